"""Language ID by compression: a text belongs to the language whose dictionary makes it smallest.

Each language's model is a zstandard raw-content dictionary of bounded size. A text is encoded whole with every
dictionary, in blocks that each start with it, as its lower-cased words without digits and signs; the smallest sum of
sizes wins, and a narrow margin to the second is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, small_batches

#: Bounds of the sample that a dictionary is made of: documents a language, bytes of each, bytes of a dictionary.
SAMPLE_DOCS, PIECE_BYTES, DICTIONARY_BYTES = 96, 1200, 96 << 10
LEVEL = 6
#: What a dictionary saves ends with its own bytes, so a longer text is encoded in blocks of so many bytes.
BLOCK_BYTES = 96 << 10
#: A text is rejected when the second language's size is within this share of the smallest.
MIN_MARGIN = 0.002
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> str:
    """The lower-cased words of a text, letters with their combining marks, each with a space on either side, without digits and signs."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, piece_bytes: int = PIECE_BYTES) -> dict[str, bytes]:
    """(doc_id, text, lang) -> a dictionary for each non-null lang with a text that has letters.

    The sample holds the sample_docs documents of the smallest id hash in each language; the middle piece_bytes of each
    go into the dictionary. One aggregation counts the languages, one reads the rows under a hash bound.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("u"), "doc_id")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    bound = F.create_map(*(x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1 << 30, (1 << 30) * (4 * sample_docs + 40) // n)))))[F.col("lang")]
    some = rows.where(F.col("u") < bound).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "text"))).where(F.col("rank") <= sample_docs)
    start = F.greatest(F.lit(1), (F.length("text") - piece_bytes).cast("int") / 2 + 1).cast("int")
    pieces = some.select("lang", "rank", F.substring(F.col("text"), start, F.lit(piece_bytes)).alias("piece")).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(pieces, key=lambda r: (r["lang"], -r["rank"])):
        out.setdefault(r["lang"], []).append(letters(r["piece"]).encode()[:piece_bytes])
    return {lang: b"\n".join(x)[-DICTIONARY_BYTES:] for lang, x in out.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.languages = sorted(dictionaries)
        self.packers = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = letters(text).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(p.compress(x)) for x in blocks) for p in self.packers]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its margin: the share by which the second size is larger. Ties go to the first name."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        ranked = sorted(zip(self.sizes(text), self.languages, strict=True))
        return ranked[0][1], 1.0 if len(ranked) == 1 else ranked[1][0] / ranked[0][0] - 1


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN, keep_text: bool = False) -> DataFrame:
    """Add lang_pred, margin and rejected to each row, and drop the text unless keep_text. No shuffle.

    Null, empty and letterless texts are `und`, with margin 0, and rejected. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "margin", "rejected") and (keep_text or c != text)]
    frame = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in small_batches(batches, "__scored"):
            found = [model.predict(t) for t in columns(batch, "__scored")[0]]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([m for _, m in found], pa.float64()), pa.array([x == UNDETERMINED or m < min_margin for x, m in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *new], names=[*kept, "lang_pred", "margin", "rejected"])

    schema = frame.select(*(F.col(f"`{c}`") for c in kept)).schema.add("lang_pred", "string").add("margin", "double").add("rejected", "boolean")
    return frame.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    """op2: learnt from documents whose crc32(doc_id as text) mod 4 is not 2; score grows with the margin from 0 to 1."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~held))
    return classify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", (1 - F.exp(-F.col("margin") * 25)).alias("score"), "rejected")
