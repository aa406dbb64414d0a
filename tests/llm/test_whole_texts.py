"""Whole texts: long ones, repeated rows, strings of added tokens."""

import collections
import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_corpora import brute_links, brute_mix, edited_groups, words

import corpus_pipeline
from rastermill.llm import common, fingerprints, jaccard, language, lines, mixing, packing, toxicity


def test_margins_of_long_texts_stay():
    rng = np.random.default_rng(5)
    vocabulary = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(4000)] for lang, letters in (("en", "etaoinshrdlu"), ("xx", "etaoinvkjzqy"))}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    model = language.Classifier({lang: language.letters(text(lang, 14_000)).encode()[: language.DICTIONARY_BYTES] for lang in vocabulary})
    whole = text("en", 1_200_000)
    assert len(whole) > 6_500_000
    found, margin = model.predict(whole)
    short = model.predict(whole[:50_000])
    assert found == short[0] == "en" and margin > language.MIN_MARGIN and margin > short[1] / 4


def test_near_duplicates_keep_one_row_of_an_id_and_part_namesakes(spark):
    one, two, own = ("a b c d e f g h", "k l m n o p q r", "s t u v w x y z")
    rows = [(1, one), (1, one), (2, one), (2, own), (3, two), (3, two), (4, two), (5, "z z y y x x w w"), (5, "a z y y x x w v"), (None, one), (None, one)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(1, one), (2, own), (3, two), (5, "a z y y x x w v"), (None, one), (None, one)], key=str)


def test_strings_of_added_tokens_are_as_the_library_has_them():
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(packing.default_tokenizer()), packing.tokenizer(packing.default_tokenizer())
    for text in ("abc <|endoftext|> def", "<|endoftext|>", "x<|endoftext|", "<|endoftext|><|endoftext|> ß"):
        assert ours.ids(text) == library.encode(text, add_special_tokens=False).ids, text
    assert ours.fast is not None and len(ours.ids("abc <|endoftext|> def")) == 4


# --- registered queries and pipeline stages against brute force

SF = "/root/testdata/sf0.001"


def library_pieces(rows):
    """Ids of each document by the tokenizers library alone."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    return {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}


def same_pieces(pieces, ids):
    ends = collections.defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == ends[p["doc_id"]] and p["doc_tokens"] == len(ids[p["doc_id"]])
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == p["length"]
        ends[p["doc_id"]] += p["length"]
    assert ends == {d: len(x) for d, x in ids.items()}


def test_packed_ids_are_the_librarys(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "a <|endoftext|><|endoftext|> b"), (-2, None)], "doc_id long, text string"))
    same_pieces(packing.query(docs).collect(), library_pieces([tuple(r) for r in docs.collect()]))


def brute_language(rows, dictionaries):
    """Sizes of each text by a compressor made anew for each block, and the share by which the second language's is larger."""
    out = {}
    for d, t in rows:
        if not t or not any(c.isalpha() for c in t):
            out[d] = ("und", 0.0)
            continue
        data, sizes = language.letters(t).encode("utf-8", "surrogatepass"), []
        for lang in sorted(dictionaries):
            total = 0
            for i in range(0, len(data), language.BLOCK_BYTES):
                known = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=language.LEVEL)
                total += len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data[i : i + language.BLOCK_BYTES]))
            sizes.append((total, lang))
        (least, lang), (second, _) = sorted(sizes)[:2]
        out[d] = (lang, second / least - 1)
    return out


def test_language_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learnt = docs.where("crc32(cast(doc_id as string)) % 4 <> 2")
    want = brute_language([(r["doc_id"], r["text"]) for r in docs.collect()], language.fit(learnt))
    for r in language.query(docs).collect():
        lang, margin = want[r["doc_id"]]
        assert (r["lang_pred"], r["held_out"]) == (lang, zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["score"] == pytest.approx(1 - math.exp(-25 * margin))


def test_language_ties_are_rejected():
    model = language.Classifier({"aa": b" one two three ", "bb": b" one two three "})
    assert model.predict("one two") == ("aa", 0.0) and 0.0 < language.MIN_MARGIN


def test_toxicity_query_equals_a_naive_scorer(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    known = labels.where("crc32(cast(doc_id as string)) % 5 <> 0").selectExpr("doc_id", "toxic as label")
    model, texts = toxicity.fit(docs, known), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.query(docs, labels).collect():
        at = [model.active[b] for b in toxicity.buckets(texts[r["doc_id"]])]
        at = [i for i in at if i >= 0]
        z = model.w0 + sum(float(model.w[i]) for i in at) + sum(float(np.dot(model.v[i], model.v[j])) for k, i in enumerate(at) for j in at[k + 1 :])
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert r["score"] == pytest.approx(score, abs=1e-4) and r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5)


def test_each_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}

    found = corpus_pipeline.identify_language(spark, docs, SF)
    want = brute_language([(d, r["text"]) for d, r in rows.items()], language.fit(docs))
    rows = {d: r | {"lang": want[d][0]} for d, r in rows.items() if want[d][0] != "und" and want[d][1] >= language.MIN_MARGIN}
    assert {r["doc_id"]: r.asDict() for r in found.collect()} == rows

    found = corpus_pipeline.dedup_lines(spark, found, SF)
    sites = collections.defaultdict(set)
    for r in rows.values():
        for x in r["text"].split("\n"):
            sites[x.strip(" ")].add(r["source"])
    common = {x for x, s in sites.items() if x and len(s - {None}) >= lines.MIN_SITES}
    for r in rows.values():
        r["text"] = "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in common)
        r["n_chars"] = len(r["text"])
    assert {r["doc_id"]: r.asDict() for r in found.collect()} == rows

    found = corpus_pipeline.drop_near_duplicates(spark, found, SF)
    rows = {d: rows[d] for d, _, c in brute_links([(d, r["text"]) for d, r in rows.items()], 5, 80) if c == d}
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(rows)

    found = corpus_pipeline.mix(spark, found, SF)
    domains = dict(found.sparkSession.createDataFrame([(d, r["source"]) for d, r in rows.items()], "d long, s string").select("d", mixing.domain_of(F.col("s"))).collect())
    total = corpus_pipeline.MIX_SHARE * sum(len(words(r["text"])) for r in rows.values())
    taken = brute_mix([(d, r["text"], r["lang"], r["source"], domains[d]) for d, r in rows.items()], mixing.WEIGHTS, total, 1, 17)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(d for d, _ in taken) and len(taken) < len(rows)

    same_pieces(corpus_pipeline.pack(spark, found, SF).collect(), library_pieces([(d, rows[d]["text"]) for d, _ in taken]))


def test_stages_of_odd_rows(spark):
    """Nulls in every column, repeated rows, empty and letterless texts, columns that the operators use themselves."""
    text = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    rows = [(1, text, "en", "s1", 74), (1, text, "en", "s1", 74), (2, text, None, None, None), (None, text + " home", "en", "s2", 80), (None, None, None, None, None), (3, "", "en", "s1", 0), (4, "123 !?", "de", "s1", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("digest", "lang_pred", "n_lines", "tokens", "key")})
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, SF)
            kept = found.collect()
            if name != "packing":
                assert found.columns == docs.columns
                if name in ("lines", "mixing"):
                    assert len(kept) <= table.count()
            if name == "language":
                assert {r["text"] for r in kept} <= {text, text + " home"}
            if name == "near_duplicates" and table is docs:
                assert [r["doc_id"] for r in kept if r["text"] == text] == [1]


# --- hot keys


def test_hot_keys_meet_all_their_rows(spark, monkeypatch):
    """With hot keys from three rows on, joins have the rows of plain ones."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 9 + [2] * 3 + [3, 4, 5] + [None] * 4)], "k long, i long")
    right = spark.createDataFrame([(1, "a", 9), (2, "b", 3), (3, "c", 1), (6, "d", 0)], "k long, v string, n long")
    for how in ("inner", "left", "left_semi"):
        got = common.join_counted(left, right, "k", "n", how)
        want = left.join(right.select("k", "v"), "k", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), how
    salted = common.join_salted(left, right.select("k", "v"), "k", ["i"], left, rows_each=3)
    assert sorted((r["i"], r["v"]) for r in salted.collect()) == sorted((r["i"], r["v"]) for r in left.join(right, "k").collect())


def test_links_and_groups_with_hot_keys_everywhere(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = edited_groups(7, groups=6, members=10)
    rows += [(1000 + i, rows[0][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.similar_sets(df, width=3, percent=70, frequent=4, block=4, reorder_blocks=2).collect()) == brute_links(rows, 3, 70)
    found = fingerprints.group_by_text(df).collect()
    sizes = collections.Counter(t for _, t in rows)
    assert {(r["doc_id"], r["copies"]) for r in found} == {(d, sizes[t]) for d, t in rows}


def test_combining_marks_stay_with_their_letters():
    assert language.letters("हिन्दी, 12 É_é!") == " हिन्दी é é "
