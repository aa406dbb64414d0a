"""Fingerprints, language, lines, quality and toxicity against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.llm import fingerprints, language, lines, quality, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(1, "Héllo  WORLD ﬁne", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "Héllo world fine", None, "b"), (5, "x" * 200_000, "en", "a"), (5, "12 !?", "en", "a"), (None, "no id here", "en", "c"), (7, "Héllo  WORLD ﬁne", "en", "a"), (7, "Héllo  WORLD ﬁne", "en", "a")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return {r["doc_id"]: r for r in documents.collect()}


def odd(spark, extra=True):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumn("score", F.lit("kept")).withColumn("label", F.lit(1)) if extra else df


# --- op6


def test_fingerprint_query(documents, rows):
    got = {r["doc_id"]: r for r in fingerprints.query(documents).collect()}
    ids = sorted(rows, reverse=True)
    assert len(got) == len(ids)
    for i, d in enumerate(ids):
        t, n = rows[d]["text"] or "", rows[ids[(i + 1) % len(ids)]]["text"] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[d]["fingerprint"] == fingerprints.digest(t) and got[d]["edited_fingerprint"] == fingerprints.digest(e)
        assert got[d]["near_edited"] == float(fingerprints.canonical(e) == fingerprints.canonical(t)) and got[d]["near_next"] == float(fingerprints.canonical(n) == fingerprints.canonical(t))


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.query(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[1] == by[4] == by[7] and by[2] == by[3] and len(by[5]) == 2
    assert fingerprints.query(odd(spark).limit(0)).count() == 0
    one = fingerprints.query(odd(spark).where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_byte_comparison_parts_texts_of_one_hash(spark):
    """A hash of 4 bits makes unequal texts meet; the comparison must part them all."""
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(80)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.group_by_text(docs, bits=4).collect()}
    assert len({r["fingerprint"] for r in got.values()}) == 40
    assert all(got[i]["fingerprint"] == got[i % 40]["fingerprint"] and got[i]["copies"] == 2 and got[i]["first_doc_id"] == i % 40 for i in range(80))
    near = {r["doc_id"]: r for r in fingerprints.with_next(docs, bits=4).collect()}
    texts = {i: f"text {i % 40}" for i in range(80)}
    marks = collections.defaultdict(set)
    for i in range(80):
        e = fingerprints.edited(texts[i], texts[(i - 1) % 80])
        marks[near[i]["fingerprint"]].add(fingerprints.canonical(texts[i]))
        marks[near[i]["edited_fingerprint"]].add(fingerprints.canonical(e))
        assert near[i]["next_fingerprint"] == near[(i - 1) % 80]["fingerprint"]
    assert all(len(x) == 1 for x in marks.values()) and len(marks) == len(set().union(*marks.values()))


# --- op2


def test_language_learns_from_its_share_only_and_is_right(documents, rows):
    got = {r["doc_id"]: r for r in language.query(documents).collect()}
    held = [d for d in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d in got if got[d]["held_out"]} == set(held) and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[d]["lang_pred"] == rows[d]["lang"] for d in held]) > 0.9
    changed = documents.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang_pred"] for r in language.query(changed).collect()} == {d: r["lang_pred"] for d, r in got.items()}


def test_language_of_odd_rows(spark):
    model = {"en": language.letters("the quick brown fox and the lazy dog " * 40).encode(), "de": language.letters("der schnelle braune fuchs und der faule hund " * 40).encode()}
    df = odd(spark).withColumn("margin", F.lit("old"))
    got = language.classify(df, model).collect()
    assert len(got) == len(ODD) and "score" in got[0].asDict() and "text" not in got[0].asDict()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in got if r["doc_id"] in (2, 3))
    c = language.Classifier(model)
    assert c.predict("und der hund")[0] == "de" and c.predict("the lazy dog")[0] == "en" and c.predict("12 !?") == ("und", 0.0) and c.predict(None) == ("und", 0.0)
    assert language.fit(odd(spark).where("false")) == {} and language.Classifier({}).predict("abc") == ("und", 0.0)


# --- op3


def brute_lines(data, min_sites):
    sites = collections.defaultdict(set)
    for _, text, site in data:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None:
                sites[line.strip(" ")].add(site)
    common = {x for x, s in sites.items() if len(s) >= min_sites}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in common)) for d, t, _ in data]


def test_lines_equal_brute_force_around_the_threshold(spark):
    data = [(i, "\n".join([f"own {i}", "", *(f" line {k} " for k in range(3, 40) if i % 50 < k)]), f"s{i % 50}") for i in range(200)]
    data += [(1000, None, "s1"), (1001, "", "s1"), (1002, "line 30", None), (1003, "line 30\nline 30", "s2"), (1003, "line 30\nline 30", "s2"), (None, "line 39\nmine", "s3")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("n_lines", F.lit("x"))
    for k in (3, 10, 25):
        got = sorted(((r["doc_id"], r["text"]) for r in lines.remove_boilerplate(df, min_sites=k).collect()), key=str)
        assert got == sorted(brute_lines(data, k), key=str)
    assert lines.remove_boilerplate(df.where("false")).count() == 0


def test_line_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    names = ["doc_id", "n_lines", "n_removed", "n_chars_kept", "kept_md5"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({lines.SQL})").fetchall())
    got = sorted(tuple(r) for r in lines.query(spark.read.parquet(f"{sf}/documents.parquet")).select(names).collect())
    assert got == want and sum(r[2] for r in got) > 0


def test_lines_stay_native(documents):
    assert not re.search("Python|Pandas|Arrow", lines.query(documents)._jdf.queryExecution().toString())


# --- op9


def brute_counts(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    g = collections.Counter(zip(w, w[1:], w[2:]))
    rep = {j for i in range(len(w) - 2) if g[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    own = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(rep)


def test_quality_counts_equal_brute_force(spark, documents):
    texts = ["a b c a b c", "x x x x", "\n\n a \n a \na\n", "no break space", "\u000b\f\r\t", "one two", "q " * 3000 + "end", "# * <&>| $%", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(documents.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = df.select("doc_id", "text", *(c.alias(n) for n, c in quality.base_counts(F.col("text")).items())).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(r["text"]), r["doc_id"]


def test_quality_keeps_the_good_and_drops_the_marked(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.query(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    rows = out.join(labels, "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"])
    assert not any(r["kept"] for r in rows if r["quality"] == 0)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)


def test_quality_score_is_the_mean_weight(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad ### words"), (3, None), (4, "")], "doc_id long, text string").withColumn("kept", F.lit("old"))
    weights = quality.fit(docs, spark.createDataFrame([(1,), (3,), (99,)], "doc_id long"), buckets=64)
    w = {r["bucket"]: r["weight"] for r in weights.collect()}
    assert sorted(w) == list(range(64))
    g = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.grams(F.col("text"), 64).alias("g")).collect()}
    raw, good = collections.Counter(x for v in g.values() for x in v), collections.Counter(g[1])
    for bucket, weight in w.items():
        assert weight == pytest.approx(np.log((good[bucket] + 0.5) / (len(g[1]) + 32)) - np.log((raw[bucket] + 0.5) / (sum(raw.values()) + 32)))
    full = quality.fit(docs, spark.createDataFrame([(1,)], "doc_id long"))
    w = {r["bucket"]: r["weight"] for r in full.collect()}
    g = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.grams(F.col("text")).alias("g")).collect()}
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, full).select("doc_id", "score").collect()}
    assert got[3] == got[4] == 0 and got[1] == pytest.approx(np.mean([w[x] for x in g[1]])) and got[1] > got[2]
    assert quality.scored(docs.where("false"), quality.fit(docs, docs.select("doc_id"))).count() == 0


# --- op10


def test_toxicity_finds_pairs_that_a_sum_misses():
    """Neither word is toxic alone; both together are: only the interaction can tell."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.4
        words = [*(["insult"] if a else []), *(["group"] if b else []), *(f"w{k}" for k in rng.integers(0, 50, 8))]
        rows.append(toxicity.buckets(" ".join(words)))
        labels.append(int(a and b))
    model = toxicity.train(rows, np.array(labels), epochs=40)
    score = lambda t: model.score(toxicity.buckets(t))
    assert score("insult group w1") > 0.5 > max(score("insult w1"), score("group w1"), score("w1 w2"), score(""))
    again = toxicity.train(rows, np.array(labels), epochs=40)
    assert np.array_equal(again.w, model.w)


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    assert np.mean(np.array(toxic) >= 0.5) > 0.75 and np.mean(np.array(clean) < 0.5) > 0.98
    assert np.mean([t > c for t in toxic for c in clean]) > 0.9


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, None)], "doc_id long, toxic int")
    assert toxicity.query(odd(spark), labels).count() == len(ODD)
    assert toxicity.query(odd(spark), labels.where("false")).count() == len(ODD)
    assert toxicity.query(odd(spark).where("false"), labels).count() == 0
