"""Substrings, Jaccard links, mixing, packing, archives and the pipeline against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.llm import components, jaccard, mixing, packing, substrings, warc

SF = "/root/testdata/sf0.001"
SEPARATOR = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [x for x in SEPARATOR.split(text or "") if x]


# --- op1


def brute_substrings(rows, window):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches, runs", [(1, 2), (3, 2), (6, 2)])
def test_substrings_equal_brute_force(spark, batches, runs):
    """Six batches over at most two runs compact twice."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = substrings.dedup(docs, batches=batches, max_runs=runs)
    assert sorted(tuple(r) for r in got.drop("kept").collect()) == sorted(brute_substrings([(r["doc_id"], r["text"]) for r in docs.collect()], 20))


def test_a_saved_index_goes_on_in_a_later_session(spark, tmp_path):
    word = lambda i: f"w{i % 60}"
    rows = [(i, " ".join(word(i * 7 + j) for j in range(30))) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0]: r[1:] for r in brute_substrings(rows, 20)}
    first, got = substrings.Index(spark, 6, max_runs=1), []
    first.save(f"file://{tmp_path}/empty")
    index = substrings.Index.open(spark, f"file://{tmp_path}/empty")
    for k in range(4):  # a snapshot after each batch, compacted runs among them
        got += index.add(df.where(f"doc_id between {3 * k + 1} and {3 * k + 3}")).drop("kept").collect()
        index.save(f"file://{tmp_path}/s{k}")
        index.drop()
        index = substrings.Index.open(spark, f"file://{tmp_path}/s{k}")
    index.drop()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and any(r["n_removed"] for r in got)
    again = substrings.Index.open(spark, f"file://{tmp_path}/s1")  # an older snapshot is still whole
    assert [tuple(r)[1:] for r in again.add(df.where("doc_id = 7"), keep=False).drop("kept").collect()] == [want[7]]
    again.drop()


def test_substrings_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(6)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\t\n \x0b"), (103, "ü x " * 30), (104, "same word " * 5000), (105, "same word " * 5000), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(0))
    for window in (3, 20):
        got = substrings.dedup(df, window=window, batches=2, with_text=True).collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(brute_substrings(rows, window), key=str)
        assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert substrings.dedup(df.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substrings.dedup(twice, window=3, batches=1).collect()) == [0, 5]


def test_one_key_with_two_tags_is_verified():
    """Equal keys count only with equal check tags."""
    keys, tags = np.array([5, 5, 7], np.uint64), np.array([1, 2, 1], np.uint32)
    found = substrings._flagged(keys, tags, np.array([5, 7], np.uint64), np.array([2, 9], np.uint32))
    assert found.tolist() == [False, True, False]
    order, begins = substrings._ordered(np.array([5, 5, 5], np.uint64), np.array([2, 1, 2], np.uint32))
    assert order.tolist() == [1, 0, 2] and begins.tolist() == [0, 1]


# --- op4


def brute_links(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, holders = sorted(sets), collections.defaultdict(list)
    for d in ids:
        for x in sets[d]:
            holders[x].append(d)
    for a in ids:
        for b in {d for x in sets[a] for d in holders[x] if d > a}:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def edited_groups(seed, groups=12, members=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g % 5}x{k}" for k in range(int(rng.integers(1, 60)))]
        for _ in range(members):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("width, percent, frequent, block", [(4, 85, 4096, 512), (4, 85, 4, 3), (5, 80, 4096, 2), (1, 60, 4, 4)])
def test_links_equal_brute_force(spark, width, percent, frequent, block):
    """With `frequent` at 4 nearly all candidates come from combinations of two tokens; small blocks make groups into corpora of their own."""
    rows = edited_groups(width * percent)
    rows += [(900, None), (901, ""), (902, "a"), (903, "A"), (904, "a b"), (905, "A\tB"), (906, "x y z " * 2000), (907, "x y z " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.similar_sets(df, width=width, percent=percent, frequent=frequent, block=block, reorder_blocks=1).collect())
    assert got == brute_links(rows, width, percent)


def test_links_of_a_template_with_slots(spark):
    """Many texts share most words and few pairs link: one list holds all, and its lead links with few."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join([f"t{k}" for k in range(40)] + [f"s{j}v{rng.integers(0, 4)}" for j in range(14)])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.similar_sets(df, width=1, percent=75, frequent=4, block=8, reorder_blocks=2).collect())
    want = brute_links(rows, 1, 75)
    assert got == want and 1 < len({c for _, _, c in want}) < 90


def test_linked_sets_have_a_kind_of_key_in_common():
    """Around the length from which on single tokens are keys."""
    for long in (8, 10, 12):
        for n in range(4, 24):
            a = np.arange(n, dtype=np.uint64)
            for m in range(n, 25):
                b = np.arange(m, dtype=np.uint64)
                if 100 * n >= 80 * m:  # a lies in b
                    keys = [set(jaccard.keys_of(x, np.full(len(x), 99), 80, 2, 4, long)) for x in (a, b)]
                    assert keys[0] & keys[1], (long, n, m)
    many = np.arange(5000, dtype=np.uint64)
    assert len(jaccard.keys_of(many, np.full(5000, 9999), 80, 2, 4096)) <= 5000


def test_documents_link_as_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(tuple(r) for r in jaccard.query(docs).collect()) == brute_links([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 85)


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_on_which_polynomial_hashes_collide(spark):
    """Complementary Thue-Morse words of 1,024 letters have one polynomial hash modulo 2^64 in every odd base."""
    a, b = thue_morse(10)
    rest = " ".join(f"w{k}" for k in range(19))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.query(df).collect()) == [(1, 0), (2, 0), (3, 20)]
    short = spark.createDataFrame([(1, f"{a} x y z"), (2, f"{b} x y z"), (3, f"{a} x y z"), (4, a), (5, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.query(short).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)]


def test_substrings_of_extreme_ids(spark):
    """Ids from the least to the greatest in one unit: smaller ids come first."""
    text = " ".join(f"w{k}" for k in range(25))
    ids = [-(1 << 63), -5, 0, 7, (1 << 63) - 2]
    df = spark.createDataFrame([(i, text) for i in reversed(ids)] + [(None, text)], "doc_id long, text string").coalesce(1)
    for batches in (1, 3):
        got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(df, batches=batches).collect()}
        assert got == {None: 25, **{i: 25 for i in ids[1:]}, ids[0]: 0}


def test_links_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string").withColumn("digest", F.lit("x"))
    got = sorted((tuple(r) for r in jaccard.query(df).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, None), (2, 3, 1)], key=str)
    assert jaccard.query(df.where("false")).count() == 0
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {1, None}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 200)] + [(7, 7), (300, 250), (300, 250)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 10 for i in range(10, 41)) and all(got[k] == 100 for k in range(100, 200)) and got[7] == 7 and got[300] == got[250] == 250
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op5


def test_shares_go_to_siblings_before_ancestors():
    capacity = {("w", "en", "a"): 10.0, ("w", "en", "b"): 100.0, ("w", "fr", "c"): 100.0, ("x", "en", "d"): 1000.0}
    got = mixing.budgets(capacity, {("w",): 1.0, ("x",): 1.0}, 160)
    assert got == {("w", "en", "a"): 10.0, ("w", "en", "b"): 30.0, ("w", "fr", "c"): 40.0, ("x", "en", "d"): 80.0}
    far = mixing.budgets(capacity, {}, 1000)
    assert far[("w", "fr", "c")] == 100 and sum(far.values()) == pytest.approx(1000) and far[("x", "en", "d")] == pytest.approx(790)
    assert mixing.budgets({}, {}, 5) == {} and mixing.share_out(5, [(1, 0.0)]) == [0.0]


def brute_mix(rows, weights, total, max_epochs, seed):
    leaves = collections.defaultdict(list)
    for d, t, lang, source, domain in rows:
        leaves[domain or "", lang or "", source or ""].append((d, len(words(t)), t))
    tokens = {k: sum(n for _, n, _ in v) for k, v in leaves.items()}
    out = []
    for leaf, budget in mixing.budgets({k: float(v * max_epochs) for k, v in tokens.items()}, weights, total).items():
        budget = int(budget + 1e-6)
        whole = min(budget // tokens[leaf], max_epochs) if tokens[leaf] else 0
        out += [(d, e) for e in range(whole) for d, _, _ in leaves[leaf]]
        cut, sofar = budget - whole * tokens[leaf] if tokens[leaf] else 0, 0
        place = lambda d: int(hashlib.md5("|".join([str(seed), str(whole), *([str(d)] if d is not None else [])]).encode()).hexdigest()[:15], 16)
        for d, n, _ in sorted(leaves[leaf], key=lambda x: (place(x[0]), x[0])):
            if sofar >= cut:
                break
            out.append((d, whole))
            sofar += n
    return sorted(out)


def test_budgets_on_executors_equal_the_drivers(spark):
    rng = np.random.default_rng(2)
    leaves = [(f"d{i % 3}", f"l{i % 7 % 4}", f"s{i}", int(rng.integers(0, 50)) * int(rng.integers(1, 200)), 1) for i in range(120)]
    weights = {("d0",): 3.0, ("d1",): 0.0, ("d0", "l1"): 4.0, ("d2", "l2"): 0.0, ("d0", "l1", "s1"): 0.2}
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    for total in (10.0, 50_000.0, 300_000.0, 1e9):
        want = mixing.budgets({x[:3]: 2.0 * x[3] for x in leaves}, weights, total)
        got = {(r["domain"], r["lang"], r["source"]): r["found"] for r in mixing.budget_frame(frame, weights, total, 2).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want), total


@pytest.mark.parametrize("max_epochs, share, leaves", [(1, 0.7, 50_000), (3, 1.2, 50_000), (3, 0.3, 0)])
def test_mix_equals_brute_force(spark, monkeypatch, max_epochs, share, leaves):
    monkeypatch.setattr(mixing, "BIN_DOCS", 4)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", leaves)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("w" * int(rng.integers(1, 30))) if i % 17 else None, str(rng.choice(["en", "fr"])) if i % 13 else None, f"s{i % 3 if i % 2 else 0}", "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string").withColumn("tokens", F.lit("x"))
    total = share * sum(len(words(r[1])) for r in rows)
    weights = {("a",): 3.0, ("b",): 1.0, ("a", "en"): 2.0}
    got = mixing.select(df, F.col("domain"), weights, total=total, max_epochs=max_epochs, seed=9)
    assert set(df.columns) <= set(got.columns)
    assert sorted((r["doc_id"], r["__epoch"]) for r in got.collect()) == brute_mix(rows, weights, total, max_epochs, 9)
    assert mixing.select(df.where("false"), F.col("domain"), weights).count() == 0


# --- op7


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    t = packing.tokenizer(packing.default_tokenizer())
    assert t.fast is not None
    library = Tokenizer.from_file(packing.default_tokenizer())
    for text in ["", " ", "\n\n  x", "It's  'tis I'LL 12345 ½²³ Ⅷ", "naïve Straße ÀÉ", "汉字 かな 한글 😀🇩🇪", "a" * 3000, " \t   x", "é ‍ ﬁ", "{}();#%$ -- ...", "ß" * 50 + "\x00\x01"]:
        assert t.ids(text) == library.encode(text, add_special_tokens=False).ids, text


def check_packing(pieces, texts, sequence=1024):
    t = packing.tokenizer(packing.default_tokenizer())
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert set(docs) == set(texts)
    for d, own in docs.items():
        ids, at = np.array([*t.ids(texts[d] or ""), 0], "<u4"), 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= sequence
    return sequences


def test_packing_holds_every_id_once_with_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sequences = check_packing(packing.query(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert sum(sum(p["length"] for p in s) < 1024 for s in sequences.values()) <= 4


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b " * 5000), (4, "x"), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit("k"))
    check_packing(packing.pack(df).collect(), dict(rows))
    assert packing.pack(df.where("false")).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")).count() == 3


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert sorted(packing.hilbert(grid, 3).tolist()) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# --- op8


def test_archives_round_trip(spark, tmp_path):
    big = "".join(chr(33 + i * 7 % 90) for i in range(20_000))
    rows = [(3, "http://a/", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b/", None), (4, "http://c/\r\nX: y", ""), (5, "u", "é" * 10), (6, "u", big), (7, "u", "y" * (17 << 20)), (8, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = "file://" + str(tmp_path / "w")
    files = warc.write_archives(df.repartition(3), path)
    assert files and all(f.endswith(".warc.gz") for f in files)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path, with_payload=True).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == warc.sha1_base32(data)
        if got[i]["record_type"] == "response":
            assert bytes(got[i]["payload"]) == data
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {3: 1, 4: 2}
    assert warc.query(df.where("false")).count() == 0
    kept = warc.write_archives(df, path + "2", revisit_bytes=100)
    assert kept and warc.read_archives(spark, path + "2").where("record_type = 'revisit'").count() == 0
    assert warc.query(spark.createDataFrame([(None, "u", "z"), (9, "u", "z"), (9, "u", "z")], "page_id long, url string, html string")).count() == 3


def test_reader_finds_what_is_broken():
    good = warc.record(1, "u", b"hello", None)
    assert [r["payload"] for r in warc.read_records(warc.member(good) + warc.EMPTY_MEMBER + warc.member(good))] == [b"hello"] * 2
    for bad in (good.replace(b"hello", b"hellO"), good[:-6], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length: 5", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            list(warc.read_records(warc.member(bad)))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(warc.member(good)[:-9]))


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src1", 0)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        docs = out
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(left) == docs.count() and 9001 not in left
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), left)
