"""Mixing sources to target weights: budgets in a domain-language-source tree, token-prefixes of seeded epochs.

Budgets flow from the root by weights. What a child can't supply (its tokens times the epochs allowed) goes to its
siblings by their weights; only what all of them can't supply goes to the parent's siblings. A leaf takes whole epochs and
then the documents of one more epoch in that epoch's order, until its budget is met.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = ("domain", "lang", "source")
#: About so many documents stand in a bin of a leaf's order; only the bin in which a budget ends is sorted.
BIN_DOCS = 4096
#: Leaf tables of up to so many rows go through the driver and are broadcast; larger ones are worked on and joined by shuffles.
BROADCAST_LEAVES = 50_000


def share_out(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Shares of a budget for (weight, capacity) children: by weight, no more than capacity, the rest to the others by weight."""
    out, left, open_ = [0.0] * len(children), budget, [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] - out[i] <= left * children[i][0] / total]
        if not full:
            for i in open_:
                out[i] += left * children[i][0] / total
            break
        for i in full:
            left -= children[i][1] - out[i]
            out[i] = children[i][1]
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def budgets(capacity: Mapping[tuple, float], weights: Mapping[tuple, float], total: float) -> dict[tuple, float]:
    """Leaf budgets. weights: by path from the root, such as ("web",), ("web", "en"); a path without one weighs 1."""
    out: dict[tuple, float] = {}

    def walk(prefix: tuple, leaves: list[tuple], budget: float) -> None:
        depth = len(prefix)
        if leaves == [prefix]:
            out[prefix] = budget
            return
        groups: dict[str, list[tuple]] = {}
        for leaf in leaves:
            groups.setdefault(leaf[depth], []).append(leaf)
        shares = share_out(budget, [(weights.get((*prefix, n), 1.0), sum(capacity[x] for x in g)) for n, g in groups.items()])
        for (n, g), s in zip(groups.items(), shares, strict=True):
            walk((*prefix, n), g, s)

    if capacity:
        walk((), sorted(capacity), min(float(total), float(sum(capacity.values()))))
    return out


def n_tokens(text: Column) -> Column:
    """Words of a text; zero for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def place(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """A document's place from 0 to 2^60 in a seeded epoch's order; one without an id goes by a hash of its text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), name)), 1, 15), 16, 10).cast("long")


def budget_frame(leaves: DataFrame, weights: Mapping[tuple, float], total: float, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens, ...) with `found`, the same budgets as budgets() gives, level by level on executors.

    Children are ordered by capacity over weight; those whose level lies under the water line are full, and what is left
    goes to the others by weight. The running sums go along a sorted parent without holding it.
    """
    nodes = leaves.withColumn("cap", F.coalesce("tokens", F.lit(0)).cast("double") * max_epochs)
    above = None
    for depth, name in enumerate(LEVELS, 1):
        path = list(LEVELS[:depth])
        level = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"))
        known = [x for w in weights.items() if len(w[0]) == depth for x in (F.lit("\u001f".join(w[0])), F.lit(float(w[1])))]
        weight = F.create_map(*known)[F.concat_ws("\u001f", *path)] if known else F.lit(None).cast("double")
        level = level.withColumn("w", F.coalesce(weight, F.lit(1.0)))
        if above is None:
            parents = level.agg(F.least(F.lit(float(total)), F.sum("cap")).alias("budget"))
            level = level.join(F.broadcast(parents))  # one row
        else:
            level = level.join(above, path[:-1])
        up = path[:-1] or [F.lit(0)]
        live = (F.col("w") > 0) & (F.col("cap") > 0)
        along = Window.partitionBy(*up).orderBy("r", name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        some = level.where(live).withColumn("r", F.col("cap") / F.col("w"))
        some = some.withColumn("caps", F.sum("cap").over(along)).withColumn("ws", F.sum("w").over(along))
        sums = some.groupBy(*path[:-1]).agg(F.sum("w").alias("all_w"))
        some = some.join(sums, path[:-1]) if path[:-1] else some.join(F.broadcast(sums))
        some = some.withColumn("full", F.col("caps") + F.col("r") * (F.col("all_w") - F.col("ws")) <= F.col("budget"))
        lines = some.groupBy(*path[:-1]).agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0.0)).alias("taken"), F.sum(F.when(~F.col("full"), F.col("w"))).alias("rest_w"))
        some = some.join(lines, path[:-1]) if path[:-1] else some.join(F.broadcast(lines))
        share = F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - F.col("taken")) / F.col("rest_w") * F.col("w"))
        above = some.select(*path, share.alias("budget")).unionByName(level.where(~live).select(*path, F.lit(0.0).alias("budget")))
    return leaves.join(above.withColumnRenamed("budget", "found"), list(LEVELS))


def plan(sized: DataFrame, weights: Mapping[tuple, float], total: float | None, max_epochs: int, share: float = 1.0) -> tuple[DataFrame, int]:
    """(domain, lang, source, n_tokens) -> a row a leaf: budget, whole epochs, tokens of the epoch that is cut, bins; and how many leaves.

    Up to BROADCAST_LEAVES leaves are shared out by the driver, more of them on executors. total None: share of all tokens.
    """
    leaves = written(sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    n = leaves.count()
    if total is None:
        total = share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    if n <= BROADCAST_LEAVES:
        rows = leaves.collect()
        found = budgets({tuple(r[x] for x in LEVELS): float((r["tokens"] or 0) * max_epochs) for r in rows}, weights, total)
        flat = [(*(r[x] for x in LEVELS), r["tokens"], r["docs"], found[tuple(r[x] for x in LEVELS)]) for r in rows]
        leaves = sized.sparkSession.createDataFrame(flat, "domain string, lang string, source string, tokens long, docs long, found double")
    else:
        leaves = written(budget_frame(leaves, weights, total, max_epochs), "budgets")
    leaves = leaves.withColumn("budget", F.floor(F.col("found") + 1e-6))
    some, bins = F.col("tokens") > 0, F.expr(f"docs div {BIN_DOCS}")
    leaves = leaves.withColumn("whole", F.when(some, F.least(F.expr("budget div tokens"), F.lit(max_epochs))).otherwise(0).cast("long"))
    leaves = leaves.withColumn("cut", F.when(some, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0).cast("long"))
    return leaves.select(*LEVELS, "budget", "whole", "cut", F.when(bins > 0, F.length(F.bin(bins))).otherwise(0).alias("bin_bits")), n


def select(docs: DataFrame, domain: Column, weights: Mapping[tuple, float], total: float | None = None, share: float = 1.0, max_epochs: int = 1, seed: int = 0, text: str = "text") -> DataFrame:
    """docs' rows of the mix, each once an epoch, with __leaf (domain, lang, source), __epoch, __tokens and __budget.

    total: tokens of the mix; None: share of all tokens. A document without a word is taken with its leaf's whole
    epochs only, or if its place lies before the cut. A null lang or source is a leaf of its own, named "". Repeated rows count each.
    """
    leaf = F.struct(F.coalesce(domain.cast("string"), F.lit("")).alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"))
    sized = docs.withColumn("__leaf", leaf).withColumn("__tokens", n_tokens(F.col(f"`{text}`")))
    leaves, n = plan(sized.select("__leaf.*", F.col("__tokens").alias("n_tokens")), weights, total, max_epochs, share)
    hint = F.broadcast if n <= BROADCAST_LEAVES else lambda x: x
    plans = leaves.select(F.struct(*LEVELS).alias("__leaf"), F.col("budget").alias("__budget"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"), F.col("bin_bits").alias("__bits"))
    rows = sized.join(hint(plans), "__leaf").withColumn("__place", place(seed, F.col("__whole"), F.col("doc_id"), F.col(f"`{text}`"))).withColumn("__bin", F.expr("shiftright(__place, 60 - __bits)"))
    whole = rows.where("__whole > 0").withColumn("__epoch", F.explode(F.expr("sequence(0L, __whole - 1)")))
    # the bin in which each leaf's cut ends
    bins = rows.where("__cut > 0").groupBy("__leaf", "__cut", "__bin").agg(F.sum("__tokens").alias("n"))
    upto = bins.withColumn("after", F.sum("n").over(Window.partitionBy("__leaf").orderBy("__bin"))).withColumn("before", F.col("after") - F.col("n"))
    ends = written(upto.where("before < __cut and after >= __cut").groupBy("__leaf").agg(F.min("__bin").alias("__end"), F.min_by("before", "__bin").alias("__before")), "ends")
    cut = rows.where("__cut > 0").join(hint(ends), "__leaf").withColumn("__epoch", F.col("__whole"))
    sure = cut.where("__bin < __end")
    # only the bin in which a leaf's cut ends is sorted: some BIN_DOCS rows, whatever the leaf's size
    last = cut.where("__bin = __end").withColumn("__sum", F.sum("__tokens").over(Window.partitionBy("__leaf").orderBy("__place", "doc_id", F.hash(F.col(f"`{text}`"))).rowsBetween(Window.unboundedPreceding, -1)))
    last = last.where(F.col("__before") + F.coalesce("__sum", F.lit(0)) < F.col("__cut")).drop("__sum")
    names = [*docs.columns, "__leaf", "__epoch", "__tokens", "__budget"]
    return whole.select(*names).unionByName(sure.select(*names)).unionByName(last.select(*names))


#: The mix of the registered query: weights by domain and by language under each; sources of a language weigh alike.
DOMAINS = ("web", "books", "forums")
WEIGHTS: dict[tuple, float] = {("web",): 0.5, ("books",): 0.3, ("forums",): 0.2, **{(d, lang): w for d in DOMAINS for lang, w in (("en", 0.55), ("fr", 0.15), ("de", 0.15), ("es", 0.15))}}


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 3 (no number: web)."""
    n = F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), "(\\d+)$", 1).try_cast("long"), F.lit(0))
    return F.when(n % 3 == 0, F.lit(DOMAINS[0])).when(n % 3 == 1, F.lit(DOMAINS[1])).otherwise(F.lit(DOMAINS[2]))


def query(docs: DataFrame) -> DataFrame:
    """op5: as many tokens as the corpus has, in up to three epochs a leaf."""
    rows = select(docs.select("doc_id", "text", "lang", "source"), domain_of(F.col("source")), WEIGHTS, max_epochs=3, seed=17)
    return rows.select("__leaf.domain", "__leaf.lang", "__leaf.source", "doc_id", F.col("__epoch").alias("epoch"), F.col("__tokens").alias("n_tokens"), F.col("__budget").alias("leaf_budget"))
