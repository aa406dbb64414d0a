"""Spatial joins: radius joins by buckets, exact nearest neighbours by trees, polygon predicates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.nulls import positive
from .tree import SLACK, Tree, along, gap2

#: A side of at most so many rows may be broadcast for a nearest-neighbour search.
BROADCAST_ROWS = 2000
#: One of at most so many rows goes to the tasks as a tree; a larger one meets the other side on tiles.
ARRAY_ROWS = 1_000_000
#: Rows of a tile, boxes of a tile that the tasks get, rows that meet one copy of a tile (on average).
TILE_ROWS, RUNS, GROUP_ROWS = 250_000, 64, 250_000


def _bucketed(df: DataFrame, size: float, spread: bool) -> DataFrame:
    bx, by = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    if not spread:
        return df.withColumn("__bx", bx).withColumn("__by", by)
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    return df.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumn("__bx", bx + F.col("__dx")).withColumn("__by", by + F.col("__dy")).drop("__dx", "__dy")


def radius_join(a: DataFrame, b: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of (a_id, x, y) and (b_id, x, y) within the radius, inclusive, with distance_m: an equi-join of buckets."""
    r = positive("radius_m", radius_m)
    left = _bucketed(a, r, False).withColumnsRenamed({"x": "ax", "y": "ay"})
    right = _bucketed(b, r, True).withColumnsRenamed({"x": "bx", "y": "by"})
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return left.join(right, ["__bx", "__by"]).withColumn("distance_m", d).where(F.col("distance_m") <= r).drop("__bx", "__by")


def point_density(cells: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """cells (a_id, x, y) with n_points within the radius; 0 where there is none. Points are spread, not cells."""
    n = radius_join(cells.select("a_id", "x", "y"), points.select("b_id", "x", "y"), radius_m).groupBy("a_id").agg(F.count("*").alias("n_points"))
    return cells.join(n, "a_id", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def nearest(a: DataFrame, b: DataFrame, start_m: float = 10_000.0, broadcast_rows: int = BROADCAST_ROWS, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """(a_id, b_id, distance_m) for every a, b the nearest; ties go to the smallest b_id.

    A b side of at most broadcast_rows rows is broadcast; a larger one is searched as in nearest_few. An empty b gives
    NULLs. start_m has no effect any more and is kept for callers.
    """
    few = b.limit(broadcast_rows + 1).count()
    if few > broadcast_rows:
        return nearest_few(a, b, 1, array_rows=array_rows).select("a_id", "b_id", "distance_m")
    left, right = a.select("a_id", F.col("x").alias("ax"), F.col("y").alias("ay")), b.select("b_id", F.col("x").alias("bx"), F.col("y").alias("by")).dropna(subset=["bx", "by"])
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    met = left.dropna(subset=["ax", "ay"]).join(F.broadcast(right), F.lit(True)).withColumn("d", F.sqrt(dx * dx + dy * dy))
    found = met.groupBy("a_id").agg(F.min(F.struct("d", "b_id")).alias("best"))
    return a.select("a_id").join(found, "a_id", "left").select("a_id", F.col("best.b_id").alias("b_id"), F.col("best.d").alias("distance_m"))


def nearest_few(a: DataFrame, b: DataFrame, k: int, within_m: float = math.inf, carried: Sequence[str] = (), array_rows: int = ARRAY_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a_id, place, b_id, distance_m, *carried of b): up to k nearest b of every a by (distance, b_id), place from 1 on.

    An a without any has one row of NULLs. Exact on both ways: a b side of at most array_rows rows goes to the tasks as one
    tree; a larger one is cut along a curve into tiles of some tile_rows rows, which meet those a for which they may hold one.
    """
    if not 1 <= k <= Tree.MOST:
        raise ValueError(f"k must lie between 1 and {Tree.MOST}")
    names = ["b_id", *carried]
    xy = [F.col(c).cast("double").alias(c) for c in "xy"]
    left, right = a.select("a_id", *xy), b.select(*names, *xy).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    kept = StructType([StructField("place", IntegerType()), StructField("distance_m", DoubleType()), *(StructField(c, right.schema[c].dataType) for c in names)])
    schema = StructType([left.schema["a_id"], *kept])
    n = right.count()
    if n <= array_rows:
        table = right.toArrow().combine_chunks()
        table = table.take(pc.sort_indices(table, [("b_id", "ascending")]))
        tree, rows = Tree(*(table[c].to_numpy() for c in "xy"), k), table.select(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _matches(pa.Table.from_batches([batch]), tree, rows, k, within_m, True).to_batches()

        found = left.repartition("a_id").mapInArrow(run, schema)
    else:
        found = _nearest_on_tiles(left, right, k, within_m, names, schema, n, tile_rows)
    return found.select("a_id", "place", "b_id", "distance_m", *carried)


def _matches(a: pa.Table, tree: Tree, rows: pa.Table, k: int, within_m: float, all_rows: bool) -> pa.Table:
    """a_id, place, distance_m and the columns of rows; all_rows: NULLs for an a without any."""
    i, rank, d, place = tree.query(*(a[c].to_numpy().astype(float) for c in "xy"), k, within_m)
    if all_rows and len(none := np.setdiff1d(np.arange(a.num_rows), i)):
        i, rank, d, place = (np.concatenate([v, np.full(len(none), fill, v.dtype)]) for v, fill in ((i, 0), (rank, -1), (d, np.nan), (place, 0)))
        i[len(i) - len(none) :] = none
    hidden = rank < 0
    out = {"a_id": a["a_id"].take(pa.array(i)), "place": pa.array(place, pa.int32(), mask=hidden), "distance_m": pa.array(d, pa.float64(), mask=hidden)}
    at = pa.array(rank, pa.int64(), mask=hidden)
    return pa.table(out | {c: rows[c].take(at) for c in rows.column_names})


def _nearest_on_tiles(a: DataFrame, b: DataFrame, k: int, within_m: float, names: list[str], schema: StructType, n: int, tile_rows: int) -> DataFrame:
    """Tiles are stretches of a Hilbert curve, bounded by quantiles; RUNS boxes of each go to the tasks and say which tiles
    may hold one of the k nearest of an a. Tiles that many a meet are repeated, so that a group holds some GROUP_ROWS of them."""
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy("b_id"))
    b = b.withColumn("__k", place).where(F.col("__k") <= k).drop("__k")  # no more of one position can be among the k nearest
    box = b.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    at = F.pandas_udf(lambda x, y: pd.Series(along(x.to_numpy(), y.to_numpy(), *box)), "long")
    placed = b.withColumn("__h", at("x", "y"))
    runs = RUNS * math.ceil(n / tile_rows)
    cuts = np.unique(placed.approxQuantile("__h", [i / runs for i in range(1, runs)], 0.25 / runs)).astype(np.int64)
    run_of = F.pandas_udf(lambda h: pd.Series(np.searchsorted(cuts, h.to_numpy(), side="right")), "long")
    placed = placed.withColumn("__run", run_of("__h")).withColumn("__tile", F.expr(f"__run div {RUNS}")).drop("__h")
    boxes = placed.groupBy("__run", "__tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).toPandas()
    tile_of, full = boxes["__tile"].to_numpy(), boxes["n"].to_numpy() >= k
    edges = boxes[["x0", "x1", "y0", "y1"]].to_numpy()

    def met(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(x), 256):
            qx, qy = x.to_numpy()[i : i + 256, None], y.to_numpy()[i : i + 256, None]
            far = np.maximum(qx - edges[:, 0], edges[:, 1] - qx) ** 2 + np.maximum(qy - edges[:, 2], edges[:, 3] - qy) ** 2
            bound = np.minimum(far[:, full].min(1, initial=math.inf), within_m**2) * SLACK
            out += [np.unique(tile_of[near]) for near in gap2(edges[None], qx, qy) <= bound[:, None]]
        return pd.Series(out)

    met_of = F.pandas_udf(met, "array<long>")
    pairs = a.select("*", F.explode(met_of("x", "y")).alias("__tile"))
    parts = {r["__tile"]: math.ceil(r["count"] / GROUP_ROWS) for r in pairs.groupBy("__tile").count().collect()}
    copies = F.create_map(*(F.lit(v) for t in parts.items() for v in t)) if parts else F.create_map(F.lit(-1), F.lit(0))
    of = F.coalesce(F.try_element_at(copies, F.col("__tile").cast("int")), F.lit(0))
    pairs = pairs.withColumn("__part", F.pmod(F.xxhash64("a_id"), of).cast("int"))
    placed = placed.drop("__run").withColumn("__copies", of).where("__copies > 0").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [("b_id", "ascending")]))
        return _matches(left, Tree(*(right[c].to_numpy() for c in "xy"), k), right.select(names), k, within_m, False)

    found = pairs.groupBy("__tile", "__part").cogroup(placed.groupBy("__tile", "__part")).applyInArrow(run, schema)
    best = Window.partitionBy("a_id").orderBy("distance_m", "b_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return a.select("a_id").join(found, "a_id", "left")


def ring_edges(ring: Column) -> Column:
    """Edges of a closed or open ring of points (x, y)."""
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get(ring, F.pmod(i + 1, F.size(ring)))["x"].alias("x1"), F.get(ring, F.pmod(i + 1, F.size(ring)))["y"].alias("y1")))


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Strictly inside, by the parity of crossings of a ray to the right."""

    def crosses(e: Column) -> Column:
        rise = e["y1"] - e["y0"]
        at = e["x0"] + (y - e["y0"]) / F.nullif(rise, F.lit(0.0)) * (e["x1"] - e["x0"])
        return F.coalesce(((e["y0"] > y) != (e["y1"] > y)) & (x < at), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def edge_distance(edges: Column, x: Column, y: Column) -> Column:
    """The distance to the nearest edge."""

    def to(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e["x0"]) * dx + (y - e["y0"]) * dy) / F.nullif(n, F.lit(0.0))))).otherwise(0.0)
        return F.hypot(x - (e["x0"] + t * dx), y - (e["y0"] + t * dy))

    return F.array_min(F.transform(edges, to))


def signed_edge_distance(edges: Column, x: Column, y: Column) -> Column:
    """Negative inside."""
    d = edge_distance(edges, x, y)
    return F.when(contains(edges, x, y), -d).otherwise(d)


def touches_square(edges: Column, x: Column, y: Column, half: float) -> Column:
    """Whether an edge meets the open square of a cell around (x, y), by clipping the edge to it."""

    def hit(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]

        def span(start: Column, d: Column, centre: Column) -> tuple[Column, Column]:
            inside = F.abs(start - centre) < half
            a, b = (centre - half - start) / F.nullif(d, F.lit(0.0)), (centre + half - start) / F.nullif(d, F.lit(0.0))
            return F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, 1.0).otherwise(-2.0)).otherwise(F.greatest(a, b))

        (x0, x1), (y0, y1) = span(e["x0"], dx, x), span(e["y0"], dy, y)
        return F.greatest(x0, y0, F.lit(0.0)) < F.least(x1, y1, F.lit(1.0))

    return F.exists(edges, hit)


def polygon_cells(cells: DataFrame, polygons: DataFrame, pixel: float, all_touched: bool = True) -> DataFrame:
    """cells (x, y, ...) x polygons (region, ring): each cell once for every polygon that contains or touches it.

    Polygons are few and broadcast after a check; their boxes meet cells in buckets otherwise.
    """
    half = positive("pixel", pixel) / 2
    boxed = polygons.withColumn("edges", ring_edges(F.col("ring")))
    for v in "xy":
        values = F.col(f"ring.{v}")
        boxed = boxed.withColumn(f"{v}0", F.array_min(values)).withColumn(f"{v}1", F.array_max(values))
    boxed = boxed.drop("ring")
    near = F.col("x").between(F.col("x0") - half, F.col("x1") + half) & F.col("y").between(F.col("y0") - half, F.col("y1") + half)
    if boxed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = cells.join(F.broadcast(boxed), near)
    else:
        size = 64 * pixel
        steps = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - half) / size), F.floor((F.col(hi) + half) / size)))
        met = _bucketed(cells, size, False).join(boxed.withColumn("__bx", steps("x0", "x1")).withColumn("__by", steps("y0", "y1")), ["__bx", "__by"]).where(near).drop("__bx", "__by")
    test = contains(F.col("edges"), F.col("x"), F.col("y"))
    if all_touched:
        test = test | touches_square(F.col("edges"), F.col("x"), F.col("y"), half)
    return met.where(test).drop("x0", "x1", "y0", "y1", "edges")
