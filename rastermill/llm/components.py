"""Connected components of an undirected graph by minimum labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, join_counted, release, written_at


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) rows -> (id, label): the smallest id reachable, for every id that has an edge. Repeats and loops are fine.

    A label moves to the smallest of the neighbours' labels and then to its own label's label, so chains halve. Vertices of
    many edges and labels of many vertices are hot keys of the two joins; their rows meet by a broadcast of bounded size.
    """
    spark = edges.sparkSession
    both, both_path = written_at(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    first = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label"), F.count("*").alias("degree"))
    labels, path = written_at(first.withColumnRenamed("x", "id"), "labels")
    n_edges, n_ids = both.count(), labels.count()
    while n_edges:
        ends = labels.select(F.col("id").alias("y"), "label", "degree")
        near = join_counted(both, ends, "y", "degree", total=n_edges).groupBy("x").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["id"] == near["x"]).select("id", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        moved, moved_path = written_at(moved, "moved")
        heads = moved.groupBy("label").agg(F.count("*").alias("n")).join(labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label")
        new = join_counted(moved, heads, "label", "n", "left", total=n_ids)
        new, new_path = written_at(new.select("id", "degree", "old", F.least(F.col("label"), F.coalesce("next", F.col("label"))).alias("label")), "labels")
        changed = not new.where("label <> old").isEmpty()
        for done in (path, moved_path):
            delete(spark, done)
        labels, path = new.select("id", "label", "degree"), new_path
        release(spark)
        if not changed:
            break
    delete(spark, both_path)
    return labels.select("id", "label")
