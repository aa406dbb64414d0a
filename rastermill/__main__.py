"""python -m rastermill COMMAND: the engine's commands over Parquet cell tables."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.grid import GridSpec
from .plans import commands
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rastermill")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *needs: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in needs:
            c.add_argument(f"--{n}", required=True)
        c.add_argument("--out")
        return c

    def on_grid(c: argparse.ArgumentParser) -> argparse.ArgumentParser:
        c.add_argument("--grid", required=True, help="JSON of left, top, pixel, height, width")
        return c

    c = on_grid(add("preprocess", "elevation"))
    c.add_argument("--layer", action="append", default=[])
    c.add_argument("--craters")
    c.add_argument("--azimuths", type=int, default=36)
    c.add_argument("--max-km", type=float, default=100.0)
    c.add_argument("--horizons", help="a folder for the horizon profiles")
    c = add("score", "cells", "weights")
    c.add_argument("--method", choices=("weighted_sum", "topsis"), default="weighted_sum")
    for name in ("rank", "rank-per-region"):
        c = on_grid(add(name, "scored"))
        c.add_argument("--n", type=int, default=20 if name == "rank" else 10)
        c.add_argument("--min-distance-km", type=float, default=5.0 if name == "rank" else 2.0)
        if name == "rank":
            c.add_argument("--min-score", type=float, default=0.5)
        else:
            c.add_argument("--regions", required=True)
            c.add_argument("--method", choices=("weighted_sum", "topsis"), default="weighted_sum")
            c.add_argument("--tiled", action="store_true")
            c.add_argument("--region-code", action="append", default=[])
            c.add_argument("--resolution")
    on_grid(add("score-sites", "scored", "catalog"))
    c = add("compare", "sites", "catalog")
    c.add_argument("--km", type=float, default=5.0)
    c = add("validate", "sites", "centroids")
    c.add_argument("--near-km", type=float, default=25.0)
    add("validate-per-region", "regions", "sites", "areas")
    c = on_grid(add("sensitivity", "scored", "centroids"))
    c.add_argument("--criterion", action="append", default=[])
    c.add_argument("--samples", type=int, default=100)
    c = add("coupling-sweep", "scored")
    c.add_argument("--grid", help="JSON of left, top, pixel, height, width")
    c.add_argument("--disks", help="b_id, x, y, radius_km, ring: the cells are ranked for each distance and held against them")
    return p


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "rank-per-region":
        if not a.tiled and (a.resolution or a.region_code):
            p.error("--resolution and --region-code are only honoured with --tiled")
        if a.method == "topsis" and a.out:
            a.out = os.path.join(a.out, "topsis")
    spark = SparkSession.builder.appName("rastermill").getOrCreate()
    read = spark.read.parquet
    grid = GridSpec(**json.loads(a.grid)) if getattr(a, "grid", None) else None
    if a.command == "preprocess":
        craters = tables.read_craters(spark, a.craters) if a.craters else None
        df = commands.preprocess(spark, read(a.elevation), grid, [read(x) for x in a.layer], craters, azimuths=a.azimuths, max_km=a.max_km, out=a.out, horizons=a.horizons)
    elif a.command == "score":
        df = commands.score(read(a.cells), commands.load_weights(a.weights), a.method, a.out)
    elif a.command == "rank":
        df = commands.rank_sites(read(a.scored), grid, a.n, a.min_distance_km * 1000, a.min_score, a.out)
    elif a.command == "rank-per-region":
        regions, far = tables.read_regions(spark, a.regions), a.min_distance_km * 1000
        if a.tiled:
            df = commands.rank_tiled(read(a.scored), regions, grid, commands.parse_resolution(a.resolution or "20m"), n=a.n, min_distance_m=far, codes=a.region_code, out=a.out)
        else:
            df = commands.rank_per_region(read(a.scored), regions, grid, a.n, far, out=a.out)
    elif a.command == "score-sites":
        df = commands.score_catalog(read(a.scored), tables.read_catalog(spark, a.catalog), grid, out=a.out)
    elif a.command == "compare":
        catalog = tables.read_catalog(spark, a.catalog).select(F.col("site_id").alias("b_id"), "x", "y")
        df = commands.compare_catalogs(read(a.sites).select(F.col("site_id").alias("a_id"), F.col("x_m").alias("x"), F.col("y_m").alias("y")), catalog, a.km, a.out)
    elif a.command == "validate":
        df = commands.validate_sites(read(a.sites).select(F.col("site_id").alias("a_id"), F.col("x_m").alias("x"), F.col("y_m").alias("y")), read(a.centroids).select("b_id", "x", "y"), a.near_km, a.out)
    elif a.command == "validate-per-region":
        df = commands.validate_per_region(read(a.regions), read(a.sites).withColumnRenamed("region_name", "region"), read(a.areas), a.out)
    elif a.command == "sensitivity":
        df = commands.sensitivity(spark, read(a.scored), a.criterion, read(a.centroids), grid, a.samples, out=a.out, baseline=True)
    else:
        df = commands.coupling_sweep(read(a.scored), out=a.out, grid=grid, disks=read(a.disks) if a.disks else None)
    df.show(20, truncate=False)


if __name__ == "__main__":
    main()
