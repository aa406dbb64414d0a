"""Grids, tiles and cell tables (row, col, layers): row 0 on top, centres at half pixels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import positive


@dataclass(frozen=True)
class GridSpec:
    """Left and top edges, pixel size and shape; x and y of cells are derived, not stored."""

    left: float
    top: float
    pixel: float
    height: int
    width: int

    def __post_init__(self):
        positive("pixel", self.pixel)
        if self.height <= 0 or self.width <= 0:
            raise ValueError("a grid needs rows and columns")

    @classmethod
    def of_bounds(cls, left: float, bottom: float, right: float, top: float, pixel: float) -> GridSpec:
        return cls(left, top, positive("pixel", pixel), round((top - bottom) / pixel), round((right - left) / pixel))

    def x(self, col: Column) -> Column:
        return self.left + self.pixel * (col + 0.5)

    def y(self, row: Column) -> Column:
        return self.top - self.pixel * (row + 0.5)

    def row(self, y: Column) -> Column:
        """The nearest row, halves to even."""
        return F.rint((self.top - y) / self.pixel - 0.5).cast("long")

    def col(self, x: Column) -> Column:
        return F.rint((x - self.left) / self.pixel - 0.5).cast("long")

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells, made on the executors."""
        n = spark.range(self.height * self.width)
        return n.select(F.expr(f"id div {self.width}").alias("row"), (F.col("id") % self.width).alias("col"))


@dataclass(frozen=True)
class TileSpec:
    name: str
    code: str
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def grid(self, pixel: float) -> GridSpec:
        return GridSpec.of_bounds(self.xmin, self.ymin, self.xmax, self.ymax, pixel)


def tile_specs(vertices: DataFrame, buffer_m: float, pixel: float, by: str = "region") -> DataFrame:
    """(region, x, y) -> each region's bounding box plus a buffer, snapped outward to whole pixels."""
    p = positive("pixel", pixel)
    box = vertices.groupBy(by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    low, high = (lambda c: F.floor((c - buffer_m) / p) * p), (lambda c: F.ceil((c + buffer_m) / p) * p)
    out = box.select(by, low(F.col("x0")).alias("xmin"), low(F.col("y0")).alias("ymin"), high(F.col("x1")).alias("xmax"), high(F.col("y1")).alias("ymax"))
    return out.withColumn("width", F.rint((F.col("xmax") - F.col("xmin")) / p).cast("long")).withColumn("height", F.rint((F.col("ymax") - F.col("ymin")) / p).cast("long"))


def azimuth_chunk(height: int, width: int, azimuths: int, budget_bytes: int = 18 << 30, bytes_per_cell: int = 4) -> int | None:
    """How many azimuths fit the budget at once; None if all do. Kept as a pure function; partitions are Spark's."""
    if min(height, width, azimuths, budget_bytes) <= 0:
        raise ValueError("sizes must be positive")
    each = height * width * bytes_per_cell
    return None if each * azimuths <= budget_bytes else max(1, min(azimuths, budget_bytes // each))


def join_layers(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Layers of one grid side by side: an equi-join on (row, col)."""
    for other in others:
        first = first.join(other, ["row", "col"])
    return first


def crop(cells: DataFrame, row: int, col: int, half: int) -> DataFrame:
    """The window of `half` cells around one cell; range predicates prune Parquet by its statistics."""
    return cells.where(F.col("row").between(row - half, row + half) & F.col("col").between(col - half, col + half))


def coarsened(cells: DataFrame, layer: str, factor: int, height: int, width: int) -> DataFrame:
    """Block means; the ragged right and bottom edges are trimmed and NULL cells skipped."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    inner = cells.where((F.col("row") < height // factor * factor) & (F.col("col") < width // factor * factor))
    return inner.groupBy(F.expr(f"row div {factor}").alias("row"), F.expr(f"col div {factor}").alias("col")).agg(F.avg(layer).alias(layer))


def sample_nearest(points: DataFrame, cells: DataFrame, grid: GridSpec, clamp: bool = False) -> DataFrame:
    """points (x, y, ...) with the layers of their nearest cell: NULL outside the grid, or the edge cell if clamp."""
    row, col = grid.row(F.col("y")), grid.col(F.col("x"))
    if clamp:
        row, col = F.greatest(F.lit(0), F.least(row, F.lit(grid.height - 1))), F.greatest(F.lit(0), F.least(col, F.lit(grid.width - 1)))
    return points.withColumn("row", row).withColumn("col", col).join(cells, ["row", "col"], "left")
