"""Sources and sinks: fixed-width tables, catalogs, regions, rasters as cell tables, cached layers, documents."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.crs import stereo_x, stereo_y
from ..functions.local import first_present


@dataclass(frozen=True)
class FieldSpec:
    name: str
    offset: int
    length: int
    unit: str = ""
    missing: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableSpec:
    header_bytes: int
    records: int
    record_bytes: int
    fields: tuple[FieldSpec, ...] = field(default=())

    def chosen(self, names: Sequence[str] | None) -> tuple[FieldSpec, ...]:
        if names is None:
            return self.fields
        known = {f.name: f for f in self.fields}
        if unknown := [n for n in names if n not in known]:
            raise ValueError(f"no field {unknown}")
        return tuple(known[n] for n in names)


def parse_label(xml: str) -> TableSpec:
    """The layout of a fixed-width character table from its XML label; offsets become 0-based. A missing element is an error."""
    root = ElementTree.fromstring(xml)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]

    def text(node: ElementTree.Element | None, name: str) -> str:
        found = None if node is None else node.find(f".//{name}")
        if found is None or found.text is None:
            raise ValueError(f"the label has no {name}")
        return found.text.strip()

    table = root.find(".//Table_Character")
    if table is None:
        raise ValueError("the label has no Table_Character")
    offset, record = table.find("offset"), table.find("Record_Character")
    header = int(offset.text) if offset is not None and offset.text else int(text(root.find(".//Header"), "object_length"))
    fields = []
    for f in ([] if record is None else record.iter("Field_Character")):
        missing = tuple((c.text or "").strip() for s in f.iter("Special_Constants") for c in s)
        unit = f.find("unit")
        fields.append(FieldSpec(text(f, "name"), int(text(f, "field_location")) - 1, int(text(f, "field_length")), (unit.text or "").strip() if unit is not None else "", missing))
    if not fields:
        raise ValueError("the label has no Field_Character")
    return TableSpec(header, int(text(table, "records")), int(text(record, "record_length")), tuple(fields))


class _Bytes(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__((first, count))
        self.first, self.count = first, count


class FixedWidthSource(DataSource):
    """spark.read.format("fixed_width") with options path, spec (JSON) and fields; byte ranges of whole records are the partitions."""

    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def _spec(self) -> tuple[TableSpec, tuple[FieldSpec, ...]]:
        raw = json.loads(self.options["spec"])
        spec = TableSpec(raw["header_bytes"], raw["records"], raw["record_bytes"], tuple(FieldSpec(f["name"], f["offset"], f["length"], f.get("unit", ""), tuple(f.get("missing", ()))) for f in raw["fields"]))
        names = self.options.get("fields")
        return spec, spec.chosen(names.split(",") if names else None)

    def schema(self) -> StructType:
        return StructType([StructField(f.name, DoubleType()) for f in self._spec()[1]])

    def reader(self, schema: StructType) -> DataSourceReader:
        spec, fields = self._spec()
        return _FixedWidthReader(self.options["path"], spec, fields, int(self.options.get("chunk", "100000")))


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a URI, or of a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _FixedWidthReader(DataSourceReader):
    def __init__(self, path: str, spec: TableSpec, fields: tuple[FieldSpec, ...], chunk: int):
        self.path, self.spec, self.fields, self.chunk = path, spec, fields, chunk

    def partitions(self) -> list[_Bytes]:
        fs, path = _store(self.path)
        info = fs.get_file_info(path)
        if info.type != pafs.FileType.File:
            raise FileNotFoundError(self.path)
        whole = max(0, (info.size - self.spec.header_bytes) // self.spec.record_bytes)
        n = min(self.spec.records, whole)
        return [_Bytes(a, min(self.chunk, n - a)) for a in range(0, n, self.chunk)]

    def read(self, partition: _Bytes) -> Iterator[pa.RecordBatch]:
        fs, path = _store(self.path)
        with fs.open_input_file(path) as f:
            raw = f.read_at(partition.count * self.spec.record_bytes, self.spec.header_bytes + partition.first * self.spec.record_bytes)
        data = np.frombuffer(raw, "S1").reshape(-1, self.spec.record_bytes)
        yield decoded(data, self.fields)


def decoded(records: np.ndarray, fields: Sequence[FieldSpec]) -> pa.RecordBatch:
    """Records of single bytes -> doubles; blanks and the fields' missing constants are NULL."""
    out = []
    for f in fields:
        raw = pd.Series(np.ascontiguousarray(records[:, f.offset : f.offset + f.length]).view(f"S{f.length}").ravel()).str.decode("ascii").str.strip()
        value = pd.to_numeric(raw.where(raw != "", None))
        gone = value.isna()
        for m in f.missing:
            gone |= value == float(m)
        out.append(pa.array(np.asarray(value, float), pa.float64(), mask=gone.to_numpy()))
    return pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])


def read_fixed_width(spark: SparkSession, path: str, spec: TableSpec, fields: Sequence[str] | None = None, chunk: int = 100_000) -> DataFrame:
    """A fixed-width table, the chosen columns only; a short last block is cut to whole records."""
    spec.chosen(fields)
    spark.dataSource.register(FixedWidthSource)
    raw = {"header_bytes": spec.header_bytes, "records": spec.records, "record_bytes": spec.record_bytes, "fields": [vars(f) | {"missing": list(f.missing)} for f in spec.fields]}
    reader = spark.read.format("fixed_width").option("path", path).option("spec", json.dumps(raw)).option("chunk", chunk)
    return (reader.option("fields", ",".join(fields)) if fields else reader).load()


def read_fixed_width_text(spark: SparkSession, path: str, spec: TableSpec, fields: Sequence[str] | None = None) -> DataFrame:
    """The same by Spark's text reader, for stores that only Spark reads; a header must be whole lines of the record length."""
    lines = spark.read.text(path).where(F.length("value") >= max(f.offset + f.length for f in spec.fields))

    def column(f: FieldSpec) -> Column:
        v = F.trim(F.substring("value", f.offset + 1, f.length)).try_cast("double")
        return F.when(~v.isin([float(m) for m in f.missing]) if f.missing else F.lit(True), v).alias(f.name)

    return lines.select(*(column(f) for f in spec.chosen(fields)))


def read_raster(spark: SparkSession, path: str, height: int, width: int, dtype: str = "<f4", scale: float = 1.0, no_data: float | None = None, header_bytes: int = 0, layer: str = "z") -> DataFrame:
    """A raw single-band raster -> (row, col, layer); stored numbers times scale, no_data and NaN are NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                a = np.frombuffer(data, dtype, height * width, header_bytes).astype(float)
                gone = np.isnan(a) | ((a == no_data) if no_data is not None else False)
                for r in range(0, height, 256):
                    n = min(256, height - r)
                    part = slice(r * width, (r + n) * width)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(r, r + n), width)), pa.array(np.tile(np.arange(width), n)), pa.array(a[part] * scale, mask=np.broadcast_to(gone, a.shape)[part])], names=["row", "col", layer])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"row long, col long, {layer} double")


#: Scales of stored numbers (fixed values): elevation in half metres, illumination in 1/25000.
ELEVATION_SCALE = 0.5
ILLUMINATION_SCALE = 0.00004


#: Names that the columns of crater tables go by (fixed values); the first one present is taken.
CRATER_COLUMNS = {"lat": ("lat", "LAT_CIRC_IMG", "latitude"), "lon": ("lon", "LON_CIRC_IMG", "longitude"), "diam_km": ("diam_km", "DIAM_CIRC_IMG", "diameter_km")}


def _zipped_craters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = {n: pa.float64() for names in CRATER_COLUMNS.values() for n in names}
    for batch in batches:
        for data in batch.column(0).to_pylist():
            reader = pacsv.open_csv(io.BytesIO(largest_csv(data)), convert_options=pacsv.ConvertOptions(column_types=numbers))
            chosen = {k: first_present(reader.schema.names, names) for k, names in CRATER_COLUMNS.items()}
            for part in reader:
                yield pa.RecordBatch.from_arrays([pc.cast(part.column(part.schema.get_field_index(n)), pa.float64()) for n in chosen.values()], names=list(chosen))


def read_craters(spark: SparkSession, path: str, lat_max: float = -75.0, min_diameter_km: float | None = None) -> DataFrame:
    """A crater CSV (gzip as well) or the largest CSV of a zip, whatever its column names -> lat, lon, diam_km, x, y of the polar cap."""
    if path.lower().endswith(".zip"):
        zipped = spark.read.format("binaryFile").load(path).select("content")
        rows = zipped.mapInArrow(_zipped_craters, "lat double, lon double, diam_km double")
    else:
        raw = spark.read.option("header", True).csv(path)
        rows = raw.select(*(F.col(first_present(raw.columns, c)).try_cast("double").alias(k) for k, c in CRATER_COLUMNS.items()))
    return crater_filter(rows, lat_max, min_diameter_km)


def crater_filter(rows: DataFrame, lat_max: float = -75.0, min_diameter_km: float | None = None) -> DataFrame:
    rows = rows.where(F.col("lat") <= lat_max)
    if min_diameter_km is not None and "diam_km" in rows.columns:
        rows = rows.where(F.coalesce("diam_km", F.lit(0.0)) >= min_diameter_km)
    return rows.withColumn("x", stereo_x(F.col("lon"), F.col("lat"))).withColumn("y", stereo_y(F.col("lon"), F.col("lat")))


def largest_csv(data: bytes) -> bytes:
    """The largest .csv member of a zip, or the bytes themselves if they are none."""
    if not data.startswith(b"PK\x03\x04"):
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        members = [i for i in z.infolist() if i.filename.lower().endswith(".csv")]
        if not members:
            raise ValueError("the zip has no csv member")
        return z.read(max(members, key=lambda i: i.file_size))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON of polygons -> ordinal, region, code, area_km2, ring of projected (x, y); vertices only are projected."""
    rows = spark.read.option("multiLine", True).json(path).select(F.posexplode("features").alias("ordinal", "f"))
    p = F.col("f.properties")
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda v: F.struct(stereo_x(v[0].cast("double"), v[1].cast("double")).alias("x"), stereo_y(v[0].cast("double"), v[1].cast("double")).alias("y")))
    return rows.select(F.col("ordinal").cast("long").alias("ordinal"), p["Region"].alias("region"), F.upper(p["RegionCode"]).alias("code"), p["Area_km2"].cast("double").alias("area_km2"), ring.alias("ring"))


def disk_rings(centres: DataFrame, vertices: int = 64) -> DataFrame:
    """(name, lat, lon, radius_km) -> rings of so many vertices, built in projected metres."""
    x, y = stereo_x(F.col("lon"), F.col("lat")), stereo_y(F.col("lon"), F.col("lat"))
    angle = lambda i: i * (2 * np.pi / vertices)
    return centres.withColumn("ring", F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), lambda i: F.struct((x + F.col("radius_km") * 1000 * F.cos(angle(i))).alias("x"), (y + F.col("radius_km") * 1000 * F.sin(angle(i))).alias("y"))))


def read_catalog(spark: SparkSession, path: str, required: Sequence[str] = ("region", "lat", "lon")) -> DataFrame:
    """A site catalog CSV with # comments -> its columns, site_id (the column whose name ends so) and x, y.

    Missing columns and other suffixes are errors.
    """
    if not path.lower().endswith((".csv", ".csv.gz")):
        raise ValueError(f"not a catalog: {path}")
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"the catalog has no {missing}")
    ids = [c for c in rows.columns if c.lower().endswith("site_id")]
    if not ids:
        raise ValueError("the catalog has no site_id")
    rows = rows.withColumnRenamed(ids[0], "site_id")
    rows = rows.withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double"))
    return rows.withColumn("x", stereo_x(F.col("lon"), F.col("lat"))).withColumn("y", stereo_y(F.col("lon"), F.col("lat")))


#: Region codes of the site catalog, their names, and the names of regions that are in scope (fixed values).
REGION_NAMES = {
    "AR": "Amundsen Rim",
    "CR": "Connecting Ridge",
    "CRE": "Connecting Ridge Extension",
    "FRA": "Faustini Rim A",
    "HW": "Haworth",
    "MMA": "Mons Malapert",
    "MMO": "Mons Mouton",
    "MMP": "Mons Mouton Plateau",
    "NR1": "Nobile Rim 1",
    "NR2": "Nobile Rim 2",
    "PCB": "Peak Near Cabeus B",
    "PNS": "Peak Near Shackleton",
    "SP": "Slater Plain",
    "dGKM": "de Gerlache-Kocher Massif",
    "dGR1": "de Gerlache Rim 1",
    "dGR2": "de Gerlache Rim 2",
}
IN_SCOPE = ("Haworth", "Mons Mouton", "Mons Mouton Plateau", "Nobile Rim 1", "Nobile Rim 2", "Peak Near Cabeus B", "Slater Plain", "de Gerlache Rim 2")


def named_regions(catalog: DataFrame, code: str = "region", names: Mapping[str, str] = REGION_NAMES, scope: Sequence[str] = IN_SCOPE) -> DataFrame:
    """catalog with region_name and in_scope by its region codes; an unknown code fails the query that reads it."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    wrong = F.raise_error(F.concat(F.lit("unknown region code "), F.coalesce(F.col(code), F.lit("NULL"))))
    rows = catalog.withColumn("region_name", F.coalesce(table[F.col(code)], wrong))
    return rows.withColumn("in_scope", F.col("region_name").isin(list(scope)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Lines and points of a GeoJSON, or points of a CSV with lat and lon -> (line_id, points) in projected metres, for densified().

    The parts of multi-part geometries are lines of their own; other geometries have no points.
    """
    point = lambda lon, lat: F.struct(stereo_x(lon, lat).alias("x"), stereo_y(lon, lat).alias("y"))
    if path.lower().endswith((".csv", ".csv.gz")):
        rows = spark.read.option("header", True).option("comment", "#").csv(path)
        return rows.select(F.monotonically_increasing_id().alias("line_id"), F.array(point(F.col("lon").cast("double"), F.col("lat").cast("double"))).alias("points"))
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
    g = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.geometry.type", "f.geometry.coordinates")
    parsed = lambda kind: F.from_json("coordinates", kind)
    lines = F.when(F.col("type") == "Point", F.array(F.array(parsed("array<double>")))).when(F.col("type") == "MultiPoint", F.transform(parsed("array<array<double>>"), lambda p: F.array(p)))
    lines = lines.when(F.col("type") == "LineString", F.array(parsed("array<array<double>>"))).when(F.col("type") == "MultiLineString", parsed("array<array<array<double>>>"))
    rows = g.select(F.explode(lines).alias("line"))
    return rows.select(F.monotonically_increasing_id().alias("line_id"), F.transform("line", lambda p: point(p[0], p[1])).alias("points"))


def is_placeholder(id_column: str, prefix: str = "synthetic-placeholder") -> Column:
    """An aggregate: whether there are rows and all ids start with the prefix."""
    return F.coalesce(F.bool_and(F.col(id_column).startswith(prefix)), F.lit(False))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store Spark reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {list(paths)} is there")


#: Elevation sources, the finest first, and the suffixes of one that is named outright (fixed values).
ELEVATION_SOURCES = ("ldem_80s_20m.lbl", "ldem_80s_80m.lbl", "sample_lola.tif")
ELEVATION_SUFFIXES = (".tif", ".lbl", ".img")


def elevation_source(spark: SparkSession, root: str, resolution_m: int | None = None, override: str | None = None) -> str:
    """The finest elevation source under root; with resolution_m that one or none; or override, whatever its name but not its suffix."""
    if override is not None:
        if not override.lower().endswith(ELEVATION_SUFFIXES):
            raise ValueError(f"{override}: a source ends with one of {ELEVATION_SUFFIXES}")
        return first_existing(spark, [override])
    names = ELEVATION_SOURCES if resolution_m is None else (f"ldem_80s_{resolution_m}m.lbl",)
    return first_existing(spark, [f"{root.rstrip('/')}/{n}" for n in names])


#: Rows of the grid in one folder of a horizon store.
HORIZON_BAND = 256


def write_horizon(profile: DataFrame, path: str) -> None:
    """(row, col, azimuth, horizon) -> Parquet of one ARRAY<FLOAT> by azimuth a cell, in folders of HORIZON_BAND rows; an older store goes.

    Rows are dealt by range of (band, row), so a wide band is shared by several tasks.
    """
    steps = F.transform(F.sort_array(F.collect_list(F.struct("azimuth", "horizon"))), lambda a: a["horizon"].cast("float"))
    cells = profile.groupBy("row", "col").agg(steps.alias("horizon")).withColumn("band", F.expr(f"row div {HORIZON_BAND}"))
    cells.repartitionByRange("band", "row").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("band").parquet(path)


def read_horizon(spark: SparkSession, path: str, azimuths: int, rows: tuple[int, int] | None = None) -> DataFrame:
    """(row, col, horizon) of a store, of the rows from the first to the last only if given; other folders aren't opened.

    A cell without exactly so many azimuths fails the query that reads it.
    """
    cells = spark.read.parquet(path)
    if rows is not None:
        cells = cells.where(F.col("band").between(rows[0] // HORIZON_BAND, rows[1] // HORIZON_BAND) & F.col("row").between(*rows))
    wrong = F.raise_error(F.format_string(f"a horizon of %d azimuths instead of {azimuths}", F.size("horizon")))
    return cells.select("row", "col", F.when(F.size("horizon") == azimuths, F.col("horizon")).otherwise(wrong).alias("horizon"))


def cached_layer(build, spark: SparkSession, root: str, name: str, overwrite: bool = False, **parameters) -> DataFrame:
    """build() written once under a path that a hash of the parameters names, so other parameters never meet an old layer."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{key}"
    if overwrite or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def layers_present(spark: SparkSession, paths: dict[str, str], wanted: Sequence[str]) -> DataFrame:
    """Cell tables side by side; wanted layers without a path become NULL columns."""
    out = None
    for name, path in paths.items():
        layer = spark.read.parquet(path).select("row", "col", F.col(name))
        out = layer if out is None else out.join(layer, ["row", "col"], "full")
    if out is None:
        raise ValueError("no layer")
    return out.select("row", "col", *(F.col(w) if w in paths else F.lit(None).cast("double").alias(w) for w in wanted))


def _feature(sites: DataFrame) -> Column:
    properties = [c for c in sites.columns if c not in ("lon", "lat")]
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def geojson_features(sites: DataFrame) -> DataFrame:
    """One GeoJSON point feature a row; NULL properties stay null."""
    return sites.select(_feature(sites).alias("value"))


def geojson_document(sites: DataFrame, order: str) -> DataFrame:
    """One row: a GeoJSON collection of the sites in order. For site lists, which a top-k bounds; larger tables stay lines."""
    rows = sites.select(F.struct(F.col(order).alias("o"), _feature(sites).alias("value")).alias("r"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["value"]), ",")
    return rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("value"))


def write_sites(sites: DataFrame, path: str) -> None:
    """Sites as lines of GeoJSON in path/geojson and as CSV with a header, without nested columns, in path/csv; empty tables as well."""
    flat = [f.name for f in sites.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    geojson_features(sites).write.mode("overwrite").text(f"{path.rstrip('/')}/geojson")
    sites.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/csv")


def json_document(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def text_table(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fixed-width lines; `--` for NULL."""
    return df.select(F.concat_ws(" ", *(F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("--")), w, " ") for c, w in widths.items())).alias("value"))
