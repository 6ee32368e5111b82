"""Readers for the input files: monitor CSV and archives, hotspot CSV, perimeter features, sample logs."""

from __future__ import annotations

import csv
import datetime as dt
import io
import zipfile
import zlib
from functools import reduce
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumeframe.functions.scalars import acquisition_time, hour_floor, missing_to_null, unquote
from plumeframe.operators.incidents import latest_index
from plumeframe.operators.observations import RAW_COLUMNS, require_columns
from plumeframe.scale import stage

DETECTION_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("latitude", "longitude", "acq_date", "acq_time", "frp", "confidence", "daynight")
    ]
)
ROWS_PER_BATCH = 50_000


# ---- listing ---------------------------------------------------------------------------------


def list_files(spark: SparkSession, folder: str, glob: str) -> list[str]:
    """Paths in a folder that match a glob; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    return sorted(row["path"] for row in files.toLocalIterator())


def year_of(path: str) -> int | None:
    """Year written after the last underscore of a file's stem."""
    tail = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].split("_")[-1]
    try:
        return int(tail)
    except ValueError:
        return None


def select_year_files(spark: SparkSession, folder: str, glob: str, start: dt.date, end: dt.date) -> list[str]:
    """Files whose name carries a year of the run; none raises."""
    chosen = [p for p in list_files(spark, folder, glob) if (y := year_of(p)) is not None and start.year <= y <= end.year]
    if not chosen:
        raise FileNotFoundError(f"No files found with pattern {glob} for {start.year}-{end.year}")
    return chosen


# ---- monitor rows ----------------------------------------------------------------------------


def _keep_code(rows: DataFrame, code: str) -> DataFrame:
    if "Parameter Code" in rows.columns:
        rows = rows.filter(unquote("`Parameter Code`") == code)
    return rows.withColumn("pm_source_code", F.lit(code))


def _csv_by_header(spark: SparkSession, path: str | Sequence[str]) -> list[DataFrame]:
    """CSV files as text columns, one frame per distinct header; files may order their columns differently."""
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path")
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in files.orderBy("path").collect():
        header = tuple(spark.read.csv(row["path"], header=True, inferSchema=False).columns)
        groups.setdefault(header, []).append(row["path"])
    return [spark.read.csv(paths, header=True, inferSchema=False) for paths in groups.values()]


def read_observations(spark: SparkSession, paths: Sequence[str], code: str) -> DataFrame:
    """Monitor CSV files as text columns, rows of one parameter; splits over tasks by file ranges."""
    parts = []
    for rows in _csv_by_header(spark, paths):
        require_columns(rows, list(RAW_COLUMNS))
        parts.append(_keep_code(rows, code))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class _Inflated(io.RawIOBase):
    """Reads a member's raw bytes as they are unpacked, a bounded piece at a time."""

    def __init__(self, data: bytes, method: int):
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"unsupported compression method {method}")
        self._unpack = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        self._left = memoryview(data)

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        size = len(target)
        if self._unpack is None:
            piece, self._left = bytes(self._left[:size]), self._left[size:]
        else:
            piece = b""
            while not piece and not self._unpack.eof and (self._left or self._unpack.unconsumed_tail):
                more = self._unpack.unconsumed_tail
                if not more:
                    more, self._left = self._left[:1 << 16], self._left[1 << 16 :]
                piece = self._unpack.decompress(more, size)
        target[: len(piece)] = piece
        return len(piece)


def archives(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, content`` of archive files."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def archive_members(archives: DataFrame, name_part: str | None = None) -> DataFrame:
    """``path, place, member, method, data``: the CSV members of zip archives, still packed, one row each.

    ``name_part`` keeps members whose name contains it; an archive without any is an error. An archive is opened where it
    is read, but not unpacked there: its members are dealt over all tasks, which unpack and parse them on their own.
    """
    schema = "path string, place int, member string, method int, data binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                body = content.as_buffer()
                with zipfile.ZipFile(pa.BufferReader(body)) as archive:
                    wanted = lambda n: n.lower().endswith(".csv") and (name_part or "").lower() in n.lower()
                    found = [m for m in archive.infolist() if wanted(m.filename)]
                if not found:
                    raise ValueError(f"No {name_part + ' ' if name_part else ''}CSV found in {path}")
                for place, member in enumerate(found):
                    # The local header repeats name and extra field, whose lengths lie at bytes 26 to 29.
                    head = bytes(body[member.header_offset : member.header_offset + 30])
                    start = member.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                    row = [[path], [place], [member.filename], [member.compress_type], [bytes(body[start : start + member.compress_size])]]
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["path", "place", "member", "method", "data"])

    return archives.select("path", "content").mapInArrow(split, schema).repartition("path", "member")


def member_rows(members: DataFrame, required: Sequence[str], optional: Sequence[str] = (), skip_others: bool = False) -> DataFrame:
    """Rows of packed CSV members as text columns, found by each member's own header; empty fields are NULL.

    A member without a ``required`` column is an error, unless ``skip_others`` and it is not the first of its archive.
    """
    names = [*required, *optional]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)
        for batch in batches:
            for member in batch.to_pylist():
                text = io.TextIOWrapper(io.BufferedReader(_Inflated(member["data"], member["method"]), 1 << 18), encoding="utf-8-sig", newline="")
                reader = csv.reader(text)
                header = {name: i for i, name in reversed(list(enumerate(next(reader, []))))}
                absent = [n for n in required if n not in header]
                if absent and skip_others and member["place"]:
                    continue
                if absent:
                    raise ValueError(f"Missing expected columns: {absent}")
                places = [header.get(n) for n in names]
                rows: list[list[str | None]] = []
                for line in reader:
                    if line:
                        rows.append([(line[i] or None) if i is not None and i < len(line) else None for i in places])
                    if len(rows) >= ROWS_PER_BATCH:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return members.mapInArrow(parse, schema)


def read_observation_archives(spark: SparkSession, paths: Sequence[str], code: str) -> DataFrame:
    """The same from zip archives: the first CSV member, which must hold the table, and all others that hold it."""
    return observations_of(archives(spark, paths), code)


def observations_of(contents: DataFrame, code: str) -> DataFrame:
    """Monitor rows of archives that are given as ``path, content``."""
    return _keep_code(member_rows(archive_members(contents), RAW_COLUMNS, ["Parameter Code"], skip_others=True), code)


# ---- detections ------------------------------------------------------------------------------


def _typed_detections(rows: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    number = lambda c: missing_to_null(F.trim(c).try_cast("double"))
    out = rows.select(
        number("longitude").alias("lon"),
        number("latitude").alias("lat"),
        acquisition_time("acq_date", "acq_time").alias("acq_ts"),
        number("frp").alias("frp"),
        "confidence",
        "daynight",
    )
    out = out.filter(F.col("acq_ts").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("frp").isNotNull())
    out = out.withColumn("acq_day", F.to_date("acq_ts")).withColumn("hour_utc", hour_floor("acq_ts"))
    return out.select(*columns) if columns else out


def read_detections(
    spark: SparkSession, path: str | Sequence[str], name_part: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Hotspot CSV files with typed columns and times; rows without place, time or power go.

    ``name_part`` keeps files whose name contains it. Only the needed columns are parsed.
    """
    parts = []
    for part in _csv_by_header(spark, path):
        if name_part is not None:
            part = part.filter(F.lower(F.col("_metadata.file_name")).contains(name_part.lower()))
        parts.append(part.select(*DETECTION_SCHEMA.fieldNames()))
    return _typed_detections(reduce(lambda a, b: a.unionByName(b), parts), columns)


def read_detection_archives(
    spark: SparkSession, paths: Sequence[str], name_part: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """The same from zip archives: all CSV members whose name contains ``name_part``, each by its own header."""
    return detections_of(archives(spark, paths), name_part, columns)


def detections_of(contents: DataFrame, name_part: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Detections of archives that are given as ``path, content``."""
    return _typed_detections(member_rows(archive_members(contents, name_part), DETECTION_SCHEMA.fieldNames()), columns)


def add_detection_id(detections: DataFrame) -> DataFrame:
    """Numbers the detections (equal rows stay separate rows) and stages them, so that the numbers hold."""
    return stage(detections.withColumn("det_id", F.monotonically_increasing_id()))


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table: read it when it is there, else build and write it first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---- perimeters ------------------------------------------------------------------------------

# Feature properties the incident rules read.
PROPERTIES = (
    "attr_IncidentTypeCategory", "attr_FireDiscoveryDateTime", "attr_FireOutDateTime", "attr_ContainmentDateTime",
    "attr_ControlDateTime", "poly_PolygonDateTime", "attr_IncidentSize", "poly_GISAcres", "attr_UniqueFireIdentifier",
    "poly_IRWINID", "attr_IrwinID", "attr_LocalIncidentIdentifier", "attr_IncidentName", "poly_IncidentName",
    "attr_POOState", "attr_FireCauseGeneral", "attr_FireCauseSpecific", "attr_IncidentTypeKind",
    "attr_PredominantFuelGroup",
)
FEATURE = "properties struct<{}>, geometry struct<type:string, coordinates:string>"


# The two keys of a feature that hold its content.
_CONTENT = ('"properties"', '"geometry"')


def _first_key(spark: SparkSession, path: str) -> str:
    """Which of a feature's two content keys comes first in a collection; only the start of the file is read."""
    head = spark.read.option("lineSep", _CONTENT[1]).text(path).first()
    start = (head["value"] if head else "").partition('"features"')[2]
    return _CONTENT[0] if _CONTENT[0] in start else _CONTENT[1]


def _collection_features(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """Features of collections, read in pieces: the key that a feature begins its content with separates the records.

    A file is split over tasks like any text. A record runs from one separator to the next; put behind its key it is an
    object that ends where the feature does, and what follows is left unread. Other members that carry the separator (such as
    a reference system) lack the second key and are dropped.
    """
    first = _first_key(spark, path)
    second = _CONTENT[1 - _CONTENT.index(first)]
    records = spark.read.option("lineSep", first).text(path).filter(F.col("value").contains(second))
    # What precedes the first separator of a file is no record; it never holds the second key after "features".
    records = records.filter(F.ltrim("value").startswith(":"))
    return records.select(F.from_json(F.concat(F.lit("{" + first), "value"), feature).alias("f")).select("f.*")


def read_perimeters(spark: SparkSession, path: str | Sequence[str], properties: Sequence[str] = PROPERTIES, lines: bool = False) -> DataFrame:
    """Perimeter features as text properties plus ``rings``.

    A feature collection is split over tasks at its features; ``lines`` reads one feature per line. Coordinates stay
    text until their depth is known from the type.
    """
    feature = FEATURE.format(", ".join(f"{p}:string" for p in properties))
    if lines:
        rows = spark.read.schema(feature).json(path)
    else:
        parts = [_collection_features(spark, p, feature) for p in ([path] if isinstance(path, str) else path)]
        rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.select("properties.*", parse_rings("geometry.type", "geometry.coordinates").alias("rings"))


def parse_rings(kind: str, coordinates: str):
    """Polygon or MultiPolygon coordinates as one list of rings of points; other shapes give NULL."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.when(F.col(kind) == "Polygon", polygon).when(F.col(kind) == "MultiPolygon", multi)
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


# ---- sample log ------------------------------------------------------------------------------

LOG_SCHEMA = (
    "sample_id bigint, sample_key string, fire_id string, incident_name string, state string, run_time_utc string, run_date string,"
    " aggregation_mode string, source_hours_utc string, bbox_min_lon double, bbox_min_lat double, bbox_max_lon double, bbox_max_lat double,"
    " size_acres double, split string, label_t_plus_12h_available boolean, label_t_plus_24h_available boolean,"
    " persistence_mse_t_plus_12h double, persistence_mse_t_plus_24h double, advection_mse_t_plus_12h double, advection_mse_t_plus_24h double,"
    " seq bigint"
)


def read_sample_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Rows of a JSON-lines log; malformed lines and lines that are no object are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    there = F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()
    return rows.filter(F.col("_corrupt_record").isNull() & there).drop("_corrupt_record")


def read_index(spark: SparkSession, table: str, log: str) -> DataFrame:
    """Sample index: the written table if there is one, else the log with the latest row per sample."""
    try:
        return spark.read.parquet(table)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return latest_index(read_sample_log(spark, log))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """Field cells as ``write_fields`` left them; filters on variable, level and run pick folders."""
    return spark.read.parquet(f"{path}/cells")


def field_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``run_time, variable, level, cells``: which fields are there, without reading them."""
    return spark.read.parquet(f"{path}/catalog")
