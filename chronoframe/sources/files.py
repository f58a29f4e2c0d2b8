"""File sources.

Text-shaped inputs (CSV with a preamble or a tag row) are read with the
splittable ``text`` source; the position of a line inside its file is the
pair (split start offset, row id), so the header / marker search is a
per-file aggregate instead of a whole-file read in one task. Files that hold
quotes are cut into records by ``records.csv_records``, which reads a file in
many tasks whatever its quoted fields hold.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoframe.session import broadcast_below
from chronoframe.sources.archives import ZippedCsv, filesystem, records_of
from chronoframe.sources.records import csv_records


def _ddl(schema) -> str:
    if isinstance(schema, str):
        return schema
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _struct(spark: SparkSession, schema) -> StructType:
    if isinstance(schema, StructType):
        return schema
    return spark.createDataFrame([], schema).schema


# S01
def scan_table(spark: SparkSession, source: str, columns: Sequence[str] | None = None, where=None,
               params: Mapping[str, object] | None = None) -> DataFrame:
    """A Parquet path or catalog table, optional projection and predicate.
    ``where`` may use ``:name`` placeholders bound from ``params`` as literals
    (through the SQL parameter API, not string pasting)."""
    df = spark.read.parquet(source) if ("/" in source or source.endswith(".parquet")) else spark.table(source)
    if where is not None:
        if isinstance(where, str):
            if params:
                df = spark.sql(f"SELECT * FROM {{scanned}} WHERE {where}", args=dict(params), scanned=df)  # its view is dropped again
            else:
                df = df.filter(F.expr(where))
        else:
            df = df.filter(where)
    if columns:
        df = df.select(*columns)
    return df


def _parse(lines: DataFrame, schema, value: str = "value") -> DataFrame:
    ddl = _ddl(schema)
    parsed = lines.select(F.from_csv(F.col(value), ddl, {"mode": "PERMISSIVE", "escape": '"', "multiLine": "true"}).alias("__r"))
    return parsed.select("__r.*")


def _bytes(text: str) -> int:
    """A size setting of Spark in bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", text.lower()).groups()
    return int(number) << (10 * "kmgt".index(unit) + 10 if unit else 0)


def _any_quote(spark: SparkSession, path: str) -> bool:
    return not spark.read.text(path).filter(F.col("value").contains('"')).isEmpty()


# S02
def scan_csv(spark: SparkSession, path: str, schema, header: bool = True) -> DataFrame:
    """Header CSV (RFC 4180: doubled quotes, line breaks inside quotes) typed by
    a declared schema; malformed fields become NULL. Files of one split are
    read by one task each. Larger ones are read by many: as lines when they
    hold no quote, else as records whose starts a scan over all quotes has found."""
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0  # the listing; no content
    quoted = largest > split and _any_quote(spark, path)
    if quoted:
        return _parse(csv_records(spark, path).filter((F.col("rec") > int(header) - 1) & (F.length("value") > 0)), schema)
    declared = _struct(spark, schema)
    read = spark.read.csv(path, schema=declared, header=header, mode="PERMISSIVE", quote='"', escape='"',
                          multiLine=largest <= split)
    return read.select(*[f"`{c}`" for c in declared.names])  # a folder's partition columns are not the file's


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and an in-file order key (split offset, row id)."""
    t = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__blk"),
        F.monotonically_increasing_id().alias("__id"))
    return t.withColumn("__pos", F.struct("__blk", "__id"))


def _per_file(spark: SparkSession, path: str, side: DataFrame, rows: int) -> DataFrame:
    """``side`` has at most ``rows`` rows a file, each a path and a position, so
    the listing bounds its size in bytes. Broadcast, it spares the lines a
    shuffle by file."""
    return broadcast_below(side, rows * sum(len(f.encode()) + 64 for f in spark.read.text(path).inputFiles()))


# S03
def scan_csv_preamble(spark: SparkSession, path: str, marker: str, schema) -> DataFrame:
    """Skip everything up to and including the first line starting with
    ``marker`` (the header) in each file, parse the records behind it. Quotes
    above the header mean nothing; below it they may hold line breaks."""
    if _any_quote(spark, path):
        return _parse(csv_records(spark, path, marker).filter(F.length("value") > 0), schema)
    lines = _lines(spark, path)
    first = lines.filter(F.col("value").startswith(marker)).groupBy("__file").agg(F.min("__pos").alias("__hdr"))
    body = lines.join(_per_file(spark, path, first, 1), "__file", "inner").filter(F.col("__pos") > F.col("__hdr"))
    return _parse(body.filter(F.length("value") > 0), schema)


# S04
def scan_csv_tagrow(spark: SparkSession, path: str, schema, tag: str = "#") -> DataFrame:
    """Header CSV whose *second* record may be a tag row (``#…``): that one
    is dropped; a ``#`` data row further down is kept."""
    if _any_quote(spark, path):
        tagged = (F.col("rec") == 1) & F.col("value").startswith(tag)
        return _parse(csv_records(spark, path).filter((F.col("rec") > 0) & ~tagged & (F.length("value") > 0)), schema)
    lines = _lines(spark, path)
    first = lines.groupBy("__file").agg(F.min("__pos").alias("__hdr"))
    body = lines.join(_per_file(spark, path, first, 1), "__file").filter(F.col("__pos") > F.col("__hdr"))
    second = body.groupBy("__file").agg(F.min(F.struct("__pos", "value")).alias("__s")).filter(
        F.col("__s.value").startswith(tag)).select("__file", F.col("__s.__pos").alias("__pos"))
    body = body.join(_per_file(spark, path, second, 1), ["__file", "__pos"], "left_anti")
    return _parse(body.filter(F.length("value") > 0), schema)


# S05
def scan_csv_in_zip(spark: SparkSession, path: str, member_regex: str, schema, encoding: str = "utf-8-sig") -> DataFrame:
    """CSV members of ZIP archives: pick members by regex, decode (BOM
    stripped, undecodable bytes replaced), drop each member's header, parse.
    Members are streamed record by record, line breaks inside quotes included.
    Each member is a task of its own, planned from the archive's directory,
    whatever the archive's size; where only Spark's readers reach the path, an
    archive is one task and 2 GB at most."""
    if filesystem(path) is not None:
        spark.dataSource.register(ZippedCsv)
        lines = (spark.read.format("zipped_csv").option("path", path).option("member", member_regex)
                 .option("encoding", encoding).load())
        return _parse(lines, schema)
    pattern = re.compile(member_regex)

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(blob.as_buffer())) as z:
                    for name in z.namelist():
                        if pattern.search(name.rsplit("/", 1)[-1]):
                            with io.TextIOWrapper(z.open(name), encoding, errors="replace", newline="") as text:
                                yield from records_of(text, f"{p}!{name}")

    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return _parse(blobs.mapInArrow(unzip, "member string, value string"), schema)


# S06
def scan_json_array(spark: SparkSession, path: str, rename: Mapping[str, str] | None = None, schema=None) -> DataFrame:
    """Files holding a JSON array of flat records (odd keys allowed)."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(_struct(spark, schema))
    df = r.json(path)
    return rename_map(df, rename) if rename else df


# S07
def scan_json_pages(spark: SparkSession, path: str, items_field: str | None = "data", row_schema=None) -> DataFrame:
    """Landed API pages → rows. ``items_field`` names the array in an object
    page (``{"data": [...]}`` / ``{"items": [...], "maxPages": n}``); ``None``
    means the ``[meta, [rows]]`` page shape, which needs ``row_schema``
    (optional for object pages: it skips schema inference)."""
    if items_field is not None:
        r = spark.read.option("multiLine", True)
        if row_schema is not None:  # declared: no inference pass, and empty landings read as empty
            r = r.schema(f"`{items_field}` array<struct<{_ddl_struct(spark, row_schema)}>>")
        pages = r.json(path)
        return pages.select(F.explode(F.col(items_field)).alias("__r")).select("__r.*")
    raw = spark.read.option("wholetext", True).text(path)
    parts = raw.select(F.from_json("value", "array<string>").alias("__p"))
    rows = parts.select(F.explode(F.from_json(F.element_at("__p", 2), f"array<struct<{_ddl_struct(spark, row_schema)}>>")).alias("__r"))
    return rows.select("__r.*")


def _ddl_struct(spark: SparkSession, schema) -> str:
    st = _struct(spark, schema)
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in st.fields)


# S07, pages that differ
def scan_json_variant(spark: SparkSession, path: str, items: str, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Landed pages whose records differ in keys and types from page to page, in
    one pass and without an inference scan: a page is parsed as ``VARIANT`` and
    ``columns`` takes ``{name: (path, type)}`` out of each record, e.g.
    ``{"amount": ("$['amount (eur)']", "double")}``. A key that a record lacks,
    or a value that is no such type, is NULL; a page that is no JSON has no
    records. ``items`` is the path of the array in a page, ``$`` for the page."""
    pages = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("page"))
    records = pages.select(F.explode(F.try_variant_get("page", items, "array<variant>")).alias("r"))
    return records.select(*[F.try_variant_get("r", at, kind).alias(name) for name, (at, kind) in columns.items()])


# S08
def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection files named by date → one row per polygon vertex:
    (date, feature_id, ring, vertex, lon, lat)."""
    schema = ("type string, features array<struct<type: string, properties: map<string, string>, "
              "geometry: struct<type: string, coordinates: array<array<array<double>>>>>>")
    fc = spark.read.option("multiLine", True).schema(schema).json(path) \
        .withColumn("date", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})", 1)))
    f = fc.select("date", F.posexplode("features").alias("feature_id", "f"))
    r = f.select("date", "feature_id", F.posexplode("f.geometry.coordinates").alias("ring", "pts"))
    v = r.select("date", "feature_id", "ring", F.posexplode("pts").alias("vertex", "xy"))
    return v.select("date", "feature_id", "ring", "vertex", F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat"))


# S09
def rename_map(df: DataFrame, mapping: Mapping[str, str], order: Sequence[str] | None = None) -> DataFrame:
    """External header → canonical name; keep only mapped columns that exist,
    in declared order (missing ones are ignored)."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    renamed = df.withColumnsRenamed(present)
    wanted = list(order) if order else list(mapping.values())
    return renamed.select(*[F.col(f"`{c}`") for c in wanted if c in renamed.columns])
