"""Landed-file fixtures derived from the driver tables.

The S- and X-queries exercise readers of raw files (CSV with a preamble or a
tag row, zipped CSV, JSON arrays, API pages, GeoJSON, file streams). The
inputs are rendered from the driver tables by Spark itself, JVM-side
(``to_csv`` / ``to_json`` over bounded groups) except the ZIP archives, and
written in parallel into the shared scratch folder — so their size grows
with the tables like everything else.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.session import scratch_path


def _spread(df: DataFrame, min_files: int) -> DataFrame:
    """Keep the input's own partitioning (one output file per input split, so
    nothing is funnelled); only spread out when there are fewer splits than
    ``min_files`` (small test tables), never merge."""
    n = df.rdd.getNumPartitions()  # planning only, no job
    return df.repartition(min_files) if n < min_files else df


def write_csv_files(df: DataFrame, name: str, head_lines, files: int | None = None, min_files: int = 4) -> str:
    """CSV files whose first lines are ``head_lines(header)`` (a preamble,
    the header, a tag row …), rendered JVM-side: rows become ``to_csv`` text
    tagged with a file number, each file's head lines are unioned in with a
    lower sequence, and ``partitionBy`` on the file number writes one file
    per number with its head first (the rows of a file number are co-located
    and sorted by sequence)."""
    spark = df.sparkSession
    n = files or max(min_files, df.rdd.getNumPartitions())  # planning only
    cols = df.columns
    head = head_lines(",".join(cols))
    body = df.select(F.pmod(F.hash(*cols), F.lit(n)).alias("__f"), F.lit(len(head)).alias("__seq"),
                     F.to_csv(F.struct(*cols), {"dateFormat": "yyyy-MM-dd", "escape": '"',
                                                   "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("value"))
    heads = spark.range(n).select(F.col("id").cast("int").alias("__f"),  # generated on the executors, not the driver
                                  F.posexplode(F.array(*[F.lit(line) for line in head])).alias("__seq", "value"))
    out = heads.unionByName(body).repartition(n, "__f").sortWithinPartitions("__f", "__seq")
    path = scratch_path(spark, name)
    out.select("__f", "value").write.partitionBy("__f").text(path)
    return path


def write_json_pages(df: DataFrame, name: str, page, rows_per_page: int = 5000) -> str:
    """JSON documents of at most about ``rows_per_page`` records, one per
    file (a landed API page): rows are hashed into pages, each page's records
    are collected (a bounded group) and ``page(records_column, n_pages)``
    builds the document text."""
    spark = df.sparkSession
    n_pages = max(1, -(-df.count() // rows_per_page))
    cols = df.columns
    paged = df.withColumn("__p", F.pmod(F.hash(*cols), F.lit(n_pages)))
    docs = paged.groupBy("__p").agg(F.collect_list(F.struct(*cols)).alias("__rows"))
    path = scratch_path(spark, name)
    docs.select("__p", page(F.col("__rows"), n_pages).alias("value")).write.partitionBy("__p").text(path)
    return path


def csv_text(pdf: pd.DataFrame, header: bool = True) -> str:
    buf = io.StringIO()
    pdf.to_csv(buf, index=False, header=header, lineterminator="\n", date_format="%Y-%m-%d")
    return buf.getvalue()


def write_zipped_csv(df: DataFrame, name: str, member: str, min_files: int = 4) -> str:
    """One ZIP archive per input split holding a BOM-prefixed CSV member and
    an unrelated text member, written with the filesystem of the target URI.
    The member is packed as its rows arrive: a task holds one batch of them."""
    path = scratch_path(df.sparkSession, name)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext
        frames = (pdf for pdf in it if len(pdf))
        first = next(frames, None)
        if first is None:
            return
        # named by partition: a retried task overwrites its own archive instead of adding a duplicate
        target = f"{path}/part-{TaskContext.get().partitionId():05d}.zip"
        filesystem, p = pafs.FileSystem.from_uri(target if "://" in target else "file://" + target.replace("file:", ""))
        filesystem.create_dir(p.rsplit("/", 1)[0], recursive=True)
        rows = len(first)
        with filesystem.open_output_stream(p) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
            with zf.open(member, "w", force_zip64=True) as body:
                body.write(("\ufeff" + csv_text(first)).encode("utf-8"))
                for pdf in frames:
                    body.write(csv_text(pdf, header=False).encode("utf-8"))
                    rows += len(pdf)
            zf.writestr("readme.txt", "not data\n")
        yield pd.DataFrame({"file": [target], "rows": [rows]})

    _spread(df, min_files).mapInPandas(run, "file string, rows long").collect()  # one row per archive
    from pyarrow import fs as pafs
    filesystem, p = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.replace("file:", ""))
    filesystem.create_dir(p, recursive=True)  # an empty landing is an empty folder, not a missing one
    return path
