"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of their id and sorted within a shard.
The ranges come from the ids with the least hashes, a fixed, evenly drawn and
bounded set, so equal input gives equal shards whatever its partitioning. A
shard's task rolls to a new file when the compressed size reaches the limit.
Headers and digests are made afresh. A file is written under a temporary name
and renamed when complete; a retried task writes the same bytes under the same
name. The manifest, written last, names the files that count, with their sizes
and digests: without it there is no archive.

Files go to a folder that all executors share (``file://``, or what pyarrow
can open of the cluster's file systems) and are read back by Spark.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.session import scratch_path

ROLL_BYTES = 4 << 20  # compressed size at which a file is complete
SHARD_BYTES = 32 << 20  # payload bytes of a shard, about
MOST_SHARDS = 100_000  # beyond, shards grow: a shard is streamed, so its size costs no memory
DRAWN_PER_SHARD = 64
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}"


def record(page_id, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header and leaves the payload out."""
    revisit = refers_to is not None
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block += b"" if revisit else payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_urn(page_id)}>",
             f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response",
             f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
             f"X-Page-Id: {'' if page_id is None else page_id}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{record_urn(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    at = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at)
        lines = raw[at:head].decode().split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, raw[head + 4:head + 4 + size]
        at = head + 8 + size


def _revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``page_id, sha, refers_to`` of the rows whose payload a row with a smaller id has. Only digests are shuffled."""
    keys = rows.select("page_id", F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha"))
    # equality by SHA-256 and size: SHA-1, which the format asks for, has known collisions
    first = (keys.where(F.col("size") >= least_bytes).groupBy("size", "sha")
             .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return (keys.join(first, ["size", "sha"]).where("refers_to is not null and not page_id <=> refers_to")
            .select("page_id", "sha", "refers_to").distinct())


def shard_bounds(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """Upper ids of all shards but the last. The same for equal input. At most
    ``DRAWN_PER_SHARD`` ids a shard, 51 MB for all, reach the driver."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = min(max(1, -(-total // shard_bytes)), MOST_SHARDS)
    if shards == 1:
        return []
    drawn = (pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("i"))
             .select("i", F.xxhash64("i").alias("h")).orderBy("h", "i").limit(shards * DRAWN_PER_SHARD).select("i").toArrow())
    ids = np.sort(drawn.column("i").to_numpy()).tolist()
    return sorted({ids[len(ids) * k // shards] for k in range(1, shards)}) if ids else []


def shard_of(bounds: list[int]) -> Column:
    """Number of bounds up to ``page_id``, in two steps of about the root of their number each; a null id is in the first shard."""
    page = F.coalesce("page_id", F.lit(-(1 << 63)))
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    rows = [bounds[i:i + width] for i in range(0, len(bounds), width)]

    def upto(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: b <= page))

    heads = F.expr("array(" + ", ".join(f"{r[0]}L" for r in rows) + ")")
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{b}L" for b in r) + ")" for r in rows) + ")")
    step = upto(heads)
    return F.when(step == 0, 0).otherwise((step - 1) * width + upto(F.get(table, step - 1)))


def write_warc(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES,
               least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write ``page_id, url, html`` as WARC files below ``path`` and return the
    manifest: ``file, records, bytes, sha256, first_id, last_id``.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the
    least id is a response and the others revisit it. Rows that share the least
    id and payload are all responses. A null payload is empty; a null id gets
    the same record name for all such rows, sorts first, and is a response
    unless a row with an id has its payload. Other columns are not read. An
    empty table gives an empty manifest and no files.
    """
    spark = pages.sparkSession
    bounds = shard_bounds(pages, shard_bytes)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # a page's revisit mark travels to its shard as a row of its own and sorts before it: payloads are shuffled once
    rows = rows.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(
        _revisits(rows, least_bytes).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                                            F.col("sha").alias("html"), "refers_to"))
    rows = rows.withColumn("__shard", shard_of(bounds))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath

        from pyarrow import fs
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        done: list[dict] = []
        held: dict = {}

        def close() -> None:
            if not held:
                return
            raw = b"".join(held["parts"])
            name = f"shard-{held['shard']:06d}-{held['seq']:05d}.warc.gz"
            temp = posixpath.join(folder, f"_{name}.{uuid.uuid4().hex}.tmp")
            with system.open_output_stream(temp, compression=None) as out:
                out.write(raw)
            system.move(temp, posixpath.join(folder, name))
            done.append({"file": name, "records": len(held["parts"]), "bytes": len(raw),
                         "sha256": hashlib.sha256(raw).hexdigest(), "first_id": held["first"], "last_id": held["last"]})

        marks: dict[str, int] = {}
        of = None
        for batch in batches:
            for shard, page, kind, url, html, refers in zip(*(batch.column(c) for c in (
                    "__shard", "page_id", "kind", "url", "html", "refers_to")), strict=True):
                shard, page = shard.as_py(), page.as_py()
                if page != of:
                    marks, of = {}, page
                if kind.as_py() == 0:
                    marks[html.as_py()] = refers.as_py()
                    continue
                payload = html.as_buffer().to_pybytes()
                target = marks.get(hashlib.sha256(payload).hexdigest()) if marks else None
                if held and (held["shard"] != shard or held["size"] >= roll_bytes):
                    close()
                    held = {"shard": shard, "seq": held["seq"] + 1 if held["shard"] == shard else 0, "parts": [], "size": 0,
                            "first": page, "last": page}
                elif not held:
                    held = {"shard": shard, "seq": 0, "parts": [], "size": 0, "first": page, "last": page}
                one = gzip.compress(record(page, url.as_py(), payload, target, date), 6, mtime=0)
                held["parts"].append(one)
                held["size"] += len(one)
                held["last"] = page
        close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([
            ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()),
            ("first_id", pa.int64()), ("last_id", pa.int64())]))

    sorted_rows = (rows.repartitionById(len(bounds) + 1, F.col("__shard"))  # a task each; hashed numbers would share tasks
                   .sortWithinPartitions("__shard", "page_id", "kind", "url", "html"))
    manifest = sorted_rows.select("__shard", "page_id", "kind", "url", "html", "refers_to").mapInArrow(
        write, "file string, records long, bytes long, sha256 string, first_id long, last_id long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest below ``path`` names.

    Returns ``page_id, url, record_type, refers_to, payload_digest,
    payload_bytes`` and, with ``payloads``, ``payload`` of the responses. A file
    whose bytes differ from the manifest, or a payload from its header, is an
    error, whether payloads are returned or not.
    """
    manifest = spark.read.parquet(f"{path}/manifest").select("file", "sha256")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.warc.gz").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                        *([("payload", pa.binary())] if payloads else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, sha in zip(*(batch.column(c) for c in ("file", "content", "sha256")), strict=True):
                raw = content.as_buffer().to_pybytes()
                if hashlib.sha256(raw).hexdigest() != sha.as_py():
                    raise ValueError(f"{name} differs from the manifest")
                out, size = [[] for _ in schema], 0
                for fields, block in parse(gzip.decompress(raw)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: payload differs from its digest")
                    length = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                    refers = fields.get("X-Refers-To-Page")
                    values = (int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, fields["WARC-Target-URI"], kind,
                              int(refers) if refers else None, digest, length, payload if kind == "response" else None)
                    for column, value in zip(out, values, strict=False):
                        column.append(value)
                    size += len(block) if payloads else 0
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                        out, size = [[] for _ in schema], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return files.join(manifest, "file").mapInArrow(
        read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
        + (", payload binary" if payloads else ""))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Whole ``pages``: written as archives and read back."""
    path = scratch_path(spark, "warc")
    path = path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

