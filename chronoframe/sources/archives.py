"""ZIP members as partitions: a Python data source over central directories.

The driver-side planner reads only the directory at the end of each archive;
every chosen member is a partition, read by seeking to it and unpacked as a
stream. An archive of any size is so read by as many tasks as it has members.
"""

from __future__ import annotations

import csv
import io
import re
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORDS = 10_000  # records a batch
BYTES = 8 << 20  # or about so many characters


def filesystem(path: str):
    """(file system, path in it) of a path or URI, or None where only Spark's own readers reach it."""
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        return None


class Member(InputPartition):
    def __init__(self, archive: str, name: str) -> None:
        super().__init__((archive, name))
        self.archive, self.name = archive, name


def csv_line(record: list[str]) -> str:
    return ",".join('"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\r\n') else x for x in record)


def records_of(text, label: str) -> Iterator[pa.RecordBatch]:
    """Batches of ``member, value`` from a member's text: CSV records without the header, line breaks kept."""
    csv.field_size_limit(sys.maxsize)  # a field may be as long as its member
    records = csv.reader(text)
    next(records, None)
    held: list[str] = []
    size = 0

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([label] * len(held)), pa.array(held)], ["member", "value"])
        held.clear()
        return out

    for r in records:
        line = csv_line(r)
        if line:
            held.append(line)
            size += len(line)
        if len(held) >= RECORDS or size > BYTES:
            yield batch()
            size = 0
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8-sig")
        self.pattern = options.get("member", "")

    def _archives(self) -> list[str]:
        """Archives below the folder, or the one file, in the order of their names; none where nothing has landed."""
        from pyarrow import fs
        files, path = filesystem(self.path)
        at = files.get_file_info(path)
        if at.type == fs.FileType.File:
            return [path]
        found = files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))

    def partitions(self) -> list[InputPartition]:
        files, _ = filesystem(self.path)
        wanted, out = re.compile(self.pattern), []
        for archive in self._archives():
            with files.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                out += [Member(archive, m.filename) for m in z.infolist()
                        if not m.is_dir() and wanted.search(m.filename.rsplit("/", 1)[-1])]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        archive, name = partition.value
        files, _ = filesystem(self.path)
        with files.open_input_file(archive) as f, zipfile.ZipFile(f) as z, z.open(name) as member:
            text = io.TextIOWrapper(member, self.encoding, errors="replace", newline="")
            yield from records_of(text, f"{archive}!{name}")


class ZippedCsv(DataSource):
    """``spark.read.format("zipped_csv")``: options ``path``, ``member`` (regular
    expression on the member's name) and ``encoding``; columns ``member, value``."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        return "member string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
