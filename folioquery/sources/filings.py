"""Filings as a Spark source: manifests list them, files hold their HTML.

A folder has manifests (JSON lines: accession number, form, dates, and the file's path below the folder) and the files. ``spark.read`` and ``spark.readStream`` with
format ``filings`` give one row a manifest line with the file's text; a line that is no JSON, or a file that cannot be read, is a row with its error.

The driver lists names and sizes alone. A partition is a range of bytes of one manifest (a line belongs to where it begins), so lines are parsed and files are read by
tasks. A stream's offset is the last manifest's name and size: manifests are read in the order of their names, may grow at the end, and new ones sort after old ones.

    register(spark)
    spark.readStream.format("filings").load("/data/filings")
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: What a manifest tells of a filing, as Spark types.
FIELDS = {"filing_id": "long", "company_id": "long", "accession_number": "string", "form": "string", "items": "array<string>", "fiscal_year": "int", "fiscal_period": "string", "filing_date": "string", "report_date": "string"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", path string, html string, error string"
#: Bytes of a manifest in one partition: some dozens of filings.
RANGE = 16 << 10


@dataclass
class Range(InputPartition):
    manifest: str
    start: int
    stop: int


class _Files:
    """A folder on a mount, or in a store that a file system client reaches."""

    def __init__(self, root: str):
        self.root = root.removeprefix("file://").rstrip("/") if root.startswith("file:") else root.rstrip("/")
        self.remote = None
        if "://" in self.root:
            from pyarrow import fs

            self.remote, self.root = fs.FileSystem.from_uri(self.root)

    def manifests(self) -> list[tuple[str, int]]:
        """(name, size), by name."""
        at = f"{self.root}/manifests"
        if self.remote is None:
            found = [(e.name, e.stat().st_size) for e in os.scandir(at)] if os.path.isdir(at) else []
        else:
            from pyarrow import fs

            found = [(f.base_name, f.size) for f in self.remote.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.is_file]
        return sorted((n, s) for n, s in found if n.endswith(".jsonl"))

    def read(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        path = f"{self.root}/{name}"
        if self.remote is None:
            with open(path, "rb") as f:
                f.seek(start)
                return f.read() if size is None else f.read(size)
        with self.remote.open_input_file(path) as f:
            f.seek(start)
            return f.read() if size is None else f.read(size)


    def write(self, name: str, content: bytes) -> None:
        """Whole or not at all."""
        path = f"{self.root}/{name}"
        part = f"{path}.{uuid.uuid4().hex}.part"
        if self.remote is None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(part, "wb") as f:
                f.write(content)
            os.replace(part, path)
            return
        self.remote.create_dir(os.path.dirname(path), recursive=True)
        with self.remote.open_output_stream(part) as f:
            f.write(content)
        self.remote.move(part, path)


def _lines(files: _Files, part: Range) -> Iterator[bytes]:
    """The lines that begin in the range."""
    at = max(0, part.start - 1)
    data = files.read(f"manifests/{part.manifest}", at, part.stop - at)
    if part.start:
        data = data.partition(b"\n")[2]  # what began before belongs to the range before
        if not data:
            return
    end = part.stop
    while data and not data.endswith(b"\n"):  # the last line goes on
        more = files.read(f"manifests/{part.manifest}", end, RANGE)
        if not more:
            break
        head, newline, _ = more.partition(b"\n")
        data += head + newline
        end += len(more)
        if newline:
            break
    yield from (x for x in data.split(b"\n") if x.strip())


def _value(kind: str, v):
    if v is None:
        return None
    if kind == "string":
        return str(v)
    if kind.startswith("array"):
        return [str(x) for x in v]
    return int(v)


def _rows(root: str, part: Range) -> Iterator[tuple]:
    files = _Files(root)
    for line in _lines(files, part):
        values, path, text, error = [None] * len(FIELDS), None, None, None
        try:
            told = json.loads(line)
            values = [_value(kind, told.get(name)) for name, kind in FIELDS.items()]
            path = str(told["path"])
            if ".." in path.split("/") or path.startswith("/"):
                raise ValueError("a path outside the folder")
            text = files.read(path).decode("utf-8")
        except Exception as e:  # the others go on
            error = f"{type(e).__name__}: {e}"[:300]
        yield (*values, path, text, error)


def _cut(name: str, start: int, stop: int) -> list[Range]:
    return [Range(name, a, min(a + RANGE, stop)) for a in range(start, stop, RANGE)]


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Range]:
        return [r for name, size in _Files(self.root).manifests() for r in _cut(name, 0, size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.root, partition) if partition.manifest else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"name": "", "size": 0}

    def latestOffset(self) -> dict:
        found = _Files(self.root).manifests()
        return {"name": found[-1][0], "size": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in _Files(self.root).manifests():
            if start["name"] <= name <= end["name"]:
                out += _cut(name, start["size"] if name == start["name"] else 0, end["size"] if name == end["name"] else size)
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.root, partition)


class FilingsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"])


def export(rows: DataFrame, root: str, prefix: str) -> int:
    """Write filings (columns of a manifest, path, html) as the source reads them: each task its files, then a manifest of its own under a name that
    begins with ``prefix``. A null html writes no file. Returns how many filings there are. A task that runs twice writes the same."""
    names = [n for n in FIELDS if n in rows.columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, lines = _Files(root), []
        for batch in batches:
            for row in batch.to_pylist():
                if row["html"] is not None:
                    files.write(row["path"], row["html"].encode())
                lines.append(json.dumps({n: row[n] for n in names} | {"path": row["path"]}, default=str))
        if lines:
            files.write(f"manifests/{prefix}-{TaskContext.get().partitionId():06d}.jsonl", ("\n".join(lines) + "\n").encode())
        yield pa.record_batch([pa.array([len(lines)], pa.int64())], ["n"])

    return rows.select(*names, "path", "html").mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilingsSource)


TRANSCRIPT = "transcript_id long, company_id long, year int, quarter int, date date, content string, broken string"


def read_transcripts(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, stream: bool = False) -> DataFrame:
    """Transcripts from files of JSON lines, of calls between two dates (inclusive); a line that is no JSON is a row with the line in ``broken``.
    As a stream, new files are read once each."""
    reader = (spark.readStream if stream else spark.read).schema(TRANSCRIPT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    rows = reader.json(path)
    day = F.col("date")
    kept = F.lit(True)
    if start:
        kept = kept & (day >= F.lit(start).cast("date"))
    if end:
        kept = kept & (day <= F.lit(end).cast("date"))
    return rows.where(F.col("broken").isNotNull() | kept)
