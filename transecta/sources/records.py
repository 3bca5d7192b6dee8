"""A splittable source of marked text records: byte ranges find the records that start in them, and records are numbered by file order whatever the ranges."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Records of a batch.
ROWS = 4096
START = re.compile(rb"(?m)^>")
BLANK = re.compile(rb"\s+")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder in order of name; names that start with a dot or an underscore are none."""
    system, name = _opened(path)
    found = system.get_file_info(name)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    host = path.removeprefix(scheme).split("/")[0] if scheme and scheme != "file://" else ""
    hidden = lambda p: any(part[:1] in (".", "_") for part in p.removeprefix(name).split("/"))
    return sorted((scheme + (host + f.path if host and f.path.startswith("/") else f.path), f.size) for f in files if f.type == fs.FileType.File and (f is found or not hidden(f.path)))


class RecordReader(DataSourceReader):
    def __init__(self, path: str, split: int, sequences: bool):
        self.path, self.split, self.sequences = path, split, sequences

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(at + self.split, size)) for p, size in _files(self.path) for at in range(0, size, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range):
        """The records whose mark lies in the range; the last one goes on beyond it."""
        if part.end <= part.start:
            return
        system, name = _opened(part.path)
        with system.open_input_file(name) as f:
            base = max(0, part.start - 1)  # one byte more tells whether a line starts here
            buffer = f.read_at(part.end - base, base)
            starts = [m.start() for m in START.finditer(buffer) if base + m.start() >= part.start]
            if not starts:
                return
            size, wanted = f.size(), b"\n>" if self.sequences else b"\n"
            grow = 1 << 16
            at = starts[-1] + 1
            while buffer.find(wanted, at) < 0 and base + len(buffer) < size:
                at = max(at, len(buffer) - 1)
                buffer += f.read_at(min(grow, size - base - len(buffer)), base + len(buffer))
                grow = min(grow * 2, SPLIT_BYTES)
        end = buffer.find(b"\n>", starts[-1])
        ends = [*(s - 1 for s in starts[1:]), end if end >= 0 else len(buffer)]
        rows = []
        for s, e in zip(starts, ends):
            line = buffer.find(b"\n", s)
            line = len(buffer) if line < 0 else line
            header = buffer[s + 1 : line].decode("utf-8", "replace").strip()
            if header:
                rows.append((part.path, part.start, len(rows), header) + ((BLANK.sub(b"", buffer[line:e]).upper().decode("utf-8", "replace"),) if self.sequences else ()))
        for k in range(0, len(rows), ROWS):
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + ROWS]), kinds)], ["path", "start", "place", "header", "sequence"][: len(rows[0])])


class Records(DataSource):
    """Format fasta_records: (path, start, place, header, sequence) of records that a line with the mark > starts.

    Options: path, a file or a folder of any file system that Arrow opens; split, the bytes of a range; sequences,
    false for headers only, which then hold no byte of a sequence. start and place are the range and the
    record's place in it.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta_records"

    def schema(self) -> str:
        return "path string, start long, place long, header string" + (", sequence string" if self._sequences() else "")

    def _sequences(self) -> bool:
        return self.options.get("sequences", "true").lower() == "true"

    def reader(self, schema) -> RecordReader:
        split = int(self.options.get("split", SPLIT_BYTES))
        if split < 1:
            raise ValueError("split must be positive")
        return RecordReader(self.options["path"], split, self._sequences())


def numbered(spark: SparkSession, path: str, sequences: bool = True, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, number, header, sequence) of all records below path; number is a record's place in its file, from 0, for any size of ranges.

    Records are counted by range without their sequences, and the counts before a range, one row for each range,
    are its first number. Records without a header are none. Sequences are in upper case, without white space.
    """
    spark.dataSource.register(Records)
    read = lambda full: spark.read.format("fasta_records").option("split", split).option("sequences", str(full).lower()).load(path)
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    counts = read(False).groupBy("path", "start").agg(F.count(F.lit(1)).alias("n")).select("path", "start", F.coalesce(before, F.lit(0)).alias("first"))
    rows = read(sequences).join(counts, ["path", "start"])
    return rows.select("path", (F.col("first") + F.col("place")).alias("number"), "header", *(["sequence"] if sequences else []))
