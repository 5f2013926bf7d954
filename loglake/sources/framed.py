"""Records out of files and byte streams: delimited scans with byte offsets and terminators, octet-counted frames, whole bodies.

Files are listed by Spark and cut into ranges of bytes; a task reads the records that begin in its range, whichever range they end in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions.values import framing
from loglake.operators.framing import CONT, MORE
from loglake.session import ship

#: Mode -> what ends a record, its name, and whether a carriage return before it belongs to the ending.
MODES = {"lf": (b"\n", "lf", False), "crlf": (b"\r\n", "crlf", False), "lines": (b"\n", "lf", True), "nul": (b"\0", "nul", False)}
MAX_FRAME, RANGE, READ = 1 << 20, 64 << 20, 1 << 20
MAX_OCTETS, MAX_DIGITS = 16 << 20, 10
RECORD = "addr string, offset bigint, term string, frag int, raw binary"


def opened(path: str):
    """A file of any file system that Arrow knows, by the name that Spark gives it."""
    path = re.sub(r"^file:/+(?!/)", "file:///", path)
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length) of the files that ``paths`` name. A glob without files gives none; a literal path that isn't there is an error (Spark's)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        if re.search(r"[*?\[{]", path):
            target = jvm.org.apache.hadoop.fs.Path(path)
            if not len(target.getFileSystem(conf).globStatus(target) or []):
                continue
        found.append(path)
    if not found:
        return spark.createDataFrame([], "path string, length bigint")
    return spark.read.format("binaryFile").load(found).select("path", "length")


class Reader:
    """A file's bytes from a place on, as many as are asked for. What was taken stays in the buffer until the next read, so that taking moves no bytes."""

    def __init__(self, f, at: int, size: int) -> None:
        self.f, self.at, self.size, self.buffer, self.gone = f, at, size, b"", 0

    def have(self) -> int:
        return len(self.buffer) - self.gone

    def find(self, end: bytes, most: int) -> int:
        """Where ``end`` begins within the next ``most`` bytes and itself, or -1."""
        looked = 0
        while True:
            k = self.buffer.find(end, self.gone + max(0, looked - len(end) + 1), self.gone + most + len(end))
            if k >= 0:
                return k - self.gone
            looked = self.have()
            if looked >= most + len(end) or not self.more():
                return -1

    def more(self) -> bool:
        self.f.seek(self.at + self.have())
        data = self.f.read(READ)
        self.buffer, self.gone = self.buffer[self.gone :] + data, 0
        return bool(data)

    def take(self, n: int) -> bytes:
        out = self.buffer[self.gone : self.gone + n]
        self.gone += len(out)
        self.at += len(out)
        return out


def records(path: str, start: int, stop: int, size: int, mode: str, most: int) -> Iterator[tuple[int, str, int, bytes]]:
    """(offset, term, frag, raw) of the records that begin within [start, stop). Longer ones than ``most`` bytes come in parts; an unterminated rest is a
    record with the terminator ``none``; empty records count."""
    end, name, strip = MODES[mode]
    with opened(path) as f:
        read = Reader(f, max(0, start - len(end)), size)
        if start:  # the first record begins after the first ending at or before the range's start
            while (k := read.find(end, READ)) < 0:
                if read.have() <= len(end):
                    return
                read.take(min(read.have(), READ + len(end)) - len(end) + 1)
            read.take(k + len(end))
        while read.at < stop and read.at < size:
            frag = 0
            while True:
                k = read.find(end, most)
                at = read.at
                if k < 0 and read.have() <= most and at + read.have() >= size:
                    raw = read.take(read.have())
                    if raw or frag:
                        yield at, "none", frag, raw
                    break
                if k < 0:
                    yield at, "none", frag | MORE, read.take(most)
                    frag = CONT
                    continue
                raw, term = read.take(k), name
                read.take(len(end))
                if strip and raw.endswith(b"\r"):
                    raw, term = raw[:-1], "crlf"
                yield at, term, frag, raw
                break


def scan(spark: SparkSession, paths: list[str], mode: str = "lines", max_frame: int = MAX_FRAME, range_bytes: int = RANGE) -> DataFrame:
    """(addr, offset, term, frag, raw) of the records of all files that ``paths`` (literal or globs) name: each file and byte offset is an origin."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    ship(spark)
    ranges = files(spark, paths).filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("addr", pa.string()), ("offset", pa.int64()), ("term", pa.string()), ("frag", pa.int32()), ("raw", pa.binary())])
        for batch in batches:
            for path, length, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out, size = [], 0
                for offset, term, frag, raw in records(path, start, start + range_bytes, length, mode, max_frame):
                    out.append((path, offset, term, frag, raw))
                    size += len(raw) + 64
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t.type) for k, t in enumerate(schema)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t.type) for k, t in enumerate(schema)], schema=schema)

    return ranges.repartition(F.col("path"), F.col("start")).mapInArrow(run, RECORD)


def octets(body: bytes, most: int, cap: int) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(offset, frag, raw, error) of ``<length> <message>`` frames; the first error ends the stream. A last message that is shorter than it says is kept,
    its bits say that more should follow."""
    at = 0
    while at < len(body):
        blank = body.find(b" ", at, at + MAX_DIGITS + 1)
        digits = body[at:blank] if blank >= 0 else body[at : at + MAX_DIGITS + 1]
        if not digits or not digits.isdigit() or blank < 0:
            yield at, 0, b"", "malformed length"
            return
        length = int(digits)
        if not 0 < length <= cap:
            yield at, 0, b"", "length is zero" if not length else "length is over the cap"
            return
        at, left, frag = blank + 1, length, 0
        if at >= len(body):
            yield at, 0, b"", "unexpected end"
            return
        while left and at < len(body):
            raw = body[at : at + min(left, most)]
            left -= len(raw)
            yield at, frag | (MORE if left else 0), raw, None
            at, frag = at + len(raw), CONT


def octet_frames(bodies: DataFrame, key: str, body: str, max_frame: int = MAX_FRAME, cap: int = MAX_OCTETS) -> DataFrame:
    """(key, offset, frag, raw, error) of the octet-counted frames of each stream in ``body`` (binary). A stream isn't seekable, so it is one value."""
    ship(bodies.sparkSession)
    kind = bodies.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                for frame in octets(data or b"", max_frame, cap):
                    keys.append(k)
                    out.append(frame)
            columns = [pa.array([f[n] for f in out], t) for n, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], names=["key", "offset", "frag", "raw", "error"])

    out = bodies.select(F.col(key).alias("key"), F.col(body).cast("binary").alias("body")).mapInArrow(run, f"key {kind}, offset bigint, frag int, raw binary, error string")
    return out.withColumnRenamed("key", key)


def mode_of(head: Column) -> Column:
    """Framing of a stream by its first bytes."""
    return framing(F.substring(head, 1, 7))


def whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(addr, offset, term, frag, raw): each file is one record."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("addr"), F.lit(0).cast("bigint").alias("offset"), F.lit("none").alias("term"), F.lit(0).alias("frag"), F.col("content").alias("raw"))
