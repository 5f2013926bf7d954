"""A streaming source that follows growing files: what is appended to a known file arrives once, over restarts and rotations.

The offset of the stream holds for each file its place on disk (device and inode), a fingerprint of its first bytes and the end of its last whole
line. A file is told by its inode and by whether it still begins with the bytes of the fingerprint: renamed, it goes on where it was; written anew under
the old name (or cut short), it begins at 0. A last line without its end waits. Offsets live in the query's checkpoint; a batch that fails is read again.
Driver and executors see the files under the same paths (a shared mount).
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loglake.session import ship
from loglake.sources.framed import MAX_FRAME, MODES, records

#: Bytes of a file that its fingerprint is made of, at most; bytes of a task.
PREFIX, RANGE = 1024, 32 << 20
SCHEMA = "addr string, offset bigint, term string, frag int, raw binary, source_id string"


@dataclass
class Span(InputPartition):
    """Bytes start to stop of a file, told by path, device and inode."""

    path: str
    device: int
    inode: int
    start: int
    stop: int
    size: int


def fingerprint(path: str, length: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(length)).hexdigest()


def whole_lines(path: str, size: int, end: bytes, step: int = 1 << 16) -> int:
    """Bytes up to the last line end."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            low = max(0, at - step)
            f.seek(low)
            found = f.read(at - low + len(end) - 1 if at < size else at - low).rfind(end)
            if found >= 0:
                return low + found + len(end)
            at = low
    return 0


class Follower(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.mode = options.get("mode", "lines")
        self.begin = options.get("startat", "beginning")
        self.known: dict[str, dict] = {}

    def names(self) -> list[str]:
        found = [os.path.join(self.path, "**") if os.path.isdir(self.path) else self.path]
        return sorted(p for p in glob.glob(found[0], recursive=True) if os.path.isfile(p))

    def look(self) -> dict[str, dict]:
        now = {}
        for path in self.names():
            try:
                said = os.stat(path)
                length = min(PREFIX, said.st_size)
                now[f"{said.st_dev}:{said.st_ino}"] = {"path": path, "end": whole_lines(path, said.st_size, MODES[self.mode][0]), "length": length, "prefix": fingerprint(path, length)}
            except FileNotFoundError:  # rotated away meanwhile: found under its other name in the next batch
                continue
        return now

    def initialOffset(self) -> dict:
        return {"files": self.look() if self.begin == "end" else {}}

    def latestOffset(self) -> dict:
        """Files that are gone for now keep their entries, so that they go on where they were when they are back."""
        self.known = self.known | self.look()
        return {"files": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for key, now in end["files"].items():
            before = start["files"].get(key)
            at = before["end"] if before and self.goes_on(before, now) else 0
            device, inode = map(int, key.split(":"))
            for low in range(at, now["end"], RANGE):
                out.append(Span(now["path"], device, inode, low, min(low + RANGE, now["end"]), now["end"]))
        return out

    def goes_on(self, before: dict, now: dict) -> bool:
        """Whether the file still begins as it did, and is no shorter."""
        if before["end"] > now["end"]:
            return False
        if before["prefix"] == now["prefix"]:
            return True
        try:
            return fingerprint(now["path"], before["length"]) == before["prefix"]
        except FileNotFoundError:
            return True

    def read(self, part: Span) -> Iterator[tuple]:
        path = part.path
        if not same_file(path, part):  # renamed since
            path = next((p for p in self.names() if same_file(p, part)), None)
            if path is None:
                raise FileNotFoundError(f"{part.path} is gone, bytes {part.start} to {part.stop} were not read")
        for offset, term, frag, raw in records(path, part.start, part.stop, part.size, self.mode, MAX_FRAME):
            yield part.path, offset, term, frag, raw, os.path.basename(os.path.dirname(part.path))


def same_file(path: str, part: Span) -> bool:
    try:
        said = os.stat(path)
    except FileNotFoundError:
        return False
    return (said.st_dev, said.st_ino) == (part.device, part.inode)


class TailSource(DataSource):
    """``format("loglake_tail")``: path (a folder or a glob), mode (of ``framed.MODES``), startAt (``beginning`` or ``end`` for files there at the first start)."""

    @classmethod
    def name(cls) -> str:
        return "loglake_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Follower:
        return Follower({k.lower(): v for k, v in self.options.items()})


def follow(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines appended to the files under ``path``: raw (text), addr, offset, term, frag, source_id (the folder), received_at."""
    ship(spark)
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format("loglake_tail").options(path=path, **options).load()
    return rows.withColumn("raw", F.col("raw").cast("string")).withColumn("received_at", F.current_timestamp())
