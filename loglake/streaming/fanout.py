"""One stream to many sinks: each micro-batch is spooled once, every sink goes through the spool at its own pace.

A sink has a commit log (a file a batch). One that fails keeps its place, is tried again with the next batch or by ``drain``, and holds up no other. A
batch that a sink refuses for good (``Rejected``) is set aside under ``dead`` with the reason, and the sink goes on. A spooled batch goes when all sinks
are done with it. A batch that Spark runs again overwrites itself in the spool and is not sent again to sinks that have it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A sink takes a batch and its number; it may be called again with a batch that it took in part.
Sink = Callable[[DataFrame, int], None]


class Rejected(Exception):
    """The sink will never take this batch."""


class Store:
    """Files of a folder that the cluster shares, through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.fs.exists(self.path(folder)) else []

    def put(self, name: str, text: str) -> None:
        """Written under another name first, so that a file is whole or not there."""
        draft = self.path(f"{name}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self.path(name), False)
        if not self.fs.rename(draft, self.path(name)):
            raise OSError(f"{name} could not be written")

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Fanout:
    def __init__(self, spark: SparkSession, sinks: dict[str, Sink], root: str):
        if not sinks or any("/" in name for name in sinks):
            raise ValueError("at least one sink, with names that are file names")
        self.spark, self.sinks, self.store = spark, sinks, Store(spark, root)
        self.errors: dict[str, str] = {}

    def done(self, sink: str) -> set[int]:
        return {int(n) for n in self.store.names(f"commits/{sink}") if n.isdigit()}

    def spooled(self) -> list[int]:
        """Batches whose rows were written whole, in order."""
        return sorted(int(n.partition("=")[2]) for n in self.store.names("spool") if n.startswith("batch=") and "_SUCCESS" in self.store.names(f"spool/{n}"))

    def accept(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: spools the batch, then sends what sinks have not had yet."""
        if not all(number in self.done(s) for s in self.sinks):
            batch.write.mode("overwrite").parquet(f"{self.store.root}/spool/batch={number}")
        self.drain()

    def drain(self) -> dict[str, int]:
        """Sends each sink its batches in order up to the first that fails; returns the batches that each still waits for."""
        waiting = self.spooled()
        for name, sink in self.sinks.items():
            self.errors.pop(name, None)
            for number in [n for n in waiting if n not in self.done(name)]:
                rows = self.spark.read.parquet(f"{self.store.root}/spool/batch={number}")
                try:
                    sink(rows, number)
                except Rejected as why:
                    rows.withColumn("_rejected", F.lit(str(why))).write.mode("overwrite").parquet(f"{self.store.root}/dead/{name}/batch={number}")
                    self.store.put(f"commits/{name}/{number}", f"rejected: {why}")
                    continue
                except Exception as why:  # noqa: BLE001  whatever a sink raises is its own trouble: it is told by `errors` and tried again
                    self.errors[name] = f"{type(why).__name__}: {why}"
                    break
                self.store.put(f"commits/{name}/{number}", "written")
        lag = {name: len([n for n in waiting if n not in self.done(name)]) for name in self.sinks}
        for number in waiting:
            if all(number in self.done(name) for name in self.sinks):
                self.store.drop(f"spool/batch={number}")
        return lag

    def start(self, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return rows.writeStream.foreachBatch(self.accept).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def dead(self, sink: str) -> DataFrame | None:
        """Rows that the sink refused for good, with ``_rejected`` and ``batch``; none: nothing was."""
        folder = f"dead/{sink}"
        return self.spark.read.option("basePath", f"{self.store.root}/{folder}").parquet(f"{self.store.root}/{folder}/*") if self.store.names(folder) else None


def send(rows: DataFrame, write_partition: Callable[[list], None], size: int = 500) -> None:
    """Helper of sinks: rows of each task in groups of at most ``size`` to a function that runs there."""

    def run(part) -> None:
        group: list = []
        for row in part:
            group.append(row)
            if len(group) >= size:
                write_partition(group)
                group = []
        if group:
            write_partition(group)

    rows.foreachPartition(run)
