"""Replay of a record table under the active specs: all of it, one source, or its open quarantine; resumable, by ranges of record ids.

A job is a folder: what was asked, and a folder a range with the events and the quarantine of the range, which is there whole or not at all. A job that
was stopped goes on with the ranges that it lacks; a range that is run again replaces itself, so that each record counts once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.operators import normalize, serve
from loglake.sources import exports
from loglake.streaming.fanout import Store

#: Record ids of a range.
RANGE = 1_000_000


class Rebuild:
    def __init__(self, spark: SparkSession, root: str, size: int = RANGE):
        self.spark, self.store, self.size = spark, Store(spark, root), size

    def begin(self, records: DataFrame, scope: str = "all", source: str | None = None) -> dict:
        """What the job is to do; a job that began before keeps what it was asked then. ``scope``: ``all``, ``source`` or ``quarantine``."""
        if "job.json" in self.store.names(""):
            return json.loads(self.store.text("job.json"))
        if scope not in ("all", "source", "quarantine") or (scope == "source") != (source is not None):
            raise ValueError("scope is all, quarantine, or source with a source")
        last = records.agg(F.max("record_id")).first()[0]
        job = {"scope": scope, "source": source, "ranges": 0 if last is None else last // self.size + 1}
        self.store.put("job.json", json.dumps(job))
        return job

    def done(self) -> set[int]:
        return {int(n) for n in self.store.names("done") if n.isdigit()}

    def run(self, records: DataFrame, specs: list[dict], quarantine: DataFrame | None = None, scope: str = "all", source: str | None = None, most: int | None = None, parse: Callable | None = None) -> dict:
        """Goes through the ranges that are not done (``most``: so many at most); returns state, ranges, done, processed, succeeded and failed."""
        job = self.begin(records, scope, source)
        parse = parse or (lambda rows: normalize.normalize(rows, specs))
        rows = records if job["source"] is None else records.filter(F.col("source_id") == job["source"])
        if job["scope"] == "quarantine":
            if quarantine is None:
                raise ValueError("a replay of the quarantine needs it")
            rows = rows.join(quarantine.filter("status = 'open'").select("record_id"), "record_id", "left_semi")
        left = [k for k in range(job["ranges"]) if k not in self.done()]
        for k in left[:most]:
            part = rows.filter(F.col("record_id").between(k * self.size, (k + 1) * self.size - 1))
            fine, rest = normalize.split(parse(part))
            exports.flat(fine).withColumn("unmapped", F.to_json("unmapped")).write.mode("overwrite").parquet(f"{self.store.root}/events/range={k}")
            rest.write.mode("overwrite").parquet(f"{self.store.root}/rest/range={k}")
            self.store.put(f"done/{k}", "written")
        return self.state()

    def state(self) -> dict:
        job, done = json.loads(self.store.text("job.json")), self.done()
        fine, rest = self.table("events"), self.table("rest")
        succeeded, failed = (0 if x is None else x.count() for x in (fine, rest))
        return {"state": "done" if len(done) == job["ranges"] else "running", "ranges": job["ranges"], "done": len(done), "processed": succeeded + failed, "succeeded": succeeded, "failed": failed}

    def table(self, name: str) -> DataFrame | None:
        """What the finished ranges hold of ``events`` or ``rest``."""
        paths = [f"{self.store.root}/{name}/range={k}" for k in sorted(self.done())]
        return self.spark.read.option("basePath", f"{self.store.root}/{name}").parquet(*paths) if paths else None

    def versions(self, before: DataFrame) -> DataFrame:
        """Events (event_id, record_id, arrival) of before with those of the job, as versions; the job's arrive last, known ids keep their arrival."""
        now = self.table("events")
        last = before.agg(F.coalesce(F.max("arrival"), F.lit(0))).first()[0]
        own = before.limit(0) if now is None else now.select(F.col("event_uid").alias("event_id"), "record_id", F.lit(last + 1).alias("arrival"))
        return serve.current_versions(before.select("event_id", "record_id", "arrival").unionByName(own))
