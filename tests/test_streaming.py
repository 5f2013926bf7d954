"""Streams over files that a test writes."""

import time

from pyspark.sql import functions as F

from loglake.operators import identity
from loglake.plans.lines import KV_SPEC, kv_lines
from loglake.plans.records import asked, facts
from loglake.streaming import jobs


def test_tail_normalize_twice(spark, sf_dir, tmp_path):
    lines = kv_lines(spark, sf_dir).filter("record_id < 300").select("raw")
    lines.filter("length(raw) % 2 = 0").coalesce(1).write.text(str(tmp_path / "in/gate1"))

    def run():
        q = jobs.normalize_to(jobs.tail(spark, str(tmp_path / "in")), [KV_SPEC], str(tmp_path / "events"), str(tmp_path / "rest"), str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    lines.filter("length(raw) % 2 = 1").coalesce(1).write.text(str(tmp_path / "in/gate2"))
    run()
    run()
    events, rest = spark.read.parquet(str(tmp_path / "events")), spark.read.parquet(str(tmp_path / "rest"))
    assert events.count() + rest.count() == 300
    assert {r["source_id"] for r in events.select("source_id").distinct().collect()} == {"gate1", "gate2"}


def test_multiline_stream_releases_what_waits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x\nA 1\nb\nA 2\nc\n")
    lines = spark.readStream.text(str(tmp_path / "in")).select(F.lit("s").alias("source_id"), F.col("value").alias("raw"))
    q = jobs.multiline(lines.coalesce(1), "^A ", 500).writeStream.format("memory").queryName("records").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            got = sorted(r["raw"] for r in spark.table("records").collect())
            if len(got) == 3:
                break
            time.sleep(1)
        assert got == ["A 1\nb", "A 2\nc", "x"]
    finally:
        q.stop()


def test_late_facts_change_what_they_should(spark, sf_dir):
    every = facts(spark, sf_dir)
    known, fresh = every.filter("record_id % 10 != 4"), every.filter("record_id % 10 = 4")
    want = asked(spark, sf_dir)
    claims, changed = jobs.late_facts(known, fresh, want)
    a = identity.resolve(want, identity.claims(known), "id").select("id", "user")
    b = identity.resolve(want, identity.claims(every), "id").select("id", F.col("user").alias("now"))
    differ = {r["id"] for r in a.join(b, "id").filter(~F.col("user").eqNullSafe(F.col("now"))).collect()}
    assert {r["id"] for r in changed.collect()} == differ and differ
    assert claims.count() > 0
