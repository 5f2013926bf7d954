"""Replay of the record table, stopped half way and started again."""

import pytest
from pyspark.sql import functions as F

from loglake.operators import normalize, rebuild
from loglake.plans.lines import KV_SPEC, kv_lines


def test_stopped_and_started_again(spark, sf_dir, tmp_path):
    lines = kv_lines(spark, sf_dir)
    n = lines.count()
    whole = rebuild.Rebuild(spark, f"file://{tmp_path}/a", size=300).run(lines, [KV_SPEC])
    job = rebuild.Rebuild(spark, f"file://{tmp_path}/b", size=300)
    first = job.run(lines, [KV_SPEC], most=2)
    assert first["state"] == "running" and first["done"] == 2 and first["processed"] == 600
    again = rebuild.Rebuild(spark, f"file://{tmp_path}/b", size=300)
    assert again.run(lines, [KV_SPEC]) == whole and whole["state"] == "done" and whole["processed"] == n
    assert again.run(lines, [KV_SPEC]) == whole  # nothing is left to do
    same = lambda x: sorted(map(str, x.table("events").drop("range").collect()))
    assert same(again) == same(rebuild.Rebuild(spark, f"file://{tmp_path}/a", size=300))


def test_scopes_and_versions(spark, sf_dir, tmp_path):
    lines = kv_lines(spark, sf_dir)
    fine, rest = normalize.split(normalize.normalize(lines, [KV_SPEC]))
    one = rebuild.Rebuild(spark, f"file://{tmp_path}/one").run(lines, [KV_SPEC], scope="source", source="s1")
    assert one["processed"] == lines.filter("source_id = 's1'").count()
    main = KV_SPEC["extractors"][0]
    looser = KV_SPEC | {"version": "1.1.0", "extractors": [main | {"map": main["map"] | {"src_endpoint.ip": {"from": "ip", "type": "ip", "optional": True}}}]}
    job = rebuild.Rebuild(spark, f"file://{tmp_path}/q")
    got = job.run(lines, [looser], quarantine=rest.select("record_id", "status"), scope="quarantine")
    assert got["processed"] == rest.count() and 0 < got["succeeded"] <= got["processed"]
    before = fine.select(F.concat(F.col("record_id").cast("string"), F.lit(".app_kv@1.0.0")).alias("event_id"), "record_id", F.lit(1).alias("arrival"))
    versions = job.versions(before)
    assert versions.filter("is_current").count() == fine.count() + got["succeeded"]
    with pytest.raises(ValueError):
        rebuild.Rebuild(spark, f"file://{tmp_path}/x").run(lines, [looser], scope="source")
    empty = rebuild.Rebuild(spark, f"file://{tmp_path}/e").run(lines.limit(0), [looser])
    assert empty == {"state": "done", "ranges": 0, "done": 0, "processed": 0, "succeeded": 0, "failed": 0}
