"""The lake as files: columns, partitions, odd vendors and further paths."""

import json

from pyspark.sql import functions as F

from loglake.operators import normalize
from loglake.plans.lines import KV_SPEC, kv_lines
from loglake.sources import exports


def test_files(spark, sf_dir, tmp_path):
    lines = kv_lines(spark, sf_dir).withColumn("segment", F.lit(1))
    main = KV_SPEC["extractors"][0]
    spec = KV_SPEC | {"vendor": "Ac/me v1.2", "extractors": [main | {"map": main["map"] | {"action_id": {"from": "port", "type": "int"}, "device.hostname": {"from": "action"}, "dst_endpoint.mac": {"from": "value"}}}]}
    rows = exports.lake_columns(normalize.normalize(lines, [spec]), F.col("record_id") % 2 == 0)
    exports.write_lake_columns(rows, str(tmp_path / "lake"))
    back = spark.read.parquet(str(tmp_path / "lake"))
    assert len(set(back.columns) - {"dt", "vendor", "extras_json"}) == 29
    assert back.count() == rows.count() > 0
    got = back.join(lines.select("record_id", F.sha2(F.col("raw").cast("binary"), 256).alias("sha")), "record_id").limit(50).collect()
    for r in got:
        extras = json.loads(r["extras_json"])
        assert (r["vendor"], r["vendor_name"], r["host"]) == ("Ac_me_v1.2", "Ac/me v1.2", extras["ocsf"]["message"])
        assert r["raw_sha256"].hex() == r["sha"] and r["current"] == (r["record_id"] % 2 == 0)
        assert r["action_id"] == r["src_port"] == extras["ocsf"]["src_endpoint"]["port"] and "dst_endpoint.mac" in extras["more"]
        assert str(r["dt"]) == r["event_time"].strftime("%Y-%m-%d") and r["bytes_in"] == 0 and r["dst_ip"] == ""
    none = KV_SPEC | {"vendor": None}
    assert {r["vendor"] for r in exports.lake_columns(normalize.normalize(lines.limit(40), [none])).select("vendor").collect()} == {"unknown"}
    assert exports.lake_columns(normalize.normalize(lines.limit(0), [KV_SPEC])).count() == 0


def test_ocsf_documents(spark, sf_dir):
    main = KV_SPEC["extractors"][0]
    spec = KV_SPEC | {"extractors": [main | {"map": main["map"] | {"dst_endpoint.mac": {"from": "value"}}}]}
    parsed = normalize.normalize(kv_lines(spark, sf_dir), [spec]).withColumn("entities", F.array(F.lit("user:a")))
    rows = exports.ocsf_documents(parsed.withColumn("event_time", F.when(F.col("record_id") % 2 == 0, F.col("event_time"))))
    got = rows.join(parsed.select("record_id", "received_at", "event_time"), "record_id").limit(60).collect()
    assert got and rows.count() == parsed.filter("event is not null").count()
    for r in got:
        doc, at = json.loads(r["line"]), r["event_time"] if r["record_id"] % 2 == 0 else r["received_at"]
        assert doc["metadata"] | {"uid": r["event_id"], "original_time": at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")} == doc["metadata"]
        assert doc["lineage"]["entities"] == ["user:a"] and "raw_data" not in doc and "dst_endpoint.mac" in doc["more"]
    assert exports.ocsf_documents(parsed.limit(0), raw=True).count() == 0
