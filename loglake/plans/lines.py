"""Log lines rendered from ``events``, the input of the log queries: one row an event, in a format that depends on its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.plans.registry import table


def kv_line():
    """``ts user action value ip port``, with faults by id: every 11th lacks the address, every 13th repeats a key, every 17th leaves a quote open."""
    e = F.col("event_id")
    return F.concat(
        F.format_string("ts=%d user=u%d action=\"%s\" value=", F.unix_millis("ts"), F.col("user_id"), F.col("event_type")),
        F.col("value").cast("string"),
        F.when(e % 11 == 0, "").otherwise(F.format_string(" ip=10.0.%d.%d", F.col("user_id") % 4, e % 250)),
        F.format_string(" port=%d", (e * 37) % 70000),
        F.when(e % 13 == 0, " user=other").otherwise(""),
        F.when(e % 17 == 0, ' note="open end').otherwise(""),
    )


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than the cluster has cores is dealt out before costly parsing; a larger one stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, source_id, received_at, raw)."""
    rows = spread(events(spark, sf_dir))
    return rows.select(F.col("event_id").alias("record_id"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("source_id"), F.col("ts").alias("received_at"), kv_line().alias("raw"))


#: The spec that reads ``kv_line``.
KV_SPEC = {
    "id": "app_kv",
    "version": "1.0.0",
    "vendor": "Acme",
    "product": "Gate",
    "signature": "ts=[0-9]+ user=",
    "extractors": [
        {
            "id": "main",
            "kind": "kv",
            "class_uid": 4001,
            "map": {
                "time": {"from": "ts", "type": "time", "layout": "epoch_ms"},
                "actor.user.name": {"from": "user"},
                "message": {"from": "action"},
                "metric.value": {"from": "value", "type": "float"},
                "src_endpoint.ip": {"from": "ip", "type": "ip"},
                "src_endpoint.port": {"from": "port", "type": "port"},
                "severity_id": {"from": "action", "type": "enum", "values": {"error": "4", "purchase": "2"}, "default": "1"},
            },
        }
    ],
}

#: What ``KV_SPEC`` accepts, in terms of the source columns.
KV_OK = "(event_id % 11 <> 0 AND (event_id * 37) % 70000 <= 65535)"


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of six formats by ``event_id % 6``: kv, csv, json, cef, leef, syslog."""
    e, v = F.col("event_id"), F.col("value").cast("string")
    ms, user, kind = F.unix_millis("ts"), F.col("user_id"), F.col("event_type")
    csv = F.concat_ws(",", ms.cast("string"), user.cast("string"), kind, v, F.concat(F.lit('"a, ""'), e.cast("string"), F.lit('"""')), F.lit("x"), F.lit(""))
    json = F.concat(F.format_string('{"ts":%d,"user":{"id":%d,"tags":["t%d","t%d"]},"action":"%s","value":', ms, user, e % 3, e % 5, kind), v, F.lit(',"none":null,"props":'), F.col("props"), F.lit("}"))
    cef = F.concat(F.format_string("<34>host CEF:0|Acme|Gate\\|way|1.0|%d|%s|%d|rt=%d suser=user %d msg=a\\=b act=%s cn1=", e % 7, kind, e % 10, ms, user, kind), v)
    leef = F.concat(F.format_string("LEEF:2.0|Acme|Gate|1.0|%s|^|usrName=u%d^devTime=%d^note=a b^value=", kind, user, ms), v)
    syslog = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.format_string(" gate%d app[%d]: user u%d did %s value ", e % 4, e % 1000, user, kind), v)
    raw = F.when(e % 6 == 0, kv_line()).when(e % 6 == 1, csv).when(e % 6 == 2, json).when(e % 6 == 3, cef).when(e % 6 == 4, leef).otherwise(syslog)
    return spread(events(spark, sf_dir)).select(e.alias("record_id"), F.concat(F.lit("s"), user % 5).alias("source_id"), F.col("ts").alias("received_at"), raw.alias("raw"))


SYSLOG = r"^(?P<when>[A-Z][a-z]{2} [0-9]{2} [0-9:]{8}) (?P<host>\S+) (?P<app>[a-z]+)\[(?P<pid>[0-9]+)\]: user (?P<user>u[0-9]+) did (?P<action>[a-z]+) value (?P<value>\S+)$"

MIXED_SPECS = [
    KV_SPEC,
    {"id": "b_csv", "version": "1.0.0", "vendor": "Acme", "product": "Csv", "signature": r"^[0-9]{13},", "extractors": [{"id": "row", "kind": "csv", "options": {"names": ["ts", "user", "action", "value", "note", "_"], "min_columns": 6}, "map": {"time": {"from": "ts", "type": "time", "layout": "epoch_ms"}, "actor.user.name": {"from": "user"}, "metric.value": {"from": "value", "type": "float"}}}]},
    {"id": "c_json", "version": "1.0.0", "vendor": "Acme", "product": "Json", "signature": r"^\{", "extractors": [{"id": "doc", "kind": "json", "options": {"paths": ["user.id"]}, "map": {"time": {"from": "ts", "type": "time", "layout": "epoch_ms"}, "actor.user.name": {"from": "user.id"}, "metric.value": {"from": "value", "type": "float"}}}]},
    {"id": "d_cef", "version": "1.0.0", "vendor": "Acme", "product": "Cef", "signature": "CEF:", "extractors": [{"id": "cef", "kind": "cef", "map": {"time": {"from": "rt", "type": "time", "layout": "epoch_ms"}, "actor.user.name": {"from": "suser"}, "metric.value": {"from": "cn1", "type": "float"}}}]},
    {"id": "e_leef", "version": "1.0.0", "vendor": "Acme", "product": "Leef", "signature": "LEEF:", "extractors": [{"id": "leef", "kind": "leef", "map": {"time": {"from": "devTime", "type": "time", "layout": "epoch_ms"}, "actor.user.name": {"from": "usrName"}, "metric.value": {"from": "value", "type": "float"}}}]},
    {"id": "f_syslog", "version": "1.0.0", "vendor": "Acme", "product": "Syslog", "extractors": [{"id": "errors", "kind": "regex", "options": {"pattern": SYSLOG}, "when": {"action": ["error"]}, "map": {"time": {"from": "when", "type": "time", "layout": "MMM d HH:mm:ss"}, "actor.user.name": {"from": "user"}, "metric.value": {"from": "value", "type": "float"}}}, {"id": "rest", "kind": "regex", "options": {"pattern": SYSLOG}, "map": {"time": {"from": "when", "type": "time", "layout": "MMM d HH:mm:ss"}, "actor.user.name": {"from": "user"}, "metric.value": {"from": "value", "type": "float"}}}]},
]
