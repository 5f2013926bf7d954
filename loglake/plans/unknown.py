"""Queries about sources whose format is not known yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.operators import columns, normalize
from loglake.plans.lines import KV_OK, KV_SPEC, events, kv_lines, spread
from loglake.plans.registry import query

FIELDS = ["c1_time", "c2_src", "c3_dst", "c4_port", "c5_mac", "c6_act", "c7_nat", "c8_n", "c9_ms", "c10_user", "c11_proto", "c12_level", "c13_day", "c14_six", "c15_none", "c16_text"]
VERBS = {"error": "deny", "click": "allow", "view": "allowed", "purchase": "accept", "signup": "drop"}
VERB = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERBS.items()) + " END"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    verb = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in VERBS.items()])
    return spread(events(spark, sf_dir)).select(
        e.alias("record_id"), F.concat(F.lit("s"), u % 3).alias("source_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("c1_time"), F.format_string("10.0.%d.%d", u % 4, e % 200).alias("c2_src"), F.format_string("93.184.0.%d", e % 50).alias("c3_dst"),
        F.when(e % 4 == 0, "").otherwise(((e * 37) % 65536).cast("string")).alias("c4_port"), F.format_string("aa:bb:cc:00:00:%02d", e % 90).alias("c5_mac"), verb.alias("c6_act"),
        F.when(e % 50 == 0, "10.9.9.9").otherwise(F.format_string("10.0.%d.%d", u % 4, e % 200)).alias("c7_nat"), F.when(e % 3 == 0, F.lit(None)).otherwise((e + 70000).cast("string")).alias("c8_n"), F.unix_millis("ts").cast("string").alias("c9_ms"),
        F.format_string("corp\\u%d", u).alias("c10_user"), F.when(e % 2 == 0, "tcp").otherwise("UDP").alias("c11_proto"), F.element_at(F.array(F.lit("low"), F.lit("high"), F.lit("7")), (e % 3 + 1).cast("int")).alias("c12_level"),
        F.date_format("ts", "yyyy-MM-dd").alias("c13_day"), F.lit("fd00::1").alias("c14_six"), F.lit("").alias("c15_none"), F.format_string("%d %% of", e).alias("c16_text"),
    )


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.long_form(wide(spark, sf_dir).drop("record_id"), FIELDS)


S = "'s' || (user_id % 3) AS source_id"


@query(f"""WITH e AS (SELECT {S}, * FROM events), n AS (SELECT source_id, (event_id * 37) % 65536 AS v FROM e WHERE event_id % 4 <> 0)
SELECT DISTINCT source_id, field, type, share FROM e, (VALUES ('c1_time', 'timestamp', 1.0::DOUBLE), ('c2_src', 'ipv4', 1.0), ('c3_dst', 'ipv4', 1.0), ('c5_mac', 'mac', 1.0), ('c6_act', 'action', 1.0), ('c6_act', 'username', 1.0), ('c7_nat', 'ipv4', 1.0), ('c8_n', 'integer', 1.0), ('c9_ms', 'timestamp', 1.0), ('c9_ms', 'integer', 1.0),
  ('c4_port', 'port', 1.0), ('c4_port', 'integer', 1.0), ('c10_user', 'username', 1.0), ('c11_proto', 'protocol', 1.0), ('c11_proto', 'username', 1.0), ('c13_day', 'date', 1.0), ('c13_day', 'hostname', 1.0), ('c14_six', 'ipv6', 1.0)) v(field, type, share)
UNION ALL SELECT source_id, 'c4_port', 'protocol', round(avg(CASE WHEN v IN (1, 6, 17, 58) THEN 1 ELSE 0 END), 9) FROM n GROUP BY 1 HAVING count(*) FILTER (v IN (1, 6, 17, 58)) > 0
UNION ALL SELECT source_id, 'c4_port', 'severity', round(avg(CASE WHEN v <= 10 THEN 1 ELSE 0 END), 9) FROM n GROUP BY 1 HAVING count(*) FILTER (v <= 10) > 0
UNION ALL SELECT source_id, 'c12_level', 'severity', 1.0 FROM e GROUP BY 1 UNION ALL SELECT source_id, 'c12_level', 'username', round(avg(CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END), 9) FROM e GROUP BY 1""")
def column_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.candidates(long(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"""WITH e AS (SELECT {S}, * FROM events) SELECT DISTINCT source_id, field, layout, 1.0::DOUBLE AS share FROM e, (VALUES ('c1_time', 'yyyy-MM-dd HH:mm:ss'), ('c9_ms', 'epoch_ms'), ('c13_day', 'yyyy-MM-dd')) v(field, layout)""")
def time_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.time_layouts(long(spark, sf_dir))


SAID = ["2024/01/02 03:04:05", "2024-01-02 03:04:05", "Jan  2 03:04:05", "02/Jan/2024:03:04:05 +0530", "Jan 2 2024 03:04:05", "1704164645", "1704164645123", "1704164645123456", "1704164645123456789", "2024-01-02T03:04:05Z", "03:04:05", "0018164645"]
NAMES = "['yyyy/MM/dd HH:mm:ss', 'yyyy-MM-dd HH:mm:ss', 'MMM d HH:mm:ss', 'dd/MMM/yyyy:HH:mm:ss Z', 'MMM d yyyy HH:mm:ss', 'epoch_s', 'epoch_ms', 'epoch_us', 'epoch_ns', 'rfc3339', 'HH:mm:ss', NULL]"


@query(f"SELECT 'f' || (event_id % 12) AS field, ({NAMES})[event_id % 12 + 1] AS layout, round(avg(CASE WHEN event_id % 12 < 9 AND event_id % 24 >= 12 AND event_id % 5 = 0 THEN 0.0 ELSE 1.0 END), 6) AS share FROM events WHERE event_id % 12 <> 11 GROUP BY ALL")
def time_layout_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    said = F.element_at(F.array(*[F.lit(x) for x in SAID]), (e % 12 + 1).cast("int"))
    rows = events(spark, sf_dir).select(F.lit("s").alias("source_id"), F.concat(F.lit("f"), e % 12).alias("field"), F.when((e % 12 < 9) & (e % 24 >= 12) & (e % 5 == 0), "none").otherwise(said).alias("value"))
    return columns.time_layouts(rows).select("field", "layout", F.round("share", 6).alias("share"))


@query(f"""WITH e AS (SELECT {S}, * FROM events) SELECT source_id, 'c4_port' AS field, count(*) AS rows, count(*) FILTER (event_id % 4 = 0) AS empty, count(DISTINCT (event_id * 37) % 65536) FILTER (event_id % 4 <> 0) AS "distinct" FROM e GROUP BY 1
UNION ALL SELECT source_id, 'c6_act', count(*), 0, count(DISTINCT event_type) FROM e GROUP BY 1 UNION ALL SELECT source_id, 'c8_n', count(*), count(*) FILTER (event_id % 3 = 0), count(*) FILTER (event_id % 3 <> 0) FROM e GROUP BY 1
UNION ALL SELECT source_id, 'c15_none', count(*), count(*), 0 FROM e GROUP BY 1 UNION ALL SELECT source_id, 'c3_dst', count(*), 0, count(DISTINCT event_id % 50) FROM e GROUP BY 1""")
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.stats(long(spark, sf_dir)).filter("field in ('c3_dst', 'c4_port', 'c6_act', 'c8_n', 'c15_none')")


@query(f"""WITH e AS (SELECT {S}, {VERB} AS verb, * FROM events), t AS (SELECT source_id, list_sort(list(DISTINCT verb)) AS l, count(*) AS n FROM e GROUP BY 1), n AS (SELECT source_id, count(*) FILTER (event_id % 3 <> 0) AS present, list_sort(list(CAST(event_id + 70000 AS VARCHAR)) FILTER (event_id % 3 <> 0)) AS l, count(*) AS n FROM e GROUP BY 1)
SELECT source_id, 'c6_act' AS field, n AS present, len(l) AS "distinct", array_to_string(l[1:3], '|') AS samples, false AS warning FROM t UNION ALL SELECT source_id, 'c8_n', present, present, array_to_string(l[1:3], '|'), n > 2 * present FROM n UNION ALL SELECT source_id, 'c15_none', 0, 0, '', true FROM t""")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.field_stats(long(spark, sf_dir)).filter("field in ('c6_act', 'c8_n', 'c15_none')")


@query(f"""WITH e AS (SELECT DISTINCT {S} FROM events) SELECT source_id, 'c2_src' AS field, 'src_endpoint.ip' AS role FROM e UNION ALL SELECT source_id, 'c3_dst', 'dst_endpoint.ip' FROM e""")
def role_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.roles(long(spark, sf_dir), {f: n for n, f in enumerate(FIELDS)})


@query(f"""WITH e AS (SELECT DISTINCT {S} FROM events) SELECT source_id, field, role FROM e, (VALUES ('col_0', 'src_endpoint.ip'), ('col_1', 'dst_endpoint.ip'), ('col_3', 'src_endpoint.port'), ('col_2', 'dst_endpoint.port')) v(field, role)""")
def role_by_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nameless columns: an inner address before an outer one, a well-known port before an ephemeral one."""
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(F.concat(F.lit("s"), F.col("user_id") % 3).alias("source_id"), F.format_string("10.1.%d.%d", e % 4, e % 200).alias("col_0"), F.format_string("198.51.100.%d", e % 90).alias("col_1"), F.when(e % 2 == 0, "443").otherwise("53").alias("col_2"), (e % 30000 + 20000).cast("string").alias("col_3"), F.format_string("203.0.113.%d", e % 7).alias("col_4"))
    typed = columns.typed(columns.long_form(rows, ["col_0", "col_1", "col_2", "col_3", "col_4"]), names=False, lists=False)
    return typed.filter("path != ''").select("source_id", "field", F.col("path").alias("role"))


@query(f"""WITH e AS (SELECT DISTINCT {S} FROM events) SELECT source_id, field, type, path, confidence FROM e, (VALUES ('c1_time', 'timestamp', 'time', 1.0::DOUBLE), ('c2_src', 'ipv4', 'src_endpoint.ip', 1.0), ('c3_dst', 'ipv4', 'dst_endpoint.ip', 0.855), ('c4_port', 'port', 'src_endpoint.port', 0.875), ('c5_mac', 'mac', '', 0.8), ('c6_act', 'action', 'action_id', 0.8),
  ('c7_nat', 'ipv4', '', 0.5), ('c8_n', 'integer', '', 0.5), ('c9_ms', 'timestamp', '', 0.5), ('c10_user', 'username', 'actor.user.name', 0.925), ('c11_proto', 'protocol', 'connection_info.protocol_name', 0.8), ('c12_level', 'severity', 'severity_id', 0.925), ('c13_day', 'date', '', 0.5), ('c14_six', 'ipv6', '', 0.5), ('c15_none', 'empty', '', 0.0), ('c16_text', 'string', '', 0.4)) v(field, type, path, confidence)""")
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.typed(long(spark, sf_dir), {f: n for n, f in enumerate(FIELDS)}, lists=False).select("source_id", "field", "type", "path", "confidence")


@query(f"""WITH e AS (SELECT {S}, * FROM events) SELECT source_id, 'c2_src' AS a, 'c7_nat' AS b, round(avg(CASE WHEN event_id % 50 <> 0 THEN 1 ELSE 0 END), 6) AS share FROM e GROUP BY 1 HAVING avg(CASE WHEN event_id % 50 <> 0 THEN 1 ELSE 0 END) >= 0.95""")
def twin_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.twins(wide(spark, sf_dir), FIELDS).withColumn("share", F.round("share", 6))


@query(f"""SELECT {S}, 'c6_act' AS field, count(DISTINCT event_type) AS values FROM events GROUP BY 1 UNION ALL SELECT {S}, 'c11_proto', 2 FROM events GROUP BY 1 UNION ALL SELECT {S}, 'c12_level', 3 FROM events GROUP BY 1""")
def routing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(spark, sf_dir).drop("record_id")
    return columns.routing_keys(columns.long_form(rows, [f for f in FIELDS if f not in ("c10_user", "c13_day")]), rows)


@query(f"""SELECT 's' || (user_id % 5) AS source_id, count(*) AS samples, count(*) FILTER ({KV_OK}) AS parsed, count(*) FILTER (NOT {KV_OK}) AS failed, round(avg(CASE WHEN {KV_OK} THEN 1 ELSE 0 END), 6) AS match_rate FROM events GROUP BY 1""")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.dry_run(normalize.normalize(kv_lines(spark, sf_dir), [KV_SPEC])).drop("coverage")


@query(f"""WITH r AS (SELECT 'u' || user_id AS source_id, avg(CASE WHEN {KV_OK} THEN 1.0 ELSE 0 END) AS m FROM events GROUP BY user_id)
SELECT source_id, m >= 0.95 AS accepted, CASE WHEN m < 0.95 THEN 'match_rate below 0.95' ELSE '' END AS reasons FROM r""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates over the dry runs of each user's lines; unmapped are eight bytes in a line of 17, so that the coverage is always met."""
    lines = kv_lines(spark, sf_dir).withColumn("source_id", F.regexp_extract("raw", " user=(u[0-9]+)", 1))
    return columns.acceptance(columns.dry_run(normalize.normalize(lines, [KV_SPEC])).withColumn("render_back", F.lit(1.0)))
