"""Queries of log normalization: framing, detection, extraction, mapping, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.functions import values as V
from loglake.operators import extract, framing, normalize
from loglake.plans.lines import KV_OK, KV_SPEC, MIXED_SPECS, events, kv_lines, mixed_lines
from loglake.plans.registry import query, table

MS = "(epoch_us(ts) // 1000)"


@query(f"""SELECT 's' || (user_id % 5) AS source_id, event_type AS action, sum(CASE WHEN {KV_OK} THEN 1 ELSE 0 END)::BIGINT AS events,
  sum(CASE WHEN {KV_OK} THEN 0 ELSE 1 END)::BIGINT AS quarantined, round(sum(CASE WHEN {KV_OK} THEN value END), 4) AS total FROM events GROUP BY ALL""")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = normalize.normalize(kv_lines(spark, sf_dir), [KV_SPEC])
    action = F.coalesce(F.col("event.ocsf.message"), F.regexp_extract("raw", 'action="([a-z]*)"', 1))
    ok = F.col("event").isNotNull()
    return parsed.groupBy("source_id", action.alias("action")).agg(F.count_if(ok).alias("events"), F.count_if(~ok).alias("quarantined"), F.round(F.sum("event.ocsf.metric_value"), 4).alias("total"))


@query(f"""SELECT event_id AS record_id, 'u' || user_id AS "user", event_type AS action, value, CASE WHEN event_id % 11 <> 0 THEN '10.0.' || (user_id % 4) || '.' || (event_id % 250) END AS ip,
  CASE WHEN event_id % 17 = 0 THEN 'open end' END AS note, event_id % 17 = 0 AS suspect, event_id % 13 = 0 AS duplicate FROM events""")
def extract_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = kv_lines(spark, sf_dir).withColumn("x", extract.kv(F.col("raw")))
    field = lambda k: F.try_element_at("x.fields", F.lit(k))
    return x.select("record_id", field("user").alias("user"), field("action").alias("action"), field("value").cast("double").alias("value"), field("ip").alias("ip"), field("note").alias("note"), F.array_contains("x.flags", "key_injection_suspect").alias("suspect"), F.array_contains("x.flags", "duplicate_key").alias("duplicate"))


@query("""SELECT 'user' AS k, 'other' AS v, count(*) AS n FROM events WHERE event_id % 13 = 0""")
def kv_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = kv_lines(spark, sf_dir).select(F.explode(extract.kv(F.col("raw"))["dupes"]).alias("d"))
    return x.groupBy(F.col("d.k").alias("k"), F.col("d.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def extracted(spark: SparkSession, sf_dir: str, spec: int, **options) -> DataFrame:
    """Lines of all formats through the first extractor of one spec, behind its signature; those that it takes."""
    chosen = MIXED_SPECS[spec]
    extractor = chosen["extractors"][0]
    found = normalize.extraction(chosen, extractor | {"options": extractor.get("options", {}) | options}, F.col("raw"))
    return mixed_lines(spark, sf_dir).withColumn("x", found).filter("x is not null")


@query(f"""SELECT event_id AS record_id, {MS} AS ts, event_type AS action, value, 'a, "' || event_id || '"' AS note, '' AS col_6, 7 AS columns FROM events WHERE event_id % 6 = 1""")
def extract_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extracted(spark, sf_dir, 1)
    field = lambda k: F.try_element_at("x.fields", F.lit(k))
    return x.select("record_id", field("ts").cast("bigint").alias("ts"), field("action").alias("action"), field("value").cast("double").alias("value"), field("note").alias("note"), field("col_6").alias("col_6"), extract.csv_columns(F.col("raw")).alias("columns"))


@query(f"""SELECT event_id AS record_id, {MS} AS ts, user_id AS user_id, event_type AS action, value, '' AS none, 't' || (event_id % 3) AS tag FROM events WHERE event_id % 6 = 2""")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extracted(spark, sf_dir, 2)
    field = lambda k: F.try_element_at("x.fields", F.lit(k))
    return x.select("record_id", field("ts").cast("bigint").alias("ts"), field("user.id").cast("bigint").alias("user_id"), field("action").alias("action"), field("value").cast("double").alias("value"), field("none").alias("none"), field("user.tags.0").alias("tag"))


@query(f"""WITH e AS (SELECT * FROM events WHERE event_id % 6 = 2)
SELECT event_id AS record_id, 'ts' AS path, CAST({MS} AS VARCHAR) AS value FROM e UNION ALL SELECT event_id, 'user.id', CAST(user_id AS VARCHAR) FROM e
UNION ALL SELECT event_id, 'user.tags.0', 't' || (event_id % 3) FROM e UNION ALL SELECT event_id, 'user.tags.1', 't' || (event_id % 5) FROM e
UNION ALL SELECT event_id, 'action', event_type FROM e UNION ALL SELECT event_id, 'none', '' FROM e UNION ALL SELECT event_id, 'value', printf('%.2f', value) FROM e UNION ALL SELECT event_id, 'props.k', json_extract_string(props, '$.k') FROM e""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.format_string("%.2f", F.col("value").try_cast("double"))
    return extract.flatten_json(mixed_lines(spark, sf_dir), "record_id", "raw").withColumn("value", F.when(F.col("path") == "value", number).otherwise(F.col("value")))


@query(f"""SELECT event_id AS record_id, 'Gate|way' AS device_product, event_type AS name, event_id % 10 AS severity, {MS} AS rt, 'user ' || user_id AS suser, 'a=b' AS msg, value FROM events WHERE event_id % 6 = 3""")
def extract_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extracted(spark, sf_dir, 3)
    field = lambda k: F.try_element_at("x.fields", F.lit(k))
    return x.select("record_id", field("cef.product").alias("device_product"), field("cef.name").alias("name"), field("cef.severity").cast("bigint").alias("severity"), field("rt").cast("bigint").alias("rt"), field("suser").alias("suser"), field("msg").alias("msg"), field("cn1").cast("double").alias("value"))


@query(f"""SELECT event_id AS record_id, event_type AS leef_event, 'u' || user_id AS "user", {MS} AS ts, 'a b' AS note, value FROM events WHERE event_id % 6 = 4""")
def extract_leef(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extracted(spark, sf_dir, 4)
    field = lambda k: F.try_element_at("x.fields", F.lit(k))
    return x.select("record_id", field("leef.event_id").alias("leef_event"), field("usrName").alias("user"), field("devTime").cast("bigint").alias("ts"), field("note").alias("note"), field("value").cast("double").alias("value"))


@query("""SELECT event_id AS record_id, 'gate' || (event_id % 4) AS host, event_id % 1000 AS pid, 'u' || user_id AS "user", event_type AS action, value FROM events WHERE event_id % 6 = 5""")
def extract_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extracted(spark, sf_dir, 5)
    field = lambda k: F.try_element_at("x.fields", F.lit(k))
    return x.select("record_id", field("host").alias("host"), field("pid").cast("bigint").alias("pid"), field("user").alias("user"), field("action").alias("action"), field("value").cast("double").alias("value"))


@query(f"""SELECT CASE event_id % 6 WHEN 0 THEN CASE WHEN {KV_OK} THEN 'app_kv' END WHEN 1 THEN 'b_csv' WHEN 2 THEN 'c_json' WHEN 3 THEN 'd_cef' WHEN 4 THEN 'e_leef' ELSE 'f_syslog' END AS parser_id,
  CASE event_id % 6 WHEN 0 THEN CASE WHEN {KV_OK} THEN 'main' END WHEN 1 THEN 'row' WHEN 2 THEN 'doc' WHEN 3 THEN 'cef' WHEN 4 THEN 'leef' ELSE CASE WHEN event_type = 'error' THEN 'errors' ELSE 'rest' END END AS extractor,
  count(*) AS n, round(sum(CASE WHEN event_id % 6 <> 0 OR {KV_OK} THEN value END), 4) AS total FROM events GROUP BY ALL""")
def dispatch_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = normalize.normalize(mixed_lines(spark, sf_dir), MIXED_SPECS)
    return parsed.groupBy("event.parser_id", "event.extractor").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("event.ocsf.metric_value"), 4).alias("total"))


@query("""SELECT event_id AS record_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS as_int, CASE WHEN (event_id * 37) % 70000 <= 65535 THEN CAST((event_id * 37) % 70000 AS INTEGER) END AS as_port,
  CASE WHEN event_id % 300 <= 255 THEN '10.0.' || (user_id % 4) || '.' || (event_id % 300) END AS as_ip, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS as_bool,
  CAST(event_id * 1000 + 500 AS BIGINT) AS as_ms, CASE event_type WHEN 'error' THEN 'bad' WHEN 'click' THEN 'ok' ELSE 'other' END AS as_enum, 'aa:bb:cc:dd:0e:0' || (event_id % 10) AS as_mac FROM events""")
def convert_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = events(spark, sf_dir).select(
        e.alias("record_id"),
        F.when(e % 3 == 0, F.concat(F.lit(" "), e.cast("string"))).otherwise(e.cast("string")).alias("i"),
        ((e * 37) % 70000).cast("string").alias("p"),
        F.format_string("::ffff:10.0.%d.%d", F.col("user_id") % 4, e % 300).alias("a"),
        F.element_at(F.array(F.lit("T"), F.lit("false"), F.lit("1"), F.lit("yes")), (e % 4 + 1).cast("int")).alias("b"),
        F.concat(e.cast("string"), F.lit(".5")).alias("d"),
        "event_type",
        F.format_string("AABB.CCDD.0E0%d", e % 10).alias("m"),
    )
    c = F.col
    return text.select("record_id", V.to_int(c("i")).alias("as_int"), V.to_port(c("p")).alias("as_port"), V.to_ip(c("a")).alias("as_ip"), V.to_bool(c("b")).alias("as_bool"), V.to_duration_ms(c("d"), "s").alias("as_ms"), V.to_enum(c("event_type"), {"error": "bad", "click": "ok"}, "other").alias("as_enum"), V.to_mac(F.regexp_replace("m", r"\.", "")).alias("as_mac"))


@query(f"""SELECT event_id AS record_id, {MS} // 1000 * 1000 AS from_s, {MS} AS from_ms, {MS} AS from_rfc3339, {MS} // 1000 * 1000 - 19800000 AS from_zone FROM events""")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis("ts")
    x = events(spark, sf_dir).select(F.col("event_id").alias("record_id"), F.floor(ms / 1000).cast("string").alias("s"), ms.cast("string").alias("ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("r"), F.date_format("ts", "yyyy/MM/dd  HH:mm:ss").alias("z"))
    c = F.col
    return x.select("record_id", V.to_time_ms(c("s"), "epoch_s").alias("from_s"), V.to_time_ms(c("ms"), "epoch_ms").alias("from_ms"), V.to_time_ms(c("r"), "rfc3339").alias("from_rfc3339"), V.to_time_ms(c("z"), "yyyy/MM/dd HH:mm:ss", "+05:30").alias("from_zone"))


@query("""WITH y AS (SELECT o_orderkey AS record_id, month(o_orderdate) = 2 AND day(o_orderdate) = 29 AS leap_day, year(o_orderdate) - CASE WHEN month(o_orderdate) > month(o_orderdate - INTERVAL 60 DAY) + 1 THEN 1 ELSE 0 END - CASE WHEN year(o_orderdate - INTERVAL 60 DAY) < year(o_orderdate) THEN 1 ELSE 0 END AS y FROM orders)
SELECT record_id, CASE WHEN NOT leap_day OR (y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)) THEN y END AS inferred_year FROM y""")
def year_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.date_format("o_orderdate", "MMM  d HH:mm:ss").alias("t"), (F.col("o_orderdate") - F.expr("INTERVAL 60 DAY")).alias("received"))
    # 29 February does not exist in the year before; such a line keeps no time
    time = V.to_time_ms(F.col("t"), "MMM d HH:mm:ss", received=F.col("received"))
    return x.select("record_id", F.year(F.timestamp_millis(time)).alias("inferred_year"))


@query(f"""SELECT event_id AS record_id, CASE WHEN event_id % 17 = 0 THEN 'note' END AS unmapped_keys, event_id % 13 = 0 AS has_dupes FROM events WHERE {KV_OK}""")
def unmapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = normalize.normalize(kv_lines(spark, sf_dir), [KV_SPEC]).filter("event is not null")
    keys = F.array_join(F.array_sort(F.map_keys("event.unmapped")), ",")
    return parsed.select("record_id", F.nullif(keys, F.lit("")).alias("unmapped_keys"), (F.size("event.dupes") > 0).alias("has_dupes"))


@query(f"""WITH e AS (SELECT event_id, CAST({MS} AS VARCHAR) AS ts, 'u' || user_id AS u, event_type AS a, '10.0.' || (user_id % 4) || '.' || (event_id % 250) AS ip, CAST((event_id * 37) % 70000 AS VARCHAR) AS port FROM events WHERE {KV_OK}),
c AS (SELECT event_id, strlen(ts) + strlen(u) + 2 * strlen(a) + strlen(ip) + strlen(port) AS mapped, CASE WHEN event_id % 17 = 0 THEN 8 ELSE 0 END AS note, 36 + CASE WHEN event_id % 13 = 0 THEN 11 ELSE 0 END + CASE WHEN event_id % 17 = 0 THEN 7 ELSE 0 END - strlen(a) AS signs FROM e)
SELECT event_id AS record_id, mapped::BIGINT AS mapped_without_value, note::BIGINT AS unmapped_bytes, signs::BIGINT AS constant_bytes, 0::BIGINT AS uncovered_bytes, 7 AS mapped_fields, CASE WHEN note > 0 THEN 1 ELSE 0 END AS unmapped_fields FROM c""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a double is the engine's own, so that the value's bytes are taken off; all others are compared."""
    parsed = normalize.normalize(kv_lines(spark, sf_dir), [KV_SPEC]).filter("event is not null")
    value = F.octet_length(F.regexp_extract("raw", r"value=(\S+)", 1))
    c = F.col("event.coverage")
    return parsed.select("record_id", (c["mapped_bytes"] - value).cast("bigint").alias("mapped_without_value"), *[c[k].cast("bigint").alias(k) for k in ("unmapped_bytes", "constant_bytes", "uncovered_bytes")], c["mapped_fields"].alias("mapped_fields"), c["unmapped_fields"].alias("unmapped_fields"))


RENDERED = [
    {"id": "auto", "version": "1", "signature": "^user=", "extractors": [{"id": "pairs", "kind": "kv", "render": "auto", "map": {"actor.user.name": {"from": "user"}}}]},
    {"id": "text", "version": "1", "signature": "^user ", "extractors": [{"id": "words", "kind": "regex", "options": {"pattern": r"^user (?P<user>\S+) did (?P<action>[a-z]+) \{(?P<value>\S+)\}$"}, "render": "user {user} did {action} {{{value}}}", "map": {"actor.user.name": {"from": "user", "lower": True}, "message": {"from": "action"}}}]},
]


@query("""SELECT event_id AS record_id, CASE WHEN event_id % 2 = 0 THEN event_id % 4 <> 0 ELSE event_id % 3 <> 0 END AS render_ok, CASE WHEN CASE WHEN event_id % 2 = 0 THEN event_id % 4 <> 0 ELSE event_id % 3 <> 0 END THEN 1.0 ELSE 0.8 END::DOUBLE AS parse_confidence FROM events""")
def render_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pairs = F.format_string('user=u%d note="%s', F.col("user_id"), F.col("event_type"))
    raw = F.when(e % 4 == 0, F.concat(pairs, F.lit('"'))).when(e % 2 == 0, F.concat(pairs, F.lit(' again"'))).otherwise(F.format_string("user %s%d did %s {%d}", F.when(e % 3 == 0, "U").otherwise("u"), F.col("user_id"), F.col("event_type"), e))
    lines = events(spark, sf_dir).select(e.alias("record_id"), raw.alias("raw"), F.col("ts").alias("received_at"))
    return normalize.normalize(lines, RENDERED).select("record_id", F.col("event.render_ok").alias("render_ok"), "parse_confidence")


@query(f"""SELECT event_id AS record_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN {MS} + 60000 ELSE {MS} END AS event_ms, event_id % 5 = 0 OR event_id % 7 = 0 AS time_from_receipt, CASE WHEN event_id % 7 = 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS parse_confidence FROM events""")
def event_time_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    time = F.when(e % 7 == 0, F.lit("soon")).when(e % 5 == 0, F.lit("0")).otherwise(F.unix_millis("ts").cast("string"))
    line = F.concat(F.lit("ts="), time, F.lit(" user=a k=b"), F.when(e % 3 == 0, " k=c").otherwise(""))  # a repeated key is flagged, and no matter of confidence
    spec = {"id": "t", "version": "1", "extractors": [{"id": "x", "kind": "kv", "map": {"time": {"from": "ts", "type": "time", "layout": "epoch_ms"}}}]}
    lines = events(spark, sf_dir).select(e.alias("record_id"), line.alias("raw"), (F.col("ts") + F.expr("INTERVAL 60 SECOND")).alias("received_at"))
    parsed = normalize.normalize(lines, [spec])
    return parsed.select("record_id", F.unix_millis("event_time").alias("event_ms"), "time_from_receipt", "parse_confidence")


BROKEN = {"id": "b_csv", "version": "1", "signature": "^[0-9]{13},", "extractors": [{"id": "row", "kind": "csv", "options": {"names": ["ts"], "quote": "'"}, "map": {}}]}


@query(f"""SELECT CASE event_id % 6 WHEN 0 THEN CASE WHEN NOT {KV_OK} THEN 'detect' WHEN event_id % 10 = 0 THEN 'normalize' ELSE 'event' END WHEN 1 THEN 'extract' ELSE 'detect' END AS stage,
  CASE event_id % 6 WHEN 0 THEN CASE WHEN NOT {KV_OK} THEN 'no parser matched' WHEN event_id % 10 = 0 THEN 'no such host' END WHEN 1 THEN 'csv quote "''" is unsupported' ELSE 'no parser matched' END AS error, count(*) AS n FROM events GROUP BY ALL""")
def failure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = normalize.normalize(mixed_lines(spark, sf_dir), [KV_SPEC, BROKEN])
    late = parsed.withColumn("enrich_error", F.when(F.col("record_id") % 10 == 0, "no such host"))
    return normalize.staged(late).groupBy(F.coalesce("failure_stage", F.lit("event")).alias("stage"), "error").agg(F.count(F.lit(1)).alias("n"))


def odd_lines(spark: SparkSession, sf_dir: str, other: dict[int, str]) -> DataFrame:
    """Lines of all formats, and others by the id modulo 12."""
    e = F.col("record_id") % 12
    return mixed_lines(spark, sf_dir).withColumn("raw", F.coalesce(*[F.when(e == k, F.lit(v)) for k, v in other.items()], F.col("raw")))


@query("""SELECT CASE event_id % 12 WHEN 0 THEN 'kv' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'cef' WHEN 4 THEN 'leef' WHEN 6 THEN 'syslog5424' WHEN 7 THEN 'syslog3164' WHEN 8 THEN 'xml' WHEN 9 THEN 'xml' WHEN 11 THEN 'json' ELSE 'unknown' END AS hint, count(*) AS n FROM events GROUP BY ALL""")
def sniff_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = {6: "<34>1 2024-01-02T03:04:05Z host app - - x", 7: "<34>12 Oct 11 22:14:15 host su: x", 8: "  <?xml version='1.0'?>", 9: "<Event x='1'>", 10: "<5 is less than a=1 b=2", 11: "  [1, 2]"}
    return odd_lines(spark, sf_dir, other).groupBy(V.sniff(F.col("raw")).alias("hint")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE event_id % 12 WHEN 0 THEN 'kv' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'cef' WHEN 4 THEN 'leef' WHEN 10 THEN 'kv' WHEN 11 THEN 'leef' ELSE 'text' END AS kind, count(*) AS n FROM events GROUP BY ALL""")
def line_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = {6: "CEF:x|no version", 7: "far " * 50 + "CEF:0|a", 8: '{"broken": ', 9: "a=1 b=2 c=3", 10: '  a=1 b="2 3" c=4 d=', 11: "x LEEF:2.0|a"}
    return odd_lines(spark, sf_dir, other).groupBy(V.line_kind(F.col("raw")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(strlen(t) AS BIGINT) + 2 AS bytes, CAST(len(regexp_extract_all(t, '[\x00-\x1f\x7f]')) AS BIGINT) AS control, CAST(strlen(t) - (length(t) - len(regexp_extract_all(t, '[^\x00-\x7f]'))) AS BIGINT) AS multibyte, CAST(2 AS BIGINT) AS invalid FROM b""")
def byte_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.unhex(F.lit("FFC3")))  # two bytes that are no text
    x = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).withColumn("p", V.byte_profile(F.col("raw")))
    return x.select("doc_id", F.octet_length("raw").cast("bigint").alias("bytes"), F.col("p.control").cast("bigint").alias("control"), F.col("p.multibyte").cast("bigint").alias("multibyte"), F.col("p.invalid").cast("bigint").alias("invalid"))


@query(f"""SELECT CASE WHEN event_id % 11 = 0 THEN 'missing_required:src_endpoint.ip,missing_required:dst_endpoint.ip' ELSE 'missing_required:dst_endpoint.ip' END AS flags, count(*) AS n FROM events GROUP BY ALL""")
def required_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = kv_lines(spark, sf_dir).withColumn("x", extract.kv(F.col("raw")))
    paths = {"src_endpoint.ip": "ip", "dst_endpoint.ip": "dst", "time": "ts"}
    flags = F.array_compact(F.array(*[F.when(F.try_element_at("x.fields", F.lit(k)).isNull(), f"missing_required:{p}") for p, k in paths.items()]))
    return x.groupBy(F.array_join(flags, ",").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '(?=x)' || p_name WHEN 1 THEN '(a)\1' || p_name WHEN 2 THEN '(?P<n>' || p_name || ')' WHEN 3 THEN '(?<!b)' || p_name ELSE '^' || p_name || '$' END AS pattern FROM part)
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 1 THEN 'backreference' ELSE 'lookaround' END AS violation FROM p WHERE p_partkey % 5 IN (0, 1, 3)""")
def spec_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    pattern = F.when(k == 0, F.concat(F.lit("(?=x)"), "p_name")).when(k == 1, F.concat(F.lit("(a)\\1"), "p_name")).when(k == 2, F.concat(F.lit("(?P<n>"), "p_name", F.lit(")"))).when(k == 3, F.concat(F.lit("(?<!b)"), "p_name")).otherwise(F.concat(F.lit("^"), "p_name", F.lit("$")))
    return framing.lint_patterns(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pattern.alias("pattern")), "id", "pattern")


@query("""SELECT CASE event_id % 12 WHEN 0 THEN 'ip' WHEN 1 THEN 'uuid' WHEN 2 THEN 'timestamp' WHEN 3 THEN 'epoch' WHEN 4 THEN 'int' WHEN 5 THEN 'word' WHEN 6 THEN 'timestamp' WHEN 7 THEN 'epoch' WHEN 8 THEN 'other' WHEN 9 THEN 'qstr' WHEN 10 THEN 'hex' ELSE 'ip' END AS shape, count(*) AS n FROM events GROUP BY ALL""")
def value_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    every = [
        F.format_string("10.1.%d.%d", e % 256, e % 200), F.regexp_replace(F.md5(e.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.unix_millis("ts").cast("string"), (e % 1000).cast("string"), F.col("event_type"),
        F.date_format("ts", "yyyy/MM/dd"), F.format_string("27%08d", e), F.format_string("+%d", e), F.col("event_type"), F.format_string("0x%x", e), F.format_string("300.1.2.%d", e % 1000),
    ]
    x = F.coalesce(*[F.when(e % 12 == k, v) for k, v in enumerate(every)])
    return events(spark, sf_dir).groupBy(V.shape(x, e % 12 == 9).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id AS record_id, 'u' || user_id AS user_name, '10.0.' || (user_id % 4) || '.' || (event_id % 250) AS src_ip, CAST((event_id * 37) % 70000 AS INTEGER) AS src_port, 0 AS dst_port, '' AS protocol, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 ELSE 1 END::BIGINT AS severity FROM events WHERE {KV_OK}""")
def siem_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events_ = normalize.normalize(kv_lines(spark, sf_dir), [KV_SPEC]).filter("event is not null")
    return events_.select("record_id", *normalize.siem(F.col("event")))


@query("""SELECT 's' || (user_id % 5) AS source_id, CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'file' END AS kind, count(*) AS records, CAST(sum(strlen(props)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fragments FROM events GROUP BY ALL""")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(F.concat(F.lit("s"), F.col("user_id") % 5).alias("source_id"), F.when(e % 2 == 0, "tcp").otherwise("file").alias("kind"), F.col("props").cast("binary").alias("raw"), F.when(e % 9 == 0, 1).otherwise(0).alias("frag"))
    return framing.ingest_counters(rows)


@query("""SELECT c_custkey AS id, c_name AS source_id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 <> 0""")
def admit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.regexp_replace("c_name", "#", "-")
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, F.concat(name, F.lit(" x"))).otherwise(name).alias("source_id"))
    allowed = c.filter("c_custkey % 3 = 0").select(name.alias("source_id"))
    return framing.admit(rows, allowed).select("id", F.regexp_replace("source_id", "-", "#").alias("source_id"))


@query("""SELECT addr, "offset", min(record_id) AS record_id FROM (SELECT 'f' || (l_suppkey % 10) AS addr, l_orderkey AS "offset", l_orderkey * 10 + l_linenumber AS record_id FROM lineitem) GROUP BY ALL""")
def dedup_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey") % 10).alias("addr"), F.col("l_orderkey").alias("offset"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"))
    return rows.groupBy("addr", "offset").agg(F.min("record_id").alias("record_id"))


PREFIXES = [("10.0.0.0/8", "corp"), ("10.1.0.0/16", "branch"), ("10.1.2.9/24", "lab"), ("192.168.0.0/16", "home"), ("fd00::/8", "inside"), ("fd00:1:2::/48", "rack"), ("fd00:1:2:3::/65", "half")]


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 8 = 7 THEN 'rack' WHEN c_custkey % 8 = 6 THEN CASE WHEN c_custkey % 3 = 0 THEN 'half' ELSE 'rack' END WHEN c_custkey % 8 = 5 THEN 'inside' WHEN c_custkey % 4 = 3 THEN 'listener' WHEN c_custkey % 4 = 2 THEN 'home' WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 2 THEN 'lab' WHEN c_custkey % 3 = 1 THEN 'branch' ELSE 'corp' END AS source_id FROM customer""")
def peer_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    six = F.when(k % 8 == 7, F.lit("[FD00:1:2::7]:514")).when(k % 8 == 6, F.when(k % 3 == 0, F.lit("fd00:1:2:3:7fff::1")).otherwise(F.lit("[fd00:1:2:3:8000::1]:6514"))).when(k % 8 == 5, F.format_string("fd00:%x::1", k % 60000 + 2))
    four = F.when(k % 4 == 3, F.lit("172.16.0.9:514")).when(k % 4 == 2, F.format_string("::ffff:192.168.%d.1", k % 200)).otherwise(F.format_string("10.%d.%d.7:%d", k % 3, k % 5, k % 60000 + 1))
    peers = table(spark, sf_dir, "customer").select(k.alias("id"), F.coalesce(six, four).alias("peer"))
    return framing.peer_source(peers, PREFIXES, "listener").select("id", "source_id")


@query("""WITH d AS (SELECT doc_id, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, n, unnest(range(0, greatest(1, (n + 999) // 1000))) AS part FROM d)
SELECT doc_id, part, CAST(least(1000, n - part * 1000) AS BIGINT) AS bytes, part * 1000 AS "offset", CAST((CASE WHEN (part + 1) * 1000 < n THEN 1 ELSE 0 END) + (CASE WHEN part > 0 THEN 2 ELSE 0 END) AS INTEGER) AS frag FROM f""")
def fragment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("raw"))
    x = framing.fragments(docs, "doc_id", 1000)
    return x.select("doc_id", "part", F.octet_length("raw").cast("bigint").alias("bytes"), "offset", "frag")


@query("""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha FROM documents WHERE text IS NOT NULL""")
def reassemble_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("raw"))
    whole = framing.reassemble(framing.fragments(docs, "doc_id", 1000), "doc_id")
    return whole.select("doc_id", F.octet_length("raw").cast("bigint").alias("bytes"), F.sha2("raw", 256).alias("sha"))


@query("""WITH l AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS pos, l_returnflag = 'A' AS start, coalesce(l_returnflag || ' line', '') AS raw FROM lineitem),
g AS (SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS grp FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY file, grp ORDER BY pos) AS k FROM g),
r AS (SELECT file, pos, raw, CASE WHEN grp = 0 OR k > 3 THEN pos ELSE min(pos) OVER (PARTITION BY file, grp) END AS first_pos FROM n)
SELECT file, first_pos, count(*) AS lines, string_agg(raw, chr(10) ORDER BY pos) AS raw FROM r GROUP BY ALL""")
def multiline_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "file")
    place = F.row_number().over(Window.partitionBy("file").orderBy(*along)).cast("bigint")
    lines = rows.select("file", *along, place.alias("pos"), F.concat("l_returnflag", F.lit(" line")).alias("raw"))
    x = framing.multiline(lines, "file", "pos", "^A ", max_lines=3, by=along)
    return x.select("file", F.col("pos").alias("first_pos"), "lines", "raw")
