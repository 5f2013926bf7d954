"""Queries of parser proposals, over lines rendered from ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.operators import columns, normalize, propose, texts
from loglake.plans.lines import KV_OK, KV_SPEC, events, kv_lines
from loglake.plans.registry import query
from loglake.plans.unknown import FIELDS, S, wide


def told() -> Column:
    """A map as text: source, path, type and what else an entry has."""
    part = lambda k: lambda m: F.when(F.coalesce(m[k], F.lit("")) != "", F.concat(F.lit(f"{k}="), m[k]))
    return F.array_join(F.transform("map", lambda m: F.concat_ws(" ", F.concat(m["from"], F.lit("->"), m["to"]), m["type"], part("layout")(m), part("enum")(m), part("default")(m))), "; ").alias("map")


def rows(spark: SparkSession, sf_dir: str, raw) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("record_id"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("source_id"), raw.alias("raw"), F.col("ts").alias("received_at"))


CSV_MAP = "col_1->time time layout=yyyy-MM-dd HH:mm:ss; col_3->src_endpoint.ip ip; col_4->dst_endpoint.ip ip; col_5->src_endpoint.port port; col_6->dst_endpoint.port port; col_7->connection_info.protocol_name lower; col_7->connection_info.protocol_num enum enum=tcp=6,udp=17 default=0; col_8->action_id enum enum=allow=1,deny=2 default=99; ->activity_id const default=6; ->severity_id const default=1"


@query(f"""SELECT {S}, count(*) AS lines, 10::BIGINT AS min_columns, '_,col_1,_,col_3,col_4,col_5,col_6,col_7,col_8' AS columns, 'TRAFFIC' AS marker, '^(?:[^,]*,){{2}}TRAFFIC,' AS signature, '{CSV_MAP}' AS map FROM events GROUP BY 1""")
def propose_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    raw = F.concat_ws(",", F.format_string("r%d x", e), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("TRAFFIC"), F.format_string("10.0.%d.%d", u % 4, e % 200), F.format_string("93.184.0.%d", e % 50), (e % 30000 + 20000).cast("string"), F.when(e % 2 == 0, "443").otherwise("53"), F.when(e % 2 == 0, "tcp").otherwise("udp"), F.when(e % 3 == 0, "deny").otherwise("allow"), F.lit('"note, quoted"'), F.when(e % 5 == 0, "extra"))
    out = propose.propose_csv(rows(spark, sf_dir, raw))
    return out.select("source_id", "lines", F.col("min_columns").cast("bigint").alias("min_columns"), F.array_join("columns", ",").alias("columns"), "marker", "signature", told())


def pair_line():
    e, u = F.col("event_id"), F.col("user_id")
    return F.concat(
        F.date_format("ts", "'date='yyyy-MM-dd' time='HH:mm:ss"), F.format_string(' type="traffic" src=10.0.%d.%d dst=93.184.0.%d sport=%d dport=', u % 4, e % 200, e % 50, e % 30000 + 20000), F.when(e % 2 == 0, "443").otherwise("53"),
        F.format_string(" user=corp\\u%d", u), F.when(e % 2 == 0, " level=high").otherwise(" level=low"), F.when(e % 7 == 0, " rare=1").otherwise(""),
    )


KV_MAP = "date+time->time time layout=yyyy-MM-dd HH:mm:ss; src->src_endpoint.ip ip; dst->dst_endpoint.ip ip; sport->src_endpoint.port port; dport->dst_endpoint.port port; user->actor.user.name string; level->severity_id enum enum=high=4,low=2 default=99; ->activity_id const default=6"


@query(rf"""SELECT {S}, count(*) AS lines, '\btype="?traffic"?(?: |$)' AS signature, '{KV_MAP}' AS map FROM events GROUP BY 1""")
def propose_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propose.propose_kv(rows(spark, sf_dir, pair_line())).select("source_id", "lines", "signature", told())


@query(f"""SELECT source_id, change, old, new, path AS "to" FROM (SELECT DISTINCT {S} FROM events), (VALUES ('kept', 'date+time', 'date+time', 'time'), ('moved', 'srcip', 'src', 'src_endpoint.ip'), ('moved', 'srcport', 'sport', 'src_endpoint.port'), ('dropped', 'devname', NULL, 'device.hostname'), ('kept', 'user', 'user', 'actor.user.name'), ('added', NULL, 'dst', 'dst_endpoint.ip'), ('added', NULL, 'dport', 'dst_endpoint.port')) v(change, old, new, path)""")
def propose_kv_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rows(spark, sf_dir, pair_line())
    known = F.array(*[F.struct(F.array(*[F.lit(k) for k in keys]).alias("from"), F.lit(to).alias("to")) for keys, to in [(["date", "time"], "time"), (["srcip"], "src_endpoint.ip"), (["srcport"], "src_endpoint.port"), (["devname"], "device.hostname"), (["user"], "actor.user.name")]])
    mapping = lines.select("source_id").distinct().select("source_id", F.inline(known))
    return propose.propose_kv_patch(lines, mapping)


@query(f"""WITH g AS (SELECT {S}, event_type AS value, count(*) AS lines FROM events GROUP BY ALL HAVING count(*) >= 50)
SELECT source_id, 'event_type' AS route, value, lines, 'src_ip->src_endpoint.ip ip; ' || 'time->time time layout=epoch_ms; ' || '->activity_id const default=6; ->severity_id const default=1' AS map FROM g""")
def propose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    raw = F.concat(F.format_string('{"event_type":"%s","time":%d,"src_ip":"10.0.%d.%d"', F.col("event_type"), F.unix_millis("ts"), u % 4, e % 200), F.when(e % 9 == 0, ',"rare":true').otherwise(""), F.format_string(',"n":{"text":"%d of"}}', e))
    return propose.propose_json(rows(spark, sf_dir, raw)).select("source_id", "route", "value", "lines", told())


CEF_MAP = "src->src_endpoint.ip ip; spt->src_endpoint.port port; act->action_id enum enum=allow=1,deny=2 default=99; rt->time time layout=epoch_ms; cef.severity->severity_id enum enum=0=2,3=2,6=3,9=5 default=99; cef.name->message string; ->activity_id const default=6"


@query(rf"""SELECT {S}, count(*) AS lines, 'CEF:\d+\|Acme\|Gate\|' AS signature, '{CEF_MAP}' AS map, 'dst' AS unfit FROM events GROUP BY 1""")
def propose_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.format_string("CEF:0|Acme|Gate|1.0|%d|%s|%d|src=10.0.0.%d dst=host%d spt=%d act=%s rt=%d", e % 7, F.col("event_type"), e % 4 * 3, e % 200, e % 9, e % 30000 + 20000, F.when(e % 3 == 0, "deny").otherwise("allow"), F.unix_millis("ts"))
    return propose.propose_cef(rows(spark, sf_dir, raw)).select("source_id", "lines", "signature", told(), F.array_join("unfit", ",").alias("unfit"))


@query(f"""WITH g AS (SELECT {S}, event_id % 2 AS form, count(*) AS lines FROM events GROUP BY ALL HAVING count(*) >= 50)
SELECT source_id, form, position, kind, literal, type, path, lines FROM g, (VALUES (0, 0, 'slot', NULL, 'timestamp', 'time'), (0, 2, 'literal', 'gate', NULL, NULL), (0, 3, 'literal', ':', NULL, NULL), (0, 5, 'literal', 'Built', NULL, NULL), (0, 7, 'slot', NULL, 'ipv4', 'src_endpoint.ip'), (0, 8, 'literal', '/', NULL, NULL), (0, 9, 'slot', NULL, 'port', 'src_endpoint.port'),
  (1, 0, 'slot', NULL, 'timestamp', 'time'), (1, 2, 'literal', 'gate', NULL, NULL), (1, 3, 'literal', ':', NULL, NULL), (1, 5, 'literal', 'user', NULL, NULL), (1, 7, 'slot', NULL, 'string', ''), (1, 9, 'literal', 'left', NULL, NULL)) v(f, position, kind, literal, type, path) WHERE f = form""")
def template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" gate: "))
    raw = F.when(e % 2 == 0, F.concat(head, F.format_string("Built 10.0.0.%d/%d", e % 200, e % 30000 + 20000))).otherwise(F.concat(head, F.format_string("user u%d left", F.col("user_id"))))
    out = propose.template_slots(rows(spark, sf_dir, raw))
    form = F.when(F.col("template").contains("/"), 0).otherwise(1)
    return out.filter("literal is null or literal != ' '").select("source_id", form.cast("bigint").alias("form"), "position", "kind", "literal", "type", "path", "lines")


@query(f"""WITH e AS (SELECT {S}, * FROM events), v AS (SELECT DISTINCT source_id, CAST(event_id + 70000 AS VARCHAR) AS v FROM e WHERE event_id % 3 <> 0), w AS (SELECT DISTINCT source_id, event_id || ' % of' AS v FROM e)
SELECT source_id, 'c8_n' AS field, array_to_string(list_sort(list(v))[1:5], '|') AS samples FROM v GROUP BY 1 UNION ALL SELECT source_id, 'c16_text', array_to_string(list_sort(list(v))[1:5], '|') FROM w GROUP BY 1""")
def anonymous_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = [f for f in FIELDS if f not in ("c8_n", "c15_none", "c16_text")]
    long = columns.long_form(wide(spark, sf_dir).drop("record_id"), FIELDS)
    return propose.anonymous_columns(long, used).select("source_id", "field", F.array_join("samples", "|").alias("samples"))


@query(f"""WITH r AS (SELECT 's' || (user_id % 5) AS source_id, event_id AS record_id, event_type, user_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events WHERE {KV_OK}) SELECT source_id, record_id, 'u' || user_id AS "user", event_type AS message FROM r WHERE n <= 5""")
def parser_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = propose.vectors(normalize.normalize(kv_lines(spark, sf_dir), [KV_SPEC]))
    return found.select("source_id", "record_id", F.get_json_object("expect", "$.actor_user_name").alias("user"), F.get_json_object("expect", "$.message").alias("message"))


@query(f"""WITH r AS (SELECT 's' || (user_id % 5) AS source_id, event_id AS record_id, event_type, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events WHERE {KV_OK}) SELECT source_id, record_id, event_type NOT IN ('error', 'purchase') AS same FROM r WHERE n <= 5""")
def vector_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = propose.vectors(normalize.normalize(kv_lines(spark, sf_dir), [KV_SPEC]))
    main = KV_SPEC["extractors"][0]
    other = KV_SPEC | {"version": "1.0.1", "extractors": [main | {"map": main["map"] | {"severity_id": {"from": "action", "type": "enum", "values": {}, "default": "1"}}}]}
    lines = found.withColumn("received_at", F.lit(0).cast("timestamp"))
    return propose.replay_vectors(lines, lambda x: normalize.normalize(x, [other])).select("source_id", "record_id", "same")


TIME_GROUP = r"(?P<ts>\d{4}-\d\d-\d\d[ T][\d:.]+(?:Z|[+-]\d\d:?\d\d)?)"
IP_GROUP = r"(?P<%s>\d{1,3}(?:\.\d{1,3}){3})"
TEXT_PATTERN = rf"^{TIME_GROUP} gate: (?P<v5>[\w.]+) inbound TCP from {IP_GROUP % 'src_ip'}/(?P<src_port>\d+) to {IP_GROUP % 'dst_ip'}/443$"
TEXT_MAP = "ts->time time layout=yyyy-MM-dd HH:mm:ss; src_ip->src_endpoint.ip ip; src_port->src_endpoint.port port; dst_ip->dst_endpoint.ip ip; ->dst_endpoint.port const default=443; ->connection_info.protocol_num const default=6; ->connection_info.protocol_name const default=tcp; ->activity_id const default=6; ->severity_id const default=1"


@query(f"""WITH g AS (SELECT {S}, count(*) AS lines FROM events GROUP BY ALL HAVING count(*) >= 50)
SELECT source_id, 'tpl_1' AS extractor, lines, '{TEXT_PATTERN}' AS pattern, '{{ts}} gate: {{v5}} inbound TCP from {{src_ip}}/{{src_port}} to {{dst_ip}}/443' AS render, '{TEXT_MAP}' AS map, NULL::VARCHAR AS confirm, ' inbound TCP from ' AS signature FROM g""")
def propose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.format_string(" gate: c%d inbound TCP from 93.184.0.%d/%d to 10.0.0.%d/443", e % 7000, e % 50, e % 30000 + 20000, e % 200))
    return texts.propose_text(rows(spark, sf_dir, raw)).select("source_id", "extractor", "lines", "pattern", "render", told(), "confirm", "signature")
