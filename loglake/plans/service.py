"""Queries of versions, quarantine, event pages, drift and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions import values
from loglake.operators import drift, normalize, serve
from loglake.plans.lines import KV_OK, KV_SPEC, events, kv_lines, mixed_lines
from loglake.plans.registry import query, table
from loglake.sources import exports


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    stage = F.element_at(F.array(F.lit("detect"), F.lit("extract"), F.lit("normalize")), (e % 3 + 1).cast("int"))
    status = F.when(e % 7 == 0, "ignored").when(e % 5 == 0, "resolved").otherwise("open")
    return events(spark, sf_dir).filter("event_type in ('error', 'click')").select(e.alias("record_id"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("source_id"), stage.alias("failure_stage"), status.alias("status"))


Q = "SELECT event_id AS record_id, 's' || (user_id % 5) AS source_id, ['detect', 'extract', 'normalize'][event_id % 3 + 1] AS failure_stage, CASE WHEN event_id % 7 = 0 THEN 'ignored' WHEN event_id % 5 = 0 THEN 'resolved' ELSE 'open' END AS status FROM events WHERE event_type IN ('error', 'click')"


@query("""WITH e AS (SELECT l_orderkey || '.p@' || l_linenumber AS event_id, l_orderkey AS record_id, min(l_partkey) AS arrival FROM lineitem GROUP BY 1, 2), l AS (SELECT record_id, max((arrival, event_id)) AS m FROM e GROUP BY 1)
SELECT e.event_id, e.record_id, (e.arrival, e.event_id) = l.m AS is_current FROM e JOIN l ON e.record_id = l.record_id""")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("", F.col("l_orderkey"), F.lit(".p@"), F.col("l_linenumber")).alias("event_id"), F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("arrival"))
    return serve.current_versions(rows).select("event_id", "record_id", "is_current")


@query(f"""SELECT count(*) AS processed, CAST(sum(CASE WHEN (event_id * 37) % 70000 <= 65535 THEN 1 ELSE 0 END) AS BIGINT) AS succeeded FROM events WHERE NOT {KV_OK}""")
def replay_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = kv_lines(spark, sf_dir)
    _, rest = normalize.split(normalize.normalize(lines, [KV_SPEC]))
    main = KV_SPEC["extractors"][0]
    looser = KV_SPEC | {"version": "1.0.1", "extractors": [main | {"map": main["map"] | {"src_endpoint.ip": {"from": "ip", "type": "ip", "optional": True}}}]}
    again = serve.replay(lines, rest.select("record_id", "status"), lambda x: normalize.normalize(x, [looser]))
    return again.agg(F.count(F.lit(1)).alias("processed"), F.count("event").alias("succeeded"))


@query(f"""WITH q AS ({Q}) SELECT record_id, CASE WHEN status = 'open' AND record_id % 4 = 1 THEN 'resolved' ELSE status END AS status, CASE WHEN status = 'open' AND record_id % 4 = 1 THEN record_id || '.p@2' END AS resolved_by FROM q""")
def quarantine_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = events(spark, sf_dir).filter("event_id % 4 = 1").select(F.col("event_id").alias("record_id"), F.concat(F.col("event_id").cast("string"), F.lit(".p@2")).alias("event_id"))
    return serve.resolve_quarantine(quarantine(spark, sf_dir), parsed).select("record_id", "status", "resolved_by")


@query(f"""WITH q AS ({Q}) SELECT source_id, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'ignored') AS ignored, count(*) FILTER (status = 'open' AND failure_stage = 'detect') AS open_detect,
  count(*) FILTER (status = 'open' AND failure_stage = 'extract') AS open_extract, count(*) FILTER (status = 'open' AND failure_stage = 'normalize') AS open_normalize FROM q GROUP BY 1""")
def quarantine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.quarantine_summary(quarantine(spark, sf_dir))


@query(f"""WITH q AS ({Q}) SELECT record_id, failure_stage FROM q WHERE source_id = 's1' AND status = 'open' ORDER BY record_id LIMIT 500""")
def quarantine_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine(spark, sf_dir).filter("source_id = 's1' and status = 'open'").orderBy("record_id").limit(500).select("record_id", "failure_stage")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("o_orderstatus") == "O", "approve").when(F.col("o_orderstatus") == "F", "rollback").otherwise("reject")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("spec"), F.col("o_custkey") % 50).alias("spec_id"), action.alias("action"), F.col("o_orderdate").alias("changed_at"), F.concat_ws(".", F.lit("1"), F.lit("0"), (F.col("o_orderkey") % 20).cast("string")).alias("to_version"))


H = "SELECT o_orderkey AS seq, 'spec' || (o_custkey % 50) AS spec_id, CASE o_orderstatus WHEN 'O' THEN 'approve' WHEN 'F' THEN 'rollback' ELSE 'reject' END AS action, o_orderdate AS changed_at, '1.0.' || (o_orderkey % 20) AS to_version FROM orders"


@query(f"WITH h AS ({H}) SELECT spec_id, max_by(to_version, (changed_at, seq)) AS version FROM h WHERE action <> 'reject' GROUP BY 1")
def active_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.active_specs(history(spark, sf_dir))


@query(f"WITH h AS ({H}) SELECT spec_id, array_to_string(list_sort(list(DISTINCT lpad(split_part(to_version, '.', 3), 3, '0'))), ',') AS versions FROM h GROUP BY 1")
def spec_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.transform(F.collect_set("to_version"), lambda v: F.struct(serve.version_key(v).alias("k"), v.alias("v"))))
    rows = history(spark, sf_dir).groupBy("spec_id").agg(ordered.alias("o"))
    return rows.select("spec_id", F.array_join(F.transform("o", lambda x: F.lpad(F.substring_index(x["v"], ".", -1), 3, "0")), ",").alias("versions"))


@query(f"WITH h AS ({H}) SELECT spec_id, to_version, count(*) FILTER (action = 'approve') AS approvals, count(*) FILTER (action = 'reject') AS rejections, epoch_us(max(changed_at)) AS last_change FROM h GROUP BY 1, 2")
def approval_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    versions = h.select("spec_id", "to_version").distinct()
    joined = versions.join(h, ["spec_id", "to_version"], "left")
    return joined.groupBy("spec_id", "to_version").agg(F.count_if(F.col("action") == "approve").alias("approvals"), F.count_if(F.col("action") == "reject").alias("rejections"), F.unix_micros(F.max("changed_at")).alias("last_change"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with versions, from ``lineitem``: a record is an order, a version one of its lines."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id"), F.concat_ws(".", F.col("l_orderkey"), F.col("l_linenumber")).alias("event_id")).agg(F.min("l_returnflag").alias("parser_id"), F.min("l_shipdate").alias("received_at"), F.concat(F.lit("s"), F.min("l_suppkey") % 3).alias("source_id"), F.min("l_linenumber").alias("line"))
    last = rows.groupBy("record_id").agg(F.max("line").alias("_l"))
    return rows.join(last, "record_id").withColumn("is_current", F.col("line") == F.col("_l")).drop("_l")


VERSIONS = "v AS (SELECT l_orderkey AS record_id, l_orderkey || '.' || l_linenumber AS event_id, min(l_returnflag) AS parser_id, min(l_shipdate) AS received_at, 's' || (min(l_suppkey) % 3) AS source_id, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2), x AS (SELECT *, line = max(line) OVER (PARTITION BY record_id) AS is_current FROM v)"
SINCE, UNTIL = "1993-01-01 00:00:00", "1998-01-01 00:00:00"


@query(f"""WITH {VERSIONS}, p AS (SELECT *, row_number() OVER (ORDER BY record_id DESC, event_id DESC) AS n, count(*) OVER () AS total FROM x WHERE source_id = 's1' AND parser_id = 'N' AND is_current AND received_at >= TIMESTAMP '{SINCE}' AND received_at <= TIMESTAMP '{UNTIL}')
SELECT record_id, event_id, CASE WHEN n = 50 AND total > 50 THEN event_id END AS next_cursor FROM p WHERE n <= 50""")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = [F.lit(t).cast("timestamp") for t in (SINCE, UNTIL)]
    page = serve.event_page(versions(spark, sf_dir), 50, source="s1", parser="N", current=True, received_from=span[0], received_to=span[1])
    return page.select("record_id", "event_id", "next_cursor")


@query(f"""WITH {VERSIONS}, o AS (SELECT record_id, event_id, row_number() OVER (ORDER BY record_id DESC, event_id DESC) AS n, count(*) OVER () AS total FROM x) SELECT record_id, event_id, CASE WHEN n = 240 AND total > 240 THEN event_id END AS next_cursor FROM o WHERE n > 120 AND n <= 240""")
def event_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions(spark, sf_dir)
    last = serve.event_page(rows, 120).filter("next_cursor is not null").first()  # the page before gives the cursor
    page = serve.event_page(rows, 120, (last["record_id"], last["next_cursor"])) if last else serve.event_page(rows.limit(0), 120)
    return page.select("record_id", "event_id", "next_cursor")


@query("SELECT event_id AS seq, event_type AS kind FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_id > 700) WHERE n <= 100")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.tail_since(events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind")), 700)


@query(f"WITH {VERSIONS} SELECT count(*) AS events, coalesce(max(record_id), 0) AS max_record_id FROM x")
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.event_totals(versions(spark, sf_dir))


@query(f"WITH {VERSIONS} SELECT record_id, event_id FROM x WHERE is_current AND record_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def current_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("record_id"))
    return serve.current_event(versions(spark, sf_dir), asked).select("record_id", "event_id")


@query("""WITH a AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'conflict' ELSE 'approve' END WHEN 'F' THEN 'reject' ELSE 'comment' END AS action FROM orders),
l AS (SELECT id, max_by(action, seq) FILTER (action IN ('approve', 'conflict')) AS last, count(*) FILTER (action = 'reject') AS no FROM a GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN last = 'approve' THEN 'approved' WHEN last = 'conflict' THEN 'stale' WHEN no > 0 THEN 'rejected' ELSE 'pending' END AS status FROM customer LEFT JOIN l ON l.id = c_custkey""")
def proposal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    action = F.when(status == "O", F.when(key % 3 == 0, "conflict").otherwise("approve")).when(status == "F", "reject").otherwise("comment")
    actions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), key.alias("seq"), action.alias("action"))
    return serve.proposal_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), actions)


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    entity = lambda kind, name: F.struct(F.lit(kind).alias("type"), name.alias("id"))
    return events(spark, sf_dir).select(
        e.alias("record_id"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("source_id"), F.format_string("10.0.0.%d", e % 20).alias("src_ip"), F.format_string("10.0.0.%d", F.col("user_id") % 30).alias("dst_ip"),
        (e % 6).alias("severity"), F.when(e % 13 == 0, F.array(F.lit("duplicate_key"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.col("ts").alias("event_time"), F.concat(F.lit("v"), e % 2).alias("vendor"), F.when(e % 4 != 3, e % 3).alias("action_id"),
        F.array_compact(F.array(F.when(e % 3 != 0, entity("user", F.concat(F.lit("u"), F.col("user_id") % 4))), F.when(e % 5 != 0, entity("host", F.concat(F.lit("h"), F.col("user_id") % 4))))).alias("entities"), (e % 10 != 0).alias("is_current"),
    )


@query("""SELECT event_id AS record_id, 'either' AS asked FROM events WHERE (event_id % 20 = 7 OR user_id % 30 = 7) AND user_id % 5 = 2 AND event_id % 6 IN (1, 3, 5) AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
UNION ALL SELECT event_id, 'source' FROM events WHERE event_id % 20 = 4 AND event_id % 2 = 0 AND event_id % 4 <> 3 AND event_id % 3 = 1 AND event_id % 10 <> 0 AND user_id % 4 = 1
UNION ALL SELECT event_id, 'destination' FROM events WHERE user_id % 30 = 8 AND event_id % 5 <> 0 AND user_id % 4 = 0 UNION ALL SELECT event_id, 'flag' FROM events WHERE event_id % 13 = 0 AND event_id % 2 = 1""")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = [F.lit(t).cast("timestamp") for t in ("2024-01-05 00:00:00", "2024-01-25 00:00:00")]
    asked = {
        "either": serve.event_filter(ip="10.0.0.7", source="s2", severity=[1, 3, 5], since=span[0], until=span[1]), "source": serve.event_filter(src_ip="10.0.0.4", vendor="v0", action=1, user="u1", current=True),
        "destination": serve.event_filter(dst_ip="10.0.0.8", host="h0"), "flag": serve.event_filter(flag="duplicate_key", vendor="v1"),
    }
    which = F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in asked.items()])))
    return flat_events(spark, sf_dir).select("record_id", which.alias("asked"))


@query(f"""WITH q AS ({Q}) SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM q WHERE status = 'open') AS open_quarantine, (SELECT coalesce(max(event_id) + 1, 0) FROM events WHERE event_id // 1000 IN (SELECT event_id // 1000 FROM events GROUP BY 1 HAVING count(*) = 1000)) AS sealed_through""")
def telemetry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 1000).alias("segment")).agg(F.count(F.lit(1)).alias("n"), (F.max("event_id") + 1).alias("last_seq")).filter("n = 1000")
    return serve.telemetry_totals(flat_events(spark, sf_dir), quarantine(spark, sf_dir), full)


@query("SELECT 's' || (user_id % 5) AS source_id, count(*) AS events, round(count(*) * 1e6 / (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events), 9) AS per_second FROM events GROUP BY 1")
def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.telemetry(flat_events(spark, sf_dir)).withColumn("per_second", F.round("per_second", 9))


@query("SELECT source_id, record_id FROM (SELECT 's' || (user_id % 5) AS source_id, event_id AS record_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS k FROM events WHERE event_type = 'error') WHERE k <= 20")
def source_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_type = 'error'").select(F.concat(F.lit("s"), F.col("user_id") % 5).alias("source_id"), F.col("event_id").alias("record_id"))
    return serve.samples(rows, 20)


@query("SELECT min(o_orderkey) AS seq FROM orders GROUP BY o_custkey % 100, o_orderpriority")
def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 100).alias("source_id"), F.col("o_orderpriority").alias("parser_id"), (F.col("o_orderstatus") == "F").alias("resolved"))
    return serve.first_alerts(alerts).select("seq")


@query(f"""WITH q AS ({Q}), s AS (SELECT source_id, failure_stage, count(*) AS n FROM q WHERE status = 'open' GROUP BY 1, 2)
SELECT 1 AS rank, 'proposal' AS kind, CAST(s_suppkey AS VARCHAR) AS key, NULL AS stage FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 2, 'alert', CAST(n_nationkey AS VARCHAR), NULL FROM nation
UNION ALL SELECT 3, 'quarantine', source_id, stage FROM (SELECT source_id, failure_stage AS stage, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, failure_stage) AS k FROM s) WHERE k = 1""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "pending").otherwise("approved").alias("status"))
    alerts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return serve.review_queue(proposals, alerts, quarantine(spark, sf_dir))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A source's lines before and after a change: later lines call ``user`` by another name, drop the quotes and give the time in seconds."""
    lines = kv_lines(spark, sf_dir)
    now = lines.filter("record_id % 2 = 1").withColumn("raw", F.regexp_replace(F.regexp_replace("raw", " user=", " usr="), '"', ""))
    return lines.filter("record_id % 2 = 0"), now


KEYS = """WITH e AS (SELECT *, event_id % 2 AS half, 's' || (user_id % 5) AS source_id FROM events),
k AS (SELECT half, source_id, event_id, 'ts' AS key FROM e UNION ALL SELECT half, source_id, event_id, CASE half WHEN 0 THEN 'user' ELSE 'usr' END FROM e UNION ALL SELECT half, source_id, event_id, 'action' FROM e UNION ALL SELECT half, source_id, event_id, 'value' FROM e
  UNION ALL SELECT half, source_id, event_id, 'port' FROM e UNION ALL SELECT half, source_id, event_id, 'ip' FROM e WHERE event_id % 11 <> 0 UNION ALL SELECT half, source_id, event_id, 'note' FROM e WHERE event_id % 17 = 0),
n AS (SELECT half, source_id, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT k.half, k.source_id, key, count(*) / any_value(n.n) AS presence FROM k JOIN n ON k.half = n.half AND k.source_id = n.source_id GROUP BY 1, 2, 3)"""


@query(f"{KEYS} SELECT half, source_id, key, round(presence, 6) AS presence FROM p")
def key_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [drift.key_presence(drift.fields(x), x).withColumn("half", F.lit(k).cast("bigint")) for k, x in enumerate(halves(spark, sf_dir))]
    return sides[0].unionByName(sides[1]).withColumn("presence", F.round("presence", 6))


@query(f"{KEYS}, b AS (SELECT * FROM p WHERE half = 0), c AS (SELECT * FROM p WHERE half = 1) SELECT coalesce(b.source_id, c.source_id) AS source_id, round(1 - sum(least(coalesce(b.presence, 0), coalesce(c.presence, 0))) / sum(greatest(coalesce(b.presence, 0), coalesce(c.presence, 0))), 6) AS distance FROM b FULL JOIN c ON b.source_id = c.source_id AND b.key = c.key GROUP BY 1")
def keyset_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (drift.key_presence(drift.fields(x), x) for x in halves(spark, sf_dir))
    return drift.weighted_jaccard(a, b, "key", "presence").withColumn("distance", F.round("distance", 6))


@query(f"{KEYS} SELECT source_id, key, CASE half WHEN 0 THEN 'gone' ELSE 'new' END AS change FROM p WHERE key IN ('user', 'usr')")
def key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (drift.key_presence(drift.fields(x), x) for x in halves(spark, sf_dir))
    return drift.key_changes(a, b)


@query(f"{KEYS} SELECT DISTINCT p.source_id, 'user' AS old, 'usr' AS new FROM p JOIN p q ON p.source_id = q.source_id WHERE p.key = 'user' AND q.key = 'usr'")
def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    (fa, a), (fb, b) = ((drift.fields(x), x) for x in halves(spark, sf_dir))
    changes = drift.key_changes(drift.key_presence(fa, a), drift.key_presence(fb, b))
    return drift.rename_candidates(changes, drift.shape_histogram(fa), drift.shape_histogram(fb))


@query(f"""{KEYS} SELECT source_id, key, CASE key WHEN 'ip' THEN 'ip' WHEN 'action' THEN 'qstr' WHEN 'ts' THEN 'epoch' WHEN 'port' THEN 'int' WHEN 'note' THEN 'qstr' WHEN 'value' THEN 'other' ELSE 'word' END AS shape, 1.0::DOUBLE AS share FROM (SELECT DISTINCT source_id, CASE key WHEN 'usr' THEN 'user' ELSE key END AS key FROM p)""")
def shape_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.shape_histogram(drift.fields(kv_lines(spark, sf_dir)))


SHAPED = f"""{KEYS}, sk AS (SELECT source_id, key, count(*) AS sides FROM p GROUP BY 1, 2), sd AS (SELECT source_id, avg(CASE WHEN sides = 1 OR key IN ('action', 'note') THEN 1.0 ELSE 0.0 END) AS distance FROM sk GROUP BY 1)"""


@query(f"{SHAPED} SELECT source_id, round(distance, 6) AS distance FROM sd")
def shape_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (drift.shape_histogram(drift.fields(x)) for x in halves(spark, sf_dir))
    return drift.shape_distance(a, b).withColumn("distance", F.round("distance", 6))


MARKS = "5 + CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END"
QUOTES = "CASE WHEN event_id % 17 = 0 THEN 3 ELSE 2 END"


@query(f"""SELECT source_id, delimiter, round(CASE delimiter WHEN '=' THEN e WHEN '"' THEN q ELSE 0 END, 6) AS mean FROM (SELECT 's' || (user_id % 5) AS source_id, avg({MARKS}) AS e, avg({QUOTES}) AS q FROM events GROUP BY 1), (SELECT unnest(['=', ',', '|', ':', ';', '"', chr(39), '{{', '}}', '[', ']', chr(9)]) AS delimiter)""")
def delimiter_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.delimiter_profile(kv_lines(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


DELIMITED = f"""dm AS (SELECT 's' || (user_id % 5) AS source_id, event_id % 2 AS half, avg({MARKS}) AS e, avg({QUOTES}) AS q FROM events GROUP BY ALL), dd AS (SELECT a.source_id, (abs(a.e - b.e) + a.q) / (a.e + b.e + a.q) AS distance FROM dm a JOIN dm b ON a.source_id = b.source_id AND a.half = 0 AND b.half = 1)"""


@query(f"WITH {DELIMITED} SELECT source_id, round(distance, 6) AS distance FROM dd")
def delimiter_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (drift.delimiter_profile(x) for x in halves(spark, sf_dir))
    return drift.delimiter_distance(a, b).withColumn("distance", F.round("distance", 6))


SETS = f"""ks AS (SELECT source_id, 1 - sum(least(coalesce(a, 0), coalesce(b, 0))) / sum(greatest(coalesce(a, 0), coalesce(b, 0))) AS distance FROM (SELECT source_id, key, max(presence) FILTER (half = 0) AS a, max(presence) FILTER (half = 1) AS b FROM p GROUP BY 1, 2) GROUP BY 1),
qr AS (SELECT 's' || (user_id % 5) AS source_id, avg(CASE WHEN event_id % 2 = 0 AND {KV_OK} THEN 0.0 ELSE 1.0 END) AS rate FROM events GROUP BY 1)"""


def fingerprints(spark: SparkSession, sf_dir: str) -> dict:
    """What two halves of the sources' lines look like, and the share of all lines that the spec of the first half rejects."""
    out: dict = {"lines": halves(spark, sf_dir)}
    out["fields"] = [drift.fields(x) for x in out["lines"]]
    out["presence"] = [drift.key_presence(f, x) for f, x in zip(out["fields"], out["lines"], strict=True)]
    out["shapes"] = [drift.shape_histogram(f) for f in out["fields"]]
    a, b = (drift.dominant_kind(x) for x in out["lines"])
    out["kinds"] = a.select("source_id", F.col("kind").alias("base_kind")).join(b.select("source_id", F.col("kind").alias("now_kind")), "source_id")
    parsed = normalize.normalize(out["lines"][0].unionByName(out["lines"][1]), [KV_SPEC])
    out["rates"] = parsed.groupBy("source_id").agg(F.avg(F.col("event").isNull().cast("int")).alias("rate"))
    return out


@query(f"""{SHAPED}, {SETS}, {DELIMITED} SELECT ks.source_id, round(ks.distance, 4) AS keyset, round(dd.distance, 4) AS delimiters, 1.0::DOUBLE AS templates, round(sd.distance, 4) AS shapes, round(rate, 4) AS quarantine,
  round(0.3 * ks.distance + 0.25 * dd.distance + 0.2 + 0.15 * sd.distance + 0.1 * rate, 4) AS score FROM ks JOIN sd USING (source_id) JOIN dd USING (source_id) JOIN qr USING (source_id)""")
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(spark, sf_dir)
    (a, b), (pa, pb), (ha, hb) = f["lines"], f["presence"], f["shapes"]
    parts = {
        "keyset": drift.keyset_distance(pa, pb, f["kinds"]), "delimiters": drift.delimiter_distance(drift.delimiter_profile(a), drift.delimiter_profile(b)), "templates": drift.weighted_jaccard(drift.templates(a), drift.templates(b), "template", "share"),
        "shapes": drift.shape_distance(ha, hb), "quarantine": f["rates"].withColumnRenamed("rate", "distance"),
    }
    return drift.drift_score(parts).select("source_id", *[F.round(k, 4).alias(k) for k in parts], "score")


@query("""SELECT kind, key, count(*) AS n, count(*) FILTER ((kind = 'kv' AND key IN ('action', 'note')) OR (kind = 'json' AND key IN ('user.tags.0', 'user.tags.1', 'action'))) AS quoted, count(DISTINCT v) AS "values" FROM (
  SELECT CASE event_id % 6 WHEN 0 THEN 'kv' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'cef' ELSE 'leef' END AS kind, unnest(CASE event_id % 6 WHEN 0 THEN [{'key': 'ts', 'v': CAST(epoch_us(ts) // 1000 AS VARCHAR)}, {'key': 'user', 'v': 'u' || user_id}, {'key': 'action', 'v': event_type}, {'key': 'value', 'v': CAST(value AS VARCHAR)}, {'key': 'port', 'v': CAST((event_id * 37) % 70000 AS VARCHAR)}]
      || CASE WHEN event_id % 11 <> 0 THEN [{'key': 'ip', 'v': '10.0.' || (user_id % 4) || '.' || (event_id % 250)}] ELSE [] END || CASE WHEN event_id % 17 = 0 THEN [{'key': 'note', 'v': 'ope'}] ELSE [] END
    WHEN 1 THEN [{'key': 'col_0', 'v': CAST(epoch_us(ts) // 1000 AS VARCHAR)}, {'key': 'col_1', 'v': CAST(user_id AS VARCHAR)}, {'key': 'col_2', 'v': event_type}, {'key': 'col_3', 'v': CAST(value AS VARCHAR)}, {'key': 'col_4', 'v': 'a, "' || event_id || '"'}, {'key': 'col_5', 'v': 'x'}, {'key': 'col_6', 'v': ''}]
    WHEN 2 THEN [{'key': 'ts', 'v': CAST(epoch_us(ts) // 1000 AS VARCHAR)}, {'key': 'user.id', 'v': CAST(user_id AS VARCHAR)}, {'key': 'user.tags.0', 'v': 't' || (event_id % 3)}, {'key': 'user.tags.1', 'v': 't' || (event_id % 5)}, {'key': 'action', 'v': event_type}, {'key': 'value', 'v': CAST(value AS VARCHAR)}, {'key': 'none', 'v': 'null'}, {'key': 'props.k', 'v': json_extract_string(props, '$.k')}]
    WHEN 3 THEN [{'key': 'cef.version', 'v': '0'}, {'key': 'cef.vendor', 'v': 'Acme'}, {'key': 'cef.product', 'v': 'Gate|way'}, {'key': 'cef.device_version', 'v': '1.0'}, {'key': 'cef.signature_id', 'v': CAST(event_id % 7 AS VARCHAR)}, {'key': 'cef.name', 'v': event_type}, {'key': 'cef.severity', 'v': CAST(event_id % 10 AS VARCHAR)}, {'key': 'rt', 'v': CAST(epoch_us(ts) // 1000 AS VARCHAR)}, {'key': 'suser', 'v': 'user ' || user_id}, {'key': 'msg', 'v': 'a=b'}, {'key': 'act', 'v': event_type}, {'key': 'cn1', 'v': CAST(value AS VARCHAR)}]
    WHEN 4 THEN [{'key': 'leef.version', 'v': '2.0'}, {'key': 'leef.vendor', 'v': 'Acme'}, {'key': 'leef.product', 'v': 'Gate'}, {'key': 'leef.product_version', 'v': '1.0'}, {'key': 'leef.event_id', 'v': event_type}, {'key': 'usrName', 'v': 'u' || user_id}, {'key': 'devTime', 'v': CAST(epoch_us(ts) // 1000 AS VARCHAR)}, {'key': 'note', 'v': 'a b'}, {'key': 'value', 'v': CAST(value AS VARCHAR)}] ELSE [] END, recursive := true) FROM events WHERE event_id % 6 <> 5) GROUP BY ALL""")
def field_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mixed_lines(spark, sf_dir)
    kind = values.line_kind(F.col("raw"))
    found = drift.fields(lines, kind).join(lines.select("record_id", kind.alias("kind")), "record_id")
    return found.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("quoted").alias("quoted"), F.count_distinct("value").alias("values"))


@query("""WITH t AS (SELECT 's' || (user_id % 5) AS source_id, 5 + CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS t FROM events),
s AS (SELECT source_id, list_sort(list(t)) AS l, avg(t) AS mean, count(*) AS n FROM t GROUP BY 1) SELECT source_id, round(mean, 6) AS mean, l[n // 10 + 1] AS p10, l[least(n - 1, 9 * n // 10) + 1] AS p90 FROM s""")
def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.token_profile(kv_lines(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("""WITH k AS (SELECT 's' || (user_id % 5) AS source_id, ['kv', 'csv', 'json', 'cef', 'leef', 'text'][event_id % 6 + 1] AS kind, count(*) AS n FROM events GROUP BY ALL)
SELECT source_id, kind, n AS lines FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, kind) AS k FROM k) WHERE k = 1""")
def dominant_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.dominant_kind(mixed_lines(spark, sf_dir))


@query("""WITH s AS (SELECT 's' || (user_id % 5) AS source_id, (event_id % 11 = 0) AS a, (event_id % 17 = 0) AS c, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT source_id, max(n) AS m, sum(n) AS n FROM s GROUP BY 1) SELECT source_id, round(m / n, 6) AS share FROM t""")
def dominant_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = kv_lines(spark, sf_dir)
    return drift.dominant_structure(lines, drift.fields(lines)).withColumn("share", F.round("share", 6))


@query("""WITH k AS (SELECT 's' || (user_id % 5) AS source_id, 7 - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS w, count(*) AS n FROM events GROUP BY ALL) SELECT source_id, round(max(n) / sum(n), 6) AS share, round(sum(w * n) / sum(n), 6) AS columns FROM k GROUP BY 1""")
def csv_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.concat_ws(",", F.lit("a"), e.cast("string"), F.lit('"b,c"'), F.lit(""), F.lit("d"), F.lit("e"), F.when(e % 3 != 0, "f"), F.when(e % 7 == 0, "g,h"))
    lines = events(spark, sf_dir).select(e.alias("record_id"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("source_id"), raw.alias("raw"))
    found = drift.fields(lines, F.lit("csv"))
    share = drift.dominant_structure(lines, found, csv_lines=True)
    return share.join(drift.csv_columns(found, lines), "source_id").select("source_id", F.round("share", 6).alias("share"), F.round("columns", 6).alias("columns"))


MIX = "CASE WHEN event_id % 11 = 0 AND user_id % 2 = 0 THEN 'r' || (user_id % 3) ELSE 'b' || (user_id % 10) END"
DECIDED = f"""s AS (SELECT {MIX} AS source_id, count(*) FILTER ({KV_OK}) AS parsed, count(*) FILTER (NOT {KV_OK}) AS quarantined FROM events GROUP BY 1),
k AS (SELECT {MIX} AS source_id, event_id % 11 = 0 AS a, event_id % 17 = 0 AS c, count(*) AS n FROM events WHERE NOT {KV_OK} GROUP BY ALL), t AS (SELECT source_id, max(n) / sum(n) AS structure FROM k GROUP BY 1),
d AS (SELECT s.source_id, CASE WHEN parsed + quarantined < 50 THEN 'needs_samples' WHEN round(quarantined / (parsed + quarantined), 4) < 0.35 AND quarantined / (parsed + quarantined) <= 0.2 THEN CASE WHEN parsed > 0 THEN 'baseline' ELSE 'none' END
  WHEN quarantined < 50 OR coalesce(structure, 0) < 0.8 THEN 'alert' ELSE 'proposal' END AS decision FROM s LEFT JOIN t USING (source_id))"""


def decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions of sources that have no baseline yet (the score is the rate of rejects), and the lines that were parsed."""
    e, u = F.col("record_id"), F.regexp_extract("raw", " user=u([0-9]+)", 1).cast("int")
    lines = kv_lines(spark, sf_dir).withColumn("source_id", F.when((e % 11 == 0) & (u % 2 == 0), F.concat(F.lit("r"), u % 3)).otherwise(F.concat(F.lit("b"), u % 10)))
    fine, rest = normalize.split(normalize.normalize(lines, [KV_SPEC]))
    counts = fine.select("source_id", F.lit(1).alias("ok")).unionByName(rest.select("source_id", F.lit(0).alias("ok"))).groupBy("source_id").agg(F.sum("ok").alias("parsed"), F.count_if(F.col("ok") == 0).alias("quarantined"))
    structure = drift.dominant_structure(rest, drift.fields(rest)).withColumnRenamed("share", "structure")
    scored = counts.withColumn("score", F.round(F.col("quarantined") / (F.col("parsed") + F.col("quarantined")), 4)).join(structure, "source_id", "left")
    return drift.decide(scored), fine


@query(f"WITH {DECIDED} SELECT source_id, decision FROM d")
def source_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir)[0]


@query(f"WITH {DECIDED}, r AS (SELECT {MIX} AS source_id, event_id AS record_id, row_number() OVER (PARTITION BY {MIX} ORDER BY event_id DESC) AS n FROM events WHERE {KV_OK}) SELECT source_id, record_id FROM r JOIN d USING (source_id) WHERE n <= 500 AND decision = 'baseline'")
def baseline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions, fine = decided(spark, sf_dir)
    healthy = fine.join(decisions.filter("decision = 'baseline'").select("source_id"), "source_id", "left_semi")
    return serve.samples(healthy.select("source_id", "record_id", (-F.col("record_id")).alias("_o")), 500, order="_o").drop("_o")


@query("""WITH v AS (SELECT 's' || (user_id % 5) AS source_id, event_id % 11 <> 0 AS ip, event_id % 13 = 0 AS again, event_id % 17 = 0 AS note FROM events),
f AS (SELECT source_id, 5 + ip::INT + again::INT + 2 * note::INT AS words, bool_or(ip) AND NOT bool_and(ip) AS mixed, bool_or(ip) AS ip, bool_or(again) AS again, bool_or(note) AS note, count(*) AS lines FROM v GROUP BY 1, 2)
SELECT source_id, lines, 'ts=<V> user=<V> action=<V> value=<V>' || CASE words WHEN 5 THEN ' port=<V>' WHEN 6 THEN CASE WHEN mixed THEN ' <*> <*>' WHEN ip THEN ' ip=<V> port=<V>' ELSE ' port=<V> user=<V>' END
  WHEN 7 THEN CASE WHEN mixed THEN ' <*> <*> <*>' WHEN ip THEN ' ip=<V> port=<V> user=<V>' ELSE ' port=<V> note=<V> end' END
  WHEN 8 THEN CASE WHEN mixed THEN ' <*> <*> note=<V> end' WHEN ip THEN ' ip=<V> port=<V> note=<V> end' ELSE ' port=<V> user=<V> note=<V> end' END ELSE ' ip=<V> port=<V> user=<V> note=<V> end' END AS template FROM f""")
def log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.templates(kv_lines(spark, sf_dir)).select("source_id", "lines", "template")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, _ = normalize.split(normalize.normalize(kv_lines(spark, sf_dir), [KV_SPEC]))
    return exports.flat(parsed)


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS dt, 'Acme' AS vendor, count(*) AS rows, round(sum(value), 4) AS total FROM events WHERE {KV_OK} GROUP BY 1")
def lake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.lake(export_rows(spark, sf_dir)).groupBy("dt", "vendor").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("metric_value"), 4).alias("total"))


@query(f"""SELECT event_id || '.app_kv@1.0.0' AS event_id, event_id AS record_id, event_id // 1000 AS segment, 64::BIGINT AS sha, 's' || (user_id % 5) AS source_id, 'Acme' AS vendor_name, 'Gate' AS product, 'app_kv' AS parser_id, '1.0.0' AS parser_version, 'main' AS template_id,
  epoch_us(ts) // 1000 * 1000 AS event_us, epoch_us(ts) AS received_us, (CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 ELSE 1 END)::INT AS severity_id, 0 AS action_id, 4001 AS class_uid, '10.0.' || (user_id % 4) || '.' || (event_id % 250) AS src_ip, '' AS dst_ip,
  ((event_id * 37) % 70000)::INT AS src_port, 0 AS dst_port, '' AS proto, 0::BIGINT AS bytes_in, 0::BIGINT AS bytes_out, 'u' || user_id AS "user", '' AS host, false AS time_from_receipt, true AS current, event_type AS message, 'u' || user_id AS nested_user, strftime(ts, '%Y-%m-%d') AS dt, 'Acme' AS vendor FROM events WHERE {KV_OK}""")
def lake_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = kv_lines(spark, sf_dir).withColumn("segment", F.floor(F.col("record_id") / 1000))
    rows = exports.lake_columns(normalize.normalize(lines, [KV_SPEC]))
    get = lambda p: F.get_json_object("extras_json", p)
    same = [c for c in rows.columns if c not in ("raw_sha256", "event_time", "received_at", "activity_id", "confidence", "integrity_flags", "extras_json")]
    return rows.select(*same, F.length(F.hex("raw_sha256")).cast("bigint").alias("sha"), F.unix_micros("event_time").alias("event_us"), F.unix_micros("received_at").alias("received_us"), get("$.ocsf.message").alias("message"), get("$.ocsf.actor.user.name").alias("nested_user"))


@query(f"""SELECT event_id || '.app_kv@1.0.0' AS event_id, 'u' || user_id AS "user", event_type AS message, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS original_time, event_id AS record_id, 'app_kv' AS parser, '1.0.0' AS version, true AS same, true AS raw_same FROM events WHERE {KV_OK}""")
def ocsf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of all events, each listed twice, with the raw line and its hash checked against the line."""
    lines = kv_lines(spark, sf_dir)
    parsed, _ = normalize.split(normalize.normalize(lines, [KV_SPEC]))
    docs = exports.ocsf_documents(parsed.unionByName(parsed), raw=True).join(lines.select("record_id", "raw"), "record_id")
    get = lambda p: F.get_json_object("line", p)
    held = F.unbase64(get("$.raw_data"))
    return docs.select(
        "event_id", get("$.actor.user.name").alias("user"), get("$.message").alias("message"), get("$.metadata.original_time").alias("original_time"), get("$.lineage.record_id").cast("bigint").alias("record_id"), get("$.lineage.parser").alias("parser"),
        get("$.lineage.parser_version").alias("version"), (F.sha2(held, 256) == get("$.lineage.raw_sha256")).alias("same"), (held == F.col("raw").cast("binary")).alias("raw_same"),
    )


@query(f"""SELECT event_id AS record_id, epoch_us(ts) // 1000 AS time, 'u' || user_id AS "user", event_id || '.app_kv@1.0.0' AS uid FROM events WHERE {KV_OK}""")
def export_ocsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = exports.ocsf(export_rows(spark, sf_dir))
    get = lambda p: F.get_json_object("line", p)
    return x.select("record_id", get("$.time").cast("bigint").alias("time"), get("$.actor.user.name").alias("user"), get("$.metadata.uid").alias("uid"))


@query(f"""SELECT event_id AS record_id, '10.0.' || (user_id % 4) || '.' || (event_id % 250) AS ip, event_type AS action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events WHERE {KV_OK}""")
def export_ecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = exports.ecs(export_rows(spark, sf_dir))
    get = lambda p: F.get_json_object("line", p)
    return x.select("record_id", get("$.source.ip").alias("ip"), get("$.event.action").alias("action"), F.regexp_replace(F.substring(get("$['@timestamp']"), 1, 19), "T", " ").alias("stamp"))


@query(f"""SELECT event_id AS record_id, 'CEF:0|Acme|Gate|1.0.0|main|' || event_type || '|' || (CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 ELSE 1 END) || '|rt=' || (epoch_us(ts) // 1000) || ' src=10.0.' || (user_id % 4) || '.' || (event_id % 250) || ' spt=' || ((event_id * 37) % 70000) || ' suser=u' || user_id AS line FROM events WHERE {KV_OK}""")
def export_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.cef(export_rows(spark, sf_dir)).select("record_id", "line")


@query(f"""WITH c AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, 'CEF:0|Acme|Gate|1.0.0|main|' || event_type || '|' || (CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 ELSE 1 END) || '|rt=' || (epoch_us(ts) // 1000) || ' src=10.0.' || (user_id % 4) || '.' || (event_id % 250) || ' spt=' || ((event_id * 37) % 70000) || ' suser=u' || user_id AS line FROM events WHERE {KV_OK}),
l AS (SELECT event_id, '<134>1 ' || strftime(make_timestamp(ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || rtrim(printf('%03d', ms % 1000), '0') END || 'Z collector gate - - - ' || line AS line FROM c)
SELECT event_id AS record_id, strlen(line) || ' ' || line AS frame FROM l""")
def export_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.syslog(export_rows(spark, sf_dir), "collector", "gate", octets=True)


@query("""WITH RECURSIVE d AS (SELECT doc_id, greatest(1, strlen(coalesce(text, ''))) AS n, 's' || (doc_id % 4) AS source_id FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS i, sum(n) OVER (PARTITION BY source_id ORDER BY doc_id) AS p FROM d),
b AS (SELECT source_id, 0::BIGINT AS batch, 1::BIGINT AS i, 0::HUGEINT AS base FROM r WHERE i = 1
  UNION ALL SELECT b.source_id, b.batch + 1, min(r.i), min(r.p - r.n) FROM b JOIN r ON r.source_id = b.source_id AND r.i > b.i AND r.p > b.base + 65536 GROUP BY b.source_id, b.batch),
e AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY source_id ORDER BY batch), 1000000000000) AS stop FROM b)
SELECT source_id, batch, count(*) AS rows, CAST(sum(n) AS BIGINT) AS bytes FROM r JOIN e USING (source_id) WHERE r.i >= e.i AND r.i < e.stop GROUP BY 1, 2""")
def export_hec_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), F.col("doc_id") % 4).alias("source_id"), F.greatest(F.lit(1), F.octet_length(F.coalesce("text", F.lit("")))).cast("bigint").alias("bytes"))
    b = exports.batches(docs, "source_id", "doc_id", "bytes", 65536)
    return b.groupBy("source_id", "batch").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))


@query(f"""{SHAPED}, {SETS} SELECT sk.source_id, 'keys renamed: user->usr | value shape of action changed: qstr->word' || CASE WHEN max(CASE WHEN key = 'note' THEN sides END) = 2 THEN ' | value shape of note changed: qstr->word' ELSE '' END || ' | quarantine rate ' || printf('%.2f', any_value(rate)) AS signals FROM sk JOIN qr USING (source_id) GROUP BY 1""")
def drift_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(spark, sf_dir)
    (pa, pb), (ha, hb) = f["presence"], f["shapes"]
    changes = drift.key_changes(pa, pb)
    found = drift.signals(f["kinds"], changes, drift.rename_candidates(changes, ha, hb), ha, hb, f["rates"])
    return found.select("source_id", F.array_join("signals", " | ").alias("signals"))
