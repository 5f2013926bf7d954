"""Queries of the ledger and of temporal identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.operators import checkpoints, evidence, extract, identity, ledger, normalize
from loglake.plans.lines import KV_OK, KV_SPEC, events, kv_lines
from loglake.plans.registry import query, table
from loglake.session import stored

SEGMENT = 1000
RAW = "event_type || ':' || user_id || ':' || (event_id % 97)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger records from ``events``: record_id from 1, raw bytes, segment of 1000."""
    raw = F.concat_ws(":", "event_type", F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string"))
    rows = events(spark, sf_dir).select((F.col("event_id") + 1).alias("record_id"), raw.cast("binary").alias("raw"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("source_id"), "ts")
    return rows.withColumn("segment", ledger.segment_of(F.col("record_id"), SEGMENT))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("segment", "record_id", ledger.leaf_hash(F.col("raw")).alias("leaf"))


LEAVES = f"SELECT event_id // {SEGMENT} + 1 AS segment, event_id + 1 AS record_id, unhex(sha256(unhex('00') || encode({RAW}))) AS leaf FROM events"
TREE = f"""leaves AS ({LEAVES}), numbered AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY record_id) - 1 AS i, count(*) OVER (PARTITION BY segment) AS size FROM leaves),
tree AS (SELECT segment, 0 AS level, i, size AS n, leaf AS h FROM numbered UNION ALL
  SELECT a.segment, a.level + 1, a.i // 2, (a.n + 1) // 2, CASE WHEN b.h IS NULL THEN a.h ELSE unhex(sha256(unhex('01') || a.h || b.h)) END
  FROM tree a LEFT JOIN tree b ON a.segment = b.segment AND b.i = a.i + 1 AND a.level = b.level WHERE a.n > 1 AND a.i % 2 = 0),
roots AS (SELECT segment, h AS root FROM tree WHERE n = 1)"""


@query(f"SELECT event_id + 1 AS record_id, sha256(encode({RAW})) AS raw_sha256 FROM events")
def raw_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("record_id", F.sha2("raw", 256).alias("raw_sha256"))


@query(f"SELECT segment, record_id, lower(hex(leaf)) AS leaf FROM ({LEAVES})")
def leaf_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(spark, sf_dir).withColumn("leaf", F.lower(F.hex("leaf")))


@query(f"""SELECT event_id + 1 AS record_id, sha256(unhex('0100') || unhex(printf('%016X', event_id + 1)) || unhex(printf('%016X', epoch_us(ts) * 1000)) || unhex('0002') || encode('s' || (user_id % 5)) || unhex('02')
  || unhex('0004') || encode('file') || unhex(printf('%016X', event_id * 10)) || unhex(printf('%08X', strlen({RAW}))) || encode({RAW})) AS body_sha256 FROM events""")
def canonical_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    body = ledger.canonical_body(F.col("record_id"), F.unix_micros("ts") * 1000, F.col("source_id"), F.lit(2), F.lit("file"), (F.col("record_id") - 1) * 10, F.col("raw"))
    return r.select("record_id", F.sha2(body, 256).alias("body_sha256"))


@query(f"""SELECT event_id + 1 AS record_id, CASE event_id % 5 WHEN 1 THEN 'version' WHEN 2 THEN 'flags' WHEN 3 THEN 'trailing' WHEN 4 THEN 'length' END AS error, CASE WHEN event_id % 5 = 0 THEN {RAW} END AS raw FROM events""")
def decode_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    body = ledger.canonical_body(F.col("record_id"), F.unix_micros("ts") * 1000, F.col("source_id"), F.lit(2), F.lit("file"), F.col("record_id"), F.col("raw"))
    e = (F.col("record_id") - 1) % 5
    tail = lambda b, at: F.substring(b, F.lit(at), F.octet_length(b))
    broken = F.when(e == 1, F.concat(F.unhex(F.lit("02")), tail(body, 2))).when(e == 2, F.concat(F.unhex(F.lit("0110")), tail(body, 3))).when(e == 3, F.concat(body, F.unhex(F.lit("00")))).when(e == 4, F.substring(body, F.lit(1), F.octet_length(body) - 1)).otherwise(body)
    d = r.withColumn("d", ledger.decode_body(broken))
    return d.select("record_id", F.col("d.error").alias("error"), F.when(F.col("d.error").isNull(), F.col("d.raw").cast("string")).alias("raw"))


@query(f"SELECT event_id // {SEGMENT} + 1 AS segment, min(event_id) + 1 AS first_seq, max(event_id) + 1 AS last_seq, count(*) AS records FROM events GROUP BY 1")
def segment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("segment").agg(F.min("record_id").alias("first_seq"), F.max("record_id").alias("last_seq"), F.count(F.lit(1)).alias("records"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, greatest(1, strlen(coalesce(text, ''))) AS n, 's' || (doc_id % 4) AS source_id FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS i, sum(n) OVER (PARTITION BY source_id ORDER BY doc_id) AS p FROM d),
b AS (SELECT source_id, 1::BIGINT AS segment, 1::BIGINT AS i, 0::HUGEINT AS base FROM r WHERE i = 1
  UNION ALL SELECT b.source_id, b.segment + 1, min(r.i) + 1, min(r.p) FROM b JOIN r ON r.source_id = b.source_id AND r.i >= b.i AND (r.p >= b.base + 65536 OR r.i + 1 - b.i >= 30) GROUP BY b.source_id, b.segment),
e AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY source_id ORDER BY segment), 1000000000000) AS stop FROM b)
SELECT source_id, segment, count(*) AS records, CAST(sum(n) AS BIGINT) AS bytes FROM r JOIN e USING (source_id) WHERE r.i >= e.i AND r.i < e.stop GROUP BY 1, 2""")
def segment_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), F.col("doc_id") % 4).alias("source_id"), F.greatest(F.lit(1), F.octet_length(F.coalesce("text", F.lit("")))).cast("bigint").alias("bytes"))
    return ledger.segments_by_size(docs, "source_id", "doc_id", "bytes", 65536, 30).groupBy("source_id", "segment").agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"))


@query(f"WITH RECURSIVE {TREE} SELECT segment, lower(hex(root)) AS root FROM roots")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.roots(leaves(spark, sf_dir)).select("segment", F.lower(F.hex("root")).alias("root"))


@query(f"""WITH RECURSIVE {TREE}, levels AS (SELECT DISTINCT segment, level FROM tree WHERE n > 1)
SELECT r.segment, r.record_id, coalesce(string_agg(lower(hex(t.h)), ',' ORDER BY t.level), '') AS path FROM numbered r LEFT JOIN levels l ON l.segment = r.segment
LEFT JOIN tree t ON t.segment = r.segment AND t.level = l.level AND t.i = xor(r.i >> l.level, 1) GROUP BY ALL""")
def inclusion_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.inclusion_paths(leaves(spark, sf_dir)).select("segment", "record_id", F.array_join(F.transform("path", lambda h: F.lower(F.hex(h))), ",").alias("path"))


@query(f"SELECT event_id // {SEGMENT} + 1 AS segment, event_id % 3 = 1 AS forged, event_id % 3 <> 1 AS valid, count(*) AS n FROM events GROUP BY ALL")
def verify_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = leaves(spark, sf_dir)
    proofs = ledger.inclusion_paths(leaf).join(ledger.roots(leaf).select("segment", "root"), "segment")
    forged = (F.col("record_id") - 1) % 3 == 1
    own = F.when(forged, ledger.leaf_hash(F.unhex(F.lit("FF")))).otherwise(F.col("leaf"))
    valid = ledger.verify_inclusion(own, F.col("index"), F.col("size"), F.col("path"), F.col("root"))
    return proofs.groupBy("segment", forged.alias("forged"), valid.alias("valid")).agg(F.count(F.lit(1)).alias("n"))


CHAIN = f"""{TREE}, sealed AS (SELECT segment, min(record_id) AS first_seq, max(record_id) AS last_seq, count(*) AS count FROM leaves GROUP BY segment),
chain AS (SELECT s.segment, s.first_seq, s.last_seq, s.count, r.root, unhex(repeat('00', 32)) AS prev, unhex(sha256(unhex('02') || unhex(repeat('00', 32)) || r.root || unhex(printf('%016X', s.segment)) || unhex(printf('%016X', s.count)))) AS chain
  FROM sealed s JOIN roots r ON r.segment = s.segment WHERE s.segment = 1 UNION ALL
  SELECT s.segment, s.first_seq, s.last_seq, s.count, r.root, c.chain, unhex(sha256(unhex('02') || c.chain || r.root || unhex(printf('%016X', s.segment)) || unhex(printf('%016X', s.count)))) FROM chain c JOIN sealed s ON s.segment = c.segment + 1 JOIN roots r ON r.segment = s.segment)"""


@query(f"WITH RECURSIVE {CHAIN} SELECT segment, lower(hex(prev)) AS prev, lower(hex(chain)) AS chain FROM chain")
def seal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.seals(leaves(spark, sf_dir)).select("segment", F.lower(F.hex("prev")).alias("prev"), F.lower(F.hex("chain")).alias("chain"))


@query(f"WITH RECURSIVE {CHAIN} SELECT segment, first_seq, last_seq, count AS records, lower(hex(root)) AS root, lower(hex(chain)) AS chain FROM chain")
def seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.seals(leaves(spark, sf_dir)).select("segment", "first_seq", "last_seq", F.col("count").alias("records"), F.lower(F.hex("root")).alias("root"), F.lower(F.hex("chain")).alias("chain"))


@query(f"SELECT DISTINCT event_id // {SEGMENT} + 1 AS segment, 'chain' AS reason FROM events WHERE (event_id // {SEGMENT} + 1) % 4 = 1")
def verify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = ledger.seals(leaves(spark, sf_dir))
    forged = F.when(F.col("segment") % 4 == 1, ledger.sha(F.col("root"))).otherwise(F.col("root"))
    return ledger.verify_chain(sealed.withColumn("root", forged))


@query(f"""WITH n AS (SELECT count(DISTINCT event_id // {SEGMENT}) AS segments, count(*) AS records, max(event_id) // {SEGMENT} + 1 AS last FROM events)
SELECT forged, reason IS NULL AS ok, segments, CASE WHEN bad IS NULL THEN records ELSE 0 END AS records, bad AS first_bad, reason FROM (SELECT forged, segments, records, CASE WHEN forged IN ('none', 'head') THEN NULL WHEN forged = 'gap' THEN 2 ELSE last END AS bad,
  nullif(forged, 'none') AS reason FROM n, (VALUES ('none'), ('gap'), ('sequence'), ('range'), ('prev'), ('chain'), ('missing'), ('footer root'), ('footer chain'), ('head')) v(forged))""")
def chain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger ten times: whole, and with one fault each, all but the gap in its last segment."""
    forged = ["none", "gap", "sequence", "range", "prev", "chain", "missing", "footer root", "footer chain", "head"]
    many = ledger.seals(leaves(spark, sf_dir)).withColumn("forged", F.explode(F.array(*[F.lit(x) for x in forged])))
    rows = many.withColumn("_end", F.col("segment") == F.max("segment").over(Window.partitionBy("forged")))  # a row a segment
    at = lambda kind: (F.col("forged") == kind) & F.col("_end")
    wrong = lambda kind, column: F.when(at(kind), ledger.sha(F.col(column))).otherwise(F.col(column))
    more = lambda test, column: F.col(column) + test.cast("int")
    sealed = rows.withColumns({"segment": more(F.col("forged") == "gap", "segment"), "first_seq": more(at("sequence"), "first_seq"), "count": more(at("range"), "count"), "prev": wrong("prev", "prev"), "root": wrong("chain", "root")})
    footers = rows.filter(~at("missing")).select("forged", "segment", wrong("footer root", "root").alias("root"), wrong("footer chain", "chain").alias("chain"))
    heads = rows.filter("_end").select("forged", wrong("head", "chain").alias("head"))
    return ledger.chain_report(sealed, footers, heads, ("forged",))


@query(f"SELECT DISTINCT event_id // {SEGMENT} + 1 AS segment, 'root' AS reason FROM events WHERE event_id % 1500 = 7")
def verify_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    sealed = ledger.seals(leaves(spark, sf_dir))
    changed = rows.select("segment", "record_id", ledger.leaf_hash(F.when((F.col("record_id") - 1) % 1500 == 7, F.lit("x").cast("binary")).otherwise(F.col("raw"))).alias("leaf"))
    return ledger.verify_deep(changed, sealed)


@query(f"SELECT event_id // {SEGMENT} + 1 AS segment, event_id + 1 AS record_id, CASE WHEN event_id % 101 = 0 THEN 'removed' ELSE 'changed' END AS change FROM events WHERE event_id % 101 = 0 OR event_id % 103 = 0")
def tamper_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = leaves(spark, sf_dir)
    e = F.col("record_id") - 1
    now = stored.filter(e % 101 != 0).withColumn("leaf", F.when(e % 103 == 0, ledger.sha(F.col("leaf"))).otherwise(F.col("leaf")))
    return ledger.tampered(stored, now)


@query(f"SELECT sha256(encode({RAW})) AS raw_sha256, max(event_id) + 1 AS record_id, count(*) AS copies, max_by(epoch_us(ts), event_id) AS received_us, any_value({RAW}) AS raw FROM events GROUP BY 1")
def get_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest_by_hash(records(spark, sf_dir)).select("raw_sha256", "record_id", "copies", F.unix_micros("ts").alias("received_us"), F.col("raw").cast("string").alias("raw"))


@query(f"WITH RECURSIVE {CHAIN} SELECT CAST(sum(count) AS BIGINT) AS records, max(last_seq) AS sealed_through, count(*) AS segments, max_by(lower(hex(chain)), segment) AS head FROM chain")
def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.seals(leaves(spark, sf_dir)).agg(F.sum("count").alias("records"), F.max("last_seq").alias("sealed_through"), F.count(F.lit(1)).alias("segments"), F.max_by(F.lower(F.hex("chain")), "segment").alias("head"))


def closed(rows: DataFrame) -> DataFrame:
    """Rows of the segments that are full; the last one may still be written."""
    full = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == SEGMENT).select("segment")
    return rows.join(full, "segment", "left_semi")


CLOSED = f"SELECT event_id // {SEGMENT} + 1 AS segment FROM events GROUP BY 1 HAVING count(*) = {SEGMENT}"


@query(f"""WITH RECURSIVE {CHAIN}, levels AS (SELECT DISTINCT segment, level FROM tree WHERE n > 1), paths AS (SELECT r.segment, r.record_id, coalesce(string_agg(lower(hex(t.h)), ',' ORDER BY t.level), '') AS path FROM numbered r LEFT JOIN levels l ON l.segment = r.segment
LEFT JOIN tree t ON t.segment = r.segment AND t.level = l.level AND t.i = xor(r.i >> l.level, 1) GROUP BY ALL), done AS ({CLOSED})
SELECT event_id + 1 AS record_id, event_id // {SEGMENT} + 1 AS segment, d.segment IS NOT NULL AS sealed, sha256(encode({RAW})) AS raw_sha256, CASE WHEN d.segment IS NOT NULL THEN md5(p.path) END AS proof_md5, CASE WHEN d.segment IS NOT NULL THEN lower(hex(c.chain)) END AS chain
FROM events e JOIN paths p ON p.record_id = e.event_id + 1 LEFT JOIN done d ON d.segment = event_id // {SEGMENT} + 1 JOIN chain c ON c.segment = event_id // {SEGMENT} + 1""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sealed = records(spark, sf_dir), closed(leaves(spark, sf_dir))
    # digests travel, not the paths
    proofs = ledger.inclusion_paths(sealed).select("record_id", F.md5(F.array_join(F.transform("path", lambda h: F.lower(F.hex(h))), ",")).alias("proof_md5"))
    seal = ledger.seals(sealed).select("segment", F.lower(F.hex("chain")).alias("chain"))
    out = rows.join(proofs, "record_id", "left").join(seal, "segment", "left")
    return out.select("record_id", "segment", F.col("chain").isNotNull().alias("sealed"), F.sha2("raw", 256).alias("raw_sha256"), "proof_md5", "chain")


@query("SELECT event_id, row_number() OVER (ORDER BY date_trunc('hour', ts), user_id, event_id) AS record_id FROM events")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_seconds("ts") / 3600)
    return ledger.dense_ids(events(spark, sf_dir).select("event_id", "user_id", "ts"), hour, ["user_id", "event_id"]).select("event_id", "record_id")


@query(f"""WITH done AS ({CLOSED}) SELECT event_id + 1 AS record_id, d.segment IS NULL OR (event_id % 101 <> 0 AND event_id % 103 <> 0 AND d.segment % 3 <> 2 AND d.segment % 5 <> 4) AS ok, d.segment IS NOT NULL AS sealed,
  CASE WHEN d.segment IS NULL THEN NULL WHEN event_id % 101 = 0 THEN 'record does not match its leaf hash' WHEN event_id % 103 = 0 THEN 'inclusion proof does not verify against the segment root' WHEN d.segment % 3 = 2 THEN 'segment chain link does not verify' WHEN d.segment % 5 = 4 THEN 'segment root does not match the ledger' END AS reason
FROM events LEFT JOIN done d ON d.segment = event_id // {SEGMENT} + 1""")
def verify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, every = F.col("record_id") - 1, leaves(spark, sf_dir)
    sealed = ledger.seals(closed(every))
    footer = sealed.select("segment", "root", "prev", F.when(F.col("segment") % 3 == 2, ledger.sha(F.col("chain"))).otherwise(F.col("chain")).alias("chain"))
    proofs = ledger.inclusion_paths(closed(every)).join(footer, "segment").withColumn("path", F.when(e % 103 == 0, F.transform("path", lambda h: ledger.sha(h))).otherwise(F.col("path")))
    now = every.withColumn("leaf", F.when(e % 101 == 0, ledger.sha(F.col("leaf"))).otherwise(F.col("leaf")))
    book = sealed.withColumn("root", F.when(F.col("segment") % 5 == 4, ledger.sha(F.col("root"))).otherwise(F.col("root")))
    return ledger.verify_records(now, proofs, book)


@query(f"SELECT event_id + 1 AS record_id, {RAW} AS raw FROM events WHERE event_id + 1 >= 500")
def scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.scan(records(spark, sf_dir), 500).select("record_id", F.col("raw").cast("string").alias("raw"))


@query(f"WITH done AS ({CLOSED}) SELECT event_id // {SEGMENT} + 1 AS segment, bool_or(d.segment IS NOT NULL) AS sealed, min(event_id) + 1 AS first_seq, max(event_id) + 1 AS last_seq, count(*) AS count FROM events LEFT JOIN done d ON d.segment = event_id // {SEGMENT} + 1 GROUP BY 1")
def segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.segment_list(ledger.seals(closed(leaves(spark, sf_dir))), records(spark, sf_dir))


@query("SELECT event_id + 1 AS record_id, event_id % 50 <> 3 AS sha_match FROM events")
def raw_sha_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    said = rows.select("record_id", F.when((F.col("record_id") - 1) % 50 == 3, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.sha2("raw", 256)).alias("said"))
    return rows.join(said, "record_id").select("record_id", (F.sha2("raw", 256) == F.col("said")).alias("sha_match"))


@query("SELECT c_custkey AS checkpoint, CASE WHEN c_custkey % 40 = 9 THEN 'prev' ELSE 'coverage' END AS reason FROM customer WHERE (c_custkey % 40 = 9 OR c_custkey % 40 = 21)")
def checkpoint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    log = table(spark, sf_dir, "customer").select(k.alias("checkpoint"), F.when(k % 40 == 21, k - 5).otherwise(k).alias("covered"), F.col("c_name").cast("binary").alias("signature"))
    before = F.format_string("Customer#%09d", k - 1).cast("binary")
    prev = table(spark, sf_dir, "customer").select(k.alias("checkpoint"), F.when(k == 0, F.unhex(F.lit(ledger.ZERO))).when(k % 40 == 9, F.unhex(F.lit("AB"))).otherwise(ledger.sha(before)).alias("prev"))
    return ledger.checkpoint_links(log.join(prev, "checkpoint"))


@query(f"SELECT count(*) AS ingested, count(*) FILTER ({KV_OK}) AS events, count(*) FILTER (NOT {KV_OK}) AS quarantined, 0::BIGINT AS lost, 0::BIGINT AS twice FROM events")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = kv_lines(spark, sf_dir)
    fine, rest = normalize.split(normalize.normalize(lines, [KV_SPEC]))
    out = fine.select("record_id", F.lit(1).alias("event")).unionByName(rest.select("record_id", F.lit(0).alias("event")))
    # every record that came in is one event or one quarantine row
    met = lines.select("record_id").join(out.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("event")), "record_id", "left")
    return met.agg(F.count(F.lit(1)).alias("ingested"), F.sum("event").alias("events"), F.sum(F.col("n") - F.col("event")).alias("quarantined"), F.count_if(F.col("n").isNull()).alias("lost"), F.count_if(F.col("n") > 1).alias("twice"))


@query(f"""WITH m AS (SELECT sha256(encode({RAW})) AS sha, count(*) AS expected FROM events WHERE event_id % 7 <> 0 GROUP BY 1), f AS (SELECT sha256(encode({RAW})) AS sha, count(*) AS found FROM events WHERE event_id % 11 <> 0 GROUP BY 1)
SELECT coalesce(m.sha, f.sha) AS sha, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM m FULL JOIN f ON m.sha = f.sha WHERE coalesce(expected, 0) <> coalesce(found, 0)""")
def reconcile_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select((F.col("record_id") - 1).alias("e"), F.sha2("raw", 256).alias("sha"))
    return ledger.reconcile(rows.filter("e % 11 != 0"), rows.filter("e % 7 != 0"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity facts from ``events``: an error releases, any other event binds."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.array(F.lit("dhcp"), F.lit("radius"), F.lit("vpn")), (e % 3 + 1).cast("int"))
    return events(spark, sf_dir).select(
        e.alias("record_id"), kind.alias("kind"), F.when(F.col("event_type") == "error", "release").otherwise("bind").alias("action"), F.format_string("10.0.0.%d", e % 20).alias("ip"),
        F.concat(F.lit("u"), u % 3).alias("user"), F.concat(F.lit("h"), u % 3).alias("host"), F.format_string("AA:00:00:00:00:0%d", u % 3).alias("mac"), F.col("ts").alias("at"),
    )


FACTS = "SELECT event_id AS record_id, ['dhcp', 'radius', 'vpn'][event_id % 3 + 1] AS kind, CASE WHEN event_type = 'error' THEN 'release' ELSE 'bind' END AS action, '10.0.0.' || (event_id % 20) AS ip, user_id % 3 AS who, ts AS mo FROM events"
CLAIMS = f"""facts AS ({FACTS}),
f1 AS (SELECT *, CASE kind WHEN 'dhcp' THEN INTERVAL 8 HOUR ELSE INTERVAL 12 HOUR END AS ttl, lag(action) OVER w AS pa, lag(who) OVER w AS pw, lag(mo) OVER w AS pt, lead(mo) OVER w AS nx FROM facts WINDOW w AS (PARTITION BY ip, kind ORDER BY mo, record_id)),
f2 AS (SELECT *, sum(CASE WHEN action = 'bind' AND NOT coalesce(pa = 'bind' AND pw = who AND mo < pt + ttl, false) THEN 1 ELSE 0 END) OVER (PARTITION BY ip, kind ORDER BY mo, record_id) AS c FROM f1),
f3 AS (SELECT ip, kind, c, min(who) AS who, min(mo) AS valid_from, max(mo + ttl) AS e, arg_max_null(nx, mo) AS closer, min(record_id) AS record_id FROM f2 WHERE action = 'bind' GROUP BY ip, kind, c),
f4 AS (SELECT *, coalesce(closer <= e, false) AS closed, CASE WHEN coalesce(closer <= e, false) THEN closer ELSE e END AS valid_to FROM f3),
claims AS (SELECT ip, kind, 'u' || who AS "user", 'h' || who AS host, valid_from, valid_to, closed, record_id FROM f4 WHERE valid_to > valid_from)"""


@query("SELECT ['dhcp', 'radius', 'vpn'][event_id % 3 + 1] AS kind, CASE WHEN event_type = 'error' THEN 'release' ELSE 'bind' END AS action, count(*) AS n, count(DISTINCT '10.0.0.' || (event_id % 20)) AS ips FROM events GROUP BY ALL")
def identity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("kind", "action").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ip").alias("ips"))


@query("SELECT event_id AS record_id FROM events WHERE event_id % 7 NOT IN (1, 3, 4)")
def valid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("record_id") % 7
    rows = facts(spark, sf_dir)
    odd = rows.withColumns({"ip": F.when(e == 1, "8.8.8.8").when(e == 2, "172.20.1.1").when(e == 4, "127.0.0.1").when(e == 5, "FE80::1").when(e == 6, "fd12:3456::7").otherwise(F.col("ip")), "kind": F.when(e == 3, "arp").otherwise(F.col("kind"))})
    return identity.valid_facts(odd.union(odd)).select("record_id")


@query(f"""WITH f AS (SELECT event_id AS record_id, user_id, CASE WHEN event_type = 'error' THEN 'release' ELSE 'bind' END AS action, CASE WHEN event_type = 'error' THEN '' ELSE '10.0.0.' || (event_id % 20) END AS ip FROM events),
l AS (SELECT *, lag(action) OVER (PARTITION BY user_id ORDER BY record_id) AS pa, lag(ip) OVER (PARTITION BY user_id ORDER BY record_id) AS pip FROM f)
SELECT record_id, action, CASE WHEN action = 'bind' THEN ip ELSE pip END AS ip FROM l WHERE action = 'bind' OR pa = 'bind'""")
def vpn_release_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_id").alias("record_id"), F.lit("vpn").alias("kind"), F.when(F.col("event_type") == "error", "release").otherwise("bind").alias("action"), F.when(F.col("event_type") == "error", "").otherwise(F.format_string("10.0.0.%d", F.col("event_id") % 20)).alias("ip"), F.col("user_id").cast("string").alias("user"), F.lit("peer").alias("host"))
    return identity.complete_vpn(rows).select("record_id", "action", "ip")


@query(f"""WITH {CLAIMS} SELECT ip, kind, "user", epoch_us(valid_from) AS valid_from, epoch_us(valid_to) AS valid_to, closed, record_id FROM claims""")
def identity_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.claims(facts(spark, sf_dir)).select("ip", "kind", "user", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_to").alias("valid_to"), "closed", "record_id")


ASKED = "SELECT event_id AS id, '10.0.0.' || (user_id % 25) AS ip, ts + INTERVAL 7 MINUTE AS mo FROM events"
RESOLVED = f"""WITH {CLAIMS}, asked AS ({ASKED}), cov AS (SELECT a.id, c.* FROM asked a JOIN claims c ON a.ip = c.ip AND a.mo >= c.valid_from AND a.mo < c.valid_to),
u AS (SELECT id, max_by("user", (valid_from, kind = 'radius', record_id)) AS "user", CASE WHEN count(DISTINCT "user") > 1 THEN 0.7 ELSE 1.0 END AS confidence, count(DISTINCT record_id) AS evidence FROM cov WHERE kind <> 'dhcp' GROUP BY id),
d AS (SELECT id, max_by(host, (valid_from, record_id)) AS host FROM cov WHERE kind = 'dhcp' GROUP BY id)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.format_string("10.0.0.%d", F.col("user_id") % 25).alias("ip"), (F.col("ts") + F.expr("INTERVAL 7 MINUTE")).alias("at"))


@query(f"""{RESOLVED} SELECT a.id, u."user", CAST(u.confidence AS DOUBLE) AS confidence, u.evidence, d.host FROM asked a LEFT JOIN u ON a.id = u.id LEFT JOIN d ON a.id = d.id""")
def resolve_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identity.resolve(asked(spark, sf_dir), identity.claims(facts(spark, sf_dir)), "id")
    return out.select("id", "user", "confidence", F.when(F.col("user").isNotNull(), F.size("evidence")).cast("bigint").alias("evidence"), "host")


@query(f"""{RESOLVED} SELECT a.id, CAST((CASE WHEN u."user" IS NULL THEN 0 ELSE 1 END) + (CASE WHEN d.host IS NULL THEN 0 ELSE 2 END) AS INTEGER) AS entities FROM asked a LEFT JOIN u ON a.id = u.id LEFT JOIN d ON a.id = d.id""")
def enrich_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identity.resolve(asked(spark, sf_dir), identity.claims(facts(spark, sf_dir)), "id")
    entity = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(c).alias("name")))
    return out.select("id", F.size(F.array_compact(F.array(entity("user", "user"), entity("host", "host"), entity("mac", "mac")))).alias("entities"))


@query(f"""WITH {CLAIMS}, u AS (SELECT * FROM claims WHERE kind <> 'dhcp')
SELECT a.record_id, a.kind, a."user", CAST(CASE WHEN EXISTS (SELECT 1 FROM u b WHERE b.ip = a.ip AND b."user" <> a."user" AND b.valid_from < a.valid_to AND a.valid_from < b.valid_to) THEN 0.7 ELSE 1.0 END AS DOUBLE) AS confidence FROM u a""")
def identity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.timeline(identity.claims(facts(spark, sf_dir))).select("record_id", "kind", "user", "confidence")


@query(f"""WITH {CLAIMS}, u AS (SELECT * FROM claims WHERE kind <> 'dhcp')
SELECT ip, record_id, "user", lag("user") OVER w AS previous_user, epoch_us(valid_from) // 1000000 - epoch_us(lag(valid_to) OVER w) // 1000000 AS gap_seconds FROM u WINDOW w AS (PARTITION BY ip ORDER BY valid_from, record_id)""")
def reassignment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.reassignments(identity.claims(facts(spark, sf_dir)))


@query(f"""WITH {CLAIMS}, e AS (SELECT 'ip:' || ip AS source, 'user:' || "user" AS target, 'used_by' AS kind, valid_from, valid_to FROM claims UNION ALL SELECT 'ip:' || ip, 'host:' || host, 'held_by', valid_from, valid_to FROM claims
UNION ALL SELECT 'ip:' || ip, 'mac:AA:00:00:00:00:0' || substr(host, 2), 'seen_on', valid_from, valid_to FROM claims UNION ALL SELECT 'host:' || host, 'mac:AA:00:00:00:00:0' || substr(host, 2), 'has', valid_from, valid_to FROM claims)
SELECT source, target, kind, epoch_us(min(valid_from)) AS first, epoch_us(max(valid_to)) AS last FROM e GROUP BY ALL""")
def identity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = identity.graph_edges(identity.claims(facts(spark, sf_dir)))
    return g.select("source", "target", "kind", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes when a late share of the facts arrives."""
    every = facts(spark, sf_dir)
    return identity.changed_windows(identity.claims(every.filter("record_id % 10 != 4")), identity.claims(every))


def claims_sql(name: str, where: str) -> str:
    """The claims of a part of the facts, under names of their own."""
    out = CLAIMS.replace("FROM events", f"FROM events WHERE {where}")
    for k in ("facts", "f1", "f2", "f3", "f4"):
        out = out.replace(f"{k} AS (", f"{name}_{k} AS (").replace(f"FROM {k} ", f"FROM {name}_{k} ").replace(f"FROM {k})", f"FROM {name}_{k})")
    return out.replace("claims AS (", f"{name} AS (")


WINDOWS = f"""{claims_sql('old', 'event_id % 10 <> 4')}, {claims_sql('new', 'true')},
both_ AS (SELECT *, 'old' AS side FROM old WHERE kind <> 'dhcp' UNION ALL SELECT *, 'new' FROM new WHERE kind <> 'dhcp'),
edges AS (SELECT ip, valid_from AS t FROM both_ UNION SELECT ip, valid_to FROM both_),
spans AS (SELECT ip, t AS a, lead(t) OVER (PARTITION BY ip ORDER BY t) AS b FROM edges),
ans AS (SELECT s.ip, s.a, s.b, max_by(c."user", (c.valid_from, c.kind = 'radius', c.record_id)) FILTER (side = 'old') AS o, max_by(c."user", (c.valid_from, c.kind = 'radius', c.record_id)) FILTER (side = 'new') AS n
  FROM spans s JOIN both_ c ON c.ip = s.ip AND c.valid_from <= s.a AND s.a < c.valid_to WHERE s.b IS NOT NULL GROUP BY s.ip, s.a, s.b),
dif AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY ip ORDER BY a) = a THEN 0 ELSE 1 END AS fresh FROM ans WHERE o IS DISTINCT FROM n),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY ip ORDER BY a) AS g FROM dif), win AS (SELECT ip, min(a) AS f, max(b) AS t FROM isl GROUP BY ip, g)"""


@query(f"WITH {WINDOWS} SELECT ip, epoch_us(f) AS from_us, epoch_us(t) AS to_us FROM win")
def invalidation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("ip", F.unix_micros("from").alias("from_us"), F.unix_micros("to").alias("to_us"))


@query(f"WITH {WINDOWS}, asked AS ({ASKED}) SELECT DISTINCT a.id FROM asked a JOIN win w ON a.ip = w.ip AND a.mo >= w.f AND a.mo < w.t")
def reenrich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = windows(spark, sf_dir).select("ip", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), F.lit(0).alias("record_id"))
    return identity.covering(asked(spark, sf_dir), spans).select("id").distinct()


@query(f"""{RESOLVED} SELECT (a.id % 3) AS part, count(*) AS cases, CAST(sum(CASE WHEN u."user" IS NOT DISTINCT FROM 'u0' THEN 1 ELSE 0 END) AS BIGINT) AS right_cases, CAST(sum(CASE WHEN u."user" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS none FROM asked a LEFT JOIN u ON a.id = u.id GROUP BY 1""")
def identity_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identity.resolve(asked(spark, sf_dir), identity.claims(facts(spark, sf_dir)), "id")
    return out.groupBy((F.col("id") % 3).alias("part")).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("user").eqNullSafe(F.lit("u0"))).alias("right_cases"), F.count_if(F.col("user").isNull()).alias("none"))


PAGE, EVERY, SEED = 100, 4, bytes(range(32))  # records of a segment, segments between checkpoints, and the fixture's signing key


def proven(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bundles of the key=value events with forgeries by id, the seals that lead to their checkpoints, and the ledger."""
    lines = kv_lines(spark, sf_dir).withColumn("record_id", F.col("record_id") + 1)
    e = F.col("record_id") - 1
    body = lambda raw: ledger.canonical_body(F.col("record_id"), F.unix_micros("received_at") * 1000, F.col("source_id"), F.lit(2), F.lit("file"), F.col("record_id"), raw)
    rows = lines.withColumn("segment", ledger.segment_of(F.col("record_id"), PAGE))
    leaf = rows.select("segment", "record_id", ledger.leaf_hash(body(F.col("raw"))).alias("leaf"))
    book = stored(ledger.seals(leaf), "ledger")
    states = book.filter(F.col("segment") % EVERY == 0).select(F.lower(F.hex("chain")).alias("head"), F.col("last_seq").alias("sealed_through"), F.col("segment").alias("segments"), F.col("segment").cast("string").alias("signed_at"))
    forged = F.when(F.col("segments") / EVERY % 5 == 2, F.unhex(F.lit("AB" * 64))).otherwise(F.col("signature"))
    log = checkpoints.checked(checkpoints.signed(states, SEED).withColumn("signature", forged), checkpoints.public_key(SEED))
    runs = evidence.runs(book.withColumn("root", F.when(F.col("segment") % 12 == 7, ledger.sha(F.col("root"))).otherwise(F.col("root"))), stored(log, "checkpoints"))
    fine = normalize.split(normalize.normalize(lines, [KV_SPEC]))[0]
    version = F.when(e % 43 == 9, "0.9.0").otherwise(F.col("event.parser_version"))
    served = fine.select(
        "record_id", F.sha2(F.col("raw").cast("binary"), 256).alias("raw_sha256"), F.when(e % 31 == 4, "other").otherwise(F.col("source_id")).alias("source_id"), F.col("event.parser_id").alias("parser_id"), version.alias("parser_version"),
        F.when(e % 23 == 7, "{}").otherwise(evidence.claim(F.col("event"))).alias("claim"),
    )
    raw = F.when(e % 19 == 5, F.lit("forged")).otherwise(F.col("raw"))
    held = rows.select("record_id", "segment", "source_id", "received_at", raw.cast("binary").alias("raw"), body(raw).alias("body"))
    proofs = ledger.inclusion_paths(leaf).filter(e % 29 != 3)
    made = evidence.bundles(held, served, proofs, book, evidence.walk(runs))
    of = F.col("event.record_id") - 1
    bad = F.when(of % 37 == 6, F.col("proof").withField("root", F.unhex(F.lit(ledger.ZERO)))).when(of % 41 == 8, F.col("proof").withField("chain", F.unhex(F.lit(ledger.ZERO)))).otherwise(F.col("proof"))
    return made.withColumn("proof", bad), runs, book


@query(f"""WITH b AS (SELECT event_id AS e, event_id // {PAGE} + 1 AS seg, (event_id // {PAGE} + {EVERY}) // {EVERY} AS cp, max(event_id // {PAGE} + 1) OVER () AS segs FROM events),
v AS (SELECT *, e % 29 = 3 AS open, CASE WHEN e % 29 = 3 OR cp * {EVERY} > segs THEN 'skip' WHEN cp % 5 = 2 OR seg % 12 IN (5, 6) OR (e % 37 <> 6 AND e % 41 = 8) THEN 'fail' ELSE 'pass' END AS covered FROM b JOIN events ON e = event_id WHERE {KV_OK})
SELECT CASE WHEN e % 19 = 5 THEN 'fail' ELSE 'pass' END AS raw_hash, CASE WHEN e % 31 = 4 THEN 'fail' ELSE 'pass' END AS record, CASE WHEN open THEN 'skip' WHEN e % 19 = 5 THEN 'fail' ELSE 'pass' END AS leaf,
  CASE WHEN open THEN 'skip' WHEN e % 37 = 6 THEN 'fail' ELSE 'pass' END AS inclusion, CASE WHEN open THEN 'skip' WHEN e % 37 = 6 OR e % 41 = 8 THEN 'fail' ELSE 'pass' END AS chain, CASE WHEN open THEN 'skip' ELSE 'pass' END AS anchor,
  CASE WHEN e % 43 = 9 THEN 'skip' WHEN e % 23 = 7 OR e % 19 = 5 THEN 'fail' ELSE 'pass' END AS derived, covered, CASE WHEN covered = 'pass' THEN 'pass' ELSE 'skip' END AS trusted,
  CASE WHEN open OR cp * {EVERY} > segs THEN NULL WHEN cp % 5 = 2 THEN 'the checkpoint''s signature is not right' WHEN seg % 12 IN (5, 6) THEN 'the chain breaks at segment ' || (seg + 7 - seg % 12) WHEN e % 37 <> 6 AND e % 41 = 8 THEN 'the chain does not go on from the record''s seal' END AS problem, count(*) AS n FROM v GROUP BY ALL""")
def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _, book = proven(spark, sf_dir)
    head = evidence.head(book)
    checked = evidence.checks(made, [KV_SPEC], trusted=checkpoints.public_key(SEED), anchor=head, head=head)
    return checked.groupBy(*[F.col("checks")[k].alias(k) for k in evidence.CHECKS], "problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT event_id // {PAGE} + 1 AS segment, max(event_id // {PAGE} + 1) OVER () AS segs FROM events), c AS (SELECT DISTINCT segment, (segment + {EVERY} - 1) // {EVERY} * {EVERY} AS last FROM s WHERE (segment + {EVERY} - 1) // {EVERY} * {EVERY} <= segs)
SELECT segment, last AS "to", last - segment AS links, CAST(coalesce(list_sum(range(segment + 1, last + 1)), 0) AS BIGINT) AS segments FROM c""")
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, runs, _ = proven(spark, sf_dir)
    ways = evidence.links(runs, runs).join(runs.select("segment", F.col("checkpoint.segments").alias("to")), "segment")
    total = F.aggregate("links", F.lit(0).cast("bigint"), lambda a, s: a + s["segment"])
    return ways.select("segment", "to", F.size("links").cast("bigint").alias("links"), total.alias("segments"))


RULE = {"kind": "radius", "when": {"field": "action", "in": ["purchase", "error", "view"]}, "action": {"field": "action", "enum": {"purchase": "bind", "view": "bind", "error": "release"}}, "ip": "ip", "user": "user", "host": "note"}


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity facts that the fields of key=value lines tell."""
    lines = kv_lines(spark, sf_dir).withColumn("x", extract.kv(F.col("raw")))
    time = F.try_element_at("x.fields", F.lit("ts")).try_cast("bigint")
    fact = identity.facts_of(F.col("x.fields"), RULE, F.col("received_at"), F.when(F.col("record_id") % 3 != 0, time))
    return lines.withColumn("fact", fact).filter("fact is not null").select("fact.*", "record_id", "source_id")


@query("""SELECT event_id AS record_id, 'radius' AS kind, CASE event_type WHEN 'error' THEN 'release' ELSE 'bind' END AS action, CASE WHEN event_id % 11 <> 0 THEN '10.0.' || (user_id % 4) || '.' || (event_id % 250) ELSE '' END AS ip, 'u' || user_id AS "user", CASE WHEN event_id % 17 = 0 THEN 'open end' ELSE '' END AS host,
  CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) ELSE epoch_us(ts) // 1000 * 1000 END AS at_us FROM events WHERE event_type IN ('purchase', 'error', 'view')""")
def identity_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).select("record_id", "kind", "action", "ip", "user", "host", F.unix_micros("at").alias("at_us"))


@query("""WITH f AS (SELECT event_id AS record_id, CASE event_type WHEN 'error' THEN 'release' ELSE 'bind' END AS action, '10.0.' || (user_id % 4) || '.' || (event_id % 250) AS ip, user_id AS who, CASE WHEN event_id % 17 = 0 THEN 'open end' ELSE '' END AS host, CASE WHEN event_id % 3 = 0 THEN ts ELSE to_timestamp(epoch_us(ts) // 1000 / 1000.0)::TIMESTAMP END AS mo, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) ELSE epoch_us(ts) // 1000 * 1000 END AS us FROM events WHERE event_type IN ('purchase', 'error', 'view') AND event_id % 11 <> 0),
w AS (SELECT *, lag(action) OVER o AS pa, lag((who, host)) OVER o AS pw, lag(us) OVER o AS pt, lead(us) OVER o AS nx FROM f WINDOW o AS (PARTITION BY ip ORDER BY us, record_id)),
c AS (SELECT *, sum(CASE WHEN action = 'bind' AND NOT coalesce(pa = 'bind' AND pw = (who, host) AND us < pt + 43200000000, false) THEN 1 ELSE 0 END) OVER (PARTITION BY ip ORDER BY us, record_id) AS c FROM w),
g AS (SELECT ip, c, arg_min(who, (us, record_id)) AS who, min(us) AS valid_from, max(us) + 43200000000 AS e, arg_max_null(nx, (us, record_id)) AS closer FROM c WHERE action = 'bind' GROUP BY ip, c)
SELECT ip, 'u' || who AS "user", valid_from, CASE WHEN coalesce(closer <= e, false) THEN closer ELSE e END AS valid_to FROM g WHERE CASE WHEN coalesce(closer <= e, false) THEN closer ELSE e END > valid_from""")
def identity_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.rebuild(told(spark, sf_dir)).select("ip", "user", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_to").alias("valid_to"))


EDGES = f"""{CLAIMS}, ed AS (SELECT DISTINCT 'ip-host' AS type, ip AS a, host AS b, valid_from FROM claims WHERE kind = 'dhcp' UNION SELECT 'host-mac', host, 'AA:00:00:00:00:0' || substr(host, 2), valid_from FROM claims WHERE kind = 'dhcp' UNION SELECT 'ip-user', ip, "user", valid_from FROM claims WHERE kind <> 'dhcp'),
ask AS (SELECT DISTINCT 'ip' AS kind, '10.0.0.' || (n_nationkey % 20) AS id FROM nation UNION SELECT 'user', 'u1' UNION SELECT 'host', 'h2'),
hit AS (SELECT k.kind, k.id, ed.* FROM ask k JOIN ed ON (k.kind = 'ip' AND ed.type <> 'host-mac' AND ed.a = k.id) OR (k.kind = 'user' AND ed.type = 'ip-user' AND ed.b = k.id) OR (k.kind = 'host' AND ((ed.type = 'ip-host' AND ed.b = k.id) OR (ed.type = 'host-mac' AND ed.a = k.id)))),
nb AS (SELECT * FROM hit UNION SELECT h.kind, h.id, ed.* FROM (SELECT DISTINCT kind, id, b FROM hit WHERE type = 'ip-host' AND kind <> 'host') h JOIN ed ON ed.type = 'host-mac' AND ed.a = h.b)"""


def around(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.lit("ip").alias("kind"), F.format_string("10.0.0.%d", F.col("n_nationkey") % 20).alias("id"))
    known = nations.unionByName(table(spark, sf_dir, "region").limit(1).select(F.explode(F.array(F.struct(F.lit("user").alias("kind"), F.lit("u1").alias("id")), F.struct(F.lit("host").alias("kind"), F.lit("h2").alias("id")))).alias("n")).select("n.*"))
    return identity.neighbours(identity.claims(facts(spark, sf_dir)), known)


@query(f"WITH {EDGES} SELECT kind, id, type, a, b, epoch_us(valid_from) AS valid_from FROM nb")
def identity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return around(spark, sf_dir).select("kind", "id", "type", "a", "b", F.unix_micros("valid_from").alias("valid_from")).distinct()


@query(f"WITH {EDGES} SELECT CASE type WHEN 'host-mac' THEN 'host' ELSE 'ip' END AS kind, a AS id FROM nb UNION SELECT CASE type WHEN 'host-mac' THEN 'mac' WHEN 'ip-host' THEN 'host' ELSE 'user' END, b FROM nb")
def identity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.nodes(around(spark, sf_dir))


@query(f"""{RESOLVED.replace(f'asked AS ({ASKED})', "asked AS (SELECT event_id * 2 AS id, '10.0.0.' || (user_id % 25) AS ip, ts + INTERVAL 7 MINUTE AS mo FROM events UNION ALL SELECT event_id * 2 + 1, '10.0.0.' || (event_id % 22), ts + INTERVAL 7 MINUTE FROM events WHERE event_id % 4 <> 0)")},
l AS (SELECT a.id // 2 AS id, a.id % 2 AS side, u."user", d.host FROM asked a LEFT JOIN u ON a.id = u.id LEFT JOIN d ON a.id = d.id),
x AS (SELECT id, side, 0 AS o, 'user:' || "user" AS e FROM l WHERE "user" IS NOT NULL UNION ALL SELECT id, side, 1, 'host:' || host FROM l WHERE host IS NOT NULL UNION ALL SELECT id, side, 2, 'mac:aa:00:00:00:00:0' || substr(host, 2) FROM l WHERE host IS NOT NULL)
SELECT e.event_id AS id, coalesce(string_agg(CASE side WHEN 0 THEN 'src' ELSE 'dst' END || ':' || x.e, ' ' ORDER BY side, o), '') AS entities FROM events e LEFT JOIN x ON x.id = e.event_id GROUP BY 1""")
def enrich_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(e.alias("id"), F.format_string("10.0.0.%d", F.col("user_id") % 25).alias("src_ip"), F.when(e % 4 != 0, F.format_string("10.0.0.%d", e % 22)).alias("dst_ip"), (F.col("ts") + F.expr("INTERVAL 7 MINUTE")).alias("at"))
    out = identity.entities(rows, identity.claims(facts(spark, sf_dir)), "id")
    text = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["role"], x["type"], x["id"])), " ")
    return out.select("id", F.coalesce(text, F.lit("")).alias("entities"))
