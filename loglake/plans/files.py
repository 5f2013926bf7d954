"""Queries of byte-accurate framing: files that Spark writes from ``events`` are scanned back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.plans.lines import events
from loglake.plans.registry import query
from loglake.session import shared_dir
from loglake.sources import framed

LINE = "event_type || ':' || user_id || ':' || repeat('x', event_id % 150)"


def line():
    return F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.repeat(F.lit("x"), (F.col("event_id") % 150).cast("int")))


def written(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files of a thousand lines, every third line ended by a carriage return as well."""
    where = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(F.floor(e / 1000).alias("bucket"), "event_id", F.concat(line(), F.when(e % 3 == 0, "\r").otherwise("")).alias("value"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "event_id").select("bucket", "value").write.partitionBy("bucket").text(where)
    return where


def bucket():
    return F.regexp_extract("addr", "bucket=([0-9]+)", 1).cast("bigint").alias("bucket")


@query(f"""WITH l AS (SELECT event_id, event_id // 1000 AS bucket, {LINE} || CASE WHEN event_id % 3 = 0 THEN chr(13) ELSE '' END AS line FROM events),
o AS (SELECT *, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY bucket ORDER BY event_id) - length(line) - 1 AS pos FROM l), p AS (SELECT *, greatest(1, (n + 63) // 64) AS parts, unnest(range(0, greatest(1, (n + 63) // 64))) AS k FROM o),
r AS (SELECT *, k = parts - 1 AS last, CASE WHEN k = parts - 1 AND event_id % 3 = 0 THEN left(substr(line, k * 64 + 1, 64), -1) ELSE substr(line, k * 64 + 1, 64) END AS raw FROM p)
SELECT bucket, CAST(pos + k * 64 AS BIGINT) AS "offset", CASE WHEN NOT last THEN 'none' WHEN event_id % 3 = 0 THEN 'crlf' ELSE 'lf' END AS term, CAST((CASE WHEN last THEN 0 ELSE 1 END) + (CASE WHEN k > 0 THEN 2 ELSE 0 END) AS INTEGER) AS frag, md5(raw) AS raw_md5 FROM r""")
def frame_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = framed.scan(spark, [f"{written(spark, sf_dir)}/bucket=*/part-*"], "lines", max_frame=64, range_bytes=10_000)
    return found.select(bucket(), "offset", "term", "frag", F.md5("raw").alias("raw_md5"))


@query(f"""WITH l AS (SELECT event_id // 1000 AS bucket, count(*) AS records, CAST(sum(length({LINE}) + 1 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bytes FROM events GROUP BY 1) SELECT bucket, records, bytes FROM l""")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files by a glob, and another that matches nothing: each record is found once, whatever the ranges."""
    where = written(spark, sf_dir)
    found = framed.scan(spark, [f"{where}/bucket=*/part-*", f"{where}/none-*"], "lf", range_bytes=4_096)
    return found.groupBy(bucket()).agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("raw") + 1).cast("bigint").alias("bytes"))


@query(f"""SELECT event_id // 1000 AS bucket, sha256(string_agg({LINE} || CASE WHEN event_id % 3 = 0 THEN chr(13) ELSE '' END || chr(10), '' ORDER BY event_id)) AS body_sha256 FROM events GROUP BY 1""")
def whole_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed.whole(spark, [f"{written(spark, sf_dir)}/bucket=*/part-*"]).select(bucket(), F.sha2("raw", 256).alias("body_sha256"))


MESSAGE = "event_type || ':' || user_id || ':' || repeat('y', event_id % 40)"


@query(f"""WITH m AS (SELECT event_id // 100 AS stream, event_id, {MESSAGE} AS msg FROM events), h AS (SELECT *, length(msg) AS n, length(CAST(length(msg) AS VARCHAR)) + 1 AS head FROM m),
o AS (SELECT *, sum(n + head) OVER (PARTITION BY stream ORDER BY event_id) - n AS pos FROM h), p AS (SELECT *, unnest(range(0, (n + 31) // 32)) AS k FROM o WHERE stream % 7 <> 3),
e AS (SELECT stream, max(pos + n) AS tail FROM o GROUP BY 1)
SELECT stream, CAST(pos + k * 32 AS BIGINT) AS "offset", CAST((CASE WHEN (k + 1) * 32 < n THEN 1 ELSE 0 END) + (CASE WHEN k > 0 THEN 2 ELSE 0 END) AS INTEGER) AS frag, substr(msg, k * 32 + 1, 32) AS raw, NULL AS error FROM p
UNION ALL SELECT stream, 0, 0, '', 'malformed length' FROM e WHERE stream % 7 = 3 UNION ALL SELECT stream, CAST(tail + 4 AS BIGINT), 1, 'short', NULL FROM e WHERE stream % 7 = 5""")
def octet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    msg = F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.repeat(F.lit("y"), (e % 40).cast("int")))
    rows = events(spark, sf_dir).select(F.floor(e / 100).alias("stream"), "event_id", F.concat(F.length(msg).cast("string"), F.lit(" "), msg).alias("frame"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "frame"))), lambda x: x["frame"]), "")
    streams = rows.groupBy("stream").agg(body.alias("body"))
    broken = F.when(F.col("stream") % 7 == 3, F.concat(F.lit("x"), "body")).when(F.col("stream") % 7 == 5, F.concat("body", F.lit("999 short"))).otherwise(F.col("body"))
    found = framed.octet_frames(streams.withColumn("body", broken), "stream", "body", max_frame=32)
    return found.select("stream", "offset", "frag", F.col("raw").cast("string").alias("raw"), "error")


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'octet' WHEN 4 THEN 'octet' ELSE 'lf' END AS mode, count(*) AS n FROM events GROUP BY 1")
def framing_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    head = F.when(e % 5 == 0, F.format_string("%d <34>1", e % 900_000)).when(e % 5 == 1, "<34>1 x").when(e % 5 == 2, F.format_string("1%06d x", e % 1000)).when(e % 5 == 3, " 12 x").otherwise("7 x")
    return events(spark, sf_dir).groupBy(framed.mode_of(head).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
