"""Structured Streaming jobs: tailing files, normalization into tables, rates, de-duplication, multi-line records with a time limit, late identity facts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loglake.operators import identity, normalize
from loglake.sources import exports


def tail(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of files that appear under ``path``: raw, addr (the file), source_id (its folder), received_at. Offsets live in the query's checkpoint."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    addr = F.col("_metadata.file_path")
    return lines.select(F.col("value").alias("raw"), addr.alias("addr"), F.element_at(F.split(addr, "/"), -2).alias("source_id"), F.current_timestamp().alias("received_at"))


def normalize_to(lines: DataFrame, specs: list[dict], events_path: str, quarantine_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Events and quarantine as tables partitioned by batch. A batch that is run again overwrites its own partition, so each line counts once."""

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("record_id", F.xxhash64("addr", "raw") if "addr" in batch.columns else F.xxhash64("raw"))
        parsed = normalize.normalize(keyed, specs).persist()
        events, rest = normalize.split(parsed)
        exports.flat(events).withColumn("unmapped", F.to_json("unmapped")).write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        rest.write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
        parsed.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def rates(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events a source and window of receipt."""
    return events.withWatermark("received_at", late).groupBy(F.window("received_at", width), "source_id").count()


def once(rows: DataFrame, keys: list[str], time: str = "received_at", late: str = "1 hour") -> DataFrame:
    """Repeats of a key within the watermark go; in a batch, all repeats."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def multiline(lines: DataFrame, start: str, wait_ms: int, max_lines: int = 500) -> DataFrame:
    """Records of (source_id, raw) lines that begin where ``start`` matches; a pending record is released after ``wait_ms`` without another line."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = list(state.get[0]) if state.exists else []
        out: list[str] = []
        if state.hasTimedOut:
            out.append("\n".join(pending))
            state.remove()
            yield pd.DataFrame({"source_id": [key[0]] * len(out), "raw": out})
            return
        for batch in batches:
            for line in batch["raw"]:
                if re.search(start, line):
                    if pending:
                        out.append("\n".join(pending))
                    pending = [line]
                elif pending and len(pending) < max_lines:
                    pending.append(line)
                else:
                    out.append(line)
        if pending:
            state.update((pending,))
            state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"source_id": [key[0]] * len(out), "raw": out})

    return lines.groupBy("source_id").applyInPandasWithState(fold, "source_id string, raw string", "pending array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def late_facts(known: DataFrame, fresh: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of the addresses that new facts touch, recomputed, and the rows of ``asked`` (id, ip, at) whose answer these change. Any fact may be late."""
    ips = fresh.select("ip").distinct()
    before = known.join(ips, "ip", "left_semi")
    after = before.unionByName(fresh)
    old, new = identity.claims(identity.valid_facts(before)), identity.claims(identity.valid_facts(after))
    spans = identity.changed_windows(old, new).select("ip", F.col("from").alias("valid_from"), F.col("to").alias("valid_to"), F.lit(0).cast("bigint").alias("record_id"))
    hit = identity.covering(asked.join(ips, "ip", "left_semi"), spans).select("id").distinct()
    return new, asked.join(hit, "id", "left_semi")
