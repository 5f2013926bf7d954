"""Event versions, quarantine, spec versions, and the queries an analyst asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 500


def current_versions(events: DataFrame) -> DataFrame:
    """Events (event_id, record_id, arrival, ...) once each, the first arrival of an id counts; the last id to arrive of a record is current."""
    once = events.groupBy("event_id", "record_id").agg(F.min("arrival").alias("arrival"))
    last = once.groupBy("record_id").agg(F.max(F.struct("arrival", "event_id")).alias("_last"))
    return once.join(last, "record_id").withColumn("is_current", F.col("_last.event_id") == F.col("event_id")).drop("_last")


def resolve_quarantine(quarantine: DataFrame, parsed: DataFrame) -> DataFrame:
    """Open quarantine rows whose record has an event now become resolved by it."""
    by = parsed.groupBy("record_id").agg(F.max("event_id").alias("_event"))
    done = (F.col("status") == "open") & F.col("_event").isNotNull()
    out = quarantine.join(by, "record_id", "left")
    return out.withColumn("resolved_by", F.when(done, F.col("_event"))).withColumn("status", F.when(done, "resolved").otherwise(F.col("status"))).drop("_event")


def replay(lines: DataFrame, quarantine: DataFrame, parse) -> DataFrame:
    """Lines of the open quarantine through ``parse`` again."""
    return parse(lines.join(quarantine.filter("status = 'open'").select("record_id"), "record_id", "left_semi"))


def quarantine_summary(quarantine: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("open", "resolved", "ignored")]
    stages = [F.count_if((F.col("status") == "open") & (F.col("failure_stage") == s)).alias(f"open_{s}") for s in ("detect", "extract", "normalize")]
    return quarantine.groupBy("source_id").agg(*counts, *stages)


def version_key(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def active_specs(history: DataFrame) -> DataFrame:
    """(spec_id, version): the version that the last approval or rollback points to; rejections change nothing."""
    moved = history.filter("action in ('approve', 'rollback')")
    return moved.groupBy("spec_id").agg(F.max_by("to_version", F.struct("changed_at", "seq")).alias("version"))


def event_page(events: DataFrame, limit: int, cursor: tuple[int, str] | None = None, where: Column | None = None, source: str | None = None, parser: str | None = None, current: bool = False, received_from=None, received_to=None) -> DataFrame:
    """Newest first by (record_id, event_id), after the cursor, of what the filters let through (times of receipt are inclusive). The last row's
    ``next_cursor`` is its event id where there is a further page, null else; a limit that isn't within 1 to 500 is 100."""
    limit = limit if 0 < limit <= MAX_PAGE else 100
    out = events if where is None else events.filter(where)
    given = {"source_id": source, "parser_id": parser}
    for column, value in given.items():
        out = out if value is None else out.filter(F.col(column) == value)
    out = out.filter("is_current") if current else out
    out = out if received_from is None else out.filter(F.col("received_at") >= F.lit(received_from))
    out = out if received_to is None else out.filter(F.col("received_at") <= F.lit(received_to))
    if cursor:
        record, event = cursor
        out = out.filter((F.col("record_id") < record) | ((F.col("record_id") == record) & (F.col("event_id") < event)))
    page = out.orderBy(F.desc("record_id"), F.desc("event_id")).limit(limit + 1)  # one more says that there is a next page
    numbered = page.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("record_id"), F.desc("event_id")))).withColumn("_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    last = (F.col("_n") == limit) & F.col("_more")
    return numbered.filter(F.col("_n") <= limit).withColumn("next_cursor", F.when(last, F.col("event_id").cast("string"))).drop("_n", "_more")


def tail_since(events: DataFrame, since: int, limit: int = 100, order: str = "seq") -> DataFrame:
    """The oldest events after ``since``, in order of arrival."""
    return events.filter(F.col(order) > since).orderBy(order).limit(limit)


def event_totals(events: DataFrame) -> DataFrame:
    """Events, and the highest record id (0: none)."""
    return events.agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.max("record_id"), F.lit(0)).cast("bigint").alias("max_record_id"))


def current_event(events: DataFrame, records: DataFrame) -> DataFrame:
    """The current events of the records asked for (record_id); a record without an event has none."""
    return events.filter("is_current").join(records.select("record_id").distinct(), "record_id", "left_semi")


def proposal_states(proposals: DataFrame, actions: DataFrame) -> DataFrame:
    """(id, status) of proposals (id) after their actions (id, seq, action): pending first. A rejection counts only while it is pending; an approval
    makes it approved, or stale where its base version was no longer active (``conflict``)."""
    moved = actions.withColumn("to", F.when(F.col("action") == "reject", "rejected").when(F.col("action") == "conflict", "stale").when(F.col("action") == "approve", "approved")).filter("to is not null")
    last = moved.filter("to != 'rejected'").groupBy("id").agg(F.max_by("to", "seq").alias("_last"))
    out = moved.filter("to = 'rejected'").groupBy("id").agg(F.min("seq").alias("_no"))
    joined = proposals.select("id").join(last, "id", "left").join(out, "id", "left")
    # an approval goes through whatever the status; a rejection needs a proposal that nothing else has moved
    return joined.select("id", F.coalesce("_last", F.when(F.col("_no").isNotNull(), "rejected"), F.lit("pending")).alias("status"))


def event_filter(ip: str | None = None, source: str | None = None, severity: list[int] | None = None, flag: str | None = None, since=None, until=None, src_ip: str | None = None, dst_ip: str | None = None, vendor: str | None = None, user: str | None = None, host: str | None = None, action: int | None = None, current: bool = False) -> Column:
    """Conjunction of what is given: address on either or one side, vendor, source, severities, action, an integrity flag, a user or host among the
    entities, a half-open span of event time, current events only."""
    out = F.lit(True)
    for column, value in (("src_ip", src_ip), ("dst_ip", dst_ip), ("vendor", vendor), ("action_id", action)):
        if value is not None:
            out = out & F.coalesce(F.col(column) == value, F.lit(False))
    for kind, value in (("user", user), ("host", host)):
        if value is not None:
            wanted = F.array_contains(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["id"])), f"{kind}:{value}")
            out = out & F.coalesce(wanted, F.lit(False))
    if current:
        out = out & F.col("is_current")
    if ip is not None:
        out = out & ((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    if source is not None:
        out = out & (F.col("source_id") == source)
    if severity is not None:
        out = out & F.col("severity").isin(severity)
    if flag is not None:
        out = out & F.array_contains("flags", flag)
    if since is not None:
        out = out & (F.col("event_time") >= F.lit(since))
    if until is not None:
        out = out & (F.col("event_time") < F.lit(until))
    return out


def telemetry_totals(events: DataFrame, quarantine: DataFrame, seals: DataFrame) -> DataFrame:
    """One row: events, open quarantine, the last record that a seal covers (0: none)."""
    a = events.agg(F.count(F.lit(1)).alias("events"))
    b = quarantine.agg(F.count_if(F.col("status") == "open").alias("open_quarantine"))
    c = seals.agg(F.coalesce(F.max("last_seq"), F.lit(0)).cast("bigint").alias("sealed_through"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def telemetry(events: DataFrame) -> DataFrame:
    """Per source: events and their rate over the span of all."""
    span = events.agg((F.max(F.unix_micros("event_time")) - F.min(F.unix_micros("event_time"))).alias("_span"))
    return events.groupBy("source_id").agg(F.count(F.lit(1)).alias("events")).crossJoin(F.broadcast(span)).withColumn("per_second", F.col("events") * 1e6 / F.col("_span")).drop("_span")


def samples(rows: DataFrame, n: int, by: str = "source_id", order: str = "record_id") -> DataFrame:
    """The first n rows of each source; Spark keeps n a task before it moves any."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def first_alerts(alerts: DataFrame) -> DataFrame:
    """The first alert of each source and parser; later ones are the same alert, whatever has become of it."""
    first = alerts.groupBy("source_id", "parser_id").agg(F.min("seq").alias("seq"))
    return alerts.join(first, ["source_id", "parser_id", "seq"], "left_semi")


def review_queue(proposals: DataFrame, alerts: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One list: proposals, then alerts, then sources with open quarantine and their commonest stage (ties by name)."""
    a = proposals.filter("status = 'pending'").select(F.lit(1).alias("rank"), F.lit("proposal").alias("kind"), F.col("id").cast("string").alias("key"), F.lit(None).cast("string").alias("stage"))
    b = alerts.select(F.lit(2).alias("rank"), F.lit("alert").alias("kind"), F.col("id").cast("string").alias("key"), F.lit(None).cast("string").alias("stage"))
    stages = quarantine.filter("status = 'open'").groupBy("source_id", "failure_stage").agg(F.count(F.lit(1)).alias("n"))
    best = stages.groupBy("source_id").agg(F.min_by("failure_stage", F.struct(-F.col("n"), F.col("failure_stage"))).alias("stage"))
    # shown by rank, the newest key first
    return a.unionByName(b).unionByName(best.select(F.lit(3).alias("rank"), F.lit("quarantine").alias("kind"), F.col("source_id").alias("key"), "stage"))
