"""The drift loop as a stream: each micro-batch moves the newest lines of the sources on and decides about every source that it touched.

State is four tables in a shared folder, a version a batch: ``window`` (the newest ``LINES`` lines a source), ``baseline`` (the parsed lines of the last
healthy window), ``alerts`` (the open alert of a source) and ``outcomes``. All are bounded by the number of sources but the last, which grows by a row a
source and batch. A version counts once its commit is written; a batch that Spark runs again starts from the version before it and overwrites its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglake.operators import drift
from loglake.streaming.fanout import Store

LINES = 500
WINDOW = "source_id string, record_id bigint, raw string, parsed boolean, parser_id string"
ALERTS = "source_id string, alert_id string, score double, since bigint, proposed boolean"


def sampled(parsed: DataFrame) -> DataFrame:
    """The loop's input, of normalized lines: source_id, record_id, raw, parsed, parser_id."""
    return parsed.select("source_id", "record_id", "raw", F.col("event").isNotNull().alias("parsed"), F.col("event.parser_id").alias("parser_id"))


def newest(rows: DataFrame, n: int = LINES) -> DataFrame:
    """The n lines of each source with the highest ids; Spark keeps n a task before it moves any, so a source with most of the rows is n rows a task. A line
    that is there twice (the same id) counts once."""
    own = Window.partitionBy("source_id", "record_id").orderBy(F.desc("parsed"), "raw")
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("record_id")))).filter(F.col("_n") <= 2 * n)
    once = few.withColumn("_n", F.row_number().over(own)).filter("_n = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("record_id")))).filter(F.col("_n") <= n).drop("_n")


def counted(window: DataFrame) -> DataFrame:
    """(source_id, parsed, quarantined, rate, parser_id): the parser that made most of a source's events."""
    by = window.groupBy("source_id", "parser_id").agg(F.count_if("parsed").alias("p"), F.count_if(~F.col("parsed")).alias("q"))
    best = F.max_by("parser_id", F.struct("p", "parser_id"))
    all_ = by.groupBy("source_id").agg(F.sum("p").alias("parsed"), F.sum("q").alias("quarantined"), F.when(F.max("p") > 0, best).alias("parser_id"))
    return all_.withColumn("rate", F.col("quarantined") / (F.col("parsed") + F.col("quarantined")))


def decisions(window: DataFrame, baseline: DataFrame, open_: DataFrame | None = None, keep: drift.Keep = lambda df, name: df) -> DataFrame:
    """(source_id, parsed, quarantined, parser_id, score, structure, decision) of a window.

    A source with a baseline is scored by how far its lines are from it: the rejected ones, where they are enough for a proposal, else all. One without
    has the rate of rejects as its score. Only key=value and CSV lines need a common structure for a proposal. ``open_`` (source_id, proposed) tells whose open alert has its proposal.
    """
    counts = keep(counted(window), "counts")
    rest = window.filter(~F.col("parsed"))
    known = baseline.select("source_id").distinct()
    now = window.join(counts.select("source_id", (F.col("quarantined") >= drift.CLUSTER).alias("_rest")), "source_id").filter(~F.col("_rest") | ~F.col("parsed")).drop("_rest").join(known, "source_id", "left_semi")
    scores = drift.compared(baseline, now, counts.select("source_id", "rate"), keep).select("source_id", F.col("score").alias("_score"))
    of = keep(rest.join(drift.dominant_kind(rest).select("source_id", "kind"), "source_id"), "rejected")
    listed = of.filter("kind in ('kv', 'csv')")
    keys = keep(drift.fields(listed, F.col("kind")), "keys")
    shares = [drift.dominant_structure(x, keys.join(x.select("source_id").distinct(), "source_id", "left_semi"), csv_lines=c) for c, x in ((False, listed.filter("kind = 'kv'")), (True, listed.filter("kind = 'csv'")))]
    free = of.filter("kind in ('json', 'cef', 'leef', 'text')").select("source_id").distinct().withColumn("share", F.lit(1.0))
    structure = shares[0].unionByName(shares[1]).unionByName(free)
    rows = counts.join(scores, "source_id", "left").join(known.withColumn("_known", F.lit(True)), "source_id", "left").join(structure.withColumnRenamed("share", "structure"), "source_id", "left")
    rows = rows.withColumn("score", F.when(F.col("_known"), F.coalesce("_score", F.lit(0.0))).otherwise(F.round("rate", 4)))
    rows = rows.join(open_.select("source_id", "proposed"), "source_id", "left") if open_ is not None else rows.withColumn("proposed", F.lit(False))
    return rows.join(drift.decide(rows), "source_id").select("source_id", "parsed", "quarantined", "parser_id", "score", "structure", "decision")


class Watch:
    def __init__(self, spark: SparkSession, root: str, lines: int = LINES):
        self.spark, self.store, self.lines = spark, Store(spark, root), lines

    def committed(self) -> list[int]:
        return sorted(int(n) for n in self.store.names("commits") if n.isdigit())

    def table(self, name: str, number: int | None, schema: str) -> DataFrame:
        """A version of a state table; without a number an empty one."""
        if number is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.store.root}/{name}/batch={number}")

    def put(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.store.root}/{name}/batch={number}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.store.root}/{name}/batch={number}")

    def step(self, batch: DataFrame, number: int, closed: DataFrame | None = None) -> None:
        """For ``foreachBatch``. Sources without new lines keep their state; ``closed`` (alert_id) are alerts that people have dealt with."""
        done = self.committed()
        if number in done:
            return
        before = max((n for n in done if n < number), default=None)
        old = lambda name, schema: self.table(name, before, schema)
        rows = batch.select("source_id", F.col("record_id").cast("bigint"), "raw", "parsed", "parser_id").filter("source_id is not null and raw is not null")
        window = self.put(newest(old("window", WINDOW).unionByName(rows), self.lines).select("source_id", "record_id", "raw", "parsed", "parser_id"), "window", number)
        touched = self.put(rows.select("source_id").distinct(), "touched", number)
        baseline, alerts = old("baseline", WINDOW), old("alerts", ALERTS)
        if closed is not None:
            alerts = alerts.join(closed.select("alert_id"), "alert_id", "left_anti")
        seen = window.join(touched, "source_id", "left_semi")
        work = lambda rows, name: self.put(rows, f"work/{name}", number)
        found = decisions(seen, baseline.join(touched, "source_id", "left_semi"), alerts, work)
        kept = alerts.select("source_id", "alert_id", "since", "proposed")
        told = found.join(kept, "source_id", "left").withColumns({
            "alert_id": F.when(F.col("decision").isin("alert", "proposal"), F.coalesce("alert_id", F.concat_ws("-", "source_id", F.lit(number).cast("string")))),
            "since": F.coalesce("since", F.lit(number).cast("bigint")),
        })
        columns = ("source_id", "decision", "score", "structure", "parsed", "quarantined", "parser_id", "alert_id", "since", F.coalesce("proposed", F.lit(False)).alias("proposed"))
        outcomes = self.put(told.select(*columns), "outcomes", number)
        healthy = outcomes.filter("decision = 'baseline'").select("source_id")
        fresh = window.filter("parsed").join(healthy, "source_id", "left_semi")
        self.put(baseline.join(healthy, "source_id", "left_anti").unionByName(fresh), "baseline", number)
        # a source that is healthy again has no alert; one that has too few samples, or that was not touched, keeps what it had
        raised = outcomes.filter("alert_id is not null").select("source_id", "alert_id", "score", "since", (F.col("proposed") | (F.col("decision") == "proposal")).alias("proposed"))
        stay = alerts.join(raised.select("source_id"), "source_id", "left_anti").join(healthy, "source_id", "left_anti")
        self.put(stay.select(*raised.columns).unionByName(raised), "alerts", number)
        self.store.put(f"commits/{number}", "done")
        self.store.drop("work")
        for n in [n for n in done if before is not None and n < before]:
            for name in ("window", "baseline", "alerts", "touched"):
                self.store.drop(f"{name}/batch={n}")

    def start(self, rows: DataFrame, checkpoint: str, closed=None, **trigger) -> StreamingQuery:
        """``closed`` is asked for the closed alerts at each batch; ``trigger`` is that of the stream, ``processingTime="5 seconds"`` for a loop."""
        run = lambda batch, number: self.step(batch, number, closed() if closed else None)
        return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def outcomes(self) -> DataFrame | None:
        """What was decided, with the batch; none: nothing yet."""
        paths = [f"{self.store.root}/outcomes/batch={n}" for n in self.committed()]
        return self.spark.read.option("basePath", f"{self.store.root}/outcomes").parquet(*paths) if paths else None
