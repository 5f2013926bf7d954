"""Proportional stratified interleaving: shards that all have the corpus' mixture of sources.

Rows of a source are shuffled by a seeded hash and ranked; the fractional rank ``(rank - 1 + u) / rows of the source`` spreads every source evenly over
(0, 1). The offsets u of sources with equally many rows are staggered, so that they spread evenly together as well: a thousand sources of one row are
interleaved like one source of a thousand. All rows are sorted by the fractional rank and cut into runs, so that a run holds every source in its share
of the corpus and sizes differ by a row at most.

Equal rows are one row with a count until their ranks are known. Ranks are found without a window over a whole source: a range of the hash (or of the
fractional rank) holds a few hundred rows, rows are ranked within their range, and a running sum over the ranges' counts gives what lies before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loglake.llm.shared import store

#: Rows that a range holds on average.
RANGE_ROWS = 256
HASH_BITS, OFFSET_BITS = 60, 52
#: Copies of a row that a task lists at once; rows with more copies are dealt out first.
COPIES = 10_000


def seeded_hash(seed: int, *columns: Column) -> Column:
    """60 bits of MD5 over the seed and the columns; a null counts as an empty text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def range_bits(rows: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / RANGE_ROWS)))


def ranked(rows: DataFrame, group: Column | None, range_: Column, order: list[Column], out: str, weight: Column | None = None) -> DataFrame:
    """``rows`` with the number ``out`` of rows before them by (range_, order), within ``group`` if there is one; a row counts ``weight`` times.
    ``range_`` must not fall along ``order``."""
    keyed = rows.withColumns({"_g": group if group is not None else F.lit(0), "_r": range_, "_w": weight if weight is not None else F.lit(1)})
    counts = keyed.groupBy("_g", "_r").agg(F.sum("_w").alias("_n"))
    # two steps, so that no task sums more than the square root of all ranges
    step = counts.withColumn("_s", F.col("_r") - F.pmod("_r", F.lit(1024)))
    above = step.groupBy("_g", "_s").agg(F.sum("_n").alias("_m")).withColumn("_above", F.sum("_m").over(Window.partitionBy("_g").orderBy("_s")) - F.col("_m"))
    within = Window.partitionBy("_g", "_s").orderBy("_r")
    before = step.withColumn("_within", F.sum("_n").over(within) - F.col("_n")).join(above.drop("_m"), ["_g", "_s"]).select("_g", "_r", (F.col("_within") + F.col("_above")).alias("_before"))
    local = F.sum("_w").over(Window.partitionBy("_g", "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    return keyed.join(before, ["_g", "_r"]).withColumn(out, F.col("_before") + local).drop("_g", "_r", "_w", "_before")


def offsets(sources: DataFrame, seed: int) -> DataFrame:
    """``_u`` in [0, 1) of each source (_src, _rows): sources of as many rows are dealt evenly, in the order of a seeded hash, from a seeded start."""
    classes = sources.groupBy("_rows").agg(F.count(F.lit(1)).alias("_m"))
    hashed = sources.withColumn("_sh", seeded_hash(seed, F.col("_src")))
    placed = ranked(hashed, F.col("_rows"), F.shiftright("_sh", HASH_BITS - 20), [F.col("_sh"), F.col("_src")], "_j").join(classes, "_rows")
    start = F.shiftright(seeded_hash(seed, F.col("_rows")), HASH_BITS - OFFSET_BITS) / F.lit(float(1 << OFFSET_BITS))
    at = (F.col("_j") + F.lit(0.5)) / F.col("_m") + start
    return placed.select("_src", "_rows", (at - F.floor(at)).alias("_u"))


def shard_documents(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, source, size, text_crc32, law, shard, slot and grown_shard (null: a grown mixture moves rows).

    ``size`` is the text's UTF-8 bytes (null: none) plus 16. Null sources are a source of their own (reported as null), null ids and texts are ranked by
    what is left, rows that are equal in all of it share their ranks in any order, fewer rows than shards leave shards empty, an empty table gives an
    empty result, further columns are not read. The narrow rows are stored once in the shared folder; the documents are read once.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
    ).groupBy("doc_id", "source", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_c"))
    keyed = narrow.withColumns({"_src": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "_h": seeded_hash(seed, F.col("doc_id"), F.col("text_crc32"))})
    seen = Observation()
    kept = docs.sparkSession.read.schema(keyed.schema).parquet(store(keyed.observe(seen, F.sum("_c").alias("rows")), "narrow"))
    rows = seen.get["rows"] or 0
    bits = range_bits(rows)
    ties = [F.col(c) for c in ("_h", "doc_id", "text_crc32", "size")]
    by_source = ranked(kept, F.col("_src"), F.shiftright("_h", HASH_BITS - bits), ties, "_rank", F.col("_c"))
    sources = offsets(kept.groupBy("_src").agg(F.sum("_c").alias("_rows")), seed)
    copies = by_source.join(sources, "_src")
    many = copies.filter(F.col("_c") > COPIES).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c") - 1, F.lit(COPIES).cast("bigint")))).repartition("_src", "_h", "_k")
    last = F.least(F.col("_k") + COPIES, F.col("_c")) - 1
    listed = many.withColumn("_k", F.explode(F.sequence("_k", last))).unionByName(copies.filter(F.col("_c") <= COPIES).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c") - 1))))
    spread = listed.withColumn("_rank", F.col("_rank") + F.col("_k")).withColumn("_f", (F.col("_rank") + F.col("_u")) / F.col("_rows"))
    by_share = ranked(spread, None, F.floor(F.col("_f") * F.lit(float(1 << bits))), [F.col("_f"), F.col("_src"), F.col("_rank")], "_pos")
    if rows:
        shard = F.expr(f"_pos * {shards}L div {rows}L")
        first = F.expr(f"((_pos * {shards}L div {rows}L) * {rows}L + {shards - 1}L) div {shards}L")
    else:
        shard, first = F.col("_pos"), F.lit(0)
    return by_share.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("_pos") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes ``docs`` by ``plan`` (from ``shard_documents``; ids must be unique) as one folder a shard, rows by slot; a shard is as many files, in the
    order of their names, as tasks had parts of it."""
    placed = docs.join(plan.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
