"""Integrity of a record table: canonical bodies, leaf hashes, Merkle trees per segment, proofs, the chain of seals and its checks.

Hashes are binary; ``hex`` makes them text at the edge. A segment is bounded by the rule that seals it (a number of records), so its leaves may be held in
one row; trees of different segments are independent.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.operators import cuts
from loglake.session import ship

SEGMENT_RECORDS, SEGMENT_BYTES = 250_000, 64 << 20
ZERO = "00" * 32


def big_endian(x: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 2 * size, "0"))


def sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def canonical_body(seq: Column, received_ns: Column, source: Column, kind: Column, addr: Column, offset: Column, raw: Column, term: Column | None = None, frag: Column | None = None) -> Column:
    """Version 1 of a record's body; whole numbers are big-endian. ``kind`` and ``term`` are numbers, ``frag`` has the bits more (1) and goes on (2)."""
    flags = (term if term is not None else F.lit(0)) + F.shiftleft(frag if frag is not None else F.lit(0), 2)
    return F.concat(
        F.unhex(F.lit("01")), big_endian(flags, 1), big_endian(seq, 8), big_endian(received_ns, 8), big_endian(F.octet_length(source), 2), source.cast("binary"),
        big_endian(kind, 1), big_endian(F.octet_length(addr), 2), addr.cast("binary"), big_endian(offset, 8), big_endian(F.octet_length(raw), 4), raw.cast("binary"),
    )


def decode_body(body: Column) -> Column:
    """The parts of a body and what is wrong with it (null: nothing)."""
    number = lambda at, size: F.conv(F.hex(F.substring(body, at, F.lit(size) if isinstance(size, int) else size)), 16, 10).cast("bigint")
    one = F.lit(1)
    source_len = number(F.lit(19), 2)
    at = F.lit(21) + source_len
    addr_len = number(at + 1, 2)
    rest = at + 3 + addr_len
    raw_len = number(rest + 8, 4)
    whole = rest + 11 + raw_len
    error = (
        F.when(F.octet_length(body) < 35, "short")
        .when(number(one, 1) != 1, "version")
        .when(number(F.lit(2), 1) > 15, "flags")
        .when(F.coalesce(whole, F.lit(-1)) > F.octet_length(body), "length")
        .when(whole < F.octet_length(body), "trailing")
    )
    return F.struct(
        error.alias("error"),
        number(F.lit(3), 8).alias("seq"),
        F.substring(body, F.lit(21), source_len).cast("string").alias("source_id"),
        number(at, 1).alias("kind"),
        F.substring(body, at + 3, addr_len).cast("string").alias("addr"),
        number(rest, 8).alias("offset"),
        F.substring(body, rest + 12, raw_len).alias("raw"),
    )


def leaf_hash(body: Column) -> Column:
    return sha(F.unhex(F.lit("00")), body)


def node_hash(left: Column, right: Column) -> Column:
    return sha(F.unhex(F.lit("01")), left, right)


def segment_of(record_id: Column, records: int = SEGMENT_RECORDS) -> Column:
    """Segments count from 1, as record ids do."""
    return F.floor((record_id - 1) / records).cast("bigint") + 1


def segments_by_size(records_: DataFrame, stream: str, order: str, size: str, most: int = SEGMENT_BYTES, limit: int = SEGMENT_RECORDS) -> DataFrame:
    """``records_`` with the segment, from 1, that each falls into when a segment is sealed by the record that reaches ``most`` bytes or ``limit`` records."""
    return cuts.cut(records_, stream, order, size, most, limit, under=False, out="segment").withColumn("segment", F.col("segment") + 1)


def next_level(level: Column) -> Column:
    """Pairs are hashed, an odd last node goes up as it is."""
    half = F.floor((F.size(level) + 1) / 2).cast("int")
    pair = lambda i: F.when(2 * i + 1 < F.size(level), node_hash(F.get(level, 2 * i), F.get(level, 2 * i + 1))).otherwise(F.get(level, 2 * i))
    return F.transform(F.sequence(F.lit(0), half - 1), pair)


def trees(leaves: DataFrame, *more: str) -> DataFrame:
    """(segment, first_seq, last_seq, count, levels) from (segment, record_id, leaf); ``levels`` runs from the leaves to the root, ``ids`` are the records'."""
    rows = leaves.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("record_id", "leaf"))).alias("rows"))
    first = F.transform("rows", lambda r: r["leaf"])
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size("rows"))).cast("int")))
    levels = F.aggregate(steps, F.array(first), lambda acc, _: F.when(F.size(F.element_at(acc, -1)) > 1, F.array_append(acc, next_level(F.element_at(acc, -1)))).otherwise(acc))
    return rows.select("segment", F.element_at("rows", 1)["record_id"].alias("first_seq"), F.element_at("rows", -1)["record_id"].alias("last_seq"), F.size("rows").cast("bigint").alias("count"), levels.alias("levels"), F.transform("rows", lambda r: r["record_id"]).alias("ids")).select("segment", "first_seq", "last_seq", "count", "levels", *more)


def roots(leaves: DataFrame) -> DataFrame:
    return trees(leaves).select("segment", "first_seq", "last_seq", "count", F.element_at(F.element_at("levels", -1), 1).alias("root"))


def nodes(leaves: DataFrame) -> DataFrame:
    """(segment, level, i, hash) of every node."""
    levels = trees(leaves).select("segment", F.posexplode("levels").alias("level", "row"))
    return levels.select("segment", "level", F.posexplode("row").alias("i", "hash"))


def inclusion_paths(leaves: DataFrame) -> DataFrame:
    """(segment, record_id, index, size, leaf, path): siblings from leaf to root; a node that went up alone has none.

    A segment's tree is in its row, so its paths are read off there: one shuffle, that of the leaves to their segments.
    """
    rows = trees(leaves, "ids")
    depth = F.size("levels") - 1
    steps = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
    sibling = lambda i, level: F.get(F.element_at("levels", level + 1), F.call_function("shiftright", i, level).bitwiseXOR(F.lit(1)))
    path = lambda i: F.array_compact(F.transform(steps, lambda level: sibling(i, level)))
    paths = F.transform("ids", lambda r, i: F.struct(r.alias("record_id"), i.cast("bigint").alias("index"), F.col("count").alias("size"), F.get(F.element_at("levels", 1), i).alias("leaf"), path(i).alias("path")))
    return rows.select("segment", F.inline(paths))


def verify_inclusion(leaf: Column, index: Column, size: Column, path: Column, root: Column) -> Column:
    """Whether the path leads from the leaf at ``index`` of ``size`` to the root."""
    start = F.struct(index.cast("bigint").alias("fn"), (size - 1).cast("bigint").alias("sn"), leaf.alias("r"), F.lit(True).alias("ok"))

    def step(s: Column, p: Column) -> Column:
        right = (s["fn"].bitwiseAND(F.lit(1)) == 1) | (s["fn"] == s["sn"])
        low = F.bit_count(s["fn"].bitwiseAND(-s["fn"]) - 1)
        skip = F.when(right & (s["fn"].bitwiseAND(F.lit(1)) == 0) & (s["fn"] != 0), low).otherwise(0) + 1
        shift = lambda x: F.call_function("shiftright", x, skip)
        return F.struct(shift(s["fn"]).alias("fn"), shift(s["sn"]).alias("sn"), F.when(right, node_hash(p, s["r"])).otherwise(node_hash(s["r"], p)).alias("r"), (s["ok"] & (s["sn"] != 0)).alias("ok"))

    end = F.aggregate(path, start, step)
    return F.coalesce((size > 0) & (index < size) & end["ok"] & (end["sn"] == 0) & (end["r"] == root), F.lit(False))


def chain_hash(prev: Column, root: Column, segment: Column, count: Column) -> Column:
    return sha(F.unhex(F.lit("02")), prev, root, big_endian(segment, 8), big_endian(count, 8))


def seals(leaves: DataFrame) -> DataFrame:
    """The ledger (segment, first_seq, last_seq, count, root, prev, chain). Each link needs the one before, so the chain is a stream through one task: a
    hundred bytes a segment, of which only the last hash is held. Trees are built before that shuffle, in as many tasks as there are segments."""
    ship(leaves.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = bytes(32)
        for batch in batches:
            before, after = [], []
            for segment, count, root in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                before.append(chain)
                chain = hashlib.sha256(b"\x02" + chain + root + struct.pack(">qq", segment, count)).digest()
                after.append(chain)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=[*batch.schema.names, "prev", "chain"])

    rows = roots(leaves).select("segment", "first_seq", "last_seq", "count", "root")
    return rows.repartition(1).sortWithinPartitions("segment").mapInArrow(run, "segment bigint, first_seq bigint, last_seq bigint, count bigint, root binary, prev binary, chain binary")


def verify_chain(ledger: DataFrame, footers: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(segment, reason) of each seal that doesn't follow from the one before it: gap, sequence, range, prev, chain; with ``footers`` (segment, root, chain:
    what the segments themselves say) also missing, footer root, footer chain. ``by``: columns that tell ledgers apart, each a chain of its own. The seal
    before is found within blocks of segments, and across them from one row a block."""
    key = [F.col(k) for k in by]
    within = Window.partitionBy(*key, "_b").orderBy("segment")
    rows = ledger.select(*by, "segment", "first_seq", "last_seq", "count", "root", "prev", "chain", F.floor(F.col("segment") / 4096).alias("_b"))
    last = rows.groupBy(*key, "_b").agg(F.max_by(F.struct("segment", "last_seq", "chain"), "segment").alias("_end"))
    ends = last.withColumn("_end", F.lag("_end").over(Window.partitionBy(*key).orderBy("_b")))  # one row a block
    seal = F.coalesce(F.lag(F.struct("segment", "last_seq", "chain")).over(within), F.col("_end"))
    before = rows.join(ends, [*by, "_b"]).withColumn("_p", seal).select("*", F.col("_p.segment").alias("_s"), F.col("_p.last_seq").alias("_l"), F.col("_p.chain").alias("_c"))
    prev = F.coalesce(F.col("_c"), F.unhex(F.lit(ZERO)))
    reason = (
        F.when(F.col("segment") != F.coalesce(F.col("_s"), F.lit(0)) + 1, "gap")
        .when(F.col("first_seq") != F.coalesce(F.col("_l"), F.lit(0)) + 1, "sequence")
        .when((F.col("count") == 0) | (F.col("count") != F.col("last_seq") - F.col("first_seq") + 1), "range")
        .when(F.col("prev") != prev, "prev")
        .when(F.col("chain") != chain_hash(F.col("prev"), F.col("root"), F.col("segment"), F.col("count")), "chain")
    )
    if footers is not None:
        before = before.join(footers.select(*by, "segment", F.struct("root", "chain").alias("_f")), [*by, "segment"], "left")
        agrees = lambda k: F.col(f"_f.{k}").eqNullSafe(F.col(k))
        reason = reason.when(F.col("_f").isNull(), "missing").when(~agrees("root"), "footer root").when(~agrees("chain"), "footer chain")
    return before.withColumn("reason", reason).filter("reason is not null").select(*by, "segment", "reason")


def chain_report(ledger: DataFrame, footers: DataFrame, heads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(ok, segments, records, first_bad, reason), one row a ledger of ``heads`` (head: the chain hash that was recorded last): the first segment of
    ``verify_chain`` that is bad and why, else ``head`` where the last seal isn't the recorded head. Records count only where no segment is bad.
    A ledger without seals has a head of zeros."""
    key = [F.col(k) for k in by]
    size = ledger.groupBy(*key).agg(F.count(F.lit(1)).alias("segments"), F.sum("count").alias("_n"), F.max_by("chain", "segment").alias("_last"))
    bad = verify_chain(ledger, footers, by).groupBy(*key).agg(F.min(F.struct("segment", "reason")).alias("_bad"))
    beside = lambda a, b: a.join(b, list(by), "left") if by else a.join(b, how="left")  # noqa: E731 (without ``by``, one row each)
    both = beside(beside(heads, size), bad)
    led = F.coalesce("_last", F.unhex(F.lit(ZERO))).eqNullSafe(F.col("head"))
    reason = F.coalesce(F.col("_bad.reason"), F.when(~led, "head"))
    records = F.when(F.col("_bad").isNull(), F.coalesce("_n", F.lit(0))).otherwise(0)
    return both.select(*by, reason.isNull().alias("ok"), F.coalesce("segments", F.lit(0)).alias("segments"), records.alias("records"), F.col("_bad.segment").alias("first_bad"), reason.alias("reason"))


def verify_deep(leaves: DataFrame, ledger: DataFrame) -> DataFrame:
    """(segment, reason) of segments whose recomputed root isn't the ledger's, or that only one side has."""
    own = roots(leaves).select("segment", F.col("root").alias("_root"))
    both = ledger.select("segment", "root").join(own, "segment", "full_outer")
    reason = F.when(F.col("root").isNull(), "not sealed").when(F.col("_root").isNull(), "records missing").when(F.col("root") != F.col("_root"), "root")
    return both.withColumn("reason", reason).filter("reason is not null").select("segment", "reason")


def tampered(stored: DataFrame, present: DataFrame) -> DataFrame:
    """(segment, record_id, change) of records whose leaf isn't the stored one: changed, removed or added."""
    both = stored.select("segment", "record_id", F.col("leaf").alias("_a")).join(present.select("segment", "record_id", F.col("leaf").alias("_b")), ["segment", "record_id"], "full_outer")
    change = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return both.withColumn("change", change).filter("change is not null").select("segment", "record_id", "change")


def newest_by_hash(records: DataFrame) -> DataFrame:
    """The newest record of each content, with the number of its copies."""
    return records.groupBy(F.sha2("raw", 256).alias("raw_sha256")).agg(F.max_by(F.struct(*[c for c in records.columns]), "record_id").alias("r"), F.count(F.lit(1)).alias("copies")).select("raw_sha256", "copies", "r.*")


def dense_ids(rows: DataFrame, bucket: Column, order: list, out: str = "record_id") -> DataFrame:
    """``rows`` numbered from 1 in the order of (bucket, order): buckets are counted, then rows are numbered within theirs, so no task sees all rows.
    ``bucket`` must be a number that doesn't fall along ``order``."""
    keyed = rows.withColumn("_b", bucket)
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.floor(F.col("_b") / 1024))
    above = counts.groupBy("_s").agg(F.sum("_n").alias("_m")).withColumn("_above", F.sum("_m").over(Window.orderBy("_s")) - F.col("_m")).drop("_m")  # a row for 1024 buckets
    before = counts.join(above, "_s").withColumn("_before", F.col("_above") + F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_n")).select("_b", "_before")
    return keyed.join(before, "_b").withColumn(out, (F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(*order))).cast("bigint")).drop("_b", "_before")


def verify_records(records: DataFrame, proofs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(record_id, ok, sealed, reason) of records (record_id, segment, leaf of what is stored now) against their proofs (leaf, index, size, path, root,
    prev, chain: what the segment's footer says) and the ledger: a record whose segment isn't sealed is fine and not sealed."""
    own = proofs.select("record_id", F.struct("leaf", "index", "size", "path", "root", "prev", "chain").alias("p"))
    both = records.select("record_id", "segment", "leaf").join(own, "record_id", "left").join(ledger.select("segment", F.struct("root", "chain").alias("s")), "segment", "left")
    p, sealed = F.col("p"), F.col("p").isNotNull() & F.col("s").isNotNull()
    reason = (
        F.when(~sealed, None)
        .when(F.col("leaf") != p["leaf"], "record does not match its leaf hash")
        .when(~verify_inclusion(p["leaf"], p["index"], p["size"], p["path"], p["root"]), "inclusion proof does not verify against the segment root")
        .when(chain_hash(p["prev"], p["root"], F.col("segment"), p["size"]) != p["chain"], "segment chain link does not verify")
        .when(p["root"] != F.col("s.root"), "segment root does not match the ledger")
    )
    return both.select("record_id", reason.isNull().alias("ok"), sealed.alias("sealed"), reason.alias("reason"))


def scan(records: DataFrame, start: int) -> DataFrame:
    """Records from an id on, in order."""
    return records.filter(F.col("record_id") >= start).orderBy("record_id")


def segment_list(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """(segment, sealed, first_seq, last_seq, count): the sealed segments, and the one that is being written, if it has records."""
    open_ = records.join(ledger.select("segment"), "segment", "left_anti").groupBy("segment").agg(F.min("record_id").alias("first_seq"), F.max("record_id").alias("last_seq"), F.count(F.lit(1)).alias("count"))
    return ledger.select("segment", F.lit(True).alias("sealed"), "first_seq", "last_seq", "count").unionByName(open_.withColumn("sealed", F.lit(False)))


def checkpoint_links(log: DataFrame) -> DataFrame:
    """(checkpoint, reason) of a checkpoint log (checkpoint, covered, signature, prev): prev is the hash of the signature before, coverage never falls."""
    within = Window.partitionBy("_b").orderBy("checkpoint")
    rows = log.withColumn("_b", F.floor(F.col("checkpoint") / 4096))
    own = F.struct("signature", "covered")
    ends = rows.groupBy("_b").agg(F.max_by(own, "checkpoint").alias("_end")).withColumn("_end", F.lag("_end").over(Window.orderBy("_b")))  # one row a block
    before = rows.join(ends, "_b").withColumn("_p", F.coalesce(F.lag(own).over(within), F.col("_end")))
    wanted = F.when(F.col("_p").isNull(), F.unhex(F.lit(ZERO))).otherwise(sha(F.col("_p.signature")))
    reason = F.when(F.col("prev") != wanted, "prev").when(F.col("covered") < F.col("_p.covered"), "coverage")
    return before.withColumn("reason", reason).filter("reason is not null").select("checkpoint", "reason")


def reconcile(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sha, expected, found) of contents whose number of records isn't what the manifest says."""
    a = manifest.groupBy("sha").agg(F.count(F.lit(1)).alias("expected"))
    b = records.groupBy("sha").agg(F.count(F.lit(1)).alias("found"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return a.join(b, "sha", "full_outer").select("sha", zero("expected"), zero("found")).filter("expected != found")
