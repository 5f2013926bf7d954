"""Evidence bundles: all that proves one event, and the named checks that a bundle passes or fails.

A bundle is one row: the event as served, its record, the record's proof, and how the chain of seals goes on from the record's segment to a signed
checkpoint. That way is the same for all records of a segment, so it is walked once a segment (``walk``) and not carried by records; ``links`` lists it for
bundles that leave the system (``portable``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.operators import checkpoints, ledger, normalize

CHECKS = ("raw_hash", "record", "leaf", "inclusion", "chain", "anchor", "derived", "covered", "trusted")
FORMAT = "loglake-evidence/1"
BLOCK = 4096
SEAL = ("segment", "root", "prev", "chain", "count")


def runs(ledger_rows: DataFrame, log: DataFrame) -> DataFrame:
    """Seals with the checkpoint (a struct of the log's columns) that covers them: the earliest one, so that ways are as long as the time between two
    checkpoints. Seals behind the last checkpoint have none and are left out. Of checkpoints over equally many segments the first signed counts."""
    one = log.groupBy("segments").agg(F.min_by(F.struct(*log.columns), F.struct("sealed_through", "signed_at")).alias("checkpoint")).withColumn("_b", F.floor(F.col("segments") / BLOCK))
    ends = one.groupBy("_b").agg(F.max("segments").alias("_end")).withColumn("_end", F.lag("_end").over(Window.orderBy("_b")))  # one row a block
    before = F.coalesce(F.lag("segments").over(Window.partitionBy("_b").orderBy("segments")), F.col("_end"), F.lit(0).cast("bigint"))
    spans = one.join(ends, "_b").withColumn("_from", before + 1).filter("_from <= segments")
    covered = spans.select("checkpoint", F.explode(F.sequence("_from", "segments")).alias("segment"))
    return ledger_rows.select(*SEAL).join(covered, "segment")


def walk(runs_: DataFrame) -> DataFrame:
    """(segment, checkpoint, onward, broken, reached): ``onward`` is the chain value that the way goes on from, ``broken`` the first later seal that doesn't
    follow from the one before (null: none), ``reached`` whether the way ends in the checkpoint's head. Linear in the seals of a run."""
    run = Window.partitionBy(F.col("checkpoint.segments")).orderBy("segment")
    before = lambda c: F.lag(c).over(run)
    follows = (F.col("segment") == before("segment") + 1) & (ledger.chain_hash(F.col("prev"), F.col("root"), F.col("segment"), F.col("count")) == F.col("chain"))
    rows = runs_.withColumns({"_follows": F.coalesce(follows, F.lit(False)), "_joins": F.coalesce(F.col("prev") == before("chain"), F.lit(False))})
    later = lambda n, ok: F.min(F.when(~F.col(ok), F.col("segment"))).over(run.rowsBetween(n, Window.unboundedFollowing))
    end = F.last(F.struct("segment", "chain")).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cp = F.col("checkpoint")
    rows = rows.withColumns({"_end": end, "broken": F.least(later(1, "_follows"), later(2, "_joins")), "onward": F.coalesce(F.lead("prev").over(run), F.unhex(cp["head"]))})
    reached = (F.col("_end.segment") == cp["segments"]) & (F.lower(F.hex("_end.chain")) == F.lower(cp["head"]))
    return rows.select("segment", "checkpoint", "onward", "broken", F.coalesce(reached, F.lit(False)).alias("reached"))


def links(segments: DataFrame, runs_: DataFrame) -> DataFrame:
    """(segment, links): of asked segments, the seals from the next one to the checkpoint's, in order."""
    asked = segments.select("segment").distinct().join(runs_.select("segment", F.col("checkpoint.segments").alias("_last")), "segment")
    wanted = asked.select(F.col("segment").alias("_of"), F.when(F.col("_last") > F.col("segment"), F.sequence(F.col("segment") + 1, "_last")).otherwise(F.array().cast("array<bigint>")).alias("_s"))
    each = wanted.select("_of", F.explode_outer("_s").alias("segment")).join(runs_.select(*SEAL), "segment", "left")
    seal = F.when(F.col("root").isNotNull(), F.struct(*SEAL))
    return each.groupBy("_of").agg(F.array_sort(F.collect_list(seal)).alias("links")).withColumnRenamed("_of", "segment")


def claim(event: Column) -> Column:
    """What a parser derived, as text that is equal for equal events."""
    more = F.map_from_entries(F.array_sort(F.map_entries(event["more"])))
    return F.to_json(F.struct(event["ocsf"].alias("ocsf"), more.alias("more")))


def bundles(records: DataFrame, served: DataFrame, proofs: DataFrame, ledger_rows: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """A row an event of ``served`` (record_id, raw_sha256, source_id, parser_id, parser_version, claim): event, record, proof and anchor, each a struct. The
    record is what the ledger holds (record_id, segment, source_id, received_at, raw, body); proof and anchor are null where there is none yet."""
    cols = lambda df: F.struct(*df.columns)
    sealed = proofs.drop("segment").join(records.select("record_id", "segment"), "record_id").join(ledger_rows.select("segment", "root", "prev", "chain"), "segment")
    proof = sealed.select("record_id", F.struct("segment", "leaf", "index", "size", "path", "root", "prev", "chain").alias("proof"))
    out = served.select("record_id", cols(served).alias("event")).join(records.select("record_id", "segment", cols(records).alias("record")), "record_id").join(proof, "record_id", "left")
    if walked is None:
        return out.withColumn("anchor", F.lit(None)).drop("record_id", "segment")
    return out.join(walked.select("segment", cols(walked).alias("anchor")), "segment", "left").drop("record_id", "segment")


def derived(bundle: DataFrame, specs: list[dict]) -> DataFrame:
    """``bundle`` with ``again``: what the event's own parser makes of the record now; null where it is not among ``specs`` or doesn't match."""
    keep, told = bundle.columns, []
    for k, spec in enumerate(specs):
        own = (F.col("event.parser_id") == spec["id"]) & (F.col("event.parser_version") == spec["version"])
        rows = bundle.withColumns({"_raw": F.when(own, F.decode(F.col("record.raw"), "UTF-8")), "_at": F.col("record.received_at"), "_served": F.col("event")})
        found = normalize.normalize(rows, [spec], raw="_raw", received="_at")
        again = F.when(F.col("event").isNotNull(), claim(F.col("event"))).alias(f"_again{k}")
        bundle = found.select(*[F.col("_served").alias("event") if c == "event" else F.col(c) for c in bundle.columns], again)
        told.append(f"_again{k}")
    return bundle.select(*keep, F.coalesce(*[F.col(c) for c in told], F.lit(None).cast("string")).alias("again"))


def checks(bundle: DataFrame, specs: list[dict], trusted: bytes | None = None, anchor: str | None = None, head: str | None = None) -> DataFrame:
    """``bundle`` with ``checks``: name -> pass, fail or skip (nothing to check against), ``problem`` (why the chain isn't covered) and ``ok`` (none failed).

    raw_hash: the bytes are those that the event names. record: the event names this record and its source. leaf: the record's body hashes to the leaf.
    inclusion, chain: the leaf is in the tree, and the seal follows from its root. anchor: the value from outside (hex) is the seal's or ``head``. derived:
    the event's parser makes the event again; a parser that isn't there is skipped. covered: a checkpoint with a signature that verifies covers the record,
    and the chain goes on from its seal to the checkpoint's head. trusted: the key that signed is ``trusted``. Records that aren't sealed skip what needs a seal.
    """
    rows = derived(bundle, specs)
    say = lambda known, ok: F.when(~F.coalesce(known, F.lit(False)), "skip").when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    e, r, p, a = F.col("event"), F.col("record"), F.col("proof"), F.col("anchor")
    sealed, anchored = p.isNotNull(), p.isNotNull() & a.isNotNull()
    known = F.lit(False)
    for spec in specs:
        known = known | ((e["parser_id"] == spec["id"]) & (e["parser_version"] == spec["version"]))
    outside = F.lit((anchor or "").strip().lower())
    problem, fine = F.lit(None).cast("string"), F.lit(False)
    if "checkpoint" in (bundle.schema["anchor"].dataType.fieldNames() if hasattr(bundle.schema["anchor"].dataType, "fieldNames") else []):
        cp = a["checkpoint"]
        problem = (
            F.when(~anchored, None)
            .when(cp["refused"].isNotNull(), F.concat(F.lit("the checkpoint's "), cp["refused"], F.lit(" is not right")))
            .when(F.coalesce(r["record_id"] > cp["sealed_through"], F.lit(True)) | (r["record_id"] < 1), "the record is beyond the checkpoint")
            .when(a["broken"].isNotNull(), F.concat(F.lit("the chain breaks at segment "), a["broken"].cast("string")))
            .when(~F.coalesce(p["chain"] == a["onward"], F.lit(False)), "the chain does not go on from the record's seal")
            .when(~a["reached"], "the chain does not reach the signed head")
        )
        fine = cp["public"] == F.lit(trusted)
    else:
        anchored = F.lit(False)
    covered = F.col("problem").isNull()
    results = {
        "raw_hash": say(F.lit(True), F.sha2(r["raw"], 256) == e["raw_sha256"]),
        "record": say(F.lit(True), (e["record_id"] == r["record_id"]) & (e["source_id"] == r["source_id"])),
        "leaf": say(sealed, ledger.leaf_hash(r["body"]) == p["leaf"]),
        "inclusion": say(sealed, ledger.verify_inclusion(p["leaf"], p["index"], p["size"], p["path"], p["root"])),
        "chain": say(sealed, ledger.chain_hash(p["prev"], p["root"], p["segment"], p["size"]) == p["chain"]),
        "anchor": say(sealed & (outside != ""), (outside == F.lower(F.hex(p["chain"]))) | (outside == F.lit((head or "").lower()))),
        "derived": say(known, F.col("again").isNotNull() & (F.col("again") == e["claim"])),
        "covered": say(anchored, covered),
        "trusted": say(anchored & covered & F.lit(trusted is not None), fine),
    }
    rows = rows.withColumn("problem", problem)
    rows = rows.withColumn("checks", F.map_from_arrays(F.array(*[F.lit(k) for k in results]), F.array(*results.values()))).drop("again")
    return rows.withColumn("ok", ~F.array_contains(F.map_values("checks"), "fail"))


def portable(bundle: DataFrame, ways: DataFrame) -> DataFrame:
    """(record_id, line): bundles as JSON that needs nothing else to be checked, with the seals of ``links``."""
    of = bundle.withColumn("segment", F.col("record.segment")).join(ways, "segment", "left")
    text = lambda c: F.lower(F.hex(c))
    p, r, cp = F.col("proof"), F.col("record"), F.col("anchor.checkpoint")
    seals = F.transform("links", lambda s: F.struct(s["segment"].alias("segment"), text(s["root"]).alias("root"), text(s["prev"]).alias("prev"), text(s["chain"]).alias("chain"), s["count"].alias("count")))
    proof = F.struct(*[p[k].alias(k) for k in ("segment", "index", "size")], *[text(p[k]).alias(k) for k in ("leaf", "root", "prev", "chain")], F.transform(p["path"], text).alias("path"))
    point = F.struct(*[cp[k].alias(k) for k in ("version", "head", "sealed_through", "segments", "signed_at", "prev", "key_id")], F.base64(cp["signature"]).alias("signature"))
    doc = F.struct(
        F.lit(FORMAT).alias("format"), "event", F.struct(r["record_id"].alias("record_id"), r["source_id"].alias("source_id"), F.base64(r["raw"]).alias("raw_base64"), F.base64(r["body"]).alias("body_base64")).alias("record"),
        F.when(p.isNotNull(), proof).alias("proof"), F.when(cp.isNotNull(), F.struct(point.alias("checkpoint"), text(cp["public"]).alias("public_key"), seals.alias("links"))).alias("anchor"),
    )
    return of.select(r["record_id"].alias("record_id"), F.to_json(doc).alias("line"))


def head(ledger_rows: DataFrame) -> str:
    """The newest chain value, in hex; zeros where nothing is sealed. One row."""
    return ledger_rows.agg(F.lower(F.hex(F.max_by("chain", "segment"))).alias("h")).first()["h"] or checkpoints.ZERO
