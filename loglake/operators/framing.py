"""Records out of bytes and lines: fragments, multi-line records, peers, admission, counters, lint."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.functions.values import ip_bits, to_ip

MORE, CONT = 1, 2
#: Names of terminators and their bytes; any other name has none.
TERMS = {"lf": b"\n", "crlf": b"\r\n", "nul": b"\0"}


def fragments(records: DataFrame, key: str, most: int) -> DataFrame:
    """Records of more than ``most`` bytes as consecutive parts: part, offset, frag bits (1: more follow, 2: goes on), raw. Order within a key is by part."""
    n = F.octet_length("raw")
    parts = F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    cut = records.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)))
    bits = F.when((F.col("part") + 1) * most < n, MORE).otherwise(0) + F.when(F.col("part") > 0, CONT).otherwise(0)
    return cut.withColumns({"frag": bits, "offset": F.col("part") * most, "raw": F.substring("raw", F.col("part") * most + 1, F.lit(most))})


def reassemble(parts: DataFrame, key: str) -> DataFrame:
    """The inverse of ``fragments``: a part that doesn't go on opens a record, and what follows by offset belongs to it."""
    order = Window.partitionBy(key).orderBy("offset")
    opened = parts.withColumn("_r", F.sum((F.col("frag").bitwiseAND(CONT) == 0).cast("int")).over(order))
    bits = F.transform(F.array_sort(F.collect_list(F.struct("offset", "raw"))), lambda x: F.hex(x["raw"]))
    return opened.groupBy(key, "_r").agg(F.unhex(F.array_join(bits, "")).alias("raw")).drop("_r")


def multiline(lines: DataFrame, file: str, pos: str, start: str, max_lines: int = 500, terminator: str = "\n", text: bool = True, max_bytes: int = 1 << 20, term: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Lines that match ``start`` open a record, others append to it, behind the terminator of the line before, until it has ``max_lines`` (two at least, if a
    second one follows); what is beyond, or before any start, stands alone. One row a record: place of its first line, lines, raw. What is longer than
    ``max_bytes`` comes in parts (part, and frag bits as in ``fragments``); lines count in the part that they begin in. A line that fills a part does not end the
    record, so such a record goes on until a line at or past ``max_lines`` fills none. ``terminator`` ends every line, or ``term`` is the column with its name
    (``TERMS``); then a record has that of its last line. Binary ``raw`` stays so; as a string it is cut by bytes, too. ``by`` are columns that order a file as
    ``pos`` does, where ``pos`` was counted along them: then nothing is sorted a second time. Without ``text`` only a record's place and number of lines: it runs
    to the next one."""
    order = Window.partitionBy(file).orderBy(*(by or [pos]))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    kind = lines.schema["raw"].dataType.simpleString()
    ends = F.lit(terminator.encode()) if term is None else F.coalesce(*[F.when(F.col(term) == name, F.lit(end)) for name, end in TERMS.items()], F.lit(b""))
    size, ending = F.coalesce(F.octet_length("raw"), F.lit(0)).cast("bigint"), F.octet_length(ends)
    opens = F.coalesce(F.col("raw").cast("string").rlike(start), F.lit(False))
    # every window goes through a file in one order, so that nothing is sorted again; lines and bytes of a record are counted from its start
    running = {"_n": F.row_number().over(order), "_at": F.coalesce(F.sum(size + ending).over(before), F.lit(0)), "_first": F.max(F.when(opens, F.col(pos))).over(so_far)}
    placed = lines.withColumns(running | {"_opens": opens, "_next": F.coalesce(F.lead(opens).over(order), F.lit(True))})
    begun = placed.withColumns({"_n0": F.max(F.when(F.col("_opens"), F.col("_n"))).over(so_far), "_at": F.col("_at") - F.max(F.when(F.col("_opens"), F.col("_at"))).over(so_far)})
    # a line fills one part at most, and the first none: the parts filled up to a line are its number less the highest of (number - parts that the bytes
    # make) so far. The first line's own number is above all before it, so the highest starts anew with each record.
    whole = F.floor((F.col("_at") + size) / max_bytes)
    behind = F.when(F.col("_opens"), F.col("_n")).otherwise(F.col("_n") - whole)
    filled = begun.withColumns({"_m": F.max(behind).over(so_far), "_m1": F.max(behind).over(before)})
    closes = (F.col("_n") - F.col("_n0") + 1 >= max(2, max_lines)) & (F.col("_m") > F.col("_m1"))
    closed = filled.withColumn("_closes", closes).withColumn("_alone", F.col("_n0").isNull() | F.coalesce(F.max(F.when(closes, F.col("_n"))).over(before) > F.col("_n0"), F.lit(False)))
    alone = F.col("_alone")
    if not text:
        heads = closed.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(file))).filter(alone | F.col("_opens"))
        until = F.coalesce(F.lead("_n").over(order), F.col("_all") + 1)
        return heads.select(file, pos, (until - F.col("_n")).cast("bigint").alias("lines"))
    last = alone | F.col("_next") | F.col("_closes")
    at = F.when(alone, F.lit(0)).otherwise(F.col("_at")).cast("bigint")
    until = at + size + F.when(last, F.lit(0)).otherwise(ending)
    high = F.greatest(F.lit(0), F.floor((until - 1) / max_bytes), F.when(~alone & last, F.col("_n") - F.col("_m")))
    low = F.least(F.floor(at / max_bytes), high)
    bits = F.coalesce(F.col("raw").cast("binary"), F.lit(b""))
    own = [F.col(file), F.col(pos), F.when(alone, F.col(pos)).otherwise(F.col("_first")).alias("_first"), at.alias("_at"), last.alias("_last"), low.alias("_low"), high.alias("_high")]
    named = [] if term is None else [F.col(term).alias("_term")]
    pieces = closed.select(*own, *named, F.when(last, bits).otherwise(F.concat(bits, ends)).alias("_raw")).withColumn("part", F.explode(F.sequence("_low", "_high")))
    skipped, most = F.greatest(F.col("part") * max_bytes - F.col("_at"), F.lit(0)), F.lit(max_bytes)
    kept = F.least(most, (F.col("part") + 1) * max_bytes - F.col("_at"))
    piece = F.when(F.col("_low") == F.col("_high"), F.col("_raw")).otherwise(F.substring("_raw", (skipped + 1).cast("int"), kept.cast("int")))
    more = ~F.bool_or(F.col("_last") & (F.col("part") == F.col("_high")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, piece.cast("string").alias("raw")))), lambda x: x["raw"]), "")
    frag = F.when(more, MORE).otherwise(0) + F.when(F.col("part") > 0, CONT).otherwise(0)
    ended = [] if term is None else [F.when(more, "none").otherwise(F.max_by("_term", pos)).alias("term")]
    out = pieces.groupBy(file, "_first", "part").agg(F.count_if(F.col("part") == F.col("_low")).alias("lines"), frag.alias("frag"), *ended, joined.cast(kind).alias("raw"))
    return out.withColumnRenamed("_first", pos)


def peer_ip(peer: Column) -> Column:
    """The address of ``ip``, ``ip:port`` or ``[ip]:port``; version 4 also where it is mapped into version 6. Null where there is none."""
    bracketed = F.regexp_extract(peer, r"^\[([^\]]+)\](:[0-9]+)?$", 1)
    bare = F.regexp_replace(peer, r":[^:]*$", "")
    return F.coalesce(to_ip(F.nullif(bracketed, F.lit(""))), to_ip(peer), to_ip(bare))


def peer_source(peers: DataFrame, prefixes: list[tuple[str, str]], fallback: str, peer: str = "peer") -> DataFrame:
    """``peers`` with the source of the longest prefix that holds the address. The prefixes are configuration; each length is one equi-join on the
    address' leading bits, so no range join is needed. Host bits of a prefix are masked, of equal prefixes the first counts."""
    by_length: dict[tuple[int, int], dict[str, str]] = {}
    for text, source in prefixes:
        net = ipaddress.ip_network(text, strict=False)
        bits = f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen]
        by_length.setdefault((net.prefixlen, net.max_prefixlen), {}).setdefault(bits, source)
    spark = peers.sparkSession
    out = peers.withColumn("_bits", ip_bits(peer_ip(F.col(peer))))
    found = []
    for n, ((length, width), rows) in enumerate(sorted(by_length.items(), reverse=True)):
        side = spark.createDataFrame(sorted(rows.items()), f"_k{n} string, _s{n} string")
        side = F.broadcast(side) if len(rows) <= 100_000 else side
        key = F.when(F.length("_bits") == width, F.substring("_bits", 1, length))
        out = out.join(side, key == F.col(f"_k{n}"), "left").drop(f"_k{n}")
        found.append(f"_s{n}")
    return out.withColumn("source_id", F.coalesce(*[F.col(c) for c in found], F.lit(fallback))).drop("_bits", *found)


def admit(rows: DataFrame, allowed: DataFrame | None, column: str = "source_id") -> DataFrame:
    """Rows whose source id is well formed and on the list (None: any)."""
    fine = rows.filter(F.col(column).rlike("^[A-Za-z0-9._-]{1,64}$"))
    return fine if allowed is None else fine.join(allowed.select(column).distinct(), column, "left_semi")


def ingest_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("raw")).cast("bigint").alias("bytes"), F.count_if(F.col("frag") != 0).alias("fragments"))


# Syntax that the linear-time regex dialect of specs does not have.
FORBIDDEN = {"lookaround": r"\(\?(=|!|<=|<!)", "backreference": r"\\[1-9]|\(\?P=", "atomic_or_possessive": r"\(\?>|[*+?}]\+", "group_name": r"\(\?<[A-Za-z_]"}


def lint_patterns(specs: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, violation) of patterns that linear-time engines reject."""
    kinds = F.array_compact(F.array(*[F.when(F.col(pattern).rlike(rule), name) for name, rule in FORBIDDEN.items()]))
    return specs.select(key, F.explode(kinds).alias("violation"))
