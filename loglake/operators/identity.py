"""Who held an address when: facts, claims with half-open validity, resolution at an instant, timelines, graph, windows of change."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.functions.values import to_ip

#: Hours after which a claim ends by itself.
TTL_HOURS = {"dhcp": 8, "radius": 12, "vpn": 12}
# Address ranges that identities are kept for (10/8, 172.16/12, 192.168/16, 100.64/10, 169.254/16, fc00::/7, fe80::/10).
INTERNAL = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|169\.254\.|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
HOLDER = ["user", "host", "mac"]


def internal(ip: Column) -> Column:
    canonical = to_ip(ip)
    return F.coalesce(canonical.isNotNull() & canonical.rlike(INTERNAL), F.lit(False))


def valid_facts(facts: DataFrame) -> DataFrame:
    """Facts of known kind and action, with a time, about an internal address; exact repeats once."""
    fine = F.col("kind").isin(list(TTL_HOURS)) & F.col("action").isin("bind", "release") & F.col("at").isNotNull() & internal(F.col("ip"))
    return facts.filter(fine).dropDuplicates(["ip", "kind", "at", "action", "record_id", *HOLDER])


def complete_vpn(facts: DataFrame) -> DataFrame:
    """A VPN release without an address gets that of the last binding of the same user and peer that wasn't released yet; none: the fact goes."""
    mine = (F.col("kind") == "vpn") & (((F.col("action") == "bind") & (F.col("ip") != "")) | ((F.col("action") == "release") & (F.coalesce(F.col("ip"), F.lit("")) == "")))
    order = Window.partitionBy("kind", "user", "host", mine).orderBy("record_id")
    before = F.when(F.lag("action").over(order) == "bind", F.lag("ip").over(order))
    filled = facts.withColumn("ip", F.when(mine & (F.col("action") == "release"), before).otherwise(F.col("ip")))
    return filled.filter("kind != 'vpn' or coalesce(ip, '') != ''")


def claims(facts: DataFrame) -> DataFrame:
    """(ip, kind, user, host, mac, valid_from, valid_to, closed, record_id). Renewals by the same holder extend a claim, another fact closes it, else it
    ends a time to live after it was last seen. Empty claims are dropped."""
    ttl = F.coalesce(*[F.when(F.col("kind") == k, F.lit(h * 3600).cast("bigint")) for k, h in TTL_HOURS.items()])
    order = Window.partitionBy("ip", "kind").orderBy("at", "record_id")
    # what is held while an address is gone through is the facts alone: nothing is made of them before
    rows = facts.withColumns({"_pa": F.lag("action").over(order), "_pt": F.lag("at").over(order), "_next": F.lead("at").over(order)} | {f"_p_{c}": F.lag(c).over(order) for c in HOLDER})
    same = functools.reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_p_{c}"), F.lit("")) == F.coalesce(F.col(c), F.lit("")) for c in HOLDER])
    rows = rows.withColumn("_ttl", F.make_dt_interval(secs=ttl))
    renews = (F.col("_pa") == "bind") & same & (F.col("at") < F.col("_pt") + F.col("_ttl"))
    new = F.when((F.col("action") == "bind") & ~F.coalesce(renews, F.lit(False)), 1).otherwise(0)
    numbered = rows.withColumn("_c", F.sum(new).over(order)).filter("action = 'bind'")
    first = lambda c: F.min_by(c, F.struct("at", "record_id"))
    out = numbered.groupBy("ip", "kind", "_c").agg(*[first(c).alias(c) for c in HOLDER], F.min("at").alias("valid_from"), F.max(F.col("at") + F.col("_ttl")).alias("_end"), F.max_by("_next", F.struct("at", "record_id")).alias("_closer"), first("record_id").alias("record_id"))
    closed = F.coalesce(F.col("_closer") <= F.col("_end"), F.lit(False))
    out = out.withColumn("closed", closed).withColumn("valid_to", F.when(closed, F.col("_closer")).otherwise(F.col("_end")))
    return out.filter("valid_to > valid_from").select("ip", "kind", *HOLDER, "valid_from", "valid_to", "closed", "record_id")


def bucketed(claims_: DataFrame, hours: int = 4) -> DataFrame:
    """Claims dealt to the time buckets they touch: a busy address becomes many join keys, each with the claims of a few hours."""
    size = hours * 3600
    first, last = F.floor(F.unix_seconds("valid_from") / size), F.floor(F.unix_seconds("valid_to") / size)
    return claims_.withColumn("_b", F.explode(F.sequence(first, last)))


def covering(asked: DataFrame, claims_: DataFrame, hours: int = 4) -> DataFrame:
    """``asked`` (ip, at, ...) with each claim that covers the instant; rows without one go."""
    left = asked.withColumn("_b", F.floor(F.unix_seconds("at") / (hours * 3600)))
    right = bucketed(claims_, hours).withColumnRenamed("record_id", "claim_id")
    return left.join(right, ["ip", "_b"]).filter("at >= valid_from and at < valid_to").drop("_b")


def resolve(asked: DataFrame, claims_: DataFrame, key: str) -> DataFrame:
    """Per row of ``asked`` (key, ip, at): user, confidence, evidence, valid_from, valid_to, host, mac; null where nobody is known.

    The newest RADIUS or VPN claim with a user wins (of equal ones RADIUS); another user's claim at the same time lowers the confidence to 0.7.
    """
    found = covering(asked.select(key, "ip", "at"), claims_)
    by_user = F.col("kind").isin("radius", "vpn") & (F.coalesce("user", F.lit("")) != "")
    rank = F.when(by_user, F.struct("valid_from", (F.col("kind") == "radius").alias("radius"), F.col("claim_id")))
    winner = F.struct("user", "valid_from", F.when(F.col("closed"), F.col("valid_to")).alias("valid_to"), F.col("claim_id").alias("record_id"))
    lease = F.when(F.col("kind") == "dhcp", F.struct("valid_from", "claim_id"))
    # one pass over the claims that cover an instant: who, and which machine
    best = found.groupBy(key).agg(
        F.max_by(winner, rank).alias("w"),
        F.when(F.min(F.when(by_user, F.col("user"))) < F.max(F.when(by_user, F.col("user"))), 0.7).when(F.count_if(by_user) > 0, 1.0).alias("confidence"),
        F.when(F.count_if(by_user) > 0, F.array_sort(F.collect_set(F.when(by_user, F.col("claim_id"))))).alias("evidence"),
        F.max_by(F.struct("host", F.lower("mac").alias("mac")), lease).alias("m"),
    )
    out = asked.join(best, key, "left")
    return out.select(*asked.columns, F.col("w.user").alias("user"), "confidence", "evidence", F.col("w.valid_from").alias("valid_from"), F.col("w.valid_to").alias("valid_to"), F.nullif("m.host", F.lit("")).alias("host"), F.nullif("m.mac", F.lit("")).alias("mac"))


def timeline(claims_: DataFrame) -> DataFrame:
    """User claims with confidence: 0.7 where a claim of another user for the address overlaps."""
    users = claims_.filter("kind in ('radius', 'vpn') and coalesce(user, '') != ''")
    a = bucketed(users).select("ip", "_b", "record_id", "kind", "user", "valid_from", "valid_to")
    b = a.select("ip", "_b", F.col("user").alias("u2"), F.col("valid_from").alias("f2"), F.col("valid_to").alias("t2"))
    clash = a.join(b, ["ip", "_b"]).filter("user != u2 and f2 < valid_to and valid_from < t2").select("record_id", "kind", "ip").distinct().withColumn("_x", F.lit(True))
    return users.join(clash, ["record_id", "kind", "ip"], "left").withColumn("confidence", F.when(F.col("_x"), 0.7).otherwise(1.0)).drop("_x")


def reassignments(claims_: DataFrame) -> DataFrame:
    """Per user claim: the user before it on the address, and the seconds nobody held it (negative where they overlap)."""
    users = claims_.filter("kind in ('radius', 'vpn') and coalesce(user, '') != ''")
    order = Window.partitionBy("ip").orderBy("valid_from", "record_id")
    gap = F.unix_seconds("valid_from") - F.unix_seconds(F.lag("valid_to").over(order))
    return users.select("ip", "record_id", "user", F.lag("user").over(order).alias("previous_user"), gap.alias("gap_seconds"))


def graph_edges(claims_: DataFrame) -> DataFrame:
    """(source, target, kind, first, last) between addresses and users, hosts and hardware, and hosts and hardware."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    edge = lambda a, b, kind: F.when(said(a) & said(b), F.struct(F.concat(F.lit(f"{a}:"), a).alias("source"), F.concat(F.lit(f"{b}:"), b).alias("target"), F.lit(kind).alias("kind")))
    edges = F.array_compact(F.array(edge("ip", "user", "used_by"), edge("ip", "host", "held_by"), edge("ip", "mac", "seen_on"), edge("host", "mac", "has")))
    # all edges of a claim at once: claims are made in one pass, not one a kind of edge
    every = claims_.select(F.explode(edges).alias("e"), "valid_from", "valid_to").select("e.*", "valid_from", "valid_to")
    return every.groupBy("source", "target", "kind").agg(F.min("valid_from").alias("first"), F.max("valid_to").alias("last"))


def changed_windows(old: DataFrame, new: DataFrame) -> DataFrame:
    """(ip, from, to): spans in which the user that two sets of claims give for an address differs; neighbours are joined."""
    both = old.select("ip", "kind", "user", "valid_from", "valid_to", "record_id").withColumn("side", F.lit("old")).union(new.select("ip", "kind", "user", "valid_from", "valid_to", "record_id").withColumn("side", F.lit("new")))
    both = both.filter("kind in ('radius', 'vpn') and coalesce(user, '') != ''")
    edges = both.select("ip", F.col("valid_from").alias("t")).union(both.select("ip", F.col("valid_to").alias("t"))).distinct()
    order = Window.partitionBy("ip").orderBy("t")
    spans = edges.withColumn("to", F.lead("t").over(order)).filter("to is not null").withColumnRenamed("t", "at")
    found = covering(spans, both)
    rank = F.struct("valid_from", (F.col("kind") == "radius").alias("r"), "claim_id")
    answers = found.groupBy("ip", "at", "to").agg(*[F.max_by(F.when(F.col("side") == s, F.col("user")), F.when(F.col("side") == s, rank)).alias(s) for s in ("old", "new")])
    differ = answers.filter(~F.col("old").eqNullSafe(F.col("new")))
    fresh = F.when(F.lag("to").over(Window.partitionBy("ip").orderBy("at")) == F.col("at"), 0).otherwise(1)
    islands = differ.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(Window.partitionBy("ip").orderBy("at")))
    return islands.groupBy("ip", "_g").agg(F.min("at").alias("from"), F.max("to").alias("to")).drop("_g")


# Kinds of edges of the neighbour graph and what they join.
ENDS = {"ip-host": ("ip", "host"), "ip-user": ("ip", "user"), "host-mac": ("host", "mac")}


def claim_edges(claims_: DataFrame, start=None, end=None) -> DataFrame:
    """(type, a, b, valid_from, valid_to) of claims that touch [start, end) (null: unbounded): an address and its host or user, a host and its hardware.
    ``valid_to`` is null for a claim that nothing has closed. Equal edges of one start count once."""
    rows = claims_
    if start is not None:
        rows = rows.filter(F.col("valid_to") > F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("valid_from") < F.lit(end))
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    lease, login = F.col("kind") == "dhcp", F.col("kind").isin("radius", "vpn")
    edge = lambda ok, kind, a, b: F.when(ok, F.struct(F.lit(kind).alias("type"), F.col(a).alias("a"), F.col(b).alias("b")))
    edges = F.array_compact(F.array(edge(lease & said("host"), "ip-host", "ip", "host"), edge(lease & said("host") & said("mac"), "host-mac", "host", "mac"), edge(login & said("user"), "ip-user", "ip", "user")))
    until = F.when(F.col("closed"), F.col("valid_to"))
    each = rows.select(F.explode(edges).alias("e"), "valid_from", until.alias("valid_to")).select("e.type", "e.a", "e.b", "valid_from", "valid_to")
    return each.groupBy("type", "a", "b", "valid_from").agg(F.max("valid_to").alias("valid_to"))


def neighbours(claims_: DataFrame, asked: DataFrame, start=None, end=None) -> DataFrame:
    """(kind, id, type, a, b, valid_from, valid_to): the edges that touch each node of ``asked`` (kind: ip, user or host; id), and the hardware of each
    host that an address' edges lead to."""
    edges = claim_edges(claims_, start, end)
    ends = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(side).alias("kind"), F.col(c).alias("id")) for t, pair in ENDS.items() for side, c in zip(pair, ("a", "b"), strict=True)])
    touched = edges.withColumn("e", F.explode(F.filter(ends, lambda x: (x["t"] == F.col("type")) & (x["kind"] != "mac"))))
    near = touched.select(F.col("e.kind").alias("kind"), F.col("e.id").alias("id"), "type", "a", "b", "valid_from", "valid_to").join(asked.select("kind", "id").distinct(), ["kind", "id"], "left_semi")
    hosts = near.filter("type = 'ip-host' and kind != 'host'").select("kind", "id", F.col("b").alias("a")).distinct()
    hardware = edges.filter("type = 'host-mac'").join(hosts, "a").select("kind", "id", "type", "a", "b", "valid_from", "valid_to")
    return near.unionByName(hardware).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """(kind, id) of every end of ``edges`` (type, a, b)."""
    kind = lambda side: F.coalesce(*[F.when(F.col("type") == t, F.lit(pair[side])) for t, pair in ENDS.items()])
    both = F.array(F.struct(kind(0).alias("kind"), F.col("a").alias("id")), F.struct(kind(1).alias("kind"), F.col("b").alias("id")))
    return edges.select(F.explode(both).alias("n")).select("n.kind", "n.id").distinct()


def facts_of(fields: Column, rule: dict, received: Column, time_ms: Column | None = None) -> Column:
    """The identity fact (kind, action, ip, mac, host, user, at) that a record's fields tell by ``rule``: ``kind``; ``when`` a field is one of some values;
    ``action``: a field and an enum of its values, or a constant; the fields of ip, mac, host and user. ``at`` is the record's time, else its receipt.
    Null where ``when`` doesn't hold."""
    field = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("")) if k else F.lit("")
    what = rule["action"]
    action = F.coalesce(*[F.when(field(what["field"]) == k, F.lit(v)) for k, v in what["enum"].items()], F.lit("")) if isinstance(what, dict) else F.lit(what)
    at = F.coalesce(F.timestamp_millis(time_ms), received) if time_ms is not None else received
    fact = F.struct(F.lit(rule["kind"]).alias("kind"), action.alias("action"), *[field(rule.get(c)).alias(c) for c in ("ip", "mac", "host", "user")], at.alias("at"))
    when = rule.get("when")
    return F.when(fields.isNotNull() & field(when["field"]).isin(list(when["in"])) if when else fields.isNotNull(), fact)


def rebuild(facts: DataFrame) -> DataFrame:
    """Claims from all facts of a record table: validation, completion of VPN releases, intervals."""
    return claims(valid_facts(complete_vpn(facts)))


def entities(asked: DataFrame, claims_: DataFrame, key: str) -> DataFrame:
    """``asked`` (key, src_ip, dst_ip, at) with ``entities``: for each side with an address, who and what held it (type, id, role, valid_from, valid_to,
    confidence, evidence), users before hosts before hardware, the source's side first."""
    side = lambda role: asked.select(F.struct(F.col(key).alias("k"), F.lit(role).alias("role")).alias("_k"), F.col(f"{role}_ip").alias("ip"), "at").filter("ip is not null")
    found = resolve(side("src").union(side("dst")), claims_, "_k")
    one = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(c).alias("id"), F.col("_k.role").alias("role"), F.when(F.lit(kind) == "user", F.col("valid_from")).alias("valid_from"), F.when(F.lit(kind) == "user", F.col("valid_to")).alias("valid_to"), F.when(F.lit(kind) == "user", F.col("confidence")).otherwise(1.0).alias("confidence"), F.when(F.lit(kind) == "user", F.col("evidence")).alias("evidence")))
    each = found.select("_k", F.array_compact(F.array(one("user", "user"), one("host", "host"), one("mac", "mac"))).alias("e"))
    both = each.groupBy(F.col("_k.k").alias(key)).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct((F.col("_k.role") == "dst").alias("last"), "e"))), lambda x: x["e"])).alias("entities"))
    return asked.join(both, key, "left")
