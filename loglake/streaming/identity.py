"""Identities as facts stream in: claims and their changes, answers for events, and new answers where late facts change them.

One state an address: its facts, and the events that asked about it. Facts may come in any order; claims are derived anew from the address' facts, what
changed is told as rows, and events whose answer is another now are answered again. At the end of a stream the claims (added minus taken back) are those of
``operators.identity.claims`` over all facts, and the last answers those of ``resolve``. ``keep_hours`` bounds the state: facts and events that are
older than the newest by more are forgotten; what comes later than that is for the batch job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loglake.operators.identity import HOLDER, TTL_HOURS, internal

FACTS = "kind string, action string, user string, host string, mac string, at bigint, record_id bigint"
OUT = "ip string, what string, turn bigint, id bigint, n int, kind string, user string, host string, mac string, since bigint, until bigint, closed boolean, record_id bigint, confidence double"
FIELDS = [c.split()[0] for c in OUT.split(", ")]
HOUR = 3_600_000_000


def claims_of(kind: str, facts: list[tuple]) -> list[tuple]:
    """(kind, user, host, mac, from, to, closed, record_id) of one address and kind; facts (kind, action, user, host, mac, at, record_id)."""
    ttl = TTL_HOURS[kind] * HOUR
    open_: list[dict] = []
    order = sorted(facts, key=lambda f: (f[5], f[6]))
    for k, fact in enumerate(order):
        if fact[1] != "bind":
            continue
        last = order[k - 1] if k else None
        follower = order[k + 1][5] if k + 1 < len(order) else None
        if last and last[1] == "bind" and last[2:5] == fact[2:5] and fact[5] < last[5] + ttl:
            open_[-1] |= {"seen": fact[5], "next": follower}
        else:
            open_.append({"fact": fact, "seen": fact[5], "next": follower})
    out = []
    for c in open_:
        _, _, user, host, mac, since, record = c["fact"]
        end = c["seen"] + ttl
        closed = c["next"] is not None and c["next"] <= end
        until = c["next"] if closed else end
        if until > since:
            out.append((kind, user, host, mac, since, until, closed, record))
    return out


def derive(facts: list[tuple]) -> list[tuple]:
    return [c for kind in TTL_HOURS for c in claims_of(kind, [f for f in facts if f[0] == kind])]


def answer(claims: list[tuple], at: int) -> tuple:
    """(user, host, mac, since, until, record_id, confidence): the newest login (RADIUS before VPN), surer if no other user was there; the newest lease."""
    here = [c for c in claims if c[4] <= at < c[5]]
    users = [c for c in here if c[0] != "dhcp" and c[1]]
    leases = [c for c in here if c[0] == "dhcp"]
    lease = max(leases, key=lambda c: (c[4], c[7])) if leases else None
    machine = (lease[2] or None, lease[3].lower() or None) if lease else (None, None)
    if not users:
        return None, *machine, None, None, None, None
    best = max(users, key=lambda c: (c[4], c[0] == "radius", c[7]))
    return best[1], *machine, best[4], best[5] if best[6] else None, best[7], 0.7 if len({c[1] for c in users}) > 1 else 1.0


def windows(old: list[tuple], new: list[tuple], last: int) -> list[tuple[int, int]]:
    """Spans up to the last instant asked about whose answer (who, how sure) is another now."""
    told = lambda claims, t: (lambda a: (a[0], a[1], a[2], a[5], a[6]))(answer(claims, t))
    edges = sorted({t for c in [*old, *new] for t in c[4:6] if t <= last} | {last + 1})
    out: list[list[int]] = []
    for a, b in zip(edges, edges[1:]):
        if told(old, a) != told(new, a):
            if out and out[-1][1] == a:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [tuple(w) for w in out]


class Identities(StatefulProcessor):
    def __init__(self, keep_hours: float | None = None, idle_ms: int | None = None):
        self.keep, self.idle = int(keep_hours * HOUR) if keep_hours else None, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getListState("facts", FACTS)
        self.asked = handle.getListState("asked", "id bigint, at bigint")
        self.turn = handle.getValueState("turn", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, asked = [tuple(f) for f in self.facts.get()], [tuple(a) for a in self.asked.get()]
        turn = (self.turn.get()[0] if self.turn.exists() else 0) + 1
        facts, fresh = dict.fromkeys(held), []
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.what == "fact":
                    facts[(r.kind, r.action, r.user or "", r.host or "", r.mac or "", int(r.at), int(r.record_id))] = None
                else:
                    fresh.append((int(r.id), int(r.at)))
        old, new = derive(held), derive(list(facts))
        out = [("window", turn, None, None, None, None, None, None, a, b, None, None, None) for a, b in (windows(old, new, max(a for _, a in asked)) if asked and old != new else [])]
        for sign, mine, other in ((-1, old, new), (1, new, old)):
            out += [("claim", turn, None, sign, *c, None) for c in mine if c not in other]
        out += [self.told(turn, a, answer(new, a[1])) for a in fresh]
        out += [self.told(turn, a, answer(new, a[1])) for a in asked if old != new and answer(new, a[1]) != answer(old, a[1])]
        asked += fresh
        if self.keep:
            oldest = max([f[5] for f in facts] + [a for _, a in asked]) - self.keep
            asked = [a for a in asked if a[1] >= oldest]
            # a claim is forgotten with all its facts, or not at all
            bound = {k: min([c[4] for c in new if c[0] == k and c[5] >= oldest], default=oldest) for k in TTL_HOURS}
            facts = {f: None for f in facts if f[5] >= min(bound[f[0]], oldest)}
        self.facts.put(list(facts)) if facts else self.facts.clear()
        self.asked.put(asked) if asked else self.asked.clear()
        self.turn.update((turn,))
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield frame(key[0], out)

    @staticmethod
    def told(turn: int, asked: tuple, a: tuple) -> tuple:
        user, host, mac, since, until, record, confidence = a
        return ("answer", turn, asked[0], None, None, user, host, mac, since, until, None, record, confidence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An address that nothing has been heard of for ``idle_ms`` has no state any more."""
        self.facts.clear()
        self.asked.clear()
        yield frame(key[0], [])

    def close(self) -> None:
        pass


def frame(ip: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(ip, *r) for r in rows], columns=FIELDS, dtype=object)
    for c in ("turn", "id", "n", "since", "until", "record_id"):
        out[c] = out[c].astype("Int64")
    out["closed"] = out["closed"].astype("boolean")
    out["confidence"] = out["confidence"].astype("Float64")
    return out


def identities(facts: DataFrame, asked: DataFrame | None = None, keep_hours: float | None = None, idle_ms: int | None = None) -> DataFrame:
    """Streams of facts (kind, action, ip, mac, host, user, at, record_id) and questions (id, ip, at) to rows of what changed: ``claim`` (n: 1 new, -1 taken
    back), ``window`` (since, until: the answer for this span, up to the last question, is another now), ``answer`` (id; of several the one with the
    highest turn holds). Facts of other kinds, actions or addresses are left out. Needs the RocksDB state store."""
    fine = F.col("kind").isin(list(TTL_HOURS)) & F.col("action").isin("bind", "release") & F.col("at").isNotNull() & internal(F.col("ip"))
    none = lambda t: F.lit(None).cast(t)
    rows = facts.filter(fine).select("ip", F.lit("fact").alias("what"), none("bigint").alias("id"), "kind", "action", *HOLDER, F.unix_micros("at").alias("at"), "record_id")
    if asked is not None:
        rows = rows.union(asked.filter(F.col("ip").isNotNull() & F.col("at").isNotNull()).select("ip", F.lit("ask"), "id", *[none("string")] * 5, F.unix_micros("at"), F.lit(0).cast("bigint")))
    out = rows.groupBy("ip").transformWithStateInPandas(Identities(keep_hours, idle_ms), OUT, "Append", "ProcessingTime" if idle_ms else "None")
    return out.withColumns({"since": F.timestamp_micros("since"), "until": F.timestamp_micros("until")})


def claims_now(changes: DataFrame) -> DataFrame:
    """The claims that hold after all changes, as ``operators.identity.claims`` has them."""
    keys = ["ip", "kind", *HOLDER, "since", "until", "closed", "record_id"]
    left = changes.filter("what = 'claim'").groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 0")
    return left.select("ip", "kind", *HOLDER, F.col("since").alias("valid_from"), F.col("until").alias("valid_to"), "closed", "record_id")


def answers_now(changes: DataFrame) -> DataFrame:
    """The last answer of each question: id, ip, user, confidence, valid_from, valid_to, host, mac."""
    last = F.max_by(F.struct("user", "confidence", F.col("since").alias("valid_from"), F.col("until").alias("valid_to"), "host", "mac"), "turn").alias("a")
    return changes.filter("what = 'answer'").groupBy("id", "ip").agg(last).select("id", "ip", "a.*")
