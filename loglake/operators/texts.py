"""Parsers for free text: a pattern a template, with typed slots and the address that is the source.

Lines are cut into words, signs, blanks and times, dealt to families, and counted by (family, position, value); what is decided afterwards is decided on one
row a family, which holds one entry a position of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.operators import columns, drift, propose
from loglake.session import stored

# How each form of ``propose.TIMES`` is read, the words before an address or a message that say who is who, and how sure each sign makes.
TIME_FORMS = [
    (r"[A-Z][a-z]{2} +\d+ \d{4} \d\d:\d\d:\d\d", r"[A-Z][a-z]{2} +\d+ \d{4} [\d:]+"),
    (r"[A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d", r"[A-Z][a-z]{2} +\d+ [\d:]+"),
    (r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d", r"\d{4}/\d\d/\d\d [\d:]+"),
    (r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?", r"\d{4}-\d\d-\d\d[ T][\d:.]+(?:Z|[+-]\d\d:?\d\d)?"),
]
ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}"
FROM_WORDS, TO_WORDS = ["src", "source", "from", "orig"], ["dst", "dest", "destination"]
SURE, LIKELY, GUESS = 0.85, 0.75, 0.65
GROUPS = {"src_endpoint.ip": "src_ip", "dst_endpoint.ip": "dst_ip", "src_endpoint.port": "src_port", "dst_endpoint.port": "dst_port", "time": "ts", "action_id": "action"}

KEYS, COUNTED = ["source_id", "template", "skeleton", "code"], ["ipv4", "port", "integer"]


def kind_of(t: Column) -> Column:
    """t (a time), a blank, w (a word or number), or the sign itself."""
    return F.when(t.rlike(f"^(?:{propose.TIMES})$"), "t").when(t.rlike(r"^\s"), " ").when(t.rlike(r"^[\w.]"), "w").otherwise(t)


def families(lines: DataFrame, least: int = propose.CLUSTER, codes: int = 2) -> DataFrame:
    """(source_id, record_id, template, skeleton, code, tokens): a family is a template and the kinds of its tokens. One that differs in a code (two to
    twelve numbers of one length of three digits or more, each on ``least`` lines) is a family a code; at most ``codes`` such positions, from the left."""
    cut = drift.assigned(lines).select("source_id", "record_id", "template", F.regexp_extract_all("raw", F.lit(propose.TOKEN), F.lit(0)).alias("tokens"))
    cut = cut.withColumns({"skeleton": F.array_join(F.transform("tokens", kind_of), ""), "code": F.lit("")})
    for _ in range(codes):  # what is found out is a row a family of ``least`` lines or more; dealt by family, all lines of one would go to one task
        seen = cut.select(*KEYS, F.posexplode("tokens").alias("position", "value")).groupBy(*KEYS, "position", "value").agg(F.count(F.lit(1)).alias("n"))
        width = F.length("value")
        spots = seen.groupBy(*KEYS, "position").agg(F.count(F.lit(1)).alias("c"), F.bool_and(F.col("value").rlike(r"^\d{3,}$")).alias("digits"), (F.min(width) == F.max(width)).alias("even"), F.min("n").alias("fewest"))
        first = spots.filter((F.col("c").between(2, 12)) & F.col("digits") & F.col("even") & (F.col("fewest") >= least)).groupBy(*KEYS).agg(F.min("position").alias("_at"))
        added = F.when(F.col("_at").isNotNull(), F.concat("code", F.lit("|"), F.get("tokens", F.col("_at")))).otherwise(F.col("code"))
        cut = cut.join(F.broadcast(first), KEYS, "left").withColumn("code", added).drop("_at")
    return cut


def copies(cut: DataFrame, typed: DataFrame, least: float = 0.95) -> DataFrame:
    """(g, position): slots of addresses and numbers whose values are those of an earlier slot of their type on nearly all lines."""
    some = typed.filter(F.col("type").isin(COUNTED)).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("position", "type"))).alias("_p"))
    rows = cut.select(F.struct(*KEYS).alias("g"), "tokens").join(F.broadcast(some), "g")
    slots = F.transform("_p", lambda p: F.struct(p["position"].alias("at"), p["type"].alias("type"), F.get("tokens", p["position"]).alias("v")))
    rows = rows.select("g", slots.alias("_s"))
    same = F.flatten(F.transform("_s", lambda b: F.transform(F.filter("_s", lambda a: (a["at"] < b["at"]) & (a["v"] == b["v"]) & (a["type"] == b["type"])), lambda a: F.struct(a["at"].alias("a"), b["at"].alias("b")))))
    agreed = rows.select("g", F.inline(same)).groupBy("g", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    return agreed.join(sizes(cut), "g").filter(F.col("c") >= least * F.col("lines")).select("g", F.col("b").alias("position")).distinct()


def sizes(cut: DataFrame) -> DataFrame:
    return cut.groupBy(F.struct(*KEYS).alias("g")).agg(F.count(F.lit(1)).alias("lines"), F.min("record_id").alias("first"))


def sheets(lines: DataFrame, least: int, codes: int) -> DataFrame:
    """(g, lines, first, n, s): one row a family of ``least`` lines or more, numbered by size within its source; ``s`` has an entry a position: at, kind,
    text (null where it varies), slot, type, path, confidence, copy, known (share of well-known ports), small (all below 65536), form and what maps need."""
    cut = stored(families(lines, least, codes), "families")
    sized = sizes(cut).filter(F.col("lines") >= least).withColumn("n", F.row_number().over(Window.partitionBy("g.source_id").orderBy(F.desc("lines"), "first")))
    words = cut.select(F.struct(*KEYS).alias("g"), F.posexplode("tokens").alias("position", "value"))
    seen = words.groupBy("g", "position", "value").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(sized.select("g")), "g", "left_semi")
    number = F.when(F.col("value").rlike(r"^\d{1,18}$"), F.col("value").cast("bigint"))
    form = F.coalesce(*[F.when(F.col("value").rlike(f"^(?:{a})$"), F.lit(k)) for k, (a, _) in enumerate(TIME_FORMS)])
    known = F.sum(F.when(number.isin(columns.WELL_KNOWN), F.col("n")).otherwise(0)) / F.sum("n")
    spots = seen.groupBy("g", "position").agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("text"), known.alias("known"), F.bool_and(F.coalesce(number <= 65535, F.lit(False))).alias("small"), F.array_sort(F.collect_set(form)).alias("forms"))
    spots = spots.withColumn("kind", kind_of(F.col("text"))).withColumn("slot", (F.col("c") > 1) & F.col("kind").isin("w", "t"))
    slots = F.broadcast(spots.filter("slot").select("g", "position"))
    long = seen.join(slots, ["g", "position"], "left_semi").select(F.col("g").alias("source_id"), F.concat(F.lit("slot_"), F.col("position").cast("string")).alias("field"), "value", "n")
    typed = columns.typed(long, names=False).withColumnsRenamed({"source_id": "g", "place": "position"}).drop("field", "distinct", "least_value", "alternatives")
    twin = copies(cut, typed.select("g", "position", "type")).withColumn("copy", F.lit(True))
    full = spots.join(typed, ["g", "position"], "left").join(twin, ["g", "position"], "left")
    none = lambda k, v: F.coalesce(k, F.lit(v)).alias(k)
    spot = F.struct(F.col("position").alias("at"), "kind", F.when(F.col("c") == 1, F.col("text")).alias("text"), "slot", none("type", ""), none("path", ""), none("confidence", 0.0), none("copy", False), "known", "small", "forms", "layout", "listed", none("numeric", False))
    return full.groupBy("g").agg(F.array_sort(F.collect_list(spot)).alias("s")).join(sized, "g").filter(F.exists("s", lambda x: x["slot"]))


def first_of(a: Column) -> Column:
    return F.get(a, F.lit(0))


def after(x: Column) -> Column:
    """What follows a position, past at most three signs."""
    return first_of(F.filter("s", lambda y: (y["at"] > x["at"]) & (y["at"] <= x["at"] + 4) & y["kind"].isin("w", "t", " ")))


def before(s: Column, x: Column) -> Column:
    return F.try_element_at(F.filter(s, lambda y: (y["at"] < x["at"]) & (y["at"] >= x["at"] - 4) & y["kind"].isin("w", "t", " ")), F.lit(-1))


def literal(x: Column) -> Column:
    return (x["kind"] == "w") & ~x["slot"]


def directed(sheet: DataFrame) -> DataFrame:
    """``sheet`` with src and dst (positions), why and sure. The first two addresses that aren't copies are source and destination, in the order that the
    first of these tells: a word of the two literal ones before one of them; an arrow between them; inbound or outbound before them (the first address is the
    foreign host); which has a well-known port behind it; else their places. A single address is the source."""
    two = F.filter("s", lambda x: x["slot"] & (x["type"] == "ipv4") & ~x["copy"])
    x = sheet.withColumns({"_a": F.get(two, F.lit(0)), "_b": F.get(two, F.lit(1))})

    def cue(spot: Column) -> Column:
        near = F.slice(F.reverse(F.filter("s", lambda y: literal(y) & (y["at"] < spot["at"]) & (y["at"] >= spot["at"] - 7))), 1, 2)
        return first_of(F.filter(F.transform(near, lambda y: F.when(F.lower(y["text"]).isin(FROM_WORDS), "src").when(F.lower(y["text"]).isin(TO_WORDS), "dst")), lambda w: w.isNotNull()))

    def serves(spot: Column) -> Column:
        q = after(spot)
        fixed = F.when(q["text"].rlike(r"^\d+$"), q["text"].isin([str(p) for p in columns.WELL_KNOWN]).cast("double"))
        return F.when(q["slot"], F.when(q["type"].isin("port", "integer") & ~q["copy"], q["known"])).when(q["kind"] == "w", fixed)

    a, b = F.col("_a"), F.col("_b")
    x = x.withColumns({"_ca": cue(a), "_cb": cue(b), "_sa": serves(a), "_sb": serves(b)})
    between = F.array_join(F.transform(F.filter("s", lambda y: (y["at"] > a["at"]) & (y["at"] < b["at"])), lambda y: F.coalesce(y["text"], F.lit("\0"))), "")
    course = first_of(F.transform(F.filter("s", lambda y: literal(y) & (y["at"] < a["at"]) & F.lower(y["text"]).isin("inbound", "outbound")), lambda y: F.lower(y["text"])))
    x = x.withColumns({"_arrow": between.contains("->"), "_course": course})
    tell = lambda forth, why, sure: F.struct(F.lit(forth).alias("forth"), F.lit(why).alias("why"), F.lit(sure).alias("sure"))
    c = F.col
    is_ = lambda k, v: c(k).eqNullSafe(F.lit(v))
    told = (
        F.when(b.isNull(), F.lit(None))
        .when(is_("_ca", "src") | is_("_cb", "dst"), tell(True, "a word before the address", SURE))
        .when(is_("_ca", "dst") | is_("_cb", "src"), tell(False, "a word before the address", SURE))
        .when(c("_arrow"), tell(True, "the arrow between the addresses", SURE))
        .when(is_("_course", "inbound"), tell(True, "inbound: the first address is the foreign host", LIKELY))
        .when(is_("_course", "outbound"), tell(False, "outbound: the first address is the foreign host", LIKELY))
        .when((c("_sa") >= 0.8) & (c("_sb") <= 0.2), tell(False, "a well-known port", LIKELY))
        .when((c("_sb") >= 0.8) & (c("_sa") <= 0.2), tell(True, "a well-known port", LIKELY))
        .otherwise(tell(True, "its place only", GUESS))
    )
    x = x.withColumn("_t", told)
    forth = F.coalesce(c("_t.forth"), F.lit(True))
    return x.withColumns({"src": F.when(forth, a["at"]).otherwise(b["at"]), "dst": F.when(forth, b["at"]).otherwise(a["at"]), "why": c("_t.why"), "sure": c("_t.sure")})


def pathed(sheet: DataFrame) -> DataFrame:
    """``sheet`` of ``directed`` with the paths settled: a number behind an address is its port, any other number has no path, and a path belongs to the
    first slot that has it."""
    is_ = lambda x, k: x["at"].eqNullSafe(F.col(k))
    number = lambda x: x["type"].isin("port", "integer") & ~x["copy"]

    def settled(x: Column) -> Column:
        p = before(F.col("s"), x)
        behind = number(x) & x["small"] & (is_(p, "src") | is_(p, "dst"))
        port = F.when(is_(p, "src"), "src_endpoint.port").otherwise("dst_endpoint.port")
        path = F.when(~x["slot"] | x["copy"], "").when(behind, port).when(number(x), "").when(is_(x, "src"), "src_endpoint.ip").when(is_(x, "dst"), "dst_endpoint.ip").when(x["type"] == "ipv4", "").otherwise(x["path"])
        addressed = is_(x, "src") | is_(x, "dst")
        own = F.when(behind, F.round(F.coalesce(F.col("sure"), p["confidence"]) * 0.95, 3)).when(x["copy"] | number(x), 0.5).when(addressed, F.coalesce(F.col("sure"), x["confidence"])).otherwise(x["confidence"])
        return x.withField("path", path).withField("type", F.when(behind, "port").when(number(x), "integer").otherwise(x["type"])).withField("confidence", own)

    x = sheet.withColumn("_s", F.transform("s", settled))
    taken = lambda x: F.exists("_s", lambda y: (y["at"] < x["at"]) & (y["path"] == x["path"]))
    return x.withColumn("s", F.transform("_s", lambda x: x.withField("path", F.when((x["path"] != "") & taken(x), "").otherwise(x["path"])))).drop("_s")


def group_name(x: Column) -> Column:
    short = F.coalesce(F.try_element_at(F.create_map(*[F.lit(t) for pair in GROUPS.items() for t in pair]), x["path"]), F.when(x["path"] != "", F.element_at(F.split(x["path"], r"\."), -1)))
    return F.coalesce(short, F.concat(F.lit("v"), x["at"].cast("string")))


def escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"([.^$*+?()\[\]{}|\\])", r"\\$1")


def pattern(s: Column) -> Column:
    """The anchored pattern of a family; blanks that vary are one or more blanks."""
    forms = lambda x: F.transform(x["forms"], lambda k: F.get(F.array(*[F.lit(rx) for _, rx in TIME_FORMS]), k))
    times = lambda x: F.when(F.size(x["forms"]) == 1, F.get(forms(x), F.lit(0))).otherwise(F.concat(F.lit("(?:"), F.array_join(forms(x), "|"), F.lit(")")))
    shape = lambda x: F.when(x["kind"] == "t", times(x)).when(x["type"] == "ipv4", ADDRESS).when(x["type"].isin("port", "integer"), r"\d+").otherwise(r"[\w.]+")
    part = lambda x: F.when(x["slot"], F.concat(F.lit("(?P<"), group_name(x), F.lit(">"), shape(x), F.lit(")"))).when(x["text"].isNull(), " +").otherwise(escaped(x["text"]))
    return F.concat(F.lit("^"), F.array_join(F.transform(s, part), ""), F.lit("$"))


def template_of(s: Column) -> Column:
    """What renders a line again; null where blanks vary."""
    part = lambda x: F.when(x["slot"], F.concat(F.lit("{"), group_name(x), F.lit("}"))).otherwise(F.replace(F.replace(x["text"], F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}")))
    return F.when(~F.exists(s, lambda x: ~x["slot"] & x["text"].isNull()), F.array_join(F.transform(s, part), ""))


def constants(sheet: DataFrame) -> DataFrame:
    """(g, place, n, e): entries of what is the same in all lines: a port behind an address, and the first word that names a protocol and an action."""
    has = lambda *paths: F.exists("s", lambda x: x["path"].isin(*paths))
    const = lambda to, value: propose.entry(F.lit(""), to, "const", default=value)
    pick = lambda words: first_of(F.filter(F.transform(F.filter("s", literal), lambda x: F.lower(x["text"])), lambda w: w.isin(list(words))))
    actions = {a: "1" if a in columns.ALLOWING else "2" for a in columns.ACTIONS if a != "alert"}
    value = lambda m, k: F.try_element_at(F.create_map(*[F.lit(str(t)) for pair in m.items() for t in pair]), k)
    spot = lambda k: first_of(F.filter("s", lambda x: x["path"] == f"{k}_endpoint.ip"))
    x = sheet.withColumns({"_protocol": F.when(~has("connection_info.protocol_num", "connection_info.protocol_name"), pick(columns.PROTOCOL_NUMBERS)), "_action": F.when(~has("action_id"), pick(actions))})
    ports = [F.when(literal(after(spot(k))) & after(spot(k))["text"].rlike(r"^\d+$") & ~has(f"{k}_endpoint.port"), const(f"{k}_endpoint.port", after(spot(k))["text"])) for k in ("src", "dst")]
    known = F.col("_protocol").isNotNull()
    words = [F.when(known, const("connection_info.protocol_num", value(columns.PROTOCOL_NUMBERS, F.col("_protocol")))), F.when(known, const("connection_info.protocol_name", F.col("_protocol"))), F.when(F.col("_action").isNotNull(), const("action_id", value(actions, F.col("_action"))))]
    return x.select("g", F.lit(1 << 30).alias("place"), F.posexplode(F.array_compact(F.array(*ports, *words))).alias("n", "e"))


def detector(sheet: DataFrame, lines: DataFrame, share: float = 0.95) -> DataFrame:
    """(source_id, signature): the longest text of five signs or more in the largest family's literals that also stands in those of families with ``share``
    of the source's lines; any sign where there is none."""
    runs = F.array_join(F.transform("s", lambda x: F.coalesce(x["text"], F.lit("\0"))), "")
    texts = sheet.select("g.source_id", "lines", "n", runs.alias("_text"))
    big = texts.filter("n = 1").select("source_id", F.explode(F.split("_text", "\0")).alias("_run")).filter(F.length("_run") >= 5)
    starts = big.select("source_id", "_run", F.explode(F.sequence(F.lit(1), F.length("_run") - 4)).alias("_i"))
    cuts = starts.select("source_id", "_run", "_i", F.explode(F.sequence(F.lit(5), F.length("_run") - F.col("_i") + 1)).alias("_l")).select("source_id", F.expr("substring(_run, _i, _l)").alias("_c")).distinct()
    held = cuts.join(texts.select("source_id", "lines", "_text"), "source_id").filter(F.contains("_text", "_c")).groupBy("source_id", "_c").agg(F.sum("lines").alias("_n"))
    total = propose.counts(lines.filter(F.trim("raw") != "")).withColumnRenamed("lines", "_all")
    best = held.join(total, "source_id").filter(F.col("_n") >= share * F.col("_all")).groupBy("source_id").agg(F.min(F.struct(-F.length("_c"), "_c"))["_c"].alias("_best"))
    return total.join(best, "source_id", "left").select("source_id", F.coalesce(escaped(F.col("_best")), F.lit(r"\S")).alias("signature"))


def propose_text(lines: DataFrame, least: int = propose.CLUSTER, codes: int = 2) -> DataFrame:
    """(source_id, extractor, lines, pattern, render, map, slots, confirm, signature): an extractor a family of free text of ``least`` lines or more that has
    a position that varies, the largest first. ``slots`` has at, name, type, path and confidence of each; ``confirm`` says by what the direction was decided
    where a reviewer should look. Smaller families get no extractor: their lines stay rejected. Null and blank lines are left out; equal lines count each."""
    sheet = stored(pathed(directed(sheets(lines.filter(F.trim("raw") != ""), least, codes))), "sheets")  # a row a family
    slot = F.explode(F.filter("s", lambda x: x["slot"] & (x["path"] != "")))
    each = sheet.select("g", slot.alias("x")).select("g", F.col("x.at").alias("place"), F.posexplode(propose.entries(group_name(F.col("x")), *[F.col(f"x.{k}") for k in ("path", "type", "numeric", "listed", "layout")])).alias("n", "e"))
    maps = propose.gathered(each.unionByName(constants(sheet)).withColumnRenamed("g", "source_id")).withColumnRenamed("source_id", "g")
    bare = F.array(*[propose.entry(F.lit(""), to, "const", default=v) for to, v in (("activity_id", "6"), ("severity_id", "1"))])
    slots = F.transform(F.filter("s", lambda x: x["slot"]), lambda x: F.struct(x["at"].alias("at"), group_name(x).alias("name"), x["type"].alias("type"), x["path"].alias("path"), x["confidence"].alias("confidence")))
    out = sheet.join(maps, "g", "left").withColumn("map", F.coalesce("map", bare)).withColumn("source_id", F.col("g.source_id")).join(detector(sheet, lines), "source_id")
    confirm = F.when(F.col("sure") < SURE, F.col("why"))
    return out.select("source_id", F.concat(F.lit("tpl_"), F.col("n").cast("string")).alias("extractor"), "lines", pattern(F.col("s")).alias("pattern"), template_of(F.col("s")).alias("render"), "map", slots.alias("slots"), confirm.alias("confirm"), "signature")


def spec(rows: list, zone: str | None = None) -> dict:
    """The spec of a source from its (few) rows of ``propose_text``, as ``normalize`` follows it."""

    def how(e) -> dict:
        if e["type"] == "const":
            return {"const": int(e["default"]) if e["default"].isdigit() else e["default"]}
        rule = {"from": e["from"], "type": e["type"]} | {k: e[k] for k in ("layout", "default") if e[k] is not None}
        if e["type"] == "enum":
            rule["values"] = dict(pair.split("=", 1) for pair in e["enum"].split(",") if pair)
        if e["type"] == "time" and zone:
            rule["zone"] = zone
        return rule

    ordered = sorted(rows, key=lambda r: int(r["extractor"].removeprefix("tpl_")))
    extractors = [{"id": r["extractor"], "kind": "regex", "options": {"pattern": r["pattern"]}, "map": {e["to"]: how(e) for e in r["map"]}} | ({"render": r["render"]} if r["render"] else {}) for r in ordered]
    name = f"{ordered[0]['source_id']}_auto"
    return {"id": name, "version": "1.0.0", "vendor": str(ordered[0]["source_id"]), "product": "auto", "signature": ordered[0]["signature"], "extractors": extractors, "defaults": {"class_uid": 4001, "category_uid": 4}}
