"""Parser proposals: what a spec for an unknown source would map, from the types of its fields.

A proposal is a row a source (and group): a signature and ``map``, an array of (from, to, type, layout, enum, default), constants with an empty ``from``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.operators import columns, drift
from loglake.session import stored

# Names of protocols and bands of severities by number, keys that tell kinds of records apart, standard keys of CEF and LEEF extensions.
PROTOCOL_NAMES = {"6": "tcp", "17": "udp", "1": "icmp", "58": "icmpv6", "132": "sctp"}
CEF_SEVERITY = {"0": 2, "1": 2, "2": 2, "3": 2, "4": 3, "5": 3, "6": 3, "7": 4, "8": 4, "9": 5, "10": 5}
ROUTE_KEYS = ["event_type", "type", "kind", "category"]
KIND_KEYS = ["type", "logtype", "log_type", "event_type", "category"]
STANDARD_KEYS = [
    ("src", "src_endpoint.ip", "ipv4"), ("dst", "dst_endpoint.ip", "ipv4"), ("spt", "src_endpoint.port", "port"), ("dpt", "dst_endpoint.port", "port"), ("srcPort", "src_endpoint.port", "port"), ("dstPort", "dst_endpoint.port", "port"),
    ("smac", "src_endpoint.mac", "mac"), ("dmac", "dst_endpoint.mac", "mac"), ("proto", "connection_info.protocol_name", "protocol"), ("act", "action_id", "action"), ("action", "action_id", "action"), ("rt", "time", "timestamp"), ("devTime", "time", "timestamp"),
]
WORD = r"^[A-Za-z][\w-]{2,}$"
#: The share of records that must carry a key, and the records that an extractor of its own needs.
CARRIED, CLUSTER = 0.99, 50
ENTRY = "struct<from:string,to:string,type:string,layout:string,enum:string,default:string>"


def enumeration(listed: Column, values: dict) -> Column:
    """``value=meaning`` of the listed values that ``values`` knows, joined by commas."""
    known = F.create_map(*[F.lit(str(x)) for pair in values.items() for x in pair])
    return F.array_join(F.array_compact(F.transform(listed, lambda v: F.concat(v, F.lit("="), F.try_element_at(known, v)))), ",")


def entry(source: Column, to: Column | str, kind: str, layout: Column | None = None, enum: Column | None = None, default: str | None = None) -> Column:
    text = lambda x: (F.lit(x) if x is None or isinstance(x, str) else x).cast("string")
    return F.struct(text(source).alias("from"), text(to).alias("to"), F.lit(kind).alias("type"), text(layout).alias("layout"), text(enum).alias("enum"), text(default).alias("default"))


def entries(field: Column, path: Column, kind: Column, numeric: Column, listed: Column, layout: Column) -> Column:
    """The map entries of a typed field, as an array."""
    actions = enumeration(listed, {a: 1 if a in columns.ALLOWING else 2 for a in columns.ACTIONS if a != "alert"})
    words = enumeration(listed, columns.SEVERITY_NUMBERS)
    names = enumeration(listed, PROTOCOL_NAMES)
    number = F.array(entry(field, path, "int"), F.when(names != "", entry(field, "connection_info.protocol_name", "enum", enum=names, default="other")))
    name = F.array(entry(field, path, "lower"), entry(field, "connection_info.protocol_num", "enum", enum=enumeration(listed, columns.PROTOCOL_NUMBERS), default="0"))
    out = (
        F.when(kind == "timestamp", F.array(entry(field, path, "time", layout)))
        .when(kind.isin("ipv4", "ipv6"), F.array(entry(field, path, "ip")))
        .when(kind == "port", F.array(entry(field, path, "port")))
        .when(kind == "protocol", F.when(numeric, F.array_compact(number)).otherwise(name))
        .when(kind == "action", F.array(entry(field, path, "enum", enum=actions, default="99")))
        .when(kind == "mac", F.array(entry(field, path, "mac")))
        .when(kind == "severity", F.when(words != "", F.array(entry(field, path, "enum", enum=words, default="99"))).otherwise(F.array(entry(field, path, "int"))))
        .otherwise(F.array(entry(field, path, "string")))
    )
    return F.coalesce(out, F.array().cast(f"array<{ENTRY}>"))


def mapped(typed: DataFrame) -> DataFrame:
    """(source_id, place, n, e): the entries of the fields that got a path."""
    c = F.col
    each = typed.filter("path != ''").select("source_id", "place", F.posexplode(entries(c("field"), c("path"), c("type"), c("numeric"), c("listed"), c("layout"))).alias("n", "e"))
    return each.select("source_id", "place", "n", "e")


def gathered(rows: DataFrame) -> DataFrame:
    """(source_id, map): entries in the order of their fields (a source has few), then the constants that every spec sets."""
    listed = rows.groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "n", "e"))), lambda x: x["e"]).alias("m"))
    constants = F.array(entry(F.lit(""), "activity_id", "const", default="6"))
    severity = F.when(~F.exists("m", lambda x: x["to"] == "severity_id"), F.array(entry(F.lit(""), "severity_id", "const", default="1"))).otherwise(F.array().cast(f"array<{ENTRY}>"))
    return listed.select("source_id", F.concat("m", constants, severity).alias("map"))


def counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("lines"))


def carried(keys: DataFrame, total: DataFrame) -> DataFrame:
    """``keys`` (source_id, key, c: records that have it, and more), a row a key, of those that nearly all records of a source carry. What a record holds is
    never joined to them: all values of a key would go to one task. Types are found for all keys, and those of others dropped."""
    return keys.join(total, "source_id").filter(F.col("c") >= CARRIED * F.col("lines"))


def as_long(found: DataFrame) -> DataFrame:
    return found.select("source_id", F.col("key").alias("field"), "value", *[k for k in ("n",) if k in found.columns])


def seen(found: DataFrame) -> DataFrame:
    """(source_id, key, value, n, record_id, and pos where ``found`` has it): each value of a key once, on how many records and on which first. It is kept,
    so that lines are read once however much is asked of their fields."""
    first = [F.min_by("pos", "record_id").alias("pos")] if "pos" in found.columns else []
    return stored(found.groupBy("source_id", "key", "value").agg(F.count(F.lit(1)).alias("n"), *first, F.min("record_id").alias("record_id")), "seen")


def propose_csv(lines: DataFrame) -> DataFrame:
    """(source_id, lines, min_columns, columns, marker, signature, map) for headerless CSV: columns count as far as every line has them; the first column
    that always says the same word marks the source."""
    found = seen(drift.fields(lines, F.lit("csv")))
    keys = stored(present(found), "keys")  # cells have no gaps: a column that is on as many records as any other is on all
    most = keys.groupBy("source_id").agg(F.max("c").alias("lines"))
    width = keys.join(most, "source_id").filter("c = lines").groupBy("source_id").agg(F.count(F.lit(1)).cast("int").alias("min_columns"), F.max("lines").alias("lines"))
    places = width.select("source_id", F.posexplode(F.sequence(F.lit(0), F.col("min_columns") - 1)).alias("_", "first")).select("source_id", F.concat(F.lit("col_"), F.col("first").cast("string")).alias("field"), "first")
    typed = stored(columns.typed(as_long(found), names=False, places=places), "typed")
    marks = typed.filter((F.col("distinct") == 1) & F.col("least_value").rlike(WORD)).groupBy("source_id").agg(F.min_by("least_value", "place").alias("marker"), F.min("place").alias("marker_at"))
    last = typed.filter("path != ''").groupBy("source_id").agg(F.max("place").alias("_last"), F.collect_set("place").alias("_places"))
    out = width.join(gathered(mapped(typed)), "source_id").join(marks, "source_id", "left").join(last, "source_id", "left")
    names = F.transform(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0))), lambda k: F.when(F.array_contains("_places", k), F.concat(F.lit("col_"), k.cast("string"))).otherwise("_"))
    signature = F.when(F.col("marker").isNotNull(), F.concat(F.lit("^(?:[^,]*,){"), F.col("marker_at").cast("string"), F.lit("}"), "marker", F.lit(","))).otherwise("^(?:[^,]*,)+")
    return out.select("source_id", "lines", "min_columns", names.alias("columns"), "marker", signature.alias("signature"), "map")


def pairs(lines: DataFrame) -> DataFrame:
    """(source_id, record_id, pos, key, value) of key=value lines."""
    return lines.select("source_id", "record_id", F.posexplode(drift.pair_fields(F.col("raw"))).alias("pos", "f")).select("source_id", "record_id", "pos", "f.key", "f.value")


def in_order(found: DataFrame) -> DataFrame:
    """(source_id, key, c, record_id, pos) of ``seen``: keys, on how many records they are, and where they first stand (a key is once on a record)."""
    return found.groupBy("source_id", "key").agg(F.sum("n").alias("c"), F.min_by("pos", "record_id").alias("pos"), F.min("record_id").alias("record_id"))


def typed_pairs(found: DataFrame, keys: DataFrame) -> DataFrame:
    """The typed ones of ``keys`` of key=value lines, by where they first stand: a row a key, which is kept, as many parts are made of it."""
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("record_id", "pos"))
    return stored(columns.typed(as_long(found), places=keys.select("source_id", F.col("key").alias("field"), first.alias("first"))), "typed")


def by_name(keys: DataFrame) -> DataFrame:
    """(source_id, field, first): keys by their names, where records have no order of keys."""
    return keys.select("source_id", F.col("key").alias("field"), F.row_number().over(Window.partitionBy("source_id").orderBy("key")).alias("first"))


def present(found: DataFrame) -> DataFrame:
    return found.groupBy("source_id", "key").agg(F.sum("n").alias("c"))


def propose_kv(lines: DataFrame) -> DataFrame:
    """(source_id, lines, signature, map) for a key=value source without a parser: keys that nearly all records carry; a date and a time of day make the
    time where nothing else does. The signature is built from a key that tells the kind, else from the first three mapped keys."""
    found = seen(pairs(lines))
    typed = typed_pairs(found, carried(in_order(found), counts(lines)))
    part = lambda t: typed.filter(F.col("type") == t).groupBy("source_id").agg(F.min_by(F.struct("field", "layout"), "place").alias(t))
    timed = typed.filter("path = 'time'").select("source_id").distinct()
    both = part("date").join(part("time_of_day"), "source_id").join(timed, "source_id", "left_anti")
    joined = both.select("source_id", F.lit(-1).alias("place"), F.lit(0).alias("n"), entry(F.concat("date.field", F.lit("+"), "time_of_day.field"), "time", "time", F.concat("date.layout", F.lit(" "), "time_of_day.layout")).alias("e"))
    told = F.coalesce(*[F.when((F.col("field") == k) & (F.col("distinct") == 1), F.lit(n)) for n, k in enumerate(KIND_KEYS)])
    kind = typed.withColumn("_k", told).filter("_k is not null").groupBy("source_id").agg(F.min_by(F.struct("field", "least_value"), "_k").alias("kind"))
    useful = (F.col("path") != "") | F.col("type").isin("date", "time_of_day")
    first = typed.groupBy("source_id").agg(*[F.slice(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("place", "field")))), lambda x: x["field"]), 1, 3).alias(name) for name, test in (("some", useful), ("any", F.lit(True)))])
    keys = F.array_join(F.transform(F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("any")), lambda k: F.concat(F.lit(r"\b"), k, F.lit("="))), ".*")
    signature = F.when(F.col("kind").isNotNull(), F.concat(F.lit(r"\b"), "kind.field", F.lit('="?'), "kind.least_value", F.lit('"?(?: |$)'))).otherwise(keys)
    out = counts(lines).join(gathered(mapped(typed).unionByName(joined)), "source_id").join(kind, "source_id", "left").join(first, "source_id", "left")
    return out.select("source_id", "lines", signature.alias("signature"), "map")


def propose_kv_patch(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source_id, change, old, new, to) for a key=value source whose keys moved. ``mapping`` (source_id, from: array, to) is what its spec maps now: kept
    where the keys still exist, moved to the new key that the same path is found for, else dropped; new keys of a sure type (0.8) are added."""
    found = seen(pairs(lines))
    order = stored(in_order(found), "keys")
    typed = typed_pairs(found, order)
    keys = order.groupBy("source_id").agg(F.collect_set("key").alias("_keys"))
    paths = typed.filter("path != ''").select("source_id", F.col("path").alias("to"), F.col("field").alias("new"))
    old = F.array_join("from", "+")
    now = mapping.join(keys, "source_id").withColumn("kept", F.forall("from", lambda k: F.array_contains("_keys", k))).join(paths, ["source_id", "to"], "left")
    change = F.when(F.col("kept"), "kept").when(F.col("new").isNotNull(), "moved").otherwise("dropped")
    moved = now.select("source_id", change.alias("change"), old.alias("old"), F.when(F.col("kept"), old).otherwise(F.col("new")).alias("new"), "to")
    covered = moved.filter("change != 'dropped'").select("source_id", "to")
    sure = typed.filter("path != '' and confidence >= 0.8 and type in ('ipv4', 'ipv6', 'port', 'mac')").select("source_id", F.lit("added").alias("change"), F.lit(None).cast("string").alias("old"), F.col("field").alias("new"), F.col("path").alias("to"))
    return moved.unionByName(sure.join(covered, ["source_id", "to"], "left_anti").select(*moved.columns))


def propose_json(lines: DataFrame) -> DataFrame:
    """(source_id, route, value, lines, map): an extractor for each value of the key that tells kinds of records apart (on 95 % of them, ten values at
    most), for groups that are large enough; one for all without such a key."""
    total = counts(lines)
    found = drift.fields(lines, F.lit("json"))
    told = found.filter(F.col("key").isin(ROUTE_KEYS) & F.col("quoted")).groupBy("source_id", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    routes = told.groupBy("source_id", "key").agg(F.sum("n").alias("c"), F.count("value").alias("d")).join(total, "source_id")
    fit = routes.filter((F.col("c") >= 0.95 * F.col("lines")) & (F.col("d") + (F.col("c") < F.col("lines")).cast("int") <= 10))
    rank = F.coalesce(*[F.when(F.col("key") == k, F.lit(n)) for n, k in enumerate(ROUTE_KEYS)])
    route = fit.groupBy("source_id").agg(F.min_by("key", rank).alias("route"))
    # a line finds its group in its own fields; only the route, a row a source, is brought to it
    said = F.get(F.filter("_f", lambda x: x["key"] == F.col("route")), F.lit(0))["value"]
    value = F.when(F.col("route").isNotNull(), F.coalesce(said, F.lit("None"))).otherwise("all")
    cut = lines.select("source_id", drift.line_fields(F.col("raw"), F.lit("json")).alias("_f")).join(F.broadcast(route), "source_id", "left")
    cut = cut.select(F.struct("source_id", F.coalesce("route", F.lit("")).alias("route"), value.alias("value")).alias("g"), "_f")
    sized = cut.groupBy("g").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") >= CLUSTER)
    own = cut.select(F.col("g").alias("source_id"), F.inline("_f")).groupBy("source_id", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    own = stored(own, "seen")
    # groups that are too small have no lines here, so that their keys are left out
    typed = columns.typed(as_long(own), places=by_name(carried(present(own), sized.withColumnRenamed("g", "source_id"))))
    out = sized.join(gathered(mapped(typed)).withColumnRenamed("source_id", "g"), "g", "left")
    return out.select("g.source_id", "g.route", "g.value", "lines", "map")


def propose_cef(lines: DataFrame, kind: str = "cef") -> DataFrame:
    """(source_id, lines, signature, map, unfit) for CEF or LEEF: the standard keys that nearly all records carry and whose values are of the type that the
    key stands for; ``unfit`` names those that aren't. The severity of CEF goes by its bands."""
    found = seen(drift.fields(lines, F.lit(kind)))
    kept = stored(carried(present(found), counts(lines)).select("source_id", "key"), "keys")
    typed = stored(columns.typed(as_long(found), places=by_name(kept)), "typed")
    spark = lines.sparkSession
    table = F.broadcast(spark.createDataFrame([(n, k, p, w) for n, (k, p, w) in enumerate(STANDARD_KEYS)], "n int, field string, to string, want string"))
    known = typed.join(table, "field").withColumn("fits", (F.col("type") == F.col("want")) | ((F.col("want") == "port") & (F.col("type") == "integer")))
    unfit = known.filter("not fits").groupBy("source_id").agg(F.array_sort(F.collect_set("field")).alias("unfit"))
    first = known.filter("fits").withColumn("r", F.row_number().over(Window.partitionBy("source_id", "to").orderBy("n"))).filter("r = 1")
    c = F.col
    each = first.select("source_id", c("n").alias("place"), F.posexplode(entries(c("field"), c("to"), c("want"), c("numeric"), c("listed"), c("layout"))).alias("n", "e"))
    name = "cef.severity" if kind == "cef" else "sev"
    levels = found.filter((c("key") == name) & (c("value") != "")).groupBy("source_id").agg(F.min(c("value").isin(list(CEF_SEVERITY)).cast("int")).alias("ok"), F.array_sort(F.collect_set(F.substring("value", 1, 2))).alias("v"))
    banded = levels.filter(c("ok") == 1).select("source_id", F.lit(1000).alias("place"), F.lit(0).alias("n"), entry(F.lit(name), "severity_id", "enum", enum=enumeration(c("v"), CEF_SEVERITY), default="99").alias("e"))
    text = kept.select("source_id").distinct().select("source_id", F.lit(1001).alias("place"), F.lit(0).alias("n"), entry(F.lit("cef.name" if kind == "cef" else "leef.event_id"), "message", "string").alias("e"))
    rows = each.unionByName(text)
    rows = rows.unionByName(banded) if kind == "cef" else rows
    maker = ("vendor", "product")
    made = found.filter(c("key").isin([f"{kind}.{k}" for k in maker])).groupBy("source_id").agg(*[F.min_by(F.when(c("key") == f"{kind}.{k}", c("value")), F.when(c("key") == f"{kind}.{k}", c("record_id"))).alias(k) for k in maker])
    escaped = lambda k: F.regexp_replace(k, r"([.^$*+?()\[\]{}|\\])", r"\\$1")
    signature = F.concat(F.lit(r"CEF:\d+\|" if kind == "cef" else r"LEEF:\d\.\d\|"), escaped(maker[0]), F.lit(r"\|"), escaped(maker[1]), F.lit(r"\|"))
    out = counts(lines).join(gathered(rows), "source_id").join(made, "source_id").join(unfit, "source_id", "left")
    return out.select("source_id", "lines", signature.alias("signature"), "map", F.coalesce("unfit", F.array().cast("array<string>")).alias("unfit"))


# Forms of times within free text.
TIMES = r"[A-Z][a-z]{2} +\d+ \d{4} \d\d:\d\d:\d\d|[A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d|\d{4}/\d\d/\d\d \d\d:\d\d:\d\d|\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?"
TOKEN = rf"{TIMES}|\s+|[^\s\w.]|[\w.]+"


def template_slots(lines: DataFrame, least: int = CLUSTER) -> DataFrame:
    """(source_id, template, lines, position, kind, literal, type, path) of free text: lines with the same skeleton (words, times, blanks, and each other
    sign as it is) are one template; a position where words or times vary is a slot with a type, any other a literal. Templates of under ``least`` lines
    are left out. A word is compared where it stands, so lines are cut into (template, position, value) and counted before anything is gathered."""
    tokens = F.regexp_extract_all("raw", F.lit(TOKEN), F.lit(0))
    kind = lambda t: F.when(t.rlike(f"^({TIMES})$"), "t").when(t.rlike(r"^\s"), " ").when(t.rlike(r"^[\w.]"), "w").otherwise(t)
    cut = lines.select("source_id", "record_id", tokens.alias("tokens")).withColumn("template", F.array_join(F.transform("tokens", kind), ""))
    sized = cut.groupBy("source_id", "template").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") >= least)
    words = cut.select("source_id", "template", F.posexplode("tokens").alias("position", "value"))
    seen = words.groupBy("source_id", "template", "position", "value").agg(F.count(F.lit(1)).alias("n")).join(sized.select("source_id", "template"), ["source_id", "template"], "left_semi")
    spots = seen.groupBy("source_id", "template", "position").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("literal")).withColumn("kind", kind(F.col("literal")))
    slots = spots.filter("values > 1 and kind in ('w', 't')").select("source_id", "template", "position")
    group = F.struct("source_id", "template").alias("source_id")
    long = seen.join(slots, ["source_id", "template", "position"], "left_semi").select(group, F.concat(F.lit("slot_"), F.col("position").cast("string")).alias("field"), "value", "n")
    typed = columns.typed(long, names=False).select("source_id.source_id", "source_id.template", F.col("place").alias("position"), "type", "path")
    out = spots.join(sized, ["source_id", "template"]).join(typed, ["source_id", "template", "position"], "left")
    slot = F.col("type").isNotNull()
    return out.select("source_id", "template", "lines", "position", F.when(slot, "slot").otherwise("literal").alias("kind"), F.when(~slot, F.col("literal")).alias("literal"), "type", "path")


def anonymous_columns(long: DataFrame, used: list[str], most: int = 5) -> DataFrame:
    """(source_id, field, samples): columns that nothing maps or names and that hold a value; the ``most`` least values of each."""
    rest = columns.counted(long).filter(~F.col("field").isin(used) if used else F.lit(True))
    first = rest.withColumn("r", F.row_number().over(Window.partitionBy("source_id", "field").orderBy("value"))).filter(F.col("r") <= most)
    return first.groupBy("source_id", "field").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def vectors(parsed: DataFrame, n: int = 5) -> DataFrame:
    """(source_id, extractor, record_id, raw, expect): the first ``n`` lines of each extractor that parse, with the values they map to, as JSON."""
    hit = parsed.filter("event is not null").select("source_id", F.col("event.extractor").alias("extractor"), "record_id", "raw", F.col("event.ocsf").alias("ocsf"))
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("source_id", "extractor").orderBy("record_id"))).filter(F.col("r") <= n)
    return ranked.select("source_id", "extractor", "record_id", "raw", F.to_json("ocsf").alias("expect"))


def replay_vectors(vectors_: DataFrame, parse) -> DataFrame:
    """(source_id, extractor, record_id, same): whether a line still maps to what it did."""
    again = parse(vectors_.drop("extractor")).select("source_id", "record_id", F.to_json("event.ocsf").alias("now"))
    return vectors_.join(again, ["source_id", "record_id"], "left").select("source_id", "extractor", "record_id", F.coalesce(F.col("expect") == F.col("now"), F.lit(False)).alias("same"))
