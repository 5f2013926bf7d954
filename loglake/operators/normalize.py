"""Parser specs compiled to columns: raw lines to typed events, and the rest to quarantine.

A spec is a dict: ``id, version, vendor, product, signature, defaults`` (target path -> constant), ``identity`` (a rule of ``identity.facts_of``; ``at`` names
a key that is mapped as a time) and ``extractors``, each ``id, kind, options`` (of ``extract.EXTRACTORS``), ``class_uid, activity_id, render``, ``when`` (see
``routed``) and ``map``: target path -> {``from``: key or keys | ``const``, ``type``, ``optional``, ``values``, ``default``, ``unit``, ``layout``, ``zone``}. ``specs.compiled``
makes one of a parser document. For each extractor a candidate struct is built, null where it does not match; the first candidate in order of spec id and
place wins. Targets of the closed list ``PATHS`` are typed columns of ``event.ocsf``, all others are kept as text in the map ``event.more``.
``render`` (``auto`` for key=value pairs, or a template with ``{field}``) says how the line is written from its fields; an event whose rendering isn't the
line is kept, flagged. A line that meets an extractor with options that can't be followed is not parsed at all (stage ``extract``).
"""

from __future__ import annotations

import functools
import json
import re
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions import values as V
from loglake.operators import identity
from loglake.operators.extract import EXTRACTORS, java

#: Extractors whose columns are kept for the next batch.
KEPT = 1000
#: Bytes of a value that is flagged as too large.
OVERSIZE = 64 * 1024
FACT = "struct<kind:string,action:string,ip:string,mac:string,host:string,user:string,at:timestamp>"
#: The closed list of target paths that have a column of their own, and their types.
PATHS = {
    "class_uid": "bigint", "activity_id": "bigint", "type_uid": "bigint", "time": "bigint", "severity_id": "bigint", "message": "string", "duration": "bigint",
    "src_endpoint.ip": "string", "src_endpoint.port": "int", "src_endpoint.mac": "string", "src_endpoint.hostname": "string",
    "dst_endpoint.ip": "string", "dst_endpoint.port": "int", "connection_info.protocol_name": "string",
    "traffic.bytes_in": "decimal(20,0)", "traffic.bytes_out": "decimal(20,0)", "actor.user.name": "string", "metric.value": "double", "disposition.blocked": "boolean",
}


def convert(x: Column, how: dict, received: Column) -> Column:
    kind = how.get("type", "string")
    if kind == "string":
        return F.lower(x) if how.get("lower") else x
    if kind == "enum":
        return V.to_enum(x, how["values"], how.get("default"))
    if kind == "duration":
        return V.to_duration_ms(x, how.get("unit", "s"))
    if kind == "time":
        return V.to_time_ms(x, how["layout"], how.get("zone"), received)
    return {"int": V.to_int, "uint": V.to_uint, "bytes": V.to_uint, "float": V.to_float, "ip": V.to_ip, "port": V.to_port, "mac": V.to_mac, "bool": V.to_bool}[kind](x)


def extraction(spec: dict, extractor: dict, raw: Column) -> Column:
    """The fields an extractor finds, where the spec's signature stands in the first 512 characters."""
    found = EXTRACTORS[extractor["kind"]](raw, **extractor.get("options", {}))
    if not spec.get("signature"):
        return found
    return F.when(F.substring(raw, 1, 512).rlike(java(spec["signature"])), found)


def routed(extractor: dict, fields: Column) -> Column:
    """Whether the extractor's ``when`` holds: ``column`` (a number, from 0) or ``path`` with ``equals`` or ``in``, or keys with the values that each may have. An
    empty list holds for any value; a column that the line lacks never does, a path that it lacks is the empty text."""
    when = dict(extractor.get("when") or {})
    checks = []
    if "column" in when or "path" in when:
        wanted = [when["equals"]] if when.get("equals") is not None else list(when.get("in") or [])
        key = when.get("path")
        if "column" in when:
            names = extractor.get("options", {}).get("names", [])
            n = when["column"]
            key = names[n] if 0 <= n < len(names) and names[n] not in ("", "_") else f"col_{n}"
        value = F.try_element_at(fields, F.lit(key))
        checks.append((value if "column" in when else F.coalesce(value, F.lit("")), wanted))
    else:
        checks = [(F.try_element_at(fields, F.lit(k)), list(v)) for k, v in when.items()]
    out = F.lit(True)
    for value, wanted in checks:
        out = out & (F.coalesce(value.isin([text_of(w) for w in wanted]), F.lit(False)) if wanted else value.isNotNull())
    return out


def without(fields: Column, keys: list[str]) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.isin(keys))


def text_of(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def unsupported(extractor: dict) -> str | None:
    """Why an extractor can't be followed, if so: a record that reaches it fails."""
    quote = extractor.get("options", {}).get("quote", '"')
    return f'csv quote "{quote}" is unsupported' if extractor["kind"] == "csv" and quote != '"' else None


def rendered(extractor: dict, fields: Column, typed: dict[str, Column]) -> Column:
    """The line as the extractor's ``render`` writes it: pairs in their order, or a template's literals and values (typed ones as they were converted)."""
    how, options = extractor["render"], extractor.get("options", {})
    if how == "auto":
        pair, sep, quote = options.get("pair_sep", " "), options.get("kv_sep", "="), options.get("quote", '"')
        value = lambda v: F.when(v.contains(pair), F.concat(F.lit(quote), v, F.lit(quote))).otherwise(v)
        return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(sep), value(e["value"]))), pair)
    out = []
    for text, name in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{([^{}]*)\}", how):
        if text:
            out.append(F.lit(text.replace("{{", "{").replace("}}", "}")))
        else:
            raw = F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit(""))
            out.append(F.coalesce(typed[name].cast("string"), raw) if name in typed else raw)
    return F.concat(*out) if out else F.lit("")


class Candidate:
    """The event that an extractor's fields make, in steps of their own columns, so that each is computed once: what was found, the parts that the map
    reads, the converted values, the event (null, unless every key that isn't optional is there and every conversion but that of times succeeds)."""

    def __init__(self, name: str, spec: dict, extractor: dict, raw: Column, received: Column) -> None:
        self.name, self.spec, self.extractor, self.raw, self.received = name, spec, extractor, raw, received
        self.sources = {p: [how["from"]] if isinstance(how["from"], str) else how["from"] for p, how in extractor["map"].items() if "const" not in how}
        self.keys = list(dict.fromkeys(k for keys in self.sources.values() for k in keys))

    def found(self) -> dict[str, Column]:
        if unsupported(self.extractor):
            return {f"{self.name}_f": F.coalesce(F.substring(self.raw, 1, 512).rlike(java(self.spec["signature"])) if self.spec.get("signature") else self.raw.isNotNull(), F.lit(False))}
        return {f"{self.name}_f": extraction(self.spec, self.extractor, self.raw)}

    def part(self, key: str) -> str:
        return f"{self.name}_p{self.keys.index(key)}"

    def parts(self) -> dict[str, Column]:
        if unsupported(self.extractor):
            return {}
        return {self.part(k): F.try_element_at(F.col(f"{self.name}_f.fields"), F.lit(k)) for k in self.keys}

    def values(self) -> dict[str, Column]:
        out = {}
        if unsupported(self.extractor):
            return out
        for n, (path, keys) in enumerate(self.sources.items()):
            parts = [F.nullif(F.col(self.part(k)), F.lit("")) for k in keys]
            joined = parts[0] if len(parts) == 1 else F.concat(*[x for p in parts for x in (p, F.lit(" "))][:-1])
            out[f"{self.name}_v{n}"] = convert(joined, self.extractor["map"][path], self.received)
        alone = [keys[0] for keys in self.sources.values() if len(keys) == 1]
        fields = F.col(f"{self.name}_f.fields")
        left = lambda k, v: (v != "") & ~k.isin(alone) if alone else v != ""
        # where all fields are keys that are read alone, nothing is left
        read = sum((F.col(self.part(k)).isNotNull().cast("int") for k in dict.fromkeys(alone)), F.lit(0))
        unmapped = F.when(F.size(fields) == read, F.create_map().cast("map<string,string>")).otherwise(F.map_filter(fields, left))
        for keys in self.sources.values():  # keys that are read together are used only where all of them are there
            if len(keys) > 1:
                there = functools.reduce(lambda a, b: a & b, [F.col(self.part(k)).isNotNull() for k in keys])
                unmapped = F.when(there, without(unmapped, keys)).otherwise(unmapped)
        out[f"{self.name}_u"] = unmapped
        return out

    def event(self) -> dict[str, Column]:
        found, x = F.col(f"{self.name}_f"), self.extractor
        if unsupported(x):
            return {}
        fields = found["fields"]
        ok = found.isNotNull() & routed(x, fields)
        legacy = {"class_uid": x.get("class_uid", 4001), "activity_id": x.get("activity_id", 1)}
        targets: dict[str, Column] = {p: F.lit(v) for p, v in self.spec.get("defaults", legacy).items()}
        targets |= {p: F.lit(how["const"]) for p, how in x["map"].items() if "const" in how}
        # no value is longer than its line
        flags = [F.when((F.octet_length(self.raw) > OVERSIZE) & F.exists(F.map_values(fields), lambda v: F.octet_length(v) > OVERSIZE), "oversize_field")]
        typed: dict[str, Column] = {}
        mapped_bytes = F.lit(0)
        mapped_fields = F.lit(sum("const" in how for how in x["map"].values()))
        used: dict[str, Column] = {}
        for n, (path, keys) in enumerate(self.sources.items()):
            how, value = x["map"][path], F.col(f"{self.name}_v{n}")
            parts = [F.col(self.part(k)) for k in keys]
            there, empty = F.lit(True), F.lit(False)
            for p in parts:
                there = there & p.isNotNull()
                empty = empty | (F.coalesce(p, F.lit("")) == "")
            if not how.get("optional"):
                ok = ok & there
            if how.get("type") == "time":
                flags.append(F.when(~empty & value.isNull(), "time_unparseable"))
            elif how.get("type", "string") != "string":
                ok = ok & (empty | value.isNotNull())
            targets[path] = F.coalesce(value, targets[path].cast(PATHS.get(path, "string"))) if path in targets else value
            typed[keys[0]] = F.coalesce(value.cast("string"), typed[keys[0]]) if keys[0] in typed else value.cast("string")
            for k in keys:
                used[k] = used.get(k, F.lit(False)) | there
            mapped_bytes = mapped_bytes + F.when(~empty, sum((F.octet_length(p) for p in parts), F.lit(0))).otherwise(0)
            mapped_fields = mapped_fields + (~empty & value.isNotNull()).cast("int")
        render_ok = F.lit(None).cast("boolean")
        if x.get("render"):
            render_ok = F.coalesce(rendered(x, fields, typed) == self.raw, F.lit(False))
            flags.append(F.when(~render_ok, "render_back_mismatch"))
        if "class_uid" in targets and "activity_id" in targets:
            targets["type_uid"] = targets["class_uid"].try_cast("bigint") * 100 + targets["activity_id"].try_cast("bigint")
        unmapped = F.col(f"{self.name}_u")
        n_used = sum((x.cast("int") for x in used.values()), F.lit(0))
        rest = F.octet_length(F.array_join(F.map_values(unmapped), ""))
        uncovered = F.greatest(F.lit(0), F.octet_length(self.raw) - found["accounted"])
        ocsf = F.struct(*[targets.get(p, F.lit(None)).cast(t).alias(p.replace(".", "_")) for p, t in PATHS.items()])
        others = [F.struct(F.lit(p).alias("k"), t.cast("string").alias("v")) for p, t in targets.items() if p not in PATHS]
        more = F.map_from_entries(F.filter(F.array(*others).cast("array<struct<k:string,v:string>>"), lambda e: e["v"].isNotNull()))
        coverage = F.struct(
            F.lit(x["kind"] in ("regex", "kv")).alias("applicable"), mapped_bytes.alias("mapped_bytes"), rest.alias("unmapped_bytes"),
            F.greatest(F.lit(0), F.octet_length(self.raw) - mapped_bytes - rest - uncovered).alias("constant_bytes"), uncovered.alias("uncovered_bytes"),
            mapped_fields.alias("mapped_fields"), (F.size(fields) - n_used).alias("unmapped_fields"), F.size(fields).alias("fields"),
        )
        fact = F.lit(None).cast(FACT)
        if rule := self.spec.get("identity"):
            at = typed.get(rule.get("at"))
            fact = identity.facts_of(fields, rule, self.received, None if at is None else at.try_cast("bigint")).cast(FACT)
        event = F.struct(
            ocsf.alias("ocsf"),
            more.alias("more"),
            fact.alias("identity"),
            unmapped.alias("unmapped"),
            F.transform(found["dupes"], lambda d: F.concat(d["k"], F.lit("="), d["v"])).alias("dupes"),
            F.array_distinct(F.concat(found["flags"], F.array_compact(F.array(*flags)))).alias("flags"),
            coverage.alias("coverage"),
            render_ok.alias("render_ok"),
            F.lit(self.spec["id"]).alias("parser_id"),
            F.lit(self.spec["version"]).alias("parser_version"),
            F.lit(x["id"]).alias("extractor"),
            F.lit(self.spec.get("vendor")).cast("string").alias("vendor"),
            F.lit(self.spec.get("product")).cast("string").alias("product"),
        )
        return {f"{self.name}_e": F.when(ok, event)}


_built: dict[tuple, tuple[Candidate, list[dict[str, Column]]]] = {}


def candidate(name: str, spec: dict, extractor: dict, raw: str, received: str) -> tuple[Candidate, list[dict[str, Column]]]:
    """A candidate and the columns of its four steps. They belong to no table, so that a spec is made into columns once, however many batches it reads."""
    key = (id(SparkContext._gateway), name, raw, received, json.dumps([spec, extractor], default=str))
    if key not in _built:
        if len(_built) >= KEPT:
            _built.clear()
        x = Candidate(name, spec, extractor, F.col(raw), F.col(received))
        _built[key] = x, [step(x) for step in (Candidate.found, Candidate.parts, Candidate.values, Candidate.event)]
    return _built[key]


def normalize(lines: DataFrame, specs: list[dict], raw: str = "raw", received: str = "received_at") -> DataFrame:
    """``lines`` with ``event`` (a struct, null where no spec matches) and the columns derived from it: event_time, time_from_receipt, parse_confidence
    (0.8 where the time can't be read, the confidence is flagged or the rendering differs), and extract_error. Null lines match nothing."""
    order = [(s, x) for s in sorted(specs, key=lambda s: s["id"]) for x in s["extractors"]]
    built = [candidate(f"_c{k}", s, x, raw, received) for k, (s, x) in enumerate(order)]
    every = [x for x, _ in built]
    out, own = lines, []
    for step in range(4):
        columns = {name: c for _, steps in built for name, c in steps[step].items()}
        out = out.withColumns(columns)
        own += columns
    broken = [x for x in every if unsupported(x.extractor)]
    event = F.coalesce(*[F.col(f"{x.name}_e") for x in every if x not in broken], F.lit(None))
    if broken:  # the first candidate that matches or can't be followed decides
        reached = lambda x: F.when(F.col(f"{x.name}_f"), F.lit(unsupported(x.extractor))) if x in broken else F.when(F.col(f"{x.name}_e").isNotNull(), F.lit(""))
        out = out.withColumn("extract_error", F.nullif(F.coalesce(*[reached(x) for x in every]), F.lit("")))
        event = F.when(F.col("extract_error").isNull(), event)
    else:
        out = out.withColumn("extract_error", F.lit(None).cast("string"))
    out = out.withColumn("event", event).drop(*own)
    # counting the rows here keeps filters and the fields they need above the extraction: pushed below it, they would repeat it for each field that an
    # event must have, and before a small table is dealt out
    out = out.observe(f"parsed-{uuid.uuid4().hex}", F.count(F.lit(1)))
    time = F.nullif(F.col("event.ocsf.time"), F.lit(0))
    return out.withColumns(
        {
            "event_time": F.coalesce(F.timestamp_millis(time), F.col(received)),
            "time_from_receipt": time.isNull(),
            "parse_confidence": F.when(~F.coalesce("event.render_ok", F.lit(True)) | F.coalesce(F.arrays_overlap("event.flags", F.array(F.lit("time_unparseable"), F.lit("low_confidence"))), F.lit(False)), 0.8).otherwise(1.0),
        }
    )


def staged(parsed: DataFrame) -> DataFrame:
    """``parsed`` with failure_stage and error, both null for events: ``detect`` where no parser matched, ``extract`` where an extractor failed,
    ``normalize`` where a later step left its reason in a column ``enrich_error``."""
    late = F.col("enrich_error") if "enrich_error" in parsed.columns else F.lit(None).cast("string")
    missed = F.col("event").isNull()
    stage = F.when(F.col("extract_error").isNotNull(), "extract").when(missed, "detect").when(late.isNotNull(), "normalize")
    error = F.when(F.col("extract_error").isNotNull(), F.col("extract_error")).when(missed, "no parser matched").otherwise(late)
    return parsed.withColumns({"failure_stage": stage, "error": error})


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and quarantine rows with stage and reason (``staged``)."""
    fine = F.col("event").isNotNull() & F.col("enrich_error").isNull() if "enrich_error" in parsed.columns else F.col("event").isNotNull()
    rest = staged(parsed.filter(~fine)).withColumn("status", F.lit("open"))
    return parsed.filter(fine).drop("extract_error", "enrich_error"), rest.drop("event", "event_time", "time_from_receipt", "parse_confidence", "extract_error", "enrich_error")


def siem(event: Column) -> list[Column]:
    """Common fields of exports: the first path that is present; missing numbers are 0, missing texts empty."""
    o = event["ocsf"]
    text = lambda *c: F.coalesce(*c, F.lit(""))
    number = lambda c, t: F.coalesce(c.cast(t), F.lit(0).cast(t))
    return [
        text(o["actor_user_name"], F.try_element_at(event["unmapped"], F.lit("user"))).alias("user_name"),
        text(o["src_endpoint_ip"], F.try_element_at(event["unmapped"], F.lit("src_ip"))).alias("src_ip"),
        number(o["src_endpoint_port"], "int").alias("src_port"),
        number(o["dst_endpoint_port"], "int").alias("dst_port"),
        text(F.try_element_at(event["unmapped"], F.lit("proto")), o["connection_info_protocol_name"]).alias("protocol"),
        number(o["severity_id"], "bigint").alias("severity"),
    ]
