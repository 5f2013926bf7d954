"""Parser documents (as they are written in YAML or JSON) to the specs that ``normalize`` follows, with the checks that a document must pass."""

from __future__ import annotations

import re

from loglake.operators.framing import FORBIDDEN

# Parts of time layouts, as documents write them and as Spark does; longer ones first.
LAYOUT_PARTS = [
    ("January", "MMMM"), ("Monday", "EEEE"), ("2006", "yyyy"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("-0700", "xx"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"),
    (".000000000", ".SSSSSSSSS"), (".000000", ".SSSSSS"), (".000", ".SSS"), ("01", "MM"), ("02", "dd"), ("_2", "d"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"),
]
NAMED_LAYOUTS = ("rfc3339", "epoch_s", "epoch_ms", "epoch_ns")
KINDS = {"regex": {"pattern": "pattern"}, "kv": {"skip": "skip", "pair_sep": "pair_sep", "kv_sep": "kv_sep", "quote": "quote"}, "csv": {"columns": "names", "sep": "sep", "quote": "quote", "min_columns": "min_columns"}, "json": {}, "cef": {}, "leef": {}}


class SpecError(ValueError):
    """What is wrong with a document, with parser, extractor and entry."""


def layout(written: str) -> str:
    """A time layout as Spark's pattern; letters that mean nothing are quoted."""
    if written in NAMED_LAYOUTS:
        return written
    out, at = "", 0
    while at < len(written):
        part = next(((a, b) for a, b in LAYOUT_PARTS if written.startswith(a, at)), None)
        if part:
            out += part[1]
            at += len(part[0])
        else:
            c = written[at]
            out += f"'{c}'" if c.isalpha() else c
            at += 1
    return out


def compiled(document: dict) -> dict:
    """The spec of a document: ``id, version, vendor, product, timezone, match.signature, ocsf_defaults, extractors, identity``."""
    name = f'parser "{document.get("id", "")}"'
    signature = (document.get("match") or {}).get("signature")
    if not document.get("id") or not signature:
        raise SpecError(f"{name}: id and match.signature are required")
    checked(signature, f"{name} signature")
    seen: set[str] = set()
    out = []
    for x in document.get("extractors") or []:
        where = f'{name} extractor "{x.get("id", "")}"'
        if x.get("id") in seen:
            raise SpecError(f"{where}: the id is taken")
        seen.add(x.get("id"))
        out.append(extractor(x, document.get("timezone"), where))
    if not out:
        raise SpecError(f"{name}: no extractors")
    spec = {"id": document["id"], "version": document.get("version", "1.0.0"), "vendor": document.get("vendor"), "product": document.get("product"), "signature": signature, "extractors": out}
    spec["defaults"] = flat(document.get("ocsf_defaults") or {})
    if rule := document.get("identity"):
        spec["identity"] = rule
    return spec


def checked(pattern: str, where: str) -> re.Pattern:
    for kind, rule in FORBIDDEN.items():
        if kind != "group_name" and re.search(rule, pattern):
            raise SpecError(f"{where}: {kind} is not supported")
    try:
        return re.compile(pattern)
    except re.error as why:
        raise SpecError(f"{where}: {why}") from None


def flat(values: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in values.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def extractor(x: dict, zone: str | None, where: str) -> dict:
    kind = x.get("kind")
    if kind not in KINDS:
        raise SpecError(f"{where}: unknown kind {kind}")
    groups = None
    if kind == "regex":
        groups = checked(x.get("pattern", ""), f"{where} pattern").groupindex
    options = {ours: x[theirs] for theirs, ours in KINDS[kind].items() if x.get(theirs) is not None}
    if kind == "csv":
        options.setdefault("names", [])
    entries = {}
    for n, entry in enumerate(x.get("map") or []):
        if "const" in entry:
            entries[entry["to"]] = {"const": entry["const"]}
            continue
        keys = [entry["from"]] if isinstance(entry["from"], str) else list(entry["from"])
        for key in keys:
            if groups is not None and key not in groups:
                raise SpecError(f"{where} map[{n}] (from: {key}): the pattern has no such group")
        how = {"from": keys if len(keys) > 1 else keys[0]} | {k: entry[k] for k in ("type", "optional", "default", "unit", "lower") if k in entry}
        if entry.get("type") == "enum":
            how["values"] = {str(k): v for k, v in (entry.get("enum") or {}).items()}
        if entry.get("type") == "time":
            how["layout"] = layout(entry.get("layout", "rfc3339"))
            if zone and how["layout"] not in NAMED_LAYOUTS:
                how["zone"] = zone
        entries[entry["to"]] = how
    return {"id": x.get("id"), "kind": kind, "options": options, "map": entries} | {k: x[k] for k in ("when", "render") if x.get(k) is not None}
