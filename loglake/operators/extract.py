"""Extractors: a raw text column to a map of fields. Each gives a struct ``fields, dupes, flags, accounted``, null where it does not match.

The first of several pairs with a key wins, later ones go to ``dupes`` with the flag ``duplicate_key``. ``accounted`` are the bytes of the line that the
extractor has looked at: what a pattern spans, the whole line for the other kinds. Null lines match nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = "array<struct<k:string,v:string>>"
#: Stands between the groups of a pattern while these are one text.
BETWEEN = "\u0001\u001e\u0001"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def from_pairs(ok: Column, pairs: Column, accounted: Column, flags: Column | None = None) -> Column:
    """``flags``: an array of flags of the extractor's own."""

    def build(pairs: Column, keys: Column) -> Column:
        first = F.transform(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1), lambda p: F.struct(p["k"], p["v"]))
        later = F.transform(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) != i + 1), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
        again = F.array_compact(F.array(F.when(F.size(keys) > F.size(F.array_distinct(keys)), "duplicate_key")))
        return F.struct(F.map_from_entries(first).alias("fields"), later.alias("dupes"), (again if flags is None else F.concat(flags, again)).alias("flags"), accounted.alias("accounted"))

    return F.when(ok, let(pairs, lambda p: let(F.transform(p, lambda x: x["k"]), lambda keys: build(p, keys))))


def from_distinct(pairs: Column, accounted: Column) -> Column:
    """The struct of pairs whose keys are known to differ."""
    none = F.array().cast("array<string>")
    return F.struct(F.map_from_entries(pairs).alias("fields"), F.array().cast(PAIRS).alias("dupes"), none.alias("flags"), accounted.alias("accounted"))


def kv(raw: Column, skip: str = "", pair_sep: str = " ", kv_sep: str = "=", quote: str = '"') -> Column:
    """Pairs in sequence: a key is all up to the next key separator (blanks too), a value runs to the next pair separator, or from quote to quote. A quoted
    value is not looked into; one without its closing quote runs to the end and is flagged. A line without any pair is a match without fields."""
    body = F.regexp_replace(raw, rf"\A(?:{skip})", "") if skip else raw
    p, s, q = re.escape(pair_sep), re.escape(kv_sep), re.escape(quote)
    single = len({pair_sep, kv_sep, quote}) == 3 and all(len(x) == 1 for x in (pair_sep, kv_sep, quote))
    if single:  # classes of signs that never step back; the second group is the value as it stands, the third what is in its quotes
        pattern = rf"\G{p}*+([^{s}]*+){s}({q}?+((?<={s}{q})[^{q}]*+|(?<!{s}{q})[^{p}]*+){q}?+)"
    else:
        pattern = rf"(?s)\G(?:{p})*+(.*?){s}({q}.*?(?:{q}|\z)|.*?(?={p}|\z))"
    groups = [F.regexp_extract_all(body, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)[: 3 if single else 2]]
    closed = lambda v: F.endswith(v, F.lit(quote)) & (F.length(v) > 1)
    inside = lambda v: F.when(~v.startswith(quote), v).otherwise(F.substring(v, F.lit(2), F.length(v) - F.when(closed(v), 2).otherwise(1)))

    def build(k: Column, v: Column, bare: Column) -> Column:
        pairs = F.arrays_zip(k.alias("k"), bare.alias("v"))
        once = F.size(F.array_distinct(k)) == F.size(k)
        first = F.filter(pairs, lambda p, i: F.array_position(k, p["k"]) == i + 1)
        later = F.when(once, F.array().cast(PAIRS)).otherwise(F.filter(pairs, lambda p, i: F.array_position(k, p["k"]) != i + 1))
        last = F.try_element_at(v, F.lit(-1))  # a quote that isn't closed runs to the end
        open_ = F.when(last.startswith(quote) & ~closed(last), "key_injection_suspect")
        fields = F.when(once, F.map_from_arrays(k, bare)).otherwise(F.map_from_entries(first))
        return F.struct(fields.alias("fields"), later.alias("dupes"), F.array_compact(F.array(open_, F.when(~once, "duplicate_key"))).alias("flags"), F.octet_length(raw).alias("accounted"))

    bare = (lambda v: groups[2]) if single else (lambda v: F.transform(v, inside))
    return F.when(raw.isNotNull(), let(groups[0], lambda k: let(groups[1], lambda v: let(bare(v), lambda b: build(k, v, b)))))


def java(pattern: str) -> str:
    """A pattern with Python's named groups as Java writes it (names without underscores)."""
    return re.sub(r"\(\?<([A-Za-z][A-Za-z0-9_]*)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern.replace("(?P<", "(?<"))


def regex(raw: Column, pattern: str) -> Column:
    """Named groups; a group that took no part is absent, one that matched the empty text has it as its value."""
    spelt = java(pattern)
    index = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern.replace("(?P<", "(?<"))).groupindex
    if not index:
        return from_pairs(raw.rlike(spelt) & F.is_valid_utf8(raw), F.array().cast(PAIRS), F.octet_length(F.regexp_extract(raw, spelt, 0)))
    # one search gives all groups: the line is rewritten to what they hold
    groups = F.split(F.regexp_replace(raw, rf"(?s)\A.*?(?:{spelt})(?s:.*)\z", BETWEEN.join(f"${i}" for i in index.values())), BETWEEN, -1)

    def pairs(groups: Column) -> Column:
        # a reference to a group fails where the group took no part, and holds for nothing
        value = lambda n, i: F.when((F.get(groups, n) != "") | raw.rlike(f"(?:{spelt})\\{i}"), F.get(groups, n))
        return F.filter(F.array(*[F.struct(F.lit(k).alias("k"), value(n, i).alias("v")) for n, (k, i) in enumerate(index.items())]), lambda p: p["v"].isNotNull())

    return F.when(raw.rlike(spelt) & F.is_valid_utf8(raw), from_distinct(let(groups, pairs), F.octet_length(F.regexp_extract(raw, spelt, 0))))


def csv_cells(raw: Column, sep: str = ",") -> Column:
    """The cells of the first record (quoted ones may hold separators, line ends and doubled quotes); null where a quote stands elsewhere or isn't closed,
    and for lines without a record."""
    s = re.escape(sep)
    cell = rf'(?:"(?:[^"]|"")*"|(?:[^{s}"\r\n]|\r(?!\n|\z))*+)'
    record = F.regexp_extract(raw, rf"\A(?:\r?\n)*+({cell}(?:{s}{cell})*+)(?:\r?\n|\r?\z)", 1)
    whole = raw.rlike(rf"\A(?:\r?\n)*+(?!\r?\n|\r?\z)({cell}(?:{s}{cell})*+)(?:\r?\n|\r?\z)")
    cells = F.transform(
        F.regexp_extract_all(F.concat(record, F.lit(sep)), F.lit(rf'("(?:[^"]|"")*"|[^{s}]*){s}'), F.lit(1)),
        lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"'), "\r\n", "\n")).otherwise(x),
    )
    return F.when(whole, cells)


def csv(raw: Column, names: list[str], sep: str = ",", min_columns: int = 0, quote: str = '"') -> Column:
    """One record; columns without a name, or named ``_``, are ``col_N``, counted from 0. ``normalize`` refuses another ``quote``."""

    def build(cells: Column) -> Column:
        known = F.array(*[F.lit(None if n in ("", "_") else n).cast("string") for n in names]) if names else F.array().cast("array<string>")
        pairs = F.transform(cells, lambda v, i: F.struct(F.coalesce(F.try_element_at(known, i + 1), F.concat(F.lit("col_"), i.cast("string"))).alias("k"), v.alias("v")))
        return from_pairs(F.size(cells) >= min_columns, pairs, F.octet_length(raw))

    return let(csv_cells(raw, sep), lambda cells: F.when(cells.isNotNull(), build(cells)))


def csv_columns(raw: Column, sep: str = ",") -> Column:
    return F.size(csv_cells(raw, sep))


#: Levels of a document that are read, and values of it that are kept.
DEEPEST, MOST = 32, 512
NODES = "array<struct<path:string,node:variant>>"


def json_leaves(raw: Column) -> Column:
    """(leaves, deep) of a document, null where it is none: leaves (path, value, quoted) with objects by name and arrays by index; null has no value, numbers
    stand as they are written; deep: whether something lies below ``DEEPEST``. A node opens level by level, all in one expression, so rows never move."""
    # numbers become texts behind a mark, so that they are not read and written again
    marked = F.regexp_replace(raw, r'("(?:[^"\\]|\\.)*+")|(-?[0-9][0-9.eE+-]*)', "$1\u0001$2\u0002")
    texts = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, "\u0001\u0002", ""), "\u0001", '"\\\\u0001'), "\u0002", '"')
    root = F.when(F.try_parse_json(raw).isNotNull(), F.try_parse_json(texts))
    kind = lambda n: F.substring(F.schema_of_variant(n), 1, 5)
    nested = lambda n: kind(n).isin("OBJEC", "ARRAY")
    under = lambda path, step: F.when(path == "", step).otherwise(F.concat(path, F.lit("."), step))

    def opened(x: Column) -> Column:
        named = F.transform(F.map_entries(F.try_variant_get(x["node"], "$", "map<string,variant>")), lambda e: F.struct(under(x["path"], e["key"]).alias("path"), e["value"].alias("node")))
        listed = F.transform(F.try_variant_get(x["node"], "$", "array<variant>"), lambda v, i: F.struct(under(x["path"], i.cast("string")).alias("path"), v.alias("node")))
        return F.when(kind(x["node"]) == "OBJEC", named).when(kind(x["node"]) == "ARRAY", listed).otherwise(F.array(F.struct(x["path"].alias("path"), x["node"].alias("node"))))

    def level(nodes: Column, _: Column) -> Column:
        return F.when(F.exists(nodes, lambda x: nested(x["node"])), F.flatten(F.transform(nodes, opened)).cast(NODES)).otherwise(nodes)

    def leaf(x: Column) -> Column:
        text = F.try_variant_get(x["node"], "$", "string")
        number = text.startswith("\u0001") & (kind(x["node"]) == "STRIN")
        return F.struct(x["path"].alias("path"), F.when(number, F.substring(text, F.lit(2), F.length(text))).otherwise(text).alias("value"), ((kind(x["node"]) == "STRIN") & ~number).alias("quoted"))

    def read(node: Column) -> Column:
        start = F.array(F.struct(F.lit("").alias("path"), node.alias("node"))).cast(NODES)
        every = F.aggregate(F.sequence(F.lit(1), F.lit(DEEPEST)), start, level)
        plain = lambda nodes: F.transform(F.filter(nodes, lambda x: ~nested(x["node"])), leaf)
        empty = lambda x: F.coalesce(F.size(F.map_keys(F.try_variant_get(x["node"], "$", "map<string,variant>"))), F.size(F.try_variant_get(x["node"], "$", "array<variant>"))) == 0
        return let(every, lambda nodes: F.struct(plain(nodes).alias("leaves"), F.exists(nodes, lambda x: nested(x["node"]) & ~F.coalesce(empty(x), F.lit(False))).alias("deep")))

    return let(root, lambda node: F.when(node.isNotNull(), read(node)))


def json(raw: Column, paths: list[str] | None = None) -> Column:
    """Every leaf under its dotted path (``user.tags.0``), null as the empty text. Of more than ``MOST`` values the rest is left out, flagged; so is what lies
    too deep. Documents with a key twice in an object, or with text behind them, are none. ``paths`` needn't be given: all are read."""

    def build(x: Column) -> Column:
        values = F.filter(x["leaves"], lambda e: e["value"].isNotNull())
        kept = F.concat(F.filter(x["leaves"], lambda e: e["value"].isNull()), F.slice(values, 1, MOST))
        pairs = F.transform(kept, lambda e: F.struct(e["path"].alias("k"), F.coalesce(e["value"], F.lit("")).alias("v")))
        flags = F.array_compact(F.array(F.when(x["deep"], "nested_too_deep"), F.when(F.size(values) > MOST, "too_many_fields")))
        return from_pairs(F.lit(True), pairs, F.octet_length(raw), flags)

    return let(json_leaves(raw), lambda x: F.when(x.isNotNull(), build(x)))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


PART = r"((?:[^\\|]|\\.)*)\|"
CEF_PAIR = r"(?s)(?:^| )([A-Za-z0-9_.-]+)=((?:(?! [A-Za-z0-9_.-]+=).)*)"
# Names of the fields of the two headers.
CEF_NAMES = ["cef.version", "cef.vendor", "cef.product", "cef.device_version", "cef.signature_id", "cef.name", "cef.severity"]
LEEF_NAMES = ["leef.version", "leef.vendor", "leef.product", "leef.product_version", "leef.event_id"]


def split_by(text: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of a pattern that spans the text, by one search; a text that it doesn't span is one element."""
    return F.split(F.regexp_replace(text, pattern, BETWEEN.join(f"${k}" for k in range(1, n + 1))), BETWEEN, -1)


def cef(raw: Column) -> Column:
    """Seven header fields with escaped pipes, then values that run to the next `` key=``."""

    def build(parts: Column) -> Column:
        head = F.array(*[F.struct(F.lit(n).alias("k"), unescape(F.get(parts, k)).alias("v")) for k, n in enumerate(CEF_NAMES)])
        keys, values = (F.regexp_extract_all(F.get(parts, 7), F.lit(CEF_PAIR), F.lit(k)) for k in (1, 2))
        pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), unescape(F.trim(v)).alias("v")))
        return from_pairs(F.size(parts) == 8, F.concat(head, pairs), F.octet_length(raw))

    parts = split_by(F.regexp_replace(raw, r"(?s)\A.*?CEF:", ""), rf"(?s)\A{PART * 7}(.*)\z", 8)
    return F.when(raw.contains("CEF:"), let(parts, build))


def leef(raw: Column) -> Column:
    """Version 1.0 (attributes between tabs) and 2.0 (between a sign of its own, ``xHH`` too); values are taken as they are."""

    def build(parts: Column) -> Column:
        newer = F.get(parts, 0) == "2.0"
        sign = F.get(parts, 5)
        given = F.when(sign.rlike(r"\Ax[0-9A-Fa-f]{2}\z"), F.char(F.conv(F.substring(sign, 2, 2), 16, 10).cast("int"))).otherwise(sign)
        head = F.array(*[F.struct(F.lit(n).alias("k"), (F.get(parts, k) if k == 0 else unescape(F.get(parts, k))).alias("v")) for k, n in enumerate(LEEF_NAMES)])
        delim = F.when(newer, given).otherwise("\t")
        bits = F.filter(F.split(F.element_at(parts, -1), F.when(delim == "", "").otherwise(F.concat(F.lit("\\Q"), delim, F.lit("\\E")))), lambda x: x.contains("="))
        pairs = F.transform(bits, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
        return from_pairs(F.size(parts) == F.when(newer, 7).otherwise(6), F.concat(head, pairs), F.octet_length(raw))

    body = F.regexp_replace(raw, r"(?s)\A.*?LEEF:", "")
    one, two = rf"(?s)\A([^|]*)\|{PART * 4}(.*)\z", rf"(?s)\A([^|]*)\|{PART * 5}(.*)\z"
    return F.when(raw.contains("LEEF:"), let(F.when(body.startswith("2.0|"), split_by(body, two, 7)).otherwise(split_by(body, one, 6)), build))


def flatten_json(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, path, value) of every leaf; objects by name, arrays by index, null as the empty text."""
    leaves = df.select(F.col(key), F.explode(json_leaves(F.col(raw))["leaves"]).alias("x"))
    return leaves.select(key, F.col("x.path").alias("path"), F.coalesce("x.value", F.lit("")).alias("value"))


EXTRACTORS = {"kv": kv, "regex": regex, "csv": csv, "json": json, "cef": cef, "leef": leef}
