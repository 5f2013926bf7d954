"""Column expressions for values in log fields: typed conversion, shapes, times.

Every conversion gives null for a value it rejects; none raises, whatever ANSI mode says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
MAC = r"^[0-9A-Fa-f]{2}([:.-]?[0-9A-Fa-f]{2}){5}$"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
TRUE, FALSE = ["1", "t", "T", "TRUE", "true", "True"], ["0", "f", "F", "FALSE", "false", "False"]
#: Milliseconds of a unit of a duration.
DURATION_MS = {"s": 1000.0, "ms": 1.0, "ns": 1e-6}


def to_int(x: Column) -> Column:
    return F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("bigint"))


def to_uint(x: Column) -> Column:
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("decimal(20,0)"))


def to_float(x: Column) -> Column:
    return F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double"))


def to_ip(x: Column) -> Column:
    """Canonical dotted form of version 4 (also where it is mapped into version 6); others of version 6 in lower case."""
    mapped = F.regexp_extract(F.lower(x), r"^::ffff:([0-9.]+)$", 1)
    plain = F.when(mapped != "", mapped).otherwise(x)
    v6 = F.lower(x).rlike(r"^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|^(([0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4})?::(([0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4})?$")
    return F.when(plain.rlike(IPV4), plain).when(v6, shortest_ip6(F.lower(x)))


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ip6_groups(x: Column) -> Column:
    """The eight groups of a version 6 address (more or fewer where it is none)."""
    part = lambda y: F.when(F.coalesce(y, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(y, ":"))
    sides = F.transform(F.split(x, "::"), part)
    fill = lambda s: F.concat(F.get(s, 0), F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(F.flatten(s)))), F.coalesce(F.get(s, 1), F.array().cast("array<string>")))
    return once(sides, fill)


def shortest_ip6(x: Column) -> Column:
    """Version 6 as it is written by rule: no leading zeros, the first of the longest runs of two or more zero groups as ``::``."""

    def written(groups: Column) -> Column:
        text = F.concat(F.lit(":"), F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"), F.lit(":"))
        found = F.regexp_extract_all(text, F.lit("(?<=:)(?:0:){2,}"), F.lit(0))
        longest = once(found, lambda f: F.aggregate(f, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best)))
        cut = once(F.struct(text.alias("t"), longest.alias("l")), lambda z: F.when(z["l"] == "", z["t"]).otherwise(once(F.call_function("instr", z["t"], F.concat(F.lit(":"), z["l"])), lambda k: F.concat(F.substring(z["t"], F.lit(1), k), F.lit(":"), F.substring(z["t"], k + 1 + F.length(z["l"]), F.length(z["t"]))))))
        return F.regexp_replace(F.regexp_replace(cut, "^:(?!:)", ""), "(?<!:):$", "")

    return once(ip6_groups(x), lambda g: F.when(F.size(g) == 8, written(g)))


def ip_number(x: Column) -> Column:
    """The number of a version 4 address."""
    p = F.split(x, r"\.")
    return F.when(x.rlike(IPV4), sum(p[k].try_cast("bigint") * 256 ** (3 - k) for k in range(4)))


def to_port(x: Column) -> Column:
    n = to_int(x)
    return F.when(n.between(0, 65535), n.cast("int"))


def to_mac(x: Column) -> Column:
    bare = F.lower(F.regexp_replace(x, "[:.-]", ""))
    return F.when(x.rlike(MAC), F.regexp_replace(bare, "(..)(?=.)", "$1:"))


def to_bool(x: Column) -> Column:
    return F.when(x.isin(TRUE), True).when(x.isin(FALSE), False)


def to_duration_ms(x: Column, unit: str) -> Column:
    return F.round(to_float(x) * DURATION_MS[unit]).cast("bigint")


def to_enum(x: Column, values: dict, default=None) -> Column:
    """The text of the value's own entry (exact, upper and lower case apart), else the default; an empty text has neither."""
    values, default = {k: str(v) for k, v in values.items()}, None if default is None else str(default)
    found = F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in values.items()]) if values else F.lit(None).cast("string")
    return F.when(x.isNotNull(), F.coalesce(found, F.lit(default))) if default is not None else found


#: Named layouts and the patterns that read them; the unit ones are numbers since 1970.
LAYOUTS = {"rfc3339": None, "epoch_s": 1000.0, "epoch_ms": 1.0, "epoch_us": 1e-3, "epoch_ns": 1e-6}


def to_time_ms(x: Column, layout: str, zone: str | None = None, received: Column | None = None) -> Column:
    """Milliseconds since 1970. A pattern without a year takes it from ``received``, or the year before where the month lies over a month ahead."""
    if layout == "rfc3339":
        return F.unix_millis(F.when(x.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), x.try_cast("timestamp")))
    if layout in LAYOUTS:
        number = F.when(x.rlike(r"^[0-9]+(\.[0-9]+)?$"), x.try_cast("decimal(30,6)"))
        return F.floor(number * F.lit(LAYOUTS[layout]).cast("decimal(12,6)")).cast("bigint")
    if "y" not in layout:
        text = F.regexp_replace(F.trim(x), " +", " ")
        month = F.array_position(F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]), F.substring(text, 1, 3))
        here = F.from_utc_timestamp(received, zone) if zone else received
        year = F.year(here) - F.when(month > F.month(here) + 1, 1).otherwise(0)
        t = F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), text), F.lit(f"yyyy {layout}"))
    else:
        t = F.try_to_timestamp(F.regexp_replace(F.trim(x), " +", " "), F.lit(layout))
    return F.unix_millis(F.to_utc_timestamp(t, zone) if zone else t)


# What values look like, in the order in which the shapes are tried.
SHAPES = [
    ("ip", r"^\d{1,3}(\.\d{1,3}){3}$"),
    ("uuid", UUID),
    ("timestamp", r"^(\d{4}[-/]\d\d[-/]\d\d([ T]\S*)?|\d\d:\d\d:\d\d(\.\d+)?)$"),
    ("epoch", r"^(\d{10}|\d{13}|\d{16}|\d{19})$"),
    ("int", r"^-?\d+$"),
    ("hex", r"^(0x[0-9a-fA-F]+|(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{6,})$"),
    ("word", r"^[A-Za-z][\w-]*$"),
]
#: A pair of a key=value line: the key, and a value in quotes or up to white space.
PAIR = r'([A-Za-z_][\w.-]*)=("[^"]*"|\S*)'


def shape(value: Column, quoted: Column | None = None) -> Column:
    """What a value looks like: qstr if it was quoted, else the first of ``SHAPES`` that fits, else other."""
    found = F.coalesce(*[F.when(value.rlike(pattern), name) for name, pattern in SHAPES], F.lit("other"))
    return found if quoted is None else F.when(quoted, "qstr").otherwise(found)


def sniff(raw: Column) -> Column:
    """Format hint from the first 256 characters, the first rule that fits: a priority in angle brackets (then CEF or LEEF within the next 200
    characters, else by the version), a bare CEF or LEEF, JSON or XML by the first sign, three ``word=``, five commas and no ``=``."""
    head = F.substring(raw, 1, 256)
    prival = head.rlike(r"^<[0-9]{1,3}>")
    body = F.regexp_replace(head, r"^<[0-9]{1,3}>", "")
    near, text = F.substring(body, 1, 200), F.regexp_replace(head, r"^[ \t\r\n]+", "")
    return (
        F.when(prival & near.contains("CEF:"), "cef")
        .when(prival & near.contains("LEEF:"), "leef")
        .when(prival & body.startswith("1 "), "syslog5424")
        .when(prival, "syslog3164")
        .when(head.startswith("CEF:"), "cef")
        .when(head.startswith("LEEF:"), "leef")
        .when(text.rlike(r"^[{\[]"), "json")
        .when(text.rlike(r"^<(\?xml|[A-Za-z])"), "xml")
        .when(F.regexp_count(head, F.lit(r"[A-Za-z0-9_]=")) >= 3, "kv")
        .when((F.regexp_count(head, F.lit(",")) >= 5) & ~head.contains("="), "csv")
        .otherwise("unknown")
    )


def line_kind(line: Column) -> Column:
    """json (that parses), cef or leef (a marker with its version in the first 160 characters), kv (four pairs), csv (five commas) or text."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    head = F.substring(text, 1, 160)
    return (
        F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), "json")
        .when(head.rlike(r"CEF:\d+\|"), "cef")
        .when(head.rlike(r"LEEF:\d\.\d\|"), "leef")
        .when(F.regexp_count(text, F.lit(PAIR)) >= 4, "kv")
        .when(F.regexp_count(text, F.lit(",")) >= 5, "csv")
        .otherwise("text")
    )


def framing(head: Column) -> Column:
    """Octet counting (one to six digits and a blank stand first) or lines."""
    return F.when(head.rlike("^[0-9]{1,6} "), "octet").otherwise("lf")


def ip_bits(ip: Column) -> Column:
    """The bits of a canonical address, as text of 32 or 128 signs."""

    def bits(x: Column) -> Column:
        number = F.aggregate(F.split(x, r"\."), F.lit(0).cast("bigint"), lambda n, part: n * 256 + F.coalesce(part.try_cast("bigint"), F.lit(0)))
        four = F.lpad(F.conv(number.cast("string"), 10, 2), 32, "0")
        digits = F.array_join(F.transform(ip6_groups(x), lambda g: F.lpad(g, 4, "0")), "")
        six = once(digits, lambda d: F.concat(*[F.lpad(F.conv(F.substring(d, at, 16), 16, 2), 64, "0") for at in (1, 17)]))
        return F.when(x.rlike(IPV4), four).when(x.contains(":"), six)

    return once(ip, bits)


#: Valid UTF-8 of two to four bytes, as the bytes read as Latin-1.
MULTIBYTE = "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"


def byte_profile(raw: Column) -> Column:
    """Counts of bytes of a binary column: printable ASCII, control, in valid multi-byte UTF-8, invalid."""
    text = F.decode(raw, "ISO-8859-1")
    rest = F.regexp_replace(text, MULTIBYTE, "")
    control = F.regexp_count(text, F.lit("[\\x00-\\x1f\\x7f]"))
    invalid = F.regexp_count(rest, F.lit("[\x80-\xff]"))
    multi = F.length(text) - F.length(rest)
    return F.struct((F.length(text) - control - invalid - multi).alias("printable"), control.alias("control"), multi.alias("multibyte"), invalid.alias("invalid"))
