"""Events to other shapes: a partitioned lake, OCSF, ECS and CEF lines, batches bounded by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.operators import cuts
from loglake.operators.normalize import PATHS

OCSF = {p.replace(".", "_") for p in PATHS}


def flat(parsed: DataFrame) -> DataFrame:
    """One flat row an event: record_id, event_uid, times, parser and the closed list of fields."""
    uid = F.concat(F.col("record_id").cast("string"), F.lit("."), F.col("event.parser_id"), F.lit("@"), F.col("event.parser_version"))
    return parsed.select("record_id", uid.alias("event_uid"), "source_id", "received_at", "event_time", "event.vendor", "event.product", "event.parser_version", "event.extractor", "event.unmapped", "event.flags", "event.ocsf.*")


def folder(vendor: Column) -> Column:
    """A vendor's name, made safe for a path; none is ``unknown``."""
    return F.regexp_replace(F.coalesce(F.nullif(vendor, F.lit("")), F.lit("unknown")), "[^A-Za-z0-9_.-]", "_")


def lake(rows: DataFrame) -> DataFrame:
    """With the partition columns dt (UTC date of the event) and vendor (made safe for a path) and the leftovers as JSON."""
    return rows.withColumns({"dt": F.date_format("event_time", "yyyy-MM-dd"), "vendor": folder(F.col("vendor")), "extras_json": F.to_json("unmapped")}).drop("unmapped")


def at(path: str) -> Column:
    """The value of a target path: its own column, or what is kept among further paths."""
    return F.col("event.ocsf")[path.replace(".", "_")].cast("string") if path in PATHS else F.try_element_at("event.more", F.lit(path))


def nested() -> Column:
    """The mapped paths as a struct of structs; further paths stay dotted, under ``more``."""
    tree: dict[str, list] = {}
    for path in PATHS:
        tree.setdefault(path.partition(".")[0], []).append(path)

    def node(paths: list[str], depth: int) -> Column:
        own: dict[str, list[str]] = {}
        for path in paths:
            own.setdefault(path.split(".")[depth], []).append(path)
        value = lambda ps: F.col("event.ocsf")[ps[0].replace(".", "_")] if len(ps) == 1 and ps[0].count(".") == depth else node(ps, depth + 1)
        return F.struct(*[value(ps).alias(k) for k, ps in own.items()])

    return node(list(PATHS), 0)


def lake_columns(parsed: DataFrame, current: Column | None = None) -> DataFrame:
    """An event a row, as the lake's files hold it: 29 columns with types, and the rest as JSON. Absent texts are empty, absent numbers 0.

    ``parsed`` is what the normalizer gives, with ``segment``; numbers that aren't one count as absent. The typed vendor is ``vendor_name``: ``vendor`` is the
    partition, with ``dt``, the UTC date of the event. ``current`` tells superseded events; all are current without it. Nothing is shuffled.
    """
    text = lambda *paths: F.coalesce(*[at(p) for p in paths], F.lit(""))
    number = lambda kind, *paths: F.coalesce(F.coalesce(*[at(p) for p in paths]).try_cast(kind), F.lit(0).cast(kind))
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    extras = F.struct(
        nested().alias("ocsf"), F.col("event.more").alias("more"), F.col("event.unmapped").alias("unmapped"), F.col("event.coverage").alias("coverage"), F.col("event.identity").alias("identity"),
        *([F.col("entities")] if "entities" in parsed.columns else []),
    )
    columns = {
        "event_id": F.concat(F.col("record_id").cast("string"), F.lit("."), F.col("event.parser_id"), F.lit("@"), F.col("event.parser_version")),
        "record_id": F.col("record_id").cast("bigint"), "segment": F.col("segment").cast("bigint"), "raw_sha256": F.unhex(F.sha2(F.col("raw").cast("binary"), 256)), "source_id": plain("source_id"),
        "vendor_name": plain("event.vendor"), "product": plain("event.product"), "parser_id": F.col("event.parser_id"), "parser_version": F.col("event.parser_version"), "template_id": F.col("event.extractor"),
        "event_time": F.coalesce("event_time", "received_at"), "received_at": F.col("received_at"),
        "severity_id": number("int", "severity_id"), "action_id": number("int", "action_id"), "activity_id": number("int", "activity_id"), "class_uid": number("int", "class_uid"),
        "src_ip": text("src_endpoint.ip", "source.ip", "src_ip"), "dst_ip": text("dst_endpoint.ip", "destination.ip", "dst_ip"),
        "src_port": number("int", "src_endpoint.port", "source.port", "src_port"), "dst_port": number("int", "dst_endpoint.port", "destination.port", "dst_port"),
        "proto": text("protocol", "network.transport", "proto"), "bytes_in": number("bigint", "traffic.bytes_in", "network.bytes_in", "bytes_in"), "bytes_out": number("bigint", "traffic.bytes_out", "network.bytes_out", "bytes_out"),
        "user": text("user.name", "actor.user.name", "user"), "host": text("device.hostname", "host.name", "host"), "confidence": F.col("parse_confidence").cast("float"),
        "integrity_flags": F.coalesce("event.flags", F.array().cast("array<string>")), "time_from_receipt": F.col("time_from_receipt"), "current": F.lit(True) if current is None else current,
        "extras_json": F.to_json(extras), "dt": F.date_format(F.coalesce("event_time", "received_at"), "yyyy-MM-dd"), "vendor": folder(F.col("event.vendor")),
    }
    return parsed.filter("event is not null").select(*[c.alias(name) for name, c in columns.items()])


def write_lake_columns(rows: DataFrame, path: str) -> None:
    """Appends rows of ``lake_columns``; a task's rows of a day and vendor lie together, so that it has one file open at a time."""
    rows.sortWithinPartitions("dt", "vendor", "record_id").write.partitionBy("dt", "vendor").option("compression", "zstd").option("maxRecordsPerFile", 500_000).mode("append").parquet(path)


def write_lake(rows: DataFrame, path: str) -> None:
    lake(rows).write.partitionBy("dt", "vendor").option("compression", "zstd").option("maxRecordsPerFile", 500_000).mode("append").parquet(path)


def ocsf(rows: DataFrame) -> DataFrame:
    """(record_id, line): nested OCSF JSON with lineage in ``metadata``."""
    end = lambda side: F.struct(*[F.col(f"{side}_endpoint_{k}").alias(k) for k in ("ip", "port")])
    doc = F.struct(
        "class_uid", "activity_id", "type_uid", "time", "severity_id", "message", end("src").alias("src_endpoint"), end("dst").alias("dst_endpoint"),
        F.struct(F.struct(F.col("actor_user_name").alias("name")).alias("user")).alias("actor"), "unmapped",
        F.struct(F.col("event_uid").alias("uid"), F.struct(F.col("vendor").alias("vendor_name"), F.col("product").alias("name")).alias("product"), F.unix_millis("received_at").alias("logged_time")).alias("metadata"),
    )
    return rows.select("record_id", F.to_json(doc).alias("line"))


def ocsf_documents(parsed: DataFrame, raw: bool = False) -> DataFrame:
    """(event_id, record_id, line), an event once, as nested OCSF JSON: the mapped paths, leftovers as ``unmapped``, uid and original time in ``metadata``, and
    ``lineage`` (record, hash, parser, confidence, flags, and ``entities`` if ``parsed`` has them). ``raw``: the line itself as base64, too. Further paths
    stay dotted, under ``more``. An event without a time has that of its receipt. Events that are listed twice are told by their id."""
    uid = F.concat(F.col("record_id").cast("string"), F.lit("."), F.col("event.parser_id"), F.lit("@"), F.col("event.parser_version"))
    tops = list(dict.fromkeys(p.partition(".")[0] for p in PATHS))
    own = [F.col(f"_o.metadata.{p.partition('.')[2]}").alias(p.partition(".")[2]) for p in PATHS if p.count(".") == 1 and p.startswith("metadata.")]
    stamp = F.date_format(F.coalesce("event_time", "received_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    lineage = F.struct(
        "record_id", F.sha2(F.col("raw").cast("binary"), 256).alias("raw_sha256"), F.col("event.parser_id").alias("parser"), F.col("event.parser_version").alias("parser_version"),
        F.col("parse_confidence").alias("confidence"), F.coalesce("event.flags", F.array().cast("array<string>")).alias("integrity_flags"),
        *([F.col("entities")] if "entities" in parsed.columns else []), *([F.lit("base64").alias("raw_encoding")] if raw else []),
    )
    doc = F.struct(
        *[F.col(f"_o.{k}").alias(k) for k in tops if k != "metadata"], F.struct(*own, F.col("_uid").alias("uid"), stamp.alias("original_time")).alias("metadata"), F.col("event.more").alias("more"), F.col("event.unmapped").alias("unmapped"),
        *([F.base64(F.col("raw").cast("binary")).alias("raw_data")] if raw else []), lineage.alias("lineage"),
    )
    rows = parsed.filter("event is not null").withColumns({"_uid": uid, "_o": nested()})
    return rows.select(F.col("_uid").alias("event_id"), "record_id", F.to_json(doc).alias("line")).dropDuplicates(["event_id"])


def ecs(rows: DataFrame, action_lines: bool = False) -> DataFrame:
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    doc = F.struct(
        stamp.alias("@timestamp"), F.struct(F.col("src_endpoint_ip").alias("ip"), F.col("src_endpoint_port").alias("port")).alias("source"),
        F.struct(F.col("dst_endpoint_ip").alias("ip")).alias("destination"), F.struct(F.col("actor_user_name").alias("name")).alias("user"),
        F.struct(F.col("message").alias("action"), F.col("severity_id").alias("severity"), F.col("event_uid").alias("id")).alias("event"),
    )
    line = F.to_json(doc)
    if action_lines:
        line = F.concat_ws("\n", F.to_json(F.struct(F.struct(F.col("event_uid").alias("_id")).alias("create"))), line)
    return rows.select("record_id", line.alias("line"))


def escape_header(x: Column) -> Column:
    return F.translate(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "\r\n", "  ")


def escape_extension(x: Column) -> Column:
    escaped = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\="))
    return F.replace(F.replace(escaped, F.lit("\r\n"), F.lit("\\n")), F.lit("\n"), F.lit("\\n"))


def cef_line() -> Column:
    """Escaped header and extension, absent fields left out, severity held between 0 and 10."""
    severity = F.least(F.greatest(F.coalesce("severity_id", F.lit(0)), F.lit(0)), F.lit(10)).cast("string")
    head = [escape_header(F.coalesce(c, F.lit(""))) for c in (F.col("vendor"), F.col("product"), F.col("parser_version"), F.col("extractor"), F.coalesce("message", F.lit("event")))]
    pair = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), escape_extension(c.cast("string"))))
    rest = F.concat_ws(" ", pair("rt", F.unix_millis("event_time")), pair("src", F.col("src_endpoint_ip")), pair("spt", F.col("src_endpoint_port")), pair("dst", F.col("dst_endpoint_ip")), pair("suser", F.col("actor_user_name")))
    return F.concat_ws("|", F.lit("CEF:0"), *head, severity, rest)


def cef(rows: DataFrame) -> DataFrame:
    """(record_id, line)."""
    return rows.select("record_id", cef_line().alias("line"))


def syslog(rows: DataFrame, host: str, app: str, octets: bool = False) -> DataFrame:
    """(record_id, frame): CEF lines behind a header of RFC 5424 (facility local0, informational), as a stream carries them: ended by a line feed, or after
    the number of their bytes."""
    stamp = F.concat(F.rtrim(F.rtrim(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0")), F.lit(".")), F.lit("Z"))
    line = F.concat(F.lit("<134>1 "), stamp, F.lit(f" {host} {app} - - - "), cef_line())
    # a column of its own, so that the line isn't written a second time for its length
    written = rows.select("record_id", line.alias("_line"))
    frame = F.concat(F.octet_length("_line").cast("string"), F.lit(" "), "_line") if octets else F.concat("_line", F.lit("\n"))
    return written.select("record_id", frame.alias("frame"))


def batches(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """``rows`` with the number of their batch: none is over ``most`` bytes, but for a single row that is larger itself."""
    return cuts.cut(rows, group, order, size, most)


def hec(rows: DataFrame, index: str = "main") -> DataFrame:
    """(source_id, record_id, line, bytes): an envelope an event, with its time in seconds."""
    event = F.struct(F.col("event_uid").alias("event_id"), "record_id", "vendor", "product", F.col("extractor").alias("parser"), "parser_version", F.struct(*[c for c in rows.columns if c in OCSF]).alias("ocsf"), "unmapped")
    envelope = F.struct((F.unix_micros("event_time") / 1e6).alias("time"), F.col("source_id").alias("host"), F.col("source_id").alias("source"), F.lit("loglake:event").alias("sourcetype"), F.lit(index).alias("index"), event.alias("event"))
    line = F.to_json(envelope)
    return rows.select("source_id", "record_id", line.alias("line"), F.octet_length(line).cast("bigint").alias("bytes"))
