"""Token counts by a separator scan over flat token files.

A token file is nothing but identifiers, two bytes each (little endian), each document's followed by the end-of-document identifier: no index, no
lengths. Files are cut into blocks of fixed size without regard to documents. Tasks read their blocks and search the identifiers of each at once; a
prefix scan over one small row a block (separators, tokens after the last one) then tells each block how many documents ended before it and how many
tokens of its first document lie in blocks before.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.llm.shared import shared_dir, ship, stored

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Bytes of a block; and blocks of a step of the scan's upper level.
BLOCK = 4 << 20
STEP = 1024

_encodings: dict = {}


def ranks_of(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(ranks: dict[bytes, int]):
    import tiktoken

    if id(ranks) not in _encodings:
        _encodings.clear()
        _encodings[id(ranks)] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[id(ranks)]


def where(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path as Spark writes it (file:/x too)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, ranks: dict[bytes, int], path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a token file a task under ``path``, a URI that all executors share; rows (id, file, ordinal) say what went where.

    A task writes under a name of its own and renames when it is done, so a repeated task replaces what it wrote. Null texts are empty documents. The
    rows are a plan: store them once (``stored``), reading them twice would write twice.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value)
        store, root = where(path)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        own = f"{root}/.{name}-{uuid.uuid4().hex}"
        n = 0
        with store.open_output_stream(own) as out:
            for batch in batches:
                for text in batch.column(1):
                    ids = enc.encode_ordinary(text.as_py() or "")
                    ids.append(end)
                    out.write(np.array(ids, "<u2").tobytes())
                size = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * size), pa.array(range(n, n + size), pa.int64())], names=["id", "file", "ordinal"])
                n += size
        store.move(own, f"{root}/{name}")

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, file string, ordinal bigint")


def scan(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the token files under ``path``; tokens after a file's last separator are a last document.

    An empty file has no documents. A file with an odd number of bytes is refused.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "length").filter("length > 0")
    cut = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {block}L"))))
    return documents(blocks(cut.repartition("path", "block"), end, block))


def blocks(cut: DataFrame, end: int, block: int) -> DataFrame:
    """Per block: separators, tokens before the first, lengths between separators, tokens after the last (all, if there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, length, k in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if length % 2:
                    raise ValueError(f"{path} holds half a token")
                store, place = where(path)
                with store.open_input_file(place) as f:
                    f.seek(k * block)
                    ids = np.frombuffer(f.read(min(block, length - k * block)), "<u2")
                at = np.flatnonzero(ids == end)
                inner = (np.diff(at) - 1).astype(np.int32)
                out.append((path.rpartition("/")[2], k, k == (length - 1) // block, len(at), int(at[0]) if len(at) else 0, inner, len(ids) - int(at[-1]) - 1 if len(at) else len(ids)))
            names = ["file", "block", "final", "n", "head", "inner", "tail"]
            types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=names)

    return cut.select("path", "length", "block").mapInArrow(run, "file string, block bigint, final boolean, n bigint, head bigint, inner array<int>, tail bigint")


def carried(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Exclusive scan: ``ended`` separators before a row, and ``open`` tokens since the last of them (or since the start)."""
    along = Window.partitionBy(*keys).orderBy(order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("ended", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_run", F.sum((F.col("n") > 0).cast("bigint")).over(along))
    held = run.withColumn("_held", F.sum("tail").over(Window.partitionBy(*keys, "_run").orderBy(order)))
    return held.withColumn("open", F.coalesce(F.lag("_held").over(along), F.lit(0))).drop("_run", "_held")


def documents(found: DataFrame) -> DataFrame:
    """Stitches blocks: the scan runs within steps of ``STEP`` blocks, then over one row a step."""
    found = found.withColumn("step", F.expr(f"block div {STEP}"))
    slim = found.select("file", "step", "block", "n", "tail")
    local = carried(slim, ["file", "step"], "block")
    step = local.groupBy("file", "step").agg(F.sum("n").alias("n"), F.max_by(F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail")), "block").alias("tail"))
    above = carried(step, ["file"], "step").select("file", "step", F.col("ended").alias("_ended"), F.col("open").alias("_open"))
    told = local.join(above, ["file", "step"]).select("file", "block", (F.col("ended") + F.col("_ended")).alias("ended"), (F.col("open") + F.when(F.col("ended") == 0, F.col("_open")).otherwise(0)).alias("open"))
    whole = found.join(told, ["file", "block"])
    closed = F.when(F.col("n") > 0, F.concat(F.array(F.col("open") + F.col("head")), F.col("inner").cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>"))
    left = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail"))
    lengths = F.when(F.col("final") & (left > 0), F.concat(closed, F.array(left))).otherwise(closed)
    return whole.select("file", "ended", F.posexplode(lengths).alias("at", "n_tokens")).select("file", (F.col("ended") + F.col("at")).alias("ordinal"), "n_tokens")


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, file, ordinal, n_tokens) of every row of ``docs``, counted in token files that are written to the shared folder (``tokens-*``).

    Null and empty texts have 0 tokens, texts of any length are read whole, repeated rows and ids are counted each, an empty table gives an empty result,
    and further columns (whatever their names) are not read. The files are the product: they are the caller's, and stay until the caller deletes them.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    placed = stored(write_tokens(docs, ranks, path, id_col=id_col, text_col=text_col), "placed")
    if not placed.take(1):
        return placed.select(F.col("id").alias(id_col), "file", "ordinal", F.lit(0).cast("bigint").alias("n_tokens"))
    return placed.join(scan(spark, path), ["file", "ordinal"]).select(F.col("id").alias(id_col), "file", "ordinal", "n_tokens")
