"""MinHash near-duplicates: universal hash minima, banding, signature verification, full-set verification, star components.

1. ``sketch``: a document's set of distinct word shingles as 64-bit hashes, the minima of many universal hash functions over it, and a key for each band.
2. Documents with the same set are one class; what follows handles classes.
3. Band keys that several classes share are buckets. Buckets with the same members are handled once. Within a bucket signatures are compared, and edges
   that connect what is similar enough by signature are passed on: as many as it has members at most, never all pairs.
4. Components of these edges are small families. Within a family full sets are compared, and again only connecting links are passed on.
5. Components of the confirmed links are the result.

Connectivity is exact but for the chance that two texts at the threshold share no band or that their signatures differ by more than ``SLACK``: less
than one in a million each. Large buckets and families are cut into blocks, and each pair of blocks is a unit of work of its own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loglake.llm.components import components
from loglake.llm.shared import ship, stored

WORDS = 5
BANDS, ROWS = 32, 6
#: At a similarity of 0.85 a pair shares no band with probability (1 - 0.85^6)^32 = 3e-7.
HASHES = BANDS * ROWS
#: Bands and rows for thresholds below 0.85: at 0.8 (1 - 0.8^5)^48 = 5e-9; further down there are as many bands as ``MISSED`` asks for.
LOW_BANDS, LOW_ROWS, MISSED = 48, 5, 1e-6
#: How far a signature's estimate may fall below the threshold: ``DEVIATIONS`` standard deviations, sqrt(0.85 * 0.15 / 192) = 0.026 each, and this at least.
SLACK, DEVIATIONS = 0.14, 5.4
BLOCK = 256
#: Shingles of a block of full sets.
BLOCK_SHINGLES = 1 << 19
#: Ids of candidate families are broadcast up to this count (8 bytes each; an eighth of it if they are not bigint), beyond it joined by shuffle.
BROADCAST_IDS = 2_000_000

MULTIPLIER = 0x9E3779B97F4A7C15


def banding(least: float) -> tuple[int, int]:
    """Bands, and rows of a band, for links of a similarity of ``least`` or more."""
    if least >= 0.85:
        return BANDS, ROWS
    return max(LOW_BANDS, math.ceil(math.log(MISSED) / math.log1p(-(least**LOW_ROWS)))), LOW_ROWS


@functools.cache
def tables(n_bands: int = BANDS, n_rows: int = ROWS):
    n_hashes = n_bands * n_rows
    r = np.random.default_rng(20240229)
    letters = r.integers(1, 1 << 63, 256, dtype=np.uint64)
    a = r.integers(0, 1 << 31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = r.integers(0, 1 << 32, n_hashes, dtype=np.uint32)
    bands = r.integers(1, 1 << 63, (n_bands, n_rows), dtype=np.uint64) | np.uint64(1)
    return letters, a, b, bands, r.integers(1, 1 << 63, n_bands, dtype=np.uint64)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: a shingle is a run of bytes of the lower-cased text whose words are joined by one blank, and the sums
    of letter codes times powers of a multiplier up to each byte give the hash of any run at once."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tables()[0][data] * up[: len(data)], out=sums[1:])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(ends) >= words:
        ends, starts = ends[words - 1 :], starts[: len(starts) - words + 1]
    else:
        ends, starts = ends[-1:], starts[:1]
    return np.unique(mix((sums[ends] - sums[starts]) * down[starts]))


def minima(hashes: np.ndarray, layout: tuple[int, int] = (BANDS, ROWS)) -> np.ndarray:
    _, a, b, _, _ = tables(*layout)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        values = a[:, None] * x[None, at : at + 1024]
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, layout: tuple[int, int] = (BANDS, ROWS)) -> np.ndarray:
    _, _, _, factors, own = tables(*layout)
    return mix((least.reshape(layout).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64) + own).view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, layout: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """id, n_shingles, set_key (128 bits of the set; null for no words), signature (a byte a hash function), bands."""
    schema = pa.schema([("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.large_binary()):
                h = shingles(text.as_py())
                if not len(h):
                    out.append((0, None, None, None))
                    continue
                least = minima(h, layout)
                out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), least.astype(np.uint8).tobytes(), band_keys(least, layout)))
            columns = [pa.array([row[k] for row in out], field.type) for k, field in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_shingles bigint, set_key binary, signature binary, bands array<bigint>")


class Forest:
    """Union by the smaller index."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i
        return i != j


def connecting(n: int, similar) -> Iterator[tuple[int, int]]:
    """Edges that connect what ``similar(i)`` (indices after i) connects."""
    forest = Forest(n)
    for i in range(n - 1):
        for j in similar(i):
            if forest.join(i, int(j)):
                yield i, int(j)


def blocks(members: DataFrame, parts: str) -> DataFrame:
    """``members`` (bucket, set_key, ...) dealt to pairs of blocks: a row goes to each pair that holds its block; ``parts`` counts a bucket's blocks."""
    block = F.pmod(F.xxhash64("set_key"), F.col(parts).cast("bigint")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1))
    return members.withColumn("b", block).withColumn("o", other).withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o")}).drop("b", "o", parts)


def grouped(rows: DataFrame, payload: str, work) -> DataFrame:
    """Edges (u, v) that ``work(keys, payloads)`` finds in each (bucket, bi, bj), one group after the other in a stream."""
    dealt = rows.select("bucket", "bi", "bj", "set_key", payload).repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "set_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, loads, out = None, [], [], []

        def close():
            if len(keys) > 1:
                out.extend((keys[i], keys[j]) for i, j in work(loads))

        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for name, key, load in zip(names, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if name != group:
                    close()
                    group, keys, loads = name, [], []
                keys.append(key)
                loads.append(load)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], names=["u", "v"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], names=["u", "v"])

    return dealt.mapInArrow(run, "u binary, v binary")


def by_signature(least: float):
    bands, rows = banding(least)
    need = least - max(SLACK, DEVIATIONS * math.sqrt(least * (1 - least) / (bands * rows)))
    most = int(bands * rows * (1 - (need + (1 - need) / 256)))  # functions that may differ; a byte agrees by chance once in 256

    def work(loads):
        s = np.frombuffer(b"".join(loads), np.uint8).reshape(len(loads), -1)
        return connecting(len(loads), lambda i: np.flatnonzero((s[i + 1 :] != s[i]).sum(axis=1) <= most) + i + 1)

    return work


def by_sets(num: int, den: int):
    def work(loads):
        sets = [np.frombuffer(x, np.uint64) for x in loads]
        sizes = np.array([len(x) for x in sets])
        if len(sets) == 2:
            shared = len(np.intersect1d(*sets, assume_unique=True))
            return [(0, 1)] if den * shared >= num * (sizes.sum() - shared) else []
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        mark = np.zeros(codes.max() + 1, np.int32)

        def similar(i):
            own = codes[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[codes[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
            mark[own] = 0
            return np.flatnonzero(den * shared >= num * (sizes[i] + sizes[i + 1 :] - shared)) + i + 1

        return connecting(len(sets), similar)

    return work


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100) -> DataFrame:
    """Per row of ``docs``: the id, n_shingles, component_id and kept. Linked: ``den`` * intersection >= ``num`` * union of the shingle sets.

    Texts that are null, empty or without words have no shingles, are linked with nothing and are kept. Fewer than five words are one shingle. Rows with
    the same text are linked, with repeated ids or not; null ids count only where a component has no other (component_id and kept are then null). An
    empty table gives an empty result; further columns are not read.
    """
    ship(docs.sparkSession)
    rows = stored(sketch(docs, id_col, text_col, banding(num / den)), "sketch")
    classes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("first_id"), F.max("n_shingles").alias("size"))
    faces = rows.filter("n_shingles > 0").select("set_key", "signature", "bands")
    found = families(docs, faces, classes, id_col, text_col, num, den)
    labelled = classes.join(found, classes["set_key"] == found["node"], "left").select("set_key", "first_id", F.coalesce("component", "set_key").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = labelled.join(least, "component").select("set_key", "component_id")
    full = rows.filter("n_shingles > 0").join(members, "set_key").select("id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return full.union(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def families(docs, faces: DataFrame, classes: DataFrame, id_col: str, text_col: str, num: int, den: int) -> DataFrame:
    """Components of the confirmed links between classes that have any."""
    keyed = faces.select("set_key", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band", "set_key").agg(F.lit(1).alias("one")).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("set_key").cast("decimal(38,0)")).alias("s"), F.min("set_key").alias("m"))
    distinct = buckets.filter("n > 1").groupBy("n", "s", "m").agg(F.min("band").alias("band"))
    members = keyed.join(distinct.select("band", "n"), "band").select(F.col("band").cast("string").alias("bucket"), "set_key", F.ceil(F.col("n") / BLOCK).alias("parts")).distinct()
    signatures = faces.groupBy("set_key").agg(F.min("signature").alias("signature"))
    edges = grouped(blocks(members.join(signatures, "set_key"), "parts"), "signature", by_signature(num / den))
    near = components(edges)

    sized = near.join(classes, near["node"] == classes["set_key"]).select("component", "set_key", "first_id", "size")
    sized = stored(sized, "families")
    totals = sized.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("parts"))
    ids = sized.select("first_id").distinct()
    if sized.count() <= (BROADCAST_IDS if isinstance(docs.schema[id_col].dataType, LongType) else BROADCAST_IDS // 8):
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(ids, F.col("id").eqNullSafe(F.col("first_id")), "left_semi").select("t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h.tobytes() for h in map(shingles, batch.column(0).cast(pa.large_binary()).to_pylist()) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h) for h in found], pa.binary()), pa.array(found, pa.binary())], names=["set_key", "shingle_set"])

    whole = texts.mapInArrow(sets, "set_key binary, shingle_set binary").dropDuplicates(["set_key"])
    dealt = sized.join(totals, "component").select(F.hex("component").alias("bucket"), "set_key", "parts").join(whole, "set_key")
    return components(grouped(blocks(dealt, "parts"), "shingle_set", by_sets(num, den)))
