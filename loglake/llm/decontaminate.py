"""Benchmark decontamination by latent semantic retrieval.

1. Documents become sequences of codes: a word is the CRC-32 of its bytes where a bitmap of the benchmark's words (of fixed size) may hold it, else 0. The
   codes are stored once for the whole benchmark, later steps read them only.
2. Document frequencies of the benchmark's words over all documents give the inverse document frequencies.
3. A randomised SVD of the TF-IDF matrix of the benchmark's passages (items cut into parts of ``STRIDE`` words) gives a latent space: tasks hold passages
   and add up their share of the products, the driver factors what is as wide as the rank.
4. Windows of ``2 * STRIDE`` words of each document are projected, and parts whose cosine is ``COSINE`` or more are candidates, if the product
   is ``COVERED`` of the part's square or more. Words that a large share of the documents holds have no weight here; they count in step 5.
5. A candidate's surroundings are aligned with the whole item: the longest common subsequence must hold ``SHARE`` of the item's words. Where the item
   has an answer of its own (an answer column), that with the answer must hold ``ANSWER`` of its words, too; without one the share of the item's last
   sentence is reported and decides nothing.

The benchmark is indexed in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words at most, so that what the driver holds and tasks get stays
bounded for benchmarks of any size; each block reads the codes again, not the texts. Two words with the same CRC-32 count as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loglake.llm.shared import ship, stored

BLOCK_ITEMS, BLOCK_WORDS = 2000, 500_000
#: Bits of a word's code that the bitmap of the benchmark's words tells apart (half a megabyte).
BITS = 22
STRIDE = 32
RANK = 512
COSINE, COVERED = 0.4, 0.35
#: Words in more documents than this share (and this number) don't count in the retrieval, unless a part would keep fewer than ``LEFT``.
COMMON, COMMON_ROWS, LEFT = 0.02, 20, 8
#: Blocks of a document that are projected together.
SPAN = 128
SHARE, ANSWER = 0.6, 0.5
SEED = 11

SEPARATORS = bytes(c for c in range(128) if not (chr(c).isalnum() or c == ord("_")))
BLANKS = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and underscores; any character beyond ASCII is part of a word."""
    return text.lower().encode("utf-8", "replace").translate(BLANKS).split() if text else []


def answer_of(text: str) -> str:
    """The last sentence of an item that holds a word."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text) if words(x)]
    return parts[-1] if parts else ""


def lcs(a, b) -> int:
    """Length of the longest common subsequence, a bit for each place of ``b``."""
    at: dict = {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def weights(seen: np.ndarray, rows: int, parts: list[np.ndarray]) -> np.ndarray:
    """Inverse document frequencies, 0 for common words and for code 0."""
    idf = np.log((1.0 + rows) / (1.0 + seen)) + 0.1
    idf[0] = 0.0
    common = seen > max(COMMON * rows, COMMON_ROWS)
    for p in parts:
        if (~common[p]).sum() < LEFT:
            common[p] = False
    return np.where(common, 0.0, idf)


def coded_words(found: list[bytes]) -> np.ndarray:
    """CRC-32 of each word; 0 is kept for other words."""
    return np.maximum(np.fromiter(map(crc32, found), np.uint32, len(found)), 1)


def benchmark_words(items: DataFrame) -> np.ndarray:
    """The bitmap of the codes of all words of ``items`` (text, answer): ``1 << BITS`` bits, whatever the benchmark's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [coded_words(words(x)) >> np.uint32(32 - BITS) for c in (0, 1) for x in batch.column(c).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(seen)).astype(np.int32) if seen else [], pa.int32())], names=["slot"])

    out = np.zeros(1 << BITS, bool)
    for batch in items.select("text", "answer").mapInArrow(run, "slot int").distinct().toArrow().to_batches():
        out[batch.column(0).to_numpy()] = True
    return np.packbits(out)


def encode(docs: DataFrame, bitmap: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, codes): four bytes a word; documents without a word of the benchmark are left out."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap).astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, out = [], []
            for k, text in enumerate(batch.column(1)):
                codes = coded_words(words(text.as_py()))
                codes[~known[codes >> np.uint32(32 - BITS)]] = 0
                if codes.any():
                    ids.append(k)
                    out.append(codes.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.binary())], names=["id", "codes"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, codes binary")


def numbered(codes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Codes as numbers from 1 in a block's (sorted) vocabulary, 0 where it doesn't hold them."""
    live = np.flatnonzero(codes)
    at = np.minimum(np.searchsorted(vocabulary, codes[live]), len(vocabulary) - 1)
    out = np.zeros(len(codes), np.uint32)
    out[live] = np.where(vocabulary[at] == codes[live], at + 1, 0)
    return out


def frequencies(coded: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Documents that hold each word of the block; tasks count first, and the answer has a row a word of the block at most."""
    size = len(vocabulary) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for codes in batch.column(0).to_pylist():
                total[numbered(np.unique(np.frombuffer(codes, np.uint32)), vocabulary)] += 1
        total[0] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["word", "n"])

    out = np.zeros(size, np.int64)
    for r in coded.select("codes").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def summed(passages: DataFrame, share, rows: int, columns: int, pieces: int = 16) -> np.ndarray:
    """Sum over tasks of the matrix that ``share(list of code arrays)`` gives. Tasks pass on the rows they have touched; strips of rows are added up by as
    many tasks."""
    height = -(-rows // pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = (np.zeros((rows, columns)) if total is None else total) + share([np.frombuffer(x, np.uint32) for x in batch.column(0).to_pylist()])
        if total is None:
            return
        touched = np.flatnonzero(total.any(axis=1))
        strip = touched // height
        out = [(k, touched[strip == k], total[touched[strip == k]]) for k in np.unique(strip).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in out], pa.int32()), pa.array([at.tobytes() for _, at, _ in out], pa.binary()), pa.array([x.tobytes() for _, _, x in out], pa.binary())], names=["strip", "at", "part"])

    def add(key, table):
        first = key[0].as_py() * height
        total = np.zeros((min(height, rows - first), columns))
        for at, part in zip(table.column("at").to_pylist(), table.column("part").to_pylist(), strict=True):
            total[np.frombuffer(at, np.int64) - first] += np.frombuffer(part).reshape(-1, columns)
        return pa.table({"strip": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((rows, columns))
    for r in passages.select("codes").mapInArrow(run, "strip int, at binary, part binary").groupBy("strip").applyInArrow(add, "strip int, part binary").collect():
        part = np.frombuffer(r["part"]).reshape(-1, columns)
        out[r["strip"] * height : r["strip"] * height + len(part)] = part
    return out


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, power: int = 1, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (words x rank, float32) and singular values of the passages' TF-IDF matrix."""
    rank = max(1, min(rank, len(idf)))
    basis = np.random.default_rng(seed).standard_normal((len(idf), rank))
    for _ in range(1 + power):
        y = summed(passages, multiply(idf, basis, False), len(idf), rank)
        basis, _ = np.linalg.qr(y)
    gram = summed(passages, multiply(idf, basis, True), rank, rank, 1)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-values)
    return (basis @ vectors[:, order]).astype(np.float32), np.sqrt(np.maximum(values[order], 0))


def multiply(idf: np.ndarray, basis: np.ndarray, gram: bool):
    """Passages' share of A'(A basis), or of (A basis)'(A basis)."""

    def share(codes: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((basis.shape[1] if gram else len(idf), basis.shape[1]))
        for c in codes:
            at = np.unique(c)
            seen = idf[at] @ basis[at]
            if gram:
                total += np.outer(seen, seen)
            else:
                total[at] += np.outer(idf[at], seen)
        return total

    return share


class Index:
    """A block's items, their parts and the latent space; what tasks get."""

    def __init__(self, ids: list, items: list[np.ndarray], answers: list[np.ndarray], asked: list[bool], idf: np.ndarray, space: np.ndarray) -> None:
        self.ids, self.asked = ids, asked  # asked: the answer is one of a column, and must be there
        self.items, self.answers = [x.tolist() for x in items], [x.tolist() for x in answers]
        self.sizes = np.array([len(x) for x in items])
        self.counts = idf > 0
        self.placed = idf.astype(np.float32)[:, None] * space
        parts = [(k, p) for k, x in enumerate(items) for p in pieces(x)]
        self.owner = np.array([k for k, _ in parts])
        vectors = np.array([self.placed[np.unique(p)].sum(axis=0) for _, p in parts], np.float32)
        self.norms = np.linalg.norm(vectors, axis=1)
        self.least = max(float(self.norms.min()), 1e-6)
        self.parts = (vectors / np.maximum(self.norms[:, None], 1e-9)).T.copy()
        # the items that hold a word, and how often
        self.holds: list = [None] * len(idf)
        held: dict[int, dict[int, int]] = {}
        for k, item in enumerate(self.items):
            for x in item:
                own = held.setdefault(x, {})
                own[k] = own.get(k, 0) + 1
        for x, own in held.items():
            self.holds[x] = (np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own)))

    def search(self, codes: np.ndarray) -> list[tuple[int, float, float, float]]:
        """Item, cosine, LCS share and answer share of each item found in a document, best place each."""
        best: dict[int, tuple[float, float, float]] = {}
        blocks = -(-len(codes) // STRIDE)
        for first in range(0, max(1, blocks - 1), SPAN):
            count = min(SPAN + 1, blocks - first)
            own = codes[first * STRIDE : (first + count) * STRIDE]
            at = np.flatnonzero(self.counts[own])
            if not len(at):
                continue
            block = at // STRIDE
            starts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1))
            sums = np.zeros((count, self.placed.shape[1]), np.float32)
            sums[block[starts]] = np.add.reduceat(self.placed[own[at]], starts, axis=0)
            windows = sums if count == 1 else sums[:-1] + sums[1:]
            norms = np.linalg.norm(windows, axis=1)
            live = np.flatnonzero(norms >= COVERED * self.least)  # no other can cover a part
            product = windows[live] @ self.parts
            rows, hits = np.nonzero((product >= COSINE * norms[live, None]) & (product >= COVERED * self.norms))
            for k in np.flatnonzero(np.diff(rows, prepend=-1)):
                row = rows[k]
                found = hits[k : np.searchsorted(rows, row, side="right")]
                self.align(codes, (first + int(live[row])) * STRIDE, found, product[row, found] / norms[live[row]], best)
        return [(k, *x) for k, x in sorted(best.items())]

    def align(self, codes: np.ndarray, start: int, parts: np.ndarray, cosine: np.ndarray, best: dict) -> None:
        """Checks the candidates of a window; no common subsequence is longer than the words that both hold, counted as often as the item has them."""
        owners = self.owner[parts]
        reach = int(self.sizes[owners].max())
        here = np.unique(codes[max(0, start - reach) : start + 2 * STRIDE + reach])
        held = [self.holds[x] for x in here.tolist() if self.holds[x] is not None]
        if not held:
            return
        most = np.bincount(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), len(self.items))
        for p in np.flatnonzero(most[owners] >= SHARE * self.sizes[owners]):
            k = int(owners[p])
            item = self.items[k]
            near = codes[max(0, start - len(item)) : start + 2 * STRIDE + len(item)].tolist()
            if common(near, item) < SHARE * len(item):
                continue
            share, answer = lcs(near, item) / len(item), lcs(near, self.answers[k]) / max(1, len(self.answers[k]))
            if share >= SHARE and (answer >= ANSWER or not self.asked[k]) and (k not in best or best[k] < (float(cosine[p]), share, answer)):
                best[k] = (float(cosine[p]), share, answer)


def common(near: list[int], item: list[int]) -> int:
    """Words in common, counted as often as both have them: no common subsequence is longer."""
    counts: dict[int, int] = {}
    for x in near:
        if x:
            counts[x] = counts.get(x, 0) + 1
    n = 0
    for x in item:
        if counts.get(x, 0):
            counts[x] -= 1
            n += 1
    return n


def pieces(item: np.ndarray) -> list[np.ndarray]:
    """Equal parts of at most ``STRIDE`` words."""
    return np.array_split(item, -(-len(item) // STRIDE)) if len(item) else []


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """(id, item, cosine, lcs_share, answer_share) of every item that a row of ``docs`` holds.

    With ``answer_col`` an item that has an answer there counts only with its answer; an item without one counts by its own words alone.
    Null or empty texts and items match nothing. Items with the same text are found each. Repeated rows give repeated results; an empty table on either
    side gives an empty result; further columns are not read.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kind}, item_id {item_kind}, cosine double, lcs_share double, answer_share double"
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).cast("string").alias("text"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))
    items = items.filter("text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("words")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["words"] // BLOCK_WORDS))
    coded = stored(encode(docs, benchmark_words(items), id_col, text_col), "codes", compression="zstd")
    rows = docs.count()
    found = None
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        leaks = block_leaks(coded, rows, part, schema)
        if leaks is not None:
            found = leaks if found is None else found.unionByName(leaks)
    return found if found is not None else spark.createDataFrame([], schema)


def block_leaks(coded: DataFrame, count: int, block: DataFrame, schema: str) -> DataFrame | None:
    rows = [(r["id"], words(r["text"]), own or words(answer_of(r["text"])), bool(own)) for r in block.collect() for own in [words(r["answer"])]]
    rows = [(key, coded_words(item), coded_words(answer), asked) for key, item, answer, asked in rows if item]
    if not rows:
        return None
    vocabulary = np.unique(np.concatenate([x for _, item, answer, _ in rows for x in (item, answer)]))
    items, answers = [numbered(r[1], vocabulary) for r in rows], [numbered(r[2], vocabulary) for r in rows]
    spark = coded.sparkSession
    seen = frequencies(coded, vocabulary)
    idf = weights(seen, count, [p for x in items for p in pieces(x)])
    passages = spark.createDataFrame([(bytearray(p.tobytes()),) for x in items for p in pieces(x)], "codes binary")
    space, _ = randomised_svd(passages, idf, min(RANK, sum(len(pieces(x)) for x in items)))
    sent = spark.sparkContext.broadcast((Index([r[0] for r in rows], items, answers, [r[3] for r in rows], idf, space), vocabulary))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names, types = arrow.names, arrow.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value
        for batch in batches:
            at, out = [], []
            for k, codes in enumerate(batch.column(1)):
                for hit in own.search(numbered(np.frombuffer(codes.as_py(), np.uint32), known)):
                    at.append(k)
                    out.append(hit)
            columns = [pa.array([own.ids[h[0]] for h in out], types[1]), *(pa.array([h[j] for h in out], pa.float64()) for j in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    return coded.mapInArrow(run, schema)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names: str) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null id go together, if one of them leaks."""
    leaks = find_leaks(docs, benchmark, id_col, **names).select(F.col(id_col).alias("_leak")).distinct()
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col("_leak")), "left_anti")
