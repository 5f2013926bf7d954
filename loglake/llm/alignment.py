"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

1. ``write_aligned``: tasks encode texts with both tokenizers and intersect the two ascending lists of end offsets of each document. The shorter list
   drives: each of its ends gallops (steps that double, then a binary search) into the longer list, from where the end before it was found. Ends in
   both lists cut the tokens into groups; the places found are ranks, and their differences give the range of tokens that each token overlaps.
2. Linked id pairs are counted by documents: a chunk of documents lists its distinct pairs once with their documents, Spark adds these up.
3. The counts go back to the chunks that asked, one row a pair and chunk, and documents add up what their links count.

A document is a row; null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens: zeros and an empty
digest. Rows that repeat count as documents of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.shared import ship, store, stored
from loglake.llm.tokencount import PATTERN

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are aligned at once, and that share a list of pairs.
STEP = 1 << 20
CHUNK = 16 << 20
#: Pairs of a row of such a list.
LISTED = 4096
#: Every so many-th end of the shorter list is searched first; those between start where their left neighbour was found.
STRIDES = (512, 64, 8, 1)


class ByteTokens:
    """A byte-level BPE vocabulary read from its JSON file; special tokens are left out, so that their strings are plain text."""

    def __init__(self, path: str = BYTE_BPE):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in said["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in token): k for token, k in said["model"]["vocab"].items() if token not in special}
        merged = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        made = [self.ranks[bytes(letters[c] for c in a + b)] for a, b in merged]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        self.table = {k: b for b, k in self.ranks.items()}
        self._encoding = None

    def __getstate__(self):
        return {"ranks": self.ranks, "table": self.table, "_encoding": None}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with a space before it."""
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return [np.array(self._encoding.encode_ordinary(" " + t), np.int64) for t in texts]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest for letters from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PieceTokens:
    """A SentencePiece vocabulary; the model puts a space before each text."""

    def __init__(self, path: str = PIECE_BPE):
        with open(path, "rb") as f:
            self.model = f.read()
        self._processor = None
        piece = self.processor().id_to_piece
        self.table = {k: piece_bytes(piece(k)) for k in range(self.processor().get_piece_size())}

    def __getstate__(self):
        return {"model": self.model, "table": self.table, "_processor": None}

    def processor(self):
        if self._processor is None:
            import sentencepiece

            self._processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self._processor

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.processor().encode(texts, num_threads=1)]


def piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def bounds(sizes) -> np.ndarray:
    """Where lists of these sizes begin and end, one after another."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def gallop(short: np.ndarray, short_at: np.ndarray, long: np.ndarray, long_at: np.ndarray) -> np.ndarray:
    """For lists one after another (``*_at``: bounds of each): where the first element of the longer list is that is no less than each of the shorter.

    Both lists of a pair end in the same number. All elements of a stride search at once, each from the place of the searched one before it.
    """
    found = np.zeros(len(short), np.int64)
    of = np.repeat(np.arange(len(short_at) - 1), np.diff(short_at))
    rank = np.arange(len(short)) - short_at[of]
    before = None
    for stride in STRIDES:
        mine = np.flatnonzero(rank % stride == 0) if before is None else np.flatnonzero((rank % stride == 0) & (rank % before != 0))
        low = long_at[of[mine]] if before is None else found[mine - rank[mine] % before]
        found[mine] = search(short[mine], low, long_at[of[mine] + 1] - 1, long)
        before = stride
    return found


def search(wanted: np.ndarray, low: np.ndarray, last: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Exponential, then binary search of each wanted number from ``low`` on; ``last`` is the end of its list, which is no less than it."""
    low, high = low.copy(), last.copy()
    step, going = 1, np.arange(len(wanted))
    while len(going):
        probe = np.minimum(low[going] + step - 1, last[going])
        less = long[probe] < wanted[going]
        high[going[~less]] = probe[~less]
        going = going[less]
        low[going] = probe[less] + 1
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        less = long[middle] < wanted[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def align(a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray) -> dict:
    """Groups and links of documents given as lists of ids (none empty), by the number of bytes of each id.

    a, b: all ids; a_at, b_at: bounds of documents; a_ends, b_ends: whether a group ends with the token; of, link_a, link_b: document and token
    places of each link.
    """
    a_at, b_at = bounds([len(x) for x in a]), bounds([len(x) for x in b])
    a, b = np.concatenate(a), np.concatenate(b)
    a_end, b_end = offsets(a_sizes[a], a_at), offsets(b_sizes[b], b_at)
    a_ends, b_ends = np.zeros(len(a), bool), np.zeros(len(b), bool)
    links = []
    fewer = np.diff(a_at) <= np.diff(b_at)
    for docs, s_end, s_at, s_ends, l_end, l_at, l_ends in ((np.flatnonzero(fewer), a_end, a_at, a_ends, b_end, b_at, b_ends), (np.flatnonzero(~fewer), b_end, b_at, b_ends, a_end, a_at, a_ends)):
        if not len(docs):
            links.append((np.empty(0, np.int64),) * 3)
            continue
        s, l = places(s_at, docs), places(l_at, docs)
        s_own, l_own = bounds(np.diff(s_at)[docs]), bounds(np.diff(l_at)[docs])
        found = gallop(s_end[s], s_own, l_end[l], l_own)
        common = l_end[l][found] == s_end[s]
        s_ends[s[common]] = True
        l_ends[l[found[common]]] = True
        first = np.concatenate([[0], (found + common)[:-1]])
        first[s_own[:-1]] = l_own[:-1]
        width = found - first + 1
        lane = np.repeat(np.arange(len(s)), width)
        other = np.repeat(first - bounds(width)[:-1], width) + np.arange(len(lane))
        links.append((np.repeat(docs, np.diff(s_own))[lane], s[lane], l[other]))
    (d1, s1, l1), (d2, s2, l2) = links
    return {"a": a, "b": b, "a_at": a_at, "b_at": b_at, "a_ends": a_ends, "b_ends": b_ends, "of": np.concatenate([d1, d2]), "link_a": np.concatenate([s1, l2]), "link_b": np.concatenate([l1, s2])}


def offsets(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """End offsets within each document."""
    total = np.cumsum(sizes)
    return total - np.repeat(np.concatenate([[0], total])[at[:-1]], np.diff(at))


def places(at: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places of all tokens of the documents, in order."""
    sizes = np.diff(at)[docs]
    return np.repeat(at[docs] - bounds(sizes)[:-1], sizes) + np.arange(sizes.sum())


def group_digests(x: dict) -> list[str]:
    """SHA-256 of each document's groups, ``a1,a2|b1;a3|b2,b3``, written for all documents at once."""
    a_group, b_group = np.cumsum(x["a_ends"]) - x["a_ends"], np.cumsum(x["b_ends"]) - x["b_ends"]
    n = int(a_group[-1]) + 1
    a_before, b_before = bounds(np.bincount(a_group, minlength=n)), bounds(np.bincount(b_group, minlength=n))
    a_place, b_place = np.arange(len(a_group)) + b_before[a_group], np.arange(len(b_group)) + a_before[b_group + 1]
    ids, mark = np.empty(len(a_place) + len(b_place), np.int64), np.empty(len(a_place) + len(b_place), np.uint8)
    ids[a_place], ids[b_place] = x["a"], x["b"]
    mark[a_place] = np.where(x["a_ends"], ord("|"), ord(","))
    mark[b_place] = np.where(x["b_ends"], ord(";"), ord(","))
    width = len(str(ids.max()))
    size = 1 + np.searchsorted(10 ** np.arange(1, width), ids, side="right")
    digits = np.empty((len(ids), width + 1), np.uint8)
    for k in range(width):  # the digits of a shorter number begin further left
        digits[:, k] = ids // 10 ** np.maximum(size - 1 - k, 0) % 10 + ord("0")
    digits[np.arange(len(ids)), size] = mark
    text = digits[np.arange(width + 1) <= size[:, None]]
    ends = np.cumsum(size + 1)[x["a_at"][1:] + x["b_at"][1:] - 1]
    return [hashlib.sha256(text[a : b - 1]).hexdigest() for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte planes apart so that the upper ones compress to nothing."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8)
    return planes.reshape(4, n).T.copy().view("<u4")[:, 0].astype(np.int64)


class Chunk:
    """Documents of a task that share a list of pairs; what is kept of a document are its distinct pairs and how often each is linked."""

    def __init__(self, name: int):
        self.name, self.size, self.rows, self.keys, self.times, self.n = name, 0, [], [], [], []

    def add(self, ids: list, a: list[np.ndarray], b: list[np.ndarray], whole: list[bool], a_sizes, b_sizes) -> None:
        held = [k for k, ok in enumerate(whole) if ok]
        rows = [[i, 0, 0, 0, 0, ""] for i in ids]
        counts = np.zeros(len(ids), np.int64)
        if held:
            x = align([a[k] for k in held], [b[k] for k in held], a_sizes, b_sizes)
            linked = x["a"][x["link_a"]] * len(b_sizes) + x["b"][x["link_b"]]
            key, times = np.unique(x["of"] * (len(a_sizes) * len(b_sizes)) + linked, return_counts=True)
            of, pair = np.divmod(key, len(a_sizes) * len(b_sizes))
            groups = np.diff(np.concatenate([[0], np.cumsum(x["a_ends"])])[x["a_at"]])
            counts[held] = np.bincount(of, minlength=len(held))
            for k, g, n_links, digest in zip(held, groups.tolist(), np.bincount(x["of"], minlength=len(held)).tolist(), group_digests(x), strict=True):
                rows[k][1:] = [len(a[k]), len(b[k]), g, n_links, digest]
            self.keys.append(pair)
            self.times.append(times.astype(np.uint32))
        self.rows += rows
        self.n += counts.tolist()

    def tables(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0: documents; of kind 1: the chunk's pairs with their documents, ``LISTED`` a row."""
        keys = np.concatenate(self.keys) if self.keys else np.empty(0, np.int64)
        pairs, which, docs = np.unique(keys, return_inverse=True, return_counts=True)
        times = np.concatenate(self.times) if self.times else np.empty(0, np.uint32)
        at = bounds(self.n)
        blobs = [(pack(np.diff(which[p:q], prepend=0)), pack(times[p:q])) if q > p else (None, None) for p, q in zip(at[:-1].tolist(), at[1:].tolist())]
        for k in range(0, len(self.rows), 1000):
            part = list(zip(*self.rows[k : k + 1000], strict=True))
            size = len(part[0])
            packed = list(zip(*blobs[k : k + 1000], strict=True))
            cols = [[self.name] * size, [0] * size, *part, self.n[k : k + 1000], *packed, [None] * size, [None] * size, [None] * size]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        for k in range(0, len(pairs), LISTED):
            cols = [[self.name], [1], *[[None]] * 9, [k], [pairs[k : k + LISTED]], [docs[k : k + LISTED]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def write_aligned(docs: DataFrame, a: ByteTokens, b: PieceTokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded and aligned documents (kind 0) and lists of the pairs of each chunk (kind 1), stored."""
    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast((a, b))  # two vocabularies, whatever the documents are
    fields = f"chunk bigint, kind int, id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_pairs bigint, which binary, times binary, first int, pairs array<bigint>, docs array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sent.value
        a_sizes, b_sizes = table_sizes(a.table), table_sizes(b.table)
        schema, chunk, seq = None, None, 0
        for batch in batches:
            if schema is None:
                big = pa.int64()
                types = [big, pa.int32(), batch.column(0).type, *[big] * 4, pa.string(), big, pa.binary(), pa.binary(), pa.int32(), pa.list_(big), pa.list_(big)]
                schema = pa.schema([(n.split()[0], t) for n, t in zip(fields.split(", "), types, strict=True)])
            for ids, texts, size in steps(batch):
                chunk = chunk or Chunk((TaskContext.get().partitionId() << 32) + seq)
                a_ids, b_ids = a.encode(texts), b.encode(texts)
                whole = []
                for t, x, y in zip(texts, a_ids, b_ids, strict=True):
                    said = (" " + t).encode()
                    whole.append(t != "" and b"".join(map(a.table.__getitem__, x.tolist())) == said and b"".join(map(b.table.__getitem__, y.tolist())) == said)
                chunk.add(ids, a_ids, b_ids, whole, a_sizes, b_sizes)
                chunk.size += size
                if chunk.size >= CHUNK:
                    yield from chunk.tables(schema)
                    chunk, seq = None, seq + 1
        if chunk:
            yield from chunk.tables(schema)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, fields)
    schema = rows.select(*[c for c in rows.columns if c != "kind"], "kind").schema
    return docs.sparkSession.read.schema(schema).parquet(store(rows, "aligned", partition="kind", compression="zstd"))


def table_sizes(table: dict[int, bytes]) -> np.ndarray:
    sizes = np.zeros(max(table) + 1, np.int64)
    for k, b in table.items():
        sizes[k] = len(b)
    return sizes


def steps(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str], int]]:
    """Rows of a batch in steps of about ``STEP`` bytes, a longer text alone."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1), strict=True):
        t = t.as_py()
        ids.append(i.as_py())
        texts.append(t)
        size += 2 * len(t)
        if size >= 2 * STEP:
            yield ids, texts, size // 2
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size // 2


def align_documents(docs: DataFrame, a: ByteTokens, b: PieceTokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of its A id), count_sum (of its links), groups_sha256.

    A pair's count is the number of documents that hold it linked. Of the best counts as many rows are broadcast as A has ids.
    """
    aligned = write_aligned(docs, a, b, id_col, text_col)
    width = max(b.table) + 1
    listed = aligned.filter("kind = 1").select("chunk", "first", F.posexplode(F.arrays_zip("pairs", "docs")).alias("k", "x")).select("chunk", (F.col("first") + F.col("k")).alias("k"), F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = stored(listed.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.expr(f"pair div {width}L")), "pair-counts")
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("best")))
    known = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    back = listed.select("chunk", "k", "pair").join(known, "pair").select(F.col("chunk").alias("of"), "k", "n", "top")
    kind = aligned.schema["id"].dataType.simpleString()
    plain = ["n_a", "n_b", "n_groups", "n_links"]

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        n, top = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        k = right.column("k").to_numpy()
        n[k], top[k] = right.column("n").to_numpy(), right.column("top").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for pairs, which, times in zip(left.column("n_pairs").to_pylist(), left.column("which").to_pylist(), left.column("times").to_pylist(), strict=True):
            if not pairs:
                n_best.append(0)
                count_sum.append(0)
                continue
            which, times = np.cumsum(unpack(which, pairs)), unpack(times, pairs)
            n_best.append(int(times[top[which]].sum()))
            count_sum.append(int((times * n[which]).sum()))
        return pa.table([left.column("id"), *[left.column(c) for c in plain], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), left.column("groups_sha256")], names=[id_col, *plain, "n_best", "count_sum", "groups_sha256"])

    own = aligned.filter("kind = 0").select("chunk", "id", *plain, "groups_sha256", "n_pairs", "which", "times")
    return own.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(add_up, f"{id_col} {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
