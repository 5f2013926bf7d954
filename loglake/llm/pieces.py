"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has an edge for each vocabulary piece that stands in it, and one for each character that is no piece (which becomes byte pieces).
A segmentation scores the sum of its pieces' scores. Forward Viterbi gives the best score of each prefix; a search from the end that ranks what it has
by own score plus that of the best prefix is an A* search with an exact heuristic and finds segmentations best first.

No piece joins letters and other signs, or goes on after a blank that follows something (checked when a vocabulary is loaded), so a text falls
into chunks and its lattice into a chain of small ones. Distinct chunks are segmented together, chunks of a length at a time; the best segmentation of a
text joins those of its chunks, and its N best differ from it in the N - 1 chunks at most whose second best lose least, which alone are searched.

Order is by score, and a function of the text alone: the best of equal segmentations of a chunk is the one with the longest last piece (then the last but
one, ...), further ones follow in the order of the search, and within a text the change that comes later goes first.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.shared import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
SPACE = "▁"
#: Chunks that a Python worker remembers.
REMEMBERED = 250_000
#: Chunks of more characters are segmented one by one.
LONG = 96
#: Characters of text that are worked on together.
TOGETHER = 1 << 21


class Vocabulary:
    """Pieces with scores; read once on the driver, sent to the tasks."""

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], byte_ids: list[int], unknown: int, dummy_prefix: bool = True) -> None:
        self.pieces, self.byte_ids, self.unknown, self.dummy_prefix = pieces, byte_ids, unknown, dummy_prefix
        self.ids = {p: k for k, p in enumerate(pieces) if usable[k]}
        self.scores = np.array(scores, np.float64)
        self.score_list = self.scores.tolist()
        self.unknown_score = min((float(self.scores[k]) for p, k in self.ids.items() if p.strip(SPACE)), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        # white space and digits of other kinds that pieces hold count as signs
        odd = {c for p in self.ids if len(p) > 1 for c in p if c.isspace() or re.match(r"[^\W\d_]", c) and not c.isalpha()}
        odd = "".join(map(re.escape, sorted(odd)))
        letter, sign, blank = rf"[^\W\d_{odd}]", rf"(?:[\d_{odd}]|[^\w\s{SPACE}])", rf"[^\S{odd}]"
        self.chunk = re.compile(rf" *{letter}+| *(?:[\d_{odd}]|[^\w\s])+| +|\s")
        # a piece that no chunk may hold whole: letters next to signs, a blank mark after something, other white space with company
        crossing = re.compile(rf"{letter}{sign}|{sign}{letter}|[^{SPACE}]{SPACE}|.{blank}|{blank}.", re.S)
        self.whole = any(crossing.search(p) for p in self.ids)
        back = {k: b for b, k in enumerate(byte_ids)}
        self.bytes = [bytes([back[k]]) if k in back else p.replace(SPACE, " ").encode() if usable[k] else b"" for k, p in enumerate(pieces)]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if any(sp.normalize(x) != SPACE + x.replace(" ", SPACE) for x in ("a  b", "\u00c4\uff21 \u00bd", "x ")):
            raise ValueError(f"{path} normalises texts, or puts no blank before them: only models that take texts as they are can be read back without loss")
        usable = [not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k)) for k in range(n)]
        byte_ids = [k for k in range(n) if sp.is_byte(k)]
        return cls([sp.id_to_piece(k) for k in range(n)], [sp.get_score(k) for k in range(n)], usable, byte_ids if len(byte_ids) == 256 else [], sp.unk_id())

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, joined they are the text as it is segmented (with the blank that goes before)."""
        text = (" " if self.dummy_prefix else "") + text.replace(SPACE, " ")
        return [text] if self.whole else self.chunk.findall(text)

    def spelled(self, ids: list[int], chunk: str) -> list[int]:
        """Replaces -1 (a character that is no piece) by the ids of its bytes, or by the unknown piece's."""
        out, at = [], 0
        for k in ids:
            if k < 0:
                out.extend(self.byte_ids[b] for b in chunk[at].encode()) if self.byte_ids else out.append(self.unknown)
                at += 1
            else:
                out.append(k)
                at += len(self.pieces[k])
        return out


class Table:
    """Hash table from the hash of a run of characters to its piece, looked up for whole arrays."""

    def __init__(self, v: Vocabulary) -> None:
        self.factor = np.uint64(0x9E3779B97F4A7C15)
        found = {self.of(p): k for p, k in v.ids.items()}
        self.bits = np.uint64(max(10, (4 * len(found)).bit_length()))
        size = 1 << int(self.bits)
        self.keys, self.ids = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.mask = np.int64(size - 1)
        for h, k in found.items():
            at = int(self.slot(np.array([h], np.uint64))[0])
            while self.ids[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.ids[at] = h, k

    def of(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0xD1342543DE82EF95 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * self.factor) >> (np.uint64(64) - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, -1 for none."""
        at = self.slot(hashes)
        out = np.where(self.keys[at] == hashes, self.ids[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
        while len(open_):
            at_open = (at[open_] + 1) & self.mask
            at[open_] = at_open
            hit = self.keys[at_open] == hashes[open_]
            out[open_[hit]] = self.ids[at_open[hit]]
            open_ = open_[~hit & (self.ids[at_open] >= 0)]
        return out


class Growing:
    """An array that rows are added to."""

    def __init__(self, kind) -> None:
        self.data, self.size = np.empty(1024, kind), 0

    def add(self, rows: np.ndarray) -> None:
        if self.size + len(rows) > len(self.data):
            self.data = np.concatenate((self.data[: self.size], np.empty(self.size + 2 * len(rows), self.data.dtype)))
        self.data[self.size : self.size + len(rows)] = rows
        self.size += len(rows)


class Segmenter:
    """Best segmentations of chunks (remembered), N best of chunks and of texts."""

    def __init__(self, v: Vocabulary, nbest: int = NBEST) -> None:
        self.v, self.nbest, self.table = v, nbest, Table(v)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.lists: dict[str, list[tuple[float, bytes]]] = {}
        #: By a chunk's number: ids (all chunks' one after the other), where they start, how many, the score, and what the second best loses.
        self.ids, self.start, self.count, self.score, self.loss = (Growing(k) for k in (np.int32, np.int64, np.int64, np.float64, np.float64))

    def learn(self, chunks: set[str]) -> None:
        """Segments the chunks that aren't remembered."""
        if len(self.number) > REMEMBERED:
            self.forget()
        by_length: dict[int, list[str]] = {}
        for c in chunks - self.number.keys():
            by_length.setdefault(len(c), []).append(c)
        for length, found in by_length.items():
            if length > LONG:
                for c in found:
                    self.segment_long(c)
                continue
            step = max(1, 200_000 // length)
            for at in range(0, len(found), step):
                self.segment(found[at : at + step], length)

    def segment(self, chunks: list[str], length: int) -> None:
        """Viterbi in both directions over chunks of one length at once."""
        n, v = len(chunks), self.v
        chars = np.frombuffer("".join(chunks).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).T.astype(np.uint64)
        chars = np.ascontiguousarray(chars) + np.uint64(1)
        ids, scores = [], []
        hashes = np.zeros((length, n), np.uint64)
        for size in range(1, min(length, v.longest) + 1):
            hashes = hashes[: length - size + 1] * np.uint64(0xD1342543DE82EF95) + chars[size - 1 :]
            k = self.table.find(hashes.ravel()).reshape(hashes.shape)
            ids.append(k)
            scores.append(np.where(k >= 0, v.scores[k], v.unknown_score if size == 1 else -np.inf))
        ahead = np.full((length + 1, n), -np.inf)
        last = np.zeros((length + 1, n), np.int32)
        ahead[0] = 0
        for j in range(1, length + 1):
            for size in range(min(j, v.longest), 0, -1):  # of equals the longest last piece stays
                s = ahead[j - size] + scores[size - 1][j - size]
                better = s > ahead[j]
                ahead[j][better] = s[better]
                last[j][better] = size
        back = np.full((length + 1, n), -np.inf)
        back[length] = 0
        for i in range(length - 1, -1, -1):
            for size in range(1, min(length - i, v.longest) + 1):
                np.maximum(back[i], scores[size - 1][i] + back[i + size], out=back[i])
        # the best path, from the end
        piece = np.full((length, n), -2, np.int32)
        at, rows = np.full(n, length), np.arange(n)
        flat_ids = np.full((min(length, v.longest) + 1, length, n), -1, np.int32)
        on = np.zeros_like(flat_ids, bool)
        for size, k in enumerate(ids, 1):
            flat_ids[size, : k.shape[0]] = k
        while len(rows):
            size = last[at, rows]
            start = at - size
            piece[start, rows] = flat_ids[size, start, rows]
            on[size, start, rows] = True
            at, keep = start, start > 0
            at, rows = at[keep], rows[keep]
        second = np.full(n, -np.inf)
        for size, s in enumerate(scores, 1):
            through = np.where(on[size, : s.shape[0]], -np.inf, ahead[: s.shape[0]] + s + back[size:])
            np.maximum(second, through.max(axis=0), out=second)
        total = ahead[length]
        for_chunk = np.ascontiguousarray(piece.T)
        used = for_chunk > -2
        self.keep(chunks, used.sum(axis=1), for_chunk[used], total, total - second)

    def segment_long(self, chunk: str) -> None:
        """The same for one long chunk, place after place."""
        text, v = chunk.replace(" ", SPACE), self.v
        into, ahead = lattice(v, text)
        size = len(text)
        back = [-np.inf] * size + [0.0]
        for j in range(size, 0, -1):
            for i, s, _ in into[j]:
                back[i] = max(back[i], s + back[j])
        ids, best, second, j = [], set(), -np.inf, size
        while j:
            i, _, k = next(e for e in into[j] if ahead[e[0]] + e[1] == ahead[j])  # edges begin with the longest piece
            ids.append(k)
            best.add((i, j))
            j = i
        for j in range(1, size + 1):
            for i, s, _ in into[j]:
                if (i, j) not in best:
                    second = max(second, ahead[i] + s + back[j])
        self.keep([chunk], np.array([len(ids)]), np.array(ids[::-1], np.int32), np.array([ahead[size]]), np.array([ahead[size] - second]))

    def keep(self, chunks: list[str], counts: np.ndarray, flat: np.ndarray, total: np.ndarray, loss: np.ndarray) -> None:
        v, n = self.v, len(chunks)
        if (flat == -1).any():
            ends = np.cumsum(counts)
            own = [v.spelled(flat[e - k : e].tolist(), c) for c, e, k in zip(chunks, ends.tolist(), counts.tolist(), strict=True)]
            counts = np.array([len(x) for x in own])
            flat = np.fromiter(chain.from_iterable(own), np.int32, counts.sum())
        self.number.update(zip(chunks, range(self.count.size, self.count.size + n), strict=True))
        self.start.add(self.ids.size + np.cumsum(counts) - counts)
        self.ids.add(flat)
        self.count.add(counts)
        self.score.add(total)
        self.loss.add(loss)

    def chunk_nbest(self, chunk: str) -> list[tuple[float, bytes]]:
        """The N best (score, ids) of a chunk: A* from the end, forward Viterbi scores being what a prefix can still add."""
        if chunk not in self.lists:
            self.lists[chunk] = [(s, np.array(self.v.spelled(k, chunk), np.int32).tobytes()) for s, k in a_star(self.v, chunk.replace(" ", SPACE), self.nbest)]
        return self.lists[chunk]

    def texts_nbest(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, bytes]]]]:
        """Best ids of all texts one after the other, where each ends, and each text's N best (score, ids), for texts cut into chunks."""
        self.learn(set(chain.from_iterable(cut)))
        sizes = np.array([len(c) for c in cut], np.int64)
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, sizes.sum())
        counts, loss, score = self.count.data[number], self.loss.data[number], self.score.data[number]
        ends = np.cumsum(counts)
        flat = self.ids.data[np.repeat(self.start.data[number] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        lasts = np.cumsum(sizes)
        where = np.concatenate(([0], ends))
        out = []
        for chunks, begin, end in zip(cut, (lasts - sizes).tolist(), lasts.tolist(), strict=True):
            a, b = where[begin], where[end]
            out.append(self.changed(chunks, flat[a:b], float(score[begin:end].sum()), loss[begin:end], where[begin : end + 1] - a) if chunks else [])
        return flat, where[lasts], out

    def changed(self, chunks: list[str], best: np.ndarray, score: float, loss: np.ndarray, where: np.ndarray) -> list[tuple[float, bytes]]:
        """The N best of a text: its best with other segmentations of the chunks that lose least."""
        chosen = smallest(loss, self.nbest - 1) if self.nbest > 1 else []
        options = [self.chunk_nbest(chunks[k]) for k in chosen]
        out = []
        for change, ranks in combined([[o[0][0] - x for x, _ in o] for o in options], self.nbest):
            parts, at = [], 0
            for k, o, r in zip(chosen, options, ranks, strict=True):
                if r:
                    parts += [best[at : where[k]].tobytes(), o[r][1]]
                    at = int(where[k + 1])
            out.append((score - change, b"".join([*parts, best[at:].tobytes()])))
        return out

def smallest(loss: np.ndarray, k: int) -> list[int]:
    """Places of the k smallest finite losses, in order of place; of equal ones the later."""
    finite = np.flatnonzero(np.isfinite(loss))
    if len(finite) > k:
        values = loss[finite]
        bound = np.partition(values, k - 1)[k - 1]
        under = finite[values < bound]
        return sorted([*under.tolist(), *finite[values == bound][len(under) - k :].tolist()])
    return finite.tolist()


def combined(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums with one loss (ascending, from 0) of each list; of equal sums the later change."""
    if not losses:
        return [(0.0, ())]
    start = (0,) * len(losses)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        total, ranks = heapq.heappop(heap)
        out.append((total, ranks))
        for k in range(len(losses)):
            if ranks[k] + 1 < len(losses[k]):
                new = (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (sum(x[r] for x, r in zip(losses, new, strict=True)), new))
    return out


def lattice(v: Vocabulary, text: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
    """Edges (start, score, id) into each place, the longest first, and the best score of each prefix."""
    size, ids, scores = len(text), v.ids, v.score_list
    into: list[list[tuple[int, float, int]]] = [[] for _ in range(size + 1)]
    ahead = [0.0] + [-np.inf] * size
    for j in range(1, size + 1):
        for i in range(max(0, j - v.longest), j):
            k = ids.get(text[i:j], -1)
            if k >= 0 or j - i == 1:
                s = scores[k] if k >= 0 else v.unknown_score
                into[j].append((i, s, k))
                if ahead[i] + s > ahead[j]:
                    ahead[j] = ahead[i] + s
    return into, ahead


def a_star(v: Vocabulary, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations (score, ids with -1 for a character that is no piece) of a text in which blanks are marks.

    What a hypothesis holds is its own piece and the hypothesis after it. Of equal bounds the one made last is next, and of those made together the one
    with the longest piece: a plateau is searched in depth, and the first result is the one that Viterbi prefers.
    """
    into, ahead = lattice(v, text)
    size = len(text)
    # (bound of the whole negated, order, place, own score, (id, hypothesis after it))
    heap: list = [(-ahead[size], 0, size, 0.0, None)]
    made, out = 0, []
    while heap and len(out) < n:
        _, _, at, own, chain_ = heapq.heappop(heap)
        if at == 0:
            ids = []
            while chain_:
                ids.append(chain_[0])
                chain_ = chain_[1]
            out.append((own, ids))
            continue
        for i, s, k in reversed(into[at]):  # the shortest piece is made first
            made -= 1
            heapq.heappush(heap, (-(ahead[i] + own + s), made, i, own + s, (k, chain_)))
    return out


def decode_ids(v: Vocabulary, ids) -> str:
    """The text of ids; ids of control pieces have none."""
    data = b"".join(map(v.bytes.__getitem__, ids))
    return (data[1:] if v.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


_segmenters: dict = {}


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, nbest: int = NBEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (best segmentation), n_tokens, score, round_trip, and nbest, the best segmentations in order: (score, n_tokens, ids_crc32, at,
    removed, put). A segmentation's ids are those of the best, with ``removed`` of them from ``at`` (counted from 0) on replaced by ``put``
    (``segmentations`` lists them whole); ids_crc32 is over the ids as 4-byte integers.

    ``round_trip`` says that the decoded ids are the text (blank marks in it read as blanks). Null and empty texts have no ids, no score and no
    segmentations. Repeated rows are encoded each; an empty table gives an empty result; further columns are not read.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    nested = pa.list_(pa.struct([("score", pa.float64()), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64()), ("at", pa.int32()), ("removed", pa.int32()), ("put", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        key = (id(v), nbest)
        if key not in _segmenters:
            _segmenters.clear()
            _segmenters[key] = Segmenter(v, nbest)
        s = _segmenters[key]
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < len(texts):
                end, size, some = at, 0, []
                while end < len(texts) and (end == at or size < TOGETHER):
                    some.append(texts[end].as_py())
                    size += len(some[-1] or "")
                    end += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *encoded(s, some, nested)], names=["id", "ids", "n_tokens", "score", "round_trip", "nbest"])
                at = end

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>, n_tokens int, score double, round_trip boolean, nbest array<struct<score: double, n_tokens: int, ids_crc32: bigint, at: int, removed: int, put: array<int>>>")
    return out.withColumnRenamed("id", id_col)


def encoded(s: Segmenter, texts: list[str | None], nested: pa.DataType) -> list[pa.Array]:
    cut = [s.v.chunks(t) if t else [] for t in texts]
    flat, ends, found = s.texts_nbest(cut)
    ends = np.concatenate(([0], ends)).astype(np.int32)
    trip = [decode_ids(s.v, flat[a:b].tolist()) == (t or "").replace(SPACE, " ") for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]
    many = [[{"score": x, "n_tokens": len(b) // 4, "ids_crc32": zlib.crc32(b), **change(f[0][1], b)} for x, b in f] for f in found]
    return [
        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
        pa.array(np.diff(ends), pa.int32()),
        pa.array([f[0][0] if f else None for f in found], pa.float64()),
        pa.array(trip),
        pa.array(many, nested),
    ]


def change(best: bytes, other: bytes) -> dict:
    """What makes ``other`` of ``best`` (4-byte ids): the place, how many ids go, and those that come."""
    if best == other:
        return {"at": 0, "removed": 0, "put": []}
    a, b = np.frombuffer(best, np.int32), np.frombuffer(other, np.int32)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    at = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + at :] != b[len(b) - n + at :])
    left = n - at - (int(differ[-1]) + 1 if len(differ) else 0)
    return {"at": at, "removed": len(a) - at - left, "put": b[at : len(b) - left].tolist()}


def segmentations(encoded_docs: DataFrame, out: str = "segmentations") -> DataFrame:
    """``encoded_docs`` with the ids of each of its best segmentations, whole."""
    whole = F.transform("nbest", lambda x: F.concat(F.slice("ids", 1, x["at"]), x["put"], F.slice("ids", x["at"] + x["removed"] + 1, F.size("ids"))))
    return encoded_docs.withColumn(out, whole)


def decode_documents(encoded_docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded_docs`` with the text of its ids; null ids have a null text, ids outside the vocabulary none."""
    ship(encoded_docs.sparkSession)
    sent = encoded_docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def decode(ids):
        v = sent.value
        return ids.map(lambda row: None if row is None else decode_ids(v, [k for k in row.tolist() if 0 <= k < len(v.bytes)]))

    return encoded_docs.withColumn(text_col, decode(F.col(ids_col)))
