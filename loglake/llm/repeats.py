"""Removal of passages that documents with smaller ids hold, by suffix arrays sorted in two stages.

Texts are UTF-8 bytes; a passage is any string of ``LENGTH`` bytes. Every byte goes that such a string covers which also starts in a document with a
smaller id; all is judged on the input, and matches never cross documents.

1. Equal texts are one: the row with the least id is looked at, its copies go whole (if they are long enough to hold a passage).
2. The passage at each byte is filed under the least hash of the short strings in it. Equal passages have equal keys, and neighbours share keys, so that
   a key a run of about eighteen passages is enough. Chunks of documents list their keys; keys that one document alone has are done with.
3. The other runs are cut out (as pieces) and dealt by key, equal ones of a chunk once. ``suffix_order`` sorts the suffixes of a block of pieces: those
   smaller than their successors directly, the rest induced from these by scans of the buckets of first bytes. ``common_prefixes`` of neighbours in that
   order tell equal passages apart from others, and the least document of each class is known.
4. What was found goes back to the chunks, where the bytes to go are joined to spans.

A key that very many pieces share (``HOT``: say, one line of a third of all documents, with other text around it each time) isn't sorted in one block:
each of its passages is a piece of its own there and dealt by its bytes.

Null texts are empty. Rows with a null id keep all and take nothing from others. Rows that share an id don't take from each other. An empty table gives
no rows. Ids are numbers. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.alignment import bounds
from loglake.llm.shared import release_table, shared_dir, ship, stored

LENGTH = 50
#: Bytes of the short strings that keys are made of.
SHORT = 24
#: Passages of a piece at most, bytes of a block of pieces, pieces that one key may send to a block.
RUN, BLOCK, HOT = 64, 2 << 20, 4096
#: Bytes of a chunk of documents and of what is hashed at once; keys of a list's bucket; most files that chunks are dealt to.
CHUNK, STEP, BUCKET, FILES = 8 << 20, 1 << 20, 1 << 20, 50_000
#: Bytes of text that send their pieces to one task.
SORTED = 16 << 20
#: Bits by which keys are compared in a bucket; another key that looks the same costs work, not right results.
BITS = 40
#: Bytes of a sort key: seven values of nine bits, so that the end of a piece is less than any byte.
WORD = 7

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LETTERS = np.random.default_rng(20240512).integers(0, 1 << 64, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, width: int = SHORT) -> np.ndarray:
    """Mixed polynomial hashes of all strings of ``width`` bytes, put together from strings of powers of two."""
    with np.errstate(over="ignore"):
        block, factor, size = LETTERS[data], MULTIPLIER, 1
        out, done = None, 0
        while True:
            if width & size:
                out = block if out is None else block[: len(block) - done] * out_factor + out[size:] if done else block
                out_factor = factor if not done else out_factor * factor
                done += size
            if done == width:
                return mixed(out[: len(data) - width + 1])
            block = block[: len(block) - size] * factor + block[size:]
            factor = factor * factor
            size *= 2


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size, out = 1, h
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(h) - width + 1], out[width - size : width - size + len(h) - width + 1]) if width > size else out


def runs(data: np.ndarray, at: np.ndarray, length: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, end, key) of runs of passages with one key, for documents one after another (``at``: bounds); passages are told by their starts."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        key = least_of(hashes(data, short), length - short + 1)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(key)]
    inside = np.arange(len(key)) + length <= at[of + 1]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(~inside[1:] | new[1:], True)) + 1
    size = stop - first
    parts = -(-size // RUN)  # a run without end (the same byte again and again) is cut
    which = np.repeat(np.arange(len(first)), parts)
    k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    first, stop = first[which] + k * RUN, np.minimum(first[which] + (k + 1) * RUN, stop[which])
    return of[first], first, stop, mixed(key[first])  # the least of several are not spread evenly until mixed again


def contents(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the strings data[first:stop]."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.append(np.uint64(1), np.full(len(data), MULTIPLIER)))
        back = np.cumprod(np.append(np.uint64(1), np.full(len(data), INVERSE)))
        total = np.append(np.uint64(0), np.cumsum(LETTERS[data] * power[:-1]))
        return mixed((total[stop] - total[first]) * back[first])


def steps(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Texts joined to about ``STEP`` bytes: data, bounds, (text, offset) of each part. A long text is cut into parts that overlap by a passage less a byte."""
    parts, size = [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 1), STEP):
            part = t[a : a + STEP + length - 1]
            parts.append((part, k, a))
            size += len(part)
            if size >= STEP:
                yield joined(parts)
                parts, size = [], 0
    if parts:
        yield joined(parts)


def joined(parts: list[tuple[bytes, int, int]]):
    data = np.frombuffer(b"".join(p for p, _, _ in parts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(p) for p, _, _ in parts])])
    return data, at, [(k, a) for _, k, a in parts]


def kinds(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is larger than its successor; equal neighbours take after the first place to their right where they differ."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    larger = np.append(text[:-1] > text[1:], False)
    following = np.where(differs, np.arange(n), n - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    return larger[following] & (text > 0)


def words(text: np.ndarray, places: np.ndarray, offset: int) -> np.ndarray:
    """Sort keys: the ``WORD`` values from each place plus offset on, nothing beyond the end."""
    out = np.zeros(len(places), np.uint64)
    for j in range(WORD):
        at = np.minimum(places + (offset + j), len(text) - 1)
        out = (out << np.uint64(9)) | text[at].astype(np.uint64)
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in order, by ``depth`` values at least; zeros are ends of pieces and less than all else.

    Stage one sorts those that are smaller than their successors, by words of seven values, going on only with what is not told apart yet. Stage two goes
    through the buckets of first values in order: a bucket begins with suffixes larger than their successors, and these have been found when
    the buckets before were read, in waves for successors in the same bucket.
    """
    n = len(text)
    large = kinds(text)
    small = np.flatnonzero(~large)
    key = words(text, small, 0)
    order = np.argsort(key, kind="stable")
    small, key = small[order], key[order]
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))
    for offset in range(WORD, depth, WORD):
        tied = np.zeros(len(small), bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = words(text, small[at], offset)
        order = np.lexsort((key, group[at]))
        small[at] = small[at][order]
        key, own = key[order], group[at]
        step = np.zeros(len(small), np.int64)
        step[at[1:]] = (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        group = group + np.cumsum(step)
    first = text[small]
    begin = np.searchsorted(first, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(places: np.ndarray) -> np.ndarray | None:
        """Files the predecessors that are larger under their first values; those of the bucket itself are its next wave."""
        before = places[places > 0] - 1
        before = before[large[before]]
        values = text[before]
        order = np.argsort(values, kind="stable")
        before, values = before[order], values[order]
        own = None
        cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else []
        for a, b in zip(cuts, [*cuts[1:], len(values)]):
            if values[a] == c:
                own = before[a:b]
            else:
                waiting[values[a]].append(before[a:b])
        return own

    for c in range(257):
        wave = np.concatenate(waiting[c]) if waiting[c] else None
        while wave is not None and len(wave):
            out.append(wave)
            wave = induce(wave)
        rest = small[begin[c] : begin[c + 1]]
        if len(rest):
            out.append(rest)
            induce(rest)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Values that each suffix shares with the one before it in order, ``depth`` at most; the first shares none."""
    shared = np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    for offset in range(0, depth, WORD):
        mine, other = words(text, order[going], offset), words(text, order[going - 1], offset)
        differ = mine ^ other
        same = differ == 0
        shared[going[same]] = min(offset + WORD, depth)
        part = going[~same]
        lead = np.zeros(len(part), np.int64)
        rest = differ[~same]
        for j in range(WORD - 1, 0, -1):  # so many values from the left are the same
            lead[(lead == 0) & (rest >> np.uint64(9 * (WORD - j)) == 0)] = j
        shared[part] = np.minimum(offset + lead, depth)
        going = going[same]
    return shared


def classes(data: np.ndarray, at: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each passage of the pieces (one after another, ``at``: bounds) its piece and the least owner of any piece that holds the passage."""
    sizes = np.diff(at)
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(len(of), np.uint16)
    text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data.astype(np.uint16) + np.uint16(1)
    order = suffix_order(text, length)
    whole = ends[of] - np.arange(len(text)) >= length
    order = order[whole[order]]
    new = common_prefixes(text, order, length) < length
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(owners[of[order]], starts) if len(starts) else owners[:0]
    out = np.empty(len(text), owners.dtype)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    held = np.flatnonzero(whole)
    return of[held], out[held]


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising numbers of ``BITS`` bits as differences, byte planes apart."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(BITS // 8, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : BITS // 8] = planes.T
    return np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64)


def cuts(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where stretches of one value begin and end."""
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist() if len(values) else []
    return begins, [*begins[1:], len(values)] if begins else []


class Chunk:
    """Texts of a chunk, one after another, in the order of their rows, with runs as they are asked for."""

    def __init__(self, rows: np.ndarray, docs: np.ndarray, texts: list[str], length: int, short: int):
        order = np.argsort(rows, kind="stable")
        self.rows, self.docs, self.length, self.short = rows[order], docs[order], length, short
        self.texts = [texts[k].encode() for k in order.tolist()]
        self.at = bounds([len(t) for t in self.texts])

    def runs(self) -> Iterator[tuple]:
        """(text, first place in the chunk, passages, key, content) of runs, a step's at a time."""
        for data, at, parts in steps(self.texts, self.length):
            of, first, stop, key = runs(data, at, self.length, self.short)
            which, offset = np.array([k for k, _ in parts]), np.array([a for _, a in parts])
            yield which[of], self.at[which[of]] + offset[of] + first - at[of], stop - first, key, data, first

    def pieces(self, wanted: np.ndarray, hot: np.ndarray, shift: int, buckets: int) -> dict:
        """Runs whose keys (shifted) are wanted, hot ones passage by passage; equal pieces are numbered once, by bucket."""
        every = []
        for of, place, size, key, data, first in self.runs():
            near = np.minimum(np.searchsorted(wanted, key >> np.uint64(shift)), len(wanted) - 1)
            held = wanted[near] == key >> np.uint64(shift)
            of, place, size, key, first, split = of[held], place[held], size[held], key[held], first[held], hot[near[held]]
            times = np.where(split, size, 1)
            lane = np.repeat(np.arange(len(of)), times)
            inner = np.arange(len(lane)) - np.repeat(np.cumsum(times) - times, times)
            of, place, first, split = of[lane], place[lane] + inner, first[lane] + inner, split[lane]
            size = np.where(split, 1, size[lane])
            content = contents(data, first, first + size + self.length - 1)
            every.append((of, place, size, np.where(split, content, key[lane]), content, split))
        of, place, size, key, content, split = (np.concatenate(c) for c in zip(*every))
        bucket = ((mixed(key) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) + np.where(split, buckets, 0)
        order = np.lexsort((size, content, key, bucket))
        of, place, size, key, content, bucket = (c[order] for c in (of, place, size, key, content, bucket))
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (size[1:] != size[:-1])) if len(of) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        owner = self.docs[of]
        found = {"of": of, "place": place, "piece": np.cumsum(new) - 1, "bucket": bucket[starts], "start": place[starts], "size": size[starts] + self.length - 1}
        if len(starts):
            found |= {"lo": np.minimum.reduceat(owner, starts), "hi": np.maximum.reduceat(owner, starts)}
        return found


def key_lists(texts: DataFrame, bits: int, length: int, short: int) -> DataFrame:
    """(bucket, of, keys, held): per chunk its keys by bucket, with the pieces that have the key (twice the number, plus one if several documents have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for name in np.unique(chunks):  # rows of a chunk that come in two batches give two lists
                at = np.flatnonzero(chunks == name)
                chunk = Chunk(at, batch.column(1).to_numpy()[at], [batch.column(2)[int(k)].as_py() for k in at], length, short)
                parts = [(key >> np.uint64(24 - bits), contents(data, first, first + size + length - 1), chunk.docs[of]) for of, _, size, key, data, first in chunk.runs()]
                key, content, owner = (np.concatenate(c) for c in zip(*parts))
                if not len(key):
                    continue
                order = np.lexsort((content, key))
                key, content, owner = key[order], content[order], owner[order]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
                pieces = np.add.reduceat(np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])).astype(np.int64), starts)
                held = (2 * np.minimum(pieces, 1 << 14) + several).astype("<u2")
                key = key[starts]
                bucket = (key >> np.uint64(BITS)).astype(np.int32)
                rest = key & np.uint64((1 << BITS) - 1)
                begins, ends = cuts(bucket)
                lists = [pa.array(bucket[begins]), pa.array(np.full(len(begins), name)), pa.array([pack_keys(rest[a:b]) for a, b in zip(begins, ends)], pa.binary()), pa.array([held[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())]
                yield pa.RecordBatch.from_arrays(lists, names=["bucket", "of", "keys", "held"])

    return texts.select("chunk", "doc", "text").mapInArrow(run, "bucket int, of bigint, keys binary, held binary")


def shared_keys(lists: DataFrame) -> DataFrame:
    """(of, bucket, keys, held): what is left of each list are the keys that several documents have; held tells which of them are hot."""

    def meet(table: pa.Table) -> pa.Table:
        lists = [unpack_keys(k) for k in table.column("keys").to_pylist()]
        held = np.concatenate([np.frombuffer(h, "<u2") for h in table.column("held").to_pylist()]).astype(np.int64)
        place = np.repeat(np.arange(len(lists)), [len(k) for k in lists])
        key = np.concatenate(lists)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        size = np.diff(np.append(starts, len(key)))
        several = (size > 1) | (np.maximum.reduceat(held[order] & 1, starts) > 0)
        many = np.add.reduceat(held[order] >> 1, starts) > HOT
        keep, hot = np.empty(len(key), bool), np.empty(len(key), bool)
        keep[order], hot[order] = np.repeat(several, size), np.repeat(many, size)
        key, place, hot = key[keep], place[keep], hot[keep]
        begins, ends = cuts(place)
        rows = place[begins]
        return pa.table([table.column("of").take(pa.array(rows)), table.column("bucket").take(pa.array(rows)), pa.array([pack_keys(key[a:b]) for a, b in zip(begins, ends)], pa.binary()), pa.array([np.packbits(hot[a:b]).tobytes() for a, b in zip(begins, ends)], pa.binary())], names=["of", "bucket", "keys", "held"])

    return lists.groupBy("bucket").applyInArrow(meet, "of bigint, bucket int, keys binary, held binary")


def wanted_keys(lists: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Shifted keys of a chunk, rising, and which are hot."""
    keys, hot = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    for bucket, k, h in zip(lists.column("bucket").to_pylist(), lists.column("keys").to_pylist(), lists.column("held").to_pylist(), strict=True):
        keys.append(unpack_keys(k) + (np.uint64(bucket) << np.uint64(BITS)))
        hot.append(np.unpackbits(np.frombuffer(h, np.uint8), count=len(keys[-1])).astype(bool))
    key, hot = np.concatenate(keys), np.concatenate(hot)
    order = np.argsort(key, kind="stable")
    return key[order], hot[order]


def chunk_of(left: pa.Table, length: int, short: int) -> Chunk:
    return Chunk(left.column("row").to_numpy(), left.column("doc").to_numpy(), left.column("text").to_pylist(), length, short)


def squeeze(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), "zstd", asbytes=True)


def cut_pieces(texts: DataFrame, keys: DataFrame, bits: int, buckets: int, length: int, short: int) -> DataFrame:
    """(sorter, of, n, size, pieces): a chunk's pieces for a sorting task: sizes, least and largest documents, bytes."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        wanted, hot = wanted_keys(right)
        if len(wanted) and left.num_rows:
            chunk = chunk_of(left, length, short)
            x = chunk.pieces(wanted, hot, 24 - bits, buckets)
            text = np.frombuffer(b"".join(chunk.texts), np.uint8)
            for a, b in zip(*cuts(x["bucket"])):
                size, start = x["size"][a:b], x["start"][a:b]
                data = text[np.repeat(start - bounds(size)[:-1], size) + np.arange(size.sum())]
                rows.append((int(x["bucket"][a]), b - a, len(data), squeeze(size.astype("<u2"), x["lo"][a:b], x["hi"][a:b], data)))
        name = left.column("chunk")[0].as_py() if left.num_rows else None
        cols = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip([cols[0], [name] * len(rows), *cols[1:]], kinds, strict=True)], names=["sorter", "of", "n", "size", "pieces"])

    return texts.groupBy("chunk").cogroup(keys.groupBy("of")).applyInArrow(cut, "sorter int, of bigint, n bigint, size bigint, pieces binary")


def earlier_passages(pieces: DataFrame, length: int, short: int) -> DataFrame:
    """(of, sorter, n, found): for a chunk's pieces the runs of passages (piece, first, end, least document) that a document less than one of the piece's has."""

    def sort(table: pa.Table) -> pa.Table:
        sizes, lo, hi, data, of = [], [], [], [], []
        for k, (n, size, blob) in enumerate(zip(*(table.column(c).to_pylist() for c in ("n", "size", "pieces")), strict=True)):
            raw = pa.decompress(blob, 18 * n + size, "zstd")
            sizes.append(np.frombuffer(raw, "<u2", n).astype(np.int64))
            lo.append(np.frombuffer(raw, np.int64, n, 2 * n))
            hi.append(np.frombuffer(raw, np.int64, n, 10 * n))
            data.append(np.frombuffer(raw, np.uint8, size, 18 * n))
            of.append(np.full(n, k))
        size, lo, hi, data, of = (np.concatenate(c) for c in (sizes, lo, hi, data, of))
        at = bounds(size)
        key = np.empty(len(size), np.uint64)
        content = np.empty(len(size), np.uint64)
        hot = table.column("hot")[0].as_py()
        for a, b in stretches(at, STEP):
            part, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
            content[a:b] = contents(part, own[:-1], own[1:])
            key[a:b] = content[a:b] if hot else least_of(hashes(part, short), length - short + 1)[own[:-1]]
        order = np.lexsort((size, content, key))  # equal pieces of several chunks are sorted once
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1]) | (size[order][1:] != size[order][:-1]))
        starts = np.flatnonzero(new)
        one, least, most = order[starts], np.minimum.reduceat(lo[order], starts), np.maximum.reduceat(hi[order], starts)
        alike = np.empty(len(size), np.int64)
        alike[order] = np.cumsum(new) - 1
        found = []
        fresh = np.append(True, key[one][1:] != key[one][:-1])
        for a, b in stretches(bounds(size[one] + 1), BLOCK, fresh):
            own = bounds(size[one[a:b]])
            text = data[np.repeat(at[one[a:b]] - own[:-1], size[one[a:b]]) + np.arange(own[-1])]
            piece, by = classes(text, own, least[a:b], length)
            begin = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (by[1:] != by[:-1])))
            zero = np.searchsorted(piece, piece[begin])
            end = np.append(begin[1:], len(piece))
            keep = by[begin] < most[a:b][piece[begin]]
            found.append(np.stack([piece[begin] + a, begin - zero, end - zero, by[begin]])[:, keep])
        found = np.concatenate(found, axis=1)
        span = np.searchsorted(found[0], np.arange(len(starts) + 1))
        rows = []
        for k, (a, b) in enumerate(zip(bounds(np.bincount(of))[:-1].tolist(), bounds(np.bincount(of))[1:].tolist())):
            mine = alike[a:b]
            times = span[mine + 1] - span[mine]
            lane = np.repeat(np.arange(b - a), times)
            at_run = np.repeat(span[mine] - (np.cumsum(times) - times), times) + np.arange(len(lane))
            keep = found[3][at_run] < hi[a:b][lane]
            if keep.any():
                rows.append((k, int(keep.sum()), squeeze(lane[keep].astype("<i4"), *(found[j][at_run[keep]].astype(t) for j, t in ((1, "<u1"), (2, "<u1"), (3, "<i8"))))))
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.table([table.column("of").take(pa.array(cols[0], pa.int64())), table.column("sorter").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["of", "sorter", "n", "found"])

    return pieces.groupBy("sorter").applyInArrow(sort, "of bigint, sorter int, n bigint, found binary")


def stretches(at: np.ndarray, size: int, fresh: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Items from one to another that are about ``size`` bytes, given their bounds; cut only before items that are fresh."""
    n, a = len(at) - 1, 0
    open_at = np.arange(n + 1) if fresh is None else np.append(np.flatnonzero(fresh), n)
    while a < n:
        b = int(open_at[min(np.searchsorted(open_at, max(int(np.searchsorted(at, at[a] + size, side="right")) - 1, a + 1)), len(open_at) - 1)])
        yield a, b
        a = b


def without_spans(texts: DataFrame, told: DataFrame, bits: int, buckets: int, length: int, short: int) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256) of the texts; told: keys (n is null) and what was found, by chunk."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left, length, short)
        answers = right.filter(pc.is_valid(right.column("n")))
        cover = np.zeros(int(chunk.at[-1]) + 1, np.int32)
        if answers.num_rows:
            x = chunk.pieces(*wanted_keys(right.filter(pc.is_null(right.column("n")))), 24 - bits, buckets)
            first = np.searchsorted(x["bucket"], answers.column("sorter").to_numpy())
            parts = []
            for base, n, blob in zip(first.tolist(), answers.column("n").to_pylist(), answers.column("found").to_pylist(), strict=True):
                raw = pa.decompress(blob, 14 * n, "zstd")
                parts.append((np.frombuffer(raw, "<i4", n) + base, np.frombuffer(raw, "<u1", n, 4 * n), np.frombuffer(raw, "<u1", n, 5 * n), np.frombuffer(raw, "<i8", n, 6 * n)))
            piece, a, b, least = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(piece, kind="stable")
            piece, a, b, least = piece[order], a[order].astype(np.int64), b[order].astype(np.int64), least[order]
            span = np.searchsorted(piece, np.arange(len(x["bucket"]) + 1))
            times = span[x["piece"] + 1] - span[x["piece"]]
            lane = np.repeat(np.arange(len(times)), times)
            run = np.repeat(span[x["piece"]] - (np.cumsum(times) - times), times) + np.arange(len(lane))
            gone = least[run] < chunk.docs[x["of"][lane]]
            place, run = x["place"][lane[gone]], run[gone]
            np.add.at(cover, place + a[run], 1)
            np.add.at(cover, place + b[run] - 1 + length, -1)
        removed = np.cumsum(cover[:-1]) > 0
        keys = dict(zip(left.column("row").to_pylist(), left.column("key").to_pylist(), strict=True))
        out = []
        for k, (row, text) in enumerate(zip(chunk.rows.tolist(), chunk.texts, strict=True)):
            mine = removed[chunk.at[k] : chunk.at[k + 1]]
            n = int(mine.sum())
            kept = np.frombuffer(text, np.uint8)[~mine].tobytes() if n else text
            out.append((keys[row], n, int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) if out else [[] for _ in range(4)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["key", "n_removed", "n_spans", "kept_sha256"])

    return texts.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(apply, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay)."""
    if not short < length <= 256 - RUN:
        raise ValueError("short strings are shorter than passages, and a piece of these has less than 256 bytes")
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = stored(docs.select("id", "doc", F.octet_length("text").cast("bigint").alias("n_bytes"), F.unhex(F.md5("text")).alias("key"), F.sha2("text", 256).alias("sha")), "rows")
    firsts = stored(base.filter(f"doc is not null and n_bytes >= {length}").groupBy("key").agg(F.min("doc").alias("doc"), F.first("n_bytes").alias("n_bytes")), "firsts")
    total = firsts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    chunks = max(1, -(-total // CHUNK))
    files = max(1, min(FILES, -(-chunks // 2)))
    chunk = F.pmod(F.xxhash64("doc", "key"), F.lit(chunks).cast("bigint")).alias("chunk")
    # texts meet their marks in an aggregation that the one shuffle by chunk serves, too; a join would move them once more
    marks = firsts.select(chunk, "doc", "key", F.lit(None).cast("string").alias("text"), F.lit(True).alias("first"))
    every = docs.filter("doc is not null").select("doc", F.unhex(F.md5("text")).alias("key"), "text").select(chunk, "doc", "key", "text", F.lit(False).alias("first"))
    met = every.union(marks).repartition(files, "chunk").groupBy("chunk", "doc", "key").agg(F.max("text").alias("text"), F.max("first").alias("first"))
    chunked = met.filter("first").select("chunk", "doc", "key", "text", F.monotonically_increasing_id().alias("row"))
    name = f"loglake_{uuid.uuid4().hex}"
    # files are told apart by chunk, so that what chunks ask for and get comes to the texts, which move no more
    chunked.write.bucketBy(files, "chunk").sortBy("chunk").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    texts = spark.table(name)
    bits = min(24, max(0, (2 * total // ((length - short + 2) * BUCKET)).bit_length()))
    sorters = max(1, -(-total // SORTED))
    keys = stored(shared_keys(key_lists(texts, bits, length, short)), "keys")
    pieces = cut_pieces(texts, keys, bits, sorters, length, short).withColumn("hot", F.col("sorter") >= sorters)
    found = earlier_passages(pieces, length, short)
    nothing = F.lit(None)
    told = keys.select("of", "bucket", "keys", "held", nothing.cast("int").alias("sorter"), nothing.cast("bigint").alias("n"), nothing.cast("binary").alias("found")).union(
        found.select("of", nothing.cast("int"), nothing.cast("binary"), nothing.cast("binary"), "sorter", "n", "found")
    )
    left = without_spans(spark.table(name), told, bits, sorters, length, short)
    result = stored(left.join(firsts.withColumnRenamed("doc", "first").drop("n_bytes"), "key"), "removed")
    release_table(spark, name)
    whole = F.col("doc") > F.col("first")
    own = F.col("doc") == F.col("first")
    return base.join(result, "key", "left").select(
        F.col("id").cast(kind).alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).when(own, F.col("n_removed")).otherwise(F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).when(own, F.col("n_spans")).otherwise(F.lit(0)).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
