"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

A line's features are shares and counts (letter case, symbols, repeated words, ...), cut into bins; those of its neighbours count too. Forward-backward
gives each line's marginal probability of being good; the mean over lines, weighted by length, is the document's raw quality, and a logistic curve
fitted on the same training documents turns it into the probability of the label.

Labels are known for documents only: all lines first get their document's label, and after a first fit the lines of bad documents that look good are
relabelled good for a second fit. The sample for fitting is bounded (``TRAIN_DOCS``, ``TRAIN_LINES``), everything else covers all documents.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.shared import ship

#: At most so many labelled documents (those of the least seeded hash), and of these so many that their lines stay below the second bound.
TRAIN_DOCS, TRAIN_LINES = 6000, 400_000
FOLDS = 5

FEATURES = ("length", "words", "word_length", "upper", "symbols", "symbol_runs", "pipes", "exclaim", "digits", "adjacent", "distinct", "ends", "again", "position", "document")
# Upper edges of each feature's bins.
EDGES = {
    "length": (5, 20, 60, 200, 800),
    "words": (1, 3, 8, 30, 120),
    "word_length": (2.5, 4, 6, 8, 12),
    "upper": (0.02, 0.1, 0.3, 0.6, 0.9),
    "symbols": (0.001, 0.01, 0.05, 0.15, 0.4),
    "symbol_runs": (0.001, 0.05, 0.2, 0.5, 0.8),
    "pipes": (0.001, 0.05, 0.2, 0.4, 0.6),
    "exclaim": (0.001, 0.05, 0.2, 0.5, 0.8),
    "digits": (0.001, 0.02, 0.1, 0.3, 0.6),
    "adjacent": (0.001, 0.02, 0.1, 0.4, 0.8),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
    "ends": (0.5,),
    "again": (0.5,),
    "position": (0.001, 0.1, 0.5, 0.9),
    "document": (40, 150, 600, 3000, 20000),
}
BINS = 6
WIDTH = len(FEATURES) * BINS

# Classes of bytes: bit 0 upper-case letter, 1 letter, 2 symbol, 3 pipe, 4 exclamation mark, 5 digit.
CLASSES = np.zeros(256, np.uint8)
CLASSES[65:91] |= 3
CLASSES[97:123] |= 2
CLASSES[128:] |= 2
CLASSES[48:58] |= 32
for _c in b"#$%&*+<=>@[\\]^_`{|}~":
    CLASSES[_c] |= 4
CLASSES[ord("|")] |= 8
CLASSES[ord("!")] |= 16


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins (lines x features, uint8) and lengths of a text's lines that hold a word; the whole text is read."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.empty((0, len(FEATURES)), np.uint8), np.empty(0, np.int32)
    n = len(lines)
    data = np.frombuffer("\n".join(lines).encode("utf-8", "replace") + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    kinds = CLASSES[data]
    runs = (data[1:] == data[:-1]) & ((kinds[1:] & 20) > 0)
    runs[1:] &= ~runs[:-1]
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int32).astype(np.float64)
    size = (ends - starts).astype(np.float64)
    raw = np.empty((n, len(FEATURES)))
    letters = np.maximum(count((kinds & 2) > 0), 1)
    seen: dict[str, int] = {}
    words = np.empty((n, 3))
    for k, line in enumerate(lines):
        parts = line.split()
        words[k] = len(parts), sum(map(operator.eq, parts, parts[1:])), len(set(parts))
        seen[line] = seen.get(line, 0) + 1
    many = np.maximum(words[:, 0], 1)
    raw[:, 0] = size
    raw[:, 1] = words[:, 0]
    raw[:, 2] = size / many
    raw[:, 3] = count((kinds & 1) > 0) / letters
    raw[:, 4] = count((kinds & 4) > 0) / np.maximum(size, 1)
    raw[:, 5] = count(np.append(runs, False)) / many
    raw[:, 6] = count((kinds & 8) > 0) / many
    raw[:, 7] = count((kinds & 16) > 0) / many
    raw[:, 8] = count((kinds & 32) > 0) / np.maximum(size, 1)
    raw[:, 9] = words[:, 1] / np.maximum(words[:, 0] - 1, 1)
    raw[:, 10] = words[:, 2] / many
    raw[:, 11] = np.isin(data[np.maximum(ends - 1, 0)], np.frombuffer(b".!?:\"", np.uint8))
    raw[:, 12] = [seen[x] > 1 for x in lines]
    raw[:, 13] = np.arange(n) / n
    raw[:, 14] = len(data) - 1
    return np.stack([np.searchsorted(EDGES[f], raw[:, k], side="left") for k, f in enumerate(FEATURES)], axis=1).astype(np.uint8), size.astype(np.int32)


@dataclass
class Sequences:
    """Lines of many documents one after the other, with what takes one step along all documents at once."""

    bins: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[np.ndarray, np.ndarray]]) -> Sequences:
        counts = np.array([len(s) for _, s in found])
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        return cls(np.concatenate([b for b, _ in found]), np.concatenate([s for _, s in found]), starts, counts)

    def codes(self) -> np.ndarray:
        """Indices of the weights that a line's own bins and those of the line before and after pick; a missing neighbour picks the last weight."""
        own = self.bins.astype(np.int32) + np.arange(len(FEATURES), dtype=np.int32) * BINS
        first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
        full = self.counts > 0
        first[self.starts[full]] = True
        last[self.starts[full] + self.counts[full] - 1] = True
        before, after = np.roll(own, 1, axis=0) + WIDTH, np.roll(own, -1, axis=0) + 2 * WIDTH
        before[first], after[last] = 3 * WIDTH, 3 * WIDTH
        return np.concatenate((own, before, after), axis=1)

    def steps(self) -> list[np.ndarray]:
        """Indices of the t-th lines of all documents that have one."""
        order = np.argsort(-self.counts, kind="stable")
        starts, counts = self.starts[order], self.counts[order]
        return [starts[: np.searchsorted(-counts, -t, side="left")] + t for t in range(int(counts[0]) if len(counts) else 0)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return self.weights[codes].sum(axis=1) + self.bias


def marginals(emission: np.ndarray, steps: list[np.ndarray], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the mean use of each pair of states; emission is the log-odds of good (state 1). Forward-backward over all documents."""
    local = np.stack((np.zeros_like(emission), emission), axis=1)
    ahead, back = np.zeros_like(local), np.zeros_like(local)
    for t, at in enumerate(steps):
        ahead[at] = local[at]
        if t:
            a = ahead[at - 1][:, :, None] + moves
            ahead[at] += np.logaddexp(a[:, 0], a[:, 1])
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t]
        b = (back[at] + local[at])[:, None, :] + moves
        back[at - 1] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    total = ahead + back
    good = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
    pairs = np.zeros((2, 2))
    z = np.logaddexp(total[:, 0], total[:, 1])
    for at in steps[1:]:
        pairs += np.exp(ahead[at - 1][:, :, None] + moves + (local[at] + back[at])[:, None, :] - z[at][:, None, None]).sum(axis=0)
    return good, pairs


def fit_lines(rows: Sequences, state: np.ndarray, rounds: int = 120) -> Model:
    """Maximum likelihood by Adam; ``state`` has each line's label."""
    codes, steps = rows.codes(), rows.steps()
    size = 3 * WIDTH + 1
    prior = np.clip(state.mean(), 0.01, 0.99)
    x = np.zeros(size + 5)
    x[size] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(x), np.zeros_like(x)
    seen = np.zeros((2, 2))
    for at in steps[1:]:
        np.add.at(seen, (state[at - 1].astype(int), state[at].astype(int)), 1)
    flat = codes.ravel()
    for k in range(1, rounds + 1):
        model = Model(x[:size], x[size], x[size + 1 :].reshape(2, 2))
        good, pairs = marginals(model.emissions(codes), steps, model.moves)
        error = (good - state) / len(state)
        grad = np.concatenate((np.bincount(flat, np.repeat(error, codes.shape[1]), size), [error.sum()], (pairs - seen).ravel() / len(state)))
        grad[:size] += 1e-5 * x[:size]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x = x - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(x[:size], float(x[size]), x[size + 1 :].reshape(2, 2))


def raw_quality(rows: Sequences, model: Model) -> np.ndarray:
    """Length-weighted mean of the lines' marginals per document; 0 without lines."""
    if not len(rows.sizes):
        return np.zeros(len(rows.counts))
    good, _ = marginals(model.emissions(rows.codes()), rows.steps(), model.moves)
    sums = lambda x: np.concatenate(([0.0], np.cumsum(x)))
    a, b = sums(good * rows.sizes), sums(rows.sizes.astype(float))
    ends = rows.starts + rows.counts
    return (a[ends] - a[rows.starts]) / np.maximum(b[ends] - b[rows.starts], 1)


def scores(raw: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-(model.slope * logits(raw) + model.shift)))


def fit(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """``labels``: 1 for good documents. Without labels of both kinds the model is constant."""
    full = np.array([len(s) > 0 for _, s in found], bool)
    found, labels = [x for x, f in zip(found, full, strict=True) if f], labels[full]
    if not len(labels) or labels.min() == labels.max():
        sure = 30.0 * (2 * (labels[0] if len(labels) else 1) - 1)
        return Model(np.zeros(3 * WIDTH + 1), sure, np.zeros((2, 2)))
    rows = Sequences.of(found)
    of_line = np.repeat(labels, rows.counts).astype(float)
    first = fit_lines(rows, of_line, 60)
    good, _ = marginals(first.emissions(rows.codes()), rows.steps(), first.moves)
    model = fit_lines(rows, np.where((of_line == 0) & (good > 0.7), 1.0, of_line))
    logit = logits(raw_quality(rows, model))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method for the logistic curve, drawn towards slope 1
        p = 1 / (1 + np.exp(-(a * logit + b)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - labels) * logit).sum() + (a - 1), (p - labels).sum()])
        hess = np.array([[(w * logit**2).sum() + 1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = max(a - step[0], 0.05), b - step[1]
    model.slope, model.shift = float(a), float(b)
    return model


def logits(raw: np.ndarray) -> np.ndarray:
    return np.log(np.clip(raw, 1e-3, 1 - 1e-3) / np.clip(1 - raw, 1e-3, 1 - 1e-3))


def fold(id_col):
    """crc32 of the id as text modulo ``FOLDS``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on labelled documents outside the held-out fold: at most ``TRAIN_DOCS``, in the order of a seeded hash, until they hold ``TRAIN_LINES`` lines
    (the draw doesn't look at lengths; the document that would pass the bound gives a run of its lines). An id with several labels has their mean, at least 0.5 being good; null labels don't count."""
    ship(docs.sparkSession)
    judged = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    chosen = judged.filter(fold(F.col("_id")) != 0).orderBy(F.xxhash64(F.lit(7), "_id"), "_id").limit(TRAIN_DOCS)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_text is not null")
    sample = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["id", "label", "bins", "sizes"])

    rows = sample.mapInArrow(run, "id string, label int, bins binary, sizes binary").orderBy(F.xxhash64(F.lit(7), "id"), "bins").limit(TRAIN_DOCS)
    found, y, lines = [], [], 0
    for r in rows.toLocalIterator():
        bins, sizes = np.frombuffer(r["bins"], np.uint8).reshape(-1, len(FEATURES)), np.frombuffer(r["sizes"], np.int32)
        left = TRAIN_LINES - lines
        if len(sizes) > left:  # the last document of the draw: a run of its lines from a seeded place
            at = int(np.random.default_rng(lines).integers(0, len(sizes) - left + 1))
            bins, sizes = bins[at : at + left], sizes[at : at + left]
        lines += len(sizes)
        found.append((bins, sizes))
        y.append(r["label"])
        if lines >= TRAIN_LINES:
            break
    return fit(found, np.array(y))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted (which replace columns of these names).

    Texts that are null, empty or without a word score 0 where the model has both labels. Repeated rows are scored each; an empty table gives an empty
    result. Only the text is an input of the score.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        values = texts.tolist()
        for at in range(0, len(values), 2000):
            found = [line_features(x or "") for x in values[at : at + 2000]]
            rows = Sequences.of(found)
            result = scores(raw_quality(rows, model), model)
            result[rows.counts == 0] = 0.0
            out[at : at + 2000] = result
        return pd.Series(out)

    scored = docs.withColumn("held_out", fold(F.col(id_col)) == 0).withColumn("score", score(F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
