"""Greedy cuts of a sorted sequence by bytes and rows, each batch counted anew from its first row, without one task that sees all rows.

Rows are sorted into ranges. Where the first cut of a range falls depends on what the open batch brings along, but from there on all is settled: a range
says for each place of its first cut (those within one batch's bytes) what it leaves open at its end, and how many cuts it has. A stream through these
short tables, range by range, gives each range what it starts with; then ranges number their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.session import ship, stored


class Rule:
    """``under``: a batch holds at most ``most`` bytes (a larger row is alone); else it ends with the row that reaches ``most``. ``rows``: at most so many."""

    def __init__(self, most: int, rows: int | None = None, under: bool = True):
        if most < 1 or rows is not None and rows < 1:
            raise ValueError("bounds are positive")
        self.most, self.rows, self.under = most, rows, under

    def next(self, total: np.ndarray, base, first):
        """Place at which the batch after the one that begins at place ``first``, with ``base`` bytes before it, begins; ``len(total) + 1``: none here."""
        n = len(total)
        base, first = np.asarray(base), np.asarray(first)
        if self.under:
            at = np.maximum(first + 1, np.searchsorted(total, base + self.most, side="right"))
            at = np.where(at >= n, n + 1, at)  # whether the next range's first row still fits is not known here
        else:
            at = np.searchsorted(total, base + self.most, side="left") + 1
        return at if self.rows is None else np.where(first + self.rows <= n, np.minimum(at, first + self.rows), at)


def table(sizes: np.ndarray, rule: Rule) -> dict:
    """For first cuts 0, 1, ... of a range: bytes and rows that are open at its end, and its cuts; ``total``: bytes up to each of these places."""
    total = np.cumsum(sizes)
    n = len(total)
    latest = int(min(rule.next(total, 0, 0), n))
    begin = np.arange(latest + 1)
    before = np.concatenate([[0], total])
    cuts = np.ones(latest + 1, np.int64)
    at = begin.copy()
    going = np.arange(latest + 1)
    while len(going):
        after = rule.next(total, before[at[going]], at[going])
        ok = after <= n
        going, after = going[ok], after[ok]
        moved = after > at[going]
        going, after = going[moved], after[moved]
        at[going] = after
        cuts[going] += 1
    return {"n": n, "bytes": int(total[-1]), "total": total[: latest + 1], "open_bytes": total[-1] - before[at], "open_rows": n - at, "cuts": cuts}


def cut(rows: DataFrame, group: str, order: str, size: str, most: int, limit: int | None = None, under: bool = True, out: str = "batch") -> DataFrame:
    """``rows`` with the number of their batch within their group, from 0. ``order`` must be different for each row of a group, ``size`` positive bytes."""
    spark = rows.sparkSession
    ship(spark)
    rule = Rule(most, limit, under)
    columns = rows.columns
    ranged = stored(rows.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()), "ranges")
    kind = rows.schema[group].dataType.simpleString()

    def tell(x: pa.Table) -> pa.Table:
        sizes = x.sort_by(order).column(size).to_numpy().astype(np.int64)
        t = table(sizes, rule)
        lists = [pa.array([t[k].tolist()], pa.list_(pa.int64())) for k in ("total", "open_bytes", "open_rows", "cuts")]
        return pa.table([x.column(group).slice(0, 1), x.column("_part").slice(0, 1), pa.array([t["n"]], pa.int64()), pa.array([t["bytes"]], pa.int64()), *lists], names=[group, "_part", "n", "bytes", "total", "open_bytes", "open_rows", "cuts"])

    tables = ranged.select(group, "_part", order, size).groupBy(group, "_part").applyInArrow(tell, f"{group} {kind}, _part int, n bigint, bytes bigint, total array<bigint>, open_bytes array<bigint>, open_rows array<bigint>, cuts array<bigint>")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), (0, 0, 0)
        for batch in batches:
            told = []
            for key, n, size_, total, ob, orows, cuts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 7)), strict=True):
                if key != last:
                    last, state = key, (0, 0, 0)
                told.append(state)
                first = int(first_cut(rule, np.array(total, np.int64), n, state))
                state = (state[0] + size_, state[1] + n, state[2]) if first > n else (ob[first], orows[first], state[2] + cuts[first])
            cols = [pa.array(c, pa.int64()) for c in zip(*told, strict=True)] if told else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=[group, "_part", "_bytes", "_rows", "_batch"])

    states = tables.repartition(group).sortWithinPartitions(group, "_part").mapInArrow(walk, f"{group} {kind}, _part int, _bytes bigint, _rows bigint, _batch bigint")
    states = states.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_bytes", "_rows", "_batch")

    def number(x: pa.Table, start: pa.Table) -> pa.Table:
        x = x.sort_by(order)
        total = np.cumsum(x.column(size).to_numpy().astype(np.int64))
        held, count, batch = (start.column(c)[0].as_py() for c in ("_bytes", "_rows", "_batch"))
        base, first, begins = -held, -count, []
        while (at := int(rule.next(total, base, first))) < len(total):
            begins.append(at)
            base, first = int(total[at - 1]) if at else 0, at
        numbers = batch + np.searchsorted(np.array(begins, np.int64), np.arange(len(total)), side="right")
        return x.select(columns).append_column(out, pa.array(numbers, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranged.groupBy(group, "_part").cogroup(states.groupBy("_g", "_p")).applyInArrow(number, f"{schema}, {out} bigint")


def first_cut(rule: Rule, total: np.ndarray, n: int, state: tuple[int, int, int]) -> int:
    """Where the first cut of a range of ``n`` rows falls, of which only the ``total`` of the first is at hand; beyond ``n``: nowhere."""
    held, count, _ = state
    at = int(rule.next(total, -held, -count))
    return at if at <= min(n, len(total)) else n + 1
