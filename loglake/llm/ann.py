"""Approximate nearest neighbours: NN-descent on Spark joins, greedy search of the graph.

Equal vectors are one node. Every node starts with its nearest among the nodes of the cells it falls into (cells of nearest pivots). Each round of
NN-descent then joins every node's neighbours, and a bounded draw of those that have it as a neighbour, with each other: a node's members meet in one
group, their distances are computed there, and pairs that are nearer than what a member knows go on to the next graph. A query is a node of the graph:
its search starts at its own neighbours and opens, step by step, the nearest nodes of its beam that it has not opened, until none is left. What comes
out is measured again on the original vectors in double precision.

Graph and beams live in the shared folder, a round or a step is one job that reads the one before, and counts what it changed as it writes. Vectors
travel unrounded, and groups are centred before distances are taken, so that near copies stay apart. Queries are worked on in blocks of bounded bytes.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loglake.llm.shared import discard, ship, store, stored

log = logging.getLogger(__name__)

#: Neighbours a node keeps; of these, and of those that have it as neighbour, so many meet in a round; nearer partners that a member takes from a group.
NEIGHBOURS, JOINED, TAKEN = 32, 8, 6
#: Cells a node falls into, nodes of a cell (or of a cell's random block) on average, partners taken there, and the most pivots that cells are made of.
CELLS, CELL, CELL_TAKEN, PIVOTS = 8, 1024, 16, 4096
#: Descent ends when less than this share of the graph is new, and says so in the log if it has not after so many rounds.
SETTLED, ROUNDS = 0.02, 15
#: Nodes of a query's beam, all of which are opened before the search ends, and those measured again at the end.
BEAM, MEASURED = 256, 48
#: Bytes of query vectors that tasks get at once; further queries follow in blocks of their own.
QUERY_BYTES = 64 << 20
#: Pairs that a task of a round gathers before it drops what a node can't use.
GATHERED = 1 << 18
#: Nodes, and nodes of beams, that a task works on at least, unless there are as many tasks as cores.
NODES_A_TASK, BEAMED_A_TASK = 20_000, 100_000

GRAPH = "id bigint, near array<bigint>, far array<float>"
PAIRS = "a bigint, new boolean, b binary, d binary"
BEAMS = "q bigint, node bigint, d double, opened boolean, go boolean"


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole groups (runs of equal values in the first column)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(key[1:] != key[:-1])
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(cut):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]) + 1)]).combine_chunks()
            held = [batch.slice(int(cut[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tasks(spark: SparkSession, count: int, least: int) -> int:
    """How many tasks rows deserve: as many as there are cores, more where each would still get ``least``. Small tables need not pay for every
    partition that the session shuffles into; ``coalesce`` never makes more of them."""
    return max(spark.sparkContext.defaultParallelism, count // least)


def runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end of the last."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)


def matrix(column, kind: str) -> np.ndarray:
    """Rows of numbers from packed vectors, in double precision."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64) if values else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(vec_id, x) of the rows that take part, and the kind of the numbers packed in x: rows with an id and a finite vector that isn't zero, of the
    length that most vectors have (the least such length)."""
    kind = "f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "f8"
    v = F.col(vec_col) if kind == "f4" else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    usual = rows.agg(F.mode(F.size("v"), True).alias("n")).first()["n"]
    rows = rows.filter(F.size("v") == (usual or 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) + 0.0  # no negative zeros
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names=["vec_id", "x"])

    return rows.mapInArrow(pack, "vec_id bigint, x binary"), kind


def squares(x: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances within each group (the last axis but one), taken about the group's mean."""
    x = x - x.mean(axis=-2, keepdims=True)
    n = np.einsum("...ij,...ij->...i", x, x)
    return np.maximum(n[..., :, None] + n[..., None, :] - 2 * x @ np.swapaxes(x, -1, -2), 0)


def best(a: np.ndarray, b: np.ndarray, d: np.ndarray, old: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k nearest different b of each a, by a and distance; of rows with the same (a, b), one that is marked old stays."""
    order = np.lexsort((d, ~old, b, a))
    first = np.ones(len(order), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    order = order[first]
    order = order[np.lexsort((b[order], d[order], a[order]))]
    start = runs(a[order])
    rank = np.arange(len(order)) - np.repeat(start[:-1], np.diff(start))
    return order[rank < k]


def packed(a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> pa.RecordBatch:
    """One row a node: its k nearest of the pairs given."""
    at = best(a, b, d, np.zeros(len(a), bool), k)
    a, b, d = a[at], b[at].astype("i8"), d[at].astype("f4")
    start = runs(a)
    cut = lambda z: pa.array([z[s:e].tobytes() for s, e in zip(start[:-1], start[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a[start[:-1]], pa.int64()), pa.array(np.ones(len(start) - 1, bool)), cut(b), cut(d)], names=["a", "new", "b", "d"])


def first_pairs(nodes: DataFrame, pivots: np.ndarray, kind: str, parts: int) -> DataFrame:
    """Pairs of nodes that share a cell; a cell is cut at random into blocks of ``CELL`` nodes on average."""
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            d = (p**2).sum(1)[None] - 2 * matrix(b.column(1), kind) @ p.T
            k = min(CELLS, len(p))
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(p) else np.tile(np.arange(k), (len(d), 1))
            at = pa.array(np.repeat(np.arange(b.num_rows), k))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), b.column(0).take(at), b.column(1).take(at)], names=["cell", "id", "x"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            key, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
            start = runs(key).tolist()
            for s, e in zip(start[:-1], start[1:], strict=True):
                if e - s > 1:
                    d = squares(matrix(t.column(2).slice(s, e - s), kind))
                    np.fill_diagonal(d, np.inf)
                    k = min(CELL_TAKEN, e - s - 1)
                    at = np.argpartition(d, k - 1, axis=1)[:, :k]
                    yield packed(np.repeat(ids[s:e], k), ids[s:e][at.ravel()], np.take_along_axis(d, at, 1).ravel(), k)

    cells = nodes.select("id", "x").mapInArrow(assign, "cell bigint, id bigint, x binary")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    dealt = cells.join(F.broadcast(sizes), "cell")  # at most PIVOTS rows
    block = F.xxhash64("cell", F.pmod(F.xxhash64(F.lit(3), "id", "cell"), "parts"))
    return dealt.select(block.alias("g"), "id", "x").repartition("g").coalesce(parts).sortWithinPartitions("g").mapInArrow(within, PAIRS)


def kept(pairs: DataFrame, parts: int) -> DataFrame:
    """Each node's nearest (id, near, far) of the pairs, and how many of them are new (fresh)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            raw = t.column(2).to_pylist()
            counts = np.array([len(r) // 8 for r in raw])
            a, old = np.repeat(t.column(0).to_numpy(), counts), np.repeat(~t.column(1).to_numpy(), counts)
            b, d = np.frombuffer(b"".join(raw), "i8"), np.frombuffer(b"".join(t.column(3).to_pylist()), "f4")
            at = best(a, b, d, old, NEIGHBOURS)
            start = runs(a[at])
            lists = lambda z: pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(z))
            fresh = np.add.reduceat((~old[at]).astype(np.int64), start[:-1]) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[at][start[:-1]]), lists(b[at]), lists(d[at]), pa.array(fresh)], names=["id", "near", "far", "fresh"])

    return pairs.repartition("a").coalesce(parts).sortWithinPartitions("a").mapInArrow(run, f"{GRAPH}, fresh bigint")


def reversed_links(graph: DataFrame, first: int, most: int) -> DataFrame:
    """(u, a): nodes a that have u among their ``first`` neighbours, ``most`` of them at random (Spark limits the groups before they move)."""
    back = graph.select(F.explode(F.slice("near", 1, first)).alias("u"), F.col("id").alias("a"))
    drawn = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "a"), "a"))
    return back.withColumn("r", drawn).filter(F.col("r") <= most).drop("r")


def descend(nodes: DataFrame, graph: DataFrame, kind: str, parts: int) -> DataFrame:
    """Pairs among the members that meet at a node, where b is nearer to a than the last that a keeps (or a keeps too few)."""
    members = graph.select(F.col("id").alias("u"), F.explode(F.slice("near", 1, JOINED)).alias("a")).union(reversed_links(graph, JOINED, JOINED))
    last = F.when(F.size("near") < NEIGHBOURS, F.lit(float("inf"))).otherwise(F.element_at("far", -1)).cast("float")
    about = nodes.select("id", "x").join(graph.select("id", last.alias("last")), "id").select(F.col("id").alias("a"), "x", "last")

    def meet(u: np.ndarray, a: np.ndarray, x: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        start = runs(u)
        sizes = np.diff(start)
        for n in np.unique(sizes[sizes > 1]).tolist():  # groups of one size at once
            at = start[:-1][sizes == n]
            for some in np.array_split(at, -(-len(at) * n * n // (1 << 21)) or 1):
                rows = some[:, None] + np.arange(n)
                d = squares(x[rows])
                d[:, np.arange(n), np.arange(n)] = np.inf
                d[(a[rows][:, :, None] == a[rows][:, None, :]) | (d >= last[rows][:, :, None])] = np.inf
                k = min(TAKEN, n - 1)
                pick = np.argpartition(d, k - 1, axis=2)[:, :, :k]
                value = np.take_along_axis(d, pick, 2)
                fine = np.isfinite(value)
                ids = np.broadcast_to(a[rows][:, :, None], value.shape)
                yield ids[fine], np.take_along_axis(np.broadcast_to(a[rows][:, None, :], d.shape), pick, 2)[fine], value[fine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for t in whole_groups(batches):
            for part in meet(t.column(0).to_numpy(), t.column(1).to_numpy(), matrix(t.column(2), kind), t.column(3).to_numpy()):
                held.append(part)
                count += len(part[0])
            if count >= GATHERED:
                yield packed(*map(np.concatenate, zip(*held, strict=True)), NEIGHBOURS)
                held, count = [], 0
        if count:
            yield packed(*map(np.concatenate, zip(*held, strict=True)), NEIGHBOURS)

    return members.join(about, "a").select("u", "a", "x", "last").repartition("u").coalesce(parts).sortWithinPartitions("u").mapInArrow(run, PAIRS)


def known(graph: DataFrame) -> DataFrame:
    """A graph as the pairs that ``kept`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, far = b.column(1), b.column(2)
            at = near.offsets.to_numpy()
            bs, ds = near.values.to_numpy(), far.values.to_numpy()
            cut = lambda z: pa.array([z[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(b.num_rows, bool)), cut(bs), cut(ds)], names=["a", "new", "b", "d"])

    return graph.select("id", "near", "far").mapInArrow(run, PAIRS)


def counted(df: DataFrame, name: str, what: Column) -> tuple[str, int]:
    """``df`` stored, and a sum over its rows that is taken while they are written."""
    seen = Observation()
    path = store(df.observe(seen, F.sum(what).alias("n")), name)
    return path, seen.get["n"] or 0


def build(nodes: DataFrame, pivots: np.ndarray, count: int, kind: str) -> DataFrame:
    """The neighbour graph (id, near, far) of all nodes; a node without another one has no row."""
    spark = nodes.sparkSession
    parts = tasks(spark, count, NODES_A_TASK)
    path, _ = counted(kept(first_pairs(nodes, pivots, kind, parts), parts), "graph", F.col("fresh"))
    for k in range(ROUNDS):
        graph = spark.read.schema(GRAPH).parquet(path)
        new, fresh = counted(kept(known(graph).union(descend(nodes, graph, kind, parts)), parts), "graph", F.col("fresh"))
        discard(spark, path)
        path = new
        spark._jvm.System.gc()  # lets Spark's cleaner drop the round's shuffle files
        if fresh <= SETTLED * count * NEIGHBOURS:
            break
        if k == ROUNDS - 1:
            log.warning("the neighbour graph was still changing after %d rounds: %.3f of it was new", ROUNDS, fresh / count / NEIGHBOURS)
    return spark.read.schema(GRAPH).parquet(path)


def linked(graph: DataFrame) -> DataFrame:
    """(id, links): a node's neighbours and a draw of those that have it as neighbour."""
    back = reversed_links(graph, NEIGHBOURS, NEIGHBOURS).groupBy("u").agg(F.collect_list("a").alias("back"))
    both = graph.select("id", "near").join(back.withColumnRenamed("u", "id"), "id", "full_outer")
    return both.select("id", F.array_union(F.coalesce("near", F.array().cast("array<bigint>")), F.coalesce("back", F.array().cast("array<bigint>"))).alias("links"))


def measured(pairs: DataFrame, nodes: DataFrame, queries, kind: str, parts: int, *more: str) -> DataFrame:
    """(q, node, d, *more) of pairs (q, node) and the nodes' columns ``more``: squared distances, differences of the original numbers in double
    precision. ``queries``: the broadcast ids (sorted) and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = queries.value
        for b in batches:
            if b.num_rows:
                y, at = matrix(b.column(2), kind), np.searchsorted(own, b.column(0).to_numpy())
                d = ((np.frombuffer(vectors, kind).reshape(len(own), -1)[at].astype(np.float64) - y) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d), *[b.column(3 + i) for i in range(len(more))]], names=["q", "node", "d", *more])

    both = pairs.join(nodes.withColumnRenamed("id", "node"), "node").select("q", "node", "x", *more).coalesce(parts)
    return both.mapInArrow(run, "q bigint, node bigint, d double" + "".join(f", {c} {nodes.schema[c].dataType.simpleString()}" for c in more))


def beams(found: DataFrame, parts: int) -> DataFrame:
    """Each query's nearest (q, node, d, opened) of what was found; ``go`` marks what is opened next: all that wasn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            q, node, d, opened = (t.column(k).to_numpy() for k in range(4))
            at = best(q, node, d, opened, BEAM)
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in (q[at], node[at], d[at], np.ones(len(at), bool), ~opened[at])], names=["q", "node", "d", "opened", "go"])

    return found.select("q", "node", "d", "opened").repartition("q").coalesce(parts).sortWithinPartitions("q").mapInArrow(run, BEAMS)


def search(nodes: DataFrame, graph: DataFrame, links: DataFrame, asked: DataFrame, queries, kind: str, parts: int) -> str:
    """Path of the beams of a block of queries after the greedy search: it ends when all of every beam is opened."""
    spark = nodes.sparkSession
    starts = asked.select(F.col("id").alias("q")).join(graph.withColumnRenamed("id", "q"), "q").select("q", F.explode(F.arrays_zip("near", "far")).alias("z"))
    start = starts.select("q", F.col("z.near").alias("node"), F.col("z.far").cast("double").alias("d"), F.lit(False).alias("opened"))
    own = asked.select(F.col("id").alias("q"), F.col("id").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("opened"))
    path, open_ = counted(beams(start.union(own), parts), "beam", F.col("go").cast("bigint"))
    while open_:
        beam = spark.read.schema(BEAMS).parquet(path)
        opened = beam.filter("go").select("q", F.col("node").alias("id")).join(links, "id").select("q", F.explode("links").alias("node"), F.lit(False).alias("seen"))
        some = opened.union(beam.select("q", "node", F.lit(True).alias("seen"))).repartition("node")
        fresh = some.groupBy("q", "node").agg(F.max("seen").alias("seen")).filter("not seen").select("q", "node")
        more = measured(fresh, nodes.select("id", "x"), queries, kind, parts).withColumn("opened", F.lit(False))
        new, open_ = counted(beams(more.union(beam.select("q", "node", "d", "opened")), parts), "beam", F.col("go").cast("bigint"))
        discard(spark, path)
        path = new
        spark._jvm.System.gc()
    return path


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``, among all other ids.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. Rows without an id, and vectors that are
    null, zero, of an unusual length or hold a null or non-finite number take no part. Rows that repeat an id and vector count once; an id with several
    vectors is as near as its nearest, and as a query is searched by each, with its results merged. Fewer candidates than k give as many rows; an empty
    table gives none; further columns are not read.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    some, kind = usable(vectors, id_col, vec_col)
    path, total = counted(some, "vectors", F.lit(1))
    rows = spark.read.schema(some.schema).parquet(path)
    parts = tasks(spark, total, NODES_A_TASK)
    few = rows.groupBy("x", "vec_id").agg(F.lit(0)).withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    nodes = few.groupBy("x").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    path, count = counted(nodes.coalesce(parts), "nodes", F.lit(1))
    nodes = spark.read.schema("x binary, id bigint, ids array<bigint>").parquet(path)
    if not count:
        return spark.createDataFrame([], schema)
    names = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).distinct().join(nodes.select("x", "id"), "x").select("id", F.col("vec_id").alias("query_id"))
    names = stored(names, "names")
    bound = int(min(1.0, max(16, min(PIVOTS, count * CELLS / CELL)) / count) * (1 << 40))
    drawn = nodes.filter(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 40)) < bound).select("x").toArrow()
    pivots = matrix(drawn.column("x"), kind)
    if not len(pivots):
        pivots = np.zeros((1, len(matrix(nodes.select("x").limit(1).toArrow().column("x"), kind)[0])))
    graph = build(nodes, pivots, count, kind)
    links = stored(linked(graph).coalesce(parts), "links")
    own = names.select("id").distinct()
    path, total = counted(nodes.select("id", "x").join(own, "id", "left_semi"), "asked", F.octet_length("x"))
    asked = spark.read.schema("id bigint, x binary").parquet(path)
    blocks = -(-total // QUERY_BYTES)
    out = None
    for k_block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)) == k_block)
        block = own.toArrow()
        if block.num_rows:
            parts = tasks(spark, block.num_rows * BEAM, BEAMED_A_TASK)
            ids = block.column("id").to_numpy()
            order = np.argsort(ids)
            queries = spark.sparkContext.broadcast((ids[order], b"".join(block.column("x").take(pa.array(order)).to_pylist())))
            beam = spark.read.schema(BEAMS).parquet(search(nodes, graph, links, own, queries, kind, parts))
            near = beam.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))).filter(F.col("r") <= MEASURED).select("q", "node")
            found = measured(near, nodes, queries, kind, parts, "ids").select("q", F.explode("ids").alias("vec_id"), F.sqrt("d").alias("score"))
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema)
    pairs = out.join(names.withColumnRenamed("id", "q"), "q").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
