"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample: each node's vectors are split around ``branches`` centres until
a node holds few of them. Every vector of the table then goes down to the nearest centre at each level and is
indexed under its leaf. A query walks the tree through a priority queue, always opening the centre with
the largest inner product so far, and so meets leaves in order of promise; it looks at all
vectors of the first ``visits`` leaves. ``calibrate`` takes the exact neighbours of a bounded sample of queries, by
brute force over all rows, and widens the visits until the wanted share of them lies in visited leaves.

Equal vectors are one entry of the index with the smallest ids that any query can need (k + 1, to leave out the
query itself), so a vector that very many rows share costs what one does. An id is one candidate, by the best of its vectors, and a
query id asks with all of its vectors; every cut to k counts ids, not vectors. A leaf's entries are dealt to groups and its
queries to blocks, each a row; a task compares one block with one group at a time, and the k best per query are merged.

Inner products are double precision, summed in the order of the coordinates, so equal vectors tie exactly
and ties go to the smaller id. Defined cases: null vectors, zero vectors, vectors with null, NaN or infinite
components, with another length than ``dim`` (by default, the most common one), and rows without an id take no part; a repeated id is
never its own neighbour; fewer candidates than k give all; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.llm.common import staged, top_ids as top

#: vectors that the tree is fitted on, at most about
FIT_ROWS = 20_000
BRANCHES = 8
#: sampled vectors that a leaf holds at most
LEAF_ROWS = 512
#: index entries of a leaf that one task compares, on average at most
GROUP_ROWS = 1_024
#: queries of a leaf that one task compares at once, on average at most
BLOCK_ROWS = 512
#: queries that the visits are calibrated on, at most about
CALIBRATION_QUERIES = 200
RECALL = 0.95
ROUNDS = 8


@dataclass
class Tree:
    """Centres of all nodes: node i has the children ``first[i]`` to ``first[i] + count[i] - 1``, a leaf has none."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    radius: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.count == 0).sum())

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector goes down to, by the nearest centre at each level."""
        at = np.zeros(len(vectors), dtype=np.int64)
        active = np.arange(len(vectors)) if self.count[0] else np.zeros(0, np.int64)
        while len(active):
            for node in np.unique(at[active]):
                here = active[at[active] == node]
                children = slice(self.first[node], self.first[node] + self.count[node])
                at[here] = self.first[node] + _nearest(vectors[here], self.centres[children])
            active = active[self.count[at[active]] > 0]
        return at

    def search(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves met by a best-bin-first walk, most promising first."""
        length = float(np.sqrt(query @ query))
        queue, found = [(0.0, 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                found.append(node)
                continue
            children = np.arange(self.first[node], self.first[node] + self.count[node])
            for promise, child in zip(self.centres[children] @ query + PROMISE * length * self.radius[children], children):
                heapq.heappush(queue, (-float(promise), int(child)))
        return found


#: how much of a node's radius counts in its favour
PROMISE = 1.0


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * vectors @ centres.T, axis=1)


def grow(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> Tree:
    """A tree by k-means at every node."""
    random = np.random.default_rng(seed)
    centres, first, count, radius = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [0], [0], [0.0]
    work = [(0, sample)]
    while work:
        node, rows = work.pop(0)
        radius[node] = float(np.sqrt(((rows - centres[node]) ** 2).sum(axis=1).mean())) if len(rows) else 0.0
        distinct = np.unique(rows, axis=0) if len(rows) > leaf_rows else rows[:0]
        if len(distinct) <= branches:
            continue
        middle = distinct[random.choice(len(distinct), branches, replace=False)]
        for _ in range(ROUNDS):
            own = _nearest(rows, middle)
            middle = np.array([rows[own == j].mean(axis=0) if (own == j).any() else middle[j] for j in range(branches)])
        own = _nearest(rows, middle)
        used = [j for j in range(branches) if (own == j).any()]
        if len(used) < 2:
            continue
        first[node], count[node] = len(centres), len(used)
        for j in used:
            work.append((len(centres), rows[own == j]))
            centres.append(middle[j])
            first.append(0)
            count.append(0)
            radius.append(0.0)
    return Tree(np.array(centres), np.array(first), np.array(count), np.array(radius))


def usable(table: DataFrame, id_col: str, vec_col: str, dim: int | None) -> DataFrame:
    """``vec_id`` and ``vec`` (array of floats or doubles) of the rows that take part."""
    given = table.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if given == "array<float>" else F.col(vec_col).cast("array<double>")  # floats are widened where they are used
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(F.forall("vec", sound) & F.exists("vec", lambda x: x != 0))
    if dim is None:
        lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = lengths["n"] if lengths else 0
    return rows.where(F.size("vec") == dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def score_matrix(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, summed in the order of the coordinates."""
    made = np.zeros((len(queries), len(vectors)))
    for c in range(queries.shape[1]):
        made += queries[:, c, None] * vectors[None, :, c]
    return made


def build(rows: DataFrame, k: int, fit_rows: int = FIT_ROWS, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> tuple[Tree, DataFrame]:
    """The tree and the index: ``leaf``, ``vec`` and ``ids`` (the k + 1 smallest ids) of every distinct vector."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)  # cut in every task before the shuffle
    entries = staged(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    n = entries.count()
    share = min(1.0, fit_rows / max(n, 1))
    drawn = entries.where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < share * 1_000_000).select("vec").orderBy(F.xxhash64("vec")).collect()
    sample = np.array([r["vec"] for r in drawn], dtype=np.float64) if drawn else np.zeros((0, 1))
    tree = grow(sample, branches, leaf_rows)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaf_of(_matrix(batch.column("vec"), shared.value.centres.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column("vec"), batch.column("ids")], names=["leaf", "vec", "ids"])

    kind = entries.schema["vec"].dataType.simpleString()
    return tree, staged(entries.mapInArrow(run, f"leaf long, vec {kind}, ids array<long>"), "index")


def visit(queries: DataFrame, tree: Tree, visits: int) -> DataFrame:
    """``query_id``, ``query`` and ``leaf`` for every leaf that a query visits."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = [shared.value.search(q, visits) for q in _matrix(batch.column("query"), shared.value.centres.shape[1])]
                at = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
                leaf = pa.array([leaf for f in found for leaf in f], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("query").take(at), leaf], names=["query_id", "query", "leaf"])

    kind = queries.schema["query"].dataType.simpleString()
    return queries.select("query_id", "query").mapInArrow(run, f"query_id long, query {kind}, leaf long")


@dataclass
class Entries:
    """Vectors and the ids of each."""

    vectors: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, ids: pa.Array) -> Entries:
        return cls(vectors, ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of the k nearest ids of each query."""
        scores = score_matrix(queries, self.vectors)
        near = np.ones(scores.shape, dtype=bool)
        if scores.shape[1] > k + 1 and len(np.unique(self.ids)) == len(self.ids):
            # each of the k + 1 nearest vectors has an id of its own, and only one of these can be the query's
            near = scores >= np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1][:, None]
        rows, columns = np.nonzero(near)
        times = self.sizes[columns]
        begin = np.cumsum(self.sizes) - self.sizes
        at = np.repeat(begin[columns] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        query, ids, held = np.repeat(rows, times), self.ids[at], np.repeat(scores[rows, columns], times)
        other = ids != query_ids[query]
        return top(query[other], ids[other], held[other], k)


def merge(partial: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query: ``query_id``, ``rank``, ``vec_id`` and ``score``. A candidate met twice counts once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def look_up(index: DataFrame, visits: DataFrame, k: int, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest entries in the visited leaves: every block of a leaf's queries meets every group of its entries."""

    def dealt(rows: DataFrame, size: int, *by: str) -> DataFrame:
        parts = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_parts"))  # a row for each leaf of the tree
        return rows.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int")).drop("_parts")

    longs = pa.list_(pa.int64())

    def group(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        columns = [table.column("leaf")[:1].combine_chunks(), pa.array([_reals(table.column("vec")).tobytes()], pa.binary()), pa.array([ids.flatten()], longs)]
        return pa.table([*columns, pa.array([pc.list_value_length(ids).cast(pa.int64())], longs)], names=["leaf", "vectors", "ids", "sizes"])

    def block(table: pa.Table) -> pa.Table:
        columns = [table.column("leaf")[:1].combine_chunks(), pa.array([table.column("query_id").combine_chunks()], longs), pa.array([_reals(table.column("query")).tobytes()], pa.binary())]
        return pa.table(columns, names=["leaf", "query_ids", "queries"])

    width = 4 if index.schema["vec"].dataType.simpleString() == "array<float>" else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                query_ids, ids, sizes = (batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in ("query_ids", "ids", "sizes"))
                queries, vectors = (
                    np.frombuffer(batch.column(name)[row].as_buffer(), dtype=f"<f{width}").reshape(n, -1).astype(np.float64) for name, n in (("queries", len(query_ids)), ("vectors", len(sizes)))
                )
                query, found, scores = Entries(vectors, ids, sizes).best(query_ids, queries, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[query]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    groups = dealt(index, group_rows, "vec").groupBy("leaf", "part").applyInArrow(group, "leaf long, vectors binary, ids array<long>, sizes array<long>")
    blocks = dealt(visits, block_rows, "query_id", "query").groupBy("leaf", "part").applyInArrow(block, "leaf long, query_ids array<long>, queries binary")
    return merge(blocks.join(groups, "leaf").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def _reals(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of a column of vectors as they are, one after the other."""
    return np.asarray(column.combine_chunks().flatten())


def brute_force(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The exact k nearest of a bounded number of queries (they are collected and sent to all tasks)."""
    asked = queries.select("query_id", "query").collect()
    ids, matrix = np.array([r["query_id"] for r in asked], dtype=np.int64), np.array([r["query"] for r in asked], dtype=np.float64)
    shared = index.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, wanted = shared.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if batch.num_rows and len(query_ids):
                more = Entries.of(_matrix(batch.column("vec"), wanted.shape[1]), batch.column("ids")).best(query_ids, wanted, k)
                held = top(*(np.concatenate(pair) for pair in zip(held, more)), k)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "score"])

    return merge(index.select("vec", "ids").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def calibrate(index: DataFrame, tree: Tree, queries: DataFrame, k: int, wanted: float = RECALL, limit: int = CALIBRATION_QUERIES) -> tuple[int, float]:
    """The least visits with which a sample of the queries reaches the wanted recall, and that recall."""
    share = min(1.0, limit / max(queries.count(), 1))
    sample = staged(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(1_000_000)) < share * 1_000_000), "calibration")
    exact = brute_force(index, sample, k)  # about limit * k rows
    homes = exact.join(index.select("leaf", F.explode("ids").alias("vec_id")), "vec_id").select("query_id", "vec_id", "leaf").collect()
    places: dict[int, dict[int, int]] = {}  # how early each leaf comes for a query id, by the vector that meets it first
    for row in sample.collect():
        held = places.setdefault(row["query_id"], {})
        for i, leaf in enumerate(tree.search(np.array(row["query"], dtype=np.float64), tree.leaves)):
            held[leaf] = min(i, held.get(leaf, i))
    # an id with several vectors counts as found where the latest of them lies
    latest: dict[tuple[int, int], int] = {}
    for query_id, vec_id, leaf in homes:
        latest[query_id, vec_id] = max(places[query_id][leaf], latest.get((query_id, vec_id), 0))
    ranks = np.sort(list(latest.values()))
    if not len(ranks):
        return 1, 1.0
    visits = int(ranks[math.ceil(wanted * len(ranks)) - 1]) + 1
    return visits, float((ranks < visits).mean())


def search(table: DataFrame, is_query: Column, k: int = 20, dim: int | None = None, wanted: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest of every row where ``is_query`` (over ``vec_id``) holds."""
    rows = usable(table, id_col, vec_col, dim)
    queries = staged(rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")).distinct(), "queries")
    tree, index = build(rows, k)
    visits, _ = calibrate(index, tree, queries, k, wanted)
    return look_up(index, visit(queries, tree, visits), k)
