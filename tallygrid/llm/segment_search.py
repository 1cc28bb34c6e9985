"""Exact top-k search by inner product, with multi-resolution segment statistics.

Vectors are turned into integers (floor of ``scale`` times each component). Each resolution cuts the coordinates into equal
segments and keeps, for every segment, its mean and its deviation. Two vectors whose segment means differ by m and deviations by s
are at least sqrt(length * (m^2 + s^2)) apart in that segment; with both norms known, this lower bound of the squared
distance is an upper bound of the inner product, (|q|^2 + |c|^2 - d^2) / 2. Written out, it is the inner product of the two
vectors of statistics sqrt(length) * (means, deviations), so a block of bounds is one small matrix product.

Candidates are dealt to cells by the signs of their coarse means against the medians, and each cell keeps the range of its statistics.
A query first gets a threshold: its k-th best score in a bounded sample of candidates, which the true k-th best can only
exceed. Cells whose bound stays below it are skipped whole. In the others, bounds go from coarse to fine; pairs that a
resolution leaves below the threshold are not looked at again, and survivors are scored exactly. The bounds carry a
margin for rounding, so they decide only what to skip and the result is exact.

Equal vectors are one entry with the smallest ids that any query can need (k + 1, to leave out the query's own). An id is one
candidate, by the best of its vectors, and a query id asks with all of its vectors; it is never its own neighbour. Cells hold at
most ``part_rows`` entries a part, queries travel in blocks of ``block_rows``: a task holds one block and one part.

Defined cases: null vectors, vectors that are empty, have null, NaN or infinite components or another length than ``dim`` (by default
the most common one, the least of equally common ones), and rows without an id take no part; zero vectors do; ties go to the
smaller id; fewer candidates than k give all; an empty table gives an empty result; other columns are ignored. Scores are exact in
long integers; a table whose scores could pass 2^63 raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.llm.common import Scratch, top_ids as top

#: segments of each resolution, coarse to fine
RESOLUTIONS = (1, 4, 16)
#: candidates that first thresholds come from, at most about
SAMPLE_ROWS = 4_096
PART_ROWS = 4_096
BLOCK_ROWS = 512
#: cells, at most two to the power of this, whatever the table's size
CELL_BITS = 10
#: survivors of a resolution below this share are scored pair by pair
SPARSE = 0.1
_EXACT = float(1 << 52)
_NEVER = np.iinfo(np.int64).min // 2  # below every score


def integers(table: DataFrame, id_col: str, vec_col: str, scale: int, dim: int | None) -> DataFrame:
    """``vec_id`` and ``vec``, the integer vector, of the rows that take part."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("real"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("real") > 0)).where(F.forall("real", sound))
    if dim is None:
        lengths = rows.groupBy(F.size("real").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = lengths["n"] if lengths else 1
    # beyond 2^53 every double is whole and floor changes nothing; a cast would not hold it
    whole = F.transform("real", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return rows.where(F.size("real") == dim).select("vec_id", whole.alias("vec"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) * mean of every segment, then sqrt(length) * deviation: the norm of a row is that of the vector."""
    dim = vectors.shape[1]
    edges = np.linspace(0, dim, min(segments, dim) + 1).astype(int)
    lengths = np.diff(edges)
    real = vectors.astype(np.float64)
    sums = np.add.reduceat(real, edges[:-1], axis=1)
    squares = np.add.reduceat(real * real, edges[:-1], axis=1)
    return np.hstack([sums / np.sqrt(lengths), np.sqrt(np.maximum(squares - sums * sums / lengths, 0.0))])


def _margin(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """What rounding may take from a bound, for each query."""
    longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
    return 1e-9 * np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * longest + 1e-6


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, exactly."""
    return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64) if _small(queries, vectors) else queries @ vectors.T


def _small(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether sums of products are whole numbers that doubles hold."""
    most = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0.0))
    bound = most(queries) * most(vectors) * queries.shape[1]
    if bound >= float(1 << 62):
        raise OverflowError("inner products may not fit 64 bits: scale the vectors down")
    return bound < _EXACT


def survivors(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, resolutions: tuple[int, ...] = RESOLUTIONS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query, vector) whose bounds reach the query's ``least`` score at every resolution, coarse to fine."""
    floor = least - _margin(queries, vectors)
    alive, pairs = np.ones((len(queries), len(vectors)), dtype=bool), None
    for segments in resolutions:
        of_queries, of_vectors = statistics(queries, segments), statistics(vectors, segments)
        if pairs is not None:
            rows, columns = pairs
            near = np.einsum("ij,ij->i", of_queries[rows], of_vectors[columns]) >= floor[rows]
            pairs = rows[near], columns[near]
            continue
        alive &= of_queries @ of_vectors.T >= floor[:, None]
        if np.count_nonzero(alive) < SPARSE * alive.size:
            pairs = np.nonzero(alive)
    return pairs if pairs is not None else np.nonzero(alive)


def scores_of(queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact scores of pairs; many pairs are taken from the whole product."""
    if len(rows) >= SPARSE * len(queries) * len(vectors):
        return inner(queries, vectors)[rows, columns]
    _small(queries, vectors)
    return np.einsum("ij,ij->i", queries[rows], vectors[columns])


class Entries:
    """Distinct vectors with the ids of each."""

    def __init__(self, vectors: np.ndarray, ids: pa.Array):
        self.vectors = vectors
        self.sizes = np.array([len(i) for i in ids], dtype=np.int64)
        self.ids = ids.flatten().to_numpy(zero_copy_only=False)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if len(self.sizes) else np.zeros(0, np.int64)

        self.plain = len(np.unique(self.ids)) == len(self.ids)

    def _edges(self, rows: np.ndarray, scores: np.ndarray, queries: int, k: int) -> np.ndarray:
        """For each query the score of its k + 1-st best vector, which its k best ids reach if no id has two vectors.
        Pairs come sorted by query, as ``np.nonzero`` gives them."""
        edges = np.full(queries, _NEVER)
        if self.plain:
            ends = np.searchsorted(rows, np.arange(queries + 1))
            for query in np.flatnonzero(np.diff(ends) > k + 1):
                own = scores[ends[query] : ends[query + 1]]
                edges[query] = np.partition(own, len(own) - k - 1)[len(own) - k - 1]
        return edges

    def best(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, resolutions: tuple[int, ...] = RESOLUTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of the k best for each query among those that score at least ``least``."""
        if not len(self.vectors):
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        rows, columns = survivors(queries, self.vectors, least, resolutions)
        scores = scores_of(queries, self.vectors, rows, columns)
        near = scores >= np.maximum(least, self._edges(rows, scores, len(queries), k))[rows]
        rows, columns, scores = rows[near], columns[near], scores[near]
        times = self.sizes[columns]
        at = np.repeat(self.begin[columns] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(columns) else np.zeros(0, np.int64)
        query, ids, scores = np.repeat(rows, times), self.ids[at], np.repeat(scores, times)
        other = ids != query_ids[query]
        return top(query[other], ids[other], scores[other], k)


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """``vec`` and ``ids``, the k + 1 smallest ids, of every distinct vector."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)  # cut in every task before the shuffle
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def cell_cuts(entries: DataFrame, bits: int) -> np.ndarray:
    """About the median of each of ``bits`` segment means, over all entries: what the cells' signs are taken against."""
    if not bits:
        return np.zeros(0)
    schema = ", ".join(f"m{i} double" for i in range(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                means = statistics(_matrix(batch.column("vec")), bits)[:, : min(bits, len(batch.column("vec")[0]))]
                yield pa.RecordBatch.from_arrays([pa.array(means[:, i % means.shape[1]]) for i in range(bits)], names=[f"m{i}" for i in range(bits)])

    row = entries.select("vec").mapInArrow(run, schema).agg(*[F.percentile_approx(f"m{i}", 0.5, 1000).alias(f"m{i}") for i in range(bits)]).first()
    return np.array([row[f"m{i}"] or 0.0 for i in range(bits)])


def cells_of(vectors: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The cell of each vector: the signs of its segment means against the cuts."""
    bits = len(cuts)
    if not bits:
        return np.zeros(len(vectors), dtype=np.int64)
    means = statistics(vectors, bits)[:, : min(bits, vectors.shape[1])]
    above = means[:, np.arange(bits) % means.shape[1]] >= cuts
    return (above << np.arange(bits)).sum(axis=1).astype(np.int64)


def with_cell(table: DataFrame, cuts: np.ndarray) -> DataFrame:
    """The rows with ``cell``, from ``vec``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(cells_of(_matrix(batch.column("vec")), cuts)))

    return table.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in table.schema), "cell long"]))


@dataclass
class Ranges:
    """What is known of every cell: the range of each statistic over its vectors, its rows, its longest norm."""

    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    norms: np.ndarray

    def useful(self, queries: np.ndarray, least: np.ndarray, segments: int) -> np.ndarray:
        """Which cells may hold a score of at least ``least`` for some query."""
        if not len(self.cells):
            return np.zeros(0, dtype=bool)
        stats = statistics(queries, segments)
        # for each statistic the end of the range that makes the product greatest
        bound = np.maximum(stats, 0) @ self.high.T + np.minimum(stats, 0) @ self.low.T
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        return (bound + 1e-9 * lengths[:, None] * self.norms[None, :] + 1e-6 >= least[:, None]).any(axis=0)


def cell_ranges(celled: DataFrame, segments: int) -> Ranges:
    """The ranges of all cells, at most 2^CELL_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            if batch.num_rows:
                cell, vectors = batch.column("cell").to_numpy(), _matrix(batch.column("vec"))
                stats = statistics(vectors, segments)
                norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
                for one in np.unique(cell):
                    own = cell == one
                    low, high, n, norm = held.get(int(one), (np.inf, -np.inf, 0, 0.0))
                    held[int(one)] = (np.minimum(low, stats[own].min(axis=0)), np.maximum(high, stats[own].max(axis=0)), n + int(own.sum()), max(norm, norms[own].max()))
        for cell, (low, high, n, norm) in held.items():
            size = len(low)
            columns = [np.full(size, cell), np.arange(size), low, high, np.full(size, n), np.full(size, norm)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "at", "low", "high", "n", "norm"])

    partial = celled.mapInArrow(run, "cell long, at long, low double, high double, n long, norm double")
    made = partial.groupBy("cell", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.max("norm").alias("norm"))
    table = made.orderBy("cell", "at").toPandas()
    first = table[table["at"] == 0]
    shape = (len(first), -1) if len(first) else (0, 0)
    return Ranges(first["cell"].to_numpy(), table["low"].to_numpy().reshape(shape), table["high"].to_numpy().reshape(shape), first["n"].to_numpy(), first["norm"].to_numpy())


def dealt(rows: DataFrame, sizes: list[tuple[int, int]], name: str, *by: str) -> DataFrame:
    """The rows with a number below the size given for their cell (a short list), by a hash of the columns ``by``."""
    counts = rows.sparkSession.createDataFrame([(int(cell), int(size)) for cell, size in sizes], "cell long, _size long")
    return rows.join(F.broadcast(counts), "cell").withColumn(name, F.pmod(F.xxhash64(*by), "_size")).drop("_size")


def _packed(vectors: np.ndarray) -> bytes:
    """A matrix of whole numbers in as few bytes as they need; the first byte says how many a number takes."""
    most = int(np.abs(vectors).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + vectors.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def query_blocks(queries: DataFrame, ranges: Ranges, sample: Entries, k: int, segments: int) -> DataFrame:
    """Blocks of queries (rows with ``cell`` and ``block``): ``cells`` where neighbours may be, ``ids``, ``least`` and ``vecs``.

    ``least`` is the k-th best score of the query in the sample. A block leaves out a cell that none of its queries can use."""
    shared = queries.sparkSession.sparkContext.broadcast((ranges, sample))

    def run(table: pa.Table) -> pa.Table:
        ranges, sample = shared.value
        vectors, ids = _matrix(table.column("vec")), table.column("vec_id").to_numpy()
        query, _, scores = sample.best(ids, vectors, np.full(len(ids), _NEVER), k, resolutions=())
        least = np.full(len(ids), _NEVER)
        full = np.flatnonzero(np.bincount(query, minlength=len(ids)) == k)
        least[full] = scores[np.searchsorted(query, full, side="right") - 1]
        longs = pa.list_(pa.int64())
        return pa.table({
            "cells": pa.array([ranges.cells[ranges.useful(vectors, least, segments)]], longs), "ids": pa.array([ids], longs),
            "least": pa.array([least], longs), "vecs": pa.array([_packed(vectors)], pa.binary()),
        })

    return queries.groupBy("cell", "block").applyInArrow(run, "cells array<long>, ids array<long>, least array<long>, vecs binary")


def candidate_parts(celled: DataFrame) -> DataFrame:
    """Parts of cells (rows with ``cell`` and ``part``) as one row each: ``entry_ids``, ``sizes`` and ``entries``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        longs = pa.list_(pa.int64())
        return pa.table({
            "cell": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
            "entry_ids": pa.array([ids.flatten().to_numpy(zero_copy_only=False)], longs), "sizes": pa.array([np.array([len(i) for i in ids], dtype=np.int64)], longs),
            "entries": pa.array([_packed(_matrix(table.column("vec")))], pa.binary()),
        })

    return celled.groupBy("cell", "part").applyInArrow(run, "cell long, part long, entry_ids array<long>, sizes array<long>, entries binary")


def compare(blocks: DataFrame, parts: DataFrame, sizes: list[tuple[int, int]], k: int, resolutions: tuple[int, ...] = RESOLUTIONS) -> DataFrame:
    """``query_id``, ``vec_id`` and ``score`` of the k best of each query in each part that it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values.to_numpy()
                queries = _unpacked(batch.column("vecs")[row].as_py(), len(ids))
                sizes = batch.column("sizes")[row].values
                vectors = _unpacked(batch.column("entries")[row].as_py(), len(sizes))
                entries = Entries(vectors, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy())]), pa.int32()), batch.column("entry_ids")[row].values))
                query, found, scores = entries.best(ids, queries, batch.column("least")[row].values.to_numpy(), k, resolutions)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    counts = blocks.sparkSession.createDataFrame([(int(cell), int(size)) for cell, size in sizes], "cell long, _size long")
    sent = blocks.withColumn("cell", F.explode("cells")).join(F.broadcast(counts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)))
    return sent.drop("cells", "_size").join(parts, ["cell", "part"]).mapInArrow(run, "query_id long, vec_id long, score long")


def search(
    table: DataFrame, is_query: Column, k: int = 20, scale: int = 64, dim: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding",
    resolutions: tuple[int, ...] = RESOLUTIONS, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k highest of every id where ``is_query`` (over ``vec_id``) holds."""
    scratch = Scratch(table.sparkSession)
    rows = integers(table, id_col, vec_col, scale, dim)
    entries = scratch.write(entries_of(rows, k), "entries")
    n = entries.count()
    bits = min(CELL_BITS, max(0, (n // part_rows).bit_length() - 1))
    cuts = cell_cuts(entries, bits)
    celled = scratch.write(with_cell(entries, cuts), "cells")
    scratch.drop(entries)
    segments = max(resolutions)
    ranges = cell_ranges(celled, segments)
    parts = [(cell, -(-int(size) // part_rows)) for cell, size in zip(ranges.cells, ranges.rows)]
    drawn = celled.where(F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1_000_000)) < min(1.0, sample_rows / max(n, 1)) * 1_000_000).select("vec", "ids").toArrow()
    sample = Entries(_matrix(drawn.column("vec")) if drawn.num_rows else np.zeros((0, 1), np.int64), drawn.column("ids").combine_chunks())
    asked = scratch.write(with_cell(rows.where(is_query).distinct(), cuts), "queries")
    blocks = [(r["cell"], -(-r["count"] // block_rows)) for r in asked.groupBy("cell").count().collect()]  # a row a cell
    sent = query_blocks(dealt(asked, blocks, "block", "vec_id", "vec"), ranges, sample, k, segments)
    found = compare(sent, candidate_parts(dealt(celled, parts, "part", "vec")), parts, k, resolutions)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
