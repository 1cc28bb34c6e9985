"""N-gram Jaccard join by chosen paths.

A text is the set of its word shingles (five words; a shorter text is one shingle). Sets are mapped
to ``COORDINATES`` minhashes, whose tokens (coordinate, value) two sets share about as often as their Jaccard
similarity says. The join splits recursively: a node's sets go to one child for each sampled
coordinate, by the token they have there, so similar sets keep meeting and others part. A node is a
leaf once it is small, or if a child would keep most of it (its sets are alike, or many copies with small
edits): leaves are compared by brute force, large ones in blocks of at most about ``BLOCK`` sets, each pair
of blocks by a task. ``runs_for`` says how many independent starts lift the recall of the faintest wanted pair to the target.

Pairs that a leaf proposes by their minhashes are confirmed on the whole shingle sets. A pair counts in
the first of the leaves that it shares, so links are counted exactly once without listing pairs, and
each leaf hands on only its members: their number of links and the least member they connect to. Components
of these stars are the classes.

Texts with equal sets are one node from the start, whatever their number. Defined cases: a text without
a word, or a row without an id, has no links and is its own class; repeated rows are copies; ties do not arise
(a class is named by its least id); an empty table gives an empty result; other columns are ignored. Nodes are
told apart by a 64-bit hash of their set.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.llm.common import WORD, Scratch, split_by_filter, staged

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
TARGET_MISS = 1e-5
#: children of a node that is split, and how often nodes are split at most
BRANCHES = 3
LEVELS = 7
#: sets that a leaf holds at most, and a side of a compared pair of blocks on average
BLOCK = 400
#: a node is not split if a child would keep this share of it
DENSE = 0.5
#: words whose hashes a task holds, and tokens hashed at once
HELD_WORDS = 200_000
PART = 8_192

_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_agreeing(similarity: float, coordinates: int = COORDINATES) -> int:
    """Agreeing coordinates that a wanted pair has, but for five standard deviations."""
    return max(1, math.floor(coordinates * similarity - 5 * math.sqrt(coordinates * similarity * (1 - similarity))))


def runs_for(similarity: float, miss: float = TARGET_MISS, branches: int = BRANCHES) -> int:
    """Starts after which a pair at the threshold is missed with at most this probability, at any depth."""
    stays = 1.0
    for _ in range(200):
        stays = 1 - (1 - similarity * stays) ** branches
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity * stays)))


def _hash_family(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    state = np.random.Generator(np.random.PCG64(20_240_601))
    return state.integers(0, 2**64, coordinates, dtype=np.uint64) | np.uint64(1), state.integers(0, 2**64, coordinates, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, held for a while."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def shingles(text: str | None, words_seen: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes."""
    words = WORD.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([words_seen[w] for w in words], dtype=np.uint64)
    width = min(size, len(words))
    rolled = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        rolled = (rolled ^ hashes[i : len(words) - width + 1 + i]) * _MIX
        rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


def minhashes(tokens: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The 32-bit minhash of a set in every coordinate."""
    factors, shifts = family
    least = np.full(len(factors), 2**64 - 1, dtype=np.uint64)
    for start in range(0, len(tokens), PART):
        part = tokens[start : start + PART, None] * factors[None, :] + shifts[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id``, ``sid`` (hash of the shingle set; null if there is none) and ``sketch`` (its minhashes) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, seen = _hash_family(coordinates), WordHashes()
        for batch in batches:
            ids, sids, sketches = [], [], []
            for doc_id, text in zip(*batch.to_pydict().values()):
                tokens = shingles(text, seen, size)
                takes_part = doc_id is not None and len(tokens)
                ids.append(doc_id)
                sids.append(_set_id(tokens) if takes_part else None)
                sketches.append(minhashes(tokens, family).tobytes() if takes_part else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sids, pa.int64()), pa.array(sketches, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, sid long, sketch binary")


def _set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def _token_at(coordinate: Column) -> Column:
    """The 32-bit value of a sketch at a coordinate."""
    return F.substring(F.col("sketch"), coordinate * 4 + 1, F.lit(4))


def _met(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (``path``, ``sid``, ...) of the paths that more than one set took, with that number as ``n``.

    The numbers are written first: joined with a table, a path that very many sets took is split between tasks."""
    taken = scratch.write(rows, "taken")
    return taken.join(scratch.write(taken.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts"), "path")


def choose_leaves(nodes: DataFrame, runs: int, scratch: Scratch, levels: int = LEVELS, branches: int = BRANCHES, block: int = BLOCK, dense: float = DENSE, coordinates: int = COORDINATES) -> DataFrame:
    """The recursion, level by level: ``leaf``, ``sid`` and ``n`` (sets in the leaf)."""
    starts = F.array(*[F.xxhash64(F.lit(r), _token_at(F.lit(r))) for r in range(runs)])
    waiting = scratch.write(_met(nodes.select("sid", F.explode(starts).alias("path")), scratch), "paths")
    own = (coordinates - runs) // levels  # coordinates that a level may sample
    leaves = waiting.where(F.col("n") <= block)
    for level in range(levels):
        large = waiting.where(F.col("n") > block)
        if large.isEmpty():
            return leaves.select(F.col("path").alias("leaf"), "sid", "n")
        first = F.pmod(F.xxhash64("parent", F.lit(level)), F.lit(own)).cast("int")
        picks = F.transform(F.sequence(F.lit(0), F.lit(min(branches, own) - 1)), lambda j: (first + j) % own + (runs + level * own))
        children = large.select(F.col("path").alias("parent"), F.col("n").alias("parent_n"), "sid").join(nodes.select("sid", "sketch"), "sid")
        children = children.withColumn("pick", F.explode(picks)).withColumn("path", F.xxhash64("parent", "pick", _token_at(F.col("pick"))))
        children = scratch.write(_met(children.select("parent", "parent_n", "sid", "path"), scratch), "paths")
        alike = children.groupBy("parent", "parent_n").agg(F.max("n").alias("most")).where(F.col("most") >= dense * F.col("parent_n")).select("parent")
        alike = scratch.write(alike, "alike")  # written for the same reason
        whole = large.join(alike.withColumnRenamed("parent", "path"), "path")
        waiting = scratch.write(children.join(alike, "parent", "left_anti").select("path", "sid", "n"), "paths")
        leaves = leaves.unionByName(whole.select("path", "sid", "n")).unionByName(waiting.where(F.col("n") <= block).select("path", "sid", "n"))
    # what is still large after the last level is compared as it is, in blocks
    return leaves.unionByName(waiting.where(F.col("n") > block).select("path", "sid", "n")).select(F.col("path").alias("leaf"), "sid", "n")


def units(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each set and pair of blocks of its leaf: ``leaf``, ``low``, ``high`` (the blocks), ``sid``,
    ``side`` (the set's block) and ``leaves`` (all leaves of the set, ascending)."""
    every = leaves.groupBy("sid").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))  # at most runs * branches ^ levels
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = leaves.withColumn("side", F.pmod(F.xxhash64("sid", "leaf"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("leaf", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "sid", "side")
    return placed.join(every, "sid")


UNIT = ["leaf", "low", "high"]


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one unit after the other, from rows sorted by unit."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy() for c in UNIT])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        start = 0
        if rest and tuple(rest[-1].column(c)[0].as_py() for c in UNIT) != tuple(keys[0].tolist()):
            yield pa.Table.from_batches(rest)
            rest = []
        for cut in cuts.tolist():
            yield pa.Table.from_batches([*rest, batch.slice(start, cut - start)])
            rest, start = [], cut
        rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


def _fresh_pairs(unit: pa.Table, coordinates: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit that agree in enough coordinates and share no earlier leaf."""
    n = unit.num_rows
    sketches = np.frombuffer(b"".join(unit.column("sketch").to_pylist()), dtype="<u4").reshape(n, coordinates)
    low, high, leaf = (unit.column(c)[0].as_py() for c in ("low", "high", "leaf"))
    side = unit.column("side").to_numpy()
    left, right = (np.arange(n), np.arange(n)) if low == high else (np.flatnonzero(side == low), np.flatnonzero(side == high))
    agree = np.zeros((len(left), len(right)), dtype=np.int16)
    for c in range(coordinates):
        agree += sketches[left, c][:, None] == sketches[right, c][None, :]
    wanted = agree >= least
    if low == high:
        wanted &= left[:, None] < right[None, :]
    if wanted.any():
        holders = defaultdict(list)
        for i, ids in enumerate(unit.column("leaves").to_pylist()):
            for earlier in ids:
                if earlier >= leaf:
                    break
                holders[earlier].append(i)
        for members in holders.values():
            if len(members) > 1:
                a, b = np.isin(left, members), np.isin(right, members)
                wanted &= ~(a[:, None] & b[None, :])
    i, j = np.nonzero(wanted)
    return left[i], right[j]


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, exactly."""
    if len(a) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], dtype=np.int64)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, 2_048):
        part = slice(np.searchsorted(token, start), np.searchsorted(token, start + 2_048))
        holds = np.zeros((len(sets), 2_048), dtype=np.float32)
        holds[owner[part], token[part] - start] = 1
        common += holds @ holds.T
    return common[a, b].astype(np.int64)


def propose(rows: DataFrame, least: int, coordinates: int = COORDINATES) -> DataFrame:
    """The rows of ``units`` (with ``sketch``) that stand in a proposed pair."""
    kept = ["leaf", "low", "high", "sid", "side", "leaves"]

    def run(batches):
        for unit in _by_unit(batches):
            if unit.num_rows > 1:
                a, b = _fresh_pairs(unit, coordinates, least)
                if len(a):
                    yield from unit.select(kept).take(np.union1d(a, b)).combine_chunks().to_batches()

    sorted_rows = rows.repartition(*UNIT).sortWithinPartitions(*UNIT)
    return sorted_rows.mapInArrow(run, "leaf long, low int, high int, sid long, side int, leaves array<long>")


def confirm(rows: DataFrame, least: int, similarity: float, coordinates: int = COORDINATES) -> DataFrame:
    """Links inside units, by their whole sets (``tokens``): ``sid``, ``links`` (documents that the pairs counted
    here add, by ``copies``) and ``root``, the least set that it is connected to here."""

    def run(batches):
        for unit in _by_unit(batches):
            if unit.num_rows < 2:
                continue
            a, b = _fresh_pairs(unit, coordinates, least)
            sets = [np.frombuffer(t, dtype="<u8") for t in unit.column("tokens").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            both = _overlaps(sets, a, b)
            # both / union >= similarity, without a division; the slack is far below one token
            linked = both * (1 + similarity) >= similarity * (sizes[a] + sizes[b]) - 1e-9
            a, b = a[linked], b[linked]
            if len(a):
                copies, sids = unit.column("copies").to_numpy(), unit.column("sid").to_numpy()
                links = np.bincount(a, copies[b], len(sids)) + np.bincount(b, copies[a], len(sids))
                root = sids.copy()
                while True:
                    before = root.copy()
                    np.minimum.at(root, a, root[b])
                    np.minimum.at(root, b, root[a])
                    if (root == before).all():
                        break
                used = np.union1d(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(sids[used]), pa.array(links[used].astype(np.int64)), pa.array(root[used])], names=["sid", "links", "root"])

    sorted_rows = rows.repartition(*UNIT).sortWithinPartitions(*UNIT)
    return sorted_rows.mapInArrow(run, "sid long, links long, root long")


def token_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``sid`` and ``tokens`` of the wanted sets (``doc_id``, ``sid``, ``sketch``, ``copies``), from their documents' whole texts.
    Ids may repeat with other texts: a row meets a wanted set only if both its id and its set are that one's."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = split_by_filter(texts, wanted.select("doc_id"), "doc_id")[0]
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        seen = WordHashes()
        for batch in batches:
            made = {name: [] for name in schema.names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = shingles(text, seen, size)
                if len(tokens):
                    for name, value in zip(schema.names, (doc_id, _set_id(tokens), tokens.astype("<u8").tobytes())):
                        made[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    sets = texts.mapInArrow(run, "doc_id long, sid long, tokens binary").withColumn("_pair", F.xxhash64("doc_id", "sid"))
    sets = split_by_filter(sets, wanted.select(F.xxhash64("doc_id", "sid")), "_pair")[0].drop("_pair").dropDuplicates(["doc_id", "sid"])
    return sets.join(wanted, ["doc_id", "sid"]).select("sid", "sketch", "copies", "tokens")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of edges (``a``, ``b``), by alternating stars."""
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = scratch.write(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def _classes(docs: DataFrame, similarity: float, size: int, miss: float, block: int, id_col: str, text_col: str) -> DataFrame:
    """``join`` with ``sid`` and ``first_sid``, the set that the class's least id stands for (the least of its sets in the class)."""
    scratch = Scratch(docs.sparkSession)
    runs, least = runs_for(similarity, miss), least_agreeing(similarity)
    rows = scratch.write(signatures(docs, id_col, text_col, size), "signatures")
    nodes = scratch.write(rows.where("sid IS NOT NULL").groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "nodes")
    leaves = scratch.write(choose_leaves(nodes, runs, scratch, block=block), "leaves")
    scratch.keep(rows, nodes, leaves)
    placed = scratch.write(units(leaves, block), "units")
    proposed = scratch.write(propose(placed.join(nodes.select("sid", "sketch"), "sid"), least), "proposed")
    wanted = nodes.join(proposed.select("sid").distinct(), "sid")
    tokens = scratch.write(token_sets(docs, wanted, id_col, text_col, size), "tokens")
    confirmed = scratch.write(confirm(proposed.join(tokens, "sid"), least, similarity), "confirmed")
    scratch.keep(rows, nodes, confirmed)
    links = confirmed.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = components(confirmed.select(F.col("sid").alias("a"), F.col("root").alias("b")), scratch)
    named = nodes.join(links, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.select("sid", "copies", "doc_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sid").alias("root"))
    classes = named.groupBy("root").agg(F.min(F.struct("doc_id", "sid")).alias("first"), F.sum("copies").alias("class_size"))
    classes = classes.where("class_size > 1").select("root", F.col("first.doc_id").alias("class_id"), F.col("first.sid").alias("first_sid"), "class_size")
    known = named.join(classes, "root").select("sid", "class_id", "first_sid", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    known = scratch.write(known, "known")
    scratch.keep(rows, known)
    # rows without a word, and those alone in their class, need no join
    some, others = split_by_filter(rows.select("doc_id", "sid"), known.select("sid"), "sid")
    joined = some.join(known, "sid", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "sid", F.coalesce("first_sid", "sid").alias("first_sid"),
    )
    alone = others.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"), "sid", F.col("sid").alias("first_sid"))
    return joined.unionByName(alone)


def join(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, miss: float = TARGET_MISS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``class_id`` (the least id of all documents connected by links), ``n_links`` (other documents at
    least so similar, copies included) and ``class_size`` of every row."""
    return _classes(docs, similarity, size, miss, block, id_col, text_col).drop("sid", "first_sid")


def _sid_of(size: int):
    """A column function: the hash of a text's shingle set, null without a word or an id, as ``signatures`` has it."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        seen = WordHashes()
        for ids, texts in batches:
            sets = (shingles(text, seen, size) if doc_id is not None else () for doc_id, text in zip(ids.to_pylist(), texts.to_pylist()))
            yield pa.array([_set_id(tokens) if len(tokens) else None for tokens in sets], pa.int64())

    return F.arrow_udf(run, "long")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they were, with only one row of each class, of its least id (of its several rows with equal
    sets, the first in the order of their columns as JSON text); rows without an id, or without a word, stay. An id may stand for several texts: each row is judged by its id and its own set."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    classes = staged(_classes(docs, similarity, SHINGLE, TARGET_MISS, BLOCK, id_col, text_col).where("class_size > 1"), "classes")
    is_first = (F.col("doc_id") == F.col("class_id")) & (F.col("sid") == F.col("first_sid"))
    pairs = classes.groupBy(F.col("doc_id").alias("_id"), F.col("sid").alias("_sid")).agg(F.min(is_first).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    meant = staged(pairs.where("NOT _first OR _rows > 1"), "meant")
    repeated = meant.where("_first")
    # the documents as one column each, so that no name of theirs meets one of these
    rows = docs.select(F.struct(*columns).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def with_set(some: DataFrame) -> DataFrame:
        return some.withColumn("_sid", _sid_of(SHINGLE)(F.col("_id"), F.col("_text")))

    # only rows that may be meant are read again and travel to an exact join; the others stay where they are
    some, others = split_by_filter(rows, meant.select("_id"), "_id")
    once = with_set(some).join(meant, ["_id", "_sid"], "left_anti")
    again = split_by_filter(rows, repeated.select("_id"), "_id")[0]
    order = Window.partitionBy("_id", "_sid").orderBy(F.to_json("_row"))  # which row stays depends on the rows alone
    twice = with_set(again).join(repeated, ["_id", "_sid"], "left_semi").withColumn("_place", F.row_number().over(order)).where("_place = 1")
    kept = others.select("_row").unionByName(once.select("_row")).unionByName(twice.select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
