"""Phrase collocations, mined set by set over sorted occurrence relations.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. The
relation of length k holds all occurrences of phrases of k words that may be frequent, sorted by piece and position: a row a
text, a line a run of words in one piece, and every k words in a row on a line are an occurrence. Two occurrences that
start side by side in a piece stand side by side on a line, so the merge join that extends the relation to the next length reads
each line once and never leaves a row. The groups are counted, the joined relation is semi-joined with the frequent ones, which breaks
its lines where an occurrence is not frequent, and written for the next length.

Groups are counted twice. First by a short hash of language and words: a hash that comes up less than ``min_count`` times stands for no
frequent phrase, and what is left is put into a bitmap of fixed size that is sent to the tasks for the semi-join. Then
the phrases themselves, in the relation that is left. The semi-join never misses a frequent phrase; an occurrence that it lets
through by chance costs room and is counted like any other, and exact counts below ``min_count`` fall out. So every
count is exact, whatever the bitmap's load. Only counts are shuffled, added up inside the tasks first.

``score`` is floor(1000 * a * n / (l * r)) for the cut with the least score (ties: the first cut), in decimal arithmetic of 38
digits, exact for up to 10^17 words. A candidate is dropped if a candidate one word longer holds it with
``100 * f >= cover * a``: any longer one that does so has such a one inside.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count again; equal scores
go by count, then by phrase in byte order; an empty table gives an empty result; other columns are ignored. A text is one
row, whatever its length, and a piece without a separator may be as long as its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.llm.common import Scratch

# fixed values: what ends a piece, what parts words
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_GAPS = b"\x20\x09"

MAX_WORDS = 5
MIN_COUNT = 100
COVER = 100
TOP = 2000
#: words that a task codes at once
CHUNK_WORDS = 1_000_000
#: bits of the hashes that groups are counted by first; two phrases with one hash only let more through
HASH_BITS = 40
#: groups whose counts a task holds before it hands them on
HELD_GROUPS = 500_000
#: tasks a core that count phrases by name: each hands on a row a frequent phrase, so their number must not follow the text
COUNT_TASKS = 2
#: bits of the semi-join's bitmap, whatever the number of phrases
FILTER_BITS = 1 << 26
_BITMAP = 32_768  # positions in one value of bitmap_construct_agg
_MIX = np.uint64(0x9E3779B97F4A7C15)

_LOWER = bytes(range(ord("a"), ord("z") + 1))
_CODED = bytes.maketrans(bytes(range(ord("A"), ord("Z") + 1)) + PIECE_ENDS + WORD_GAPS, _LOWER + b"\n" * len(PIECE_ENDS) + b" " * len(WORD_GAPS))

RELATION = "lang string, lines string, n long"


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of every piece of a text that has some."""
    found = (piece.split() for piece in (text or "").encode().translate(_CODED).split(b"\n"))
    return [words for words in found if words]


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The relation of single words: ``lines``, a line a piece, and ``n``, the words of each text that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sizes = [], []
            for text in batch.column("text").to_pylist():
                words = pieces(text)
                lines.append(b"\n".join([b" ".join(piece) for piece in words]))
                sizes.append(sum(map(len, words)))
            made = pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(lines, pa.string()), pa.array(sizes, pa.int64())], names=["lang", "lines", "n"])
            yield made.filter(pc.greater(made.column("n"), 0))

    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, RELATION)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Chunk:
    """Rows of a relation: their words one after the other, and the line and the row of each."""

    langs: pa.Array
    words: pa.Array
    line: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, langs: pa.Array, texts: pa.Array) -> Chunk:
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        line_of_word = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        row_of_line = np.repeat(np.arange(len(lines)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
        return cls(langs, words.flatten(), line_of_word, row_of_line[line_of_word])

    def joined(self, length: int) -> np.ndarray:
        """Where occurrences of ``length`` words begin: so many words stand on one line."""
        ahead = length - 1
        return np.flatnonzero(self.line[ahead:] == self.line[: len(self.line) - ahead])

    @cached_property
    def coded(self) -> tuple[np.ndarray, int]:
        """A number for every word and language, and how many numbers there are."""
        langs, words = self.langs.dictionary_encode(), self.words.dictionary_encode()
        vocabulary = max(len(words.dictionary), 1)
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.row]
        return lang * vocabulary + words.indices.to_numpy(zero_copy_only=False), vocabulary * max(len(langs.dictionary), 1)

    def hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        """A hash of ``HASH_BITS`` bits of the language and the words of each occurrence, the same in every task."""
        digests = lambda texts: np.array([xxhash.xxh3_64_intdigest(t) for t in texts.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        langs, words = self.langs.dictionary_encode(), self.words.dictionary_encode()
        word = digests(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        made = digests(langs.dictionary)[langs.indices.to_numpy(zero_copy_only=False)][self.row[starts]]
        for ahead in range(length):
            made = (made ^ word[starts + ahead]) * _MIX
            made ^= made >> np.uint64(29)
        return (made >> np.uint64(64 - HASH_BITS)).view(np.int64)

    def grouped(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence the number of its phrase, and for each phrase where it begins first."""
        code, base = self.coded
        made, size = code[starts], base
        for ahead in range(1, length):
            if size * base >= 1 << 62:  # numbers get too long: number anew
                made, distinct = pd.factorize(made)
                size = len(distinct)
            made, size = made * base + code[starts + ahead], size * base
        number, distinct = pd.factorize(made)
        first = np.empty(len(distinct), dtype=np.int64)
        first[number[::-1]] = starts[::-1]
        return number, first

    def phrases(self, first: np.ndarray, length: int) -> tuple[pa.Array, pa.Array]:
        """Language and text of the phrases that begin at ``first``."""
        parts = [self.words.take(pa.array(first + ahead)) for ahead in range(length)]
        text = pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0]
        return self.langs.take(pa.array(self.row[first])), text

    def runs(self, starts: np.ndarray, length: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Languages, lines and words of the rows that are left when only the occurrences at ``starts`` are."""
        opens = np.ones(len(starts), dtype=bool)
        opens[1:] = (starts[1:] != starts[:-1] + 1) | (self.line[starts[1:]] != self.line[starts[:-1]])
        first = np.flatnonzero(opens)
        begin, sizes = starts[first], np.diff(np.append(first, len(starts))) + length - 1
        lists = lambda values, counts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
        lines = pc.binary_join(lists(self.words.take(pa.array(_spread(begin, sizes))), sizes), " ")
        rows, line_counts = np.unique(self.row[begin], return_counts=True)
        words = np.add.reduceat(sizes, np.concatenate([[0], np.cumsum(line_counts)[:-1]]))
        return self.langs.take(pa.array(rows)), pc.binary_join(lists(lines, line_counts), "\n"), words


def chunks(batches: Iterator[pa.RecordBatch], chunk_words: int) -> Iterator[Chunk]:
    """The rows of a task, some ``chunk_words`` words at a time."""
    held, size = [], 0

    def made() -> Chunk:
        table = pa.Table.from_batches(held).combine_chunks()
        return Chunk.of(*(pa.concat_arrays(table.column(name).chunks) for name in ("lang", "lines")))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(batch.column("n")).as_py()
        if size >= chunk_words:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def added(parts: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The counts ``n`` of a task's chunks added up by key and in order of keys, in which they pack best; about ``HELD_GROUPS`` are held at most."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])

    def handed(table: pa.Table) -> list[pa.RecordBatch]:
        return table.sort_by([(key, "ascending") for key in keys]).to_batches(max_chunksize=50_000)

    held: list[pa.Table] = []
    size = 0
    for part in parts:
        held.append(part)
        size += part.num_rows
        if size >= HELD_GROUPS:
            held = [summed(held)]
            size = held[0].num_rows
            if size >= HELD_GROUPS // 2:  # little falls together: hand them on
                yield from handed(held[0])
                held, size = [], 0
    if held:
        yield from handed(summed(held))


def frequent_bitmap(relation: DataFrame, length: int, min_count: int = MIN_COUNT, bits: int = FILTER_BITS, chunk_words: int = CHUNK_WORDS) -> Broadcast:
    """A bitmap of the hashes that ``min_count`` or more occurrences of ``length`` words have, ``bits`` in size, on all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for chunk in chunks(batches, chunk_words):
            number, distinct = pd.factorize(chunk.hashes(chunk.joined(length), length))
            yield pa.table({"hash": pa.array(distinct), "n": pa.array(np.bincount(number, minlength=len(distinct)).astype(np.int64))})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(run(batches), ["hash"])

    counted = relation.mapInArrow(summed, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    placed = counted.select(F.pmod("hash", F.lit(bits)).alias("at"))
    parts = placed.groupBy(F.floor(F.col("at") / _BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % _BITMAP).alias("bits"))
    bitmap = np.zeros(max(bits, _BITMAP) // 8, dtype=np.uint8)
    for row in parts.collect():  # at most bits / 32,768 rows of 4 kB
        start = row["part"] * _BITMAP // 8
        bitmap[start : start + len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
    return relation.sparkSession.sparkContext.broadcast(bitmap)


def keep_frequent(relation: DataFrame, length: int, bitmap: Broadcast, bits: int = FILTER_BITS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The relation of ``length`` words: the one of a word less joined with itself, semi-joined with the frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, chunk_words):
            starts = chunk.joined(length)
            place = chunk.hashes(starts, length) % bits
            known = (bitmap.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            if known.any():
                langs, lines, words = chunk.runs(starts[known], length)
                yield pa.RecordBatch.from_arrays([langs, lines, pa.array(words.astype(np.int64))], names=["lang", "lines", "n"])

    return relation.mapInArrow(run, RELATION)


def task_counts(relation: DataFrame, length: int, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``lang``, ``phrase`` and ``n``, each task's count of the phrases of ``length`` words in its part of their relation.

    A frequent phrase stands in about every file, so a task a file would make rows by phrases times files, and both grow with the text.
    ``COUNT_TASKS`` tasks a core read all files between them, a chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for chunk in chunks(batches, chunk_words):
            number, first = chunk.grouped(chunk.joined(length), length)
            langs, texts = chunk.phrases(first, length)
            yield pa.table({"lang": langs, "phrase": texts, "n": pa.array(np.bincount(number, minlength=len(first)).astype(np.int64))})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(run(batches), ["lang", "phrase"])

    few = relation.coalesce(COUNT_TASKS * relation.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(summed, "lang string, phrase string, n long")


def count_phrases(relation: DataFrame, length: int, min_count: int = MIN_COUNT, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``lang``, ``phrase`` and ``f`` of the frequent phrases of ``length`` words, from their relation."""
    counted = task_counts(relation, length, chunk_words)
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)


def frequent_phrases(docs: DataFrame, scratch: Scratch, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, bits: int = FILTER_BITS, chunk_words: int = CHUNK_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of every length from 1 on (``lang``, ``phrase``, ``f``), and ``n``, the words of each language."""
    relation = scratch.write(occurrences(docs), "occurrences")
    totals = scratch.write(relation.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    levels = []
    for length in range(1, max_words + 1):
        bitmap = frequent_bitmap(relation, length, min_count, bits, chunk_words)
        joined = scratch.write(keep_frequent(relation, length, bitmap, bits, chunk_words), f"occurrences-{length}")
        scratch.drop(relation)
        bitmap.unpersist()
        relation = joined
        levels.append(scratch.write(count_phrases(relation, length, min_count, chunk_words), f"phrases-{length}"))
    scratch.drop(relation)
    return levels, totals


def weakest_cuts(candidates: DataFrame, phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of every candidate at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    for name, count in (("first", "l"), ("rest", "r")):
        cut = cut.join(phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)), ["lang", name])
    wide = lambda name: F.col(name).cast("decimal(38,0)")
    cut = cut.join(totals, "lang").withColumns({"over": F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n"), "under": wide("l") * wide("r")})
    scored = cut.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def covered(levels: list[DataFrame]) -> DataFrame:
    """``lang``, ``phrase`` and ``inside``, the count of the most frequent longer candidate (levels of two words on) that holds the phrase."""
    made = []
    for longer in levels[1:]:
        words = F.split("phrase", " ")
        less = F.size(words) - 1
        both = F.array(F.array_join(F.slice(words, F.lit(1), less), " "), F.array_join(F.slice(words, F.lit(2), less), " "))
        made.append(longer.select("lang", F.explode(both).alias("phrase"), "f"))
    return reduce(DataFrame.unionByName, made).groupBy("lang", "phrase").agg(F.max("f").alias("inside"))


def mine(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, cover: int = COVER, bits: int = FILTER_BITS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """All candidates that are not covered: ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``."""
    if max_words < 2:
        raise ValueError("phrases have at least two words")
    scratch = Scratch(docs.sparkSession)
    levels, totals = frequent_phrases(docs, scratch, max_words, min_count, bits, chunk_words)
    candidates = reduce(DataFrame.unionByName, levels[1:])
    scored = weakest_cuts(candidates, reduce(DataFrame.unionByName, levels), totals)
    if max_words > 2:
        scored = scored.join(covered(levels[1:]), ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("inside") < F.lit(cover) * F.col("a"), F.lit(True)))
    return scored.select("lang", "phrase", "a", "l", "r", "n", "score")


def best_phrases(mined: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their ``rank``; every task cuts its own before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = mined.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
