"""Importance resampling towards a target distribution, by hashed word features.

The tokenizers library's ``Split`` pre-tokenizer, which needs no training, cuts ASCII-lowered texts into words with offsets.
Windows over the offset pairs give the features: runs of ``least`` to ``most`` words joined by one space. A feature's bucket is the
CRC-32 of its bytes. Each text is tokenized once; its distinct buckets and their counts are written, so that the histograms
of the corpus and the sum of gains of every document need no second tokenization.

A bucket's gain compares its smoothed shares in target and corpus; a document's weight is the sum of gains over its features. Every
weight gets Gumbel noise from a hash of the id, so the highest sums are a draw without replacement in proportion to the
exponentials of the weights (thousandths), and the same one on every run. Ranks come from a range partitioning by score, whose
partitions are numbered one after the other: no task sorts more than its share, even if one id holds most rows.

Defined cases: a null text has no words; a text without features has weight 0; a null id is never drawn (its score is null);
rows that are equal in id and text are drawn each by itself, with equal scores; ties go to the smaller id, and rows of one id with
equal scores stand in any order, which shows in no column but those rows' own counts; an empty target or corpus gives gains by
smoothing alone; an empty table gives an empty result; other columns are ignored. What a task holds is a batch of texts, so a
very long text costs its own size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Regex, pre_tokenizers

from tallygrid.llm.common import Scratch

# fixed value: what counts as a word here, in text whose A-Z are lowered
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
SHARE = 10
#: features whose bucket a task remembers
CACHE = 200_000
#: rows of one range while ranks are given, about
RANGE_ROWS = 250_000


class Features:
    """Hashed word windows of texts, one text at a time."""

    def __init__(self, least: int = 1, most: int = 1, buckets: int = BUCKETS):
        self.least, self.most, self.buckets = least, most, buckets
        self.split = pre_tokenizers.Split(Regex(WORD_PATTERN), behavior="removed", invert=True)
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> tuple[str, list[tuple[int, int]]]:
        """The lowered text and the offsets of its words."""
        lowered = (text or "").encode().lower().decode()  # bytes lower A-Z alone
        return lowered, [offsets for _, offsets in self.split.pre_tokenize_str(lowered)]

    def windows(self, lowered: str, offsets: list[tuple[int, int]]) -> Iterator[str]:
        """All runs of ``least`` to ``most`` consecutive words."""
        words = [lowered[start:end] for start, end in offsets]
        for size in range(self.least, self.most + 1):
            if size == 1:
                yield from words
            else:
                yield from (" ".join(words[i : i + size]) for i in range(len(words) - size + 1))

    def bucket(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[feature] = crc32(feature.encode()) % self.buckets
        return found

    def histogram(self, text: str | None) -> tuple[int, dict[int, int]]:
        """The number of words, and how many features fall into each bucket."""
        lowered, offsets = self.words(text)
        held: Counter[int] = Counter()
        for feature, times in Counter(self.windows(lowered, offsets)).items():
            held[self.bucket(feature)] += times
        return len(offsets), held


def bucketed(table: DataFrame, text_col: str, id_col: str | None = None, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``buckets`` (rising) and ``times`` of every row; ``place`` numbers the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen = Features(least, most, buckets), 0
        for batch in batches:
            n_words, n_features, at, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                n, held = features.histogram(text)
                n_words.append(n)
                n_features.append(sum(held.values()))
                at.append(sorted(held))
                times.append([held[b] for b in at[-1]])
            place = np.arange(seen, seen + len(at))
            seen += len(at)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_words, n_features)), *(pa.array(c, pa.list_(pa.int32())) for c in (at, times)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets", "times", "place"])

    given = table.select((F.col(id_col) if id_col else F.lit(None)).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>, times array<int>, place long")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, the features of all rows that fall into it; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            at = batch.column("buckets").flatten().to_numpy(zero_copy_only=False)
            np.add.at(total, at, batch.column("times").flatten().to_numpy(zero_copy_only=False))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    return rows.select("buckets", "times").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``gain``, thousandths of the log ratio of smoothed shares, of every bucket; from two histograms."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    spark = corpus.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    summed = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = summed.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda name, more: F.col(name).cast("double") + float(more)
    ratio = real("t", 1) * real("all_s", buckets) / (real("s", 1) * real("all_t", buckets))
    return summed.join(F.broadcast(whole), how="cross").select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row is joined


def weigh(rows: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows with ``weight``, the sum of gains over their features, instead of the buckets."""
    table = np.zeros(buckets, dtype=np.int64)
    for row in gain.collect():  # a row a bucket
        table[row["bucket"]] = row["gain"]
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, times = (batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for name in ("buckets", "times"))
            ends = np.cumsum([0, *(len(b) for b in batch.column("buckets"))])
            sums = np.concatenate([[0], np.cumsum(shared.value[at] * times)])
            weight = sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "n_words", "n_features", "place")), pa.array(weight)], names=["doc_id", "n_words", "n_features", "place", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, place long, weight long")


def noise(id_col: str, seed: int = SEED):
    """Gumbel noise in thousandths, a function of the id and the seed."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def ranked(rows: DataFrame, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with ``rank`` (1, 2, 3 ... by falling score, then rising id) instead of ``place``.

    Ranges are cut by score, id and place, so equal rows may fall into several."""
    ranges = max(1, -(-rows.count() // range_rows))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("place")]
    sorted_rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the numbers that Spark gives rows: the partition in the upper bits, the place in it in the lower 33
    number = F.monotonically_increasing_id()
    numbered = scratch.write(sorted_rows.withColumns({"part": F.shiftright(number, 33), "at": number.bitwiseAND((1 << 33) - 1)}), "ranked")
    parts = numbered.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row a range
    return numbered.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("part", "before", "at", "place")


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, least: int = 1, most: int = 1,
    buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document; ``rank`` is null for those not drawn.

    Of the documents with ``least_words`` words or more, ``share`` percent (rounded down) are drawn."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(bucketed(docs, text_col, id_col, least, most, buckets), "features")
    gain = gains(histogram(rows, buckets), histogram(bucketed(target, target_col, None, least, most, buckets), buckets), buckets)
    scored = scratch.write(weigh(rows, gain, buckets).withColumn("score", F.col("weight") + noise("doc_id", seed)), "weights")
    scratch.drop(rows)
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = scored.where(able).count() * share // 100
    placed = ranked(scored.where(able), scratch, range_rows).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*columns).unionByName(rest.select(*columns))
