"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned first: words and word beginnings with the odds at which they occur in toxic and in
other documents. The features of a text are densities of the lexicon, closeness of its strong entries
to a second person, rates of capitals and punctuation, and of words with signs or digits inside
(also read with these undone). Trees are grown on three quarters of the sample and calibrated on the
rest (calibrated scores come in few steps, so they keep a small share of the trees' score); a training row meets lexicon counts without its own share, so trees see the lexicon as new texts will.

The sample has at most about ``fit_rows`` labelled documents of each class, chosen by a hash of the id and
weighted back to their number. Only it is used for learning; all documents are scored, and read whole.

Defined cases: a null text is the empty text and is scored like any other; several labels of one document count as
toxic if one does; repeated rows are scored each; without labels of both classes every score is 0;
an empty table gives an empty result; other columns are ignored or, in ``reject_toxic``, kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.llm.common import WORD, staged

FIT_ROWS = 6_000
LEXICON_SIZE = 20_000
STEMS = range(3, 8)
LEAST_WEIGHT, STRONG = 1.5, 3.0
NEAR = 5
RAW_SHARE = 0.02
#: entries that one task holds before it passes its counts on
HELD_ENTRIES = 300_000
HELD_WORDS = 200_000

# fixed value: words that address somebody
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
# fixed value: signs that stand for letters
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

LETTERS = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"[^\W\d_][^\s\w'’.,;:!?()\"-]+[^\W\d_]|[^\W\d_][013457@$!]+[^\W\d_]")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){2,}[^\W\d_](?!\w)")

FEATURES = (
    "log_words", "strongest", "weight_density", "strong_entries", "strong_density", "near_second_person", "second_person_rate", "capitals",
    "capital_words", "exclamations", "punctuation", "obfuscated_rate", "obfuscated_strong",
)


def entries(word: str) -> list[str]:
    """The lexicon entries that a word (lower case) stands for: itself and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in STEMS if len(word) > n)]


def text_entries(text: str) -> set[str]:
    return {entry for word in set(LETTERS.findall(text.lower())) for entry in entries(word)}


def log_odds(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """How much likelier an entry is in a toxic document, as a logarithm, smoothed by half a document."""
    return math.log((pos + 0.5) / (n_pos - pos + 0.5)) - math.log((neg + 0.5) / (n_neg - neg + 0.5))


@dataclass
class Lexicon:
    """Documents of each class that hold an entry."""

    counts: dict[str, tuple[int, int]]
    n_pos: int
    n_neg: int

    def weight(self, word: str, label: int | None = None) -> float:
        """The largest weight of a word's entries; with a label, without the share of one document of that class."""
        best = 0.0
        for entry in entries(word):
            if entry in self.counts:
                pos, neg = self.counts[entry]
                if label is None:
                    best = max(best, log_odds(pos, neg, self.n_pos, self.n_neg))
                else:
                    best = max(best, log_odds(max(0, pos - label), max(0, neg - 1 + label), self.n_pos - label, self.n_neg - 1 + label))
        return best if best >= LEAST_WEIGHT else 0.0


class Weights(dict):
    """Weights of words, worked out once for each word while it is held."""

    def __init__(self, lexicon: Lexicon, label: int | None):
        super().__init__()
        self.lexicon, self.label = lexicon, label

    def __missing__(self, word: str) -> float:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = found = self.lexicon.weight(word, self.label)
        return found


def features(text: str | None, weights: Weights) -> list[float]:
    """The dense features of a text, in the order of FEATURES."""
    text = text or ""
    words = LETTERS.findall(text.lower())
    found = [weights[w] for w in words]
    n, chars = max(len(words), 1), max(len(text), 1)
    strong = [i for i, w in enumerate(found) if w >= STRONG]
    addressed = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in strong)
    raw = WORD.findall(text)
    hidden = [m.group() for m in SPACED.finditer(text)] + [w for w in raw if MIXED.search(w)]
    undone = [LETTERS.findall(h.lower().translate(LOOKALIKES)) for h in hidden]
    unmasked = sum(max((weights["".join(u)], *(weights[x] for x in u))) >= STRONG for u in undone if u)
    return [
        math.log1p(len(words)), max(found, default=0.0), sum(found) / n, math.log1p(len({words[i] for i in strong})), len(strong) / n,
        math.log1p(addressed), sum(w in SECOND_PERSON for w in words) / n, sum(map(str.isupper, text)) / chars,
        sum(map(str.isupper, raw)) / max(len(raw), 1), text.count("!") / chars, sum(map(text.count, ".,;:!?*#$%&|")) / chars,
        len(hidden) / max(len(raw), 1), math.log1p(unmasked),
    ]


@dataclass
class Model:
    """Lexicon, trees and calibration; without trees, every score is 0."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None


def draw(labels: DataFrame, training: Column, fit_rows: int, id_col: str, label_col: str) -> DataFrame:
    """The bounded sample: ``doc_id``, ``label`` and ``weight`` (documents of the class for each one drawn)."""
    known = labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    rows_of = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = {label: min(1.0, fit_rows / n) for label, n in rows_of.items()}
    by_class = lambda value: F.when(F.col("label") == 1, F.lit(value(share.get(1, 1.0)))).otherwise(F.lit(value(share.get(0, 1.0))))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < by_class(lambda s: s * 1_000_000)
    return known.where(drawn).select("doc_id", F.col("label").cast("int"), by_class(lambda s: 1.0 / s).alias("weight"))


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> Lexicon:
    """Entries whose odds speak for toxicity, counted over the sample (``text``, ``label``)."""

    def partial(batches):
        pos, neg = Counter(), Counter()

        def counted():
            names = list(pos.keys() | neg.keys())
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[k] for k in names], pa.int64()), pa.array([neg[k] for k in names], pa.int64())], names=["entry", "pos", "neg"])
            pos.clear(), neg.clear()
            return made

        for batch in batches:
            for text, label in zip(*batch.to_pydict().values()):
                (pos if label else neg).update(text_entries(text or ""))
                if len(pos) + len(neg) > HELD_ENTRIES:
                    yield counted()
        yield counted()

    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_pos, n_neg = total.get(1, 0), total.get(0, 0)
    counts = sample.select("text", "label").mapInArrow(partial, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (n_neg - F.col("neg") + 0.5))
    best = counts.where(F.col("pos") >= 3).withColumn("odds", odds).where(F.col("odds") >= LEAST_WEIGHT)
    rows = best.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "entry").limit(size).collect()
    return Lexicon({r["entry"]: (r["pos"], r["neg"]) for r in rows}, n_pos, n_neg)


def with_features(rows: DataFrame, lexicon: Lexicon, keep: str, label_col: str | None = None) -> DataFrame:
    """The ``keep`` column and ``features`` of ``text``; given a label, as a row that the lexicon has not seen."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    kind = rows.schema[keep].dataType.simpleString()
    columns = [keep, *([label_col, "weight"] if label_col else [])]

    def run(batches):
        held = {label: Weights(shared.value, label) for label in (None, 0, 1)}
        for batch in batches:
            labels = batch.column(label_col).to_pylist() if label_col else [None] * batch.num_rows
            made = [features(text, held[label]) for text, label in zip(batch.column("text").to_pylist(), labels)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(made, pa.list_(pa.float64()))], names=[*columns, "features"])

    ddl = f"{keep} {kind}, " + (f"{label_col} int, weight double, " if label_col else "") + "features array<double>"
    return rows.select(*columns, "text").mapInArrow(run, ddl).withColumn("features", array_to_vector("features"))


def fit(docs: DataFrame, labels: DataFrame, training: Column, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model learned from the labelled documents where ``training`` (over the labels' columns) holds."""
    drawn = F.broadcast(draw(labels, training, fit_rows, id_col, label_col))  # about 2 * fit_rows rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(drawn, "doc_id")
    # an id may stand for any number of rows: one of its texts is taken, the one of the least hash
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    texts = texts.groupBy("doc_id", "label", "weight").agg(first).select("doc_id", "label", "weight", "first.text")
    sample = staged(texts, "toxicity-sample").repartition(2 * sample_parts(docs), "doc_id")
    lexicon = learn_lexicon(sample)
    if not lexicon.n_pos or not lexicon.n_neg:
        return Model(lexicon, None, None)
    rows = staged(with_features(sample, lexicon, "doc_id", "label"), "toxicity-features")
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    grown, calibrating = rows.where(~held), rows.where(held)
    if grown.select("label").distinct().count() < 2 or calibrating.select("label").distinct().count() < 2:
        grown = calibrating = rows  # too few rows to set some apart
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=20, maxDepth=3, stepSize=0.3, seed=7).fit(grown.coalesce(2))
    raw = _raw_scores(trees, calibrating, "label", "weight")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw)
    return Model(lexicon, trees, calibration)


def sample_parts(docs: DataFrame) -> int:
    """Tasks for work on the bounded sample."""
    return max(1, min(16, docs.sparkSession.sparkContext.defaultParallelism))


def _raw_scores(trees: GBTClassificationModel, rows: DataFrame, *keep: str) -> DataFrame:
    return trees.transform(rows).select(*keep, vector_to_array("probability")[1].alias("raw"))


def _final(calibrated: str, raw: str) -> Column:
    """The calibrated score, with a small share of the trees' own so that its steps keep their order inside."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - RAW_SHARE) * F.col(calibrated) + RAW_SHARE * F.col(raw)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from a score of one half) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model.trees is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        raw = _raw_scores(model.trees, with_features(rows, model.lexicon, "doc_id"), "doc_id")
        calibrated = model.calibration.transform(raw)
        scored = calibrated.select("doc_id", _final("prediction", "raw").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, all columns as they were."""
    if model.trees is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model.lexicon)

    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = Weights(shared.value, None)
        for texts in batches:
            yield pa.array([features(text, weights) for text in texts.to_pylist()], pa.list_(pa.float64()))

    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), array_to_vector(measured(F.col(f"`{text_col}`"))).alias("features"))
    raw = _raw_scores(model.trees, whole, "doc")
    return model.calibration.transform(raw).where(_final("prediction", "raw") < 0.5).select(*[F.col("doc")[c].alias(c) for c in columns])
