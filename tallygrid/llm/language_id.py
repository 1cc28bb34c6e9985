"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (one to three letters inside a
word, blanks at its ends) in order of frequency. A document gets such a list too, and its distance
to a language is the sum, over the document's n-grams, of how far each is out of place in the
profile; an n-gram that the profile lacks counts as far as the profile is long. The nearest
language wins.

Profiles are counted from all training documents, and documents are always read whole. Counting n-grams combines inside each
task first, in parts of bounded size.

Defined cases: a null text, or one without a letter, gives ``und`` and score 0; so does every text if
there is nothing to learn from. Rows without a language or without letters teach nothing. Equal counts are ordered by
n-gram, equal distances by name. Repeated rows, extra columns and empty tables need no care.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.llm.common import by_batch

UNKNOWN = "und"
PROFILE_SIZE = 400
#: long texts are counted in pieces of so many characters, so that memory does not follow their length
PIECE = 200_000
#: n-grams with counts that a task holds before it adds them up
HELD_COUNTS = 2_000_000

_BITS = 21  # a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def _piece_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    points = np.where(_letters()[points], points, 32)
    points = np.concatenate(([32], points, [32]))
    blank = points == 32
    keep = np.concatenate(([True], ~(blank[1:] & blank[:-1])))
    points, blank = points[keep], blank[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = points[:-1] << _BITS | points[1:]
    triples = points[:-2] << 2 * _BITS | pairs[1:]
    return np.unique(np.concatenate((points[~blank], pairs, triples[~blank[1:-1]])), return_counts=True)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text, ascending, and how often each occurs."""
    text = text or ""
    if len(text) <= PIECE:
        return _piece_counts(text)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = 0
    while start < len(text):
        end = min(start + PIECE, len(text))
        while end < len(text) and text[end - 1].isalpha() and end - start < 2 * PIECE:
            end += 1  # pieces end between words; a "word" longer than a piece is cut
        more_codes, more = _piece_counts(text[start:end])
        codes, place = np.unique(np.concatenate((codes, more_codes)), return_inverse=True)
        counts = np.bincount(place, np.concatenate((counts, more)), len(codes)).astype(np.int64)
        start = end
    return codes, counts


def top_ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams: ``ranks[i, j]`` is the place of ``codes[i]`` in the profile of ``languages[j]``."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 minus its distance as a share of the largest one possible."""
        codes, counts = ngram_counts(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        top = top_ranked(codes, counts, self.size)
        place = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = self.codes[place] == top
        ranks = np.where(known[:, None], self.ranks[place], self.size)
        away = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (self.size * len(top)))


def make_profiles(ranked: dict[str, list[int]], size: int) -> Profiles:
    """Profiles from each language's n-grams in order of rank."""
    languages = tuple(sorted(ranked))
    codes = np.array(sorted({code for top in ranked.values() for code in top}), dtype=np.int64)
    ranks = np.full((len(codes), len(languages)), size, dtype=np.int64)
    for j, language in enumerate(languages):
        ranks[np.searchsorted(codes, np.array(ranked[language], dtype=np.int64)), j] = np.arange(len(ranked[language]))
    return Profiles(languages, codes, ranks, size)


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles learned from the rows where ``training`` holds."""
    labelled = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def added(parts):
        codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return codes, np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

    def partial(batches):
        for batch in batches:
            found, held = defaultdict(list), 0
            for lang, text in zip(*batch.to_pydict().values()):
                found[lang].append(ngram_counts(text))
                held += len(found[lang][-1][0])
                if held >= HELD_COUNTS:
                    found, held = defaultdict(list, {lang: [added(parts)] for lang, parts in found.items()}), 0
            for lang, parts in found.items():
                codes, counts = added(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    totals = rows.mapInArrow(partial, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    ranked = defaultdict(list)
    for row in totals.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        ranked[row["lang"]].append(row["code"])
    return make_profiles(ranked, size)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) of every document."""
    return _with_prediction(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")), profiles)


def _with_prediction(source: DataFrame, profiles: Profiles) -> DataFrame:
    model = source.sparkSession.sparkContext.broadcast(profiles)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def rows(columns: dict[str, list]) -> dict[str, list]:
        made = [model.value.predict(text) for text in columns["_text"]]
        return {"doc_id": columns["doc_id"], "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

    return source.mapInArrow(by_batch(rows, schema), "doc_id long, lang_pred string, score double")


def prediction(profiles: Profiles, spark) -> Callable[[Column], Column]:
    """A column function from a text to ``struct<lang_pred, score>``, to judge rows where they stand."""
    model = spark.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        made = [model.value.predict(text) for text in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["lang_pred", "score"])

    return judge


#: the share of labelled texts that may score below the mark, and how far below it a text of a learned language may still lie
LOW_SHARE, SLACK = 0.001, 0.85


def least_score(docs: DataFrame, profiles: Profiles, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The score below which a text is in none of the learned languages: ``SLACK`` times what all but ``LOW_SHARE`` of the labelled
    texts reach. Without such texts, 0."""
    labelled = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    scored = predict(labelled, profiles, id_col, text_col).where(F.col("lang_pred") != UNKNOWN)
    mark = scored.agg(F.percentile_approx("score", LOW_SHARE, 10_000).alias("mark")).first()["mark"]
    return SLACK * (mark or 0.0)


def reject_unknown(docs: DataFrame, profiles: Profiles, min_score: float = 0.05, text_col: str = "text") -> DataFrame:
    """The documents, all columns as they were, without those that are in none of the learned languages:
    no letters, or a score below ``min_score`` (see ``least_score``)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    judged = docs.select(F.struct(*columns).alias("_row"), prediction(profiles, docs.sparkSession)(F.col(f"`{text_col}`")).alias("_judged"))
    kept = judged.where((F.col("_judged.lang_pred") != UNKNOWN) & (F.col("_judged.score") >= min_score))
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
