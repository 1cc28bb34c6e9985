"""Phrases, importance resampling and exact search against plain versions on small tables."""

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import importance_resampling as resampling
from tallygrid.llm import phrase_mining, segment_search
from tallygrid.llm.common import Scratch

LOWER = {c: c + 32 for c in range(65, 91)}


# --- phrases


def plain_phrases(rows, max_words=5, min_count=2, cover=100, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, held in counts.items():
        candidates = {p: f for p, f in held.items() if len(p) > 1 and f >= min_count}
        kept = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * f >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in candidates.items())
            if not inside:
                score, k = min((1000 * a * totals[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


TEXTS = [
    ("The old river, the old river! The OLD river runs\tby the old mill.", "en"), ("the old mill by the old river; a a a a a", "en"),
    ("", "en"), (None, "en"), (",.;:!?\n\r\x0b\x0c \t", None), ("über den fluss über den fluss ÜBER den fluss", None), ("über den fluss über den fluss ÜBER den fluss", None),
    ("a b a b a b x a b x", "en"), ("one two. three one two three one two three", "de"), ("one two three one two three", "de"),
]


def as_docs(documents, rows):
    return documents([(i, text, lang) for i, (text, lang) in enumerate(rows)])


@pytest.mark.parametrize("cover", [100, 60])
@pytest.mark.parametrize("bits", [phrase_mining.FILTER_BITS, 1])
def test_phrases_like_plain_version(llm_spark, documents, bits, cover):
    """Also with a bitmap so small that it lets everything through, and with chunks of a few words."""
    mined = phrase_mining.mine(as_docs(documents, TEXTS), min_count=2, cover=cover, bits=bits, chunk_words=7)
    assert sorted(tuple(r) for r in phrase_mining.best_phrases(mined).collect()) == plain_phrases(TEXTS, cover=cover)


def test_phrases_ties_top_and_lengths(llm_spark, documents):
    rows = [("p q. r s. t u", "en")] * 3 + [("p q r s t u v", "fr")] * 2
    mined = phrase_mining.mine(as_docs(documents, rows), max_words=3, min_count=2)
    assert sorted(tuple(r) for r in phrase_mining.best_phrases(mined, 2).collect()) == plain_phrases(rows, max_words=3, top=2)
    assert [r["phrase"] for r in phrase_mining.best_phrases(mined, 2).where("lang = 'en'").orderBy("rank").collect()] == ["p q", "r s"]
    with pytest.raises(ValueError):
        phrase_mining.mine(as_docs(documents, rows), max_words=1)


def test_phrases_of_a_long_text_and_of_none(llm_spark, documents):
    long = " ".join(f"w{i % 7} v{i % 3}" for i in range(30_000))
    rows = [(long, "en"), (long, "en")]
    mined = phrase_mining.mine(as_docs(documents, rows), min_count=4, chunk_words=1_000)
    assert sorted(tuple(r) for r in phrase_mining.best_phrases(mined).collect()) == plain_phrases(rows, min_count=4)
    empty = as_docs(documents, TEXTS).limit(0)
    assert phrase_mining.best_phrases(phrase_mining.mine(empty)).collect() == []


def test_phrase_counts_do_not_follow_the_files(llm_spark, documents):
    """A relation in many parts, a frequent phrase in each: the rows handed on are bounded by the cores, and the counts are whole."""
    parts = 16 * llm_spark.sparkContext.defaultParallelism
    relation = phrase_mining.occurrences(as_docs(documents, [("a b. c", "en")] * (4 * parts))).repartition(parts)
    made = phrase_mining.task_counts(relation, 2)
    assert {(r["lang"], r["phrase"]) for r in made.collect()} == {("en", "a b")}
    assert made.count() <= phrase_mining.COUNT_TASKS * llm_spark.sparkContext.defaultParallelism
    assert [tuple(r) for r in phrase_mining.count_phrases(relation, 2).collect()] == [("en", "a b", 4 * parts)]


def test_phrase_scores_beyond_64_bits(llm_spark):
    levels = llm_spark.createDataFrame([("en", "a b", 3 * 10**12)], "lang string, phrase string, f long")
    parts = llm_spark.createDataFrame([("en", "a", 4 * 10**12), ("en", "b", 5 * 10**12 + 1)], levels.schema)
    totals = llm_spark.createDataFrame([("en", 10**15)], "lang string, n long")
    row = phrase_mining.weakest_cuts(levels, parts, totals).first()
    assert row["score"] == 1000 * 3 * 10**12 * 10**15 // (4 * 10**12 * (5 * 10**12 + 1))


# --- importance resampling


def plain_resample(rows, target, share=10, least_words=20, least=1, most=1, buckets=10_000, seed=2024):
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    def features(text):
        w = words(text)
        return [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, text in rows for b in features(text)), Counter(b for text in target for b in features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    scored = []
    for place, (doc_id, text) in enumerate(rows):
        weight = sum(gain[b] for b in features(text))
        score = None
        if doc_id is not None:
            h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, len(features(text)), weight, score, place))
    able = sorted((r for r in scored if r[0] is not None and len(words(rows[r[4]][1])) >= least_words), key=lambda r: (-r[3], r[0]))
    rank = {r[4]: i + 1 for i, r in enumerate(able[: len(able) * share // 100])}
    return sorted(((*r[:4], rank.get(r[4])) for r in scored), key=repr)


CORPUS = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 40))) for i in range(120)]
CORPUS += [(500, None), (501, ""), (502, "\x00 -- !? "), (None, "W1 w2 " * 30), (7, CORPUS[7][1]), (7, "other w3 " * 40), (503, "Ärger İst 日本 w1-w2 " * 12), (504, "ab" * 100_000 + " w5" * 30)]
TARGET = ["w1 w2 w3 w1", None, "", "Ärger 日本 w22"]


@pytest.mark.parametrize("shape", [dict(), dict(share=55, least_words=3, least=1, most=3, buckets=97, seed=5), dict(share=100, least_words=0, least=2, most=2)])
def test_resampling_like_plain_version(llm_spark, documents, shape):
    target = llm_spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    made = resampling.resample(documents(CORPUS), target, range_rows=40, **shape)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == plain_resample(CORPUS, TARGET, **shape)


def test_resampling_hot_id_and_empty_tables(llm_spark, documents):
    target = llm_spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    rows = [(3, "w1 " * 25)] * 60 + [(i, f"w{i} " * 25) for i in range(10, 60)]
    made = resampling.resample(documents(rows), target, share=50, range_rows=8).collect()
    assert sorted(r["rank"] for r in made if r["rank"]) == list(range(1, 56)) and len(made) == 110
    assert sorted((tuple(r)[:4] for r in made), key=repr) == sorted((r[:4] for r in plain_resample(rows, ["w1 w2"])), key=repr)
    assert resampling.resample(documents(rows).limit(0), target).collect() == []
    alone = resampling.resample(documents(rows), target.limit(0), share=50).collect()
    assert sorted((tuple(r)[:4] for r in alone), key=repr) == sorted((r[:4] for r in plain_resample(rows, [])), key=repr)


def test_no_range_holds_a_hot_id_whole(llm_spark, documents):
    scratch = Scratch(llm_spark)
    rows = scratch.write(resampling.bucketed(documents([(3, "w1 " * 25)] * 400), "text", "doc_id"), "features")
    scored = rows.withColumns({"weight": F.lit(1).cast("long"), "score": F.lit(5).cast("long")})
    made = resampling.ranked(scored, scratch, range_rows=50)
    assert sorted(r["rank"] for r in made.collect()) == list(range(1, 401))
    numbered = scratch._paths[-1][0]
    assert max(r["count"] for r in numbered.groupBy("part").count().collect()) < 200


# --- exact search


def plain_search(rows, is_query, k=20, scale=64, dim=None):
    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    if dim is None:
        sizes = Counter(len(v) for _, v in sound)
        dim = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 1
    sound = [(i, v) for i, v in sound if len(v) == dim]
    best = defaultdict(dict)
    for q, a in sound:
        if is_query(q):
            best[q]
            for c, b in sound:
                if c != q:
                    score = sum(x * y for x, y in zip(a, b))
                    best[q][c] = max(best[q].get(c, score), score)
    return sorted((q, rank, c, s) for q, held in best.items() for rank, (c, s) in enumerate(sorted(held.items(), key=lambda m: (-m[1], m[0]))[:k], 1))


def vectors(spark, rows):
    full = [(i, v, "x", 1) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, query_id string, rank int")


def some_vectors():
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=12).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # many equal vectors
    rows += [(2000, (0.9 * np.array(rows[i][1])).tolist()) for i in range(30)]  # one id, many vectors
    rows += [(20, rows[77][1]), (20, rows[77][1]), (None, rows[1][1]), (2001, None), (2002, []), (2003, [None] * 12), (2004, [math.nan] * 12), (2005, [math.inf] * 12)]
    return rows + [(2020, [0.0] * 12), (2040, [1.0] * 5), (2060, [1e-9] * 12), (2080, [-1.0] * 12)]


@pytest.mark.parametrize("shape", [dict(part_rows=16, block_rows=4, sample_rows=50), dict(part_rows=1000, sample_rows=1), dict(resolutions=(3,)), dict(k=500)])
def test_search_like_brute_force(llm_spark, shape):
    rows = some_vectors()
    made = segment_search.search(vectors(llm_spark, rows), F.col("vec_id") % 20 == 0, **shape)
    assert sorted(tuple(r) for r in made.collect()) == plain_search(rows, lambda i: i % 20 == 0, k=shape.get("k", 20))


def test_search_with_one_repeated_id_finds_the_others(llm_spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, i / 100]) for i in range(30)] + [(i, [0.5, i / 100]) for i in range(2, 42)]
    made = segment_search.search(vectors(llm_spark, rows), F.col("vec_id") == 0).collect()
    assert sorted(tuple(r) for r in made) == plain_search(rows, lambda i: i == 0) and len(made) == 20


def test_search_few_rows_none_and_large_numbers(llm_spark):
    rows = [(20, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [-5.0, 1.0])]
    assert sorted(tuple(r) for r in segment_search.search(vectors(llm_spark, rows), F.col("vec_id") == 20).collect()) == plain_search(rows, lambda i: i == 20)
    assert segment_search.search(vectors(llm_spark, rows).limit(0), F.col("vec_id") == 20).collect() == []
    assert segment_search.search(vectors(llm_spark, rows), F.col("vec_id") == 9).collect() == []
    large = [(20, [3.0e6 + 0.3, -2.0e6]), (3, [4.0e6, 1.0e6 + 0.7]), (4, [-1.0e6, 9.0e6])]  # products beyond 2^53
    assert sorted(tuple(r) for r in segment_search.search(vectors(llm_spark, large), F.col("vec_id") == 20).collect()) == plain_search(large, lambda i: i == 20)


def test_bounds_never_lose_a_pair():
    random = np.random.default_rng(8)
    for spread in (1, 50, 5000):
        queries, others = (random.integers(-spread, spread + 1, (n, 24)) for n in (30, 200))
        exact = queries @ others.T
        least = np.sort(exact, axis=1)[:, -10]
        rows, columns = segment_search.survivors(queries, others, least)
        assert set(zip(*np.nonzero(exact >= least[:, None]))) <= set(zip(rows, columns))
        assert (segment_search.scores_of(queries, others, rows, columns) == exact[rows, columns]).all()
        for segments in segment_search.RESOLUTIONS:
            bound = segment_search.statistics(queries, segments) @ segment_search.statistics(others, segments).T
            assert (bound + 1e-6 * (1 + np.abs(bound)) >= exact).all()
