"""Profiles and the least score follow every labelled text, however many there are."""

from pyspark.sql import functions as F

from tallygrid.llm import language_id


def test_profiles_count_every_text(llm_spark, documents):
    letters = [chr(0x4E00 + i) for i in range(20_500)]
    profiles = language_id.fit(documents([(i, letter, "zh") for i, letter in enumerate(letters)]), F.lit(True), size=100_000)
    assert {ord(letter) for letter in letters} <= set(profiles.codes.tolist())


def test_counts_held_in_parts_add_up(llm_spark, documents, monkeypatch):
    docs = documents([(i, f"some words of text {'abcdefgh'[i % 8] * 3}", "en" if i % 3 else "xx") for i in range(60)])
    whole = language_id.fit(docs, F.lit(True))
    monkeypatch.setattr(language_id, "HELD_COUNTS", 50)
    parts = language_id.fit(docs, F.lit(True))
    assert whole.languages == parts.languages and (whole.codes == parts.codes).all() and (whole.ranks == parts.ranks).all()


def test_least_score_judges_every_text(llm_spark, documents, monkeypatch):
    docs = documents([(i, "the quiet river runs along the old road", "en") for i in range(6_000)])
    profiles = language_id.fit(docs, F.lit(True))
    judged, predict = [], language_id.predict
    monkeypatch.setattr(language_id, "predict", lambda rows, *rest: judged.append(rows.count()) or predict(rows, *rest))
    assert language_id.least_score(docs, profiles, F.lit(True)) > 0 and judged == [6_000]
