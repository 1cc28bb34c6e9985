"""Registered queries against SQL, and the pipeline against plain steps."""

import corpus_pipeline
import public_tokenizers
import pytest
from oracle import _rows, connect
from plain import base_spans, near_copies
from pyspark.sql import functions as F

from tallygrid.llm import language_id, toxicity
from tallygrid.llm.common import fold, read_table
from tallygrid.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(llm_spark, name):
    frame = QUERIES[name](llm_spark, SF)
    cursor = connect(SF).execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, cursor.fetchall())


def test_entry_has_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)) and "pipeline" in names


def test_pipeline_like_plain_steps(llm_spark):
    docs = read_table(llm_spark, SF, "documents")
    profiles = language_id.fit(docs, fold("doc_id", 4) != 2)
    least = language_id.least_score(docs, profiles, fold("doc_id", 4) != 2)
    judged = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, profiles).collect()}
    left = docs.where(F.col("doc_id").isin([d for d, (lang, score) in judged.items() if lang != "und" and score >= least]))
    model = toxicity.fit(left, read_table(llm_spark, SF, "labels"), fold("doc_id", 5) != 0)
    toxic = {r["doc_id"] for r in toxicity.score(left, model).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] not in toxic]
    kept = {d for d, (cls, _, _) in near_copies(rows).items() if d == cls}
    made = corpus_pipeline.run(llm_spark, SF)
    assert {r["doc_id"] for r in made.select("doc_id").distinct().collect()} == kept
    assert 0 < len(kept) < len(rows) < docs.count() and public_tokenizers is not None


def test_stages_keep_columns_and_take_odd_tables(llm_spark, documents):
    docs = documents([(1, None), (2, ""), (3, "Write to a@b.cd or call +49 30 1234567 " * 20, "en"), (3, "Write to a@b.cd or call +49 30 1234567 " * 20, "en"), (4, "the quiet river runs along the old road to the sea", "en")])
    plain = docs.drop("shard", "kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(llm_spark, docs, SF).columns == docs.columns, name
        assert stage(llm_spark, plain.limit(0), SF).count() == 0, name
    masked = dict(corpus_pipeline.STAGES)["pii"](llm_spark, docs, SF).collect()
    assert all(not base_spans(r["text"]) for r in masked) and masked[0]["text"] is None


def test_language_stage_drops_junk_and_unlearned_languages(llm_spark):
    docs = read_table(llm_spark, "/root/testdata/sf0.01", "documents")
    planted = [
        (900_001, "qwrt zxcv bnmk plkj hgfd sdfg wrtz qzxw vbnm kljh gfds " * 3), (900_002, "Dzisiaj rano poszedłem do sklepu, żeby kupić świeży chleb i mleko dla całej rodziny, ale sklep był zamknięty."),
        (900_003, "asdkjh qwoeiu zxmcnb alskdj qpwoei zmxncb " * 9), (900_004, "123 456 --- !!!"), (900_005, "Сегодня утром я пошёл в магазин, чтобы купить хлеба и молока."), (900_006, None), (900_007, ""),
    ]
    extra = llm_spark.createDataFrame([(i, t, None, "planted", 0) for i, t in planted], docs.schema)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](llm_spark, docs.unionByName(extra), SF).select("doc_id").collect()}
    assert not kept & {i for i, _ in planted}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
