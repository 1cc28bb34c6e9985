"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.llm import byte_bpe, chat_format, chosen_path, importance_resampling, kmeans_tree, language_id, packing, phrase_mining, pii, quality_rules, ring_sharding, segment_search, toxicity
from tallygrid.llm.common import fold, prepare, read_table
from tallygrid.llm.sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["QUERIES", "SQL"]


def query(build: Callable[[SparkSession, str], DataFrame]):
    """Register a query under the function's name."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v1."""
    rows = quality_rules.ledger(read_table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(rows, "v1").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.fails(quality_rules.POLICIES["base"]).alias("base_failed"), "kept", "failed",
    )


@query
def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule of every policy drops, alone and in all."""
    return quality_rules.ablations(quality_rules.ledger(read_table(spark, sf_dir, "documents")))


@query
def quality_rule_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that some and that all documents of a source fail."""
    return quality_rules.failure_summary(quality_rules.ledger(read_table(spark, sf_dir, "documents"), carry=("source",)), "source")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from profiles of three quarters of the ids."""
    docs = read_table(spark, sf_dir, "documents")
    profiles = language_id.fit(docs, fold("doc_id", 4) != 2)
    return language_id.predict(docs, profiles).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(read_table(spark, sf_dir, "documents"))
    base = F.concat(*[pii.span_texts(F.col(kind.name)) for kind in pii.KINDS if kind.base])
    every = F.concat(*[pii.span_texts(F.col(kind.name)) for kind in pii.KINDS])
    return found.select(
        "doc_id",
        *[F.size(kind.name).cast("long").alias(f"n_{kind.name}") for kind in pii.KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is full of control strings, formatted and read back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = chat_format.ordered_turns(chat_format.format_turns(rows, path, public_tokenizers.PATTERN))
    return chat_format.fold_conversations(turns, path, public_tokenizers.PATTERN).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


@query
def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return ring_sharding.assign(read_table(spark, sf_dir, "documents"), shards=24)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is, by a model of four fifths of the labels."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: five-word shingles, similarity of 0.8 or more."""
    return chosen_path.join(read_table(spark, sf_dir, "documents"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return kmeans_tree.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two to five words of every language."""
    return phrase_mining.best_phrases(phrase_mining.mine(read_table(spark, sf_dir, "documents")))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    return importance_resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op13_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector."""
    return segment_search.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
