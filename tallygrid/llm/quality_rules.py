"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one ``failed``
bitmask (bit i: rule i failed). A policy is a named version of a set of rules, that is, a mask; what
it keeps, what each rule drops alone, and what a source fails are bitwise operations and aggregates
on the ledger, without another look at a text.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows are judged
each by itself; an empty table gives an empty ledger; other columns of the input are ignored unless
named in ``carry``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.llm.common import WORD, by_batch

SYMBOLS = "#*$%&|<>"

MEASURES = pa.schema(
    [
        ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_lines", pa.int64()),
        ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_letter_words", pa.int64()), ("longest_word", pa.int64()),
    ]
)

# rule -> SQL condition under which it fails; the place in this list is the rule's bit, so new rules go to the end
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_rate": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "few_letter_words": "10 * n_letter_words < 7 * n_words",
    "giant_word": "longest_word > 1000",
}

# policy version -> the rules that it applies; a version is never changed once it is used
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbol_rate", "duplicate_lines", "short_words", "long_words", "few_letter_words"),
    "v2_strict": tuple(RULES),
}


def mask(rules: tuple[str, ...] | list[str]) -> int:
    """The bits of some rules."""
    places = {name: i for i, name in enumerate(RULES)}
    return sum(1 << places[name] for name in set(rules))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
        repeated_words(words), sum(any(map(str.isalpha, w)) for w in words), max(map(len, words), default=0),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the ``carry`` columns, the measurements and ``failed``, a long with one bit per rule."""
    kept = [F.col(id_col).alias("doc_id"), *(F.col(c) for c in carry)]
    source = docs.select(*kept, F.col(text_col).alias("_text"))
    plain = source.select("doc_id", *carry).schema
    out = pa.schema([*_arrow_fields(plain), *MEASURES])

    def rows(columns: dict[str, list]) -> dict[str, list]:
        measured = list(zip(*map(measure, columns.pop("_text"))))
        return columns | {f.name: list(values) for f, values in zip(MEASURES, measured)}

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain), *(f"{f.name} long" for f in MEASURES)])
    measured = source.mapInArrow(by_batch(rows, out), ddl)
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(RULES.values())]
    return measured.withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def _arrow_fields(schema) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))


def fails(rules: tuple[str, ...] | list[str], failed: str = "failed") -> Column:
    """Whether any of the rules failed."""
    return F.col(failed).bitwiseAND(F.lit(mask(rules))) != 0


def apply_policy(ledger_rows: DataFrame, version: str, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """The ledger with ``policy`` and ``kept``."""
    return ledger_rows.withColumns({"policy": F.lit(version), "kept": ~fails(policies[version])})


def ablations(ledger_rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each policy and rule of it: documents kept by the policy, kept without that rule, and
    dropped by that rule alone. The ledger is first reduced to its distinct bitmasks."""
    patterns = ledger_rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(
        *[
            F.struct(F.lit(version).alias("policy"), F.lit(rule).alias("rule"), F.lit(mask(rules)).cast("long").alias("mask"), F.lit(mask([rule])).cast("long").alias("bit"))
            for version, rules in policies.items()
            for rule in rules
        ]
    )
    each = patterns.select("failed", "n", F.inline(cases))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        count(hit == 0).alias("kept"),
        count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
        count(hit == F.col("bit")).alias("dropped_alone"),
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("failed_rule"),
    )


def failure_summary(ledger_rows: DataFrame, *by: str) -> DataFrame:
    """Per group: rules that some document fails (``any_failed``) and that all documents fail (``all_failed``)."""
    return ledger_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"),
        F.avg(F.bit_count("failed")).alias("mean_failures"),
    )
