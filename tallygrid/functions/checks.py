"""Row checks that name every reason for a rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def failed(*checks: tuple[str, Column]) -> Column:
    """Texts of the checks whose condition is true, as an array."""
    texts = [F.when(bad, F.lit(text)) for text, bad in checks]
    return F.filter(F.array(*texts), lambda text: text.isNotNull())


def split_by_reasons(df: DataFrame, reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with at least one)."""
    clean = F.size(reasons) == 0
    return df.filter(clean).drop(reasons), df.filter(~clean)
