"""Access to the schema-less property text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_property(properties: Column, key: str) -> Column:
    """Top-level property as text; NULL for a missing key, JSON null or broken JSON."""
    if "'" in key:
        raise ValueError("property names may not contain quotes")
    return F.get_json_object(properties, f"$['{key}']")
