import sys

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm_spark(spark):
    from tallygrid.llm.common import prepare

    return prepare(spark)


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text[, lang]) tuples, with columns whose names clash with results."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src0", None, 7, "x") for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept string"
        return spark.createDataFrame(full, schema)

    return build
