import os
import sys

import pytest
from instants import utc

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallygrid import build_session

    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def make_events(spark):
    """Events from (client, user, name, time text[, properties]) tuples."""
    from tallygrid.schemas import EVENTS

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            client, user, name, time = row[:4]
            properties = row[4] if len(row) > 4 else None
            full.append((str(i), client, user, name, properties, utc(time), utc(time)))
        return spark.createDataFrame(full, EVENTS)

    return build


@pytest.fixture
def registry(spark):
    """Tenants a (active), idle (active), off (inactive)."""
    from tallygrid.schemas import REGISTRY

    made = utc("2024-01-01")
    return spark.createDataFrame(
        [("a", "A", "h1", "o", 2, True, made), ("idle", "I", "h2", "o", 2, True, made), ("off", "O", "h3", "p", 2, False, made)],
        REGISTRY,
    )
