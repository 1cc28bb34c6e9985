import random

import pytest

from tallygrid.operators import ratelimit
from tallygrid.schemas import REQUESTS


def simulate(requests, limits, window=60, mode="per_request"):
    """Request by request, with an explicit list of stored entries per key."""
    stored, out = {}, {}
    for client, epoch, seq in sorted(requests):
        entries = [e for e in stored.get(client, []) if e > epoch - window]
        limit = limits.get(client, 1000)
        allowed = len(entries) < limit
        current = len(entries) + (1 if allowed else 0)
        if allowed and (mode == "per_request" or epoch not in entries):
            entries.append(epoch)
        stored[client] = entries
        out[client, epoch, seq] = (allowed, current, limit, max(0, limit - current), epoch + window)
    return out


def decided(df):
    return {(r["client_id"], r["epoch"], r["seq"]): (r["allowed"], r["current"], r["limit"], r["remaining"], r["reset_at"])
            for r in df.collect()}


def limits_frame(spark, limits):
    return spark.createDataFrame(list(limits.items()), "id string, rate_limit int")


def bursty(seed, keys=("a", "b", "hot"), n=300):
    rng = random.Random(seed)
    rows, clock = [], 1000
    for seq in range(n):
        clock += rng.choice([0, 0, 0, 0, 1, 1, 5, 30])
        rows.append((rng.choice(keys + ("hot",) * 3), clock, seq))
    return rows


@pytest.mark.parametrize("mode", ["per_request", "distinct_second"])
@pytest.mark.parametrize("block", [1_000_000, 7])
def test_equals_request_by_request(spark, monkeypatch, mode, block):
    monkeypatch.setattr(ratelimit, "SEQ_BLOCK", block)
    rows, limits = bursty(5), {"a": 3, "b": 1, "hot": 12}
    found = ratelimit.admit(spark.createDataFrame(rows, REQUESTS), limits_frame(spark, limits), mode=mode)
    assert decided(found) == simulate(rows, limits, mode=mode)


def test_hand_made(spark):
    rows = [("k", 100, 1), ("k", 100, 2), ("k", 100, 3), ("k", 130, 4), ("k", 159, 5), ("k", 160, 6), ("k", 161, 7), ("k", 162, 8)]
    found = decided(ratelimit.admit(spark.createDataFrame(rows, REQUESTS), limits_frame(spark, {"k": 2})))
    allowed = [found[r][0] for r in rows]
    # the two entries of second 100 leave at 160; the denied ones never counted
    assert allowed == [True, True, False, False, False, True, True, False]
    assert found["k", 100, 3] == (False, 2, 2, 0, 160)


def test_limit_reached_and_default_limit(spark):
    rows = [("k", 5, i) for i in range(11)] + [("free", 5, i) for i in range(11)]
    found = decided(ratelimit.admit(spark.createDataFrame(rows, REQUESTS), limits_frame(spark, {"k": 10})))
    assert [found["k", 5, i][0] for i in range(11)] == [True] * 10 + [False]
    assert found["free", 5, 10] == (True, 11, 1000, 989, 65)


def test_distinct_second_never_denies_above_sixty(spark):
    rows = [("k", s, s * 10 + i) for s in range(200) for i in range(3)]
    df, limits = spark.createDataFrame(rows, REQUESTS), limits_frame(spark, {"k": 61})
    assert ratelimit.admit(df, limits, mode="distinct_second").filter("not allowed").count() == 0
    assert ratelimit.admit(df, limits).filter("not allowed").count() > 0


@pytest.mark.parametrize("mode", ["per_request", "distinct_second"])
def test_carry_continues_a_log(spark, mode):
    rows, limits = bursty(9), {"a": 3, "b": 1, "hot": 12}
    frame = limits_frame(spark, limits)
    cut, carry, found = 150, None, {}
    for part in (rows[:cut], rows[cut:200], rows[200:]):
        admitted = ratelimit.admit(spark.createDataFrame(part, REQUESTS), frame, mode=mode, carry=carry)
        found.update(decided(admitted))
        carry = ratelimit.carry_after(admitted, carry, mode=mode)
        carry = spark.createDataFrame(carry.collect(), carry.schema)
    assert found == simulate(rows, limits, mode=mode)


def test_unknown_mode(spark):
    empty = spark.createDataFrame([], REQUESTS)
    with pytest.raises(ValueError):
        ratelimit.admit(empty, limits_frame(spark, {"k": 1}), mode="other")
    assert ratelimit.admit(empty, limits_frame(spark, {"k": 1})).count() == 0


@pytest.mark.parametrize("window", [60, 1000, 5000])
def test_attempts_across_slices(spark, window):
    rows = bursty(3, n=400) + [("a", s, 9000 + s) for s in (3540, 3541, 3599, 3600, 3659, 7199, 7200, 10800)]
    found = {(r["client_id"], r["epoch"]): r["in_window"]
             for r in ratelimit.attempt_rate(spark.createDataFrame(rows, REQUESTS), window).collect()}
    for (client, epoch), count in found.items():
        assert count == sum(1 for c, e, _ in rows if c == client and epoch - window < e <= epoch)
    assert set(found) == {(c, e) for c, e, _ in rows}


def test_notices(spark):
    rows = [("k", 5, 1), ("k", 5, 2)]
    admitted = ratelimit.admit(spark.createDataFrame(rows, REQUESTS), limits_frame(spark, {"k": 1}))
    assert [tuple(r) for r in ratelimit.limit_notices(admitted).collect()] == [("k", 1, 65)]
