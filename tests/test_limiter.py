"""The sliced limiter against one run over all attempts."""

import random

import numpy as np
import pytest

from reqlens.streaming import limiter, state

SCHEMA = "key string, us long, seq long, status int"


def one_run(rows, limit):
    out, states = {}, {}
    for key, us, seq, status in sorted(rows, key=lambda r: (r[1], r[2])):
        own = states.setdefault(key, state.Limiter())
        refused = own.step(us, 0 if status is None else status, limit)
        out[seq] = (refused, own.count)
    return out


def judged(spark, rows, limit, **options):
    got = limiter.login_bursts(spark.createDataFrame(rows, SCHEMA).repartition(5), limit, **options).collect()
    assert len(got) == len(rows)
    return {r.seq: (r.blocked, r.failures) for r in got}


def attempts(seed, n, gaps, statuses, key="hot"):
    rng, us, rows = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(n):
        us += int(rng.choice(gaps) * 1_000_000)
        rows.append((key, us, i, rng.choice(statuses)))
    return rows


@pytest.mark.parametrize("seed", range(40))
def test_slices_lead_where_one_run_leads(seed):
    rng = random.Random(seed)
    rows = attempts(seed, 80, rng.choice([[0, 1, 3], [5, 20, 30], [0.001, 59, 60, 61]]), rng.choice([[401], [401, 401, 200], [401, 500, None, 204]]))
    us, status = np.array([r[1] for r in rows]), np.array([r[3] or 0 for r in rows])
    limit = rng.choice([1, 2, 5])
    part = limiter.Slice(us, status, limit)
    for at in range(len(rows)):
        own = state.Limiter()
        for u, s in zip(us[at:], status[at:], strict=True):
            own.step(int(u), int(s), limit)
        end = part.ends()[at]
        assert (end[0], end[1], max(end[2], us[-1])) == (own.count, own.start, max(own.until, us[-1]))
    cut = 40
    late = limiter.Slice(us[cut:], status[cut:], limit)
    for end, entry in zip(late.lead(limiter.Slice(us[:cut], status[:cut], limit).ends()), part.ends()[:cut], strict=True):
        assert (end[0], end[1], max(end[2], us[-1])) == (entry[0], entry[1], max(entry[2], us[-1]))


@pytest.mark.parametrize(("gaps", "statuses", "limit"), [([1], [401], 5), ([0, 2, 7], [401, 401, 401, 200], 3), ([13, 31, 59], [401, 500, None], 2)])
def test_hot_key_over_many_slices(spark, gaps, statuses, limit):
    rows = attempts(1, 2500, gaps, statuses)
    rows += [("other", us, seq + 10_000, status) for _, us, seq, status in attempts(2, 100, [1, 50, 200], [401, 200])]
    expected = one_run(rows, limit)
    assert judged(spark, rows, limit, slice_minutes=3) == expected
    assert judged(spark, rows, limit) == expected


def test_attempts_of_one_time_and_no_attempts(spark):
    rows = [("k", 5_000_000, i, 401) for i in range(9)] + [("k", 65_000_000, 20, 401), ("", 5_000_000, 21, 200)]
    assert judged(spark, rows, 0) == one_run(rows, state.MAX_FAILURES)
    assert judged(spark, [], 5) == {}
    with pytest.raises(ValueError):
        judged(spark, rows, 5, slice_minutes=2)
