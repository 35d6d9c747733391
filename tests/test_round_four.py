"""What the fourth review found."""

import bisect
import math
import random
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.operators import stats as S
from tidemark.plans import nulls as N
from tidemark.plans import pricing as E
from tidemark.queries import ORACLE, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import normal  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SEC, MIN = 1_000_000, 60_000_000


def test_latency_sweep_has_a_null_and_a_whole_summary(spark):
    """It once gave the signals' figures alone, without controls measured at each latency, and few of the summary's."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    got, want = normal(QUERIES["latency_sweep"](spark, SMALL).toPandas()), normal(con.sql(ORACLE["latency_sweep"]).df())
    assert {"signals", "share", "pre_mean", "spread_mean", "rush_se", "mid_se", "null_n", "null_mean", "null_se", "z"} <= set(got.columns)
    assert len(got) == 6 and (got["null_n"] > got["fwd_n"]).all() and (got["z"] != 0).all()
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-12)


def test_nulls_are_picked_at_each_latency(spark):
    """Beside loops over the signals: the first two draws that can be measured at a latency, of the signals measured at it."""
    rnd, delays, horizons, stale, wait = random.Random(4), (0, MIN, 30 * MIN), (5, 15), 300 * SEC, 120 * SEC
    stamps = sorted(rnd.randrange(0, 300) * MIN + rnd.randrange(MIN) for _ in range(260))
    stamps = [x for x in stamps if not 100 * MIN < x < 112 * MIN and not 200 * MIN < x < 215 * MIN]
    ticks = [("s", t, i, p := 100 + rnd.random(), p + 0.01) for i, t in enumerate(stamps)]
    tape = spark.createDataFrame(ticks, "symbol string, ts_us long, seq long, bid double, ask double")
    sig = [(i, "s", rnd.randrange(0, 300 * MIN), rnd.choice([1, -1])) for i in range(40)]
    signals = spark.createDataFrame(sig, "signal_id long, symbol string, when_us long, sign int")
    draw = {"per": 2, "tries": 5, "span_us": 60 * MIN, "exclude_us": 10 * MIN}

    def quote(when):
        i = bisect.bisect_right(stamps, when) - 1
        return (ticks[i][3] + ticks[i][4]) / 2 if i >= 0 and stamps[i] >= when - stale else None

    def forward(when, sign, delay):
        i = bisect.bisect_left(stamps, when + delay)
        exits = [quote(when + delay + h * MIN) for h in horizons]
        if i == len(stamps) or stamps[i] > when + delay + wait or None in (quote(when), quote(when - 15 * MIN), *exits):
            return None
        return [sign * math.log(m / ticks[i][4 if sign > 0 else 3]) * 1e4 for m in exits]

    tried, real, want = {}, {}, {}
    for r in sorted(N.draws(signals, **draw).collect(), key=lambda r: r["try"]):
        tried.setdefault(r.signal_id, []).append((r["try"], r.when_us))
    for i, _, when, sign in sig:
        for d in delays:
            if (x := forward(when, sign, d)) is not None:
                real |= {(i, d, h): v for h, v in zip(horizons, x)}
                found = [(t, y) for t, at in tried.get(i, []) if (y := forward(at, sign, d)) is not None][:2]
                want |= {(i, d, t, h): v for t, y in found for h, v in zip(horizons, y)}
    out, nulls = N.with_nulls(signals, lambda s, c: E.tick_outcomes(tape, s, horizons, delays, stale_us=stale, wait_us=wait, carry=c), **draw, each=("latency_us",))
    assert {(r.signal_id, r.latency_us, r.horizon): r.fwd_bps for r in out.collect()} == pytest.approx(real)
    assert {(r.source_id, r.latency_us, r["try"], r.horizon): r.fwd_bps for r in nulls.collect()} == pytest.approx(want)
    by = [{(i, t) for i, d, t, _ in want if d == x} for x in delays]
    assert min(map(len, by)) > 10 and by[0] != by[1] != by[2] != by[0]
    assert len({i for i, *_ in real}) > len(set.intersection(*[{i for i, d, _ in real if d == x} for x in delays]))


def test_a_null_that_is_not_a_number_stays_one(spark):
    """Filled with 0 it once read as a null without an edge; SQL's coalesce() keeps it."""
    rows = [("a", "x", 1, 6, 0.0, 0.0, 0.0, v, 0.0) for v in (1.0, 2.0)] + [("b", "y", 1, 6, 0.0, 0.0, 0.0, v, 0.0) for v in (1.0, 2.0)]
    out = spark.createDataFrame(rows, "arm string, signal_id string, sign int, horizon int, pre_bps double, spread_bps double, rush_bps double, fwd_bps double, fwd_mid_bps double")
    nulls = spark.createDataFrame([("a", 6, math.inf), ("a", 6, -math.inf)], "arm string, horizon int, fwd_bps double")
    got = {r.arm: r for r in S.arm_summary(out.select("arm", "signal_id"), out, nulls).collect()}
    assert got["a"].null_n == 2 and math.isnan(got["a"].null_mean) and math.isnan(got["a"].z)
    assert (got["b"].null_n, got["b"].null_mean, got["b"].null_se) == (0, 0.0, 0.0) and got["b"].z == pytest.approx(3.0)
