"""Event-study operators on small exact fixtures and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import prices as P
from tidemark.functions import text as T
from tidemark.functions import times as C
from tidemark.operators import asof, documents, features, labels, ledger, stats
from tidemark.plans import nulls, pricing, scoring
from tidemark.schema import MINUTE, SECOND, numbered

S = SECOND


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


# ------------------------------------------------------------------ as-of


@pytest.mark.parametrize("direction", [asof.BACKWARD, asof.FORWARD])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_brute_force_at_any_bucket(spark, direction, strict):
    rng = random.Random(1)
    ticks = sorted((s, rng.randrange(300), 0) for s in "ab" for _ in range(60))
    ticks = [(s, t, i, float(i)) for i, (s, t, _) in enumerate(ticks)]
    probes = [(i, rng.choice(["a", "b", "c", None]), rng.choice([rng.randrange(-20, 320), ticks[rng.randrange(120)][1]])) for i in range(150)] + [(900, "a", None)]
    tape = spark.createDataFrame(ticks, "symbol string, ts_us long, seq long, bid double").repartition(3)
    asked = spark.createDataFrame(probes, "id long, symbol string, when_us long")
    for bucket in (None, 1, 64):
        got = {r.id: r.q_seq for r in asof.bounded_asof(tape, asked, 9, direction, strict, bucket, ("bid",)).collect()}
        assert len(got) == len(probes)
        for i, s, w in probes:
            if w is None:
                assert got[i] is None
                continue
            if direction == asof.BACKWARD:
                fit = [(t, q) for y, t, q, _ in ticks if y == s and w - 9 <= t and (t < w if strict else t <= w)]
                want = max(fit)[1] if fit else None
            else:
                fit = [(t, q) for y, t, q, _ in ticks if y == s and t <= w + 9 and (t > w if strict else t >= w)]
                want = min(fit)[1] if fit else None
            assert got[i] == want


def test_asof_empty(spark):
    tape = spark.createDataFrame([], "symbol string, ts_us long, seq long, bid double")
    asked = spark.createDataFrame([(1, "a", 5)], "id long, symbol string, when_us long")
    assert asof.bounded_asof(tape, asked, 9, values=("bid",)).first().q_bid is None
    assert asof.bounded_asof(tape, asked.limit(0), 9, values=("bid",)).count() == 0


def test_numbering_is_dense_over_buckets(spark):
    rows = spark.range(500).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 500).alias("t"))
    got = sorted((r.t, r.seq) for r in numbered(rows, "k", ["t"], F.floor(F.col("t") / 40)).collect())
    assert got == [(i, i) for i in range(500)]


# --------------------------------------------------------------- features


def test_features_are_the_same_in_any_block(spark):
    rng, rows, x = random.Random(2), [], 100.0
    for i in range(900):
        x *= math.exp(rng.gauss(0, 0.001)) if i % 9 else 1.0
        rows.append(("s", i, i * S, x * 0.9999, x * 1.0001, x, float(rng.randrange(1, 9)), float(rng.randrange(1, 5)), 2.0))
    t = spark.createDataFrame(rows, "symbol string, seq long, ts_us long, bid double, ask double, last double, volume double, bid_size double, ask_size double")
    a = {r.seq: r for r in features.tape_features(t).collect()}
    b = {r.seq: r for r in features.tape_features(t, size=700, halo=640).collect()}
    assert set(a) == set(b) == set(range(59, 900))
    mids = [(r[3] + r[4]) / 2 for r in rows]
    rets = [math.log(q / p) for p, q in zip(mids, mids[1:])]
    var = None
    for i, r in enumerate(rets):
        var = r * r if var is None else 0.94 * var + 0.06 * r * r
        if i + 1 >= 59:
            g = a[i + 1]
            assert g.vol_bps == pytest.approx(math.sqrt(var) * 1e4) and b[i + 1].vol_bps == pytest.approx(g.vol_bps)
            run = 0
            for v in reversed(rets[: i + 1]):
                if v == 0 or (run and (v > 0) != (run > 0)):
                    break
                run += 1 if v > 0 else -1
            assert g.run_length == run == b[i + 1].run_length


def test_features_pass_over_ticks_without_a_price(spark):
    """Zero and negative mids: no return into or out of them, the latest return stands again."""
    rng, rows, x = random.Random(5), [], 100.0
    for i in range(400):
        x *= math.exp(rng.gauss(0, 0.001))
        m = x if i % 11 or i < 3 else rng.choice([0.0, -1.0])
        rows.append(("s", i, i * S, m - 0.001, m + 0.001, m, 1.0 + i % 3, 1.0, 2.0))
    t = spark.createDataFrame(rows, "symbol string, seq long, ts_us long, bid double, ask double, last double, volume double, bid_size double, ask_size double")
    got = {r.seq: r for r in features.tape_features(t).collect()}
    known, var = [], None
    for i, r in enumerate(rows):
        before = (rows[i - 1][3] + rows[i - 1][4]) / 2 if i else 0.0
        now = (r[3] + r[4]) / 2
        if before > 0 and now > 0:
            known.append(math.log(now / before))
        if known:
            var = known[-1] ** 2 if var is None else 0.94 * var + 0.06 * known[-1] ** 2
        if i >= 59:
            g = got[i]
            assert g.ret_1_bps == pytest.approx(known[-1] * 1e4) and g.ret_15_bps == pytest.approx(sum(known[-15:]) * 1e4)
            assert g.vol_bps == pytest.approx(math.sqrt(var) * 1e4) and g.up_fraction == pytest.approx(sum(v > 0 for v in known[-10:]) / 10)
            run = 0
            for v in reversed(known[-120:]):
                if run and (v > 0) != (run > 0):
                    break
                run += 1 if v > 0 else -1
            assert g.run_length == run
    assert features.volatility_spikes(t).count() > 0


def test_bands_and_phrases(spark):
    assert one(spark, *[P.band(F.lit(x), "move") for x in (-2.0, -2.1, 0.3, 2.0, 1.99)])[:] == ("falling", "falling hard", "drifting up", "rising hard", "rising")
    assert one(spark, P.band(F.lit(None).cast("double"), "move"), P.streak(F.lit(0)), P.streak(F.lit(-1)), P.streak(F.lit(3)))[:] == (None, "no streak", "1 consecutive down tick", "3 consecutive up ticks")
    assert one(spark, P.balance(F.lit(0.25)), P.balance(F.lit(0.35)))[:] == ("2 of the last 10 snapshots closed higher", "4 of the last 10 snapshots closed higher")
    assert one(spark, P.log_bps(F.lit(0.0), F.lit(1.0)), P.spread_bps(F.lit(0.0), F.lit(0.0)))[:] == (None, 0.0)


# ---------------------------------------------------------------- pricing


def test_tick_pricing_pays_the_side_and_drops_whole(spark):
    m = 60
    ticks = [("s", t * S, i, 100.0 + t / m, 100.02 + t / m) for i, t in enumerate(range(0, 90 * m, 60))]
    tape = spark.createDataFrame(ticks, "symbol string, ts_us long, seq long, bid double, ask double")
    sig = spark.createDataFrame([(1, "s", 20 * m * S, 1), (2, "s", 20 * m * S, -1), (3, "s", 85 * m * S, 1), (4, "zz", 20 * m * S, 1)], "signal_id long, symbol string, when_us long, sign int")
    got = {(r.signal_id, r.horizon): r for r in pricing.tick_outcomes(tape, sig, (5, 15)).collect()}
    assert {i for i, _ in got} == {1, 2}
    mid = lambda t: 100.01 + t
    r = got[1, 5]
    assert r.entry_ts_us == 21 * m * S and r.entry_px == pytest.approx(121.02)
    assert r.fwd_bps == pytest.approx(math.log(mid(25) / 121.02) * 1e4) and r.pre_bps == pytest.approx(math.log(mid(20) / mid(5)) * 1e4)
    assert got[2, 5].entry_px == pytest.approx(121.0) and got[2, 5].rush_bps == pytest.approx(-r.rush_bps)


def test_bar_gap_drops_the_signal(spark):
    bar = 5 * MINUTE
    ts = [i for i in range(40) if i != 30]
    bars = spark.createDataFrame([("s", i * bar, n, 100.0, 110.0 if i >= 12 else 100.0) for n, i in enumerate(ts)], "symbol string, ts_us long, seq long, open double, close double")
    sig = spark.createDataFrame([(1, "s", 10 * bar + 5, 1), (2, "s", 27 * bar + 5, 1), (3, "s", 29 * bar + 5, 1)], "signal_id long, symbol string, when_us long, sign int")
    adjacent = {r.signal_id for r in pricing.bar_outcomes(bars, sig, bar, (5, 15), 15 * MINUTE).collect()}
    loose = {r.signal_id for r in pricing.bar_outcomes(bars, sig, bar, (5, 15), 15 * MINUTE, require_adjacent=False).collect()}
    assert adjacent == {1} and loose == {1, 3}
    got = {r.horizon: r.fwd_bps for r in pricing.bar_outcomes(bars, sig.filter("signal_id = 1"), bar, (5, 7, 15), 15 * MINUTE).collect()}
    assert got[5] == 0 and got[7] == pytest.approx(math.log(1.1) * 1e4) == got[15]


def test_two_sided_drops_padding(spark):
    side = lambda rows: spark.createDataFrame(rows, "symbol string, ts_us long, open double, close double, volume double")
    got = pricing.two_sided(side([("s", 0, 1.0, 1.0, 1.0), ("s", 1, 1.0, 1.0, 0.0), ("s", 2, 1.0, 1.0, 1.0)]), side([("s", 0, 3.0, 5.0, 1.0), ("s", 1, 1.0, 1.0, 1.0)]))
    assert [(r.ts_us, r.mid_open, r.mid_close) for r in got.collect()] == [(0, 2.0, 3.0)]


def test_grid_fills_forward(spark):
    bars = spark.createDataFrame([("s", 0, 1.0, 2.0), ("s", 3 * MINUTE, 0.0, 4.0)], "symbol string, ts_us long, open double, close double")
    got = [(r.seq, r.open, r.close, r.real) for r in pricing.gridded(bars, MINUTE).orderBy("seq").collect()]
    assert got == [(0, 1.0, 2.0, True), (1, 2.0, 2.0, False), (2, 2.0, 2.0, False), (3, 2.0, 4.0, True)]


def test_ordered_source(spark):
    bars = spark.createDataFrame([("s", t, v) for v, ts in (("b", (1, 2, 3)), ("a", (1, 2)), ("c", (1, 2, 3, 4))) for t in ts], "symbol string, ts_us long, venue string")
    sig = spark.createDataFrame([(1, "s", 2), (2, "s", 500)], "signal_id long, symbol string, when_us long")
    assert {r.signal_id: r.venue for r in pricing.ordered_source(bars, sig, ["a", "b", "c"], 10).collect()} == {1: "b", 2: None}


def test_draws_ignore_partitioning_and_keep_away(spark):
    sig = spark.createDataFrame([(i, "s", 10**15, 1) for i in range(40)], "signal_id long, symbol string, when_us long, sign int")
    a = sorted(map(tuple, nulls.draws(sig.repartition(1)).collect()))
    assert a == sorted(map(tuple, nulls.draws(sig.repartition(9)).collect()))
    gaps = [abs(r[2] - 10**15) for r in a]
    assert min(gaps) >= 3 * 3600 * S and max(gaps) <= 5 * 86400 * S
    assert nulls.unconditioned(sig).count() == 40


def test_no_edge_in_no_edge_out(spark):
    rng, rows, x = random.Random(3), [], 100.0
    for i in range(6000):
        x *= math.exp(rng.gauss(0, 1e-4))
        rows.append(("s", i * 10 * S, i, x, x))
    tape = spark.createDataFrame(rows, "symbol string, ts_us long, seq long, bid double, ask double")
    sig = spark.createDataFrame([(i, "s", rng.randrange(20 * 60, 15 * 3600) * S, rng.choice([1, -1]), "arm") for i in range(300)], "signal_id long, symbol string, when_us long, sign int, arm string")
    out = pricing.tick_outcomes(tape, sig, (5,)).join(sig.select("signal_id", "arm"), "signal_id")
    null = nulls.with_nulls(sig, lambda s, c: pricing.tick_outcomes(tape, s, (5,), carry=c), exclude_us=600 * S, span_us=3 * 3600 * S)[1].withColumn("arm", F.lit("arm"))
    r = stats.arm_summary(sig, out, null).first()
    assert abs(r.z) < 3 and r.spread_mean == 0 and r.null_n > 300


# ------------------------------------------------------------------ stats


def test_stat_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", -3.0), ("c", None), ("b", 0.0)], "k string, x double")
    got = {r.k: r for r in df.groupBy("k").agg(*stats.stat(F.col("x"), "s"), stats.hit_rate(F.col("x")).alias("hit")).collect()}
    assert got["a"][1:] == (1, 1.0, 0.0, 1.0) and got["c"][1:] == (0, 0.0, 0.0, 0.0) and got["b"].hit == 0.5


def test_sign_test_and_medians(spark):
    for k, n in ((0, 0), (3, 10), (29, 37), (10, 20), (500, 1000)):
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
        assert one(spark, stats.sign_test(F.lit(k), F.lit(n)))[0] == pytest.approx(want)
    d = spark.createDataFrame([(1.0, 1), (2.0, 2), (9.0, 1), (50.0, 0)], "l double, n int")
    assert d.agg(stats.weighted_median(F.col("l"), F.col("n"))).first()[0] == 2.0
    assert one(spark, stats.round_tenth(F.lit(0.875)), stats.round_tenth(F.lit(-0.25)))[:] == (0.9, -0.3)


def test_calibration_last_bin(spark):
    d = spark.createDataFrame([(1.0, True), (0.85, False), (0.1, False)], "p double, up boolean")
    got = sorted(map(tuple, stats.calibration(d, F.col("p"), F.col("up")).collect()))
    assert got == [(0.0, 0.2, 1, 0.1, 0.0), (0.8, 1.0, 2, 0.925, 0.5)]


def test_capture_and_drift_identity(spark):
    ticks = spark.createDataFrame([("s", i, 100.0 + i) for i in range(10)], "symbol string, seq long, mid double")
    fills = spark.createDataFrame([("s", 2, 1, 101.0, 2.0, True), ("s", 8, -1, 109.0, 1.0, False)], "symbol string, seq long, side int, price double, size double, informed boolean")
    got = {(r["class"], r.horizon): (r.capture, r.adverse) for r in stats.markouts(fills, ticks, (4,)).collect()}
    assert got["informed", 4] == (2.0, 8.0) and got["benign", 4] == (1.0, -1.0) and got["all", 4] == (3.0, 7.0)


def test_breakdown_and_paired(spark):
    o = spark.createDataFrame([("x", 1.0), (" ", 3.0), (None, 5.0), ("x", 2.0)], "k string, fwd_bps double")
    assert [(r.key, r.fwd_n, r.fwd_mean) for r in stats.breakdown(o, {"k": F.col("k")}).collect()] == [("none", 2, 4.0), ("x", 2, 1.5)]
    p = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "a", 4.0), (2, "b", 2.0), (3, "a", 9.0)], "seed int, arm string, net double")
    assert stats.paired_difference(p, "a", "b").first()[:] == (2, 2.0, 0.0, True)


# ----------------------------------------------------------------- ledger


def test_ledger_open_add_reduce_flip_close(spark):
    f = spark.createDataFrame([("r", "s", i, d, p, 0.5) for i, (d, p) in enumerate([(1.0, 10.0), (1.0, 20.0), (-0.5, 25.0), (-3.0, 30.0), (1.5, 20.0)])], "run string, symbol string, seq long, delta double, price double, fee double")
    got = [(r.units, r.avg_price, r.realized, r.fees) for r in ledger.ledger(f).orderBy("seq").collect()]
    assert got == [(1.0, 10.0, 0.0, 0.5), (2.0, 15.0, 0.0, 1.0), (1.5, 15.0, 5.0, 1.5), (-1.5, 30.0, 27.5, 2.0), (0.0, 0.0, 42.5, 2.5)]
    ticks = spark.createDataFrame([("s", i, 20.0) for i in range(5)], "symbol string, seq long, mid double")
    eq = [r.equity for r in ledger.marked(ledger.ledger(f), ticks).orderBy("seq").collect()]
    assert eq == [9.5, 9.0, 11.0, 40.5, 40.0]


def test_fill_price_and_arrival(spark):
    c = [F.lit(x) for x in (99.0, 101.0, 2.0, 4.0)]
    assert one(spark, ledger.fill_price(*c, F.lit(2.0), 10.0), ledger.fill_price(*c, F.lit(-100.0), 10.0))[:] == pytest.approx((101 * (1 + 5 / 1e4), 99 * (1 - 50 / 1e4)))
    d = spark.createDataFrame([(5, 0), (5, 1_000_001)], "seq long, lat long")
    assert [r.arrival for r in ledger.arrivals(d, F.col("lat"), S).orderBy("lat").collect()] == [6, 7]


def test_dead_band_and_admission(spark):
    i = spark.createDataFrame([("r", "s", n, x) for n, x in enumerate([1.0, 0.9, 0.5, 0.1, 0.0])], "run string, symbol string, seq long, ideal double")
    assert [r.target for r in ledger.dead_band(i).orderBy("seq").collect()] == [1.0, 1.0, 0.5, 0.1, 0.0]
    small = i.withColumn("ideal", F.col("ideal") / 10)
    assert [r.target for r in ledger.dead_band(small, always_flat=False).orderBy("seq").collect()] == [0.0] * 5
    q = spark.createDataFrame([("r", "s", n, lat) for n, lat in enumerate([2_500_000, 0, 0, 0, 9_000_000, 0, 0])], "run string, symbol string, seq long, latency_us long")
    got = [r.status for r in ledger.admitted(q, 1, 3_000_000).orderBy("seq").collect()]
    assert got == ["sent", "busy", "busy", "sent", "expired", "busy", "busy"]


def test_quotes_stop_at_full_inventory(spark):
    r = spark.createDataFrame([(100.0, 0.0, x, 1.0, 1.0, 1.0, 1.0) for x in (0.0, 8.0, -9.0)], "mid double, vol_bps double, inventory double, bid_spread_mult double, ask_spread_mult double, bid_size_mult double, ask_size_mult double")
    got = ledger.quotes(r).collect()
    assert [(g.quote_bid_size, g.quote_ask_size) for g in got] == [(1.0, 1.0), (0.0, 1.0), (1.0, 0.0)]
    assert got[1].quote_bid < got[0].quote_bid < got[2].quote_bid


def test_curve(spark):
    c = spark.createDataFrame([("r", i, v) for i, v in enumerate([0.0, 5.0, 2.0, 6.0, 1.0])], "run string, seq long, equity double")
    r = stats.curve_stats(c).first()
    assert r.max_drawdown == 5.0 and r.final == 1.0 and r.sharpe != 0


# ------------------------------------------------------------------- text


def test_text_rules(spark):
    L = F.lit
    assert one(spark, T.action(L("The Committee decided to raise the target range. It does not expect to reduce.")), T.action(L("would cut the target range")), T.action(L("nothing")))[:] == ("hike", "cut", "hold")
    assert one(spark, T.word_lean(L("raised rates, cutting")))[0][:] == ("neutral", 1, 1, 0.0)
    assert one(spark, T.currency(L("the hyena")), T.currency(L("dollar and yen")), T.about_fx(L("bitcoin dollar")))[:] == ("none", "JPY", False)
    assert one(spark, T.rate_value(L("3-3/4")), T.rate_value(L("1/4")), T.rate_value(L("4.00")), T.range_top(L("3-1/2 to 3-3/4")))[:] == (3.75, 0.25, 4.0, 3.75)
    assert one(spark, T.announced_rate(L("Bank Rate maintained at 4.25%"), L("9% of it")), T.announced_rate(L("x"), L("only 5 percent is named")), T.announced_rate(L("x"), L("3% or 4%")), T.announced_rate(L("x"), L("inflation of 2%. It voted to raise the target range for the federal funds rate by 1/4 percentage point to 3-3/4 to 4 percent.")), T.announced_rate(L("x"), L("2% growth; target range for the federal funds rate at 0 to 1/4 percent")))[:] == (4.25, 5.0, None, 4.0, 0.25)
    assert one(spark, T.level_of(L("0.875")), T.level_of(L("0.38 - 0.62")), T.level_of(L("0 - 0.37")), T.level_of(L("-0.125")), T.level_of(L("rate")))[:] == (0.875, 0.5, 0.25, -0.125, None)
    assert one(spark, T.title_family(L("Minutes of the Committee, July 28-29, 2026")), T.title_side(L("Will delist; lists X")), T.slug(L("A  b/C!")))[:] == ("minutes of the committee", -1, "a-b-c")
    assert one(spark, T.tickers(L("Will list Foo (FOO) and BAR/USDT (UTC) BAZUSDT 1000PEPEUSDT (USDT)"), L("again (FOO) then (QUX)")))[0] == ["FOO", "BAR", "BAZ", "PEPE", "QUX"]
    assert one(spark, T.sentences(L("Governor Lorie K. Logan spoke at the event today. Share this page with your friends now. Too short. Rates were held by the bank vs. The market view of it.")))[0] == ["Governor Lorie K. Logan spoke at the event today.", "Rates were held by the bank vs. The market view of it."]
    assert one(spark, T.headline(L("word " * 60), L("")), T.headline(L(" "), L('Someone: "Hello there"')))[:] == (("word " * 24).rstrip() + "...", "Hello there")
    assert one(spark, T.is_chair(L("Chair Powell")), T.is_chair(L("Vice Chair X")), T.keyword_hit(L("a HACK!"), ["hack", "war"]), T.keyword_hit(L("warm"), ["war"]))[:] == (True, False, True, False)
    assert one(spark, T.section(L("aa Staff view bb"), "Staff", limit=8), T.dominant_topic(L("inflation prices and growth")), T.intervention_level(L("one-sided moves")), T.versus(L("hawkish"), L("neutral")))[:] == ("Staff vi", "inflation", 2.0, "more_hawkish")


def test_times(spark):
    f = lambda s, z="UTC": C.moment(F.lit(s), z).cast("string")
    got = one(spark, f("Wed, 29 Jul 2026 14:00:00 GMT"), f("2026-07-29T14:00:00.1234567+02:00"), f("7/29/2026 2:00:00 PM", "America/New_York"), f("2026-07-29"), f("7/29/2026"), f("junk"))
    assert got[:] == ("2026-07-29 14:00:00", "2026-07-29 12:00:00.123456", "2026-07-29 18:00:00", None, None, None)
    ts = F.lit("2027-01-03 06:30:00").cast("timestamp")
    assert one(spark, C.session(ts), C.week_part(ts), C.iso_week(ts), C.quarter_steps(F.lit(0.375)))[:] == ("asia", "weekend", "2026-W53", 2)
    assert one(spark, C.conference_start(F.lit("2012-06-20 16:30:00").cast("timestamp")).cast("string"), C.conference_start(ts).cast("string"), F.size(C.covering(ts, ts + F.expr("INTERVAL 2 HOURS"), "hour")))[:] == ("2012-06-20 18:15:00", "2027-01-03 07:00:00", 3)


# -------------------------------------------------------------- documents


def test_editions_and_changes(spark):
    old, new = "The bank held rates at its meeting. Growth is moderate in the country.", "The bank raised rates at its meeting. Growth is moderate in the country. A new sentence was added here."
    d = spark.createDataFrame([(1, "f", "st", "Statement May 2020", old, 1), (2, "f", "st", "Statement June 2020", "", 2), (3, "f", "st", "Statement July 2020", new, 3), (4, "f", "st", "Statement July 2021", "x", 3), (5, "f", "mi", "Minutes", "y", 9)], "id long, issuer string, kind string, title string, body string, ts_us long")
    got = {r.id: r.prev_id for r in documents.previous_edition(d).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 1, 5: None}
    both = {r.id: r.prev_id for r in documents.previous_with_fallback(d, F.col("kind") == "st").collect()}
    assert both[5] == 4 and both[3] == 1
    ch = documents.changed_sentences(documents.previous_edition(d).filter("id = 3")).first().changes
    assert [(c.was, c.now) for c in ch] == [("The bank held rates at its meeting.", "The bank raised rates at its meeting."), ("", "A new sentence was added here.")]


def test_merges(spark):
    r = spark.createDataFrame([("a", 2, "late", None), ("a", 1, " ", "u1"), ("b", 1, "t", "u")], "id string, ord int, text string, url string")
    assert {x.id: (x.text, x.url, x.copies, x.filled) for x in documents.merged(r, fields=("text", "url")).collect()} == {"a": ("late", "u1", 2, 1), "b": ("t", "u", 1, 0)}
    s = spark.createDataFrame([("2020-01", 1), ("2020-02", 2)], "k string, v int")
    assert [tuple(x) for x in documents.merge_register(s, spark.createDataFrame([("2020-02", 9), ("2020-03", 3)], "k string, v int"), ["k"], "k").collect()] == [("2020-01", 1), ("2020-02", 9), ("2020-03", 3)]


def test_context_refuses_what_was_not_known(spark):
    rel = spark.createDataFrame([("r", 10)], "id string, ts_us long")
    items = spark.createDataFrame([("r", "rates", "R", 9, False, "x"), ("r", "press", "P", 10, True, "y"), ("r", "rates", "late", 10, False, "z")], "release_id string, kind string, label string, ts_us long, concurrent boolean, text string")
    fine = documents.context(rel, items.filter("label <> 'late'"), ("press", "rates")).first()
    assert fine.context == "P: y\nR: x" and fine.has_press and fine.has_rates
    with pytest.raises(Exception, match="not yet known"):
        documents.context(rel, items, ("press", "rates")).collect()
    assert documents.context(rel, items, ("press", "rates"), on_violation="quarantine").first().violations == 1


def test_between_releases(spark):
    rel = spark.createDataFrame([("a", "f", 10), ("b", "f", 20)], "id string, issuer string, ts_us long")
    said = spark.createDataFrame([(str(i), "f", 10 + i, "Chair X" if i % 2 else "Other", "body") for i in range(11)], "id string, issuer string, ts_us long, name string, body string")
    got = documents.between_releases(rel, said, T.is_chair(F.col("name"))).collect()
    assert {r.release_id for r in got} == {"b"} and sorted((int(r.remark_id), r.rank) for r in got if r.is_chair) == [(5, 3), (7, 2), (9, 1)]
    assert sorted(int(r.remark_id) for r in got if not r.is_chair) == [2, 4, 6, 8]


def test_surprises(spark):
    d = spark.createDataFrame([(4.0, 3.75, 4.0, 4.0), (4.0, 4.0, 4.02, 4.0)], "rate double, prev_rate double, bill6m double, fedfunds double")
    assert [(r.sign, round(r.strength, 4)) for r in documents.surprise(d).collect()] == [(1, 1.0), (0, 0.02)]
    m = spark.createDataFrame([("2020-01", "2020", 1.0), ("2020-03", "2020", 1.375), ("2020-03", "2021", 2.0)], "meeting string, year string, median double")
    assert [(r.meeting, r.year, r.steps) for r in documents.projection_moves(m).collect()] == [("2020-03", "2020", 2)]


def test_turns(spark):
    d = spark.createDataFrame([("d", "CHAIR POWELL. Good afternoon all.\nMORE text.\nSMITH. What about rates?\nCHAIR POWELL. We will see.")], "doc string, text string")
    t = documents.turns(d)
    assert [(r.speaker, r.style) for r in t.orderBy("idx").collect()] == [("CHAIR POWELL", "moderator"), ("SMITH", "question"), ("CHAIR POWELL", "moderator")]
    r = documents.remarks_and_questions(t, F.col("speaker").startswith("CHAIR")).first()
    assert r.remarks == "Good afternoon all.\nMORE text." and r.qa.startswith("What about rates?")


# ---------------------------------------------------------------- scoring


def test_scoring_cache_scores_once(spark):
    import pandas as pd

    rows = spark.createDataFrame([(i, f"t{i % 3}") for i in range(9)], "id long, text string").withColumn("digest", scoring.digest(F.col("text")))
    cache = rows.filter("id = 0").select("digest", F.lit(5.0).alias("score"))

    def scorer(batches):
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "score": 1.0})

    got, fresh = scoring.scored(rows, cache, scorer, "digest string, score double")
    assert fresh.count() == 2 and sorted(r.score for r in got.collect()) == [1.0] * 6 + [5.0] * 3


def test_answers_and_policy(spark):
    ok = '{"answers":{"a":{"type":"noul","noul":0.7},"b":{"type":"choice","choice":"up","probabilities":{"up":0.9},"confidence":0.8}},"input_tokens":10}'
    d = spark.createDataFrame([(ok,), ('{"answers":{"a":{"type":"odd"}}}',), ("junk",)], "response string")
    got = scoring.parsed_answers(d).collect()
    assert [r.error for r in got] == [None, "unknown kind", "unreadable"] and got[0].answers["b"].probabilities["up"] == 0.9
    assert one(spark, scoring.softmax(F.array(F.lit(0.0), F.lit(0.0))), scoring.entropy_confidence(F.array(F.lit(0.5), F.lit(0.5))), scoring.entropy_confidence(F.array(F.lit(1.0), F.lit(0.0))))[:] == ([0.5, 0.5], pytest.approx(0.0), 1.0)
    a = dict(p_up=0.8, p_down=0.1, confidence=1.0, p_continue=0.0, p_reverse=0.0, conviction=1.0, liquidity=1.0, hazard=0.0, cut=0.0, position=0.0)
    cases = [{}, {"hazard": 0.9}, {"cut": 0.7}, {"confidence": 0.1}, {"conviction": 0.2}, {"p_up": 0.15}, {"liquidity": 0.1}]
    out = scoring.decision(spark.createDataFrame([{**a, **c} for c in cases])).collect()
    assert [r.gate for r in out] == ["", "disorderly", "cut_position", "low_confidence", "weak_setup", "no_edge", "illiquid"] and out[0].target == pytest.approx(0.1)
    risk = lambda *x: scoring.headline_risk(*[F.lit(v) for v in x])
    assert one(spark, risk(1.0, 1.0, 1.0, 1.0, 0.0), risk(0.0, 1.0, 1.0, 0.0, 1.0))[:] == pytest.approx((0.07, 0.85))
    s = one(spark, scoring.stance(*[F.lit(x) for x in (0.9, 0.8, 0.1, 0.9, True, 0.0)]), scoring.stance(*[F.lit(x) for x in (0.1, 0.8, 0.1, 0.9, True, 0.0)]), scoring.stance(*[F.lit(x) for x in (0.5, 0.0, 0.0, 0.0, False, -0.7)]))
    assert [x.name for x in s] == ["pull offer", "normal", "pull bid"] and s[0].ask_size_mult == 0.0 and s[0].bid_spread_mult == 1.0
    assert one(spark, scoring.inventory_words(F.lit(-5.0)), scoring.flow_words(F.lit(0.3)))[:] == ("heavily short", "recent trades have leaned towards people buying from us")


def test_labels(spark):
    bars = spark.createDataFrame([("s", i * 100, i, 100.0 if i < 20 else 101.0) for i in range(40)], "symbol string, ts_us long, seq long, close double")
    at = spark.createDataFrame([(1, "s", 1950), (2, "s", 2100), (3, "s", 100), (4, "s", 9999)], "id long, symbol string, when_us long")
    got = {r.id: (r.moved, r.reactive, r.clean) for r in labels.labelled(bars, at, 1.0).collect()}
    assert got == {1: (True, False, True), 2: (False, True, False)}


# ---------------------------------------------------------- arms, sentences


def test_arms(spark):
    from tidemark.plans import arms

    d = spark.createDataFrame([(1, 5, "USD", "Statement", "raised rates"), (2, 6, "JPY", "Statement", "nothing"), (3, 7, "XXX", "x", "hike"), (4, 8, "GBP", "Bank rate at 4%", "")], "id long, ts_us long, currency string, title string, body string")
    assert [(r.id, r.symbol, r.sign) for r in arms.keyword_arm(d).collect()] == [(1, "EURUSD", -1)]
    assert [(r.id, r.symbol, r.sign) for r in arms.all_text_arm(d).orderBy("id").collect()] == [(1, "EURUSD", -1), (2, "USDJPY", -1), (4, "GBPUSD", 1)]
    cal = spark.createDataFrame([("GBP", 9, "Official Bank Rate", "3.75%"), ("USD", 5, "Rate", "3-0-6%")], "currency string, ts_us long, title string, forecast string")
    assert [(r.id, r.symbol, r.sign) for r in arms.surprise_arm(d, cal).collect()] == [(4, "GBPUSD", 1)]
    w = spark.createDataFrame([(1, 5, "BoJ hike", ""), (2, 5, "bitcoin dollar hike", ""), (3, 5, "yuan hike", "")], "id long, ts_us long, title string, body string")
    assert [(r.id, r.symbol, r.sign) for r in arms.wire_arm(w).collect()] == [(1, "USDJPY", -1)]
    assert arms.sample_arm(w, 3).first().id == "sample:1"
    n = spark.createDataFrame([(1, 5, "Will list Foo (FOO)", "and (BAR)"), (2, 5, "Removal of (BAZ)", ""), (3, 5, "Notice (X1)", "")], "id long, ts_us long, title string, body string")
    assert [(r.id, r.symbol, r.sign) for r in arms.title_arm(n, True).orderBy("id", "symbol").collect()] == [(1, "BAR", 1), (1, "FOO", 1), (2, "BAZ", -1)]
    s = [F.lit(x) for x in (1.0, 1.0, 0.5, 1.0, 0.0, 1.0)]
    assert one(spark, arms.strength(*s), arms.context_strength(*s[:4]), arms.wire_strength(*s[:3], F.lit(1.0), F.lit(0.5)), arms.projection_strength(F.lit(-8)), arms.dollar_side(F.lit("USDJPY"), F.lit(1)))[:] == pytest.approx((0.175, 0.0, 0.25, 1.0, 1))


def test_reversal_days(spark):
    from tidemark.plans import arms

    tape = spark.createDataFrame([("s", m * MINUTE, m, 100.0 + m, 100.0 + m) for m in range(200)], "symbol string, ts_us long, seq long, bid double, ask double")
    r = spark.createDataFrame([(1, "s", 10 * MINUTE, 40 * MINUTE, "more_dovish", "consistent"), (2, "s", 10 * MINUTE, 40 * MINUTE, "consistent", "consistent")], "id long, symbol string, statement_us long, start_us long, remarks_vs_statement string, qa_vs_remarks string")
    got = arms.reversals(r, tape).collect()
    assert [x.id for x in got] == [1] and got[0].statement_bps == pytest.approx(math.log(140 / 110) * 1e4) and got[0].presser_bps == pytest.approx(math.log(200 / 140) * 1e4)


def test_sentences_of_numbers(spark):
    from tidemark.functions import sentences as N

    L = F.lit
    got = one(spark, N.pricing_sentences(L(4.0), L(3.9), L("2026-07-01"), L(3.4), {"2y": (L(3.5), L(-14.0)), "10y": (L(4.1), L(None).cast("double"))}, L("2026-06-10")))[0]
    assert got == [
        "The target range set at the last meeting tops out at 4.00 percent, and the effective funds rate printed 3.90 percent on 2026-07-01.",
        "The six-month bill yields 3.40 percent against an overnight rate of 3.90: the market prices roughly 2 quarter-point cuts within six months.",
        "The two-year yield is 14 bp lower than on 2026-06-10, at 3.50 percent: the market has moved dovish since then.",
        "The ten-year yield is at 4.10 percent; there is no reading from the last meeting.",
    ]
    assert one(spark, N.plausible_target(L(1.0), L(0.12)), N.plausible_target(L(0.25), L(0.12)), N.priced_sentence(L(0.2), L(0.12)))[:] == (None, 0.25, "Policy is at the zero bound and the six-month bill yields 0.20 percent, so there is no room to price cuts; the bill prices no move away from the floor within six months.")
    assert one(spark, N.projection_sentence(L("2027"), L(3.4), L(2.9), L("March")), N.projection_sentence(L("longer run"), L(3.0), L(3.0), L(None).cast("string")))[:] == ("Median projection for end-2027 moved to 3.4% from 2.9% in March: fewer cuts (2 quarter-point steps).", "Median projection for the longer run is unchanged at 3.0%.")
    assert one(spark, N.drift_sentences(L("EURUSD"), L(1.1), L(-12.4), L(3.0)))[0] == ["EURUSD is at 1.10000, 12 bp lower than 24 hours before the release.", "In the fifteen minutes before the release it moved 3 bp up: the tape was quiet going in."]
