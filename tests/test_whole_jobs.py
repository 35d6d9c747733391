"""Queries and operators over all of their rows, against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import text as T
from tidemark.operators import ledger
from tidemark.plans import nulls
from tidemark.plans.arms import WIRE_PAIRS

SMALL = "/root/testdata/sf0.001"


def plain_ledger(fills):
    """fills (delta, price, fee) in order -> (units, avg, realized, fees) after each."""
    units = avg = realized = fees = 0.0
    out = []
    for delta, price, fee in fills:
        if units == 0 or (units > 0) == (delta > 0):
            avg = (avg * abs(units) + price * abs(delta)) / (abs(units) + abs(delta)) if delta else avg
        else:
            realized += (price - avg) * min(abs(units), abs(delta)) * (1 if units > 0 else -1)
            avg = price if abs(delta) > abs(units) else avg
        units += delta
        if abs(units) < 1e-9:
            units = avg = 0.0
        fees += fee
        out.append((units, avg, realized, fees))
    return out


@pytest.fixture(scope="module")
def line_items(spark, tmp_path_factory):
    """A folder with 1,400 line items of ten suppliers, a third of them of one."""
    rng = random.Random(3)
    rows = [(k // 4 + 1, k % 4 + 1, k + 1, 0 if k % 3 == 0 else rng.randrange(10), float(rng.randrange(1, 51)), rng.choice("RAN"), rng.choice("OF")) for k in range(1400)]
    path = tmp_path_factory.mktemp("whole")
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string")
    df = df.withColumn("l_extendedprice", F.col("l_quantity") * (90 + F.col("l_partkey") % 20)).withColumn("l_shipdate", F.lit("1995-01-01").cast("date"))
    df.write.parquet(str(path / "lineitem.parquet"))
    return str(path), rows


def by_symbol(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(f"S{r[3] % 7}", []).append(r)
    return out


@pytest.mark.parametrize("block", [1, 7, 65536])
def test_ledger_in_blocks_equals_a_plain_loop(spark, block):
    rng = random.Random(block)
    fills = {
        ("r", "long"): [(rng.choice([1.0, 2.5, -1.5]), 100 + rng.random(), 0.1) for _ in range(150)],
        ("r", "flat"): [(d, 100 + rng.random(), 0.2) for _ in range(40) for d in rng.choice([(0.1, 0.2, -0.3), (-2.0, 2.0), (1.0, -3.0, 2.0), (0.0,)])],
        ("q", "walk"): [(float(rng.randrange(-5, 6)), 50 + rng.random(), 0.0) for _ in range(300)],
        (None, "one"): [(3.0, 10.0, 1.0)],
    }
    rows = [(*k, i, *f) for k, own in fills.items() for i, f in enumerate(own)]
    df = spark.createDataFrame(rows, "run string, symbol string, seq long, delta double, price double, fee double").repartition(3)
    got = {(r.run, r.symbol, r.seq): (r.units, r.avg_price, r.realized, r.fees) for r in ledger.ledger(df, block=block).collect()}
    assert len(got) == len(rows)
    for k, own in fills.items():
        for i, want in enumerate(plain_ledger(own)):
            assert got[(*k, i)] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_whole_ledger_folds_every_fill(spark, line_items):
    path, rows = line_items
    got = {r.symbol: (r.fills, r.units, r.avg_price, r.realized) for r in queries.QUERIES["led3_ledger"](spark, path).collect()}
    own = by_symbol(rows)
    assert set(got) == set(own) and max(map(len, own.values())) > 400
    for symbol, fills in own.items():
        want = plain_ledger([(r[4] if i % 2 == 0 else -r[4], float(90 + r[2] % 20), 0.0) for i, r in enumerate(fills)])[-1][:3]
        assert got[symbol] == pytest.approx((len(fills), *want), abs=1e-3)


def test_whole_sign_test_counts_every_fill(spark, line_items):
    path, rows = line_items
    got = {r.arm: (r.wins, r.n, r.p) for r in queries.QUERIES["agg24_sign_test"](spark, path).collect()}
    own = by_symbol(rows)
    assert set(got) == set(own)
    for arm, fills in own.items():
        n, wins = len(fills), sum(r[5] == "R" for r in fills)
        p = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, n - wins) + 1)) / 2**n)
        assert got[arm] == pytest.approx((wins, n, p), abs=1e-8)


LATE = (
    "payrolls beat and the dollar jumps", "ecb easing weighs on the euro", "bitcoin jumps", "wages and jobs and employment and labor", "a speech on the dot plot",
    "the fed decided to lower the target range", "conducted large operations in the foreign exchange market", "delisting of pairs", "strong growth, gdp up, demand up, recession over", "",
)


@pytest.fixture(scope="module")
def late_texts(spark, tmp_path_factory):
    """A folder with documents of every residue whose words stand behind 600 characters of others, and the texts with their sentences."""
    path = tmp_path_factory.mktemp("late")
    rows = [(i, "plain words. " * 50 + LATE[(i // 10 + i) % 10] + f". Then they raised the bank rate to {i}.25 percent (ZZ{i}Q)" * (i % 3 > 0)) for i in range(100)] + [(100, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    return str(path), {i: f"{queries._SALT[i % 10]}. {t or ''}" for i, t in rows}


def first(text, table, otherwise):
    return next((n for n, p in table if re.search(p, text)), otherwise)


def count(text, pattern):
    return sum(1 for _ in re.finditer(pattern, text))


def test_whole_text_rules_read_past_the_start(spark, late_texts):
    path, texts = late_texts
    got = {r.doc_id: r for r in queries.QUERIES["fn_text_rules"](spark, path).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        hawks, doves, up, down = (count(t, p) for p in (T.HAWKISH, T.DOVISH, T.HAWKISH_WIRE, T.DOVISH_WIRE))
        r, currency = got[i], first(t, T.CURRENCIES, "none")
        assert (r.hawks, r.doves, r.direction) == (hawks, doves, "none" if up == down else "stronger" if up > down else "weaker")
        assert r.stance == ("neutral" if hawks == doves else "hawkish" if hawks > doves else "dovish")
        assert (r.currency, r.category, r.kind) == (currency, first(t, T.CATEGORIES, "other"), first(t, T.KINDS, "other"))
        assert (r.channel, r.level) == (first(t, T.CHANNELS, "nothing_surprising"), first(t, T.INTERVENTION, 0.0))
        assert r.about_fx == (currency != "none" and not re.search(T.NOT_FX, t))
        assert r.side == (-1 if re.search(T.BEARISH_TITLE, t) else 1 if re.search(T.BULLISH_TITLE, t) else 0)


def test_whole_topic_and_action_read_past_the_start(spark, late_texts):
    path, texts = late_texts
    got = {r.doc_id: (r.topic, r.action) for r in queries.QUERIES["fn_topic_and_action"](spark, path).collect()}
    want = {}
    for i, t in texts.items():
        n, topic = max((count(t, p), name) for name, p in T.TOPICS)
        m = re.search(T.DECIDED, t)
        scope = m[1] if m else t
        want[i] = (topic if n else "other", "hike" if re.search(T.DID_HIKE, scope) else "cut" if re.search(T.DID_CUT, scope) else "hold")
    assert got == want


def test_whole_rates_and_tickers_read_every_document(spark, late_texts):
    path, texts = late_texts
    rates = {r.doc_id: r.rate for r in queries.QUERIES["fn_announced_rate"](spark, path).collect()}
    names = {r.doc_id: r.tickers for r in queries.QUERIES["fn_tickers"](spark, path).collect()}
    assert set(rates) == set(names) == set(texts)
    for i in texts:
        late = i % 3 > 0 and i < 100
        assert rates[i] == (i + 0.25 if late else {5: 4.0, 6: 0.25}.get(i % 10))
        assert names[i] == ",".join([*{3: ["ABC", "XYZ"], 4: ["DEF"]}.get(i % 10, []), *[f"ZZ{i}Q"] * late])


def test_whole_wire_arm_reads_past_the_start(spark, late_texts):
    path, texts = late_texts
    got = {(r.id, r.symbol, r.sign) for r in queries.QUERIES["evt10_wire_arm"](spark, path).collect()}
    want = set()
    for i, t in texts.items():
        up, down, currency = count(t, T.HAWKISH_WIRE), count(t, T.DOVISH_WIRE), first(t, T.CURRENCIES, "none")
        if up != down and currency in WIRE_PAIRS and not re.search(T.NOT_FX, t):
            want.add((i, WIRE_PAIRS[currency][0], WIRE_PAIRS[currency][1] * (1 if up > down else -1)))
    assert want and got == want


def test_matched_excursions_draw_500_trials(spark, monkeypatch):
    seen, draw = [], nulls.trial_times
    monkeypatch.setattr(nulls, "trial_times", lambda span, trials, *a: seen.append(trials) or draw(span, trials, *a))
    queries.QUERIES["evt9_matched_excursions"](spark, SMALL)
    assert seen == [500]
