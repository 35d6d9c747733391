"""Forms that hold for groups of any size, against plain ones: look-ups, folds in blocks, quantiles, tests, lexicons, scores, controls."""

import math
import random
import re
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicons, text
from tidemark.operators import documents, quantiles, stats
from tidemark.operators.asof import BACKWARD, FORWARD, bounded_asof
from tidemark.operators.ledger import admitted, dead_band
from tidemark.plans import arms, nulls, scoring


@pytest.mark.parametrize("direction", [BACKWARD, FORWARD])
def test_look_ups_are_linear_in_a_bucket(spark, direction):
    n = 60_000
    ticks = spark.range(n).select(F.lit("s").alias("symbol"), (F.col("id") * 1000).alias("ts_us"), F.col("id").alias("seq"), F.col("id").cast("double").alias("bid"))
    asked = spark.range(n).select(F.lit("s").alias("symbol"), (F.col("id") * 1000 + 500).alias("when_us"), F.col("id").alias("i"))
    began = time.time()
    got = bounded_asof(ticks, asked, 10**9, direction, bucket_us=10**12, values=("bid",))
    step = 0 if direction == BACKWARD else 1
    wrong = got.filter(~F.col("q_seq").eqNullSafe(F.when(F.col("i") + step < n, F.col("i") + step))).count()
    assert wrong == 0 and time.time() - began < 40  # the quadratic form takes many minutes


@pytest.mark.parametrize("mode", ["wide", "slow", "zero", "never one"])
@pytest.mark.parametrize("pieces", [256, 3])
def test_dead_band_in_blocks(spark, mode, pieces):
    rnd = random.Random(1)
    made = {"wide": lambda i: rnd.uniform(-1, 1), "slow": lambda i: i * 0.0003, "zero": lambda i: 0.0 if i % 50 == 0 else rnd.uniform(-0.3, 0.3), "never one": lambda i: 1.0 + (i % 7) * 0.02 + i * 1e-6}[mode]
    xs = [made(i) for i in range(1500)]
    want, p = [], 0.0
    for x in xs:
        p = x if abs(x - p) >= 0.18 or (x == 0 and p != 0) else p
        want.append(p)
    rows = spark.createDataFrame([("r", k, i, float(x)) for k in ("a", None) for i, x in enumerate(xs)], "run string, symbol string, seq long, ideal double")
    got = {(r.symbol, r.seq): r.target for r in dead_band(rows, block=200, pieces=pieces).collect()}
    assert len(got) == 3000 and all(got[k, i] == want[i] for k in ("a", None) for i in range(1500))
    assert dead_band(rows.limit(0)).collect() == []


@pytest.mark.parametrize("cadence", [1, 3])
def test_admission_in_blocks(spark, cadence):
    rnd = random.Random(2)
    late = [rnd.choice([1, 500_000, 1_500_000, 3_000_000, 9_000_000]) for _ in range(2000)]
    free, want = -1, []
    for i, x in enumerate(late):
        if i % cadence:
            want.append("off")
        elif i < free:
            want.append("busy")
        else:
            free = i + max(1, -(-min(x, 7_000_000) // 1_000_000))
            want.append("expired" if x > 7_000_000 else "sent")
    rows = spark.createDataFrame([("r", "a", i, x) for i, x in enumerate(late)], "run string, symbol string, seq long, latency_us long")
    got = {r.seq: r.status for r in admitted(rows, cadence, 7_000_000, block=50).collect()}
    assert [got[i] for i in range(2000)] == want


def test_sign_test_of_any_size(spark):
    cases = [(k, n) for n in (1, 2, 3, 5, 10, 15, 16, 17, 33, 100, 1001, 5000) for k in range(0, n + 1, max(1, n // 37))] + [(0, 0), (4_999_999, 10**7)]

    def exact(k, n):
        k, t, c = min(k, n - k), 1, 1
        if n <= 0 or 2 * k + 1 >= n:
            return 1.0
        for i in range(k):
            t = t * (n - i) // (i + 1)
            c += t
        return float(Fraction(2 * c, 2**n))

    got = spark.createDataFrame(cases, "k long, n long").withColumn("p", stats.sign_test(F.col("k"), F.col("n"))).collect()
    assert all(r.p == pytest.approx(exact(r.k, r.n), abs=1e-12) for r in got if r.n < 10**6)
    # one pair of terms is missing from the whole: C(n, n/2) / 2^n
    assert got[-1].p == pytest.approx(1 - math.sqrt(2 / (math.pi * 10**7)) * (1 - 1 / (4 * 10**7)), abs=1e-9)


@pytest.mark.parametrize("most", [100_000, 10])
def test_quantiles_by_narrowing(spark, most):
    rnd = random.Random(3)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(3000)], "b": [5.0] * 2000 + [1.0, 9.0], None: [float(rnd.randrange(4)) for _ in range(500)], "one": [2.5], "far": [10.0**rnd.randint(-300, 300) for _ in range(900)]}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("none", None)]
    got = {r.k: r for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, x double").repartition(5), ["k"], "x", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, {"i95": (0.95, 0), "i90": (0.9, 1)}, most).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        v = sorted(v)
        for name, s in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
            at = s * (len(v) - 1)
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert got[k][name] == pytest.approx(low + (at - math.floor(at)) * (high - low), rel=1e-12)
        assert got[k].i95 == v[min(int(0.95 * len(v)), len(v) - 1)] and got[k].i90 == v[int(0.9 * (len(v) - 1))]


def test_lexicons_in_one_pass_equal_each_pattern_alone():
    patterns = tuple(lexicons.RULES.values())
    compiled = [re.compile(p, re.ASCII) for p in patterns]
    rnd = random.Random(4)
    words = ["the fed", "raised rates", "Lowering", "lower", "tightening" * 9, "eur/usd", "usd/jpy", "s&p", "U.S.", "too LATE", "conducted big operations in the foreign exchange", "must be cut", "ÄÖcutß", "one-sided", "inflation", "\n", "rate check", "x", "supports", "unsupported", "İ"]
    for _ in range(400):
        t = "".join(rnd.choice(words) + rnd.choice([" ", "", ". ", "-"]) for _ in range(rnd.randint(1, 40)))
        assert lexicons.counted(t, patterns) == [sum(1 for _ in p.finditer(t)) for p in compiled]
    began = time.time()
    for w in ("cut", "rate", "tighten", "a"):
        lexicons.counted(w * 300_000, patterns)
    assert time.time() - began < 20
    for bad in (r"\w+", r"(cut)?", r"\w*cut"):
        with pytest.raises(ValueError):
            lexicons.literals(bad)


def test_text_rules_equal_the_column_rules(spark):
    t = ["the fed raised rates, inflation remains elevated", "ecb cuts rates as growth weakens", "bitcoin and the yen", "bank of japan will intervene", "speech on the balance sheet, dissent", "will list ABC", "delisting", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, text string")
    c = F.col("text")
    lean = text.word_lean(c)
    want = rows.select("i", lean["hawks"].alias("hawks"), lean["stance"].alias("stance"), lean["strength"].alias("strength"), text.wire_direction(c).alias("direction"), text.currency(c).alias("currency"), text.category(c).alias("category"), text.title_kind(c).alias("kind"), text.channel(c, F.lit(False)).alias("channel"), text.intervention_level(c).alias("level"), text.about_fx(c).alias("about_fx"), text.title_side(c).alias("side"), text.dominant_topic(c).alias("topic"))
    got = lexicons.text_rules(rows)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_sentences_and_tickers_of_long_texts(spark):
    s = "Mr. Smith of the U.S. said 12 things. " + "They were told to wait until 3. Then it was over, and e.g. nobody came back. "
    got = spark.createDataFrame([(s * 3,), (None,)], "t string").select(text.sentences(F.col("t")).alias("s")).collect()
    assert got[0].s[:3] == ["Mr. Smith of the U.S. said 12 things.", "They were told to wait until 3.", "Then it was over, and e.g. nobody came back."] and got[1].s == []
    began = time.time()
    long = spark.createDataFrame([("(ABC) x " * 20_000 + "(DEF)",)], "t string").select(text.tickers(F.col("t")).alias("n"), F.size(text.sentences(F.concat_ws(" ", F.lit("A sentence that is long enough. ") , F.repeat(F.lit("Another one of these sentences. "), 20_000)))).alias("s")).first()
    assert long.n == ["ABC", "DEF"] and long.s == 20_001 and time.time() - began < 60


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(text.running(F.array(*[F.lit(i % 7) for i in range(n)]).cast("array<int>"), 16 if n > 500 else 256).alias("s")).first().s
        want, total = [], 0
        for i in range(n):
            total += i % 7
            want.append(total)
        assert got == want


def test_scores_are_paid_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def scorer(batches):
        import os
        import uuid

        os.makedirs(seen, exist_ok=True)
        for b in batches:
            for d in b["digest"]:
                open(os.path.join(seen, f"{d}-{uuid.uuid4().hex}"), "w").close()
            yield b[["digest"]].assign(score=[random.random() for _ in range(len(b))])

    inputs = spark.createDataFrame([(f"d{i % 7}", i) for i in range(20)], "digest string, i long")
    every, fresh = scoring.scored(inputs, spark.createDataFrame([("d0", 0.5)], "digest string, score double"), scorer, "digest string, score double")
    a, b = {r.digest: r.score for r in every.collect()}, {r.digest: r.score for r in fresh.collect()}
    assert len(list((tmp_path / "seen").iterdir())) == 6 == len(b) and all(a[k] == v for k, v in b.items()) and a["d0"] == 0.5 and every.count() == 20


def test_editions_spread_over_years(spark):
    year = 365 * 86_400_000_000
    rows = [(i, "iss", "k", "Statement 2024", "" if i % 3 == 0 else f"body {i}", (i // 2) * year // 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, issuer string, kind string, title string, body string, ts_us long")
    got = {r.id: (r.prev_id, r.prev_body) for r in documents.previous_edition(docs).collect()}
    for i, *_, ts in rows:
        before = [(r[5], r[0], r[4]) for r in rows if r[5] < ts and r[4]]
        want = max(before)[1:] if before else (None, None)
        assert got[i] == want
    near = documents.near_duplicate_headlines(spark.createDataFrame([(2, "One two three four five six seven eight"), (1, "one TWO three four five six seven, nine"), (3, "other"), (4, None), (5, "!!")], "id long, title string").withColumn("ts_us", F.lit(1)))
    assert sorted(r.id for r in near.collect()) == [1, 3]


def test_arms_of_readers_and_users(spark):
    r = spark.createDataFrame([(1, 5, "USD", "hawkish", 0.9, 0.4), (2, 5, "EUR", "neutral", 0.9, 0.4), (3, 5, "JPY", "dovish", 0.4, 0.9), (4, 5, "GBP", "dovish", 0.6, 0.1), (5, 5, None, None, None, None)], "id long, ts_us long, currency string, direction string, confidence double, s double")
    assert [(x.id, x.symbol, x.sign, x.strength) for x in arms.reader_arm(r, F.col("s"), 0.2).collect()] == [(1, "EURUSD", -1, 0.4)]
    own = F.when(F.col("id") < 3, F.array(F.struct(F.lit("A").alias("symbol"), (F.col("id") - 2).alias("sign"), F.lit(1).alias("strength")), F.struct(F.lit(None).cast("string").alias("symbol"), F.lit(1).cast("long").alias("sign"), F.lit(1).alias("strength"))))
    assert [(x.id, x.symbol, x.sign, x.arm) for x in arms.user_arm(r, own, "mine").collect()] == [(1, "A", -1, "mine")]
    m = spark.createDataFrame([(1, y, v) for y, v in (("2020", 1.0), ("2021", 2.0), ("longer run", 2.5))] + [(2, y, v) for y, v in (("2021", 2.5), ("2022", 3.0), ("longer run", 2.5))] + [(3, y, v) for y, v in (("2021", 2.5), ("2022", 2.0), ("longer run", 2.75))], "meeting long, year string, median double")
    got = {(x.id, x.arm.split(": ")[1]): (x.sign, x.strength) for x in arms.projection_arms(m, m.select("meeting", F.lit(7).alias("ts_us")).distinct()).collect()}
    assert got == {(2, "current"): (-1, 0.5), (3, "next"): (1, 1.0), (3, "longer run"): (-1, 0.25), (3, "sum"): (1, 1.0)}


def test_controls_of_several_symbols(spark):
    spans = spark.createDataFrame([("a", 0, 1000), ("b", 5000, 6000), ("c", None, None)], "symbol string, lo long, hi long")
    got = nulls.trial_times(spans, 3, 4).collect()
    assert len(got) == 24 and all((r.when_us < 1000) == (r.symbol == "a") for r in got)
    chosen = spark.createDataFrame([("a", "x", True, True), ("a", "x", False, True), ("a", "y", True, False), ("a", "y", True, True), ("b", "x", False, False)], "symbol string, arm string, chosen boolean, clean boolean")
    draws = spark.createDataFrame([("a", t, d, (t + d) % 2 == 0) for t in range(4) for d in range(3)], "symbol string, trial long, draw long, clean boolean")
    by = {(r.symbol, r.arm): r for r in nulls.arm_scores(chosen, draws).collect()}
    assert by["a", "x"].null_rate == 0.5 and by["a", "x"].null_sd == 0.5 and by["a", "x"].z == 1.0 and by["a", "x"].fire_rate == 0.5
    assert by["a", "y"].null_rate == 0.5 and by["a", "y"].null_sd == 0.0 and by["a", "y"].z == 0.0 and by["b", "x"].selected == 0 and by["b", "x"].rate == 0.0


def test_disagreements_and_agreement(spark):
    s = spark.createDataFrame([(1, "a", "X", 1), (1, "b", "X", -1), (2, "a", "X", 1), (2, "b", "X", 1), (3, "b", "Y", 1)], "doc long, arm string, symbol string, sign int")
    o = spark.createDataFrame([(1, "X", -1, 30.0), (1, "Z", 1, 99.0), (2, "X", 1, 5.0)], "doc long, symbol string, sign int, move_bps double")
    got = documents.disagreements_with_moves(s, o, "a", "b").collect()
    assert [(r.doc, r.top_bps, None if r.moves is None else [tuple(x) for x in r.moves]) for r in got] == [(1, 30.0, [("X", -30.0)]), (3, None, None)]
    p = spark.createDataFrame([(1, 2.5, 2.45), (2, 2.5, 2.44), (3, 1.0, None), (4, None, 1.0)], "m long, printed double, computed double")
    r = stats.agreement(p, "printed", "computed", ["m"]).first()
    assert (r.n, r.agree, r.share, [x.m for x in r.mismatches]) == (2, 1, 0.5, [2, 3])


def test_temporary_tables_go(spark):
    from pathlib import Path

    from tidemark.schema import stored, temporary_tables

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    kept, before = stored(spark.range(3)), set(shared.glob("tidemark-*"))
    with temporary_tables(spark):
        assert stored(spark.range(5)).count() == 5 and len(set(shared.glob("tidemark-*")) - before) == 1
    assert set(shared.glob("tidemark-*")) == before and kept.count() == 3
