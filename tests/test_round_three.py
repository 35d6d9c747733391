"""Tests for the findings of the third review."""

import difflib
import math
import random
import re
import statistics

from pyspark.sql import functions as F

from tidemark import queries_words
from tidemark.functions import text as T
from tidemark.operators import documents as D
from tidemark.operators import features as W
from tidemark.operators import labels as L
from tidemark.operators.asof import clamped, stepped
from tidemark.operators import ledger as B
from tidemark.operators import stats as S
from tidemark.plans import arms as A
from tidemark.plans import nulls as N
from tidemark.plans import pricing as E
from tidemark.queries import rounded


def made_bars(spark, n=300, seed=1):
    rnd, out = random.Random(seed), []
    for s, gap in (("A", 10), ("B", 1000)):
        t = 0
        for i in range(n):
            t += rnd.randrange(0, gap)
            out.append((s, t, i, 100 * math.exp(rnd.gauss(0, 0.01))))
    return spark.createDataFrame(out, "symbol string, ts_us long, seq long, close double")


def test_stepped_is_clamped(spark):
    bars = made_bars(spark)
    probes = spark.range(6000).select((F.col("id") * 53 - 1000).alias("when_us"), F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B").otherwise("C").alias("symbol"))
    want = clamped(bars, probes, ("close",)).select("symbol", "when_us", "q_close")
    got = stepped(bars, probes, ("close",)).select("symbol", "when_us", "q_close")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.filter("q_close IS NOT NULL").count() > 100


def test_draws_are_made_by_many_tasks(spark):
    """A trial's draws once were made by one task, as its few rows were brought together."""
    spans = spark.createDataFrame([("A", 0, 10**9, 200_000)], "symbol string, lo long, hi long, n long")
    got = N.trial_times(spans, 3, F.col("n"))
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    rows = got.groupBy("trial").agg(F.count(F.lit(1)), F.min("draw"), F.max("draw"), F.countDistinct("draw")).collect()
    assert sorted(map(tuple, rows)) == [(t, 200_000, 0, 199_999, 200_000) for t in range(3)]
    part = N.trial_times(spans, 3, F.col("n"), low=150_000, only=spark.createDataFrame([("A", 1)], "symbol string, trial long"))
    assert part.exceptAll(got.filter("draw >= 150000 AND trial = 1")).count() == 0 and part.count() == 50_000


def test_conditional_test_draws_in_rounds(spark):
    """All 40 n draws at once and rounds that stop when every trial has enough pick the same draws."""
    bars = L.sigma_bars(made_bars(spark).filter("symbol = 'B'")).cache()
    moments = bars.filter("seq % 9 = 0").select("symbol", (F.col("ts_us") + 1).alias("when_us"))
    got = {r["condition"]: r for r in N.conditional_test(bars, moments, trials=20).collect()}
    most, want = max(r["n"] for r in got.values()), {}
    span = moments.groupBy("symbol").agg(F.min("when_us").alias("lo"), F.max("when_us").alias("hi"))
    rows = L.excursion(clamped(bars, N.trial_times(span, 20, 40 * most), L.SIGMAS)).filter("before >= 0 AND before < 99 AND after IS NOT NULL").orderBy("trial", "draw").collect()
    for r in rows:
        want.setdefault(("quiet before" if r["before"] < 0.7 else "already moving", r["trial"]), []).append(r["after"])
    for c, r in got.items():
        means = [sum(v[: r["n"]]) / r["n"] for (k, _), v in want.items() if k == c and len(v) >= r["n"]]
        assert len(means) == 20 and abs(r["null"] - sum(means) / 20) < 1e-12


def zero_tape(spark):
    """A tick every minute, the seventh at a price of zero."""
    rows = [("A", i * 60_000_000, i, 0.0 if i == 6 else 99.0 + i, 0.0 if i == 6 else 101.0 + i) for i in range(12)]
    return spark.createDataFrame(rows, "symbol string, ts_us long, seq long, bid double, ask double")


def test_a_price_of_zero_is_a_price_where_asked(spark):
    minute, inf = 60_000_000, float("inf")
    s = spark.createDataFrame([(n, "A", at * minute, 1) for n, at in (("into", 4), ("from", 6), ("clear", 8))], "signal_id string, symbol string, when_us long, sign int")
    look = lambda **k: {r["signal_id"]: r for r in E.tick_outcomes(zero_tape(spark), s, (2,), (0,), minute, minute, 90_000_000, 90_000_000, **k).collect()}
    assert set(look()) == {"clear"}
    got = look(zero=True)
    assert set(got) == {"into", "from", "clear"} and got["into"]["fwd_bps"] == -inf and got["from"]["fwd_bps"] == inf and got["from"]["pre_bps"] == -inf and math.isnan(got["from"]["spread_bps"])
    assert got["clear"]["fwd_bps"] == look()["clear"]["fwd_bps"]
    d = {r["signal_id"]: r["drift_0"] for r in E.drift(zero_tape(spark), s.withColumn("when_us", F.col("when_us") + 1000), (2 * minute,), 90_000_000, zero=True).collect()}
    assert d["from"] == -inf and d["clear"] == inf
    r = s.select(F.col("signal_id").alias("id"), "symbol", (F.col("when_us") - 2 * minute).alias("statement_us"), F.col("when_us").alias("start_us"), F.lit("more_hawkish").alias("remarks_vs_statement"), F.lit("consistent").alias("qa_vs_remarks"))
    m = {x["id"]: x for x in A.reversals(r, zero_tape(spark), 2 * minute, 90_000_000, zero=True).collect()}
    assert m["from"]["statement_bps"] == -inf and m["from"]["presser_bps"] == inf and m["into"]["presser_bps"] == -inf


def test_decisions_at_a_price_of_zero_count_where_asked(spark):
    t = zero_tape(spark).select("symbol", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid"))
    d = t.select("symbol", "seq", (F.col("seq") + 1).alias("arrival"), F.lit(0.6).alias("p_up"), F.lit(0.2).alias("p_down"), F.lit(0.4).alias("edge"))
    scored = lambda **k: S.direction_scores(d, t, 2, **k).filter("p IS NOT NULL").count()
    assert scored(zero=True) == scored() + 1


def test_rounding_is_that_of_sql(spark):
    import duckdb

    values = [16.5 * (1 - 5 / 1e6), 0.1234565, 2.0000005, -1.0000015, 5e-7, float("-inf"), 1.5]
    got = [r["x"] for r in rounded(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0.0", [v]).fetchone()[0] for v in values]


def test_an_entry_at_zero_has_no_excursion(spark):
    """Its move once was divided by zero."""
    curve = spark.createDataFrame([(1.0, 5.0, 5.0, 0.0), (2.0, 4.0, -4.0, 4.0), (0.0, 3.0, 0.0, None)], "units double, mid double, unrealized double, avg_price double")
    want = [(0.0, False), (0.0, False), (0.0, False)]
    assert [tuple(r) for r in B.excursion_flags(curve, F.lit(2.0)).select("excursion_bps", "stop").collect()] == want
    assert B.excursion_flags(curve.drop("avg_price").filter("units = 1"), F.lit(2.0)).first()["excursion_bps"] == 0.0


def test_draws_labelled_many_at_a_time(spark):
    bars = made_bars(spark)
    moments = spark.range(500).select(F.lit("B").alias("symbol"), (F.col("id") * 311).alias("when_us"))
    few, many = (L.labelled(bars, moments, 1.0, many=m) for m in (False, True))
    assert few.count() > 100 and few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0


def test_an_event_meets_one_quote(spark):
    """However many quotes lie within the bound, a row of state and one row of output; late rows are in order."""
    import pandas as pd

    from tidemark.streaming.tapes import LastQuotes

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

    class Handle:
        def getValueState(self, *_):
            return Value()

    fold = LastQuotes(100)
    fold.open(Handle())
    rows = lambda *r: pd.DataFrame(r, columns=["ts_us", "event", "seq", "bid", "ask"])
    nan = float("nan")
    assert len(fold.fold("A", rows((5, True, 1, nan, nan)))) == 0
    got = fold.fold("A", rows((10, False, 1, 1.0, 2.0), (10, False, 2, 3.0, 4.0), (10, True, 7, nan, nan), (60, False, 3, 5.0, 6.0)))
    assert got[["event_id", "quote_us", "quote_seq", "bid"]].values.tolist() == [[7, 10, 2, 3.0]]
    got = fold.fold("A", rows((160, True, 8, nan, nan), (161, True, 9, nan, nan)))
    assert got[["event_id", "quote_us", "quote_seq", "bid"]].values.tolist() == [[8, 60, 3, 5.0]]


def test_typical_volatility_is_the_median_of_known_means(spark):
    """No percentile is kept for each row's frame any more; prices of zero leave gaps."""
    rnd = random.Random(5)
    px = [0.0 if 100 <= i < 140 or i % 97 == 0 else rnd.uniform(90, 110) for i in range(5000)]
    ticks = spark.createDataFrame([("A", i, p, p) for i, p in enumerate(px)], "symbol string, seq long, bid double, ask double")
    out = W.volatility_spikes(ticks)
    assert "percentile" not in out._jdf.queryExecution().toString().lower()
    got = {r["seq"]: r for r in out.collect()}
    moved = [abs(math.log(b / a)) if a > 0 and b > 0 else None for a, b in zip(px, px[1:])]
    moved = [None, *moved]
    recent = [[m for m in moved[max(0, i - 23) : i + 1] if m is not None] if i >= 23 else [] for i in range(len(px))]
    recent = [sum(m) / len(m) if m else None for m in recent]
    assert set(got) == {i for i, m in enumerate(recent) if m is not None} and len(got) < 4977
    for i in (23, 60, 123, 150, 421, 422, 600, 4095, 4096, 4300, 4999):
        if i in got:
            past = [m for m in recent[max(0, i - 399) : i + 1] if m is not None]
            assert abs(got[i]["typical"] - statistics.median(past)) < 1e-12
            assert got[i]["spike"] == (len(past) >= 120 and got[i]["recent"] > 2 * got[i]["typical"])


def test_histogram_takes_pages_apart_once(spark):
    """The cells once were made three times, for each side of two joins."""
    from tidemark.sources import texts as X

    page = "<table><tr><th>Level</th><th>2024</th></tr><tr><td>4.00</td><td>3</td></tr></table>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string").withColumn("html", F.concat("html", F.lit("")))
    out = X.histogram(X.table_cells(pages))
    assert "html" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["page_id"], r["year"], r["n"]) for r in out.collect()] == [(1, "2024", 3)]


def plain_sentences(text, least):
    """Sentences part by part: a part that follows an initial or abbreviation is joined to the one before."""
    out = []
    for part in re.split(r"(?<=[.!?])[ ]+(?=[\"“‘(\[]?[A-Z0-9])", re.sub(r"[ \t\n\x0b\f\r\x01]+", " ", text or "").strip(" ")):
        last = part.rsplit(" ", 1)[-1]
        short = re.fullmatch(r"(?:[A-Za-z]\.){1,4}", last) or last.rstrip(".").lower() in T.ABBREVIATIONS
        if out and out[-1][1]:
            out[-1] = (out[-1][0] + " " + part, short)
        else:
            out.append((part, short))
    return [s for s, _ in out if len(s) >= least and not re.match(T.CHROME, s)]


def test_a_text_is_split_into_sentences_once(spark):
    rnd = random.Random(5)
    words = ["A.", "U.S.", "A.B.C.D.E.", "etc.", "Etc..", "no", "No.", "vs!", "vs.!", "vs!.", "Mr.", "..", "...", "!", "(The", "“The", "[9", "the", "Menu", "A long enough sentence.", "End!", "xetc.", "etc.x.", "\U0001f600A.", "é.", ".A.", "A!.", "skip to", "for media inquiries", "for media inquiriess are here now."]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\n", "\t ", "\x01", "\r\n", ""]) for _ in range(rnd.randrange(30))) for _ in range(3000)] + [None, "", " ", "\x01"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for least in (1, 20):
        got = {r.i: r.s for r in rows.select("i", T.sentences(F.col("t"), least).alias("s")).collect()}
        assert got == {i: plain_sentences(t, least) for i, t in enumerate(texts)}
    assert str(T.sentences(F.col("t"))).count("split(") == 1


def told(a, b, limit):
    """The changed slots of difflib's whole list of operations."""
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
        if tag != "equal":
            out += [(a[i1 + k] if i1 + k < i2 else "", b[j1 + k] if j1 + k < j2 else "") for k in range(max(i2 - i1, j2 - j1))]
    return out[:limit]


def test_alignment_ends_with_the_last_slot_told(monkeypatch):
    rnd, calls, find = random.Random(6), [], difflib.SequenceMatcher.find_longest_match
    name = lambda x, i: x[i] if i >= 0 else ""
    for _ in range(500):
        a, b = ([str(rnd.randrange(n)) for _ in range(rnd.randrange(25))] for n in (rnd.choice((3, 30)), rnd.choice((3, 30))))
        for limit in (1, 4, 12, 1000):
            assert [(name(a, i), name(b, j)) for i, j in D.changed_slots(a, b, limit)] == told(a, b, limit)
    monkeypatch.setattr(difflib.SequenceMatcher, "find_longest_match", lambda self, *x: calls.append(x) or find(self, *x))
    a, b = [str(i) for i in range(1000)], [str(i) if i % 2 else "new" for i in range(1000)]
    assert len(D.changed_slots(a, b, 12)) == 12 and len(calls) < 50


def test_changed_sentences_of_lists_and_texts(spark):
    rnd, long = random.Random(7), lambda i: f"Sentence number {i} is long enough."
    lists = [([long(rnd.randrange(40)) for _ in range(rnd.randrange(20))], [long(rnd.randrange(40) + rnd.choice((0, 100))) for _ in range(rnd.randrange(20))]) for _ in range(300)]
    lists += [([], []), ([], [long(1)]), ([long(i) for i in range(20)], []), ([long(1)], [long(i + 50) for i in range(20)])]
    rows = spark.createDataFrame([(i, a, b, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(lists)], "i int, a array<string>, b array<string>, ta string, tb string")
    for old, new in (("a", "b"), ("ta", "tb")):
        for limit in (1, 12):
            got = {r.i: [tuple(c) for c in r.changes] for r in D.changed_sentences(rows, old, new, limit).collect()}
            assert got == {i: told(a, b, limit) for i, (a, b) in enumerate(lists)}
    none = spark.createDataFrame([(None, [long(1)])], "a array<string>, b array<string>")
    assert [tuple(c) for c in D.changed_sentences(none, "a", "b").first().changes] == [("", long(1))]


def test_editions_are_split_and_dealt_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables would not be dealt at all
    try:
        got = queries_words.fn15_changed_sentences(spark, "/root/testdata/sf0.001")
        assert got.count() and got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan
