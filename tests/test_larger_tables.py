"""Tests for what the third review projected on larger tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

import tidemark.queries_pages  # noqa: F401
from tidemark.functions import lexicons as V
from tidemark.operators import ledger as B
from tidemark.operators.asof import bounded_asof
from tidemark.plans import arms as A
from tidemark.queries import QUERIES
from tidemark.schema import parts_for
from tidemark.sources import texts, trees

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lexicons_take_texts_one_at_a_time(spark):
    """A worker once turned every batch of texts into Python strings at once."""
    df = spark.createDataFrame([(1, "the fed raised rates"), (2, None)], "id long, t string").select("id", V.lexicon_counts(F.col("t"), V.RULES)["hawks"].alias("n"))
    assert ", 251" in plan_of(df)  # an iterator of Arrow arrays
    assert sorted(map(tuple, df.collect())) == [(1, 1), (2, 0)]


def test_wire_arm_reads_texts_in_one_pass(spark):
    """It once ran some thirteen regular expressions over every text, several of them twice."""
    df = A.wire_arm(spark.createDataFrame([(1, 0, "ecb: euro jumps", ""), (2, 0, "bitcoin jumps, dollar too", ""), (3, 0, "yen", "nothing")], "id long, ts_us long, title string, body string"))
    plan = plan_of(df)
    assert plan.count("ArrowEvalPython") == 1 and "rlike" not in plan.lower() and "regexp" not in plan.lower()
    assert [tuple(r) for r in df.collect()] == [(1, 0, "EURUSD", 1, 1.0, "wire keyword")]


def test_trees_stay_one_row(spark, monkeypatch):
    """Each level of a tree was once stored as rows of its nodes; now only trees of more levels than a step takes need another."""
    calls, keep = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df: calls.append(1) or keep(df))
    text = lambda t: {"node": "text", "text": t}
    flat = json.dumps([{"tag": "div", "child": [{"tag": "p", "child": [text("a &nbsp; b"), {"tag": "b", "child": text("c")}, None, 7, []]}, {"tag": "p", "child": [text("d")]}]}])
    deep = text("end")
    for i in range(40):
        deep = {"tag": "p", "child": [text(str(i)), deep]} if i % 8 == 0 else {"tag": "span", "child": deep}
    rows = [(1, flat), (2, json.dumps(deep)), (3, "<p>x</p><p>y</p>"), (4, '{"a": '), (5, "{}"), (6, None)]
    df = spark.createDataFrame(rows, "id int, body string")
    assert dict(texts.cms_text(df.filter("id <> 2")).select("id", "text").collect()) == {1: "a bc\nd", 3: "x\ny", 4: '{"a":', 5: "", 6: None}
    assert len(calls) == 1
    assert texts.cms_text(df.filter("id = 2")).first().text == "32\n24\n16\n8\n0end"
    assert len(calls) > 2


def test_projection_rows_are_dealt_out(spark):
    """One task once read and worked through the whole file."""
    assert QUERIES["fn31_projection_rows"](spark, SMALL).rdd.getNumPartitions() > 1


def test_containers_are_looked_for_only_where_needed(spark):
    """All containers, paragraphs and the plain page were once made of every page."""
    pages = spark.createDataFrame([(1, '<div class="col-xs-12 col-sm-8 col-md-8">' + "word " * 60 + '</div><div id="content">other</div>'), (2, '<div id="content">' + "more " * 60 + "</div>")], "page_id int, html string")
    df = trees.page_body(pages)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("(coalesce(length(_c0" in plan[: plan.index(f" AS {n}#")].rsplit("\n", 1)[-1] for n in ("_c1", "_c2", "_p", "_all"))
    assert dict(df.select("page_id", "body").collect()) == {1: ("word " * 60).strip(), 2: ("more " * 60).strip()}


def test_parts_follow_the_rows(spark):
    """A shuffle's fixed number of parts once made tasks grow with the tables."""
    assert parts_for(spark, 2_000_000) is None and parts_for(spark, 2_000_001) == 5 and parts_for(spark, 50_000_000) == 100


def test_last_block_of_a_ledger(spark):
    """For the state after the last fill, all fills were once folded twice and all states sorted."""
    rnd = random.Random(3)
    rows = [("r", s, i, rnd.choice([-3.0, -1.0, 2.0, 4.0]), 90 + 20 * rnd.random(), 0.1) for s, n in (("A", 57), ("B", 8), ("C", 40)) for i in range(n)]
    fills = spark.createDataFrame(rows, "run string, symbol string, seq long, delta double, price double, fee double")
    every, last = ({(r.symbol, r.seq): r for r in B.ledger(fills, block=10, last=x).collect()} for x in (False, True))
    assert len(every) == 105 and sorted(last) == sorted(k for k in every if k[1] // 10 == {"A": 5, "B": 0, "C": 3}[k[0]])
    assert all(last[k] == every[k] for k in last)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_buckets_shorter_than_the_bound(spark, direction, strict):
    """Buckets were once raised to the bound, so that many probes met in few of them."""
    rnd = random.Random(5)
    at = lambda: rnd.choice([rnd.randrange(0, 400), rnd.randrange(2000, 2040)])
    stamps = {s: sorted(at() for _ in range(60)) for s in "AB"}
    ticks = spark.createDataFrame([(s, t, i, float(t + i)) for s in "AB" for i, t in enumerate(stamps[s])], "symbol string, ts_us long, seq long, bid double")
    asked = spark.createDataFrame([(i, rnd.choice(["A", "B", "C", None]), rnd.choice([None, *[at() + rnd.randrange(-90, 90) for _ in range(9)]])) for i in range(500)], "id int, symbol string, when_us long")
    look = lambda **kw: sorted(map(tuple, bounded_asof(ticks, asked, 50, direction, strict, values=("bid",), **kw).collect()))
    want = look()
    assert sum(r[-1] is not None for r in want) > 100
    for size in (1, 7, 50):
        assert look(bucket_us=size, parts=3) == want
    used = bounded_asof(ticks, asked, 50, direction, strict, values=("bid",), bucket_us=7)
    assert "/ 7" in used._jdf.queryExecution().optimizedPlan().toString()
