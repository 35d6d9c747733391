"""Registered queries beside their SQL on the smallest tables, and what all of them have in common."""

import re
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark import queries, queries_arms, queries_pages, queries_streams, queries_tables, queries_words  # noqa: F401

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import normal  # noqa: E402

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "study_summary", "evt9_matched_excursions", "fn_tickers", "fn_announced_rate", "led3_ledger", "src2_tick_csv", "src8_posts", "src16_table_cells",
    "jn11_between_releases", "jn19_confusion", "fn13_sentences", "fn20_moments", "fn36_answers", "evt10_surprise_arm", "led4_marked", "led5_dead_band", "led6_admitted", "led9_stances", "str2_late_rows", "str6_event_quotes", "agg14_percentiles", "agg23_agreement", "evt12_projection_arms", "prj12_hosts", "src13_nested_articles", "src14_balanced", "src15_trees", "fn31_projection_rows",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    got, want = normal(queries.QUERIES[name](spark, SMALL).toPandas()), normal(con.sql(queries.ORACLE[name]).df())
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-12)


def test_changed_sentences_leave_a_common_subsequence(spark):
    """Both sides without their changed sentences are one sequence, so the pairs are a whole difference, and no shorter one by much."""
    from pyspark.sql import functions as F

    from tidemark.functions.text import sentences
    from tidemark.operators import documents as D

    d = D.previous_edition(queries.docs_of(spark, SMALL).withColumn("title", F.lit("edition")), ("issuer",)).filter("prev_id IS NOT NULL")
    rows = D.changed_sentences(d, limit=1_000_000).withColumn("a", sentences(F.col("prev_body"))).withColumn("b", sentences(F.col("body"))).select("a", "b", "changes").collect()
    assert len(rows) > 100

    def without(whole, gone):
        """whole less the sentences of gone, taken off in order from the front."""
        kept = list(whole)
        for x in gone:
            kept.remove(x)
        return kept

    def longest(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            before = best[:]
            for j, y in enumerate(b):
                best[j + 1] = before[j] + 1 if x == y else max(before[j + 1], best[j])
        return best[-1]

    for r in rows:
        was, now = [c.was for c in r.changes if c.was], [c.now for c in r.changes if c.now]
        left = sorted(without(r.a, was))
        assert left == sorted(without(r.b, now)) and len(left) <= longest(r.a, r.b)
        if not set(r.a) & set(r.b):
            assert (was, now) == (list(r.a), list(r.b))
    capped = D.changed_sentences(d).select("id", F.size("changes").alias("n")).agg(F.max("n")).first()[0]
    assert capped <= 12


def test_no_query_reads_a_part_of_its_texts():
    for name, sql in queries.ORACLE.items():
        assert not re.search(r"left\(text, ?\d+\)|o_orderkey % 3 = 0 GROUP|event_id % 5 = 0\)$", sql), name
