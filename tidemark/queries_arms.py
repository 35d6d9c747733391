"""Registered queries of arms against their nulls, of arms from scores, projections and rules of one's own, and of crawl permissions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import documents as D
from tidemark.operators import labels as L
from tidemark.operators import stats as S
from tidemark.plans import arms as A
from tidemark.plans import nulls as N
from tidemark.plans import pricing as E
from tidemark.queries import (
    DOCS_SQL, EXCLUDE, H, HIT_SQL, HZ, LATENCIES, NULL_PICK_SQL, NULL_SQL, PER, PRE, SALTED_SQL, SIGMA_SQL, SIGNALS_SQL, SPAN, STALE, TICKERS_SQL, TRIES, WAIT, bars_of, docs_of, near, outcome_sql, outcomes_of, probe_parts, query, rounded,
    salted_of, signals_of, stat_sql, ticks_of, with_nulls_of,
)
from tidemark.queries_tables import medians_of
from tidemark.queries_words import picked, picked_sql
from tidemark.schema import micros, stored, table
from tidemark.sources import permissions as X

# --------------------------------------------------------- arms and nulls

_U = "(('0x' || left(md5(0 || ':' || trial || ':' || draw), 12))::BIGINT::DOUBLE / 281474976710656)"
_MOVES = "abs(ln({c} / b3)) / (sigma * sqrt(3)) AS pre, greatest(abs(ln(a1 / {c})) / sigma, abs(ln(a2 / {c})) / (sigma * sqrt(2)), abs(ln(a3 / {c})) / (sigma * sqrt(3))) AS post"
_AT = "JOIN sg ON sg.symbol = t.symbol AND t.when_us BETWEEN sg.lo AND sg.hi ASOF JOIN n ON n.symbol = t.symbol AND n.ts_us <= t.when_us WHERE b3 IS NOT NULL AND a3 IS NOT NULL"


@query(SIGMA_SQL + f""", p AS (SELECT atm.signal_id, sig.when_us, sig.sign, value > 100 AS large, {_MOVES.format(c="c")} FROM atm JOIN sig USING (signal_id) JOIN k ON event_id = signal_id WHERE b3 IS NOT NULL AND a3 IS NOT NULL),
w AS (SELECT signal_id, when_us, post >= 1 AND pre < 1 AS clean, unnest([{{'arm': 'all', 'chosen': true}}, {{'arm': 'long', 'chosen': sign > 0}}, {{'arm': 'large', 'chosen': large}}]) AS x FROM p),
a AS (SELECT x.arm AS arm, count(*) FILTER (WHERE x.chosen) AS selected, count(*) AS total, count(*) FILTER (WHERE x.chosen AND clean) AS movers FROM w GROUP BY 1),
sp AS (SELECT min(when_us) AS lo, max(when_us) AS hi FROM p), tr AS (SELECT r.i AS trial, d.i AS draw FROM range(400) r(i), (SELECT unnest(range(0, (SELECT max(selected) FROM a))) AS i) d),
tm AS (SELECT trial, draw, 'purchase' AS symbol, lo + floor({_U} * (hi - lo))::BIGINT AS when_us FROM tr, sp),
ta AS (SELECT trial, draw, {_MOVES.format(c="n.close")} FROM tm t {_AT}),
rt AS (SELECT arm, trial, avg((post >= 1 AND pre < 1)::INT::DOUBLE) AS r FROM a JOIN ta ON draw < selected GROUP BY ALL),
z AS (SELECT 'purchase' AS symbol, a.*, movers / selected AS rate, null_rate, null_sd, selected / total AS fire_rate FROM a JOIN (SELECT arm, avg(r) AS null_rate, stddev_pop(r) AS null_sd FROM rt GROUP BY 1) USING (arm))"""
    + near("symbol arm selected total movers", "rate null_rate null_sd z fire_rate", "FROM (SELECT *, CASE WHEN null_sd > 0 THEN (rate - null_rate) / null_sd ELSE 0 END AS z FROM z)"))
def agg25_arm_scores(spark, sf_dir):
    """Move rates of three arms against 400 trials of as many random moments, all arms from one table of draws."""
    bars = stored(bars_of(spark, sf_dir))
    got = stored(L.labelled(bars, signals_of(spark, sf_dir), 1.0))
    named = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), c.alias("chosen")) for a, c in (("all", F.lit(True)), ("long", F.col("sign") > 0), ("large", F.col("arm") == "large"))]))
    selected = got.select("symbol", "clean", named.alias("x")).select("symbol", "x.arm", "x.chosen", "clean")
    spans = got.groupBy("symbol").agg(F.min("when_us").alias("lo"), F.max("when_us").alias("hi"), F.count(F.lit(1)).alias("n"))
    draws = L.labelled(bars, N.trial_times(stored(spans), 400, F.col("n")), 1.0, many=True)
    return rounded(N.arm_scores(selected, draws))


@query(SIGMA_SQL + f""", mo AS (SELECT event_id, ts_us FROM k WHERE event_type = 'error' AND value > 150),
g AS (SELECT CASE WHEN before < 0.7 THEN 'quiet before' ELSE 'already moving' END AS condition, count(*) AS n, avg(after_) AS after FROM (SELECT abs(ln(c / b3)) / (sigma * sqrt(3)) AS before, abs(ln(a1 / c)) / sigma AS after_ FROM atm WHERE b3 IS NOT NULL AND a3 IS NOT NULL AND signal_id IN (SELECT event_id FROM mo)) WHERE before < 99 GROUP BY 1 HAVING count(*) >= 5),
sp AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM mo), tr AS (SELECT r.i AS trial, d.i AS draw FROM range(100) r(i), (SELECT unnest(range(0, 40 * (SELECT max(n) FROM g))) AS i) d),
tm AS (SELECT trial, draw, 'purchase' AS symbol, lo + floor({_U} * (hi - lo))::BIGINT AS when_us FROM tr, sp),
ta AS (SELECT trial, draw, CASE WHEN before < 0.7 THEN 'quiet before' ELSE 'already moving' END AS condition, after_ FROM (SELECT trial, draw, abs(ln(n.close / b3)) / (sigma * sqrt(3)) AS before, abs(ln(a1 / n.close)) / sigma AS after_ FROM tm t {_AT}) WHERE before < 99),
pk AS (SELECT ta.*, n, row_number() OVER (PARTITION BY condition, trial ORDER BY draw) AS r FROM ta JOIN g USING (condition)),
rt AS (SELECT condition, trial, avg(after_) AS m FROM pk WHERE r <= n GROUP BY condition, trial, n HAVING count(*) = n),
z AS (SELECT 'purchase' AS symbol, g.*, coalesce(x.null_, 0) AS "null", coalesce(x.sd, 0) AS null_sd FROM g LEFT JOIN (SELECT condition, avg(m) AS null_, stddev_pop(m) AS sd FROM rt GROUP BY 1) x USING (condition))"""
    + near("symbol condition n", "after null_sd z", ", round(\"null\", 6) + 0.0 AS \"null\" FROM (SELECT *, CASE WHEN null_sd > 0 THEN (after - \"null\") / null_sd ELSE 0 END AS z FROM z)"))
def agg26_matched(spark, sf_dir):
    """Moves after the largest errors, by whether the tape was quiet before, against moments that were as quiet."""
    m = table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 150").select(F.lit("purchase").alias("symbol"), micros(F.col("ts")).alias("when_us"))
    return rounded(N.conditional_test(stored(L.sigma_bars(bars_of(spark, sf_dir))), m, trials=100))


_LATE_SIGNALS = SIGNALS_SQL.replace("sig AS (", "sig0 AS (") + ", sig AS (SELECT signal_id || ':' || l AS signal_id, symbol, when_us, sign, arm, l::BIGINT AS latency_us FROM sig0, (VALUES " + ", ".join(f"({x})" for x in LATENCIES) + ") v(l))"
_FIGURES = "fwd_mean fwd_se hit null_mean null_se z"
_Z_SQL = "CASE WHEN fwd_se * fwd_se + null_se * null_se > 0 THEN (fwd_mean - null_mean) / sqrt(fwd_se * fwd_se + null_se * null_se) ELSE 0 END AS z"
_OWN_LATENCY = outcome_sql((0,), "both_").replace(" CROSS JOIN (VALUES (0::BIGINT)) l(latency_us)", "")


@query(_LATE_SIGNALS + NULL_SQL.replace("sign, arm, signal_id AS source_id", "sign, arm, latency_us, signal_id AS source_id") + ", both_ AS (SELECT signal_id, symbol, when_us, sign, latency_us FROM sig UNION ALL SELECT signal_id, symbol, when_us, sign, latency_us FROM cand)" + _OWN_LATENCY + NULL_PICK_SQL
    + f""", a AS (SELECT latency_us, horizon, {stat_sql('fwd_bps', 'fwd')}, {HIT_SQL} FROM o WHERE signal_id IN (SELECT signal_id FROM sig) GROUP BY ALL),
b AS (SELECT latency_us, horizon, {stat_sql('fwd_bps', 'null')} FROM o JOIN pick USING (signal_id) WHERE source_id IN (SELECT signal_id FROM o) GROUP BY ALL)""" + near("latency_us horizon fwd_n null_n", _FIGURES, f"FROM (SELECT *, {_Z_SQL} FROM a JOIN b USING (latency_us, horizon))"))
def agg27_latency_null(spark, sf_dir):
    """The same signals entered later and later, each latency against draws of its own, all priced by one set of look-ups."""
    t = stored(ticks_of(spark, sf_dir))
    late = signals_of(spark, sf_dir).withColumn("latency_us", F.explode(F.array(*[F.lit(x).cast("long") for x in LATENCIES]))).withColumn("signal_id", F.concat_ws(":", "signal_id", "latency_us"))
    parts = probe_parts(late)
    real, nulls = N.with_nulls(late, lambda s, carry: E.tick_outcomes(t, s, HZ, None, PRE, H, STALE, WAIT, carry, zero=True, parts=parts), PER, TRIES, SPAN, EXCLUDE)
    return rounded(N.with_null_figures(real, nulls, ["latency_us", "horizon"]).select("latency_us", "horizon", "fwd_n", "fwd_mean", "fwd_se", "hit", "null_n", "null_mean", "null_se", "z"))


@query(SIGNALS_SQL + NULL_SQL + ", both_ AS (SELECT signal_id::VARCHAR AS signal_id, symbol, when_us, sign FROM sig UNION ALL SELECT signal_id, symbol, when_us, sign FROM cand)" + outcome_sql((1_000_000,), "both_") + NULL_PICK_SQL
    + f""", real AS (SELECT o.*, unnest([CASE WHEN sig.signal_id % 2 = 0 THEN 'in' ELSE 'out' END, 'pooled']) AS split FROM o JOIN sig ON o.signal_id = sig.signal_id::VARCHAR),
a AS (SELECT symbol, horizon, split, {stat_sql('fwd_bps', 'fwd')}, {HIT_SQL} FROM real GROUP BY ALL),
b AS (SELECT symbol, horizon, {stat_sql('fwd_bps', 'null')} FROM o JOIN pick USING (signal_id) WHERE source_id::VARCHAR IN (SELECT signal_id FROM real) GROUP BY ALL)""" + near("symbol horizon split fwd_n null_n", _FIGURES, f"FROM (SELECT *, {_Z_SQL} FROM a JOIN b USING (symbol, horizon))"))
def agg29_split_null(spark, sf_dir):
    """In the sample, out of it and pooled; the null is drawn once for each symbol and shared."""
    real, nulls = with_nulls_of(ticks_of(spark, sf_dir), signals_of(spark, sf_dir))
    rows = S.in_and_out(real, F.col("signal_id").cast("long") % 2 == 0)
    return rounded(N.with_null_figures(rows, nulls, ["symbol", "horizon", "split"], ["symbol", "horizon"]).select("symbol", "horizon", "split", "fwd_n", "fwd_mean", "fwd_se", "hit", "null_n", "null_mean", "null_se", "z"))


_TWO_ARMS = ", two AS (SELECT signal_id AS doc, 'a' AS arm, symbol, sign FROM sig WHERE signal_id % 2 = 0 UNION ALL SELECT signal_id, 'b', symbol, CASE WHEN signal_id % 5 = 0 THEN -sign ELSE sign END FROM sig WHERE signal_id % 4 <> 3)"


@query(SIGNALS_SQL + outcome_sql((1_000_000,)) + _TWO_ARMS + """, x AS (SELECT doc, max(CASE WHEN arm = 'a' THEN sign END) AS a, max(CASE WHEN arm = 'b' THEN sign END) AS b FROM two GROUP BY doc),
m AS (SELECT signal_id AS doc, sign * fwd_bps AS bps FROM o WHERE horizon = 6)""" + near("doc n_a n_b", "bps top_bps", "FROM (SELECT doc, (a IS NOT NULL)::BIGINT AS n_a, (b IS NOT NULL)::BIGINT AS n_b, bps, abs(bps) AS top_bps FROM x LEFT JOIN m USING (doc) WHERE a IS DISTINCT FROM b)"))
def jn17_moves(spark, sf_dir):
    """Signals that two arms took differently, with what the tape did, whichever side either took."""
    s = signals_of(spark, sf_dir)
    doc = F.col("signal_id").alias("doc")
    two = s.filter("signal_id % 2 = 0").select(doc, F.lit("a").alias("arm"), "symbol", "sign").unionByName(s.filter("signal_id % 4 <> 3").select(doc, F.lit("b").alias("arm"), "symbol", F.when(F.col("signal_id") % 5 == 0, -F.col("sign")).otherwise(F.col("sign")).alias("sign")))
    moves = outcomes_of(ticks_of(spark, sf_dir), s).filter("horizon = 6").select(doc, "symbol", "sign", F.col("fwd_bps").alias("move_bps"))
    got = D.disagreements_with_moves(two, moves, "a", "b")
    return rounded(got.select("doc", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.get("moves", F.lit(0))["bps"].alias("bps"), "top_bps"))


# ------------------------------------------------------- arms from scores

_CURRENCIES, _DIRECTIONS = ("USD", "EUR", "GBP", "JPY", "SEK"), ("hawkish", "dovish", "neutral")


@query(f"WITH d AS (SELECT doc_id AS id, doc_id * 60000000 AS ts_us, {picked_sql(_CURRENCIES, 'n_chars')} AS cur, {picked_sql(_DIRECTIONS, 'n_chars', 5)} AS dir, (n_chars % 100) / 100.0 AS confidence, coalesce(quality, 0) * (n_chars % 37) / 36.0 AS strength FROM documents LEFT JOIN labels USING (doc_id)), p(cur, symbol, base) AS (VALUES ('USD', 'EURUSD', -1), ('EUR', 'EURUSD', 1), ('GBP', 'GBPUSD', 1), ('JPY', 'USDJPY', -1))" + near("id ts_us symbol sign arm", "strength", "FROM (SELECT id, ts_us, symbol, base * CASE dir WHEN 'hawkish' THEN 1 ELSE -1 END AS sign, strength::DOUBLE AS strength, 'reader' AS arm FROM d JOIN p USING (cur) WHERE dir <> 'neutral' AND strength >= 0.2 AND confidence >= 0.5)"))
def evt10_reader_arm(spark, sf_dir):
    """Scored documents as signals, behind the gate of strength and confidence."""
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 60_000_000).alias("ts_us"), picked(_CURRENCIES, n).alias("currency"), picked(_DIRECTIONS, n, 5).alias("direction"), (n % 100 / 100).alias("confidence"), (F.coalesce("quality", F.lit(0)) * (n % 37) / 36).alias("score"))
    return rounded(A.reader_arm(rows, F.col("score"), 0.2))


def _notices(spark, sf_dir):
    return salted_of(spark, sf_dir).select(F.col("doc_id").alias("id"), (F.col("doc_id") * 60_000_000).alias("ts_us"), F.lit("").alias("title"), F.col("t").alias("body"))


@query(TICKERS_SQL + " SELECT doc_id AS id, doc_id * 60000000 AS ts_us, n AS symbol, 1 AS sign, 'mentions' AS arm FROM e WHERE r <= 24")
def evt10_mentions_arm(spark, sf_dir):
    """Every ticker that a whole document names, always long."""
    return A.mentions_arm(_notices(spark, sf_dir)).select("id", "ts_us", "symbol", "sign", "arm")


@query(SALTED_SQL + f", w AS (SELECT doc_id AS id, doc_id * 60000000 AS ts_us, t FROM s), r AS (SELECT id, ts_us, unnest([{{'symbol': 'EURUSD', 'sign': CASE WHEN regexp_matches(t, '(?i)\\bfed\\b') THEN -2 ELSE 0 END, 'strength': 0.5}}, {{'symbol': 'USDJPY', 'sign': CASE WHEN length(t) % 2 = 0 THEN 1 ELSE -1 END, 'strength': (length(t) % 4) / 4.0}}], recursive := true) FROM w) SELECT id, ts_us, symbol, sign(sign)::INT AS sign, strength::DOUBLE AS strength, 'own' AS arm FROM r WHERE sign <> 0 AND strength > 0")
def udf4_user_arm(spark, sf_dir):
    """A rule of one's own, a column of signals over whole documents."""
    t = F.col("body")
    one = F.struct(F.lit("EURUSD").alias("symbol"), F.when(T.keyword_hit(t, ["fed"]), -2).otherwise(0).alias("sign"), F.lit(0.5).alias("strength"))
    two = F.struct(F.lit("USDJPY").alias("symbol"), F.when(F.length(t) % 2 == 0, 1).otherwise(-1).alias("sign"), (F.length(t) % 4 / 4).alias("strength"))
    return A.user_arm(_notices(spark, sf_dir), F.array(one, two), "own")


_PROJECTED = """WITH c AS (SELECT p_size AS meeting, CASE WHEN p_partkey % 4 = 3 THEN 'longer run' ELSE (2020 + p_partkey % 4)::VARCHAR END AS year, quantile_cont(p_retailprice / 1000, 0.5) AS median FROM part GROUP BY 1, 2),
m AS (SELECT meeting, lag(meeting) OVER (ORDER BY meeting) AS prev FROM (SELECT DISTINCT meeting FROM c)),
y AS (SELECT *, CASE WHEN year <> 'longer run' THEN row_number() OVER (PARTITION BY meeting, year <> 'longer run' ORDER BY year) - 1 END AS place FROM c),
j AS (SELECT y.meeting, y.year, y.place, y.median AS now, b.median AS was FROM y JOIN m USING (meeting) JOIN c b ON b.meeting = m.prev AND b.year = y.year),
v AS (SELECT meeting, CASE WHEN place IS NULL THEN 'longer run' WHEN place = 0 THEN 'current' WHEN place = 1 THEN 'next' WHEN place = 2 THEN 'two out' END AS variant, now - was AS delta FROM j UNION ALL SELECT meeting, 'sum', sum(now) - sum(was) FROM j WHERE place IS NOT NULL GROUP BY meeting HAVING count(*) >= 2)"""


@query(_PROJECTED + near("id ts_us symbol sign arm", "strength", "FROM (SELECT meeting AS id, meeting * 1000000 AS ts_us, 'EURUSD' AS symbol, -sign(delta)::INT AS sign, least(1.0, abs(round_even(round(delta / 0.25, 9), 0)) / 4) AS strength, 'projections: ' || variant AS arm FROM v WHERE variant IS NOT NULL AND abs(delta) >= 1e-9)"))
def evt12_projection_arms(spark, sf_dir):
    """The five projection variants over parts as printed projections."""
    year = F.when(F.col("p_partkey") % 4 == 3, A.LONGER_RUN).otherwise((2020 + F.col("p_partkey") % 4).cast("string"))
    m = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("meeting"), year.alias("year")).agg(F.percentile(F.col("p_retailprice") / 1000, F.lit(0.5)).alias("median"))
    return rounded(A.projection_arms(m, m.select("meeting", (F.col("meeting") * 1_000_000).cast("long").alias("ts_us")).distinct()))


@query("""WITH c AS (SELECT p_size AS meeting, 2020 + p_partkey % 4 AS year, quantile_cont(p_retailprice / 1000, 0.5) AS median FROM part GROUP BY 1, 2),
p AS (SELECT meeting, year, floor(median * 10 + 0.5) / 10 + CASE WHEN meeting % 10 = 3 THEN 0.1 ELSE 0 END AS printed, CASE WHEN meeting % 25 <> 4 THEN median END AS computed FROM c),
r AS (SELECT *, coalesce(abs(floor(abs(computed) * 10 + 0.5) / 10 - printed) < 1e-9, false) AS same FROM p),
f AS (SELECT count(computed) AS n, count(*) FILTER (WHERE same) AS agree FROM r)
SELECT n, agree, round(agree / n, 6) + 0.0 AS share, (SELECT string_agg(meeting || ':' || year, ',' ORDER BY meeting, year) FROM (SELECT * FROM r WHERE NOT same ORDER BY meeting, year LIMIT 30)) AS mismatches FROM f""")
def agg23_agreement(spark, sf_dir):
    """Printed medians against computed ones; every tenth meeting is misprinted, some have no histogram."""
    m = medians_of(spark, sf_dir)
    printed = S.round_tenth(F.col("median")) + F.when(F.col("meeting") % 10 == 3, 0.1).otherwise(0.0)
    got = S.agreement(m.select("meeting", "year", printed.alias("printed"), F.when(F.col("meeting") % 25 != 4, F.col("median")).alias("computed")), "printed", "computed", ["meeting", "year"], 30)
    return rounded(got.select("n", "agree", "share", F.array_join(F.transform("mismatches", lambda x: F.concat_ws(":", x["meeting"], x["year"])), ",").alias("mismatches")))


_KEYWORDS = ("fed", "ECB", "will list", "yen")


@query(SALTED_SQL + " SELECT doc_id, regexp_matches(t, '(?i)\\b(fed|ECB|will list|yen)\\b') AS hit FROM s")
def fn1_keyword_hits(spark, sf_dir):
    """Whether a word of a list stands in a whole text."""
    return salted_of(spark, sf_dir).select("doc_id", T.keyword_hit(F.col("t"), list(_KEYWORDS)).alias("hit"))


# ------------------------------------------------------ crawl permissions

#: Three robots texts; a host has the one that the length of its name picks.
_ROBOTS = (
    "# all\nUser-agent: *\nDisallow: /en/1\nAllow: /en/1*5$ # fives\nDisallow:\n\nSitemap: /map.xml\nUser-agent: BotA\nUser-agent: BotB\nDisallow: /*?utm_source=\nAllow: /fr/",
    "User-agent: botb\r\nDisallow: /\r\nAllow: /es/\r\nAllow: /en/*\r\nDisallow: /en/*.html$\r\n",
    "User-agent: other\nDisallow: /\nUser-agent: BotA\nDisallow: /de/2\nAllow: /de/2",
)
_RULES = (
    (0, "*", False, "/en/1", "^/en/1"), (0, "*", True, "/en/1*5$", "^/en/1.*5$"), (0, "bota", False, "/*?utm_source=", "^/.*\\?utm_source="), (0, "bota", True, "/fr/", "^/fr/"), (0, "botb", False, "/*?utm_source=", "^/.*\\?utm_source="), (0, "botb", True, "/fr/", "^/fr/"),
    (1, "botb", False, "/", "^/"), (1, "botb", True, "/es/", "^/es/"), (1, "botb", True, "/en/*", "^/en/.*"), (1, "botb", False, "/en/*.html$", "^/en/.*\\.html$"),
    (2, "other", False, "/", "^/"), (2, "bota", False, "/de/2", "^/de/2"), (2, "bota", True, "/de/2", "^/de/2"),
)
_AGENTS = ("BotA", "botb", "*")
_URL = "^[a-z]+://([^/?#]+)(/[^#]*)?"


@query(f"WITH p AS (SELECT page_id, regexp_extract(url, '{_URL}', 1) AS host, regexp_extract(url, '{_URL}', 2) AS path FROM pages), r(t, agent, allow, pattern, re) AS (VALUES " + ", ".join(str(r).replace("\\\\", "\\") for r in _RULES)
    + "), h AS (SELECT page_id, agent, arg_max({'a': allow, 'p': pattern}, {'n': length(pattern), 'a': allow}) AS v FROM p JOIN r ON length(host) % 3 = t AND regexp_matches(path, re) WHERE agent IN ('bota', 'botb', '*') GROUP BY ALL), b AS (SELECT page_id, arg_min({'g': agent, 'p': v.p}, CASE agent WHEN 'bota' THEN 1 WHEN 'botb' THEN 2 ELSE 3 END) AS b FROM h WHERE NOT v.a GROUP BY 1) SELECT page_id, b IS NULL AS allowed, b.g AS blocked_by, b.p AS rule FROM p LEFT JOIN b USING (page_id)")
def prj12_hosts(spark, sf_dir):
    """Every page against its own host's robots text: which agent's rule forbids it."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _URL, 1).alias("host"), F.regexp_extract("url", _URL, 2).alias("path"))
    robots = p.select("host").distinct().withColumn("text", F.element_at(F.array(*[F.lit(t) for t in _ROBOTS]), F.length("host") % 3 + 1))
    return X.permitted(p, X.robots_rules(robots), F.col("host"), F.col("path"), _AGENTS).select("page_id", "allowed", "blocked_by", "rule")
