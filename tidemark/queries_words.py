"""Further registered queries: words, moments, scores, arms, books and streams on the driver's tables, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sentences as N
from tidemark.functions import text as T
from tidemark.functions import times as C
from tidemark.operators import documents as D
from tidemark.operators import ledger as B
from tidemark.operators.asof import valid_for
from tidemark.plans import arms as A
from tidemark.plans import scoring as R
from tidemark.queries import DOCS_SQL, FEATURES_SQL, SALTED_SQL, STALE, TICKERS_SQL, docs_of, first_sql, hits_sql, near, query, rate_sql, rounded, salted_of, signals_of, ticks_of, top_sql
from tidemark.schema import TAPE_SQL, micros, scratch, table

# ------------------------------------------------------------------- words

_NAMES = ("Chair Powell", "Vice Chair Smith", "Chairman Pro Tem", "Governor Low", "the chairwoman", "Vice Chairman Old")
_CURRENCIES = ("USD", "EUR", "GBP", "JPY", "SEK")
_STANCES = ("hawkish", "dovish", "neutral")


def picked(names, key, step: int = 1):
    """One of a few fixed words, by a key."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(key / step) % len(names)).cast("int") + 1)


def picked_sql(names, key: str, step: int = 1) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][({key} // {step}) % {len(names)} + 1]"


@query(f"WITH d AS (SELECT doc_id, {picked_sql(_NAMES, 'doc_id')} AS name, {picked_sql(_CURRENCIES, 'doc_id')} AS cur, {picked_sql(_STANCES, 'doc_id', 5)} AS stance, {picked_sql(_STANCES, 'doc_id', 7)} AS later FROM documents), p(cur, symbol, base) AS (VALUES ('USD', 'EURUSD', -1), ('EUR', 'EURUSD', 1), ('GBP', 'GBPUSD', 1), ('JPY', 'USDJPY', -1)), r(s, n) AS (VALUES ('hawkish', 1), ('neutral', 0), ('dovish', -1)) SELECT doc_id, name IN ('Chair Powell', 'Chairman Pro Tem', 'the chairwoman') AS chair, CASE WHEN stance <> 'neutral' THEN symbol END AS symbol, CASE WHEN stance <> 'neutral' THEN base * CASE stance WHEN 'hawkish' THEN 1 ELSE -1 END END AS sign, CASE WHEN symbol = 'USDJPY' THEN 1 ELSE -1 END AS usd, CASE WHEN b.n > a.n THEN 'more_hawkish' WHEN b.n < a.n THEN 'more_dovish' ELSE 'consistent' END AS versus FROM d LEFT JOIN p USING (cur) JOIN r a ON a.s = stance JOIN r b ON b.s = later")
def fn9_pairs(spark, sf_dir):
    """Pairs and sides by currency and stance, the dollar's side, chairs by name, and how a later stance compares."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", picked(_NAMES, i).alias("name"), picked(_CURRENCIES, i).alias("cur"), picked(_STANCES, i, 5).alias("stance"), picked(_STANCES, i, 7).alias("later"))
    pair = A.signed_pair(F.col("cur"), F.col("stance"))
    symbol = A.lookup(F.col("cur"), {k: v[0] for k, v in A.PAIRS.items()})
    return d.select("doc_id", T.is_chair(F.col("name")).alias("chair"), pair["symbol"].alias("symbol"), pair["sign"].alias("sign"), A.dollar_side(symbol, F.lit(1)).alias("usd"), T.versus(F.col("later"), F.col("stance")).alias("versus"))


_ABBREVIATED = ", ".join(f"'{x}'" for x in T.ABBREVIATIONS)
_LAST = "regexp_extract(a, '([^ \\x01]*)$', 1)"
SENTENCES_SQL = f"""f AS (SELECT id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS t FROM docs),
p AS (SELECT id, string_split(regexp_replace(t, '([.!?])\\s+(["“‘(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM f),
g AS (SELECT id, list_reduce(parts, lambda a, x: a || CASE WHEN regexp_matches({_LAST}, '^(?:[A-Za-z]\\.){{1,4}}$') OR lower(rtrim({_LAST}, '.')) IN ({_ABBREVIATED}) THEN ' ' ELSE chr(1) END || x) AS t FROM p),
s AS (SELECT id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x)), lambda x: length(x) >= 20 AND NOT regexp_matches(x, '{T.CHROME}')) AS sentences FROM g)"""


@query(DOCS_SQL + ", " + SENTENCES_SQL + " SELECT id, len(sentences) AS n, md5(array_to_string(sentences, chr(10))) AS digest FROM s")
def fn13_sentences(spark, sf_dir):
    """The sentences of every whole document."""
    s = docs_of(spark, sf_dir).select("id", T.sentences(F.col("body")).alias("s"))
    return s.select("id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n").cast("binary")).alias("digest"))


@query()
def fn15_changed_sentences(spark, sf_dir):
    """What changed between a document and the issuer's edition before: sequence alignment, which SQL can't say (tests compare with difflib)."""
    docs = docs_of(spark, sf_dir).withColumn("title", F.lit("edition")).withColumn("sentences", T.sentences(F.col("body")))
    d = D.previous_edition(docs, ("issuer",), carried="sentences").filter("prev_id IS NOT NULL")
    got = D.changed_sentences(d.select("id", "prev_id", "prev_sentences", "sentences"), "prev_sentences", "sentences")
    return got.select("id", "prev_id", F.size("changes").alias("n"), F.md5(F.to_json("changes").cast("binary")).alias("digest"))


_HEADING = "(?i) (the|der|le|el) "


@query(DOCS_SQL + f" SELECT id, CASE WHEN regexp_matches(body, '{_HEADING}') THEN substring(body, length(regexp_extract(body, '(?is)^(.*?) (the|der|le|el) ', 1)) + 1, 4000) ELSE right(body, 4000) END || chr(10) || issuer AS section FROM docs")
def fn17_section(spark, sf_dir):
    """From a heading on, with the tail of another section; the end of the text where it has none."""
    return docs_of(spark, sf_dir).select("id", T.section(F.col("body"), _HEADING, F.col("issuer")).alias("section"))


_TURNS_SQL = "WITH t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS idx, upper(role) AS speaker, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS text FROM conversations)"


def transcripts_of(spark, sf_dir):
    """Conversations as transcripts: a line for each turn, which begins with the speaker in capitals."""
    said = F.trim(F.regexp_replace("text", "[\\r\\n]+", " "))
    turn = F.struct("turn", "role", F.concat(F.upper("role"), F.lit(": "), said).alias("t"))
    # a transcript is one conversation
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.sort_array(F.collect_list(turn)).alias("r"))
    return rows.select("doc", F.array_join("r.t", "\n").alias("text"))


@query(_TURNS_SQL + " SELECT doc, idx::INT AS idx, speaker, text, CASE WHEN contains(text, '?') THEN 'question' WHEN length(text) < 120 THEN 'moderator' ELSE 'reporter' END AS style FROM t")
def fn18_turns(spark, sf_dir):
    return D.turns(transcripts_of(spark, sf_dir))


@query(_TURNS_SQL + ", c AS (SELECT doc, min(idx) FILTER (WHERE speaker <> 'USER') AS cut FROM t GROUP BY doc) SELECT doc, coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (WHERE idx < coalesce(cut, 1000000)), '') AS remarks, coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (WHERE idx >= cut), '') AS qa FROM t JOIN c USING (doc) GROUP BY doc")
def fn18_remarks(spark, sf_dir):
    """Remarks up to the first turn of another speaker than the first role, and what follows."""
    return D.remarks_and_questions(D.turns(transcripts_of(spark, sf_dir)), F.col("speaker") == "USER")


@query("SELECT page_id, right(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug FROM pages")
def fn42_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(DOCS_SQL + " SELECT id, '{\"issuer\":\"' || issuer || '\",\"kind\":\"' || kind || '\",\"body\":\"' || md5(left(body, 6000)) || '\",\"clocks\":{\"new_york\":\"' || strftime(make_timestamp(ts_us) - INTERVAL 5 HOURS, '%H:%M') || '\",\"london\":\"' || strftime(make_timestamp(ts_us), '%H:%M') || '\",\"tokyo\":\"' || strftime(make_timestamp(ts_us) + INTERVAL 9 HOURS, '%H:%M') || '\"}}' AS state FROM docs")
def fn43_scorer_input(spark, sf_dir):
    """What a scorer sees of a document, as JSON: issuer, kind, the capped body (here its digest) and three clocks."""
    body = F.md5(F.left("body", F.lit(6000)).cast("binary"))
    s = F.struct("issuer", "kind", body.alias("body"), C.clocks(F.timestamp_micros("ts_us")).alias("clocks"))
    return docs_of(spark, sf_dir).select("id", F.to_json(s).alias("state"))


@query("SELECT event_id, (event_id % 3 >= 1)::INT + (event_id % 5 >= 2)::INT + (event_id % 7 >= 3)::INT AS material FROM events")
def fn44_material_changes(spark, sf_dir):
    i = F.col("event_id")
    diffs = F.array(*[F.struct((i % k / (2.0 * least)).alias("material")) for k, least in ((3, 1), (5, 2), (7, 3))])
    return table(spark, sf_dir, "events").select("event_id", F.size(F.filter(diffs, lambda d: d["material"] >= 0.5)).alias("material"))


@query("WITH b AS (SELECT p_partkey, p_size // 4 AS q, p_partkey % 4 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN q * 0.25 WHEN 1 THEN q * 0.25 + 0.25 WHEN 2 THEN q * 0.25 + 0.5 END::DOUBLE AS level FROM b")
def fn30_levels(spark, sf_dir):
    """Labels of histogram rows: a number, a bucket with one quarter point inside, one with several, and words."""
    q, k = F.floor(F.col("p_size") / 4) * 0.25, F.col("p_partkey") % 4
    label = F.when(k == 0, F.format_string("%.2f", q)).when(k == 1, F.concat(F.format_string("%.2f", q + 0.13), F.lit(" - "), F.format_string("%.2f", q + 0.37))).when(k == 2, F.concat(F.format_string("%.2f", q), F.lit("–"), F.format_string("%.2f", q + 1.0))).otherwise("no level")
    return rounded(table(spark, sf_dir, "part").select("p_partkey", T.level_of(label).alias("level")), 9)


# ----------------------------------------------------------------- moments


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts) + INTERVAL 5 HOURS WHEN 3 THEN date_trunc('minute', ts) END AS moment FROM events")
def fn20_moments(spark, sf_dir):
    """Stamps written as RFC 2822, ISO with seven digits, US local text and without seconds are read again; dates alone are refused."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    text = (
        F.when(k == 0, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss 'GMT'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'9Z'"))
        .when(k == 2, F.date_format(ts, "M/d/yyyy h:mm:ss a")).when(k == 3, F.date_format(ts, "EEE, d MMM yyyy HH:mm Z")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    return table(spark, sf_dir, "events").select("event_id", C.moment(text, "America/New_York").alias("moment"))


_NY = "(({0} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


@query(f"WITH r AS (SELECT 'o' || o_orderkey AS id, o_orderdate + INTERVAL 15 HOURS AS ts FROM orders UNION ALL SELECT 'e' || event_id, ts FROM events), l AS (SELECT id, ts, {_NY.format('ts')} AS local FROM r) SELECT id, local, CASE WHEN year(local) >= 2013 THEN ts + INTERVAL 30 MINUTES ELSE (((date_trunc('day', local) + INTERVAL 855 MINUTES) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') END AS start FROM l")
def fn26_conference_starts(spark, sf_dir):
    """The issuer's local clock, summer time included, and when a release's conference begins."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 15 HOURS")).alias("ts"))
    r = o.unionByName(table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")))
    plain = lambda c: c.cast("timestamp_ntz")
    return r.select("id", plain(C.local(F.col("ts"), "America/New_York")).alias("local"), plain(C.conference_start(F.col("ts"))).alias("start"))


@query("SELECT event_id, len(range(date_trunc('hour', ts), date_trunc('hour', ts + to_hours((event_id % 60)::INT)) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hours, date_diff('day', date_trunc('day', ts), date_trunc('day', ts + to_hours((event_id % 60)::INT))) + 1 AS days, date_diff('week', date_trunc('week', ts), date_trunc('week', ts + to_hours((event_id % 60)::INT))) + 1 AS weeks FROM events")
def fn25_covering(spark, sf_dir):
    """How many hours, days and weeks a span touches."""
    ts = F.col("ts").cast("timestamp")
    end = ts + F.make_dt_interval(F.lit(0), (F.col("event_id") % 60).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", *[F.size(C.covering(ts, end, s)).cast("long").alias(s + "s") for s in ("hour", "day", "week")])


_PART_SQL = "WITH p AS (SELECT p_partkey, p_retailprice / 397 AS target, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice / 397 + (p_partkey % 11 - 7) * 0.07 END AS effective FROM part), q AS (SELECT *, CASE WHEN effective IS NULL OR (target >= effective - 0.10 AND target <= effective + 0.60) THEN target END AS plausible FROM p)"


@query(_PART_SQL + " SELECT p_partkey, round_even((effective - target) / 0.25, 0)::INT AS steps, CASE WHEN plausible IS NOT NULL THEN printf('The target range set at the last meeting tops out at %.2f percent', plausible) || CASE WHEN effective IS NOT NULL THEN printf(', and the effective funds rate printed %.2f percent on May 1', effective) ELSE '' END || '.' ELSE printf('The previous statement''s target range could not be parsed; the effective funds rate printed %.2f percent on May 1.', effective) END AS level FROM q")
def fn29_level_sentence(spark, sf_dir):
    """Quarter steps, and the sentence on the level, which needs a plausible target."""
    p = table(spark, sf_dir, "part").withColumn("target", F.col("p_retailprice") / 397)
    p = p.withColumn("effective", F.when(F.col("p_partkey") % 4 > 0, F.col("target") + (F.col("p_partkey") % 11 - 7) * 0.07))
    return p.select("p_partkey", C.quarter_steps(F.col("effective") - F.col("target")).alias("steps"), N.level_sentence(F.col("target"), F.col("effective"), F.lit("May 1")).alias("level"))


_SINCE = "CASE WHEN change IS NULL THEN printf('The {0} is at %.2f percent; there is no reading from the last meeting.', v) ELSE 'The {0} is ' || CASE WHEN change = 0 THEN 'unchanged' ELSE printf('%.0f', round_even(abs(change), 0)) || ' bp ' || CASE WHEN change > 0 THEN 'higher' ELSE 'lower' END END || printf(' than on May 1, at %.2f percent', v) || {1} || '.' END"
_GLOSS = "': ' || CASE WHEN change >= 10 THEN 'the market has moved hawkish since then' WHEN change <= -10 THEN 'the market has moved dovish since then' ELSE 'little changed either way' END"


@query(_PART_SQL.replace("AS effective FROM part", "AS effective, p_retailprice / 500 AS v, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 41 - 20)::DOUBLE END AS change FROM part") + f" SELECT p_partkey, {_SINCE.format('two-year yield', _GLOSS)} AS two, {_SINCE.format('ten-year yield', repr(''))} AS ten FROM q")
def fn28_yields(spark, sf_dir):
    """The yield sentences of the pricing list; the two-year one is glossed."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    value, change = F.col("p_retailprice") / 500, F.when(k % 5 > 0, (k % 41 - 20).cast("double"))
    t = F.col("p_retailprice") / 397
    got = N.pricing_sentences(t, F.when(k % 4 > 0, t + (k % 11 - 7) * 0.07), F.lit("May 1"), F.lit(None).cast("double"), {"2y": (value, change), "10y": (value, change)}, F.lit("May 1"))
    return p.select("p_partkey", F.get(got, F.lit(1)).alias("two"), F.get(got, F.lit(2)).alias("ten"))


@query("""WITH c AS (SELECT p_partkey, p_retailprice / 397 AS was0, p_retailprice / 397 + (p_partkey % 7 - 3) * 0.23 AS now, CASE WHEN p_partkey % 4 = 3 THEN 'longer run' ELSE (2020 + p_partkey % 4)::VARCHAR END AS year FROM part),
d AS (SELECT *, CASE WHEN p_partkey % 5 > 0 THEN was0 END AS was, CASE WHEN year = 'longer run' THEN 'the longer run' ELSE 'end-' || year END AS place, round_even(abs(now - was0) / 0.25, 0)::INT AS n FROM c)
SELECT p_partkey, 'Median projection for ' || place || CASE WHEN was IS NULL THEN printf(' is %.1f%%.', now) WHEN abs(now - was) < 1e-9 THEN printf(' is unchanged at %.1f%%.', now)
  ELSE printf(' moved to %.1f%% from %.1f%%', now, was) || CASE WHEN p_partkey % 3 = 0 THEN ' at the last projection' ELSE ' in March' END || ': ' || CASE WHEN year = 'longer run' THEN CASE WHEN now > was THEN 'a higher' ELSE 'a lower' END || ' neutral rate' WHEN now > was THEN 'fewer cuts' ELSE 'more cuts' END
    || CASE WHEN n > 0 THEN ' (' || n || ' quarter-point step' || CASE WHEN n = 1 THEN '' ELSE 's' END || ')' ELSE '' END || '.' END AS said FROM d""")
def fn28_projections(spark, sf_dir):
    """How each median moved, as a sentence."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    was = F.col("p_retailprice") / 397
    year = F.when(k % 4 == 3, "longer run").otherwise((2020 + k % 4).cast("string"))
    said = N.projection_sentence(year, was + (k % 7 - 3) * 0.23, F.when(k % 5 > 0, was), F.when(k % 3 != 0, F.lit("March")))
    return p.select("p_partkey", said.alias("said"))


@query("""WITH c AS (SELECT p_partkey, p_retailprice / 1000 AS mid, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 61 - 30 + 0.25 END AS day, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 47 - 23 + 0.25 END AS quarter FROM part)
SELECT p_partkey, printf('EURUSD is at %.5f', mid) || CASE WHEN day IS NULL THEN '; there is no price 24 hours back.' ELSE printf(', %.0f', round_even(abs(day), 0)) || CASE WHEN day > 0 THEN ' bp higher' ELSE ' bp lower' END || ' than 24 hours before the release.' END AS first,
  CASE WHEN quarter IS NOT NULL THEN printf('In the fifteen minutes before the release it moved %.0f', round_even(abs(quarter), 0)) || CASE WHEN quarter > 0 THEN ' bp up: ' ELSE ' bp down: ' END || CASE WHEN abs(quarter) < 5 THEN 'the tape was quiet going in' WHEN abs(quarter) < 15 THEN 'some positioning ahead of the release' ELSE 'a large move going in, so something was already being traded' END || '.' END AS second FROM c""")
def fn28_drift(spark, sf_dir):
    """The sentences on the day and the quarter of an hour before a release."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    got = N.drift_sentences(F.lit("EURUSD"), F.col("p_retailprice") / 1000, F.when(k % 4 > 0, k % 61 - 30 + 0.25), F.when(k % 3 > 0, k % 47 - 23 + 0.25))
    return p.select("p_partkey", F.get(got, F.lit(0)).alias("first"), F.get(got, F.lit(1)).alias("second"))


# ------------------------------------------------------------------ scores

_SIX_SQL = "WITH s AS (SELECT event_id AS id, (event_id % 11) / 10.0::DOUBLE * 0.987654321::DOUBLE AS a, (event_id % 7) / 6.0::DOUBLE AS b, (event_id % 5) / 4.0::DOUBLE AS c, (event_id % 13) / 12.0::DOUBLE AS d, (event_id % 17) / 16.0::DOUBLE AS e, (event_id % 3) / 2.0::DOUBLE AS f FROM events)"


def six_of(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i.alias("id"), *[((i % k) / (k - 1)).alias(n) for n, k in zip("abcdef", (11, 7, 5, 13, 17, 3), strict=True)])
    return rows.withColumn("a", F.col("a") * 0.987654321)


@query(_SIX_SQL + near("id", "plain context wire listing", "FROM (SELECT id, least(1, greatest(0, a * b * c * d * (0.7 + 0.3 * e) * (1 - 0.5 * f))) AS plain, least(1, greatest(0, a * b * c * (1 - d))) AS context, least(1, greatest(0, a * b * c * d * (1 - e))) AS wire, least(1, greatest(0, a * b * c * d * (1 - 0.7 * e) * (1 - 0.5 * f))) AS listing FROM s)", 6))
def fn32_strengths(spark, sf_dir):
    c = [F.col(x) for x in "abcdef"]
    return rounded(six_of(spark, sf_dir).select("id", A.strength(*c).alias("plain"), A.context_strength(*c[:4]).alias("context"), A.wire_strength(*c[:5]).alias("wire"), A.listing_strength(*c).alias("listing")), 6)


@query(_SIX_SQL + near("id", "confirm", "FROM (SELECT id, CASE WHEN a >= 0.5 THEN (1 - b) * c ELSE 0 END AS confirm FROM s)", 9))
def fn35_second_stage(spark, sf_dir):
    """Only rows past the gate go to the second scorer."""
    first = six_of(spark, sf_dir)

    def scorer(batches):
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "unaffected": x["b"], "agree": x["c"]})

    return rounded(R.second_stage(first, F.col("a") >= 0.5, scorer, "id long, unaffected double, agree double").select("id", "confirm"), 9)


@query(_SIX_SQL + near("id error tokens", "noul score confidence", "FROM (SELECT id, CASE WHEN id % 10 = 0 THEN 'unreadable' WHEN id % 10 = 1 THEN 'unknown kind' END AS error, CASE WHEN id % 10 <> 0 THEN id % 100 END AS tokens, CASE WHEN id % 10 > 1 THEN a END AS noul, CASE WHEN id % 10 > 1 THEN least(1.0, c * 4 / 2) END AS score, CASE WHEN id % 10 > 1 THEN 1 + (CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END + CASE WHEN q < 1 THEN (1 - q) * ln(1 - q) ELSE 0 END) / ln(2) END AS confidence FROM (SELECT *, exp(b) / (exp(b) + exp(d)) AS q FROM s))", 8))
def fn36_answers(spark, sf_dir):
    """A scorer's JSON answers parsed and checked: a probability, a rubric score as a share of its length, and the confidence of a softmax."""
    kind = F.when(F.col("id") % 10 == 1, "riddle").otherwise("noul")
    answers = F.struct(
        F.struct(kind.alias("type"), F.col("a").alias("noul")).alias("p"),
        F.struct(F.lit("score").alias("type"), (F.col("c") * 4).alias("score"), F.create_map(*[F.lit(x) for x in ("0", "none", "1", "some", "2", "much")]).alias("legend")).alias("s"),
    )
    text = F.when(F.col("id") % 10 == 0, "{ no").otherwise(F.to_json(F.struct(answers.alias("answers"), (F.col("id") % 100).alias("input_tokens"), F.lit(1.5).alias("latency_ms"))))
    got = R.parsed_answers(six_of(spark, sf_dir).withColumn("response", text))
    ok = F.col("error").isNull()
    s = F.col("answers")["s"]
    sure = R.entropy_confidence(R.softmax(F.array("b", "d")))
    return rounded(got.select("id", "error", "tokens", F.col("answers")["p"]["noul"].alias("noul"), F.when(ok, R.normalised(s["score"], s["legend"])).alias("score"), F.when(ok, sure).alias("confidence")), 8)


@query(TAPE_SQL + ", z AS (SELECT symbol, seq, (seq % 21) - 10.0 AS x, (seq % 19) / 9.0 - 1 AS y FROM tape) SELECT symbol, seq, CASE WHEN abs(x) < 0.5 THEN 'flat' ELSE CASE WHEN abs(x) > 4 THEN 'heavily' ELSE 'modestly' END || CASE WHEN x > 0 THEN ' long' ELSE ' short' END END AS held, CASE WHEN y > 0.6 THEN 'almost every recent trade has been someone buying from us' WHEN y > 0.25 THEN 'recent trades have leaned towards people buying from us' WHEN y < -0.6 THEN 'almost every recent trade has been someone selling to us' WHEN y < -0.25 THEN 'recent trades have leaned towards people selling to us' ELSE 'buying and selling have been roughly balanced' END AS flow FROM z")
def fn41_words(spark, sf_dir):
    return ticks_of(spark, sf_dir).select("symbol", "seq", R.inventory_words((F.col("seq") % 21) - 10.0).alias("held"), R.flow_words((F.col("seq") % 19) / 9 - 1).alias("flow"))


# -------------------------------------------------------------------- arms

_PAIR_SQL = "p(cur, symbol, base) AS (VALUES ('USD', 'EURUSD', -1), ('EUR', 'EURUSD', 1), ('GBP', 'GBPUSD', 1), ('JPY', 'USDJPY', -1))"
_LEAN_SQL = SALTED_SQL + f", h AS (SELECT doc_id, {picked_sql(_CURRENCIES, 'doc_id')} AS cur, {hits_sql('t', T.HAWKISH)} AS up, {hits_sql('t', T.DOVISH)} AS down FROM s), {_PAIR_SQL}"


def lean_docs(spark, sf_dir):
    return salted_of(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ts_us"), F.col("t").alias("title"), F.lit("").alias("body"), picked(_CURRENCIES, F.col("doc_id")).alias("currency"))


@query(_LEAN_SQL + " SELECT doc_id AS id, symbol, base * CASE WHEN up > down THEN 1 ELSE -1 END AS sign, 'keyword' AS arm FROM h JOIN p USING (cur) WHERE up <> down UNION ALL SELECT doc_id, symbol, base * CASE WHEN up >= down THEN 1 ELSE -1 END, 'all text' FROM h JOIN p USING (cur)")
def evt10_lean_arms(spark, sf_dir):
    """The keyword arm, silent on ties, and the arm that always takes a side; one table by arm."""
    d = lean_docs(spark, sf_dir)
    return A.keyword_arm(d).unionByName(A.all_text_arm(d)).select("id", "symbol", "sign", "arm")


@query(TICKERS_SQL + f", x AS (SELECT doc_id, CASE WHEN regexp_matches(t, '{T.BEARISH_TITLE}') THEN -1 WHEN regexp_matches(t, '{T.BULLISH_TITLE}') THEN 1 ELSE 0 END AS sign FROM s) SELECT doc_id AS id, n AS symbol, sign, 'title' AS arm FROM e JOIN x USING (doc_id) WHERE r <= 24 AND sign <> 0")
def evt10_title_arm(spark, sf_dir):
    """Listing notices: every ticker of a text on the side its words take."""
    return A.title_arm(lean_docs(spark, sf_dir)).select("id", "symbol", "sign", "arm")


@query(SALTED_SQL + f", b AS (SELECT * FROM s ORDER BY md5('0:' || doc_id), doc_id LIMIT 300), h AS (SELECT doc_id, {hits_sql('t', T.HAWKISH_WIRE)} AS up, {hits_sql('t', T.DOVISH_WIRE)} AS down, {first_sql('t', T.CURRENCIES, 'none')} AS cur FROM b WHERE NOT regexp_matches(t, '{T.NOT_FX}')), p(cur, symbol, base) AS (VALUES ('USD', 'EURUSD', -1), ('EUR', 'EURUSD', 1), ('JPY', 'USDJPY', -1), ('GBP', 'GBPUSD', 1), ('AUD', 'AUDUSD', 1), ('CAD', 'USDCAD', -1), ('CHF', 'USDCHF', -1), ('NZD', 'NZDUSD', 1)) SELECT 'sample:' || doc_id AS id, symbol, base * CASE WHEN up > down THEN 1 ELSE -1 END AS sign FROM h JOIN p USING (cur) WHERE up <> down")
def evt10_sample_arm(spark, sf_dir):
    """The wire arm on a sample of fixed size, which is this arm's feature."""
    return A.sample_arm(lean_docs(spark, sf_dir), 300).select("id", "symbol", "sign")


_ANNOUNCED = ("The bank rate was raised to 4.25 percent. ", "They kept the policy rate at 3-1/2 to 3-3/4 percent. ", "No rate was named here. ")


@query(DOCS_SQL + f""", d AS (SELECT id, ts_us, {picked_sql(_CURRENCIES, 'id')} AS cur, {picked_sql(_ANNOUNCED, 'id', 3)} || body AS body FROM docs), c AS (SELECT cur AS ci, ts_us + (id % 7) * 10000000 AS t, 'rate ' || id AS title, CASE WHEN id % 3 = 0 THEN '3.75%' WHEN id % 3 = 1 THEN '<4.50%' ELSE 'n/a' END AS forecast FROM d),
j AS (SELECT d.id, c.forecast, row_number() OVER (PARTITION BY d.id ORDER BY NOT contains(c.forecast, '%'), c.forecast = '', abs(d.ts_us - c.t), c.title) AS r FROM d JOIN c ON d.cur = c.ci AND abs(d.ts_us - c.t) <= 900000000),
m AS (SELECT d.*, CASE WHEN contains(j.forecast, '%') THEN regexp_extract(j.forecast, '(-?\\d+(?:\\.\\d+)?)', 1)::DOUBLE END AS forecast FROM d JOIN j ON d.id = j.id AND r = 1),
f AS (SELECT id, cur, forecast, nullif(regexp_extract(body, '{T.DECISION}', 1), '') AS decision, nullif(regexp_extract('policy rate' || chr(10) || body, '{T.TARGET}', 1), '') AS target, regexp_extract_all('policy rate' || chr(10) || body, '{T.PERCENT}', 1) AS alone FROM m),
g AS (SELECT id, cur, coalesce({top_sql('decision')}, {top_sql('target')}, CASE WHEN len(alone) = 1 THEN {rate_sql('alone[1]')} END) - forecast AS gap FROM f), {_PAIR_SQL} SELECT id, symbol, base * CASE WHEN gap > 0 THEN 1 ELSE -1 END AS sign FROM g JOIN p USING (cur) WHERE abs(gap) > 1e-9""")
def evt10_surprise_arm(spark, sf_dir):
    """The announced rate against the calendar's forecast."""
    d = docs_of(spark, sf_dir).select("id", "ts_us", F.lit("policy rate").alias("title"), F.concat(picked(_ANNOUNCED, F.col("id"), 3), "body").alias("body"), picked(_CURRENCIES, F.col("id")).alias("currency"))
    f = F.when(F.col("id") % 3 == 0, "3.75%").when(F.col("id") % 3 == 1, "<4.50%").otherwise("n/a")
    cal = d.select("currency", (F.col("ts_us") + (F.col("id") % 7) * 10_000_000).alias("ts_us"), F.concat(F.lit("rate "), F.col("id")).alias("title"), f.alias("forecast"))
    return A.surprise_arm(d, cal).select("id", "symbol", "sign")


@query("WITH r AS (SELECT p_partkey, (p_size % 9) / 4.0::DOUBLE AS rate, (p_size % 7) / 4.0::DOUBLE AS prev_rate, p_retailprice / 397 AS fedfunds, p_retailprice / 397 + (p_partkey % 9 - 4) * 0.5 AS bill6m FROM part), g AS (SELECT *, (rate - prev_rate) - (bill6m - fedfunds) / 4 AS gap FROM r)" + near("p_partkey sign", "gap strength", "FROM (SELECT p_partkey, gap, CASE WHEN abs(gap) < 0.01 THEN 0 ELSE sign(gap) END::INT AS sign, least(1.0, abs(gap) / 0.25) AS strength FROM g)", 9))
def evt11_surprise(spark, sf_dir):
    """What a decision did against what the six-month bill had priced."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select("p_partkey", ((F.col("p_size") % 9) / 4).alias("rate"), ((F.col("p_size") % 7) / 4).alias("prev_rate"), (F.col("p_retailprice") / 397).alias("fedfunds"), (F.col("p_retailprice") / 397 + (k % 9 - 4) * 0.5).alias("bill6m"))
    return rounded(D.surprise(rows).select("p_partkey", "sign", "gap", "strength"), 9)


@query("SELECT event_id AS id, 'purchase' AS symbol, epoch_us(ts) + 1800000000 AS ts_us FROM events WHERE event_type = 'error' AND event_id % 3 = 0")
def evt13_carried(spark, sf_dir):
    """Signals entered at their conference's start; those without one go."""
    s = signals_of(spark, sf_dir).select(F.col("signal_id").alias("id"), "symbol", F.col("when_us").alias("ts_us"))
    starts = s.filter("id % 3 = 0").select("id", (F.col("ts_us") + 1_800_000_000).alias("start_us"))
    return A.carried(s, starts).select("id", "symbol", "ts_us")


# ------------------------------------------------------------------- books

_BOOK_SQL = TAPE_SQL + """, t AS (SELECT symbol, seq, (bid + ask) / 2 AS mid FROM tape), b AS (SELECT symbol, seq, sum(CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END) OVER w AS units, last AS avg_price, sum(last) OVER w AS realized, 0.01 * (seq + 1) AS fees FROM tape WHERE seq % 5 = 2 WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
m AS (SELECT t.symbol, t.seq, t.mid, coalesce(units, 0)::DOUBLE AS units, coalesce((mid - avg_price) * units, 0) AS unrealized, coalesce(realized, 0) + coalesce((mid - avg_price) * units, 0) AS gross, coalesce(fees, 0) AS fees, avg_price FROM t ASOF LEFT JOIN b ON t.symbol = b.symbol AND t.seq >= b.seq)"""


def marked_of(spark, sf_dir):
    """Every tick marked against a book with a row at every fifth."""
    t = ticks_of(spark, sf_dir).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    fills = t.filter("seq % 5 = 2").select("symbol", "seq", F.when(F.col("seq") % 3 == 0, -1).otherwise(1).alias("side"), F.lit(1.0).alias("size"), F.col("last").alias("price"))
    units, paid = B.running_book(fills), B.running_book(fills.withColumn("side", F.lit(-1)))  # running units, and running sums of prices as cash
    b = units.join(paid.select("symbol", "seq", F.col("cash").alias("realized")), ["symbol", "seq"])
    b = b.select(F.lit("r").alias("run"), "symbol", "seq", F.col("inventory").alias("units"), F.col("price").alias("avg_price"), "realized", (0.01 * (F.col("seq") + 1)).alias("fees"))
    return B.marked(b, t)


@query(_BOOK_SQL + near("symbol seq", "units unrealized gross equity", "FROM (SELECT *, gross - fees AS equity FROM m)", 4))
def led4_marked(spark, sf_dir):
    return rounded(marked_of(spark, sf_dir).select("symbol", "seq", "units", "unrealized", "gross", "equity"), 4)


@query(_BOOK_SQL + ", x AS (SELECT symbol, seq, CASE WHEN units <> 0 AND avg_price <> 0 THEN (mid - avg_price) / avg_price * 1e4 * sign(units) ELSE 0 END AS excursion_bps FROM m)" + near("symbol seq stop", "excursion_bps excursion_vols", "FROM (SELECT *, excursion_bps / 2 AS excursion_vols, excursion_bps <= -25 AS stop FROM x)", 4))
def led7_excursions(spark, sf_dir):
    return rounded(B.excursion_flags(marked_of(spark, sf_dir), F.lit(2.0)).select("symbol", "seq", "excursion_bps", "excursion_vols", "stop"), 4)


@query(TAPE_SQL + """, x AS (SELECT symbol, seq, CASE WHEN seq % 17 = 0 THEN 0.0 ELSE ((seq * 7919) % 41 - 20) / 20.0 END::DOUBLE AS ideal FROM tape),
r AS (WITH RECURSIVE f(symbol, seq, p) AS (SELECT symbol, -1::BIGINT, 0.0::DOUBLE FROM (SELECT DISTINCT symbol FROM x) UNION ALL SELECT f.symbol, x.seq, CASE WHEN abs(x.ideal - f.p) >= 0.18 OR (x.ideal = 0 AND f.p <> 0) THEN x.ideal ELSE f.p END FROM f JOIN x ON x.symbol = f.symbol AND x.seq = f.seq + 1) SELECT * FROM f) SELECT symbol, seq, p AS target FROM r WHERE seq >= 0""")
def led5_dead_band(spark, sf_dir):
    ideal = F.when(F.col("seq") % 17 == 0, 0.0).otherwise(((F.col("seq") * 7919) % 41 - 20) / 20.0)
    return B.dead_band(ticks_of(spark, sf_dir).select(F.lit("r").alias("run"), "symbol", "seq", ideal.alias("ideal"))).select("symbol", "seq", "target")


@query(TAPE_SQL + """, x AS (SELECT symbol, seq, (seq * 7919) % 40 * 100000 AS latency FROM tape),
r AS (WITH RECURSIVE f(symbol, seq, free, status) AS (SELECT symbol, -1::BIGINT, -1::BIGINT, '' FROM (SELECT DISTINCT symbol FROM x) UNION ALL SELECT f.symbol, x.seq, CASE WHEN x.seq % 2 = 0 AND x.seq >= f.free THEN x.seq + greatest(1, ceil(least(latency, 2000000) / 1000000.0)::BIGINT) ELSE f.free END, CASE WHEN x.seq % 2 <> 0 THEN 'off' WHEN x.seq < f.free THEN 'busy' WHEN latency > 2000000 THEN 'expired' ELSE 'sent' END FROM f JOIN x ON x.symbol = f.symbol AND x.seq = f.seq + 1) SELECT * FROM f) SELECT symbol, seq, status FROM r WHERE seq >= 0""")
def led6_admitted(spark, sf_dir):
    rows = ticks_of(spark, sf_dir).select(F.lit("r").alias("run"), "symbol", "seq", ((F.col("seq") * 7919) % 40 * 100_000).alias("latency_us"))
    return B.admitted(rows, cadence=2).select("symbol", "seq", "status")


@query(TAPE_SQL + ", s AS (SELECT symbol, seq + seq % 4 AS arrival, seq AS nth, 'stance ' || seq AS name FROM tape WHERE seq % 30 < 2) SELECT t.symbol, t.seq, (SELECT CASE WHEN t.seq - max(arrival) < 20 THEN arg_max(name, (arrival, nth)) END FROM s WHERE s.symbol = t.symbol AND s.arrival <= t.seq AND s.arrival > t.seq - 40) AS s_name FROM tape t")
def led9_stances(spark, sf_dir):
    """The stance in force at each tick: twenty ticks from its arrival, unless a later one arrives."""
    t = ticks_of(spark, sf_dir)
    s = t.filter("seq % 30 < 2").select("symbol", (F.col("seq") + F.col("seq") % 4).alias("arrival"), F.col("seq").alias("nth"), F.concat(F.lit("stance "), "seq").alias("name"))
    return valid_for(t.select("symbol", "seq"), s, 20, ("name",))
