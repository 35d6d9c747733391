"""Editions, merges, calendars and point-in-time context over dated documents."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import sentences, title_family
from tidemark.operators.asof import carried_asof
from tidemark.schema import DAY, SECOND


def _latest_before(rows: DataFrame, keys: list[str], held: Column, name: str, bucket_us: int = DAY) -> DataFrame:
    """rows with `name` = (ts_us, id) of the latest row of the same keys with a smaller stamp for which `held` is true.

    Only stamps and ids are carried, over buckets of time, so an issuer with most of the documents spreads
    over its days, of which each leaves one row to be carried on; equal stamps share their predecessor.
    """
    rows = rows.withColumn("_found", F.when(held, F.struct("ts_us", "id"))).withColumn("_bucket", F.coalesce(F.floor(F.col("ts_us") / bucket_us), F.lit(0)))
    ends = rows.groupBy(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b")).agg(F.max("_found").alias("_end"))
    before = Window.partitionBy(*[f"_k_{i}" for i in range(len(keys))]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.max("_end").over(before)).drop("_end")
    own = Window.partitionBy(*keys, "_bucket").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    got = rows.withColumn("_own", F.max("_found").over(own)).join(ends, [*same, F.col("_bucket") == F.col("_b")], "left")
    return got.withColumn(name, F.when(F.col("ts_us").isNotNull(), F.coalesce("_own", "_carry"))).drop("_found", "_bucket", "_own", "_carry", "_b", *[f"_k_{i}" for i in range(len(keys))])


def _with_values(docs: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """docs with prev_id, prev_ts_us and prev_<value> from found (_row id, _p): texts meet by id, once each, after all order is known.

    An earlier text is taken to those who follow it first; docs are dealt by (id, ts_us) for that and for what
    it meets there, so where both need the same columns Spark makes and shuffles them once.
    """
    bodies = docs.select(F.col("id").alias("_pid"), F.col("ts_us").alias("_pts"), F.col(value).alias("prev_" + value))
    pairs = found.filter("_p IS NOT NULL").select(F.col("id").alias("_id"), F.col("ts_us").alias("_ts"), "_p")
    pairs = pairs.join(bodies, F.col("_p.id").eqNullSafe(F.col("_pid")) & F.col("_p.ts_us").eqNullSafe(F.col("_pts")), "left")
    got = docs.join(pairs, F.col("id").eqNullSafe(F.col("_id")) & F.col("ts_us").eqNullSafe(F.col("_ts")), "left")
    return got.select(*docs.columns, F.col("_p.id").alias("prev_id"), F.col("_p.ts_us").alias("prev_ts_us"), "prev_" + value)


def previous_edition(docs: DataFrame, keys: tuple[str, ...] = ("issuer", "kind"), title: str = "title", value: str = "body", carried: str | None = None) -> DataFrame:
    """docs (id, ts_us, ...) with prev_id, prev_ts_us and prev_<value>: the latest earlier one of the same keys and title family that has a body.

    Earlier means a smaller stamp: documents of one stamp share their predecessor. (id, ts_us) must be unique.
    carried: a column made from the body, such as its sentences, that is brought along in the body's place.
    """
    rows = docs.select("id", "ts_us", *keys, title_family(F.col(title)).alias("_family"), (F.coalesce(F.length(value), F.lit(0)) > 0).alias("_has"))
    return _with_values(docs, _latest_before(rows, [*keys, "_family"], F.col("_has"), "_p"), carried or value)


def previous_with_fallback(docs: DataFrame, statement: Column, keys: tuple[str, ...] = ("issuer",), value: str = "body") -> DataFrame:
    """previous_edition, else the latest earlier statement of any family by the same keys. (id, ts_us) must be unique."""
    has = F.coalesce(F.length(value), F.lit(0)) > 0
    rows = docs.select("id", "ts_us", *keys, "kind", title_family(F.col("title")).alias("_family"), has.alias("_has"), statement.alias("_statement"))
    rows = _latest_before(rows, [*keys, "kind", "_family"], F.col("_has"), "_e")
    rows = _latest_before(rows, list(keys), F.col("_has") & F.col("_statement"), "_f").withColumn("_p", F.coalesce("_e", "_f"))
    return _with_values(docs, rows, value)


def changed_slots(a: list, b: list, limit: int) -> list[tuple[int, int]]:
    """The first `limit` places (in a, in b) at which difflib's alignment of two lists differs; -1 where one side has none.

    What lies left of a longest match is aligned before what lies right of it, so nothing beyond the last
    slot told is aligned; the slots are those of get_opcodes().
    """
    matcher, out, spans = difflib.SequenceMatcher(a=a, b=b, autojunk=False), [], [(0, len(a), 0, len(b))]
    while spans and len(out) < limit:
        i1, i2, j1, j2 = spans.pop()
        i, j, n = matcher.find_longest_match(i1, i2, j1, j2)
        if n:
            spans += [(i + n, i2, j + n, j2), (i1, i, j1, j)]
        else:
            out += [(i1 + k if i1 + k < i2 else -1, j1 + k if j1 + k < j2 else -1) for k in range(max(i2 - i1, j2 - j1))]
    return out[:limit]


def changed_sentences(docs: DataFrame, old: str = "prev_body", new: str = "body", limit: int = 12) -> DataFrame:
    """docs with `changes`, at most `limit` (was, now) pairs of the slots that differ, in order; '' where one side has none.

    old, new: texts, or arrays of their sentences. Sentences are split in the JVM, where two lists without a
    common sentence are paired slot by slot, which is their alignment; only other pairs of lists are aligned
    in Python, on numbers that stand for equal sentences.
    """
    kind = pa.list_(pa.struct([("was", pa.string()), ("now", pa.string())]))
    types = dict(docs.dtypes)
    split = lambda c: sentences(F.col(c)) if types[c] == "string" else F.coalesce(F.col(c), F.array().cast("array<string>"))

    def pairs(a: pa.Array, b: pa.Array) -> list[dict]:
        codes = pa.concat_arrays([a, b]).dictionary_encode().indices.to_pylist()
        told = lambda x, i: x[i].as_py() if i >= 0 else ""
        return [{"was": told(a, i), "now": told(b, j)} for i, j in changed_slots(codes[: len(a)], codes[len(a) :], limit)]

    @F.arrow_udf("array<struct<was:string,now:string>>")
    def diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:  # a pair at a time, so a worker holds the batch itself and one pair's numbers
            yield pa.array((pairs(x.values, y.values) if x.is_valid else None for x, y in zip(a, b, strict=True)), kind)

    given = docs.withColumns({"_old": split(old), "_new": split(new)}).withColumn("_meet", F.coalesce(F.arrays_overlap("_old", "_new"), F.lit(True)))
    slots = F.zip_with(F.slice("_old", 1, limit), F.slice("_new", 1, limit), lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("was"), F.coalesce(y, F.lit("")).alias("now")))
    aligned = diff(F.when(F.col("_meet"), F.col("_old")), F.when(F.col("_meet"), F.col("_new")))
    return given.withColumn("changes", F.when(F.col("_meet"), aligned).otherwise(slots)).drop("_old", "_new", "_meet")


def merged(rows: DataFrame, key: str = "id", order: str = "ord", fields: tuple[str, ...] = ("text", "url", "headline", "published")) -> DataFrame:
    """One row per key: for each field the first value that isn't blank, in the order given; copies and filled fields counted."""
    blank = lambda f: F.coalesce(F.trim(f), F.lit("")) == ""
    firsts = [F.min_by(f, F.when(~blank(F.col(f)), F.col(order))).alias(f) for f in fields]
    lead = F.min(order)
    got = rows.groupBy(key).agg(*[F.when(F.count_if(~blank(F.col(f))) > 0, x).alias(f) for f, x in zip(fields, firsts, strict=True)], F.count(F.lit(1)).alias("copies"), *[F.min(F.when(~blank(F.col(f)), F.col(order))).alias(f"_{f}") for f in fields], lead.alias("_lead"))
    filled = sum((F.when(F.col(f"_{f}") > F.col("_lead"), 1).otherwise(0) for f in fields), F.lit(0))
    return got.withColumn("filled", filled).drop(*[f"_{f}" for f in fields], "_lead")


def near_duplicate_headlines(rows: DataFrame, title: str = "title", order: tuple[str, ...] = ("ts_us", "id")) -> DataFrame:
    """The first row, in time order, of each opening: the first seven words of the title in lower case without other signs."""
    key = F.trim(F.regexp_replace(F.lower(F.col(title)), "[^a-z0-9 ]", ""))
    opening = F.array_join(F.slice(F.split(key, r"\s+"), 1, 7), " ")
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))  # combines before the shuffle, so a common opening is no hot group
    return rows.withColumn("_key", opening).filter(F.col("_key") != "").groupBy("_key").agg(first.alias("_r")).select("_r.*")


def latest_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key in an order; put the other way round for the first."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("_v")).select(*keys, "_v.*")


def merge_register(stored: DataFrame, fresh: DataFrame, key: list[str], order: str) -> DataFrame:
    """Stored rows whose keys the fresh ones lack, and the fresh ones, in order."""
    return stored.join(fresh, key, "left_anti").unionByName(fresh, allowMissingColumns=True).orderBy(order)


def match_calendar(releases: DataFrame, calendar: DataFrame, bound_us: int = 900 * SECOND) -> DataFrame:
    """releases (id, currency, ts_us) with the best calendar row within the bound: rate rows with %, then any %, then any forecast, then the closest.

    Moments are bucketed by the bound and calendar rows put into both neighbours, so the join is on equal keys.
    """
    b = F.floor(F.col("ts_us") / bound_us)
    cal = calendar.select(F.col("currency").alias("_c"), F.explode(F.array(b - 1, b, b + 1)).alias("_b"), F.col("ts_us").alias("_t"), F.col("title").alias("cal_title"), F.col("forecast").alias("cal_forecast"), F.col("actual").alias("cal_actual") if "actual" in calendar.columns else F.lit(None).cast("string").alias("cal_actual"))
    rows = releases.withColumn("_bb", b).join(cal, (F.col("currency") == F.col("_c")) & (F.col("_bb") == F.col("_b")))
    gap = F.abs(F.col("ts_us") - F.col("_t"))
    pct = F.coalesce(F.col("cal_forecast").contains("%"), F.lit(False))
    rate = F.regexp_like(F.col("cal_title"), F.lit("(?i)rate"))
    rank = F.struct((~(rate & pct)).alias("a"), (~pct).alias("b"), (F.coalesce(F.col("cal_forecast"), F.lit("")) == "").alias("c"), gap.alias("d"), F.col("cal_title").alias("e"))
    best = rows.filter(gap <= bound_us).groupBy("id").agg(F.min_by(F.struct("cal_title", "cal_forecast", "cal_actual", F.col("_t").alias("cal_ts_us")), rank).alias("_v"))
    return releases.join(best.select("id", "_v.*"), "id", "left")


def between_releases(releases: DataFrame, remarks: DataFrame, chair: Column, chars: int = 700, n_chair: int = 3, n_other: int = 8) -> DataFrame:
    """Rows (release_id, remark_id, is_chair, rank, body): remarks strictly between a release and the one before of its issuer.

    The chair's last n_chair with a body, cut, and the last n_other of the others without.
    """
    w = Window.partitionBy("issuer").orderBy("ts_us")  # an issuer's releases, a few a year
    spans = releases.select(F.col("id").alias("release_id"), F.col("issuer").alias("symbol"), F.col("ts_us"), F.lit(0).cast("long").alias("seq"), F.lag("ts_us").over(w).alias("lo"))
    said = remarks.withColumn("is_chair", chair).select(F.col("id").alias("remark_id"), F.col("issuer").alias("symbol"), F.col("ts_us").alias("when_us"), "is_chair", (F.coalesce(F.length("body"), F.lit(0)) > 0).alias("_has"))
    # the next release at or after a remark is its only candidate: the first of them from the other end of time
    back = spans.withColumn("ts_us", -F.col("ts_us"))
    got = carried_asof(back, said.withColumn("when_us", -F.col("when_us")), ("release_id", "lo"), "r_", 365 * DAY).withColumn("when_us", -F.col("when_us"))
    rows = got.filter((F.col("when_us") > F.col("r_lo")) & (F.col("when_us") < -F.col("r_ts_us")) & (~F.col("is_chair") | F.col("_has")))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("r_release_id", "is_chair").orderBy(F.col("when_us").desc(), "remark_id")))
    rows = rows.filter(F.col("rank") <= F.when(F.col("is_chair"), n_chair).otherwise(n_other))
    rows = rows.select(F.col("r_release_id").cast("string").alias("release_id"), "remark_id", "is_chair", "rank")
    bodies = remarks.select(F.col("id").alias("remark_id"), F.substring("body", 1, chars).alias("body"))
    return rows.join(bodies, "remark_id").select("release_id", "remark_id", "is_chair", "rank", F.when(F.col("is_chair"), F.col("body")).alias("body"))


def context(releases: DataFrame, items: DataFrame, order: tuple[str, ...], budget: int = 6000, on_violation: str = "fail") -> DataFrame:
    """releases (id, ts_us) with has_<kind> flags and the items' texts in a fixed order of kinds, within a character budget.

    items: release_id, kind, label, ts_us, concurrent, text. An item must be strictly before its release
    (a concurrent one at most at it). A later one fails the job, or goes to `violations` with
    on_violation='quarantine'.
    """
    rows = items.join(releases.select(F.col("id").alias("release_id"), F.col("ts_us").alias("_at")), "release_id")
    fine = F.when(F.col("concurrent"), F.col("ts_us") <= F.col("_at")).otherwise(F.col("ts_us") < F.col("_at"))
    if on_violation == "fail":
        rows = rows.filter(F.assert_true(fine, F.concat(F.lit("not yet known at its release: "), F.col("label"))).isNull())
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    got = rows.groupBy("release_id").agg(*[F.coalesce(F.bool_or(fine & (F.col("kind") == k)), F.lit(False)).alias("has_" + k) for k in order], F.count_if(~fine).alias("violations"))
    # of a release's items only those that begin within the budget are brought together
    line = F.concat(F.col("label"), F.lit(": "), F.col("text"))
    lines = rows.filter(fine).select("release_id", rank.alias("r"), "ts_us", "label", F.substring(line, 1, budget).alias("line"), F.length(line).alias("_n"))
    before = Window.partitionBy("release_id").orderBy("r", "ts_us", "label", "line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_from", F.coalesce(F.sum(F.coalesce(F.col("_n") + 1, F.lit(0))).over(before), F.lit(0))).filter(F.col("_from") < budget)
    texts = lines.groupBy("release_id").agg(F.sort_array(F.collect_list(F.struct("r", "ts_us", "label", "line"))).alias("_k"))
    text = F.substring(F.array_join(F.transform("_k", lambda x: x["line"]), "\n"), 1, budget)
    out = got.join(texts, "release_id", "left").select(F.col("release_id").alias("id"), "violations", *["has_" + k for k in order], F.coalesce(text, F.lit("")).alias("context"))
    return releases.join(out, "id", "left")


def disagreements(signals: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (doc, a, b): documents whose sorted (symbol, sign) lists differ between two arms; a missing list is empty."""
    lists = lambda arm: signals.filter(F.col("arm") == arm).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("symbol", "sign"))).alias(arm))
    both = lists(a).join(lists(b), "doc", "full_outer")
    none = F.array().cast(both.schema[a].dataType)
    both = both.withColumn(a, F.coalesce(a, none)).withColumn(b, F.coalesce(b, none))
    return both.filter(~F.col(a).eqNullSafe(F.col(b)))


def disagreements_with_moves(signals: DataFrame, outcomes: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """disagreements() with `moves`, how far the tape went for each symbol that either arm named, without either's sign, and `top_bps`.

    outcomes: (doc, symbol, sign, move_bps), the move signed by the trade; symbols that nothing priced are
    absent. Largest absolute move first; most: so many rows only.
    """
    odd = disagreements(signals, a, b)
    unsigned = outcomes.groupBy("doc", "symbol").agg(F.max_by(F.col("sign") * F.col("move_bps"), F.struct("sign", "move_bps")).alias("bps"))
    named = odd.select("doc", F.explode(F.array_distinct(F.transform(F.concat(a, b), lambda x: x["symbol"]))).alias("symbol"))
    moved = named.join(unsigned, ["doc", "symbol"]).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("symbol", "bps"))).alias("moves"), F.max(F.abs("bps")).alias("top_bps"))
    out = odd.join(moved, "doc", "left").orderBy(F.desc_nulls_last("top_bps"), "doc")
    return out if most is None else out.limit(most)


def unpriced(signals: DataFrame, outcomes: DataFrame, keys: list[str], week: Column) -> DataFrame:
    """Per symbol: signals without an outcome, and how many of them fell on a weekday or a weekend."""
    rows = signals.join(outcomes.select(*keys).distinct(), keys, "left_anti")
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(week == "weekday").alias("weekday"), F.count_if(week == "weekend").alias("weekend"))


def surprise(rows: DataFrame) -> DataFrame:
    """rows (rate, prev_rate, bill6m, fedfunds) with sign and strength of (rate - prev) - (6m - ff) / 4; gaps below 0.01 have sign 0."""
    gap = (F.col("rate") - F.col("prev_rate")) - (F.col("bill6m") - F.col("fedfunds")) / 4
    sign = F.when(F.abs(gap) < 0.01, 0).otherwise(F.signum(gap)).cast("int")
    return rows.withColumn("gap", gap).withColumn("sign", sign).withColumn("strength", F.least(F.lit(1.0), F.abs(gap) / 0.25))


def projection_moves(medians: DataFrame) -> DataFrame:
    """medians (meeting, year, median) with prev_meeting and steps, quarter points against the same year column a meeting earlier.

    Meetings are a few a year; their order is found in one task.
    """
    meetings = medians.select("meeting").distinct().withColumn("prev_meeting", F.lag("meeting").over(Window.orderBy("meeting")))
    rows = medians.join(meetings, "meeting")
    before = medians.select(F.col("meeting").alias("_m"), F.col("year").alias("_y"), F.col("median").alias("prev_median"))
    rows = rows.join(before, (F.col("prev_meeting") == F.col("_m")) & (F.col("year") == F.col("_y"))).drop("_m", "_y")
    return rows.withColumn("steps", F.bround((F.col("median") - F.col("prev_median")) / 0.25).cast("int"))


def turns(transcripts: DataFrame, marker: str = r"(?m)^([A-Z][A-Z .'-]{2,40})[.:]\s+") -> DataFrame:
    """Rows (doc, idx, speaker, text, style): the speaker turns of transcripts (doc, text); style by what a turn is.

    A question has a question mark, a moderator's turn is short (under 120 characters), others are reporters'.
    """
    names = F.regexp_extract_all("text", F.lit(marker), 1)
    parts = F.slice(F.split("text", marker), F.lit(2), F.greatest(F.size(F.split("text", marker)) - 1, F.lit(0)))
    rows = transcripts.select("doc", F.posexplode(F.arrays_zip(names.alias("speaker"), parts.alias("said"))).alias("idx", "t"))
    said = F.btrim(F.col("t.said"), F.lit(" \t\r\n"))
    style = F.when(said.contains("?"), "question").when(F.length(said) < 120, "moderator").otherwise("reporter")
    return rows.select("doc", "idx", F.col("t.speaker").alias("speaker"), said.alias("text"), style.alias("style"))


def remarks_and_questions(turns_: DataFrame, chair: Column) -> DataFrame:
    """Per doc: `remarks` up to the first speaker who isn't the chair, and `qa` from there on."""
    cut = turns_.groupBy("doc").agg(F.min(F.when(~chair, F.col("idx"))).alias("_cut"))
    rows = turns_.join(cut, "doc").withColumn("_qa", F.coalesce(F.col("idx") >= F.col("_cut"), F.lit(False)))
    side = lambda qa: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_qa") == qa, F.struct("idx", "text")))), lambda x: x["text"]), "\n")
    return rows.groupBy("doc").agg(side(False).alias("remarks"), side(True).alias("qa"))
