"""Arms: rules that turn documents and scores into signals (id, ts_us, symbol, sign, strength, arm)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import lexicons as V
from tidemark.functions import text as T
from tidemark.operators.asof import BACKWARD, bounded_asof
from tidemark.functions.prices import full_log_bps, log_bps, mid
from tidemark.operators.documents import match_calendar, projection_moves
from tidemark.plans.pricing import probes
from tidemark.schema import MINUTE

# Currency -> (symbol, 1 if the currency is the pair's base, else -1).
PAIRS = {"USD": ("EURUSD", -1), "EUR": ("EURUSD", 1), "GBP": ("GBPUSD", 1), "JPY": ("USDJPY", -1)}
WIRE_PAIRS = {"USD": ("EURUSD", -1), "EUR": ("EURUSD", 1), "JPY": ("USDJPY", -1), "GBP": ("GBPUSD", 1), "AUD": ("AUDUSD", 1), "CAD": ("USDCAD", -1), "CHF": ("USDCHF", -1), "NZD": ("NZDUSD", 1)}
USD_SIDE = {"EURUSD": -1, "GBPUSD": -1, "USDJPY": 1}
RATE_TITLE = r"(?i)fomc statement|federal funds rate|monetary policy statement|policy rate|official bank rate|bank rate|monetary policy summary|guideline for money market operations|interest rate decision"
DIRECTION = {"hawkish": 1, "dovish": -1, "stronger": 1, "weaker": -1}


def lookup(key: Column, table: dict) -> Column:
    """A small fixed table as a map expression."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def signed_pair(currency: Column, direction: Column, pairs: dict = PAIRS) -> Column:
    """Struct (symbol, sign) for a currency and a stance or direction; null where there is nothing to trade."""
    symbol = lookup(currency, {k: v[0] for k, v in pairs.items()})
    sign = lookup(currency, {k: v[1] for k, v in pairs.items()}) * lookup(direction, DIRECTION)
    return F.when(symbol.isNotNull() & sign.isNotNull(), F.struct(symbol.alias("symbol"), sign.alias("sign")))


def dollar_side(symbol: Column, usd_sign: Column) -> Column:
    return F.coalesce(lookup(symbol, USD_SIDE), F.lit(-1)) * usd_sign


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def strength(p_stance: Column, confirm: Column, magnitude: Column, relevant: Column, surprise: Column, priced_in: Column) -> Column:
    """A stance's strength: what was priced in halves it at most."""
    return unit(p_stance * confirm * magnitude * relevant * (0.7 + 0.3 * surprise) * (1 - 0.5 * priced_in))


def context_strength(p_relative: Column, confirm: Column, surprise: Column, priced_in: Column) -> Column:
    """Strength against expectations: what was priced in is not traded."""
    return unit(p_relative * confirm * surprise * (1 - priced_in))


def wire_strength(p_direction: Column, confirm: Column, magnitude: Column, new: Column, already_moved: Column) -> Column:
    return unit(p_direction * confirm * magnitude * new * (1 - already_moved))


def listing_strength(subject: Column, confirm: Column, magnitude: Column, p_side: Column, conditional: Column, priced_in: Column) -> Column:
    return unit(subject * confirm * magnitude * p_side * (1 - 0.7 * conditional) * (1 - 0.5 * priced_in))


def projection_strength(steps: Column) -> Column:
    """A quarter point is a quarter of full size, four are full."""
    return F.least(F.lit(1.0), F.abs(steps) / 4)


def _signals(docs: DataFrame, pair: Column, arm: str, size: Column | float = 1.0) -> DataFrame:
    size = size if isinstance(size, Column) else F.lit(size)
    return docs.withColumn("_p", pair).filter(F.col("_p").isNotNull()).select("id", "ts_us", F.col("_p.symbol").alias("symbol"), F.col("_p.sign").alias("sign"), size.alias("strength"), F.lit(arm).alias("arm"))


def keyword_arm(docs: DataFrame) -> DataFrame:
    """One signal on the issuer's pair from the lexicon's lean of title and body; ties give none."""
    lean = T.word_lean(T.text_of(F.col("title"), F.col("body")))
    return _signals(docs, signed_pair(F.col("currency"), lean["stance"]), "keyword")


def all_text_arm(docs: DataFrame) -> DataFrame:
    """One signal for every document of a traded currency: the lean's side, the long one on a tie."""
    stance = T.word_lean(T.text_of(F.col("title"), F.col("body")))["stance"]
    return _signals(docs, signed_pair(F.col("currency"), F.when(stance == "neutral", "hawkish").otherwise(stance)), "all text")


def wire_arm(docs: DataFrame) -> DataFrame:
    """Keyword rules on a wire: the currency and direction of each headline that is about one. All lexicons read a text in one pass."""
    rules = {k: V.RULES[k] for k in V.RULES if k in ("up", "down", "not_fx") or k.startswith("currency_")}
    rows = docs.withColumn("_c", V.lexicon_counts(T.text_of(F.col("title"), F.col("body")), rules))
    c = F.col("_c")
    currency = V.first_named(c, [(f"currency_{i}", name) for i, (name, _) in enumerate(T.CURRENCIES)], "none")
    direction = F.when(c["up"] > c["down"], "stronger").when(c["up"] < c["down"], "weaker").otherwise("none")
    pair = F.when(c["not_fx"] == 0, signed_pair(currency, direction, WIRE_PAIRS))
    # exploded, not filtered: a filter on counts would be moved below them and count every text once more
    rows = rows.withColumn("_p", F.explode(F.array_compact(F.array(pair))))
    return _signals(rows, F.col("_p"), "wire keyword")


def surprise_arm(docs: DataFrame, calendar: DataFrame, rate_title: str = RATE_TITLE) -> DataFrame:
    """The announced rate against the calendar's forecast; no signal where they agree or either is missing."""
    rows = match_calendar(docs.filter(F.regexp_like(F.coalesce("title", F.lit("")), F.lit(rate_title))), calendar)
    pct = F.col("cal_forecast").contains("%") & ~F.regexp_like("cal_forecast", F.lit(r"\d+-\d+-\d+"))
    forecast = F.when(pct, T.rate_value(F.regexp_replace("cal_forecast", "[<>%]", "")))
    gap = T.announced_rate(F.col("title"), F.col("body")) - forecast
    stance = F.when(gap > 1e-9, "hawkish").when(gap < -1e-9, "dovish")
    return _signals(rows, signed_pair(F.col("currency"), stance), "surprise")


def title_arm(docs: DataFrame, with_body: bool = False) -> DataFrame:
    """Listing notices: a signal for every ticker of the title (and the body), on the title's side."""
    names = T.tickers(F.col("title"), F.col("body") if with_body else None)
    rows = docs.withColumn("_s", T.title_side(F.col("title"))).filter(F.col("_s") != 0).withColumn("_t", F.explode(names))
    return rows.select("id", "ts_us", F.col("_t").alias("symbol"), F.col("_s").alias("sign"), F.lit(1.0).alias("strength"), F.lit("body" if with_body else "title").alias("arm"))


def mentions_arm(docs: DataFrame, least: int = 1) -> DataFrame:
    """Listing notices: a signal, always long, for every ticker that title and body name; no side is read from the words.

    A control for the arms that read a side: what any mention is followed by. least: documents that must name a ticker.
    """
    rows = docs.withColumn("_t", F.explode(T.tickers(F.col("title"), F.col("body"))))
    got = rows.select("id", "ts_us", F.col("_t").alias("symbol"), F.lit(1).alias("sign"), F.lit(1.0).alias("strength"), F.lit("mentions").alias("arm"))
    if least <= 1:
        return got
    often = got.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return got.join(often.select("symbol"), "symbol", "left_semi")


def reader_arm(readings: DataFrame, size: Column, least_strength: float = 0.0, least_confidence: float = 0.5, pairs: dict = PAIRS, arm: str = "reader") -> DataFrame:
    """Scored documents as signals: readings (id, ts_us, currency, direction, confidence, ...) whose strength `size` and confidence pass the gate.

    The side is the pair's for currency and direction; readings without one, without strength, or below a
    threshold abstain. Several readings of a document are several signals.
    """
    rows = readings.withColumn("_p", signed_pair(F.col("currency"), F.col("direction"), pairs)).withColumn("strength", size)
    fine = F.col("_p").isNotNull() & (F.col("strength") > 0) & (F.col("strength") >= least_strength) & (F.col("confidence") >= least_confidence)
    return rows.filter(fine).select("id", "ts_us", F.col("_p.symbol").alias("symbol"), F.col("_p.sign").alias("sign"), "strength", F.lit(arm).alias("arm"))


def user_arm(docs: DataFrame, signals: Column, arm: str) -> DataFrame:
    """A rule of one's own: a column of array<struct<symbol, sign, strength>> over docs, null or empty where it abstains.

    Entries without symbol, side or positive strength are no signals.
    """
    rows = docs.withColumn("_x", F.explode(signals)).select("id", "ts_us", F.col("_x.symbol").alias("symbol"), F.signum(F.col("_x.sign")).cast("int").alias("sign"), F.col("_x.strength").cast("double").alias("strength"))
    return rows.filter("symbol IS NOT NULL AND sign <> 0 AND strength > 0").withColumn("arm", F.lit(arm))


#: Which of a projection's year columns, in their order, a variant reads; the first is the meeting's own year.
PROJECTIONS = {0: "current", 1: "next", 2: "two out"}
LONGER_RUN = "longer run"


def projection_arms(medians: DataFrame, releases: DataFrame, symbol: str = "EURUSD") -> DataFrame:
    """The five projection variants as signals: medians (meeting, year, median) and releases (meeting, ts_us).

    year is a text, a calendar year or 'longer run'. Every variant compares the same column of a meeting and
    the one before: the meeting's own year, the next, the one after that, the longer run, or the sum of all
    calendar years that both have, two at least. A rise is hawkish for the dollar; no move, no signal.
    Strength: a quarter of full size for each quarter point.
    """
    calendar = F.col("year") != LONGER_RUN
    place = Window.partitionBy("meeting", calendar).orderBy("year")  # a meeting's few columns
    columns = medians.select(F.col("meeting").alias("_m"), F.col("year").alias("_y"), F.when(calendar, F.row_number().over(place) - 1).alias("_place"))
    rows = projection_moves(medians).join(columns, (F.col("meeting") == F.col("_m")) & (F.col("year") == F.col("_y")))
    variant = F.when(~calendar, LONGER_RUN)
    for at, name in PROJECTIONS.items():
        variant = variant.when(F.col("_place") == at, name)
    one = rows.withColumn("variant", variant).filter("variant IS NOT NULL").select("meeting", "variant", (F.col("median") - F.col("prev_median")).alias("delta"))
    every = rows.filter(calendar).groupBy("meeting").agg((F.sum("median") - F.sum("prev_median")).alias("delta"), F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("meeting", F.lit("sum").alias("variant"), "delta")
    both = one.unionByName(every).filter(F.abs("delta") >= 1e-9).join(releases, "meeting")
    steps = F.bround(F.round(F.col("delta") / 0.25, 9))
    return both.select(F.col("meeting").alias("id"), "ts_us", F.lit(symbol).alias("symbol"), dollar_side(F.lit(symbol), F.signum("delta").cast("int")).alias("sign"), projection_strength(steps).alias("strength"), F.concat(F.lit("projections: "), "variant").alias("arm"))


def sample_arm(docs: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """The wire arm on a fixed-size sample of documents, the same on every run; it abstains where the rules do."""
    picked = docs.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary")), "id").limit(size)
    return wire_arm(picked).withColumn("id", F.concat(F.lit("sample:"), F.col("id").cast("string"))).withColumn("arm", F.lit("sample"))


def carried(signals: DataFrame, starts: DataFrame) -> DataFrame:
    """signals entered at a later start (id, start_us) instead of their own moment."""
    return signals.join(starts, "id").withColumn("ts_us", F.col("start_us")).drop("start_us")


def reversals(readings: DataFrame, tape: DataFrame, after_us: int = 60 * MINUTE, stale_us: int = 300_000_000, zero: bool = False) -> DataFrame:
    """readings (id, symbol, statement_us, start_us, remarks_vs_statement, qa_vs_remarks) that aren't consistent throughout, with the moves before and after the start. zero: as in tick_outcomes()."""
    bps = full_log_bps if zero else log_bps
    odd = readings.filter((F.col("remarks_vs_statement") != "consistent") | (F.col("qa_vs_remarks") != "consistent"))
    looks = {"release": F.col("statement_us"), "start": F.col("start_us"), "later": F.col("start_us") + after_us}
    got = bounded_asof(tape, probes(odd.withColumn("signal_id", F.col("id")), looks), stale_us, BACKWARD, values=("bid", "ask")).withColumn("m", mid(F.col("q_bid"), F.col("q_ask")))
    m = got.groupBy(F.col("signal_id").alias("id")).agg(*[F.max(F.when(F.col("probe") == n, F.col("m"))).alias(n) for n in looks])
    return odd.join(m.select("id", bps(F.col("release"), F.col("start")).alias("statement_bps"), bps(F.col("start"), F.col("later")).alias("presser_bps")), "id", "left").orderBy("start_us")
