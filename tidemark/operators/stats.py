"""Summaries of arms, sweeps, calibration, tests and curves, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stat(x: Column, name: str) -> list[Column]:
    """n, mean and standard error of a column: zeros for none, se 0 for one."""
    n = F.count(x)
    return [n.alias(f"{name}_n"), F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(x) / F.sqrt(n), F.lit(0.0)).alias(f"{name}_se")]


def hit_rate(x: Column) -> Column:
    """Share of positive ones among values other than zero; 0 if there are none."""
    return F.coalesce(F.avg(F.when(x != 0, (x > 0).cast("double"))), F.lit(0.0))


def z_score(m: Column, se: Column, m0: Column, se0: Column) -> Column:
    s = F.sqrt(se * se + se0 * se0)
    return F.when(s > 0, (m - m0) / s).otherwise(0.0)


def arm_summary(signals: DataFrame, outcomes: DataFrame, nulls: DataFrame | None = None, keys: tuple[str, ...] = ("arm",)) -> DataFrame:
    """Per key and horizon: signals, measured, share, pre (signed), spread, rush, forward net and mid, hit rate, null and z.

    signals: keys and signal_id; outcomes and nulls: keys, signal_id, sign, horizon and the prices of
    tidemark.plans.pricing. Every figure comes from one grouping of the long outcome table.
    """
    got = outcomes.groupBy(*keys, "horizon").agg(
        *stat(F.col("pre_bps") * F.col("sign"), "pre"), *stat(F.col("spread_bps"), "spread"), *stat(F.col("rush_bps"), "rush"),
        *stat(F.col("fwd_bps"), "fwd"), *stat(F.col("fwd_mid_bps"), "mid"), hit_rate(F.col("fwd_bps")).alias("hit"),
    )
    got = got.join(signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("signals")), list(keys)).withColumn("share", F.col("fwd_n") / F.col("signals"))
    if nulls is None:
        return got
    got = got.join(nulls.groupBy(*keys, "horizon").agg(*stat(F.col("fwd_bps"), "null")), [*keys, "horizon"], "left")
    # not fillna(), which takes a figure that is not a number for a missing one
    got = got.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("null_n", "null_mean", "null_se")})
    return got.withColumn("z", z_score(F.col("fwd_mean"), F.col("fwd_se"), F.col("null_mean"), F.col("null_se")))


def breakdown(outcomes: DataFrame, keys: dict[str, Column], value: str = "fwd_bps", least: int = 1) -> DataFrame:
    """Per key name and key ('none' if blank): n, mean, se and hit rate; groups below `least` are left out, largest first."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("by"), F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("none")).alias("key")) for n, c in keys.items()]))
    got = outcomes.select(F.col(value), pairs.alias("k")).groupBy("k.by", "k.key").agg(*stat(F.col(value), "fwd"), hit_rate(F.col(value)).alias("hit"))
    return got.filter(F.col("fwd_n") >= least).orderBy(F.col("fwd_n").desc(), "by", "key")


def in_and_out(rows: DataFrame, inside: Column) -> DataFrame:
    """Every row twice, for its split ('in' or 'out') and for 'pooled'."""
    return rows.withColumn("split", F.explode(F.array(F.when(inside, "in").otherwise("out"), F.lit("pooled"))))


def calibration(rows: DataFrame, p: Column, happened: Column, bins: int = 5) -> DataFrame:
    """Per bin of equal width (1 belongs to the last; empty ones are absent): low, high, n, predicted, realized."""
    b = F.least(F.floor(p * bins), F.lit(bins - 1))
    got = rows.filter(p.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(happened.cast("double")).alias("realized"))
    return got.select((F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), "n", "predicted", "realized")


def curve_stats(curve: DataFrame, keys: tuple[str, ...] = ("run",), per_year: float = 365.0 * 86400, order: str = "seq", value: str = "equity") -> DataFrame:
    """Per key: max_drawdown (peak to trough), sharpe of the steps (annualised, over two steps) and the last value.

    Curves are cut into blocks: running peaks combine a peak within the block and the earlier blocks'.
    """
    block = F.floor(F.col(order) / 65536)
    rows = curve.withColumn("_b", block)
    per = rows.groupBy(*keys, "_b").agg(F.max(value).alias("_top"), F.max_by(value, order).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", F.max("_top").over(before).alias("_peak"), F.last("_last").over(before).alias("_prev"))
    own = Window.partitionBy(*keys, "_b").orderBy(order)
    peak = F.greatest(F.max(value).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_peak"))
    rows = rows.join(per, [*keys, "_b"]).withColumn("_down", peak - F.col(value)).withColumn("_step", F.col(value) - F.coalesce(F.lag(value).over(own), F.col("_prev")))
    sd = F.stddev_pop("_step")
    sharpe = F.when((F.count("_step") > 2) & (sd > 0), F.avg("_step") / sd * (per_year**0.5)).otherwise(0.0)
    return rows.groupBy(*keys).agg(F.max("_down").alias("max_drawdown"), sharpe.alias("sharpe"), F.max_by(value, order).alias("final"))


def direction_scores(decisions: DataFrame, ticks: DataFrame, horizon: int = 5, least_edge: float = 0.05, zero: bool = False) -> DataFrame:
    """decisions (symbol, seq, arrival, p_up, p_down, edge) with formed and executed hits (null: not scored) and p and up for calibration.

    formed: the mid `horizon` ticks after the decision against the decision's; executed: from its arrival. Zero moves are skipped,
    and, unless zero is given, decisions at a mid that is not positive.
    """
    mids = ticks.select(F.col("symbol").alias("_s"), F.col("seq").alias("_q"), "mid")
    out = decisions
    for name, at in (("m0", F.col("seq")), ("m1", F.col("seq") + horizon), ("a0", F.col("arrival")), ("a1", F.col("arrival") + horizon)):
        out = out.withColumn("_at", at).join(mids.withColumnRenamed("mid", name), (F.col("symbol") == F.col("_s")) & (F.col("_at") == F.col("_q")), "left").drop("_s", "_q", "_at")
    change, realised, strong = F.col("m1") - F.col("m0"), F.col("a1") - F.col("a0"), F.abs("edge") >= least_edge
    scored = (F.lit(zero) | (F.col("m0") > 0)) & (change != 0)
    both = F.col("p_up") + F.col("p_down")
    return out.withColumn("formed", F.when(scored & strong, (F.col("edge") > 0) == (change > 0))).withColumn("executed", F.when(scored & strong & (realised != 0), (F.col("edge") > 0) == (realised > 0))).withColumn("p", F.when(scored & (both > 1e-9), F.col("p_up") / both)).withColumn("up", change > 0)


def markouts(fills: DataFrame, ticks: DataFrame, horizons=(4, 20, 80)) -> DataFrame:
    """Per class ('all', 'informed', 'benign') and horizon: fills, notional, capture and adverse drift.

    fills: symbol, seq, side (+1/-1), price, size, informed; capture is (mid - price) * signed size, adverse
    the mid's drift from the fill to seq + horizon (at most the last tick) times signed size.
    """
    mids = ticks.select(F.col("symbol").alias("_s"), F.col("seq").alias("_q"), F.col("mid").alias("_m"))
    ends = ticks.groupBy(F.col("symbol").alias("_e")).agg(F.max("seq").alias("_last"))
    rows = fills.join(ends, F.col("symbol") == F.col("_e")).drop("_e")
    rows = rows.join(mids.withColumnRenamed("_m", "mid0"), (F.col("symbol") == F.col("_s")) & (F.col("seq") == F.col("_q"))).drop("_s", "_q")
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("_at", F.least(F.col("seq") + F.col("horizon"), F.col("_last")))
    rows = rows.join(mids.withColumnRenamed("_m", "mid1"), (F.col("symbol") == F.col("_s")) & (F.col("_at") == F.col("_q"))).drop("_s", "_q", "_at")
    rows = rows.withColumn("class", F.explode(F.array(F.lit("all"), F.when(F.col("informed"), "informed").otherwise("benign"))))
    signed = F.col("side") * F.col("size")
    return rows.groupBy("class", "horizon").agg(F.count(F.lit(1)).alias("fills"), F.sum(F.col("price") * F.col("size")).alias("notional"), F.sum((F.col("mid0") - F.col("price")) * signed).alias("capture"), F.sum((F.col("mid1") - F.col("mid0")) * signed).alias("adverse"))


def weighted_median(level: Column, n: Column) -> Column:
    """Median of levels with counts: the mean of the two middle ones if the number is even; null without any."""
    return F.percentile(level, F.lit(0.5), F.greatest(n.cast("long"), F.lit(0).cast("long")))


def round_tenth(x: Column) -> Column:
    """To a tenth, half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * 10.0 + 0.5) / 10.0


def agreement(rows: DataFrame, printed: str, computed: str, keys: list[str], most: int = 20) -> DataFrame:
    """One row: n compared, agree, share, and `mismatches`, the first `most` by keys, of printed figures against computed ones rounded to a tenth, half away from zero.

    A printed figure without a computed one is a mismatch that isn't compared; rows without a printed one don't count.
    """
    rounded_ = round_tenth(F.col(computed))
    both = rows.filter(F.col(printed).isNotNull()).select(*keys, F.col(printed).alias("printed"), F.col(computed).alias("computed"), F.coalesce(F.abs(rounded_ - F.col(printed)) < 1e-9, F.lit(False)).alias("_same"))
    figures = both.agg(F.count("computed").alias("n"), F.count_if("_same").alias("agree"))
    odd = both.filter("NOT _same").orderBy(*keys, "printed", "computed").limit(most).agg(F.sort_array(F.collect_list(F.struct(*keys, "printed", "computed"))).alias("mismatches"))
    # both sides are one row
    return figures.join(odd).withColumn("share", F.coalesce(F.col("agree") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)))


def stirling_rest(x: Column) -> Column:
    """ln x! less (x + 1/2) ln x - x + ln(2 pi)/2, for x >= 1: a series from 16 on, products of whole numbers below."""
    i = 1.0 / x
    series = i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i * (1 / 1680 - i * i / 1188))))
    small = F.log(F.factorial(F.least(x, F.lit(16.0)).cast("int")).cast("double")) - (x + 0.5) * F.log(x) + x - 0.9189385332046727
    return F.when(x < 16, small).otherwise(series)


def fair_binomial(k: Column, n: Column) -> Column:
    """C(n, k) / 2^n for 0 <= k <= n, in a form that keeps its digits for any n."""
    j, u = n - k, (n - 2 * k) / n
    far = n / 2 * ((1 - u) * F.log1p(-u) + (1 + u) * F.log1p(u))
    inner = F.exp(stirling_rest(n) - stirling_rest(k) - stirling_rest(j) - far) * F.sqrt(n / (6.283185307179586 * k * j))
    return F.when((k <= 0) | (j <= 0), F.exp(-n * 0.6931471805599453)).otherwise(inner)


def beta_fraction(a: Column, b: Column, x: float, rounds: int) -> Column:
    """The continued fraction of the regularised incomplete beta function at x, `rounds` steps of it (modified Lentz)."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    start = F.struct(F.lit(1.0).alias("c"), (1.0 / safe(1.0 - (a + b) * x / (a + 1.0))).alias("d"), (1.0 / safe(1.0 - (a + b) * x / (a + 1.0))).alias("h"))

    def move(s: Column, term: Column) -> Column:
        d = 1.0 / safe(1.0 + term * s["d"])
        c = safe(1.0 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def terms(m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return F.array(even, odd)

    every = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda m: terms(m.cast("double"))))
    return F.aggregate(every, start, move, lambda s: s["h"])


def sign_test(wins: Column, n: Column, rounds: int = 1024) -> Column:
    """Exact two-sided sign test: min(1, 2 * sum of C(n, i) / 2^n up to the smaller side); 1 for n <= 0.

    The sum is the regularised incomplete beta function I(1/2; n - k, k + 1), by its continued fraction: a
    fixed number of steps, enough for n up to ten million at any k, and no list of n numbers.
    """
    k = F.least(wins, n - wins).cast("double")
    n = n.cast("double")
    twice = fair_binomial(k, n) * beta_fraction(n - k, k + 1.0, 0.5, rounds)
    return F.when((n <= 0) | (2 * k + 1 >= n), 1.0).otherwise(F.least(F.lit(1.0), twice))


def paired_difference(rows: DataFrame, a: str, b: str, key: str = "seed", arm: str = "arm", value: str = "net") -> DataFrame:
    """One row: n, mean of a - b over the runs both have, population standard error, and whether it is outside the noise."""
    wide = rows.groupBy(key).agg(F.max(F.when(F.col(arm) == a, F.col(value))).alias("x"), F.max(F.when(F.col(arm) == b, F.col(value))).alias("y"))
    d = F.col("x") - F.col("y")
    got = wide.filter(d.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), (F.stddev_pop(d) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return got.withColumn("outside_noise", F.abs("mean") >= 2 * F.col("se"))


def precision_recall(acted: Column, material: Column) -> list[Column]:
    hits = F.count_if(acted & material)
    return [hits.alias("hits"), F.count_if(~acted & material).alias("misses"), F.count_if(acted & ~material).alias("false_alarms"), F.count_if(~acted & ~material).alias("quiet"), F.coalesce(hits / F.nullif(F.count_if(acted), F.lit(0)), F.lit(0.0)).alias("precision"), F.coalesce(hits / F.nullif(F.count_if(material), F.lit(0)), F.lit(0.0)).alias("recall")]


def abstention(traded: Column) -> Column:
    """1 - traded / read."""
    return 1 - F.avg(traded.cast("double"))


def run_ratios(gross: Column, turnover: Column, net: Column, capital: Column, first_mid: Column, last_mid: Column) -> list[Column]:
    """break_even_bps (the fee that eats the gross result), return_on_capital, and what holding would have earned on the same capital; 0 where undefined."""
    share = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    return [(share(gross, turnover) * 1e4).alias("break_even_bps"), share(net, capital).alias("return_on_capital"), (share(last_mid - first_mid, first_mid) * capital).alias("held")]
