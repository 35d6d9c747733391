"""Matched controls: random moments drawn by hashing, so draws ignore partitioning and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import clamped, stepped
from tidemark.operators.labels import SIGMAS, excursion
from tidemark.operators.stats import hit_rate, stat, z_score
from tidemark.schema import DAY, HOUR, parts_for, stored


#: Draws of a trial that are made together.
RUN = 65_536


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: 48 bits, the same in any engine with md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def draws(signals: DataFrame, per: int = 2, tries: int = 40, span_us: int = 5 * DAY, exclude_us: int = 3 * HOUR, seed: int = 0, low: int = 0, high: int | None = None) -> DataFrame:
    """per * tries candidate moments for each signal, uniform in +-span but not within +-exclude: its columns, plus try and when_us.

    Each signal has a stream of its own, keyed by seed, id and try; low and high pick tries from it.
    """
    last = per * tries if high is None else high
    rows = signals.withColumn("try", F.explode(F.sequence(F.lit(low), F.lit(last - 1))))
    offset = F.round((2 * uniform(F.lit(seed), F.col("signal_id"), F.col("try")) - 1) * span_us).cast("long")
    rows = rows.withColumn("_off", offset).filter(F.abs("_off") >= exclude_us)
    return rows.withColumn("when_us", F.col("when_us") + F.col("_off")).drop("_off")


def first_measurable(candidates: DataFrame, covered: DataFrame, per: int = 2) -> DataFrame:
    """The first `per` candidates of each signal, by try, that the coverage test has (rows signal_id, try)."""
    fine = candidates.join(covered.select("signal_id", "try").distinct(), ["signal_id", "try"], "left_semi")
    order = Window.partitionBy("signal_id").orderBy("try")
    return fine.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per).drop("_r")


def rounds(total: int, first: int) -> list[tuple[int, int]]:
    """Spans of tries, each three times as long as the one before."""
    out, low, size = [], 0, first
    while low < total:
        out.append((low, min(total, low + size)))
        low, size = low + size, 3 * size
    return out


def with_nulls(signals: DataFrame, measure, per: int = 2, tries: int = 40, span_us: int = 5 * DAY, exclude_us: int = 3 * HOUR, seed: int = 0, every: bool = False, each: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(outcomes of the signals, outcomes of each measured signal's first `per` measurable draws, same symbol and side).

    every: draws of signals that could not be measured themselves, too. each: columns of the outcomes for whose
    values (latency_us) a signal is measured, and its draws picked, anew; its stream of draws is one. Not with every.

    measure(signals, carry) -> outcomes with the columns named in carry, which are the signals' own beyond
    id, symbol, moment and side, and source_id (the signal) and try. The signals and their first draws
    are priced together; only signals that lack measurable draws after that go into a further round,
    with three times as many draws, until the per * tries are used up. Every round's outcomes are stored.
    """
    extra = tuple(c for c in signals.columns if c not in ("signal_id", "symbol", "when_us", "sign"))
    carry = (*extra, "source_id", "try")
    named = lambda rows: rows.withColumn("source_id", F.col("signal_id")).withColumn("signal_id", F.concat_ws(":", F.lit("null"), "source_id", "try"))
    pair, left, priced, outcomes = ["signal_id", *each], signals, None, None
    for low, high in rounds(per * tries, 2 * per):
        asked = named(draws(left, per, tries, span_us, exclude_us, seed, low, high))
        if outcomes is None:
            asked = asked.unionByName(named(signals.withColumn("try", F.lit(-1))))
        got = stored(measure(asked, carry))
        if outcomes is None:
            outcomes = got.filter(F.col("try") < 0).withColumn("signal_id", F.col("source_id")).drop("source_id", "try")
            open_ = (signals if every else outcomes).select(*pair).distinct()
        got = got.filter(F.col("try") >= 0)
        priced = got if priced is None else priced.unionByName(got)
        enough = priced.groupBy(F.col("source_id").alias("signal_id"), *each).agg(F.countDistinct("try").alias("_n")).filter(F.col("_n") >= per)
        open_ = stored(open_.join(enough, pair, "left_anti"))
        if not open_.take(1):
            break
        left = signals.join(open_.select("signal_id").distinct(), "signal_id", "left_semi")
    if not every:
        priced = priced.join(outcomes.select(F.col("signal_id").alias("source_id"), *each).distinct(), ["source_id", *each], "left_semi")
    # a signal's rows meet once, in parts whose number follows theirs
    order = Window.partitionBy("source_id", *each).orderBy("try")
    parts = parts_for(signals.sparkSession, priced.count())
    rows = priced.repartition(parts, "source_id") if parts else priced
    return outcomes, rows.withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= per).drop("_r")


def unconditioned(signals: DataFrame, span_us: int = 5 * DAY, exclude_us: int = 3 * HOUR, seed: int = 0, tries: int = 40) -> DataFrame:
    """One draw for each signal, redrawn only inside the excluded zone, without a coverage test."""
    cand = draws(signals, 1, tries, span_us, exclude_us, seed)
    first = Window.partitionBy("signal_id").orderBy("try")
    return cand.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "try")


def trial_times(spans: DataFrame, trials: int, n: int | Column, seed: int = 0, low: int | Column = 0, only: DataFrame | None = None) -> DataFrame:
    """Rows (symbol, trial, draw, when_us): the uniform moments low .. n - 1 of each symbol and trial within the symbol's span (symbol, lo, hi).

    n, low: numbers, or columns of spans. only: rows (symbol, trial), trials to draw for. A trial's draws are
    made in runs of at most 65,536, dealt out before they are made.
    """
    long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    rows = spans.withColumn("_end", long(n)).withColumn("_low", long(low)).filter("_end > _low AND lo IS NOT NULL").withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))))
    if only is not None:
        rows = rows.join(only.select("symbol", "trial").distinct(), ["symbol", "trial"], "left_semi")
    rows = rows.withColumn("_run", F.explode(F.sequence("_low", F.col("_end") - 1, F.lit(RUN).cast("long"))))
    # in as many parts as a shuffle has: rows this small would else be brought together, and all draws made by one task
    rows = rows.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "trial", "_run")
    rows = rows.withColumn("draw", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + RUN, F.col("_end")) - 1)))
    u = uniform(F.lit(seed), F.col("trial"), F.col("draw"))
    return rows.select("symbol", "trial", "draw", (F.col("lo") + F.floor(u * (F.col("hi") - F.col("lo")))).cast("long").alias("when_us"))


def trial_spread(values: DataFrame, value: Column) -> DataFrame:
    """One row (null_rate, null_sd): mean and population deviation of the trials' means, all symbols' draws of a trial together."""
    return values.groupBy("trial").agg(F.avg(value).alias("m")).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("null_rate"), F.coalesce(F.stddev_pop("m"), F.lit(0.0)).alias("null_sd"))


def matched_excursions(bars: DataFrame, span: DataFrame, low: float, high: float, n: int, trials: int = 500, oversample: int = 8, horizon: int = 1, pre_horizon: int = 3, seed: int = 0) -> DataFrame:
    """One row (null_rate, null_sd) of the move after n moments whose move before lies in [low, high); incomplete trials are dropped."""
    times = clamped(bars, trial_times(span, trials, n * oversample, seed), (*SIGMAS,))
    rows = excursion(times, horizon, pre_horizon).filter((F.col("before") >= low) & (F.col("before") < high) & F.col("after").isNotNull())
    order = Window.partitionBy("trial").orderBy("draw")
    rows = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
    full = rows.groupBy("trial").agg(F.count(F.lit(1)).alias("k"), F.avg("after").alias("m")).filter(F.col("k") == n)
    return full.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("null_rate"), F.coalesce(F.stddev_pop("m"), F.lit(0.0)).alias("null_sd"))


def arm_scores(selected: DataFrame, labelled_draws: DataFrame, hit: str = "clean") -> DataFrame:
    """Per symbol and arm: selected, total, movers, rate, null_rate, null_sd, z, fire_rate.

    selected: rows (symbol, arm, chosen, <hit>), every labelled moment once for each arm that could have
    chosen it. labelled_draws: rows (symbol, trial, draw, <hit>) of random moments, of each trial as
    many at least as the largest arm chose; moments without a label are absent. An arm of n moments is
    compared with the first n draws of every trial: draws are counted between the arms' sizes, and an
    arm's null is a running sum over these counts, so all arms read one table of draws.
    """
    arms = stored(selected.groupBy("symbol", "arm").agg(F.count_if("chosen").alias("selected"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("chosen") & F.col(hit)).alias("movers")))
    # a row for each symbol: the different sizes of its arms, ascending
    sizes = stored(arms.filter("selected > 0").groupBy(F.col("symbol").alias("_s")).agg(F.sort_array(F.collect_set("selected")).alias("_sizes")))
    steps = sizes.select(F.col("_s").alias("_t"), F.posexplode("_sizes").alias("_step", "_end"), "_sizes")
    steps = steps.select("_t", "_step", F.when(F.col("_step") > 0, F.get("_sizes", F.col("_step") - 1)).otherwise(0).alias("_begin"), "_end")
    cut = labelled_draws.join(F.broadcast(steps), (F.col("symbol") == F.col("_t")) & (F.col("draw") >= F.col("_begin")) & (F.col("draw") < F.col("_end")))
    counted = cut.groupBy("symbol", "trial", "_step").agg(F.sum(F.col(hit).cast("long")).alias("_h"), F.count(F.lit(1)).alias("_m"))
    spread = counted.join(sizes, F.col("symbol") == F.col("_s")).withColumn("selected", F.explode(F.slice("_sizes", F.col("_step") + 1, F.size("_sizes"))))
    trials = spread.groupBy("symbol", "trial", "selected").agg((F.sum("_h") / F.sum("_m")).alias("r"))
    null = trials.groupBy("symbol", "selected").agg(F.avg("r").alias("null_rate"), F.stddev_pop("r").alias("null_sd"))
    out = arms.join(null, ["symbol", "selected"], "left").fillna(0.0, ["null_rate", "null_sd"])
    rate = F.when(F.col("selected") > 0, F.col("movers") / F.col("selected")).otherwise(0.0)
    z = F.when(F.col("null_sd") > 0, (F.col("rate") - F.col("null_rate")) / F.col("null_sd")).otherwise(0.0)
    return out.withColumn("rate", rate).withColumn("z", z).withColumn("fire_rate", F.col("selected") / F.col("total")).select("symbol", "arm", "selected", "total", "movers", "rate", "null_rate", "null_sd", "z", "fire_rate")


def conditional_test(bars: DataFrame, moments: DataFrame, quiet_below: float = 0.7, least: int = 5, trials: int = 500, oversample: int = 40, horizon: int = 1, pre_horizon: int = 3, seed: int = 0) -> DataFrame:
    """Per symbol and condition ('quiet before', 'already moving'): n, after, null, null_sd and z against moments that moved as much before.

    bars: with sigma_bars()' columns. Both conditions read one table of at most oversample * n draws a trial, n the
    larger group; of each trial the first n that meet the condition count, and trials with fewer are dropped.
    The first round draws a quarter more moments than there are in both groups; only trials that still lack
    some go into a further round. Moves are found once a bar.
    """
    named = F.when(F.col("before") < quiet_below, "quiet before").otherwise("already moving").alias("condition")
    fine = lambda rows: rows.filter("before >= 0 AND before < 99 AND after IS NOT NULL")
    own = fine(excursion(clamped(bars, moments, SIGMAS), horizon, pre_horizon))
    groups = stored(own.groupBy("symbol", named).agg(F.count(F.lit(1)).alias("n"), F.avg("after").alias("after")).filter(F.col("n") >= least))
    wanted = groups.groupBy("symbol").agg(F.max("n").alias("_most"), F.sum("n").alias("_all"))
    spans = stored(moments.groupBy("symbol").agg(F.min("when_us").alias("lo"), F.max("when_us").alias("hi")).join(wanted, "symbol"))
    known = stored(excursion(bars.select("symbol", "seq", "ts_us", *[F.col(c).alias("q_" + c) for c in SIGMAS]), horizon, pre_horizon).select("symbol", "seq", "ts_us", "before", "after"))
    drawn, open_, low, size = None, None, F.lit(0), F.ceil(F.col("_all") * 1.25) + 16
    for _ in range(max(1, oversample).bit_length() + 1):  # each round ends at twice as many draws, the last at all
        end = F.least(size, F.col("_most") * oversample)
        times = stepped(known, trial_times(spans, trials, end, seed, low, open_), ("before", "after"), "")
        got = stored(fine(times).select("symbol", "trial", "draw", named, F.col("after").alias("_a")).join(groups.select("symbol", "condition", "n"), ["symbol", "condition"]))
        drawn = got if drawn is None else drawn.unionByName(got)
        every = spans.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))).alias("trial")).join(groups.select("symbol", "condition", "n"), "symbol")
        met = every.join(drawn.groupBy("symbol", "condition", "trial").agg(F.count(F.lit(1)).alias("_k")), ["symbol", "condition", "trial"], "left")
        left = met.filter(F.coalesce("_k", F.lit(0)) < F.col("n")).join(spans.filter(end < F.col("_most") * oversample).select("symbol"), "symbol", "left_semi")
        open_, low, size = stored(left.select("symbol", "trial").distinct()), end, size * 2
        if not open_.take(1):
            break
    order = Window.partitionBy("symbol", "condition", "trial").orderBy("draw")
    means = drawn.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("n")).groupBy("symbol", "condition", "trial", "n").agg(F.count(F.lit(1)).alias("_k"), F.avg("_a").alias("_m")).filter(F.col("_k") == F.col("n"))
    null = means.groupBy("symbol", "condition").agg(F.avg("_m").alias("null"), F.stddev_pop("_m").alias("null_sd"))
    out = groups.join(null, ["symbol", "condition"], "left").fillna(0.0, ["null", "null_sd"])
    return out.withColumn("z", F.when(F.col("null_sd") > 0, (F.col("after") - F.col("null")) / F.col("null_sd")).otherwise(0.0))


def with_null_figures(real: DataFrame, nulls: DataFrame, by: list[str], shared: list[str] | None = None, value: str = "fwd_bps") -> DataFrame:
    """Per group: n, mean, se and hit rate of the outcomes, the controls' n, mean and se, and z.

    Controls are those of the same group, or, with `shared`, of all groups with the same values of these columns.
    """
    on = by if shared is None else shared
    got = real.groupBy(*by).agg(*stat(F.col(value), "fwd"), hit_rate(F.col(value)).alias("hit"))
    own = nulls.groupBy(*on).agg(*stat(F.col(value), "null"))
    got = got.join(own, on, "left").fillna(0, ["null_n", "null_mean", "null_se"])
    return got.withColumn("z", z_score(F.col("fwd_mean"), F.col("fwd_se"), F.col("null_mean"), F.col("null_se")))
