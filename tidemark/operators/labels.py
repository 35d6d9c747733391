"""Moves around moments in units of the tape's own volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import clamped, stepped

H = 3
#: What sigma_bars adds to a bar: neighbours' closes within H bars, and sigma.
SIGMAS = ("close", "sigma", *[f"b{h}" for h in range(1, H + 1)], *[f"a{h}" for h in range(1, H + 1)])


def sigma_bars(bars: DataFrame) -> DataFrame:
    """bars (symbol, ts_us, seq, close) with sigma, the population deviation of log returns, and the closes up to H bars before and after."""
    w = Window.partitionBy("symbol", "block").orderBy("seq")
    own = F.floor(F.col("seq") / 4096)
    place = F.col("seq") % 4096
    near = F.array_compact(F.array(own, F.when(place < H, own - 1), F.when(place >= 4096 - H, own + 1)))
    rows = bars.withColumn("block", F.explode(near)).withColumn("_own", own)
    for h in range(1, H + 1):
        rows = rows.withColumn(f"b{h}", F.lag("close", h).over(w)).withColumn(f"a{h}", F.lead("close", h).over(w))
    rows = rows.filter(F.col("block") == F.col("_own")).drop("block", "_own")
    r = F.when((F.col("close") > 0) & (F.col("b1") > 0), F.ln(F.col("close") / F.col("b1")))
    per = rows.groupBy("symbol").agg(F.coalesce(F.stddev_pop(r), F.lit(0.0)).alias("sigma"))
    return rows.join(per, "symbol")


def in_sigmas(a: Column, b: Column, steps: int, sigma: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(b / a) / (sigma * (float(steps) ** 0.5))).otherwise(0.0)


def excursion(rows: DataFrame, horizon: int = 1, pre_horizon: int = 3, p: str = "q_") -> DataFrame:
    """rows with `before` and `after`: absolute moves over exactly so many bars, in sigmas; null at the edges."""
    c, s = F.col(p + "close"), F.col(p + "sigma")
    whole = lambda h: F.col(f"{p}b{h}").isNotNull() & F.col(f"{p}a{h}").isNotNull() & (c > 0) & (s > 0)
    before = F.when(whole(pre_horizon) & (F.col(f"{p}b{pre_horizon}") > 0), F.abs(F.ln(c / F.col(f"{p}b{pre_horizon}"))) / (s * pre_horizon**0.5))
    after = F.when(whole(horizon) & (F.col(f"{p}a{horizon}") > 0), F.abs(F.ln(F.col(f"{p}a{horizon}") / c)) / (s * horizon**0.5))
    return rows.withColumn("before", before).withColumn("after", after)


def own_labels(rows: DataFrame, horizon: int = H) -> DataFrame:
    """sigma_bars() with pre, post and post_signed in sigmas and the price, for a moment in each bar; all null too near an edge."""
    c, s = F.col("close"), F.col("sigma")
    fine = (c > 0) & (s > 0) & F.col(f"b{horizon}").isNotNull() & F.col(f"a{horizon}").isNotNull()
    post = F.greatest(*[F.abs(in_sigmas(c, F.col(f"a{h}"), h, s)) for h in range(1, horizon + 1)], F.lit(0.0))
    pre, signed = F.abs(in_sigmas(F.col(f"b{horizon}"), c, horizon, s)), in_sigmas(c, F.col(f"a{horizon}"), horizon, s)
    return rows.select("symbol", "ts_us", "seq", *[F.when(fine, x).alias(n) for n, x in (("pre", pre), ("post", post), ("post_signed", signed), ("price", c))])


def labelled(bars: DataFrame, moments: DataFrame, threshold: float = 2.0, horizon: int = H, many: bool = False) -> DataFrame:
    """moments (symbol, when_us, ...) with pre, post, post_signed in sigmas and moved, reactive, clean; moments too near an edge have no row.

    post is the largest move at any step up to the horizon, each scaled by its own root of time. many: the
    moments far outnumber the bars, which are looked up without sorting them.
    """
    names = ("pre", "post", "post_signed", "price")
    rows = (stepped if many else clamped)(own_labels(sigma_bars(bars), horizon), moments, names).filter("q_price IS NOT NULL")
    out = rows.select(*moments.columns, *[F.col("q_" + n).alias(n) for n in names])
    moved, reactive = F.col("post") >= threshold, F.col("pre") >= threshold
    return out.withColumn("moved", moved).withColumn("reactive", reactive).withColumn("clean", moved & ~reactive)


def quiet_or_moving(bars: DataFrame, moments: DataFrame, quiet_below: float = 0.7, least: int = 5) -> DataFrame:
    """Per condition ('quiet before', 'already moving'): n and mean move after; groups below `least` are dropped."""
    rows = excursion(clamped(sigma_bars(bars), moments, SIGMAS)).filter(F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before") < 99.0))
    condition = F.when(F.col("before") < quiet_below, "quiet before").otherwise("already moving")
    return rows.groupBy(condition.alias("condition")).agg(F.count(F.lit(1)).alias("n"), F.avg("after").alias("after")).filter(F.col("n") >= least)
