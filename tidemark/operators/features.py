"""Rolling tape features per symbol. Long tapes are cut into blocks with a halo, so one symbol spreads over the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prices import log_bps, mid, spread_bps

SIZE, WARMUP, SHORT, MEDIUM, LONG, DECAY = 120, 60, 5, 15, 60, 0.94


def blocked(ticks: DataFrame, size: int = 4096, halo: int = 640) -> DataFrame:
    """ticks with block and halo: the last `halo` rows of a block are also put before the next one."""
    own = F.floor(F.col("seq") / size)
    near = F.when(F.col("seq") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return ticks.withColumn("block", F.explode(near)).withColumn("halo", F.col("block") != own)


def tape_features(ticks: DataFrame, size: int = 4096, halo: int = 640) -> DataFrame:
    """A feature row for each tick from the WARMUP-th of its symbol on.

    ticks: symbol, seq (dense), ts_us, bid, ask, last, volume, bid_size, ask_size. A tick without a
    positive mid counts as a tick, and there is no return into or out of it: windows of returns reach
    over it to earlier returns, and the latest return stands again, in the decayed variance too. The
    variance is a weighted prefix sum within a block: 0.94^640 is far below double precision, so the
    halo makes it exact, as long as a halo holds SIZE returns.
    """
    w = Window.partitionBy("symbol", "block").orderBy("seq")
    back = lambda n: w.rowsBetween(1 - n, 0)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = blocked(ticks, size, halo).withColumn("mid", mid(F.col("bid"), F.col("ask"))).withColumn("spread_bps", spread_bps(F.col("bid"), F.col("ask")))
    rows = rows.withColumn("r", log_bps(F.lag("mid").over(w), F.col("mid")) / 1e4).withColumn("i", F.row_number().over(w) - 1)
    rows = rows.withColumn("priced", F.col("r").isNotNull())
    # rows with a return have windows of their own, whose values are carried to those without; both lie in one shuffle
    own = Window.partitionBy("symbol", "block", "priced").orderBy("seq")
    past = lambda n: own.rowsBetween(1 - n, 0)
    rows = rows.withColumn("nth", F.row_number().over(own)).withColumn("sign", F.signum("r"))
    rows = rows.withColumn("turned", F.when(F.coalesce(F.lag("sign").over(own), F.lit(9.0)) != F.col("sign"), F.col("nth")))
    run = F.least(F.col("nth") - F.last("turned", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)) + 1, F.lit(SIZE))
    of_returns = F.struct(
        F.col("r").alias("r"), F.sum("r").over(past(SHORT)).alias("ret_5"), F.sum("r").over(past(MEDIUM)).alias("ret_15"),
        F.stddev_pop("r").over(past(MEDIUM)).alias("short_vol"), F.stddev_pop("r").over(past(LONG)).alias("long_vol"),
        F.avg((F.col("r") > 0).cast("double")).over(past(10)).alias("up_fraction"), F.sum(F.abs("r")).over(past(MEDIUM)).alias("gross"),
        F.when(F.col("sign") == 0, 0).otherwise(F.col("sign") * run).cast("int").alias("run_length"),
    )
    rows = rows.withColumn("known", F.when(F.col("priced"), of_returns))
    rows = rows.withColumn("known", F.last("known", ignorenulls=True).over(so_far))
    squared = F.col("known.r") * F.col("known.r")
    weight = F.when(F.col("priced") & (F.col("nth") == 1), 1.0).otherwise(1 - DECAY) * F.pow(F.lit(DECAY), -F.col("i"))
    rows = rows.withColumn("vol", F.sqrt(F.coalesce(F.pow(F.lit(DECAY), F.col("i")) * F.sum(weight * squared).over(so_far), F.lit(0.0))))
    size_ = F.col("bid_size") + F.col("ask_size")
    rows = rows.withColumn("depth", size_)
    known = lambda c, none: F.coalesce(F.col("known." + c), F.lit(none))
    rows = rows.withColumn("imbalance_", F.when(size_ > 0, (F.col("bid_size") - F.col("ask_size")) / size_).otherwise(0.0))
    rows = rows.select(
        "symbol", "seq", "ts_us", "halo", "mid", "spread_bps", "vol", "imbalance_", "depth", "volume",
        (known("r", 0.0) * 1e4).alias("ret_1_bps"), known("ret_5", 0.0).alias("ret_5"), known("ret_15", 0.0).alias("ret_15"),
        "known.short_vol", "known.long_vol", known("up_fraction", 0.5).alias("up_fraction"), known("run_length", 0).alias("run_length"), "known.gross",
        F.avg("volume").over(back(SIZE)).alias("v_mean"), F.stddev_pop("volume").over(back(SIZE)).alias("v_sd"), F.percentile("volume", F.lit(0.5)).over(back(SIZE)).alias("v_median"),
        F.percentile("depth", F.lit(0.5)).over(back(SIZE)).alias("d_median"),
        F.sum(F.col("last") * F.col("volume")).over(back(SIZE)).alias("turnover"), F.sum("volume").over(back(SIZE)).alias("traded"), F.max("mid").over(back(SIZE)).alias("high"),
    )
    vwap = F.when(F.col("traded") > 0, F.col("turnover") / F.col("traded")).otherwise(F.col("mid"))
    expected = F.col("vol") * F.sqrt(F.lit(float(SHORT)))
    return rows.filter(~F.col("halo") & (F.col("seq") >= WARMUP - 1)).select(
        "symbol", "seq", "ts_us", "mid", "spread_bps", "ret_1_bps",
        (F.col("ret_5") * 1e4).alias("ret_5_bps"), (F.col("ret_15") * 1e4).alias("ret_15_bps"), (F.col("vol") * 1e4).alias("vol_bps"),
        F.when(F.col("long_vol") > 0, F.col("short_vol") / F.col("long_vol")).otherwise(1.0).alias("vol_ratio"),
        F.when(expected > 0, F.col("ret_5") / expected).otherwise(0.0).alias("move_z"),
        "up_fraction", "run_length",
        F.when(F.col("v_sd") > 0, (F.col("volume") - F.col("v_mean")) / F.col("v_sd")).otherwise(0.0).alias("volume_z"),
        F.when(F.col("v_median") > 0, F.col("volume") / F.col("v_median")).otherwise(1.0).alias("volume_ratio"),
        F.col("imbalance_").alias("imbalance"),
        F.when(F.col("d_median") > 0, F.col("depth") / F.col("d_median")).otherwise(1.0).alias("depth_ratio"),
        F.when(F.col("gross") > 0, F.abs("ret_15") / F.col("gross")).otherwise(0.0).alias("trend_efficiency"),
        F.when(vwap > 0, (F.col("mid") - vwap) / vwap * 1e4).otherwise(0.0).alias("dist_vwap_bps"),
        F.when(F.col("high") > 0, (F.col("mid") - F.col("high")) / F.col("high") * 1e4).otherwise(0.0).alias("drawdown_bps"),
    )


def volatility_spikes(ticks: DataFrame, window: int = 24, trigger: float = 2.0, history: int = 400, least: int = 120) -> DataFrame:
    """Rows (symbol, seq, recent, typical, spike): mean absolute return against twice the median of past means.

    Means come from the ticks at which `window` mids are known; a spike needs `least` of them. Returns
    into and out of a tick without a positive mid are left out of the means.
    """
    w = Window.partitionBy("symbol", "block").orderBy("seq")
    rows = blocked(ticks).withColumn("mid", mid(F.col("bid"), F.col("ask"))).withColumn("a", F.abs(log_bps(F.lag("mid").over(w), F.col("mid"))) / 1e4)
    rows = rows.withColumn("recent", F.when(F.col("seq") >= window - 1, F.avg("a").over(w.rowsBetween(1 - window, 0))))
    rows = rows.select("symbol", "block", "seq", "recent", "halo")

    def medians(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("seq", ignore_index=True)
        x = np.concatenate([np.full(history - 1, np.nan), held["recent"].to_numpy(float)])
        missing = np.isnan(x)
        typical, known = np.full(len(held), np.nan), np.zeros(len(held), np.int64)
        for i in range(0, len(held), 1024):
            part = np.lib.stride_tricks.sliding_window_view(x[i : i + 1023 + history], history)
            n = history - np.lib.stride_tricks.sliding_window_view(missing[i : i + 1023 + history], history).sum(axis=1)
            known[i : i + len(part)], at = n, np.arange(i, i + len(part))
            whole, some = n == history, (n > 0) & (n < history)
            typical[at[whole]] = np.median(part[whole], axis=1) if whole.any() else 0.0
            # missing ones sort last
            own, m = np.sort(part[some], axis=1), n[some]
            line = np.arange(len(m))
            typical[at[some]] = (own[line, (m - 1) // 2] + own[line, m // 2]) / 2
        return held.assign(typical=typical, known=known)[["symbol", "seq", "recent", "halo", "typical", "known"]]

    kind = rows.schema["symbol"].dataType.simpleString()
    rows = rows.groupBy("symbol", "block").applyInPandas(medians, f"symbol {kind}, seq long, recent double, halo boolean, typical double, known long")
    rows = rows.withColumn("typical", F.nanvl("typical", F.lit(None).cast("double"))).withColumn("recent", F.nanvl("recent", F.lit(None).cast("double")))
    spike = (F.col("known") >= least) & (F.col("typical") > 0) & (F.col("recent") > trigger * F.col("typical"))
    return rows.filter(~F.col("halo") & F.col("recent").isNotNull()).select("symbol", "seq", "recent", "typical", spike.alias("spike"))


def interval_volume(ticks: DataFrame, counter: str = "day_volume") -> DataFrame:
    """ticks with `traded`, what a daily counter gained since the row before; 0 for the first and after a reset."""
    w = Window.partitionBy("symbol", "block").orderBy("seq")
    before = F.lag(counter).over(w)
    gained = F.when(before.isNull() | (F.col(counter) < before), 0.0).otherwise(F.col(counter) - before)
    return blocked(ticks, halo=1).withColumn("traded", gained).filter(~F.col("halo")).drop("block", "halo")
