"""Column expressions on prices: mid, spread, log returns, bands and phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies and their cuts, name: (labels, cuts).
BANDS = {
    "move": (("falling hard", "falling", "drifting down", "going nowhere", "drifting up", "rising", "rising hard"), (-2.0, -1.0, -0.3, 0.3, 1.0, 2.0)),
    "volatility": (("much quieter than usual", "quieter than usual", "normal", "more active than usual", "far more active than usual"), (0.6, 0.85, 1.2, 1.7)),
    "volume": (("very light", "light", "normal", "heavy", "surging"), (-1.0, -0.35, 0.75, 2.0)),
    "book": (("heavily weighted to sellers", "weighted to sellers", "balanced", "weighted to buyers", "heavily weighted to buyers"), (-0.5, -0.15, 0.15, 0.5)),
    "depth": (("much thinner than usual", "thinner than usual", "normal", "deeper than usual"), (0.5, 0.8, 1.3)),
    "cross_cost": (("negligible next to a typical move", "small next to a typical move", "about the size of a typical move", "larger than a typical move", "far larger than a typical move"), (0.25, 0.6, 1.0, 2.0)),
    "character": (("pure chop, no direction holds", "mostly chop", "mixed", "directional", "a clean one-way run"), (0.15, 0.3, 0.5, 0.7)),
    "vs_vwap": (("far below the session's average traded price", "below the session's average traded price", "around the session's average traded price", "above the session's average traded price", "far above the session's average traded price"), (-2.0, -0.6, 0.6, 2.0)),
    "exposure": (("at the maximum short", "meaningfully short", "slightly short", "flat, no position", "slightly long", "meaningfully long", "at the maximum long"), (-0.85, -0.45, -0.05, 0.05, 0.45, 0.85)),
    "open_pnl": (("a significant loss", "a small loss", "roughly break-even", "a small gain", "a significant gain"), (-2.0, -0.5, 0.5, 2.0)),
}


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_bps(bid: Column, ask: Column) -> Column:
    """Spread in basis points of the mid; 0 where the mid isn't positive."""
    m = mid(bid, ask)
    return F.when(m > 0, (ask - bid) / m * 1e4).otherwise(0.0)


def log_bps(a: Column, b: Column) -> Column:
    """ln(b / a) in basis points; null unless both are positive numbers."""
    fine = (a > 0) & (b > 0) & ~F.isnan(a) & ~F.isnan(b)
    return F.when(fine, F.ln(b / a) * 1e4)


def full_log_bps(a: Column, b: Column) -> Column:
    """log_bps() where a price of zero is a price: infinite into or out of it, not a number from zero to zero."""
    fine = ~F.isnan(a) & ~F.isnan(b)
    edge = F.when((a > 0) & (b == 0), float("-inf")).when((a == 0) & (b > 0), float("inf")).when((a == 0) & (b == 0), float("nan"))
    return F.coalesce(log_bps(a, b), F.when(fine, edge))


def band(value: Column, name: str) -> Column:
    """The label of the first cut strictly above the value, the last label beyond all cuts; null for null."""
    labels, cuts = BANDS[name]
    if len(labels) != len(cuts) + 1:
        raise ValueError(f"{name}: labels must be exactly one more than cuts")
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for label, cut in zip(labels, cuts, strict=False):
        out = out.when(value < cut, label)
    return out.otherwise(labels[-1])


def streak(run: Column) -> Column:
    """'3 consecutive up ticks' of a signed run length, 'no streak' of 0."""
    n = F.abs(run)
    said = F.concat(n.cast("string"), F.lit(" consecutive "), F.when(run > 0, "up").otherwise("down"), F.when(n == 1, " tick").otherwise(" ticks"))
    return F.when(run == 0, "no streak").otherwise(said)


def balance(up_fraction: Column) -> Column:
    """'7 of the last 10 snapshots closed higher', rounded half to even."""
    return F.concat(F.bround(up_fraction * 10).cast("int").cast("string"), F.lit(" of the last 10 snapshots closed higher"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def state(units: Column | None = None, max_units: float = 1.0, pnl_vols: Column | None = None, interval: str = "1 second", note: str = "top of book") -> Column:
    """A feature row (columns of tidemark.operators.features) as a nested struct of words."""
    vol = F.greatest(F.col("vol_bps"), F.lit(1e-9))
    units = F.lit(0.0) if units is None else units
    pnl = F.when(F.abs(units) < 1e-12, "no open position").otherwise(band(F.lit(0.0) if pnl_vols is None else pnl_vols, "open_pnl"))
    return F.struct(
        F.concat(F.col("symbol"), F.lit(f" spot, {interval} snapshots")).alias("instrument"),
        F.struct(
            band(F.col("ret_1_bps") / vol, "move").alias("last_snapshot"),
            band(F.col("move_z"), "move").alias("last_5_snapshots"),
            band(F.col("ret_15_bps") / (vol * 3.873), "move").alias("last_15_snapshots"),
            streak(F.col("run_length")).alias("streak"),
            balance(F.col("up_fraction")).alias("recent_balance"),
            band(F.col("trend_efficiency"), "character").alias("character"),
            band(F.col("dist_vwap_bps") / (vol * 5), "vs_vwap").alias("versus_session"),
        ).alias("price_action"),
        F.struct(band(F.col("vol_ratio"), "volatility").alias("volatility"), band(F.col("volume_z"), "volume").alias("traded_volume")).alias("activity"),
        F.struct(
            F.lit(note).alias("note"),
            band(F.col("imbalance"), "book").alias("resting_size"),
            band(F.col("depth_ratio"), "depth").alias("depth"),
            band(F.col("spread_bps") / vol, "cross_cost").alias("cost_to_cross_the_spread"),
        ).alias("order_book"),
        F.struct(band(units / max_units if max_units > 0 else F.lit(0.0), "exposure").alias("exposure"), pnl.alias("open_position_pnl")).alias("our_book"),
    )


#: Rule signals on a feature row, each in -1..1.
SIGNALS = {
    "flat": lambda: F.lit(0.0),
    "buy_and_hold": lambda: F.lit(1.0),
    "momentum": lambda: clamp(F.col("move_z") / 2.0, -1.0, 1.0),
    "mean_reversion": lambda: -clamp(F.col("move_z") / 2.0, -1.0, 1.0),
    "imbalance": lambda: clamp(F.col("imbalance") * 1.5, -1.0, 1.0),
    "random": lambda: (F.pmod(F.xxhash64(F.lit(11), "symbol", "seq"), F.lit(3)) - 1).cast("double"),
}


def band_sql(value: str, name: str) -> str:
    """band() in SQL."""
    labels, cuts = BANDS[name]
    quoted = [label.replace("'", "''") for label in labels]
    return f"CASE WHEN {value} IS NULL THEN NULL " + " ".join(f"WHEN {value} < {c} THEN '{q}'" for q, c in zip(quoted, cuts, strict=False)) + f" ELSE '{quoted[-1]}' END"
