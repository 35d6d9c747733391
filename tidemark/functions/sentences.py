"""Numbers as fixed sentences: what is priced, how projections moved, how the tape drifted."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

# The sentences below, word for word, and the rate up to which policy is at its floor.
ZERO_BOUND = 0.30


def half_even(x: Column, places: int) -> Column:
    """A double rounded to so many places by its exact value, half-way ones to even: how C and most languages print it.

    The product's rounding error is found by splitting x, so that 1.815, which is a little less, becomes 1.81
    and 4.125, which isn't, 4.12. For values below 2^40; -0.004 becomes -0.0.
    """
    scale = 10.0**places

    def parts(a: Column) -> Column:
        high = a * 134217729.0 - (a * 134217729.0 - a)
        return F.struct((a * scale).alias("p"), ((high * scale - a * scale) + (a - high) * scale).alias("error"))

    def nearest(s: Column) -> Column:
        k = F.floor(s["p"]).cast("double")
        return let((s["p"] - k) + s["error"], lambda rest: (k + F.when((rest > 0.5) | ((rest == 0.5) & (k % 2 == 1)), 1.0).otherwise(0.0)) / scale)

    return let(x, lambda v: let(let(parts(F.abs(v)), nearest), lambda m: F.when(v < 0, -m).otherwise(m)))


def told(pattern: str, *values: Column) -> Column:
    """format_string() with figures rounded by half_even()."""
    places = [int(n) if n else None for n in re.findall(r"%(?:\.(\d)f|s)", pattern)]
    return F.format_string(pattern, *[v if n is None else half_even(v, n) for v, n in zip(values, places, strict=True)])


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def gloss(change_bp: Column, quiet: float = 10.0) -> Column:
    return F.when(change_bp >= quiet, "the market has moved hawkish since then").when(change_bp <= -quiet, "the market has moved dovish since then").otherwise("little changed either way")


def plausible_target(target: Column, effective: Column) -> Column:
    """A parsed target unless the effective rate is more than 60 bp below or 10 bp above it; as given without an effective rate."""
    inside = (target >= effective - 0.10) & (target <= effective + 0.60)
    return F.when(effective.isNull() | inside, target)


def level_sentence(target: Column, effective: Column, as_of: Column) -> Column:
    t = plausible_target(target, effective)
    printed = told("the effective funds rate printed %.2f percent on %s", effective, as_of)
    return (
        F.when(t.isNotNull(), F.concat(told("The target range set at the last meeting tops out at %.2f percent", t), F.when(effective.isNotNull(), F.concat(F.lit(", and "), printed)).otherwise(""), F.lit(".")))
        .when(effective.isNotNull(), F.concat(F.lit("The previous statement's target range could not be parsed; "), printed, F.lit(".")))
        .otherwise(F.concat(F.lit("Neither the target range nor the effective funds rate is available for "), as_of, F.lit(".")))
    )


def priced_sentence(bill: Column, anchor: Column) -> Column:
    """What the six-month bill prices against the overnight rate, in quarter points; null without a bill."""
    steps = F.bround((bill - anchor) / 0.25).cast("int")
    against = told("The six-month bill yields %.2f percent against an overnight rate of %.2f: the market prices roughly ", bill, anchor)
    floor = F.concat(told("Policy is at the zero bound and the six-month bill yields %.2f percent, so there is no room to price cuts; the bill prices ", bill), F.when(steps > 0, F.concat(F.lit("roughly "), plural(F.abs(steps), "quarter-point hike"), F.lit(" within six months."))).otherwise("no move away from the floor within six months."))
    word = F.when(steps > 0, plural(F.abs(steps), "quarter-point hike")).otherwise(plural(F.abs(steps), "quarter-point cut"))
    return (
        F.when(bill.isNull(), F.lit(None).cast("string")).when(anchor.isNull(), told("The six-month bill yields %.2f percent; there is nothing to price it against.", bill))
        .when(anchor <= ZERO_BOUND, floor).when(steps == 0, F.concat(against, F.lit("no change within six months."))).otherwise(F.concat(against, word, F.lit(" within six months.")))
    )


def yield_sentence(name: str, value: Column, change_bp: Column, since: Column, glossed: bool = False) -> Column:
    moved = F.when(change_bp == 0, "unchanged").otherwise(F.concat(F.format_string("%.0f", F.bround(F.abs(change_bp))), F.lit(" bp "), F.when(change_bp > 0, "higher").otherwise("lower")))
    tail = F.concat(F.lit(": "), gloss(change_bp)) if glossed else F.lit("")
    line = F.concat(F.lit(f"The {name} is "), moved, F.lit(" than on "), F.coalesce(since, F.lit("the last meeting")), told(", at %.2f percent", value), tail, F.lit("."))
    return F.when(value.isNull(), F.lit(None).cast("string")).when(change_bp.isNull(), told(f"The {name} is at %.2f percent; there is no reading from the last meeting.", value)).otherwise(line)


def pricing_sentences(target: Column, effective: Column, as_of: Column, bill: Column, yields: dict[str, tuple[Column, Column]], since: Column, most: int = 6) -> Column:
    """Array of at most `most` sentences. yields: '2y', '10y', '1y' -> (value, change in bp); the two-year one is glossed."""
    names = (("2y", "two-year yield"), ("10y", "ten-year yield"), ("1y", "one-year yield"))
    rows = [yield_sentence(n, *yields[k], since, k == "2y") for k, n in names if k in yields]
    anchor = F.coalesce(effective, plausible_target(target, effective))
    return F.slice(F.array_compact(F.array(level_sentence(target, effective, as_of), priced_sentence(bill, anchor), *rows)), 1, most)


def projection_sentence(year: Column, now: Column, was: Column, since: Column) -> Column:
    where = F.when(year == "longer run", "the longer run").otherwise(F.concat(F.lit("end-"), year))
    steps = F.bround(F.abs(now - was) / 0.25).cast("int")
    move = F.when(year == "longer run", F.when(now > was, "a higher neutral rate").otherwise("a lower neutral rate")).when(now > was, "fewer cuts").otherwise("more cuts")
    size = F.when(steps > 0, F.concat(F.lit(" ("), plural(steps, "quarter-point step"), F.lit(")"))).otherwise("")
    first = F.concat(F.lit("Median projection for "), where)
    moved = F.concat(first, told(" moved to %.1f%% from %.1f%%", now, was), F.coalesce(F.concat(F.lit(" in "), since), F.lit(" at the last projection")), F.lit(": "), move, size, F.lit("."))
    return F.when(was.isNull(), F.concat(first, told(" is %.1f%%.", now))).when(F.abs(now - was) < 1e-9, F.concat(first, told(" is unchanged at %.1f%%.", now))).otherwise(moved)


def drift_sentences(symbol: Column, mid: Column, day_bps: Column, quarter_bps: Column) -> Column:
    """Array of one or two sentences on the day and the quarter of an hour before a release."""
    at = F.concat(symbol, F.format_string(" is at %.5f", mid))
    size = lambda x: F.format_string("%.0f", F.bround(F.abs(x)))
    day = F.when(day_bps.isNull(), F.concat(at, F.lit("; there is no price 24 hours back."))).otherwise(F.concat(at, F.lit(", "), size(day_bps), F.when(day_bps > 0, " bp higher").otherwise(" bp lower"), F.lit(" than 24 hours before the release.")))
    mood = F.when(F.abs(quarter_bps) < 5, "the tape was quiet going in").when(F.abs(quarter_bps) < 15, "some positioning ahead of the release").otherwise("a large move going in, so something was already being traded")
    quarter = F.concat(F.lit("In the fifteen minutes before the release it moved "), size(quarter_bps), F.when(quarter_bps > 0, " bp up: ").otherwise(" bp down: "), mood, F.lit("."))
    return F.array_compact(F.array(day, F.when(quarter_bps.isNotNull(), quarter)))
