"""Bounded as-of joins: every price lookup is a probe, and all probes share one shuffle.

Rows of both sides are put into time buckets no shorter than the bound; tape rows within the bound of
a bucket's edge are also put into the neighbour. One sort of each (symbol, bucket) then answers its
probes with a last or first value, and an age test makes the answer exact. One symbol spreads over
its buckets, and nothing is multiplied but the rows at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import DAY, stored

BACKWARD, FORWARD = "backward", "forward"


def bounded_asof(tape: DataFrame, probes: DataFrame, bound_us: int, direction: str = BACKWARD, strict: bool = False, bucket_us: int | None = None, values: tuple[str, ...] = ("bid", "ask", "last"), prefix: str = "q_", parts: int | None = None) -> DataFrame:
    """probes (symbol, when_us, ...) with the tape's row found: q_ts_us, q_seq and q_<value>, null where none is in reach.

    Backward: the last row with when - bound <= ts <= when (strict: < when), the highest seq of equal
    stamps. Forward: the first with when <= ts <= when + bound (strict: > when), the lowest seq.
    Probes with a null symbol or moment stay, unanswered. bucket_us defaults to twice the bound; results
    don't depend on it. Buckets no longer than the bound are for many probes: of each only the row next to
    its edge is put into the buckets that it reaches, up to the next one with rows. parts: of the shuffle, if
    not as many as any has.
    """
    size = max(bucket_us or max(2 * bound_us, 1), 1)
    side = 1 if direction == BACKWARD else -1
    edge = F.col("ts_us") + side * bound_us
    own, far = F.floor(F.col("ts_us") / size), F.floor(edge / size)
    found = F.struct(F.col("ts_us"), F.col("seq"), *[F.col(v) for v in values])
    rows = tape.filter(F.col("symbol").isNotNull())
    if size > bound_us:
        ticks = rows.select("symbol", F.explode(F.array_distinct(F.array(own, far))).alias("_bucket"), F.col("ts_us").alias("_t"), F.col("seq").alias("_seq"), found.alias("_q"))
    else:
        ticks = rows.select("symbol", own.alias("_bucket"), F.col("ts_us").alias("_t"), F.col("seq").alias("_seq"), found.alias("_q"))
        at = F.struct("_t", "_seq")
        ends = ticks.groupBy("symbol", "_bucket").agg((F.max_by if side > 0 else F.min_by)(F.struct("_t", "_seq", "_q"), at).alias("_e"))
        following_ = F.lead("_bucket").over(Window.partitionBy("symbol").orderBy(F.col("_bucket") * side))  # a row a bucket
        last = F.floor((F.col("_e._t") + side * bound_us) / size)
        near = (F.least if side > 0 else F.greatest)(last, F.coalesce(following_, last))
        ends = ends.withColumn("_near", near).filter((F.col("_near") - F.col("_bucket")) * side > 0)
        ticks = ticks.unionByName(ends.select("symbol", F.explode(F.sequence(F.col("_bucket") + side, F.col("_near"))).alias("_bucket"), "_e.*"))
    # at equal stamps the inclusive reading needs ticks before probes when looking back, after them when looking ahead
    first = (direction == BACKWARD) != strict
    ticks = ticks.withColumn("_kind", F.lit(0 if first else 1)).withColumn("_p", F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType))
    asked = probes.select("symbol", F.floor(F.col("when_us") / size).alias("_bucket"), F.col("when_us").alias("_t"), F.lit(None).cast("long").alias("_seq"), F.lit(None).cast(ticks.schema["_q"].dataType).alias("_q"), F.lit(1 if first else 0).alias("_kind"), F.struct("*").alias("_p"))
    # looking ahead is looking back in the opposite order: a frame that only grows is one running value
    order = ["_t", "_kind", "_seq"] if direction == BACKWARD else [F.desc("_t"), F.desc("_kind"), F.desc("_seq")]
    so_far = Window.partitionBy("symbol", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    answer = F.last("_q", ignorenulls=True).over(so_far)
    age = side * (F.col("_t") - F.col("_a.ts_us"))
    both = ticks.unionByName(asked)
    if parts:
        both = both.repartition(parts, "symbol", "_bucket")
    out = both.withColumn("_a", answer).filter(F.col("_p").isNotNull())
    out = out.withColumn("_a", F.when((age >= 0) & (age <= bound_us), F.col("_a")))
    return out.select("_p.*", *[F.col(f"_a.{v}").alias(prefix + v) for v in ("ts_us", "seq", *values)])


def containing(bars: DataFrame, probes: DataFrame, length_us: int, values: tuple[str, ...], prefix: str = "q_") -> DataFrame:
    """probes with the bar that holds their moment: ts <= when < ts + length."""
    return bounded_asof(bars, probes, length_us - 1, BACKWARD, values=values, prefix=prefix)


def following(bars: DataFrame, probes: DataFrame, values: tuple[str, ...], day_us: int, prefix: str = "q_") -> DataFrame:
    """probes with the first bar at or after their moment, that day or the next, and no later."""
    got = bounded_asof(bars, probes, 2 * day_us, FORWARD, values=values, prefix=prefix)
    last_day = F.floor(F.col("when_us") / day_us) + 1
    near = F.floor(F.col(prefix + "ts_us") / day_us) <= last_day
    return got.select(*probes.columns, *[F.when(near, F.col(prefix + v)).alias(prefix + v) for v in ("ts_us", "seq", *values)])


def carried_asof(tape: DataFrame, probes: DataFrame, values: tuple[str, ...] = ("close",), prefix: str = "q_", bucket_us: int = 30 * DAY) -> DataFrame:
    """probes (symbol, when_us, ...) with the last row of the tape at or before them, however old; null before the first.

    A bucket's last row is carried over to the buckets after it, one row for each (symbol, bucket); within a
    bucket one sort answers all probes.
    """
    found = F.struct(F.col("ts_us"), F.col("seq"), *[F.col(v) for v in values])
    kind = probes.select(F.struct("*")).schema[0].dataType
    ticks = tape.filter(F.col("symbol").isNotNull()).select("symbol", F.col("ts_us").alias("_t"), F.lit(0).alias("_kind"), F.col("seq").alias("_seq"), found.alias("_q"), F.lit(None).cast(kind).alias("_p"))
    asked = probes.select("symbol", F.col("when_us").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_seq"), F.lit(None).cast(ticks.schema["_q"].dataType).alias("_q"), F.struct("*").alias("_p"))
    both = ticks.unionByName(asked).withColumn("_bucket", F.coalesce(F.floor(F.col("_t") / bucket_us), F.lit(0)))
    key = [F.col("symbol").eqNullSafe(F.col("_s")), F.col("_bucket") == F.col("_b")]
    ends = both.groupBy(F.col("symbol").alias("_s"), F.col("_bucket").alias("_b")).agg(F.max_by("_q", F.when(F.col("_kind") == 0, F.struct("_t", "_seq"))).alias("_end"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_s", "_b", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    own = Window.partitionBy("symbol", "_bucket").orderBy("_t", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_a", F.last("_q", ignorenulls=True).over(own)).filter(F.col("_p").isNotNull()).join(ends, key, "left")
    answer = F.when(F.col("_t").isNotNull(), F.coalesce("_a", "_carry"))
    return out.withColumn("_a", answer).select("_p.*", *[F.col(f"_a.{v}").alias(prefix + v) for v in ("ts_us", "seq", *values)])


def clamped(bars: DataFrame, probes: DataFrame, values: tuple[str, ...] = ("close",), prefix: str = "q_") -> DataFrame:
    """probes with the last bar at or before them, null outside the first and last bar of their symbol."""
    last = bars.groupBy(F.col("symbol").alias("_s")).agg(F.max("ts_us").alias("_hi"))
    got = carried_asof(bars, probes, values, prefix).join(last, F.col("symbol") == F.col("_s"), "left")
    inside = F.col("when_us") <= F.col("_hi")
    return got.select(*probes.columns, *[F.when(inside, F.col(prefix + v)).alias(prefix + v) for v in ("ts_us", "seq", *values)])


def stepped(bars: DataFrame, probes: DataFrame, values: tuple[str, ...] = ("close",), prefix: str = "q_") -> DataFrame:
    """What clamped() gives (without q_ts_us and q_seq), for probes that far outnumber the bars: no probe is sorted.

    bars: with a dense seq. A bar holds from its stamp up to the next one's. Time is cut into cells, for each symbol as many
    as it has bars, a bar is put into every cell that it touches (about two rows a bar), and a probe meets its own
    cell's bars in a hash join. The table of cells is stored, so a small one is broadcast.
    """
    per = bars.groupBy(F.col("symbol").alias("_s")).agg(F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    per = stored(per.select("_s", "_lo", "_hi", F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo")) / F.col("_n"))).cast("long").alias("_w")))  # a row a symbol
    held = by_position(bars.select("symbol", "seq", "ts_us", *values), bars, F.col("seq") + 1, ("ts_us",), "_next_").join(per, F.col("symbol") == F.col("_s"))
    held = held.withColumn("_to", F.coalesce("_next_ts_us", F.col("_hi") + 1)).filter("_to > ts_us")
    cell = lambda t: F.floor((t - F.col("_lo")) / F.col("_w"))
    cells = stored(held.select(F.col("symbol").alias("_c"), F.explode(F.sequence(cell(F.col("ts_us")), cell(F.col("_to") - 1))).alias("_cell"), F.col("ts_us").alias("_from"), "_to", *[F.col(v).alias(prefix + v) for v in values]))
    asked = probes.join(F.broadcast(per), F.col("symbol") == F.col("_s"), "left").withColumn("_at", cell(F.col("when_us")))
    same = (F.col("symbol") == F.col("_c")) & (F.col("_at") == F.col("_cell")) & (F.col("when_us") >= F.col("_from")) & (F.col("when_us") < F.col("_to"))
    return asked.join(cells, same, "left").select(*probes.columns, *[F.col(prefix + v) for v in values])


def by_position(rows: DataFrame, bars: DataFrame, index: Column, values: tuple[str, ...], prefix: str) -> DataFrame:
    """rows (symbol, ...) with the values of the bar at the given position of their symbol; null beyond the ends."""
    right = bars.select(F.col("symbol").alias("_s"), F.col("seq").alias("_i"), *[F.col(v).alias(prefix + v) for v in values])
    return rows.withColumn("_at", index).join(right, (F.col("symbol") == F.col("_s")) & (F.col("_at") == F.col("_i")), "left").drop("_s", "_i", "_at")


def range_lookup(rows: DataFrame, dated: DataFrame, when: str, date: str, strict: bool, prefix: str = "d_") -> DataFrame:
    """rows with the latest row of a small dated table before (strict) or at their moment; rows must have no such columns.

    dated is one table of daily figures; it joins by union and one window over date buckets of a month,
    carrying the last row of each earlier month forward.
    """
    cols = dated.columns
    right = dated.select(F.col(date).alias("_t"), F.lit(1 if strict else 0).alias("_k"), F.struct(*cols).alias("_d"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_r"))
    left = rows.select(F.col(when).alias("_t"), F.lit(0 if strict else 1).alias("_k"), F.lit(None).cast(right.schema["_d"].dataType).alias("_d"), F.struct("*").alias("_r"))
    both = right.unionByName(left).withColumn("_m", F.floor(F.unix_date(F.col("_t").cast("date")) / 31))
    month = both.groupBy("_m").agg(F.max_by("_d", F.when(F.col("_d").isNotNull(), F.struct("_t"))).alias("_end"))
    carried = Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)  # one row a month
    month = month.select("_m", F.last("_end", ignorenulls=True).over(carried).alias("_carry"))
    own = Window.partitionBy("_m").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.join(month, "_m").withColumn("_d", F.coalesce(F.last("_d", ignorenulls=True).over(own), F.col("_carry"))).filter(F.col("_r").isNotNull())
    return out.select("_r.*", *[F.col(f"_d.{c}").alias(prefix + c) for c in cols])


def valid_for(ticks: DataFrame, stances: DataFrame, ttl: int, values: tuple[str, ...], prefix: str = "s_") -> DataFrame:
    """ticks (symbol, seq, ...) with the stance in force: the latest that arrived at or before the tick, for ttl ticks from its arrival; null otherwise.

    stances: symbol, arrival (a seq), nth (order of equal arrivals), and the values. Seqs serve as moments.
    """
    tape = stances.select("symbol", F.col("arrival").alias("ts_us"), F.col("nth").alias("seq"), *values)
    got = bounded_asof(tape, ticks.withColumn("when_us", F.col("seq")), ttl - 1, values=values, prefix=prefix)
    return got.drop("when_us", prefix + "ts_us", prefix + "seq")
