"""Exact quantiles of groups of any size, by narrowing.

Sketches that combine before the shuffle bound the value of each wanted rank; rows below the bounds are
counted, and only rows within them go on. When few different values are left, their counts are summed
in order. No group is ever brought together, and repeated values are one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import stored

#: Values of one rank that are sorted in the end, at most; and the grid of each narrowing, whose sketch is finer than its steps.
SORTED, GRID, ACCURACY = 100_000, 64, 4096
#: Ranks that are broadcast; more of them join by shuffle, and then no group is large against the others' number.
FEW = 10_000


def ranked_values(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame, most: int = SORTED) -> DataFrame:
    """ranks (keys, name, rank) with `value`: the value at that place, from 0, of the key's ascending values without null and NaN.

    A rank beyond the key's values has no row. Keys compare null-safe.
    """
    data = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    asked = stored(ranks.select(*named, "name", F.col("rank").cast("long").alias("rank")))
    few = asked.count() <= FEW
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # of a rank: its value lies in [low, high], `below` values are less than low, `inside` lie between
    state = stored(sizes.join(F.broadcast(asked) if few else asked, same).filter("rank < _n").select(*[c for c in asked.columns], F.lit(0).cast("long").alias("below"), F.col("_n").alias("inside"), F.col("_low").alias("low"), F.col("_high").alias("high")))
    own = [f"_k{i}" for i in range(len(keys))] + ["name", "rank"]

    def within(left: DataFrame) -> DataFrame:
        return data.join(F.broadcast(left) if few else left, same).filter("_v >= low AND _v <= high")

    done = []
    while True:
        done.append(state.filter((F.col("inside") <= most) | (F.col("low") == F.col("high"))))
        left = stored(state.filter((F.col("inside") > most) & (F.col("low") < F.col("high"))))
        if not left.take(1):
            break
        grid = F.percentile_approx("_v", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY)
        sketch = within(left).groupBy(*own, "below", "inside", "low", "high").agg(grid.alias("_g"))
        at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * GRID).cast("int")
        # a step more on either side than the sketch's error needs
        cut = sketch.withColumn("_a", F.when(at > 0, F.greatest(F.get("_g", at - 1), F.col("low"))).otherwise(F.col("low"))).withColumn("_z", F.when(at + 2 <= GRID, F.least(F.get("_g", at + 2), F.col("high"))).otherwise(F.col("high")))
        cut = cut.drop("_g")
        counted = within(cut).groupBy(*own, "below", "inside", "low", "high", "_a", "_z").agg(F.count_if(F.col("_v") < F.col("_a")).alias("_less"), F.count_if((F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_z"))).alias("_in"))
        down = F.col("below") + F.col("_less")
        fine = (F.col("rank") >= down) & (F.col("rank") < down + F.col("_in")) & (F.col("_in") < F.col("inside"))
        state = stored(counted.select(*own, F.when(fine, down).otherwise(F.col("below")).alias("below"), F.when(fine, F.col("_in")).otherwise(F.col("inside")).alias("inside"), F.when(fine, F.col("_a")).otherwise(F.col("low")).alias("low"), F.when(fine, F.col("_z")).otherwise(F.col("high")).alias("high"), fine.alias("_fine")))
        # bounds that don't narrow leave the rank to the sorted counts, whatever their number
        done.append(state.filter("NOT _fine").drop("_fine"))
        state = state.filter("_fine").drop("_fine")
    last = reduce(DataFrame.unionByName, done)
    counts = within(last).groupBy(*own, "below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    so_far = Window.partitionBy(*own, "below").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("_to", F.col("below") + F.sum("_c").over(so_far)).filter((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("_c")))
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "name", "rank", F.col("_v").alias("value"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], index: dict[str, tuple[float, int]] | None = None, most: int = SORTED) -> DataFrame:
    """Per key: a column for each share, interpolated between the two places next to share * (n - 1).

    index: name -> (share, base), for the value at place int(share * (n - base)), at most the last, without
    interpolation. Keys without values have no row.
    """
    fine = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sizes = stored(fine.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    at = lambda s: F.lit(s) * (F.col("_n") - 1)
    wanted = [F.struct(F.lit(f"{n}:{side}").alias("name"), f(at(s)).cast("long").alias("rank")) for n, s in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    wanted += [F.struct(F.lit(f"{n}:low").alias("name"), F.least(F.floor(F.lit(s) * (F.col("_n") - base)), F.col("_n") - 1).cast("long").alias("rank")) for n, (s, base) in (index or {}).items()]
    got = ranked_values(rows, keys, value, sizes.select(*keys, F.explode(F.array(*wanted)).alias("_w")).select(*keys, "_w.*"), most)
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    wide = got.groupBy(*keys).agg(*[pick(f"{n}:{side}").alias(f"_{n}_{side}") for n in shares for side in ("low", "high")], *[pick(f"{n}:low").alias(n) for n in index or {}])
    wide = wide.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in wide.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    out = sizes.join(wide, same)
    mixed = lambda n, s: F.col(f"_{n}_low") + (at(s) - F.floor(at(s))) * (F.col(f"_{n}_high") - F.col(f"_{n}_low"))
    return out.select(*keys, *[mixed(n, s).alias(n) for n, s in shares.items()], *(index or {}))
