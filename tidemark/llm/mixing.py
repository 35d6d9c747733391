"""Time-varying curriculum: sources mixed to target weights and put in training order.

Each source has a weight and a schedule, a piecewise linear multiplier over training progress
0..1. The area under a schedule, scaled to the source's target, is the cumulative demand for its
words. A document's place among its source's words (in hash order, epoch after epoch) is looked up
in the inverse of that demand, which gives the training position; rows are range-sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK_CLASS, words_col

WEIGHTS = (5, 2, 1)
BUCKETS, ROWS_A_BUCKET = 1024, 65_536
#: Knots (progress, multiplier) by the source's place in the repeating weights: one kind early, one even, one late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3, budget: float = 1.0) -> DataFrame:
    """Per source: source, kind, source_size, target.

    sizes: rows (source, size). Sources rank by code point, null last, and take the weights in turn.
    The weights share `budget` times all words. A target stops at `most` times its source's size and
    the excess goes to the others by weight, until none is above: with r = cap / weight ascending,
    the capped sources are a prefix, and the rest get level * weight. Ties in r are capped together,
    which gives the same targets. No rows: no sources; no words: all targets 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("kind", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("kind") + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_r = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_r.rowsBetween(Window.unboundedPreceding, -1)
    after = by_r.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(every) * budget)
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(after))
        # the level if this source and all after it were uncapped; the first that holds is the level
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("left"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct("spent", "level"))).over(every)["level"])
    )
    share = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return per.select("source", "kind", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def place(u: Column, knots) -> Column:
    """Training progress at which a share u of the demand is used up: the inverse of the schedule's integral."""
    area, areas = 0.0, []
    for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):
        areas.append(area)
        area += (t1 - t0) * (m0 + m1) / 2
    out = F.lit(float(knots[-1][0]))
    for (t0, m0), (t1, m1), a0 in reversed(list(zip(knots, knots[1:], areas, strict=False))):
        rest, slope = u * area - a0, (m1 - m0) / (t1 - t0)
        # m0*x + slope*x^2/2 = rest, in the form that stays exact where the slope is 0
        x = 2 * rest / F.nullif(m0 + F.sqrt(F.greatest(F.lit(0.0), m0 * m0 + 2 * slope * rest)), F.lit(0.0))
        end = a0 + (t1 - t0) * (m0 + m1) / 2
        out = F.when(u * area <= end, t0 + F.coalesce(x, F.lit(0.0))).otherwise(out)
    return out


def curriculum(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most: int = 3, budget: float = 1.0, buckets: int = BUCKETS, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """All rows of docs with mix_size, mix_source_size, mix_target, mix_taken and mix_copies.

    mix_copies is an array of (epoch, words, position), one for each time the document is used: whole
    epochs first, then the rest of the target by hash order, the last document cut at the target.
    The running sum over a source is a sum over hash buckets plus a sum within the bucket, so a
    source with a third of all rows spreads over tasks; buckets are split by the hash's first digits
    until one holds about `rows_a_bucket` rows at most, which leaves the order as it is. Sources are
    rows of a small table that some windows hold in one task: some tens of bytes each. Every order is by md5 of the id, then id,
    then size: reruns agree, and equal rows get equal sums in some order. Null texts have size 0, a
    null source is a source of its own, and a null id hashes as ''. Columns of docs called mix_* are
    replaced.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    sized = docs.withColumn("mix_size", F.size(words_col(F.col("text"))).cast("long"))
    # a key without nulls, so that the window and the join below share one shuffle of the rows
    sized = sized.withColumn("mix_src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    bucket = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") % buckets
    digits, n = 0, docs.count()
    while n > rows_a_bucket * buckets * 16**digits:
        digits += 1
    if digits:
        bucket = bucket * 16**digits + F.conv(F.substring("mix_key", 1, digits), 16, 10).cast("long")
    sized = sized.withColumn("mix_key", key).withColumn("mix_bucket", bucket)
    per = sized.groupBy("source", "mix_src", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum"))
    targets = source_targets(per.select("source", F.col("mix_sum").alias("size")), weights, most, budget)
    before = Window.partitionBy("mix_src").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumn("mix_before", F.coalesce(F.sum("mix_sum").over(before), F.lit(0)))
    base = base.join(targets.withColumnRenamed("source", "mix_t"), F.col("source").eqNullSafe(F.col("mix_t")))
    base = base.select("mix_src", "mix_bucket", "mix_before", F.col("kind").alias("mix_kind"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    within = Window.partitionBy("mix_src", "mix_bucket").orderBy("mix_key", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("mix_cum", F.coalesce(F.sum("mix_size").over(within), F.lit(0)))
    out = out.join(base, ["mix_src", "mix_bucket"])
    cum, want, all_ = F.col("mix_cum") + F.col("mix_before"), F.round("mix_target").cast("long"), F.col("mix_source_size")
    full = F.when(all_ > 0, F.floor(want / all_)).otherwise(0).cast("int")
    part = F.greatest(F.lit(0), F.least(F.col("mix_size"), want - full * all_ - cum))

    def copy(e: Column) -> Column:
        taken = F.when(e < full, F.col("mix_size")).otherwise(part)
        # a source without words has no demand and no positions
        u = F.least(F.lit(1.0), (e * all_ + cum + taken / 2) / F.nullif(want, F.lit(0)))
        at = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            at = F.when(F.col("mix_kind") % len(schedules) == i, place(u, knots)).otherwise(at)
        return F.struct(e.alias("epoch"), taken.alias("words"), at.alias("position"))

    out = out.withColumn("mix_taken", full * F.col("mix_size") + part)
    out = out.withColumn("mix_copies", F.filter(F.transform(F.sequence(F.lit(0), full), copy), lambda c: c["words"] > 0))
    return out.drop("mix_key", "mix_bucket", "mix_src", "mix_before", "mix_kind", "mix_cum")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, white space as it was."""
    ends = f"(?<=[^{BLANK_CLASS}])(?=[{BLANK_CLASS}])"
    return F.array_join(F.slice(F.split(text, ends), F.lit(1), n), "")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy that curriculum() planned, range-sorted by training position; the text of a copy taken in part ends after its words."""
    rows = mixed.withColumn("mix_copy", F.explode("mix_copies"))
    cut = F.when(F.col("mix_copy.words") < F.col("mix_size"), first_words(F.col("text"), F.col("mix_copy.words").cast("int"))).otherwise(F.col("text"))
    return rows.withColumn("text", cut).select("*", "mix_copy.position", "mix_copy.epoch").drop("mix_copy").orderBy("position", "doc_id", "epoch")
