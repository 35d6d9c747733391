"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites of each line merges by aggregation; lines whose estimate is near
the threshold get an exact distinct count. A line on `sites` or more sites is boilerplate: the
document with the smallest id keeps it, all others lose it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lines_col, normal_line, stored

SITES = 10
#: log2 of the sketch's buckets; its relative standard error is about 1.04 / sqrt(2^LG).
LG = 10
NULL_SITE = "\x00"


def site_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """Rows (doc_id, site, key): the hashes of the normalised lines with a word, once for each row of docs."""
    keys = F.array_distinct(F.transform(lines_col(F.col("text")), lambda x: F.xxhash64(normal_line(x))))
    return docs.select("doc_id", F.coalesce(F.col(site), F.lit(NULL_SITE)).alias("site"), F.explode(keys).alias("key"))


def spread_lines(rows: DataFrame, sites: int = SITES, lg: int = LG) -> DataFrame:
    """Rows (key, keeper): lines on at least `sites` sites and the smallest id of a document that has them.

    Exact: an estimate further than five standard errors (and one site) from the threshold decides,
    the lines between are counted.
    """
    seen = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"), F.hll_sketch_agg("site", lg).alias("sketch"))
    # a line in fewer documents than `sites` can't be on that many sites
    seen = seen.filter(F.col("n") >= sites).select("key", "keeper", F.hll_sketch_estimate("sketch").alias("est"))
    seen = stored(seen)
    band = max(1.0, 5 * 1.04 * sites / 2 ** (lg / 2))
    near = seen.filter(F.abs(F.col("est") - sites) <= band).select("key", "keeper")
    exact = rows.join(near.select("key"), "key", "left_semi").groupBy("key").agg(F.countDistinct("site").alias("s"))
    exact = near.join(exact.filter(F.col("s") >= sites), "key").select("key", "keeper")
    return seen.filter(F.col("est") > sites + band).select("key", "keeper").unionByName(exact)


def line_dedup(docs: DataFrame, site: str = "source", sites: int = SITES, lg: int = LG) -> DataFrame:
    """docs with its columns, boilerplate lines cut from text, and n_cut_lines.

    Every row stays, also where no line is left (text ''); texts without boilerplate, null ones
    included, stay as they were, byte for byte. Blank lines are never boilerplate. A null site is a
    site of its own; with equal ids, all rows of the smallest id keep the line. A column n_cut_lines
    of docs is replaced.
    """
    rows = site_lines(docs, site)
    spread = stored(spread_lines(rows, sites, lg))
    cuts = rows.join(spread, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    cuts = cuts.groupBy(F.col("doc_id").alias("cut_id")).agg(F.collect_set("key").alias("cut_keys"))
    out = docs.drop("n_cut_lines").join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda x: ~F.array_contains(F.col("cut_keys"), F.xxhash64(normal_line(x))))
    out = out.withColumn("ls_left", F.when(F.col("cut_keys").isNotNull(), left))
    n_cut = F.when(F.col("ls_left").isNull(), 0).otherwise(F.size(parts) - F.size("ls_left")).cast("long")
    out = out.withColumn("n_cut_lines", n_cut)
    text = F.when(F.col("ls_left").isNull(), F.col("text")).otherwise(F.array_join("ls_left", "\n"))
    return out.withColumn("text", text).drop("cut_id", "cut_keys", "ls_left")
