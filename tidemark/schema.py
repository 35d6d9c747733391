"""Column conventions and the tapes derived from the event table.

Every moment is `ts_us`, epoch microseconds as BIGINT, because comparisons at equal stamps decide
results. A tape has symbol, ts_us, seq (dense per symbol), bid, ask, last, volume, bid_size, ask_size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp; one without zone counts in the session's, which is set to UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, the folder that all executors share.

    Without that setting a session on one machine takes a temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder and read again: made once, however often it is used."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that stored() made within, and no others; results must be written by then."""
    held = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    try:
        yield
    finally:
        own = held[before:]
        del held[before:]
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def parts_for(spark: SparkSession, rows: int, each: int = 500_000) -> int | None:
    """Parts for a shuffle of so many rows, of at most `each` on average; None where as many as any shuffle has are enough."""
    parts = -(-rows // each)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def numbered(rows: DataFrame, key: str, order: list[str], bucket: Column, name: str = "seq", parts: int | None = None) -> DataFrame:
    """rows with a dense number from 0 per key in the given order; bucket must be monotone in the order.

    Places within (key, bucket) plus the earlier buckets' sizes: one key with all rows still spreads
    over as many tasks as it has buckets. parts: of the shuffle, if not as many as any has.
    """
    rows = rows.withColumn("_b", bucket)
    if parts:
        rows = rows.repartition(parts, key, "_b")
    sizes = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(key, "_b").orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(own) - 1).join(sizes, [key, "_b"]).withColumn(name, (F.col("_base") + F.col("_r")).cast("long")).drop("_b", "_r", "_base")


def tape(events: DataFrame) -> DataFrame:
    """The event table as ticks: one symbol for each event type, quoted k millionths around the value."""
    k = F.get_json_object("props", "$.k").cast("double")
    ticks = events.select(
        F.col("event_type").alias("symbol"), micros(F.col("ts")).alias("ts_us"), "event_id",
        (F.col("value") * (1 - k / 1e6)).alias("bid"), (F.col("value") * (1 + k / 1e6)).alias("ask"), F.col("value").alias("last"),
        (k + 1).alias("volume"), (1 + F.col("user_id") % 7).cast("double").alias("bid_size"), (1 + F.col("user_id") % 5).cast("double").alias("ask_size"),
    )
    return numbered(ticks, "symbol", ["ts_us", "event_id"], F.floor(F.col("ts_us") / DAY))


#: The same ticks in DuckDB SQL, as the start of a WITH clause.
TAPE_SQL = """WITH k AS (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k, epoch_us(ts) AS ts_us FROM events),
tape AS (SELECT event_type AS symbol, ts_us, event_id, value * (1 - k / 1e6) AS bid, value * (1 + k / 1e6) AS ask, value AS last, k + 1 AS volume,
  (1 + user_id % 7)::DOUBLE AS bid_size, (1 + user_id % 5)::DOUBLE AS ask_size, row_number() OVER (PARTITION BY event_type ORDER BY ts_us, event_id) - 1 AS seq FROM k)"""
