"""Pieces that several text operators share: word rules, folds, scratch tables, packed arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, U+0009 to U+000D and the space: what separates words everywhere here.
BLANK = " \t\n\x0b\f\r"
BLANK_CLASS = " \\t\\n\\x0B\\f\\r"
SPLIT = f"[{BLANK_CLASS}]+"


def words_col(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; an empty array for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))


def lines_col(text: Column) -> Column:
    """Array of the \\n-split lines that hold a word; an empty array for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")


def normal_line(line: Column) -> Column:
    """Lower case, outer blanks cut, inner runs of blanks as one space."""
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(BLANK))), SPLIT, " ")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k: which part of a split a document belongs to (null ids: as '')."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(k)).cast("int")


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with A-Z in lower case and every other byte as it was (bytes.lower is ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower()


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that all executors share, spark.checkpoint.dir.

    Where it is unset, a session on one machine takes a temporary folder; on a cluster every executor
    would write to a disk of its own, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder and read again: a cut in the lineage that outlives executors.

    Results are lazy and read these tables when they run, so the tables stay until removed() is called.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def removed(spark: SparkSession) -> int:
    """Deletes the tables that this application stored so far, for callers whose results are written; returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    delete(spark, paths)
    return len(paths)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables stored within, and no others; results must be written by then."""
    held = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    try:
        yield
    finally:
        own = held[before:]
        del held[before:]
        delete(spark, own)


def parts(spark: SparkSession) -> int:
    """How many parts a keyed shuffle should have: the session's own figure."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def attached(rows: DataFrame, names: DataFrame, keys: list[str], share: int | None = None) -> DataFrame:
    """rows joined with names, a row for each key that has `members`: how many of rows have that key.

    Keys with more rows than `share`, by default a quarter of a partition's even share, are broadcast, so that
    their rows need not come together: at that default they are at most four for each partition. All other
    keys join by shuffle.
    """
    if share is None:
        share = max(64, (names.agg(F.sum("members")).first()[0] or 0) // (4 * parts(rows.sparkSession)))
    large, small = names.filter(F.col("members") > share).drop("members"), names.filter(F.col("members") <= share).drop("members")
    first = rows.join(F.broadcast(large), keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys)
    return first.unionByName(rest)


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as byte planes of their differences: the width first, then plane after plane."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(np.uint64, copy=False), prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """The numbers that pack() was given."""
    if not blob:
        return np.empty(0, np.uint64)
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes spread over all bits (wraps round)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))
