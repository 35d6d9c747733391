"""Landing jobs for tapes: CSV ticks, packed tick and minute files, chart JSON, OHLCV bars."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import HOUR, SECOND

TICK_CSV = "seq long, ts double, symbol string, bid double, ask double, last double, volume double, bid_size double, ask_size double"
TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
BAR = np.dtype([("s", ">u4"), ("open", ">u4"), ("close", ">u4"), ("low", ">u4"), ("high", ">u4"), ("volume", ">f4")])


def read_ticks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Tick CSV with header, ts as ts_us; with a limit, the rows of the smallest seq."""
    rows = spark.read.schema(TICK_CSV).csv(path, header=True).withColumn("ts_us", F.round(F.col("ts") * SECOND).cast("long")).drop("ts")
    return rows if limit is None else rows.orderBy("seq").limit(limit)


def interval_us(ticks: DataFrame) -> DataFrame:
    """One row per symbol: the gap between its first two ticks."""
    firsts = ticks.groupBy("symbol").agg(F.min(F.struct("seq", "ts_us")).alias("a"))
    rest = ticks.join(firsts, "symbol").filter(F.col("seq") > F.col("a.seq"))
    return rest.groupBy("symbol").agg((F.min_by("ts_us", "seq") - F.first("a.ts_us")).alias("interval_us"))


def write_ticks(ticks: DataFrame, path: str) -> None:
    """Tick CSV: ts with 3 places, prices with 6, volumes with 8."""
    places = {"bid": 6, "ask": 6, "last": 6, "volume": 8, "bid_size": 8, "ask_size": 8}
    cols = [F.col("seq"), F.format_string("%.3f", F.col("ts_us") / SECOND).alias("ts"), F.col("symbol"), *[F.format_string(f"%.{n}f", F.col(c)).alias(c) for c, n in places.items()]]
    ticks.select(*cols).write.csv(path, header=True)


def unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    """Records of an LZMA file; an empty one has none, a truncated tail is ignored."""
    if not blob:
        return np.empty(0, kind)
    d = lzma.LZMADecompressor()
    raw = d.decompress(blob)
    return np.frombuffer(raw[: len(raw) // kind.itemsize * kind.itemsize], kind)


def price_scale(symbol: str) -> float:
    return 1e3 if symbol.endswith("JPY") else 1e5


def _named(spark: SparkSession, path: str, pattern: str, names: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("content", *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def read_tick_files(spark: SparkSession, path: str) -> DataFrame:
    """Hourly tick files .../SYMBOL/yyyy/MM/dd/HHh_ticks.bi5, month from zero: symbol, ts_us, bid, ask, volumes."""
    files = _named(spark, path, r"/([A-Z]{6})/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$", ("symbol", "y", "m", "d", "h"))
    start = F.make_timestamp(F.col("y").cast("int"), F.col("m").cast("int") + 1, F.col("d").cast("int"), F.col("h").cast("int"), F.lit(0), F.lit(0), F.lit("UTC"))
    return unpacked_ticks(files.select("content", "symbol", F.unix_micros(start).alias("start")))


def unpacked_ticks(files: DataFrame) -> DataFrame:
    """The ticks of packed files (content, symbol, start in microseconds)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, symbol, start_us in b.itertuples(index=False):
                r = unpacked(content, TICK)
                yield pd.DataFrame({"symbol": symbol, "ts_us": start_us + r["ms"].astype(np.int64) * 1000, "bid": r["bid"] / price_scale(symbol), "ask": r["ask"] / price_scale(symbol), "bid_volume": r["bid_volume"].astype(float), "ask_volume": r["ask_volume"].astype(float)})

    return files.mapInPandas(run, "symbol string, ts_us long, bid double, ask double, bid_volume double, ask_volume double")


def read_minute_files(spark: SparkSession, path: str) -> DataFrame:
    """Daily one-sided minute files .../SYMBOL/yyyy/MM/dd/SIDE_candles_min_1.bi5, month from zero: symbol, side, ts_us, open, close, low, high, volume."""
    files = _named(spark, path, r"/([A-Z]{6})/(\d{4})/(\d{2})/(\d{2})/(BID|ASK)_candles_min_1\.bi5$", ("symbol", "y", "m", "d", "side"))
    start = F.make_timestamp(F.col("y").cast("int"), F.col("m").cast("int") + 1, F.col("d").cast("int"), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    return unpacked_minutes(files.select("content", "symbol", F.lower("side").alias("side"), F.unix_micros(start).alias("start")))


def unpacked_minutes(files: DataFrame) -> DataFrame:
    """The bars of packed files (content, symbol, side, start in microseconds)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, symbol, side, start_us in b.itertuples(index=False):
                r, k = unpacked(content, BAR), price_scale(symbol)
                yield pd.DataFrame({"symbol": symbol, "side": side, "ts_us": start_us + r["s"].astype(np.int64) * SECOND, **{c: r[c] / k for c in ("open", "close", "low", "high")}, "volume": r["volume"].astype(float)})

    return files.mapInPandas(run, "symbol string, side string, ts_us long, open double, close double, low double, high double, volume double")


def land(rows: DataFrame, path: str) -> None:
    """Rows with ts_us as Parquet by symbol and date, for pruning."""
    dated = rows.withColumn("date", F.timestamp_micros("ts_us").cast("date"))
    dated.repartition("symbol", "date").write.partitionBy("symbol", "date").option("compression", "zstd").parquet(path)


def chart_bars(docs: DataFrame, column: str = "value") -> DataFrame:
    """Bars (symbol, ts_us, open, close) of chart JSON texts; prints that are null or not positive are dropped."""
    schema = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<long>,indicators:struct<quote:array<struct<open:array<double>,close:array<double>>>>>>>"
    r = docs.select(F.explode(F.from_json(column, schema)["chart"]["result"]).alias("r"))
    q = F.get(F.col("r.indicators.quote"), 0)
    rows = r.select(F.col("r.meta.symbol").alias("symbol"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), q["open"].alias("o"), q["close"].alias("c"))).alias("b"))
    return rows.filter((F.col("b.o") > 0) & (F.col("b.c") > 0)).select("symbol", (F.col("b.t") * SECOND).alias("ts_us"), F.col("b.o").alias("open"), F.col("b.c").alias("close"))


def ohlcv_ticks(bars: DataFrame) -> DataFrame:
    """Ticks made from bars (symbol, ts_us, open, high, low, close, volume, trades).

    The spread is a tenth of the bar's range within 1 to 25 bps; the close's place in the range gives
    the book's lean, within 0.9; sizes follow four times the volume of a trade, at least 1e-6.
    """
    span, middle = F.col("high") - F.col("low"), (F.col("high") + F.col("low")) / 2
    bps = F.greatest(F.lit(1.0), F.least(F.lit(25.0), 0.1 * span / F.col("close") * 1e4))
    lean = F.when(span > 0, F.greatest(F.lit(-0.9), F.least(F.lit(0.9), 2 * (F.col("close") - middle) / span))).otherwise(0.0)
    size, half = 4 * F.col("volume") / F.greatest(F.col("trades"), F.lit(1)), F.col("close") * bps / 2e4
    sized = lambda x: F.greatest(F.lit(1e-6), x)
    return bars.select("symbol", "ts_us", (F.col("close") - half).alias("bid"), (F.col("close") + half).alias("ask"), F.col("close").alias("last"), "volume", sized(size * (1 + lean) / 2).alias("bid_size"), sized(size * (1 - lean) / 2).alias("ask_size"))


def bars_of(ticks: DataFrame, width_us: int = HOUR) -> DataFrame:
    """Bars (symbol, ts_us, open, close, high, low, volume, trades) of ticks, dense seq per symbol added, gaps left out."""
    from tidemark.schema import DAY, numbered

    start = (F.floor(F.col("ts_us") / width_us) * width_us).cast("long")
    got = ticks.groupBy("symbol", start.alias("start")).agg(F.min_by("last", "seq").alias("open"), F.max_by("last", "seq").alias("close"), F.max("last").alias("high"), F.min("last").alias("low"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trades"))
    return numbered(got.withColumnRenamed("start", "ts_us"), "symbol", ["ts_us"], F.floor(F.col("ts_us") / (30 * DAY)))


def rates(lines: DataFrame, described: dict[str, str], header: Column) -> DataFrame:
    """Rows (date, tenor, value) of rate CSV lines (value, and file where there are several): columns are known by their description, blanks and ND are absent.

    described: description -> tenor. header: which lines hold descriptions; each file's columns are those of
    its own, the one that names most of the tenors if it has several.
    """
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.lit(""))
    clean = F.regexp_replace("value", "^﻿", "")
    cells = lambda c: F.transform(F.split(c, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    named = F.create_map(*[F.lit(x) for kv in described.items() for x in kv])
    tenors = F.transform(cells(clean), lambda x: F.element_at(named, x))
    best = lines.filter(header).groupBy("file").agg(F.max_by(tenors, F.struct(F.size(F.array_compact(tenors)), "value")).alias("t"))
    heads = best.select(F.col("file").alias("_f"), F.posexplode("t").alias("_pos", "tenor")).filter(F.col("tenor").isNotNull())
    body = lines.select("file", cells(clean).alias("c")).withColumn("date", F.to_date(F.get("c", 0).try_cast("date"))).filter(F.col("date").isNotNull())
    rows = body.select("file", "date", F.posexplode("c").alias("pos", "cell")).join(heads, (F.col("file") == F.col("_f")) & (F.col("pos") == F.col("_pos")))
    return rows.select("date", "tenor", F.col("cell").try_cast("double").alias("value")).filter(F.col("value").isNotNull())


def merged_rates(tables: list[DataFrame]) -> DataFrame:
    """One value per date and tenor: that of the first table that has it."""
    rows = None
    for i, t in enumerate(tables):
        t = t.withColumn("_p", F.lit(i))
        rows = t if rows is None else rows.unionByName(t)
    return rows.groupBy("date", "tenor").agg(F.min_by("value", "_p").alias("value"))
