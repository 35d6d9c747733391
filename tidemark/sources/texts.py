"""Landing jobs for documents: post archives, feeds, indexes, calendars, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.times import iso_week, moment
from tidemark.schema import stored
from tidemark.sources.trees import linked_articles, told


def _first(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


POST_FIELDS = ("status_id", "post_id", "text", "article_body", "original_url", "archive_url", "url", "date_published", "headline")


def posts(rows: DataFrame) -> DataFrame:
    """Any of the archive shapes as id, text, url, published, headline; fields that a shape lacks are null, rows without id stay to be counted."""
    for name in POST_FIELDS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.withColumns({n: F.col(n).cast("string") for n in POST_FIELDS})
    return rows.select(_first("status_id", "post_id").alias("id"), _first("text", "article_body").alias("text"), _first("original_url", "archive_url", "url").alias("url"), _first("date_published").alias("published"), _first("headline").alias("headline"), *[c for c in ("_corrupt", "ord") if c in rows.columns])


def read_posts(spark: SparkSession, path: str, form: str = "jsonl") -> tuple[DataFrame, DataFrame]:
    """(posts with id, one row of counts): JSON lines, a JSON array or CSV with or without a byte order mark."""
    fields = ", ".join(f"{n} string" for n in POST_FIELDS)
    if form == "csv":
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        rows = rows.toDF(*[c.replace("﻿", "") for c in rows.columns])
    else:
        rows = spark.read.schema(fields + ", _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=form == "json")
    got = posts(rows)
    bad = F.col("_corrupt").isNotNull() if "_corrupt" in got.columns else F.lit(False)
    counts = got.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("unreadable"), F.count_if(~bad & F.col("id").isNull()).alias("without_id"))
    return got.filter(~bad & F.col("id").isNotNull()).drop("_corrupt"), counts


def coverage(rows: DataFrame, ts: Column, inside: Column) -> DataFrame:
    """One row: rows, empty texts, without time, within the window, median length of the texts."""
    size = F.length(F.coalesce("text", F.lit("")))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(size == 0).alias("empty"), F.count_if(ts.isNull()).alias("no_time"), F.count_if(F.coalesce(inside, F.lit(False))).alias("in_window"), F.median(F.when(size > 0, size)).alias("median_chars"))


def feed_items(feeds: DataFrame) -> DataFrame:
    """Rows (source, title, ts) of feed texts (source, xml), RSS items and Atom entries: a title with its own stamp; either missing drops the item."""
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)
    rows = feeds.select("source", F.explode(items).alias("i"))
    raw = F.regexp_replace(F.regexp_extract("i", r"(?s)<title\b[^>]*>(.*?)</title>", 1), r"<!\[CDATA\[|\]\]>", "")
    title = F.trim(F.regexp_replace(F.regexp_replace(unescaped(raw), "<[^>]+>", ""), r"\s+", " "))
    ts = moment(F.regexp_extract("i", r"(?s)<(?:pubDate|published|updated|(?:dc:)?date)\b[^>]*>\s*(.*?)\s*</", 1))
    return rows.select("source", title.alias("title"), ts.alias("ts")).filter((F.col("title") != "") & F.col("ts").isNotNull())


def unescaped(x: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def archive_index(spark: SparkSession, path: str, kind: str, zone: str = "America/New_York") -> tuple[DataFrame, DataFrame]:
    """(rows kind, ts, title, speaker, link; one row of refused date-only ones) of an archive's JSON index; rows without a link are trailers."""
    return archive_rows(spark.read.schema("d string, t string, pt string, s string, l string, lo string").json(path, multiLine=True), kind, zone)


def archive_rows(raw: DataFrame, kind: str, zone: str = "America/New_York") -> tuple[DataFrame, DataFrame]:
    """archive_index() of rows that are read already (d, t, pt, s, l)."""
    raw = raw.filter(F.col("l").isNotNull())
    rows = raw.select(F.lit(kind).alias("kind"), moment(F.col("d"), zone).alias("ts"), "t", F.coalesce("s", "pt").alias("speaker"), F.col("l").alias("link"))
    return rows.filter(F.col("ts").isNotNull()).withColumnRenamed("t", "title"), rows.agg(F.count_if(F.col("ts").isNull()).alias("date_only"))


def add_calendar(rows: DataFrame, path: str, taken: Column) -> None:
    """Appends a snapshot by ISO week; earlier ones stay as they are."""
    rows.withColumn("taken", taken).withColumn("iso_week", iso_week(F.col("taken"))).write.mode("append").partitionBy("iso_week").parquet(path)


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot's row of each (title, country, ts)."""
    rows = spark.read.parquet(path)
    keys = ["title", "country", "ts"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("taken", *[c for c in rest if c != "taken"])).alias("_r")).select(*keys, "_r.*")


def articles(pages: DataFrame, limit: int = 8000) -> DataFrame:
    """Per page: page_id, title, published, body, keywords and `from`: JSON-LD of an article type at any depth first, else meta tags."""
    meta = lambda n: F.nullif(F.coalesce(F.nullif(F.regexp_extract("html", rf'(?is)<meta[^>]*(?:property|name)="{n}"[^>]*content="([^"]*)"', 1), F.lit("")), F.regexp_extract("html", rf'(?is)<meta[^>]*content="([^"]*)"[^>]*(?:property|name)="{n}"', 1)), F.lit(""))
    plain = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    tags = pages.select("page_id", F.coalesce(meta("og:title"), plain).alias("m_title"), meta("article:published_time").alias("m_published"), F.substring(F.coalesce(meta("og:description"), F.lit("")), 1, limit).alias("m_body"), F.split(F.coalesce(meta("article:tag"), F.lit("")), r"\s*,\s*").alias("m_keywords"))
    found = linked_articles(pages, limit).select(F.col("page_id").alias("_p"), F.struct("title", "published", "body", "keywords").alias("a"))
    rows = tags.join(found, F.col("page_id") == F.col("_p"), "left")
    linked = F.col("a").isNotNull()
    pick = lambda n: F.when(linked, F.col(f"a.{n}")).otherwise(F.col(f"m_{n}")).alias(n)
    return rows.select("page_id", F.when(linked, F.coalesce(F.nullif(F.col("a.title"), F.lit("")), F.col("m_title"))).otherwise(F.col("m_title")).alias("title"), pick("published"), pick("body"), pick("keywords"), F.when(linked, "json-ld").otherwise("meta").alias("from"))


TAG, GAP = r"(?s)<[^>]+>", r"\s+"


def plain_text(html: Column) -> Column:
    """Text of HTML without scripts, styles and comments; tags become blanks, runs of blanks one."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(bare, TAG, " ")), GAP, " "))


def lined_text(html: Column) -> Column:
    """Text of HTML with a line break at block tags, blank lines dropped."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    marked = unescaped(F.regexp_replace(F.regexp_replace(bare, r"(?is)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article)\b[^>]*>", "\n"), TAG, ""))
    return F.array_join(F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r]+", " "))), lambda s: s != ""), "\n")


def cms_text(rows: DataFrame, column: str = "body") -> DataFrame:
    """rows with `text`: of a JSON tree its text nodes with a line for each block, of HTML its lined text; rows are stored."""
    got = told(rows.withColumn("v", F.when(F.regexp_like(column, F.lit(r"^\s*[\[{]")), F.try_parse_json(column))), "_told")
    return got.select(*rows.columns, F.coalesce("_told", lined_text(F.col(column))).alias("text"))


def body_text(pages: DataFrame, block: str = r"(?is)<(article|main)\b[^>]*>(.*?)</\1>", tails: tuple[str, ...] = ("For media inquiries", "Last Update", "Related information")) -> DataFrame:
    """Per page: page_id, body (the longer of the content block and its paragraphs of 40 characters or more) and `short` (under 200)."""
    inner = F.regexp_extract("html", block, 2)
    text = plain_text(inner)
    for t in tails:
        text = F.when(F.locate(t, text) > 0, F.substring_index(text, t, 1)).otherwise(text)
    paragraphs = F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), plain_text), lambda s: F.length(s) >= 40)
    joined = F.array_join(paragraphs, " ")
    body = F.when(F.length(text) >= F.length(joined), F.trim(text)).otherwise(joined)
    return pages.select("page_id", body.alias("body")).withColumn("short", F.length("body") < 200)


def table_cells(pages: DataFrame) -> DataFrame:
    """Rows (page_id, table, row, col, text) of HTML tables, blank cells kept."""
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), 1)).alias("table", "t"))
    rows = tables.select("page_id", "table", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|\z)"), 1)).alias("row", "r"))
    cells = rows.select("page_id", "table", "row", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?=</?t[hdr]\b|\z)"), 1)).alias("col", "c"))
    return cells.select("page_id", "table", "row", "col", plain_text(F.col("c")).alias("text"))


def histogram(cells: DataFrame) -> DataFrame:
    """Rows (page_id, table, year, level, n): tables whose first column is rate levels and whose header names years."""
    from tidemark.functions.text import level_of

    cells = stored(cells)  # read three times, the pages taken apart once
    head = cells.filter((F.col("row") == 0) & F.regexp_like("text", F.lit(r"^(19|20)\d{2}$|(?i)^longer[\s-]*run$"))).select("page_id", "table", "col", F.col("text").alias("year"))
    stub = cells.filter(F.col("col") == 0).select("page_id", "table", "row", level_of(F.col("text")).alias("level")).filter(F.col("level").isNotNull())
    counts = cells.filter(F.col("col") > 0).select("page_id", "table", "row", "col", F.col("text").try_cast("int").alias("n")).filter(F.col("n") > 0)
    return counts.join(head, ["page_id", "table", "col"]).join(stub, ["page_id", "table", "row"]).select("page_id", "table", "year", "level", "n")


def sitemap_links(maps: DataFrame) -> DataFrame:
    """Rows (url, lastmod, year, week) of sitemap texts (xml), each url once; lastmod is when the entry changed, never when it was published."""
    rows = maps.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)).alias("u"))
    rows = rows.select(F.regexp_extract("u", r"(?s)<loc>\s*(.*?)\s*</loc>", 1).alias("url"), F.nullif(F.regexp_extract("u", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1), F.lit("")).alias("lastmod"))
    rows = rows.filter(F.col("url") != "").groupBy("url").agg(F.max("lastmod").alias("lastmod"))
    return rows.withColumn("year", F.regexp_extract("url", r"(\d{4})-W(\d{2})", 1).try_cast("int")).withColumn("week", F.regexp_extract("url", r"(\d{4})-W(\d{2})", 2).try_cast("int"))
