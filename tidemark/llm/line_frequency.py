"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed, distinct documents are counted per host and line, lines above the
host's limit are taken away, and documents that lose most of their words are rejected. Simple
in-document rules (length, repeated windows of words) come with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, lines_col, normal_line, stored, words_col

WINDOW = 8
#: A line is boilerplate of a host from more than LEAST_DOCS documents and more than HOST_SHARE of the host's documents.
LEAST_DOCS, HOST_SHARE = 10, 0.02
#: A document must keep this share of its words.
LEFT_SHARE = 0.3


def window_keys(hashes: Column) -> Column:
    """Hashes of the WINDOW-word windows in text order, given the words' hashes; none if there is one window at most."""
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) <= WINDOW, F.array().cast("array<bigint>")).otherwise(keys)


def repeated_starts(pairs: Column) -> Column:
    """Starts of the windows found twice or more, ascending; pairs: sorted structs of hash k and start i."""
    last = F.size(pairs) - 1

    def flagged(p: Column, j: Column) -> Column:
        near = ((j > 0) & (F.get(pairs, j - 1)["k"] == p["k"])) | ((j < last) & (F.get(pairs, j + 1)["k"] == p["k"]))
        return F.when(near, p["i"])

    return F.sort_array(F.filter(F.transform(pairs, flagged), lambda i: i.isNotNull()))


def covered(starts: Column) -> Column:
    """Number of words under windows with these ascending starts."""
    steps = F.transform(starts, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - i, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda a, s: a + s)


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null and blank texts have no words: counts 0 (symbols need no word), base_failed true. Columns of
    these names are replaced; all others stay, texts of any length included.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # each array is a column of its own: inside a lambda an expression would be made again for every element
    out = docs.withColumn("lf_words", words_col(text)).withColumn("lf_lines", lines_col(text))
    out = out.withColumn("lf_hash", F.transform("lf_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("lf_keys", window_keys(F.col("lf_hash")))
    repeated = F.size(F.array_distinct("lf_keys")) < F.size("lf_keys")
    pairs = F.sort_array(F.transform("lf_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    out = out.withColumn("lf_pairs", F.when(repeated, pairs))
    out = out.withColumn("lf_at", F.when(F.col("lf_pairs").isNotNull(), repeated_starts(F.col("lf_pairs"))))
    out = (
        out.withColumn("n_words", F.size("lf_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("lf_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("lf_lines") - F.size(F.array_distinct("lf_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered(F.col("lf_at")), F.lit(0)).cast("long"))
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("lf_words", "lf_lines", "lf_hash", "lf_keys", "lf_pairs", "lf_at")


def line_keys(text: Column) -> Column:
    """Hashes of the normalised lines that hold a word, in order."""
    return F.transform(lines_col(text), lambda x: F.xxhash64(normal_line(x)))


def host_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """Rows (doc, host, key): the distinct normalised lines of each row of docs. doc: the doc_id as text; a row without one is a document of its own."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    return docs.select(doc.alias("doc"), F.col(host).alias("host"), F.explode(F.array_distinct(line_keys(F.col("text")))).alias("key"))


def frequent_lines(docs: DataFrame, host: str = "source", least: int = LEAST_DOCS, share: float = HOST_SHARE) -> DataFrame:
    """Rows (host, keys): the lines found in more than `least` and more than `share` of a host's documents, as one array.

    Such lines number less than 1 / share times the lines of the host's average document, so a row is
    small, however large the host.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    size = docs.select(F.col(host).alias("h"), doc.alias("doc")).groupBy("h").agg(F.countDistinct("doc").alias("host_docs"))
    seen = host_lines(docs, host).groupBy("host", "key").agg(F.countDistinct("doc").alias("n")).filter(F.col("n") > least)
    seen = seen.join(size, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > share * F.col("host_docs"))
    return seen.groupBy("host").agg(F.collect_list("key").alias("keys"))


def line_frequency_rules(docs: DataFrame, host: str = "source", least: int = LEAST_DOCS, share: float = HOST_SHARE, left: float = LEFT_SHARE) -> DataFrame:
    """Per row of docs: doc_id, text without the host's frequent lines, the base rules' columns (of the whole text), n_host_words (words in lines taken away) and kept.

    kept is false if base_failed, else whether the words outside frequent lines are at least `left` of
    all. A null host is a host of its own. Rows of one doc_id count as one document of their host, and
    each row is judged by its own lines. Texts without a frequent line, null ones included, stay byte
    for byte. An empty table gives an empty result.
    """
    # a written table has a known size: small ones are broadcast, larger ones joined by shuffle
    often = stored(frequent_lines(docs.select("doc_id", "text", host), host, least, share)).select(F.col("host").alias("lf_host"), "keys")
    rows = docs.select("doc_id", "text", F.col(host).alias("lf_source")).join(often, F.col("lf_source").eqNullSafe(F.col("lf_host")), "left")
    # the few frequent lines that a row has, found by hash; most rows have none and are not looked at line by line
    hit = F.array_intersect(F.when(F.col("keys").isNotNull(), F.array_distinct(line_keys(F.col("text")))), "keys")
    rows = base_rules(rows.withColumn("lf_hit", hit).drop("keys", "lf_host", "lf_source"))
    found = F.size("lf_hit") > 0
    cut = lambda x: F.array_contains(F.col("lf_hit"), F.xxhash64(normal_line(x))) & (F.btrim(x, F.lit(BLANK)) != "")
    parts = F.split("text", "\n")
    gone = F.aggregate(F.filter(parts, cut), F.lit(0), lambda n, x: n + F.size(words_col(x)))
    rows = rows.withColumn("n_host_words", F.when(found, gone).otherwise(0).cast("long"))
    rows = rows.withColumn("text", F.when(found, F.array_join(F.filter(parts, lambda x: ~cut(x)), "\n")).otherwise(F.col("text")))
    enough = F.col("n_words") - F.col("n_host_words") >= F.lit(left) * F.col("n_words")
    return rows.withColumn("kept", ~F.col("base_failed") & enough).drop("lf_hit")
