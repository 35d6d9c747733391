"""The registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import curriculum

    mixed = curriculum(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.array_min(F.transform("mix_copies", lambda c: c["position"]))
    out = mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), first.alias("position"))
    return out.orderBy("position", "doc_id").drop("position")


OP5_SQL = """
WITH s AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
      row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS o FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, o) FROM l WHERE level * w <= cap) * w) AS target FROM l),
d AS (SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS want,
      sum(s.size) OVER (PARTITION BY s.source ORDER BY left(md5(s.doc_id::VARCHAR), 0), ('0x' || left(md5(s.doc_id::VARCHAR), 8))::BIGINT % 1024, md5(s.doc_id::VARCHAR), s.doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS cum
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (want // source_size) * size + greatest(0, least(size, want - (want // source_size) * source_size - cum)) ELSE 0 END)::BIGINT AS taken
FROM d"""


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_frequency import line_frequency_rules

    out = line_frequency_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_host_words", "kept")


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS lines FROM documents),
win AS (SELECT doc_id, i, w[i:i+7] AS k, len(w) AS n FROM d, unnest(range(1, len(w) - 6)) AS t(i) WHERE len(w) > 8),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS r FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, source, regexp_replace(lower(trim(x, {_BLANK})), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS k, len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0B\\f\\r]+'), lambda y: y <> '')) AS c FROM (SELECT doc_id, source, unnest(lines) AS x FROM d)),
f AS (SELECT source, k FROM ln JOIN (SELECT source AS s, count(DISTINCT doc_id) AS hd FROM d GROUP BY source) h ON source IS NOT DISTINCT FROM s GROUP BY source, k, hd HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.02 * hd),
cut AS (SELECT ln.doc_id, sum(c)::BIGINT AS n_host_words FROM ln JOIN f ON ln.k = f.k AND ln.source IS NOT DISTINCT FROM f.source GROUP BY ln.doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(n_host_words, 0)::BIGINT AS n_host_words
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_host_words, NOT base_failed AND n_words - n_host_words >= 0.3 * n_words AS kept FROM g"""


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_spread import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_cut_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS site, text, string_split(text, chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, site, x, trim(x, {_BLANK}) <> '' AS word, regexp_replace(lower(trim(x, {_BLANK})), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS k, o FROM (SELECT doc_id, site, unnest(lines) AS x, unnest(range(1, len(lines) + 1)) AS o FROM d)),
f AS (SELECT k, min(doc_id) AS keeper FROM k WHERE word GROUP BY k HAVING count(DISTINCT site) >= 10),
c AS (SELECT k.doc_id, k.o, k.x, keeper IS NOT NULL AND keeper <> k.doc_id AS cut FROM k LEFT JOIN f ON k.k = f.k AND k.word)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_cut_lines, sha256(CASE WHEN coalesce(n, 0) = 0 THEN text ELSE coalesce(t, '') END) AS text_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE cut) AS n, string_agg(x, chr(10) ORDER BY o) FILTER (WHERE NOT cut) AS t FROM c GROUP BY doc_id) USING (doc_id)"""


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import fold
    from tidemark.llm.quality import fit_quality, score_quality

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), table(spark, sf_dir, "labels")
    blob = fit_quality(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    out = score_quality(docs, blob)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.nearest import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import scratch
    from tidemark.llm.warc import read_archives, write_archives

    path = scratch(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM m"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import fold
    from tidemark.llm.katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.merkle import merkle_proofs

    return merkle_proofs(table(spark, sf_dir, "documents"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_LEFT, _RIGHT = "coalesce(array_to_string(nodes[8 * (c.at // 8) + 1 : c.at], ''), '')", "coalesce(array_to_string(nodes[c.at + 2 : 8 * (c.at // 8) + 8], ''), '')"
_UP = "list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], '')))"
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, text, {" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM documents),
h AS (SELECT doc_id, lang, sha256(head || {_field("text")}) AS leaf,
  sha256(head || {_field("CASE WHEN " + _CRC + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS low FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM h),
tree AS (SELECT lang, 0 AS level, list(leaf ORDER BY p) AS nodes FROM l GROUP BY lang UNION ALL SELECT lang, level + 1, {_UP} FROM tree WHERE len(nodes) > 1),
sub AS (SELECT lang, level AS depth, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM tree WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY g) AS nodes FROM sub UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(nodes) > 1),
climb AS (SELECT lang, doc_id, leaf, p, p AS at, 0 AS level, low AS fold, '' AS sib FROM l UNION ALL
  SELECT c.lang, doc_id, leaf, p, c.at // 8, c.level + 1, sha256({_LEFT} || fold || {_RIGHT}), sib || {_LEFT} || {_RIGHT}
  FROM climb c JOIN tree t ON c.lang IS NOT DISTINCT FROM t.lang AND c.level = t.level WHERE len(nodes) > 1),
high AS (SELECT doc_id, leaf, subroot, g AS at, 0 AS level, fold, sib FROM climb c JOIN sub ON c.lang IS NOT DISTINCT FROM sub.lang AND c.level = depth UNION ALL
  SELECT doc_id, leaf, subroot, c.at // 8, c.level + 1, sha256({_LEFT} || fold || {_RIGHT}), sib || {_LEFT} || {_RIGHT} FROM high c JOIN top t ON c.level = t.level WHERE len(nodes) > 1)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = nodes[1] AS verified FROM high JOIN top ON high.level = top.level WHERE len(nodes) = 1"""


def op12_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vafile import vafile_clusters

    return vafile_clusters(table(spark, sf_dir, "embeddings"))


def _clusters_sql(rounds: int = 3, k: int = 16) -> str:
    """The plain form: every distance of every round."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM v QUALIFY c < {k})"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT key, vec_id, v.q, c, {square} AS d FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, c) = 1)"""
        if r < rounds:
            out += f""",
s{r} AS (SELECT c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT p.c, coalesce(m.q, p.q) AS q FROM c{r} p LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS q FROM s{r} GROUP BY c) m USING (c))"""
    return out + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(p.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} p ON a.c = p.c"""


OP12_SQL = _clusters_sql()


def op13_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.balanced import pack_balanced

    out = pack_balanced(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "piece_cost")


QUERIES = {f.__name__: f for f in (op1_quality, op2_warc, op3_katz, op4_secrets, op5_mixing, op6_jaccard, op7_line_frequency, op8_line_spread, op9_packing, op10_nearest, op11_merkle, op12_vafile, op13_balanced)}
ORACLE = {"op2_warc": OP2_SQL, "op5_mixing": OP5_SQL, "op7_line_frequency": OP7_SQL, "op8_line_spread": OP8_SQL, "op11_merkle": OP11_SQL, "op12_vafile": OP12_SQL}
