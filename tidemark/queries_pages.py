"""Registered queries of pages made of whole documents: nested articles, balanced containers, content trees and projection rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.queries import query, unescape_sql
from tidemark.schema import table
from tidemark.sources import texts as X
from tidemark.sources import trees as Y

_CLEAN = lambda x: f"trim(regexp_replace({unescape_sql(f'''regexp_replace({x}, '<[^>]+>', ' ', 'g')''')}, '\\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, 'Title ' || doc_id AS title FROM documents)
SELECT doc_id AS page_id, CASE WHEN doc_id % 4 = 0 THEN 'Page ' || doc_id ELSE title END AS title, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '2024-01-0' || (doc_id % 9 + 1) || 'T00:00:00Z' END AS published,
  md5(CASE WHEN doc_id % 4 = 0 THEN 'about ' || doc_id ELSE left({_CLEAN('t')}, 8000) END) AS body, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'fx|rates|' || doc_id END AS keywords, CASE WHEN doc_id % 4 = 0 THEN 'meta' ELSE 'json-ld' END AS "from" FROM d""")
def src13_nested_articles(spark, sf_dir):
    """Pages whose article lies two levels deep in @graph, its type a list; a quarter has meta tags only."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    article = F.struct(F.array(F.lit("Thing"), F.lit("NewsArticle")).alias("@type"), F.concat(F.lit("Title "), i).alias("headline"), F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("T00:00:00Z")).alias("datePublished"), F.coalesce("text", F.lit("")).alias("articleBody"), F.concat(F.lit("fx, rates; "), i).alias("keywords"))
    site = F.struct(F.lit("WebSite").alias("@type"), F.lit("a site").alias("name"))
    # a graph holds objects of different shapes, so its text is put together
    graph = F.concat(F.lit('{"@graph": ['), F.to_json(site), F.lit(', {"@type": "Page", "@graph": ['), F.to_json(article), F.lit("]}]}"))
    ld = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit('<script type="application/ld+json">'), F.replace(graph, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))).otherwise("")
    html = F.concat(F.lit("<title>Page "), i, F.lit('</title><meta property="og:description" content="about '), i, F.lit('">'), ld)
    got = X.articles(d.select(F.col("doc_id").alias("page_id"), html.alias("html")))
    return got.select("page_id", "title", "published", F.md5(F.col("body").cast("binary")).alias("body"), F.array_join("keywords", "|").alias("keywords"), "from")


_NORM = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) // 2 AS h FROM documents), e AS (SELECT doc_id, left(t, h) AS a, substr(t, h + 1) AS b FROM d),
n AS (SELECT doc_id, {_NORM("a || ' ' || b")} AS whole, {_NORM('b')} AS second, {_NORM("'Menu ' || a || ' ' || b || ' other words'")} AS page FROM e),
r AS (SELECT doc_id AS page_id, CASE WHEN length(whole) >= 200 OR (length(second) >= 40 AND NOT regexp_matches(second, '{Y.FURNITURE}')) THEN whole ELSE left(page, 20000) END AS body FROM n)
SELECT page_id, md5(body) AS body, length(body) < 200 AS short FROM r""")
def src14_balanced(spark, sf_dir):
    """Pages with a document in nested containers, between a menu and other text."""
    t = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit('<div>Menu</div><div class="col-xs-12 col-sm-8 col-md-8"><div><DIV><span>'), safe(F.left(t, half)), F.lit("</span></DIV></div><p>"), safe(F.substring(t, half + 1, F.length(t))), F.lit("</p></div ><div>other<div> words</div></div>"))
    got = Y.page_body(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html")))
    return got.select("page_id", F.md5(F.col("body").cast("binary")).alias("body"), "short")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS o FROM documents),
j AS (SELECT doc_id, string_agg(chr(10) || x || '!', '' ORDER BY o) AS t FROM l GROUP BY doc_id),
s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(t, '&nbsp;', ' '), '[ \\t' || chr(160) || ']+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{2,}', chr(10), 'g') AS t FROM j)
SELECT doc_id, md5(trim(t, ' ' || chr(9) || chr(10) || chr(13))) AS text FROM s""")
def src15_trees(spark, sf_dir):
    """Content trees of documents, a paragraph for each line, within lists and single children."""
    text = lambda x: F.struct(F.lit("text").alias("node"), x.alias("text"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(F.lit("element").alias("node"), F.lit("p").alias("tag"), F.array(F.struct(F.lit("span").alias("tag"), F.array(text(x), text(F.lit("!"))).alias("child"))).alias("child")))
    tree = F.array(F.struct(F.lit("root").alias("node"), F.lit("div").alias("tag"), F.struct(F.lit("section").alias("tag"), F.array(lines).alias("child")).alias("child")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.to_json(tree).alias("body"))
    return X.cms_text(rows).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


def _quarter(k: int) -> str:
    return f"((p_size % 20 + {k}) / 4)"


@query(f"""WITH p AS (SELECT p_partkey AS id, [{', '.join(f'{_quarter(k)}::DOUBLE' for k in range(4))}] AS m FROM part)
SELECT id, CASE WHEN id % 11 <> 0 THEN '2020,2021,2022,longer run' END AS years, CASE WHEN id % 11 <> 0 THEN array_to_string(m, ',') END AS medians, CASE WHEN id % 11 <> 0 THEN CASE WHEN id % 7 = 0 THEN '' ELSE 'June' END END AS label,
  CASE WHEN id % 11 <> 0 THEN CASE WHEN id % 7 = 0 THEN '' ELSE array_to_string([m[1], 50.0::DOUBLE], ',') || ',-,' || (m[4] + 0.5)::VARCHAR END END AS previous FROM p""")
def fn31_projection_rows(spark, sf_dir):
    """Projection tables as text, with footnotes, a blank cell lost from the row before and figures that don't belong to it."""
    k = F.col("p_partkey")
    m = [((F.col("p_size") % 20 + i) / 4) for i in range(4)]
    said = lambda c: F.concat(c.cast("string"), F.lit(" "))
    longer = m[3] + F.when(k % 7 == 0, 2.0).otherwise(0.5)
    row = F.when(k % 11 != 0, F.concat(F.lit("Federal funds rate "), F.when(k % 3 == 0, "4 ").otherwise(""), *map(said, m), F.lit("0.1 0.2 - "))).otherwise("Unemployment 4.1 ")
    text = F.concat(F.lit("Variable Range 1 2020 2021\n 2022 Longer run Change in real GDP 2.1 1.9 "), row, F.lit("June projection "), said(m[0]), F.lit("50.0 "), said(longer), F.when(k % 5 == 0, "99.9 ").otherwise(""), F.lit("end"))
    r = F.col("r")
    numbers = lambda x: F.array_join(F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",")
    # dealt out first: a file of small rows is read by few tasks
    parts = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = parts.select(k.alias("id"), Y.projection_rows(text).alias("r"))
    return got.select("id", F.array_join(r["years"], ",").alias("years"), numbers(r["medians"]).alias("medians"), r["previous_label"].alias("label"), numbers(r["previous"]).alias("previous"))
