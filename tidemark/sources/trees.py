"""JSON trees and nested tags of web pages: walked level by level over all rows at once, and matched by running depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let, running
from tidemark.functions.times import moment
from tidemark.schema import stored

# Tags that begin a line of a content tree, containers of a page's text, and furniture.
BLOCK_TAGS = ("p", "li", "br", "h1", "h2", "h3", "h4", "tr", "div", "td", "th")
CONTAINERS = (("div", r'(?i)<div\s+class="col-xs-12 col-sm-8 col-md-8"\s*>'), ("div", r'(?i)<div\s+[^>]*\bclass="[^"]*\bcol-md-8\b[^"]*"[^>]*>'), ("div", r'(?i)<div\s+[^>]*\bid="(?:content|article|leftText)"[^>]*>'))
LAST_UPDATE = r'(?i)<div\s+class="col-xs-12 col-sm-8 col-md-8 last-update"'
FURNITURE = r"(?i)cookie|javascript|enable js|skip to (main )?content|newsletter|subscribe|follow us|all rights reserved|search term|privacy (policy|notice)|accessibility|sitemap|^share$|^menu$|browser"
TAILS = ("Implementation Note issued", "For media inquiries")
LEAST_BODY, LEAST_PARAGRAPH, MOST_PLAIN = 200, 40, 20_000


def walked(trees: DataFrame, down: str, lists_only: bool = False) -> DataFrame:
    """The object nodes of trees (id, v: variant) as rows (id, hops, path, v).

    Lists give their elements, and an object what it holds at `down` (only if that is a list, with
    lists_only). path is the place in the tree, so that sorting by it is reading order; hops counts the
    objects above. A level of all trees is one step, so the number of steps is the deepest tree's depth.
    """
    level, out = trees.select("id", F.lit(0).alias("hops"), F.array().cast("array<int>").alias("path"), "v"), []
    while True:
        first = F.try_variant_get("v", "$[0]", "variant")
        level = stored(level.filter("v IS NOT NULL").withColumn("_list", first.isNotNull()).withColumn("_object", F.try_variant_get("v", "$", "map<string,variant>").isNotNull()).filter("_list OR _object"))
        if not level.take(1):
            break
        objects, lists = level.filter("_object").drop("_list", "_object"), level.filter("_list")
        out.append(objects)
        inside = level.sparkSession.sql("SELECT f.id, f.hops, concat(f.path, array(t.pos)) AS path, t.value AS v FROM {lists} f, LATERAL variant_explode(f.v) t", lists=lists)
        below = objects.select("id", (F.col("hops") + 1).alias("hops"), F.concat("path", F.array(F.lit(0))).alias("path"), F.try_variant_get("v", down, "variant").alias("v"))
        if lists_only:
            below = below.filter(F.try_variant_get("v", "$[0]", "variant").isNotNull())
        level = inside.unionByName(below)
    return reduce(DataFrame.unionByName, out) if out else trees.select("id", F.lit(0).alias("hops"), F.array().cast("array<int>").alias("path"), "v").limit(0)


#: Levels of a tree that one step takes apart.
LEVELS = 12


def told(rows: DataFrame, name: str = "text") -> DataFrame:
    """rows (v: variant, ...) without v, with the column `name`: a content tree's text nodes in reading order, a new line before each block tag, blanks and empty lines squeezed.

    A tree stays one row: each node of its list is replaced, where it stands, by its own piece of text and what it
    holds, so the list stays in reading order. Twelve levels of all trees are one step, and only deeper trees go into a
    further one; every step's rows are stored. Null where v is, and '' where no node says anything.
    """
    kept, n = [c for c in rows.columns if c != "v"], F.col("_n")
    node = lambda p, v: F.struct(p.alias("p"), v.alias("v"))

    def inside(v: Column) -> Column:
        said = F.when(F.try_variant_get(v, "$.node", "string") == "text", F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))).otherwise("")
        piece = F.concat(said, F.when(F.coalesce(F.try_variant_get(v, "$.tag", "string").isin(*BLOCK_TAGS), F.lit(False)), "\n").otherwise(""))
        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: node(F.lit(""), e))
        return F.coalesce(listed, F.array(node(piece, F.lit(None).cast("variant")), node(F.lit(""), F.try_variant_get(v, "$.child", "variant"))))

    def expanded(nodes: Column) -> Column:
        below = F.flatten(F.transform(nodes, lambda x: F.when(x["v"].isNull(), F.array(x)).otherwise(inside(x["v"]))))
        return F.filter(below, lambda x: (x["p"] != "") | x["v"].isNotNull())

    flat = F.regexp_replace(F.regexp_replace(F.replace(F.array_join(F.transform(n, lambda x: x["p"]), ""), F.lit("&nbsp;"), F.lit(" ")), "[ \\t\u00a0]+", " "), " *\n *", "\n")
    text = F.btrim(F.regexp_replace(flat, "\n{2,}", "\n"), F.lit(" \n\t\r"))
    open_ = F.coalesce(F.exists(n, lambda x: x["v"].isNotNull()), F.lit(False))
    level, out = rows.select(*kept, F.when(F.col("v").isNotNull(), F.array(node(F.lit(""), F.col("v")))).alias("_n")), []
    while True:
        level = level.select(*kept, reduce(lambda x, _: expanded(x), range(LEVELS), n).alias("_n"))
        level = stored(level.select(*kept, F.when(~open_, text).alias(name), F.when(open_, n).alias("_n")))
        out.append(level.filter("_n IS NULL").drop("_n"))
        level = level.filter("_n IS NOT NULL")
        if not level.take(1):
            return reduce(DataFrame.unionByName, out)


def _cleaned(v: Column, key: str) -> Column:
    """A value of an object as one line of text: a string, a list's strings, or a named thing's name; '' for none."""
    one = F.try_variant_get(v, f"$['{key}']", "string")
    several = F.array_join(F.try_variant_get(v, f"$['{key}']", "array<string>"), " ")
    name = F.coalesce(F.try_variant_get(v, f"$['{key}'].name", "string"), F.try_variant_get(v, f"$['{key}']['@value']", "string"))
    thing = F.try_variant_get(v, f"$['{key}']", "map<string,variant>").isNotNull()
    from tidemark.sources.texts import unescaped

    text = F.when(thing, name).otherwise(F.coalesce(several, one))
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)<[^>]+>", " ")), r"\s+", " "))


def linked_articles(pages: DataFrame, limit: int = 8000) -> DataFrame:
    """Rows (page_id, title, published, body, keywords, section) of the pages that carry an article as JSON-LD, at any depth of @graph.

    Of several the first in the order of blocks, then of the levels of @graph. One without a title and a
    readable date is passed over.
    """
    ld = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), 1)
    blocks = pages.select("page_id", F.posexplode(ld).alias("block", "json"))
    trees = blocks.select(F.struct("page_id", "block").alias("id"), F.try_parse_json(F.trim("json")).alias("v"))
    v = F.col("v")
    kinds = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    title = F.when(_cleaned(v, "headline") != "", _cleaned(v, "headline")).otherwise(_cleaned(v, "alternativeHeadline"))
    body = F.when(_cleaned(v, "articleBody") != "", _cleaned(v, "articleBody")).otherwise(_cleaned(v, "text"))
    section = F.when(_cleaned(v, "articleSection") != "", _cleaned(v, "articleSection")).otherwise(_cleaned(v, "genre"))
    words = F.coalesce(F.try_variant_get(v, "$.keywords", "array<string>"), F.split(F.coalesce(F.try_variant_get(v, "$.keywords", "string"), F.lit("")), "[,;|]"))
    keywords = F.filter(F.transform(words, lambda x: F.trim(x)), lambda w: w != "")
    published = F.try_variant_get(v, "$.datePublished", "string")
    rows = walked(trees, "$['@graph']", lists_only=True).filter(F.exists(kinds, lambda k: F.coalesce(F.endswith(k, F.lit("Article")), F.lit(False))))
    fields = rows.select("id", "hops", "path", title.alias("title"), published.alias("published"), F.substring(body, 1, limit).alias("body"), keywords.alias("keywords"), section.alias("section")).filter((F.col("title") != "") | moment(F.col("published"), "UTC").isNotNull())
    first = F.min_by(F.struct("title", "published", "body", "keywords", "section"), F.struct("id.block", "hops", "path"))
    return fields.groupBy("id.page_id").agg(first.alias("a")).select("page_id", "a.*")


def balanced(html: Column, tag: str, opening: str) -> Column:
    """What stands between the first match of an opening tag and the tag that closes it; to the end if none does, null without an opening.

    Depth is a running sum over the tags behind the opening; its first return to zero is the end.
    """
    edge = rf"(?i)<{tag}\b[^>]*>|</{tag}\s*>"
    start = F.regexp_instr(html, F.lit(opening)) + F.length(F.regexp_extract(html, opening, 0))
    rest = F.substring(html, start, F.length(html))

    def closed(r: Column) -> Column:
        tags, between = F.regexp_extract_all(r, F.lit(edge), 0), F.split(r, edge, -1)
        steps = F.transform(tags, lambda t: F.when(F.startswith(t, F.lit("</")), -1).otherwise(1))
        place = F.zip_with(between, F.concat(F.array(F.lit("")), tags), lambda x, y: F.length(x) + F.length(y))
        end = F.array_position(running(steps), F.lit(-1)).cast("int")  # the opening itself is depth one
        return let(end, lambda e: F.when(e > 0, F.substring(r, F.lit(1), F.get(running(place), e - 1))).otherwise(r))

    return F.when(F.regexp_like(html, F.lit(opening)), let(rest, closed))


def page_body(pages: DataFrame, containers=CONTAINERS, tails: tuple[str, ...] = TAILS) -> DataFrame:
    """Per page: page_id, body and `short` (under 200 characters).

    The first container whose balanced inside has 200 characters of text or more; else the longest of the
    containers, what stands before the last-update line, and the page's paragraphs of 40 characters or
    more without furniture (without any, the whole page's first 20,000). Tail markers cut what follows.
    """
    from tidemark.sources.texts import plain_text

    html = F.col("_h")

    def trimmed(text: Column) -> Column:
        cut = lambda t: lambda x: F.when(F.locate(t, x) > 1, F.substring_index(x, t, 1)).otherwise(x)
        for t in tails:
            text = let(text, cut(t))
        return F.trim(text)

    rows = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).alias("_h"))
    # each is looked for only in pages that the ones before don't settle
    found, wanted = [f"_c{i}" for i in range(len(containers))], F.lit(True)
    for name, (tag, opening) in zip(found, containers, strict=True):
        rows = rows.withColumn(name, F.when(wanted, trimmed(plain_text(balanced(html, tag, opening)))))
        wanted = wanted & (F.coalesce(F.length(name), F.lit(0)) < LEAST_BODY)
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    paragraphs = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), plain_text), lambda s: (F.length(s) >= LEAST_PARAGRAPH) & ~F.regexp_like(s, F.lit(FURNITURE)))
    last = F.when(wanted & F.regexp_like(html, F.lit(LAST_UPDATE)), trimmed(plain_text(F.substring(html, F.lit(1), F.regexp_instr(html, F.lit(LAST_UPDATE)) - 1))))
    rows = rows.withColumn("_last", last).withColumn("_p", F.when(wanted, paragraphs))
    rows = rows.withColumn("_all", F.when(wanted & (F.size("_p") == 0), F.substring(plain_text(html), 1, MOST_PLAIN)))
    generic = trimmed(F.when(F.size("_p") > 0, F.array_join("_p", " ")).otherwise(F.col("_all")))
    every = [*found, "_last"]
    enough = [F.when(F.length(n) >= LEAST_BODY, F.col(n)) for n in found]
    # the longest, of equals the first
    choices = F.array(*[F.struct(F.length(F.coalesce(c, F.lit(""))).alias("n"), F.lit(-i).alias("i"), F.coalesce(c, F.lit("")).alias("t")) for i, c in enumerate([*map(F.col, every), generic])])
    body = F.coalesce(*enough, F.array_max(choices)["t"])
    return rows.select("page_id", body.alias("body")).withColumn("short", F.length("body") < LEAST_BODY)


# The rows of a projection table as running text.
_DECIMAL = r"(?:\d+(?:\.\d+)?|\.\d+)"
SEP_YEARS = r"(?i)Range\s*\d?\s*(?:Variable\s*)?((?:\d{4}\s+){2,6})Longer run"
SEP_RATE = rf"Federal funds rate\s+((?:{_DECIMAL}\s+){{1,12}})"
SEP_PREVIOUS = rf"([A-Z][a-z]+)\s+projection\s+((?:{_DECIMAL}\s+){{1,12}})"
LONGER_RUN_TOLERANCE, SEARCHED = 0.75, 400


def projection_rows(text: Column) -> Column:
    """Struct (years, medians, previous_label, previous) of a projection table's text; null without year heads or a median row.

    A footnote's digit before a row with more values than columns is dropped. The row of the projection
    before has no cell for the newest year, and blank cells are lost in text: the longest reading of it
    whose last value, the longer run, is near this table's is taken, short ones filled from both ends.
    """
    return let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), _projection)


def _projection(flat: Column) -> Column:
    words = lambda s: F.filter(F.split(F.trim(s), " "), lambda w: w != "")

    def numbers(tokens: Column, columns: Column) -> Column:
        lead = F.array_position(F.transform(tokens, lambda t: ~F.regexp_like(t, F.lit("^[1-9]$"))), F.lit(True)).cast("int")
        notes = F.when(lead > 0, lead - 1).otherwise(F.size(tokens))
        drop = F.least(notes, F.greatest(F.size(tokens) - columns, F.lit(0)))
        return F.transform(F.slice(tokens, drop + 1, F.greatest(F.size(tokens) - drop, F.lit(0))), lambda t: t.cast("double"))

    # every expression is matched once: in a struct that the next one reads
    seen = F.struct(F.regexp_extract(flat, SEP_YEARS, 1).alias("heads"), F.regexp_extract(flat, SEP_RATE, 1).alias("row"), F.regexp_extract(flat, SEP_RATE, 0).alias("whole"), F.regexp_instr(flat, F.lit(SEP_RATE)).alias("at"))

    def told_before(x: Column) -> Column:
        tail = F.substring(flat, x["at"] + F.length(x["whole"]) - 1, F.lit(SEARCHED + 1))
        return let(tail, lambda t: F.struct(F.regexp_extract(t, SEP_PREVIOUS, 1).alias("label"), words(F.regexp_extract(t, SEP_PREVIOUS, 2)).alias("before"), F.concat(words(x["heads"]), F.array(F.lit("longer run"))).alias("years"), words(x["row"]).alias("row")))

    def rows(x: Column) -> Column:
        n = F.size(x["years"])
        parts = F.struct(x["years"].alias("years"), numbers(x["row"], n).alias("medians"), x["label"].alias("label"), numbers(x["before"], n).alias("before"))

        def aligned(y: Column) -> Column:
            n, values = F.size(y["years"]), y["before"]
            longer = F.get(y["medians"], n - 1)
            takes = F.when(F.size(values) >= 2, F.reverse(F.sequence(F.lit(2), F.least(F.size(values), n)))).otherwise(F.array().cast("array<int>"))
            fits = F.filter(takes, lambda k: F.abs(F.get(values, k - 1) - longer) <= LONGER_RUN_TOLERANCE)
            take = F.get(fits, F.lit(0))
            filled = F.concat(F.slice(values, F.lit(1), take - 1), F.array_repeat(F.lit(None).cast("double"), n - take), F.array(F.get(values, take - 1)))
            previous = F.when(take.isNotNull(), filled)
            return F.when(F.size(y["medians"]) >= n, F.struct(y["years"].alias("years"), F.slice(y["medians"], F.lit(1), n).alias("medians"), F.when(previous.isNotNull(), y["label"]).otherwise("").alias("previous_label"), F.coalesce(previous, F.array().cast("array<double>")).alias("previous")))

        return let(parts, aligned)

    return let(seen, lambda x: F.when((x["heads"] != "") & (x["row"] != ""), let(told_before(x), rows)))
