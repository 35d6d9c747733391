"""A Merkle manifest of a table of documents, and the climb that proves every row against its root.

Leaves ascend by doc_id within a language, eight consecutive nodes make their parent, and the
languages' roots make the table's root in the same way. Each built level is a stored table of node
rows that name their parent, so a recursive query can climb from the leaves: each step joins the
parent, appends the siblings to its left and right, and folds the leaf's hash with them.

A node's id is its level and the rank of its first leaf, so parents' ids follow from ranks by
arithmetic, before any hash is known. The leaves of one run climb together in one row: from the
second level on they have the same siblings.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

FANOUT, TOP = 8, 40
#: Nodes of the upper levels that are broadcast: their number is counted, a node takes some 400 bytes.
BROADCAST_NODES = 8192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as a leaf hashes it: '-' for null, else its UTF-8 bytes' number, ':' and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def digest(*texts: Column) -> Column:
    """sha256 of the texts joined, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*texts), 256))


def hexed(hashes: Column) -> Column:
    """Hashes that stand one behind the other, as lower-case hexadecimal text."""
    return F.lower(F.hex(hashes))


def node_id(level: Column | int, first: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(level.cast("long"), 50) + first


def leaf_rows(docs: DataFrame) -> DataFrame:
    """Rows (lang, doc_id, leaf, folded): the leaf's hash as stored, and as the tampered copy has it.

    Tampered are rows where 3 divides the crc32 of the doc_id's decimals (none without an id): A-Z of
    their text in lower case, null texts as they are.
    """
    parts = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = digest(*parts, field(F.col("text")))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = digest(*parts, field(F.translate("text", UPPER, LOWER)))
    return docs.select("lang", "doc_id", leaf.alias("leaf"), F.when(tampered, changed).alias("folded")).withColumn("folded", F.coalesce("folded", "leaf"))


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with g, start, n and p; a row for each language: g, start, n).

    g is the language's number, start the rank of its first leaf, n its leaves, p the leaf's place in
    it. Leaves are range-sorted once; places are those within a written part and the sizes of the
    parts before it. The windows run over a row for each part and language.
    """
    # a hash of the row's place spreads repeated rows, which are interchangeable, over the ranges
    order = ["lang", "doc_id", "leaf", "_salt"]
    rows = leaves.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.select("lang", "doc_id", "leaf", "folded", F.monotonically_increasing_id().alias("_at"))).withColumn("_part", F.shiftright("_at", 33))
    segments = stored(rows.groupBy("_part", "lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low")))
    languages = segments.groupBy("lang").agg(F.sum("_n").alias("n"))
    ordered = Window.orderBy("lang")
    languages = stored(languages.select("lang", "n", (F.row_number().over(ordered) - 1).cast("long").alias("g"), (F.sum("n").over(ordered) - F.col("n")).alias("start")))
    own = Window.partitionBy("lang").orderBy("_part")
    base = segments.select("_part", F.col("lang").alias("_lang"), "_low", (F.sum("_n").over(own) - F.col("_n")).alias("_base"))
    named = languages.select(F.col("lang").alias("_l"), "g", "start", "n")
    base = base.join(named, F.col("_lang").eqNullSafe(F.col("_l"))).withColumnRenamed("_part", "_p").drop("_l")
    joined = rows.join(base, (F.col("_part") == F.col("_p")) & F.col("lang").eqNullSafe(F.col("_lang")))
    return joined.select("g", "start", "n", (F.col("_at") - F.col("_low") + F.col("_base")).alias("p"), "doc_id", "leaf", "folded"), languages


def linked(base: int, level: int, languages: int) -> list[Column]:
    """parent and pos of the node (start, n, i, g: one of n at its level of its tree); what remains of a language hangs below the top tree.

    base: what is added to the tree's levels to number them, 0 or TOP.
    """
    many, i = F.col("n") > 1, F.col("i")
    inner = node_id(base + level + 1, F.col("start") + F.floor(i / FANOUT) * FANOUT ** (level + 1))
    top = node_id(TOP + 1, F.floor(F.col("g") / FANOUT) * FANOUT) if languages > 1 else F.lit(None).cast("long")
    return [F.when(many, inner).otherwise(top).alias("parent"), F.when(many, i % FANOUT).otherwise(F.col("g") % FANOUT).cast("int").alias("pos")]


def runs_of(leaves: DataFrame, languages: int) -> DataFrame:
    """The runs of leaves, stored: parent, pos, hash, g, start, n (runs of the language), i, leaves (doc_id, leaf, folded by place)."""
    i = F.floor(F.col("p") / FANOUT)
    got = leaves.groupBy("g", "start", F.col("n").alias("_n"), i.alias("i")).agg(F.sort_array(F.collect_list(F.struct((F.col("p") % FANOUT).alias("at"), "doc_id", "leaf", "folded"))).alias("_l"))
    own = F.transform("_l", lambda x: hexed(x["leaf"]))
    # a leaf alone in its language is what remains of it: no hash above it
    alone = F.col("_n") == 1
    folds = F.transform("_l", lambda x, k: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), F.when(alone, x["folded"]).otherwise(digest(F.array_join(F.transform(own, lambda y, j: F.when(j == k, hexed(x["folded"])).otherwise(y)), ""))).alias("folded")))
    got = got.withColumn("n", F.ceil(F.col("_n") / FANOUT))
    value = F.when(alone, F.col("_l")[0]["leaf"]).otherwise(digest(F.array_join(own, "")))
    return stored(got.select(*linked(0, 1, languages), value.alias("hash"), "g", "start", "n", "i", folds.alias("leaves")))


def level_above(below: DataFrame, level: int, languages: int, base: int = 0) -> DataFrame:
    """The nodes of a level, stored, from those below: id, parent, pos, hash, children (their hashes joined), g, start, n, i."""
    got = below.filter("n > 1").groupBy("g", "start", F.ceil(F.col("n") / FANOUT).alias("n"), F.floor(F.col("i") / FANOUT).alias("i")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("_c"))
    children = F.unhex(F.array_join(F.transform("_c", lambda x: hexed(x["hash"])), ""))
    own = node_id(base + level, F.col("start") + F.col("i") * FANOUT**level)
    return stored(got.select(own.alias("id"), *linked(base, level, languages), digest(hexed(children)).alias("hash"), children.alias("children"), "g", "start", "n", "i"))


@contextmanager
def climbing(spark: SparkSession) -> Iterator[None]:
    """The settings of a climb: no limit on a recursion's rows (meant for recursions that don't end; ours end at the root), and as many parts as a shuffle has.

    A recursion's result gets the parts of its last step, which is empty: left to be put together, that
    would bring all rows into a few tasks.
    """
    own = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: One step up: the siblings to the left and right of a node come from its parent's row.
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT parent, pos, hash, subroot, leaves, siblings FROM {start}
  UNION ALL
  SELECT n.parent, n.pos, n.hash, CASE WHEN c.subroot IS NULL AND (n.parent IS NULL OR n.parent >= {top}) THEN n.hash ELSE c.subroot END,
    transform(c.leaves, x -> named_struct('doc_id', x.doc_id, 'leaf', x.leaf, 'folded', unhex(sha2(concat(
      lower(hex(substring(n.children, 1, 32 * c.pos))), lower(hex(x.folded)), lower(hex(substring(n.children, 32 * c.pos + 33)))), 256)))),
    concat(c.siblings, substring(n.children, 1, 32 * c.pos), substring(n.children, 32 * c.pos + 33))
  FROM climb c JOIN {nodes} n ON c.parent = n.id
)
SELECT * FROM climb WHERE parent IS NULL OR parent >= {cut}"""


def climbed(start: DataFrame, nodes: DataFrame, cut: int) -> DataFrame:
    """The rows of start where they leave the given nodes, stored: at the root, or below a node of id `cut` or more."""
    spark = start.sparkSession
    with climbing(spark):
        return stored(spark.sql(CLIMB, start=start, nodes=nodes.select("id", "parent", "pos", "hash", "children"), cut=cut, top=(TOP + 1) << 50))


def merkle_proofs(docs: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof_sha256 (of the untampered table), folded_root, verified.

    docs: doc_id, source, lang, n_chars, text; nulls in any of them hash as '-', a null language is
    one of its own and comes first, other columns are not used. Rows of one doc_id are leaves each,
    ordered by their hash; equal rows are interchangeable. A table of one row is its own root, with an
    empty proof; an empty table gives no rows. folded_root is the root that the climb reaches from the
    tampered leaf and the original siblings; only a row whose bytes didn't change is verified.

    Lower levels are joined by shuffle. A parent in the upper levels is shared by many rows, so these
    levels, at most `broadcast_nodes` nodes by count, are climbed in a second recursion by broadcast.
    """
    leaves, languages = placed(leaf_rows(docs.select("doc_id", "source", "lang", "n_chars", "text")))
    n_languages, most = languages.agg(F.count(F.lit(1)), F.max("n")).first()
    depth = 1
    while FANOUT**depth < (most or 0):
        depth += 1
    levels = {1: runs_of(leaves, n_languages)}
    for level in range(2, depth + 1):
        levels[level] = level_above(levels[level - 1], level, n_languages)
    if n_languages > 1:  # the languages' roots are the leaves of the top tree
        roots = reduce(DataFrame.unionByName, [x.filter("n = 1").select("g", "hash") for x in levels.values()])
        zero = F.lit(0).cast("long")
        below = roots.select(zero.alias("start"), F.lit(n_languages).cast("long").alias("n"), F.col("g").alias("i"), (F.col("g") % FANOUT).cast("int").alias("pos"), "hash", zero.alias("g"))
        level, left = 0, n_languages
        while left > 1:
            level, left = level + 1, -(-left // FANOUT)
            below = levels[TOP + level] = level_above(below, level, 1, TOP)
    inner = {k: x for k, x in levels.items() if k > 1}
    cut, total = max(inner, default=0) + 1, 0
    for k in sorted(inner, reverse=True):
        total += inner[k].count()
        if total > broadcast_nodes:
            break
        cut = k
    under_top = F.col("parent").isNull() | (F.col("parent") >= (TOP + 1) << 50)
    rows = levels[1].select("parent", "pos", "hash", F.when(under_top, F.col("hash")).alias("subroot"), "leaves", F.lit("").cast("binary").alias("siblings"))
    for part, end, small in (([k for k in inner if k < cut], cut, False), ([k for k in inner if k >= cut], 2 * TOP, True)):
        if part:
            nodes = reduce(DataFrame.unionByName, [inner[k] for k in part])
            rows = climbed(rows, F.broadcast(nodes) if small else nodes, end << 50)
    each = rows.select(F.posexplode("leaves").alias("at", "x"), "leaves", "hash", "subroot", "siblings")
    own = F.array_join(F.transform(F.filter("leaves", lambda x, k: k != F.col("at")), lambda x: hexed(x["leaf"])), "")
    root, folded = hexed(F.col("hash")), hexed(F.col("x.folded"))
    proof = F.sha2(F.concat(own, hexed(F.col("siblings"))), 256)
    return each.select("x.doc_id", hexed(F.col("x.leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))
