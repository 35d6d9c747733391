"""Crawl permissions of many hosts: robots texts as rules, and which rule decides each page.

A rule can fit a path only if the path starts with the rule's literal part, what stands before its first
wildcard. So paths and rules meet on equal (host, literal): each path gives its prefixes of the lengths
that some rule has, and wildcards are tested only on the pairs that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robots_rules(robots: DataFrame) -> DataFrame:
    """Rules (host, agent, allow, pattern) of robots texts (host, text), agents in lower case.

    User-agent lines that follow each other share the lines after them; comments, blanks and other
    directives count for nothing; an empty Disallow allows everything, so it gives no rule but ends a
    list of agents. A pattern named twice is one rule.
    """
    lines = robots.select("host", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("at", "line"))
    bare = F.btrim(F.regexp_extract("line", "^([^#]*)", 1), F.lit(" \t﻿"))
    part = lambda k: F.btrim(F.regexp_extract("bare", "^([^:]*):(.*)$", k), F.lit(" \t"))
    fields = lines.withColumn("bare", bare).filter(F.col("bare").contains(":")).select("host", "at", F.lower(part(1)).alias("field"), part(2).alias("value")).filter(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("at")  # the lines of one text
    agent = F.col("field") == "user-agent"
    opens = agent & F.coalesce(F.lag("field").over(w) != "user-agent", F.lit(True))
    grouped = fields.withColumn("_opens", opens.cast("int")).withColumn("_group", F.sum("_opens").over(w))
    names = grouped.filter(agent).select("host", "_group", F.lower("value").alias("agent")).distinct()
    rules = grouped.filter(~agent & (F.col("value") != "")).select("host", "_group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return names.join(rules, ["host", "_group"]).select("host", "agent", "allow", "pattern").distinct()


def _parsed(rules: DataFrame) -> DataFrame:
    """rules with `literal`, the part before the first wildcard, and `expr`, a regular expression where more than the literal must be tested."""
    ends = F.col("pattern").endswith("$")
    body = F.when(ends, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(F.col("pattern"))
    literal = F.split("_body", r"\*", 2)[0]
    quoted = F.regexp_replace(F.regexp_replace("_body", r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return rules.withColumn("_body", body).withColumn("literal", literal).withColumn("expr", F.when(ends | F.col("_body").contains("*"), F.concat(F.lit("^"), quoted, F.when(ends, "$").otherwise("")))).drop("_body")


def permitted(pages: DataFrame, rules: DataFrame, host: Column, path: Column, agents: tuple[str, ...] | None = None, salts: int = 16) -> DataFrame:
    """pages with allowed, blocked_by (agent) and rule (pattern).

    Of an agent's rules that fit a path the longest pattern wins, and Allow wins a tie; every agent must
    permit. agents: whose rules count, in that order (each that has any, by name, if none are given); the
    first that forbids is named. Patterns start at the path's start, * is any run, a last $ the end.
    Pages without host or path are allowed. Rules are repeated `salts` times, so that a host with most of
    the pages and a rule for all of its paths spreads.
    """
    # by place: matching of no more than the distinct lengths of literals, which no pattern's length exceeds
    known = _parsed(rules.filter(F.col("pattern") != "").withColumn("agent", F.lower("agent")))
    if agents is not None:
        known = known.filter(F.col("agent").isin(*[a.lower() for a in agents]))
    lengths = sorted(r[0] for r in known.select(F.length("literal")).distinct().collect())
    salt = F.pmod(F.xxhash64("_path"), F.lit(salts)).cast("int")
    paths = pages.select(host.alias("_host"), path.alias("_path")).filter("_host IS NOT NULL AND _path IS NOT NULL").distinct().withColumn("_salt", salt)
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_path"))
    heads = paths.select("_host", "_path", "_salt", F.explode(F.transform(fits, lambda n: F.left(F.col("_path"), n))).alias("_head"))
    spread = known.select(F.col("host").alias("_h"), F.col("literal").alias("_l"), "agent", "allow", "pattern", "expr", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    met = heads.join(spread, (F.col("_host") == F.col("_h")) & (F.col("_head") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
    hits = met.filter(F.col("expr").isNull() | F.expr("_path RLIKE expr"))
    each = hits.groupBy("_host", "_path", "agent").agg(F.max_by(F.struct("allow", "pattern"), F.struct(F.length("pattern"), "allow", "pattern")).alias("_v"))
    place = F.array_position(F.array(*[F.lit(a.lower()) for a in agents]), F.col("agent")) if agents is not None else F.lit(0)
    first = F.min(F.when(~F.col("_v.allow"), F.struct(place.alias("p"), "agent", F.col("_v.pattern").alias("pattern"))))
    found = each.groupBy("_host", "_path").agg(first.alias("_b")).filter("_b IS NOT NULL")
    own = pages.withColumn("_ph", host).withColumn("_pp", path)
    out = own.join(found, (F.col("_ph") == F.col("_host")) & (F.col("_pp") == F.col("_path")), "left")
    return out.select(*pages.columns, F.col("_b").isNull().alias("allowed"), F.col("_b.agent").alias("blocked_by"), F.col("_b.pattern").alias("rule"))
