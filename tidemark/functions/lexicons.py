"""Many lexicons over whole texts in one pass.

A lexicon is a regular expression, and each of its matches holds one of a few literal strings (of
`\\btighten\\w*` it is `tighten`). One automaton over the literals of all lexicons reads a text once;
only around the places it finds are the expressions themselves run. The counts are those of running
every expression over the whole text, for ASCII word boundaries and cases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def literals(pattern: str) -> tuple[list[str], int]:
    """Strings in lower case of which every match holds one, and how far a match can reach beyond runs of word characters.

    Of parts that follow each other the one with the longest shortest string is taken; alternatives need
    one string each. Unbounded runs may only come after the literals, and consist of word characters. An
    expression with a match that holds no such literal is a ValueError.
    """

    def better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
        key = lambda x: (min(map(len, x)), -len(x)) if x else (0, 0)
        return max(a, b, key=key)

    def of(nodes) -> tuple[list[str] | None, int, bool]:
        best, run, reach, endless = None, "", 0, False

        def take(found: list[str] | None) -> None:
            nonlocal best
            best = best if endless else better(best, found)

        for op, arg in nodes:
            if op is C.LITERAL:
                run, reach = run + chr(arg).lower(), reach + 1
                continue
            take([run] if run else None)
            run = ""
            if op is C.BRANCH:
                each = [of(x) for x in arg[1]]
                take(None if any(x[0] is None for x in each) else [s for x in each for s in x[0]])
                reach, endless = reach + max(x[1] for x in each), endless or any(x[2] for x in each)
            elif op is C.SUBPATTERN:
                found, n, open_ = of(arg[3])
                take(found)
                reach, endless = reach + n, endless or open_
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                found, n, open_ = of(arg[2])
                take(found if arg[0] else None)
                reach, endless = reach + n * (1 if arg[1] is C.MAXREPEAT else arg[1]), endless or open_ or arg[1] is C.MAXREPEAT
            elif op is not C.AT:
                reach += 1
        take([run] if run else None)
        return best, reach, endless

    found, reach, _ = of(parser.parse(pattern))
    if not found:
        raise ValueError(f"no literal in every match of {pattern}")
    return sorted(set(found)), reach


@lru_cache(maxsize=8)
def automaton(patterns: tuple[str, ...]):
    import ahocorasick

    which: dict[str, set[int]] = {}
    reaches = []
    for i, p in enumerate(patterns):
        strings, reach = literals(p)
        reaches.append(reach)
        for s in strings:
            which.setdefault(s, set()).add(i)
    out = ahocorasick.Automaton()
    for s, owners in which.items():
        out.add_word(s, (len(s), tuple(owners)))
    out.make_automaton()
    return out, [re.compile(p, re.ASCII) for p in patterns], reaches


_WORD = re.compile(r"\w*", re.ASCII)


def counted(text: str, patterns: tuple[str, ...]) -> list[int]:
    """How often each expression matches a text."""
    machine, compiled, reaches = automaton(patterns)
    places: dict[int, list[tuple[int, int]]] = {}
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so places stay
    for end, (n, owners) in machine.iter(low):
        for i in owners:
            places.setdefault(i, []).append((end + 1 - n, end + 1))
    out = [0] * len(patterns)
    for i, found in places.items():
        spans: list[list[int]] = []
        for start, end in sorted(found):
            a, b = max(0, start - reaches[i]), min(len(text), end + reaches[i])
            if not spans or a > spans[-1][1]:
                spans.append([a, _WORD.match(text, b).end()])  # a word that runs on belongs to the window
            elif b > spans[-1][1]:
                spans[-1][1] = _WORD.match(text, b).end()
        out[i] = sum(1 for a, b in spans for _ in compiled[i].finditer(text, a, b))
    return out


def lexicon_counts(text: Column, lexicons: Mapping[str, str]) -> Column:
    """A struct with the number of matches of each lexicon in a text, by name; a null text has none."""
    patterns = tuple(lexicons.values())
    none = [0] * len(patterns)

    @F.arrow_udf("array<int>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:  # a text at a time, so a worker holds the batch itself and one text
            yield pa.array((counted(t, patterns) if t else none for t in (x.as_py() for x in batch)), pa.list_(pa.int32()))

    got = counts(F.coalesce(text, F.lit("")))
    return F.struct(*[F.get(got, F.lit(i)).alias(n) for i, n in enumerate(lexicons)])


def first_named(counts: Column, names: list[tuple[str, object]], otherwise) -> Column:
    """The name of the first lexicon, in the order of (lexicon, name), that was found."""
    out = None
    for lexicon, name in names:
        out = F.when(counts[lexicon] > 0, F.lit(name)) if out is None else out.when(counts[lexicon] > 0, F.lit(name))
    return out.otherwise(F.lit(otherwise))


#: The lexicons of the text rules, by name; tables of (name, pattern) as their prefix and place.
TABLES = {"currency": T.CURRENCIES, "category": T.CATEGORIES, "kind": T.KINDS, "channel": T.CHANNELS, "level": T.INTERVENTION, "topic": T.TOPICS}
RULES = {"hawks": T.HAWKISH, "doves": T.DOVISH, "up": T.HAWKISH_WIRE, "down": T.DOVISH_WIRE, "not_fx": T.NOT_FX, "bearish": T.BEARISH_TITLE, "bullish": T.BULLISH_TITLE}
RULES |= {f"{table}_{i}": pattern for table, rows in TABLES.items() for i, (_, pattern) in enumerate(rows)}


def text_rules(rows: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """rows with every rule's answer for a text column, all from one pass.

    hawks, doves, stance, strength, direction, currency, category, kind, channel, level, about_fx, side
    and topic, as the functions of the same names in tidemark.functions.text give them.
    """
    c = F.col("_counts")
    names = lambda table: [(f"{table}_{i}", name) for i, (name, _) in enumerate(TABLES[table])]
    h, d, up, down = c["hawks"], c["doves"], c["up"], c["down"]
    best = F.greatest(*[F.struct(c[k].alias("n"), F.lit(name).alias("t")) for k, name in names("topic")])
    out = {
        "hawks": h, "doves": d, "stance": F.when(h == d, "neutral").when(h > d, "hawkish").otherwise("dovish"), "strength": F.when(h == d, 0.0).otherwise(F.abs(h - d) / (h + d)),
        "direction": F.when(up == down, "none").when(up > down, "stronger").otherwise("weaker"),
        "currency": first_named(c, names("currency"), "none"), "category": first_named(c, names("category"), "other"), "kind": first_named(c, names("kind"), "other"),
        "channel": first_named(c, names("channel"), "nothing_surprising"), "level": first_named(c, names("level"), 0.0).cast("double"),
        "about_fx": (c["not_fx"] == 0) & (first_named(c, names("currency"), "none") != "none"),
        "side": F.when(c["bearish"] > 0, -1).when(c["bullish"] > 0, 1).otherwise(0), "topic": F.when(best["n"] > 0, best["t"]).otherwise("other"),
    }
    return rows.withColumn("_counts", lexicon_counts(F.col(text), RULES)).select(*rows.columns, *[x.alias(prefix + k) for k, x in out.items()])
