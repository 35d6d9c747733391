"""Secret scan: fixed patterns, and a character convolutional network over further candidates.

Every whole text is searched for the base patterns and for candidate tokens. Base findings are the
labelled positives and the other candidates the negatives of a small network in numpy (character
embedding, one convolution, max and mean pooling, logistic output), which sees a long candidate in
overlapping windows, the highest score counting. Its threshold is the largest that keeps the wanted
recall on all positives held out. Candidates above it are added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# The base patterns, in the order in which their kinds are listed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "network")
#: A candidate: a token of the secrets' alphabet, or what stands behind a key word's separator.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
KEY_WORDS = ("key", "pwd", "pass", "auth", "bearer", "credential", "private")
KEY_WORD = re.compile("|".join(KEY_WORDS), re.ASCII | re.IGNORECASE)
KEY_TAIL = re.compile("[a-z_]*", re.ASCII)
KEY_VALUE = re.compile(r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{8,})", re.ASCII)

LEFT, INSIDE, RIGHT = 16, 48, 8
WIDTH = LEFT + INSIDE + RIGHT
#: Windows of a long candidate start STEP characters apart.
STEP = INSIDE // 2
#: Bounds of the fitted sample (views of either label, smallest hashes first), and the recall to keep.
SAMPLE, RECALL = 4000, 0.99
DIM, FILTERS, KERNEL = 8, 24, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings by start, then kind; code points, end exclusive."""
    out = []
    # the access and hex patterns match maximal runs, so a least length in the pattern drops just the
    # failing matches; an assignment that fails still uses up its text and is dropped afterwards
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def window(text: str, start: int, end: int) -> str:
    """What the network sees of a candidate of at most INSIDE characters: LEFT before, all of it and RIGHT after, padded with NUL."""
    inside = text[start : min(end, start + INSIDE)]
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + inside.ljust(INSIDE, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0")


def windows(text: str, start: int, end: int) -> list[str]:
    """The views that cover a candidate of any length: each of INSIDE characters at most, the last one at its end."""
    starts = [*range(start, max(start, end - INSIDE), STEP), max(start, end - INSIDE)]
    return [window(text, s, min(end, s + INSIDE)) for s in starts]


def bare(view: str) -> str:
    """A view without what stands around the candidate."""
    return "\0" * LEFT + view[LEFT : LEFT + INSIDE] + "\0" * RIGHT


def keyed(text: str) -> list[tuple[int, int]]:
    """Spans of the values behind key words: a key word, lower-case letters that run on, a separator, the value.

    All key words of one run share its end, so where no value follows it, the search goes on near that
    end: each run is read once, however many key words it holds.
    """
    out, at, longest = [], 0, max(map(len, KEY_WORDS))
    while word := KEY_WORD.search(text, at):
        end = KEY_TAIL.match(text, word.end()).end()
        value = KEY_VALUE.match(text, end)
        if value:
            out.append(value.span(1))
            at = value.end()
        else:  # a key word that begins in the run may still reach beyond it
            at = max(word.start() + 1, end - longest + 1)
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind of the base pattern that found it or -1) of every candidate, base findings first; no two of the others overlap a finding."""
    # of an assignment the network judges the value; the key word is context
    out = [(ASSIGN.match(text, s).start(2) if k == 0 else s, e, k) for s, k, e in base]
    starts, ends = [], []  # the findings' union, as ascending spans apart from each other
    for s, _, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    spans = {(m.start(), m.end()) for m in TOKEN.finditer(text)}
    spans |= set(keyed(text))
    last, at = -1, 0
    for s, e in sorted(spans):
        while at < len(ends) and ends[at] <= s:
            at += 1
        if s >= last and not (at < len(ends) and starts[at] < e):
            out.append((s, e, -1))
            last = e
    return out


def findings(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base, candidates) for each row of docs; null texts as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, base, cands = np.zeros((3, len(b)), np.int64), [], []
            for i, text in enumerate(b.column("text")):
                text = text.as_py() or ""
                spans = base_spans(text)
                for _, kind, _ in spans:
                    n[kind, i] += 1
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                cands.append([{"start": s, "end": e, "kind": k, "views": windows(text, s, e)} for s, e, k in candidates(text, spans)])
            span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
            cand = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("views", pa.list_(pa.string()))])
            arrays = [b.column("doc_id"), *(pa.array(x) for x in n), pa.array(base, pa.list_(span)), pa.array(cands, pa.list_(cand))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base", "candidates"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base array<struct<start:long,kind:int,end:long>>, candidates array<struct<start:long,end:long,kind:int,views:array<string>>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encoded(views: list[str]) -> np.ndarray:
    """Character classes, one row of WIDTH for each view: ASCII as it is, everything else as one class."""
    raw = np.array([list(map(ord, v)) for v in views], np.int64).reshape(len(views), WIDTH)
    return np.where(raw < 127, raw, 127)


class Network:
    """Embedding, convolution, max and mean pooling, logistic output; Adam on the logistic loss."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.3, (128, DIM)), rng.normal(0, 0.2, (KERNEL * (DIM + 1), FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0

    def forward(self, c: np.ndarray):
        table, conv, bias, out, b = self.p
        inside = np.zeros((*c.shape, 1))
        inside[:, LEFT : LEFT + INSIDE] = 1
        x = np.concatenate([table[c], inside], 2)
        steps = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(c), WIDTH - KERNEL + 1, -1)
        h = np.maximum(steps @ conv + bias, 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return steps, h, top, pooled, pooled @ out + b[0]

    def margins(self, views: list[str]) -> np.ndarray:
        return np.concatenate([np.empty(0), *(self.forward(encoded(views[k : k + 512]))[4] for k in range(0, len(views), 512))])

    def scores(self, candidates: list[list[str]]) -> np.ndarray:
        """The probability of each candidate, given its views: the highest, rounded, so that batches don't matter."""
        if not candidates:
            return np.empty(0)
        starts = np.cumsum([0, *(len(v) for v in candidates[:-1])])
        return np.round(self.probability(np.maximum.reduceat(self.margins([v for views in candidates for v in views]), starts)), 9)

    def fit(self, views: list[str], y: np.ndarray, steps: int = 600, rate: float = 3e-3, batch: int = 128, seed: int = 9) -> None:
        rng, c = np.random.default_rng(seed), encoded(views)
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y != 1).sum())) * len(y)
        for _ in range(-(-steps * batch // len(y))):
            order = rng.permutation(len(y))
            for part in np.array_split(order, max(1, len(order) // batch)):
                codes = c[part]
                steps, h, top, pooled, z = self.forward(codes)
                d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) * weight[part] / len(part)
                dp = d[:, None] * self.p[3]
                dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
                np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :FILTERS], 1)
                dh *= h > 0
                dsteps = (dh @ self.p[1].T).reshape(len(part), -1, KERNEL, DIM + 1)[..., :DIM]
                dtable = np.zeros_like(self.p[0])
                for k in range(KERNEL):
                    np.add.at(dtable, codes[:, k : k + h.shape[1]], dsteps[:, :, k])
                grads = [dtable, steps.reshape(-1, steps.shape[2]).T @ dh.reshape(-1, FILTERS), dh.sum((0, 1)), pooled.T @ d, d.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, views: list[str], y: np.ndarray, recall: float) -> None:
        """Platt scaling on these findings, then the largest threshold that keeps `recall` of the positives."""
        z = self.margins(views)
        a, b = 1.0, 0.0
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            a, b = a - 0.05 * ((p - y) * z).mean(), b - 0.2 * (p - y).mean()
        self.scale, self.shift = max(a, 1e-3), b
        own = np.sort(self.probability(z[y == 1]))
        self.threshold = float(own[int((1 - recall) * len(own))]) if len(own) else 1.0

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))


def smallest(values: DataFrame, k: int, n: int, accuracy: int = 10_000) -> float:
    """The k-th smallest (from 0) of the n values z, exactly: an approximate quantile on either side, then counts between them."""
    near = [min(1.0, max(0.0, k / n + d / accuracy)) for d in (-2, 2)]
    low, high = values.agg(F.percentile_approx("z", near, accuracy).alias("q")).first().q
    at = values.filter(F.col("z") < low).count()
    for r in values.filter(F.col("z").between(low, high)).groupBy("z").count().orderBy("z").collect():
        at += r["count"]
        if at > k:
            return r.z
    return high


def fit_network(found: DataFrame, sample: int = SAMPLE, recall: float = RECALL, kinds: tuple[int, ...] = (0, 1, 2)) -> Network | None:
    """A network fitted on at most `sample` views of each label; None without both labels.

    Findings of `kinds` are the positives; those of other kinds are left out, so that what the network
    makes of a kind it never saw can be measured (kind_recall).

    A quarter of the candidates, by hash, is held out, and with them every view they have. A bounded
    sample of their views scales the output; all positives among them, with and without their
    surroundings, set the threshold. Where no
    positive is held out, or none is left to learn from, all serve for both.
    """
    every = found.select(F.explode("candidates").alias("c")).filter(F.col("c.kind").isin(-1, *kinds)).select("c.views", (F.col("c.kind") >= 0).alias("found"))
    every = every.withColumn("held", F.pmod(F.xxhash64(F.get("views", F.lit(0))), F.lit(4)) == 0)
    views = every.select(F.explode("views").alias("view"), "found", "held").groupBy("view").agg(F.max("found").alias("found"), F.max("held").alias("held"))
    views = stored(views.withColumn("h", F.xxhash64("view")))
    part = {(y, h): views.filter((F.col("found") == y) & (F.col("held") == h)).orderBy("h", "view").limit(sample).collect() for y in (True, False) for h in (True, False)}
    whole = not all(part[True, h] for h in (True, False))
    learn, check = ([r for y in (True, False) for h in ((True, False) if whole else (own,)) for r in part[y, h]] for own in (False, True))
    y = np.array([r.found for r in learn], np.float64)
    if not 0 < y.sum() < len(y):
        return None
    # every view is learned with and without its surroundings, else the key words of the patterns would decide alone
    net = Network()
    net.fit([v for r in learn for v in (r.view, bare(r.view))], np.repeat(y, 2))
    net.calibrate([v for r in check for v in (r.view, bare(r.view))], np.repeat(np.array([r.found for r in check], np.float64), 2), recall)
    shared = found.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views = b.column("views").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.scores([*views, *([bare(v) for v in own] for own in views)]))], ["z"])

    positives = every.filter("found") if whole else every.filter("found AND held")
    values = stored(positives.select("views").mapInArrow(run, "z double"))
    n = values.count()
    net.threshold = smallest(values, int((1 - recall) * n), n)
    return net


def kind_recall(docs: DataFrame, kind: int, sample: int = SAMPLE, recall: float = RECALL) -> tuple[int, int]:
    """(findings of a base pattern, how many of them a network finds that learned from the other patterns only)."""
    found = stored(findings(docs))
    net = fit_network(found, sample, recall, tuple(k for k in (0, 1, 2) if k != kind))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            views = b.column("views").to_pylist()
            hit = net.scores(views) >= net.threshold if net is not None else np.zeros(len(views), bool)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.bool_())], ["hit"])

    own = found.select(F.explode("candidates").alias("c")).filter(F.col("c.kind") == kind).select("c.views").mapInArrow(run, "hit boolean")
    got = own.agg(F.count(F.lit(1)), F.count_if("hit")).first()
    return got[0], got[1]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(docs: DataFrame, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (`kind:start:end`, by start and kind), n_network.

    Null texts count as empty ones; a text without findings has spans ''. Without findings of both
    labels to learn from, the network adds none. Columns of docs other than doc_id and text are not used.
    """
    found = stored(findings(docs))
    net = fit_network(found, sample, recall)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            base = [[(x["start"], x["kind"], x["end"]) for x in row] for row in b.column("base").to_pylist()]
            more = [(i, x) for i, row in enumerate(b.column("candidates").to_pylist()) for x in row if x["kind"] < 0]
            added: list[list] = [[] for _ in base]
            if net is not None and more:
                for (i, x), p in zip(more, net.scores([x["views"] for _, x in more]), strict=True):
                    if p >= net.threshold:
                        added[i].append((x["start"], 3, x["end"]))
            digest = [hashlib.sha256(shown(s).encode()).hexdigest() for s in base]
            spans = [shown(s + a) for s, a in zip(base, added, strict=True)]
            arrays = [*(b.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")), pa.array(digest), pa.array(spans), pa.array([len(a) for a in added], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network"])

    kind = dict(docs.dtypes)["doc_id"]
    return found.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long")
