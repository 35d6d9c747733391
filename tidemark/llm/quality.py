"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part is computed in time
linear in the features as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import stored

BITS, FACTORS = 15, 8
#: Bound of the sample of labelled documents that is fitted, and how it is dealt out and repeated.
SAMPLE, SHARDS, ROUNDS, EPOCHS = 8192, 6, 3, 3
STATS = ("words", "word_length", "upper", "digit", "symbol", "stop", "distinct", "top_word", "lines", "repeated_lines", "bang", "bar", "n_chars")
WORDS = 1 << BITS
_UPPER, _DIGIT, _SYMBOL = (bytes(sorted(set(range(256)) - set(x))) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>"))


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words as normalised log counts at 0..WORDS-1, then the STATS and the bias' neighbours."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    top = max(seen.values(), default=0)
    stats = np.array(
        [
            np.log1p(n) / 6, (len(raw) - raw.count(b" ")) / max(1, n) / 10, len(raw.translate(None, _UPPER)) / size * 4,
            len(raw.translate(None, _DIGIT)) / size * 4, len(raw.translate(None, _SYMBOL)) / size * 10, raw.count(b".") / max(1, n) * 3,
            len(seen) / max(1, n), top / max(1, n), np.log1p(len(lines)) / 3, 1 - len(set(lines)) / max(1, len(lines)),
            raw.count(b"!") / max(1, n), raw.count(b"|") / max(1, n), np.log1p(max(0.0, n_chars) if n_chars is not None and n_chars == n_chars else 0.0) / 8,
        ]
    )
    at = np.fromiter((zlib.crc32(w) & (WORDS - 1) for w in seen), np.int64, len(seen))
    tf = np.log1p(np.fromiter(seen.values(), np.float64, len(seen)))
    norm = np.sqrt((tf * tf).sum())
    return np.concatenate([at, WORDS + np.arange(len(STATS))]), np.concatenate([tf / norm if norm else tf, stats])


class Machine:
    """The weights, and the scores and gradients of batches of sparse rows."""

    def __init__(self, factors: int = FACTORS, seed: int = 7, blob: bytes | None = None):
        n = WORDS + len(STATS)
        if blob is None:
            self.w, self.bias = np.zeros(n), np.zeros(1)
            self.v = np.random.default_rng(seed).normal(0, 0.05, (n, factors))
        else:
            flat = np.frombuffer(blob, np.float32).astype(np.float64)
            self.bias, self.w, self.v = flat[:1].copy(), flat[1 : n + 1].copy(), flat[n + 1 :].reshape(n, -1).copy()

    def blob(self) -> bytes:
        return np.concatenate([self.bias, self.w, self.v.ravel()]).astype(np.float32).tobytes()

    def margins(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray):
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return self.bias[0] + np.add.reduceat(self.w[at] * x, starts) + pairs, sums, vx

    def scores(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(at, x, starts)[0], -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, rate: float = 0.1, l2: float = 1e-5, seed: int = 0, batch: int = 128) -> None:
        """Adagrad on the logistic loss, the two labels weighed evenly."""
        g_w, g_v, g_b = np.full(self.w.shape, 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y != 1).sum())) * len(y)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                at, x, starts = joined([rows[i] for i in part])
                margin, sums, vx = self.margins(at, x, starts)
                d = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[part]) * weight[part] / len(part)
                dx = np.repeat(d, np.diff(np.append(starts, len(at)))) * x
                own = np.repeat(sums, np.diff(np.append(starts, len(at))), axis=0)
                used, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, dx, len(used)) + l2 * self.w[used]
                dv = np.stack([np.bincount(back, dx * (own[:, f] - vx[:, f]), len(used)) for f in range(self.v.shape[1])], 1) + l2 * self.v[used]
                g_w[used] += dw * dw
                g_v[used] += dv * dv
                g_b += d.sum() ** 2
                self.w[used] -= rate * dw / np.sqrt(g_w[used])
                self.v[used] -= rate * 0.5 * dv / np.sqrt(g_v[used])
                self.bias -= rate * d.sum() / np.sqrt(g_b)


def joined(rows: list[tuple[np.ndarray, np.ndarray]]):
    """Rows one after another: indices, values and where each row starts."""
    lens = np.fromiter((len(a) for a, _ in rows), np.int64, len(rows))
    return np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(lens) - lens


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, rounds: int = ROUNDS, epochs: int = EPOCHS) -> bytes:
    """Weights fitted on at most `sample` labelled documents, those with the smallest hash of their id.

    labels: rows (doc_id, quality); null labels and labels other than 0 and 1 are left out, of repeated
    labels the smallest counts. The sample is dealt to `shards` tasks that train side by side; their
    weights are averaged after every round (a shard's weights are of fixed size). Without labelled
    documents the weights are zero and every score is 0.5.
    """
    few = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("fm_y"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    # at most `sample` small rows, so sending them to every task is bounded
    rows = docs.select("doc_id", "text", n_chars.alias("n_chars")).join(F.broadcast(few), "doc_id")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [features(t, c) for t, c in zip(b["text"], b["n_chars"], strict=True)]
            yield pd.DataFrame({"shard": b["shard"], "y": b["fm_y"], "h": b["h"], "t": b["t"], "at": [a.astype(np.int32).tobytes() for a, _ in got], "x": [x.astype(np.float32).tobytes() for _, x in got]})

    h = F.xxhash64("doc_id", F.lit(1))
    rows = rows.select("text", "n_chars", "fm_y", h.alias("h"), F.xxhash64("text", "n_chars").alias("t"), F.pmod(h, F.lit(shards)).alias("shard"))
    rows = stored(rows.mapInPandas(extract, "shard long, y int, h long, t long, at binary, x binary"))
    blob = Machine().blob()

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "t"], kind="stable")  # rows of one id in the order of their texts, so that reruns agree
        data = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)) for a, x in zip(group["at"], group["x"], strict=True)]
        m = Machine(blob=blob)
        # small shards go round more often, for some thirty steps at least
        m.fit(data, group["y"].to_numpy(np.float64), max(epochs, -(-30 // -(-len(group) // 128))))
        return pd.DataFrame({"n": [len(group)], "blob": [m.blob()]})

    for _ in range(rounds):
        got = rows.groupBy("shard").applyInPandas(train, "n long, blob binary").collect()
        if got:
            total = sum(r.n for r in got)
            blob = sum(np.frombuffer(r.blob, np.float32).astype(np.float64) * (r.n / total) for r in sorted(got, key=lambda r: bytes(r.blob))).astype(np.float32).tobytes()
        else:
            blob = np.zeros(len(blob) // 4, np.float32).tobytes()
    return blob


def score_quality(docs: DataFrame, blob: bytes, column: str = "score") -> DataFrame:
    """docs with `column`, the score 0..1 of each whole text; nulls and empty texts have scores too."""
    weights = docs.sparkSession.sparkContext.broadcast(blob)
    given = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(blob=weights.value)
        for b in batches:
            texts = b.column("text")
            sizes = b.column("n_chars").cast(pa.float64()).to_pylist() if "n_chars" in b.schema.names else [None] * len(b)
            out = np.empty(len(b))
            for k in range(0, len(b), 256):
                rows = [features(t, c) for t, c in zip(texts.slice(k, 256).to_pylist(), sizes[k : k + 256], strict=True)]
                out[k : k + 256] = m.scores(*joined(rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, column])

    return given.mapInArrow(run, StructType([*given.schema.fields, StructField(column, DoubleType())]))
