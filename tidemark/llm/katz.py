"""Language-model scores by Katz backoff on word bigrams.

P(w|h) = d_c c(h,w) / c(h) for bigrams seen in training, with Good-Turing discounts d_c up to count K,
else alpha(h) P(w), where alpha(h) makes the probabilities of all words and of the unknown word sum to 1
exactly; P(w) is the unigram distribution, discounted the same way, whose freed mass is the unknown
word's. Counts come from all training documents.

Documents are encoded once, in batches of bounded size, against batch-local dictionaries. Word counts
are a table keyed by word; words get global numbers by descending count, so a word's count can be
read from its number with a table of at most sqrt(2N) steps. Bigram counts are a table partitioned
by history (those of very frequent histories by history and word); batches send their distinct
bigrams there and get counts and their histories' statistics back. No step holds more than a batch
or a partition of fixed size in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import ascii_lower, mixed, pack, parts, stored, unpack

K = 5
#: Tokens of a batch, and distinct bigrams of a partition, about.
BATCH, PARTITION = 2_000_000, 2_000_000
#: A history that is split by word has more tokens than this.
LEAST_HOT = 1000
#: Words, by descending count, whose numbers are broadcast (about a megabyte): they stand in every batch's dictionary.
HEAD = 65_536
#: Number of the history before the first token.
START = (1 << 32) - 1


def squeezed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def opened(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=0), kind)


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0..K, given the numbers n[r] of types with count r, r to K + 1; 1 where they don't exist."""
    d = np.ones(K + 1)
    if n[1] > 0:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and common < 1:
                got = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = got if 0 < got <= 1 else 1.0
    return d


class Words:
    """What is global about words: tokens N, words V, and a count and a probability for each number."""

    def __init__(self, steps: list[tuple[int, int]]):
        """steps: (count, number of words with it) for the counts above 0."""
        steps = sorted(steps, reverse=True)
        self.count = np.array([c for c, _ in steps] + [0], np.int64)
        sizes = np.array([n for _, n in steps], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n, self.v = int((self.count[:-1] * sizes).sum()), int(sizes.sum())
        of = np.zeros(K + 2)
        for c, n in steps:
            if c <= K + 1:
                of[c] = n
        mass = discounts(of)[np.minimum(self.count, K)] * self.count
        mass[self.count > K] = self.count[self.count > K]
        left = self.n - (mass[:-1] * sizes).sum()
        total = self.n if left > 1e-9 * max(1, self.n) else self.n + 1
        self.p = mass / total
        self.p[-1] = max(1 - (self.p[:-1] * sizes).sum(), 1e-300)  # the unknown word

    def step(self, number: np.ndarray) -> np.ndarray:
        """Index into count and p; the last one for words that training lacks."""
        return np.searchsorted(self.first, number, "right") - 1


def encoded(docs: DataFrame) -> DataFrame:
    """Rows of at most about BATCH tokens: batch, doc_ids, sizes, train, codes, and the batch's dictionary: keys and training counts."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            at = 0
            texts, train = b.column("text"), b.column("train").to_numpy(zero_copy_only=False).astype(bool)
            while at < len(b):
                words: dict[bytes, int] = {b"": 0}  # no word is empty: the end token
                codes, sizes, began, total = [], [], at, 0
                while at < len(b) and total < BATCH:
                    own = ascii_lower(texts[at].as_py() or "").split()
                    codes.append(np.fromiter([*(words.setdefault(w, len(words)) for w in own), 0], np.int32, len(own) + 1))
                    sizes.append(len(own) + 1)
                    total += len(own) + 1
                    at += 1
                flat, lens, seen = np.concatenate(codes), np.array(sizes, np.int32), train[began:at]
                counts = np.bincount(flat[np.repeat(seen, lens)], minlength=len(words))
                keys = np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
                ids = pa.ListArray.from_arrays(pa.array([0, at - began], pa.int32()), b.column("doc_id").slice(began, at - began))
                planes = flat.view(np.uint8).reshape(-1, 4).T
                blobs = [squeezed(x) for x in (lens, seen, planes, keys, counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *(pa.array([x], pa.binary()) for x in blobs)], ["batch", "doc_ids", "sizes", "train", "codes", "keys", "counts"])
                number += 1

    return docs.select("doc_id", "text", "train").mapInArrow(run, f"batch long, doc_ids array<{kind}>, sizes binary, train binary, codes binary, keys binary, counts binary")


def dictionaries(batches: DataFrame) -> DataFrame:
    """Rows (batch, code, key, n) of the batches' dictionaries; n: count in the batch's training documents."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for number, keys, counts in zip(*(b.column(c).to_pylist() for c in ("batch", "keys", "counts")), strict=True):
                k, n = opened(keys, np.int64), opened(counts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), number)), pa.array(np.arange(len(k), dtype=np.int32)), pa.array(k), pa.array(n)], ["batch", "code", "key", "n"])

    return batches.select("batch", "keys", "counts").mapInArrow(run, "batch long, code int, key long, n long")


def numbered(words: DataFrame) -> DataFrame:
    """Rows (key, c) with `number`, dense from 0 by descending count: places within sorted ranges plus the ranges' starts."""
    n = parts(words.sparkSession)
    ranged = words.repartitionByRange(n, F.col("c").desc(), "key").sortWithinPartitions(F.col("c").desc(), "key")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()))
    # one row for each range
    sizes = {r["part"]: (r["first"], r["count"]) for r in ranged.groupBy("part").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("count")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total - sizes[p][0]))
        total += sizes[p][1]
    if not starts:
        return ranged.select("key", "c", F.lit(0).cast("long").alias("number"))
    shift = words.sparkSession.createDataFrame(starts, "part int, shift long")
    return ranged.join(F.broadcast(shift), "part").select("key", "c", (F.col("nth") + F.col("shift")).alias("number"))


def numbers_of(rows: pa.Table) -> pa.Table:
    """The word numbers of one batch in the order of its codes, as one row."""
    rows = rows.sort_by("code")
    return pa.table({"batch": rows.column("batch").slice(0, 1), "numbers": pa.array([squeezed(rows.column("number").to_numpy().astype(np.uint32))], pa.binary())})


class Bigrams:
    """The distinct bigrams of a batch, ordered by partition and then by key, with each token's place among them."""

    def __init__(self, row: dict, buckets: int, hot: int, hot_start: bool):
        self.sizes, self.train = opened(row["sizes"], np.int32), opened(row["train"], bool)
        planes = opened(row["codes"], np.uint8).reshape(4, -1)
        codes = np.ascontiguousarray(planes.T).view(np.int32).ravel()
        self.words = opened(row["numbers"], np.uint32)[codes]
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.starts] = START
        keys, self.of_token = np.unique((before.astype(np.uint64) << np.uint64(32)) | self.words, return_inverse=True)
        h = keys >> np.uint64(32)
        salted = (h < hot) | ((h == START) & hot_start)
        bucket = (mixed(np.where(salted, keys, h)) % np.uint64(buckets)).astype(np.int32)
        self.order = np.argsort(bucket, kind="stable")
        self.keys, bucket = keys[self.order], bucket[self.order]
        self.used, first = np.unique(bucket, return_index=True)
        self.slices = [slice(a, z) for a, z in zip(first, [*first[1:], len(keys)], strict=True)]


def requests(row: dict, g: Bigrams) -> pa.RecordBatch:
    seen = np.bincount(g.of_token, np.repeat(g.train, g.sizes), len(g.keys)).astype(np.uint32)[g.order]
    n = len(g.used)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, row["batch"])), pa.array(g.used.astype(np.int32)), pa.array([squeezed(np.frombuffer(pack(g.keys[s]), np.uint8)) for s in g.slices], pa.binary()), pa.array([squeezed(seen[s]) for s in g.slices], pa.binary())],
        ["batch", "bucket", "keys", "seen"],
    )


#: Statistics of a history: types with counts 1..K, sum of the larger counts, and sum of the followers' P(w).
STATS = K + 2


def counted(words: Words, hot: int, hot_start: bool):
    """A function of one partition's requests: answers to each batch, and one summary row (batch -1)."""

    def run(rows: pa.Table) -> pa.Table:
        asked = [unpack(opened(x, np.uint8).tobytes()) for x in rows.column("keys").to_pylist()]
        keys, back = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.bincount(back, np.concatenate([opened(x, np.uint32) for x in rows.column("seen").to_pylist()])).astype(np.int64)
        totals = np.bincount(np.minimum(n, K + 2), minlength=K + 3)[: K + 2]
        h, first = np.unique(keys >> np.uint64(32), return_index=True)
        stats = np.empty((STATS, len(h)))
        for r in range(1, K + 1):
            stats[r - 1] = np.add.reduceat(n == r, first, dtype=np.float64)
        stats[K] = np.add.reduceat(np.where(n > K, n, 0), first)
        stats[K + 1] = np.add.reduceat(np.where(n > 0, words.p[words.step((keys & np.uint64(START)).astype(np.int64))], 0), first)
        out, at = [], 0
        for number, own in zip(rows.column("batch").to_pylist(), asked, strict=True):
            part = n[back[at : at + len(own)]]
            at += len(own)
            of = np.searchsorted(h, np.unique(own >> np.uint64(32)))
            out.append((number, squeezed(part.astype(np.uint32)), squeezed(stats[:, of])))
        frequent = np.flatnonzero((h < hot) | ((h == START) & hot_start))
        out.append((-1, squeezed(totals.astype(np.int64)), squeezed(np.vstack([h[frequent].astype(np.float64), stats[:, frequent]]))))
        a, b, c = zip(*out, strict=True)
        bucket = pa.array([rows.column("bucket")[0].as_py()] * len(out), pa.int32())
        return pa.table({"batch": pa.array(a, pa.int64()), "bucket": bucket, "counts": pa.array(b, pa.binary()), "stats": pa.array(c, pa.binary())})

    return run


def backoff(stats: np.ndarray, d: np.ndarray):
    """(count, denominator, log10 alpha) of histories: what discounting frees goes to the words not seen after them."""
    r = np.arange(1, K + 1)[:, None]
    count = (stats[:K] * r).sum(0) + stats[K]
    free = (stats[:K] * r * (1 - d[1:, None])).sum(0)
    none = free <= 1e-9
    total = np.where(none, count + 1, count)
    return count, total, np.log10(np.where(none, 1.0, free) / np.maximum(total, 1) / np.maximum(1 - stats[K + 1], 1e-300))


def scored(words: Words, d: np.ndarray, start_stats: list | None, buckets: int, hot: int, hot_start: bool, names: list[str]):
    """A function of one batch and the answers to it: a row for each document."""

    def own_stats(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Ascending frequent histories of the batch and their whole statistics, of which the partitions hold only parts."""
        rows = opened(blob, np.float64).reshape(-1, STATS + 1) if blob else np.empty((0, STATS + 1))
        if start_stats is not None:
            rows = np.vstack([rows, [float(START), *start_stats]])
        rows = rows[np.argsort(rows[:, 0])]
        return rows[:, 0], rows[:, 1:].T

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: batch.column(c)[0].as_py() for c in ("batch", "sizes", "train", "codes", "numbers", "hot")}
        hot_h, hot_s = own_stats(row["hot"])
        g = Bigrams(row, buckets, hot, hot_start)
        told = {b: (c, s) for b, c, s in zip(*(answers.column(x).to_pylist() for x in ("bucket", "counts", "stats")), strict=True)}
        value = np.empty(len(g.keys))
        step = words.step((g.keys & np.uint64(START)).astype(np.int64))
        log_p = np.log10(words.p)
        for b, s in zip(g.used, g.slices, strict=True):
            n = opened(told[int(b)][0], np.uint32).astype(np.int64)
            h, of = np.unique(g.keys[s] >> np.uint64(32), return_inverse=True)
            stats = opened(told[int(b)][1], np.float64).reshape(STATS, len(h)).copy()
            if len(hot_h):
                at = np.minimum(np.searchsorted(hot_h, h), len(hot_h) - 1)
                found = hot_h[at] == h
                stats[:, found] = hot_s[:, at[found]]
            count, total, alpha = backoff(stats, d)
            seen = np.log10(np.maximum(np.where(n > K, n, d[np.minimum(n, K)] * n), 1e-300) / total[of])
            value[s] = np.where(n > 0, seen, np.where(count[of] > 0, alpha[of], 0.0) + log_p[step[s]])
        per_type = np.empty_like(value)
        per_type[g.order] = value
        of_word = words.step(g.words.astype(np.int64))
        base = np.log10((words.count + 0.5) / (words.n + 0.5 * (words.v + 1)))[of_word]
        sums = [np.add.reduceat(x, g.starts) for x in (words.count[of_word] > 0, base, per_type[g.of_token])]
        ids = batch.column("doc_ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(~g.train), pa.array(g.sizes.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(ids), words.n)), pa.array(sums[1]), pa.array(sums[2])], names)

    return run


def katz_scores(docs: DataFrame, train) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    train: a boolean column, which rows the model learns from (null: not). Texts are in lower case (A-Z
    only) and split at ASCII white space; every document ends in one end token, so null and empty
    texts have one token. Rows of equal doc_id are scored each for itself. Without training rows only
    the unknown word has probability. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    batches = stored(encoded(docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))))
    entries = dictionaries(batches)
    named = stored(numbered(entries.groupBy("key").agg(F.sum("n").alias("c"))))
    # at most sqrt(2N) different counts
    words = Words([tuple(r) for r in named.filter("c > 0").groupBy("c").count().collect()])
    n_train = int(named.filter(F.col("key") == F.lit(np.uint64(xxh3_64_intdigest(b"")).astype(np.int64).item())).agg(F.sum("c")).first()[0] or 0)
    buckets = max(parts(spark), words.n // PARTITION + 1)
    # histories with more than a quarter of a partition's share are split by word
    limit = max(LEAST_HOT, words.n / buckets / 4)
    hot, hot_start = int(words.first[int((words.count > limit).sum())]), n_train > limit
    # the commonest words are joined by broadcast, so that no key's rows of all batches come together
    codes, head = entries.select("batch", "code", "key"), named.filter(F.col("number") < HEAD).select("key", "number")
    tail = named.filter(F.col("number") >= HEAD).select("key", "number")
    mine = codes.join(F.broadcast(head), "key").unionByName(codes.join(F.broadcast(head.select("key")), "key", "left_anti").join(tail, "key"))
    numbers = stored(mine.groupBy("batch").applyInArrow(numbers_of, "batch long, numbers binary"))
    whole = batches.select("batch", "doc_ids", "sizes", "train", "codes").join(numbers.hint("merge"), "batch")

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(len(b))):
                yield requests(row, Bigrams(row, buckets, hot, hot_start))

    asked = whole.select("batch", "sizes", "train", "codes", "numbers").mapInArrow(ask, "batch long, bucket int, keys binary, seen binary")
    told = stored(asked.groupBy("bucket").applyInArrow(counted(words, hot, hot_start), "batch long, bucket int, counts binary, stats binary"))

    def summaries(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for counts, stats in zip(b.column("counts").to_pylist(), b.column("stats").to_pylist(), strict=True):
                totals = opened(counts, np.int64)
                s = opened(stats, np.float64).reshape(STATS + 1, -1).T
                yield pa.RecordBatch.from_arrays([pa.array([-1.0, *s[:, 0]]), pa.array([[*map(float, totals)], *map(list, s[:, 1:])], pa.list_(pa.float64()))], ["h", "s"])

    # whole statistics of the frequent histories: a table, of which each batch gets the rows of its own words
    sums = stored(told.filter("batch = -1").mapInArrow(summaries, "h double, s array<double>").groupBy("h").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(STATS)]).alias("s")))
    apart = {r.h: r.s for r in sums.filter(F.col("h").isin(-1.0, float(START))).collect()}
    d = discounts(np.array([0.0, *apart.get(-1.0, [0.0] * STATS)[1 : K + 2]]))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    run = scored(words, d, apart.get(float(START)), buckets, hot, hot_start, names)

    def held(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for number, blob in zip(*(b.column(c).to_pylist() for c in ("batch", "numbers")), strict=True):
                own = opened(blob, np.uint32)
                own = own[own < hot].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(own)], ["batch", "h"])

    def gathered(rows: pa.Table) -> pa.Table:
        flat = np.column_stack([rows.column("h").to_numpy(), *(rows.column(f"s{i}").to_numpy() for i in range(STATS))])
        return pa.table({"batch": rows.column("batch").slice(0, 1), "hot": pa.array([squeezed(flat)], pa.binary())})

    wide = sums.select("h", *[F.col("s")[i].alias(f"s{i}") for i in range(STATS)])
    stats = numbers.mapInArrow(held, "batch long, h double").join(wide, "h").groupBy("batch").applyInArrow(gathered, "batch long, hot binary")
    answers = told.filter("batch >= 0")
    told_all = whole.join(stats.hint("merge"), "batch", "left")
    return told_all.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
