"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner
product is the smallest Euclidean distance, and are rotated at random. A query visits the lists whose
centres are nearest to it, as many as calibration against brute force asks for. A scan of a list sums
distances over column blocks; after each block a hypothesis test compares the partial distance, scaled
by the share of dimensions seen, with the k-th best so far, and abandons vectors that can hardly be
among the nearest. Survivors are ranked by exact inner products of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: The index is fitted on a sample of at most SAMPLE vectors (smallest hashes of the id), SAMPLE_A_LIST for each list; all vectors are indexed.
SAMPLE, SAMPLE_A_LIST = 32_768, 8
#: Lists: LISTS_A_ROOT times the root of the number of vectors, at most as many as the sample can fit; beyond that lists grow and are split over parts.
LISTS_A_ROOT = 4.0
#: Queries whose neighbours are found by brute force to learn how many lists must be visited, and the share of neighbours to find there.
CALIBRATION, RECALL = 128, 0.93
BLOCK, EPSILON = 16, 1.0
#: Rows whose distances to all centres stand in memory at once, and pairs that a batch holds before those beyond the bound go.
SLICE, PAIRS = 1024, 1_000_000
#: Vectors and queries that one task holds, about, and queries that it scans for at once.
CHUNK, QUERIES, BATCH = 8192, 65_536, 512


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding array<double>): ids and vectors that are not null, finite and not zero; of a repeated id the least vector."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).groupBy("vec_id").agg(F.min(x).alias("embedding"))


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]


def lifted(x: np.ndarray, norm: float, turn: np.ndarray, query: bool = False) -> np.ndarray:
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, norm * norm - (x * x).sum(1)))
    return np.column_stack([x, more]) @ turn


def centroids(x: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means on the sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        size, own = (c * c).sum(1), np.empty(len(x), np.int64)
        for a in range(0, len(x), SLICE):
            own[a : a + SLICE] = (size - 2 * (x[a : a + SLICE] @ c.T)).argmin(1)
        order = np.argsort(own, kind="stable")
        used, starts = np.unique(own[order], return_index=True)
        c[used] = np.add.reduceat(x[order], starts) / np.diff(np.append(starts, len(x)))[:, None]
    return c


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A column of arrays of equal length as one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dims)


def scan(rows: np.ndarray, q: np.ndarray, limit: np.ndarray, block: int = BLOCK, epsilon: float = EPSILON) -> np.ndarray:
    """Squared distances (queries by rows) of one list; infinite for rows that the tests abandon.

    limit: the k-th best distance of each query so far. Distances grow block by block for all queries of
    a batch at once; when few pairs are left, only these are carried on.
    """
    dims = rows.shape[1]
    more = slack(limit)
    pairs, part = None, np.zeros((len(q), len(rows)))
    for start in range(0, dims, block):
        r, x, seen = rows[:, start : start + block], q[:, start : start + block], min(start + block, dims)
        if pairs is None:
            part += (x * x).sum(1)[:, None] + (r * r).sum(1) - 2 * (x @ r.T)
        else:
            part += ((r[pairs[1]] - x[pairs[0]]) ** 2).sum(1)
        test = (1 + epsilon / np.sqrt(seen)) ** 2 if seen < dims else 1.0
        bound = limit * (seen / dims) * test + more
        if pairs is None:
            alive = part <= bound[:, None]
            if alive.mean() < 0.1:
                pairs = np.nonzero(alive)
                part = part[pairs]
        else:
            alive = part <= bound[pairs[0]]
            pairs, part = (pairs[0][alive], pairs[1][alive]), part[alive]
    if pairs is None:
        return np.where(alive, part, np.inf)
    out = np.full((len(q), len(rows)), np.inf)
    out[pairs] = part
    return out


def slack(bound: np.ndarray) -> np.ndarray:
    """What rounding may add to a distance."""
    return 1e-9 * (1 + np.minimum(bound, 1e300))


class Best:
    """Of each query of a batch, the rows whose distances are within rounding of its k-th smallest; ties stay, whatever their number."""

    def __init__(self, queries: int, k: int):
        self.least = np.full((queries, k), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def bound(self, who: np.ndarray) -> np.ndarray:
        return self.least[who].max(1)

    def add(self, who: np.ndarray, far: np.ndarray, first: int) -> None:
        """Distances of queries to the rows from place `first` on; infinite ones are none."""
        k = self.least.shape[1]
        self.least[who] = np.partition(np.concatenate([self.least[who], far], axis=1), k - 1, axis=1)[:, :k]
        bound = self.bound(who)
        i, c = np.nonzero((far <= (bound + slack(bound))[:, None]) & np.isfinite(far))
        self.found.append((who[i], first + c, far[i, c]))
        self.n += len(i)
        if self.n > PAIRS:
            self.pairs()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all that are still within the bound."""
        i, j, far = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *self.found, strict=True))
        bound = self.least.max(1)
        keep = far <= (bound + slack(bound))[i]
        self.found = [(i[keep], j[keep], far[keep])]
        self.n = int(keep.sum())
        return self.found[0][:2]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, sample: int = SAMPLE, lists_a_root: float = LISTS_A_ROOT, chunk: int = CHUNK, epsilon: float = EPSILON, calibration: int = CALIBRATION) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the k candidates found with the largest inner products.

    vectors and queries: rows (vec_id, embedding). A query's own id is no candidate. Nearest first,
    ties to the smaller vec_id; fewer candidates than k give them all. Vectors of different dimensions
    have no inner product: a query's candidates are those of its own. No usable vectors: no rows.

    Queries visit as many lists as hold `recall` of the neighbours of `calibration` queries (1.0: all
    lists). Lists are put together, or split by hash, into parts of about `chunk` vectors, and a query
    is sent once to each part in which it visits a list; equal vectors in any number spread over parts.
    """
    base, asked = stored(usable(vectors)), stored(usable(queries))
    out = None
    # one round for each dimension in use
    for dims in sorted(r.d for r in base.select(F.size("embedding").alias("d")).distinct().collect()):
        own = [df.filter(F.size("embedding") == dims) for df in (base, asked)]
        got = searched(*own, dims, k, recall, sample, lists_a_root, chunk, epsilon, calibration)
        out = got if out is None else out.unionByName(got)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def searched(base: DataFrame, asked: DataFrame, dims: int, k: int, recall: float, sample: int, lists_a_root: float, chunk: int, epsilon: float, calibration: int) -> DataFrame:
    """nearest() among usable vectors of one dimension."""
    spark = base.sparkSession
    size = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    n, norm = base.agg(F.count(F.lit(1)), F.sqrt(F.max(size))).first()
    wanted = int(max(1, min(lists_a_root * np.sqrt(n) // 1, n // 4, sample // SAMPLE_A_LIST)))
    hashed = F.xxhash64("vec_id")
    picked = base.orderBy(hashed, "vec_id").limit(min(sample, SAMPLE_A_LIST * wanted)).select("embedding").collect()
    turn = rotation(dims + 1)
    center = centroids(lifted(np.array([r[0] for r in picked]), norm, turn), wanted)
    # lists in the order of a few coarse groups, so that lists near each other share parts
    coarse = centroids(center, max(1, len(center) // 16))
    order = np.lexsort((np.arange(len(center)), ((coarse * coarse).sum(1) - 2 * (center @ coarse.T)).argmin(1)))
    center = center[order]
    shared = spark.sparkContext.broadcast((turn, center, norm))

    def distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
        return (center * center).sum(1) - 2 * (x @ center.T)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, center, norm = shared.value
        for b in batches:
            x = lifted(matrix(b.column("embedding"), dims), norm, turn)
            near = np.concatenate([np.empty(0, np.int64), *(distances(x[a : a + SLICE], center).argmin(1) for a in range(0, len(x), SLICE))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], ["vec_id", "embedding", "list"])

    listed = stored(base.mapInArrow(assign, "vec_id long, embedding array<double>, list int"))
    visits = len(center)
    if recall < 1 and len(center) > 1:
        tried = asked.orderBy(hashed, "vec_id").limit(calibration).collect()
        visits = visited(listed, tried, dims, k, recall, turn, center, norm) if tried else visits
    # one row for each list
    count = np.zeros(len(center), np.int64)
    for r in listed.groupBy("list").count().collect():
        count[r["list"]] = r["count"]
    pieces = np.maximum(1, -(-count // chunk))
    part_of, filled, parts = np.zeros(len(center), np.int64), chunk, -1
    for i, c in enumerate(count):
        if pieces[i] > 1 or filled + c > chunk:
            parts, filled = parts + 1, 0
        part_of[i] = parts
        if pieces[i] > 1:
            parts, filled = parts + pieces[i] - 1, chunk
        filled += c
    layout = spark.sparkContext.broadcast((part_of, pieces))
    rounds = max(1, -(-asked.count() // QUERIES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of, pieces = layout.value
        for b in batches:
            own = b.column("list").to_numpy()
            part = part_of[own] + b.column("h").to_numpy() % pieces[own]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "embedding", "list")), pa.array(part)], ["vec_id", "embedding", "list", "part"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, center, norm = shared.value
        part_of, pieces = layout.value
        for b in batches:
            for begin in range(0, len(b), 256):
                few = b.slice(begin, 256)
                far = distances(lifted(matrix(few.column("embedding"), dims), norm, turn, True), center)
                near = np.argpartition(far, visits - 1, axis=1)[:, :visits] if visits < len(center) else np.broadcast_to(np.arange(len(center)), far.shape)
                row, part, own = [], [], []
                for i in range(len(few)):
                    lists = np.sort(near[i])
                    last = part_of[lists] + pieces[lists] - 1
                    at = np.repeat(np.arange(len(lists)), pieces[lists])
                    to = np.concatenate([np.arange(a, z + 1) for a, z in zip(part_of[lists], last, strict=True)]) if (pieces[lists] > 1).any() else part_of[lists]
                    used, first = np.unique(to, return_index=True)
                    ends = [*first[1:], len(to)]
                    row += [i] * len(used)
                    part += used.tolist()
                    own += [lists[at[a:z]].astype(np.int32).tobytes() for a, z in zip(first, ends, strict=True)]
                of = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([few.column("vec_id").take(of), few.column("embedding").take(of), pa.array(own, pa.binary()), pa.array(part, pa.int64())], ["vec_id", "embedding", "lists", "part"])

    placed = listed.select("vec_id", "embedding", "list", F.pmod(hashed, F.lit(1 << 31)).alias("h")).mapInArrow(place, "vec_id long, embedding array<double>, list int, part long")
    placed = placed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    sent = asked.mapInArrow(send, "vec_id long, embedding array<double>, lists binary, part long").withColumn("round", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(rounds)).cast("int"))

    def search(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        turn, _, norm = shared.value
        got: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if rows.num_rows and wanted.num_rows:
            rows = rows.sort_by([("list", "ascending"), ("vec_id", "ascending")])
            x, ids, own = matrix(rows.column("embedding"), dims), rows.column("vec_id").to_numpy(), rows.column("list").to_numpy()
            # equal vectors are one: of their ids only the k + 1 smallest can matter
            _, first, back = np.unique(np.ascontiguousarray(x).view([("", np.void, 8 * dims)]).ravel(), return_index=True, return_inverse=True)
            rank = np.argsort(np.argsort(first))
            back, first = rank[back], np.sort(first)  # distinct vectors in the order of lists
            by = np.argsort(back, kind="stable")
            starts = np.searchsorted(back[by], np.arange(len(first)))
            copies = np.minimum(np.diff(np.append(starts, len(by))), k + 1)
            turned, lists = lifted(x[first], norm, turn), own[first]
            names, opens = np.unique(lists, return_index=True)
            ends = np.append(opens[1:], len(lists))
            for begin in range(0, wanted.num_rows, BATCH):
                some = wanted.slice(begin, BATCH)
                q, me = matrix(some.column("embedding"), dims), some.column("vec_id").to_numpy()
                q_turned = lifted(q, norm, turn, True)
                asks = np.zeros((len(q), len(names)), bool)
                for i, blob in enumerate(some.column("lists").to_pylist()):
                    asks[i] = np.isin(names, np.frombuffer(blob, np.int32), assume_unique=True)
                # one more than k: the query itself may be among them
                best = Best(len(q), k + 1)
                for c, (a, z) in enumerate(zip(opens, ends, strict=True)):
                    who = np.flatnonzero(asks[:, c])
                    if len(who):
                        far = scan(turned[a:z], q_turned[who], best.bound(who), epsilon=epsilon)
                        hit = np.isfinite(far).any(1)
                        best.add(who[hit], far[hit], a)
                i, j = best.pairs()
                # a sum per row, so that equal vectors get equal scores wherever they stand
                score = (x[first[j]] * q[i]).sum(1)
                i, score, j = np.repeat(i, copies[j]), np.repeat(score, copies[j]), by[np.repeat(starts[j], copies[j]) + offsets(copies[j])]
                other = ids[j] != me[i]
                i, j, score = i[other], j[other], score[other]
                top = np.lexsort((ids[j], -score, i))
                rank = np.arange(len(top)) - np.searchsorted(i[top], i[top])
                top = top[rank < k]
                for column, values in zip(got, (me[i[top]], ids[j[top]], score[top]), strict=True):
                    column.append(values)
        return pa.table({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), got, strict=True)})

    found = placed.groupBy("part", "round").cogroup(sent.groupBy("part", "round")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def offsets(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def visited(listed: DataFrame, tried: list, dims: int, k: int, recall: float, turn: np.ndarray, center: np.ndarray, norm: float) -> int:
    """How many lists the tried queries must visit for `recall` of their true neighbours, found by brute force in one pass over all vectors."""
    q, me = np.array([r.embedding for r in tried]), np.array([r.vec_id for r in tried])
    shared = listed.sparkSession.sparkContext.broadcast((q, me))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, me = shared.value
        best, at = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        for b in batches:
            score = q @ matrix(b.column("embedding"), dims).T
            score[me[:, None] == b.column("vec_id").to_numpy()[None, :]] = -np.inf
            every = np.concatenate([best, -score], axis=1)
            lists = np.concatenate([at, np.broadcast_to(b.column("list").to_numpy(), score.shape)], axis=1)
            keep = np.argpartition(every, k - 1, axis=1)[:, :k]
            best, at = np.take_along_axis(every, keep, 1), np.take_along_axis(lists, keep, 1)
        i, c = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(at[i, c].astype(np.int64)), pa.array(best[i, c])], ["i", "list", "far"])

    every = listed.mapInArrow(exact, "i long, list long, far double")
    first = Window.partitionBy("i").orderBy("far", "list")
    true = every.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).select("i", "list").collect()
    far = (center * center).sum(1) - 2 * (lifted(q, norm, turn, True) @ center.T)
    rank = np.argsort(np.argsort(far, axis=1), axis=1)
    ranks = np.sort([rank[r.i, r.list] for r in true])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else len(center)
