"""Centroid clustering with vector approximations: a few bits for each dimension decide most rows.

Vectors are integers, each dimension cut into cells. For given centroids, two lookup tables hold the
least and greatest squared difference between a cell and each centroid's component, so a row's cells
alone bound its distance to every centroid. Where one centroid's bounds lie below all others', the row
is decided; only where intervals overlap is the full vector fetched and its exact distances compared.

The first round and the last need every vector anyway (for exact sums, and for exact distances), so
they run over the table of cells and vectors side by side. The rounds between read the cells alone,
and fetch vectors by key for rows that are undecided or have moved, whose vectors correct the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

DIMENSIONS, CENTROIDS, ROUNDS, BITS = 64, 16, 3, 6
#: On the given vectors (integers with a deviation of 8) cells of 6 bits leave 1 to 2 % of the rows undecided, 5 bits 88 to 98 %.
#: Boundaries of cells come from so many vectors, those with the smallest hashes; they affect the work, never a result.
SAMPLE = 4096
#: Components beyond this would overflow a long when squared and summed.
LIMIT = 1 << 27
SLICE = 2048


def packed(codes: np.ndarray, bits: int) -> np.ndarray:
    """(n, dimensions) cell numbers as (n, bits * dimensions / 8) bytes, a plane for each bit."""
    return np.concatenate([np.packbits((codes >> b) & 1, axis=1) for b in range(bits)], axis=1)


def unpacked(blob: np.ndarray, bits: int, dimensions: int) -> np.ndarray:
    planes = np.unpackbits(blob.reshape(len(blob), bits, -1), axis=2)[:, :, :dimensions]
    return sum(planes[:, b].astype(np.uint8) << b for b in range(bits))


def binary_rows(column: pa.Array, dtype: str) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def kept_vectors(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows (key, vec_id, ints: `dimensions` little-endian 32-bit integers floor(64 x)), stored; key numbers them.

    Left out: null vectors, other lengths, null or non-finite components, and components beyond two
    million, whose squared distances no long can hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), dimensions)
            ints = np.floor(flat * 64.0)
            fine = (np.abs(ints) <= LIMIT).all(axis=1)
            blobs = [x.tobytes() for x in ints[fine].astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(fine)), pa.array(blobs, pa.binary())], ["vec_id", "ints"])

    v = F.col("embedding").cast("array<double>")
    finite = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = rows.filter(v.isNotNull() & finite).select("vec_id", v.alias("v"))
    kind = dict(rows.dtypes)["vec_id"]
    got = given.mapInArrow(run, f"vec_id {kind}, ints binary")
    return stored(got.select(F.monotonically_increasing_id().alias("key"), "vec_id", "ints"))


def numbers(rows: list, dimensions: int) -> np.ndarray:
    return np.array([np.frombuffer(r["ints"], "<i4") for r in rows], np.int64).reshape(-1, dimensions)


def first_centroids(vectors: DataFrame, k: int, dimensions: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of '1:<vec_id>' (equal ids by their components' bytes; a null id as '')."""
    named = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return numbers(vectors.orderBy(named, "ints").limit(k).select("ints").collect(), dimensions)


def boundaries(vectors: DataFrame, bits: int, dimensions: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Per dimension and cell, the least and greatest integer it may hold: (dimensions, cells) each.

    Cells are equally wide over the middle of a bounded sample, its far values left out; the outer ones end at the least and greatest value of all rows.
    """

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = binary_rows(b.column("ints"), "<i4")
                yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array(x.min(axis=0).astype(np.int64)), pa.array(x.max(axis=0).astype(np.int64))], ["dim", "low", "high"])

    ends = vectors.select("ints").mapInArrow(extremes, "dim int, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    some = numbers(vectors.orderBy(F.xxhash64("vec_id", F.lit(2)), "key").limit(sample).select("ints").collect(), dimensions)
    cells = 1 << bits
    low = np.empty((dimensions, cells), np.int64)
    for d in range(dimensions):
        x = some[:, d]
        q1, q3 = np.quantile(x, [0.25, 0.75])
        reach = 4 * max(q3 - q1, 1)  # far values don't widen the cells of the others
        inner = np.unique(np.round(np.linspace(max(x.min(), q1 - reach), min(x.max(), q3 + reach) + 1, cells + 1)).astype(np.int64))[1:-1]
        low[d] = np.concatenate([[ends[d]["low"]], inner, np.full(cells - 1 - len(inner), ends[d]["high"] + 1)])
    high = np.concatenate([low[:, 1:] - 1, np.array([[e["high"]] for e in ends], np.int64)], axis=1)
    return low, np.maximum(high, low)


def cell_codes(ints: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(low[d, 1:], ints[:, d], side="right") for d in range(ints.shape[1])], axis=1).astype(np.uint8)


def lookup(centroids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared difference: (dimensions, cells, centroids) each."""
    c = centroids.T[:, None, :]
    below, above = low[:, :, None] - c, c - high[:, :, None]
    least = np.maximum(np.maximum(below, above), 0)
    most = np.maximum(np.abs(c - low[:, :, None]), np.abs(c - high[:, :, None]))
    return least**2, most**2


def judged(codes: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(n, centroids) booleans: which centroids' distance intervals reach below the smallest upper end."""
    lower, upper = np.zeros((len(codes), least.shape[2]), np.int64), np.zeros((len(codes), least.shape[2]), np.int64)
    for d in range(codes.shape[1]):
        lower += least[d][codes[:, d]]
        upper += most[d][codes[:, d]]
    return lower <= upper.min(axis=1, keepdims=True)


def exact(ints: np.ndarray, maybe: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row among those that may be (ties: the smaller number), and how many rows had several."""
    nearest = maybe.argmax(axis=1).astype(np.int32)
    several = np.flatnonzero(maybe.sum(axis=1) > 1)
    for begin in range(0, len(several), SLICE):
        at = several[begin : begin + SLICE]
        d = ((ints[at, None, :] - centroids[None]) ** 2).sum(axis=2)
        d[~maybe[at]] = np.iinfo(np.int64).max
        nearest[at] = d.argmin(axis=1)
    return nearest, len(several)


def assigned_rows(b: pa.RecordBatch, cluster: np.ndarray) -> pa.RecordBatch:
    """A batch's rows with their clusters."""
    none = [pa.nulls(len(b), t) for t in (pa.list_(pa.int64()), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([b.column("key"), b.column("cells"), pa.array(cluster), *none], NAMES)


def sums_rows(sums: np.ndarray, counts: np.ndarray, fetched: int) -> pa.RecordBatch:
    """A batch's sums and counts, a row for each centroid; the first tells how many rows were decided by their vectors."""
    k = len(counts)
    told = pa.array([fetched] + [0] * (k - 1), pa.int64())
    return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(counts.tolist(), pa.int64()), told], NAMES)


def added(x: np.ndarray, cluster: np.ndarray, k: int, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
    for c in np.unique(cluster):
        own = cluster == c
        sums[c], counts[c] = sign * x[own].sum(axis=0), sign * own.sum()
    return sums, counts


class Clustering:
    """One run: the stored vectors with their cells, the centroids, and exact sums and counts of each cluster."""

    def __init__(self, vectors: DataFrame, k: int, bits: int, dimensions: int):
        self.bits, self.dimensions = bits, dimensions
        self.centroids = first_centroids(vectors, k, dimensions)
        self.k = len(self.centroids)
        self.fetched: list[int] = []  # rows whose full vector decided, by round
        if not self.k:
            return
        self.low, self.high = boundaries(vectors, bits, dimensions)
        low = self.low

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    got = packed(cell_codes(binary_rows(b.column("ints"), "<i4"), low), bits)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in got], pa.binary())], [*b.schema.names, "cells"])

        self.table = stored(vectors.mapInArrow(code, f"key long, vec_id {dict(vectors.dtypes)['vec_id']}, ints binary, cells binary"))
        self.sums, self.counts = [[0] * dimensions for _ in range(self.k)], [0] * self.k

    def moved(self, rows: DataFrame) -> None:
        """Adds the sums that the batches of a round left, and moves the centroids to the floor of their means."""
        sums = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(self.dimensions)]
        for r in rows.filter("sums IS NOT NULL").groupBy("cluster").agg(F.sum("counts").alias("n"), F.sum("fetched").alias("f"), *sums).collect():
            c = r["cluster"]
            self.sums[c] = [s + r[f"s{d}"] for d, s in enumerate(self.sums[c])]
            self.counts[c] += r["n"]
            if c == 0:
                self.fetched.append(r["f"])
        for c in range(self.k):
            if self.counts[c]:
                self.centroids[c] = [s // self.counts[c] for s in self.sums[c]]

    def whole_round(self, last: bool) -> DataFrame:
        """Every row assigned by its cells or else its vector, over cells and vectors side by side.

        The first: rows (key, cells, cluster) and rows of sums; the last: rows (vec_id, cluster, distance).
        """
        centroids, (least, most), bits, dimensions, k = self.centroids.copy(), lookup(self.centroids, self.low, self.high), self.bits, self.dimensions, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = binary_rows(b.column("ints"), "<i4").astype(np.int64)
                cluster, fetched = exact(x, judged(unpacked(binary_rows(b.column("cells"), "u1"), bits, dimensions), least, most), centroids)
                if last:
                    distance = ((x - centroids[cluster]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])
                else:
                    yield assigned_rows(b, cluster)
                    yield sums_rows(*added(x, cluster, k), fetched)

        kind = dict(self.table.dtypes)["vec_id"]
        return stored(self.table.mapInArrow(run, f"vec_id {kind}, cluster int, distance long" if last else SCHEMA))

    def cells_round(self, state: DataFrame) -> DataFrame:
        """Rows (key, cells, cluster) and rows of sums after a round over the cells; vectors are fetched by key where cells leave a doubt or the cluster changed."""
        centroids, (least, most), bits, dimensions, k = self.centroids.copy(), lookup(self.centroids, self.low, self.high), self.bits, self.dimensions, self.k

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                maybe = judged(unpacked(binary_rows(b.column("cells"), "u1"), bits, dimensions), least, most)
                decided = np.where(maybe.sum(axis=1) == 1, maybe.argmax(axis=1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decided)], [*b.schema.names, "decided"])

        def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x, before = binary_rows(b.column("ints"), "<i4").astype(np.int64), b.column("cluster").to_numpy()
                cluster, fetched = exact(x, judged(unpacked(binary_rows(b.column("cells"), "u1"), bits, dimensions), least, most), centroids)
                other = cluster != before
                plus, minus = added(x[other], cluster[other], k), added(x[other], before[other], k, -1)
                yield assigned_rows(b, cluster)
                yield sums_rows(plus[0] + minus[0], plus[1] + minus[1], fetched)

        seen = stored(state.filter("key IS NOT NULL").select("key", "cells", "cluster").mapInArrow(judge, "key long, cells binary, cluster int, decided int"))
        stays = F.col("decided") == F.col("cluster")
        fetch = seen.filter(~stays).select("key", "cells", "cluster").join(self.table.select("key", "ints"), "key")
        fetched = stored(fetch.mapInArrow(resolve, SCHEMA))
        return seen.filter(stays).select("key", "cells", "cluster").unionByName(fetched, allowMissingColumns=True)


NAMES = ["key", "cells", "cluster", "sums", "counts", "fetched"]
SCHEMA = "key long, cells binary, cluster int, sums array<long>, counts long, fetched long"


def vafile_clusters(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, bits: int = BITS, dimensions: int = DIMENSIONS, report: list[int] | None = None) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    rows: vec_id, embedding; other columns are not used. Vectors are kept as in kept_vectors(), each
    repeated row for itself, null ids too. Fewer kept vectors than k: as many centroids as vectors;
    none: no rows. Of equally near centroids the smaller number counts; equal centroids leave the later
    ones empty, and empty ones stay where they are. report, if given, gets the number of rows that each
    round decided by their full vectors. An inertia that no long holds is null. What the driver holds is k vectors, their sums, and the cells'
    boundaries with the bounded sample they come from.
    """
    run = Clustering(kept_vectors(rows, dimensions), k, bits, dimensions)
    spark: SparkSession = rows.sparkSession
    kind = dict(rows.dtypes)["vec_id"]
    if not run.k:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = None
    for _ in range(rounds):
        state = run.whole_round(last=False) if state is None else run.cells_round(state)
        run.moved(state)
    if report is not None:
        report.extend(run.fetched)
    out = run.whole_round(last=True)
    inertia = out.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    names = [(c, ",".join(map(str, row))) for c, row in enumerate(run.centroids.tolist())]
    named = spark.createDataFrame(names, "cluster int, components string").select("cluster", F.sha2("components", 256).alias("centroid_sha256"))
    found = {r["cluster"]: r["cluster_inertia"] for r in inertia.collect()}  # a row for each centroid
    total = None if None in found.values() or sum(found.values()) > np.iinfo(np.int64).max else sum(found.values())
    sums = spark.createDataFrame([(c, s, total) for c, s in found.items()], "cluster int, cluster_inertia long, inertia long")
    return out.join(F.broadcast(sums.join(named, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
