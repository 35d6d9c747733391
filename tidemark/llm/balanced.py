"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity.

The cost of a piece is what training on it takes: a part linear in its tokens and one that grows with
their square, for attention. Documents are taken in descending cost, and each goes to the sequence with
the lowest cost so far that has room for it, so sequences end with like costs. Full pieces of long
documents are sequences of their own; only what is left of a document, less than a sequence, is dealt
to groups and packed.

A group's sequences hold exactly its tokens: as many of full capacity as fit, and the rest as lengths
that are powers of two, which need no padding. When no sequence has room for a whole piece, the piece is
cut: it fills the sequence with the most room, and the rest of it goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.packing import END, cut, encoder

CAPACITY, HIDDEN, TOKENS_A_GROUP = 1024, 4096, 2_000_000


def cost(length: int, hidden: int = HIDDEN) -> float:
    """Work of a piece in units of one token's linear work: a transformer layer of width h takes 24 h^2 for a token and 4 h for each token it attends to."""
    return length + length * length / (6 * hidden)


def room(tokens: int, capacity: int) -> list[int]:
    """Capacities that hold exactly so many tokens: full ones, then powers of two."""
    left = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


class Sequences:
    """The sequences of one group, in a heap by cost for each amount of free space; a sequence stands in one heap at a time."""

    def __init__(self, tokens: int, capacity: int = CAPACITY, hidden: int = HIDDEN):
        self.hidden, self.sizes = hidden, room(tokens, capacity)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.least = np.full(capacity + 1, np.inf)  # the lowest cost of each heap
        for s, size in enumerate(self.sizes):
            self._put(size, 0.0, s)

    def _put(self, free: int, total: float, s: int) -> None:
        heappush(self.heaps[free], (total, s))
        self.least[free] = self.heaps[free][0][0]

    def _fill(self, free: int, length: int) -> tuple[int, int]:
        total, s = heappop(self.heaps[free])
        self.least[free] = self.heaps[free][0][0] if self.heaps[free] else np.inf
        if free > length:
            self._put(free - length, total + cost(length, self.hidden), s)
        return s, self.sizes[s] - free

    def place(self, length: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the piece, or of its parts if no sequence has room for all of it."""
        out = []
        while length:
            fits = self.least[length:]
            at = int(fits.argmin()) if len(fits) else 0
            if len(fits) and fits[at] < np.inf:
                free, part = length + at, length
            else:  # the most room there is
                free = part = int(np.flatnonzero(self.least < np.inf)[-1])
            s, offset = self._fill(free, part)
            out.append((s, offset, part))
            length -= part
        return out


def balanced(lengths, capacity: int = CAPACITY, hidden: int = HIDDEN) -> list[list[tuple[int, int, int]]]:
    """Places of pieces, each shorter than the capacity, in descending order of length."""
    run = Sequences(int(sum(lengths)), capacity, hidden)
    return [run.place(int(n)) for n in lengths]


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, ids): each row's whole text as ids, then END; the first piece is what full ones leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column("text")
            for begin in range(0, len(batch), 64):  # so that a batch of ids stays small
                row, out, blobs = [], [], []
                for i in range(begin, min(begin + 64, len(batch))):
                    ids = np.append(encode(texts[i].as_py() or ""), np.uint32(END)).astype("<u4")
                    for start, length in cut(len(ids), capacity):
                        row.append(i)
                        out.append((start, length, len(ids)))
                        blobs.append(ids[start : start + length].tobytes())
                got = np.array(out, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *map(pa.array, got.T), pa.array(blobs, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    given = docs.select("doc_id", "text")
    return given.mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, start long, length long, doc_tokens long, ids binary")


def pack_balanced(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, hidden: int = HIDDEN, tokens_a_group: int = TOKENS_A_GROUP) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset, piece_cost.

    Null and empty texts are the one id END. Rows are dealt to groups of about `tokens_a_group` tokens by
    a hash of their place in the table, so rows that repeat an id spread, and each is packed for itself.
    A group streams through one task in descending order, which holds a number or two for each of its
    sequences. Sequences that aren't of full capacity are powers of two, so nothing is padded. Negative
    sequence_ids are full pieces. An empty table gives no rows; other columns of docs are not used.
    """
    kind = dict(docs.dtypes)["doc_id"]
    whole = stored(pieces_of(docs, path, capacity)).withColumn("_row", F.monotonically_increasing_id())
    short = whole.filter(F.col("length") < capacity)
    total = short.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // tokens_a_group))
    short = short.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    sizes = short.groupBy(F.col("_group").alias("_g")).agg(F.sum("length").alias("_tokens"))
    dealt = short.join(sizes, F.col("_group") == F.col("_g")).drop("_g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sequences = None, None
        for b in batches:
            row, out, blobs = [], [], []
            for i, (g, tokens, length, start, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_group", "_tokens", "length", "start", "ids")), strict=True)):
                if g != group:
                    group, sequences = g, Sequences(tokens, capacity, hidden)
                done = 0
                for s, offset, n in sequences.place(length):
                    row.append(i)
                    out.append((start + done, n, (g << 32) + s, offset))
                    blobs.append(ids[4 * done : 4 * (done + n)])
                    done += n
            at, got = pa.array(row, pa.int64()), np.array(out, np.int64).reshape(-1, 4).T
            arrays = [b.column("doc_id").take(at), pa.array(got[0]), pa.array(got[1]), b.column("doc_tokens").take(at), pa.array(blobs, pa.binary()), pa.array(got[2]), pa.array(got[3])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    # a group each task, as near as hashing gets; longer pieces cost more, so length is the order of cost
    dealt = dealt.repartition(groups, "_group").sortWithinPartitions("_group", F.col("length").desc(), "_row")
    packed = dealt.select("doc_id", "start", "length", "doc_tokens", "ids", "_group", "_tokens").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
    full = whole.filter(F.col("length") == capacity).select("doc_id", "start", "length", "doc_tokens", "ids", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n = F.col("length")
    return packed.unionByName(full).withColumn("piece_cost", n + n * n / F.lit(6 * hidden))
