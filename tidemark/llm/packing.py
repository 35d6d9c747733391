"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best fit: a fixed number of open bins, held in a bitset keyed by free space, so
the tightest bin that fits is one shift and one lowest-bit lookup. When a bin too many is open, the
fullest closes first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

CAPACITY, OPEN_BINS, PIECES_A_TASK = 2048, 1024, 16_000
END = 0


@lru_cache(maxsize=2)
def whole_tokenizer(path: str):
    """The tokenizer itself, which takes some hundred megabytes: loaded only where a text needs it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """A function text -> uint32 ids of a byte-level BPE given as a tokenizers JSON file.

    The vocabulary and its order are read from the file and run by tiktoken, which gives the same ids
    several times faster; texts its pattern engine refuses go to tokenizers itself. The file's added
    tokens keep their own ids where their strings stand in a text, as in a plain call of tokenizers'
    encode(text, add_special_tokens=False). path: byte_bpe_50k.json of the installed vocabulary
    package if none is given, looked up where it runs.
    """
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    # byte-level vocabularies write bytes as printable characters: those that are printable as
    # themselves, the others in order from U+0100 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # the pattern engine's own limits, on texts such as a million blanks
            return np.asarray(whole_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


class Bins:
    """The open bins of one packing run: a bit for each free space that some bin has, and the bins that have it."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.n_open, self.n_bins = 0, 0, 0

    def taken(self, free: int) -> int:
        """Takes a bin with that much free space out."""
        own = self.free_bins[free].pop()
        if not self.free_bins[free]:
            self.mask ^= 1 << free
        self.n_open -= 1
        return own

    def place(self, need: int) -> tuple[int, int]:
        """(bin, offset) of the next piece, whose length lies in 1..capacity."""
        fits = self.mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            own = self.taken(free)
        else:
            free, own = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - need
        if left:
            self.free_bins[left].append(own)
            self.mask |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                self.taken((self.mask & -self.mask).bit_length() - 1)
        return own, self.capacity - free


def best_fit(lengths, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, in the order given."""
    bins = Bins(capacity, open_bins)
    got = np.array([bins.place(n) for n in lengths], np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def token_pieces(docs: DataFrame, order: Column, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (at, doc_id, piece, start, length, ids): each row's whole text as ids, then END, cut to pieces; at: order's value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column("text")
            for begin in range(0, len(batch), 64):  # so that a batch of ids stays small
                row, out, blobs = [], [], []
                for i in range(begin, min(begin + 64, len(batch))):
                    ids = np.append(encode(texts[i].as_py() or ""), np.uint32(END)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        row.append(i)
                        out.append((k, start, length))
                        blobs.append(ids[start : start + length].tobytes())
                got, of = np.array(out, np.int64).reshape(-1, 3), pa.array(row, pa.int64())
                arrays = [batch.column("at").take(of), batch.column("doc_id").take(of), pa.array(got[:, 0].astype(np.int32)), pa.array(got[:, 1]), pa.array(got[:, 2]), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["at", "doc_id", "piece", "start", "length", "ids"])

    given = docs.select(order.alias("at"), "doc_id", "text")
    kinds = dict(given.dtypes)
    return given.mapInArrow(run, f"at {kinds['at']}, doc_id {kinds['doc_id']}, piece int, start long, length long, ids binary")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK, order: Column | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Null and empty texts are the one id END. Pieces are dealt to tasks by ranges of `order` (a column
    of docs: training order, say; a hash of the id if none is given) of about `pieces_a_task` and are
    packed online in that order, a few at a time in memory, so a sequence holds pieces that stand near
    each other in it. Full pieces are sequences of their own. Rows of equal doc_id are packed each for
    itself. An empty table gives no rows; columns of docs other than doc_id and text are not used.
    """
    hashed = F.xxhash64("doc_id", F.lit(1))
    pieces = stored(token_pieces(docs, hashed if order is None else order, path, capacity))
    tasks = max(1, -(-pieces.count() // pieces_a_task))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = Bins(capacity, open_bins), TaskContext.get().partitionId() << 32
        for b in batches:
            # a full piece opens and fills a bin of its own
            got = np.array([bins.place(n) for n in b.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + got[:, 0]), pa.array(got[:, 1])], [*b.schema.names, "sequence_id", "offset"])

    # rows of one id, and the pieces of one row, are told apart by their place in the stored table
    keys = ("at", "doc_id", "piece", "row")
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return dealt.select("doc_id", "piece", "start", "length", "ids").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
