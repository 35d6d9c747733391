"""N-gram Jaccard self join with token-combination prefixes.

A document's set is its distinct word shingles, hashed. Shingles found in many documents form the
frequent class. In the global order (rare before frequent, then by hash) a prefix of each set is
indexed: rare shingles one by one, frequent ones as pairs within hash ranges. If a set may miss at
most m shingles in a partner, its prefix is extended until m missing shingles cannot destroy every
single and every pair, so linked sets share an index key. Candidates are verified on whole sets.

Equal sets are one node. Short key lists give pairs; the members of long ones (many near copies)
form candidate clusters, which are compared in blocks of bounded size inside tasks, where a pair
already connected is not compared again and only connecting links are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tidemark.llm.common import ascii_lower, attached, mixed, pack, parts, stored, unpack
from tidemark.llm.components import components

#: A shingle of more documents than RARE is frequent.
RARE = 8
#: The frequent class is a bitmap over hash prefixes of at most so many bits (16 MB). Any function of the
#: hash serves, as long as all documents use the same: shingles that share a bit with a frequent one
#: count as frequent and are indexed in pairs.
CLASS_BITS = 27
#: Bits of the ids' bitmap that picks the texts to be read again, at most (64 MB).
SPOT_BITS = 29
#: Key lists of up to this many sets give pairs.
SHORT = 8
#: Index keys that a task sorts at a time, about.
KEYS = 1_000_000
#: Sets, and shingles, of a block of a candidate cluster.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
BITMAP = 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Ascending distinct hashes of the `size`-word shingles; of the whole sequence if it is shorter; none without words."""
    words = ascii_lower(text or "").split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, size)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out + h[k : n - width + 1 + k] * _ODD[k % 8])
    return np.unique(out)


def most_missing(n: int, percent: int) -> int:
    """Shingles of a set of n that a linked partner may lack: the common part is at least percent/100 of n."""
    return n - -(-n * percent // 100)


def levels(n: int, percent: int) -> list[int]:
    """The powers of two (exponents) that sizes of linked partners lie at."""
    low, high = -(-n * percent // 100), n * 100 // percent
    return list(range(low.bit_length() - 1, high.bit_length()))


def index_keys(rare: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set given as its ascending rare and frequent shingles.

    With r rare shingles in the prefix and, for each hash range, f frequent ones, r + sum(f - 1) missing
    shingles are needed to destroy all singles and pairs. The number of ranges is at most an eighth of
    the size (a power of two, so partners agree on it at one of their common levels), hence a prefix
    that covers the most that may be missing exists, and pairs grow in proportion to the set.
    """
    n = len(rare) + len(frequent)
    need = most_missing(n, percent) + 1
    keys = [mixed(rare[:need] ^ _ODD[0])]
    short = need - len(rare)
    if short > 0 and n > 1:
        for level in levels(n, percent):
            bits = max(0, level - 3)
            ranges = frequent >> np.uint64(64 - bits) if bits else np.zeros(len(frequent), np.uint64)
            opens = np.diff(ranges.astype(np.int64), prepend=-1) != 0
            covers = np.arange(1, len(frequent) + 1) - np.cumsum(opens)
            p = int(np.searchsorted(covers, short)) + 1
            f, own = frequent[:p], ranges[:p]
            for d in range(1, len(f)):
                same = own[d:] == own[:-d]
                if not same.any():
                    break
                keys.append(mixed(f[:-d][same] * _ODD[1] + f[d:][same] * _ODD[2] + np.uint64(level)))
    return np.unique(np.concatenate(keys))


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the hashes' last bits: two sets differ in at least as many shingles as their bitmaps in bits."""
    return np.packbits(np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).tobytes()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * common size >= percent * union size, for ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * 100 < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum()) if len(b) else 0
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def bits_for(n: int, most: int, spare: int = 4) -> int:
    """Exponent of a bitmap with 2^spare bits for each of n members, at most `most`."""
    return min(most, max(16, (n << spare).bit_length()))


def bitmap_of(places: DataFrame, bits: int) -> np.ndarray:
    """The bitmap (64-bit words) of a column `at` of places below 2^bits: words are put together where the rows are."""
    words = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return out


def inside(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places of the bitmap are set."""
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """The frequent class as a bitmap over hash prefixes.

    All shingles of all documents are counted by a prefix of their hash, long enough for the corpus
    that few share one (equal prefixes only raise a count): batches send each distinct prefix once,
    packed by hash range, with its count where that is above one.
    """
    n_ranges = 8 * max(parts(docs.sparkSession), docs.rdd.getNumPartitions())
    chars = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count_bits = max(32, min(62, chars.bit_length() + 11))
    edges = (np.arange(n_ranges + 1, dtype=np.float64) / n_ranges * 2.0**count_bits).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), size) >> np.uint64(64 - count_bits) for t in b.column("text")]
            values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            cuts = np.searchsorted(values, edges)
            rows = [(i, pack(values[a:z] - edges[i]), (m := np.flatnonzero(n[a:z] > 1)).astype(np.int32).tobytes(), n[a:z][m].astype(np.int32).tobytes()) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "keys", "at", "more"])

    def add(rows: pa.Table) -> pa.Table:
        keys, n = [], []
        for k, at, more in zip(*(rows.column(c).to_pylist() for c in ("keys", "at", "more")), strict=True):
            keys.append(unpack(k))
            one = np.ones(len(keys[-1]), np.int64)
            one[np.frombuffer(at, np.int32)] = np.frombuffer(more, np.int32)
            n.append(one)
        values, back = np.unique(np.concatenate(keys), return_inverse=True)
        often = np.bincount(back, np.concatenate(n)).astype(np.int64) > RARE
        return pa.table({"key": pa.array((values[often] + edges[rows.column("part")[0].as_py()]).astype(np.int64))})

    counted = docs.select("text").mapInArrow(run, "part int, keys binary, at binary, more binary").groupBy("part").applyInArrow(add, "key long")
    counted = stored(counted)
    bits = bits_for(counted.count(), min(CLASS_BITS, count_bits), 7)
    return bitmap_of(counted.select(F.shiftright("key", count_bits - bits).alias("at")), bits)


def indexed(docs: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """docs' doc_id with n (set size), two halves of the set's digest, its index keys and bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        shift = np.uint64(64 - (len(often) * 64).bit_length() + 1)
        for b in batches:
            n, digests, keys, maps = [], [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), size)
                flag = inside(often, s >> shift)
                n.append(len(s))
                digests.append(np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64))
                keys.append(index_keys(s[~flag], s[flag], percent).tobytes() if len(s) else b"")
                maps.append(bitmap(s))
            d = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(keys, pa.binary()), pa.array(maps, pa.binary())], ["doc_id", "n", "d1", "d2", "keys", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, keys binary, bits binary").withColumn("node", F.monotonically_increasing_id())


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal sorted keys starts, and its length."""
    opens = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return opens, np.diff(np.append(opens, len(keys)))


def key_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, long): candidate pairs a < b of short key lists, and the edges to the first member of long ones.

    A key that is long within a batch already is sent with its first member only, marked as long, and
    the edges to the batch's other members go along in any range: so a key of very many sets sends one
    entry a batch, and no task holds all of them.
    """
    n_ranges = 4 * max(parts(sets.sparkSession), sets.rdd.getNumPartitions())
    most = np.iinfo(np.int32).max

    def entries(keys: list[np.ndarray], nodes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(keys)), np.fromiter(map(len, keys), np.int64, len(keys)))
        flat = np.concatenate([np.empty(0, np.uint64), *keys])
        order = np.argsort(flat, kind="stable")  # sets come in the order of their nodes
        flat, row = flat[order], row[order]
        opens, length = runs(flat)
        first, of = np.repeat(opens, length), np.repeat(length, length)
        rest = (of > SHORT) & (first != np.arange(len(flat)))
        # an edge has many keys: its two places in the batch as one number
        edges = np.unique(row[first[rest]] * len(keys) + row[rest])
        edges = np.column_stack([nodes[edges // max(1, len(keys))], nodes[edges % max(1, len(keys))]])
        n = np.where(of > SHORT, most, sizes[row]).astype(np.int32)[~rest]  # the mark of a key that is long already
        flat, node = flat[~rest], nodes[row[~rest]]
        part = ((flat >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int32)
        used, first = np.unique(part, return_index=True)
        cuts = list(zip(first, [*first[1:], len(part)], strict=True))
        dealt = np.array_split(edges, len(used)) if len(used) else []
        columns = [[x[a:z].tobytes() for a, z in cuts] for x in (flat, node, n)]
        return pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c, pa.binary()) for c in columns), pa.array([e.tobytes() for e in dealt], pa.binary())], ["part", "keys", "nodes", "sizes", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.sort_by("node")
            held = np.cumsum(pc.binary_length(b.column("keys")).to_numpy()) // 8
            begin = 0
            while begin < len(b):  # about KEYS keys at a time
                end = max(begin + 1, int(np.searchsorted(held, (held[begin - 1] if begin else 0) + KEYS, "right")))
                few = b.slice(begin, end - begin)
                yield entries([np.frombuffer(k, np.uint64) for k in few.column("keys").to_pylist()], few.column("node").to_numpy(), few.column("n").to_numpy())
                begin = end

    def lists(rows: pa.Table) -> pa.Table:
        keys, node, n = (np.concatenate([np.frombuffer(x, k) for x in rows.column(c).to_pylist()]) for c, k in (("keys", np.uint64), ("nodes", np.int64), ("sizes", np.int32)))
        order = np.lexsort((node, keys))
        keys, node, n = keys[order], node[order], n[order].astype(np.int64)
        opens, length = runs(keys)
        length = np.where(np.maximum.reduceat(n, opens) == most, SHORT + length, length) if len(opens) else length
        first, of = np.repeat(opens, np.diff(np.append(opens, len(keys)))), np.repeat(length, np.diff(np.append(opens, len(keys))))
        found = [np.empty((0, 3), np.int64)]
        for d in range(1, SHORT):
            i = np.arange(len(keys) - d)
            i = i[(keys[i] == keys[i + d]) & (of[i] <= SHORT)]
            i = i[100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])]
            found.append(np.column_stack([node[i], node[i + d], np.zeros(len(i), np.int64)]))
        i = np.flatnonzero((of > SHORT) & (first != np.arange(len(keys))))
        found.append(np.column_stack([node[first[i]], node[i], np.ones(len(i), np.int64)]))
        local = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("edges").to_pylist()]).reshape(-1, 2)
        found.append(np.column_stack([local, np.ones(len(local), np.int64)]))
        got = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1]), "long": pa.array(got[:, 2] == 1)})

    sent = sets.select("node", "n", "keys").mapInArrow(run, "part int, keys binary, nodes binary, sizes binary, edges binary")
    return sent.groupBy("part").applyInArrow(lists, "a long, b long, long boolean").distinct()


def close_bits(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps don't prove them apart."""
    few = sets.select("node", "n", "bits")
    rows = pairs.join(few.withColumnsRenamed({"node": "a", "n": "na", "bits": "ba"}), "a").join(few.withColumnsRenamed({"node": "b", "n": "nb", "bits": "bb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(len(b), -1) for c in ("ba", "bb"))
                both = b.column("na").to_numpy() + b.column("nb").to_numpy()
                differ = both - 2 * -(-percent * both // (100 + percent))
                keep = pa.array(np.bitwise_count(x ^ y).sum(1) <= differ)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(keep)

    return rows.mapInArrow(run, "a long, b long")


def whole_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Rows (node, n, bits, shingles) of the wanted nodes, their sets made again from the texts.

    So that other texts are not shuffled, a bit array of the wanted ids' hashes (of fixed size at most)
    goes to the scan; ids that only share a bit are dropped by the join on the digest.
    """
    nodes = stored(sets.join(wanted.select("node").distinct(), "node").select("node", "doc_id", "n", "d1", "d2", "bits"))
    bits = bits_for(nodes.count(), SPOT_BITS)
    spot = F.xxhash64("doc_id").bitwiseAND((1 << bits) - 1)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(nodes.select(spot.alias("at")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = shared.value
        for b in batches:
            hit = np.flatnonzero(inside(bit, b.column("spot").to_numpy().astype(np.uint64)))
            made = [shingles(b.column("text")[int(i)].as_py(), size) for i in hit]
            d = np.array([np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64) for s in made], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([s.tobytes() for s in made], pa.binary())], ["d1", "d2", "shingles"])

    made = docs.select(spot.alias("spot"), "text").mapInArrow(run, "d1 long, d2 long, shingles binary")
    return stored(made.join(nodes.drop("doc_id"), ["d1", "d2"]).dropDuplicates(["node"]).select("node", "n", "bits", "shingles"))


def verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, b)."""
    s = whole.select("node", "shingles")
    rows = pairs.join(s.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").join(s.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column("sa"), b.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def cluster_links(clusters: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect within each cluster what any links in it connect. clusters: rows (node, component)."""
    per = clusters.join(whole.select("node", "n"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("s"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_SETS, F.col("s") / BLOCK_SHINGLES)).cast("int")
    rows = attached(clusters, stored(per.select("component", "members", blocks.alias("blocks"))), ["component"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).join(whole, "node")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, n, own = (group.column(c).to_numpy() for c in ("node", "n", "own"))
        mixed_blocks = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        label, out = np.arange(len(node)), []
        for x in range(len(node)):
            y = np.arange(x + 1, len(node))
            y = y[(label[y] != label[x]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))]
            if mixed_blocks:
                y = y[own[y] != own[x]]
            both = n[x] + n[y]
            y = y[np.bitwise_count(bits[x] ^ bits[y]).sum(1) <= both - 2 * -(-percent * both // (100 + percent))]
            for z in y.tolist():
                if label[z] != label[x] and linked(sets[x], sets[z], percent):
                    label[label == label[z]] = label[x]
                    out.append((node[x], node[z]))
        got = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    return rows.select("component", "i", "j", "own", "node", "n", "bits", "shingles").groupBy("component", "i", "j").applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links, its own included).

    Rows link when 100 * common >= percent * union of their shingle sets. Null and blank texts have
    empty sets and link with nothing; texts of fewer words than `size` are one shingle. Equal rows
    are linked with each other. A null doc_id stays null and never names a component unless all of
    its component's ids are null.
    """
    sets = stored(indexed(docs, frequent_shingles(docs, size), size, percent))
    firsts = stored(sets.filter("n > 0").groupBy("d1", "d2").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")))
    nodes = sets.join(firsts.select(F.col("first").alias("node")), "node", "left_semi")
    found = stored(key_lists(nodes, percent))
    clusters = components(found.filter("long").select("a", "b"))
    pairs = stored(close_bits(found.filter("not long").select("a", "b"), sets, percent))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(clusters.select("node"))
    whole = whole_sets(docs, sets, wanted, size)
    links = verified(pairs, whole, percent).union(cluster_links(clusters, whole, percent))
    joined = components(stored(links))
    names = firsts.join(joined.withColumnRenamed("node", "first"), "first", "left").select("d1", "d2", "members", F.coalesce("component", "first").alias("root"))
    full = attached(sets.filter("n > 0").select("doc_id", "n", "d1", "d2"), stored(names), ["d1", "d2"])
    # rows without shingles are each their own
    named = stored(full.select("doc_id", "n", "root").unionByName(sets.filter("n = 0").select("doc_id", "n", F.col("node").alias("root"))))
    return smallest_ids(named).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def smallest_ids(named: DataFrame) -> DataFrame:
    """named (root, doc_id, ..) with component_id, the least doc_id of each root."""
    return attached(named, stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))), ["root"])
