"""Merkle manifest, vector-approximation clustering and cost-balanced packing against plain loops, and their odd inputs."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import balanced, merkle, vafile

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def plain_proofs(rows):
    """What merkle_proofs() gives, one row after another."""
    leaf = lambda r, text: h(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda x: x[:3])
        trees[lang] = climb([x[2] for x in langs[lang]])
    top = climb([trees[lang][-1][0] for lang in order])
    out = []
    for g, lang in enumerate(order):
        for p, (_, _, own, r) in enumerate(langs[lang]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            fold = leaf(r, r[1].translate(str.maketrans(merkle.UPPER, merkle.LOWER))) if tampered else own
            proof = ""
            for levels, at in ((trees[lang], p), (top, g)):
                for nodes in levels[:-1]:
                    run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                    left, right = run[: at % 8], run[at % 8 + 1 :]
                    proof, fold, at = proof + "".join(left + right), h(*left, fold, *right), at // 8
            out.append((r[0], own, trees[lang][-1][0], top[-1][0], h(proof), fold, fold == top[-1][0]))
    return out


def by_all(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("broadcast_nodes", [8192, 3])
def test_proofs_equal_a_plain_climb(spark, broadcast_nodes):
    rows = [(i, f"Text {i} ÄÖ" * (i % 5), "en", ("a", None)[i % 2], i, "x") for i in range(150)]
    rows += [(i, None, "de", "s", None, "x") for i in range(9)] + [(7, "Other", "en", "a", 1, "x"), (7, "Other", "en", "a", 1, "x")]  # a repeated id, repeated rows
    rows += [(None, "No Id", "en", "a", 2, "x"), (500, "ALONE", "zz", "a", 5, "x"), (501, "ALONE", None, "a", 5, "x"), (3, "", "", "", 0, "x")]
    rows += [(1000 + i, "Ab" * 50_000, f"l{i}", None, None, "x") for i in range(12)]  # more languages than a run, long texts
    got = merkle.merkle_proofs(spark.createDataFrame(rows, DOCS).repartition(7), broadcast_nodes)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_all(got.collect()) == by_all(plain_proofs(rows))


def test_small_manifests(spark):
    assert merkle.merkle_proofs(spark.createDataFrame([], DOCS)).collect() == []
    for rows in ([(1, "One", "en", "a", 3, "x")], [(i, "One", "en", "a", 3, "x") for i in range(9)]):
        assert by_all(merkle.merkle_proofs(spark.createDataFrame(rows, DOCS)).collect()) == by_all(plain_proofs(rows))


def plain_clusters(vectors, k=16, rounds=3):
    kept = []
    for i, (vec_id, v) in enumerate(vectors):
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((hashlib.sha256(f"1:{'' if vec_id is None else vec_id}".encode()).hexdigest(), [math.floor(64 * x) for x in v], vec_id, i))
    c = [list(q) for _, q, _, _ in sorted(kept, key=lambda r: (r[0], struct.pack("<64i", *r[1])))[:k]]
    far = lambda q, p: sum((a - b) ** 2 for a, b in zip(q, p, strict=True))
    near = lambda q: min((far(q, p), j) for j, p in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, q, _, _ in kept:
            groups.setdefault(near(q)[1], []).append(q)
        for j, g in groups.items():
            c[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    got = [(vec_id, *near(q)[::-1]) for _, q, vec_id, _ in kept]
    per = {}
    for _, j, d in got:
        per[j] = per.get(j, 0) + d
    return [(v, j, d, per[j], sum(per.values()), h(",".join(map(str, c[j])))) for v, j, d in got]


VECTORS = "vec_id long, embedding array<float>, cluster int"


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_clusters_equal_a_plain_loop(spark, bits):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64)) * 0.12 if bits == 6 else rng.normal(size=(300, 64)) + 2 * rng.integers(0, 4, (300, 1))
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5, x[5].tolist(), 0)] * 3 + [(900 + i, [0.5] * 64, 0) for i in range(40)]  # ties and copies
    rows += [(1, None, 0), (2, [1.0] * 63, 0), (3, [float("nan")] * 64, 0), (4, [None] + [1.0] * 63, 0), (6, [float("inf")] * 64, 0), (None, [0.25] * 64, 0), (7, [1e5] * 64, 0)]
    report = []
    got = vafile.vafile_clusters(spark.createDataFrame(rows, VECTORS).repartition(5), bits=bits, report=report)
    assert by_all(got.collect()) == by_all(plain_clusters([r[:2] for r in rows]))
    assert len(report) == 3 and (bits < 6 or max(report) < 300)  # cells alone decide the others


def test_few_vectors(spark):
    assert vafile.vafile_clusters(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(i, [float(i % 2)] * 64, 0) for i in range(5)]  # fewer than centroids, and equal ones
    assert by_all(vafile.vafile_clusters(spark.createDataFrame(rows, VECTORS)).collect()) == by_all(plain_clusters([r[:2] for r in rows]))
    huge = vafile.vafile_clusters(spark.createDataFrame([(1, [1e30] * 64, 0), (2, [0.0] * 64, 0)], VECTORS)).collect()
    assert [(r.vec_id, r.distance) for r in huge] == [(2, 0)]  # left out: no long holds its distances


def test_cells_bound_every_distance():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-40, 40, (500, 16)), rng.integers(-4000, 4000, (5, 16))])
    low = np.sort(np.concatenate([np.full((16, 1), x.min()), rng.integers(-40, 40, (16, 7))], axis=1), axis=1)
    high = np.maximum(np.concatenate([low[:, 1:] - 1, np.full((16, 1), x.max())], axis=1), low)
    codes, c = vafile.cell_codes(x, low), x[:6]
    assert (vafile.unpacked(vafile.packed(codes, 3), 3, 16) == codes).all()
    least, most = vafile.lookup(c, low, high)
    true = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (sum(least[d][codes[:, d]] for d in range(16)) <= true).all() and (true <= sum(most[d][codes[:, d]] for d in range(16))).all()
    assert vafile.judged(codes, least, most)[np.arange(len(x)), true.argmin(1)].all()


def plain_balance(lengths, capacity, hidden):
    """Every sequence is looked at for every piece."""
    sizes = balanced.room(sum(lengths), capacity)
    free, total, out = list(sizes), [0.0] * len(sizes), []
    for n in lengths:
        places = []
        while n:
            fits = [(total[s], free[s], s) for s in range(len(sizes)) if free[s] >= n]
            if fits:
                s, part = min((t, f, s) for t, f, s in fits)[2], n
            else:
                most = max(free)
                s, part = min((total[s], s) for s in range(len(sizes)) if free[s] == most)[1], most
            places.append((s, sizes[s] - free[s], part))
            free[s], total[s], n = free[s] - part, total[s] + balanced.cost(part, hidden), n - part
        out.append(places)
    return out


def test_balance_equals_a_plain_search():
    rng = np.random.default_rng(3)
    for capacity, hidden in ((64, 8), (1024, 4096)):
        lengths = sorted(rng.integers(1, capacity, 200).tolist() + [7] * 20, reverse=True)
        assert balanced.balanced(lengths, capacity, hidden) == plain_balance(lengths, capacity, hidden)


def test_packed_documents_are_whole_and_unpadded(spark):
    from tidemark.llm.packing import encoder

    encode = encoder()
    texts = {i: "word " * (i * 37 % 900) + "tail" for i in range(120)} | {200: None, 201: "", 202: "ab " * 30_000}
    rows = [(i, t, "en", "s", 0, "x") for i, t in texts.items()] + [(300, "same text", "en", "s", 0, "x")] * 50
    got = balanced.pack_balanced(spark.createDataFrame(rows, DOCS).repartition(5), tokens_a_group=20_000).collect()
    ids = {i: np.append(encode(t or ""), np.uint32(0)).astype("<u4") for i, t in texts.items()}
    for i, want in ids.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == want.tolist()
        assert all(r.doc_tokens == len(want) and r.length == len(r.ids) // 4 for r in own)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    same = len(encode("same text")) + 1
    assert sum(r.length for r in got if r.doc_id == 300) == 50 * same
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    full = []
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        used = sum(r.length for r in own)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert used <= 1024 and used & (used - 1) == 0  # full, or a power of two: nothing is padded
        if used == 1024 and own[0].sequence_id >= 0:
            full.append(sum(r.piece_cost for r in own))
    assert max(full) <= 1.06 * min(full)
    assert balanced.pack_balanced(spark.createDataFrame([], DOCS)).collect() == []
    nulls = balanced.pack_balanced(spark.createDataFrame([(None, None, None, None, None, None)], DOCS)).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens) for r in nulls] == [(None, 0, 1, 1)]


# ------------------------------------------------ earlier operators: ties, long texts, hot keys


def test_nearest_keeps_the_smallest_ids_among_ties(spark):
    from tidemark.llm.nearest import nearest

    rng = np.random.default_rng(8)
    x = rng.choice([-1.0, 1.0], (300, 16))  # few different scores, so most ranks are ties of different vectors
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(v, v.filter("vec_id % 20 = 0"), k=20, recall=1.0, epsilon=50.0, chunk=64).collect()
    want = []
    for q in range(0, 300, 20):
        best = sorted((-float(x[q] @ x[i]), i) for i in range(300) if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_secrets_of_a_long_text_without_blanks():
    import re
    import time

    from tidemark.llm.secrets import base_spans, candidates, keyed

    plain = re.compile(r"(?i:key|pwd|pass|auth|bearer|credential|private)[a-z_]*[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{8,})", re.ASCII)
    rng = np.random.default_rng(2)
    bits = ["key", "KEY", "pass", "_", "k", "EY", "auth", "x", "=", ":", " ", "'", "abcdefgh", "12345678", "privat", "e", "credentia", "l"]
    for _ in range(3000):
        text = "".join(rng.choice(bits, 12))
        assert keyed(text) == [m.span(1) for m in plain.finditer(text)], text
    began = time.time()
    for word in ("key", "pass_", "auth", "kEY", "private key "):
        text = word * (1_000_000 // len(word))
        candidates(text, base_spans(text))
    assert time.time() - began < 20


def test_hot_keys_join_by_broadcast(spark):
    from tidemark.llm.common import attached
    from tidemark.llm.components import components

    rows = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(2000)], "k long, v long")
    names = rows.groupBy("k").agg(F.count("v").alias("members"), F.max("v").alias("top"))
    got = {(r.k, r.v): r.top for r in attached(rows, names, ["k"]).collect()}
    assert len(got) == 2000 and all(top == (1999 if k == 0 else v) for (k, v), top in got.items())
    star = spark.createDataFrame([(5000, i) for i in range(2000)] + [(9000 + i, 9001 + i) for i in range(40)], "a long, b long")
    label = {r.node: r.component for r in components(star).collect()}
    assert all(label[i] == 0 for i in [*range(2000), 5000]) and all(label[9000 + i] == 9000 for i in range(41))


def test_pieces_of_one_row_spread(spark):
    from tidemark.llm.packing import pack_documents

    rows = [(1, "word " * 40_000)] + [(2, "same")] * 300
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=16, pieces_a_task=400)
    tasks = {r.sequence_id >> 32 for r in got.filter("doc_id = 1").select("sequence_id").distinct().collect()}
    assert len(tasks) > 3 and got.groupBy("doc_id").agg(F.sum("length").alias("n")).filter("doc_id = 2").first().n == 600


def test_the_pipeline_leaves_only_its_result(spark):
    from pathlib import Path

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("tidemark-*"))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and len(set(shared.glob("tidemark-*")) - before) == 1
