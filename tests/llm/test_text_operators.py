"""The text operators against brute force, round trips and held-out accuracy, with odd rows in every one."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def corpus(n=120, seed=1):
    """Documents with copies, near copies, a shared passage, nulls, blanks and a very long text."""
    rng, out = random.Random(seed), []
    passage = " ".join(rng.choices(WORDS, k=30))
    base = rng.choices(WORDS, k=60)
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(1, 80))
        if i % 7 == 1 and out:
            text = out[i // 2][1]
        elif i % 5 == 2:
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(60)] = rng.choice(WORDS)
            text = " ".join(words)
        else:
            text = " ".join(words) + ("\n" + passage if i % 3 == 0 else "")
        out.append((i, text, "en", f"s{i % 4}" if i % 3 else "s0", len(text or "")))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \t\n", "en", "s1", 3), (n + 3, "one", "en", None, 3), (n + 4, " ".join(WORDS * 40), "en", "s2", None), (n + 5, "Ünï  cödé\x1cword " * 9, "fr", "s3", 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).withColumns({"key": F.lit("x"), "n": F.lit(1), "score": F.lit("y"), "words": F.lit(2)}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --------------------------------------------------------------- 6


def components(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(t)]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (2, 60)])
def test_jaccard_equals_brute_force(docs, size, percent):
    from tidemark.llm.jaccard import jaccard_components

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, size, percent).collect()}
    assert got == components(corpus(), size, percent)


def test_jaccard_through_pairs_of_frequent_shingles(spark, monkeypatch):
    """Near copies in such number that all their shingles are frequent, and blocks so small that they are split."""
    from tidemark.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    rng = random.Random(3)
    base, rows = rng.choices(WORDS, k=120), []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(120)] = rng.choice(WORDS)
        rows.append((i, " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(rows, DOC).repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 4, 85).collect()}
    assert got == components(rows, 4, 85)


@pytest.mark.parametrize("batch", ["12", "10000"])
def test_jaccard_with_a_key_in_all_sets(spark, batch):
    """One passage in every document, long within a batch, between batches or both; equal ids of large groups."""
    from tidemark.llm.jaccard import jaccard_components

    rng, passage = random.Random(8), [f"p{i}" for i in range(40)]
    rows = []
    for i in range(150):
        own = rng.choices(WORDS, k=rng.choice([0, 2, 5, 30]))
        rows.append((i, " ".join(passage[: rng.choice([40, 40, 38])] + own), "en", "s", 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, DOC).repartition(2), 4, 85).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == components(rows, 4, 85) and len({c for _, c in got.values()}) > 5


def test_prefixes_of_linked_sets_share_a_key():
    from tidemark.llm.jaccard import index_keys, linked

    rng = np.random.default_rng(0)
    universe = np.unique(rng.integers(0, 2**64, 4000, np.uint64))
    often = set(universe[::2].tolist())
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = rng.choice(universe, n, replace=False)
        drop, add = int(rng.integers(0, max(1, n // 5))), int(rng.integers(0, max(1, n // 5)))
        b = np.concatenate([a[drop:], rng.choice(universe, add, replace=False)])
        a, b = np.unique(a), np.unique(b)
        if len(b) and linked(a, b, 85) and not np.array_equal(a, b):
            ka, kb = (index_keys(x[[v not in often for v in x.tolist()]], x[[v in often for v in x.tolist()]], 85) for x in (a, b))
            assert len(np.intersect1d(ka, kb))


def test_jaccard_odd_rows(spark, empty):
    from tidemark.llm.jaccard import jaccard_components

    assert jaccard_components(empty).count() == 0
    twice = spark.createDataFrame([(5, "a b", "", "", 1), (5, "a b", "", "", 1), (None, "a b", "", "", 1), (None, None, "", "", 1)], DOC)
    assert sorted(map(str, jaccard_components(twice).collect())) == sorted(["Row(doc_id=5, n_shingles=1, component_id=5)"] * 2 + ["Row(doc_id=None, n_shingles=1, component_id=5)", "Row(doc_id=None, n_shingles=0, component_id=None)"])


# --------------------------------------------------------------- 3


@pytest.mark.parametrize("small", [False, True])
def test_katz_is_normalised_and_equals_brute_force(docs, monkeypatch, small):
    """small: nearly all histories are split by word, and most words are outside the broadcast head."""
    from tidemark.llm import katz
    from tidemark.llm.katz import K, discounts, katz_scores

    if small:
        monkeypatch.setattr(katz, "LEAST_HOT", 3)
        monkeypatch.setattr(katz, "PARTITION", 300)
        monkeypatch.setattr(katz, "HEAD", 9)

    rows = corpus()
    train = [r for r in rows if r[0] % 5]
    toks = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(t)] + [""]
    uni, bi = Counter(), Counter()
    for r in train:
        t = toks(r[1])
        uni.update(t)
        bi.update(zip([None, *t], t))
    n, v = sum(uni.values()), len(uni)

    def gt(counts):
        of = Counter(counts.values())
        return discounts(np.array([0, *(of[r] for r in range(1, K + 2))], float))

    du, db = gt(uni), gt(bi)
    d = lambda ds, c: c * (ds[c] if c <= K else 1.0)
    kept = sum(d(du, c) for c in uni.values())
    total = n if n - kept > 1e-9 * n else n + 1
    p = {w: d(du, c) / total for w, c in uni.items()}
    unk = 1 - sum(p.values())
    hist = defaultdict(dict)
    for (h, w), c in bi.items():
        hist[h][w] = c

    def model(h):
        f = hist[h]
        count, free = sum(f.values()), sum(c - d(db, c) for c in f.values())
        total = count + 1 if free <= 1e-9 else count
        alpha = (1.0 if free <= 1e-9 else free) / total / (1 - sum(p[w] for w in f))
        return f, total, alpha

    def prob(h, w):
        if h not in hist:
            return p.get(w, unk)
        f, total, alpha = model(h)
        return d(db, f[w]) / total if w in f else alpha * p.get(w, unk)

    for h in list(hist)[:20]:
        assert abs(sum(prob(h, w) for w in p) + prob(h, "\x00never") - 1) < 1e-9
    got = {r.doc_id: r for r in katz_scores(docs, F.col("doc_id") % 5 != 0).collect()}
    assert len(got) == len(rows)
    for r in rows:
        t = toks(r[1])
        g = got[r[0]]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (r[0] % 5 == 0, len(t), sum(w in uni for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert g.score == pytest.approx(sum(math.log10(prob(h, w)) for h, w in zip([None, *t], t)))


def test_katz_odd_rows(spark, empty):
    from tidemark.llm.katz import katz_scores

    assert katz_scores(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b", "", "", 1), (1, "a b", "", "", 1), (None, None, "", "", 1)], DOC)
    got = katz_scores(one, F.lit(False)).collect()
    assert len(got) == 3 and all(r.held_out and r.train_tokens == 0 and r.base_score == 0 for r in got)


# --------------------------------------------------------------- 1


def test_quality_learns_and_keeps_rows(spark, empty):
    from tidemark.llm.quality import fit_quality, score_quality

    rng = random.Random(5)
    good = [(i, " ".join(rng.choices(WORDS, k=60)), "en", "s", 300) for i in range(150)]
    bad = [(1000 + i, " ".join([rng.choice(WORDS).upper() + "!!"] * 60), "en", "s", 300) for i in range(60)]
    df = spark.createDataFrame([*good, *bad, (None, None, None, None, None), (7777, "", "", "", 0)], DOC).withColumn("at", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad if r[0] % 3] + [(2, None), (3, 9)], "doc_id long, quality int")
    blob = fit_quality(df, labels)
    got = {r.doc_id: r for r in score_quality(df, blob).collect()}
    held = [i for i in got if i is not None and i % 3 == 0 and i != 7777]
    assert sum((got[i].score >= 0.5) == (i < 1000) for i in held) / len(held) > 0.95
    assert len(got) == 212 and got[None].at == "clash" and 0 <= got[None].score <= 1
    assert score_quality(empty, blob).count() == 0
    none = score_quality(df, fit_quality(df, labels.filter("doc_id < 0"))).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_pairwise_identity():
    from tidemark.llm.quality import Machine, joined

    m = Machine(seed=3)
    at, x = np.array([1, 5, 900]), np.array([0.5, -1.0, 2.0])
    direct = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert m.margins(*joined([(at, x)]))[0][0] == pytest.approx(direct)


def test_quality_scores_equal_a_plain_loop(spark, docs):
    """Every score against the double sum over pairs, features made again from the text."""
    from tidemark.llm import quality as q

    m = q.Machine(seed=3)
    m.w = np.random.default_rng(1).normal(0, 0.3, len(m.w))
    m.bias[:] = 0.2
    blob = m.blob()
    m = q.Machine(blob=blob)
    got = {r.doc_id: r.fm for r in q.score_quality(docs, blob, "fm").collect()}
    sizes = {i: n for i, _, _, _, n in corpus()}
    for i, text, *_ in corpus()[::9] + corpus()[-6:]:
        pairs = list(zip(*q.features(text, sizes[i])))
        if len(pairs) > 400:
            continue
        z = m.bias[0] + sum(m.w[a] * v for a, v in pairs)
        z += sum(float(m.v[a] @ m.v[b]) * v * w for k, (a, v) in enumerate(pairs) for b, w in pairs[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)


def test_quality_fit_ignores_the_order_of_rows(spark):
    from tidemark.llm.quality import fit_quality

    rng = random.Random(4)
    rows = [(i // 2, " ".join(rng.choices(WORDS, k=20)), "en", "s", 100 + i % 2) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = (fit_quality(spark.createDataFrame(x, DOC).repartition(n), labels, shards=1, rounds=1, epochs=1) for x, n in ((rows, 1), (rows[::-1], 3)))
    assert one == two


# --------------------------------------------------------------- 2


def test_warc_round_trip(spark):
    from tidemark.llm.common import scratch
    from tidemark.llm.warc import read_archives, write_archives

    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    big = "x" * 1500
    pages = [(1, "http://a/\r\nx", "plain"), (2, None, None), (3, "u", ""), (4, "u", big), (5, "u", big), (6, "u", big + "é"), (7, "u", "a" + fake + "b" + fake), (8, "u", "WARC/1.1\r\n"), (9, "u", "plain"), (None, "u", "null id"), (10, "u", "x\r\n\r\ny"), (11, "u", big)]
    pages += [(100 + i, "u", f"<p>{i}</p>" * (i % 50)) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("value", F.lit("clash"))
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        top = max((j for j, _, g in pages if j is not None and (g or "") == (h or "")), default=None)
        again = len(body) >= 1000 and i is not None and i < top
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    for split_bytes in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        try:
            path = scratch(spark)
            write_archives(df.repartition(2), path)
            read = read_archives(spark, path)
            # files cut otherwise when the result is made than when they were first read
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1100")
            got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(map(str, got)) == sorted(map(str, want))
    path = scratch(spark)
    write_archives(df.limit(0), path)
    assert read_archives(spark, path).count() == 0


# --------------------------------------------------------------- 4


def test_secret_spans(spark, empty):
    from tidemark.llm import secrets

    rng = random.Random(2)
    texts = [None, "", "password=abcdefghijkl12 x", "secret: token: abcdefghijklmnop", "API-KEY apikey = 'ABCDEFGHIJKLMNOP'", "AKIA" + "A" * 14 + " AKIAB", "é0123456789abcdef0", "token=token=abcdefghijkl", "x" * 100_000 + " deadbeefdeadbeef"]
    texts += [f"some words {rng.randrange(10**15, 10**16):x} and host mail{rng.randrange(9)}.example-{rng.randrange(99)}.com here" for _ in range(80)]
    df = spark.createDataFrame([(i, t, "", "", 1) for i, t in enumerate(texts)], DOC)
    patterns = [r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    for i, t in enumerate(texts):
        spans = []
        for k, (p, least) in enumerate(zip(patterns, (12, 18, 16))):
            spans += [(m.start(), k, m.end()) for m in re.finditer(p, t or "", re.ASCII) if len(m[1] if k == 0 else m[0]) >= least]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    assert secrets.scan_secrets(empty).count() == 0


def test_network_learns_and_keeps_recall():
    from tidemark.llm.secrets import Network, window

    rng = random.Random(4)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=32))
    host = lambda: f"mail{rng.randrange(9)}.{rng.choice(WORDS)}example{rng.randrange(99)}.com"
    made = [(f"and here {s()} end", y) for s, y in ((key, 1), (host, 0)) for _ in range(300)]
    views = [window(t, 9, len(t) - 4) for t, _ in made]
    y = np.array([v for _, v in made], float)
    part = np.arange(len(y)) % 2 == 0
    net = Network()
    net.fit([v for v, p in zip(views, part) if p], y[part], 200)
    net.calibrate([v for v, p in zip(views, part) if not p], y[~part], 0.99)
    p = net.probability(net.margins([v for v, q in zip(views, part) if not q]))
    assert (p[y[~part] == 1] >= net.threshold).mean() >= 0.99 and (p[y[~part] == 0] >= net.threshold).mean() < 0.05


def test_secret_candidates_are_whole_and_of_every_kind():
    from tidemark.llm import secrets

    text = "x " + "a/" * 40 + "Q7" * 30 + " lettersonlykeyabc"
    (s, e, _), (s2, e2, _) = secrets.candidates(text, [])
    assert (text[s2:e2], e - s) == ("lettersonlykeyabc", 140)
    views = secrets.windows(text, s, e)
    assert all(len(v) == secrets.WIDTH for v in views)
    inside = [v[secrets.LEFT : secrets.LEFT + secrets.INSIDE] for v in views]
    assert all(any(text[k : k + secrets.STEP] in v for v in inside) for k in range(s, e - secrets.STEP + 1, secrets.STEP))
    assert text[e - secrets.INSIDE : e] == inside[-1]
    assert [len(secrets.windows("y" * n, 0, n)) for n in (8, 48, 49, 72, 73)] == [1, 1, 2, 2, 3]


def test_secret_behind_48_characters_is_scored(spark):
    from tidemark.llm import secrets

    rng = random.Random(4)
    key = lambda: f"{rng.randrange(16**20):020x}"
    texts = [f"token={key()} end" for _ in range(300)] + [f"see path/of/many/ordinary/words/{rng.choice('abcdef')}/{rng.choice('ghij')}/here now" for _ in range(300)]
    late = "path/of/many/ordinary/words/and/more/ordinary/words/in/it/token=" + "G".join(key()[:10] for _ in range(5))
    df = spark.createDataFrame([*enumerate(texts), (1000, f"see {late} now")], "doc_id long, text string")
    assert not secrets.base_spans(late.replace("token=", "")) and secrets.window(late, 0, len(late))[secrets.LEFT :].find("token") < 0
    net = secrets.fit_network(secrets.findings(df))
    views = secrets.windows(late, 0, len(late))
    assert net.scores([views])[0] > 0.9 > 0.1 > net.scores([views[:1]])[0]


def test_kth_smallest_is_exact(spark):
    from tidemark.llm.secrets import smallest

    rng = random.Random(8)
    z = [round(rng.random(), 3) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in z], "z double").repartition(5)
    for k in (0, 50, 2500, 4999):
        assert smallest(df, k, len(z), 100) == sorted(z)[k]



def test_secrets_of_many_findings_in_a_long_text():
    from tidemark.llm import secrets

    line = "password=abcdefghijkl12 someordinaryword 0123456789abcdef0 another-long-token-here\n"
    text = line * (10_000_000 // len(line))
    began = time.time()
    base = secrets.base_spans(text)
    found = secrets.candidates(text, base)
    assert len(base) == 2 * text.count("\n") and len(found) == 2 * len(base) and time.time() - began < 30
    few = secrets.candidates(line * 3, secrets.base_spans(line * 3))
    brute = [(m.start(), m.end()) for m in secrets.TOKEN.finditer(line * 3) if not any(s < m.end() and m.start() < e for s, _, e in secrets.base_spans(line * 3))]
    assert [(s, e) for s, e, k in few if k < 0] == brute


def test_network_finds_kinds_it_never_saw(spark):
    """Learned from the base patterns, it finds keys that none of them match, and leaves long ordinary words alone."""
    from tidemark.llm import secrets

    rng = random.Random(12)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    low, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [f"the words token={pick(alnum, 28)} and {pick('0123456789abcdef', 32)} stand in it" for _ in range(300)]
    rows += [f"ordinary {pick(low, 14)} words and {'-'.join(pick(low, 5) for _ in range(4))} and www.{pick(low, 9)}.org/{pick(low, 6)} here" for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    net = secrets.fit_network(secrets.findings(df))
    unseen = [f"we wrote {pick(alnum, 30)} on the board" for _ in range(60)]
    plain = [f"we wrote {pick(low, 13)}-{pick(low, 7)} on www.{pick(low, 11)}.org/{pick(low, 4)} once" for _ in range(60)]
    hits = [[net.scores([secrets.windows(t, s, e) for s, e, _ in secrets.candidates(t, [])]).max() >= net.threshold for t in texts] for texts in (unseen, plain)]
    assert sum(hits[0]) >= 48 and sum(hits[1]) <= 6
    assert sum(r.n_network > 0 for r in secrets.scan_secrets(df).collect()) <= 20
    n, hit = secrets.kind_recall(df, 2)
    assert n >= 300 and 0 <= hit <= n


# --------------------------------------------------------------- 5


def test_mixing_shares_and_order(spark, docs, empty):
    from tidemark.llm.mixing import curriculum, training_order

    mixed = curriculum(docs, buckets=8).cache()
    rows = mixed.collect()
    size = {r.doc_id: len(split(t)) for r, t in ((r, r.text) for r in rows)}
    per, taken = Counter(), Counter()
    for r in rows:
        assert r.mix_size == size[r.doc_id] and 0 <= r.mix_taken <= 3 * r.mix_size and sum(c.words for c in r.mix_copies) == r.mix_taken
        assert all(0 <= c.position <= 1 for c in r.mix_copies)
        per[r.source] += r.mix_size
        taken[r.source] += r.mix_taken
    names = sorted([s for s in per if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(per.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * per[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * per[s] for s in over}
        free -= over
        left -= sum(3 * per[s] for s in over)
        if not free:
            break
    for r in rows:
        assert r.mix_target == pytest.approx(target[r.source]) and r.mix_source_size == per[r.source]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    uses = training_order(mixed).collect()
    ordered = [r.position for r in uses]
    assert ordered == sorted(ordered) and len(ordered) == sum(len(r.mix_copies) for r in rows)
    text = {r.doc_id: r.text for r in rows}
    assert all(text[r.doc_id].startswith(r.text) for r in uses) and sum(len(split(r.text)) for r in uses) == sum(taken.values())
    assert any(0 < len(split(r.text)) < r.mix_size for r in uses)
    fine = curriculum(docs, buckets=8, rows_a_bucket=1).select("doc_id", "mix_taken").collect()
    assert sorted(map(str, fine)) == sorted(map(str, mixed.select("doc_id", "mix_taken").collect()))
    again = {r.doc_id: r.mix_copies for r in curriculum(docs.repartition(7), buckets=8).collect()}
    assert again == {r.doc_id: r.mix_copies for r in rows}
    assert curriculum(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "", "a", 1), (2, " ", "", None, 1), (2, " ", "", None, 1)], DOC)
    assert [(r.mix_taken, r.mix_target, len(r.mix_copies)) for r in curriculum(blank).collect()] == [(0, 0.0, 0)] * 3


def test_mixing_of_thousands_of_sources(spark):
    from tidemark.llm.mixing import curriculum

    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 9)), "", f"s{i % 3000:05d}", 1) for i in range(6000)]
    got = curriculum(spark.createDataFrame(rows, DOC)).groupBy("source").agg(F.sum("mix_taken").alias("taken"), F.max("mix_target").alias("target"), F.max("mix_source_size").alias("size")).collect()
    assert len(got) == 3000 and all(abs(r.taken - r.target) <= 1 and r.target <= 3 * r.size + 1e-6 for r in got)
    assert sum(r.target for r in got) == pytest.approx(sum(r.size for r in got))


def test_place_inverts_the_integral(spark):
    from tidemark.llm.mixing import place

    for knots in (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.3, 2.0), (1.0, 0.5))):
        def done(t):
            a = 0.0
            for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
                x = min(max(t - t0, 0.0), t1 - t0)
                a += m0 * x + (m1 - m0) / (t1 - t0) * x * x / 2
            return a

        for r in spark.range(21).select((F.col("id") / 20).alias("u"), place(F.col("id") / 20, knots).alias("t")).collect():
            assert done(r.t) / done(1.0) == pytest.approx(r.u, abs=1e-9)


# ------------------------------------------------------------- 7, 8


def test_line_rules(spark, docs, empty):
    from tidemark.llm.line_frequency import line_frequency_rules

    rows = [(i, f"common line here\nown words number {i} " + " ".join(WORDS[i : i + 25]), "", "h", 1) for i in range(30)]
    rows += [(100, "common line here\n" * 9 + "rest", "", "h", 1), (101, " ".join(["a b c d e f g h i"] * 5), "", None, 1), (102, None, "", "h", 1)]
    got = {r.doc_id: r for r in line_frequency_rules(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i].kept and got[i].n_host_words == 3 for i in range(30))
    assert not got[100].kept and got[100].n_dup_lines == 8 and got[100].n_host_words == 27
    assert got[101].n_repeat_words == 45 and got[101].base_failed and not got[101].kept
    assert got[102].base_failed and got[102].n_words == 0 and got[102].text is None
    assert got[5].text == rows[5][1].split("\n")[1] and got[100].text == "rest" and got[101].text == rows[31][1]
    assert {r.n_symbols for r in line_frequency_rules(spark.createDataFrame([(1, "a # b * $ <x> | & % é", "", "h", 1)], DOC)).collect()} == {8}
    # rows of one id, and rows without one, are judged each by its own lines
    twins = rows + [(5, " ".join(WORDS[40:65]), "", "h", 1), (None, "common line here\n" + " ".join(WORDS[:25]), "", "h", 1), (None, " ".join(WORDS[3:28]), "", "h", 1)]
    two = [(r.doc_id, r.n_words, r.n_host_words, r.kept) for r in line_frequency_rules(spark.createDataFrame(twins, DOC)).collect() if r.doc_id in (5, None)]
    assert sorted(two, key=str) == sorted([(5, 32, 3, True), (5, 25, 0, True), (None, 28, 3, True), (None, 25, 0, True)], key=str)
    for r in line_frequency_rules(docs).collect():
        text = next(t for i, t, *_ in corpus() if i == r.doc_id)
        w = split(text)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
    assert line_frequency_rules(empty).count() == 0


def test_line_dedup_keeps_the_first_and_counts_exactly(spark, docs, empty):
    from tidemark.llm.line_spread import line_dedup

    rows = [(i, f"Shared  LINE\nown {i}\n\nrare", "", f"s{i}", 1) for i in range(5)] + [(9, None, "", None, 1), (10, "shared line", "", None, 1)]
    df = spark.createDataFrame(rows, DOC).withColumn("h", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_cut_lines) for r in line_dedup(df, sites=6).collect()}
    assert got[0] == (rows[0][1], 0) and got[1] == ("own 1\n\nrare", 1) and got[9] == (None, 0) and got[10] == ("", 1)
    assert all(n == 0 for _, n in ((r.text, r.n_cut_lines) for r in line_dedup(df, sites=7).collect()))
    assert {r.doc_id: r.text for r in line_dedup(docs, sites=50).collect()} == {r[0]: r[1] for r in corpus()}
    assert line_dedup(empty).count() == 0


def test_line_spread_is_exact_around_the_threshold(spark):
    """Lines on 3 to 25 sites and a sketch of 16 buckets: estimates are far off, the counted band decides."""
    from tidemark.llm.line_spread import line_dedup

    rows = [(site * 100 + k, f"line {k} of many\nown {site} {k}", "", f"s{site}", 1) for k in range(3, 26) for site in range(k)]
    got = {r.doc_id: r.n_cut_lines for r in line_dedup(spark.createDataFrame(rows, DOC), sites=10, lg=4).collect()}
    assert got == {i: int(i % 100 >= 10 and i >= 100) for i, *_ in rows}


# --------------------------------------------------------------- 9


def test_packing(docs, empty, spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tidemark.llm.packing import pack_documents

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*((i, x) for i, x, *_ in corpus()), (900, "hello <|endoftext|> world"), (901, "<|endoftext|><|endoftext|>"), (902, "a <|endof <|endoftext|" * 30 + "<|endoftext|>")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(texts[-3:], "doc_id long, text string")).withColumn("at", F.lit("clash"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts}
    assert ids[900][2] == 50256
    got = pack_documents(docs, capacity=64, open_bins=8).collect()
    bins, own = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == part and 0 < r.length <= 64
        bins[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append((r.piece, r.start, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for i, pieces in own.items():
        pieces.sort()
        assert [p for p, *_ in pieces] == list(range(len(pieces))) and sum(n for *_, n in pieces) == len(ids[i])
        assert len(ids[i]) > 64 or len(pieces) == 1
        assert all(n == 64 for _, _, n in pieces[1:])
    assert len(own) == len(ids)
    assert len(bins) <= 1.15 * sum(map(len, ids.values())) / 64 + 4
    assert pack_documents(empty).count() == 0
    # pieces of a task are near each other in the order asked for
    ordered = pack_documents(docs.withColumn("p", -F.coalesce(F.col("doc_id"), F.lit(0))), capacity=64, pieces_a_task=100, order=F.col("p")).collect()
    spans = defaultdict(list)
    for r in ordered:
        spans[r.sequence_id >> 32].append(r.doc_id)
    ends = sorted((min(v), max(v)) for v in spans.values())
    assert len(ends) > 2 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert pack_documents(spark.createDataFrame([(None, " " * 50_000, "", "", 1), (1, None, "", "", 1), (1, None, "", "", 1)], DOC)).count() >= 3


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    from tidemark.llm.packing import best_fit

    bins, offsets = best_fit([60, 50, 40, 5], 100, 8)
    assert bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 60, 50]
    assert best_fit([60, 50, 40], 100, 1)[0].tolist() == [0, 1, 1]


# -------------------------------------------------------------- 10


def brute_lists(n):
    from tidemark.llm import nearest

    return int(min(nearest.LISTS_A_ROOT * n**0.5, n // 4))


def brute(vectors, k):
    want = {}
    for i, v in vectors.items():
        if i % 20 == 0:
            s = sorted(((-(v * w).sum(), j) for j, w in vectors.items() if j != i))[:k]
            want[i] = [j for _, j in s]
    return want


def test_nearest(spark):
    from tidemark.llm.nearest import nearest

    rng = np.random.default_rng(1)
    x = {i: rng.normal(size=24) * rng.uniform(0.5, 2) for i in range(800)}
    for i in range(100, 160):
        x[i] = x[100]
    rows = [(i, v.tolist()) for i, v in x.items()] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash"))
    want = brute(x, 20)
    exact = defaultdict(list)
    for r in nearest(df, df.filter("vec_id % 20 = 0"), 20, recall=1.0, chunk=64, epsilon=50.0).orderBy("query_id", "rank").collect():
        exact[r.query_id].append(r.vec_id)
    assert dict(exact) == want
    found = sum(r.vec_id in want[r.query_id] for r in nearest(df, df.filter("vec_id % 20 = 0"), 20).collect())
    assert found / (20 * len(want)) >= 0.9
    assert brute_lists(800) >= 30
    # repeated ids count once, with the least vector; other dimensions are a search of their own
    more = spark.createDataFrame([(0, [9.0] * 24), (7, [-99.0] * 24), (6000, [1.0, 2.0]), (6001, [2.0, 1.0]), (6020, [1.0, 1.0]), (6040, [3.0])], "vec_id long, embedding array<double>")
    y = {i: min(v.tolist(), [9.0] * 24) if i == 0 else v.tolist() for i, v in x.items()} | {7: [-99.0] * 24}
    want = brute({i: np.array(v) for i, v in y.items()}, 20)
    both, exact = df.select("vec_id", "embedding").union(more), defaultdict(list)
    for r in nearest(both, both.filter("vec_id % 20 = 0"), 20, recall=1.0, chunk=64, epsilon=50.0).orderBy("query_id", "rank").collect():
        exact[r.query_id].append(r.vec_id)
    assert dict(exact) == want | {6000: [6001, 6020], 6020: [6000, 6001]}
    few = df.filter("vec_id < 5")
    assert [(r.rank, r.vec_id) for r in nearest(few, few.filter("vec_id = 0"), 20).collect()] == [(i + 1, j) for i, j in enumerate(sorted(range(1, 5), key=lambda j: -(x[0] * x[j]).sum()))]
    assert nearest(df.filter("vec_id > 9000"), df, 20).count() == 0


# -------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        if name == "quality classifier":
            assert len({r.doc_id for r in docs.collect()} & bad) <= 0.1 * len(bad) + 1
    assert counts[0] == counts[1] >= counts[2] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= counts[-1]


def test_pipeline_odd_rows(spark, docs, empty):
    """Stages 2 to 5 against brute force on the corpus with nulls, blanks and long texts; all of them on no rows."""
    import corpus_pipeline as p

    rows = docs.select(*p.COLUMNS)
    texts = {i: t for i, t, *_ in corpus()}
    stages = dict(p.STAGES)
    sf = "/root/testdata/sf0.001"
    lines = stages["line dedup"](spark, rows, sf)
    assert {r.doc_id: r.text for r in lines.collect()} == texts
    kept = {r.doc_id for r in stages["n-gram Jaccard join"](spark, rows, sf).collect()}
    assert kept == {i for i, (_, c) in components(corpus(), 5, 80).items() if i == c}
    mixed = stages["mixing sources to target weights"](spark, rows, sf).collect()
    assert {r.doc_id for r in mixed} <= set(texts) and all(texts[r.doc_id].startswith(r.text) and split(r.text) for r in mixed)
    packed = stages["best-fit packing"](spark, rows, sf)
    assert packed.select("doc_id").distinct().count() == len(texts)
    for name, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a b", None, None, None), (1, "a b", "en", "s", 3)], DOC)
    for _, stage in p.STAGES:
        assert stage(spark, odd, sf).count() >= 0


def test_components(spark):
    from tidemark.llm.components import components as find

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (101, 100), *[(200, 200 + i) for i in range(1, 50)]], "a long, b long")
    got = {r.node: r.component for r in find(chain).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and all(got[200 + i] == 200 for i in range(50))
    assert find(chain.limit(0)).count() == 0
