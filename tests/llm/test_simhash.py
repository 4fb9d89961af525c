import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash as S


def brute_components(fps, max_bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_hand():
    for text in ("", None, "one", "One TWO", "a b c d e f g", "é É x\ty\x0bz"):
        assert S.fingerprint(S.shingle_hashes(S.tokens_of(text), 3)) == brute_fingerprint(text)


def test_allotment_is_least_and_keeps_the_sum():
    rng = random.Random(1)
    cost = [[rng.random() for _ in range(6)] for _ in range(4)]
    best, ts = S.allot(cost, 5)
    import itertools

    every = min(sum(cost[i][t + 1] for i, t in enumerate(c)) for c in itertools.product(range(-1, 5), repeat=4) if sum(c) == 5)
    assert best == pytest.approx(every) and sum(ts) == 5


def test_pairs_by_distance():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, 32)
    want = np.zeros(6)
    for a in range(32):
        for b in range(a, 32):
            want[bin(a ^ b).count("1")] += counts[a] * (counts[a] - 1) / 2 if a == b else counts[a] * counts[b]
    assert np.allclose(S.pairs_by_distance(counts), want)


@pytest.mark.parametrize("max_bits", [0, 3, 7, 12])
@pytest.mark.parametrize("hot", [50_000, 3])
def test_links_against_all_pairs(spark, monkeypatch, max_bits, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(max_bits)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in centres for _ in range(20)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {tuple(sorted((r.src, r.dst))) for r in S.near_links(df, max_bits, pairs=True).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    assert got == {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= max_bits}


@pytest.mark.parametrize("hot", [50_000, 3])
def test_links_across_batches(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(8)
    high = [rng.getrandbits(32) << 32 for _ in range(4)]
    fps = sorted({int(np.uint64(h | 1 << rng.randrange(32) | 1 << rng.randrange(32)).astype(np.int64)) for h in high for _ in range(30)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        # One group of a threshold in which many fingerprints are equal, and one that is not probed.
        for threshold in (0, 1):
            monkeypatch.setattr(S, "make_plan", lambda *a, t=threshold: ([list(range(32)), list(range(32, 64))], [t, -1], 30))
            got = {tuple(sorted((r.src, r.dst))) for r in S.near_links(df, 4, pairs=True).collect()}
            assert got == {tuple(sorted((a, b))) for a in fps for b in fps if a != b and a >> 32 == b >> 32 and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_components_against_all_pairs(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(2, 400))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(w if rng.random() > 0.004 else "zz" for w in b) for b in base for _ in range(3)] + ["", None, "w1"]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {i * 3: (f"{fps[i]:016x}", want[i] * 3) for i in range(len(texts))}


def jaccard_groups(texts, size=5, least=0.8):
    sets = [frozenset(S.shingle_hashes(S.tokens_of(t), size).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(texts))}


@pytest.mark.parametrize(("block", "bits", "dense"), [(4000, 6, 50), (6, 6, 2), (4000, 0, 2)])
def test_one_of_each_against_all_pairs(spark, monkeypatch, block, bits, dense):
    monkeypatch.setattr(S, "BLOCK_TEXTS", block)
    monkeypatch.setattr(S, "DENSE", dense)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 300))] for _ in range(12)]
    texts = [" ".join(b) for b in base] * 2
    texts += [" ".join(w if rng.random() > rate else "zz" for w in b) for b in base for rate in (0.005, 0.01, 0.1)]
    texts += [" ".join([*base[0][:k], "q", *base[0][k:]]) for k in range(0, 60, 3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id for r in S.one_of_each(docs, max_bits=bits).collect()}
    assert got == jaccard_groups(texts)


def random_words(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def near_copy(rng, words, kind):
    """A copy whose 5-word shingles are about 0.8 to 0.9 similar."""
    n = len(words)
    cut = max(1, int(n * rng.uniform(0.1, 0.2)))
    if kind == "appended":
        return [*words, *random_words(rng, cut)]
    if kind == "truncated":
        return words[: n - cut]
    if kind == "block":
        at, cut = rng.randrange(n - cut // 2), max(1, cut // 2 - 4)
        return [*words[:at], *random_words(rng, cut), *words[at + cut :]]
    if kind == "scattered":
        at = set(rng.sample(range(n), max(1, n // 55)))
        return [random_words(rng, 1)[0] if i in at else w for i, w in enumerate(words)]
    return [*words, *words[: n // 4] * rng.randrange(2, 9)]  # repeated lines: the same shingles more often


def copies(seed):
    rng = random.Random(seed)
    texts, pairs = [], 0
    for kind in ("appended", "truncated", "block", "scattered", "repeated"):
        for n in (20, 60, 200, 600, 1200):
            for _ in range(12):
                words = random_words(rng, n)
                texts += [" ".join(words), " ".join(near_copy(rng, words, kind))]
                a, b = (set(S.shingle_hashes(S.tokens_of(t), 5).tolist()) for t in texts[-2:])
                pairs += len(a & b) >= 0.8 * len(a | b)
    return texts, pairs


def test_every_kind_of_near_copy_is_found(spark):
    texts, pairs = copies(3)
    assert pairs > 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in S.one_of_each(docs).collect()}
    want = {i for i in range(len(texts)) if i % 2 == 0 or not alike(texts[i - 1], texts[i])}
    assert got == want and len(texts) - len(want) == pairs


def alike(a, b):
    a, b = (set(S.shingle_hashes(S.tokens_of(t), 5).tolist()) for t in (a, b))
    return len(a & b) >= 0.8 * len(a | b)


def test_links_within_blocks():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)))) for _ in range(60)] + [base[:0]]
    whole = {(i, j) for i in range(61) for j in range(i + 1, 61) if S.similar(sets[i], sets[j], 0.8)}
    assert 10 < len(whole) < 1700
    for blocks in (np.zeros(61, int), np.arange(61) % 2):
        pairs = {(i, j) for i, j in whole if len(set(blocks.tolist())) == 1 or blocks[i] != blocks[j]}
        a, b = S.links_within(sets, blocks, 0.8)
        x, y = S._forest(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(x.tolist(), y.tolist(), strict=True))


def test_many_long_copies_of_few_texts(spark, monkeypatch):
    """Copies whose shingles, summed, were once beyond a block's while the texts were not."""
    monkeypatch.setattr(S, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(S, "DENSE", 3)
    rng = random.Random(4)
    base = random_words(rng, 200)
    texts = [" ".join([*base[:k], "q", *base[k:]]) for k in range(0, 200, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in S.one_of_each(docs).collect()] == [0]


def test_similar_pairs_among_many_less_similar_texts(spark, monkeypatch):
    """Texts that share most of a template, which only some similar pairs stand out from: by clusters in several blocks."""
    monkeypatch.setattr(S, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(S, "DENSE", 5)
    rng = random.Random(6)
    base, texts = random_words(rng, 200), []
    for _ in range(40):
        at = rng.randrange(180)
        texts.append(" ".join([*base[:at], *random_words(rng, 18), *base[at + 18 :]]))
    texts += [" ".join(near_copy(rng, t.split(), "appended")) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = jaccard_groups(texts)
    assert 3 < len(want) < 60
    assert {r.doc_id for r in S.one_of_each(docs).collect()} == want
