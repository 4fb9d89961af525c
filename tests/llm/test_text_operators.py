"""Decontamination, mixing, language model, token files, token counts, media and classifier against plain Python."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from ledgerline.llm import decontam, lm, matroska, mixing, quality, token_count, urls, wavelet
from ledgerline.llm.common import connected_components


def sample(rng, n, size=80, vocabulary=60):
    return [" ".join(f"v{rng.randrange(vocabulary)}" for _ in range(rng.randrange(size))) for _ in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, k) for k in range(2001, 2300)] + [(5, None), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in list(root)}


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, t) for i, t in enumerate(sample(rng, 12, 40)) if t] + [(90, "Solo"), (91, "two words"), (92, "É x9 é"), (93, "")]
    docs = [t + " " + items[i % len(items)][1] + "! " + t for i, t in enumerate(sample(rng, 60, 200))] + ["solo", "TWO-words two words", None, "", "é x9 é É x9 é"]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[at : at + n])].add(str(i))
    want = []
    for i, t in enumerate(docs):
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[tuple(w[at : at + n])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in decontam.contamination(d, b).collect()) == want
    clean = {i for i, *_, bad in want if not bad}
    assert {r.doc_id for r in decontam.decontaminate(d, b).collect()} == clean
    cut = decontam.decontaminate(d, b, remove="spans")
    assert {r.doc_id: r.text for r in cut.collect() if r.doc_id in clean} == {i: docs[i] for i in clean}
    left = {r.doc_id: r.n_words for r in decontam.contamination(cut, b).collect()}
    assert all(left[i] == n - h for i, n, h, *_, bad in want if bad)


def test_mixing_reaches_targets_and_is_nested(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("x" * rng.randrange(1, 60)), f"s{min(rng.randrange(5), 3)}" if i % 11 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    assert sorted(got) == sorted(mixing.mix_report(docs.repartition(7)).collect())
    source = {r[0]: r[2] for r in rows}
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        s = source[r.doc_id]
        size[s] += r.size
        target[s] = r.target
        taken[s] += r.taken
        assert r.taken <= 2 * r.size and r.source_size > 0
    order = sorted(size, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_ = {}, set(order)
    while True:  # share what is left by weight; stop sources at twice their size
        left = 1.5 * sum(size.values()) - sum(want.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            break
        want |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    want |= share
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 40
    one = {r.doc_id for r in mixing.mix_report(docs, budget=0.5).where("taken > 0").collect()}
    two = {r.doc_id for r in mixing.mix_report(docs, budget=0.8).where("taken > 0").collect()}
    assert one < two
    assert mixing.mix(docs).count() == sum(r.taken // r.size for r in got)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(spark, order, monkeypatch):
    # Small blocks, parts and lanes, so that n-grams are asked for across blocks and documents are read in several lanes.
    for name, n in (("BLOCK_TOKENS", 900), ("PART_TOKENS", 700), ("SUMMED", 150), ("LANE", 9)):
        monkeypatch.setattr(lm, name, n)
    rng, mu = random.Random(6), 7.0
    texts = [*sample(rng, 70), None, "", "UNSEEN Unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = collections.Counter()
    tokens = {i: [*lm.tokens_of(t), lm.END] for i, t in enumerate(texts)}
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            s = [lm.START, *t]
            count[(lm.START,)] += 1
            for j in range(1, len(s)):
                for k in range(order):
                    if j - k >= 0:
                        count[tuple(s[j - k : j + 1])] += 1
    n = sum(len(t) for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10)
    v = sum(len(k) == 1 and k != (lm.START,) for k in count)
    for r in lm.score(docs, order, mu).collect():
        s, base, total = [lm.START, *tokens[r.doc_id]], 0.0, 0.0
        for j in range(1, len(s)):
            p = (count[(s[j],)] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(1, order):
                h = tuple(s[max(0, j - k) : j])
                if j - k >= 0 and count[h]:
                    p = (count[(*h, s[j])] + mu * p) / (count[h] + mu)
            total += math.log10(p)
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(s) - 1, n, not zlib.crc32(str(r.doc_id).encode()) % 10)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(total)


def test_wavelet_matrix():
    rng = np.random.default_rng(8)
    for n in (0, 1, 511, 512, 513, 3000):
        a = (rng.zipf(1.4, n) % 300).astype(np.uint32)
        m = wavelet.Shard(wavelet.to_bytes(a, [7] if n else [], np.array([n] if n else []))).ids
        assert (m.decode() == a).all() and [m[i] for i in range(0, n, 5)] == a[::5].tolist()
        for s in {*a[:6].tolist(), 999}:
            assert m.count(s) == (a == s).sum() and m.positions(s) == np.flatnonzero(a == s).tolist() and m.rank(s, n // 3) == (a[: n // 3] == s).sum()


def test_token_files(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 500)
    rng = random.Random(9)
    odd = ["a b c<|endoftext|>d  \t x́ y", "İSTANBUL ΣΑΣ Σ'S it's don't", "x<|startoftext|>", "", None, "​　é e\n\nÑ,ñ!", "a\r\nb\x0bc\x0c d\x85e", "日本語 \U0001f600", "Straße, GROSS. ÀÉ;"]
    texts = odd + sample(rng, 60)
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    t, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    ids = {}
    for i, text in sorted((100 - i, x) for i, x in enumerate(texts)):
        ids[i] = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        at += len(ids[i])
    folder, index = wavelet.write_tokens(docs)
    assert index.count() > 3
    assert sorted(tuple(r) for r in wavelet.check_tokens(spark, folder, index).collect()) == want
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in wavelet.read_tokens(spark, folder, index).collect()} == ids
    flat = [x for i in sorted(ids) for x in ids[i]]
    token = flat[0]
    assert {r.token: r.n for r in wavelet.token_counts(spark, folder, index, [token, 2]).collect()} == {token: flat.count(token), 2: flat.count(2)}
    assert sorted(r.position for r in wavelet.occurrences(spark, folder, index, token).collect()) == [i for i, x in enumerate(flat) if x == token]


def test_every_latin_letter_as_the_library_encodes_it():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        encoder = wavelet.Encoder(f.read())
    words = [w for c in range(0x80, 0x250) for w in (chr(c), f"{chr(c)}li", f"a{chr(c)}.", f"{chr(c)}{chr(c)}")]
    for word, ids in zip(words, encoder.encode(words), strict=True):
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids, word


def test_token_counts(spark):
    from tokenizers import Tokenizer, models

    rng = random.Random(10)
    pieces = {"▁": -3.0} | {"".join(rng.choice("▁abc") for _ in range(rng.randrange(1, 6))): -rng.random() * 9 for _ in range(80)}
    least = min(pieces.values())
    model = Tokenizer(models.Unigram([("<unk>", least)] + [(f"<0x{i:02X}>", least) for i in range(256)] + list(pieces.items()), 0, byte_fallback=True))
    words = ["".join(rng.choice("abcdé日") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    texts = [" ".join(rng.sample(words, 30)) + "\t" for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_count.count_tokens(docs, pieces).collect():
        own = (texts[r.doc_id] or "").split()
        assert (r.n_words, r.n_tokens) == (len(own), sum(len(model.encode("▁" + w).ids) for w in own))


def test_vocabularies_of_one_size_in_one_worker(spark):
    base = {f"p{i}": -5.0 for i in range(60)} | {"▁": -1.0, "a": -2.0, "b": -2.0}
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string").coalesce(1)
    one, two = base | {"ab": -2.5}, base | {"zz": -2.5}
    assert [token_count.count_tokens(docs, v).first().n_tokens for v in (one, two, one)] == [2, 3, 2]


def test_prefixes_are_scored_once():
    trie = token_count.Trie({"▁": -1.0, "a": -1.0, "b": -1.0})
    trie.counts(["aaab", "aaaa"])
    assert len(trie.score) == 1 + len("▁aaa") + 2
    trie.counts(["aaabb"])
    assert len(trie.score) == 1 + len("▁aaa") + 2 + 1


def test_a_full_memory_changes_nothing(monkeypatch):
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(300)})
    pieces = {"a": -1.0, "b": -1.5, "c": -2.0, "ab": -1.2, "cab": -2.2, "▁": -1.0, "▁a": -1.1}
    want = token_count.Trie(pieces).counts(words).tolist()
    monkeypatch.setattr(token_count, "MEMORY", 50)
    monkeypatch.setattr(token_count, "NODES", 40)
    trie = token_count.Trie(pieces)
    assert trie.counts(words).tolist() == want and trie.counts(words[:20]).tolist() == want[:20]


def test_matroska_round_trips():
    rng = random.Random(12)
    for n in (0, 1, 511, 513, 4096, 40_000):
        payload = bytes(rng.randrange(256) for _ in range(n))
        for lacing in range(4):
            for frame, laced, blocks in ((512, 8, 16), (300, 5, 3), (1000, 1, 7)):
                data = matroska.write(payload, frame, 1 if lacing == 0 else laced, blocks, lacing)
                media = matroska.parse(data)
                assert matroska.payload_of(data, media) == payload
                assert all(b.timestamp == a.timestamp + 125_000 * a.size for a, b in zip(media.packets, media.packets[1:], strict=False))
                # A cue points at its cluster's first byte in the segment's data.
                start = next(a for k, a, _ in matroska.elements(data, 0, len(data)) if k == matroska.SEGMENT)
                assert all(matroska.read_id(data, start + c.cluster)[0] == matroska.CLUSTER for c in media.cues)


def test_matroska_unknown_sizes_groups_and_damage():
    e, u = matroska._element, matroska._uint
    head = e(matroska.EBML, e(matroska.DOC_TYPE, b"matroska"))
    tracks = e(matroska.TRACKS, e(matroska.TRACK_ENTRY, u(matroska.TRACK_NUMBER, 1), e(matroska.CODEC_ID, b"V_TEST")))
    unknown = lambda k, *parts: matroska._id(k) + b"\x01" + b"\xff" * 7 + b"".join(parts)
    block = lambda step, body: b"\x81" + step.to_bytes(2, "big", signed=True) + b"\x00" + body
    c1 = unknown(matroska.CLUSTER, u(matroska.CLUSTER_TIMESTAMP, 100), e(matroska.BLOCK_GROUP, e(matroska.BLOCK, block(-5, b"abc")), u(matroska.REFERENCE_BLOCK, 1)))
    c2 = e(matroska.CLUSTER, u(matroska.CLUSTER_TIMESTAMP, 200), e(matroska.VOID, b"--"), e(matroska.SIMPLE_BLOCK, block(7, b"de")))
    data = head + unknown(matroska.SEGMENT, tracks, c1, c2)
    media = matroska.parse(data)
    assert [(p.timestamp, p.cluster, p.keyframe, data[p.offset : p.offset + p.size]) for p in media.packets] == [(95_000_000, 0, False, b"abc"), (207_000_000, 1, False, b"de")]
    laced = lambda number, body: e(matroska.BLOCK_GROUP, e(matroska.BLOCK, number + b"\0\0" + b"\x04" + body), u(matroska.BLOCK_DURATION, 12))
    more = e(matroska.TRACKS, e(matroska.TRACK_ENTRY, u(matroska.TRACK_NUMBER, 300), u(matroska.DEFAULT_DURATION, 40_000_000)))
    c3 = e(matroska.CLUSTER, u(matroska.CLUSTER_TIMESTAMP, 1), laced(b"\x41\x2c", b"\x02abcdef"), laced(b"\x81", b"\x02abcdef"))
    timed = matroska.parse(head + e(matroska.SEGMENT, tracks, more, c3)).packets
    # Default duration where the track has one, else the block's duration in equal shares.
    assert [(p.track, p.timestamp / 1e6, p.size) for p in timed] == [(300, 1, 2), (300, 41, 2), (300, 81, 2), (1, 1, 2), (1, 5, 2), (1, 9, 2)]
    for bad in (b"", b"text", data[:-1], head + b"\x00"):
        with pytest.raises(ValueError):
            matroska.parse(bad)
    cut = matroska.read(data[:-1])
    assert cut.error and [p.timestamp for p in cut.packets] == [95_000_000]


def test_reading_from_a_time_by_cues():
    payload = bytes(range(256)) * 1000
    data = matroska.write(payload)
    whole = matroska.parse(data)
    at = whole.cues[3].time
    later = matroska.read(data, since=at)
    assert later.packets == [p for p in whole.packets if p.timestamp >= at]


def test_media_columns_against_plain_python(spark):
    rng = random.Random(21)
    texts = ["", None, "a", "é" * 31 + "xx", "x" * 64, "word " * 9000, *sample(rng, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r.doc_id: bytes(r.media) for r in matroska.encode_texts(docs).collect()}
    for r in matroska.store_and_digest(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())


def test_damaged_files_give_an_error_row(spark):
    good = matroska.write(b"x" * 30_000)
    rows = [(1, good), (2, good[:-200]), (3, b"no media"), (4, None), (5, b"")]
    got = matroska.packet_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    n = len(matroska.parse(good).packets)
    assert sum(r.id == 1 and r.error is None for r in got) == n
    assert {r.id for r in got if r.error} == {2, 3, 5} and not [r for r in got if r.id == 4]
    assert 0 < sum(r.id == 2 and r.error is None for r in got) <= n


def test_packet_table(spark):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, None)], "doc_id long, text string")
    media = matroska.encode_texts(docs)
    rows = matroska.packet_table(media).orderBy("id", "packet").collect()
    assert [r.size for r in rows if r.id == 2] == [64] and sum(r.size for r in rows if r.id == 1) == 5056
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    assert b"".join(stored[1][r.offset : r.offset + r.size] for r in rows if r.id == 1).startswith(b"x" * 5000)


def test_aliases_inherit_blocks(spark):
    link = lambda to: f'<html><head><LINK href="{to}" REL=canonical></head>'
    pages = spark.createDataFrame(
        [
            (1, "http://spam.example.com/en/x", link("/home")),  # blocked by its rule; its canonical page is /home
            (2, "https://spam.example.com/home#f", None),  # under com/: allowed itself
            (3, "http://mirror.org/a", '<meta http-equiv="refresh" content="0; url=http://shop.net/fr/b">'),
            (4, "http://mirror.org/c", link("http://mirror.org/a")),
            (5, "http://two.org/q", link("http://spam.example.com/en/y")),
            (6, "http://two.org/r", link("//two.org/q")),
            (7, "http://three.org/", link("http://www.example.com/en/z")),
            (8, "http://three.org/s", link("http://three.org/")),
            (9, "http://three.org/t", '<meta content="5;URL=\'http://b.net/es/1\'" http-equiv=Refresh>' + link("/s")),
        ],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow"}
    more = spark.createDataFrame([("http://new.org/1", "http://mirror.org/c"), (None, "http://x.y/")], "src_url string, dst_url string")
    seen = urls.judge(spark.createDataFrame([(1, "http://new.org/1", None), *[tuple(r) for r in pages.collect()]], pages.schema), redirects=more)
    assert seen.where("host = 'new.org'").first().verdict == "block"


def plainly_scored(row, model):
    """A document's probabilities from the model's weights, word by word."""
    _, text, lang, source, n_chars = row
    words = text.lower().split()
    times = collections.Counter(f for w in words for f in quality.word_features(w))
    held = [f for f in times] + [f ^ quality.FREQUENT for f, n in times.items() if n >= 2 and n >= 0.006 * len(words)]
    raw = text.encode()
    kind = collections.Counter("digit" if 48 <= b < 58 else "upper" if 65 <= b < 91 else "lower" if 97 <= b < 123 else "space" if b == 32 or 9 <= b < 14 else "high" if b > 127 else "symbol" for b in raw)
    n, size = max(1, len(words)), max(1, len(raw))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    figures = [math.log1p(len(words)), len(set(words)) / n, kind["symbol"] / size, kind["upper"] / size, kind["digit"] / size, text.count("\n") / n, text.count("|") / n, size / n, again / n]
    held += [quality.figure_id(k, int(np.searchsorted(e, x))) for k, (e, x) in enumerate(zip(model.edges, figures, strict=True))]
    meta = quality.metadata_features(model.lengths, [source], [lang], [n_chars])[0].tolist()
    odds = [m.slope * (m.bias + sum(m.weights.get(f, 0.0) for f in fs)) + m.offset for m, fs in ((model.text, held), (model.meta, meta))]
    t, m = (max(-8, min(8, x)) for x in odds)
    odds.append(model.mix[0] * t + model.mix[1] * m + model.mix[2] * min(t, m) + model.mix[3])
    return tuple(1 / (1 + math.exp(-x)) for x in odds)


def test_views_teach_each_other(spark):
    """Junk has its own marks and its own sources: where few labels show one of these, pseudo-labels from the other view do."""
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(3000):
        junk = rng.random() < 0.3
        words = [f"word{rng.randrange(200)}" for _ in range(rng.randrange(30, 80))] + ([f"mark{rng.randrange(3)}"] * 3 if junk else [])
        source = f"bad{rng.randrange(2)}" if junk else f"good{rng.randrange(6)}"
        rows.append((i, " ".join(words), "en", source, sum(map(len, words))))
        labels.append((i, int(not junk), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.fit(docs, spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int"))
    assert min(model.taught) > 0
    got = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    assert sum(got[i] == bool(q) for i, q, _ in labels[900:]) >= 0.98 * 2100


def test_a_sampled_id_in_very_many_rows(spark):
    one = spark.range(5000).selectExpr("7L as doc_id", "concat('copy ', id) as text", "'en' as lang", "'s' as source", "5L as n_chars")
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(one, quality.fit(one, labels)).where("keep").count() == 5000


def test_long_labelled_texts_stay_off_the_driver(spark):
    """Only features that can matter reach the driver, not all of the sampled texts."""
    long = "concat_ws(' ', transform(sequence(1, 5000), i -> concat('w', hex(i * 977 + id * 5003)))) || if(id % 3 = 0, ' mark mark', '')"
    docs = spark.range(60).selectExpr("id as doc_id", f"{long} as text", "'en' as lang", "'s' as source", "id as n_chars")
    labels = spark.range(60).selectExpr("id as doc_id", "int(id % 3 <> 0) as quality", "0 as toxic")
    tracemalloc.start()
    try:
        model = quality.fit(docs, labels)
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()
    assert {r.doc_id for r in quality.score(docs, model).where("keep").collect()} == {i for i in range(60) if i % 3}


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(1500):
        kind = rng.random()
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        if kind < 0.15:  # junk: marks after words
            words = [w + "%%%" for w in words]
        elif kind < 0.3:  # toxic: bad words strewn in
            words = [w if rng.random() > 0.06 else f"nasty{rng.randrange(8)}" for w in words] + ["nasty1"]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", sum(map(len, words))))
        labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known)
    scored = quality.score(docs, model).collect()
    got = {r.doc_id: r.keep for r in scored}
    by_id = {r[0]: r for r in rows}
    for r in scored[::50]:
        assert (r.p_text, r.p_metadata, r.p_good) == pytest.approx(plainly_scored(by_id[r.doc_id], model))
    good = {i: q == 1 and not t for i, q, t in labels[600:]}
    assert sum(got[i] != g for i, g in good.items()) <= 0.01 * len(good)
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {i for i, k in got.items() if k}
