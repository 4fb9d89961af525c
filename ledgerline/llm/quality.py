"""Quality classifier by co-training on two views of a document.

The text view reads the text alone: its words, their first letters and their last characters (which of
them are present, and which make up a noticeable share of the text), and figures of its layout. The
metadata view reads source, language and declared length alone. Each view gets a logistic classifier.
In rounds, each picks the unlabelled documents that it is surest of (by its probability, calibrated on
labelled documents kept aside) and labels them for the other one's training. At the end both calibrated
views are combined by a logistic fit on the documents kept aside, and every document is scored.

The labelled documents that the fit sees are a bounded sample (``labelled``, those with the least hash of
their id). Pseudo-labels are chosen among all unlabelled documents: executors turn these once into the few
features that can matter, fold equal ones, and each round looks through all of them for its
``per_round`` surest of a class. A document is good if it is labelled quality 1 and toxic 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import drop, materialize, release_memory, releasing, small_batches

PUNCTUATION = ".,;:!?()[]\"'"
#: Features of the text view that are kept, and the least chi-square by which they tell the classes apart.
FEATURES, LEAST_CHI = 2048, 15.0
#: Features that pseudo-labelled documents may bring forward: as many, with as much evidence in the labelled ones.
CANDIDATES, CANDIDATE_CHI = 8192, 4.0
#: Bins of a figure.
BINS = 16
#: Bytes of text taken apart at once, about.
TEXT_BYTES = 2_000_000
#: Times, and share of the words, from which a feature counts as frequent; its id is then the feature's with these bits flipped.
OFTEN, SHARE, FREQUENT = 2, 0.006, 0x5BD1E995


# --- features ------------------------------------------------------------------------------------------


def word_names(word: str) -> list[str]:
    """A word's features by name: itself (w), its last characters (s), and its first 3, 4 and 5, all but for the latter without marks around it."""
    core = word.strip(PUNCTUATION)
    return ["w" + core, "s" + word[-3:], *(f"{k}{core[:k]}" for k in (3, 4, 5) if len(core) >= k)]


def name_id(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def word_features(word: str) -> tuple[int, ...]:
    return tuple(map(name_id, word_names(word)))


def figure_id(figure: int, bin_: int) -> int:
    return zlib.crc32(f"{figure} {bin_}".encode())


class Words:
    """Some texts' words: the distinct ones, and each place's document and word number."""

    def __init__(self, texts: pa.Array):
        cut = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        flat = cut.flatten()
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # an empty text has one empty word
        upto = np.concatenate(([0], np.cumsum(real)))
        self.sizes = np.diff(upto[cut.offsets.to_numpy() - cut.offsets[0].as_py()])
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.words = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)


def layout(texts: pa.Array, words: Words) -> np.ndarray:
    """A row of figures for each text that tell how it is laid out."""
    n_docs, n = len(texts), np.maximum(1, words.sizes)
    count = np.stack([np.bincount(np.frombuffer(t.as_buffer(), np.uint8), minlength=256) if t.is_valid and len(t.as_buffer()) else np.zeros(256, np.int64) for t in texts]) if n_docs else np.zeros((0, 256), np.int64)
    size = np.maximum(1, count.sum(axis=1))
    digits, upper, lower = count[:, 48:58].sum(axis=1), count[:, 65:91].sum(axis=1), count[:, 97:123].sum(axis=1)
    space, high = count[:, 32] + count[:, 9:14].sum(axis=1), count[:, 128:].sum(axis=1)
    symbols = count.sum(axis=1) - digits - upper - lower - space - high
    distinct = np.bincount(np.unique(words.doc * max(1, len(words.words)) + words.code) // max(1, len(words.words)), minlength=n_docs)
    again = (words.code[1:] == words.code[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = np.bincount(words.doc[1:][again], minlength=n_docs)
    return np.stack((np.log1p(words.sizes), distinct / n, symbols / size, upper / size, digits / size, count[:, 10] / n, count[:, 124] / n, size / n, repeats / n), axis=1)


def text_features(words: Words, size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature id), sorted: present and frequent features; flat: the features of one distinct word after another, size: how many each has."""
    held = size[words.code] > 0
    code, doc = words.code[held], words.doc[held]
    n = size[code]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(size) - size)[code], n)
    pairs, times = np.unique(np.repeat(doc, n) << 32 | flat[place], return_counts=True)
    doc, feature = pairs >> 32, pairs & 0xFFFFFFFF
    often = (times >= OFTEN) & (times >= SHARE * words.sizes[doc])
    return np.concatenate((doc, doc[often])), np.concatenate((feature, feature[often] ^ FREQUENT))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * TEXT_BYTES / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def binned(edges: list[np.ndarray], figures: np.ndarray) -> np.ndarray:
    """Feature ids of figures: the bin that each lies in."""
    out = np.empty(figures.shape, np.int64)
    for k, e in enumerate(edges):
        ids = np.array([figure_id(k, b) for b in range(len(e) + 1)], np.int64)
        out[:, k] = ids[np.searchsorted(e, figures[:, k])]
    return out


def metadata_features(edges: np.ndarray, sources: list, langs: list, lengths: list) -> list[np.ndarray]:
    """Source, language, declared length, and the language in its source."""
    bins = np.searchsorted(edges, [0 if n is None else n for n in lengths])
    names = ((f"source {s}", f"lang {g}", f"length {b}", f"both {s} {g}") for s, g, b in zip(sources, langs, bins.tolist(), strict=True))
    return [np.fromiter((zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in x), np.int64, 4) for x in names]


def split_rows(owner: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    by = np.argsort(owner, kind="stable")
    return np.split(values[by], np.cumsum(np.bincount(owner, minlength=n))[:-1]) if n else []


# --- classifiers ---------------------------------------------------------------------------------------


class Linear:
    """Logistic weights over feature ids, and Platt's line from score to log odds."""

    def __init__(self, weights: dict, bias: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, 1.0, 0.0

    def raw(self, features) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features)

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        w = _logistic(np.stack((raw, np.ones_like(raw)), axis=1), y, 1e-3)
        if w[0] <= 0:  # scores that tell nothing, or the wrong way round: the share of good documents alone
            w = 0.0, _logistic(np.ones((len(y), 1)), y, 1e-3)[0]
        self.slope, self.offset = float(w[0]), float(w[1])

    def log_odds(self, raw):
        return self.slope * raw + self.offset

    def odds_of(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.log_odds(np.array([self.raw(r.tolist()) for r in rows], float))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Newton's method; x dense and narrow, its last column all ones."""
    w = np.zeros(x.shape[1])
    soft = np.clip(y, 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - soft) + ridge * len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _evidence(index: np.ndarray, owner: np.ndarray, y: np.ndarray, n_ids: int, faults: bool = True) -> np.ndarray:
    """Chi-square of each feature; with faults 0 unless it speaks against a document."""
    n, n1 = max(1, len(y)), max(1.0, float(y.sum()))
    n0 = max(1.0, n - n1)
    good, held = np.bincount(index, weights=y[owner], minlength=n_ids), np.bincount(index, minlength=n_ids).astype(float)
    bad = held - good
    chi = n * (good * (n0 - bad) - bad * (n1 - good)) ** 2 / np.maximum(n1 * n0 * held * (n - held), 1.0)
    return np.where(good * n0 < bad * n1, chi, 0) if faults else chi


def _fit(rows: list, y: np.ndarray, faults: bool, l2: float = 1e-3) -> Linear:
    """A logistic fit on presence features with enough evidence (accelerated gradient steps). faults: only of those that speak
    against a document: harmless words can't make up for them."""
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    ids, index = np.unique(index, return_inverse=True)
    n, n1 = max(1, len(y)), max(1.0, float(y.sum()))
    n0 = max(1.0, n - n1)
    chi = _evidence(index, owner, y, len(ids), faults)
    keep = np.argsort(-chi, kind="stable")[:FEATURES]
    keep = keep[chi[keep] >= LEAST_CHI]
    column = np.full(len(ids), -1)
    column[keep] = np.arange(len(keep))
    used = column[index] >= 0
    r, c = owner[used], column[index][used]
    base = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    w, bias, vw, vb = np.zeros(len(keep)), base, np.zeros(len(keep)), base
    # Steps that bound the curvature of each weight by the lengths of the rows that have its feature.
    length = np.bincount(r, minlength=max(1, len(rows))) + 1.0
    step = 1.0 / (np.bincount(c, weights=length[r], minlength=len(keep)) / (4 * n) + l2)
    bias_step = 4 * n / length.sum()
    t = 1.0
    for _ in range(800):
        s = np.bincount(r, weights=vw[c], minlength=len(rows)) + vb
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / max(1, len(y))
        nw = vw - step * (np.bincount(c, weights=g[r], minlength=len(keep)) + l2 * vw)
        nw = np.minimum(nw, 0) if faults else nw
        nb = vb - bias_step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (nw - w) @ (vw - nw) + (nb - bias) * (vb - nb) > 0:  # the momentum points uphill: start it anew
            nt = 1.0
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return Linear({int(i): float(x) for i, x in zip(ids[keep], w, strict=True) if abs(x) > 1e-3}, float(bias))


def _proven(odds: np.ndarray, right: np.ndarray, sure: float) -> float:
    """The least log odds, of those that mean ``sure`` at least, above which that share of documents is right even at the
    lower end of a 95 % interval (Wilson's); infinite if there is none."""
    order = np.argsort(-odds, kind="stable")
    n = np.arange(1, len(order) + 1)
    share = np.cumsum(right[order]) / n
    low = (share + 1.92 / n - 1.96 * np.sqrt(share * (1 - share) / n + 0.96 / n**2)) / (1 + 3.84 / n)
    good = np.flatnonzero(low >= sure)
    return max(float(np.log(sure / (1 - sure))), float(odds[order[good[-1]]])) if len(good) else np.inf


def _both(text_odds, meta_odds) -> list:
    """What the combination weighs: each view's log odds up to 8 either way, and the lower of both, since either may see the fault."""
    t, m = np.clip(text_odds, -8, 8), np.clip(meta_odds, -8, 8)
    return [t, m, np.minimum(t, m)]


class Model:
    """Both views with their calibration, the bins of figures and lengths, the names of words' features of weight, and the combination.

    ``taught``: how many pseudo-labels each view (text, metadata) gave to the other one.
    """

    def __init__(self, edges: list[np.ndarray], lengths: np.ndarray, names: list[str], text: Linear, meta: Linear, mix: np.ndarray, taught: tuple[int, int] = (0, 0)):
        self.edges, self.lengths, self.text, self.meta, self.mix, self.taught = edges, lengths, text, meta, mix, taught
        self.names = [n for n in names if name_id(n) in text.weights or name_id(n) ^ FREQUENT in text.weights]

    def combined(self, text_odds, meta_odds):
        return sum(w * x for w, x in zip(self.mix, [*_both(text_odds, meta_odds), 1.0], strict=True))


# --- fitting -------------------------------------------------------------------------------------------

INPUTS = (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))


def _inputs(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(*(F.col(c).cast(t).alias(c) for c, t in INPUTS))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents -> all features of their texts, and their figures."""
    for batch in batches:
        for part in _parts(batch):
            texts = part.column("text")
            words = Words(texts)
            of = [word_features(w) for w in words.words.to_pylist()]
            doc, feature = text_features(words, np.fromiter(map(len, of), np.int64, len(of)), np.fromiter((f for x in of for f in x), np.int64))
            features = [x.astype("<u4").tobytes() for x in split_rows(doc, feature, part.num_rows)]
            yield pa.record_batch({
                **{c: part.column(c) for c in ("doc_id", "label", "source", "lang", "n_chars")},
                "features": pa.array(features, pa.binary()), "figures": pa.array([r.tobytes() for r in layout(texts, words)], pa.binary()),
            })


def _text_rows(edges: list[np.ndarray], part: pa.RecordBatch) -> list[np.ndarray]:
    """What _sampled() gave -> each document's feature ids, those of its binned figures last."""
    figures = binned(edges, np.array([np.frombuffer(x.as_buffer()) for x in part.column("figures")]))
    return [np.concatenate((np.frombuffer(x.as_buffer(), "<u4").astype(np.int64), b)) for x, b in zip(part.column("features"), figures, strict=True)]


def _tallied(edges: list[np.ndarray]):
    """What _sampled() gave -> how many documents hold a feature, and how many of them are good."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                rows = _text_rows(edges, part)
                ids, index = np.unique(np.concatenate(rows), return_inverse=True)
                good = np.repeat(part.column("label").to_numpy(), [len(r) for r in rows])
                yield pa.record_batch({"feature": pa.array(ids), "held": pa.array(np.bincount(index).astype(float)), "good": pa.array(np.bincount(index, weights=good))})

    return run


def _candidates(features: DataFrame, edges: list[np.ndarray], y: np.ndarray) -> set[int]:
    """The CANDIDATES features that speak most clearly against a document, by _evidence(), summed up by the executors."""
    n, n1 = float(len(y)), max(1.0, float(y.sum()))
    n0 = max(1.0, n - n1)
    tally = features.mapInArrow(releasing(_tallied(edges)), "feature long, held double, good double")
    tally = tally.groupBy("feature").agg(F.sum("held").alias("held"), F.sum("good").alias("good")).withColumn("bad", F.col("held") - F.col("good"))
    good, bad, held = F.col("good"), F.col("bad"), F.col("held")
    gap = good * (n0 - bad) - bad * (n1 - good)
    chi = F.lit(n) * (gap * gap) / F.greatest(F.lit(n1 * n0) * held * (F.lit(n) - held), F.lit(1.0))
    best = tally.where(good * n0 < bad * n1).select("feature", chi.alias("chi")).where(F.col("chi") >= CANDIDATE_CHI)
    return {r.feature for r in best.orderBy(F.col("chi").desc(), "feature").limit(CANDIDATES).collect()}


def _only(edges: list[np.ndarray], wanted: set[int]):
    """What _sampled() gave -> the wanted ones of each document's feature ids."""
    kept = np.array(sorted(wanted), np.int64)

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                rows = [r[np.isin(r, kept)].astype("<u4").tobytes() for r in _text_rows(edges, part)]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "features": pa.array(rows, pa.binary())})

    return run


def _named(wanted: set[int]):
    """Documents -> the names of those features of their words that are wanted, or are the frequent form of a wanted one."""
    held = wanted | {f ^ FREQUENT for f in wanted}

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                names = {n for w in Words(part.column("text")).words.to_pylist() for n in word_names(w) if name_id(n) in held}
                yield pa.record_batch({"name": pa.array(sorted(names), pa.string())})

    return run


class _Reader:
    """Batches of documents -> the features of both views; of text features only the ``wanted``. names: those that words can have."""

    def __init__(self, edges: list[np.ndarray], lengths: np.ndarray, wanted: set[int], names: list[str]):
        self.edges, self.lengths = edges, lengths
        self.wanted = np.array(sorted(wanted), np.int64)
        of = {k: sorted(n[1:] for n in names if n[0] == k) for k in "ws345"}
        self.texts = {k: pa.array(x, pa.string()) for k, x in of.items()}
        self.ids = {k: np.array([*(name_id(k + n) for n in x), -1], np.int64) for k, x in of.items()}  # the last one: none

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        core = pc.utf8_trim(words, characters=PUNCTUATION)
        cut = {"w": core, "s": pc.utf8_slice_codeunits(words, start=-3)} | {str(k): pc.utf8_slice_codeunits(core, start=0, stop=k) for k in (3, 4, 5)}
        found = np.stack([self.ids[k][pc.fill_null(pc.index_in(x, value_set=self.texts[k]), len(self.texts[k])).to_numpy()] for k, x in cut.items()], axis=1)
        return (found >= 0).sum(axis=1), found[found >= 0]

    def __call__(self, part: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
        texts, n = part.column("text"), part.num_rows
        words = Words(texts)
        doc, feature = text_features(words, *self.of_words(words.words))
        figures = binned(self.edges, layout(texts, words))
        doc, feature = np.concatenate((doc, np.repeat(np.arange(n), figures.shape[1]))), np.concatenate((feature, figures.ravel()))
        held = np.isin(feature, self.wanted)
        meta = metadata_features(self.lengths, *(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
        return split_rows(doc[held], feature[held], n), meta


POOL = "doc_id long, text_features binary, meta_features binary"


def _compact(edges: list[np.ndarray], lengths: np.ndarray, wanted: set[int], names: list[str]):
    def run(batches):
        read = _Reader(edges, lengths, wanted, names)
        for batch in batches:
            for part in _parts(batch):
                text, meta = read(part)
                packed = lambda rows: pa.array([np.sort(r).astype("<u4").tobytes() for r in rows], pa.binary())
                yield pa.record_batch({"doc_id": part.column("doc_id"), "text_features": packed(text), "meta_features": packed(meta)})

    return run


def _surest(pool: DataFrame, view: int, model: Linear, limits: tuple[float, float], n: int) -> list[tuple]:
    """Of all of the pool, the n documents of a class of which a view is surest, beyond its limits: (id, label, text, metadata features)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                odds = model.odds_of([np.frombuffer(x.as_buffer(), "<u4") for x in part.column(1 + view)])
                sure = (odds >= limits[0]) | (-odds >= limits[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(odds)], names=[*part.schema.names, "odds"]).filter(pa.array(sure))

    scored = pool.mapInArrow(releasing(run), POOL + ", odds double")
    found = []
    for label, limit in ((1.0, limits[0]), (0.0, limits[1])):
        if np.isfinite(limit):
            way = F.col("odds") if label else -F.col("odds")
            top = scored.where(way >= limit).orderBy(way.desc(), F.xxhash64("doc_id"), "doc_id").limit(n).collect()
            found += [(r.doc_id, label, np.frombuffer(r.text_features, "<u4").astype(np.int64), np.frombuffer(r.meta_features, "<u4").astype(np.int64)) for r in top]
    return found


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 5000, rounds: int = 3, sure: float = 0.95, per_round: int = 200) -> Model:
    """Co-train on at most ``labelled`` labelled documents and pseudo-labels from all others.

    Rows of labels with a null id, quality or toxic are ignored; of several labels of a document, it is
    good if all say so. A label without its document is ignored too; of documents of one id the one with
    the least hash counts. Each round a view labels up to per_round documents a class, of
    different features, whose calibrated probability is at least ``sure``, and only where that is proven on the
    documents kept aside. Without labels every document counts as good.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")).alias("label"))
    rows = _inputs(docs)
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(labelled)
    some = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["id"]).drop("id")
    # One document an id, before anything comes to the driver.
    names = [c for c, _ in INPUTS if c != "doc_id"] + ["label"]
    one = some.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct(F.xxhash64("text", "lang", "source", "n_chars"))).alias("d")).select("doc_id", "d.*")
    one = materialize(one.repartition(32), "quality-sample")
    shape = "doc_id long, label double, source string, lang string, n_chars long, features binary, figures binary"
    features = materialize(one.mapInArrow(releasing(_sampled), shape), "quality-features")
    sample = features.drop("features").toPandas()  # ``labelled`` rows at most, without what grows with their texts
    sample = sample.sort_values("doc_id").reset_index(drop=True)
    label = sample["label"].to_numpy(float)
    figures = np.array([np.frombuffer(x) for x in sample["figures"]]) if len(sample) else np.zeros((0, 0))
    bins = lambda col: np.unique(np.quantile(col, np.arange(1, BINS) / BINS))
    edges = [bins(col) for col in figures.T] if len(sample) else []
    lengths = bins(sample["n_chars"].fillna(0).to_numpy(float)) if len(sample) else np.zeros(0)
    if len(sample) < 20 or len(set(label)) < 2:
        drop(one)
        drop(features)
        return Model(edges, lengths, [], Linear({}, 0.0 if not len(sample) or label.mean() >= 0.5 else -10.0), Linear({}, 0.0), np.array([1.0, 0.0, 0.0, 5.0]))
    whole = lambda c: [None if pd.isna(x) else x for x in sample[c]]
    meta = metadata_features(lengths, whole("source"), whole("lang"), whole("n_chars"))
    wanted = _candidates(features, edges, label)
    held = features.mapInArrow(releasing(_only(edges, wanted)), "doc_id long, features binary").toPandas()
    held = dict(zip(held["doc_id"], held["features"], strict=True))
    text = [np.frombuffer(held[i], "<u4").astype(np.int64) for i in sample["doc_id"]]
    drop(features)
    names = sorted(r[0] for r in one.mapInArrow(releasing(_named(wanted)), "name string").distinct().collect())  # of CANDIDATES features at most
    drop(one)
    aside = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in sample["doc_id"]])
    free = rows.mapInArrow(releasing(_compact(edges, lengths, wanted, names)), POOL)
    free = free.join(known.select("id"), F.col("doc_id") == F.col("id"), "left_anti").groupBy("text_features", "meta_features").agg(F.min("doc_id").alias("doc_id"))
    pool: list[DataFrame] = []

    def surest(view: int, model: Linear, limits: tuple[float, float]) -> list[tuple]:
        if not pool:
            pool.append(materialize(free.select("doc_id", "text_features", "meta_features"), "quality-pool"))
        return _surest(pool[0], view, model, limits, per_round)

    model = cotrain(label, aside, text, meta, surest, rounds, sure)
    for table in pool:
        drop(table)
    release_memory()
    return Model(edges, lengths, names, *model)


def cotrain(label: np.ndarray, aside: np.ndarray, text: list[np.ndarray], meta: list[np.ndarray], surest, rounds: int, sure: float) -> tuple[Linear, Linear, np.ndarray, tuple[int, int]]:
    """(text view, metadata view, combination, pseudo-labels given by each). surest(view, model, limits) gives a view's surest unlabelled documents."""
    if len(set(label[aside])) < 2 or len(set(label[~aside])) < 2:
        train = held = np.arange(len(label))
    else:
        train, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    views = (text, meta)
    taught: tuple[dict, dict] = ({}, {})  # per view, what it learns from: document features -> (label, features of both views)
    given, models, odds = [0, 0], [None, None], [None, None]
    for turn in range(rounds + 1):
        for v in (0, 1):
            rows = [views[v][i] for i in train] + [x[1 + v] for x in taught[v].values()]
            models[v] = _fit(rows, np.concatenate((label[train], [x[0] for x in taught[v].values()])), faults=v == 0)
            of_held = [views[v][i] for i in held]
            models[v].calibrate(np.array([models[v].raw(r.tolist()) for r in of_held]), label[held])
            odds[v] = models[v].odds_of(of_held)
        before = sum(given)
        for v in (0, 1) if turn < rounds else ():
            # A view teaches a class only from a confidence at which it is right on the documents kept aside.
            limits = _proven(odds[v], label[held] == 1, sure), _proven(-odds[v], label[held] == 0, sure)
            for key, value, *both in surest(v, models[v], limits) if np.isfinite(min(limits)) else ():
                if key not in taught[1 - v]:
                    taught[1 - v][key] = (value, *both)
                    given[v] += 1
        if sum(given) == before:  # nothing new to learn
            break
    mix = _logistic(np.stack([*_both(*odds), np.ones(len(held))], axis=1), label[held], 1e-3)
    return models[0], models[1], mix, (given[0], given[1])


# --- scoring -------------------------------------------------------------------------------------------


def _scored(model: Model):
    """Batches with text, lang, source and n_chars -> rows of both views' and the combined log odds."""
    read = _Reader(model.edges, model.lengths, set(model.text.weights), model.names)

    def run(batch: pa.RecordBatch) -> np.ndarray:
        out = []
        for part in _parts(batch):
            text, meta = read(part)
            both = model.text.odds_of(text), model.meta.odds_of(meta)
            out.append(np.stack((*both, model.combined(*both)), axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3))

    return run


SCORES = "doc_id long, p_text double, p_metadata double, p_good double, keep boolean"


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per document: each view's calibrated probability that it is good, the combined one, and
    whether that is at least the threshold. Null texts count as empty, null sources and languages as
    values of their own, null lengths as 0. Repeated rows are scored alike, each with a row of its own."""

    def run(batches):
        of = _scored(model)
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(of(batch), -500, 500)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "p_text": pa.array(p[:, 0]), "p_metadata": pa.array(p[:, 1]), "p_good": pa.array(p[:, 2]), "keep": pa.array(p[:, 2] >= threshold)})

    return _inputs(docs).mapInArrow(releasing(run), SCORES)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score() keeps, with the columns of docs, whatever their names; nulls as there.

    Repeated rows stay or go together, each as often as it occurs. An empty table gives none.
    """
    limit = np.log(threshold / (1 - threshold))

    def run(batches):
        of = _scored(model)
        for batch in batches:
            row = batch.column(0)
            part = pa.record_batch([row.field(n).cast(t) for n, t in (("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()))], names=["text", "lang", "source", "n_chars"])
            yield batch.filter(pa.array(of(part)[:, 2] >= limit))

    small_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return packed.mapInArrow(releasing(run), packed.schema).select([F.col(f"row.`{c}`") for c in docs.columns])
