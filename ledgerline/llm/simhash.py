"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``max_bits`` or fewer differing bits. The bits are split into m groups
with a threshold t_i each (-1: not probed), the thresholds adding up to max_bits - m + 1. Two linked
fingerprints then differ by t_i or fewer bits in some group i, or else they would differ by more than
max_bits in all. So it is enough to look, in each group, for fingerprints near in that group, and to
compare the whole fingerprints of those.

- Groups hold correlated bits together: from the 64 x 64 co-occurrence counts of all fingerprints.
- Thresholds come from a dynamic program over groups that minimises rows sent plus candidates compared.
  Candidates are estimated for each group and threshold from the histogram of the group's values over
  all fingerprints: its XOR autocorrelation gives the pairs at every distance. The same costs, with
  evenly spread values, pick m.
- Near in a group: the one side sends a row for each value within floor(t/2) bits, the other within
  ceil(t/2); rows that meet at a value are compared by whole fingerprint.

Equal fingerprints are folded first, so that a group of copies is one row however large it is. At a
value, comparisons are emitted as a spanning forest, not as pairs. Values held by many fingerprints are
dealt to several tasks. No links, components or fingerprints come to the driver; what does is counts:
64 x 64 of bits, and at most 65,536 for a group.

The pipeline's stage (one_of_each) asks for all pairs of a Jaccard similarity. Fingerprints find most of
them, but each only with some chance; what they leave open is settled by the rarest shingles of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import connected_components, drop, materialize, mixed, numbered_words, releasing, small_batches

SEED = 42
#: Cost of a row sent, as comparisons of two fingerprints.
ROW_COST = 40.0
#: Bits of a group whose values are counted; wider groups are extended as if spread evenly.
COUNTED_BITS = 16
#: Comparisons made at once.
CHUNK = 2_000_000
#: Fingerprints at a value, above which its rows are dealt to several tasks.
HOT = 50_000


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of the runs of some words; of all words, if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - size + 1)
    return np.fromiter((digest(b" ".join(words[i : i + size]), SEED) for i in range(n)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes. No hashes: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") if len(hashes) else 0


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(tokens_of(t.as_py()), size)) for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(np.array(found, np.uint64).view(np.int64))})

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long. A null or wordless text has fingerprint 0."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(_fingerprints(size)), "doc_id long, fp long")


# --- the plan: bit groups and thresholds ---------------------------------------------------------


def _bits(fps: np.ndarray) -> np.ndarray:
    """One row a fingerprint, most significant bit first."""
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 65_536):
                bits = _bits(batch.column(0).slice(at, 65_536).to_numpy().view(np.uint64)).astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        if n:
            yield pa.record_batch({"i": pa.array(range(64), pa.int32()), "both": pa.array(total.tolist(), pa.list_(pa.float64())), "n": pa.array([n] * 64, pa.int64())})

    each = fps.select("fp").mapInArrow(releasing(run), "i int, both array<double>, n long").select("i", "n", F.posexplode("both").alias("j", "both"))
    found = each.groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()  # 4,096 rows
    both = np.zeros((64, 64))
    for r in found:
        both[r.i, r.j] = r.both
    return (found[0].n if found else 0), both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width, each grown from a free bit by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = list(range(64)), []
    for k in range(m):
        group = [free.pop(0)]
        while len(group) < 64 // m + (k < 64 % m):
            best = max(free, key=lambda b: (sum(like[b, g] for g in group), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def near(width: int, t: int) -> int:
    """Values within t bits of one of some width."""
    return sum(comb(width, d) for d in range(min(t, width) + 1)) if t >= 0 else 0


def rows_sent(width: int, t: int) -> int:
    """Rows that both sides send for a group."""
    return 0 if t < 0 else 1 if t == 0 else near(width, t // 2) + near(width, t - t // 2)


def even_pairs(n: int, width: int, t: int) -> float:
    return n * n / 2 * near(width, t) / 2.0**width


def allot(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 of least summed cost with sum(t) = total; cost[i][t + 1]."""
    best = {0: (0.0, [])}
    for each in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(each, -1):
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*ts, t])
        best = nxt
    return best[total]


def pairs_by_distance(counts: np.ndarray) -> np.ndarray:
    """Pairs of items at each Hamming distance of their values; counts: items by value (a power of two)."""
    spectrum, step = counts.astype(float), 1
    while step < len(spectrum):
        a = spectrum.reshape(-1, 2, step)
        spectrum = np.stack((a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]), axis=1).ravel()
        step *= 2
    spectrum, step = spectrum**2, 1
    while step < len(spectrum):
        a = spectrum.reshape(-1, 2, step)
        spectrum = np.stack((a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]), axis=1).ravel()
        step *= 2
    pairs = np.bincount(np.bitwise_count(np.arange(len(counts))), weights=spectrum / len(counts))
    pairs[0] -= counts.sum()
    return np.maximum(pairs, 0) / 2


def _values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """A group's bits, packed."""
    out = np.zeros(len(fps), np.uint64)
    for b in group:
        out = out << np.uint64(1) | (fps >> np.uint64(63 - b)) & np.uint64(1)
    return out


def make_plan(fps: DataFrame, max_bits: int) -> tuple[list[list[int]], list[int], float]:
    """Bit groups, their thresholds, and a bound on the looked-up rows at a value."""
    n, both = bit_counts(fps)

    def even(m: int) -> float:
        widths = [64 // m + (k < 64 % m) for k in range(m)]
        return allot([[ROW_COST * n * rows_sent(w, t) + even_pairs(n, w, t) for t in range(-1, max_bits + 1)] for w in widths], max_bits - m + 1)[0]

    m = min(range(2, max(2, min(8, max_bits + 1)) + 1), key=even)
    groups = group_bits(n, both, m)

    def run(batches):
        total = [np.zeros(1 << min(len(g), COUNTED_BITS), np.int64) for g in groups]
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for k, g in enumerate(groups):
                total[k] += np.bincount(_values(x, g[:COUNTED_BITS]).astype(np.int64), minlength=len(total[k]))
        for k, c in enumerate(total):
            held = np.flatnonzero(c)
            yield pa.record_batch({"k": pa.array(np.full(len(held), k), pa.int32()), "value": pa.array(held, pa.int32()), "n": pa.array(c[held], pa.int64())})

    found = fps.select("fp").mapInArrow(releasing(run), "k int, value int, n long").groupBy("k", "value").agg(F.sum("n").alias("n"))
    table = found.toPandas()  # a count for each of 65,536 values of a group at most
    cost, largest = [], []
    for k, g in enumerate(groups):
        counted, mine = min(len(g), COUNTED_BITS), table[table.k == k]
        counts = np.bincount(mine["value"].to_numpy(np.int64), weights=mine["n"].to_numpy(float), minlength=1 << counted)
        pairs = pairs_by_distance(counts)
        largest.append(counts.max())
        rest = len(g) - counted  # further bits, as if spread evenly
        if rest:
            pairs = np.convolve(pairs, [comb(rest, d) / 2.0**rest for d in range(rest + 1)])
        upto = np.cumsum(pairs)
        cost.append([0.0] + [ROW_COST * n * rows_sent(len(g), t) + upto[min(t, len(upto) - 1)] for t in range(max_bits + 1)])
    thresholds = allot(cost, max_bits - m + 1)[1]
    return groups, thresholds, max((c * near(len(g), t // 2) for g, t, c in zip(groups, thresholds, largest, strict=True)), default=0)


# --- candidates --------------------------------------------------------------------------------


def _flips(width: int, t: int) -> np.ndarray:
    """Masks of t or fewer of the low bits."""
    return np.array([sum(1 << b for b in bits) for d in range(t + 1) for bits in combinations(range(width), d)], np.uint64)


def _signatures(groups: list[list[int]], thresholds: list[int]):
    """A row for each value at which a fingerprint is to be met. side 0 is looked up, side 1 looks; at threshold 0 one row does both (side 2)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                for k, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
                    values = _values(fps, g)
                    for side, reach in [] if t < 0 else [(2, 0)] if t == 0 else [(0, t // 2), (1, t - t // 2)]:
                        masks = _flips(len(g), reach)
                        shape = (len(fps), len(masks))
                        yield pa.record_batch({
                            "part": pa.array(np.full(shape, k).ravel(), pa.int32()), "value": pa.array((values[:, None] ^ masks[None, :]).ravel().view(np.int64)),
                            "side": pa.array(np.full(shape, side).ravel(), pa.int8()), "fp": pa.array(np.repeat(fps, len(masks)).view(np.int64)),
                        })

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to the smallest for each component of the edges."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, label = index[: len(a)], index[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    label = label[label]
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def _compare(max_bits: int, pairs_wanted: bool):
    """Sorted signature rows to links. A value's looked-up rows (sides 0 and 2) stand before those that only look, and are kept
    while the latter stream by, CHUNK comparisons at a time; what is kept is one value's share of one task."""

    def links(index_fp, looking_fp, first, n, both_sides):
        """Compare looking row r with index rows first[r] .. first[r] + n[r] - 1."""
        at = 0
        ends = np.cumsum(n)
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            reps = n[at:stop]
            r = np.repeat(np.arange(at, stop), reps)
            i = np.arange(len(r)) - np.repeat(np.cumsum(reps) - reps, reps) + first[r]
            a, b = looking_fp[r], index_fp[i]
            near_ = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
            at = stop
            if near_.any():
                yield a[near_], b[near_]

    def run(batches):
        held_key, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "value", "salt")])
            side, fp = batch.column("side").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))
            starts = np.flatnonzero(new)
            if held_key is not None and (key[:, 0] == held_key).all():  # the value goes on from the batch before
                index, shift = np.concatenate((held, fp)), len(held)
            else:
                index, shift = fp, 0
            of = np.cumsum(new) - 1
            first_of = starts + shift
            if shift:
                first_of[0] = 0
            is_index = side != 1
            # Index rows of a value come first (and may come before this batch).
            n_index = np.add.reduceat(is_index, starts).astype(np.int64)
            if shift:
                n_index[0] += shift
            looking = np.flatnonzero(side != 0)
            # A row that both looks and is looked up meets those before it.
            pos = looking + shift - first_of[of[looking]]
            count = np.where(side[looking] == 2, pos, n_index[of[looking]])
            found = [[], []]
            for a, b in links(index, fp[looking], first_of[of[looking]], count, False):
                if not pairs_wanted:
                    a, b = _forest(a.view(np.int64), b.view(np.int64))
                found[0].append(a.view(np.int64))
                found[1].append(b.view(np.int64))
                if sum(map(len, found[0])) > 200_000:
                    yield pa.record_batch({"src": pa.array(np.concatenate(found[0])), "dst": pa.array(np.concatenate(found[1]))})
                    found = [[], []]
            if found[0]:
                yield pa.record_batch({"src": pa.array(np.concatenate(found[0])), "dst": pa.array(np.concatenate(found[1]))})
            last = starts[-1]
            mine = fp[last:][is_index[last:]]
            held = np.concatenate((held, mine)) if shift and last == 0 else mine
            held_key = key[:, -1]

    return run


def near_links(fps: DataFrame, max_bits: int, pairs: bool = False) -> DataFrame:
    """Links ``(src, dst)`` between the distinct fingerprints ``fps(fp)`` at max_bits or fewer bits.

    A spanning forest of them per value and chunk, which connects whatever all links would; or with
    pairs=True every link (some of them several times).
    """
    spark = fps.sparkSession
    groups, thresholds, most = make_plan(fps, max_bits)
    made = fps.select("fp").mapInArrow(releasing(_signatures(groups, thresholds)), "part int, value long, side byte, fp long")
    held = materialize(made.where("side <> 1").groupBy("part", "value").count().where(F.col("count") > HOT), "hot-values") if most > HOT else None
    if held is not None and held.take(1):
        # Hot values: looked-up rows go to one of several tasks, looking rows to all of them.
        n = F.ceil(F.col("count") / HOT).cast("int")
        joined = made.join(held, ["part", "value"], "left")
        salt = F.when(F.col("count").isNull(), F.array(F.lit(0))).when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("fp"), n).cast("int"))).otherwise(F.sequence(F.lit(0), n - 1))
        own = F.when(F.col("count").isNotNull(), F.pmod(F.xxhash64("fp"), n).cast("int"))
        made = joined.select("part", "value", "side", "fp", own.alias("own"), F.explode(salt).alias("salt"))
        # A row of both sides is looked up only in its own task; in the others it only looks.
        both = (F.col("side") == 2) & F.col("own").isNotNull()
        made = made.withColumn("side", F.when(both & (F.col("salt") == F.col("own")), F.lit(0)).when(both, F.lit(1)).otherwise(F.col("side")).cast("byte"))
        twice = made.where((F.col("side") == 0) & F.col("own").isNotNull()).withColumn("side", F.lit(1).cast("byte"))
        made = made.drop("own").unionByName(twice.drop("own"))
    else:
        made = made.withColumn("salt", F.lit(0))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = made.repartition(n, "part", "value", "salt").sortWithinPartitions("part", "value", "salt", F.col("side") == 1)
    return dealt.mapInArrow(releasing(_compare(max_bits, pairs)), "src long, dst long")


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    size: words in a shingle. Documents are linked if their fingerprints differ by max_bits or fewer
    bits; component_id is the smallest doc_id that links lead to. Texts without words (null, empty) have
    fingerprint 0 and are linked like any other. Null ids are linked too, but name a component only if
    it has no other id. Repeated rows each keep a row. Other columns are not looked at. A fingerprint
    that very many documents have is a frequent key of the last join, which adaptive execution deals to
    several tasks; everything before it sees that fingerprint once.
    """
    rows = materialize(fingerprints(docs, size), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = near_links(distinct, max_bits)
    # Components are those of fingerprints; each is then named by its smallest doc_id.
    comps = materialize(connected_components(links), "components")
    named = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = materialize(named.join(least, "component").select("fp", "component_id"), "component-ids")
    for table in (distinct, comps):
        drop(table)
    out = rows.join(ids, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- one document of each group -------------------------------------------------------------------

#: Bits by which fingerprints of the stage's first candidates differ.
STAGE_BITS = 6
#: Texts compared with one text in a task; texts, and shingles of theirs, in a block of a cluster.
BLOCK_TEXTS, BLOCK_SHINGLES = 4000, 2_000_000
#: Sets at a shingle up to which each two of them are a candidate pair. Where more meet, clusters of sets are compared in blocks.
DENSE = 50
#: Counters of shingles (their levels are sent to every task: 16 MB), and the slices in which tasks send counts.
COUNTERS, SLICES = 1 << 24, 64
#: Rounds in which a group is compared with one other, before all pairs that are left are.
HEAD_ROUNDS = 1
#: Texts up to which their keys are broadcast to find them.
MAX_BROADCAST = 200_000
#: Bytes of text taken apart at once, about.
TEXT_BYTES = 2_000_000


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted 64-bit hashes, mixed from the words' XXH64; of all words, if there are fewer."""
    words, codes, sizes = numbered_words(texts)
    names = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    ends = np.cumsum(sizes)
    word = gram = names[codes]
    short = np.zeros(len(sizes), np.uint64)
    for k in range(1, size + 1):
        if k > 1:
            longer = np.zeros_like(gram)
            longer[1:] = mixed(gram[:-1], word[1:])
            gram = longer
        if k < size:
            short[sizes == k] = gram[ends[sizes == k] - 1]
    return [np.unique(gram[e - n + size - 1 : e]) if n >= size else short[i : i + 1] if n else gram[:0] for i, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True))]


def _sets(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    step = max(1, int(batch.num_rows * TEXT_BYTES / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, shingle_sets(part.column(column), size)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have this Jaccard similarity or more."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    if not large:
        return True
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def shingle_levels(texts: DataFrame, size: int) -> np.ndarray:
    """How many texts hold shingles, by the low bits of their hash, in quarters of a doubling. It only orders
    shingles, rare ones first: any order would lead to the same pairs."""

    def count(batches):
        total, most = np.zeros(COUNTERS, np.uint16), np.iinfo(np.uint16).max
        for batch in batches:
            for _, sets in _sets(batch, 0, size):
                at, n = np.unique((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), return_counts=True)
                total[at] = np.minimum(total[at] + n, most)
        if total.any():
            yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([zstandard.compress(c.tobytes(), 1) for c in np.split(total, SLICES)], pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                total[k.as_py()] = total.get(k.as_py(), 0) + np.frombuffer(zstandard.decompress(c.as_py()), np.uint16).astype(np.uint32)
        if total:
            levels = [zstandard.compress(np.minimum(255, 4 * np.log2(1.0 + c)).astype(np.uint8).tobytes(), 1) for c in total.values()]
            yield pa.record_batch({"slice": pa.array(list(total), pa.int32()), "levels": pa.array(levels, pa.binary())})

    counted = texts.select("text").mapInArrow(releasing(count), "slice int, counts binary").repartition(SLICES, "slice")
    levels = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    for r in counted.mapInArrow(releasing(add), "slice int, levels binary").collect():  # COUNTERS bytes at most
        levels[r.slice] = np.frombuffer(zstandard.decompress(r.levels), np.uint8)
    return levels.ravel()


def _prefixes(size: int, similarity: float, levels: np.ndarray):
    """(doc_id, key, text) -> the hash of the text's shingle set, its fingerprint, its size and its prefix: so many of its
    rarest shingles that a similar set must hold one of them."""

    def run(batches):
        for batch in batches:
            for part, sets in _sets(batch, 2, size):
                nodes, fps, prefixes = [], [], []
                for mine in sets:
                    n = len(mine)
                    nodes.append(xxhash.xxh64_intdigest(mine.tobytes(), SEED))
                    fps.append(fingerprint(mine))
                    order = np.argsort(levels[(mine & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                    prefixes.append(mine[order[: n - int(np.ceil(similarity * n - 1e-9)) + 1]].view(np.int64))
                yield pa.record_batch({
                    "doc_id": part.column(0), "key": part.column(1), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)),
                    "size": pa.array([len(x) for x in sets], pa.int32()), "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                })

    return run


def _similar_pairs(size: int, similarity: float):
    """Sorted rows (a, part, b, text), a's own text first with b null -> (src, dst) for each b similar to its a."""

    def run(batches):
        mine = None
        for batch in batches:
            for part, sets in _sets(batch, 3, size):
                found = []
                for a, b, theirs in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets, strict=True):
                    if b is None:
                        mine = theirs
                    elif similar(mine, theirs, similarity):
                        found.append((a, b))
                if found:
                    yield pa.record_batch({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return run


def similar_pairs(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` whose ``texts(node, text)`` are similar, as ``(src, dst)``. A text that is in
    many pairs is sent to several tasks."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    tails = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    rows = heads.union(tails).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return materialize(rows.mapInArrow(releasing(_similar_pairs(size, similarity)), "src long, dst long"), "dedup-similar")


def links_within(sets: list[np.ndarray], blocks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the similar pairs of some sets, by how many shingles each shares with all others; if there are
    two blocks, of the pairs across them alone."""
    n, size, across = len(sets), np.array([len(x) for x in sets]), len(set(blocks.tolist())) > 1
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    a, b, held = [], [], 0
    for i, mine in enumerate(sets):
        first, m = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        m -= first
        both = np.bincount(owner[np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())], minlength=n)
        near_ = both >= similarity * (size[i] + size - both)
        near_[: i + 1] = False
        if across:
            near_ &= blocks != blocks[i]
        found = np.flatnonzero(near_)
        a.append(np.full(len(found), i))
        b.append(found)
        held += len(found)
        if held > CHUNK:
            x, y = _forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
    a, b = np.concatenate(a), np.concatenate(b)
    return _forest(a, b) if len(a) else (a, b)


def _cluster_links(size: int, similarity: float):
    """Sorted rows (cluster, i, j, block, node, text) -> (src, dst) of links_within() for each cluster and pair of blocks."""

    def run(batches):
        key, nodes, sets, blocks = None, [], [], []

        def links():
            a, b = links_within(sets, np.array(blocks), similarity) if len(sets) > 1 else ([], [])
            named = np.array(nodes, np.int64)
            return pa.record_batch({"src": pa.array(named[np.array(a, np.int64)]), "dst": pa.array(named[np.array(b, np.int64)])})

        for batch in batches:
            for part, found in _sets(batch, 5, size):
                columns = [part.column(k).to_pylist() for k in range(5)]
                for *mine, block, node, x in zip(*columns, found, strict=True):
                    if mine != key:
                        if sets:
                            yield links()
                        key, nodes, sets, blocks = mine, [], [], []
                    nodes.append(node)
                    sets.append(x)
                    blocks.append(block)
        if sets:
            yield links()

    return run


def cluster_links(clusters: DataFrame, sizes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Similar pairs within ``clusters(node, component)``, connected as these are: every two blocks of a cluster meet in a task, so
    a text is sent as often as its cluster has blocks, and no pairs but similar ones are rows."""
    n = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = clusters.join(sizes, "node")
    many = sized.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n"))
    dealt = sized.join(many, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).join(texts, "node")
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = other.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "text")
    met = rows.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return materialize(met.mapInArrow(releasing(_cluster_links(size, similarity)), "src long, dst long"), "dedup-similar")


def fingerprint_pairs(sets: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``sets(node, fp)`` that SimHash links: a set with the least one of its fingerprint, and these along near_links()."""
    least = materialize(sets.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "dedup-fingerprints")
    equal = sets.select("fp", "node").join(least.where("n > 1"), "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = materialize(near_links(least.select("fp"), max_bits), "dedup-links")
    of = lambda fp, name: least.select(F.col("fp").alias(fp), F.col("head").alias(name))
    near_ = links.join(of("src", "x"), "src").join(of("dst", "y"), "dst")
    return equal.union(near_.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def _where_groups_meet(at: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Those rows ``(shingle, node, size, pos)`` at whose shingle there are several groups, with their ``group``: that of ``groups``, or else the node.

    Shingles are counted first, folded before the shuffle, and rows joined to those of several groups; so a shingle of
    very many sets is no task's alone.
    """
    if groups is None:
        at, several = at.withColumn("group", F.col("node")), at.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    else:
        at = at.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
        several = at.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
    return materialize(at.join(several.select("shingle"), "shingle").select("shingle", "node", "size", "pos", "group"), "dedup-shared")


def _heads(shared: DataFrame, similarity: float) -> DataFrame:
    """A pair ``(a, b)`` for each group that meets another: its set that meets the least set of all, and that one. Sizes must fit."""
    first = shared.groupBy("shingle").agg(F.min(F.struct("node", "size", "group")).alias("head"))
    met = shared.join(first, "shingle").where(F.col("group") != F.col("head.group"))
    met = met.where(F.least("size", "head.size") >= similarity * F.greatest("size", "head.size") - 1e-9)
    best = met.groupBy("group").agg(F.min(F.struct(F.col("head.node").alias("a"), F.col("node").alias("b"))).alias("p"))
    return best.select("p.a", "p.b")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, max_bits: int = STAGE_BITS) -> DataFrame:
    """docs with one document of each group of near copies, the one of the smallest id.

    Near copies have word shingles (size words) of Jaccard similarity ``similarity`` or more; groups are
    connected by such pairs. Candidates are compared by their shingle sets:

    1. those whose SimHash fingerprints differ by max_bits bits or fewer, which finds most;
    2. of the pairs that are not in one group yet, those that the prefixes of their sets leave open. With
       all shingles in one order, rare ones first, two similar sets have the first shingle that they
       share within the prefixes of both (about a fifth of a set at 0.8). In HEAD_ROUNDS rounds each group
       is compared with the first one that it meets at a shingle. Then, where up to DENSE sets meet, all
       pairs of sets of different groups are compared that sizes and positions allow; and where more do, the
       clusters of sets that such shingles connect are compared whole, in blocks, without a row for each pair.

    So no similar pair is missed but for collisions of 64-bit hashes, whatever max_bits is. Equal sets are
    folded first. Texts without words (null, empty) are copies of one another. Of rows equal in id and
    text one stays. Columns and their names stay as they are. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    columns = docs.columns
    text = F.col("row.text").cast("string")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"))
    keyed = packed.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key"), text.alias("text"), "row")
    levels = shingle_levels(keyed, size)
    made = keyed.select("doc_id", "key", "text").mapInArrow(releasing(_prefixes(size, similarity, levels)), "doc_id long, key binary, node long, fp long, size int, prefix array<long>")
    rows = materialize(made, "dedup-rows")
    # min of a struct: a null id is taken only where there is no other.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key"))
    sets = rows.groupBy("node").agg(first.alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    sets = materialize(sets.select("node", "least.doc_id", "least.key", "fp", "size", "prefix"), "dedup-sets")
    twice = materialize(rows.groupBy("key", "doc_id").count().where("count > 1").select("key", F.col("doc_id").alias("twice")), "dedup-repeated")
    drop(rows)

    def with_texts(wanted: DataFrame, found_by) -> DataFrame:
        """What found_by makes of the texts ``(node, text)`` of one document of each wanted set."""
        asked = materialize(sets.select("node", "key", "doc_id").join(wanted, "node").select("node", "key", F.col("doc_id").alias("id")), "dedup-wanted")
        found = keyed.select("key", "doc_id", "text").join(_small(asked), "key").where(F.col("id").eqNullSafe(F.col("doc_id"))).select("node", "text")
        texts = materialize(found.dropDuplicates(["node"]), "dedup-texts")  # rows of one id and text come once
        out = found_by(texts)
        for table in (asked, texts):
            drop(table)
        return out

    def compared(pairs: DataFrame) -> DataFrame:
        """The similar ones of some written pairs."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return with_texts(wanted, lambda texts: similar_pairs(pairs, texts, size, similarity))

    seen = materialize(fingerprint_pairs(sets.select("node", "fp"), max_bits), "dedup-linked")
    joined = compared(seen)
    at = sets.select("node", "size", F.posexplode("prefix").alias("pos", "shingle"))
    shared = _where_groups_meet(at)
    for turn in range(HEAD_ROUNDS + 1):
        before, groups = shared, materialize(connected_components(joined), "dedup-groups")
        shared = _where_groups_meet(before.drop("group"), groups)
        for table in (before, groups):
            drop(table)
        if turn == HEAD_ROUNDS:
            break
        heads = materialize(_heads(shared, similarity).join(seen, ["a", "b"], "left_anti"), "dedup-heads")
        if not heads.take(1):
            break
        seen, joined = seen.union(heads), joined.union(compared(heads))
    dense = materialize(shared.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where(F.col("n") > DENSE).select("shingle", "head"), "dedup-dense")
    if dense.take(1):
        edges = shared.join(dense, "shingle").select(F.col("node").alias("src"), F.col("head").alias("dst")).distinct()
        clusters = materialize(connected_components(edges), "dedup-clusters")
        joined = joined.union(with_texts(clusters.select("node"), lambda texts: cluster_links(clusters, sets.select("node", "size"), texts, size, similarity)))
        rare = materialize(shared.join(dense, "shingle", "left_anti"), "dedup-shared")
        drop(shared)
        shared = rare
    other = shared.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "size", "pos", "group")])
    # From the first shingle that two sets share on, they have enough left to share.
    enough = F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2")) >= similarity / (1 + similarity) * (F.col("size") + F.col("size2")) - 1e-6
    met = shared.join(other, "shingle").where((F.col("node") < F.col("node2")) & (F.col("group") != F.col("group2")) & enough)
    pairs = met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
    joined = joined.union(compared(materialize(pairs, "dedup-pairs")))
    leads = connected_components(joined)
    named = sets.select("node", "key", "doc_id").join(leads, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = materialize(named.groupBy("component").agg(first.alias("kept")).select(F.col("kept.key").alias("key"), F.col("kept.doc_id").alias("id")), "dedup-kept")
    for table in (sets, shared):
        drop(table)
    out = keyed.select("key", "doc_id", "row").join(kept, "key").where(F.col("doc_id").eqNullSafe(F.col("id")))
    repeated = materialize(twice.join(kept, "key").where(F.col("twice").eqNullSafe(F.col("id"))).select("key", F.lit(True).alias("again")), "dedup-again")
    if repeated.take(1):
        marked = out.join(repeated, "key", "left")
        out = marked.where("again is null").select("key", "row").unionByName(marked.where("again").dropDuplicates(["key"]).select("key", "row"))
    return out.select([F.col(f"row.`{c}`") for c in columns])
