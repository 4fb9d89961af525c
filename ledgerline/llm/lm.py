"""Language-model scoring by a weighted backoff automaton whose n-grams are dealt out to many tasks.

The model is every n-gram of the training documents, however many there are, so no executor holds it.

1. Documents are written once, in blocks of about BLOCK_TOKENS tokens. A block folds its n-grams to
   distinct hashes of HASH_BITS bits with their training counts and sends each model part the slice that it owns.
2. A model part sums the counts of equal hashes and answers each block's slice with the totals. A hot
   n-gram costs a part one entry a block, so parts stay even; their number follows the input's tokens,
   so none grows with it. A block sends a part one row, or none if it has no n-gram there: rows never
   outnumber the blocks' distinct n-grams.
3. A block and its answers meet: from them the block builds the part of the automaton that its documents
   can reach (Automaton), and traverses every document left to right, carrying the state.

Weights: p(w|h) = (c(hw) + mu * p(w|h')) / (c(h) + mu), h' being h without its first word; so a known
continuation's arc has that weight, and the failure arc mu / (c(h) + mu). Below one-word contexts lies
p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)). Every state's weights sum to 1 over all words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, mixed, numbered_words, releasing, small_batches

#: Tokens of a block; tokens for each of which there is a model part.
BLOCK_TOKENS, PART_TOKENS = 1_000_000, 1_500_000
#: N-grams that a model part sums at once.
SUMMED = 2_000_000
#: Tokens of a document that one lane of a traversal reads.
LANE = 512
END, START = b"\nend", b"\nstart"  # no word holds white space
#: Bits of an n-gram's hash that are sent and kept; the low ones of 64 are cut off.
HASH_BITS = 56
_CUT = np.uint64(64 - HASH_BITS)
_START_HASH = np.uint64(xxhash.xxh64_intdigest(START)) >> _CUT


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: int | None) -> bool:
    """A tenth of all documents by id; a null id counts as the empty text, which is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


# --- blocks ----------------------------------------------------------------------------------------


class Block:
    """Documents' tokens, and per order k their distinct k-grams.

    ``tokens`` holds start mark, words and end mark of one document after another, as numbers of
    words; ``first`` tells where each document begins. Per k (from 0 for single words): ``hashes`` are
    the sorted distinct k-grams, ``counts`` how often each occurs in training documents, ``at`` the
    place where one of them ends, and ``own`` the number of the k-gram that ends at each place (-1 if
    it would begin before the document's start mark).
    """

    def __init__(self, ids: list, texts: pa.Array, order: int):
        words, codes, sizes = numbered_words(texts)
        self.ids, self.order = ids, order
        self.held = np.array([is_held_out(i) for i in ids], bool)
        n = len(ids)
        ends = np.cumsum(sizes + 2)
        self.first = ends - (sizes + 2)
        self.doc_of = np.repeat(np.arange(n), sizes + 2)
        tokens = np.empty(int(ends[-1]) if n else 0, np.int64)
        inside = np.ones(len(tokens), bool)
        inside[self.first] = inside[ends - 1] = False
        tokens[inside], tokens[ends - 1], tokens[self.first] = codes, len(words), len(words) + 1
        names = np.fromiter((xxhash.xxh64_intdigest(w) for w in [*words, END, START]), np.uint64, len(words) + 2)
        self.tokens, self.start_word = tokens, len(words) + 1
        place = np.arange(len(tokens)) - self.first[self.doc_of]
        training = ~self.held[self.doc_of]
        self.hashes, self.counts, self.at, self.own = [], [], [], []
        gram = names[tokens]
        for k in range(order):
            if k:
                longer = np.zeros_like(gram)
                longer[1:] = mixed(gram[:-1], names[tokens[1:]])
                gram = longer
            fits = np.flatnonzero(place >= k)
            hashes, at, index = np.unique(gram[fits] >> _CUT, return_index=True, return_inverse=True)
            own = np.full(len(tokens), -1, np.int32)
            own[fits] = index
            self.hashes.append(hashes)
            self.at.append(fits[at])
            self.own.append(own)
            self.counts.append(np.bincount(index, weights=training[fits], minlength=len(hashes)).astype(np.int64))

    def cuts(self, k: int, parts: int) -> np.ndarray:
        """Where the sorted hashes pass from one model part to the next."""
        edges = np.array([(i << HASH_BITS) // parts for i in range(parts)], dtype=np.uint64)
        return np.append(np.searchsorted(self.hashes[k], edges), len(self.hashes[k]))


BLOCKS = "block long, tokens long, docs binary"


def _write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive documents of a task, packed, as a row for each block."""
    held, size, n, part = [], 0, 0, TaskContext.get().partitionId() << 32

    def packed():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in held:
                out.write_batch(b)
        return pa.record_batch({"block": pa.array([part + n], pa.int64()), "tokens": pa.array([size], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for batch in batches:
        step = max(1, int(batch.num_rows * 500_000 / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            held.append(some)
            size += some.num_rows + some.column(1).nbytes // 6  # about a token each six bytes
            if size >= BLOCK_TOKENS:
                yield packed()
                held, size, n = [], 0, n + 1
    if held:
        yield packed()


def _unpacked(docs: bytes, order: int) -> Block:
    table = pa.ipc.open_stream(docs).read_all()
    texts = table.column(1).cast(pa.large_string()).combine_chunks()
    return Block(table.column(0).to_pylist(), texts if isinstance(texts, pa.Array) else texts.chunk(0), order)


# --- asking the model's parts -----------------------------------------------------------------------


def _pack(sorted_hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes as differences, byte plane by byte plane, then counts; compressed."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes() + counts.astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    n = len(raw) // 12
    planes = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u8").ravel(), dtype=np.uint64), np.frombuffer(raw, "<u4", n, 8 * n)


def _totals(counts: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _counts(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


ASK = "part int, block long, slices array<binary>"
ANSWER = "block long, part int, slices array<binary>, n_tokens long, n_types long"
ANSWER_TYPES = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.int64()]
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _ask(order: int, parts: int):
    """Blocks -> a row for each part that owns some of a block's n-grams: its slice of each order."""

    def run(batches):
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("slices", pa.list_(pa.binary()))])
        for batch in batches:
            for block_id, docs in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                block = _unpacked(docs.as_py(), order)
                cuts = [block.cuts(k, parts) for k in range(order)]
                asked = np.flatnonzero(np.any([c[1:] > c[:-1] for c in cuts], axis=0))
                for some in np.split(asked, range(256, len(asked), 256)):
                    rows = [
                        {"part": p, "block": block_id, "slices": [_pack(block.hashes[k][c[p] : c[p + 1]], block.counts[k][c[p] : c[p + 1]]) for k, c in enumerate(cuts)]}
                        for p in some.tolist()
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                del block, rows  # before the next one is made

    return run


def summed(asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], int, int]:
    """Totals of equal hashes over sorted (hashes, counts), in each one's own order; and, the start mark aside, the sum of
    all counts and the number of hashes counted at all. About SUMMED entries are in the works at once."""
    n = sum(len(h) for h, _ in asked)
    steps = max(1, -(-n // SUMMED))
    longest = max((h for h, _ in asked), key=len)
    edges = [longest[len(longest) * i // steps] for i in range(1, steps)]
    at = [np.concatenate(([0], np.searchsorted(h, edges), [len(h)])).astype(np.int64) for h, _ in asked]
    out, tokens, types = [[] for _ in asked], 0, 0
    for i in range(steps):
        hashes, index = np.unique(np.concatenate([h[a[i] : a[i + 1]] for (h, _), a in zip(asked, at, strict=True)]), return_inverse=True)
        sums = np.bincount(index, weights=np.concatenate([c[a[i] : a[i + 1]] for (_, c), a in zip(asked, at, strict=True)]), minlength=len(hashes)).astype(np.int64)
        real = hashes != _START_HASH
        tokens, types = tokens + int(sums[real].sum()), types + int((sums[real] > 0).sum())
        given = np.split(sums[index], np.cumsum([a[i + 1] - a[i] for a in at])[:-1])
        for o, g in zip(out, given, strict=True):
            o.append(g)
    return [np.concatenate(o) for o in out], tokens, types


def _answer(order: int):
    """A model part: totals of its n-grams for each block that asked, and a row of its own with its tokens and words."""

    def run(table: pa.Table) -> pa.Table:
        slices = table["slices"].to_pylist()
        answers, n_tokens, n_types = [[] for _ in slices], 0, 0
        for k in range(order):
            totals, tokens, types = summed([_unpack(s[k]) for s in slices])
            n_tokens, n_types = (tokens, types) if k == 0 else (n_tokens, n_types)
            for a, t in zip(answers, totals, strict=True):
                a.append(_totals(t))
        n, part = len(slices), table["part"][0].as_py()
        columns = [[*table["block"].to_pylist(), None], [part] * (n + 1), [*answers, None], [None] * n + [n_tokens], [None] * n + [n_types]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, ANSWER_TYPES, strict=True)], names=[c.split()[0] for c in ANSWER.split(", ")])

    return run


# --- the automaton -----------------------------------------------------------------------------------


class Automaton:
    """The states and arcs that a block's documents can reach.

    States are the contexts, of order - 1 words at most, that training has seen; 0 is the empty one. A
    state's failure arc leads to the context without its first word. An arc of a state and a word
    exists where training has seen the two together, and at state 0 for every word; it leads to
    the longest context that ends with that word. ``keys`` are the arcs as state * words + word, sorted.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n_tokens: int, n_types: int, mu: float):
        self.words, self.order = len(block.tokens) and int(block.tokens.max()) + 1, block.order
        self.failure, self.failure_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        keys, weights, targets = [], [], []
        p_shorter = shorter_state = None
        made = 1
        for k in range(block.order):
            at, count = block.at[k], counts[k].astype(float)
            word = block.tokens[at]
            if k == 0:
                context, known = np.zeros(len(at), np.int64), np.ones(len(at), bool)
                p = (count + 0.1) / (n_tokens + 0.1 * (n_types + 1))
                suffix = np.zeros(len(at), np.int64)
                self.base = np.log10(p)
            else:
                before, tail = block.own[k - 1][at - 1], block.own[k - 1][at]  # the context, and the k-gram without its first word
                context, known = shorter_state[before], count > 0
                held = counts[k - 1][before].astype(float)
                p = (count + mu * p_shorter[tail]) / (held + mu)
                suffix = shorter_state[tail]
            state = np.zeros(len(at), np.int64)
            seen = counts[k] > 0
            if k < block.order - 1:
                state[seen] = made + np.arange(seen.sum())
                made += int(seen.sum())
                self.failure.append(suffix[seen])
                self.failure_weight.append(np.log10(mu / (count[seen] + mu)))
                target = np.where(seen, state, suffix)
            else:
                target = suffix
            keys.append((context * self.words + word)[known])
            weights.append(np.log10(p)[known])
            targets.append(target[known])
            p_shorter, shorter_state = p, state
        self.failure, self.failure_weight = np.concatenate(self.failure), np.concatenate(self.failure_weight)
        self.keys, self.weights, self.targets = np.concatenate(keys), np.concatenate(weights), np.concatenate(targets)
        del keys, weights, targets
        by = np.argsort(self.keys)
        self.keys, self.weights, self.targets = self.keys[by], self.weights[by], self.targets[by].astype(np.int32)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From states by words: the next states and the weights on the way, failure arcs included."""
        weight, state = np.zeros(len(state)), state.copy()
        left = np.arange(len(state))
        while len(left):
            key = state[left] * self.words + word[left]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            there, arc = left[found], arc[found]
            weight[there] += self.weights[arc]
            state[there] = self.targets[arc]
            left = left[~found]
            weight[left] += self.failure_weight[state[left]]
            state[left] = self.failure[state[left]]
        return state, weight

    def traverse(self, block: Block) -> np.ndarray:
        """Each document's summed log10 weights.

        All documents are read at once, a token of each at a time. Long ones are cut into lanes of LANE
        tokens. A state is the longest known context that ends the text so far, so it depends on the last
        order - 1 tokens alone: a lane reads these from state 0 first and then has the state that the
        whole traversal would carry there.
        """
        n = np.diff(np.append(block.first, len(block.tokens)))
        lanes = -(-(n - 1) // LANE)
        doc = np.repeat(np.arange(len(n)), lanes)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = block.first[doc] + 1 + turn * LANE
        last = np.minimum(first + LANE, block.first[doc] + n[doc])
        begin = np.maximum(block.first[doc], first - (self.order - 1 or 1))
        by = np.argsort(begin - last, kind="stable")
        doc, first, begin, length = doc[by], first[by], begin[by], (last - begin)[by]
        state, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
        for t in range(length[0] if len(length) else 0):
            live = int(np.searchsorted(-length, -t, "left"))
            at = begin[:live] + t
            state[:live], weight = self.step(state[:live], block.tokens[at])
            total[:live] += np.where(at >= first[:live], weight, 0.0)
        return np.bincount(doc, weights=total, minlength=len(n))


def _score(order: int, n_tokens: int, n_types: int, mu: float):
    def run(table: pa.Table) -> pa.Table:
        part, slices = table["part"].to_numpy(), table["slices"].to_pylist()
        by_part = np.argsort(part)  # the block itself is part -1
        block = _unpacked(slices[by_part[0]][0], order)
        counts = [np.concatenate([_counts(slices[i][k]) for i in by_part[1:]]) for k in range(order)]
        automaton = Automaton(block, counts, n_tokens, n_types, mu)
        block.hashes, block.at, block.counts, block.own[1:] = [], [], [], []
        score = automaton.traverse(block)
        real = block.tokens != block.start_word
        own, doc, n = block.own[0][real], block.doc_of[real], len(block.ids)
        total = lambda x: np.bincount(doc, weights=x, minlength=n)
        return pa.table({
            "doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(np.bincount(doc, minlength=n), pa.int64()),
            "n_known": pa.array(total(counts[0][own] > 0).astype(np.int64), pa.int64()), "train_tokens": pa.array([n_tokens] * n, pa.int64()),
            "base_score": pa.array(total(automaton.base[own]), pa.float64()), "score": pa.array(score, pa.float64()),
        })

    return run


def score(docs: DataFrame, order: int = 3, mu: float = 30.0) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each document.

    Learns from the documents that is_held_out() is false for; order: words in the longest n-gram; mu:
    how many observations the shorter context counts for. Null and empty texts are an end token alone.
    Null ids are held out. Repeated rows count, and are scored, as often as they occur. An empty table
    gives no rows, and without training documents all weights come from the 0.1 per word. Other columns
    are not looked at. Two n-grams of equal hashes share a count: of D distinct ones, about D^2 / 2^57 pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(releasing(_write_blocks), BLOCKS), "lm-blocks")
    n_blocks, size = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-size // PART_TOKENS))
    asked = blocks.mapInArrow(releasing(_ask(order, parts)), ASK)
    answers = materialize(asked.repartition(parts, "part").groupBy("part").applyInArrow(_answer(order), ANSWER), "lm-answers")
    n_tokens, n_types = answers.where("block is null").agg(F.sum("n_tokens"), F.sum("n_types")).first()
    own = blocks.select("block", F.lit(-1).alias("part"), F.array("docs").alias("slices"))
    met = own.union(answers.where("block is not null").select("block", "part", "slices"))
    return met.repartition(max(least, n_blocks), "block").groupBy("block").applyInArrow(_score(order, n_tokens or 0, n_types or 0, mu), SCORES)
