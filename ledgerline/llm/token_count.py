"""Token counts by dynamic programming over a trie of pre-tokens.

A unigram tokenizer cuts a pre-token (a word, with a mark for the space before it) into the pieces whose
scores add up highest. The best score of a prefix depends on that prefix alone, so distinct pre-tokens
are inserted in a trie whose nodes hold the forward score and the pieces of their prefix: each is
computed once, however many pre-tokens share it, and stays for later batches. Where a pre-token ends,
the count of its pieces is stored. A worker keeps NODES nodes and MEMORY ends at most and then starts
anew, so its memory is bounded and every text is counted whole.
"""

from __future__ import annotations

import hashlib
import math
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import releasing, small_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MEMORY, NODES = 400_000, 600_000
#: What a character of no piece costs besides the least score of all pieces.
UNKNOWN = 10.0


def pieces_of(model: str) -> dict[str, float]:
    """A SentencePiece file's pieces with log scores by rank (Zipf's law): the file gives an order of merges, not probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    normal = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(normal))))
    return {p: -math.log(k + 1) - total for k, p in enumerate(normal)}


class Trie:
    """Nodes of pre-tokens' prefixes, with their best scores and counts, and the counts of whole pre-tokens."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.ends = pieces, {}
        self.longest: dict[str, int] = {}  # the longest piece that ends with a character
        for p in pieces:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.clear()

    def clear(self) -> None:
        """The root alone: child nodes by (node, character), and each node's score and count."""
        self.child, self.score, self.count = {}, array("d", [0.0]), array("q", [0])
        self.ends.clear()

    def insert(self, word: str) -> int:
        """Walk a word's path, adding what is missing, and store its count of pieces. A character of no piece counts its UTF-8 bytes."""
        text, node, path = SPACE + word, 0, [0]
        pieces, longest, child, score, count = self.pieces, self.longest, self.child, self.score, self.count
        for end, c in enumerate(text, 1):
            below = child.get((node, c))
            if below is None:
                best, n = -math.inf, 0
                for start in range(max(0, end - longest.get(c, 0)), end):
                    p = pieces.get(text[start:end])
                    if p is not None:
                        at = path[start]
                        x = score[at] + p
                        if x >= best and (x > best or count[at] + 1 < n):
                            best, n = x, count[at] + 1
                if c not in pieces and (x := score[node] + self.unknown) > best:
                    best, n = x, count[node] + len(c.encode("utf-8", "surrogatepass"))
                below = child[node, c] = len(score)
                score.append(best)
                count.append(n)
            path.append(below)
            node = below
        self.ends[word] = count[node]
        return count[node]

    def counts(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            n = self.ends.get(word)
            if n is None:
                if len(self.score) > NODES or len(self.ends) >= MEMORY:
                    self.clear()
                n = self.insert(word)
            out[i] = n
        return out


#: Bytes of text counted at once, about.
TEXT_BYTES = 8_000_000


def _counter(pieces: dict[str, float]):
    name = "trie " + hashlib.sha256(repr(sorted(pieces.items())).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        # A worker process keeps the trie of the last vocabulary.
        kept = sys.modules.setdefault("_ledgerline_worker", types.ModuleType("_ledgerline_worker")).__dict__
        if kept.get("trie", (None,))[0] != name:
            kept["trie"] = name, Trie(pieces)
        trie = kept["trie"][1]
        for batch in batches:
            step = max(1, int(batch.num_rows * TEXT_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cut = pc.ascii_split_whitespace(pc.fill_null(part.column(1), ""))
                numbered = cut.flatten().dictionary_encode()
                words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
                # Splitting an empty text, or white space at an end, leaves an empty word.
                size = np.array([n * bool(w) for n, w in zip(trie.counts(words).tolist(), words, strict=True)], np.int64)
                real = np.array([bool(w) for w in words], np.int64)
                index = numbered.indices.to_numpy()
                place = cut.offsets.to_numpy() - cut.offsets[0].as_py()
                tokens, words_ = (np.concatenate(([0], np.cumsum(x[index] if len(index) else []))).astype(np.int64)[place] for x in (size, real))
                yield pa.record_batch({"doc_id": part.column(0), "n_words": pa.array(np.diff(words_)), "n_tokens": pa.array(np.diff(tokens))})

    return run


def count_tokens(docs: DataFrame, pieces: dict[str, float] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_tokens``.

    Words stand between ASCII white space. pieces: a vocabulary with log scores; n_tokens counts the
    pieces of the best cut by these scores. The default is pieces_of() for the 32k SentencePiece file, whose
    scores stand in for missing probabilities: n_tokens is then not what that file's own BPE gives. Null, empty and blank texts have no tokens. Of equally
    good cuts the one with fewer pieces counts. Repeated rows each keep a row; other columns are not
    looked at.
    """
    if pieces is None:
        import public_tokenizers

        pieces = pieces_of(public_tokenizers.path(MODEL))
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(_counter(pieces)), "doc_id long, n_words long, n_tokens long")
