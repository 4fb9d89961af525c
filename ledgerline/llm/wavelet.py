"""Token-ID files: one wavelet matrix a shard.

Documents in ascending id order are dealt to shards by id range, encoded, and written as one file a
shard. The file holds the shard's ids as bit planes over the alphabet that it uses, each plane with
counts of ones per block, so that access, rank, select, counting and occurrence lookup read planes
instead of ids. All parts are compressed (zstd).

File: ``LWM1``, u32 header length, a JSON header, then the parts that the header lists (offset, bytes):
the alphabet (ascending u32), documents' ids (i64, with a null mask) and end positions (i64), the planes
(bits, least first) and their block counts (u64).
"""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import drop, materialize, new_folder, releasing, small_batches
from ledgerline.operators.ordering import running

MAGIC = b"LWM1"
#: Bits whose ones one count covers.
RANK_BLOCK = 512
#: A shard's file is closed at this many tokens; a longer document has a file of its own.
SHARD_TOKENS = 2_000_000
#: Distinct pieces of text whose ids a worker remembers.
MEMORY = 300_000
#: Bytes of text encoded at once, about.
TEXT_BYTES = 6_000_000
TOKENIZER, END_ID = "word_bpe_49k.json", 2


class WaveletMatrix:
    """A sequence of u32 symbols: ``m[i]``, rank, select, count and positions from bit planes."""

    def __init__(self, alphabet: np.ndarray, planes: Sequence[np.ndarray], ranks: Sequence[np.ndarray], n: int, zeros: list[int] | None = None):
        self.alphabet, self.planes, self.ranks, self.n = alphabet, planes, ranks, n
        self.zeros = zeros if zeros is not None else [n - int(self._ones(k, n)) for k in range(len(planes))]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        if len(ids) and int(ids.max()) < 1 << 22:
            alphabet = np.flatnonzero(np.bincount(ids))
            place = np.zeros(int(alphabet[-1]) + 1, np.uint32)
            place[alphabet] = np.arange(len(alphabet))
            codes = place[ids]
        else:
            alphabet, codes = np.unique(ids, return_inverse=True) if len(ids) else (np.zeros(0, np.uint32), ids)
        depth = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
        rest, planes, ranks = codes.astype(np.uint16 if depth <= 16 else np.uint32), [], []
        for level in range(depth - 1, -1, -1):
            bit = (rest & rest.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            padded = np.zeros(-(-len(bit) // RANK_BLOCK) * RANK_BLOCK // 8, np.uint8)
            padded[: len(planes[-1])] = planes[-1]
            whole = np.bitwise_count(padded.view(np.uint64)).reshape(-1, RANK_BLOCK // 64).sum(axis=1, dtype=np.uint64)
            ranks.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(whole, dtype=np.uint64))))
            zeros, below = len(bit) - np.count_nonzero(bit), np.empty_like(rest)
            np.compress(bit, rest, out=below[zeros:])
            np.compress(np.logical_not(bit, out=bit), rest, out=below[:zeros])
            rest = below
        return cls(alphabet.astype(np.uint32), planes, ranks, len(ids))

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block = i // RANK_BLOCK
        part = self.planes[level][block * RANK_BLOCK // 8 : (i + 7) // 8]
        inside = i - block * RANK_BLOCK
        bits = int.from_bytes(part.tobytes(), "little") & ((1 << inside) - 1)
        return int(self.ranks[level][block]) + bits.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _select(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) bit of a kind is in a level."""
        counts = self.ranks[level].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * RANK_BLOCK, self.n) - counts
        block = int(np.searchsorted(counts, k, "right")) - 1
        part = np.unpackbits(self.planes[level][block * RANK_BLOCK // 8 : (block + 1) * RANK_BLOCK // 8], bitorder="little")[: self.n - block * RANK_BLOCK]
        return block * RANK_BLOCK + int(np.flatnonzero(part == bit)[k - int(counts[block])])

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        code = 0
        for level, z in enumerate(self.zeros):
            one, bit = self._ones(level, i), self._bit(level, i)
            code = code << 1 | bit
            i = z + one if bit else i - one
        return int(self.alphabet[code])

    def _walk(self, symbol: int, i: int, j: int) -> tuple[int, int, int] | None:
        """The symbol's code, and where positions i and j come to stand below the last plane."""
        code = int(np.searchsorted(self.alphabet, symbol))
        if code == len(self.alphabet) or self.alphabet[code] != symbol:
            return None
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, i), self._ones(level, j)
            i, j = (z + a, z + b) if code >> (len(self.zeros) - 1 - level) & 1 else (i - a, j - b)
        return code, i, j

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences among the first i."""
        found = self._walk(symbol, 0, i)
        return found[2] - found[1] if found else 0

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        found = self._walk(symbol, start, self.n if stop is None else stop)
        return found[2] - found[1] if found else 0

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        found = self._walk(symbol, 0, self.n)
        if not found or not 0 <= k < found[2] - found[1]:
            raise IndexError(f"symbol {symbol} has no occurrence {k}")
        code, i = found[0], found[1] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = code >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def positions(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All symbols, by undoing the planes from the last to the first."""
        codes = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            z, above = self.zeros[-1 - k], np.empty_like(codes)
            codes[z:] |= codes.dtype.type(1 << k)
            above[np.flatnonzero(bit)] = codes[z:]
            above[np.flatnonzero(~bit)] = codes[:z]
            codes = above
        return self.alphabet[codes] if self.n else np.zeros(0, np.uint32)


def to_bytes(ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> bytes:
    matrix = WaveletMatrix.of(ids)
    keys = np.array([0 if i is None else i for i in doc_ids], "<i8")
    parts = {"alphabet": matrix.alphabet.astype("<u4"), "doc_ids": keys, "nulls": np.array([i is None for i in doc_ids], np.uint8), "ends": np.asarray(ends, "<i8")}
    parts |= {f"plane{k}": p for k, p in enumerate(matrix.planes)} | {f"ranks{k}": r.astype("<u8") for k, r in enumerate(matrix.ranks)}
    packer, body, at, places = zstandard.ZstdCompressor(level=1), [], 0, {}
    for name, values in parts.items():
        data = packer.compress(values.tobytes())
        places[name] = [at, len(data)]
        body.append(data)
        at += len(data)
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "depth": len(matrix.planes), "zeros": matrix.zeros, "rank_block": RANK_BLOCK, "parts": places}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *body])


class _Parts(Sequence):
    """Arrays that are decompressed when first asked for: a lookup that ends early leaves the deeper planes packed."""

    def __init__(self, names: list[str], load):
        self.names, self.load, self.held = names, load, {}

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, k: int) -> np.ndarray:
        k = range(len(self.names))[k]
        if k not in self.held:
            self.held[k] = self.load(self.names[k])
        return self.held[k]


class Shard:
    """A shard's file: its documents, and its ids as a WaveletMatrix.

    Planes and ranks are decompressed as they are needed: for a token that the shard lacks, none is.
    """

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(data[4:8], "little")
        head, base = json.loads(data[8 : 8 + size]), 8 + size

        def part(name: str, kind: str) -> np.ndarray:
            at, n = head["parts"][name]
            return np.frombuffer(zstandard.decompress(data[base + at : base + at + n]), kind)

        self.n_docs, self._part = head["docs"], part
        empty, levels = not head["n"], range(head["depth"])
        planes = _Parts([f"plane{k}" for k in levels], (lambda _: np.zeros(0, "u1")) if empty else lambda name: part(name, "u1"))
        self.ids = WaveletMatrix(np.zeros(0, "<u4") if empty else part("alphabet", "<u4"), planes, _Parts([f"ranks{k}" for k in levels], lambda name: part(name, "<u8")), head["n"], head["zeros"])

    @cached_property
    def doc_ids(self) -> list[int | None]:
        if not self.n_docs:
            return []
        return [None if null else int(i) for i, null in zip(self._part("doc_ids", "<i8"), self._part("nulls", "u1"), strict=True)]

    @cached_property
    def ends(self) -> np.ndarray:
        return self._part("ends", "<i8") if self.n_docs else np.zeros(0, "<i8")


#: Characters that the tokenizer file splits from letters before them; the apostrophe, which may start a suffix, is not one.
TAIL = ".,!?;:"


class _Pieces(dict):
    """Ids of pieces of text, as little-endian u32 bytes; made on first use."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.tails = tokenizer, tokenizer.model, {}
        self.letters = {chr(c): "".join(_BYTE_LETTERS[b] for b in chr(c).lower().encode()) for c in range(128, 0x250)}

    def ids(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        # Latin letters and then perhaps end marks are two units to the tokenizer: the letters go to its model
        # directly, lower-cased and with bytes as letters, which is what its own first steps make of them. Some
        # Latin capitals have their small letters beyond the table of letters (U+018F is one): those are encoded whole.
        core = piece.rstrip(TAIL)
        low = core.lower()
        if low.isalpha() and core.isalpha() and (core.isascii() or max(core) < "\u0250" and max(low) < "\u0250"):
            word = low if low.isascii() else "".join([self.letters.get(c, c) for c in low])
            found = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
            tail = piece[len(core) :]
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = self.ids(tail)
                found += self.tails[tail]
        else:
            found = self.ids(piece)
        if len(self) >= MEMORY:
            self.clear()
        self[piece] = found
        return found


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(other) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Texts to ids with a tokenizer file. White space ends every piece, so texts are cut at spaces and line
    ends, and the ids of each distinct piece are remembered (up to MEMORY of them, then anew) for as long
    as the worker process lives."""

    def __init__(self, tokenizer: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = sys.modules.setdefault("_ledgerline_worker", types.ModuleType("_ledgerline_worker")).__dict__
        name = f"pieces {zlib.crc32(tokenizer)} {len(tokenizer)}"
        if name not in kept:
            kept[name] = _Pieces(Tokenizer.from_buffer(tokenizer))
        self.known = kept[name]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Arrow cuts the texts and numbers their distinct pieces; ids are then gathered by number."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        numbered = cut.flatten().dictionary_encode()
        found = list(map(self.known.__getitem__, numbered.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, ids = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4")
        piece = numbered.indices.to_numpy()
        n = size[piece]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat(first[piece] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def _write_file(path: str, data: bytes) -> None:
    """Whole or not at all: a task that runs again puts the same file in place."""
    system, place = _file_system(path)
    part = f"{place}.{TaskContext.get().taskAttemptId()}.tmp"
    system.create_dir(os.path.dirname(place), recursive=True)
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, place)


def _writer(folder: str, tokenizer: bytes, end_id: int, shard_tokens: int):
    """Encode a partition's documents (in order) and write its shard files; a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, encode = TaskContext.get().partitionId(), 0, Encoder(tokenizer).encode
        ids, doc_ids, size = [], [], 0

        def close():
            nonlocal ids, doc_ids, size, seq
            name = f"shard-{part:06d}-{seq:04d}.lwm"
            ends = np.cumsum([len(x) for x in ids])
            _write_file(f"{folder}/{name}", to_bytes(np.concatenate(ids), doc_ids, ends))
            row = pa.record_batch({"name": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": pa.array([len(ids)], pa.int64()), "tokens": pa.array([size], pa.int64())})
            ids, doc_ids, size, seq = [], [], 0, seq + 1
            return row

        end = np.array([end_id], np.uint32)
        for batch in batches:
            step = max(1, int(batch.num_rows * TEXT_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                for doc_id, x in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    if size and size + len(x) + 1 > shard_tokens:
                        yield close()
                    ids += [np.concatenate((x, end))]
                    doc_ids.append(doc_id)
                    size += len(x) + 1
        if ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int | None = None) -> tuple[str, DataFrame]:
    """Encode whole texts and write shard files in ascending doc_id order; the folder and its index.

    The index has a row for each file: ``name, docs, tokens, base``, base being the tokens in all files
    before it. Null ids come first; rows of one id follow each other, ordered by text. A null text is
    empty: its end id alone. folder must be one that all executors can write (default: in the shared
    folder). shard_tokens: tokens of a file, but that a longer document is one file. An empty table writes no
    file. Other columns are not written. The index is a table in the shared folder.
    """
    import public_tokenizers

    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "tokens")
    with open(tokenizer or public_tokenizers.path(TOKENIZER), "rb") as f:
        model = f.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The hash spreads rows of one id, should a third of them share it.
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    writer = _writer(folder, model, end_id, shard_tokens or SHARD_TOKENS)
    files = materialize(ordered.mapInArrow(releasing(writer), "name string, part int, seq int, docs long, tokens long"), "token-files")
    index = running(files, ["part", "seq"], ["tokens"], suffix="_before").select("name", "docs", "tokens", F.col("tokens_before").alias("base"))
    index = materialize(index, "token-index")
    drop(files)
    return folder, index


def _open(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """``(name, base, content)`` of the index's files."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.join(index.select("name", "base"), "name")


def read_tokens(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` for each document, from the files. ids: little-endian u32, as bytes."""
    return _open(spark, folder, index).mapInArrow(releasing(_reader(True)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary").select("doc_id", "start", "n_tokens", "ids")


def check_tokens(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` for each document, from the files."""
    return _open(spark, folder, index).mapInArrow(releasing(_reader(False)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _reader(with_ids: bool):
    def run(batches):
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(data.as_py())
                ids = np.ascontiguousarray(shard.ids.decode().astype("<u4"))
                starts = np.concatenate(([0], shard.ends[:-1]))
                texts = [ids[a:b].tobytes() for a, b in zip(starts, shard.ends, strict=True)]
                out = {
                    "doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(starts + base, pa.int64()), "n_tokens": pa.array(shard.ends - starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in texts], pa.int64()),
                } | ({"ids": pa.array(texts, pa.binary())} if with_ids else {})
                yield pa.record_batch(out)

    return run


def occurrences(spark: SparkSession, folder: str, index: DataFrame, token: int) -> DataFrame:
    """``(doc_id, position)`` of a token id, position counted in all ids, by select on each file's planes."""

    def run(batches):
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(data.as_py())
                found = np.array(shard.ids.positions(token), np.int64)
                doc = np.searchsorted(shard.ends, found, "right")
                yield pa.record_batch({"doc_id": pa.array([shard.doc_ids[i] for i in doc], pa.int64()), "position": pa.array(found + base, pa.int64())})

    return _open(spark, folder, index).mapInArrow(releasing(run), "doc_id long, position long")


def token_counts(spark: SparkSession, folder: str, index: DataFrame, tokens: list[int]) -> DataFrame:
    """``(token, n)`` over all files, by rank on the planes."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                shard = Shard(data.as_py())
                yield pa.record_batch({"token": pa.array(tokens, pa.int64()), "n": pa.array([shard.ids.count(t) for t in tokens], pa.int64())})

    return _open(spark, folder, index).mapInArrow(releasing(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def tokenize(docs: DataFrame, **how) -> DataFrame:
    """Write the documents' ids to shard files and report each document as read back. See write_tokens()."""
    folder, index = write_tokens(docs, **how)
    if not index.take(1):
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return check_tokens(docs.sparkSession, folder, index)
