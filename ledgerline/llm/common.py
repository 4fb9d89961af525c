"""Shared pieces: memory of workers and batches, and rules that cut texts into words."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.graph import connected_components
from ledgerline.written import drop, materialize, new_folder, scratch

__all__ = ["ascii_lower", "connected_components", "drop", "materialize", "mixed", "new_folder", "numbered_words", "release_memory", "releasing", "scratch", "small_batches", "word_count"]

#: A run of anything but ASCII white space, as Java and RE2 both read it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Let Arrow batches of this session hold 16 MB at most: a batch of whole texts is in memory several
    times over, in the JVM and in Python. A smaller setting stays."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m").strip().lower()
    size = int(now[:-1]) << {"b": 0, "k": 10, "m": 20, "g": 30}[now[-1]] if now[-1].isalpha() else int(now)
    if size <= 0 or size > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def release_memory() -> None:
    """Give memory that was freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run):
    """A function of batches that gives back what it has freed when a task ends: worker processes live on, idle."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Texts of single-byte characters take the quicker built-in, which then does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of white-space-separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words (A-Z lower-cased, between ASCII white space) of some texts, each word's number in order, and how many words each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = cut.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    upto = np.concatenate(([0], np.cumsum(real)))
    places = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    coded = flat.filter(pa.array(real)).dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary())
    return words.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.diff(upto[places])


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of words and the words after them."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
