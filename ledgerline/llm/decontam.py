"""Benchmark decontamination by a broadcast hash set of test n-grams (DataFrame functions only).

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A window is 13 consecutive
words of a test item; a shorter item is one window. Two passes over the documents find every occurrence,
whatever lengths windows have:

1. Anchors. A document hashes only every s-th run of L words, with s + L - 1 = the window's length, and
   looks each up in the hash set of all L-word runs of the windows. Any occurrence of a window covers
   one whole aligned run, so no occurrence is missed, at 1/s of the hashes.
2. Verification. Documents with a hit compare the words of every window with those of the items.

The windows' tables are broadcast while they have at most MAX_BROADCAST rows, else joined by shuffle. Ids of
items come last, by sets: a passage that many items share costs a hit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, materialize

#: What lies between words, in a text whose A-Z are lower-case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BROADCAST = 200_000
NO_ITEMS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of nothing


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def _anchor(length: int) -> tuple[int, int]:
    """Words in an anchor and its stride, for windows of a length."""
    words = (length + 2) // 2 + 1 if length > 4 else length
    return words, length - words + 1


def test_windows(benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``(length, gram, items_id)``: the distinct windows as words joined by spaces; and ``(items_id, items)``: the sets of items
    that windows are in, as sorted ids. Windows of one set share a row there, however many items hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    grams = items.select(
        "item", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.array_join(F.slice("w", i, length), " "))).alias("gram")
    )
    held = grams.groupBy("length", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    held = materialize(held.withColumn("items_id", F.sha2(F.to_json("items"), 256)), "windows")
    return held.select("length", "gram", "items_id"), held.select("items_id", "items").dropDuplicates(["items_id"])


def _all_lengths(made: list[Column]) -> Column:
    return F.flatten(F.array(*made)) if len(made) > 1 else made[0]


def _runs(w: Column, starts: Column, words: int) -> Column:
    """Hashes of the runs of so many words at some places."""
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, words)))


def _grams(starts: Column, length: int) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice("w", i, length), " ").alias("gram")))


def _suspects(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Keys of the texts that hold an anchor of some window, for documents of ``(key, w)``. One pass makes the anchors of all lengths."""
    w, marks, runs = F.split("gram", " "), [], []
    for length in lengths:
        words, stride = _anchor(length)
        marks.append(F.when(F.col("length") == length, _runs(w, F.sequence(F.lit(1), F.lit(stride)), words)).otherwise(F.array().cast("array<bigint>")))
        starts = F.sequence(F.lit(1), F.size("w") - words + 1, F.lit(stride))
        runs.append(F.when(F.size("w") >= length, _runs(F.col("w"), starts, words)).otherwise(F.array().cast("array<bigint>")))
    marked = windows.select(F.explode(_all_lengths(marks)).alias("mark")).distinct()
    # The outer form: for the inner one the optimizer would infer a filter that hashes every run once more.
    each = docs.select("key", F.explode_outer(_all_lengths(runs)).alias("mark"))
    return each.join(_small(marked), "mark", "left_semi").select("key").distinct()


def _spans(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``(key, start, length, items_id)``: the verified windows, by the words' positions from 1, for ``(key, w)``."""
    made = []
    for length in lengths:
        made.append(F.when(F.size("w") >= length, _grams(F.sequence(F.lit(1), F.size("w") - length + 1), length)).otherwise(F.array().cast("array<struct<start:int,length:int,gram:string>>")))
    runs = texts.select("key", F.inline_outer(_all_lengths(made)))
    return runs.join(_small(windows), ["length", "gram"]).select("key", "start", "length", "items_id")


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hits(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame | None:
    """``(key, spans, items)`` per distinct text that holds a window; None if there are no windows.

    spans: sorted, disjoint ``(first, last)`` words.
    """
    windows, sets = test_windows(benchmark, n)
    lengths = [r[0] for r in windows.select("length").distinct().orderBy("length").collect()]  # n at most
    if not lengths:
        return None
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")
    suspects = materialize(_suspects(texts.select("key", words_of(F.col("text")).alias("w")), windows, lengths), "suspects")
    held = texts.join(_small(suspects), "key", "left_semi").select("key", words_of(F.col("text")).alias("w"))
    # One row per text, place and set of items first: copies of a text fold before the shuffle.
    spans = materialize(_spans(held, windows, lengths).groupBy("key", "start", "items_id").agg(F.max("length").alias("length")), "spans")
    own = spans.select("key", "items_id").distinct().join(_small(sets), "items_id")
    items = own.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    each = spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("length") - 1).alias("last")))).alias("runs"))
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"] - 1),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last")))),
    ).otherwise(F.concat(acc, F.array(x)))
    merged = F.aggregate("runs", F.slice("runs", 1, 0), step)
    return materialize(each.select("key", merged.alias("spans")).join(items, "key"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit inside any occurrence of a window; contaminated: some hit, and n_hit * share >= n_words.
    items_sha256 is of the ids of the items that occur, sorted as strings and comma-joined. Null and
    wordless texts have no words and no hits; items without words match nothing; items of null id count
    as hits but are not listed. Repeated rows and ids each keep a row. Other columns are not looked at.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    hits = _hits(docs, benchmark, n)
    if hits is None:
        rows = rows.withColumns({"spans": F.lit(None).cast("array<struct<first:int,last:int>>"), "items": F.lit(None).cast("array<string>")})
    else:
        rows = rows.join(_small(hits), "key", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"] + 1)), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, remove: str = "documents") -> DataFrame:
    """docs without their contaminated documents, or (``remove="spans"``) with the hit words cut out of those.

    Columns and their names stay as they are. Documents that are not contaminated stay untouched, null
    and empty ones too. Cut texts keep the rest of the text as it was written.
    """
    hits = _hits(docs, benchmark, n)
    if hits is None:
        return docs
    columns = docs.columns
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"))
    rows = packed.select("row", text_key(F.col("row.text")).alias("key"), F.size(words_of(F.col("row.text"))).alias("n_words"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"] + 1))
    rows = rows.join(_small(hits), "key", "left").withColumn("bad", F.coalesce(n_hit * share >= F.col("n_words"), F.lit(False)))
    if remove == "documents":
        return rows.where(~F.col("bad")).select([F.col(f"row.`{c}`") for c in columns])
    # Words and the gaps after them, as they stand in the text: gaps[0] comes before the first word.
    text = F.col("row.text")
    words = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    gaps = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    kept = F.transform(words, lambda x, i: F.when(F.exists("spans", lambda s: (s["first"] <= i + 1) & (i + 1 <= s["last"])), F.lit("")).otherwise(F.concat(x, F.get(gaps, i + 1))))
    cut = F.when(F.col("bad"), F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))).otherwise(text)
    return rows.select([(cut.alias("text") if c == "text" else F.col(f"row.`{c}`")) for c in columns])
