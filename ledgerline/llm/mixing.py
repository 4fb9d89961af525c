"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a 60-bit hash. A source's budget is a threshold on that hash: documents below it
are taken. The threshold is found by summing sizes per (source, 4,096 hash buckets), locating the
bucket where the running sum crosses the budget, and repeating inside that bucket alone, so nothing
is sorted and each pass shuffles at most 4,096 rows a source and task. Budgets are nested: a larger
one takes every document of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import drop, materialize, word_count
from ledgerline.operators.ordering import running

#: Levels of 12 bits that make up the 60-bit hash.
LEVELS, BITS = 5, 12
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Tasks that the rows of a source are dealt to where sources are not broadcast.
SALTS = 64


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text, so that rows of one id but other text do not tie."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """``(source, source_size)`` -> the same with ``target``. Sources are ordered by a window while they are few, else by ranges.

    Sources in code-point order, null last, take the weights in turn. Together they get ``budget`` times
    all sizes; no target is over ``cap`` times its source's size, and what that cuts off is shared among
    the others by weight. With sources in order of cap per weight, the level at which all others are
    filled follows from running sums of the caps and weights before each source.
    """
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    # Null last: an order that both ways share.
    named = sizes.select(F.struct(F.col("source").isNull().alias("no"), "source").alias("by"), "source", "source_size")
    ranked = named.withColumn("position", F.row_number().over(Window.orderBy("by"))) if few else running(named, ["by"])
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", w).withColumn("room", cap * F.col("source_size")).withColumn("per", F.col("room") / F.col("weight"))
    if few:
        before = Window.orderBy("per", "by").rowsBetween(Window.unboundedPreceding, -1)
        w = w.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("room", "weight")})
    else:
        w = running(w, ["per", "by"], ["room", "weight"], position="place")
    whole = w.agg(F.sum("source_size").alias("sizes"), F.sum("weight").alias("weights"))  # one row
    w = w.crossJoin(F.broadcast(whole))
    w = w.withColumn("level", (budget * F.col("sizes") - F.col("room_before")) / (F.col("weights") - F.col("weight_before")))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct("per", "level"))
    w = w.crossJoin(F.broadcast(w.agg(F.min(fits)["level"].alias("filled"))))
    return w.select("source", "source_size", F.least("room", F.coalesce(F.col("filled") * F.col("weight"), F.col("room"))).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``copies`` (whole passes over it), and the hash below which documents get one more.

    ``cut`` is the hash of the boundary documents, which get one more copy if ``at_cut``: then the sum
    comes nearer to the target than without them. rows: ``(source, size, hash)``.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    found = targets.withColumn("copies", copies).select(
        "source", "source_size", "target", "copies",
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"),
    )
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        at = found.select(F.col("source").alias("s"), "rest", "prefix")
        # Sums by bucket first: a source joins with 4,096 rows at level 0. Below, rows join by source and bucket, so that a
        # source's rows are spread over its buckets.
        per = rows if level else rows.groupBy("source", F.shiftleft(F.shiftright("hash", shift), shift).alias("hash")).agg(F.sum("size").alias("size"))
        inside = per.join(F.broadcast(at) if few else at, per["source"].eqNullSafe(at["s"]) & (F.shiftright(per["hash"], shift + BITS) == at["prefix"]))
        sums = inside.groupBy("s", "rest", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("sum"))
        upto = F.sum("sum").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        edge = sums.withColumn("upto", upto).where((F.col("upto") - F.col("sum") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        edge = edge.select("s", F.col("bucket").alias("prefix_"), (F.col("rest") - (F.col("upto") - F.col("sum"))).alias("rest_"), F.col("sum").alias("sum_"))
        found = found.join(edge, found["source"].eqNullSafe(edge["s"]), "left")
        found = found.select("source", "source_size", "target", "copies", F.col("rest_").alias("rest"), F.col("prefix_").alias("prefix"), F.col("sum_").alias("last"))
        found = materialize(found, "mix-level")  # a row a source; plans stay small
    return found.select("source", "source_size", "target", "copies", F.col("prefix").alias("cut"), (F.col("last") - F.col("rest") < F.col("rest")).alias("at_cut"))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("hash")
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The documents' narrow rows ``(doc_id, source, size, hash)`` and their sources' thresholds, both written."""
    rows = materialize(measured(docs), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, budget, cap), "mix-targets")
    found = thresholds(rows, targets)
    drop(targets)
    return rows, found


def _taken(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with their source's columns and ``n_copies``."""
    found = found.withColumnRenamed("source", "s")
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(found), rows["source"].eqNullSafe(F.col("s"))).drop("s")
    else:
        # A source's rows go to SALTS tasks, and its thresholds to each of them.
        salted = rows.withColumn("salt", F.pmod(F.col("hash"), F.lit(SALTS)))
        each = found.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(each, salted["source"].eqNullSafe(each["s"]) & (salted["salt"] == each["of"])).drop("s", "of", "salt")
    more = F.coalesce((F.col("hash") < F.col("cut")) | ((F.col("hash") == F.col("cut")) & F.col("at_cut")), F.lit(False))
    return joined.withColumn("n_copies", F.col("copies") + more.cast("long"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, in words.

    A null text has size 0 and is taken as 0 words. Null sources form one source. Rows equal in id,
    text and source share a hash, so they are taken together or not at all. An empty table gives none.
    """
    out = _taken(*plan(docs, **how))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents with the columns of docs, a row per copy taken.

    Documents of no words count nothing, so they go where their hash falls. Other columns of docs pass
    through whatever their names. See mix_report() for nulls and ties.
    """
    _, found = plan(docs, **how)
    columns = docs.columns
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"))
    rows = packed.select(
        "row", F.col("row.source").cast("string").alias("source"), document_hash(F.col("row.doc_id"), F.col("row.text")).alias("hash")
    )
    out = _taken(rows, found).where("n_copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("n_copies").cast("int"))))
    return out.select([F.col(f"row.`{c}`") for c in columns])
