"""Chat formatting: collapse cumulative snapshots of conversations, then render the maximal ones.

Logs often hold a conversation again and again as it grows. A conversation's turns get rolling hashes:
the k-th covers the first k turns. A conversation whose full hash is the hash of a proper prefix of
another is a snapshot of that one; an anti-join drops it. Of equal conversations the one of the
smallest id stays. What is left is rendered. The hashes of all proper prefixes are folded to distinct
ones before the join, so that a first turn which a third of all conversations share is one row.

The k-th hash is the sum, over the first k turns, of 140 bits of the SHA-256 of a turn's place and
content, kept as five sums of 28 bits: running sums of a window, which one task makes for a conversation
and which spill, so no conversation's turns are gathered before it is known to stay. Conversations of
different turns would have to add up alike to be taken for one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize

#: Sums of seven hex digits each.
LANES, DIGITS = ("h0", "h1", "h2", "h3", "h4"), 7


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, k, n, role, text`` and the hash of the first k turns, for each turn."""
    rows = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    own = Window.partitionBy("conv_id")
    in_order = own.orderBy("turn", "role", "text")  # nulls first
    said = [F.concat(F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text")]
    placed = rows.withColumn("k", F.row_number().over(in_order).cast("long"))
    digest = F.sha2(F.concat_ws(" ", F.col("k").cast("string"), F.sha2(said[0], 256), F.sha2(said[1], 256)), 256)
    hashed = placed.withColumn("digest", digest)
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    sums = {h: F.sum(F.conv(F.substring("digest", 1 + DIGITS * i, DIGITS), 16, 10).cast("long")).over(upto) for i, h in enumerate(LANES)}
    return hashed.withColumns(sums).withColumn("n", F.max("k").over(own)).drop("digest", "turn")


def _maximal(turns: DataFrame) -> DataFrame:
    prefixes = turns.where("k < n").select(F.col("k").alias("length"), *LANES).distinct()
    whole = turns.where("k = n").groupBy(F.col("n").alias("length"), *LANES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    return whole.join(prefixes, ["length", *LANES], "left_anti").select("conv_id", F.col("length").alias("n_turns"), "n_copies")


def maximal(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)``: conversations that are no proper prefix of another, one of each group of equals."""
    return _maximal(materialize(_turns(conversations).drop("role", "text"), "chat-hashes"))


def format_chats(conversations: DataFrame, before: str = "<|", between: str = "|>\n", after: str = "\n") -> DataFrame:
    """``(conv_id, n_turns, n_copies, text)``: the maximal conversations, rendered turn by turn as before + role + between + text + after.

    Turns are ordered by turn number, then role and text, nulls first; rows that are equal in all of them
    are turns of their own. A null role or text is rendered as nothing, but is not equal to an empty one.
    Rows of null conv_id form one conversation, kept unless it is a prefix or an equal of another. A
    conversation is one row of the result, so one that is kept must fit in a row. An empty table gives no
    rows. Other columns are not looked at.
    """
    turns = materialize(_turns(conversations), "chat-turns")
    kept = _maximal(turns).withColumnRenamed("conv_id", "id")
    spoken = turns.select("conv_id", "k", "role", "text").join(kept, turns["conv_id"].eqNullSafe(kept["id"]))
    line = lambda t: F.concat(F.lit(before), F.coalesce(t["role"], F.lit("")), F.lit(between), F.coalesce(t["text"], F.lit("")), F.lit(after))
    rendered = spoken.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("k", "role", "text"))).alias("turns"))
    return rendered.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", line), "").alias("text"))
