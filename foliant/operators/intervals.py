"""Continuous periods and gaps of intervals, by a sweep line over signed boundary events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def sweep_intervals(df: DataFrame, entity: str, start: str, end: str, block_bits: int = 12) -> DataFrame:
    """Maximal continuous periods and the gaps between them, per entity.

    Each closed integer interval [start, end] becomes an event +1 at ``start`` and -1 at ``end + 1``; events are
    summed per position before the shuffle, so repeated rows and hot entities cost one row per distinct position.
    The prefix sum has two levels: blocks of 2**block_bits positions are summed, the blocks' sums are accumulated
    per entity, and positions are accumulated inside their block only. No task holds more than one block's positions
    or one entity's blocks.

    Rows whose entity or bound is null, with a negative start or with start > end take no part. Neighbouring positions
    are continuous. Other columns of ``df`` are ignored, whatever their names. An empty table gives no rows.

    Returns (entity, kind, start, end); kind is 'period' or 'gap'.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    valid = df.select(F.col(entity).alias("_e"), s.alias("_s"), e.alias("_t")).where(
        F.col("_e").isNotNull() & (F.col("_s") >= 0) & (F.col("_s") <= F.col("_t"))
    )
    events = (
        valid.select("_e", F.inline(F.array(F.struct(F.col("_s").alias("_p"), F.lit(1).alias("_d")), F.struct((F.col("_t") + 1).alias("_p"), F.lit(-1).alias("_d")))))
        .groupBy("_e", "_p")
        .agg(F.sum("_d").alias("_d"))
        .where("_d <> 0")
        .withColumn("_b", F.shiftright("_p", block_bits))
    )
    blocks = events.groupBy("_e", "_b").agg(F.sum("_d").alias("_t"))
    before = blocks.select("_e", "_b", (F.sum("_t").over(W.partitionBy("_e").orderBy("_b")) - F.col("_t")).alias("_base"))
    inside = W.partitionBy("_e", "_b").orderBy("_p")
    active = events.join(before, ["_e", "_b"]).select("_e", "_b", "_p", "_d", (F.col("_base") + F.sum("_d").over(inside)).alias("_n"))
    # a change between covered and empty; everything between two changes is one period or one gap
    turns = active.select("_e", "_b", "_p", (F.col("_n") > 0).alias("_on"), (F.col("_n") - F.col("_d") > 0).alias("_was")).where("_on <> _was")
    first = turns.groupBy("_e", "_b").agg(F.min("_p").alias("_f"))
    after = first.select("_e", "_b", F.lead("_f").over(W.partitionBy("_e").orderBy("_b")).alias("_nf"))
    nxt = F.coalesce(F.lead("_p").over(inside), F.col("_nf"))
    spans = turns.join(after, ["_e", "_b"]).select("_e", "_on", "_p", nxt.alias("_q")).where(F.col("_q").isNotNull())
    kind: Column = F.when(F.col("_on"), F.lit("period")).otherwise(F.lit("gap"))
    return spans.select(
        F.col("_e").alias(entity), kind.alias("kind"), F.col("_p").cast("int").alias(start), (F.col("_q") - 1).cast("int").alias(end)
    )
