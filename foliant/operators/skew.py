"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_HOT = 4096


def salted_join(left: DataFrame, right: DataFrame, on: list[str], per_key: int = 200_000, counts: DataFrame | None = None) -> DataFrame:
    """Inner equi-join of ``left`` and ``right`` on ``on``; keys of more than ``per_key`` left rows are spread over salts.

    Left rows are counted per key with map-side combining. Hot keys are at most rows / per_key, and per_key grows with
    the rows so that they are never more than MAX_HOT: only that many are broadcast. The right side's rows of a hot key
    are repeated once per salt. Without a hot key this is a plain join. Rows with a null in ``on`` match nothing.
    A row's salt is a hash of its columns, so a task that is run again after a loss sends its rows to the same places.
    ``counts``, columns ``on`` and count, says how many left rows a key has at most, where that is known more cheaply.
    Columns of both sides other than ``on`` must have distinct names.
    """
    counts = left.groupBy(*on).count() if counts is None else counts
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    per_key = max(per_key, (total or 0) // MAX_HOT)
    if not total or most <= per_key:
        return left.join(right, on)
    hot = counts.where(F.col("count") > per_key).select(*on, (F.col("count") / per_key).cast("int").alias("_salts"))
    l2 = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(0)) + 1).cast("int")).drop("_salts")
    r2 = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(0))))).drop("_salts")
    return l2.join(r2, [*on, "_salt"]).drop("_salt")
