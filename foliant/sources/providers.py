"""Remote services and models as tables: each answer is looked up by key in a cache with an ``error`` column."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, functions as F


class Provider(Protocol):
    """Adds a service's answers to rows with its key."""

    key: str

    def enrich(self, rows: DataFrame) -> DataFrame: ...


class TableProvider:
    """Answers from a table (key, columns…, error). Keys are compared in lower case; rows without an answer stay, with nulls."""

    def __init__(self, cache: DataFrame, key: str, prefix: str) -> None:
        self.cache, self.key, self.prefix = cache, key, prefix

    def enrich(self, rows: DataFrame) -> DataFrame:
        values = [c for c in self.cache.columns if c not in (self.key, "error")]
        good = self.cache.where("error IS NULL") if "error" in self.cache.columns else self.cache
        answers = good.select(F.lower(self.key).alias("_k"), *[F.col(c).alias(f"{self.prefix}_{c}") for c in values])
        names = [c for c in answers.columns if c != "_k"]
        row = F.struct(*names)  # of several answers to a key the least, so that every run takes the same
        answers = answers.groupBy("_k").agg(F.min_by(row, F.to_json(row)).alias("_r")).select("_k", *[F.col("_r")[c].alias(c) for c in names])
        return rows.withColumn("_k", F.lower(self.key)).join(answers, "_k", "left").drop("_k")

    def missing(self, rows: DataFrame) -> DataFrame:
        """Keys that have no answer yet, or only a failed one."""
        good = self.cache.where("error IS NULL") if "error" in self.cache.columns else self.cache
        return rows.select(F.lower(self.key).alias(self.key)).distinct().join(good.select(F.lower(self.key).alias(self.key)), self.key, "left_anti")


def enrich_all(rows: DataFrame, providers: list[Provider]) -> DataFrame:
    for p in providers:
        rows = p.enrich(rows)
    return rows
