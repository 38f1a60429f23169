"""Writers: contents records as JSON per item, JSON lines, reports as Markdown or HTML rows, and publishing behind an interface."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, functions as F


def toc_documents(header: DataFrame, entries: DataFrame) -> DataFrame:
    """(item, document): one JSON contents record per item, entries in order. An item has a few hundred entries at most."""
    body = F.struct("ord", *[c for c in entries.columns if c not in ("item", "ord")])
    e = entries.groupBy("item").agg(F.array_sort(F.collect_list(body)).alias("entries"))
    doc = header.join(e, "item", "left")
    return doc.select("item", F.to_json(F.struct(*doc.columns)).alias("document"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key isn't in the table at ``path`` yet; returns what was written."""
    try:
        done = df.sparkSession.read.parquet(path)
        df = df.join(done.select(key).distinct(), key, "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(path)
    return df


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line): each row as a line of a Markdown table, in no order of its own."""
    cell = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[|\n]", " "), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"))


def html_rows(df: DataFrame) -> DataFrame:
    """(line): each row as a line of an HTML table."""
    cell = [F.concat(F.lit("<td>"), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cell, F.lit("</tr>")).alias("line"))


class Publisher(Protocol):
    def publish(self, item: str, document: str, review: str) -> None: ...


class DryRun:
    """Checks what would be published and keeps it."""

    def __init__(self) -> None:
        self.sent: list[tuple[str, str]] = []

    def publish(self, item: str, document: str, review: str) -> None:
        import json

        if "schema_version" not in json.loads(document) or not review.strip():
            raise ValueError(f"{item}: no schema_version or an empty review")
        self.sent.append((item, document))


def reason_summary(entries: DataFrame) -> DataFrame:
    """(reason, entries, items): how many entries (item, reason) were flagged, by reason and for all (reason null), in how many
    items; those without a reason don't count."""
    return entries.where("reason IS NOT NULL").rollup("reason").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("item").alias("items"))
