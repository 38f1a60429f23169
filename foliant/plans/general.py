"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.operators.intervals import sweep_intervals
from foliant.operators.multivalue import split_values
from foliant.operators.nested import flatten_nested, layout_cells, layout_provs, layout_texts
from foliant.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a = split_values(table(spark, d, "ill_anchors"), "anchor_id", "article_author", "authors")
    r = split_values(table(spark, d, "lookup_requests"), "request_id", "pages", "pages")
    tag = lambda df, src, key: df.select(F.lit(src).alias("src"), F.col(key).alias("row_id"), "pos", "val")
    return tag(a, "ill_anchors", "anchor_id").unionByName(tag(r, "lookup_requests", "request_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_nested(table(spark, d, "layouts"), "layout_id", "payload", body=False).drop("body")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return flatten_nested(table(spark, d, "layouts"), "layout_id", "payload")


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    return layout_texts(_nodes(spark, d), "layout_id")


def p4_provs(spark: SparkSession, d: str) -> DataFrame:
    return layout_provs(_nodes(spark, d), "layout_id")


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    return layout_cells(_nodes(spark, d), "layout_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sweep_intervals(table(spark, d, "toc_entries"), "item", "start_page_index", "end_page_index")


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_texts, p4_provs, p4_cells, p7_found)}

SQL = {
    "p7_found": """
WITH v AS (SELECT DISTINCT item, start_page_index AS s, end_page_index AS e FROM toc_entries
           WHERE item IS NOT NULL AND start_page_index >= 0 AND start_page_index <= end_page_index),
m AS (SELECT *, max(e) OVER (PARTITION BY item ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY s, e) AS run FROM m),
p AS (SELECT item, run, min(s) AS s, max(e) AS e FROM g GROUP BY item, run),
n AS (SELECT *, lead(s) OVER (PARTITION BY item ORDER BY s) AS nxt FROM p)
SELECT item, 'period' AS kind, s AS start_page_index, e AS end_page_index FROM n
UNION ALL SELECT item, 'gap', e + 1, nxt - 1 FROM n WHERE nxt IS NOT NULL""",
}
