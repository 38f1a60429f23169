"""Queries over the training-text operators, and SQL that states the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import copies, leaks, matching, names, packing, scans, splitting
from foliant.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copied_anchors(table(spark, d, "ill_anchors"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse_anchors(table(spark, d, "ill_anchors"))


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "ill_anchors"), table(spark, d, "toc_entries"), table(spark, d, "toc_authors")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_names(*_names(spark, d))


def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    return names.name_variants(*_names(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_faults(table(spark, d, "layout_blocks"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "layout_blocks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_articles(*_names(spark, d)).select("anchor_id", "entry_id")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_articles(*_names(spark, d)).select("anchor_id", "entry_id", F.round("confidence", 4).alias("confidence"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p8_items(spark, d), "doc_id").withColumnRenamed("keys", "doc_ids")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("words >= 20").select("doc_id", "item_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).withColumn("coverage", F.round("coverage", 4))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"), "doc_id", "text", keep_text=False).where("pos = 0").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_variants, p5_found, p5_paragraphs, p6_found, p6_matches, p8_containers, p8_items, p9_found, p9_passages, p10_found, p10_pieces)}

_KEYED = r"""
WITH keyed AS (
  SELECT anchor_id, regexp_replace(lower(article_title), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS t,
         coalesce(regexp_replace(lower(identifier), '[^\p{L}\p{M}\p{N}]+', '', 'g'), '~') AS i,
         coalesce(array_to_string(list_sort(list_distinct(list_transform(leaf_ranges,
           lambda r: array_to_string(list_transform(r, lambda x: regexp_replace(regexp_replace(x, '[^0-9]+', '', 'g'), '^0+([0-9])', '\1')), '-')))), ','), '~') AS r,
         article_title, identifier, leaf_ranges
  FROM ill_anchors WHERE article_title IS NOT NULL)
"""
SQL = {
    "p1_found": _KEYED + "SELECT first_id, anchor_id AS copy_id FROM (SELECT anchor_id, min(anchor_id) OVER (PARTITION BY t, i, r) AS first_id FROM keyed) WHERE anchor_id <> first_id",
    "p1_records": _KEYED + "SELECT anchor_id, article_title, identifier, to_json(leaf_ranges)::VARCHAR AS leaf_ranges, copies FROM (SELECT *, min(anchor_id) OVER w AS first_id, count(*) OVER w AS copies FROM keyed WINDOW w AS (PARTITION BY t, i, r)) WHERE anchor_id = first_id",
    "p10_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 4096",
}
