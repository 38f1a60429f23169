"""The test tables seen as the engine's entities. Each view is one SQL text, for Spark here and for the checking engine in
``reference``; the few spellings that differ are filled in by ``dialect``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.session import table

SPARK = {"first_start": "element_at(element_at(leaf_ranges, 1), 1)", "first_stop": "element_at(element_at(leaf_ranges, 1), 2)", "names": "regexp_extract_all(lower({0}), '([a-z]{{4,}})', 1)", "flat": "flatten", "collect": "collect_list", "sorted": "array_sort", "distinct": "array_distinct"}
DUCK = {"first_start": "leaf_ranges[1][1]", "first_stop": "leaf_ranges[1][2]", "names": "regexp_extract_all(lower({0}), '([a-z]{{4,}})', 1)", "flat": "flatten", "collect": "list", "sorted": "list_sort", "distinct": "list_distinct"}


def views(d: dict) -> dict[str, str]:
    names = d["names"].format
    return {
        # scan leaves with printed labels
        "leaves": """SELECT l_orderkey AS item, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS leaf,
            l_returnflag <> 'R' AS accessible, CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_linenumber AS VARCHAR(9)) END AS label, l_discount AS confidence FROM lineitem""",
        # page ranges read from running heads
        "heads": """SELECT l_orderkey AS item, CAST(l_linenumber AS INT) AS leaf, CAST(l_linenumber + l_suppkey % 4 * 10 + 20 AS INT) AS first_page, CAST(l_linenumber + l_suppkey % 4 * 10 + 21 AS INT) AS last_page
            FROM lineitem WHERE l_linenumber % 3 = 1""",
        # known article locations, keyed by issue
        "known": f"""SELECT anchor_id, concat(issn, '|', regexp_extract(volume, '([0-9]+)', 1), '|', regexp_extract(issue, '([0-9]+)', 1)) AS item, article_title AS title, {names("article_author")} AS names,
            TRY_CAST(regexp_extract({d["first_start"]}, '^n([0-9]+)$', 1) AS INT) AS a_start, TRY_CAST(regexp_extract({d["first_stop"]}, '^n([0-9]+)$', 1) AS INT) AS a_end
            FROM ill_anchors WHERE issn IS NOT NULL AND volume IS NOT NULL AND issue IS NOT NULL""",
        # contents entries, keyed by issue
        "listed": f"""SELECT entry_id, concat(issn, '|', regexp_extract(volume, '([0-9]+)', 1), '|', regexp_extract(issue, '([0-9]+)', 1)) AS item, ord, title AS e_title, n.e_names, start_page_index AS e_start, end_page_index AS e_end
            FROM toc_entries LEFT JOIN (SELECT entry_id AS k, {d["flat"]}({d["collect"]}({names("name")})) AS e_names FROM toc_authors WHERE name IS NOT NULL GROUP BY entry_id) n ON n.k = entry_id
            WHERE issn IS NOT NULL AND volume IS NOT NULL AND issue IS NOT NULL""",
        # audited issues of journals
        "issues": """SELECT issn, TRY_CAST(substr(yr, 1, 4) AS INT) AS year, concat(coalesce(regexp_extract(volume, '([0-9]+)', 1), ''), '/', coalesce(regexp_extract(issue, '([0-9]+)', 1), '')) AS issue, count(*) AS anchors,
            count(CASE WHEN article_author LIKE '%,%' THEN 1 END) AS hits FROM ill_anchors WHERE issn IS NOT NULL AND TRY_CAST(substr(yr, 1, 4) AS INT) IS NOT NULL GROUP BY 1, 2, 3""",
        # catalogue records
        "catalogue": """SELECT concat('c', identifier) AS ident, title AS name, CASE WHEN length(title) % 3 = 0 THEN issn END AS issn, CASE WHEN length(title) % 3 = 1 THEN sim_pubid END AS sim_pubid, publisher FROM pubs
            UNION ALL SELECT concat('d', identifier), title, NULL, NULL, 'Other House' FROM pubs WHERE length(title) % 5 = 0""",
        # items that can be looked up
        "items": """SELECT DISTINCT issn, regexp_extract(volume, '([0-9]+)', 1) AS vol, regexp_extract(issue, '([0-9]+)', 1) AS iss, CAST(yr AS VARCHAR(9)) AS yr, item FROM toc_entries WHERE issn IS NOT NULL AND volume IS NOT NULL AND issue IS NOT NULL AND yr IS NOT NULL""",
        # model entries with 1-based pages
        "model": """SELECT item, entry_id, title, start_page_index AS start, end_page_index AS stop, start_page_number AS first_page, end_page_number AS last_page FROM toc_entries WHERE start_page_index IS NOT NULL AND end_page_index IS NOT NULL""",
        # cells of printed contents pages: a title on the left, its page number on the right
        "cells": """SELECT item, CAST(1 + floor(ord / 20) AS INT) AS page_no, entry_id * 2 AS block_id, CAST(60 AS DOUBLE) AS l, CAST(700 - ord % 20 * 30 AS DOUBLE) AS t, CAST(690 - ord % 20 * 30 AS DOUBLE) AS b, title AS text,
            CASE WHEN entry_id % 17 = 0 THEN 'furniture' END AS content_layer FROM toc_entries WHERE item IS NOT NULL AND ord IS NOT NULL
            UNION ALL SELECT item, CAST(1 + floor(ord / 20) AS INT), entry_id * 2 + 1, CAST(500 AS DOUBLE), CAST(700 - ord % 20 * 30 + entry_id % 5 AS DOUBLE), CAST(690 - ord % 20 * 30 AS DOUBLE), CAST(start_page_number AS VARCHAR(9)), 'body'
            FROM toc_entries WHERE item IS NOT NULL AND ord IS NOT NULL AND start_page_number > 0 AND entry_id % 4 <> 0""",
        # cells of tables that a text recogniser found
        "grid": """SELECT item, CASE CAST(length(item) % 4 AS INT) WHEN 0 THEN 'tesseract 5.3' WHEN 1 THEN 'ABBYY FineReader 11' WHEN 2 THEN '' ELSE 'ocropus' END AS engine, CAST(floor(ord / 10) AS INT) AS table_pos, ord AS row, 0 AS col, entry_id AS pos, title AS text FROM toc_entries
            UNION ALL SELECT item, CASE CAST(length(item) % 4 AS INT) WHEN 0 THEN 'tesseract 5.3' WHEN 1 THEN 'ABBYY FineReader 11' WHEN 2 THEN '' ELSE 'ocropus' END, CAST(floor(ord / 10) AS INT), ord, 1, entry_id, CAST(start_page_number AS VARCHAR(9)) FROM toc_entries""",
    }


USES = {"cells": ["toc_entries"], "grid": ["toc_entries"], "leaves": ["lineitem"], "heads": ["lineitem"], "known": ["ill_anchors"], "listed": ["toc_entries", "toc_authors"], "issues": ["ill_anchors"], "catalogue": ["pubs"], "items": ["toc_entries"], "model": ["toc_entries"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = views(SPARK)[name]
    dfs = {}
    for t in USES[name]:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        dfs[t] = table(spark, sf_dir, t)
    braces = sql.replace("{4,}", "{{4,}}") if "{4,}" in sql else sql
    return spark.sql(braces, **dfs)


def duck(*names: str) -> str:
    """WITH clause of these views for the checking engine."""
    v = views(DUCK)
    return "WITH " + ", ".join(f"{n} AS ({v[n]})" for n in names) + " "
