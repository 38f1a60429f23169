"""Queries over the native file formats: the test tables written as such files to the shared folder, and read back by the readers;
and articles placed by several kinds of evidence."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession as Spark, functions as F

from foliant.functions import text
from foliant.operators import contents, placement
from foliant.plans.adapters import duck, view
from foliant.plans.layout import _q
from foliant.plans.lookup_chain import _SCANNED, _leaves
from foliant.plans.reference import _tokens
from foliant.plans.registry import registry
from foliant.session import cut, remove, shared_dir, table
from foliant.sources import readers

QUERIES, SQL, query = registry()


def _through(s: Spark, lines: DataFrame, read: Callable[[str], DataFrame], ending: str) -> DataFrame:
    """What a reader makes of text lines written as files, kept as a table; the files are removed."""
    path = f"{shared_dir(s)}/foliant/files-{uuid.uuid4().hex}.{ending}"
    lines.write.text(path)
    out = cut(read(path), "read")
    remove(s, path)
    return out


def _json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


@query("SELECT anchor_id::VARCHAR AS time, identifier AS source_identifier, concat('{\"title\":\"', replace(replace(regexp_replace(coalesce(article_title, ''), '[\\s]+', ' ', 'g'), '\\', ''), '\"', ''''), '\"}') AS full_form FROM ill_anchors WHERE identifier IS NOT NULL")
def read_ill_log(s: Spark, d: str) -> DataFrame:
    a = table(s, d, "ill_anchors").where("identifier IS NOT NULL")
    title = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("article_title", F.lit("")), r"[\s]+", " "), r"\\", ""), '"', "'")
    form = F.concat(F.lit('{""title"":""'), title, F.lit('""}'))
    row = F.concat(F.col("anchor_id"), F.lit(",user,\""), F.col("identifier"), F.lit('",fill,"'), form, F.lit('"'))
    path = f"{shared_dir(s)}/foliant/log-{uuid.uuid4().hex}.csv"
    lines = a.select(row.alias("value"))
    lines.write.option("lineSep", "\n").text(path)
    out = cut(readers.ill_log(s, path, header=False), "read")
    remove(s, path)
    return out.select("time", "source_identifier", "full_form")


@query("SELECT identifier AS item, (row_number() OVER (PARTITION BY identifier ORDER BY anchor_id) - 1)::INT AS ord, article_title, issn, len(leaf_ranges)::INT AS n FROM ill_anchors")
def read_corpus(s: Spark, d: str) -> DataFrame:
    a = table(s, d, "ill_anchors")
    one = F.struct("anchor_id", "article_title", "issn", "leaf_ranges")
    g = a.groupBy("identifier").agg(F.array_sort(F.collect_list(one)).alias("anchors"))
    r = _through(s, _json(g), lambda p: readers.corpus(s, p), "jsonl")
    return r.select("item", "ord", "article_title", "issn", F.size("leaf_ranges").alias("n"))


@query("SELECT item, (row_number() OVER (PARTITION BY item ORDER BY entry_id) - 1)::INT AS ord, title, start_page_index AS start, end_page_index AS stop FROM toc_entries WHERE item IS NOT NULL AND start_page_index >= 0 AND end_page_index >= 0")
def read_toc(s: Spark, d: str) -> DataFrame:
    """Contents files, every other one with its ranges under the old name."""
    e = table(s, d, "toc_entries").where("item IS NOT NULL AND start_page_index >= 0 AND end_page_index >= 0")
    ranges = F.array(F.array(F.concat(F.lit("n"), "start_page_index"), F.concat(F.lit("n"), "end_page_index")))
    old = F.length("item") % 2 == 0
    one = F.struct("entry_id", "title", F.when(~old, ranges).alias("page_index_ranges"), F.when(old, ranges).alias("leaf_ranges"))
    g = e.groupBy("item").agg(F.array_sort(F.collect_list(one)).alias("entries"))
    return _through(s, _json(g), lambda p: readers.toc(s, p, lines=True), "json").select("item", "ord", "title", "start", "stop")


@query("SELECT item, (row_number() OVER (PARTITION BY item ORDER BY entry_id) - 1)::INT AS ord, title, start_page_index, start_page_number, entry_type AS type FROM toc_entries WHERE item IS NOT NULL")
def read_model_toc(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries").where("item IS NOT NULL")
    g = e.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("entry_id", "title", "start_page_index", "start_page_number", F.col("entry_type").alias("type")))).alias("entries"))
    return _through(s, _json(g), lambda p: readers.model_toc(s, p, lines=True), "json").select("item", "ord", "title", "start_page_index", "start_page_number", "type")


@query(duck("leaves") + " SELECT CAST(item AS VARCHAR) AS item, leaf AS ord, leaf, label FROM leaves")
def read_page_numbers(s: Spark, d: str) -> DataFrame:
    v = view(s, d, "leaves")
    g = v.groupBy(F.col("item").cast("string").alias("identifier")).agg(F.array_sort(F.collect_list(F.struct(F.col("leaf").alias("leafNum"), F.col("label").alias("pageNumber")))).alias("pages"))
    return _through(s, _json(g), lambda p: readers.page_numbers(s, p, lines=True), "json").select("item", "ord", "leaf", "label")


@query(duck("leaves") + " SELECT leaf, accessible, count(*) AS n FROM leaves GROUP BY ALL")
def read_scan_leaves(s: Spark, d: str) -> DataFrame:
    v = view(s, d, "leaves")
    page = F.concat(F.lit('<page leafNum="'), "leaf", F.lit('"><addToAccessFormats>'), F.when(F.col("accessible"), "true").otherwise("false"), F.lit("</addToAccessFormats></page>"))
    return _through(s, v.select(page.alias("value")), lambda p: readers.scan_leaves(s, p, lines=True), "xml").groupBy("leaf", "accessible").agg(F.count(F.lit(1)).alias("n"))


@query(duck("leaves") + " SELECT leaf, label AS asserted, count(*) AS n FROM leaves WHERE label IS NOT NULL GROUP BY ALL")
def read_scan_assertions(s: Spark, d: str) -> DataFrame:
    v = view(s, d, "leaves").where("label IS NOT NULL")
    one = F.concat(F.lit("<assertion><leafNum>"), "leaf", F.lit("</leafNum><pageNum>"), "label", F.lit("</pageNum></assertion>"))
    return _through(s, v.select(one.alias("value")), lambda p: readers.scan_assertions(s, p, lines=True), "xml").groupBy("leaf", "asserted").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('c', identifier) AS ident, title AS name, issn, publisher, sim_pubid FROM pubs WHERE sim_pubid IS NOT NULL")
def read_containers(s: Spark, d: str) -> DataFrame:
    extra = F.struct(F.struct(F.struct("sim_pubid").alias("sim")).alias("ia"))
    p = table(s, d, "pubs").select(F.concat(F.lit("c"), "identifier").alias("ident"), F.col("title").alias("name"), F.when(F.length("title") % 2 == 0, F.col("issn")).alias("issnl"), F.col("issn").alias("issne"), "publisher", extra.alias("extra"))
    return _through(s, _json(p), lambda x: readers.containers(s, x, True), "jsonl").select("ident", "name", "issn", "publisher", "sim_pubid")


@query("SELECT identifier, title, issn FROM pubs")
def read_publications(s: Spark, d: str) -> DataFrame:
    """Publications, every other with a list for its title."""
    p = table(s, d, "pubs")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', "\\\\$1"), F.lit('"'))
    title = F.when(F.length("title") % 2 == 0, F.concat(F.lit("["), quoted("title"), F.lit(',"other"]'))).otherwise(quoted("title"))
    line = F.concat(F.lit('{"identifier":'), quoted("identifier"), F.lit(',"title":'), title, F.lit(',"issn":'), quoted("issn"), F.lit("}"))
    return _through(s, p.select(line.alias("value")), lambda x: readers.publications(s, x), "jsonl").select("identifier", "title", "issn")


@query("SELECT issn, yr AS year, title, count(*) AS n FROM toc_entries WHERE issn IS NOT NULL AND yr IS NOT NULL AND yr % 5 <> 0 GROUP BY ALL")
def read_xref_years(s: Spark, d: str) -> DataFrame:
    """Answers of a service by journal and year, those of every fifth year failed."""
    e = table(s, d, "toc_entries").where("issn IS NOT NULL AND yr IS NOT NULL")
    g = e.groupBy("issn", F.col("yr").alias("year")).agg(F.collect_list(F.struct(F.array("title").alias("title"), F.col("volume"))).alias("items"))
    g = g.withColumn("error", F.when(F.col("year") % 5 == 0, "timeout"))
    r = _through(s, _json(g), lambda p: readers.xref_year(s, p, lines=True), "json")
    return r.select("issn", "year", F.col("title")[0].alias("title")).groupBy("issn", "year", "title").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT item, min(start_page_index) AS first_entry, arg_min(CASE WHEN k = 'article' THEN start_page_index END, CASE WHEN k = 'article' THEN ord * 1000000 + entry_id END) AS first_article FROM (SELECT *, CASE WHEN regexp_matches(lower(trim(coalesce(title, ''))), '{_q(contents.FRONT_TITLE)}') THEN 'frontmatter' WHEN regexp_matches(lower(trim(coalesce(title, ''))), '{_q(contents.BACK_TITLE)}') THEN 'backmatter' ELSE 'article' END AS k FROM toc_entries WHERE start_page_index IS NOT NULL) GROUP BY item")
def first_starts(s: Spark, d: str) -> DataFrame:
    return placement.first_starts(table(s, d, "toc_entries").select("item", "entry_id", "ord", "title", F.col("start_page_index").alias("start")))


_W3 = lambda c: f"list_distinct({_tokens(c, text.STOP_PLACE, 3)})"


@query(
    f"""WITH {_SCANNED}, art AS (SELECT anchor_id AS article_id, identifier AS item, {_W3('article_title')} AS tw, lower(trim(journal_pages)) AS p FROM ill_anchors WHERE identifier IN (SELECT item FROM layout_blocks)),
m1 AS (SELECT item, article_id, min(leaf) AS l1 FROM art JOIN (SELECT item, CAST(printed AS VARCHAR) AS p, leaf FROM pm) USING (item, p) GROUP BY ALL),
h AS (SELECT a.item, a.article_id, (b.page_no - 1)::INT AS leaf, b.block_id AS part, len(list_intersect(tw, {_W3('b.text')})) AS k, len(tw) AS n FROM art a JOIN layout_blocks b ON b.item = a.item WHERE label IN ('title', 'section_header') AND page_no IS NOT NULL AND text IS NOT NULL),
m2 AS (SELECT item, article_id, leaf AS l2 FROM h WHERE k > 0 AND k >= 0.5 * n QUALIFY row_number() OVER (PARTITION BY item, article_id ORDER BY -k / n, leaf, part) = 1),
m3 AS (SELECT a.item, a.article_id, min(leaf) AS l3 FROM art a JOIN lt ON lt.item = a.item AND list_contains(regexp_split_to_array(lower(concat(substr(lt.text, 1, 200), ' ', substr(lt.text, greatest(length(lt.text) - 199, 1)::INT, 200))), '[^a-z0-9]+'), a.p) WHERE a.p <> '' GROUP BY ALL),
u AS (SELECT a.item, a.article_id, leaf, len(list_intersect(tw, {_W3("substr(lt.text, 1, (length(lt.text) // 3)::INT)")})) AS k, len(tw) AS n FROM art a JOIN lt ON lt.item = a.item),
m4 AS (SELECT item, article_id, leaf AS l4 FROM u WHERE k > 0 AND k >= CASE WHEN n >= 4 THEN 0.4 ELSE 0.5 END * n QUALIFY row_number() OVER (PARTITION BY item, article_id ORDER BY -k / n, leaf) = 1)
SELECT item, article_id, coalesce(l1, l2, l3, l4)::INT AS leaf, CASE WHEN l1 IS NOT NULL THEN 'page_map' WHEN l2 IS NOT NULL THEN 'heading' WHEN l3 IS NOT NULL THEN 'margin' WHEN l4 IS NOT NULL THEN 'text' ELSE 'failed' END AS method FROM art LEFT JOIN m1 USING (item, article_id) LEFT JOIN m2 USING (item, article_id) LEFT JOIN m3 USING (item, article_id) LEFT JOIN m4 USING (item, article_id)"""
)
def place_unplaced(s: Spark, d: str) -> DataFrame:
    from foliant.plans.lookup_chain import _asking, _page_map

    a = _asking(s, d).select(F.col("identifier").alias("item"), F.col("request_id").alias("article_id"), "title", F.col("pages").alias("page"))
    m = _page_map(s, d).select("item", F.col("printed").cast("string").alias("label"), "leaf")
    return placement.place_unplaced(a, m, table(s, d, "layout_blocks"), _leaves(s, d))
