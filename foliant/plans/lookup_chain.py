"""Queries of the citation lookup: from a request to an item and its pages, by contents, headings and the page map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession as Spark, functions as F

from foliant.functions import text
from foliant.operators import lookup, lookup_pages as lp, scoring
from foliant.plans.adapters import duck, view
from foliant.plans.reference import _overlap, _tokens
from foliant.plans.registry import registry
from foliant.session import cut, table

QUERIES, SQL, query = registry()

_LT = lambda c: f"list_distinct({_tokens(c, text.STOP_LOOKUP, 4)})"
_WS = lambda c: f"list_distinct(list_filter({_tokens(c, ['~'])}, lambda x: x <> ''))"
_PAGES = r"""pg0 AS (SELECT request_id, title, regexp_extract(trim(pages), '^([0-9]{1,9})\s*[-–]\s*([0-9]{1,9})', 1) AS a, regexp_extract(trim(pages), '^([0-9]{1,9})\s*[-–]\s*([0-9]{1,9})', 2) AS b, TRY_CAST(regexp_extract(trim(pages), '^([0-9]{1,9})', 1) AS BIGINT) AS one FROM asking),
pg1 AS (SELECT *, TRY_CAST(a AS BIGINT) AS s, TRY_CAST(b AS BIGINT) AS e, (10 ** length(b))::BIGINT AS k FROM pg0), pg2 AS (SELECT *, s - s % k + e AS near FROM pg1),
pg AS (SELECT request_id, title, coalesce(s, one) AS first, CASE WHEN one IS NOT NULL THEN coalesce(CASE WHEN length(b) < length(a) AND e < s THEN CASE WHEN near < s THEN near + k ELSE near END ELSE e END, one) END AS last FROM pg2)"""


def _cand_sql(items: str = "items", to: str = "c") -> str:
    return f"""{to}r AS (SELECT request_id, issn, trim(vol) AS vol, trim(iss) AS iss, trim(yr) AS yr FROM asking),
{to}t AS (SELECT request_id, item, 1 AS tier FROM {to}r JOIN {items} USING (issn, vol, iss) WHERE vol <> '' AND iss <> '' UNION ALL SELECT request_id, item, 2 FROM {to}r JOIN {items} USING (issn, vol) WHERE vol <> '' UNION ALL SELECT request_id, item, 3 FROM {to}r JOIN {items} USING (issn, yr) WHERE {to}r.yr <> ''),
{to}b AS (SELECT request_id, item, min(tier) AS tier FROM {to}t GROUP BY 1, 2), {to} AS (SELECT *, row_number() OVER (PARTITION BY request_id, tier ORDER BY item)::INT AS rank FROM {to}b QUALIFY rank <= 4)"""


# requests that were answered, asked again: the anchors of items with a layout
_SCANNED = """asking AS (SELECT anchor_id AS request_id, issn, regexp_extract(volume, '([0-9]+)', 1) AS vol, regexp_extract(issue, '([0-9]+)', 1) AS iss, substr(yr, 1, 4) AS yr, journal_pages AS pages, article_title AS title, identifier FROM ill_anchors WHERE identifier IN (SELECT item FROM layout_blocks)),
items AS (SELECT DISTINCT issn, regexp_extract(volume, '([0-9]+)', 1) AS vol, regexp_extract(issue, '([0-9]+)', 1) AS iss, substr(yr, 1, 4) AS yr, identifier AS item FROM ill_anchors WHERE identifier IN (SELECT item FROM layout_blocks) AND issn IS NOT NULL AND volume IS NOT NULL AND issue IS NOT NULL AND yr IS NOT NULL),
lt AS (SELECT item, (page_no - 1)::INT AS leaf, string_agg(text, ' ' ORDER BY idx, block_id) AS text FROM layout_blocks WHERE text IS NOT NULL AND page_no IS NOT NULL GROUP BY 1, 2),
hd AS (SELECT item, page_no, label, text, coalesce(bbox.t, 0) AS top FROM layout_blocks WHERE label IN ('section_header', 'title') AND text IS NOT NULL AND page_no IS NOT NULL),
pm AS (SELECT item, TRY_CAST(trim(text) AS BIGINT) AS printed, min(page_no - 1)::INT AS leaf FROM layout_blocks WHERE regexp_matches(trim(text), '^[0-9]{1,4}$') AND page_no IS NOT NULL GROUP BY 1, 2),
sz AS (SELECT item, max(page_no) AS n_leaves FROM layout_blocks WHERE page_no IS NOT NULL GROUP BY 1)"""
_STEPS = f"{_SCANNED}, {_cand_sql()}, {_PAGES}"
_BASE = f"WITH {_STEPS} "


def _scanned(s: Spark, d: str) -> DataFrame:
    n = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    known = table(s, d, "layout_blocks").select(F.col("item").alias("identifier")).distinct()
    a = table(s, d, "ill_anchors").where("issn IS NOT NULL AND volume IS NOT NULL AND issue IS NOT NULL AND yr IS NOT NULL").join(known, "identifier", "left_semi")
    return a.select("issn", n("volume").alias("vol"), n("issue").alias("iss"), F.substring("yr", 1, 4).alias("yr"), F.col("identifier").alias("item")).distinct()


def _leaves(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "layout_blocks").where("text IS NOT NULL AND page_no IS NOT NULL")
    g = b.groupBy("item", (F.col("page_no") - 1).cast("int").alias("leaf")).agg(F.array_sort(F.collect_list(F.struct("idx", "block_id", "text"))).alias("t"))
    return g.select("item", "leaf", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def _headings(s: Spark, d: str) -> DataFrame:
    return table(s, d, "layout_blocks").where("label IN ('section_header', 'title') AND text IS NOT NULL AND page_no IS NOT NULL").select("item", "page_no", "label", "text", F.coalesce("bbox.t", F.lit(0.0)).alias("top"))


def _page_map(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "layout_blocks").where("page_no IS NOT NULL").where(F.trim("text").rlike("^[0-9]{1,4}$"))
    return b.groupBy("item", F.trim("text").cast("bigint").alias("printed")).agg(F.min(F.col("page_no") - 1).cast("int").alias("leaf"))


def _sizes(s: Spark, d: str) -> DataFrame:
    return table(s, d, "layout_blocks").where("page_no IS NOT NULL").groupBy("item").agg(F.max("page_no").alias("n_leaves"))


def _asking(s: Spark, d: str) -> DataFrame:
    n = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    known = table(s, d, "layout_blocks").select(F.col("item").alias("identifier")).distinct()
    a = table(s, d, "ill_anchors").join(known, "identifier", "left_semi")
    return a.select(F.col("anchor_id").alias("request_id"), "issn", n("volume").alias("vol"), n("issue").alias("iss"), F.substring("yr", 1, 4).alias("yr"), F.col("journal_pages").alias("pages"), F.col("article_title").alias("title"), "identifier")


def _cand(s: Spark, d: str) -> DataFrame:
    return lookup.candidates(_asking(s, d), _scanned(s, d))


# every anchor with a layout asks for the leaf it was answered with
_ASKED = "asked AS (SELECT anchor_id AS request_id, identifier AS item, TRY_CAST(regexp_extract(leaf_ranges[1][1], '^n([0-9]+)$', 1) AS INT) AS leaf, article_title AS title FROM ill_anchors WHERE article_title IS NOT NULL AND identifier IN (SELECT item FROM layout_blocks)), ask AS (SELECT * FROM asked WHERE leaf IS NOT NULL)"


def _asked(s: Spark, d: str) -> DataFrame:
    known = table(s, d, "layout_blocks").select(F.col("item").alias("identifier")).distinct()
    a = table(s, d, "ill_anchors").where("article_title IS NOT NULL").join(known, "identifier", "left_semi")
    leaf = F.regexp_extract(F.get(F.get("leaf_ranges", F.lit(0)), F.lit(0)), "^n([0-9]+)$", 1).try_cast("int")
    return a.select(F.col("anchor_id").alias("request_id"), F.col("identifier").alias("item"), leaf.alias("leaf"), F.col("article_title").alias("title")).where("leaf IS NOT NULL")


@query("SELECT block_id, CASE WHEN idx >= 0 AND idx * 3 < length(text) THEN substr(text, (idx * 3 + 1)::INT, 40) ELSE '' END AS text FROM layout_blocks WHERE item IS NOT NULL AND text IS NOT NULL")
def leaf_slices(s: Spark, d: str) -> DataFrame:
    """Slices of texts by place: each block's text from three times its number, forty characters."""
    b = table(s, d, "layout_blocks").where("item IS NOT NULL AND text IS NOT NULL")
    spans = b.select(F.col("block_id").alias("item"), F.col("idx").alias("leaf"), (F.col("idx") * 3).cast("int").alias("start"), (F.col("idx") * 3 + 40).cast("int").alias("stop"))
    return lp.leaf_texts(spans, b.select(F.col("block_id").alias("item"), "text")).select(F.col("item").alias("block_id"), "text")


def _top_sql(asked: str, name: str) -> str:
    return f"""{name}_a AS (SELECT request_id, item, leaf, {_LT('title')} AS tt FROM {asked}),
{name}_p AS (SELECT item, leaf, text, string_split(regexp_replace(lower(substr(text, 1, greatest(300, length(text) // 2)::INT)), '[^a-z0-9]', ' ', 'g'), ' ') AS ws FROM lt JOIN (SELECT DISTINCT item, leaf FROM {asked}) USING (item, leaf)),
{name}_w AS (SELECT item, leaf, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM {name}_p), {name}_q AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY item, leaf ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS p FROM {name}_w),
{name}_h AS (SELECT a.request_id, a.item, a.leaf, q.w, q.p FROM {name}_a a JOIN {name}_q q ON a.item = q.item AND a.leaf = q.leaf AND list_contains(a.tt, q.w) WHERE q.w <> ''),
{name}_n AS (SELECT request_id, item, leaf, count(DISTINCT w) OVER (PARTITION BY request_id, item, leaf ORDER BY p RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS near FROM {name}_h), {name}_b AS (SELECT request_id, item, leaf, max(near)::INT AS top FROM {name}_n GROUP BY ALL),
{name} AS (SELECT a.request_id, a.item, a.leaf, len(tt)::INT AS n, coalesce(top, 0)::INT AS top, coalesce(len(list_intersect(tt, {_WS('text')})), 0)::INT AS whole, n >= 3 AND (coalesce(b.top, 0) >= 0.6 * n OR (coalesce(b.top, 0) > 0 AND whole >= 0.8 * n AND coalesce(b.top, 0) >= 0.4 * n)) AS ok
 FROM {name}_a a LEFT JOIN {name}_p USING (item, leaf) LEFT JOIN {name}_b b USING (request_id, item, leaf))"""


@query(f"WITH {_SCANNED}, {_ASKED}, {_top_sql('ask', 'top')} SELECT request_id, item, leaf, n, top, whole, ok FROM top")
def title_at_top(s: Spark, d: str) -> DataFrame:
    return lp.title_at_top(_asked(s, d), _leaves(s, d))


def _scan_sql(asked: str, name: str) -> str:
    marks = lp.END_MARKS.replace("'", "''")
    return f"""{name}_a AS (SELECT request_id, item, leaf, {_LT('title')} AS tt FROM {asked}),
{name}_j AS (SELECT a.*, l.leaf AS spot, l.text, {_WS("substr(l.text, 1, greatest(300, length(l.text) // 3)::INT)")} AS seen FROM {name}_a a JOIN lt l ON l.item = a.item AND l.leaf BETWEEN a.leaf + 1 AND a.leaf + 50),
{name}_k AS (SELECT *, spot >= leaf + 2 AND len(tt) > 0 AND coalesce(len(list_intersect(tt, seen)), 0) < 0.2 * len(tt) AND text <> '' AND len(list_filter(seen, lambda x: length(x) >= 5 AND x NOT IN ({", ".join(f"'{w}'" for w in text.STOP_LOOKUP)}) AND NOT list_contains(tt, x))) >= 4 AS other FROM {name}_j),
{name}_g AS (SELECT request_id, item, leaf, min(CASE WHEN regexp_matches(text, '{marks}') THEN spot END) AS marks, min(CASE WHEN other THEN spot - 1 END) AS next_article FROM {name}_k GROUP BY ALL),
{name} AS (SELECT request_id, item, leaf, marks, next_article FROM {name}_a LEFT JOIN {name}_g USING (request_id, item, leaf))"""


@query(f"WITH {_SCANNED}, {_ASKED}, {_scan_sql('ask', 'scan')} SELECT * FROM scan")
def ends_by_scan(s: Spark, d: str) -> DataFrame:
    return lp.ends_by_scan(_asked(s, d), _leaves(s, d))


_HEAD = f"""ho AS (SELECT *, {_LT('text')} AS ht, row_number() OVER (PARTITION BY item ORDER BY page_no, label, text, top) AS o FROM hd WHERE trim(text) <> ''),
hq AS (SELECT c.*, first, last, {_LT('title')} AS tt FROM c JOIN pg USING (request_id)), hs AS (SELECT hq.*, o, page_no, ht, len(list_intersect(tt, ht)) AS shared FROM hq JOIN ho USING (item) WHERE len(tt) >= 3),
h2 AS (SELECT *, CASE WHEN shared = len(tt) THEN greatest(shared / greatest(len(tt), len(ht)), 0.95) ELSE shared / greatest(len(tt), len(ht)) END AS score FROM hs WHERE shared > 0),
hb AS (SELECT * FROM h2 WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY request_id, item ORDER BY score DESC, o) = 1),
hn AS (SELECT hb.request_id, hb.item, arg_min(x.page_no, x.o) AS next_page FROM hb JOIN ho x ON x.item = hb.item AND x.o > hb.o AND x.page_no <> hb.page_no AND length(x.text) >= 4 AND len(x.ht) >= 3 AND len(list_intersect(x.ht, list_concat(hb.tt, hb.ht))) = 0 GROUP BY ALL),
hj AS (SELECT hb.*, next_page, n_leaves, pm.leaf AS mapped, coalesce(last <> first, false) AS ranged, page_no - 1 AS st FROM hb LEFT JOIN hn USING (request_id, item) LEFT JOIN sz USING (item) LEFT JOIN pm ON pm.item = hb.item AND pm.printed = hb.first),
hk AS (SELECT *, CASE WHEN ranged THEN page_no + last - first ELSE coalesce(next_page - 1, n_leaves, page_no + 20) END AS fin, 50 + floor(round(score * 40, 6))::INT AS b0 FROM hj),
hc AS (SELECT *, CASE WHEN ranged THEN b0 + 5 WHEN next_page IS NULL THEN least(b0, 70) ELSE b0 END AS b1 FROM hk),
ah AS (SELECT request_id, item, tier, rank, 'headings' AS strategy, least(100, CASE WHEN mapped IS NULL THEN b1 WHEN abs(mapped - st) <= 1 THEN least(100, b1 + 10) ELSE greatest(0, b1 - 15) END)::INT AS confidence, st::INT AS start, greatest(st, fin - 1)::INT AS stop FROM hc)"""


@query(f"{_BASE}, {_HEAD} SELECT * FROM ah")
def answers_from_headings(s: Spark, d: str) -> DataFrame:
    return lp.answers_from_headings(_cand(s, d), _asking(s, d), _headings(s, d), _page_map(s, d), _sizes(s, d))


_MAP = f"""m0 AS (SELECT c.*, first, last, title, a.leaf AS start, z.leaf AS mapped, last <> first AS ranged FROM c JOIN pg USING (request_id) JOIN pm a ON a.item = c.item AND a.printed = first LEFT JOIN pm z ON z.item = c.item AND z.printed = last),
mask AS (SELECT request_id, item, start AS leaf, title FROM m0), {_top_sql('mask', 'mtop')}, {_scan_sql('mask', 'mscan')},
m1 AS (SELECT m0.*, coalesce(ok, false) AS titled, least(marks, next_article) AS scanned FROM m0 LEFT JOIN mtop USING (request_id, item) LEFT JOIN mscan USING (request_id, item)),
m2 AS (SELECT *, (CASE WHEN mapped IS NULL THEN start + last - first WHEN NOT ranged THEN coalesce(scanned, mapped) ELSE mapped END)::INT AS stop FROM m1),
m3 AS (SELECT m2.*, EXISTS (SELECT 1 FROM lt WHERE lt.item = m2.item AND lt.leaf IN (m2.stop, m2.stop + 1) AND regexp_matches(lt.text, '{lp.END_MARKS}')) AS ended FROM m2),
am AS (SELECT request_id, item, tier, rank, 'page_map' AS strategy, least(100, 30 + CASE WHEN ranged AND mapped IS NOT NULL THEN 15 + CASE WHEN abs(last - first - (stop - start)) <= 2 THEN 15 ELSE 0 END WHEN NOT ranged AND mapped IS NOT NULL AND scanned IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN titled THEN 25 ELSE 0 END + CASE WHEN ended THEN 15 ELSE 0 END)::INT AS confidence, start::INT AS start, stop FROM m3)"""


@query(f"{_BASE}, {_MAP} SELECT * FROM am")
def answers_from_page_map(s: Spark, d: str) -> DataFrame:
    return lp.answers_from_page_map(_cand(s, d), _asking(s, d), _page_map(s, d), _leaves(s, d))


_ALL = (
    duck("items").replace(" items AS", " listed AS")
    + f""", {_STEPS}, {_HEAD}, {_MAP}, {_cand_sql("listed", "lc")}, en AS (SELECT item, entry_id, {_LT('title')} AS et, start_page_number AS first_page, start_page_index, end_page_index FROM toc_entries), rq AS (SELECT request_id, {_LT('title')} AS rt, first AS page FROM pg),
aj AS (SELECT lc.*, entry_id, start_page_index, end_page_index, coalesce(first_page > 0 AND page = first_page, false) AS onp, coalesce({_overlap('rt', 'et')}, 0.0) AS ov, len(list_intersect(rt, et)) AS sh FROM lc JOIN rq USING (request_id) JOIN en USING (item)),
ac AS (SELECT request_id, item, tier, rank, 'contents' AS strategy, least(100, 70 + score // 4 - CASE WHEN coalesce(sh, 0) < 3 AND NOT onp THEN 10 ELSE 0 END)::INT AS confidence, start_page_index AS start, end_page_index AS stop FROM (SELECT *, floor(100 * ov)::INT + CASE WHEN onp THEN 30 ELSE 0 END AS score FROM aj) WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY request_id, item ORDER BY score DESC, entry_id) = 1),
every AS (SELECT * FROM ac UNION ALL SELECT * FROM ah UNION ALL SELECT * FROM am), pen AS (SELECT *, greatest(0, least(100, confidence - CASE tier WHEN 1 THEN 0 WHEN 2 THEN 5 ELSE 15 END))::INT AS k FROM every),
mx AS (SELECT *, max(k) OVER (PARTITION BY request_id) AS mk FROM pen),
sel AS (SELECT request_id, item, strategy, k AS confidence, start, stop FROM mx QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN mk >= 90 AND k < 90 THEN 1 ELSE 0 END, CASE WHEN mk < 90 THEN -k ELSE 0 END, tier, rank, strategy, item) = 1) """
)


def _selected(s: Spark, d: str) -> DataFrame:
    asked = _asking(s, d)
    e = table(s, d, "toc_entries")
    listed = lookup.answers_from_contents(lookup.candidates(asked, view(s, d, "items")), asked, e.select("item", "entry_id", "title", F.col("start_page_number").alias("first_page"), F.col("end_page_number").alias("last_page")))
    listed = listed.join(e.select("entry_id", F.col("start_page_index").alias("start"), F.col("end_page_index").alias("stop")), "entry_id").drop("entry_id")
    answers = cut(listed.unionByName(answers_from_headings(s, d)).unionByName(answers_from_page_map(s, d)), "answers")  # read twice
    best = lookup.select_answer(answers)
    return best.join(answers.select("request_id", "item", "strategy", "start", "stop"), ["request_id", "item", "strategy"])


@query(_ALL + "SELECT * FROM sel")
def lookup_select(s: Spark, d: str) -> DataFrame:
    return _selected(s, d)


def _outcomes(s: Spark, d: str) -> DataFrame:
    truth = _asking(s, d).select("request_id", F.col("identifier").alias("true_item"))
    j = cut(truth.join(_selected(s, d), "request_id", "left"), "looked-up").withColumns({"true_start": F.col("start"), "true_stop": F.col("stop")})
    return scoring.lookup_outcomes(j).join(j.select("request_id", "confidence"), "request_id")


_KIND = f"o AS (SELECT request_id, CASE WHEN item IS NULL THEN 'no_item' WHEN item <> identifier THEN 'diff_item' WHEN start IS NOT NULL AND stop IS NOT NULL THEN 'exact' ELSE 'pages_differ' END AS outcome, confidence FROM asking LEFT JOIN sel USING (request_id))"


@query(f"{_ALL}, {_KIND} SELECT request_id, outcome FROM o")
def lookup_outcomes(s: Spark, d: str) -> DataFrame:
    return _outcomes(s, d).select("request_id", "outcome")


@query(f"{_ALL}, {_KIND} SELECT CASE WHEN confidence >= 90 THEN 'sure' WHEN confidence >= 70 THEN 'likely' WHEN confidence IS NULL THEN 'none' ELSE 'weak' END AS band, count(*) FILTER (outcome = 'exact') AS exact, count(*) FILTER (outcome = 'diff_item') AS diff_item, count(*) FILTER (outcome = 'no_item') AS no_item FROM o GROUP BY 1")
def band_outcome_pivot(s: Spark, d: str) -> DataFrame:
    return scoring.outcomes_by_band(_outcomes(s, d), ["exact", "diff_item", "no_item"])
