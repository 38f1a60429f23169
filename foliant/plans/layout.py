"""Queries over layout blocks and printed contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession as Spark, functions as F

from foliant.functions import text
from foliant.operators import contents, layout as lo, pagination, placement
from foliant.plans.adapters import duck, view
from foliant.plans.reference import _tokens
from foliant.plans.registry import registry
from foliant.session import table

QUERIES, SQL, query = registry()


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _any(c: str, shapes: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{_q(s)}')" for s in shapes) + ")"


def _list(words: list[str]) -> str:
    return ", ".join("'" + _q(w) + "'" for w in words)


@query("SELECT DISTINCT label AS written, lower(label) AS label FROM layout_blocks WHERE label IS NOT NULL")
def text_labels(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "layout_blocks").where("label IS NOT NULL").select("label").distinct()
    return b.select(F.col("label").alias("written"), lo.text_label(F.concat(F.lit("DocItemLabel."), F.upper("label"), F.lit("'>"))).alias("label"))


_BODY = "trim(regexp_replace(text, '(?i)^by\\s+', ''))"
_WORDS = lambda c: f"regexp_replace({c}, '[^\\P{{L}}a-zA-Z]', '_', 'g')"  # noqa: E731  the checking engine's word boundaries know ASCII letters only
_ASCII = _WORDS(_BODY)


@query(
    f"SELECT block_id FROM layout_blocks WHERE length(text) BETWEEN 3 AND 300 AND ({_BODY} <> trim(text) OR regexp_matches({_ASCII}, '{text.CREDENTIALS}') OR {_any(_ASCII, lo.STRICT_NAMES)} OR ((regexp_matches({_BODY}, ',|\\s+and\\s+|\\s*&\\s*|;') OR length({_BODY}) <= 30) AND {_any(_ASCII, lo.LOOSE_NAMES)}))"
)
def bylines(s: Spark, d: str) -> DataFrame:
    return table(s, d, "layout_blocks").where(lo.byline(F.col("text"))).select("block_id")


@query(
    f"""SELECT author_id FROM (SELECT *, regexp_split_to_array(trim(name), '\\s+') AS w FROM toc_authors WHERE name IS NOT NULL)
WHERE length(name) BETWEEN 2 AND 60 AND len(w) <= 5 AND regexp_matches(w[1], '^\\p{{Lu}}') AND w[1] NOT IN ({_list(lo.NOT_NAMES)})
AND len(list_filter(w[2:6], lambda x: x = lower(x) AND x <> upper(x) AND x NOT IN ({_list(lo.PARTICLES)}))) <= 1"""
)
def author_parts(s: Spark, d: str) -> DataFrame:
    return table(s, d, "toc_authors").where(lo.author_part(F.col("name"))).select("author_id")


_PART = lambda x, w: f"length({x}) BETWEEN 2 AND 60 AND len({w}) <= 5 AND regexp_matches({w}[1], '^\\p{{Lu}}') AND {w}[1] NOT IN ({_list(lo.NOT_NAMES)}) AND len(list_filter({w}[2:6], lambda y: y = lower(y) AND y <> upper(y) AND y NOT IN ({_list(lo.PARTICLES)}))) <= 1"


@query(
    f"""WITH p AS (SELECT author_id, unnest(regexp_split_to_array(trim(regexp_replace(name, '(?i)^by\\s+', '')), '\\s*,\\s*|\\s+and\\s+|\\s*&\\s*|\\s*;\\s*')) AS x FROM toc_authors WHERE name IS NOT NULL),
c AS (SELECT author_id, regexp_replace(regexp_replace(regexp_replace(x, '(?i)^(and|or|&)\\s+', ''), '(?i)(^|[^\\p{{L}}\\p{{N}}_])(M\\.?\\s*D|Ph\\.?\\s*D|MA|MS|MPH|MSc|R\\.?\\s*N|D\\.?\\s*O|RD|Sc\\.?\\s*D|Jr|Sr|II|III|FRCP|FRCS|FACP|MHA|EdD|DSc)($|[^\\p{{L}}\\p{{N}}_])', '\\1\\3', 'g'), '^[ ,.;-]+|[ ,.;-]+$', '', 'g') AS n FROM p),
t AS (SELECT author_id, CASE WHEN n = upper(n) AND n <> lower(n) THEN array_to_string(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr(n, i - 1, 1), '\\p{{L}}') THEN lower(substr(n, i, 1)) ELSE substr(n, i, 1) END), '') ELSE n END AS n FROM c WHERE length(n) > 1 AND regexp_matches(n, '\\p{{L}}')),
w AS (SELECT *, regexp_split_to_array(trim(n), '\\s+') AS w FROM t) SELECT author_id, n AS name FROM w WHERE {_PART("n", "w")}"""
)
def byline_names(s: Spark, d: str) -> DataFrame:
    return table(s, d, "toc_authors").select("author_id", F.explode(lo.parse_names(F.col("name"))).alias("name"))


@query(
    f"""WITH b AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x, label IN ('section_header', 'title') AS head FROM layout_blocks WHERE item IS NOT NULL AND page_no IS NOT NULL),
s AS (SELECT * EXCLUDE (text), CASE WHEN lag(head) OVER w THEN lag(x) OVER w END AS title, x AS text FROM b WHERE x <> '' AND (coalesce(head, false) OR length(x) <= 300) AND head IS NOT NULL WINDOW w AS (PARTITION BY item, page_no ORDER BY idx, block_id)),
f AS (SELECT * FROM s WHERE NOT head AND length(title) >= 5 QUALIFY row_number() OVER (PARTITION BY item, lower(title) ORDER BY page_no, idx, block_id) = 1)
SELECT item, page_no, title, CASE WHEN length(text) BETWEEN 3 AND 300 AND ({_BODY} <> trim(text) OR regexp_matches({_ASCII}, '{text.CREDENTIALS}') OR {_any(_ASCII, lo.STRICT_NAMES)} OR ((regexp_matches({_BODY}, ',|\\s+and\\s+|\\s*&\\s*|;') OR length({_BODY}) <= 30) AND {_any(_ASCII, lo.LOOSE_NAMES)})) THEN text END AS byline FROM f"""
)
def segment_blocks(s: Spark, d: str) -> DataFrame:
    return contents.segment_blocks(table(s, d, "layout_blocks").where("label IS NOT NULL"))


_REAL = f"len(list_filter(names, lambda x: length(trim(x)) <= 60 AND NOT regexp_matches(x, '{contents.EDITOR}') AND {_any(_WORDS('trim(x)'), lo.STRICT_NAMES)})) > 0"
_SHORT = f"(t <> '' AND length(t) < 50 AND NOT regexp_matches(t, '\\p{{Ll}}') AND len(list_filter(regexp_extract_all(t, '([A-Za-z][A-Za-z''-]*)', 1), lambda w: lower(w) NOT IN ({_list(text.STOP_FILTER)}))) <= 4 AND NOT regexp_matches(t, '[?!.]$'))"
# names as they stand and, for a third of the entries, as a scan might have spoilt them
_FILTER = f"""n AS (SELECT entry_id, list(CASE WHEN entry_id % 3 = 0 THEN lower(name) WHEN entry_id % 11 = 0 THEN concat(name, ', M.D.') ELSE name END) AS names FROM toc_authors WHERE name IS NOT NULL GROUP BY entry_id), x AS (SELECT item, max(end_page_index) + 1 AS page_count FROM toc_entries GROUP BY item),
e AS (SELECT entry_id, item, title, start_page_index AS start, page_count, names, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM toc_entries LEFT JOIN n USING (entry_id) LEFT JOIN x USING (item)),
r AS (SELECT *, coalesce({_REAL}, false) AS strong, CASE WHEN {_SHORT} AND NOT coalesce({_REAL}, false) THEN 'label' WHEN regexp_matches(upper(title), '{contents.ADVERT}') THEN 'advert' WHEN len(list_filter(names, lambda x: regexp_matches(x, '{contents.EDITOR}'))) > 0 THEN 'editorial'
 WHEN len(list_filter(names, lambda x: regexp_matches(x, '{contents.DRUG_AD}'))) > 0 THEN 'pharma_ad' WHEN len(names) > 0 AND len(list_filter(names, lambda x: length(trim(x)) <= 60 AND {_any(_WORDS('trim(x)'), (*lo.STRICT_NAMES, *lo.LOOSE_NAMES))})) = 0 THEN 'fake_byline'
 WHEN start < floor(page_count * 5 / 100) THEN 'front_matter' END AS reason FROM e)"""


def _filtered(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries")
    spoilt = F.when(F.col("entry_id") % 3 == 0, F.lower("name")).when(F.col("entry_id") % 11 == 0, F.concat("name", F.lit(", M.D."))).otherwise(F.col("name"))
    n = table(s, d, "toc_authors").where("name IS NOT NULL").groupBy("entry_id").agg(F.collect_list(spoilt).alias("names"))
    x = e.groupBy("item").agg((F.max("end_page_index") + 1).alias("page_count"))
    return contents.filter_reasons(e.join(n, "entry_id", "left").join(x, "item", "left").withColumn("start", F.col("start_page_index")))


@query(f"WITH {_FILTER} SELECT entry_id, reason FROM r")
def filter_reasons(s: Spark, d: str) -> DataFrame:
    return _filtered(s, d).select("entry_id", "reason")


@query(
    f"""WITH RECURSIVE {_FILTER}, o AS (SELECT item, entry_id, coalesce(start, 0) AS start, strong, row_number() OVER (PARTITION BY item ORDER BY coalesce(start, 0), entry_id) AS k FROM r WHERE reason IS NULL AND item IS NOT NULL),
f AS (SELECT item, k, entry_id, start AS kept, true AS stays FROM o WHERE k = 1 UNION ALL SELECT o.item, o.k, o.entry_id, CASE WHEN o.start - f.kept < 3 AND NOT o.strong THEN f.kept ELSE o.start END, NOT (o.start - f.kept < 3 AND NOT o.strong) FROM f JOIN o ON o.item = f.item AND o.k = f.k + 1)
SELECT item, entry_id, kept AS start FROM f WHERE stays"""
)
def merge_splits(s: Spark, d: str) -> DataFrame:
    kept = _filtered(s, d).where("reason IS NULL").withColumn("strong", contents.real_author(F.col("names")))
    return contents.merge_weak(kept)


@query("SELECT block_id, false AS promoted FROM layout_blocks WHERE length(trim(text)) BETWEEN 10 AND 200 AND (NOT regexp_matches(trim(text), '\\.$') OR regexp_matches(trim(text), '(Inc|Co|Jr|Sr|Ltd|ed)\\.$')) AND length(trim(text)) - length(replace(trim(text), ' ', '')) >= 2")
def titleish_blocks(s: Spark, d: str) -> DataFrame:
    return table(s, d, "layout_blocks").where(lo.titleish(F.col("text"))).select("block_id", lo.promoted(F.col("text")).alias("promoted"))


_STRIPPED = f"(CASE WHEN len(regexp_split_to_array(trim(regexp_extract(x, '(?i)^\\s*(?:{'|'.join(text.SECTION_LABELS)})\\s*[:.-]?\\s+(.*)$', 1)), '\\s+')) >= 3 THEN trim(regexp_extract(x, '(?i)^\\s*(?:{'|'.join(text.SECTION_LABELS)})\\s*[:.-]?\\s+(.*)$', 1)) ELSE x END)"


@query(
    f"""WITH n AS (SELECT *, sum(CASE WHEN label = 'footnote' THEN 1 ELSE 0 END) OVER (PARTITION BY item, page_no ORDER BY idx, block_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS boxes FROM layout_blocks WHERE item IS NOT NULL AND page_no IS NOT NULL),
h AS (SELECT block_id, boxes, regexp_replace(trim(text), '\\s+', ' ', 'g') AS x FROM n WHERE label <> 'footnote' AND text IS NOT NULL AND length(text) <= 300), t AS (SELECT *, {_STRIPPED} AS t FROM h)
SELECT block_id, CASE WHEN length(t) < 5 THEN 'short' WHEN lower(t) IN ({_list(lo.NOT_TITLES)}) THEN 'heading' WHEN regexp_matches(t, '{lo.TABLE_OR_FIGURE}') THEN 'table' WHEN regexp_matches(t, '{lo.TRADEMARK}') THEN 'trademark'
 WHEN regexp_matches(t, '{lo.LISTED_DEGREES}') THEN 'degrees' WHEN regexp_matches(t, '{lo.DRUG_AD_TITLE}') THEN 'drug' WHEN boxes >= 2 THEN 'form' END AS reason FROM t"""
)
def start_reasons(s: Spark, d: str) -> DataFrame:
    """Blocks as candidates for titles; footnotes stand for check boxes, which these layouts have none of."""
    b = table(s, d, "layout_blocks").where("item IS NOT NULL AND page_no IS NOT NULL")
    boxed = lo.boxes_ahead(b.withColumn("label", F.when(F.col("label") == "footnote", "checkbox_unselected").otherwise(F.col("label"))))
    c = boxed.where("label <> 'checkbox_unselected' AND text IS NOT NULL AND length(text) <= 300").select("block_id", F.col("text").alias("title"), F.lit(None).cast("string").alias("byline"), "boxes")
    return lo.start_reasons(c).select("block_id", "reason")


@query("SELECT item, page_no, list_sort(list(abs(bbox.t - bbox.b)))[count(*) // 2 + 1] AS height FROM layout_blocks WHERE label = 'text' AND bbox IS NOT NULL AND abs(bbox.t - bbox.b) > 0 GROUP BY item, page_no")
def upper_median_heights(s: Spark, d: str) -> DataFrame:
    return lo.upper_median_heights(table(s, d, "layout_blocks"))


@query("SELECT block_id FROM layout_blocks WHERE bbox.t > 300 AND bbox.t <= 700")
def blocks_in_band(s: Spark, d: str) -> DataFrame:
    return lo.in_band(table(s, d, "layout_blocks"), 300.0, 700.0).select("block_id")


@query("SELECT block_id FROM (SELECT *, abs(bbox.t - bbox.b) AS height FROM layout_blocks WHERE bbox IS NOT NULL) QUALIFY height >= 0.85 * median(height) OVER (PARTITION BY item)")
def tall_candidates(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "layout_blocks").where("bbox IS NOT NULL")
    return lo.tall_enough(b.select("item", "block_id", F.abs(F.col("bbox.t") - F.col("bbox.b")).alias("height"))).select("block_id")


@query('SELECT block_id, page_no, coalesce(bbox.t, 0) AS top, coalesce(abs(bbox.t - bbox.b), 0) AS height, coalesce(bbox.l, 0) AS "left", coalesce(bbox.r, 0) AS "right" FROM layout_blocks')
def first_places(s: Spark, d: str) -> DataFrame:
    return lo.first_places(table(s, d, "layout_blocks"))


@query("SELECT item, row_number() OVER (PARTITION BY item ORDER BY page_no NULLS FIRST, coalesce(bbox.t, 0) DESC, block_id)::INT AS n, block_id FROM layout_blocks WHERE label IN ('section_header', 'title', 'paragraph_header') OR (label = 'text' AND length(trim(text)) >= 20)")
def prompt_blocks(s: Spark, d: str) -> DataFrame:
    return lo.prompt_blocks(table(s, d, "layout_blocks"))


# heads with a range of printed pages, and some that have years or nonsense instead
_RANGED = "concat(text, ' ', CASE CAST(page_no % 5 AS INT) WHEN 0 THEN '1978-1979' WHEN 1 THEN '90-12' ELSE '' END, ' ', CAST(page_no * 7 AS VARCHAR(9)), '-', CAST(page_no * 7 + 3 AS VARCHAR(9)))"
_HEADS = f"heads AS (SELECT item, block_id, page_no, {_RANGED} AS text FROM layout_blocks WHERE label IN ('page_header', 'page_footer') AND page_no IS NOT NULL AND text IS NOT NULL)"
_RANGES = """pr AS (SELECT *, unnest(regexp_extract_all(text, '([0-9]+)\\s*[-–—]\\s*([0-9]+)', 1)) AS a, unnest(regexp_extract_all(text, '([0-9]+)\\s*[-–—]\\s*([0-9]+)', 2)) AS z, generate_subscripts(regexp_extract_all(text, '([0-9]+)\\s*[-–—]\\s*([0-9]+)', 1), 1) AS k FROM heads),
hr AS (SELECT item, block_id, (page_no - 1)::INT AS leaf, a::INT AS first_page, z::INT AS last_page FROM pr WHERE length(a) <= 4 AND length(z) <= 4 AND NOT a::INT BETWEEN 1900 AND 2100 AND NOT z::INT BETWEEN 1900 AND 2100 AND z::INT >= a::INT AND z::INT - a::INT <= 200 QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY k) = 1)"""


def _heads(s: Spark, d: str) -> DataFrame:
    return table(s, d, "layout_blocks").where("label IN ('page_header', 'page_footer') AND page_no IS NOT NULL AND text IS NOT NULL").withColumn("text", F.expr(_RANGED.replace("VARCHAR(9)", "STRING")))


@query(f"WITH {_HEADS}, {_RANGES} SELECT * FROM hr")
def head_ranges(s: Spark, d: str) -> DataFrame:
    return lo.head_ranges(_heads(s, d))


@query(
    f"""WITH {_HEADS}, {_RANGES}, ok AS (SELECT * FROM hr QUALIFY count(*) OVER (PARTITION BY item, leaf - first_page) >= 2 OR count(*) OVER (PARTITION BY item) = 1),
sz AS (SELECT item, max(page_no)::INT AS n FROM layout_blocks WHERE page_no IS NOT NULL GROUP BY 1),
a AS (SELECT *, leaf - first_page AS o, row_number() OVER w AS ord, lag(last_page) OVER w AS prev, count(*) OVER (PARTITION BY item) AS many FROM ok WINDOW w AS (PARTITION BY item ORDER BY first_page, leaf)),
cl AS (SELECT item, o, ord, 0 AS pass, unnest(generate_series(first_page, last_page)) AS printed FROM a
 UNION ALL SELECT item, o, ord, 1, unnest(generate_series(prev + 1, first_page - 1)) FROM a WHERE prev + 1 <= first_page - 1
 UNION ALL SELECT item, o, ord, 2, unnest(generate_series(last_page + 1, least(n - 1 - o, 9999))) FROM a JOIN sz USING (item) WHERE ord = many AND last_page + 1 <= least(n - 1 - o, 9999)
 UNION ALL SELECT item, o, ord, 3, unnest(generate_series(greatest(1, -o), first_page - 1)) FROM a WHERE ord = 1 AND greatest(1, -o) <= first_page - 1)
SELECT item, printed::INT AS printed, (printed + o)::INT AS leaf FROM cl QUALIFY row_number() OVER (PARTITION BY item, printed ORDER BY pass, ord) = 1"""
)
def extrapolated_map(s: Spark, d: str) -> DataFrame:
    heads = pagination.supported_offsets(lo.head_ranges(_heads(s, d)))
    sizes = table(s, d, "layout_blocks").where("page_no IS NOT NULL").groupBy("item").agg(F.max("page_no").cast("int").alias("n_leaves"))
    return pagination.repaired_map(heads, sizes)


# ---------------------------------------------------------------- printed contents

_LINE = f"len({_tokens('title', text.STOP_EVIDENCE, 3)}) >= 4 AND len(regexp_extract_all(title, '\\b([0-9]+\\s*[A-Z])\\b', 1)) < 2 AND NOT (regexp_matches(trim(title), '^[A-Z][a-z]+\\.?\\s+[A-Z]\\.?\\s+[A-Z][a-z]+') AND len(regexp_split_to_array(trim(title), '\\s+')) <= 8) AND (length(regexp_replace(title, '[^A-Za-z]', '', 'g')) = 0 OR length(regexp_replace(title, '[^A-Z]', '', 'g')) <= 0.85 * length(regexp_replace(title, '[^A-Za-z]', '', 'g')))"


@query(f"SELECT entry_id FROM toc_entries WHERE {_LINE}")
def contents_lines(s: Spark, d: str) -> DataFrame:
    return table(s, d, "toc_entries").where(lo.contents_line(F.col("title"))).select("entry_id")


@query("SELECT entry_id FROM toc_entries WHERE start_page_number BETWEEN 1 AND 2000")
def page_tokens(s: Spark, d: str) -> DataFrame:
    return table(s, d, "toc_entries").where(lo.page_token(F.col("start_page_number").cast("string"))).select("entry_id")


_INSIDE = duck("cells") + ", bx AS (SELECT item, page_no, 705.0 - page_no * 10 AS t, 100.0 AS b, 540.0 AS r FROM (SELECT DISTINCT item, page_no FROM cells)), ib AS (SELECT c.*, r AS box_r FROM cells c JOIN bx USING (item, page_no) WHERE coalesce(content_layer, '') <> 'furniture' AND c.b >= bx.b - 5 AND c.t <= bx.t + 5)"


def _inside(s: Spark, d: str) -> DataFrame:
    c = view(s, d, "cells")
    boxes = c.select("item", "page_no").distinct().select("item", "page_no", (705.0 - F.col("page_no") * 10).alias("t"), F.lit(100.0).alias("b"), F.lit(540.0).alias("r"))
    return lo.inside_boxes(c, boxes)


@query(_INSIDE + " SELECT item, page_no, block_id FROM ib")
def cells_in_boxes(s: Spark, d: str) -> DataFrame:
    return _inside(s, d).select("item", "page_no", "block_id")


_ROWS = (
    _INSIDE
    + """, c1 AS (SELECT *, CASE WHEN lag(t) OVER w - t > 12 THEN 1 ELSE 0 END AS brk FROM ib WHERE trim(text) <> '' WINDOW w AS (PARTITION BY item, page_no ORDER BY t DESC, l, block_id)),
c2 AS (SELECT *, sum(brk) OVER (PARTITION BY item, page_no ORDER BY t DESC, l, block_id ROWS UNBOUNDED PRECEDING) AS row, l >= box_r - 80 AND regexp_matches(trim(text), '^[0-9]{1,4}$') AND coalesce(TRY_CAST(trim(text) AS INT) BETWEEN 1 AND 2000, false) AS num FROM c1),
c3 AS (SELECT item, page_no, row, max(CASE WHEN num THEN TRY_CAST(trim(text) AS INT) END) AS page, string_agg(trim(text), ' ' ORDER BY l, block_id) FILTER (NOT num AND regexp_matches(text, '[A-Za-z]{3,}')) AS words FROM c2 GROUP BY ALL),
c4 AS (SELECT *, count(page) OVER (PARTITION BY item, page_no ORDER BY row DESC ROWS UNBOUNDED PRECEDING) AS entry FROM c3),
c5 AS (SELECT item, page_no, entry, max(page) AS page, max(row) AS row, trim(regexp_replace(coalesce(string_agg(words, ' ' ORDER BY page IS NULL, row), ''), '\\s+', ' ', 'g')) AS title FROM c4 WHERE entry > 0 GROUP BY ALL),
ar AS (SELECT item, page_no, row_number() OVER (PARTITION BY item, page_no ORDER BY row)::INT AS n, title, page FROM c5 WHERE length(title) > 5)"""
)


@query(_ROWS + " SELECT * FROM ar")
def anchored_rows(s: Spark, d: str) -> DataFrame:
    return lo.anchored_rows(_inside(s, d))


@query(
    _ROWS
    + f""", ok AS (SELECT * FROM ar WHERE {_LINE}), pr AS (SELECT item, page_no, sum(b) OVER (PARTITION BY item ORDER BY page_no) AS k FROM (SELECT item, page_no, CASE WHEN page_no - lag(page_no) OVER (PARTITION BY item ORDER BY page_no) > 1 THEN 1 ELSE 0 END AS b FROM (SELECT DISTINCT item, page_no FROM ar))),
rn AS (SELECT item, min(page_no) AS first_page, max(page_no) AS last_page FROM pr GROUP BY item, k), e1 AS (SELECT ok.*, first_page, last_page FROM ok JOIN rn ON rn.item = ok.item AND page_no BETWEEN first_page AND last_page),
e2 AS (SELECT *, (page >= lag(page) OVER (PARTITION BY item, first_page ORDER BY page_no, n))::INT AS up FROM e1), e3 AS (SELECT item, first_page, last_page, count(*) AS n, sum(up) AS up FROM e2 GROUP BY ALL),
e4 AS (SELECT *, round(n * (1 + CASE WHEN n > 1 THEN up / (n - 1) ELSE 0.0 END) + CASE WHEN EXISTS (SELECT 1 FROM cells c WHERE c.item = e3.item AND c.page_no BETWEEN first_page AND last_page AND c.text LIKE '%istory%') THEN 5 ELSE 0 END, 6) AS score FROM e3)
SELECT item, first_page, last_page, n, score FROM (SELECT * FROM e4 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, first_page) = 1) WHERE n >= 3"""
)
def best_contents(s: Spark, d: str) -> DataFrame:
    """Printed contents pages, with a page that mentions history standing for one with a heading."""
    rows = lo.anchored_rows(_inside(s, d))
    runs = pagination.page_runs(rows, "item", "page_no")
    headed = view(s, d, "cells").where("text LIKE '%istory%'").select("item", "page_no").distinct()
    return lo.best_contents(rows.where(lo.contents_line(F.col("title"))), headed, runs)


@query(
    """WITH e AS (SELECT item, entry_id, coalesce(start_page_index, 0) AS start, end_page_index AS stop, CASE WHEN entry_id % 7 = 0 THEN 1 ELSE 0 END AS o FROM toc_entries WHERE item IS NOT NULL)
SELECT item, entry_id, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY item ORDER BY start, o, entry_id) - 1, stop, start))::INT AS stop FROM e"""
)
def inserted_entries(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries").where("item IS NOT NULL").select("item", "entry_id", F.col("start_page_index").alias("start"), F.col("end_page_index").alias("stop"))
    return lo.insert_entries(e.where("entry_id % 7 <> 0"), e.where("entry_id % 7 = 0"))


# ---------------------------------------------------------------- tables and engines

_METRICS = duck("grid") + """, gr AS (SELECT item, engine, table_pos, row, count(*) AS cells, count(*) FILTER (trim(text) <> '') AS with_text, coalesce(bool_or(coalesce(regexp_matches(trim(text), '^[0-9]{1,4}$') AND TRY_CAST(trim(text) AS INT) BETWEEN 1 AND 2000, false)) AND bool_or(regexp_matches(text, '[A-Za-z]{4,}')), false) AS anchored FROM grid GROUP BY ALL),
tm AS (SELECT item, engine, count(DISTINCT table_pos) AS tables, sum(cells)::BIGINT AS cells, sum(with_text)::BIGINT AS with_text, count(*) FILTER (anchored AND row IS NOT NULL) AS anchored FROM gr GROUP BY ALL)"""


@query(_METRICS + " SELECT * FROM tm")
def table_metrics(s: Spark, d: str) -> DataFrame:
    return lo.table_metrics(view(s, d, "grid"))


@query(_METRICS + " SELECT CASE engine WHEN 'tesseract 5.3' THEN 'tesseract' WHEN 'ABBYY FineReader 11' THEN 'abbyy' WHEN '' THEN '(none)' ELSE engine END AS engine, count(*) AS items, sum(tables)::BIGINT AS tables, median(anchored)::DOUBLE AS median_anchored, round(avg(anchored), 6) AS mean_anchored FROM tm GROUP BY 1")
def engine_summary(s: Spark, d: str) -> DataFrame:
    return lo.engine_summary(lo.table_metrics(view(s, d, "grid")))


@query("SELECT item FROM layout_blocks GROUP BY item HAVING item IS NOT NULL AND count(*) FILTER (label = 'caption') > 0 AND count(*) FILTER (label = 'list_item' AND trim(text) <> '') = 0")
def stale_layouts(s: Spark, d: str) -> DataFrame:
    """Captions stand for tables and list items for their cells."""
    b = table(s, d, "layout_blocks").where("item IS NOT NULL")
    return lo.stale_layouts(b.groupBy("item").agg(F.count_if(F.col("label") == "caption").alias("tables")), b.where("label = 'list_item'").select("item", "text"))


@query(duck("grid") + " SELECT item, table_pos, row, string_agg(coalesce(text, ''), ' | ' ORDER BY col, pos, coalesce(text, '')) AS text FROM grid WHERE row IS NOT NULL GROUP BY item, table_pos, row")
def grid_rows(s: Spark, d: str) -> DataFrame:
    return placement.table_rows(view(s, d, "grid"), "item")
