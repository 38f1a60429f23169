"""Queries of the periodical operators, and SQL that states the same over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.functions import pages, text
from foliant.operators import catalogue, contents, lookup, nested, pagination, placement, requests, scoring
from foliant.plans.adapters import duck, view
from foliant.session import table
from foliant.sources import sinks
from foliant.streaming import arrivals
from foliant.sources.providers import TableProvider, enrich_all

Spark = SparkSession
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _tokens(c: str, stop: list[str] = text.STOP_TITLE, least: int = 1) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= {least} AND x NOT IN ({_in(stop)}))"


def _overlap(a: str, b: str) -> str:
    return f"(CASE WHEN least(len(list_distinct({a})), len(list_distinct({b}))) > 0 THEN len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / least(len(list_distinct({a})), len(list_distinct({b}))) ELSE 0.0 END)"


# ---------------------------------------------------------------- scan pages

_BR = ", br AS (SELECT item, leaf, label, CASE WHEN accessible THEN CAST(sum(CASE WHEN accessible THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY leaf) - 1 AS INT) END AS br FROM leaves) "


@query(duck("leaves") + _BR + "SELECT item, leaf, br FROM br")
def page_index_map(s: Spark, d: str) -> DataFrame:
    return pagination.page_index_map(view(s, d, "leaves"))


@query(duck("leaves") + _BR + "SELECT item, label, arg_min(br, leaf) AS br FROM br WHERE br IS NOT NULL AND label IS NOT NULL GROUP BY item, label")
def printed_to_page(s: Spark, d: str) -> DataFrame:
    return pagination.printed_to_page(view(s, d, "leaves"))


@query(duck("leaves") + _BR + "SELECT item, br, label FROM br WHERE br IS NOT NULL AND label IS NOT NULL")
def page_to_printed(s: Spark, d: str) -> DataFrame:
    return pagination.page_to_printed(view(s, d, "leaves"))


@query(
    duck("leaves")
    + """, named AS (SELECT *, TRY_CAST(label AS INT) - lag(TRY_CAST(label AS INT)) OVER (PARTITION BY item ORDER BY leaf) AS step, lag(leaf) OVER (PARTITION BY item ORDER BY leaf) AS before FROM leaves WHERE label IS NOT NULL),
g AS (SELECT item, count(*) AS n_labels, count(DISTINCT label) AS n_distinct, count(*) FILTER (confidence > 0) AS n_confident, count(before) AS n_pairs, count(*) FILTER (step = 1) AS n_steps FROM named GROUP BY item),
t AS (SELECT item, count(*) AS n_rows FROM leaves GROUP BY item),
j AS (SELECT item, n_rows, coalesce(n_labels, 0) AS n_labels, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_confident, 0) AS n_confident, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_steps, 0) AS n_steps FROM t LEFT JOIN g USING (item))
SELECT item, n_rows, n_labels, n_confident, n_pairs, n_steps, CASE WHEN (n_labels - n_distinct) * 100 > 5 * n_labels THEN 'restart_pagination'
 WHEN n_labels * 100 < 10 * n_rows AND n_confident * 100 < 5 * n_labels OR n_labels = 0 THEN 'unusable'
 WHEN n_labels * 100 >= 60 * n_rows AND n_confident * 100 >= 20 * n_labels AND n_steps * 100 >= 85 * n_pairs THEN 'ok' ELSE 'repair' END AS status FROM j"""
)
def page_label_health(s: Spark, d: str) -> DataFrame:
    return pagination.page_label_health(view(s, d, "leaves"))


@query(duck("heads") + "SELECT item, leaf, first_page, last_page, leaf - first_page AS \"offset\" FROM heads QUALIFY count(*) OVER (PARTITION BY item, leaf - first_page) >= 2 OR count(*) OVER (PARTITION BY item) = 1")
def repair_consistency_filter(s: Spark, d: str) -> DataFrame:
    return pagination.supported_offsets(view(s, d, "heads"))


@query(
    duck("heads")
    + """, a AS (SELECT *, leaf - first_page AS o, row_number() OVER w AS ord, lag(last_page) OVER w AS prev FROM heads WINDOW w AS (PARTITION BY item ORDER BY first_page, leaf)),
c AS (SELECT item, o, ord, 0 AS pass, unnest(generate_series(first_page, greatest(first_page, last_page))) AS printed FROM a
      UNION ALL SELECT item, o, ord, 1, unnest(generate_series(prev + 1, first_page - 1)) FROM a WHERE prev + 1 <= first_page - 1)
SELECT item, printed::INT AS printed, (printed + o)::INT AS leaf FROM c QUALIFY row_number() OVER (PARTITION BY item, printed ORDER BY pass, ord) = 1"""
)
def repaired_map(s: Spark, d: str) -> DataFrame:
    return pagination.repaired_map(view(s, d, "heads"))


def _assertions(s: Spark, d: str) -> DataFrame:
    leaves = view(s, d, "leaves")
    return pagination.compare_assertions(leaves.select("item", "leaf", (F.col("leaf") + 1 + F.col("item") % 2).cast("string").alias("asserted")), leaves.select("item", "leaf", F.col("label").alias("observed")))


_ASSERT = ", c AS (SELECT item, leaf, CAST(leaf + 1 + item % 2 AS VARCHAR) AS asserted, label AS observed, CASE WHEN coalesce(label, '') = '' THEN 'no_ocr' WHEN label = CAST(leaf + 1 + item % 2 AS VARCHAR) THEN 'match' ELSE 'mismatch' END AS outcome FROM leaves) "


@query(duck("leaves") + _ASSERT + "SELECT item, leaf, asserted, observed, outcome FROM c")
def scanner_assertions(s: Spark, d: str) -> DataFrame:
    return _assertions(s, d)


@query(duck("leaves") + _ASSERT + "SELECT asserted, observed, count(*) AS n FROM c WHERE outcome = 'mismatch' GROUP BY 1, 2 ORDER BY n DESC, asserted, observed LIMIT 40")
def top_mismatch_pairs(s: Spark, d: str) -> DataFrame:
    return pagination.top_mismatches(_assertions(s, d))


@query("SELECT item, min(p) AS first_page, max(p) AS last_page, count(*) AS n FROM (SELECT item, p, sum(b) OVER (PARTITION BY item ORDER BY p) AS r FROM (SELECT item, p, CASE WHEN p - lag(p) OVER (PARTITION BY item ORDER BY p) > 1 THEN 1 ELSE 0 END AS b FROM (SELECT DISTINCT item, start_page_index AS p FROM toc_entries WHERE item IS NOT NULL AND start_page_index IS NOT NULL))) GROUP BY item, r")
def page_clusters(s: Spark, d: str) -> DataFrame:
    return pagination.page_runs(table(s, d, "toc_entries"), "item", "start_page_index")


# ---------------------------------------------------------------- requests

_STRIP = r"nullif(regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'), '')"


def _log(s: Spark, d: str) -> DataFrame:
    a = table(s, d, "ill_anchors")
    pick = lambda k: F.transform("leaf_ranges", lambda r: F.element_at(r, k))
    params = F.struct(*[F.col(c).alias(n) for c, n in (("article_title", "article_title"), ("article_author", "article_author"), ("journal_title", "journal_title"), ("issn", "standard_number"), ("volume", "journal_volume"), ("issue", "journal_issue"), ("yr", "journal_year"), ("journal_pages", "journal_pages"))])
    form = F.struct("identifier", pick(1).alias("start"), pick(2).alias("stop"), "provider", "unfill_reason", params.alias("original_request_params"))
    return a.select(F.unix_timestamp(F.col("request_time").cast("timestamp")).cast("string").alias("time"), F.col("identifier").alias("source_identifier"), F.to_json(form).alias("full_form"), F.lit("log").alias("src_file"), F.col("anchor_id").alias("src_ord"))


@query(
    f"""SELECT {_STRIP.format('identifier')} AS item, {_STRIP.format('article_title')} AS article_title, {_STRIP.format('article_author')} AS article_author, {_STRIP.format('issn')} AS issn,
{_STRIP.format('volume')} AS volume, {_STRIP.format('journal_pages')} AS printed_pages, epoch(date_trunc('second', request_time))::BIGINT AS request_time, len(leaf_ranges)::INT AS n_ranges, anchor_id AS src_ord
FROM ill_anchors WHERE len(leaf_ranges) > 0 AND {_STRIP.format('identifier')} IS NOT NULL"""
)
def log_parse_project(s: Spark, d: str) -> DataFrame:
    p = requests.parse_log(_log(s, d))
    return p.select("item", "article_title", "article_author", "issn", "volume", "printed_pages", "request_time", F.size("ranges").alias("n_ranges"), "src_ord")


@query("SELECT anchor_id, identifier, article_title FROM ill_anchors QUALIFY row_number() OVER (PARTITION BY identifier, article_title, leaf_ranges ORDER BY logged_at, anchor_id) = 1")
def log_dedup_first(s: Spark, d: str) -> DataFrame:
    a = table(s, d, "ill_anchors").withColumn("k", F.to_json("leaf_ranges"))
    return requests.first_wins(a, ["identifier", "article_title", "k"], ["logged_at", "anchor_id"]).select("anchor_id", "identifier", "article_title")


@query("SELECT identifier, count(*) AS n FROM ill_anchors WHERE request_time >= TIMESTAMP '2024-04-01' GROUP BY identifier")
def log_cutoff_items(s: Spark, d: str) -> DataFrame:
    return requests.requests_of_items(requests.since(table(s, d, "ill_anchors"), "request_time", "2024-04-01"), "identifier")


@query("SELECT anchor_id, len(leaf_ranges) > 0 AND len(list_filter(leaf_ranges, lambda r: regexp_full_match(r[1], 'n[0-9]+') AND regexp_full_match(r[2], 'n[0-9]+'))) = len(leaf_ranges) AS leaf_shaped FROM ill_anchors WHERE leaf_ranges IS NOT NULL")
def leaf_shape_choice(s: Spark, d: str) -> DataFrame:
    pick = lambda k: F.transform("leaf_ranges", lambda r: F.element_at(r, k))
    return table(s, d, "ill_anchors").where("leaf_ranges IS NOT NULL").select("anchor_id", (requests.all_leaves(pick(1)) & requests.all_leaves(pick(2))).alias("leaf_shaped"))


@query("SELECT identifier, count(*) FILTER (trim(coalesce(article_title, '')) <> '') AS n_named FROM ill_anchors GROUP BY identifier HAVING n_named >= 2 ORDER BY n_named DESC, identifier LIMIT 100")
def sample_items(s: Spark, d: str) -> DataFrame:
    return requests.sample_items(table(s, d, "ill_anchors"), "identifier", "article_title")


@query(r"""SELECT anchor_id, identifier FROM ill_anchors WHERE NOT regexp_matches(identifier, '[0-9]{4}[a-z]+(_[a-z0-9]+)*$') AND (regexp_matches(identifier, '^sim_') OR regexp_matches(identifier, '^pub_')
OR regexp_matches(identifier, '_[0-9]{4}.*_[0-9]+_[0-9]+(-[0-9]+)?$') OR regexp_matches(identifier, '_[0-9]{4}-[0-9]{2}_[0-9]+_[0-9]+(-[0-9]+)?$')
OR regexp_matches(identifier, '(?i)_(spring|summer|fall|autumn|winter|january|february|march|april|may|june|july|august|september|october|november|december)[a-z0-9_-]*_[0-9]+_[0-9]+'))""")
def periodical_corpus(s: Spark, d: str) -> DataFrame:
    return requests.periodical_corpus(table(s, d, "ill_anchors"), "identifier").select("anchor_id", "identifier")


@query("SELECT identifier AS item, issn, volume, issue, yr AS \"year\" FROM ill_anchors WHERE regexp_matches(issn, '^[0-9]{4}-?[0-9]{3}[0-9Xx]$') AND volume IS NOT NULL AND issue IS NOT NULL AND yr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY anchor_id) = 1")
def usable_metadata(s: Spark, d: str) -> DataFrame:
    a = table(s, d, "ill_anchors").select(F.col("identifier").alias("item"), "issn", "volume", "issue", F.col("yr").alias("year"), F.col("anchor_id").alias("ord"))
    return requests.usable_metadata(a)


@query("SELECT * FROM (SELECT anchor_id, (epoch(date_trunc('second', request_time)) - epoch(date_trunc('second', lag(request_time) OVER (PARTITION BY identifier, article_title ORDER BY request_time, anchor_id))))::BIGINT AS gap_s FROM ill_anchors) WHERE gap_s <= 3600")
def operator_retries(s: Spark, d: str) -> DataFrame:
    return requests.retry_rows(table(s, d, "ill_anchors"), ["identifier", "article_title"], ["request_time", "anchor_id"], 3600).select("anchor_id", "gap_s")


@query()
def cover_text_fields(s: Spark, d: str) -> DataFrame:
    a = table(s, d, "ill_anchors")
    line = lambda c, other="": F.coalesce(F.regexp_replace(c, r"\s+", " "), F.lit(other))
    numbers = F.concat(F.lit("volume "), line("volume", "0"), F.lit(" issue "), line("issue", "0"), F.lit(" year "), line("yr", "0"))
    t = F.concat_ws("\n", F.lit("Request on Friday, July 1st, 2022"), line("journal_title", "?"), "issn", line("article_title"), line("article_author", "Anon."), numbers, F.concat(F.lit("pages "), F.col("journal_pages")), F.lit(""), F.lit("Response from the library"))
    return requests.parse_cover_text(a.select("anchor_id", t.alias("t")), "anchor_id", "t")


# ---------------------------------------------------------------- scoring

_PAIRS = duck("known", "listed") + f""", p AS (SELECT *, coalesce({_overlap(_tokens('title'), _tokens('e_title'))} >= 0.6, false) AS title_hit, coalesce(list_has_any(names, e_names), false) AS author_hit,
coalesce(a_start = e_start AND a_end = e_end, false) AS same, coalesce(abs(a_start - e_start) <= 1, false) AS near FROM known JOIN listed USING (item)) """
_HITS = _PAIRS + """, ranked AS (SELECT anchor_id, item, entry_id, ord, e_end - a_end AS off, CASE WHEN same AND (title_hit OR author_hit) THEN 1 WHEN near AND (title_hit OR author_hit) THEN 2 WHEN same THEN 3 WHEN title_hit OR author_hit THEN 4 ELSE 5 END AS rank FROM p),
hits AS (SELECT anchor_id, item, ['exact', 'soft', 'leaves_only', 'content_only', 'miss'][rank] AS match, CASE WHEN rank < 5 THEN entry_id END AS entry_id, CASE WHEN rank < 5 THEN off END AS end_offset FROM ranked
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY rank, ord, entry_id) = 1) """


def _pairs(s: Spark, d: str) -> DataFrame:
    return scoring.judged_pairs(view(s, d, "known"), view(s, d, "listed"))


@query(_HITS + "SELECT anchor_id, match, entry_id, end_offset FROM hits")
def find_hit_rank(s: Spark, d: str) -> DataFrame:
    return scoring.find_hit(_pairs(s, d))


@query(_PAIRS + ", g AS (SELECT anchor_id, count(*) FILTER (title_hit OR author_hit) AS n_content, count(*) FILTER ((title_hit OR author_hit) AND near AND e_end - a_end BETWEEN 0 AND 2) AS n_passing FROM p GROUP BY anchor_id) SELECT *, n_passing >= 1 AS hit, n_passing >= 2 AS ambiguous FROM g")
def findable(s: Spark, d: str) -> DataFrame:
    return scoring.findable(_pairs(s, d))


@query(_PAIRS + f", sc AS (SELECT anchor_id, entry_id, ord, (floor(floor(100 * {_overlap(_tokens('title'), _tokens('e_title'))}) * 55 / 100) + CASE WHEN same THEN 40 WHEN near THEN 24 ELSE 0 END + CASE WHEN author_hit THEN 5 ELSE 0 END)::INT AS score FROM p) SELECT anchor_id, entry_id, score FROM sc WHERE score >= 55 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, ord, entry_id) = 1")
def best_match_blend(s: Spark, d: str) -> DataFrame:
    return scoring.best_blend(_pairs(s, d))


@query(
    _PAIRS
    + """, r AS (SELECT anchor_id, abs(e_start - a_start) AS d, ord, entry_id, e_end - e_start AS span, a_end - a_start AS a_span, title_hit, author_hit FROM p WHERE a_start IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY d NULLS LAST, ord, entry_id) AS n FROM r)
SELECT anchor_id, CASE WHEN d IS NULL THEN 'no_entries' WHEN d > 5 THEN 'no_neighbor_entry' WHEN a_span <= 1 THEN 'short_anchor_range' WHEN title_hit AND NOT author_hit THEN 'wrong_author'
WHEN author_hit AND NOT title_hit THEN 'wrong_title' WHEN span < floor(a_span / 2) THEN 'split_article' ELSE 'leaf_offset' END AS category, d AS distance FROM b WHERE n = 1"""
)
def miss_categories(s: Spark, d: str) -> DataFrame:
    return scoring.miss_category(_pairs(s, d))


@query(_HITS + "SELECT match, CASE WHEN end_offset IS NULL THEN 'none' WHEN end_offset < -2 THEN 'far short' WHEN end_offset < 0 THEN 'short' WHEN end_offset = 0 THEN 'equal' WHEN end_offset <= 2 THEN 'beyond by 2' ELSE 'far beyond' END AS band, count(*) AS n FROM hits GROUP BY 1, 2")
def end_offset_bands(s: Spark, d: str) -> DataFrame:
    return scoring.end_offset_bands(scoring.find_hit(_pairs(s, d)))


@query(_HITS + "SELECT item, count(*) AS n, count(*) FILTER (match = 'exact') AS exact, count(*) FILTER (match = 'soft') AS soft, count(*) FILTER (match = 'leaves_only') AS leaves_only, count(*) FILTER (match = 'content_only') AS content_only, count(*) FILTER (match = 'miss') AS miss, ((count(*) FILTER (match = 'exact' OR match = 'soft')) * 100 // count(*))::BIGINT AS placed_pct FROM hits GROUP BY ROLLUP (item)")
def scoreboard_rollup(s: Spark, d: str) -> DataFrame:
    hits = scoring.find_hit(_pairs(s, d)).join(view(s, d, "known").select("anchor_id", "item"), "anchor_id")
    return scoring.scoreboard(hits, "item")


@query(f"SELECT entry_id, array_to_string({_tokens('title')}, ' ') AS norm, len({_tokens('title', text.STOP_AUDIT, 2)})::INT AS n_audit, len({_tokens('title', text.STOP_EVIDENCE, 3)})::INT AS n_evidence FROM toc_entries WHERE title IS NOT NULL")
def title_normalize(s: Spark, d: str) -> DataFrame:
    t = F.col("title")
    return table(s, d, "toc_entries").where("title IS NOT NULL").select("entry_id", text.normalize_title(t).alias("norm"), F.size(text.tokens(t, text.STOP_AUDIT, 2)).alias("n_audit"), F.size(text.tokens(t, text.STOP_EVIDENCE, 3)).alias("n_evidence"))


@query()
def title_ratio_join(s: Spark, d: str) -> DataFrame:
    """Anchors and entries of an issue whose titles share a word, with the agreement and likeness of their titles."""
    words = lambda df, c: df.withColumn("_w", F.explode(F.array_distinct(text.tokens(F.col(c)))))
    j = words(view(s, d, "known").select("anchor_id", "item", "title"), "title").join(words(view(s, d, "listed").select("entry_id", "item", "e_title"), "e_title"), ["item", "_w"]).drop("_w").distinct()
    return j.select("anchor_id", "entry_id", text.title_match(F.col("title"), F.col("e_title")).alias("agree"), F.round(text.seq_ratio(text.normalize_title(F.col("title")), text.normalize_title(F.col("e_title"))), 6).alias("ratio"))


@query(
    r"""SELECT anchor_id, coalesce(list_distinct(list_filter(list_transform(string_split_regex(article_author, '\s*(?:;|&|\band\b)\s*'),
 lambda p: lower(CASE WHEN contains(p, ',') THEN regexp_extract(string_split(p, ',')[1], '([A-Z][A-Za-z''-]+)', 1) ELSE regexp_extract(p, '.*\b([A-Z][A-Za-z''-]{2,})', 1) END)), lambda n: n <> '')), [])::VARCHAR[] AS l FROM ill_anchors""".replace("SELECT anchor_id,", "WITH x AS (SELECT anchor_id,")
    + ") SELECT anchor_id, array_to_string(list_sort(l), ' ') AS surnames, len(l)::INT AS n FROM x"
)
def surname_overlap(s: Spark, d: str) -> DataFrame:
    n = text.surnames(F.col("article_author"))
    return table(s, d, "ill_anchors").select("anchor_id", F.array_join(F.array_sort(n), " ").alias("surnames"), F.size(n).alias("n"))


@query(
    """WITH r AS (SELECT request_id, issn, trim(coalesce(iss, '')) AS a FROM lookup_requests WHERE issn IS NOT NULL), e AS (SELECT DISTINCT issn, trim(coalesce(issue, '')) AS b FROM toc_entries WHERE issn IS NOT NULL)
SELECT request_id, count(*) AS n_labels, count(*) FILTER (CASE WHEN a = '' OR b = '' THEN a = b ELSE list_has_any(list_distinct(list_concat([lower(a)], list_transform(string_split_regex(lower(a), '[-/,]'), lambda x: trim(x)))), list_distinct(list_concat([lower(b)], list_transform(string_split_regex(lower(b), '[-/,]'), lambda x: trim(x))))) END) AS n_match
FROM r JOIN e USING (issn) GROUP BY request_id"""
)
def label_match(s: Spark, d: str) -> DataFrame:
    r = table(s, d, "lookup_requests").where("issn IS NOT NULL").select("request_id", "issn", "iss")
    e = table(s, d, "toc_entries").where("issn IS NOT NULL").select("issn", F.trim(F.coalesce("issue", F.lit(""))).alias("issue")).distinct()
    return r.join(e, "issn").groupBy("request_id").agg(F.count(F.lit(1)).alias("n_labels"), F.count_if(text.label_match(F.col("iss"), F.col("issue"))).alias("n_match"))


_FOLD = "list_reduce(list_prepend(0, list_transform(range(1, length(v) + 1), lambda i: {val} * CASE WHEN i < length(v) AND {val} < list_max(list_transform(range(i + 1, length(v) + 1), lambda k: {valk})) THEN -1 ELSE 1 END)), lambda a, b: a + b)"
_VAL = "(CASE substr(v, {i}::BIGINT, 1) WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END)"


@query("WITH t AS (SELECT entry_id, lower(trim(volume)) AS v FROM toc_entries) SELECT entry_id, (" + _FOLD.format(val=_VAL.format(i="i"), valk=_VAL.format(i="k")) + ")::INT AS value FROM t WHERE regexp_full_match(v, '[ivxlcdm]+')")
def roman_volumes(s: Spark, d: str) -> DataFrame:
    return table(s, d, "toc_entries").select("entry_id", pages.roman_to_int(F.col("volume")).alias("value")).where("value IS NOT NULL")


@query(
    r"""WITH t AS (SELECT request_id, trim(pages) AS p, regexp_extract(trim(pages), '^([0-9]{1,9})\s*[-–]\s*([0-9]{1,9})', 1) AS a, regexp_extract(trim(pages), '^([0-9]{1,9})\s*[-–]\s*([0-9]{1,9})', 2) AS b, TRY_CAST(regexp_extract(trim(pages), '^([0-9]{1,9})', 1) AS BIGINT) AS one FROM lookup_requests),
u AS (SELECT *, TRY_CAST(a AS BIGINT) AS s, TRY_CAST(b AS BIGINT) AS e, (10 ** length(b))::BIGINT AS k FROM t), v AS (SELECT *, s - s % k + e AS near FROM u)
SELECT request_id, coalesce(s, one) AS first_page, coalesce(CASE WHEN length(b) < length(a) AND e < s THEN CASE WHEN near < s THEN near + k ELSE near END ELSE e END, one) AS last_page FROM v WHERE one IS NOT NULL"""
)
def page_ranges(s: Spark, d: str) -> DataFrame:
    r = pages.parse_pages(F.col("pages"))
    return table(s, d, "lookup_requests").select("request_id", r.alias("r")).where("r IS NOT NULL").select("request_id", F.col("r.first").alias("first_page"), F.col("r.last").alias("last_page"))


# ---------------------------------------------------------------- contents

@query("WITH x AS (SELECT item, max(greatest(start_page_index, end_page_index)) AS m FROM toc_entries GROUP BY item) SELECT e.item, entry_id, start_page_index AS start, greatest(start_page_index, coalesce(lead(start_page_index) OVER (PARTITION BY e.item ORDER BY start_page_index, entry_id) - 1, m))::INT AS stop FROM toc_entries e JOIN x ON e.item = x.item WHERE start_page_index IS NOT NULL")
def toc_spans(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries")
    last = e.groupBy("item").agg(F.max(F.greatest("start_page_index", "end_page_index")).alias("m"))
    return contents.spans(e.where("start_page_index IS NOT NULL").select("item", "entry_id", F.col("start_page_index").alias("start")).join(last, "item"), "m")


@query(f"SELECT CASE WHEN regexp_matches(lower(trim(title)), '{contents.FRONT_TITLE.replace(chr(39), chr(39) * 2)}') THEN 'frontmatter' WHEN regexp_matches(lower(trim(title)), '{contents.BACK_TITLE}') THEN 'backmatter' ELSE 'article' END AS kind, entry_type, count(*) AS n FROM toc_entries GROUP BY 1, 2")
def entry_kinds(s: Spark, d: str) -> DataFrame:
    return table(s, d, "toc_entries").groupBy(contents.entry_kind(F.col("title")).alias("kind"), "entry_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH h AS (SELECT *, coalesce(label IN ('section_header', 'title'), false) AS is_head FROM layout_blocks WHERE item IS NOT NULL),
b AS (SELECT *, CASE WHEN coalesce(lag(is_head) OVER w, false) AND is_head AND abs(lag(bbox.t) OVER w - bbox.t) <= 80 THEN 0 ELSE 1 END AS brk FROM h WINDOW w AS (PARTITION BY item, page_no ORDER BY idx)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY item, page_no ORDER BY idx) AS run FROM b) SELECT item, page_no, min(idx) AS first_idx, count(*)::INT AS n, string_agg(text, ' ' ORDER BY idx) AS text FROM r WHERE is_head AND text IS NOT NULL GROUP BY item, page_no, run"""
)
def stacked_headers(s: Spark, d: str) -> DataFrame:
    return contents.stacked_headers(table(s, d, "layout_blocks"))


@query("WITH b AS (SELECT *, coalesce(regexp_full_match(trim(text), '[0-9]{1,4}'), false) AS x FROM layout_blocks WHERE item IS NOT NULL), g AS (SELECT *, sum(x::INT) OVER (PARTITION BY item ORDER BY idx) AS part FROM b) SELECT item, part::BIGINT AS part, min(idx) AS first_idx, count(*) AS n FROM g WHERE NOT x GROUP BY item, part")
def delimited_groups(s: Spark, d: str) -> DataFrame:
    return contents.delimited_groups(table(s, d, "layout_blocks"))


_LETTERS = "length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g'))"
# every third page's texts cut to twelve characters, as on a page that is all but blank
_THIN = "(SELECT * REPLACE (CASE WHEN page_no % 3 = 0 THEN substr(text, 1, 12) ELSE text END AS text) FROM layout_blocks)"


@query(f"SELECT item, page_no, sum(CASE WHEN {_LETTERS} >= 5 THEN {_LETTERS} ELSE 0 END)::BIGINT AS n_chars FROM {_THIN} GROUP BY item, page_no HAVING n_chars < 50")
def blank_pages(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "layout_blocks")
    return contents.blank_pages(b.withColumn("text", F.when(F.col("page_no") % 3 == 0, F.substring("text", 1, 12)).otherwise(F.col("text"))))


@query(f"WITH p AS (SELECT item, page_no, max(CASE WHEN label IN ('section_header', 'title') THEN bbox.t END) AS top, max(CASE WHEN label = 'text' AND {_LETTERS} >= 5 THEN bbox.b END) AS tb FROM layout_blocks GROUP BY item, page_no) SELECT item, page_no, coalesce(tb > top + 5, false) AS above FROM p WHERE top IS NOT NULL")
def content_above_title(s: Spark, d: str) -> DataFrame:
    return contents.content_above_title(table(s, d, "layout_blocks"))


# some blocks say that they head a list of contents
_LISTED = "(SELECT * REPLACE (CASE WHEN block_id % 9 = 0 THEN 'TABLE OF\nCONTENTS.' WHEN block_id % 10 = 0 THEN 'Contents of this and other numbers' ELSE text END AS text) FROM layout_blocks)"


def _listed(s: Spark, d: str) -> DataFrame:
    k = F.col("block_id")
    return table(s, d, "layout_blocks").withColumn("text", F.when(k % 9 == 0, "TABLE OF\nCONTENTS.").when(k % 10 == 0, "Contents of this and other numbers").otherwise(F.col("text")))


@query(rf"SELECT DISTINCT item, page_no FROM {_LISTED} WHERE length(text) <= 60 AND coalesce(content_layer, '') <> 'furniture' AND regexp_matches(text, '(?i)\b(contents|table\s+of\s+contents)\b')")
def contents_pages(s: Spark, d: str) -> DataFrame:
    return contents.contents_pages(_listed(s, d))


@query(rf"SELECT DISTINCT item, page_no FROM {_LISTED} WHERE label IN ('section_header', 'title', 'paragraph_header') AND trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) IN ('contents', 'table of contents')")
def toc_pages(s: Spark, d: str) -> DataFrame:
    return contents.toc_pages(_listed(s, d))


@query(duck("model") + "SELECT item, entry_id, title, concat('n', greatest(0, start - 1)) AS first_leaf, concat('n', greatest(greatest(0, start - 1), stop - 1)) AS last_leaf, CASE WHEN first_page > 0 THEN concat(first_page, '-', CASE WHEN last_page > 0 THEN last_page ELSE first_page END) END AS printed, 0.9::DOUBLE AS confidence FROM model")
def model_entries_to_pages(s: Spark, d: str) -> DataFrame:
    return contents.layout_to_legacy(view(s, d, "model"))


@query(
    f"""WITH e AS (SELECT issn, entry_id, list_distinct({_tokens('title', text.STOP_FILTER, 3)}) AS et FROM toc_entries WHERE issn IS NOT NULL AND start_page_number > 0), h AS (SELECT issn, min(anchor_id) AS block_id, list_distinct({_tokens('article_title', text.STOP_FILTER, 3)}) AS bt, TRY_CAST(regexp_extract(journal_pages, '([0-9]+)', 1) AS INT) AS pg
FROM ill_anchors WHERE issn IS NOT NULL AND article_title IS NOT NULL GROUP BY issn, article_title, journal_pages), p AS (SELECT e.*, x.start_page_number AS pg FROM e JOIN toc_entries x USING (entry_id)),
m AS (SELECT p.entry_id, h.block_id FROM p JOIN h ON p.issn = h.issn AND p.pg = h.pg WHERE len(list_intersect(et, bt)) > 0 AND len(list_intersect(et, bt))::DOUBLE / least(len(et), len(bt)) >= 0.5) SELECT entry_id, min(block_id) AS first_block, count(*) AS n_blocks FROM m GROUP BY entry_id"""
)
def title_overlap_join(s: Spark, d: str) -> DataFrame:
    page = F.regexp_extract("journal_pages", "([0-9]+)", 1).try_cast("int").cast("string")
    e = table(s, d, "toc_entries").where("issn IS NOT NULL AND start_page_number > 0").select(F.concat_ws("|", "issn", "start_page_number").alias("item"), "entry_id", "title")
    a = table(s, d, "ill_anchors").where("issn IS NOT NULL AND article_title IS NOT NULL").groupBy("issn", "article_title", "journal_pages").agg(F.min("anchor_id").alias("block_id"))
    h = a.where(page.isNotNull()).select(F.concat_ws("|", "issn", page).alias("item"), "block_id", F.col("article_title").alias("text"))
    return contents.title_in_contents(e, h)


# ---------------------------------------------------------------- catalogues and audits

_NT = "array_to_string({0}, ' ')"


@query(
    duck("catalogue")
    + f""", p AS (SELECT identifier AS pub_id, {_NT.format(_tokens('title'))} AS t, issn, sim_pubid, lower(publisher) AS publisher FROM pubs), c AS (SELECT ident, {_NT.format(_tokens('name'))} AS t, issn, sim_pubid, lower(publisher) AS publisher FROM catalogue),
i AS (SELECT issn, min(ident) AS by_issn FROM c WHERE issn IS NOT NULL GROUP BY issn), m AS (SELECT sim_pubid, min(ident) AS by_sim FROM c WHERE sim_pubid IS NOT NULL GROUP BY sim_pubid),
t AS (SELECT t, min(ident) AS by_title, count(DISTINCT ident) AS n FROM c WHERE t <> '' GROUP BY t),
b AS (SELECT pub_id, min(ident) AS by_both FROM p JOIN c USING (t) WHERE t <> '' AND p.publisher <> '' AND c.publisher <> '' AND (contains(c.publisher, p.publisher) OR contains(p.publisher, c.publisher)) GROUP BY pub_id)
SELECT p.pub_id, coalesce(by_issn, by_sim, CASE WHEN n = 1 THEN by_title END, by_both) AS container_id, CASE WHEN by_issn IS NOT NULL THEN 'issn' WHEN by_sim IS NOT NULL THEN 'sim_pubid' WHEN n = 1 THEN 'title' WHEN by_both IS NOT NULL THEN 'title+publisher' WHEN n > 1 THEN 'title_ambiguous' ELSE 'unmatched' END AS method
FROM p LEFT JOIN i ON p.issn = i.issn LEFT JOIN m ON p.sim_pubid = m.sim_pubid LEFT JOIN t ON p.t = t.t LEFT JOIN b ON p.pub_id = b.pub_id"""
)
def pub_match_cascade(s: Spark, d: str) -> DataFrame:
    return catalogue.match_publications(table(s, d, "pubs").withColumnRenamed("identifier", "pub_id"), view(s, d, "catalogue"))


@query("WITH c AS (SELECT p.identifier, p.title, p.publisher, count(DISTINCT a.identifier) AS issue_count FROM pubs p JOIN ill_anchors a ON a.issn = p.issn GROUP BY ALL) SELECT coalesce(publisher, '?') AS publisher, sum(issue_count)::BIGINT AS issues, count(*) AS pubs, min(title) AS sample FROM c GROUP BY 1 ORDER BY issues DESC, publisher LIMIT 25")
def rank_publishers(s: Spark, d: str) -> DataFrame:
    n = table(s, d, "ill_anchors").groupBy("issn").agg(F.count_distinct("identifier").alias("issue_count"))
    return catalogue.rank_publishers(table(s, d, "pubs").join(n, "issn"))


@query(duck("issues") + ", j AS (SELECT issn, sum(anchors) AS a, sum(hits) AS h FROM issues GROUP BY issn) SELECT CASE WHEN a < 30 THEN 'unknown' WHEN h * 100 / a >= 95 THEN 'clean' WHEN h * 100 / a >= 80 THEN 'near' WHEN h * 100 / a >= 50 THEN 'mid' WHEN h > 0 THEN 'bad' ELSE 'zero' END AS tier, count(*) AS journals FROM j GROUP BY 1")
def journal_tiers(s: Spark, d: str) -> DataFrame:
    return catalogue.journal_tiers(view(s, d, "issues"))


_EARLY = duck("issues") + """, b AS (SELECT *, CASE WHEN year BETWEEN 1900 AND 2030 THEN concat(year - year % 5, '-', year - year % 5 + 4) ELSE 'unknown' END AS bucket FROM issues),
n AS (SELECT *, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY issn, bucket ORDER BY year, issue)), k AS (SELECT *, n - coalesce(max(CASE WHEN hits > 0 THEN n END) OVER (PARTITION BY issn, bucket ORDER BY year, issue), 0) AS streak FROM n),
kept AS (SELECT *, coalesce(max(CASE WHEN streak >= 3 THEN 1 END) OVER (PARTITION BY issn, bucket ORDER BY year, issue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM k) """


@query(_EARLY + "SELECT issn, bucket, year, issue, anchors, hits FROM kept WHERE done = 0")
def early_stop(s: Spark, d: str) -> DataFrame:
    return catalogue.stop_after_misses(view(s, d, "issues")).select("issn", "bucket", "year", "issue", "anchors", "hits")


@query(_EARLY + "SELECT issn, bucket, count(*) AS queried, sum(anchors)::BIGINT AS anchors_seen, sum(hits)::BIGINT AS anchors_matched, (sum(hits) * 100 // sum(anchors))::BIGINT AS match_pct FROM kept WHERE done = 0 GROUP BY issn, bucket")
def year_bucket_audit(s: Spark, d: str) -> DataFrame:
    return catalogue.audit_buckets(view(s, d, "issues"))


@query(
    duck("issues")
    + """, r AS (SELECT issn, year, issue, row_number() OVER w AS n, sum(anchors) OVER (w ROWS 4 PRECEDING) AS a, sum(hits) OVER (w ROWS 4 PRECEDING) AS h FROM issues WINDOW w AS (PARTITION BY issn ORDER BY year, issue)),
k AS (SELECT *, CASE WHEN n >= 5 AND a > 0 THEN (h * 100 >= 95 * a)::INT END AS ok FROM r), f AS (SELECT *, CASE WHEN ok IS NOT NULL THEN min(ok) OVER (PARTITION BY issn ORDER BY year, issue ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS rest FROM k),
g AS (SELECT issn, min(ok) AS lo, max(ok) AS hi, min(CASE WHEN rest = 1 THEN year END) AS y, min(CASE WHEN ok IS NOT NULL THEN year END) AS y0 FROM f GROUP BY issn),
z AS (SELECT *, CASE WHEN lo IS NULL THEN 'no_data' WHEN lo = 1 THEN 'always_clean' WHEN hi = 0 THEN 'never_clean' WHEN y IS NOT NULL THEN 'transitioned' ELSE 'mixed_unstable' END AS status FROM g)
SELECT issn, status, CASE status WHEN 'always_clean' THEN y0 WHEN 'transitioned' THEN y END AS year FROM z"""
)
def transitions(s: Spark, d: str) -> DataFrame:
    return catalogue.transitions(view(s, d, "issues"))


@query(
    duck("issues")
    + """, j AS (SELECT coalesce(publisher, '?') AS publisher, (sum(hits) * 100 // sum(anchors))::DOUBLE AS pct FROM issues JOIN pubs USING (issn) GROUP BY issn, publisher),
g AS (SELECT publisher, count(*) AS n, median(pct) AS median_pct, min(pct) AS min_pct, max(pct) AS max_pct, list_sort(list(pct)) AS v FROM j GROUP BY publisher),
q AS (SELECT *, CASE WHEN n >= 4 THEN v[floor((n + 1) / 4)::INT] + ((n + 1) / 4 - floor((n + 1) / 4)) * (v[floor((n + 1) / 4)::INT + 1] - v[floor((n + 1) / 4)::INT]) ELSE min_pct END AS q1_pct FROM g)
SELECT publisher, n, median_pct, q1_pct, min_pct, max_pct, n >= 3 AND median_pct >= 95 AND q1_pct >= 80 AS trusted FROM q"""
)
def publisher_trust(s: Spark, d: str) -> DataFrame:
    j = view(s, d, "issues").join(table(s, d, "pubs"), "issn").groupBy("issn", F.coalesce("publisher", F.lit("?")).alias("publisher")).agg(F.floor(F.sum("hits") * 100 / F.sum("anchors")).cast("double").alias("pct"))
    return catalogue.publisher_trust(j)


_MISS = f"""m AS (SELECT anchor_id, issn, regexp_extract(volume, '([0-9]+)', 1) AS volume, regexp_extract(issue, '([0-9]+)', 1) AS issue, {_NT.format(_tokens('article_title'))} AS t FROM ill_anchors WHERE issn IS NOT NULL AND article_title IS NOT NULL),
w AS (SELECT DISTINCT issn AS w_issn, regexp_extract(volume, '([0-9]+)', 1) AS w_volume, regexp_extract(issue, '([0-9]+)', 1) AS w_issue, {_NT.format(_tokens('title'))} AS t FROM toc_entries)"""


@query("WITH " + _MISS + " , j AS (SELECT anchor_id, max(CASE WHEN w_issn IS NOT NULL THEN 1 ELSE 0 END) AS a, max(CASE WHEN issn = w_issn THEN 1 ELSE 0 END) AS s, max(CASE WHEN issn = w_issn AND volume = w_volume AND issue = w_issue THEN 1 ELSE 0 END) AS i FROM m LEFT JOIN w USING (t) GROUP BY anchor_id) SELECT anchor_id, CASE WHEN a = 0 THEN 'A' WHEN s = 0 THEN 'C' WHEN i = 1 THEN 'D' ELSE 'B' END AS cause FROM j")
def miss_diagnosis(s: Spark, d: str) -> DataFrame:
    n = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    m = table(s, d, "ill_anchors").where("issn IS NOT NULL AND article_title IS NOT NULL").select("anchor_id", "issn", n("volume").alias("volume"), n("issue").alias("issue"), text.normalize_title(F.col("article_title")).alias("t"))
    w = table(s, d, "toc_entries").select(F.col("issn").alias("w_issn"), n("volume").alias("w_volume"), n("issue").alias("w_issue"), text.normalize_title(F.col("title")).alias("t")).distinct()
    return catalogue.miss_diagnosis(m, w)


@query("WITH " + _MISS + " SELECT anchor_id FROM m WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.w_issn = m.issn AND w.t = m.t)")
def miss_anti_join(s: Spark, d: str) -> DataFrame:
    m = table(s, d, "ill_anchors").select("anchor_id", "issn", text.normalize_title(F.col("article_title")).alias("t"))
    return catalogue.not_in_contents(m, table(s, d, "toc_entries").select("issn", text.normalize_title(F.col("title")).alias("t")))


@query("SELECT o_orderkey, o_custkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def enrich_sources(s: Spark, d: str) -> DataFrame:
    t = lambda name, key, cols: table(s, d, name).select(F.col(key).cast("string").alias("k"), *cols)
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("k"))
    a = TableProvider(t("customer", "c_custkey", ["c_name", "c_nationkey"]), "k", "a").enrich(o)
    b = TableProvider(t("nation", "n_nationkey", ["n_name", "n_regionkey"]), "k", "b").enrich(a.withColumn("k", F.col("a_c_nationkey").cast("string")))
    c = enrich_all(b.withColumn("k", F.col("b_n_regionkey").cast("string")), [TableProvider(t("region", "r_regionkey", ["r_name"]), "k", "c")])
    return c.select("o_orderkey", "o_custkey", F.col("a_c_name").alias("c_name"), F.col("b_n_name").alias("n_name"), F.col("c_r_name").alias("r_name"))


@query("WITH n AS (SELECT issn, count(DISTINCT concat(coalesce(volume, ''), chr(1), coalesce(issue, ''))) AS n FROM ill_anchors WHERE issn IS NOT NULL GROUP BY issn) SELECT 'issues' AS what, sum(n)::DOUBLE AS value FROM n UNION ALL SELECT 'journals', count(*) FROM n UNION ALL SELECT 'most', max(n) FROM n UNION ALL SELECT 'median', median(n) FROM n UNION ALL SELECT 'mean', round(avg(n), 6) FROM n UNION ALL SELECT 'top', (SELECT sum(n) FROM (SELECT n FROM n ORDER BY n DESC, issn LIMIT 10))")
def distinct_issue_sizes(s: Spark, d: str) -> DataFrame:
    return catalogue.issue_sizes(table(s, d, "ill_anchors"))


@query("SELECT (yr // 10 * 10)::INT AS decade, count(*) AS entries, count(doi) AS with_doi, (count(doi) * 100 // count(*))::BIGINT AS pct FROM toc_entries WHERE yr IS NOT NULL GROUP BY 1")
def decade_coverage(s: Spark, d: str) -> DataFrame:
    return catalogue.decade_coverage(table(s, d, "toc_entries"))


# ---------------------------------------------------------------- lookup

_CAND = duck("items") + """, r AS (SELECT request_id, issn, trim(vol) AS vol, trim(iss) AS iss, trim(yr) AS yr FROM lookup_requests),
t AS (SELECT request_id, item, 1 AS tier FROM r JOIN items USING (issn, vol, iss) WHERE vol <> '' AND iss <> '' UNION ALL SELECT request_id, item, 2 FROM r JOIN items USING (issn, vol) WHERE vol <> '' UNION ALL SELECT request_id, item, 3 FROM r JOIN items USING (issn, yr) WHERE r.yr <> ''),
b AS (SELECT request_id, item, min(tier) AS tier FROM t GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY request_id, tier ORDER BY item)::INT AS rank FROM b QUALIFY rank <= 4) """


def _candidates(s: Spark, d: str) -> DataFrame:
    return lookup.candidates(table(s, d, "lookup_requests"), view(s, d, "items"))


@query(_CAND + "SELECT request_id, item, tier, rank FROM c")
def lookup_candidates(s: Spark, d: str) -> DataFrame:
    return _candidates(s, d)


@query("SELECT journal_title AS title, identifier AS slug FROM (SELECT journal_title, identifier, count(*) AS n FROM ill_anchors WHERE journal_title IS NOT NULL AND identifier IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY journal_title ORDER BY n DESC, identifier) = 1")
def title_slugs(s: Spark, d: str) -> DataFrame:
    return lookup.most_frequent_slug(table(s, d, "ill_anchors").select(F.col("journal_title").alias("title"), F.col("identifier").alias("slug")))


# ---------------------------------------------------------------- sinks, resumption, streams

@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti_join(s: Spark, d: str) -> DataFrame:
    done = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalogue.not_done(table(s, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query()
def toc_documents(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries")
    head = e.groupBy("item").agg(F.min("issn").alias("issn"), F.lit(2).alias("schema_version"))
    return sinks.toc_documents(head, e.select("item", "ord", "entry_id", "title", "start_page_index", "end_page_index"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def arrival_stream(s: Spark, d: str) -> DataFrame:
    """All of the events through a stream of files that ends when it has read them, each batch counted before it is written to
    the shared folder; what the stream wrote is read back into a table of its own and removed."""
    stream = arrivals.arrived(s, f"{d}/events.parquet*", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(s, d, "events").schema), _day_counts, "arrivals")
    return stream.groupBy("start", "event_type").agg(F.sum("n").alias("n"))


def _day_counts(batch: DataFrame) -> DataFrame:
    return batch.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY ALL")
def windowed_requests(s: Spark, d: str) -> DataFrame:
    """Requests by day and kind, counted by the streaming operator over a bounded table."""
    e = table(s, d, "events")
    return arrivals.request_counts(e, late="36500 days").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# ---------------------------------------------------------------- placement


_WORDS3 = lambda c: _tokens(c, text.STOP_PLACE, 3)


@query(
    f"""WITH a AS (SELECT item, block_id AS article_id, page_no AS hint, list_distinct({_WORDS3('text')}) AS tw FROM layout_blocks WHERE label = 'title' AND text IS NOT NULL AND item IS NOT NULL),
b AS (SELECT item, block_id, page_no, label IN ('section_header', 'title', 'paragraph_header') AS head, list_distinct({_WORDS3('text')}) AS bw FROM layout_blocks WHERE text IS NOT NULL AND page_no IS NOT NULL),
m AS (SELECT a.item, article_id, block_id, hint, page_no, coalesce(head, false) AS head, len(list_intersect(tw, bw)) AS sh, len(tw) AS nt, len(bw) AS nb FROM a JOIN b USING (item) WHERE list_has_any(tw, bw)),
g AS (SELECT *, round(sh::DOUBLE / nt * CASE WHEN head THEN 1.5 ELSE 1.0 END * (0.5 + 0.5 * (sh::DOUBLE / nb)) - coalesce(abs(page_no - hint), 0) * 0.001, 6) AS score FROM m WHERE sh::DOUBLE / nt >= 0.5 AND (head OR sh::DOUBLE / nb >= 0.5))
SELECT item, article_id, page_no AS page, score FROM g QUALIFY row_number() OVER (PARTITION BY item, article_id ORDER BY score DESC, block_id) = 1"""
)
def title_places(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "layout_blocks")
    a = b.where("label = 'title' AND text IS NOT NULL AND item IS NOT NULL").select("item", F.col("block_id").alias("article_id"), F.col("text").alias("title"), F.col("page_no").alias("hint"))
    return placement.title_places(a, b.withColumn("label", F.coalesce("label", F.lit(""))))


_ARTICLES = "(SELECT o_orderkey AS item, o_custkey AS article_id, CAST(1 + o_custkey % 4 AS VARCHAR) AS first_page, CAST(1 + o_custkey % 4 + o_orderkey % 3 AS VARCHAR) AS last_page FROM orders)"


@query(
    duck("leaves")
    + _BR
    + f""", m AS (SELECT item, label, arg_min(br, leaf) AS page FROM br WHERE br IS NOT NULL AND label IS NOT NULL GROUP BY item, label)
SELECT a.item, article_id, s.page AS start, CASE WHEN s.page IS NOT NULL AND e.page >= s.page THEN e.page ELSE s.page + CASE WHEN last_page::INT >= first_page::INT THEN last_page::INT - first_page::INT ELSE 0 END END AS stop,
CASE WHEN s.page IS NOT NULL AND e.page >= s.page THEN 'page_map' WHEN s.page IS NOT NULL THEN 'partial' ELSE 'failed' END AS method
FROM {_ARTICLES} a LEFT JOIN m s ON s.item = a.item AND s.label = first_page LEFT JOIN m e ON e.item = a.item AND e.label = last_page"""
)
def place_articles(s: Spark, d: str) -> DataFrame:
    o = table(s, d, "orders")
    first = 1 + F.col("o_custkey") % 4
    a = o.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("article_id"), first.cast("string").alias("first_page"), (first + F.col("o_orderkey") % 3).cast("string").alias("last_page"))
    m = pagination.printed_to_page(view(s, d, "leaves")).withColumnRenamed("br", "page")
    return placement.place_articles(a, m)


@query(
    duck("leaves", "heads")
    + _BR
    + """, m AS (SELECT item, label, min(br) AS page, 0 AS r FROM br WHERE br IS NOT NULL AND label IS NOT NULL GROUP BY item, label UNION ALL SELECT item, CAST(first_page AS VARCHAR), min(leaf), 1 FROM heads GROUP BY 1, 2)
SELECT item, label, page FROM m QUALIFY row_number() OVER (PARTITION BY item, label ORDER BY r, page) = 1"""
)
def overlay_maps(s: Spark, d: str) -> DataFrame:
    own = pagination.page_to_printed(view(s, d, "leaves")).withColumnRenamed("br", "page")
    return placement.overlay_maps(own, view(s, d, "heads").select("item", F.col("first_page").alias("label"), F.col("leaf").alias("page")))


@query("""WITH x AS (SELECT item, max(greatest(start_page_index, end_page_index)) AS m FROM toc_entries GROUP BY item), s AS (SELECT DISTINCT item, start_page_index AS start FROM toc_entries WHERE start_page_index IS NOT NULL AND item IS NOT NULL),
n AS (SELECT *, lead(start) OVER (PARTITION BY item ORDER BY start) AS nxt FROM s)
SELECT e.item, entry_id, start, greatest(start, coalesce(nxt - CASE WHEN entry_type = 'section' THEN 0 ELSE 1 END, m))::INT AS stop FROM toc_entries e JOIN n ON n.item = e.item AND n.start = e.start_page_index JOIN x ON x.item = e.item""")
def ends_before_next(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries")
    last = e.groupBy("item").agg(F.max(F.greatest("start_page_index", "end_page_index")).alias("m"))
    return placement.ends_before_next(e.withColumn("start", F.col("start_page_index")).join(last, "item"), "m", F.col("entry_type") == "section")


@query("""WITH e AS (SELECT item, entry_id, start_page_index AS s, end_page_index AS t FROM toc_entries WHERE start_page_index BETWEEN 0 AND end_page_index), f AS (SELECT DISTINCT item, start_page_index AS p FROM toc_entries WHERE start_page_index IS NOT NULL)
SELECT e.item, entry_id, any_value(s) AS start, coalesce(max(p), any_value(s)) AS stop FROM e LEFT JOIN f ON f.item = e.item AND p BETWEEN s AND t GROUP BY e.item, entry_id""")
def trim_blank_ends(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries")
    spans = e.where("start_page_index BETWEEN 0 AND end_page_index").select("item", "entry_id", F.col("start_page_index").alias("start"), F.col("end_page_index").alias("stop"))
    return placement.trim_blank_ends(spans, e.where("start_page_index IS NOT NULL").select("item", F.col("start_page_index").alias("page")))


@query("""WITH h AS (SELECT item, start_page_number AS printed, min(start_page_index) AS t FROM toc_entries WHERE start_page_number > 0 AND entry_type = 'article' GROUP BY 1, 2), k AS (SELECT item, start_page_index AS s, count(DISTINCT lower(title)) AS k FROM toc_entries WHERE start_page_index IS NOT NULL GROUP BY 1, 2)
SELECT e.item, entry_id, CASE WHEN k > 1 AND t <> s THEN t ELSE s END AS start, CASE WHEN k > 1 AND t <> s THEN t + end_page_index - s ELSE end_page_index END AS stop, coalesce(k > 1 AND t <> s, false) AS moved
FROM toc_entries e JOIN k ON k.item = e.item AND k.s = e.start_page_index LEFT JOIN h ON h.item = e.item AND h.printed = e.start_page_number""")
def relocate_shared_starts(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries").where("start_page_index IS NOT NULL").select("item", "entry_id", "title", F.col("start_page_index").alias("start"), F.col("end_page_index").alias("stop"), F.col("start_page_number").alias("printed"))
    h = table(s, d, "toc_entries").where("start_page_number > 0 AND entry_type = 'article'").select("item", F.col("start_page_number").alias("printed"), F.col("start_page_index").alias("page"))
    return placement.relocate_shared_starts(e, h)


@query(duck("leaves", "heads") + _BR + ", a AS (SELECT item, label, arg_min(br, leaf) AS x FROM br WHERE br IS NOT NULL AND label IS NOT NULL GROUP BY item, label), b AS (SELECT item, CAST(leaf AS VARCHAR) AS label, min(first_page) AS y FROM heads GROUP BY 1, 2) SELECT x - y AS delta, count(*) AS n FROM a JOIN b USING (item, label) GROUP BY 1")
def map_agreement(s: Spark, d: str) -> DataFrame:
    a = pagination.printed_to_page(view(s, d, "leaves")).withColumnRenamed("br", "page")
    b = view(s, d, "heads").groupBy("item", F.col("leaf").cast("string").alias("label")).agg(F.min("first_page").alias("page"))
    return placement.map_agreement(a, b)


_WORDS = "(SELECT l_orderkey AS item, CAST(l_suppkey % 2 AS INT) AS page, CAST(l_partkey % 500 AS INT) AS x1, CAST(l_suppkey * 37 % 1000 AS INT) AS y1, CAST(l_suppkey * 37 % 1000 + 10 + l_linenumber % 4 * 8 AS INT) AS y2, concat(l_linestatus, l_linenumber) AS text FROM lineitem)"
def _lines_sql(words: str) -> str:
    return f"""lw AS (SELECT *, CASE WHEN y1 - lag(y1) OVER z > 25 THEN 1 ELSE 0 END AS b FROM {words} WINDOW z AS (PARTITION BY item, page ORDER BY y1, x1, text)),
lr AS (SELECT *, sum(b) OVER (PARTITION BY item, page ORDER BY y1, x1, text ROWS UNBOUNDED PRECEDING) AS line FROM lw),
l AS (SELECT item, page, line::BIGINT AS line, round(avg(y1), 6) AS y, round(avg(y2 - y1), 6) AS height, string_agg(text, ' ' ORDER BY x1, y1, text) AS text FROM lr GROUP BY item, page, line)"""


def _words(s: Spark, d: str) -> DataFrame:
    y = F.col("l_suppkey") * 37 % 1000
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 2).cast("int").alias("page"), (F.col("l_partkey") % 500).cast("int").alias("x1"), y.cast("int").alias("y1"), (y + 10 + F.col("l_linenumber") % 4 * 8).cast("int").alias("y2"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("text"))


@query("WITH " + _lines_sql(_WORDS) + " SELECT item, page, line, y, height, text FROM l")
def text_lines(s: Spark, d: str) -> DataFrame:
    return placement.text_lines(_words(s, d))


@query(
    f"""WITH v AS (SELECT *, median(CASE WHEN y2 > y1 THEN y2 - y1 END) OVER (PARTITION BY item, page) AS m, floor(max(y2) OVER (PARTITION BY item, page) / 2) AS h FROM {_WORDS}), up AS (SELECT * FROM v WHERE y1 <= h), {_lines_sql("up")},
g AS (SELECT l.*, height >= 1.6 * m AS big FROM l JOIN (SELECT DISTINCT item, page, m FROM v) USING (item, page)),
k AS (SELECT *, CASE WHEN big AND NOT (coalesce(lag(big) OVER w, false) AND y - lag(y) OVER w <= 150) THEN 1 ELSE 0 END AS b FROM g WINDOW w AS (PARTITION BY item, page ORDER BY y, line)),
q AS (SELECT *, sum(b) OVER (PARTITION BY item, page ORDER BY y, line ROWS UNBOUNDED PRECEDING) AS r FROM k),
t AS (SELECT item, page, r, min(y) AS y, round(avg(height), 6) AS height, string_agg(text, ' ' ORDER BY y, line) AS text FROM q WHERE big GROUP BY item, page, r)
SELECT item, page, y, height, text FROM t QUALIFY row_number() OVER (PARTITION BY item, page ORDER BY height DESC, y) = 1"""
)
def title_lines(s: Spark, d: str) -> DataFrame:
    return placement.title_lines(_words(s, d))


@query()
def claim_blocks(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "layout_blocks").withColumn("label", F.coalesce("label", F.lit("")))
    t = b.where("label = 'title' AND text IS NOT NULL").select("item", F.col("block_id").alias("title_id"), F.col("text").alias("title"))
    return placement.claim_blocks(t, b)


@query()
def layout_table_rows(s: Spark, d: str) -> DataFrame:
    nodes = nested.flatten_nested(table(s, d, "layouts"), "layout_id", "payload")
    return placement.table_rows(nested.layout_cells(nodes, "layout_id"), "layout_id")


@query(
    f"""SELECT entry_id, array_to_string(list_sort(list_distinct({_tokens('title', text.STOP_EVIDENCE, 3)})), ' ') AS signature, count(*) OVER (PARTITION BY item, array_to_string(list_sort(list_distinct({_tokens('title', text.STOP_EVIDENCE, 3)})), ' ')) AS n FROM toc_entries"""
)
def title_signatures(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries").select("item", "entry_id", text.token_signature(F.col("title")).alias("signature"))
    n = e.groupBy("item", "signature").agg(F.count(F.lit(1)).alias("n"))
    return e.join(n, ["item", "signature"]).select("entry_id", "signature", "n")


@query("SELECT item, entry_id, title FROM toc_entries WHERE item IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item, lower(title) ORDER BY start_page_index NULLS FIRST, entry_id) = 1")
def first_titles(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries").where("item IS NOT NULL").withColumn("t", F.lower("title"))
    return requests.first_wins(e, ["item", "t"], ["start_page_index", "entry_id"]).select("item", "entry_id", "title")


_LT = lambda c: f"list_distinct({_tokens(c, text.STOP_LOOKUP, 4)})"
_ANS = (
    _CAND
    + f""", rq AS (SELECT request_id, {_LT('title')} AS rt, TRY_CAST(regexp_extract(trim(pages), '^([0-9]{{1,9}})', 1) AS BIGINT) AS page FROM lookup_requests), en AS (SELECT item, entry_id, {_LT('title')} AS et, start_page_number AS first_page FROM toc_entries),
aj AS (SELECT c.*, entry_id, coalesce(first_page > 0 AND page = first_page, false) AS onp, coalesce({_overlap('rt', 'et')}, 0.0) AS ov, len(list_intersect(rt, et)) AS sh FROM c JOIN rq USING (request_id) JOIN en USING (item)),
sc AS (SELECT *, floor(100 * ov)::INT + CASE WHEN onp THEN 30 ELSE 0 END AS score FROM aj),
ans AS (SELECT request_id, item, tier, rank, 'contents' AS strategy, least(100, 70 + score // 4 - CASE WHEN coalesce(sh, 0) < 3 AND NOT onp THEN 10 ELSE 0 END)::INT AS confidence, entry_id FROM sc WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY request_id, item ORDER BY score DESC, entry_id) = 1) """
)


@query(_ANS + "SELECT * FROM ans")
def answers_from_contents(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries").select("item", "entry_id", "title", F.col("start_page_number").alias("first_page"), F.col("end_page_number").alias("last_page"))
    return lookup.answers_from_contents(_candidates(s, d), table(s, d, "lookup_requests"), e)


@query("SELECT json_extract_string(props, '$.k')::INT % 10 AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def open_records(s: Spark, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int") % 10
    return table(s, d, "events").groupBy(k.alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_FLAGS = duck("leaves") + _ASSERT + """, sz AS (SELECT item, max(leaf) + 3 AS n_leaves FROM leaves GROUP BY item), said AS (SELECT * FROM c WHERE leaf % 3 <> item % 3),
g AS (SELECT item, count(*) AS asserted, count(*) FILTER (outcome = 'match') AS matches, count(*) FILTER (outcome = 'mismatch') AS mismatches, count(*) FILTER (outcome = 'no_ocr') AS no_ocr, min(leaf) AS lo, max(leaf) AS hi FROM said GROUP BY item),
fl AS (SELECT item, coalesce(asserted, 0) AS asserted, coalesce(matches, 0) AS matches, coalesce(mismatches, 0) AS mismatches, coalesce(no_ocr, 0) AS no_ocr, coalesce(asserted, 0) = 0 AS no_assertions, coalesce(asserted, 0) = 1 AS single_assertion, coalesce(lo * 10 > n_leaves, false) AS missing_start, coalesce(hi * 10 < n_leaves * 9, false) AS missing_end FROM sz LEFT JOIN g USING (item))"""


def _flags(s: Spark, d: str) -> DataFrame:
    sizes = view(s, d, "leaves").groupBy("item").agg((F.max("leaf") + 3).alias("n_leaves"))
    return pagination.assertion_flags(_assertions(s, d).where("leaf % 3 <> item % 3"), sizes)


@query(_FLAGS + " SELECT * FROM fl")
def assertion_flags(s: Spark, d: str) -> DataFrame:
    return _flags(s, d)


@query(_FLAGS + " SELECT centre, operator, count(*) AS n_items, count(*) FILTER (no_assertions) AS n_no_assertions, count(*) FILTER (single_assertion) AS n_single_assertion, count(*) FILTER (missing_start) AS n_missing_start, count(*) FILTER (missing_end) AS n_missing_end, sum(asserted)::BIGINT AS n_asserted, sum(matches)::BIGINT AS n_matches, sum(mismatches)::BIGINT AS n_mismatches, sum(no_ocr)::BIGINT AS n_no_ocr FROM (SELECT *, (item % 5)::INT AS centre, (item % 7)::INT AS operator FROM fl) GROUP BY GROUPING SETS ((centre), (operator))")
def counters_by_centre_and_operator(s: Spark, d: str) -> DataFrame:
    f = _flags(s, d).withColumns({"centre": (F.col("item") % 5).cast("int"), "operator": (F.col("item") % 7).cast("int")})
    return pagination.counters(f, ["centre", "operator"])


@query()
def qa_report_lines(s: Spark, d: str) -> DataFrame:
    e = _flagged(s, d)
    return sinks.markdown_rows(e.where("reason IS NOT NULL").select("item", "entry_id", "title", "reason"))


_FAULT = "CASE WHEN start_page_index IS NULL THEN 'no start' WHEN end_page_index IS NULL THEN 'no end' WHEN end_page_index < start_page_index THEN 'ends before it starts' WHEN title IS NULL OR trim(title) = '' THEN 'no title' WHEN title_match_score < 0.5 THEN 'weak title' END"


def _flagged(s: Spark, d: str) -> DataFrame:
    return table(s, d, "toc_entries").withColumn("reason", F.expr(_FAULT))


@query(f"SELECT reason, count(*) AS entries, count(DISTINCT item) AS items FROM (SELECT item, {_FAULT} AS reason FROM toc_entries) WHERE reason IS NOT NULL GROUP BY ROLLUP (reason)")
def qa_reasons(s: Spark, d: str) -> DataFrame:
    return sinks.reason_summary(_flagged(s, d))
