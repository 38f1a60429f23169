"""Queries of the audit of journals and of contents against known articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession as Spark, functions as F

from foliant.functions import text
from foliant.operators import audit as au, catalogue, evaluation as ev, scoring
from foliant.plans.adapters import duck, view
from foliant.plans.reference import _overlap, _tokens
from foliant.plans.registry import registry
from foliant.session import table

QUERIES, SQL, query = registry()

# ---------------------------------------------------------------- contents against known articles

_NT = lambda c, stop=text.STOP_TITLE, least=1: f"array_to_string({_tokens(c, stop, least)}, ' ')"
_SIM = lambda a, b: f"(CASE WHEN {_NT(a)} = '' OR {_NT(b)} = '' THEN 0.0 WHEN {_NT(a)} = {_NT(b)} THEN 1.0 WHEN contains({_NT(a)}, {_NT(b)}) OR contains({_NT(b)}, {_NT(a)}) THEN 0.95 ELSE {_overlap(_tokens(a), _tokens(b))} END)"
_SHARE = lambda a, b: f"len(list_intersect({_tokens(a)}, {_tokens(b)})) > 0"


@query(f"SELECT anchor_id FROM ill_anchors WHERE {_NT('article_title')} <> '' AND {_NT('journal_title')} <> '' AND (contains({_NT('article_title')}, {_NT('journal_title')}) OR contains({_NT('journal_title')}, {_NT('article_title')})) UNION ALL SELECT -anchor_id FROM ill_anchors WHERE {_NT('journal_title', text.STOP_AUDIT, 2)} <> '' AND anchor_id % 5 = 0")
def junk_titles(s: Spark, d: str) -> DataFrame:
    """Anchors whose title is only the journal's; a fifth of them once more with the journal's title in place of their own."""
    a = table(s, d, "ill_anchors")
    own = a.where(ev.junk_title(F.col("article_title"), F.col("journal_title"), use_ratio=False)).select("anchor_id")
    swapped = a.where("anchor_id % 5 = 0").where(ev.junk_title(F.upper("journal_title"), F.col("journal_title"), text.STOP_AUDIT, 2, use_ratio=False)).select((-F.col("anchor_id")).alias("anchor_id"))
    return own.unionByName(swapped)


_FW = lambda c: _tokens(c, text.STOP_AUDIT, 2)


@query(
    f"""WITH j AS (SELECT a.anchor_id, e.entry_id, {_FW('a.article_title')} AS x, {_FW('e.title')} AS y FROM ill_anchors a JOIN toc_entries e ON a.issn = e.issn AND regexp_extract(a.volume, '([0-9]+)', 1) = regexp_extract(e.volume, '([0-9]+)', 1) AND a.anchor_id % 3 = 0),
k AS (SELECT *, least(4, len(x), len(y)) AS k FROM j) SELECT anchor_id, entry_id FROM k WHERE len(x) > 0 AND len(y) > 0 AND (((len(x) = 1 OR len(y) = 1) AND x[1] = y[1]) OR (k >= 2 AND x[1:k] = y[1:k]))"""
)
def first_words_pairs(s: Spark, d: str) -> DataFrame:
    n = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    a = table(s, d, "ill_anchors").where("anchor_id % 3 = 0").select("anchor_id", "issn", n("volume").alias("v"), "article_title")
    e = table(s, d, "toc_entries").select("entry_id", "issn", n("volume").alias("v"), "title")
    return a.join(e, ["issn", "v"]).where(ev.first_words_match(F.col("article_title"), F.col("title"), use_ratio=False)).select("anchor_id", "entry_id")


@query(
    r"""WITH p AS (SELECT anchor_id, unnest(regexp_split_to_array(article_author, '[;,&]| and ')) AS p FROM ill_anchors WHERE article_author IS NOT NULL),
w AS (SELECT anchor_id, p, list_filter(list_transform(regexp_split_to_array(trim(p), '\s+'), lambda x: regexp_replace(x, '^\.+|\.+$', '', 'g')), lambda x: length(x) >= 3 AND regexp_full_match(x, '\p{L}+')) AS ws FROM p),
m AS (SELECT anchor_id, list_max(list_transform(ws, lambda x: length(x))) AS n, ws FROM w WHERE len(ws) > 0)
SELECT anchor_id, array_to_string(list_sort(list_distinct(list(lower(list_filter(ws, lambda x: length(x) = n)[1])))), ' ') AS names FROM m GROUP BY anchor_id"""
)
def longest_words(s: Spark, d: str) -> DataFrame:
    a = table(s, d, "ill_anchors").where("article_author IS NOT NULL").select("anchor_id", ev.longest_words(F.col("article_author")).alias("n"))
    return a.where("size(n) > 0").select("anchor_id", F.array_join("n", " ").alias("names"))


_PAIRS = duck("known", "listed") + f""", jp AS (SELECT anchor_id, item, entry_id, ord, a_start, a_end, e_start, e_end, coalesce(a_start = e_start AND a_end = e_end, false) AS same, coalesce(abs(a_start - e_start) <= 1 AND abs(a_end - e_end) <= 1, false) AS close, {_overlap(_tokens('title'), _tokens('e_title'))} >= 0.6 AS hit FROM known JOIN listed USING (item)),
cm AS (SELECT anchor_id, item, CASE WHEN same THEN 'exact' WHEN close THEN 'soft' WHEN hit THEN 'title_only' ELSE 'miss' END AS match, CASE WHEN same OR close OR hit THEN entry_id END AS entry_id, ord FROM jp QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY CASE WHEN same THEN 1 WHEN close THEN 2 WHEN hit THEN 3 ELSE 4 END, ord, entry_id) = 1)"""


def _cutoff(s: Spark, d: str, shift: int = 0) -> DataFrame:
    listed = view(s, d, "listed")
    if shift:
        listed = listed.withColumn("e_start", F.col("e_start") + shift)
    known = view(s, d, "known")
    return ev.cutoff_matches(scoring.judged_pairs(known, listed)).join(known.select("anchor_id", "item"), "anchor_id")


@query(_PAIRS + " SELECT anchor_id, match, entry_id FROM cm")
def cutoff_matches(s: Spark, d: str) -> DataFrame:
    return _cutoff(s, d).select("anchor_id", "match", "entry_id")


_BOTH = _PAIRS + f""", jp2 AS (SELECT anchor_id, item, ord, entry_id, coalesce(a_start = e_start + 1 AND a_end = e_end, false) AS same, coalesce(abs(a_start - e_start - 1) <= 1 AND abs(a_end - e_end) <= 1, false) AS close, hit FROM jp),
cm2 AS (SELECT anchor_id, item, CASE WHEN same THEN 'exact' WHEN close THEN 'soft' WHEN hit THEN 'title_only' ELSE 'miss' END AS match FROM jp2 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY CASE WHEN same THEN 1 WHEN close THEN 2 WHEN hit THEN 3 ELSE 4 END, ord, entry_id) = 1),
al AS (SELECT 'heur' AS variant, anchor_id, item, match FROM cm UNION ALL SELECT 'llm', anchor_id, item, match FROM cm2)"""
_BOARD = "count(*) AS n, count(*) FILTER (match = 'exact') AS exact, count(*) FILTER (match = 'soft') AS soft, count(*) FILTER (match = 'title_only') AS title_only, count(*) FILTER (match = 'miss') AS miss"


def _variants(s: Spark, d: str) -> DataFrame:
    """The contents as they are, and with starts one later, as two techniques."""
    return ev.variants(heur=_cutoff(s, d).drop("entry_id"), llm=_cutoff(s, d, 1).drop("entry_id"))


@query(_BOTH + " SELECT variant, anchor_id, match FROM al")
def variant_union(s: Spark, d: str) -> DataFrame:
    return _variants(s, d).select("variant", "anchor_id", "match")


@query(_BOTH + f" SELECT variant, {_BOARD} FROM al GROUP BY variant")
def variant_scoreboard(s: Spark, d: str) -> DataFrame:
    return ev.scoreboards(_variants(s, d))


@query(_BOTH + f" SELECT variant, {_BOARD} FROM al WHERE item IN (SELECT item FROM listed WHERE entry_id % 3 = 0) GROUP BY variant")
def variant_scoreboard_subset(s: Spark, d: str) -> DataFrame:
    return ev.scoreboards(_variants(s, d), view(s, d, "listed").where("entry_id % 3 = 0"))


_STARTS, _STOPS = "list_transform(leaf_ranges, lambda r: r[1])", "list_transform(leaf_ranges, lambda r: r[2])"
_LEAVES = f"(CASE WHEN len(leaf_ranges) > 0 AND len(list_filter({_STARTS}, lambda x: coalesce(regexp_full_match(trim(x), 'n[0-9]{{1,9}}'), false))) = len(leaf_ranges) AND len(list_filter({_STOPS}, lambda x: coalesce(regexp_full_match(trim(x), 'n[0-9]{{1,9}}'), false))) = len(leaf_ranges) THEN 1 END)"


@query(f"SELECT anchor_id, len(leaf_ranges)::INT AS n, regexp_extract(leaf_ranges[1][1], '([0-9]+)', 1)::INT AS start, regexp_extract(leaf_ranges[1][2], '([0-9]+)', 1)::INT AS stop FROM ill_anchors WHERE {_LEAVES} = 1")
def leaf_pairs(s: Spark, d: str) -> DataFrame:
    pick = lambda k: F.transform("leaf_ranges", lambda r: F.get(r, F.lit(k)))
    p = table(s, d, "ill_anchors").select("anchor_id", ev.leaf_pairs(pick(0), pick(1)).alias("p")).where("p IS NOT NULL")
    return p.select("anchor_id", F.size("p").alias("n"), F.col("p")[0]["start"].alias("start"), F.col("p")[0]["stop"].alias("stop"))


_PRED = f"""jk AS (SELECT k.anchor_id, l.entry_id, l.ord, l.e_start AS start, l.e_end AS stop, {_SIM('k.title', 'l.e_title')} AS sim FROM known k JOIN listed l USING (item) WHERE {_SHARE('k.title', 'l.e_title')}),
pt AS (SELECT anchor_id, entry_id, start, stop FROM jk WHERE sim >= 0.55 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY sim DESC, ord NULLS FIRST, entry_id) = 1)"""


def _predicted(s: Spark, d: str) -> DataFrame:
    e = view(s, d, "listed").select("item", "entry_id", "ord", F.col("e_title").alias("title"), F.col("e_start").alias("start"), F.col("e_end").alias("stop"))
    return ev.predict_by_title(view(s, d, "known"), e)


@query(duck("known", "listed") + f", {_PRED} SELECT * FROM pt")
def predict_by_title(s: Spark, d: str) -> DataFrame:
    return _predicted(s, d)


_KM = lambda a, b: f"CASE WHEN {a} IS NULL OR a_start IS NULL THEN 'no_prediction' WHEN {a} = a_start AND {b} = a_end THEN 'exact' WHEN abs({a} - a_start) <= 1 AND abs({b} - a_end) <= 1 THEN 'soft' ELSE 'wrong' END"


@query(
    duck("known", "listed")
    + f""", {_PRED}, pr AS (SELECT k.anchor_id, a_start, a_end, CASE WHEN k.anchor_id % 3 = 0 THEN a_start END AS m1, CASE WHEN k.anchor_id % 3 = 0 THEN a_end + 1 END AS m2, start AS h1, stop AS h2, CASE WHEN k.anchor_id % 2 = 0 THEN start + 4 END AS l1, CASE WHEN k.anchor_id % 2 = 0 THEN stop + 4 END AS l2, pt.anchor_id IS NOT NULL AS got FROM known k LEFT JOIN pt USING (anchor_id)),
lg AS (SELECT 'map' AS path, {_KM('m1', 'm2')} AS kind FROM pr UNION ALL SELECT 'heur', {_KM('h1', 'h2')} FROM pr UNION ALL SELECT 'llm', {_KM('l1', 'l2')} FROM pr
UNION ALL SELECT 'map_then_heur', CASE WHEN anchor_id % 3 = 0 THEN {_KM('m1', 'm2')} ELSE {_KM('h1', 'h2')} END FROM pr UNION ALL SELECT 'map_then_llm', CASE WHEN anchor_id % 3 = 0 THEN {_KM('m1', 'm2')} ELSE {_KM('l1', 'l2')} END FROM pr)
SELECT path, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'soft') AS soft, count(*) FILTER (kind = 'wrong') AS wrong, count(*) FILTER (kind = 'no_prediction') AS no_prediction FROM lg GROUP BY path"""
)
def path_outcomes(s: Spark, d: str) -> DataFrame:
    """A page map that knows a third of the answers, the contents, and contents with pages four off for half of the anchors."""
    j = view(s, d, "known").join(_predicted(s, d), "anchor_id", "left")
    pair = lambda ok, a, b: F.when(ok, F.struct(a.alias("start"), b.alias("stop")))
    third, half, got = F.col("anchor_id") % 3 == 0, F.col("anchor_id") % 2 == 0, F.col("entry_id").isNotNull()
    rows = j.select(F.col("a_start").alias("true_start"), F.col("a_end").alias("true_stop"), pair(third, F.col("a_start"), F.col("a_end") + 1).alias("map"), pair(got, F.col("start"), F.col("stop")).alias("heur"), pair(got & half, F.col("start") + 4, F.col("stop") + 4).alias("llm"))
    return ev.path_outcomes(rows)


_ARTICLES = "art AS (SELECT item, anchor_id AS article_id, title FROM known WHERE anchor_id % 2 = 0)"
_RECALL = duck("known", "listed") + f""", {_ARTICLES}, en AS (SELECT l.item, l.entry_id, l.e_title, t.entry_type FROM listed l JOIN toc_entries t USING (entry_id)),
sj AS (SELECT a.item, a.article_id, e.entry_id, {_SIM('a.title', 'e.e_title')} AS sim FROM art a JOIN en e ON a.item = e.item AND {_SHARE('a.title', 'e.e_title')}), sb AS (SELECT * FROM sj WHERE sim >= 0.6 QUALIFY row_number() OVER (PARTITION BY item, article_id ORDER BY sim DESC, entry_id) = 1),
ex AS (SELECT item, entry_id FROM en WHERE entry_type IN ('article', 'review') AND entry_id NOT IN (SELECT entry_id FROM sb))"""


def _recall(s: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    a = view(s, d, "known").where("anchor_id % 2 = 0").select("item", F.col("anchor_id").alias("article_id"), "title")
    e = view(s, d, "listed").join(table(s, d, "toc_entries").select("entry_id", "entry_type"), "entry_id").select("item", "entry_id", "entry_type", F.col("e_title").alias("title"))
    return ev.list_recall(a, e)


@query(_RECALL + " SELECT item, count(*) AS articles, coalesce((SELECT count(*) FROM sb WHERE sb.item = art.item), 0) AS matched, coalesce((SELECT count(*) FROM ex WHERE ex.item = art.item), 0) AS extras FROM art GROUP BY item")
def list_recall(s: Spark, d: str) -> DataFrame:
    return _recall(s, d)[0]


@query(_RECALL + " SELECT item, entry_id FROM ex")
def list_extras(s: Spark, d: str) -> DataFrame:
    return _recall(s, d)[1]


_ANN = _PAIRS + ", ev AS (SELECT entry_id, count(*) AS n, min(anchor_id) AS first_anchor, max(match) AS last_match FROM cm WHERE entry_id IS NOT NULL GROUP BY entry_id)"


def _annotated(s: Spark, d: str) -> DataFrame:
    hits = _cutoff(s, d).where("entry_id IS NOT NULL").select("entry_id", "anchor_id", "match", F.lit(1).alias("score"))
    return ev.annotated_entries(view(s, d, "listed").select("item", "entry_id"), hits)


@query(_ANN + " SELECT item, entry_id, coalesce(n, 0)::INT AS n, first_anchor FROM listed LEFT JOIN ev USING (entry_id)")
def annotated_entries(s: Spark, d: str) -> DataFrame:
    a = _annotated(s, d)
    return a.select("item", "entry_id", F.size("ill_evidence").alias("n"), F.get("ill_evidence", F.lit(0))["anchor_id"].alias("first_anchor"))


@query(_ANN + " SELECT item, count(*) AS entries, count(n) AS confirmed FROM listed LEFT JOIN ev USING (entry_id) GROUP BY ROLLUP (item)")
def confirmed_entries(s: Spark, d: str) -> DataFrame:
    return ev.confirmed_entries(_annotated(s, d))


@query("SELECT match AS match, count(*) AS n FROM cm GROUP BY 1".join([_PAIRS + " ", ""]))
def match_kinds(s: Spark, d: str) -> DataFrame:
    return ev.status_counts(_cutoff(s, d), "match")


@query("SELECT extract_method AS variant, item, count(*) AS entries, count(start_page_index) AS placed, sum(coalesce(greatest(end_page_index - start_page_index + 1, 0), 0))::BIGINT AS pages FROM toc_entries WHERE extract_method IS NOT NULL AND item IS NOT NULL GROUP BY ROLLUP (extract_method, item)")
def technique_totals(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries").where("extract_method IS NOT NULL AND item IS NOT NULL")
    return ev.technique_totals(e.select(F.col("extract_method").alias("variant"), "item", F.col("start_page_index").alias("start"), F.col("end_page_index").alias("stop")))


# ---------------------------------------------------------------- the audit

_BUCKETS = duck("issues") + ", bk AS (SELECT issn, CASE WHEN year BETWEEN 1900 AND 2030 THEN concat(year - year % 5, '-', year - year % 5 + 4) ELSE 'unknown' END AS bucket, count(*) AS issues, sum(anchors)::BIGINT AS anchors, sum(hits)::BIGINT AS hits FROM issues GROUP BY 1, 2)"


@query(_BUCKETS + ", t AS (SELECT issn, sum(anchors)::BIGINT AS anchors_seen, (sum(hits) * 100 // sum(anchors))::BIGINT AS overall_match_pct FROM bk GROUP BY issn) SELECT * FROM bk JOIN t USING (issn)")
def audit_rows(s: Spark, d: str) -> DataFrame:
    """The audit's JSON lines, made of the anchors, read back, with a blank and a broken line among them."""
    y = F.col("year")
    bucket = F.when(y.between(1900, 2030), F.concat_ws("-", (y - y % 5).cast("string"), (y - y % 5 + 4).cast("string"))).otherwise("unknown")
    b = view(s, d, "issues").groupBy("issn", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("issues"), F.sum("anchors").alias("anchors"), F.sum("hits").alias("hits"))
    j = b.groupBy("issn").agg(F.sum("anchors").alias("anchors_seen"), F.floor(F.sum("hits") * 100 / F.sum("anchors")).alias("overall_match_pct"), F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("issues", "anchors", "hits")))).alias("year_buckets"))
    lines = j.select(F.to_json(F.struct(*j.columns)).alias("value")).unionByName(s.createDataFrame([("",), ("{broken",)], "value string"))
    return au.audit_rows(lines)


# a journal's first year as the one from which it matches, its share of hits as the status
_TQ = duck("issues") + ", tr AS (SELECT issn, min(year) AS year, (sum(hits) * 100 // sum(anchors))::BIGINT AS pct, CASE WHEN pct >= 95 THEN 'always_clean' WHEN pct >= 20 THEN 'transitioned' ELSE 'never_clean' END AS status FROM issues GROUP BY issn)"


def _trans(s: Spark, d: str) -> DataFrame:
    g = view(s, d, "issues").groupBy("issn").agg(F.min("year").alias("year"), F.floor(F.sum("hits") * 100 / F.sum("anchors")).alias("pct"))
    return g.withColumn("status", F.when(F.col("pct") >= 95, "always_clean").when(F.col("pct") >= 20, "transitioned").otherwise("never_clean"))


@query(_TQ + ", v AS (SELECT 'status' AS kind, status AS value FROM tr UNION ALL SELECT 'year', concat(year - year % 5, '-', year - year % 5 + 4) FROM tr WHERE status = 'transitioned' AND year IS NOT NULL), c AS (SELECT kind, value, count(*) AS n FROM v GROUP BY ALL) SELECT *, round(n * 100 / sum(n) OVER (PARTITION BY kind), 1) AS pct FROM c")
def transition_counts(s: Spark, d: str) -> DataFrame:
    return au.transition_counts(_trans(s, d))


@query(_TQ + ", x AS (SELECT issn, year, pct FROM tr WHERE status = 'transitioned') (SELECT 'earliest' AS kind, * FROM x ORDER BY year, pct DESC, issn LIMIT 8) UNION ALL (SELECT 'latest', * FROM x ORDER BY year DESC, pct DESC, issn LIMIT 8)")
def extreme_transitions(s: Spark, d: str) -> DataFrame:
    return au.extreme_transitions(_trans(s, d))


@query(_TQ + " SELECT issn, issue, (anchors - hits)::BIGINT AS misses, pct FROM issues JOIN tr USING (issn) WHERE anchors > hits ORDER BY pct DESC, misses, issn, issue LIMIT 5")
def miss_examples(s: Spark, d: str) -> DataFrame:
    i = view(s, d, "issues").join(_trans(s, d).select("issn", "pct"), "issn").where("anchors > hits")
    return au.miss_examples(i.select("issn", "issue", (F.col("anchors") - F.col("hits")).alias("misses"), "pct"))


@query(duck("issues") + ", q AS (SELECT issn, count(*) AS issues, sum(anchors)::BIGINT AS anchors FROM issues GROUP BY issn HAVING sum(anchors) >= 10 ORDER BY issues DESC, issn LIMIT 100) SELECT * FROM q WHERE issn NOT IN (SELECT issn FROM pubs WHERE sim_pubid IS NULL AND issn IS NOT NULL)")
def audit_queue(s: Spark, d: str) -> DataFrame:
    return au.audit_queue(view(s, d, "issues"), table(s, d, "pubs").where("sim_pubid IS NULL"), 10, 100)


@query(duck("issues") + " SELECT issn, year, sum(anchors)::BIGINT AS anchors, sum(hits)::BIGINT AS hits FROM issues GROUP BY issn, year")
def year_matches(s: Spark, d: str) -> DataFrame:
    return au.year_matches(view(s, d, "issues"))


@query("SELECT a.anchor_id, e.entry_id FROM ill_anchors a JOIN toc_entries e ON a.issn = e.issn WHERE trim(coalesce(e.volume, '')) = trim(coalesce(a.volume, '')) AND trim(coalesce(e.issue, '')) = trim(coalesce(a.issue, ''))")
def same_issue_pairs(s: Spark, d: str) -> DataFrame:
    a = table(s, d, "ill_anchors").select("anchor_id", "issn", F.col("volume").alias("av"), F.col("issue").alias("ai"), F.trim(F.coalesce("volume", F.lit(""))).alias("v"))
    e = table(s, d, "toc_entries").select("entry_id", "issn", "volume", "issue", F.trim(F.coalesce("volume", F.lit(""))).alias("v"))
    return au.of_issue(e.join(a, ["issn", "v"]), F.col("av"), F.col("ai")).select("anchor_id", "entry_id")


@query("SELECT anchor_id FROM ill_anchors ORDER BY md5(concat('7|', CAST(anchor_id AS VARCHAR))), anchor_id LIMIT 50")
def sampled_anchors(s: Spark, d: str) -> DataFrame:
    return au.seeded_sample(table(s, d, "ill_anchors").select("anchor_id"), "anchor_id", 50, 7)


@query(duck("issues") + ", j AS (SELECT issn, sum(hits) * 100 // sum(anchors) AS pct, sum(anchors) AS anchors FROM issues GROUP BY issn) SELECT DISTINCT identifier AS item FROM ill_anchors WHERE NOT regexp_matches(lower(identifier), 'contents|index') AND issn IN (SELECT issn FROM j JOIN pubs USING (issn) WHERE pct >= 10 AND anchors >= 5 AND contains(coalesce(publisher, ''), 'e'))")
def clean_journal_items(s: Spark, d: str) -> DataFrame:
    j = view(s, d, "issues").groupBy("issn").agg(F.floor(F.sum("hits") * 100 / F.sum("anchors")).alias("pct"), F.sum("anchors").alias("anchors")).join(table(s, d, "pubs").select("issn", "publisher"), "issn")
    return au.items_of_clean_journals(table(s, d, "ill_anchors").select(F.col("identifier").alias("item"), "issn"), j, 10, 5, "e")


_PRE = "CASE anchor_id % 5 WHEN 0 THEN concat('arxiv-', identifier) WHEN 1 THEN concat('osf-', identifier) ELSE identifier END"


@query(f"SELECT anchor_id FROM ill_anchors WHERE NOT regexp_matches({_PRE}, '^({'|'.join(au.PREPRINTS)})')")
def without_preprints(s: Spark, d: str) -> DataFrame:
    return table(s, d, "ill_anchors").where(au.not_preprint(F.expr(_PRE))).select("anchor_id")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'cebu' WHEN 1 THEN 'supplier' || s_nationkey WHEN 2 THEN 'unknown' ELSE 'unknown' END AS centre FROM supplier")
def scan_centres(s: Spark, d: str) -> DataFrame:
    """Suppliers as scans: with a field, with a host name, with a short host, with another domain."""
    k = F.col("s_suppkey") % 4
    host = F.when(k == 1, F.concat(F.lit("Scanner1.supplier"), "s_nationkey", F.lit(".scans.org"))).when(k == 2, "localhost").when(k == 3, "a.b.c.net")
    return table(s, d, "supplier").select("s_suppkey", au.host_centre(F.when(k == 0, " Cebu "), host).alias("centre"))


@query("SELECT item, CASE WHEN n = 0 THEN '—' ELSE concat(round_even(100 * k / n, 0)::INT, '%') END AS pct FROM (SELECT item, count(*) FILTER (end_page_index IS NOT NULL) AS n, count(*) FILTER (end_page_index > 50) AS k FROM toc_entries GROUP BY item)")
def percent_texts(s: Spark, d: str) -> DataFrame:
    g = table(s, d, "toc_entries").groupBy("item").agg(F.count("end_page_index").alias("n"), F.count_if(F.col("end_page_index") > 50).alias("k"))
    return g.select("item", au.percent(F.col("k"), F.col("n")).alias("pct"))


@query("SELECT anchor_id, regexp_replace(lower(coalesce(journal_pages, '')), '[^\\p{L}\\p{N}_]+', '', 'g') AS page FROM ill_anchors")
def plain_pages(s: Spark, d: str) -> DataFrame:
    return table(s, d, "ill_anchors").select("anchor_id", au.plain_page(F.col("journal_pages")).alias("page"))


@query(r"SELECT anchor_id, trim(regexp_replace(translate(regexp_replace(lower(coalesce(journal_title || CASE WHEN anchor_id % 2 = 0 THEN ' 1951 - 1968' ELSE '' END, '')), '\s*[0-9]{4}\s*[-–]\s*[0-9]{4}\s*$', ''), 'äöüáéíóúàèìòùâêîôûñçåø', 'aouaeiouaeiouaeiouncao'), '[^a-z0-9]+', ' ', 'g')) AS title FROM ill_anchors")
def journal_title_keys(s: Spark, d: str) -> DataFrame:
    t = F.concat("journal_title", F.when(F.col("anchor_id") % 2 == 0, " 1951 - 1968").otherwise(""))
    return table(s, d, "ill_anchors").select("anchor_id", au.title_key(t).alias("title"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY active_seconds DESC, email)::INT AS n, email, save_count, active_seconds FROM (SELECT o_orderkey, concat('a', o_custkey, '@x.org') AS email, (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 5 END)::INT AS save_count, (o_orderkey % 90)::INT AS active_seconds FROM orders UNION ALL SELECT o_orderkey, concat('b', o_custkey, '@x.org'), 7, 45 FROM orders)")
def scan_operators(s: Spark, d: str) -> DataFrame:
    """Orders as scan logs of two operators, the first without a count in every third."""
    o = table(s, d, "orders")
    user = lambda tag, *parts: F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag}>"))
    v = lambda tag, c: F.concat(F.lit(f"<{tag}> "), c.cast("string"), F.lit(f" </{tag}>"))
    a = user("a_x_org", v("user", F.concat(F.lit("a"), "o_custkey", F.lit("@x.org"))), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(v("saveCount", F.lit(5))), v("activeTime", F.col("o_orderkey") % 90))
    b = user("b_x_org", v("user", F.concat(F.lit("b"), "o_custkey", F.lit("@x.org"))), v("saveCount", F.lit(7)), v("activeTime", F.lit(45)))
    log = F.concat(F.lit("<book><scanLog><userMetrics>"), a, b, F.lit("</userMetrics></scanLog></book>"))
    return au.scan_operators(o.select("o_orderkey", log.alias("xml")), "o_orderkey", "xml")


@query("SELECT p_partkey, concat('r', p_partkey) AS release_ident, p_brand AS work_ident, p_size::BIGINT AS size, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::INT AS files FROM part WHERE p_partkey % 7 <> 0")
def slim_releases(s: Spark, d: str) -> DataFrame:
    """Parts as bibliographic records, every seventh without an identifier, every other with a file."""
    p = table(s, d, "part")
    file = F.struct(F.lit("f").alias("id"), F.lit("00").alias("sha1"), F.col("p_size").alias("size"), F.array(F.struct(F.lit("http://x").alias("url"), F.lit("web").alias("rel"))).alias("urls"))
    rec = F.to_json(F.struct(F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("r"), "p_partkey")).alias("id"), F.col("p_brand").alias("work_id"), F.col("p_size").alias("extra"), F.when(F.col("p_partkey") % 2 == 0, F.array(file)).alias("_files")))
    r = p.select("p_partkey", F.col("p_size").cast("bigint").alias("size"), au.slim_release(rec).alias("r")).where("r IS NOT NULL")
    return r.select("p_partkey", "r.release_ident", "r.work_ident", "size", F.size("r.files").alias("files"))


@query("SELECT entry_id, count(*)::INT AS n, min(name) AS first FROM toc_authors WHERE name IS NOT NULL AND name <> '' GROUP BY entry_id")
def json_author_names(s: Spark, d: str) -> DataFrame:
    """Lists of authors as JSON, objects and plain names mixed."""
    a = table(s, d, "toc_authors").where("name IS NOT NULL AND name <> ''")
    quoted = F.when(F.col("pos") % 2 == 0, F.to_json(F.struct(F.col("name")))).otherwise(F.concat(F.lit('"'), F.regexp_replace("name", '(["\\\\])', "\\\\$1"), F.lit('"')))
    j = a.groupBy("entry_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(quoted), ","), F.lit("]")).alias("j"))
    n = j.select("entry_id", au.author_names(F.col("j")).alias("n"))
    return n.select("entry_id", F.size("n").alias("n"), F.array_min("n").alias("first"))


@query(
    """WITH f AS (SELECT item, entry_id, start_page_index + 1 AS page, title FROM toc_entries WHERE item IS NOT NULL AND start_page_index >= 0), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item, page, lower(coalesce(title, '')) ORDER BY entry_id) = 1),
z AS (SELECT item, max(end_page_index) + 1 AS n_leaves FROM toc_entries GROUP BY item)
SELECT item, row_number() OVER w::INT AS n, coalesce(title, '') AS title, (page - 1)::INT AS start, greatest(page - 1, coalesce(lead(page) OVER w - 2, n_leaves - 1, page - 1))::INT AS stop FROM g LEFT JOIN z USING (item) WINDOW w AS (PARTITION BY item ORDER BY page, entry_id)"""
)
def model_entries_in_order(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "toc_entries")
    z = e.groupBy("item").agg((F.max("end_page_index") + 1).alias("n_leaves"))
    return au.entries_in_order(e.where("item IS NOT NULL AND start_page_index >= 0").select("item", "entry_id", (F.col("start_page_index") + 1).alias("page"), "title"), z)


@query("SELECT item, row_number() OVER (PARTITION BY item ORDER BY CASE WHEN coalesce(start_page_index, 0) = 0 THEN 9999 ELSE start_page_index END, coalesce(start_page_number, 0), entry_id)::INT AS n, entry_id FROM toc_entries WHERE item IS NOT NULL")
def entries_in_print_order(s: Spark, d: str) -> DataFrame:
    return au.in_print_order(table(s, d, "toc_entries").where("item IS NOT NULL").select("item", "entry_id", F.col("start_page_index").alias("start"), F.col("start_page_number").alias("printed")))


@query("SELECT anchor_id, coalesce(len(leaf_ranges), 0)::INT AS n FROM ill_anchors")
def either_ranges(s: Spark, d: str) -> DataFrame:
    a = table(s, d, "ill_anchors")
    return a.select("anchor_id", F.size(au.either_ranges(F.when(F.col("anchor_id") % 2 == 0, F.col("leaf_ranges")), F.col("leaf_ranges"))).alias("n"))


@query(r"SELECT entry_id, CASE WHEN length(t) <= 30 THEN t ELSE concat(rtrim(substr(t, 1, 29)), '…') END AS short FROM (SELECT entry_id, coalesce(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS t FROM toc_entries)")
def shortened_titles(s: Spark, d: str) -> DataFrame:
    return table(s, d, "toc_entries").select("entry_id", au.shortened(F.col("title"), 30).alias("short"))


@query(duck("leaves") + """ SELECT item, count(label) AS assertions, concat('{', coalesce(string_agg(concat('"', leaf, '":"', label, '"'), ',' ORDER BY CAST(leaf AS VARCHAR)) FILTER (label IS NOT NULL), ''), '}') AS leaf_pages FROM leaves GROUP BY item""")
def item_records(s: Spark, d: str) -> DataFrame:
    return au.item_records(view(s, d, "leaves").select("item", "leaf", F.col("label").alias("asserted")))


@query("SELECT identifier, 'foliant' AS name, '2' AS version, 2 AS schema_version FROM pubs")
def version_blocks(s: Spark, d: str) -> DataFrame:
    return au.with_version(table(s, d, "pubs").select("identifier"), "foliant", "2").select("identifier", "made_by.name", "made_by.version", "made_by.schema_version")


@query("SELECT identifier, CASE WHEN length(title) % 3 = 0 OR length(title) % 2 = 0 THEN title ELSE concat('new ', title) END AS body, CASE WHEN length(title) % 2 = 0 THEN CASE WHEN length(title) % 3 = 0 THEN 'timeout' END END AS error FROM pubs WHERE false UNION ALL SELECT identifier, CASE WHEN new_error AND NOT old_error THEN title ELSE concat('new ', title) END, CASE WHEN new_error AND old_error THEN 'timeout' END FROM (SELECT *, length(title) % 2 = 0 AS new_error, length(title) % 3 = 0 AS old_error FROM pubs)")
def refetched_cache(s: Spark, d: str) -> DataFrame:
    """A cache after a refetch in which some answers failed: a good old answer stays where the new one is an error."""
    p, n = table(s, d, "pubs"), F.length("title")
    old = p.select("identifier", F.col("title").alias("body"), F.when(n % 3 == 0, "timeout").alias("error"))
    new = p.select("identifier", F.concat(F.lit("new "), "title").alias("body"), F.when(n % 2 == 0, "timeout").alias("error"))
    return catalogue.upsert_good(old, new, ["identifier"])
