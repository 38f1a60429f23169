"""The audit of journals: its rows, histograms, extremes and queue; identifiers, hosts, scan logs and cached records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Beginnings of identifiers that are no periodicals
PREPRINTS = ("biorxiv-", "arxiv-", "medrxiv-", "osf-", "ssrn-", "psyarxiv-", "chemrxiv-")
AUDIT = "issn string, anchors_seen bigint, overall_match_pct bigint, year_buckets map<string, struct<issues:bigint,anchors:bigint,hits:bigint>>"


def not_preprint(c: Column) -> Column:
    return ~c.rlike("^(" + "|".join(PREPRINTS) + ")")


def audit_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """(issn, anchors_seen, overall_match_pct, bucket, issues, anchors, hits) of JSON lines of the audit, a row a year bucket.
    Blank and unreadable lines, and journals without buckets, give none."""
    j = lines.select(F.from_json(value, AUDIT).alias("j")).where("j.issn IS NOT NULL")
    return j.select("j.issn", "j.anchors_seen", "j.overall_match_pct", F.explode("j.year_buckets").alias("bucket", "b")).select("issn", "anchors_seen", "overall_match_pct", "bucket", "b.issues", "b.anchors", "b.hits")


def transition_counts(transitions: DataFrame) -> DataFrame:
    """(kind, value, n, pct): journals by status, and transitions by five years of onset; ``pct`` of all of the kind, one digit."""
    status = transitions.select(F.lit("status").alias("kind"), F.col("status").alias("value"))
    years = transitions.where("status = 'transitioned' AND year IS NOT NULL").select(F.lit("year").alias("kind"), F.concat_ws("-", (F.col("year") - F.col("year") % 5).cast("string"), (F.col("year") - F.col("year") % 5 + 4).cast("string")).alias("value"))
    n = status.unionByName(years).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy("kind")), 1))


def extreme_transitions(transitions: DataFrame, most: int = 8) -> DataFrame:
    """(kind, issn, year, pct): the ``most`` earliest and the ``most`` latest transitions, higher percentages first in a year.
    The limits are the feature; each is a top-k, not a sort of all."""
    t = transitions.where("status = 'transitioned' AND year IS NOT NULL").select("issn", "year", "pct")
    first = t.orderBy("year", F.desc("pct"), "issn").limit(most).withColumn("kind", F.lit("earliest"))
    last = t.orderBy(F.desc("year"), F.desc("pct"), "issn").limit(most).withColumn("kind", F.lit("latest"))
    return first.unionByName(last).select("kind", "issn", "year", "pct")


def miss_examples(issues: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` issues (issn, issue, misses, pct) to look at: of the cleanest journals, fewest misses first."""
    return issues.orderBy(F.desc("pct"), "misses", "issn", "issue").limit(most)


def audit_queue(issues: DataFrame, done: DataFrame, least_anchors: int = 30, most: int | None = None) -> DataFrame:
    """(issn, issues, anchors): journals to audit, those with most issues first, with enough anchors, at most ``most``, without
    those ``done`` (the limit comes first, as a round is what it is whether or not it was broken off)."""
    j = issues.groupBy("issn").agg(F.count(F.lit(1)).alias("issues"), F.sum("anchors").alias("anchors")).where(F.col("anchors") >= least_anchors)
    if most is not None:
        j = j.orderBy(F.desc("issues"), "issn").limit(most)
    return j.join(done.select("issn").distinct(), "issn", "left_anti")


def year_matches(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issn", "year").agg(F.sum("anchors").alias("anchors"), F.sum("hits").alias("hits"))


def of_issue(records: DataFrame, volume: Column, issue: Column) -> DataFrame:
    """Records whose volume and issue are exactly these but for blanks at the ends; null is blank."""
    t = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return records.where((t(F.col("volume")) == t(volume)) & (t(F.col("issue")) == t(issue)))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows by the smallest hashes of key and seed: the same on every run and cluster, whatever the partitions."""
    return df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def items_of_clean_journals(anchors: DataFrame, journals: DataFrame, least_pct: int = 95, least_anchors: int = 20, publisher: str = "") -> DataFrame:
    """(item) of anchors (item, issn) in journals (issn, pct, anchors, publisher) that match well and often enough and whose
    publisher has ``publisher`` in it; tables of contents and indexes by their identifiers are left out."""
    good = journals.where((F.col("pct") >= least_pct) & (F.col("anchors") >= least_anchors) & F.coalesce(F.col("publisher"), F.lit("")).contains(publisher))
    return anchors.where(~F.lower("item").rlike("contents|index")).join(good.select("issn"), "issn", "left_semi").select("item").distinct()


def host_centre(centre: Column, host: Column, domain: str = "org") -> Column:
    """Where an item was scanned: the field, else the third label from the right of a host name under ``domain``, else 'unknown'."""
    c, labels = F.lower(F.trim(centre)), F.split(F.lower(F.trim(host)), "[.]")
    third = F.when((F.size(labels) >= 3) & (F.element_at(labels, -1) == domain), F.element_at(labels, -3))
    return F.coalesce(F.when(c != "", c), F.when(F.size(labels) >= 3, third), F.lit("unknown"))


def percent(part: Column, whole: Column) -> Column:
    """'42%', rounded half to even; a dash where there is no whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, "—").otherwise(F.concat(F.bround(100 * part / whole, 0).cast("int").cast("string"), F.lit("%")))


def plain_page(c: Column) -> Column:
    """A page label's letters, digits and underscores in lower case, to compare; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)[^\w]+", "")


def title_key(c: Column) -> Column:
    """A journal's title to look it up by: lower case, without a range of years at the end, letters, digits and single blanks."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s*[0-9]{4}\s*[-–]\s*[0-9]{4}\s*$", "")
    return F.trim(F.regexp_replace(F.translate(t, "äöüáéíóúàèìòùâêîôûñçåø", "aouaeiouaeiouaeiouncao"), r"[^a-z0-9]+", " "))


def scan_operators(scans: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, n, email, save_count, active_seconds): the operators in a scan log's user metrics, the longest at work first.

    Each child of userMetrics is an operator; one without an address, or a count that is missing or no number, is left out or 0.
    Fields are found inside the child's own text, so a missing one shifts no other's. Null logs give none."""
    block = F.regexp_extract(F.col(xml), r"(?s)<userMetrics>(.*?)</userMetrics>", 1)
    child = F.explode(F.regexp_extract_all(block, F.lit(r"(?s)<([A-Za-z][\w.-]*)>\s*(<.*?)</\1>"), F.lit(2)))
    field = lambda name: F.trim(F.regexp_extract("c", rf"(?s)<{name}>(.*?)</{name}>", 1))
    count = lambda name: F.coalesce(field(name).try_cast("int"), F.lit(0))
    rows = scans.select(key, child.alias("c")).select(key, field("user").alias("email"), count("saveCount").alias("save_count"), count("activeTime").alias("active_seconds")).where("email <> ''")
    return rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("active_seconds"), "email"))).select(key, "n", "email", "save_count", "active_seconds")


def slim_release(c: Column) -> Column:
    """The parts of a bibliographic record's JSON that are kept: identifiers, stage and files; null without an id."""
    schema = "id string, work_id string, container_id string, release_stage string, _files array<struct<id:string,sha1:string,size_bytes:bigint,size:bigint,urls:array<struct<url:string,rel:string>>>>"
    r = F.from_json(c, schema)
    files = F.transform(F.coalesce(r["_files"], F.array().cast("array<struct<id:string,sha1:string,size_bytes:bigint,size:bigint,urls:array<struct<url:string,rel:string>>>>")), lambda f: F.struct(f["id"].alias("ident"), f["sha1"].alias("sha1"), F.coalesce(f["size_bytes"], f["size"]).alias("size"), F.transform(f["urls"], lambda u: u["url"]).alias("urls")))
    return F.when(F.coalesce(r["id"], F.lit("")) != "", F.struct(r["id"].alias("release_ident"), r["work_id"].alias("work_ident"), r["container_id"].alias("container_ident"), r["release_stage"].alias("release_stage"), files.alias("files")))


def author_names(c: Column) -> Column:
    """Names of a JSON list of authors, each an object with a name or the name itself; nulls and blanks left out."""
    v = F.from_json(c, "array<string>")
    name = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)
    return F.coalesce(F.filter(F.transform(v, name), lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def entries_in_order(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(item, n, title, start, stop): model entries (item, entry_id, page from 1, title) as contents: one per page and title
    whatever its case, down the pages, from 0, each to the page before the next; the last to the item's end (``sizes``: item,
    n_leaves)."""
    once = F.row_number().over(W.partitionBy("item", "page", F.lower(F.coalesce("title", F.lit("")))).orderBy("entry_id"))
    f = found.where("page IS NOT NULL").withColumn("_k", once).where("_k = 1")
    down = W.partitionBy("item").orderBy("page", "entry_id")
    f = f.withColumn("n", F.row_number().over(down)).withColumn("_next", F.lead("page").over(down)).join(sizes, "item", "left")
    start = F.col("page") - 1
    stop = F.greatest(start, F.coalesce(F.col("_next") - 2, F.col("n_leaves") - 1, start))
    return f.select("item", "n", F.coalesce("title", F.lit("")).alias("title"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def in_print_order(entries: DataFrame) -> DataFrame:
    """(item, n, entry_id): an item's entries by start page, 0 and unknown ones last, then by printed page."""
    order = W.partitionBy("item").orderBy(F.when(F.coalesce("start", F.lit(0)) == 0, 9999).otherwise(F.col("start")), F.coalesce("printed", F.lit(0)), "entry_id")
    return entries.select("item", F.row_number().over(order).alias("n"), "entry_id")


def either_ranges(new: Column, old: Column) -> Column:
    """A record's page ranges under their new name, else under the old one, else none."""
    none = F.array().cast("array<array<string>>")
    return F.when(F.size(F.coalesce(new, none)) > 0, new).when(F.size(F.coalesce(old, none)) > 0, old).otherwise(none)


def shortened(c: Column, n: int = 60) -> Column:
    """A text of at most ``n`` characters, ended by an ellipsis where it was longer; '' for null."""
    t = F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…")))


def item_records(assertions: DataFrame) -> DataFrame:
    """(item, assertions, leaf_pages): one compact record an item: how many leaves carry an assertion, and their pages as JSON
    by leaf. An item has as many as it has leaves."""
    g = assertions.groupBy("item").agg(F.count("asserted").alias("assertions"), F.array_sort(F.collect_list(F.when(F.col("asserted").isNotNull(), F.struct(F.col("leaf").cast("string").alias("leaf"), "asserted")))).alias("p"))
    return g.select("item", "assertions", F.to_json(F.map_from_entries("p")).alias("leaf_pages"))


def with_version(df: DataFrame, name: str, version: str, schema: int = 2) -> DataFrame:
    """Rows with the block that says what made them."""
    return df.withColumn("made_by", F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(schema).alias("schema_version")))
