"""Publications and their catalogues, publishers, and the audit of journals against a bibliographic service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions.pages import year_bucket
from foliant.functions.text import normalize_title


def match_publications(pubs: DataFrame, containers: DataFrame) -> DataFrame:
    """(pub_id, container_id, method): the cascade of issn, sim id, unique title, title and publisher; 'title_ambiguous' if
    only the title fits several, 'unmatched' if nothing does. Equi-joins only; publishers agree if one contains the other.

    ``containers``: ident, name, issn, sim_pubid, publisher. The first ident of equals wins. A null never matches.
    """
    p = pubs.select("pub_id", normalize_title(F.col("title")).alias("t"), F.col("issn").alias("p_issn"), F.col("sim_pubid").alias("p_sim"), F.lower("publisher").alias("p_publisher"))
    c = containers.select("ident", normalize_title(F.col("name")).alias("t"), "issn", "sim_pubid", F.lower("publisher").alias("publisher"))
    by = lambda key: c.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ident").alias(f"by_{key}"))
    titles = c.where("t <> ''").groupBy("t").agg(F.min("ident").alias("by_title"), F.count_distinct("ident").alias("n_title"))
    same = p.where("p_publisher IS NOT NULL AND p_publisher <> '' AND t <> ''").join(c.where("publisher IS NOT NULL AND publisher <> ''"), "t")
    agree = same.where(F.col("publisher").contains(F.col("p_publisher")) | F.col("p_publisher").contains(F.col("publisher")))
    both = agree.groupBy("pub_id").agg(F.min("ident").alias("by_both"))
    j = p.join(by("issn"), p["p_issn"] == F.col("issn"), "left").join(by("sim_pubid"), p["p_sim"] == F.col("sim_pubid"), "left").join(titles, "t", "left").join(both, "pub_id", "left")
    one = F.when(F.col("n_title") == 1, F.col("by_title"))
    ident = F.coalesce("by_issn", "by_sim_pubid", one, "by_both")
    method = (
        F.when(F.col("by_issn").isNotNull(), "issn")
        .when(F.col("by_sim_pubid").isNotNull(), "sim_pubid")
        .when(one.isNotNull(), "title")
        .when(F.col("by_both").isNotNull(), "title+publisher")
        .when(F.col("n_title") > 1, "title_ambiguous")
        .otherwise("unmatched")
    )
    return j.select("pub_id", ident.alias("container_id"), method.alias("method"))


def rank_publishers(counts: DataFrame, most: int = 25) -> DataFrame:
    """(publisher, issues, pubs, samples): publishers by issues, with three titles each; the limit is the feature."""
    g = counts.groupBy(F.coalesce("publisher", F.lit("?")).alias("publisher")).agg(F.sum("issue_count").alias("issues"), F.count(F.lit(1)).alias("pubs"), F.min("title").alias("sample"))
    return g.orderBy(F.desc("issues"), "publisher").limit(most)


def tier(pct: Column, anchors: Column) -> Column:
    """clean, near, mid, bad or zero by percentage; unknown under 30 anchors."""
    return F.when(anchors < 30, "unknown").when(pct >= 95, "clean").when(pct >= 80, "near").when(pct >= 50, "mid").when(pct > 0, "bad").otherwise("zero")


def journal_tiers(issues: DataFrame) -> DataFrame:
    """(tier, journals) from issues (issn, anchors, hits); percentages compare as integers."""
    j = issues.groupBy("issn").agg(F.sum("anchors").alias("a"), F.sum("hits").alias("h"))
    return j.groupBy(tier(F.col("h") * 100 / F.col("a"), F.col("a")).alias("tier")).agg(F.count(F.lit(1)).alias("journals"))


def stop_after_misses(issues: DataFrame, misses: int = 3) -> DataFrame:
    """Issues of each (issn, bucket), in order of (year, issue), up to where ``misses`` in a row had no hit. The streak is the
    distance to the last issue with a hit, so no loop is needed."""
    order = W.partitionBy("issn", "bucket").orderBy("year", "issue")
    n = F.row_number().over(order)
    b = issues.withColumn("bucket", year_bucket(F.col("year").cast("string"))).withColumn("_n", n)
    b = b.withColumn("_hit", F.coalesce(F.max(F.when(F.col("hits") > 0, F.col("_n"))).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    b = b.withColumn("_streak", F.col("_n") - F.col("_hit"))
    done = F.coalesce(F.max(F.when(F.col("_streak") >= misses, 1)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("_done", done).where("_done = 0").drop("_n", "_hit", "_streak", "_done")


def audit_buckets(issues: DataFrame) -> DataFrame:
    """(issn, bucket, queried, anchors_seen, anchors_matched, match_pct) after stopping early; percentage rounded down."""
    g = stop_after_misses(issues).groupBy("issn", "bucket").agg(F.count(F.lit(1)).alias("queried"), F.sum("anchors").alias("anchors_seen"), F.sum("hits").alias("anchors_matched"))
    return g.withColumn("match_pct", F.floor(F.col("anchors_matched") * 100 / F.col("anchors_seen")).cast("bigint"))


def transitions(issues: DataFrame, window: int = 5, least: int = 95) -> DataFrame:
    """(issn, status, year): whether the rolling share of hits over ``window`` issues is always, never, or from some year on at
    least ``least`` percent."""
    order = W.partitionBy("issn").orderBy("year", "issue")
    roll = order.rowsBetween(1 - window, 0)
    r = issues.withColumn("n", F.row_number().over(order)).withColumn("a", F.sum("anchors").over(roll)).withColumn("h", F.sum("hits").over(roll))
    r = r.withColumn("ok", F.when((F.col("n") >= window) & (F.col("a") > 0), (F.col("h") * 100 >= least * F.col("a")).cast("int")))
    rest = W.partitionBy("issn").orderBy("year", "issue").rowsBetween(0, W.unboundedFollowing)
    r = r.withColumn("from_here", F.when(F.col("ok").isNotNull(), F.min("ok").over(rest)))
    g = r.groupBy("issn").agg(F.min("ok").alias("lo"), F.max("ok").alias("hi"), F.min(F.when(F.col("from_here") == 1, F.col("year"))).alias("y"), F.min(F.when(F.col("ok").isNotNull(), F.col("year"))).alias("y0"))
    status = F.when(F.col("lo").isNull(), "no_data").when(F.col("lo") == 1, "always_clean").when(F.col("hi") == 0, "never_clean").when(F.col("y").isNotNull(), "transitioned").otherwise("mixed_unstable")
    return g.select("issn", status.alias("status"), F.when(status == "always_clean", F.col("y0")).when(status == "transitioned", F.col("y")).alias("year"))


def publisher_trust(journals: DataFrame, least_journals: int = 3, least_median: float = 95.0, least_q1: float = 80.0) -> DataFrame:
    """(publisher, n, median_pct, q1_pct, min_pct, max_pct, trusted) from (publisher, pct).

    The quartile is the exclusive one: position (n + 1) / 4 with linear interpolation, the minimum under four values. Sorted
    percentages of one publisher's journals are one array; a publisher has thousands of journals at most.
    """
    g = journals.groupBy("publisher").agg(F.count(F.lit(1)).alias("n"), F.median("pct").alias("median_pct"), F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"), F.array_sort(F.collect_list("pct")).alias("v"))
    at = (F.col("n") + 1) / 4
    k = F.floor(at).cast("int")
    low, high = F.get("v", k - 1), F.get("v", k)
    q1 = F.when(F.col("n") >= 4, low + (at - k) * (high - low)).otherwise(F.col("min_pct"))
    g = g.withColumn("q1_pct", q1)
    trusted = (F.col("n") >= least_journals) & (F.col("median_pct") >= least_median) & (F.col("q1_pct") >= least_q1)
    return g.select("publisher", "n", "median_pct", "q1_pct", "min_pct", "max_pct", trusted.alias("trusted"))


def upsert_good(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A cache after a refetch: a new row replaces an old one unless the new one is an error and the old one isn't."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    pick = F.struct(F.col("error").isNull().cast("int").alias("g"), F.col("_new"))
    rows = both.groupBy(*key).agg(F.max_by(F.struct(*[c for c in old.columns]), pick).alias("r"))
    return rows.select("r.*")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def miss_diagnosis(misses: DataFrame, works: DataFrame) -> DataFrame:
    """(anchor_id, cause) of anchors (anchor_id, issn, volume, issue, t) without a hit, against works (w_issn, w_volume, w_issue, t):
    A no work with the title, C only another journal's, D one of the same issue, B another issue's of the journal.

    Anchors meet distinct keys of the works, most exact first, so a title that everything has ('editorial') makes no pairs.
    """
    w = works.select(F.col("w_issn").alias("issn"), F.col("w_volume").alias("volume"), F.col("w_issue").alias("issue"), "t")
    keys = (["issn", "volume", "issue", "t"], ["issn", "t"], ["t"])
    j = misses
    for k, name in zip(keys, ("_issue", "_journal", "_any")):
        j = j.join(w.select(*k).distinct().withColumn(name, F.lit(True)), k, "left")
    return j.select("anchor_id", F.when(F.col("_issue"), "D").when(F.col("_journal"), "B").when(F.col("_any"), "C").otherwise("A").alias("cause"))


def not_in_contents(anchors: DataFrame, works: DataFrame) -> DataFrame:
    """Anchors (anchor_id, issn, t) whose journal's works (issn, t) have no such title; null titles and journals are left out."""
    return anchors.where("issn IS NOT NULL AND t IS NOT NULL").join(works.select("issn", "t").distinct(), ["issn", "t"], "left_anti").select("anchor_id")


def issue_sizes(anchors: DataFrame, top: int = 10) -> DataFrame:
    """(what, value) of the journals' distinct issues (issn, volume, issue): issues, journals, most, median and mean of a journal,
    and what the ``top`` largest have together."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    n = anchors.where("issn IS NOT NULL").select("issn", blank("volume").alias("v"), blank("issue").alias("i")).distinct().groupBy("issn").agg(F.count(F.lit(1)).alias("n"))
    all_of = n.agg(F.sum("n").cast("double").alias("issues"), F.count(F.lit(1)).cast("double").alias("journals"), F.max("n").cast("double").alias("most"), F.median("n").alias("median"), F.round(F.avg("n"), 6).alias("mean"))
    largest = n.orderBy(F.desc("n"), "issn").limit(top).agg(F.sum("n").cast("double").alias("value")).select(F.lit("top").alias("what"), "value")
    return all_of.unpivot([], ["issues", "journals", "most", "median", "mean"], "what", "value").unionByName(largest)


def decade_coverage(entries: DataFrame) -> DataFrame:
    """(decade, entries, with_doi, pct): how many entries (yr, doi) of each decade have an identifier; pct rounded down."""
    e = entries.where("yr IS NOT NULL")
    n = F.count(F.lit(1))
    return e.groupBy((F.col("yr") - F.col("yr") % 10).cast("int").alias("decade")).agg(n.alias("entries"), F.count("doi").alias("with_doi"), F.floor(F.count("doi") * 100 / n).cast("bigint").alias("pct"))
