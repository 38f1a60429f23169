"""Scan leaves, visible pages and printed labels: maps between them, their health, and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def page_index_map(leaves: DataFrame) -> DataFrame:
    """(item, leaf, br): the dense index of visible images; hidden images have none. One window per item."""
    seen = F.sum(F.col("accessible").cast("int")).over(W.partitionBy("item").orderBy("leaf").rowsBetween(W.unboundedPreceding, 0))
    return leaves.select("item", "leaf", F.when(F.col("accessible"), seen - 1).cast("int").alias("br"))


def printed_to_page(leaves: DataFrame) -> DataFrame:
    """(item, label, br): the first visible page with each printed label."""
    pages = leaves.join(page_index_map(leaves), ["item", "leaf"]).where("br IS NOT NULL AND label IS NOT NULL")
    return pages.groupBy("item", "label").agg(F.min_by("br", "leaf").alias("br"))


def page_to_printed(leaves: DataFrame) -> DataFrame:
    """(item, br, label): the printed label of each visible page that has one."""
    return leaves.join(page_index_map(leaves), ["item", "leaf"]).where("br IS NOT NULL AND label IS NOT NULL").select("item", "br", "label")


def page_label_health(leaves: DataFrame, min_coverage: int = 60, min_confident: int = 20, min_monotone: int = 85) -> DataFrame:
    """How far an item's printed labels can be trusted, thresholds in percent.

    (item, n_rows, n_labels, n_confident, n_pairs, n_steps, status). 'restart_pagination' if more than 5 % of the labels
    repeat; 'unusable' below 10 % coverage and 5 % confidence; 'ok' if all three thresholds hold; else 'repair'.
    Comparisons are in integers. A label without digits makes no step.
    """
    order = W.partitionBy("item").orderBy("leaf")
    n = F.col("label").try_cast("int")
    named = leaves.where("label IS NOT NULL").withColumn("n", n).withColumn("before", F.lag("n").over(order)).withColumn("first", F.lag("leaf").over(order).isNull())
    steps = named.groupBy("item").agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.count_distinct("label").alias("n_distinct"),
        F.count_if(F.col("confidence") > 0).alias("n_confident"),
        F.count_if(~F.col("first")).alias("n_pairs"),
        F.count_if(F.col("n") - F.col("before") == 1).alias("n_steps"),
    )
    all_rows = leaves.groupBy("item").agg(F.count(F.lit(1)).alias("n_rows"))
    j = all_rows.join(steps, "item", "left").na.fill(0)
    labels, conf = F.col("n_labels"), F.col("n_confident")
    status = (
        F.when((labels - F.col("n_distinct")) * 100 > 5 * labels, "restart_pagination")
        .when((labels * 100 < 10 * F.col("n_rows")) & (conf * 100 < 5 * labels) | (labels == 0), "unusable")
        .when((labels * 100 >= min_coverage * F.col("n_rows")) & (conf * 100 >= min_confident * labels) & (F.col("n_steps") * 100 >= min_monotone * F.col("n_pairs")), "ok")
        .otherwise("repair")
    )
    return j.select("item", "n_rows", "n_labels", "n_confident", "n_pairs", "n_steps", status.alias("status"))


def supported_offsets(anchors: DataFrame, key: str = "item") -> DataFrame:
    """Anchors (item, leaf, first_page, last_page) whose offset at least two agree on; a single anchor is kept as it is."""
    offset = F.col("leaf") - F.col("first_page")
    w = W.partitionBy(key)
    return (
        anchors.withColumn("offset", offset)
        .withColumn("support", F.count(F.lit(1)).over(W.partitionBy(key, "offset")))
        .withColumn("all", F.count(F.lit(1)).over(w))
        .where("support >= 2 OR all = 1")
        .drop("support", "all")
    )


def repaired_map(anchors: DataFrame, sizes: DataFrame | None = None, most: int = 9999) -> DataFrame:
    """(item, printed, leaf): the leaf of each printed page, the first claim on a page wins.

    An anchor (item, leaf, first_page, last_page) covers its own pages at its own offset; pages between two anchors take the
    later one's. With ``sizes`` (item, n_leaves) pages after the last anchor go on at its offset to the item's end, and those
    before the first one down to page 1 or the first leaf. Ranges are expanded by ``sequence``; no pairs of anchors are formed.
    """
    order = W.partitionBy("item").orderBy("first_page", "leaf")
    a = anchors.withColumn("ord", F.row_number().over(order)).withColumn("_prev", F.lag("last_page").over(order)).withColumn("o", F.col("leaf") - F.col("first_page"))

    def claim(rows: DataFrame, step: int, low, high) -> DataFrame:
        r = rows.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
        return r.select("item", "o", "ord", F.lit(step).alias("pass"), F.explode(F.sequence("_low", "_high")).alias("printed"))

    claims = claim(a, 0, F.col("first_page"), F.greatest("first_page", "last_page")).unionByName(claim(a, 1, F.col("_prev") + 1, F.col("first_page") - 1))
    if sizes is not None:
        last = a.join(sizes.select("item", "n_leaves"), "item").withColumn("_n", F.max("ord").over(W.partitionBy("item"))).where("ord = _n")
        claims = claims.unionByName(claim(last, 2, F.col("last_page") + 1, F.least(F.col("n_leaves") - 1 - F.col("o"), F.lit(most))))
        claims = claims.unionByName(claim(a.where("ord = 1"), 3, F.greatest(F.lit(1), -F.col("o")), F.col("first_page") - 1))
    return claims.groupBy("item", "printed").agg(F.min_by(F.col("printed") + F.col("o"), F.struct("pass", "ord")).alias("leaf"))


def compare_assertions(assertions: DataFrame, labels: DataFrame) -> DataFrame:
    """Operators' page assertions against read labels at the same leaf: (item, leaf, asserted, observed, outcome)."""
    clean = lambda c: F.regexp_replace(F.lower(c.cast("string")), "[^a-z0-9]+", "")
    j = assertions.join(labels, ["item", "leaf"], "left")
    a, o = clean(F.col("asserted")), clean(F.col("observed"))
    return j.select("item", "leaf", "asserted", "observed", F.when(o.isNull() | (o == ""), "no_ocr").when(a == o, "match").otherwise("mismatch").alias("outcome"))


def page_runs(pages: DataFrame, key: str, page: str, gap: int = 1) -> DataFrame:
    """(key, first_page, last_page, n): runs of distinct pages with steps of at most ``gap``."""
    w = W.partitionBy(key).orderBy(page)
    p = pages.select(key, page).where(F.col(key).isNotNull() & F.col(page).isNotNull()).distinct()
    p = p.withColumn("_d", F.when(F.col(page) - F.lag(page).over(w) > gap, 1).otherwise(0)).withColumn("_r", F.sum("_d").over(w))
    return p.groupBy(key, "_r").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count(F.lit(1)).alias("n")).drop("_r")


def top_mismatches(outcomes: DataFrame, most: int = 40) -> DataFrame:
    """(asserted, observed, n): the ``most`` frequent pairs of differing labels; the limit is the feature."""
    return outcomes.where("outcome = 'mismatch'").groupBy("asserted", "observed").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "asserted", "observed").limit(most)


def assertion_flags(outcomes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(item, asserted, matches, mismatches, no_ocr, no_assertions, single_assertion, missing_start, missing_end): per item of
    ``sizes`` (item, n_leaves) how its assertions fare; they are missing at the start if the first is beyond a tenth of the
    leaves, and at the end if the last is before nine tenths."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    g = outcomes.groupBy("item").agg(F.count(F.lit(1)).alias("asserted"), n("match").alias("matches"), n("mismatch").alias("mismatches"), n("no_ocr").alias("no_ocr"), F.min("leaf").alias("_lo"), F.max("leaf").alias("_hi"))
    j = sizes.join(g, "item", "left").na.fill(0, ["asserted", "matches", "mismatches", "no_ocr"])
    late = F.coalesce(F.col("_lo") * 10 > F.col("n_leaves"), F.lit(False))
    early = F.coalesce(F.col("_hi") * 10 < F.col("n_leaves") * 9, F.lit(False))
    return j.select("item", "asserted", "matches", "mismatches", "no_ocr", (F.col("asserted") == 0).alias("no_assertions"), (F.col("asserted") == 1).alias("single_assertion"), late.alias("missing_start"), early.alias("missing_end"))


def counters(flags: DataFrame, by: list[str]) -> DataFrame:
    """The flags and outcomes added up, by each of the columns ``by`` (the others null): one pass over grouping sets."""
    flagged = [F.count_if(c).alias(f"n_{c}") for c in ("no_assertions", "single_assertion", "missing_start", "missing_end")]
    added = [F.sum(c).alias(f"n_{c}") for c in ("asserted", "matches", "mismatches", "no_ocr")]
    return flags.groupingSets([[c] for c in by], *by).agg(F.count(F.lit(1)).alias("n_items"), *flagged, *added)
