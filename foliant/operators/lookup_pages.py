"""Where on an item's pages a requested article is: the texts of leaves, headings and printed pages as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions.pages import parse_pages
from foliant.functions.text import STOP_LOOKUP, tokens

# What stands at the end of an article
END_MARKS = r"(?i)\b(references|bibliography|literature\s+cited|acknowledge?ments?|received\s+(\w+\s+)?\d{1,2},?\s+\d{4}|received\s+\d{1,2}\s+\w+\s+\d{4})\b"


def _title(c: Column) -> Column:
    return F.array_distinct(tokens(c, STOP_LOOKUP, 4))


def _words(c: Column) -> Column:
    return F.array_distinct(tokens(c, []))


def leaf_texts(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(item, leaf, text): the characters [start, stop) of the item's text that are a leaf's; '' where they lie outside of it.
    ``spans``: item, leaf, start, stop; ``texts``: item, text."""
    j = spans.join(texts.select("item", F.col("text").alias("_t")), "item", "left")
    inside = (F.col("start") >= 0) & (F.col("stop") > F.col("start")) & (F.col("start") < F.length("_t"))
    return j.select("item", "leaf", F.when(inside, F.substring(F.col("_t"), F.col("start") + 1, F.col("stop") - F.col("start"))).otherwise("").alias("text"))


def title_at_top(asked: DataFrame, leaves: DataFrame, width: int = 300, least: float = 0.6, least_whole: float = 0.8, least_top: float = 0.4) -> DataFrame:
    """(request_id, item, leaf, n, top, whole, ok): how many of a title's ``n`` words stand within ``width`` characters of each
    other in the upper half of a leaf (``top``), and how many anywhere on it (``whole``).

    ``ok``: the share at the top reaches ``least``, or all of the leaf has ``least_whole`` and the top ``least_top``. Titles of
    under three words and leaves without text are not ok. ``asked``: request_id, item, leaf, title; ``leaves``: item, leaf,
    text. Word places are rows of the leaves asked for; a range frame looks back over the title's words only, so the work grows
    with the text, not with its square.
    """
    a = asked.select("request_id", "item", "leaf", _title(F.col("title")).alias("tt"))
    page = leaves.join(asked.select("item", "leaf").distinct(), ["item", "leaf"])
    half = F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(300), F.floor(F.length("text") / 2).cast("int")))
    w = page.select("item", "leaf", F.posexplode(F.split(F.regexp_replace(F.lower(half), "[^a-z0-9]", " "), " ")).alias("k", "w"))
    before = F.coalesce(F.sum(F.length("w") + 1).over(W.partitionBy("item", "leaf").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    w = w.withColumn("p", before).where("w <> ''")
    hit = a.withColumn("w", F.explode("tt")).join(w, ["item", "leaf", "w"])
    near = F.size(F.collect_set("w").over(W.partitionBy("request_id", "item", "leaf").orderBy("p").rangeBetween(-width, 0)))
    best = hit.withColumn("near", near).groupBy("request_id", "item", "leaf").agg(F.max("near").alias("top"))
    j = a.join(page.select("item", "leaf", _words(F.col("text")).alias("all")), ["item", "leaf"], "left").join(best, ["request_id", "item", "leaf"], "left")
    j = j.withColumn("n", F.size("tt")).withColumn("top", F.coalesce("top", F.lit(0)).cast("int")).withColumn("whole", F.coalesce(F.size(F.array_intersect("tt", "all")), F.lit(0)))
    ok = (F.col("n") >= 3) & ((F.col("top") >= least * F.col("n")) | ((F.col("top") > 0) & (F.col("whole") >= least_whole * F.col("n")) & (F.col("top") >= least_top * F.col("n"))))
    return j.select("request_id", "item", "leaf", "n", "top", "whole", ok.alias("ok"))


def ends_by_scan(asked: DataFrame, leaves: DataFrame, most: int = 50) -> DataFrame:
    """(request_id, item, leaf, marks, next_article): going forward from an article's first leaf, the first leaf with the marks
    of an end (END_MARKS), and the leaf before the first one, two or more on, whose upper third has under a fifth of the title's
    words and four new ones of five letters. At most ``most`` leaves are looked at; null where there is no such leaf."""
    a = asked.select("request_id", "item", "leaf", _title(F.col("title")).alias("tt"))
    j = a.withColumn("at", F.explode(F.sequence(F.col("leaf") + 1, F.col("leaf") + most))).join(leaves.select("item", F.col("leaf").alias("at"), "text"), ["item", "at"])
    third = F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(300), F.floor(F.length("text") / 3).cast("int")))
    j = j.withColumn("seen", _words(third))
    fresh = F.size(F.array_except(F.filter("seen", lambda t: (F.length(t) >= 5) & ~t.isin(STOP_LOOKUP)), F.col("tt")))
    other = (F.col("at") >= F.col("leaf") + 2) & (F.size("tt") > 0) & (F.size(F.array_intersect("tt", "seen")) < 0.2 * F.size("tt")) & (fresh >= 4) & (F.col("text") != "")
    g = j.groupBy("request_id", "item", "leaf").agg(F.min(F.when(F.col("text").rlike(END_MARKS), F.col("at"))).alias("marks"), F.min(F.when(other, F.col("at") - 1)).alias("next_article"))
    return a.select("request_id", "item", "leaf").join(g, ["request_id", "item", "leaf"], "left")


def _asked(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    p = parse_pages(F.col("pages"))
    return candidates.join(requests.select("request_id", "title", p["first"].alias("first"), p["last"].alias("last")), "request_id")


def answers_from_headings(candidates: DataFrame, requests: DataFrame, headings: DataFrame, page_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """(request_id, item, tier, rank, strategy, confidence, start, stop): the heading that shows the requested title best.

    A heading's score is the words both have in common over the larger number of words, at least 0.95 if it has all of the
    title's; from 0.6 on it answers, the first of equals down the pages. The article ends by the printed range if the request
    has one, else on the page before the next heading that reads like another title (three words or more, none of this one's)
    or at the end of the item. The confidence is 50 and 40 times the score; 5 more for a printed range, at most 70 where the
    item's end had to do, 10 more if the printed first page is within a leaf, 15 less if it is elsewhere.

    ``headings``: item, page_no, label, text, top; ``page_map``: item, printed, leaf; ``sizes``: item, n_leaves. Headings meet
    requests by a word of the title, not as all pairs.
    """
    h = headings.where("trim(text) <> ''").withColumn("ht", _title(F.col("text")))
    h = h.withColumn("o", F.row_number().over(W.partitionBy("item").orderBy("page_no", "label", "text", "top")))
    r = _asked(candidates, requests).withColumn("tt", _title(F.col("title"))).where(F.size("tt") >= 3)
    met = r.withColumn("w", F.explode("tt")).join(h.select("item", "o", "page_no", "ht", F.explode("ht").alias("w")), ["item", "w"])
    key = ["request_id", "item", "tier", "rank", "first", "last"]
    n = met.groupBy(*key, "o").agg(F.count(F.lit(1)).alias("shared"), F.first("tt").alias("tt"), F.first("ht").alias("ht"), F.first("page_no").alias("page_no"))
    share = F.col("shared") / F.greatest(F.size("tt"), F.size("ht"))
    score = F.when(F.col("shared") == F.size("tt"), F.greatest(share, F.lit(0.95))).otherwise(share)
    best = n.withColumn("score", score).where("score >= 0.6").groupBy(*key).agg(F.min_by(F.struct("o", "page_no", "score", F.array_union("tt", "ht").alias("own")), F.struct((-F.col("score")).alias("s"), "o")).alias("b")).select(*key, "b.*")
    later = h.where("length(text) >= 4 AND size(ht) >= 3").select("item", F.col("o").alias("o2"), F.col("page_no").alias("p2"), F.col("ht").alias("h2"))
    nxt = best.join(later, "item").where((F.col("o2") > F.col("o")) & (F.col("p2") != F.col("page_no")) & ~F.arrays_overlap("own", "h2")).groupBy("request_id", "item").agg(F.min_by("p2", "o2").alias("next_page"))
    j = best.join(nxt, ["request_id", "item"], "left").join(sizes, "item", "left").join(page_map.select("item", F.col("printed").alias("first"), F.col("leaf").alias("mapped")), ["item", "first"], "left")
    ranged = F.coalesce(F.col("last") != F.col("first"), F.lit(False))
    end = F.when(ranged, F.col("page_no") + F.col("last") - F.col("first")).otherwise(F.coalesce(F.col("next_page") - 1, F.col("n_leaves"), F.col("page_no") + 20))
    base = 50 + F.floor(F.round(F.col("score") * 40, 6)).cast("int")
    base = F.when(ranged, base + 5).when(F.col("next_page").isNull(), F.least(base, F.lit(70))).otherwise(base)
    start = F.col("page_no") - 1
    conf = F.when(F.col("mapped").isNull(), base).when(F.abs(F.col("mapped") - start) <= 1, F.least(F.lit(100), base + 10)).otherwise(F.greatest(F.lit(0), base - 15))
    return j.select("request_id", "item", "tier", "rank", F.lit("headings").alias("strategy"), F.least(F.lit(100), conf).cast("int").alias("confidence"), start.cast("int").alias("start"), F.greatest(start, end - 1).cast("int").alias("stop"))


def answers_from_page_map(candidates: DataFrame, requests: DataFrame, page_map: DataFrame, leaves: DataFrame) -> DataFrame:
    """(request_id, item, tier, rank, strategy, confidence, start, stop): printed pages through the item's page map.

    The first page must be on the map. The last is looked up too; where it isn't there, the printed length counts, and where the
    request has only one page, the first end that ``ends_by_scan`` finds. The confidence is 30; 15 more for a mapped last page
    and 15 if the lengths agree within two, or 10 for an end by scanning; 25 for the title at the top of the first leaf; 15 for
    the marks of an end on the last leaf or the one after it.
    """
    r = _asked(candidates, requests).where("first IS NOT NULL")
    m = page_map.select("item", "printed", "leaf")
    j = r.join(m.withColumnsRenamed({"printed": "first", "leaf": "start"}), ["item", "first"]).join(m.withColumnsRenamed({"printed": "last", "leaf": "mapped"}), ["item", "last"], "left")
    at = j.select("request_id", "item", F.col("start").alias("leaf"), "title")
    top = title_at_top(at, leaves).select("request_id", "item", F.col("ok").alias("titled"))
    scan = ends_by_scan(at, leaves).select("request_id", "item", F.least("marks", "next_article").alias("scanned"))
    j = j.join(top, ["request_id", "item"], "left").join(scan, ["request_id", "item"], "left")
    ranged = F.col("last") != F.col("first")
    stop = F.when(F.col("mapped").isNull(), F.col("start") + F.col("last") - F.col("first")).when(~ranged, F.coalesce("scanned", "mapped")).otherwise(F.col("mapped"))
    j = j.withColumn("stop", stop.cast("int"))
    marked = leaves.where(F.col("text").rlike(END_MARKS)).select("item", F.explode(F.array(F.col("leaf").cast("int"), (F.col("leaf") - 1).cast("int"))).alias("stop"), F.lit(True).alias("ended")).distinct()
    j = j.join(marked, ["item", "stop"], "left")
    both = ranged & F.col("mapped").isNotNull()
    alike = F.abs(F.col("last") - F.col("first") - (F.col("stop") - F.col("start"))) <= 2
    by_scan = ~ranged & F.col("mapped").isNotNull() & F.col("scanned").isNotNull()
    conf = F.lit(30) + F.when(both & alike, 30).when(both, 15).when(by_scan, 10).otherwise(0) + F.when(F.col("titled"), 25).otherwise(0) + F.when(F.col("ended"), 15).otherwise(0)
    return j.select("request_id", "item", "tier", "rank", F.lit("page_map").alias("strategy"), F.least(F.lit(100), conf).cast("int").alias("confidence"), F.col("start").cast("int").alias("start"), "stop")
