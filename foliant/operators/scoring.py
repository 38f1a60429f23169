"""How well contents entries place known article locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions.text import overlap, tokens

MATCH_RANK = {"exact": 1, "soft": 2, "leaves_only": 3, "content_only": 4, "miss": 5}


def judged_pairs(anchors: DataFrame, entries: DataFrame, on: str = "item", tolerance: int = 1) -> DataFrame:
    """Each anchor (anchor_id, title, names, a_start, a_end) with each entry (entry_id, ord, e_title, e_names, e_start,
    e_end) of its item, and flags: title_hit, author_hit, same, near. An item has a few hundred entries at most; the join is an
    equi-join on the item."""
    # titles become words once a row, not once a pair
    j = anchors.withColumn("_t", F.array_distinct(tokens(F.col("title")))).join(entries.withColumn("_e", F.array_distinct(tokens(F.col("e_title")))), on)
    j = j.withColumn("overlap", F.coalesce(overlap(F.col("_t"), F.col("_e")), F.lit(0.0))).drop("_t", "_e")
    title = F.col("overlap") >= 0.6
    author = F.coalesce(F.arrays_overlap("names", "e_names"), F.lit(False))
    same = F.coalesce((F.col("a_start") == F.col("e_start")) & (F.col("a_end") == F.col("e_end")), F.lit(False))
    near = F.coalesce(F.abs(F.col("a_start") - F.col("e_start")) <= tolerance, F.lit(False))
    return j.withColumns({"title_hit": title, "author_hit": author, "same": same, "near": near})


def find_hit(pairs: DataFrame, anchor: str = "anchor_id") -> DataFrame:
    """(anchor, match, entry_id, end_offset): the best entry of each anchor that has candidates. Classes in order: exact (same
    range and content), soft (start within tolerance, end neither short nor beyond two, and content), leaves_only, content_only,
    miss; first entry of the class wins. Pre-aggregated per anchor, no sort of all pairs."""
    content = F.col("title_hit") | F.col("author_hit")
    off = F.col("e_end") - F.col("a_end")
    rank = F.when(F.col("same") & content, 1).when(F.col("near") & content, 2).when(F.col("same"), 3).when(content, 4).otherwise(5)
    best = pairs.groupBy(anchor).agg(F.min(F.struct(rank.alias("rank"), F.col("ord"), F.col("entry_id"), off.alias("off"))).alias("b"))
    name: Column = F.element_at(F.array(*[F.lit(k) for k in MATCH_RANK]), F.col("b.rank"))
    return best.select(anchor, name.alias("match"), F.when(F.col("b.rank") < 5, F.col("b.entry_id")).alias("entry_id"), F.when(F.col("b.rank") < 5, F.col("b.off")).alias("end_offset"))


def findable(pairs: DataFrame, anchor: str = "anchor_id", overshoot: int = 2) -> DataFrame:
    """(anchor, n_content, n_passing, hit, ambiguous): entries with title or author agreeing, start within the tolerance and an
    end that isn't short and at most ``overshoot`` beyond."""
    content = F.col("title_hit") | F.col("author_hit")
    off = F.col("e_end") - F.col("a_end")
    passing = content & F.col("near") & F.coalesce(off.between(0, overshoot), F.lit(False))
    n = pairs.groupBy(anchor).agg(F.count_if(content).alias("n_content"), F.count_if(passing).alias("n_passing"))
    return n.withColumns({"hit": F.col("n_passing") >= 1, "ambiguous": F.col("n_passing") >= 2})


def best_blend(pairs: DataFrame, anchor: str = "anchor_id", least: int = 55) -> DataFrame:
    """(anchor, entry_id, score): the entry with the largest 55 * title + 40 * place + 5 * author in hundredths, first of
    equals; place counts 10, 6 or 0 tenths. Entries under ``least`` don't count."""
    title = F.floor(100 * F.col("overlap")).cast("int")
    place = F.when(F.col("same"), 40).when(F.col("near"), 24).otherwise(0)
    score = (F.floor(title * 55 / 100).cast("int") + place + F.when(F.col("author_hit"), 5).otherwise(0)).cast("int")
    s = pairs.withColumn("score", score).where(F.col("score") >= least)
    best = s.groupBy(anchor).agg(F.max(F.struct(F.col("score"), (-F.col("ord")).alias("o"), (-F.col("entry_id")).alias("e"))).alias("b"))
    return best.select(anchor, (-F.col("b.e")).alias("entry_id"), F.col("b.score").alias("score"))


def miss_category(pairs: DataFrame, anchor: str = "anchor_id", far: int = 5) -> DataFrame:
    """(anchor, category, distance): why an anchor isn't placed, from the entry that starts nearest (first of equals)."""
    d = F.abs(F.col("e_start") - F.col("a_start"))
    near = pairs.where("a_start IS NOT NULL").groupBy(anchor).agg(F.min(F.when(d.isNotNull(), F.struct(d.alias("d"), F.col("ord"), F.col("entry_id"), (F.col("e_end") - F.col("e_start")).alias("span"), (F.col("a_end") - F.col("a_start")).alias("a_span"), "title_hit", "author_hit"))).alias("b"))
    b = F.col("b")
    kind = (
        F.when(b.isNull(), "no_entries")
        .when(b["d"] > far, "no_neighbor_entry")
        .when(b["a_span"] <= 1, "short_anchor_range")
        .when(b["title_hit"] & ~b["author_hit"], "wrong_author")
        .when(b["author_hit"] & ~b["title_hit"], "wrong_title")
        .when(b["span"] < F.floor(b["a_span"] / 2), "split_article")
        .otherwise("leaf_offset")
    )
    return near.select(anchor, kind.alias("category"), b["d"].alias("distance"))


def end_offset_bands(hits: DataFrame) -> DataFrame:
    """(match, band, n): how far ends are off, by match class."""
    o = F.col("end_offset")
    band = F.when(o.isNull(), "none").when(o < -2, "far short").when(o < 0, "short").when(o == 0, "equal").when(o <= 2, "beyond by 2").otherwise("far beyond")
    return hits.groupBy("match", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def scoreboard(hits: DataFrame, item: str) -> DataFrame:
    """One row per item and one for all (item null): counts by match class and the percentage placed, rounded down."""
    classes = [F.count_if(F.col("match") == k).alias(k) for k in MATCH_RANK]
    total = hits.rollup(item).agg(F.count(F.lit(1)).alias("n"), *classes)
    return total.withColumn("placed_pct", F.floor((F.col("exact") + F.col("soft")) * 100 / F.col("n")).cast("bigint"))


def lookup_outcomes(results: DataFrame, tolerance: int = 2) -> DataFrame:
    """(request_id, outcome) of looked-up against true item and pages: exact, partial_pages, pages_differ, diff_item, no_item."""
    same = F.col("item") == F.col("true_item")
    s, e = F.abs(F.col("start") - F.col("true_start")) <= tolerance, F.abs(F.col("stop") - F.col("true_stop")) <= tolerance
    kind = F.when(F.col("item").isNull(), "no_item").when(~same, "diff_item").when(s & e, "exact").when(s | e, "partial_pages").otherwise("pages_differ")
    return results.select("request_id", kind.alias("outcome"))


def outcomes_by_band(outcomes: DataFrame, kinds: list[str]) -> DataFrame:
    """(band, a column a kind): how many of (outcome, confidence) ended how, by confidence from 90, from 70 and below."""
    c = F.col("confidence")
    band = F.when(c >= 90, "sure").when(c >= 70, "likely").when(c.isNull(), "none").otherwise("weak")
    return outcomes.groupBy(band.alias("band")).pivot("outcome", kinds).agg(F.count(F.lit(1))).na.fill(0)


def first_per_group(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
