"""Citation lookup: tiers of candidate items, and the choice among scored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

TIER_PENALTY = {1: 0, 2: 5, 3: 15}


def candidates(requests: DataFrame, items: DataFrame, most: int = 4) -> DataFrame:
    """(request_id, item, tier, rank): items of the request's journal by volume and issue (1), volume (2) or year (3); an item
    counts in its best tier; at most ``most`` a tier, by name, as the limit is the feature. Blank fields match nothing."""
    ok = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    r = requests.select("request_id", "issn", F.trim("vol").alias("vol"), F.trim("iss").alias("iss"), F.trim("yr").alias("yr"))
    tiers = [
        r.where(ok("vol") & ok("iss")).join(items, ["issn", "vol", "iss"]).select("request_id", "item", F.lit(1).alias("tier")),
        r.where(ok("vol")).join(items.drop("iss", "yr"), ["issn", "vol"]).select("request_id", "item", F.lit(2).alias("tier")),
        r.where(ok("yr")).join(items.drop("iss", "vol"), ["issn", "yr"]).select("request_id", "item", F.lit(3).alias("tier")),
    ]
    best = tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).groupBy("request_id", "item").agg(F.min("tier").alias("tier"))
    rank = F.row_number().over(W.partitionBy("request_id", "tier").orderBy("item"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most)


def select_answer(answers: DataFrame, sure: int = 90) -> DataFrame:
    """(request_id, item, strategy, confidence): the first answer, by (tier, rank, strategy), that is sure after its tier's
    penalty, else the most confident, first of equals. Answers have (request_id, item, tier, rank, strategy, confidence)."""
    c = F.greatest(F.lit(0), F.least(F.lit(100), F.col("confidence") - F.when(F.col("tier") == 1, 0).when(F.col("tier") == 2, 5).otherwise(15)))
    a = answers.withColumn("c", c)
    order = F.struct("tier", "rank", "strategy", "item")
    g = a.groupBy("request_id").agg(
        F.min_by(F.struct("item", "strategy", "c"), F.when(F.col("c") >= sure, order)).alias("s"),
        F.min_by(F.struct("item", "strategy", "c"), F.struct((-F.col("c")).alias("n"), "tier", "rank", "strategy", "item")).alias("b"),
        F.max("c").alias("m"),
    )
    pick = F.when(F.col("m") >= sure, F.col("s")).otherwise(F.col("b"))
    return g.select("request_id", pick["item"].alias("item"), pick["strategy"].alias("strategy"), pick["c"].alias("confidence"))


def most_frequent_slug(titles: DataFrame) -> DataFrame:
    """(title, slug): the identifier each title is most often served from, first by name of equals."""
    n = titles.where("title IS NOT NULL AND slug IS NOT NULL").groupBy("title", "slug").count()
    return n.groupBy("title").agg(F.min_by("slug", F.struct((-F.col("count")).alias("n"), "slug")).alias("slug"))


def answers_from_contents(candidates: DataFrame, requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(request_id, item, tier, rank, strategy, confidence, entry_id): contents entries that fit a request's title and pages.

    The score is the overlap of words in hundredths, and 30 more if the first page is the entry's; from 60 on it answers, with
    confidence 70 + a quarter of the score, 10 less for titles of under three words in common and no page. Per request and item
    the best entry, first of equals. Entries meet requests through the candidate items, not as all pairs.
    """
    from foliant.functions.pages import parse_pages
    from foliant.functions.text import STOP_LOOKUP, overlap, tokens

    r = requests.select("request_id", F.array_distinct(tokens(F.col("title"), STOP_LOOKUP, 4)).alias("rt"), parse_pages(F.col("pages"))["first"].alias("page"))
    e = entries.select("item", "entry_id", F.array_distinct(tokens(F.col("title"), STOP_LOOKUP, 4)).alias("et"), "first_page", "last_page")
    j = candidates.join(r, "request_id").join(e, "item")
    on_page = F.coalesce((F.col("first_page") > 0) & (F.col("page") == F.col("first_page")), F.lit(False))
    score = F.floor(100 * F.coalesce(overlap(F.col("rt"), F.col("et")), F.lit(0.0))).cast("int") + F.when(on_page, 30).otherwise(0)
    weak = (F.size(F.array_intersect("rt", "et")) < 3) & ~on_page
    j = j.withColumn("score", score).where("score >= 60").withColumn("confidence", F.least(F.lit(100), 70 + F.floor(F.col("score") / 4) - F.when(weak, 10).otherwise(0)).cast("int"))
    best = j.groupBy("request_id", "item", "tier", "rank").agg(F.min(F.struct((-F.col("score")).alias("n"), "entry_id", "confidence")).alias("b"))
    return best.select("request_id", "item", "tier", "rank", F.lit("contents").alias("strategy"), F.col("b.confidence").alias("confidence"), F.col("b.entry_id").alias("entry_id"))
