"""Contents against known articles: match classes of several variants, predictions, recall of lists, annotated entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.text import STOP_AUDIT, STOP_TITLE, normalize_title, overlap, seq_ratio, tokens


def title_similarity(a: Column, b: Column, use_ratio: bool = True) -> Column:
    """1 for equal titles, 0.95 where one contains the other, else the larger of word overlap and spelling; 0 for empty ones."""
    x, y = normalize_title(a), normalize_title(b)
    near = overlap(tokens(a), tokens(b))
    if use_ratio:
        near = F.greatest(near, F.coalesce(seq_ratio(x, y), F.lit(0.0)))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.95).otherwise(F.coalesce(near, F.lit(0.0)))


def junk_title(title: Column, journal: Column, stop: list[str] = STOP_TITLE, least: int = 1, use_ratio: bool = True) -> Column:
    """Whether a title is only the journal's: one contains the other, or they are spelled alike. Empty ones are not."""
    x, y = F.array_join(tokens(title, stop, least), " "), F.array_join(tokens(journal, stop, least), " ")
    alike = x.contains(y) | y.contains(x)
    if use_ratio:
        alike = alike | (seq_ratio(x, y) >= 0.85)
    return F.coalesce((x != "") & (y != "") & alike, F.lit(False))


def first_words_match(a: Column, b: Column, n: int = 4, ratio: float = 0.8, use_ratio: bool = True) -> Column:
    """Whether the first ``n`` words agree: the first one where either title has only one, else as many as both have, two at
    least, equal or spelled alike."""
    x, y = tokens(a, STOP_AUDIT, 2), tokens(b, STOP_AUDIT, 2)
    some = (F.size(x) > 0) & (F.size(y) > 0)
    single = ((F.size(x) == 1) | (F.size(y) == 1)) & (F.get(x, F.lit(0)) == F.get(y, F.lit(0)))
    k = F.least(F.lit(n), F.size(x), F.size(y))
    head = lambda w: F.array_join(F.slice(w, F.lit(1), F.greatest(k, F.lit(0))), " ")
    same = head(x) == head(y)
    if use_ratio:
        same = same | (seq_ratio(head(x), head(y)) >= ratio)
    return F.coalesce(some & (single | ((k >= 2) & same)), F.lit(False))


def longest_words(c: Column) -> Column:
    """The longest alphabetic word of three letters or more of each part of an author string, the first of equals, lower case."""
    parts = F.split(c, r"[;,&]| and ")
    words = lambda p: F.filter(F.transform(F.split(F.trim(p), r"\s+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{L}+$"))
    longest = lambda ws: F.aggregate(ws, F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(longest(words(p)))), lambda w: w != ""))), F.array().cast("array<string>"))


def cutoff_matches(pairs: DataFrame, anchor: str = "anchor_id", tolerance: int = 1) -> DataFrame:
    """(anchor, match, entry_id): exact pages, else both ends within ``tolerance``, else the title, else a miss; the first entry
    of the best class. ``pairs`` as of ``scoring.judged_pairs``."""
    close = F.coalesce((F.abs(F.col("a_start") - F.col("e_start")) <= tolerance) & (F.abs(F.col("a_end") - F.col("e_end")) <= tolerance), F.lit(False))
    rank = F.when(F.col("same"), 1).when(close, 2).when(F.col("title_hit"), 3).otherwise(4)
    b = pairs.groupBy(anchor).agg(F.min(F.struct(rank.alias("rank"), "ord", "entry_id")).alias("b"))
    name = F.element_at(F.array(*map(F.lit, ("exact", "soft", "title_only", "miss"))), F.col("b.rank"))
    return b.select(anchor, name.alias("match"), F.when(F.col("b.rank") < 4, F.col("b.entry_id")).alias("entry_id"))


def scoreboards(hits: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """(variant, n, exact, soft, title_only, miss) of hits (variant, item, match); of the items in ``subset`` (item) only, if
    given."""
    if subset is not None:
        hits = hits.join(subset.select("item").distinct(), "item", "left_semi")
    return hits.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("match") == k).alias(k) for k in ("exact", "soft", "title_only", "miss")])


def leaf_pairs(starts: Column, stops: Column) -> Column:
    """[struct(start, stop)] of two arrays of 'n12', null unless both are of one length and all of that shape."""
    whole = lambda a: (F.size(a) > 0) & F.forall(a, lambda x: F.coalesce(F.trim(x).rlike("^n[0-9]{1,9}$"), F.lit(False)))
    n = lambda x: F.regexp_extract(F.trim(x), "^n([0-9]{1,9})$", 1).cast("int")
    pairs = F.zip_with(starts, stops, lambda a, b: F.struct(n(a).alias("start"), n(b).alias("stop")))
    return F.when(whole(starts) & whole(stops) & (F.size(starts) == F.size(stops)), pairs)


def kind_match(start: Column, stop: Column, true_start: Column, true_stop: Column, tolerance: int = 1) -> Column:
    """no_prediction, exact, soft (both ends within ``tolerance``) or wrong."""
    return (
        F.when(start.isNull() | true_start.isNull(), "no_prediction")
        .when((start == true_start) & (stop == true_stop), "exact")
        .when((F.abs(start - true_start) <= tolerance) & (F.abs(stop - true_stop) <= tolerance), "soft")
        .otherwise("wrong")
    )


def predict_by_title(asked: DataFrame, entries: DataFrame, least: float = 0.55, use_ratio: bool = False) -> DataFrame:
    """(anchor_id, entry_id, start, stop): the entry of the item whose title is most like the one asked for, from ``least`` on;
    the first of equals. Without ``use_ratio`` titles meet by a word they share, so an item's entries are no pairs of all;
    containment inside a word needs it."""
    a = asked.select("anchor_id", "item", "title")
    e = entries.select("item", "entry_id", "ord", F.col("title").alias("e_title"), "start", "stop")
    if use_ratio:
        j = a.join(e, "item")
    else:
        w = lambda df, c: df.withColumn("_w", F.explode(F.array_distinct(tokens(F.col(c)))))
        j = w(a, "title").join(w(e, "e_title"), ["item", "_w"]).drop("_w").distinct()
    j = j.withColumn("sim", title_similarity(F.col("title"), F.col("e_title"), use_ratio)).where(F.col("sim") >= least)
    b = j.groupBy("anchor_id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "ord", "entry_id", "start", "stop")).alias("b"))
    return b.select("anchor_id", "b.entry_id", "b.start", "b.stop")


def path_outcomes(rows: DataFrame) -> DataFrame:
    """(path, exact, soft, wrong, no_prediction): how three predictions of (start, stop) do, and the first with each of the other
    two where it says nothing. ``rows``: true_start, true_stop and a struct of start and stop (or null) for map, heur and llm."""
    said = {"map": F.col("map"), "heur": F.col("heur"), "llm": F.col("llm"), "map_then_heur": F.coalesce("map", "heur"), "map_then_llm": F.coalesce("map", "llm")}
    kinds = F.array(*[F.struct(F.lit(k).alias("path"), kind_match(p["start"], p["stop"], F.col("true_start"), F.col("true_stop")).alias("kind")) for k, p in said.items()])
    return rows.select(F.inline(kinds)).groupBy("path").pivot("kind", ["exact", "soft", "wrong", "no_prediction"]).agg(F.count(F.lit(1))).na.fill(0)


def list_recall(articles: DataFrame, entries: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """How much of a list of articles (item, article_id, title) the contents (item, entry_id, entry_type, title) have:
    (item, articles, matched, extras), and the entries no article was matched with, (item, entry_id), articles and reviews only.

    An article's best entry is the first of the most similar ones; candidates share a word."""
    w = lambda df, c: df.withColumn("_w", F.explode(F.array_distinct(tokens(F.col(c)))))
    a, e = articles.select("item", "article_id", "title").where("title IS NOT NULL"), entries.select("item", "entry_id", "entry_type", F.col("title").alias("e_title"))
    j = w(a, "title").join(w(e, "e_title"), ["item", "_w"]).drop("_w").distinct().withColumn("sim", title_similarity(F.col("title"), F.col("e_title"), False)).where(F.col("sim") >= least)
    best = j.groupBy("item", "article_id").agg(F.min_by("entry_id", F.struct((-F.col("sim")).alias("s"), "entry_id")).alias("entry_id"))
    extras = e.where("entry_type IN ('article', 'review')").join(best.select("entry_id").distinct(), "entry_id", "left_anti").select("item", "entry_id")
    n = articles.groupBy("item").agg(F.count(F.lit(1)).alias("articles")).join(best.groupBy("item").agg(F.count(F.lit(1)).alias("matched")), "item", "left").join(extras.groupBy("item").agg(F.count(F.lit(1)).alias("extras")), "item", "left")
    return n.na.fill(0), extras


def annotated_entries(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Entries (item, entry_id, …) with ``ill_evidence``: the anchors that were matched with them as (anchor_id, match, score),
    in order, empty if none. An entry of popular articles has as many as were asked for."""
    g = hits.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("anchor_id", "match", "score"))).alias("ill_evidence"))
    return entries.join(g, "entry_id", "left").withColumn("ill_evidence", F.coalesce("ill_evidence", F.array().cast("array<struct<anchor_id:bigint,match:string,score:int>>")))


def confirmed_entries(annotated: DataFrame) -> DataFrame:
    """(item, entries, confirmed): how many entries have evidence, by item and for all (item null)."""
    return annotated.rollup("item").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.size("ill_evidence") > 0).alias("confirmed"))


def variants(**tables: DataFrame) -> DataFrame:
    """Tables of one shape under each other, with their names as ``variant``."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("variant", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def technique_totals(entries: DataFrame) -> DataFrame:
    """(variant, item, entries, placed, pages): per technique and item, per technique (item null) and for all (both null)."""
    pages = F.coalesce(F.greatest(F.col("stop") - F.col("start") + 1, F.lit(0)), F.lit(0))
    return entries.rollup("variant", "item").agg(F.count(F.lit(1)).alias("entries"), F.count("start").alias("placed"), F.sum(pages).cast("bigint").alias("pages"))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
