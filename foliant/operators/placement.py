"""Putting articles on pages: printed-page maps, titles found in blocks, ends by what follows, relocation, agreement of maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions.text import STOP_PLACE, tokens


def overlay_maps(*maps: DataFrame) -> DataFrame:
    """(item, label, page): maps laid over each other, the first that has a label wins; labels compare in lower case, and in one
    map the smallest page of a label counts."""
    both = None
    for rank, m in enumerate(maps):
        m = m.select("item", F.lower(F.trim(F.col("label").cast("string"))).alias("label"), F.col("page").cast("int").alias("page"), F.lit(rank).alias("rank"))
        both = m if both is None else both.unionByName(m)
    return both.where("label <> ''").groupBy("item", "label").agg(F.min_by("page", F.struct("rank", "page")).alias("page"))


def title_places(articles: DataFrame, blocks: DataFrame, least: float = 0.5, skip_pages: DataFrame | None = None) -> DataFrame:
    """(item, article_id, page, score): the block that best shows each article's title.

    Recall of the title's words must reach ``least``; blocks that aren't headings need as much precision; headings count half as
    much again, a block that is nothing but the title twice one that is hardly so, each page away from the hinted one a
    thousandth less; the first block of equals. Candidates meet on (item, word).
    ``articles``: item, article_id, title, hint; ``blocks``: item, block_id, page_no, label, text.
    """
    words = lambda c: F.array_distinct(tokens(c, STOP_PLACE, 3))
    a = articles.select("item", "article_id", "hint", words(F.col("title")).alias("tw")).where(F.size("tw") > 0)
    b = blocks.where("text IS NOT NULL AND page_no IS NOT NULL").select("item", "block_id", "page_no", F.col("label").isin("section_header", "title", "paragraph_header").alias("head"), words(F.col("text")).alias("bw"))
    if skip_pages is not None:
        b = b.join(skip_pages.select("item", "page_no").distinct(), ["item", "page_no"], "left_anti")
    met = a.withColumn("w", F.explode("tw")).join(b.withColumn("w", F.explode("bw")), ["item", "w"])
    n = met.groupBy("item", "article_id", "block_id").agg(F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in ("hint", "page_no", "head")], F.first(F.size("tw")).alias("nt"), F.first(F.size("bw")).alias("nb"))
    recall = F.col("shared") / F.col("nt")
    precision = F.col("shared") / F.col("nb")
    good = n.where((recall >= least) & (F.col("head") | (precision >= least)))
    away = F.coalesce(F.abs(F.col("page_no") - F.col("hint")), F.lit(0))
    score = F.round(recall * F.when(F.col("head"), 1.5).otherwise(1.0) * (0.5 + 0.5 * precision) - away * 0.001, 6)
    best = good.groupBy("item", "article_id").agg(F.min(F.struct((-score).alias("s"), "block_id", "page_no")).alias("b"))
    return best.select("item", "article_id", F.col("b.page_no").alias("page"), (-F.col("b.s")).alias("score"))


def place_articles(articles: DataFrame, page_map: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(item, article_id, start, stop, method): printed first and last page through the map; else the title's place with the
    printed length; else the first page alone; else nothing. ``articles``: item, article_id, first_page, last_page (text)."""
    m = page_map.select("item", F.lower(F.col("label").cast("string")).alias("k"), "page")
    s, e = m.select("item", F.col("k").alias("sk"), F.col("page").alias("sp")), m.select("item", F.col("k").alias("ek"), F.col("page").alias("ep"))
    a = articles.withColumn("sk", F.lower("first_page")).withColumn("ek", F.lower("last_page"))
    j = a.join(s, ["item", "sk"], "left").join(e, ["item", "ek"], "left")
    if found is not None:
        j = j.join(found.select("item", "article_id", F.col("page").alias("fp")), ["item", "article_id"], "left")
    else:
        j = j.withColumn("fp", F.lit(None).cast("int"))
    length = F.col("last_page").try_cast("int") - F.col("first_page").try_cast("int")
    length = F.when(length >= 0, length)
    start = F.coalesce("sp", "fp")
    stop = F.when(F.col("sp").isNotNull() & (F.col("ep") >= F.col("sp")), F.col("ep")).otherwise(start + F.coalesce(length, F.lit(0)))
    method = F.when(F.col("sp").isNotNull() & (F.col("ep") >= F.col("sp")), "page_map").when(F.col("sp").isNotNull(), "partial").when(F.col("fp").isNotNull(), "title").otherwise("failed")
    return j.select("item", "article_id", start.cast("int").alias("start"), stop.cast("int").alias("stop"), method.alias("method"))


def ends_before_next(entries: DataFrame, last: str, shared: Column | None = None) -> DataFrame:
    """(item, entry_id, start, stop): an entry ends before the next strictly greater start, or on it where ``shared`` is true
    of it; entries with one start end alike. The distinct starts of an item are looked at, not its pairs."""
    starts = entries.where("start IS NOT NULL").select("item", "start").distinct()
    nxt = starts.withColumn("next", F.lead("start").over(W.partitionBy("item").orderBy("start")))
    j = entries.join(nxt, ["item", "start"])
    less = F.when(shared, 0).otherwise(1) if shared is not None else F.lit(1)
    return j.select("item", "entry_id", "start", F.greatest(F.col("start"), F.coalesce(F.col("next") - less, F.col(last))).cast("int").alias("stop"))


def trim_blank_ends(spans: DataFrame, filled: DataFrame) -> DataFrame:
    """Spans (item, entry_id, start, stop) whose stop is the last page with content in them, or the start. ``filled``: (item,
    page) of pages with content. Pages of a span are made by ``sequence`` and met by equality."""
    each = spans.select("item", "entry_id", "start", "stop", F.explode(F.sequence("start", "stop")).alias("page"))
    last = each.join(filled.select("item", "page").distinct(), ["item", "page"]).groupBy("item", "entry_id").agg(F.max("page").alias("last"))
    return spans.join(last, ["item", "entry_id"], "left").select("item", "entry_id", "start", F.coalesce("last", "start").alias("stop"))


def relocate_shared_starts(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """(item, entry_id, start, stop, moved): entries that share a start with one of another title move to the page whose header
    has their printed page, keeping their length. ``headers``: item, printed, page."""
    w = W.partitionBy("item", "start")
    e = entries.withColumn("_k", F.size(F.collect_set(F.lower("title")).over(w)))
    h = headers.groupBy("item", "printed").agg(F.min("page").alias("to"))
    j = e.join(h, ["item", "printed"], "left")
    go = (F.col("_k") > 1) & F.col("to").isNotNull() & (F.col("to") != F.col("start"))
    return j.select("item", "entry_id", F.when(go, F.col("to")).otherwise(F.col("start")).alias("start"), F.when(go, F.col("to") + F.col("stop") - F.col("start")).otherwise(F.col("stop")).alias("stop"), F.coalesce(go, F.lit(False)).alias("moved"))


def map_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(delta, n): how far two maps (item, label, page) are apart on the labels both have."""
    j = a.select("item", "label", F.col("page").alias("x")).join(b.select("item", "label", F.col("page").alias("y")), ["item", "label"])
    return j.groupBy((F.col("x") - F.col("y")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


def text_lines(words: DataFrame, tolerance: int = 25) -> DataFrame:
    """(item, page, line, y, height, text): words (item, page, x1, y1, x2, y2, text) as lines from top to bottom, with the
    average of their words' tops and heights; a word starts a new line if it is more than ``tolerance`` below the one before."""
    down = W.partitionBy("item", "page").orderBy("y1", "x1", "text")
    w = words.withColumn("_b", F.when(F.col("y1") - F.lag("y1").over(down) > tolerance, 1).otherwise(0)).withColumn("line", F.sum("_b").over(down.rowsBetween(W.unboundedPreceding, 0)))
    g = w.groupBy("item", "page", "line").agg(F.avg("y1").alias("y"), F.avg(F.col("y2") - F.col("y1")).alias("height"), F.array_sort(F.collect_list(F.struct("x1", "y1", "text"))).alias("t"))
    return g.select("item", "page", "line", F.round("y", 6).alias("y"), F.round("height", 6).alias("height"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def title_lines(words: DataFrame, times: float = 1.6, most_gap: int = 150) -> DataFrame:
    """(item, page, y, height, text): the block of large lines in the upper half of a page whose lines are highest on average.

    Lines are of words that begin in the upper half of what is printed; large are those of ``times`` the median height of the
    page's words; a smaller line, or a gap of more than ``most_gap``, ends a block. The higher of equals wins."""
    page = W.partitionBy("item", "page")
    w = words.withColumn("_m", F.median(F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1"))).over(page)).withColumn("_h", F.floor(F.max("y2").over(page) / 2))
    sizes = w.groupBy("item", "page").agg(F.first("_m").alias("_m"))
    lines = text_lines(w.where("y1 <= _h").drop("_m", "_h")).join(sizes, ["item", "page"])
    down = page.orderBy("y", "line")
    lines = lines.withColumn("_big", F.col("height") >= times * F.col("_m"))
    new = F.when(F.col("_big") & ~(F.coalesce(F.lag("_big").over(down), F.lit(False)) & (F.col("y") - F.lag("y").over(down) <= most_gap)), 1).otherwise(0)
    runs = lines.withColumn("_b", new).withColumn("_r", F.sum("_b").over(down.rowsBetween(W.unboundedPreceding, 0))).where("_big")
    g = runs.groupBy("item", "page", "_r").agg(F.min("y").alias("y"), F.round(F.avg("height"), 6).alias("height"), F.array_sort(F.collect_list(F.struct("y", "line", "text"))).alias("t"))
    best = g.groupBy("item", "page").agg(F.max(F.struct("height", (-F.col("y")).alias("n"), "t")).alias("b"))
    return best.select("item", "page", (-F.col("b.n")).alias("y"), F.col("b.height").alias("height"), F.array_join(F.transform("b.t", lambda x: x["text"]), " ").alias("text"))


def table_rows(cells: DataFrame, key: str) -> DataFrame:
    """(key, table_pos, row, text): cells (key, table_pos, row, col, text) as rows of text with bars between; empty cells count."""
    g = cells.where("row IS NOT NULL").groupBy(key, "table_pos", "row").agg(F.array_sort(F.collect_list(F.struct("col", "pos", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
    return g.select(key, "table_pos", "row", F.array_join(F.transform("c", lambda x: x["text"]), " | ").alias("text"))


def claim_blocks(titles: DataFrame, blocks: DataFrame, least_head: float = 0.7, least_text: float = 0.85) -> DataFrame:
    """(item, title_id, block_id, page): each printed title takes the best block no other has taken, in the order of titles;
    headings from ``least_head`` of the title's words, text from ``least_text``; more words, then headings, then earlier pages.

    Candidates are found by joins on (item, word); only the choice, which depends on earlier ones, runs per item in Python, on
    the few candidates of the item's printed titles.
    """
    import pandas as pd

    words = lambda c: F.array_distinct(tokens(c, STOP_PLACE, 3))
    t = titles.select("item", "title_id", words(F.col("title")).alias("tw")).where(F.size("tw") >= 2)
    b = blocks.where("text IS NOT NULL").select("item", "block_id", "page_no", F.col("label").isin("section_header", "title").alias("head"), words(F.col("text")).alias("bw"))
    met = t.withColumn("w", F.explode("tw")).join(b.withColumn("w", F.explode("bw")), ["item", "w"])
    n = met.groupBy("item", "title_id", "block_id").agg(F.count(F.lit(1)).alias("shared"), F.first(F.size("tw")).alias("nt"), F.first("head").alias("head"), F.first("page_no").alias("page_no"))
    share = F.col("shared") / F.col("nt")
    good = n.withColumn("share", share).where(F.when(F.col("head"), share >= least_head).otherwise(share >= least_text))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        pdf = pdf.assign(page_no=pdf["page_no"].fillna(1 << 30)).sort_values(["title_id", "share", "head", "page_no", "block_id"], ascending=[True, False, False, True, True])
        done = set()
        for r in pdf.itertuples():
            if r.title_id not in done and r.block_id not in taken:
                done.add(r.title_id)
                taken.add(r.block_id)
                out.append((r.item, r.title_id, r.block_id, None if r.page_no == 1 << 30 else int(r.page_no)))
        return pd.DataFrame(out, columns=["item", "title_id", "block_id", "page"])

    return good.groupBy("item").applyInPandas(choose, "item string, title_id long, block_id long, page int")


def first_starts(entries: DataFrame) -> DataFrame:
    """(item, first_entry, first_article): the least start of an item's entries, and the start of the first in order that is an
    article by its title; entries without a start don't count."""
    from foliant.operators.contents import entry_kind

    e = entries.where("start IS NOT NULL")
    article = entry_kind(F.coalesce("title", F.lit(""))) == "article"
    return e.groupBy("item").agg(F.min("start").alias("first_entry"), F.min_by(F.when(article, F.col("start")), F.when(article, F.struct("ord", "entry_id"))).alias("first_article"))


def place_unplaced(articles: DataFrame, page_map: DataFrame, blocks: DataFrame, texts: DataFrame, margin: int = 200) -> DataFrame:
    """(item, article_id, leaf, method): articles (item, article_id, title, page) that no printed page led to, by the first that
    answers: the map in any case of letters ('page_map'), a heading with half of the title's words ('heading'), the printed page
    by itself within ``margin`` characters of either end of a leaf's text ('margin'), the title's words in the upper third of a
    leaf's text ('text': 0.4 of them from four words on, else 0.5). The best, then the earliest, leaf of equals.

    Candidates meet on (item, word) or (item, label). ``page_map``: item, label, leaf; ``blocks``: item, page_no, label, text;
    ``texts``: item, leaf, text.
    """
    words = lambda c: F.array_distinct(tokens(c, STOP_PLACE, 3))
    key = ["item", "article_id"]
    a = articles.select(*key, F.lower(F.trim("page")).alias("p"), words(F.col("title")).alias("tw"))
    tw = a.where(F.size("tw") > 0).select(*key, F.size("tw").alias("n"), F.explode("tw").alias("w"))
    by_map = a.join(page_map.select("item", F.lower(F.trim("label")).alias("p"), "leaf"), ["item", "p"]).groupBy(*key).agg(F.min("leaf").alias("l1"))

    def best(parts: DataFrame, least, name: str) -> DataFrame:
        met = tw.join(parts, ["item", "w"]).groupBy(*key, "leaf", "part").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
        good = met.where(F.col("k") >= least * F.col("n"))
        return good.groupBy(*key).agg(F.min_by("leaf", F.struct((-F.col("k") / F.col("n")).alias("s"), "leaf", "part")).alias(name))

    heads = blocks.where("label IN ('title', 'section_header') AND page_no IS NOT NULL AND text IS NOT NULL").select("item", (F.col("page_no") - 1).cast("int").alias("leaf"), F.col("block_id").alias("part"), F.explode(words(F.col("text"))).alias("w"))
    ends = F.concat_ws(" ", F.substring("text", 1, margin), F.substring(F.col("text"), F.greatest(F.length("text") - margin + 1, F.lit(1)), F.lit(margin)))
    seen = texts.select("item", F.col("leaf").cast("int").alias("leaf"), F.explode(F.array_distinct(F.split(F.lower(ends), r"[^a-z0-9]+"))).alias("p")).where("p <> ''")
    by_margin = a.join(seen, ["item", "p"]).groupBy(*key).agg(F.min("leaf").alias("l3"))
    third = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 3).cast("int"))
    upper = texts.select("item", F.col("leaf").cast("int").alias("leaf"), F.lit(0).cast("bigint").alias("part"), F.explode(words(third)).alias("w"))
    j = a.select(*key).join(by_map, key, "left").join(best(heads, F.lit(0.5), "l2"), key, "left").join(by_margin, key, "left").join(best(upper, F.when(F.col("n") >= 4, 0.4).otherwise(0.5), "l4"), key, "left")
    method = F.when(F.col("l1").isNotNull(), "page_map").when(F.col("l2").isNotNull(), "heading").when(F.col("l3").isNotNull(), "margin").when(F.col("l4").isNotNull(), "text").otherwise("failed")
    return j.select(*key, F.coalesce("l1", "l2", "l3", "l4").cast("int").alias("leaf"), method.alias("method"))
