"""Contents entries and layout blocks: spans, filters, merging, headings, segmentation, evidence."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions.pages import format_leaf, zero_based
from foliant.functions.text import STOP_FILTER, overlap, tokens

# Words of advertisements, drug advertisements and editorial bylines; titles before and after the articles
ADVERT = r"\b(ASKING|BUY|ORDER|CALL|FREE|MAIL|SAVE|WRITE TO|PLEASE SEND|SUBSCRIBE|\$[0-9]|YOUR PATIENT|LOOK FOR|WE ACCEPT)\b"
DRUG_AD = r"\b(ADVERSE\s+REACTIONS?|INDICATIONS?|DOSAGE\s+AND\s+ADMIN|PRECAUTIONS?|CONTRAINDICATIONS?|HOW\s+SUPPLIED|PRESCRIBING\s+INFORMATION|COMPOSITION|WARNINGS?|N\.?F\.?\s+Units|MG\.?\s*PER|TABLETS|CAPSULES)\b|[®™©]"
EDITOR = r"(?i)\b(editor|editorial|editor-in-chief|managing|publisher|chairman|board|administration)\b"
FRONT_TITLE = r"^(preface|foreword|introduction|editorial board|contents|table of contents|editor'?s notes?|from the editor|editorial|publication information|masthead|in this issue|forthcoming|recent issues|notices?|open forum|announcements?|call for papers)\b"
BACK_TITLE = r"^(index|subject index|author index|bibliography|references|errata|colophon|advertisements?|back matter|publications? received|in memoriam|memorials?)\b"
CONTENTS_HEADING = r"(?i)\b(contents|table\s+of\s+contents)\b"


def entry_kind(title: Column) -> Column:
    t = F.lower(F.trim(title))
    return F.when(t.rlike(FRONT_TITLE), "frontmatter").when(t.rlike(BACK_TITLE), "backmatter").otherwise("article")


def short_label(title: Column) -> Column:
    """A section label rather than a title: no lower-case letter, under 50 characters, four content words at most, no '?!.' at
    the end."""
    t = F.trim(F.regexp_replace(title, r"\s+", " "))
    words = F.filter(F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z'-]*)"), F.lit(1)), lambda w: ~F.lower(w).isin(STOP_FILTER))
    return F.coalesce((t != "") & (F.length(t) < 50) & ~t.rlike(r"\p{Ll}") & (F.size(words) <= 4) & ~t.rlike("[?!.]$"), F.lit(False))


def real_author(names: Column) -> Column:
    """Whether a list has a name of at most 60 characters and a strict shape that is no editor's."""
    from foliant.operators.layout import STRICT_NAMES, any_shape

    return F.coalesce(F.exists(names, lambda x: (F.length(F.trim(x)) <= 60) & ~x.rlike(EDITOR) & any_shape(F.trim(x), STRICT_NAMES)), F.lit(False))


def filter_reasons(entries: DataFrame, leaves: str = "page_count") -> DataFrame:
    """Adds ``reason``: why an entry (title, names, start, page_count) is no article, null if it may be one; the first of
    label (but not over a real author's name), advert, editorial, pharma_ad, fake_byline (names, but none of at most 60
    characters with the shape of one), front_matter (first 5 %), back_matter_index (a label in the last 10 %)."""
    from foliant.operators.layout import LOOSE_NAMES, STRICT_NAMES, any_shape

    t, n, total = F.col("title"), F.col("names"), F.col(leaves)
    says = lambda pattern: F.coalesce(F.exists(n, lambda x: x.rlike(pattern)), F.lit(False))
    shaped = F.exists(n, lambda x: (F.length(F.trim(x)) <= 60) & any_shape(F.trim(x), (*STRICT_NAMES, *LOOSE_NAMES)))
    label = short_label(t) & ~real_author(n)
    reason = (
        F.when(label, "label")
        .when(F.upper(t).rlike(ADVERT), "advert")
        .when(says(EDITOR), "editorial")
        .when(says(DRUG_AD), "pharma_ad")
        .when(F.coalesce((F.size(n) > 0) & ~shaped, F.lit(False)), "fake_byline")
        .when(F.col("start") < F.floor(total * 5 / 100), "front_matter")
        .when((F.col("start") >= F.floor(total * 90 / 100)) & label, "back_matter_index")
    )
    return entries.withColumn("reason", reason)


def merge_weak(entries: DataFrame, gap: int = 3) -> DataFrame:
    """(item, entry_id, start): entries (item, entry_id, start, strong) that stay when one closer than ``gap`` to the last that
    stayed is taken for a part of it, unless it is ``strong`` (has a real author). What stays depends on what did before, so it
    is a fold over the item's entries in order; an item's contents are a few hundred. Unknown starts count as 0."""
    e = entries.where("item IS NOT NULL").select("item", F.struct(F.coalesce("start", F.lit(0)).alias("start"), "entry_id", "strong").alias("e"))
    rows = e.groupBy("item").agg(F.array_sort(F.collect_list("e")).alias("es"))
    kind = "struct<start:int,entry_id:bigint,strong:boolean>"
    kept = F.aggregate("es", F.array().cast(f"array<{kind}>"), lambda acc, x: F.when((F.size(acc) > 0) & ~x["strong"] & (x["start"] - F.element_at(acc, -1)["start"] < gap), acc).otherwise(F.concat(acc, F.array(x.cast(kind)))))
    return rows.select("item", F.explode(kept).alias("x")).select("item", "x.entry_id", "x.start")


def spans(entries: DataFrame, last: str) -> DataFrame:
    """(item, entry_id, start, stop): an entry ends before the next start of its item, the last at ``last``; never before it
    starts. Null starts are left out."""
    w = W.partitionBy("item").orderBy("start", "entry_id")
    stop = F.coalesce(F.lead("start").over(w) - 1, F.col(last))
    return entries.where("start IS NOT NULL").select("item", "entry_id", "start", F.greatest(F.col("start"), stop).cast("int").alias("stop"))


def merged_starts(entries: DataFrame, gap: int = 3) -> DataFrame:
    """(item, start): starts that stay when one closer than ``gap`` to the last kept start is merged into it. The outcome
    depends on what was kept before, so it is a fold over the item's distinct starts in order."""
    starts = entries.where("item IS NOT NULL AND start IS NOT NULL").groupBy("item").agg(F.array_sort(F.collect_set("start")).alias("s"))
    kept = F.aggregate("s", F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(x))).otherwise(acc))
    return starts.select("item", F.explode(kept).alias("start"))


def stacked_headers(blocks: DataFrame, most_gap: float = 80.0) -> DataFrame:
    """(item, page_no, first_idx, n, text): consecutive header blocks of a page whose tops are within ``most_gap`` become one."""
    w = W.partitionBy("item", "page_no").orderBy("idx")
    h = blocks.where("item IS NOT NULL").withColumn("is_head", F.col("label").isin("section_header", "title"))
    h = h.withColumn("_break", F.when(F.coalesce(F.lag("is_head").over(w), F.lit(False)) & F.col("is_head") & (F.abs(F.lag("bbox.t").over(w) - F.col("bbox.t")) <= most_gap), 0).otherwise(1))
    h = h.withColumn("_run", F.sum("_break").over(w)).where("is_head AND text IS NOT NULL")
    g = h.groupBy("item", "page_no", "_run").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"))
    return g.select("item", "page_no", F.col("t")[0]["idx"].alias("first_idx"), F.size("t").alias("n"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def delimited_groups(blocks: DataFrame, delimiter: str = "^[0-9]{1,4}$") -> DataFrame:
    """(item, part, first_idx, n): runs of blocks between those that are just a number."""
    w = W.partitionBy("item").orderBy("idx")
    b = blocks.where("item IS NOT NULL").withColumn("_is", F.coalesce(F.trim("text").rlike(delimiter), F.lit(False)))
    b = b.withColumn("part", F.sum(F.col("_is").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("NOT _is")
    return b.groupBy("item", "part").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n"))


def blank_pages(blocks: DataFrame, least: int = 50) -> DataFrame:
    """(item, page_no, n_chars) of pages whose blocks of five letters or digits and more have under ``least`` of them."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]", ""))
    return blocks.groupBy("item", "page_no").agg(F.sum(F.when(n >= 5, n).otherwise(0)).alias("n_chars")).where(F.col("n_chars") < least)


def content_above_title(blocks: DataFrame) -> DataFrame:
    """(item, page_no, above): whether text stands higher on the page than its first heading; pages without one are left out."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]", ""))
    heads = F.when(F.col("label").isin("section_header", "title") & F.col("bbox").isNotNull(), F.col("bbox.t"))
    pages = blocks.groupBy("item", "page_no").agg(F.max(heads).alias("top"), F.max(F.when((F.col("label") == "text") & (n >= 5), F.col("bbox.b"))).alias("text_bottom"))
    return pages.where("top IS NOT NULL").select("item", "page_no", F.coalesce(F.col("text_bottom") > F.col("top") + 5, F.lit(False)).alias("above"))


def contents_pages(blocks: DataFrame) -> DataFrame:
    """(item, page_no) of pages with a short block, of the page itself and not its frame, that says 'contents'."""
    short = (F.length("text") <= 60) & (F.coalesce("content_layer", F.lit("")) != "furniture")
    return blocks.where(short & F.col("text").rlike(CONTENTS_HEADING)).select("item", "page_no").distinct()


def toc_pages(blocks: DataFrame) -> DataFrame:
    """(item, page_no) of pages with a heading that says nothing but '(table of) contents'."""
    said = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    return blocks.where(F.col("label").isin("section_header", "title", "paragraph_header") & said.isin("contents", "table of contents")).select("item", "page_no").distinct()


def layout_to_legacy(entries: DataFrame) -> DataFrame:
    """1-based model entries as page-index entries: identifiers, printed pair or null for 0, fixed confidence."""
    s, e = zero_based(F.col("start"), F.col("stop"))
    printed = F.when(F.col("first_page") > 0, F.concat_ws("-", F.col("first_page"), F.when(F.col("last_page") > 0, F.col("last_page")).otherwise(F.col("first_page"))))
    return entries.select("item", "entry_id", "title", format_leaf(s).alias("first_leaf"), format_leaf(e).alias("last_leaf"), printed.alias("printed"), F.lit(0.9).alias("confidence"))


def title_in_contents(entries: DataFrame, blocks: DataFrame, on: str = "item", least: float = 0.5) -> DataFrame:
    """(entry_id, best): entries whose title shares at least ``least`` of its words with some heading of the item; candidates
    meet on (item, word), never as all pairs."""
    e = entries.select(on, "entry_id", F.array_distinct(tokens(F.col("title"), STOP_FILTER, 3)).alias("et"))
    h = blocks.select(on, "block_id", F.array_distinct(tokens(F.col("text"), STOP_FILTER, 3)).alias("bt"))
    met = e.withColumn("w", F.explode("et")).join(h.withColumn("w", F.explode("bt")), [on, "w"]).select("entry_id", "block_id", "et", "bt").distinct()
    good = met.withColumn("s", overlap(F.col("et"), F.col("bt"))).where(F.col("s") >= least)
    return good.groupBy("entry_id").agg(F.min("block_id").alias("first_block"), F.count(F.lit(1)).alias("n_blocks"))


def segment_blocks(blocks: DataFrame) -> DataFrame:
    """(item, page_no, title, byline): articles found by going down each page: a heading, and the first short block after it,
    which is its byline if it looks like one. Blank blocks and texts of over 300 characters are passed over; a title counts
    where it stands first in the item, and from five characters on."""
    from foliant.operators.layout import byline

    b = blocks.where("item IS NOT NULL AND page_no IS NOT NULL").withColumn("t", F.trim(F.regexp_replace("text", r"\s+", " "))).withColumn("head", F.col("label").isin("section_header", "title"))
    b = b.where((F.col("t") != "") & (F.col("head") | (F.length("t") <= 300)))
    down = W.partitionBy("item", "page_no").orderBy("idx", "block_id")
    b = b.withColumn("title", F.when(F.lag("head").over(down), F.lag("t").over(down))).where("NOT head AND length(title) >= 5")
    first = F.row_number().over(W.partitionBy("item", F.lower("title")).orderBy("page_no", "idx", "block_id"))
    return b.withColumn("_n", first).where("_n = 1").select("item", "page_no", "title", F.when(byline(F.col("t")), F.col("t")).alias("byline"))


def model_pages(pages: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Per-page model output as (contents rows, article starts); fences around the JSON don't matter."""
    from foliant.functions.text import strip_fences

    j = F.from_json(strip_fences(F.col(payload)), "category string, page string, articles array<struct<title:string,authors:string,doi:string,printed_page:string>>, table_of_contents array<struct<title:string,page:string>>")
    p = pages.withColumn("j", j)
    toc = p.select("item", "pdf_page", F.inline("j.table_of_contents"))
    articles = p.where("j.category = 'article_start'").select("item", "pdf_page", F.inline("j.articles"))
    return toc, articles


