"""Layout blocks and tables of scanned issues: printed contents, running heads, candidates for titles and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions.text import STOP_EVIDENCE, tokens

# Words that may be lower case in a name, words that begin sentences but no names
PARTICLES = "de del della di da van von der den le la du el al bin ibn ben y ter".split()
NOT_NAMES = (
    "As At In On Of By For From To With The This That These Those Such But Or If So And Nor Yet Has Have Had Is Are Was Were Be Been Being Will Would Should Could Can May Might Must Do Does Did "
    "We Our Us They Their Them He His Him She Her It Its I My Me You Your When Where Why How What Who Also Only Yet Still Now Then"
).split()
# Shapes of names, the first four strict
STRICT_NAMES = (r"\b[A-Z][a-z]+\s+[A-Z]\.\s*[A-Z][a-z]+\b", r"\b[A-Z]{2,}\s+[A-Z]\.?\s*[A-Z]{2,}\b", r"\b[A-Z][a-z]+,\s+[A-Z](\s|\.|$)", r"\b[A-Z]{2,},\s+[A-Z](\s|\.|$)")
LOOSE_NAMES = (r"^[A-Z][a-z]+\s+[A-Z][a-z]+\b", r"^[A-Z][a-z]+\s+\S{1,4}\s+[A-Z][a-z]+\b")
# Headings inside articles, of front and back matter, and of advertisements
NOT_TITLES = (
    "methods|method|materials and methods|results|result|findings|results in children|discussion|conclusion|conclusions|introduction|background|summary|abstract|references|reference|bibliography|"
    "additional references|further reading|related articles|acknowledgments|acknowledgements|acknowledgment|acknowledgement|appendix|appendices|tables|figures|subject index|author index|index of authors|"
    "index of first authors or sources|index of authors or sources-continued from page iv|table of contents|contents|precautions|adverse reactions|dosage and administration|contraindications|indications|"
    "warnings|how supplied|prescribing information|indications and usage|clinical pharmacology|communications|letters to the editor|letters|correspondence|editorial|editorials|errata|erratum|in this issue|"
    "from the editor|editor's note|editor|book reviews|book review|publications received|address changes|address correction|subscriptions|announcements|notices|calendar|official publication|articles|"
    "research articles|original articles|invited articles|features|departments|news|abstracts|acknowledgment of reviewers|past editors"
).split("|")
TABLE_OR_FIGURE = r"(?i)^(table|figure|fig\.?)\s*([0-9]+|[ivxlc]+)\b"
TRADEMARK = r"(?i)[™®©℠]|\(\s*R\s*\)|\(\s*TM\s*\)"
LISTED_DEGREES = r"(?i)[,.]\s*(M\.?\s*D\.?|Ph\.?\s*D\.?|MA|MS|MPH|MSc|R\.?\s*N\.?|D\.?\s*O\.?|RD|PhD|Sc\.?\s*D\.?|Jr\.?|Sr\.?|II|III|FRCP|FRCS|FACP|MHA|EdD|DSc|FAAN|CNS|CNAA|APRN|BC|CTN|FACOG|FACS)\.?\b"
DRUG_AD_TITLE = r"(?i)^(dosage\s+and\s+administration|indications(\s+and\s+usage)?|contraindications|adverse\s+reactions|precautions|warnings|how\s+supplied|prescribing\s+information|clinical\s+pharmacology)\s*[:.\-]"
HEADS = ("section_header", "title", "paragraph_header")
PAGE_RANGE = r"([0-9]+)\s*[-–—]\s*([0-9]+)"


def text_label(c: Column) -> Column:
    """The lower-case name of a label written as an enumeration's member: 'section_header' of "DocItemLabel.SECTION_HEADER'>"."""
    return F.lower(F.rtrim(F.element_at(F.split(c, "[.]"), -1), F.lit("'>")))


def any_shape(c: Column, shapes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for s in shapes:
        hit = hit | c.rlike(s)
    return hit


def byline(c: Column) -> Column:
    """Whether a text of 3 to 300 characters may be a line of authors: 'by' before it, a degree in it, a strict name shape, or
    a loose one with a connector or in at most 30 characters."""
    from foliant.functions.text import CREDENTIALS

    body = F.trim(F.regexp_replace(c, r"(?i)^by\s+", ""))
    loose = (body.rlike(r",|\s+and\s+|\s*&\s*|;") | (F.length(body) <= 30)) & any_shape(body, LOOSE_NAMES)
    return F.coalesce(F.length(c).between(3, 300) & ((body != F.trim(c)) | body.rlike(CREDENTIALS) | any_shape(body, STRICT_NAMES) | loose), F.lit(False))


def author_part(c: Column) -> Column:
    """Whether a string may be one author's name: 2 to 60 characters, one to five words, the first with a capital and no word
    that begins sentences, at most one other in lower case that is no particle."""
    words = F.split(F.trim(c), r"\s+")
    first = F.get(words, F.lit(0))
    low = F.filter(F.slice(words, 2, 5), lambda w: (w == F.lower(w)) & (w != F.upper(w)) & ~w.isin(PARTICLES))
    return F.coalesce(F.length(c).between(2, 60) & (F.size(words) <= 5) & first.rlike(r"^\p{Lu}") & ~first.isin(NOT_NAMES) & (F.size(low) <= 1), F.lit(False))


def parse_names(c: Column) -> Column:
    """The names of a byline, in order: without 'by' and degrees, parts at commas, ';', '&' and 'and'; capitals throughout become
    names, and what doesn't look like a name is left out."""
    from foliant.functions.text import CREDENTIALS

    body = F.trim(F.regexp_replace(c, r"(?i)^by\s+", ""))
    chars = lambda x: F.split(x, "")
    titled = lambda x: F.array_join(F.transform(chars(x), lambda ch, i: F.when((i > 0) & F.get(chars(x), i - 1).rlike(r"\p{L}"), F.lower(ch)).otherwise(ch)), "")
    clean = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(?i)^(and|or|&)\s+", ""), CREDENTIALS, ""), r"^[ ,.;-]+|[ ,.;-]+$", "")
    names = F.transform(F.split(body, r"\s*,\s*|\s+and\s+|\s*&\s*|\s*;\s*"), clean)
    names = F.transform(F.filter(names, lambda n: (F.length(n) > 1) & n.rlike(r"\p{L}")), lambda n: F.when((n == F.upper(n)) & (n != F.lower(n)), titled(n)).otherwise(n))
    return F.filter(names, author_part)


def titleish(c: Column) -> Column:
    """Whether a text reads like a title: 10 to 200 characters, three words, no full stop at the end but of an abbreviation."""
    t = F.trim(c)
    return F.coalesce(F.length(t).between(10, 200) & (~t.rlike(r"\.$") | t.rlike(r"(Inc|Co|Jr|Sr|Ltd|ed)\.$")) & (F.length(t) - F.length(F.regexp_replace(t, " ", "")) >= 2), F.lit(False))


def promoted(c: Column) -> Column:
    """Whether a large text counts as a heading: never, as a trial found no gain in it."""
    return F.lit(False) & c.isNotNull()


def start_reasons(candidates: DataFrame) -> DataFrame:
    """Adds ``reason``: why a heading (title, byline, boxes: how many check boxes are among the next eight blocks) begins no
    article, null if it may. In order: short, heading (no title), table, trademark, degrees, drug, form."""
    from foliant.functions.text import strip_section_label

    t = strip_section_label(F.regexp_replace(F.trim("title"), r"\s+", " "))
    trade = t.rlike(TRADEMARK) | F.coalesce(F.col("byline").rlike(TRADEMARK), F.lit(False))
    reason = (
        F.when(F.coalesce(F.length(t), F.lit(0)) < 5, "short")
        .when(F.lower(t).isin(NOT_TITLES), "heading")
        .when(t.rlike(TABLE_OR_FIGURE), "table")
        .when(trade, "trademark")
        .when(t.rlike(LISTED_DEGREES), "degrees")
        .when(t.rlike(DRUG_AD_TITLE), "drug")
        .when(F.col("boxes") >= 2, "form")
    )
    return candidates.withColumn("reason", reason)


def boxes_ahead(blocks: DataFrame, ahead: int = 7) -> DataFrame:
    """Adds ``boxes``: how many check boxes are among a block and the ``ahead`` after it on its page."""
    down = W.partitionBy("item", "page_no").orderBy("idx", "block_id").rowsBetween(0, ahead)
    return blocks.withColumn("boxes", F.sum(F.col("label").isin("checkbox_unselected", "checkbox_selected").cast("int")).over(down))


def upper_median_heights(blocks: DataFrame) -> DataFrame:
    """(item, page_no, height): the upper median of the heights of a page's text blocks."""
    h = blocks.where("label = 'text' AND bbox IS NOT NULL").withColumn("h", F.abs(F.col("bbox.t") - F.col("bbox.b"))).where("h > 0")
    g = h.groupBy("item", "page_no").agg(F.array_sort(F.collect_list("h")).alias("v"))
    return g.select("item", "page_no", F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("height"))


def in_band(blocks: DataFrame, low: float, high: float) -> DataFrame:
    """Blocks whose top is above ``low`` and at most ``high``."""
    return blocks.where((F.col("bbox.t") > low) & (F.col("bbox.t") <= high))


def tall_enough(candidates: DataFrame, share: float = 0.85) -> DataFrame:
    """Candidates (item, …, height) at least ``share`` of the median height of their item's."""
    return candidates.withColumn("_m", F.median("height").over(W.partitionBy("item"))).where(F.col("height") >= share * F.col("_m")).drop("_m")


def first_places(blocks: DataFrame) -> DataFrame:
    """(block_id, page_no, top, height, left, right): where a block is; 0 for what isn't known."""
    zero = lambda c: F.coalesce(F.col(f"bbox.{c}"), F.lit(0.0))
    height = F.coalesce(F.abs(F.col("bbox.t") - F.col("bbox.b")), F.lit(0.0))
    return blocks.select("block_id", "page_no", zero("t").alias("top"), height.alias("height"), zero("l").alias("left"), zero("r").alias("right"))


def prompt_blocks(blocks: DataFrame, least: int = 20) -> DataFrame:
    """(item, n, block_id): headings, and texts of at least ``least`` characters, down the pages of an item."""
    down = W.partitionBy("item").orderBy("page_no", F.desc("top"), "block_id")
    b = blocks.where(F.col("label").isin(*HEADS) | ((F.col("label") == "text") & (F.length(F.trim("text")) >= least))).withColumn("top", F.coalesce("bbox.t", F.lit(0.0)))
    return b.select("item", F.row_number().over(down).alias("n"), "block_id")


def head_ranges(blocks: DataFrame) -> DataFrame:
    """(item, block_id, leaf, first_page, last_page): the first page range in a running head or foot that may be one: no number
    between 1900 and 2100, of at most four digits, not backwards, not of more than 200 pages."""
    b = blocks.where("label IN ('page_header', 'page_footer') AND page_no IS NOT NULL AND text IS NOT NULL")
    pairs = F.zip_with(F.regexp_extract_all("text", F.lit(PAGE_RANGE), F.lit(1)), F.regexp_extract_all("text", F.lit(PAGE_RANGE), F.lit(2)), lambda a, z: F.struct(a.try_cast("int").alias("a"), z.try_cast("int").alias("z"), F.greatest(F.length(a), F.length(z)).alias("n")))
    year = lambda c: c.between(1900, 2100)
    good = F.filter(pairs, lambda p: (p["n"] <= 4) & ~year(p["a"]) & ~year(p["z"]) & (p["z"] >= p["a"]) & (p["z"] - p["a"] <= 200))
    return b.withColumn("p", F.get(good, F.lit(0))).where("p IS NOT NULL").select("item", "block_id", (F.col("page_no") - 1).cast("int").alias("leaf"), F.col("p.a").alias("first_page"), F.col("p.z").alias("last_page"))


# ---------------------------------------------------------------- printed contents


def page_token(c: Column) -> Column:
    """A number from 1 to 2000 by itself."""
    return F.coalesce(F.trim(c).rlike("^[0-9]{1,4}$") & F.trim(c).try_cast("int").between(1, 2000), F.lit(False))


def contents_line(c: Column) -> Column:
    """Whether a line of a printed contents page may name an article: four content words, fewer than two lettered page numbers,
    no short name by itself, at most 85 % capitals among its letters."""
    letters, upper = F.length(F.regexp_replace(c, r"[^A-Za-z]", "")), F.length(F.regexp_replace(c, r"[^A-Z]", ""))
    name = F.trim(c).rlike(r"^[A-Z][a-z]+\.?\s+[A-Z]\.?\s+[A-Z][a-z]+") & (F.size(F.split(F.trim(c), r"\s+")) <= 8)
    lettered = F.size(F.regexp_extract_all(c, F.lit(r"\b([0-9]+\s*[A-Z])\b"), F.lit(1)))
    return F.coalesce((F.size(tokens(c, STOP_EVIDENCE, 3)) >= 4) & (lettered < 2) & ~name & ((letters == 0) | (upper <= 0.85 * letters)), F.lit(False))


def inside_boxes(cells: DataFrame, boxes: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Text cells (item, page_no, block_id, l, t, b, text) inside a table's box (item, page_no, l, t, r, b) from top to bottom,
    with the box's right edge as ``box_r``; pieces of the page's frame (layer 'furniture') are left out. Cells meet boxes on the
    page."""
    x = boxes.select("item", "page_no", F.greatest("t", "b").alias("_top"), F.least("t", "b").alias("_bottom"), F.col("r").alias("box_r"))
    j = cells.where("coalesce(content_layer, '') <> 'furniture'").join(x, ["item", "page_no"])
    return j.where((F.least("t", "b") >= F.col("_bottom") - tolerance) & (F.greatest("t", "b") <= F.col("_top") + tolerance)).drop("_top", "_bottom")


def anchored_rows(cells: DataFrame, column: float = 80.0, line: float = 12.0) -> DataFrame:
    """(item, page_no, n, title, page): entries of a printed contents page, from cells (item, page_no, block_id, l, t, text, box_r).

    Cells from top to bottom form a row while each is at most ``line`` below the one before it. A row with a page number in the
    rightmost ``column`` ends an entry: its own words come first, then those of the rows without a number since the entry before.
    The grouping is by the number that follows, counted from below; titles need three letters in a row and over five characters.
    """
    down = W.partitionBy("item", "page_no").orderBy(F.desc("t"), "l", "block_id")
    c = cells.where("trim(text) <> ''").withColumn("_b", F.when(F.lag("t").over(down) - F.col("t") > line, 1).otherwise(0)).withColumn("row", F.sum("_b").over(down.rowsBetween(W.unboundedPreceding, 0)))
    number = (F.col("l") >= F.col("box_r") - column) & page_token(F.col("text"))
    word = ~number & F.col("text").rlike("[A-Za-z]{3,}")
    part = F.struct("l", "block_id", F.trim("text").alias("text"))
    rows = c.groupBy("item", "page_no", "row").agg(F.max_by(F.when(number, F.trim("text").cast("int")), F.when(number, F.struct("l", "block_id"))).alias("page"), F.array_sort(F.collect_list(F.when(word, part))).alias("parts"))
    rows = rows.withColumn("entry", F.count("page").over(W.partitionBy("item", "page_no").orderBy(F.desc("row")).rowsBetween(W.unboundedPreceding, 0))).where("entry > 0")
    own = F.when(F.col("page").isNotNull(), 0).otherwise(1)
    g = rows.groupBy("item", "page_no", "entry").agg(F.max("page").alias("page"), F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct(own.alias("own"), "row", "parts"))).alias("r"))
    text = F.array_join(F.transform(F.flatten(F.transform("r", lambda x: x["parts"])), lambda p: p["text"]), " ")
    g = g.withColumn("title", F.trim(F.regexp_replace(text, r"\s+", " "))).where("length(title) > 5")
    return g.select("item", "page_no", F.row_number().over(W.partitionBy("item", "page_no").orderBy("row")).alias("n"), "title", "page")


def best_contents(entries: DataFrame, headed: DataFrame, runs: DataFrame, least: int = 3) -> DataFrame:
    """(item, first_page, last_page, n, score): the run of pages that looks most like the contents.

    Entries (item, page_no, n, page) of a run score one each, once more by the share of neighbours whose page numbers don't
    fall, and 5 for a run with a page in ``headed`` (item, page_no). The first of equals; runs of fewer than ``least`` are none.
    """
    e = entries.join(runs.select("item", "first_page", "last_page"), "item").where(F.col("page_no").between(F.col("first_page"), F.col("last_page")))
    along = W.partitionBy("item", "first_page").orderBy("page_no", "n")
    e = e.withColumn("up", (F.col("page") >= F.lag("page").over(along)).cast("int"))
    g = e.groupBy("item", "first_page", "last_page").agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("up"))
    h = headed.join(runs.select("item", "first_page", "last_page"), "item").where(F.col("page_no").between(F.col("first_page"), F.col("last_page"))).select("item", "first_page", F.lit(5.0).alias("bonus")).distinct()
    rising = F.when(F.col("n") > 1, F.col("up") / (F.col("n") - 1)).otherwise(0.0)
    g = g.join(h, ["item", "first_page"], "left").withColumn("score", F.round(F.col("n") * (1 + rising) + F.coalesce("bonus", F.lit(0.0)), 6))
    best = g.groupBy("item").agg(F.min_by(F.struct("first_page", "last_page", "n", "score"), F.struct((-F.col("score")).alias("s"), "first_page")).alias("b"))
    return best.select("item", "b.*").where(F.col("n") >= least)


def insert_entries(existing: DataFrame, found: DataFrame) -> DataFrame:
    """(item, entry_id, start, stop): entries with those found later, in the order of their starts (unknown ones as 0, existing
    ones first); each ends before the next begins, never before it starts; the last keeps its own stop."""
    both = existing.select("item", "entry_id", "start", "stop", F.lit(0).alias("o")).unionByName(found.select("item", "entry_id", "start", "stop", F.lit(1).alias("o")))
    both = both.withColumn("start", F.coalesce("start", F.lit(0)))
    order = W.partitionBy("item").orderBy("start", "o", "entry_id")
    stop = F.coalesce(F.lead("start").over(order) - 1, F.col("stop"), F.col("start"))
    return both.withColumn("stop", F.greatest(F.col("start"), stop).cast("int")).select("item", "entry_id", "start", "stop")


# ---------------------------------------------------------------- tables and engines


def engine_name(c: Column) -> Column:
    """The text recogniser of a scan by its family; '(none)' where it isn't said."""
    low = F.lower(c)
    named = F.when(low.contains("tesseract"), "tesseract").when(low.contains("abbyy"), "abbyy").when(low.contains("google-cloud-vision"), "google-cloud-vision").otherwise(low)
    return F.when(c.isNull() | c.isin("", "(none)"), "(none)").otherwise(named)


def table_metrics(cells: DataFrame) -> DataFrame:
    """(item, engine, tables, cells, with_text, anchored): of cells (item, engine, table_pos, row, text), how many tables and
    cells, how many with text, and in how many rows a page number stands beside a word of four letters."""
    filled = F.coalesce(F.trim("text") != "", F.lit(False))
    rows = cells.groupBy("item", "engine", "table_pos", "row").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(filled).alias("with_text"), F.coalesce(F.max(page_token(F.col("text"))) & F.max(F.col("text").rlike("[A-Za-z]{4,}")), F.lit(False)).alias("anchored")
    )
    return rows.groupBy("item", "engine").agg(F.count_distinct("table_pos").alias("tables"), F.sum("cells").alias("cells"), F.sum("with_text").alias("with_text"), F.count_if(F.col("anchored") & F.col("row").isNotNull()).alias("anchored"))


def engine_summary(metrics: DataFrame) -> DataFrame:
    """(engine, items, tables, median_anchored, mean_anchored) of ``table_metrics``."""
    return metrics.groupBy(engine_name(F.col("engine")).alias("engine")).agg(F.count(F.lit(1)).alias("items"), F.sum("tables").alias("tables"), F.median("anchored").alias("median_anchored"), F.round(F.avg("anchored"), 6).alias("mean_anchored"))


def stale_layouts(items: DataFrame, cells: DataFrame) -> DataFrame:
    """(item) of layouts that have to be made again: they have tables but no cell with text. ``items``: item, tables;
    ``cells``: item, text."""
    told = cells.where("trim(text) <> ''").select("item").distinct()
    return items.where("tables > 0").select("item").join(told, "item", "left_anti")
