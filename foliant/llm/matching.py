"""Request records and contents entries that describe the same article, by loopy belief propagation over candidate pairs."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.operators.skew import salted_join
from foliant.session import cut, release

# Log odds of the evidence, set by how often it goes with true and with false pairs of one issue
PRIOR = -2.5
TITLE = ((0.9, 5.0), (0.78, 3.5), (0.65, 1.5), (0.5, -1.0), (0.0, -5.0))
PAGE_SAME, PAGE_NEAR, PAGE_INSIDE, PAGE_OTHER = 3.0, 1.0, -1.0, -4.0
END_SAME, END_OTHER = 1.0, -1.5
LEAF_SAME, LEAF_NEAR, LEAF_OTHER = 1.5, 0.0, -1.2
AUTHOR_SAME, AUTHOR_OTHER = 2.0, -3.0
PART_SAME, PART_OTHER, PART_ONE = 1.0, -5.0, -2.0
SHORT_TITLE = 2  # words up to which one shared word is enough
LEAST_ODDS = -2.0  # pairs below are never accepted and hardly weigh on others
_ACCENTS = ("äöüáéíóúàèìòùâêîôûñçåøőű", "aouaeiouaeiouaeiouncaoou")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _plain(c: Column) -> Column:
    return F.translate(F.lower(c), *_ACCENTS)


def _compact(c: Column) -> Column:
    """Letters and digits only, without a bracketed remark or a leading number."""
    c = F.regexp_replace(_plain(c), r"[\s\-–—:,(\[]*\b(?:abstract|article|full text|vol\.? [0-9]+)\b[\s)\].\"'”]*$", "")
    c = F.regexp_replace(c, r"^\s*[0-9]+\s*[.)]\s*", "")
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


def _words(c: Column, letters: int = 5) -> Column:
    """Hashes of the beginnings of the words of four letters or more; words broken by a hyphen and a blank count as one."""
    c = F.regexp_replace(_plain(c), r"-\s+", "")
    return F.array_distinct(F.transform(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4), lambda w: F.hash(F.substring(w, 1, letters))))


def _part(c: Column) -> Column:
    """The number of a part, '' if the title has none."""
    return F.regexp_extract(_plain(c), r"\bp[a-z]?rt\.?\s+([ivxl0-9]+)\b", 1)


def _roman(c: Column) -> Column:
    """Arabic digits of a volume that may be Roman or have a word before it; null if neither."""
    t = F.regexp_replace(F.lower(c), r"^\s*(vol\.?|v\.|no\.?)\s*|\s+", "")
    values = F.transform(F.reverse(F.split(t, "")), lambda ch: F.coalesce(*[F.when(ch == k, v) for k, v in _ROMAN.items()], F.lit(0)))
    total = F.aggregate(
        values,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), F.greatest(a["last"], v).alias("last")),
        lambda a: a["sum"],
    )
    digits = F.regexp_extract(t, r"([0-9]+)", 1)
    return F.when(digits != "", digits.cast("bigint").cast("string")).when(t.rlike("^[ivxlcdm]+$"), total.cast("string"))


def _first_page(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9]{1,7})", 1).try_cast("int")


def _last_page(c: Column) -> Column:
    """The last page of a range; 703-7 ends at 707. 0 if there is none."""
    a, b = F.regexp_extract(c, r"([0-9]{1,7})\s*[-–]\s*[a-zA-Z]?([0-9]{1,7})", 1), F.regexp_extract(c, r"([0-9]{1,7})\s*[-–]\s*[a-zA-Z]?([0-9]{1,7})", 2)
    whole = F.concat(F.substring(a, F.lit(1), F.greatest(F.length(a) - F.length(b), F.lit(0))), b)
    return F.coalesce(whole.try_cast("int"), F.lit(0))


def _issues(df: DataFrame) -> DataFrame:
    """One row per issue g: its most frequent issn, volume, number and year; from (g, issn, vol, iss, yr)."""
    seen = df.groupBy("g", "issn", "vol", "iss", "yr").count()
    said = seen.select("g", F.col("count").alias("n"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in ("issn", "vol", "iss", "yr")])).alias("s"))
    n = said.where("s.v IS NOT NULL AND s.v <> ''").groupBy("g", "s.k", "s.v").agg(F.sum("n").alias("n"))
    best = n.groupBy("g", "k").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
    return best.groupBy("g").agg(pick("issn"), pick("vol"), pick("iss"), pick("yr"))


def align_issues(left: DataFrame, right: DataFrame) -> DataFrame:
    """(ga, ge): issues of both sides that agree in journal and, where both are known, volume, number and year, in at least
    two of the three; one known disagreement of the year is forgiven if volume and number agree."""
    a = left.select(F.col("g").alias("ga"), "issn", F.col("vol").alias("va"), F.col("iss").alias("ia"), F.col("yr").alias("ya"))
    e = right.select(F.col("g").alias("ge"), "issn", F.col("vol").alias("ve"), F.col("iss").alias("ie"), F.col("yr").alias("ye"))
    near = lambda on: a.join(e, [a["issn"] == e["issn"], a[f"{on}a"] == e[f"{on}e"]]).drop(e["issn"])
    both = near("v").unionByName(near("y")).distinct()
    same = lambda x: F.coalesce((F.col(f"{x}a") == F.col(f"{x}e")).cast("int"), F.lit(0))
    differ = lambda x: F.coalesce((F.col(f"{x}a") != F.col(f"{x}e")).cast("int"), F.lit(0))
    scored = both.withColumn("hits", same("v") + same("i") + same("y")).withColumn("misses", differ("v") + differ("i") + 0.5 * differ("y"))
    return scored.where("hits >= 2 AND misses < 1").select("ga", "ge")


def request_units(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the same issue, title and first page become one unit, however many there are: (units, members)."""
    rows = anchors.where("anchor_id IS NOT NULL").select(
        "anchor_id",
        F.xxhash64(F.coalesce(F.regexp_replace(F.lower("identifier"), r"[^\p{L}\p{N}]+", ""), F.lit(""))).alias("g"),
        "article_title",
        F.coalesce(_compact("article_title"), F.lit("")).alias("title_key"),
        F.coalesce(_first_page(F.col("journal_pages")), F.lit(0)).alias("page"),
        "journal_pages",
        F.regexp_extract(F.get(F.get("leaf_ranges", F.lit(0)), F.lit(0)), r"([0-9]{1,7})", 1).try_cast("int").alias("leaf"),
        "article_author",
        "issn",
        F.regexp_extract("volume", r"([0-9]+)", 1).try_cast("bigint").cast("string").alias("vol"),
        F.regexp_extract("issue", r"([0-9]+)", 1).alias("iss"),
        F.regexp_extract("yr", r"(\d{4})", 1).alias("yr"),
    )
    rows = cut(rows.withColumn("unit", F.xxhash64("g", "title_key", "page")).drop("title_key"), "requests")
    units = rows.groupBy("unit").agg(
        F.first("g").alias("ga"),
        F.max("article_title").alias("raw"),
        F.first("page").alias("page"),
        F.max("journal_pages").alias("pages"),
        F.percentile_approx("leaf", 0.5, 100).alias("leaf"),
        F.max_by("article_author", F.struct(F.length("article_author"), "article_author")).alias("author"),
    )
    title = F.coalesce(F.regexp_replace(F.lower("raw"), r"\s+", " "), F.lit(""))
    units = units.select("unit", "ga", "page", "leaf", title.alias("title"), F.coalesce(_compact("raw"), F.lit("")).alias("title_key"), F.coalesce(_last_page(F.col("pages")), F.lit(0)).alias("last_page"), F.coalesce(_words(F.col("author"), 4), F.array().cast("array<int>")).alias("authors"))
    return units.withColumn("title_words", _words(F.col("title"))).withColumn("part_a", _part("title")).drop("title"), rows


def _keyed(df: DataFrame, node: str, words: str, page: str, authors: str) -> DataFrame:
    """(node, k, c): what candidates share, and what that is worth: a title's word, an author's word, or the first printed page.
    Two are needed, but a word of a short title, the author or the page is enough."""
    of = lambda c, kind, worth: F.transform(c, lambda x: F.struct(F.xxhash64("_g", x, F.lit(kind)).alias("k"), worth.alias("c")))
    page_key = F.when(F.col(page) > 0, F.array(F.col(page))).otherwise(F.array().cast("array<int>"))
    keys = F.concat(of(F.col(words), 0, F.when(F.size(words) <= SHORT_TITLE, 2).otherwise(1)), of(F.col(authors), 1, F.lit(2)), of(page_key, 2, F.lit(2)))
    return df.withColumn("_g", F.xxhash64("ge")).select(node, F.explode(keys).alias("x")).select(node, "x.k", "x.c")


def candidate_pairs(units: DataFrame, entries: DataFrame) -> DataFrame:
    """(unit, entry_id) of aligned issues that share two keys, or one that is enough; see _keyed. Only identifiers are shuffled
    here; what pairs are scored on is looked up afterwards."""
    a = _keyed(units, "unit", "title_words", "page", "authors")
    e = _keyed(entries, "entry_id", "entry_words", "start_page", "entry_authors").withColumnRenamed("c", "d")
    return cut(a.join(e, "k").groupBy("unit", "entry_id").agg(F.sum(F.greatest("c", "d")).alias("shared")).where("shared >= 2").drop("shared"), "candidates")


def _pair_scores(pairs: DataFrame) -> DataFrame:
    """Adds ``odds``: the log odds of a candidate pair from its own attributes."""
    part = F.when((F.col("part_a") != "") & (F.col("part_e") != ""), F.when(F.col("part_a") == F.col("part_e"), PART_SAME).otherwise(PART_OTHER)).when((F.col("part_a") != "") | (F.col("part_e") != ""), PART_ONE).otherwise(0.0)
    known = (F.col("page") > 0) & (F.col("start_page") > 0)
    gap = F.abs(F.col("page") - F.col("start_page"))
    page = F.when(known, F.when(gap == 0, PAGE_SAME).when(gap <= 1, PAGE_NEAR).when(F.col("page").between(F.col("start_page"), F.col("end_page")), PAGE_INSIDE).otherwise(PAGE_OTHER)).otherwise(0.0)
    ends = known & (F.col("last_page") > 0) & (F.col("end_page") > 0)
    page = page + F.when(ends, F.when(F.abs(F.col("last_page") - F.col("end_page")) == 0, END_SAME).when(F.abs(F.col("last_page") - F.col("end_page")) > 1, END_OTHER).otherwise(0.0)).otherwise(0.0)
    off = F.abs(F.col("leaf") - F.col("start_index") - F.col("shift"))
    leaf = F.when(off.isNull(), 0.0).when(off <= 2, LEAF_SAME).when(off <= 4, LEAF_NEAR).otherwise(LEAF_OTHER)
    both = (F.size("authors") > 0) & (F.size("entry_authors") > 0)
    author = F.when(both, F.when(F.arrays_overlap("authors", "entry_authors"), AUTHOR_SAME).otherwise(AUTHOR_OTHER)).otherwise(0.0)
    n = F.least(F.length("title_key"), F.length("entry_key"))
    pairs = pairs.withColumn("rest", F.lit(PRIOR) + F.when(n > 0, part).otherwise(0.0) + page + leaf + author)
    pairs = pairs.where(F.col("rest") + TITLE[0][1] > LEAST_ODDS)  # the same title couldn't save the others

    longest = F.greatest(F.length("title_key"), F.length("entry_key"))
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("title_words", "entry_words"))).withColumn("few", F.least(F.size("title_words"), F.size("entry_words")))
    contained = F.when(F.col("few") >= 3, 0.95 * F.col("shared") / F.col("few")).otherwise(0.0)
    edit = 1 - F.levenshtein("title_key", "entry_key") / longest
    begins = F.levenshtein(F.expr("left(title_key, least(length(title_key), length(entry_key)))"), F.expr("left(entry_key, least(length(title_key), length(entry_key)))"))
    cut_short = F.when((n >= 12) & (n < 0.9 * longest), 1 - begins / n).otherwise(0.0)
    # spellings are compared only where the words don't settle it: from TITLE[0] on all similarities weigh alike, and titles
    # of three words and more without one in common are other titles, unless all else speaks for the pair
    alike = (
        F.when(F.col("title_key") == F.col("entry_key"), 1.0)
        .when(contained >= TITLE[0][0], contained)
        .when((F.col("shared") == 0) & (F.col("few") >= 3) & (F.col("rest") <= 0), 0.0)
        .otherwise(F.greatest(edit, cut_short, contained))
    )
    pairs = pairs.withColumn("t", alike)  # a column of its own, to be computed once
    title = F.when(n == 0, 0.0)
    for least, odds in TITLE:
        title = title.when(F.col("t") >= least, odds)
    return pairs.withColumn("odds", F.col("rest") + title)


DAMPED_FROM = 6  # rounds after which messages are mixed with those before them


def propagate(edges: DataFrame, least_change: float = 0.005, most_rounds: int = 60, rounds_a_step: int = 3) -> DataFrame:
    """Marginals of a matching by messages in a graph with loops: (unit, entry_id, p).

    Edges are (unit, entry_id, slot_a, slot_e, odds). A unit belongs to at most one article of the contents, and an
    article to at most one article asked for: edges exclude each other at a unit if their entries begin on different known
    pages (slot_e), and at an entry if their units do (slot_a); variants of one article, which share a slot, and those
    without a page (slot 0) don't. A message from a unit to an entry is 1 / (1 + the other claims on the unit), where the
    claims of one slot count once, as the strongest of them, and those of different slots are summed; and the other way
    round. An edge that nothing excludes has no messages to wait for.

    Rounds go on in written steps until no marginal changes by more than ``least_change`` in a round; from DAMPED_FROM on
    messages are mixed half and half with those before, so that loops can't swing for ever. Should ``most_rounds`` not be
    enough, a warning says how many edges still move. A node's edges are the distinct candidates of one issue.
    """
    mixed = lambda node, slot: F.max(slot).over(W.partitionBy(node)) != F.min(slot).over(W.partitionBy(node))
    edges = edges.withColumn("_c", mixed("unit", "slot_e")).withColumn("_c", F.col("_c") | mixed("entry_id", "slot_a"))
    edges = cut(edges, "contested")
    free = edges.where("NOT _c").select("unit", "entry_id", (1 / (1 + F.exp(-F.col("odds")))).alias("p"))
    state = edges.where("_c").select("unit", "entry_id", "slot_a", "slot_e", F.exp(F.least(F.col("odds"), F.lit(30.0))).alias("w"), F.lit(1.0).alias("to_a"))

    def half(s: DataFrame, node: str, slot: str, sent: str, out: str) -> DataFrame:
        """Messages ``out`` of the nodes, from those they were ``sent``; one shuffle and one sort."""
        mine = W.partitionBy(node, slot)
        s = s.withColumn("_own", F.max(F.col("w") * F.col(sent)).over(mine)).withColumn("_n", F.row_number().over(mine.orderBy(F.lit(1))))
        known = F.col(slot) > 0
        total = F.sum(F.when((F.col("_n") == 1) & known, F.col("_own")).otherwise(0.0)).over(W.partitionBy(node))
        others = F.when(known, F.greatest(total - F.col("_own"), F.lit(0.0))).otherwise(0.0)
        return s.withColumn(out, 1 / (1 + others)).drop("_own", "_n")

    rounds, last = 0, None
    while True:
        for k in range(rounds_a_step):
            rounds += 1
            ends = k + 1 == rounds_a_step
            damped = rounds > DAMPED_FROM
            state = state.withColumnRenamed("to_a", "_a")
            state = half(state.repartition("unit"), "unit", "slot_e", "_a", "to_e")
            state = half((state if damped or ends else state.drop("_a")).repartition("entry_id"), "entry_id", "slot_a", "to_e", "to_a")
            if damped:
                state = state.withColumn("to_a", (F.col("to_a") + F.col("_a")) / 2)
            if ends:  # with to_e the same, a marginal moves by as much as its claim on the entry
                now, before = F.col("w") * F.col("to_e") * F.col("to_a"), F.col("w") * F.col("to_e") * F.col("_a")
                state = state.withColumn("p", now / (1 + now)).withColumn("moved", F.abs(now / (1 + now) - before / (1 + before)))
            state = state.drop("to_e", "_a")
        state = cut(state, "messages")
        if last is not None:
            release(last)
        last = state
        moving = state.where(F.col("moved") > least_change).count()
        if not moving or rounds >= most_rounds:
            if moving:
                warnings.warn(f"{moving} pairs still move after {rounds} rounds")
            return state.select("unit", "entry_id", "p").unionByName(free)
        state = state.drop("p", "moved")


def match_articles(anchors: DataFrame, entries: DataFrame, authors: DataFrame, least: float = 0.5) -> DataFrame:
    """(anchor_id, entry_id, confidence): requests and contents entries of the same article, p >= ``least``.

    Issues are aligned by journal, volume, number and year, each the most frequent of its rows; requests that don't differ
    are one unit; units and entries of aligned issues that share a title word or first page are scored on title, part,
    pages, leaves (after the issue's usual shift) and authors; messages settle which claims exclude each other. A null
    title, page, leaf or author is no evidence. Every row of a unit gets the unit's matches, repeated rows too. Rows
    without ids or in issues without a partner give none.
    """
    units, requests = request_units(anchors)
    none = F.array().cast("array<int>")
    names = authors.where("name IS NOT NULL").select("entry_id", F.explode(_words(F.col("name"), 4)).alias("w")).groupBy("entry_id").agg(F.collect_set("w").alias("entry_authors"))
    e = entries.where("entry_id IS NOT NULL AND item IS NOT NULL").withColumn("title", F.coalesce("title", F.lit("")))
    sides = _issues(requests), _issues(e.select(F.col("item").alias("g"), "issn", _roman(F.col("volume")).alias("vol"), F.regexp_extract("issue", r"([0-9]+)", 1).alias("iss"), "yr"))
    aligned = align_issues(*sides)
    e = e.select(
        "entry_id",
        F.col("item").alias("ge"),
        _compact("title").alias("entry_key"),
        _words(F.col("title")).alias("entry_words"),
        _part("title").alias("part_e"),
        F.coalesce("start_page_number", F.lit(0)).alias("start_page"),
        F.coalesce("end_page_number", F.lit(0)).alias("end_page"),
        F.when(F.col("start_page_index").between(0, 100000), F.col("start_page_index")).alias("start_index"),
    )
    e = cut(e.join(names, "entry_id", "left").withColumn("entry_authors", F.coalesce("entry_authors", none)), "entries")
    units = cut(units.join(aligned, "ga").drop("ga"), "units")
    members = cut(requests.select("anchor_id", "unit"), "members")
    release(requests)
    # the usual shift between leaves and page indexes of an issue, from units and entries with the same first page
    beside = units.where("page > 0").join(e.where("start_page > 0"), (units["ge"] == e["ge"]) & (units["page"] == e["start_page"]))
    shift = beside.groupBy(units["ge"]).agg(F.percentile_approx(F.col("leaf") - F.col("start_index"), 0.5, 100).alias("shift"))
    found = candidate_pairs(units, e)
    pairs = found.join(e.join(shift, "ge", "left"), "entry_id").join(units, ["unit", "ge"]).drop("ge")
    edges = cut(_pair_scores(pairs).where(F.col("odds") > LEAST_ODDS).select("unit", "entry_id", F.col("page").alias("slot_a"), F.col("start_page").alias("slot_e"), "odds"), "edges")
    release(units, e, found)
    sure = propagate(edges).where(F.col("p") >= least)
    return salted_join(members.select("anchor_id", "unit"), sure, ["unit"]).select("anchor_id", "entry_id", F.col("p").alias("confidence"))
