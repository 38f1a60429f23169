"""Request logs to article locations: projection, shape choice, first-wins dedup, corpus, samples and cover text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions.text import ISSN_SHAPE, is_periodical, strip

FORM = (
    "identifier string, start array<string>, stop array<string>, orig_start array<string>, orig_stop array<string>, normalized_orig_start array<string>, "
    "normalized_orig_stop array<string>, filename string, provider string, cover_text string, unfill_reason string, original_request_params struct<article_title:string,"
    "article_author:string,journal_title:string,standard_number:string,journal_volume:string,journal_issue:string,journal_year:string,journal_month:string,journal_pages:string>"
)
LEAF_SHAPE = "^n[0-9]+$"


def all_leaves(c: Column) -> Column:
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(x.rlike(LEAF_SHAPE), F.lit(False))), F.lit(False))


def chosen_ranges(start: Column, stop: Column, other_start: Column, other_stop: Column) -> Column:
    """The raw pair of arrays if all of it has leaf shape, else the normalised pair if that has, else whichever isn't empty;
    null unless both arrays are of one length."""
    raw = all_leaves(start) & all_leaves(stop)
    other = all_leaves(other_start) & all_leaves(other_stop)
    use_raw = raw | (~other & (F.coalesce(F.size(start), F.lit(0)) > 0))
    a, b = F.when(use_raw, start).otherwise(other_start), F.when(use_raw, stop).otherwise(other_stop)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.zip_with(a, b, lambda x, y: F.struct(x.alias("start"), y.alias("stop"))))


def parse_log(log: DataFrame) -> DataFrame:
    """Anchors of log rows (time, source_identifier, full_form, src_file, src_ord); rows whose form can't be read, or whose
    ranges are empty or of unequal length, are left out. Blank texts are null; time counts only if it is all digits."""
    f = F.col("f")
    p = f["original_request_params"]
    rows = log.withColumn("f", F.from_json("full_form", FORM))
    ranges = chosen_ranges(f["start"], f["stop"], f["normalized_orig_start"], f["normalized_orig_stop"])
    return rows.select(
        F.coalesce(strip(f["identifier"]), strip(F.col("source_identifier"))).alias("item"),
        *[strip(p[k]).alias(v) for k, v in (("article_title", "article_title"), ("article_author", "article_author"), ("journal_title", "journal_title"), ("standard_number", "issn"), ("journal_volume", "volume"), ("journal_issue", "issue"), ("journal_year", "year"), ("journal_month", "month"), ("journal_pages", "printed_pages"))],
        ranges.alias("ranges"),
        f["unfill_reason"].alias("unfill_reason"),
        f["provider"].alias("provider"),
        f["cover_text"].alias("cover_text"),
        F.when(F.col("time").rlike("^[0-9]+$"), F.col("time").try_cast("bigint")).alias("request_time"),
        "src_file",
        "src_ord",
    ).where("item IS NOT NULL AND ranges IS NOT NULL")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` of each group of equal ``keys``, nulls equal. A hash aggregate with map-side combining
    finds it, so a key of a third of all rows is no single sort."""
    named = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.min_by(named, F.struct(*order)).alias("r"))
    return best.select("r.*")


def periodical_corpus(anchors: DataFrame, item: str = "item") -> DataFrame:
    """Anchors of periodical identifiers only."""
    return anchors.where(is_periodical(F.col(item)))


def sample_items(anchors: DataFrame, item: str, title: str, least: int = 2, most: int = 100) -> DataFrame:
    """Items with at least ``least`` titled anchors, most first; the limit is the feature."""
    n = anchors.groupBy(item).agg(F.count_if(F.coalesce(F.trim(title), F.lit("")) != "").alias("n_named"))
    return n.where(F.col("n_named") >= least).orderBy(F.desc("n_named"), item).limit(most)


def usable_metadata(anchors: DataFrame) -> DataFrame:
    """(item, issn, volume, issue, year) of each item's first row that has all four and an issn of the right shape."""
    ok = anchors.where(F.col("issn").rlike(ISSN_SHAPE) & F.col("volume").isNotNull() & F.col("issue").isNotNull() & F.col("year").isNotNull())
    return ok.groupBy("item").agg(F.min_by(F.struct("issn", "volume", "issue", "year"), "ord").alias("r")).select("item", "r.*")


COVER = "journal_title string, issn string, article_title string, article_author string, volume string, issue string, year string, pages string"


def cover_fields(text: str | None) -> dict | None:
    """Fields of a delivery's cover text; None if it isn't one.

    Lines: 'Request on …', journal with a span of years, number, title (one line or more), author, then 'volume … issue …
    year …' and perhaps 'pages …'. What follows the response line is ignored.
    """
    import re

    if not text or not text.strip():
        return None
    lines = [x.strip() for x in text.replace("\r", "\n").strip().split("\n")]
    for i, line in enumerate(lines):
        if line.lower().startswith("response from "):
            lines = lines[:i]
            break
    while lines and not lines[-1]:
        lines.pop()
    if len(lines) < 5 or not lines[0].lower().startswith("request on"):
        return None
    out: dict = dict.fromkeys(x.split()[0] for x in COVER.split(", "))
    out["journal_title"] = re.sub(r"\s+\d{4}\s*-\s*(\d{4})?$", "", lines[1]) or None
    at = 2
    if m := re.fullmatch(r"(\d{4}-?\d{3}[\dXx])|\d{9}[\dXx]|97[89]\d{10}", lines[2]):
        out["issn"], at = m[1], 3
    stop = len(lines)
    for i in range(len(lines) - 1, at - 1, -1):
        if re.match(r"(volume\s+|year\s+\d|issue\s+\S+\s+year\s)", lines[i], re.I):
            stop = i
            break
        if re.match(r"pages?\s", lines[i], re.I):
            stop = i
    for line in lines[stop:]:
        for name, key in (("volume", "volume"), ("issue", "issue"), ("year", "year")):
            if m := re.search(rf"\b{name}\s+(\S+)", line, re.I):
                out[key] = m[1]
        if m := re.search(r"\bpages?\s+(.+)$", line, re.I):
            out["pages"] = m[1].strip()
    body = [x for x in lines[at:stop] if x]
    if len(body) > 1:
        out["article_author"] = body[-1]
        body = body[:-1]
    out["article_title"] = " ".join(body) or None
    return out


def parse_cover_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fields of COVER) for each row whose ``text`` is a cover text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, cover_fields(t)) for k, t in zip(b["k"], b["t"])]
            yield pd.DataFrame([{"k": k} | r for k, r in got if r], columns=["k", *[x.split()[0] for x in COVER.split(", ")]])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, {COVER}").withColumnRenamed("k", key)


def retry_rows(df: DataFrame, keys: list[str], order: list[str], seconds: int) -> DataFrame:
    """Rows that repeat another with the same keys within so many seconds before them, with ``gap_s``; the first column of
    ``order`` is the time. Nulls in ``keys`` are equal."""
    w = W.partitionBy(*keys).orderBy(*order)
    gap = F.unix_timestamp(F.col(order[0]).cast("timestamp")) - F.unix_timestamp(F.lag(order[0]).over(w).cast("timestamp"))
    return df.withColumn("gap_s", gap).where(F.col("gap_s") <= seconds)


def since(rows: DataFrame, time: str, cutoff: str) -> DataFrame:
    """Rows from ``cutoff`` on. The comparison is with a literal of the column's own type, so it reaches the scan and skips files
    and row groups that end before it."""
    return rows.where(F.col(time) >= F.lit(cutoff).cast(rows.schema[time].dataType))


def requests_of_items(rows: DataFrame, item: str) -> DataFrame:
    """(item, n): how often each item was asked for."""
    return rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
