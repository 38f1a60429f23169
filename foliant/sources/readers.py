"""Readers of the native file formats, each with an explicit schema; nothing is inferred. Records may be a file each, as they
are made, or with ``lines`` a line each, as many small ones should be kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.functions.pages import leaf_int

RANGES = "array<array<string>>"
ANCHOR = f"struct<article_title:string,article_author:string,journal_title:string,issn:string,volume:string,issue:string,year:string,printed_pages:string,leaf_ranges:{RANGES},unfill_reason:string>"
AUTHORS = "array<struct<name:string,affiliation:string>>"
TOC = (
    f"item string, schema_version int, issn string, volume string, issue string, year string, page_index_count int, leaf_count int, generated_at string,"
    f"entries array<struct<id:string,type:string,title:string,authors:{AUTHORS},page_index_ranges:{RANGES},leaf_ranges:{RANGES},doi:string,confidence:double,evidence:array<string>,needs_qa:boolean>>"
)
MODEL_TOC = f"item string, entries array<struct<title:string,authors:{AUTHORS},start_page_index:int,end_page_index:int,start_page_number:int,end_page_number:int,type:string>>"
PAGE_NUMBERS = "identifier string, confidence double, pages array<struct<leafNum:int,pageNumber:string,confidence:double>>"
CONTAINER = "ident string, name string, issnl string, issne string, issnp string, publisher string, container_type string, wikidata_qid string, extra struct<ia:struct<sim:struct<sim_pubid:string,year_spans:string,peer_reviewed:string>>>"
PUB = "identifier string, title string, issn string, sim_pubid string, publisher string"
WORK_FIELDS = "DOI:string,title:array<string>,page:string,volume:string,issue:string,author:array<struct<given:string,family:string>>"
ILL_LOG = "time string, username string, source_identifier string, action string, full_form string"


def ill_log(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Request-log CSV with a quoted JSON column; rows carry their file and their place in it.

    The place is exact within a file that isn't split, which multi-line CSV never is.
    """
    raw = spark.read.schema(ILL_LOG).option("header", header).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select("*", F.col("_metadata.file_name").alias("src_file"), F.monotonically_increasing_id().alias("src_ord"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per anchor of a corpus of JSON lines (identifier, anchors)."""
    return spark.read.schema(f"identifier string, anchors array<{ANCHOR}>").json(path).select(F.col("identifier").alias("item"), F.posexplode("anchors").alias("ord", "a")).select("item", "ord", "a.*")


def toc(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per entry of contents files of either version: ranges under the new or the old name, first range as integers."""
    t = spark.read.schema(TOC).option("multiLine", not lines).json(path)
    e = t.select("item", "issn", "volume", "issue", "year", F.coalesce("page_index_count", "leaf_count").alias("page_count"), F.posexplode("entries").alias("ord", "e"))
    ranges = F.coalesce("e.page_index_ranges", "e.leaf_ranges")
    return e.select("item", "issn", "volume", "issue", "year", "page_count", "ord", "e.id", "e.type", "e.title", "e.authors", ranges.alias("ranges"), leaf_int(ranges[0][0]).alias("start"), leaf_int(F.element_at(ranges[0], -1)).alias("stop"), "e.doi", "e.confidence", "e.evidence", "e.needs_qa")


def model_toc(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    t = spark.read.schema(MODEL_TOC).option("multiLine", not lines).json(path)
    return t.select("item", F.posexplode("entries").alias("ord", "e")).select("item", "ord", "e.*")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload): whole layout records, gzip or not, for ``operators.nested.flatten_nested``."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def page_numbers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    t = spark.read.schema(PAGE_NUMBERS).option("multiLine", not lines).json(path)
    return t.select(F.col("identifier").alias("item"), F.posexplode("pages").alias("ord", "p")).select("item", "ord", F.col("p.leafNum").alias("leaf"), F.col("p.pageNumber").alias("label"), F.col("p.confidence").alias("confidence"))


def scan_leaves(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, leaf, accessible): the pages of scan XML; only the text 'true' makes a page visible."""
    raw = spark.read.format("xml").option("rowTag", "page").option("multiLine", not lines).schema("_leafNum int, addToAccessFormats string, pageType string").load(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("_leafNum").alias("leaf"), (F.coalesce("addToAccessFormats", F.lit("")) == "true").alias("accessible"))


def scan_assertions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "assertion").option("multiLine", not lines).schema("leafNum int, pageNum string").load(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("leafNum").alias("leaf"), F.col("pageNum").alias("asserted"))


def hocr_words(spark: SparkSession, path: str) -> DataFrame:
    """(file, leaf, x1, y1, x2, y2, text): words of hOCR pages."""
    pages = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.explode(F.slice(F.split("value", "class=['\"]ocr_page['\"]"), 2, 1_000_000)).alias("p"))
    leaf = F.regexp_extract("p", r"page_([0-9]+)", 1).try_cast("int")
    word = r"(?s)ocrx_word['\"][^>]*?bbox ([0-9]+) ([0-9]+) ([0-9]+) ([0-9]+)[^>]*>(.*?)</span>"
    parts = F.arrays_zip(*[F.regexp_extract_all("p", F.lit(word), k).alias(f"g{k}") for k in range(1, 6)])
    w = pages.select("file", leaf.alias("leaf"), F.explode(parts).alias("w"))
    return w.select("file", "leaf", *[F.col("w")[f"g{k + 1}"].cast("int").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], F.regexp_replace(F.col("w")["g5"], "<[^>]*>", "").alias("text"))


def containers(spark: SparkSession, path: str, with_sim_only: bool = False) -> DataFrame:
    """Catalogue records, one a line; optionally only those with a sim id."""
    c = spark.read.schema(CONTAINER).json(path)
    c = c.select("ident", "name", F.coalesce("issnl", "issne", "issnp").alias("issn"), "publisher", "container_type", F.col("extra.ia.sim.sim_pubid").alias("sim_pubid"))
    return c.where("sim_pubid IS NOT NULL") if with_sim_only else c


def publications(spark: SparkSession, path: str) -> DataFrame:
    """Publications whose fields may be a text or a list of texts; the first counts."""
    from foliant.functions.text import first_string

    raw = spark.read.schema(PUB).json(path)
    return raw.select(*[first_string(F.col(c)).alias(c) for c in raw.columns])


def xref_year(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per work of cached service answers (items, error)."""
    t = spark.read.schema(f"issn string, year int, error string, items array<struct<{WORK_FIELDS}>>").option("multiLine", not lines).json(path)
    return t.where("error IS NULL").select("issn", "year", F.inline("items"))
