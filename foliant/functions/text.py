"""Title, author and label functions: columns in, columns out; edit similarity as the one Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

# Stop words of the several title comparisons
STOP_TITLE = "the a an of and in on for to la le les der die das el los il".split()
STOP_AUDIT = "the a an of and in on for to with by from la le les der die das el los il de du is at as that this be or not but".split()
STOP_EVIDENCE = "a an the of for in on to and or but with by at from as is are was were be that this if".split()
STOP_PLACE = "the a an of and in on for to".split()
STOP_LOOKUP = "the of in and on a an for to with by or is at de la le les du et des une un von der die das im zur fur bei aus mit zu sur sui ein eine einer over som its as be from this that into under between among".split()
STOP_FILTER = "the a an of and in on for to or by from with at as is".split()
# Shapes of identifiers
ISSN_SHAPE = r"^[0-9]{4}-?[0-9]{3}[0-9Xx]$"
BOOK_SUFFIX = r"[0-9]{4}[a-z]+(_[a-z0-9]+)*$"
PERIODICAL_SHAPES = (r"^sim_", r"^pub_", r"_[0-9]{4}.*_[0-9]+_[0-9]+(-[0-9]+)?$", r"_[0-9]{4}-[0-9]{2}_[0-9]+_[0-9]+(-[0-9]+)?$", r"(?i)_(spring|summer|fall|autumn|winter|january|february|march|april|may|june|july|august|september|october|november|december)[a-z0-9_-]*_[0-9]+_[0-9]+")


def strip(c: Column) -> Column:
    """Without any white space at the ends; blank becomes null."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def tokens(c: Column, stop: list[str] = STOP_TITLE, least: int = 1) -> Column:
    """Lower-case runs of letters and digits that aren't stop words and have at least ``least`` characters."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(stop))


def normalize_title(c: Column, stop: list[str] = STOP_TITLE) -> Column:
    return F.array_join(tokens(c, stop), " ")


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token arrays; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit similarity of Ratcliff and Obershelp, in the order of its arguments; null if either is."""
    from difflib import SequenceMatcher

    cache: dict = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in cache:
            cache[x, y] = SequenceMatcher(None, x, y).ratio()
        out.append(cache[x, y])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(StringType())
def nfk_fold(s: pd.Series) -> pd.Series:
    """Compatibility-composed, umlauts spelled out, other marks dropped, lower case."""
    import unicodedata

    two = str.maketrans({"ß": "ss", "ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"})

    def one(x):
        if x is None:
            return None
        y = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", x).translate(two))
        return "".join(c for c in y if not unicodedata.combining(c)).lower()

    return s.map(one)


@F.pandas_udf(StringType())
def py_title(s: pd.Series) -> pd.Series:
    """Title case that starts a word after every non-letter (O'Brien, Smith-Jones)."""
    return s.map(lambda x: None if x is None else x.title())


def title_match(a: Column, b: Column, use_ratio: bool = True) -> Column:
    """Titles agree: equal, one word that begins the other, contained, half of the words and more, or alike in spelling.
    An empty title agrees with none."""
    na, nb = normalize_title(a), normalize_title(b)
    ta, tb = tokens(a), tokens(b)
    single = ((F.size(ta) == 1) | (F.size(tb) == 1)) & (F.get(ta, F.lit(0)) == F.get(tb, F.lit(0)))
    agree = (na == nb) | single | na.contains(nb) | nb.contains(na) | (overlap(ta, tb) >= 0.6)
    if use_ratio:
        six = lambda t: F.array_join(F.slice(t, 1, 6), " ")
        agree = agree | (seq_ratio(six(ta), six(tb)) >= 0.85) | (seq_ratio(na, nb) >= 0.7)
    return F.coalesce((na != "") & (nb != "") & agree, F.lit(False))


def surnames(c: Column) -> Column:
    """Surnames of an author string: parts at ';', '&' and 'and'; the first capitalised word before a comma, else the last
    capitalised word of three letters or more; lower case."""
    parts = F.split(c, r"\s*(?:;|&|\band\b)\s*")
    before = lambda p: F.regexp_extract(F.split(p, ",")[0], r"([A-Z][A-Za-z'-]+)", 1)
    last = lambda p: F.regexp_extract(p, r".*\b([A-Z][A-Za-z'-]{2,})", 1)
    names = F.transform(parts, lambda p: F.lower(F.when(p.contains(","), before(p)).otherwise(last(p))))
    return F.coalesce(F.array_distinct(F.filter(names, lambda n: n != "")), F.array().cast("array<string>"))


def label_parts(c: Column) -> Column:
    """A volume or issue label with its parts at '-', '/' and ','."""
    t = F.lower(F.trim(c))
    return F.array_distinct(F.filter(F.array_union(F.array(t), F.transform(F.split(t, "[-/,]"), lambda p: F.trim(p))), lambda p: p != ""))


def label_match(a: Column, b: Column) -> Column:
    """Labels agree if they share a part; an empty one agrees only with an empty one."""
    x, y = F.coalesce(F.trim(a), F.lit("")), F.coalesce(F.trim(b), F.lit(""))
    return F.when((x == "") | (y == ""), x == y).otherwise(F.arrays_overlap(label_parts(x), label_parts(y)))


def is_periodical(c: Column) -> Column:
    shapes = F.lit(False)
    for s in PERIODICAL_SHAPES:
        shapes = shapes | c.rlike(s)
    return F.coalesce(~c.rlike(BOOK_SUFFIX) & shapes, F.lit(False))


def distinctive_phrase(c: Column, most: int = 5) -> Column:
    """The first words of three letters or more that aren't stop words."""
    return F.array_join(F.slice(tokens(c, STOP_LOOKUP, 3), 1, most), " ")


def strip_fences(c: Column) -> Column:
    """JSON text without the code fences a model may put around it."""
    return F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")


def first_string(c: Column) -> Column:
    """The value itself, or the first of a JSON list."""
    return F.when(c.rlike(r"^\s*\["), F.try_variant_get(F.try_parse_json(c), "$[0]", "string")).otherwise(c)


# Degrees and roles after names, section labels before titles
CREDENTIALS = r"(?i)\b(M\.?\s*D\.?|Ph\.?\s*D\.?|MA|MS|MPH|MSc|R\.?\s*N\.?|D\.?\s*O\.?|RD|PhD|Sc\.?\s*D\.?|Jr\.?|Sr\.?|II|III|FRCP|FRCS|FACP|MHA|EdD|DSc)\.?\b"
SECTION_LABELS = ("original articles?", "original research", "short notes?", "brief communications?", "case reports?", "letters? to the editor", "book reviews?", "review articles?", "research notes?", "editorial", "commentary", "correspondence")


def strip_section_label(c: Column) -> Column:
    """A title without a section label before it, if three words or more remain."""
    m = F.regexp_extract(c, rf"(?i)^\s*(?:{'|'.join(SECTION_LABELS)})\s*[:.-]?\s+(.*)$", 1)
    return F.when(F.size(F.split(F.trim(m), r"\s+")) >= 3, F.trim(m)).otherwise(c)


def token_signature(c: Column, stop: list[str] = STOP_EVIDENCE) -> Column:
    """The distinct words in alphabetical order: equal for titles that differ in order and repetition."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(c, stop, 3))), " ")
