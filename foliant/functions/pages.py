"""Page numbers, page ranges and page-index identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_to_int(c: Column) -> Column:
    """Value of a Roman numeral, subtractive pairs included; null if it has other letters or is empty."""
    t = F.lower(F.trim(c))
    value = lambda ch: F.coalesce(*[F.when(ch == k, v) for k, v in _ROMAN.items()])
    digits = F.transform(F.reverse(F.split(t, "")), value)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))
    step = lambda a, v: F.struct((a["sum"] + F.when(v < a["most"], -v).otherwise(v)).alias("sum"), F.greatest(a["most"], v).alias("most"))
    return F.when(t.rlike("^[ivxlcdm]+$"), F.aggregate(digits, start, step, lambda a: a["sum"]))


def page_to_int(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("int"), roman_to_int(c))


def parse_pages(c: Column) -> Column:
    """struct(first, last) of '987-93', '69', '69-'; a shorter, smaller end takes the leading digits of the start, one step
    higher if it would still be smaller. Null if the text doesn't begin with a number."""
    shape = r"^([0-9]{1,9})\s*[-–]\s*([0-9]{1,9})"
    t = F.trim(c)
    one = F.regexp_extract(t, "^([0-9]{1,9})", 1).try_cast("bigint")
    a, b = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
    s, e = a.try_cast("bigint"), b.try_cast("bigint")
    scale = F.pow(F.lit(10), F.length(b)).cast("bigint")
    near = s - s % scale + e
    last = F.when((F.length(b) < F.length(a)) & (e < s), F.when(near < s, near + scale).otherwise(near)).otherwise(e)
    return F.when(one.isNotNull(), F.struct(F.coalesce(s, one).alias("first"), F.coalesce(last, one).alias("last")))


def leaf_int(c: Column) -> Column:
    """26 of 'n26'; null for anything else."""
    return F.regexp_extract(F.trim(c), "^n([0-9]{1,9})$", 1).try_cast("int")


def format_leaf(c: Column) -> Column:
    return F.concat(F.lit("n"), c.cast("string"))


def zero_based(first: Column, last: Column) -> tuple[Column, Column]:
    """1-based pages as clamped 0-based ones."""
    s = F.greatest(F.lit(0), first - 1)
    return s, F.greatest(s, last - 1)


def year_bucket(year: Column, span: int = 5) -> Column:
    """'1995-1999'; 'unknown' outside 1900..2030."""
    y = year.try_cast("int")
    low = y - y % span
    return F.when(y.between(1900, 2030), F.concat(low.cast("string"), F.lit("-"), (low + span - 1).cast("string"))).otherwise("unknown")
