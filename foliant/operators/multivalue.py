"""Several values in one field: a quote-aware tokenizer, and what its separators mean for names and for page ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "([{", ")]}"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}

# Remarks that more follow, words that only announce
MORE = r"(?:et\s+al|et\s+alii|and\s+others|&\s*others|and\s+colleagues|u\.\s?a)\b\.?"
ANNOUNCE = r"(?:pages?|pgs?|pp?)\b\.?\s*"
PLACEHOLDERS = {"n/a", "na", "none", "unknown", "anon", "anonymous", "null", "no author", "not given", "-", "--", "?", "various", ""}
ORG_TYPES = ("department", "dept", "institute", "inst", "association", "assoc", "commission", "comm", "bureau", "bur", "society", "soc", "university", "univ", "committee", "council", "board", "office", "laboratory", "lab", "school", "college", "centre", "center", "academy", "acad", "federation", "fed", "union", "agency", "ministry", "group", "company", "co", "foundation", "found", "museum", "survey", "service")

_ORG = "|".join(ORG_TYPES)
_ORG_WORD = re.compile(rf"(?<![\w])(?:{_ORG})(?:\.|(?![\w]))", re.I)
_ORG_START = re.compile(rf"(?:the\s+)?(?:{_ORG})(?:\.|(?![\w]))", re.I)
_ORG_AND = re.compile(rf"(?<![\w])(?:{_ORG})\.?\s+(?:for|of|on)\s+[\w-]+\s*$", re.I)
_MORE_END = re.compile(rf"[\s,;/|&]*(?<![\w]){MORE}[\s,;/|&.]*$", re.I)
_AND = re.compile(r"\s+(?:and|with)\s+", re.I)
_LEAD = re.compile(r"^(?:[\s,;/|&+]+|(?:and|with)\s+)+", re.I)
_TITLE = re.compile(r"^(?:(?:dr|prof|mr|mrs|ms|sir|rev)\b\.?\s*)+", re.I)
_JOINED = re.compile(r"\s*(and|with)\s", re.I)
_PLAIN = re.compile(r"[^\\\"'“‘«(\[{)\]};|/\t\n\r&+,]+")
_THOUSAND = re.compile(r"(?<![\d,])\d,\d{3}(?![\d,])")
_ANNOUNCE = re.compile(rf"^\s*{ANNOUNCE}(?=[\divxlcSe(])", re.I)


def scan(text: str) -> Iterator[tuple[str, str]]:
    """Tokens of ``text`` by a finite-state scan: ('quoted', content), ('sep', character) and ('text', run).

    State is the open quote, a pending backslash escape and the bracket depth. A quote opens only where no word
    runs into it (so O'Neil keeps its apostrophe) and must be closed before a blank, a separator or the end; one that
    is never closed is text. Separators inside quotes or brackets are text.
    """
    run: list[str] = []
    i, n, depth = 0, len(text), 0
    last = {c: text.rfind(c) for c in CLOSE}
    while i < n:
        m = _PLAIN.match(text, i)
        if m:  # nothing in it changes the state
            run.append(m[0])
            i = m.end()
            continue
        c = text[i]
        if c == "\\" and i + 1 < n:
            run.append(text[i + 1])
            i += 2
            continue
        if c in QUOTES and depth == 0 and (i == 0 or not text[i - 1].isalnum()):
            close, j, body = QUOTES[c], i + 1, []
            while j < n:
                if text[j] == "\\" and j + 1 < n:
                    body.append(text[j + 1])
                    j += 2
                    continue
                if text[j] == close:
                    if j + 1 < n and text[j + 1] == close:  # a doubled quote stands for itself
                        body.append(close)
                        j += 2
                        continue
                    if j + 1 == n or not text[j + 1].isalnum():
                        break
                body.append(text[j])
                j += 1
            if j < n:
                if run:
                    yield "text", "".join(run)
                    run = []
                yield "quoted", "".join(body)
                i = j + 1
                continue
        if c in OPEN and last[CLOSE[OPEN.index(c)]] > i:
            depth += 1
        elif c in CLOSE and depth:
            depth -= 1
        elif depth == 0 and c in ";|/\t\n\r&+,":
            if run:
                yield "text", "".join(run)
                run = []
            yield "sep", c
            i += 1
            continue
        run.append(c)
        i += 1
    if run:
        yield "text", "".join(run)


def _enclosed(text: str) -> str:
    """Without blanks, trailing separators and one pair of marks around everything."""
    while True:
        t = text.strip().strip(";|/,&+").strip()
        if len(t) > 1 and ((t[0] in QUOTES and t[-1] == QUOTES[t[0]]) or (t[0] in OPEN and t[-1] == CLOSE[OPEN.index(t[0])])):
            inner = t[1:-1]
            if t[0] not in inner and t[-1] not in inner:
                text = inner
                continue
        return t


def _names(pieces: list[str]) -> Iterator[str]:
    """Values from the comma-separated pieces of one segment: a lone word is a surname and takes the next piece."""
    k = 0
    while k < len(pieces):
        p, taken = pieces[k].strip(), pieces[k]
        k += 1
        if not p:
            continue
        bare = _TITLE.sub("", p)
        if _ORG_WORD.search(p):
            takes = bool(_ORG_START.match(p)) and not p.lower().startswith("the ")
        else:
            takes = len(bare.split()) == 1
        if takes and k < len(pieces) and pieces[k].strip() and not _TITLE.match(pieces[k].strip()):
            taken += "," + pieces[k]
            k += 1
        yield taken.strip()


def split_authors(text: str | None) -> list[str]:
    """The persons and organisations of an author field, in order, each as written.

    Null, blank and placeholder fields have none. 'et al' and the like are dropped, titles stay. ';', '|', '/', a line
    break, '&', 'and' and 'with' separate; a comma separates unless it stands after a lone surname or before the place
    of an organisation. 'Institute for A and B' isn't divided.
    """
    if text is None:
        return []
    t = _enclosed(_MORE_END.sub("", text))
    if t.lower().strip(".[]()? ") in PLACEHOLDERS or not any(c.isalpha() for c in t):
        return []
    segments: list[list[str]] = [[""]]
    fixed: dict[int, str] = {}
    for kind, s in scan(t):
        if kind == "quoted":
            if segments[-1] != [""] and any(x.strip() for x in segments[-1]):
                segments.append([""])
            fixed[len(segments) - 1] = s
            segments.append([""])
        elif kind == "sep" and s == ",":
            segments[-1].append("")
        elif kind == "sep":
            segments.append([""])
        else:
            at = 0
            for m in _AND.finditer(s):
                left = ",".join(segments[-1]) + s[at : m.start()]
                if _ORG_AND.search(left):
                    continue
                segments[-1][-1] += s[at : m.start()]
                segments.append([""])
                at = m.end()
            segments[-1][-1] += s[at:]
    out = []
    for i, pieces in enumerate(segments):
        if i in fixed:
            out.append(fixed[i].strip())
            continue
        while pieces and not _LEAD.sub("", pieces[0] + " ").strip():
            pieces = pieces[1:]
        if not pieces:
            continue
        pieces[0] = _LEAD.sub("", pieces[0])
        for v in _names([(_LEAD.sub("", p) if _JOINED.match(p) else p) for p in pieces if p.strip()]):
            v = _enclosed(_MORE_END.sub("", v))
            if v and any(c.isalpha() for c in v):
                out.append(v)
    if len(fixed) == 1 and len(out) == 1 and out[0] != t:
        return split_authors(out[0])
    return out


def split_pages(text: str | None) -> list[str]:
    """The page ranges of a field, in order, each as written.

    Null and blank fields have none. 'pp.', 'pages' and enclosing brackets or quotes are dropped; a comma inside a
    number of thousands (1,204-1,210) doesn't separate.
    """
    if text is None:
        return []
    t = _enclosed(text)
    t = _enclosed(_ANNOUNCE.sub("", t))
    if not re.search(r"[0-9]|^[ivxlcdm]", t, re.I):
        return []
    numbers = re.findall(r"\d+(?:,\d{3}(?!\d))?", t)
    big = _THOUSAND.findall(t)
    if big and len(big) * 2 >= len(numbers):
        t = _THOUSAND.sub(lambda m: m[0].replace(",", "\0"), t)
    out = []
    for kind, s in scan(t):
        if kind == "sep":
            continue
        for v in _AND.split(f" {s} ") if kind == "text" else [s]:
            v = _enclosed(_ANNOUNCE.sub("", _LEAD.sub("", v.strip() + " ").strip()))
            if re.search(r"\w", v):
                out.append(v.replace("\0", ","))
    return out


SPLITTERS = {"authors": split_authors, "pages": split_pages}


def split_values(df: DataFrame, key: str, field: str, kind: str = "authors", least: int = 2) -> DataFrame:
    """(key, pos INT from 1, val): one row per value of ``field``, for fields of at least ``least`` values.

    Rows are independent: no shuffle, so hot values or keys need no care. Null keys are kept; null, blank and
    placeholder fields give no rows; repeated rows are each split. Extra columns of ``df`` are dropped.
    """
    split = SPLITTERS[kind]
    source = df.select(F.col(key).alias("k"), F.col(field).alias("f")).where(F.col("f").isNotNull())
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, pos, vals = [], [], []
            for k, f in zip(b["k"], b["f"]):
                got = split(f)
                if len(got) >= least:
                    keys += [k] * len(got)
                    pos += range(1, len(got) + 1)
                    vals += got
            yield pd.DataFrame({"k": pd.Series(keys, dtype=b["k"].dtype), "pos": pd.Series(pos, dtype="int32"), "val": pd.Series(vals, dtype=object)})

    return source.mapInPandas(run, f"k {key_type}, pos int, val string").withColumnRenamed("k", key)
