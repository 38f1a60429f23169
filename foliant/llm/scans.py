"""Scanned text to readable paragraphs: lines labelled by a hidden Markov model, then words repaired by corpus counts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.session import cut

WINDOW, HALO = 512, 64  # blocks of an item that are labelled together, and blocks before and after them that are looked at
MISREAD_SHARE = 0.01  # how much of a word's occurrences one misreading of it may make up
SHORT_WORD, SHORT_SHARE = 3, 0.002  # words up to so many letters: likewise, and the word must occur 1 / SHORT_SHARE times
PAGE_HEIGHT = 792.0  # points; pages of another height are scaled to it
HEADER, BODY, BREAK = 0, 1, 2
STATES = ("header", "body", "break")

# What scanning makes of letters, as (printed, read)
CONFUSED = (
    ("e", "c"), ("c", "e"), ("a", "ä"), ("t", "f"), ("f", "t"), ("i", "l"), ("l", "i"), ("n", "ri"), ("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("u", "ii"), ("d", "cl"), ("cl", "d"),
    ("g", "q"), ("m", "rn"), ("rn", "m"), ("h", "b"), ("b", "h"), ("y", "v"), ("in", "m"), ("m", "in"), ("li", "h"), ("h", "li"), ("w", "vv"), ("fi", "ﬁ"), ("ri", "n"), ("b", "6"), ("b", "8"), ("u", "n"), ("n", "u"), ("j", "i"), ("t", "l"), ("l", "t"), ("o", "c"),
)
_DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "ä": "4"})
_NUMBER = re.compile(r"^[\[(—–\-\s]*([0-9lIiOoSsB|]{1,5})[\])—–\-\s]*$")
_EDGE_NUMBER = re.compile(r"(?:^[\[(—–\-\s]*([0-9lIOoSsB|]{1,5})[\])—–\-]*(?=\s))|(?:(?<=\s)[\[(—–\-]*\s?([0-9lIOoSsB|]{1,5})[\])—–\-\s]*$)")
_ROMAN = re.compile(r"^\W*[ivxlIVXL1]{1,7}\W*$")
_PAGE_MARKS = re.compile(r"^\s*[\[(—–-]*\s*(?:[0-9lIiOoSsB|]*[0-9][0-9lIiOoSsB|]*|[ivxlIVXL]+)\s*[\])—–-]*\s|\s[\[(—–-]*\s*(?:[0-9lIiOoSsB|]*[0-9][0-9lIiOoSsB|]*|[ivxlIVXL]+)\s*[\])—–-]*\s*$")
_VOLUME = re.compile(r"\bv[o0][l1i]\.?\s*[0-9lIoO]+\s*,?\s*n[o0]\.?\s*[0-9lIoO]+", re.I)
_CAPTION = re.compile(r"^(?:f[il1]g|table|plate|chart|map)\b\.?\s*[0-9lIoO]+", re.I)
_HYPHEN = re.compile(r"([^\W\d_](?:[\w'-]*[^\W_])?)[­¬‐-]\s*$")
_TOKEN = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_END = re.compile(r"[.!?:;]['\")\]”’]*\s*$")
_MIXED = re.compile(r"^(?=.*\d)(?=.*[lIOS])[\dlIOS]+$|[^\W\d_][015][^\W\d_]|^[015][^\W\d_]{2,}|[^\W\d_]{2,}[015]$|[äﬁﬂ]", re.I)

_NOT_LETTER = re.compile(r"[^a-z]+")
_ALIKE = str.maketrans({"1": "l", "i": "l", "f": "t", "0": "o", "5": "s", "c": "e", "ä": "a", "q": "g", "b": "h", "v": "y"})
_DIGIT = re.compile(r"\d")
_HYPHENS = ("-", "\u00ad", "¬", "\u2010")

FEATURES = ("zone", "form", "label", "layer")


def _letters(line: str) -> str:
    """The letters of a line as scanning may have read them, to compare running heads."""
    s = _PAGE_MARKS.sub(" ", f" {line.strip()} ").lower()
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("in", "m")):
        s = s.replace(a, b)
    return _NOT_LETTER.sub("", s.translate(_ALIKE))


def _number(text: str) -> int | None:
    t = text.translate(_DIGITS)
    return int(t) if t.isdigit() and any(c.isdigit() for c in text) else None


def page_scale(tops: list[float | None], pages: int = 4) -> float:
    """What makes the heights of an item's pages PAGE_HEIGHT. Nearly all of a page is printed on, so the height that
    ``pages`` blocks reach is a little less than the page's; between four fifths and all of PAGE_HEIGHT it is that."""
    known = sorted((abs(t) for t in tops if t is not None and t == t), reverse=True)
    reached = known[pages - 1] if len(known) >= 2 * pages else 0.0
    return 1.0 if not reached or 0.8 * PAGE_HEIGHT <= reached <= PAGE_HEIGHT else 0.97 * PAGE_HEIGHT / reached


def _zone(t: float | None, scale: float = 1.0) -> str:
    """Where on the page a top edge is; negative ones count from the top of the page."""
    if t is None or t != t:
        return "unknown"
    t = t * scale if t >= 0 else PAGE_HEIGHT + t * scale
    return "top" if t >= 745 else "bottom" if t <= 65 else "heading" if 710 <= t < 745 else "middle"


def _prior() -> dict[str, list[dict[str, float]]]:
    """Where fitting starts: rough chances of each feature's values in each state."""
    return {
        "zone": [{"top": 0.5, "bottom": 0.3, "unknown": 0.05, "middle": 0.13, "heading": 0.02}, {"middle": 0.93, "unknown": 0.05, "heading": 0.01, "top": 0.005, "bottom": 0.005}, {"heading": 0.5, "middle": 0.44, "unknown": 0.05, "top": 0.005, "bottom": 0.005}],
        "form": [
            {"page": 0.44, "head": 0.38, "volume": 0.1, "caps": 0.05, "number": 0.02, "short": 0.009, "prose": 0.0005, "caption": 0.0005},
            {"prose": 0.9, "short": 0.098, "number": 0.001, "page": 0.0005, "head": 0.0002, "volume": 0.0001, "caps": 0.0002, "caption": 0.0002},
            {"caps": 0.05, "short": 0.55, "caption": 0.15, "number": 0.1, "blank": 0.1, "prose": 0.049, "head": 0.0005, "page": 0.0003, "volume": 0.0002},
        ],
        "label": [{"furniture": 0.8, "text": 0.15, "other": 0.05}, {"furniture": 0.04, "text": 0.86, "other": 0.1}, {"furniture": 0.05, "text": 0.4, "other": 0.55}],
        "layer": [{"furniture": 0.8, "body": 0.1, "none": 0.1}, {"furniture": 0.1, "body": 0.75, "none": 0.15}, {"furniture": 0.1, "body": 0.75, "none": 0.15}],
    }


def start_model() -> dict:
    return {"emit": _prior(), "move": [[0.25, 0.6, 0.15], [0.1, 0.85, 0.05], [0.1, 0.8, 0.1]], "first": [0.5, 0.35, 0.15]}


def _logs(model: dict) -> tuple:
    emit = {f: [{v: math.log(p) for v, p in s.items()} for s in model["emit"][f]] for f in FEATURES}
    return emit, np.log(model["move"]), np.log(model["first"])


def viterbi(lines: list[tuple[str, ...]], logs: tuple) -> list[int]:
    """The most likely states of a sequence of lines, each a tuple of the FEATURES' values."""
    emit, move, first = logs
    if not lines:
        return []
    low = math.log(1e-5)
    chance: dict[tuple[str, ...], tuple[float, float, float]] = {}
    for line in set(lines):
        chance[line] = tuple(sum(emit[f][s].get(v, low) for f, v in zip(FEATURES, line) if v) for s in range(3))
    (m00, m01, m02), (m10, m11, m12), (m20, m21, m22) = move.tolist()
    e = chance[lines[0]]
    a, b, c = first[0] + e[0], first[1] + e[1], first[2] + e[2]
    back: list[tuple[int, int, int]] = []
    for line in lines[1:]:
        e = chance[line]
        x, i = max((a + m00, 0), (b + m10, 1), (c + m20, 2))
        y, j = max((a + m01, 0), (b + m11, 1), (c + m21, 2))
        z, k = max((a + m02, 0), (b + m12, 1), (c + m22, 2))
        a, b, c = x + e[0], y + e[1], z + e[2]
        back.append((i, j, k))
    out = [max((a, 0), (b, 1), (c, 2))[1]]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


class Page:
    """The blocks of one window in order, cut into lines with their features."""

    def __init__(self, blocks: list[tuple]) -> None:
        # a block: (block_id, page_no, label, content_layer, text, top)
        self.blocks = blocks
        self.lines: list[tuple[int, str]] = []  # (block, text)
        for b, block in enumerate(blocks):
            text = (block[4] or "").replace("\r", "")
            parts = text.split("\n") if text.strip() else [""]
            self.lines += [(b, p) for p in parts]
        size = Counter(b for b, _ in self.lines)
        scale = page_scale([b[5] for b in blocks])
        zone = [_zone(b[5], scale) for b in blocks]
        shifts, heads = Counter(), {}
        for b, text in self.lines:
            if size[b] == 1:
                for n in self.numbers(text):
                    if blocks[b][1] is not None:
                        shifts[n - blocks[b][1]] += 1 + (zone[b] in ("top", "bottom"))
                key = _letters(text)
                if len(key) > 5 and zone[b] in ("top", "bottom"):
                    heads.setdefault(key, set()).add(blocks[b][1])
        self.shift = max(shifts, key=lambda s: (shifts[s], -abs(s))) if shifts and max(shifts.values()) > 2 else None
        self.heads = {k for k, pages in heads.items() if len(pages) > 1}
        self.features = []
        for b, text in self.lines:
            if size[b] > 1:  # the block's place and labels say nothing about one of its lines
                self.features.append(("", self.form(text, blocks[b][1]), "", ""))
                continue
            label = blocks[b][2] or ""
            kind = "furniture" if label in ("page_header", "page_footer") else "text" if label in ("text", "paragraph", "list_item") else "other"
            self.features.append((zone[b], self.form(text, blocks[b][1]), kind, blocks[b][3] if blocks[b][3] in ("furniture", "body") else "none"))

    def numbers(self, text: str) -> list[int]:
        if len(text) > 8 and not _DIGIT.search(text):
            return []
        m = _NUMBER.match(text.strip())
        found = [m[1]] if m else [x for g in _EDGE_NUMBER.findall(text.strip()) for x in g if x]
        return [n for n in map(_number, found) if n is not None]

    def form(self, text: str, page: int | None) -> str:
        t = text.strip()
        if not t:
            return "blank"
        if len(t) >= 20 and t[0].islower():  # a line of text that goes on; no page mark is so long
            return "prose" if len(t) >= 36 or _END.search(t) else "short"
        if _CAPTION.match(t):
            return "caption"
        if _ROMAN.match(t):
            return "page"
        alone = _NUMBER.match(t)
        mine = self.shift is not None and page is not None and any(n == page + self.shift for n in self.numbers(t))
        if alone:
            return "page" if mine else "number"
        if _VOLUME.search(t) and len(_VOLUME.sub("", t).strip(" -—–[]()0123456789,.lO")) < 40:
            return "volume"
        key = _letters(t)
        if key in self.heads or (len(key) > 8 and mine and any(key in h or h in key for h in self.heads)):
            return "head"
        if len(key) > 8 and t.upper() == t:
            return "caps"
        return "prose" if _END.search(t) or len(t) >= 36 else "short"


def _group(pdf: pd.DataFrame) -> tuple[list[tuple], list[bool]]:
    pdf = pdf.sort_values(["idx", "block_id"], kind="stable")
    page = pdf["page_no"]
    own = pdf["own"].tolist()
    rows = [
        (int(i), None if p != p or p is None else int(p), l if isinstance(l, str) else None, c if isinstance(c, str) else None, t if isinstance(t, str) else None, x)
        for i, p, l, c, t, x in zip(pdf["block_id"], page, pdf["label"], pdf["content_layer"], pdf["text"], pdf["top"])
    ]
    return rows, own


def fit(blocks: DataFrame, items: int = 200, rounds: int = 3, most_blocks: int = 20_000) -> dict:
    """Emission and transition chances by repeated decoding and counting, on at most ``items`` items (the smallest hashes
    of their names) and at most ``most_blocks`` blocks of them; everything else is decoded with the result. An empty table
    keeps the starting values."""
    few = blocks.where("item IS NOT NULL").select("item").distinct().orderBy(F.xxhash64("item")).limit(items)
    sample = blocks.join(F.broadcast(few), "item").orderBy("item", "idx").limit(most_blocks).withColumn("own", F.lit(True)).withColumn("idx", F.coalesce(F.col("idx").cast("long"), F.col("block_id").cast("long"))).withColumn("top", top_edge(F.col("bbox"))).drop("bbox").toPandas()
    model = start_model()
    if not len(sample):
        return model
    sequences = [Page(_group(g)[0]).features for _, g in sample.groupby("item")]
    for _ in range(rounds):
        logs = _logs(model)
        emit = {f: [Counter(), Counter(), Counter()] for f in FEATURES}
        move, first = np.ones((3, 3)), np.ones(3)
        for seq in sequences:
            path = viterbi(seq, logs)
            for line, s in zip(seq, path):
                for f, v in zip(FEATURES, line):
                    emit[f][s][v] += 1
            for a, b in zip(path, path[1:]):
                move[a, b] += 1
            first[path[0]] += 1 if path else 0
        weight = 200.0  # of the starting values, in lines
        new = {}
        for f in FEATURES:
            new[f] = []
            for s in range(3):
                prior, n = model["emit"][f][s], sum(emit[f][s].values()) + weight
                values = set(prior) | set(emit[f][s])
                new[f].append({v: (emit[f][s][v] + weight * prior.get(v, 1e-5)) / n for v in values})
        model = {"emit": new, "move": (move / move.sum(1, keepdims=True)).tolist(), "first": (first / first.sum()).tolist()}
    return model


LABELLED = (
    "item string, block_id long, idx long, state string, embedded boolean, continued boolean, prose boolean, "
    "pieces array<string>, lefts array<string>, rights array<string>, words array<string>"
)


_TEXTS = pa.list_(pa.string())
_ARROW = {"item": pa.string(), "block_id": pa.int64(), "idx": pa.int64(), "state": pa.string(), "embedded": pa.bool_(), "continued": pa.bool_(), "prose": pa.bool_(), "pieces": _TEXTS, "lefts": _TEXTS, "rights": _TEXTS, "words": _TEXTS}


def _label(item: str, rows: list[tuple], own: list[bool], idx: list[int], logs: tuple) -> list[tuple]:
    page = Page(rows)
    states = viterbi(page.features, logs)
    per: list[list[tuple[str, int]]] = [[] for _ in rows]
    for (b, text), s, f in zip(page.lines, states, page.features):
        inside_break = s == BREAK and not f[0] and f[1] in ("caps", "head", "page", "volume")  # no heading stands inside a block
        per[b].append((text, HEADER if inside_break else s))
    body = [[t for t, s in lines if s != HEADER and t.strip()] for lines in per]
    furniture = [all(s == HEADER for _, s in lines) for lines in per]
    # a block of prose: several lines, or one that is labelled body
    prose = [not f and bool(ls) and (len(ls) > 1 or any(s == BODY for _, s in lines)) and not _CAPTION.match(ls[0].strip()) for f, ls, lines in zip(furniture, body, per)]
    after: list[int | None] = [None] * len(rows)
    nxt = None
    for b in range(len(rows) - 1, -1, -1):
        after[b] = nxt
        if prose[b]:
            nxt = b
    out = []
    for b, block in enumerate(rows):
        if not own[b]:
            continue
        follow = body[after[b]][0].strip() if after[b] is not None else ""
        pieces, lefts, rights, continued = [""], [], [], False
        lines = body[b]
        for k, line in enumerate(lines):
            s = line.strip()
            m = _HYPHEN.search(s) if s.endswith(_HYPHENS) else None
            right = None
            if m:
                target = lines[k + 1].strip() if k + 1 < len(lines) else follow if prose[b] else ""
                r = _TOKEN.match(target)
                right = r[0] if r and r[0][0].isalpha() else None
            if m and right:
                pieces[-1] += s[: m.start()] + m[1]
                lefts.append(m[1])
                rights.append(right)
                pieces.append("")
            else:
                pieces[-1] += s + ("" if k + 1 == len(lines) else " ")
        if prose[b] and follow:
            last = lines[-1].strip()
            open_end = not re.search(r"[.!?]['\")\]”’]*$", last)
            continued = open_end and (len(lines) > 1 or follow[0].islower() or follow[0].isdigit() or follow[0] == "(" or bool(_HYPHEN.search(last)))
        embedded = not furniture[b] and len(per[b]) > 1 and any(s == HEADER for _, s in per[b])
        words: list[str] = []
        for k, p in enumerate(pieces):
            w = _TOKEN.findall(p)
            if k and w and w[0] == rights[k - 1]:
                w = w[1:]
            if k < len(lefts) and w and w[-1] == lefts[k]:
                w = w[:-1]
            words += w
        # a bracket inside a word, or one that opens before a word and never closes, is a misread letter
        flat = " ".join(x.strip() for x in lines)
        if "(" in flat:
            words += re.findall(r"[^\W\d_]+\([^\W\d_]*", flat)
        if flat.count("(") > flat.count(")"):
            words += re.findall(r"(?<!\S)\([^\W\d_]+(?=[\s.,;])", flat)
        state = "header" if furniture[b] else "body" if prose[b] else "break"
        out.append((item, block[0], idx[b], state, embedded, continued, prose[b], pieces, lefts, rights, [] if furniture[b] else words))
    return out


def top_edge(bbox: Column) -> Column:
    """The upper edge of a box, negative where heights count from the top of the page."""
    return F.when(bbox["t"] < bbox["b"], -bbox["t"]).otherwise(bbox["t"])


def label_lines(blocks: DataFrame, model: dict | None = None) -> DataFrame:
    """Each block with its lines labelled and taken apart; see LABELLED.

    Items are decoded in windows of WINDOW blocks, each with HALO blocks before and after it in view, so no task holds more
    of an item than that, however long it is. Blocks without a place in their item stand where their id would. Tops of
    pages whose origin is above are made negative; see ``_zone``.
    """
    logs = _logs(model or fit(blocks))
    at = F.coalesce(F.col("idx").cast("long"), F.col("block_id").cast("long"))
    win = lambda i: F.floor(i / WINDOW).cast("long")
    here = win(F.col("idx"))
    # no block of an item has a number under 0, so there is no window before that of 0
    before = F.when(F.col("idx") >= 0, F.greatest(win(F.col("idx") - HALO), F.lit(0))).otherwise(win(F.col("idx") - HALO))
    source = (
        blocks.where("block_id IS NOT NULL AND item IS NOT NULL")
        .select("item", F.col("block_id").cast("long").alias("block_id"), at.alias("idx"), "page_no", "label", "content_layer", "text", top_edge(F.col("bbox")).alias("top"))
        .withColumn("win", F.explode(F.array_distinct(F.array(here, win(F.col("idx") + HALO), before))))
        .select("item", "win", (F.col("win") == here).alias("own"), "block_id", "idx", "page_no", "label", "content_layer", "text", "top")
    )
    placed = source.repartition("item", "win").sortWithinPartitions("item", "win", "idx", "block_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, own, idx, out = None, [], [], [], []
        for b in batches:
            for item, win, o, block, i, *rest in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                if (item, win) != now:
                    if any(own):  # a window that only others look into is none
                        out += _label(now[0], rows, own, idx, logs)
                    now, rows, own, idx = (item, win), [], [], []
                    if len(out) > 2000:
                        yield _batch(out)
                        out = []
                rows.append((block, *rest))
                own.append(o)
                idx.append(i)
        if any(own):
            out += _label(now[0], rows, own, idx, logs)
        yield _batch(out)

    return placed.mapInArrow(run, LABELLED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.values())], list(_ARROW))


def _undone(words: DataFrame) -> DataFrame:
    """(word, n, candidate): each word with what it would be if one or two confusions were undone."""

    def once(w: str) -> set[str]:
        return {w[:i] + a + w[i + len(b) :] for a, b in CONFUSED for i in range(len(w) - len(b) + 1) if w.startswith(b, i)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w, n in zip(b["word"], b["n"]):
                seen = once(w)
                if any(ord(c) > 127 or c.isdigit() for c in w):
                    seen |= {y for x in seen for y in once(x)}
                rows += [(w, n, c) for c in seen if c != w]
            yield pd.DataFrame(rows, columns=["word", "n", "candidate"])

    return words.mapInPandas(run, "word string, n long, candidate string")


def repair(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the corpus' word counts say: misread words as (word, printed), and broken words as (left, right, split).

    A word is misread if undoing a confusion gives a more frequent one, of which it is no more than MISREAD_SHARE, or one
    occurrence (short words no more than SHORT_SHARE); words that mix letters and digits are misread in any case (see _misread_blocks). A word broken at a line end is one word unless its hyphenated form is known better. Counts are
    over all blocks; very frequent words never leave the count.
    """
    words = labelled.select(F.explode("words").alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    vocabulary = cut(words.where("length(word) > 1"), "vocabulary")
    whole = _broken_words(labelled).groupBy(F.lower("raw").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    all_words = vocabulary.unionByName(whole).groupBy("word").agg(F.sum("n").alias("n"))
    suspects = _undone(all_words.where(r"word rlike '\\p{L}'").where("length(word) > 1"))
    known = vocabulary.select(F.col("word").alias("candidate"), F.col("n").alias("m"))
    short = F.length("word") <= SHORT_WORD
    better = F.when(short, (F.col("n") <= SHORT_SHARE * F.col("m")) & (F.length("candidate") > 1)).otherwise(F.col("n") <= 1 + MISREAD_SHARE * F.col("m"))
    misread = (
        suspects.join(known, "candidate")
        .where(better & (F.col("m") > F.col("n")))
        .groupBy("word")
        .agg(F.max_by("candidate", F.struct("m", "candidate")).alias("printed"))
    )
    pairs = labelled.select(F.explode(F.arrays_zip("lefts", "rights")).alias("p")).select("p.lefts", "p.rights").distinct().toDF("left", "right")
    low = pairs.select("left", "right", F.lower(F.concat("left", "right")).alias("joined"), F.lower(F.concat_ws("-", "left", "right")).alias("dashed"), F.lower("left").alias("start"))
    count = lambda key, name: vocabulary.select(F.col("word").alias(key), F.col("n").alias(name))
    starts = vocabulary.where("word like '%-%'").groupBy(F.substring_index("word", "-", 1).alias("start")).agg(F.sum("n").alias("s"))
    look = low.join(count("joined", "j"), "joined", "left").join(count("dashed", "d"), "dashed", "left").join(starts, "start", "left").na.fill(0, ["j", "d", "s"])
    hyphen = (F.col("d") > F.col("j")) | ((F.col("d") == 0) & (F.col("j") == 0) & (F.col("s") >= 20))
    return cut(misread, "misread"), cut(look.select("left", "right", (~hyphen).alias("split")), "broken")


def _broken_words(labelled: DataFrame) -> DataFrame:
    """(block_id, raw): the words broken at line ends, put together."""
    parts = labelled.where("state <> 'header'").select("block_id", F.explode(F.arrays_zip("lefts", "rights")).alias("p"))
    return parts.select("block_id", F.concat("p.lefts", "p.rights").alias("raw"))


def _misread_blocks(labelled: DataFrame, misread: DataFrame, frequent: int = 5000) -> DataFrame:
    """(block_id, word) of misread words in blocks. Words of more than a ``frequent``-th of all are few, so those of them
    that aren't misread are set aside by a broadcast; what is left has no hot key."""
    said = labelled.where("state <> 'header'").select("block_id", F.explode(F.array_distinct("words")).alias("raw")).unionByName(_broken_words(labelled)).withColumn("word", F.lower("raw"))
    total = labelled.select(F.sum(F.size("words"))).first()[0] or 0
    usual = labelled.select(F.explode("words").alias("w")).groupBy(F.lower("w").alias("word")).count().where(F.col("count") > total / frequent).join(misread, "word", "left_anti").select("word")
    rare = said.join(F.broadcast(usual), "word", "left_anti")
    odd = rare.where(F.col("raw").rlike(r"^(?=.*[0-9])(?=.*[lIOS])[0-9lIOS]+$|\p{L}[015]\p{L}|^[015]\p{L}{2,}|\p{L}{2,}[015]$|[äÄﬁﬂ(|!$]")).select("block_id", "raw", F.lit(None).cast("string").alias("printed"))
    return rare.join(misread, "word").select("block_id", "raw", "printed").unionByName(odd)


def find_faults(blocks: DataFrame) -> DataFrame:
    """(block_id, fault) of scanned blocks: 'furniture', 'embedded', 'split_word', 'misread', 'continued'.

    Furniture blocks have only that fault. Null and blank texts have none; a null bbox, label or layer is one more value
    of its feature; rows without item or block_id take no part; repeated rows are blocks of their own but give distinct
    rows. Other columns of ``blocks`` are ignored.
    """
    labelled = cut(label_lines(blocks), "labelled")
    misread, broken = repair(labelled)
    simple = labelled.select(
        "block_id",
        F.explode(F.array_compact(F.array(F.when(F.col("state") == "header", "furniture"), F.when((F.col("state") != "header") & F.col("embedded"), "embedded"), F.when((F.col("state") != "header") & F.col("continued"), "continued")))).alias("fault"),
    )
    breaks = labelled.where("state <> 'header'").select("block_id", F.explode(F.arrays_zip("lefts", "rights")).alias("p")).select("block_id", F.col("p.lefts").alias("left"), F.col("p.rights").alias("right"))
    split = breaks.join(broken.where("split"), ["left", "right"]).select("block_id", F.lit("split_word").alias("fault"))
    wrong = _misread_blocks(labelled, misread).select("block_id", F.lit("misread").alias("fault"))
    return simple.unionByName(split).unionByName(wrong).distinct()


def _numbered(prose: DataFrame) -> DataFrame:
    """Adds ``n``, the paragraph's number in its item: a block starts one unless the block of prose before it continues.

    Starts are counted in runs of WINDOW blocks first; then each run is told, by one row a run, how many came before it and
    whether its first block goes on with what the run before left open.
    """
    prose = prose.withColumn("win", F.floor(F.col("idx") / WINDOW))
    here = W.partitionBy("item", "win").orderBy("idx", "block_id")
    prose = prose.withColumn("_open", F.lag("continued").over(here))
    runs = prose.groupBy("item", "win").agg(F.max_by("continued", F.struct("idx", "block_id")).alias("_last"), F.sum(F.when(F.col("_open"), 0).when(F.col("_open").isNull(), 0).otherwise(1)).alias("_inner"))
    along = W.partitionBy("item").orderBy("win")
    runs = runs.withColumn("_first", F.when(F.lag("_last").over(along), 0).otherwise(1))
    before = F.coalesce(F.sum(F.col("_inner") + F.col("_first")).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    prose = prose.join(runs.select("item", "win", "_first", before.alias("_before")), ["item", "win"])
    start = F.when(F.col("_open").isNull(), F.col("_first")).when(F.col("_open"), 0).otherwise(1)
    return prose.withColumn("_start", start).withColumn("n", F.col("_before") + F.sum("_start").over(here.rowsBetween(W.unboundedPreceding, 0)))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(item, first_block, blocks, text): continuous paragraphs, headings and captions in reading order.

    Furniture and embedded lines are left out, broken words joined, misread words replaced by what was printed, and a block
    that continues is joined with the next block of prose. Blank blocks give nothing.
    """
    labelled = cut(label_lines(blocks), "labelled")
    misread, broken = repair(labelled)
    kept = labelled.where("state <> 'header' AND size(pieces) > 0")
    seams = kept.select("block_id", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "p")).select("block_id", "k", F.col("p.lefts").alias("left"), F.col("p.rights").alias("right"))
    joints = seams.join(broken, ["left", "right"]).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("split"), "").otherwise("-").alias("j")))).alias("joints"))
    fixes = _misread_blocks(labelled, misread).where("printed IS NOT NULL").groupBy("block_id").agg(F.collect_set(F.struct("raw", "printed")).alias("fixes"))
    joined = F.expr("aggregate(sequence(0, size(pieces) - 1), '', (t, i) -> concat(t, pieces[i], coalesce(get(joints, i).j, '')))")
    case: Column = F.expr("aggregate(coalesce(fixes, array()), raw_text, (t, f) -> regexp_replace(t, concat('\\\\b', f.raw, '\\\\b'), if(substr(f.raw, 1, 1) = upper(substr(f.raw, 1, 1)), initcap(f.printed), f.printed)))")
    text = kept.join(joints, "block_id", "left").join(fixes, "block_id", "left").withColumn("raw_text", joined).withColumn("fixed", case)
    prose = _numbered(text.where("prose"))
    whole = (
        prose.groupBy("item", "n")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "block_id", "fixed", F.when((F.element_at("pieces", -1) == "") & (F.size("lefts") > 0), F.get("joints", F.size("lefts") - 1).getField("j")).alias("last")))).alias("b"))
        .select("item", F.col("b")[0]["block_id"].alias("first_block"), F.size("b").alias("blocks"), F.expr("trim(aggregate(b, '', (t, x) -> concat(t, x.fixed, if(x.last is null, ' ', ''))))").alias("text"))
    )
    rest = text.where("NOT prose AND trim(fixed) <> ''").select("item", F.col("block_id").alias("first_block"), F.lit(1).alias("blocks"), F.trim("fixed").alias("text"))
    return whole.unionByName(rest)
