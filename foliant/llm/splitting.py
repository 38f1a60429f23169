"""Oversized texts cut at natural boundaries, by range-maximum queries over boundary strengths."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from foliant.llm.tokens import tokenizer

# strengths of a cut, weakest first; a cut inside a character is never allowed
INSIDE, ANY, WORD, LINE, CLAUSE, SENTENCE, PARAGRAPH = -1, 0, 1, 2, 3, 4, 5
_MARKS = (
    (WORD, re.compile(rb"[ \t\x0b\x0c\r\n]+")),
    (LINE, re.compile(rb"[ \t\r]*\n[ \t]*")),
    (CLAUSE, re.compile(rb"[,;:)\]](?:['\"])?[ \t\r\n]+")),
    (SENTENCE, re.compile(rb"[.!?](?:['\")\]]|\xe2\x80\x9d)*\s+")),
    (PARAGRAPH, re.compile(rb"\n[ \t\r]*(?:\n[ \t\r]*)+")),
)


def boundary_strengths(raw: bytes) -> np.ndarray:
    """For each byte position, how natural a cut before it is; blanks belong to what comes before them."""
    buf = np.frombuffer(raw, np.uint8)
    s = np.zeros(len(raw) + 1, np.int8)
    for strength, pattern in _MARKS:
        ends = np.fromiter((m.end() for m in pattern.finditer(raw)), np.int64)
        s[ends] = strength
    s[:-1][(buf & 0xC0) == 0x80] = INSIDE
    s[-1] = PARAGRAPH
    return s


class RangeMax:
    """Sparse table: the rightmost position of the largest value in any range of at most ``widest`` positions, in constant
    time. It has a level for each power of two up to ``widest``."""

    def __init__(self, values: np.ndarray, widest: int | None = None) -> None:
        n = len(values)
        key = values.astype(np.int64) * (n + 1) + np.arange(n)  # ties go right
        self.n, self.rows = n, [key]
        width = 1
        while 2 * width <= min(n, widest or n):
            low = self.rows[-1]
            self.rows.append(np.maximum(low[: len(low) - width], low[width:]))
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Of positions lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        return int(max(self.rows[k][lo], self.rows[k][hi - (1 << k) + 1]) % (self.n + 1))


STRETCH = 64  # lengths of the longest piece that are looked at together


def cut_points(raw: bytes, starts: Sequence[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of a text as token spans [a, b): each at most ``limit`` tokens, the next one begins ``overlap`` tokens
    before the end of the last, or somewhat less where a boundary asks for it. Every token is in a piece.

    The cut is the strongest boundary in the second half of the longest possible piece, the rightmost of equals; where
    that half has no boundary but those between any two characters, the strongest of the whole piece. The table of
    strengths covers a stretch of STRETCH * limit tokens at a time, so a long text needs no more memory than that.
    """
    n = len(starts)
    if n <= limit:
        return [(0, n)]
    byte_strength = boundary_strengths(raw)
    pieces, a = [], 0
    low = high = 0  # the stretch of tokens the table covers
    strength = table = None
    while n - a > limit:
        if table is None or a + limit >= high:
            low, high = a, min(n, a + STRETCH * limit)
            strength = byte_strength[low:high] if isinstance(starts, range) else byte_strength[starts[low:high]]
            if high == n:
                strength = np.append(strength, PARAGRAPH)
            table = RangeMax(strength, limit + 1)
            high = low + len(strength)
        top = a + limit - low
        b = table.argmax(min(a - low + max(limit // 2, overlap + 1, 1), top), top)
        if strength[b] <= ANY:
            wider = table.argmax(min(a - low + overlap + 1, top), top)
            b = wider if strength[wider] > ANY else b
        b = a + limit if strength[b] == INSIDE else b + low  # INSIDE: no whole character ends in the window
        pieces.append((a, b))
        if overlap:
            first = max(a + 1, b - overlap)
            last = max(first, b - overlap + overlap // 4)
            nxt = table.argmax(first - low, last - low)
            if strength[nxt] <= ANY:  # no boundary asks for less
                nxt = first - low + int(np.argmax(strength[first - low : last - low + 1]))
            a = nxt + low if strength[nxt] != INSIDE else first
        else:
            a = b
    pieces.append((a, n))
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 4096, overlap: int = 128, tokens: str = "bytes", keep_text: bool = True) -> DataFrame:
    """(key, pos, start_token, end_token, tokens, piece): the ordered pieces of the texts of more than ``limit`` tokens.

    Of all cuts in the second half of the longest possible piece the strongest is taken (paragraph, sentence, clause,
    line, word; failing these the strongest of the whole piece, then any character), the rightmost of equals; then the
    window steps back by the overlap. A piece exceeds
    nothing and never ends inside a character, unless one character has more tokens than half the limit. Null and blank
    texts, and texts within the limit, give no rows; repeated rows are each cut; other columns are dropped. Rows are
    independent: there is no shuffle. ``overlap`` must be less than half of ``limit``.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and less than half of limit")
    key_type = df.schema[key].dataType.simpleString()
    # no tokenizer here makes more tokens than a text has bytes, so shorter texts needn't leave the JVM
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(tokens)
        for b in batches:
            out: list[tuple] = []
            size = 0
            for k, t in zip(b["k"], b["t"]):
                raw = t.encode("utf-8", "surrogatepass")
                starts = tok.starts(t)
                if len(starts) <= limit:
                    continue
                for pos, (lo, hi) in enumerate(cut_points(raw, starts, limit, overlap)):
                    piece = None
                    if keep_text:
                        end = starts[hi] if hi < len(starts) else len(raw)
                        piece = raw[starts[lo] if lo else 0 : end].decode("utf-8", "replace")
                        size += len(piece)
                    out.append((k, pos, lo, hi, hi - lo, piece))
                if size > 8_000_000:
                    yield pd.DataFrame(out, columns=["k", "pos", "start_token", "end_token", "tokens", "piece"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["k", "pos", "start_token", "end_token", "tokens", "piece"])

    schema = f"k {key_type}, pos int, start_token int, end_token int, tokens int, piece string"
    return source.mapInPandas(run, schema).withColumnRenamed("k", key)
