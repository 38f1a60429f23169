"""Deeply nested JSON records to linked flat tables, by vectorised structural indexing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

QUOTE, BACKSLASH = 34, 92
KEYS = ("texts", "tables", "prov", "data", "table_cells")
NODE_SCHEMA = "node string, parent_pos int, pos int, body string"
CHUNK_BYTES = 2_000_000


class Index:
    """Containers (objects and arrays) of a buffer of JSON records, found with bitmaps and prefix sums.

    ``kind`` is the opening byte, ``start`` and ``end`` the span, ``up`` the enclosing container (-1 at the top),
    ``key`` the index in KEYS of the member name (-1: none of these) and ``order`` the 0-based place in an array.
    ``good`` tells for each record whether quotes and brackets balance.
    """

    def __init__(self, buf: np.ndarray, starts: np.ndarray) -> None:
        n, at = len(buf), np.arange(len(buf))
        ends = np.append(starts[1:], n)
        plain = np.where(buf != BACKSLASH, at, -1)
        last_plain = np.maximum.accumulate(plain) if n else plain
        run = at - last_plain  # length of the run of backslashes that ends here
        before = np.concatenate(([0], run[:-1])) if n else run
        quote = (buf == QUOTE) & (before % 2 == 0)
        quotes = np.cumsum(quote)
        base = np.concatenate(([0], quotes))[starts]
        record_of = np.repeat(np.arange(len(starts)), ends - starts)
        inside = (quotes - base[record_of]) % 2 == 1
        opener = ((buf == 123) | (buf == 91)) & ~inside
        closer = ((buf == 125) | (buf == 93)) & ~inside
        depth = np.cumsum(opener.astype(np.int32) - closer.astype(np.int32))
        depth_base = np.concatenate(([0], depth))[starts]
        depth = depth - depth_base[record_of]
        self.good = np.ones(len(starts), bool)
        some = ends > starts
        self.good[some] &= (depth[ends[some] - 1] == 0) & ((quotes[ends[some] - 1] - base[some]) % 2 == 0)
        self.good[np.unique(record_of[depth < 0])] = False
        self.good &= some

        tok = np.flatnonzero((opener | closer | (((buf == 44) | (buf == 58)) & ~inside)) & self.good[record_of])
        char, rec = buf[tok], record_of[tok]
        is_open, is_close = opener[tok], closer[tok]
        level = depth[tok] - is_open  # the depth around a container, the depth inside for ',' and ':'
        pick = np.flatnonzero(is_open | is_close)
        order = pick[np.lexsort((tok[pick], level[pick], rec[pick]))]  # in one record and level: open, close, open, close
        o, c = order[0::2], order[1::2]
        sort = np.argsort(tok[o], kind="stable")
        o, c = o[sort], c[sort]
        self.good[np.unique(rec[o[char[c] != char[o] + 2]])] = False
        self.tok, self.record, self.kind, self.start, self.end, self.level = tok, rec[o], char[o], tok[o], tok[c], level[o]
        m = len(o)
        self.up, self.order, self.key = np.full(m, -1), np.zeros(m, int), np.full(m, -1)
        commas = tok[char == 44]
        comma_level = level[char == 44]
        for d in range(int(self.level.max(initial=-1)) + 1):
            here = np.flatnonzero(self.level == d)
            if d:
                above = np.flatnonzero(self.level == d - 1)
                self.up[here] = above[np.searchsorted(self.start[above], self.start[here]) - 1]
                at_level = commas[comma_level == d]
                self.order[here] = np.searchsorted(at_level, self.start[here]) - np.searchsorted(at_level, self.start[self.up[here]])
        named = np.flatnonzero((o > 1) & (char[np.maximum(o - 1, 0)] == 58))
        q = np.flatnonzero(quote)
        lo = q[np.minimum(np.searchsorted(q, tok[o[named] - 2]), len(q) - 1)] + 1 if len(q) else np.zeros(0, int)
        hi = q[np.searchsorted(q, tok[o[named] - 1]) - 1] if len(q) else np.zeros(0, int)
        for k, name in enumerate(KEYS):
            raw = name.encode()
            fit = np.flatnonzero(hi - lo == len(raw))
            for j, byte in enumerate(raw):
                fit = fit[buf[lo[fit] + j] == byte]
            self.key[named[fit]] = k
        self.quotes, self.char = q, char

    def strings_of_json(self, buf: np.ndarray, record: int, lo: int, hi: int) -> list[tuple[int, int]]:
        """Spans, with the quotes, of the string values in [lo, hi) whose content begins like an object or array."""
        q = self.quotes[(self.quotes >= lo) & (self.quotes < hi)]
        out = []
        for a, b in zip(q[0::2], q[1::2]):
            j = a + 1
            while j < b and (buf[j] in b" \t" or buf[j] == BACKSLASH and j + 1 < b and buf[j + 1] in b"nrt" and (j := j + 1)):
                j += 1
            if j < b and buf[j] in b"[{":
                out.append((int(a), int(b) + 1))
        return out


def _unpack(raw: bytes) -> bytes | None:
    """The record with JSON held in strings put in place of these strings; None if it can't be read. Each pass takes one level of
    escaping away and makes the record shorter, so it ends however deep the strings are."""
    while True:
        try:
            text = raw.strip()
            if text[:1] == b'"':
                raw = json.loads(text).encode()
                continue
            json.loads(text)
        except (ValueError, RecursionError):
            return None
        buf = np.frombuffer(text, np.uint8)
        index = Index(buf, np.array([0]))
        changed, at = [], 0
        for a, b in index.strings_of_json(buf, 0, 0, len(text)):
            after = text[b : b + 20].lstrip()
            if after[:1] == b":":
                continue
            try:
                inner = json.loads(text[a:b])
                json.loads(inner)
            except ValueError:
                continue
            head = text[:a].rstrip()
            name = head[:-1].rstrip().rsplit(b'"', 2)[-2] if head[-1:] == b":" else b""
            if head[-1:] == b":" and name.decode(errors="replace") not in KEYS and not ('"texts"' in inner or '"tables"' in inner):
                continue
            changed += [text[at:a], inner.encode()]
            at = b
        if not changed:
            return text
        raw = b"".join([*changed, text[at:]])


def extract(payloads: list[bytes]) -> Iterator[tuple[int, str, int, int, int, int, bytes]]:
    """(record, node, parent_pos, pos, start, end, buffer) of every object on the known paths."""
    buf_bytes = b"".join(payloads)
    buf = np.frombuffer(buf_bytes, np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in payloads])[:-1])).astype(int) if payloads else np.zeros(0, int)
    if not len(buf):
        return
    x = Index(buf, starts)
    good = x.good[x.record]
    obj = x.kind == 123

    def members(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objects in these containers: (object, container, place); an object in place of a list is a list of one."""
        own = np.flatnonzero(obj & np.isin(x.up, lists[~obj[lists]]) & good)
        single = lists[obj[lists]]
        return np.concatenate((own, single)), np.concatenate((x.up[own], single)), np.concatenate((x.order[own], np.zeros(len(single), int)))

    for root in ("texts", "tables"):
        found = np.flatnonzero((x.key == KEYS.index(root)) & good)
        if not len(found):
            continue
        found = found[np.lexsort((x.start[found], x.level[found], x.record[found]))]
        found = found[np.concatenate(([True], x.record[found][1:] != x.record[found][:-1]))]  # the outermost of each record
        items, _, place = members(found)
        pos_of = np.full(len(x.start), -1)
        pos_of[items] = place
        for i, p in zip(items, place):
            yield int(x.record[i]), root, -1, int(p), int(x.start[i]), int(x.end[i]), buf_bytes
        below = [(f"{root}.prov", np.flatnonzero((x.key == KEYS.index("prov")) & np.isin(x.up, items) & good), None)]
        if root == "tables":
            data = np.flatnonzero((x.key == KEYS.index("data")) & np.isin(x.up, items) & good)
            boxes, owner, _ = members(data)
            pos_of[boxes] = pos_of[x.up[owner]]
            holders = np.concatenate((items, boxes))
            below.append(("tables.table_cells", np.flatnonzero((x.key == KEYS.index("table_cells")) & np.isin(x.up, holders) & good), None))
        for node, lists, _ in below:
            kids, owner, place = members(lists)
            parent = pos_of[x.up[owner]]
            for i, pp, p in zip(kids, parent, place):
                yield int(x.record[i]), node, int(pp), int(p), int(x.start[i]), int(x.end[i]), buf_bytes


def flatten_nested(df: DataFrame, key: str, payload: str, body: bool = True) -> DataFrame:
    """(key, node, parent_pos, pos, body) for each non-null object on the paths texts, texts.prov, tables, tables.prov
    and tables.table_cells of a JSON column; body is the object's own JSON text (null unless ``body``).

    Batches of records are indexed at once: quotes, escapes and brackets become bitmaps, nesting depth is a prefix sum,
    containers are matched by sorting on (record, depth, position). An object in place of a list is a list of one, a
    string that holds JSON counts as its content, outer wrappers are passed through, null elements keep their place.
    Null, blank and unreadable payloads give no rows. Rows are independent: there is no shuffle, and repeated or hot
    keys need no care. Other columns of ``df`` are dropped.
    """
    key_type = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("k"), F.col(payload).alias("p")).where(F.col("p").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys: list = []
            raws: list[bytes] = []
            size = 0
            for k, p in zip(b["k"], b["p"]):
                raw = _unpack(p.encode("utf-8", "replace"))
                if raw is None:
                    continue
                keys.append(k)
                raws.append(raw)
                size += len(raw)
                if size > CHUNK_BYTES:
                    yield rows(keys, raws, b["k"].dtype)
                    keys, raws, size = [], [], 0
            yield rows(keys, raws, b["k"].dtype)

    def rows(keys: list, raws: list[bytes], dtype) -> pd.DataFrame:
        got = list(extract(raws))
        return pd.DataFrame(
            {
                "k": pd.Series([keys[g[0]] for g in got], dtype=dtype),
                "node": pd.Series([g[1] for g in got], dtype=object),
                "parent_pos": pd.Series([g[2] for g in got], dtype="int32"),
                "pos": pd.Series([g[3] for g in got], dtype="int32"),
                "body": pd.Series([g[6][g[4] : g[5] + 1].decode("utf-8", "replace") if body else None for g in got], dtype=object),
            }
        )

    return source.mapInPandas(run, f"k {key_type}, {NODE_SCHEMA}").withColumnRenamed("k", key)


BBOX = "struct<l:double,t:double,r:double,b:double>"


def layout_texts(nodes: DataFrame, key: str) -> DataFrame:
    """The texts as a flat table: (key, pos, label, content_layer, text)."""
    j = F.from_json("body", "label string, content_layer string, text string")
    return nodes.where("node = 'texts'").select(key, "pos", j.alias("j")).select(key, "pos", "j.label", "j.content_layer", "j.text")


def layout_provs(nodes: DataFrame, key: str) -> DataFrame:
    """The places of texts and tables: (key, owner, parent_pos, pos, page_no, l, t, r, b)."""
    j = F.from_json("body", f"page_no int, bbox {BBOX}")
    of = nodes.where("node IN ('texts.prov', 'tables.prov')").select(key, F.split("node", "[.]")[0].alias("owner"), "parent_pos", "pos", j.alias("j"))
    return of.select(key, "owner", "parent_pos", "pos", "j.page_no", "j.bbox.l", "j.bbox.t", "j.bbox.r", "j.bbox.b")


def layout_cells(nodes: DataFrame, key: str) -> DataFrame:
    """The table cells: (key, table_pos, pos, row, col, text)."""
    j = F.from_json("body", "text string, row_offset_idx int, col_offset_idx int")
    of = nodes.where("node = 'tables.table_cells'").select(key, F.col("parent_pos").alias("table_pos"), "pos", j.alias("j"))
    return of.select(key, "table_pos", "pos", F.col("j.row_offset_idx").alias("row"), F.col("j.col_offset_idx").alias("col"), "j.text")
