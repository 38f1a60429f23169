"""Held-out test passages inside documents, by greedy string tiling over Karp-Rabin seeds."""

from __future__ import annotations

import heapq
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SEED = 5  # words of a seed
STOCK_RUN, STOCK_ITEMS = 10, 3  # words shared in runs of STOCK_RUN by STOCK_ITEMS items are stock wording
MATCHED = 0.8  # share of a passage's words that must match exactly
CONTENT = 0.22  # share of the matched words that must not be common
COMMON_ITEMS = 0.2  # words in so large a share of the items are common
MIN_SEEDS = 4  # seeds near one diagonal that make a pair worth tiling
NEAR, NEAR_SEEDS = 15, 2  # or so many words that match around seeds, if there are at least so many near the diagonal
SIDE, SIDE_LONG = 4, 8  # words that must match on each side of an interruption; less than SIDE_LONG only in a passage that
SIDE_MATCHED = 0.95  # matches to this share
BAND = 16  # width of a diagonal band in words
INTERRUPTION = 80  # words of a document that may stand between two parts of a passage
COVERING = 5  # words of a tile that counts for coverage
TILE = 3  # words of a tile at least
GAP = 3  # words of an item that may be missing between neighbouring tiles of a passage
HITS = 4_000_000  # seeds found in texts that are worked on at a time
BOUND_WORDS = 1_000_000  # and words of items
BASE = np.uint64(0x9E3779B97F4A7C15)
MAX_TEST_BYTES = 64 << 20

# Characters that scanning takes for one another; both sides are mapped before comparing
_SAME = str.maketrans({"1": "l", "i": "l", "j": "l", "t": "l", "f": "l", "0": "o", "c": "o", "e": "o", "5": "s", "8": "b", "h": "b", "6": "b", "v": "u", "y": "u"})
_GROUPS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("nn", "m"))
_BREAK = re.compile(r"[\xad\xac\u2010-](?<=\w.)[\xad\xac\u2010-]*\s*(?=\w)")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """Lower-case words without accents, punctuation and hyphens; a word broken at a line end is whole again."""
    if not text.isascii():
        text = text.replace("¬", "-").replace("­", "-").replace("‐", "-")
        text = _FOREIGN.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), unicodedata.normalize("NFKD", text))
    if "-" in text:
        text = _BREAK.sub("", text)
    return _WORD.findall(text.lower())


def skeleton(word: str) -> str:
    """The same for words that differ in characters which scanning confuses."""
    for a, b in _GROUPS:
        word = word.replace(a, b)
    return word.translate(_SAME)


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every run of k ids, modulo 2**64."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * BASE + x[j : j + n]
    return h


@dataclass
class TestIndex:
    """Seeds of all test items, however many items share them: sorted hashes with item number and place. For the words of
    all items in a row, item j from ``first[j]``: the number of the run of TILE words that begins there (``run_at``; 0 for
    none, from 1 by ``runs``, the sorted hashes), whether the word is no stock wording (``own``) and neither that nor common
    (``content``). ``usual`` says by word number which words are common, ``shared`` how many words from one on (up to
    STOCK_RUN - 1) STOCK_ITEMS items have alike: a set phrase, if no stock wording."""

    ids: list[int]
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    stock: list[np.ndarray]
    common: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    first: np.ndarray
    runs: np.ndarray
    run_at: np.ndarray
    own: np.ndarray
    content: np.ndarray
    usual: np.ndarray
    shared: np.ndarray


def build_index(rows: list[tuple[int, str]]) -> TestIndex:
    vocabulary: dict[str, int] = {}
    ids, items = [], []
    for i, text in rows:
        w = words_of(text)
        ids.append(i)
        items.append(np.array([vocabulary.setdefault(skeleton(x), len(vocabulary) + 1) for x in w], dtype=np.int64))

    def table(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = [rolling(x, k) for x in items]
        n = np.concatenate([np.full(len(x), j) for j, x in enumerate(h)]) if h else np.zeros(0, int)
        p = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, int)
        return (np.concatenate(h) if h else np.zeros(0, np.uint64)), n, p

    def spread(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """In how many items each hash occurs."""
        if not len(h):
            return np.zeros(0, int)
        order = np.argsort(h, kind="stable")  # items stay in order
        same = h[order][1:] == h[order][:-1]
        other = np.concatenate(([True], ~same | (n[order][1:] != n[order][:-1])))
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        out = np.empty(len(h), int)
        out[order] = np.repeat(np.add.reduceat(other, begin, dtype=int), np.diff(np.append(begin, len(h))))
        return out

    seen = np.zeros(len(vocabulary) + 1, int)
    for x in items:
        seen[np.unique(x)] += 1
    usual = seen >= max(STOCK_ITEMS, COMMON_ITEMS * len(items))
    common = [usual[x] for x in items]
    h, n, p = table(STOCK_RUN)
    many = spread(h, n) >= STOCK_ITEMS
    stock = [np.zeros(len(x), bool) for x in items]
    for j, at in zip(n[many], p[many]):
        stock[j][at : at + STOCK_RUN] = True
    first = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(int)
    h, n, p = table(TILE)
    runs, number = np.unique(h, return_inverse=True)
    run_at = np.zeros(first[-1], int)
    run_at[first[n] + p] = number.ravel() + 1
    shared = np.zeros(first[-1], int)
    for k in range(TILE, STOCK_RUN):
        h, n, p = table(k)
        many = spread(h, n) >= STOCK_ITEMS
        shared[first[n[many]] + p[many]] = k
    own = ~np.concatenate([*stock, np.zeros(0, bool)])
    content = own & ~np.concatenate([*common, np.zeros(0, bool)])
    h, n, p = table(SEED)
    order = np.argsort(h, kind="stable")
    return TestIndex(ids, vocabulary, items, stock, common, h[order], n[order], p[order], first, runs, run_at, own, content, usual, shared)


def tiles(a: np.ndarray, b: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest common run of unmarked words is marked, again and again, down to ``least``.
    (place in a, place in b, length), runs found by extending equal Karp-Rabin hashes of ``least`` words."""
    ha, hb = rolling(a, least), rolling(b, least)
    if not len(ha) or not len(hb):
        return []
    order = np.argsort(hb, kind="stable")
    sorted_b = hb[order]
    lo, hi = np.searchsorted(sorted_b, ha, "left"), np.searchsorted(sorted_b, ha, "right")
    n = hi - lo
    ia = np.repeat(np.arange(len(ha)), n)
    ib = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    if not len(ia):
        return []
    return _marked(_runs(ia, ib, least), len(a), len(b), least)


def _runs(ia: np.ndarray, ib: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the longest common runs that equal runs of ``least`` words at ``ia`` and ``ib``
    make up, by their place in b."""
    diagonal = ib - ia
    order = np.lexsort((ia, diagonal))
    ia, ib, diagonal = ia[order], ib[order], diagonal[order]
    begin = np.flatnonzero(np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (ia[1:] != ia[:-1] + 1))))
    size = np.diff(np.append(begin, len(ia))) + least - 1
    x, y = ia[begin], ib[begin]
    order = np.argsort(y, kind="stable")
    return list(zip(x[order].tolist(), y[order].tolist(), size[order].tolist()))


def _marked(runs: list[tuple[int, int, int]], len_a: int, len_b: int, least: int, begin_b: int = 0) -> list[tuple[int, int, int]]:
    """The tiles that greedy marking makes of the common runs of a and the ``len_b`` words of b from ``begin_b`` on."""
    heap = [(-n, x, y) for x, y, n in runs]
    heapq.heapify(heap)
    used_a, used_b = bytearray(len_a), bytearray(len_b)
    out = []
    while heap:
        size, x, y = heapq.heappop(heap)
        size, z = -size, y - begin_b
        if used_a.find(1, x, x + size) < 0 and used_b.find(1, z, z + size) < 0:
            used_a[x : x + size] = used_b[z : z + size] = b"\1" * size
            out.append((x, y, size))
        elif size > least:
            used = int.from_bytes(used_a[x : x + size]) | int.from_bytes(used_b[z : z + size])
            s = 0
            for free in used.to_bytes(size).split(b"\1"):
                if len(free) >= least:
                    heapq.heappush(heap, (-len(free), x + s, y + s))
                s += len(free) + 1
    return sorted(out)


def _worth_tiling(index: TestIndex, ids: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray, reach: int = 22, shift: int = 1) -> np.ndarray:
    """Of seeds at ``at`` in the documents and ``place`` in the items: whether NEAR words match within ``reach`` words of
    the seed, on its diagonal or up to ``shift`` beside it."""
    flat, first = np.concatenate(index.items), np.concatenate(([0], np.cumsum([len(x) for x in index.items])))
    good = np.zeros(len(at), bool)
    for lo in range(0, len(at), 100_000):
        part = slice(lo, lo + 100_000)
        steps = np.arange(-reach, reach + SEED)
        k = place[part, None] + steps
        inside = (k >= 0) & (k < (first[item[part] + 1] - first[item[part]])[:, None])
        word_at = np.where(inside, first[item[part]][:, None] + k, 0)
        words = np.where(inside, flat[word_at], -1)
        same = np.zeros(words.shape, bool)
        for d in range(-shift, shift + 1):
            same |= words == ids[np.clip(at[part, None] + steps + d, 0, len(ids) - 1)]
        good[part] = same.sum(1) >= NEAR
    return good


def longest_passage(found: list[tuple[int, int, int]], stock: np.ndarray, common: np.ndarray, gap: int = GAP, interruption: int = INTERRUPTION, shared: np.ndarray | None = None) -> int:
    """Words of the item, stock wording left out, in the longest chain of tiles in order.

    Neighbouring tiles belong together if at most ``gap`` words of the item are missing between them and about as many
    words of the document; once in a chain the document may have up to ``interruption`` words in between, if at least
    SIDE_LONG words match on both sides, or SIDE where nearly all words of the chain match. Of a chain's words the share
    MATCHED must be in tiles, and of its matched words the share CONTENT must not be common ones or in tiles that are set
    phrases as a whole (``shared`` says for each word how many from there on are one), so that strings of set phrases with
    other words between aren't taken for it. All chains are followed but those that an earlier start is as
    good as in every respect: what comes after adds the same to both.
    """
    best = 0
    weight = np.concatenate(([0], np.cumsum(~stock)))
    content = np.concatenate(([0], np.cumsum(~stock & ~common)))
    # for each tile, the chains that end with it: (first word of the item, 0 without an interruption, 1 with one, 2 with one
    # after a short side) to words matched, of these content words, and matched since the interruption
    states: list[dict[tuple[int, int], tuple[int, int, int]]] = []
    for k, (x, y, n) in enumerate(found):
        own, rare = int(weight[x + n] - weight[x]), int(content[x + n] - content[x])
        if shared is not None and n <= shared[x]:
            rare = 0
        mine = {(x, 0): (own, rare, 0)}
        for j in range(k - 1, -1, -1):
            px, py, pn = found[j]
            da, db = x - px - pn, y - py - pn
            if da > gap:  # tiles share no words of the item, so those before end earlier still
                break
            if not (0 <= da and 0 <= db <= max(da + 2, interruption)):
                continue
            broken = db > da + 2
            for (s, u), (m, c, r) in states[j].items():
                if broken and (u or m < SIDE):
                    continue
                to = (s, u if not broken else 1 if m >= SIDE_LONG else 2)
                mine[to] = max(mine.get(to, (0, 0, 0)), (m + own, c + rare, own if broken else r + own if u else 0))
        end = int(weight[x + n])
        kept: dict[tuple[int, int], tuple[int, int, int]] = {}
        front: list[list[tuple]] = [[], [], []]
        for (s, u), (m, c, r) in sorted(mine.items()):
            span = end - int(weight[s])
            worth = (m - MATCHED * span, m - SIDE_MATCHED * span, c - CONTENT * m, r, m)
            if any(all(p >= q for p, q in zip(w, worth)) for w in front[u]):
                continue
            front[u].append(worth)
            kept[s, u] = m, c, r
            whole = not u or (r >= SIDE and ((u == 1 and r >= SIDE_LONG) or m >= SIDE_MATCHED * span))
            if span > best and whole and m >= MATCHED * span and c >= CONTENT * m:
                best = span
        states.append(kept)
    return best


def _hits(index: TestIndex, of: np.ndarray, h: np.ndarray, at: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in the texts, text, number in the index) of the seeds ``h`` that occur among the seeds ``of`` of the index. More
    than HITS come in several parts: the texts are halved, for one text the items. No pair of a text and an item is divided."""
    hashes = index.hashes[of]
    lo = np.searchsorted(hashes, h, "left")
    hit = hashes[np.minimum(lo, len(hashes) - 1)] == h if len(hashes) else np.zeros(len(h), bool)
    h, at, text, lo = h[hit], at[hit], text[hit], lo[hit]
    if not len(h):
        return
    n = np.searchsorted(hashes, h, "right") - lo
    total = int(n.sum())
    if total > HITS and text[0] != text[-1]:
        half = text[np.searchsorted(np.cumsum(n), total // 2)]
        cut = np.searchsorted(text, half, "left") or np.searchsorted(text, half, "right")
        for part in (slice(0, cut), slice(cut, None)):
            yield from _hits(index, of, h[part], at[part], text[part])
        return
    if total > HITS and (low := index.item[of].min()) != (high := index.item[of].max()):
        upper = index.item[of] > (low + high) // 2
        for part in (of[~upper], of[upper]):
            yield from _hits(index, part, h, at, text)
        return
    yield np.repeat(at, n), np.repeat(text, n), of[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def _possible(index: TestIndex, run_at: np.ndarray, start: np.ndarray, text: np.ndarray, item: np.ndarray, least_words: int, least_coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of a text and an item, in the order of texts: whether the item's words in runs of TILE that the text has
    too (numbers ``run_at``) are enough for a passage, and whether for the coverage. Tiling the others can't give a leak:
    tiles are made of such runs, a passage never goes on over more than GAP words of the item outside them, and
    ``longest_passage`` asks for the shares MATCHED and CONTENT."""
    passage, coverage = np.zeros(len(text), bool), np.zeros(len(text), bool)
    seen = np.zeros(len(index.runs) + 1, bool)
    length = index.first[item + 1] - index.first[item]
    ends = np.cumsum(length)
    own_sum, content_sum = (np.concatenate(([0], np.cumsum(x))) for x in (index.own, index.content))
    least, lo = MATCHED * least_words, 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - length[lo] + BOUND_WORDS, "right")))
        n = length[lo:hi]
        begin = np.cumsum(n) - n
        word = np.arange(n.sum()) + np.repeat(index.first[item[lo:hi]] - begin, n)
        number, run = index.run_at[word], np.zeros(len(word), bool)
        edges = np.flatnonzero(np.diff(text[lo:hi], prepend=-1, append=-1))
        bounds = np.append(begin, len(word))[edges]
        for t, a, b in zip(text[lo:hi][edges[:-1]], bounds[:-1], bounds[1:]):
            there = run_at[start[t] : max(start[t], start[t + 1] - TILE + 1)]
            seen[there] = True
            seen[0] = False
            run[a:b] = seen[number[a:b]]
            seen[there] = False
        at = np.flatnonzero(run)
        runs = np.diff(np.searchsorted(at, np.append(begin, len(word))))
        enough = runs * TILE >= least  # none has more than TILE words
        at, owner = at[np.repeat(enough, runs)], np.repeat(np.arange(lo, hi)[enough], runs[enough])
        lo = hi
        if not len(at):
            continue
        step, at = np.diff(at), word[at]
        other = np.diff(owner) > 0  # no run begins in an item's last words
        size = np.minimum(np.append(step, TILE), TILE)  # words up to the next run
        apart = np.concatenate(([0], np.flatnonzero(other | (step > GAP + TILE)) + 1))
        matched = np.add.reduceat(own_sum[at + size] - own_sum[at], apart)
        content = np.add.reduceat(content_sum[at + size] - content_sum[at], apart)
        passage[owner[apart[(matched >= least) & (content >= CONTENT * least)]]] = True
        long = np.ones(max(len(at) - COVERING + TILE, 0), bool)  # COVERING words in such runs begin here
        for k in range(COVERING - TILE):
            long &= step[k : k + len(long)] == 1
        long = np.flatnonzero(long)
        if len(long):
            at, owner = at[long], owner[long]
            step, other = np.diff(at), np.diff(owner) > 0
            size = np.append(np.where(other, COVERING, np.minimum(step, COVERING)), COVERING)
            apart = np.concatenate(([0], np.flatnonzero(other) + 1))
            own, owner = np.add.reduceat(own_sum[at + size] - own_sum[at], apart), owner[apart]
            all_own = own_sum[index.first[item[owner] + 1]] - own_sum[index.first[item[owner]]]
            coverage[owner[(own >= least_words) & (own >= least_coverage * all_own)]] = True
    return passage, coverage


def _gathered(at: np.ndarray, unusual: np.ndarray, least_words: int) -> bool:
    """The same for the words of one text in runs of TILE, which begin at ``at``, that the item has too: whether enough for a
    passage stand together, or in two places with no more than INTERRUPTION words between. ``unusual`` sums up which words
    of the text aren't common."""
    if not len(at):
        return False
    least = MATCHED * least_words
    step = np.diff(at)
    n = np.minimum(np.append(step, TILE), TILE)  # words up to the next run
    apart = np.concatenate(([0], np.flatnonzero(step > GAP + TILE + 2) + 1))  # a tile begins up to GAP + 2 words after the last
    matched = np.add.reduceat(n, apart).tolist()
    content = np.add.reduceat(unusual[at + n] - unusual[at], apart).tolist()
    begin, end = at[apart].tolist(), (at[np.append(apart[1:], len(at)) - 1] + TILE - 1).tolist()
    for a in range(len(begin)):
        if matched[a] >= least and content[a] >= CONTENT * least:
            return True
        for b in range(a + 1, len(begin)):
            if begin[b] - end[a] > INTERRUPTION + 1:
                break
            if matched[a] + matched[b] >= least and content[a] + content[b] >= CONTENT * least:
                return True
    return False


def _within(runs: list[tuple[int, int, int]], places: list[int], lo: int, hi: int, length: int) -> list[tuple[int, int, int]]:
    """What lies within the words ``lo`` to ``hi`` of the text of common runs with an item of ``length`` words; the runs are
    in the order of their ``places`` in the text."""
    out = []
    for x, y, n in runs[bisect_left(places, lo - length) : bisect_left(places, hi)]:
        cut = max(lo - y, 0)
        n = min(y + n, hi) - y - cut
        if n >= TILE:
            out.append((x + cut, y + cut, n))
    return out


def _reaches(runs: list[tuple[int, int, int]], own: list[int], content: list[int], least_words: int) -> bool:
    """Whether the item's words in the given runs, never more than GAP words apart, are enough for a passage; ``own`` and
    ``content`` sum up the item's words of the kinds."""
    least = MATCHED * least_words
    end, matched, rare = 0, 0, 0
    for x, _, n in sorted(runs):
        if x > end + GAP:
            matched = rare = 0
        x, end, before = max(x, end), max(x + n, end), end
        if end > before:
            matched += own[end] - own[x]
            rare += content[end] - content[x]
            if matched >= least and rare >= CONTENT * least:
                return True
    return False


def search(index: TestIndex, texts: list[str], least_words: int, known: dict[str, int], least_coverage: float = 1.0) -> list[tuple[int, int, int, float]]:
    """(text number, item number, words, coverage) of the leaks in a batch of texts."""
    per_text, number = [], known.__getitem__
    for t in texts:
        w = words_of(t)
        if len(known) > 300_000:
            known.clear()
        for x in w:
            if x not in known:
                known[x] = index.vocabulary.get(skeleton(x), 0)
        per_text.append(np.fromiter(map(number, w), np.int64, len(w)))
    ids = np.concatenate([*per_text, np.zeros(0, np.int64)])
    lengths = [len(x) for x in per_text]
    start = np.concatenate(([0], np.cumsum(lengths)))
    if len(ids) < SEED or not len(index.hashes):
        return []
    unknown = np.concatenate(([0], np.cumsum(ids == 0)))
    run_at = np.zeros(len(ids), int)
    known_runs = np.flatnonzero(unknown[TILE:] == unknown[:-TILE])
    r = rolling(ids, TILE)[known_runs]
    number = np.minimum(np.searchsorted(index.runs, r), len(index.runs) - 1)
    run_at[known_runs] = np.where(index.runs[number] == r, number + 1, 0)
    shared = run_at > 0
    whole = shared[: -SEED + 1].copy()  # the runs of a seed that the index has are there too
    for k in range(1, SEED - TILE + 1):
        whole &= shared[k : len(ids) - SEED + 1 + k]
    whole = np.flatnonzero(whole)
    text = np.searchsorted(start, whole, "right") - 1
    inside = whole + SEED <= start[text + 1]
    whole, text = whole[inside], text[inside]
    h = rolling(ids, SEED)
    out = []
    for part in _hits(index, np.arange(len(index.hashes)), h[whole], whole, text):
        out += _leaks(index, ids, start, run_at, *part, least_words, least_coverage)
    return out


def _leaks(index: TestIndex, ids: np.ndarray, start: np.ndarray, run_at: np.ndarray, at: np.ndarray, text: np.ndarray, seed: np.ndarray, least_words: int, least_coverage: float) -> list[tuple[int, int, int, float]]:
    """``search`` for all pairs of the seeds found."""
    item = index.item[seed]
    pair = text * len(index.items) + item
    pairs, n = np.unique(pair, return_counts=True)
    pairs = pairs[n >= NEAR_SEEDS]
    passage, coverage = _possible(index, run_at, start, *np.divmod(pairs, len(index.items)), least_words, least_coverage)
    possible = np.isin(pair, pairs[passage | coverage])
    covering = set(pairs[coverage].tolist())
    pair, item, at, text, place = pair[possible], item[possible], at[possible], text[possible], index.place[seed[possible]]
    if not len(at):
        return []
    band = (at - start[text] - place) // BAND
    u, first, back, c = np.unique(pair * (1 << 32) + band + (1 << 31), return_index=True, return_inverse=True, return_counts=True)
    beside = u[1:] == u[:-1] + 1  # seeds of a chain may lie on both sides of a band's edge
    many = c.copy()
    many[:-1] += np.where(beside, c[1:], 0)
    many[1:] = np.maximum(many[1:], np.where(beside, c[:-1] + c[1:], 0))
    enough, few = many >= MIN_SEEDS, np.flatnonzero((many >= NEAR_SEEDS) & (many < MIN_SEEDS))
    one = first[few]  # the seeds of a band have one neighbourhood
    enough[few] = _worth_tiling(index, ids, at[one], item[one], place[one])
    keep = np.isin(pair, u[enough] >> 32)
    pair, at, place, good = pair[keep], at[keep], place[keep], enough[back.ravel()][keep]
    if not len(at):
        return []
    order = np.argsort(pair, kind="stable")
    pair, at, place, good = pair[order], at[order], place[order], good[order]
    edges = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True]))).tolist()
    out, last = [], -1
    seen = np.zeros(len(index.runs) + 1, bool)
    for a, b in zip(edges[:-1], edges[1:]):
        t, j = divmod(int(pair[a]), len(index.items))
        covers = int(pair[a]) in covering
        if t != last:
            last, size = t, int(start[t + 1] - start[t])
            text_run = run_at[start[t] : start[t + 1] - TILE + 1]
            known_at = np.flatnonzero(text_run)
            known_run = text_run[known_at]
            unusual = np.concatenate(([0], np.cumsum(~index.usual[ids[start[t] : start[t + 1]]])))
        item_run = index.run_at[index.first[j] : index.first[j + 1]]
        seen[item_run] = True
        alike = seen[known_run]
        seen[item_run] = False
        run, run_place = known_run[alike], known_at[alike]
        if not (covers or _gathered(run_place, unusual, least_words)):
            continue
        words, stock = index.items[j], index.stock[j]
        length, best = len(words), 0
        # windows around the seeds: a passage lies within the item's length and one interruption of its seeds
        order = np.argsort(at[a:b], kind="stable")
        seeds, sound = at[a:b][order] - start[t], good[a:b][order]
        cuts = np.flatnonzero(np.diff(seeds) > 2 * length) + 1
        around = []
        for g, any_good in zip(np.split(seeds, cuts), np.split(sound, cuts)):
            if any_good.any():
                around.append((max(0, int(g[0]) - length - INTERRUPTION), min(size, int(g[-1]) + length + INTERRUPTION)))
        # and what is around each diagonal alone: a longer run elsewhere may have taken words of a passage
        windows = dict.fromkeys(around)
        diagonals = np.sort((at - place)[a:b][good[a:b]] - start[t])
        for d in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > INTERRUPTION) + 1):
            windows[max(0, int(d[0]) - INTERRUPTION), min(size, int(d[-1]) + length + INTERRUPTION)] = None
        near = np.zeros(len(run), bool)
        for window in windows:
            near[slice(*np.searchsorted(run_place, window))] = True
        run, run_place = run[near], run_place[near]
        order = np.argsort(item_run, kind="stable")
        item_run = item_run[order]
        lo = np.searchsorted(item_run, run, "left")
        n = np.searchsorted(item_run, run, "right") - lo
        runs = _runs(order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)], np.repeat(run_place, n), TILE)
        places = [y for _, y, _ in runs]
        phrases = index.shared[index.first[j] : index.first[j + 1]]
        own, content = (np.concatenate(([0], np.cumsum(x[index.first[j] : index.first[j + 1]]))).tolist() for x in (index.own, index.content))
        for lo, hi in windows:
            part = _within(runs, places, lo, hi, length)
            if covers or _reaches(part, own, content, least_words):
                found = windows[lo, hi] = _marked(part, length, hi - lo, TILE, lo)
                best = max(best, longest_passage(found, stock, index.common[j], shared=phrases))
        if best < least_words and not covers:
            continue
        covered = np.zeros(length, bool)
        for lo, hi in around:
            found = windows[lo, hi]
            if found is None:
                found = _marked(_within(runs, places, lo, hi, length), length, hi - lo, TILE, lo)
            for x, _, n in found:
                if n >= COVERING:
                    covered[x : x + n] = True
        share = int((covered & ~stock).sum())
        if best >= least_words or (share >= least_words and share >= least_coverage * own[-1]):
            out.append((t, j, best, share / own[-1] if own[-1] else 0.0))
    return out


def find_leaks(documents: DataFrame, tests: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least_words: int = 20, least_coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, words, coverage): every document with at least ``least_words`` successive words of a test item in
    order, ``words`` of them, or with the share ``least_coverage`` of its words in tiles of COVERING words or more in any
    order, at least ``least_words`` too; stock wording counts for neither. Where only the coverage is enough, ``words`` is
    less than ``least_words``.

    Seeds of five words are looked up in the index of the test items for whole texts, also those that many items share;
    pairs with MIN_SEEDS near one diagonal, or NEAR_SEEDS with NEAR matching words around one, are tiled greedily, unless
    upper bounds of what tiling can give (``_possible``, ``_gathered``, ``_reaches``) rule a leak out. Case, punctuation, accents, spacing, words broken at line ends, characters that scanning confuses, a few
    changed words and one interruption don't matter. Wording that several items share isn't counted.

    The test items are a stated, bounded query set: they are broadcast, and more than MAX_TEST_BYTES of them raise an
    error (split them then, each part against all documents). Documents are read once, without a shuffle. Null, empty and
    short texts give no rows; repeated rows give repeated rows; other columns are dropped.
    """
    size = tests.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if size > MAX_TEST_BYTES:
        raise ValueError(f"{size} bytes of test items; search them in parts of at most {MAX_TEST_BYTES}")
    rows = [(r[0], r[1]) for r in tests.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).distinct().orderBy(item_id).collect()]
    shared = documents.sparkSession.sparkContext.broadcast(build_index(rows))
    doc_type, item_type = documents.schema[doc_id].dataType.simpleString(), tests.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, known = shared.value, {}
        for b in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(b["k"], b["t"]):
                keys.append(k)
                texts.append(t)
                size += len(t)
                if size > 2_000_000:
                    yield rows_of(index, keys, texts, known)
                    keys, texts, size = [], [], 0
            if texts:
                yield rows_of(index, keys, texts, known)

    def rows_of(index: TestIndex, keys: list, texts: list[str], known: dict) -> pd.DataFrame:
        got = search(index, texts, least_words, known, least_coverage)
        return pd.DataFrame([(keys[t], index.ids[j], n, c) for t, j, n, c in got], columns=["k", "i", "words", "coverage"])

    source = documents.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).where(F.length("t") >= 2 * least_words)
    return source.mapInPandas(run, f"k {doc_type}, i {item_type}, words int, coverage double").toDF(doc_id, item_id, "words", "coverage")
