"""The training-text operators against brute force, round trips and the awkward cases each must define."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import copies, leaks, matching, names, packing, scans, splitting
from foliant.llm.tokens import tokenizer

ANCHORS = "anchor_id long, identifier string, article_title string, article_author string, issn string, volume string, issue string, yr string, journal_pages string, leaf_ranges array<array<string>>"


def anchors(spark, rows):
    """Rows given as dicts; what is missing is null. Extra columns have clashing names."""
    fields = [x.split()[0] for x in ANCHORS.split(", ")]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], ANCHORS).selectExpr("*", "1 AS key", "2 AS id", "3 AS unit", "4 AS g")


# ---------------------------------------------------------------- copies


def test_copies(spark):
    base = {"identifier": "sim_a-b_1", "article_title": "On Moss, and Rye", "leaf_ranges": [["n9", "n12"], ["n20", "n21"]]}
    rows = [
        base | {"anchor_id": 5},
        base | {"anchor_id": 3, "article_title": "“ON moss\nand  rye”!"},
        base | {"anchor_id": 4, "leaf_ranges": [[" N20", "n-21 "], ["n 09", "n12"]]},
        base | {"anchor_id": 6, "identifier": "SIM a b 1/"},
        base | {"anchor_id": 7, "leaf_ranges": [["n9", "n13"], ["n20", "n21"]]},
        base | {"anchor_id": 8, "article_title": None},
        base | {"anchor_id": 9, "article_title": "On Móss and Rye"},
        base | {"anchor_id": 10, "leaf_ranges": None},
        base | {"anchor_id": 11, "leaf_ranges": None},
        base | {"anchor_id": 12, "identifier": None},
        base | {"anchor_id": 13, "article_title": "x" * 300_000},
        base | {"anchor_id": 14, "article_title": "X" * 300_000},
        base | {"anchor_id": 5},
        base | {"anchor_id": None},
    ]
    df = anchors(spark, rows)
    got = {tuple(r) for r in copies.copied_anchors(df).collect()}
    assert got == {(3, 4), (3, 5), (3, 6), (10, 11), (13, 14)}
    counts = {r.anchor_id: r.copies for r in copies.collapse_anchors(df).collect()}
    assert counts[3] == 5 and counts[7] == 1
    assert copies.copied_anchors(df.where("anchor_id > 99")).count() == 0


def test_copies_hot_and_split(spark):
    """One key of a third of all rows, small buckets and salts: the same groups as a plain count."""
    rnd = random.Random(3)
    keys = ["same" * 9] * 1000 + [f"same{rnd.randint(0, 500)}" for _ in range(1500)] + [chr(97 + k % 26) * (k % 40) for k in range(500)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(keys)], "id long, key string")
    counts = {}
    for i, k in enumerate(keys):
        counts.setdefault(k, []).append(i)
    got = {(r.key, r.first_id, r.copies) for r in copies.count_keys(df, bucket_keys=20, first_prefix=1).collect()}
    assert got == {(k, min(v), len(v)) for k, v in counts.items()}
    _, pairs = copies.copy_groups(df, hot_rows=100)
    assert {tuple(r) for r in pairs.collect()} == {(min(v), i) for v in counts.values() for i in v if i != min(v)}


# ---------------------------------------------------------------- names


@pytest.mark.parametrize(
    "text,parsed",
    [
        ("Smith, John A.", ("person", "smith", ["john", "a"])),
        ("SMITH, J.A.", ("person", "smith", ["j", "a"])),
        ("J. A. Smíth", ("person", "smith", ["j", "a"])),
        ("Smith JA", ("person", "smith", ["j", "a"])),
        ("Smith SR", ("person", "smith", ["s", "r"])),
        ("Prof. John Smith", ("person", "smith", ["john"])),
        ("john henry smith", ("person", "smith", ["john", "henry"])),
        ("Dept. Moss Growth, Oslo", ("org", "", ["department", "moss", "growth", "oslo"])),
        ("--", None),
    ],
)
def test_parse_name(text, parsed):
    assert names.parse_name(text) == parsed


def toc(spark, rows):
    """Contents entries from (entry_id, issn[, title])."""
    return spark.createDataFrame([(*r, None)[:3] + (None, None) for r in rows], "entry_id long, issn string, title string, volume string, start_page_number int")


def test_several_persons_behind_an_initial(spark):
    """Planted persons of one surname whose initials agree: a spelling goes to the one its article names, else to the most
    usual; with ten and a hundred times the rows the answer is the same."""
    said = [
        ("On Moss", "Heirard, Bridget"), ("On Moss", "Heirard, B"), ("On Moss", "B Heirard"), ("On Peat", "Heirard, Bertha"), ("On Peat", "Heirard, B."), ("On Clay", "Heirard, Bertha"), ("On Marl", "Heirard, Bertha T"),
        ("On Sand", "Heirard, B"), ("On Fens", "Heirard, Ted"), ("On Fens", "Heirard, Theodore"), ("On Dunes", "Heirard, Edward"),
    ]
    df = anchors(spark, [{"anchor_id": k, "issn": "1", "article_title": t, "article_author": a} for k, (t, a) in enumerate(said)])
    entries = toc(spark, [(1, "1", "on moss."), (2, "1", "On Peat"), (3, "1", "On Fens"), (4, "1", "On Loess")])
    authors = spark.createDataFrame([(11, 1, "Heirard, B."), (12, 2, "Heirard, Bertha"), (13, 3, "T. Heirard"), (14, 4, "E. Heirard")], "author_id long, entry_id long, name string")
    want = {(0, 11), (1, 11), (2, 11), (3, 12), (4, 12), (5, 12), (6, 12), (7, 12), (8, 13), (9, 13), (10, 14)}
    assert {tuple(r) for r in names.same_names(df, entries, authors).collect()} == want
    often = df.crossJoin(spark.range(30)).drop("id")
    assert {tuple(r) for r in names.same_names(often, entries, authors).collect()} == want


def test_same_names(spark):
    a = [
        (1, "Heirard, Timothy; Brown, K"),
        (2, "Heiirard, T M"),
        (3, "Tim Heirard et al."),
        (4, "Heirard, Susan"),
        (5, "The Oslo Institute of Moss Growth"),
        (6, None),
        (7, "[unknown]"),
        (8, "timothy heirard"),
        (9, "A" * 50_000),
    ]
    df = anchors(spark, [{"anchor_id": i, "issn": "1", "article_author": x} for i, x in a] + [{"anchor_id": 20, "issn": "2", "article_author": "Heirard, T"}, {"anchor_id": 21, "article_author": "Heirard, T"}, {"anchor_id": 1, "issn": "1", "article_author": "Heirard, Timothy; Brown, K"}])
    entries = toc(spark, [(1, "1"), (2, None)])
    authors = spark.createDataFrame([(11, 1, "Heirard, T."), (12, 1, "INST. MOSS GROWTH, OSLO"), (13, 1, None), (14, 2, "Heirard, T."), (15, 1, "Brown, Karl"), (16, 9, "Brown, Karl")], "author_id long, entry_id long, name string")
    got = {tuple(r) for r in names.same_names(df, entries, authors).collect()}
    assert got == {(1, 11), (2, 11), (3, 11), (8, 11), (5, 12), (1, 15)}
    assert names.same_names(df.where("anchor_id > 99"), entries, authors).count() == 0


def test_attribution_held_out(spark):
    """Spellings made wrong on purpose: nearly all go to the name they came from, and names stay themselves."""
    rnd = random.Random(5)
    part = ["bar", "den", "fol", "gul", "hem", "kar", "lun", "mos", "nor", "pel", "ros", "stu", "tov", "wik"]
    real = sorted({"".join(rnd.sample(part, 3)) for _ in range(150)})
    wrong = {}
    for w in real[:80]:
        k = rnd.randrange(1, len(w))
        v = rnd.choice([w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + "x" + w[k + 1 :]])
        if v not in real:
            wrong[v] = w
    rows = [("s", w, 12) for w in real] + [("s", v, 1) for v in wrong]
    got = {r.word: r.canon for r in names.attribute(spark.createDataFrame(rows, "scope string, word string, n long")).collect()}
    assert sum(got.get(v) == w for v, w in wrong.items()) >= 0.95 * len(wrong)
    assert sum(w in got for w in real) <= 0.02 * len(real)


def test_attribution_of_larger_tables(spark):
    """Errors of a frequent name stay errors when there are ten times as many of both, names of their own stay names; and a
    table repeated ten times, whose rare names have few typings, gives the same classes."""
    rows = [("felix", 92), ("felxi", 1), ("gareth", 88), ("greth", 2), ("carl", 64), ("karl", 84), ("tim", 14), ("tom", 15)]
    for times in (1, 10, 100):
        df = spark.createDataFrame([("G", w, n * times) for w, n in rows], "scope string, word string, n long")
        assert {r.word: r.canon for r in names.attribute(df).collect()} == {"felxi": "felix", "greth": "gareth"}
    spelled = ["Sturhaeland, Felix", "Sturshaeland, Felix", "Sturshaeland, F", "Sturshaeland, Felix M", "Oland, Carl", "Oland, Karl", "Berg, Felix", "Dal, Felxi", "Dal, Felix"]
    df = anchors(spark, [{"anchor_id": k, "issn": "1", "article_author": x} for k, x in enumerate(spelled)])
    entries = toc(spark, [(1, "1")])
    authors = spark.createDataFrame([(11, 1, "Sturshaeland, F."), (12, 1, "Dal, Felix")], "author_id long, entry_id long, name string")
    often = df.crossJoin(spark.range(10)).drop("id")
    once = {tuple(r) for r in names.name_variants(df, entries, authors).drop("n").collect()}
    assert {tuple(r) for r in names.name_variants(often, entries, authors.crossJoin(spark.range(10)).drop("id")).drop("n").collect()} == once
    assert {tuple(r) for r in names.same_names(often, entries, authors).collect()} == {(0, 11), (1, 11), (2, 11), (3, 11), (7, 12), (8, 12)}


# ---------------------------------------------------------------- scans

BLOCK = "block_id long, item string, idx int, page_no int, label string, content_layer string, text string, bbox struct<l:double,t:double,r:double,b:double>"


def issue(spark):
    rows, k = [], 0
    words = "the northern oyster of the valley was measured against the southern treaty of early moss growth".split()
    rnd = random.Random(2)

    def prose(n):
        return "\n".join(" ".join(rnd.choice(words) for _ in range(8)) for _ in range(n)) + " end."

    for page in range(1, 9):
        for label, text, top in (
            ("page_header", "ANNALS OF MOSS", 760.0),
            ("text", prose(4), 700.0),
            ("text", prose(3), 400.0),
            ("page_footer", f"- {page + 100} -", 40.0),
        ):
            rows.append([k, "i", k, page, label, "body", text, (50.0, top, 500.0, top - 20)])
            k += 1
    rows[5][6] = "the northern oyster of the valley was mea-\nsured against the southern treaty\nANNALS OF MOSS\nof early moss growth in the valley. Then the moss of the val-"
    rows[6][6] = "ley was measured against the oyster and\nthe treafy of the early moss growth of the valley."
    rows.append([k, "i", k, 9, None, None, None, None])
    rows.append([k + 1, None, None, None, None, None, "x", None])
    rows.append([k + 2, "j", None, None, None, None, "  ", None])
    return spark.createDataFrame([tuple(r) for r in rows], BLOCK).selectExpr("*", "1 AS win", "2 AS state"), rows


def test_scans(spark):
    df, rows = issue(spark)
    got = {tuple(r) for r in scans.find_faults(df).collect()}
    furniture = {r[0] for r in rows if r[4] in ("page_header", "page_footer")}
    assert {b for b, f in got if f == "furniture"} == furniture
    assert {(5, "embedded"), (5, "split_word"), (5, "continued"), (6, "misread")} <= got
    assert not {f for b, f in got if b in furniture} - {"furniture"}
    text = [r.text for r in scans.paragraphs(df).where("item = 'i'").collect()]
    joined = next(t for t in text if "measured against the southern" in t)
    assert "ANNALS" not in joined and "of the valley was measured against the oyster and the treaty of" in joined
    assert scans.find_faults(df.where("block_id > 999")).count() == 0


def test_scan_windows(spark, monkeypatch):
    """An item longer than a window gives what it gives in one piece."""
    df, _ = issue(spark)
    whole = {tuple(r) for r in scans.find_faults(df).collect()}
    model = scans.start_model()
    monkeypatch.setattr(scans, "WINDOW", 10)
    monkeypatch.setattr(scans, "HALO", 5)
    rows = scans.label_lines(df, model).collect()
    assert len(rows) == len({r.block_id for r in rows}) == df.where("item IS NOT NULL").count()
    assert {(r.block_id, "continued") for r in rows if r.continued} == {x for x in whole if x[1] == "continued"}


def test_paragraphs_across_windows(spark, monkeypatch):
    """A paragraph that runs over the edges of windows is one, also where a page header stands at the edge."""
    monkeypatch.setattr(scans, "WINDOW", 4)
    monkeypatch.setattr(scans, "HALO", 3)
    df, _ = issue(spark)
    long = [(100 + k, "long", k, k // 2, "text", "body", f"the early moss of the valley grew {'and' if k < 19 else 'or'} the oyster\nof the southern treaty was measured in the valley" + (" of" if k % 10 != 9 else "."), (50.0, 600.0, 500.0, 300.0)) for k in range(20)]
    both = df.select(*df.columns[:8]).unionByName(spark.createDataFrame(long, BLOCK))
    got = [(r.first_block, r.blocks) for r in scans.paragraphs(both).where("item = 'long'").collect()]
    assert sorted(got) == [(100, 10), (110, 10)]
    unplaced = both.where("item = 'long'").withColumn("idx", F.lit(None).cast("int"))
    assert sorted((r.first_block, r.blocks) for r in scans.paragraphs(unplaced).collect()) == [(100, 10), (110, 10)]


def test_zones_of_other_pages():
    page = lambda tops: [scans._zone(t, scans.page_scale(tops)) for t in tops]
    points = [760.0, 720.0, 400.0, 40.0] * 5
    want = ["top", "heading", "middle", "bottom"] * 5
    assert page(points) == want and page([t * 4 for t in points]) == want
    assert page([t - 792.0 for t in points]) == want  # counted from the top of the page


# ---------------------------------------------------------------- matching


def test_matching(spark):
    t = ["Growth of alpine moss near Oslo", "Tariffs of northern harbor towns", "Growth of alpine moss near Oslo. Part II", "Editorial"]
    base = {"identifier": "sim_j_1999_4_2", "issn": "1", "volume": "4", "issue": "no. 2", "yr": "1999"}
    a = [
        base | {"anchor_id": 1, "article_title": t[0].upper(), "journal_pages": "10-15", "leaf_ranges": [["n12", "n17"]], "article_author": "Lee, Anna"},
        base | {"anchor_id": 2, "article_title": "[Growth of alpin moss near Oslo]", "journal_pages": None, "leaf_ranges": [["n12", "n17"]]},
        base | {"anchor_id": 3, "article_title": t[1], "journal_pages": "pp. 20-3", "leaf_ranges": [["n22", "n25"]]},
        base | {"anchor_id": 4, "article_title": t[2], "journal_pages": "30-33", "leaf_ranges": [["n32", "n35"]]},
        base | {"anchor_id": 5, "article_title": None, "journal_pages": "20-23", "leaf_ranges": [["n22", "n25"]], "article_author": "Ray Fox"},
        base | {"anchor_id": 6, "article_title": "Quite another thing altogether", "journal_pages": "50", "leaf_ranges": None},
        {"anchor_id": 7, "article_title": t[0], "identifier": "other", "issn": "2", "volume": "4", "issue": "2", "yr": "1999"},
        {"anchor_id": 8},
        base | {"anchor_id": 1, "article_title": t[0].upper(), "journal_pages": "10-15", "leaf_ranges": [["n12", "n17"]], "article_author": "Lee, Anna"},
    ]
    e = [(11, "m1", "1", "IV", "2", 1999, t[0], 10, 15, 9), (12, "m1", "1", "4", "2", 1999, "1. " + t[0], 0, 0, 9), (13, "m1", "1", "Vol. 4", None, 1999, t[1], 20, 23, 19), (14, "m1", "1", "4", "2", None, t[2], 30, 33, 29), (15, None, None, None, None, None, None, None, None, None)]
    entries = spark.createDataFrame(e, "entry_id long, item string, issn string, volume string, issue string, yr int, title string, start_page_number int, end_page_number int, start_page_index int").selectExpr("*", "1 AS unit", "2 AS p")
    authors = spark.createDataFrame([(11, "Anna Lee"), (13, "R. Fox"), (14, None)], "entry_id long, name string")
    rows = matching.match_articles(anchors(spark, a), entries, authors).collect()
    assert {(r.anchor_id, r.entry_id) for r in rows} == {(1, 11), (1, 12), (2, 11), (2, 12), (3, 13), (4, 14), (5, 13)}
    assert len([r for r in rows if r.anchor_id == 1]) == 4 and all(0.5 <= r.confidence <= 1 for r in rows)
    assert matching.match_articles(anchors(spark, a).where("anchor_id > 99"), entries, authors).count() == 0


def test_matching_by_rare_keys(spark):
    """Without a page: misread words in titles of two words, titles cut to one, prefixes broken twice, and the author alone."""
    base = {"identifier": "sim_j_1999_4_2", "issn": "1", "volume": "4", "issue": "2", "yr": "1999"}
    pairs = [
        ("On Infant Chorus", "On infant cborus", None),
        ("On historical teacrer", "ON HISTORICAL TEACHER", None),
        ("On bistorical brewing", "On historical brewing", None),
        ("On the Teaching of...", "On the teaching of northern dialects", None),
        ("Alpine mqsses under frqzen lakes beside qlaciers", "Alpine mosses under frozen lakes beside glaciers", None),
        ("Tqriffs, hqrbors", "Tariffs, harbors", "Fox, Raymond"),
    ]
    a = [base | {"anchor_id": k, "article_title": x, "article_author": by} for k, (x, _, by) in enumerate(pairs)]
    e = [(k, "m1", "1", "4", "2", 1999, y, 10 * k + 5, 10 * k + 9, None) for k, (_, y, _) in enumerate(pairs)]
    entries = spark.createDataFrame(e, "entry_id long, item string, issn string, volume string, issue string, yr int, title string, start_page_number int, end_page_number int, start_page_index int")
    authors = spark.createDataFrame([(k, by) for k, (_, _, by) in enumerate(pairs) if by], "entry_id long, name string")
    rows = matching.match_articles(anchors(spark, a), entries, authors).collect()
    assert {(r.anchor_id, r.entry_id) for r in rows} == {(k, k) for k in range(len(pairs))}


def test_propagation_against_enumeration(spark):
    """On a tree, messages give the exact marginals over all matchings."""
    edges = [(1, 11, 0.5), (1, 12, 1.5), (2, 12, 1.0), (3, 12, -0.5), (3, 13, 0.2)]
    total, mass = 0.0, dict.fromkeys([(a, e) for a, e, _ in edges], 0.0)
    for m in range(1 << len(edges)):
        chosen = [edges[k] for k in range(len(edges)) if m >> k & 1]
        if len({a for a, _, _ in chosen}) < len(chosen) or len({e for _, e, _ in chosen}) < len(chosen):
            continue
        w = float(np.exp(sum(x for _, _, x in chosen)))
        total += w
        for a, e, _ in chosen:
            mass[a, e] += w
    df = spark.createDataFrame([(a, e, a, e, x) for a, e, x in edges], "unit long, entry_id long, slot_a int, slot_e int, odds double")
    for r in matching.propagate(df, 1e-6, 30).collect():
        assert r.p == pytest.approx(mass[r.unit, r.entry_id] / total, abs=1e-4)


# ---------------------------------------------------------------- packing, splitting


def test_best_fill_against_all_subsets():
    rnd = random.Random(4)
    for _ in range(200):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        hist = {s: sizes.count(s) for s in sizes}
        order = sorted(hist, reverse=True)
        used, slack = packing.best_fill(order, hist, 40)
        rest = sorted(sizes, reverse=True)[1:]
        best = min(40 - order[0] - s for m in range(1 << len(rest)) if (s := sum(x for k, x in enumerate(rest) if m >> k & 1)) <= 40 - order[0])
        assert slack == best and sum(s * n for s, n in used.items()) == 40 - slack and all(n <= hist[s] for s, n in used.items())


@pytest.mark.parametrize("tokens", ["bytes", "bpe"])
def test_pack(spark, tokens):
    if tokens == "bpe":
        P = pytest.importorskip("public_tokenizers")
        tokens = P.path("byte_bpe_50k.json")
    rnd = random.Random(6)
    texts = [(k, " ".join("moss" for _ in range(rnd.randint(1, 50)))) for k in range(300)] + [(k, "equal size!") for k in range(300, 500)] + [(500, None), (501, ""), (502, "é. " * 400), (502, "twice"), (503, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS k")
    items = packing.pack(df, "doc_id", "text", 256, tokens, per_salt=40)
    rows = items.collect()
    used = {}
    for r in rows:
        if r.container_id is not None:
            used[r.container_id] = used.get(r.container_id, 0) + r.size
    assert max(used.values()) <= 256 and {r.doc_id for r in rows} == set(range(504))
    assert {r.doc_id for r in rows if r.container_id is None} == {500, 501}
    assert {r.doc_id for r in rows if r.piece > 0} <= {502}
    assert len(used) <= 1.05 * sum(used.values()) / 256 + 2
    assert sum(r.items for r in packing.containers(items, "doc_id", 256).collect()) == len(rows) - 2
    assert packing.pack(df.where("doc_id > 999"), "doc_id", "text", 256).count() == 0


def test_pack_of_one_size(spark):
    """All items alike, in many salts: every container but the last is full."""
    df = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 64) AS text")
    items = packing.pack(df, "doc_id", "text", 256, per_salt=30)
    used = sorted(r.used for r in packing.containers(items, "doc_id", 256).collect())
    assert used == [256] * 250 and items.select("doc_id").distinct().count() == 1000


def test_range_max():
    rnd = random.Random(7)
    v = np.array([rnd.randint(-1, 5) for _ in range(200)])
    table = splitting.RangeMax(v)
    for _ in range(500):
        lo = rnd.randrange(200)
        hi = rnd.randrange(lo, 200)
        assert table.argmax(lo, hi) == max(range(lo, hi + 1), key=lambda k: (v[k], k))


@pytest.mark.parametrize("text", ["One sentence. Another one, longer; and so on.\n\nA paragraph.\n" * 40, "x" * 3000, "é" * 1500, "日本語" * 700, "ab " * 1000, "a" * 257])
def test_split_round_trip(text):
    raw = text.encode()
    starts = tokenizer("bytes").starts(text)
    cuts = splitting.cut_points(raw, starts, 256, 16)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(raw)
    rebuilt, end = b"", 0
    for a, b in cuts:
        assert 0 < b - a <= 256 and a <= end and (end == 0 or 8 - 3 <= end - a <= 16)
        raw[a:b].decode()  # no character is cut
        rebuilt += raw[end:b]
        end = b
    assert rebuilt == raw


def test_split_of_long_and_unbroken_texts():
    """Stretches don't show; a boundary early in the piece is taken if the rest has none."""
    raw = ("One two three. Four five, six seven eight nine ten.\n" * 60_000).encode()
    cuts = splitting.cut_points(raw, tokenizer("bytes").starts(raw.decode()), 256, 16)
    assert all(raw[b - 1 : b] == b"\n" or raw[b - 1 : b] == b" " for _, b in cuts[:-1]) and cuts[-1][1] == len(raw)
    assert all(c[0] <= p[1] and 1 <= p[1] - c[0] <= 16 for p, c in zip(cuts, cuts[1:]))
    url = b"See here: " + b"x" * 400
    assert splitting.cut_points(url, range(len(url)), 256, 0)[0] == (0, 10)


def test_split_oversized(spark):
    long = "A sentence here. " * 600
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "short"), (5, "é" * 2048), (6, "é" * 2049), (1, long), (None, long)], "doc_id long, text string").selectExpr("*", "1 AS pos", "2 AS t")
    rows = splitting.split_oversized(df, "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {1, 6, None} and max(r.tokens for r in rows) <= 4096
    assert all(r.piece.endswith(". ") for r in rows if r.doc_id == 1)
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "doc_id", "text", 100, 60)


# ---------------------------------------------------------------- leaks


def brute_tiles(a, b, least):
    a, b, out = list(a), list(b), []
    ua, ub = [False] * len(a), [False] * len(b)
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sorted(out)
        out.append((i, j, n))
        for k in range(n):
            ua[i + k] = ub[j + k] = True


def test_tiles_against_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        a = np.array([rnd.randint(1, 4) for _ in range(rnd.randint(0, 25))], dtype=np.int64)
        b = np.array([rnd.randint(1, 4) for _ in range(rnd.randint(0, 25))], dtype=np.int64)
        assert sum(n for *_, n in leaks.tiles(a, b)) == sum(n for *_, n in brute_tiles(a, b, 3))


def test_leaks(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("bdgkmprsvz") + rnd.choice("aou") for _ in range(3))
    say = lambda n: [word() for _ in range(n)]
    head = "read the passage below and answer each question in one complete sentence".split()
    items = [head + say(60) for _ in range(12)]
    around = lambda w: " ".join(say(40) + w + say(40))
    faults = [w.replace("m", "rn", 1) for w in items[3][20:60]]
    wrapped = " ".join(items[4][20:60])
    wrapped = wrapped[:50] + "-\n" + wrapped[50:] if wrapped[49] != " " and wrapped[50] != " " else wrapped
    docs = [
        (1, around(items[0][20:45])),
        (2, around([w.upper() + "," for w in items[1][20:50]])),
        (3, around(items[2][20:35])),  # too short
        (4, around(faults)),
        (5, around([wrapped])),
        (6, around(items[5][:13] + items[5][13:25])),  # the shared line doesn't count
        (7, around(items[6][20:35] + say(30) + items[6][35:55])),
        (8, around(items[7][20:30] + say(1) + items[7][31:42] + say(1) + items[7][43:50])),
        (9, None),
        (10, ""),
        (11, " ".join(say(30_000) + items[8][15:60] + say(30_000))),
        (12, around(items[9][20:50]) + " " + around(items[10][20:50])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS k")
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, t).collect()}
    assert got == {(1, 0), (2, 1), (4, 3), (5, 4), (7, 6), (8, 7), (11, 8), (12, 9), (12, 10)}
    assert leaks.find_leaks(d, t.where("item_id > 999")).count() == 0
    assert leaks.find_leaks(d.where("doc_id > 999"), t).count() == 0


def test_leaks_in_parts_and_in_another_order(spark):
    rnd = random.Random(19)
    word = lambda: "".join(rnd.choice("bdgkmprsvz") + rnd.choice("aou") for _ in range(3))
    say = lambda n: [word() for _ in range(n)]
    items = [say(60), say(60), say(900), say(60)]
    around = lambda w: " ".join(say(40) + w + say(40))
    every = [w if k % 6 else word() for k, w in enumerate(items[2])]  # 150 tiles in one chain
    docs = [
        (1, around(items[0][20:26] + say(60) + items[0][26:44])),  # broken after the sixth word
        (2, around([word() if k in (5, 10, 15) else w for k, w in enumerate(items[1][20:41])])),  # one run of five words
        (3, around(every)),
        (4, around(items[3][40:52] + items[3][20:32] + items[3][0:12])),  # no twenty words in order, but half of it
    ]
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), t).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert got[3, 2].words > 800 and got[1, 0].words == 24
    assert got[4, 3].words < 20 and got[4, 3].coverage == 0.6


def test_leaks_of_wording_whose_every_seed_is_shared(spark):
    rnd = random.Random(29)
    word = lambda: "".join(rnd.choice("bdgkmprsvz") + rnd.choice("aou") for _ in range(3))
    say = lambda n: [word() for _ in range(n)]
    passage = say(24)
    parts = [passage[k : k + 9] for k in (0, 5, 10, 15)]  # in runs under STOCK_RUN, so no stock wording
    sharing = [[w for p in parts for w in say(25) + p] + say(25) for _ in range(2)]
    items = [say(20) + passage + say(20), *sharing, *(say(60) for _ in range(17))]
    around = lambda w: " ".join(say(40) + w + say(40))
    docs = spark.createDataFrame([(1, around(passage)), (2, around(passage[:12])), (3, around(parts[1]))], "doc_id long, text string")
    t = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert [tuple(r)[:3] for r in leaks.find_leaks(docs, t).collect()] == [(1, 0, 24)]


def test_set_phrases_with_other_words_between_are_no_leak():
    rnd = random.Random(37)
    word = lambda: "".join(rnd.choice("bdgkmprsvz") + rnd.choice("aou") for _ in range(3))
    say = lambda n: [word() for _ in range(n)]
    phrases = [say(8) for _ in range(4)]
    filled = lambda: [w for p in phrases for w in p + say(1)]
    items = [say(20) + filled() + say(20) for _ in range(3)] + [say(70) for _ in range(17)]  # in less than COMMON_ITEMS
    index = leaks.build_index([(k, " ".join(w)) for k, w in enumerate(items)])
    texts = [" ".join(say(30) + w + say(30)) for w in (filled(), items[0][20:56])]
    assert [r[:2] for r in leaks.search(index, texts, 20, {}) if r[2] >= 20] == [(1, 0)]


def test_a_set_phrase_elsewhere_takes_no_words_of_a_passage():
    rnd = random.Random(41)
    word = lambda: "".join(rnd.choice("bdgkmprsvz") + rnd.choice("aou") for _ in range(3))
    say = lambda n: [word() for _ in range(n)]
    phrase = say(8)
    items = [say(20) + phrase + say(34) for _ in range(3)] + [say(62) for _ in range(17)]
    index = leaks.build_index([(k, " ".join(w)) for k, w in enumerate(items)])
    text = " ".join(say(30) + phrase + say(107) + items[0][21:42] + say(30))
    assert [r[:3] for r in leaks.search(index, [text], 20, {})] == [(0, 0, 21)]


def test_leaks_in_parts_and_without_bounds(monkeypatch):
    rnd = random.Random(31)
    phrases = [[f"w{rnd.randrange(30)}x" for _ in range(rnd.randint(3, 12))] for _ in range(12)]
    say = lambda n: [w for _ in range(n) for w in (rnd.choice(phrases) if rnd.random() < 0.6 else [f"q{rnd.randrange(400)}z"])]
    items = [say(14) for _ in range(20)]
    texts = [" ".join(say(8) + rnd.choice(items)[5:45] + say(8)) for _ in range(60)]
    index = leaks.build_index([(k, " ".join(w)) for k, w in enumerate(items)])
    whole = leaks.search(index, texts, 20, {}, 0.5)
    assert len(whole) >= 30
    with monkeypatch.context() as m:
        m.setattr(leaks, "HITS", 50)
        m.setattr(leaks, "BOUND_WORDS", 300)
        assert leaks.search(index, texts, 20, {}, 0.5) == whole
    with monkeypatch.context() as m:
        m.setattr(leaks, "_possible", lambda index, run_at, start, text, *_: (text >= 0, text >= 0))
        assert leaks.search(index, texts, 20, {}, 0.5) == whole


def test_only_windows_that_can_hold_a_passage_are_tiled(monkeypatch):
    rnd = random.Random(41)
    word = lambda: "".join(rnd.choice("bdgkmprsvz") + rnd.choice("aou") for _ in range(3))
    say = lambda n: [word() for _ in range(n)]
    items = [say(60) for _ in range(3)]
    apart = items[0][:9] + say(2) + items[0][:9] + say(300) + items[0][9:18]  # 18 words of the item in two places far apart
    texts = [" ".join(say(30) + w + say(30)) for w in [apart] * 8 + [items[1][10:40], items[2][:9] + say(3) + items[2][9:30]]]
    index = leaks.build_index([(k, " ".join(w)) for k, w in enumerate(items)])
    tilings, heapify = [], leaks.heapq.heapify
    monkeypatch.setattr(leaks.heapq, "heapify", lambda heap: (tilings.append(len(heap)), heapify(heap)))
    got = leaks.search(index, texts, 20, {})
    assert [r[:3] for r in got] == [(8, 1, 30), (9, 2, 30)]
    assert len(tilings) <= 4
    monkeypatch.setattr(leaks, "_reaches", lambda *_: True)
    monkeypatch.setattr(leaks, "_gathered", lambda *_: True)
    monkeypatch.setattr(leaks, "_possible", lambda index, run_at, start, text, *_: (text >= 0, text >= 0))
    assert leaks.search(index, texts, 20, {}) == got and len(tilings) > 10


def test_no_core_module_imports_the_subpackage():
    from pathlib import Path

    import foliant

    root = Path(foliant.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"foliant\.llm|from \.+llm", p.read_text()), p
    assert F
