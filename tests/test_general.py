"""The general training-data operators: values, nested records, intervals."""

import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from foliant.operators.intervals import sweep_intervals
from foliant.operators.multivalue import split_authors, split_pages, split_values
from foliant.operators.nested import _unpack, extract, flatten_nested, layout_cells, layout_provs, layout_texts


@pytest.mark.parametrize(
    "text,values",
    [
        (None, []),
        ("", []),
        ("n/a", []),
        ("[unknown]", []),
        ("Smith, J", ["Smith, J"]),
        ("Smith, J A, Jones, B", ["Smith, J A", "Jones, B"]),
        ("Olive R. Plant, Matthew Quim & Hannah Hel", ["Olive R. Plant", "Matthew Quim", "Hannah Hel"]),
        ("Shaw, Flora and Veld, Philip", ["Shaw, Flora", "Veld, Philip"]),
        ('"Stur, B A" "Bral, O"', ["Stur, B A", "Bral, O"]),
        ("'Skun, Dorothy', 'Grer, Albert'", ["Skun, Dorothy", "Grer, Albert"]),
        ('"Klou, P"', ["Klou, P"]),
        ("Brock, O N; Prof. George Crul; and Hil, Felix; et al.", ["Brock, O N", "Prof. George Crul", "Hil, Felix"]),
        ("Institute for Enzyme and Variation, Roul; Brown B.", ["Institute for Enzyme and Variation, Roul", "Brown B."]),
        ("Dr Ann Lee\tBo O'Neil\nCy Dee", ["Dr Ann Lee", "Bo O'Neil", "Cy Dee"]),
        ("M. Lo AND F. Po with G. Ro", ["M. Lo", "F. Po", "G. Ro"]),
        ("A Fox;; ; B Cat;", ["A Fox", "B Cat"]),
    ],
)
def test_split_authors(text, values):
    assert split_authors(text) == values


@pytest.mark.parametrize(
    "text,values",
    [
        (None, []),
        ("  ", []),
        ("pp. 12-15", ["12-15"]),
        ("(287-294 & 302-5)", ["287-294", "302-5"]),
        ("1,412-1,413 ; 1,436", ["1,412-1,413", "1,436"]),
        ("734,736-743", ["734", "736-743"]),
        ("pages xi-xii, 3 and S4-S6", ["xi-xii", "3", "S4-S6"]),
        ('"1-2\n9"', ["1-2", "9"]),
        ("8, 9-10,", ["8", "9-10"]),
    ],
)
def test_split_pages(text, values):
    assert split_pages(text) == values


def test_split_values(spark):
    long = "; ".join(f"A{i} Bee" for i in range(5000))
    df = spark.createDataFrame([(1, "A B; C D", 9), (1, "A B; C D", 9), (2, None, 9), (None, "E F; G H", 9), (3, long, 9), (4, "X Y", 9)], "k long, f string, pos int")
    out = split_values(df, "k", "f").collect()
    assert sum(r.k == 1 for r in out) == 4 and sum(r.k is None for r in out) == 2 and sum(r.k == 3 for r in out) == 5000
    assert {(r.pos, r.val) for r in out if r.k == 1} == {(1, "A B"), (2, "C D")}
    assert split_values(df.where("k > 100"), "k", "f").count() == 0


def brute_nodes(payload):
    try:
        j = json.loads(payload)
    except ValueError:
        return set()

    def own(x):
        if isinstance(x, str):
            try:
                return own(json.loads(x))
            except ValueError:
                return x
        return x

    j, out = own(j), set()
    while isinstance(j, dict) and "texts" not in j and "tables" not in j and any(isinstance(v, dict) for v in j.values()):
        j = next(v for v in j.values() if isinstance(v, dict))
    listed = lambda x: [] if own(x) is None else own(x) if isinstance(own(x), list) else [own(x)]
    for root in ("texts", "tables"):
        for i, t in enumerate(listed(j.get(root)) if isinstance(j, dict) else []):
            t = own(t)
            if not isinstance(t, dict):
                continue
            out.add((root, -1, i))
            out |= {(root + ".prov", i, k) for k, q in enumerate(listed(t.get("prov"))) if isinstance(q, dict)}
            if root == "tables" and isinstance(own(t.get("data")), dict):
                out |= {("tables.table_cells", i, k) for k, q in enumerate(listed(own(t["data"]).get("table_cells"))) if isinstance(q, dict)}
    return out


prov = st.one_of(st.none(), st.just([]), st.dictionaries(st.just("page_no"), st.integers(0, 9), min_size=1), st.lists(st.one_of(st.none(), st.just({"page_no": 1, "x": [1, [2]]})), max_size=3))
texts = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({"text": st.text(max_size=8), "prov": prov})), max_size=3), st.fixed_dictionaries({"prov": prov}))
cells = st.lists(st.one_of(st.none(), st.just({"text": 'a"b\\'})), max_size=3)
tables = st.lists(st.fixed_dictionaries({"prov": prov, "data": st.one_of(st.none(), st.fixed_dictionaries({"table_cells": cells}), st.builds(lambda c: json.dumps({"table_cells": c}), cells))}), max_size=2)


@settings(max_examples=150, deadline=None)
@given(texts, tables, st.booleans(), st.sampled_from([None, 1]))
def test_nested_against_json(t, b, wrapped, indent):
    j = {"texts": t, "tables": b}
    payload = json.dumps({"document": j} if wrapped else j, indent=indent)
    raw = _unpack(payload.encode())
    assert {g[1:4] for g in extract([raw])} == brute_nodes(payload)


def test_flatten_nested(spark):
    doc = {"texts": [{"label": "text", "text": "é \"q\"", "prov": {"page_no": 2, "bbox": {"l": 1.0}}}, None], "tables": {"data": json.dumps({"table_cells": [None, {"text": "c", "row_offset_idx": 1, "col_offset_idx": 0}]})}}
    rows = [(1, json.dumps(doc), "x"), (2, None, "x"), (3, "", "x"), (4, json.dumps(doc)[:-4], "x"), (5, "[]", "x"), (6, json.dumps(json.dumps(doc)), "x")]
    df = spark.createDataFrame(rows, "id long, p string, node string")
    nodes = flatten_nested(df, "id", "p")
    assert {(r.node, r.parent_pos, r.pos) for r in nodes.where("id = 1").collect()} == {("texts", -1, 0), ("texts.prov", 0, 0), ("tables", -1, 0), ("tables.table_cells", 0, 1)}
    assert {r.id for r in nodes.collect()} == {1, 6}
    assert layout_texts(nodes, "id").where("id = 1").first().text == 'é "q"'
    assert layout_provs(nodes, "id").where("id = 1").first().page_no == 2
    assert layout_cells(nodes, "id").where("id = 1").first().row == 1
    assert flatten_nested(df.where("id > 9"), "id", "p").count() == 0


def brute_intervals(rows):
    out = set()
    for e in {r[0] for r in rows if r[0] is not None}:
        pages = sorted({p for x, s, t in rows if x == e and s is not None and t is not None and 0 <= s <= t for p in range(s, t + 1)})
        runs = []
        for p in pages:
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out |= {(e, "period", a, b) for a, b in runs}
        out |= {(e, "gap", a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:])}
    return out


def test_sweep_intervals(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, -1, *range(60)]), None) for _ in range(120)]
    rows = [(e, s, None if s is None or rnd.random() < 0.1 else s + rnd.randint(-1, 6)) for e, s, _ in rows] + [("d", 5, 5), ("d", 5, 5), ("d", 100000, 300000)]
    df = spark.createDataFrame(rows, "item string, s int, t int").selectExpr("*", "1 AS kind", "2 AS _e")
    for bits in (2, 12):
        assert {tuple(r) for r in sweep_intervals(df, "item", "s", "t", bits).collect()} == brute_intervals(rows)
    assert sweep_intervals(df.where("s > 999999999"), "item", "s", "t").count() == 0
