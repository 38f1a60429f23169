"""The periodical operators on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import pages, text
from foliant.operators import catalogue, contents, lookup, pagination, requests, scoring
from foliant.operators.skew import salted_join
from foliant.sources import readers, sinks
from foliant.sources.providers import TableProvider


def values(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_pages(spark):
    assert values(spark, pages.roman_to_int, ["xiv", "MCM", "iii", "abc", "", None]) == [14, 1900, 3, None, None, None]
    got = values(spark, pages.parse_pages, ["987-93", "671-85", "407-18", "1421-30", "995-03", "69", "69-", "iii", None])
    assert [g and tuple(g) for g in got] == [(987, 993), (671, 685), (407, 418), (1421, 1430), (995, 1003), (69, 69), (69, 69), None, None]
    assert values(spark, pages.leaf_int, ["n26", "26", "", "foo", "n", None]) == [26, None, None, None, None, None]
    assert values(spark, pages.year_bucket, ["1997", "1899", "x", None]) == ["1995-1999", "unknown", "unknown", "unknown"]


def test_text(spark):
    assert [sorted(x) for x in values(spark, text.surnames, ["Miller, G E", "George E. Miller", "Pounds, L A; Wallin, J", None])] == [["miller"], ["miller"], ["pounds", "wallin"], []]
    assert values(spark, text.normalize_title, ["The Growth of Moss!", "", None]) == ["growth moss", "", None]
    df = spark.createDataFrame([("21", "21-22"), ("3/4", "4"), ("", "1"), ("", ""), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(text.label_match(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, True]
    df = spark.createDataFrame([("Growth of alpine moss", "Growth of alpine mos"), ("Harbor tariffs", "Growth of moss"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.title_match(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert values(spark, text.first_string, ['["a","b"]', "c", None]) == ["a", "c", None]
    assert values(spark, text.py_title, ["o'brien smith-jones"]) == ["O'Brien Smith-Jones"]
    assert values(spark, text.nfk_fold, ["Größe é"]) == ["groesse e"]


def test_page_index(spark):
    leaves = spark.createDataFrame([("i", n, n not in (0, 101), "4" if n == 1 else None, 1.0) for n in range(102)], "item string, leaf int, accessible boolean, label string, confidence double")
    m = {r.leaf: r.br for r in pagination.page_index_map(leaves).collect()}
    assert m[0] is None and m[1] == 0 and m[100] == 99 and m[101] is None
    assert [tuple(r) for r in pagination.printed_to_page(leaves).collect()] == [("i", "4", 0)]


@pytest.mark.parametrize("labels,status", [(range(1, 11), "ok"), ([None] * 10, "unusable"), ([1, 2, 3, 4, 5] * 2, "restart_pagination"), ([1, 2, 3, 4, 5] + [None] * 5, "repair")])
def test_label_health(spark, labels, status):
    rows = [("i", n, True, None if x is None else str(x), 1.0) for n, x in enumerate(labels)]
    leaves = spark.createDataFrame(rows, "item string, leaf int, accessible boolean, label string, confidence double")
    assert pagination.page_label_health(leaves).first().status == status


def test_repair(spark):
    a = spark.createDataFrame([("a", 5, 29, 42), ("b", 1, 25, 26), ("b", 2, 26, 27), ("b", 1, 11, 12), ("c", 1, 25, 26), ("c", 1, 11, 12)], "item string, leaf int, first_page int, last_page int")
    kept = pagination.supported_offsets(a).groupBy("item").count().collect()
    assert {tuple(r) for r in kept} == {("a", 1), ("b", 2)}
    m = {r.printed: r.leaf for r in pagination.repaired_map(a.where("item = 'a'")).collect()}
    assert m[29] == 5 and m[42] == 18 and 43 not in m


def test_hits(spark):
    known = spark.createDataFrame([(1, "i", "Growth of alpine moss colonies", ["miller"], 10, 15)], "anchor_id long, item string, title string, names array<string>, a_start int, a_end int")

    def one(title, start, end):
        e = spark.createDataFrame([(7, "i", 0, title, None, start, end)], "entry_id long, item string, ord int, e_title string, e_names array<string>, e_start int, e_end int")
        p = scoring.judged_pairs(known, e)
        return scoring.find_hit(p).first().match, scoring.findable(p).first().hit

    same = "Growth of alpine moss colonies"
    assert one(same, 10, 15) == ("exact", True)
    assert one(same, 11, 16) == ("soft", True)
    assert one("Harbor tariffs", 10, 15) == ("leaves_only", False)
    assert one(same, 40, 45) == ("content_only", False)
    assert one("Harbor tariffs", 40, 45) == ("miss", False)
    assert one(same, 10, 18) == ("soft", False)
    assert one(same, 10, 14) == ("soft", False)


def test_contents(spark):
    e = spark.createDataFrame([("i", k, s) for k, s in enumerate((2, 6, 6, 11))], "item string, entry_id int, start int").withColumn("last", F.lit(19))
    assert [(r.start, r.stop) for r in contents.spans(e, "last").orderBy("entry_id").collect()] == [(2, 5), (6, 6), (6, 10), (11, 19)]
    assert sorted(r.start for r in contents.merged_starts(spark.createDataFrame([("i", s) for s in (1, 2, 6, 7, 12)], "item string, start int")).collect()) == [1, 6, 12]
    rows = [("COMPUTERS", None, 50), ("ORDER NOW!", None, 50), ("A study", ["Managing Editor"], 50), ("A study", None, 1), ("A study", None, 50)]
    f = contents.filter_reasons(spark.createDataFrame(rows, "title string, names array<string>, start int").withColumn("page_count", F.lit(100)))
    assert [r.reason for r in f.collect()] == ["label", "advert", "editorial", "front_matter", None]
    model = spark.createDataFrame([("i", 1, '```json\n{"category":"article_start","articles":[{"title":"T"}],"table_of_contents":null}\n```')], "item string, pdf_page int, p string")
    toc, articles = contents.model_pages(model, "p")
    assert toc.count() == 0 and articles.first().title == "T"


def test_audit(spark):
    tier = lambda p, n: spark.range(1).select(catalogue.tier(F.lit(p), F.lit(n))).first()[0]
    assert [tier(95.0, 30), tier(94.9, 30), tier(79.9, 30), tier(49.9, 30), tier(0.0, 30), tier(99.0, 29)] == ["clean", "near", "mid", "bad", "zero", "unknown"]
    j = spark.createDataFrame([("p", float(x)) for x in (80, 95, 97, 100, 100)], "publisher string, pct double")
    r = catalogue.publisher_trust(j).first()
    assert (r.q1_pct, r.median_pct, r.trusted) == (87.5, 97.0, True)

    def status(hits):
        rows = [("j", 2001 + k, str(k), 1, h) for k, h in enumerate(hits)]
        r = catalogue.transitions(spark.createDataFrame(rows, "issn string, year int, issue string, anchors int, hits int")).first()
        return r.status, r.year

    assert status([1] * 5)[0] == "always_clean" and status([1] * 4)[0] == "no_data" and status([0] * 10)[0] == "never_clean"
    assert status([0] * 5 + [1] * 5) == ("transitioned", 2010)
    issues = spark.createDataFrame([("j", 2000 + k % 5, str(k), 2, h) for k, h in enumerate((0, 0, 0, 2, 2))], "issn string, year int, issue string, anchors int, hits int")
    assert catalogue.stop_after_misses(issues).count() == 3


def test_publications(spark):
    pubs = spark.createDataFrame([("a", "X Journal", "1", None, None), ("b", "Y", None, None, "Elsevier Ltd."), ("c", "Y", None, None, None), ("d", "Z", None, None, None)], "pub_id string, title string, issn string, sim_pubid string, publisher string")
    cont = spark.createDataFrame([("1", "Other", "1", None, None), ("2", "X Journal", None, None, None), ("3", "Y", None, None, "Elsevier"), ("4", "Y", None, None, "Wiley")], "ident string, name string, issn string, sim_pubid string, publisher string")
    got = {r.pub_id: (r.container_id, r.method) for r in catalogue.match_publications(pubs, cont).collect()}
    assert got == {"a": ("1", "issn"), "b": ("3", "title+publisher"), "c": (None, "title_ambiguous"), "d": (None, "unmatched")}


def test_requests(spark):
    pair = lambda a, b, c=None, d=None: spark.createDataFrame([(a, b, c, d)], "a array<string>, b array<string>, c array<string>, d array<string>").select(requests.chosen_ranges(*map(F.col, "abcd"))).first()[0]
    assert [tuple(x) for x in pair(["n241", "n281"], ["n244", "n283"])] == [("n241", "n244"), ("n281", "n283")]
    assert [tuple(x) for x in pair(["12"], ["14"], ["n2"], ["n4"])] == [("n2", "n4")]
    assert pair(["n1"], []) is None
    cover = "Request on Friday\nAmerasia Journal 1973-2012\n0044-7471\nOn Strike\nKaren Umemoto\nyear 1989\n\nResponse from the library"
    got = requests.cover_fields(cover)
    assert (got["journal_title"], got["article_author"], got["year"], got["volume"]) == ("Amerasia Journal", "Karen Umemoto", "1989", None)
    assert requests.cover_fields("hello") is None and requests.cover_fields(None) is None


def test_lookup(spark):
    a = spark.createDataFrame([(1, "x", 1, 1, "a", 60), (1, "y", 2, 1, "a", 99), (1, "z", 1, 2, "a", 80), (2, "x", 3, 1, "a", 30)], "request_id int, item string, tier int, rank int, strategy string, confidence int")
    assert {r.request_id: (r.item, r.confidence) for r in lookup.select_answer(a).collect()} == {1: ("y", 94), 2: ("x", 15)}


def test_salted_join(spark):
    left = spark.range(1000).selectExpr("id AS a", "IF(id < 700, 0, id % 7) AS k")
    right = spark.range(14).selectExpr("id AS b", "id % 7 AS k")
    plain = {tuple(r) for r in left.join(right, "k").select("a", "b").collect()}
    assert {tuple(r) for r in salted_join(left, right, ["k"], per_key=50).select("a", "b").collect()} == plain


def test_files(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<book><page leafNum='0'><addToAccessFormats>false</addToAccessFormats></page><page leafNum='1'><addToAccessFormats>true</addToAccessFormats></page></book>")
    assert [(r.leaf, r.accessible) for r in readers.scan_leaves(spark, str(tmp_path / "s.xml")).collect()] == [(0, False), (1, True)]
    (tmp_path / "t.json").write_text('{"item": "i", "leaf_count": 9, "entries": [{"title": "T", "leaf_ranges": [["n2", "n5"]]}]}')
    r = readers.toc(spark, str(tmp_path / "t.json")).first()
    assert (r.page_count, r.start, r.stop) == (9, 2, 5)
    (tmp_path / "l.csv").write_text('time,username,source_identifier,action,full_form\n1,u,s,a,"{""identifier"": ""i"",\n ""start"": [""n1""], ""stop"": [""n2""]}"\n')
    log = readers.ill_log(spark, str(tmp_path / "l.csv"))
    assert requests.parse_log(log).first().item == "i"
    (tmp_path / "h.html").write_text("<div class='ocr_page' id='page_3'><span class='ocrx_word' id='w' title='bbox 1 2 3 4; x_wconf 9'>Hi</span></div>")
    assert tuple(readers.hocr_words(spark, str(tmp_path / "h.html")).select("leaf", "x1", "y2", "text").first()) == (3, 1, 4, "Hi")
    (tmp_path / "c.json").write_text('{"ident":"x","name":"N","issnl":"1","extra":{"ia":{"sim":{"sim_pubid":"9"}}}}\n{"ident":"y","name":"M"}\n')
    assert readers.containers(spark, str(tmp_path / "c.json"), True).count() == 1
    head = spark.createDataFrame([("i", 2)], "item string, schema_version int")
    doc = sinks.toc_documents(head, spark.createDataFrame([("i", 1, "B"), ("i", 0, "A")], "item string, ord int, title string")).first().document
    assert doc.index('"A"') < doc.index('"B"')
    out = sinks.DryRun()
    out.publish("i", doc, "fine")
    with pytest.raises(ValueError):
        out.publish("i", "{}", "fine")
    assert sinks.append_new(head, str(tmp_path / "done"), "item").count() == 1


def test_provider(spark):
    cache = spark.createDataFrame([("A", 1, None), ("b", 2, "timeout")], "doi string, n int, error string")
    p = TableProvider(cache, "doi", "x")
    rows = spark.createDataFrame([("a",), ("B",), ("c",)], "doi string")
    assert {r.doi: r.x_n for r in p.enrich(rows).collect()} == {"a": 1, "B": None, "c": None}
    assert {r.doi for r in p.missing(rows).collect()} == {"b", "c"}
