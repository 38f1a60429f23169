"""Articles on pages, lines of scanned words, and streams of files."""

from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import layout, lookup, placement
from foliant.session import table
from foliant.streaming import arrivals


def test_places(spark):
    a = spark.createDataFrame([("i", 1, "Growth of alpine moss", 4), ("i", 2, "Nothing like it", 4), (None, 3, "Growth of alpine moss", 4)], "item string, article_id long, title string, hint int")
    b = spark.createDataFrame(
        [("i", 1, 2, "text", "Growth of alpine moss"), ("i", 2, 9, "title", "Growth of alpine moss"), ("i", 3, 4, "text", "growth of alpine moss and a great many further words that follow here"), ("i", 4, None, "title", None)],
        "item string, block_id long, page_no int, label string, text string",
    )
    assert [tuple(r) for r in placement.title_places(a, b).collect()] == [("i", 1, 9, 1.495)]
    skip = spark.createDataFrame([("i", 9)], "item string, page_no int")
    assert placement.title_places(a, b, skip_pages=skip).first().page == 2
    art = spark.createDataFrame([("i", 1, "4", "6"), ("i", 2, "5", "99"), ("i", 3, "x", None), ("i", 4, "50", "52")], "item string, article_id long, first_page string, last_page string")
    m = spark.createDataFrame([("i", str(k), k - 4) for k in range(4, 10)], "item string, label string, page int")
    found = spark.createDataFrame([("i", 4, 30)], "item string, article_id long, page int")
    got = {r.article_id: (r.start, r.stop, r.method) for r in placement.place_articles(art, m, found).collect()}
    assert got == {1: (0, 2, "page_map"), 2: (1, 95, "partial"), 3: (None, None, "failed"), 4: (30, 32, "title")}


def test_ends(spark):
    e = spark.createDataFrame([("i", 1, 2), ("i", 2, 6), ("i", 3, 6), ("i", 4, 11), ("i", 5, None)], "item string, entry_id long, start int").withColumn("last", F.lit(19))
    spans = placement.ends_before_next(e, "last")
    assert {(r.entry_id, r.stop) for r in spans.collect()} == {(1, 5), (2, 10), (3, 10), (4, 19)}
    filled = spark.createDataFrame([("i", p) for p in (2, 3, 6, 11, 14)], "item string, page int")
    assert {(r.entry_id, r.stop) for r in placement.trim_blank_ends(spans, filled).collect()} == {(1, 3), (2, 6), (3, 6), (4, 14)}


def test_relocate_and_claim(spark):
    e = spark.createDataFrame([("i", 1, "A", 5, 8, 10), ("i", 2, "B", 5, 6, 20), ("i", 3, "C", 9, 9, 30)], "item string, entry_id long, title string, start int, stop int, printed int")
    h = spark.createDataFrame([("i", 20, 15), ("i", 30, 40)], "item string, printed int, page int")
    got = {r.entry_id: (r.start, r.stop, r.moved) for r in placement.relocate_shared_starts(e, h).collect()}
    assert got == {1: (5, 8, False), 2: (15, 16, True), 3: (9, 9, False)}
    t = spark.createDataFrame([("i", 1, "Alpine moss growth"), ("i", 2, "Alpine moss growth")], "item string, title_id long, title string")
    b = spark.createDataFrame([("i", 7, 3, "title", "Alpine moss growth"), ("i", 8, None, "title", "Growth of alpine moss")], "item string, block_id long, page_no int, label string, text string")
    assert {(r.title_id, r.block_id) for r in placement.claim_blocks(t, b).collect()} == {(1, 7), (2, 8)}


def test_lines(spark):
    w = [("i", 0, 10, 100, 40, 150, "Big"), ("i", 0, 50, 105, 90, 155, "Title"), ("i", 0, 10, 300, 30, 312, "small"), ("i", 0, 10, 340, 30, 352, "text"), ("i", 0, 40, 300, 50, 312, "words")]
    words = spark.createDataFrame(w, "item string, page int, x1 int, y1 int, x2 int, y2 int, text string")
    lines = placement.text_lines(words)
    assert sorted(r.text for r in lines.collect()) == ["Big Title", "small words", "text"]
    assert placement.title_lines(words).first().text == "Big Title"


def test_names_and_answers(spark):
    df = spark.createDataFrame([("By Anna Lee, M.D., and Bo Fox",), ("the growth of moss",), (None,)], "x string")
    assert [r[0] for r in df.select(layout.byline(F.col("x"))).collect()] == [True, False, False]
    assert df.select(layout.parse_names(F.col("x"))).first()[0] == ["Anna Lee", "Bo Fox"]
    assert spark.sql("SELECT 'Original Article: The growth of moss' AS x").select(text.strip_section_label(F.col("x"))).first()[0] == "The growth of moss"
    c = spark.createDataFrame([(1, "i", 1, 1)], "request_id long, item string, tier int, rank int")
    r = spark.createDataFrame([(1, "Growth of alpine moss", "12-15")], "request_id long, title string, pages string")
    e = spark.createDataFrame([("i", 5, "Alpine moss growth", 12, 15), ("i", 6, "Harbor tariffs", 20, 22)], "item string, entry_id long, title string, first_page int, last_page int")
    a = lookup.answers_from_contents(c, r, e).first()
    assert (a.entry_id, a.confidence) == (5, 100)


def test_streams(spark, tmp_path):
    seen = []
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"n": {k}}}')
        arrivals.process_arrivals(spark, str(tmp_path / "in"), "n int", lambda df, _: seen.extend(r.n for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert seen == [0, 1]
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "a.json").write_text("\n".join('{"k": "a", "event_type": "x", "ts": "2024-01-01T00:00:%02d"}' % s for s in (1, 5, 9)))
    stream = spark.readStream.schema("k string, event_type string, ts timestamp").json(str(tmp_path / "ev"))
    for name, df, n in (("kept", arrivals.without_retries(stream, ["k"], "ts"), 1), ("counted", arrivals.request_counts(stream), 1)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "kept" else "update").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == n
    assert table(spark, "/root/testdata/sf0.001", "pubs").count() == 500
