"""The queries of the general modules with nulls, long texts and repeated rows; some of them on empty tables and against their SQL,
which is compared for every query elsewhere, on larger tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from foliant.plans import audit, files, general, layout, lookup_chain, reference

SF = "/root/testdata/sf0.001"
PARTS = (lookup_chain, layout, audit, files, general)
NAMES = [n for m in PARTS for n in m.QUERIES]
QUERIES = {n: f for m in PARTS for n, f in m.QUERIES.items()}
SQL = {n: f for m in PARTS for n, f in m.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module", autouse=True)
def one_partition(spark):
    """The tables here have a few rows, and most of the time would go into empty tasks."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL)[::7])
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(map(plain, r)) for r in df.select(*columns).collect()) == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """The tables without rows; and a few rows, twice, with a row of nulls, a very long text and extra columns of clashing names."""
    base = tmp_path_factory.mktemp("odd")
    for path in glob.glob(f"{SF}/*.parquet"):
        df, name = spark.read.parquet(path), os.path.basename(path)
        df.limit(0).write.parquet(f"{base}/empty/{name}")
        few = df.limit(12)
        texts = {"text", "title", "article_title", "article_author", "pages", "name"}
        long = few.limit(1).selectExpr(*["repeat('Moss, and rye; ', 3000) AS `%s`" % c if c in texts else f"`{c}`" for c in df.columns])
        nulls = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
        rows = few.unionByName(few).unionByName(long).unionByName(nulls)
        extra = {c: "1" for c in ("n", "k", "pos", "unit", "start", "stop") if c not in df.columns}
        rows.selectExpr("*", *[f"{v} AS {c}" for c, v in extra.items()]).write.parquet(f"{base}/odd/{name}")
    return str(base)


@pytest.mark.parametrize("name", NAMES[::3])
def test_empty_tables(spark, odd_tables, name):
    totals = {"confirmed_entries", "technique_totals", "audit_rows"}  # a grand total is a row
    assert QUERIES[name](spark, f"{odd_tables}/empty").count() <= (1 if name in totals else 0)


@pytest.mark.parametrize("name", NAMES)
def test_nulls_and_repeats(spark, odd_tables, name):
    QUERIES[name](spark, f"{odd_tables}/odd").collect()


def test_names_are_unique():
    assert len(NAMES) == len(set(NAMES)) and not set(NAMES) & set(reference.QUERIES)
