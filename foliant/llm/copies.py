"""Records equal but for formatting: recursive radix partitioning on canonical bytes, then tries with counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliant.session import cut

EDGE = 12  # characters on an edge of a trie
ROWS_A_TASK = 1_000_000
MAX_HOT = 4096  # groups that are told apart as hot
_PARTIAL = "key string, first_id bigint, copies bigint"


def canonical_text(c: Column) -> Column:
    """Letters and digits only, in lower case; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")


def canonical_ranges(c: Column) -> Column:
    """The distinct ranges of an array of [start, stop] in a fixed order and notation; digits without leading zeros.
    A bound without digits keeps its letters; a null list, range or bound is marked as such."""

    def bound(x: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(x, r"[^0-9]+", ""), r"^0+(?=[0-9])", "")
        return F.coalesce(F.when(digits != "", digits).otherwise(canonical_text(x)), F.lit("~"))

    one = F.transform(c, lambda r: F.coalesce(F.concat_ws("-", F.transform(r, bound)), F.lit("~")))
    return F.coalesce(F.concat_ws(",", F.array_sort(F.array_distinct(one))), F.lit("~"))


class Trie:
    """Keys cut into edges of EDGE characters; a node's terminal holds [smallest id, count] of the keys that end there."""

    __slots__ = ("root", "keys")

    def __init__(self) -> None:
        self.root: dict = {}
        self.keys = 0

    def add(self, key: str, first_id: int, copies: int) -> None:
        node = self.root
        for i in range(0, len(key), EDGE):
            edge = key[i : i + EDGE]
            below = node.get(edge)
            if below is None:
                below = node[edge] = {}
            node = below
        end = node.get(None)
        if end is None:
            node[None] = [first_id, copies]
            self.keys += 1
        else:
            end[1] += copies
            if first_id < end[0]:
                end[0] = first_id

    def rows(self) -> Iterator[tuple[str, int, int]]:
        stack: list[tuple[str, dict]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for edge, below in node.items():
                if edge is None:
                    yield prefix, below[0], below[1]
                else:
                    stack.append((prefix + edge, below))


def _batch(rows) -> pa.RecordBatch:
    k, i, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(i, pa.int64()), pa.array(c, pa.int64())], ["key", "first_id", "copies"])


def _out(trie: Trie, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    rows = []
    for r in trie.rows():
        rows.append(r)
        if len(rows) == size:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _common(a: Column, b: Column) -> Column:
    """How many characters two strings begin with in common, by halving: their beginnings agree up to there and not beyond."""
    start = F.struct(F.lit(0).alias("low"), F.least(F.length(a), F.length(b)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        alike = F.left(a, mid) == F.left(b, mid)
        return F.struct(F.when(alike, mid).otherwise(s["low"]).alias("low"), F.when(alike, s["high"]).otherwise(F.greatest(mid - 1, s["low"])).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda s: s["low"])


def _bucketed(rows: DataFrame, levels: list[DataFrame], first_prefix: int) -> DataFrame:
    """Adds ``bucket``, the prefix that ``levels`` of split buckets (prefix, width) leave a key in, and ``split``, whether the
    last level split it. The tables are joined: Spark broadcasts them while they are small and shuffles them beyond."""
    rows = rows.withColumn("bucket", F.substring("key", 1, first_prefix)).withColumn("split", F.lit(True))
    for level in levels:
        rows = rows.join(level.select(F.col("prefix").alias("bucket"), "width"), "bucket", "left")
        rows = rows.withColumn("bucket", F.coalesce(F.left("key", F.col("width")), F.col("bucket"))).withColumn("split", F.col("width").isNotNull()).drop("width")
    return rows


def count_keys(keyed: DataFrame, bucket_keys: int = 50_000, first_prefix: int = 2) -> DataFrame:
    """(key, first_id, copies) of each distinct key of (id, key), smallest id first.

    1. Each task counts its own rows in a trie and hands on one row per key it saw, so a key that holds a third of all
       rows becomes a row per task before anything is shuffled.
    2. Radix partitioning: buckets are prefixes of the key. A bucket of more than ``bucket_keys`` rows is split by the
       character after the longest beginning that all its keys share, again and again until each fits; a bucket of one key
       can't be split and doesn't need to be, as its rows are one per task. The split buckets of a level are a table; the
       driver only learns whether there are any.
    3. Each bucket is counted in a trie of its own; a task holds one bucket's trie at a time.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            add = trie.add
            for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                add(k, i, 1)
            if trie.keys > 200_000:
                yield from _out(trie)
                trie = Trie()
        yield from _out(trie)

    partials = cut(keyed.select("id", "key").where("id IS NOT NULL AND key IS NOT NULL").mapInArrow(partial, _PARTIAL), "partials")
    levels: list[DataFrame] = []
    while True:
        rows = _bucketed(partials, levels, first_prefix).where("split")
        big = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        big = big.where((F.col("n") > bucket_keys) & (F.col("low") != F.col("high")))
        level = cut(big.select(F.col("bucket").alias("prefix"), (_common(F.col("low"), F.col("high")) + 1).alias("width")), "split")
        if level.isEmpty():
            break
        levels.append(level)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = Trie(), None
        for b in batches:
            for bk, k, i, c in zip(*(b.column(j).to_pylist() for j in range(4))):
                if bk != now:
                    if trie.keys:
                        yield from _out(trie)
                    trie, now = Trie(), bk
                trie.add(k, i, c)
        yield from _out(trie)

    n = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), partials.count() // ROWS_A_TASK + 1)
    placed = _bucketed(partials, levels, first_prefix).select("bucket", "key", "first_id", "copies")
    return placed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(final, _PARTIAL)


def anchor_keys(anchors: DataFrame) -> DataFrame:
    """(id, key) of the request records that take part: those with an id and a title. A null identifier equals only null."""
    key = F.concat_ws(
        "\u001f",
        canonical_ranges(F.col("leaf_ranges")),
        canonical_text(F.col("article_title")),
        F.coalesce(canonical_text(F.col("identifier")), F.lit("\u0000")),
    )
    return anchors.where("article_title IS NOT NULL AND anchor_id IS NOT NULL").select(F.col("anchor_id").alias("id"), key.alias("key"))


def copy_groups(keyed: DataFrame, hot_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Groups of (id, key), and each row that isn't its group's smallest id as (first_id, copy_id).

    Rows find their group by joining on the key. A group of more than ``hot_rows`` rows is spread over salts; hot groups
    are at most rows / hot_rows, and hot_rows grows so that they are never more than MAX_HOT: that many are
    broadcast, to tell rows whether they need a salt. Null ids and keys take no part; a repeated id counts as a copy
    of itself in ``copies`` but gives no pair.
    """
    groups = cut(count_keys(keyed).where("copies > 1"), "groups")
    rows = groups.agg(F.sum("copies")).first()[0] or 0
    hot_rows = max(hot_rows, rows // MAX_HOT)
    salted = groups.withColumn("salts", (F.col("copies") / hot_rows).cast("int") + 1)
    if rows > hot_rows and salted.where("salts > 1").limit(1).count():
        hot = salted.where("salts > 1").select("key", "salts")
        left = keyed.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        right = salted.select("key", "first_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        pairs = left.join(right, ["key", "salt"])
    else:
        pairs = keyed.join(groups.select("key", "first_id"), "key")
    return groups, pairs.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def copied_anchors(anchors: DataFrame) -> DataFrame:
    """(first_id, copy_id) of request records equal in title, identifier and leaf ranges but for formatting."""
    return copy_groups(anchor_keys(anchors))[1]


def collapse_anchors(anchors: DataFrame) -> DataFrame:
    """One record for each distinct content, as its first row wrote it, with the number of its copies."""
    counted = count_keys(anchor_keys(anchors)).select("first_id", "copies")
    record = anchors.where("article_title IS NOT NULL").select("anchor_id", "article_title", "identifier", "leaf_ranges")
    return record.join(counted, record["anchor_id"] == counted["first_id"]).select("anchor_id", "article_title", "identifier", F.to_json("leaf_ranges").alias("leaf_ranges"), "copies")
