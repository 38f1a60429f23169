"""Items into containers of fixed capacity, by minimum bin slack over the histogram of sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from foliant.llm.splitting import cut_points
from foliant.llm.tokens import tokenizer
from foliant.session import cut


def best_fill(sizes: list[int], counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """The multiset of sizes that contains the largest size left and comes closest to the capacity.

    Subset sums are the bits of one integer; sizes are added in descending order, each as often as its count and the
    capacity allow, in powers of two. Returns how often each size is taken, and the unused space.
    """
    first = sizes[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # size, how many, sums before
    for s in sizes:
        left = min(counts[s] - (s == first), room // s)
        k = 1
        while left > 0:
            take = min(k, left)
            grown = (reach | (reach << (s * take))) & mask
            if grown != reach:
                steps.append((s, take, reach))
                reach = grown
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {first: 1}
    at = total
    for s, take, before in reversed(steps):
        if not (before >> at) & 1:
            used[s] = used.get(s, 0) + take
            at -= s * take
    return used, room - total


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used, until no item is left. At each step the filling is repeated as often as the
    counts allow, so every step uses up a size: there are at most about ``capacity`` steps, however many items."""
    counts = {s: c for s, c in histogram.items() if c > 0 and s > 0}
    sizes = sorted(counts, reverse=True)
    out = []
    while sizes:
        used, _ = best_fill(sizes, counts, capacity)
        times = min(counts[s] // n for s, n in used.items())
        out.append((used, times))
        for s, n in used.items():
            counts[s] -= n * times
        sizes = [s for s in sizes if counts[s]]
    return out


MOST_CELLS = 65_536  # counts of (size, salt) beyond one a size that the driver holds


def sized_items(df: DataFrame, key: str, text: str, capacity: int, tokens: str = "bytes") -> DataFrame:
    """(k, piece, size): each text with its tokens, or the parts of one that has more than ``capacity``. One scan; with a
    token per byte only texts that have to be divided go to Python."""
    key_type = df.schema[key].dataType.simpleString()
    n = F.coalesce(F.octet_length(text), F.lit(0))
    seen = n > capacity if tokens == "bytes" else n > 0
    source = df.select(F.col(key).alias("k"), n.alias("n"), F.when(seen, F.col(text)).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(tokens)
        for b in batches:
            texts = b["t"].to_numpy(dtype=object)
            rows, pieces, sizes = [], [], []
            for i, t in enumerate(texts):
                if t is None:
                    rows.append(i)
                    pieces.append(0)
                    sizes.append(int(b["n"].iat[i]) if tokens == "bytes" else 0)
                    continue
                starts = tok.starts(t)
                parts = cut_points(t.encode("utf-8", "surrogatepass"), starts, capacity, 0)
                rows += [i] * len(parts)
                pieces += range(len(parts))
                sizes += [hi - lo for lo, hi in parts]
            yield pd.DataFrame({"k": b["k"].iloc[rows].reset_index(drop=True), "piece": pieces, "size": sizes})

    return source.mapInPandas(run, f"k {key_type}, piece int, size int")


def pack(df: DataFrame, key: str, text: str, capacity: int = 4096, tokens: str = "bytes", per_salt: int = 1_000_000) -> DataFrame:
    """(container_id, key, piece, size): every text in a container of ``capacity`` tokens.

    Only texts larger than a container are divided, at natural boundaries; ``piece`` counts their parts from 0. Sizes
    are integers up to the capacity, so the driver sees a histogram of at most ``capacity`` counts, whatever the number
    of texts, and plans the fillings on it. Items are then numbered within their size and look up their container by that
    number. A size of more than ``per_salt`` items is numbered in as many salts (a hash of the key) as that makes; the
    driver and the tasks see a count for each, and per_salt grows with the items so that these are at most MOST_CELLS more.

    Null and empty texts have no tokens and need no space: they come out once with container_id null and size 0.
    Repeated rows are separate items. Other columns are dropped. ``capacity`` must be at least 8. Texts are read once.
    """
    items = cut(sized_items(df, key, text, capacity, tokens), "items")
    counts = {int(r["size"]): int(r["count"]) for r in items.groupBy("size").count().collect()}  # at most capacity + 1 rows
    per_salt = max(per_salt, sum(counts.values()) // MOST_CELLS)
    many = {s: c // per_salt + 1 for s, c in counts.items() if c > per_salt}
    salts = F.coalesce(*[F.when(F.col("size") == s, k) for s, k in many.items()], F.lit(1))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("k", "piece"), salts).cast("int"))

    cells = salted.where("size > 0").groupBy("size", "salt").count().toPandas().sort_values(["size", "salt"])
    cells["base"] = cells.groupby("size")["count"].cumsum() - cells["count"]
    fillings = plan({s: c for s, c in counts.items() if s > 0}, capacity)
    # for each size, ranks [from, ...) belong to a filling; a container takes n of them
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for used, times in fillings:
        for s, n in used.items():
            ranges.setdefault(s, []).append((taken.get(s, 0), n, first))
            taken[s] = taken.get(s, 0) + n * times
        first += times
    look = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for s, r in ranges.items()}
    base = {(int(a), int(b)): int(c) for a, b, c in zip(cells["size"], cells["salt"], cells["base"])}
    shared = df.sparkSession.sparkContext.broadcast((look, base))

    numbered = salted.withColumn("r", F.row_number().over(W.partitionBy("size", "salt").orderBy("k", "piece")) - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look, base = shared.value
        for b in batches:
            size, salt, r = b["size"].to_numpy(), b["salt"].to_numpy(), b["r"].to_numpy()
            out = np.full(len(b), -1, dtype=np.int64)
            for s in np.unique(size[size > 0]):
                here = np.flatnonzero(size == s)
                rank = r[here] + np.array([base[int(s), int(x)] for x in salt[here]], dtype=np.int64)
                begin, n, first = look[int(s)]
                f = np.searchsorted(begin, rank, side="right") - 1
                out[here] = first[f] + (rank - begin[f]) // n[f]
            ids = pd.Series(out, dtype="Int64").mask(out < 0)
            yield pd.DataFrame({"container_id": ids, "k": b["k"], "piece": b["piece"], "size": b["size"]})

    key_type = df.schema[key].dataType.simpleString()
    return numbered.select("k", "piece", "size", "salt", "r").mapInPandas(place, f"container_id long, k {key_type}, piece int, size int").withColumnRenamed("k", key)


def containers(items: DataFrame, key: str, capacity: int = 4096) -> DataFrame:
    """One row per container: its keys in order, the tokens used and the slack. A container holds at most ``capacity``
    items, so no group is unbounded; items without tokens are in no container."""
    return (
        items.where("container_id IS NOT NULL")
        .groupBy("container_id")
        .agg(F.sort_array(F.collect_list(key)).alias("keys"), F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"))
        .withColumn("slack", F.lit(capacity) - F.col("used"))
    )
