"""Filling fixed-capacity containers by multiway differencing (problem 9).

Items are spread by hash into blocks of bounded weight and number, and each block
is divided by Karmarkar-Karp differencing: partial partitions with the largest
spread meet, the heaviest window of one with the lightest of the other, until one
partition of near-equal windows is left.  If its heaviest window exceeds the
capacity, the number of windows rises and the block is divided again.

Defined results: an item above the capacity, and only such an item, is divided
into full containers and a rest, which is packed like an item.  Items of size
null or zero take no space and are assigned as well.  Repeated rows are separate
items.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import staged, tasks_for

CAPACITY = 8192
BLOCK_WINDOWS = 192
BLOCK_ITEMS = 4096
#: Up to so many blocks each has a task; of more, a task takes TASK_BLOCKS, one after another.
MANY_BLOCKS = 4000
TASK_BLOCKS = 32


class _Partial:
    """Windows as parallel lists of sums, descending, and items; empty windows are implied."""

    __slots__ = ("sums", "items")

    def __init__(self, sums: list[int], items: list):
        self.sums, self.items = sums, items

    def spread(self, k: int) -> int:
        return self.sums[0] - (self.sums[-1] if len(self.sums) == k else 0)


def _join(a: _Partial, b: _Partial, k: int) -> _Partial:
    """The heaviest windows of a with the lightest of b."""
    la, lb = len(a.sums), len(b.sums)
    shared = max(0, la + lb - k)
    pairs = list(zip(a.sums[: la - shared], a.items[: la - shared])) + list(zip(b.sums[: lb - shared], b.items[: lb - shared]))
    for i in range(shared):
        x, y = la - shared + i, lb - 1 - i
        pairs.append((a.sums[x] + b.sums[y], (a.items[x], b.items[y])))
    pairs.sort(key=lambda p: -p[0])
    return _Partial([p[0] for p in pairs], [p[1] for p in pairs])


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The indexes of sizes in at most k windows with near-equal sums."""
    parts = [_Partial([s], [i]) for i, s in enumerate(sizes)]
    heap = [(-p.spread(k), i, p) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = _join(a, b, k)
        heapq.heappush(heap, (-c.spread(k), tick, c))
        tick += 1
    if not heap:
        return []
    windows = []
    for tree in heap[0][2].items:
        out, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                out.append(x)
        windows.append(out)
    return windows


def divide(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within the capacity; no size may exceed it."""
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        windows = difference(sizes, k)
        over = sum(1 for w in windows if sum(sizes[i] for i in w) > capacity)
        if not over:
            return windows
        k += max(1, min(over // 8, k // 64))


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(key, piece, start, length, container, n_pieces) of every row of sizes.

    start and length are in the unit of ``size``; container is a string.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    items = sizes.select(F.col(key).alias("key"), n.alias("n"))
    whole = F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(0)
    items = staged(items.withColumn("row", F.monotonically_increasing_id()).withColumn("whole", whole).withColumn("rest", F.col("n") - F.col("whole") * capacity), "items")
    total = items.agg(F.sum("rest"), F.count("*")).first()
    blocks = max(1, math.ceil((total[0] or 0) / (capacity * block_windows)), math.ceil(total[1] / block_items))
    last = F.col("whole") + F.when((F.col("rest") > 0) | (F.col("whole") == 0), 1).otherwise(0)
    full = items.filter("whole > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("piece"), "row", last.cast("int").alias("n_pieces"))
    full = full.select("key", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.concat(F.lit("full-"), F.col("row"), F.lit("-"), F.col("piece")).alias("container"), "n_pieces")
    rest = items.filter("rest > 0 or whole = 0").select("key", F.col("whole").cast("int").alias("piece"), (F.col("whole") * capacity).alias("start"), F.col("rest").alias("length"), last.cast("int").alias("n_pieces"), F.pmod(F.xxhash64("key", "row"), F.lit(blocks)).alias("block"))
    kind = dict(rest.dtypes)["key"]

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True]).reset_index(drop=True)
        names = [""] * len(pdf)
        block = pdf["block"].iloc[0]
        for w, members in enumerate(divide(pdf["length"].tolist(), capacity)):
            for i in members:
                names[i] = f"{block}-{w}"
        return pdf.assign(container=names)[["key", "piece", "start", "length", "container", "n_pieces"]]

    # Blocks are light in bytes but not in work: a stated number of tasks is not coalesced.
    packed = rest.repartition(max(min(blocks, MANY_BLOCKS), tasks_for(blocks, TASK_BLOCKS, 1)), "block").groupBy("block").applyInPandas(windows, f"key {kind}, piece int, start long, length long, container string, n_pieces int")
    return full.unionByName(packed).withColumnRenamed("key", key)
