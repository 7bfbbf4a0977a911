"""Problem 8: filling containers of fixed capacity.

Items of one size are interchangeable, so the packing is planned on the histogram of sizes (at most capacity + 1
rows, whatever the number of items) and only then laid onto the items by their rank within their size.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomloom.session import written

CAPACITY = 2048
#: Ranks within one size are made in parts of about so many items, since one size can hold any share of them.
PART_ITEMS = 200_000


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Placements (size, first rank, first container, items a container), in rank order of each size, and the number of containers.

    The item of rank r of that size goes to container `first container + (r - first rank) // items a container`.
    Sizes are from 0 to capacity. Items above a third of the capacity come first: at most two of them share a
    container, so from the largest on each is matched with the largest that fits beside it. Smaller items follow from
    the largest on, each into the smallest gap that holds it, or new containers. Items of size 0 go to the first one.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    rank: dict[int, int] = defaultdict(int)
    steps: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges (first container, number)
    containers = 0

    def put(size: int, number: int, first: int, each: int = 1) -> None:
        steps.append((size, rank[size], first, each))
        rank[size] += number
        left[size] -= number

    def free(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps or not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, number))

    order: list[int] = []  # the gaps there are, ascending
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        if not left[s]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - s) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            n = left[s]
            put(s, n, containers)
            free(capacity - s, containers, n)
        elif large[at] == s:
            n = left[s] // 2
            if n:
                put(s, 2 * n, containers, 2)
                free(capacity - 2 * s, containers, n)
            else:
                rest = bisect.bisect_left(large, s) - 1  # the last one of its size: the next smaller one, if any
                while rest >= 0 and not left[large[rest]]:
                    rest -= 1
                n = 1
                put(s, 1, containers)
                if rest >= 0:
                    put(large[rest], 1, containers)
                free(capacity - s - (large[rest] if rest >= 0 else 0), containers, 1)
        else:
            t = large[at]
            n = min(left[s], left[t])
            put(s, n, containers)
            put(t, n, containers)
            free(capacity - s - t, containers, n)
        containers += n
    for s in sorted((s for s in left if 0 < 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                n, rest = divmod(left[s], each)
                if n:
                    put(s, n * each, containers, each)
                    free(capacity - each * s, containers, n)
                    containers += n
                if rest:
                    put(s, rest, containers, rest)
                    free(capacity - rest * s, containers, 1)
                    containers += 1
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
            each = min(gap // s, max(1, left[s] // number))
            n = min(number, left[s] // each)
            put(s, n * each, first, each)
            free(gap - each * s, first, n)
            free(gap, first + n, number - n)
    if left.get(0):
        put(0, left[0], 0, left[0])
        containers = max(containers, 1)
    return steps, containers


def assign(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """(key, piece_no int, size int, container_id bigint): every item in a container, no container over its capacity.

    An item larger than the capacity is cut into pieces of the capacity and a last one (piece_no from 0); no other is
    cut. Null sizes count as 0; negative ones are an error. Ties are broken by key, equal keys arbitrarily but each is
    placed. An empty table gives an empty result. sizes is read three times: pass a written table.

    The driver gets the histogram, capacity + 1 rows and one for every part_items items; the plan laid out on the
    executors has at most a few rows for each pair of a size and a gap, so it is bounded by the capacity, not by the
    number of items. No task ranks more than some part_items items, however many have one size.
    """
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    whole = F.assert_true(n >= 0, F.lit("sizes cannot be negative"))
    cut = F.when(n <= capacity, F.array(n)).otherwise(
        F.concat(F.array_repeat(F.lit(capacity).cast("bigint"), (n / capacity).cast("int")), F.when(n % capacity > 0, F.array(n % capacity)).otherwise(F.array().cast("array<bigint>")))
    )
    items = sizes.where(whole.isNull()).select(F.col(key).alias("key"), F.posexplode(cut).alias("piece_no", "size"))
    many = {r.size: 1 + r.n // part_items for r in items.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") >= part_items).collect()}
    of_size = F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("size")], F.lit(1)) if many else F.lit(1)
    items = items.withColumn("part", F.pmod(F.xxhash64("key", "piece_no"), of_size).cast("int"))
    counts: dict[tuple[int, int], int] = {(r.size, r.part): r.n for r in items.groupBy("size", "part").agg(F.count("*").alias("n")).collect()}
    histogram: dict[int, int] = defaultdict(int)
    start: dict[tuple[int, int], int] = {}
    for (s, part), m in sorted(counts.items()):
        start[s, part] = histogram[s]
        histogram[s] += m
    steps, _ = plan(histogram, capacity)
    base, total = np.zeros(capacity + 2, np.int64), 0  # sizes laid one after another, so one search finds a step
    for s in range(capacity + 1):
        base[s] = total
        total += histogram.get(s, 0)
    rows = sorted((base[s] + r, f, e) for s, r, f, e in steps)
    at, first, each = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
    first_part = np.zeros(capacity + 2, np.int64)  # parts laid one after another too
    np.cumsum([many.get(s, 1) for s in range(capacity + 1)], out=first_part[1:])
    starts = np.zeros(first_part[-1], np.int64)
    for (s, part), r in start.items():
        starts[first_part[s] + part] = base[s] + r

    def run(batches):
        for batch in batches:
            s, part, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            rank = starts[first_part[s] + part] + row - 1
            i = np.searchsorted(at, rank, "right") - 1
            box = first[i] + (rank - at[i]) // each[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.int32)), pa.array(box)], names=[key, "piece_no", "size", "container_id"])

    ranked = items.withColumn("row", F.row_number().over(Window.partitionBy("size", "part").orderBy("key", "piece_no")))
    kind = sizes.schema[key].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{key}` {kind}, piece_no int, size int, container_id bigint")


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Documents (doc_id, text) in containers, sized in tokens; each text is encoded once."""
    from atomloom.llm.encode import token_counts

    return assign(written(token_counts(docs, path=path), "sizes"), capacity=capacity)
