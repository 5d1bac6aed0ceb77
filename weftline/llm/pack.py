"""Problem 9: documents into containers of fixed token capacity.

There are at most *capacity* distinct sizes, so the instance is a histogram
whatever the number of documents.  Martello and Toth's dominance reduction and
the best fit of what it leaves both work on that histogram, in runs of equal
containers; the resulting runs, again bounded by the capacity, are matched with
the documents by rank within size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import counter, slices, stored

#: A size value may be that of a third of all documents; its ranking is spread over so many groups at least and at most, as many as give a group this number of items.
RANK_GROUPS, MOST_GROUPS, GROUP_ITEMS = 64, 1024, 1_000_000


def sized(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str | None = None) -> DataFrame:
    """Rows (key, piece, token_start, size): one per document, more only for documents above the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                total = count(texts)
                pieces = np.maximum(1, -(-total // capacity))
                row = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(capacity, total[row] - piece * capacity)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype("int32")), pa.array(piece * capacity), pa.array(size.astype("int32"))], names=["_key", "piece", "token_start", "size"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, piece int, token_start long, size int")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, end rank, first container, items a container) and the number of containers.

    Dominance: a set {j, k} dominates every set with j if k fills j's rest exactly,
    or if k is the largest item beside j and no two items fit there; so it can be
    fixed.  What stays is packed by best fit, largest sizes first.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        if size > 0:
            left[size] += n
    runs: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(capacity + 1, dtype=np.int64)
    made = 0

    def put(size: int, n: int, first: int, each: int) -> None:
        runs.append((size, int(used[size]), int(used[size]) + n, first, each))
        used[size] += n
        left[size] -= n

    for j in range(capacity, 0, -1):
        while left[j]:
            room = capacity - j
            present = np.flatnonzero(left[1 : room + 1]) + 1 if room else ()
            if not len(present):  # nothing fits beside j
                n = int(left[j])
                put(j, n, made, 1)
            elif room == j:
                n = int(left[j]) // 2
                if not n:
                    break
                put(j, 2 * n, made, 2)
            else:
                small = int(present[0])
                second = small if left[small] > 1 else int(present[1]) if len(present) > 1 else capacity + 1
                k = int(present[-1])
                if k >= j or (k != room and small + second <= room):
                    break
                n = int(min(left[j], left[k]))
                put(j, n, made, 1)
                put(k, n, made, 1)
            made += n
    rest: dict[int, list[list[int]]] = {}
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rest:
                rest[room] = []
                bisect.insort(rooms, room)
            rest[room].append([first, n])

    for size in range(capacity, 0, -1):
        while left[size]:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                n = -(-int(left[size]) // each)
                add(capacity, made, n)
                made += n
                continue
            room = rooms[at]
            first, n = rest[room].pop()
            if not rest[room]:
                del rest[room], rooms[at]
            each = room // size
            whole = min(n, int(left[size]) // each)
            if whole:
                put(size, whole * each, first, each)
                add(room - each * size, first, whole)
            if whole < n:
                some = int(left[size]) if left[size] < each else 0
                if some:
                    put(size, some, first + whole, some)
                    add(room - some * size, first + whole, 1)
                add(room, first + whole + bool(some), n - whole - bool(some))
    return runs, made


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Rows (*key*, piece, token_start, tokens, container_id).

    Every row comes out, whole; only texts above the capacity are divided, at
    multiples of it.  Null and empty texts have no tokens and go to container 0.
    Repeated rows are items of their own.  An empty table gives no rows.  Extra
    columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = stored(sized(df, key, text, capacity, vocabulary), "sizes")
    groups = min(MOST_GROUPS, max(RANK_GROUPS, items.count() // GROUP_ITEMS))
    items = items.withColumn("_group", F.pmod(F.xxhash64("_key", "piece"), F.lit(groups)).cast("int"))
    cells = {(r["size"], r["_group"]): r["n"] for r in items.groupBy("size", "_group").agg(F.count("*").alias("n")).collect()}  # at most capacity x MOST_GROUPS
    counts: dict[int, int] = {}
    offset: dict[tuple[int, int], int] = {}
    for (size, group), n in sorted(cells.items()):
        offset[size, group] = counts.get(size, 0)
        counts[size] = counts.get(size, 0) + n
    runs, _ = plan(counts, capacity)
    first_rank: dict[int, np.ndarray] = {}
    detail: dict[int, np.ndarray] = {}
    for size in counts:
        own = sorted(r[1:] for r in runs if r[0] == size) if size else [(0, counts[size], 0, counts[size])]
        first_rank[size] = np.array([r[0] for r in own])
        detail[size] = np.array(own)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = np.zeros(len(pdf), dtype=np.int64)
            sizes = pdf["size"].to_numpy()
            rank = pdf["_rank"].to_numpy() + np.array([offset[s, g] for s, g in zip(sizes.tolist(), pdf["_group"].tolist())], dtype=np.int64)
            order = np.argsort(sizes, kind="stable")
            edges = np.flatnonzero(np.diff(sizes[order])) + 1
            for rows in np.split(order, edges) if len(order) else ():
                size = int(sizes[rows[0]])
                d = detail[size][np.searchsorted(first_rank[size], rank[rows], side="right") - 1]
                out[rows] = d[:, 2] + (rank[rows] - d[:, 0]) // d[:, 3]
            yield pd.DataFrame({"_key": pdf["_key"], "piece": pdf["piece"], "token_start": pdf["token_start"], "tokens": sizes.astype("int64"), "container_id": out})

    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("size", "_group").orderBy("_key", "piece")) - 1)
    kind = df.schema[key].dataType.simpleString()
    return ranked.mapInPandas(place, f"_key {kind}, piece int, token_start long, tokens long, container_id long").withColumnRenamed("_key", key)
