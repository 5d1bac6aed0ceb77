"""Problem 7: near-duplicate texts by a join of parity sketches.

A text is the set of its three-word sequences.  Its parity sketch flips one bit
for each element, so the Hamming distance of two sketches is at most the
symmetric difference of the sets.  For similarity t, that difference is at most
(1 - t) / (1 + t) of the two sizes together: sketches further apart are dropped
without looking at the texts.

Candidates come from a join by prefixes.  (Blocks of a sketch that must agree by the
pigeonhole principle would be of four bits at similarity 0.6, which any two texts share.)
All elements have one order: by the number of texts of a sample that hold them, then by
their hash.  Similar sets of sizes n share at least t * n elements, so their first shared
element is among the first n - ceil(t * n) + 1 of either: these are the words of a text,
and each similar pair shares one.  This holds for any order and size; the sample only
makes words rare.  A pair is taken at a shared word only if so many elements follow it
in both texts as the similarity demands, and if its fingerprints (a bit for the smallest
element of each of 128 parts of the hash range) agree as those of similar sets do: up to
98 elements no similar pair fails that, above it one at the threshold does with a
probability of 1e-7.  A word that many texts share is worked through in blocks of
these texts, each pair of blocks a piece of work of its own; none is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import stored
from .shingles import mix, shingle_sets

#: Texts in the sample that shows which elements are common, and how many of these are told apart; only the speed depends on them.
SAMPLE_TEXTS, COMMON_ELEMENTS = 12_000, 500_000
#: Texts of a word that are worked through at once; more are split into blocks of so many.
HOT = 20_000
BATCH = 400
#: Pairs that are compared at once.
PAIRS = 1_000_000


def band(n: np.ndarray | int, t: float) -> np.ndarray:
    """Sizes of one band differ by less than the factor that similarity *t* allows."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(t)).astype(int)


def sketch(elements: np.ndarray, b: int, t: float) -> bytes:
    """Parity sketch, of two bits for each element that the largest text of the next band has."""
    bits = 64 * max(1, math.ceil(2 * (1 / t) ** (b + 1) / 64))
    flips = np.bincount(((mix(elements ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(17)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


_BINS = np.arange(128, dtype=np.uint64) << np.uint64(57)


def fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """128 bits, one of the smallest element in each 128th of the hash range: those of similar sets mostly agree."""
    at = np.searchsorted(elements, _BINS)
    low = elements[np.minimum(at, len(elements) - 1)]
    bits = np.where((at < len(elements)) & (low >> np.uint64(57) == _BINS >> np.uint64(57)), (mix(low) >> np.uint64(33)) & np.uint64(1), 0).astype(np.uint8)
    return tuple(int(x) for x in np.packbits(bits).view(np.int64))


def least_agreement(t: float) -> int:
    """Bits of 128 that texts of similarity *t* agree in, less 5.2 standard deviations."""
    p = (1 + t) / 2
    return math.floor(128 * p - 5.2 * math.sqrt(128 * p * (1 - p)))


def words_of(elements: np.ndarray, common: np.ndarray, counts: np.ndarray, t: float) -> tuple[np.ndarray, int]:
    """The first elements of a text in the common order, and how many of them are its words; the rest is for second words."""
    n = len(elements)
    held = np.zeros(n, dtype=np.int64)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
        held = np.where(common[at] == elements, counts[at], 0)
    lead = n - math.ceil(t * n - 1e-9) + 1
    return elements[np.lexsort((mix(elements), held))[: lead + 1]], min(lead, n)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (_id, elements array<long>)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), BATCH):
                part = pdf.iloc[i : i + BATCH]
                yield pd.DataFrame({"_id": part["_id"], "elements": [_signed(s) for s in shingle_sets(part["_text"].tolist())]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, f"_id {kind}, elements array<long>")


def common_elements(some: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The elements that most texts of a sample hold, sorted, with the number of these texts; at most COMMON_ELEMENTS."""
    share = min(1.0, SAMPLE_TEXTS / max(1, some.count()))
    draw = F.xxhash64(F.col(key), F.lit("sample")).bitwiseAND(F.lit((1 << 62) - 1))
    sample = _sets(some.where(draw < F.lit(int(share * (1 << 62)))), key, text)
    held = sample.select(F.explode("elements").alias("x")).groupBy("x").agg(F.count("*").cast("int").alias("c")).where("c > 1")
    seen = held.orderBy(F.desc("c"), "x").limit(COMMON_ELEMENTS).toPandas()
    values = seen["x"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], seen["c"].to_numpy(dtype=np.int64)[order]


def classes(df: DataFrame, key: str, text: str, t: float) -> DataFrame:
    """Rows (_id, n, same, f, g, bits, words, lead): size, hash of the set, fingerprint, sketch, first elements and how many are words, of every text with at least one sequence."""
    some = df.where(F.length(text) > 0)
    common, counts = common_elements(some, key, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), BATCH):
                part = pdf.iloc[i : i + BATCH]
                rows = []
                for k, s in zip(part["_id"].tolist(), shingle_sets(part["_text"].tolist())):
                    if len(s):
                        b = int(band(len(s), t))
                        whole = mix(np.array([np.bitwise_xor.reduce(mix(s)), np.add.reduce(s)], dtype=np.uint64))
                        words, lead = words_of(s, common, counts, t)
                        rows.append((k, len(s), int(_signed(mix(whole[:1] * np.uint64(3) + whole[1:]))[0]), *fingerprint(s), sketch(s, b, t) + sketch(s, b + 1, t), _signed(words), lead))
                yield pd.DataFrame(rows, columns=["_id", "n", "same", "f", "g", "bits", "words", "lead"])

    kind = df.schema[key].dataType.simpleString()
    out = spread(some.select(F.col(key).alias("_id"), F.col(text).alias("_text"))).mapInPandas(run, f"_id {kind}, n int, same long, f long, g long, bits binary, words array<long>, lead int")
    return stored(out, "sketches")


def _candidates(cell: np.ndarray, n: np.ndarray, at: np.ndarray, f: np.ndarray, g: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that share a cell, whose sizes and places in the order allow the similarity, and whose fingerprints agree. Sorted by cell and size."""
    run = np.concatenate(([0], np.cumsum(cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    share = t / (1 + t)
    # With the smaller text's word at its place, the larger one has at most so many elements.
    most = np.minimum(n / t, (n - at) / share - n) + 1e-6
    end = np.searchsorted(run * (1 << 33) + n, run * (1 << 33) + np.maximum(most, 0).astype(np.int64), side="right")
    count = np.maximum(end - np.arange(len(n)) - 1, 0)
    upto = np.cumsum(count)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, side="right")))
        c = count[start:stop]
        i = np.repeat(np.arange(start, stop), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        keep = n[j] - at[j] >= share * (n[i] + n[j]) - 1e-6
        i, j = i[keep], j[keep]
        apart = np.bitwise_count((f[i] ^ f[j]).view(np.uint64)).astype(int) + np.bitwise_count((g[i] ^ g[j]).view(np.uint64))
        keep = apart <= 128 - least_agreement(t)
        yield i[keep], j[keep]
        start = stop


def _paired(words: DataFrame, kind: str, t: float, split: bool) -> DataFrame:
    """Rows (a, b, hot, cell, n, at, f, g) of *words* (cell, _id, n, at, f, g, part, parts), which are grouped by cell and sorted by size within it.

    A row is a pair, or with hot set a text (a) of a word that is in too many
    texts to be worked through at once.  With *split* no such rows come out, and
    pairs within one part of a cell of two parts are left to that part's own cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: int | None = None

        def out(a: pa.Array, b: pa.Array, rows: dict[str, np.ndarray] | None) -> pa.RecordBatch:
            values = [pa.array(rows[c] if rows else np.zeros(len(a), dtype=np.int64)) for c in ("cell", "n", "at", "f", "g")]
            return pa.RecordBatch.from_arrays([a, b, pa.array(np.full(len(a), rows is not None)), *values], names=["a", "b", "hot", "cell", "n", "at", "f", "g"])

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = table.column("_id").combine_chunks()
            v = {c: table.column(c).to_numpy().astype(np.int64) for c in ("cell", "n", "at", "f", "g", "part")}
            first = np.flatnonzero(np.concatenate(([True], v["cell"][1:] != v["cell"][:-1])))
            length = np.repeat(np.diff(np.append(first, len(ids))), np.diff(np.append(first, len(ids))))
            if not split and (length > HOT).any():
                many = np.flatnonzero(length > HOT)
                some = ids.take(pa.array(many))
                yield out(some, some, {c: x[many] for c, x in v.items()})
            keep = np.flatnonzero((length > 1) & (split | (length <= HOT)))
            w = {c: x[keep] for c, x in v.items()}
            for i, j in _candidates(w["cell"], w["n"], w["at"], w["f"], w["g"], t):
                if split:
                    other = (w["part"][i] != w["part"][j]) | (w["part"][i] < 0)
                    i, j = i[other], j[other]
                if len(i):
                    yield out(ids.take(pa.array(keep[i])), ids.take(pa.array(keep[j])), None)

        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if hot is not None:  # the rest of a word that is already known to be hot
                cells = table.column("cell").to_numpy()
                end = int(np.searchsorted(cells != hot, True)) if (cells == hot).any() else 0
                if end:
                    v = {c: table.column(c).slice(0, end).to_numpy().astype(np.int64) for c in ("cell", "n", "at", "f", "g")}
                    ids = table.column("_id").slice(0, end).combine_chunks()
                    yield out(ids, ids, v)
                table = table.slice(end)
                if not table.num_rows:
                    continue
                hot = None
            if left is not None:
                table = pa.concat_tables([left, table])
            cells = table.column("cell").to_numpy()
            last = len(cells) - int(np.argmax(cells[::-1] != cells[-1])) if (cells != cells[-1]).any() else 0
            if last:
                yield from work(table.slice(0, last))
            left = table.slice(last)
            if not split and left.num_rows > HOT:
                hot = int(cells[-1])
                yield from work(left)
                left = None
        if left is not None:
            yield from work(left)

    return words.mapInArrow(run, f"a {kind}, b {kind}, hot boolean, cell long, n long, at long, f long, g long")


def candidate_pairs(heads: DataFrame, kind: str, t: float) -> DataFrame:
    """Distinct (a, b) of the texts that share a word and may be similar, in no order."""
    words = heads.select("_id", "n", "f", "g", F.posexplode(F.slice("words", 1, F.col("lead"))).alias("at", "cell")).select("cell", "_id", "n", "at", "f", "g", F.lit(-1).alias("part"))
    found = stored(_paired(words.repartition("cell").sortWithinPartitions("cell", "n"), kind, t, False), "words")
    pairs = found.where(~F.col("hot")).select("a", "b")
    hot = found.where("hot").select("cell", F.col("a").alias("_id"), "n", "at", "f", "g")
    if not hot.isEmpty():
        parts = hot.groupBy("cell").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
        own = hot.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("_id", "cell"), F.col("parts")).cast("int"))
        each = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        low, high = F.least("part", "with"), F.greatest("part", "with")
        cells = each.select(F.xxhash64("cell", low, high).alias("cell"), "_id", "n", "at", "f", "g", F.when(low == high, F.lit(-1)).otherwise(F.col("part")).alias("part"))
        pairs = pairs.unionByName(_paired(cells.repartition("cell").sortWithinPartitions("cell", "n"), kind, t, True).select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_pairs(df: DataFrame, key: str = "content_id", text: str = "markdown", t: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class (smallest id with the same set) of every text with a sequence, and (a, b, similarity) of all similar classes."""
    rows = classes(df, key, text, t)
    members = rows.join(rows.groupBy("same", "n").agg(F.min("_id").alias("class")), ["same", "n"]).select("_id", "class", "n")
    members = stored(members, "members")
    heads = rows.join(members.where(F.col("_id") == F.col("class")).select("_id"), "_id", "left_semi")
    pairs = candidate_pairs(heads, df.schema[key].dataType.simpleString(), t)
    bits = rows.select("_id", "n", "bits")
    both = pairs.join(bits.select(F.col("_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a").join(bits.select(F.col("_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            na, nb = pdf["na"].to_numpy(), pdf["nb"].to_numpy()
            ka, kb = band(na, t), band(nb, t)
            keep = np.zeros(len(pdf), dtype=bool)
            for i, (x, y) in enumerate(zip(pdf["ba"], pdf["bb"])):
                k = max(ka[i], kb[i])
                width = lambda j: 8 * max(1, math.ceil(2 * (1 / t) ** (j + 1) / 64))
                sx = x[: width(k)] if ka[i] == k else x[width(k - 1) :]
                sy = y[: width(k)] if kb[i] == k else y[width(k - 1) :]
                apart = (int.from_bytes(sx, "little") ^ int.from_bytes(sy, "little")).bit_count()
                keep[i] = apart <= (1 - t) / (1 + t) * (na[i] + nb[i])
            yield pdf.loc[keep, ["a", "b"]]

    kind = df.schema[key].dataType.simpleString()
    left = stored(both.mapInPandas(close, f"a {kind}, b {kind}"), "close")
    wanted = left.select(F.col("a").alias("_id")).unionByName(left.select(F.col("b").alias("_id"))).distinct()
    sets = stored(_sets(df.join(wanted.withColumnRenamed("_id", key), key, "left_semi"), key, text), "sets")
    full = left.join(sets.select(F.col("_id").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("_id").alias("b"), F.col("elements").alias("eb")), "b")
    shared = F.size(F.array_intersect("ea", "eb"))
    links = full.select("a", "b", (shared / (F.size("ea") + F.size("eb") - shared)).alias("similarity")).where(F.col("similarity") >= t)
    return members, stored(links, "links")


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (a, b): every pair of similar texts, those with the same set included; the smaller id first."""
    a, b = members.select(F.col("_id").alias("x"), F.col("class").alias("a")), members.select(F.col("_id").alias("y"), F.col("class").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    twins = members.groupBy("class").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("class")
    same = members.join(twins, "class", "left_semi")
    within = same.select("class", F.col("_id").alias("a")).join(same.select("class", F.col("_id").alias("b")), "class").where(F.col("a") < F.col("b")).select("a", "b")
    return across.unionByName(within)


def components(links: DataFrame) -> DataFrame:
    """Rows (class, group): the smallest class that can be reached over links, for every class with a link. Rounds of hooking and halving, each written, until nothing changes."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    state = stored(edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("g")), "state")
    while True:
        seen = edges.join(state.select(F.col("a").alias("b"), F.col("g").alias("gb")), "b").groupBy("a").agg(F.min("gb").alias("gb"))
        step = state.join(seen, "a").select("a", F.least("g", "gb").alias("g"), F.col("g").alias("before"))
        jump = step.join(state.select(F.col("a").alias("g"), F.col("g").alias("far")), "g", "left").select("a", F.least("g", F.coalesce("far", "g")).alias("g"), "before")
        jump = stored(jump, "state")
        changed = not jump.where(F.col("g") < F.col("before")).isEmpty()
        state = jump.select("a", "g")
        if not changed:
            return state.select(F.col("a").alias("class"), F.col("g").alias("group"))


def groups(df: DataFrame, key: str = "content_id", text: str = "markdown", t: float = 0.6) -> DataFrame:
    """Rows (*key*, class_id, group_id, links): one for every row of *df*.

    class_id is the smallest id with the same set of sequences, group_id the
    smallest id that links lead to, links the number of other classes that are
    similar.  Null, empty and very short texts (no sequence) are classes and
    groups of their own.  Extra columns are ignored.
    """
    members, links = similar_pairs(df, key, text, t)
    count = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    out = df.select(F.col(key).alias("_id")).join(members.select("_id", "class"), "_id", "left").withColumn("class", F.coalesce("class", "_id"))
    out = out.join(components(links), "class", "left").join(count, "class", "left")
    return out.select(F.col("_id").alias(key), F.col("class").alias("class_id"), F.coalesce("group", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
