"""Vectors: exact search in blocks, truncation, point identities, a deterministic embedder."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A fixed namespace, so that point ids stay the same over restarts.
NAMESPACE = uuid.UUID("6f6b1f0a-2b0e-5b52-9d53-0f5d2c7a9e11")
#: Bytes of query vectors that are sent to every task at once, and queries that are compared at once.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def truncate(vector: Column, dims: int) -> Column:
    """The first dimensions, not normalised again."""
    return F.slice(vector, 1, dims)


def knn(points: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, key, score, rank): the k points of largest dot product for each query; ties go to the smaller key.

    *queries* (query_id, vector) are a stated query set.  As many as QUERY_BYTES
    hold are sent to every task at once and compared in blocks; points are read
    once for these, and each task keeps its own k best, so what is shuffled is
    tasks x queries x k rows, whatever the number of points.  Null vectors take no part.
    """
    kind, asked = points.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    some = queries.where(F.col("vector").isNotNull())
    size = some.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    share = max(1, QUERY_BYTES // (8 * max(1, size["d"] or 1)))
    parts = []
    for block in range(-(-size["n"] // share)):
        of = some if size["n"] <= share else some.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-size["n"] // share))) == block)
        rows = sorted(of.select("query_id", "vector").collect())
        if not rows:
            continue
        names = np.array([r["query_id"] for r in rows])
        sent = points.sparkSession.sparkContext.broadcast((names, np.array([r["vector"] for r in rows], dtype=np.float64)))

        def best(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, matrix = sent.value
            held: dict[int, pd.DataFrame] = {}
            for pdf in frames:
                pdf = pdf[pdf["v"].notna()]
                if not len(pdf):
                    continue
                own, keys = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["p"].to_numpy()
                for at in range(0, len(names), QUERY_BLOCK):
                    scores = own @ matrix[at : at + QUERY_BLOCK].T
                    n = min(k, len(keys))
                    top = np.lexsort((np.broadcast_to(keys[:, None], scores.shape), -scores), axis=0)[:n]
                    found = pd.DataFrame({"query_id": np.repeat(names[at : at + QUERY_BLOCK], n), "p": keys[top.T.ravel()], "score": scores[top.T.ravel(), np.repeat(np.arange(scores.shape[1]), n)]})
                    held[at] = found if at not in held else pd.concat([held[at], found]).sort_values(["query_id", "score", "p"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
            yield from held.values()

        parts.append(points.select(F.col(key).alias("p"), F.col(vector).alias("v")).mapInPandas(best, f"query_id {asked}, p {kind}, score double"))
    if not parts:
        return points.select(F.lit(None).cast(asked).alias("query_id"), F.col(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "p"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("p").alias(key), "score", "rank")


@F.pandas_udf(T.StringType())
def point_id(url: pd.Series, index: pd.Series) -> pd.Series:
    """UUIDv5 of the URL and chunk number."""
    return pd.Series([None if u is None or pd.isna(i) else str(uuid.uuid5(NAMESPACE, f"{u}#chunk{int(i)}")) for u, i in zip(url, index)])


@F.pandas_udf(T.StringType())
def file_hash(data: pd.Series) -> pd.Series:
    """XXH3-64 in hexadecimal (Spark's xxhash64 is another function)."""
    import xxhash

    return pd.Series([None if d is None else xxhash.xxh3_64_hexdigest(d) for d in data])


def embed(texts: list[str], dims: int = 64) -> np.ndarray:
    """Deterministic unit vectors from hashed words: a stand-in for a model where none is at hand."""
    out = np.zeros((len(texts), dims), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dims] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out[i])
        out[i] /= n if n else 1.0
    return out


def embed_column(df: DataFrame, text: str, out: str = "vector", provider=embed) -> DataFrame:
    """*df* with a vector of each text; the provider sees batches, order is kept within a batch."""

    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(embed_batches(t.fillna("").tolist(), provider))

    return df.withColumn(out, run(F.col(text)))


class TooLarge(Exception):
    """A provider's answer to a batch that is too large for it."""


class Busy(Exception):
    """A provider's answer when it should be asked again later."""


def embed_batches(texts: list[str], provider, size: int = 96, tries: int = 3, wait: float = 0.2, most_wait: float = 2.0) -> list:
    """Vectors of texts in their order: batches of *size*; one that is too large is halved, a busy provider asked again after doubling waits.

    A single text that is too large, a provider that stays busy, and an answer of
    another number of vectors raise.
    """
    out: list = []
    todo = [texts[i : i + size] for i in range(0, len(texts), size)][::-1]
    while todo:
        batch = todo.pop()
        for k in range(tries + 1):
            try:
                found = list(provider(batch))
            except TooLarge:
                if len(batch) < 2:
                    raise
                middle = len(batch) // 2
                todo += [batch[middle:], batch[:middle]]
                break
            except Busy:
                if k == tries:
                    raise
                time.sleep(min(most_wait, wait * 2**k))
                continue
            if len(found) != len(batch):
                raise ValueError(f"{len(found)} vectors for {len(batch)} texts")
            out += found
            break
    return out


def query_text(instruction: str, query: Column) -> Column:
    """The form in which instruction-tuned embedders want queries (documents are embedded as they are)."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query)
