"""What the operators of this subpackage share: tables, shared-folder tables, batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread
from . import bpe

#: Characters that are handed to a Python kernel at once; it bounds a worker's memory whatever the row count of an Arrow batch.
BATCH_CHARS = 3_000_000


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table; with *columns* only these, spread over the cores where it has few partitions, for a heavy kernel."""
    df = ship(spark).read.parquet(f"{folder}/{name}.parquet")
    return spread(df.select(*columns)) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where none is set (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write *df* to the shared folder and read it back: lineage is cut and lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def host(url: Column) -> Column:
    """Host of a URL in lower case without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut an Arrow batch into runs of about BATCH_CHARS characters of *column*; a longer text is a run of its own."""
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    start, chars = 0, 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if chars and chars + n > BATCH_CHARS:
            yield batch.slice(start, k - start), texts[start:k]
            start, chars = k, 0
        chars += n
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def runs(pdf: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """Cut a frame into runs of about BATCH_CHARS characters of *column*; a longer text is a run of its own."""
    size = np.cumsum(np.fromiter((len(t) if t else 0 for t in pdf[column]), np.int64, len(pdf)))
    start = 0
    while start < len(pdf):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + BATCH_CHARS, side="right")))
        yield pdf.iloc[start:stop]
        start = stop


def counter(path: str | None = None):
    """A function from texts to their token counts: the Rust encoder where installed, else this package's."""
    own = bpe.encoder(path)
    try:
        import tiktoken
    except ImportError:
        return own.count_batch
    key = path or bpe.vocabulary_path()
    if key not in _RUST:
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _RUST[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    encode = _RUST[key].encode_ordinary
    # The Rust encoder merges a single word in quadratic time, so texts with very long words take the other way.
    slow = 20_000

    def count(texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                out[k] = len(encode(text)) if len(text) < slow else own.count_batch([text])[0]
        return out

    return count


_RUST: dict = {}
