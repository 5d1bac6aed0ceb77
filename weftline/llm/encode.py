"""Problem 8: the whole corpus as token ids of a public byte-level vocabulary, by speculation and verification (see :mod:`.bpe`)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import slices


def encode_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Rows (*key*, ids array<int>): the token ids of each text, without special tokens.

    Null and empty texts give an empty list.  Rows are kept one for one (repeated
    rows stay repeated, an empty table gives none); other columns, whatever their
    names, are ignored.  Texts of any length are taken whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                ids, offsets = own.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(ids.astype("int32")))], names=["_key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Rows (*key*, text): the text of each list of token ids; an empty list gives an empty text, null gives null. The inverse of :func:`encode_ids` for texts that aren't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary).bytes_of
        for batch in batches:
            texts = [None if row is None else b"".join(map(known.__getitem__, row)).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)
