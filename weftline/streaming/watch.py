"""Incremental forms: indexing files as they come, and watching pages for changes with state by URL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import Store
from ..sources.parsers import SUFFIXES, parse_files

STATUS = "url string, seen_at timestamp, status string, previous_digest string, digest string"


def watch_pages(pages: DataFrame, url: str = "url", text: str = "markdown", at: str = "fetched_at") -> DataFrame:
    """Status of each fetch of a stream against the last one of its URL: New, Same, Changed; a failed fetch (null text) is Failed and leaves the state, so a first fetch that fails lets the next be the baseline."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for pdf in frames:
            for seen, t in pdf.sort_values("seen_at")[["seen_at", "text"]].itertuples(index=False):
                if t is None or pd.isna(t):
                    rows.append((key[0], seen, "Failed", last, None))
                    continue
                digest = hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((key[0], seen, "New" if last is None else "Same" if digest == last else "Changed", last, digest))
                last = digest
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["url", "seen_at", "status", "previous_digest", "digest"])

    rows = pages.select(F.col(url).alias("url"), F.col(at).alias("seen_at"), F.col(text).alias("text"))
    return rows.groupBy("url").applyInPandasWithState(step, STATUS, "digest string", "append", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 256) -> DataFrame:
    """Documents of files as they appear in a folder; back-pressure by files per trigger."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return parse_files(files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*SUFFIXES)))


def into_store(store: Store, key: str = "url", at: str = "fetched_at") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the last row of each key of the batch is merged into the store. A batch without rows changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            row = F.struct(*batch.columns)
            store.write(batch.groupBy(key).agg(F.max_by(row, at).alias("r")).select("r.*"), key, at)

    return write


def error_alerts(results: DataFrame, at: str = "seen_at", failed: str = "status = 'Failed'", share: float = 0.2, window: str = "5 minutes") -> DataFrame:
    """Windows in which failures reach a share of all results; late rows up to one window are counted."""
    counts = results.withWatermark(at, window).groupBy(F.window(at, window)).agg(F.count("*").alias("results"), F.sum(F.expr(f"int({failed})")).alias("failures"))
    return counts.where(F.col("failures") >= share * F.col("results")).select(F.col("window.start").alias("since"), "results", "failures")
