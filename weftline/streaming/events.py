"""Events of files and runs: changes between listings, debounced; states of crawls, alerts with a pause, log tails, heartbeats, orderly ends."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (path, change, old_path) of two listings (path, length, modified, digest): created, modified, removed or renamed.

    A file that went and one that came with the same digest are one renamed file,
    paired in the order of their paths; digests may be null, which pairs nothing.
    """
    a = before.select("path", F.struct("length", "modified", "digest").alias("_a"))
    b = after.select("path", F.struct("length", "modified", "digest").alias("_b"))
    j = a.join(b, "path", "full_outer")
    went = j.where(F.col("_b").isNull()).select(F.col("path").alias("old_path"), F.col("_a.digest").alias("digest"))
    came = j.where(F.col("_a").isNull()).select("path", F.col("_b.digest").alias("digest"))
    kept = j.where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).select("path", F.lit("modified").alias("change"), F.lit(None).cast("string").alias("old_path"))
    rank = lambda c: F.row_number().over(Window.partitionBy("digest").orderBy(c))
    went, came = went.withColumn("_n", rank("old_path")), came.withColumn("_n", rank("path"))
    both = came.join(went, ["digest", "_n"], "full_outer")
    change = F.when(F.col("old_path").isNull(), "created").when(F.col("path").isNull(), "removed").otherwise("renamed")
    return kept.unionByName(both.select(F.coalesce("path", "old_path").alias("path"), change.alias("change"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path")))


def index_jobs(changes: DataFrame) -> DataFrame:
    """Rows (path, job) of changes: a removed file is deleted, a renamed one deleted under its old path and indexed under its new one."""
    jobs = F.when(F.col("change") == "removed", F.array(F.struct("path", F.lit("delete").alias("job")))).when(F.col("change") == "renamed", F.array(F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("job")), F.struct("path", F.lit("index").alias("job"))))
    return changes.select(F.explode(jobs.otherwise(F.array(F.struct("path", F.lit("index").alias("job"))))).alias("j")).select("j.path", "j.job")


def debounced(events: DataFrame, quiet_ms: int = 500, key: str = "path", at: str = "at", kind: str = "kind") -> DataFrame:
    """Rows (path, kind, at) of a stream of file events: the last event of each file after which it was quiet for *quiet_ms* of event time."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None  # (kind, milliseconds)
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((name[0], last[0], pd.Timestamp(last[1], unit="ms")))
            state.remove()
        else:
            rows = sorted((t.value // 1_000_000, k) for pdf in frames for t, k in zip(pdf["at"], pdf["kind"]))
            for ms, what in rows:
                if last is not None and ms - last[1] > quiet_ms:
                    out.append((name[0], last[0], pd.Timestamp(last[1], unit="ms")))
                if last is None or ms >= last[1]:
                    last = (what, ms)
            state.update(last)
            state.setTimeoutTimestamp(max(last[1] + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "kind", "at"])

    rows = events.select(F.col(key).alias("path"), F.col(at).alias("at"), F.col(kind).alias("kind")).withWatermark("at", f"{quiet_ms} milliseconds")
    return rows.groupBy("path").applyInPandasWithState(step, "path string, kind string, at timestamp", "kind string, ms long", "append", GroupStateTimeout.EventTimeTimeout)


def crawl_state(phase: Column, pid: Column, live: Column) -> Column:
    """NeverStarted, Done, Running, or Stale where the record says running but its process (pid) isn't among the live ones (array)."""
    return F.when(phase.isNull(), "NeverStarted").when(phase == "done", "Done").when((phase == "running") & F.coalesce(F.array_contains(live, pid), F.lit(False)), "Running").otherwise("Stale")


def alerts_with_pause(alerts: DataFrame, at: str = "since", pause_s: int = 300, key: str | None = None) -> DataFrame:
    """Of a stream of alerts those that come at least *pause_s* seconds after the last one that went out, for each key."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for pdf in frames for t in pdf["at"]):
            ms = t.value // 1_000_000
            if last is None or ms - last >= 1000 * pause_s:
                out.append((name[0], t))
                last = ms
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at"])

    rows = alerts.select((F.col(key) if key else F.lit("")).cast("string").alias("key"), F.col(at).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, at timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def log_tail(lines: DataFrame, most: int = 50, level: str | None = None, order: tuple[str, ...] = ("at", "line_no")) -> DataFrame:
    """The last *most* lines of a log in a total order, of one level if given; only these are kept while sorting."""
    some = lines.where(F.upper("level") == level.upper()) if level else lines
    return some.orderBy(*[F.desc(c) for c in order]).limit(most).orderBy(*order)


class Heartbeat(StreamingQueryListener):
    """Tells *beat* how far each query is, at most once in *every* seconds, and when it ends."""

    def __init__(self, beat: Callable[[dict], None], every: float = 60.0):
        self.beat, self.every = beat, every
        self.last: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.beat({"query": str(event.id), "state": "started"})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p, now = event.progress, time.monotonic()
        if now - self.last.get(str(p.id), float("-inf")) >= self.every:
            self.last[str(p.id)] = now
            self.beat({"query": str(p.id), "state": "running", "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.beat({"query": str(event.id), "state": "failed" if event.exception else "ended"})


def drain(query: StreamingQuery, seconds: float = 10.0) -> bool:
    """Let a query work through what is there, for so long at most, and stop it; whether it got through."""
    end = time.monotonic() + seconds
    through = False
    while query.isActive and time.monotonic() < end:
        state = query.status
        if not state["isDataAvailable"] and not state["isTriggerActive"]:
            through = True
            break
        time.sleep(0.05)
    query.stop()
    return through
