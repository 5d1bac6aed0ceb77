"""A versioned document store on Parquet snapshots: merge by URL, change log, operations log, pointer to the current version."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import cap_history


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge(current: DataFrame | None, batch: DataFrame, key: str = "url", at: str = "fetched_at", ignore: tuple[str, ...] = ("fetched_at",)) -> DataFrame:
    """The next snapshot: (key, fields of *batch*, first_seen, last_fetched, fetch_count, changelog).

    A new key gets a baseline entry; a known one counts up, and gets an entry where
    a field beside *ignore* changed. A batch may hold a key once only (use upsert
    before). The change log keeps its first entry and the newest 99.
    """
    fields = [c for c in batch.columns if c != key]
    compared = [c for c in fields if c not in ignore]
    entry = lambda d: F.array(F.struct(F.col(at).alias("at"), F.sha2(F.to_json(F.struct(*compared)), 256).alias("digest"), F.lit(d).alias("status")))
    fresh = batch.withColumns({"first_seen": F.col(at), "last_fetched": F.col(at), "fetch_count": F.lit(1).cast("long")}).withColumn("changelog", entry("New"))
    if current is None:
        return fresh
    new = batch.withColumn("_digest", F.sha2(F.to_json(F.struct(*compared)), 256))
    old = current.select(key, F.struct(*[c for c in current.columns if c != key]).alias("_old"))
    j = new.join(old, key, "full_outer")
    both, log = F.col("_old").isNotNull(), F.col("_old.changelog")
    changed = F.col("_digest") != F.element_at(log, -1)["digest"]
    grown = F.concat(log, F.array(F.struct(F.col(at).alias("at"), F.col("_digest").alias("digest"), F.lit("Changed").alias("status"))))
    capped = F.when(F.size(grown) > 100, F.concat(F.slice(grown, 1, 1), F.slice(grown, -99, 99))).otherwise(grown)
    here = F.col("_digest").isNotNull()
    return j.select(
        key,
        *[F.when(here, F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c) for c in fields],
        F.when(both, F.col("_old.first_seen")).otherwise(F.col(at)).alias("first_seen"),
        F.when(here, F.col(at)).otherwise(F.col("_old.last_fetched")).alias("last_fetched"),
        (F.coalesce(F.col("_old.fetch_count"), F.lit(0)) + here.cast("long")).alias("fetch_count"),
        F.when(~both, F.array(F.struct(F.col(at).alias("at"), F.col("_digest").alias("digest"), F.lit("New").alias("status")))).when(here & changed, capped).otherwise(log).alias("changelog"),
    )


def build(versions: DataFrame, order: list[str], key: str = "url", at: str = "fetched_at", ignore: tuple[str, ...] = ("fetched_at",)) -> DataFrame:
    """The snapshot that merging all *versions* of each key one after another gives, in the total order *order*.

    Columns of *order* beside *at* aren't fields of the store. Only digests are ranked; a hot key's versions are sorted, never gathered.
    """
    fields = [c for c in versions.columns if c != key and (c == at or c not in order)]
    compared = [c for c in fields if c not in ignore]
    w = Window.partitionBy(key).orderBy(*order)
    digests = versions.select(key, *order, F.sha2(F.to_json(F.struct(*compared)), 256).alias("digest"))
    before = digests.withColumn("_before", F.lag("digest").over(w))
    entries = before.where(F.col("_before").isNull() | (F.col("_before") != F.col("digest"))).withColumn("status", F.when(F.col("_before").isNull(), "New").otherwise("Changed"))
    capped = cap_history(entries, key, order, 100)
    logs = capped.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "digest", "status"))), lambda e: F.struct(e[at].alias("at"), e["digest"].alias("digest"), e["status"].alias("status"))).alias("changelog"))  # at most 100 entries
    last = versions.groupBy(key).agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("_last"),
        F.min(at).alias("first_seen"),
        F.max(at).alias("last_fetched"),
        F.count("*").alias("fetch_count"),
    )
    return last.join(logs, key).select(key, *[F.col(f"_last.{c}").alias(c) for c in fields], "first_seen", "last_fetched", "fetch_count", "changelog")


#: Bytes of a document above which it isn't stored, and of an operation's output above which a mark stands for it.
MOST_BYTES, MOST_OUTPUT = 2 << 20, 1 << 20


class Store:
    """Documents under a folder, in buckets by key; a version file lists the tables that the buckets are in.

    A write merges a batch into the buckets that it touches and puts a new version
    beside the others, which fails where another writer was first.  Tables that the
    last two versions don't list are removed.  Files go through the Hadoop file
    system, so the folder may be anywhere.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        at = self._path(f"{self.folder}/versions")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _load(self, name: str) -> dict[str, str]:
        stream = self._fs.open(self._path(f"{self.folder}/versions/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _current(self) -> dict[str, str]:
        known = self._versions()
        return self._load(known[-1]) if known else {}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, keys: list[str] | None = None, key: str = "url") -> DataFrame | None:
        """All documents, or those of some keys, for which only their buckets are read; None from an empty store."""
        tables = self._current()
        if keys is not None:
            names = self.spark.createDataFrame([(k,) for k in keys], "k string").select(self.bucket(F.col("k")).alias("b")).distinct().collect()
            tables = {str(r["b"]): tables[str(r["b"])] for r in names if str(r["b"]) in tables}
        if not tables:
            return None
        out = self.spark.read.parquet(*sorted({f"{self.folder}/{t}/bucket={b}" for b, t in tables.items()}))
        return out if keys is None else out.where(F.col(key).isin(keys))

    def write(self, batch: DataFrame, key: str = "url", at: str = "fetched_at", text: str = "markdown") -> int:
        """Merge a batch (each key once); the number of documents left out because they are too large."""
        large = F.coalesce(F.octet_length(text), F.lit(0)) > MOST_BYTES if text in batch.columns else F.lit(False)
        kept = cut(batch.where(~large), "batch")
        touched = [str(r["b"]) for r in kept.select(self.bucket(F.col(key)).alias("b")).distinct().collect()]  # at most the buckets
        known = self._versions()
        tables = self._load(known[-1]) if known else {}
        old = [f"{self.folder}/{tables[b]}/bucket={b}" for b in touched if b in tables]
        name = f"table-{uuid.uuid4().hex}"
        merged = merge(self.spark.read.parquet(*sorted(old)) if old else None, kept, key, at)
        merged.withColumn("bucket", self.bucket(F.col(key))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        self._publish(tables | dict.fromkeys(touched, name), len(known) and int(known[-1][:-5]) + 1)
        return batch.where(large).count()

    def _publish(self, tables: dict[str, str], number: int) -> None:
        stream = self._fs.create(self._path(f"{self.folder}/versions/{number:012d}.json"), False)  # fails where it exists
        try:
            stream.write(bytearray(json.dumps(tables).encode()))
        finally:
            stream.close()
        known = self._versions()
        used = {t for v in known[-2:] for t in self._load(v).values()}
        for v in known[:-2]:
            for t in set(self._load(v).values()) - used:
                self._fs.delete(self._path(f"{self.folder}/{t}"), True)
            self._fs.delete(self._path(f"{self.folder}/versions/{v}"), False)

    def log(self, entries: DataFrame) -> None:
        """Append operations (op, at, url, input, output) as JSON lines by domain; an output above 1 MiB becomes a mark."""
        big = F.octet_length("output") > MOST_OUTPUT
        entries.withColumn("output", F.when(big, F.lit('{"truncated":true}')).otherwise(F.col("output"))).withColumn("domain", F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1), F.lit(""))).write.mode("append").partitionBy("domain").json(f"{self.folder}/operations")
