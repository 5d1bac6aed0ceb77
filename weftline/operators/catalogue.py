"""What surrounds the documents: totals, listings, manifests, states that a run resumes from, payloads for indexes and hooks."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as fu
from .store import cut

#: Bytes from which a folder's size is noted, and growth between two looks that is a spike.
SIZE_MARKS, SPIKE = (1 << 30, 5 << 30, 10 << 30), 500 << 20
#: Fields of points that searches filter by.
FILTER_FIELDS = ("url", "domain", "source_type", "language", "file_path", "last_modified", "git_branch", "content_hash", "external_id")


# -- totals --------------------------------------------------------------------

def crawl_totals(pages: DataFrame, ok: str = "error IS NULL", excluded: str = "false", elapsed: str = "elapsed_ms") -> DataFrame:
    """One row (ok, errors, excluded, elapsed_ms) of a crawl's pages."""
    out = F.expr(excluded)
    good = F.expr(ok)
    return pages.agg(F.count_if(good & ~out).alias("ok"), F.count_if(~good & ~out).alias("errors"), F.count_if(out).alias("excluded"), F.coalesce(F.sum(elapsed), F.lit(0)).alias("elapsed_ms"))


def session_counters(jobs: DataFrame, *measures: str, failed: str = "error IS NOT NULL") -> DataFrame:
    """One row (jobs, failed, sum and whole-number average of each measure over the jobs that didn't fail; 0 where there are none)."""
    good = ~F.coalesce(F.expr(failed), F.lit(False))
    n = F.count_if(good)
    sums = {m: F.coalesce(F.sum(F.when(good, F.col(m))), F.lit(0)).cast("long") for m in measures}
    averages = [F.when(n > 0, F.floor(v / F.greatest(n, F.lit(1)))).otherwise(0).cast("long").alias(f"avg_{m}") for m, v in sums.items()]
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(~good).alias("failed"), *[v.alias(f"total_{m}") for m, v in sums.items()], *averages)


def refresh_summary(old: DataFrame, new: DataFrame, key: str, digest: str, failed: str = "false") -> DataFrame:
    """Rows (outcome, n): updated, unchanged, failed or skipped (known, but not fetched again) by one full outer join of digests."""
    a = old.select(F.col(key).alias("_k"), F.col(digest).alias("_o"), F.lit(True).alias("_a"))
    b = new.select(F.col(key).alias("_k"), F.col(digest).alias("_n"), F.expr(failed).alias("_f"), F.lit(True).alias("_b"))
    outcome = F.when(F.col("_b").isNull(), "skipped").when(F.coalesce("_f", F.lit(False)), "failed").when(F.col("_a").isNotNull() & F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("updated")
    return a.join(b, "_k", "full_outer").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def folder_sizes(files: DataFrame, folder: str = "folder", length: str = "length") -> DataFrame:
    """Rows (folder, files, bytes, mark): the size of each folder and the number of the size marks it has reached."""
    total = F.coalesce(F.sum(length), F.lit(0))
    mark = F.lit(0)
    for m in SIZE_MARKS:
        mark = mark + (total >= m).cast("int")
    return files.groupBy(folder).agg(F.count("*").alias("files"), total.alias("bytes"), mark.alias("mark"))


def size_events(looks: DataFrame, folder: str = "folder", at: str = "at", size: str = "bytes") -> DataFrame:
    """Rows (folder, at, bytes, grown, event): looks at which a folder passed a size mark (mark) or grew by more than a spike (spike)."""
    w = Window.partitionBy(folder).orderBy(at)
    before = F.lag(size).over(w)
    passed = F.lit(False)
    for m in SIZE_MARKS:
        passed = passed | ((F.col(size) >= m) & (F.coalesce(F.col("_before"), F.lit(0)) < m))
    rows = looks.withColumn("_before", before)
    event = F.when(F.col(size) - F.col("_before") > SPIKE, "spike").when(passed, "mark")
    return rows.select(folder, at, size, (F.col(size) - F.coalesce("_before", F.lit(0))).alias("grown"), event.alias("event")).where(F.col("event").isNotNull())


# -- listings ------------------------------------------------------------------

def document_paths(df: DataFrame, url: str = "url") -> DataFrame:
    """*df* with its store key (path) and the key's domain, in the order of the path; rows without a host have none and go."""
    return df.withColumns({"path": fu.store_key(F.col(url)), "store_domain": fu.store_domain(F.col(url))}).where(F.col("path").isNotNull()).orderBy("path", url)


def page_of(df: DataFrame, order: list[str], page: int = 0, size: int = 50) -> DataFrame:
    """One page of a listing: the rows after page x size in a total order. Only the rows up to its end are kept while sorting."""
    return df.orderBy(*order).offset(page * size).limit(size)


def manifest(docs: DataFrame, url: str = "url", title: str = "title", words: str = "word_count", at: str = "fetched_at") -> DataFrame:
    """Rows (domain, documents, words, last_fetched, digest): a catalogue whose digest changes if and only if any of a domain's entries does (up to collisions of 64 bits)."""
    entry = F.xxhash64(url, F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(words), F.lit(-1)), F.col(at))
    # A sum of hashes doesn't depend on the order; it is kept below overflow by its halves.
    low, high = F.sum(F.pmod(entry, F.lit(1 << 31))), F.sum(F.pmod(F.shiftright(entry, 31), F.lit(1 << 31)))
    return docs.groupBy(fu.store_domain(F.col(url)).alias("domain")).agg(F.count("*").alias("documents"), F.sum(words).alias("words"), F.max(at).alias("last_fetched"), F.sha2(F.concat_ws(":", low.cast("string"), high.cast("string")), 256).alias("digest"))


def sanitised(docs: DataFrame, url: str = "url", dropped: tuple[str, ...] = ("raw_html", "file_path", "search_query")) -> DataFrame:
    """Documents as the store keeps them: the query of the URL is cut, fields of one fetch become null."""
    out = docs.withColumn(url, F.regexp_replace(url, r"\?[^#]*", ""))
    return out.withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in dropped if c in docs.columns})


# -- writing and resuming ------------------------------------------------------

def changed_only(batch: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (of *batch*, outcome): New and Changed ones are to be written; a value equal byte for byte is Unchanged and left out."""
    old = current.select(F.col(key), F.sha2(F.col(value), 256).alias("_old"), F.lit(True).alias("_known"))
    j = batch.join(old, key, "left")
    outcome = F.when(F.col("_known").isNull(), "New").when(~F.col("_old").eqNullSafe(F.sha2(F.col(value), 256)), "Changed")
    return j.withColumn("outcome", outcome).where(F.col("outcome").isNotNull()).drop("_old", "_known")


def dead_letters(jobs: DataFrame, folder: str, error: str = "error", records_per_file: int = 100_000) -> int:
    """Append the failed jobs as JSON lines, in files of a bounded number of records; the number of them."""
    bad = jobs.where(F.col(error).isNotNull()).withColumn("failed_at", F.current_timestamp())
    n = bad.count()
    if n:
        bad.write.mode("append").option("maxRecordsPerFile", records_per_file).json(folder)
    return n


def save_crawl(visited: DataFrame, frontier: DataFrame, folder: str) -> None:
    """What a crawl resumes from, as two tables; a second save goes beside the first and counts from when it is whole."""
    for name, df in (("visited", visited), ("frontier", frontier)):
        cut(df, f"crawl-{name}").write.mode("overwrite").parquet(f"{folder}/{name}")


def load_crawl(spark, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(visited, frontier) of a saved crawl; None where none was saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/frontier/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{folder}/visited"), spark.read.parquet(f"{folder}/frontier")


def redirect_chains(starts: DataFrame, redirects: DataFrame, most: int = 10) -> DataFrame:
    """Rows (url, final, hops, valid, reason): where redirects (source, target) lead, at most *most* hops; every address on the way must be public.

    One join a hop, of the addresses that still move; a loop ends as too many hops.
    """
    state = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("hops")).distinct()
    moves = redirects.select(F.col("source").alias("final"), F.col("target")).groupBy("final").agg(F.min("target").alias("target"))
    done: DataFrame | None = None
    for _ in range(most):
        judged = state.withColumn("valid", fu.is_public(F.col("final")))
        step = cut(judged.join(moves, "final", "left"), "hops")
        ended = step.where(~F.col("valid") | F.col("target").isNull()).select("url", "final", "hops", "valid", F.when(~F.col("valid"), "not public").alias("reason"))
        done = ended if done is None else done.unionByName(ended)
        state = step.where(F.col("valid") & F.col("target").isNotNull()).select("url", F.col("target").alias("final"), (F.col("hops") + 1).alias("hops"))
        if state.isEmpty():
            return done
    moving = cut(state.join(moves, "final", "left"), "hops")
    over = F.col("target").isNotNull()
    last = moving.select("url", "final", "hops", (fu.is_public(F.col("final")) & ~over).alias("valid"), F.when(over, "too many hops").when(~fu.is_public(F.col("final")), "not public").alias("reason"))
    return done.unionByName(last)


# -- points --------------------------------------------------------------------

def point_payloads(chunks: DataFrame, documents: DataFrame, key: str = "url") -> DataFrame:
    """Payloads of points: every chunk with the flat fields of its document; the chunk's own fields win. A chunk without its document keeps nulls."""
    own = set(chunks.columns) - {key}
    wanted = [c for c in ("title", "author", "published_date", "language", "source_type", "content_hash", "technologies", "is_truncated", "file_path", "last_modified", "git_branch", "external_id", "seed_url", "crawl_depth") if c in documents.columns and c not in own]
    out = chunks.join(documents.select(key, *wanted).dropDuplicates([key]), key, "left")
    return out.withColumn("domain", F.coalesce(F.col("domain") if "domain" in own else F.lit(None), fu.host(F.col(key)), F.lit("")))


def write_points(points: DataFrame, folder: str, buckets: int = 64) -> None:
    """Points laid out for the fields that searches filter by: files by hash of the URL, sorted within, so that statistics skip row groups."""
    fields = [c for c in FILTER_FIELDS if c in points.columns]
    points.repartition(buckets, "url").sortWithinPartitions(*fields).write.mode("append").parquet(folder)


def existence(wanted: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (*keys*, state): Exists or NotIndexed; a fault of the point table raises, it is never taken for absence."""
    return wanted.join(points.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left").select(*keys, F.when(F.col("_there"), "Exists").otherwise("NotIndexed").alias("state"))


def git_branch(folder: str) -> str | None:
    """The branch of the working tree that a folder lies in; None outside one and on a detached head. A relative gitdir is followed, an absolute one is not."""
    at = os.path.abspath(folder)
    while True:
        mark = os.path.join(at, ".git")
        if os.path.isfile(mark):
            with open(mark, encoding="utf-8") as f:
                m = re.match(r"gitdir:\s*(\S.*)", f.read())
            if not m or os.path.isabs(m.group(1).strip()):
                return None
            mark = os.path.normpath(os.path.join(at, m.group(1).strip()))
        if os.path.isfile(os.path.join(mark, "HEAD")):
            with open(os.path.join(mark, "HEAD"), encoding="utf-8") as f:
                m = re.match(r"ref:\s*refs/heads/(\S+)", f.read())
            return m.group(1) if m else None
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


# -- hooks ---------------------------------------------------------------------

def hook_payload(url: Column, kind: str, title: Column, lines: Column) -> Column:
    """The message that tells a hook of a change: in the form of chat services, or plain."""
    text = F.concat(title, F.lit("\n"), F.array_join(F.slice(lines, 1, 20), "\n"))
    chat, board = url.rlike(r"^https://(?:[\w-]+\.)?discord(?:app)?\.com/api/webhooks/"), url.rlike(r"^https://hooks\.slack\.com/")
    embed = F.to_json(F.struct(F.array(F.struct(title.alias("title"), F.array_join(lines, "\n").alias("description"))).alias("embeds")))
    return F.when(chat, embed).when(board, F.to_json(F.struct(text.alias("text")))).otherwise(F.to_json(F.struct(F.lit(kind).alias("event"), title.alias("title"), lines.alias("changes"))))
