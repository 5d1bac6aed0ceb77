"""Relational operators over documents: duplicates, differences, versions, search by words, catalogue."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import urls as fu


_HEADING = re.compile(r"^#{1,3} +([^\n]*)", re.M)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (ties are decided by *order*, so it must be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (content_hash, copies, first): texts that occur more than once. Hashes are grouped, not texts; null texts don't count."""
    return df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where(F.col("copies") > 1)


def links_of(df: DataFrame, key: str, links: str = "links") -> DataFrame:
    """Rows (key, pos, text, href)."""
    return df.select(key, F.posexplode(links).alias("pos", "_l")).select(key, "pos", F.col("_l.text").alias("text"), F.col("_l.href").alias("href"))


def link_changes(old: DataFrame, new: DataFrame, key: str, links: str = "links") -> DataFrame:
    """Rows (key, change, href): links of a page added in *new* or removed since *old*; by href, duplicates kept, texts ignored."""
    a, b = links_of(old, key, links).select(key, "href"), links_of(new, key, links).select(key, "href")
    return b.join(a, [key, "href"], "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, [key, "href"], "left_anti").withColumn("change", F.lit("removed"))).select(key, "change", "href")


def snapshot_status(old: DataFrame, new: DataFrame, key: str, compared: list[str], words: str = "word_count") -> DataFrame:
    """Rows (key, status, word_count_delta, changed array<string>) of a full outer join: New, Removed, Changed or Same. Nulls equal nulls."""
    a = old.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"_o_{c}") for c in {*compared, words}])
    b = new.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"_n_{c}") for c in {*compared, words}])
    j = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), F.lit(c)) for c in sorted(compared)]))
    delta = F.coalesce(F.col(f"_n_{words}"), F.lit(0)) - F.coalesce(F.col(f"_o_{words}"), F.lit(0))
    status = F.when(F.col("_a").isNull(), "New").when(F.col("_b").isNull(), "Removed").when((F.size(changed) > 0) | (delta != 0), "Changed").otherwise("Same")
    return j.select(key, status.alias("status"), delta.cast("long").alias("word_count_delta"), F.array_join(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), changed).otherwise(F.array().cast("array<string>")), ",").alias("changed"))


def versions_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """*df* with version (from 1) and versions (how many its key has). Rows without a key are no versions of each other and go."""
    w = Window.partitionBy(key)
    return df.where(F.col(key).isNotNull()).withColumn("version", F.row_number().over(w.orderBy(*order))).withColumn("versions", F.count("*").over(w))


def link_history(df: DataFrame, key: str, order: list[str], links: str = "links") -> DataFrame:
    """Rows (key, version, change, href): :func:`link_changes` of every version since the one before it."""
    v = versions_of(df.select(key, *order, links), key, order)
    page = lambda n: F.struct(key, n.alias("version")).alias("_page")
    old = v.where(F.col("version") < F.col("versions")).select(page(F.col("version") + 1), links)
    new = v.where(F.col("version") > 1).select(page(F.col("version")), links)
    return link_changes(old, new, "_page", links).select(f"_page.{key}", "_page.version", "change", "href")


def snapshot_history(df: DataFrame, key: str, order: list[str], compared: list[str], words: str = "word_count") -> DataFrame:
    """Rows (key, version, status, word_count_delta, changed): every version against the one before it; the first is New. Nulls equal nulls; texts are compared by digest."""
    marks = df.where(F.col(key).isNotNull()).select(key, *order, F.coalesce(words, F.lit(0)).alias("_words"), *[F.sha2(F.col(c).cast("string"), 256).alias(f"_d_{c}") for c in compared])
    w = Window.partitionBy(key).orderBy(*order)
    v = marks.withColumn("version", F.row_number().over(w)).withColumn("_before", F.lag(F.struct("_words", *[f"_d_{c}" for c in compared])).over(w))
    first = F.col("version") == 1
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_d_{c}").eqNullSafe(F.col(f"_before._d_{c}")), F.lit(c)) for c in sorted(compared)]))
    delta = F.col("_words") - F.coalesce(F.col("_before._words"), F.lit(0))
    status = F.when(first, "New").when((F.size(changed) > 0) | (delta != 0), "Changed").otherwise("Same")
    return v.select(key, "version", status.alias("status"), delta.cast("long").alias("word_count_delta"), F.when(first, "").otherwise(F.array_join(changed, ",")).alias("changed"))


def grep(df: DataFrame, key: str, text: str, pattern: str, width: int | None = 120) -> DataFrame:
    """Rows (key, line_no from 1, line) that match; without capitals in the pattern, case doesn't matter. Lines are shown up to *width* characters."""
    smart = pattern if any(c.isupper() for c in pattern) else f"(?i){pattern}"
    lines = df.where(F.col(text).rlike(f"(?m){smart}")).select(key, F.posexplode(F.split(text, "\n", -1)).alias("_p", "line"))
    return lines.where(F.col("line").rlike(smart)).select(key, (F.col("_p") + 1).alias("line_no"), (F.substring("line", 1, width) if width else F.col("line")).alias("line"))


def top_scored(df: DataFrame, query: str, n: int, url: str = "url", title: str = "title") -> DataFrame:
    """The n best documents for a query: number of query words among the tokens of URL and title, then plain pages first, then shorter URLs, then the URL.

    The query is split at white space only, so words with other signs never match. A query of stop words gives nothing.
    """
    terms = [t for t in query.lower().split() if t not in ft.STOP_WORDS]
    known = F.array_union(ft.tokens(F.col(url)), ft.tokens(F.col(title)))
    score = F.lit(0)
    for t in terms:
        score = score + F.array_contains(known, t).cast("int")
    path = F.regexp_replace(url, r"\?.*$", "")
    penalty = F.when(path.rlike(r"/(LICENSE|README\.md|CHANGELOG\.md|CHANGELOG)$"), 2).when(path.endswith("all.html"), 1).otherwise(0)
    best = df.select(F.col(url), F.col(title), score.alias("score"), penalty.alias("penalty")).where(F.col("score") > 0)
    return best.orderBy(F.desc("score"), "penalty", F.octet_length(url), url, title).limit(n)


def heading_as_of(chunks: DataFrame, headings: DataFrame, key: str, offset: str = "char_offset") -> DataFrame:
    """*chunks* with the nearest heading at or before their offset: one window over the union, no range join. *headings* has (key, offset, title)."""
    both = chunks.withColumn("_h", F.lit(None).cast("string")).withColumn("_kind", F.lit(1)).unionByName(headings.select(key, F.col("offset").alias(offset), F.col("title").alias("_h")).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(offset, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("heading", F.last("_h", ignorenulls=True).over(w)).where(F.col("_kind") == 1).drop("_h", "_kind")


def headings_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, offset in characters, title) of h1 to h3 lines; each text is read once, null ones have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, m.start(), m.group(1).strip(" ")) for k, t in zip(pdf["_key"], pdf["_text"]) if t for m in _HEADING.finditer(t)]
            yield pd.DataFrame(rows, columns=["_key", "offset", "title"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.contains(text, F.lit("#"))).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInPandas(run, f"_key {kind}, offset long, title string").withColumnRenamed("_key", key)


def not_indexed(files: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose (url, hash) no point has: what a start has to index."""
    return files.join(points.select(*keys).distinct(), keys, "left_anti")


def upsert(current: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins by key: one aggregation over the union, so a batch may repeat keys. Ties go to the batch."""
    both = current.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*[F.col(c) for c in both.columns if c != "_b"])
    return both.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(version, "_b")).alias("_r")).select("_r.*")


def without_stale(points: DataFrame, kept: DataFrame, url: str, key: str) -> DataFrame:
    """Points of the URLs in *kept* that are not among its keys are stale and go; other URLs stay. Apply after the upsert."""
    touched = kept.select(url).distinct()
    stale = points.join(touched, url, "left_semi").join(kept.select(url, key), [url, key], "left_anti").select(key)
    return points.join(stale, key, "left_anti")


def domains(df: DataFrame, url: str) -> DataFrame:
    """Rows (domain, documents, first_url): the catalogue by host without www."""
    return df.groupBy(F.regexp_replace(fu.host(F.col(url)), r"^www\.", "").alias("domain")).agg(F.count("*").alias("documents"), F.min(url).alias("first_url"))


def cap_history(df: DataFrame, key: str, order: list[str], cap: int = 100) -> DataFrame:
    """The first entry of each key and the newest cap - 1, ranks from both ends; a hot key's history is sorted, never gathered in an array."""
    up = Window.partitionBy(key).orderBy(*order)
    down = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down)).where((F.col("_u") == 1) | (F.col("_d") <= cap - 1)).drop("_u", "_d")


def dedup_blocks(df: DataFrame, key: str, text: str, floor: int = 20) -> DataFrame:
    """Rows (key, text): each text without blocks (split at blank lines) that repeat an earlier one, of at least *floor* bytes; shorter blocks stay. Null texts go. Nothing is shuffled."""
    # Short blocks are marked by their place, which makes them differ; the first of equal strings stays.
    marked = F.transform(F.split(text, r"\n\n+"), lambda x, i: F.when(F.octet_length(x) < floor, F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02"), x)).otherwise(x))
    kept = F.transform(F.array_distinct(marked), lambda x: F.when(x.startswith("\x01"), F.regexp_replace(x, "^\x01[0-9]+\x02", "")).otherwise(x))
    return df.where(F.col(text).isNotNull()).select(key, F.array_join(kept, "\n\n").alias(text))


def changes_over_time(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows with previous value and status New, Same or Changed."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("status", F.when(F.row_number().over(w) == 1, "New").when(F.col("previous").eqNullSafe(F.col(value)), "Same").otherwise("Changed"))


#: Suffixes of files that hold no page.
SKIP_SUFFIXES = ".pdf .png .jpg .jpeg .gif .svg .webp .ico .css .js .zip .tar .gz .xml .rss .mp3 .mp4 .avi .mov .woff .woff2 .ttf .eot".split()


def qualify_links(links: DataFrame, base_url: Column, include: list[str], exclude: list[str], visited: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """Links (column href) worth crawling: public, of the same origin, with a path that begins with *prefix*, that the globs allow and that has no file suffix, in crawl form; seen ones go by anti-join."""
    path = fu.part(F.col("href"), 4)
    suffix = "(?:" + "|".join(re.escape(x) for x in SKIP_SUFFIXES) + ")$"
    keep = fu.is_public(F.col("href")) & (fu.origin(F.col("href")) == fu.origin(base_url)) & ~F.lower(path).rlike(suffix)
    if prefix:
        keep = keep & path.startswith(prefix)
    if include:
        keep = keep & fu.glob_match(path, include)
    if exclude:
        keep = keep & ~fu.glob_match(path, exclude)
    out = links.where(keep).withColumn("href", fu.crawl_form(F.col("href")))
    return out.join(visited.select(F.col("url").alias("href")), "href", "left_anti") if visited is not None else out
