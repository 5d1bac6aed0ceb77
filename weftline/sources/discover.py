"""Finding what to fetch and index: sitemaps with their indexes, answers of search services, records of note services page by page."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators.store import cut
from .parsers import sitemaps

#: Where sitemaps are looked for beside those that robots.txt names, and how deep indexes are followed.
FALLBACKS, DEPTH = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap/sitemap-index.xml"), 3


def sitemap_sources(sites: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows (site, url): sitemaps that the robots.txt of each site (an origin) names, and the fallbacks it doesn't; *bodies* has (url, body)."""
    robots = sites.select("site", F.concat("site", F.lit("/robots.txt")).alias("url")).join(bodies, "url", "left")
    named = robots.select("site", F.explode(ft.sitemaps_of_robots(F.col("body"))).alias("url"))
    guessed = sites.select("site", F.explode(F.array(*[F.concat("site", F.lit(x)) for x in FALLBACKS])).alias("url"))
    return named.unionByName(guessed).distinct()


def discover(sites: DataFrame, bodies: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (site, url, last_modified, priority, change_freq, sitemap): pages that the sitemaps of sites list, the first of each URL by sitemap.

    Indexes are followed *depth* levels down, one join with *bodies* (url, body) a
    level; a sitemap that was read is not read again, one that can't be fetched or
    read gives nothing.
    """
    frontier = cut(sitemap_sources(sites, bodies), "sitemaps")
    seen, found = frontier, None
    for level in range(depth + 1):
        read = cut(sitemaps(frontier.select("url").distinct().join(bodies, "url"), "url", "body"), "entries")
        entries = frontier.withColumnRenamed("url", "source").join(read, "source")
        pages = entries.where(F.col("kind") == "urlset").select("site", "url", "last_modified", "priority", "change_freq", F.col("source").alias("sitemap"), F.lit(level).alias("_level"))
        found = pages if found is None else found.unionByName(pages)
        inner = entries.where(F.col("kind") == "index").select("site", "url").distinct()
        frontier = cut(inner.join(seen, ["site", "url"], "left_anti"), "sitemaps")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    rest = [c for c in found.columns if c not in ("site", "url")]
    first = found.groupBy("site", "url").agg(F.min_by(F.struct(*rest), F.struct("_level", "sitemap")).alias("_f"))
    return first.select("site", "url", *[f"_f.{c}" for c in rest if c != "_level"])


def search_results(answers: DataFrame, most: int = 10, status: str = "status", body: str = "body", query: str = "query") -> DataFrame:
    """Rows (query, rank, title, url, snippet, error) of a search service's JSON answers; one row with the error where the answer is none."""
    item = "array<struct<title:string,url:string,content:string>>"
    found = F.from_json(F.get_json_object(body, "$.results"), item)
    bad = F.when(F.col(status) == 403, "the service refuses JSON").when(~F.col(status).between(200, 299), F.concat(F.lit("status "), F.col(status).cast("string"))).when(F.try_parse_json(body).isNull(), "not JSON")
    rows = answers.select(F.col(query).alias("query"), bad.alias("error"), F.when(bad.isNull(), F.slice(F.coalesce(found, F.array().cast(item)), 1, most)).otherwise(F.array(F.lit(None).cast("struct<title:string,url:string,content:string>"))).alias("r"))
    return rows.select("query", "error", F.posexplode("r").alias("p", "x")).select("query", F.when(F.col("error").isNull(), F.col("p") + 1).alias("rank"), F.col("x.title").alias("title"), F.col("x.url").alias("url"), F.col("x.content").alias("snippet"), "error")


# -- services that hand out their records in pages ------------------------------

#: (records, what to ask for next or None) for a page; the first is asked for with None.
Asked = Callable[[str | None], tuple[list[dict], str | None]]


def all_pages(ask: Asked) -> Iterator[dict]:
    """Records of all pages; it stops where a page or its successor comes a second time, which a faulty service would repeat for ever."""
    at: str | None = None
    asked: set[str | None] = set()
    last = None
    while at not in asked:
        asked.add(at)
        records, following = ask(at)
        shown = json.dumps(records, sort_keys=True, ensure_ascii=False)
        if records and shown == last:
            return
        last = shown
        yield from records
        if not records or following is None:
            return
        at = following


def by_offset(get: Callable[[int, int], dict], size: int = 100) -> Asked:
    """Pages by offset: an answer has results and next."""

    def ask(at: str | None) -> tuple[list[dict], str | None]:
        offset = int(at or 0)
        answer = get(offset, size)
        return answer.get("results") or [], str(offset + size) if answer.get("next") else None

    return ask


def by_token(get: Callable[[str | None], dict], records: str, token: str = "nextPageToken") -> Asked:
    """Pages by token: an empty token ends."""

    def ask(at: str | None) -> tuple[list[dict], str | None]:
        answer = get(at)
        return answer.get(records) or [], answer.get(token) or None

    return ask


def by_number(get: Callable[[int], dict]) -> Asked:
    """Pages by number from 1: an answer has results and next."""

    def ask(at: str | None) -> tuple[list[dict], str | None]:
        page = int(at or 1)
        answer = get(page)
        return answer.get("results") or [], str(page + 1) if answer.get("next") else None

    return ask


def synced(spark: SparkSession, services: dict[str, Asked]) -> DataFrame:
    """Rows (service, position, payload, error): the records of services, each read by a task of its own; a fault ends that service's rows with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name in pdf["service"]:
                batch: list[tuple] = []
                n = 0
                try:
                    for record in all_pages(services[name]):
                        batch.append((name, n, json.dumps(record, ensure_ascii=False), None))
                        n += 1
                        if len(batch) == 1_000:
                            yield pd.DataFrame(batch, columns=["service", "position", "payload", "error"])
                            batch = []
                except Exception as e:  # noqa: BLE001 - a fault of one service is data
                    batch.append((name, n, None, str(e)[:200]))
                yield pd.DataFrame(batch, columns=["service", "position", "payload", "error"])

    names = spark.createDataFrame([(n,) for n in services], "service string").repartition(max(1, len(services)), "service")
    return names.mapInPandas(run, "service string, position long, payload string, error string")


def memos(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Memo records (name, content, tags, updateTime) as documents; a memo has the first line of its content as title."""
    r = F.from_json(payload, "struct<name:string,uid:string,content:string,tags:array<string>,createTime:string,updateTime:string,creator:string>")
    d = df.select(r.alias("r"))
    title = F.trim(F.regexp_replace(F.regexp_extract("r.content", r"^\s*([^\n]*)", 1), r"^#{1,6}\s+", ""))
    return d.select(F.substring(title, 1, 120).alias("title"), F.col("r.content").alias("markdown"), F.col("r.creator").alias("author"), F.lit("mcp").alias("source_type"), F.coalesce("r.tags", F.array().cast("array<string>")).alias("technologies"), F.coalesce("r.uid", "r.name").alias("external_id"), F.coalesce("r.updateTime", "r.createTime").alias("last_modified"))
