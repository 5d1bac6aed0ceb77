"""Fetching over a transport that is passed in, and lists of URLs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.extract import extract_pages
from ..operators.site_pages import READERS
from ..operators.store import Store, cut
from ..operators.verticals import vertical_of
from .parsers import parse_files

#: (status, body or None) of a URL.
Transport = Callable[[str], tuple[int, bytes | None]]
#: Statuses that are tried again.
AGAIN = frozenset((429, 502, 503, 504, *range(520, 525)))
#: Most bytes of a body by kind.
CAPS = {"html": 5 << 20, "json": 5 << 20, "document": 16 << 20, "pdf": 32 << 20}


def fetch(df: DataFrame, transport: Transport, url: str = "url", tries: int = 2, tasks: int | None = None, waits: tuple[float, ...] = (0.0, 1.0)) -> DataFrame:
    """*df* (url and a position to keep the order by) with status, body and error; a retryable status or a fault of the transport is tried again after the next of *waits* (seconds before each try)."""

    def one(u: str | None) -> tuple[int | None, bytes | None, str | None]:
        error = "no url"
        for k in range(tries if u else 0):
            time.sleep(waits[min(k, len(waits) - 1)] if waits else 0)
            try:
                status, body = transport(u)
            except Exception as e:  # noqa: BLE001 - a fault of one URL is data
                error = str(e)[:200]
                continue
            if status not in AGAIN:
                return status, body, None
            error = f"status {status}"
        return None, None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [one(u) for u in pdf[url]]
            yield pdf.assign(status=pd.array([g[0] for g in got], dtype="Int64"), body=[g[1] for g in got], error=[g[2] for g in got])

    spread = df.repartition(tasks) if tasks else df
    return spread.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", status long, body binary, error string")


def kind(url: Column, content_type: Column) -> Column:
    """What a response is: pdf, document, json or html, by type and then by suffix."""
    path, low = F.lower(F.regexp_replace(url, r"[?#].*$", "")), F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(low.contains("application/pdf") | path.endswith(".pdf"), "pdf")
        .when(low.rlike("officedocument|opendocument|text/csv|ms-excel") | path.rlike(r"\.(docx|xlsx|pptx|odt|csv)$"), "document")
        .when(low.contains("json") | path.endswith(".json"), "json")
        .otherwise("html")
    )


def within_cap(body: Column, what: Column) -> Column:
    """Whether a body is within the size of its kind; null bodies are."""
    out = F.lit(True)
    for name, most in CAPS.items():
        out = F.when(what == name, F.coalesce(F.length(body), F.lit(0)) <= most).otherwise(out)
    return out


def route(url: Column, content_type: Column) -> Column:
    """What reads a response: the payload reader of a well-known site (vertical:name), the page reader of one (page:name), or its kind."""
    page = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(READERS.items()):
        if pattern and not name.endswith("_tree"):
            page = F.when(url.rlike(rf"^https?://(?:[\w-]+\.)*{pattern}"), F.lit(f"page:{name}")).otherwise(page)
    what = kind(url, content_type)
    site = vertical_of(url)
    return F.when((what == "json") & site.isNotNull(), F.concat(F.lit("vertical:"), site)).when((what == "html") & page.isNotNull(), page).otherwise(what)


def read_responses(fetched: DataFrame, url: str = "url", body: str = "body", content_type: str = "content_type", at: str = "fetched_at") -> DataFrame:
    """Rows (url, fetched_at, route, title, markdown, plain_text, record, error) of responses within their size: each by what its route reads it with, branch by branch."""
    base = fetched.select(F.col(url).alias("url"), F.col(at).alias("fetched_at"), F.col(body).alias("_body"), kind(F.col(url), F.col(content_type)).alias("_kind"), route(F.col(url), F.col(content_type)).alias("route"))
    text = F.decode(F.col("_body"), "UTF-8")
    fits = within_cap(F.col("_body"), F.col("_kind"))
    empty = {c: F.lit(None).cast("string") for c in ("title", "markdown", "plain_text", "record", "error")}
    shape = lambda df, **own: df.select("url", "fetched_at", "route", *[own.get(c, v).alias(c) for c, v in empty.items()])
    large = shape(base.where(~fits), error=F.lit("body above the size of its kind"))
    good = base.where(fits)
    key = F.struct("url", "fetched_at", "route")
    html = good.where((F.col("route") == "html") | F.col("route").startswith("page:")).select(key.alias("_key"), "url", text.alias("_html"))
    pages = extract_pages(html, "_key", "url", "_html").select("_key.url", "_key.fetched_at", "_key.route", "title", "markdown", "plain_text", F.lit(None).cast("string").alias("record"), "error")
    files = good.where(F.col("route").isin("pdf", "document"))
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^$", "x")
    named = files.select(F.concat(F.to_json(key), F.lit("\n"), F.when(path.rlike(r"\.[A-Za-z0-9]+$"), path).when(F.col("route") == "pdf", F.concat(path, F.lit(".pdf"))).otherwise(F.concat(path, F.lit(".docx")))).alias("path"), F.col("_body").alias("content"))
    parsed = parse_files(named)
    told = F.from_json(F.substring_index("path", "\n", 1), "url string, fetched_at timestamp, route string")
    docs = parsed.select(told.alias("_k"), "title", "markdown", "plain_text", "error").select("_k.url", "_k.fetched_at", "_k.route", "title", "markdown", "plain_text", F.lit(None).cast("string").alias("record"), "error")
    data = shape(good.where((F.col("route") == "json") | F.col("route").startswith("vertical:")), record=text)
    return pages.unionByName(docs).unionByName(data).unionByName(large)


def ingest(df: DataFrame, transport: Transport, store: Store, url: str = "url", tasks: int | None = None) -> DataFrame:
    """Fetch, read and store the URLs of *df*: the rows of :func:`read_responses`, of which those with a text were merged into the store (the last of each URL)."""
    got = cut(fetch(df.select(F.col(url).alias("url")), transport, tasks=tasks).withColumns({"content_type": F.lit(None).cast("string"), "fetched_at": F.current_timestamp()}), "fetched")
    read = cut(read_responses(got.where(F.col("error").isNull() & F.col("status").between(200, 299))), "read")
    texts = read.where(F.col("markdown").isNotNull()).select("url", "title", "markdown", "plain_text", "fetched_at").dropDuplicates(["url"])
    if not texts.isEmpty():
        store.write(texts)
    failed = got.where(F.col("error").isNotNull() | ~F.coalesce(F.col("status").between(200, 299), F.lit(False)))
    return read.unionByName(failed.select("url", "fetched_at", F.lit(None).cast("string").alias("route"), F.coalesce("error", F.concat(F.lit("status "), F.col("status").cast("string"))).alias("error")), allowMissingColumns=True)


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows (url, name) of a list: blank lines and # comments are left out; a name follows the last comma if it holds neither :// nor a dot."""
    t = F.trim(column)
    name = F.regexp_extract(t, r",([^,]*)$", 1)
    named = t.contains(",") & ~name.contains("://") & ~name.contains(".") & (F.trim(name) != "")
    return lines.where((t != "") & ~t.startswith("#")).select(F.when(named, F.trim(F.regexp_replace(t, r",[^,]*$", ""))).otherwise(t).alias("url"), F.when(named, F.trim(name)).alias("name"))
