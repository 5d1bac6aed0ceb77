"""The engine's functions under SQL names."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.chunk import chunks
from ..operators.extract import extract
from ..operators.readable import readable
from ..session import ship
from ..sources.parsers import sitemap_entries


def register(spark: SparkSession) -> None:
    """Functions page_markdown(html, url), readable_text(markdown), page_json(html, url) and table functions markdown_chunks(text), sitemap_urls(xml)."""
    ship(spark)

    @F.pandas_udf(T.StringType())
    def page_markdown(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([extract(h, u)["markdown"] for h, u in zip(html, url)])

    @F.pandas_udf(T.StringType())
    def page_json(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(extract(h, u), ensure_ascii=False) for h, u in zip(html, url)])

    @F.pandas_udf(T.StringType())
    def readable_text(text: pd.Series) -> pd.Series:
        return pd.Series([readable(t)[0] for t in text])

    @F.udtf(returnType="chunk_index int, char_offset long, section_header string, text string")
    class MarkdownChunks:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, (offset, body, header) in enumerate(chunks(text or "", least=1)):
                yield i, offset, header, body

    @F.udtf(returnType="url string, last_modified string, priority double, change_freq string")
    class SitemapUrls:
        def eval(self, xml: str) -> Iterator[tuple]:
            yield from sitemap_entries(xml or "")[1]

    for f in (page_markdown, page_json, readable_text):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("markdown_chunks", MarkdownChunks)
    spark.udtf.register("sitemap_urls", SitemapUrls)
