"""Visual identity of pages: colours and fonts of their styles, counted in Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dom import parse

#: Colours that say nothing about a brand: white, black and common greys.
PLAIN_COLOURS = (
    "#ffffff #000000 #f8f8f8 #f5f5f5 #eeeeee #e5e5e5 #dddddd #d4d4d4 #cccccc #bbbbbb #aaaaaa #999999 #888888 #777777 #666666 #555555 #444444 #333333 #222222 #111111 #f0f0f0 #e0e0e0 #d0d0d0 #c0c0c0 #b0b0b0 #a0a0a0 #909090 #808080 #707070 #606060 "
    "#505050 #404040 #303030 #202020 #101010 #fafafa #f9f9f9 #f7f7f7 #f4f4f4 #f3f3f3 #f2f2f2 #f1f1f1 #efefef #ebebeb #e8e8e8"
).split()
#: Fonts that say nothing about a brand.
GENERIC_FONTS = ("inherit", "initial", "unset", "serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui", "-apple-system", "blinkmacsystemfont", "ui-sans-serif", "ui-serif", "ui-monospace")


def declarations(df: DataFrame, key: str, html: str) -> DataFrame:
    """Rows (key, property, value) of style blocks and style attributes; in the JVM."""
    css = F.concat_ws(";", F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), 1), F.regexp_extract_all(html, F.lit(r'(?is)\sstyle\s*=\s*"([^"]*)"'), 1))
    found = F.regexp_extract_all(css, F.lit(r"(?i)([a-z-]+\s*:\s*[^;{}]+)"), 1)
    return df.select(key, F.explode(found).alias("d")).select(key, F.lower(F.trim(F.regexp_extract("d", r"^([A-Za-z-]+)", 1))).alias("property"), F.trim(F.regexp_extract("d", r":\s*(.*)$", 1)).alias("value"))


def all_declarations(df: DataFrame, key: str, html: str, sheets: DataFrame | None = None) -> DataFrame:
    """:func:`declarations` and those that stand elsewhere: styles in single quotes, colours in utility classes, the theme colour, fonts that links load, and linked style sheets (href, css) of *sheets*."""
    styles = F.regexp_extract_all(html, F.lit(r"(?is)\sstyle\s*=\s*'([^']*)'"), 1)
    single = df.select(key, F.explode(F.regexp_extract_all(F.array_join(styles, ";"), F.lit(r"(?i)([a-z-]+\s*:\s*[^;{}]+)"), 1)).alias("d")).select(key, F.lower(F.trim(F.regexp_extract("d", r"^([A-Za-z-]+)", 1))).alias("property"), F.trim(F.regexp_extract("d", r":\s*(.*)$", 1)).alias("value"))
    utility = df.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?<![\w-])((?:bg|text|border|from|to|via|ring|fill|stroke)-\[#[0-9a-fA-F]{3,8}\])"), 1)).alias("u"))
    named = F.when(F.col("u").startswith("bg-"), "background-color").when(F.col("u").startswith("text-"), "color").when(F.col("u").startswith("border-"), "border-color").otherwise("--utility")
    utility = utility.select(key, named.alias("property"), F.regexp_extract("u", r"\[(#[0-9a-fA-F]+)\]", 1).alias("value"))
    theme = df.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<meta[^>]*name=[\"']theme-color[\"'][^>]*content=[\"']([^\"']+)"), 1)).alias("value")).select(key, F.lit("--theme-color").alias("property"), "value")
    loaded = df.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"fonts\.googleapis\.com/css2?\?[^\"'>\s]*?family=([^&\"':>\s]+)"), 1)).alias("f")).select(key, F.lit("font-family").alias("property"), F.replace("f", F.lit("+"), F.lit(" ")).alias("value"))
    out = declarations(df, key, html).unionByName(single).unionByName(utility).unionByName(theme).unionByName(loaded)
    if sheets is not None:
        hrefs = df.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<link[^>]*rel=[\"']stylesheet[\"'][^>]*href=[\"']([^\"']+)"), 1)).alias("href")).distinct()
        linked = hrefs.join(sheets.select("href", "css"), "href").select(key, F.concat(F.lit("<style>"), "css", F.lit("</style>")).alias("_css"))
        out = out.unionByName(declarations(linked, key, "_css"))
    return out


def hex_of(value: Column) -> Column:
    """The first colour of a CSS value as #rrggbb in lower case: hexadecimal of 3, 4, 6 or 8 digits, rgb(), rgba(), hsl() or hsla(); null without one."""
    part = lambda pattern, k: F.regexp_extract(value, pattern, k)
    short, long = part(r"#([0-9a-fA-F]{3})[0-9a-fA-F]?(?![0-9a-fA-F])", 1), part(r"#([0-9a-fA-F]{6})(?:[0-9a-fA-F]{2})?(?![0-9a-fA-F])", 1)
    rgb = r"(?i)rgba?\(\s*(\d{1,3})\s*[, ]\s*(\d{1,3})\s*[, ]\s*(\d{1,3})"
    hsl = r"(?i)hsla?\(\s*([\d.]+)(?:deg)?\s*[, ]\s*([\d.]+)%\s*[, ]\s*([\d.]+)%"
    two = lambda n: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), n)).cast("long")), 2, "0")
    h, sat, light = (F.nullif(part(hsl, k), F.lit("")).cast("double") for k in (1, 2, 3))
    sat, light = sat / 100, light / 100

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 30, F.lit(12.0))
        return F.round(255 * (light - sat * F.least(light, 1 - light) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))))

    whole = lambda k: F.nullif(part(rgb, k), F.lit("")).cast("int")
    found = (
        F.when(long != "", long)
        .when(short != "", F.concat(*[F.repeat(F.substring(short, i, 1), 2) for i in (1, 2, 3)]))
        .when(part(rgb, 1) != "", F.concat(*[two(whole(k)) for k in (1, 2, 3)]))
        .when(part(hsl, 1) != "", F.concat(*[two(channel(n)) for n in (0, 8, 4)]))
    )
    return F.concat(F.lit("#"), F.lower(found))


def identity(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Rows (key, name, logos array<struct<url,kind>>, favicon, image): what a page says of the brand it belongs to; URLs are resolved, the first of each counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for u, h in zip(pdf["_url"], pdf["_html"]):
                rows.append(_identity(u or "", h or ""))
            yield pd.DataFrame(rows, columns=["name", "logos", "favicon", "image"]).assign(_key=pdf["_key"].to_numpy())

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    return rows.mapInPandas(run, f"name string, logos array<struct<url:string,kind:string>>, favicon string, image string, _key {kind}").withColumnRenamed("_key", key)


def _identity(url: str, html: str) -> tuple:
    root = parse(html)
    meta: dict[str, str] = {}
    for n in root.find("meta"):
        name = (n.attrs.get("property") or n.attrs.get("name") or "").lower()
        if name and n.attrs.get("content", "").strip():
            meta.setdefault(name, n.attrs["content"].strip())
    full = lambda x: urljoin(url, x) if url else x
    title = " ".join(next((t.text() for t in root.find("title")), "").split())
    tail = re.split(r"\s+[|–—-]\s+", title)[-1] if title else ""
    logos: dict[str, str] = {}
    for n in root.find("img"):
        said = " ".join(n.attrs.get(a, "") for a in ("class", "id", "alt", "src")).lower()
        ups = [n.parent, n.parent.parent if n.parent else None]
        if n.attrs.get("src") and not n.attrs["src"].startswith("data:") and ("logo" in said or any(up is not None and "logo" in f"{up.attrs.get('class', '')} {up.attrs.get('id', '')}".lower() for up in ups)):
            logos.setdefault(full(n.attrs["src"]), "image")
    icons = [n for n in root.find("link") if "icon" in n.attrs.get("rel", "").lower().split() or "icon" in n.attrs.get("rel", "").lower()]
    for n in icons:
        if n.attrs.get("href") and ("apple-touch" in n.attrs.get("rel", "").lower() or n.attrs["href"].lower().endswith(".svg")):
            logos.setdefault(full(n.attrs["href"]), "icon")
    favicon = next((full(n.attrs["href"]) for n in icons if n.attrs.get("href")), full("/favicon.ico") if url else None)
    image = meta.get("og:image") or meta.get("twitter:image")
    host = re.sub(r"^www\.", "", urlsplit(url).hostname or "") if url else ""
    name = meta.get("og:site_name") or meta.get("application-name") or tail or host or None
    return name, [{"url": u, "kind": k} for u, k in logos.items()], favicon, full(image) if image else None


def colours(decls: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Rows (key, hex, usage, count, rank): colours by how often they are declared, hex as tie-break; the first two of unknown use are primary and secondary."""
    hexes = decls.select(key, "property", hex_of(F.col("value")).alias("hex")).where(F.col("hex").isNotNull())
    usage = F.when(F.col("property").startswith("background"), "background").when(F.col("property") == "color", "text").when(F.col("property").rlike("border|outline|accent"), "accent").otherwise("unknown")
    seen = hexes.select(key, "hex", usage.alias("usage")).where(~F.col("hex").isin(*PLAIN_COLOURS))
    by_use = seen.groupBy(key, "hex", "usage").agg(F.count("*").alias("n"))
    total = by_use.groupBy(key, "hex").agg(F.sum("n").alias("count"), F.max_by("usage", F.struct("n", "usage")).alias("usage"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "hex"))
    return total.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "hex", "usage", "count", "rank")


def fonts(decls: DataFrame, key: str) -> DataFrame:
    """Rows (key, font, count): families by frequency, generic ones left out."""
    names = decls.where(F.col("property").isin("font-family", "font")).select(key, F.explode(F.split("value", ",")).alias("f"))
    clean = names.select(key, F.trim(F.regexp_replace("f", r"[\"']|!important", "")).alias("font")).where((F.col("font") != "") & ~F.lower("font").isin(*GENERIC_FONTS))
    return clean.groupBy(key, "font").agg(F.count("*").alias("count"))
