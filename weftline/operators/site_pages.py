"""Records of sites that are read from their pages or trees: products, reviews, articles, posts, videos, papers, comment trees.

A page is read once into what it declares (JSON-LD objects, meta properties, its
title); a record is a table of fields, each with the places it may stand in, the
first of which counts.  Records come out as JSON, which :func:`fields` makes columns.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import cached_property
from html import unescape
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.S | re.I)
_META = re.compile(r"<meta\b([^>]*)>", re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_TAGS = re.compile(r"<[^>]+>")


def squeeze(text: str | None) -> str | None:
    """White space as single spaces; null stays null and nothing becomes null."""
    return " ".join(text.split()) or None if text else None


def plain(html: str | None) -> str | None:
    return squeeze(unescape(_TAGS.sub(" ", html))) if html else None


def dig(value: object, *path: str | int) -> object:
    """What stands at a path of keys and places, else None."""
    for step in path:
        if isinstance(value, dict) and isinstance(step, str):
            value = value.get(step)
        elif isinstance(value, list) and isinstance(step, int) and len(value) > step:
            value = value[step]
        else:
            return None
    return value


def scalar(value: object) -> str | None:
    """A string or number as a string; anything else is none."""
    return value if isinstance(value, str) else json.dumps(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


class Page:
    """What a page declares about itself."""

    def __init__(self, url: str, html: str):
        self.url, self.html = url, html

    @cached_property
    def objects(self) -> list[dict]:
        """Its JSON-LD objects; lists and graphs are taken apart, broken blocks left out."""
        out: list = []
        for attrs, body in _SCRIPT.findall(self.html):
            if "ld+json" in attrs.lower():
                try:
                    value = json.loads(body.strip())
                except ValueError:
                    continue
                graph = dig(value, "@graph")
                out += value if isinstance(value, list) else graph if isinstance(graph, list) else [value]
        return [x for x in out if isinstance(x, dict)]

    def object(self, *kinds: str) -> dict:
        """The first object of one of these types."""
        for x in self.objects:
            own = x.get("@type")
            if any(k in kinds for k in (own if isinstance(own, list) else [own])):
                return x
        return {}

    @cached_property
    def meta(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for attrs in _META.findall(self.html):
            found = {k.lower(): unescape(a or b) for k, a, b in _ATTRIBUTE.findall(attrs)}
            name = found.get("property") or found.get("name")
            if name and found.get("content"):
                out.setdefault(name.lower(), found["content"])
        return out

    @cached_property
    def title(self) -> str | None:
        m = re.search(r"<title[^>]*>(.*?)</title>", self.html, re.S | re.I)
        return squeeze(unescape(m.group(1))) if m else None

    def first(self, pattern: str) -> str | None:
        m = re.search(pattern, self.html, re.S)
        return m.group(1) if m else None

    def script_json(self, name: str) -> object:
        """The JSON value that a script assigns to a variable."""
        m = re.search(rf"{name}\s*=\s*(?=\{{)", self.html)
        if not m:
            return None
        try:
            return json.JSONDecoder().raw_decode(self.html, m.end())[0]
        except ValueError:
            return None


def _product(p: Page) -> dict:
    item = p.object("Product")
    offer = item.get("offers")
    offer = offer[0] if isinstance(offer, list) and offer else offer
    brand = item.get("brand")
    stock = scalar(dig(offer, "availability"))
    return {
        "title": scalar(item.get("name")) or p.meta.get("og:title"), "description": scalar(item.get("description")), "sku": scalar(item.get("sku")), "brand": scalar(dig(brand, "name")) or scalar(brand), "image": item.get("image"),
        "price": scalar(dig(offer, "price")) or p.meta.get("product:price:amount"), "currency": scalar(dig(offer, "priceCurrency")) or p.meta.get("product:price:currency"), "availability": stock.rsplit("/", 1)[-1] if stock else None,
        "offer_url": scalar(dig(offer, "url")), "rating": scalar(dig(item, "aggregateRating", "ratingValue")), "review_count": scalar(dig(item, "aggregateRating", "reviewCount")),
    }


def _reviews(p: Page) -> dict:
    item = p.object("LocalBusiness", "Organization", "Corporation")
    found = item.get("review") or []
    reviews = [{"author": dig(r, "author", "name"), "rating": dig(r, "reviewRating", "ratingValue"), "body": dig(r, "reviewBody"), "date": dig(r, "datePublished")} for r in (found if isinstance(found, list) else [found])]
    return {"business": scalar(item.get("name")), "rating": scalar(dig(item, "aggregateRating", "ratingValue")), "review_count": scalar(dig(item, "aggregateRating", "reviewCount")), "reviews": reviews}


def _article(p: Page) -> dict:
    item = p.object("Article", "BlogPosting", "NewsArticle")
    author = item.get("author")
    author = author[0] if isinstance(author, list) and author else author
    return {
        "canonical_url": p.meta.get("og:url") or p.url, "title": scalar(item.get("headline")) or scalar(item.get("name")) or p.meta.get("og:title") or p.title, "description": scalar(item.get("description")) or p.meta.get("og:description"),
        "author": scalar(dig(author, "name")) or scalar(author) or p.meta.get("author"), "published_at": scalar(item.get("datePublished")) or p.meta.get("article:published_time"),
        "modified_at": scalar(item.get("dateModified")) or p.meta.get("article:modified_time"), "image": item.get("image") or p.meta.get("og:image"), "body": plain(p.first(r"(?i)<article[^>]*>(.*?)</article>")),
    }


def post_urn(url: str) -> str | None:
    """The identity of a post that a LinkedIn address names."""
    if (urlsplit(url).hostname or "") not in ("www.linkedin.com", "linkedin.com"):
        return None
    m = re.search(r"urn:li:[^:/?#]+:\d+(?=[/?#]|$)", url)
    if m:
        return m.group(0)
    m = re.search(r"/posts/[^/]*?-(\d{15,})-[A-Za-z0-9]{2,}/?", url)
    return f"urn:li:activity:{m.group(1)}" if m else None


def _linkedin_post(p: Page) -> dict:
    name = p.title.rpartition("|")[2].strip() if p.title and "|" in p.title else None
    urn = post_urn(p.url)
    return {
        "urn": urn, "embed_url": f"https://www.linkedin.com/embed/feed/update/{urn}" if urn else None, "canonical_url": p.meta.get("og:url") or p.url, "title": p.meta.get("og:title"), "author_name": name,
        "body": plain(p.first(r"<p[^>]+class=\"[^\"]*attributed-text-segment-list__content[^\"]*\"[^>]*>(.*?)</p>")), "image_url": p.meta.get("og:image"), "site_name": p.meta.get("og:site_name") or "LinkedIn",
    }


def _linkedin_page(p: Page) -> dict:
    """Post, author and comments out of the largest list of included records of the page's code elements; authors by their urn."""
    best: list = []
    for body in re.findall(r"<code\b[^>]*>(.*?)</code>", p.html, re.S | re.I):
        if len(body.encode("utf-8", "surrogatepass")) > 1000:
            try:
                found = dig(json.loads(unescape(re.sub(r"^\s*<!--|-->\s*$", "", body))), "included")
            except ValueError:
                continue
            if isinstance(found, list) and len(found) > len(best):
                best = found
    people = {x["entityUrn"]: squeeze(f"{x.get('firstName') or ''} {x.get('lastName') or ''}") for x in best if isinstance(x, dict) and isinstance(x.get("entityUrn"), str) and ("firstName" in x or "lastName" in x)}
    texts = [x for x in best if isinstance(x, dict)]
    post = next((x for x in texts if scalar(dig(x, "commentary", "text", "text"))), {})
    comments = [{"author": people.get(dig(x, "commenter", "commenterProfileId") or dig(x, "commenterProfileUrn") or ""), "text": scalar(dig(x, "commentV2", "text")) or scalar(dig(x, "comment", "values", 0, "value"))} for x in texts if str(x.get("$type", "")).endswith("Comment")]
    return {"body": scalar(dig(post, "commentary", "text", "text")), "author": scalar(dig(post, "actor", "name", "text")), "headline": scalar(dig(post, "actor", "description", "text")), "comments": [c for c in comments if c["text"]], "people": len(people)}


def _instagram_post(p: Page) -> dict:
    steps = [x for x in urlsplit(p.url).path.split("/") if x]
    kind = {"p": "post", "reel": "reel", "reels": "reel", "tv": "tv"}.get(steps[0] if steps else "")
    code = steps[1] if kind and len(steps) > 1 else None
    caption = p.first(r"<div\s+class=\"Caption\"[^>]*>(.*?)</div>")
    name = p.first(r"class=\"CaptionUsername\"[^>]*>([^<]+)<")
    image = p.first(r"<img[^>]+class=\"[^\"]*EmbeddedMediaImage[^\"]*\"[^>]+src=\"([^\"]+)\"")
    return {
        "kind": kind, "shortcode": code, "embed_url": f"https://www.instagram.com/p/{code}/embed/captioned/" if code else None, "canonical_url": f"https://www.instagram.com/{'p' if kind == 'post' else kind}/{code}/" if code else None,
        "author_username": unescape(name).strip() if name else None, "caption": plain(re.sub(r"(?s)<a[^>]*class=\"CaptionUsername\"[^>]*>.*?</a>", "", caption)) if caption else None, "thumbnail_url": unescape(image) if image else None,
    }


def compact(n: int) -> str:
    """A count as people write it: 1.2K, 3.4M."""
    for size, mark in ((1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K")):
        if n >= size:
            return f"{n / size:.1f}{mark}"
    return str(n)


def _youtube(p: Page) -> dict:
    player = p.script_json("ytInitialPlayerResponse")
    seen, more = dig(player, "videoDetails"), dig(player, "microformat", "playerMicroformatRenderer")
    whole = lambda v: int(v) if isinstance(v, (str, int)) and str(v).isdigit() else None
    tracks = dig(player, "captions", "playerCaptionsTracklistRenderer", "captionTracks") or []
    seconds, views = whole(dig(seen, "lengthSeconds")), whole(dig(seen, "viewCount"))
    title, text = dig(seen, "title"), dig(seen, "shortDescription")
    length = None if seconds is None else f"{seconds // 3600}:{seconds // 60 % 60:02d}:{seconds % 60:02d}" if seconds >= 3600 else f"{seconds // 60}:{seconds % 60:02d}"
    facts = [f"**Channel:** {dig(seen, 'author')}" if dig(seen, "author") else None, f"**Views:** {compact(views)}" if views is not None else None, f"**Duration:** {length}" if length else None, f"**Published:** {dig(more, 'publishDate')}" if dig(more, "publishDate") else None]
    return {
        "video_id": dig(seen, "videoId") or (parse_qs(urlsplit(p.url).query).get("v") or [None])[0], "title": title, "description": text, "author": dig(seen, "author"), "channel_id": dig(seen, "channelId"), "channel_url": dig(more, "ownerProfileUrl"),
        "view_count": views, "length_seconds": seconds, "upload_date": dig(more, "uploadDate"), "publish_date": dig(more, "publishDate"), "category": dig(more, "category"), "keywords": dig(seen, "keywords") or [], "duration": length,
        "caption_tracks": [{"url": dig(t, "baseUrl"), "language": dig(t, "languageCode")} for t in tracks],
        "markdown": "\n\n".join(filter(None, [f"# {title}" if title else None, " | ".join(filter(None, facts)), f"## Description\n\n{text}" if text else None])) or None,
    }


def paper_id(url: str) -> str | None:
    """The identity of a paper that an arXiv address names, without version."""
    steps = [x for x in urlsplit(url).path.split("/") if x]
    if len(steps) < 2 or steps[0] not in ("abs", "pdf"):
        return None
    old = len(steps) > 2 and ("." in steps[1] or steps[1].isalpha())
    return re.sub(r"v\d*$", "", ("/".join(steps[1:3]) if old else steps[1]).removesuffix(".pdf")) or None


_ATOM = "{http://www.w3.org/2005/Atom}"
_ARXIV = "{http://arxiv.org/schemas/atom}"


def _arxiv(p: Page) -> dict:
    try:
        entry = ET.fromstring(p.html.encode("utf-8", "surrogatepass")).find(f"{_ATOM}entry")
    except ET.ParseError:
        entry = None
    if entry is None:
        return {}
    text = lambda tag: squeeze(entry.findtext(tag))
    links = {(x.get("title") or x.get("rel")): x.get("href") for x in entry.iter(f"{_ATOM}link")}
    first = entry.find(f"{_ARXIV}primary_category")
    return {
        "id": paper_id(p.url), "arxiv_id": text(f"{_ATOM}id"), "title": text(f"{_ATOM}title"), "authors": [squeeze(a.findtext(f"{_ATOM}name")) for a in entry.iter(f"{_ATOM}author")], "abstract": text(f"{_ATOM}summary"),
        "published": text(f"{_ATOM}published"), "updated": text(f"{_ATOM}updated"), "primary_category": first.get("term") if first is not None else None, "categories": [c.get("term") for c in entry.iter(f"{_ATOM}category")],
        "doi": text(f"{_ARXIV}doi"), "comment": text(f"{_ARXIV}comment"), "pdf_url": links.get("pdf"), "abs_url": links.get("alternate"),
    }


def _descend(roots: list, children: Callable[[dict], list], keep: Callable[[dict], bool], show: Callable[[dict], dict]) -> tuple[list[dict], int]:
    """A tree of replies and the number of its nodes, without recursion; what isn't kept goes with all below it."""
    top: list[dict] = []
    count, todo = 0, [(x, top) for x in reversed(roots)]
    while todo:
        node, place = todo.pop()
        if not isinstance(node, dict) or not keep(node):
            continue
        own = show(node) | {"replies": []}
        place.append(own)
        count += 1
        todo += [(x, own["replies"]) for x in reversed(children(node))]
    return top, count


def _listing(value: object) -> list:
    found = dig(value, "data", "children")
    return found if isinstance(found, list) else []


def _hackernews(p: Page) -> dict:
    item = json.loads(p.html)
    comments, n = _descend(dig(item, "children") or [], lambda x: x.get("children") or [], lambda x: x.get("type") == "comment", lambda x: {k: x.get(k) for k in ("id", "author", "text", "created_at", "parent_id", "story_id")})
    return {k: dig(item, k) for k in ("id", "type", "title", "url", "author", "points", "text", "created_at")} | {"comment_count": n, "permalink": f"https://news.ycombinator.com/item?id={dig(item, 'id')}", "comments": comments}


def _reddit(p: Page) -> dict:
    pair = json.loads(p.html)
    post = dig(_listing(dig(pair, 0)), 0, "data") or {}
    comments, n = _descend(_listing(dig(pair, 1)), lambda x: _listing(dig(x, "data", "replies")), lambda x: x.get("kind") == "t1", lambda x: {k: dig(x, "data", k) for k in ("author", "body", "score", "permalink", "created_utc")})
    return {"title": post.get("title"), "author": post.get("author"), "subreddit": post.get("subreddit_name_prefixed"), "selftext": post.get("selftext"), "score": post.get("score"), "num_comments": post.get("num_comments"), "comment_count": n, "comments": comments}


#: Readers by name: the URLs they take, and what reads their page or payload.
READERS: dict[str, tuple[str, Callable[[Page], dict]]] = {
    "arxiv": (r"arxiv\.org/(?:abs|pdf)/", _arxiv),
    "substack_post": (r"[^/]+\.substack\.com/p/", _article),
    "linkedin_post": (r"linkedin\.com/(?:posts|feed/update)/", _linkedin_post),
    "linkedin_page": (r"linkedin\.com/(?:posts|feed/update)/", _linkedin_page),
    "instagram_post": (r"instagram\.com/(?:p|reels?|tv)/", _instagram_post),
    "youtube_page": (r"(?:youtube\.com/watch|youtu\.be/)", _youtube),
    "amazon_product": (r"amazon\.[a-z.]+/", _product),
    "ebay_listing": (r"ebay\.[a-z.]+/itm/", _product),
    "etsy_listing": (r"etsy\.com/listing/", _product),
    "ecommerce_product": (r"", _product),
    "woocommerce_product": (r"", _product),
    "trustpilot_reviews": (r"trustpilot\.com/review/", _reviews),
    "hackernews_tree": (r"news\.ycombinator\.com/item", _hackernews),
    "reddit_tree": (r"reddit\.com/r/[^/]+/comments/", _reddit),
}


def site_record(name: str, url: str | None, payload: str | None) -> dict | None:
    """The record that a reader finds; null for a null or empty payload, and for one that can't be read."""
    if not payload:
        return None
    try:
        return READERS[name][1](Page(url or "", payload)) or None
    except (ValueError, AttributeError, TypeError, KeyError):
        return None


def read_pages(df: DataFrame, name: str, key: str, url: str = "url", payload: str = "html") -> DataFrame:
    """Rows (*key*, url, record): the record of each row as JSON, one for one; null where there is none."""
    if name not in READERS:
        raise ValueError(f"unknown reader: {name}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [site_record(name, u, p) for u, p in zip(pdf["url"], pdf["_payload"])]
            yield pd.DataFrame({"_key": pdf["_key"], "url": pdf["url"], "record": [None if r is None else json.dumps(r, ensure_ascii=False) for r in found]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(url).alias("url"), F.col(payload).alias("_payload"))
    return rows.mapInPandas(run, f"_key {kind}, url string, record string").withColumnRenamed("_key", key)


def fields(record: Column, **kinds: str) -> list[Column]:
    """Columns of a record by name and type."""
    data = F.try_parse_json(record)
    return [F.try_variant_get(data, f"$.{name}", kind).alias(name) for name, kind in kinds.items()]
