"""Column functions over URLs. Three canonical forms exist, for crawling, for indexing and for input; they differ and aren't merged."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Substrings of a lower-cased URL that tell the kind of a site, tried in this order.
DOMAIN_TYPES: dict[str, list[str]] = {
    "git_hub": ["github.com", "gitlab.com"],
    "documentation": ["docs.", "readthedocs", "gitbook", "docusaurus", "/docs/", "/documentation/", "devdocs.io", "doc.rust-lang.org", "developer.mozilla.org", "developer.apple.com/documentation"],
    "forum": ["reddit.com", "news.ycombinator.com", "stackoverflow.com", "stackexchange.com", "discourse", "forum", "community."],
    "social": ["twitter.com", "x.com", "linkedin.com", "facebook.com", "instagram.com", "mastodon", "bsky.app"],
    "e_commerce": ["amazon.", "ebay.", "shopify.", "etsy.com", "/product/", "/shop/", "/cart"],
}

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, group: int) -> Column:
    """Group of a URL: 1 scheme, 2 host, 3 port with colon, 4 path, 5 query with mark, 6 fragment with mark; '' where absent."""
    return F.regexp_extract(url, _SPLIT, group)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def domain_type(url: Column) -> Column:
    """The kind of site a URL shows, or 'generic'. Substrings match anywhere, as in 'netflix.com' for 'x.com'. Null stays null."""
    low = F.lower(url)
    out = F.lit("generic")
    for name, needles in reversed(DOMAIN_TYPES.items()):
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(low, F.lit(n))
        out = F.when(hit, name).otherwise(out)
    return F.when(url.isNull(), F.lit(None)).otherwise(out)


#: Substrings of lower-cased HTML that tell the kind of a page whose URL doesn't.
PAGE_MARKS: dict[str, list[str]] = {"article": ["<article", "schema.org/article"], "documentation": ["docsearch", "sidebar-nav", "doc-content"]}


def page_type(url: Column, html: Column) -> Column:
    """The kind that the URL shows, else the one that the page's marks do, else 'generic'; of a null URL by the page alone."""
    low = F.lower(html)
    out = F.lit("generic")
    for name, needles in reversed(PAGE_MARKS.items()):
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(low, F.lit(n))
        out = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(out)
    known = F.coalesce(domain_type(url), F.lit("generic"))
    return F.when(known != "generic", known).otherwise(out)


def crawl_form(url: Column) -> Column:
    """Without fragment and one trailing slash (not that of the root), scheme and host in lower case; the query stays."""
    path = part(url, 4)
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(F.when(path == "", "/").otherwise(path))
    return F.when(part(url, 1) == "", url).otherwise(F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), part(url, 3), path, part(url, 5)))


def index_form(url: Column) -> Column:
    """Without fragment and without any trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"/+$", "")


def input_form(url: Column) -> Column:
    """Trimmed, with https:// where no scheme is given."""
    t = F.trim(url)
    return F.when(t.rlike(r"^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def origin(url: Column) -> Column:
    """Scheme, host without www. and port: what same-origin tests compare."""
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.regexp_replace(host(url), r"^www\.", ""), part(url, 3))


def looks_like_url(text: Column) -> Column:
    """A scheme, or no space and a dot before an alphabetic last label of two letters or more."""
    return text.rlike(r"^https?://") | (~text.rlike(r"\s") & text.rlike(r"^[^/]+\.[A-Za-z]{2,}(?:[/?#:].*)?$"))


def glob_regex(pattern: str, max_length: int = 512, max_wild: int = 64, max_recursive: int = 4) -> str:
    """Anchored regular expression of a path glob: * within a segment, ** over segments, ? any character. Raises ValueError beyond the limits."""
    if len(pattern.encode()) > max_length or sum(c in "*?" for c in pattern) > max_wild or pattern.count("**") > max_recursive:
        raise ValueError(f"glob beyond the limits: {pattern!r}")
    out = []
    for m in re.finditer(r"\*\*+/?|\*|\?|[^*?]+", pattern):
        token = m.group(0)
        out.append("(?s:.*)" if token.startswith("**") else "[^/]*" if token == "*" else "(?s:.)" if token == "?" else re.escape(token))
    return f"^{''.join(out)}$"


def glob_match(path: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(glob_regex(p))
    return hit


#: First labels and literal addresses that public fetches must not reach.
_PRIVATE = (
    r"^(?:localhost|.*\.localhost|.*\.local|.*\.internal|0\.0\.0\.0|127(?:\.\d{1,3}){3}|10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|169\.254(?:\.\d{1,3}){2}"
    r"|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])(?:\.\d{1,3}){2}|(?:22[4-9]|23\d|24\d|25[0-5])(?:\.\d{1,3}){3}|\[(?:::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*)\])$"
)


def is_public(url: Column) -> Column:
    """An http(s) URL whose host is neither local nor a private or reserved literal address. Names aren't resolved."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.coalesce(F.lower(part(url, 1)).isin("http", "https") & (h != "") & ~h.rlike(_PRIVATE), F.lit(False))


@F.pandas_udf(StringType())
def url_digest(url: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits of a URL's bytes, in hexadecimal."""

    def one(u: str) -> str:
        h = 14695981039346656037
        for b in u.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return url.map(one, na_action="ignore")


#: Bytes of a store key without and with the digest that is put behind a longer one.
KEY_BYTES, KEY_KEPT = 240, 223


def store_key(url: Column) -> Column:
    """Path of a document in the store: host without www. and sanitized path segments; a digest of the URL tells queries and long paths apart. Null where there is no host."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_\-]", "_"), r"^_+|_+$", "")
    clean = lambda c: F.when(bare(c) == "", "index").otherwise(bare(c))
    segments = F.filter(F.split(part(url, 4), "/"), lambda s: ~s.isin("", ".", ".."))
    path = F.when(F.size(segments) == 0, "index").otherwise(F.array_join(F.transform(segments, clean), "/"))
    key = F.concat(store_domain(url), F.lit("/"), path)
    marked = (part(url, 5) != "") | (F.length(key) > KEY_BYTES)
    # The digest is made in Python, so only for URLs that need it.
    return F.when(marked, F.concat(F.substring(key, 1, KEY_KEPT), F.lit("_"), url_digest(F.when(marked, url)))).otherwise(key)


def store_domain(url: Column) -> Column:
    """The host without www. as a name of a folder; null without a host."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(host(url)), r"^www\.", ""), r"[^a-z0-9_\-]", "_"), r"^_+|_+$", "")
    return F.when(host(url) != "", F.when(name == "", "index").otherwise(name))


def store_url(key: Column) -> Column:
    """The likeliest URL of a store key: the digest goes, underscores of the host become dots; what sanitizing lost stays lost."""
    path = F.regexp_replace(F.regexp_extract(key, r"^[^/]*/(.*)$", 1), r"_[0-9a-f]{16}$", "")
    return F.concat(F.lit("https://"), F.replace(F.regexp_extract(key, r"^([^/]*)", 1), F.lit("_"), F.lit(".")), F.lit("/"), F.when(path == "index", "").otherwise(path))


def indexable(url: Column) -> Column:
    """Whether a document's URL may be indexed: public http(s), or a file of this machine."""
    local = url.rlike(r"(?i)^file://(?:localhost)?/")
    return F.coalesce(is_public(url) | local, F.lit(False))


def within_root(path: Column, root: str) -> Column:
    """Whether a canonical path is a folder or lies in it; a sibling that begins alike doesn't."""
    base = root.rstrip("/")
    return F.coalesce((path == (base or "/")) | path.startswith(base + "/"), F.lit(False)) & ~F.coalesce(path.rlike(r"(?:^|/)\.\.(?:/|$)"), F.lit(False))
