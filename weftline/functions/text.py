"""Column functions over texts and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Title openings of challenge pages.
CHALLENGE_TITLES = ("just a moment", "attention required", "access denied", "checking your browser", "please wait", "one more step", "verify you are human", "bot verification", "security check", "ddos protection")
#: Words that a search leaves out.
STOP_WORDS = ("the", "a", "an", "of", "in", "and", "or", "for", "to", "with", "is", "at", "by", "from")
#: Marks of single-page applications.
APP_MARKS = ("react-app", 'id="__next"', 'id="root"', 'id="app"', "__next_data__", "nuxt", "ng-app")
#: Invisible characters.
INVISIBLE = "​‌‍⁠﻿­‎‏‪‬᠎⁡"


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and empty."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")), F.lit(0))


def any_of(low: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(low, F.lit(n))
    return hit


def bot_protected(html: Column, has_edge_header: Column | None = None) -> Column:
    """Whether a page is a challenge of a bot protection. Sizes are in bytes; null is not."""
    low, size = F.lower(html), F.octet_length(html)
    wait = any_of(low, ("just a moment", "checking your browser"))
    out = any_of(low, ("_cf_chl_opt", "challenge-platform", "geo.captcha-delivery.com", "captcha-delivery.com/captcha", "awswaf-captcha", "aws-waf-client-browser"))
    out = out | (wait & F.contains(low, F.lit("cf-spinner")))
    out = out | (any_of(low, ("cf-turnstile", "challenges.cloudflare.com/turnstile")) & (size < 100_000))
    out = out | (F.contains(low, F.lit("hcaptcha.com")) & F.contains(low, F.lit("h-captcha")) & (size < 50_000))
    if has_edge_header is not None:
        out = out | (has_edge_header & wait)
    return F.coalesce(out, F.lit(False))


def needs_scripts(words: Column, html: Column) -> Column:
    """Whether a page has to be rendered: large and almost without words, or an application with few."""
    size, scripts = F.octet_length(html), F.contains(html, F.lit("<script"))
    return F.coalesce(scripts & (((words < 50) & (size > 5_000)) | ((words < 800) & (size > 50_000) & any_of(F.lower(html), APP_MARKS))), F.lit(False))


def empty_reason(words: Column, markdown: Column, title: Column, links: Column) -> Column:
    """Why an extraction is empty: antibot, js_required, or null where it isn't or nothing tells."""
    low = F.lower(title)
    known = F.lit(False)
    for t in CHALLENGE_TITLES:
        known = known | low.startswith(t)
    full = (words > 50) | (F.coalesce(markdown, F.lit("")) != "")
    return F.when(full, F.lit(None)).when(F.coalesce(known, F.lit(False)), "antibot").when((words == 0) & (links == 0), "js_required")


def strip_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def collapse_blank(text: Column, most: int = 1) -> Column:
    """At most *most* blank lines in a row, no white space at line ends, none around the text."""
    t = F.regexp_replace(text, r"(?<![ \t])[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{" + str(most + 2) + r",}", "\n" * (most + 1)), r"^\s+|\s+$", "")


def strip_thinking(text: Column) -> Column:
    """Without <think> sections; an unclosed one takes the rest."""
    return F.trim(F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?(?:</think(?:ing)?>|\z)", ""))


def json_answer(text: Column) -> Column:
    """The JSON of a model's answer: without thinking and code fences, from the first to the last brace or bracket; null if it doesn't parse."""
    bare = F.regexp_replace(strip_thinking(text), r"(?m)^```[a-zA-Z]*[ \t]*$", "")
    found = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def challenge_response(status: Column, body: Column, most: int = 15_000) -> Column:
    """Whether a response is the page of a bot check instead of the page asked for: small, with a title such pages have."""
    title = F.lower(F.trim(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    known = F.lit(False)
    for t in CHALLENGE_TITLES:
        known = known | title.startswith(t)
    return F.coalesce((F.octet_length(body) <= most) & known, F.lit(False))


def slug(text: Column, most: int = 60) -> Column:
    """Words of letters and digits in lower case joined by hyphens, up to *most* characters."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]", " "), " +"), lambda w: w != "")
    return F.substring(F.array_join(words, "-"), 1, most)


def research_key(query: Column, request: Column) -> Column:
    """The name under which an answer is kept: the query's slug and the first half of a digest of the whole request."""
    return F.concat(slug(query), F.lit("-"), F.substring(F.sha2(request, 256), 1, 32))


def metadata_header(url: Column, title: Column, author: Column, published: Column, language: Column, words: Column, description: Column | None = None) -> Column:
    """Quoted header lines before a text; absent fields are left out."""
    line = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"> {name}: "), c.cast("string")))
    return F.concat_ws("\n", line("URL", url), line("Title", title), *([line("Description", description)] if description is not None else []), line("Author", author), line("Published", published), line("Language", language), F.when(words > 0, F.concat(F.lit("> Word count: "), words.cast("string"))))


def front_matter(fields: dict[str, Column]) -> Column:
    """YAML block of the fields that are there."""
    return F.concat(F.lit("---\n"), F.concat_ws("", *[F.when(c.isNotNull(), F.concat(F.lit(f'{k}: "'), F.replace(c.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"\n'))) for k, c in fields.items()]), F.lit("---\n"))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def sitemaps_of_robots(robots: Column) -> Column:
    """URLs of the Sitemap lines of a robots.txt: case-insensitive, comments cut, http(s) with a host only."""
    lines = F.transform(F.split(robots, r"\r\n|\r|\n"), lambda s: F.trim(F.regexp_replace(s, r"#.*$", "")))
    urls = F.transform(F.filter(lines, lambda s: s.rlike(r"(?i)^sitemap\s*:")), lambda s: F.trim(F.regexp_replace(s, r"(?i)^sitemap\s*:\s*", "")))
    return F.filter(urls, lambda u: u.rlike(r"^https?://[^/?#]+"))


def projection(form: str, title: Column, url: Column, markdown: Column, plain: Column, readable: Column | None = None, html: Column | None = None, data: Column | None = None) -> Column:
    """A document in one output format: markdown (with front matter, and embedded data in a fence), text, json, llm (a short text under its header) or html."""
    if form == "markdown":
        body = F.concat(front_matter({"title": title, "url": url}), F.lit("\n"), F.coalesce(markdown, F.lit("")))
        return body if data is None else F.concat(body, F.when(F.coalesce(data, F.lit("")) != "", F.concat(F.lit("\n\n## Structured Data\n\n```json\n"), data, F.lit("\n```"))).otherwise(""))
    if form == "text":
        return plain
    if form == "json":
        return F.to_json(F.struct(title.alias("title"), url.alias("url"), markdown.alias("markdown"), plain.alias("plain_text")))
    if form == "llm":
        none = F.lit(None).cast("string")
        return F.concat_ws("\n\n", metadata_header(url, title, none, none, none, word_count(plain)), readable if readable is not None else markdown)
    if form == "html" and html is not None:
        return html
    raise ValueError(f"unknown format: {form}")
