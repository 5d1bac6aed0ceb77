"""HTML pages to structured documents: metadata, main body as Markdown and plain text, links, images, code, embedded data."""

from __future__ import annotations

import json
import math
import re
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dom import BLOCK, Element, parse, select

SCHEMA = (
    "error string, title string, description string, author string, published_date string, language string, site_name string, image string, favicon string, word_count long, "
    "markdown string, plain_text string, links array<struct<text:string,href:string>>, images array<struct<alt:string,src:string>>, code_blocks array<struct<language:string,code:string>>, structured_data array<string>"
)
#: Elements, roles, class tokens and ids of page furniture, and prefixes of consent managers.
NOISE_TAGS = frozenset("script style noscript iframe svg nav aside footer header video audio canvas template".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo".split())
NOISE_CLASSES = frozenset(
    "header top navbar footer bottom sidebar modal popup overlay ad ads advert lang-selector language social social-media social-links menu navigation breadcrumbs breadcrumb share widget cookie newsletter subscribe skip-link "
    "sr-only visually-hidden notification alert toast pagination pager signup login-form search-form related-posts recommended".split()
)
NOISE_IDS = frozenset("header footer nav sidebar menu modal popup cookie breadcrumbs widget ad social share newsletter subscribe comments related recommended".split())
CONSENT = tuple("onetrust optanon ot-sdk cookiebot CybotCookiebot cc- cookie-law gdpr consent- cmp- sp_message qc-cmp trustarc evidon".split())
FORM_WORDS = ("login", "search", "subscribe", "signup", "newsletter", "contact")
#: Sizes in bytes: an element that is noisy by class or id and larger than this is kept, as it probably wraps the page; a form below this goes.
KEEP_ABOVE, FORM_BELOW = 5_000, 500

_ABSOLUTE, _SPACE, _BLANKS, _HEADING = re.compile(r"[a-z][a-z0-9+.-]*:|//", re.I), re.compile(r"\s+"), re.compile(r"[ \t]+"), re.compile(r"h[1-6]")
_AD = re.compile(r"(?:^|\s)(?:ad(?=[\s_-]|$)|\S*[-_]ad(?=\s|$))")


def size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def is_noise(node: Element) -> bool:
    if node.noise is None:
        node.noise = _noisy(node)
    return node.noise


def _noisy(node: Element) -> bool:
    tag = node.tag
    if tag in ("html", "body"):
        return False
    if tag in NOISE_TAGS:
        return True
    if not node.raw:
        return tag == "form" and node.size < FORM_BELOW
    attrs = node.attrs
    classes = attrs.get("class", "")
    low = classes.lower()
    if tag == "form":
        return node.size < FORM_BELOW or any(w in low for w in FORM_WORDS)
    if attrs.get("role") in NOISE_ROLES:
        return True
    name = attrs.get("id", "").lower()
    if classes:
        tokens = low.split()
        if not NOISE_CLASSES.isdisjoint(tokens) or any(t.startswith(("footer", "header-", "nav-")) for t in tokens) or "ad" in classes and _AD.search(classes):
            return node.size <= KEEP_ABOVE
    if name in NOISE_IDS:
        return node.size <= KEEP_ABOVE
    return name.startswith(CONSENT) or any(c in low for c in CONSENT)


def candidate_score(node: Element) -> float:
    """ln(bytes), bonuses for article, main and telling names and for paragraphs, cut by link density."""
    total = max(0, node.size - node.lead - node.trail)
    if total < 50:
        return -1.0
    main = node.attrs.get("role") == "main"
    strong = node.tag in ("article", "main")
    names = ("content", "article", "main", "post", "body", "entry")
    out = math.log(total) + 50 * strong + 50 * main + 3 * node.paragraphs
    if node.raw:
        classes, name = " ".join(node.classes()), node.attrs.get("id", "").lower()
        out += 25 * any(n in classes for n in names) + 25 * any(n in name for n in names)
    density = node.linked / total
    for limit, factor in ((0.7, 0.3), (0.5, 0.5)) if strong or main else ((0.5, 0.1), (0.3, 0.5)):
        if density > limit:
            return out * factor
    return out


def main_node(root: Element) -> Element:
    """The candidate of the highest score, the first of equals; else the body."""
    best, most = None, 0.0
    for node in root.walk():
        if (node.tag in ("article", "main", "div", "section", "td") or node.attrs.get("role") == "main") and not is_noise(node):
            s = candidate_score(node)
            if s > most:
                best, most = node, s
    return best or next(root.find("body"), root)


def best_source(srcset: str) -> str:
    """The URL of the largest descriptor of a srcset; the first of equals."""
    best, most = "", -1.0
    for part in srcset.split(","):
        words = part.split()
        if words:
            m = re.match(r"([\d.]+)[wx]$", words[1]) if len(words) > 1 else None
            value = float(m.group(1)) if m else 1.0
            if value > most:
                best, most = words[0], value
    return best


#: Languages that a class may name without a prefix, and short names.
LANGUAGES = frozenset(
    "javascript typescript python rust go java ruby php swift kotlin scala html css scss sass less json yaml yml toml xml sql graphql bash shell sh zsh powershell dockerfile makefile c cpp csharp js ts jsx tsx py rb rs md markdown r lua perl elixir "
    "haskell ocaml clojure dart zig nim wasm diff text plaintext console".split()
)
SHORT_NAMES = {"javascript": "js", "typescript": "ts", "py": "python", "cs": "csharp", "c#": "csharp", "c++": "cpp", "shell": "bash", "zsh": "bash", "sh": "bash", "yml": "yaml", "rs": "rust", "md": "markdown", "plaintext": "text"}


def code_language(node: Element) -> str | None:
    """The language that a class of a code element, or of an element within, names."""
    for n in node.walk():
        for c in n.attrs.get("class", "").split() if n.raw else ():
            m = re.match(r"(?:language|lang|highlight)-(\S{1,19})$", c)
            name = (m.group(1) if m else c.removeprefix("sp-")).lower()
            if m or name in LANGUAGES:
                return SHORT_NAMES.get(name, name)
    return None


class Markdown:
    """One rendering of a tree: Markdown with its links, images and code blocks."""

    def __init__(self, base: str, excluded: set[int]):
        self.base, self.excluded = base, excluded
        site = re.match(r"^https?://[^/?#]+", base)
        self.origin = site.group(0) if site else ""
        self.links: list[tuple[str, str]] = []
        self.images: list[tuple[str, str]] = []
        self.code: list[tuple[str | None, str]] = []

    def url(self, href: str) -> str:
        if _ABSOLUTE.match(href) or not self.base:
            return href
        if href.startswith("/") and "/." not in href and self.origin:
            return self.origin + href
        return urljoin(self.base, href)

    def assets(self, node: Element) -> None:
        """Images with a text and absolute links of page furniture: kept as metadata, not as text."""
        if node.tag in ("script", "style", "template") or not node.children:
            return
        for n in node.walk():
            if n.tag == "img" and n.attrs.get("alt") and n.attrs.get("src"):
                self.images.append((n.attrs["alt"], self.url(n.attrs["src"])))
            elif n.tag == "a" and n.attrs.get("href"):
                href, text = self.url(n.attrs["href"]), n.text().strip()
                if text and href.startswith(("http", "//")):
                    self.links.append((re.sub(r"\s+", " ", text), href))

    def inline(self, node: Element | str) -> str:
        if isinstance(node, str):
            return _SPACE.sub(" ", node)
        if id(node) in self.excluded:
            return ""
        if is_noise(node):
            self.assets(node)
            return ""
        tag = node.tag
        if tag == "br":
            return "\n"
        if tag == "img":
            src = next((node.attrs[k] for k in ("src", "data-src", "data-lazy-src", "data-original") if node.attrs.get(k) and not node.attrs[k].startswith(("data:", "blob:"))), "") or best_source(node.attrs.get("srcset", ""))
            if not src:
                return ""
            self.images.append((node.attrs.get("alt", ""), self.url(src)))
            return f"![{node.attrs.get('alt', '')}]({self.url(src)})"
        if tag in ("code", "kbd", "samp", "tt"):
            return f"`{node.text().strip()}`" if node.text().strip() else ""
        inner = "".join(self.inline(c) for c in node.children)
        bare = inner.strip()
        if not bare:
            return inner
        wrap = lambda mark: inner.replace(bare, f"{mark}{bare}{mark}", 1)
        if tag == "a":
            href = node.attrs.get("href", "")
            if href and not href.startswith(("javascript:", "#")):
                self.links.append((re.sub(r"\s+", " ", bare), self.url(href)))
                return inner.replace(bare, f"[{bare}]({self.url(href)})", 1)
            return inner
        if tag in ("b", "strong"):
            return wrap("**")
        if tag in ("i", "em"):
            return wrap("*")
        return inner

    def blocks(self, node: Element, depth: int = 0) -> list[str]:
        out: list[str] = []
        run: list[str] = []

        def flush() -> None:
            if run:
                text = _BLANKS.sub(" ", "".join(run)).strip()
                if text:
                    out.append(text)
                run.clear()

        for c in node.children:
            if isinstance(c, str) or not c.blocky:
                run.append(self.inline(c))
                continue
            if id(c) in self.excluded:
                continue
            if is_noise(c):
                self.assets(c)
                continue
            flush()
            out += self.block(c, depth)
        flush()
        return out

    def block(self, node: Element, depth: int) -> list[str]:
        tag = node.tag
        if _HEADING.fullmatch(tag):
            text = re.sub(r"\s+", " ", "".join(self.inline(c) for c in node.children)).strip()
            return [f"{'#' * int(tag[1])} {text}"] if text else []
        if tag == "pre":
            code = node.text(frozenset()).strip("\n")
            language = code_language(node)
            self.code.append((language, code))
            longest = max((len(m) for m in re.findall(r"`+", code)), default=0)
            fence = "`" * max(3, longest + 1)
            return [f"{fence}{language or ''}\n{code}\n{fence}"]
        if tag == "blockquote":
            return ["\n".join(f"> {line}" for line in "\n\n".join(self.blocks(node, depth)).split("\n"))]
        if tag in ("ul", "ol"):
            lines, number = [], 1
            for c in node.children:
                if isinstance(c, Element) and c.tag in ("li", "ul", "ol"):
                    inner = self.blocks(c, depth + 1) if c.tag == "li" else self.block(c, depth + 1)
                    if not inner:
                        continue
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    body = "\n".join(inner).split("\n")
                    lines += [mark + body[0], *("  " + x for x in body[1:])]
            return ["\n".join(lines)] if lines else []
        if tag == "table":
            return self.table(node, depth)
        if tag == "hr":
            return ["---"]
        return self.blocks(node, depth)

    def table(self, node: Element, depth: int) -> list[str]:
        rows = [r for r in node.find("tr") if next(iter(_tables(r)), None) is node]
        cells = [[c for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in rows]
        if any(x.tag in BLOCK - {"p", "td", "th", "tr"} for row in cells for c in row for x in c.walk() if x is not c):
            return [b for row in cells for c in row for b in self.blocks(c, depth)]  # a layout table
        lines = [[re.sub(r"\s+", " ", "".join(self.inline(x) for x in c.children)).strip().replace("|", "\\|") for c in row] for row in cells if row]
        if not lines:
            return []
        width = max(map(len, lines))
        text = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in lines]
        headed = any(c.tag == "th" for c in cells[0])
        return ["\n".join([text[0], "|" + " --- |" * width, *(text[1:] if headed else text)])]


def _tables(node: Element) -> Iterator[Element]:
    up = node.parent
    while up is not None:
        if up.tag == "table":
            yield up
        up = up.parent


def announcements(root: Element) -> list[str]:
    """Texts of regions that are labelled as announcements, as quoted lines."""
    found = (n for n in root.walk() if n.attrs.get("role") == "region" and "announcement" in n.attrs.get("aria-label", "").lower())
    return [f"> **{t}**" for n in found if (t := re.sub(r"\s+", " ", n.text()).strip())]


def hero(root: Element, text: str) -> str | None:
    """A paragraph of 40 to 300 bytes near the h1 that the text lacks."""
    h1 = next(root.find("h1"), None)
    up = h1.parent if h1 is not None else None
    for _ in range(4):
        if up is None or up.tag in ("body", "html", "document"):
            return None
        for i, p in enumerate(up.find("p")):
            body = re.sub(r"\s+", " ", p.text()).strip()
            if i > 50:
                break
            if 40 <= size(body) <= 300 and body not in text:
                return body
        up = up.parent
    return None


def _squeezed(node: Element) -> str:
    return _SPACE.sub(" ", node.text()).strip()


def section_headings(root: Element, text: str) -> str:
    """*text* with the h2 headings that furniture rules took from sections whose text it has, and the short lines (up to 80 bytes) above headings."""
    for h2 in root.find("h2"):
        title = _squeezed(h2)
        ups = list(_ancestors(h2))
        if not title or title in text or any(u.tag in ("nav", "aside", "header", "footer") for u in ups):
            continue
        home = next((u for u in ups if u.tag in ("section", "article", "main", "body")), None)
        for n in home.walk() if home is not None else ():
            if n.tag in ("p", "h3", "h4") and len(t := _squeezed(n)) > 15 and t not in title and (at := text.find(t)) >= 0:
                start = text.rfind("\n", 0, at) + 1
                while start:  # short lines before it, such as a number, belong to the section too
                    above = text[:start].rstrip("\n").rpartition("\n")[2]
                    if not above or len(above) > 25 or above.startswith("#"):
                        break
                    start = len(text[:start].rstrip("\n")) - len(above)
                text = f"{text[:start]}## {title}\n\n{text[start:]}"
                break
    for h2 in root.find("h2"):
        title = _squeezed(h2)
        at = text.find(title) if title else -1
        if at < 0:
            continue
        for c in h2.parent.children:
            if c is h2:
                break
            if isinstance(c, Element) and c.tag == "p" and (t := _squeezed(c)) and size(t) <= 80 and not t.startswith("/") and t not in strip_markdown(text):
                start = text.rfind("\n", 0, text.find(title)) + 1
                text = f"{text[:start]}*{t}*\n\n{text[start:]}"
    return text


#: Headings of footers that name only the footer, class words of headings for screen readers, and what links worth keeping lead to.
FOOTER_NAMES, HIDDEN_WORDS, CALLS = ("footer", "navigation", "site map"), ("sr-only", "visually-hidden", "screen-reader"), ("docs.", "/docs", "app.", "/app", "api.")


def footer_calls(root: Element, render: Markdown, text: str) -> str:
    """*text* with the headings of footers and their links to documentation, applications and interfaces that it lacks."""
    for footer in root.find("footer"):
        for h2 in footer.find("h2"):
            title = _squeezed(h2)
            if title and title not in text and title.lower() not in FOOTER_NAMES and not any(w in h2.attrs.get("class", "").lower() for w in HIDDEN_WORDS):
                text = f"{text}\n\n## {title}".strip()
        for a in footer.find("a"):
            label, href = _squeezed(a), render.url(a.attrs.get("href", ""))
            if label and href and label not in text and any(c in href.lower() for c in CALLS):
                text = f"{text}\n\n[{label}]({href})".strip()
                render.links.append((label, href))
    return text


_LITERAL = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|new Date\(([^()]*)\)|[A-Za-z_$][\w$]*(?:\s+0)?|,(?=\s*[\]}])", re.S)


def literal_json(source: str) -> object:
    """The value of a JavaScript literal of objects, lists, strings and numbers; raises ValueError where it is more."""

    def one(m: re.Match) -> str:
        t = m.group(0)
        if t == ",":
            return ""
        if t[0] == '"':
            return t
        if t[0] in "'`":
            return json.dumps(re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e.group(1), e.group(1)), t[1:-1]))
        if m.group(1) is not None:
            return m.group(1) or "null"
        if t in ("true", "false", "null"):
            return t
        if t == "undefined" or re.fullmatch(r"void\s+0", t):
            return "null"
        return json.dumps(t)

    return json.loads(_LITERAL.sub(one, source))


def balanced(text: str, start: int) -> str | None:
    """The bracketed part that begins at *start*, strings passed over; None if it never ends."""
    depth = 0
    for m in re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|[\[\]{}()]", re.S).finditer(text, start):
        t = m.group(0)
        if len(t) == 1:
            depth += 1 if t in "[{(" else -1
            if not depth:
                return text[start : m.end()]
    return None


def started_data(html: str) -> list[str]:
    """What an application's start call hands over as data: each part as JSON, taken out of its wrapping; nothing where it isn't a literal."""
    out = []
    for m in re.finditer(r"kit\.start\(", html):
        at = re.compile(r"\bdata\s*:\s*(?=\[)").search(html, m.end())
        body = balanced(html, at.end()) if at else None
        if body and size(body) >= 20:
            try:
                found = literal_json(body)
            except ValueError:
                continue
            out += [json.dumps(x["data"] if isinstance(x, dict) and "data" in x else x, ensure_ascii=False) for x in found if x is not None]
    return out


def footer_links(root: Element, render: Markdown) -> str | None:
    """The categories of a footer's site map, if there are three or more with 2 to 20 links each."""
    parts = []
    for footer in root.find("footer"):
        for group in (n for n in footer.walk() if n.tag in ("ul", "div", "section", "nav")):
            own = [c for c in group.children if isinstance(c, Element)]
            links = [a for c in own for a in c.find("a") if a.attrs.get("href")]
            head = next((h for c in own for h in c.find("h2", "h3", "h4", "h5", "h6")), None)
            if head is not None and 2 <= len(links) <= 20 and sum(1 for h in group.find("h2", "h3", "h4", "h5", "h6")) == 1:
                lines = [f"- [{re.sub(chr(92) + 's+', ' ', a.text()).strip()}]({render.url(a.attrs['href'])})" for a in links]
                parts.append(f"### {head.text().strip()}\n\n" + "\n".join(lines))
    return "\n\n".join(dict.fromkeys(parts)) if len(set(parts)) >= 3 else None


def data_islands(html: str, text: str, depth: int = 15, most: int = 1000) -> list[str]:
    """Readable strings of embedded JSON (50 bytes and more) that the text lacks: sentences, with the heading of their object."""
    out: dict[str, None] = {}

    def walk(value: object, level: int) -> None:
        if level > depth or len(out) >= most:
            return
        if isinstance(value, dict):
            head = value.get("title") or value.get("heading")
            if isinstance(head, str) and 3 < len(head) < 120 and head not in text and any(isinstance(value.get(k), str) and len(value[k].split()) > 5 for k in ("body", "text", "description", "content")):
                out.setdefault(f"## {head}")
            for v in value.values():
                walk(v, level + 1)
        elif isinstance(value, list):
            for v in value:
                walk(v, level + 1)
        elif isinstance(value, str):
            plain = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", value)).strip()
            if len(plain.split()) > 5 and plain not in text and not re.search(r"[{};]|https?://\S+$|function\s*\(", plain):
                out.setdefault(plain)

    for m in re.finditer(r"<script[^>]*type=[\"']application/json[\"'][^>]*>(.*?)</script>", html, re.S | re.I):
        if size(m.group(1)) >= 50:
            try:
                walk(json.loads(m.group(1)), 0)
            except ValueError:
                continue
    return list(out)


def captions(xml: str) -> str:
    """Timed text as one transcript."""
    import html as entities

    return " ".join(filter(None, (re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", entities.unescape(entities.unescape(x)))).strip() for x in re.findall(r"<text[^>]*>(.*?)</text>", xml, re.S))))


_IMAGE_MARK, _LINK_MARK = re.compile(r"!\[([^\]]*)\]\([^)]*\)"), re.compile(r"\[([^\]]*)\]\([^)]*\)")
_LINE_MARK, _TEXT_MARK = re.compile(r"^(?:#{1,6} |> |```.*$)", re.M), re.compile(r"\*\*|(?<!\w)\*|\*(?!\w)|`")


def strip_markdown(text: str) -> str:
    if "](" in text:
        text = _LINK_MARK.sub(r"\1", _IMAGE_MARK.sub(r"\1", text))
    text = _LINE_MARK.sub("", text)
    return _TEXT_MARK.sub("", text) if "*" in text or "`" in text else text


def json_ld(html: str) -> list[str]:
    """Valid JSON-LD objects of a page; arrays are taken apart, raw line ends in strings repaired, broken ones left out."""
    out = []
    for m in re.finditer(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html, re.S | re.I):
        for body in (m.group(1), re.sub(r"[\r\n\t]+", " ", m.group(1))):
            try:
                data = json.loads(body)
            except ValueError:
                continue
            out += [json.dumps(x, ensure_ascii=False) for x in (data if isinstance(data, list) else [data])]
            break
    m = re.search(r'<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', html, re.S)
    if m and size(m.group(1)) >= 20:
        try:
            data = json.loads(m.group(1))
            out.append(json.dumps(data.get("props", {}).get("pageProps") or data, ensure_ascii=False))
        except (ValueError, AttributeError):
            pass
    return out + (started_data(html) if "kit.start(" in html else [])


def extract(html: str | None, url: str | None = None, include: str | None = None, exclude: str | None = None, only_main: bool = False) -> dict:
    """One page. Null or blank HTML gives an error and no content; nothing raises."""
    empty = dict.fromkeys(n.split()[0] for n in re.sub(r"<[^<>]*(?:<[^<>]*>)?[^<>]*>", "", SCHEMA).split(", "))
    if not html or not html.strip():
        return empty | {"error": "empty html", "word_count": 0, "links": [], "images": [], "code_blocks": [], "structured_data": []}
    root = parse(html)
    meta = {}
    for n in root.find("meta"):
        name = (n.attrs.get("property") or n.attrs.get("name") or "").lower()
        if name and n.attrs.get("content"):
            meta.setdefault(name, n.attrs["content"].strip())
    title = meta.get("og:title") or meta.get("twitter:title") or next((t.text().strip() for t in root.find("title") if t.text().strip()), None)
    icon = next((n.attrs.get("href") for n in root.find("link") if "icon" in n.attrs.get("rel", "").lower()), None)
    language = next((n.attrs.get("lang") for n in root.find("html") if n.attrs.get("lang")), None)
    date = meta.get("article:published_time") or meta.get("date") or next((n.attrs.get("datetime") for n in root.find("time") if n.attrs.get("datetime")), None)
    dropped = {id(x) for n in (select(root, exclude) if exclude else []) for x in n.walk()}
    body = next(root.find("body"), root)

    def render(nodes: list[Element]) -> tuple[Markdown, str]:
        md = Markdown(url or "", dropped)
        return md, "\n\n".join(b if b.startswith("```") else re.sub(r"\n{3,}", "\n\n", b) for n in nodes for b in md.blocks(n)).strip()

    known: dict[str, int] = {}

    def words(t: str) -> int:
        if t not in known:
            known[t] = len(strip_markdown(t).split())
        return known[t]

    if include:
        chosen = select(root, include)
        md, text = render([n for n in chosen if not any(up in chosen for up in _ancestors(n))])
    else:
        node = next(root.find("article", "main"), None) if only_main else None
        md, text = render([node or main_node(root)])
        if words(text) < 30 and only_main:
            md, text = render([main_node(root)])
        if words(text) < 200:  # a poor choice shows where the whole body has far more
            wide, whole = render([body])
            if words(whole) > 2 * words(text) and words(whole) > 50:
                md, text = wide, whole
        h1 = next((re.sub(r"\s+", " ", h.text()).strip() for h in root.find("h1")), "")
        if h1 and h1 not in text:
            text = f"# {h1}\n\n{text}".strip()
        lead = hero(root, text)
        if lead and h1:
            text = text.replace(f"# {h1}", f"# {h1}\n\n{lead}", 1)
        text = "\n\n".join(filter(None, [*(a for a in announcements(root) if a not in text), text]))
        if words(text) < 500:
            text = "\n\n".join(filter(None, [text, *data_islands(html, text)]))
        text = section_headings(root, text) if "h2" in root.index else text
        if not only_main:
            text = footer_calls(root, md, text)
        site_map = footer_links(root, md)
        if site_map and not only_main:
            text = f"{text}\n\n{site_map}".strip()
    plain = strip_markdown(text)
    unique = list(dict.fromkeys(md.links))
    return {
        "error": None, "title": title, "description": meta.get("og:description") or meta.get("twitter:description") or meta.get("description"), "author": meta.get("author") or meta.get("article:author"), "published_date": date, "language": language,
        "site_name": meta.get("og:site_name"), "image": meta.get("og:image"), "favicon": icon, "word_count": len(plain.split()), "markdown": text, "plain_text": plain,
        "links": [{"text": t, "href": h} for t, h in unique], "images": [{"alt": a, "src": s} for a, s in dict.fromkeys(md.images)], "code_blocks": [{"language": lang, "code": c} for lang, c in md.code], "structured_data": json_ld(html),
    }


def _ancestors(node: Element) -> Iterator[Element]:
    up = node.parent
    while up is not None:
        yield up
        up = up.parent


@contextmanager
def deadline(seconds: float) -> Iterator[None]:
    """Raise TimeoutError in the main thread of a worker after so many seconds; elsewhere there is no limit."""
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        yield
        return

    def over(*_: object) -> None:
        raise TimeoutError(f"longer than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


#: Seconds that one page may take.
PAGE_SECONDS = 5.0


def extract_pages(df: DataFrame, key: str = "fetch_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """Rows (*key*, url, fields of SCHEMA): one for each row of *df*; a page that can't be read has its error instead of failing the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for u, h in zip(pdf["_url"], pdf["_html"]):
                try:
                    with deadline(PAGE_SECONDS):
                        rows.append(extract(h, u, **options))
                except (RecursionError, ValueError, TimeoutError) as e:
                    rows.append(extract(None) | {"error": str(e)[:200]})
            yield pd.DataFrame(rows).assign(_key=pdf["_key"].to_numpy(), _url=pdf["_url"].to_numpy())

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html")).mapInPandas(run, f"{SCHEMA}, _key {kind}, _url string")
    return out.withColumnsRenamed({"_key": key, "_url": url})
