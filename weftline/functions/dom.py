"""A lenient HTML tree on the standard library: void and raw elements, implied end tags, unclosed formatting carried into later blocks.

One pass over the page makes the tree, one pass backwards over its nodes sums up
what each holds (bytes of text, of white space at its ends, of link text, number
of paragraphs, whether there are blocks), so that no subtree is walked again for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}}
_SCOPE = frozenset("table td th ul ol dl html body".split())
_STOP = {tag: _SCOPE - {tag} - closed for tag, closed in _IMPLIED.items()}
_UNSEEN = frozenset(("script", "style", "template", "noscript"))
_RAW = frozenset(("script", "style"))
_RAW_TEXT = frozenset(("title", "textarea"))
_NEVER_FORMATTED = BLOCK | {"script", "style", "meta", "link", "title"}
_CELLS = frozenset(("table", "td", "th"))
_ENDS_IN_CELL = frozenset(("table", "tr", "tbody", "body", "html"))

#: A comment, a declaration, an end tag, or a start tag with its attributes; quantifiers don't backtrack.
_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|/([a-zA-Z][^\s>/]*+)[^>]*+>|([a-zA-Z][^\s/>]*+)((?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+'))*+[^>\"']*+|[^>]*+)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Element:
    __slots__ = ("tag", "raw", "_attrs", "children", "parent", "size", "lead", "trail", "linked", "paragraphs", "blocky", "noise", "index")

    def __init__(self, tag: str, raw: str = "", parent: Element | None = None):
        self.tag, self.raw, self.children, self.parent = tag, raw, [], parent
        self._attrs: dict[str, str] | None = None
        self.size = self.lead = self.trail = self.linked = self.paragraphs = 0
        self.blocky = tag in BLOCK
        self.noise: bool | None = None
        self.index: dict[str, list[Element]] | None = None  # of the root: its elements by tag, in document order

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            found: dict[str, str] = {}
            for name, a, b, c in _ATTRIBUTE.findall(self.raw) if self.raw else ():
                value = a or b or c
                found[name.lower()] = unescape(value) if "&" in value else value
            self._attrs = found
        return self._attrs

    def walk(self) -> Iterator[Element]:
        if self.index is not None:
            yield from self.index["*"]
            return
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def text(self, skip: frozenset = _UNSEEN) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                todo.extend(reversed(node.children))
        return "".join(out)

    def find(self, *tags: str) -> Iterator[Element]:
        if self.index is not None and len(tags) == 1:
            return iter(self.index.get(tags[0], ()))
        return (n for n in self.walk() if n.tag in tags)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").lower().split() if self.raw else []


def _measure(nodes: list[Element]) -> None:
    """Sums of all nodes, the last one first, so that children come before their parents."""
    for node in reversed(nodes):
        size = lead = 0
        linked, paragraphs, blocky, only_space = 0, 0, node.blocky, True
        trail = 0
        for c in node.children:
            if isinstance(c, str):
                n = len(c) if c.isascii() else len(c.encode("utf-8", "surrogatepass"))
                if c.isspace():
                    if only_space:
                        lead += n
                    trail += n
                else:
                    if only_space:
                        lead += len(c) - len(c.lstrip())
                        only_space = False
                    trail = len(c) - len(c.rstrip())
                size += n
                continue
            blocky = blocky or c.blocky
            paragraphs += c.paragraphs + (c.tag == "p")
            if c.tag in _UNSEEN:
                continue
            linked += c.linked + (c.size if c.tag == "a" else 0)
            if c.size:
                size += c.size
                if c.lead == c.size:
                    if only_space:
                        lead += c.size
                    trail += c.size
                else:
                    if only_space:
                        lead += c.lead
                        only_space = False
                    trail = c.trail
        node.size, node.lead, node.trail, node.linked, node.paragraphs, node.blocky = size, lead, trail, linked, paragraphs, blocky


def parse(html: str, depth: int = 200) -> Element:
    """The tree of a page; whatever can't be read as markup is text, nesting beyond *depth* is flattened."""
    root = Element("document")
    nodes = [root]
    opened = [root]
    formatting: list[Element] = []
    paragraphs = 0  # open p elements
    at, end = 0, len(html)

    def cut(i: int) -> None:
        nonlocal paragraphs
        for e in opened[i:]:
            if e.tag == "p":
                paragraphs -= 1
        del opened[i:]

    def close_to(tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(opened) - 1, 0, -1):
            tag = opened[i].tag
            if tag in tags:
                cut(i)
                return
            if tag in stop:
                return

    def reopen() -> None:
        """Formatting that was open when its block ended goes on in the next one; at most three alike."""
        for k, old in enumerate(formatting):
            if len(opened) < depth and not any(e is old for e in opened):
                again = Element(old.tag, old.raw, opened[-1])
                opened[-1].children.append(again)
                nodes.append(again)
                opened.append(again)
                formatting[k] = again

    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            data = html[at:stop]
            if formatting and not data.isspace():
                reopen()
            opened[-1].children.append(unescape(data) if "&" in data else data)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag:
            tag = tag.lower()
            raw = m.group(3)
            closed = raw.endswith("/")
            if paragraphs and tag in BLOCK:
                close_to({"p"}, _CELLS)
            if tag in _IMPLIED:
                for _ in range(2 if tag in ("tbody", "tr") else 1):
                    close_to(_IMPLIED[tag], _STOP[tag])
            if formatting and tag not in _NEVER_FORMATTED:
                reopen()
            node = Element(tag, raw, opened[-1])
            opened[-1].children.append(node)
            nodes.append(node)
            if tag in VOID or closed and tag not in BLOCK:
                continue
            if tag in _RAW or tag in _RAW_TEXT:
                over = re.compile(rf"</{tag}(?=[\s>/])", re.I).search(html, at)
                data = html[at : over.start() if over else end]
                if data:
                    node.children.append(unescape(data) if tag in _RAW_TEXT and "&" in data else data)
                at = html.find(">", over.end()) + 1 if over else end
                at = at or end
                continue
            if len(opened) < depth:
                opened.append(node)
                if tag == "p":
                    paragraphs += 1
                if tag in FORMATTING:
                    same = [f for f in formatting if f.tag == tag and f.raw == raw]
                    if len(same) >= 3:
                        formatting.remove(same[0])
                    formatting.append(node)
            continue
        tag = m.group(1)
        if not tag:
            continue
        tag = tag.lower()
        if formatting and tag in FORMATTING:
            for k in range(len(formatting) - 1, -1, -1):
                if formatting[k].tag == tag:
                    del formatting[k]
                    break
        for i in range(len(opened) - 1, 0, -1):
            name = opened[i].tag
            if name == tag:
                cut(i)
                break
            if name in _CELLS and tag not in _ENDS_IN_CELL:
                break
    _measure(nodes)
    root.index = {"*": nodes}
    for node in nodes:
        root.index.setdefault(node.tag, []).append(node)
    return root


_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")


def _matches(node: Element, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m:
        raise ValueError(f"selector not supported: {step!r}")
    if m.group(1) not in (None, "*") and node.tag != m.group(1).lower():
        return False
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m.group(2)):
        if part[0] == "." and part[1:].lower() not in node.classes():
            return False
        if part[0] == "#" and node.attrs.get("id") != part[1:]:
            return False
        if part[0] == "[":
            name, op, value = re.fullmatch(r"\[\s*([\w-]+)\s*(?:([*^$~]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]", part).groups()
            have = node.attrs.get(name)
            if have is None or not {None: True, "=": have == value, "*=": value in have if value else False, "^=": have.startswith(value or "\0"), "$=": have.endswith(value or "\0"), "~=": value in have.split() if value else False}[op]:
                return False
    return True


def select(root: Element, selector: str) -> list[Element]:
    """Elements that match a list of selectors of tags, classes, ids and attributes with descendant and child combinators, in document order."""
    chains = [re.sub(r"\s*>\s*", " > ", s.strip()).split() for s in selector.split(",") if s.strip()]

    def holds(node: Element | None, chain: list[str]) -> bool:
        if node is None or not _matches(node, chain[-1]):
            return False
        rest = chain[:-1]
        if not rest:
            return True
        if rest[-1] == ">":
            return holds(node.parent, rest[:-1])
        up = node.parent
        while up is not None:
            if holds(up, rest):
                return True
            up = up.parent
        return False

    return [n for n in root.walk() if any(holds(n, c) for c in chains)]
