"""Problem 5: left-over HTML, Markdown, wiki and LaTeX markup, found and turned into clean text.

What counts as markup is told by its syntax outside code and formulas.  A text
with markup is converted: wiki and LaTeX by rewriting, HTML through a tree whose
containers are scored as page extractors do (paragraphs pass points for length
and commas to their ancestors, discounted by link density; the best container
and the siblings that hold text are kept).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML, with those that wiki dialects add.
ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav noframes noscript object ol optgroup option output p "
    "param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr"
)
WIKI_ELEMENTS = "ref references nowiki gallery includeonly noinclude onlyinclude math poem syntaxhighlight"

_ATTRIBUTES = r"(?:\s+[^<>\s=\"'/]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^<>\s\"']+))?)*\s*/?"
_TAG = re.compile(rf"<!--|<!doctype\b|</?(?:{'|'.join(ELEMENTS.split())}){_ATTRIBUTES}>", re.I)
_WIKI_TAG = re.compile(rf"</?(?:{'|'.join(WIKI_ELEMENTS.split())}){_ATTRIBUTES}>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_WIKI = re.compile(r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]*\}\}|^\{\|.*$|^\|\}[ \t]*$|^(={2,6})[^=\n]+\1[ \t]*$|'{2,5}(?=[^'\s])[^'\n]+?'{2,5}|\[https?://[^\s\]]+ [^\]\n]+\](?!\()", re.M)
_LATEX = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|^[ \t]*\\item\b|\\\\(?:\[\d[\d.]*[a-z]{2}\])?[ \t]*$|\\(?:maketitle|tableofcontents|noindent|newpage|bigskip|medskip|smallskip|hline|centering)\b", re.M)
_MARKDOWN = re.compile(
    r"^ {0,3}#{1,6}[ \t]+\S|(?<![\w*])\*\*(?=\S)[^*\n]+\*\*|(?<!\w)__(?=\S)[^_\n]+?__(?!\w)|(?<![\w*])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])|~~(?=\S)[^~\n]+~~"
    r"|!?\[[^\[\]\n]*\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)|^ {0,3}>[ \t]?\S|^ {0,3}(?:```|~~~)|`[^`\n]+`|^[ \t]*(?:\|[ \t]*)?:?-{3,}:?[ \t]*\|[ \t:|-]*$|^(?=[^\n]*\S)[^\n]+\n(?:={3,}|-{3,})[ \t]*$|^\[[^\]\n]+\]:[ \t]+\S+",
    re.M,
)
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)([^\n`]*)$", re.M)
_PROTECTED = re.compile(r"^ {0,3}(```+|~~~+).*?(?:^ {0,3}\1[^\S\n]*$|\Z)|\$\$.*?\$\$|``[^\n]+?``|`[^`\n]+`", re.M | re.S)


def _fenced_start(text: str) -> str:
    """A text cut inside a code block begins with code: give it the opening fence it lost."""
    fences = _FENCE.findall(text)
    return f"{fences[0][0]}\n{text}" if len(fences) % 2 and not fences[0][1].strip() else text


def _outside(text: str) -> str:
    """The text without code blocks, code spans and display formulas."""
    if "`" in text or "~~~" in text:
        text = _fenced_start(text)
    elif "$$" not in text:
        return text
    return _PROTECTED.sub(" ", text)


def _html(text: str) -> bool:
    if "<" in text and _TAG.search(text):
        return True
    return "&" in text and any(m.group(1) is None or m.group(1) + ";" in html5 for m in _ENTITY.finditer(text))


def kinds(text: str | None, plain: bool = False, markdown: str | None = None) -> list[str]:
    """Which markup a text holds: of html, latex, markdown, wiki. Null and empty hold none.

    Markdown counts only in *plain* text, where *markdown* is the same record's
    Markdown: the code it shows in fences is code in the plain text too.
    """
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    found = _kinds(text, plain)
    if found and plain and markdown and ("```" in markdown or "~~~" in markdown):
        code = {line.strip() for m in _PROTECTED.finditer(markdown.replace("\r\n", "\n")) for line in m.group(0).split("\n")[1:-1]}
        found = _kinds("\n".join(x for x in text.split("\n") if not x.strip() or x.strip() not in code), plain)
    return found


def _kinds(text: str, plain: bool) -> list[str]:
    out = []
    body = _outside(text)
    if _html(body):
        out.append("html")
    if "\\" in body and _LATEX.search(body):
        out.append("latex")
    if plain and _MARKDOWN.search(re.sub(r"\$\$.*?\$\$", " ", text, flags=re.S) if "$$" in text else text):
        out.append("markdown")
    if ("[" in body or "{" in body or "''" in body or "==" in body) and _WIKI.search(body) or "<" in body and _WIKI_TAG.search(body):
        out.append("wiki")
    return out


# -- conversion ---------------------------------------------------------------

_SECTION = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_ENVIRONMENT_MATH = re.compile(r"\\begin\{(equation|align|displaymath|gather)\*?\}(.*?)\\end\{\1\*?\}", re.S)
_ENVIRONMENT_CODE = re.compile(r"\\begin\{(verbatim|lstlisting)\}(?:\[[^\]]*\])?\n?(.*?)\n?\\end\{\1\}", re.S)


def clean_latex(text: str) -> str:
    text = _ENVIRONMENT_MATH.sub(lambda m: f"$$ {m.group(2).strip()} $$", text)
    text = _ENVIRONMENT_CODE.sub(lambda m: f"```\n{m.group(2)}\n```", text)
    text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "#" * _SECTION[m.group(1)] + " " + m.group(2), text)
    text = re.sub(r"(?<![ \t])[ \t]*~?\\(?:cite|citep|citet|ref|eqref|pageref|label|index|vspace|hspace|usepackage|documentclass|bibliographystyle|bibliography|includegraphics)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", text)
    text = re.sub(r"^[ \t]*\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\]|\{[^{}]*\})*[ \t]*\n?", "", text, flags=re.M)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}", "", text)
    text = re.sub(r"^([ \t]*)\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: f"{m.group(1)}- " + (f"{m.group(2)} " if m.group(2) else ""), text, flags=re.M)
    text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
    n = 1
    while n:  # from the inside out, however deep
        text, n = re.subn(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\\\(?:\[\d[\d.]*[a-z]{2}\])?[ \t]*(?=\n|$)", "", text)
    text = re.sub(r"\\(?:maketitle|tableofcontents|noindent|newpage|bigskip|medskip|smallskip|hline|centering)\b[ \t]*", "", text)
    return re.sub(r"\\([%&_#{}$])", r"\1", text)


def clean_wiki(text: str) -> str:
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", "", text, flags=re.S | re.I)
    n = 1
    while n:
        text, n = re.subn(r"(?<![ \t])[ \t]*\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"^\{\|.*?^\|\}[ \t]*$", _wiki_table, text, flags=re.M | re.S)
    text = re.sub(r"\[\[(?:category|kategorie|catégorie|categoría|categoria|категория|file|image):[^\[\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", text)
    text = re.sub(r"\[https?://[^\s\]]+ ([^\]\n]+)\](?!\()", r"\1", text)
    text = re.sub(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), text, flags=re.M)
    text = re.sub(r"'{2,5}(?=[^'\s])([^'\n]+?)'{2,5}", r"\1", text)
    text = re.sub(r"^\*+[ \t]*(?=\S)", lambda m: "  " * (m.group(0).count("*") - 1) + "- ", text, flags=re.M)
    return _WIKI_TAG.sub("", text)


def _wiki_table(m: re.Match) -> str:
    rows: list[list[str]] = [[]]
    for line in m.group(0).split("\n")[1:-1]:
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in "|!":
            for cell in re.split(r"\|\||!!", line[1:]):
                rows[-1].append(cell.rsplit("|", 1)[-1].strip())
    return "\n".join("| " + " | ".join(r) + " |" for r in rows if r)


_BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_PART = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)({_ATTRIBUTES})>", re.S)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "score")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent, self.score = tag, attrs, [], parent, 0.0

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style", "template"):
                todo.extend(reversed(node.children))
        return "".join(out)


def parse(text: str, depth: int = 200) -> Node:
    """A lenient tree: unknown end tags are dropped, missing ones implied; nesting beyond *depth* is flattened."""
    root = node = Node("body")
    at, level = 0, 0
    raw_until = None
    for m in _PART.finditer(text):
        if raw_until and not (m.group(1) and m.group(2).lower() == raw_until):
            continue
        if m.start() > at:
            node.children.append(text[at : m.start()])
        at = m.end()
        raw_until = None
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                while node is not up.parent:
                    node, level = node.parent, level - 1
            continue
        while node.tag in _CLOSES.get(tag, ()) or (node.tag == "p" and tag in _BLOCKS):
            node, level = node.parent, level - 1
        child = Node(tag, m.group(3) or "", node)
        node.children.append(child)
        if tag not in _VOID and not (m.group(3) or "").endswith("/") and level < depth:
            node, level = child, level + 1
            if tag in ("script", "style"):
                raw_until = tag
    if at < len(text):
        node.children.append(text[at:])
    return root


def link_density(node: Node) -> float:
    total = len(node.text().strip())
    return sum(len(n.text()) for n in node.walk() if n.tag == "a") / total if total else 0.0


def score(root: Node) -> Node:
    """Points of paragraphs passed to parent and grandparent, discounted by link density; the best container."""
    for node in root.walk():
        own = "".join(c for c in node.children if isinstance(c, str)) if node.tag not in ("p", "pre", "td", "blockquote") else node.text()
        size = len(own.strip())
        if size < 25 or node.tag in ("a", "script", "style"):
            continue
        points = 1 + own.count(",") + own.count("，") + own.count("、") + min(size / 100, 3)
        target, share = (node.parent if node.tag in ("p", "pre", "td", "blockquote") else node), 1.0
        for _ in range(2):
            if target is None:
                break
            target.score += points * share
            target, share = target.parent, 0.5
    best = root
    for node in root.walk():
        node.score *= 1 - link_density(node) if node.score else 0
        if node.score > best.score:
            best = node
    return best


def _drop_links(root: Node) -> None:
    """Keep the best container and, of its siblings and those of its ancestors, what holds text of its own and not just links."""
    best = score(root)
    node: Node | None = best
    while node is not None and node.parent is not None:
        up = node.parent
        up.children = [c for c in up.children if c is node or isinstance(c, str) or c.tag not in _BLOCKS or c.score >= 0.2 * best.score > 0 or c.tag[:1] == "h" or link_density(c) <= 0.5]
        node = up


def render(node: Node | str, out: list[str], pre: bool = False) -> None:
    if isinstance(node, str):
        out.append(unescape(node) if pre or "\n" in node else unescape(re.sub(r"[ \t]+", " ", node)))
        return
    tag = node.tag
    if tag in ("script", "style", "template"):
        return
    if tag == "br":
        out.append("\n")
    elif tag == "hr":
        out.append("\n\n")
    elif tag == "img":
        alt = re.search(r"alt\s*=\s*(\"[^\"]*\"|'[^']*')", node.attrs)
        out.append(unescape(alt.group(1)[1:-1]) if alt else "")
    elif tag == "pre":
        out.append("\n\n```\n" + unescape(node.text()).strip("\n") + "\n```\n\n")
    elif tag in ("code", "kbd", "samp", "tt") and not pre:
        body = unescape(node.text())
        out.append(f"`{body}`" if body.strip() and "`" not in body else body)
    else:
        head = {"li": "\n- ", "tr": "\n| "}.get(tag) or ("\n\n" + "#" * int(tag[1]) + " " if re.fullmatch(r"h[1-6]", tag) else "\n" if tag in _BLOCKS and tag not in ("td", "th") else "")
        out.append(head)
        for child in node.children:
            render(child, out, pre)
        out.append(" | " if tag in ("td", "th") and node.parent is not None and node.parent.tag == "tr" else "\n" if tag in _BLOCKS and tag not in ("td", "th", "li", "tr") else "")


def clean_html(text: str) -> str:
    root = parse(text)
    if sum(isinstance(c, Node) and c.tag in _BLOCKS for c in root.children):
        _drop_links(root)
    out: list[str] = []
    render(root, out)
    return "".join(out)


_PLACE = "\ue000{}\ue001"


def clean(text: str | None, found: list[str], plain: bool = False) -> str | None:
    """The text without the markup *found* in it; headings, lists, tables, code and formulas stay, in the marks of Markdown."""
    if not text or not found:
        return text
    text = _fenced_start(text.replace("\r\n", "\n").replace("\r", "\n"))
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m.group(0))
        return _PLACE.format(len(kept) - 1)

    text = _PROTECTED.sub(keep, text)
    if "latex" in found:
        text = _PROTECTED.sub(keep, clean_latex(text))
    if "wiki" in found:
        text = clean_wiki(text)
    if "html" in found:
        while True:  # markup that was escaped, once or more often, shows only now
            before, text = text, clean_html(text)
            if text == before or not _html(text):
                break
        text = _PROTECTED.sub(keep, text)
    if plain and "markdown" in found:
        text = re.sub(r"^ {0,3}#{1,6}[ \t]+([^\n]*)$", lambda m: m.group(1).rstrip().rstrip("#").rstrip(), text, flags=re.M)
        text = re.sub(r"^((?=[^\n]*\S)[^\n]+)\n(?:={3,}|-{3,})[ \t]*$", r"\1", text, flags=re.M)
        text = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", text)
        text = re.sub(r"^[ \t]*(?:\|[ \t]*)?:?-{3,}:?[ \t]*\|[ \t:|-]*\n?", "", text, flags=re.M)
        text = re.sub(r"^[ \t]*\|([^\n]*)$", lambda m: "\t".join(c.strip() for c in m.group(1).rstrip().removesuffix("|").split("|")), text, flags=re.M)
        text = re.sub(r"^ {0,3}>[ \t]?", "", text, flags=re.M)
        text = re.sub(r"(\*\*|__|~~)(?=\S)([^*_~\n]+?)\1", r"\2", text)
        text = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])", r"\1", text)
        text = re.sub(r"^\[[^\]\n]+\]:[ \t]+\S+[^\n]*\n?", "", text, flags=re.M)
    while "\ue000" in text:  # what was kept may hold what was kept before
        before, text = text, re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))] if int(m.group(1)) < len(kept) else m.group(0), text)
        if text == before:
            break
    if plain and "markdown" in found:
        text = re.sub(r"^ {0,3}(?:```|~~~)[^\n]*\n?", "", text, flags=re.M)
        text = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<![ \t])[ \t]+$", "", text, flags=re.M)).strip("\n")


def changed(text: str | None, clean_text: str | None) -> bool:
    """Whether conversion took anything away or rewrote it, white space apart."""
    return text is not None and text.split() != (clean_text or "").split()


def clean_markup(df: DataFrame, key: str, columns: dict[str, bool], with_text: bool = True) -> DataFrame:
    """Rows (record_id, kinds array<string>, found boolean, and the clean text of each column).

    *columns* tells for each text column whether it is plain text.  found tells
    whether conversion changed any of the texts.  Null and empty texts hold no
    markup and stay as they are; other texts without markup are returned
    unchanged.  Repeated rows stay repeated; extra columns are ignored.  With
    *with_text* false the texts are converted but not returned.
    """
    names = list(columns)
    reference = next((c for c in names if not columns[c]), None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [pdf[f"c{i}"].tolist() for i in range(len(names))]
            aside = texts[names.index(reference)] if reference else [None] * len(pdf)
            kinds_of = [[kinds(t, columns[c], m) for t, m in zip(texts[i], aside)] for i, c in enumerate(names)]
            done = [[clean(t, k, columns[c]) for t, k in zip(texts[i], kinds_of[i])] for i, c in enumerate(names)]
            out = {"record_id": pdf["_key"], "kinds": [sorted(set().union(*row)) for row in zip(*kinds_of)]}
            out["found"] = [any(k and changed(t, u) for k, t, u in zip(ks, ts, us)) for ks, ts, us in zip(zip(*kinds_of), zip(*texts), zip(*done))]
            if with_text:
                out |= {f"c{i}": done[i] for i in range(len(names))}
            yield pd.DataFrame(out)

    schema = f"record_id {df.schema[key].dataType.simpleString()}, kinds array<string>, found boolean" + "".join(f", c{i} string" for i in range(len(names)) if with_text)
    out = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).mapInPandas(run, schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(names)}) if with_text else out
