"""Problem 6: the furniture of sites told from the main body of pages by wrapper induction.

A page is a shallow tree of blocks and lines.  Labels of a line are its text with
what varies between pages (numbers, link targets, names, the page's own title, the
site's name) made slots.  Lines whose labels are constant over enough pages of a
host, or over hosts, are nodes of its template.  The wrapper of a host is a few of its
pages, so chosen that every node of the template is in one; a page is aligned with
them by simple tree matching, and the lines that are aligned with nodes of the
template are furniture.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, stored
from .markup import Node, _BLOCKS, parse

#: A template node is on at least so many pages (with different titles) of its host, and so large a part of them.
HOST_PAGES, HOST_SHARE = 3, 0.012
#: The same for a node that reads as sentences without the site's name, which copies of a page share too.
PROSE_PAGES, PROSE_SHARE = 8, 0.04
#: A node of the shared template is on pages of at least so many hosts, on so many pages, and on so large a part of the pages of the hosts that have it.
SHARED_HOSTS, SHARED_PAGES, SHARED_SHARE = 3, 6, 0.012
#: The same for sentences: so many hosts and so many different titles, which copies of a page don't reach.
SHARED_PROSE = 8
#: A title that so many different pages of a host have, and so large a part of them, is the site's and doesn't tell copies.
TITLE_PAGES, TITLE_SHARE = 8, 0.2
#: Pages of a host that are aligned in one go, after its representatives.
PART_PAGES = 5_000

_LINK = re.compile(r"!?\[([^\[\]]*)\]\(([^()\s]*)[^()]*\)")
_PURE_LINK = re.compile(r"^(?:[-*+]|\d+[.)])[ \t]+\**\[([^\[\]]*)\]\(([^()\s]*)[^()]*\)\**[ \t]*$")
_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+")
_HEAD = re.compile(r"^(#{1,6})[ \t]+(.*)$")
_TOKEN = re.compile(r"⟦\w⟧|[^\W\d_一-鿿぀-ヿ]+|\d+|\S")
_SENTENCE_END = re.compile(r"[.!?。！？…:;,][\"'”’)»]*$")
_SLOT = "⟦*⟧"


def site_names(host: str | None) -> list[str]:
    """What a site may call itself: the longest label of its host, and the host."""
    if not host:
        return []
    labels = [x for x in host.split(".")[:-1] if x not in ("www", "com", "co", "org")] or [host]
    return [host, max(labels, key=len)] if len(max(labels, key=len)) >= 4 else [host]


class Labeller:
    """Labels of the lines of one page."""

    def __init__(self, host: str | None, title: str | None):
        names = sorted(site_names(host), key=len, reverse=True)
        self.site = re.compile("|".join(map(re.escape, names)), re.I) if names else None
        self.title = re.compile(re.escape(title), re.I) if title and len(title) >= 4 else None

    def labels(self, line: str) -> list[str]:
        """Labels of a line, strongest first; none if it can't be furniture."""
        raw = line.strip()
        if not raw or raw.startswith(("|", "$$", "\\", "<", "&lt;", "{", "[[", "==", "''", "* ''", "!")):
            return []  # tables, formulas and left-over markup are content
        pure = _PURE_LINK.match(raw)
        if pure:
            return ["link " + re.sub(r"\d+", "0", pure.group(2).lower()), "menu " + self._mask(pure.group(1))[1]]
        head = _HEAD.match(raw)
        if head and len(head.group(1)) == 1:
            return []
        if _ITEM.match(raw) and not _LINK.search(raw):
            alone = self._mask(_ITEM.sub("", raw))[1]
            return ["menu " + alone] if alone == "⟦s⟧" else []
        if _ITEM.match(raw) and not re.match(r"^[^:]*$", _LINK.sub("", raw)):
            return []  # a link with its explanation
        text = head.group(2) if head else raw
        bold = bool(re.match(r"^\*\*[^*]+\*\*$", text))
        text = re.sub(r"(?<!\w)[*_]{1,3}|[*_]{1,3}(?!\w)", "", text)
        links = len(_LINK.findall(text))
        flat, masked = self._mask(_LINK.sub(lambda m: "⟦L⟧" + m.group(1), text))
        has_site = "⟦s⟧" in masked
        if head or bold:
            return (["head " + flat] if "0" not in masked.split() else []) + (["line " + masked] if has_site else [])
        tokens = masked.split()
        words = [t for t in tokens if t not in (_SLOT, "0") and any(c.isalpha() for c in t)]
        if not words:
            return []
        out = [("line " if has_site or links or not _SENTENCE_END.search(text) else "prose ") + masked]
        if has_site and len(tokens) > 3:
            out.append("site " + " ".join(tokens[:3]))
        if links and (rest := self._mask(_LINK.sub("", text))[1]) and any(c.isalpha() for c in rest):
            out += ["links " + rest, "head " + self._mask(_LINK.sub("", text).strip(" :："))[0]]
        if len(tokens) >= 4 and not _SENTENCE_END.search(text):  # no sentence: parts of it may be slots of several words
            out += ["gap " + " ".join(tokens[:2]) + " … " + tokens[-1], "ends " + tokens[0] + " … " + " ".join(tokens[-3:])]
            if any(t not in (_SLOT, "0") and t[0].isalpha() for t in tokens[:3]):
                out.append("lead " + " ".join(tokens[:3]))
        return out

    def _mask(self, text: str) -> tuple[str, str]:
        if self.title is not None:
            text = self.title.sub("⟦t⟧", text)
        if self.site is not None:
            text = self.site.sub("⟦s⟧", text)
        tokens = _TOKEN.findall(text)
        caps = text.upper() == text and text.lower() != text
        masked = []
        first = next((i for i, t in enumerate(tokens) if t[0].isalpha()), 0)  # a capital there says nothing
        for i, t in enumerate(tokens):
            if t.isdigit():
                masked.append("0")
            elif i > first and not caps and t[0].isupper() and len(t) > 1 and not t.startswith("⟦"):
                masked.append(_SLOT)
            else:
                masked.append(t.lower())
        return " ".join(t.lower() for t in tokens), " ".join(masked)


def page_title(lines: list[str]) -> str | None:
    fence = False
    for line in lines:
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        elif not fence and line.startswith("# "):
            return line[2:].strip()
    return None


def page_labels(text: str, host: str | None) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The key under which copies of a page count once, and (line number, block number, labels) of the lines that can be furniture."""
    lines = text.split("\n")
    title = page_title(lines)
    own = Labeller(host, title)
    out, fence, block = [], None, 0
    for i, line in enumerate(lines):
        if not line or line.isspace():
            block += 1
        start = line.lstrip()[:3]
        if start in ("```", "~~~"):
            fence = None if fence == start else fence or start
            continue
        if fence is None and (labels := own.labels(line)):
            out.append((i, block, labels))
    return title or max(lines, key=len), out


def _int64(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def label_id(label: str) -> int:
    """Hash of a label; it is odd for prose."""
    return _int64(label) & ~1 | label.startswith("prose ")


def _host(url: str | None) -> str:
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m.group(1).lower() if m else ""


def labelled(df: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """Rows (_key, line_no, _block, _host, _page, _body, _labels): number of the block, hashes of host, title, text and labels for every line that can be furniture."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (x for whole in frames for x in runs(whole, "_text")):
            rows = []
            for k, u, t in zip(pdf["_key"], pdf["_url"], pdf["_text"]):
                if t:
                    host = _host(u)
                    page, lines = page_labels(t, host)
                    hosts, pages, body = _int64(host), _int64(page), _int64(t)
                    rows += [(k, i, b, hosts, pages, body, [label_id(x) for x in labels]) for i, b, labels in lines]
            yield pd.DataFrame(rows, columns=["_key", "line_no", "_block", "_host", "_page", "_body", "_labels"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(text).alias("_text")).mapInPandas(run, f"_key {kind}, line_no int, _block int, _host long, _page long, _body long, _labels array<long>")


def furniture(df: DataFrame, key: str = "content_id", url: str = "url", text: str = "markdown") -> DataFrame:
    """Rows (*key*, line_no): the lines of Markdown pages that belong to the template of their site.

    Lines are split at LF and counted from 0.  Null and empty texts have none.  A
    null or unreadable URL puts a page on a host without name.  Copies of a page
    (the same title, unless it is the site's) count once, so that copying makes no template.  Extra columns
    are ignored.
    """
    lines = stored(labelled(df, key, url, text), "labels")
    # Copies of a page have its title; where many pages of a host have one title, their texts tell them apart.
    bodies = lines.select("_host", "_page", "_body").distinct().groupBy("_host", "_page").agg(F.count("*").alias("_c"))
    named = bodies.join(bodies.groupBy("_host").agg(F.sum("_c").alias("_all")), "_host").where((F.col("_c") >= TITLE_PAGES) & (F.col("_c") >= TITLE_SHARE * F.col("_all"))).select("_host", "_page", F.lit(True).alias("_named"))
    lines = lines.join(named, ["_host", "_page"], "left").withColumn("_page", F.when(F.col("_named"), F.col("_body")).otherwise(F.col("_page"))).drop("_named", "_body")
    pages = lines.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("_pages"))
    shown = lines.select("_host", "_page", F.explode("_labels").alias("_label"))
    support = stored(shown.distinct().groupBy("_host", "_label").agg(F.count("*").alias("_n")).join(pages, "_host"), "support")
    prose = F.col("_label").bitwiseAND(F.lit(1)) == 1
    common = support.groupBy("_label").agg(F.sum("_n").alias("_n"), F.count("*").alias("_hosts"), F.sum("_pages").alias("_pages"))
    shared = common.where(~prose & (F.col("_hosts") >= SHARED_HOSTS) & (F.col("_n") >= SHARED_PAGES) & (F.col("_n") >= SHARED_SHARE * F.col("_pages"))).select("_label")
    wide = common.where(prose & (F.col("_hosts") >= SHARED_PROSE)).select("_label")
    titles = shown.where(prose).join(wide, "_label", "left_semi").select("_label", "_page").distinct().groupBy("_label").agg(F.count("*").alias("_n"))
    shared = shared.unionByName(titles.where(F.col("_n") >= SHARED_PROSE).select("_label"))
    own = support.where(F.when(prose, (F.col("_n") >= PROSE_PAGES) & (F.col("_n") >= PROSE_SHARE * F.col("_pages"))).otherwise((F.col("_n") >= HOST_PAGES) & (F.col("_n") >= HOST_SHARE * F.col("_pages")))).select("_host", "_label")
    labels = lines.select("_key", "line_no", "_block", "_host", F.explode("_labels").alias("_label"))
    nodes = labels.join(own, ["_host", "_label"], "left_semi").unionByName(labels.join(shared, "_label", "left_semi"))
    return aligned(nodes, df.schema[key].dataType.simpleString()).select(F.col("_key").alias(key), "line_no")


Tree = list[list[tuple[int, frozenset[int]]]]  # blocks of (line number, labels)


def _heaviest(n: int, m: int, weight: Callable[[int, int], float]) -> tuple[float, list[tuple[int, int]]]:
    """The heaviest matching of two sequences that keeps their order, and its pairs."""
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        above, row = best[i], best[i + 1]
        for j in range(m):
            w = weight(i, j)
            row[j + 1] = max(above[j + 1], row[j], above[j] + w if w else 0.0)
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[n][m], pairs[::-1]


def tree_matching(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching of two pages: the pairs of line numbers of a largest alignment that keeps the order of blocks and, within blocks, of lines. Lines match if they share a label."""
    inner: dict[tuple[int, int], tuple[float, list[tuple[int, int]]]] = {}
    mine, other = ([frozenset().union(*(labels for _, labels in block)) for block in t] for t in (a, b))

    def blocks(x: int, y: int) -> float:
        if mine[x].isdisjoint(other[y]):
            return 0.0
        if (x, y) not in inner:
            inner[x, y] = _heaviest(len(a[x]), len(b[y]), lambda i, j: 0.0 if a[x][i][1].isdisjoint(b[y][j][1]) else 1.0)
        return inner[x, y][0]

    _, pairs = _heaviest(len(a), len(b), blocks)
    return [(a[x][i][0], b[y][j][0]) for x, y in pairs for i, j in inner[x, y][1]]


class Wrapper:
    """The representatives of a host, and which of them stands for a label."""

    def __init__(self) -> None:
        self.trees: list[Tree] = []
        self.cover: dict[int, int] = {}

    def add(self, tree: Tree, labels: list[int]) -> None:
        for x in labels:
            self.cover.setdefault(x, len(self.trees))
        self.trees.append(tree)

    def furniture(self, page: Tree) -> list[int]:
        """Lines of a page that are aligned with the template.

        The page is aligned with the representative that stands for most of its
        labels; what is left, such as moved blocks and further items of a list, is
        aligned again in the same way, until no representative takes any of it.
        """
        left = {i: labels for block in page for i, labels in block}
        found: list[int] = []
        done: set[int] = set()
        while left:
            stands = Counter(self.cover[x] for labels in left.values() for x in labels if x in self.cover)
            rest = [(-n, k) for k, n in stands.items() if k not in done]
            if not rest:
                break
            k = min(rest)[1]
            taken = tree_matching(page, self.trees[k])
            if not taken:
                done.add(k)
                continue
            for i, _ in taken:
                found.append(i)
                del left[i]
            page = [kept for block in page if (kept := [n for n in block if n[0] in left])]
        return found


def _tree(nodes: Iterable[dict]) -> Tree:
    lines: dict[tuple[int, int], set[int]] = {}
    for n in nodes:
        lines.setdefault((n["_block"], n["line_no"]), set()).add(n["_label"])
    out: Tree = []
    last = None
    for (block, line), labels in sorted(lines.items()):
        if block != last:
            out.append([])
            last = block
        out[-1].append((line, frozenset(labels)))
    return out


def aligned(nodes: DataFrame, kind: str) -> DataFrame:
    """Rows (_key, line_no): lines of template nodes (_key, line_no, _block, _host, _label) that tree matching aligns with their host's wrapper.

    The representative of a label is the page that holds it with the smallest hash,
    so a host has as many as its template needs, whatever the number of its pages.
    Pages of a large host are spread, with its representatives before each part.
    """
    nodes = stored(nodes, "nodes")
    pages = nodes.groupBy("_host", "_key").agg(F.collect_set(F.struct("line_no", "_block", "_label")).alias("_nodes"))  # bounded by one page
    stands = nodes.groupBy("_host", "_label").agg(F.min(F.struct(F.xxhash64("_key").alias("h"), "_key")).alias("m"))
    chosen = stands.groupBy("_host", F.col("m._key").alias("_key")).agg(F.collect_list("_label").alias("_stands"))  # bounded by one page's labels
    parts = pages.groupBy("_host").agg(F.ceil(F.count("*") / PART_PAGES).cast("int").alias("_parts"))
    whole = stored(pages.join(chosen, ["_host", "_key"], "left").join(parts, "_host"), "trees")
    each = whole.select("_host", F.pmod(F.xxhash64("_key"), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_kind"), "_key", "_nodes", F.lit(None).cast("array<bigint>").alias("_stands"))
    before = whole.where(F.col("_stands").isNotNull()).select("_host", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_kind"), "_key", "_nodes", "_stands")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, Wrapper()
        for pdf in frames:
            rows = []
            for h, p, what, k, n, stands in zip(pdf["_host"], pdf["_part"], pdf["_kind"], pdf["_key"], pdf["_nodes"], pdf["_stands"]):
                if (h, p) != at:
                    at, own = (h, p), Wrapper()
                if what == 0:
                    own.add(_tree(n), [int(x) for x in stands])
                else:
                    rows += [(k, i) for i in own.furniture(_tree(n))]
            yield pd.DataFrame(rows, columns=["_key", "line_no"])

    both = before.unionByName(each).repartition("_host", "_part").sortWithinPartitions("_host", "_part", "_kind", "_key")
    return both.mapInPandas(run, f"_key {kind}, line_no int")


def html_lines(html: str) -> str:
    """A page's visible text as Markdown lines, one for each block, with its links: what :func:`furniture` reads."""
    out: list[str] = []
    current: list[str] = []
    prefix = ""

    def flush() -> None:
        nonlocal prefix
        text = re.sub(r"\s+", " ", "".join(current)).strip()
        if text:
            out.append(prefix + text)
        current.clear()
        prefix = ""

    from html import unescape

    todo: list[tuple[str, object]] = [("in", parse(html))]
    while todo:
        what, node = todo.pop()
        if isinstance(node, str):
            current.append(unescape(node) if what == "in" else node)
            continue
        if not isinstance(node, Node):
            continue
        if what == "out":
            flush()
            continue
        if node.tag in ("script", "style", "template", "noscript", "title", "svg"):
            continue
        if node.tag == "pre":
            flush()
            out.extend(["```", *unescape(node.text()).strip("\n").split("\n"), "```"])
            continue
        if node.tag == "a":
            href = re.search(r"href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", node.attrs)
            target = next((g for g in href.groups() if g), "") if href else ""
            label = re.sub(r"\s+", " ", unescape(node.text())).strip()
            up = node.parent
            alone = up is not None and up.tag not in ("p", "li", "td", "h1", "h2", "h3", "span") and all(isinstance(c, Node) and c.tag == "a" or isinstance(c, str) and not c.strip() or c is up.children[0] for c in up.children)
            if alone:  # a run of bare links is a list
                flush()
                prefix = "- "
            current.append(f"[{label}]({target})" if target and not re.search(r"[\s()]", target) else label)
            if alone:
                flush()
            continue
        if node.tag in _BLOCKS or node.tag in ("br", "hr"):
            flush()
            if re.fullmatch(r"h[1-6]", node.tag):
                prefix = "#" * int(node.tag[1]) + " "
            elif node.tag == "li":
                prefix = "- "
            todo.append(("out", node))
        todo.extend(("in", c) for c in reversed(node.children))
    flush()
    return "\n".join(out)


def main_body(df: DataFrame, key: str, url: str, text: str, html: bool = False) -> DataFrame:
    """Rows (*key*, body, removed): each page without its furniture and the number of lines removed.

    HTML is first read as Markdown lines.  Null texts stay null, empty ones empty; rows stay one for one where *key* is unique.
    """
    base = df.select(F.col(key), F.col(url).alias("_url"), F.col(text).alias("_text"))
    if html:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pdf.assign(_text=[html_lines(t) if t else t for t in pdf["_text"]])

        base = stored(base.mapInPandas(run, base.schema), "pages")
    gone = furniture(base, key, "_url", "_text").groupBy(key).agg(F.collect_set("line_no").alias("_gone"))  # bounded by the lines of one page
    kept = F.expr("trim(BOTH '\n' FROM regexp_replace(array_join(filter(split(_text, '\n', -1), (x, i) -> not array_contains(_gone, i)), '\n'), '\n{3,}', '\n\n'))")
    out = base.join(gone, key, "left")
    return out.select(key, F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias("body"), F.coalesce(F.size("_gone"), F.lit(0)).alias("removed"))
