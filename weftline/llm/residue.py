"""Problem 2: pages without content: gaps of templates, dummy copy, error and refusal messages, demands for scripts.

Messages are mined as templates with a prefix tree of fixed depth (number of
words, then the first three words); within a leaf, texts of enough equal words are
one template and the words that differ its slots.  A template is classified once,
by how often its pages hold a text of their own, and the verdict goes to all
pages that show it.  Gaps and dummy copy are told inside any page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from operator import eq
from re import _constants as _c
from re import _parser

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Share of equal words that makes two texts one template.
SIMILAR = 0.75
#: A text of so many characters that at most so many pages show is the page's own, and so much code makes a page one of code.
OWN_CHARS, OWN_PAGES = 60, 2
#: Words for each of which a notice has one of a notice's phrases: a longer text that names one in passing is none.
NOTICE_WORDS = 60
#: Copies of a page vary a longer text a little: whether it is a page's own is told by its exact wording, not by its template.
LONG_WORDS = 40
#: Verdicts on texts of at most so many characters that one worker keeps.
CACHE_TEXTS, KEPT_CHARS = 20_000, 200
#: Patterns of some of the notice phrases that one worker keeps.
KEPT_PATTERNS = 256
#: A message template: on so many pages of so many hosts, of which so large a part has no text of its own.
PAGES, HOSTS, BARE = 3, 2, 0.6

#: How a gap of a template looks, by the syntax of common template engines and mail merges.
GAPS = (
    r"\{\{[^{}]*\}\}",
    r"[$#]\{[^{}]+\}",
    r"\{%[^%]*%\}",
    r"<%[=\-#]?[^%]*%>",
    r"<<\s*[A-Z][A-Z0-9_ ]*\s*>>",
    r"(?<![\w%])%[A-Z][A-Z_]{2,}%",
    r"@@[A-Za-z][A-Za-z_]+@@",
    r"(?<!\w)__[A-Z][A-Z_]+__(?!\w)",
    r"\[\[\s*[A-Z][A-Z_ ]+\s*\]\]",
    r"\[object Object\]",
    r"\[(?:insert|enter|add|put|your)\b[^\[\]]{2,60}\]",
    r"(?<![\w$#{\\}_^])\{[a-zA-Z_][a-zA-Z_.]{2,}\}(?![\w{])",
)
#: Openings of dummy copy.
DUMMY = (
    r"lorem ipsum\b",
    r"(?:this is|here is|here goes) (?:some |a )?(?:sample|dummy|placeholder|example|filler) (?:text|copy|content)",
    r"(?:sample|dummy|placeholder|filler) (?:text|copy|content)\b",
    r"your [\w ]{2,40} goes here",
    r"(?:tbd|tba|todo|xxx)(?:\W+(?:tbd|tba|todo|xxx))+",
    r"(?:dies ist|hier steht) (?:ein )?(?:beispieltext|platzhalter|blindtext|mustertext)",
    r"(?:beispieltext|blindtext|platzhaltertext|mustertext)\b",
    r"(?:ceci est |voici )?(?:un )?(?:texte d['’]exemple|texte factice|faux texte)",
    r"(?:este es |esto es )?(?:un )?texto de (?:ejemplo|relleno|prueba)",
    r"(?:este é |isto é )?(?:um )?texto de (?:exemplo|preenchimento|teste)",
    r"(?:это )?(?:пример текста|образец текста|текст-заполнитель|здесь будет текст)",
    r"(?:これは)?(?:サンプル|ダミー|仮の)(?:テキスト|文章|文)",
    r"(?:这是)?(?:示例|占位|样例|测试)(?:文本|文字)",
    r"(?:texte|text|texto|copy|contenu|contenido|conteúdo|inhalt|текст) (?:provisoire|provisional|provisório|provisorio|vorläufig\w*|temporaire|temporal|temporário|временный|заглушка)\b",
    r"(?:vorläufiger|provisorischer|временный|temporary|placeholder) (?:text|текст|copy|content)\b",
    r"(?:hier (?:steht|kommt|folgt)(?: später| bald| dann| noch)? (?:der|die|das|ihr|dein|ein)|ici (?:va|vient|se place|prend place) (?:le|votre|ton)|aquí (?:va|irá) (?:el|su|tu)|aqui (?:vai|entra) (?:o|seu)|здесь (?:будет|появится|стоит)|text (?:for|about|of) [\w ]+ goes here)\b.{0,40}",
    r"(?:ここに|此处|這裡|هنا).{0,24}(?:テキスト|文章|本文|入り|文本|文字|内容|نص)",
)
#: Words of error, refusal, maintenance, human-check and scripts-required notices; only for templates too rare to be judged by their pages.
NOTICE = (
    r"\b(?:40[0-9]|410|429|50[0-4])\b.{0,40}(?:error|forbidden|not found|unavailable|gateway|too many|denied|gone)|(?:internal )?server error|bad gateway|gateway time-?out|service (?:is )?(?:temporarily )?unavailable|not found|access denied|forbidden|permission to (?:access|view)|lack the rights|too many requests|rate limit"
    r"|under maintenance|maintenance mode|be back (?:soon|shortly|at|later)|come back later|try again later|not a robot|are (?:you )?human|verify (?:that )?you|checking your browser|unusual traffic|captcha"
    r"|(?:enable|allow|requires?|needs?|activate|switch on|turn on|without|disabled).{0,30}(?:java ?script|scripts?|cookies)|(?:java ?script|scripts?|cookies).{0,40}(?:enable|allow|require|need|disabled|switch it on|must be)|something went wrong|unexpected (?:fault|error)|does not exist|page (?:is )?(?:missing|gone|was removed)"
    r"|wartung|nicht gefunden|zugriff verweigert|kein(?:e)? (?:zugriff|berechtigung)|später (?:erneut|noch einmal|wieder)|serverfehler|kein roboter|ein mensch bist|(?:javascript|skripte?).{0,40}(?:aktivier|einschalt|erlaub|nötig|benötig)"
    r"|en maintenance|introuvable|accès (?:refusé|interdit)|erreur (?:interne|du serveur)|réessayez|plus tard|pas un robot|(?:javascript|scripts?).{0,40}(?:activ|autoris|nécessaire)"
    r"|mantenimiento|no (?:se )?(?:encuentra|encontr|existe)|acceso (?:denegado|prohibido)|error (?:interno|del servidor)|más tarde|no eres un robot|(?:javascript|scripts?).{0,40}(?:activ|habilit|permit|necesari)"
    r"|manutenção|não (?:foi )?encontrad|acesso negado|erro (?:interno|do servidor)|mais tarde|não é um robô|(?:javascript|scripts?).{0,40}(?:ativ|habilit|permit|necess)"
)
NOTICE_OTHER = (
    r"техническ\w+ работ|обслуживани|не найден|доступ (?:запрещ|закрыт)|ошибка сервера|позже|не робот|(?:javascript|скрипт).{0,40}(?:включ|разреш|нуж)|нужны скрипты|что-то пошло не так"
    r"|メンテナンス|見つかりません|アクセスが?(?:拒否|禁止)|エラーが発生|サーバー ?エラー|ロボットでは|(?:javascript|スクリプト).{0,30}(?:有効|必要|許可)|後でもう一度|しばらくして"
    r"|维护|未找到|不存在|拒绝访问|禁止访问|服务器错误|稍后再试|不是机器人|(?:javascript|脚本).{0,20}(?:启用|开启|需要|允许)|出错了"
    r"|صيانة|غير موجود|تم رفض|خطأ في الخادم|لاحقا|لست روبوت"
)
#: What a page that is only preformatted text shows when it is a fault's trace.
_TRACE = re.compile(r"traceback|stack trace|exception|\b\w*error\b|fatal|could not connect|connection (?:refused|timed out|reset)|timed? ?out|unavailable|denied|not found|^\s*at [\w.$<>]+\(|warning:|sqlstate|cannot (?:get|post)|segmentation fault|panic", re.I | re.M)
_CASED = re.compile("|".join(g for g in GAPS if "[A-Z]" in g))
_ANYCASE = re.compile("|".join(g for g in GAPS if "[A-Z]" not in g), re.I)
_DUMMY = re.compile(rf"^[\W_]*(?:{'|'.join(DUMMY)})", re.I)
_YOURS = re.compile(r"(?:^|[.!?:,]\s+|^\w+ )your [\w ]{2,40} goes here\W*$", re.I)



def needed(parsed) -> frozenset[str] | None:
    """Strings in lower case of which every match of a parsed pattern holds at least one; null if there are none such."""
    found: list[frozenset[str]] = []
    literal = ""

    def end() -> None:
        nonlocal literal
        if literal:
            found.append(frozenset((literal,)))
        literal = ""

    for op, arg in parsed:
        if op is _c.LITERAL:
            literal += chr(arg).lower()
            continue
        end()
        if op is _c.SUBPATTERN:
            inner = needed(arg[3])
        elif op is _c.BRANCH:
            sides = [needed(x) for x in arg[1]]
            inner = None if any(x is None for x in sides) else frozenset().union(*sides)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
            inner = needed(arg[2])
        else:
            inner = None
        if inner:
            found.append(inner)
    end()
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between the bars that are in no bracket."""
    out, depth, i, start = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


class Phrases:
    """A pattern of many alternatives, of which only those are tried whose own strings the text holds."""

    #: The letters that equal an ASCII letter only without regard to case.
    FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")

    def __init__(self, pattern: str):
        self.whole = re.compile(pattern, re.I)
        self.parts = [re.compile(x, re.I) for x in alternatives(pattern)]
        own = [needed(_parser.parse(x, re.I)) for x in alternatives(pattern)]
        self.always = [i for i, x in enumerate(own) if not x]
        places: dict[str, list[int]] = {}
        for i, x in enumerate(own):
            for string in x or ():
                places.setdefault(string, []).append(i)
        self.strings = frozenset(places)
        self.some: dict[frozenset[int], re.Pattern] = {}
        self.wide = not self.always and not any(x.isascii() for x in places)
        self.finder = ahocorasick.Automaton()
        for string, at in places.items():
            self.finder.add_word(string, tuple(at))
        self.finder.make_automaton()

    def _tried(self, text: str) -> set[int] | list[int] | range:
        """Alternatives that may match; the others don't."""
        if text.isascii():
            if self.wide:
                return self.always
        elif self.FOLDED.search(text):
            return range(len(self.parts))
        hits = list(self.finder.iter(text.lower()))
        return {*self.always, *(i for _, at in hits for i in at)} if hits else self.always

    def search(self, text: str) -> bool:
        return any(self.parts[i].search(text) for i in self._tried(text))

    def count(self, text: str) -> int:
        tried = self._tried(text)
        return sum(1 for _ in self._only(frozenset(tried)).finditer(text)) if tried else 0

    def _only(self, tried: frozenset[int]) -> re.Pattern:
        """The pattern without the alternatives that match nowhere in a text, which finds the same there."""
        if len(tried) == len(self.parts):
            return self.whole
        if tried not in self.some:
            if len(self.some) >= KEPT_PATTERNS:
                self.some.clear()
            self.some[tried] = re.compile("|".join(self.parts[i].pattern for i in sorted(tried)), re.I)
        return self.some[tried]

    def most(self, text: str) -> int:
        """As many matches as there can be: they don't overlap, and each holds a string that it needs."""
        if self.wide and text.isascii():
            return 0
        if self.always or self.FOLDED.search(text):
            return len(text) + 1
        return sum(1 for _ in self.finder.iter(text.lower()))

    def possible(self, text: str) -> bool:
        """Whether the text holds a string that a match needs; it never denies a match."""
        return bool(self._tried(text))


_LATIN, _OTHER = Phrases(NOTICE), Phrases(NOTICE_OTHER)


def is_notice(text: str, words: int) -> bool:
    """Whether a text has the phrases of a notice, as many as its length demands."""
    if words <= NOTICE_WORDS:
        return _LATIN.search(text) or _OTHER.search(text)
    if (_LATIN.most(text) + _OTHER.most(text)) * NOTICE_WORDS < words:
        return False
    return (_LATIN.count(text) + _OTHER.count(text)) * NOTICE_WORDS >= words


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)>", re.S)
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")  # such a character says as much as two or more others
_RAW = frozenset(("script", "style", "template", "textarea", "svg"))
_CODE = frozenset(("pre", "code", "kbd", "samp"))
_INLINE = frozenset("b i em strong u s small big span font abbr cite q mark sub sup time label wbr code kbd samp".split())
#: What the tags do that end no block.
_WITHIN = {**dict.fromkeys(_INLINE, "inline"), "a": "link", **dict.fromkeys(_CODE, "code"), **dict.fromkeys(_RAW, "raw")}
_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def blocks(html: str) -> tuple[list[tuple[str, str, int]], str]:
    """(kind, text, characters outside links) of the blocks of a page and the code it shows. Kinds: title, head, text, link, noscript."""
    out: list[tuple[str, str, int]] = []
    text: list[str] = []
    raw, code, shown = None, 0, []
    kind, noscript, link, linked = "text", False, False, 0

    def flush() -> None:
        nonlocal linked, text
        joined = "".join(text) if len(text) > 1 else text[0]
        whole = " ".join((unescape(joined) if "&" in joined else joined).split())
        if whole:
            out.append(("noscript" if noscript else "link" if kind == "text" and linked and linked >= len(joined.strip()) else kind, whole, len(whole) - linked + (0 if whole.isascii() else len(_WIDE.findall(whole)))))
        text = []
        linked = 0

    parts = _TAG.split(html)  # what is between the tags, and of each tag the slash, the name and the rest
    last = parts.pop()
    each = iter(parts)
    for piece, slash, name, rest in zip(each, each, each, each):
        if raw is not None:
            if slash and name.lower() == raw:
                raw = None
            continue
        if piece:
            if code:
                shown.append(piece)
            elif link:
                text.append(piece)
                linked += len(piece)
            elif text or not piece.isspace():  # a block's leading space shows nowhere
                text.append(piece)
        if not name:
            continue
        name = name.lower()
        does = _WITHIN.get(name)
        if does == "inline":
            continue
        if does == "link":
            link = not slash
            continue
        if does == "code":
            code = max(0, code - 1) if slash else code + 1
            text.append(" ")
            continue
        if does == "raw":
            if not slash and not rest.endswith("/"):
                raw = name
            continue
        if text:
            flush()
        if name == "noscript":
            noscript = not slash
        elif name == "title":
            kind = "text" if slash else "title"
        elif name in _HEADS:
            kind = "text" if slash else "head"
    if last and raw is None and not code:
        text.append(last)
    if text:
        flush()
    return out, unescape("".join(shown)).strip()


def has_gap(kind: str, text: str) -> bool:
    """Whether a visible block shows an unfilled gap or dummy copy instead of its text."""
    if kind == "noscript" or "$$" in text:
        return False
    if ("{" in text or "[" in text or "<" in text or "%" in text or "__" in text or "@@" in text) and (_CASED.search(text) or _ANYCASE.search(text)):
        return True
    if _DUMMY.match(text) or ("goes here" in text.lower() and _YOURS.search(text)):
        return True
    first, *rest = text.split(None, 1) or ("",)
    if not rest or not first.isalpha() or not rest[0].rstrip().endswith(first):
        return False
    words = text.split()
    return len(words) >= 5 and len(set(words)) == 1


# Addresses, paths, hexadecimal words and numbers, in this order at each place; the first character is taken before it is told which, as a search for one set is fast.
_SLOTS = re.compile(r"[hH/\da-fA-F](?:(?<=[hH])[tT][tT][pP][sS\u017f]?://\S+|(?<=/)(?<![\w<]/)[\w\-./%?=&#]+|(?<=[0-9a-fA-F])(?<!\w.)[0-9a-fA-F]{5,}\b|(?<=\d)\d*(?:[.:,\-]\d+)*)")


_VARIES = re.compile(r"[\d/]")


def masked(text: str) -> str:
    return _SLOTS.sub("<*>", text) if _VARIES.search(text) else text


def _hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


_WORD = re.compile(r"[^\W_぀-鿿]+|<\*>|\S")


def leaf(text: str) -> tuple[list[str], str]:
    """The words of a masked text and its leaf in the prefix tree."""
    words = _WORD.findall(text)
    return words, f"{len(words)}\x1f" + "\x1f".join(words[:3])


class Leaf:
    """The templates of one leaf, in the order in which texts came.

    A text and its template differ in at most a quarter of the words, so in one of
    more parts than that they don't differ at all: only templates that equal the
    text in some part, slots apart, are compared with it.
    """

    def __init__(self, size: int) -> None:
        self.templates: list[list[str]] = []
        self.slots: list[int] = []
        parts = size - math.ceil(SIMILAR * size) + 1
        cuts = [min(3, size) + (size - min(3, size)) * k // parts for k in range(parts + 1)]
        # For each part the templates by the words there, and of those with slots there by the kept places (those that aren't slots) that occur.
        self.parts: list[tuple[int, int, dict[tuple[str, ...], list[int]], dict[tuple[int, ...], dict[tuple[str, ...], list[int]]]]] = [(a, b, {}, {}) for a, b in zip(cuts, cuts[1:])]

    def _enter(self, i: int) -> None:
        words = tuple(self.templates[i])
        for a, b, known, slotted in self.parts:
            key = words[a:b]
            if "" in key:
                places = tuple(k for k in range(a, b) if words[k])
                known, key = slotted.setdefault(places, {}), tuple(words[k] for k in places)
            own = known.setdefault(key, [])
            if i not in own[-1:]:
                own.append(i)

    def _near(self, words: list[str]) -> list[int]:
        """Indices of the templates that may be similar to a text, in order."""
        found: set[int] = set()
        whole = tuple(words)
        for a, b, known, slotted in self.parts:
            found.update(known.get(whole[a:b], ()))
            for places, other in slotted.items():
                found.update(other.get(tuple([words[k] for k in places]), ()))
        return sorted(found)

    def add(self, words: list[str]) -> int:
        """Index of the template that *words* belong to; it gets slots where they differ."""
        best, most = -1, 0
        for i in self._near(words):
            same = sum(map(eq, self.templates[i], words)) + self.slots[i]
            if same > most:
                best, most = i, same
        if best >= 0 and most >= SIMILAR * len(words):
            merged = [a if a == b else "" for a, b in zip(self.templates[best], words)]  # a slot equals no word
            if merged != self.templates[best]:
                self.templates[best], self.slots[best] = merged, merged.count("")
                self._enter(best)
            return best
        self.templates.append(words)
        self.slots.append(0)
        self._enter(len(self.templates) - 1)
        return len(self.templates) - 1


_NAMES = ("_url", "_host", "_title", "gap", "code", "trace", "kind", "chars", "_mask", "_x", "_leaf", "notice", "long")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())


def _scan(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Rows (_key, _url, _host, _title, gap, code, trace, kind, chars, _mask, _x, _leaf, notice, long): one for each block, or one without for a page that shows none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[bool, str, int, int, bool, bool]] = {}

        def judged(text: str) -> tuple[bool, str, int, int, bool, bool]:
            """Of a visible text: gap, mask, hash of the mask, leaf, notice, long; the short ones, which pages repeat, are kept."""
            found = known.get(text)
            if found is None:
                mask = masked(text)
                words, name = leaf(mask)
                found = has_gap("text", text), mask, _hash(mask), _hash(name), is_notice(mask, len(words)), len(words) > LONG_WORDS
                if len(text) <= KEPT_CHARS:
                    if len(known) > CACHE_TEXTS:
                        known.clear()
                    known[text] = found
            return found

        for batch, pages in (x for whole in batches for x in slices(whole, "_html")):
            keys = batch.schema.field("_key").type
            rows = []
            for k, u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pages):
                found, code = blocks(h)
                told = [(has_gap(kind, text),) if kind in ("link", "title") else judged(text) for kind, text, _ in found]
                gap = any(t[0] for (kind, _, _), t in zip(found, told) if kind != "noscript")
                site = re.match(r"^[a-z]+://([^/?#]+)", u or "")
                page, host = _hash(u or f"\x00{k}"), _hash(site.group(1).lower() if site else "")
                name = next((text for kind, text, _ in found if kind == "head"), None) or next((text for kind, text, _ in found if kind == "title"), "")
                letters = "".join(c for c in name.lower() if c.isalpha())
                title = _hash(letters) if letters else page
                trace = bool(code and _TRACE.search(code)) and not any(kind == "text" for kind, _, _ in found)
                listing = len(code) >= OWN_CHARS  # a path or a name set as code is no body
                kept = [(kind, free, t) for (kind, _, free), t in zip(found, told) if kind not in ("link", "title")]
                for kind, free, (_, *own) in kept:
                    rows.append((k, page, host, title, gap, listing, trace, kind, max(0, free), *own))
                if not kept:
                    rows.append((k, page, host, title, gap, listing, trace, "", 0, None, None, None, False, False))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (keys, *_TYPES))], names=["_key", *_NAMES])

    kind = df.schema[key].dataType.simpleString()
    some = df.where(F.col(html).isNotNull() & (F.length(html) > 0))
    return some.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html")).mapInArrow(run, f"_key {kind}, _url long, _host long, _title long, gap boolean, code boolean, trace boolean, kind string, chars int, _mask string, _x long, _leaf long, notice boolean, long boolean")


def mine(texts: DataFrame) -> DataFrame:
    """Rows (_x, _template): the template of each distinct masked text of *texts* (_x, _leaf, _mask) that isn't alone in its leaf, as hashes.

    Leaves of the prefix tree are spread over the cluster and worked through one
    after the other, so no leaf is gathered; a leaf keeps only its templates.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, own = None, Leaf(0)
        for pdf in frames:
            found = []
            for name, mask in zip(pdf["_leaf"], pdf["_mask"]):
                words = _WORD.findall(mask)
                if name != current:
                    current, own = name, Leaf(len(words))
                found.append(_hash(f"{name}\x1e{own.add(words)}"))
            yield pd.DataFrame({"_x": pdf["_x"], "_template": found})

    # Most texts are the only ones of their leaf and need not be moved.
    shared = texts.groupBy("_leaf").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high")).where(F.col("_low") != F.col("_high")).select("_leaf")
    distinct = texts.join(shared, "_leaf", "left_semi").groupBy("_x").agg(F.min("_leaf").alias("_leaf"), F.min("_mask").alias("_mask"))
    return distinct.repartition("_leaf").sortWithinPartitions("_leaf", "_mask").mapInPandas(run, "_x long, _template long")


def residue(df: DataFrame, key: str = "fetch_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (*key*, residue boolean, reason string) for every row of *df*; reason is gap, notice, noscript, or null.

    Null and empty *html* is no residue.  Only *html* is read, so a status that
    disagrees does not matter.  A page fetched again (the same URL) counts once
    towards a template; a null URL is a page of its own.  Every row comes out,
    repeated ones too; extra columns are ignored.
    """
    pages = stored(_scan(df, key, url, html), "blocks")
    shown = pages.where(F.col("_mask").isNotNull())
    # A hash of the text joins blocks and templates; texts themselves are shuffled only once, distinct.
    known = stored(mine(shown.select("_x", "_leaf", "_mask")), "templates")
    own = shown.select("_key", "_url", "_host", "_title", "gap", "code", "trace", "kind", "chars", "_x", "notice", "long")
    judged = stored(own.join(known, "_x", "left").withColumn("_t", F.coalesce("_template", "_x")).withColumn("_own", F.when(F.col("long"), F.col("_x")).otherwise(F.col("_t"))).drop("_x", "_template"), "judged")
    # How many pages show a template: distinct (template, page) pairs, so that no page or template is gathered.
    seen = judged.where(F.col("kind") != "noscript").select("_t", "_url", "_host").distinct()
    # Copies of a page under other addresses keep its title, so a text of few titles is a page's own.
    few = judged.select("_own", "_title").distinct().groupBy("_own").agg(F.count("*").alias("_n")).where(F.col("_n") <= OWN_PAGES).select("_own")
    body = (F.col("chars") >= OWN_CHARS) & (F.col("kind") != "noscript") & ~F.col("notice")
    thick = judged.where(body).select("_key", "_url", "_own").join(few, "_own", "left_semi").select("_key", "_url").distinct()
    thick = stored(thick, "thick")
    bare = seen.join(thick.select("_url").distinct().withColumn("_thick", F.lit(1)), "_url", "left")
    verdict = bare.groupBy("_t").agg(F.count("*").alias("_n"), F.approx_count_distinct("_host").alias("_hosts"), F.avg(F.when(F.col("_thick").isNull(), 1.0).otherwise(0.0)).alias("_bare"))
    words = judged.groupBy("_t").agg(F.max(F.col("notice") | (F.col("kind") == "noscript")).alias("_word"))
    message = verdict.join(words, "_t").where((F.col("_bare") >= BARE) & (((F.col("_n") >= PAGES) & (F.col("_hosts") >= HOSTS)) | F.col("_word"))).select("_t", F.lit(True).alias("_message"))
    common = verdict.where((F.col("_bare") < BARE) & (F.col("_n") > OWN_PAGES)).select("_t", F.lit(True).alias("_common"))
    marks = judged.join(message, "_t", "left").join(common, "_t", "left")
    by_page = marks.groupBy("_key").agg(
        F.max("gap").alias("gap"),
        F.max("code").alias("code"),
        F.max("trace").alias("trace"),
        F.max(F.coalesce("_message", F.lit(False)) & (F.col("kind") != "noscript")).alias("message"),
        F.max(F.col("kind") == "noscript").alias("noscript"),
        F.max((F.col("kind") != "noscript") & F.col("_common").isNull() & F.col("_message").isNull()).alias("rest"),
    )
    by_page = by_page.join(thick.select("_key", F.lit(True).alias("thick")).distinct(), "_key", "left")
    empty = pages.where(F.col("_mask").isNull()).select("_key", "gap", "code", "trace", F.lit(False).alias("message"), F.lit(False).alias("noscript"), F.lit(False).alias("rest"), F.lit(None).cast("boolean").alias("thick"))
    state = by_page.unionByName(empty)
    reason = (
        F.when(F.col("gap"), "gap")
        .when(F.col("trace"), "notice")
        .when(F.col("thick").isNotNull() | F.col("code"), F.lit(None))
        .when(F.col("message"), "notice")
        .when(F.col("noscript") & ~F.col("rest"), "noscript")
    )
    out = df.select(F.col(key)).join(state.select(F.col("_key").alias(key), reason.alias("reason")).where(F.col("reason").isNotNull()), key, "left")
    return out.select(key, F.col("reason").isNotNull().alias("residue"), "reason")
