"""Markdown made short for language models: ordered steps over text, each a function of its own, and all in one batch function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import INVISIBLE

_FENCE = re.compile(r"(^```.*?^```[ \t]*$|^```.*\Z)", re.M | re.S)


def outside_fences(step: Callable[[str], str]) -> Callable[[str], str]:
    def run(text: str) -> str:
        return "".join(p if i % 2 else step(p) for i, p in enumerate(_FENCE.split(text)))

    run.__name__ = step.__name__
    return run


def decode_entities(text: str) -> str:
    return unescape(text) if "&" in text else text


_UNSEEN = re.compile(f"[{INVISIBLE}]")


def strip_invisible(text: str) -> str:
    return text if text.isascii() else _UNSEEN.sub("", text)


@outside_fences
def strip_leaked_scripts(text: str) -> str:
    """Lines are cut where a script of the page's framework leaks in; one that is nothing else becomes a blank line between texts."""
    if "self.__" not in text:
        return text
    lines = [re.split(r"self\.__\w", line, maxsplit=1)[0].rstrip() if re.search(r"self\.__\w", line) else line for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines))


@outside_fences
def collapse_spaced(text: str) -> str:
    """Four or more letters with single spaces between are one word, parted again where a capital follows a small letter."""

    def join(m: re.Match) -> str:
        return re.sub(r"(?<=[a-z\u00df-\u00ff])(?=[A-Z\u00c0-\u00de])", " ", m.group(0).replace(" ", ""))

    return re.sub(r"(?<!\S)(?:\S ){3,}\S(?!\S)", join, text)


_IMAGE = re.compile(r"!\[([^\]]*)\]\([^)]+\)")


def _large(alt: str) -> bool:
    return len(alt.encode("utf-8", "surrogatepass")) > 30


def unwrap_linked_images(text: str) -> str:
    return re.sub(r"\[!\[([^\]]*)\]\([^)]*\)\]\(([^)]*)\)", r"[\1](\2)\n", text)


def collapse_image_runs(text: str) -> str:
    """Runs of image lines become their alternative texts; a single one stays if its text is above 30 bytes."""
    def alts(m: re.Match) -> str:
        found = [a.strip() for a in re.findall(r"!\[([^\]]*)\]", m.group(0)) if a.strip()]
        return ", ".join(found) + "\n" if len(found) > 1 or found and len(found[0].encode()) > 30 else ""

    return re.sub(r"(?m)(?:^[ \t]*!\[[^\]]*\]\([^)]*\)[ \t]*(?:\n|\Z)\s*)+", alts, text)


def strip_images(text: str) -> str:
    """Images go. Of a single one in a line an alternative text above 30 bytes stays; of several, short texts are joined and long ones get lines of their own. Names of assets never stay."""
    if "![" not in text:
        return text
    out = []
    for line in text.split("\n"):
        found = [a.strip() for a in _IMAGE.findall(line)]
        if len(found) < 2:
            out.append(_IMAGE.sub(lambda m: m.group(1).strip() if _large(m.group(1).strip()) and not is_asset_label(m.group(1).strip()) else "", line))
            continue
        told = [a for a in found if a and a != '""' and not is_asset_label(a)]
        rest = re.sub(r"\[\]\([^)]*\)", "", _IMAGE.sub("", line)).strip()
        small = ", ".join(a for a in told if not _large(a))
        out += [x for x in (rest, small) if x] + [a for a in told if _large(a)]
    return "\n".join(out)


def strip_image_names(text: str) -> str:
    return re.sub(r"(?mi)^\S+\.(?:png|jpe?g|gif|svg|webp|avif|ico)[ \t]*\n?", "", text)


@outside_fences
def strip_emphasis(text: str) -> str:
    return re.sub(r"(?<![\w*])\*([^*\n]+)\*(?![\w*])", r"\1", re.sub(r"\*\*([^*\n]+)\*\*|__([^_\n]+)__", lambda m: m.group(1) or m.group(2), text))


#: Names and signs of icons that show as text.
ICONS = frozenset(
    "navigate_before navigate_next chevron_left chevron_right arrow_back arrow_forward arrow_upward arrow_downward arrow_drop_down arrow_drop_up arrow_left arrow_right expand_more expand_less unfold_more unfold_less first_page last_page more_horiz "
    "more_vert open_in_new open_in_full close_fullscreen fullscreen fullscreen_exit close search menu share ← → ↑ ↓ ▸ ▾ ◀ ▶ ⤓ ⏵ › ‹ » «".split()
)


def strip_controls(text: str) -> str:
    """Lines of nothing but icons, and those that tell what a browser lacks, are dropped."""

    def control(line: str) -> bool:
        words = line.split()
        return bool(words) and (words[0] in ICONS and len(line.strip().encode("utf-8", "surrogatepass")) <= 120 and ICONS.issuperset(words) or "your browser does not support" in line.lower())

    return "\n".join(x for x in text.split("\n") if not control(x))


@outside_fences
def strip_css(text: str) -> str:
    """Rules of style sheets: at-rules with all that their braces hold, however deep, and lines of declarations in braces."""
    at = 0
    while m := re.compile(r"@(?:media|keyframes|font-face|supports|layer|container)\b[^{\n]*\{").search(text, at):
        depth, end = 1, m.end()
        for b in re.compile(r"[{}]").finditer(text, m.end()):
            depth += 1 if b.group() == "{" else -1
            end = b.end()
            if not depth:
                break
        if depth:
            at = m.end()  # it never ends: not a rule
            continue
        text, at = text[: m.start()] + text[end:], m.start()
    return re.sub(r"(?m)^[^\n{}]*\{[^\n{}]*:[^\n{}]*\}[ \t]*\n?", "", text)


def _cycle(words: list[str]) -> list[str] | None:
    """100 words or more that are, after up to 15 others, the same run of words several times over: one of them, and what follows."""
    for start in range(min(15, len(words) - 100) + 1):
        rest = words[start:]
        for n in (5, 4, 3, 2):
            if len(rest) % n == 0 and len(rest) // n >= 20 and rest == rest[: len(rest) // n] * n:
                return words[:start] + rest[: len(rest) // n]
        for size in range(len(rest) // 2, max(29, len(rest) // 2 - 51), -1):
            if rest[0] == rest[size] and rest[:size] == rest[size : 2 * size]:
                end = 2 * size
                while rest[end : end + size] == rest[:size]:
                    end += size
                return words[:start] + rest[:size] + rest[end:]
    return None


@outside_fences
def dedup_phrases(text: str) -> str:
    """A phrase of 2 to 20 words that directly repeats within a line comes once, and so does a long run of words that goes round."""
    out = []
    for line in text.split("\n"):
        words = line.split()
        if len(words) < 4 or line.lstrip().startswith("#") or len(set(words)) == len(words):
            out.append(line)
            continue
        if len(words) >= 100 and (once := _cycle(words)):
            out.append(" ".join(once))
            continue
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        kept, i = [], 0
        while i < len(words):
            # The phrase begins again where its first word does.
            for j in reversed([j for j in places[words[i]] if i + 2 <= j <= i + 20]):
                size = j - i
                if words[i:j] == words[j : j + size]:
                    kept += words[i:j]
                    while words[j : j + size] == words[i : i + size]:
                        j += size
                    i = j
                    break
            else:
                kept.append(words[i])
                i += 1
        out.append(" ".join(kept) if len(kept) < len(words) else line)
    return "\n".join(out)


def dedup_headings(text: str) -> str:
    """A line that only repeats a heading is dropped."""
    heads = {m.group(1).strip().lower() for m in re.finditer(r"(?m)^#{1,6} +(.+)$", text)}
    return "\n".join(line for line in text.split("\n") if line.strip().lower() not in heads or not line.strip())


def strip_empty_headings(text: str) -> str:
    """Headings without a letter or digit, and those that only name a part of the page, are dropped."""
    return re.sub(r"(?mi)^[ \t]*#{1,6}[ \t]+(?:[^\w\n]*|footer|header|navigation|sidebar|menu)[ \t]*(?:\n|\Z)|^#{1,6}[ \t]*(?:\n|\Z)", "", text)


def fingerprint(text: str) -> str:
    """Its letters and digits in lower case, words parted by single spaces."""
    return " ".join("".join(c if c.isalnum() else " " if c.isspace() else "" for c in text.lower()).split())


def _structural(line: str) -> bool:
    return bool(re.match(r"#{1,6} |[-*+>|]|\d+[.)] |```|~~~", line.strip()))


class _Seen:
    """Texts that came before, as a whole or with their first ten words."""

    def __init__(self) -> None:
        self.whole: set[str] = set()
        self.openings: set[str] = set()

    def again(self, text: str) -> bool:
        own = fingerprint(text)
        if own in self.whole:
            return True
        self.whole.add(own)
        words = own.split(" ", 10)[:10]
        if len(words) < 10:
            return False
        opening = " ".join(words)
        if opening in self.openings:
            return True
        self.openings.add(opening)
        return False


def _blocks(text: str) -> Iterator[tuple[str, bool]]:
    """Blocks between blank lines, and whether they hold code of a fence."""
    fence = ""
    for block in text.split("\n\n"):
        inside = bool(fence)
        for line in block.split("\n"):
            mark = line.lstrip()[:3]
            if mark in ("```", "~~~"):
                inside = True
                fence = "" if fence == mark else fence or mark
        yield block, inside


def dedup_blocks(text: str) -> str:
    """A block of 20 bytes or more that came before, or whose first ten words did, is dropped; code and single lines of structure stay."""
    seen = _Seen()
    out = []
    for block, code in _blocks(text):
        bare = block.strip()
        if not code and not bare:
            continue
        if not code and len(bare.encode("utf-8", "surrogatepass")) >= 20 and not ("\n" not in bare and _structural(bare)) and seen.again(bare):
            continue
        out.append(block if code else bare)
    return "\n\n".join(out)


def dedup_list_items(text: str) -> str:
    """A comma list of six or more entries that goes round comes once; elsewhere an entry that equals the one before, case aside, is dropped."""
    out = []
    for line in text.split("\n"):
        items = [x.strip() for x in line.split(",") if x.strip()] if "," in line else []
        if len(items) >= 6 and (n := next((k for k in range(1, len(items) // 2 + 1) if len(items) % k == 0 and items == items[:k] * (len(items) // k)), None)):
            out.append(", ".join(items[:n]))
            continue
        kept = [x for i, x in enumerate(items) if not i or x.lower() != items[i - 1].lower()]
        out.append(", ".join(kept) if len(kept) < len(items) else line)
    return "\n".join(out)


def strip_trailing_headings(text: str) -> str:
    """A heading without content before the next of its level or higher, or the end, is dropped."""
    while True:
        new = re.sub(r"(?m)^(#{1,6}) [^\n]*\n+(?=(#{1,6}) )", lambda m: "" if len(m.group(2)) <= len(m.group(1)) else m.group(0), text)
        new = re.sub(r"\n*^#{1,6} [^\n]*\s*\Z", "", new, flags=re.M)
        if new == text:
            return text
        text = new


def strip_empty_code(text: str) -> str:
    return re.sub(r"(?m)^```[^\n`]*\n\s*^```[ \t]*\n?", "", text)


def collapse_blank_lines(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)(?<![ \t])[ \t]+$", "", text)).strip()


@outside_fences
def merge_stat_lines(text: str) -> str:
    """A line of up to 25 bytes, blank ones and the next line, 120 bytes together, become one line, unless either is structure."""
    lines, out, i = text.split("\n"), [], 0
    size = lambda x: len(x.encode("utf-8", "surrogatepass"))
    while i < len(lines):
        own = lines[i].strip()
        if own and size(own) <= 25 and not _structural(own):
            j = i + 1
            while j < len(lines) and not lines[j].strip():
                j += 1
            if i + 1 < j < len(lines) and not _structural(lines[j]) and size(own) + 1 + size(lines[j].strip()) <= 120:
                out.append(f"{own} {lines[j].strip()}")
                i = j + 1
                continue
        out.append(lines[i])
        i += 1
    return "\n".join(out)


#: Openings of alternative texts: of lines of four words and more, and of lines of 80 bytes and more.
ALT_OPENINGS = (
    "image of ", "photo of ", "animation of ", "interactive animation of ", "screenshot of ", "illustration of ", "illustration ", "picture of ", "a image of ", "a photo of ", "an image of ", "an illustration ", "an animation ", "a screenshot ", "a rendering ",
    "a graphic ", "a diagram ",
)
LONG_OPENINGS = ("an illustration ", "an image ", "a screenshot ", "a photo ", "a picture ", "a diagram ", "a graphic ", "a rendering ", "an animation ", "an icon ", "this element contains ", "this image shows ", "this image depicts ")
#: Words that running text has, which a dump of words lacks.
FUNCTION_WORDS = frozenset(
    "the a an of to for with in on is are was were be been being and but or not that this these it its you your we our they from by at as if so no can will has have had do does did about into than then also more".split()
)
#: Beginnings and whole names of utility classes.
CLASS_OPENINGS = tuple(
    "text- bg- px- py- pt- pb- pl- pr- p- mx- my- mt- mb- ml- mr- m- w- h- min- max- flex- grid- col- row- gap- space- rounded- shadow- border- ring- outline- font- tracking- leading- decoration- opacity- transition- duration- delay- ease- translate- scale- "
    "rotate- origin- overflow- inset- divide- z- top- left- right- bottom- sr- not- group- peer- placeholder- focus- hover- active- disabled- dark- sm- md- lg- xl- 2xl-".split()
)
CLASS_NAMES = frozenset("flex grid block inline hidden static fixed absolute relative sticky isolate container prose antialiased truncate uppercase lowercase capitalize italic underline overline invisible visible sr-only not-sr-only".split())


def class_word(word: str) -> bool:
    """Whether a word looks like a utility class, state prefixes and negative signs aside."""
    core = word.rpartition(":")[2].lower()
    return "[" in core and "]" in core or core in CLASS_NAMES or core.startswith(CLASS_OPENINGS) or core[:1] == "-" and core[1:].startswith(CLASS_OPENINGS)


def _marked(line: str) -> bool:
    return line.startswith(("#", "-", ">"))


def _avatars(low: str) -> bool:
    return low.count("twitter image") >= 3 or low.count("avatar") >= 2 and sum(w.startswith("@") for w in low.split()) >= 3


def _brands(line: str) -> bool:
    """A list of four or more names of two words and more, most of which begin alike."""
    names = [x.split() for x in line.split(",") if len(x.split()) > 1]
    if len(names) < 4 or line.count(",") < 3:
        return False
    first = [n[0] for n in names]
    return any(2 * first.count(w) > len(first) for w in set(first))


@outside_fences
def strip_alt_noise(text: str) -> str:
    """Lines that only describe an image, list avatars or a brand over and over, and ends of broken image marks, are dropped."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        low = bare.lower()
        if bare and not _marked(bare):
            if low.startswith(ALT_OPENINGS) and len(low.split()) >= 4 or "avatar" in low and _avatars(low) or "twitter image" in low and _avatars(low) or "," in bare and _brands(bare):
                continue
            if bare[-1] == ")" and all(re.fullmatch(r".{0,5}\.(?:webp|svg|png|jpe?g|gif|avif)\)", w) for w in bare.split()):
                continue
        out.append(line)
    return "\n".join(out)


@outside_fences
def strip_long_descriptions(text: str) -> str:
    """Lines of 80 bytes and more that describe an image are dropped, and sentences on what an element contains cut."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        if bare[:1] in ("a", "A", "t", "T") and len(bare.encode("utf-8", "surrogatepass")) >= 80 and bare.lower().startswith(LONG_OPENINGS):
            continue
        if bare.startswith("This element contains "):
            line = re.sub(r"^\s*This element contains [^.]*\.[^.]*\.(?:\s*[^.]*\.)*", "", line).rstrip()
        out.append(line)
    return "\n".join(out)


@outside_fences
def collapse_word_lists(text: str) -> str:
    """From where 15 words in a row and nearly all that follow (95 %) are no function words, more than 20 words of a line of 200 bytes are a dump: what precedes stays, else its first three words and their number."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        words = bare.split() if len(bare) >= 50 and len(bare.encode("utf-8", "surrogatepass")) >= 200 and bare[0] not in "#->|" else []
        if len(words) >= 25:
            prose = [w.lower() in FUNCTION_WORDS for w in words]
            left = sum(prose)
            row, start = 0, None
            behind = 0  # function words before the window
            for i, p in enumerate(prose):
                row = 0 if p else row + 1
                behind += p
                if row >= 15:
                    at = i - 14
                    if (left - behind) / (len(words) - at) < 0.05:
                        start = at
                        break
            if start is not None and len(words) - start > 20:
                line = " ".join(words[:start]) if start else f"{' '.join(words[:3])} and {len(words) - 3} more ..."
        out.append(line)
    return "\n".join(out)


def dedup_teasers(text: str) -> str:
    """A line that says "learn more" before or after what repeats a part (above 15 bytes) of the line before is dropped."""
    out: list[str] = []
    last = ""
    for line in text.split("\n"):
        bare = line.strip()
        if bare[-10:].lower() == "learn more" and len(bare) > 25 and bare[:-10].strip() in last:
            continue
        if bare[:10].lower() == "learn more":
            rest = bare[10:].strip().lstrip("*").strip()
            if len(rest.encode("utf-8", "surrogatepass")) > 15 and rest in last:
                last = ""
                continue
        out.append(line)
        last = bare
    return "\n".join(out)


def merge_heading_paragraph(text: str) -> str:
    """A heading that the next line repeats or goes on with becomes the longer of the two."""
    def longer(m: re.Match) -> str:
        mark, head, line = m.group(1), m.group(2).strip(), m.group(3).strip()
        if line.lower() == head.lower():
            return f"{mark} {head}"
        return f"{mark} {line}" if line.lower().startswith(head.lower()) else m.group(0)

    return re.sub(r"(?m)^(#{1,6}) ([^\n]+)\n+([^\n#][^\n]*)$", longer, text)


def dedup_sections(text: str) -> str:
    """A later heading of the same level and words as an earlier one is dropped with the lines after it that equal those after the first; it stays where none does."""
    lines = text.split("\n")
    heads = [i for i, x in enumerate(lines) if re.match(r"\s*#{1,6} \s*\S", x)]

    def following(i: int) -> list[int]:
        i += 1
        while i < len(lines) and not lines[i].strip():
            i += 1
        out = []
        while i < len(lines) and lines[i].strip() and not re.match(r"\s*#{1,6} ", lines[i]):
            out.append(i)
            i += 1
        return out

    first: dict[tuple[str, str], int] = {}
    gone: set[int] = set()
    for i in heads:
        mark, _, words = lines[i].strip().partition(" ")
        key = (mark, fingerprint(words))
        if not key[1]:
            continue
        if key not in first:
            first[key] = i
            continue
        own = following(i)
        same = []
        for a, b in zip(following(first[key]), own):
            if fingerprint(lines[a]) != fingerprint(lines[b]):
                break
            same.append(b)
        if same or not own:
            gone.update((i, *same))
    return "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text


#: Words that name assets in paths of labels, and labels of content systems.
ASSET_WORDS, ASSET_LABELS = ("cover", "card", "image", "poster", "logo", "thumbnail"), ("Art Card", "ArtCard", "Card Image", "Cover Image", "1x1", "SEO")


def is_asset_label(line: str) -> bool:
    """Whether a line is the label of an asset: three or more short parts between bars without figures, a path of assets, a label of a content system, or a slug."""
    if not line or line[0] == "|":
        return False
    parts = line.split(" | ")
    figures = re.compile(r"[%#]|[MKB][+ ]|\dx\s*$|x\s*$(?<=\dx)")
    if len(parts) >= 3 and all(len(p) < 40 for p in parts) and not any(figures.search(p.strip()) for p in parts):
        return True
    if " > " in line and len(line) < 80 and any(w in p.lower() for p in line.split(" > ") for w in ASSET_WORDS):
        return True
    if 3 <= len(line.split()) <= 12 and any(x in line for x in ASSET_LABELS):
        return True
    return " " not in line and "-" in line and 10 < len(line) < 80 and all(c.isalnum() or c in "-_" for c in line)


@outside_fences
def strip_asset_labels(text: str) -> str:
    """Labels of assets are dropped; headings and quotes stay."""
    return "\n".join(x for x in text.split("\n") if not x.strip() or x.strip()[0] in "#>" or not is_asset_label(x.strip()))


@outside_fences
def strip_class_lines(text: str) -> str:
    """Lines of which more than half of three or more words are style classes, and lone bullets, are dropped; two or more classes at a line's end are cut."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        if bare in ("-", "*"):
            continue
        words = bare.split()
        if len(words) < 3 or bare.startswith(("#", ">", "- ", "* ")):
            out.append(line)
            continue
        known = [class_word(w) for w in words]
        if 2 * sum(known) > len(words):
            continue
        tail = 0
        while tail < len(words) and known[-1 - tail]:
            tail += 1
        out.append(line[: len(line) - len(line.lstrip())] + " ".join(words[: len(words) - tail]) if tail >= 2 else line)
    return "\n".join(out)


def dedup_lines(text: str) -> str:
    """Within a block of more than two lines a line of 20 bytes or more that came before, or whose first ten words did, is dropped; code and structure stay."""
    out = []
    for block, code in _blocks(text):
        lines = block.split("\n")
        if not code and len(lines) > 2:
            seen = _Seen()
            lines = [x for x in lines if len(x.strip().encode("utf-8", "surrogatepass")) < 20 or _structural(x) or not seen.again(x)]
        out.append("\n".join(lines))
    return "\n\n".join(out)


STEPS: tuple[Callable[[str], str], ...] = (
    decode_entities, strip_invisible, strip_leaked_scripts, collapse_spaced, unwrap_linked_images, collapse_image_runs, strip_images, strip_image_names, strip_emphasis, strip_alt_noise, strip_controls, strip_long_descriptions, strip_css, collapse_word_lists, dedup_teasers,
)
LATER: tuple[Callable[[str], str], ...] = (
    dedup_phrases, merge_heading_paragraph, dedup_headings, dedup_sections, strip_empty_headings, strip_asset_labels, strip_class_lines, collapse_blank_lines, dedup_blocks, dedup_lines, dedup_list_items, strip_trailing_headings, strip_empty_code, collapse_blank_lines, merge_stat_lines,
)


#: Labels of links that only act on the page, and targets of user and action pages.
ACTIONS = frozenset("hide flag reply favorite unflag vouch next prev previous more".split())
ACTION_TARGETS = ("/user?id=", "/hide?id=", "/from?site=", "/flag?id=")


def noise_link(label: str, href: str) -> bool:
    low = label.lower()
    return low in ACTIONS or low.endswith(" ago") or low in ("yesterday", "just now") or len(label) == 1 and not label.isalnum() or any(x in href for x in ACTION_TARGETS)


def link_label(raw: str) -> str:
    """A label without marks of Markdown, said once if it is said twice, cut at a space near 80 bytes."""
    label = " ".join(re.sub(r"#{1,6}\s+|\*{1,2}|_{1,2}|`", "", raw).split())
    for m in re.finditer(" ", label):
        left, right = label[: m.start()].strip(), label[m.end() :].strip()
        if len(left) >= 4 and left.lower() == right.lower():
            label = left
            break
    data = label.encode("utf-8", "surrogatepass")
    if len(data) <= 80:
        return label
    cut = data[:81].rfind(b" ")
    return (data[:cut] if cut > 0 else data[:80]).decode("utf-8", "ignore").rstrip() + "..."


def _closed(text: str, start: int, opening: str, closing: str) -> int:
    """Place of the bracket that closes the one at *start*, escaped ones passed over; -1 if none does."""
    depth = 0
    for m in re.compile(rf"\\.|[{re.escape(opening)}{re.escape(closing)}]", re.S).finditer(text, start):
        if m.group() == opening:
            depth += 1
        elif m.group() == closing:
            depth -= 1
            if not depth:
                return m.start()
    return -1


def take_links(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with labels in place of links, and the links: the first label of each target wins; anchors, script targets and links that only act are left out. Brackets may be nested."""
    links: dict[str, str] = {}
    out: list[str] = []
    at = 0
    nowhere: dict[str, int] = {}  # from where on a bracket is known to stay open
    while (start := text.find("[", at)) >= 0:
        out.append(text[at:start])
        end = _closed(text, start, "[", "]") if start < nowhere.get("[", len(text)) else -1
        if end < 0:
            nowhere["["] = min(start, nowhere.get("[", start))
        stop = _closed(text, end + 1, "(", ")") if 0 < end < len(text) - 1 and text[end + 1] == "(" else -1
        if stop < 0:
            out.append("[")
            at = start + 1
            continue
        label, href = text[start + 1 : end].strip(), text[end + 2 : stop].strip()
        href = href[1:-1] if href.startswith("<") and href.endswith(">") else href
        if label and href and not href.startswith(("#", "javascript:")) and not noise_link(label, href):
            links.setdefault(href, label)
        out.append(label)
        at = stop + 1
    out.append(text[at:])
    return "".join(out), [(link_label(label), href) for href, label in links.items()]


def readable(text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    if not text:
        return text, []
    for step in STEPS:
        text = step(text)
    text, links = take_links(text)
    for step in LATER:
        text = step(text)
    return text, links


def to_readable(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (*key*, text, links array<struct<label,href>>)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [readable(t) for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "text": [m[0] for m in made], "links": [[{"label": a, "href": h} for a, h in m[1]] for m in made]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, text string, links array<struct<label:string,href:string>>").withColumnRenamed("k", key)


def steps(df: DataFrame, key: str, text: str, *chosen: Callable[[str], str]) -> DataFrame:
    """Rows (key, text) after some of the steps, in their order; null and empty texts stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf["t"].tolist()
            for step in chosen:
                out = [step(t) if t else t for t in out]
            yield pd.DataFrame({"k": pdf["k"], "text": out})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, text string").withColumnRenamed("k", key)
