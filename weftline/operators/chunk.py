"""Markdown into chunks for retrieval: sections, then paragraphs, within a range of words, with overlap and the heading of each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "url string, domain string, chunk_index int, total_chunks int, char_offset long, token_estimate long, section_header string, text string"


def word_size(text: str) -> int:
    return len(text.split())


@lru_cache(maxsize=4)
def tokenizer_size(path: str) -> Callable[[str], int]:
    """The size of a text in tokens of a tokenizer file, loaded once a worker."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


def chunks(text: str, target: int = 512, overlap: int = 64, least: int = 50, most: int = 100, size: Callable[[str], int] = word_size) -> list[tuple[int, str, str | None]]:
    """(offset, text, header): units are paragraphs, or sentences, or runs of words where one is too long, by *size*; chunks below *least* words go before the cap of *most* applies."""
    units: list[tuple[int, str]] = []
    for m in re.finditer(r"(?:(?!\n\s*\n).)+", text, re.S):
        piece = m.group(0)
        if size(piece) <= target:
            units.append((m.start(), piece))
            continue
        for s in re.finditer(r"\S.*?(?:[.!?。！？](?=\s)|$)|\S+", piece, re.S):
            words = [(w.start(), w.end()) for w in re.finditer(r"\S+", s.group(0))]
            i = 0
            while i < len(words):
                n = min(target, len(words) - i)
                while n > 1 and size(s.group(0)[words[i][0] : words[i + n - 1][1]]) > target:
                    n //= 2
                a, b = words[i][0], words[i + n - 1][1]
                units.append((m.start() + s.start() + a, s.group(0)[a:b]))
                i += n
    out: list[tuple[int, int]] = []
    first, count = 0, 0
    sizes = [size(unit) for _, unit in units]
    for i, (_, unit) in enumerate(units):
        n = sizes[i]
        if count and (count + n > target or (unit.lstrip().startswith("#") and count >= target - 112)):
            out.append((first, i))
            back, kept = i, 0
            while back > first + 1 and kept + sizes[back - 1] <= overlap:
                back -= 1
                kept += sizes[back]
            first, count = back, kept
        count += n
    if units:
        out.append((first, len(units)))
    heads = [(m.start(), m.group(1).strip()) for m in re.finditer(r"^#{1,3} +(.+)$", text, re.M)]
    made = []
    for a, b in out:
        start, end = units[a][0], units[b - 1][0] + len(units[b - 1][1])
        body = text[start:end].strip()
        if len(body.split()) >= least:
            before = [t for at, t in heads if at <= start]
            made.append((start, body, before[-1] if before else None))
    return made[:most]


def chunk_pages(df: DataFrame, url: str = "url", text: str = "markdown", tokenizer: str | None = None, **options) -> DataFrame:
    """Rows of SCHEMA; null and short texts give none. Sizes are in tokens of a *tokenizer* file that all executors can read, else in words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = tokenizer_size(tokenizer) if tokenizer else word_size
        for pdf in frames:
            rows = []
            for u, t in zip(pdf["u"], pdf["t"]):
                made = chunks(t, size=size, **options) if t else []
                host = re.match(r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)", u or "")
                rows += [(u, host.group(1).lower() if host else "", i, len(made), o, size(b), h, b) for i, (o, b, h) in enumerate(made)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return df.select(F.col(url).alias("u"), F.col(text).alias("t")).mapInPandas(run, SCHEMA)
