"""Problem 1: texts above a token limit cut into pieces by content-defined chunking.

A rolling hash over the words marks landmarks that depend on the text alone; a
cut is the natural boundary nearest to the first landmark between the smallest
and the largest piece.  So an edit moves only the cuts beside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SpeculativeBPE, encoder, words
from .common import counter, runs

_BLOCK = re.compile(r"(?:\r\n?|\n)[ \t]*(?:(?:\r\n?|\n)[ \t]*)+|(?:\r\n?|\n)(?=#{1,6}[ \t])")
_LINE = re.compile(r"\r\n?|\n| | ")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[」』）]*")
_HEADING = re.compile(r"^ {0,3}(#{1,3})[ \t]+([^\r\n]*)$", re.M)
_FENCE = re.compile(r"^ {0,3}(```|~~~).*?(?:^ {0,3}\1[^\S\n]*$|\Z)", re.M | re.S)
#: Words in the rolling hash, and one word in so many is a landmark.
WINDOW, LANDMARK_EVERY = 8, 48


@dataclass
class Piece:
    start: int
    end: int
    tokens: int


def headings(text: str) -> list[tuple[int, str]]:
    """(offset, title) of the h1 to h3 headings outside fenced code."""
    flat = text.replace("\r\n", " \n").replace("\r", "\n")
    fences = [m.span() for m in _FENCE.finditer(flat)] if "```" in flat or "~~~" in flat else []
    found = ((m.start(), m.group(2).strip().rstrip("#").rstrip()) for m in _HEADING.finditer(flat))
    return [(at, title) for at, title in found if title and not any(a <= at < b for a, b in fences)]


def _boundaries(text: str, starts: np.ndarray) -> np.ndarray:
    """For the start of each word the strength of the boundary there: 3 block, 2 line, 1 sentence, 0 word."""
    level = np.zeros(len(starts) + 1, dtype=np.int8)
    for strength, pattern in ((1, _SENTENCE), (2, _LINE), (3, _BLOCK)):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        if len(ends):
            at = np.searchsorted(starts, ends)  # the first word that starts at or after the end
            level[at] = np.maximum(level[at], strength)
    return level[: len(starts)]


def split_text(text: str, limit: int, overlap: int, bpe: SpeculativeBPE, count: Callable[[list[str]], np.ndarray] | None = None, total: int | None = None) -> list[Piece]:
    """Pieces of at most *limit* tokens that cover *text*; each but the first begins up to *overlap* tokens before the end of the one before.

    *count* counts tokens of texts and *total* is the count of *text*, where these are known.
    """
    count = count or bpe.count_batch
    total = int(count([text])[0]) if total is None else total
    if total <= limit:
        return [Piece(0, len(text), total)]
    overlap = max(0, min(overlap, limit - 1))
    found = words(text)
    if max(map(len, found)) > 64:  # a word above a small part of the limit (no spaces, odd runs) is cut by characters
        found = [w[i : i + 16] if len(w) > 64 else w for w in found for i in (range(0, len(w), 16) if len(w) > 64 else (0,))]
    lens = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    rows = bpe.word_rows(found)
    tokens = np.concatenate(([0], np.cumsum(bpe.lens[rows], dtype=np.int64)))
    level = _boundaries(text, starts)
    # What a word is to the rolling hash: its first and last token and their number.
    own = bpe.lens[rows].astype(np.uint64)
    hashes = (bpe.pool[bpe.starts[rows]].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (bpe.pool[bpe.starts[rows] + bpe.lens[rows] - 1].astype(np.uint64) * np.uint64(0x165667B19E3779F9) + own)
    rolling = np.zeros(len(found), dtype=np.uint64)
    for k in range(min(WINDOW, len(found))):
        rolling[k:] += hashes[: len(found) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    landmark = (rolling >> np.uint64(33)) % np.uint64(LANDMARK_EVERY) == 0
    n, core = len(found), max(1, limit - overlap - (8 if limit - overlap > 64 else 0))
    least = max(1, core // 3)
    cuts = [0]
    while tokens[n] - tokens[cuts[-1]] > core:
        p = cuts[-1]
        high = int(np.searchsorted(tokens, tokens[p] + core, side="right")) - 1
        low = min(int(np.searchsorted(tokens, tokens[p] + least)), high)
        if high <= p:
            high = low = p + 1
        low = max(low, p + 1)
        inside = level[low : high + 1] if high < n else level[low:n]
        if not len(inside):
            cuts.append(high)
            continue
        best = np.flatnonzero(inside == inside.max()) + low
        marks = np.flatnonzero(landmark[low : high + 1])
        cuts.append(int(best[np.argmin(np.abs(tokens[best] - tokens[marks[0] + low]))] if len(marks) else best[-1]))
    cuts.append(n)
    spans: list[tuple[int, int, int]] = []
    for a, b in zip(cuts, cuts[1:]):
        if b <= a:
            continue
        begin = a
        if spans and overlap:
            first = int(np.searchsorted(tokens, tokens[a] - overlap))
            if first < a:
                before = level[first:a]
                begin = int(np.flatnonzero(before == before.max())[0] + first) if before.max() else first
        spans.append((begin, a, b))
    position = lambda w: int(starts[w]) if w < n else len(text)
    out: list[Piece] = []
    counts = count([text[position(begin) : position(b)] for begin, _, b in spans])
    for (begin, a, b), exact in zip(spans, counts.tolist()):
        while exact > limit and begin < a:  # words cut apart can need a token more
            begin += 1
            exact = int(count([text[position(begin) : position(b)]])[0])
        if exact <= limit:
            out.append(Piece(position(begin), position(b), exact))
        else:
            out += _by_characters(text, position(begin), position(b), limit, bpe)
    return out


def _by_characters(text: str, start: int, end: int, limit: int, bpe: SpeculativeBPE) -> list[Piece]:
    """Last resort: halve until the pieces fit; a single character is never divided."""
    exact = int(bpe.count_batch([text[start:end]])[0])
    if exact <= limit or end - start < 2:
        return [Piece(start, end, exact)]
    middle = (start + end) // 2
    return _by_characters(text, start, middle, limit, bpe) + _by_characters(text, middle, end, limit, bpe)


def split_oversized(df: DataFrame, limit: int, overlap: int, key: str = "chunk_id", text: str = "text", offset: str = "char_offset", header: str = "section_header", vocabulary: str | None = None) -> DataFrame:
    """Rows (*key*, piece_index, pieces, text, char_offset, section_header, token_estimate, source_tokens).

    Every row comes out, rows within the limit as one piece.  A null or empty text
    is one piece with no tokens.  A null offset counts as 0.  The header is the
    nearest h1 to h3 heading at or before the start of the piece, else the stored
    one.  Line ends of any kind are kept.  Repeated rows stay repeated; extra
    columns are ignored.
    """
    if limit < 1:
        raise ValueError("limit must be positive")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, count = encoder(vocabulary), counter(vocabulary)
        for whole in frames:
            for pdf in runs(whole, "t"):
                rows = []
                totals = count(pdf["t"].tolist()).tolist()
                for k, t, o, h, total in zip(pdf["k"], pdf["t"], pdf["o"], pdf["h"], totals):
                    if not t:
                        rows.append((k, 0, 1, t, int(o), h, 0, 0))
                        continue
                    pieces = split_text(t, limit, overlap, bpe, count, total)
                    heads = headings(t) if "#" in t else []
                    at, title = 0, h
                    for i, p in enumerate(pieces):
                        while at < len(heads) and heads[at][0] <= p.start:
                            title, at = heads[at][1], at + 1
                        rows.append((k, i, len(pieces), t[p.start : p.end], int(o) + p.start, title, p.tokens, total))
                yield pd.DataFrame(rows, columns=["k", "piece_index", "pieces", "text", "char_offset", "section_header", "token_estimate", "source_tokens"])

    kind = df.schema[key].dataType.simpleString()
    cols = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(offset).cast("long"), F.lit(0)).alias("o"), F.col(header).alias("h"))
    return cols.mapInPandas(run, f"k {kind}, piece_index int, pieces int, text string, char_offset long, section_header string, token_estimate long, source_tokens long").withColumnRenamed("k", key)
