"""Byte-level BPE by speculation and verification.

A word (a match of the public split pattern) is first covered greedily by the
longest vocabulary entries.  A sequence of tokens is what the merges would give
exactly when every adjacent pair is: encoding the concatenation of the two
gives the two back.  So the adjacent pairs of all new words of a batch are
checked together against the known pairs, and only words with a failing pair
go through exact merging.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
import re

import numpy as np
import regex

#: The split pattern published with the vocabulary, with Unicode white space spelled out.
_WS = r"\t-\r \x85\xa0  -     　"
_UNICODE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

#: Words kept in the cache of one Python worker; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Checked pairs kept likewise.
CACHE_PAIRS = 4_000_000


def tokenizer_dir() -> str:
    """The folder of the public vocabularies: $PUBLIC_TOKENIZERS, else the installed package, else /opt/tokenizers."""
    if os.environ.get("PUBLIC_TOKENIZERS"):
        return os.environ["PUBLIC_TOKENIZERS"]
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    return os.path.join(folder or tokenizer_dir(), name)


def words(text: str) -> list[str]:
    """Split *text* as the vocabulary's pattern does."""
    return (_ASCII if text.isascii() else _UNICODE).findall(text)


class SpeculativeBPE:
    """Encoder over a rank file; one instance per Python worker (see :func:`encoder`)."""

    def __init__(self, path: str | None = None):
        with open(path or vocabulary_path(), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.longest: dict[bytes, int] = {}
        for token in self.ranks:
            head = token[:2]
            self.longest[head] = max(self.longest.get(head, 1), len(token))
        # Pairs of tokens that were checked, sorted, and whether they stay as they are.
        self.pairs, self.stays = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        # A vocabulary entry that its own merges cannot reach must never be proposed.
        self.reachable: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.lens = np.zeros(1024, dtype=np.int32)
        self.starts = np.zeros(1024, dtype=np.int64)
        self.pool = np.zeros(4096, dtype=np.int32)
        self.used = 0

    def greedy(self, data: bytes) -> list[int]:
        """Longest-match cover of *data*: the speculation."""
        out, i, n, ranks, longest = [], 0, len(data), self.ranks, self.longest
        while i < n:
            for j in range(min(n, i + longest.get(data[i : i + 2], 1)), i, -1):
                token = ranks.get(data[i:j])
                if token is not None and (j == i + 1 or self._reaches(token)):
                    break
            out.append(token)
            i = j
        return out

    def _reaches(self, token: int) -> bool:
        known = self.reachable.get(token)
        if known is None:
            known = self.reachable[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def merge(self, data: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost first; O(n log n)."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return [ranks[data]] if n else []
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or ends[i] >= n or ends[ends[i]] != e:
                continue
            j = ends[i]
            alive[j], ends[i] = False, e
            if e < n:
                before[e] = i
                if (r := ranks.get(data[i : ends[e]])) is not None:
                    heapq.heappush(heap, (r, i, ends[e]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For sorted distinct pairs of tokens whether encoding their concatenation gives the two back; all at once where known, new ones are merged."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == pairs if len(self.pairs) else np.zeros(len(pairs), dtype=bool)
        ok = self.stays[at] & known if len(self.pairs) else np.zeros(len(pairs), dtype=bool)
        new = np.flatnonzero(~known)
        if len(new):
            text = self.bytes_of
            ok[new] = [self.merge(text[a] + text[b]) == [a, b] for a, b in zip((pairs[new] >> 20).tolist(), (pairs[new] & 0xFFFFF).tolist())]
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs, self.stays = self.pairs[:0], self.stays[:0]
            self.pairs, self.stays = np.concatenate([self.pairs, pairs[new]]), np.concatenate([self.stays, ok[new]])
            order = np.argsort(self.pairs, kind="stable")
            self.pairs, self.stays = self.pairs[order], self.stays[order]
        return ok

    def _learn(self, new: list[str]) -> None:
        """Encode words not seen before and append them to the pool."""
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        proposed = [self.greedy(x) for x in raw]
        lens = np.fromiter(map(len, proposed), np.int32, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lens.sum()))
        word = np.repeat(np.arange(len(new)), lens)
        pairs = (flat[:-1] << 20) | flat[1:]
        inside = word[:-1] == word[1:]
        uniq, back = np.unique(pairs[inside], return_inverse=True)
        ok = self.compatible(uniq)
        for k in np.unique(word[:-1][inside][~ok[back]]) if len(uniq) else ():
            proposed[k] = self.merge(raw[k])
        lens = np.fromiter(map(len, proposed), np.int32, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int32, int(lens.sum()))
        first = len(self.index)
        need = first + len(new)
        if need > len(self.lens):
            grow = max(need, 2 * len(self.lens))
            self.lens, self.starts = np.resize(self.lens, grow), np.resize(self.starts, grow)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, max(self.used + len(flat), 2 * len(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.lens[first:need] = lens
        self.starts[first:need] = self.used + np.concatenate(([0], np.cumsum(lens[:-1], dtype=np.int64)))
        self.used += len(flat)
        self.index.update(zip(new, range(first, need)))

    def word_rows(self, split: list[str]) -> np.ndarray:
        """Rows of the pool of these words, learning the unknown ones."""
        if len(self.index) > CACHE_WORDS:
            self._reset()
        index = self.index
        new = [w for w in dict.fromkeys(split) if w not in index]
        if new:
            self._learn(new)
        return np.fromiter(map(index.__getitem__, split), np.int64, len(split))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and the offsets of each text in it; null and empty give no ids."""
        per, split = np.zeros(len(texts), dtype=np.int64), []
        for k, text in enumerate(texts):
            if text:
                found = words(text)
                per[k] = len(found)
                split += found
        rows = self.word_rows(split)
        lens, starts = self.lens[rows].astype(np.int64), self.starts[rows]
        ends = np.concatenate(([0], np.cumsum(lens)))
        ids = self.pool[np.repeat(starts - ends[:-1], lens) + np.arange(ends[-1])]
        return ids, ends[np.concatenate(([0], np.cumsum(per)))]

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        per, split = np.zeros(len(texts), dtype=np.int64), []
        for k, text in enumerate(texts):
            if text:
                found = words(text)
                per[k] = len(found)
                split += found
        rows = self.word_rows(split)  # before self.lens is read, as it may be replaced
        ends = np.concatenate(([0], np.cumsum(self.lens[rows], dtype=np.int64)))
        edge = np.concatenate(([0], np.cumsum(per)))
        return ends[edge[1:]] - ends[edge[:-1]]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


_ENCODERS: dict[str, SpeculativeBPE] = {}


def encoder(path: str | None = None) -> SpeculativeBPE:
    """The worker's encoder of this vocabulary file."""
    path = path or vocabulary_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = SpeculativeBPE(path)
    return _ENCODERS[path]
