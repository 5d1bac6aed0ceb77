"""Three-word sequences of texts as sorted arrays of 64-bit hashes, for whole batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Maximal runs of letters and digits; a letter of kana or Han is a word of its own.
_CJK = "ぁ-ゖゝ-ゟァ-ヺー-ヿ㐀-䶿一-鿿"
_WORDS = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_ASCII = re.compile(r"[a-z0-9]+")
_CACHE: dict[str, int] = {}
CACHE_WORDS = 500_000
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def words(text: str) -> list[str]:
    low = text.lower()
    return (_ASCII if low.isascii() else _WORDS).findall(low)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word sequences; empty for fewer words."""
    if len(_CACHE) > CACHE_WORDS:
        _CACHE.clear()
    tokens: list[str] = []
    ends = []
    for text in texts:
        if text:
            tokens += words(text)
        ends.append(len(tokens))
    for w in set(tokens) - _CACHE.keys():
        _CACHE[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    ids = np.fromiter(map(_CACHE.__getitem__, tokens), np.uint64, len(tokens))
    out, start = [], 0
    if len(ids) >= n:
        grams = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            grams += mix(ids[k : len(ids) - n + 1 + k] * _K[k % 3] + np.uint64(k // 3))
        grams = mix(grams)
    for end in ends:
        out.append(np.unique(grams[start : end - n + 1]) if end - start >= n else np.zeros(0, dtype=np.uint64))
        start = end
    return out
