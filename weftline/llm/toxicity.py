"""Problem 10: abusive, hateful or sexual content by class-conditional Kneser-Ney models.

Two bigram models with interpolated Kneser-Ney smoothing, one of unacceptable and
one of ordinary language, share their lowest order (continuation counts over both
classes), so that rare expressions say nothing.  A word's evidence is the
difference of its log-likelihoods; a text's score is that of its strongest run of
words within a sentence, divided by the run's length and a prior number of words
that say nothing.  Unlabelled documents fill up the ordinary class: most are
ordinary, and those that speak like the unacceptable ones are left out.
Words are read through their disguises (digits and signs for letters, letters of
other alphabets, stretched or spaced letters, accents, invisible characters).

The labels are of whole documents, so the models are fitted by re-assigning the
sentences of unacceptable documents until they settle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import slices

#: Labelled documents of either class that are fitted on, at most; the first by hash. Fit only: every document is scored.
LABELLED_DOCS = 5_000
#: Characters of the labelled documents of either class, at most (whole documents).
LABELLED_CHARS = 12_000_000
#: Documents of the ordinary class: where fewer are labelled, unlabelled ones fill it up.
ORDINARY_DOCS = 2_000
#: What each word of a run pays, the discount of Kneser-Ney, and the weight of an acceptable document when the threshold is set (labels over-represent the others).
TOLL, DISCOUNT, ORDINARY_WEIGHT = 0.6, 0.75, 6.0
#: Words without evidence that each run is taken to have besides its own, and the score below which no text is unacceptable, however few the labels are.
PRIOR_WORDS, LEAST_SCORE = 20.0, 0.6
CACHE_WORDS = 400_000

#: Letters that look alike, and signs that stand for letters.
_LOOKALIKE = dict(zip("авсеһнікмоорԛгѕтуѵхѡζαβεικνορτυχ" "ј", "abcehhikmoopqrstuvxwzaBEiKvoptux".lower() + "j"))
_LEET = str.maketrans("013457@$!|", "oieastasii")
_CYRILLIC_FOR = dict(zip("aceopxyk", "асеорхук"))
_LOOK_TABLE = str.maketrans({k: v for k, v in _LOOKALIKE.items()})
_CYR_TABLE = str.maketrans(_CYRILLIC_FOR)

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_TOKEN_ASCII = re.compile(r"[A-Za-z0-9@$*][A-Za-z0-9@$*']*(?:![A-Za-z0-9@$*']+)*|[.!?\n]")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|(?:[^\W_぀-ヿ㐀-鿿豈-﫿]|[@$*])(?:[^\W_぀-ヿ㐀-鿿豈-﫿]|[@$*'’̀-ͯ])*(?:!(?:[^\W_]|[@$*])+)*|[.!?\n。！？؟]")
_BREAK = frozenset(".!?\n。！？؟")


def plain_word(word: str) -> str:
    """The word behind its disguise: lower case, no accents, look-alike letters and signs read as letters, repeated letters once."""
    w = word.lower()
    if not w.isascii():
        w = unicodedata.normalize("NFKC", w)
        if not ("぀" <= w[0] <= "鿿"):
            w = "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")
        foreign = [c for c in w if "Ͱ" <= c <= "ԯ"]
        if foreign:
            if all(c in _LOOKALIKE for c in foreign):
                w = w.translate(_LOOK_TABLE)
            elif any("a" <= c <= "z" for c in w):
                w = w.translate(_CYR_TABLE)
    if not w.isalpha():
        letters = sum(c.isalpha() for c in w)
        if letters < 2 and (len(w) > 3 or not letters) and not any(c in "@$*" for c in w):
            return "0"
        w = w.translate(_LEET).strip("'’")
    return re.sub(r"([^\W\d_])\1+", r"\1", w)


def split(text: str) -> list[str]:
    """Words and sentence breaks of a text."""
    if text.isascii():
        return _TOKEN_ASCII.findall(_SPACED.sub(lambda m: m.group(0).replace(" ", ""), text))
    text = _INVISIBLE.sub("", text)
    return _TOKEN.findall(_SPACED.sub(lambda m: m.group(0).replace(" ", ""), text))


def sentences(text: str) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = []
    current: list[str] = []
    for t in split(text):
        if t in _BREAK:
            if current:
                out.append(tuple(current))
                current = []
        else:
            current.append(plain_word(t))
    if current:
        out.append(tuple(current))
    return out


class Model:
    """Log-likelihood ratios of the two classes, as arrays for whole batches."""

    def __init__(self, bad: Counter, good: Counter):
        """From sentences (tuples of words) with their weights."""
        seen: Counter = Counter()
        for counts in (bad, good):
            for s in counts:
                seen.update(set(s))
        self.vocabulary = {w: i + 2 for i, w in enumerate(sorted(w for w, n in seen.items() if n >= 2))}  # 0 begins a sentence, 1 is any other word
        self.size = len(self.vocabulary) + 2
        tables = [self._bigrams(c) for c in (bad, good)]
        together = np.union1d(tables[0][0], tables[1][0])
        shared = np.bincount((together % self.size).astype(np.int64), minlength=self.size) + 0.5
        lowest = shared / shared.sum()
        words, backs, pairs = [], [], []
        for keys, counts in tables:
            head = keys // self.size
            total = np.bincount(head, weights=counts, minlength=self.size)
            kinds = np.bincount(head, minlength=self.size)
            after = np.bincount((keys % self.size).astype(np.int64), minlength=self.size)  # continuation counts
            every = max(1, after.sum())
            lower = np.maximum(after - DISCOUNT, 0) / every + DISCOUNT * max(1, (after > 0).sum()) / every * lowest if len(keys) else lowest.copy()
            back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
            value = np.zeros(len(together))
            value[np.searchsorted(together, keys)] = np.maximum(counts - DISCOUNT, 0) / total[head]
            words.append(lower)
            backs.append(back)
            pairs.append(value + back[together // self.size] * lower[together % self.size])
        self.word = np.log(words[0]) - np.log(words[1])
        self.back = np.log(backs[0]) - np.log(backs[1])
        self.word[1] = 0.0
        self.keys, self.pair = together, np.log(pairs[0]) - np.log(pairs[1])
        self._cache: dict[str, int] = {}

    def _bigrams(self, sents: Counter) -> tuple[np.ndarray, np.ndarray]:
        heads, tails, weights = [], [], []
        for s, n in sents.items():
            ids = [0, *(self.vocabulary.get(w, 1) for w in s)]
            heads += ids[:-1]
            tails += ids[1:]
            weights += [n] * len(s)
        keys = np.array(heads, dtype=np.int64) * self.size + np.array(tails, dtype=np.int64)
        uniq, back = np.unique(keys, return_inverse=True)
        return uniq, np.bincount(back, weights=np.array(weights, dtype=float), minlength=len(uniq)) if len(uniq) else np.zeros(0)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}}

    def ids(self, tokens: list[str]) -> np.ndarray:
        """Vocabulary ids of words; -1 for sentence breaks."""
        cache = self._cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        if not cache:
            cache.update(dict.fromkeys(_BREAK, -1))
        for t in set(tokens) - cache.keys():
            cache[t] = self.vocabulary.get(plain_word(t), 1)
        return np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))

    def ratios(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        keys = before * self.size + ids
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return np.where(hit, self.pair[at] if len(self.keys) else 0, self.word[ids] + self.back[before])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text: its strongest run of words within a sentence; 0 without words."""
        tokens: list[str] = []
        ends = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                tokens += split(text)
                tokens.append("\n")
            ends[k] = len(tokens)
        out = np.zeros(len(texts))
        if not tokens:
            return out
        best = self._runs(self.ids(tokens))[1]
        starts = np.concatenate(([0], ends[:-1]))
        some = ends > starts
        out[some] = np.maximum.reduceat(best, starts[some])
        return out

    def points(self, sents: list[tuple[str, ...]], normal: bool = False) -> np.ndarray:
        """Evidence, or with *normal* score, of sentences that are already words."""
        if not sents:
            return np.zeros(0)
        get = self.vocabulary.get
        ids = np.fromiter((i for s in sents for i in (*(get(w, 1) for w in s), -1)), np.int64)
        ends = np.cumsum(np.fromiter((len(s) + 1 for s in sents), np.int64, len(sents)))
        return np.maximum.reduceat(self._runs(ids)[normal], np.concatenate(([0], ends[:-1])))

    def _runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the strongest run within its sentence that ends with it: its evidence above the toll, and its evidence by length."""
        word = ids >= 0
        before = np.concatenate(([0], np.where(word[:-1], ids[:-1], 0)))
        gain = np.zeros(len(ids))
        gain[word] = self.ratios(ids[word], before[word]) - TOLL
        # The best run up to a word is its prefix sum less the lowest before it in the sentence; a large step at each break keeps sentences apart.
        total = np.cumsum(gain) - 1e6 * np.cumsum(~word)
        prior = np.concatenate(([0.0], total[:-1]))
        low = np.minimum.accumulate(prior)
        length = np.arange(len(ids)) - np.maximum.accumulate(np.where(prior == low, np.arange(len(ids)), 0)) + 1
        best = np.where(word, total - low, 0.0)
        return best, np.where(word, (best + TOLL * length) / (length + PRIOR_WORDS), 0.0)


Sentences = list[tuple[str, ...]]


def _doc_points(model: Model, docs: list[Sentences], normal: bool = False) -> list[np.ndarray]:
    points = model.points([s for d in docs for s in d], normal)
    return np.split(points, np.cumsum([len(d) for d in docs])[:-1]) if docs else []


def fit(docs: list[Sentences], labels: list[int], rounds: int = 3) -> Model:
    """Models from the distinct sentences of documents that are wholly ordinary (0) or unacceptable somewhere (1)."""
    good_docs = [d for d, y in zip(docs, labels) if not y]
    bad_docs = [d for d, y in zip(docs, labels) if y]
    good, bad = Counter(s for d in good_docs for s in d), Counter(s for d in bad_docs for s in d)
    share = 4 * len(bad_docs) / max(1, len(good_docs))
    start = Counter({s: n for s, n in bad.items() if n > share * good[s]})
    model = Model(start, Counter({s: n for s, n in good.items() if s not in start}))
    for k in range(rounds):
        points = _doc_points(model, bad_docs)
        top = np.array([p.max() if len(p) else 0.0 for p in points])
        if k < 2:  # a document that speaks like the unacceptable ones bears a wrong label
            cut = 0.6 * float(np.median(top)) if len(top) else 0.0
            ordinary = [d for d, p in zip(good_docs, _doc_points(model, good_docs)) if not len(p) or p.max() < max(10.0, cut)]
            good = Counter(s for d in ordinary for s in d)
        bad, rest = Counter(), Counter(good)
        for d, p, m in zip(bad_docs, points, top):
            bar = max(3.0, min(8.0, 0.35 * m))
            for s, x in zip(d, p):
                (bad if x >= bar else rest)[s] += 1
        if not bad:
            break
        model = Model(bad, rest)
    return model


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score that best tells the labels apart (F1, acceptable documents weighing more)."""
    order = np.argsort(-scores, kind="stable")
    y = labels[order]
    hits = np.cumsum(y)
    wrong = np.cumsum(1 - y) * ORDINARY_WEIGHT
    f1 = 2 * hits / np.maximum(1, hits + wrong + y.sum())
    good = np.flatnonzero(f1 >= 0.998 * f1.max())
    s = np.maximum(scores[order], 1e-6)
    low = s[min(good[-1] + 1, len(s) - 1)]
    return float(math.sqrt(s[good[0]] * (s[good[-1]] + low) / 2))  # the middle of those that are as good


def held_out(docs: list[Sentences], y: np.ndarray, folds: int = 2) -> np.ndarray:
    """Scores of documents by models that haven't seen them."""
    fold = np.arange(len(y)) % folds
    held = np.zeros(len(y))
    for k in range(folds):
        model = fit([d for d, f in zip(docs, fold) if f != k], (y[fold != k] > 0).tolist())
        held[fold == k] = [p.max() if len(p) else 0.0 for p in _doc_points(model, [d for d, f in zip(docs, fold) if f == k], True)]
    return held


def train(texts: list[str], labels: list[int]) -> tuple[Model, float]:
    """Model and threshold: held-out scores set the threshold and show documents whose label must be wrong. Label -1 is of unlabelled documents."""
    y = np.array(labels)
    if not (y == 0).any() or not (y == 1).any():
        return Model(Counter(), Counter()), float("inf")
    docs = [list(dict.fromkeys(sentences(t))) for t in texts]
    held = held_out(docs, y)
    known = y >= 0
    bar = threshold(held[known], y[known])
    # A high score shows a wrong label, and in an unlabelled document that it isn't ordinary.
    keep = ~((y == 0) & (held > 1.7 * bar) | (y < 0) & (held > 0.8 * bar))
    bar = max(LEAST_SCORE, threshold(held[keep & known], y[keep & known]))
    return fit([d for d, k in zip(docs, keep) if k], (y[keep] > 0).tolist()), bar


def _texts(df: DataFrame, some: DataFrame, key: str, text: str) -> list[tuple[int, str]]:
    """(draw, text) of the documents of *some* (_key, _draw), a bounded number: the first by _draw, up to LABELLED_CHARS characters."""
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(some), "_key")
    sizes = sorted((r["_draw"], r["_n"]) for r in rows.select("_draw", F.length("_text").alias("_n")).collect())
    upto, last = 0, None
    for draw, n in sizes:
        upto += n
        if upto > LABELLED_CHARS:
            break
        last = draw
    return [] if last is None else [(r["_draw"], r["_text"]) for r in rows.where(F.col("_draw") <= last).select("_draw", "_text").collect()]


def labelled(df: DataFrame, labels: DataFrame, key: str, text: str, most: int = LABELLED_DOCS) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled documents, and unlabelled ones (-1) up to ORDINARY_DOCS. Ratings of a document are averaged, those that disagree evenly are left out."""
    ratings = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("label").alias("_y")).where(F.col("_y") != 0.5)
    draw = lambda k: F.xxhash64(k).alias("_draw")
    found: list[tuple[int, int, str]] = []
    for y in (0, 1):
        some = ratings.where((F.col("_y") > 0.5) == F.lit(bool(y))).select(F.col("doc_id").alias("_key"), draw("doc_id")).orderBy("_draw", "_key").limit(most)  # at most *most* keys
        found += [(d, y, t) for d, t in _texts(df, some, key, text)]
    lack = ORDINARY_DOCS - sum(y == 0 for _, y, _ in found)
    if lack > 0 and found:
        rest = df.where(F.length(text) > 0).select(F.col(key).alias("_key"), draw(key)).join(labels.select(F.col("doc_id").alias("_key")), "_key", "left_anti")
        found += [(d, -1, t) for d, t in _texts(df, rest.orderBy("_draw", "_key").limit(lack), key, text)]
    found.sort()  # by draw, so that every fold has every class
    return [t for _, _, t in found], [y for _, y, _ in found]


def score_content(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = LABELLED_DOCS) -> DataFrame:
    """Rows (*key*, *source*, score double, unacceptable boolean), one for every row of *df*.

    Null and empty texts score 0 and are acceptable.  Without labels of both
    kinds nothing is unacceptable.  Whole texts are read.  Repeated rows stay
    repeated; extra columns are ignored.
    """
    model, bar = train(*labelled(df, labels, key, text, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                points = model.scores(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(points), pa.array(points > bar)], names=["_key", "_source", "score", "unacceptable"])

    kind, where = df.schema[key].dataType.simpleString(), df.schema[source].dataType.simpleString()
    out = spread(df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))).mapInArrow(run, f"_key {kind}, _source {where}, score double, unacceptable boolean")
    return out.withColumnsRenamed({"_key": key, "_source": source})


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Rows (*source*, documents, unacceptable, rate)."""
    return scored.groupBy(source).agg(F.count("*").alias("documents"), F.sum(F.col("unacceptable").cast("long")).alias("unacceptable")).withColumn("rate", F.col("unacceptable") / F.col("documents"))
