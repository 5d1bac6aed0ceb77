"""Problem 4: tokens per source type, language and domain, from a regression on cheap counts.

The counts (bytes, words, digits, punctuation, letters by script) are JVM
expressions over every row; only a bounded sample is tokenized, one part to fit
a regression for each language and another to correct its bias.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import counter, slices

#: Rows that are tokenized to fit and to correct, at most about so many in all.
SAMPLE_ROWS = 20_000
#: A language with fewer tokenized rows than this uses the regression over all languages.
LEAST_ROWS = 60
FEATURES = ("bytes", "chars", "words", "digits", "punctuation", "upper", "cyrillic", "kana", "han", "arabic", "lines")


def features(text: Column) -> dict[str, Column]:
    """The counts of a text; all 0 for null and empty. Script counts are only made where bytes and characters differ."""
    wide = F.octet_length(text) > F.length(text)
    script = lambda name: F.when(wide, F.regexp_count(text, F.lit(rf"\p{{Is{name}}}"))).otherwise(0)
    counts = {
        "bytes": F.octet_length(text),
        "chars": F.length(text),
        "words": F.regexp_count(text, F.lit(r"\S+")),
        "digits": F.length(text) - F.length(F.translate(text, "0123456789", "")),
        "punctuation": F.length(text) - F.length(F.translate(text, ".,;:!?()[]{}<>/\\|-_*#`'\"$%&=+@~^", "")),
        "upper": F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        "cyrillic": script("Cyrillic"),
        "kana": F.when(wide, F.regexp_count(text, F.lit(r"[ぁ-ヿ]"))).otherwise(0),
        "han": script("Han"),
        "arabic": script("Arabic"),
        "lines": F.length(text) - F.length(F.translate(text, "\n", "")),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in counts.items()}


def solve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge regression through the origin with an intercept; scaled, so that rare scripts do no harm."""
    a = np.column_stack([x, np.ones(len(x))])
    scale = np.maximum(np.sqrt((a**2).mean(axis=0)), 1e-9)
    z = a / scale
    return np.linalg.solve(z.T @ z + 1e-4 * len(x) * np.eye(z.shape[1]), z.T @ y) / scale


def language(df: DataFrame, tags: DataFrame, column: str = "language") -> Column:
    """The language that a tag names, else 'unknown'. The tag table is fixed and small."""
    known = {r["tag"]: r["lang"] for r in tags.select("tag", "lang").collect() if r["tag"] is not None and r["lang"] is not None}
    if not known:
        return F.lit("unknown")
    pairs = [F.lit(x) for kv in sorted(known.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit("unknown"))


def _base(df: DataFrame, tags: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.lower("source_type").alias("source_type"), language(df, tags).alias("language"), F.lower("domain").alias("domain"), F.col(text).alias("_text"))


def drawn(key: Column, share: float, salt: str) -> Column:
    """Whether a row is in a sample of this share: a hash of its key of 62 bits, so that shares of a few rows of any table are kept."""
    return F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit((1 << 62) - 1)) < F.lit(int(share * (1 << 62)))


def fitted(base: DataFrame, vocabulary: str | None, sample_rows: int) -> dict[str, np.ndarray]:
    """Weights of the counts for each language of *base*, bias corrected; the last one is of every text that isn't empty."""
    total = base.count()
    if not total:
        return {}
    sample = base.where(drawn(F.col("_key"), min(1.0, sample_rows / total), "budget"))
    sample = sample.select("language", F.pmod(F.xxhash64("_key", F.lit("part")), F.lit(5)).alias("_part"), "_text", *[v.alias(k) for k, v in features(F.col("_text")).items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                at = part.schema.get_field_index("_text")
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns) if i != at] + [pa.array(count(texts))], names=[n for i, n in enumerate(part.schema.names) if i != at] + ["tokens"])

    seen = sample.mapInArrow(run, "language string, _part long, " + ", ".join(f"{k} double" for k in FEATURES) + ", tokens long").toPandas()
    if seen.empty:
        raise ValueError("the sample is empty: nothing to fit on")
    x, y, part, lang = seen[list(FEATURES)].to_numpy(), seen["tokens"].to_numpy(dtype=float), seen["_part"].to_numpy(), seen["language"].to_numpy()
    fit = part < 3 if (part < 3).any() else np.ones(len(part), dtype=bool)
    everywhere = solve(x[fit], y[fit])
    names = sorted({r["language"] for r in base.select("language").distinct().collect()})  # at most the languages of the tag table and 'unknown'
    weights = {}
    for name in names:
        own = lang == name
        w = solve(x[own & fit], y[own & fit]) if (own & fit).sum() >= LEAST_ROWS else everywhere
        held = own & ~fit
        guess = float((np.column_stack([x[held], np.ones(held.sum())]) @ w).sum()) if held.any() else 0.0
        weights[name] = w * (y[held].sum() / guess) if held.sum() >= LEAST_ROWS // 3 and guess > 0 else w
    return weights


def predicted(weights: dict[str, np.ndarray]) -> Column:
    """The tokens that the weights give for columns of counts; _full tells (or counts) texts that aren't empty."""
    guess = F.lit(0.0)
    for name, w in weights.items():
        line = F.col("_full") * F.lit(float(w[-1]))
        for k, c in zip(FEATURES, w):
            line = line + F.col(k) * F.lit(float(c))
        guess = F.when(F.col("language") == name, line).otherwise(guess)
    return F.greatest(F.lit(0), F.round(guess)).cast("long")


def _full() -> Column:
    return (F.coalesce(F.length("_text"), F.lit(0)) > 0).cast("double")


def token_budget(df: DataFrame, tags: DataFrame, text: str = "text", vocabulary: str | None = None, sample_rows: int = SAMPLE_ROWS, key: str = "row_id") -> DataFrame:
    """Rows (source_type, language, domain, rows, tokens): estimated totals over all rows of *df*.

    source_type and domain are in lower case, null stays null and '' stays ''.
    Tags that name no language, and null, count as 'unknown'.  Null and empty
    texts are rows without tokens.  An empty table gives no rows.  Rows delivered
    twice count twice.  Extra columns are ignored.
    """
    base = _base(df, tags, text, key)
    weights = fitted(base, vocabulary, sample_rows)
    # A sum of predictions is the prediction of the sums, so only the sums of the counts are shuffled.
    sums = spread(base).withColumn("_full", _full()).groupBy("source_type", "language", "domain").agg(F.count("*").alias("rows"), F.sum("_full").alias("_full"), *[F.sum(v).alias(k) for k, v in features(F.col("_text")).items()])
    return sums.select("source_type", "language", "domain", "rows", predicted(weights).alias("tokens"))


def token_estimates(df: DataFrame, tags: DataFrame, text: str = "text", vocabulary: str | None = None, sample_rows: int = SAMPLE_ROWS, key: str = "row_id") -> DataFrame:
    """Rows (*key*, source_type, language, domain, tokens): the estimate of every row of *df*, as :func:`token_budget` adds them up."""
    base = _base(df, tags, text, key)
    weights = fitted(base, vocabulary, sample_rows)
    counts = spread(base).select("_key", "source_type", "language", "domain", _full().alias("_full"), *[v.alias(k) for k, v in features(F.col("_text")).items()])
    return counts.select(F.col("_key").alias(key), "source_type", "language", "domain", predicted(weights).alias("tokens"))
