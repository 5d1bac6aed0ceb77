"""Text differences between versions: unified line diffs by Myers' algorithm, and the whole content diff of joined snapshots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edits(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Shortest edit script: (' ' | '-' | '+', line). Common ends are taken off first; O((n + m) d)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(x), len(y)
    reach, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            reach[k] = i
            if i >= n and i - k >= m:
                break
        else:
            continue
        break
    out: list[tuple[str, str]] = []
    i, j = n, m
    for d in range(len(trace) - 1, -1, -1):
        before, k = trace[d], i - j
        down = k == -d or (k != d and before.get(k - 1, -1) < before.get(k + 1, -1))
        pi = before[k + 1] if down else before[k - 1]
        pj = pi - (k + 1 if down else k - 1)
        while i > pi + (0 if down else 1) and j > pj + (1 if down else 0) and i and j:
            out.append((" ", x[i - 1]))
            i, j = i - 1, j - 1
        if d:
            out.append(("+", y[j - 1]) if down else ("-", x[i - 1]))
            i, j = pi, pj
    out.reverse()
    return [(" ", s) for s in a[:start]] + out + [(" ", s) for s in a[len(a) - end :] if end]


def unified(old: str | None, new: str | None, context: int = 3) -> str | None:
    """Unified diff with headers old and new; null for equal texts."""
    if (old or "") == (new or ""):
        return None
    script = edits((old or "").split("\n"), (new or "").split("\n"))
    changed = [i for i, (op, _) in enumerate(script) if op != " "]
    hunks: list[list[int]] = []
    for i in changed:
        lo, hi = max(0, i - context), min(len(script), i + context + 1)
        if hunks and lo <= hunks[-1][1]:
            hunks[-1][1] = hi
        else:
            hunks.append([lo, hi])
    out = ["--- old", "+++ new"]
    for lo, hi in hunks:
        a, b = (sum(op in kinds for op, _ in script[:lo]) for kinds in (" -", " +"))
        na, nb = (sum(op in kinds for op, _ in script[lo:hi]) for kinds in (" -", " +"))
        out.append(f"@@ -{a + 1 if na else a},{na} +{b + 1 if nb else b},{nb} @@")
        out += [op + line for op, line in script[lo:hi]]
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def text_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([unified(a, b) for a, b in zip(old, new)])


#: Fields of a document's metadata that are compared.
METADATA = (
    "title description author published_date language url site_name image favicon word_count source_type content_hash file_path last_modified is_truncated technologies external_id seed_url crawl_depth search_query".split()
)


def content_diff(old: DataFrame, new: DataFrame, key: str, metadata: list[str] | None = None, text: str = "markdown", links: str = "links", words: str = "word_count", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Of the fields that are compared, METADATA unless given: rows (key, status, text_diff, metadata_changes, links_added, links_removed, word_count_delta) of the keys in both."""
    known = metadata if metadata is not None else [c for c in METADATA if c in old.columns and c in new.columns and c not in (key, words)]
    fields = [c for c in known if c not in ignore]
    o = old.select(key, F.struct(*{*fields, text, links, words}).alias("o"))
    n = new.select(key, F.struct(*{*fields, text, links, words}).alias("n"))
    hrefs = lambda side: F.coalesce(F.transform(F.col(f"{side}.{links}"), lambda x: x["href"]), F.array().cast("array<string>"))
    value = lambda side, c: F.to_json(F.col(f"{side}.{c}")) if old.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(f"{side}.{c}").cast("string")
    changes: Column = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.struct(F.lit(c).alias("field"), value("o", c).alias("old"), value("n", c).alias("new"))) for c in fields]))
    j = o.join(n, key).select(
        key,
        text_diff(F.col(f"o.{text}"), F.col(f"n.{text}")).alias("text_diff"),
        changes.alias("metadata_changes"),
        F.filter(hrefs("n"), lambda h: ~F.array_contains(hrefs("o"), h)).alias("links_added"),
        F.filter(hrefs("o"), lambda h: ~F.array_contains(hrefs("n"), h)).alias("links_removed"),
        (F.coalesce(F.col(f"n.{words}"), F.lit(0)) - F.coalesce(F.col(f"o.{words}"), F.lit(0))).cast("long").alias("word_count_delta"),
    )
    same = F.col("text_diff").isNull() & (F.size("metadata_changes") == 0) & (F.size("links_added") == 0) & (F.size("links_removed") == 0) & (F.col("word_count_delta") == 0)
    return j.withColumn("status", F.when(same, "Same").otherwise("Changed"))
