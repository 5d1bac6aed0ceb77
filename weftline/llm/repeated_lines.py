"""Problem 3: lines that a source repeats over many of its documents, by distributed PrefixSpan.

The sequences are the line identifiers of each text, the databases are the
sources.  The first level counts single lines.  Each further level extends the
frequent sequences by the frequent line that follows, within the texts that hold
the prefix (the projected database), until none is frequent.  Support is the
number of distinct documents.  Every line of an occurrence of a frequent sequence,
single lines included, is repeated; the levels tell how long the sequence is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Production parameters: distinct documents, and letters of a line.
SUPPORT, LETTERS = 5, 15


def line_key(line: Column) -> Column:
    """The letters of a line in lower case: what makes two lines the same."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]", ""))


def lines_of(df: DataFrame, key: str = "row_id", text: str = "text", domain: str = "domain", doc: str = "url", letters: int = LETTERS, named: bool = False) -> DataFrame:
    """Rows (_key, line_no, _a, _b, _d) of every line that can count: hashes of the line within its source, and of the document; with *named* also domain and _id, the line's key."""
    split = df.where(F.col(domain).isNotNull() & (F.col(domain) != "") & F.col(doc).isNotNull()).select(F.col(key).alias("_key"), F.lower(domain).alias("domain"), F.col(doc).alias("_doc"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "_line"))
    keyed = split.where(F.length("_line") >= letters).withColumn("_id", line_key(F.col("_line"))).where(F.length("_id") >= letters)
    # Two independent hashes stand for the text of a line, so texts aren't shuffled.
    return keyed.select("_key", "line_no", F.xxhash64("domain", "_id").alias("_a"), F.hash("_id", "domain").alias("_b"), F.xxhash64("_doc").alias("_d"), *(("domain", "_id") if named else ()))


def _mined(df: DataFrame, key: str, text: str, domain: str, doc: str, support: int, letters: int, longest: int | None, named: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels: frequent sequences (_x, _y, domain, length, lines, support), and where they begin in the texts (_key, line_no, _at, length).

    With *named* false domain and lines are null, so that no text of a line is shuffled.
    """
    names = ("domain", "_id") if named else ()
    base = lines_of(df, key, text, domain, doc, letters, named)
    pairs = base.select("_a", "_b", "_d", *names).distinct()
    first = pairs.groupBy("_a", "_b").agg(F.count("*").alias("support"), *[F.min(c).alias(c) for c in names]).where(F.col("support") >= support)
    first = stored(first if named else first.withColumns({"domain": F.lit(None).cast("string"), "_id": F.lit(None).cast("string")}), "first")
    # Only frequent lines can be in a longer sequence; their order in a text is all that is kept. A hot source is spread by text.
    window = Window.partitionBy("_key").orderBy("_at")
    at = F.row_number().over(Window.partitionBy("_key").orderBy("line_no"))
    ids = base.join(first.select("_a", "_b", "support"), ["_a", "_b"]).withColumn("_at", at)
    known = stored(ids.select("_key", "_at", "line_no", "support", "_d", "_a", "_b", F.col("_a").alias("_x"), F.col("_b").alias("_y")), "lines")
    # Of a sequence, _x and _y are two independent hashes: texts aren't shuffled. A sequence is frequent only if what is left of it without its first or last line is.
    levels = [first.select(F.col("_a").alias("_x"), F.col("_b").alias("_y"), "domain", F.lit(1).alias("length"), F.array("_id").alias("lines"), "support")]
    starts, length = [known.select("_key", "line_no", "_at", F.lit(1).alias("length"), "support")], 1
    while longest is None or length < longest:
        ahead = known.select("_key", "_at", "line_no", "_d", "_a", "_b", "_x", "_y", F.lead("_at").over(window).alias("_next"), F.lead("_x").over(window).alias("_p"), F.lead("_y").over(window).alias("_q"))
        grown = ahead.where(F.col("_next") == F.col("_at") + 1).select("_key", "_at", "line_no", "_d", "_a", "_b", "_p", "_q", F.xxhash64("_a", "_b", "_p", "_q").alias("_x"), F.hash("_q", "_p", "_b", "_a").alias("_y"))
        count = grown.select("_x", "_y", "_a", "_b", "_p", "_q", "_d").distinct().groupBy("_x", "_y").agg(F.min_by(F.struct("_a", "_b", "_p", "_q"), F.struct("_a", "_b", "_p", "_q")).alias("_s"), F.count("*").alias("support")).where(F.col("support") >= support)
        count = stored(count.select("_x", "_y", "_s.*", "support"), "counts")
        if count.isEmpty():
            break
        length += 1
        if named:
            # The lines of a sequence are its first line and those of the rest, a sequence of the level before.
            heads = levels[0].select(F.col("_x").alias("_a"), F.col("_y").alias("_b"), "domain", F.col("lines").alias("_head"))
            rest = levels[-1].select(F.col("_x").alias("_p"), F.col("_y").alias("_q"), "lines")
            level = count.join(heads, ["_a", "_b"]).join(rest, ["_p", "_q"])
            levels.append(stored(level.select("_x", "_y", "domain", F.lit(length).alias("length"), F.concat("_head", "lines").alias("lines"), "support"), "level"))
        known = stored(grown.join(count.select("_x", "_y"), ["_x", "_y"], "left_semi").select("_key", "_at", "line_no", "_d", "_a", "_b", "_x", "_y"), "lines")
        starts.append(known.select("_key", "line_no", "_at", F.lit(length).alias("length"), F.lit(0).cast("long").alias("support")))
    return levels, starts


def sequences(df: DataFrame, key: str = "row_id", text: str = "text", domain: str = "domain", doc: str = "url", support: int = SUPPORT, letters: int = LETTERS, longest: int | None = None) -> DataFrame:
    """Rows (domain, length, lines array<string>, support): the frequent sequences of lines that follow each other directly, of any length unless *longest* is given.

    The lines are given as their keys (letters in lower case); lines that are not
    frequent are passed over.  A level holds the occurrences (text and place) of
    the frequent sequences of its length and is grown from those of the level
    before, until none is frequent.
    """
    levels, _ = _mined(df, key, text, domain, doc, support, letters, longest, True)
    return reduce(DataFrame.unionByName, levels).select("domain", "length", "lines", "support")


def repeated(df: DataFrame, key: str = "row_id", text: str = "text", domain: str = "domain", doc: str = "url", support: int = SUPPORT, letters: int = LETTERS) -> DataFrame:
    """Rows (*key*, line_no, support, longest): every line that occurs in a frequent sequence of its source, and how many lines the longest such sequence there has.

    Lines are split at LF and counted from 0.  support is that of the line alone.
    Rows with a null or empty source or a null document neither count nor come
    out; null and empty texts have no such lines.  Rows delivered twice count
    once, as support is of distinct documents, but each comes out (the key is
    unique).  Extra columns are ignored.
    """
    _, starts = _mined(df, key, text, domain, doc, support, letters, None, False)
    longest = reduce(DataFrame.unionByName, starts).repartition("_key").groupBy("_key", "_at").agg(F.max("length").alias("length"), F.max("line_no").alias("line_no"), F.max("support").alias("support"))
    window = Window.partitionBy("_key").orderBy("_at")
    # A sequence that begins within one that ends no earlier covers nothing more; the others are spread over their lines.
    before = F.coalesce(F.lag(F.col("_at") + F.col("length")).over(window), F.lit(0))
    spread = longest.withColumn("_most", F.when(before < F.col("_at") + F.col("length"), F.col("length")).otherwise(F.lit(0)))
    spread = spread.select("_key", "_at", "line_no", "support", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("_most") - 1))).alias("_k"), "_most")
    cover = spread.select("_key", (F.col("_at") + F.col("_k")).alias("_at"), F.when(F.col("_k") == 0, F.col("line_no")).alias("line_no"), F.when(F.col("_k") == 0, F.col("support")).alias("support"), F.greatest(F.lit(1), "_most").alias("longest"))
    found = cover.groupBy("_key", "_at").agg(F.max("line_no").alias("line_no"), F.max("support").alias("support"), F.max("longest").alias("longest"))
    return found.select(F.col("_key").alias(key), F.col("line_no").cast("int").alias("line_no"), "support", "longest")


def without_repeated(df: DataFrame, key: str = "row_id", text: str = "text", domain: str = "domain", doc: str = "url", support: int = SUPPORT, letters: int = LETTERS) -> DataFrame:
    """Rows (*key*, text, removed): every text without its repeated lines and the number of them; rows without any come out as they are."""
    gone = repeated(df, key, text, domain, doc, support, letters).groupBy(key).agg(F.collect_set("line_no").alias("_gone"))  # bounded by the lines of one text
    kept = F.expr("array_join(filter(split(_text, '\n', -1), (x, i) -> not array_contains(_gone, i)), '\n')")
    base = df.select(F.col(key), F.col(text).alias("_text")).join(gone, key, "left")
    return base.select(key, F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias(text), F.coalesce(F.size("_gone"), F.lit(0)).alias("removed"))
