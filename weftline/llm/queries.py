"""Queries of the problems and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .budget import token_budget, token_estimates
from .chunking import split_oversized
from .common import table
from .encode import decode_ids, encode_ids
from .markup import clean_markup
from .neardup import expand, groups, similar_pairs
from .pack import pack
from .repeated_lines import repeated, sequences, without_repeated
from .residue import residue
from .toxicity import rates, score_content
from .wrapper import furniture, main_body


def limits(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "size_limits").where(F.col("purpose") == purpose).first()
    return int(row["max_tokens"]), int(row["overlap_tokens"] or 0)


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks", "chunk_id", "text", "char_offset", "section_header"), *limits(spark, d, "chunk"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    limit = limits(spark, d, "chunk")[0]
    return p1_pieces(spark, d).where((F.col("piece_index") == 0) & (F.col("source_tokens") > limit)).select("chunk_id")


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each text put together again from its pieces, by their offsets, and how many pieces are above the limit."""
    limit = limits(spark, d, "chunk")[0]
    piece = F.struct("piece_index", F.col("char_offset").alias("at"), F.col("text").alias("t"))
    whole = p1_pieces(spark, d).groupBy("chunk_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.count_if(F.col("token_estimate") > limit).alias("above"))  # bounded by one text
    first = F.element_at("p", 1)["at"]
    text = F.aggregate("p", F.lit(""), lambda s, x: F.concat(s, F.substring(x["t"], (F.length(s) - (x["at"] - first) + 1).cast("int"), F.length(x["t"]))))
    return whole.select("chunk_id", text.alias("text"), "above")


def p2_marked(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "fetch_results", "fetch_id", "url", "html"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_marked(spark, d).where("residue").select("fetch_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated(table(spark, d, "point_payloads")).select("row_id", "line_no")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated(table(spark, d, "point_payloads"))


def p3_sequences(spark: SparkSession, d: str) -> DataFrame:
    return sequences(table(spark, d, "point_payloads"))


def p4_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget(table(spark, d, "point_payloads"), table(spark, d, "language_tags"))


def p4_estimates(spark: SparkSession, d: str) -> DataFrame:
    return token_estimates(table(spark, d, "point_payloads"), table(spark, d, "language_tags"))


def p4_budget_rows(spark: SparkSession, d: str) -> DataFrame:
    """The slices of the budget and their rows, which SQL can count."""
    return p4_budget(spark, d).select("source_type", "language", "domain", "rows")


_MARKUP = {"contents": ("content_id", {"markdown": False, "plain_text": True}), "point_payloads": ("row_id", {"text": False})}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = [clean_markup(table(spark, d, t, key, *columns), key, columns, with_text=False).where("found").select(F.lit(t).alias("source_table"), "record_id") for t, (key, columns) in _MARKUP.items()]
    return out[0].unionByName(out[1])


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    out = [clean_markup(table(spark, d, t, key, *columns), key, columns).withColumn("source_table", F.lit(t)) for t, (key, columns) in _MARKUP.items()]
    return out[0].unionByName(out[1], allowMissingColumns=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture(table(spark, d, "contents", "content_id", "url", "markdown"))


def p6_main(spark: SparkSession, d: str) -> DataFrame:
    return main_body(table(spark, d, "contents", "content_id", "url", "markdown"), "content_id", "url", "markdown")


def p6_main_html(spark: SparkSession, d: str) -> DataFrame:
    return main_body(table(spark, d, "fetch_results", "fetch_id", "url", "html"), "fetch_id", "url", "html", html=True)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return expand(*similar_pairs(table(spark, d, "contents"))).select(F.col("a").alias("content_id_a"), F.col("b").alias("content_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(table(spark, d, "contents"))


def p7_group_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the pages of each group."""
    pages = p7_groups(spark, d).join(table(spark, d, "contents").select("content_id", "url"), "content_id").where(F.col("url").isNotNull()).select("group_id", "url").distinct()
    return table(spark, d, "point_payloads").join(pages, "url").select("group_id", "url", "row_id", "chunk_index")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_ids(table(spark, d, "documents", "doc_id", "text"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode_ids(p8_ids(spark, d))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were packed, and containers above the capacity."""
    capacity = limits(spark, d, "container")[0]
    packed = p9_containers(spark, d)
    filled = packed.groupBy("container_id").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("above"))
    return packed.agg(F.countDistinct("doc_id").alias("documents")).crossJoin(filled)  # two single rows


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents", "doc_id", "text"), capacity=limits(spark, d, "container")[0])


def p10_scored(spark: SparkSession, d: str) -> DataFrame:
    return score_content(table(spark, d, "documents"), table(spark, d, "toxicity_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scored(spark, d).where("unacceptable").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(p10_scored(spark, d))


def p10_rate_rows(spark: SparkSession, d: str) -> DataFrame:
    """The sources of the rates and their documents, which SQL can count."""
    return p10_rates(spark, d).select("source", "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p2_found, p2_marked, p3_found, p3_clean, p3_sequences, p4_budget, p4_budget_rows, p4_estimates, p5_found, p5_clean, p6_found, p6_main, p6_main_html, p7_found, p7_groups, p7_group_chunks, p8_ids, p8_decoded, p9_containers, p9_checked, p10_found, p10_scored, p10_rates, p10_rate_rows)}

_REPEATED = """
WITH lines AS (
  SELECT row_id, lower(domain) AS d, url, line_no - 1 AS line_no, lower(regexp_replace(line, '[^\\p{L}]', '', 'g')) AS k
  FROM (SELECT row_id, domain, url, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM point_payloads WHERE domain IS NOT NULL AND domain <> '')
), frequent AS (SELECT d, k FROM lines WHERE length(k) >= 15 GROUP BY d, k HAVING count(DISTINCT url) >= 5)
"""

_OCCURRENCES = _REPEATED + ", occurrences AS (SELECT row_id, line_no FROM lines JOIN frequent USING (d, k))"

SQL: dict[str, str] = {
    "p3_found": _REPEATED + "SELECT row_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN frequent USING (d, k)",
    "p3_clean": _OCCURRENCES
    + """, gone AS (SELECT row_id, count(*) AS n FROM occurrences GROUP BY row_id), whole AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM point_payloads),
kept AS (SELECT row_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM whole w WHERE NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.row_id = w.row_id AND o.line_no = w.line_no) GROUP BY row_id)
SELECT p.row_id, CASE WHEN g.n IS NULL THEN p.text ELSE coalesce(k.text, '') END AS text, CAST(coalesce(g.n, 0) AS INTEGER) AS removed FROM point_payloads p LEFT JOIN gone g ON g.row_id = p.row_id LEFT JOIN kept k ON k.row_id = p.row_id""",
    "p1_rebuilt": "SELECT chunk_id, text, 0 AS above FROM chunks",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_checked": "SELECT count(*) AS documents, 0 AS above FROM documents",
    "p10_rate_rows": "SELECT source, count(*) AS documents FROM documents GROUP BY source",
    "p7_found": r"""
WITH words AS (SELECT content_id, regexp_extract_all(regexp_replace(lower(markdown), '([\x{3041}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM contents WHERE markdown <> ''),
grams AS (SELECT DISTINCT content_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM words WHERE len(w) >= 3),
sizes AS (SELECT content_id, count(*) AS n FROM grams GROUP BY content_id),
met AS (SELECT a.content_id AS x, b.content_id AS y, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.content_id < b.content_id GROUP BY 1, 2)
SELECT x AS content_id_a, y AS content_id_b FROM met JOIN sizes s ON s.content_id = x JOIN sizes t ON t.content_id = y WHERE shared >= 0.6 * (s.n + t.n - shared)""",
    "p4_budget_rows": """
SELECT lower(source_type) AS source_type, coalesce(t.lang, 'unknown') AS language, lower(domain) AS domain, count(*) AS rows FROM point_payloads p LEFT JOIN (SELECT tag, min(lang) AS lang FROM language_tags WHERE tag IS NOT NULL AND lang IS NOT NULL GROUP BY tag) t ON t.tag = p.language GROUP BY 1, 2, 3""",
}
