"""Queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import urls as fu
from ..operators import brand, chunk, extract, readable, verticals
from ..operators import relational as rel
from ..operators import store
from ..operators import vector as vec
from ..operators.crawl import crawl
from ..session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def _like(needles: list[str]) -> str:
    return " OR ".join(f"contains(lower(url), '{n}')" for n in needles)


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
#: The lists in SQL are written out, so that the check shows a wrong one.
_TYPE = f"""CASE WHEN url IS NULL THEN NULL WHEN {_like(["github.com", "gitlab.com"])} THEN 'git_hub'
WHEN {_like(["docs.", "readthedocs", "gitbook", "docusaurus", "/docs/", "/documentation/", "devdocs.io", "doc.rust-lang.org", "developer.mozilla.org", "developer.apple.com/documentation"])} THEN 'documentation'
WHEN {_like(["reddit.com", "news.ycombinator.com", "stackoverflow.com", "stackexchange.com", "discourse", "forum", "community."])} THEN 'forum'
WHEN {_like(["twitter.com", "x.com", "linkedin.com", "facebook.com", "instagram.com", "mastodon", "bsky.app"])} THEN 'social'
WHEN {_like(["amazon.", "ebay.", "shopify.", "etsy.com", "/product/", "/shop/", "/cart"])} THEN 'e_commerce' ELSE 'generic' END"""


@query(f"SELECT {_TYPE} AS domain_type, source_type, count(*) AS pages, CAST(sum(word_count) AS BIGINT) AS words FROM contents GROUP BY ALL")
def page_domain_type(spark, d):
    return read(spark, d, "contents").groupBy(fu.domain_type(F.col("url")).alias("domain_type"), "source_type").agg(F.count("*").alias("pages"), F.sum("word_count").alias("words"))


@query(f"SELECT regexp_replace({_HOST}, '^www\\.', '') AS domain, count(*) AS documents, min(url) AS first_url FROM contents GROUP BY ALL")
def pages_per_host(spark, d):
    return rel.domains(read(spark, d, "contents"), "url")


@query(r"SELECT fetch_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url FROM fetch_results")
def url_canonical_index(spark, d):
    return read(spark, d, "fetch_results").select("fetch_id", fu.index_form(F.col("url")).alias("url"))


@query(
    r"""WITH p AS (SELECT fetch_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$', ['s','h','p','t','q','f']) AS x FROM fetch_results)
SELECT fetch_id, CASE WHEN x.s = '' THEN url ELSE lower(x.s) || '://' || lower(x.h) || x.p || CASE WHEN x.t = '' THEN '/' WHEN length(x.t) > 1 AND x.t LIKE '%/' THEN x.t[:-2] ELSE x.t END || x.q END AS url FROM p"""
)
def url_canonical_crawl(spark, d):
    return read(spark, d, "fetch_results").select("fetch_id", fu.crawl_form(F.col("url")).alias("url"))


@query("SELECT url, fetch_id, epoch_us(fetched_at) AS fetched_us FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at, fetch_id) AS r FROM fetch_results) WHERE r = 1")
def url_dedup_first_wins(spark, d):
    return rel.first_wins(read(spark, d, "fetch_results"), ["url"], ["fetched_at", "fetch_id"]).select("url", "fetch_id", F.unix_micros("fetched_at").alias("fetched_us"))


@query(
    """WITH l AS (SELECT url, links, row_number() OVER (PARTITION BY url ORDER BY fetched_at, content_id) AS v FROM contents WHERE url IS NOT NULL),
m AS (SELECT url, max(v) AS last FROM l GROUP BY url), e AS (SELECT url, v, unnest(links).href AS href FROM l)
SELECT url, v AS version, 'added' AS change, href FROM e n WHERE v > 1 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.url = n.url AND o.v = n.v - 1 AND o.href = n.href)
UNION ALL SELECT o.url, o.v + 1, 'removed', o.href FROM e o JOIN m ON m.url = o.url WHERE o.v < m.last AND NOT EXISTS (SELECT 1 FROM e n WHERE n.url = o.url AND n.v = o.v + 1 AND n.href = o.href)"""
)
def links_added_removed(spark, d):
    return rel.link_history(read(spark, d, "contents"), "url", ["fetched_at", "content_id"]).withColumn("version", F.col("version").cast("long"))


@query("SELECT content_id, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos, unnest(links).text AS text, unnest(links).href AS href FROM contents")
def page_links(spark, d):
    return rel.links_of(read(spark, d, "contents"), "content_id")


@query(
    """WITH l AS (SELECT url, title, author, language, markdown, coalesce(word_count, 0) AS words, row_number() OVER w AS v, lag(title) OVER w AS t, lag(author) OVER w AS a, lag(language) OVER w AS g, lag(markdown) OVER w AS m, lag(coalesce(word_count, 0)) OVER w AS o
FROM contents WHERE url IS NOT NULL WINDOW w AS (PARTITION BY url ORDER BY fetched_at, content_id)),
c AS (SELECT *, CASE WHEN v = 1 THEN '' ELSE concat_ws(',', CASE WHEN a IS DISTINCT FROM author THEN 'author' END, CASE WHEN g IS DISTINCT FROM language THEN 'language' END, CASE WHEN m IS DISTINCT FROM markdown THEN 'markdown' END, CASE WHEN t IS DISTINCT FROM title THEN 'title' END) END AS changed, words - coalesce(o, 0) AS delta FROM l)
SELECT url, v AS version, CASE WHEN v = 1 THEN 'New' WHEN changed <> '' OR delta <> 0 THEN 'Changed' ELSE 'Same' END AS status, delta AS word_count_delta, changed FROM c"""
)
def snapshot_diff(spark, d):
    return rel.snapshot_history(read(spark, d, "contents"), "url", ["fetched_at", "content_id"], ["title", "author", "language", "markdown"]).withColumn("version", F.col("version").cast("long"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(spark, d):
    return rel.exact_duplicates(read(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len([x for x in regexp_split_to_array(text, '[ \t\n\r\f]+') if x <> '']) END AS words FROM documents")
def word_count(spark, d):
    return read(spark, d, "documents").select("doc_id", ft.word_count(F.col("text")).cast("long").alias("words"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, line_no, line[:120] AS line FROM l WHERE regexp_matches(line, '(?i)retry|frontier')")
def grep_lines(spark, d):
    return rel.grep(read(spark, d, "documents"), "doc_id", "text", "retry|frontier").withColumn("line_no", F.col("line_no").cast("long"))


_TOKENS = r"[x for x in regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+') if x <> '']"


@query(
    "WITH s AS (SELECT url, title, " + " + ".join(f"(list_contains({_TOKENS.format('url')}, '{t}') OR list_contains({_TOKENS.format('title')}, '{t}'))::INT" for t in ("guide", "score", "column"))
    + " AS score, CASE WHEN regexp_matches(regexp_replace(url, '\\?.*$', ''), '/(LICENSE|README\\.md|CHANGELOG\\.md|CHANGELOG)$') THEN 2 WHEN regexp_replace(url, '\\?.*$', '') LIKE '%all.html' THEN 1 ELSE 0 END AS penalty FROM (SELECT DISTINCT url, title FROM contents)) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, penalty, strlen(url), url, title LIMIT 20"
)
def retrieve_topk(spark, d):
    return rel.top_scored(read(spark, d, "contents").select("url", "title").distinct(), "guide of the score column", 20)


@query(
    """WITH l AS (SELECT content_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM contents),
o AS (SELECT content_id, line, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY content_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
h AS (SELECT content_id, off, trim(regexp_replace(line, '^#{1,3} +', '')) AS title FROM o WHERE regexp_matches(line, '^#{1,3} ')),
c AS (SELECT content_id, unnest(generate_series(0, length(markdown) - 1, 1000)) AS char_offset FROM contents WHERE markdown <> '')
SELECT c.content_id, c.char_offset, h.title AS heading FROM c ASOF LEFT JOIN h ON c.content_id = h.content_id AND c.char_offset >= h.off"""
)
def heading_asof(spark, d):
    pages = read(spark, d, "contents").where("markdown <> ''")
    cuts = pages.select("content_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.length("markdown") - 1).cast("long"), F.lit(1000).cast("long"))).alias("char_offset"))
    return rel.heading_as_of(cuts, rel.headings_of(pages, "content_id", "markdown"), "content_id")


@query("SELECT url, content_hash FROM (SELECT DISTINCT url, content_hash FROM contents WHERE url IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM point_payloads p WHERE p.url = c.url AND p.content_hash = c.content_hash)")
def delta_scan(spark, d):
    return rel.not_indexed(read(spark, d, "contents").where(F.col("url").isNotNull()).select("url", "content_hash").distinct(), read(spark, d, "point_payloads"), ["url", "content_hash"])


@query("SELECT point_id, row_id, url, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY indexed_at DESC, row_id DESC) AS r FROM point_payloads) WHERE r = 1")
def upsert_points(spark, d):
    p = read(spark, d, "point_payloads").select("point_id", "row_id", "url", "chunk_index", F.struct("indexed_at", "row_id").alias("v"))
    return rel.upsert(p.where("chunk_index > 0"), p.where("chunk_index = 0"), "point_id", "v").select("point_id", "row_id", "url", "chunk_index")


@query("WITH k AS (SELECT DISTINCT url, point_id FROM point_payloads WHERE chunk_index <= 3) SELECT row_id FROM point_payloads p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.url = p.url) OR EXISTS (SELECT 1 FROM k WHERE k.url = p.url AND k.point_id = p.point_id)")
def delete_stale_points(spark, d):
    p = read(spark, d, "point_payloads").select("row_id", "url", "point_id", "chunk_index")
    return rel.without_stale(p, p.where("chunk_index <= 3").select("url", "point_id").distinct(), "url", "point_id").select("row_id")


@query("SELECT user_id, event_id, epoch_us(ts) AS ts_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS w FROM events) WHERE u = 1 OR w <= 4")
def changelog_cap(spark, d):
    return rel.cap_history(read(spark, d, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query("WITH s AS (SELECT CASE WHEN row_number() OVER w = 1 THEN 'New' WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 'Same' ELSE 'Changed' END AS status FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT status, count(*) AS n FROM s GROUP BY 1")
def watch_status_counts(spark, d):
    return rel.changes_over_time(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("status").agg(F.count("*").alias("n"))


@query(
    "WITH b AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\n+')) AS block, generate_subscripts(regexp_split_to_array(text, '\\n\\n+'), 1) AS pos FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY pos) AS r FROM b) SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS text FROM k WHERE strlen(block) < 20 OR r = 1 GROUP BY doc_id"
)
def dedup_blocks(spark, d):
    return rel.dedup_blocks(read(spark, d, "documents"), "doc_id", "text")


_LOW = "lower(html)"
_BOT = f"(contains({_LOW}, '_cf_chl_opt') OR contains({_LOW}, 'challenge-platform') OR contains({_LOW}, 'geo.captcha-delivery.com') OR contains({_LOW}, 'captcha-delivery.com/captcha') OR contains({_LOW}, 'awswaf-captcha') OR contains({_LOW}, 'aws-waf-client-browser') OR ((contains({_LOW}, 'just a moment') OR contains({_LOW}, 'checking your browser')) AND contains({_LOW}, 'cf-spinner')) OR ((contains({_LOW}, 'cf-turnstile') OR contains({_LOW}, 'challenges.cloudflare.com/turnstile')) AND strlen(html) < 100000) OR (contains({_LOW}, 'hcaptcha.com') AND contains({_LOW}, 'h-captcha') AND strlen(html) < 50000))"


@query(f"SELECT fetch_id, coalesce({_BOT}, false) AS bot_protected FROM fetch_results")
def bot_protected(spark, d):
    return read(spark, d, "fetch_results").select("fetch_id", ft.bot_protected(F.col("html")).alias("bot_protected"))


_WORDS = r"len([x for x in regexp_split_to_array(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+') if x <> ''])"


@query(f"""SELECT fetch_id, coalesce(contains(html, '<script') AND ((w < 50 AND strlen(html) > 5000) OR (w < 800 AND strlen(html) > 50000 AND (contains({_LOW}, 'react-app') OR contains({_LOW}, 'id="__next"') OR contains({_LOW}, 'id="root"') OR contains({_LOW}, 'id="app"') OR contains({_LOW}, '__next_data__') OR contains({_LOW}, 'nuxt') OR contains({_LOW}, 'ng-app')))), false) AS needs_js FROM (SELECT *, {_WORDS} AS w FROM fetch_results)""")
def needs_js(spark, d):
    return read(spark, d, "fetch_results").select("fetch_id", ft.needs_scripts(ft.word_count(F.regexp_replace("html", r"<[^>]*>", " ")), F.col("html")).alias("needs_js"))


@query(r"SELECT fetch_id FROM fetch_results WHERE regexp_matches(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '^/(guide|help)/[^/]*$') AND NOT regexp_matches(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '^/.*-..$')")
def glob_include_exclude(spark, d):
    path = fu.part(F.col("url"), 4)
    return read(spark, d, "fetch_results").where(fu.glob_match(path, ["/guide/*", "/help/*"]) & ~fu.glob_match(path, ["/**-??"])).select("fetch_id")


@query(r"SELECT content_id, concat_ws(chr(10), '> URL: ' || nullif(url, ''), '> Title: ' || nullif(title, ''), '> Author: ' || nullif(author, ''), '> Published: ' || nullif(published_date, ''), '> Language: ' || nullif(language, ''), CASE WHEN word_count > 0 THEN '> Word count: ' || word_count END) AS header FROM contents")
def metadata_header(spark, d):
    c = F.col
    return read(spark, d, "contents").select("content_id", ft.metadata_header(c("url"), c("title"), c("author"), c("published_date"), c("language"), c("word_count")).alias("header"))


_DOT = "list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[])"


def _knn_sql(where: str = "", dims: int = 64) -> str:
    cut = f"[:{dims}]"
    return f"SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, p.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding{cut}::DOUBLE[], p.embedding{cut}::DOUBLE[]) DESC, p.vec_id) AS rank, list_dot_product(q.embedding{cut}::DOUBLE[], p.embedding{cut}::DOUBLE[]) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0 {where}) WHERE rank <= 10"


def _knn(points: DataFrame, all_points: DataFrame, dims: int) -> DataFrame:
    cut = lambda df: df.withColumn("embedding", vec.truncate(F.col("embedding"), dims))
    queries = cut(all_points).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vec.knn(cut(points), queries, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_knn_sql())
def knn_topk(spark, d):
    e = read(spark, d, "embeddings")
    return _knn(e, e, 64)


@query(_knn_sql("AND p.label = 1"))
def knn_filtered(spark, d):
    e = read(spark, d, "embeddings")
    return _knn(e.where("label = 1"), e, 64)


@query(_knn_sql(dims=16))
def mrl_truncate_knn(spark, d):
    e = read(spark, d, "embeddings")
    return _knn(e, e, 16)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY ALL")
def generic_aggregate(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))


@query("SELECT source_type, is_truncated, count(*) AS points, count(DISTINCT url) AS urls, epoch_us(min(indexed_at)) AS first_indexed, epoch_us(max(indexed_at)) AS last_indexed FROM point_payloads GROUP BY ALL")
def point_counts(spark, d):
    return read(spark, d, "point_payloads").groupBy("source_type", "is_truncated").agg(F.count("*").alias("points"), F.countDistinct("url").alias("urls"), F.unix_micros(F.min("indexed_at")).alias("first_indexed"), F.unix_micros(F.max("indexed_at")).alias("last_indexed"))


@query("SELECT row_id, chunk_index, count(*) OVER (PARTITION BY url) AS chunks_here FROM point_payloads WHERE chunk_index < 100")
def chunks_per_page(spark, d):
    p = read(spark, d, "point_payloads").where("chunk_index < 100")
    return p.select("row_id", "chunk_index", F.count("*").over(rel.Window.partitionBy("url")).alias("chunks_here"))


@query()
def extract_markdown(spark, d):
    return extract.extract_pages(spread(read(spark, d, "fetch_results").select("fetch_id", "url", "html")))


@query()
def page_chunks(spark, d):
    return chunk.chunk_pages(spread(read(spark, d, "contents").select("url", "markdown")), target=256)


_C = r"regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$', ['s','h','p','t','q','f'])"
_CRAWL_FORM = "CASE WHEN {0}.s = '' THEN {1} ELSE lower({0}.s) || '://' || lower({0}.h) || {0}.p || CASE WHEN {0}.t = '' THEN '/' WHEN length({0}.t) > 1 AND {0}.t LIKE '%/' THEN {0}.t[:-2] ELSE {0}.t END || {0}.q END"


@query(
    rf"""WITH p AS (SELECT DISTINCT url, unnest(links).href AS href FROM contents WHERE url IS NOT NULL), x AS (SELECT url, href, {_C.format("url")} AS u, {_C.format("href")} AS h FROM p),
s AS (SELECT url AS u FROM (SELECT url, max(len(links)) AS n FROM contents WHERE url IS NOT NULL GROUP BY url) ORDER BY n DESC, url LIMIT 1), o AS (SELECT {_C.format("u")} AS o, u AS raw FROM s),
e AS (SELECT {_CRAWL_FORM.format("x.u", "x.url")} AS a, {_CRAWL_FORM.format("x.h", "x.href")} AS b FROM x, o WHERE lower(h.s) IN ('http', 'https') AND regexp_replace(lower(h.h), '^www\.', '') = regexp_replace(lower(o.o.h), '^www\.', '') AND h.p = o.o.p
  AND NOT regexp_matches(lower(h.t), '\.(pdf|png|jpg|jpeg|gif|svg|webp|ico|css|js|zip|tar|gz|xml|rss|mp3|mp4|avi|mov|woff|woff2|ttf|eot)$')),
k AS (SELECT DISTINCT {_CRAWL_FORM.format("c.u", "c.url")} AS a FROM (SELECT url, {_C.format("url")} AS u FROM contents WHERE url IS NOT NULL AND len(links) > 0) c), z AS (SELECT {_CRAWL_FORM.format("o.o", "o.raw")} AS u FROM o),
r1 AS (SELECT DISTINCT b AS u FROM e, z WHERE e.a = z.u AND z.u IN (SELECT a FROM k) AND b <> z.u), r2 AS (SELECT DISTINCT b AS u FROM e WHERE e.a IN (SELECT u FROM r1) AND b NOT IN (SELECT u FROM r1) AND b NOT IN (SELECT u FROM z))
SELECT u AS url, depth, u IN (SELECT a FROM k) AS found FROM (SELECT u, 0 AS depth FROM z UNION ALL SELECT u, 1 FROM r1 UNION ALL SELECT u, 2 FROM r2)"""
)
def crawl_levels(spark, d):
    pages = read(spark, d, "contents").where(F.col("url").isNotNull())
    links = pages.select("url", F.posexplode("links.href").alias("pos", "href"))
    start = pages.groupBy("url").agg(F.max(F.size("links")).alias("n")).orderBy(F.desc("n"), "url").first()["url"]
    return crawl(spark, links, start, max_depth=2, max_pages=50_000).select("url", F.col("depth").cast("int").alias("depth"), "found")


@query(
    """WITH v AS (SELECT url, epoch_us(fetched_at) AS us, title, markdown, row_number() OVER w AS n, lag(title) OVER w AS t, lag(markdown) OVER w AS m FROM contents WHERE url IS NOT NULL WINDOW w AS (PARTITION BY url ORDER BY fetched_at, content_id))
SELECT url, count(*) AS fetch_count, min(us) AS first_seen, max(us) AS last_fetched, least(100, count(*) FILTER (WHERE n = 1 OR t IS DISTINCT FROM title OR m IS DISTINCT FROM markdown)) AS entries FROM v GROUP BY url"""
)
def store_merge(spark, d):
    pages = read(spark, d, "contents").where(F.col("url").isNotNull()).select("url", "title", "markdown", "fetched_at", "content_id")
    return store.build(pages, ["fetched_at", "content_id"]).select("url", "fetch_count", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_fetched").alias("last_fetched"), F.size("changelog").cast("long").alias("entries"))


@query()
def readable_text(spark, d):
    return readable.to_readable(spread(read(spark, d, "contents").select("content_id", "markdown")), "content_id", "markdown")


_CSS = r"""WITH c AS (SELECT fetch_id, concat_ws(';', array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), ';'), array_to_string(regexp_extract_all(html, '(?is)\sstyle\s*=\s*"([^"]*)"', 1), ';')) AS css FROM fetch_results),
d AS (SELECT fetch_id, unnest(regexp_extract_all(css, '(?i)([a-z-]+\s*:\s*[^;{}]+)', 1)) AS x FROM c),
v AS (SELECT fetch_id, regexp_extract(x, ':\s*(.*)$', 1) AS value FROM d),
h AS (SELECT fetch_id, lower(CASE WHEN regexp_extract(value, '#([0-9a-fA-F]{6})(?:[0-9a-fA-F]{2})?(?:[^0-9a-fA-F]|$)', 1) <> '' THEN regexp_extract(value, '#([0-9a-fA-F]{6})(?:[0-9a-fA-F]{2})?(?:[^0-9a-fA-F]|$)', 1)
 WHEN regexp_extract(value, '#([0-9a-fA-F]{3})[0-9a-fA-F]?(?:[^0-9a-fA-F]|$)', 1) <> '' THEN regexp_replace(regexp_extract(value, '#([0-9a-fA-F]{3})[0-9a-fA-F]?(?:[^0-9a-fA-F]|$)', 1), '(.)(.)(.)', '\1\1\2\2\3\3')
 WHEN regexp_matches(value, '(?i)rgba?\(\s*\d') THEN printf('%02x%02x%02x', least(255, regexp_extract(value, '(?i)rgba?\(\s*(\d{1,3})\s*[, ]\s*(\d{1,3})\s*[, ]\s*(\d{1,3})', 1)::INT), least(255, regexp_extract(value, '(?i)rgba?\(\s*(\d{1,3})\s*[, ]\s*(\d{1,3})\s*[, ]\s*(\d{1,3})', 2)::INT), least(255, regexp_extract(value, '(?i)rgba?\(\s*(\d{1,3})\s*[, ]\s*(\d{1,3})\s*[, ]\s*(\d{1,3})', 3)::INT)) END) AS hex FROM v),
g AS (SELECT fetch_id, '#' || hex AS hex, count(*) AS n FROM h WHERE length(hex) = 6 AND hex NOT IN ('ffffff', '000000', 'f8f8f8', 'f5f5f5', 'eeeeee', 'e5e5e5', 'dddddd', 'd4d4d4', 'cccccc', 'bbbbbb', 'aaaaaa', '999999', '888888', '777777', '666666', '555555', '444444', '333333', '222222', '111111', 'f0f0f0', 'e0e0e0', 'd0d0d0', 'c0c0c0', 'b0b0b0', 'a0a0a0', '909090', '808080', '707070', '606060', '505050', '404040', '303030', '202020', '101010', 'fafafa', 'f9f9f9', 'f7f7f7', 'f4f4f4', 'f3f3f3', 'f2f2f2', 'f1f1f1', 'efefef', 'ebebeb', 'e8e8e8') GROUP BY ALL)
SELECT fetch_id, hex, n AS count, rank FROM (SELECT *, row_number() OVER (PARTITION BY fetch_id ORDER BY n DESC, hex) AS rank FROM g) WHERE rank <= 10"""


@query(_CSS)
def brand_colours(spark, d):
    found = brand.colours(brand.declarations(spread(read(spark, d, "fetch_results").select("fetch_id", "html")), "fetch_id", "html"), "fetch_id")
    return found.select("fetch_id", "hex", "count", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id, json_extract_string(props, '$.page') AS page, count(*) AS n FROM events GROUP BY ALL")
def event_properties(spark, d):
    page = F.try_variant_get(F.try_parse_json("props"), "$.page", "string")
    return read(spark, d, "events").groupBy("user_id", page.alias("page")).agg(F.count("*").alias("n"))


# Names under which the forms over all versions were first registered.
for _name in ("links_added_removed", "snapshot_diff", "store_merge"):
    QUERIES[f"{_name}_all"], SQL[f"{_name}_all"] = QUERIES[_name], SQL[_name]
