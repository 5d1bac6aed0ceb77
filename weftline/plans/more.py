"""Queries of the operators around documents: catalogue, discovery, sites, hooks, files; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import urls as fu
from ..operators import brand, catalogue, readable, site_pages, verticals
from ..operators import diff as dif
from ..operators import relational as rel
from ..sources import discover
from ..streaming import events
from .queries import _TYPE, QUERIES, SQL, query, read

_URL = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$', ['s','h','p','t','q','f'])"
_CLEAN = r"coalesce(nullif(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9_\-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'index')"
_DOMAIN = "CASE WHEN x.h <> '' THEN " + _CLEAN.format(r"regexp_replace(lower(x.h), '^www\.', '')") + " END"


@query(
    rf"""WITH p AS (SELECT fetch_id, url, {_URL} AS x FROM fetch_results), k AS (SELECT fetch_id, url, x, {_DOMAIN} || '/' || coalesce(nullif(array_to_string([{_CLEAN.format("s")} FOR s IN string_split(x.t, '/') IF s NOT IN ('', '.', '..')], '/'), ''), 'index') AS key FROM p),
h AS (SELECT *, list_reduce([14695981039346656037::UHUGEINT] || [ord(c)::UHUGEINT FOR c IN string_split(url, '')], lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS f FROM k)
SELECT fetch_id, CASE WHEN x.q <> '' OR length(key) > 240 THEN key[:223] || '_' || lpad(lower(to_hex(f::UBIGINT)), 16, '0') ELSE key END AS key, {_DOMAIN} AS domain FROM h"""
)
def store_keys(spark, d):
    return read(spark, d, "fetch_results").select("fetch_id", fu.store_key(F.col("url")).alias("key"), fu.store_domain(F.col("url")).alias("domain"))


@query(rf"WITH p AS (SELECT DISTINCT url, {_URL} AS x FROM contents WHERE url IS NOT NULL) SELECT url, 'https://' || replace({_DOMAIN}, '_', '.') || '/' || coalesce(nullif(array_to_string([{_CLEAN.format('s')} FOR s IN string_split(x.t, '/') IF s NOT IN ('', '.', '..')], '/'), ''), '') AS likely FROM p WHERE x.q = '' AND length(url) < 200")
def store_key_inverse(spark, d):
    u = read(spark, d, "contents").where(F.col("url").isNotNull() & (fu.part(F.col("url"), 5) == "") & (F.length("url") < 200)).select("url").distinct()
    return u.select("url", fu.store_url(fu.store_key(F.col("url"))).alias("likely"))


@query("SELECT count(*) FILTER (status BETWEEN 200 AND 299 AND html <> '') AS ok, count(*) FILTER (NOT coalesce(status BETWEEN 200 AND 299 AND html <> '', false)) AS errors, 0::BIGINT AS excluded, coalesce(sum(elapsed_ms), 0)::BIGINT AS elapsed_ms FROM fetch_results")
def crawl_totals(spark, d):
    return catalogue.crawl_totals(read(spark, d, "fetch_results"), ok="coalesce(status between 200 and 299 and html <> '', false)")


@query("SELECT count(*) AS jobs, count(*) FILTER (token_estimate IS NULL) AS failed, coalesce(sum(token_estimate), 0)::BIGINT AS total_token_estimate, coalesce(sum(total_chunks) FILTER (token_estimate IS NOT NULL), 0)::BIGINT AS total_total_chunks, coalesce(floor(sum(token_estimate) / count(token_estimate)), 0)::BIGINT AS avg_token_estimate, coalesce(floor(sum(total_chunks) FILTER (token_estimate IS NOT NULL) / count(token_estimate)), 0)::BIGINT AS avg_total_chunks FROM point_payloads")
def session_counters(spark, d):
    return catalogue.session_counters(read(spark, d, "point_payloads"), "token_estimate", "total_chunks", failed="token_estimate IS NULL")


@query(
    """WITH v AS (SELECT url, content_hash, row_number() OVER (PARTITION BY url ORDER BY fetched_at, content_id) AS f, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, content_id DESC) AS l FROM contents WHERE url IS NOT NULL),
o AS (SELECT url, content_hash FROM v WHERE f = 1), n AS (SELECT url, content_hash FROM v WHERE l = 1 AND f > 1)
SELECT CASE WHEN n.url IS NULL THEN 'skipped' WHEN n.content_hash IS NULL THEN 'failed' WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM o LEFT JOIN n ON o.url = n.url GROUP BY 1"""
)
def refresh_summary(spark, d):
    v = rel.versions_of(read(spark, d, "contents").select("url", "content_hash", "fetched_at", "content_id"), "url", ["fetched_at", "content_id"])
    return catalogue.refresh_summary(v.where("version = 1"), v.where("version = versions and version > 1"), "url", "content_hash", "content_hash IS NULL")


@query("SELECT lower(domain) AS folder, count(*) AS files, sum(length(text))::BIGINT AS bytes, 0 AS mark FROM point_payloads WHERE domain IS NOT NULL GROUP BY 1")
def folder_sizes(spark, d):
    return catalogue.folder_sizes(read(spark, d, "point_payloads").where("domain is not null").select(F.lower("domain").alias("folder"), F.length("text").alias("length")))


@query("SELECT user_id AS folder, epoch_us(ts) AS at_us, bytes::BIGINT AS bytes, (bytes - o)::BIGINT AS grown, CASE WHEN bytes - l > 524288000 THEN 'spike' ELSE 'mark' END AS event FROM (SELECT *, coalesce(l, 0) AS o FROM (SELECT *, lag(bytes) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM (SELECT user_id, ts, event_id, (event_id * 7919 % 12000)::BIGINT * 1000000 AS bytes FROM events))) WHERE bytes - l > 524288000 OR (bytes >= 1073741824 AND o < 1073741824) OR (bytes >= 5368709120 AND o < 5368709120) OR (bytes >= 10737418240 AND o < 10737418240)")
def folder_size_events(spark, d):
    looks = read(spark, d, "events").select(F.col("user_id").alias("folder"), F.struct("ts", "event_id").alias("at"), ((F.col("event_id") * 7919 % 12000).cast("long") * 1_000_000).alias("bytes"))
    return catalogue.size_events(looks).select("folder", F.unix_micros(F.col("at.ts").cast("timestamp")).alias("at_us"), "bytes", "grown", "event")


@query("SELECT content_id, url, title FROM contents WHERE url IS NOT NULL ORDER BY url, content_id LIMIT 50 OFFSET 100")
def listing_page(spark, d):
    return catalogue.page_of(read(spark, d, "contents").where(F.col("url").isNotNull()).select("content_id", "url", "title"), ["url", "content_id"], page=2)


@query(rf"WITH p AS (SELECT *, {_URL} AS x FROM contents) SELECT {_DOMAIN} AS domain, count(*) AS documents, sum(word_count)::BIGINT AS words, epoch_us(max(fetched_at)) AS last_us FROM p GROUP BY 1")
def store_manifest(spark, d):
    return catalogue.manifest(read(spark, d, "contents")).select("domain", "documents", "words", F.unix_micros("last_fetched").alias("last_us"))


@query(r"SELECT content_id, regexp_replace(url, '\?[^#]*', '') AS url, NULL::VARCHAR AS file_path, word_count FROM contents")
def store_sanitised(spark, d):
    return catalogue.sanitised(read(spark, d, "contents").select("content_id", "url", "file_path", "word_count"))


@query("WITH v AS (SELECT url, markdown, row_number() OVER (PARTITION BY url ORDER BY fetched_at, content_id) AS f, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, content_id DESC) AS l FROM contents WHERE url IS NOT NULL), o AS (SELECT * FROM v WHERE f = 1 AND l > 1), n AS (SELECT * FROM v WHERE l = 1) SELECT n.url, CASE WHEN o.url IS NULL THEN 'New' ELSE 'Changed' END AS outcome FROM n LEFT JOIN o ON o.url = n.url WHERE o.url IS NULL OR o.markdown IS DISTINCT FROM n.markdown")
def write_if_changed(spark, d):
    v = rel.versions_of(read(spark, d, "contents").select("url", "markdown", "fetched_at", "content_id"), "url", ["fetched_at", "content_id"])
    return catalogue.changed_only(v.where("version = versions"), v.where("version = 1 and versions > 1"), "url", "markdown").select("url", "outcome")


@query("SELECT DISTINCT url, content_hash, CASE WHEN EXISTS (SELECT 1 FROM point_payloads p WHERE p.url = c.url AND p.content_hash = c.content_hash) THEN 'Exists' ELSE 'NotIndexed' END AS state FROM contents c WHERE url IS NOT NULL")
def index_existence(spark, d):
    return catalogue.existence(read(spark, d, "contents").where(F.col("url").isNotNull()).select("url", "content_hash").distinct(), read(spark, d, "point_payloads"), ["url", "content_hash"])


@query(
    r"""WITH c AS (SELECT url, min(site_name) AS site_name FROM contents WHERE url IS NOT NULL GROUP BY url HAVING count(*) = 1)
SELECT row_id, p.url, p.title, coalesce(p.domain, lower(regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS domain, (c.url IS NOT NULL) AS known FROM point_payloads p LEFT JOIN c ON c.url = p.url"""
)
def point_payload_build(spark, d):
    once = read(spark, d, "contents").where(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("n"), F.lit(1).alias("crawl_depth")).where("n = 1")
    built = catalogue.point_payloads(read(spark, d, "point_payloads").select("row_id", "url", "title", "domain"), once)
    return built.select("row_id", "url", "title", "domain", F.col("crawl_depth").isNotNull().alias("known"))


@query(
    """WITH m AS (SELECT url AS a, min(h) AS b FROM (SELECT url, unnest(links).href AS h FROM contents WHERE url IS NOT NULL AND fetched_at < TIMESTAMP '2024-01-15') WHERE h LIKE 'http%' GROUP BY url), s AS (SELECT DISTINCT url FROM contents WHERE url IS NOT NULL),
r AS (SELECT s.url, s.url AS f, 0 AS hops FROM s), h1 AS (SELECT r.url, m.b AS f, 1 AS hops FROM r JOIN m ON m.a = r.f), h2 AS (SELECT h1.url, m.b AS f, 2 AS hops FROM h1 JOIN m ON m.a = h1.f), h3 AS (SELECT h2.url, m.b AS f, 3 AS hops FROM h2 JOIN m ON m.a = h2.f),
e AS (SELECT * FROM r UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
SELECT url, f AS final, hops, hops < 3 OR f NOT IN (SELECT a FROM m) AS valid, CASE WHEN hops = 3 AND f IN (SELECT a FROM m) THEN 'too many hops' END AS reason FROM e WHERE hops = 3 OR f NOT IN (SELECT a FROM m)"""
)
def redirect_chains(spark, d):
    pages = read(spark, d, "contents").where(F.col("url").isNotNull())
    moves = pages.where("fetched_at < timestamp '2024-01-15'").select(F.col("url").alias("source"), F.explode("links.href").alias("target")).where(F.col("target").startswith("http"))
    return catalogue.redirect_chains(pages.select("url").distinct(), moves, most=3)


@query(
    """WITH v AS (SELECT file_path AS path, length(markdown) AS length, content_hash AS digest, epoch_us(stored_at) AS modified, row_number() OVER (PARTITION BY file_path ORDER BY stored_at, content_id) AS f FROM contents WHERE file_path IS NOT NULL),
a AS (SELECT * FROM v WHERE f = 1 AND ord(right(path, 4)[1]) % 2 = 0), b AS (SELECT * FROM v WHERE f = 1 AND length(path) % 3 > 0)
SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'created' ELSE 'removed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL"""
)
def file_listing_changes(spark, d):
    files = rel.versions_of(read(spark, d, "contents").select(F.col("file_path").alias("path"), F.length("markdown").alias("length"), F.unix_micros("stored_at").alias("modified"), F.lit(None).cast("string").alias("digest"), "stored_at", "content_id"), "path", ["stored_at", "content_id"]).where("version = 1")
    a, b = files.where(F.ascii(F.substring(F.expr("right(path, 4)"), 1, 1)) % 2 == 0), files.where(F.length("path") % 3 > 0)
    return events.file_changes(a, b).select("path", "change")


@query("SELECT event_id, user_id, CASE WHEN event_type IS NULL THEN 'NeverStarted' WHEN event_type = 'purchase' THEN 'Done' WHEN event_type = 'click' AND user_id IN (1, 2, 3, 5, 8, 13, 21) THEN 'Running' ELSE 'Stale' END AS state FROM events")
def crawl_states(spark, d):
    phase = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", "user_id", events.crawl_state(phase, F.col("user_id"), F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 5, 8, 13, 21)])).alias("state"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, ts FROM events WHERE upper(event_type) = 'CLICK' ORDER BY ts DESC, event_id DESC LIMIT 50)")
def log_tail(spark, d):
    return events.log_tail(read(spark, d, "events").withColumns({"level": F.col("event_type")}), 50, "click", ("ts", "event_id")).select("event_id", "user_id")


@query(r"SELECT content_id, array_to_string([w FOR w IN regexp_split_to_array(regexp_replace(lower(title), '[^\p{L}\p{N} ]', ' ', 'g'), ' +') IF w <> ''], '-')[:60] AS slug, CASE WHEN title IS NOT NULL AND markdown IS NOT NULL THEN array_to_string([w FOR w IN regexp_split_to_array(regexp_replace(lower(title), '[^\p{L}\p{N} ]', ' ', 'g'), ' +') IF w <> ''], '-')[:60] || '-' || sha256(markdown)[:32] END AS key FROM contents")
def research_keys(spark, d):
    return read(spark, d, "contents").select("content_id", ft.slug(F.col("title")).alias("slug"), ft.research_key(F.col("title"), F.col("markdown")).alias("key"))


@query(r"SELECT fetch_id, coalesce(strlen(html) <= 15000 AND regexp_matches(lower(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '^(just a moment|attention required|access denied|checking your browser|please wait|one more step|verify you are human|bot verification|security check|ddos protection)'), false) AS challenge FROM fetch_results")
def challenge_responses(spark, d):
    return read(spark, d, "fetch_results").select("fetch_id", ft.challenge_response(F.col("status"), F.col("html")).alias("challenge"))


@query(r"SELECT fetch_id, coalesce(regexp_matches(url, '(?i)^https?://[^/?#]') AND NOT regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)), '^(localhost|.*\.localhost|.*\.local|.*\.internal|127(\.\d{1,3}){3}|10(\.\d{1,3}){3}|192\.168(\.\d{1,3}){2})$'), false) OR coalesce(regexp_matches(url, '(?i)^file://(localhost)?/'), false) AS indexable FROM fetch_results")
def indexable_urls(spark, d):
    return read(spark, d, "fetch_results").select("fetch_id", fu.indexable(F.col("url")).alias("indexable"))


@query("SELECT content_id, coalesce(file_path = '/srv/notes' OR (starts_with(file_path, '/srv/notes/') AND NOT regexp_matches(file_path, '(^|/)\\.\\.(/|$)')), false) AS inside FROM contents")
def watch_root(spark, d):
    return read(spark, d, "contents").select("content_id", fu.within_root(F.col("file_path"), "/srv/notes").alias("inside"))


@query("SELECT content_id, CASE WHEN title IS NOT NULL THEN json_object('text', title || chr(10) || array_to_string(string_split(markdown, chr(10))[:20], chr(10))) END AS payload FROM contents WHERE markdown IS NOT NULL AND regexp_matches(markdown || title, '^[ -~\n]*$')")
def hook_payloads(spark, d):
    c = read(spark, d, "contents").where(F.col("markdown").isNotNull() & F.concat("markdown", "title").rlike(r"\A[ -~\n]*\z"))
    return c.select("content_id", catalogue.hook_payload(F.lit("https://hooks.slack.com/x"), "changed", F.col("title"), F.split("markdown", "\n")).alias("payload"))


@query(r"SELECT content_id, offset_ AS offset, trim(regexp_replace(line, '^#{1,3} +', '')) AS title FROM (SELECT content_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY content_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM (SELECT content_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM contents)) WHERE regexp_matches(line, '^#{1,3} ')")
def heading_offsets(spark, d):
    return rel.headings_of(read(spark, d, "contents"), "content_id", "markdown")


@query(r"WITH l AS (SELECT content_id, url, unnest(links).href AS href FROM contents WHERE url IS NOT NULL), x AS (SELECT *, regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$', ['s','h','p','t','q','f']) AS h, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?', ['s','h','p']) AS u FROM l) SELECT content_id, lower(h.s) || '://' || lower(h.h) || h.p || CASE WHEN h.t = '' THEN '/' WHEN length(h.t) > 1 AND h.t LIKE '%/' THEN h.t[:-2] ELSE h.t END || h.q AS href FROM x WHERE lower(h.s) IN ('http', 'https') AND h.h <> '' AND lower(h.s) = lower(u.s) AND regexp_replace(lower(h.h), '^www\.', '') = regexp_replace(lower(u.h), '^www\.', '') AND h.p = u.p AND starts_with(h.t, '/guide') AND NOT regexp_matches(lower(h.t), '\.(pdf|png|jpg|jpeg|gif|svg|webp|ico|css|js|zip|tar|gz|xml|rss|mp3|mp4|avi|mov|woff|woff2|ttf|eot)$')")
def link_filter(spark, d):
    links = read(spark, d, "contents").where(F.col("url").isNotNull()).select("content_id", "url", F.explode("links.href").alias("href"))
    return rel.qualify_links(links, F.col("url"), [], [], prefix="/guide").select("content_id", "href")


@query(r"SELECT doc_id, translate(text, chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(173) || chr(8206) || chr(8207) || chr(8234) || chr(8236) || chr(6158) || chr(8289), '') AS text FROM documents")
def invisible_characters(spark, d):
    return read(spark, d, "documents").select("doc_id", ft.strip_invisible(F.col("text")).alias("text"))


@query("SELECT content_id, (word_count - lag_words)::BIGINT AS delta FROM (SELECT content_id, coalesce(word_count, 0) AS word_count, lag(coalesce(word_count, 0)) OVER (PARTITION BY url ORDER BY fetched_at, content_id) AS lag_words FROM contents WHERE url IS NOT NULL) WHERE lag_words IS NOT NULL")
def word_count_delta(spark, d):
    w = rel.Window.partitionBy("url").orderBy("fetched_at", "content_id")
    words = F.coalesce("word_count", F.lit(0))
    c = read(spark, d, "contents").where(F.col("url").isNotNull()).select("content_id", words.alias("n"), F.lag(words).over(w).alias("o"))
    return c.where(F.col("o").isNotNull()).select("content_id", (F.col("n") - F.col("o")).cast("long").alias("delta"))


@query(r"SELECT fetch_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM fetch_results WHERE regexp_matches(html, '(?is)^<!doctype html><html[^>]*><head>.*<title>[^<&]+</title>') AND NOT contains(html, 'og:title') AND NOT contains(html, 'twitter:title')")
def page_titles(spark, d):
    from ..operators import extract

    some = read(spark, d, "fetch_results").where(F.col("html").rlike(r"(?is)\A<!doctype html><html[^>]*><head>.*<title>[^<&]+</title>") & ~F.contains("html", F.lit("og:title")) & ~F.contains("html", F.lit("twitter:title")))
    return extract.extract_pages(some).select("fetch_id", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"))


@query(f"SELECT fetch_id, CASE WHEN coalesce({_TYPE}, 'generic') <> 'generic' THEN {_TYPE} WHEN contains(lower(html), '<article') OR contains(lower(html), 'schema.org/article') THEN 'article' WHEN contains(lower(html), 'docsearch') OR contains(lower(html), 'sidebar-nav') OR contains(lower(html), 'doc-content') THEN 'documentation' ELSE 'generic' END AS page_type FROM fetch_results")
def page_types(spark, d):
    return read(spark, d, "fetch_results").select("fetch_id", fu.page_type(F.col("url"), F.col("html")).alias("page_type"))


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at, content_id) AS f, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, content_id DESC) AS l FROM contents WHERE url IS NOT NULL), o AS (SELECT * FROM v WHERE f = 1 AND l > 1), n AS (SELECT * FROM v WHERE l = 1)
SELECT n.url, concat_ws(',', CASE WHEN o.title IS DISTINCT FROM n.title THEN 'title' END, CASE WHEN o.author IS DISTINCT FROM n.author THEN 'author' END, CASE WHEN o.published_date IS DISTINCT FROM n.published_date THEN 'published_date' END, CASE WHEN o.language IS DISTINCT FROM n.language THEN 'language' END, CASE WHEN o.site_name IS DISTINCT FROM n.site_name THEN 'site_name' END,
CASE WHEN o.source_type IS DISTINCT FROM n.source_type THEN 'source_type' END, CASE WHEN o.content_hash IS DISTINCT FROM n.content_hash THEN 'content_hash' END, CASE WHEN o.file_path IS DISTINCT FROM n.file_path THEN 'file_path' END, CASE WHEN o.technologies IS DISTINCT FROM n.technologies THEN 'technologies' END) AS fields,
o.markdown IS DISTINCT FROM n.markdown AND coalesce(o.markdown, '') <> coalesce(n.markdown, '') AS text_differs, (coalesce(n.word_count, 0) - coalesce(o.word_count, 0))::BIGINT AS word_count_delta FROM o JOIN n ON o.url = n.url""")
def content_diffs(spark, d):
    v = rel.versions_of(read(spark, d, "contents"), "url", ["fetched_at", "content_id"])
    out = dif.content_diff(v.where("version = 1 and versions > 1"), v.where("version = versions and versions > 1"), "url")
    return out.select("url", F.array_join(F.transform("metadata_changes", lambda c: c["field"]), ",").alias("fields"), F.col("text_diff").isNotNull().alias("text_differs"), "word_count_delta")


@query("SELECT content_id, CASE WHEN url IS NULL AND title IS NULL THEN '' ELSE '' END || '---' || chr(10) || CASE WHEN title IS NULL THEN '' ELSE 'title: \"' || replace(title, '\"', '\\\"') || '\"' || chr(10) END || CASE WHEN url IS NULL THEN '' ELSE 'url: \"' || replace(url, '\"', '\\\"') || '\"' || chr(10) END || '---' || chr(10) || chr(10) || coalesce(markdown, '') AS text FROM contents")
def markdown_with_front_matter(spark, d):
    c = F.col
    return read(spark, d, "contents").select("content_id", ft.projection("markdown", c("title"), c("url"), c("markdown"), c("plain_text")).alias("text"))


# -- sites: each extractor's round trip over payloads made of the documents -----

_PAYLOAD = "SELECT content_id, title, word_count AS n, CASE WHEN word_count IS NULL THEN NULL ELSE word_count > 200 END AS flag FROM contents"


def _site(name: str) -> None:
    kinds = {field: kind for field, (_, kind) in verticals.VERTICALS[name][1].items() if kind != "variant"}
    source = {"string": "title", "long": "n", "boolean": "flag"}

    def run(spark, d) -> DataFrame:
        c = read(spark, d, "contents").select("content_id", F.col("url"), "title", F.col("word_count").alias("n"), (F.col("word_count") > 200).alias("flag"))
        made = c.withColumn("payload", verticals.payload_of(name, F.col("title"), F.col("n"), F.col("flag")))
        return verticals.extract_vertical(made, name).select("content_id", *[F.col(f"{name}.{field}").alias(field) for field in kinds])

    QUERIES[f"site_{name}"] = run
    SQL[f"site_{name}"] = f"WITH c AS ({_PAYLOAD}) SELECT content_id, " + ", ".join(f"{source[kind]} AS {field}" for field, kind in kinds.items()) + " FROM c"


for _name in verticals.VERTICALS:
    if any(kind != "variant" for _, kind in verticals.VERTICALS[_name][1].values()):
        _site(_name)


def _page_site(name: str, page, wanted: dict[str, str], sql: str) -> None:
    def run(spark, d) -> DataFrame:
        c = read(spark, d, "contents").where(F.col("title").isNotNull() & ~F.col("title").rlike(r"[<&\\]") & ~F.col("title").rlike(r"^\s|\s$|\s{2,}") & (F.col("title") != "") & F.col("word_count").isNotNull()).select("content_id", "url", "title", "word_count")
        read_ = site_pages.read_pages(c.withColumn("html", page(F.col("title"), F.col("word_count"))), name, "content_id")
        return read_.select("content_id", *site_pages.fields(F.col("record"), **wanted))

    QUERIES[f"site_{name}"] = run
    SQL[f"site_{name}"] = f"SELECT content_id, {sql} FROM contents WHERE title IS NOT NULL AND NOT regexp_matches(title, '[<&\\\\]') AND NOT regexp_matches(title, '^\\s|\\s$|\\s{{2,}}') AND title <> '' AND word_count IS NOT NULL"


def _ld(value) -> object:
    return F.concat(F.lit('<html><head><script type="application/ld+json">'), F.to_json(value), F.lit("</script></head></html>"))


_item = lambda kind, t, n: F.struct(F.lit(kind).alias("@type"), t.alias("name"), n.cast("string").alias("sku"), F.struct(n.alias("ratingValue"), n.alias("reviewCount")).alias("aggregateRating"), F.array(F.struct(n.alias("price"), F.lit("EUR").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"))).alias("offers"))
for _name in ("ecommerce_product", "woocommerce_product", "amazon_product", "ebay_listing", "etsy_listing"):
    _page_site(
        _name,
        lambda t, n: _ld(F.struct(F.array(_item("Product", t, n)).alias("@graph"))),
        {"title": "string", "sku": "string", "price": "string", "currency": "string", "availability": "string", "rating": "string"},
        "title, word_count::VARCHAR AS sku, word_count::VARCHAR AS price, 'EUR' AS currency, 'InStock' AS availability, word_count::VARCHAR AS rating",
    )
_page_site(
    "trustpilot_reviews",
    lambda t, n: _ld(F.struct(F.lit("Organization").alias("@type"), t.alias("name"), F.struct(n.alias("ratingValue"), n.alias("reviewCount")).alias("aggregateRating"))),
    {"business": "string", "review_count": "long"},
    "title AS business, word_count AS review_count",
)
_page_site(
    "substack_post",
    lambda t, n: F.concat(F.lit("<html><head><title>"), t, F.lit('</title><meta name="author" content="A"></head><body><article><p>'), n.cast("string"), F.lit("</p></article></body></html>")),
    {"title": "string", "author": "string", "body": "string"},
    "title, 'A' AS author, word_count::VARCHAR AS body",
)
_page_site(
    "linkedin_post",
    lambda t, n: F.concat(F.lit('<meta property="og:site_name" content="LinkedIn"><title>Post | '), t, F.lit('</title><p class="attributed-text-segment-list__content">'), n.cast("string"), F.lit("</p>")),
    {"author_name": "string", "body": "string", "site_name": "string"},
    "regexp_extract('Post | ' || title, '\\| ?([^|]*)$', 1) AS author_name, word_count::VARCHAR AS body, 'LinkedIn' AS site_name",
)
_page_site(
    "instagram_post",
    lambda t, n: F.concat(F.lit('<div class="Caption"><a class="CaptionUsername" href="#">me</a> '), t, F.lit("</div>")),
    {"author_username": "string", "caption": "string"},
    "'me' AS author_username, title AS caption",
)
_page_site(
    "youtube_page",
    lambda t, n: F.concat(F.lit("<script>var ytInitialPlayerResponse = "), F.to_json(F.struct(F.struct(t.alias("title"), n.cast("string").alias("viewCount"), F.lit("65").alias("lengthSeconds")).alias("videoDetails"))), F.lit(";</script>")),
    {"title": "string", "view_count": "long", "duration": "string"},
    "title, word_count AS view_count, '1:05' AS duration",
)
_page_site(
    "arxiv",
    lambda t, n: F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), t, F.lit("</title><author><name>A B</name></author><published>"), n.cast("string"), F.lit("</published></entry></feed>")),
    {"title": "string", "published": "string"},
    "title, word_count::VARCHAR AS published",
)


@query("WITH RECURSIVE t AS (SELECT content_id, len(links) AS n FROM contents) SELECT content_id, n::BIGINT AS comments FROM t WHERE n IS NOT NULL")
def site_hackernews_tree(spark, d):
    c = read(spark, d, "contents").where(F.col("links").isNotNull())
    child = F.transform("links", lambda x: F.struct(F.lit("comment").alias("type"), F.concat(F.lit('"parent_id": 1 '), F.coalesce(x["text"], F.lit(""))).alias("text")))
    tree = F.to_json(F.struct(F.lit(1).alias("id"), child.alias("children")))
    return site_pages.read_pages(c.withColumn("html", tree), "hackernews_tree", "content_id").select("content_id", *site_pages.fields(F.col("record"), comment_count="long")).withColumnRenamed("comment_count", "comments")


@query()
def brand_identity(spark, d):
    return brand.identity(read(spark, d, "fetch_results"), "fetch_id", "url", "html")


@query()
def brand_fonts(spark, d):
    return brand.fonts(brand.all_declarations(read(spark, d, "fetch_results"), "fetch_id", "html"), "fetch_id")


@query(
    r"""WITH c AS (SELECT url, row_number() OVER (ORDER BY url) AS n FROM (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]+', 0) AS url FROM contents WHERE url LIKE 'http%')) SELECT url AS site, url || '/page' AS url, url || '/inner.xml' AS sitemap FROM c"""
)
def sitemap_discovery(spark, d):
    sites = read(spark, d, "contents").where(F.col("url").like("http%")).select(F.regexp_extract("url", r"^https?://[^/?#]+", 0).alias("site")).distinct()
    files = {
        "/robots.txt": F.concat(F.lit("User-agent: *\nSITEMAP: "), "site", F.lit("/map.xml # here\n")),
        "/map.xml": F.concat(F.lit("<sitemapindex><sitemap><loc>"), "site", F.lit("/inner.xml</loc></sitemap><sitemap><loc>"), "site", F.lit("/map.xml</loc></sitemap></sitemapindex>")),
        "/inner.xml": F.concat(F.lit("<urlset><url><loc>"), "site", F.lit("/page</loc></url><url><loc>"), "site", F.lit("/page</loc></url></urlset>")),
    }
    rows = sites.select("site", F.explode(F.array(*[F.struct(F.concat("site", F.lit(k)).alias("url"), v.alias("body")) for k, v in files.items()])).alias("f"))
    return discover.discover(sites, rows.select("f.url", "f.body")).select("site", "url", "sitemap")


@query("WITH a AS (SELECT content_id, len(links) AS n, links FROM contents WHERE links IS NOT NULL AND len(links) > 0), r AS (SELECT content_id, unnest(links[:10]).href AS url, generate_subscripts(links[:10], 1) AS rank FROM a) SELECT content_id AS query, rank::INT AS rank, url FROM r")
def search_answers(spark, d):
    body = F.to_json(F.struct(F.transform("links", lambda x: F.struct(x["text"].alias("title"), x["href"].alias("url"))).alias("results")))
    answers = read(spark, d, "contents").where(F.size("links") > 0).select(F.col("content_id").alias("query"), F.lit(200).alias("status"), body.alias("body"))
    return discover.search_results(answers).select("query", "rank", "url")




# -- steps of readable text, one by one ------------------------------------------

def _step(name: str, step, sql: str) -> None:
    QUERIES[f"step_{name}"] = lambda spark, d: readable.steps(read(spark, d, "contents"), "content_id", "markdown", step)
    SQL[f"step_{name}"] = f"SELECT content_id, CASE WHEN markdown = '' THEN '' ELSE {sql} END AS text FROM contents"


_step("linked_images", readable.unwrap_linked_images, r"regexp_replace(markdown, '\[!\[([^\]]*)\]\([^)]*\)\]\(([^)]*)\)', '[\1](\2)' || chr(10), 'g')")
_step("image_names", readable.strip_image_names, r"regexp_replace(markdown, '(?mi)^\S+\.(?:png|jpe?g|gif|svg|webp|avif|ico)[ \t]*\n?', '', 'g')")
_step("blank_lines", readable.collapse_blank_lines, r"regexp_replace(regexp_replace(regexp_replace(markdown, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')")
_step("empty_headings", readable.strip_empty_headings, r"regexp_replace(markdown, '(?mi)^[ \t]*#{1,6}[ \t]+(?:[^\p{L}\p{N}_\n]*|footer|header|navigation|sidebar|menu)[ \t]*(?:\n|\z)|^#{1,6}[ \t]*(?:\n|\z)', '', 'g')")
_step("controls", readable.strip_controls, r"array_to_string([x FOR x IN string_split(markdown, chr(10)) IF NOT (contains(lower(x), 'your browser does not support') OR (strlen(trim(x)) <= 120 AND regexp_matches(x, '^\s*(?:(?:navigate_before|navigate_next|chevron_left|chevron_right|arrow_back|arrow_forward|arrow_upward|arrow_downward|arrow_drop_down|arrow_drop_up|arrow_left|arrow_right|expand_more|expand_less|unfold_more|unfold_less|first_page|last_page|more_horiz|more_vert|open_in_new|open_in_full|close_fullscreen|fullscreen|fullscreen_exit|close|search|menu|share|←|→|↑|↓|▸|▾|◀|▶|⤓|⏵|›|‹|»|«)(?:\s+|$))+$')))], chr(10))")
