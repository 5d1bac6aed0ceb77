import json
import zipfile
import io
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions import dom, text as ft, urls as fu
from weftline.operators import brand, chunk, crawl, extract, readable, relational as rel, store, vector as vec, verticals
from weftline.sources import parsers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("url", "form"),
    [("HTTP://Example.com/a/#x", "http://example.com/a"), ("https://e.com", "https://e.com/"), ("https://e.com/a/?q=1#t", "https://e.com/a?q=1"), ("not a url", "not a url"), (None, None)],
)
def test_crawl_form(spark, url, form):
    assert one(spark, fu.crawl_form, url) == form


def test_url_functions(spark):
    assert one(spark, fu.domain_type, "https://netflix.com/") == "social"  # substrings match anywhere
    assert one(spark, fu.domain_type, "https://GitHub.com/docs/") == "git_hub"
    assert one(spark, fu.domain_type, None) is None
    assert one(spark, fu.index_form, "https://e.com/a///#b") == "https://e.com/a"
    assert one(spark, fu.input_form, " e.com ") == "https://e.com"
    assert [one(spark, fu.is_public, u) for u in ("http://10.0.0.1/", "http://e.com/", "ftp://e.com/", "http://[::1]/", None)] == [False, True, False, False, False]
    assert one(spark, fu.store_key, "https://www.e.com/a b/") == "e_com/a_b"
    assert one(spark, fu.store_key, "https://e.com") == "e_com/index"
    glob = lambda p, path: one(spark, lambda c: fu.glob_match(c, [p]), path)
    assert (glob("/shelf/*/page", "/shelf/a/page"), glob("/shelf/*/page", "/shelf/a/b/page"), glob("/shelf/**/page", "/shelf/a/b/page"), glob("/vol-?", "/vol-7"), glob("/vol-?", "/vol-77")) == (True, False, True, True, False)
    with pytest.raises(ValueError):
        fu.glob_regex("*" * 65)


def test_text_functions(spark):
    assert one(spark, ft.word_count, " a  b\nc ") == 3 and one(spark, ft.word_count, None) == 0
    assert one(spark, ft.strip_thinking, "<think>x</think>y<think>z") == "y"
    assert json.loads(one(spark, ft.json_answer, 'sure\n```json\n{"a": 1}\n```')) == {"a": 1}
    assert one(spark, ft.json_answer, "no json") is None
    assert one(spark, ft.sitemaps_of_robots, "SITEMAP: https://e.com/s.xml # x\nsitemap: /no\nAllow: /") == ["https://e.com/s.xml"]
    assert one(spark, ft.strip_ansi, "\x1b[31mred\x1b[0m") == "red"
    assert one(spark, ft.bot_protected, "<script>window._cf_chl_opt={}</script>") and not one(spark, ft.bot_protected, None)


def test_relational(spark):
    old = spark.createDataFrame([("u", "a", 1), ("gone", "x", 1)], "url string, title string, word_count long")
    new = spark.createDataFrame([("u", None, 3), ("new", "y", 1)], "url string, title string, word_count long")
    got = {r["url"]: (r["status"], r["word_count_delta"], r["changed"]) for r in rel.snapshot_status(old, new, "url", ["title"]).collect()}
    assert got == {"u": ("Changed", 2, "title"), "gone": ("Removed", -1, ""), "new": ("New", 1, "")}
    d = spark.createDataFrame([(1, "Foo\nbar"), (2, None), (3, "")], "id long, t string")
    assert [tuple(r) for r in rel.grep(d, "id", "t", "foo").collect()] == [(1, 1, "Foo")]
    assert rel.grep(d, "id", "t", "FOO").count() == 0
    assert rel.grep(d.limit(0), "id", "t", "x").count() == 0
    blocks = spark.createDataFrame([(1, "a block of enough bytes\n\nshort\n\na block of enough bytes\n\nshort")], "id long, t string")
    assert rel.dedup_blocks(blocks, "id", "t").first()["t"] == "a block of enough bytes\n\nshort\n\nshort"
    docs = spark.createDataFrame([("https://e.com/auth", "OAuth guide"), ("https://e.com/trust", "Trust")], "url string, title string")
    assert [r["score"] for r in rel.top_scored(docs, "the oauth guide", 5).collect()] == [2]
    assert rel.top_scored(docs, "the of", 5).count() == 0
    h = spark.createDataFrame([("p", "# One\ntext\n## Two\nmore")], "k string, t string")
    c = spark.createDataFrame([("p", 0), ("p", 7), ("p", 11)], "k string, char_offset long")
    assert [r["heading"] for r in rel.heading_as_of(c, rel.headings_of(h, "k", "t"), "k").orderBy("char_offset").collect()] == ["One", "One", "Two"]
    hist = spark.createDataFrame([("k", i) for i in range(10)], "k string, i long")
    assert sorted(r["i"] for r in rel.cap_history(hist, "k", ["i"], 3).collect()) == [0, 8, 9]


def test_upsert_and_stale(spark):
    cur = spark.createDataFrame([("a", "u", 1), ("b", "u", 1), ("c", "w", 1)], "id string, url string, v long")
    batch = spark.createDataFrame([("a", "u", 2), ("a", "u", 3)], "id string, url string, v long")
    merged = rel.upsert(cur, batch, "id", "v")
    assert {(r["id"], r["v"]) for r in merged.collect()} == {("a", 3), ("b", 1), ("c", 1)}
    assert {r["id"] for r in rel.without_stale(merged, batch.select("url", "id").distinct(), "url", "id").collect()} == {"a", "c"}


def test_vectors(spark):
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r["vec_id"], r["rank"]) for r in vec.knn(pts, q, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]  # ties by key
    assert vec.knn(pts, q.limit(0), 2).count() == 0 and vec.knn(pts.limit(0), q, 2).count() == 0
    ids = spark.createDataFrame([("u", 0), (None, 0)], "u string, i long").select(vec.point_id("u", "i")).collect()
    assert ids[0][0] == spark.createDataFrame([("u", 0)], "u string, i long").select(vec.point_id("u", "i")).first()[0] and ids[1][0] is None


def test_dom_and_extraction():
    md = extract.extract("<p><b>one<br><p>two")["markdown"]
    assert md.count("**") == 4  # unclosed formatting goes on in the next paragraph
    page = extract.extract('<html lang=en><head><title>T</title><meta property="og:title" content="OG"></head><body><nav><a href="/n">n</a></nav><main><h1>Head</h1><p>Some text with <a href="/x">a link</a>.</p><pre><code class="language-rs">a &lt; b</code></pre><table><tr><th>A<th>B<tr><td>1<td>2</table></main></body></html>', "https://e.com/d/")
    assert page["title"] == "OG" and "# Head" in page["markdown"] and "[a link](https://e.com/x)" in page["markdown"]
    assert page["code_blocks"] == [{"language": "rust", "code": "a < b"}] and "| A | B |" in page["markdown"]
    assert extract.extract("")["error"] and extract.extract(None)["error"]
    root = dom.parse('<div class="a b"><p id=x>1</p><ul><li>2</ul></div>')
    assert len(dom.select(root, "div.a > p#x, ul li")) == 2
    assert extract.best_source("a.png 1x, b.png 2x, c.png 2x") == "b.png"
    assert extract.json_ld('<script type="application/ld+json">[{"a":1},{"b":2}]</script>') == ['{"a": 1}', '{"b": 2}']
    assert extract.extract("<div>" * 3000 + "deep" + "</div>" * 3000)["markdown"].endswith("deep")


def test_extract_pages_keeps_rows(spark):
    df = spark.createDataFrame([(1, "https://e.com/", "<p>hello world</p>"), (2, None, None), (3, "x", "")], "fetch_id long, url string, html string")
    got = {r["fetch_id"]: (r["plain_text"], r["error"]) for r in extract.extract_pages(df).collect()}
    assert got[1] == ("hello world", None) and got[2][1] and got[3][1]


def test_crawl(spark):
    links = spark.createDataFrame([("https://e.com/", "https://e.com/a"), ("https://e.com/", "https://e.com/b.png"), ("https://e.com/", "https://o.com/"), ("https://e.com/a", "https://e.com/"), ("https://e.com/a", "https://e.com/c")], "url string, href string")
    got = {r["url"]: (r["depth"], r["found"]) for r in crawl.crawl(spark, links, "https://e.com", max_depth=2).collect()}
    assert got == {"https://e.com/": (0, True), "https://e.com/a": (1, True), "https://e.com/c": (2, False)}
    assert crawl.crawl(spark, links, "https://e.com", max_depth=2, max_pages=2).count() == 2


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    row = lambda text, day: spark.createDataFrame([("u", text, datetime(2025, 1, day))], "url string, markdown string, fetched_at timestamp")
    assert s.read() is None
    for text, day in (("a", 1), ("a", 2), ("b", 3)):
        s.write(row(text, day))
    got = s.read().first()
    assert got["fetch_count"] == 3 and [e["status"] for e in got["changelog"]] == ["New", "Changed"] and got["first_seen"] == datetime(2025, 1, 1)


def test_chunks():
    text = "# Title\n\n" + "\n\n".join("word " * 60 for _ in range(10))
    made = chunk.chunks(text, target=120, overlap=0, least=10)
    assert len(made) > 3 and all(len(b.split()) <= 125 for _, b, _ in made) and made[0][2] == "Title"
    assert all(text[o:].lstrip().startswith(b[:20]) for o, b, _ in made)
    assert chunk.chunks("") == [] and chunk.chunks("too short") == []


def test_parsers():
    p = lambda name, data: parsers.parse_file(name, data)
    assert p("a.md", b"# x")["plain_text"] == "" and p("a.txt", b"x")["plain_text"] == "x"
    assert p("a.xyz", b"")["error"] and p("noext", b"{}")["error"]
    assert p("a.jsonl", b'{"text":"a"}\nbad\n{"body":"b"}')["markdown"] == "a\nb"
    assert p("a.csv", b'a,"b,c"\n,\n1,2')["markdown"].split("\n")[0] == "| a | b,c |"
    srt = p("a.srt", b"1\n00:00:01,000 --> 00:00:02,500\nHi <i>there</i>\n")
    assert srt["markdown"] == "Hi there" and srt["provenance"]["end_seconds"] == "2.5"
    mail = p("a.eml", b"Subject: S\nFrom: a@e.com\nReferences: <r1> <r2>\nContent-Type: text/plain\n\nbody")
    assert mail["title"] == "S" and mail["provenance"]["thread_id"] == "<r1>" and mail["markdown"] == "body"
    assert p("a.rss", b"<rss><channel><item><title>T</title><description>d</description></item></channel></rss>")["title"] == "T"
    nb = p("a.ipynb", json.dumps({"cells": [{"cell_type": "markdown", "source": ["a", "b"]}, {"cell_type": "code", "source": "x=1"}]}).encode())
    assert nb["markdown"] == "ab\n\n```\nx=1\n```" and nb["source_type"] == "notebook"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:document>')
    assert p("a.docx", buf.getvalue())["markdown"] == "# Head\n\nBody"
    assert p("a.pdf", b"%PDF-1.4\nstream\nBT (Hello) Tj ET\nendstream")["markdown"] == "Hello" and p("b.pdf", b"no")["error"]
    assert parsers.sitemap_entries("<urlset><url><loc>https://a/</loc><priority>0.5</priority></url><url><loc>b")[1] == [("https://a/", None, 0.5, None)]


def test_verticals(spark):
    df = spark.createDataFrame([("https://github.com/a/b", '{"full_name":"a/b","stargazers_count":5,"license":{"spdx_id":"MIT"}}'), ("https://github.com/a/b/pull/3", "broken")], "url string, payload string")
    assert [r[0] for r in df.select(verticals.vertical_of(F.col("url"))).collect()] == ["github_repo", "github_pr"]
    got = [r["github_repo"] for r in verticals.extract_vertical(df, "github_repo").collect()]
    assert (got[0]["stars"], got[0]["license"]) == (5, "MIT") and got[1]["stars"] is None
    rel_ = spark.createDataFrame([('{"assets":[{"name":"x","download_count":3},{"name":"y","download_count":4}]}',), ("{}",)], "p string").select(verticals.release_assets(F.col("p"))).collect()
    assert [(r[0]["assets"], r[0]["downloads"]) for r in rel_] == [(2, 7), (0, 0)]
    papers = verticals.papers(spark.createDataFrame([(1, "t", "c", [2, 9, 1], 5)], "id long, title string, content string, tags array<long>, correspondent long"), spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string"), spark.createDataFrame([(6, "z")], "id long, name string")).first()
    assert papers["technologies"] == ["y", "x"] and papers["author"] is None


def test_brand(spark):
    df = spark.createDataFrame([(1, '<style>.a{color:#F00;background:#00ff00}.b{color:#ff0000;font-family:"My Font",serif}</style>')], "id long, html string")
    d = brand.declarations(df, "id", "html")
    assert [(r["hex"], r["count"], r["usage"]) for r in brand.colours(d, "id").orderBy("rank").collect()] == [("#ff0000", 2, "text"), ("#00ff00", 1, "background")]
    assert [r["font"] for r in brand.fonts(d, "id").collect()] == ["My Font"]


def test_readable():
    text, links = readable.readable("# T\n\n![a](x.png)\n\n**bold** [go](https://e.com) [go2](https://e.com)\n\n## Empty\n")
    assert text == "# T\n\nbold go go2" and links == [("go", "https://e.com")]
    assert readable.readable(None) == (None, []) and readable.readable("")[0] == ""


def test_watch_stream(spark, tmp_path):
    from weftline.streaming.watch import watch_pages

    folder = str(tmp_path / "in")
    rows = [("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("w", 1, None), ("w", 2, "x")]
    spark.createDataFrame([(u, datetime(2025, 1, d), t) for u, d, t in rows], "url string, fetched_at timestamp, markdown string").write.parquet(folder)
    stream = spark.readStream.schema("url string, fetched_at timestamp, markdown string").parquet(folder)
    q = watch_pages(stream).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["url"], r["seen_at"].day): r["status"] for r in spark.sql("select * from watched").collect()}
    assert got == {("u", 1): "New", ("u", 2): "Same", ("u", 3): "Changed", ("w", 1): "Failed", ("w", 2): "New"}


def test_entry_without_llm():
    import __spark_entry__ as e

    assert "page_domain_type" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
