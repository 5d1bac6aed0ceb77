"""Operators around documents: listings, states, discovery, sites, events."""

import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as ft
from weftline.functions import urls as fu
from weftline.operators import brand, catalogue, chunk, crawl, extract, models, site_pages, store, vector, verticals
from weftline.sources import discover, fetch, parsers
from weftline.streaming import events


def test_store_keys(spark):
    rows = ["https://www.e.com/a?x=1", "https://e.com/" + "long/" * 80, "https://e.com/../b c/", None, "nothing"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in rows], "u string").select(fu.store_key(F.col("u"))).collect()]

    def digest(url):
        h = 0xCBF29CE484222325
        for b in url.encode():
            h = ((h ^ b) * 0x100000001B3) % (1 << 64)
        return f"{h:016x}"

    assert got[0] == f"e_com/a_{digest(rows[0])}" and got[1].endswith(digest(rows[1])) and len(got[1]) == 240
    assert got[2:] == ["e_com/b_c", None, None]
    back = spark.createDataFrame([("e_com/a_0123456789abcdef",), ("e_com/index",)], "k string").select(fu.store_url(F.col("k"))).collect()
    assert [r[0] for r in back] == ["https://e.com/a", "https://e.com/"]


def test_predicates(spark):
    df = spark.createDataFrame([("/srv/a/b",), ("/srv/ab",), ("/srv/a",), ("/srv/a/../x",), (None,)], "p string")
    assert [r[0] for r in df.select(fu.within_root(F.col("p"), "/srv/a/")).collect()] == [True, False, True, False, False]
    df = spark.createDataFrame([("https://e.com/",), ("http://127.0.0.1/",), ("file:///x",), ("file://far/x",), (None,)], "u string")
    assert [r[0] for r in df.select(fu.indexable(F.col("u"))).collect()] == [True, False, True, False, False]
    df = spark.createDataFrame([(503, "<title>Just a moment...</title>"), (200, "<title>Guide</title>"), (200, None)], "s int, b string")
    assert [r[0] for r in df.select(ft.challenge_response(F.col("s"), F.col("b"))).collect()] == [True, False, False]
    assert spark.createDataFrame([("What is  a Z-order?",)], "q string").select(ft.slug(F.col("q"))).first()[0] == "what-is-a-z-order"


def test_redirects(spark):
    moves = spark.createDataFrame([("https://a.com/1", "https://a.com/2"), ("https://a.com/2", "https://a.com/3"), ("https://l.com/", "https://l.com/"), ("https://b.com/", "http://10.0.0.1/")], "source string, target string")
    starts = spark.createDataFrame([("https://a.com/1",), ("https://l.com/",), ("https://b.com/",), ("http://localhost/",)], "url string")
    got = {r["url"]: (r["final"], r["hops"], r["valid"], r["reason"]) for r in catalogue.redirect_chains(starts, moves, most=3).collect()}
    assert got["https://a.com/1"] == ("https://a.com/3", 2, True, None) and got["https://l.com/"][2:] == (False, "too many hops")
    assert got["https://b.com/"] == ("http://10.0.0.1/", 1, False, "not public") and got["http://localhost/"][1:] == (0, False, "not public")


def test_store_buckets(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=4)
    schema = "url string, markdown string, fetched_at timestamp"
    day = datetime(2024, 1, 1)
    assert s.read() is None and s.read(["x"]) is None
    assert s.write(spark.createDataFrame([(f"https://e.com/{i}", f"t{i}", day) for i in range(12)], schema)) == 0
    assert s.write(spark.createDataFrame([("https://e.com/3", "new", day + timedelta(1)), ("https://e.com/big", "x" * (3 << 20), day)], schema)) == 1
    rows = {r["url"]: r for r in s.read().collect()}
    assert len(rows) == 12 and (rows["https://e.com/3"]["markdown"], rows["https://e.com/3"]["fetch_count"]) == ("new", 2)
    assert [r["markdown"] for r in s.read(["https://e.com/3"]).collect()] == ["new"]
    for k in range(3):
        s.write(spark.createDataFrame([("https://e.com/1", f"v{k}", day + timedelta(2 + k))], schema))
    assert len(s._versions()) == 2 and s.read().count() == 12
    with pytest.raises(Exception):
        s._publish({}, int(s._versions()[-1][:-5]))  # another writer was first


def test_crawl_takes_links_in_order_and_resumes(spark, tmp_path):
    links = spark.createDataFrame([("https://e.com/", "https://e.com/z", 0), ("https://e.com/", "https://e.com/a", 1), ("https://e.com/z", "https://e.com/m", 0), ("https://e.com/a", "https://e.com/n.pdf", 0)], "url string, href string, pos int")
    got = [r["url"] for r in crawl.crawl(spark, links, "https://e.com", max_depth=2, max_pages=2).orderBy("depth", "position").collect()]
    assert got == ["https://e.com/", "https://e.com/z"]
    folder = f"file://{tmp_path}/c"
    assert catalogue.load_crawl(spark, folder) is None
    crawl.crawl(spark, links, "https://e.com", max_depth=1, save=folder)
    state = catalogue.load_crawl(spark, folder)
    assert {r["url"] for r in crawl.crawl(spark, links, "https://e.com", max_depth=2, resume=state).collect()} == {"https://e.com/", "https://e.com/z", "https://e.com/a", "https://e.com/m"}


def test_totals_and_states(spark, tmp_path):
    jobs = spark.createDataFrame([(10, None), (5, None), (100, "bad")], "n long, error string")
    r = catalogue.session_counters(jobs, "n").first()
    assert (r["jobs"], r["failed"], r["total_n"], r["avg_n"]) == (3, 1, 15, 7) and catalogue.session_counters(jobs.limit(0), "n").first()["avg_n"] == 0
    assert catalogue.dead_letters(jobs, str(tmp_path / "dead")) == 1 and spark.read.json(str(tmp_path / "dead")).count() == 1
    a = spark.createDataFrame([("x", "1", 1, "d1"), ("y", "1", 1, "d2"), ("w", "1", 1, None)], "path string, length string, modified long, digest string")
    b = spark.createDataFrame([("x", "2", 1, "d3"), ("z", "1", 1, "d2"), ("v", "1", 1, None)], "path string, length string, modified long, digest string")
    changes = events.file_changes(a, b)
    assert {(r["path"], r["change"], r["old_path"]) for r in changes.collect()} == {("x", "modified", None), ("z", "renamed", "y"), ("w", "removed", None), ("v", "created", None)}
    assert {(r["path"], r["job"]) for r in events.index_jobs(changes).collect()} == {("x", "index"), ("y", "delete"), ("z", "index"), ("w", "delete"), ("v", "index")}


def test_git_branch(tmp_path):
    (tmp_path / "r/.git").mkdir(parents=True)
    (tmp_path / "r/.git/HEAD").write_text("ref: refs/heads/topic/x\n")
    (tmp_path / "r/sub").mkdir()
    assert catalogue.git_branch(str(tmp_path / "r/sub")) == "topic/x"
    (tmp_path / "r/.git/HEAD").write_text("0123abcd\n")
    assert catalogue.git_branch(str(tmp_path / "r")) is None
    (tmp_path / "w").mkdir()
    (tmp_path / "w/.git").write_text(f"gitdir: {tmp_path}/r/.git\n")
    assert catalogue.git_branch(str(tmp_path / "w")) is None


def test_discovery(spark):
    site = "https://e.com"
    bodies = {"/robots.txt": f"Sitemap: {site}/a.xml", "/a.xml": f"<sitemapindex><sitemap><loc>{site}/b.xml</loc></sitemap><sitemap><loc>{site}/a.xml</loc></sitemap></sitemapindex>", "/b.xml": f"<urlset><url><loc>{site}/1</loc></url><url><loc>{site}/2</loc>", "/sitemap.xml": f"<urlset><url><loc>{site}/2</loc></url></urlset>"}
    df = spark.createDataFrame([(site + k, v) for k, v in bodies.items()], "url string, body string")
    got = {(r["url"], r["sitemap"]) for r in discover.discover(spark.createDataFrame([(site,)], "site string"), df).collect()}
    assert got == {(f"{site}/1", f"{site}/b.xml"), (f"{site}/2", f"{site}/sitemap.xml")}
    answers = spark.createDataFrame([("q", 200, '{"results":[{"title":"T","url":"u"}]}'), ("r", 403, ""), ("s", 200, "<html>")], "query string, status int, body string")
    assert {(r["query"], r["url"], r["error"]) for r in discover.search_results(answers).collect()} == {("q", "u", None), ("r", None, "the service refuses JSON"), ("s", None, "not JSON")}


def test_paged_services(spark):
    data = [{"id": i} for i in range(5)]
    offset = discover.by_offset(lambda o, n: {"results": data[o : o + n], "next": o + n < 5}, size=2)
    assert list(discover.all_pages(offset)) == data
    assert list(discover.all_pages(discover.by_token(lambda t: {"memos": data[:1], "nextPageToken": "same"}, "memos"))) == data[:1]  # a token that repeats ends it

    def broken(page):
        raise OSError("down")

    got = discover.synced(spark, {"good": discover.by_number(lambda p: {"results": data, "next": None}), "bad": discover.by_number(broken)}).collect()
    assert sorted((r["service"], r["error"]) for r in got) == [("bad", "down")] + [("good", None)] * 5
    memo = discover.memos(spark.createDataFrame([('{"name":"m/1","content":"# Head\\nbody","tags":["t"]}',)], "payload string")).first()
    assert (memo["title"], memo["external_id"], memo["technologies"]) == ("Head", "m/1", ["t"])


def test_site_records():
    read = site_pages.site_record
    graph = {"@graph": [{"@type": "WebSite"}, {"@type": ["Product"], "name": "Cup", "brand": "B", "offers": {"price": 3, "availability": "https://schema.org/InStock"}}]}
    got = read("ecommerce_product", "https://e.com/p", f'<script type="application/ld+json">{json.dumps(graph)}</script><script type="application/ld+json">broken</script>')
    assert (got["title"], got["brand"], got["price"], got["availability"]) == ("Cup", "B", "3", "InStock")
    assert read("amazon_product", "u", '<meta property="og:title" content="A &amp; B">')["title"] == "A & B"
    tree = {"id": 7, "children": [{"type": "comment", "text": 'says "parent_id": 1', "children": [{"type": "comment"}, {"type": "poll"}]}, {"type": "story"}]}
    hn = read("hackernews_tree", "u", json.dumps(tree))
    assert hn["comment_count"] == 2 and hn["comments"][0]["replies"][0]["replies"] == []
    reply = {"kind": "t1", "data": {"body": "b", "replies": ""}}
    rd = read("reddit_tree", "u", json.dumps([{"data": {"children": [{"data": {"title": "T"}}]}}, {"data": {"children": [{"kind": "t1", "data": {"body": "a", "replies": {"data": {"children": [reply, {"kind": "more"}]}}}}]}}]))
    assert (rd["title"], rd["comment_count"]) == ("T", 2)
    assert read("reddit_tree", "u", "not json") is None and read("arxiv", "u", None) is None and read("arxiv", "u", "<feed") is None
    player = {"videoDetails": {"title": "V", "viewCount": "1234567", "lengthSeconds": "3725"}}
    yt = read("youtube_page", "https://youtu.be/x", f"<script>var ytInitialPlayerResponse = {json.dumps(player)};var x</script>")
    assert yt["duration"] == "1:02:05" and "1.2M" in yt["markdown"]
    assert site_pages.paper_id("https://arxiv.org/pdf/math/0211159v1.pdf") == "math/0211159"
    people = [{"entityUrn": "p1", "firstName": "Ann", "lastName": "B"}, {"$type": "x.Comment", "commenter": {"commenterProfileId": "p1"}, "commentV2": {"text": "fine"}}, {"commentary": {"text": {"text": "post"}}}]
    page = f"<code><!--{json.dumps({'included': people + [{'pad': 'x' * 1200}]})}--></code><code>{json.dumps({'included': []})}</code>"
    li = read("linkedin_page", "u", page)
    assert li["body"] == "post" and li["comments"] == [{"author": "Ann B", "text": "fine"}]


def test_vertical_fields(spark):
    pr = {"number": 4, "labels": [{"name": "bug"}], "user": {"login": "me"}, "head": {"ref": "x"}}
    npm = {"name": "p", "dist-tags": {"latest": "1.2"}, "versions": {"1.2": {"license": "MIT"}, "1.1": {}}, "time": {"1.2": "2024"}}
    df = spark.createDataFrame([("https://github.com/o/r/pull/4", json.dumps(pr), json.dumps(npm))], "url string, payload string, npm string")
    got = verticals.extract_vertical(df, "github_pr").first()["github_pr"]
    assert (got["owner"], got["repo"], got["labels"], got["head_ref"]) == ("o", "r", ["bug"], "x")
    got = verticals.extract_vertical(df, "npm", payload="npm").first()["npm"]
    assert (got["latest_version"], got["license"], got["release_count"], got["latest_release_date"]) == ("1.2", "MIT", 2, "2024")


def test_extraction_recovers_and_ends():
    page = "<body><main><section><div class='header'><p>Our promise</p><h2>Why</h2></div><p>" + "A text on why it is so, told at length. " * 3 + "</p></section></main><footer><h2>Begin</h2><a href='https://docs.e.com/'>Manual</a><a href='/about'>About</a></footer></body>"
    r = extract.extract(page, "https://e.com/")
    assert r["markdown"].startswith("*Our promise*\n\n## Why\n\nA text") and "## Begin\n\n[Manual](https://docs.e.com/)" in r["markdown"]
    assert ("About", "https://e.com/about") not in {(x["text"], x["href"]) for x in r["links"]} or "About" not in r["markdown"]
    assert json.loads(extract.started_data("<script>kit.start(a, b, {data: [null, {type: 'data', data: {n: 1, t: `x`, u: undefined}, }]})</script>")[0]) == {"n": 1, "t": "x", "u": None}
    assert extract.started_data("<script>kit.start(a, {data: [f(x)()]})</script>") == []
    with pytest.raises(TimeoutError), extract.deadline(0.05):
        while True:
            pass


def test_brand(spark):
    df = spark.createDataFrame([(1, "https://www.acme.com/", "<title>Home | Acme</title><link rel='icon' href='/f.ico'><div class='logo'><img src='/l.png'></div><b style='color: rgb(255, 0, 16)' class='bg-[#0af]'></b><link href='https://fonts.googleapis.com/css2?family=Open+Sans:wght@400'>")], "id long, url string, html string")
    r = brand.identity(df, "id", "url", "html").first()
    assert (r["name"], r["favicon"], r["logos"][0]["url"]) == ("Acme", "https://www.acme.com/f.ico", "https://www.acme.com/l.png")
    d = brand.all_declarations(df, "id", "html")
    assert {r["hex"] for r in brand.colours(d, "id").collect()} == {"#ff0010", "#00aaff"} and [r["font"] for r in brand.fonts(d, "id").collect()] == ["Open Sans"]
    assert [r[0] for r in spark.createDataFrame([("hsl(120, 100%, 25%)",), ("none",), (None,)], "v string").select(brand.hex_of(F.col("v"))).collect()] == ["#008000", None, None]


def test_embedding_batches():
    seen = []

    def provider(batch):
        seen.append(len(batch))
        if len(batch) > 3:
            raise vector.TooLarge
        if len(seen) == 3:
            raise vector.Busy
        return [[float(len(t))] for t in batch]

    texts = ["x" * i for i in range(7)]
    assert vector.embed_batches(texts, provider, size=6, wait=0.0) == [[float(i)] for i in range(7)]
    with pytest.raises(ValueError):
        vector.embed_batches(["a"], lambda b: [])
    with pytest.raises(vector.TooLarge):
        vector.embed_batches(["a"], lambda b: (_ for _ in ()).throw(vector.TooLarge))


def test_prompted_extraction(spark):
    df = spark.createDataFrame([(1, "t"), (2, None)], "id long, t string")
    got = {r["id"]: (r["data"], r["error"]) for r in models.extract_with_prompt(df, "id", "t", "List it.", lambda asks: ['```json\n{"a": 1}\n```' if "Content:\nt" in a else "no" for a in asks]).collect()}
    assert json.loads(got[1][0]) == {"a": 1} and got[2][0] is None and got[2][1]


def test_sheet_cells_stand_where_they_belong(tmp_path):
    path = tmp_path / "x.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId2" Target="worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet9.xml", '<worksheet><sheetData><row><c r="A1"><v>a</v></c><c r="C1"><v>c</v></c></row><row><c r="B2"><v>b</v></c></row></sheetData></worksheet>')
    md = parsers.parse_file("x.xlsx", path.read_bytes())["markdown"]
    assert "## Sheet: One" in md and "| a |  | c |" in md and "|  | b |  |" in md


def test_debounced_stream(spark, tmp_path):
    folder, day = tmp_path / "in", datetime(2024, 1, 1)
    schema = "path string, at timestamp, kind string"
    rows = [("f", day, "create"), ("f", day + timedelta(milliseconds=100), "modify"), ("f", day + timedelta(seconds=5), "remove"), ("g", day, "create")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    q = events.debounced(stream).writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["path"], r["kind"]) for r in spark.sql("select * from quiet").collect()}
    assert ("f", "modify") in got and ("f", "create") not in got


def test_responses_are_read_by_their_route_and_stored(spark, tmp_path):
    pdf = b"%PDF-1.4\n1 0 obj << /Type /Page >> stream\nBT (Hello) Tj 0 -12 Td (World) Tj ET\nendstream"
    bodies = {"https://e.com/p": b"<title>T</title><main><h1>Head</h1><p>Some text of the page that is read.</p></main>", "https://e.com/f.pdf": pdf, "https://api.e.com/x.json": b'{"a": 1}'}

    def transport(url):
        return (200, bodies[url]) if url in bodies else (404, None)

    s = store.Store(spark, f"file://{tmp_path}/s", buckets=2)
    got = {r["url"]: r for r in fetch.ingest(spark.createDataFrame([(u,) for u in [*bodies, "https://e.com/gone"]], "url string"), transport, s).collect()}
    assert "# Head" in got["https://e.com/p"]["markdown"] and got["https://e.com/f.pdf"]["markdown"] == "Hello\nWorld" and got["https://api.e.com/x.json"]["record"] == '{"a": 1}'
    assert got["https://e.com/gone"]["error"] == "status 404" and {r["url"] for r in s.read().collect()} == {"https://e.com/p", "https://e.com/f.pdf"}
    routes = spark.createDataFrame([("https://github.com/a/b", "application/json"), ("https://www.etsy.com/listing/1", "text/html"), ("https://e.com/", None)], "u string, t string").select(fetch.route(F.col("u"), F.col("t"))).collect()
    assert [r[0] for r in routes] == ["vertical:github_repo", "page:etsy_listing", "html"]


def test_pdf_maps_to_unicode():
    cmap = b"stream\n1 beginbfchar <0003> <0041> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange\nendstream"
    body = b"stream\nBT [<00030010> -300 <0011>] TJ T* (\\101\\)) Tj ET\nendstream"
    assert parsers.parse_file("x.pdf", b"%PDF-1.5 " + body)["plain_text"].endswith("A)")
    assert parsers.parse_file("x.pdf", b"%PDF-1.5 " + cmap + body)["plain_text"].startswith("Aa b")


def test_chunks_by_tokens():
    text = "\n\n".join(" ".join(["supercalifragilistic"] * 30) for _ in range(6)) + "\n\n" + "x" * 50
    size = lambda t: len(t) // 4
    made = chunk.chunks(text, target=100, overlap=0, least=1, size=size)
    assert all(size(b) <= 110 for _, b, _ in made) and sum(len(b.split()) for _, b, _ in made) >= 181


def test_page_types_and_formats(spark):
    df = spark.createDataFrame([("https://e.com/", "<ARTICLE>"), ("https://e.com/", "<div id=docsearch>"), ("https://github.com/", "<article>"), (None, None)], "u string, h string")
    assert [r[0] for r in df.select(fu.page_type(F.col("u"), F.col("h"))).collect()] == ["article", "documentation", "git_hub", "generic"]
    row = spark.createDataFrame([("T", "u", "# m", "m", '{"a":1}')], "t string, u string, m string, p string, d string")
    c = F.col
    got = row.select(ft.projection("markdown", c("t"), c("u"), c("m"), c("p"), data=c("d")), ft.projection("llm", c("t"), c("u"), c("m"), c("p")), ft.projection("json", c("t"), c("u"), c("m"), c("p"))).first()
    assert got[0].endswith('```json\n{"a":1}\n```') and got[1].startswith("> URL: u\n> Title: T") and json.loads(got[2])["markdown"] == "# m"
    with pytest.raises(ValueError):
        ft.projection("odd", c("t"), c("u"), c("m"), c("p"))
