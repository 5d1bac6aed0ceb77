import random

from pyspark.sql import functions as F

from weftline.operators import diff, models
from weftline.sources import fetch


def test_edits_are_shortest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        script = diff.edits(a, b)
        assert [s for op, s in script if op != "+"] == a and [s for op, s in script if op != "-"] == b
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert sum(op == " " for op, _ in script) == table[-1][-1]


def test_unified():
    assert diff.unified("a\nb\nc", "a\nx\nc") == "--- old\n+++ new\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c"
    assert diff.unified("a", "a") is None and diff.unified(None, "") is None


def test_content_diff(spark):
    schema = "url string, title string, markdown string, links array<struct<text:string,href:string>>, word_count long"
    old = spark.createDataFrame([("u", "t", "a", [("x", "/1")], 1), ("s", "t", "a", None, 1)], schema)
    new = spark.createDataFrame([("u", None, "b", [("y", "/2")], 2), ("s", "t", "a", None, 1)], schema)
    got = {r["url"]: r for r in diff.content_diff(old, new, "url", ["title"]).collect()}
    assert got["s"]["status"] == "Same" and got["u"]["status"] == "Changed"
    assert got["u"]["links_added"] == ["/2"] and got["u"]["links_removed"] == ["/1"] and got["u"]["metadata_changes"][0]["field"] == "title"


def test_models(spark):
    def provider(prompts):
        return ['{"n": 1}' if "wrong" in p else '<think>x</think>```json\n{"n": "no"}\n```' if "bad" in p else None if "none" in p else '{"n": 2}' for p in prompts]

    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id long, t string")
    got = {r["id"]: (r["data"], r["error"]) for r in models.extract_json(df, "id", "t", schema, provider).collect()}
    assert got == {1: ('{"n": 2}', None), 2: ('{"n": 1}', None), 3: ('{"n": 2}', None)}
    assert models.violation({"a": [1, "x"]}, {"properties": {"a": {"items": {"type": "integer"}}}}) == "$.a[1]: type"
    assert models.chain([lambda p: [None, "a"], lambda p: ["b"] * len(p)])(["1", "2"]) == ["b", "a"]
    assert models.summarize(df, "id", "t", lambda p: ["<think>a</think> s"] * len(p)).first()["summary"] == "s"


def test_fetch(spark):
    def transport(url):
        if url == "boom":
            raise OSError("down")
        return (503, None) if url == "busy" else (200, b"ok")

    df = spark.createDataFrame([(0, "a"), (1, "boom"), (2, "busy"), (3, None)], "pos long, url string")
    got = [(r["status"], r["error"]) for r in fetch.fetch(df, transport).orderBy("pos").collect()]
    assert got == [(200, None), (None, "down"), (None, "status 503"), (None, "no url")]
    lines = spark.createDataFrame([("# c",), ("",), ("https://e.com/a, my name",), ("https://e.com/a,b.html",)], "value string")
    assert [tuple(r) for r in fetch.url_list(lines).collect()] == [("https://e.com/a", "my name"), ("https://e.com/a,b.html", None)]
    kinds = spark.createDataFrame([("https://e.com/x.PDF?y", None), ("https://e.com/", "application/json"), ("https://e.com/a.docx", "")], "u string, t string").select(fetch.kind(F.col("u"), F.col("t"))).collect()
    assert [k[0] for k in kinds] == ["pdf", "json", "document"]


def test_readable_steps():
    from weftline.operators import readable as r

    assert r.strip_alt_noise("Image of a cat\ntext") == "text"
    assert r.merge_heading_paragraph("## Fast\nFast and safe") == "## Fast and safe"
    assert r.dedup_sections("# A\nx\n# A\nx\n# A\ny\n") == "# A\nx\n# A\ny\n"
    assert r.strip_class_lines("flex items-center text-sm\nreal words here") == "real words here"
    assert r.collapse_word_lists(" ".join(["token"] * 60)).endswith("...") and r.collapse_word_lists("short") == "short"
    assert r.dedup_lines("a line of more than twenty\nother\na line of more than twenty") == "a line of more than twenty\nother"
    assert r.dedup_teasers("A description that is long enough\nA description that is long enough Learn more") == "A description that is long enough"
    assert "```\nImage of x\n```" in r.readable("```\nImage of x\n```")[0]


def test_sql_names(spark):
    from weftline.functions.register import register

    register(spark)
    assert spark.sql("select page_markdown('<h1>A</h1><p>b</p>', 'https://e.com')").first()[0] == "# A\n\nb"
    assert spark.sql("select readable_text('**a**')").first()[0] == "a"
    assert spark.sql("select * from markdown_chunks('# H\n\nsome words')").first()["section_header"] == "H"
    assert spark.sql("select url from sitemap_urls('<urlset><url><loc>https://a/</loc></url></urlset>')").first()[0] == "https://a/"


def test_recovery():
    from weftline.operators.extract import captions, extract

    foot = "".join(f"<div><h3>G{g}</h3><ul>" + "".join(f'<li><a href="/{g}{i}">L{g}{i}</a></li>' for i in range(3)) + "</ul></div>" for g in range(3))
    page = f'<body><div role="region" aria-label="Announcement bar">Sale now</div><main><h1>Head</h1><p>{"Some words here. " * 12}</p></main><script type="application/json">{{"title": "A block", "body": "This sentence is only in the embedded data."}}</script><footer>{foot}</footer></body>'
    md = extract(page, "https://e.com/")["markdown"]
    assert md.startswith("> **Sale now**") and "only in the embedded data" in md and "## A block" in md
    assert "### G1" in md and "- [L12](https://e.com/12)" in md
    assert captions('<t><text start="0">Hello &amp;amp; you</text><text>again</text></t>') == "Hello & you again"
