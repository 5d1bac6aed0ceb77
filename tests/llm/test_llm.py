"""The operators of problems 1 to 10 against brute force, exact round trips and defined edge cases."""

import itertools
import random
import re

import numpy as np
import pytest

from weftline.llm import budget, bpe, chunking, encode, markup, neardup, pack, repeated_lines, residue, toxicity, wrapper
from weftline.llm.shingles import shingle_sets, words

WORDS = "river stone lamp under green quickly table seven window market cloud paper engine garden silver north follow bright carry letter".split()


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er"]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder()


@pytest.fixture(scope="module")
def rust(coder):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})


# -- 8 ------------------------------------------------------------------------

def test_encoding_equals_the_public_encoder(coder, rust):
    rng = random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice("ab'sté 日\n\t\x1c\x85　 1½²٣_-=<|>​кя😀aaa\x00") for _ in range(rng.randint(0, 60)))
        assert coder.encode(t) == rust.encode_ordinary(t), repr(t)
        t = "".join(rng.choice("abcdefgh ") for _ in range(150))
        assert coder.encode(t) == rust.encode_ordinary(t), repr(t)
    assert coder.encode("x" * 50_000) == coder.merge(b"x" * 50_000)
    assert coder.encode("<|endoftext|>") == rust.encode_ordinary("<|endoftext|>")


def test_encode_ids(spark, coder):
    df = spark.createDataFrame([(1, "hello world", 9), (2, None, 9), (3, "", 9), (1, "hello world", 9), (4, "a " * 60_000, 9)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], len(r["ids"]), r["ids"][:3]) for r in encode.encode_ids(df).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and got[2][1] == got[3][1] == 0
    assert got[0][2] == coder.encode("hello world") and got[4][1] == len(coder.encode("a " * 60_000))
    assert encode.encode_ids(df.limit(0)).count() == 0


# -- 1 ------------------------------------------------------------------------

def check_pieces(text, pieces, limit, overlap, coder):
    end = 0
    for i, p in enumerate(pieces):
        assert p.start <= end and p.tokens == coder.count_batch([text[p.start : p.end]])[0] <= limit
        if i:
            assert coder.count_batch([text[p.start : end]])[0] <= overlap
        end = p.end
    assert end == len(text)


def test_pieces_cover_and_stay_below_the_limit(coder):
    rng = random.Random(2)
    long = "\n\n".join(" ".join(sentence(rng) for _ in range(6)) for _ in range(40))
    for text in (long, long.replace("\n", "\r\n"), long.replace("\n", " "), "x" * 9000, "日本語の文。" * 900, "😀" * 2000, " \n" * 3000, "a"):
        for limit, overlap in ((128, 16), (64, 0), (512, 64)):
            check_pieces(text, chunking.split_text(text, limit, overlap, coder), limit, overlap, coder)


def test_an_edit_moves_only_neighbouring_cuts(coder):
    rng = random.Random(3)
    text = "\n\n".join(" ".join(sentence(rng) for _ in range(5)) for _ in range(120))
    a = {text[p.start : p.end] for p in chunking.split_text(text, 256, 0, coder)}
    at = text.index("\n\n", 400)
    edited = text[:at] + " One more sentence." + text[at:]
    b = {edited[p.start : p.end] for p in chunking.split_text(edited, 256, 0, coder)}
    assert len(a - b) <= 4 < len(a)


def test_split_oversized(spark):
    rng = random.Random(4)
    body = "\n\n".join(sentence(rng, 12) for _ in range(20))
    text = f"{body}\n\n## Second\n\n{body}\n\n```\n# no heading\n```\n"
    df = spark.createDataFrame([(1, text, 100, "First", "x"), (2, "", None, None, "x"), (3, None, 5, "H", "x"), (4, "short", 7, None, "x")], "chunk_id long, text string, char_offset long, section_header string, pieces string")
    rows = chunking.split_oversized(df, 128, 16).collect()
    by = {k: [r for r in rows if r["chunk_id"] == k] for k in (1, 2, 3, 4)}
    assert len(by[1]) > 3 and all(text[r["char_offset"] - 100 :].startswith(r["text"]) for r in by[1])
    assert by[1][0]["section_header"] == "First" and by[1][-1]["section_header"] == "Second"
    assert [(by[k][0]["pieces"], by[k][0]["token_estimate"]) for k in (2, 3)] == [(1, 0), (1, 0)] and by[2][0]["char_offset"] == 0
    assert by[4][0]["char_offset"] == 7
    assert chunking.split_oversized(df.limit(0), 128, 16).count() == 0


# -- 9 ------------------------------------------------------------------------

def test_plan_packs_whole_and_tight():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randint(1, 40)
        counts = {s: rng.randint(0, 30) for s in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        runs, made = pack.plan(counts, capacity)
        load, seen = {}, {}
        for size, a, b, first, each in runs:
            for rank in range(a, b):
                assert (size, rank) not in seen
                seen[size, rank] = first + (rank - a) // each
                load[seen[size, rank]] = load.get(seen[size, rank], 0) + size
        assert len(seen) == sum(counts.values()) and max(load.values(), default=0) <= capacity and len(load) == made
        total = sum(s * n for s, n in counts.items())
        assert made <= 11 / 9 * max(-(-total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity)) + 4


def test_pack(spark):
    rows = [(i, "word " * n, "c") for i, n in enumerate([0, 5, 5, 5, 9, 30, 3, 3])] + [(98, None, "c"), (5, "word " * 30, "c")]
    out = pack.pack(spark.createDataFrame(rows, "doc_id long, text string, tokens string"), capacity=10).collect()
    load = {}
    for r in out:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
    assert max(load.values()) <= 10 and len({(r["doc_id"], r["piece"]) for r in out}) == len(out) - 4  # one document is there twice
    assert {r["doc_id"] for r in out if r["piece"]} == {5} and {r["container_id"] for r in out if r["doc_id"] in (0, 98)} == {0}
    assert pack.pack(spark.createDataFrame([], "doc_id long, text string"), capacity=10).count() == 0


# -- 3 ------------------------------------------------------------------------

def brute_lines(rows, support, letters):
    key = lambda line: "".join(c for c in line.lower() if c.isalpha())
    where, out = {}, []
    for r, text, domain, url in rows:
        if domain and text is not None:
            for i, line in enumerate(text.split("\n")):
                if len(key(line)) >= letters:
                    where.setdefault((domain.lower(), key(line)), set()).add(url)
                    out.append((r, i, (domain.lower(), key(line))))
    return {(r, i) for r, i, k in out if len(where[k]) >= support}


def test_repeated_lines(spark):
    rng = random.Random(6)
    lines = ["All rights reserved by 12", "ALL RIGHTS -- reserved by", "Share this page now please", "short"]
    rows = [(i, "\n".join(rng.choices([*lines, sentence(rng), ""], k=rng.randint(0, 6))), rng.choice(["a.x", "A.X", "b.x", "", None]), f"u{rng.randint(0, 12)}") for i in range(120)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "row_id long, text string, domain string, url string, support string")
    got = {(r["row_id"], r["line_no"]) for r in repeated_lines.repeated(df, support=4).collect()}
    assert got == brute_lines(rows, 4, 15) and got
    clean = {r["row_id"]: (r["text"], r["removed"]) for r in repeated_lines.without_repeated(df, support=4).collect()}
    for r, text, *_ in rows:
        kept = [line for i, line in enumerate(text.split("\n")) if (r, i) not in got]
        assert clean[r] == ("\n".join(kept), len(text.split("\n")) - len(kept))
    assert repeated_lines.repeated(df.limit(0)).count() == 0


def test_sequences(spark):
    rows = [(i, "the first repeated line\nthe second repeated line\n" + sentence(random.Random(i)), "d", f"u{i}") for i in range(5)]
    got = {(tuple(r["lines"]), r["support"]) for r in repeated_lines.sequences(spark.createDataFrame(rows, "row_id long, text string, domain string, url string")).collect()}
    assert (("thefirstrepeatedline", "thesecondrepeatedline"), 5) in got and (("thefirstrepeatedline",), 5) in got


# -- 4 ------------------------------------------------------------------------

def test_budget(spark, coder):
    rng = random.Random(7)
    rows = [(i, " ".join(sentence(rng) for _ in range(rng.randint(1, 8))), rng.choice(["WEB", "web", None]), rng.choice(["en", "EN", None]), rng.choice(["d", "D", "", None])) for i in range(600)] + [(900, "", "web", "en", "d")]
    df = spark.createDataFrame(rows, "row_id long, text string, source_type string, language string, domain string")
    tags = spark.createDataFrame([("en", "en"), ("EN", "en")], "tag string, lang string")
    out = budget.token_budget(df, tags).collect()
    true = int(coder.count_batch([r[1] for r in rows]).sum())
    assert sum(r["rows"] for r in out) == 601 and abs(sum(r["tokens"] for r in out) / true - 1) < 0.03
    assert {r["language"] for r in out} == {"en", "unknown"} and {r["domain"] for r in out} == {"d", "", None}
    assert budget.token_budget(df.limit(0), tags).count() == 0


# -- 5 ------------------------------------------------------------------------

@pytest.mark.parametrize(
    ("text", "plain", "found"),
    [
        ("a <br> b", False, ["html"]), ("x &nbsp; y", False, ["html"]), ("<!-- c -->", False, ["html"]), ("x < 3 and Q&A; R&D", False, []), ("use `<div>` here", False, []), ("```html\n<p>\n```", False, []),
        ("[[A|B]] c", False, ["wiki"]), ("{{cn|x}}", False, ["wiki"]), ("== Head ==", False, ["wiki"]), ("# Head\n**b** [l](u)", False, []), ("# Head", True, ["markdown"]), ("a **b** c", True, ["markdown"]), ("Head\n====", True, ["markdown"]),
        ("3 * 4 * 5", True, []), ("\\emph{x}", False, ["latex"]), ("C:\\data\\new", False, []), ("$$ \\frac{a}{b} $$", False, []), ("", True, []), (None, False, []), ("see [2], [sic].", True, []), ("It costs $70 or 5%; x_70 <3", True, []),
    ],
)
def test_kinds(text, plain, found):
    assert markup.kinds(text, plain) == found


def test_clean():
    c = lambda t, p=False: markup.clean(t, markup.kinds(t, p), p)
    assert c("<p>One</p><ul><li>a</li><li>b &amp; c</li></ul><pre>x &lt; y</pre>") == "One\n\n- a\n- b & c\n\n```\nx < y\n```"
    assert c("\\section{A}\n\\begin{itemize}\n\\item b\\footnote{n}\n\\end{itemize}\nc\\cite{d}") == "## A\n- b (n)\nc"
    assert c("== A ==\n'''b''' [[C|d]] {{x}}\n* e") == "## A\nb d\n- e"
    assert c("## A\n\n**b** [c](d) `e`\n\n> f", True) == "A\n\nb c e\n\nf"
    assert c("keep `<b>` and $$\\frac{a}{b}$$ <i>x</i>") == "keep `<b>` and $$\\frac{a}{b}$$ x"
    assert c("&lt;p&gt;x&lt;/p&gt;") == "x" and c("no markup") == "no markup" and c(None) is None
    nav = "<div>" + "".join(f'<a href="/{i}">Menu entry number {i}</a> ' for i in range(9)) + "</div><div><p>" + "A real paragraph, with commas, and words. " * 6 + "</p></div>"
    assert "Menu" not in c(nav) and "real paragraph" in c(nav)
    assert "deep" in c("<div>" * 5000 + "deep<br>")


def test_clean_markup_rows(spark):
    df = spark.createDataFrame([(1, "x <b>y</b>", "k"), (2, None, "k"), (3, "", "k"), (1, "x <b>y</b>", "k")], "row_id long, text string, kinds string")
    got = sorted((r["record_id"], r["kinds"], r["text"]) for r in markup.clean_markup(df, "row_id", {"text": False}).fillna("-").collect())
    assert got == [(1, ["html"], "x y"), (1, ["html"], "x y"), (2, [], "-"), (3, [], "")]
    assert markup.clean_markup(df.limit(0), "row_id", {"text": False}).count() == 0


# -- 6 ------------------------------------------------------------------------

def site_page(rng, i, name="Zanzibar"):
    return f"Skip to main content of {name}\n\n# Topic {i} {sentence(rng, 3)}\n\nWritten by {rng.choice(['Ada Lovelace', 'Alan Turing', 'Grace Hopper'])}, editor at {name}\n\n{sentence(rng)} {sentence(rng)}\n\n- plain item {sentence(rng)}\n- [Other](https://e.com/{i}): explained here\n\n### Related articles\n- [One {i}](/r/{i})\n- [Two](/r/{i + 1})\n\n© 20{10 + i % 15} {name}. All rights reserved."


def test_furniture(spark):
    rng = random.Random(8)
    rows = [(i, f"https://docs.zanzibar.example/{i}", site_page(rng, i), 1) for i in range(30)] + [(90, None, "# Alone\n\nSome text.", 1), (91, "https://z/", None, 1), (92, "https://z/", "", 1)]
    df = spark.createDataFrame(rows, "content_id long, url string, markdown string, line_no int")
    got = {}
    for r in wrapper.furniture(df).collect():
        got.setdefault(r["content_id"], set()).add(r["line_no"])
    for i, _, text, _ in rows[:30]:
        true = {n for n, line in enumerate(text.split("\n")) if line.startswith(("Skip", "Written", "### Rel", "- [One", "- [Two", "©"))}
        assert got[i] == true
    assert not {90, 91, 92} & set(got)
    body = {r["content_id"]: r for r in wrapper.main_body(df, "content_id", "url", "markdown").collect()}
    assert body[3]["body"].startswith("# Topic 3") and body[3]["removed"] == 6 and body[91]["body"] is None and body[92]["body"] == "" and len(body) == 33
    assert wrapper.furniture(df.limit(0)).count() == 0


def test_html_lines():
    text = wrapper.html_lines("<nav><ul><li><a href='/a'>A</a></li></ul></nav><h1>T</h1><p>x <a href='/b'>y</a></p><pre>c\nd</pre><script>no</script>")
    assert text.split("\n") == ["- [A](/a)", "# T", "x [y](/b)", "```", "c", "d", "```"]


# -- 2 ------------------------------------------------------------------------

@pytest.mark.parametrize(
    ("html", "gap"),
    [
        ("<h1>{{ title }}</h1>", True), ("<p>Price: ${price}</p>", True), ("<p>&lt;%= x %&gt;</p>", True), ("<p>%USER_NAME%</p>", True), ("<p>[Insert title here]</p>", True), ("<p>Lorem ipsum dolor sit amet</p>", True), ("<p>This is sample text. More.</p>", True), ("<p>In [object Object]</p>", True), ("<p>{item.name}</p>", True),
        ("<code>{{ title }}</code>", False), ("<pre>${x}</pre>", False), ("<script>'${x}'</script><p>ok</p>", False), ("<!-- {{ x }} --><p>ok</p>", False), ("<p>Designers use lorem ipsum, but we don't.</p>", False), ("<p>$$ \\frac{a_i}{33} $$</p>", False), ("<p>Let {a, b} be a pair, 50% of it</p>", False), ("<noscript>{{ x }}</noscript>", False),
    ],
)
def test_gaps(html, gap):
    assert any(residue.has_gap(k, t) for k, t, _ in residue.blocks(html)[0]) is gap


def test_residue(spark):
    rng = random.Random(9)
    real = [(i, f"https://h{i % 4}.x/{i}", f"<title>Page {sentence(rng, 3)}</title><h1>{sentence(rng, 3)}</h1><p>{sentence(rng, 14)} {sentence(rng, 14)}</p><noscript>Scripts are off</noscript><p>© Site</p>") for i in range(40)]
    notes = [(100 + i, f"https://h{i % 4}.x/n{i}", f"<title>Site {i % 7}</title><h1>Oh no!</h1><p>Your address sent too many requests; wait {i} seconds.</p><p>© Site</p>") for i in range(12)]
    odd = [(200, "https://h1.x/s", "<title>App</title><noscript>Please switch on scripts</noscript>"), (201, None, None), (202, "u", ""), (203, "https://h2.x/g", real[0][2].replace("</h1>", " {{ name }}</h1>")), (204, "https://h2.x/t", "<pre>Traceback (most recent call last):\nKeyError</pre>"), (205, "https://h2.x/e", "<div></div>")]
    df = spark.createDataFrame([(*r, "x") for r in real + notes + odd], "fetch_id long, url string, html string, reason string")
    got = {r["fetch_id"]: r["reason"] for r in residue.residue(df).collect()}
    assert all(got[i] is None for i in range(40)) and all(got[100 + i] == "notice" for i in range(12))
    assert [got[k] for k in (200, 201, 202, 203, 204, 205)] == ["noscript", None, None, "gap", "notice", None]
    assert residue.residue(df.limit(0)).count() == 0


# -- 7 ------------------------------------------------------------------------

def similarity(a, b):
    grams = lambda t: {tuple(words(t)[i : i + 3]) for i in range(len(words(t)) - 2)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_duplicates(spark):
    rng = random.Random(10)
    texts = []
    for _ in range(40):
        base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(rng.randint(20, 300))).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            for _ in range(rng.randint(0, len(other) // 7)):
                other[rng.randrange(len(other))] = "changed" + str(rng.randint(0, 99999))
            texts.append(" ".join(other))
    texts += [texts[0], texts[0].upper(), "", None, "two words", "two words", "three short words", "three short words"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "content_id long, markdown string, n int")
    true = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] and texts[b] and similarity(texts[a], texts[b]) >= 0.6}
    got = [(r["a"], r["b"]) for r in neardup.expand(*neardup.similar_pairs(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == true
    groups = {r["content_id"]: r for r in neardup.groups(df).collect()}
    assert len(groups) == len(texts)
    for a, b in true:
        assert groups[a]["group_id"] == groups[b]["group_id"]
    assert neardup.expand(*neardup.similar_pairs(df.limit(0))).count() == 0


def test_hot_words_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    rng = random.Random(11)
    base = [rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(120)]
    rows = []
    for i in range(14):
        other = list(base)
        for _ in range(5):
            other[rng.randrange(len(other))] = f"edit{rng.randint(0, 99999)}"
        rows.append((i, " ".join(other)))
    got = {(r["a"], r["b"]) for r in neardup.expand(*neardup.similar_pairs(spark.createDataFrame(rows, "content_id long, markdown string"))).collect()}
    assert got == {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if similarity(x, y) >= 0.6}


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(12)
    for _ in range(50):
        common = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
        x, y = neardup.sketch(a, 10, 0.6), neardup.sketch(b, 10, 0.6)
        apart = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
        assert apart <= len(np.setxor1d(a, b))


def test_shingles():
    assert words("Ab-c2 日本 カナ・x") == ["ab", "c2", "日", "本", "カ", "ナ", "x"]
    assert [len(s) for s in shingle_sets(["a b c d", "a b", None, "", "a b c a b c"])] == [2, 0, 0, 0, 3]


# -- 10 -----------------------------------------------------------------------

@pytest.mark.parametrize(("word", "plain"), [("1d10t", "idiot"), ("f00l", "fol"), ("іdіоt", "idiot"), ("stuuupid", "stupid"), ("$cum", "scum"), ("déchet", "dechet"), ("2024", "0"), ("08T08", "0"), ("привет", "привет"), ("日", "日")])
def test_plain_word(word, plain):
    assert toxicity.plain_word(word) == plain


def test_score_content(spark):
    rng = random.Random(13)
    insults = ["You are a worthless {0} and everyone here knows it.", "Shut up, you brainless {0}, nobody asked you.", "I will find out where you live, stupid {0}."]
    rows, labels = [], []
    for i in range(160):
        bad = i % 3 == 0
        parts = [sentence(rng) for _ in range(rng.randint(2, 6))]
        if bad:
            parts.insert(rng.randrange(len(parts)), rng.choice(insults).format(rng.choice(["clown", "fool", "pig"])))
        rows.append((i, "\n".join(parts), f"s{i % 2}", "k"))
        if i < 120:
            labels.append((i, "r", int(bad)))
    rows += [(900, "Shut up, you br@1nl3$$ f00l, nobody asked y o u r self.", "s0", "k"), (901, None, "s0", "k"), (902, "", "s0", "k"), (903, "The report says that the word is masked. " * 3000, "s0", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, label int")
    out = {r["doc_id"]: r for r in toxicity.score_content(df, lab).collect()}
    held = range(120, 160)
    assert sum(out[i]["unacceptable"] == (i % 3 == 0) for i in held) / len(held) >= 0.9
    assert out[900]["unacceptable"] and not any(out[i]["unacceptable"] for i in (901, 902, 903)) and out[901]["score"] == 0
    rates = {r["source"]: r["documents"] for r in toxicity.rates(toxicity.score_content(df, lab)).collect()}
    assert sum(rates.values()) == len(rows)
    assert not any(r["unacceptable"] for r in toxicity.score_content(df, lab.limit(0)).collect())
    assert toxicity.score_content(df.limit(0), lab).count() == 0


def test_no_other_module_imports_this_subpackage():
    import pathlib

    import weftline

    root = pathlib.Path(weftline.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+\S*\bllm\b", f.read_text(), re.M), f


# -- long and odd texts ---------------------------------------------------------

@pytest.mark.parametrize("text", ["x" * 200_000, "# " + " " * 100_000 + "x", "a\n" + " " * 100_000 + "b <br>", "word " * 40_000, "*" * 50_000, "[" * 50_000, "{" * 50_000, "<" * 50_000, "'" * 50_000, "`" * 50_001, "$" * 50_001, "<!--" * 20_000, "<a href='" * 10_000, "=" * 50_000, "\\" * 50_000, "&" * 50_000, "a " * 60_000])
def test_no_kernel_blows_up(text, coder):
    import time

    began = time.time()
    for plain in (False, True):
        markup.clean(text, markup.kinds(text, plain), plain)
    chunking.headings(text)
    wrapper.page_labels(text, "site.example")
    wrapper.html_lines(text)
    found, _ = residue.blocks(text)
    [residue.has_gap(k, t) for k, t, _ in found]
    [residue.leaf(residue.masked(t)) for _, t, _ in found]
    toxicity.sentences(text)
    shingle_sets([text])
    coder.count_batch([text])
    assert time.time() - began < 20
