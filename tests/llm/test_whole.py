"""Nothing is cut, dropped or switched by size: the operators against plain forms of what they do."""

import random
from operator import eq

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, budget, chunking, markup, neardup, repeated_lines, residue, toxicity, wrapper

DATA = "/root/testdata/sf0.01"


def column(table, name):
    return [x for x in pq.read_table(f"{DATA}/{table}.parquet", columns=[name]).column(name).to_pylist() if x]


# -- 2 ------------------------------------------------------------------------

def test_the_gate_denies_no_notice():
    texts = ["Diese Seite ist wegen Wartungsarbeiten nicht aktiv", "Wartungsmodus aktiv", "Confirme que não é um robô", "This page is missing", "We will be back at 10", "no encontramos nada", "429 too many attempts", "Jāvaſcript", "ſcripts must be enabled"]
    texts += [line for t in column("documents", "text") + column("fetch_results", "html") for line in t.split("\n")]
    for phrases in (residue._LATIN, residue._OTHER):
        assert phrases.strings and all(phrases.possible(t) for t in texts if phrases.whole.search(t))


def test_strings_that_a_pattern_needs():
    need = lambda p: residue.needed(residue._parser.parse(p))
    assert need("(?:ab|cd)x?") == {"ab", "cd"} and need("a*") is None and need("x|y*") is None and need(r"\d{3}.{0,9}(?:gone|lost)") == {"gone", "lost"}


def test_leaves_find_the_templates_of_a_plain_search():
    rng = random.Random(3)
    for size in (1, 2, 4, 5, 8, 13, 45):
        own, templates, slots = residue.Leaf(size), [], []
        bases = [[rng.choice("abcdefgh") for _ in range(size)] for _ in range(10)]
        for _ in range(200):
            words = list(rng.choice(bases))
            words[:3] = ["x", "y", "z"][:size]
            for _ in range(rng.randint(0, size // 3)):
                if size > 3:
                    words[rng.randrange(3, size)] = rng.choice("abcdefgh")
            same = [sum(map(eq, t, words)) + s for t, s in zip(templates, slots)]
            best = max(range(len(same)), key=lambda i: (same[i], -i), default=-1)
            if best >= 0 and same[best] >= residue.SIMILAR * size:
                templates[best] = [a if a == b else "\x00" for a, b in zip(templates[best], words)]
                slots[best] = templates[best].count("\x00")
            else:
                best = len(templates)
                templates.append(list(words))
                slots.append(0)
            assert own.add(list(words)) == best


def test_long_notices_and_paths_in_code(spark):
    long = "This website is using a security service to protect itself from online attacks. The action you just performed triggered the security solution and access denied was the answer. There are several actions that could trigger this block, among them a certain word, a command, or unusual traffic from {} in the last hour; please try again later."
    pages = [(i, f"https://h{i}.com/", f"<title>Access denied</title><h1>Access denied</h1><p>{long.format(chr(65 + i) + 'xyz network')}</p>") for i in range(8)]
    pages += [(20, "https://k.com/x", "<h1>Not Found</h1><p>The requested URL <code>/x</code> was not found on this server.</p>")]
    pages += [(30 + i, f"https://r{i}.com/", f"<h1>Part {i}</h1><p>{' '.join(random.Random(i).choices('river stone walks under green bridge while many boats pass slowly along'.split(), k=60))}</p>") for i in range(8)]
    got = {r["fetch_id"]: r["residue"] for r in residue.residue(spark.createDataFrame(pages, "fetch_id long, url string, html string")).collect()}
    assert all(got[i] for i in (*range(8), 20)) and not any(got[30 + i] for i in range(8))


def test_long_texts_are_not_searched_for_every_phrase(monkeypatch):
    class Whole:
        def finditer(self, text):
            raise AssertionError("all alternatives are tried")

    passing = "the next page is missing here " + "a river runs by old stone walls " * 30
    notice = "access denied and the page is gone, come back later " * 7
    for phrases in (residue._LATIN, residue._OTHER):
        monkeypatch.setattr(phrases, "whole", Whole())
    assert not residue.is_notice(passing, len(residue.leaf(passing)[0])) and residue.is_notice(notice, len(residue.leaf(notice)[0]))


def test_counts_and_masks_of_plain_patterns():
    slots = residue.re.compile(r"https?://\S+|(?<![\w<])/[\w\-./%?=&#]+|\b[0-9a-f]{6,}\b|\d+(?:[.:,\-]\d+)*", residue.re.I)
    odd = ["HTTPſ://a/b c/d /e?f=1 deadBEEF decade9 1.2:3-4, ٣٤,٥ <*>/x _/y 7abcdef0z", "access denied access denied not found " * 30, "ſcripts must be enabled " * 40, "доступ закрыт, not found " * 40]
    for text in odd + [line for t in column("documents", "text") + column("fetch_results", "html") for line in t.split("\n")]:
        assert residue.masked(text) == (slots.sub("<*>", text) if residue._VARIES.search(text) else text)
        words = len(text.split())
        if words > residue.NOTICE_WORDS:
            plain = [sum(1 for _ in x.whole.finditer(text)) for x in (residue._LATIN, residue._OTHER)]
            assert [residue._LATIN.count(text), residue._OTHER.count(text)] == plain
            assert residue.is_notice(text, words) is (sum(plain) * residue.NOTICE_WORDS >= words)


def test_a_page_without_blocks_leaves_the_hashes_of_others_whole(spark):
    pages = [(1, "https://a.com/", "<h1>River</h1><p>Stone walls by the river</p>"), (2, "https://b.com/", "<div></div>"), (3, "https://c.com/", "<p>Boats pass 12 bridges</p>")]
    rows = residue._scan(spark.createDataFrame(pages, "fetch_id long, url string, html string").coalesce(1), "fetch_id", "url", "html").collect()
    assert len(rows) == 4 and [r["_x"] for r in rows if r["_key"] == 2] == [None]
    assert all((r["_x"], r["_leaf"]) == (residue._hash(r["_mask"]), residue._hash(residue.leaf(r["_mask"])[1])) for r in rows if r["_mask"])


# -- 3 ------------------------------------------------------------------------

def test_lines_know_their_longest_sequence(spark):
    part = ["first repeated line of it", "second repeated line of it", "third repeated line of it", "fourth repeated line of it"]
    rows = [(i, f"u{i}", "d", "\n".join([f"own words of page number {chr(97 + i) * 9}", *part, "an end"])) for i in range(5)]
    rows += [(9, "u9", "d", f"{part[2]}\nx\n{part[0]}")]
    df = spark.createDataFrame(rows, "row_id long, url string, domain string, text string")
    got = {(r["row_id"], r["line_no"]): (r["support"], r["longest"]) for r in repeated_lines.repeated(df).collect()}
    assert {k[1] for k in got if k[0] == 0} == {1, 2, 3, 4} and got[0, 1] == (6, 4) and got[0, 4] == (5, 4)
    assert {k: got[k][1] for k in got if k[0] == 9} == {(9, 0): 1, (9, 2): 1}


# -- 4 ------------------------------------------------------------------------

def test_small_shares_draw_rows_and_nothing_to_fit_on_raises(spark):
    n = spark.range(3_000_000).where(budget.drawn(F.col("id"), 1e-5, "budget")).count()
    assert 10 <= n <= 60
    tags = spark.createDataFrame([("en", "en")], "tag string, lang string")
    rows = [(i, f"some words of row {i} and more of them", "web", "en", "d") for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, text string, source_type string, language string, domain string")
    with pytest.raises(ValueError):
        budget.token_budget(df, tags, sample_rows=0)
    total = budget.token_budget(df, tags).agg(F.sum("tokens")).first()[0]
    each = budget.token_estimates(df, tags).agg(F.sum("tokens"), F.count("*")).first()
    assert each[1] == 50 and abs(each[0] - total) <= 25 and total > 300


# -- 1, 8 ---------------------------------------------------------------------

def test_pieces_are_counted_exactly():
    own = bpe.encoder()
    for text in sorted(column("chunks", "text"), key=len)[-25:]:
        pieces = chunking.split_text(text, 128, 16, own)
        assert all(p.tokens == len(own.encode(text[p.start : p.end])) <= 128 for p in pieces)
        assert pieces[0].start == 0 and pieces[-1].end == len(text) and all(a.end >= b.start for a, b in zip(pieces, pieces[1:]))


def test_pairs_are_checked_as_one_by_one(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 50)
    own = bpe.SpeculativeBPE()
    rng = np.random.default_rng(1)
    for _ in range(5):
        pairs = np.unique((rng.integers(0, 50_000, 80) << 20) | rng.integers(0, 50_000, 80))
        want = [own.merge(own.bytes_of[a] + own.bytes_of[b]) == [a, b] for a, b in zip((pairs >> 20).tolist(), (pairs & 0xFFFFF).tolist())]
        assert own.compatible(pairs).tolist() == want == own.compatible(pairs).tolist()


# -- 5 ------------------------------------------------------------------------

def test_nesting_of_any_depth():
    tex = "\\textbf{" * 12 + "deep" + "}" * 12
    assert markup.clean(tex, markup.kinds(tex)) == "deep"
    wiki = "a " + "{{t|" * 10 + "x" + "}}" * 10 + " b"
    assert markup.clean(wiki, markup.kinds(wiki)) == "a b"
    html = "<p>it&amp;amp;amp;lt;s</p>"
    assert not markup.kinds(markup.clean(html, markup.kinds(html)))
    for text in column("contents", "plain_text")[:200]:
        found = markup.kinds(text, True)
        assert not found or markup.changed(text, markup.clean(text, found, True))


# -- 6 ------------------------------------------------------------------------

def test_tree_matching_keeps_order_and_is_largest():
    rng = random.Random(4)
    tree = lambda: [[(10 * b + i, frozenset(rng.sample(range(8), rng.randint(0, 2)))) for i in range(rng.randint(1, 3))] for b in range(rng.randint(1, 4))]

    def most(n, m, weight):
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight(i, j))
        return best[n][m]

    for _ in range(300):
        a, b = tree(), tree()
        got = wrapper.tree_matching(a, b)
        assert got == sorted(got) and all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))
        labels = [{i: s for block in t for i, s in block} for t in (a, b)]
        assert all(labels[0][i] & labels[1][j] for i, j in got)
        assert len(got) == most(len(a), len(b), lambda x, y: most(len(a[x]), len(b[y]), lambda i, j: bool(a[x][i][1] & b[y][j][1])))


def test_constant_heading_and_long_targets(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "PART_PAGES", 4)
    body = lambda i: " ".join(random.Random(i).choices("river stone walks under green bridge while boats pass slowly along quiet water".split(), k=30)) + "."
    pages = [(i, f"https://www.brandsite.com/{i}", f"# Brandsite\n\n{body(i)}\n\n- [ref {body(100 + i)[:9]}](/{'deep/' * 20}{chr(97 + i)})\n\nTerms of use | Imprint\n") for i in range(12)]
    pages += [(50, None, None), (51, "https://www.brandsite.com/x", "")]
    got = {(r["content_id"], r["line_no"]) for r in wrapper.furniture(spark.createDataFrame(pages, "content_id long, url string, markdown string")).collect()}
    assert {(i, 6) for i in range(12)} <= got and not {(i, k) for i in range(12) for k in (0, 2, 4)} & got


# -- 7 ------------------------------------------------------------------------

def test_texts_alike_by_common_parts_alone_are_linked(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    frame = [word() for _ in range(160)]
    rows = [(i, " ".join([*frame, *[word() for _ in range(40)]])) for i in range(30)]
    rows += [(100 + i, " ".join(word() for _ in range(rng.randint(3, 120)))) for i in range(60)]
    df = spark.createDataFrame(rows, "content_id long, markdown string")
    members, links = neardup.similar_pairs(df)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(i, j) for i in range(30) for j in range(i + 1, 30)}


def test_fingerprints_pass_all_similar_pairs_of_up_to_98_elements():
    rng = np.random.default_rng(2)
    least = neardup.least_agreement(0.6)
    for n in (5, 20, 60, 98):
        for _ in range(60):
            shared = -(-6 * 2 * n // 16)
            pool = neardup.mix(rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64))
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
            f, g = (np.array(neardup.fingerprint(x), dtype=np.int64).view(np.uint64) for x in (a, b))
            assert 128 - int(np.bitwise_count(f ^ g).sum()) >= least


# -- 10 -----------------------------------------------------------------------

def test_scores_are_by_length_and_few_labels_do_not_flag_ordinary_texts(spark):
    rng = random.Random(9)
    topics = ["cache", "crawler", "store", "index", "queue", "parser", "chunk", "table"]
    plain = lambda: f"The {rng.choice(topics)} of {rng.choice(topics)} {rng.choice(['reads', 'keeps', 'drops'])} {rng.randint(1, 99)} rows of {''.join(rng.choices('abcdef', k=6))}."
    rude = ["You are a worthless idiot and nobody likes you.", "Shut your mouth you stupid idiot.", "Go away you worthless stupid fool."]
    rows = [(i, " ".join([plain() for _ in range(5)] + ([rng.choice(rude)] if i % 20 == 0 else [])), "s") for i in range(400)]
    labels = [(i, int(i % 20 == 0)) for i in range(0, 400, 10)]
    got = {r["doc_id"]: r for r in toxicity.score_content(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, label int")).collect()}
    flagged = {k for k, r in got.items() if r["unacceptable"]}
    assert len(flagged & set(range(0, 400, 20))) >= 18 and len(flagged - set(range(0, 400, 20))) <= 2
