import random
from collections import defaultdict

from weftline.llm import repeated_lines


def key(line):
    return "".join(c for c in line.lower() if c.isalpha())


def brute(rows, support, letters):
    """Every run of frequent lines of every text, of any length."""
    where = defaultdict(set)
    kept = [(d.lower(), u, [k for k in map(key, t.split("\n")) if len(k) >= letters]) for _, t, d, u in rows if d and u and t is not None]
    for d, u, ks in kept:
        for k in ks:
            where[d, (k,)].add(u)
    frequent = {s for s, us in where.items() if len(us) >= support}
    for d, u, ks in kept:
        ks = [k for k in ks if (d, (k,)) in frequent]
        for n in range(2, len(ks) + 1):
            for i in range(len(ks) - n + 1):
                where[d, tuple(ks[i : i + n])].add(u)
    return {(d, s, len(us)) for (d, s), us in where.items() if len(us) >= support}


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "row_id long, text string, domain string, url string")
    got = [(r["domain"], tuple(r["lines"]), r["support"]) for r in repeated_lines.sequences(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_sequences_of_any_length(spark):
    block = [f"the {name} line of a long block" for name in ("first", "second", "third", "fourth", "fifth", "sixth")]
    rng = random.Random(3)
    rows = [(i, "\n".join([f"own text number {chr(97 + i) * 12}", *block[: 6 if i < 5 else 4], "", "short"]), "d.x", f"u{i}") for i in range(7)]
    lines = [f"shared line of letters {c * 3}" for c in "abcd"]
    rows += [(100 + i, "\n".join(rng.choices(lines, k=rng.randint(0, 7))), rng.choice(["e.x", "E.X", "", None]), rng.choice([f"v{i % 9}", None])) for i in range(60)]
    got = mined(spark, rows)
    assert got == brute(rows, 5, 15)
    assert ("d.x", tuple(map(key, block)), 5) in got and ("d.x", tuple(map(key, block[:4])), 7) in got
    assert mined(spark, rows, longest=2) == {s for s in got if len(s[1]) <= 2}
    assert mined(spark, rows[:2]) == set()
