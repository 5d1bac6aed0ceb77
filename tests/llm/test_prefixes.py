import random
from itertools import combinations

import numpy as np

from weftline.llm import neardup
from weftline.llm.shingles import mix


def elements(values):
    return np.sort(mix(np.array(sorted(values), dtype=np.uint64)))


def test_similar_sets_share_words_at_every_size():
    """Also where only common elements are shared, and with sizes that differ."""
    rng = random.Random(5)
    common = elements(range(1000))
    counts = np.ones(len(common), dtype=np.int64) * 2
    for _ in range(3000):
        n = rng.choice((2, 3, 5, 8, 12, 16, 20, 22, 30, 60, 200))
        shared = rng.sample(range(1000 if rng.random() < 0.5 else 3000), n)
        rest = int(n / 0.6 + 1e-9) - n
        cut = rng.randint(0, rest)
        a = elements([*shared, *range(5000, 5000 + cut)])
        b = elements([*shared, *range(9000, 9000 + rest - cut)])
        (x, i), (y, j) = (neardup.words_of(s, common, counts, 0.6) for s in (a, b))
        assert set(x[:i].tolist()) & set(y[:j].tolist())
        first = next(w for w in x.tolist() if w in set(y.tolist()))
        assert first in x[:i] and first in y[:j]
        assert len(set(x.tolist()) & set(y.tolist())) >= 2  # a hot word has a second one


def test_short_and_templated_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    rows = []
    for n in (8, 12, 16, 20, 22, 60, 200):
        base = [word() for _ in range(n + 2)]
        rows += [" ".join(base[: (n * 3) // 4 + 2] + [word() for _ in range(n // 4)]) for _ in range(12)]
    texts = list(enumerate(rows))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in texts}
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = [(r["a"], r["b"]) for r in neardup.expand(*neardup.similar_pairs(spark.createDataFrame(texts, "content_id long, markdown string"))).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
