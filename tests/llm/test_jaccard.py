import random

import pytest

from sparkfield.llm import graph
from sparkfield.llm import jaccard as J


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def corpus(seed, groups=12, size=8, passage=True):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(400)]
    common = rng.choices(voc, k=30)
    rows = []
    for _ in range(groups):
        base = rng.choices(voc, k=rng.choice([2, 5, 12, 30, 60, 150, 300]))
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(voc)
            if passage and rng.random() < 0.3:
                words += common
            rows.append(rng.choice([" ", "\n", "  "]).join(words).title())
    rows += [None, "", " \n", "one", "ONE", "one two", "É x y z", "é x y z", "same row here now", "long " * 9000]
    rng.shuffle(rows)
    return [*enumerate(rows), (3, rows[3]), (None, "one"), (None, "lonely text without id")]


@pytest.mark.parametrize("seed, n, percent, options", [
    (1, 3, 90, {}),
    (2, 5, 80, {}),
    (3, 3, 90, {"frequent": 1}),
    (4, 5, 80, {"frequent": 1, "block_shingles": 300}),
    (6, 5, 80, {"frequent": 2}),
    (8, 3, 76, {"frequent": 1}),
    (5, 3, 70, {"block_shingles": 200}),
])
def test_against_brute_force(spark, seed, n, percent, options):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as r1")
    got = sorted((tuple(r) for r in J.components(df, n, percent, **options).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_keep_one(spark):
    rows = corpus(7, groups=5)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "2 as r1")
    kept = J.keep_one(df, 5, 80)
    assert kept.columns == df.columns
    truth = brute(rows, 5, 80)
    empty = sum(n == 0 for _, n, _ in truth)
    lonely = 1  # the component without any id
    assert kept.count() == len({c for _, n, c in truth if n and c is not None}) + empty + lonely
    assert J.keep_one(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 600: 600, 601: 600}


@pytest.mark.parametrize("n", [1, 3, 5, 8])
def test_few_words_in_all(n):
    for k in range(12):
        for texts in ([" ".join(f"w{i}" for i in range(k))], [None, *[f"w{i}" for i in range(k)], ""]):
            assert [len(s) for s in J.Shingler(n)(texts)] == [len(shingles(t, n)) for t in texts]


@pytest.mark.parametrize("percent", [75, 76, 80, 85, 90, 95, 99])
def test_sketches_share_more_than_they_do_not(percent):
    assert all(J.bounds(n, percent)[2] >= 2 for n in [*range(1, 600), 1000, 5001, 40000])


@pytest.mark.parametrize("percent", [75, 80, 90])
def test_linked_sets_have_a_common_key(percent):
    rng = random.Random(percent)
    for _ in range(3000):
        n = rng.randrange(1, 150)
        a = set(rng.sample(range(1, 10**6), n))
        b = set(a)
        for _ in range(rng.randrange(0, n // 4 + 1)):
            step = rng.random()
            if step < 0.6 and b:
                b.remove(rng.choice(sorted(b)))
            if step > 0.3:
                b.add(rng.randrange(10**6))
        if not b or a == b or 100 * len(a & b) < percent * len(a | b):
            continue
        # Counts are any function of the shingle; those of shared ones are 2 at least.
        sketches = [sorted(s)[: int(J.sketch_size(len(s), percent))] for s in (a, b)]
        shared = set(sketches[0]) & set(sketches[1])
        df = {h: rng.choice([1, 2, 3, 9]) if h not in shared else rng.choice([2, 3, 9]) for h in a | b}
        for frequent in (1, 2, 5):
            keys = [set(J.keys_of(sorted((df[h], h) for h in s if df[h] > 1), len(x), percent, frequent)) for s, x in zip(sketches, (a, b))]
            assert keys[0] & keys[1]


def test_keys_of_long_documents_are_as_many_as_their_sketch():
    order = [(100, h) for h in range(int(J.sketch_size(50_000, 90)))]
    assert len(J.keys_of(order, 50_000, 90, 64)) < len(order)
