import hashlib
import random
import re

from sparkfield.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=13):
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(window, len(b))
            for s in range(len(b) - n + 1) if n else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit.update(range(p, p + n))
                        names.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(2)
    voc = ["the", "of", "été", "X1", "a", "b", "c", "naïve", "汉字", "Z"]
    items = [(i, " ".join(rng.choices(voc, k=rng.choice([3, 12, 13, 14, 40])))) for i in range(12)]
    items += [(None, "one two"), (99, None), (98, "?!"), (3, items[3][1])]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(voc, k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [", ".join(w[a : a + rng.choice([12, 13, 20])]).upper(), " ".join(rng.choices(voc, k=4))]
        docs.append((i, "-".join(parts)))
    docs += [(100, None), (101, ""), (None, "one, TWO"), (5, "other text"), docs[7], (102, "One two " * 300)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as words", "2 as h", "'x' as word")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words")
    rows = D.find(d, i).withColumn("contaminated", D.contaminated()).drop("h").collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items)
    kept = D.keep_clean(d, i)
    assert kept.columns == d.columns
    assert kept.count() == sum(not r[-1] for r in brute(docs, items))


def test_beyond_the_bounds(spark, monkeypatch):
    for name in ("BROADCAST_WORDS", "BROADCAST_WINDOWS", "BROADCAST_DOCUMENTS"):
        monkeypatch.setattr(D, name, 0)
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = D.find(d, i, listed=0).withColumn("contaminated", D.contaminated()).drop("h").collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items)
    assert D.keep_clean(d, i).count() == sum(not r[-1] for r in brute(docs, items))


def test_very_long_texts(spark):
    words_ = [f"w{k % 977}" for k in range(60_000)]
    docs = [(1, " ".join(words_)), (2, " ".join(words_[500:520]))]
    items = [(7, " ".join(words_[100:130])), (8, "w1 w3 w2")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = sum(100 <= k % 977 < 130 for k in range(60_000))
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in D.find(d, i).orderBy("doc_id").collect()] == [(1, 60_000, expected, 1), (2, 20, 0, 0)]


def test_empty_tables(spark):
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.n_hit for r in D.find(d, i.limit(0)).collect()} == {0}
    assert D.find(d.limit(0), i).count() == 0
