import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfield.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeat = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "x#", " ", "\n", "\t", "a b c", "\x0b", "\x85", " ", "\r\n", "汉"]), max_size=40))
def test_base_counts(parts):
    text = " ".join(parts)
    assert Q.measure(text)[:5] == brute(text)
    assert Q.measure("".join(parts))[:5] == brute("".join(parts))


def test_em_finds_the_good_rules():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.6, 0.6, 0.7, 0.8])
    right = rng.random((20000, 10)) < accuracy
    votes = np.where(right, good[:, None], ~good[:, None])
    patterns = Counter("".join("+" if v else "-" for v in row) for row in votes)
    model = Q.LabelModel.fit(list(patterns), np.array(list(patterns.values())))
    assert np.abs(np.array(list(model.accuracies().values())) - accuracy).max() < 0.05
    assert abs(model.prior - 0.8) < 0.05


def votes_by_hand(text):
    """The rules from their descriptions, without the operator's code."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [0] * 10
    n, (_, chars, symbols, dup, repeat) = len(words), brute(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = re.findall("[A-Za-z]", text)
    odd = [c for c in text if ord(c) < 128 and not re.match(r"[A-Za-z\x20\x09-\x0D]", c)]
    plain = [w for w in text.split() if w.rstrip(".,;:!?").isalpha()]
    stops = [x for x in lines if re.search(r"[.!?:;\"')]$", x.rstrip(" \t\r\v\f"))]
    shares = [
        (symbols / n, 0.10, None), (dup / len(lines), 0.30, None), (repeat / n, 0.30, None),
        (len(re.findall("[A-Z]", text)) / max(len(letters), 1), 0.30, None),
        (len(re.findall("[!?,;]", text)) / n, 0.50, None), (len(odd) / chars, 0.12, 0.06),
        (1 - len(plain) / n, 0.30, 0.10), (1 - len(stops) / len(lines), 0.80, None),
        (1 - len(set(words)) / n, 0.85, None), (abs(chars / n - 5), 3.5, None),
    ]
    return [-1 if v > bad else 1 if good is not None and v <= good else 0 for v, bad, good in shares]


def kept_by_hand(texts, rounds=200):
    """Expectation-maximisation document by document, in plain Python."""
    votes = [votes_by_hand(t) for t in texts]
    accuracy, prior = [0.8] * 10, 0.5
    last = None
    for step in range(rounds + 1):
        good = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, accuracy))
            good.append(1 / (1 + math.exp(-odds)))
        if last is not None and max(abs(a - b) for a, b in zip(good, last)) < 1e-9:
            break
        last = good
        for k in range(10):
            right = sum(g if v[k] > 0 else 1 - g for g, v in zip(good, votes) if v[k])
            cast = sum(1 for v in votes if v[k])
            accuracy[k] = min(max((right + 8) / (cast + 10), 0.55), 0.99)
        prior = min(max((sum(good) + 1) / (len(good) + 2), 0.05), 0.95)
    out = []
    for t, g in zip(texts, good):
        n, _, _, _, repeat = brute(t)
        out.append(n >= 50 and 100 * repeat <= 50 * n and g >= 0.5)
    return out


def test_kept_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(10**6 + k, t) for k, t in enumerate([None, "", "one", "LOUD WORDS! " * 40, "a # b % c " * 30, "word " * 200, "Fine words of a sentence go here. " * 2, rows[0][1]])]
    got = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([d for d, _ in rows], kept_by_hand([t for _, t in rows])))


def test_agrees_with_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = Q.judge(docs)
    assert out.count() == docs.count()
    rows = out.drop("quality").join(labels, "doc_id").where("not base_failed").collect()
    right = [r.kept == bool(r.quality) for r in rows]
    assert sum(right) / len(right) > 0.95
    clean = [r.kept for r in rows if r.quality]
    assert sum(clean) / len(clean) > 0.98


def test_nulls_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "plain words of some length here. " * 3, "x"), (4, " \n ", None), (4, " \n ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q string").withColumn("votes", F.lit(1)).withColumn("kept", F.lit(0))
    got = Q.judge(df).collect()
    assert len(got) == 5 and all(r.base_failed and not r.kept for r in got)
    assert Q.keep_good(df).columns == df.columns
    assert Q.judge(df.limit(0)).count() == 0
    assert Q.keep_good(spark.createDataFrame([(1, " ".join("abcdefghij"[i % 10] * (i // 10 + 1) for i in range(90)) + ".", "x")], "doc_id long, text string, q string")).count() == 1
