import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfield.llm import repeats as R


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for raw in raws:
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] = seen.get(raw[p : p + length], 0) + 1
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), st.binary(min_size=1, max_size=5))
def test_runs_count_patterns(segments, pattern):
    pattern = bytes(97 + x % 2 for x in pattern)
    raw = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8)
    index = R.RunIndex(raw, np.cumsum([len(s) + 1 for s in segments]) - 1)
    assert index.count(pattern) == sum(s.startswith(pattern, k) for s in segments for k in range(len(s)))
    assert index.run_lengths.sum() == len(raw) and len(index.run_bytes) == index.runs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6))
def test_matching_statistics(segments):
    text = b"\x00".join(segments) + b"\x00"
    ends = np.cumsum([len(s) + 1 for s in segments]) - 1
    raw = np.frombuffer(text, np.uint8)
    index = R.RunIndex(raw, ends)
    suffixes = [text[p : ends[np.searchsorted(ends, p)]] for p in range(len(text))]

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = [max((common(s, t) for j, t in enumerate(suffixes) if j != i), default=0) for i, s in enumerate(suffixes)]
    assert index.matching_statistics().tolist() == want
    assert index.runs <= index.size


def test_runs_are_few_in_copies():
    rng = random.Random(1)
    base = bytes(rng.choices(b"abcdefgh", k=300))
    segments = [base[: 100 + k] + bytes([200 + k]) + base[101 + k :] for k in range(50)]
    sizes = np.array([len(s) + 1 for s in segments])
    index = R.RunIndex(np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8), np.cumsum(sizes) - 1)
    assert index.runs < index.size / 10


def corpus(seed, length):
    rng = random.Random(seed)
    voc = ["alpha", "béta", "c", "汉", "delta,", "\x00", "eps\n"]
    passages = [" ".join(rng.choices(voc, k=rng.randint(5, 60))) for _ in range(4)]
    rows = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append("".join(chr(rng.randint(97, 122)) for _ in range(rng.randint(0, 2 * length))))
            parts.append(rng.choice(passages) if rng.random() < 0.6 else rng.choice(voc))
        rows.append("".join(parts))
    rows += [None, "", "x", "ab" * length, "a" * (3 * length), rows[0], rows[0], rows[5][1:], "y" * length, "z" + "y" * length]
    return [*enumerate(rows), (None, "y" * length), (3, rows[3])]


@pytest.mark.parametrize("seed, length, gram, options", [(1, 40, 9, {}), (2, 40, 7, {"index_bytes": 200}), (3, 30, 30, {}), (4, 40, 8, {"group_bytes": 0}), (5, 200, 48, {})])
def test_against_brute_force(spark, seed, length, gram, options):
    rows = corpus(seed, length)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as t1", "3 as marks")
    out = R.without_repeats(df, length, gram=gram, **options).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out), key=str)
    assert got == brute(rows, length)


def test_empty_table(spark):
    assert R.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
