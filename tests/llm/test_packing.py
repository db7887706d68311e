import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfield.llm import packing as P
from sparkfield.llm import tokens


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_plan_covers_the_histogram(h):
    counts = np.zeros(65, np.int64)
    for k, v in h.items():
        counts[k] = v
    used = np.zeros(65, np.int64)
    for lengths, n in P.plan(counts, 64):
        assert sum(lengths) <= 64 and n > 0
        for v in lengths:
            used[v] += n
    assert (used == counts).all()


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.gamma(2, 180, 50_000).astype(int), 1, 1024), minlength=1025)
    n = sum(k for _, k in P.plan(counts))
    bound = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert n <= 1.01 * bound


def brute_pieces(rows):
    from tokenizers import Tokenizer

    model, out = Tokenizer.from_file(tokens.default_vocabulary()), []
    for doc, text in rows:
        ids = [*(model.encode(text, add_special_tokens=False).ids if text else []), 2]
        at, end = 0, (len(ids) - 1) % 1024 + 1
        while at < len(ids):
            out.append((doc, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())))
            at, end = end, end + 1024
    return sorted(out, key=str)


def test_pack_against_the_library_and_the_bound(spark):
    """All documents of a table: pieces as the plain library call gives them, in few sequences."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(10**6, "a <|endoftext|> b"), (10**6 + 1, "x\n\ny  z \n"), (10**6 + 2, "long " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "3 as bucket", "4 as at")
    out = P.pack(df).collect()
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32) for r in out], key=str) == brute_pieces(rows)
    bound = -(-sum(r.length for r in out) // 1024)
    assert len({r.sequence_id for r in out}) <= 1.02 * bound


def test_pack_is_whole_and_gapless(spark):
    texts = ["", None, "a b c", "word " * 5000, "same text", "same text", "x" * 3000]
    rows = [(i, t) for i, t in enumerate(texts * 20)] + [(None, "no id"), (3, "a b c")]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    encode = tokens.encoder(tokens.default_vocabulary())
    for doc in (10, 0, None):
        ids = encode([dict(rows)[doc]])[0] + tokens.END
        got = sorted(docs[doc], key=lambda r: r.piece)
        assert [r.start for r in got] == np.cumsum([0, *(r.length for r in got)])[:-1].tolist()
        assert all(r.length == 1024 for r in got[1:])
        assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in got]
    assert len(docs[3]) == 1 + len([r for r in docs[10]])
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
