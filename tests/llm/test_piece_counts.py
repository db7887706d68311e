import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfield.llm import piece_counts as C


def greedy(word, first, inner):
    n, pieces = 0, first
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return -1
        word, pieces, n = word[k:], inner, n + 1
    return n


piece = st.text("abc", min_size=1, max_size=5)


@settings(max_examples=500, deadline=None)
@given(st.sets(piece, max_size=12), st.sets(piece, max_size=12), st.text("abcd", max_size=20))
def test_agrees_with_greedy_match(first, inner, word):
    assert C.Automaton(first, inner).count(word) == greedy(word, first, inner)


def test_texts(spark):
    counter = C.Counter()
    pieces = set(C.marked_end_vocabulary()[0])
    texts = ["The Fast-est tokenizers, naïve 汉字 _x 3.14", None, "", " \n", "word " * 5000, "x" * 20000, "\x00\x01"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a"), (0, texts[0])], "doc_id long, text string").selectExpr("*", "1 as n_words")
    got = C.piece_counts(df).collect()
    assert len(got) == len(texts) + 2
    alphabet = C.byte_alphabet()
    for r in got:
        if r.doc_id not in (None, 5):
            words = C.WORD.findall((texts[r.doc_id] or "").lower())
            counts = [greedy("".join(alphabet[b] for b in w.encode()) + C.END, pieces, pieces) for w in words]
            assert (r.n_words, r.n_pieces, r.n_unknown) == (len(words), sum(abs(c) for c in counts), counts.count(-1))
    assert counter.text(None) == (0, 0, 0)
    assert C.piece_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_linear_in_the_word(n):
    a = C.Automaton(["a", "a" * 50], ["a", "a" * 50])
    assert a.count("a" * n) == greedy("a" * n, {"a", "a" * 50}, {"a", "a" * 50})
