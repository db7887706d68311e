"""Operator 6: greedy word-piece counts by a linear longest-match automaton.

The vocabulary's pieces form a trie. Where the trie has no edge for the next character,
greedy longest match has settled some pieces and goes on from a shorter suffix: that
suffix is the node's failure link, and how many pieces were settled is counted when the
automaton is built. So a word's number of pieces comes from one pass over its
characters, with no piece built and nothing read twice. Pieces that begin a word and
pieces that continue one may differ: the trie has a root for either.

Defined cases: null and empty texts have no words; a word that the vocabulary cannot
cover is one unknown piece; repeated rows are counted alike; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import common

MEMO_ENTRIES = 500_000
END = "\x00"  # stands for the end of a word in vocabularies that mark it
WORD = re.compile(r"[^\W\d_]+|\d|[^\s\w]+|_+")


class Automaton:
    """``count(word)``: pieces of greedy longest match, or -1 if the word cannot be covered."""

    def __init__(self, first: Iterable[str], inner: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 continues it
        ends = [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.edges[node].get(c)
                    if nxt is None:
                        nxt = self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = nxt
                ends[node] = ends[node] or node > 1
        self.fail: list[int] = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        queue = [0, 1]
        for node in queue:  # by length: a link leads to a shorter suffix
            for c, child in self.edges[node].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.pops[child] = 1, 1
                    continue
                link, settled = self.fail[node], self.pops[node]
                while link >= 0 and c not in self.edges[link]:
                    link, settled = self.fail[link], settled + self.pops[link]
                if link >= 0:
                    self.fail[child], self.pops[child] = self.edges[link][c], settled

    def count(self, word: str) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        node, total = 0, 0
        for c in word:
            while (nxt := edges[node].get(c)) is None:
                if (link := fail[node]) < 0:
                    return -1
                total += pops[node]
                node = link
            node = nxt
        while node > 1:
            if (link := fail[node]) < 0:
                return -1
            total += pops[node]
            node = link
        return total


def marked_end_vocabulary(path: str | None = None) -> tuple[list[str], bool]:
    """Pieces of a vocabulary whose word-final pieces end in ``</w>``, in its byte alphabet."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return [p.removesuffix("</w>") + END if p.endswith("</w>") else p for p in model["model"]["vocab"] if p not in special], True


def byte_alphabet() -> dict[int, str]:
    """The usual stand-ins: visible bytes for themselves, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in visible)}


class Counter:
    """Words -> piece counts, with a bounded memo."""

    def __init__(self, path: str | None = None):
        pieces, self.marked = marked_end_vocabulary(path)
        self.automaton = Automaton(pieces, pieces)
        self.alphabet = byte_alphabet()
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        return self.automaton.count(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet) + END)

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, pieces, unknown words."""
        words = WORD.findall(text.lower()) if isinstance(text, str) else []
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {}
        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = self.word(w)
        counts = [memo[w] for w in words]
        unknown = counts.count(-1)
        return len(words), sum(counts) + 2 * unknown, unknown


_COUNTERS: dict[str | None, Counter] = {}


def piece_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_pieces, n_unknown."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(vocabulary)
        text = _COUNTERS[vocabulary].text
        for batch in common.slices(batches):
            out = pd.DataFrame([text(t) for t in batch["text"]], columns=["n_words", "n_pieces", "n_unknown"])
            out.insert(0, "doc_id", pd.array([None if x is None or x != x else int(x) for x in batch["doc_id"]], "Int64"))
            yield out

    return docs.select("doc_id", "text").mapInPandas(count, "doc_id long, n_words long, n_pieces long, n_unknown long")


def op6_piece_counts(spark, sf_dir: str) -> DataFrame:
    return piece_counts(common.table(spark, sf_dir, "documents"))
