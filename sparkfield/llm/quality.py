"""Operator 7: quality rules under weak supervision.

Each rule looks at a text and votes for it (+1), against it (-1) or abstains (0). Nobody
says how good a rule is: expectation-maximisation over the vote patterns of all
documents estimates how often each rule's votes are right, and the posterior probability
of "good" given a document's votes is its quality. Rules that look for one defect abstain
where they do not find it, as that says little about the others. A document
stays unless a hard base rule rejects it or its quality is under ``threshold``.

The corpus enters the fit as counts of vote patterns, ``3 ** len(RULES)`` at most
whatever its size; only those counts reach the driver.

Defined cases: null and empty texts have no words and fail the base rule; a repeated row
is judged like any other; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
_WIDE = bytes(range(128, 256))
_UPPER, _LETTERS = common.UPPER.encode(), (common.UPPER + common.LOWER).encode()

# Name; a value over the first bound is a vote against, one up to the second (where there is one) a vote for, else none.
RULES = (
    ("symbols_per_word", 0.10, None),
    ("repeated_lines", 0.30, None),
    ("repeated_words", 0.30, None),
    ("shouting", 0.30, None),
    ("marks_per_word", 0.50, None),
    ("clutter", 0.12, 0.06),
    ("words_not_plain", 0.30, 0.10),
    ("lines_without_stop", 0.80, None),
    ("repeated_vocabulary", 0.85, None),
    ("word_length_off", 3.50, None),
)
PSEUDO_VOTES = 10.0
MOST_TRUSTED = 0.99  # no rule counts as better than this
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TYPICAL_WORD_LENGTH = 5.0


def measure(text: str | None) -> tuple[int, int, int, int, int, str]:
    """The base counts of a text, and its votes as a string over '+', '-' and '0'."""
    if not isinstance(text, str) or not text:
        return 0, 0, 0, 0, 0, "0" * len(RULES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, "0" * len(RULES)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    repeat = 0
    if n > 3:
        pairs = ids[:-1] * len(seen) + ids[1:]
        if len(seen) >= 1 << 20:  # three ids would not fit into 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        order = np.argsort(key := pairs[:-1] * len(seen) + ids[2:], kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        repeat = int(inside.sum())
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    blank = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    wide = len(raw) - len(raw.translate(None, _WIDE))
    plain = sum(w.rstrip(".,;:!?").isalpha() for w in text.split())
    stops = sum(line.rstrip()[-1:] in b".!?:;\"')" for line in lines)
    values = (
        symbols / n,
        dup_lines / len(lines),
        repeat / n,
        upper / max(letters, 1),
        (raw.count(b"!") + raw.count(b"?") + raw.count(b",") + raw.count(b";")) / n,
        (len(raw) - wide - letters - blank) / max(chars, 1),
        1 - plain / n,
        1 - stops / len(lines),
        1 - len(seen) / n,
        abs(chars / n - TYPICAL_WORD_LENGTH),
    )
    votes = "".join("-" if v > bad else "+" if good is not None and v <= good else "0" for v, (_, bad, good) in zip(values, RULES))
    return n, chars, symbols, dup_lines, repeat, votes


def measured(text: str) -> Column:
    """The struct of the base counts and the votes of a text column."""

    def each(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([measure(t) for t in batch], columns=[*BASE, "votes"])
        common.give_back()

    return F.pandas_udf(each, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string")(text)


def base_failed() -> Column:
    words = F.col("q.n_words")
    return (words < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MAX_REPEAT_PERCENT * words)


class LabelModel:
    """Two classes; each rule has one accuracy, the chance that a vote it casts is right. Abstentions say nothing."""

    def __init__(self, prior: float, accuracy: np.ndarray):
        self.prior, self.accuracy = prior, accuracy

    @staticmethod
    def _codes(patterns: list[str]) -> np.ndarray:
        return np.array([["-0+".index(v) - 1 for v in p] for p in patterns], float).reshape(len(patterns), len(RULES))

    @classmethod
    def fit(cls, patterns: list[str], counts: np.ndarray, rounds: int = 200) -> LabelModel:
        """EM from accuracies of 0.8. Pseudo-votes and a floor say that rules are better than chance, which fixes which class is which."""
        codes, weight = cls._codes(patterns), np.asarray(counts, float)
        model = cls(0.5, np.full(len(RULES), 0.8))
        if not len(patterns):
            return model
        cast = weight @ np.abs(codes)
        good = model.posterior(patterns)
        for _ in range(rounds):
            right = weight @ (good[:, None] * (codes > 0) + (1 - good)[:, None] * (codes < 0))
            accuracy = np.clip((right + PSEUDO_VOTES * 0.8) / (cast + PSEUDO_VOTES), 0.55, MOST_TRUSTED)
            prior = float(np.clip(((weight * good).sum() + 1) / (weight.sum() + 2), 0.05, 0.95))
            model = cls(prior, accuracy)
            new, good = good, model.posterior(patterns)
            if np.abs(new - good).max() < 1e-9:
                break
        return model

    def posterior(self, patterns: list[str]) -> np.ndarray:
        if not len(patterns):
            return np.zeros(0)
        odds = np.log(self.prior / (1 - self.prior)) + self._codes(patterns) @ np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def accuracies(self) -> dict[str, float]:
        return dict(zip([name for name, *_ in RULES], self.accuracy.round(4).tolist()))


def fit(votes: DataFrame) -> tuple[LabelModel, dict[str, float]]:
    """The model, and the posterior of each pattern, from a table with a ``votes`` column."""
    rows = sorted(votes.groupBy("votes").agg(F.count("*").alias("n")).collect())  # 3 ** len(RULES) rows at most
    patterns = [r.votes for r in rows]
    model = LabelModel.fit(patterns, np.array([r.n for r in rows], float))
    return model, dict(zip(patterns, model.posterior(patterns).tolist()))


def with_verdict(df: DataFrame, posterior: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``quality`` and ``kept`` to a table with the struct ``q``."""
    spark = df.sparkSession
    table = spark.createDataFrame(sorted(posterior.items()) or [("", 0.5)], "votes string, quality double")
    out = df.join(F.broadcast(table), df["q.votes"] == table["votes"], "left").drop("votes")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, quality."""
    table = common.written(docs.select("doc_id", measured("text").alias("q")), "votes")
    _, posterior = fit(table.select("q.votes"))
    out = with_verdict(table, posterior, threshold)
    return out.select("doc_id", *[f"q.{c}" for c in BASE], "base_failed", "kept", "quality")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that stay, with their columns as they were. Texts are measured once, and written with their votes."""
    common.small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    table = common.written(docs.select(row).withColumn("q", measured("row.text")), "votes")
    _, posterior = fit(table.select("q.votes"))
    return with_verdict(table, posterior, threshold).where("kept").select("row.*")


def op7_quality_votes(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
