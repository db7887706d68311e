"""Operator 8: pattern packing by non-negative least squares.

The number of pieces of each length is a histogram with as many bins as the capacity has
tokens, whatever the corpus. On it alone the driver plans the sequences:

1. enumerate patterns of few pieces (one to three lengths) that fill a sequence exactly
   or nearly so;
2. fit repeat counts to the histogram by non-negative least squares;
3. round them down and take what they use off the histogram;
4. pack the rest, longest first, each into the fullest sequence that has room (best fit),
   on counts of equal sequences, not on single pieces.

The plan gives, for each length, intervals of ranks and where they go. Pieces get their
rank among the pieces of their length in two levels (within a bucket, plus the counts of
the buckets before), so that no task holds a length's pieces, however frequent it is.

Defined cases: a null or empty text is the end id alone; a repeated row is a document of
its own; an empty table packs to nothing; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 1024
MAX_PATTERNS = 20_000  # enumerated
SLACK = 2  # tokens that an enumerated pattern may leave free


# ---- the plan: histogram -> groups of equal sequences


def enumerate_patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths (0: none), each filling ``capacity`` up to SLACK, frequent lengths first."""
    lengths = np.flatnonzero(counts)
    lengths = lengths[np.argsort(-counts[lengths], kind="stable")]
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    found: list[tuple[int, int, int]] = [(int(x), 0, 0) for x in lengths if x >= capacity - SLACK]
    for x in lengths.tolist():
        for total in range(capacity, capacity - SLACK - 1, -1):
            if 0 < (y := total - x) <= x and have[y]:
                found.append((x, y, 0))
    room = MAX_PATTERNS - len(found)
    for i, x in enumerate(lengths.tolist()):
        if room <= 0:
            break
        y = lengths[i:]
        z = capacity - x - y
        good = (z > 0) & (z <= y)
        good[good] = have[z[good]]
        take = min(room, int(good.sum()))
        found += [tuple(sorted((x, int(b), int(c)), reverse=True)) for b, c in zip(y[good][:take], z[good][:take])]
        room -= take
    return np.array(sorted(set(found)), np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring patterns near the histogram: least squares by accelerated projected gradient."""
    if not len(patterns):
        return np.zeros(0)
    target = counts.astype(float)
    scale = max(target.max(), 1.0)
    used = patterns > 0

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns[used], np.broadcast_to(x[:, None], patterns.shape)[used], len(counts))

    def backward(r: np.ndarray) -> np.ndarray:
        return np.where(used, r[patterns], 0.0).sum(axis=1)

    # The largest eigenvalue is at most the largest column sum of |A|'|A|.
    step = 1.0 / max(backward(forward(np.ones(len(patterns)))).max(), 1.0)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * backward(forward(y) - target / scale))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), covering the histogram exactly."""
    left = np.asarray(counts, np.int64).copy()
    groups: list[tuple[tuple[int, ...], int]] = []
    patterns = enumerate_patterns(left, capacity)
    repeats = np.floor(fit_counts(patterns, left) + 1e-6).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        pattern = tuple(int(v) for v in patterns[k] if v)
        need = defaultdict(int)
        for v in pattern:
            need[v] += 1
        n = min([int(repeats[k]), *(int(left[v]) // c for v, c in need.items())])
        if n > 0:
            groups.append((pattern, n))
            for v, c in need.items():
                left[v] -= c * n
    # The rest by best fit, longest first, on groups of equal open sequences.
    open_at: list[list[list]] = [[] for _ in range(capacity + 1)]  # by free tokens: [lengths, number]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            free = next((f for f in range(length, capacity) if open_at[f]), capacity)
            if free == capacity:
                per = max(1, min(n, capacity // length))
                base, number = (), n // per
            else:
                base, number = open_at[free].pop()
                per = max(1, min(free // length, n))
                if number * per > n:
                    keep = number - max(1, n // per)
                    number -= keep
                    open_at[free].append([base, keep])
            put = (*base, *(length,) * per)
            open_at[free - per * length].append([put, number])
            n -= per * number
    groups += [(tuple(g), n) for at in open_at for g, n in at if n]
    return groups


def assignment(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank of an interval, its first sequence id, offset within the sequence), by rank."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    first = 0
    for lengths, n in groups:
        offset = 0
        for v in lengths:
            out[v].append((ranks[v], first, offset))
            ranks[v] += n
            offset += v
        first += n
    return {v: tuple(np.array(c, np.int64) for c in zip(*rows)) for v, rows in out.items()}


# ---- the data: pieces, ranks, places


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, memo_entries: int = tokens.MEMO_ENTRIES, forget: bool = False) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32. With ``forget`` a task's end drops its encoder."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(vocabulary, memo_entries)
        for batch in common.slices(batches):
            names, rows = [], []
            for name, ids in zip(batch["doc_id"], encode([t if isinstance(t, str) else None for t in batch["text"]])):
                ids += tokens.END
                n, start, piece = len(ids) // 4, 0, 0
                end = (n - 1) % capacity + 1
                while start < n:
                    names.append(None if name is None or name != name else int(name))
                    rows.append((piece, start, end - start, tokens.crc(ids[4 * start : 4 * end])))
                    start, end, piece = end, end + capacity, piece + 1
            if rows:
                out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
                out.insert(0, "doc_id", pd.array(names, "Int64"))
                yield out
        if forget:
            del encode
            tokens.forget()

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, memo_entries: int = tokens.MEMO_ENTRIES, forget: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    buckets = 4 * common.partitions(spark)
    table = pieces(docs, vocabulary, capacity, memo_entries, forget)
    table = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    table = common.written(table, "pieces")
    counts = table.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in table.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        histogram[row.length] = row.n
    places = spark.sparkContext.broadcast(assignment(plan(histogram, capacity)))  # bounded by the capacity, not by the corpus

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for v in np.unique(lengths):
            rows = np.flatnonzero(lengths == v)
            first_rank, first_sequence, at = places.value[int(v)]
            k = np.searchsorted(first_rank, ranks[rows], side="right") - 1
            sequence[rows], offset[rows] = first_sequence[k] + ranks[rows] - first_rank[k], at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = table.withColumn("inside", F.row_number().over(inside) - 1).join(counts, ["bucket", "length"])
    ranked = ranked.withColumn("at", placed("length", F.col("rank_before") + F.col("inside")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op8_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
