"""Operator 1: repeated byte strings, by run-compressed Burrows-Wheeler indexes.

Every byte that is covered by a string of ``LENGTH`` bytes which also starts anywhere else
in the corpus is removed. Each window of that length picks its smallest-hashed gram of
``GRAM`` bytes as its anchor; equal windows pick the same one, so only segments (the
windows of one anchor) with equal anchors need to be compared:

1. Anchors are counted. One that occurs once has no repeats. Where all its segments are
   equal, they are copies, and repeated throughout; they are kept as one.
2. The distinct segments of the other anchors are indexed, many anchors to an index: the
   suffix array gives the Burrows-Wheeler transform, of which only runs are kept, with
   the text positions at both ends of each run and the common prefixes there. Streaming
   over the text from those samples gives each position's matching statistic, the longest
   string from there that occurs elsewhere, as inside a run it falls by one a step.
   Positions with LENGTH or more start repeats.
3. Texts that occur twice as a whole are marked from their hashes.

An anchor with more than ``GROUP_BYTES`` of distinct segments is not held in one task:
its windows are counted by hash instead, which spreads over all tasks.

Defined cases: a null text is empty; a text shorter than LENGTH repeats nothing; a repeated
row repeats its whole text; rows without doc_id and ties are judged each by its text;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 200
GRAM = 48
INDEX_BYTES = 1_000_000  # of segments in one index, unless a single anchor has more
GROUP_BYTES = 6_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ---- anchors


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes, by doubling."""
    done, width, at = None, 1, 0
    h = raw.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if gram & width:
                # ``at`` bytes are in ``done``; the next ``width`` follow them.
                part = h[at:]
                done = part if done is None else (done[: len(part)] * _MIX[(at + width) % 3] + part[: len(done)]) * _MIX[0]
                at += width
            if at == gram:
                break
            h = (h[:-width] * _MIX[1] + h[width:]) * _MIX[2]
            h ^= h >> np.uint64(32)
            width *= 2
        done = done[: max(0, len(raw) - gram + 1)]
        done = (done ^ (done >> np.uint64(31))) * _MIX[1]
        return done ^ (done >> np.uint64(29))


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor of a text of at least ``length`` bytes."""
    hashes = gram_hashes(raw, gram)
    width = length - gram + 1
    low = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(place[1:] != place[:-1])
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(place) - 1]))
    return hashes[place[first]].view(np.int64), first, last


# ---- the index


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of segments laid end to end, each closed by a zero byte at ``ends``; the closing bytes are told apart by their order."""
    n = len(text)
    segment = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([-1], ends))))
    end = ends[segment]
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    at = np.arange(n)
    for k in range(8):
        inside &= at + k <= end
        key = (key << np.uint64(8)) | np.where(inside, padded[k : n + k], np.uint64(0))
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    k, classes = 8, int(new.sum())
    longest = int(np.diff(np.concatenate(([-1], ends))).max()) if n else 0
    while classes < n and k < 2 * longest:
        beyond = at + k > end
        follow = np.where(beyond, segment, rank[np.minimum(at + k, n - 1)] + len(ends))
        both = rank * (n + len(ends) + 1) + follow
        order = np.argsort(both, kind="stable")
        new = np.concatenate(([True], both[order][1:] != both[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        k, classes = 2 * k, int(new.sum())
    return order


class RunIndex:
    """The run-length transform: a byte and a length a run, sampled at both ends.

    :meth:`rank`, :meth:`step` and :meth:`count` work on the runs alone. ``heads`` and ``tails`` are the text positions of the suffixes at the first and last
    place of each run, with the length of the common prefix with the suffix before
    (after) them. Positions right after a segment's start always are samples.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        order = suffix_array(text, ends)
        n = len(text)
        closing = np.zeros(n, bool)
        closing[ends] = True
        before = text[order - 1].astype(np.int16)
        unique = (order == 0) | closing[order - 1]
        change = np.concatenate(([True], (before[1:] != before[:-1]) | unique[1:] | unique[:-1], [True]))
        self.size, self.runs = n, int(change[:-1].sum())
        head, tail = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])
        self.run_starts, self.run_bytes, self.run_lengths = head, np.where(unique[head], -1, before[head]), tail - head + 1
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=256))))  # suffixes that start with a smaller byte
        self._runs_of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.heads = order[head], self._common(text, ends, order, head, head - 1)
        self.tails = order[tail], self._common(text, ends, order, tail, tail + 1)

    @staticmethod
    def _common(text: np.ndarray, ends: np.ndarray, order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at places a and b of the order (0 off its ends)."""
        out = np.zeros(len(a), np.int64)
        some = np.flatnonzero((b >= 0) & (b < len(order)))
        p, q = order[a[some]], order[b[some]]
        room = np.minimum(ends[np.searchsorted(ends, p)] - p, ends[np.searchsorted(ends, q)] - q)
        step = 16
        padded = np.concatenate((text, np.zeros(step, np.uint8)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, step)
        while len(some):
            differ = windows[p] != windows[q]
            any_differ = differ.any(axis=1)
            gain = np.where(any_differ, differ.argmax(axis=1), step)
            gain = np.minimum(gain, room)
            out[some] += gain
            room = room - gain
            go = (gain == step) & (room > 0)
            some, p, q, room = some[go], p[go] + step, q[go] + step, room[go]
        return out

    def rank(self, byte: int, place: int) -> int:
        """How often ``byte`` stands in the transform before ``place``."""
        if byte not in self._runs_of:
            own = self.run_bytes == byte
            lengths = self.run_lengths[own]
            self._runs_of[byte] = self.run_starts[own], lengths, np.cumsum(lengths) - lengths
        starts, lengths, before = self._runs_of[byte]
        k = int(np.searchsorted(starts, place, side="right")) - 1
        return 0 if k < 0 else int(before[k] + min(place - starts[k], lengths[k]))

    def step(self, byte: int, low: int, high: int) -> tuple[int, int]:
        """From the places of the suffixes that start with a string to those that start with ``byte`` and the string."""
        return int(self.below[byte]) + self.rank(byte, low), int(self.below[byte]) + self.rank(byte, high)

    def count(self, pattern: bytes) -> int:
        """How often a pattern without zero bytes occurs in the segments."""
        low, high = 0, self.size
        for byte in reversed(pattern):
            low, high = self.step(byte, low, high)
            if low >= high:
                return 0
        return high - low

    def _stream(self, samples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        place, value = samples
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        at = np.arange(self.size)
        last = np.searchsorted(place, at, side="right") - 1
        return value[last] - (at - place[last])

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of the longest string from there that occurs elsewhere in the text."""
        return np.maximum(self._stream(self.heads), self._stream(self.tails))


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct segments, the places at which a string of ``length`` bytes starts that is elsewhere too."""
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    ends = np.cumsum(sizes) - 1
    text = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8)
    long = np.flatnonzero(RunIndex(text, ends).matching_statistics() >= length)
    starts = ends - sizes + 1
    of = np.searchsorted(ends, long)
    cut = np.searchsorted(of, np.arange(len(segments) + 1))
    return [long[cut[i] : cut[i + 1]] - starts[i] for i in range(len(segments))]


def as_runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ascending numbers as runs (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.concatenate((cut, [len(starts) - 1]))].tolist()))


# ---- the corpus


TEXT = ["t1", "t2"]


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), F.col("text"))})


def segments_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Per distinct text: t1, t2, and arrays over its segments: h (anchor), s (content), first and last window."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        seen: set[tuple[int, int]] = set()
        for batch in common.slices(batches):
            rows = []
            for text, *name in zip(batch["text"], batch["t1"], batch["t2"]):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length or tuple(name) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(tuple(name))
                h, first, last = anchors(np.frombuffer(raw, np.uint8), length, gram)
                view = memoryview(raw)
                s = np.array([xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64)
                rows.append((*name, h, s, first.astype(np.int32), last.astype(np.int32)))
            yield pd.DataFrame(rows, columns=[*TEXT, "h", "s", "first", "last"])

    made = docs.select("text", *TEXT).where(F.octet_length("text") >= length)
    made = made.mapInPandas(each, "t1 long, t2 long, h array<long>, s array<long>, first array<int>, last array<int>")
    return made.dropDuplicates(TEXT)


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the ``wanted`` segments (t1, t2, h, s, first, last)."""
    parts = wanted.groupBy(*TEXT).agg(F.collect_list(F.struct("h", "s", "first", "last")).alias("parts"))  # of one text

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for batch in common.slices(batches):
            rows = []
            for text, parts, *name in zip(batch["text"], batch["parts"], batch["t1"], batch["t2"]):
                if tuple(name) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(tuple(name))
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(p["h"], p["s"], raw[p["first"] : p["last"] + length]) for p in parts]
            yield pd.DataFrame(rows, columns=["h", "s", "bytes"])

    joined = docs.select("text", *TEXT).join(parts, TEXT)
    return joined.mapInPandas(each, "h long, s long, bytes binary").dropDuplicates(["h", "s"])


def _indexed(segments: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """(h, s, runs) of the repeated window starts of segments that come in whole anchors."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, parts, size, anchor = [], [], 0, None

        def found() -> pd.DataFrame:
            rows = [(*n, [{"a": a, "b": b} for a, b in as_runs(x)]) for n, x in zip(names, repeated_starts(parts, length)) if len(x)]
            return pd.DataFrame(rows, columns=["h", "s", "runs"])

        for batch in common.slices(batches):
            for h, s, raw in zip(batch["h"], batch["s"], batch["bytes"]):
                if h != anchor and size >= index_bytes:
                    yield found()
                    names, parts, size = [], [], 0
                anchor = h
                names.append((h, s))
                parts.append(raw)
                size += len(raw)
        if parts:
            yield found()

    spread = segments.repartition(common.partitions(segments.sparkSession), "h").sortWithinPartitions("h")
    return spread.mapInPandas(each, "h long, s long, runs array<struct<a:int,b:int>>")


def _counted(segments: DataFrame, length: int) -> DataFrame:
    """The same by counting the hashes of all windows."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in common.slices(batches):
            for h, s, raw in zip(batch["h"], batch["s"], batch["bytes"]):
                n = len(raw) - length + 1
                yield pd.DataFrame({"h": h, "s": s, "at": range(n), "w": [xxh3_128_digest(raw[k : k + length]) for k in range(n)]})

    table = common.written(segments.mapInPandas(windows, "h long, s long, at int, w binary"), "windows")
    twice = table.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    hits = table.join(twice, "w", "left_semi")
    return hits.groupBy("h", "s").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("b")))).alias("runs"))


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(t1, t2, marks) of distinct texts: runs of window starts that are repeated, from ``_identified`` docs."""
    table = common.written(segments_of(docs, length, gram), "segments")
    rows = table.select(*TEXT, F.explode(F.arrays_zip("h", "s", "first", "last")).alias("x")).select(*TEXT, "x.*")
    counts = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).where("n > 1")
    # Written, so that it is an exchange of its own in the join, whose hot anchors Spark then splits.
    counts = common.written(counts.select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "counts")
    again = common.written(rows.join(counts, "h"), "recurring")
    common.release(table)
    common.release(counts)
    mixed = again.where("mixed")
    one = F.min(F.struct(*TEXT, "first", "last")).alias("x")
    distinct = mixed.groupBy("h", "s").agg(F.count("*").alias("n"), one).select("h", "s", "n", "x.*")
    distinct = common.written(distinct, "distinct")
    whole = distinct.where("n > 1").select("h", "s", F.array(F.struct(F.lit(0).alias("a"), (F.col("last") - F.col("first")).alias("b"))).alias("runs"))
    bytes_of = common.written(_fetched(docs, distinct.select(*TEXT, "h", "s", "first", "last"), length), "bytes")
    load = bytes_of.groupBy("h").agg(F.sum(F.length("bytes")).alias("load")).where(F.col("load") > group_bytes).select("h")
    hot = common.written(load, "hot")
    found = _indexed(bytes_of.join(hot, "h", "left_anti"), length, index_bytes).unionByName(_counted(bytes_of.join(hot, "h", "left_semi"), length))
    single = distinct.where("n = 1").select("h", "s")
    found = common.written(found.join(single, ["h", "s"], "left_semi").unionByName(whole), "found")
    first, last = F.col("first"), F.col("last")
    places = again.where("NOT mixed").select(*TEXT, F.array(F.struct(first.alias("a"), last.alias("b"))).alias("runs"))
    moved = F.transform("runs", lambda r: F.struct((r["a"] + first).alias("a"), (r["b"] + first).alias("b")))
    places = places.unionByName(mixed.join(found, ["h", "s"]).select(*TEXT, moved.alias("runs")))
    out = common.written(places.groupBy(*TEXT).agg(F.flatten(F.collect_list("runs")).alias("marks")), "marks")  # of one text
    for t in (again, distinct, bytes_of, found):
        common.release(t)
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Per row: doc_id, kept (bytes), n_bytes, n_removed, n_spans."""
    rows = _identified(docs)
    copies = rows.groupBy(*TEXT).agg(F.count("*").alias("n")).where("n > 1").select(*TEXT, F.lit(True).alias("copied"))
    found = marks(rows, length, **options).join(copies, TEXT, "full")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.slices(batches):
            out = []
            for text, runs, copied in zip(batch["text"], batch["marks"], batch["copied"]):
                raw = text.encode("utf-8", "surrogatepass")
                n = len(raw)
                if copied is True and n >= length:
                    out.append((b"", n, n, 1))
                elif runs is None or not len(runs):
                    out.append((raw, n, 0, 0))
                else:
                    kept, at, removed, spans = [], 0, 0, 0
                    for a, b in sorted((r["a"], r["b"] + length) for r in runs):
                        if not spans or a > at:
                            kept.append(raw[at:a])
                            spans += 1
                            removed += b - a
                            at = b
                        elif b > at:
                            removed += b - at
                            at = b
                    kept.append(raw[at:])
                    out.append((b"".join(kept), n, removed, spans))
            frame = pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])
            frame.insert(0, "doc_id", pd.array([None if x is None or x != x else int(x) for x in batch["doc_id"]], "Int64"))
            yield frame

    joined = rows.join(found, TEXT, "left").select("doc_id", "text", "marks", F.coalesce("copied", F.lit(False)).alias("copied"))
    return joined.mapInPandas(each, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op1_run_length_index(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
