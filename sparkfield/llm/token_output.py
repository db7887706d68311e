"""Operator 3: token ids as binary volumes with Elias-Fano document boundaries.

A volume holds the ids of a run of documents, in ascending ``doc_id`` order, as one
concatenated array. Where each document ends is an Elias-Fano code of the running
totals: about ``2 + log2(n_ids / n_docs)`` bits a document and one for the sampled select
directory, so that no table of 64-bit offsets is kept. The documents' names ascend too, so
they are coded in the same way. Reading takes both from select. The layout, little-endian:

    magic "SFTV", u32 version, u64 n_docs, u64 n_ids, u32 bytes an id,
    u64 documents without name, i64 first name, u64 last name less the first,
    code of the ends, code of the names, ids (u16 or u32 each)

where a code is: low part, high part, select samples (u32 each), and the sizes of all three
follow from the number of values, the largest one and ``SELECT_EVERY``.

Volumes are rows of a Parquet table in shared storage (``first_doc``, ``n_docs``,
``n_ids``, ``ids_before``, ``payload``), which Spark commits as a whole and which every store
that Spark writes to can hold; :func:`export` also puts them down as plain files.

Defined cases: a null or empty text is the end id alone; rows without ``doc_id`` come
first; rows with the same ``doc_id`` are in the order of the table's files and each keeps its own place;
an empty table gives no volumes; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, VERSION = b"SFTV", 2
HEAD = struct.Struct("<4sIQQIQqQ")
SELECT_EVERY = 32
VOLUME_IDS = 4_000_000  # a volume is closed at the first document that reaches this many ids


class EliasFano:
    """Ascending integers in near-minimal space, with select through a sampled directory."""

    def __init__(self, count: int, universe: int, code: memoryview = memoryview(b"")):
        """``code`` starts with that of ``count`` values from 0 to ``universe``, the last of them."""
        self.count = count
        self.low_bits = max(0, (universe // count).bit_length() - 1) if count else 0
        n_low = -(-count * self.low_bits // 8)
        n_high = (count + (universe >> self.low_bits) + 7) // 8 if count else 0
        n_samples = -(-count // SELECT_EVERY)
        self.size = n_low + n_high + 4 * n_samples
        self.low, self.high = code[:n_low], code[n_low : n_low + n_high]
        self.samples = np.frombuffer(bytes(code[n_low + n_high : self.size]), "<u4").tolist()

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> bytes:
        values, n = np.asarray(values, np.uint64), len(values)
        low_bits = cls(n, universe).low_bits
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return b"".join((np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::SELECT_EVERY].astype("<u4").tobytes()))

    def select(self, k: int) -> int:
        """The k-th value: from the sample before it, in the stretch of the high part up to the next one."""
        sample = k // SELECT_EVERY
        place = self.samples[sample]
        first = place >> 3
        last = self.samples[sample + 1] >> 3 if sample + 1 < len(self.samples) else len(self.high)
        word = int.from_bytes(self.high[first : last + 1], "little") >> (place & 7)
        for _ in range(k % SELECT_EVERY):
            word &= word - 1
        high = place + (word & -word).bit_length() - 1 - k
        if not self.low_bits:
            return high
        bit = k * self.low_bits
        low = int.from_bytes(self.low[bit >> 3 : (bit + self.low_bits + 7) >> 3], "little") >> (bit & 7)
        return high << self.low_bits | low & (1 << self.low_bits) - 1


def pack_volume(names: list[int | None], lengths: np.ndarray, ids: bytes) -> bytes:
    """A volume's bytes; ``names`` ascend, nulls first; ``ids`` are little-endian 32-bit."""
    ends = np.cumsum(lengths)
    array = np.frombuffer(ids, "<u4")
    wide = bool(len(array)) and int(array.max()) > 0xFFFF
    known = [x for x in names if x is not None]
    first, span = (known[0], known[-1] - known[0]) if known else (0, 0)
    deltas = np.array([x - first for x in known], np.uint64)
    head = HEAD.pack(MAGIC, VERSION, len(names), len(array), 4 if wide else 2, len(names) - len(known), first, span)
    return b"".join((head, EliasFano.encode(ends, len(array)), EliasFano.encode(deltas, span), ids if wide else array.astype("<u2").tobytes()))


class Volume:
    """A packed volume, read in place."""

    def __init__(self, payload: bytes):
        view = memoryview(payload)
        magic, version, n, self.n_ids, width, self.nameless, self.first, span = HEAD.unpack_from(view)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token volume")
        at = HEAD.size
        self.ends = EliasFano(n, self.n_ids, view[at:])
        at += self.ends.size
        self.names = EliasFano(n - self.nameless, span, view[at:])
        at += self.names.size
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)

    def __len__(self) -> int:
        return self.ends.count

    def start(self, k: int) -> int:
        """The ids of the volume before document k."""
        return self.ends.select(k - 1) if k else 0

    def name(self, k: int) -> int | None:
        return None if k < self.nameless else self.first + self.names.select(k - self.nameless)

    def document(self, k: int) -> np.ndarray:
        """The ids of one document: two selects."""
        return self.ids[self.start(k) : self.ends.select(k)]


def write_volumes(docs: DataFrame, vocabulary: str | None = None, volume_ids: int = VOLUME_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order; the table of written volumes."""
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.default_vocabulary()

    def volumes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(vocabulary)
        names, parts, total, before = [], [], 0, 0

        def close() -> pd.DataFrame:
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            row = {"first_doc": names[0], "n_docs": len(parts), "n_ids": total, "ids_before": before, "payload": pack_volume(names, lengths, b"".join(parts))}
            return pd.DataFrame([row])

        for batch in common.slices(batches):
            for name, ids in zip(batch["doc_id"], encode([t if isinstance(t, str) else None for t in batch["text"]])):
                names.append(None if name is None or name != name else int(name))
                parts.append(ids + tokens.END)
                total += len(parts[-1]) // 4
                if total >= volume_ids:
                    yield close()
                    names, parts, total, before = [], [], 0, before + total
        if parts:
            yield close()

    ordered = (
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
        .repartitionByRange(common.partitions(spark), F.col("doc_id").asc_nulls_first(), "place")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place")
        .select("doc_id", "text")
    )
    table = ordered.mapInPandas(volumes, "first_doc long, n_docs long, n_ids long, ids_before long, payload binary")
    table = table.withColumn("partition", F.spark_partition_id())
    return common.written(table, "volumes")


def with_starts(volumes: DataFrame) -> DataFrame:
    """``volume_start``: the ids in all volumes before.

    A volume knows the ids before it in its partition; the partitions' totals, as many rows
    as ``spark.sql.shuffle.partitions`` at most, are summed up and sent to all tasks.
    """
    totals = volumes.groupBy("partition").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("partition", F.coalesce(before, F.lit(0)).alias("part_start"))
    joined = volumes.join(F.broadcast(starts), "partition")
    return joined.withColumn("volume_start", F.col("part_start") + F.col("ids_before"))


def read_documents(volumes: DataFrame) -> DataFrame:
    """Per document, from the volumes alone: doc_id, start, n_tokens, ids_crc32."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.slices(batches):
            for before, payload in zip(batch["volume_start"], batch["payload"]):
                volume, end, rows, names = Volume(payload), 0, [], []
                ids = memoryview(volume.ids.astype("<u4", copy=False))
                for k in range(len(volume)):
                    start, end = end, volume.ends.select(k)
                    names.append(volume.name(k))
                    rows.append((start + before, end - start, tokens.crc(ids[start:end])))
                out = pd.DataFrame(rows, columns=["start", "n_tokens", "ids_crc32"])
                out.insert(0, "doc_id", pd.array(names, "Int64"))
                yield out

    return with_starts(volumes).select("volume_start", "payload").mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(volumes: DataFrame, folder: str) -> list[str]:
    """Put the volumes down as plain files in a local folder, one at a time through the driver."""
    import os

    os.makedirs(folder, exist_ok=True)
    out = []
    for k, row in enumerate(volumes.orderBy("partition", "ids_before").select("payload").toLocalIterator()):
        out.append(f"{folder}/{k:08d}.sftv")
        with open(out[-1], "wb") as f:
            f.write(row.payload)
    return out


def op3_token_volumes(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_volumes(common.table(spark, sf_dir, "documents")))
