"""Whole fields: encode to a chunk table, decode all or a box of it, exchange plain streams.

A chunk is a run of neighbouring blocks of a field, coded from bit 0 of its own payload;
its row says which blocks, how many bits, and how many each block took, so that any chunk
decodes by itself. :func:`assemble` joins a field's chunks bit by bit into the one stream
that other readers of the format expect, and :func:`open_stream` cuts such a stream into
chunks again: by arithmetic where all blocks have one size, by one walk over it otherwise.
:func:`assemble_parts` and :func:`open_parts` do the same for streams too long for one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Config
from ..errors import ERROR
from ..functions import expr
from ..schema import Scalar, Shape, scalar
from . import kernels
from .blocks import AXES
from .walk import block_lengths, most_bits
from .header import Header, read_header, write_header

CHUNK_BLOCKS = 4096
CHUNKS = "chunk_id long, first_block long, n_blocks int, nbits long, block_nbits array<int>, payload binary"
BATCH_VALUES = 1 << 18  # decoded or encoded at once
VALUES_TOGETHER = 1 << 15  # of arrays coded together, as their streams are set apart by a number a bit


def _fields(schema: StructType, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in names)


def _limited(values: np.ndarray, kind: Scalar, rank: int, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """Encode in pieces that bound the coder's matrices."""
    step = max(1, BATCH_VALUES // 4**rank // 4)
    parts = [kernels.encode_blocks(values[k : k + step], kind, rank, cfg) for k in range(0, len(values), step)]
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    return np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts])


def _decoded(payload, at: np.ndarray, kind: Scalar, rank: int, cfg: Config) -> np.ndarray:
    step, bits = max(1, BATCH_VALUES // 4**rank), kernels.Bits(payload)
    parts = [kernels.decode_blocks(bits, at[k : k + step], kind, rank, cfg)[0] for k in range(0, len(at), step)]
    return np.concatenate(parts) if parts else np.zeros((0, 4**rank), kind.dtype)


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def cut_bits(stream, low: int, high: int) -> bytes:
    """Bits ``low`` to ``high`` of a buffer, moved to bit 0, with zeros up to a whole byte."""
    shift, n = low & 7, high - low
    raw = np.frombuffer(stream, np.uint8, -(-high // 8) - (low >> 3), low >> 3)
    if shift:
        out = raw >> np.uint8(shift)
        out[:-1] |= raw[1:] << np.uint8(8 - shift)
    else:
        out = raw.copy()
    out = out[: -(-n // 8)]
    if n & 7:
        out[-1] &= (1 << (n & 7)) - 1
    return out.tobytes()


class Joiner:
    """Pieces of a stream one behind the other, in whole words; of what came before, only the last word begun is kept."""

    def __init__(self, bits: int = 0, n: int = 0):
        self.head, self.word, self.n = (bits & (1 << n // 64 * 64) - 1).to_bytes(n // 64 * 8, "little"), bits >> n // 64 * 64, n % 64

    def add(self, payload, n: int) -> bytes:
        """The words that are full now that the first ``n`` bits of ``payload`` follow."""
        words = np.zeros(-(-n // 64) + 1, "<u8")
        words.view(np.uint8)[: -(-n // 8)] = np.frombuffer(payload, np.uint8)[: -(-n // 8)]
        if n % 64:
            words[n // 64] &= np.uint64((1 << n % 64) - 1)
        if self.n:
            over = words[:-1] >> np.uint64(64 - self.n)
            words <<= np.uint64(self.n)
            words[1:] |= over
            words[0] |= np.uint64(self.word)
        whole, self.n = divmod(self.n + n, 64)
        self.word, head, self.head = int(words[whole]), self.head, b""
        return head + words[:whole].tobytes()

    def close(self) -> bytes:
        return self.head + (self.word.to_bytes(8, "little") if self.n else b"")


def chunk_of(block: Column, blocks: int, chunk_blocks: int) -> Column:
    """Chunks of nearly one size: chunk i has the blocks from ``blocks * i // chunks``."""
    chunks = max(1, -(-blocks // chunk_blocks))
    return F.floor(((block + 1) * chunks - 1) / blocks).cast("bigint")


def flat_values(lists: pa.Array, size: int, dtype: str) -> np.ndarray:
    """A list column as a matrix with ``size`` columns, without a Python object a value."""
    flat = lists.flatten()
    if flat.null_count or lists.null_count or len(flat) != size * len(lists) or (len(lists) and (np.diff(lists.offsets.to_numpy()) != size).any()):
        raise ValueError(f"a block needs {size} values and no nulls")
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, size)


def encode(blocks: DataFrame, kind: str | Scalar, dims, cfg: Config, by: list[str] | None = None, chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """Block table (by.., block, vals) -> chunk table. One shuffle, on (field, chunk); the result does not depend on partitioning.

    A chunk that lacks one of its blocks, or has one twice, is refused.
    """
    kind, shape = scalar(kind), Shape.of(dims)
    by = by if by is not None else ["field_id"]
    key = [*by, "chunk_id"]
    chunks = max(1, -(-shape.blocks // chunk_blocks))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, numbers, values = None, [], []

        def chunk() -> pa.RecordBatch:
            number, c = np.concatenate(numbers), name["chunk_id"][0].as_py()
            first, stop = shape.blocks * c // chunks, shape.blocks * (c + 1) // chunks
            if len(number) != stop - first or (number != np.arange(first, stop)).any():
                raise ValueError(f"chunk {c} must have the blocks {first} to {stop - 1}, each once")
            bits, sizes = _limited(np.concatenate(values), kind, shape.rank, cfg)
            columns = {
                "chunk_id": pa.array([c], pa.int64()),
                "first_block": pa.array([first], pa.int64()),
                "n_blocks": pa.array([len(number)], pa.int32()),
                "nbits": pa.array([int(sizes.sum())], pa.int64()),
                "block_nbits": pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes.astype(np.int32))),
                "payload": pa.array([pack(bits)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict({b: name[b] for b in by} | columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = flat_values(batch.column("vals"), 4**shape.rank, kind.dtype)
            number = batch.column("block").to_numpy()
            change = np.zeros(batch.num_rows, bool)
            for c in key:
                column = batch.column(c).to_numpy(zero_copy_only=False)
                change[1:] |= column[1:] != column[:-1]
            cut = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for low, high in zip(cut, cut[1:]):
                new = {c: batch.column(c).slice(low, 1) for c in key}
                if name is not None and any(not new[c].equals(name[c]) for c in key):
                    yield chunk()
                    numbers, values = [], []
                name = new
                numbers.append(number[low:high])
                values.append(matrix[low:high])
        if numbers:
            yield chunk()

    rows = blocks.withColumn("chunk_id", chunk_of(F.col("block"), shape.blocks, chunk_blocks)).select(*key, "block", "vals")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "block")
    names = _fields(blocks.schema, by)
    return rows.mapInArrow(each, f"{names}, {CHUNKS}" if names else CHUNKS)


def decode(chunks: DataFrame, kind: str | Scalar, dims, cfg: Config, by: list[str] | None = None) -> DataFrame:
    """Chunk table -> block table. Every chunk by itself, no shuffle."""
    kind, rank = scalar(kind), Shape.of(dims).rank
    by = by if by is not None else ["field_id"]
    size = 4**rank

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, sizes_, payloads = (batch.column(c) for c in ("first_block", "block_nbits", "payload"))
            for k in range(batch.num_rows):
                sizes = sizes_[k].values.to_numpy().astype(np.int64)
                at = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
                values = _decoded(payloads[k].as_buffer(), at, kind, rank, cfg)
                n, first = len(values), firsts[k].as_py()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * n + 1, size, dtype=np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1)))
                names = {c: batch.column(c).take(pa.array(np.full(n, k))) for c in by}
                yield pa.RecordBatch.from_pydict(names | {"block": pa.array(first + np.arange(n, dtype=np.int64)), "vals": lists})

    names = _fields(chunks.schema, by)
    schema = f"block long, vals array<{kind.sql}>"
    return chunks.select(*by, "first_block", "block_nbits", "payload").mapInArrow(each, f"{names}, {schema}" if names else schema)


def decode_box(chunks: DataFrame, kind: str | Scalar, dims, cfg: Config, box: list[tuple[int, int]], by: list[str] | None = None) -> DataFrame:
    """Elements with ``low <= coordinate < high`` on each axis. Chunks without such blocks are not read."""
    from .blocks import untile

    shape = Shape.of(dims)
    first = last = 0
    for (low, high), stride in zip(box, _grid_strides(shape)):
        first, last = first + low // 4 * stride, last + (high - 1) // 4 * stride
    some = chunks.where((F.col("first_block") <= last) & (F.col("first_block") + F.col("n_blocks") > first))
    blocks = decode(some, kind, dims, cfg, by)
    for (low, high), c in zip(box, expr.block_coords(F.col("block"), list(shape.active))):
        blocks = blocks.where(c.between(low // 4, (high - 1) // 4))
    out = untile(blocks, dims, by)
    for (low, high), a in zip(box, AXES):
        out = out.where(F.col(a).between(low, high - 1))
    return out


def _grid_strides(shape: Shape) -> list[int]:
    out = [1]
    for n in shape.grid[:-1]:
        out.append(out[-1] * n)
    return out


def with_offsets(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``bit_offset``: where each chunk begins in its field's stream."""
    by = by if by is not None else ["field_id"]
    before = Window.partitionBy(*by).orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("bit_offset", F.coalesce(F.sum("nbits").over(before), F.lit(0)))


def stream_sizes(chunks: DataFrame, by: list[str] | None = None, capacity: int | None = None) -> DataFrame:
    """Bytes of each field's stream, in whole words, and an error where they exceed ``capacity``."""
    by = by if by is not None else ["field_id"]
    out = chunks.groupBy(*by).agg(F.sum("nbits").alias("nbits")).withColumn("bytes", F.ceil(F.col("nbits") / 64) * 8)
    error = F.struct(F.lit("BufferTooSmall").alias("kind"), F.col("bytes").alias("required"), F.lit(capacity).cast("bigint").alias("capacity"))
    return out.withColumn("error", F.when(F.col("bytes") > F.lit(capacity), error).cast(ERROR))


def _joined(batches: Iterator[pa.RecordBatch], by: list[str], head: int, head_bits: int) -> Iterator[tuple[dict, bool, bytes]]:
    """Of sorted chunks: name, whether the stream ends here, the next words of it."""
    name, out = None, None
    for batch in batches:
        payloads = batch.column("payload")
        for k, n in enumerate(batch.column("nbits").to_pylist()):
            new = {c: batch.column(c).slice(k, 1) for c in by}
            if name is None or any(not new[c].equals(name[c]) for c in by):
                if name is not None:
                    yield name, True, out.close()
                # A name of its own, as a slice holds its batch.
                name, out = {c: pa.array(v.to_pylist(), v.type) for c, v in new.items()}, Joiner(head, head_bits)
            yield name, False, out.add(payloads[k].as_buffer(), n)
    if name is not None:
        yield name, True, out.close()


def assemble(chunks: DataFrame, by: list[str], kind: str | Scalar, dims, cfg: Config, header: tuple[str, ...] = ()) -> DataFrame:
    """Each field's stream as other readers expect it: header, then all blocks without gaps, in whole words.

    A stream is one value, so it is as long as one value can be, and a task holds it whole;
    :func:`assemble_parts` is for longer ones.
    """
    head, head_bits = write_header(cfg, kind, dims, header) if header else (0, 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = bytearray()
        for name, done, words in _joined(batches, by, head, head_bits):
            stream += words
            if done:
                yield pa.RecordBatch.from_pydict(name | {"stream": pa.array([stream], pa.binary())})
                stream = bytearray()

    return _in_order(chunks, by).mapInArrow(each, f"{_fields(chunks.schema, by)}, stream binary")


def assemble_parts(chunks: DataFrame, by: list[str], kind: str | Scalar, dims, cfg: Config, header: tuple[str, ...] = ()) -> DataFrame:
    """The streams of :func:`assemble` in parts (by.., part, words), whole words each, to be read in the order of ``part``.

    One task a field puts them together, and holds one chunk at a time.
    """
    head, head_bits = write_header(cfg, kind, dims, header) if header else (0, 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for name, done, words in _joined(batches, by, head, head_bits):
            yield pa.RecordBatch.from_pydict(name | {"part": pa.array([part], pa.int64()), "words": pa.array([words], pa.binary())})
            part = 0 if done else part + 1

    return _in_order(chunks, by).mapInArrow(each, f"{_fields(chunks.schema, by)}, part long, words binary")


def _in_order(chunks: DataFrame, by: list[str]) -> DataFrame:
    return chunks.select(*by, "chunk_id", "nbits", "payload").repartition(*by).sortWithinPartitions(*by, "chunk_id")


def lengths_of(stream, start: int, kind: Scalar, rank: int, blocks: int, cfg: Config) -> np.ndarray:
    """Bits of each of ``blocks`` blocks of a stream from bit ``start`` on."""
    if cfg.min_bits == cfg.max_bits and cfg.block_bits(kind, rank) == cfg.max_bits:
        return np.full(blocks, cfg.max_bits, np.int64)
    return block_lengths(stream, start, kind, rank, blocks, cfg)


def walk(stream, start: int, kind: Scalar, shape: Shape, cfg: Config) -> np.ndarray:
    """Bits of each block of a stream."""
    return lengths_of(stream, start, kind, shape.rank, shape.blocks, cfg)


OPENED = pa.schema(
    [
        ("chunk_id", pa.int64()),
        ("first_block", pa.int64()),
        ("n_blocks", pa.int32()),
        ("nbits", pa.int64()),
        ("block_nbits", pa.list_(pa.int32())),
        ("payload", pa.binary()),
        ("scalar_type", pa.string()),
        ("dims", pa.list_(pa.int64())),
        ("mode_word", pa.int64()),
        ("error", pa.struct([("kind", pa.string()), ("required", pa.int64()), ("capacity", pa.int64())])),
    ]
)
OPENED_SQL = f"{CHUNKS}, scalar_type string, dims array<long>, mode_word long, error {ERROR}"


def _opened(name: dict, row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(name | {f.name: pa.array([row.get(f.name)], f.type) for f in OPENED})


def _common(head: Header, shape: Shape, config: Config) -> dict:
    word = config.mode_word()[0]
    return {"scalar_type": head.kind.name, "dims": list(head.dims), "mode_word": word - 2**64 if word >= 2**63 else word}


def open_stream(streams: DataFrame, by: list[str], kind: str | Scalar | None = None, dims=None, cfg: Config | None = None, rounding: str = "never", chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """Streams (by.., stream) -> chunk table with ``scalar_type, dims, mode_word, error``.

    Without ``kind`` the header says what the stream holds. A stream that ends early gives one
    row with an error instead of chunks, and so does a header that cannot be read.
    """

    def chunks_of(name: dict, stream) -> Iterator[pa.RecordBatch]:
        try:
            head = read_header(bytes(stream[:MOST_HEADER])) if kind is None else Header(0, scalar(kind), Shape.of(dims).active, cfg)
            shape, config = Shape.of(head.dims), head.config.with_rounding(rounding)
            common = _common(head, shape, config)
            sizes = walk(stream, head.bits, head.kind, shape, config)
        except ValueError as e:
            yield _opened(name, {"error": {"kind": type(e).__name__, "required": None, "capacity": len(stream)}})
            return
        need = -(-(head.bits + int(sizes.sum())) // 64) * 8
        if need > len(stream) // 8 * 8:
            yield _opened(name, common | {"error": {"kind": "Truncated", "required": need, "capacity": len(stream)}})
            return
        low, chunks = head.bits, max(1, -(-shape.blocks // chunk_blocks))
        for i in range(chunks):
            a, b = shape.blocks * i // chunks, shape.blocks * (i + 1) // chunks
            n = int(sizes[a:b].sum())
            yield _opened(name, common | {"chunk_id": i, "first_block": a, "n_blocks": b - a, "nbits": n, "block_nbits": sizes[a:b].astype(np.int32), "payload": cut_bits(stream, low, low + n)})
            low += n

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, stream in enumerate(batch.column("stream")):
                yield from chunks_of({c: batch.column(c).slice(k, 1) for c in by}, memoryview(stream.as_buffer()))

    return streams.select(*by, "stream").mapInArrow(each, f"{_fields(streams.schema, by)}, {OPENED_SQL}")


MOST_HEADER = 32  # bytes that a header never exceeds


class _Opening:
    """One stream that comes in parts: its chunks as soon as their words are there."""

    def __init__(self, name: dict, known: Header | None, rounding: str, chunk_blocks: int):
        self.name, self.head, self.rounding, self.chunk_blocks = name, known, rounding, chunk_blocks
        self.buffer, self.at, self.read, self.chunk, self.shape, self.failed = bytearray(), 0, 0, 0, None, False

    def more(self, words, last: bool = False) -> Iterator[pa.RecordBatch]:
        self.read += len(words)
        if self.failed:
            return
        self.buffer += words
        if self.shape is None and (last or len(self.buffer) >= MOST_HEADER):
            try:
                self.head = self.head or read_header(bytes(self.buffer[:MOST_HEADER]))
                self.shape, self.config = Shape.of(self.head.dims), self.head.config.with_rounding(self.rounding)
                self.common = _common(self.head, self.shape, self.config)
            except ValueError as e:
                self.failed = type(e).__name__
            else:
                self.at, self.chunks = self.head.bits, max(1, -(-self.shape.blocks // self.chunk_blocks))
                self.most = most_bits(self.head.kind, self.shape.rank, self.config)
        while self.shape is not None and not self.failed and self.chunk < self.chunks:
            a, b = self.shape.blocks * self.chunk // self.chunks, self.shape.blocks * (self.chunk + 1) // self.chunks
            if not last and self.at + (b - a) * self.most > 8 * len(self.buffer):
                break
            sizes = lengths_of(self.buffer, self.at, self.head.kind, self.shape.rank, b - a, self.config)
            end = self.at + int(sizes.sum())
            if -(-end // 64) * 8 > len(self.buffer) // 8 * 8:
                self.failed, self.need = "Truncated", self.read - len(self.buffer) + -(-end // 64) * 8
                break
            yield _opened(self.name, self.common | {"chunk_id": self.chunk, "first_block": a, "n_blocks": b - a, "nbits": end - self.at, "block_nbits": sizes.astype(np.int32), "payload": cut_bits(bytes(self.buffer[self.at // 8 : -(-end // 8)]), self.at % 8, end - self.at // 8 * 8)})
            self.chunk += 1
            gone = end // 64 * 8
            del self.buffer[:gone]
            self.at = end - 8 * gone
        if self.shape is not None and not self.failed and self.chunk == self.chunks:
            self.buffer.clear()
        if last and self.failed:
            error = {"kind": self.failed, "required": self.need if self.failed == "Truncated" else None, "capacity": self.read}
            yield _opened(self.name, (self.common if self.failed == "Truncated" else {}) | {"error": error})


def open_parts(parts: DataFrame, by: list[str], kind: str | Scalar | None = None, dims=None, cfg: Config | None = None, rounding: str = "never", chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """Streams in parts (by.., part, words) -> the chunk table of :func:`open_stream`, spread over tasks again.

    One task a field walks its stream, and holds the parts of one chunk at a time. So the chunks
    before the place where a stream ends early are there, beside the row with the error, whose
    ``required`` goes up to the end of the first chunk that is not whole.
    """
    known = None if kind is None else Header(0, scalar(kind), Shape.of(dims).active, cfg)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = None
        for batch in batches:
            for k, words in enumerate(batch.column("words")):
                new = {c: batch.column(c).slice(k, 1) for c in by}
                if opening is None or any(not new[c].equals(opening.name[c]) for c in by):
                    if opening is not None:
                        yield from opening.more(b"", last=True)
                    opening = _Opening({c: pa.array(v.to_pylist(), v.type) for c, v in new.items()}, known, rounding, chunk_blocks)
                yield from opening.more(memoryview(words.as_buffer()))
        if opening is not None:
            yield from opening.more(b"", last=True)

    rows = parts.select(*by, "part", "words").repartition(*by).sortWithinPartitions(*by, "part").drop("part")
    return rows.mapInArrow(each, f"{_fields(parts.schema, by)}, {OPENED_SQL}").repartition(*by, "chunk_id")


# ---- arrays: a field a row


def encode_values(values: np.ndarray, kind: Scalar, dims: tuple[int, ...], cfg: Config) -> bytes:
    shape = Shape.of(dims)
    bits, _ = _limited(kernels.gather(np.asarray(values, kind.dtype), shape.active, 0, shape.blocks), kind, shape.rank, cfg)
    data = pack(bits)
    return data + bytes(-len(data) % 8)


ROWS_TOGETHER = 32  # from so many arrays on, their blocks are decoded step by step together
_PLACES = np.stack([kernels.padded_source(n) for n in range(1, 5)])


def packed_apart(bits: np.ndarray, used: np.ndarray, unit: int) -> list[bytes]:
    """The bits of rows one behind the other, ``used`` of each, as bytes of their own in whole ``unit``s of bits."""
    whole = -(-used // unit) * unit
    begin = np.cumsum(whole) - whole
    spread = np.zeros(int(whole.sum()), np.uint8)
    spread[np.arange(len(bits)) + np.repeat(begin - (np.cumsum(used) - used), used)] = bits
    data = pack(spread)
    return [data[a // 8 : (a + w) // 8] for a, w in zip(begin.tolist(), whole.tolist())]


def encode_runs(flat: np.ndarray, offsets: np.ndarray, kind: Scalar, cfg: Config) -> list[bytes]:
    """A 1-D stream of each run between ``offsets``; blocks of many runs are coded together, within a bound."""
    out: list[bytes] = []
    k, rows = 0, len(offsets) - 1
    while k < rows:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + VALUES_TOGETHER, "right")) - 1)
        starts, lengths = offsets[k:stop], np.diff(offsets[k : stop + 1])
        if stop == k + 1 or not lengths.all():
            out += [encode_values(flat[a : a + n], kind, (n,), cfg) for a, n in zip(starts.tolist(), lengths.tolist())]
        else:
            blocks = -(-lengths // 4)
            first = np.cumsum(blocks) - blocks
            inner = 4 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
            places = _PLACES[np.minimum(np.repeat(lengths, blocks) - inner, 4) - 1]
            bits, sizes = _limited(flat[(np.repeat(starts, blocks) + inner)[:, None] + places].astype(kind.dtype, copy=False), kind, 1, cfg)
            out += packed_apart(bits, np.add.reduceat(sizes, first), 64)
        k = stop
    return out


def encode_rows(matrix: np.ndarray, kind: Scalar, cfg: Config) -> list[bytes]:
    """A 1-D stream of each row."""
    rows, n = matrix.shape
    return encode_runs(matrix.reshape(-1), np.arange(rows + 1) * n, kind, cfg)


def decode_apart(payloads: list, kind: Scalar, rank: int, cfg: Config) -> np.ndarray:
    """The block that each payload begins with."""
    sizes = 8 * np.array([len(p) for p in payloads], np.int64)
    values, used = kernels.decode_blocks(kernels.Bits(b"".join(payloads)), np.cumsum(sizes) - sizes, kind, rank, cfg)
    for k in np.flatnonzero(used > sizes).tolist():  # beyond a payload's end are zeros, not the next one
        values[k] = kernels.decode_blocks(kernels.Bits(payloads[k]), np.array([0]), kind, rank, cfg)[0][0]
    return values


def decode_runs(streams: list, lengths: np.ndarray, kind: Scalar, cfg: Config) -> np.ndarray:
    """The values of 1-D streams one behind the other. Blocks of many streams are decoded together, of a few long ones each by itself."""
    blocks = -(-lengths // 4)
    most = int(np.sort(blocks)[-ROWS_TOGETHER]) if len(blocks) >= ROWS_TOGETHER and lengths.min() > 0 else 0
    begin = np.cumsum(lengths) - lengths
    out = np.zeros(max(int(lengths.sum()), 0), kind.dtype)
    alone = np.flatnonzero((blocks > most) | (blocks <= 0)).tolist()
    order = np.argsort(-blocks, kind="stable")
    order = order[blocks[order] <= most] if most else order[:0]
    sizes = 8 * np.array([len(streams[k]) for k in order.tolist()], np.int64)
    base, bits = np.cumsum(sizes) - sizes, kernels.Bits(b"".join([streams[k] for k in order.tolist()]))
    at = base.copy()
    for step in range(most):
        live = int(np.searchsorted(-blocks[order], -step))
        values, used = kernels.decode_blocks(bits, at[:live], kind, 1, cfg)
        at[:live] += used
        places = (begin[order[:live]] + 4 * step)[:, None] + np.arange(4)
        inside = np.arange(4) < (lengths[order[:live]] - 4 * step)[:, None]
        out[places[inside]] = values[inside]
    # Beyond a stream's end are zeros, not the next one.
    for k in alone + order[at - base > sizes].tolist():
        out[begin[k] : begin[k] + max(int(lengths[k]), 0)] = decode_values(streams[k], kind, (int(lengths[k]),), cfg)
    return out


def decode_values(stream: bytes, kind: Scalar, dims: tuple[int, ...], cfg: Config) -> np.ndarray:
    shape = Shape.of(dims)
    sizes = walk(stream, 0, kind, shape, cfg)
    out = np.zeros(shape.elements, kind.dtype)
    kernels.scatter(_decoded(stream, np.concatenate(([0], np.cumsum(sizes)[:-1])), kind, shape.rank, cfg), shape.active, 0, out)
    return out


def encode_arrays(column: str | Column, kind: str | Scalar, cfg: Config) -> Column:
    """A 1-D array column as streams, without a shuffle. Null and empty arrays give null."""
    kind = scalar(kind)

    def each(arrays: pd.Series) -> pd.Series:
        out: list = [None] * len(arrays)
        lengths = np.array([0 if a is None else len(a) for a in arrays])
        for n in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            for i, stream in zip(rows, encode_rows(np.stack(arrays.iloc[rows].to_list()), kind, cfg)):
                out[i] = stream
        return pd.Series(out)

    return F.pandas_udf(each, "binary")(column)


def decode_arrays(stream: str | Column, length: str | Column, kind: str | Scalar, cfg: Config) -> Column:
    """The arrays again; all rows' blocks of one call step together where all have one length."""
    kind = scalar(kind)

    def each(streams: pd.Series, lengths: pd.Series) -> pd.Series:
        out: list = [None] * len(streams)
        rows = [i for i, (s, n) in enumerate(zip(streams, lengths)) if s is not None and n == n and n]
        at = {i: 0 for i in rows}
        base = dict(zip(rows, 8 * np.concatenate(([0], np.cumsum([len(streams.iloc[i]) for i in rows])[:-1])).astype(np.int64))) if rows else {}
        flat = kernels.Bits(b"".join(streams.iloc[i] for i in rows))
        parts: dict[int, list] = {i: [] for i in rows}
        live = list(rows)
        while live:
            starts = np.array([base[i] + at[i] for i in live])
            values, used = kernels.decode_blocks(flat, starts, kind, 1, cfg)
            for i, v, n in zip(live, values, used.tolist()):
                parts[i].append(v)
                at[i] += n
            live = [i for i in live if 4 * len(parts[i]) < lengths.iloc[i]]
        for i in rows:
            out[i] = np.concatenate(parts[i])[: int(lengths.iloc[i])]
        return pd.Series(out)

    return F.pandas_udf(each, f"array<{kind.sql}>")(stream, length)
