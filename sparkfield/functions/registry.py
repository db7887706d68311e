"""The SQL surface: functions to use in any query after :func:`register`."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import BlockLength, InsufficientData
from ..operators import codec, kernels
from ..operators.header import header_bytes, read_header
from ..schema import SCALARS, Shape, scalar
from . import bits
from .expr import PROMOTED

HEADER = "struct<bits:int,scalar_type:string,dims:array<bigint>,min_bits:int,max_bits:int,max_prec:int,min_exp:int,error:string>"


ROWS = 2048  # coded in one call


def _config(a, b, c, e) -> Config:
    return Config(int(a), int(b), int(c), int(e))


def _each(f, returns: str):
    """A vectorised function of several columns, a call a row; null in, null out."""

    def rows(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in r) else f(*r) for r in zip(*columns)])

    return F.pandas_udf(rows, returns)


def _together(f, data: tuple[int, ...], returns: str, to: pa.DataType, sized: bool = False):
    """A function of Arrow columns: rows with the same parameters, all columns but ``data``, are one call, up to ``ROWS`` of them.

    Where ``sized``, so are only rows whose lists among the data have one length. Null in, null out.
    """

    def rows(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        there = np.ones(n, bool)
        for c in columns:
            there &= c.is_valid().to_numpy(zero_copy_only=False)
        keys = [[tuple(v) if isinstance(v, list) else v for v in c.to_pylist()] for k, c in enumerate(columns) if k not in data]
        lists = [pc.list_value_length(columns[k]).to_pylist() for k in data if sized and pa.types.is_list(columns[k].type)]
        groups: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(range(n), *lists, *keys)):
            if there[k]:
                groups.setdefault(key[1:], []).append(k)
        order, parts = [], []
        for key, places in groups.items():
            for k in range(0, len(places), ROWS):
                some = pa.array(places[k : k + ROWS], pa.int64())
                parts.append(f(*[columns[c].take(some) for c in data], *key[len(lists) :]))
            order += places
        if not parts:
            return pa.nulls(n, to)
        out = pa.concat_arrays(parts)
        if order == list(range(n)):
            return out
        index = np.full(n, -1)
        index[order] = np.arange(len(order))
        return out.take(pa.array(index, mask=index < 0))

    return F.arrow_udf(rows, returns)


def _numbers(lists: pa.Array, kind: str) -> np.ndarray:
    flat = lists.flatten()
    if flat.null_count and not scalar(kind).is_float:
        raise ValueError("integers of a block or field must not be null")
    return flat.to_numpy(zero_copy_only=False).astype(scalar(kind).dtype, copy=False)


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))


def _matrix_lists(matrix: np.ndarray) -> pa.Array:
    return _lists(np.ascontiguousarray(matrix).reshape(-1), np.full(len(matrix), matrix.shape[1]))


def _coded(values: np.ndarray, kind: str, rank: int, cfg: Config) -> pa.Array:
    """Blocks as payloads of their own."""
    step = max(1, codec.VALUES_TOGETHER // 4**rank)
    pieces = [kernels.encode_blocks(values[k : k + step], kind, rank, cfg) for k in range(0, len(values), step)]
    return pa.array([p for bits, sizes in pieces for p in codec.packed_apart(bits, sizes, 8)], pa.binary())


def encode_block(vals: pa.Array, kind: str, a, b, c, e) -> pa.Array:
    size = len(vals[0])
    rank = {4: 1, 16: 2, 64: 3, 256: 4}.get(size)
    if rank is None:
        raise BlockLength(f"{size} values")
    return _coded(_numbers(vals, kind).reshape(-1, size), kind, rank, _config(a, b, c, e))


def _exact_as_doubles(values: np.ndarray) -> np.ndarray:
    """As doubles, which do not hold all 64-bit integers."""
    out = values.astype(float)
    if values.dtype.kind == "i" and (np.abs(out) > 2.0**53).any():
        raise ValueError("integers over 2 ** 53 are not all doubles: use the function of their type, like field_decode_i64")
    return out


def decode_block(payloads: pa.Array, kind: str, rank, a, b, c, e) -> pa.Array:
    return _matrix_lists(_exact_as_doubles(_decoded_blocks(payloads, kind, rank, _config(a, b, c, e))))


def _decoded_blocks(payloads: pa.Array, kind: str, rank, cfg: Config) -> np.ndarray:
    return codec.decode_apart(payloads.to_pylist(), scalar(kind), int(rank), cfg)


def decode_block_as(kind: str):
    def of_kind(payloads: pa.Array, rank, a, b, c, e) -> pa.Array:
        return _matrix_lists(_decoded_blocks(payloads, kind, rank, _config(a, b, c, e)))

    return of_kind


def _reach(size: int, start, lengths, strides) -> tuple[int, np.ndarray, np.ndarray]:
    """The rank of a block in a strided buffer, the places that its padded values come from, and which are not padding."""
    lengths, strides = [int(n) for n in lengths], [int(s) for s in strides]
    if not 1 <= len(lengths) <= 4 or len(strides) != len(lengths) or not all(1 <= n <= 4 for n in lengths):
        raise BlockLength(f"lengths {lengths} and strides {strides}: one to four of each, lengths from 1 to 4")
    at, inside = np.array([int(start)]), np.ones(1, bool)
    for n, s in zip(lengths, strides):
        at = (kernels.padded_source(n)[:, None] * s + at[None, :]).reshape(-1)
        inside = ((np.arange(4) < n)[:, None] & inside[None, :]).reshape(-1)
    if at.min() < 0 or at.max() >= size:
        raise InsufficientData(int(at.max()) + 1, size)
    return len(lengths), at, inside


def encode_block_strided(vals: pa.Array, kind: str, start, lengths, strides, a, b, c, e) -> pa.Array:
    """Blocks, whole or partial, straight from strided buffers; ``start`` is their first element, counted from 0."""
    size = len(vals[0])
    rank, at, _ = _reach(size, start, lengths, strides)
    return _coded(_numbers(vals, kind).reshape(-1, size)[:, at], kind, rank, _config(a, b, c, e))


def decode_block_strided_as(kind: str):
    def of_kind(payloads: pa.Array, buffers: pa.Array, start, lengths, strides, a, b, c, e) -> pa.Array:
        """The buffers with the blocks' values in their places; all others stay."""
        size = len(buffers[0])
        rank, at, inside = _reach(size, start, lengths, strides)
        if len(set(at[inside].tolist())) < inside.sum():
            raise BlockLength("strides put two values in one place")
        out = _numbers(buffers, kind).reshape(-1, size).copy()
        out[:, at[inside]] = _decoded_blocks(payloads, kind, rank, _config(a, b, c, e))[:, inside]
        return _matrix_lists(out)

    return of_kind


def encode_field(vals: pa.Array, kind: str, a, b, c, e) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(vals).to_numpy()))).astype(np.int64)
    return pa.array(codec.encode_runs(_numbers(vals, kind), offsets, scalar(kind), _config(a, b, c, e)), pa.binary())


def decode_field(streams: pa.Array, n: pa.Array, kind: str, a, b, c, e) -> pa.Array:
    lengths = n.to_numpy().astype(np.int64)
    return _lists(_exact_as_doubles(codec.decode_runs(streams.to_pylist(), lengths, scalar(kind), _config(a, b, c, e))), lengths)


def decode_field_as(kind: str):
    def of_kind(streams: pa.Array, n: pa.Array, a, b, c, e) -> pa.Array:
        lengths = n.to_numpy().astype(np.int64)
        return _lists(codec.decode_runs(streams.to_pylist(), lengths, scalar(kind), _config(a, b, c, e)), lengths)

    return of_kind


def bits_consumed(stream: bytes, kind: str, dims, a, b, c, e) -> int:
    """Bits of all blocks of a stream without header."""
    shape = Shape.of(tuple(int(n) for n in dims))
    return int(codec.walk(stream, 0, scalar(kind), shape, _config(a, b, c, e)).sum())


def field_header(kind: str, dims, a, b, c, e) -> bytes:
    return header_bytes(_config(a, b, c, e), kind, tuple(int(n) for n in dims))


def maximum_size(kind: str, dims, a, b, c, e) -> int:
    return _config(a, b, c, e).maximum_size(kind, tuple(int(n) for n in dims))


def header_of(stream: bytes) -> dict:
    try:
        h = read_header(stream)
    except ValueError as error:
        return {"error": type(error).__name__}
    c = h.config
    return {"bits": h.bits, "scalar_type": h.kind.name, "dims": list(h.dims), "min_bits": c.min_bits, "max_bits": c.max_bits, "max_prec": c.max_prec, "min_exp": c.min_exp}


_SHIFT = "4 + k * CAST(48 / size(dims) AS INT)"
# Arithmetic that Catalyst inlines: name, parameters, type, expression.
MACROS = (
    ("field_blocks", "dims ARRAY<BIGINT>", "BIGINT", "aggregate(dims, 1L, (n, d) -> n * CAST(ceil(d / 4) AS BIGINT))"),
    ("field_elements", "dims ARRAY<BIGINT>", "BIGINT", "aggregate(dims, 1L, (n, d) -> n * d)"),
    ("field_block_is_full", "block BIGINT, dims ARRAY<BIGINT>", "BOOLEAN",
     "aggregate(dims, named_struct('rest', block, 'full', true), (s, d) -> named_struct('rest', s.rest div CAST(ceil(d / 4) AS BIGINT),"
     " 'full', s.full AND 4 * (s.rest % CAST(ceil(d / 4) AS BIGINT)) + 4 <= d), s -> s.full)"),
    ("field_metadata", "kind STRING, dims ARRAY<BIGINT>", "BIGINT",
     "(array_position(array('i32', 'i64', 'f32', 'f64'), kind) - 1) | shiftleft(CAST(size(dims) - 1 AS BIGINT), 2)"
     f" | aggregate(transform(dims, (d, k) -> shiftleft(d - 1, {_SHIFT})), 0L, (a, b) -> a | b)"),
    ("field_metadata_type", "word BIGINT", "STRING", "element_at(array('i32', 'i64', 'f32', 'f64'), CAST(word & 3 AS INT) + 1)"),
    ("field_metadata_dims", "word BIGINT", "ARRAY<BIGINT>",
     "transform(sequence(0, CAST(shiftright(word, 2) & 3 AS INT)), k -> (shiftright(word, 4 + k * CAST(48 / ((shiftright(word, 2) & 3) + 1) AS INT))"
     " & (shiftleft(1L, CAST(48 / ((shiftright(word, 2) & 3) + 1) AS INT)) - 1)) + 1)"),
)


def register(spark: SparkSession) -> None:
    """Array functions as vectorised Python, on Arrow columns where they code; arithmetic as SQL macros that Catalyst inlines."""
    for name, f, returns in (
        ("field_header", field_header, "binary"),
        ("field_maximum_size", maximum_size, "bigint"),
        ("field_bits_consumed", bits_consumed, "bigint"),
    ):
        spark.udf.register(name, _each(f, returns))
    binary, doubles = pa.binary(), pa.list_(pa.float64())
    spark.udf.register("field_encode_block", _together(encode_block, (1,), "binary", binary, sized=True))
    spark.udf.register("field_decode_block", _together(decode_block, (0,), "array<double>", doubles))
    spark.udf.register("field_encode", _together(encode_field, (1,), "binary", binary))
    spark.udf.register("field_decode", _together(decode_field, (0, 2), "array<double>", doubles))
    spark.udf.register("field_encode_block_strided", _together(encode_block_strided, (1,), "binary", binary, sized=True))
    for kind, s in SCALARS.items():
        returns, to = f"array<{s.sql}>", pa.list_(pa.from_numpy_dtype(np.dtype(s.dtype)))
        spark.udf.register(f"field_decode_block_strided_{kind}", _together(decode_block_strided_as(kind), (0, 1), returns, to, sized=True))
        spark.udf.register(f"field_decode_block_{kind}", _together(decode_block_as(kind), (0,), returns, to))
        spark.udf.register(f"field_decode_{kind}", _together(decode_field_as(kind), (0, 1), returns, to))

    def headers(streams: pd.Series) -> pd.DataFrame:
        names = ["bits", "scalar_type", "dims", "min_bits", "max_bits", "max_prec", "min_exp", "error"]
        out = pd.DataFrame([{} if s is None else header_of(s) for s in streams]).reindex(columns=names)
        for c in names:
            kind = {"scalar_type": "string", "error": "string"}.get(c)
            if c not in ("dims", *({c} if kind else ())):
                out[c] = pd.array([None if v is None or v != v else int(v) for v in out[c]], "Int32")
            elif kind:
                out[c] = pd.Series([v if isinstance(v, str) else None for v in out[c]], dtype=object)
        return out

    spark.udf.register("field_read_header", F.pandas_udf(headers, HEADER))
    for name, parameters, returns, body in (*MACROS, *bits.MACROS):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    for kind, (shift, offset, low, high) in PROMOTED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION field_promote_{kind}(v INT) RETURNS INT RETURN shiftleft(v - {offset}, {shift})")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION field_demote_{kind}(v INT) RETURNS INT RETURN greatest(least(shiftright(v, {shift}) + {offset}, {high}), {low})")
