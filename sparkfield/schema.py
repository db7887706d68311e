"""Scalar types, shapes, strides and their persisted metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import errors

MAX_INDEX = 2**63 - 1
META_BITS = 52


@dataclass(frozen=True)
class Scalar:
    """One of the four coded types, with the widths that the format fixes for it."""

    name: str
    code: int
    bits: int
    exponent_bits: int
    bias: int
    dtype: str
    sql: str

    @property
    def size(self) -> int:
        return self.bits // 8

    @property
    def precision_bits(self) -> int:
        """Width of the precision field of a reversible block."""
        return 5 if self.bits == 32 else 6

    @property
    def is_float(self) -> bool:
        return self.exponent_bits > 0

    def header_bits(self, reversible: bool) -> int:
        """Most bits that stand before a block's planes."""
        if reversible:
            return self.precision_bits + (self.exponent_bits + 2 if self.is_float else 0)
        return self.exponent_bits + 1 if self.is_float else 0


I32 = Scalar("i32", 0, 32, 0, 0, "int32", "int")
I64 = Scalar("i64", 1, 64, 0, 0, "int64", "bigint")
F32 = Scalar("f32", 2, 32, 8, 127, "float32", "float")
F64 = Scalar("f64", 3, 64, 11, 1023, "float64", "double")
SCALARS = {s.name: s for s in (I32, I64, F32, F64)}
BY_SQL = {"int": I32, "bigint": I64, "float": F32, "double": F64}


def scalar(kind: str | Scalar) -> Scalar:
    if isinstance(kind, Scalar):
        return kind
    return SCALARS.get(kind) or BY_SQL[kind]


def rank_of(dims: tuple[int, ...]) -> int:
    """The number of leading nonzero dimensions."""
    return next((k for k, n in enumerate(dims) if n == 0), len(dims))


def four(values, fill: int = 0) -> tuple[int, int, int, int]:
    values = tuple(int(v) for v in (values if hasattr(values, "__len__") else (values,)))
    if len(values) > 4:
        raise errors.InvalidRank(f"rank {len(values)}")
    return values + (fill,) * (4 - len(values))


@dataclass(frozen=True)
class Shape:
    """Dimensions and strides of a field, x fastest. Stride 0: contiguous along that axis."""

    dims: tuple[int, int, int, int]
    strides: tuple[int, int, int, int] = (0, 0, 0, 0)

    @classmethod
    def of(cls, dims, strides=(0, 0, 0, 0)) -> Shape:
        out = cls(four(dims), four(strides))
        out.validate()
        return out

    def reshaped(self, dims, n_bytes: int | None = None, size: int = 1) -> Shape:
        """Other dimensions and natural strides; refused where ``n_bytes`` do not hold them. This shape stays as it is."""
        return self._checked(Shape(four(dims)), n_bytes, size)

    def restrided(self, strides, n_bytes: int | None = None, size: int = 1) -> Shape:
        """The same dimensions through other strides."""
        return self._checked(Shape(self.dims, four(strides)), n_bytes, size)

    @staticmethod
    def _checked(shape: Shape, n_bytes: int | None, size: int) -> Shape:
        shape.validate(n_bytes, size)
        return shape

    @property
    def rank(self) -> int:
        return rank_of(self.dims)

    @property
    def active(self) -> tuple[int, ...]:
        return self.dims[: self.rank]

    def valid(self) -> bool:
        return self.rank > 0 and not any(self.dims[self.rank :]) and min(self.dims) >= 0

    def validate(self, n_bytes: int | None = None, size: int = 1) -> None:
        if not self.valid():
            raise errors.InvalidDims(str(self.dims))
        if self.elements > MAX_INDEX or self.blocks > MAX_INDEX:
            raise errors.ShapeTooLarge(str(self.dims))
        if n_bytes is not None and self.span_bytes(size) > n_bytes:
            raise errors.InsufficientData(self.span_bytes(size), n_bytes)

    @property
    def elements(self) -> int:
        return int(np.prod(self.active, dtype=object)) if self.rank else 0

    @property
    def grid(self) -> tuple[int, ...]:
        """Blocks along each axis."""
        return tuple(-(-n // 4) for n in self.active)

    @property
    def blocks(self) -> int:
        return int(np.prod(self.grid, dtype=object)) if self.rank else 0

    @property
    def effective_strides(self) -> tuple[int, ...]:
        natural = [1]
        for n in self.active[:-1]:
            natural.append(natural[-1] * n)
        return tuple(s or t for s, t in zip(self.strides, natural))

    @property
    def contiguous(self) -> bool:
        return self.effective_strides == Shape(self.dims).effective_strides

    @property
    def index_span(self) -> tuple[int, int]:
        """Smallest and largest element index that the layout reaches."""
        reach = [s * (n - 1) for s, n in zip(self.effective_strides, self.active)]
        return sum(min(r, 0) for r in reach), sum(max(r, 0) for r in reach)

    def span_bytes(self, size: int) -> int:
        low, high = self.index_span
        return (high - low + 1) * size

    def may_alias(self) -> bool:
        """Whether two coordinates might share an element."""
        reach = 1
        for stride, n in sorted((abs(s), n) for s, n in zip(self.effective_strides, self.active) if n > 1):
            if stride < reach:
                return True
            reach += stride * (n - 1)
        return False

    def element_index(self) -> np.ndarray:
        """Of each element, x fastest, its place in the buffer counted from its lowest one."""
        low, _ = self.index_span
        out = np.array([-low], np.int64)
        for stride, n in zip(self.effective_strides, self.active):
            out = (np.arange(n)[:, None] * stride + out[None, :]).reshape(-1)
        return out


def metadata_word(kind: str | Scalar, dims) -> int:
    """Type, rank and dimensions in 52 bits."""
    dims = Shape.of(dims).active
    width = 48 // len(dims)
    if max(dims) > 1 << width:
        raise errors.DimensionTooLarge(str(dims))
    word = scalar(kind).code | (len(dims) - 1) << 2
    for k, n in enumerate(dims):
        word |= (n - 1) << (4 + k * width)
    return word


def read_metadata(word: int) -> tuple[Scalar, tuple[int, ...]]:
    if word < 0 or word >> META_BITS:
        raise errors.InvalidMetadata(hex(word))
    kind = next(s for s in SCALARS.values() if s.code == word & 3)
    rank = (word >> 2 & 3) + 1
    width = 48 // rank
    return kind, tuple((word >> (4 + k * width) & ((1 << width) - 1)) + 1 for k in range(rank))
