"""Column builders for the steps of block coding that Catalyst can express.

They take and give lists of columns, one a place of the block, so that the code is
generated whole. 64-bit steps avoid sums that could leave the range, as ANSI mode refuses
them. The steps past this point, packing bits and reading them, are array code
(:mod:`sparkfield.operators.kernels`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.kernels import MIN_CAST_EXP, order_of
from ..schema import Scalar, scalar

LOWEST = -(2**63)
NEGABINARY_MASK = -6148914691236517206  # 0xaaaa... as a signed 64-bit number


# ---- shape algebra


def block_index(coords: list[Column], dims: list[int | Column]) -> tuple[Column, Column]:
    """(block, place in it) of an element, both x fastest."""
    block, place, stride = F.lit(0).cast("bigint"), F.lit(0), F.lit(1).cast("bigint")
    for axis, (c, n) in enumerate(zip(coords, dims)):
        n = n if isinstance(n, Column) else F.lit(n)
        block = block + F.floor(c / 4).cast("bigint") * stride
        place = place + (c % 4).cast("int") * (4**axis)
        stride = stride * F.ceil(n / 4).cast("bigint")
    return block, place.cast("int")


def block_coords(block: Column, dims: list[int]) -> list[Column]:
    out, rest = [], block
    for n in dims:
        b = -(-n // 4)
        out.append((rest % b).cast("bigint"))
        rest = F.floor(rest / b).cast("bigint")
    return out


def block_lengths(block: Column, dims: list[int]) -> list[Column]:
    return [F.least(F.lit(n) - 4 * c, F.lit(4)).cast("int") for n, c in zip(dims, block_coords(block, dims))]


def span_index(coords: list[Column], strides: list[int], dims: list[int]) -> Column:
    """An element's place in a strided buffer, counted from the lowest one it reaches."""
    low = sum(min(0, s * (n - 1)) for s, n in zip(strides, dims))
    out = F.lit(-low).cast("bigint")
    for c, s in zip(coords, strides):
        out = out + c * s
    return out


def pad_line(values: list[Column]) -> list[Column]:
    """Four places of which the last may be null: the second and third repeat what stands before them, the fourth the first."""
    x, y, z, w = values
    return [x, F.coalesce(y, x), F.coalesce(z, y, x), F.coalesce(w, x)]


def pad_block(values: list[Column], rank: int) -> list[Column]:
    out = list(values)
    for axis in range(rank):
        step = 4**axis
        for first in range(len(out)):
            if first // step % 4 == 0:
                at = [first + k * step for k in range(4)]
                for k, c in zip(at, pad_line([out[k] for k in at])):
                    out[k] = c
    return out


# ---- integers


def to32(v: Column) -> Column:
    """Wrapped to 32 bits, as a bigint."""
    return F.shiftright(F.shiftleft(v, 32), 32)


def lift(values: list[Column]) -> list[Column]:
    x, y, z, w = values
    x = F.shiftright(x + w, 1)
    w = w - x
    z = F.shiftright(z + y, 1)
    y = y - z
    x = F.shiftright(x + z, 1)
    z = z - x
    w = F.shiftright(w + y, 1)
    y = y - w
    w = w + F.shiftright(y, 1)
    y = y - F.shiftright(w, 1)
    return [x, y, z, w]


def unlift(values: list[Column]) -> list[Column]:
    x, y, z, w = values
    y = y + F.shiftright(w, 1)
    w = w - F.shiftright(y, 1)
    y = y + w
    w = F.shiftleft(w, 1) - y
    z = z + x
    x = F.shiftleft(x, 1) - z
    y = y + z
    z = F.shiftleft(z, 1) - y
    w = w + x
    x = F.shiftleft(x, 1) - w
    return [x, y, z, w]


def differences(values: list[Column]) -> list[Column]:
    x, y, z, w = values
    return [x, y - x, z - 2 * y + x, w - 3 * z + 3 * y - x]


def sums(values: list[Column]) -> list[Column]:
    x, y, z, w = values
    return [x, x + y, x + 2 * y + z, x + 3 * y + 3 * z + w]


def along_axes(values: list[Column], rank: int, line, axes=None) -> list[Column]:
    out = list(values)
    for axis in axes if axes is not None else range(rank):
        step = 4**axis
        for first in range(len(out)):
            if first // step % 4 == 0:
                at = [first + k * step for k in range(4)]
                for k, c in zip(at, line([out[k] for k in at])):
                    out[k] = c
    return out


def negabinary(v: Column, bits: int = 64) -> Column:
    """The bit pattern, as a signed number of 64 bits (32-bit ones are not negative)."""
    if bits == 32:
        m = F.lit(0xAAAAAAAA).cast("bigint")
        return (v + m).bitwiseAND(0xFFFFFFFF).bitwiseXOR(m)
    m, low = F.lit(NEGABINARY_MASK), F.lit(LOWEST)
    flipped = v.bitwiseXOR(low) + (NEGABINARY_MASK - LOWEST)
    return F.when(v < LOWEST - NEGABINARY_MASK, flipped).otherwise(v + m).bitwiseXOR(m)


def from_negabinary(u: Column, bits: int = 64) -> Column:
    if bits == 32:
        m = F.lit(0xAAAAAAAA).cast("bigint")
        return to32(u.bitwiseXOR(m) - m)
    m, low = F.lit(NEGABINARY_MASK), F.lit(LOWEST)
    t = u.bitwiseXOR(m)
    # t - m leaves the range for large t; the distance from the other end does not.
    return F.when(t > F.lit(2**63 - 1 + NEGABINARY_MASK), t.bitwiseXOR(low) - (NEGABINARY_MASK - LOWEST)).otherwise(t - m)


def reorder(values: list[Column], rank: int) -> list[Column]:
    return [values[p] for p in order_of(rank).tolist()]


# ---- floating point


def magnitude(values: list[Column]) -> Column:
    """The largest magnitude; NaN counts as 0."""
    some = [F.when(F.isnan(v), F.lit(0.0).cast("double")).otherwise(F.abs(v.cast("double"))) for v in values]
    return F.greatest(*some)


def exponent(top: Column, kind: str | Scalar) -> Column:
    """The exponent of a block's largest magnitude, exact at powers of two."""
    bias = scalar(kind).bias
    f = F.floor(F.log2(top)).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)
    exact = F.when(two(f) > top, f - 1).when(two(f + 1) <= top, f + 1).otherwise(f) + 1
    return F.when(top == 0, -bias).when(top == F.lit(float("inf")), 0).otherwise(F.greatest(exact, F.lit(1 - bias)))


def precision(emax: Column, min_exp: int, max_prec: int, rank: int, tight: bool = False) -> Column:
    return F.least(F.greatest(emax - min_exp + 2 * rank + (1 if tight else 2), F.lit(0)), F.lit(max_prec))


def quantise(v: Column, emax: Column, kind: str | Scalar) -> Column:
    """Cut to an integer at the block's exponent; what does not fit is the lowest number."""
    kind = scalar(kind)
    two = lambda e: F.pow(F.lit(2.0), e).cast(kind.sql)
    tiny = (v * F.lit(2.0**64).cast(kind.sql)) * two(kind.bits - 66 - emax)
    product = F.when(emax < MIN_CAST_EXP[kind.name], tiny).otherwise(v * two(kind.bits - 2 - emax))
    limit = F.lit(2.0 ** (kind.bits - 1))
    fits = (product.cast("double") >= -limit) & (product.cast("double") < limit)
    return F.when(fits, product.cast("bigint")).otherwise(F.lit(-(2 ** (kind.bits - 1))).cast("bigint"))


def dequantise(i: Column, emax: Column, kind: str | Scalar) -> Column:
    kind = scalar(kind)
    return F.pow(F.lit(2.0), emax - (kind.bits - 2)).cast(kind.sql) * i.cast(kind.sql)


# ---- sizes


def plane_length(u: list[Column], k: Column, n: Column) -> Column:
    """Bits of plane k, of which the first n coefficients are already significant."""
    size = len(u)
    bits = [F.shiftrightunsigned(c, k).bitwiseAND(1) if isinstance(k, int) else F.call_function("shiftrightunsigned", c, k).bitwiseAND(1) for c in u]
    fresh = [F.when(n <= i, b).otherwise(0) for i, b in enumerate(bits)]
    ones = sum(fresh[1:], fresh[0])
    last = F.lit(-1)
    for i, b in enumerate(fresh):
        last = F.when(b == 1, i).otherwise(last)
    return F.when(n == size, size).when(ones == 0, n + 1).otherwise(last + 1 + ones + F.when(last == size - 1, -1).otherwise(1))


def known_before(u: list[Column], k: Column) -> Column:
    """How many leading coefficients are significant above plane k."""
    n = F.lit(0)
    for i, c in enumerate(u):
        above = F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", c, k), F.lit(1))
        n = F.when(above != 0, i + 1).otherwise(n)
    return n


def planes_bits(u: list[Column], planes: Column, bits: int) -> Column:
    """Bits of the code of the top ``planes`` planes: no packing needed."""
    ks = F.when(planes > 0, F.sequence(F.lit(bits) - planes, F.lit(bits - 1))).otherwise(F.array().cast("array<int>"))

    def add(total: Column, k: Column) -> Column:
        return total + plane_length(u, k, known_before(u, k)).cast("bigint")

    return F.aggregate(ks, F.lit(0).cast("bigint"), add)


# ---- small integers


PROMOTED = {"i8": (23, 0, -128, 127), "u8": (23, 128, 0, 255), "i16": (15, 0, -32768, 32767), "u16": (15, 32768, 0, 65535)}


def promote(v: Column, kind: str) -> Column:
    """A small integer in the 31-bit range of coded ones."""
    shift, offset, _, _ = PROMOTED[kind]
    return F.shiftleft((v - offset).cast("int"), shift)


def demote(v: Column, kind: str) -> Column:
    shift, offset, low, high = PROMOTED[kind]
    return F.greatest(F.least(F.shiftright(v.cast("int"), shift) + offset, F.lit(high)), F.lit(low))


# ---- words


def mode_word(min_bits: Column, max_bits: Column, max_prec: Column, min_exp: Column) -> Column:
    """The mode word of valid parameters, as a bigint."""
    at = lambda v, bits, shift: F.shiftleft(F.least(F.greatest(v, F.lit(0)), F.lit((1 << bits) - 1)).cast("bigint"), shift)
    long = F.lit(4095).cast("bigint").bitwiseOR(at(min_bits - 1, 15, 12)).bitwiseOR(at(max_bits - 1, 15, 27)).bitwiseOR(at(max_prec - 1, 7, 42)).bitwiseOR(at(min_exp + 16495, 15, 49))
    plain = (min_bits == 1) & (max_bits == 16658)
    defaults = plain & (max_prec == 64) & (min_exp == -1074)
    return (
        F.when(defaults, long)
        .when((min_bits == max_bits) & (max_prec >= 64) & (min_exp == -1074) & (max_bits <= 2048), max_bits - 1)
        .when((min_bits <= 1) & (max_bits >= 16658) & (min_exp == -1074), max_prec + 2047)
        .when((min_bits <= 1) & (max_bits >= 16658) & (max_prec >= 64) & (min_exp == -1075), F.lit(2176))
        .when((min_bits <= 1) & (max_bits >= 16658) & (max_prec >= 64) & (min_exp >= -1074) & (min_exp <= 843), min_exp + 3251)
        .otherwise(long)
        .cast("bigint")
    )


def metadata_word(code: Column, dims: list[Column]) -> Column:
    """Type and dimensions in 52 bits; null where a dimension does not fit."""
    width = 48 // len(dims)
    out = code.cast("bigint").bitwiseOR((len(dims) - 1) << 2)
    for k, n in enumerate(dims):
        out = out.bitwiseOR(F.shiftleft((n - 1).cast("bigint"), 4 + k * width))
    return F.when(F.greatest(*dims, F.lit(0)) <= 1 << width, out)
