"""Coding parameters: modes, their words in the header, and the sizes that follow from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from . import errors
from .schema import Scalar, Shape, scalar

# Fixed values of the format.
MIN_BITS, MAX_BITS, MAX_PREC, MIN_EXP = 1, 16658, 64, -1074
REVERSIBLE_EXP = MIN_EXP - 1
HEADER_MAX_BITS = 148
SHORT_MODE_MAX = (1 << 12) - 2
WORD_BITS = 64

ROUNDING = ("never", "first", "first_tight", "last", "last_tight")


@dataclass(frozen=True)
class Config:
    min_bits: int = MIN_BITS
    max_bits: int = MAX_BITS
    max_prec: int = MAX_PREC
    min_exp: int = MIN_EXP
    rounding: str = "never"

    # -- constructors

    @classmethod
    def fixed_rate(cls, rate: float, kind: str | Scalar, rank: int, align: bool = False) -> Config:
        """``rate`` bits a value; blocks of one size, which may be aligned to words."""
        if not rate >= 0:
            raise errors.InvalidRate(str(rate))
        bits = max(math.floor(4**rank * rate + 0.5) if math.isfinite(rate) else MAX_BITS + 1, scalar(kind).header_bits(False))
        if align:
            bits = -(-bits // WORD_BITS) * WORD_BITS
        if not 1 <= bits <= MAX_BITS:
            raise errors.InvalidRate(str(rate))
        return cls(bits, bits)

    @classmethod
    def fixed_precision(cls, planes: int) -> Config:
        return cls(max_prec=min(planes, MAX_PREC) or MAX_PREC)

    @classmethod
    def fixed_accuracy(cls, tolerance: float) -> Config:
        if tolerance > 0:
            return cls(min_exp=-1 if math.isinf(tolerance) else math.frexp(tolerance)[1] - 1)
        return cls()

    @classmethod
    def reversible(cls) -> Config:
        return cls(min_exp=REVERSIBLE_EXP)

    @classmethod
    def expert(cls, min_bits: int, max_bits: int, max_prec: int, min_exp: int) -> Config:
        if min_bits > max_bits or not 1 <= max_prec <= MAX_PREC:
            raise errors.InvalidParameters(f"{min_bits}, {max_bits}, {max_prec}, {min_exp}")
        return cls(min_bits, max_bits, max_prec, min_exp)

    def with_rounding(self, rounding: str) -> Config:
        """Rounding is a matter of coder and decoder; no header carries it."""
        if rounding not in ROUNDING:
            raise errors.InvalidParameters(rounding)
        return replace(self, rounding=rounding)

    # -- inspection

    @property
    def tight(self) -> bool:
        return self.rounding.endswith("_tight")

    @property
    def is_reversible(self) -> bool:
        return self.min_exp < MIN_EXP

    @property
    def mode(self) -> str:
        given = (self.min_bits, self.max_bits, self.max_prec, self.min_exp)
        if self.min_bits > self.max_bits or not 0 < self.max_prec <= MAX_PREC:
            return "null"
        if given == (MIN_BITS, MAX_BITS, MAX_PREC, MIN_EXP):
            return "expert"
        if self.min_bits == self.max_bits and 1 <= self.max_bits <= MAX_BITS and self.max_prec >= MAX_PREC and self.min_exp == MIN_EXP:
            return "fixed_rate"
        if self.min_bits <= MIN_BITS and self.max_bits >= MAX_BITS:
            if self.max_prec >= 1 and self.min_exp == MIN_EXP:
                return "fixed_precision"
            if self.max_prec >= MAX_PREC and self.min_exp >= MIN_EXP:
                return "fixed_accuracy"
            if self.max_prec >= MAX_PREC and self.is_reversible:
                return "reversible"
        return "expert"

    def rate(self, rank: int) -> float | None:
        return self.max_bits / 4**rank if self.mode == "fixed_rate" else None

    def precision(self) -> int | None:
        return self.max_prec if self.mode == "fixed_precision" else None

    def accuracy(self) -> float | None:
        return math.ldexp(1.0, self.min_exp) if self.mode == "fixed_accuracy" else None

    # -- the mode word

    def mode_word(self) -> tuple[int, int]:
        """(word, its bits): 12 for the common modes, 64 for all else."""
        mode = self.mode
        if mode == "fixed_rate" and self.max_bits <= 2048:
            return self.max_bits - 1, 12
        if mode == "fixed_precision" and self.max_prec <= 128:
            return 2048 + self.max_prec - 1, 12
        if mode == "reversible" and self.min_exp == REVERSIBLE_EXP:
            return 2176, 12
        if mode == "fixed_accuracy" and self.min_exp <= 843:
            return 2177 + self.min_exp - MIN_EXP, 12
        word, at = SHORT_MODE_MAX + 1, 12
        for value, bits in ((self.min_bits - 1, 15), (self.max_bits - 1, 15), (self.max_prec - 1, 7), (self.min_exp + 16495, 15)):
            word |= min(max(value, 0), (1 << bits) - 1) << at
            at += bits
        return word, 64

    @classmethod
    def from_mode_word(cls, word: int) -> Config:
        short = word & 0xFFF
        if short <= SHORT_MODE_MAX:
            if short < 2048:
                return cls.expert(short + 1, short + 1, MAX_PREC, MIN_EXP)
            if short < 2176:
                return cls.expert(MIN_BITS, MAX_BITS, short - 2047, MIN_EXP) if short - 2047 <= MAX_PREC else cls._bad(word)
            return cls.expert(MIN_BITS, MAX_BITS, MAX_PREC, REVERSIBLE_EXP if short == 2176 else short - 2177 + MIN_EXP)
        low, high, prec, exp = word >> 12 & 0x7FFF, word >> 27 & 0x7FFF, word >> 42 & 0x7F, word >> 49 & 0x7FFF
        try:
            return cls.expert(low + 1, high + 1, prec + 1, exp - 16495)
        except errors.InvalidParameters:
            return cls._bad(word)

    @staticmethod
    def _bad(word: int) -> Config:
        raise errors.InvalidMode(hex(word))

    def checked_mode_word(self) -> tuple[int, int]:
        word, bits = self.mode_word()
        try:
            same = Config.from_mode_word(word) == replace(self, rounding="never")
        except errors.FieldEngineError:
            same = False
        if not same:
            raise errors.UnrepresentableMode(str(self))
        return word, bits

    # -- sizes

    def block_bits(self, kind: str | Scalar, rank: int) -> int:
        """Most bits of a block."""
        kind, n = scalar(kind), 4**rank
        head = kind.header_bits(self.is_reversible)
        return max(min(head + n - 1 + n * min(self.max_prec, kind.bits), self.max_bits), head, self.min_bits)

    def maximum_size(self, kind: str | Scalar, dims) -> int:
        """Most bytes of a stream with header."""
        shape = Shape.of(dims)
        return -(-(shape.blocks * self.block_bits(kind, shape.rank) + HEADER_MAX_BITS) // WORD_BITS) * (WORD_BITS // 8)
