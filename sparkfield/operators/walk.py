"""Where the blocks of a stream end, without decoding them.

A variable-rate stream does not say how long its blocks are, so they are read one after the
other; but the length of a block follows from its header fields and from how far each bit
plane's group tests go. So a block takes a few integer operations a plane, and no values.
"""

from __future__ import annotations

import numpy as np

from ..config import Config
from ..schema import Scalar


def plane_bits(word: int, size: int, planes: int, budget: int) -> int:
    """Bits of the code of ``planes`` planes that starts at the lowest bit of ``word``, cut at ``budget``."""
    at = n = 0
    for _ in range(planes):
        if at >= budget:
            break
        at = min(at + n, budget)
        while n < size and at < budget:
            group = word >> at & 1
            at += 1
            if not group:
                break
            # Zeros up to the next one; the last coefficient's one is implied, as is one where the budget ends.
            most = min(size - 1 - n, budget - at)
            rest = word >> at & (1 << most) - 1
            if rest:
                zeros = (rest & -rest).bit_length() - 1
                at += zeros + 1
            else:
                zeros = most
                at += most
            n += zeros + 1
    return at


def most_bits(kind: Scalar, rank: int, cfg: Config) -> int:
    """Bits that a block never exceeds."""
    head = kind.exponent_bits + 8 if kind.is_float else 8
    return max(min(cfg.max_bits, head + (2 * 4**rank + 1) * kind.bits), cfg.min_bits)


def block_lengths(stream: bytes, start: int, kind: Scalar, rank: int, blocks: int, cfg: Config) -> np.ndarray:
    """Bits of each of ``blocks`` blocks from bit ``start`` on; bits beyond the stream's end are zeros."""
    size = 4**rank
    head = kind.exponent_bits + 8 if kind.is_float else 8
    most = min(cfg.max_bits, head + (2 * size + 1) * kind.bits)
    out, at = np.empty(blocks, np.int64), start
    for k in range(blocks):
        first = at >> 3
        word = int.from_bytes(stream[first : first + (most >> 3) + 2], "little") >> (at & 7)
        used, planes = 0, min(cfg.max_prec, kind.bits)
        if cfg.is_reversible:
            coded = True
            if kind.is_float:
                coded = bool(word & 1)
                used = 1 + coded
                if coded and not word >> 1 & 1:
                    used += kind.exponent_bits
            if coded:
                planes = min((word >> used & (1 << kind.precision_bits) - 1) + 1, kind.bits)
                used += kind.precision_bits
        elif kind.is_float:
            coded = bool(word & 1)
            used = 1
            if coded:
                emax = (word >> 1 & (1 << kind.exponent_bits) - 1) - kind.bias
                used += kind.exponent_bits
                planes = min(max(emax - cfg.min_exp + 2 * rank + (1 if cfg.tight else 2), 0), cfg.max_prec, kind.bits)
        else:
            coded = True
        if coded:
            used += plane_bits(word >> used, size, planes, max(cfg.max_bits - used, 0))
        out[k] = max(used, cfg.min_bits)
        at += int(out[k])
    return out
