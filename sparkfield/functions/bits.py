"""Bits of BINARY columns as SQL macros: a cursor is a position in a column, and nothing leaves the JVM.

Bit ``b`` of a stream is bit ``b % 8`` of byte ``b // 8``; words are 64 bits, little-endian.
Bits beyond the end read as zeros, and writing there extends the stream; reading more than 64 bits at
once reads 64. Seeking, telling and rewinding are the position itself, skipping is adding to it.
"""

from __future__ import annotations


def _turned(h: str, first: int = 1) -> str:
    """Eight bytes of a hexadecimal string in the opposite order."""
    return "concat(" + ", ".join(f"substring({h}, {first + 2 * k}, 2)" for k in reversed(range(8))) + ")"


def _parts(stream: str, at: str) -> tuple[str, str]:
    """The eight bytes from the one of bit ``at`` on, and the one after them, as numbers."""
    h = f"rpad(hex(substring({stream}, CAST(({at}) div 8 AS INT) + 1, 9)), 18, '0')"
    return f"CAST(conv({_turned(h)}, 16, -10) AS BIGINT)", f"CAST(conv(substring({h}, 17, 2), 16, 10) AS BIGINT)"


def _mask(n: str) -> str:
    return f"CASE WHEN {n} >= 64 THEN -1L WHEN {n} <= 0 THEN 0L ELSE shiftrightunsigned(-1L, CAST(64 - {n} AS INT)) END"


def _bits(stream: str, at: str, n: str) -> str:
    low, high = _parts(stream, at)
    s = f"CAST(({at}) % 8 AS INT)"
    return f"(CASE WHEN {s} = 0 THEN {low} ELSE shiftrightunsigned({low}, {s}) | shiftleft({high}, 64 - {s}) END & ({_mask(n)}))"


def _put(stream: str, at: str, value: str, n: str) -> str:
    """``stream`` with the lowest ``n`` bits of ``value`` at bit ``at``; only the bytes that they touch are made anew."""
    (low, high), s, mask = _parts(stream, at), f"CAST({at} % 8 AS INT)", f"({_mask(n)})"

    def over(bits: str) -> str:
        return f"CASE WHEN {s} = 0 THEN 0L ELSE shiftrightunsigned({bits}, 64 - {s}) END"

    new_low = f"({low} & ~shiftleft({mask}, {s})) | shiftleft({value} & {mask}, {s})"
    new_high = f"({high} & ~({over(mask)})) | ({over(f'({value} & {mask})')})"
    first = f"CAST({at} div 8 AS INT)"
    touched = f"CAST(({s} + greatest(least({n}, 64), 0) + 7) div 8 AS INT)"
    before = f"concat(substring({stream}, 1, {first}), unhex(repeat('00', {first} - length({stream}))))"
    made = f"unhex(substring(concat({_turned(f'''lpad(hex({new_low}), 16, '0')''')}, lpad(hex({new_high}), 2, '0')), 1, 2 * {touched}))"
    return f"concat({before}, {made}, substring({stream}, {first} + {touched} + 1))"


def _joined(a: str, a_bits: str, b: str, n: str) -> str:
    """The first ``a_bits`` of ``a``, then the first ``n`` of ``b``, in whole words: each word of the result from at most three reads."""
    s = f"({a_bits} % 64)"
    begin = f"({a_bits} - {s})"
    head = f"CASE WHEN k = 0 THEN {_bits(a, begin, s)} ELSE {_bits(b, f'greatest(64 * k - {s}, 0)', f'least({s}, {n} - 64 * k + {s})')} END"
    tail = f"shiftleft({_bits(b, '64 * k', f'least(64 - {s}, {n} - 64 * k)')}, CAST({s} AS INT))"
    words = f"array_join(transform(sequence(0L, ({s} + {n} - 1) div 64), k -> {_turned(f'''lpad(hex(({head}) | {tail}), 16, '0')''')}), '')"
    kept = f"concat(substring({a}, 1, CAST({begin} div 8 AS INT)), unhex(repeat('00', CAST({begin} div 8 AS INT) - length({a}))))"
    return f"concat({kept}, CASE WHEN {b} IS NULL THEN NULL WHEN {s} + {n} > 0 THEN unhex({words}) ELSE unhex('') END)"


# name, parameters, type, expression
MACROS = (
    ("field_bits", "stream BINARY, at BIGINT, n INT", "BIGINT", _bits("stream", "at", "n")),
    ("field_bit", "stream BINARY, at BIGINT", "INT", f"CAST({_bits('stream', 'at', '1')} AS INT)"),
    ("field_word", "stream BINARY, k BIGINT", "BIGINT", _bits("stream", "64 * k", "64")),
    ("field_put_bits", "stream BINARY, at BIGINT, value BIGINT, n INT", "BINARY", _put("stream", "at", "value", "n")),
    ("field_put_bit", "stream BINARY, at BIGINT, value BIGINT", "BINARY", _put("stream", "at", "value", "1")),
    ("field_put_rest", "value BIGINT, n INT", "BIGINT", "CASE WHEN n >= 64 THEN 0L ELSE shiftrightunsigned(value, n) END"),
    ("field_join_bits", "a BINARY, a_bits BIGINT, b BINARY, n BIGINT", "BINARY", _joined("a", "a_bits", "b", "n")),
    ("field_align", "at BIGINT", "BIGINT", "(at + 63) div 64 * 64"),
    ("field_pad", "stream BINARY", "BINARY", "concat(stream, unhex(repeat('00', (8 - length(stream) % 8) % 8)))"),
    ("field_capacity", "stream BINARY", "BIGINT", "length(stream) div 8 * 64L"),
    ("field_overread", "stream BINARY, at BIGINT, n BIGINT", "BOOLEAN", "at + n > length(stream) * 8L"),
)
