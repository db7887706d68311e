"""Bit operators on BINARY columns against whole numbers."""

import random

from sparkfield.functions import registry


def number(stream: bytes) -> int:
    return int.from_bytes(stream, "little")


def signed(value: int) -> int:
    return (value & (1 << 64) - 1 ^ 1 << 63) - (1 << 63)


def test_bits(spark):
    registry.register(spark)
    rng = random.Random(3)
    rows = []
    for k in range(400):
        a, b = (rng.randbytes(rng.choice([0, 1, 7, 8, 9, 16, 33])) for _ in range(2))
        rows.append((k, bytearray(a), bytearray(b), rng.randrange(300), rng.choice([0, 1, 5, 31, 63, 64, 80]), rng.randrange(-(2**63), 2**63), rng.randrange(0, 8 * len(a) + 1), rng.randrange(0, 8 * len(b) + 1)))
    df = spark.createDataFrame(rows, "k int, a binary, b binary, at bigint, n int, v bigint, an bigint, bn bigint")
    out = df.selectExpr(
        "*", "field_bits(a, at, n) AS read", "field_bit(a, at) AS bit", "field_word(a, 1) AS word", "field_put_bits(a, at, v, n) AS put", "field_put_rest(v, n) AS rest",
        "field_join_bits(a, an, b, bn) AS both", "field_align(at) AS aligned", "field_pad(a) AS padded", "field_overread(a, at, n) AS over", "field_capacity(a) AS capacity",
    )
    for r in out.collect():
        a, n = number(r.a), min(r.n, 64)
        mask = (1 << n) - 1
        assert r.read == signed(a >> r.at & mask) and r.bit == a >> r.at & 1 and r.word == signed(a >> 64)
        put = bytes(r.put)
        assert number(put) == a & ~(mask << r.at) | (r.v & mask) << r.at
        assert len(put) == max(len(r.a), r.at // 8, (r.at + n + 7) // 8)
        assert r.rest == signed((r.v & (1 << 64) - 1) >> n)
        both = bytes(r.both)
        assert number(both) == a & (1 << r.an) - 1 | (number(r.b) & (1 << r.bn) - 1) << r.an and len(both) == (r.an + r.bn + 63) // 64 * 8
        assert r.aligned == -(-r.at // 64) * 64 and len(r.padded) == -(-len(r.a) // 8) * 8 and bytes(r.padded[: len(r.a)]) == bytes(r.a)
        assert r.over == (r.at + r.n > 8 * len(r.a)) and r.capacity == len(r.a) // 8 * 64


def test_nulls(spark):
    registry.register(spark)
    row = spark.sql("SELECT field_bits(CAST(NULL AS BINARY), 3, 4) AS a, field_put_bits(CAST(NULL AS BINARY), 3, 4, 5) AS b, field_join_bits(X'01', 8, CAST(NULL AS BINARY), 8) AS c").first()
    assert tuple(row) == (None, None, None)
