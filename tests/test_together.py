"""SQL functions that code many rows in one call, against one row at a time."""

import numpy as np
import pyarrow as pa
import pytest

from sparkfield.config import Config
from sparkfield.functions import registry
from sparkfield.operators import codec, kernels
from sparkfield.schema import scalar

CONFIGS = [Config.reversible(), Config.fixed_rate(9, "f64", 1), Config.fixed_precision(20)]


def ragged(kind: str, lengths: list[int]) -> list[np.ndarray]:
    rng = np.random.default_rng(5)
    return [(rng.integers(-9, 9, n) * 100.25).astype(scalar(kind).dtype) for n in lengths]


@pytest.mark.parametrize("kind", ["i32", "i64", "f32", "f64"])
@pytest.mark.parametrize("cfg", CONFIGS)
def test_runs(kind, cfg, monkeypatch):
    monkeypatch.setattr(codec, "VALUES_TOGETHER", 300)
    t = scalar(kind)
    arrays = ragged(kind, [61, 1, 4, 900, 7, *range(1, 60), 5, 2000])
    want = [codec.encode_values(a, t, (len(a),), cfg) for a in arrays]
    lengths = np.array([len(a) for a in arrays])
    assert codec.encode_runs(np.concatenate(arrays), np.concatenate(([0], np.cumsum(lengths))), t, cfg) == want
    back = [codec.decode_values(s, t, (len(a),), cfg) for s, a in zip(want, arrays)]
    assert codec.decode_runs(want, lengths, t, cfg).tolist() == np.concatenate(back).tolist()
    # Streams cut short are zeros from there on, whatever stream comes next.
    cut = [s[: len(s) // 16 * 8] for s in want]
    back = [codec.decode_values(s, t, (len(a),), cfg) for s, a in zip(cut, arrays)]
    assert codec.decode_runs(cut, lengths, t, cfg).tolist() == np.concatenate(back).tolist()


def test_few_calls(monkeypatch):
    """500 arrays of 61 values: some calls of the coder, not one or more an array."""
    arrays, calls = ragged("i64", [61] * 500), []
    args = (1, 16658, 64, -1075)
    for name in ("encode_blocks", "decode_blocks"):
        f = getattr(kernels, name)
        monkeypatch.setattr(kernels, name, lambda *a, f=f: calls.append(1) or f(*a))
    streams = registry.encode_field(pa.array([a.tolist() for a in arrays]), "i64", *args)
    back = registry.decode_field_as("i64")(streams, pa.array([61] * 500), *args)
    assert back.to_pylist() == [a.tolist() for a in arrays] and len(calls) < 40


def test_rows_of_all_sorts(spark):
    registry.register(spark)
    rows = [([float(k + j) for j in range(n)], k % 3, n) if k % 5 else (None, 1, n) for k, n in enumerate([4, 16, 4, 64, 7, 3, 4] * 12)]
    c = "1, 16658, 64, -1075 + m"
    df = spark.createDataFrame(rows, "v array<double>, m int, n int")
    some = df.selectExpr("v", "m", "n", f"field_encode('f64', v, {c}) AS s", f"CASE WHEN n IN (4, 16, 64) THEN v END AS whole")
    some = some.selectExpr("*", f"field_encode_block('f32', whole, {c}) AS b")
    got = some.selectExpr("*", f"field_decode(s, 'f64', n, {c}) AS back", f"field_decode_block_f32(b, CAST(log(4, n) AS INT), {c}) AS block").collect()
    for r in got:
        cfg = Config(1, 16658, 64, -1075 + r.m)
        assert (r.s is None) == (r.back is None) == (r.v is None) and (r.block is None) == (r.whole is None)
        if r.v is not None:
            assert bytes(r.s) == codec.encode_values(np.array(r.v), scalar("f64"), (r.n,), cfg)
            assert r.back == codec.decode_values(bytes(r.s), scalar("f64"), (r.n,), cfg).tolist()
        if r.whole is not None:
            rank = {4: 1, 16: 2, 64: 3}[r.n]
            assert bytes(r.b) == codec.pack(kernels.encode_blocks(np.array([r.v], "f4"), "f32", rank, cfg)[0])
            assert r.block == kernels.decode_blocks(kernels.Bits(bytes(r.b)), np.array([0]), "f32", rank, cfg)[0][0].tolist()
