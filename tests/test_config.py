import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkfield import errors
from sparkfield.config import Config
from sparkfield.operators.header import header_bytes, read_header, write_header
from sparkfield.schema import SCALARS, Shape, metadata_word, read_metadata


def test_rates():
    assert Config.fixed_rate(8, "f64", 3, align=True).max_bits == 512
    assert Config.fixed_rate(5, "f64", 3, align=True).max_bits == 320
    assert [Config.fixed_rate(0.1, t, 1).max_bits for t in ("f32", "f64")] == [9, 12]
    for bad in (-1, math.nan, math.inf, 1e9):
        with pytest.raises(errors.InvalidRate):
            Config.fixed_rate(bad, "f64", 1)


def test_modes():
    assert Config.fixed_precision(16).mode == "fixed_precision" and Config.fixed_precision(16).precision() == 16
    assert Config.fixed_accuracy(1e-3).mode == "fixed_accuracy" and Config.fixed_accuracy(0.25).accuracy() == 0.25
    assert Config.reversible().mode == "reversible" and Config.reversible().is_reversible
    assert {c.mode for c in (Config(), Config.fixed_precision(0), Config.fixed_precision(64), Config.fixed_accuracy(0), Config.fixed_accuracy(math.nan))} == {"expert"}
    assert Config.fixed_rate(8, "f64", 2).rate(2) == 8
    with pytest.raises(errors.InvalidParameters):
        Config.expert(5, 4, 64, 0)
    with pytest.raises(errors.InvalidParameters):
        Config.expert(1, 4, 65, 0)


@pytest.mark.parametrize("min_exp, bits", [(-1075, 12), (-1074, 64), (843, 12), (844, 64)])
def test_mode_word_widths(min_exp, bits):
    assert Config.expert(1, 16658, 64, min_exp).mode_word()[1] == bits


@given(st.one_of(
    st.builds(lambda b: Config(b, b), st.integers(1, 2048)),
    st.builds(Config.fixed_precision, st.integers(1, 64)),
    st.builds(lambda e: Config(min_exp=e), st.integers(-1075, 843)),
    st.builds(lambda a, b, c, d: Config(min(a, b), max(a, b), c, d), st.integers(1, 16658), st.integers(1, 16658), st.integers(1, 64), st.integers(-1075, 843)),
))
def test_mode_words_round_trip(cfg):
    word, _ = cfg.checked_mode_word()
    assert Config.from_mode_word(word) == cfg


def test_unrepresentable():
    with pytest.raises(errors.UnrepresentableMode):
        Config(1, 40000, 64, -1074).checked_mode_word()
    with pytest.raises(errors.UnrepresentableMode):
        write_header(Config(1, 40000, 64, -1074), "f64", (4,))


def test_largest_blocks():
    # Most bits of a block with default parameters, by rank, of i32, i64, f32, f64.
    plain = {1: (131, 259, 140, 271), 2: (527, 1039, 536, 1051), 3: (2111, 4159, 2120, 4171), 4: (8447, 16639, 8456, 16651)}
    for rank, want in plain.items():
        assert tuple(Config().block_bits(t, rank) for t in SCALARS) == want
        more = (5, 6, 15, 19)
        less = (0, 0, 9, 12)
        assert tuple(Config.reversible().block_bits(t, rank) for t in SCALARS) == tuple(w - a + b for w, a, b in zip(want, less, more))
    assert Config.expert(1, 11, 64, -1074).maximum_size("f64", (16,)) == 32


@given(st.sampled_from(list(SCALARS)), st.lists(st.integers(1, 4096), min_size=1, max_size=4))
def test_metadata(kind, dims):
    got = read_metadata(metadata_word(kind, dims))
    assert got == (SCALARS[kind], tuple(dims))


def test_header():
    data = header_bytes(Config.fixed_accuracy(1e-6), "f32", (10, 20, 30))
    assert data[:4].hex() == "7a667005" and len(data) % 8 == 0
    head = read_header(data)
    assert (head.kind.name, head.dims, head.config, head.bits) == ("f32", (10, 20, 30), Config.fixed_accuracy(1e-6), 96)
    assert read_header(header_bytes(Config(), "i64", (5,))).bits == 148
    with pytest.raises(errors.InvalidMagic):
        read_header(b"nope" + data[4:])
    with pytest.raises(errors.DimensionTooLarge):
        metadata_word("f32", (1 << 24, (1 << 24) + 1))


def test_shapes():
    assert Shape.of((9, 5)).blocks == 6 and Shape.of((9, 5)).grid == (3, 2)
    assert Shape.of((4, 3), (-1, 4)).index_span == (-3, 8)
    assert Shape.of((4, 3)).contiguous and not Shape.of((4, 3), (2, 8)).contiguous
    assert Shape.of((4, 4), (1, 1)).may_alias() and not Shape.of((4, 3), (3, 1)).may_alias()
    for bad in ((0,), (4, 0, 4)):
        with pytest.raises(errors.InvalidDims):
            Shape.of(bad)
    with pytest.raises(errors.ShapeTooLarge):
        Shape.of((1 << 40, 1 << 40))
    with pytest.raises(errors.InsufficientData):
        Shape.of((10,)).validate(79, 8)
