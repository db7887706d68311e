"""Strided layouts against numpy, and the queries over them against SQL."""

import numpy as np
import pytest

from sparkfield.config import Config
from sparkfield.errors import InsufficientData, InvalidDims
from sparkfield.functions import registry
from sparkfield.operators import blocks as B
from sparkfield.operators import codec, kernels
from sparkfield.schema import Shape

CFG = "1, 16658, 64, -1075"


@pytest.mark.parametrize("dims, strides", [((5, 3), (-2, 11)), ((4, 3, 2), (6, 2, -30)), ((6,), (-1,)), ((2, 1, 3), (7, 5, 1)), ((4, 4), (1, 2)), ((3, 2, 2, 2), (1, 3, 6, 12))])
def test_layouts(spark, dims, strides):
    shape = Shape.of(dims, strides)
    low, high = shape.index_span
    buffer = spark.createDataFrame([("f", i, float(i * i)) for i in range(high - low + 1)], "field_id string, index long, value double")
    elements = B.gather_strided(buffer, shape)
    names = B.AXES[: shape.rank]
    got = {tuple(r[a] for a in names): r.value for r in elements.collect()}
    places = shape.element_index()
    want = {c[::-1]: float(places[k] ** 2) for k, c in enumerate(np.ndindex(*dims[::-1]))}
    assert got == want
    if shape.may_alias():
        with pytest.raises(InvalidDims):
            B.scatter_strided(elements, shape)
    else:
        back = B.scatter_strided(elements, shape).collect()
        assert sorted((r["index"], r.value) for r in back) == sorted((i, float(i * i)) for i in places.tolist())


def test_other_shapes():
    shape = Shape.of((6, 4))
    assert shape.reshaped((8, 3), 24 * 8, 8).active == (8, 3) and shape.restrided((4, 1)).effective_strides == (4, 1)
    with pytest.raises(InsufficientData):
        shape.reshaped((5, 5), 24 * 8, 8)
    with pytest.raises(InvalidDims):
        shape.reshaped((0, 5))
    assert shape == Shape.of((6, 4))


@pytest.mark.parametrize("lengths, strides, start", [((4,), (-3,), 20), ((3, 2), (1, 9), 4), ((4, 1, 3), (5, 1, 21), 0), ((2, 3, 1, 2), (1, 2, 50, 7), 1)])
def test_strided_blocks(spark, lengths, strides, start):
    registry.register(spark)
    vals = [float(np.sin(k)) for k in range(80)]
    df = spark.createDataFrame([(vals, start, list(lengths), list(strides))], "v array<double>, s int, n array<int>, t array<int>")
    row = df.withColumn("b", df.v).selectExpr("*", f"field_encode_block_strided('f64', v, s, n, t, {CFG}) AS p").selectExpr("p", f"field_decode_block_strided_f64(p, array_repeat(0D, 80), s, n, t, {CFG}) AS back").first()
    at = [start + sum(i * t for i, t in zip(c, strides)) for c in np.ndindex(*lengths)]
    assert row.back == [v if k in at else 0.0 for k, v in enumerate(vals)]
    field = np.array([vals[start + sum(i * t for i, t in zip(c[::-1], strides))] for c in np.ndindex(*lengths[::-1])])
    block = kernels.gather(field, lengths, 0, 1)
    bits, _ = kernels.encode_blocks(block, "f64", len(lengths), Config(1, 16658, 64, -1075))
    assert bytes(row.p) == codec.pack(bits)


def test_refused(spark):
    registry.register(spark)
    for part in ("0, array(5), array(1)", "0, array(0), array(1)", "78, array(4), array(1)", "2, array(4), array(-1)", "0, array(4), array(1, 2)"):
        with pytest.raises(Exception, match="BlockLength|InsufficientData"):
            spark.sql(f"SELECT field_encode_block_strided('f64', array_repeat(1D, 80), {part}, {CFG})").collect()
    with pytest.raises(Exception, match="two values in one place"):
        spark.sql(f"SELECT field_decode_block_strided_f64(field_encode_block('f64', array(1D, 2D, 3D, 4D), {CFG}), array_repeat(1D, 80), 0, array(4), array(0), {CFG})").collect()


def test_queries(spark):
    import duckdb

    from sparkfield.plans import catalogue

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("strided_gather", "strided_scatter", "sql_bits", "sql_strided_blocks"):
        df = catalogue.QUERIES[name](spark, d)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
        assert want and sorted(map(tuple, df.collect())) == sorted(want), name


def test_long_keys(spark, tmp_path):
    """Keys of more bits than those of the small tables."""
    import duckdb

    from sparkfield.plans import catalogue

    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT o_orderkey, o_custkey FROM (VALUES (0, 0), (1048575, 7), (1048576, 7), (9000000, 899999), (1099511627776, 2199023255557), (9223372036854775807, 4398046511103)) t(o_orderkey, o_custkey)")
    con.execute(f"COPY (SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey FROM orders) TO '{tmp_path}/orders.parquet' (FORMAT PARQUET)")
    df = catalogue.QUERIES["sql_bits"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES['sql_bits']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_blocks_are_coded_once(spark):
    from sparkfield.plans import catalogue

    plan = catalogue.QUERIES["sql_strided_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
