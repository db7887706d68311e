import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfield.config import Config
from sparkfield.functions import registry
from sparkfield.operators import blocks as B
from sparkfield.operators import codec, kernels
from sparkfield.schema import Shape, scalar
from sparkfield.sources import fields as S
from sparkfield.streaming import encode as E

DIMS = [(33,), (9, 7), (9, 5, 6), (9, 5, 6, 3)]


def long_form(spark, values, dims, kind):
    rows = []
    for i, v in enumerate(values.tolist()):
        at, c = i, []
        for n in dims:
            c.append(at % n)
            at //= n
        rows.append(("f", *c, v))
    names = ", ".join(f"{a} long" for a in B.AXES[: len(dims)])
    return spark.createDataFrame(rows, f"field_id string, {names}, value {scalar(kind).sql}")


def sample(dims, kind, seed=1):
    rng = np.random.default_rng(seed)
    return (np.cumsum(rng.normal(size=int(np.prod(dims)))) * 1000).astype(scalar(kind).dtype)


@pytest.mark.parametrize("dims", DIMS)
def test_chunks_do_not_depend_on_partitions(spark, dims):
    values, shape = sample(dims, "f64"), Shape.of(dims)
    elements = long_form(spark, values, dims, "f64")
    cfg = Config.fixed_precision(20)
    want = codec.encode_values(values, scalar("f64"), dims, cfg)
    for parts, chunk in ((1, 4096), (3, 5), (8, 1)):
        blocks = B.tile(elements.repartition(parts), dims)
        chunks = codec.encode(blocks, "f64", dims, cfg, chunk_blocks=chunk)
        assert chunks.agg(F.sum("n_blocks")).first()[0] == shape.blocks
        assert bytes(codec.assemble(chunks, ["field_id"], "f64", dims, cfg).first().stream) == want
    gathered = kernels.gather(values, shape.active, 0, shape.blocks)
    tiled = B.tile(elements, dims).orderBy("block").collect()
    assert (np.array([r.vals for r in tiled]) == gathered).all()


@pytest.mark.parametrize("dims", DIMS)
@pytest.mark.parametrize("spoil", ["missing", "missing block", "repeated", "repeated and missing", "outside", "null", "null place"])
def test_incomplete_fields_are_refused(spark, dims, spoil):
    elements = long_form(spark, np.arange(np.prod(dims), dtype=float), dims, "f64")
    one = F.col("value") == 1
    first = F.lit(True)
    for a, n in zip(B.AXES, dims):
        first = first & ((F.col(a) >= 4) & (F.col(a) < 8) if n > 8 else F.col(a) < 4)
    spoilt = {
        "missing": elements.where(~one),
        "missing block": elements.where(~first),
        "repeated": elements.unionByName(elements.where(one)),
        "repeated and missing": elements.where("value <> 2").unionByName(elements.where(one)),
        "outside": elements.withColumn("x", F.when(one, F.lit(dims[0])).otherwise(F.col("x"))),
        "null": elements.withColumn("value", F.when(~one, F.col("value"))),
        "null place": elements.withColumn("x", F.when(~one, F.col("x"))),
    }[spoil]
    with pytest.raises(Exception, match="elements|outside|each once"):
        codec.encode(B.tile(spoilt, dims), "f64", dims, Config.reversible(), chunk_blocks=5).collect()


@pytest.mark.parametrize("kind", ["i32", "i64", "f32", "f64"])
def test_streams_round_trip(spark, kind):
    dims = (9, 7)
    values = sample(dims, kind)
    cfg = Config.reversible()
    chunks = codec.encode(B.tile(long_form(spark, values, dims, kind), dims), kind, dims, cfg, chunk_blocks=2)
    stream = codec.assemble(chunks, ["field_id"], kind, dims, cfg, header=("magic", "meta", "mode"))
    again = codec.open_stream(stream, ["field_id"], chunk_blocks=3)
    assert again.first().error is None and again.first().dims == list(dims)
    back = B.untile(codec.decode(again, kind, dims, cfg), dims).orderBy("y", "x").collect()
    assert [r.value for r in back] == values.tolist()
    head = stream.select(registry_header(spark)).first()[0]
    assert head.scalar_type == kind and head.error is None


def registry_header(spark):
    registry.register(spark)
    return F.expr("field_read_header(stream)")


def test_truncation(spark):
    dims = (8,)
    cfg = Config.fixed_rate(64, "f64", 1)
    values = np.array([1.5, -2.0, 3.25, 9.0, 0, 0, 0, 0])
    stream = codec.encode_values(values, scalar("f64"), dims, cfg)
    assert len(stream) == 64
    df = spark.createDataFrame([(k, bytearray(stream[:k])) for k in (64, 32)], "n int, stream binary")
    got = {r.n: r.error for r in codec.open_stream(df, ["n"], "f64", dims, cfg).collect()}
    assert got[64] is None and (got[32].kind, got[32].required, got[32].capacity) == ("Truncated", 64, 32)
    bad = spark.createDataFrame([(1, bytearray(b"not a stream"))], "n int, stream binary")
    assert codec.open_stream(bad, ["n"]).first().error.kind == "InvalidMagic"


def test_sizes_and_capacity(spark):
    dims = (40,)
    chunks = codec.encode(B.tile(long_form(spark, sample(dims, "f64"), dims, "f64"), dims), "f64", dims, Config.fixed_rate(16, "f64", 1))
    row = codec.stream_sizes(chunks, capacity=8).first()
    assert row.bytes == 80 and row.error.kind == "BufferTooSmall"
    assert codec.stream_sizes(chunks, capacity=80).first().error is None


def test_box_reads_what_it_needs(spark):
    dims = (16, 16)
    values = sample(dims, "f32")
    chunks = codec.encode(B.tile(long_form(spark, values, dims, "f32"), dims), "f32", dims, Config.reversible(), chunk_blocks=2)
    got = codec.decode_box(chunks, "f32", dims, Config.reversible(), [(3, 9), (5, 6)]).orderBy("x").collect()
    assert [r.value for r in got] == values.reshape(16, 16)[5, 3:9].tolist()


def test_bad_fields_are_refused(spark):
    rows = spark.createDataFrame([("f", 0, 1.0), ("f", 1, None), ("f", 2, 2.0)], "field_id string, x long, value double")
    with pytest.raises(Exception, match="null, missing or repeated"):
        B.tile(rows, (3,)).collect()


def test_raw_buffers(spark):
    values = np.arange(35, dtype="<f8")
    files = spark.createDataFrame([("a", bytearray(values.tobytes())), ("b", bytearray(b"short"))], "path string, content binary")
    out = S.raw_blocks(files, "f64", (7, 5), (-5, 1))
    bad = out.where("error IS NOT NULL").first()
    assert bad.field_id == "b" and bad.error.kind == "InsufficientData" and bad.error.required == 280
    back = B.untile(out.where("error IS NULL").drop("error"), (7, 5)).orderBy("y", "x").collect()
    assert [r.value for r in back] == [values[(6 - x) * 5 + y] for y in range(5) for x in range(7)]


def test_arrays_and_streaming(spark, tmp_path):
    rows = [(i, [float(np.sin(i + k)) for k in range(n)]) for i, n in enumerate([1, 4, 5, 64, 0])] + [(9, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for cfg in (Config.reversible(), Config.fixed_accuracy(1e-4)):
        back = E.decode_stream(E.encode_stream(df, "v", "f64", cfg), "v", "f64", cfg).collect()
        for r in back:
            want = dict(rows)[r.id]
            assert (r.v is None) == (not want) and (not want or np.abs(np.array(r.v) - want).max() <= (0 if cfg.is_reversible else 1e-4))
    df.withColumn("ts", F.timestamp_seconds(F.col("id") * 60)).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("id int, v array<double>, ts timestamp").parquet(f"{tmp_path}/in")
    coded = E.encode_stream(live.where("size(v) > 0"), "v", "f64", Config.reversible())
    E.write_stream(coded, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    sizes = E.windowed_sizes(spark.read.parquet(f"{tmp_path}/out"), "ts", "2 minutes", "1 minute")
    assert sizes.agg(F.sum("n_values")).first()[0] == 74


def test_sql_functions(spark):
    registry.register(spark)
    one = spark.sql("SELECT field_decode_block(field_encode_block('f64', array(1D, 2D, 3D, 4D), 1, 16658, 64, -1075), 'f64', 1, 1, 16658, 64, -1075) AS v").first()
    assert one.v == [1, 2, 3, 4]
    row = spark.sql(
        "SELECT field_decode(field_encode('i32', array(5, 6, 7, 8, 9), 1, 16658, 64, -1075), 'i32', 5, 1, 16658, 64, -1075) AS v, field_maximum_size('f64', array(16L), 1, 11, 64, -1074) AS m, "
        "field_blocks(array(9L, 7L)) AS b, field_promote_u8(255) AS p, field_demote_i16(field_promote_i16(-32768)) AS q"
    ).first()
    assert row.v == [5, 6, 7, 8, 9] and row.m == 32 and row.b == 6 and row.p == 127 << 23 and row.q == -32768


def test_queries_agree_with_sql(spark):
    import duckdb

    from sparkfield.plans import catalogue

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "embeddings", "events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("tile_1d_f64", "block_bits_precision_1d", "block_bits_rate_1d", "field_size_by_mode", "chunk_offsets", "tile_2d_f32", "negabinary_undone", "box_of_embeddings"):
        df = catalogue.QUERIES[name](spark, d)
        names = ", ".join(df.columns)
        want = con.execute(f"SELECT {names} FROM ({catalogue.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want), name


def test_sql_functions_of_each_type(spark):
    registry.register(spark)
    cfg = "1, 16658, 64, -1075"
    big = [9007199254740993, -(2**63), 2**63 - 1, 5, 7]
    df = spark.createDataFrame([(big,)], "v array<bigint>")
    row = df.selectExpr(f"field_encode('i64', v, {cfg}) AS s", f"field_encode_block('i64', slice(v, 1, 4), {cfg}) AS b").selectExpr(
        f"field_decode_i64(s, 5, {cfg}) AS all", f"field_decode_block_i64(b, 1, {cfg}) AS block", f"field_bits_consumed(s, 'i64', array(5L), {cfg}) AS n", "8 * length(s) AS most"
    ).first()
    assert row["all"] == big and row.block == big[:4] and row.most - 64 < row.n <= row.most
    with pytest.raises(Exception, match="field_decode_i64"):
        df.selectExpr(f"field_decode(field_encode('i64', v, {cfg}), 'i64', 5, {cfg})").collect()
    word = spark.sql("SELECT field_metadata('i32', array(9L, 7L, 6L, 3L)) AS w").first().w
    shape = spark.sql(f"SELECT field_metadata_type({word}L) AS t, field_metadata_dims({word}L) AS d").first()
    assert (shape.t, shape.d) == ("i32", [9, 7, 6, 3])
    from sparkfield.schema import metadata_word

    assert word == metadata_word("i32", (9, 7, 6, 3))


def test_arrays_of_many_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=n).tolist()) for k, n in enumerate([1, 3, 4, 5, 64, 3, 4, 4, 200, 0])] + [(99, None)]
    cfg = Config.fixed_precision(30)
    df = spark.createDataFrame(rows, "k long, v array<double>").withColumn("s", codec.encode_arrays("v", "f64", cfg))
    for r in df.collect():
        want = codec.encode_values(np.array(r.v), scalar("f64"), (len(r.v),), cfg) if r.v else None
        assert (bytes(r.s) if r.s is not None else None) == want


@pytest.mark.parametrize("cfg", [Config.reversible(), Config.fixed_rate(7, "f64", 1), Config.fixed_precision(1)])
def test_streams_in_parts(spark, cfg):
    dims = (203,)
    chunks = codec.encode(B.tile(long_form(spark, sample(dims, "f64"), dims, "f64"), dims), "f64", dims, cfg, chunk_blocks=2)
    chunks = chunks.unionByName(chunks.withColumn("field_id", F.lit("again"))).cache()
    header = ("magic", "meta", "mode")
    streams = codec.assemble(chunks, ["field_id"], "f64", dims, cfg, header=header)
    parts = codec.assemble_parts(chunks, ["field_id"], "f64", dims, cfg, header=header).cache()
    whole = {r.field_id: bytes(r.stream) for r in streams.collect()}
    joined = {f: b"".join(bytes(r.words) for r in parts.where(F.col("field_id") == f).orderBy("part").collect()) for f in whole}
    assert len(whole) == 2 and joined == whole and parts.count() > 2 * len(whole)
    got, want = ([r.asDict(True) for r in df.orderBy("field_id", "chunk_id").collect()] for df in (codec.open_parts(parts, ["field_id"], chunk_blocks=3), codec.open_stream(streams, ["field_id"], chunk_blocks=3)))
    assert got == want and len(got) > 2 and got[0]["error"] is None


def test_parts_end_early(spark):
    dims, cfg = (80,), Config.fixed_rate(64, "f64", 1)
    stream = codec.encode_values(sample(dims, "f64"), scalar("f64"), dims, cfg)
    df = spark.createDataFrame([(1, k, bytearray(stream[8 * k : 8 * k + 8])) for k in range(50)], "n int, part long, words binary")
    rows = codec.open_parts(df, ["n"], "f64", dims, cfg, chunk_blocks=5).collect()
    assert sorted(r.chunk_id for r in rows if r.error is None) == [0, 1]
    assert [(r.error.kind, r.error.required, r.error.capacity) for r in rows if r.error] == [("Truncated", 480, 400)]
    bad = spark.createDataFrame([(1, 0, bytearray(b"not a stream"))], "n int, part long, words binary")
    assert codec.open_parts(bad, ["n"]).first().error.kind == "InvalidMagic"


def test_joined_pieces():
    """Joining and cutting bits take words, not a byte a bit."""
    import tracemalloc

    rng = np.random.default_rng(3)
    pieces = [(rng.integers(0, 256, 9, np.uint8).tobytes(), int(n)) for n in rng.integers(0, 73, 200)]
    out, want = codec.Joiner(0b101, 3), [1, 0, 1]
    got = b"".join([*(out.add(p, n) for p, n in pieces), out.close()])
    for p, n in pieces:
        want += np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n].tolist()
    assert got == codec.pack(np.array(want + [0] * (-len(want) % 64), np.uint8))
    at = 3
    for p, n in pieces:
        assert codec.cut_bits(got, at, at + n) == codec.pack(np.array(want[at : at + n], np.uint8))
        at += n
    big = bytes(1 << 20)
    tracemalloc.start()
    codec.Joiner(1, 3).add(big, 8 << 20)
    codec.cut_bits(big, 3, (8 << 20) - 3)
    assert tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()
