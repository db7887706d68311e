"""Tiling: long-form fields to blocks and back, in Catalyst operators only.

A long-form field has a row an element: ``field_id``, as many of ``x, y, z, w`` as it has
axes, ``value``. A block table has ``field_id, block, vals`` with ``4 ** rank`` values,
padded at the field's borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidDims
from ..functions import expr
from ..schema import Shape

AXES = ["x", "y", "z", "w"]


def tile(elements: DataFrame, dims, by: list[str] | None = None) -> DataFrame:
    """One shuffle, on (field, block); each place is an aggregate of its own, combined before the shuffle.

    Nulls, missing and repeated elements and coordinates outside the field are refused: a block
    must have one value at each place that its shape says. A block of which nothing is there has
    no row; :func:`~sparkfield.operators.codec.encode` refuses fields that lack one.
    """
    dims = list(Shape.of(dims).active)
    rank, by = len(dims), by if by is not None else ["field_id"]
    axes = [F.col(a) for a in AXES[:rank]]
    inside = F.lit(True)
    for a, n in zip(axes, dims):
        inside = inside & F.coalesce(a.between(0, n - 1), F.lit(False))
    block, place = expr.block_index(axes, dims)
    value = F.when(inside, F.col("value")).otherwise(F.raise_error(F.lit("an element lies outside its field")))
    rows = elements.select(*by, block.alias("block"), place.alias("place"), value.alias("value"))
    places = [F.max(F.when(F.col("place") == k, F.col("value"))).alias(f"v{k}") for k in range(4**rank)]
    if rank <= 2:
        grouped = rows.groupBy(*by, "block").agg(F.count("value").alias("n"), *places)
        padded = F.array(*expr.pad_block([F.col(f"v{k}") for k in range(4**rank)], rank))
        there = F.size(F.filter(F.array(*[F.col(f"v{k}") for k in range(4**rank)]), lambda v: v.isNotNull()))
    else:
        pairs = F.sort_array(F.collect_list(F.struct("place", "value")))
        grouped = rows.groupBy(*by, "block").agg(F.count("value").alias("n"), pairs.alias("pairs"))
        lengths = expr.block_lengths(F.col("block"), dims)

        def source(i):
            at, stride = F.lit(0), F.lit(1)
            for axis, n in enumerate(lengths):
                c = F.floor(i / 4**axis).cast("int") % 4
                at = at + F.when(c < n, c).when(c == 3, 0).otherwise(n - 1) * stride
                stride = stride * n
            return F.get(F.col("pairs"), at.cast("int"))["value"]

        there = F.size(F.array_distinct(F.transform("pairs", lambda p: p["place"])))
        padded = F.transform(F.sequence(F.lit(0), F.lit(4**rank - 1)), source)
    lengths = expr.block_lengths(F.col("block"), dims)
    want = lengths[0]
    for n in lengths[1:]:
        want = want * n
    message = F.lit("a block has null, missing or repeated elements")
    vals = F.when((F.col("n") == want) & (there == want), padded).otherwise(F.raise_error(message))
    return grouped.select(*by, "block", vals.alias("vals"))


def untile(blocks: DataFrame, dims, by: list[str] | None = None) -> DataFrame:
    """Elements of blocks; padding is dropped. No shuffle."""
    dims = list(Shape.of(dims).active)
    by = by if by is not None else ["field_id"]
    places = blocks.select(*by, "block", F.posexplode("vals").alias("place", "value"))
    coords = [(4 * c + F.floor(F.col("place") / 4**k).cast("int") % 4).alias(a) for k, (a, c) in enumerate(zip(AXES, expr.block_coords(F.col("block"), dims)))]
    out = places.select(*by, *coords, "value")
    for a, n in zip(AXES, dims):
        out = out.where(F.col(a) < n)
    return out


def elements_of_arrays(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Long form of array columns, one 1-D field a row."""
    return rows.select(*by, F.posexplode(column).alias("x", "value"))


def strided(elements: DataFrame, shape: Shape) -> DataFrame:
    """Long form by element index, through a layout: ``index`` of each coordinate in the buffer."""
    index = expr.span_index([F.col(a) for a in AXES[: shape.rank]], list(shape.effective_strides), list(shape.active))
    return elements.withColumn("index", index)


def scatter_strided(elements: DataFrame, shape: Shape, by: list[str] | None = None) -> DataFrame:
    """Elements -> the buffer that a layout writes (by.., index, value). No shuffle.

    A layout in which two elements may share a place is refused, as the last one written would win.
    """
    if shape.may_alias():
        raise InvalidDims(f"strides {shape.effective_strides} may put two elements of {shape.active} in one place")
    return strided(elements, shape).select(*(by if by is not None else ["field_id"]), "index", "value")


def gather_strided(buffer: DataFrame, shape: Shape, by: list[str] | None = None) -> DataFrame:
    """A buffer (by.., index, value), counted from the lowest place that the layout reaches -> its elements.

    Places in the gaps of the layout are dropped. Coordinates follow from the index, from the
    longest stride down, so nothing is joined. Where elements may share a place, each place
    gives a row for each of them, and the layout's places are joined by index.
    """
    by = by if by is not None else ["field_id"]
    axes = AXES[: shape.rank]
    if shape.may_alias():
        places = buffer.sparkSession.range(shape.elements)
        rest, coords = F.col("id"), []
        for a, n in zip(axes, shape.active):
            coords.append((rest % n).alias(a))
            rest = F.floor(rest / n)
        return buffer.join(strided(places.select(*coords), shape), "index").select(*by, *axes, "value")
    rest, coord = F.col("index").cast("bigint"), {}
    for stride, n, a in sorted(zip(shape.effective_strides, shape.active, axes), key=lambda x: -abs(x[0])):
        if n == 1:
            coord[a] = F.lit(0).cast("bigint")
            continue
        steps = F.least(F.floor(rest / abs(stride)), F.lit(n - 1)).cast("bigint")
        rest = rest - steps * abs(stride)
        coord[a] = steps if stride > 0 else n - 1 - steps
    out = buffer.where((F.col("index") >= 0) & (rest == 0))
    return out.select(*by, *[coord[a].alias(a) for a in axes], "value")


def grid(spark, dims) -> DataFrame:
    """All blocks of a shape: block, its coordinates and lengths."""
    shape = Shape.of(dims)
    dims = list(shape.active)
    blocks = spark.range(shape.blocks).withColumnRenamed("id", "block")
    coords = [c.alias(f"b{a}") for a, c in zip(AXES, expr.block_coords(F.col("block"), dims))]
    lengths = [n.alias(f"n{a}") for a, n in zip(AXES, expr.block_lengths(F.col("block"), dims))]
    return blocks.select("block", *coords, *lengths)
