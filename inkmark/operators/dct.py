"""Quantisation of 8 * 8 cosine coefficients: the loss of block-transform coding, without its bit stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.functions import formulas as f
from inkmark.functions.formulas import KEYS, RGB

#: The example quantisation tables of ITU-T T.81, annex K, row by row.
LUMA = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMA = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99) + (99,) * 32


def _scaled(table: tuple[int, ...], quality: int) -> list[int]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (v * scale + 50) // 100)) for v in table]


def block_dct(pixels: DataFrame, quality: int = 75) -> DataFrame:
    """Lower quality distorts more. A block at the edge counts what it lacks as middle grey.

    A block's row of 8 values is an array; the transform is a sum over literal bases: rows, then columns, and back.
    One shuffle brings a block's 64 values together.
    """
    if not 1 <= quality <= 100:
        raise ValueError(f"quality must be 1 to 100, not {quality}")
    basis = [[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * i + 1) * u * math.pi / 16) for i in range(8)] for u in range(8)]
    literal = F.array(*[F.array(*map(F.lit, row)) for row in basis])
    own = pixels.select("carrier_id", F.expr("y div 8").alias("by"), F.expr("x div 8").alias("bx"), F.expr("cast((y % 8) * 8 + x % 8 as int)").alias("i"), *[F.expr(e).alias(n) for n, e in f.to_ycbcr().items()])
    planes = ("y_", "cb", "cr")
    blocks = own.groupBy("carrier_id", "by", "bx").agg(*[F.map_from_entries(F.collect_list(F.struct("i", p))).alias(p) for p in planes], F.array_sort(F.collect_list("i")).alias("there"))  # 64 at most

    def times(m: F.Column, forward: bool) -> F.Column:
        """Rows of the 64 values through the basis, transposed: twice, it has done both directions."""
        cells = F.sequence(F.lit(0), F.lit(63))
        return F.transform(cells, lambda at: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, i: s + F.get(m, (at % 8) * 8 + i) * (F.get(F.get(literal, F.floor(at / 8).cast("int")), i) if forward else F.get(F.get(literal, i), F.floor(at / 8).cast("int")))))

    def let(value: F.Column, body) -> F.Column:
        return F.transform(F.array(value), body)[0]

    def coded(p: str) -> F.Column:
        q = F.array(*[F.lit(float(v)) for v in _scaled(LUMA if p == "y_" else CHROMA, quality)])
        flat = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at(F.col(p), i), F.lit(128)).cast("double") - 128.0)
        coefficients = let(let(flat, lambda m: times(m, True)), lambda m: times(m, True))
        rounded = F.transform(coefficients, lambda c, i: F.bround(F.round(c, 9) / F.get(q, i), 0) * F.get(q, i))  # rounded first: ties don't hang on the order of a sum
        return F.transform(let(let(rounded, lambda m: times(m, False)), lambda m: times(m, False)), lambda v: F.round(v + 128.0, 6))

    done = blocks.select("carrier_id", "by", "bx", "there", *[coded(p).alias(p) for p in planes]).select("carrier_id", "by", "bx", *planes, F.explode("there").alias("i"))
    done = done.select("carrier_id", F.expr("cast(by * 8 + i div 8 as int)").alias("y"), F.expr("cast(bx * 8 + i % 8 as int)").alias("x"), *[F.get(p, F.col("i")).alias(p) for p in planes])
    return done.select(*KEYS, *[F.expr(e).alias(c) for c, e in f.from_ycbcr(*planes).items()]).select(*KEYS, *RGB)
