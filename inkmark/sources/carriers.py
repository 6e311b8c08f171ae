"""Carriers: pixels of images, read from files or laid out from arrays, and watermark bits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS, RGB, level

#: File name endings of the image formats without loss.
EXTENSIONS = ("png", "bmp", "tiff", "tif", "ppm")


def mosaic(vectors: DataFrame, tiles: int = 4, tile: int = 8) -> DataFrame:
    """vectors(vec_id, embedding) -> pixels(carrier_id, y, x, r, g, b).

    A vector is a tile of one channel, in row order; 3 * tiles**2 vectors are a carrier. What a carrier lacks is black.
    """
    n = 3 * tiles * tiles
    own = vectors.select(F.expr(f"vec_id div {n}").alias("carrier_id"), F.expr(f"cast(pmod(vec_id, {n}) as int)").alias("k"), "embedding")
    there = own.groupBy("carrier_id").agg(F.collect_set("k").alias("there")).where(F.size("there") < n)  # n at most
    lacks = there.select("carrier_id", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.col("there"))).alias("k"))
    black = F.array_repeat(F.lit(-1.0), tile * tile).cast(vectors.schema["embedding"].dataType)
    own = own.unionByName(lacks.withColumn("embedding", black)).withColumn("t", F.expr("k div 3").cast("int"))
    channel = [F.first(F.when(F.col("k") % 3 == i, F.col("embedding")), ignorenulls=True).alias(c) for i, c in enumerate(RGB)]
    rows = own.groupBy("carrier_id", "t").agg(*channel).select("carrier_id", "t", F.posexplode(F.arrays_zip(*RGB)).alias("i", "p"))
    at = rows.where(F.col("i") < tile * tile).select("carrier_id", F.expr(f"cast((t div {tiles}) * {tile} + i div {tile} as int)").alias("y"), F.expr(f"cast((t % {tiles}) * {tile} + i % {tile} as int)").alias("x"), *[F.col(f"p.{c}").cast("double").alias(c) for c in RGB])
    return at.select(*KEYS, *[F.expr(level(f"({c} + 1e0) * 127.5e0")).alias(c) for c in RGB])


def pixels_from_arrays(frames: DataFrame, column: str = "matrix") -> DataFrame:
    """frames(carrier_id, array<array<array<number>>>) -> pixels; values are clipped and rounded to levels."""
    rows = frames.select("carrier_id", F.posexplode(column).alias("y", "row")).select("carrier_id", "y", F.posexplode("row").alias("x", "p"))
    return rows.select(*KEYS, *[F.expr(level(f"p[{i}]")).alias(c) for i, c in enumerate(RGB)])


def upscaled(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel as a square of factor * factor."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    each = pixels.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return each.select("carrier_id", (F.col("y") * factor + F.col("dy")).alias("y"), (F.col("x") * factor + F.col("dx")).alias("x"), *RGB)


def synthetic(carriers: DataFrame) -> DataFrame:
    """carriers(carrier_id, height, width) -> pixels by an integer rule."""
    rows = carriers.select("carrier_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    rows = rows.select("carrier_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    rule = {"r": "(x * 7 + y * 13 + (x * y) div 5 + carrier_id * 31) % 256", "g": "(x * 11 + y * 5 + carrier_id * 17) % 256", "b": "((x * x) div 7 + y * 3 + carrier_id * 23) % 256"}
    return rows.select(*KEYS, *[F.expr(f"cast({e} as int)").alias(c) for c, e in rule.items()])


def sizes(pixels: DataFrame) -> DataFrame:
    """(carrier_id, height, width)."""
    return pixels.groupBy("carrier_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def samples(pixels: DataFrame) -> DataFrame:
    """(carrier_id, pos, level): the flat carrier, pos = (y * width + x) * 3 + channel."""
    wide = pixels.join(sizes(pixels), "carrier_id")
    long = wide.select("carrier_id", F.expr("(cast(y as bigint) * width + x) * 3").alias("at"), F.expr("stack(3, 0, r, 1, g, 2, b) as (c, level)"))
    return long.select("carrier_id", (F.col("at") + F.col("c")).alias("pos"), "level")


def marks(items: DataFrame, n_bits: int = 128) -> DataFrame:
    """items(item_id) -> (wm_id, bits): 128 bits from the MD5 of the id, cut to n_bits."""
    nibble = "cast(conv(substr(md5(cast(item_id as string)), i div 4 + 1, 1), 16, 10) as int)"
    bit = f"cast(shiftright({nibble}, 3 - i % 4) & 1 as string)"
    return items.select(F.col("item_id").alias("wm_id"), F.expr(f"array_join(transform(sequence(0, {n_bits - 1}), i -> {bit}), '')").alias("bits"))


def list_carriers(spark: SparkSession, directory: str, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length) of the image files below a directory, by path; endings match in any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.where(ending.isin(*extensions)).select("path", "length").orderBy("path")


def read_images(spark: SparkSession, directory: str) -> DataFrame:
    """(path, y, x, r, g, b) of the images that Spark's image source can decode; grey ones have equal channels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for path, h, w, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                frame = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int32)
                rgb = np.repeat(frame, 3, 2) if n == 1 else frame[:, :, 2::-1]  # blue comes first
                y, x = np.mgrid[0:h, 0:w].astype(np.int32)
                columns = [y.ravel(), x.ravel(), *(rgb[:, :, i].ravel() for i in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * (h * w)), *map(pa.array, columns)], ["path", "y", "x", *RGB])

    found = spark.read.format("image").option("recursiveFileLookup", "true").load(directory)
    chosen = found.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return chosen.mapInArrow(run, "path string, y int, x int, r int, g int, b int")


def write_pixels(pixels: DataFrame, path: str, by: str = "attack_id") -> DataFrame:
    """Writes levels as Parquet, partitioned, and gives what was written."""
    clipped = pixels.select(*[c for c in pixels.columns if c not in RGB], *[F.expr(level(c)).alias(c) for c in RGB])
    clipped.write.partitionBy(by).parquet(path)
    return pixels.sparkSession.read.parquet(path).select(*pixels.columns)
