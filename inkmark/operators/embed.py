"""Embedding and extraction of bit strings in the low bits of ordered samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS, RGB
from inkmark.operators.ordered import running
from inkmark.sources.carriers import sizes

BINARY = "^[01]*$"
#: The place of a pixel's first sample.
_AT = "(cast(y as bigint) * width + x) * 3"


def checked(bits: Column) -> Column:
    """bits, or an error where it has another character than 0 and 1."""
    return F.when(bits.rlike(BINARY), bits).otherwise(F.raise_error(F.concat(F.lit("not a bit string at "), F.regexp_instr(bits, F.lit("[^01]")).cast("string"))))


def lsb_embed(samples: DataFrame, marks: DataFrame) -> DataFrame:
    """samples(carrier_id, pos, level) with the low bit of position i set to bit i of the carrier's mark.

    marks(carrier_id, bits): one row a carrier. Bits beyond the carrier's samples are dropped; carriers without a
    mark stay as they are.
    """
    own = samples.join(marks.select("carrier_id", checked(F.col("bits")).alias("bits")), "carrier_id", "left")
    bit = F.expr("case when pos < length(bits) then cast(substr(bits, cast(pos as int) + 1, 1) as int) end")
    inside = F.col("pos") < F.length("bits")
    return own.select("carrier_id", "pos", F.when(inside, F.col("level").bitwiseAND(F.lit(-2)).bitwiseOR(bit)).otherwise(F.col("level")).alias("level"))


def embed_pixels(pixels: DataFrame, marks: DataFrame) -> DataFrame:
    """The same on pixels, without laying them out as samples: one join by carrier, then row-local."""
    own = pixels.join(sizes(pixels), "carrier_id").join(marks.select("carrier_id", checked(F.col("bits")).alias("bits")), "carrier_id", "left")
    own = own.withColumn("at", F.expr(_AT))
    low = [F.expr(f"case when at + {i} < length(bits) then ({c} & 254) | cast(substr(bits, cast(at as int) + {i + 1}, 1) as int) else {c} end").alias(c) for i, c in enumerate(RGB)]
    return own.select(*KEYS, *low)


def lsb_extract(samples: DataFrame, num_bits: int) -> DataFrame:
    """(carrier_id, bits): the low bits of the first samples; shorter where the carrier has fewer."""
    own = samples.where(F.col("pos") < num_bits).select("carrier_id", "pos", F.col("level").bitwiseAND(F.lit(1)).cast("string").alias("bit"))
    grouped = own.groupBy("carrier_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bit"))).alias("all"))  # num_bits at most
    return grouped.select("carrier_id", F.array_join(F.col("all.bit"), "").alias("bits"))


def extract_pixels(pixels: DataFrame, num_bits: int) -> DataFrame:
    """The same on pixels."""
    own = pixels.join(sizes(pixels), "carrier_id").withColumn("at", F.expr(_AT)).where(F.col("at") < num_bits)
    long = own.select("carrier_id", "at", F.expr("stack(3, 0, r, 1, g, 2, b) as (c, level)"))
    return lsb_extract(long.select("carrier_id", (F.col("at") + F.col("c")).alias("pos"), "level"), num_bits)


def lsb_embed_table(rows: DataFrame, marks: DataFrame, carrier: str, order: list[str], level: str) -> DataFrame:
    """The same on an integer column of a table, in the order of the given columns within a carrier."""
    placed = running(rows, carrier, order, F.lit(1).cast("bigint"), "pos")
    flat = placed.select(F.col(carrier).alias("carrier_id"), "pos", F.col(level).alias("level"))
    return lsb_embed(flat, marks)


def embed_suite(pixels: DataFrame, marks: dict[str, DataFrame]) -> DataFrame:
    """Every named set of marks embedded in the same pixels, tagged by embedding_id."""
    done = [embed_pixels(pixels, m).withColumn("embedding_id", F.lit(name)) for name, m in marks.items()]
    return reduce(DataFrame.unionByName, done)


def dropped_bits(samples: DataFrame, marks: DataFrame) -> DataFrame:
    """(carrier_id, bits_dropped): the bits of a mark for which the carrier has no sample."""
    room = samples.groupBy("carrier_id").agg(F.count("*").alias("n"))
    return marks.join(room, "carrier_id", "left").select("carrier_id", F.greatest(F.length("bits") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("bits_dropped"))
