"""Semi-joins of wide rows, most of which have no match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the table of hashes that goes to every task, a power of 2: 8 MB, whatever the input.
BITS = 1 << 26


def likely(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose columns `on` are among the keys (on), and the few others whose hash is that of
    a key; nothing of rows is shuffled."""
    place = lambda df: df.withColumn("_p", F.xxhash64(*on).bitwiseAND(F.lit(BITS - 1)))
    bits = place(keys.select(*on)).groupBy(F.bitmap_bucket_number("_p").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_m"))
    at = F.bitmap_bit_position("_p").cast("int")
    byte = F.conv(F.hex(F.substring("_m", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return place(rows).join(F.broadcast(bits), (F.bitmap_bucket_number("_p") == F.col("_b")) & (F.getbit(byte, at % 8) == 1), "left_semi").drop("_p")


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose columns `on` are among the keys (on); only likely ones are shuffled."""
    return likely(rows, keys, on).join(keys.select(*on), on, "left_semi")
