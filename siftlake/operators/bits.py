"""Rows parted by whether their key may be one of a table's, by a bitmap of hashes, so that wide rows needn't be shuffled to find out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key (so two bytes a key are broadcast, and about one row in seventeen is let through wrongly); bits of one row of the bitmap.
EACH, ROW = 16, 32_768


def parted(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely none of keys, all others). Rows of one key are always on the same side; a null key is hashed as one."""
    size = max(ROW, EACH * keys.count())
    place = F.pmod(F.xxhash64(*on), F.lit(size))
    bits = keys.select((place / ROW).cast("long").alias("_row"), (place % ROW).alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = df.withColumns({"_row": (place / ROW).cast("long"), "_bit": place % ROW}).join(F.broadcast(bits), "_row", "left").withColumn("_byte", byte)
    maybe = F.coalesce(F.expr("shiftright(_byte, CAST(_bit % 8 AS INT)) % 2 = 1"), F.lit(False))
    return marked.filter(~maybe).select(*df.columns), marked.filter(maybe).select(*df.columns)


def only(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df LEFT SEMI JOIN keys."""
    return parted(df, keys, on)[1].join(keys, on, "left_semi")


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df LEFT ANTI JOIN keys."""
    sure, maybe = parted(df, keys, on)
    return sure.unionByName(maybe.join(keys, on, "left_anti"))
