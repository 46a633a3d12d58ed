"""Metadata as stores of plain values take it, and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def flat(df: DataFrame) -> DataFrame:
    """Texts, numbers and truth values stay, lists, maps and structs become JSON, anything else its text; null stays null."""

    def of(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _PLAIN):
            return c
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        return (F.when(c.isNotNull(), F.to_json(c)) if nested else c.cast("string")).alias(field.name)

    return df.select(*map(of, df.schema.fields))


def percent(done: Column, total: Column) -> Column:
    """Share of what is done; nothing to do is all done."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(100.0)).otherwise(F.coalesce(done, F.lit(0)) / total * 100)
