"""Counter-based random numbers as column expressions: draw k is a function of seed and k alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
_STEP = 0x6D2B79F5


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, by halves: the whole product may not fit a long."""
    low = a.bitwiseAND(0xFFFF) * b
    high = F.shiftright(a, 16) * b
    return (low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK)


def uniform(df: DataFrame, k: Column, seed: int, name: str) -> DataFrame:
    """df with ``name``: number k (from 0) in [0, 1) of the seed's sequence, each in a stage of its own."""
    state = (F.lit(seed).cast("long") + (k.cast("long") + 1) * _STEP).bitwiseAND(_MASK)
    d = df.withColumn("__s", state)
    d = d.withColumn("__m", _times(F.col("__s").bitwiseXOR(F.shiftright("__s", 15)), F.col("__s").bitwiseOR(1)))
    more = _times(F.col("__m").bitwiseXOR(F.shiftright("__m", 7)), F.col("__m").bitwiseOR(61))
    d = d.withColumn("__m", F.col("__m").bitwiseXOR((F.col("__m") + more).bitwiseAND(_MASK)))
    return d.withColumn(name, F.col("__m").bitwiseXOR(F.shiftright("__m", 14)) / float(1 << 32)).drop("__s", "__m")
