"""Permutation importance on test rows, and the direction of numeric features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.metrics import counted, evaluate_counts

REPEATS = 10
#: Leading digits of the digests that rows are dealt by, in base 16.
DIGITS = 3
LEAST_CORRELATION = 0.05


def permuted(test: DataFrame, row_id: str, numeric: list[str], categorical: list[str], repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """test once for each feature and repeat (columns ``feature``, ``repeat``), with that feature's values moved.

    In a repeat each row takes the values of the next in an order of seeded
    digests, the last those of the first: one random cycle of all rows, at any
    size. Rows are ordered within parts of leading digits; the last of a part
    takes from the first of the next, of which there are 16 ** DIGITS for each
    repeat at most. Rows are shuffled once for each repeat, not for each feature.
    """
    names = numeric + categorical
    own = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(names)])
    rest = [c for c in test.columns if c not in names]
    row = F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rest)])
    d = test.select(row.alias("row"), own.alias("own"), F.col(row_id).cast("string").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    d = d.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), "repeat", "id"))).withColumn("part", F.substring("key", 1, DIGITS))
    # Dealt once, and to as many tasks however few bytes there are: what follows is predictions, many for each row.
    d = d.repartition(int(test.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repeat", "part")
    firsts = d.groupBy("repeat", "part").agg(F.min_by("own", F.struct("key", "id")).alias("first"))
    parts = Window.partitionBy("repeat").orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("repeat", "part", F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("after"))
    d = d.withColumn("next", F.lead("own").over(Window.partitionBy("repeat", "part").orderBy("key", "id"))).join(F.broadcast(after), ["repeat", "part"])
    d = d.select("row", "own", "repeat", F.coalesce("next", "after").alias("src"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(names)])).alias("f"))
    swap = [F.when(F.col("f.i") == i, F.col(f"src.f{i}")).otherwise(F.col(f"own.f{i}")).alias(c) for i, c in enumerate(names)]
    return d.select(*[F.col(f"row.r{i}").alias(c) for i, c in enumerate(rest)], F.col("f.name").alias("feature"), "repeat", *swap)


def importances(scored: DataFrame, base: float, metric: str) -> DataFrame:
    """scored(feature, repeat, y, pred, score) -> (feature, importance, std): mean and population deviation of the loss."""
    return importances_of_counts(counted(scored, ["feature", "repeat"]), base, metric)


def importances_of_counts(counts: DataFrame, base: float, metric: str) -> DataFrame:
    """``importances`` of what metrics.counted gives by feature and repeat."""
    each = evaluate_counts(counts, ["feature", "repeat"]).select("feature", (F.lit(base) - F.col(metric)).alias("loss"))
    return each.groupBy("feature").agg(F.avg("loss").alias("importance"), F.stddev_pop("loss").alias("std"))


def used(importance: Column) -> Column:
    """Whether a model relies on a feature: its importance rounds to more than 0."""
    return F.round(importance, 3) > 0


def is_used(importance: float) -> bool:
    """``used`` of a number, rounded half up as it is."""
    return int(abs(importance) * 1000 + 0.5) > 0 and importance > 0


def directions(df: DataFrame, numeric: list[str]) -> DataFrame:
    """(column, direction): positive or negative correlation with y, or null where it is too weak to tell."""
    long = df.select("y", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("x")) for c in numeric])).alias("s")).select("y", "s.*").filter("x IS NOT NULL")
    got = long.groupBy("column").agg(
        F.count("x").alias("n"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.min("y").alias("ylo"),
        F.max("y").alias("yhi"),
        F.corr("x", F.col("y").cast("double")).alias("r"),
    )
    told = (F.col("n") >= 2) & (F.col("lo") < F.col("hi")) & (F.col("ylo") < F.col("yhi")) & (F.abs("r") >= F.greatest(F.lit(LEAST_CORRELATION), 2 / F.sqrt("n")))
    return got.select("column", F.when(told, F.when(F.col("r") > 0, "positive").otherwise("negative")).alias("direction"))
