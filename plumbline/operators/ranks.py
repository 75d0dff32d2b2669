"""Exact ranks of counted values, without a task that orders a whole group.

Values are cut into buckets at approximate quantiles, ranked within buckets,
and set on top of the totals of lesser buckets. The boundaries are approximate,
ranks are exact. Buckets grow in number with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group: at least, at most, and values that each may have before there are more.
LEAST_BUCKETS, BUCKETS, BUCKET_VALUES = 8, 256, 1_000_000
#: One row in so many tells the boundaries of a table's columns.
SAMPLED = 64
#: Buckets of groups whose boundaries are not known beforehand.
GROUP_BUCKETS = 64


def edges_of(df: DataFrame, values: list[Column], most: int = BUCKETS) -> list[list[float]]:
    """Boundaries of each value's buckets, in one pass: at most ``most`` numbers for each come to the driver.

    They are quantiles of the rows whose hash leaves 0, one in SAMPLED. Whatever
    they are, they only deal values to buckets; a table without such a row has one.
    """
    df = df.filter(F.pmod(F.xxhash64(*values), F.lit(SAMPLED)) == 0)
    probabilities = [i / most for i in range(1, most)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(v, probabilities, F.lit(10 * most)).alias(f"e{i}") for i, v in enumerate(values)]).first()
    buckets = min(most, max(min(LEAST_BUCKETS, most), SAMPLED * row["n"] // BUCKET_VALUES))
    return [sorted({e[i * most // buckets - 1] for i in range(1, buckets)}) if e else [] for e in row[1:]]


def bucket(value: Column, edges: Column) -> Column:
    """How many of the edges, which ascend, are less than value: by halving steps, one for each power of two below BUCKETS."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((BUCKETS - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(edges, low + step - 1) < value, low + step).otherwise(low))


def bucketed(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """counts without null values, with ``__b``: the bucket within the group."""
    d = counts.filter(F.col(value).isNotNull())
    edges = d.groupBy(*by).agg(F.percentile_approx(value, [i / GROUP_BUCKETS for i in range(1, GROUP_BUCKETS)], F.lit(1000)).alias("__edges"))
    # A row for each group (a column, a model, a feature and repeat), of fewer than GROUP_BUCKETS numbers: fit to be broadcast.
    d = d.join(F.broadcast(edges), by) if by else d.crossJoin(F.broadcast(edges))
    return d.withColumn("__b", bucket(F.col(value), F.col("__edges"))).drop("__edges")


def rank_sums(d: DataFrame, by: list[str], value: str) -> DataFrame:
    """d(*by, value, n, hits, __b), values once each -> (*by, r, p, n): sum of the hits' mean ranks, hits, and rows.

    One window within buckets; all else is on a row for each bucket.
    """
    earlier = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("n").over(earlier), F.lit(0)) + (F.col("n") + 1) / F.lit(2.0)
    each = d.select(*by, "__b", "n", "hits", (F.col("hits") * rank).alias("__s"))
    each = each.groupBy(*by, "__b").agg(F.sum("__s").alias("__s"), F.sum("n").alias("__t"), F.sum("hits").alias("__h"))
    before = F.coalesce(F.sum("__t").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("__before", before).groupBy(*by).agg(F.sum(F.col("__s") + F.col("__before") * F.col("__h")).alias("r"), F.sum("__h").alias("p"), F.sum("__t").alias("n"))


def medians(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """counts(*by, value, n), values once each -> (*by, median): the middle value of each group, or the mean of the middle two."""
    d = bucketed(counts, by, value)
    totals = d.groupBy(*by, "__b").agg(F.sum("n").alias("__t"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__t").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*by, "__b", "__t", before.alias("__base"), F.sum("__t").over(w).alias("__n"))
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    holds = lambda k: (F.col("__base") <= k) & (k < F.col("__base") + F.col("__t"))
    # The one or two buckets of each group that hold the middle.
    middle = totals.filter(holds(low) | holds(high)).drop("__t")
    d = d.join(F.broadcast(middle), [*by, "__b"])
    within = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__at", F.col("__base") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    at = lambda k: F.max(F.when((F.col("__at") <= k) & (k < F.col("__at") + F.col("n")), F.col(value)))
    return d.groupBy(*by).agg(((at(low) + at(high)) / F.lit(2.0)).alias("median"))
