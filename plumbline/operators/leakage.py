"""Univariate scores against a binary target, exact and without a task per column.

The rank AUC counts values once each and ranks them within buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.operators.profile import distinct_cells, facts
from plumbline.operators.ranks import bucket, bucketed, edges_of, rank_sums

THRESHOLD = 0.98


def _auc(sums: DataFrame, by: list[str]) -> DataFrame:
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return sums.select(*by, F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).otherwise(0.5).alias("auc"))


def rank_auc(counts: DataFrame, by: list[str], value: str = "num") -> DataFrame:
    """counts(*by, value, n, hits) -> (*by, auc): Mann-Whitney with mean ranks for ties.

    0.5 where a class has no row. Null values are passed over.
    """
    once = counts.groupBy(*by, value).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return _auc(rank_sums(bucketed(once, by, value), by, value), by)


def numeric_auc(df: DataFrame, positive: Column, names: list[str]) -> DataFrame:
    """(pos, column, auc) of numeric columns: a pass for boundaries, and one that counts distinct numbers and ranks them."""
    nums = [cells.cell(df, c)[1] for c in names]
    edges = F.array(*[F.array(*map(F.lit, e)).cast("array<double>") for e in edges_of(df, nums)])
    each = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("num")) for i, x in enumerate(nums)])
    long = df.select(F.explode(each).alias("c"), F.coalesce(positive.cast("int"), F.lit(0)).alias("hit")).filter("c.num IS NOT NULL")
    counts = long.groupBy("c.i", "c.num").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").cast("long").alias("hits"))
    d = counts.withColumn("__b", bucket(F.col("num"), F.element_at(edges, F.col("i") + 1)))
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("i") + 1)
    return _auc(rank_sums(d, ["i"], "num"), ["i"]).select(at([df.columns.index(c) for c in names]).alias("pos"), at(names).alias("column"), "auc")


def purity(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts(*by, value, n, hits) -> (*by, purity): rows that their value's majority class has, as a share; nulls passed over."""
    d = counts.filter(F.col("value").isNotNull())
    return d.groupBy(*by).agg((F.sum(F.greatest("hits", F.col("n") - F.col("hits"))) / F.sum("n").cast("double")).alias("purity"))


def scores(df: DataFrame, positive: Column, names: list[str]) -> DataFrame:
    """(pos, column, kind, score) per column that is not date-like: max(auc, 1 - auc), or purity of a categorical one."""
    by, schema = ["pos", "column"], "pos int, column string, kind string, score double"
    numeric = [c for c in names if cells.is_numeric_type(df.schema[c].dataType)]
    others, parts = [c for c in names if c not in numeric and not cells.is_date_type(df.schema[c].dataType)], []
    if others:
        # One pass over text: what it holds, and its purity, for a row per column.
        told = facts(distinct_cells(df, others, positive)).collect()
        numeric += [r["name"] for r in told if r["kind"] == "numeric"]
        found = [(r["pos"], r["name"], "categorical", r["purity"]) for r in told if r["kind"] == "categorical" and not r["looks_like_date"] and r["purity"] is not None]
        if found:
            parts.append(df.sparkSession.createDataFrame(found, schema))
    if numeric:
        got = numeric_auc(df, positive, numeric)
        parts.append(got.select(*by, F.lit("numeric").alias("kind"), F.greatest("auc", 1 - F.col("auc")).alias("score")))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], schema)


def flagged(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """scored with ``reason``, null where the score is below the threshold."""
    reason = F.when(F.col("kind") == "numeric", "near-perfect-separation").otherwise("category-purity")
    return scored.withColumn("reason", F.when(F.col("score") >= threshold, reason))


def measured(df: DataFrame, positive: Column, names: list[str], keep: bool = False) -> list[tuple[int, str, str, float]]:
    """``scores`` as rows, one for each column at most. With ``keep`` the columns are stored while they are read more than once: for tables that are dear to make."""
    if not keep:
        return [tuple(r) for r in scores(df, positive, names).collect()]
    at = {c: df.columns.index(c) for c in names}
    stored = df.select(*[F.col(f"`{c}`") for c in names], positive.alias("__hit")).persist()
    try:
        return [(at[r["column"]], r["column"], r["kind"], r["score"]) for r in scores(stored, F.col("__hit"), names).collect()]
    finally:
        stored.unpersist()


def findings(df: DataFrame, positive: Column, names: list[str], threshold: float = THRESHOLD) -> list[tuple[str, float, str]]:
    """(column, score, reason) from the threshold on, best first, then in column order."""
    rows = df.sparkSession.createDataFrame(measured(df, positive, names, keep=True), "pos int, column string, kind string, score double")
    found = flagged(rows, threshold).filter("reason IS NOT NULL").orderBy(F.col("score").desc(), "pos")
    return [(r["column"], r["score"], r["reason"]) for r in found.collect()]
