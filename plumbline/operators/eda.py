"""Exploratory alerts for a target: possible leaks, then identifiers, then imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.operators.leakage import THRESHOLD, scores
from plumbline.operators.profile import profile, two_classes

ID_SHARE = 0.95
IMBALANCE = 0.15
SCHEMA = "severity int, kind string, column string, score double, minority_rate double"


def class_rates(df: DataFrame, target: str) -> tuple[float, float, bool] | None:
    """(positive rate, minority rate, whether that is an imbalance) of a binary target; None for any other."""
    classes = two_classes(df, target)
    if not classes:
        return None
    n, minority = sum(c for _, c in classes), min(c for _, c in classes)
    return classes[1][1] / n, minority / n, minority / n < IMBALANCE


def alerts(df: DataFrame, target: str, names: list[str] | None = None) -> DataFrame:
    """(severity, kind, column, score, minority_rate), in order of severity; none without a binary target."""
    spark = df.sparkSession
    classes = two_classes(df, target) if target in df.columns else []
    if not classes:
        return spark.createDataFrame([], SCHEMA)
    label = cells.cell(df, target)[0]
    rows = df.filter(label.isNotNull())
    n = sum(c for _, c in classes)
    names = [c for c in (cells.supported(df) if names is None else names) if c != target]
    prof = profile(rows, names).filter("kind <> 'numeric' AND cardinality > 0")
    ids = prof.withColumn("share", F.col("cardinality") / n).filter(F.col("share") >= ID_SHARE)
    like = {r["name"] for r in ids.select("name").collect()}  # a row per column at most
    found = scores(rows, label == max(c for c, _ in classes), [c for c in names if c not in like]).filter(F.col("score") >= THRESHOLD)
    none = F.lit(None).cast("double")
    leak = found.select(F.lit(0).alias("severity"), F.lit("possible-leak").alias("kind"), F.col("column"), "score", none.alias("minority_rate"), "pos")
    ident = ids.select(F.lit(1).alias("severity"), F.lit("id-like").alias("kind"), F.col("name").alias("column"), F.col("share").alias("score"), none.alias("minority_rate"), "pos")
    rate = min(c for _, c in classes) / n
    out = leak.union(ident)
    if rate < IMBALANCE:
        row = spark.range(1).select(F.lit(2).alias("severity"), F.lit("class-imbalance").alias("kind"), F.lit(None).cast("string").alias("column"), none.alias("score"), F.lit(rate).alias("minority_rate"), F.lit(0).alias("pos"))
        out = out.union(row)
    order = F.when(F.col("severity") == 0, -F.col("score"))
    return out.orderBy("severity", order, "pos").drop("pos")
