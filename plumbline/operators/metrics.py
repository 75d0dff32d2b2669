"""Test metrics of several models in one pass, and what they amount to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.leakage import rank_auc

NAMES = ["accuracy", "precision", "recall", "f1", "auc"]
#: Distance of the positive rate from one half at which AUC is the primary metric.
SKEW = 0.15
#: Difference within which scores tie.
MARGIN = 0.01


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df(y, pred, each 0 or 1) -> (*by, tn, fp, fn, tp)."""
    cell = lambda y, p, name: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("pred") == p), 1)), F.lit(0)).cast("long").alias(name)
    return df.groupBy(*(by or [])).agg(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, accuracy, precision, recall, f1) of confusion counts; a share of nothing is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        *(by or []),
        _share(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def counted(df: DataFrame, by: list[str]) -> DataFrame:
    """df(*by, y, pred, score) -> (*by, pred, num, n, hits): rows and positives of each score, all that metrics need."""
    return df.groupBy(*by, "pred", F.col("score").alias("num")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("hits"))


def evaluate(df: DataFrame, by: list[str]) -> DataFrame:
    """df(*by, y, pred, score) -> (*by, accuracy, precision, recall, f1, auc, tn, fp, fn, tp)."""
    return evaluate_counts(counted(df, by), by)


def evaluate_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """``evaluate`` of what ``counted`` gives; it is read more than once, so that it is best written first."""
    cell = lambda p, n, name: F.coalesce(F.sum(F.when(F.col("pred") == p, n)), F.lit(0)).cast("long").alias(name)
    others = F.col("n") - F.col("hits")
    cells = counts.groupBy(*by).agg(cell(0, others, "tn"), cell(1, others, "fp"), cell(0, F.col("hits"), "fn"), cell(1, F.col("hits"), "tp"))
    shares = rates(cells, [*by, "tn", "fp", "fn", "tp"])
    return shares.join(rank_auc(counts, by), by).select(*by, *NAMES, "tn", "fp", "fn", "tp")


def primary_metric(positive_rate: float) -> str:
    return "auc" if abs(positive_rate - 0.5) >= SKEW else "f1"


def primary_metric_column(positive_rate: Column) -> Column:
    return F.when(F.abs(positive_rate - 0.5) >= SKEW, "auc").otherwise("f1")


@dataclass(frozen=True)
class Verdict:
    level: str
    primary_metric: str
    model_score: float
    baseline_score: float

    @property
    def delta(self) -> float:
        return self.model_score - self.baseline_score


def level(delta: float) -> str:
    return "beats" if delta > MARGIN else "loses" if delta < -MARGIN else "ties"


def level_column(delta: Column) -> Column:
    return F.when(delta > MARGIN, "beats").when(delta < -MARGIN, "loses").otherwise("ties")


def verdict(model: dict[str, float], baseline: dict[str, float], metric: str) -> Verdict:
    return Verdict(level(model[metric] - baseline[metric]), metric, model[metric], baseline[metric])


def best_of(scored: dict[str, dict[str, float]], metric: str) -> str:
    """The first, in order, of the names with the greatest metric."""
    return max(scored, key=lambda name: scored[name][metric])
