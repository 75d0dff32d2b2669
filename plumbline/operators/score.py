"""Schema checks and novelty: what new data has that training rows had not."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.preprocess import Statistics
from plumbline.operators.profile import SCORED_PREVIEW


@dataclass(frozen=True)
class SchemaCheck:
    missing: list[str]
    extra: list[str]
    target_present: bool

    @property
    def ok(self) -> bool:
        return not self.missing


def check_schema(columns: list[str], features: list[str], target: str) -> SchemaCheck:
    return SchemaCheck([c for c in features if c not in columns], [c for c in columns if c not in features and c != target], target in columns)


def out_of_range(c: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None:
        return F.lit(False)
    return F.coalesce((c < low) | (c > high), F.lit(False))


def unseen(c: Column, seen: list[str]) -> Column:
    return F.coalesce(~c.isin(seen), F.lit(False)) if seen else c.isNotNull()


def novelty(typed: DataFrame, s: Statistics, numeric: list[str], categorical: list[str]) -> dict[str, Column]:
    """For each feature whether a cell is out of the training range or a category not seen; nulls are no novelty."""
    flags = {c: out_of_range(F.col(f"`{c}`"), *s.ranges[c]) for c in numeric}
    return flags | {c: unseen(F.col(f"`{c}`"), s.categories[c]) for c in categorical}


def any_of(flags: dict[str, Column]) -> Column:
    return reduce(Column.__or__, flags.values(), F.lit(False))


def novelty_report(typed: DataFrame, s: Statistics, numeric: list[str], categorical: list[str]) -> tuple[list[tuple[str, str, int]], int, int]:
    """([(column, kind, cells)] of columns with any, in schema order; rows with any; rows), in one pass."""
    flags = novelty(typed, s, numeric, categorical)
    names = [*flags]
    row = typed.agg(*[F.count_if(flags[c]).alias(f"c{i}") for i, c in enumerate(names)], F.count_if(any_of(flags)).alias("any"), F.count(F.lit(1)).alias("n")).first()
    kind = lambda c: "out-of-range" if c in numeric else "unseen-category"
    return [(c, kind(c), row[f"c{i}"]) for i, c in enumerate(names) if row[f"c{i}"]], row["any"], row["n"]


def unseen_rows(df: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose value of column is not in vocabulary(value), for vocabularies too large to be literals."""
    return df.filter(F.col(column).isNotNull()).join(vocabulary.select(F.col("value").alias(column)), column, "left_anti")


def preview(scored: DataFrame, order: str) -> DataFrame:
    """The first SCORED_PREVIEW rows."""
    return scored.orderBy(order).limit(SCORED_PREVIEW)


def distribution(df: DataFrame) -> DataFrame:
    """(prediction, n, percent) per predicted class."""
    total = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("__n"))
    return df.groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("prediction", "n", F.round(100 * F.col("n") / F.col("__n")).cast("long").alias("percent"))
