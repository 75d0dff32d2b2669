"""Preprocessing fitted on training rows only, as a pipeline that can be saved."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.operators import ranks
from plumbline.operators.profile import distinct_cells

#: Training rows that a category needs for a slot of its own.
MIN_FREQUENCY = 2
#: Categories of a column beyond which it is refused: they become part of the model, in the driver.
MAX_CATEGORIES = 10_000
_NO_CATEGORY = "\x00none"


class VocabularyError(ValueError):
    """Columns with more than MAX_CATEGORIES categories: identifiers or texts, not features."""

    def __init__(self, columns: list[str]):
        super().__init__(f"over {MAX_CATEGORIES} categories: {', '.join(columns)}")
        self.columns = columns


@dataclass
class Statistics:
    """What training rows say: enough to rebuild the preprocessing and to tell new values from seen ones."""

    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    rare: dict[str, list[str]] = field(default_factory=dict)


def typed(df: DataFrame, numeric: list[str], categorical: list[str], keep: list[str | Column] = ()) -> DataFrame:
    """keep, numeric features as doubles and categorical ones as text, null where a cell means null."""
    num = [cells.cell(df, c)[1].alias(c) for c in numeric]
    cat = [cells.cell(df, c)[0].alias(c) for c in categorical]
    return df.select(*keep, *num, *cat)


def medians(train: DataFrame, numeric: list[str]) -> DataFrame:
    """(column, median): exact, the mean of the middle two values where they are two; no row for a column of nulls.

    By ranks of distinct values: an aggregate that holds a column's values would not fit a task.
    """
    return ranks.medians(distinct_cells(train, numeric).select("column", "num", "n"), ["column"], "num")


def scaling(train: DataFrame, medians: dict[str, float]) -> DataFrame:
    """One row: mean and population deviation of each column after its nulls have the median."""
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(m)) for c, m in medians.items()}
    return train.agg(*[f(x).alias(f"{c}_{name}") for c, x in filled.items() for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def category_counts(train: DataFrame, categorical: list[str]) -> DataFrame:
    """(column, value, n) of training rows, nulls left out."""
    return distinct_cells(train, categorical).filter("value IS NOT NULL").select("column", "value", "n")


def modes(counts: DataFrame) -> DataFrame:
    """(column, mode): the commonest value, of equals the first in text order."""
    return counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("s")).select("column", F.col("s.value").alias("mode"))


def rare(counts: DataFrame) -> DataFrame:
    """(column, categories): those with fewer than MIN_FREQUENCY training rows, sorted; columns without any left out."""
    return counts.filter(F.col("n") < MIN_FREQUENCY).groupBy("column").agg(F.sort_array(F.collect_set("value")).alias("categories"))


def learn(train: DataFrame, numeric: list[str], categorical: list[str]) -> Statistics:
    """Statistics of typed training rows: a pass for medians and ranges, one for scaling, one for categories.

    Raises VocabularyError, before any category comes to the driver, where a column has too many.
    """
    s = Statistics()
    if numeric:
        exprs = [f(F.col(f"`{c}`")).alias(f"{name}{i}") for i, c in enumerate(numeric) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        row = train.agg(*exprs).first()
        middle = {r["column"]: r["median"] for r in medians(train, numeric).collect()}  # a row per column
        s.medians = {c: middle.get(c, 0.0) for c in numeric}
        s.ranges = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(numeric)}
        row = scaling(train, s.medians).first()
        s.means = {c: row[f"{c}_mean"] or 0.0 for c in numeric}
        s.deviations = {c: row[f"{c}_std"] or 1.0 for c in numeric}
    if categorical:
        # Vocabularies become part of the model, so they come to the driver: at most one more than MAX_CATEGORIES for each column.
        few = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
        got = category_counts(train, categorical).withColumn("r", F.row_number().over(few)).filter(F.col("r") <= MAX_CATEGORIES + 1)
        counts = sorted((r["column"], r["value"], r["n"]) for r in got.collect())
        sizes = Counter(column for column, _, _ in counts)
        if over := [c for c in categorical if sizes[c] > MAX_CATEGORIES]:
            raise VocabularyError(over)
        for c in categorical:
            own = [(v, n) for column, v, n in counts if column == c]
            s.categories[c] = [v for v, _ in own]
            s.modes[c] = min(own, key=lambda x: (-x[1], x[0]))[0] if own else _NO_CATEGORY
            if few := [v for v, n in own if n < MIN_FREQUENCY]:
                s.rare[c] = few
    return s


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def build(s: Statistics, numeric: list[str], categorical: list[str], sample: DataFrame, output: str = "features") -> PipelineModel:
    """A pipeline from typed columns to one vector: scaled numbers, then a slot for each frequent category.

    Rare and unseen categories share one more slot if training rows had rare
    ones, and have none otherwise. ``sample`` gives the columns' types only.
    """
    terms = [f"(coalesce(`{c}`, {s.medians[c]!r}D) - {s.means[c]!r}D) / {s.deviations[c]!r}D AS `__n_{c}`" for c in numeric]
    terms += [f"coalesce(`{c}`, {_quote(s.modes[c])}) AS `__c_{c}`" for c in categorical]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")]
    at = stages[0].transform(sample.limit(0))
    inputs = [f"__n_{c}" for c in numeric]
    if categorical:
        # One model a column: label lists of different lengths may not share one.
        for c in categorical:
            labels = [v for v in s.categories[c] if v not in set(s.rare.get(c, []))] or [_NO_CATEGORY]
            stages.append(StringIndexerModel.from_labels(labels, f"__c_{c}", f"__i_{c}", handleInvalid="keep"))
            at = stages[-1].transform(at)
        for names, drop in (([c for c in categorical if c in s.rare], False), ([c for c in categorical if c not in s.rare], True)):
            if names:
                encoder = OneHotEncoder(inputCols=[f"__i_{c}" for c in names], outputCols=[f"__o_{c}" for c in names], dropLast=drop).fit(at)
                stages.append(encoder)
                at = encoder.transform(at)
        inputs += [f"__o_{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return PipelineModel(stages)


def groups(s: Statistics, numeric: list[str], categorical: list[str]) -> list[tuple[int, int]]:
    """(first slot, size) of each categorical column's indicators in the vector that ``build`` makes."""
    out, at = [], len(numeric)
    for c in categorical:
        rare_ones = set(s.rare.get(c, []))
        labels = len([v for v in s.categories[c] if v not in rare_ones]) or 1
        out.append((at, labels + (c in s.rare)))
        at += out[-1][1]
    return out
