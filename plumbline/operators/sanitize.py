"""Structural sanitation before the split: it knows no target, and reports all that it does."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.operators.profile import distinct_cells
from plumbline.sources import scratch

#: Share of numbers from which a column counts as numeric with junk in it.
MOSTLY_NUMERIC = 0.9


@dataclass
class Report:
    rows_before: int = 0
    rows_after: int = 0
    columns_before: int = 0
    columns_after: int = 0
    exclusions: list[tuple[str, str]] = field(default_factory=list)
    coercions: list[tuple[str, int]] = field(default_factory=list)

    @property
    def duplicates(self) -> int:
        return self.rows_before - self.rows_after

    @property
    def clean(self) -> bool:
        return not (self.duplicates or self.exclusions or self.coercions)

    @property
    def usable(self) -> bool:
        return self.columns_after >= 2 and self.rows_after >= 2


def deduplicate(df: DataFrame, row_id: str) -> DataFrame:
    """The first, by row_id, of rows that are equal in all other columns as they are written."""
    rest = [c for c in df.columns if c != row_id]
    return df.groupBy(*rest).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def column_facts(df: DataFrame, names: list[str]) -> DataFrame:
    """(pos, column, present, nulls, cardinality, numbers) per column."""
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    there = F.col("value").isNotNull()
    return (
        distinct_cells(df, names)
        .groupBy("pos", "column")
        .agg(count(there).alias("present"), count(~there).alias("nulls"), F.count("value").alias("cardinality"), count(F.col("num").isNotNull()).alias("numbers"))
    )


def decisions(facts: DataFrame) -> DataFrame:
    """facts with ``exclusion`` (constant-column, id-column or null) and ``junk``: cells to be nulled."""
    mostly = (F.col("present") > 0) & (F.col("numbers") >= MOSTLY_NUMERIC * F.col("present"))
    rows = F.col("present") + F.col("nulls")
    unique = ~mostly & (rows >= 2) & (F.col("nulls") == 0) & (F.col("cardinality") == rows)
    excluded = F.when(F.col("cardinality") <= 1, "constant-column").when(unique, "id-column")
    return facts.withColumn("exclusion", excluded).withColumn("junk", F.when(excluded.isNull() & mostly, F.col("present") - F.col("numbers")).otherwise(0))


def null_junk(df: DataFrame, name: str) -> Column:
    """The column with cells that are no number emptied."""
    value, num, _ = cells.cell(df, name)
    return F.when(value.isNotNull() & num.isNull(), "").otherwise(F.col(f"`{name}`"))


def sanitize(df: DataFrame, row_id: str) -> tuple[DataFrame, Report]:
    """Removes repeated rows, constant columns and exact identifiers, and empties junk among numbers."""
    names = [c for c in df.columns if c != row_id]
    # Each row is shuffled once; how often it was there comes with it, so that rows need no pass of their own to be counted.
    times = "__times"
    counted = df.groupBy(*names).agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias(times)).select(*df.columns, times)
    stored = scratch.stash(counted, "sanitized")
    once = stored.drop(times)
    counts = stored.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n")).first()["n"]
    facts = sorted(decisions(column_facts(once, names)).collect(), key=lambda r: r["pos"])  # a row per column
    after = facts[0]["present"] + facts[0]["nulls"] if facts else once.count()
    excluded = [(r["column"], r["exclusion"]) for r in facts if r["exclusion"]]
    coerced = [(r["column"], r["junk"]) for r in facts if r["junk"]]
    gone, mixed = {c for c, _ in excluded}, {c for c, _ in coerced}
    kept = [c for c in df.columns if c not in gone]
    table = once.select(*[null_junk(once, c).alias(c) if c in mixed else F.col(f"`{c}`") for c in kept])
    return table, Report(counts, after, len(names), len(names) - len(gone), excluded, coerced)
