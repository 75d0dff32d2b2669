"""Profiles and class counts, all from one table of distinct cells."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cells

DATE_SHARE = 0.8


def _storage(kind: T.DataType) -> str:
    """What cells of a type are grouped by."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    return "double" if isinstance(kind, T.DoubleType) else kind.simpleString()


def distinct_cells(df: DataFrame, names: list[str] | None = None, positive: Column | None = None) -> DataFrame:
    """(pos, column, value, num, date, n, hits) per distinct cell: how often it occurs, and with ``positive`` true.

    Columns of one type share a pass that reads them alone, with one shuffle;
    counts combine before it. Cells are grouped by their own type, and what
    they mean is worked out for distinct ones.
    """
    names = cells.supported(df) if names is None else names
    hit = F.lit(0) if positive is None else F.coalesce(positive.cast("int"), F.lit(0))
    by_kind: dict[str, list[str]] = {}
    for name in names:
        by_kind.setdefault(_storage(df.schema[name].dataType), []).append(name)
    parts = []
    for kind, own in by_kind.items():
        clean = (lambda c: cells.text(c)) if kind == "string" else (lambda c: c.cast(kind))  # noqa: B023
        each = F.array(*[F.struct(F.lit(df.columns.index(c)).alias("pos"), clean(F.col(f"`{c}`")).alias("v")) for c in own])
        counted = df.select(F.explode(each).alias("c"), hit.alias("hit")).groupBy("c.pos", "c.v").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").cast("long").alias("hits"))
        value, num, date = cells.cell(counted, "v")
        column = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("pos") + 1)
        parts.append(counted.select("pos", column.alias("column"), value.alias("value"), num.alias("num"), date.alias("date"), "n", "hits"))
    if not parts:
        return df.sparkSession.createDataFrame([], "pos int, column string, value string, num double, date boolean, n bigint, hits bigint")
    return reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, names: list[str] | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """A row per column: (pos, name, kind, nulls, cardinality, looks_like_date).

    Exact. A column is numeric where every cell that is not null is a number;
    date-like where it is not numeric and DATE_SHARE of those cells are dates.
    """
    return facts(distinct_cells(df, names) if distinct is None else distinct).drop("purity")


def facts(distinct: DataFrame) -> DataFrame:
    """``profile`` of counted cells, and the purity: rows that their value's majority class has, as a share of those that are not null."""
    d = distinct
    there = F.col("value").isNotNull()
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    got = d.groupBy("pos", "column").agg(
        count(~there).alias("nulls"),
        # Distinct by text, whatever the number or date that it writes. Numbers that are none may be several cells without a value.
        F.count("value").alias("cardinality"),
        count(there).alias("present"),
        count(F.col("num").isNotNull()).alias("numbers"),
        count(there & F.col("date")).alias("dates"),
        F.sum(F.when(there, F.greatest("hits", F.col("n") - F.col("hits")))).alias("major"),
    )
    numeric = (F.col("present") > 0) & (F.col("numbers") == F.col("present"))
    return got.select(
        "pos",
        F.col("column").alias("name"),
        F.when(numeric, "numeric").otherwise("categorical").alias("kind"),
        "nulls",
        "cardinality",
        (~numeric & (F.col("present") > 0) & (F.col("dates") >= DATE_SHARE * F.col("present"))).alias("looks_like_date"),
        F.try_divide(F.col("major"), F.col("present").cast("double")).alias("purity"),
    )


def target_classes(df: DataFrame, target: str, row_id: str | None = None) -> DataFrame:
    """(label, n) per class of the target, in order of first appearance where row_id tells it, else of label."""
    label = cells.cell(df, target)[0].alias("label")
    first = F.min(row_id if row_id else "label").alias("first")
    rows = df.select(label, *([row_id] if row_id else [])).filter("label IS NOT NULL")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), first).orderBy("first").select("label", "n")


def two_classes(df: DataFrame, target: str) -> list[tuple[str, int]]:
    """The classes and counts of a binary target, negative then positive; [] for any other target.

    The rarer class is positive; of equals, the one that is later in text
    order, but the shorter where one begins with the other.
    """
    value = cells.cell(df, target)[0]
    # Three rows at most come to the driver.
    got = df.select(value.alias("label")).filter("label IS NOT NULL").groupBy("label").count().limit(3).collect()
    if len(got) != 2:
        return []
    late = lambda label: label + chr(0x10FFFF)  # noqa: E731  after all that begins with it
    return sorted(((r["label"], r["count"]) for r in got), key=lambda c: (-c[1], late(c[0])))


def features(df: DataFrame, target: str, profiled: DataFrame | None = None, drop: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature columns: all but the target, date-like ones and ``drop``, in column order."""
    rows = sorted((profile(df) if profiled is None else profiled).collect(), key=lambda r: r["pos"])  # a row per column
    kept = [r for r in rows if r["name"] != target and r["name"] not in drop and not r["looks_like_date"]]
    return [r["name"] for r in kept if r["kind"] == "numeric"], [r["name"] for r in kept if r["kind"] == "categorical"]


#: Rows of a table's preview, and of a scored one's.
PREVIEW, SCORED_PREVIEW = 20, 10


@dataclass(frozen=True)
class Summary:
    columns: list[str]
    rows: int
    profiles: list[Row]
    preview: list[Row]
    target_candidates: list[str]
    date_columns: list[str]


def summarize(df: DataFrame, row_id: str) -> Summary:
    """Profiles of all columns but row_id, the first PREVIEW rows, possible targets and date columns."""
    names = [c for c in cells.supported(df) if c != row_id]
    profiles = sorted(profile(df, names).collect(), key=lambda r: r["pos"])  # a row per column
    binary = [r["name"] for r in profiles if r["cardinality"] == 2]
    return Summary(names, df.count(), profiles, df.orderBy(row_id).limit(PREVIEW).collect(), binary, [r["name"] for r in profiles if r["looks_like_date"]])
