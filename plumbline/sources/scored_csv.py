"""Scored tables as CSV, beside the user's own columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_name(taken: list[str], wanted: str) -> str:
    """wanted, or wanted_2, wanted_3 and so on: the first that is not taken."""
    name, k = wanted, 2
    while name in taken:
        name, k = f"{wanted}_{k}", k + 1
    return name


def column_names(columns: list[str], prediction: str, probability: str) -> tuple[str, str]:
    first = free_name(columns, prediction)
    return first, free_name([*columns, first], probability)


def slug(name: str, fallback: str = "") -> str:
    """Lower case, without .csv; other runs than a-z and 0-9 become single hyphens, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "-", re.sub(r"\.csv$", "", name.lower())).strip("-") or fallback


def file_name(dataset: str, suffix: str) -> str:
    return f"{slug(dataset, 'datos')}-{suffix}.csv"


def scored_table(scored: DataFrame, columns: list[str], prediction: str = "prediction", probability: str = "probability") -> DataFrame:
    """The user's columns, the prediction, and the probability with four decimals."""
    p, q = column_names(columns, prediction, probability)
    return scored.select(*[F.col(f"`{c}`") for c in columns], F.col("prediction").alias(p), F.format_string("%.4f", F.col("probability")).alias(q))


def write(table: DataFrame, path: str, single: bool = False) -> None:
    """CSV with doubled quotes; one part where ``single``, else as many as the table has."""
    (table.coalesce(1) if single else table).write.options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
