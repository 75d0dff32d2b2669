"""Example tables by key: CSV files in a folder of the user's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources import csv_scan


@dataclass(frozen=True)
class Example:
    file: str
    target: str


def keys(examples: dict[str, Example]) -> list[str]:
    return [*examples]


def read(spark: SparkSession, folder: str, examples: dict[str, Example], key: str, limits: csv_scan.Limits | None = csv_scan.COMPATIBLE) -> tuple[DataFrame, str]:
    """(table, target) of the example with that key; KeyError names those there are."""
    if key not in examples:
        raise KeyError(f"no example {key!r}; there are {', '.join(examples)}")
    found = examples[key]
    return csv_scan.read(spark, f"{folder.rstrip('/')}/{found.file}", limits), found.target
