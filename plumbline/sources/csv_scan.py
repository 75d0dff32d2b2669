"""A validated CSV scan: wrong input is refused with a reason, never guessed at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import trimmed
from plumbline.sources import csv_records

#: The limits of the compatible profile.
COMPATIBLE_BYTES, COMPATIBLE_ROWS = 5 * 1024 * 1024, 50_000
ROW_ID = "__row_id"
_BAD = "__bad_record"
_FIELD = r'(?:[^",\r]*+|"(?:[^"]++|"")*+")'
_PLAIN = f"^{_FIELD}(?:,{_FIELD})*+\\r?$"


class CsvError(ValueError):
    """code is too-large, wrong-delimiter, empty, duplicate-header, too-many-rows or ragged; facts say more."""

    def __init__(self, code: str, **facts: object):
        super().__init__(f"{code}: {facts}" if facts else code)
        self.code, self.facts = code, facts


@dataclass(frozen=True)
class Limits:
    max_bytes: int | None = None
    max_rows: int | None = None


COMPATIBLE = Limits(COMPATIBLE_BYTES, COMPATIBLE_ROWS)


def byte_length(spark: SparkSession, path: str) -> int:
    """Bytes of the files under path, without reading them."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def wrong_delimiter(header: str) -> str | None:
    """The semicolon or tab that seems to separate a header line without a comma outside quotes, or None."""
    bare = "".join(header.split('"')[::2])
    semicolons, tabs = bare.count(";"), bare.count("\t")
    if "," in bare or not semicolons + tabs:
        return None
    return ";" if semicolons >= tabs else "\t"


def read(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    """The table as written: string cells, empty for missing, and __row_id in order of input.

    A header line is needed. Records of one field that is empty or of white
    space are no rows. Raises CsvError. Files are split among
    tasks, also where quotes go on over lines. Of files of plain lines Spark's
    own reader makes the rows, of others ``csv_records``, by the same rules.
    """
    limits = limits or Limits()
    if limits.max_bytes is not None and (size := byte_length(spark, path)) > limits.max_bytes:
        raise CsvError("too-large", bytes=size, max_bytes=limits.max_bytes)
    lines = spark.read.text(path)
    first = lines.filter(F.trim("value") != "").limit(1).collect()
    if not first:
        raise CsvError("empty")
    line = first[0]["value"].removeprefix("﻿")
    if found := wrong_delimiter(line):
        raise CsvError("wrong-delimiter", delimiter=found)
    # Lines that Spark's splittable reader takes for what they are here: each field free of quotes or quoted as a whole.
    plain = F.col("value").rlike(_PLAIN) | ~F.col("value").rlike('["\r]')
    blank = (F.length("value") > 0) & (trimmed("value") == "")
    if lines.filter(~plain | blank).isEmpty():
        names, raw = _line_by_line(spark, path)
    else:
        names, raw = csv_records.read(spark, path)
    if len(set(names)) != len(names):
        raise CsvError("duplicate-header", names=sorted({x for x in names if names.count(x) > 1}))
    if raw.isEmpty():
        raise CsvError("empty")
    if limits.max_rows is not None and raw.limit(limits.max_rows + 1).count() > limits.max_rows:
        raise CsvError("too-many-rows", rows=raw.count(), max_rows=limits.max_rows)
    out = raw.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(names)], ROW_ID, "__found")
    if broken := out.filter(F.col("__found") != len(names)).orderBy(ROW_ID).limit(1).collect():
        raise CsvError("ragged", row=broken[0][ROW_ID] + 2, expected=len(names), found=broken[0]["__found"])
    return out.drop("__found")


def _line_by_line(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(names, rows): cells c0, c1 and so on, __row_id, and __found, how many fields a row has."""
    reader = spark.read.options(quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    names = ["" if x is None else x.removeprefix("\ufeff") for x in reader.csv(path).limit(1).collect()[0]]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(_BAD, T.StringType())])
    raw = reader.option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", _BAD).option("mode", "PERMISSIVE").schema(schema).csv(path)
    if len(names) == 1:
        raw = raw.filter(trimmed(F.coalesce("c0", F.lit(""))) != "")
    cells = [F.coalesce(F.col(f"c{i}"), F.lit("")).alias(f"c{i}") for i in range(len(names))]
    # Commas within quotes are none of a broken record's.
    bare = F.regexp_replace(_BAD, '"[^"]*"', "")
    found = F.when(F.col(_BAD).isNull(), len(names)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1)
    return names, numbered(raw.select(*cells, found.alias("__found")))


def numbered(df: DataFrame) -> DataFrame:
    """df with a gapless __row_id from 0 in the order of its partitions and rows; no row is shuffled.

    What comes to each task is a count for each partition.
    """
    d = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = d.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select(F.col("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    placed = d.withColumn("__p", part).join(F.broadcast(base), "__p")
    return placed.withColumn(ROW_ID, F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__p", "__base", "__at")
