"""What a cell means: the only copy of the null, number and date rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that mean null, after trimming and lower-casing.
NULL_TOKENS = ["", "na", "n/a", "null", "nan", "none", "-"]
#: Fixed value: white space that is trimmed, as a regular expression's class.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRIM = f"^{SPACE}+|{SPACE}+$"
#: Decimal numbers; dates as year-month-day in four and two digits, with or without a time, or day/month/year.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?|\d{1,2}/\d{1,2}/\d{2,4})$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), TRIM, "")


def is_null(c: str | Column) -> Column:
    """True for SQL null and for any null token."""
    return F.coalesce(F.lower(trimmed(c)).isin(NULL_TOKENS), F.lit(True))


def text(c: str | Column) -> Column:
    """The trimmed cell, or null where it means null."""
    return F.when(~is_null(c), trimmed(c))


def number(c: str | Column) -> Column:
    """The finite number that a cell writes, or null. Suffixes, hex and names of infinity are no numbers."""
    t = trimmed(c)
    n = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def looks_like_date(c: str | Column) -> Column:
    return F.coalesce(trimmed(c).rlike(DATE), F.lit(False))


def is_numeric_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_date_type(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def supported(df: DataFrame) -> list[str]:
    """Columns that can be cells: strings, numbers, booleans, dates and timestamps."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType)) or is_numeric_type(f.dataType) or is_date_type(f.dataType)]


def cell(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """(value, number, date-like) of a column of any supported type; value is null where the cell means null.

    The value of a number is its type's own text: whole numbers of any size stay apart, and 1 is not 1.0.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if is_numeric_type(kind):
        n = c.cast("double")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            n = F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)
            # Zero is one value, whatever its sign.
            return F.when(n.isNotNull(), F.when(n == 0, F.lit(0).cast(kind)).otherwise(c).cast("string")), n, F.lit(False)
        return c.cast("string"), n, F.lit(False)
    if is_date_type(kind):
        return c.cast("string"), F.lit(None).cast("double"), c.isNotNull()
    if isinstance(kind, T.BooleanType):
        return c.cast("string"), F.lit(None).cast("double"), F.lit(False)
    return text(c), F.when(~is_null(c), number(c)), looks_like_date(c)
