"""Fill-in-middle: a text's middle moves to its end, so that a model learns to fill gaps.

A text is an array of code points (UTF-32). Neighbours of different classes
have a boundary between them, and two boundaries, chosen by keyed digests of
the row's id, cut prefix, middle and suffix. Python sees only the texts, in
Arrow batches; all other columns pass by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that stay as they are; of 100 others, those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
UNITS = ("codepoint", "word", "line")
_SCHEMA = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:binary>"


def classes(codes: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; where neighbours differ, a unit ends."""
    if unit == "codepoint":
        return np.arange(len(codes))
    if unit == "line":
        # The line that a code point is of: a break ends its own.
        return np.cumsum(codes == 10) - (codes == 10)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0) | (codes == 0x3000)
    letter = ((codes | 32) >= 97) & ((codes | 32) <= 122) | (codes >= 0xAA) & ~space
    digit = (codes >= 48) & (codes <= 57)
    return np.select([space, letter, digit], [0, 1, 2], 3)


def boundaries(codes: np.ndarray, unit: str) -> np.ndarray:
    """Places where a text may be cut, its begin and end included: unit k is between places k and k + 1."""
    if not len(codes):
        return np.zeros(1, np.int64)
    of = classes(codes, unit)
    return np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(codes)]))


def _points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def _bytes(codes: np.ndarray) -> bytes:
    return codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def cut(raw: bytes | None, h: tuple[int, int, int, int], unit: str, marks: tuple[bytes, bytes, bytes], plain: int, suffix_first: int) -> tuple:
    """(n, form, prefix's code points, middle's, output) of one text."""
    raw = raw or b""
    codes = _points(raw)
    at = boundaries(codes, unit)
    n = len(at) - 1
    if not n or h[2] % 100 >= 100 - plain or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, z = int(at[a]), int(at[z])
    prefix, middle, suffix = _bytes(codes[:a]), _bytes(codes[a:z]), _bytes(codes[z:])
    p, s, m = marks
    if h[3] % 100 < suffix_first:
        return n, "spm", a, z - a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, z - a, b"".join((p, prefix, s, suffix, m, middle))


def _check(marks: tuple[str, str, str], unit: str) -> None:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    # Else a mark could be found earlier than it was put, partly in the text before it.
    if len(set(marks)) < 3 or any(not m or any(m[:k] == m[-k:] for k in range(1, len(m))) for m in marks):
        raise ValueError("marks must be three different texts, none of which ends as it begins")


def draws(id_col: str, seed: int | str = 1) -> list[Column]:
    """Four numbers below 2 ** 32 from the SHA-256 of ``seed:id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int | str = 1, unit: str = "codepoint", marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, into: str = "fim"
) -> DataFrame:
    """docs with the column ``into``: (n, form, prefix_chars, middle_chars, output).

    n counts the text's units, among whose ends the two cuts are drawn. form is
    ``psm`` or ``spm``, or ``plain`` where output is the text as it was: of
    empty and null texts, those that hold a mark, and ``plain`` in 100 of the
    others. prefix_chars and middle_chars count code points, and are null where
    plain. A row's cuts depend on its own id and text alone: repeated rows get
    the same ones, rows are neither dropped nor moved, an empty table gives
    none. Of other columns only one named ``into`` is replaced. Bytes that are no
    valid UTF-8 go to the output as they are, a code point each. A text is held
    whole, at about ten times its bytes while it is cut.
    """
    _check(marks, unit)
    importable(docs.sparkSession)
    raw_marks = tuple(m.encode() for m in marks)

    @F.arrow_udf(_SCHEMA)
    def fim(text: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        hs = zip(*(x.to_pylist() for x in (a, b, c, d)), strict=True)
        got = [cut(t.as_py(), h, unit, raw_marks, plain, suffix_first) for t, h in zip(text, hs, strict=True)]
        columns = list(zip(*got, strict=True)) or [()] * 5
        kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    made = docs.withColumn(into, fim(F.col(f"`{text_col}`").cast("binary"), *draws(id_col, seed)))
    return made.withColumn(into, F.col(f"`{into}`").withField("output", F.col(f"`{into}`.output").cast("string")))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of ``transform`` was made from, exact for valid UTF-8; null of a null output."""
    p, s, m = marks
    spm = form == "spm"
    choose = lambda x, y: F.when(spm, x).otherwise(y)
    after = lambda text, begin, mark: F.substring(text, F.length(begin) + F.length(mark) + 1, F.length(text))
    body = after(output, F.lit(""), choose(F.lit(s), F.lit(p)))
    head = choose(F.substring_index(body, p, 1), F.substring_index(body, s, 1))
    rest = after(body, head, choose(F.lit(p), F.lit(s)))
    between = F.substring_index(rest, m, 1)
    middle = after(rest, between, F.lit(m))
    return F.when(form == "plain", output).otherwise(F.concat(choose(between, head), middle, choose(head, between)))
