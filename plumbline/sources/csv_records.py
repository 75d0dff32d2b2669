"""CSV records that go on over lines, from files that are split among tasks.

A quote opens or closes a quoted part wherever it stands, so whether a place is
within quotes is the parity of the quotes before it. Each split of a file tells
the parity of its own, a running sum over splits tells each one's state at its
begin, and then each is cut into records from its true state. What is left of
the records that splits cut through, two pieces of a split at most, is put
together apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.cells import trimmed
from plumbline.sources import scratch

ROW_ID = "__row_id"
#: Fixed value: what cells are trimmed of, as ``cells.trimmed`` has it.
SPACE = " \t\n\r\f\v\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_TOKEN = re.compile(r'"((?:[^"]|"")*)"?|(,)|([^",]+)')
#: Records of a batch that a task passes on, and characters after which a batch is passed on.
BATCH, CHARACTERS = 4096, 1 << 22
#: Kinds of pieces: a whole record, the rest of one that began in an earlier split, the begin of one that ends in a later split.
WHOLE, REST, BEGIN = 0, 1, 2


def fields(record: str) -> list[str]:
    """A record's fields: quotes taken off, doubled ones within quotes as one, carriage returns outside quotes dropped."""
    if '"' not in record:
        return record.replace("\r", "").split(",")
    out = [""]
    for quoted, comma, bare in _TOKEN.findall(record):
        if comma:
            out.append("")
        else:
            out[-1] += bare.replace("\r", "") if bare else quoted.replace('""', '"')
    return out


def blank(own: list[str]) -> bool:
    """Whether a record is no row: one field, of white space at most."""
    return len(own) == 1 and not own[0].strip(SPACE)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(split, inside, value) in order of lines -> (split, seq, kind, fields, text): fields of whole records, text of pieces."""
    rows: list[tuple[int, int, int, list[str] | None, str | None]] = []
    held, split, seq, within, kind, size = [], None, 0, False, WHOLE, 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        rows.clear()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["split", "seq", "kind", "fields", "text"])

    def end(kind: int) -> None:
        nonlocal seq
        if held:
            text = "\n".join(held)
            held.clear()
            if kind == WHOLE:
                own = fields(text)
                if blank(own):
                    return
                rows.append((split, seq, kind, own, None))
            else:
                rows.append((split, seq, kind, None, text))
            seq += kind != REST

    for b in batches:
        for to, inside, line in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if to != split:
                # What a split leaves open goes on in the next.
                end(BEGIN if kind == WHOLE else kind)
                split, seq, within, kind = to, 0, inside, REST if inside else WHOLE
            held.append(line)
            size += len(line)
            if line.count('"') % 2:
                within = not within
            if not within:
                end(kind)
                kind = WHOLE
            if len(rows) >= BATCH or size > CHARACTERS:
                size = 0
                yield batch()
    end(BEGIN if kind == WHOLE else kind)
    yield batch()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fields(t) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], names=["split", "seq", "fields"])


def _header(lines: DataFrame) -> list[str]:
    """The fields of the first record that is not empty."""
    first = lines.agg(F.min(F.struct("path", "start"))["path"]).first()[0]
    k, top = 16, lines.filter((F.col("path") == first) & (F.col("start") == 0)).select("value")
    while True:
        got, held = [r["value"] for r in top.limit(k).collect()], []
        for line in got:
            held.append(line)
            if "\n".join(held).count('"') % 2 == 0:
                names = fields("\n".join(held).removeprefix("﻿"))
                if not blank(names):
                    return names
                held = []
        if len(got) < k:
            return fields("\n".join(held).removeprefix("﻿"))
        k *= 8


def read(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(names, rows): cells c0, c1 and so on, __row_id in order of files and lines, and __found, how many fields a row has.

    Records of one field that is empty or of white space are no rows; each
    file's first other record is its header. Missing cells are empty and those
    beyond the header's are left out. What comes to each task is a row for each
    split of the input; the records are written once.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    names = _header(lines)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    own = lines.groupBy("path", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    place = Window.orderBy("path", "start")
    splits = own.select("path", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"), (F.row_number().over(place) - 1).cast("long").alias("split"), (F.row_number().over(Window.partitionBy("path").orderBy("start")) == 1).alias("first"))
    splits = scratch.stash(splits, "splits")
    dealt = lines.join(F.broadcast(splits), ["path", "start"]).select("split", "inside", "value")
    pieces = scratch.stash(dealt.mapInArrow(_pieces, "split bigint, seq bigint, kind int, fields array<string>, text string"), "records")
    # The begin of a record, and the rests that follow it, until the next begin.
    cut = pieces.filter(F.col("kind") != WHOLE).select("split", "seq", "kind", "text")
    group = F.sum((F.col("kind") == BEGIN).cast("long")).over(Window.orderBy("split", "kind"))
    joined = cut.withColumn("g", group).groupBy("g").agg(F.min_by("seq", F.struct("split", "kind")).alias("seq"), F.min("split").alias("split"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "kind", "text"))), lambda x: x["text"]), "\n").alias("text"))
    mended = joined.select("split", "seq", "text").mapInArrow(_parsed, "split bigint, seq bigint, fields array<string>")
    rows = pieces.filter(F.col("kind") == WHOLE).select("split", "seq", "fields").union(mended).filter((F.size("fields") > 1) | (trimmed(F.get("fields", 0)) != ""))
    firsts = F.broadcast(splits.select("split", "first"))
    rows = rows.join(firsts, "split").filter(~(F.col("first") & (F.col("seq") == 0)))
    # Blank records took no number, but for a mended one, which is its split's last: what is left is numbered without a gap.
    ranked = rows.withColumn("r", F.col("seq") - F.col("first").cast("long"))
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("split", F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = ranked.join(F.broadcast(base), "split")
    cells = [F.coalesce(F.get("fields", i), F.lit("")).alias(f"c{i}") for i in range(len(names))]
    return names, placed.select(*cells, (F.col("base") + F.col("r")).alias(ROW_ID), F.size("fields").alias("__found"))
