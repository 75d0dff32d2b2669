"""WARC archives, read by an index.

Writing gives one gzip member per record and an index row for each: archive,
offset, length, URL and payload digest. Reading starts from index rows. Those
selected are sorted by archive and offset, near ones are read as one byte
range, and each record is cut out of its range. Archives lie in the folder that
executors share; a task that is run again writes archives of its own, and only
those that the written index names are ever read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_or_empty, work_path

#: Payloads shorter than this are always written in full.
REVISIT_LEAST = 100
#: Bytes of an archive beyond which the next one is begun.
ARCHIVE_BYTES = 1 << 30
#: Bytes of archive that a read range spans at most, save for a longer record.
RANGE_BYTES = 4 << 20
#: Bytes of archive that a reading task takes, about, and inflated bytes that it holds, save for a longer record.
TASK_BYTES, HELD_BYTES = 32 << 20, 16 << 20
#: Parts that the records of one payload are dealt to, so that a very common page is in no single task.
SALTS = 32
#: Unselected bytes between records that are read along rather than skipped.
GAP_BYTES = 64 << 10
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id {id}, url string, record_type string, refers_to {id}, digest string, archive string, offset bigint, length bigint"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _line(value: object) -> str:
    """A value fit for one header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One WARC record, uncompressed; a revisit leaves its payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(f'urn:page:{page}' if url is None else url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page is None else page}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields, lower-cased, and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return {k.lower(): v for k, v in fields.items()}, block.partition(b"\r\n\r\n")[2]


def _writer(folder: str):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page, url, payload, digest, refers in zip(*(b.column(i) for i in range(5)), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = gz.compress(record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())) + gz.flush()
                    out.write(data)
                    rows.append((f"{folder}/{name}", at, len(data)))
                    at += len(data)
                kind = pa.array(["response" if r is None else "revisit" for r in b.column(4).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), kind, b.column(4), b.column(3), pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))],
                    names=["page_id", "url", "record_type", "refers_to", "digest", "archive", "offset", "length"],
                )
        finally:
            if out is not None:
                out.close()

    return write


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row of pages under folder; returns the written index.

    Payloads are html in UTF-8; null is empty. Of rows with equal payloads of
    REVISIT_LEAST bytes or more, those with the smallest id are responses and
    the others revisit it; shorter ones are all responses. A null id is smaller
    than none; where all of a group are null, all are responses. Repeated rows
    get records of their own, null URLs a URI made of the id; an empty table
    gives an empty index. Other columns are ignored whatever their names. A
    record is made in memory, however long its payload is.
    """
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).cast("binary").alias("payload"))
    d = d.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= REVISIT_LEAST
    first = d.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    refers = F.when(long & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    d = d.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = d.join(first, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    kind = pages.schema[id_col].dataType.simpleString()
    return stash(joined.mapInArrow(_writer(folder), INDEX.format(id=kind)), "warc-index")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _reader(held_bytes: int):  # noqa: ANN202
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, tuple[fs.FileSystem, str]] = {}
        for b in batches:
            for archive, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folder, _, name = archive.rpartition("/")
                if folder not in opened:
                    opened[folder] = _open(folder)
                files, root = opened[folder]
                rows, held, k = [], 0, 0
                with files.open_input_file(f"{root}/{name}") as f:
                    while k < len(wanted):
                        first, end = k, wanted[k]["offset"] + wanted[k]["length"]
                        while k + 1 < len(wanted) and wanted[k + 1]["offset"] - end <= GAP_BYTES:
                            k += 1
                            end = max(end, wanted[k]["offset"] + wanted[k]["length"])
                        k += 1
                        base = wanted[first]["offset"]
                        f.seek(base)
                        data = f.read(end - base)
                        for w in wanted[first:k]:
                            at = w["offset"] - base
                            fields, payload = parse(zlib.decompress(data[at : at + w["length"]], 31))
                            own, refers, kind = fields["x-page-id"], fields.get("x-refers-to-page-id"), fields["warc-type"]
                            rows.append((own or None, fields["warc-target-uri"], kind, refers, fields["warc-payload-digest"].removeprefix("sha256:"), payload if kind == "response" else None))
                            held += len(payload)
                            if held >= held_bytes:
                                yield _records(rows)
                                rows, held = [], 0
                if rows:
                    yield _records(rows)

    return read


def read(index: DataFrame) -> DataFrame:
    """The records of the given index rows: (page_id, url, record_type, refers_to, digest, payload).

    payload is null for a revisit; ``measured`` looks at the record that it
    refers to. An index row twice gives its record twice; no rows give none.
    Ranges are dealt to tasks by the bytes of archive behind them.
    """
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    kind = index.schema["page_id"].dataType.simpleString()
    wanted = F.sort_array(F.collect_list(F.struct("offset", "length")))
    ranges = index.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).alias("block")).agg(wanted.alias("wanted")).select("archive", "wanted")
    found = ranges.repartition(tasks, "archive", F.col("wanted")[0]["offset"]).mapInArrow(_reader(HELD_BYTES), "page_id string, url string, record_type string, refers_to string, digest string, payload binary")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def measured(records: DataFrame) -> DataFrame:
    """Size and digest of each record's full payload, that of a revisit from the record it refers to."""
    own = stash(
        records.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha")),
        "read",
    )
    named = own.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("sha").alias("digest")).agg(F.max("bytes").alias("to_bytes"), F.lit(True).alias("there"))
    return own.join(named, ["refers_to", "digest"], "left").select(
        "page_id",
        F.coalesce("bytes", "to_bytes").alias("payload_bytes"),
        F.coalesce("sha", F.when(F.col("there"), F.col("digest"))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
