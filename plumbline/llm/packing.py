"""Best-fit packing by linear grouping.

Token counts are gathered exactly as a histogram of at most ``capacity``
lengths; all planning happens on that histogram, in runs of equal lengths, so
the driver's work depends on the capacity and not on the number of documents.

1. Large lengths, in falling order, are cut into groups of equal cardinality,
   each rounded up to its largest member.
2. The few rounded sizes are packed by their configuration linear programme
   (column generation; a knapsack prices the next configuration), rounded down
   to whole numbers of sequences.
3. Actual documents take the places of rounded sizes. Where that leaves room
   that no document is likely to fill, only the longest stays.
4. Documents that have no place yet and then the small lengths go, longest
   first, into the tightest room that holds them.

A plan is a list of intervals: ranks of one length -> sequences and offsets.
Documents get their rank within a length from counts by (length, bucket), so
no length, however common, is gathered in one task.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

CAPACITY = 2048
END_ID = 0
#: Sizes that large lengths are rounded to.
GROUPS = 64
#: Lengths up to this part of the capacity are small.
SMALL_PART = 3
#: Room up to this part of the capacity is too little to be worth filling.
TIGHT_PART = 512
#: Entries of a worker's cache of encoded words.
CACHE = 250_000
#: Runs of white space from this length on are encoded by ``tokenizers``, whose pattern has no limit of backtracking.
LONG_SPACE = 10_000
#: Pivots without a better total after which the configurations so far stand.
STALLED = 3000
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Encodes texts with the byte-level BPE ranks of ``vocabulary``.

    A single space between two characters that are not white space always
    begins a new pre-token, so texts are cut there and words are cached. A
    run of white space is a pre-token but for its last character, if that has
    text after it.
    """

    def __init__(self, vocabulary: str | None = None, exact: str | None = None, long_space: int = LONG_SPACE):
        import public_tokenizers as public
        import tiktoken

        path = vocabulary or public.path("byte_bpe_50k.tiktoken")
        self.exact_path, self.exact = exact or public.path("byte_bpe_50k.json"), None
        self.long_run = re.compile(f"{_SPACE}{{{long_space},}}")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {_SPECIAL: len(ranks)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = outer.ids(" " + word)
                if len(self) < CACHE:
                    self[word] = ids
                return ids

        self.words = Words()
        self.space_run = re.compile(r"\s\s")
        self.lone_space = re.compile(r"(?<!\s) (?!\s)")

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of text."""
        return np.asarray(self.bpe.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.space_run.search(text) or text[0] == " " or text[-1] == " ":
            if self.long_run.search(text):
                return self._with_long_runs(text)
            first, *rest = self.lone_space.split(text)
        else:
            first, *rest = text.split(" ")
        return self.ids(first) + b"".join(map(self.words.__getitem__, rest))

    def _with_long_runs(self, text: str) -> bytes:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.exact_path)
        out, at = [], 0
        for m in self.long_run.finditer(text):
            end = m.end() - (m.end() < len(text) and not text.startswith(_SPECIAL, m.end()))
            out += [self.encode(text[at : m.start()]), np.array(self.exact.encode(text[m.start() : end], add_special_tokens=False).ids, dtype="<u4").tobytes()]
            at = end
        return b"".join([*out, self.encode(text[at:])])


_encoders: dict[str | None, Encoder] = {}


def _encoder(vocabulary: str | None) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids) per piece of each row of docs.

    A document is its text's ids and then id 0; null texts count as empty, so
    every row has a piece. Documents over the capacity are cut into pieces of
    it, the first of which may be shorter, however long they are. ids are
    little-endian unsigned 32-bit numbers. Rows repeated in docs are repeated here; an empty table
    gives none; ids of documents may be null; other columns are ignored.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                row, piece, start, length, ids = array("q"), array("i"), array("q"), array("q"), []
                for i, text in enumerate(b.column(1)):
                    doc = encoder.encode(text.as_py()) + end
                    n = len(doc) // 4
                    a, z, k = 0, (n - 1) % capacity + 1, 0
                    while a < n:
                        row.append(i), piece.append(k), start.append(a), length.append(z - a)
                        ids.append(doc[4 * a : 4 * z])
                        a, z, k = z, z + capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.frombuffer(row, np.int64))), pa.array(np.frombuffer(piece, np.int32)), pa.array(np.frombuffer(start, np.int64)), pa.array(np.frombuffer(length, np.int64)), pa.array(ids, pa.binary())],
                    names=["id", "piece", "start", "length", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids binary")


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes, values = sizes[order], values[order]
    for c in range(int(sizes[0]), capacity + 1):
        m = int(np.searchsorted(sizes, c, "right"))
        gain = values[:m] + best[c - sizes[:m]]
        g = int(gain.argmax())
        best[c], took[c] = (gain[g], g) if gain[g] > best[c - 1] else (best[c - 1], -1)
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[order[took[c]]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations of sizes and how often each is used, a least total that covers counts."""
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    cost = np.ones(k)
    x = counts / columns.diagonal()
    inverse = np.diag(1 / columns.diagonal())
    best, since, pivot = np.inf, 0, -1
    # Ends with no better configuration; a long stay at one total (cycling by rounding) ends it too.
    while since < STALLED:
        pivot, total = pivot + 1, float(cost @ x)
        best, since = (total, 0) if total < best - 1e-9 * max(1.0, total) else (best, since + 1)
        dual = cost @ inverse
        worst = int(dual.argmin())
        if dual[worst] < -1e-9:
            new, price = np.zeros(k), 0.0
            new[worst] = -1
        else:
            value, pattern = _knapsack(dual, sizes, capacity)
            if value <= 1 + 1e-7:
                break
            new, price = pattern.astype(float), 1.0
        step = inverse @ new
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(k, np.inf)
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        columns[:, out], cost[out] = new, price
        if pivot % 50 == 49:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
        x = np.maximum(inverse @ counts, 0)
    return [(columns[:, j].astype(np.int64), float(x[j])) for j in range(k) if cost[j] > 0 and x[j] > 1e-9]


class Plan:
    """Intervals (length, first rank, places per sequence, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.next = dict.fromkeys(histogram, 0)
        self.room: dict[int, list[tuple[int, int]]] = {}  # free places -> runs (first sequence, sequences)
        self.rooms: list[int] = []
        left = {length: n for length, n in histogram.items() if n}
        large = sorted((x for x in left if x > capacity // SMALL_PART), reverse=True)
        if large:
            self._large(large, left, groups)
        for length in sorted(left, reverse=True):
            if left[length]:
                self._best_fit(length, left[length])

    def _take(self, length: int, sequences: int, each: int, first: int, used: int) -> None:
        self.rows.append((length, self.next[length], each, first, used))
        self.next[length] += sequences * each

    def _free(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.room:
                self.room[room] = []
                insort(self.rooms, room)
            self.room[room].append((first, n))

    def _large(self, large: list[int], left: dict[int, int], groups: int) -> None:
        total = sum(left[x] for x in large)
        size = -(-total // groups)
        members: list[list[list[int]]] = [[]]
        room = size
        for length in large:
            n = left[length]
            while n:
                if not room:
                    members.append([])
                    room = size
                m = min(n, room)
                members[-1].append([length, m])
                n, room = n - m, room - m
        sizes = np.array([m[0][0] for m in members])
        counts = np.array([sum(n for _, n in m) for m in members], dtype=float)
        # Groups rounded to one size are one size.
        distinct, which = np.unique(sizes, return_inverse=True)
        merged: list[list[list[int]]] = [[] for _ in distinct]
        for g, m in zip(which, members, strict=True):
            merged[g] += m
        demand = np.bincount(which, counts)
        for pattern, x in configurations(distinct, demand, self.capacity):
            self._configuration(pattern, int(x + 1e-6), merged, left)

    def _configuration(self, pattern: np.ndarray, times: int, members: list[list[list[int]]], left: dict[int, int]) -> None:
        """Puts documents in the places of a configuration, as many times as its groups last."""
        slots = [int(g) for g in np.flatnonzero(pattern)[::-1] for _ in range(pattern[g])]
        for g in set(slots):
            times = min(times, sum(n for _, n in members[g]) // int(pattern[g]))
        if not times:
            return
        runs = []
        for g in slots:
            need, run = times, []
            while need:
                length, n = members[g][0]
                m = min(n, need)
                run.append((length, m))
                left[length] -= m
                need -= m
                if m == n:
                    members[g].pop(0)
                else:
                    members[g][0][1] -= m
            runs.append(run)
        done = 0
        heads = [[0, r[0][1]] for r in runs]
        while done < times:
            m = min(h[1] for h in heads)
            lengths = [r[h[0]][0] for r, h in zip(runs, heads, strict=True)]
            room = self.capacity - sum(lengths)
            if self.capacity // TIGHT_PART < room < self.capacity // SMALL_PART:
                for length in lengths[1:]:
                    left[length] += m
                lengths = lengths[:1]
            used, first = 0, self.sequences
            for length in lengths:
                self._take(length, m, 1, first, used)
                used += length
            for r, h in zip(runs, heads, strict=True):
                h[1] -= m
                if not h[1] and h[0] + 1 < len(r):
                    h[0] += 1
                    h[1] = r[h[0]][1]
            self.sequences += m
            self._free(self.capacity - used, first, m)
            done += m

    def _put(self, length: int, room: int, first: int, n: int, each: int) -> None:
        if n and each:
            self._take(length, n, each, first, self.capacity - room)
            self._free(room - each * length, first, n)

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, count = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room], self.rooms[at]
            else:
                room, first, count = self.capacity, self.sequences, -(-n // (self.capacity // length))
                self.sequences += count
            each = room // length
            whole = min(count, n // each)
            self._put(length, room, first, whole, each)
            n -= whole * each
            part = 0
            if whole < count and n:
                part = 1
                self._put(length, room, first + whole, 1, n)
                n = 0
            rest = count - whole - part
            if rest:
                self._free(room, first + whole + part, rest)

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 5)
        return rows[:, 0] * (1 << 40) + rows[:, 1], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4]


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces(..., length), each 1 to capacity long -> the same with sequence_id and offset.

    Every row gets a place; places of a sequence are gapless from 0. Equal rows
    get places of their own. Which of two equal lengths goes where depends on
    the rows' hashes and on how many rows there are; how many sequences there
    are does not. pieces is read several times: pass one that is written. Its columns may have any names but ``length``, sequence_id and
    offset, which have the meanings above. An empty table gives no rows.
    """
    names = pieces.columns
    counted = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    total = sum(r["count"] for r in counted)
    keys, ranks, each, first, used = Plan({int(r["length"]): int(r["count"]) for r in counted}, capacity, groups).arrays()
    buckets = max(256, total // 1_000_000)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    salted = pieces.select(row, F.col("length").alias("length"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(buckets)).alias("bucket"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "bucket").count()
    base = base.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = salted.withColumn("within", within).join(base, ["length", "bucket"])
    ranked = ranked.select((F.col("base") + F.col("within")).alias("rank"), *[F.col("row").getField(c).alias(c) for c in names])

    at_length = 1 + names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, length = b.column(0).to_numpy(), b.column(at_length).to_numpy()
            i = np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1
            past = rank - ranks[i]
            sequence, offset = first[i] + past // each[i], used[i] + past % each[i] * length
            columns = b.columns[1:]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """placed(sequence_id, offset, ids) -> (sequence_id, ids): each sequence's ids joined.

    A sequence has at most the capacity of ids, which bounds what is gathered.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
