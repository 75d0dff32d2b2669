"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at cosine 0.95 or more lie within a fixed distance epsilon. They
are sorted by their epsilon-wide grid cells on the leading principal
dimensions, and the sorted sequence is cut into intervals with bounding boxes.
Pairs of intervals are joined recursively, from coarse to fine: pairs whose
boxes are further apart than epsilon are skipped with all that they hold.
Between tasks the recursion follows a tree of intervals as joins on its nodes;
within a task it halves intervals down to small blocks, whose cosines one
matrix product gives in double precision. Intervals are files in the folder
that executors share, so that pairs of them are rows of two paths: the vectors
themselves are shuffled once, into their order. A task takes pairs in order and
holds the last few intervals.

Equal vectors count as one with a multiplicity. A task gives the number of
links of each vector, and only such links as join groups not yet joined.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyarrow import feather, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, work_path
from .components import connected_components

COSINE = 0.95
#: Leading principal dimensions of the grid.
AXES = 8
#: Bytes of vectors in an interval, and vectors in a block of the last recursion.
INTERVAL_BYTES, LEAF = 4 << 20, 256
#: Pairs of intervals in a task, about, and intervals that it holds.
PAIRS, HELD = 8, 8
#: Children of a node in the tree above the range partitions, as a power of 2.
FANOUT_BITS = 6
#: Added to the distance that boxes must exceed to be skipped, for rounding.
SLACK = 1e-9


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, raw): the vector as doubles and its digest, null where it links with nothing."""
    for b in batches:
        column = b.column(1)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) if len(column) else np.zeros(0)
        size = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
        ends = np.cumsum(size)
        raw = []
        for a, z in zip((ends - size).tolist(), ends.tolist(), strict=True):
            x = values[a:z]
            raw.append((x + 0.0).tobytes() if z > a and np.isfinite(x).all() and x.any() else None)
        keys = [None if x is None else blake2b(x, digest_size=16).digest() for x in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "raw"])


def _units(column: pa.Array) -> list[np.ndarray]:
    out = []
    for raw in column:
        x = np.frombuffer(raw.as_buffer(), np.float64)
        x = x / np.abs(x).max()
        out.append(x / np.sqrt(x @ x))
    return out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each dimension: count, sum and sum of outer products."""
    held: dict[int, list] = {}
    for b in batches:
        by: dict[int, list] = {}
        for x in _units(b.column(0)):
            by.setdefault(len(x), []).append(x)
        for dim, xs in by.items():
            x = np.stack(xs)
            n, s, c = held.get(dim, (0, 0.0, 0.0))
            held[dim] = [n + len(x), s + x.sum(0), c + x.T @ x]
    yield from _moment_rows(held)


def _moment_rows(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
    rows = [(d, n, s.tobytes(), c.tobytes()) for d, (n, s, c) in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["dim", "n", "s", "c"])


def _more_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            _add(held, r)
    yield from _moment_rows(held)


def _add(held: dict[int, list], r: dict) -> None:
    d = r["dim"]
    n, s, c = held.get(d, (0, np.zeros(d), np.zeros((d, d))))
    held[d] = [n + r["n"], s + np.frombuffer(r["s"]), c + np.frombuffer(r["c"]).reshape(d, d)]


def principal_axes(vectors: DataFrame, axes: int = AXES) -> dict[int, np.ndarray]:
    """Leading principal axes of vectors(raw), by dimension; from all of them, summed in two levels."""
    kinds = "dim int, n bigint, s binary, c binary"
    summed = vectors.select("raw").mapInArrow(_moments, kinds).repartition(8).mapInArrow(_more_moments, kinds)
    held: dict[int, list] = {}
    for r in summed.collect():  # at most 8 for each dimension
        _add(held, r.asDict())
    out = {}
    for d, (n, s, c) in held.items():
        _, v = np.linalg.eigh(c / n - np.outer(s / n, s / n))
        out[d] = np.ascontiguousarray(v[:, ::-1][:, :axes])
    return out


def _placed(axes: dict[int, np.ndarray], k: int):  # noqa: ANN202
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = _units(b.column(2))
            p = np.zeros((len(units), k))
            for i, x in enumerate(units):
                q = x @ axes[len(x)]
                p[i, : len(q)] = q
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(x) for x in units], pa.int32()), pa.array([x.tobytes() for x in units], pa.binary()), *(pa.array(p[:, j]) for j in range(k))],
                names=["node", "copies", "dim", "unit", *(f"p{j}" for j in range(k))],
            )

    return place


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _intervals(k: int, folder: str, interval_bytes: int, leaf: int):  # noqa: ANN202
    names = ["interval", "dim", "path", *(f"{e}{j}" for e in ("lo", "hi") for j in range(k))]
    kinds = [pa.int64(), pa.int32(), pa.string()] + [pa.float64()] * (2 * k)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        files, root = _files(folder)
        files.create_dir(root, recursive=True)

        def flush() -> pa.RecordBatch:
            nonlocal count, held
            p = np.array([h[3:] for h in held])
            columns = {"node": pa.array([h[0] for h in held], pa.int64()), "copies": pa.array([h[1] for h in held], pa.int64())}
            columns |= {"unit": pa.array([h[2] for h in held], pa.binary(len(held[0][2]))), "place": pa.array([x.tobytes() for x in p], pa.binary(8 * k))}
            name = f"{uuid.uuid4().hex}.interval"
            with files.open_output_stream(f"{root}/{name}") as out:
                feather.write_feather(pa.table(columns), out, compression="lz4")
            row = [(part << 32) + count, len(held[0][2]) // 8, f"{folder}/{name}", *p.min(0), *p.max(0)]
            count, held = count + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ["node", "copies", "unit", *(f"p{j}" for j in range(k))]), strict=True):
                if held and (len(held[0][2]) != len(row[2]) or (len(held) + 1) * len(row[2]) > max(interval_bytes, leaf * len(row[2]))):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return cut, names


def _near(eps: float, k: int) -> Column:
    """Whether boxes a and b may hold vectors within eps of each other."""
    gap = lambda j: F.greatest(F.col(f"a.lo{j}") - F.col(f"b.hi{j}"), F.col(f"b.lo{j}") - F.col(f"a.hi{j}"), F.lit(0.0))
    return sum((gap(j) * gap(j) for j in range(1, k)), gap(0) * gap(0)) <= (eps + SLACK) ** 2


def near_pairs(intervals: DataFrame, eps: float, k: int) -> DataFrame:
    """(a, b), a <= b: pairs of intervals that are not provably distant, found down the tree."""
    boxes = [F.min(f"lo{j}").alias(f"lo{j}") for j in range(k)] + [F.max(f"hi{j}").alias(f"hi{j}") for j in range(k)]
    sides = [f"{e}{j}" for e in ("lo", "hi") for j in range(k)]
    last = intervals.agg(F.max(F.shiftright("interval", 32))).first()[0]
    levels = [intervals.select(F.col("interval").alias("id"), F.shiftright("interval", 32).alias("up"), *sides)]
    while True:
        below = levels[-1]
        levels.append(below.groupBy(F.col("up").alias("id")).agg(*boxes).withColumn("up", F.shiftright("id", FANOUT_BITS)))
        if last == 0:
            break
        last >>= FANOUT_BITS
    pairs = levels[-1].select(F.col("id").alias("pa"), F.col("id").alias("pb"))
    for nodes in reversed(levels[:-1]):
        a, b = nodes.alias("a"), nodes.alias("b")
        both = pairs.join(a, F.col("pa") == F.col("a.up")).join(b, F.col("pb") == F.col("b.up"))
        both = both.filter((F.col("a.id") <= F.col("b.id")) & _near(eps, k))
        pairs = both.select(F.col("a.id").alias("pa"), F.col("b.id").alias("pb"))
    return pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def _distance2(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    gap = np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0)
    return float(gap @ gap)


class _Side:
    def __init__(self, path: str, leaf: int):
        folder, _, name = path.rpartition("/")
        files, root = _files(folder)
        with files.open_input_file(f"{root}/{name}") as f:
            t = feather.read_table(f).combine_chunks()
        flat = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist())).reshape(t.num_rows, -1)
        self.nodes, self.copies, self.x, p = t.column("node").to_numpy(), t.column("copies").to_numpy(), flat("unit"), flat("place")
        at = range(0, len(p), leaf)
        self.lo, self.hi = np.stack([p[i : i + leaf].min(0) for i in at]), np.stack([p[i : i + leaf].max(0) for i in at])


def _join(a: _Side, b: _Side, same: bool, cosine: float, size: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of a's and of b's vectors, and links that connect all that are linked."""
    eps2 = (math.sqrt(2 - 2 * cosine) + SLACK) ** 2
    links_a, links_b = np.zeros(len(a.nodes), np.int64), np.zeros(len(b.nodes), np.int64)
    off = 0 if same else len(a.nodes)
    label, forest = np.arange(off + len(b.nodes)), []

    def leaf(i: int, j: int) -> None:
        r, c = slice(i * size, (i + 1) * size), slice(j * size, (j + 1) * size)
        linked = a.x[r] @ b.x[c].T >= cosine
        if same and i == j:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        links_a[r] += linked @ b.copies[c]
        if not same or i != j:
            links_b[c] += a.copies[r] @ linked
        rows = np.flatnonzero(linked.any(1))
        base = j * size + off
        cols = np.flatnonzero(linked.any(0)) + base
        labels = label[cols]
        if (labels == labels[0]).all() and (label[rows + i * size] == labels[0]).all():
            return
        for q in rows:
            cols = np.flatnonzero(linked[q]) + base
            own = i * size + q
            labels, first = np.unique(label[cols], return_index=True)
            new = labels != label[own]
            if new.any():
                forest.extend((int(a.nodes[own]), int(b.nodes[v - off])) for v in cols[first[new]])
                label[np.isin(label, labels)] = label[own]

    def descend(i0: int, i1: int, j0: int, j1: int) -> None:
        if same and i0 >= j1:
            return
        if _distance2(a.lo[i0:i1].min(0), a.hi[i0:i1].max(0), b.lo[j0:j1].min(0), b.hi[j0:j1].max(0)) > eps2:
            return
        if i1 - i0 == 1 and j1 - j0 == 1:
            if not same or i0 <= j0:
                leaf(i0, j0)
        elif i1 - i0 >= j1 - j0:
            mid = (i0 + i1) // 2
            descend(i0, mid, j0, j1)
            descend(mid, i1, j0, j1)
        else:
            mid = (j0 + j1) // 2
            descend(i0, i1, j0, mid)
            descend(i0, i1, mid, j1)

    descend(0, len(a.lo), 0, len(b.lo))
    return links_a, links_b, forest


def _join_batches(cosine: float, leaf: int, held: int):  # noqa: ANN202
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = lru_cache(held)(lambda path: _Side(path, leaf))
        for batch in batches:
            for path_a, path_b in zip(batch.column("a_path").to_pylist(), batch.column("b_path").to_pylist(), strict=True):
                same = path_a == path_b
                a, b = side(path_a), side(path_b)
                links_a, links_b, forest = _join(a, b, same, cosine, leaf)
                counts = [(a, links_a + links_b)] if same else [(a, links_a), (b, links_b)]
                u = np.concatenate([s.nodes[n > 0] for s, n in counts])
                n = np.concatenate([n[n > 0] for _, n in counts])
                e = np.array(forest, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(u, e[:, 0])), pa.array([None] * len(u) + e[:, 1].tolist(), pa.int64()), pa.array(np.append(n, np.zeros(len(e), np.int64)))],
                    names=["u", "v", "n"],
                )

    return join


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: (id_col, n_links, component_id, kept).

    Rows link where the cosine of their vectors is at least ``cosine``, which
    must be above 0. A vector that is null, empty or zero, or holds a null or a
    component that is not finite, links with nothing, and vectors of different
    lengths do not link: such a row is a component of its own. n_links counts
    other rows, repeated ones too; component_id is the smallest id reachable;
    kept tells rows with that id. Null ids count for no minimum. Vectors of any
    length are taken whole. An empty table gives no rows; other columns are ignored whatever their names.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = stash(rows.mapInArrow(_raw, f"id {kind}, key binary, raw binary"), "raw")
    distinct = rows.filter("key IS NOT NULL").groupBy("key").agg(F.any_value("raw").alias("raw"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = stash(stash(distinct, "distinct").withColumn("node", F.monotonically_increasing_id()), "nodes")
    k, eps = AXES, math.sqrt(2 - 2 * cosine)
    axes = principal_axes(distinct, k)
    points = ", ".join(f"p{j} double" for j in range(k))
    placed = distinct.select("node", "copies", "raw").mapInArrow(_placed(axes, k), f"node bigint, copies bigint, dim int, unit binary, {points}")
    order = [F.col("dim"), *(F.floor(F.col(f"p{j}") / eps) for j in range(k)), *(F.col(f"p{j}") for j in range(k)), F.col("node")]
    cut, names = _intervals(k, work_path(vectors.sparkSession, "interval-files"), INTERVAL_BYTES, LEAF)
    sides = ", ".join(f"{c} double" for c in names[3:])
    intervals = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    intervals = stash(intervals.mapInArrow(cut, f"interval bigint, dim int, path string, {sides}"), "intervals")
    side = lambda s: intervals.select(F.col("interval").alias(s), F.col("dim").alias(f"{s}_dim"), F.col("path").alias(f"{s}_path"))
    if intervals.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    pairs = near_pairs(intervals, eps, k).join(side("a"), "a").join(side("b"), "b").filter("a_dim = b_dim")
    pairs = stash(pairs.select("a", "b", "a_path", "b_path"), "pairs")
    # Neighbouring pairs share intervals; how many are in a task is fixed, since their rows say nothing of the work behind them.
    joined = pairs.repartitionByRange(math.ceil(pairs.count() / PAIRS), "a", "b").sortWithinPartitions("a", "b")
    found = stash(joined.mapInArrow(_join_batches(cosine, LEAF, HELD), "u bigint, v bigint, n bigint"), "links")
    counts = found.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("v IS NOT NULL").select("u", "v"))
    named = distinct.select("key", "node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
    named = stash(named.withColumn("root", F.coalesce("root", "node")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = stash(named.join(least, "root").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.col("component"), F.lit(True).alias("found")), "classes")
    out = rows.select("id", "key").join(classes, "key", "left")
    component = F.when(F.col("found"), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
