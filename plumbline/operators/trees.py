"""Trees on binned columns: histogram gradient boosting, and forests without a bound on depth.

Columns are cut into bins once. Rows then travel in blocks, a column of codes
each, and what a split needs is a sum for each bin. Boosting grows a tree leaf
by leaf, the best gain first: while a leaf has many rows, executors add up its
histograms and the driver compares one best split for each column; a leaf whose
rows fit a task is finished by one. Trees of a forest each have a bounded draw
of rows, and grow as deep as those need; they are files, which executors write
and read, since all of them together would not fit the driver.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from plumbline.sources import scratch

#: Fixed values of the published boosting method: bins of a column, shrinkage, leaves of a tree, rows of a leaf, its least sum of second derivatives.
BINS, RATE, LEAVES, LEAST_ROWS, LEAST_HESSIAN = 255, 0.1, 31, 20, 1e-3
#: Its early stopping: rows beyond which it is used, one row in so many held out, rounds without gain, what counts as gain.
STOP_ROWS, HELD_OUT, PATIENCE, TOLERANCE = 10_000, 10, 10, 1e-7
#: Codes (rows times columns) of a block, and of a leaf that one task finishes.
BLOCK_CELLS, LEAF_CELLS = 1 << 21, 1 << 24
#: Rounds after which the state of boosting is written, so that a lost executor costs no more than those.
CUT = 10
#: Parameter of the fit: rows that a tree of a forest draws, on average, at most.
TREE_ROWS = 100_000
#: Rows that a task scores by a forest at once, each tree read for all of them.
SCORED_ROWS = 1 << 16
#: Codes that are counted together for a split, if one column has no more; rows for which all slots are.
SPLIT_CELLS, FEW_ROWS = 1 << 18, 256
_TINY = 1e-15


@dataclass
class Layout:
    """What columns a vector has: numeric slots with their cuts, and groups (first slot, size) of indicators of which one at most is 1."""

    numeric: list[int]
    cuts: list[list[float]]
    groups: list[tuple[int, int]] = field(default_factory=list)

    @property
    def sizes(self) -> list[int]:
        """Codes of each column: bins, and then categories with none of them at 0."""
        return [len(c) + 1 for c in self.cuts] + [n + 1 for _, n in self.groups]

    @property
    def slots(self) -> int:
        return len(self.numeric) + sum(n for _, n in self.groups)

    @property
    def kind(self) -> str:
        return "<u2" if max(self.sizes, default=0) < 1 << 16 else "<u4"

    def place(self, column: int, at: int) -> tuple[int, float]:
        """(slot, threshold) of a split: rows whose slot is no more than the threshold go left."""
        if column < len(self.numeric):
            return self.numeric[column], self.cuts[column][at]
        return self.groups[column - len(self.numeric)][0] + at - 1, 0.5


def layout(df: DataFrame, size: int, groups: list[tuple[int, int]] = (), features: str = "features", bins: int = BINS) -> Layout:
    """The layout of a vector column of that size: all slots but those of groups are numeric.

    A column of few distinct values is cut half way between each two, another
    at quantiles. What comes to the driver is a column's quantiles, or its
    values if they are fewer.
    """
    inside = {s for first, n in groups for s in range(first, first + n)}
    numeric = [s for s in range(size) if s not in inside]
    if not numeric:
        return Layout([], [], list(groups))
    d = df.select(vector_to_array(features).alias("a")).select(*[F.get("a", s).alias(f"s{s}") for s in numeric])
    shares = [k / bins for k in range(1, bins)]
    row = d.agg(*[f for s in numeric for f in (F.approx_count_distinct(f"s{s}", 0.02).alias(f"n{s}"), F.percentile_approx(f"s{s}", shares, F.lit(100 * bins)).alias(f"q{s}"))]).first()
    few = [s for s in numeric if row[f"n{s}"] <= 1.1 * bins]
    values: dict[int, list[float]] = {s: [] for s in few}
    if few:
        long = d.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"s{s}").alias("x")) for s in few])).alias("e")).select("e.*").filter("x IS NOT NULL").distinct()
        for r in long.collect():  # about as many for each column as it has bins
            values[r["s"]].append(r["x"])
    cuts = []
    for s in numeric:
        own = sorted(values.get(s, []))
        if own and len(own) <= bins:
            cuts.append([(a + b) / 2 for a, b in zip(own, own[1:], strict=False)])
        else:
            cuts.append(sorted(set(row[f"q{s}"] or [])))
    return Layout(numeric, cuts, list(groups))


def _columns(a: Column, lay: Layout) -> tuple[Column, Column]:
    """Of a vector as an array: its numeric slots, and for each group which indicator is 1, 0 if none is."""
    numeric = F.array(*[F.get(a, s) for s in lay.numeric]) if lay.numeric else F.array().cast("array<double>")
    which = F.array(*[F.array_position(F.slice(a, first + 1, n), 1.0) for first, n in lay.groups]) if lay.groups else F.array().cast("array<bigint>")
    return numeric, which


def _codes(numeric: pa.Array, which: pa.Array, cuts: list[np.ndarray], width: int, kind: str) -> np.ndarray:
    """The codes (columns, rows) of what _columns gives."""
    n = len(numeric)
    codes = np.zeros((width, n), kind)
    x = numeric.flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
    for j, c in enumerate(cuts):
        codes[j] = np.searchsorted(c, x[:, j], "left")
    codes[len(cuts) :] = which.flatten().to_numpy(zero_copy_only=False).reshape(n, width - len(cuts)).T
    return codes


def blocks(df: DataFrame, lay: Layout, key: str, features: str = "features") -> DataFrame:
    """df(features, y, key) -> (n, codes, y, h): rows in blocks, column by column; h is the hash of the key that draws are made by."""
    numeric, which = _columns(F.col("a"), lay)
    d = df.select(vector_to_array(features).alias("a"), F.col("y").cast("int").alias("y"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"))
    cuts, width, kind = [np.array(c) for c in lay.cuts], len(lay.sizes), lay.kind
    most = max(1, BLOCK_CELLS // max(1, width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            codes, y, h = (np.concatenate([x[k] for x in held], axis=-1) for k in range(3))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (codes, y, h)]], names=["n", "codes", "y", "h"])

        for b in batches:
            codes = _codes(b.column(0), b.column(1), cuts, width, kind)
            y, h = b.column(2).to_numpy(zero_copy_only=False).astype(np.int8), b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, b.num_rows, most):
                if held and sum(len(p[1]) for p in held) + len(y[k : k + most]) > most:
                    yield block()
                held.append((codes[:, k : k + most], y[k : k + most], h[k : k + most]))
        if held:
            yield block()

    return d.select(numeric.alias("x"), which.alias("c"), "y", "h").mapInArrow(pack, "n bigint, codes binary, y binary, h binary")


def _opened(b: pa.RecordBatch, lay: Layout) -> Iterator[tuple[np.ndarray, ...]]:
    """(codes, y, h, raw) of each block of a batch; raw if it has one."""
    names = b.schema.names
    for k in range(b.num_rows):
        get = lambda c, kind: np.frombuffer(b.column(names.index(c))[k].as_py(), kind)  # noqa: B023, E731
        n = b.column(0)[k].as_py()
        yield get("codes", lay.kind).reshape(-1, n), get("y", np.int8), get("h", np.uint64), get("raw", np.float64) if "raw" in names else None


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashes and a number, the same wherever a row is."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


# Splits.


@dataclass
class Split:
    """A split and the sums (gradient, hessian, rows) on its two sides. Codes of a numeric column up to ``at`` go left, of a group all but ``at``."""

    gain: float
    column: int
    at: int
    left: tuple[float, float, float]
    right: tuple[float, float, float]


def best_split(hist: np.ndarray, column: int, group: bool, least_rows: int = LEAST_ROWS, least_hessian: float = LEAST_HESSIAN) -> Split | None:
    """The best split of one column's histogram (sums of gradients, hessians and rows by code), the first of equals."""
    total = hist.sum(1, keepdims=True)
    if group:
        right = hist[:, 1:]
        left = total - right
    else:
        left = np.cumsum(hist, axis=1)[:, :-1]
        right = total - left
    if not left.shape[1]:
        return None
    score = lambda s: s[0] ** 2 / (s[1] + _TINY)
    gain = score(left) + score(right) - score(total)
    ok = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= least_hessian) & (right[1] >= least_hessian)
    gain = np.where(ok, gain, -np.inf)
    k = int(np.argmax(gain))
    if not gain[k] > 0:
        return None
    return Split(float(gain[k]), column, k + 1 if group else k, tuple(map(float, left[:, k])), tuple(map(float, right[:, k])))


def histogram(codes: np.ndarray, g: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(codes, g, size), np.bincount(codes, h, size), np.bincount(codes, minlength=size).astype(float)])


def better(a: Split | None, b: Split | None) -> Split | None:
    """The one with the greater gain; of equals, that of the earlier column."""
    if a is None or b is None:
        return a or b
    return b if (b.gain, -b.column) > (a.gain, -a.column) else a


@dataclass
class Grown:
    """A tree while it grows: sums of nodes, splits found (None: there is none), and the children of split nodes."""

    sums: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    splits: dict[int, Split | None] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)

    def learn(self, node: int, split: Split | None) -> None:
        self.splits[node] = split
        if split:
            a = len(self.sums)
            self.children[node] = a, a + 1
            self.sums[a], self.sums[a + 1] = split.left, split.right
            for c in (a, a + 1):
                if self.sums[c][2] < 2 * LEAST_ROWS:
                    self.splits[c] = None

    def first(self, leaves: int) -> tuple[list[int], list[int]]:
        """(nodes split, leaves whose splits are not known) when the best gain goes first, as far as is known."""
        heap: list[tuple[float, int]] = []
        split, unknown = [], []

        def offer(node: int) -> None:
            if node not in self.splits:
                unknown.append(node)
            elif self.splits[node]:
                heapq.heappush(heap, (-self.splits[node].gain, node))

        offer(0)
        while heap and len(split) + 1 < leaves:
            node = heapq.heappop(heap)[1]
            split.append(node)
            for c in self.children[node]:
                offer(c)
        return split, unknown


def finish(codes: np.ndarray, g: np.ndarray, h: np.ndarray, lay: Layout, leaves: int = LEAVES) -> Grown:
    """A tree of rows that a task holds, the best gain first."""
    tree, rows = Grown({0: (float(g.sum()), float(h.sum()), float(len(g)))}), {0: np.arange(len(g))}
    if len(g) < 2 * LEAST_ROWS:
        tree.splits[0] = None
    sizes, numeric = lay.sizes, len(lay.numeric)
    while True:
        split, unknown = tree.first(leaves)
        for node in split:
            own = rows.pop(node, None)
            if own is not None:
                s = tree.splits[node]
                left = codes[s.column, own] <= s.at if s.column < numeric else codes[s.column, own] != s.at
                rows[tree.children[node][0]], rows[tree.children[node][1]] = own[left], own[~left]
        if not unknown:
            return tree
        for node in unknown:
            own, best = rows[node], None
            for j, size in enumerate(sizes):
                best = better(best, best_split(histogram(codes[j, own], g[own], h[own], size), j, j >= numeric))
            tree.learn(node, best)


# Trees as they are kept: arrays of nodes; a leaf has itself for children.


@dataclass
class Tree:
    column: list[int]
    at: list[int]
    left: list[int]
    right: list[int]
    value: list[float]

    def values(self, codes: np.ndarray, numeric: int) -> np.ndarray:
        """The value of the leaf of each row of codes (columns, rows)."""
        return np.array(self.value)[self.nodes(codes, numeric)]

    def nodes(self, codes: np.ndarray, numeric: int) -> np.ndarray:
        column, at, left, right = map(np.array, (self.column, self.at, self.left, self.right))
        node, going = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        while len(going := going[column[node[going]] >= 0]):
            here = node[going]
            code = codes[column[here], going]
            goes = np.where(column[here] < numeric, code <= at[here], code != at[here])
            node[going] = np.where(goes, left[here], right[here])
        return node


def _tree(grown: Grown, split: list[int], rate: float) -> tuple[Tree, list[int]]:
    """The tree of the nodes that are split, and which node of grown each of its nodes is."""
    order = [0]
    inner = set(split)
    for node in order:
        if node in inner:
            order += grown.children[node]
    place = {node: k for k, node in enumerate(order)}
    out = Tree([], [], [], [], [])
    for k, node in enumerate(order):
        s = grown.splits[node] if node in inner else None
        a, b = (place[c] for c in grown.children[node]) if s else (k, k)
        g, h, _ = grown.sums[node]
        for to, x in ((out.column, s.column if s else -1), (out.at, s.at if s else 0), (out.left, a), (out.right, b), (out.value, 0.0 if s else -rate * g / (h + _TINY))):
            to.append(x)
    return out, order


# Boosting.


def _derivatives(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-raw))
    return p - y, p * (1 - p)


def _held(h: np.ndarray, stop: bool) -> np.ndarray:
    """Rows that are held out to tell when to stop."""
    return _mixed(h, -1) < 1 / HELD_OUT if stop else np.zeros(len(h), bool)


_BEST = "node int, gain double, col int, at int, left array<double>, right array<double>"


def _searched(state: DataFrame, lay: Layout, tree: Tree, asked: dict[int, int], stop: bool) -> dict[int, Split | None]:
    """The best split of each asked node, from histograms that executors add up. asked: place in tree -> node."""
    numeric, sizes = len(lay.numeric), lay.sizes

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for codes, y, h, raw in _opened(b, lay):
                g, s = _derivatives(raw, y)
                at = np.where(_held(h, stop), -1, tree.nodes(codes, numeric))
                for place, node in asked.items():
                    own = np.flatnonzero(at == place)
                    for j, size in enumerate(sizes):
                        part = histogram(codes[j, own], g[own], s[own], size)
                        total[node, j] = total[node, j] + part if (node, j) in total else part
        task = TaskContext.get().partitionId()
        for (node, j), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([j], pa.int32()), pa.array([task], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["node", "col", "task", "sums"])

    def best(t: pa.Table) -> pa.Table:
        # In the order of tasks, so that sums come out the same each time.
        parts = sorted(zip(t["task"].to_pylist(), t["sums"].to_pylist(), strict=True))
        j = t["col"][0].as_py()
        s = best_split(sum(np.frombuffer(x).reshape(3, -1) for _, x in parts), j, j >= numeric)
        rows = [{"node": t["node"][0].as_py(), "gain": s.gain, "col": j, "at": s.at, "left": s.left, "right": s.right}] if s else []
        kinds = [("node", pa.int32()), ("gain", pa.float64()), ("col", pa.int32()), ("at", pa.int32()), ("left", pa.list_(pa.float64())), ("right", pa.list_(pa.float64()))]
        return pa.Table.from_pylist(rows, pa.schema(kinds))

    found: dict[int, Split | None] = dict.fromkeys(asked.values())
    got = state.mapInArrow(counted, "node int, col int, task int, sums binary").groupBy("node", "col").applyInArrow(best, _BEST)
    for r in sorted(got.collect(), key=lambda r: r["col"]):  # a row for each leaf and column
        found[r["node"]] = better(found[r["node"]], Split(r["gain"], r["col"], r["at"], tuple(r["left"]), tuple(r["right"])))
    return found


def _finished(state: DataFrame, lay: Layout, tree: Tree, asked: dict[int, int], stop: bool, leaves: int) -> dict[int, Grown]:
    """The subtree of each asked node, whose rows come together in one task."""
    numeric = len(lay.numeric)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for codes, y, h, raw in _opened(b, lay):
                g, s = _derivatives(raw, y)
                at = np.where(_held(h, stop), -1, tree.nodes(codes, numeric))
                for place, node in asked.items():
                    own = np.flatnonzero(at == place)
                    if len(own):
                        k += 1
                        parts = [np.ascontiguousarray(codes[:, own]), g[own], s[own]]
                        columns = [pa.array([x], pa.int32()) for x in (node, task, k)] + [pa.array([x.tobytes()], pa.binary()) for x in parts]
                        yield pa.RecordBatch.from_arrays(columns, names=["node", "task", "k", "codes", "g", "s"])

    def grown(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["task"], r["k"]))
        g, s = (np.concatenate([np.frombuffer(r[c]) for r in rows]) for c in ("g", "s"))
        codes = np.concatenate([np.frombuffer(r["codes"], lay.kind).reshape(len(lay.sizes), -1) for r in rows], axis=1)
        return pa.table({"node": pa.array([rows[0]["node"]], pa.int32()), "tree": pa.array([json.dumps(asdict(finish(codes, g, s, lay, leaves)))])})

    got = state.mapInArrow(dealt, "node int, task int, k int, codes binary, g binary, s binary").groupBy("node").applyInArrow(grown, "node int, tree string")
    out = {}
    for r in got.collect():  # a row for each leaf
        d = json.loads(r["tree"])
        split = lambda s: s and Split(s["gain"], s["column"], s["at"], tuple(s["left"]), tuple(s["right"]))
        out[r["node"]] = Grown({int(k): tuple(x) for k, x in d["sums"].items()}, {int(k): split(s) for k, s in d["splits"].items()}, {int(k): tuple(x) for k, x in d["children"].items()})
    return out


def _graft(tree: Grown, node: int, sub: Grown) -> None:
    """Sets a finished subtree in the place of a node."""
    to, waiting = {0: node}, [0]
    while waiting:
        k = waiting.pop(0)
        if k in sub.splits:
            tree.learn(to[k], sub.splits[k])
        if k in sub.children and sub.splits.get(k):
            for c, own in zip(sub.children[k], tree.children[to[k]], strict=True):
                to[c] = own
                waiting.append(c)


def _round(state: DataFrame, lay: Layout, stop: bool, leaves: int, rate: float, rows: int) -> Tree:
    tree = Grown({0: (0.0, 0.0, float(rows))})
    while True:
        split, unknown = tree.first(leaves)
        if not unknown:
            return _tree(tree, split, rate)[0]
        partial, order = _tree(tree, split, rate)
        place = {order.index(n): n for n in unknown}
        small = {p: n for p, n in place.items() if tree.sums[n][2] * len(lay.sizes) <= LEAF_CELLS}
        for node, sub in (_finished(state, lay, partial, small, stop, leaves) if small else {}).items():
            if node == 0:
                tree.sums[0] = sub.sums[0]
            _graft(tree, node, sub)
        large = {p: n for p, n in place.items() if p not in small}
        for node, s in (_searched(state, lay, partial, large, stop) if large else {}).items():
            if node == 0 and s:
                tree.sums[0] = tuple(a + b for a, b in zip(s.left, s.right, strict=True))
            tree.learn(node, s)
        for node in unknown:
            tree.splits.setdefault(node, None)


def _segment(state: DataFrame, lay: Layout, stop: bool, leaves: int, rate: float, rounds: int) -> list[Tree]:
    """The trees of the next rounds, where the rows of a root fit a task: what it finishes is then whole trees, one on another."""
    numeric = len(lay.numeric)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for codes, y, h, raw in _opened(b, lay):
                own = np.flatnonzero(~_held(h, stop))
                k += 1
                columns = [pa.array([x], pa.int32()) for x in (0, task, k)] + [pa.array([x.tobytes()], pa.binary()) for x in (np.ascontiguousarray(codes[:, own]), y[own], raw[own])]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "task", "k", "codes", "y", "raw"])

    def grown(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["task"], r["k"]))
        y, raw = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("y", np.int8), ("raw", np.float64)))
        codes, out = np.concatenate([np.frombuffer(r["codes"], lay.kind).reshape(len(lay.sizes), -1) for r in rows], axis=1), []
        while len(out) < rounds:
            tree = finish(codes, *_derivatives(raw, y), lay, leaves)
            out.append(_tree(tree, tree.first(leaves)[0], rate)[0])
            if len(out[-1].column) == 1:
                break
            raw = raw + out[-1].values(codes, numeric)
        return pa.table({"k": pa.array(range(len(out)), pa.int32()), "tree": pa.array([json.dumps(asdict(x)) for x in out])})

    got = state.mapInArrow(dealt, "node int, task int, k int, codes binary, y binary, raw binary").groupBy("node").applyInArrow(grown, "k int, tree string")
    return [Tree(**json.loads(r["tree"])) for r in sorted(got.collect(), key=lambda r: r["k"])]


def boost(df: DataFrame, lay: Layout, key: str, rounds: int = 100, leaves: int = LEAVES, rate: float = RATE, features: str = "features") -> TreesModel:
    """A model of df(features, y): y 0 or 1 without nulls, key a column that names a row.

    Beyond STOP_ROWS rows, one row in HELD_OUT tells when more rounds bring no
    gain. Sums are in the order of tasks, so that the same partitions give the
    same model. No row comes to the driver.
    """
    n, positive = df.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n:
        raise ValueError("no rows")
    stop, numeric = n > STOP_ROWS, len(lay.numeric)
    share = min(max(positive / n, 1e-7), 1 - 1e-7)
    base = float(np.log(share / (1 - share)))

    def added(more: list[Tree]):  # noqa: ANN202
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raws, losses, used = [], [], []
                for codes, y, h, raw in _opened(b, lay):
                    held = _held(h, stop)
                    raw, each = np.full(len(y), base) if raw is None else raw, []
                    for tree in more:
                        raw = raw + tree.values(codes, numeric)
                        each.append(float((np.logaddexp(0, raw) - y * raw)[held].sum()))
                    raws.append(raw.tobytes())
                    losses.append(each)
                    used.append(int((~held).sum()))
                columns = [b.column(b.schema.names.index(c)) for c in ("n", "codes", "y", "h")]
                columns += [pa.array(raws, pa.binary()), pa.array(losses, pa.list_(pa.float64())), pa.array(used, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "codes", "y", "h", "raw", "loss", "used"])

        return add

    schema = "n bigint, codes binary, y binary, h binary, raw binary, loss array<double>, used bigint"
    state = scratch.stash(blocks(df, lay, key, features).mapInArrow(added([]), schema), "boosting")
    used = state.agg(F.sum("used")).first()[0]
    small = used * len(lay.sizes) <= LEAF_CELLS
    trees: list[Tree] = []
    losses: list[float] = []
    held: list[DataFrame] = []
    try:
        while len(trees) < rounds:
            new = _segment(state, lay, stop, leaves, rate, min(CUT, rounds - len(trees))) if small else [_round(state, lay, stop, leaves, rate, used)]
            trees += new
            if len(new[-1].column) == 1 or len(trees) == rounds:  # one leaf: nothing left to split
                break
            state = state.mapInArrow(added(new), schema)
            if len(trees) % CUT:
                state = state.persist()
                held.append(state)
            else:
                state = scratch.stash(state, "boosting")
                while held:
                    held.pop().unpersist()
            if stop:
                row = state.agg(*[F.sum(F.get("loss", k)) for k in range(len(new))]).first()
                losses += [x / max(1, n - used) for x in row]
                done = next((k for k in range(PATIENCE + 1, len(losses) + 1) if min(losses[k - PATIENCE : k]) >= losses[k - PATIENCE - 1] - TOLERANCE), None)
                if done:
                    trees = trees[:done]
                    break
    finally:
        for old in held:
            old.unpersist()
    return TreesModel().of("boosting", base, trees, lay)


# Forests.


def _impurities(codes: np.ndarray, own: np.ndarray, w: np.ndarray, wy: np.ndarray, slots: list[tuple[int, int]], sizes: list[int], numeric: int) -> np.ndarray:
    """For each slot a row of its cuts' weighted impurities, less what all splits share; infinite where a cut splits nothing."""
    total, hits = w.sum(), wy.sum()
    wide = max([2, *(sizes[j] for j, _ in slots if j < numeric)])
    ln, lp = np.zeros((len(slots), wide - 1)), np.zeros((len(slots), wide - 1))
    numbers = [i for i, (j, _) in enumerate(slots) if j < numeric]
    if numbers:
        # One count for all these columns, a row of it each.
        at = (codes[np.array([slots[i][0] for i in numbers])[:, None], own] + (wide * np.arange(len(numbers)))[:, None]).ravel()
        for to, x in ((ln, w), (lp, wy)):
            to[numbers] = np.bincount(at, np.tile(x, len(numbers)), wide * len(numbers)).reshape(-1, wide).cumsum(1)[:, :-1]
    others = [i for i, (j, _) in enumerate(slots) if j >= numeric]
    if others:
        left = codes[np.array([slots[i][0] for i in others])[:, None], own] != np.array([slots[i][1] for i in others])[:, None]
        ln[others, 0], lp[others, 0] = left @ w, left @ wy
    rn, rp = total - ln, hits - lp
    ok = (ln > 0) & (rn > 0)
    ln[~ok] = rn[~ok] = 1
    return np.where(ok, lp * (ln - lp) / ln + rp * (rn - rp) / rn, np.inf)


def _gini_split(codes: np.ndarray, own: np.ndarray, w: np.ndarray, wy: np.ndarray, slots: list[tuple[int, int]], sizes: list[int], numeric: int, rng: np.random.Generator, most: int, one_cut: bool) -> tuple[int, int] | None:
    """(column, at) of the best split among ``most`` slots drawn at random, and more until one splits the rows; with one_cut at a random cut of each."""
    best, chosen, seen = np.inf, None, 0
    order = [slots[k] for k in rng.permutation(len(slots)).tolist()]
    # Few rows cost as much as the calls for them, so slots are counted together, those that may not be looked at as well.
    together, first = most if len(own) > FEW_ROWS else len(order), 0
    while first < len(order):
        part = order[first : first + max(1, min(together, SPLIT_CELLS // len(own)))]
        first, together = first + len(part), 4 * together
        impure = _impurities(codes, own, w, wy, part, sizes, numeric)
        least = impure.argmin(1).tolist()
        for i, (j, at) in enumerate(part):
            if seen >= most and chosen:
                return chosen
            k = least[i]
            if impure[i, k] == np.inf:
                continue
            seen += 1
            if one_cut:
                ok = np.flatnonzero(impure[i] < np.inf)
                k = int(rng.integers(ok[0], ok[-1] + 1))
            if impure[i, k] < best:
                best, chosen = float(impure[i, k]), (j, k if j < numeric else at)
    return chosen


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, lay: Layout, rng: np.random.Generator, most: int, one_cut: bool = False) -> Tree:
    """A tree of weighted rows, split until its leaves are pure or cannot be split."""
    out, waiting, numeric = Tree([], [], [], [], []), [(np.arange(len(y)), -1, False)], len(lay.numeric)
    slots = [(j, 0) for j in range(numeric)] + [(numeric + k, at) for k, (_, n) in enumerate(lay.groups) for at in range(1, n + 1)]
    sizes, wy = lay.sizes, w * y
    while waiting:
        own, parent, is_left = waiting.pop()
        me = len(out.column)
        if parent >= 0:
            (out.left if is_left else out.right)[parent] = me
        mine, hit = w[own], wy[own]
        hits, n = float(hit.sum()), float(mine.sum())
        split = _gini_split(codes, own, mine, hit, slots, sizes, numeric, rng, most, one_cut) if 0 < hits < n else None
        for to, x in ((out.column, split[0] if split else -1), (out.at, split[1] if split else 0), (out.left, me), (out.right, me), (out.value, hits / n if n else 0.0)):
            to.append(x)
        if split:
            code = codes[split[0], own]
            left = code <= split[1] if split[0] < numeric else code != split[1]
            waiting += [(own[~left], me, False), (own[left], me, True)]
    return out


def forest(df: DataFrame, lay: Layout, key: str, trees: int = 200, seed: int = 42, rows: int = TREE_ROWS, features: str = "features", extra: bool = False) -> TreesModel:
    """A forest of df(features, y): each tree of as many rows as there are, or ``rows`` if there are more, drawn with replacement from all.

    How often a row is drawn is a Poisson number of its key's hash. At each node
    the square root of the slots is looked at. Depth has no bound; a task holds
    one tree's rows. With ``extra`` each slot is looked at with one random cut,
    and where no more rows are there than a tree has, it has each of them once.
    """
    n = df.count()
    if not n:
        raise ValueError("no rows")
    mean, width = min(1.0, rows / n), len(lay.sizes)
    most = max(1, int(np.sqrt(lay.slots)))
    steps = np.cumsum([np.exp(-mean) * mean**k / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, y, h, _ in _opened(b, lay):
                for t in range(trees):
                    times = np.ones(len(h), np.uint8) if extra and mean == 1 else np.searchsorted(steps, _mixed(h, t + 1000 * seed), "right").astype(np.uint8)
                    own = np.flatnonzero(times)
                    parts = [np.ascontiguousarray(codes[:, own]), y[own], times[own]]
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["tree", "codes", "y", "w"])

    def grown(t: pa.Table) -> pa.Table:
        k = t["tree"][0].as_py()
        codes = np.concatenate([np.frombuffer(x, lay.kind).reshape(width, -1) for x in t["codes"].to_pylist()], axis=1)
        y, w = (np.concatenate([np.frombuffer(x, kind) for x in t[c].to_pylist()]).astype(float) for c, kind in (("y", np.int8), ("w", np.uint8)))
        tree = grow(codes, y, w, lay, np.random.default_rng([seed, k]), most, extra)
        return pa.table({"tree": pa.array([k], pa.int32())} | {c: pa.array([np.array(getattr(tree, c), kind).tobytes()], pa.binary()) for c, kind in _NODES.items()})

    dealt = blocks(df, lay, key, features).mapInArrow(drawn, "tree int, codes binary, y binary, w binary").repartition(trees, "tree")
    grown_trees = dealt.groupBy("tree").applyInArrow(grown, ", ".join(["tree int", *[f"{c} binary" for c in _NODES]]))
    # Their nodes, thousands a tree, never come to the driver.
    folder = scratch.path(df.sparkSession, "forest")
    grown_trees.write.partitionBy("tree").parquet(folder)
    return TreesModel().kept(folder, trees, lay)


#: What a file of a tree has of each node, and as which numbers; a node's left child is the next node.
_NODES = {"column": "<i4", "at": "<u4", "right": "<u4", "value": "<f8"}


def _read(folder: str, k: int) -> dict[str, np.ndarray] | None:
    """Tree k of a folder; None if it drew no rows."""
    files, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    at = f"{root}/tree={k}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return None
    got = pq.read_table(at, filesystem=files, columns=list(_NODES), partitioning=None)
    return {c: np.frombuffer(got.column(c)[0].as_py(), kind) for c, kind in _NODES.items()}


def _leaf_values(tree: dict[str, np.ndarray], rows: np.ndarray, width: int, numeric: int) -> np.ndarray:
    """The value of the leaf of each row, its codes side by side."""
    column, right, leaf = tree["column"].astype(np.int64), tree["right"].astype(np.int64), tree["column"] < 0
    number = leaf | (column < numeric)
    # Right go codes of numbers from here on, of groups this one; a leaf's test holds always and leads to itself.
    least = np.where(leaf, 0, tree["at"].astype(np.int64) + number)
    column[leaf] = 0
    out, place = np.zeros(len(rows) // width), np.arange(len(rows) // width)
    node, start = np.zeros(len(out), np.int64), place * width
    while len(node):
        for _ in range(4):  # rows that are in leaves stay there meanwhile
            over = rows.take(start + column.take(node)) - least.take(node)
            node = np.where((over == 0) | ((over > 0) & number.take(node)), right.take(node), node + 1)
        done = leaf.take(node)
        out[place[done]] = tree["value"].take(node[done])
        node, start, place = node[~done], start[~done], place[~done]
    return out


def _forest_values(codes: np.ndarray, numeric: int, folder: str, count: int) -> np.ndarray:
    """The mean over the trees of a folder, one in memory at a time, of each row of codes."""
    width, total, grown = len(codes), np.zeros(codes.shape[1]), 0
    rows = np.ascontiguousarray(codes.T).ravel()
    for k in range(count):
        if not (tree := _read(folder, k)):
            continue
        total += _leaf_values(tree, rows, width, numeric)
        grown += 1
    return total / max(1, grown)


# The model.


class _Writer(DefaultParamsWriter):
    """Parameters, and beside them the files of a forest."""

    def saveImpl(self, path: str) -> None:  # noqa: N802
        super().saveImpl(path)
        if self.instance.isSet("folder"):
            self.sparkSession.read.parquet(self.instance.getOrDefault("folder")).write.partitionBy("tree").parquet(f"{path}/trees")


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> TreesModel:
        model = super().load(path)
        if not model.isSet("folder"):
            return model
        saved = self.sparkSession.read.parquet(f"{path}/trees")
        folder = saved.inputFiles()[0].rpartition("/tree=")[0]
        try:
            fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        except (pa.ArrowInvalid, OSError):  # a store that only Spark reads
            folder = scratch.path(self.sparkSession, "forest")
            saved.write.partitionBy("tree").parquet(folder)
        return model._set(folder=folder)


class TreesModel(Transformer, MLReadable, MLWritable):
    """Adds probability (a vector) and prediction from a vector of features.

    All that boosting knows is one parameter of text. A forest's trees are files
    in ``folder``; they are copied when it is saved, and those of the saved one
    are read when it is loaded.
    """

    trees = Param(Params._dummy(), "trees", "kind, base value, and slots, thresholds, children and values of each tree, or how many files have them and by what layout", TypeConverters.toString)
    folder = Param(Params._dummy(), "folder", "files of a forest's trees", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", trees="{}")

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)

    def of(self, kind: str, base: float, trees: list[Tree], lay: Layout) -> TreesModel:
        kept = []
        for t in trees:
            places = [lay.place(c, a) if c >= 0 else (-1, 0.0) for c, a in zip(t.column, t.at, strict=True)]
            kept.append([[s for s, _ in places], [x for _, x in places], t.left, t.right, t.value])
        return self._set(trees=json.dumps({"kind": kind, "base": base, "trees": kept}))

    def kept(self, folder: str, count: int, lay: Layout) -> TreesModel:
        return self._set(folder=folder, trees=json.dumps({"kind": "forest", "base": 0.0, "count": count, "layout": asdict(lay)}))

    @property
    def known(self) -> dict:
        """The whole model; of a forest, trees may be far more than a driver holds."""
        known = json.loads(self.getOrDefault(self.trees))
        if not self.isSet("folder"):
            return known
        lay, out = _layout(known["layout"]), []
        for x in (_read(self.getOrDefault(self.folder), k) for k in range(known["count"])):
            if x:
                column, at, right = (x[c].tolist() for c in ("column", "at", "right"))
                left = [k + 1 if c >= 0 else k for k, c in enumerate(column)]
                out.append(Tree(column, at, left, right, x["value"].tolist()))
        return json.loads(TreesModel().of("forest", known["base"], out, lay).getOrDefault("trees"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        a = vector_to_array(self.getOrDefault(self.featuresCol))
        p = dataset.withColumn("__p", self._from_files(a) if self.isSet("folder") else self._from_text(a))
        p = p.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p"))))
        return p.withColumn("prediction", (F.col("__p") > 0.5).cast("double")).drop("__p")

    def _from_files(self, a: Column) -> Column:
        known, folder = json.loads(self.getOrDefault(self.trees)), self.getOrDefault(self.folder)
        lay, count = _layout(known["layout"]), known["count"]
        cuts, width, kind, numeric = [np.array(c) for c in lay.cuts], len(lay.sizes), lay.kind, len(lay.numeric)

        @F.arrow_udf("double")
        def probability(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            held: list[np.ndarray] = []
            for x, which in batches:
                held.append(_codes(x, which, cuts, width, kind))
                if sum(c.shape[1] for c in held) >= SCORED_ROWS:
                    yield pa.array(_forest_values(np.concatenate(held, axis=1), numeric, folder, count))
                    held.clear()
            if held:
                yield pa.array(_forest_values(np.concatenate(held, axis=1), numeric, folder, count))

        return probability(*_columns(a, lay))

    def _from_text(self, a: Column) -> Column:
        known = self.known
        used = sorted({s for t in known["trees"] for s in t[0] if s >= 0})
        place = {s: k for k, s in enumerate(used)} | {-1: 0}
        trees = [(np.array([place[s] for s in t[0]]), np.array(t[0]) >= 0, *map(np.array, t[1:])) for t in known["trees"]]
        boosted, base, width = known["kind"] == "boosting", known["base"], len(used)

        @F.arrow_udf("double")
        def probability(x: pa.Array) -> pa.Array:
            rows = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), width)
            total = np.full(len(rows), base)
            for slot, inner, threshold, left, right, value in trees:
                node, going = np.zeros(len(rows), np.int64), np.arange(len(rows))
                while len(going := going[inner[node[going]]]):
                    here = node[going]
                    node[going] = np.where(rows[going, slot[here]] <= threshold[here], left[here], right[here])
                total += value[node]
            return pa.array(1 / (1 + np.exp(-total)) if boosted else total / max(1, len(trees)))

        wanted = F.array(*[F.lit(s in place) for s in range(used[-1] + 1 if used else 1)])
        return probability(F.filter(a, lambda _, i: F.get(wanted, i)))


def _layout(known: dict) -> Layout:
    return Layout(known["numeric"], known["cuts"], [tuple(g) for g in known["groups"]])
