"""Boosting and forests against plain versions of the same methods."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import trees

GROUPS = [(3, 4)]


def rows_of(n, seed=1):
    draw = np.random.default_rng(seed)
    x = np.zeros((n, 7))
    x[:, 0] = draw.normal(size=n)
    x[:, 1] = draw.integers(0, 9, n)
    x[:, 2] = draw.normal(size=n).round(1)
    c = draw.integers(-1, 4, n)
    x[np.flatnonzero(c >= 0), 3 + c[c >= 0]] = 1
    y = (draw.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] * (x[:, 1] > 4) + 1.5 * (c == 2) - 0.5)))).astype(int)
    return x, y


def frame(spark, x, y):
    d = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, a array<double>, y double")
    return d.repartition(3).select("id", array_to_vector("a").alias("features"), "y")


def plain_boosting(x, y, lay, rounds, leaves, held):
    """Scores of every row after rounds of leaf-wise growth, over slots one by one."""
    use = ~held
    p = y[use].mean() if not held.any() else y.mean()
    raw = np.full(len(y), np.log(p / (1 - p)))
    cuts = {s: lay.cuts[k] for k, s in enumerate(lay.numeric)} | {s: [0.5] for first, n in lay.groups for s in range(first, first + n)}
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)

        def best(own):
            found = (0.0, None)
            value = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1e-15)  # noqa: B023, E731
            for s in sorted(cuts):
                for cut in cuts[s]:
                    left, right = own[x[own, s] <= cut], own[x[own, s] > cut]
                    if min(len(left), len(right)) >= 20 and min(h[left].sum(), h[right].sum()) >= 1e-3:  # noqa: B023
                        gain = value(left) + value(right) - value(own)
                        if gain > found[0] + 1e-12:
                            found = (gain, (s, cut))
            return found

        parts = [(np.flatnonzero(use), *best(np.flatnonzero(use)), np.arange(len(y)))]
        while len(parts) < leaves and max(p[1] for p in parts) > 0:
            k = max(range(len(parts)), key=lambda k: parts[k][1])
            own, _, (s, cut), every = parts.pop(k)
            for side in (True, False):
                part = own[(x[own, s] <= cut) == side]
                parts.append((part, *best(part), every[(x[every, s] <= cut) == side]))
        for own, _, _, every in parts:
            raw[every] -= 0.1 * g[own].sum() / (h[own].sum() + 1e-15)
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize("cells", [1 << 24, 0, 1200])
def test_boosting_by_plain_version(spark, monkeypatch, cells):
    """Leaves finished by a task, by histograms alone, and by both."""
    monkeypatch.setattr(trees, "LEAF_CELLS", cells)
    monkeypatch.setattr(trees, "BLOCK_CELLS", 300)
    x, y = rows_of(700)
    d = frame(spark, x, y)
    lay = trees.layout(d, 7, GROUPS, bins=40)
    assert lay.numeric == [0, 1, 2] and len(lay.cuts[0]) == 39 and lay.cuts[1] == [k + 0.5 for k in range(8)]
    model = trees.boost(d, lay, "id", rounds=4, leaves=8)
    got = {r["id"]: r for r in model.transform(d).select("id", vector_to_array("probability").alias("p"), "prediction").collect()}
    want = plain_boosting(x, y, lay, 4, 8, np.zeros(700, bool))
    assert all(abs(got[i]["p"][1] - want[i]) < 1e-9 and got[i]["prediction"] == (want[i] > 0.5) for i in range(700))
    assert {len(t[0]) for t in model.known["trees"]} == {15}


def test_boosting_stops_early_and_cuts_lineage(spark, monkeypatch):
    monkeypatch.setattr(trees, "STOP_ROWS", 400)
    monkeypatch.setattr(trees, "CUT", 3)
    draw = np.random.default_rng(2)
    x, y = rows_of(900)
    noise = draw.integers(0, 2, 900)
    d = frame(spark, x, noise)
    model = trees.boost(d, trees.layout(d, 7, GROUPS), "id", rounds=60)
    assert 10 < len(model.known["trees"]) < 60
    few = trees.boost(frame(spark, x, y), trees.layout(d, 7, GROUPS), "id", rounds=7)
    assert len(few.known["trees"]) == 7


def plain_tree(codes, y, w, lay):
    """Probabilities of a tree that looks at every split and goes on until it cannot."""
    n, numeric = w.sum(), len(lay.numeric)
    if 0 < (w * y).sum() < n:
        best = (np.inf, None)
        for j, size in enumerate(lay.sizes):
            for at in range(size - 1) if j < numeric else range(1, size):
                left = codes[j] <= at if j < numeric else codes[j] != at
                if left.any() and not left.all():
                    gini = sum((w[m] * y[m]).sum() * (w[m] * (1 - y[m])).sum() / w[m].sum() for m in (left, ~left))
                    best = min(best, (round(gini, 9), left.tolist()), key=lambda b: b[0])
        if best[1]:
            out, left = np.zeros(len(y)), np.array(best[1])
            for m in (left, ~left):
                out[m] = plain_tree(codes[:, m], y[m], w[m], lay)
            return out
    return np.full(len(y), (w * y).sum() / n)


def test_tree_by_plain_version():
    x, y = rows_of(400, 3)
    lay = trees.Layout([0, 1, 2], [sorted(set(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49)))) for k in range(3)], GROUPS)
    codes = np.stack([*[np.searchsorted(c, x[:, k], "left") for k, c in enumerate(lay.cuts)], np.where(x[:, 3:].any(1), x[:, 3:].argmax(1) + 1, 0)])
    w = np.random.default_rng(4).integers(1, 4, 400).astype(float)
    tree = trees.grow(codes, y.astype(float), w, lay, np.random.default_rng(0), lay.slots)
    got, want = tree.values(codes, 3), plain_tree(codes, y.astype(float), w, lay)
    # Of splits that are equally good either version may take any, so that leaves agree where they are pure: all rows that can be told apart.
    same = {tuple(c) for c in codes.T if len(set(y[(codes.T == c).all(1)])) == 1}
    assert all(abs(a - b) < 1e-9 for a, b, c in zip(got, want, codes.T, strict=True) if tuple(c) in same) and len(same) > 300


def test_forest_goes_as_deep_as_its_rows_need(spark, tmp_path):
    n = 3000
    x = np.stack([np.arange(n) % 251, np.arange(n) // 251, np.zeros(n)], 1).astype(float)
    y = ((x[:, 0] * 7 + x[:, 1] * 3) % 2).astype(int)
    d = frame(spark, x, y)
    lay = trees.layout(d, 3)
    model = trees.forest(d, lay, "id", trees=6)
    out = model.transform(d).select((F.col("prediction") == F.col("y")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]

    def depth(t, node=0):
        return 0 if t[0][node] < 0 else 1 + max(depth(t, t[2][node]), depth(t, t[3][node]))

    assert out > 0.8 and max(depth(t) for t in model.known["trees"]) > 12
    assert all(v in (0, 1) for t in model.known["trees"] for s, v in zip(t[0], t[4], strict=True) if s < 0)
    # A bounded draw of rows; the same rows in other partitions give the same trees.
    small = trees.forest(d, lay, "id", trees=4, rows=500)
    assert small.known == trees.forest(d.repartition(5), lay, "id", trees=4, rows=500).known
    assert max(len(t[0]) for t in small.known["trees"]) < max(len(t[0]) for t in model.known["trees"])
    PipelineModel([model]).write().overwrite().save(f"file://{tmp_path}/m")
    back = PipelineModel.load(f"file://{tmp_path}/m").transform(d)
    assert back.select("id", "prediction").exceptAll(model.transform(d).select("id", "prediction")).count() == 0


def test_models_of_odd_tables(spark):
    schema = "id long, a array<double>, y double"
    none = spark.createDataFrame([], schema).select("id", array_to_vector("a").alias("features"), "y")
    for fit in (trees.boost, trees.forest):
        with pytest.raises(ValueError, match="no rows"):
            fit(none, trees.Layout([0], [[0.5]]), "id")
    # One class, one value, and repeated keys.
    same = spark.createDataFrame([(None, [1.0, 0.0], 1.0)] * 60, schema).select("id", array_to_vector("a").alias("features"), "y")
    lay = trees.layout(same, 2, [(1, 1)])
    assert lay.cuts == [[]]
    for model in (trees.boost(same, lay, "id", rounds=3), trees.forest(same, lay, "id", trees=2)):
        assert {r["prediction"] for r in model.transform(same).collect()} == {1.0}


def test_forest_stays_out_of_the_driver(spark, tmp_path, monkeypatch):
    """What the driver has of a forest does not grow with its trees, and each task reads them for its rows, chunk by chunk."""
    draw = np.random.default_rng(5)
    x, _ = rows_of(1500)
    d = frame(spark, x, draw.integers(0, 2, 1500))
    lay = trees.layout(d, 7, GROUPS)
    few, more = trees.forest(d, lay, "id", trees=2), trees.forest(d, lay, "id", trees=9)
    assert sum(len(t[0]) for t in more.known["trees"]) > 4000
    kept = [len("".join(str(v) for v in m.extractParamMap().values())) for m in (few, more)]
    assert kept[0] == kept[1] < 40 * sum(map(len, lay.cuts)) + 1000
    known = more.known["trees"]

    def plain(row):
        total = 0.0
        for slot, threshold, left, right, value in known:
            k = 0
            while slot[k] >= 0:
                k = left[k] if row[slot[k]] <= threshold[k] else right[k]
            total += value[k]
        return total / len(known)

    monkeypatch.setattr(trees, "SCORED_ROWS", 100)
    score = lambda m: {r["id"]: r["p"][1] for r in m.transform(d).select("id", vector_to_array("probability").alias("p")).collect()}
    got = score(more)
    assert len(got) == 1500 and all(abs(got[i] - plain(x[i])) < 1e-12 for i in range(1500))
    PipelineModel([more]).write().save(f"file://{tmp_path}/m m")
    back = PipelineModel.load(f"file://{tmp_path}/m m").stages[0]
    assert back.getOrDefault("folder") != more.getOrDefault("folder") and back.known == more.known and score(back) == got


def test_slots_counted_together_split_as_one_by_one():
    """The same draws and the same tree, however many slots are counted at once."""
    x, y = rows_of(600, 6)
    lay = trees.Layout([0, 1, 2], [sorted(set(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49)))) for k in range(3)], GROUPS)
    codes = np.stack([*[np.searchsorted(c, x[:, k], "left") for k, c in enumerate(lay.cuts)], np.where(x[:, 3:].any(1), x[:, 3:].argmax(1) + 1, 0)])
    w = np.random.default_rng(4).integers(0, 4, 600).astype(float)
    one_cut = [False, True]
    grown = lambda: [trees.grow(codes, y.astype(float), w, lay, np.random.default_rng(1), 2, extra) for extra in one_cut]
    together = grown()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(trees, "SPLIT_CELLS", 1)
        assert grown() == together
