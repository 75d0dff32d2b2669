"""A league of models, chosen by cross-validation within training rows; the test rows are opened once, for the winner and the baselines."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.operators import metrics, models, preprocess, split, trees
from plumbline.plans import experiment
from plumbline.sources import scratch

#: A family each, in the order in which ties are decided; the first two kinds are never chosen, they are what a winner has to beat.
ROSTER = ["majority", "logistic", "rule", "bayes", "ridge", "margin", "network", "extra", "forest", "hgb"]
CANDIDATES = [m for m in ROSTER if m not in models.BASELINES]
FOLDS = 5
#: Fits beside each other.
ABREAST = 8
HIDDEN = 16
#: What convergence is to the linear models.
TOLERANCE = 1e-4


@dataclass
class Standing:
    """folds: the metrics of each model and fold; means: of each model over its folds. Test metrics are of the winner and the baselines alone."""

    spec: experiment.Spec
    folds: dict[tuple[str, int], dict[str, float]]
    means: dict[str, dict[str, float]]
    winner: str
    baseline: str
    test: dict[str, dict[str, float]]
    verdict: metrics.Verdict


def fit(name: str, train: DataFrame, lay: trees.Layout, key: str, rows: int, seed: int, settings: models.Settings):  # noqa: ANN201
    """A fitted model of the roster, majority apart."""
    common = {"featuresCol": "features", "labelCol": "y"}
    if name == "rule":
        return DecisionTreeClassifier(**common, maxDepth=3, seed=seed).fit(train)
    if name == "bayes":
        return NaiveBayes(**common, modelType="gaussian").fit(train)
    if name == "ridge":
        signed = train.withColumn("y", 2 * F.col("y") - 1)
        return LinearRegression(**common, regParam=1 / max(1, rows), standardization=False, maxIter=settings.iterations).fit(signed)
    if name == "margin":
        return LinearSVC(**common, regParam=1 / max(1, rows), maxIter=settings.iterations, tol=TOLERANCE, standardization=False).fit(train)
    if name == "network":
        return MultilayerPerceptronClassifier(**common, layers=[lay.slots, HIDDEN, 2], maxIter=min(100, settings.iterations), seed=seed).fit(train)
    if name == "extra":
        return trees.forest(train, lay, key, settings.trees, seed, extra=True)
    return models.fit(name, train, lay, key, rows, seed, settings)


def scored(name: str, model, df: DataFrame) -> DataFrame:  # noqa: ANN001
    """df with pred and score: a probability, or a margin from models that have none; either ranks rows."""
    out = model.transform(df)
    if name == "ridge":
        return out.select(*df.columns, (F.col("prediction") > 0).cast("int").alias("pred"), F.col("prediction").alias("score"))
    score = vector_to_array("rawPrediction" if name == "margin" else "probability")[1]
    return out.select(*df.columns, F.col("prediction").cast("int").alias("pred"), score.alias("score"))


def _fits(names: list[str], train: DataFrame, test: DataFrame, spec: experiment.Spec, key: str, settings: models.Settings, keep: list[str], cached: list[DataFrame]) -> list[Callable[[], DataFrame]]:
    """For each name what gives metrics.counted of test by model and keep, the preprocessing and the models learned from train alone.

    Counts are written as soon as a model is fitted: the driver then holds the
    models that are being fitted, not those of all folds and one plan of them all.
    """
    s = preprocess.learn(train, spec.numeric, spec.categorical)
    prep = preprocess.build(s, spec.numeric, spec.categorical, train)
    ready = prep.transform(train).select(key, "y", "features").persist()
    cached.append(ready)
    groups = preprocess.groups(s, spec.numeric, spec.categorical)
    lay = trees.layout(ready, len(spec.numeric) + sum(n for _, n in groups), groups)
    n, positive = ready.agg(F.count(F.lit(1)), F.sum("y")).first()
    most = int(2 * positive > n)
    rows = prep.transform(test).select(*keep, F.col("y").cast("int").alias("y"), "features")

    def made(name: str) -> DataFrame:
        if name == "majority":
            d = rows.withColumns({"pred": F.lit(most), "score": F.lit(float(most))})
        else:
            d = scored(name, fit(name, ready, lay, key, n, spec.seed, settings), rows)
        return scratch.stash(metrics.counted(d.select(F.lit(name).alias("model"), *keep, "y", "pred", "score"), ["model", *keep]), "counts")

    return [partial(made, name) for name in names]


def _all(pool: ThreadPoolExecutor, tasks: list[Callable[[], DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, pool.map(lambda f: f(), tasks))


def mean_metrics(folds: dict[tuple[str, int], dict[str, float]]) -> dict[str, dict[str, float]]:
    names = dict.fromkeys(m for m, _ in folds)
    return {m: {k: sum(x[k] for (own, _), x in folds.items() if own == m) / sum(own == m for own, _ in folds) for k in metrics.NAMES} for m in names}


def choose(scores: dict[str, dict[str, float]], metric: str, candidates: list[str], baselines: list[str]) -> tuple[str, str, metrics.Verdict]:
    """(winner, strongest baseline, verdict): the first of the greatest on each side, and how far apart they are."""
    winner = metrics.best_of({m: scores[m] for m in candidates}, metric)
    baseline = metrics.best_of({m: scores[m] for m in baselines}, metric)
    return winner, baseline, metrics.verdict(scores[winner], scores[baseline], metric)


def run(df: DataFrame, target: str, row_id: str, k: int = FOLDS, roster: list[str] | None = None, seed: int = split.SEED, settings: models.Settings | None = None) -> Standing:
    """Every model of the roster on every fold of the training rows, the best of their means on the test rows.

    Each fold has its own preprocessing, learned from the other folds. The
    counts of all models and folds are scored in one grouped pass. Test
    rows are read only after the winner is known, and only it and the baselines
    predict them. A class needs two rows in training at least for each fold to
    have learned it.
    """
    settings, roster = settings or models.Settings(), roster or ROSTER
    spec = experiment.prepare(df, target, seed, drop=(row_id,))
    label = cells.cell(df, target)[0]
    rows = split.stratified(df.filter(label.isNotNull()), label, row_id, seed=seed)
    typed = preprocess.typed(rows, spec.numeric, spec.categorical, [F.col(row_id), "part", (label == spec.positive).cast("double").alias("y")])
    typed = scratch.stash(typed.coalesce(max(1, -(-spec.rows // experiment.ROWS_PER_PARTITION))), "league")
    train = scratch.stash(split.folds(typed.filter("part = 'train'").drop("part"), F.col("y"), row_id, k, seed), "folds")
    cached: list[DataFrame] = []
    # Fits are many small jobs one after another, so those of all folds run beside each other.
    pool = ThreadPoolExecutor(ABREAST)
    try:
        prepared = pool.map(lambda f: _fits(roster, train.filter(F.col("fold") != f), train.filter(F.col("fold") == f), spec, row_id, settings, ["fold"], cached), range(k))
        counts = scratch.stash(_all(pool, [task for tasks in list(prepared) for task in tasks]), "league")
        found = {(r["model"], r["fold"]): {m: r[m] for m in metrics.NAMES} for r in metrics.evaluate_counts(counts, ["model", "fold"]).collect()}  # a row for each model and fold
        means = mean_metrics({(m, f): found[m, f] for m in roster for f in range(k) if (m, f) in found})
        winner = metrics.best_of({m: means[m] for m in roster if m in CANDIDATES}, spec.primary_metric)
        final = [*models.BASELINES, winner]
        counts = scratch.stash(_all(pool, _fits(final, train.drop("fold"), typed.filter("part = 'test'"), spec, row_id, settings, [], cached)), "league")
        test = {r["model"]: {m: r[m] for m in metrics.NAMES} for r in metrics.evaluate_counts(counts, ["model"]).collect()}  # a row for each model
        _, baseline, verdict = choose(test, spec.primary_metric, [winner], models.BASELINES)
        return Standing(spec, found, means, winner, baseline, test, verdict)
    finally:
        pool.shutdown()
        for frame in cached:
            frame.unpersist()
