"""An experiment: check, split, scan, fit, compare, explain, score."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.operators import explain, leakage, metrics, models, preprocess, profile, score, split, trees
from plumbline.sources import scratch

#: Rows of a partition in which a small table is fitted.
ROWS_PER_PARTITION = 20_000


class ExperimentError(ValueError):
    """code says why the table cannot be used: target-not-binary or no-features."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Spec:
    target: str
    numeric: list[str]
    categorical: list[str]
    positive: str
    negative: str
    rows: int
    positive_rate: float
    primary_metric: str
    dropped_null_targets: int = 0
    seed: int = split.SEED


@dataclass
class Result:
    spec: Spec
    train_rows: int
    test_rows: int
    scores: dict[str, dict[str, float]]
    winner: str
    baseline: str
    verdict: metrics.Verdict
    confusion: dict[str, int]
    features: list[dict]
    scoring: str
    leakage: list[tuple[str, float, str]]
    statistics: preprocess.Statistics = field(default_factory=preprocess.Statistics)

    @property
    def suspicious(self) -> bool:
        return bool(self.leakage)


@dataclass
class Fitted:
    """The winner with its preprocessing: all that scoring needs."""

    spec: Spec
    statistics: preprocess.Statistics
    pipeline: PipelineModel

    def typed(self, df: DataFrame, keep: list = ()) -> DataFrame:
        return preprocess.typed(df, self.spec.numeric, self.spec.categorical, keep)

    def score(self, df: DataFrame) -> DataFrame:
        """df with prediction (a class of the target), probability (of the positive class) and is_novel.

        A lazy projection: it serves batches and streams alike. Raises
        SchemaError where a feature is missing.
        """
        check = score.check_schema(df.columns, self.spec.numeric + self.spec.categorical, self.spec.target)
        if not check.ok:
            raise SchemaError(check)
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
        typed = self.typed(df, [row])
        novel = score.any_of(score.novelty(typed, self.statistics, self.spec.numeric, self.spec.categorical))
        out = self.pipeline.transform(typed.withColumn("__novel", novel))
        label = F.when(F.col("prediction") == 1, self.spec.positive).otherwise(self.spec.negative)
        return out.select("__row.*", label.alias("prediction"), vector_to_array("probability")[1].alias("probability"), F.col("__novel").alias("is_novel"))

    def novelty(self, df: DataFrame) -> tuple[list[tuple[str, str, int]], int, int]:
        return score.novelty_report(self.typed(df), self.statistics, self.spec.numeric, self.spec.categorical)


class SchemaError(ValueError):
    def __init__(self, check: score.SchemaCheck):
        super().__init__(f"missing columns: {', '.join(check.missing)}")
        self.check = check


def prepare(df: DataFrame, target: str, seed: int = split.SEED, drop: tuple[str, ...] = ()) -> Spec:
    """What a run will use; raises ExperimentError before any model is fitted."""
    classes = profile.two_classes(df, target)
    if not classes:
        raise ExperimentError("target-not-binary")
    label = cells.cell(df, target)[0]
    numeric, categorical = profile.features(df.filter(label.isNotNull()), target, drop=drop)
    if not numeric and not categorical:
        raise ExperimentError("no-features")
    (negative, n0), (positive, n1) = classes
    rate = n1 / (n0 + n1)
    gone = df.filter(label.isNull()).count()
    return Spec(target, numeric, categorical, positive, negative, n0 + n1, rate, metrics.primary_metric(rate), gone, seed)


def run(df: DataFrame, target: str, row_id: str, seed: int = split.SEED, settings: models.Settings | None = None, repeats: int = explain.REPEATS, compatible: bool = False) -> tuple[Result, Fitted]:
    """Fits baselines and candidates on training rows and compares them on test rows.

    row_id names a unique column that is no feature. With ``compatible`` the
    split has the published sequence, rows being in order of row_id.
    """
    settings = settings or models.Settings()
    spec = prepare(df, target, seed, drop=(row_id,))
    label = cells.cell(df, target)[0]
    rows = df.filter(label.isNotNull())
    names = spec.numeric + spec.categorical
    parts = (split.published if compatible else split.stratified)(rows, label, row_id, seed=seed)
    typed = preprocess.typed(parts, spec.numeric, spec.categorical, [F.col(row_id), "part", (label == spec.positive).cast("double").alias("y")])
    # Fits start several jobs each; few rows in many partitions would be all overhead.
    typed = typed.coalesce(max(1, -(-spec.rows // ROWS_PER_PARTITION))).persist()
    cached = [typed]
    try:
        train, test = typed.filter("part = 'train'"), typed.filter("part = 'test'")
        sizes = {r["part"]: r["count"] for r in typed.groupBy("part").count().collect()}
        leaks = leakage.findings(parts.filter("part = 'train'"), label == spec.positive, names)
        statistics = preprocess.learn(train, spec.numeric, spec.categorical)
        prep = preprocess.build(statistics, spec.numeric, spec.categorical, train)
        ready = prep.transform(train).select(row_id, "y", "features").persist()
        ready_test = prep.transform(test).persist()
        cached += [ready, ready_test]
        groups = preprocess.groups(statistics, spec.numeric, spec.categorical)
        lay = trees.layout(ready, len(spec.numeric) + sum(n for _, n in groups), groups)
        names_fitted = ["logistic", *models.CANDIDATES]
        # Each fit is many small jobs one after another, so the fits run beside each other.
        with ThreadPoolExecutor(len(names_fitted)) as pool:
            fitted = dict(zip(names_fitted, pool.map(lambda name: models.fit(name, ready, lay, row_id, sizes["train"], seed, settings), names_fitted), strict=True))
        majority = 1 if spec.positive_rate > 0.5 else 0
        counts = scratch.stash(metrics.counted(models.predictions(fitted, ready_test, majority), ["model"]), "scores")
        compared = metrics.evaluate_counts(counts, ["model"]).collect()  # a row per model
        scores = {r["model"]: {m: r[m] for m in metrics.NAMES} for r in compared}
        confusion = {r["model"]: {c: r[c] for c in ("tn", "fp", "fn", "tp")} for r in compared}
        metric = spec.primary_metric
        winner = metrics.best_of({c: scores[c] for c in models.CANDIDATES}, metric)
        baseline = metrics.best_of({b: scores[b] for b in models.BASELINES}, metric)
        one_class = not (confusion[winner]["tp"] + confusion[winner]["fn"]) or not (confusion[winner]["tn"] + confusion[winner]["fp"])
        scoring = "accuracy" if one_class else "auc"
        moved = explain.permuted(test, row_id, spec.numeric, spec.categorical, repeats, seed)
        judged = models.scored(fitted[winner], prep.transform(moved).select("feature", "repeat", "y", "features"))
        losses = scratch.stash(metrics.counted(judged, ["feature", "repeat"]), "losses")
        found = {r["feature"]: r for r in explain.importances_of_counts(losses, scores[winner][scoring], scoring).collect()}  # a row per feature
        ways = {r["column"]: r["direction"] for r in explain.directions(test, spec.numeric).collect()} if spec.numeric else {}
        features = [
            {"name": c, "kind": "numeric" if c in spec.numeric else "categorical", "importance": found[c]["importance"], "std": found[c]["std"], "direction": ways.get(c) if explain.is_used(found[c]["importance"]) else None}
            for c in sorted(names, key=lambda c: (-found[c]["importance"], -names.index(c)))
        ]
        result = Result(spec, sizes.get("train", 0), sizes.get("test", 0), scores, winner, baseline, metrics.verdict(scores[winner], scores[baseline], metric), confusion[winner], features, scoring, leaks, statistics)
        return result, Fitted(spec, statistics, PipelineModel([*prep.stages, fitted[winner]]))
    finally:
        for frame in cached:
            frame.unpersist()
