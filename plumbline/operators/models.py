"""Baselines and candidates, all on one fitted preprocessing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import trees as trees_

BASELINES = ["majority", "logistic"]
#: In the order in which ties are decided.
CANDIDATES = ["forest", "hgb"]


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    rounds: int = 100
    leaves: int = trees_.LEAVES
    iterations: int = 1000


def fit(name: str, train: DataFrame, lay: trees_.Layout, key: str, rows: int, seed: int, settings: Settings):  # noqa: ANN201
    """A fitted model of train(features, y, key), whose vectors are laid out so."""
    if name == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="y", maxIter=settings.iterations, regParam=1 / max(1, rows), elasticNetParam=0.0, standardization=False).fit(train)
    if name == "forest":
        return trees_.forest(train, lay, key, settings.trees, seed)
    return trees_.boost(train, lay, key, settings.rounds, settings.leaves)


def scored(model, df: DataFrame) -> DataFrame:  # noqa: ANN001
    """df with pred (0 or 1) and score, the positive class's probability."""
    out = model.transform(df)
    return out.select(*df.columns, F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("score"))


def predictions(fitted: dict, test: DataFrame, majority: int) -> DataFrame:
    """(model, y, pred, score) of every model on the same test rows."""
    rows = test.select("y", "features")
    parts = [rows.select(F.lit("majority").alias("model"), F.col("y").cast("int").alias("y"), F.lit(majority).alias("pred"), F.lit(float(majority)).alias("score"))]
    parts += [scored(m, rows).select(F.lit(name).alias("model"), F.col("y").cast("int").alias("y"), "pred", "score") for name, m in fitted.items()]
    return reduce(DataFrame.unionByName, parts)
