import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import models, split
from plumbline.plans import league

FAST = models.Settings(trees=6, rounds=3, iterations=30)
ROSTER = ["majority", "logistic", "rule", "hgb"]


def rows(n=240):
    draw = np.random.default_rng(4)
    out = []
    for i in range(n):
        x, c = float(draw.normal()), "uvw"[i % 3]
        out.append((i, x, float(draw.normal()), c, "si" if x + (c == "u") + draw.normal() * 0.3 > 0.9 else "no"))
    return out


@pytest.fixture(scope="module")
def standing(spark):
    d = spark.createDataFrame(rows(), "id long, x double, noise double, c string, y string")
    return d, league.run(d, "y", "id", k=3, roster=ROSTER, settings=FAST)


def test_every_model_on_every_fold(standing):
    _, s = standing
    assert set(s.folds) == {(m, f) for m in ROSTER for f in range(3)} and list(s.means) == ROSTER
    assert s.means["rule"]["auc"] == pytest.approx(sum(s.folds["rule", f]["auc"] for f in range(3)) / 3)
    assert s.winner in ("rule", "hgb") and set(s.test) == {"majority", "logistic", s.winner} and s.means[s.winner]["auc"] > 0.8
    assert s.verdict.model_score == s.test[s.winner][s.spec.primary_metric]


def test_test_rows_never_influence_the_choice(spark, standing):
    d, s = standing
    parts = split.stratified(d, F.col("y"), "id")
    test = F.col("part") == "test"
    spoilt = parts.select("id", F.when(test, F.rand(3) * 100).otherwise(F.col("x")).alias("x"), F.when(test, 7.0).otherwise(F.col("noise")).alias("noise"), F.when(test, "w").otherwise(F.col("c")).alias("c"), "y")
    other = league.run(spark.createDataFrame(spoilt.collect(), d.schema), "y", "id", k=3, roster=ROSTER, settings=FAST)
    assert other.winner == s.winner and other.test != s.test
    assert all(other.folds[k][m] == pytest.approx(s.folds[k][m]) for k in s.folds for m in ("auc", "f1"))


def test_whole_roster(spark, standing):
    d, _ = standing
    s = league.run(d, "y", "id", k=2, settings=FAST)
    assert list(s.means) == league.ROSTER and all(s.means[m]["auc"] > 0.75 for m in league.ROSTER if m != "majority") and s.means["majority"]["auc"] == 0.5


def test_folds_are_stratified(spark):
    d = spark.createDataFrame([(i, "a" if i % 7 else None) for i in range(300)], "id long, label string")
    got = split.folds(d, F.col("label"), "id", 4).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in got if r["label"] == "a"} <= {64, 65} and {r["count"] for r in got if r["label"] is None} <= {10, 11} and len(got) == 8
    assert split.folds(d.limit(0), F.col("label"), "id").count() == 0
    with pytest.raises(ValueError, match="folds"):
        split.folds(d, F.col("label"), "id", 1)


def test_counts_of_a_model_are_written_once_it_is_fitted(spark, standing, monkeypatch):
    """What is scored in one pass are written counts, so that no plan has the models of all folds."""
    d, s = standing
    seen, whole = [], league._all

    def kept(pool, tasks):
        seen.append(whole(pool, tasks))
        return seen[-1]

    monkeypatch.setattr(league, "_all", kept)
    again = league.run(d, "y", "id", k=3, roster=["majority", "rule"], settings=FAST)
    assert [set(x.columns) for x in seen] == [{"model", "fold", "pred", "num", "n", "hits"}, {"model", "pred", "num", "n", "hits"}]
    assert all("-counts/" in f for x in seen for f in x.inputFiles()) and all(again.folds["rule", f] == s.folds["rule", f] for f in range(3))
