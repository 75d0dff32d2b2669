"""The library's rules on small tables."""

import dataclasses
import json
from datetime import UTC, date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.functions.random import uniform
from plumbline.operators import eda, explain, leakage, metrics, models, preprocess, profile, ranks, sanitize, score, split
from plumbline.plans import artifact, experiment, modelcard, narrate
from plumbline.sources import csv_scan, examples, scored_csv, synthetic
from plumbline.streaming import scoring

FAST = models.Settings(trees=10, rounds=3, iterations=50)


def table(spark, names, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["__row_id long", *(f"`{n}` string" for n in names)]))


def test_cells(spark):
    raw = [None, "", " N/A ", "none", "-", "\t4 ", "1d", "0x1F", "1e999", "inf", "+.5", "1_0", " x ", "2024-01-02 10:30", "3/4/21", "24-1-1", "2024-1-5", "2024-01-05 7:30", "2024-01-05T07:30:01"]
    d = spark.createDataFrame([(x,) for x in raw], "c string").select("c", cells.text("c").alias("t"), cells.number("c").alias("n"), cells.looks_like_date("c").alias("d"))
    got = {r["c"]: (r["t"], r["n"], r["d"]) for r in d.collect()}
    assert all(got[x][0] is None for x in raw[:5])
    assert got["\t4 "] == ("4", 4.0, False) and got["+.5"][1] == 0.5 and got[" x "][0] == "x"
    assert all(got[x][1] is None for x in ("1d", "0x1F", "1e999", "inf", "1_0"))
    assert got["2024-01-02 10:30"][2] and got["3/4/21"][2] and not got["24-1-1"][2]
    assert got["2024-01-05T07:30:01"][2] and not got["2024-1-5"][2] and not got["2024-01-05 7:30"][2]


def test_cells_of_types_keep_their_text(spark):
    big = 2**53
    d = spark.createDataFrame([(big, 0.0, 1), (big + 1, -0.0, 0), (big, float("nan"), 0)], "k long, x double, y int")
    got = {r["name"]: (r["kind"], r["nulls"], r["cardinality"]) for r in profile.profile(d, ["k", "x", "y"]).collect()}
    assert got == {"k": ("numeric", 0, 2), "x": ("numeric", 1, 1), "y": ("numeric", 0, 2)}
    assert profile.two_classes(d, "y") == [("0", 2), ("1", 1)] and profile.two_classes(d, "k")[1] == (str(big + 1), 1)
    tie = spark.createDataFrame([("a",), ("ab",), ("b",), ("a",), ("ab",)], "c string")
    assert profile.two_classes(tie.filter("c <> 'b'"), "c")[1][0] == "a"
    assert profile.two_classes(spark.createDataFrame([("x",), ("y",)], "c string"), "c")[1][0] == "y"


def test_profile_and_classes(spark):
    d = table(spark, ["n", "m", "d", "y"], [("1", "a", "2024-01-01", "si "), ("2", "1", "2024-01-02", "no"), ("na", "", "x", "no"), ("2", "1", "1/2/2024", "no"), ("2", "1", "1/2/2024", "none")])
    got = {r["name"]: (r["kind"], r["nulls"], r["cardinality"], r["looks_like_date"]) for r in profile.profile(d, ["n", "m", "d", "y"]).collect()}
    assert got == {"n": ("numeric", 1, 2, False), "m": ("categorical", 1, 2, False), "d": ("categorical", 0, 4, True), "y": ("categorical", 1, 2, False)}
    assert profile.two_classes(d, "y") == [("no", 3), ("si", 1)]
    assert profile.two_classes(d, "d") == []
    assert [tuple(r) for r in profile.target_classes(d, "y", "__row_id").collect()] == [("si", 1), ("no", 3)]
    assert profile.features(d, "y", drop=("__row_id",)) == (["n"], ["m"])


def test_sanitation(spark):
    rows = [(f"id{i}", "k", str(i) if i else "s/d", "a" if i % 2 else "b") for i in range(12)]
    clean, r = sanitize.sanitize(table(spark, ["id", "const", "age", "y"], [*rows, rows[3], rows[3]]), "__row_id")
    assert (r.rows_before, r.rows_after, r.duplicates) == (14, 12, 2)
    assert r.exclusions == [("id", "id-column"), ("const", "constant-column")] and r.coercions == [("age", 1)]
    assert clean.columns == ["__row_id", "age", "y"] and r.usable and not r.clean
    assert {x["__row_id"]: x["age"] for x in clean.collect()}[0] == ""
    _, again = sanitize.sanitize(clean, "__row_id")
    assert again.clean
    spaced = table(spark, ["a", "b"], [("1", "x"), (" 1", "x"), ("1", "y")])
    assert sanitize.sanitize(spaced, "__row_id")[1].duplicates == 0


@pytest.mark.parametrize(("values", "target", "want"), [([1, 2, 3, 4], [0, 0, 1, 1], 1.0), ([4, 3, 2, 1], [0, 0, 1, 1], 0.0), ([1, 1, 1, 1], [0, 1, 0, 1], 0.5), ([1, 2], [1, 1], 0.5), ([1, 2, 2, 3], [0, 0, 1, 1], 0.875), ([None, 2, 1], [1, 1, 0], 1.0)])
def test_rank_auc(spark, values, target, want):
    d = spark.createDataFrame([(None if v is None else float(v), t) for v, t in zip(values, target, strict=True)], "v double, t int")
    counts = profile.distinct_cells(d, ["v"], F.col("t") == 1)
    assert leakage.rank_auc(counts, ["column"]).first()["auc"] == pytest.approx(want)


def test_leakage_and_alerts(spark):
    rows = [(str(i), str(i * 7 % 20), "p" if i < 10 else "q", f"u{i}", "1" if i >= 10 else "0") for i in range(20)]
    d = table(spark, ["proxy", "noise", "cat", "ref", "y"], rows)
    found = leakage.findings(d, F.col("y") == "1", ["proxy", "noise", "cat"])
    assert [(c, s) for c, s, _ in found] == [("proxy", 1.0), ("cat", 1.0)]
    kinds = [(r["kind"], r["column"]) for r in eda.alerts(d, "y", ["proxy", "noise", "cat", "ref", "y"]).collect()]
    assert kinds == [("possible-leak", "proxy"), ("possible-leak", "cat"), ("id-like", "ref")]
    few = table(spark, ["x", "y"], [(str(i % 3), "1" if i == 0 else "0") for i in range(20)])
    assert [r["kind"] for r in eda.alerts(few, "y", ["x", "y"]).collect()] == ["class-imbalance"]
    assert eda.alerts(few, "x").count() == 0 and eda.alerts(few, "absent").count() == 0


def test_split(spark):
    d = table(spark, ["y"], [("a",)] * 85 + [("b",)] * 15 + [("c",)])
    parts = split.stratified(d, F.col("y"), "__row_id")
    got = {(r["y"], r["part"]): r["count"] for r in parts.groupBy("y", "part").count().collect()}
    assert got == {("a", "test"): 21, ("a", "train"): 64, ("b", "test"): 4, ("b", "train"): 11, ("c", "train"): 1}
    assert parts.exceptAll(split.stratified(d.repartition(7), F.col("y"), "__row_id")).count() == 0
    assert [split.counter_random(42, k) for k in range(2)] == [0.6011037519201636, 0.44829055899754167]
    train, test = split.compatible(["a", "b"] * 20 + ["c"])
    assert sorted(train + test) == list(range(41)) and len(test) == 10 and 40 in train
    for bad in (0, 1, -1):
        with pytest.raises(ValueError, match="test size"):
            split.compatible(["a"], bad)


def test_metrics_and_verdict(spark):
    d = spark.createDataFrame([("m", 1, 1, 0.9), ("m", 1, 0, 0.4), ("m", 0, 1, 0.6), ("m", 0, 0, 0.1), ("z", 1, 0, 0.0), ("z", 0, 0, 0.0)], "model string, y int, pred int, score double")
    got = {r["model"]: r for r in metrics.evaluate(d, ["model"]).collect()}
    assert (got["m"]["accuracy"], got["m"]["f1"], got["m"]["auc"], got["m"]["tp"]) == (0.5, 0.5, 0.75, 1)
    assert (got["z"]["precision"], got["z"]["recall"], got["z"]["auc"]) == (0, 0, 0.5)
    assert [metrics.primary_metric(p) for p in (0.5, 0.36, 0.3, 0.7)] == ["f1", "f1", "auc", "auc"]
    assert [metrics.level(x) for x in (0.02, 0.01, -0.01, -0.02)] == ["beats", "ties", "ties", "loses"]
    assert metrics.best_of({"forest": {"f1": 0.5}, "hgb": {"f1": 0.5}}, "f1") == "forest"


def test_preprocessing_learns_from_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b"), (4.0, "b"), (None, "rara")], "x double, c string")
    s = preprocess.learn(train, ["x"], ["c"])
    assert s.medians == {"x": 2.5} and s.rare == {"c": ["rara"]} and s.ranges == {"x": (1.0, 4.0)} and s.modes == {"c": "a"}
    prep = preprocess.build(s, ["x"], ["c"], train)
    new = spark.createDataFrame([(2.5, "a"), (None, "rara"), (2.5, "nueva"), (2.5, None)], "x double, c string")
    vectors = [r["features"].toArray().tolist() for r in prep.transform(new).collect()]
    assert [v[1:] for v in vectors] == [[1, 0, 0], [0, 0, 1], [0, 0, 1], [1, 0, 0]] and len({v[0] for v in vectors}) == 1
    plain = preprocess.learn(train.filter("c <> 'rara'"), ["x"], ["c"])
    assert preprocess.build(plain, ["x"], ["c"], train).transform(new).collect()[2]["features"].toArray().tolist()[1:] == [0, 0]


def test_novelty_counts(spark):
    train = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(1, 11)], "x double, c string")
    s = preprocess.learn(train, ["x"], ["c"])
    new = spark.createDataFrame([(5.0, "a"), (99.0, "z"), (-1.0, "z"), (5.0, "z"), (None, "z"), (None, None)], "x double, c string")
    assert score.novelty_report(new, s, ["x"], ["c"]) == ([("x", "out-of-range", 2), ("c", "unseen-category", 4)], 4, 6)
    assert score.check_schema(["b", "y", "z"], ["a", "b"], "y") == score.SchemaCheck(["a"], ["z"], True)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(str(i), str(i * 37 % 11), "uv"[i % 2], "si" if i >= 34 else "no") for i in range(80)]
    d = table(spark, ["x", "noise", "c", "y"], rows)
    return d, *experiment.run(d, "y", "__row_id", settings=FAST, repeats=3)


def test_experiment(fitted):
    d, r, f = fitted
    assert (r.train_rows, r.test_rows) == (59, 21) and r.spec.positive == "no"
    assert set(r.scores) == {"majority", "logistic", "forest", "hgb"} and r.scores["majority"]["auc"] == 0.5
    assert r.features[0]["name"] == "x" and r.features[0]["importance"] > 2 * r.features[1]["importance"]
    assert {x["name"]: x["direction"] for x in r.features}["c"] is None
    assert [c for c, _, _ in r.leakage] == ["x"] and r.suspicious
    got = f.score(d).collect()
    assert {x["prediction"] for x in got} == {"si", "no"} and all(0 <= x["probability"] <= 1 for x in got)
    with pytest.raises(experiment.SchemaError):
        f.score(d.drop("noise"))


def test_experiment_errors(spark):
    d = table(spark, ["x", "when", "y"], [(str(i), "2024-01-01", "abc"[i % 3]) for i in range(9)])
    for names, code in ((["x", "y"], "target-not-binary"), (["when", "y"], "no-features")):
        source = d if code == "target-not-binary" else d.withColumn("y", F.when(F.col("x") > "4", "a").otherwise("b"))
        with pytest.raises(experiment.ExperimentError, match=code):
            experiment.prepare(source.select("__row_id", *names), "y", drop=("__row_id",))


def test_artifact_round_trip(spark, fitted, tmp_path):
    d, r, f = fitted
    path = f"file://{tmp_path}/model"
    manifest = artifact.save(f, r, path, "data.csv", now=datetime(2026, 1, 2, tzinfo=UTC))
    back, read, warnings = artifact.load(spark, path)
    assert read == json.loads(json.dumps(manifest)) and not warnings
    assert back.score(d).select("__row_id", "probability").exceptAll(f.score(d).select("__row_id", "probability")).count() == 0
    for change, code in (({"format_version": 2}, "unsupported-version"), ({"spec": None}, "invalid-format"), ({"format_version": "1"}, "invalid-format")):
        with pytest.raises(artifact.ArtifactError, match=code):
            artifact.validate(json.dumps(manifest | change))
    with pytest.raises(artifact.ArtifactError, match="invalid-format"):
        artifact.validate("not json")
    assert artifact.validate(json.dumps(manifest | {"versions": {"pyspark": "0"}}))[1]
    (tmp_path / "model/pipeline/extra").write_text("x")
    with pytest.raises(artifact.ArtifactError, match="hash-mismatch"):
        artifact.load(spark, path)
    with pytest.raises(artifact.ArtifactError, match="too-large"):
        artifact.load(spark, path, max_bytes=10)
    assert artifact.file_name("Mi Tabla.csv", datetime(2026, 1, 2)) == "modelo-mi-tabla-2026-01-02"


def test_streamed_scores_equal_batch_scores(spark, fitted, tmp_path):
    d, _, f = fitted
    d.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    scoring.score_stream(stream, f).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("scored").select("__row_id", "probability").exceptAll(f.score(d).select("__row_id", "probability")).count() == 0
    seen = []
    scoring.watch_novelty(stream, f, lambda *x: seen.append(x), f"{tmp_path}/check").awaitTermination(120)
    assert sum(x[3] for x in seen) == 80


def test_narration_and_card(fitted):
    d, r, _ = fitted
    p = narrate.payload(r, 4, [{"kind": "id-like", "column": "ref"}, {"kind": "class-imbalance", "minority_rate": 0.1}])
    assert narrate.check_request(p) and "si" not in json.dumps(p["explainability"]) and not narrate.check_request(p | {"rows": []})
    text = narrate.standard_text(p)
    assert "its own value of ref" in text and "10%" in text and "knows x may" in text
    assert narrate.standard_text(p | {"locale": "es"}).startswith("Con filas")
    # A text for every payload: of any size, and of none.
    large = p | {"dataset": {"rows": 10**12, "cols": 5}}
    assert narrate.check_request(large) and not narrate.check_request(large, narrate.COMPATIBLE_ROWS)
    assert narrate.narrate(large, narrate.mock_provider, max_rows=narrate.COMPATIBLE_ROWS) == {"ok": False, "reason": "invalid", "text": narrate.standard_text(large)}
    assert all(narrate.narrate(x, narrate.mock_provider)["text"] for x in ({}, None, p | {"verdict": {}}, {"locale": "es"}))
    for part, value in (("metrics", p["metrics"] | {"rows": [1]}), ("verdict", p["verdict"] | {"level": "wins"}), ("dataset", {"rows": True, "cols": 1}), ("leakage", ["x"] * 9), ("leakage", [""]), ("eda", [{"kind": "id-like", "column": "a", "cell": "b"}]), ("target", "t" * 121)):
        assert not narrate.check_request(p | {part: value})
    many = narrate.payload(dataclasses.replace(r, leakage=[(f"c{i}", 1.0, "") for i in range(30)]), 4, [{"kind": "id-like", "column": f"c{i}"} for i in range(30)])
    assert narrate.check_request(many) and len(many["leakage"]) == 8 and len(many["eda"]) == 20
    good = narrate.mock_provider(p)
    assert narrate.verify(p, good) is None and narrate.narrate(p, narrate.mock_provider)["ok"]
    first = good["claims"][0]
    for change, why in (
        ({"verdict_level": "other"}, "wrong-verdict"),
        ({"claims": [first | {"feature": "nope"}]}, "unknown-feature"),
        ({"claims": [first | {"direction": "sideways"}]}, "wrong-direction"),
        ({"claims": [first | {"importance": 9}]}, "wrong-importance"),
        ({"narrative": "–"}, "claim-not-in-narrative"),
        ({"claims": []}, "unclaimed-feature-mention"),
    ):
        assert narrate.verify(p, good | change) == why
    assert narrate.narrate(p, lambda p: good | {"narrative": "short"})["reason"] == "provider" and narrate.narrate(p, lambda p: good | {"more": 1})["reason"] == "provider"
    assert narrate.narrate(p, narrate.mock_provider, lambda p, o: {"accuracy": 9, "completeness": 5, "clarity": 5})["reason"] == "rejected"
    assert narrate.narrate(p, None)["reason"] == "unavailable" and narrate.narrate(p, lambda p: 1 / 0)["reason"] == "provider"
    assert narrate.narrate(p, narrate.mock_provider, lambda p, o: {"accuracy": 3, "completeness": 5, "clarity": 5})["reason"] == "rejected"
    limit = narrate.RateLimit(2, 60)
    assert [limit.allow("k", t) for t in (0, 1, 2, 60.5)] == [True, True, False, True]
    assert narrate.cost({"m": (1.0, 2.0)}, "m", 10**6, 10**6) == 3 and narrate.cost({}, "m", 1, 1) == 0
    card = modelcard.model_card(r, "data.csv", 4, date(2026, 1, 2), sanitize.Report(5, 4, 3, 2, [("id", "id-column")], [("age", 1)]))
    assert "Made on January 2, 2026." in card and modelcard.long_date(date(2026, 1, 2), "es") == "2 de enero de 2026"
    assert "1 repeated rows removed" in card and "| x | numeric |" in card and "suspicious" in card


def write(tmp_path, text, name="t.csv"):
    (tmp_path / name).write_bytes(text.encode())
    return f"{tmp_path}/{name}"


def test_csv_reads(spark, tmp_path):
    d = csv_scan.read(spark, write(tmp_path, '﻿a,b\r\n1,"x, ""q""\ny"\r\n\r\n2,\r\n3,""'))
    assert d.columns == ["a", "b", "__row_id"]
    assert [tuple(r) for r in d.orderBy("__row_id").collect()] == [("1", 'x, "q"\ny', 0), ("2", "", 1), ("3", "", 2)]
    one = csv_scan.read(spark, write(tmp_path, "a\n1\n \n2\n", "one.csv"))
    assert [r["a"] for r in one.orderBy("__row_id").collect()] == ["1", "2"]


@pytest.mark.parametrize(
    ("text", "code", "facts"),
    [
        ("a;b\n1;2\n", "wrong-delimiter", {"delimiter": ";"}),
        ("a\tb\n1\t2\n", "wrong-delimiter", {"delimiter": "\t"}),
        ("a,b\n", "empty", {}),
        ("", "empty", {}),
        ("a,a\n1,2\n", "duplicate-header", {"names": ["a"]}),
        ("a,b\n1,2\n3\n", "ragged", {"row": 3, "expected": 2, "found": 1}),
        ("a,b\n1,2,3\n", "ragged", {"row": 2, "expected": 2, "found": 3}),
        ("a,b\n1,2\n3,4\n5,6\n", "too-many-rows", {"rows": 3, "max_rows": 2}),
        ("a,b\n" + "1,2\n" * 50, "too-large", {"bytes": 204, "max_bytes": 100}),
    ],
)
def test_csv_refuses(spark, tmp_path, text, code, facts):
    with pytest.raises(csv_scan.CsvError) as e:
        csv_scan.read(spark, write(tmp_path, text), csv_scan.Limits(100, 2))
    assert e.value.code == code and e.value.facts == facts


def test_csv_line_by_line_and_whole_agree(spark, tmp_path):
    rows = "".join(f'{i},"a ""{i}"", b",\n' for i in range(300))
    plain = csv_scan.read(spark, write(tmp_path, "n,t,e\n" + rows, "plain.csv"))
    broken = csv_scan.read(spark, write(tmp_path, "n,t,e\n" + rows + '300,"x\ny",\n', "broken.csv"))
    assert plain.exceptAll(broken).count() == 0 and broken.count() == 301
    with pytest.raises(csv_scan.CsvError) as e:
        csv_scan.read(spark, write(tmp_path, "a,b\n1,2\n" + ",".join(map(str, range(500))) + "\n", "wide.csv"))
    assert e.value.facts == {"row": 3, "expected": 2, "found": 500}
    # A row with one field of white space is a blank row, whatever the header has.
    space = csv_scan.read(spark, write(tmp_path, "a,b\n1,2\n \u00a0\n3,4\n", "space.csv"))
    assert [tuple(r) for r in space.orderBy("__row_id").collect()] == [("1", "2", 0), ("3", "4", 1)]
    known = {"plain": examples.Example("plain.csv", "n")}
    assert examples.read(spark, str(tmp_path), known, "plain")[1] == "n" and examples.keys(known) == ["plain"]
    with pytest.raises(KeyError):
        examples.read(spark, str(tmp_path), known, "other")


def test_scored_csv(spark, tmp_path):
    assert scored_csv.column_names(["prediction", "prediction_2", "p"], "prediction", "p") == ("prediction_3", "p_2")
    assert scored_csv.slug("Mis Datos (1).CSV") == "mis-datos-1" and scored_csv.file_name("¡!", "scored") == "datos-scored.csv"
    d = spark.createDataFrame([('a "b", c\nd', "si", 0.123456)], "t string, prediction string, probability double")
    scored_csv.write(scored_csv.scored_table(d, ["t"]), f"{tmp_path}/out", single=True)
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{tmp_path}/out").collect()
    assert [tuple(r) for r in back] == [('a "b", c\nd', "si", "0.1235")]


def test_permutation_moves_values_within_their_column(spark):
    d = spark.createDataFrame([(i, float(i), "abc"[i % 3]) for i in range(20)], "id long, x double, c string")
    got = explain.permuted(d, "id", ["x"], ["c"], repeats=2).collect()
    assert len(got) == 80
    for feature in ("x", "c"):
        for repeat in range(2):
            rows = sorted((r for r in got if (r["feature"], r["repeat"]) == (feature, repeat)), key=lambda r: r["id"])
            own, other = [r["x"] for r in rows], [r["c"] for r in rows]
            assert sorted(own) == [float(i) for i in range(20)]
            assert (own == [float(i) for i in range(20)]) == (feature == "c") and (other == ["abc"[i % 3] for i in range(20)]) == (feature == "x")


def test_random_columns_follow_the_sequence(spark):
    got = [r["u"] for r in uniform(spark.range(200), F.col("id"), 42, "u").orderBy("id").collect()]
    assert got == [split.counter_random(42, k) for k in range(200)]


def test_published_tables(spark):
    """Profiles, leak scores and splits that are published for two of the tables."""
    m, a = synthetic.marketing(spark), synthetic.attrition(spark)
    distinct = {"age": 51, "income": 192, "visits": 40, "opened": 21, "region": 4, "device": 2, "converted": 2}
    assert {r["name"]: r["cardinality"] for r in profile.profile(m.drop("__row_id")).collect()} == distinct
    assert profile.two_classes(m, "converted") == [("1", 115), ("0", 85)] and profile.two_classes(a, "left") == [("0", 136), ("1", 64)]
    want = {"age": 0.5252, "income": 0.5079, "visits": 0.6740, "opened": 0.6283, "region": 0.5750, "device": 0.5750}
    assert {r["column"]: round(r["score"], 4) for r in leakage.scores(m, F.col("converted") == 0, [*want]).collect()} == want
    want = {"age": 0.5332, "years": 0.5643, "hours": 0.5841, "satisfaction": 0.6893, "department": 0.6800, "overtime": 0.6800}
    assert {r["column"]: round(r["score"], 4) for r in leakage.scores(a, F.col("left") == 1, [*want]).collect()} == want
    for d, target, sizes, first in ((m, "converted", (150, 50), [3, 7, 11, 14, 19, 26, 30, 34]), (a, "left", (150, 50), [2, 12, 19, 20, 22, 27, 30, 39])):
        train, test = split.compatible([str(r[target]) for r in d.orderBy("__row_id").collect()])
        assert (len(train), len(test)) == sizes and test[:8] == first
    assert eda.class_rates(m, "converted") == (0.425, 0.425, False) and metrics.primary_metric(0.425) == "f1" and metrics.primary_metric(0.32) == "auc"


def test_published_tables_whose_rows_take_varying_numbers(spark):
    loans, dirty = synthetic.loans(spark), synthetic.messy_customers(spark)
    distinct = {"income": 197, "amount": 199, "rating": 175, "work": 3, "recovered": 91, "defaulted": 2}
    assert {r["name"]: r["cardinality"] for r in profile.profile(loans.drop("__row_id")).collect()} == distinct
    assert profile.two_classes(loans, "defaulted") == [("0", 110), ("1", 90)]
    want = {"income": 0.5107, "amount": 0.6226, "rating": 0.7045, "work": 0.5650, "recovered": 1.0}
    assert {r["column"]: round(r["score"], 4) for r in leakage.scores(loans, F.col("defaulted") == 1, [*want]).collect()} == want
    train, test = split.compatible([str(r["defaulted"]) for r in loans.orderBy("__row_id").collect()])
    assert (len(train), len(test)) == (149, 51) and test[:8] == [2, 4, 9, 11, 13, 16, 19, 26]
    rows = dirty.orderBy("__row_id").collect()
    assert len(rows) == 200 and [r["__row_id"] for r in rows] == list(range(200))
    counts = {c: sum(r["channel"] == c for r in rows) for c in ("fax", "phone", "shop", "web")}
    assert counts == {"fax": 3, "phone": 63, "shop": 66, "web": 68} and sum(r["signed"] == "no" for r in rows) == 173
    kept, report = sanitize.sanitize(dirty, "__row_id")
    assert report.duplicates == 10 and report.exclusions == [("customer", "id-column"), ("country", "constant-column")] and report.coercions == [("age", 5)]
    want = {"age": 0.5029, "income": 0.6936, "channel": 0.8632}
    assert {r["column"]: round(r["score"], 4) for r in leakage.scores(kept, F.col("signed") == "yes", [*want]).collect()} == want
    train, test = split.compatible([r["signed"] for r in kept.orderBy("__row_id").collect()])
    assert (len(train), len(test)) == (142, 48) and test[:8] == [3, 6, 14, 16, 17, 20, 22, 23]


def test_vocabularies_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(preprocess, "MAX_CATEGORIES", 5)
    d = spark.createDataFrame([(f"v{i}", "ab"[i % 2]) for i in range(6)], "many string, few string")
    with pytest.raises(preprocess.VocabularyError) as e:
        preprocess.learn(d, [], ["many", "few"])
    assert e.value.columns == ["many"]
    assert preprocess.learn(d, [], ["few"]).categories == {"few": ["a", "b"]}
    assert len(score.preview(d, "many").collect()) == 6


def test_synthetic_tables(spark):
    loans = synthetic.loans(spark)
    assert [c for c, _, _ in leakage.findings(loans, F.col("defaulted") == 1, ["income", "amount", "rating", "work", "recovered"])] == ["recovered"]
    for made, target in ((synthetic.marketing(spark), "converted"), (synthetic.attrition(spark), "left")):
        assert made.count() == 200 and 0.2 < made.agg(F.avg(target)).first()[0] < 0.8
    table, report = sanitize.sanitize(synthetic.messy_customers(spark), "__row_id")
    assert (report.rows_before, report.rows_after) == (200, 190)
    assert report.exclusions == [("customer", "id-column"), ("country", "constant-column")] and [c for c, _ in report.coercions] == ["age"]
    s = profile.summarize(table, "__row_id")
    assert s.rows == 190 and s.target_candidates == ["signed"] and len(s.preview) == 20 and s.date_columns == []


@pytest.mark.parametrize("n,classes,share", [(1, 1, 0.25), (2, 1, 0.5), (37, 2, 0.25), (400, 3, 0.4), (3000, 2, 0.25)])
def test_published_split_at_any_size(spark, n, classes, share):
    draw = np.random.default_rng(n)
    labels = [f"c{k}" for k in draw.integers(0, classes, n)]
    ids = sorted(draw.choice(10 * n, n, replace=False).tolist())
    rows = spark.createDataFrame(list(zip(ids, labels, strict=True)), "id long, label string").repartition(5)
    got = {r["id"]: r["part"] for r in split.published(rows, F.col("label"), "id", share).collect()}
    train, test = split.compatible(labels, share)
    assert len(got) == n and {i for i, p in got.items() if p == "test"} == {ids[k] for k in test} and len(train) + len(test) == n
    assert split.published(rows.limit(0), F.col("label"), "id").count() == 0


def test_experiment_with_the_published_split(spark):
    rows = [(str(i), str(i * 37 % 11), "uv"[i % 2], "si" if i % 3 else "no") for i in range(60)]
    d = table(spark, ["x", "noise", "c", "y"], rows)
    r, _ = experiment.run(d, "y", "__row_id", settings=FAST, repeats=1, compatible=True)
    assert (r.train_rows, r.test_rows) == (45, 15)


def plain_rows(text):
    """Rows of a CSV text, one character after another."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted and c == '"' and text[i + 1 : i + 2] == '"':
            cell, i = cell + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif quoted:
            cell += c
        elif c == ",":
            row, cell = [*row, cell], ""
        elif c == "\n":
            rows, row, cell = [*rows, [*row, cell]], [], ""
        elif c != "\r":
            cell += c
        i += 1
    return rows + ([[*row, cell]] if row or cell else [])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_csv_split_within_quotes(spark, tmp_path, monkeypatch, seed):
    draw = np.random.default_rng(seed)
    cell = lambda: "".join(draw.choice(["a", "é", " ", "x,", "\n", "\r\n", '""', "\n\n", "b"], draw.integers(0, 8)))
    lines = [f'{i},"{cell()}",{"m" * (i % 50)}"{cell()}"z,' + ('"' + "long\n" * 40 + '"' if i % 17 == 0 else "") for i in range(400)]
    text = 'n,"te\nxt",t,e\n' + "\n".join(lines) + ("\n" if seed % 2 else "")
    path = write(tmp_path, text, "split.csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        got = csv_scan.read(spark, path)
        rows = [tuple(r)[:-1] for r in got.orderBy("__row_id").collect()]
        assert [r["__row_id"] for r in got.select("__row_id").orderBy("__row_id").collect()] == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = plain_rows(text)
    assert got.columns == [*want[0], "__row_id"] and rows == [tuple(r) for r in want[1:]]


def test_csv_rules_of_quotes_blanks_and_several_files(spark, tmp_path):
    d = csv_scan.read(spark, write(tmp_path, 'a,b\n5"x" pipe,6"" hose\n\n1\r2,"x"y"\r\nz"\n', "q.csv"))
    assert [tuple(r)[:2] for r in d.orderBy("__row_id").collect()] == [tuple(r) for r in plain_rows('5"x" pipe,6"" hose\n1\r2,"x"y"\r\nz"\n')]
    with pytest.raises(csv_scan.CsvError) as e:
        csv_scan.read(spark, write(tmp_path, 'a,b\n"1\n",2\n"3\n"\n', "ragged.csv"))
    assert e.value.code == "ragged" and e.value.facts == {"row": 3, "expected": 2, "found": 1}
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"{k}.csv").write_text("a,b\n" + "".join(f'{k},"{i}\n"\n' for i in range(4)))
    got = csv_scan.read(spark, f"file://{tmp_path}/many").orderBy("__row_id").collect()
    assert [(r["a"], r["b"], r["__row_id"]) for r in got] == [(str(k), f"{i}\n", 4 * k + i) for k in range(3) for i in range(4)]
    with pytest.raises(csv_scan.CsvError, match="empty"):
        csv_scan.read(spark, write(tmp_path, '"a\n",b\n', "none.csv"))
    unclosed = csv_scan.read(spark, write(tmp_path, 'a,b\n1,"open\nstill,open', "open.csv"))
    assert [tuple(r) for r in unclosed.collect()] == [("1", "open\nstill,open", 0)]


def test_bucket_counts_the_lesser_edges(spark):
    sets = [[], [1.5], [1.0, 1.0, 2.0], [float(x) for x in range(ranks.BUCKETS - 1)], [-5.0, 0.0, 3.0, float("inf")]]
    values = [-1e300, -5.0, 0.0, 0.5, 1.0, 1.5, 2.0, 127.0, 127.5, 254.0, 1e300, float("nan")]
    rows = [(e, v) for e in sets for v in values]
    got = spark.createDataFrame(rows, "e array<double>, v double").select("e", "v", ranks.bucket(F.col("v"), F.col("e")).alias("b")).collect()
    # A value that is no number is above all others.
    assert [r["b"] for r in got] == [len(e) if v != v else sum(x < v for x in e) for e, v in rows]
