"""Registered queries of what is written and read: CSV files, scored tables, saved models, narration. With DuckDB SQL for the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import explain, models
from plumbline.plans import artifact, experiment, narrate
from plumbline.plans.queries import labelled, query, table
from plumbline.sources import csv_scan, scored_csv, scratch


def _uploaded(spark, sf_dir: str, extra: str) -> DataFrame:  # noqa: ANN001
    """Customers as a user might upload them: quotes, commas, empty cells and, with ``extra``, line breaks."""
    d = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS key", f"concat(c_name, ', \"', c_mktsegment, '\"{extra}') AS name", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment", "' padded ' AS padded"
    )
    path = scratch.path(spark, "upload")
    scored_csv.write(d, path)
    return csv_scan.read(spark, path)


def _o_uploaded(extra: str) -> str:
    return f"SELECT CAST(c_custkey AS VARCHAR) AS key, concat(c_name, ', \"', c_mktsegment, '\"', {extra}) AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment, ' padded ' AS padded FROM customer"


@query("src01_csv_scan", _o_uploaded("''"))
def csv_lines(spark, sf_dir):
    return _uploaded(spark, sf_dir, "").drop(csv_scan.ROW_ID)


@query("src01_csv_scan_with_breaks", _o_uploaded("chr(10) || 'next'"))
def csv_with_breaks(spark, sf_dir):
    return _uploaded(spark, sf_dir, "\\nnext").drop(csv_scan.ROW_ID)


@query("src10_row_ids", "SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM customer")
def csv_row_ids(spark, sf_dir):
    c = csv_scan.ROW_ID
    return _uploaded(spark, sf_dir, "").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("ids"), F.min(c).alias("first"), F.max(c).alias("last"))


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({names})"


# Customers written as files that are to be refused, or read all the same: name -> (lines, limits, outcome and facts in SQL).
_ROW = "concat(CAST(c_custkey AS STRING), {sep}, c_mktsegment)"
_REFUSED = {
    "semicolons": ("a;b", _ROW.format(sep="';'"), {}, "'wrong-delimiter', ';'"),
    "tabs": ("a\tb", _ROW.format(sep="'\t'"), {}, "'wrong-delimiter', '\t'"),
    "same name twice": ("a,a", _ROW.format(sep="','"), {}, "'duplicate-header', 'a'"),
    "too few fields": ("a,b", "IF(c_custkey = 20, '20', " + _ROW.format(sep="','") + ")", {}, "'ragged', (SELECT CAST(count(*) + 2 AS VARCHAR) || ' 2 1' FROM customer WHERE c_custkey < 20)"),
    "too many fields": ("a,b", "IF(c_custkey = 33, '1,2,3', " + _ROW.format(sep="','") + ")", {}, "'ragged', (SELECT CAST(count(*) + 2 AS VARCHAR) || ' 2 3' FROM customer WHERE c_custkey < 33)"),
    "too many rows": ("a,b", _ROW.format(sep="','"), {"max_rows": 50}, "'too-many-rows', (SELECT CAST(count(*) AS VARCHAR) || ' 50' FROM customer)"),
    "too many bytes": ("a,b", _ROW.format(sep="','"), {"max_bytes": 100}, "'too-large', (SELECT CAST(sum(length(CAST(c_custkey AS VARCHAR)) + length(c_mktsegment) + 2) + 4 AS VARCHAR) || ' 100' FROM customer)"),
    "a byte order mark": ("\ufeffa,b", _ROW.format(sep="','"), {}, "'read', (SELECT 'a,b ' || CAST(count(*) AS VARCHAR) FROM customer)"),
    "a quoted semicolon": ('"a;b",c', _ROW.format(sep="','"), {}, "'read', (SELECT 'a;b,c ' || CAST(count(*) AS VARCHAR) FROM customer)"),
    "blank lines": ("a,b", "IF(c_custkey % 7 = 0, '', " + _ROW.format(sep="','") + ")", {}, "'read', (SELECT 'a,b ' || CAST(count(*) AS VARCHAR) FROM customer WHERE c_custkey % 7 <> 0)"),
    "header alone": ("a,b", "IF(c_custkey > 0, ' ', '')", {}, "'empty', ''"),
}


@query("src02_csv_refusals", "\nUNION ALL ".join(f"SELECT '{name}' AS given, outcome, facts FROM (SELECT {sql}) AS v(outcome, facts)" for name, (*_, sql) in _REFUSED.items()))
def csv_refusals(spark, sf_dir):
    rows, customers = [], table(spark, sf_dir, "customer")
    for name, (header, line, limits, _) in _REFUSED.items():
        path = scratch.path(spark, "refused")
        head = customers.limit(1).select(F.lit(-1).cast("long").alias("k"), F.lit(header).alias("value"))
        # One file, so that its order is that of the keys.
        head.union(customers.select("c_custkey", F.expr(line))).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
        try:
            d = csv_scan.read(spark, path, csv_scan.Limits(**limits))
            rows.append((name, "read", f"{','.join(c for c in d.columns if c != csv_scan.ROW_ID)} {d.count()}"))
        except csv_scan.CsvError as e:
            rows.append((name, e.code, " ".join(",".join(x) if isinstance(x, list) else str(x) for x in e.facts.values())))
    return spark.createDataFrame(rows, "given string, outcome string, facts string")


@query("snk03_scored_file", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority || ', \"x\"' AS prediction, CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END AS prediction_2, printf('%.4f', least(1.0, o_totalprice / 700001.0)) AS probability FROM orders")
def scored_file(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(', "x"')).alias("own"), F.when(F.col("o_totalprice") > 150000, "dear").otherwise("cheap").alias("prediction"), F.least(F.lit(1.0), F.col("o_totalprice") / 700001.0).alias("probability"))
    name, chance = scored_csv.column_names(["o_orderkey", "prediction"], "prediction", "probability")
    out = d.select("o_orderkey", F.col("own").alias("prediction"), F.col("prediction").alias(name), F.format_string("%.4f", "probability").alias(chance))
    path = scratch.path(spark, "scored")
    scored_csv.write(out, path)
    return csv_scan.read(spark, path).drop(csv_scan.ROW_ID)


_CHANGES = [("whole", "loaded"), ("another version", "unsupported-version"), ("no spec", "invalid-format"), ("not json", "invalid-format"), ("a byte more", "hash-mismatch"), ("too large", "too-large"), ("same scores", "0")]


@query("art01_art05_saved_models", _values(_CHANGES, "given, outcome"))
def saved_models(spark, sf_dir):
    """Saves an experiment, reads it back whole and damaged, and counts scores that differ."""
    d = labelled(spark, sf_dir).select("doc_id", "lang", "n_chars", "toxic")
    result, fitted = experiment.run(d, "toxic", "doc_id", settings=models.Settings())
    path = scratch.path(spark, "model")
    manifest = artifact.save(fitted, result, path, "labels")
    rows = []

    def tried(name, action):  # noqa: ANN001, ANN202
        try:
            action()
            rows.append((name, "loaded"))
        except artifact.ArtifactError as e:
            rows.append((name, e.code))

    back = []
    tried("whole", lambda: back.append(artifact.load(spark, path)[0]))
    tried("another version", lambda: artifact.validate(json.dumps(manifest | {"format_version": 99})))
    tried("no spec", lambda: artifact.validate(json.dumps(manifest | {"spec": None})))
    tried("not json", lambda: artifact.validate("{"))
    score = lambda f: f.score(d).select("doc_id", "prediction", "probability")
    same = score(back[0]).exceptAll(score(fitted)).count()
    spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(f"{path}/pipeline/more")
    tried("a byte more", lambda: artifact.load(spark, path))
    tried("too large", lambda: artifact.load(spark, path, max_bytes=10))
    return spark.createDataFrame([*rows, ("same scores", str(same))], "given string, outcome string")


_PAYLOAD = {
    "locale": "en",
    "problem": "binary-classification",
    "target": "y",
    "dataset": {"rows": 200, "cols": 4},
    "metrics": dict.fromkeys(narrate.METRICS, 0.8),
    "verdict": {"level": "beats", "primary_metric": "auc", "model_score": 0.8, "baseline_score": 0.7, "delta": 0.1},
    "explainability": {"method": "permutation", "scoring": "auc", "features": [{"name": "años", "kind": "numeric", "importance": 0.12, "direction": "positive"}, {"name": "canal", "kind": "categorical", "importance": 0.05, "direction": None}]},
    "leakage": [],
}
_FOUND = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]
_O_CORRELATED = "\nUNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, corr({c}, CAST(l_returnflag = 'N' AS DOUBLE)) AS r FROM lineitem" for c in _FOUND)


@query(
    "nar03_verified_claims",
    f"""WITH f AS (SELECT feature, CASE WHEN abs(r) >= greatest(0.05, 2 / sqrt(n)) THEN CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END ELSE 'none' END AS direction FROM ({_O_CORRELATED}))
        SELECT feature, claimed, change, CASE WHEN change = 'verdict' THEN 'wrong-verdict' WHEN change = 'silent' THEN 'unclaimed-feature-mention' WHEN claimed <> direction THEN 'wrong-direction' WHEN change = 'size' THEN 'wrong-importance' END AS refused
        FROM f, (VALUES ('positive'), ('negative'), ('none')) c(claimed), (VALUES ('as told'), ('verdict'), ('size'), ('silent')) d(change)""",
)
def verified_claims(spark, sf_dir):
    """Claims of each direction about features of lineitem, whose directions the table tells."""
    d = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "N").cast("double"))
    ways, rows = {r["column"]: r["direction"] for r in explain.directions(d, _FOUND).collect()}, []  # a row for each feature
    for c in _FOUND:
        feature = {"name": c, "kind": "numeric", "importance": 0.12, "direction": ways[c]}
        payload = _PAYLOAD | {"explainability": {"method": "permutation", "scoring": "auc", "features": [feature]}}
        for claimed in ("positive", "negative", "none"):
            said = {"verdict_level": "beats", "narrative": f"The model beats the baseline, mostly by its {c} and by little else.", "claims": [{"feature": c, "direction": claimed, "importance": 0.12}]}
            changes = {"as told": {}, "verdict": {"verdict_level": "ties"}, "size": {"claims": [said["claims"][0] | {"importance": 0.3}]}, "silent": {"claims": []}}
            rows += [(c, claimed, name, narrate.verify(payload, said | change)) for name, change in changes.items()]
    return spark.createDataFrame(rows, "feature string, claimed string, change string, refused string")


@query("nar04_requests", "SELECT p_brand, p_size, length(repeat(p_brand, p_size)) BETWEEN 1 AND 120 AND n <= 20 AS kept FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)")
def requests(spark, sf_dir):
    """Requests whose target has a name as long as a part's size makes it, and an alert for each part of that brand and size."""
    found = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").count().collect()  # a row for each brand and size
    alert = {"kind": "class-imbalance", "minority_rate": 0.1}
    return spark.createDataFrame([(r["p_brand"], r["p_size"], narrate.check_request(_PAYLOAD | {"target": r["p_brand"] * r["p_size"], "eda": [alert] * r["count"]})) for r in found], "p_brand string, p_size int, kept boolean")
