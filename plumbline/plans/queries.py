"""Registered queries: each operator on the supplied tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.functions.random import uniform
from plumbline.operators import eda, explain, leakage, metrics, preprocess, profile, sanitize, score, split
from plumbline.plans import experiment, league
from plumbline.sources import scored_csv, scratch, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pieces of oracle SQL.
_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Written apart from the engine's own, so that a mistake in those is seen.
_TOKENS = "'', 'na', 'n/a', 'null', 'nan', 'none', '-'"
_O_NUMBER = "[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?"
_O_DATES = ["[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}", "[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"]


def o_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def o_null(x: str) -> str:
    return f"coalesce(lower({o_trim(x)}) IN ({_TOKENS}), true)"


def o_text(x: str) -> str:
    return f"CASE WHEN NOT {o_null(x)} THEN {o_trim(x)} END"


def o_num(x: str) -> str:
    t = o_trim(x)
    return f"CASE WHEN regexp_full_match({t}, '{_O_NUMBER}') AND isfinite(TRY_CAST({t} AS DOUBLE)) THEN TRY_CAST({t} AS DOUBLE) END"


def o_date(x: str) -> str:
    return "coalesce(" + " OR ".join(f"regexp_full_match({o_trim(x)}, '{p}')" for p in _O_DATES) + ", false)"


def o_split(source: str, label: str, row_id: str) -> str:
    """A table expression of source with ``part``."""
    return f"""(SELECT * EXCLUDE (__r, __n), CASE WHEN __n >= 2 AND __r <= greatest(1, least(floor(__n * 0.25 + 0.5), __n - 1)) THEN 'test' ELSE 'train' END AS part
        FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('42|' || CAST({row_id} AS VARCHAR)), {row_id}) AS __r, count(*) OVER (PARTITION BY {label}) AS __n FROM {source}))"""


def o_times(a: str, b: str) -> str:
    return f"((({a}) & 65535) * ({b}) + (((({a}) >> 16) * ({b}) & 65535) << 16)) & 4294967295"


# A table of text cells as a user might upload it, with nulls, junk, dates and repeated rows.
_MESSY_ROWS = """
    SELECT c_custkey AS row_id, c_name AS name, 'PE' AS country,
        CASE WHEN c_custkey % 40 = 0 THEN ' s/d ' WHEN c_custkey % 45 = 0 THEN ' N/A ' WHEN c_custkey % 47 = 0 THEN '-' ELSE concat(' ', CAST(c_nationkey AS VARCHAR(9))) END AS nation,
        CASE WHEN c_custkey % 30 = 0 THEN 'None' WHEN c_custkey % 7 = 0 THEN concat(c_mktsegment, ' ') ELSE c_mktsegment END AS segment,
        CASE WHEN c_custkey % 50 = 0 THEN '1e999' WHEN c_custkey % 51 = 0 THEN '0x1F' WHEN c_custkey % 53 = 0 THEN '12d' WHEN c_custkey % 2 = 0 THEN concat(CAST(c_custkey % 97 AS VARCHAR(9)), '.50') ELSE concat('+', CAST(c_custkey % 89 AS VARCHAR(9)), 'e1') END AS amount,
        CASE WHEN c_custkey % 60 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN '3/4/21' WHEN c_custkey % 13 = 0 THEN '2024-01-05 7:30' ELSE concat('2024-01-', CAST(10 + c_custkey % 19 AS VARCHAR(9)), ' 10:30') END AS since,
        CASE WHEN c_custkey % 9 = 0 THEN 'si' WHEN c_custkey % 100 = 1 THEN 'na' ELSE 'no' END AS target
    FROM {customer}
"""
_MESSY = f"SELECT * FROM ({_MESSY_ROWS}) UNION ALL SELECT row_id + 10000000, name, country, nation, segment, amount, since, target FROM ({_MESSY_ROWS}) WHERE row_id % 20 = 0"
_O_MESSY = "(" + _MESSY.replace("{customer}", "customer") + ")"
_MESSY_COLUMNS = ["name", "country", "nation", "segment", "amount", "since", "target"]
_O_ONCE = f"(SELECT min(row_id) AS row_id, {', '.join(_MESSY_COLUMNS)} FROM {_O_MESSY} GROUP BY {', '.join(_MESSY_COLUMNS)})"


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MESSY, customer=table(spark, sf_dir, "customer"))


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


# Cells.


@query("prj01_null_tokens", f"SELECT row_id, {o_null('nation')} AS nation_null, {o_null('segment')} AS segment_null, {o_null('since')} AS since_null FROM {_O_MESSY}")
def null_tokens(spark, sf_dir):
    return messy(spark, sf_dir).select("row_id", *[cells.is_null(c).alias(f"{c}_null") for c in ("nation", "segment", "since")])


@query("prj02_normalized_cells", f"SELECT row_id, {', '.join(f'{o_text(c)} AS {c}' for c in _MESSY_COLUMNS)} FROM {_O_MESSY}")
def normalized_cells(spark, sf_dir):
    return messy(spark, sf_dir).select("row_id", *[cells.text(c).alias(c) for c in _MESSY_COLUMNS])


@query("prj03_parsed_numbers", f"SELECT row_id, {o_num('nation')} AS nation, {o_num('amount')} AS amount, {o_num('segment')} AS segment FROM {_O_MESSY}")
def parsed_numbers(spark, sf_dir):
    return messy(spark, sf_dir).select("row_id", *[cells.number(c).alias(c) for c in ("nation", "amount", "segment")])


@query("prj04_date_like", f"SELECT row_id, {o_date('since')} AS since_date, {o_date('amount')} AS amount_date FROM {_O_MESSY}")
def date_like(spark, sf_dir):
    return messy(spark, sf_dir).select("row_id", cells.looks_like_date("since").alias("since_date"), cells.looks_like_date("amount").alias("amount_date"))


@query("prj06_null_target_filter", f"SELECT row_id, trim(target) AS target FROM {_O_MESSY} WHERE NOT {o_null('target')}")
def null_target_filter(spark, sf_dir):
    return messy(spark, sf_dir).select("row_id", cells.text("target").alias("target")).filter("target IS NOT NULL")


@query(
    "prj10_label_encoding",
    "SELECT l_orderkey, l_linenumber, CAST(l_linestatus = (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*), l_linestatus DESC LIMIT 1) AS DOUBLE) AS y FROM lineitem",
)
def label_encoding(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    positive = profile.two_classes(d, "l_linestatus")[1][0]
    return d.select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == positive).cast("double").alias("y"))


# Sanitation.


@query("san01_dedup_exact_rows", f"SELECT * FROM {_O_ONCE}")
def dedup_exact_rows(spark, sf_dir):
    return sanitize.deduplicate(messy(spark, sf_dir), "row_id")


def o_facts(source: str, names: list[str]) -> str:
    return union([
        f"""SELECT {i} AS pos, '{c}' AS "column", count({o_text(c)}) AS present, count(*) - count({o_text(c)}) AS nulls, count(DISTINCT {o_text(c)}) AS cardinality,
        count(CASE WHEN NOT {o_null(c)} THEN {o_num(c)} END) AS numbers FROM {source}"""
        for i, c in enumerate(names, 1)
    ])


_O_DECIDED = f"""(SELECT *, CASE WHEN cardinality <= 1 THEN 'constant-column'
    WHEN NOT (present > 0 AND numbers >= 0.9 * present) AND present + nulls >= 2 AND nulls = 0 AND cardinality = present THEN 'id-column' END AS exclusion,
    (present > 0 AND numbers >= 0.9 * present) AS mostly FROM ({o_facts(_O_ONCE, _MESSY_COLUMNS)}))"""


@query("san02_san03_excluded_columns", f'SELECT "column", exclusion FROM {_O_DECIDED} WHERE exclusion IS NOT NULL')
def excluded_columns(spark, sf_dir):
    once = sanitize.deduplicate(messy(spark, sf_dir), "row_id")
    return sanitize.decisions(sanitize.column_facts(once, _MESSY_COLUMNS)).filter("exclusion IS NOT NULL").select("column", "exclusion")


@query("san04_numeric_share", f'SELECT "column", CAST(numbers AS DOUBLE) / nullif(present, 0) AS share FROM {_O_DECIDED}')
def numeric_share(spark, sf_dir):
    once = sanitize.deduplicate(messy(spark, sf_dir), "row_id")
    return sanitize.column_facts(once, _MESSY_COLUMNS).select("column", F.try_divide(F.col("numbers").cast("double"), F.col("present")).alias("share"))


@query("san05_mixed_numeric_coercion", f"SELECT row_id, CASE WHEN NOT {o_null('nation')} AND {o_num('nation')} IS NULL THEN '' ELSE nation END AS nation FROM {_O_ONCE}")
def mixed_numeric_coercion(spark, sf_dir):
    once = sanitize.deduplicate(messy(spark, sf_dir), "row_id")
    return once.select("row_id", sanitize.null_junk(once, "nation").alias("nation"))


@query(
    "san06_sanitation_report",
    f"""SELECT (SELECT count(*) FROM {_O_MESSY}) AS rows_before, (SELECT count(*) FROM {_O_ONCE}) AS rows_after, CAST({len(_MESSY_COLUMNS)} AS BIGINT) AS columns_before,
        {len(_MESSY_COLUMNS)} - count(exclusion) AS columns_after, CAST(sum(CASE WHEN exclusion IS NULL AND mostly THEN present - numbers ELSE 0 END) AS BIGINT) AS cells_nulled FROM {_O_DECIDED}""",
)
def sanitation_report(spark, sf_dir):
    _, r = sanitize.sanitize(messy(spark, sf_dir), "row_id")
    row = (r.rows_before, r.rows_after, r.columns_before, r.columns_after, sum(n for _, n in r.coercions))
    return spark.createDataFrame([row], "rows_before bigint, rows_after bigint, columns_before bigint, columns_after bigint, cells_nulled bigint")


@query("san06_sanitized_table", f"SELECT row_id, CASE WHEN NOT {o_null('nation')} AND {o_num('nation')} IS NULL THEN '' ELSE nation END AS nation, segment, CASE WHEN NOT {o_null('amount')} AND {o_num('amount')} IS NULL THEN '' ELSE amount END AS amount, since, target FROM {_O_ONCE}")
def sanitized_table(spark, sf_dir):
    return sanitize.sanitize(messy(spark, sf_dir), "row_id")[0]


# Profiles and classes.

_LINE = {"l_orderkey": 0, "l_partkey": 0, "l_suppkey": 0, "l_linenumber": 0, "l_quantity": 0, "l_extendedprice": 0, "l_discount": 0, "l_tax": 0, "l_returnflag": 1, "l_linestatus": 1, "l_shipdate": 2}


@query(
    "agg02_profile_table",
    union([
        f"""SELECT '{c}' AS name, '{"numeric" if k == 0 else "categorical"}' AS kind, count(*) - count({o_text(c) if k == 1 else c}) AS nulls,
        count(DISTINCT {o_text(c) if k == 1 else c}) AS cardinality, {"true" if k == 2 else "false"} AS looks_like_date FROM lineitem"""
        for c, k in _LINE.items()
    ]),
)
def profile_table(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "lineitem")).drop("pos")


@query(
    "agg01_profile_text_table",
    f"""SELECT "column" AS name, CASE WHEN present > 0 AND numbers = present THEN 'numeric' ELSE 'categorical' END AS kind, nulls, cardinality, dates >= 0.8 * present AND NOT (numbers = present) AS looks_like_date
        FROM ({o_facts(_O_MESSY, _MESSY_COLUMNS)}) JOIN ({union([f"SELECT '{c}' AS c, count(CASE WHEN NOT {o_null(c)} AND {o_date(c)} THEN 1 END) AS dates FROM {_O_MESSY}" for c in _MESSY_COLUMNS])}) ON c = "column" """,
)
def profile_text_table(spark, sf_dir):
    return profile.profile(messy(spark, sf_dir), _MESSY_COLUMNS).drop("pos")


# Keys beyond what a double tells apart, whole and as decimals, beside doubles with two zeros.
_WIDE = "SELECT o_orderkey AS row_id, 9007199254740992 + o_orderkey AS k, CAST(9007199254740992 + o_custkey AS DECIMAL(30, 2)) AS d, CASE WHEN o_orderkey % 3 = 0 THEN -0.0D WHEN o_orderkey % 3 = 1 THEN 0.0D ELSE o_totalprice END AS x, o_orderdate AS t, CAST(o_orderkey % 2 AS INT) AS y FROM {orders}"
_O_WIDE = "(" + _WIDE.replace("{orders}", "orders").replace("-0.0D", "CAST(0 AS DOUBLE)").replace("0.0D", "CAST(0 AS DOUBLE)") + ")"


@query("agg01_profile_wide_keys", union([f"SELECT '{c}' AS name, '{'categorical' if c == 't' else 'numeric'}' AS kind, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS cardinality, {'true' if c == 't' else 'false'} AS looks_like_date FROM {_O_WIDE}" for c in ("k", "d", "x", "t", "y")]))
def profile_wide_keys(spark, sf_dir):
    return profile.profile(spark.sql(_WIDE, orders=table(spark, sf_dir, "orders")), ["k", "d", "x", "t", "y"]).drop("pos")


@query("agg03_target_classes", f"SELECT {o_text('segment')} AS label, count(*) AS n FROM {_O_MESSY} WHERE NOT {o_null('segment')} GROUP BY 1")
def target_classes(spark, sf_dir):
    return profile.target_classes(messy(spark, sf_dir), "segment", "row_id")


@query("agg04_binary_target_candidates", union([f"SELECT '{c}' AS name, count(DISTINCT {o_text(c)}) = 2 AS binary FROM {_O_MESSY}" for c in _MESSY_COLUMNS]))
def binary_target_candidates(spark, sf_dir):
    return profile.profile(messy(spark, sf_dir), _MESSY_COLUMNS).select("name", (F.col("cardinality") == 2).alias("binary"))


@query("agg05_lim01_preview", f"SELECT * FROM {_O_MESSY} ORDER BY row_id LIMIT 20")
def preview(spark, sf_dir):
    d = messy(spark, sf_dir)
    return spark.createDataFrame(profile.summarize(d, "row_id").preview, d.schema)


@query("agg05_summary", f"""WITH f AS ({o_facts(_O_MESSY, _MESSY_COLUMNS)}) SELECT CAST({len(_MESSY_COLUMNS)} AS BIGINT) AS columns, (SELECT count(*) FROM {_O_MESSY}) AS n, (SELECT string_agg("column", ',' ORDER BY pos) FROM f WHERE cardinality = 2) AS target_candidates, 'since' AS date_columns""")
def summary(spark, sf_dir):
    got = profile.summarize(messy(spark, sf_dir), "row_id")
    row = (len(got.columns), got.rows, ",".join(got.target_candidates), ",".join(got.date_columns))
    return spark.createDataFrame([row], "columns bigint, n bigint, target_candidates string, date_columns string")


@query("agg06_positive_class", "SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY 1 ORDER BY n, label DESC LIMIT 1")
def positive_class(spark, sf_dir):
    return spark.createDataFrame([profile.two_classes(table(spark, sf_dir, "labels"), "quality")[1]], "label string, n bigint")


@query("agg07_agg08_class_rates", "SELECT least(avg(CAST(toxic AS DOUBLE)), avg(1 - CAST(toxic AS DOUBLE))) AS positive_rate, least(sum(toxic), sum(1 - toxic)) / CAST(count(*) AS DOUBLE) AS minority_rate, least(sum(toxic), sum(1 - toxic)) / CAST(count(*) AS DOUBLE) < 0.15 AS imbalanced FROM labels")
def class_rates(spark, sf_dir):
    return spark.createDataFrame([eda.class_rates(table(spark, sf_dir, "labels"), "toxic")], "positive_rate double, minority_rate double, imbalanced boolean")


# Leakage.


def o_auc(source: str, value: str, hit: str) -> str:
    return f"""(SELECT CASE WHEN p > 0 AND n > p THEN (r - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * (n - p)) ELSE 0.5 END FROM (
        SELECT sum(CASE WHEN hit THEN rk END) AS r, CAST(sum(CAST(hit AS INT)) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM (
            SELECT {hit} AS hit, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / CAST(2 AS DOUBLE) AS rk FROM {source} WHERE {value} IS NOT NULL)))"""


def o_purity(source: str, value: str, hit: str) -> str:
    return f"(SELECT sum(greatest(h, n - h)) / CAST(sum(n) AS DOUBLE) FROM (SELECT count(*) AS n, sum(CAST({hit} AS INT)) AS h FROM {source} WHERE {value} IS NOT NULL GROUP BY {value}))"


_NUMERIC = [c for c, k in _LINE.items() if k == 0]
_HIT = "l_linestatus = 'O'"


def _line_scores(d: DataFrame) -> DataFrame:
    return leakage.scores(d, F.col("l_linestatus") == "O", [*_NUMERIC, "l_returnflag", "l_shipdate"])


@query("win01_rank_auc_by_column", union([f"SELECT '{c}' AS \"column\", {o_auc('lineitem', c, _HIT)} AS auc" for c in _NUMERIC]))
def rank_auc_by_column(spark, sf_dir):
    return leakage.numeric_auc(table(spark, sf_dir, "lineitem"), F.col("l_linestatus") == "O", _NUMERIC).select("column", "auc")


@query("win01_rank_auc_of_groups", union([f"SELECT {m} AS l_linenumber, {o_auc(f'(SELECT * FROM lineitem WHERE l_linenumber = {m})', 'l_extendedprice', _HIT)} AS auc" for m in range(1, 8)]))
def rank_auc_of_groups(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", F.col("l_extendedprice").alias("num")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("hits"))
    return leakage.rank_auc(d, ["l_linenumber"])


@query("agg10_category_purity", union([f"SELECT '{c}' AS \"column\", {o_purity('orders', c, 'o_totalprice > 150000')} AS purity" for c in ("o_orderstatus", "o_orderpriority")]))
def category_purity(spark, sf_dir):
    counts = profile.distinct_cells(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], F.col("o_totalprice") > 150000)
    return leakage.purity(counts, ["column"])


def o_scan(source: str) -> str:
    parts = [f"SELECT {i} AS pos, '{c}' AS \"column\", 'numeric' AS kind, {o_auc(source, c, _HIT)} AS a" for i, c in enumerate(_NUMERIC)]
    flag = f"SELECT 8 AS pos, 'l_returnflag' AS \"column\", 'categorical' AS kind, {o_purity(source, 'l_returnflag', _HIT)} AS score"
    scored = f"SELECT pos, \"column\", kind, greatest(a, 1 - a) AS score FROM ({union(parts)}) UNION ALL {flag}"
    return f"SELECT \"column\", kind, score, score >= 0.98 AS flagged FROM ({scored}) ORDER BY score DESC, pos"


@query("leakage_scan", o_scan("lineitem"))
def leakage_scan(spark, sf_dir):
    found = leakage.flagged(_line_scores(table(spark, sf_dir, "lineitem")))
    return found.orderBy(F.col("score").desc(), "pos").select("column", "kind", "score", F.col("reason").isNotNull().alias("flagged"))


_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
_O_KEYED = f"(SELECT *, concat_ws('|', {', '.join(_KEY)}) AS k FROM lineitem)"


def _parts(d: DataFrame) -> DataFrame:
    return split.stratified(d.withColumn("k", F.concat_ws("|", *_KEY)), F.col("l_linestatus"), "k")


@query("dec03_leakage_scan_train_only", "WITH tr AS (SELECT * FROM " + o_split(_O_KEYED, "l_linestatus", "k") + " WHERE part = 'train') " + o_scan("tr"))
def leakage_scan_train_only(spark, sf_dir):
    rows = leakage.measured(_parts(table(spark, sf_dir, "lineitem")).filter("part = 'train'"), F.col("l_linestatus") == "O", [*_NUMERIC, "l_returnflag", "l_shipdate"], keep=True)
    found = leakage.flagged(spark.createDataFrame(rows, "pos int, column string, kind string, score double"))
    return found.select("column", "kind", "score", F.col("reason").isNotNull().alias("flagged"))


# Alerts.

_O_LABELLED = "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(l.toxic AS VARCHAR) AS toxic FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", "lang", "source", "n_chars", F.col("toxic").cast("string").alias("toxic"))


@query("agg09_id_like_columns", union([f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {o_text(c)}) AS DOUBLE) / count(*) AS score FROM {_O_LABELLED} HAVING count(DISTINCT {o_text(c)}) >= 0.95 * count(*)" for c in ("text", "lang", "source")]))
def id_like_columns(spark, sf_dir):
    d = labelled(spark, sf_dir).drop("doc_id")
    return eda.alerts(d, "toxic").filter("kind = 'id-like'").select("column", "score")


# A column that gives the target away but for its nulls, beside the others.
_GIVEN = "SELECT *, CASE WHEN row_id % 4 = 0 THEN NULL WHEN target = 'si' THEN 'x' ELSE 'y' END AS given FROM "
_ALERT_COLUMNS = [*(c for c in _MESSY_COLUMNS if c != "target"), "given"]


def o_alerts() -> str:
    per = union([
        f"""SELECT {i} AS pos, '{c}' AS c, count({o_text(c)}) AS present, count(DISTINCT {o_text(c)}) AS cardinality, count(*) AS n,
            count(CASE WHEN NOT {o_null(c)} THEN {o_num(c)} END) AS numbers, count(CASE WHEN NOT {o_null(c)} AND {o_date(c)} THEN 1 END) AS dates,
            {o_auc(f"(SELECT CASE WHEN NOT {o_null(c)} THEN {o_num(c)} END AS v, target FROM t)", "v", "trim(target) = 'si'")} AS auc,
            {o_purity(f"(SELECT {o_text(c)} AS v, target FROM t)", "v", "trim(target) = 'si'")} AS purity FROM t"""
        for i, c in enumerate(_ALERT_COLUMNS)
    ])
    return f"""WITH m AS ({_GIVEN} {_O_ONCE}), t AS (SELECT * FROM m WHERE NOT {o_null("target")}),
        f AS (SELECT *, present > 0 AND numbers = present AS numeric, CAST(cardinality AS DOUBLE) / n AS share FROM ({per})),
        g AS (SELECT *, NOT numeric AND present > 0 AND share >= 0.95 AS id_like, NOT numeric AND present > 0 AND dates >= 0.8 * present AS is_date, CASE WHEN numeric THEN greatest(auc, 1 - auc) ELSE purity END AS score FROM f)
        SELECT 0 AS severity, 'possible-leak' AS kind, c AS "column", score, CAST(NULL AS DOUBLE) AS minority_rate FROM g WHERE NOT id_like AND NOT is_date AND score >= 0.98
        UNION ALL SELECT 1, 'id-like', c, share, NULL FROM g WHERE id_like
        UNION ALL SELECT 2, 'class-imbalance', NULL, NULL, r FROM (SELECT least(avg(CAST(trim(target) = 'si' AS INT)), avg(CAST(trim(target) <> 'si' AS INT))) AS r FROM t) WHERE r < 0.15"""


@query("dec02_eda_alerts", o_alerts())
def eda_alerts(spark, sf_dir):
    once = spark.sql(_GIVEN + "{once}", once=sanitize.deduplicate(messy(spark, sf_dir), "row_id"))
    return eda.alerts(once, "target", [*_ALERT_COLUMNS, "target"])


# Splits.


@query("win02_stratified_split", f"SELECT doc_id, quality, part FROM {o_split('labels', 'quality', 'doc_id')}")
def stratified_split(spark, sf_dir):
    return split.stratified(table(spark, sf_dir, "labels"), F.col("quality"), "doc_id").select("doc_id", "quality", "part")


# The sequential shuffle, one swap after another on a list of each class.
_O_U = f"""(SELECT i AS id, xor(m, m >> 14) / 4294967296.0::DOUBLE AS u FROM (SELECT i, xor(m, (m + ({o_times("xor(m, m >> 7)", "m | 61")})) & 4294967295) AS m FROM (
    SELECT i, {o_times("xor(s, s >> 15)", "s | 1")} AS m FROM (SELECT i, (42 + (i + 1) * 1831565813) & 4294967295 AS s FROM (SELECT row_number() OVER () - 1 AS i FROM labels)))))"""


def o_published(label: str) -> str:
    return f"""WITH RECURSIVE cls AS (SELECT {label} AS label, list(doc_id ORDER BY doc_id) AS members, count(*) AS n, min(doc_id) AS f FROM labels GROUP BY 1),
        ofs AS (SELECT *, coalesce(sum(n - 1) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cls), u AS MATERIALIZED (SELECT * FROM {_O_U}),
        s AS (SELECT label, n - 1 AS i, members AS a FROM ofs UNION ALL
            SELECT label, i - 1, list_transform(a, lambda x, k: CASE WHEN k - 1 = i THEN a[j + 1] WHEN k - 1 = j THEN a[i + 1] ELSE x END)
            FROM (SELECT s.label, s.i, s.a, CAST(floor(u.u * (s.i + 1)) AS BIGINT) AS j FROM s JOIN ofs ON ofs.label = s.label JOIN u ON u.id = ofs.o + ofs.n - 1 - s.i WHERE s.i >= 1)),
        t AS (SELECT unnest(a[1:CASE WHEN n < 2 THEN 0 ELSE CAST(greatest(1, least(floor(n * 0.25 + 0.5), n - 1)) AS BIGINT) END]) AS doc_id FROM s JOIN ofs USING (label) WHERE i = 0)
        SELECT doc_id, {label}, CASE WHEN t.doc_id IS NULL THEN 'train' ELSE 'test' END AS part FROM labels LEFT JOIN t USING (doc_id)"""


@query("win04_published_split", o_published("quality"))
def published_split(spark, sf_dir):
    return split.published(table(spark, sf_dir, "labels"), F.col("quality"), "doc_id").select("doc_id", "quality", "part")


@query("win04_published_split_toxic", o_published("toxic"))
def published_split_toxic(spark, sf_dir):
    return split.published(table(spark, sf_dir, "labels"), F.col("toxic"), "doc_id").select("doc_id", "toxic", "part")


@query("set02_split_counts", f"SELECT l_linestatus, part, count(*) AS n FROM {o_split(_O_KEYED, 'l_linestatus', 'k')} GROUP BY 1, 2")
def split_counts(spark, sf_dir):
    return _parts(table(spark, sf_dir, "lineitem")).groupBy("l_linestatus", "part").agg(F.count(F.lit(1)).alias("n"))


# Preprocessing statistics, of orders' training rows.

_O_TRAIN = f"(SELECT * FROM {o_split('orders', 'o_orderstatus', 'o_orderkey')} WHERE part = 'train')"


def train_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), "o_orderkey").filter("part = 'train'")


@query("agg11_train_medians", union([f"SELECT '{c}' AS \"column\", CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE) AS median FROM {_O_TRAIN}" for c in ("o_totalprice", "o_custkey")]))
def train_medians(spark, sf_dir):
    return preprocess.medians(preprocess.typed(train_part(spark, sf_dir), ["o_totalprice", "o_custkey"], []), ["o_totalprice", "o_custkey"])


@query("agg12_train_modes", union([f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS mode FROM {_O_TRAIN} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in ("o_orderpriority", "o_orderstatus")]))
def train_modes(spark, sf_dir):
    return preprocess.modes(preprocess.category_counts(train_part(spark, sf_dir), ["o_orderpriority", "o_orderstatus"]))


@query("agg13_train_scaling", f"SELECT round(avg(o_totalprice), 6) AS o_totalprice_mean, round(stddev_pop(o_totalprice), 6) AS o_totalprice_std FROM {_O_TRAIN}")
def train_scaling(spark, sf_dir):
    t = preprocess.typed(train_part(spark, sf_dir), ["o_totalprice"], [])
    got = preprocess.scaling(t, {r["column"]: r["median"] for r in preprocess.medians(t, ["o_totalprice"]).collect()})
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


_O_RARE_TRAIN = f"(SELECT *, CASE WHEN o_orderkey % 500 = 0 THEN concat('rare', CAST(o_orderkey AS VARCHAR)) ELSE o_orderpriority END AS p FROM {_O_TRAIN})"


@query("agg14_rare_categories", f"SELECT 'p' AS \"column\", count(*) AS categories, min(p) AS first, max(p) AS last FROM (SELECT p FROM {_O_RARE_TRAIN} GROUP BY p HAVING count(*) < 2)")
def rare_categories(spark, sf_dir):
    t = train_part(spark, sf_dir).withColumn("p", F.when(F.col("o_orderkey") % 500 == 0, F.concat(F.lit("rare"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderpriority")))
    got = preprocess.rare(preprocess.category_counts(t, ["p"]))
    return got.select("column", F.size("categories").cast("long").alias("categories"), F.array_min("categories").alias("first"), F.array_max("categories").alias("last"))


@query("agg15_training_ranges", f"SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM {_O_TRAIN}")
def training_ranges(spark, sf_dir):
    s = preprocess.learn(preprocess.typed(train_part(spark, sf_dir), ["o_totalprice"], []), ["o_totalprice"], [])
    return spark.createDataFrame([s.ranges["o_totalprice"]], "low double, high double")


@query("agg16_training_categories", f"SELECT o_orderpriority AS value, count(*) AS n FROM {_O_TRAIN} GROUP BY 1")
def training_categories(spark, sf_dir):
    return preprocess.category_counts(train_part(spark, sf_dir), ["o_orderpriority"]).select("value", "n")


# Metrics, of a rule in place of a model.

_O_RULE = "(SELECT CAST(l_linestatus = 'O' AS INT) AS y, CAST(l_quantity > 25 AS INT) AS pred, CAST(l_quantity AS DOUBLE) AS score FROM lineitem)"
_O_CELLS = f"(SELECT count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM {_O_RULE})"


def rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("pred"), F.col("l_quantity").alias("score"))


@query("agg17_confusion_matrix", f"SELECT * FROM {_O_CELLS}")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(rule(spark, sf_dir))


@query(
    "agg18_classification_metrics",
    f"""SELECT (tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE) AS accuracy, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision,
        coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall, coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1 FROM {_O_CELLS}""",
)
def classification_metrics(spark, sf_dir):
    return metrics.rates(metrics.confusion(rule(spark, sf_dir)))


@query("agg19_roc_auc", f"SELECT {o_auc(_O_RULE, 'score', 'y = 1')} AS auc")
def roc_auc(spark, sf_dir):
    return metrics.evaluate(rule(spark, sf_dir).withColumn("model", F.lit("rule")), ["model"]).select("auc")


_O_RATES = union([f"SELECT '{c}' AS target, avg(CAST({e} AS DOUBLE)) AS positive_rate FROM {t}" for c, e, t in (("quality", "1 - quality", "labels"), ("toxic", "toxic", "labels"), ("l_linestatus", "CAST(l_linestatus = 'F' AS INT)", "lineitem"))])


@query("dec04_primary_metric", f"SELECT target, positive_rate, CASE WHEN abs(positive_rate - 0.5) >= 0.15 THEN 'auc' ELSE 'f1' END AS metric FROM ({_O_RATES})")
def primary_metric(spark, sf_dir):
    labels, line = table(spark, sf_dir, "labels"), table(spark, sf_dir, "lineitem")
    rate = lambda d, name, y: d.agg(F.avg(y.cast("double")).alias("positive_rate")).select(F.lit(name).alias("target"), "positive_rate")
    rates = rate(labels, "quality", 1 - F.col("quality")).union(rate(labels, "toxic", F.col("toxic"))).union(rate(line, "l_linestatus", (F.col("l_linestatus") == "F")))
    return rates.withColumn("metric", metrics.primary_metric_column(F.col("positive_rate")))


_O_RULES = f"SELECT 'a' AS model, y, pred FROM {_O_RULE} UNION ALL SELECT 'b', y, 1 FROM {_O_RULE}"


@query(
    "dec05_verdict",
    f"""SELECT a - b AS delta, CASE WHEN a - b > 0.01 THEN 'beats' WHEN a - b < -0.01 THEN 'loses' ELSE 'ties' END AS level FROM (
        SELECT max(CASE WHEN model = 'a' THEN f1 END) AS a, max(CASE WHEN model = 'b' THEN f1 END) AS b FROM (
        SELECT model, coalesce(2 * sum(y * pred) / CAST(sum(y) + sum(pred) AS DOUBLE), 0) AS f1 FROM ({_O_RULES}) GROUP BY model))""",
)
def verdict(spark, sf_dir):
    r = rule(spark, sf_dir)
    both = r.withColumn("model", F.lit("a")).union(r.withColumn("pred", F.lit(1)).withColumn("model", F.lit("b")))
    f1 = {x["model"]: x["f1"] for x in metrics.rates(metrics.confusion(both, ["model"]), ["model"]).collect()}
    delta = f1["a"] - f1["b"]
    return spark.createDataFrame([(delta, metrics.level(delta))], "delta double, level string")


@query(
    "agg20_feature_directions",
    union([
        f"""SELECT '{c}' AS "column", CASE WHEN n >= 2 AND lo < hi AND ylo < yhi AND abs(r) >= greatest(0.05, 2 / sqrt(n)) THEN CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END END AS direction
        FROM (SELECT count({c}) AS n, min({c}) AS lo, max({c}) AS hi, min(y) AS ylo, max(y) AS yhi, corr({c}, y) AS r FROM (SELECT *, CAST(l_returnflag = 'N' AS DOUBLE) AS y FROM lineitem) WHERE {c} IS NOT NULL)"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey")
    ]),
)
def feature_directions(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "N").cast("double"))
    return explain.directions(d, ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"])


# Novelty: all orders as new data, against those of three quarters of the keys that are not urgent, which were seen.

_O_SEEN = "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderpriority <> '1-URGENT')"
_O_NEW = "orders"
_O_FLAGS = f"(SELECT o_orderkey, coalesce(o_totalprice < lo OR o_totalprice > hi, false) AS price_new, coalesce(o_orderpriority NOT IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderpriority <> '1-URGENT'), false) AS priority_new FROM {_O_NEW}, {_O_SEEN})"


def _novel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, preprocess.Statistics]:
    d = table(spark, sf_dir, "orders")
    seen = preprocess.typed(d.filter("o_orderkey % 4 <> 0 AND o_orderpriority <> '1-URGENT'"), ["o_totalprice"], ["o_orderpriority"])
    return preprocess.typed(d, ["o_totalprice"], ["o_orderpriority"], ["o_orderkey"]), preprocess.learn(seen, ["o_totalprice"], ["o_orderpriority"])


@query("prj15_prj16_novelty_rows", f"SELECT * FROM {_O_FLAGS}")
def novelty_rows(spark, sf_dir):
    new, s = _novel(spark, sf_dir)
    flags = score.novelty(new, s, ["o_totalprice"], ["o_orderpriority"])
    return new.select("o_orderkey", flags["o_totalprice"].alias("price_new"), flags["o_orderpriority"].alias("priority_new"))


@query("agg22_novelty_report", f"SELECT count(*) FILTER (price_new) AS price_cells, count(*) FILTER (priority_new) AS priority_cells, count(*) FILTER (price_new OR priority_new) AS rows_affected, count(*) AS n, CAST(round(100.0 * count(*) FILTER (price_new OR priority_new) / count(*)) AS BIGINT) AS percent FROM {_O_FLAGS}")
def novelty_report(spark, sf_dir):
    new, s = _novel(spark, sf_dir)
    columns, rows, n = score.novelty_report(new, s, ["o_totalprice"], ["o_orderpriority"])
    found = {c: k for c, _, k in columns}
    row = (found.get("o_totalprice", 0), found.get("o_orderpriority", 0), rows, n, int(100 * rows / max(1, n) + 0.5))
    return spark.createDataFrame([row], "price_cells bigint, priority_cells bigint, rows_affected bigint, n bigint, percent bigint")


@query("unseen_categories_anti_join", f"SELECT o_orderkey, o_orderpriority FROM {_O_NEW} WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderpriority <> '1-URGENT')")
def unseen_categories_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    seen = d.filter("o_orderkey % 4 <> 0 AND o_orderpriority <> '1-URGENT'").select(F.col("o_orderpriority").alias("value")).distinct()
    return score.unseen_rows(d, "o_orderpriority", seen).select("o_orderkey", "o_orderpriority")


@query("set01_schema_check", "SELECT 'o_clerk' AS missing, 'o_orderkey,o_custkey,o_orderdate' AS extra, true AS target_present, false AS ok, CAST(0 AS BIGINT) AS scored UNION ALL SELECT '', 'o_orderkey,o_custkey,o_orderdate', true, true, count(*) FROM orders")
def schema_check(spark, sf_dir):
    """New orders against a model that needs a column they lack, and one that does not; what is refused is not scored."""
    d, rows = table(spark, sf_dir, "orders"), []
    for more in (["o_clerk"], []):
        c = score.check_schema(d.columns, ["o_totalprice", "o_orderpriority", *more], "o_orderstatus")
        rows.append((",".join(c.missing), ",".join(c.extra), c.target_present, c.ok, d.count() if c.ok else 0))
    return spark.createDataFrame(rows, "missing string, extra string, target_present boolean, ok boolean, scored bigint")


# Scored output, of a rule in place of a model.


@query("snk01_scored_output", "SELECT o_orderkey, o_orderstatus AS prediction, CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END AS prediction_2, printf('%.4f', least(1.0, o_totalprice / 700001.0)) AS probability FROM orders")
def scored_output(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    ruled = d.select("o_orderkey", F.col("status").alias("own"), F.when(F.col("o_totalprice") > 150000, "dear").otherwise("cheap").alias("prediction"), F.least(F.lit(1.0), F.col("o_totalprice") / 700001.0).alias("probability"))
    name, chance = scored_csv.column_names(["o_orderkey", "prediction"], "prediction", "probability")
    return ruled.select("o_orderkey", F.col("own").alias("prediction"), F.col("prediction").alias(name), F.format_string("%.4f", F.col("probability")).alias(chance))


@query("agg23_prediction_distribution", "SELECT prediction, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER ()) AS BIGINT) AS percent FROM (SELECT CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END AS prediction FROM orders) GROUP BY 1")
def prediction_distribution(spark, sf_dir):
    return score.distribution(table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") > 150000, "dear").otherwise("cheap").alias("prediction")))


# Random numbers and tables made by rule.

def o_uniform_of(ks: str, seed: int) -> str:
    """A table expression (k, u) of the numbers k (from 0) of a seed's sequence, for a table expression of k."""
    state = f"(SELECT k, ({seed} + (k + 1) * 1831565813) & 4294967295 AS s FROM {ks})"
    return f"""(SELECT k, xor(m, m >> 14) / 4294967296.0::DOUBLE AS u FROM (SELECT k, xor(m, (m + ({o_times("xor(m, m >> 7)", "m | 61")})) & 4294967295) AS m FROM (
        SELECT k, {o_times("xor(s, s >> 15)", "s | 1")} AS m FROM {state})))"""


@query("win03_counter_random", f"SELECT k AS doc_id, u FROM {o_uniform_of('(SELECT doc_id AS k FROM labels)', 42)}")
def counter_random(spark, sf_dir):
    return uniform(table(spark, sf_dir, "labels").select("doc_id"), F.col("doc_id"), split.SEED, "u")


# Synthetic columns for each customer, by its key.

def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("__row_id"))


def _o_draws(columns: int, seed: int) -> str:
    drawn = o_uniform_of(f"(SELECT c_custkey * {columns} + j AS k FROM customer, range({columns}) t(j))", seed)
    return f"(SELECT k // {columns} AS i, {', '.join(f'max(CASE WHEN k % {columns} = {j} THEN u END) AS u{j}' for j in range(columns))} FROM {drawn} GROUP BY 1)"


# The sequential way, one row after another: a row takes a seventh number where it defaulted.
_O_LOANS = f"""WITH RECURSIVE u AS MATERIALIZED (SELECT k, u FROM {o_uniform_of("(SELECT c_custkey * 7 + j AS k FROM (SELECT row_number() OVER () - 1 AS c_custkey FROM customer), range(7) t(j))", 303)}),
    w AS MATERIALIZED (SELECT list(u ORDER BY k) AS a FROM u),
    d AS MATERIALIZED (SELECT k, floor(1200 + a[k + 1] * 5000 + 0.5) AS income, floor(2000 + a[k + 2] * 20000 + 0.5) AS amount, floor(300 + a[k + 3] * 550 + 0.5) AS rating, ['formal', 'informal', 'own'][CAST(floor(a[k + 4] * 3) AS INT) + 1] AS work, a[k + 5] AS noise, a[k + 6] AS chance, a[k + 7] AS share FROM u, w),
    e AS MATERIALIZED (SELECT *, CAST(chance < 1 / (1 + exp(-(2.5 - 0.006 * rating + 0.00004 * amount + CASE WHEN work = 'informal' THEN 0.5 ELSE 0 END + (noise - 0.5)))) AS INT) AS defaulted FROM d),
    r AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS begun UNION ALL SELECT i + 1, begun + 6 + defaulted FROM r JOIN e ON e.k = r.begun WHERE i < (SELECT count(*) FROM customer))
    SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(income AS INT) AS income, CAST(amount AS INT) AS amount, CAST(rating AS INT) AS rating, work, defaulted, CASE WHEN defaulted = 1 THEN CAST(floor(amount * (0.1 + share * 0.4) + 0.5) AS INT) ELSE 0 END AS recovered
    FROM r JOIN e ON e.k = r.begun JOIN customer ON c_custkey = r.i"""


@query("src12_synthetic_loans", _O_LOANS)
def synthetic_loans(spark, sf_dir):
    keys = _customers(spark, sf_dir)
    return keys.join(synthetic.loans(spark, keys.count()), "__row_id").withColumnRenamed("__row_id", "c_custkey")


@query(
    "src12_synthetic_marketing",
    f"""SELECT i AS row_id, age, income, visits, opened, region, device, CAST(u6 < CASE WHEN (device = 'mobile' AND visits >= 22) OR (device = 'desktop' AND opened >= 11) THEN 0.85 ELSE 0.15 END AS INT) AS converted FROM (
        SELECT i, u6, CAST(floor(18 + u0 * 50 + 0.5) AS INT) AS age, CAST(floor(1500 + u1 * 6000 + 0.5) AS INT) AS income, CAST(floor(u2 * 40 + 0.5) AS INT) AS visits, CAST(floor(u3 * 20 + 0.5) AS INT) AS opened,
            ['north', 'south', 'east', 'west'][CAST(floor(u4 * 4) AS INT) + 1] AS region, ['mobile', 'desktop'][CAST(floor(u5 * 2) AS INT) + 1] AS device FROM {_o_draws(7, 101)})""",
)
def synthetic_marketing(spark, sf_dir):
    return synthetic.marketing(spark, _customers(spark, sf_dir)).withColumnRenamed("__row_id", "row_id")


@query("agg21_importance_of_rules", "SELECT feature, avg(loss) AS importance, stddev_pop(loss) AS std FROM (" + union([
    f"SELECT 'f{f}' AS feature, 1.0 - avg(CAST((l_quantity > 25) = (l_quantity > {20 + 5 * f + r}) AS DOUBLE)) AS loss FROM lineitem" for f in range(2) for r in range(3)
]) + ") GROUP BY feature")
def importance_of_rules(spark, sf_dir):
    grid = F.explode(F.array(*[F.struct(F.lit(f"f{f}").alias("feature"), F.lit(r).alias("repeat"), F.lit(20 + 5 * f + r).alias("cut")) for f in range(2) for r in range(3)]))
    d = table(spark, sf_dir, "lineitem").select("l_quantity", grid.alias("g")).select((F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_quantity") > F.col("g.cut")).cast("int").alias("pred"), F.col("l_quantity").alias("score"), "g.feature", "g.repeat")
    return explain.importances(d, 1.0, "accuracy")


# Whole experiments.

def _experiment(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    words = F.size(F.split("text", " "))
    d = labelled(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", words.alias("words"), F.length(F.regexp_replace("text", "[^A-Z]", "")).alias("capitals"), "toxic")
    # Texts are read once: an experiment passes over its table several times.
    d = scratch.stash(d, "labelled")
    return d, *experiment.run(d, "toxic", "doc_id")


@query("ml08_candidate_metrics")
def candidate_metrics(spark, sf_dir):
    _, r, _ = _experiment(spark, sf_dir)
    return spark.createDataFrame([(m, m == r.winner, *(s[k] for k in metrics.NAMES)) for m, s in r.scores.items()], "model string, winner boolean, accuracy double, precision double, recall double, f1 double, auc double")


@query("ml09_permutation_importance")
def permutation_importance(spark, sf_dir):
    _, r, _ = _experiment(spark, sf_dir)
    return spark.createDataFrame([tuple(f.values()) for f in r.features], "name string, kind string, importance double, std double, direction string")


@query("ml10_model_scores")
def model_scores(spark, sf_dir):
    d, _, fitted = _experiment(spark, sf_dir)
    return fitted.score(d)


# Permuted columns, feature selection, and what is shown of a scored table.


def o_permuted(column: str) -> str:
    order = "PARTITION BY repeat ORDER BY md5(concat_ws('|', '42', CAST(repeat AS VARCHAR), CAST(doc_id AS VARCHAR))), CAST(doc_id AS VARCHAR)"
    moved = f"coalesce(lead({column}) OVER ({order}), first_value({column}) OVER ({order}))"
    return f"""SELECT doc_id, '{column}' AS feature, repeat, {moved if column == "quality" else "quality"} AS quality, {moved if column == "toxic" else "toxic"} AS toxic
        FROM labels, (SELECT CAST(i AS INT) AS repeat FROM range(3) t(i))"""


@query("win05_permuted_columns", union([o_permuted("quality"), o_permuted("toxic")]))
def permuted_columns(spark, sf_dir):
    return explain.permuted(table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"], [], 3).select("doc_id", "feature", "repeat", "quality", "toxic")


@query(
    "prj07_selected_features",
    f"""SELECT "column" AS name, CASE WHEN present > 0 AND numbers = present THEN 'numeric' ELSE 'categorical' END AS kind
        FROM ({o_facts(_O_MESSY, _MESSY_COLUMNS)}) JOIN ({union([f"SELECT '{c}' AS c, count(CASE WHEN NOT {o_null(c)} AND {o_date(c)} THEN 1 END) AS dates FROM {_O_MESSY}" for c in _MESSY_COLUMNS])}) ON c = "column"
        WHERE "column" NOT IN ('target', 'country') AND NOT (dates >= 0.8 * present AND numbers <> present)""",
)
def selected_features(spark, sf_dir):
    numeric, categorical = profile.features(messy(spark, sf_dir).drop("row_id"), "target", drop=("country",))
    return spark.createDataFrame([(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical], "name string, kind string")


@query("lim02_scored_preview", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END AS prediction FROM orders ORDER BY o_orderkey LIMIT 10")
def scored_preview(spark, sf_dir):
    scored = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 150000, "dear").otherwise("cheap").alias("prediction"))
    return score.preview(scored, "o_orderkey")


# A column that gives the target away, beside one that does not.
_O_GIVEN = "(SELECT *, l_quantity + CASE WHEN l_linestatus = 'O' THEN 100 ELSE 0 END AS given FROM lineitem)"


@query("agg25_suspicious_columns", "SELECT * FROM (" + union([f"SELECT '{c}' AS \"column\", greatest(a, 1 - a) AS score FROM (SELECT {o_auc(_O_GIVEN, c, _HIT)} AS a)" for c in ("l_quantity", "given")]) + ") WHERE score >= 0.98")
def suspicious_columns(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("given", F.col("l_quantity") + F.when(F.col("l_linestatus") == "O", 100).otherwise(0))
    found = leakage.findings(d, F.col("l_linestatus") == "O", ["l_quantity", "given"])
    return spark.createDataFrame([(c, x) for c, x, _ in found], "column string, score double")


# A league: folds, choices from predictions of rules in place of models, and the whole of it.

@query("ml12_stratified_folds", "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INT) AS fold FROM labels")
def stratified_folds(spark, sf_dir):
    return split.folds(table(spark, sf_dir, "labels"), F.col("quality"), "doc_id").select("doc_id", "quality", "fold")


_RULES = {"dear": "o_totalprice > 150000", "urgent": "o_orderpriority = '1-URGENT'", "early": "o_custkey % 3 = 0", "all": "o_orderkey >= 0"}
_O_RULED = union([f"SELECT '{m}' AS model, o_orderkey % 5 AS fold, CAST(o_orderstatus = 'F' AS INT) AS y, CAST({e} AS INT) AS pred FROM orders" for m, e in _RULES.items()])
_O_FOLDS = f"(SELECT model, fold, coalesce(2 * sum(y * pred) / CAST(nullif(sum(y) + sum(pred), 0) AS DOUBLE), 0) AS f1, avg(CAST(y = pred AS DOUBLE)) AS accuracy FROM ({_O_RULED}) GROUP BY 1, 2)"
_O_PLACES = "CASE model WHEN 'dear' THEN 0 WHEN 'urgent' THEN 1 WHEN 'early' THEN 0 ELSE 1 END AS place, model IN ('dear', 'urgent') AS candidate"


def _ruled(spark: SparkSession, sf_dir: str) -> dict:
    d = table(spark, sf_dir, "orders")
    rules = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).cast("int").alias("pred")) for m, e in _RULES.items()]))
    long = d.select((F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), rules.alias("r")).select("r.model", "fold", "y", "r.pred", F.col("r.pred").cast("double").alias("score"))
    got = metrics.evaluate(long, ["model", "fold"]).collect()  # a row for each rule and fold
    return {(r["model"], r["fold"]): {k: r[k] for k in metrics.NAMES} for m in _RULES for r in got if r["model"] == m}


@query("ml12_out_of_fold_metrics", f"SELECT model, CAST(fold AS INT) AS fold, accuracy, f1 FROM {_O_FOLDS}")
def out_of_fold_metrics(spark, sf_dir):
    return spark.createDataFrame([(m, f, x["accuracy"], x["f1"]) for (m, f), x in _ruled(spark, sf_dir).items()], "model string, fold int, accuracy double, f1 double")


@query(
    "dec06_dec07_winner_and_baseline",
    f"""WITH m AS (SELECT model, avg(f1) AS f1, {_O_PLACES} FROM {_O_FOLDS} GROUP BY model), w AS (SELECT * FROM m WHERE candidate ORDER BY f1 DESC, place LIMIT 1), b AS (SELECT * FROM m WHERE NOT candidate ORDER BY f1 DESC, place LIMIT 1)
        SELECT w.model AS winner, b.model AS baseline, round(w.f1 - b.f1, 9) AS delta, CASE WHEN w.f1 - b.f1 > 0.01 THEN 'beats' WHEN w.f1 - b.f1 < -0.01 THEN 'loses' ELSE 'ties' END AS level FROM w, b""",
)
def winner_and_baseline(spark, sf_dir):
    winner, baseline, v = league.choose(league.mean_metrics(_ruled(spark, sf_dir)), "f1", ["dear", "urgent"], ["early", "all"])
    return spark.createDataFrame([(winner, baseline, round(v.delta, 9), v.level)], "winner string, baseline string, delta double, level string")


@query("ml12_league")
def whole_league(spark, sf_dir):
    words = F.size(F.split("text", " "))
    d = labelled(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", words.alias("words"), "toxic")
    got = league.run(scratch.stash(d, "labelled"), "toxic", "doc_id")
    rows = [(m, m == got.winner, x["accuracy"], x["f1"], x["auc"], got.test.get(m, {}).get("auc")) for m, x in got.means.items()]
    return spark.createDataFrame(rows, "model string, winner boolean, accuracy double, f1 double, auc double, test_auc double")
