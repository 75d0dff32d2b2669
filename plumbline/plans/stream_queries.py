"""Registered queries of streams, each read in several micro-batches until its input ends. With DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import preprocess
from plumbline.plans.queries import query, table
from plumbline.sources import scratch
from plumbline.streaming import limits, scoring

#: Files that a table is cut into; each is a micro-batch.
PARTS = 4


def _stream(spark: SparkSession, d: DataFrame, part: Column | None = None) -> DataFrame:
    """A stream of d: PARTS files by the number in ``part``, one after another in its order, or by ids."""
    path = scratch.path(spark, "stream")
    part = F.pmod(F.xxhash64(*d.columns), F.lit(PARTS)) if part is None else part
    stored = scratch.stash(d.withColumn("__part", part), "parts")
    for k in range(PARTS):
        stored.filter(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)


#: A limit that this table's users run into: so many requests in so many days.
_HITS, _DAYS = 3, 5

_O_LIMIT = f"""
    WITH RECURSIVE e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (
        SELECT event_id, user_id, ts, k, [t] AS past, true AS allowed FROM e WHERE k = 1
        UNION ALL
        SELECT event_id, user_id, ts, k, CASE WHEN len(recent) < {_HITS} THEN list_append(recent, t) ELSE recent END, len(recent) < {_HITS}
        FROM (SELECT e.*, list_filter(r.past, lambda x: x > e.t - {_DAYS * 86_400_000_000}) AS recent FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    )
    SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, allowed FROM r"""


@query("nar05_rate_limit", _O_LIMIT)
def rate_limit(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    # Parts follow each other in time, as requests do.
    cuts = d.select(F.percentile_approx("ts", [k / PARTS for k in range(1, PARTS)]).alias("c")).first()["c"]
    part = sum((F.col("ts") > F.lit(c)).cast("int") for c in cuts)
    return _written(limits.decisions(_stream(spark, d, part), "user_id", "ts", "event_id", _HITS, _DAYS * 86400.0)).select("event_id", "user_id", "allowed")


def _written(stream: DataFrame) -> DataFrame:
    """What a stream gives until its input ends."""
    spark, path = stream.sparkSession, scratch.path(stream.sparkSession, "sink")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch.path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


_O_FLAGS = """(SELECT coalesce(o_totalprice < lo OR o_totalprice > hi, false) AS price_new, coalesce(o_orderpriority NOT IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderpriority <> '1-URGENT'), false) AS priority_new
    FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderpriority <> '1-URGENT'))"""


@query("agg22_streamed_novelty", f"""SELECT count(*) FILTER (price_new) AS price_cells, count(*) FILTER (priority_new) AS priority_cells, count(*) FILTER (price_new OR priority_new) AS rows_affected, count(*) AS n FROM {_O_FLAGS}""")
def streamed_novelty(spark, sf_dir):
    """Orders in several micro-batches, one of which is logged again as after a failure."""
    d, path = table(spark, sf_dir, "orders"), scratch.path(spark, "novelty")
    numeric, categorical = ["o_totalprice"], ["o_orderpriority"]
    seen = preprocess.learn(preprocess.typed(d.filter("o_orderkey % 4 <> 0 AND o_orderpriority <> '1-URGENT'"), numeric, categorical), numeric, categorical)
    stream = preprocess.typed(_stream(spark, d.select("o_totalprice", "o_orderpriority")), numeric, categorical)

    def each(batch: DataFrame, number: int) -> None:
        for _ in range(2 if number == 1 else 1):
            scoring.log_novelty(batch, number, seen, numeric, categorical, path)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", scratch.path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    cells, rows = scoring.novelty_so_far(spark, path)
    of = lambda c: F.coalesce(F.sum(F.when(F.col("column") == c, F.col("cells"))), F.lit(0)).cast("long")
    return cells.agg(of("o_totalprice").alias("price_cells"), of("o_orderpriority").alias("priority_cells")).crossJoin(F.broadcast(rows))  # one row each
