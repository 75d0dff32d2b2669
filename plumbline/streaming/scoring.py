"""Scoring and novelty over streams: the batch plans on streaming input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.operators import score
from plumbline.operators.preprocess import Statistics
from plumbline.plans.experiment import Fitted


def score_stream(stream: DataFrame, fitted: Fitted) -> DataFrame:
    """Scored rows of a stream, without state."""
    return fitted.score(stream)


def watch_novelty(stream: DataFrame, fitted: Fitted, sink: Callable[[int, list, int, int], None], checkpoint: str) -> StreamingQuery:
    """Calls sink(batch, columns, rows with novelty, rows) for every micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        sink(number, *fitted.novelty(batch))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_novelty(batch: DataFrame, number: int, s: Statistics, numeric: list[str], categorical: list[str], path: str) -> None:
    """Writes the novelty counts of a typed micro-batch under its number.

    A batch that is replayed after a failure has the same number and the same
    rows, and overwrites what it wrote before, so that each row counts once.
    """
    flags = score.novelty(batch, s, numeric, categorical)
    counts = [F.struct(F.lit(c).alias("column"), F.lit("out-of-range" if c in numeric else "unseen-category").alias("kind"), F.count_if(f).alias("cells")) for c, f in flags.items()]
    one = batch.agg(F.array(*counts).alias("columns"), F.count_if(score.any_of(flags)).alias("rows_affected"), F.count(F.lit(1)).alias("n"))
    one.write.mode("overwrite").parquet(f"{path}/batch={number}")


def run_novelty(stream: DataFrame, s: Statistics, numeric: list[str], categorical: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Logs the novelty of every micro-batch of a typed stream, until the input that is there has been read."""
    return stream.writeStream.foreachBatch(lambda batch, number: log_novelty(batch, number, s, numeric, categorical, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def novelty_so_far(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((column, kind, cells) of columns with any, (rows_affected, n)) over all batches logged."""
    logged = spark.read.parquet(path)
    cells = logged.select(F.explode("columns").alias("c")).groupBy("c.column", "c.kind").agg(F.sum("c.cells").alias("cells")).filter("cells > 0")
    return cells, logged.agg(F.sum("rows_affected").alias("rows_affected"), F.sum("n").alias("n"))


def hits(stream: DataFrame, key: str, time: str, window: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Requests of each key in sliding windows, with a watermark: the rate limit as a stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window, slide), key).count()
