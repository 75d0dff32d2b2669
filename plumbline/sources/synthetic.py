"""Small tables made by rule, for demonstrations and tests: any number of rows, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.random import uniform
from plumbline.sources import scratch

#: Rows that the messy table repeats, as a share.
REPEATED = 20


def _draws(spark: SparkSession, n: int | DataFrame, seed: int, columns: int) -> DataFrame:
    """n rows, or one for each __row_id of a table, with u0, u1, ...: independent numbers in [0, 1), a function of the id alone."""
    d = n.select(F.col("__row_id").cast("long").alias("__row_id")) if isinstance(n, DataFrame) else spark.range(n).withColumnRenamed("id", "__row_id")
    for j in range(columns):
        d = uniform(d, F.col("__row_id") * columns + j, seed, f"u{j}")
    return d


def _pick(u: str, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col(u) * len(values)) + 1).cast("int"))


def _chance(logit: Column, u: str) -> Column:
    """1 with the probability of a logit."""
    return (F.col(u) < 1 / (1 + F.exp(-logit))).cast("int")


def marketing(spark: SparkSession, n: int | DataFrame = 200, seed: int = 101) -> DataFrame:
    """Who buys: on a phone those who visit often, on a desktop those who open mails. No sum of the columns tells them, a tree does."""
    d = _draws(spark, n, seed, 7)
    span = lambda u, low, width: F.round(low + F.col(u) * width).cast("int")
    d = d.select("__row_id", span("u0", 18, 50).alias("age"), span("u1", 1500, 6000).alias("income"), span("u2", 0, 40).alias("visits"), span("u3", 0, 20).alias("opened"), _pick("u4", ["north", "south", "east", "west"]).alias("region"), _pick("u5", ["mobile", "desktop"]).alias("device"), "u6")
    keen = F.when(F.col("device") == "mobile", F.col("visits") >= 22).otherwise(F.col("opened") >= 11)
    return d.withColumn("converted", (F.col("u6") < F.when(keen, 0.85).otherwise(0.15)).cast("int")).drop("u6")


def attrition(spark: SparkSession, n: int | DataFrame = 200, seed: int = 202) -> DataFrame:
    """Who leaves: the less satisfied, and those who work more. The signal is a weak one, with noise in it."""
    d = _draws(spark, n, seed, 8)
    d = d.select("__row_id", F.round(22 + F.col("u0") * 40).cast("int").alias("age"), F.round(F.col("u1") * 15, 1).alias("years"), F.round(120 + F.col("u2") * 100).cast("int").alias("hours"), F.round("u3", 2).alias("satisfaction"), _pick("u4", ["sales", "engineering", "support", "people"]).alias("department"), _pick("u5", ["yes", "no"]).alias("overtime"), "u6", "u7")
    logit = F.when(F.col("overtime") == "yes", 0.8).otherwise(0.0) + 0.014 * F.col("hours") - 2.5 * F.col("satisfaction") - 2.5 + (F.col("u6") - 0.5)
    return d.withColumn("left", _chance(logit, "u7")).drop("u6", "u7")


def _starts(steps: DataFrame, rows: int) -> DataFrame:
    """steps(at, next) -> (__row_id, at): where in the sequence each of the first rows begins, the first at 0.

    A row takes as many numbers as those it takes decide, so that each begins
    where the one before ends. But where a row that begins at a place would end
    is known of every place by itself: composing those steps with themselves
    gives steps of 2, 4, 8 rows, and each doubles the rows whose begin is known.
    """
    spark = steps.sparkSession
    known, jump, n = spark.createDataFrame([(0, 0)], "__row_id long, at long"), scratch.stash(steps, "steps"), 1
    while n < rows:
        further = known.join(jump, "at").select((F.col("__row_id") + n).alias("__row_id"), F.col("next").alias("at"))
        known = scratch.stash(known.union(further).filter(F.col("__row_id") < rows), "starts")
        twice = jump.join(jump.select(F.col("at").alias("next"), F.col("next").alias("then")), "next").select("at", F.col("then").alias("next"))
        jump, n = scratch.stash(twice, "steps"), 2 * n
    return known


def _from(spark: SparkSession, places: int, seed: int, most: int) -> DataFrame:
    """(at, u0, u1, ...): of every place in the sequence the numbers that a row beginning there may take."""
    d = spark.range(places).withColumnRenamed("id", "at")
    for j in range(most):
        d = uniform(d, F.col("at") + j, seed, f"u{j}")
    return d


def _nearest(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def loans(spark: SparkSession, n: int = 200, seed: int = 303) -> DataFrame:
    """``recovered`` is above 0 just where the loan defaulted: a planted leak. A row takes one number more where it did."""
    d = _from(spark, 7 * n, seed, 7)
    u = F.col
    d = d.select("at", _nearest(1200 + u("u0") * 5000).alias("income"), _nearest(2000 + u("u1") * 20000).alias("amount"), _nearest(300 + u("u2") * 550).alias("rating"), _pick("u3", ["formal", "informal", "own"]).alias("work"), "u4", "u5", "u6")
    # The weights of the published rows.
    logit = 2.5 - 0.006 * u("rating") + 0.00004 * u("amount") + F.when(u("work") == "informal", 0.5).otherwise(0.0) + (u("u4") - 0.5)
    d = d.withColumn("defaulted", _chance(logit, "u5"))
    d = d.withColumn("recovered", F.when(u("defaulted") == 1, _nearest(u("amount") * (0.1 + u("u6") * 0.4))).otherwise(0)).drop("u4", "u5", "u6")
    d = scratch.stash(d, "loans")
    starts = _starts(d.select("at", (u("at") + 6 + u("defaulted")).alias("next")), n)
    return starts.join(d, "at").drop("at")


def messy_customers(spark: SparkSession, n: int = 200, seed: int = 404) -> DataFrame:
    """Text cells with an identifier, a constant, junk among numbers, nulls of several kinds, a rare category, and one row in REPEATED twice.

    A row takes one number less where its channel is the rare one, and one less where its age is junk.
    """
    base, u = n - n // REPEATED, F.col
    d = _from(spark, 7 * n + n, seed, 7)
    rare = u("u1") < 0.02
    # What comes after the channel is a place earlier where that took no number of its own.
    after = [F.when(rare, u(f"u{j}")).otherwise(u(f"u{j + 1}")).alias(f"v{j}") for j in range(2, 6)]
    d = d.select("at", "u0", rare.alias("rare"), _pick("u2", ["web", "shop", "phone"]).alias("usual"), *after)
    d = d.select("at", _nearest(1200 + u("u0") * 5000).alias("income"), F.when(u("rare"), "fax").otherwise(u("usual")).alias("channel"), "rare", "v2", "v3", "v4", "v5")
    # The weights of the published rows.
    logit = -2.9 + 0.00035 * (u("income") - 3000) + F.when(u("channel") == "web", 1.0).when(u("channel") == "shop", 0.5).otherwise(0.0) + (u("v2") - 0.5)
    age = F.when(u("v4") < 0.02, "error").when(u("v4") < 0.14, _pick("v5", ["", "NA", "-"])).otherwise(_nearest(18 + u("v5") * 55).cast("string"))
    d = d.select("at", age.alias("age"), u("income").cast("string").alias("income"), "channel", F.when(_chance(logit, "v3") == 1, "yes").otherwise("no").alias("signed"), (u("at") + 7 - u("rare").cast("int") - (u("v4") < 0.02).cast("int")).alias("next"))
    d = scratch.stash(d, "customers")
    starts = scratch.stash(_starts(d.select("at", "next"), base + 1), "starts")
    rows = starts.filter(u("__row_id") < base).join(d.drop("next"), "at")
    rows = rows.select("__row_id", F.format_string("C-%04d", u("__row_id") + 1).alias("customer"), F.lit("MX").alias("country"), "age", "income", "channel", "signed")
    # The numbers after those of all rows say which are there again.
    end = starts.filter(u("__row_id") == base).select(u("at").alias("end"))
    again = uniform(spark.range(n - base).join(F.broadcast(end)).select(u("id"), (u("end") + u("id")).alias("k")), u("k"), seed, "u")
    again = again.select((u("id") + base).alias("to"), F.floor(u("u") * base).alias("__row_id")).join(rows, "__row_id").drop("__row_id").withColumnRenamed("to", "__row_id")
    return rows.unionByName(again)
