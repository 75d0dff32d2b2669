"""Stratified train and test parts, fixed by a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.random import uniform
from plumbline.sources import scratch

TEST_SIZE = 0.25
SEED = 42
_MASK = 0xFFFFFFFF


def _check(test_size: float) -> None:
    if not 0 < test_size < 1:
        raise ValueError("test size must lie between 0 and 1")


def test_count(n: Column, test_size: float) -> Column:
    """Rows of a class of n that are for test: the share rounded half up, but one at least, and one left for training."""
    return F.when(n < 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.floor(n * F.lit(float(test_size)) + 0.5), n - 1)))


def _digested(df: DataFrame, label: Column, row_id: str, seed: int) -> DataFrame:
    """df with __rank, from 1 within the class in order of digests of seed and id, and __n, the class's rows.

    Ranks come from counts by the digest's leading bits and ranks within those,
    so that a class with most of the rows is ranked by many tasks.
    """
    d = df.withColumn("__label", label).withColumn("__key", F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string"))))
    d = d.withColumn("__b", F.substring("__key", 1, 3))
    counts = d.groupBy("__label", "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__label")
    base = counts.withColumn("__base", F.coalesce(F.sum("__c").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = base.withColumn("__n", F.sum("__c").over(w)).drop("__c")
    base = base.select(F.col("__label").alias("__l2"), F.col("__b").alias("__b2"), "__base", "__n")
    d = d.withColumn("__within", F.row_number().over(Window.partitionBy("__label", "__b").orderBy("__key", row_id)))
    d = d.join(base, F.col("__label").eqNullSafe(F.col("__l2")) & (F.col("__b") == F.col("__b2")))
    return d.withColumn("__rank", F.col("__base") + F.col("__within"))


def stratified(df: DataFrame, label: Column, row_id: str, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """df with ``part``: train or test. Of each class the rows with the least digests of seed and id are for test."""
    _check(test_size)
    part = F.when(F.col("__rank") <= test_count(F.col("__n"), test_size), "test").otherwise("train")
    return _digested(df, label, row_id, seed).select(*df.columns, part.alias("part"))


def folds(df: DataFrame, label: Column, row_id: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """df with ``fold`` from 0 to k - 1: each class's rows dealt one by one in order of digests, so that folds have equal shares of it."""
    if k < 2:
        raise ValueError("two folds at least")
    return _digested(df, label, row_id, seed).select(*df.columns, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int").alias("fold"))


def counter_random(seed: int, k: int) -> float:
    """Draw k (from 0) of the small counter-based generator that the compatible split uses: a pure function of both."""
    state = (seed + (k + 1) * 0x6D2B79F5) & _MASK
    mixed = ((state ^ state >> 15) * (state | 1)) & _MASK
    mixed ^= (mixed + ((mixed ^ mixed >> 7) * (mixed | 61) & _MASK)) & _MASK
    return (mixed ^ mixed >> 14) / (1 << 32)


def compatible(labels: list[str], test_size: float = TEST_SIZE, seed: int = SEED) -> tuple[list[int], list[int]]:
    """Train and test positions as the published sequence has them: for tables that fit the driver.

    Classes in order of appearance share one generator; each is shuffled from
    its end, and its first rows are for test.
    """
    _check(test_size)
    if not labels:
        raise ValueError("no labels")
    draws, train, test = 0, [], []
    for members in ([i for i, x in enumerate(labels) if x == label] for label in dict.fromkeys(labels)):
        for last in range(len(members) - 1, 0, -1):
            other = int(counter_random(seed, draws) * (last + 1))
            draws += 1
            members[last], members[other] = members[other], members[last]
        n = len(members)
        take = 0 if n < 2 else max(1, min(int(n * test_size + 0.5), n - 1))
        test += members[:take]
        train += members[take:]
    return sorted(train), sorted(test)


def _ranked(df: DataFrame, label: Column, row_id: str) -> DataFrame:
    """(id, label, i): rows by their ranks from 0 within their class, in order of row_id, nulls first.

    Rows are dealt by ranges of ids; ranks within a range go on top of the counts of earlier ones.
    """
    d = df.select(F.col(row_id).alias("id"), label.alias("label")).repartitionByRange("id")
    # Written, since ranges are sampled and have to be the same for counts and for rows.
    d = scratch.stash(d.withColumn("range", F.spark_partition_id()), "ranges")
    counts = d.groupBy("label", "range").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("label").alias("l2"), F.col("range").alias("r2"), before.alias("before"))
    d = d.withColumn("within", F.row_number().over(Window.partitionBy("label", "range").orderBy("id")))
    return d.join(counts, F.col("label").eqNullSafe(F.col("l2")) & (F.col("range") == F.col("r2"))).select("id", "label", (F.col("before") + F.col("within") - 1).alias("i"))


def shuffled(ranked: DataFrame, classes: list[tuple], seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """ranked(id, label, i) -> (c, i, source), (id, c, i): which member of a class the published shuffle puts at each place, and members.

    classes has (label, rows) in order of appearance. The shuffle goes from a
    class's end: step i swaps places i and j(i), where j(i) <= i is drawn by the
    step's number alone, so all steps are known beforehand. What is at place p
    before step i was put there by the last earlier step that drew p, which is
    the least i' > i with j(i') = p, and what that step put there was at place
    i' before it. So each place follows a chain of steps; chains never meet and
    have about as many members as the logarithm of the rows, and each round of
    joins, on keys that are unique, follows twice as many.
    """
    d = ranked.sparkSession
    offsets, drawn = [], 0
    for c, (label, n) in enumerate(classes):
        offsets.append((c, label, n, drawn))
        drawn += max(0, n - 1)
    own = d.createDataFrame(offsets, f"c int, label {ranked.schema['label'].dataType.simpleString()}, n long, drawn long")
    members = ranked.join(F.broadcast(own.withColumnRenamed("label", "l2")), F.col("label").eqNullSafe(F.col("l2")))  # a row for each class
    steps = uniform(members.filter("i > 0"), F.col("drawn") + F.col("n") - 1 - F.col("i"), seed, "u").select("c", "i", F.floor(F.col("u") * (F.col("i") + 1)).alias("j"))
    steps = scratch.stash(steps.withColumn("earlier", F.lead("i").over(Window.partitionBy("c", "j").orderBy("i"))), "steps")
    chain, more = scratch.stash(steps.filter("i > j").groupBy("c", F.col("j").alias("i")).agg(F.min("i").alias("to")), "chain"), True
    while more:
        onward = chain.select("c", F.col("i").alias("to"), F.col("to").alias("next"))
        chain = scratch.stash(chain.join(onward, ["c", "to"], "left").select("c", "i", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "chain")
        more = not chain.filter("moved").isEmpty()
        chain = chain.drop("moved")
    first = members.filter("i = 0").select("c", "i", F.col("i").alias("at"), F.lit(None).cast("long").alias("j"))
    # A step that draws its own place leaves what is there.
    places = steps.select("c", "i", F.when(F.col("i") == F.col("j"), F.col("i")).otherwise(F.col("earlier")).alias("at"), "j").union(first)
    ends = chain.select("c", F.col("i").alias("at"), "to")
    source = F.coalesce("to", "at", "j").alias("source")
    return places.join(ends, ["c", "at"], "left").select("c", "i", source), members.select("id", "c", "i")


def published(df: DataFrame, label: Column, row_id: str, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """df with ``part``, as ``compatible`` splits it, at any size: rows are in order of row_id, which is unique and not null.

    Nothing but a row for each class comes to the driver.
    """
    _check(test_size)
    ranked = scratch.stash(_ranked(df, label, row_id), "ranked")
    classes = [(r["label"], r["n"]) for r in sorted(ranked.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).collect(), key=lambda r: r["first"])]
    if not classes:
        return df.withColumn("part", F.lit("train"))
    places, members = shuffled(ranked, classes, seed)
    takes = {c: 0 if n < 2 else max(1, min(int(n * test_size + 0.5), n - 1)) for c, (_, n) in enumerate(classes)}
    take = F.element_at(F.create_map(*[F.lit(x) for ck in takes.items() for x in ck]), F.col("c"))
    test = places.filter(F.col("i") < take).select("c", F.col("source").alias("i"))
    ids = members.join(test, ["c", "i"]).select(F.col("id").alias("__id"))
    part = F.when(F.col("__id").isNotNull(), "test").otherwise("train")
    return df.join(ids, F.col(row_id) == F.col("__id"), "left").select(*df.columns, part.alias("part"))
