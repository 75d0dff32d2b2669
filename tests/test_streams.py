"""Keyed rate limits and novelty logged once for each batch."""

from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import preprocess, score
from plumbline.plans import narrate, stream_queries
from plumbline.streaming import limits, scoring

START = datetime(2024, 1, 1)


def requests(n=400, seed=1):
    draw = np.random.default_rng(seed)
    at = np.sort(draw.integers(0, 3000, n))
    return [(i, ["a", "b", "hot", "hot", None][draw.integers(0, 5)], START + timedelta(seconds=int(t))) for i, t in enumerate(at)]


def test_limit_equals_one_request_after_another(spark):
    rows = requests()
    d = spark.createDataFrame(rows, "id long, who string, at timestamp")
    part = (F.col("id") / 100).cast("int")
    got = stream_queries._written(limits.decisions(stream_queries._stream(spark, d, part), "who", "at", "id", hits=3, seconds=60)).collect()
    plain = narrate.RateLimit(3, 60)
    want = {i: plain.allow(who, t.timestamp()) for i, who, t in rows}
    assert {r["id"]: r["allowed"] for r in got} == want and len(got) == len(rows) and 50 < sum(want.values()) < 350


def test_limit_with_disorder_within_a_batch_and_old_keys(spark):
    # A key that comes back after its state has gone; times in no order within a batch; a null time.
    rows = [(0, "k", START, 0), (1, "k", START + timedelta(seconds=5), 0), (2, "other", START + timedelta(hours=2), 1), (3, "other", START + timedelta(hours=3), 2), (5, "k", START + timedelta(hours=4, seconds=1), 3), (4, "k", START + timedelta(hours=4), 3), (6, "k", None, 3)]
    d = spark.createDataFrame(rows, "id long, who string, at timestamp, p int")
    got = stream_queries._written(limits.decisions(stream_queries._stream(spark, d.drop("p"), F.when(F.col("at").isNull(), 3).otherwise(F.greatest(F.lit(0), F.floor((F.unix_timestamp("at") - F.lit(int(START.timestamp()))) / 3600) - 1)).cast("int")), "who", "at", "id", hits=1, seconds=60)).collect()
    allowed = {r["id"]: r["allowed"] for r in got}
    assert allowed == {0: True, 1: False, 2: True, 3: True, 4: True, 5: False, **({6: False} if 6 in allowed else {})}


def test_decide_keeps_a_bounded_log():
    past = []
    for t in range(1000):
        _, past = limits.decide(past, t, 10, 60)
        assert len(past) <= 10


def test_forgotten_keys_of_the_limit_in_process():
    limit = narrate.RateLimit(2, 60)
    for k in range(1000):
        limit.allow(f"key {k}", k)
    assert len(limit.seen) < 130


@pytest.fixture
def learned(spark):
    train = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(1, 11)], "x double, c string")
    return preprocess.learn(train, ["x"], ["c"])


def test_replayed_batches_count_once(spark, tmp_path, learned):
    draw, path = np.random.default_rng(2), f"{tmp_path}/log"
    rows = [(float(draw.integers(-5, 20)), str(draw.choice(list("abz")))) for _ in range(200)] + [(None, None)]
    d = spark.createDataFrame(rows, "x double, c string")
    stream = stream_queries._stream(spark, d)
    scoring.run_novelty(stream, learned, ["x"], ["c"], path, f"{tmp_path}/offsets").awaitTermination()
    batch = d.limit(60)
    scoring.log_novelty(batch, 77, learned, ["x"], ["c"], path)
    scoring.log_novelty(batch, 77, learned, ["x"], ["c"], path)
    cells, total = scoring.novelty_so_far(spark, path)
    want, affected, n = score.novelty_report(d.unionAll(batch), learned, ["x"], ["c"])
    found = defaultdict(int)
    for r in cells.collect():
        found[r["column"], r["kind"]] += r["cells"]
    assert dict(found) == {(c, k): x for c, k, x in want} and tuple(total.first()) == (affected, n)
