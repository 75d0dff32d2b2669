"""Stretches of runs that the models take for random, against one character after another."""

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from plumbline.llm import secrets

SHORT = secrets.CANDIDATE_LENGTH - 1


@pytest.fixture(scope="module")
def ratios(spark):
    return secrets.train(secrets.samples(spark))


def stretches(run, ratios):
    """Spans of a run: all of it, or else its best stretches with the letters and digits next to them."""
    size, code = len(secrets.ALPHABET), [secrets.ALPHABET.index(c) for c in run]
    over = [float(f"{ratios[a * size + b]:.6f}") - secrets.LEAST_EACH for a, b in zip(code, code[1:], strict=False)]
    enough = lambda x, n: x >= 0 and x + secrets.LEAST_EACH * n >= secrets.LEAST_TOTAL
    if enough(sum(over), len(over)):
        return [(0, len(run))]
    sums, out = [0.0], []
    for x in over:
        sums.append(sums[-1] + x)

    def add(first, last):
        start = first - len(re.search("[A-Za-z0-9]*$", run[:first]).group())
        end = last + 1 + len(re.match("[A-Za-z0-9]*", run[last + 1 :]).group())
        if out and out[-1][1] >= start:
            start = out.pop()[0]
        out.append((start, end))

    def fresh(least):
        return {"least": least, "low": 1e300, "at": 0, "best": -1e300, "first": 0, "last": 0, "top": 0.0}

    s = fresh(0)
    for i in range(1, len(over) + 1):
        at = i - SHORT
        if at >= s["least"] and sums[max(at, 0)] < s["low"]:
            s["low"], s["at"] = sums[at], at
        if sums[i] - s["low"] > s["best"]:
            s["best"], s["first"], s["last"], s["top"] = sums[i] - s["low"], s["at"], i, sums[i]
        if enough(s["best"], s["last"] - s["first"]) and s["top"] - sums[i] >= secrets.LEAST_TOTAL:
            add(s["first"], s["last"])
            s = fresh(s["last"])
    if enough(s["best"], s["last"] - s["first"]):
        add(s["first"], s["last"])
    return out


def runs(n, seed):
    draw = random.Random(seed)
    token = lambda: "".join(draw.choices(string.ascii_letters + string.digits, k=draw.randint(8, 40)))
    words = ["house", "people", "return", "configuration", "the", "value", "index", "service", "und", "que"]
    for _ in range(n):
        parts = [draw.choice([token(), *draw.choices(words, k=4)]) for _ in range(draw.randint(2, 14))]
        yield "".join(p + draw.choice(["", "-", "/", "_", "=", "--"]) for p in parts)


def markov(spark, texts, ratios):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = F.filter("__found.all", lambda s: s["kind"] == 3)
    return {r["doc_id"]: [(s["start"], s["end"], s["value"]) for s in r["s"]] for r in secrets.scan(d, ratios).select("doc_id", spans.alias("s")).collect()}


def test_stretches_by_plain_version(spark, ratios):
    texts = [x for x in runs(600, 1) if not re.search("[0-9a-f]{24}|AKIA|secret|token|passw", x)]
    got, several = markov(spark, texts, ratios), 0
    for i, text in enumerate(texts):
        want = [(m.start() + a, m.start() + z) for m in re.finditer(secrets.CANDIDATE, text) for a, z in stretches(m.group(), ratios)]
        assert [(a, z) for a, z, _ in got[i]] == want and all(v == text[a:z] for a, z, v in got[i])
        several += len(want) > 1
    assert several > 50


@pytest.mark.parametrize("shape", ["one long block before a secret", "many secrets in one run"])
def test_long_runs(spark, ratios, shape):
    draw = random.Random(3)
    token = lambda k: "".join(draw.choices(string.ascii_letters + string.digits, k=k))
    if shape.startswith("one"):
        text = "the" * 333_333 + "-" + token(40)
    else:
        text = "-".join("the_house_of_the_many_people/" * 80 + token(24) for _ in range(400))
    began = time.time()
    got = markov(spark, [text], ratios)[0]
    assert time.time() - began < 60 and len(text) > 900_000
    assert got[-1][1] == len(text) and got[-1][2] == text[got[-1][0] :] and len(got) == (1 if shape.startswith("one") else 400)


def test_no_rows_and_clashing_names(spark, ratios):
    d = spark.createDataFrame([], "doc_id long, text string, __found string")
    assert secrets.scan(d, ratios).count() == 0
    one = secrets.scan(spark.createDataFrame([(1, None, "own")], "doc_id long, text string, __found string"), ratios).collect()
    assert one[0]["__found"]["all"] == []
