"""Texts of a million characters: whole results, in seconds."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bm25, language, licenses, packing, pii, secrets, simhash, warc

N = 1_000_000


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(0)
    run = "".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), N))
    return {1: run, 2: "token=abcdefgh " * (N // 15), 3: " " * N, 4: "a.b-" * (N // 4), 5: "line of text\n" * (N // 13), 6: "Mr Xavier Alan, " * (N // 16), 7: "ordinary words " * (N // 15)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")


@pytest.fixture(autouse=True)
def quick():
    began = time.perf_counter()
    yield
    assert time.perf_counter() - began < 120


def test_secrets(docs, texts):
    found = secrets.scan(docs).select("doc_id", F.size("__found.base").alias("base"), F.size("__found.all").alias("every"))
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[1]["every"] >= 1 and got[2]["base"] == got[2]["every"] == N // 15 and got[3]["every"] == got[7]["every"] == 0
    clean = {r["doc_id"]: r["n"] for r in secrets.redact(docs).select("doc_id", F.length("text").alias("n")).collect()}
    assert clean[2] == (N // 15) * len("[SECRET] ") and clean[3] == N and clean[7] == len(texts[7])


def test_surrogates(docs, texts):
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs, b"key").select("doc_id", "n_entities", F.length("text").alias("n")).collect()}
    assert got[6]["n_entities"] == 2 * (N // 16) and got[3]["n"] == N and got[1]["n_entities"] == got[4]["n_entities"] == 0


def test_others(spark, docs, texts):
    assert licenses.scan(docs).filter("license_id IS NULL").count() == len(texts)
    assert packing.tokenize_pieces(docs).groupBy("id").agg(F.sum("length")).count() == len(texts)
    assert language.identify(docs, language.train(docs)).count() == len(texts)
    assert simhash.near_duplicates(docs).count() == len(texts)
    index = bm25.build(docs)
    assert [r["doc_id"] for r in bm25.search(index, docs.filter("doc_id = 5"), 1).collect()] == [5]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    got = {r["page_id"]: r["payload_bytes"] for r in warc.measured(warc.read(warc.write(pages))).collect()}
    assert got == {i: len(t) for i, t in texts.items()}
