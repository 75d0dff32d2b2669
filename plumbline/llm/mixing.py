"""Mixing to target weights with soft membership.

A classifier trained from a labelled table gives each document posterior
probabilities of the domains. Nonnegative rates are then fitted so that the
expected tokens of each domain, the sum of rate * tokens * posterior, come as
near the targets as they can: weighted least squares by projected gradient.
A gradient has one number per domain, so a pass over the documents sends the
driver one row, and a document's rate follows from its posteriors and the
gradients so far alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packing
from .common import stash, text_or_empty

#: Hashed features: byte trigrams of the text as it is, and lower-case words.
TRIGRAMS, WORDS = 2048, 4096
#: Training rows of a domain at most, and training steps.
PER_DOMAIN, STEPS, DECAY = 1000, 300, 1e-5
#: The residual, as a share of the budget, at which the fit ends; or else it ends where STALL passes make it less by no more than GAIN.
CLOSE, STALL, GAIN = 1e-6, 10, 0.05
SLICE = 1 << 20
CHUNK = 256
#: Shares of tokens that the default targets give the default domains.
TARGETS = {"high": 0.88, "low": 0.09, "toxic": 0.03}
#: Seed of the registered uses' random rounding.
SEED = 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = np.array([c > 127 or chr(c).isalnum() for c in range(256)])
_R = 0x9E3779B1
_R_INVERSE = pow(_R, -1, 1 << 32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint32)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint32)


_POWERS, _BACK = _powers(_R, SLICE + 64), _powers(_R_INVERSE, SLICE + 64)


def vector(text: str) -> tuple[np.ndarray, int]:
    """Features of a whole text, and its words between white space."""
    raw = text.encode("utf-8", "replace")
    tri, words = np.zeros(TRIGRAMS, np.int64), np.zeros(WORDS, np.int64)
    at = 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        while end < len(raw) and end - at < SLICE + 60 and _WORD[raw[end]]:
            end += 1
        b = np.frombuffer(raw, np.uint8, min(end + 2, len(raw)) - at, at).astype(np.uint32)
        if len(b) > 2:
            h = b[:-2] * np.uint32(_R) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
            tri += np.bincount(h >> np.uint32(21), minlength=TRIGRAMS)
        low = np.frombuffer(raw[at:end].translate(_LOWER), np.uint8)
        inside = np.concatenate([[False], _WORD[low], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint32), np.cumsum((low.astype(np.uint32) + np.uint32(1)) * _POWERS[: len(low)], dtype=np.uint32)])
        h = (total[stop] - total[start]) * _BACK[start]
        h ^= h >> np.uint32(15)
        words += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=WORDS)
        at = end
    parts = [np.sqrt(x).astype(np.float32) for x in (tri, words)]
    return np.concatenate([x / max(float(np.linalg.norm(x)), 1e-12) for x in parts]), len(text.split())


def _counter(vocabulary: str | bool) -> Callable[[str, int], int]:
    """Tokens of a text with so many words: those, or the ids of packing's encoder."""
    if not vocabulary:
        return lambda text, words: words
    encoder = packing._encoder(None if vocabulary is True else vocabulary)
    return lambda text, words: len(encoder.encode(text)) // 4 + 1


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        domain, at, value = [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v, _ = vector(t)
            k = np.flatnonzero(v)
            domain.append(d), at.append(k.astype(np.uint16).tobytes()), value.append(v[k].astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(domain, pa.string()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["domain", "at", "value"])


class Classifier:
    """Softmax regression; priors are those of all labelled rows."""

    def __init__(self, domains: list[str], x: np.ndarray, y: np.ndarray, priors: np.ndarray):
        self.domains = domains
        one = np.eye(len(domains), dtype=np.float32)[y]
        mean = one.mean(0)
        w, bias = np.zeros((x.shape[1], len(domains)), np.float32), np.zeros(len(domains), np.float32)
        w0, b0 = w, bias
        for step in range(STEPS):
            k = step / (step + 3)
            vw, vb = w + k * (w - w0), bias + k * (bias - b0)
            p = _softmax(x @ vw + vb) - one
            w0, b0 = w, bias
            w, bias = vw - 2.0 * (x.T @ p / len(x) + DECAY * vw), vb - 2.0 * p.mean(0)
        self.w, self.bias = w, bias + np.log(np.maximum(priors, 1e-9) / np.maximum(mean, 1e-9)).astype(np.float32)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return _softmax((x @ self.w + self.bias).astype(np.float64))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def quality_domains(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> (doc_id, domain): toxic, or else high or low by quality; null where neither tells."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier | None:
    """labelled(doc_id, domain) -> classifier of docs' texts; None where no row is labelled.

    Null ids and domains are passed over. Of each domain the rows with the
    least hashed ids teach, PER_DOMAIN at most; priors are of all rows.
    """
    rows = labelled.select(F.col("doc_id").alias("__id"), "domain", F.xxhash64("doc_id", F.lit("mixing")).alias("h")).dropna()
    counts = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * PER_DOMAIN / n))])
    few = rows.filter(F.pmod("h", F.lit(1 << 30)) <= F.element_at(share, F.col("domain")) * (1 << 30))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("h", "__id"))).filter(F.col("n") <= PER_DOMAIN)
    # At most PER_DOMAIN ids for each domain are broadcast.
    chosen = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text")).join(F.broadcast(few), "__id")
    got = chosen.select("domain", "text").mapInArrow(_sparse, "domain string, at binary, value binary").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r["domain"], bytes(r["at"]), bytes(r["value"])))
    domains = sorted(counts)
    x = np.zeros((len(got), TRIGRAMS + WORDS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float16)
    priors = np.array([counts[d] for d in domains], float)
    return Classifier(domains, x, np.array([domains.index(r["domain"]) for r in got]), priors / priors.sum())


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | bool = False) -> DataFrame:
    """(id, tokens, posterior): posterior has a probability for each of the model's domains, in order."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                got = [(v, count(t, n)) for t in b.column(1).to_pylist() for v, n in [vector(t)]]
                p = model.posteriors(np.stack([v for v, _ in got]))
                offsets = pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in got], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names=["id", "tokens", "posterior"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(predicted, f"id {kind}, tokens bigint, posterior array<double>")


def _rates(p: np.ndarray, first: float, steps: list[np.ndarray]) -> np.ndarray:
    r = np.full(len(p), first)
    for v in steps:
        r = np.maximum(r - p @ v, 0)
    return r


def _columns(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return b.column("tokens").to_numpy().astype(float), b.column("posterior").flatten().to_numpy().reshape(-1, k)


def fit(soft: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None) -> tuple[float, list[np.ndarray], dict[str, float]]:
    """soft(tokens, posterior) -> (first rate, steps, expected tokens of each domain).

    Where nonnegative rates cannot meet the targets, the fit ends as near as
    they come, and a warning has the residual.

    targets are shares of the budget, by default the expected tokens of the
    domains that have a target above 0, so that rates are about 1 where shares
    are the corpus's own. Domains without a target have 0. The fit is in the
    metric of the domains' own tokens, in which a step of 1 is safe.
    """
    k = len(domains)

    def summed(first: float, steps: list[np.ndarray], square: bool) -> np.ndarray:
        width = k * k if square else k

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                t, p = _columns(b, k)
                total += ((p * t[:, None]).T @ p).ravel() if square else (t * _rates(p, first, steps)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in total], names=[f"s{j}" for j in range(width)])

        got = soft.select("tokens", "posterior").mapInArrow(part, ", ".join(f"s{j} double" for j in range(width)))
        row = got.agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).first()
        return np.array([x or 0.0 for x in row])

    whole = summed(1.0, [], False)
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if not whole.sum() or not weight.sum():
        return 0.0, [], dict.fromkeys(domains, 0.0)
    budget = float(whole[weight > 0].sum()) if budget is None else budget
    goal = budget * weight / weight.sum()
    square = summed(1.0, [], True).reshape(k, k)
    inverse = np.linalg.inv(square + np.eye(k) * 1e-9 * np.trace(square))
    first, steps = budget / float(whole.sum()), []
    now = whole * first
    residuals = [float(np.abs(now - goal).max()) / budget]
    while residuals[-1] > CLOSE and not (len(residuals) > STALL and residuals[-1] > (1 - GAIN) * residuals[-1 - STALL]):
        steps.append(inverse @ (now - goal))
        now = summed(first, steps, False)
        residuals.append(float(np.abs(now - goal).max()) / budget)
    if residuals[-1] > CLOSE:
        warnings.warn(f"the targets are not met: a domain is {residuals[-1]:.2%} of the budget off", stacklevel=2)
    return first, steps, dict(zip(domains, now.tolist(), strict=True))


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", whole: tuple[str, ...] = (), vocabulary: str | bool = False
) -> DataFrame:
    """One row per row of docs: (id_col, tokens, domain, posterior, rate).

    tokens are words between white space or, with ``vocabulary`` (True, or a
    path), ids of packing's encoder and one for the document's end; domain is
    the likeliest; posterior maps domains to probabilities. ``whole`` names
    domains whose sure documents are to be taken once at least: where their
    rates are below 1, all rates grow alike, and with them the budget. Null and
    empty texts have no words, and a rate like any other. Without a labelled
    row, or where no document has a token, rates are 1 and 0. Repeated rows are
    repeated; an empty table gives none; other columns are ignored whatever
    their names. Texts are read whole, however long.
    """
    targets = TARGETS if targets is None else targets
    model = train(docs, labelled, id_col, text_col)
    if model is None:
        words = F.size(F.filter(F.split(text_or_empty(text_col), r"\s+"), lambda w: w != ""))
        none = F.lit(None).cast("map<string,double>")
        return docs.select(F.col(id_col), words.cast("long").alias("tokens"), F.lit(None).cast("string").alias("domain"), none.alias("posterior"), F.lit(1.0).alias("rate"))
    soft = stash(posteriors(docs, model, id_col, text_col, vocabulary), "soft")
    domains = model.domains
    first, steps, _ = fit(soft, domains, targets, budget)
    sure = _rates(np.eye(len(domains)), first, steps)
    least = min([sure[i] for i, d in enumerate(domains) if d in whole and sure[i] > 0], default=1.0)
    if least < 1:
        first, steps = first / least, [v / least for v in steps]

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = _rates(_columns(b, len(domains))[1], first, steps)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], names=["id", "tokens", "posterior", "rate"])

    kind = docs.schema[id_col].dataType.simpleString()
    names = F.array(*[F.lit(d) for d in domains])
    out = soft.mapInArrow(rated, f"id {kind}, tokens bigint, posterior array<double>, rate double")
    likeliest = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    return out.select(F.col("id").alias(id_col), "tokens", likeliest.alias("domain"), F.map_from_arrays(names, "posterior").alias("posterior"), "rate")


def copies(rates: DataFrame, id_col: str = "doc_id", seed: int | None = None) -> DataFrame:
    """rates with ``copies``: the rate rounded half up, or with a seed at random by hashed id so that its expectation is the rate."""
    u = F.lit(0.5) if seed is None else F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 40)) / (1 << 40)
    return rates.withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def apply(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, each row as often as rates(id_col, copies) says; of an id with several, the most counts."""
    times = rates.groupBy(F.col(id_col).alias("__id")).agg(F.max("copies").alias("__copies")).filter(F.col("__copies") > 0)
    # The rates grow with the documents, so the join is a merge join at every size.
    rows = docs.select(F.col(id_col).alias("__own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    taken = rows.join(times.hint("merge"), F.col("__own").eqNullSafe(F.col("__id")))
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
