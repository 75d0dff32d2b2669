"""Language identification by hierarchical discrimination.

Linear support vector machines first decide between language families, one
against one; those of the family that wins then separate its languages, one
against one. All share one vector of hashed byte trigrams of the whole text.
That one language wins says nothing of texts in none of them, so each language
also has a profile of its trigrams, which a text has to fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: Hashed features of a text.
FEATURES = 4096
#: Training rows at most, for each language and in all.
PER_LANGUAGE, TRAINING = 600, 4800
#: Languages that are learned at most: those with the most rows. Pairs of them are compared.
LANGUAGES = 200
EPOCHS, COST = 12, 10.0
#: Bytes of a text that are held as arrays at a time.
SLICE = 1 << 20
#: Of a language's labelled rows, one in CALIBRATION is kept from its profile; of those, the share FITTING has to fit.
CALIBRATION, FITTING = 4, 0.95
#: Least limit of misfit in deviations, and variance of texts' means beside that of sampling.
LEAST_LIMIT, SPREAD = 4.0, 0.03
#: Texts whose vectors are held at a time.
CHUNK = 256

#: Families of languages by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "turkic": "az kk ky tr uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms tl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTERS_ONLY = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed byte trigram counts."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY) + b" "
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, len(raw) - 2, SLICE):
        b = np.frombuffer(raw, np.uint8, min(SLICE + 2, len(raw) - at), at).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
        counts += np.bincount(h, minlength=FEATURES)
    v = np.sqrt(counts).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-12)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            part = b.slice(at, CHUNK)
            rows = [(lang, features(t).astype(np.float16).tobytes()) for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "vector"])


def separate(x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear SVM of x's given rows, whose last column is 1; y is 1 or -1 for each. Dual coordinate descent on the squared hinge."""
    weight = np.where(y > 0, len(y) / max(1, 2 * int((y > 0).sum())), len(y) / max(1, 2 * int((y < 0).sum())))
    extra = 1 / (2 * COST * weight)
    norm = np.einsum("ij,ij->i", x, x)[rows] + extra
    alpha, w, draw = np.zeros(len(rows)), np.zeros(x.shape[1]), np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            row = x[rows[i]]
            gradient = y[i] * (row @ w) - 1 + alpha[i] * extra[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * row
                alpha[i] = new
    return w


def one_against_one(x: np.ndarray, y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Classes in order, and the weights of each pair of them in the order of combinations. Rows whose class is None are left out."""
    classes = sorted(set(y.tolist()) - {None})
    weights = []
    for a, b in combinations(classes, 2):
        rows = np.flatnonzero((y == a) | (y == b))
        weights.append(separate(x, rows, np.where(y[rows] == a, 1.0, -1.0)))
    return classes, np.array(weights).reshape(-1, x.shape[1])


def vote(classes: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """margins (rows, pairs) -> winner's index, and its least probability against another.

    Most won pairs wins; of equals, the greatest sum of margins, then the first class in text order.
    """
    n = len(margins)
    if len(classes) == 1:
        return np.zeros(n, int), np.ones(n)
    won, total, least = np.zeros((n, len(classes))), np.zeros((n, len(classes))), np.ones((n, len(classes)))
    for (a, b), m in zip(combinations(range(len(classes)), 2), margins.T, strict=True):
        p = 1 / (1 + np.exp(-3 * np.clip(m, -20, 20)))
        won[:, a] += m >= 0
        won[:, b] += m < 0
        total[:, a] += m
        total[:, b] -= m
        least[:, a] = np.minimum(least[:, a], p)
        least[:, b] = np.minimum(least[:, b], 1 - p)
    best = np.lexsort((-np.arange(len(classes)) * np.ones((n, 1)), total, won), axis=1)[:, -1]
    return best, least[np.arange(n), best]


class Profile:
    """How well a text fits a language: its trigrams' mean log-likelihood ratio to evenly spread ones, against that of labelled rows.

    x's squares are shares of trigrams. Rows of x in turn teach and calibrate;
    a text's misfit is how far it is below the calibrating rows' median, in
    deviations of the mean of as many trigrams.
    """

    def __init__(self, x: np.ndarray):
        kept = np.arange(len(x)) % CALIBRATION == CALIBRATION - 1
        kept = kept if kept.any() else np.ones(len(x), bool)
        share = (x[~kept] if not kept.all() else x).astype(np.float64) ** 2
        p = share.mean(0)
        p = 0.98 * p / max(p.sum(), 1e-12) + 0.02 / FEATURES
        self.ratio = np.log(p * FEATURES)
        self.variance = float(p @ self.ratio**2 - (p @ self.ratio) ** 2)
        self.middle, self.limit = 0.0, 0.0
        self.middle = float(np.median(x[kept].astype(np.float64) ** 2 @ self.ratio))
        self.limit = max(LEAST_LIMIT, float(np.quantile(self.misfit(x[kept]), FITTING)))

    def misfit(self, x: np.ndarray) -> np.ndarray:
        share = x.astype(np.float64) ** 2
        # Three trigrams share each byte.
        return (self.middle - share @ self.ratio) / np.sqrt(3 * self.variance * (share**2).sum(1) + SPREAD)


class Model:
    """Families, and within each its languages; x has a last column of ones."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        family = np.array([FAMILY.get(c, c) for c in lang.tolist()], object)
        self.families = one_against_one(x, family)
        self.languages = {f: one_against_one(x, np.where(family == f, lang, None)) for f in self.families[0]}
        self.profiles = {c: Profile(x[lang == c, :-1]) for c in sorted(set(lang.tolist()))}

    def fit(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How far each row is within the limit of its language's profile; negative beyond it."""
        out = np.zeros(len(x))
        for c in set(lang.tolist()):
            at = lang == c
            out[at] = self.profiles[c].limit - self.profiles[c].misfit(x[at])
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        family, sure = vote(self.families[0], one @ self.families[1].T)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for i, f in enumerate(self.families[0]):
            at = family == i
            if at.any():
                classes, weights = self.languages[f]
                best, within = vote(classes, one[at] @ weights.T)
                lang[at] = np.array(classes, object)[best]
                score[at] = sure[at] * within
        return lang, score


def train(docs: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of docs' languages, from rows where ``use`` holds.

    Rows with a null language, and texts without a letter, teach nothing. Of
    each language the rows with the least hashed ids are taken, PER_LANGUAGE at
    most and TRAINING in all, of the LANGUAGES with the most rows (of equals,
    the first in text order); whole texts are read. None without any such row.
    Any text may be a language's label, the empty one too.
    """
    docs = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    docs = docs if use is None else docs.filter(use)
    docs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit("language")).alias("h"))
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    each = max(1, min(PER_LANGUAGE, TRAINING // len(counts)))
    # Twice the share first, by hash alone, so that the window has few rows to order.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * each / n))])
    few = docs.filter(F.pmod("h", F.lit(1 << 30)) <= F.element_at(share, F.col("lang")) * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", F.crc32("text"))
    chosen = few.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= each)
    rows = chosen.select("lang", "text").mapInArrow(_vectors, "lang string, vector binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    x = np.ones((len(rows), FEATURES + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, :-1] = np.frombuffer(r["vector"], np.float16)
    return Model(x, np.array([r["lang"] for r in rows], object))


def annotate(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with the columns lang_pred, score and fit, which replace any of those names.

    fit is how far the text is within the limit of its language's profile. Only
    the text decides, the whole of it, SLICE bytes at a time. Null texts and
    texts without a letter, or all where there is no model, are ``und`` with
    score and fit 0. Rows stay as they are: repeated ones are repeated, ids may
    be null, and an empty table gives none.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "fit")]
    at_text = names.index(text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                texts = part.column(at_text).to_pylist()
                lang, score, fit = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts))
                known = np.array([model is not None and has_letter(t) for t in texts], bool)
                if known.any():
                    x = np.stack([features(t) for t, k in zip(texts, known, strict=True) if k])
                    lang[known], score[known] = model.predict(x)
                    fit[known] = model.fit(x, lang[known])
                found = [pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(fit)]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*names, "lang_pred", "score", "fit"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names).mapInArrow(predicted, f"{kinds}, lang_pred string, score double, fit double")


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row of docs, as ``annotate`` has them; other columns are ignored whatever their names."""
    return annotate(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select("id", "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: its id's CRC-32 modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(lang: str = "lang_pred", fit: str = "fit") -> Column:
    """Whether a prediction stands: a language, whose profile the text fits."""
    return (F.col(lang) != UNDETERMINED) & (F.col(fit) >= 0)
