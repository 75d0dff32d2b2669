"""Spelling variants: words one edit apart, by merging the subtrees of an errata trie.

Words are a trie. At each node the child with the most words below is heavy,
and all others are light. The light subtrees of a node are merged with one
character replaced (by the heavy child's, or by any, among each other), left
out, or with the heavy child's put before it; where the end of a merged word
coincides with the end of another, the two are one edit apart. A light child
has half of its parent's words at most, so a word is merged at no more nodes
than the logarithm of the number of words, however long it is.

The trie is a table: a node is the digest of the text that leads to it, and an
edge is a row of its words' number. Nothing is held whole by one task.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, stash

RUN = "[a-zÀ-ÿ]"
#: Code points of a word, and its occurrences, at least.
LENGTH, OCCURRENCES = 6, 5
#: A form occurs so many times as often as the words that it is the form of.
RATIO = 5
#: Different words that a task counts before it passes their counts on.
COUNTED = 100_000
#: Rows of a batch that a task passes on.
BATCH = 8192
#: Nodes with one in so many of all steps of all words are joined by broadcast; there are no more of them than that.
HOT = 10_000
#: Keys that a root is dealt to.
SALTS = 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_END = -1


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_of: int | None = None, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): runs of letters up to U+00FF, A-Z lower-cased, of so many code points and occurrences at least.

    With ``drop_of``, one in so many pairs of row and run loses a code point, at
    a place that hashing has chosen: errors to be found again. Null and empty
    texts have no words, a null id counts as an empty one, repeated rows count
    each time, other columns are ignored, an empty table gives none. Whole texts
    are read, and each task adds up its own counts before they are shuffled.
    """
    importable(docs.sparkSession)
    run = re.compile(f"{RUN}{{{length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            for begin, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = Counter(run.findall(raw.as_py().translate(_LOWER).decode("utf-8", "replace")))
                if drop_of:
                    start = zlib.crc32(begin)
                    for w, n in own.items():
                        h = zlib.crc32(w.encode(), start)
                        if h % drop_of:
                            total[w] += n
                        else:
                            at = h % len(w)
                            total[w[:at] + w[at + 1 :]] += n
                else:
                    total.update(own)
                if len(total) > COUNTED:
                    yield from passed(total)
                    total = Counter()
        yield from passed(total)

    def passed(total: Counter[str]) -> Iterator[pa.RecordBatch]:
        names, counts = list(total), list(total.values())
        for k in range(0, len(names), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(names[k : k + BATCH], pa.string()), pa.array(counts[k : k + BATCH], pa.int64())], names=["word", "n"])

    begin = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":")).cast("binary")
    rows = docs.filter(F.col(f"`{text_col}`").isNotNull()).select(begin.alias("begin"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    found = rows.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter((F.length("word") >= length) & (F.col("n") >= occurrences))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word -> (node, id, at, next): each node on its way, and the character after it."""
    out: list[tuple[bytes, bytes, int, int]] = []

    def batch() -> pa.RecordBatch:
        node, own, at, after = zip(*out, strict=True)
        kinds = [pa.array(node, pa.binary()), pa.array(own, pa.binary()), pa.array(at, pa.int32()), pa.array(after, pa.int32())]
        return pa.RecordBatch.from_arrays(kinds, names=["node", "id", "at", "next"])

    for b in batches:
        for word in b.column(0).to_pylist():
            own, state = _digest(word), hashlib.blake2b(digest_size=16)
            for i, c in enumerate(word):
                out.append((state.digest(), own, i, ord(c)))
                state.update(c.encode())
                if len(out) >= BATCH:
                    yield batch()
                    out.clear()
            out.append((state.digest(), own, len(word), _END))
    if out:
        yield batch()


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def light_steps(found: DataFrame) -> DataFrame:
    """found(word) -> (id, lights): the places (at, heavy) at which each word leaves the heavy path, and that path's character there.

    id is the digest of the word; words without such a place have no row. Words
    are to be distinct.
    """
    steps = found.select("word").mapInArrow(_steps, "node binary, id binary, at int, next int")
    edges = steps.groupBy("node", "next").agg(F.count(F.lit(1)).alias("size"))
    # The end of a word is a child of one word; a true child of as many goes before it.
    nodes = edges.groupBy("node").agg(F.max(F.struct("size", "next"))["next"].alias("heavy"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("children"))
    nodes = stash(nodes.filter("children > 1").drop("children"), "nodes")
    total = found.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    is_hot = F.col("size") * HOT >= total
    # Sizes add up to the steps of all words, so the hot nodes are HOT at most, and no key beside them has many rows.
    hot, cold = F.broadcast(nodes.filter(is_hot).select("node", "heavy")), nodes.filter(~is_hot).select("node", "heavy")
    lights = steps.join(hot, "node").filter("next != heavy").union(steps.join(hot, "node", "left_anti").join(cold, "node").filter("next != heavy").select("node", "id", "at", "next", "heavy"))
    return lights.groupBy("id").agg(F.collect_list(F.struct("at", "heavy")).alias("lights"))


def merged(word: str, lights: list[tuple[int, int]]) -> Iterator[tuple[str, bool]]:
    """(text, whether all that share it are one replacement apart) for each place at which a word's subtree is merged.

    Other texts are words one edit from this one, if they are words. Of places in
    a run of one character the last stands for all, so that no pair comes twice.
    """
    for at, h in lights:
        before, here, rest, heavy = word[:at], word[at : at + 1], word[at + 1 :], chr(h)
        yield before + heavy + here + rest, False
        if here:
            yield before + heavy + rest, False
            yield f"{before}\0{rest}", True
            if rest[:1] != here:
                yield before + rest, False


def near(found: DataFrame) -> DataFrame:
    """found(word, n) -> (word, n_near, best_n, best): how many words are one inserted, deleted or replaced code point away, and the commonest of them.

    Of equals the first in code-point order; words without any have no row.
    Words are to be distinct; null ones are passed over. Light words that share
    a text with a place left open are at most as many as there are letters.
    """
    importable(found.sparkSession)
    found = found.filter("word IS NOT NULL").select("word", "n")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for word, n, lights in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows += [(key, open_, word, n) for key, open_ in merged(word, [(x["at"], x["heavy"]) for x in lights])]
            for k in range(0, len(rows), BATCH):
                key, open_, word, n = zip(*rows[k : k + BATCH], strict=True)
                columns = [pa.array(key, pa.string()), pa.array(open_, pa.bool_()), pa.array(word, pa.string()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "open", "word", "n"])

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_digest(w) for w in b.column(0).to_pylist()], pa.binary())], names=["word", "n", "id"])

    ided = found.mapInArrow(identified, "word string, n bigint, id binary")
    merges = stash(ided.join(light_steps(found), "id").select("word", "n", "lights").mapInArrow(keys, "key string, open boolean, word string, n bigint"), "merges")
    # Ends that coincide with those of words.
    ends = merges.filter("NOT open").select("key", "word", "n").join(found.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key")
    both = F.explode(F.array(F.struct(F.col("word"), F.col("key_n").alias("best_n"), F.col("key").alias("best")), F.struct(F.col("key").alias("word"), F.col("n").alias("best_n"), F.col("word").alias("best"))))
    pairs = ends.select(both.alias("p")).select(F.col("p.word").alias("word"), F.lit(1).cast("long").alias("k"), F.struct((-F.col("p.best_n")).alias("m"), F.col("p.best").alias("w")).alias("best"))
    # Light subtrees merged with each other: a group has a word for each letter at most.
    group = merges.filter("open").groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")))).alias("g")).filter("size(g) > 1")
    member = F.explode(F.transform("g", lambda x: F.struct(x["w"].alias("word"), F.when(F.col("g")[0]["w"] == x["w"], F.col("g")[1]).otherwise(F.col("g")[0]).alias("best"))))
    grouped = group.select((F.size("g") - 1).cast("long").alias("k"), member.alias("p")).select("p.word", "k", "p.best")
    got = pairs.union(grouped).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return got.select("word", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.w").alias("best"))


def group(found: DataFrame, ratio: float = RATIO) -> DataFrame:
    """found(word, n) -> (word, n, n_near, form, form_n, root), a row for each word.

    form is the commonest near word, where it occurs ``ratio`` times as often at
    least, and null otherwise. root is the last form of a chain of them; each
    occurs more often than the one before, so that chains end, and each round of
    joins follows twice as many steps as the one before.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    own = F.col("best_n") >= F.col("n") * ratio
    all_ = found.join(near(found), "word", "left")
    formed = all_.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(own, F.col("best")).alias("form"), F.when(own, F.col("best_n")).alias("form_n"))
    formed = stash(formed, "forms")
    roots, more = stash(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots"), True
    while more:
        # A root that very many words have is dealt out by the words' own hash.
        salted = roots.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        moved = stash(salted.join(onward, ["root", "salt"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        more = not moved.filter("moved").isEmpty()
        roots = moved.select("word", "root")
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_of: int | None = None) -> DataFrame:
    """Words of docs with their forms and roots: ``words`` and then ``group``."""
    return group(stash(words(docs, id_col, text_col, drop_of), "words"))
