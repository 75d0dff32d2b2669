"""SimHash near-duplicates, found by pigeonring filtering.

Two 64-bit fingerprints at Hamming distance 3 or less, cut into four segments
of 16 bits laid in a ring, have a segment from which every chain of l segments
differs in at most floor(3l/4) bits: 0, then 1, then 2, then 3. A candidate
must therefore agree on one segment and differ in at most one bit on the next,
which makes 32 bits of join key: each fingerprint is filed under its own four
keys and looks under the keys with one more bit set in the second segment (of
two that differ in one bit, one has it clear). The rest of the chain and then
the full distance are tested on the candidates.

A key with many fingerprints is cut into blocks, and pairs of blocks are
separate work items. Only links that join two groups not yet joined leave a
work item, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_ids, stash, text_or_empty
from .components import connected_components

SEED = 42
WORDS = 3
DISTANCE = 3
SEGMENT_BITS = 16
SEGMENTS = 4
#: Bits that a chain of 1, 2, 3 and 4 segments may differ in.
BUDGET = [DISTANCE * k // SEGMENTS for k in range(1, SEGMENTS + 1)]
#: Fingerprints under one key beyond which the key is cut into blocks.
BLOCK = 8192
#: Parts that the fingerprints under a hot key are dealt to while its blocks are looked up.
SALTS = 64
#: Group size up to which all its pairs are compared by shifting the whole batch.
SMALL = 16


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of a text's 3-word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: 1 - WORDS].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in b.column(1).cast(pa.large_binary())], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row of docs; fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_fingerprint_batches, f"id {kind}, fp bigint")


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, own): the four keys of each fingerprint, and those that it looks under."""
    one, low = np.uint64(1), np.uint64((1 << SEGMENT_BITS) - 1)
    bits = one << np.arange(SEGMENT_BITS, dtype=np.uint64)
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            fp = whole.slice(at, 20_000).column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, fps, own = [], [], []
            for i in range(SEGMENTS):
                here = (fp >> np.uint64(SEGMENT_BITS * i)) & low
                after = (fp >> np.uint64(SEGMENT_BITS * ((i + 1) % SEGMENTS))) & low
                key = np.uint64(i << 32) | here << np.uint64(SEGMENT_BITS) | after
                clear = (after[:, None] & bits) == 0
                keys += [key, (key[:, None] | bits)[clear]]
                fps += [fp, np.broadcast_to(fp[:, None], clear.shape)[clear]]
                own += [np.ones(len(fp), bool), np.zeros(int(clear.sum()), bool)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(own))],
                names=["key", "fp", "own"],
            )


def _linked(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether differences x pass the chain from segment i and the full distance."""
    low = np.uint64((1 << SEGMENT_BITS) - 1)
    count = np.zeros(x.shape, np.uint8)
    ok = np.ones(x.shape, bool)
    for k, most in enumerate(BUDGET[:-1]):
        part = (x >> (((i + np.uint64(k)) % np.uint64(SEGMENTS)) * np.uint64(SEGMENT_BITS))) & low
        count = count + np.bitwise_count(part)
        ok &= count <= most
    return ok & (np.bitwise_count(x) <= DISTANCE)


def _forest(fp: np.ndarray, own: np.ndarray, side: np.ndarray, i: int, cross: bool) -> list[tuple[int, int]]:
    """Links of one large group that make it as connected as all its links do."""
    label, out = np.arange(len(fp)), []
    rows = np.flatnonzero(side == 0) if cross else np.arange(len(fp))
    far = np.flatnonzero(side == 1) if cross else None
    at = np.uint64(i)
    for r in rows:
        j = far if cross else np.arange(r + 1, len(fp))
        if not own[r]:
            j = j[own[j]]
        j = j[_linked(fp[j] ^ fp[r], np.full(len(j), at))]
        if not len(j):
            continue
        labels, first = np.unique(label[j], return_index=True)
        new = labels != label[r]
        if new.any():
            out += [(int(fp[r]), int(fp[q])) for q in j[first[new]]]
            label[np.isin(label, labels)] = label[r]
    return out


def _link_groups(t: pa.Table) -> pa.RecordBatch | None:
    """Links within the groups (key, a, b) of a sorted table of whole groups."""
    col = lambda c: t.column(c).to_numpy()
    key, fp, own, a, b, blk = col("key"), col("fp").view(np.uint64), col("own"), col("a"), col("b"), col("blk")
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    group = np.repeat(np.arange(len(start)), size)
    u, v = [], []
    small = np.repeat(size <= SMALL, size)
    for s in range(1, SMALL):
        p = np.flatnonzero((group[s:] == group[:-s]) & small[s:] & (own[s:] | own[:-s]) & ((a[s:] == b[s:]) | (blk[s:] != blk[:-s])))
        if not len(p) and not (group[s:] == group[:-s]).any():
            break
        p = p[_linked(fp[p] ^ fp[p + s], (key[p] >> 32).astype(np.uint64))]
        u.append(fp[p])
        v.append(fp[p + s])
    for g in np.flatnonzero(size > SMALL):
        at = slice(start[g], start[g] + size[g])
        k = start[g]
        got = _forest(fp[at], own[at], (blk[at] != a[at]).astype(np.int8), int(key[k] >> 32), a[k] != b[k])
        if got:
            e = np.array(got, dtype=np.uint64)
            u.append(e[:, 0])
            v.append(e[:, 1])
    if not u or not sum(map(len, u)):
        return None
    uv = [np.concatenate(x).view(np.int64) for x in (u, v)]
    return pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], names=["u", "v"])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted stream between groups, so that at most one group and a batch are held."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        last = tuple(held.column(c)[held.num_rows - 1].as_py() for c in ("key", "a", "b"))
        same = np.ones(held.num_rows, bool)
        for c, x in zip(("key", "a", "b"), last, strict=True):
            same &= held.column(c).to_numpy() == x
        cut = held.num_rows - int(same.sum())
        if cut:
            if (out := _link_groups(held.slice(0, cut))) is not None:
                yield out
            held = held.slice(cut)
    if held is not None and held.num_rows and (out := _link_groups(held)) is not None:
        yield out


def links(fps: DataFrame) -> DataFrame:
    """fps(fp), each once -> (u, v): links at distance 3 or less, enough to connect all that are."""
    prefix = F.shiftright("key", SEGMENT_BITS)
    filed = fps.select("fp").mapInArrow(_filed, "key bigint, fp bigint, own boolean")
    segments = fps.select(F.explode(F.array(*[F.expr(f"{i}L << {SEGMENT_BITS} | (shiftrightunsigned(fp, {SEGMENT_BITS * i}) & {(1 << SEGMENT_BITS) - 1})") for i in range(SEGMENTS)])).alias("prefix"))
    # At most SEGMENTS * 2^16 prefixes exist, however many fingerprints there are.
    hot = stash(segments.groupBy("prefix").count().filter(F.col("count") > BLOCK).select("prefix"), "hot")
    one = filed.withColumns({"a": F.lit(0), "b": F.lit(0), "blk": F.lit(0)})
    if not hot.isEmpty():
        marked = filed.withColumn("prefix", prefix).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "prefix", "left")
        warm = marked.filter("hot").select("key", "fp", "own")
        keys = stash(warm.groupBy("key").count().filter(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n")), "keys")
        # A key's rows may be a third of all, so they are dealt to many tasks; the keys grow with the documents, so the join is a merge join.
        salts = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        cut = warm.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salts, ["key", "salt"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        cut = cut.withColumn("blk", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")).cast("int"))
        other = F.explode(F.expr("sequence(0, n - 1)")).alias("other")
        cut = cut.select("key", "fp", "own", "blk", other).select("key", "fp", "own", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"), "blk")
        cold = marked.filter("hot IS NULL").select("key", "fp", "own", *[F.lit(0).alias(c) for c in ("a", "b", "blk")])
        one = cut.union(cold)
    dealt = one.select("key", "fp", "own", "a", "b", "blk").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(_link_batches, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, fingerprint, component_id).

    component_id is the smallest id among the documents reachable by links, the
    document itself included. Null and wordless texts have fingerprint zero and
    link as any other; long texts are taken whole, their shingles' hashes held
    at once. A row repeated in docs is repeated in the result. Ids
    that are null count for no minimum: a component of null ids alone has
    component_id null. An empty table gives no rows; other columns of docs are
    ignored, whatever their names.
    """
    prints = stash(fingerprints(docs, id_col, text_col), "prints")
    fps = stash(prints.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    roots = stash(connected_components(links(fps)), "roots")
    named = roots.join(fps, roots["node"] == fps["fp"]).select("node", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    classes = stash(fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), text, "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component: one of each group.

    Of rows with the same id and text one stays. Null ids stay where no other
    document is linked. Columns are those of docs.
    """
    classes = near_duplicates(docs.select(id_col, text_col), id_col, text_col)
    kept = classes.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    kept = stash(kept, "kept")
    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return keep_ids(docs, kept, id_col)
    once = keep_ids(docs, kept.filter("n = 1"), id_col)
    return once.union(keep_ids(docs, repeated, id_col).dropDuplicates([id_col, text_col]))
