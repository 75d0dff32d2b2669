"""Exact top-k search by BM25 with block-max dynamic pruning over inverted postings.

Each shard of documents is a file with postings in order of (term, document),
in which documents of a commonest term and of like lengths stand together. A
query has a goal: the k-th best score that is known so far. As in block-max
WAND, a document is scored only if its bounds reach the goal:

1. Terms that cannot reach the goal together by their greatest impacts, the
   commonest ones, give no candidates; a shard whose terms cannot is skipped.
   The postings of the other terms are summed.
2. A candidate's bound is that sum and the greatest impacts of the remaining
   terms in its block. Those whose bound is below the goal go.
3. Remaining terms are added, the rarest first, while that reads less than the
   candidates themselves; the goal rises with the sums, and candidates go.
4. What is left is scored from its own terms, in the order of their spelling:
   equal documents have equal scores whatever shard they are in.

Document counts, average length and document frequencies are those of all
shards, so results merge exactly. A first pass over one shard gives each query
a goal. Then tasks take groups of shards and a few batches of queries, with one
goal for each query over all shards of the group, and give k rows at most for
each. A shard is read once for all batches of a task.
Documents with equal texts are one within a shard, and queries with equal terms
are one: a copy costs an id.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, text_or_empty, work_path

K1, B = 1.2, 0.75
TOP = 10
#: Documents in a block, as a power of 2; different texts (16 bits number them), their characters, and rows of a shard at most.
BLOCK_BITS, SHARD_DOCS, SHARD_CHARS, SHARD_ROWS = 6, 16_384, 32 << 20, 1_000_000
#: Queries in a batch, about; groups of shards at least, and shards of a group beyond which there are more groups; batches of a task at most.
QUERIES, GROUPS, GROUP_SHARDS, TASK_BATCHES = 512, 8, 1024, 4
#: Parts that the ids of queries with equal terms are dealt to.
SALTS = 16
#: Share of a goal that sums may miss, for rounding.
MARGIN = 1e-9

_TERM = re.compile(r"\w+")
_SHARD = pa.schema(
    [("terms", pa.list_(pa.string())), ("df", pa.list_(pa.uint32())), ("docs", pa.list_(pa.uint16())), ("counts", pa.list_(pa.uint32())), ("lengths", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))]
)


def terms_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return _TERM.findall(text.lower())


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class _Gathered:
    """Documents of a shard that is being made."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.known: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        self.first: list[str] = []
        self.lengths, self.sizes = array("q"), array("q")
        self.terms, self.counts = array("i"), array("I")
        self.chars = self.rows = 0

    def add(self, i: int, text: str) -> None:
        digest = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        at = self.known.setdefault(digest, len(self.ids))
        self.rows += 1
        if at < len(self.ids):
            self.ids[at].append(i)
            return
        c = Counter(terms_of(text))
        self.ids.append([i])
        self.first.append(c.most_common(1)[0][0] if c else "")
        self.lengths.append(c.total())
        self.sizes.append(len(c))
        self.terms.extend(map(self.number.__getitem__, c))
        self.counts.extend(c.values())
        self.chars += len(text)

    def table(self) -> pa.Table:
        n, vocabulary = len(self.ids), sorted(self.number)
        spelled = np.empty(len(vocabulary), np.int32)
        spelled[np.fromiter((self.number[t] for t in vocabulary), np.int64, len(vocabulary))] = np.arange(len(vocabulary), dtype=np.int32)
        order = sorted(range(n), key=lambda d: (self.first[d], self.lengths[d], self.ids[d][0]))
        place = np.empty(n, np.uint16)
        place[order] = np.arange(n, dtype=np.uint16)
        term = spelled[np.frombuffer(self.terms, np.int32)] if len(self.terms) else np.zeros(0, np.int32)
        docs = np.repeat(place, np.frombuffer(self.sizes, np.int64))
        by_doc = np.argsort(docs, kind="stable")
        at = by_doc[np.argsort(term[by_doc], kind="stable")]
        counts = np.frombuffer(self.counts, np.uint32)[at] if len(self.counts) else np.zeros(0, np.uint32)
        ids = [sorted(self.ids[d]) for d in order]
        columns = [
            vocabulary, np.bincount(term, minlength=len(vocabulary)).astype(np.uint32), docs[at], counts,
            np.frombuffer(self.lengths, np.int64)[order], np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.int64),
        ]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, f.type.value_type)) for c, f in zip(columns, _SHARD, strict=True)]
        return pa.Table.from_arrays(lists, schema=_SHARD)


def _written(folder: str, shard_docs: int, shard_chars: int):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)

        def put(g: _Gathered) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.shard"
            with files.open_output_stream(f"{root}/{name}") as out:
                pq.write_table(g.table(), out, compression="zstd", use_dictionary=False)
            copies = [len(x) for x in g.ids]
            tokens = sum(n * length for n, length in zip(copies, g.lengths, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([sum(copies)], pa.int64()), pa.array([tokens], pa.int64())], names=["path", "docs", "tokens"])

        held = _Gathered()
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py()
                if held.ids and (len(held.ids) >= shard_docs or held.chars + len(text) > shard_chars or held.rows >= SHARD_ROWS):
                    yield put(held)
                    held = _Gathered()
                held.add(i.as_py(), text)
        if held.ids:
            yield put(held)

    return write


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: (path, docs, tokens) for each shard.

    Null ids are not indexed; null texts have no terms. Shards lie in the folder
    that executors share; a task that is run again writes shards of its own, and
    only those that the index names are ever read. A very long text is a shard
    by itself.
    """
    folder = work_path(docs.sparkSession, "bm25-shards")
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return stash(rows.mapInArrow(_written(folder, SHARD_DOCS, SHARD_CHARS), "path string, docs bigint, tokens bigint"), "bm25-index")


def _load(path: str, columns: list[str] | None = None) -> dict[str, pa.Array]:
    folder, _, name = path.rpartition("/")
    files, root = _files(folder)
    with files.open_input_file(f"{root}/{name}") as f:
        table = pq.read_table(f, columns=columns)
    return {c: table.column(c).chunk(0).values for c in table.column_names}


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            x = _load(path, ["terms", "df", "docs", "copies"])
            df, docs, copies = x["df"].to_numpy().astype(np.int64), x["docs"].to_numpy(), x["copies"].to_numpy()
            if len(df):
                df = np.add.reduceat(copies[docs], np.cumsum(df) - df)
            for at in range(0, len(df), 100_000):
                yield pa.RecordBatch.from_arrays([x["terms"][at : at + 100_000], pa.array(df[at : at + 100_000])], names=["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            b = whole.slice(start, 500)
            got = [sorted(set(terms_of(t))) for t in b.column(1).to_pylist()]
            counts = np.array([len(g) for g in got])
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(got)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([t for g in got for t in g], pa.string())], names=["query", "term"])


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class _Shard:
    def __init__(self, path: str, mean: float, bits: int = BLOCK_BITS):
        x = _load(path)
        self.bits = bits
        self.terms = x["terms"]
        self.df = x["df"].to_numpy().astype(np.int64)
        self.docs, times, length = x["docs"].to_numpy(), x["counts"].to_numpy().astype(float), x["lengths"].to_numpy()
        self.ids, copies = x["ids"].to_numpy(), x["copies"].to_numpy()
        self.n = len(length)
        self.id_ends = np.cumsum(copies)
        self.id_starts = self.id_ends - copies
        self.start = np.cumsum(self.df) - self.df
        term = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)
        self.impact = times * (K1 + 1) / (times + (K1 * (1 - B + B * length / mean))[self.docs])
        # The greatest impact of each term in each block that has it, and in all.
        block = self.docs >> bits
        first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (block[1:] != block[:-1])])[: len(block)])
        self.block, self.blocks = block[first], (self.n >> bits) + 1
        self.block_most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.block_start = np.searchsorted(first, self.start)
        self.block_size = np.diff(np.append(self.block_start, len(first)))
        self.most = np.maximum.reduceat(self.block_most, self.block_start) if len(first) else np.zeros(0)
        self.number = np.zeros(len(self.df), np.int32)

    def ask(self, at: np.ndarray) -> None:
        """Takes these terms, of a batch of queries, as those that searches have: of documents' own terms only they are laid by document."""
        at = np.sort(at)
        self.number[at] = np.arange(len(at), dtype=np.int32)
        self.own_term = self.own_impact = None
        p = _flat(self.start[at], self.df[at])
        docs = self.docs[p]
        order = np.argsort(docs, kind="stable")
        # In order of the terms' spelling; a document's lie together.
        self.own_impact = self.impact[p[order]]
        self.own_term = np.repeat(np.arange(len(at), dtype=np.int32), self.df[at])[order]
        self.own_size = np.bincount(docs, minlength=self.n)
        self.own_start = np.cumsum(self.own_size) - self.own_size
        self.weight = np.zeros(len(at))

    def _sums(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        p, size = _flat(self.start[at], self.df[at]), self.df[at]
        return np.bincount(self.docs[p], self.impact[p] * np.repeat(w, size), self.n)

    def _block_bounds(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        p, size = _flat(self.block_start[at], self.block_size[at]), self.block_size[at]
        return np.bincount(self.block[p], self.block_most[p] * np.repeat(w, size), self.blocks)

    def search(self, at: np.ndarray, w: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores, from ``least`` on, of documents among which are this shard's k best of those; at are numbers of terms asked."""
        none = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-self.df[at], kind="stable")
        at, w = at[order], w[order]
        reach = np.cumsum(w * self.most[at])
        goal = least * (1 - MARGIN)
        if not len(at) or reach[-1] < goal:
            return none
        rest = int(np.searchsorted(reach, goal))
        left = lambda: reach[rest - 1] if rest else 0.0
        score = self._sums(at[rest:], w[rest:])
        docs = np.flatnonzero((score > 0) & (score + left() >= goal))

        def raised() -> float:
            s = score[docs]
            return max(goal, float(np.partition(s, len(s) - k)[len(s) - k]) * (1 - MARGIN)) if len(s) >= k else goal

        goal = raised()
        if rest and len(docs):
            docs = docs[score[docs] + self._block_bounds(at[:rest], w[:rest])[docs >> self.bits] >= goal]
        while rest and len(docs) and self.df[at[:rest]].sum() < self.own_size[docs].sum():
            part = min(rest - 1, int(np.searchsorted(reach, left() / 2)))
            score += self._sums(at[part:rest], w[part:rest])
            rest = part
            goal = raised()
            docs = docs[score[docs] + left() >= goal]
        docs = docs[score[docs] + left() >= goal]
        if not len(docs):
            return none
        number = self.number[at]
        self.weight[number] = w
        size = self.own_size[docs]
        p = _flat(self.own_start[docs], size)
        exact = np.add.reduceat(self.own_impact[p] * self.weight[self.own_term[p]], np.cumsum(size) - size)
        self.weight[number] = 0
        keep = np.flatnonzero(exact >= least * (1 - MARGIN))
        if len(keep) > k:
            keep = keep[exact[keep] >= np.partition(exact[keep], len(keep) - k)[len(keep) - k]]
        docs, exact = docs[keep], exact[keep]
        copies = np.minimum(self.id_ends[docs] - self.id_starts[docs], k)
        return self.ids[_flat(self.id_starts[docs], copies)], np.repeat(exact, copies)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, the smaller id first of equal scores."""
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


def _asked(path: str) -> tuple[list[bytes], np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A batch of queries: digests, goals, its terms once each, their weights, and for each query its part of the numbers of terms."""
    files, root = _files(path)
    got = pq.read_table(root, filesystem=files, columns=["digest", "terms", "weights", "goal"], partitioning=None).combine_chunks()
    if not got.num_rows:
        return [], np.zeros(0), pa.array([], pa.string()), np.zeros(0), np.zeros(0, np.int64), np.zeros(1, np.int64)
    lists = got.column("terms").chunk(0)
    coded = lists.flatten().dictionary_encode()
    number = coded.indices.to_numpy()
    weight = np.zeros(len(coded.dictionary))
    weight[number] = got.column("weights").chunk(0).flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return got.column("digest").to_pylist(), got.column("goal").to_numpy(), coded.dictionary, weight, number, ends


def _searched(queries: str, mean: float, k: int, bits: int):  # noqa: ANN202
    """Searches each row's shards (paths) for the queries of its batches."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for numbers, paths in zip(b.column("batches").to_pylist(), b.column("paths").to_pylist(), strict=True):
                asked = [_asked(f"{queries}/batch={n}") for n in numbers]
                best = [[(np.zeros(0, np.int64), np.zeros(0))] * len(digests) for digests, *_ in asked]
                least = [goals.copy() for _, goals, *_ in asked]
                for path in paths:
                    shard = None  # one at a time
                    shard = _Shard(path, mean, bits)
                    for (digests, _, terms, weight, number, ends), found, goal in zip(asked, best, least, strict=True):
                        place = pc.fill_null(pc.index_in(terms, value_set=shard.terms), -1).to_numpy().astype(np.int64)
                        shard.ask(place[place >= 0])
                        for q in range(len(digests)):
                            own = number[ends[q] : ends[q + 1]]
                            own = own[place[own] >= 0]
                            ids, scores = shard.search(place[own], weight[own], goal[q], k)
                            if len(ids):
                                found[q] = _best(np.concatenate([found[q][0], ids]), np.concatenate([found[q][1], scores]), k)
                                if len(found[q][0]) == k:
                                    goal[q] = max(goal[q], found[q][1][-1])
                for (digests, *_), found in zip(asked, best, strict=True):
                    n = [len(x[0]) for x in found]
                    if sum(n):
                        names = pa.array(digests, pa.binary()).take(pa.array(np.repeat(np.arange(len(n)), n)))
                        yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found]))], names=["digest", "doc_id", "score"])

    return search


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """The few rows, each in a task of its own, however little they say of the work behind them."""
    return rows.coalesce(1).repartition(n)


def _batches(df: DataFrame, n: int, label: str) -> str:
    path = work_path(df.sparkSession, label)
    batch = F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")
    df.withColumn("batch", batch).repartition(n, "batch").write.partitionBy("batch").parquet(path)
    return path


def search(index: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of the index for each row of queries.

    A query's terms are the distinct terms of its text. Scores are BM25's with
    statistics of the whole index; of equal scores the smaller id comes first,
    and an indexed row that is repeated takes several ranks. Documents without
    a term of the query are not found, so there may be fewer than k, and none
    for a query that is null, empty or has a null id. Of queries with the same
    id, the terms count together.
    """
    size = index.agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    shards, n, mean = size["shards"], size["docs"], size["tokens"] / max(1, size["docs"]) or 1.0
    df = _dealt(index.select("path"), max(1, shards)).mapInArrow(_frequencies, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    rows = queries.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    asked = rows.mapInArrow(_query_terms, "query bigint, term string").distinct()
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # Both sides of each join grow with the documents or with the queries, so all are merge joins at every size.
    listed = asked.join(df.hint("merge"), "term").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("w")))).alias("x"))
    digest = F.unhex(F.sha2(F.array_join("x.term", " "), 256))
    listed = stash(listed.select("query", digest.alias("digest"), F.col("x.term").alias("terms"), F.col("x.w").alias("weights")), "queries")
    once = listed.groupBy("digest").agg(F.any_value("terms").alias("terms"), F.any_value("weights").alias("weights"))
    asked_once = listed.select("digest").distinct().count()
    if not asked_once or not shards:
        return index.sparkSession.createDataFrame([], "query_id bigint, rank int, doc_id bigint, score double")
    batches = math.ceil(asked_once / QUERIES)
    schema = "digest binary, doc_id bigint, score double"
    each = F.explode(F.array(*[F.array(*map(F.lit, range(i, min(i + TASK_BATCHES, batches)))) for i in range(0, batches, TASK_BATCHES)])).alias("batches")

    # A shard for each batch gives a goal for each of its queries: the k-th best there.
    largest = index.orderBy(F.col("docs").desc(), "path").limit(batches).select("path")
    largest = [r["path"] for r in largest.collect()]  # at most one for each batch
    some = index.sparkSession.createDataFrame([([i], [largest[i % len(largest)]]) for i in range(batches)], "batches array<int>, paths array<string>")
    path = _batches(once.withColumn("goal", F.lit(0.0)), batches, "asked")
    first = _dealt(some, batches).mapInArrow(_searched(path, mean, k, BLOCK_BITS), schema).groupBy("digest").agg(F.min("score").alias("goal"), F.count(F.lit(1)).alias("n"))
    goal = F.when(F.col("n") >= k, F.col("goal")).otherwise(0.0)
    path = _batches(once.join(first.hint("merge"), "digest", "left").withColumn("goal", F.coalesce(goal, F.lit(0.0))).drop("n"), batches, "goals")

    groups = min(shards, max(GROUPS, math.ceil(shards / GROUP_SHARDS)))
    dealt = index.select("path", F.pmod(F.row_number().over(Window.orderBy("path")), F.lit(groups)).alias("group"))
    tasks = dealt.groupBy("group").agg(F.collect_list("path").alias("paths")).select("paths", each)
    found = stash(_dealt(tasks, groups * math.ceil(batches / TASK_BATCHES)).mapInArrow(_searched(path, mean, k, BLOCK_BITS), schema), "found")
    best = Window.partitionBy("digest").orderBy(F.col("score").desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    # Many queries may have the terms of one: their ids are dealt to SALTS parts, and its k rows go to each.
    ids = listed.select("query", "digest", F.pmod(F.xxhash64("query"), F.lit(SALTS)).cast("int").alias("salt"))
    ranked = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return ids.join(ranked.hint("merge"), ["digest", "salt"]).select(F.col("query").alias("query_id"), "rank", "doc_id", "score")


def is_query(id_col: str = "doc_id") -> Column:
    """The stated query set: rows whose id is divisible by 100."""
    return F.col(id_col) % 100 == 0
