"""Ranked lexical search: WAND per document shard, shard heaps merged.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Each document is
scanned once for a block of queries: its number of terms, and how often it holds each of the queries' terms, are written
as a table, from which the corpus counts are taken. Tasks read that table in shards of SHARD_ROWS documents and about
SHARD_POSTINGS postings at most, in each of which every query is searched by WAND: lists stand in the order of their next documents, the pivot is the first at which
the lists' maximum impacts sum to what the heap still takes, and all lists before it skip to the pivot's document. A
task's heaps go on from shard to shard, so later shards skip more; the k best of each heap are merged, first in
groups of heaps, then for each query.

A block holds at most BLOCK_CHARS characters of queries, whose terms and postings of one shard are what a task holds;
larger query sets are searched block by block.

Cases: null texts and texts without a term are no documents (they count nowhere); queries without a term, or with null
text, have no rows; repeated documents are documents of their own, whose rank among each other is arbitrary but unique;
repeated query rows share their id and are searched as one item each time; null ids come last among equal scores; equal
scores rank by ascending id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, materialize, per_worker, ship, slices

TOP, SHARD_ROWS, SHARD_POSTINGS, BLOCK_CHARS = 20, 16_384, 2_000_000, 1_000_000
#: Documents of a task, about, at least: a task gives k rows a query.
TASK_ROWS = 8_192
#: Documents whose scores open a shard's threshold; heaps that are merged at first.
SEEDS, HEAPS = 256, 64
#: Bytes that part terms become blanks, A-Z become a-z, all others stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_END = 1 << 62


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


class Queries:
    """A block of queries: numbers of their terms, and the terms of each with repeats."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.numbers, self.rows = ids, {}, []
        for text in texts:
            self.rows.append(dict(Counter(self.numbers.setdefault(t, len(self.numbers)) for t in terms(text))))


def block_postings(docs: DataFrame, make_queries: Callable[[], Queries], name: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), term, tf (arrays: the queries' terms that it holds) of the documents with a term."""

    def make():
        numbers = per_worker(("queries", name), make_queries).numbers
        known = numbers.get

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, n, found, times, ends = [], [], [], [], [0]
            for at, text in enumerate(batch.column("text").to_pylist()):
                words = terms(text)
                if not words:
                    continue
                counts = Counter(map(known, words))
                counts.pop(None, None)
                rows.append(at)
                n.append(len(words))
                found += counts.keys()
                times += counts.values()
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

        return step

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(source, make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, term array<int>, tf array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Posting lists of some documents, in ascending order of their ids, with impacts."""

    def __init__(self, ids: list, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        self.ids = [ids[i] for i in order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc, impact = np.repeat(place, sizes), weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))
        by_term = np.lexsort((doc, term))
        self.doc, self.impact = doc[by_term], impact[by_term]
        self.edges = np.searchsorted(term[by_term], np.arange(len(weights) + 1))
        self.lists: dict[int, tuple] = {}

    def posting(self, term: int) -> tuple | None:
        """(documents and an end mark, impacts, the largest impact, both as arrays) of a term; None if no document has an impact."""
        if term not in self.lists:
            part = slice(self.edges[term], self.edges[term + 1])
            doc, impact = self.doc[part], self.impact[part]
            self.lists[term] = (doc.tolist() + [_END], impact.tolist(), int(impact.max()), doc, impact) if len(doc) and impact.any() else None
        return self.lists[term]

    def opening(self, lists: list[tuple], times: list[int], k: int) -> int:
        """The k-th best score of some documents that hold the weightiest terms: no document below it counts."""
        some: list[np.ndarray] = []
        for i in sorted(range(len(lists)), key=lambda i: -times[i] * lists[i][2]):
            some.append(lists[i][3][:SEEDS])
            if sum(map(len, some)) >= SEEDS:
                break
        docs = np.unique(np.concatenate(some))
        if len(docs) < k:
            return 1
        score = np.zeros(len(docs), np.int64)
        for (_, _, _, own, impact), n in zip(lists, times, strict=True):
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            score += np.where(own[at] == docs, impact[at], 0) * n
        return max(1, int(np.partition(score, -k)[-k]))

    def search(self, query: dict[int, int], k: int, floor: int = 1) -> list[tuple[int, object]]:
        """(score, id) of the k best documents that score floor or more, the best of them in any order; equal scores by id."""
        found = [(p, n) for t, n in query.items() if (p := self.posting(t)) is not None]
        if not found:
            return []
        lists, times = [p for p, _ in found], [n for _, n in found]
        docs, impacts, most = [p[0] for p in lists], [p[1] for p in lists], [p[2] * n for p, n in found]
        need, heap = max(floor, self.opening(lists, times, k)), []
        at, now, order = [0] * len(lists), [d[0] for d in docs], list(range(len(lists)))
        order.sort(key=now.__getitem__)
        while True:
            reach = 0
            for pivot, j in enumerate(order):
                reach += most[j]
                if reach >= need:
                    break
            else:
                break  # all lists together can't beat the heap
            doc = now[j]
            if doc == _END:
                break
            if now[order[0]] == doc:
                score = 0
                for j in order:
                    if now[j] != doc:
                        break
                    score += times[j] * impacts[j][at[j]]
                    at[j] += 1
                    now[j] = docs[j][at[j]]
                if score >= need:
                    (heapq.heappushpop if len(heap) == k else heapq.heappush)(heap, (score, -doc))
                    if len(heap) == k:
                        need = max(need, heap[0][0] + 1)  # later documents lose ties
            else:
                for j in order[:pivot]:
                    if now[j] < doc:
                        at[j] = bisect_left(docs[j], doc, at[j])
                        now[j] = docs[j][at[j]]
            order.sort(key=now.__getitem__)
        return [(score, self.ids[-doc]) for score, doc in heap]


def _rank_key(hit: tuple[int, object]) -> tuple:
    score, doc = hit
    return (-score, doc is None, doc if doc is not None else 0)


def search_shards(postings: DataFrame, make_queries: Callable[[], Queries], name: str, n_docs: int, n_terms: int, df: dict[int, int], k: int) -> DataFrame:
    """item (place in the block), doc_id, score, heap: the k best of each task's shards."""
    id_type = postings.schema["doc_id"].dataType.simpleString()
    m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = per_worker(("queries", name), make_queries)
        weights = np.array([term_weight(n_docs, df.get(t, 0)) for t in range(len(queries.numbers))], np.int64)
        heaps: list[list] = [[] for _ in queries.rows]
        kept, rows, held, kind = [], 0, 0, pa.int64()

        def search() -> None:
            table = pa.Table.from_batches(kept).combine_chunks()
            term, tf = (table.column(c).combine_chunks() for c in ("term", "tf"))
            sizes = np.diff(term.offsets.to_numpy())
            shard = Shard(table.column("doc_id").to_pylist(), table.column("m").to_numpy(), sizes, term.flatten().to_numpy(), tf.flatten().to_numpy(), weights)
            for heap, query in zip(heaps, queries.rows, strict=True):
                if query:
                    heap += shard.search(query, k, heap[k - 1][0] if len(heap) >= k else 1)
                    heap.sort(key=_rank_key)
                    del heap[k:]

        for batch in slices(batches):
            kind = batch.schema.field("doc_id").type
            more = len(batch.column("term").flatten())
            if kept and (rows + batch.num_rows > SHARD_ROWS or held + more > SHARD_POSTINGS):
                search()
                kept, rows, held = [], 0, 0
            kept.append(batch)
            rows, held = rows + batch.num_rows, held + more
        if kept:
            search()
        hits = [(i, doc, score) for i, heap in enumerate(heaps) for score, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int32()), pa.array([h[1] for h in hits], kind), pa.array([h[2] for h in hits], pa.int64())], ["item", "doc_id", "score"])

    shards = postings.select("doc_id", m.alias("m"), "term", "tf").coalesce(max(1, n_docs // TASK_ROWS))
    found = shards.mapInArrow(run, f"item int, doc_id {id_type}, score long")
    return found.withColumn("heap", F.spark_partition_id() % HEAPS)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for each query."""
    spark, item_type = docs.sparkSession, queries.schema[item_col].dataType.simpleString()
    items = queries.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = max(1, math.ceil(chars / BLOCK_CHARS)), None
    for b in range(blocks):
        part = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items).toPandas()
        name, sent = uuid.uuid4().hex, ship(spark, (part["item_id"].tolist(), part["text"].tolist()))
        make = lambda sent=sent: Queries(*sent())
        postings = materialize(block_postings(docs, make, name, id_col, text_col), "postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        # a row for each of the block's terms at most
        df = {r["t"]: r["n"] for r in postings.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
        hits = search_shards(postings, make, name, n_docs, n_terms, df, k)
        best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        merged = best(best(hits, "item", "heap").drop("rank"), "item")
        names = spark.createDataFrame([(i, x) for i, x in enumerate(part["item_id"].tolist())], f"item int, item_id {item_type}")
        rows = merged.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long") if out is None else out
