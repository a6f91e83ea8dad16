"""Ranked lexical search by WAND, document shard by document shard.

1. One pass over the texts leaves each document's number of terms and, of the terms that some query has, how often they occur. The
   corpus's counts (documents, terms, documents of each term) are sums over that table.
2. Every task walks its documents in shards of SHARD, in ascending order of id. A shard's postings carry their exact integer impacts, and
   each term its largest. For a query the terms' cursors are kept in order of their document; the first document where the largest
   impacts of the cursors so far add up to more than the query's k-th best score is the pivot. Cursors before it jump there, past
   documents that can't get into the heap, and only a pivot that they all reach is scored. Heaps go on from shard to shard.
3. The tasks' heaps, k documents a query at most, are merged.

No text and no posting is shuffled: a shard is what its task reads. Queries are a stated set: they reach the tasks in blocks of about
QUERY_CHARS characters, as many as there are, each block with a pass of its own. Documents are never cut, sampled or left out.

Edge cases: a null or empty text has no terms and is never ranked; rows that repeat a doc_id are ranked each; null ids come last among
equal scores, which otherwise go by ascending id; a query row without terms gets no rows, rows that repeat an item_id are ranked each;
very long texts are read alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.llm.text import Powers, Texts, U, item_hashes, not_alnum_table, owners, scan
from voxelgraph.storage import durable

#: Documents and postings of a shard, at most; characters of queries that travel together, about.
SHARD, POSTINGS, QUERY_CHARS = 16_384, 2_000_000, 8_000_000

#: What a document id that isn't there, or a cursor at its end, counts as.
LAST = (1 << 63) - 1

FIRST = itemgetter(0)

POSTED = "doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order: runs of letters, digits and all that isn't ASCII; A-Z in lower case."""
    t = Texts(pa.array([text], pa.string()), Powers()).lower()
    start, end, _ = t.words(not_alnum_table())
    raw = t.data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]


class Vocabulary:
    """Numbers of terms in a text. Hashes propose, the terms' bytes decide."""

    def __init__(self, terms: list[bytes]):
        whole = pa.array([b"".join(terms).decode()], pa.string())
        size = np.array([len(x) for x in terms], np.int64)
        end = np.cumsum(size)
        t = Texts(whole, Powers())
        h = item_hashes(t, end - size, end)
        self.order = np.argsort(h, kind="stable")
        self.hash, self.size, self.begin, self.data = h[self.order], size[self.order], (end - size)[self.order], t.data

    def find(self, t: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the items are terms, and which terms they are."""
        h = item_hashes(t, start, end)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero((self.hash[at] == h) & (self.size[at] == end - start))
        at = at[hit]
        live, place = np.ones(len(hit), bool), 0
        left = np.arange(len(hit))
        while len(left := left[self.size[at[left]] > place]):
            live[left] &= t.data[start[hit[left]] + place] == self.data[self.begin[at[left]] + place]
            place += 1
        return hit[live], self.order[at[live]]


def postings(docs: DataFrame, terms: list[bytes], id_col: str, text: str) -> DataFrame:
    """doc_id, n (terms in all), terms and counts (of those asked for), for every row."""

    def make():
        vocabulary = Vocabulary(terms) if terms else None

        def work(part, t):
            t = t.lower()
            start, end, first = t.words(not_alnum_table())
            if vocabulary is None:
                key, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                hit, which = vocabulary.find(t, start, end)
                key, many = np.unique(owners(first)[hit] * len(terms) + which, return_counts=True)
            off = pa.array(np.searchsorted(key, np.arange(t.n + 1) * max(1, len(terms))), pa.int32())
            asked, counts = (pa.ListArray.from_arrays(off, pa.array(c, pa.int32())) for c in (key % max(1, len(terms)), many))
            return part.column("_doc"), np.diff(first), asked, counts

        return work

    return scan(docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text).cast("string").alias("text")), make, POSTED)


class Search:
    """The heaps of a task: for each query the k best documents so far, over all shards it has seen."""

    def __init__(self, queries: list[list[tuple[int, int]]], weight: np.ndarray, documents: int, length: int, k: int):
        self.queries, self.weight, self.documents, self.length, self.k = queries, weight, documents, length, k
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in queries]
        self.seen = self.scored = 0

    def shard(self, doc: list[int], n: np.ndarray, off: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Documents in ascending order: ids, numbers of terms, and postings (those of document i are off[i] to off[i + 1])."""
        own, tf = owners(off), counts.astype(np.int64)
        m = 25 + (75 * n.astype(np.int64) * self.documents) // max(1, self.length)
        impact = self.weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[own]))
        order = np.argsort(terms, kind="stable")
        terms, own, impact = terms[order], own[order], impact[order]
        cut = np.flatnonzero(np.diff(terms, prepend=-1))
        lists = {int(terms[a]): (own[a:b].tolist() + [LAST], impact[a:b].tolist(), int(impact[a:b].max())) for a, b in zip(cut, np.append(cut[1:], len(terms)))}
        for query, heap in zip(self.queries, self.heaps):
            cursors = [[lists[t][0][0], times * lists[t][2], lists[t][0], lists[t][1], 0, times] for t, times in query if t in lists]
            self._walk(cursors, heap, doc)
        self.seen += len(doc)

    def _walk(self, cursors: list[list], heap: list[tuple[int, int, int]], doc: list[int]) -> None:
        """cursors: document, largest impact, documents, impacts, place, how often the query has the term."""
        k, floor = self.k, heap[0][0] if len(heap) == self.k else 0
        cursors.sort(key=FIRST)
        while True:
            bound = 0
            for c in cursors:
                bound += c[1]
                if bound > floor:
                    break
            else:
                return
            pivot = c[0]
            if pivot == LAST:
                return
            if cursors[0][0] == pivot:
                score = 0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    at = c[4]
                    score += c[5] * c[3][at]
                    c[4] = at = at + 1
                    c[0] = c[2][at]
                self.scored += 1
                if score > floor:  # of equal scores the smaller id came first
                    entry = (score, -self.seen - pivot, doc[pivot])
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heapreplace(heap, entry)
                    floor = heap[0][0] if len(heap) == k else 0
            else:
                for c in cursors:
                    if c[0] >= pivot:
                        break
                    c[4] = at = bisect_left(c[2], pivot, c[4])
                    c[0] = c[2][at]
            cursors.sort(key=FIRST)


def _searched(posted: DataFrame, queries: list[list[tuple[int, int]]], numbers: list[int], weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item, doc_id, score: each task's heaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, rows, size = Search(queries, weight, documents, length, k), [], 0, 0

        def settle():
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [t.column(c).combine_chunks() for c in ("terms", "counts")]
            off = np.concatenate([[0], np.cumsum(np.asarray(lists[0].value_lengths(), np.int64))])
            doc = [LAST if i is None else i for i in t.column("doc_id").to_pylist()]
            search.shard(doc, np.asarray(t.column("n")), off, *(np.asarray(x.flatten()) for x in lists))

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                rows, size = rows + part.num_rows, size + len(part.column("terms").flatten())
                if rows >= SHARD or size >= POSTINGS:
                    settle()
                    held, rows, size = [], 0, 0
        if held:
            settle()
        out = [(n, None if d == LAST else d, s) for n, heap in zip(numbers, search.heaps) for s, _, d in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["item", "doc_id", "score"])

    return posted.where("size(terms) > 0").sortWithinPartitions(F.asc_nulls_last("doc_id")).mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k documents that score highest above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out, base, totals = max(1, -(-chars // QUERY_CHARS)), [], 0, None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        number: dict[bytes, int] = {}
        queries = [[(number.setdefault(t, len(number)), n) for t, n in Counter(terms_of(r.text)).items()] for r in block]
        posted = durable(postings(docs, list(number), id_col, text))
        if totals is None:
            totals = posted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(max(1, len(number)))
        for r in posted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # as many rows as the block has terms
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * d + 1))) for d in df], np.int64)
        found = _searched(posted, queries, list(range(base, base + len(block))), weight, *totals, k)
        ids = spark.createDataFrame([(base + i, r.item_id) for i, r in enumerate(block)], "item long, item_id long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out.append(top.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
        base += len(block)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
