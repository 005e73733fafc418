"""Ranked lexical search: windowed bucket scoring over an index in windows of documents.

Documents become vectors of (term number, count) over the terms of the searched items, are ordered by doc_id and cut into windows
of WINDOW documents. In a window postings are term by term; an item's terms scatter their shares into an array of the window's
size, the bitsets of the terms are joined by OR to say which places have been touched, and those are harvested into a heap of the
item's best. Heaps of all tasks are brought together in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, small_batches, staged, texts
from .decontaminate import words

#: Documents of a window: their scores take 64 KB.
WINDOW = 8192
#: Bytes of item texts that are searched at once; what goes to the tasks is a few times that.
BLOCK_BYTES = 8_000_000
#: A null doc_id ranks after all others of the same score.
_LAST = 1 << 63


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def item_terms(items: list[tuple]) -> tuple[list, list[np.ndarray], dict[bytes, int]]:
    """Item ids, their distinct term numbers, and the number of each term."""
    number: dict[bytes, int] = {}
    own: dict[object, set[int]] = {}
    for item, text in items:
        own.setdefault(item, set()).update(number.setdefault(w, len(number)) for w in words(text))
    return list(own), [np.array(sorted(v), dtype=np.int64) for v in own.values()], number


def vectors(number: dict[bytes, int]):
    """Per document: doc_id, n (all its terms), the numbers of the searched terms it holds and how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            n, terms, counts = [], [], []
            for t in texts(batch):
                w = words(t)
                held = [(number[k], c) for k, c in Counter(w).items() if k in number]
                n.append(len(w))
                terms.append(np.array([k for k, _ in held], dtype=np.int32).tobytes())
                counts.append(np.array([c for _, c in held], dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return run


def holders(size: int):
    """(term, df) of a task's documents, added up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int32), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held], pa.int64())], ["term", "df"])

    return run


class Postings:
    """One window's postings, term by term: places, shares of the score, and a bitset of the places for each term."""

    def __init__(self, n: np.ndarray, terms: list[bytes], counts: list[bytes], weights: np.ndarray, documents: int, length: int):
        size = np.array([len(t) // 4 for t in terms], dtype=np.int64)
        term = np.frombuffer(b"".join(terms), dtype=np.int32)
        tf = np.frombuffer(b"".join(counts), dtype=np.int32).astype(np.int64)
        m = 50 + (50 * n * documents) // max(1, length)
        place = np.repeat(np.arange(len(n), dtype=np.int32), size)
        share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[place]))
        use = np.flatnonzero(share)
        use = use[np.argsort(term[use], kind="stable")]
        self.place, self.share, term = place[use], share[use], term[use]
        self.width = len(n)
        edge = [*np.flatnonzero(np.diff(term, prepend=-1)).tolist(), len(term)]
        self.at = {int(term[a]): (a, b) for a, b in zip(edge, edge[1:], strict=False)}
        self.bits: dict[int, np.ndarray] = {}

    def bitset(self, term: int) -> np.ndarray:
        if term not in self.bits:
            a, b = self.at[term]
            held = np.zeros(self.width, dtype=bool)
            held[self.place[a:b]] = True
            self.bits[term] = np.packbits(held)
        return self.bits[term]

    def scores(self, own: list[int], into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Touched places and their scores; `into` is zero again afterwards."""
        held = [t for t in own if t in self.at]
        if not held:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        occupied = self.bitset(held[0]).copy()
        for t in held:
            a, b = self.at[t]
            into[self.place[a:b]] += self.share[a:b]  # a place comes once in a term's list
            occupied |= self.bitset(t)
        touched = np.flatnonzero(np.unpackbits(occupied, count=self.width))
        out = into[touched]
        into[touched] = 0
        return touched, out


def harvest(heap: list, ids: list, touched: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Puts the window's candidates into a heap of the k best (score, -doc_id)."""
    if len(heap) == k:  # equal scores may still win by their doc_id
        keep = scores >= heap[0][0]
        touched, scores = touched[keep], scores[keep]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        touched, scores = touched[keep], scores[keep]
    for p, s in zip(touched.tolist(), scores.tolist(), strict=True):
        entry = (s, -_LAST if ids[p] is None else -ids[p])
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def searcher(queries: list[list[int]], weights: np.ndarray, documents: int, length: int, k: int, window: int):
    """A partition's best k for each query; rows come in ascending doc_id, `window` of them at a time."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        carry: list = []
        have = 0
        for batch in batches:
            carry.append(batch)
            have += batch.num_rows
            while have >= window:
                t = pa.Table.from_batches(carry)
                yield t.slice(0, window)
                carry, have = t.slice(window).to_batches(), have - window
        if have:
            yield pa.Table.from_batches(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in queries]
        into = np.zeros(window, dtype=np.int64)
        for t in windows(batches):
            ids = t.column("doc_id").to_pylist()
            p = Postings(t.column("n").to_numpy(), t.column("terms").to_pylist(), t.column("counts").to_pylist(), weights, documents, length)
            for heap, own in zip(heaps, queries, strict=True):
                harvest(heap, ids, *p.scores(own, into), k)
        rows = [(q, None if i == -_LAST else -i, s) for q, heap in enumerate(heaps) for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

    return run


def blocks(items: DataFrame, most: int) -> list[DataFrame]:
    """The items in blocks of about `most` bytes of text, by a hash of their id: each is searched by itself."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // most) + 1
    return [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) for b in range(n)] if n > 1 else [rows]


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, window: int = WINDOW, most: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best rows of `docs` with a score above 0.

    Terms are maximal runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. A term that N documents with any
    term hold df times has the weight floor(1000 ln((2N + 2) / (2 df + 1))); a document with n of all L terms scores the sum, over
    the item's distinct terms, of weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L. Null and empty texts have no
    terms and match nothing. Rows that repeat a doc_id rank each by itself; a null doc_id takes part and comes last among equal
    scores. An item's terms are those of all its rows; items without id, text or terms give no rows, nor do empty tables. Items are
    searched in blocks of bounded text, each against all documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for block in blocks(items, most):
        names, own, number = item_terms([tuple(r) for r in block.collect()])
        index = staged(docs.select("doc_id", "text").mapInArrow(vectors(number), "doc_id long, n long, terms binary, counts binary"))
        documents, length = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(number), dtype=np.int64)
        for term, n in index.select("terms").mapInArrow(holders(len(number)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():
            df[term] = n  # one number for each searched term
        weights = np.array([weight(documents, n) for n in df.tolist()], dtype=np.int64)
        queries = [t[np.argsort(df[t], kind="stable")].tolist() for t in own]
        rows = index.where("n > 0").repartitionByRange("doc_id", F.xxhash64("terms", "counts")).sortWithinPartitions("doc_id")
        found = rows.mapInArrow(searcher(queries, weights, documents, length, k, window), "item int, doc_id long, score long")
        best = _best(found, k)
        named = spark.createDataFrame(list(enumerate(names)), block.select(F.lit(0).alias("item"), "item_id").schema)
        best = best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def _best(found: DataFrame, k: int, shares: int = 32) -> DataFrame:
    """The k best of each item: of the heaps' rows in `shares` shares first, so that many tasks' heaps don't meet in one."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares)))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("share")
