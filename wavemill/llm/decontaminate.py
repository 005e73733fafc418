"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

Text becomes lower-cased ASCII letters, digits and non-ASCII characters with one space between words; each window of item
words is a pattern with a space on either side, so that matches begin and end with words. A text is scanned once; matches are
word ranges, whose byte offsets in the original text come from the same pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, lean, small_batches, texts

WINDOW = 10
#: Bytes of benchmark text in one automaton, which takes some hundred times that. A larger benchmark is several of them.
AUTOMATON_BYTES = 4_000_000
_FOLD = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as UTF-8."""
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if w]


def windows(text: str | None, width: int = WINDOW) -> set[bytes]:
    """Runs of `width` words; an item of fewer words, but not none, is one window."""
    w = words(text)
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def automaton(items: list[tuple], width: int = WINDOW):
    """Patterns ' w1 ... wn ' with their items and number of words."""
    owners: dict[bytes, list] = {}
    for item, text in items:
        for w in windows(text, width):
            owners.setdefault(w, []).append(item)
    out = ahocorasick.Automaton()
    for w, own in owners.items():
        key = " " + w.decode("utf-8", "surrogatepass") + " "
        out.add_word(key, (len(key), w.count(b" ") + 1, own))
    if owners:
        out.make_automaton()
    return out


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, maximal hit ranges of word numbers [a, b), and the items with windows here."""
    w = words(text)
    if not w or not len(machine):
        return len(w), [], set()
    line = " " + b" ".join(w).decode("utf-8", "surrogatepass") + " "
    ranges, items, ends = [], set(), None
    for last, (_, n, own) in machine.iter(line):
        if ends is None:
            ends = np.cumsum([len(x.decode("utf-8", "surrogatepass")) + 1 for x in w])
        b = int(np.searchsorted(ends, last)) + 1
        items.update(own)
        if ranges and b - n <= ranges[-1][1]:
            ranges[-1] = (min(ranges[-1][0], b - n), max(b, ranges[-1][1]))
        else:
            ranges.append((b - n, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return len(w), out, items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets [a, b) in the original UTF-8 text of ranges of word numbers."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], data.astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(start[a]), int(end[b - 1])) for a, b in ranges]


_SCHEMA = "doc_id long, key binary, n_words long, hits array<struct<a:int,b:int>>, spans array<struct<a:long,b:long>>, items array<string>"


def scanner(items: list[tuple], width: int, keyed: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, width)
        pair, wide = pa.struct([("a", pa.int32()), ("b", pa.int32())]), pa.struct([("a", pa.int64()), ("b", pa.int64())])
        for batch in by_bytes(batches):
            n, hits, spans, found, keys = [], [], [], [], []
            for t in texts(batch):
                k, r, own = scan(t, machine)
                n.append(k)
                hits.append([{"a": a, "b": b} for a, b in r])
                spans.append([{"a": a, "b": b} for a, b in original_spans(t, r)] if r else [])
                found.append(sorted(map(str, own)))
                keys.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if keyed else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pair)), pa.array(spans, pa.list_(wide)), pa.array(found, pa.list_(pa.string()))], ["doc_id", "key", "n_words", "hits", "spans", "items"])

    return run


def blocks(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The benchmark in blocks whose text is below `most` bytes on average, by a hash of the item: the bound of an automaton and
    of what goes to the tasks at once."""
    rows = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // most) + 1
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def scanned(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, hits (word ranges), spans (byte ranges in the original), items.

    Null text has no words; an empty benchmark hits nothing; items with null text or id are skipped; repeated items count once.
    Rows may repeat a doc_id or have none. Where the benchmark takes several automata, what they find in a text is brought
    together by (doc_id, digest of the text); a pair comes out as often as it is in `docs`, since equal rows have equal hits.
    """
    small_batches(docs.sparkSession)
    parts = blocks(benchmark, most)
    found = [docs.select("doc_id", "text").mapInArrow(scanner([tuple(r) for r in b.collect()], width, len(parts) > 1), _SCHEMA) for b in parts]
    out = found[0]
    for p in found[1:]:
        out = out.union(p)
    if len(parts) > 1:
        some = F.size("hits") > 0
        both = lambda c: F.flatten(F.collect_list(F.when(some, F.col(c))))
        out = out.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.array_sort(both("hits")).alias("hits"), F.array_sort(both("spans")).alias("spans"), F.array_distinct(both("items")).alias("items"), F.count("*").alias("n"))
        out = out.withColumn("n", F.explode(F.sequence(F.lit(1), (F.col("n") / len(parts)).cast("int"))))
    return out.select("doc_id", "n_words", "hits", "spans", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the byte spans of the hits in the original text."""
    s = scanned(docs, benchmark, width, most)
    # Ranges are sorted; each adds what lies beyond the furthest end so far.
    n_hit = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], x["b"]).alias("end")),
        lambda acc: acc["n"],
    )
    items = F.array_sort("items")
    return s.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def _without_hits(items: list[tuple], width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, width)
        for batch in by_bytes(batches):
            yield batch.filter(pa.array([not scan(t, machine)[1] for t in texts(batch)], pa.bool_()))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of `docs` without any hit, columns as given; one scan for each benchmark block, nothing shuffled."""
    small_batches(docs.sparkSession)
    for block in blocks(benchmark, most):
        docs = docs.mapInArrow(_without_hits([tuple(r) for r in block.collect()], width), docs.schema)
    return docs
