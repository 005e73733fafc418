"""Removal of repeated byte strings by prefix-free parsing.

Triggers are the smallest rolling hashes of 32-byte grams among the grams of a 100-byte string. They cut a text into phrases:
a phrase holds all 100-byte strings that have the same trigger, with the bytes that complete them, so that phrases overlap by
99 bytes and none is a proper prefix of another with the same trigger at the same offset. Where a string lies depends on its own
bytes only: equal strings are always at the same offset from equal triggers.

The dictionary has each distinct phrase once, with its first place in corpus order; the parse is the places of phrases, in corpus
order. One pass over the parse, sorted by phrase, gives the dictionary and removes phrases that came before. Dictionary phrases
whose trigger occurs in others too can share strings: their bytes are fetched once, and a suffix array over them (ranks of 8, 16,
32, 64 and 100 bytes by doubling) puts equal strings together; the parse orders those by their places in the corpus, and all but
the first go. As phrases overlap, no suffix has to be continued into the next phrase. Bytes decide which strings are equal. A
whole phrase, and a string of a trigger with very many phrases, is known by two 61-bit hashes at fixed points of a prime field.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, gathered, small_batches, staged, together, whole_groups
from .rolling import PART, Grams, Ranges, U, mix, range_hashes, sliding_min

LENGTH = 100
GRAM = 32
#: Phrases of one trigger that a task may hold.
HOT = 10_000
#: Phrases that a task remembers, to leave out repeats before the shuffle; and bytes of phrases sorted at once.
KNOWN, SORTED_BYTES = 2_000_000, 1 << 21
_PLACE = (1 << 20) - 1


def phrases(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(trigger hash, phrase hash, first start, number of starts) of each phrase of one text, in stretches of PART bytes.

    A phrase that a stretch's end cuts in two is two phrases; each start is in one, under the same trigger as anywhere else.
    """
    parts: list[tuple] = []
    for at in range(0, len(data) - length + 1, PART - 2 * length):
        part = data[at : at + PART - length - 1]
        grams = Grams(part).every(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & ~U(_PLACE)) | place, length - gram + 1)
        owner = (least & U(_PLACE)).astype(np.int64)[: PART - 2 * length]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(np.append(first, len(owner)))
        trigger, end = owner[first], first + count - 1 + length
        whole = [Ranges(part, lane).of(first, end) for lane in (0, 1)]
        d = mix(whole[0] ^ mix(whole[1] + (trigger - first).astype(np.uint64)))
        parts.append((grams[trigger], d, first + at, count))
    if not parts:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bytes(batch: pa.RecordBatch, name: str = "text") -> Iterator[np.ndarray]:
    for t in batch.column(batch.schema.get_field_index(name)).to_pylist():
        yield np.frombuffer((t or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Known:
    """Phrases met by a task with their earliest places. It only saves rows: what is forgotten meets again after the shuffle."""

    def __init__(self):
        self.key, self.doc, self.lo = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def later(self, key: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether a phrase was met at an earlier place, for distinct keys in ascending order."""
        if len(self.key) > KNOWN:
            self.__init__()
        spot = np.searchsorted(self.key, key)
        at = np.minimum(spot, max(0, len(self.key) - 1))
        met = self.key[at] == key if len(self.key) else np.zeros(len(key), dtype=bool)
        out = np.zeros(len(key), dtype=bool)
        out[met] = (self.doc[at[met]] < doc[met]) | ((self.doc[at[met]] == doc[met]) & (self.lo[at[met]] < lo[met]))
        lead = met & ~out  # earlier than what was known
        self.doc[at[lead]], self.lo[at[lead]] = doc[lead], lo[lead]
        new = ~met
        self.key, self.doc, self.lo = (np.insert(a, spot[new], b[new]) for a, b in ((self.key, key), (self.doc, doc), (self.lo, lo)))
        return out


def _runs(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts joined where one ends at the next, per document."""
    order = np.lexsort((lo, doc))
    doc, lo, n = doc[order], lo[order], n[order]
    cut = np.ones(len(doc), dtype=bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (lo[:-1] + n[:-1] != lo[1:])
    first = np.flatnonzero(cut)
    return doc[first], lo[first], np.add.reduceat(n, first) if len(first) else n[:0]


_ROWS = "t long, d long, doc_id long, lo long, n long, gone boolean"


def _rows(t, d, doc, lo, n, gone: bool) -> pa.RecordBatch:
    cols = [pa.array(np.asarray(x).view(np.int64), pa.int64()) for x in (t, d, doc, lo, n)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(lo), gone))], ["t", "d", "doc_id", "lo", "n", "gone"])


def phrase_rows(length: int, gram: int) -> Callable:
    """The parse: t, d, doc_id, lo, n of phrases. Those that certainly came before, by what the task has met, are runs that are
    gone, dealt out by document; so a phrase that is everywhere leaves a task a few times only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in gathered(batches):
            parts, docs = [], []
            for doc, data in zip(batch.column(0).to_pylist(), _bytes(batch), strict=True):
                p = phrases(data, length, gram)
                parts.append(p)
                docs.append(np.full(len(p[0]), doc, dtype=np.int64))
            if not parts:
                continue
            t, d, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, key = np.concatenate(docs), mix(t ^ mix(d))
            order = np.lexsort((lo, doc, key))
            t, d, lo, n, doc, key = (x[order] for x in (t, d, lo, n, doc, key))
            gone = ~_changes(key)
            first = np.flatnonzero(~gone)
            gone[first] = known.later(key[first], doc[first], lo[first])
            yield _rows(*(x[~gone] for x in (t, d, doc, lo, n)), False)
            if gone.any():
                run_doc, run_lo, run_n = _runs(doc[gone], lo[gone], n[gone])
                yield _rows(mix(run_doc.view(np.uint64)), np.zeros(len(run_doc), dtype=np.int64), run_doc, run_lo, run_n, True)

    return run


class Settler:
    """From rows sorted by (t, d, doc_id, lo): all but the first place of a (t, d) are gone; first places come back, as dictionary
    phrases, where their trigger t has others. One row has to be kept, whatever the group's size."""

    def __init__(self):
        self.last: tuple | None = None  # the phrase that a batch ended with, as (t, d, doc_id, lo, n)
        self.had = False  # whether its trigger had others before

    def push(self, t, d, doc, lo, n) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        new = _changes(t, d)
        if self.last is not None and self.last[:2] == (t[0], d[0]):
            new[0] = False
        if not new.all():
            yield _rows(*(x[~new] for x in (t, d, doc, lo, n)), True)
        lead = [x[new] for x in (t, d, doc, lo, n)]
        if self.last is not None:
            lead = [np.append(np.array([v], dtype=np.int64), x) for v, x in zip(self.last, lead, strict=True)]
        if not len(lead[0]):
            return
        same = lead[0][1:] == lead[0][:-1]
        shared = np.append(self.had if self.last is not None else False, same)
        shared[:-1] |= same
        out = shared[:-1]
        if out.any():
            yield _rows(*(x[:-1][out] for x in lead), False)
        self.last, self.had = tuple(int(x[-1]) for x in lead), bool(shared[-1])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.last is not None and self.had:
            yield _rows(*([np.array([v], dtype=np.int64) for v in self.last]), False)


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parse, sorted by (t, d, doc_id, lo), through a Settler; runs that are gone pass by."""
    book = Settler()
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(5)]
        gone = batch.column(5).to_numpy(zero_copy_only=False)
        if gone.any():
            yield _rows(*(x[gone] for x in cols), True)
        yield from book.push(*(x[~gone] for x in cols))
    yield from book.finish()


_PHRASES = pa.schema([("hot", pa.bool_()), ("t", pa.int64()), ("d", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("phrase", pa.binary())])
_FETCHED = "hot boolean, t long, d long, doc_id long, lo long, n long, phrase binary"


def with_bytes(length: int) -> Callable:
    """The listed phrases of a text with their bytes. Those of a hot trigger are cut up: a row for each string, with two hashes of
    it as its t and d, so that equal strings meet and the trigger's others don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2 << 20):
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for k in range(0, len(at), 20_000):
                    few = [(False, x["t"], 0, doc, x["lo"], x["n"], data[x["lo"] : x["lo"] + x["n"] + length - 1]) for x in at[k : k + 20_000] if not x["hot"]]
                    if few:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*few, strict=True), _PHRASES, strict=True)], schema=_PHRASES)
                many = [(x["lo"], x["n"]) for x in at if x["hot"]]
                if many:
                    lo, n = np.array(sorted(many), dtype=np.int64).T
                    start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    raw = np.frombuffer(data, dtype=np.uint8)
                    t, d = (range_hashes(raw, start, start + length, lane).view(np.int64) for lane in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), dtype=bool)), pa.array(t), pa.array(d), pa.array(np.full(len(t), doc)), pa.array(start), pa.array(np.ones(len(t), dtype=np.int64)), pa.nulls(len(t), pa.binary())], schema=_PHRASES)

    return run


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """For each place with `length` bytes from it on, the rank of those bytes among all such: the suffix array, up to `length`.

    Eight bytes are a number. From ranks of w bytes come those of up to 2 w, by the pair of ranks at a place and further on.
    """
    w = min(8, length)
    m = len(data) - w + 1
    if m <= 0 or len(data) < length:
        return np.zeros(0, dtype=np.int64)
    word = np.zeros(m, dtype=np.uint64)
    for k in range(w):
        word = (word << U(8)) | data[k : k + m]
    while True:
        order = np.argsort(word)
        step = np.append(0, np.cumsum(word[order[1:]] != word[order[:-1]]))
        rank = np.empty(len(word), dtype=np.int64)
        rank[order] = step
        if w == length:
            return rank
        more = min(w, length - w)
        word = (rank[: len(rank) - more].astype(np.uint64) << U(32)) | rank[more:].astype(np.uint64)
        w += more


def _places(table: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """Row, rank, doc_id and start of each suffix of the dictionary phrases of a table."""
    blob = np.frombuffer(b"".join(table.column("phrase").to_pylist()), dtype=np.uint8)
    n, doc, lo = (table.column(c).to_numpy() for c in ("n", "doc_id", "lo"))
    size = n + length - 1
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, ranks(blob, length)[begin[row] + inside], doc[row], lo[row] + inside


def _starts(doc: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    doc, lo, n = _runs(doc, p, np.ones(len(p), dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "lo", "n"])


def later_suffixes(length: int) -> Callable:
    """Runs of starts whose string an earlier one of the same trigger has. Rows are sorted by (hot, t, d, doc_id, lo): phrases go
    through a suffix array, whole triggers at a time; the strings of hot triggers, which are alone with their equals, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, done = Settler(), []

        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hot = batch.column(0)
                rows = batch.filter(hot)
                done.extend(book.push(*(rows.column(k).to_numpy() for k in range(1, 6))))
                rest = batch.filter(pa.compute.invert(hot))
                if rest.num_rows:
                    yield rest

        def later() -> Iterator[pa.RecordBatch]:
            for b in done:
                gone = b.filter(b.column(5))
                if gone.num_rows:
                    yield _starts(gone.column(2).to_numpy(), gone.column(3).to_numpy())
            done.clear()

        for table, cuts in whole_groups(plain(), ["t"], most=SORTED_BYTES):
            yield from later()
            row, rank, doc, p = _places(table, length)
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[row]
            order = np.lexsort((p, doc, rank, group))
            late = np.ones(len(order), dtype=bool)
            late[order[_changes(group[order], rank[order])]] = False
            yield _starts(doc[late], p[late])
        yield from later()

    return run


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cutter(length: int, keep: bool) -> Callable:
    """Cuts what the starts of a text cover; the remaining bytes come out if `keep`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            rows = []
            for doc, data, at in zip(batch.column(0).to_pylist(), _bytes(batch), batch.column(2).to_pylist(), strict=True):
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                for x in at or ():
                    edge[x["lo"]] += 1
                    edge[x["lo"] + x["n"] - 1 + length] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = data[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep else None))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.string()), pa.array(c[5], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, lo, n: runs of starts in `docs` (doc_id unique and not null, text) whose strings also start earlier."""
    parse = together(docs.mapInArrow(phrase_rows(length, gram), _ROWS), ["t"], ["t", "d", "doc_id", "lo"])
    rows = staged(parse.mapInArrow(settled, _ROWS))
    out = rows.where("gone").select("doc_id", "lo", "n")
    # A trigger with few phrases is settled in one task. The phrases of one with very many are cut up into their strings.
    book = rows.where("not gone").withColumn("hot", F.count("*").over(Window.partitionBy("t")) > HOT)
    per_doc = book.groupBy("doc_id").agg(F.collect_list(F.struct("t", "lo", "n", "hot")).alias("at"))
    found = docs.join(per_doc, "doc_id").select("doc_id", "text", "at").mapInArrow(with_bytes(length), _FETCHED)
    found = together(found, ["t"], ["hot", "t", "d", "doc_id", "lo"])
    return out.union(staged(found.mapInArrow(later_suffixes(length), "doc_id long, lo long, n long")))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with unique ids; where ids repeat or are null, numbers in their order, and the way back."""
    plain = docs.select("doc_id", "text")
    odd = plain.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return plain, None
    # Ranges of the sort follow each other, so the ids that Spark gives rows ascend with the order.
    ranked = staged(plain.sort(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("n", F.monotonically_increasing_id()))
    return ranked.select(F.col("n").alias("doc_id"), "text"), ranked.select("n", "doc_id")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if `keep`, the kept bytes.

    Each byte goes that a string of `length` bytes covers which also starts earlier (smaller doc_id, or earlier in the same
    document). Null text is empty. Rows that repeat a doc_id, or have none, count as separate documents, nulls first and
    then by text. Texts shorter than `length` stay; other columns are ignored. `gram` is below `length`, `length` at least 8.
    """
    small_batches(docs.sparkSession)
    plain, back = numbered(docs)
    spans = repeated_starts(plain, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("at"))
    out = plain.join(spans, "doc_id", "left").select("doc_id", "text", "at").mapInArrow(cutter(length, keep), _OUT)
    if back is not None:
        out = out.withColumnRenamed("doc_id", "n").join(back, "n").drop("n").select("doc_id", *out.columns[1:])
    return out if keep else out.drop("kept")
