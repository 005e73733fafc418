"""Line dedup: a sharded minimal perfect hash over distinct lines indexes fingerprints, counts and last holders.

Lines become hashes of 122 bits. Distinct ones are counted, with sums combined before the shuffle, and cut into shards by hash. A
shard's index is a minimal perfect hash (levels of bits; a key's place is the rank of its bit) and arrays in the order of those
places: a fingerprint of 32 bits, a count of 8 bits and, for lines that many documents hold, the largest doc_id that holds them.
Documents probe the arrays by hash alone; no line meets another. A shard that hot lines fill is probed in several shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, shared_dir, small_batches, staged
from .rolling import U, mix, range_hashes

#: Code points of a line that counts, and documents that make it common.
LEAST_POINTS, LEAST_DOCS = 20, 3
#: Lines of a shard at least; beyond the square of that, shards and their number grow with the root of the lines.
SHARD_LINES = 4096
#: Share of bits to keys in each level of the hash.
GAMMA = 1.5
#: Stands for a null doc_id, which is smaller than all others.
NO_ID = -(1 << 63)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Lines:
    """The lines of some texts: `doc`, raw ranges [start, end) in `data`, and for those long enough (`use`) the range of the key."""

    def __init__(self, parts: list[bytes], least: int = LEAST_POINTS):
        self.bytes = b"\n".join(parts) + b"\n" if parts else b""
        raw = np.frombuffer(self.bytes, dtype=np.uint8)
        self.end = np.flatnonzero(raw == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1]).astype(np.int64) if len(self.end) else self.end
        self.doc = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]) - 1, self.end) if parts else self.end
        edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # white space ends with words, so a line's words are its own
        a, b = np.searchsorted(first, self.start), np.searchsorted(first, self.end)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        some = np.flatnonzero(a < b)
        low, high = first[a[some]], last[b[some] - 1]
        long = points[high] - points[low] >= least
        self.use, self.low, self.high = some[long], low[long], high[long]
        self.data = _LOWER[raw]

    def keys(self, lane: int) -> np.ndarray:
        return range_hashes(self.data, self.low, self.high, lane)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)


def hashed(least: int):
    """(h, g, doc_id): the two hashes of each key of a document, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            lines = Lines(_texts(batch), least)
            h, g, doc = lines.keys(0), lines.keys(1), lines.doc[lines.use]
            order = np.lexsort((g, h, doc))
            h, g, doc = h[order], g[order], doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(g[new].view(np.int64)), pa.array(_ids(batch)[doc[new]])], ["h", "g", "doc_id"])

    return run


def _places(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h ^ mix(g + U((level + 1) * 0x9E3779B97F4A7C15 % 2**64))) % U(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct pairs (h, g): in each level, keys alone at their bit stay, the others go on."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits)

    @classmethod
    def of(cls, h: np.ndarray, g: np.ndarray) -> PerfectHash:
        rest, sizes, bits = np.arange(len(h)), [], []
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            at = _places(h[rest], g[rest], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool))

    def __call__(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Places 0 .. n - 1 of keys; any place or -1 of what is no key."""
        out, rest, base = np.full(len(h), -1, dtype=np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = base + _places(h[rest], g[rest], level, size)
            here = self.bits[at]
            out[rest[here]] = self.rank[at[here]] - 1
            rest, base = rest[~here], base + size
        return out


_INDEX = "shard long, n_keys long, pairs long, sizes array<int>, bits binary, fingerprints binary, counts binary, last binary"


def _unsigned(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().view(np.uint64)


def indexed(least: int):
    """A shard's row of the index from its distinct keys (h, g, n, last)."""

    def run(t: pa.Table) -> pa.Table:
        h, g, n, last = _unsigned(t, "h"), _unsigned(t, "g"), t.column("n").to_numpy(), t.column("last").to_numpy()
        f = PerfectHash.of(h, g)
        order = np.argsort(f(h, g))
        common = order[n[order] >= least]
        row = [t.column("shard")[0].as_py(), len(h), int(n.sum()), f.sizes, np.packbits(f.bits).tobytes(), g[order].astype("<u4").tobytes(), np.minimum(n[order], 255).astype(np.uint8).tobytes(), last[common].astype("<i8").tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _INDEX.split(", ")])

    return run


def index(lines: DataFrame, shards: int, least: int = LEAST_DOCS) -> DataFrame:
    """The index of `lines` (h, g, doc_id), one row for each shard; `least` may be 255 at most, where counts end."""
    if not 1 <= least <= 255:
        raise ValueError(f"a line is common from 1 to 255 documents on, not {least}")
    distinct = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).withColumn("shard", F.pmod("h", F.lit(shards)))
    return distinct.groupBy("shard").applyInArrow(indexed(least), _INDEX)


def probed(least: int):
    """(doc_id, h) of the probes that hit a common line which a larger doc_id holds too."""

    def run(probes: pa.Table, own: pa.Table) -> pa.Table:
        out = pa.schema([("doc_id", pa.int64()), ("h", pa.int64())])
        if not own.num_rows or not probes.num_rows:
            return out.empty_table()
        r = own.slice(0, 1).to_pylist()[0]
        f = PerfectHash(r["sizes"], np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=sum(r["sizes"])).astype(bool))
        prints, counts, last = np.frombuffer(r["fingerprints"], dtype="<u4"), np.frombuffer(r["counts"], dtype=np.uint8), np.frombuffer(r["last"], dtype="<i8")
        h, g, doc = _unsigned(probes, "h"), _unsigned(probes, "g"), probes.column("doc_id").to_numpy()
        at = f(h, g)
        known = np.flatnonzero(at >= 0)
        known = known[prints[at[known]] == g[known].astype(np.uint32)]
        known = known[counts[at[known]] >= least]
        rank = np.cumsum(counts >= least) - 1
        lost = known[doc[known] < last[rank[at[known]]]]
        return pa.table([pa.array(doc[lost]), pa.array(h[lost].view(np.int64))], schema=out)

    return run


def hits(lines: DataFrame, own: DataFrame, shards: int, share: int, least: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, h): the lines that documents lose. A shard's probes come in shares of about `share` rows by a hash of the document,
    each with a copy of the shard's arrays; the table of shards with several shares has no more rows than lines / `share`."""
    own = own.withColumn("shares", F.floor(F.col("pairs") / share).cast("int") + 1)
    full = own.where("shares > 1").select("shard", "shares")
    probes = lines.withColumn("shard", F.pmod("h", F.lit(shards))).join(F.broadcast(full), "shard", "left")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id", "g"), F.coalesce("shares", F.lit(1))).cast("int").alias("part"), "h", "g", "doc_id")
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return probes.groupBy("shard", "part").cogroup(own.groupBy("shard", "part")).applyInArrow(probed(least), "doc_id long, h long")


def cut(least: int, keep: bool):
    """Takes the lines whose hashes the last column has out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            parts, lost = _texts(batch), batch.column(batch.num_columns - 1).to_pylist()
            some = [k for k, x in enumerate(lost) if x]
            lines = Lines([parts[k] for k in some], least)
            key = np.zeros(len(lines.end), dtype=np.uint64)
            key[lines.use] = lines.keys(0)
            used = np.zeros(len(lines.end), dtype=bool)
            used[lines.use] = True
            edge = np.searchsorted(lines.doc, np.arange(len(some) + 1))
            n, dropped = [p.count(b"\n") + 1 for p in parts], [0] * len(parts)
            for j, k in enumerate(some):
                own = slice(edge[j], edge[j + 1])
                gone = used[own] & np.isin(key[own], np.array(lost[k], dtype=np.int64).view(np.uint64))
                dropped[k] = int(gone.sum())
                parts[k] = b"\n".join(lines.bytes[a:b] for a, b in zip(lines.start[own][~gone].tolist(), lines.end[own][~gone].tolist(), strict=True))
            own = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
            if keep:
                text = pa.array([p.decode() for p in parts], pa.string())
                rest = batch.schema.names[2:-1]
                yield pa.RecordBatch.from_arrays([*own, text, *(batch.column(c) for c in rest)], ["doc_id", "n_lines", "n_dropped", "text", *rest])
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array([hashlib.sha256(p).hexdigest() for p in parts])], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return run


def lost_lines(docs: DataFrame, least: int, points: int) -> DataFrame:
    """(id, lost): for each doc_id (NO_ID for null) the hashes of the keys that it loses."""
    spark = docs.sparkSession
    small_batches(spark)
    path = shared_dir(spark)
    docs.select("doc_id", "text").mapInArrow(hashed(points), "h long, g long, doc_id long").write.parquet(path)
    lines = spark.read.schema("h long, g long, doc_id long").parquet(path)
    size = max(SHARD_LINES, isqrt(lines.count()))
    shards = lines.count() // size + 1
    own = staged(index(lines, shards, least))
    return hits(lines, own, shards, 4 * size, least).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("h").alias("lost"))


def without_common_lines(docs: DataFrame, keep: bool = True, least: int = LEAST_DOCS, points: int = LEAST_POINTS) -> DataFrame:
    """Drops lines that `least` documents hold from all but the largest doc_id holding them.

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; keys of fewer than `points` code points stay.
    A text is split at \\n; null and empty texts are one empty line. Each row is a document, also where rows repeat a doc_id: all
    rows with the largest one keep their lines. A null doc_id is smaller than all others; where only rows without id hold a line,
    they keep it. A document that holds a line several times loses all of them, and a text all of whose lines go is empty.

    With `keep` the rows come back with their text without those lines, their other columns, n_lines (before) and n_dropped (in
    place of columns of those names); without it, doc_id, n_lines, n_dropped and kept_sha256. Empty tables give empty ones.
    """
    lost = lost_lines(docs, least, points)
    rest = [c for c in docs.columns if keep and c not in ("doc_id", "text", "n_lines", "n_dropped")]
    rows, last = docs.select("doc_id", "text", *rest), "lost" + "_" * max(len(c) for c in docs.columns)
    rows = rows.join(lost.hint("shuffle_hash"), F.coalesce(rows["doc_id"], F.lit(NO_ID)) == lost["id"], "left").select(rows["doc_id"], rows["text"], *[rows[c] for c in rest], lost["lost"].alias(last))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    if not keep:
        return rows.mapInArrow(cut(points, False), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return rows.mapInArrow(cut(points, True), "doc_id long, n_lines long, n_dropped long, text string" + "".join(f", `{c}` {kinds[c]}" for c in rest))
