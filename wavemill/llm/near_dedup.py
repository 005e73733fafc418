"""MinHash near-duplicates with sequential Bayesian verification of banded candidates.

Documents become sets of 5-word shingles. One representative stands for equal sets. Signatures of 8-bit minima are cut into
bands; representatives that share a band are candidates. Inside a band bucket signatures are compared batch by batch, and a
pair goes as soon as the posterior probability of reaching the threshold falls under the chosen miss probability. What
survives links buckets into canopies, whose sets are compared exactly. No pairs are emitted: every task returns a spanning
forest of what it has linked.

A bucket or canopy beyond a size is dealt out in blocks, each of which also gets the group's leaders. Rows that this links to the
group's main tree need not meet each other; only the rest is compared with all blocks. So a large group of near copies costs its
rows times the block size, and what stays quadratic is the number of rows that belong to a group and yet not to its main tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, components, lean, small_batches, staged, texts, together, whole_groups
from .rolling import U, mix, range_hashes

WIDTH = 5
BANDS, ROWS = 48, 8
HASHES = BANDS * ROWS
BATCH = 48
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 2_000_000
#: Rows of a large group that all its blocks get.
LEADERS = 8
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | U(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z lower-cased."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    return range_hashes(data, start, end)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than the width make one shingle, none make none."""
    w = word_hashes(text)
    if not len(w):
        return w
    take = min(width, len(w))
    h = np.zeros(len(w) - take + 1, dtype=np.uint64)
    for k in range(take):
        h = mix(h * U(0x9DDFEA08EB382D69) + w[k : len(w) - take + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> bytes:
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 256):
        np.minimum(low, (s[at : at + 256, None] * _A + _B).min(axis=0), out=low)
    return (mix(low) >> U(56)).astype(np.uint8).tobytes()


def set_key(s: np.ndarray) -> bytes | None:
    """What equal sets share: two sums over their hashes and their size."""
    return np.array([s.sum(), mix(s).sum()], dtype=np.uint64).tobytes() + len(s).to_bytes(4, "little") if len(s) else None


@lean
def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        n, keys, sigs = [], [], []
        for text in texts(batch):
            s = shingles(text)
            n.append(len(s))
            keys.append(set_key(s))
            sigs.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])


@lean
def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of texts: eight bytes a shingle."""
    for batch in by_bytes(batches, 2 << 20):
        sets = [shingles(t) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "shingles"])


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of batches, the fewest matches that keep a pair.

    The similarity has a uniform prior, so after m matches in n it is Beta(m + 1, n - m + 1), and the chance that it
    reaches t is the binomial sum P(X <= m) for n + 1 draws of t. Chance agreement of 8-bit values only adds matches.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        for i in range(n + 2):
            total += np.exp(lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 2 - i) + i * log(threshold) + (n + 1 - i) * log(1 - threshold))
            if total >= miss:
                m = i
                break
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the rows of two signature blocks that no batch has pruned."""
    a = b = None
    got = None
    for k, m in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        if a is None:
            got = np.zeros((len(left), len(right)), dtype=np.int32)
            for c in range(cut.start, cut.stop):
                got += left[:, c, None] == right[None, :, c]
            a, b = np.nonzero(got >= m)
            got = got[a, b]
        else:
            keep_a, keep_b, keep_got = [], [], []
            for at in range(0, len(a), 1 << 16):
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                g = got[at : at + (1 << 16)] + (left[x, cut] == right[y, cut]).sum(axis=1)
                ok = g >= m
                keep_a.append(x[ok]), keep_b.append(y[ok]), keep_got.append(g[ok])
            a, b, got = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (keep_a, keep_b, keep_got))
    return a, b


class Forest:
    """Union-find over row numbers, the smallest on top; keeps the links that joined something."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, x: int, y: int) -> None:
        p, q = self.top(x), self.top(y)
        if p != q:
            self.up[max(p, q)] = min(p, q)
            self.links.append((x, y))


def _rows(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _sigs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)


def _edges(ids: np.ndarray, links: list) -> pa.RecordBatch:
    x = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[x[:, 0]], pa.int64()), pa.array(ids[x[:, 1]], pa.int64())], ["u", "v"])


def tiles(table: pa.Table, start: int, end: int, sig: np.ndarray, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving row pairs of one group: of all its rows, or of the rest (side 0) with the others where it has two sides."""
    side = _rows(table.slice(start, end - start), "side")
    one = bool(len(side)) and (side == side[0]).all()
    x, y = (np.arange(start, end),) * 2 if one else (start + np.flatnonzero(side == 0), start + np.flatnonzero(side == 1))
    if one and side[0] == 1:
        return
    for at in range(0, len(x), 256):
        for to in range(at if one else 0, len(y), 1024):
            a, b = survivors(sig[x[at : at + 256]], sig[y[to : to + 1024]], least)
            yield x[at + a], y[to + b]


GROUP = ["group", "i", "j"]


def link_buckets(least: list[int]):
    small = 12

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, GROUP):
            ids, sig, forest = _rows(table, "id"), _sigs(table), Forest(table.num_rows)
            size = np.diff(cuts)
            tiny = size <= small  # the pairs of all small groups at once
            left = np.repeat(cuts[1:], size) - np.arange(table.num_rows)
            left[np.repeat(~tiny, size)] = 0
            for step in range(1, small):
                p = np.flatnonzero(left > step)
                for k, m in enumerate(least):
                    cut = slice(0, (k + 1) * BATCH)
                    p = p[(sig[p, cut] == sig[p + step, cut]).sum(axis=1) >= m]
                for x in p.tolist():
                    forest.link(x, x + step)
            for g in np.flatnonzero(~tiny):
                for x, y in tiles(table, cuts[g], cuts[g + 1], sig, least):
                    for p, q in zip(x.tolist(), y.tolist(), strict=True):
                        forest.link(p, q)
            yield _edges(ids, forest.links)

    return run


def link_canopies(least: list[int], percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, GROUP):
            ids, sig, forest = _rows(table, "id"), _sigs(table), Forest(table.num_rows)
            sets = [np.frombuffer(b, dtype=np.uint64) for b in table.column("shingles").to_pylist()]
            for g in range(len(cuts) - 1):
                for x, y in tiles(table, cuts[g], cuts[g + 1], sig, least):
                    for p, q in zip(x.tolist(), y.tolist(), strict=True):
                        if forest.top(p) != forest.top(q):
                            m, n = len(sets[p]), len(sets[q])
                            if 100 * min(m, n) >= percent * max(m, n):
                                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                                if 100 * both >= percent * (m + n - both):
                                    forest.link(p, q)
            yield _edges(ids, forest.links)

    return run


def linked(members: DataFrame, payload: DataFrame, linker) -> DataFrame:
    """Forest links (u, v) of groups: `members` has group, id and blocks, `payload` what `linker` needs of an id."""
    where = lambda b: F.pmod(F.xxhash64("id"), b).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    def compared(rows: DataFrame) -> DataFrame:
        return together(rows.join(payload, "id"), GROUP, [*GROUP, "side", "id"]).mapInArrow(linker, "u long, v long")

    one, none = F.lit(0), F.lit(0).alias("side")
    rows = members.select("group", "id", where(F.col("blocks")).alias("i"), one.alias("j"), none)
    large = staged(members.where("blocks > 1"))
    if not large.limit(1).count():
        return compared(rows)
    first = large.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy("id"))).where(F.col("r") <= LEADERS)
    lead = first.select("group", "id", each("blocks").alias("i"), one.alias("j"), none)
    links = staged(compared(rows.unionByName(lead)))
    tree = components(links)
    top = F.coalesce("component", "id").alias("top")
    main = first.where("r = 1").join(tree, "id", "left").select("group", top.alias("main"))
    rest = large.join(tree, "id", "left").select("group", "id", top).join(main, "group").where("top <> main").select("group", "id")
    rest = staged(rest)
    turns = rest.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("turns"))
    sizes = large.select("group", "blocks").distinct().join(turns, "group")
    left = rest.join(sizes, "group").select("group", "id", where(F.col("turns")).alias("i"), each("blocks").alias("j"), none)
    right = large.select("group", "id").join(sizes, "group").select("group", "id", each("turns").alias("i"), where(F.col("blocks")).alias("j"), F.lit(1).alias("side"))
    return links.unionByName(compared(left.unionByName(right)))


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of `docs` (doc_id, text, ...).

    Links pairs of sets with 100 * intersection >= percent * union. Null or blank texts have no shingles and stand alone; equal
    sets share a component, whose id is its smallest doc_id. Rows that repeat a doc_id count each by its own text. A null doc_id
    stands alone with a null component and is kept. Other columns are ignored. `miss` is the chance at each batch to lose a
    pair. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    least = least_matches(percent / 100, miss)
    plain = docs.select("doc_id", "text")
    sets = staged(plain.mapInArrow(sketched, "doc_id long, n_shingles long, set_key binary, sig binary"))
    known = sets.where("set_key is not null and doc_id is not null")
    same = known.groupBy("set_key").agg(F.min("doc_id").alias("low"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    same = staged(same.withColumn("id", F.monotonically_increasing_id()))
    keys = F.explode(F.array(*[F.xxhash64(F.lit(b), F.expr(f"substring(sig, {b * ROWS + 1}, {ROWS})")) for b in range(BANDS)]))
    bands = same.select(keys.alias("group"), "id")
    counts = bands.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    counts = counts.select("group", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    forest = linked(bands.join(counts, "group"), same.select("id", "sig"), link_buckets(least))
    canopies = staged(components(forest).withColumnRenamed("component", "group"))
    facts = same.join(canopies, "id")
    wide = facts.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    wide = wide.select("group", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("n") / BLOCK_SHINGLES)).alias("blocks"))
    source = plain.join(facts.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi")
    source = source.mapInArrow(whole_sets, "set_key binary, shingles binary").dropDuplicates(["set_key"])
    payload = staged(facts.join(source, "set_key").select("id", "sig", "shingles"))
    links = linked(canopies.join(wide, "group"), payload, link_canopies(least, percent))
    tree = same.select("id", "set_key", "low").join(components(links), "id")
    roots = tree.join(tree.groupBy("component").agg(F.min("low").alias("root")), "component").select("set_key", "root")
    rep = same.select("set_key", "low").join(roots, "set_key", "left").select("set_key", F.coalesce("root", "low").alias("root"))
    out = sets.drop("sig").join(rep, "set_key", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """The rows of `docs` whose doc_id heads its component; columns as given. Rows that repeat such a doc_id all stay."""
    heads = near_duplicates(docs, percent, miss).where("kept").select("doc_id").distinct()
    return docs.join(heads.where("doc_id is not null"), "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))
