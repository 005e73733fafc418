"""Maximum inner product search with score-aware anisotropic quantisation and four-bit tables.

Vectors go to the list of their nearest centre; what remains is quantised in sub-spaces of two dimensions with 16 centres
each, in units of its own length: dense and wide lists are told apart equally well. Errors along a vector change its large
inner products more than errors across it, so codes and codebooks minimise a loss that weighs the parallel part higher. A query
reads its best lists: tables of 16 entries per sub-space give approximate scores for all codes of a list. The best of them are
ranked again by exact inner products in double precision, and so is every vector that may be among the best by the length of its
code's error. Two codes share a byte, and their two tables are one of 256 entries. How many lists are read follows from sampled
queries of the table itself, whose true neighbours among all rows are known.

Lists are dealt out in parts of bounded size, and so are the queries that read a part: no task holds all of either. A query that
finds fewer vectors than it should in its lists reads all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Rows that centres, codebooks and the number of lists to read are fitted on, at most (in expectation).
FIT_ROWS = 20_000
SUB = 2
CENTRES = 16
#: Inner products above this share of a vector's length count as the large ones.
THRESHOLD = 0.2
#: Rows of a part of the search, on average.
PART_ROWS = 8_192
#: Queries that read a part in one task, on average.
QUERY_ROWS = 4_096
#: Rows of a part of a list that are ranked again for a query, and the share of a part if that is more.
RERANK, RERANK_SHARE = 64, 1 / 64
#: Standard deviations of a code's error in a score, within which a vector may still be among the best.
MARGIN = 3.0
#: Share of true neighbours in the lists that are read, on the sample; share of its own that a query may miss, and of queries that may miss more.
AIM, MISS, RARE = 0.97, 0.1, 0.02
#: Queries (in expectation) whose true neighbours among all rows say how many lists to read.
TRIED = 256


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def k_means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            s = np.bincount(at, x[:, d], k)
            c[n > 0, d] = s[n > 0] / n[n > 0]
    return c


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How much more an error along the vector counts than one across it."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def encode(r: np.ndarray, unit: np.ndarray, books: np.ndarray, weight: float, passes: int = 2) -> np.ndarray:
    """Codes of residuals r that minimise |e|^2 + (weight - 1) (e . unit)^2, one sub-space after the other."""
    subs = len(books)
    rs, us = r.reshape(len(r), subs, SUB), unit.reshape(len(r), subs, SUB)
    codes = np.zeros((len(r), subs), dtype=np.uint8)
    along = np.zeros((len(r), subs))
    for p in range(passes):
        for s in range(subs):
            e = rs[:, s, None, :] - books[s][None]
            part = (e * us[:, s, None, :]).sum(axis=2)
            rest = along.sum(axis=1) - along[:, s] if p or s else np.zeros(len(r))
            codes[:, s] = ((e * e).sum(axis=2) + (weight - 1) * (rest[:, None] + part) ** 2).argmin(axis=1)
            along[:, s] = part[np.arange(len(r)), codes[:, s]]
    return codes


def codebooks(r: np.ndarray, unit: np.ndarray, weight: float, rng, rounds: int = 5) -> np.ndarray:
    """Centres per sub-space that minimise the same loss, by turns of encoding and weighted least squares."""
    subs = r.shape[1] // SUB
    rs, us = r.reshape(len(r), subs, SUB), unit.reshape(len(r), subs, SUB)
    books = np.stack([k_means(rs[:, s], CENTRES, rng, 6) for s in range(subs)])
    for _ in range(rounds):
        codes = encode(r, unit, books, weight, 1)
        e = rs - books[np.arange(subs), codes]
        along = (e * us).sum(axis=2)
        rest = along.sum(axis=1, keepdims=True) - along
        for s in range(subs):
            u, v = us[:, s], rs[:, s]
            target = v + (weight - 1) * ((v * u).sum(axis=1) + rest[:, s])[:, None] * u
            for k in range(CENTRES):
                m = codes[:, s] == k
                if m.any():
                    a = m.sum() * np.eye(SUB) + (weight - 1) * u[m].T @ u[m]
                    books[s, k] = np.linalg.solve(a, target[m].sum(axis=0))
    return books


class Index:
    """Centres, codebooks and the number of lists a query reads; its size doesn't grow with the rows."""

    def __init__(self, x: np.ndarray, rows: int, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim = x.shape[1]
        self.pad = -self.dim % SUB
        x = self.padded(x)
        self.lists = int(max(1, min(round(np.sqrt(rows) / 2), max(1024, len(x) // 8), len(x))))
        self.centres = k_means(x, self.lists, rng)
        r, unit, _ = self._residuals(x)
        self.weight = parallel_weight(self.dim)
        self.books = codebooks(r, unit, self.weight, rng)
        self.probes = self._probes(x, k, rng)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(np.asarray(x, dtype=np.float64), ((0, 0), (0, self.pad)))

    def _residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What remains of each vector, scaled to length 1, the vector's direction, and the length of what remains."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        r = x - self.centres[_nearest(x, self.centres)]
        length = np.linalg.norm(r, axis=1)
        return r / np.maximum(length, 1e-300)[:, None], unit, length

    def _probes(self, x: np.ndarray, k: int, rng) -> int:
        """The fewest lists that hold AIM of the true neighbours of sampled queries."""
        q = rng.choice(len(x), min(len(x), 256), replace=False)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return self.lists
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-(x[q] @ self.centres.T), axis=1)
        place = np.argsort(order, axis=1)
        need = np.sort(np.take_along_axis(place, _nearest(x, self.centres)[top], axis=1).ravel())
        return int(min(self.lists, need[min(len(need) - 1, int(np.ceil(AIM * len(need))))] + 1))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, scale and length of the codes' error of each vector."""
        x = self.padded(x)
        at = _nearest(x, self.centres)
        r, unit, length = self._residuals(x)
        codes = encode(r, unit, self.books, self.weight)
        off = r - self.books[np.arange(len(self.books)), codes].reshape(len(r), -1)
        return at, packed(codes), length, length * np.linalg.norm(off, axis=1)

    def routes(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The lists each query reads, the best of them first."""
        return np.argsort(-(self.padded(q) @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def enough(self, q: np.ndarray, query: np.ndarray, lists: np.ndarray) -> int:
        """The fewest lists to read, given the list of each true neighbour of query q[query]: they hold AIM of all neighbours, and
        all but MISS of those of each query but RARE."""
        place = np.argsort(self.routes(q, self.lists), axis=1)[query, lists]
        if not len(place):
            return 1
        order = np.lexsort((place, query))
        query, place = query[order], place[order]
        n = np.bincount(query, minlength=len(q))
        last = (np.cumsum(n) - n + np.ceil((1 - MISS) * n).astype(int) - 1)[n > 0]
        own, every = np.sort(place[last]), np.sort(place)
        at = lambda v, share: v[min(len(v), int(np.ceil(share * len(v)))) - 1]
        return int(max(at(own, 1 - RARE), at(every, AIM))) + 1

    def approximate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the packed codes of a list add to their centre's score, in units of their scales, for all queries: from one table per
        query and pair of sub-spaces; queries count as of length 1."""
        q = self.padded(q)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        tables = np.einsum("qsd,scd->scq", q.reshape(len(q), len(self.books), SUB), self.books).astype(np.float32)
        if len(tables) % 2:
            tables = np.concatenate([tables, np.zeros_like(tables[:1])])
        out = np.zeros((len(codes), len(q)), dtype=np.float32)
        for s in range(codes.shape[1]):
            pair = tables[2 * s + 1][:, None, :] + tables[2 * s][None, :, :]
            out += pair.reshape(CENTRES * CENTRES, -1)[codes[:, s]]
        return out.T


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes in a byte, the first one in its lower half."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] | codes[:, 1::2] << 4


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    for d in range(q.shape[-1]):
        out += q[..., d].astype(np.float64) * x[..., d].astype(np.float64)
    return out


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy())


def searcher(index: Index, k: int):
    """For one part of the rows: the k best of each query that reads one of its lists."""

    def run(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(q) and len(v):
            qid, qs = q["query_id"].to_numpy(), _matrix(q["embedding"])
            asks = {(i, x) for i, xs in enumerate(q["lists"]) for x in xs}
            v = v.sort_values("list", kind="stable")
            ids, x, at = v["vec_id"].to_numpy(), _matrix(v["embedding"]), v["list"].to_numpy()
            codes = np.frombuffer(b"".join(v["codes"]), dtype=np.uint8).reshape(len(v), -1)
            scale, off = v["scale"].to_numpy(), v["off"].to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                who = np.array([i for i in range(len(q)) if (i, int(at[a])) in asks], dtype=np.int64)
                for w in np.array_split(who, max(1, -(-len(who) // 256))):
                    if len(w):
                        found.append(_best(index, k, qid[w], qs[w], int(at[a]), ids[a:b], x[a:b], codes[a:b], scale[a:b], off[a:b]))
        if not found:
            return pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0)})
        q_, v_, s_ = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((v_, -s_, q_))
        q_, v_, s_ = q_[order], v_[order], s_[order]
        first = np.flatnonzero(np.diff(q_, prepend=q_[0] - 1)) if len(q_) else np.zeros(0, dtype=np.int64)
        top = np.arange(len(q_)) - np.repeat(first, np.diff(np.append(first, len(q_)))) < k
        return pd.DataFrame({"query_id": q_[top], "vec_id": v_[top], "score": s_[top]})

    return run


def _best(index: Index, k: int, qid: np.ndarray, qs: np.ndarray, centre: int, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, scale: np.ndarray, off: np.ndarray):
    """Queries, vectors and exact scores of the k best of a list: all of its codes are scanned, the best ranked again, and then all
    that the errors of their codes may hide."""
    rough = index.approximate(qs, codes) * scale
    own = ids[None, :] == qid[:, None]
    rough[own] = -np.inf
    most = max(RERANK, 2 * k, int(RERANK_SHARE * len(ids)))
    best = np.argpartition(-rough, most - 1, axis=1)[:, :most] if most < len(ids) else np.broadcast_to(np.arange(len(ids)), rough.shape)
    score = exact(qs[:, None, :], x[best])
    score[np.take_along_axis(own, best, 1)] = -np.inf
    at, vec, score = np.repeat(np.arange(len(qs)), best.shape[1]), best.ravel(), score.ravel()
    if most < len(ids):
        least = np.sort(score.reshape(len(qs), -1), axis=1)[:, -k]
        length = np.maximum(np.linalg.norm(qs.astype(np.float64), axis=1), 1e-300)
        base = index.padded(qs) @ index.centres[centre]
        more = rough + (MARGIN / np.sqrt(index.dim)) * off >= ((least - base) / length)[:, None]
        np.put_along_axis(more, best, False, 1)
        i, j = np.nonzero(more & ~own)
        s = exact(qs[i], x[j])
        ok = s >= least[i]
        at, vec, score = np.append(at, i[ok]), np.append(vec, j[ok]), np.append(score, s[ok])
    ok = score > -np.inf
    at, vec, score = at[ok], vec[ok], score[ok]
    order = np.lexsort((ids[vec], -score, at))
    at, vec, score = at[order], vec[order], score[order]
    n = np.bincount(at, minlength=len(qs))
    top = np.arange(len(at)) - (np.cumsum(n) - n)[at] < k
    return qid[at[top]], ids[vec[top]], score[top]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part: an id, no null or non-finite component, not all zero."""
    e = F.col("embedding")
    ok = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where("vec_id is not null").where(ok)


def fit(vectors: DataFrame, k: int, most: int = FIT_ROWS) -> Index | None:
    """Fitted on a hash sample of about `most` usable rows of the commonest dimension; None if there are none."""
    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return None
    rows = vectors.where(F.size("embedding") == sizes["d"])
    if sizes["n"] > most:
        rows = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * most / sizes["n"]))
    x = rows.orderBy("vec_id").toPandas()  # bounded by `most`
    return Index(_matrix(x["embedding"]), sizes["n"], k) if len(x) else None


_FOUND = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each vector whose id is divisible by `every`.

    All usable vectors but the query's own are candidates, nearest first, ties to the smaller vec_id. Vectors of another
    dimension than the commonest have no inner product with the rest and take no part. Rows that repeat a vec_id count once,
    the smallest vector. Copies of one vector beyond its k + 1 smallest ids can be in no result and are left out of lists.
    An empty table has no results; other columns are ignored.
    """
    spark = vectors.sparkSession
    plain = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    plain = staged(plain)
    index = fit(plain, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plain = plain.where(F.size("embedding") == index.dim)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    useful = plain.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n")

    @F.pandas_udf("struct<list:int,codes:binary,scale:double,off:double>")
    def placed(e: pd.Series) -> pd.DataFrame:
        at, codes, scale, off = index.place(_matrix(e))
        return pd.DataFrame({"list": at.astype(np.int32), "codes": [c.tobytes() for c in codes], "scale": scale, "off": off})

    stored = staged(useful.withColumn("p", placed("embedding")).select("vec_id", "embedding", "p.list", "p.codes", "p.scale", "p.off"))
    # Small lists share a part of about PART_ROWS rows; a list of more has parts of its own. One row per list: bounded by the fit.
    sizes = stored.groupBy("list").agg(F.count("*").alias("n"))
    shares = max(1, -(-stored.count() // PART_ROWS))
    own = F.ceil(F.col("n") / PART_ROWS).cast("int")
    sizes = F.broadcast(sizes.select("list", F.when(F.col("n") > PART_ROWS // 4, own).otherwise(0).alias("own"), F.pmod("list", F.lit(shares)).alias("share")))
    block = F.pmod(F.xxhash64("vec_id"), F.greatest("own", F.lit(1)))
    parts = stored.join(sizes, "list").withColumn("part", _part(block)).drop("own", "share")
    queries = plain.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    probes = max(index.probes, _tried(queries, stored, index, k))
    found = staged(_searched(queries, parts, sizes, index, k, probes))
    if probes < index.lists:
        least = min(k, useful.count() - 1)
        have = found.groupBy("query_id").agg(F.count("*").alias("n"))
        short = staged(queries.join(have.where(F.col("n") >= least), "query_id", "left_anti"))
        if short.limit(1).count():
            more = _searched(short, parts, sizes, index, k, index.lists)
            found = found.join(short, "query_id", "left_anti").unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tried(queries: DataFrame, stored: DataFrame, index: Index, k: int) -> int:
    """How many lists hold what sampled queries look for: their true neighbours come from all rows, block by block."""
    n = queries.count()
    some = queries if n <= TRIED else queries.where(F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * TRIED / n))
    asked = some.toPandas()  # bounded by TRIED
    if not len(asked):
        return 1
    q, ids = _matrix(asked["embedding"]).astype(np.float64), asked["query_id"].to_numpy()

    def best(batches):
        kept = [(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(q)
        for v in batches:
            if not len(v):
                continue
            s, vec, at = q @ _matrix(v["embedding"]).astype(np.float64).T, v["vec_id"].to_numpy(), v["list"].to_numpy()
            s[vec[None, :] == ids[:, None]] = -np.inf
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(vec) else np.broadcast_to(np.arange(len(vec)), s.shape)
            for i, t in enumerate(top):
                new = [np.append(a, b) for a, b in zip(kept[i], (s[i, t], vec[t], at[t]), strict=True)]
                first = np.lexsort((new[1], -new[0]))[:k]
                kept[i] = tuple(a[first] for a in new)
        for i, (s, vec, at) in enumerate(kept):
            yield pd.DataFrame({"query": i, "vec_id": vec, "list": at, "score": s})

    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = stored.select("vec_id", "embedding", "list").mapInPandas(best, "query int, vec_id long, list int, score double").where("score > double('-Infinity')")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query", "list").toPandas()  # k rows a query
    return index.enough(q, near["query"].to_numpy(), near["list"].to_numpy())


def _part(block: F.Column) -> F.Column:
    return F.when(F.col("own") > 0, F.concat_ws("-", "list", block)).otherwise(F.concat(F.lit("s"), F.col("share")))


def _searched(queries: DataFrame, parts: DataFrame, sizes: DataFrame, index: Index, k: int, probes: int) -> DataFrame:
    """The k best of each query in each part that it reads, over its `probes` best lists. A part meets its queries in blocks."""

    @F.pandas_udf("array<int>")
    def routed(e: pd.Series) -> pd.Series:
        return pd.Series(list(index.routes(_matrix(e), probes).astype(np.int32)))

    asked = queries.withColumn("list", F.explode(routed("embedding"))).join(sizes, "list")
    asked = asked.withColumn("block", F.explode(F.expr("sequence(0, greatest(own, 1) - 1)"))).withColumn("part", _part(F.col("block")))
    asked = asked.groupBy("query_id", "part").agg(F.collect_list("list").alias("lists"), F.first("embedding").alias("embedding"))
    blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    asked = asked.join(blocks, "part").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    turns = staged(blocks)
    rows = parts.join(turns, "part").withColumn("turn", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    return asked.groupBy("part", "turn").cogroup(rows.groupBy("part", "turn")).applyInPandas(searcher(index, k), _FOUND)


def recall(found: DataFrame, vectors: DataFrame, queries: int = 50, every: int = 20, k: int = 20) -> tuple[float, float]:
    """Shares of the true k nearest found, the mean and the least of the first `queries` query ids, by brute force over all rows
    in blocks."""
    plain = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = plain.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    plain = plain.where(F.size("embedding") == size)
    asked = plain.where(F.col("vec_id") % every == 0).orderBy("vec_id").limit(queries).toPandas()
    q, ids = _matrix(asked["embedding"]), asked["vec_id"].to_numpy()

    def best(batches):
        for v in batches:
            s = exact(q[:, None, :], _matrix(v["embedding"])[None])
            for i, row in enumerate(s):
                row[v["vec_id"].to_numpy() == ids[i]] = -np.inf
                top = np.lexsort((v["vec_id"].to_numpy(), -row))[:k]
                yield pd.DataFrame({"query_id": ids[i], "vec_id": v["vec_id"].to_numpy()[top], "score": row[top]})

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = plain.mapInPandas(best, _FOUND).where("score > double('-Infinity')").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    hit = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    each = hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    r = each.agg(F.avg("share").alias("mean"), F.min("share").alias("least")).first()
    return r["mean"] or 0.0, r["least"] or 0.0
