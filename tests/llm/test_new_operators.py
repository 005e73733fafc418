"""op11 to op13 against plain versions, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import filter_audit, lexical, line_dedup, quality, toxicity
from wavemill.llm.queries import QUERIES

WORDS = [f"w{k}{'aeiou'[k % 5]}" for k in range(120)]
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    common = ["This line is common to very many texts.", "  \tTHIS line is common to very many texts. \r", "é" * 20, "a line of exactly 20", "a line of exact. 19"]
    rows = []
    for k in range(120):
        lines = [prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(0, 6))]
        lines += rng.sample(common, rng.randrange(0, 4)) + [f"shared by group {k % 30} only here"] * (k % 3)
        rng.shuffle(lines)
        rows.append("\n".join(lines))
    rows += [rows[5]] * 4 + [None, "", "\n\n", " ", prose(rng, 20_000) + "\n" + common[0] + "\n" + prose(rng, 20_000), "AB CD #" * 60, "$", common[0], "x" * 300_000 + "\n" + common[0], "x" * 300_000, "x" * 300_000]
    return [(2 * i + 1, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    langs = ["en", "de", None, "f'r"]
    df = spark.createDataFrame([(i, t, langs[i % 4], "s", 0, [1], 2, "h", -1) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long, lost array<long>, shard int, h string, n_lines int")
    return df.repartition(5)


def brute_lines(corpus, least=3, points=20):
    holders, cut = defaultdict(list), []
    for row, (i, t) in enumerate(corpus):
        lines = (t or "").split("\n")
        keys = [lower(x).strip(" \t\n\r\x0b\x0c") for x in lines]
        cut.append((lines, keys))
        for k in {k for k in keys if len(k) >= points}:
            holders[k].append((row, line_dedup.NO_ID if i is None else i))
    out = []
    for (i, _), (lines, keys) in zip(corpus, cut, strict=True):
        me = line_dedup.NO_ID if i is None else i
        kept = [x for x, k in zip(lines, keys, strict=True) if not (len(holders.get(k, ())) >= least and max(d for _, d in holders[k]) != me)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup(docs, corpus, monkeypatch, small):
    if small:  # many shards, hot ones in shares
        monkeypatch.setattr(line_dedup, "SHARD_LINES", 8)
        monkeypatch.setattr(line_dedup, "isqrt", lambda n: 0)
    got = sorted(map(tuple, line_dedup.without_common_lines(docs, keep=False).collect()), key=str)
    assert got == brute_lines(corpus) and sum(r[2] for r in got) > 50
    kept = line_dedup.without_common_lines(docs)
    assert set(kept.columns) == {*docs.columns, "n_dropped"}
    rows = kept.collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows) == sorted(got)
    assert {(r.doc_id, r.lang, r.shard, r.h, *r.lost) for r in rows} == {(r.doc_id, r.lang, r.shard, r.h, *r.lost) for r in docs.collect()}


def test_line_dedup_odd_rows(spark):
    a, b = "one line that is long enough", "another line that is long"
    rows = [(5, a), (5, a), (5, a + "\n" + a), (None, a), (None, b), (None, b), (None, b), (7, "X" + b), (8, b[:19])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.without_common_lines(df, keep=False).collect()), key=str)
    assert got == brute_lines(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert (None, 1, 1, empty) in got  # a: the largest id 5 keeps it in all three rows, a null id loses it; b: only null ids, kept
    assert Counter(r[2] for r in got) == {0: 8, 1: 1}
    assert line_dedup.without_common_lines(df.limit(0), keep=False).count() == 0
    assert line_dedup.without_common_lines(df.limit(0)).columns == ["doc_id", "n_lines", "n_dropped", "text"]
    with pytest.raises(ValueError):
        line_dedup.without_common_lines(df, least=300).count()


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 5000):
        h, g = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
        h[: n // 2] = 7  # equal first halves go apart by the second
        f = line_dedup.PerfectHash.of(h, g)
        assert sorted(f(h, g).tolist()) == list(range(n))
        other = f(h ^ np.uint64(1), g)
        assert ((other >= -1) & (other < max(n, 1))).all()
        assert n < 100 or sum(f.sizes) < 5 * n


def test_index_knows_strangers(spark):
    """Lines that the index has not seen hit nothing."""
    rng = np.random.default_rng(4)
    make = lambda seed, n: [(int(x), int(y), k) for k, (x, y) in enumerate(np.random.default_rng(seed).integers(-(2**62), 2**62, (n, 2)))]
    known, strange = make(1, 400), make(2, 4000)
    lines = spark.createDataFrame([(h, g, d + j) for h, g, d in known for j in range(3)], "h long, g long, doc_id long")
    own = line_dedup.index(lines, 4)
    assert sum(r.n_keys for r in own.collect()) == 400 and rng is not None
    assert line_dedup.hits(spark.createDataFrame([(h, g, -1) for h, g, _ in strange], "h long, g long, doc_id long"), own, 4, 100).count() == 0
    assert line_dedup.hits(spark.createDataFrame([(h, g, -1) for h, g, _ in known], "h long, g long, doc_id long"), own, 4, 100).count() == 400


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(corpus, items, k=50):
    docs = [(i, TERM.findall(lower(t))) for i, t in corpus]
    n_docs, length = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    own = defaultdict(set)
    for item, text in items:
        if item is not None and text is not None:
            own[item] |= set(TERM.findall(lower(text)))
    out = []
    for item, terms in own.items():
        found = []
        for i, w in docs:
            tf, n = Counter(w), len(w)
            m = 100 - 50 + (50 * n * n_docs) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [lexical.WINDOW, 7])
def test_lexical_search(spark, docs, corpus, window):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randrange(1, 12))) for k in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (None, prose(rng, 3)), (3, "common line"), (0, prose(rng, 2)), (0, prose(rng, 2)), (23, "Éé COMMON # exactly 20")]
    b = spark.createDataFrame([(i, t, 5, 0.5, "x") for i, t in items], "item_id long, text string, rank int, score double, doc_id string")
    want = brute_search(corpus, items)
    got = lexical.ranked(docs, b, window=window)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 300
    assert sorted(map(tuple, lexical.ranked(docs, b, k=3, window=window, most=60).collect()), key=str) == brute_search(corpus, items, 3)


def test_lexical_search_odd_rows(spark):
    rows = [(4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"), (None, None), (2, "alpha beta"), (9, ""), (1, "gamma " * 50_000 + "alpha")] + [(k, f"noise{k}") for k in range(30, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = [("b", "Alpha"), ("a", "beta, BETA!")]
    b = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(map(tuple, lexical.ranked(df, b).collect()), key=str)
    assert got == brute_search(rows, items)
    assert [r[2] for r in sorted(got) if r[0] == "a"] == [2, 4, 4, None]
    assert lexical.ranked(df.limit(0), b).count() == 0 and lexical.ranked(df, b.limit(0)).count() == 0


def brute_audit(corpus, langs, labels):
    fails, first = {}, {}
    for i, t in corpus:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for (i, t), part in zip(corpus, langs, strict=True):
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = {f for f, y in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if y}
        rows.append((part or "", bad, *labels.get(i, (0, 0))))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        mine, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [r for r in own if not r[1] & set(order[:k])]
                gone = [r for r in here if f in r[1]]
                total[f] += len(gone)
                mine.append(("".join(order), k + 1, f, len(here) - len(gone), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] == 1 for r in gone), sum(r[3] == 1 for r in gone)))
        out += [(part, o, k, *rest, total[f]) for o, k, f, *rest in mine]
    assert fails == {}
    return sorted(out)


def test_filter_audit(spark, docs, corpus):
    rng = random.Random(9)
    rows = [(i, rng.randrange(2), rng.randrange(2)) for i, _ in corpus if i % 3]
    labels = spark.createDataFrame([(*r, "m") for r in rows] + [(None, 1, 1, "m")], "doc_id long, quality int, toxic int, mask string")
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    langs = ["en", "de", None, "f'r"]
    assert sorted(map(tuple, got.collect())) == brute_audit(corpus, [langs[i % 4] for i, _ in corpus], {i: (q, t) for i, q, t in rows})


def test_filter_audit_odd_rows(spark):
    rows = [(4, "same", "x"), (4, "same", "x"), (None, "same", "y"), (9, "same", "y"), (9, None, None), (8, "", ""), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(9, 1, 0), (9, 0, 1), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    want = brute_audit([r[:2] for r in rows], [r[2] for r in rows], {9: (1, 1), 4: (0, 1)})
    assert sorted(map(tuple, filter_audit.audit(df, labels).collect())) == want
    none = labels.limit(0)
    assert sorted(map(tuple, filter_audit.audit(df, none).collect())) == brute_audit([r[:2] for r in rows], [r[2] for r in rows], {})
    assert filter_audit.audit(df.limit(0), labels).count() == 0


def test_filter_audit_of_other_filters(spark):
    """Two filters of one's own, no duplicates: 4 edges, 2 orders."""
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "a", 7), (4, None, 1)], "doc_id long, text string, n int")
    got = filter_audit.audit(df.withColumn("p", F.lit("all")), df.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic")), {"T": F.col("text") == "a", "N": F.col("n") > 5}, None, "p")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert rows == {("TN", 1): (2, 2, 0, 1, 2, 0, 3), ("TN", 2): (1, 1, 1, 1, 1, 0, 3), ("NT", 1): (2, 2, 0, 1, 2, 0, 3), ("NT", 2): (1, 1, 1, 1, 1, 0, 3)}


def test_lattice_has_80_edges_and_600_steps():
    assert len({r[1:3] for r in filter_audit.lattice(5)}) == 80
    assert len(filter_audit.steps("ABCDE")) == 600 and len({r[2:] for r in filter_audit.steps("ABCDE")}) == 80


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_lexical_search", "op13_filter_audit"])
def test_queries_equal_sql(spark, name):
    import os

    import duckdb

    from wavemill.llm.oracles import ORACLES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, d).select(*cols).collect())) == sorted(want.fetchall())


def test_grades_of_any_kind(spark):
    """Fractions, and scales of more grades than the model has thresholds."""
    rng = random.Random(31)
    rows = [(k, " ".join(rng.choice(["junk!", "w1", "w2"][: 1 + (k % 3)]) for _ in range(60))) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = [(900, 7.5), (1, None), (2, float("nan")), (None, 0.5), (4, 9.5)]
    rated = spark.createDataFrame([(k, (0.5, 0.7, 2.5)[k % 3]) for k in range(3, 240)] + odd, "doc_id long, quality double")
    model = quality.fit(docs, rated)
    assert model["grades"] == [0.5, 0.7, 2.5] and len(model["cuts"]) == 2  # 7.5 rates a document that is not there, 9.5 is not the lowest
    out = {r.doc_id: r.expected_grade for r in quality.grades(docs, model).collect()}
    assert np.mean([out[k] for k in range(2, 240, 3)]) > np.mean([out[k] for k in range(0, 240, 3)]) + 0.5
    fine = spark.createDataFrame([(k, (k % 3) + k / 1000) for k in range(240)], "doc_id long, quality double")
    y, values, counts = quality.ranked_grades(fine, "quality")
    assert len(values) == len(counts) == quality.LARGEST_SCALE and sum(counts) == 240 and values == sorted(values)
    want = sorted((k % 3) + k / 1000 for k in range(240))
    assert [r["rank"] for r in y.join(fine, "doc_id").orderBy("quality").collect()] == sorted(np.repeat(np.arange(100), counts).tolist())
    assert np.dot(values, counts) == pytest.approx(sum(want))
    assert len(quality.fit(docs, fine)["cuts"]) == quality.LARGEST_SCALE - 1


def test_toxic_labels_of_any_kind(spark):
    rng = random.Random(32)
    rows = [(k, prose(rng, 30) + (" vilebad " if k % 3 == 0 else " ") + prose(rng, 20)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)], "doc_id long, toxic int"))
    other = toxicity.fit(docs, spark.createDataFrame([(k, 2.5 if k % 3 == 0 else -1.0 if k % 2 else 0.0) for k in range(150)] + [(1, None), (2, float("nan"))], "doc_id long, toxic double"))
    assert plain == other and plain["weights"]
    assert [r.predicted for r in toxicity.scores(docs, other).orderBy("doc_id").collect()] == [int(k % 3 == 0) for k in range(150)]
