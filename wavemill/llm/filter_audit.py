"""Filter interaction audit: what each filter removes in every order of the filters, from sums over lattice edges.

The subsets of filters that may have been applied already form a lattice; an edge leads from such a subset to the subset with
one filter more (5 filters: 80 edges). What a filter finds at an edge does not depend on the order in which the subset came
about, so documents are counted on edges, and each order is a path of edges that picks up their counts (120 orders: 600 steps).
Texts are read once, for flags and a digest; after that only narrow rows move, and after the first sums only counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: What an edge counts; `removed`, `good_lost` and `toxic_lost` are the rows that its filter takes out there.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Fixed conditions under which a text fails: A under 100 words, B 100 * distinct words < 80 * words, C 100 * [A-Z] > 10 *
    code points, D any of [#$%&*|]. Words are maximal [^\\x20\\x09-\\x0D]+; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(fails: dict[str, Column]) -> Column:
    """Bit k is set if the k-th filter fails; an undecided (null) filter passes."""
    out = F.lit(0)
    for k, c in enumerate(fails.values()):
        out = out + F.when(c, 1 << k).otherwise(0)
    return out


def copies_of_smaller(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, digest, ...) with `copy`: a smaller doc_id has the same digest anywhere in the table.

    The smallest id of a digest comes from a sum that is combined before the shuffle; rows meet it by (digest, doc_id), so a text
    that a third of all rows share is spread by its ids. A null doc_id is smaller or larger than none.
    """
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return rows.join(first, ["digest", "doc_id"], "left").withColumn("copy", F.col("doc_id").isNotNull() & F.col("first").isNull()).drop("first")


def lattice(n: int) -> list[tuple[int, int, int, bool, bool, bool, bool]]:
    """(mask, done, filter, kept, removed, redundant, alone) for every set of failures and every edge of n filters."""
    out = []
    for mask in range(1 << n):
        for done in range(1 << n):
            for f in range(n):
                if not done >> f & 1:
                    fails, gone = bool(mask >> f & 1), bool(mask & done)
                    out.append((mask, done, f, not gone and not fails, not gone and fails, gone and fails, mask == 1 << f))
    return out


def steps(names: str) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, done, filter): every order as its path through the lattice."""
    out = []
    for order in permutations(range(len(names))):
        done = 0
        for k, f in enumerate(order):
            out.append(("".join(names[i] for i in order), k + 1, done, f))
            done |= 1 << f
    return out


def edges(masks: DataFrame, n: int) -> DataFrame:
    """(part, done, filter, COUNTS) from `masks` (part, mask, rows, good, toxic). The lattice is a fixed table of 2^n * n * 2^(n-1)
    rows, whatever the input; every part has all edges, since each of its masks counts, if only zero, on all of them."""
    spark = masks.sparkSession
    table = spark.createDataFrame(lattice(n), "mask int, done int, filter int, is_kept boolean, is_removed boolean, is_redundant boolean, alone boolean")
    e = masks.join(F.broadcast(table), "mask")
    take = lambda flag, of: F.sum(F.when(F.col(flag), F.col(of)).otherwise(F.lit(0).cast("long")))
    return e.groupBy("part", "done", "filter").agg(
        take("is_kept", "rows").alias("kept"), take("is_removed", "rows").alias("removed"), take("is_redundant", "rows").alias("redundant"),
        take("alone", "rows").alias("unique_fails"), take("is_removed", "good").alias("good_lost"), take("is_removed", "toxic").alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, duplicates: str | None = "E", part: str = "lang") -> DataFrame:
    """One row per (part, filter_order, step): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `fails` are conditions on columns of `docs`, one letter each (those of text_failures by default); `duplicates` is the letter of
    one more filter, which fails the copies of a smaller doc_id, or None. Null texts are empty and identical to empty ones; a null
    part is the empty string; rows that repeat a doc_id are rows of their own, none a copy of the other; a row without doc_id is
    nobody's copy and has no labels. Of repeated labels any 1 counts. Empty tables give no rows. Columns of `docs` beyond doc_id,
    text and the part are not used.
    """
    fails = text_failures(F.col("text")) if fails is None else fails
    names = "".join(fails) + (duplicates or "")
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), _mask(fails).alias("mask"), *([digest.alias("digest")] if duplicates else []))
    if duplicates:
        rows = copies_of_smaller(staged(rows))
        rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("copy"), 1 << len(fails)).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = rows.select("doc_id", "part", "mask").join(marks, "doc_id", "left")
    some = lambda c: F.sum(F.coalesce(c, F.lit(0).cast("long")))
    e = edges(rows.groupBy("part", "mask").agg(F.count("*").alias("rows"), some("good").alias("good"), some("toxic").alias("toxic")), len(names))
    e = staged(e)
    n = len(names)
    # Of the orders that pass through an edge, the filters before it come in any order, and so do those after it.
    paths = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)])
    shapley = e.groupBy("part", "filter").agg(F.sum(F.col("removed") * paths[F.bit_count("done")]).alias("shapley"))
    way = e.sparkSession.createDataFrame(steps(names), "filter_order string, step int, done int, filter int")
    return e.join(F.broadcast(way), ["done", "filter"]).join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
