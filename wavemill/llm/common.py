"""What the corpus operators share: table access, intermediate tables in the shared folder, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master; on
    a cluster it is an error, as executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
        base = "file://" + tempfile.mkdtemp(prefix="wavemill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/wavemill-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the application's folder."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def surrogate_key(spark: SparkSession) -> str:
    """The key of surrogates from spark.wavemill.surrogates.key. Queries over test data have none and use a public one."""
    return spark.conf.get("spark.wavemill.surrogates.key", None) or "not a secret: for test data"


def model_path(name: str) -> str:
    """`name` if it is a path, else the place of the public tokenizer file of that name on the machine that asks."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by size: ten thousand long texts are too much for one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def staged(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage is cut and lost executors cost nothing.

    A collection of the driver's garbage follows, upon which Spark deletes the shuffle files of jobs that are done.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def texts(batch, name: str = "text") -> list[str]:
    """A string column of an Arrow batch; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def give_back() -> None:
    """Returns to the system what Arrow's pool and malloc hold of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], each: int = 4 << 20) -> Callable[[Iterator], Iterator]:
    """The Arrow function `run`, whose worker gives freed memory back after every `each` bytes of input and at its end.

    Workers stay for later tasks, and what they hold counts for the executor, whose heap may be full by then.
    """

    def fed(batches: Iterator) -> Iterator:
        size = 0
        for batch in batches:
            size += batch.nbytes
            yield batch
            del batch
            if size >= each:
                give_back()
                size = 0

    @wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        yield from run(fed(batches))
        give_back()

    return tidy


def by_bytes(batches: Iterator, most: int = 8 << 20) -> Iterator:
    """The same rows in Arrow batches of about `most` bytes, so that long texts don't add up in one batch."""
    for batch in batches:
        size = max(1, batch.nbytes)
        step = max(1, batch.num_rows * most // size) if size > most else max(1, batch.num_rows)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def gathered(batches: Iterator, most: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, for work that gains by seeing many rows at once."""
    carry, size = [], 0
    for batch in by_bytes(batches, most):
        if carry and size + batch.nbytes > most:
            yield pa.concat_batches(carry)
            carry, size = [], 0
        carry.append(batch)
        size += batch.nbytes
    if carry:
        yield pa.concat_batches(carry)


def whole_groups(batches: Iterator, keys: list[str], least: int = 20_000, most: int = 12 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of equal keys of a sorted partition, each with the rows where its runs begin and end."""
    carry: list = []
    rows = size = 0
    for batch in batches:
        carry.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < least and size < most:
            continue
        table = pa.Table.from_batches(carry)
        cuts = _cuts(table, keys)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]).combine_chunks(), cuts[:-1]
            table = table.slice(cuts[-2])
        carry = table.to_batches()
        rows, size = table.num_rows, table.nbytes
        least = max(least, rows * 2) if len(cuts) <= 2 else least
    if carry and sum(b.num_rows for b in carry):
        table = pa.Table.from_batches(carry).combine_chunks()
        yield table, _cuts(table, keys)


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def together(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Partitions by keys, each sorted by `order` (the keys by default), for whole_groups()."""
    return df.repartition(*keys).sortWithinPartitions(*(order or keys))


#: Shares of the links of one node that are looked at apart.
SALTS = 32


def _with_least(e: DataFrame) -> DataFrame:
    """(u, v, m) of links (u, v): m is the least of u's other ends. A node with very many links is dealt out in SALTS shares,
    each of which is summed up by itself and gets the node's minimum back."""
    e = e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = e.groupBy("u", "s").agg(F.min("v").alias("m"))
    low = part.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))
    return e.join(low.select("u", "m", F.explode("s").alias("s")), ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (u long, v long) as (id, component), component the smallest id reachable.

    Alternates large-star and small-star steps until nothing changes, which takes a number of rounds that grows with the
    logarithm of the longest path. The links stay on the executors and each round is written to the shared folder.
    """
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = _with_least(large.where("u <> v").distinct())
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        e = staged(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        # A fixed point repeats itself: the number of links and an order-free digest of them are compared.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    out = e.groupBy("u").agg(F.min("v").alias("v"))
    return out.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
