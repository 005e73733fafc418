"""Token-id files: canonical length-limited Huffman codes of ids from global counts, in independent blocks.

A store is a folder of two tables. `codes` has the code length of each id that occurs; codes are canonical, so lengths say
all. `blocks` has, per file and block, the documents' token numbers, a bit offset at every CHECKPOINT tokens, and the bits.
Blocks are read on their own, all stretches between checkpoints in step through one lookup table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, staged, texts
from .pretokens import encoder

LONGEST = 16
CHECKPOINT = 64
BLOCK_TOKENS = 1 << 18
END_ID = 0


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal lengths up to `longest` by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if not len(used):
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    longest = max(longest, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    rows, have = [], weight
    is_leaf = np.ones(len(weight), dtype=bool)
    for _ in range(longest - 1):
        rows.append(is_leaf)
        pairs = have[: len(have) // 2 * 2].reshape(-1, 2).sum(axis=1)
        every = np.concatenate((weight, pairs))
        place = np.argsort(every, kind="stable")
        have, is_leaf = every[place], place < len(weight)
    rows.append(is_leaf)
    take = 2 * len(weight) - 2
    lengths = np.zeros(len(weight), dtype=np.int64)
    for leaf in reversed(rows):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code = last = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        code <<= n - last
        codes[i] = code
        code, last = code + 1, n
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, most significant first, and the bit offset of each CHECKPOINT-th."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    word, shift = start >> 5, (64 - n - (start & 31)).astype(np.uint64)
    value = codes[ids] << shift
    out = np.zeros((int(end[-1]) >> 5) + 3 if len(ids) else 2, dtype=np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
        last = np.append(first[1:] - 1, len(ids) - 1)
        out[word[last] + 1] |= value[last] & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes(), start[::CHECKPOINT]


def lookup(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for every value of the next `bits` bits."""
    bits = int(lengths.max(initial=1))
    ids, n = np.zeros(1 << bits, dtype=np.uint32), np.zeros(1 << bits, dtype=np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (bits - lengths[order].astype(np.int64))
    fill = int(span.sum())
    ids[:fill], n[:fill] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, n, bits


def unpack(data: bytes, marks: np.ndarray, count: int, tables) -> np.ndarray:
    """The `count` ids of a block; all stretches from mark to mark advance together."""
    ids, n, bits = tables
    raw = np.frombuffer(data, dtype=">u4").astype(np.uint64)
    pair = (raw[:-1] << np.uint64(32)) | raw[1:]
    at = marks.astype(np.int64).copy()
    out = np.zeros((CHECKPOINT, len(at)), dtype=np.uint32)
    tail = count - (len(at) - 1) * CHECKPOINT
    for k in range(CHECKPOINT):
        if k == tail:
            at = at[:-1]
        peek = (pair[at >> 5] >> (np.uint64(64 - bits) - (at & 31).astype(np.uint64))) & np.uint64((1 << bits) - 1)
        out[k, : len(at)] = ids[peek]
        at += n[peek]
    return out.T.reshape(-1)[:count]


def narrow(ids: np.ndarray) -> bytes:
    """Ids on their way: their width in bytes (2 where that does), then the ids."""
    width = 2 if len(ids) and int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.uint32)


def tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in by_bytes(batches, 4 << 20):
            ids = [np.append(x, np.uint32(end_id)) for x in encode(texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([narrow(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            c = np.bincount(wide(blob))
            if len(c) > len(total):
                total, c = c, total
            total[: len(c)] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


_BLOCKS = "file int, block int, start long, doc_ids array<long>, doc_tokens array<long>, more boolean, split boolean, n_tokens long, marks binary, bits binary"
_BLOCKS_ARROW = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("more", pa.bool_()), ("split", pa.bool_()), ("n_tokens", pa.int64()), ("marks", pa.binary()), ("bits", pa.binary())])


def packer(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.frombuffer(lengths, dtype=np.uint8)
        codes, file = canonical(n), TaskContext.get().partitionId()
        docs, sizes, parts, have, block, start = [], [], [], 0, 0, 0

        def flush(more: bool, split: bool) -> pa.RecordBatch:
            nonlocal docs, sizes, parts, have, block, start
            ids = np.concatenate(parts)
            bits, marks = pack(ids, codes, n)
            row = {"file": file, "block": block, "start": start, "doc_ids": docs, "doc_tokens": sizes, "more": more, "split": split, "n_tokens": len(ids), "marks": marks.astype("<u4").tobytes(), "bits": bits}
            block, start = block + 1, start + len(ids)
            docs, sizes, parts, have = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS_ARROW)

        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = wide(blob)
                if have and have + len(ids) > BLOCK_TOKENS:
                    yield flush(False, False)
                if len(ids) > BLOCK_TOKENS:  # such a document has blocks of its own
                    while len(ids):
                        cut, ids = ids[:BLOCK_TOKENS], ids[BLOCK_TOKENS:]
                        docs, sizes, parts = [doc], [len(cut)], [cut]
                        yield flush(len(ids) > 0, True)
                    continue
                docs.append(doc), sizes.append(len(ids)), parts.append(ids)
                have += len(ids)
        if docs:
            yield flush(False, False)

    return run


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encodes `docs` (doc_id, text) in ascending doc_id order (nulls first, ties by ids) into a store at `path`.

    Null text is empty; every document ends with `end_id`. No rows make a store without blocks.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    tokens = staged(docs.select("doc_id", "text").mapInArrow(tokenised(tokenizer, end_id), "doc_id long, n_tokens long, ids binary"))
    counts = tokens.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # one row per id: bounded by the vocabulary
    dense = np.zeros(max((r["id"] for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        dense[r["id"]] = r["n"]
    lengths = code_lengths(dense)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, length int").coalesce(1).write.parquet(f"{path}/codes")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(packer(lengths.tobytes()), _BLOCKS).write.parquet(f"{path}/blocks")


def unpacker(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.frombuffer(lengths, dtype=np.uint8)
        tables = lookup(n, canonical(n))
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["bits"], np.frombuffer(r["marks"], dtype="<u4"), r["n_tokens"], tables)
                size = np.array(r["doc_tokens"], dtype=np.int64)
                end = np.cumsum(size)
                part = [ids[b - s : b].astype("<u4").tobytes() for s, b in zip(size.tolist(), end.tolist(), strict=True)]
                last = [False] * (len(part) - 1) + [r["more"]]
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * k, pa.int32()), pa.array([r["block"]] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + end - size, pa.int64()), pa.array(size, pa.int64()), pa.array(last), pa.array(part, pa.binary())], ["file", "block", "place", "doc_id", "start", "n_tokens", "more", "ids"])

    return run


def read_store(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """Pieces of documents from a store: file, block, place, doc_id, start (in the file), n_tokens, more, ids (uint32).

    `where` picks blocks: those with `split` hold one piece of a document longer than a block, the others whole documents.
    """
    rows = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, dtype=np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]
    out = "file int, block int, place int, doc_id long, start long, n_tokens long, more boolean, ids binary"
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").where(where).mapInArrow(unpacker(lengths.tobytes()), out)


def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the pieces of a document in a file, which follow each other, and sums them up."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)

    def emit(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int64())], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    out, open_doc = [], None
    for file, _, _, doc, start, n, more, ids in rows():
        x = [file, doc, start, n, zlib.crc32(ids)] if open_doc is None else [*open_doc[:3], open_doc[3] + n, zlib.crc32(ids, open_doc[4])]
        open_doc = x if more else None
        if not more:
            out.append(x)
        if len(out) >= 10_000:
            yield emit(out)
            out = []
    if open_doc is not None:
        raise ValueError("a store ends inside a document")
    yield emit(out)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a store, from its files."""
    totals = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    base, at = [], 0  # one row per file: bounded by the number of partitions
    for r in sorted(totals, key=lambda r: r["file"]):
        base.append((r["file"], at))
        at += r["n"]
    out = "file int, doc_id long, start long, n_tokens long, ids_crc32 long"
    long = read_store(spark, path, "split").repartition("file").sortWithinPartitions("file", "block")
    docs = read_store(spark, path, "not split").mapInArrow(crc, out).union(long.mapInArrow(crc, out))
    offsets = F.broadcast(spark.createDataFrame(base, "file int, base long"))
    return docs.join(offsets, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    """A public tokenizer by its name: each task finds the file on its own machine."""
    return "byte_bpe_50k.json"
