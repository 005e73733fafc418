"""Recordings in MATLAB level 5 files, read by Spark's binary file source and parsed in tasks, one file a row.

A file holds a structure or plain variables: EEG (or EEG.Raw) with samples in rows, States, Blocks, Frq, and optionally NIRS
with HbO, HbR, Frame, States, Blocks and Frq; a rate may also be called SamplingRate. Land them as Parquet once; query that.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import subject_of
from . import schemas
from .files import stem

# Element types of the format with their numpy types.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2"}
_MATRIX, _PACKED, _CELL, _STRUCT, _CHAR = 14, 15, 1, 2, 4


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # a small element has both in one word
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == _PACKED else -size % 8)


def _matrix(data: bytes, order: str):
    parts = _elements(data, order)
    flags = struct.unpack_from(f"{order}I", next(parts)[1])[0] & 0xFF
    shape = tuple(np.frombuffer(next(parts)[1], dtype=f"{order}i4"))
    name = next(parts)[1].decode("latin-1")
    if flags == _STRUCT:
        width = int(np.frombuffer(next(parts)[1], dtype=f"{order}i4")[0])
        raw = next(parts)[1]
        fields = [raw[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(raw), width)]
        values = [_matrix(d, order)[1] if d else None for _, d in parts]
        return name, dict(zip(fields, values, strict=False))
    if flags == _CELL:
        return name, [_matrix(d, order)[1] if d else None for _, d in parts]
    kind, raw = next(parts, (1, b""))
    values = np.frombuffer(raw, dtype=order + _TYPES[kind])
    if flags == _CHAR:
        return name, "".join(map(chr, values))
    return name, values.reshape(shape, order="F")


def parse(data: bytes) -> dict:
    """Variables of a file."""
    order = "<" if data[126:128] == b"IM" else ">"
    out = {}
    for kind, raw in _elements(data[128:], order):
        if kind == _PACKED:
            kind, raw = next(_elements(zlib.decompress(raw), order))
        if kind == _MATRIX:
            name, value = _matrix(raw, order)
            out[name] = value
    return out


def _recording(data: bytes) -> tuple[dict, dict | None]:
    """The two streams of a file; errors name what is missing or doesn't fit."""
    v = parse(data)
    eeg = v.get("EEG")
    if eeg is None and len(v) == 1 and isinstance(only := next(iter(v.values())), dict):
        v, eeg = only, only.get("EEG")
    if eeg is None:
        raise KeyError("EEG")
    eeg = eeg if isinstance(eeg, dict) else {"Raw": eeg, **{k: v.get(k) for k in ("States", "Blocks", "Frq", "SamplingRate")}}
    raw = np.asarray(eeg["Raw"])
    if raw.ndim != 2:
        raise ValueError("Raw has not two dimensions")
    for k in ("States", "Blocks"):
        if np.size(eeg[k]) != len(raw):
            raise ValueError(f"{k} and Raw differ in length")
    nirs = v.get("NIRS")
    return eeg, nirs if isinstance(nirs, dict) and nirs.get("HbO") is not None else None


def _ints(x) -> np.ndarray:
    return np.asarray(x).ravel().astype(np.int32)


def _rate(stream: dict | None) -> float | None:
    found = [stream[k] for k in ("Frq", "SamplingRate") if stream is not None and stream.get(k) is not None]
    return float(np.ravel(found[0])[0]) if found else None


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, eeg, nirs) of all .mat files below a path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").option("recursiveFileLookup", True).load(path)
    found = found.select(stem(F.col("path")).alias("session_id"), "content")
    found = found.repartition(F.col("session_id"))

    def eeg(batches):
        for t in batches:
            for r in t.itertuples():
                e, _ = _recording(r.content)
                yield pd.DataFrame({"session_id": r.session_id, "sample": np.arange(len(e["Raw"])), "x": list(np.asarray(e["Raw"], dtype=float)), "state": _ints(e["States"]), "block": _ints(e["Blocks"])})

    def nirs(batches):
        for t in batches:
            for r in t.itertuples():
                _, n = _recording(r.content)
                if n is not None:
                    hb = np.asarray(n["HbO"], dtype=float)
                    yield pd.DataFrame({"session_id": r.session_id, "seq": np.arange(len(hb)), "frame": _ints(n["Frame"]), "hbo": list(hb), "hbr": list(np.asarray(n["HbR"], dtype=float)), "state": _ints(n["States"]), "block": _ints(n["Blocks"])})

    def meta(batches):
        for t in batches:
            for r in t.itertuples():
                e, n = _recording(r.content)
                e_rate, n_rate = _rate(e), _rate(n)
                yield pd.DataFrame([(r.session_id, e_rate, n_rate, n is not None, np.asarray(n["HbO"]).shape[1] if n is not None else None, len(e["Raw"]))], columns=["session_id", "fs_eeg", "fs_nirs", "has_nirs", "n_nirs_ch", "n_samples"])

    sessions = found.mapInPandas(meta, "session_id string, fs_eeg double, fs_nirs double, has_nirs boolean, n_nirs_ch int, n_samples bigint")
    sessions = schemas.checked(sessions.withColumn("subject", subject_of("session_id")), schemas.SESSIONS, "sessions")
    return sessions, found.mapInPandas(eeg, schemas.EEG), found.mapInPandas(nirs, schemas.NIRS)


def stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Samples landed as Parquet, as a stream in the order of their files."""
    return spark.readStream.schema(schemas.EEG).option("maxFilesPerTrigger", files_per_batch).parquet(path)
