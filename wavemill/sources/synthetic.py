"""Seeded two-rate recordings for tests and demonstrations: each session is made by its own task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import schemas

FS, FS_NIRS = 250.0, 12.5


def _plan(seed: int, blocks: int, trials: int, prep: float, task: float) -> tuple[np.ndarray, np.ndarray]:
    """State and block of each sample: a pause and a task by turns, rest between the two sides."""
    rng, state, block = np.random.default_rng(seed), [], []
    for b in range(1, blocks + 1):
        order = rng.permutation([2, 3] * (trials // 2))
        for side in order:
            for c in (1, int(side)):
                state += [0] * int(prep * FS) + [c] * int(task * FS)
        block += [b] * (len(state) - len(block))
    return np.array(state, dtype=np.int32), np.array(block, dtype=np.int32)


def _signals(seed: int, state: np.ndarray, fs_nirs: float, effect: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EEG whose 10 Hz rhythm falls over the side away from the movement, and slow hemodynamics that rise there."""
    rng, n, p = np.random.default_rng(seed + 1), len(state), len(schemas.CHANNELS)
    x = np.cumsum(rng.normal(0, 0.3, (n, p)), axis=0) * 0.05 + rng.normal(0, 3, (n, p)) + 1e6
    # A rhythm of its own in every channel, twice as strong over the two sides.
    for c, name in enumerate(schemas.CHANNELS):
        away = {"c4": 2, "c3": 3}.get(name)
        rhythm = np.sin(2 * np.pi * (10 + 0.05 * c) * np.arange(n) / FS + rng.uniform(0, 6))
        x[:, c] += rhythm * (2.5 if away is None else np.where(state == away, 5 * (1 - effect), 5.0))
    frame = np.arange(int(FS / fs_nirs), n, FS / fs_nirs).astype(np.int64) // 10 * 10
    hb = rng.normal(0, 0.2, (len(frame), 18))
    for name, side in (("right", 2), ("left", 3)):
        drive = np.convolve(state == side, np.ones(int(4 * FS)) / (4 * FS))[:n]
        hb[:, list(schemas.NIRS_REGIONS[name])] += effect * drive[np.minimum(frame, n - 1)][:, None]
    return x, frame, hb


def recordings(spark: SparkSession, subjects: int = 2, each: int = 2, blocks: int = 3, trials: int = 2, prep: float = 1.0, task: float = 4.0, fs_nirs: float | None = FS_NIRS, effect: float = 0.8, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, eeg, nirs) tables of small recordings."""
    ids = [(f"s{u * each + k:03d}_N{u:02d}", f"N{u:02d}", seed + 1000 * u + k) for u in range(subjects) for k in range(each)]
    todo = spark.createDataFrame(ids, "session_id string, subject string, seed int").repartition(len(ids), "session_id")

    def eeg(batches):
        for t in batches:
            for r in t.itertuples():
                state, block = _plan(r.seed, blocks, trials, prep, task)
                x, _, _ = _signals(r.seed, state, fs_nirs or FS_NIRS, effect)
                yield pd.DataFrame({"session_id": r.session_id, "sample": np.arange(len(state)), "x": list(x), "state": state, "block": block})

    def nirs(batches):
        for t in batches:
            for r in t.itertuples():
                state, block = _plan(r.seed, blocks, trials, prep, task)
                _, frame, hb = _signals(r.seed, state, fs_nirs or FS_NIRS, effect)
                yield pd.DataFrame({"session_id": r.session_id, "seq": np.arange(len(frame)), "frame": frame.astype("int32"), "hbo": list(hb), "hbr": list(-0.4 * hb), "state": state[np.minimum(frame, len(state) - 1)], "block": block[np.minimum(frame, len(state) - 1)]})

    n = len(_plan(seed, blocks, trials, prep, task)[0])
    sessions = spark.createDataFrame([(s, u, FS, fs_nirs, fs_nirs is not None, 18 if fs_nirs else None, n) for s, u, _ in ids], schemas.SESSIONS)
    second = todo.mapInPandas(nirs, schemas.NIRS) if fs_nirs else spark.createDataFrame([], schemas.NIRS)
    return sessions, todo.mapInPandas(eeg, schemas.EEG), second
