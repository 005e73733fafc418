"""The online path as stateful stream processors: samples in, grid windows or answers out, whatever the micro-batches.

State per session is what the filters remember, the last window of samples, samples that came early and, for answers, the
windows so far; all of it plain numbers in typed columns. Results equal those of the batch plan because both push the same
samples through the same kernels in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import spd
from ..operators import decode
from ..operators.signal import FrontEnd, spatial_matrix

WINDOWS = "session_id string, end_sample bigint, label int, block int, homogeneous boolean, power array<double>"
_EARLY = ["sample", "x", "state", "block"]
_KEPT = ["k", "label", "block", "homogeneous", "trained", "moments"]
#: Of each remembered sample: state, block, where its run of one state began, and which channels stood still.
_STATE, _BLOCK, _RUN, _STILL = 0, 1, 2, 3


class Samples(StatefulProcessor):
    """Takes a session's samples in order of their number and gives the windows they complete to `emitted`.

    Samples that come again are left out. Those ahead of a gap wait in state until it is filled; a gap that is still open when
    `most_early` samples wait is an error, as nothing after it could ever be answered.
    """

    def __init__(self, bands, order: int, highpass: float, fs: float, most_early: int = 15_000, preps: tuple = ()):
        self.settings, self.most_early = (bands, order, highpass, fs, preps), most_early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.front = handle.getValueState("front", "seen bigint, first array<double>, tail array<double>, memory array<double>, labels array<bigint>, last array<double>")
        self.early = handle.getListState("early", "sample bigint, x array<double>, state int, block int")

    def emitted(self, key: tuple, ends: list[int], covs: np.ndarray, cut: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self.pushed(key, [r[_EARLY] for r in rows])

    def pushed(self, key: tuple, rows: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front, labels, last = FrontEnd(*self.settings), np.zeros((0, 0), dtype=np.int64), None
        if self.front.exists():
            *kept, flat, last = self.front.get()
            front = front.thaw(*kept)
            if len(flat):
                labels = np.asarray(flat, dtype=np.int64).reshape(-1, _STILL + len(last))
        waiting = pd.DataFrame(list(self.early.get()), columns=_EARLY) if self.early.exists() else pd.DataFrame(columns=_EARLY)
        new = pd.concat(rows + ([waiting] if len(waiting) else [])) if rows or len(waiting) else waiting
        new = new[new["sample"] >= front.seen].drop_duplicates("sample").sort_values("sample")
        ready = new["sample"].to_numpy() == front.seen + np.arange(len(new))
        later, new = new[~ready], new[ready]
        if len(later) > self.most_early:
            raise ValueError(f"session {key[0]}: sample {front.seen + len(new)} is missing and {len(later)} wait for it")
        if len(new):
            x = np.stack(new["x"].to_numpy()).astype(float)
            labels = self._marked(labels, new, x, last, front.seen)
            ends, covs = front.push(x)
            base = front.seen - len(labels)
            cut = [labels[e - front.win - base : e - base] for e in ends]
            labels, last = labels[-(front.win - 1) :], x[-1].tolist()
            if ends:
                yield from self.emitted(key, ends, covs, cut)
        self.front.update((*front.frozen(), labels.ravel().tolist(), list(last) if last is not None else []))
        if len(later):
            self.early.put([(int(r.sample), [float(v) for v in r.x], int(r.state), int(r.block)) for r in later.itertuples()])
        elif len(waiting):
            self.early.clear()

    @staticmethod
    def _marked(labels: np.ndarray, new: pd.DataFrame, x: np.ndarray, last: list | None, seen: int) -> np.ndarray:
        """The remembered samples and the new ones after them."""
        state, block = new["state"].to_numpy(dtype=np.int64), new["block"].to_numpy(dtype=np.int64)
        before = np.concatenate([[labels[-1, _STATE] if len(labels) else -1], state[:-1]])
        run = np.where(state != before, seen + np.arange(len(state)), -1)
        if run[0] < 0:
            run[0] = labels[-1, _RUN]
        still = np.diff(np.vstack([x[:1] + 1 if last is None or not len(last) else np.asarray(last)[None], x]), axis=0) == 0
        own = np.column_stack([state, block, np.maximum.accumulate(run), still.astype(np.int64)])
        return np.concatenate([labels, own]) if len(labels) else own

    def close(self) -> None:
        pass


def _same(c: np.ndarray) -> bool:
    """Whether a window's samples are of one labelled state and one block."""
    c = c[:, :_RUN]
    return bool((c == c[0]).all() and c[0, 0] > 0)


class GridWindows(Samples):
    """Emits (session_id, end_sample, label, block, homogeneous, power): log power per band and channel at grid ends."""

    def emitted(self, key: tuple, ends: list[int], covs: np.ndarray, cut: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        power = np.log(np.maximum(np.einsum("kbii->kbi", covs), 1e-300)).reshape(len(ends), -1)
        yield pd.DataFrame({"session_id": key[0], "end_sample": ends, "label": [int(c[-1, 0]) for c in cut], "block": [int(c[-1, 1]) for c in cut], "homogeneous": [_same(c) for c in cut], "power": list(power)})


class Answers(Samples):
    """Emits decode.ANSWERS for windows as they are completed, by models of all blocks before theirs.

    A block that has begun is answered by a fit on those before; the fit is made again in each micro-batch that asks for it, from
    the windows in state, which are some thousand numbers each. The configuration is that of the batch plan, without the second
    stream and without bad channels (which only the end of block 1 can tell); `model` is a cross-subject model to mix in.
    """

    def __init__(self, cfg: dict, fs: float = 250.0, model: dict | None = None):
        e = cfg["eeg"]
        super().__init__(e["bands"], e["band_order"], e["hp_hz"], fs)
        self.cfg = {**cfg, "nirs": {**cfg["nirs"], "enabled": False}}
        self.matrix, _ = spatial_matrix(tuple(e["channels"]), e["reference"])
        self.model = pd.DataFrame([model]) if model else pd.DataFrame()

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.windows = handle.getListState("windows", "k bigint, label int, block int, homogeneous boolean, trained boolean, moments array<double>")

    def emitted(self, key: tuple, ends: list[int], covs: np.ndarray, cut: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        e, win = self.cfg["eeg"], FrontEnd(*self.settings).win
        step = FrontEnd(*self.settings).step
        m = spd.congruence(self.matrix, covs)
        rows = [((end - win) // step, int(c[-1, 0]), int(c[-1, 1]), _same(c), _same(c), x.ravel().tolist()) for end, c, x in zip(ends, cut, m, strict=True)]
        old = [tuple(r) for r in self.windows.get()] if self.windows.exists() else []
        self.windows.appendList(rows)
        w = pd.DataFrame(old + rows, columns=_KEPT)
        w["fresh"] = np.arange(len(w)) >= len(old)
        w["start_sample"], w["end_sample"] = w["k"] * step, w["k"] * step + win
        x = np.stack(w["moments"].to_numpy()).reshape(len(w), *m.shape[1:])
        n = e["cov_avg_n"]
        x = sum(x[np.maximum(np.arange(len(x)) - j, 0)] for j in range(n)) / n
        w["spd"] = list(spd.estimate(x, win, e["cov"], e["cov_eps"]).reshape(len(w), -1))
        yield decode.decoder(self.cfg, len(self.matrix))(key, w, self.model)


def _processed(eeg: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return eeg.groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def grid_windows(eeg: DataFrame, cfg: dict, fs: float = 250.0) -> DataFrame:
    """Grid windows of a stream of samples (session_id, sample, x, state, block); needs the RocksDB state store."""
    return _processed(eeg, GridWindows(cfg["bands"], cfg["band_order"], cfg["hp_hz"], fs), WINDOWS)


def answers(eeg: DataFrame, cfg: dict, fs: float = 250.0, model: dict | None = None) -> DataFrame:
    """Answers of a stream of samples, as log-probabilities for operators.fusion to mix and fuse."""
    return _processed(eeg, Answers(cfg, fs, model), decode.ANSWERS)


def both_streams(eeg: DataFrame, nirs: DataFrame, sessions: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """One stream of two: samples of either kind with the slow stream's rate of their session (null where it has none), and
    `closed` sessions (session_id), after which nothing is waited for. `sessions` is a table."""
    rate = F.broadcast(sessions.select("session_id", F.when(F.col("has_nirs"), F.col("fs_nirs")).alias("rate")))
    none = lambda t: F.lit(None).cast(t)
    a = eeg.select("session_id", F.lit("eeg").alias("kind"), F.col("sample").cast("long").alias("sample"), none("long").alias("frame"), "x", none("array<double>").alias("hbo"), none("array<double>").alias("hbr"), "state", "block")
    b = nirs.select("session_id", F.lit("nirs").alias("kind"), F.col("seq").cast("long").alias("sample"), F.col("frame").cast("long").alias("frame"), none("array<double>").alias("x"), "hbo", "hbr", none("int").alias("state"), none("int").alias("block"))
    out = a.unionByName(b)
    if closed is not None:
        out = out.unionByName(closed.select("session_id", F.lit("end").alias("kind")), allowMissingColumns=True)
    return out.join(rate, "session_id", "left")


def online(samples: DataFrame, cfg: dict, fs: float = 250.0, model: dict | None = None, patience_ms: int | None = None) -> DataFrame:
    """Final answers (online.FINAL) of both_streams(): what plans.session.run gives, whatever the micro-batches. With `patience_ms` a
    window whose slow samples don't come is answered with those delivered, that long after the session's last input."""
    from .online import FINAL, Online

    mode = "None" if patience_ms is None else "ProcessingTime"
    return samples.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Online(cfg, fs, model, patience_ms), outputStructType=FINAL, outputMode="Append", timeMode=mode)


def trailing_counts(events: DataFrame, width: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Windowed counts and means of an event stream with a bound on lateness."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
