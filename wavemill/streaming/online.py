"""Both streams of a session in one stateful processor: final answers as samples arrive.

Samples of either stream are taken in the order of their numbers. A window is answered when its own samples are there and the slow
stream has gone past its end, so answers do not depend on how the streams interleave: every window sees the slow samples with a
frame up to its end, every fit those up to the end of its block, and bad channels are settled when block 1 is over. State per
session is what filters remember, the tails that trailing features reach back to, sums by block, the windows so far, and what the
smoothing of either stream holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessorHandle

from ..functions import classify, filters, spd
from ..operators import decode, signal
from ..operators.signal import FrontEnd, spatial_matrix
from ..sources.schemas import CHANNELS
from .processor import _BLOCK, _EARLY, _RUN, _STATE, _STILL, Samples, _same

FINAL = "session_id string, start_sample bigint, end_sample bigint, block int, true_y int, y int, y_eeg int, y_nirs int, probs array<double>"
_WINDOW = "k bigint, label int, block int, homogeneous boolean, trained boolean, flat array<double>, moments array<double>, slow array<double>"
_NAMES = [c.split()[0] for c in _WINDOW.split(", ")]


class Slow:
    """The second stream up to a point: filters, the tail that features reach back to, and sums by block of what mixes follow from."""

    def __init__(self, cfg: dict, rate: float, channels: int):
        self.cfg, self.rate, self.channels = cfg, rate, channels
        self.streams = [filters.Stream(filters.butterworth(2, hz, rate, kind)) for hz, kind in ((cfg["hp_hz"], "highpass"), (cfg["lp_hz"], "lowpass")) if 0 < hz < rate / 2]
        decay = float(np.exp(-1 / (cfg["base_tau_s"] * rate)))
        self.base = filters.Stream(np.array([[1 - decay, 0.0, 0.0, 1.0, -decay, 0.0]]))
        reach = max(cfg["mvp_long"], cfg["mvp_lag"] + cfg["mvp_short"]) if cfg["features"] == "mvp" else max(cfg["lags_s"]) + max(cfg["level_s"], cfg["slope_s"])
        self.reach = int(round(reach * rate)) + 2
        width = 2 * channels + 2
        self.seen, self.first = 0, None
        self.y, self.slow = np.zeros((0, width)), np.zeros((0, width))
        self.sums: dict[int, np.ndarray] = {}

    def push(self, hbo: np.ndarray, hbr: np.ndarray, fits: np.ndarray) -> None:
        """Takes samples with the fit that each counts for."""
        x = np.hstack([hbo, hbr, hbo.mean(axis=1, keepdims=True), hbr.mean(axis=1, keepdims=True)])
        for f in self.streams:
            x = f(x)
        self.first = x[0] if self.first is None else self.first
        if signal.refits(self.cfg):
            m = signal.pair_moments(x - self.first)
            for fit in np.unique(fits).tolist():
                own = np.concatenate([[float((fits == fit).sum())], m[fits == fit].sum(axis=0)])
                self.sums[fit] = self.sums.get(fit, 0.0) + own
        self.seen += len(x)
        self.y, self.slow = (np.concatenate([a, b])[-self.reach :] for a, b in ((self.y, x), (self.slow, self.base(x))))

    def features(self) -> np.ndarray:
        """As of the last sample; mixed where the mix is fixed, else of all signals."""
        raw = signal.trailing(self.y, self.slow, np.array([len(self.y)]), self.cfg, self.rate)
        return (raw if signal.refits(self.cfg) else signal.mixed_features(raw, signal.slow_mix(self.cfg, self.channels)))[0]

    def mixes(self) -> list[dict]:
        """What each fit's mix follows from: running sums over the blocks up to its own."""
        out, total = [], 0.0
        for fit in sorted(self.sums):
            total = total + self.sums[fit]
            n = total[0]
            x, xx, g, gg, xg = (total[1:] / n).reshape(5, -1)
            sd = np.sqrt(np.maximum(xx - x * x, 0)) + 1e-12
            beta = (xg - x * g) / (np.maximum(gg - g * g, 0) + 1e-30 / n)
            half = len(sd) // 2
            out.append({"fit": fit, "ratio": sd[:half] / sd[half:] if n >= 10 else None, "beta": beta if n >= 10 else None})
        return out

    def frozen(self) -> tuple:
        memory = [f.state.ravel() for f in (*self.streams, self.base) if f.state is not None]
        fits = sorted(self.sums)
        return (self.channels, self.seen, [] if self.first is None else self.first.tolist(), self.y.ravel().tolist(), self.slow.ravel().tolist(), np.concatenate(memory).tolist() if memory else [], fits, [v for f in fits for v in self.sums[f].tolist()])

    def thaw(self, seen, first, y, slow, memory, fits, sums) -> Slow:
        width, at = 2 * self.channels + 2, 0
        self.seen = seen
        if len(first):
            self.first = np.asarray(first, dtype=float)
            self.y, self.slow = (np.asarray(v, dtype=float).reshape(-1, width) for v in (y, slow))
            for f in (*self.streams, self.base):
                n = len(f.sos) * 2 * width
                f.state = np.asarray(memory[at : at + n], dtype=float).reshape(len(f.sos), 2, width)
                at += n
        if len(fits):
            self.sums = dict(zip(fits, np.asarray(sums, dtype=float).reshape(len(fits), -1), strict=True))
        return self


SLOW = "rate double, channels int, seen bigint, first array<double>, y array<double>, slow array<double>, memory array<double>, fits array<int>, sums array<double>"


class Online(Samples):
    """Emits FINAL for windows of one class in blocks after the first.

    `model` is a cross-subject model to mix in. A session whose rate is null has no slow stream and waits for none. Trained filters
    and the eye-movement control are for the batch plan only.
    """

    def __init__(self, cfg: dict, fs: float = 250.0, model: dict | None = None, patience_ms: int | None = None):
        e = cfg["eeg"]
        if e["csp"]["enabled"] or e["features"] == "heog":
            raise ValueError("online answers have no trained filters and no eye movements")
        super().__init__(e["bands"], e["band_order"], e["hp_hz"], fs)
        self.cfg, self.fs, self.patience = cfg, fs, patience_ms
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.windows = handle.getListState("windows", _WINDOW)
        self.pending = handle.getListState("pending", _WINDOW)
        self.late = handle.getListState("late", "sample bigint, frame bigint, hbo array<double>, hbr array<double>")
        self.slow = handle.getValueState("slow", SLOW)
        self.marks = handle.getValueState("marks", "rate double, known boolean, closed boolean, settled boolean, bad array<int>, blocks array<int>, ends array<bigint>, le array<double>, ln array<double>")

    # what is known of a session between batches
    def _marks(self) -> dict:
        names = ("rate", "known", "closed", "settled", "bad", "blocks", "ends", "le", "ln")
        if not self.marks.exists():
            return dict(zip(names, (None, False, False, False, [], [], [], [], []), strict=True))
        return dict(zip(names, self.marks.get(), strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = list(rows)
        m = self._marks()
        for r in parts:
            if len(r) and not m["known"] and (r["kind"] != "end").any():
                rate = r.loc[r["kind"] != "end", "rate"].iloc[0]
                m["rate"], m["known"] = None if rate is None or np.isnan(rate) else float(rate), True
            m["closed"] = bool(m["closed"] or (r["kind"] == "end").any())
        self.now = m
        list(self.pushed(key, [r.loc[r["kind"] == "eeg", _EARLY] for r in parts]))
        self._keep_slow([r.loc[r["kind"] == "nirs", ["sample", "frame", "hbo", "hbr"]] for r in parts])
        yield from self._answered(key, m, m["closed"])
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if self.pending.exists():
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._answered(key, self._marks(), True)

    def emitted(self, key: tuple, ends: list[int], covs: np.ndarray, cut: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        """Windows whose samples are complete wait for the slow stream."""
        m, front = self.now, FrontEnd(*self.settings)
        found = dict(zip(m["blocks"], m["ends"], strict=True))
        skip = int(round(self.cfg["eeg"]["train_skip_s"] * self.fs))
        out = []
        for e, c, s in zip(ends, cut, covs, strict=True):
            for b in np.unique(c[:, _BLOCK]).tolist():
                last = e - len(c) + int(np.flatnonzero(c[:, _BLOCK] == b)[-1]) + 1
                found[int(b)] = max(last, found.get(int(b), 0))
            same, start = _same(c), e - front.win
            out.append(((e - front.win) // front.step, int(c[-1, _STATE]), int(c[-1, _BLOCK]), same, bool(same and start >= c[0, _RUN] + skip), c[:, _STILL:].mean(axis=0).tolist(), s.ravel().tolist(), None))
        self.pending.appendList(out)
        m["blocks"], m["ends"] = list(found), [int(v) for v in found.values()]
        yield from ()

    def _keep_slow(self, rows: list[pd.DataFrame]) -> None:
        new = [(int(r.sample), int(r.frame), [float(v) for v in r.hbo], [float(v) for v in r.hbr]) for t in rows for r in t.itertuples()]
        if new:
            self.late.appendList(new)

    def _slow_until(self, m: dict):
        """(the slow stream, its samples that are next in order, their frames)"""
        state = self.slow.get() if self.slow.exists() else None
        late = sorted({r[0]: tuple(r) for r in self.late.get()}.values()) if self.late.exists() else []
        slow = None
        if state is not None:
            slow = Slow(self.cfg["nirs"], state[0], state[1]).thaw(*state[2:])
        elif late:
            slow = Slow(self.cfg["nirs"], m["rate"], len(late[0][2]))
        seen = slow.seen if slow else 0
        late = [r for r in late if r[0] >= seen]
        ready = 0
        while ready < len(late) and late[ready][0] == seen + ready:
            ready += 1
        if len(late) - ready > self.most_early:
            raise ValueError(f"slow sample {seen + ready} is missing and {len(late) - ready} wait for it")
        return slow, late, ready

    def _answered(self, key: tuple, m: dict, whole: bool) -> Iterator[pd.DataFrame]:
        """Answers pending windows in order, as far as the slow stream goes, or all of them."""
        front, second = FrontEnd(*self.settings), self.cfg["nirs"]["enabled"] and m["rate"] is not None
        pending = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        slow, late, ready = self._slow_until(m) if second else (None, [], 0)
        ends = dict(sorted(zip(m["blocks"], m["ends"], strict=True)))
        fresh, used, frames = [], 0, np.array([r[1] for r in late[:ready]])
        for row in pending:
            e = row[0] * front.step + front.win
            if second and not whole and not (ready and frames[-1] > e):
                break
            if second:
                to = int(np.searchsorted(frames, e, side="right"))
                if to > used:
                    part = late[used:to]
                    done = [(end, b) for b, end in ends.items() if b > 0]
                    fits = np.array([min((b for end, b in done if end >= r[1]), default=max(ends)) for r in part])
                    slow.push(np.array([r[2] for r in part]), np.array([r[3] for r in part]), fits)
                    used = to
            fresh.append((*row[:7], slow.features().tolist() if second and slow is not None and slow.seen else None))
        if not fresh:
            self._store(m, slow, late)
            return
        rest = pending[len(fresh) :]
        old = [tuple(r) for r in self.windows.get()] if self.windows.exists() else []
        old, fresh, m = self._settled(old, fresh, m)
        w = pd.DataFrame(old + fresh, columns=_NAMES)
        w["fresh"] = np.arange(len(w)) >= len(old)
        yield from self._final(key, w, m, slow)
        self.windows.put(old + fresh)
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        self._store(m, slow, late[used:])

    def _store(self, m: dict, slow: Slow | None, late: list) -> None:
        self.marks.update(tuple(m[k] for k in ("rate", "known", "closed", "settled", "bad", "blocks", "ends", "le", "ln")))
        if slow is not None:
            self.slow.update((slow.rate, *slow.frozen()))
        if late:
            self.late.put(late)
        elif self.late.exists():
            self.late.clear()

    def _settled(self, old: list, fresh: list, m: dict):
        """Windows of the chosen channels once block 1 is over and its bad channels are known; of all channels until then."""
        if not m["settled"]:
            e, whole = self.cfg["eeg"], old + fresh
            if not any(r[2] > 1 for r in whole):
                return old, fresh, m
            if e["bad_channels"]:
                first = [r for r in whole if r[2] == 1]
                p = len(CHANNELS)
                power = np.array([np.log(np.maximum(np.einsum("bii->i", np.reshape(r[6], (-1, p, p))), 1e-300)) for r in first])
                if len(first) >= 8:
                    med = np.median(power, axis=0)
                    d, flat = med - np.median(med), np.mean([r[5] for r in first], axis=0)
                    wrong = (flat > e["bad_flat_frac"]) | (d > np.log(e["bad_ratio"])) | (d < -np.log(50 * e["bad_ratio"]))
                    m = {**m, "bad": np.flatnonzero(wrong).tolist()}
            old, fresh, m = [self._mapped(r, m) for r in old], fresh, {**m, "settled": True}
        return old, [self._mapped(r, m) for r in fresh], m

    def _mapped(self, row: tuple, m: dict) -> tuple:
        e, p = self.cfg["eeg"], len(CHANNELS)
        matrix, _ = spatial_matrix(tuple(e["channels"]), e["reference"], tuple(CHANNELS[i] for i in m["bad"]), interpolate=True)
        return (*row[:6], spd.congruence(matrix, np.reshape(row[6], (-1, p, p))).ravel().tolist(), row[7])

    def _final(self, key: tuple, w: pd.DataFrame, m: dict, slow: Slow | None) -> Iterator[pd.DataFrame]:
        if not m["settled"]:
            return
        e, front, p = self.cfg["eeg"], FrontEnd(*self.settings), len(self.cfg["eeg"]["channels"])
        w["start_sample"], w["end_sample"] = w["k"] * front.step, w["k"] * front.step + front.win
        x = np.stack(w["moments"].to_numpy()).reshape(len(w), -1, p, p)
        x = sum(x[np.maximum(np.arange(len(x)) - j, 0)] for j in range(e["cov_avg_n"])) / e["cov_avg_n"]
        w["spd"] = list(spd.estimate(x, front.win, e["cov"], e["cov_eps"]).reshape(len(w), -1))
        cfg = {**self.cfg, "nirs": {**self.cfg["nirs"], "enabled": bool(self.cfg["nirs"]["enabled"] and slow is not None)}}
        none = {"mu": None, "sd": None, "w": None, "b": None}
        other = pd.DataFrame([{**(self.model or none), "mixes": slow.mixes() if slow is not None else None}])
        found = decode.decoder(cfg, p)(key, w, other).sort_values("k")
        rows = [self._one(key, r, m) for r in found.itertuples()]
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINAL.split(", ")]).astype({"y_nirs": object})

    def _one(self, key: tuple, r, m: dict) -> tuple:
        """Mixes, smooths, fuses and biases one window's answers; `m` holds what the smoothing remembers."""
        cfg = self.cfg
        of = lambda v: None if v is None or (np.isscalar(v) and np.isnan(v)) else np.asarray(v, dtype=float)
        ls, lg, ln = of(r.ls), of(r.lg), of(r.ln)
        le = decode.mixed(ls, lg, r.fit, cfg["global"]["k"])
        le = np.full(3, -np.log(3)) if le is None else le
        a, an = decode.rates(cfg)
        le = self._smoothed(m, "le", le, a)
        if ln is not None:
            ln = self._smoothed(m, "ln", ln, an) if an else ln
        fused = le if ln is None else decode.fused(le[None], ln[None], cfg["fusion"])[0]
        bias = {n: self._bias(n, of(getattr(r, f"b_{n}")), r.fit) for n in ("hyb", "eeg", "nirs")}
        y = int(np.argmax(fused + bias["eeg" if ln is None else "hyb"])) + 1
        y_nirs = None
        if m["rate"] is not None and cfg["nirs"]["enabled"]:
            y_nirs = 1 if ln is None else int(np.argmax(ln + bias["nirs"])) + 1
        return key[0], r.start_sample, r.end_sample, r.block, r.label, y, int(np.argmax(le + bias["eeg"])) + 1, y_nirs, fused.tolist()

    def _smoothed(self, m: dict, name: str, v: np.ndarray, keep: float) -> np.ndarray:
        """The exponential mean over calls; in log space normalised again, else of probabilities."""
        log = self.cfg["smoothing"]["space"] == "log"
        if not keep:
            return v
        x = v if log else np.exp(v)
        before = m[name]
        now = x if before is None or not len(before) else keep * np.asarray(before) + (1 - keep) * x
        m[name] = now.tolist()
        return classify.log_softmax(now) if log else np.log(now + 1e-9)

    def _bias(self, name: str, own: np.ndarray | None, fit: int) -> np.ndarray:
        b = self.cfg["bias"]
        prior = np.asarray(self.cfg["fusion"].get("bias", {}).get(name, (0.0, 0.0, 0.0)) if b["mode"] != "none" else (0.0, 0.0, 0.0), dtype=float)
        if b["mode"] == "session" and own is not None:
            part = fit / (fit + float(b["shrink_k"]))
            prior = part * own + (1 - part) * prior
        return prior + np.asarray(b["fixed"], dtype=float)
