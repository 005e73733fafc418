"""Ids of texts from ids of their words, for tokenizers that never join what a space parts.

Arrow cuts a batch at its spaces and finds its distinct words; the ids of each are asked for once and kept in flat arrays with
the word's bytes, so a worker can keep very many of them, from task to task. A hash finds a word and its bytes confirm it: two
words with one hash never get each other's ids. Texts come out as gathers from those arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .rolling import U, mix, range_hashes

#: Words and bytes of words kept. When there are more, those met again since the last time stay, if they are few enough.
MOST, MOST_BYTES = 1_000_000, 24 << 20


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


class _Grown:
    """A flat array with room at its end."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 16, dtype=dtype), 0

    def add(self, x: np.ndarray) -> int:
        """Where x begins now."""
        while self.used + len(x) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(len(self.data) // 2 + len(x), dtype=self.data.dtype)])
        self.data[self.used : self.used + len(x)] = x
        self.used += len(x)
        return self.used - len(x)


class WordIds:
    """`learn` takes words and whether each begins its text, and gives ids in one array with the place and number of each
    word's; `by_place` tells if it matters that a word begins a text. It keeps MOST // `part` words, and bytes likewise."""

    def __init__(self, learn: Callable[[list[str], list[bool]], tuple], by_place: bool, part: int = 1):
        self.learn, self.by_place, self.part = learn, by_place, part
        self._set(np.zeros(0, dtype=np.int64))

    def _set(self, kept: np.ndarray) -> None:
        """Only the entries `kept` stay."""
        old = self.__dict__.copy() if len(kept) else None
        self.ids, self.text = _Grown(np.uint32), _Grown(np.uint8)
        names = {"keys": np.uint64, "at": np.int64, "size": np.int32, "word": np.int64, "length": np.int32, "again": np.bool_}
        for n, t in names.items():
            setattr(self, n, old[n][kept] if old else np.zeros(0, dtype=t))
        if old:
            self.ids.add(old["ids"].data[spread(self.at, self.size)])
            self.text.add(old["text"].data[spread(self.word, self.length)])
            self.at, self.word = np.cumsum(self.size, dtype=np.int64) - self.size, np.cumsum(self.length, dtype=np.int64) - self.length
            self.again[:] = False

    def _forget(self) -> None:
        most, most_bytes = MOST // self.part, MOST_BYTES // self.part
        if len(self.keys) > most or self.text.used > most_bytes:
            kept = np.flatnonzero(self.again)
            few = len(kept) <= most // 2 and int(self.length[kept].sum()) <= most_bytes // 2
            self._set(kept if few else kept[:0])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of texts that have single spaces only."""
        self._forget()
        full = [t for t in texts if t]
        if not full:
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        words = pc.split_pattern(pa.array(full, pa.large_string()), " ")
        begin = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        entry = coded.indices.to_numpy().astype(np.int64)
        distinct = coded.dictionary
        lead = np.zeros(len(distinct), dtype=bool)
        if self.by_place:  # the words that begin a text are entries of their own
            first, back = np.unique(entry[begin[:-1]], return_inverse=True)
            entry[begin[:-1]] = len(distinct) + back
            distinct = pa.concat_arrays([distinct, distinct.take(pa.array(first))])
            lead = np.append(lead, np.ones(len(first), dtype=bool))
        at, size = self._places(distinct, lead)
        size = size[entry].astype(np.int64)
        ids = self.ids.data[spread(at[entry], size)]
        cut = np.concatenate([[0], np.cumsum(size)])[begin]
        parts = iter(np.split(ids, cut[1:-1]))
        return [next(parts) if t else np.zeros(0, dtype=np.uint32) for t in texts]

    def _places(self, distinct: pa.LargeStringArray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word are, and how many."""
        offsets = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2] or b"", dtype=np.uint8)
        start, end = offsets[:-1], offsets[1:]
        key = mix(range_hashes(data, start, end) + lead)
        found = np.full(len(key), -1, dtype=np.int64)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = np.where((self.keys[spot] == key) & (self.length[spot] == end - start), spot, -1)
        hit = np.flatnonzero(found >= 0)
        n = (end - start)[hit]
        same = data[spread(start[hit], n)] == self.text.data[spread(self.word[found[hit]], n)]
        if not same.all():
            found[hit[np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(~same), side="right"))]] = -1
        self.again[found[found >= 0]] = True
        at, size = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int32)
        at[found >= 0], size[found >= 0] = self.at[found[found >= 0]], self.size[found[found >= 0]]
        new = np.flatnonzero(found < 0)
        if len(new):
            flat, place, size[new] = self.learn(distinct.take(pa.array(new)).to_pylist(), lead[new].tolist())
            at[new] = self.ids.add(flat) + place
            self._keep(new, key, at, size, data, start, end)
        return at, size

    def _keep(self, new: np.ndarray, key, at, size, data, start, end) -> None:
        """New entries for keys that have none; a word whose key belongs to another is learned anew each time."""
        _, one = np.unique(key[new], return_index=True)
        new = new[one]
        spot = np.searchsorted(self.keys, key[new])
        free = (spot == len(self.keys)) | (self.keys[np.minimum(spot, max(0, len(self.keys) - 1))] != key[new]) if len(self.keys) else np.ones(len(new), dtype=bool)
        new, spot = new[free], spot[free]
        n = (end - start)[new]
        word = self.text.add(data[spread(start[new], n)]) + np.cumsum(n) - n
        for name, x in (("keys", key[new]), ("at", at[new]), ("size", size[new]), ("word", word), ("length", n), ("again", False)):
            setattr(self, name, np.insert(getattr(self, name), spot, x))


def laid_out(ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list of ids per word as one array, places and numbers."""
    size = np.fromiter(map(len, ids), np.int32, len(ids))
    return np.fromiter((v for i in ids for v in i), np.uint32, int(size.sum())), np.cumsum(size, dtype=np.int64) - size, size
