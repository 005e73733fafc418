"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The pieces and scores come from a SentencePiece model file. Text is marked (a space becomes U+2581, one goes before the
text) and cut into words where no piece can cross. The distinct words of a batch that are not known yet are sorted, which is
the order of a depth-first walk of their trie: the forward scores of what a word shares with the one before stay, and only
the rest is scored. Characters that no piece covers become byte pieces, or the unknown piece where the model has none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, lean, model_path, small_batches, texts
from .word_ids import WordIds, laid_out

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: A worker keeps this part of the words that WordIds would: they stay in it when later stages need its executor's memory.
KEPT_PART = 4


class Pieces:
    """The Viterbi walker of one model. Normalisation other than marking isn't applied, so decoding gives the text back."""

    def __init__(self, path: str, prefix: bool = True):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        self.prefix = prefix
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.unknown = sp.unk_id()
        self.bytes: list[bytes] = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b" \xe2\x81\x87 " if i == self.unknown else b"")
            else:
                self.score[p], self.id[p] = sp.get_score(i), i
                self.bytes.append(p.replace(MARK, " ").encode())
        self.out = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        sizes: dict[str, set] = {}
        for p in self.score:
            if len(p) > 1:
                sizes.setdefault(p[-2:], set()).add(len(p))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}  # longer pieces win ties
        crossing = any(MARK in p.lstrip(MARK) for p in self.score)
        used = {c for p in self.score if len(p) > 1 for c in p}
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in used))
        self.simple = prefix and not crossing
        self.words = re.compile(".+" if crossing else f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+", re.DOTALL)
        self.kept = WordIds(lambda words, _: laid_out(self.encode_words(words)), by_place=False, part=KEPT_PART)

    def _ids(self, word: str, back: list[int]) -> list[int]:
        out, at = [], len(word)
        while at:
            p = word[back[at] : at]
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in reversed(p.encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
            at = back[at]
        return out[::-1]

    def walk(self, words: set[str]) -> dict[str, list[int]]:
        """Encodes distinct marked words in one walk of their trie."""
        score, sizes, out = self.score.get, self.sizes.get, self.out
        best, back, before, found = [0.0], [0], "", {}
        for word in sorted(words):
            n, most = 0, min(len(before), len(word))
            while n < most and before[n] == word[n]:
                n += 1
            del best[n + 1 :], back[n + 1 :]
            for at in range(n, len(word)):
                end, top, start = at + 1, None, at
                for k in sizes(word[at - 1 : end], ()) if at else ():
                    if k <= end:
                        s = score(word[end - k : end])
                        if s is not None and (top is None or best[end - k] + s > top):
                            top, start = best[end - k] + s, end - k
                s = best[at] + score(word[at], out)
                if top is None or s > top:
                    top, start = s, at
                best.append(top), back.append(start)
            before = word
            found[word] = self._ids(word, back)
        return found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words of a text that spaces parted."""
        cut = [self.words.findall(MARK + w) for w in words]
        ids = self.walk({p for ps in cut for p in ps})
        return [ids[ps[0]] if len(ps) == 1 else [i for p in ps for i in ids[p]] for ps in cut]

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text as uint32; an empty text has none.

        A text with single spaces only is cut at them, and the ids of its words are kept between batches.
        """
        simple = [self.simple and MARK not in t and "  " not in t and t[:1] != " " and t[-1:] != " " for t in batch]
        easy = iter(self.kept.encode([t for t, s in zip(batch, simple, strict=True) if s]))
        head = MARK if self.prefix else ""
        cut = [[] if s or not t else self.words.findall(head + t.replace(" ", MARK)) for t, s in zip(batch, simple, strict=True)]
        ids = self.walk({w for ws in cut for w in ws})
        return [next(easy) if s else np.array([i for w in ws for i in ids[w]], dtype=np.uint32) for ws, s in zip(cut, simple, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return data.decode("utf-8", "surrogatepass")[1 if self.prefix else 0 :]


@lru_cache(maxsize=2)
def walker_of(path: str) -> Pieces:
    """A worker keeps the walker of a model, with the words it knows, for later tasks."""
    return Pieces(path)


def encoded(path: str, keep: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = walker_of(path)
        for batch in by_bytes(batches, 1 << 20):
            ts = texts(batch)
            ids = walker.encode(ts)
            back = [walker.decode(x) for x in ids]
            cols = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
            cols += [pa.array([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back]), pa.array([b == t for b, t in zip(back, ts, strict=True)])]
            names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"]
            if keep:
                cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def default_model() -> str:
    """A public model by its name: each task finds the file on its own machine."""
    return "piece_bpe_32k.model"


def encode(docs: DataFrame, model: str, keep: bool = True) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_crc32 (of the uint32 ids), decoded_sha256, round_trip and, if `keep`, ids.

    Null and empty texts have no pieces and decode to the empty text. A text that itself holds U+2581 decodes to spaces
    there, so its round_trip is false. Other columns are ignored; every row gives one row; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep
    return docs.select("doc_id", "text").mapInArrow(encoded(model, keep), schema)
