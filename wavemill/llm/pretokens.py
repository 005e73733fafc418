"""Ids of whole texts from a byte-level BPE of the tokenizers library, each distinct word encoded once.

The library cuts a text into pre-tokens and encodes each by itself. A space before a character that isn't white space always
begins a pre-token, so a text without longer runs of white space about its spaces can be cut at the spaces: distinct words go
through the library, and texts are put together from the results. Other texts, those that hold an added token, and
tokenizers of another make go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .common import model_path
from .word_ids import WordIds, laid_out

#: White space beyond ASCII, as both the library and Unicode have it; next to a space it makes a run.
WIDE = re.compile("[\x85\xa0  -     　]")
#: ASCII white space but space and line break, and what `re` alone takes for white space.
ODD = re.compile("[\t\v\f\r\x1c-\x1f]")
#: Words in one call of the library.
CALL = 4_000


def has_run(text: str) -> bool:
    """Whether a cut at spaces could go through a run of white space."""
    if text[-1:] == " " or "  " in text or " \n" in text or "\n " in text:
        return True
    return ODD.search(text) is not None or (not text.isascii() and WIDE.search(text) is not None)


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to their ids as uint32; `path` is that of a tokenizer file, or the name of a public one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(model_path(path))
    spec = json.loads(library.to_str())
    kind = spec.get("pre_tokenizer") or {}
    cut = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer")
    line = library.encode("\n", add_special_tokens=False).ids
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def whole(batch: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in library.encode_batch_fast(batch, add_special_tokens=False)]

    def each(words: list[str], first: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Many words in one text, a line each: a line break before a word or before one space and a word is a pre-token by
        itself, so its id parts the words. Words that hold white space themselves go one by one."""
        bare = [k for k, w in enumerate(words) if len(w.split()) == 1] if len(line) == 1 else []
        words = [w if f else " " + w for w, f in zip(words, first, strict=True)]
        place, size = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int32)
        parts, at, done = [], 0, np.zeros(len(words), dtype=bool)
        for k in range(0, len(bare), CALL):
            which = bare[k : k + CALL]
            ids = np.array(library.encode_batch_fast(["\n".join([words[i] for i in which])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            end = np.append(np.flatnonzero(ids == line[0]), len(ids))
            if len(end) == len(which):
                begin = np.append(0, end[:-1] + 1)
                place[which], size[which], done[which] = at + begin, end - begin, True
                parts.append(ids)
                at += len(ids)
        odd = np.flatnonzero(~done)
        flat, spot, n = laid_out([e.ids for e in library.encode_batch_fast([words[i] for i in odd.tolist()], add_special_tokens=False)])
        place[odd], size[odd] = at + spot, n
        return np.concatenate([*parts, flat]), place, size

    known = WordIds(each, by_place=True)

    def encode(batch: list[str]) -> list[np.ndarray]:
        simple = [bool(cut) and not has_run(t) and not any(a in t for a in added) for t in batch]
        easy = iter(known.encode([t for t, s in zip(batch, simple, strict=True) if s]))
        return [next(easy) if s else whole([t])[0] for t, s in zip(batch, simple, strict=True)]

    return encode
