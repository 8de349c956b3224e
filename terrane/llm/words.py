"""Word-level caches: natural text repeats its words, so work done once per distinct word is reused."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..shipping import trim


class WordTable:
    """Maps words to rows of a float matrix, computing rows only for words not seen before.

    ``compute(words) -> array (len(words), width)``. The table holds at most ``limit`` words and starts afresh
    beyond that; words longer than ``longest`` are computed each time and never kept, so memory is bounded.
    """

    def __init__(self, compute: Callable, width: int, limit: int = 300_000, longest: int = 48):
        self.compute, self.width, self.limit, self.longest = compute, width, limit, longest
        self._reset()

    def _reset(self) -> None:
        self.index: dict = {}
        self.rows = np.zeros((1024, self.width), np.float32)

    def lookup(self, words: list) -> np.ndarray:
        """Row numbers of ``words``, adding those that are missing. Row numbers hold until the next call."""
        get = self.index.get
        found = [get(w) for w in words]
        if None in found:
            missing = [w for w in dict.fromkeys(w for w, i in zip(words, found) if i is None)]
            if len(self.index) + len(missing) > self.limit:
                self._reset()
                missing = list(dict.fromkeys(words))
            n = len(self.index)
            need = n + len(missing)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.width), np.float32)
                grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n:need] = self.compute(missing)
            self.index.update(zip(missing, range(n, need)))
            get = self.index.get
            found = [get(w) for w in words]
            for w in missing:
                if len(w) > self.longest:
                    del self.index[w]
            if any(len(w) > self.longest for w in missing):
                # row numbers stay unique: pad the index with an unused key for each dropped word
                for k, w in enumerate(missing):
                    if len(w) > self.longest:
                        self.index[(n + k,)] = n + k
        return np.fromiter(found, np.int64, len(found))


def text_chunks(column: pa.Array, most: int = 400_000):
    """Yield (first, last, texts) for ranges of an Arrow column of texts of about ``most`` bytes each, one text at least."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > first and size + n > most:
            yield first, i, column.slice(first, i - first).to_pylist()
            first, size = i, 0
        size += n
    if first < len(column):
        yield first, len(column), column.slice(first).to_pylist()


_kept: dict = {}


def release() -> None:
    """Let go of what this Python worker keeps, so that stages of other operators do not pay for it."""
    if _kept:
        _kept.clear()
        trim()


def kept(key, make: Callable):
    """``make()``, kept between the tasks of a Python worker until another key is asked for."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]
