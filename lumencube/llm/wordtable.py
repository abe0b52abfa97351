"""Numbers kept for each distinct word inside a Python worker, computed for many new words at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, each between marks '<' and '>'; and the word each belongs to."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    return codes, owner


class WordTable:
    """Word -> row of an array of `width` numbers; forgets all words when it holds `most`, so its memory is bounded."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, most: int = 250_000):
        self.compute, self.width, self.most = compute, width, most
        self.row: dict[str, int] = {}
        self.values = np.empty((1024, width), np.float32)

    def rows(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all words of all docs, one row a word, and where each doc starts (and the end)."""
        new = set().union(*docs).difference(self.row)
        if len(self.row) + len(new) > self.most:
            self.row.clear()
            new = set().union(*docs)
        if new:
            fresh, n = sorted(new), len(self.row)
            if n + len(fresh) > len(self.values):
                grown = np.empty((max(2 * len(self.values), n + len(fresh)), self.width), np.float32)
                grown[:n] = self.values[:n]
                self.values = grown
            for k in range(0, len(fresh), 20_000):
                part = fresh[k : k + 20_000]
                self.values[n + k : n + k + len(part)] = self.compute(part)
            self.row.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        get = self.row.__getitem__
        index = np.fromiter((i for d in docs for i in map(get, d)), np.int64, int(at[-1]))
        return self.values[index], at


def chunks(texts, most_chars: int = 400_000):
    """Consecutive texts in lists of at most about most_chars characters (a longer text stands alone)."""
    part, n = [], 0
    for t in texts:
        t = t or ""
        if part and n + len(t) > most_chars:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part
