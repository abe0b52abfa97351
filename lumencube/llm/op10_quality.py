"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting goes round the features in turn; each step fits a tree of at most four
leaves on one feature alone and adds it to the feature's lookup table. Then the pairs of features whose four quadrants
explain most of what is left get tables of their own in the same way. A score is the sum of one table entry a feature and
pair, found by binning. Training reads the features of at most `max_rows` labelled documents (a parameter).
"""

from __future__ import annotations

from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_ids, held_out, table, with_columns

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "repeated_neighbours", "distinct_lines", "words_a_line",
    "upper", "digits", "symbols", "pipes", "exclamations", "full_stops", "short_words", "mixed_ends",
)
_CLASSES = None


def _class(c: str) -> int:
    """0 other letters, 1 upper case, 2 digit, 3 white space, 4 symbol, 5 | , 6 !, 7 full stop or comma."""
    if c in "|!.,":
        return {"|": 5, "!": 6}.get(c, 7)
    return 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4


def classes(text: str) -> np.ndarray:
    """Class of each code point of a text: 16-bit ones by a table, others by the few different ones that the text has."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = np.array([_class(chr(i)) for i in range(0x10000)], np.uint8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CLASSES[np.minimum(codes, 0xFFFF)]
    wide = codes > 0xFFFF
    if wide.any():
        some, which = np.unique(codes[wide], return_inverse=True)
        out[wide] = np.array([_class(chr(i)) for i in some], np.uint8)[which]
    return out


def features(text: str | None) -> np.ndarray:
    text = text or ""
    n = len(text)
    share = np.bincount(classes(text), minlength=8) / max(1, n)
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    return np.array([
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / m, len(set(words)) / m, sum(map(eq, words, words[1:])) / m,
        len(set(lines)) / len(lines), len(words) / len(lines), share[1], share[2], share[4], share[5], share[6], share[7],
        sum(len(w) < 3 for w in words) / m, sum(not w[-1].isalnum() for w in words) / m,
    ])


class AdditiveModel:
    """Tables of one and two features. Without two classes to learn from, every score is `prior`."""

    def __init__(self, bins: int = 48, coarse: int = 8):
        self.bins, self.coarse, self.prior, self.edges = bins, coarse, 0.5, None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    @staticmethod
    def _leaves(g: np.ndarray, h: np.ndarray, most: int = 4) -> np.ndarray:
        """Values of a greedy tree over ordered bins with gradient sums g and curvature sums h."""
        parts = [(0, len(g))]
        value = lambda a, z: g[a:z].sum() / (h[a:z].sum() + 1.0)
        for _ in range(most - 1):
            best = (1e-9, None, None)
            for a, z in parts:
                if z - a < 2:
                    continue
                cg, ch = np.cumsum(g[a:z])[:-1], np.cumsum(h[a:z])[:-1]
                tg, th = g[a:z].sum(), h[a:z].sum()
                gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (a, z), a + k + 1)
            if best[1] is None:
                break
            parts.remove(best[1])
            parts += [(best[1][0], best[2]), (best[2], best[1][1])]
        out = np.zeros(len(g))
        for a, z in parts:
            out[a:z] = value(a, z)
        return out

    @staticmethod
    def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best cut of a grid in four, its gain, and the values."""
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

        def four(c: np.ndarray) -> list[np.ndarray]:
            a = c[:-1, :-1]
            b, d, t = c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1]
            return [a, b, d, t - a - b - d]

        gain = sum(x**2 / (y + 1) for x, y in zip(four(cg), four(ch), strict=True))
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        out = np.zeros_like(g)
        for rows in (slice(0, i + 1), slice(i + 1, None)):
            for cols in (slice(0, j + 1), slice(j + 1, None)):
                out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
        return float(gain.max()), out

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15) -> AdditiveModel:
        if not len(y) or y.min() == y.max():
            self.prior = float(y.mean()) if len(y) else 0.5
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        width = [len(e) + 1 for e in self.edges]
        p0 = y.mean()
        self.bias = float(np.log(p0 / (1 - p0)))
        self.tables = [np.zeros(w) for w in width]
        z = np.full(len(y), self.bias)
        for _ in range(rounds):
            for j in range(x.shape[1]):
                p = 1 / (1 + np.exp(-z))
                step = rate * self._leaves(np.bincount(b[:, j], y - p, width[j]), np.bincount(b[:, j], p * (1 - p), width[j]))
                self.tables[j] += step
                z += step[b[:, j]]
        self.squeeze = [np.arange(w) * self.coarse // w for w in width]
        c = np.stack([s[b[:, j]] for j, s in enumerate(self.squeeze)], 1)
        grid = lambda i, j, v: np.bincount(c[:, i] * self.coarse + c[:, j], v, self.coarse**2).reshape(self.coarse, -1)
        p = 1 / (1 + np.exp(-z))
        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -self._quadrants(grid(*ij, y - p), grid(*ij, p * (1 - p)))[0])
        self.pairs = {ij: np.zeros((self.coarse, self.coarse)) for ij in ranked[:pairs]}
        for _ in range(pair_rounds):
            for (i, j), t in self.pairs.items():
                p = 1 / (1 + np.exp(-z))
                step = rate * self._quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
                t += step
                z += step[c[:, i], c[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.edges is None:
            return np.full(len(x), self.prior)
        b = self._binned(x)
        z = self.bias + sum(t[b[:, j]] for j, t in enumerate(self.tables))
        c = np.stack([s[b[:, j]] for j, s in enumerate(self.squeeze)], 1)
        z = z + sum(t[c[:, i], c[:, j]] for (i, j), t in self.pairs.items())
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> AdditiveModel:
    """From labelled rows that are not held out: those max_rows with the smallest crc32 of doc_id (ties by doc_id).

    Null labels and texts take no part; of rows that repeat a doc_id the one with the smallest text counts, and of its
    labels the largest. Only features come to the driver, not texts.
    """
    y = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    usable = docs.where(~held_out(4, 2) & F.col("text").isNotNull()).join(y, "doc_id")
    ids = first_ids(usable, "q", max_rows).join(y, "doc_id")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    got = with_columns(rows, lambda texts: [[features(t) for t in texts]], T.StructType().add("x", T.ArrayType(T.DoubleType())), drop=("text",))
    got = sorted(got.collect(), key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in got]) if got else np.zeros((0, len(FEATURES)))
    return AdditiveModel().fit(x, np.array([float(r["y"]) for r in got]))


def quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Null texts are scored as empty ones; repeated rows score alike.

    Other columns aren't read. An empty table gives no rows. A score of exactly 0.7 is predicted as good.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size

    def compute(texts: list[str | None]) -> list[np.ndarray]:
        return [shared.value.score(np.stack([features(t) for t in texts]))]

    out = docs.select("doc_id", "text", held_out(4, 2).alias("held_out"))
    out = with_columns(out, compute, T.StructType().add("score", "double"), drop=("text",))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))
