"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's bag holds the word and its character 3- to 5-grams (with edge marks), hashed into `buckets` rows of an embedding
table, so an unseen misspelling shares most of its vectors with the word it stems from. A word's vector is the mean over
its bag; a document's is the weighted average over all of its words, as often as they occur, and a linear softmax tells the
classes. A word's weight is the exponential of a learned linear form of its vector, so every word counts, but one that
matters counts in a long text too. Table, weights and softmax are trained together, by the gradient of the same loss.
The table is trained from a sample of at most `max_rows` labelled documents (a parameter); scoring reads every whole text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_ids, held_out, table, with_columns
from .wordtable import WordTable, chunks, codes_of

BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 8, 3, 0.15
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-cased words; a longer run than 64 characters is taken in pieces of 64."""
    words = _TOKEN.findall(text.lower()) if text else []
    if any(len(w) > 64 for w in words):
        words = [w[i : i + 64] for w in words for i in range(0, len(w), 64)]
    return words


def bags(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word (itself, its 3- to 5-grams), and the word of each row, in order."""
    codes, owner = codes_of(words)
    first = np.searchsorted(owner, np.arange(len(words)))
    place = (np.arange(len(owner)) - first[owner]).astype(np.uint64)

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)

    step = np.uint64(0x9E3779B97F4A7C15)
    whole = np.add.reduceat(mixed(codes * step + place * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint64) * (place + np.uint64(1)), first)
    ids, owners = [mixed(whole * step + np.uint64(1))], [np.arange(len(words))]
    h = codes
    for n in range(2, 6):
        starts = max(0, len(codes) - n + 1)  # a single short word has no n-gram of this length
        h = h[:starts] * step + codes[n - 1 :]
        if n > 2:
            inside = owner[:starts] == owner[n - 1 :]
            ids.append(mixed(h[inside] + np.uint64(n)))
            owners.append(owner[:starts][inside])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order]


class Model:
    """Embeddings e (buckets x dim), attention v (dim), softmax weights w (dim x 2) and bias b; trained by Adagrad."""

    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets = buckets
        self.e = rng.normal(0, 0.05, (buckets, dim)).astype(np.float32)
        self.w = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
        self.v = (self.w[:, 1] - self.w[:, 0]).copy()
        self.b = np.zeros(2, np.float32)

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
        docs, y = [], []
        for t, label in zip(texts, labels, strict=True):
            if words := tokens(t):
                docs.append(words)
                y.append(int(label))
        y = np.array(y, np.int64)
        if not docs or y.min() == y.max():
            return self
        rng = np.random.default_rng(seed)
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*docs)))}
        flat, owner = bags(list(vocabulary), self.buckets)
        size = np.bincount(owner, minlength=len(vocabulary))
        begin = np.concatenate([[0], np.cumsum(size)])
        counted = [np.unique([vocabulary[w] for w in d], return_counts=True) for d in docs]
        squares = [np.full(x.shape, s, np.float32) for x, s in ((self.e[:, 0], 1e-4), (self.v, 1e-2), (self.w, 1e-2))]
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), 64):
                part = order[k : k + 64]
                lengths = np.array([len(counted[i][0]) for i in part])
                words, inverse = np.unique(np.concatenate([counted[i][0] for i in part]), return_inverse=True)
                times = np.concatenate([counted[i][1] for i in part]).astype(np.float32)
                n = size[words]
                rows = flat[np.arange(n.sum()) + np.repeat(begin[words] - np.cumsum(n) + n, n)]
                self._step(rows, n, inverse, times, lengths, y[part], squares, rate)
        return self

    def _step(self, rows, size, word, times, lengths, y, squares, rate) -> None:
        """One gradient step. rows: buckets of the batch's words, size of them each; word: of each (document, word) pair."""
        edge = np.concatenate([[0], np.cumsum(size)[:-1]])
        u = np.add.reduceat(self.e[rows], edge, axis=0) / size[:, None]
        at, doc = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.repeat(np.arange(len(lengths)), lengths)
        t = (u @ self.v)[word]
        a = times * np.exp(t - np.maximum.reduceat(t, at)[doc])
        a /= np.add.reduceat(a, at)[doc]
        h = np.add.reduceat(a[:, None] * u[word], at, axis=0)
        logits = h @ self.w + self.b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        back = p @ self.w.T
        pull = a * ((u[word] - h[doc]) * back[doc]).sum(1)  # of each pair's attention
        to_word = a[:, None] * back[doc] + pull[:, None] * self.v
        sums = lambda key, x, n: np.stack([np.bincount(key, x[:, j], n) for j in range(x.shape[1])], 1).astype(np.float32)
        unique = np.flatnonzero(np.bincount(rows, minlength=self.buckets))
        step_e = sums(rows, np.repeat(sums(word, to_word, len(u)) / size[:, None], size, axis=0), self.buckets)[unique]
        step_v, step_w = pull @ u[word], h.T @ p
        e2, v2, w2 = squares
        e2[unique] += (step_e**2).mean(1)
        v2 += step_v**2
        w2 += step_w**2
        self.e[unique] -= rate * step_e / np.sqrt(e2[unique])[:, None]
        self.v -= (rate * step_v / np.sqrt(v2)).astype(np.float32)
        self.w -= (rate * step_w / np.sqrt(w2)).astype(np.float32)
        self.b -= rate * 0.1 * p.mean(0).astype(np.float32)

    def scorer(self) -> Scorer:
        return Scorer((self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float32), (self.e @ self.v).astype(np.float32), float(self.b[1] - self.b[0]))


class Scorer:
    """Scores texts by what each bucket adds to a word's part in the logit and to its attention; keeps both of each word."""

    def __init__(self, margin: np.ndarray, attention: np.ndarray, bias: float):
        self.margin, self.attention, self.bias, self.words = margin, attention, bias, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}

    def _compute(self, words: list[str]) -> np.ndarray:
        ids, owner = bags(words, len(self.margin))
        n = np.bincount(owner, minlength=len(words))
        return np.stack([np.bincount(owner, weights=x[ids], minlength=len(words)) / n for x in (self.margin, self.attention)], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Between 0 and 1; 0 for texts without words."""
        if self.words is None:
            self.words = WordTable(self._compute, 2)
        docs = [tokens(t) for t in texts]
        out = np.zeros(len(docs))
        some = [i for i, d in enumerate(docs) if d]
        if some:
            values, at = self.words.rows([docs[i] for i in some])
            start, doc = at[:-1], np.repeat(np.arange(len(at) - 1), np.diff(at))
            a = np.exp(values[:, 1] - np.maximum.reduceat(values[:, 1], start)[doc]).astype(np.float64)
            z = np.add.reduceat(a * values[:, 0], start) / np.add.reduceat(a, start)
            out[some] = 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))
        return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Model:
    """Fits a model on labelled rows: the max_rows with the smallest crc32 of doc_id (ties by doc_id); null labels or texts take no part.

    Of rows that repeat a doc_id the one with the smallest text counts, and of its labels the largest.
    """
    y = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    rows = docs.select("doc_id", "text").where(~held_out(5, 0) & F.col("text").isNotNull())
    ids = first_ids(rows.join(y, "doc_id"), "t", max_rows).join(y, "doc_id")
    got = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return Model().fit([r["text"] for r in got], np.array([int(r["y"]) for r in got], np.int64))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Null, empty or wordless texts score 0; repeated rows score alike.

    Other columns aren't read. An empty table gives no rows. A score of exactly 0.5 is predicted as toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())  # 8 bytes a bucket, whatever the corpus

    def compute(texts: list[str | None]) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0), *(shared.value.score(part) for part in chunks(texts))])]

    out = docs.select("doc_id", "text", held_out(5, 0).alias("held_out"))
    out = with_columns(out, compute, T.StructType().add("score", "double"), drop=("text",))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
