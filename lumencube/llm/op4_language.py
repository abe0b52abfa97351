"""Language ID: interpolated Kneser-Ney character models, one a language, in sorted arrays of n-gram hashes.

Counts: every training text is lower-cased and cut into runs of letters; each run is read between edge marks, and its
4-grams are counted for each language, first inside each task and then over all by Spark. Lower orders follow from the
distinct 4-grams (continuation counts). An n-gram's hash packs 16 bits of each code point into 64 bits; code points beyond
16 bits share the 8447 places that no 16-bit letter has. Probabilities and backoffs of all orders come from Spark's
aggregations and joins of these counts; only the sorted arrays that they make are brought together and broadcast.
A text goes to the language with the lowest cross-entropy for each character. It is rejected when that is far above what
the language's own training texts have (calibrated on all of them: each is scored in tasks, and Spark aggregates).
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialise, table, with_columns
from .wordtable import WordTable, chunks, codes_of

ORDER = 4
_RUN = re.compile(r"[^\W\d_]{1,40}")
_SHIFT = np.uint64(16)
NEW = ("lang_pred", "score", "rejected", "_entropies", "_letters")  # columns that identify() and identify_own() add, the last two for a while


def runs(text: str) -> list[str]:
    """Runs of letters, lower-cased; a run of over 40 letters is taken in pieces. Numerals such as a half are no letters."""
    found = _RUN.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [r for w in found for r in "".join(c if c.isalpha() else " " for c in w).split()]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character but the first mark, at full order, and the word of each.

    Places before the word count as zeros. Code points above 16 bits are spread over the surrogates' and private places.
    """
    codes, owner = codes_of(words)
    codes = np.where(codes > np.uint64(0xFFFF), np.uint64(0xD800) + codes % np.uint64(8447), codes)
    first = np.searchsorted(owner, np.arange(len(words)))
    place = np.arange(len(codes)) - first[owner]
    h = codes.copy()
    for back in range(1, ORDER):
        ok = place >= back
        h[ok] |= codes[np.flatnonzero(ok) - back] << np.uint64(16 * back)
    keep = place > 0
    return h[keep], owner[keep]


class LanguageModel:
    """Sorted hashes and log-probabilities of one language, for orders 4 to 1; see log_probabilities."""

    def __init__(self, floor: float, grams: dict[int, tuple], contexts: dict[int, tuple]):
        """grams and contexts: order -> (hashes, logarithms of probabilities or backoffs); floor: of an unseen character."""
        self.floor = floor
        self.hashes, self.discounted = zip(*(self._sorted(*grams[n]) for n in range(1, ORDER + 1)), strict=True)
        self.contexts, self.backoff = zip(*(self._sorted(*contexts[n]) for n in range(1, ORDER + 1)), strict=True)

    @staticmethod
    def _sorted(hashes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = hashes.astype(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        return hashes[order], values[order].astype(np.float32)

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Interpolated log-probability of each gram's last character after the ones before it."""
        out, todo = np.zeros(len(grams), np.float32), np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            g = grams[todo] & np.uint64((1 << (16 * n)) - 1) if n < ORDER else grams[todo]
            hashes = self.hashes[n - 1]
            at = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
            hit = hashes[at] == g
            out[todo[hit]] += self.discounted[n - 1][at[hit]]
            todo, g = todo[~hit], g[~hit]
            if not len(todo):
                return out
            if n > 1:
                contexts = self.contexts[n - 1]
                at = np.minimum(np.searchsorted(contexts, g >> _SHIFT), len(contexts) - 1)
                known = contexts[at] == g >> _SHIFT
                out[todo[known]] += self.backoff[n - 1][at[known]]
        out[todo] += np.log(self.floor, dtype=np.float32)
        return out


class Identifier:
    """All languages' models, with the calibration: mean and deviation of the cross-entropy of each language's own texts."""

    def __init__(self, models: dict[str, LanguageModel]):
        self.langs, self.models = sorted(models), models
        self.mean, self.deviation = np.zeros(len(models)), np.full(len(models), np.inf)
        self.words = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}

    def forget(self) -> None:
        """Drops what is kept of words."""
        self.words = None

    def _compute(self, words: list[str]) -> np.ndarray:
        grams, owner = grams_of(words)
        each = [np.bincount(owner, weights=self.models[x].log_probabilities(grams), minlength=len(words)) for x in self.langs]
        return np.stack([*each, np.bincount(owner, minlength=len(words))], 1)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats for each character in each language (a row a text), and the characters; texts without letters have 0."""
        if self.words is None:
            self.words = WordTable(self._compute, len(self.langs) + 1, most=100_000)
        docs = [runs(t or "") for t in texts]
        out, n = np.zeros((len(docs), len(self.langs))), np.zeros(len(docs))
        some = [i for i, d in enumerate(docs) if d]
        if some:
            values, at = self.words.rows([docs[i] for i in some])
            sums = np.add.reduceat(values.astype(np.float64), at[:-1], axis=0)
            n[some] = sums[:, -1]
            out[some] = -sums[:, :-1] / sums[:, -1:]
        return out, n

    def rejects(self, reject_at: float) -> Column:
        """Whether a row (lang_pred, _entropies, _letters) has no letters, or is above its language's mean by over reject_at deviations.

        Short texts may vary more.
        """
        of = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), place(self.langs, "lang_pred"))
        distance = (F.array_min("_entropies") - of(self.mean)) * F.sqrt(F.least("_letters", F.lit(256.0))) / of(self.deviation)
        return (F.col("_letters") == 0) | (distance > reject_at)

    def calibrate(self, own: DataFrame) -> Identifier:
        """own (lang, e, n): of every training text its cross-entropy in its own language and its characters."""
        for r in deviations(own).collect():  # a row a language
            k = self.langs.index(r["lang"])
            self.mean[k], self.deviation[k] = r["mean"], max(0.05, r["deviation"])
        return self

    def predict(self, texts: list[str]) -> pd.DataFrame:
        entropy, n = self.entropies(texts)
        best = entropy.argmin(1) if self.langs else np.zeros(len(texts), int)
        gap = (entropy - entropy.min(1, keepdims=True)) * np.minimum(n, 512)[:, None]
        score = 1 / np.exp(-np.minimum(gap, 50)).sum(1)
        none = n == 0
        return pd.DataFrame({
            "lang_pred": np.where(none, "und", np.array(self.langs, object)[best]), "score": np.where(none, 0.0, score),
            "_entropies": list(entropy), "_letters": n,
        })


def place(langs: list[str], column: str) -> Column:
    """Where a language stands in langs, from 0; -1 if it isn't there."""
    return F.array_position(F.array(*[F.lit(x) for x in langs]), F.col(column)).cast("int") - 1


def medians(rows: DataFrame) -> DataFrame:
    """(lang, e), e of 0 or more -> (lang, mean): each language's median over all rows, e being cut to whole 2^-32.

    Counted in three rounds, by cells of 2^-8, 2^-20 and 2^-32, each inside the cells of the round before that hold the
    middle ranks. So rows meet by cell, never by language, and a window ranks 2^12 counts (in the first round 2^8 for each
    nat that a language's texts span) at most.
    """
    step = F.floor(F.col("e") * 2.0**32)
    rows = rows.select("lang", step.alias("step"))
    ranks = F.array_distinct(F.array(F.floor((F.col("c") - 1) / 2), F.floor(F.col("c") / 2)))
    found = rows.groupBy("lang").agg(F.count("*").alias("c")).select("lang", F.lit(0).cast("long").alias("cell"), F.explode(ranks).alias("rank"))
    levels = [F.lit(0).cast("long"), F.shiftright("step", 24), F.shiftright("step", 12), F.col("step")]
    for whole, part in itertools.pairwise(levels):
        found = F.broadcast(materialise(found, "middle").withColumnRenamed("cell", "whole"))  # one or two rows a language
        counts = rows.select("lang", whole.alias("whole"), part.alias("cell")).join(found, ["lang", "whole"], "left_semi")
        counts = counts.groupBy("lang", "whole", "cell").agg(F.count("*").alias("c"))
        counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("lang", "whole").orderBy("cell")))
        found = counts.join(found, ["lang", "whole"]).where("rank >= upto - c and rank < upto")
        found = found.select("lang", "cell", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
    return found.groupBy("lang").agg((F.avg("cell") / 2.0**32).alias("mean"))


def deviations(own: DataFrame) -> DataFrame:
    """own (lang, e, n) -> (lang, mean, deviation) of all rows with letters: the median of e, and the root of the mean square
    of what e is off from it, weighted by the characters up to 256. Languages with a single row have none."""
    own = own.where("n > 0")
    square = F.pow(F.col("e") - F.col("mean"), 2.0) * F.least("n", F.lit(256.0))
    both = own.join(F.broadcast(medians(own)), "lang").groupBy("lang", "mean").agg(F.sqrt(F.avg(square)).alias("deviation"), F.count("*").alias("c"))
    return both.where("c > 1").drop("c")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (text, lang); null texts and langs take no part."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                words: Counter = Counter()
                for part in chunks(texts):
                    for t in part:
                        words.update(runs(t))
                keys = list(words)
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for k in range(0, len(keys), 50_000):
                    some = keys[k : k + 50_000]
                    grams, owner = grams_of(some)
                    weight = np.fromiter((words[w] for w in some), np.int64, len(some))[owner]
                    found.append((grams, weight))
                if found:
                    grams, weight = (np.concatenate(x) for x in zip(*found, strict=True))
                    unique, inverse = np.unique(grams, return_inverse=True)
                    sums = np.bincount(inverse, weights=weight).astype(np.int64)
                    yield pd.DataFrame({"lang": lang, "gram": unique.astype(np.int64), "n": sums})

    rows = rows.select("lang", "text").where("lang is not null and text is not null")
    each = rows.mapInPandas(count, "lang string, gram long, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """counts (lang, gram, n) -> (lang, k, gram, p) and (lang, k, context, bow, floor) of the orders k = 1 to 4.

    Below the highest order an n-gram counts as often as it ends different longer ones. Each order's discount D comes from
    its counts of one and of two; p = max(c - D, 0) / all of the context + bow * p of the n-gram without its first
    character, bow being the share that discounting took from the context. At order 1, bow is spread evenly over 2000
    characters (floor of each).
    """
    short = lambda k: F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1).cast("long"))
    level = counts.select("lang", "gram", F.col("n").alias("c"))
    every = level.withColumn("k", F.lit(ORDER))
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", short(k).alias("gram")).agg(F.count("*").alias("c"))
        every = every.unionByName(level.withColumn("k", F.lit(k)))
    every = materialise(every.withColumn("context", F.shiftrightunsigned("gram", 16)), "kn-counts")
    ones, twos = F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))
    discount = F.when(ones > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), ones / (ones + 2 * twos)))).otherwise(0.5)
    discounts = F.broadcast(every.groupBy("lang", "k").agg(discount.alias("d")))  # four rows a language
    contexts = every.groupBy("lang", "k", "context").agg(F.sum("c").alias("total"), F.count("*").alias("width")).join(discounts, ["lang", "k"])
    contexts = contexts.select("lang", "k", "context", "total", "d", (F.col("d") * F.col("width") / F.col("total")).alias("bow"))
    contexts = materialise(contexts, "kn-contexts")
    own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
    every = every.join(contexts, ["lang", "k", "context"]).select("lang", "k", "gram", own.alias("own"), "bow")
    every = materialise(every, "kn-own")
    lower = every.where("k = 1").select("lang", "k", "gram", (F.col("own") + F.col("bow") / 2000).alias("p"))
    out = lower
    for k in range(2, ORDER + 1):
        here = every.where(F.col("k") == k).withColumn("short", short(k - 1))
        below = lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("below"))
        lower = here.join(below, ["lang", "short"]).select("lang", "k", "gram", (F.col("own") + F.col("bow") * F.col("below")).alias("p"))
        out = out.unionByName(lower)
    floor = F.when(F.col("k") == 1, F.col("bow") / 2000)
    return out, contexts.select("lang", "k", "context", "bow", floor.alias("floor"))


def models(docs: DataFrame) -> Identifier:
    """Models from all rows of docs that have text and lang and are not held out, without calibration.

    All 4-grams are kept, so discounts and the counts of shorter n-grams are those of all rows; what is broadcast grows
    with the number of distinct 4-grams.
    """
    rows = docs.where(~held_out(4, 2)).select("text", "lang")
    grams, contexts = (t.toPandas() for t in kneser_ney(materialise(gram_counts(rows), "grams")))
    made = {}
    for lang, g in grams.groupby("lang"):
        c = contexts[contexts["lang"] == lang]
        of = lambda t, key, v: {k: (x[key].to_numpy(), np.log(x[v].to_numpy())) for k, x in t.groupby("k")}
        made[lang] = LanguageModel(float(c["floor"].max()), of(g, "gram", "p"), of(c, "context", "bow"))
    return Identifier(made)


def scored(docs: DataFrame, identifier: Identifier, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs without the columns `drop`, plus lang_pred, score, _entropies in all languages, _letters."""
    new = T.StructType().add("lang_pred", "string").add("score", "double").add("_entropies", T.ArrayType(T.DoubleType())).add("_letters", "double")
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def compute(texts: list[str | None]) -> list:
        p = pd.concat([shared.value.predict(part) for part in chunks(texts)])
        return [p[c] for c in new.names]

    return with_columns(docs, compute, new, drop=(*NEW, *drop), done=lambda: shared.value.forget())


def own_entropies(rows: DataFrame, identifier: Identifier) -> DataFrame:
    """Rows of scored() with doc_id and lang -> (lang, e, n) of those that are not held out, a row each, repeated ones too."""
    rows = rows.where(~held_out(4, 2) & F.col("lang").isNotNull())
    return rows.select("lang", F.get("_entropies", place(identifier.langs, "lang")).alias("e"), F.col("_letters").alias("n"))


def learn(docs: DataFrame) -> Identifier:
    """Models from all rows of docs that have text and lang and are not held out, calibrated on all of them."""
    identifier = models(docs)
    if not identifier.langs:
        return identifier
    rows = docs.where(~held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return identifier.calibrate(materialise(own_entropies(scored(rows, identifier, drop=("text",)), identifier), "own-entropies"))


def unknown(docs: DataFrame) -> DataFrame:
    """What nothing was learned for: every text is `und`, score 0 and rejected."""
    return docs.drop(*NEW).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})


def identify(docs: DataFrame, identifier: Identifier, reject_at: float = 20.0) -> DataFrame:
    """docs plus lang_pred, score (share of the best language's likelihood), rejected.

    A null text, or one without letters, is `und`, score 0 and rejected; ties go to the language that sorts first. Rows
    that repeat a text get the same answer; texts of any length are read whole. With nothing to learn from, every text
    is `und`. Columns of docs with the names of the new ones (NEW) are replaced. An empty table gives no rows.
    """
    if not identifier.langs:
        return unknown(docs)
    return scored(docs, identifier).withColumn("rejected", identifier.rejects(reject_at)).drop("_entropies", "_letters")


def identify_own(docs: DataFrame, reject_at: float = 20.0, drop: tuple[str, ...] = ()) -> DataFrame:
    """identify(docs, learn(docs), reject_at) without the columns `drop`, each text being scored once for both.

    The scored rows are written to the shared folder, so columns that aren't wanted, such as text, are better dropped (all but
    doc_id and lang may be).
    """
    identifier = models(docs)
    if not identifier.langs:
        return unknown(docs).drop(*drop)
    rows = materialise(scored(docs, identifier, drop), "scored")
    identifier.calibrate(own_entropies(rows, identifier))
    return rows.withColumn("rejected", identifier.rejects(reject_at)).drop("_entropies", "_letters")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    return identify_own(docs, drop=("text",)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
