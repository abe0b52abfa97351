"""License scans: which text blocks hold (most of) the words of a license template.

Two answers a document. The base answer counts the places where the words of four fixed phrases stand one after the
other. The wider answer is an exact set-similarity join between text blocks and templates. A block is any run of
consecutive words as long as the template and a quarter more; it matches when it holds at least `threshold` of the
template's distinct words. Words are ordered by the number of documents that hold them, rarest first. A block can only
match if its rarest word of the template is among the first |T| - o + 1 of them (o: the overlap that is needed; prefix and
position: so many words of the template come no earlier in the order), and if it holds o words of the template in all
(length). What passes is verified: for every word of the template in the text, the distinct words of the block that begins
there, all at once by adding up where each word counts, so that the work is linear in the words. Of blocks that overlap
the best stands for them. Of templates that match the same words, the one with the larger containment, then with more
words, gives its label.

The texts are read once, by one helper that turns a text into the places of template words; it passes over texts that
hold too few different words of every template. Templates are constants of this module (or an argument), so what is
broadcast is bounded by them, never by the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

# The base phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences and paragraphs of well-known licenses.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
]
# Bytes that are no part of a word become spaces, A-Z become a-z; all bytes of other characters belong to words.
_KEEP = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_FOLD = bytes(c if c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SCAN = "id long, n_words long, starts array<long>, base array<string>, places array<int>, tokens array<int>, holding array<long>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand one after the other."""
    out, at, n = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


class Templates:
    """Word lists, numbered words, and the needed overlap and block length of each template."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.labels = [label for label, _ in templates]
        lists = [words_of(t) for _, t in templates]
        self.words = sorted(set().union(*lists))
        self.number = {w: k for k, w in enumerate(self.words)}
        self.tokens = [sorted({self.number[w] for w in t}) for t in lists]
        self.need = [math.ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.span = [math.ceil(1.25 * len(t)) for t in lists]


class Blocks:
    """Finds matching blocks in the places of template words, and which of them give their labels."""

    def __init__(self, templates: Templates, holding: dict[int, int]):
        self.templates = templates
        n = len(templates.words)
        self.masks = [sum(1 << k for k in t) for t in templates.tokens]
        self.own, self.prefix = np.zeros((len(templates.tokens), n), bool), np.zeros((len(templates.tokens), n), bool)
        for t, tokens in enumerate(templates.tokens):
            ranked = sorted(tokens, key=lambda k: (holding.get(k, 0), k))
            self.own[t, tokens] = True
            self.prefix[t, ranked[: len(ranked) - templates.need[t] + 1]] = True

    def of(self, places: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """(template, first, last, overlap), an int64 row a block; places ascend."""
        held, out = sum(1 << int(k) for k in np.unique(tokens)), []
        for t, (mask, need, span) in enumerate(zip(self.masks, self.templates.need, self.templates.span, strict=True)):
            if (held & mask).bit_count() >= need:
                some = self.own[t, tokens]
                out += [(t, *b) for b in self._of_template(places[some], tokens[some], self.prefix[t], need, span)]
        return np.array(out, np.int64).reshape(-1, 4)

    @staticmethod
    def _of_template(p: np.ndarray, k: np.ndarray, prefix: np.ndarray, need: int, span: int) -> list[tuple[int, int, int]]:
        n, at = len(p), np.arange(len(p))
        end = np.searchsorted(p, p + span)  # of the block that begins at each word
        rare = np.concatenate([[0], np.cumsum(prefix[k])])
        may = (end - at >= need) & (rare[end] > rare[at])
        if not may.any():
            return []
        by_word = np.argsort(k, kind="stable")
        before = np.full(n, -1)  # the same word's last place
        again = k[by_word[1:]] == k[by_word[:-1]]
        before[by_word[1:][again]] = by_word[:-1][again]
        # A word is new in the blocks that begin after its last place, and not so early that they end before it.
        first = np.maximum(before + 1, np.searchsorted(p, p - span, "right"))
        overlap = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1))[:n]
        good = np.flatnonzero(may & (overlap >= need))
        places, free, out = p[good], np.ones(len(good), bool), []
        for i in np.lexsort((places, -overlap[good])).tolist():
            if free[i]:
                free[np.searchsorted(places, places[i] - span, "right") : np.searchsorted(places, places[i] + span)] = False
                j = good[i]
                out.append((int(p[j]), int(p[end[j] - 1]), int(overlap[j])))
        return sorted(out)

    def winners(self, blocks: np.ndarray) -> tuple[list[str], float]:
        """Labels of the blocks that no better one of another label covers (by half of their words' extent or more), and the best containment.

        A better block that covers half of another begins at most a block's length before it; and as blocks of one template
        don't overlap, there are only some of each template to compare with.
        """
        if not len(blocks):
            return [], 0.0
        label = np.unique([self.templates.labels[t] for t in blocks[:, 0]], return_inverse=True)
        merit = blocks[:, 3] / np.array([len(self.templates.tokens[t]) for t in blocks[:, 0]])
        order = np.argsort(blocks[:, 1], kind="stable")
        first, last, name, merit, overlap = blocks[order, 1], blocks[order, 2], label[1][order], merit[order], blocks[order, 3]
        lo, hi = np.searchsorted(first, first - max(self.templates.span)), np.searchsorted(first, last, "right")
        out = set()
        for i in range(len(order)):
            if name[i] not in out:
                by = slice(lo[i], hi[i])
                common = np.minimum(last[i], last[by]) - np.maximum(first[i], first[by]) + 1
                better = (merit[by] > merit[i]) | ((merit[by] == merit[i]) & (overlap[by] > overlap[i]))
                if not ((name[by] != name[i]) & better & (2 * common >= last[i] - first[i] + 1)).any():
                    out.add(name[i])
        return [str(label[0][k]) for k in sorted(out)], float(merit.max())


def scan(docs: DataFrame, templates: Templates) -> DataFrame:
    """docs plus SCAN. places and tokens: template words of texts that may match, in order; holding: on a batch's first
    row, how many of its texts hold each template word."""
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
    bit = {w: 1 << k for k, w in enumerate(templates.words)}
    masks = [sum(1 << k for k in t) for t in templates.tokens]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCAN}"

    def one(text: str | None, holding: list[int]) -> tuple:
        words = words_of(text)
        own = bit.keys() & set(words)
        starts: list[int] = []
        base = []
        for phrase, label in phrases:
            if all(w in own or w not in bit for w in phrase) and (at := phrase_places(words, phrase)):
                starts += at
                base.append(label)
        held = 0
        for w in own:
            held |= bit[w]
            holding[templates.number[w]] += 1
        some = 0
        for mask, need in zip(masks, templates.need, strict=True):
            if (held & mask).bit_count() >= need:
                some |= mask
        hits = [(i, templates.number[w]) for i, w in enumerate(words) if bit.get(w, 0) & some] if some else []
        return len(words), sorted(set(starts)), base, [i for i, _ in hits], [k for _, k in hits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["doc_id", *[c.split()[0] for c in SCAN.split(", ")]]
        for b in batches:
            if b.num_rows:
                holding = [0] * len(templates.words)
                rows = [one(t, holding) for t in b.column("text").to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                first = pa.array([holding, *[None] * (len(rows) - 1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), *columns, first], names=names)

    return docs.select("doc_id", "text").withColumn("id", F.monotonically_increasing_id()).mapInArrow(run, schema)


def blocks_of(scanned: DataFrame, templates: Templates) -> Blocks:
    """scanned: rows of scan(), materialised. The counts brought to the driver are as many as the templates have words."""
    holding = scanned.where("holding IS NOT NULL").select(F.posexplode("holding").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    return Blocks(templates, {r["k"]: r["n"] for r in holding.collect()})


def _hits(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for places, tokens in zip(batch.column("places"), batch.column("tokens"), strict=True):
        yield places.values.to_numpy().astype(np.int64), tokens.values.to_numpy()


def template_join(scanned: DataFrame, templates: Templates) -> DataFrame:
    """(id, template, label, first, last, overlap, containment): a row a block that meets the threshold and that no better block of its template overlaps."""
    blocks = blocks_of(scanned, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, (places, tokens) in zip(b.column("id").to_pylist(), _hits(b), strict=True):
                if len(places) and len(found := blocks.of(places, tokens)):
                    t, sizes = found[:, 0], np.array([len(x) for x in templates.tokens])
                    columns = [pa.array([key] * len(t)), pa.array(t.astype(np.int32)), pa.array([templates.labels[k] for k in t]), *(pa.array(found[:, k]) for k in (1, 2, 3)), pa.array(found[:, 3] / sizes[t])]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "template", "label", "first", "last", "overlap", "containment"])

    return scanned.select("id", "places", "tokens").mapInArrow(run, "id long, template int, label string, first long, last long, overlap long, containment double")


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """Per row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score (the largest containment).

    Null or empty text: no words, no labels, score 0. Repeated rows get the same answer each. Other columns of docs are
    not read. An empty table gives an empty result. Matches that tie in containment and words all give their labels.
    """
    made = Templates(templates, threshold)
    scanned = materialise(scan(docs, made), "license-scan")
    blocks, kept = blocks_of(scanned, made), ("doc_id", "n_words", "starts", "base")
    schema = T.StructType([*(scanned.schema[c] for c in kept), T.StructField("found", T.ArrayType(T.StringType())), T.StructField("best", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks.winners(blocks.of(p, k)) if len(p) else ([], 0.0) for p, k in _hits(b)]
            new = [pa.array([f for f, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], names=schema.names)

    both = scanned.select(*kept, "places", "tokens").mapInArrow(run, schema)
    labels = F.array_union("base", "found")
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    has = F.size("starts") > 0
    return both.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.when(has, F.array_min("starts")).alias("first_word"), F.when(has, F.array_max("starts")).alias("last_word"),
        join(F.col("base")).alias("base_labels"), join(labels).alias("labels"),
        F.greatest("best", F.when(has, 1.0).otherwise(0.0)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
