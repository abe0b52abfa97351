"""Best-fit packing: best-fit decreasing over all pieces of all documents, with a segment tree over remaining capacities.

Texts are tokenized in tasks; only documents longer than a sequence are cut. What is packed are lengths, and pieces of one
length are interchangeable, so the fit is found on the counts of lengths: at most `size` rows, whatever the corpus. From the
longest length down, the segment tree gives the smallest room that is open and large enough, in logarithmic time, and bins
with that room take pieces of that length until either runs out; each such run is a row of the plan. The plan is exactly
what best-fit decreasing does piece by piece on the whole corpus. A bin's room at least halves each time it is in a run, so
the plan has at most about 4 * size * log2(size) rows, and it goes to all tasks. There a piece's rank among the pieces of
its length, made of its number inside its task and the counts of the tasks before, tells its run, sequence and offset.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .op3_packing import Tokens, tokenizer_path
from .wordtable import chunks

END_ID = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long"


class OpenBins:
    """Bins with room left, as ranges (first bin, how many) by their room; the segment tree says which rooms are open."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, room: int, is_open: bool) -> None:
        at = room + self.leaves
        self.open[at] = is_open
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def add(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.ranges[room].append((first, bins))
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        got = self.ranges[room].pop()
        if not self.ranges[room]:
            self._mark(room, False)
        return got

    def tightest(self, need: int) -> int | None:
        """The smallest open room that is at least need."""
        at = need + self.leaves
        while not self.open[at]:
            while at & 1:  # up from right children, then to the right
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing of counts (length: pieces) into bins of `size`: an int64 row a run, by length and rank.

    A run: length, rank of its first piece, its first bin, pieces a bin, tokens that its bins held before.
    """
    free, bins, runs = OpenBins(size), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = free.tightest(length)
            if room is None:
                room, first = size, bins
                n = -(-left // (size // length))
                bins += n
            else:
                first, n = free.take(room)
            each = room // length  # the same bin is the tightest until it is full
            put = min(left, n * each)
            full, some = divmod(put, each)
            runs.append((length, rank, first, each, size - room))
            free.add(room - each * length, first, full)
            free.add(room - some * length, first + full, 1 if some else 0)
            free.add(room, first + full + (some > 0), n - full - (some > 0))
            rank, left = rank + put, left - put
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer_path: str, size: int) -> DataFrame:
    """PIECE rows, with part (the task) and k (the piece's number among those of its length in the task)."""
    end = np.array([END_ID], "<u4").tobytes()
    schema = PIECE + ", part long, k long"
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen, out = Tokens.at(tokenizer_path), TaskContext.get().partitionId(), Counter(), []
        for b in batches:
            docs_in = iter(b.column("doc_id").to_pylist())
            for some in chunks(b.column("text").to_pylist()):
                for ids in encoder.encode(some):
                    doc, ids = next(docs_in), memoryview(ids + end)
                    total = len(ids) // 4
                    for piece, start in enumerate(range(0, total, size)):
                        n = min(size, total - start)
                        out.append((doc, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, seen[n]))
                        seen[n] += 1
                if len(out) > 5000:
                    yield batch(out)
                    out = []
        encoder.forget()
        yield batch(out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048) -> DataFrame:
    """PLACED rows, one a piece: best-fit decreasing of all documents into sequences of at most `size` tokens.

    A null or empty text has the end id alone. Repeated rows are packed each; a null doc_id stays null. Ties (pieces of one
    length, bins with one room) go by task and place in the task, so sequence numbers may differ between runs, their count
    doesn't. Other columns of docs are not read. An empty table gives no rows.
    """
    cut = materialise(pieces(docs, tokenizer_path, size), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `size` rows
    runs = plan({r["length"]: r["n"] for r in totals}, size)
    keys = (runs[:, 0] << 50) + runs[:, 1]
    names = [c.split()[0] for c in PLACED.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 50) + rank, "right") - 1]
            nth = rank - run[:, 1]
            found = [pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-2]), *found], names=names)

    ranked = cut.join(counts.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("k") + F.col("before"))
    return ranked.select(*names[:-2], "rank").mapInArrow(place, PLACED)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
