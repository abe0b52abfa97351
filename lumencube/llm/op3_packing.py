"""Packing: bounded-space online packing of token sequences into windows of a fixed size.

Each partition keeps at most `open_windows` windows open. A document's full windows are emitted at once; the rest goes
whole into the open window with the least room that it fits (best fit). When none fits and no more may be opened, the
fullest is topped up with the head of the document and emitted, so an emitted window has no padding. What is open at the
end of a partition is merged with the leftovers of up to `merge` other partitions in a second, small stage; its last
window is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialise, table
from .wordtable import chunks

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 2


def _byte_marks() -> dict[int, int]:
    """What a byte-level vocabulary writes for each byte: printable ones as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: 256 + k for k, b in enumerate(others)}


class Pieces(dict):
    """Piece without white space -> ids as little-endian uint32 bytes; computed when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.words, self.marks = tokenizer, tokenizer.model.tokenize, _byte_marks()

    def __missing__(self, w: str) -> bytes:
        if w.isalpha() and (w.isascii() or len(w) < 100):  # a run of letters is one word for the tokenizer's model
            tokens = self.words(w if w.isascii() else w.encode().decode("latin-1").translate(self.marks))
            ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        elif (k := self.letters(w)) and "'" not in w and not any(map(str.isalnum, w[k:])):
            ids = self[w[:k]] + self[w[k:]]  # marks after a run of letters are a piece of their own
        else:
            ids = self.whole(w)
        self[w] = ids
        return ids

    @staticmethod
    def letters(w: str) -> int:
        """How many letters w begins with, less than all."""
        return next((k for k in range(len(w) - 1, 0, -1) if w[k - 1].isalpha()), 0) if w[0].isalpha() and not w[-1].isalnum() else 0

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class Tokens:
    """Token ids of texts as little-endian uint32 bytes.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those of its
    white-space-free pieces in turn; the ids of pieces are kept, up to `most`. Texts where that may not hold (special
    tokens' strings, separators that only Python takes for white space, a capital sigma) are encoded whole.
    """

    _WHOLE = ("<|", "Σ", "\x1c", "\x1d", "\x1e", "\x1f")
    _kept: dict[str, Tokens] = {}

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.pieces, self.most = Pieces(Tokenizer.from_file(path)), most

    @classmethod
    def at(cls, path: str) -> Tokens:
        """One for each Python worker."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def forget(self) -> None:
        """Drops the ids of pieces and gives their memory back; called when a task ends."""
        self.pieces.clear()
        give_back()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > self.most:
            self.pieces.clear()
        get, out = self.pieces.__getitem__, []
        for t in texts:
            if any(map(t.__contains__, self._WHOLE)):
                out.append(self.pieces.whole(t))
            else:
                out.append(b"".join(map(get, unicodedata.normalize("NFC", t).lower().split())))
        return out


class Packer:
    """The open windows of one task. put() takes a piece's ids; emitted pieces gather in `out` as rows of PIECE."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id, self.open, self.out = size, most, first_id, [], []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def put(self, doc, start: int, ids: bytes, total: int) -> None:
        """ids: the rest of the document from start on, not longer than a window."""
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w[0] + n <= self.size]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                n = self.size - best[0]
            best[0] += n
            best[1].append((doc, start, ids[: 4 * n], total))
            start, ids = start + n, ids[4 * n :]
            if best[0] == self.size:
                self.emit(best[1])
                self.open = [w for w in self.open if w is not best]

    def finish(self) -> None:
        """Merges the open windows, cutting freely, and cuts the last one into powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        left = sum(len(p[2]) // 4 for p in pieces)
        while left:
            room, window = (self.size if left >= self.size else 1 << (left.bit_length() - 1)), []
            left -= room
            while room:
                doc, start, ids, total = pieces.pop(0)
                n = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], total))
                room -= n
                if 4 * n < len(ids):
                    pieces.insert(0, (doc, start + n, ids[4 * n :], total))
            self.emit(window)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, open_windows: int = 8, merge: int = 64) -> DataFrame:
    """Rows of PIECE, one a piece: every id of every document in exactly one piece.

    A null or empty text has the end id alone. Repeated rows are packed each; a null doc_id stays null. Other columns of
    docs are not read; doc_id is a long. sequence_id is unique over both stages. An empty table gives no rows.
    """
    names = [x.split()[0] for x in PIECE.split(", ")]
    end = np.array([END_ID], "<u4").tobytes()

    def rows_of(rows: list[tuple], ids: list[bytes | None] | None = None) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[] for _ in names])]
        if ids is None:
            return pa.RecordBatch.from_arrays(columns, names=names)
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=[*names, "ids"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Tokens.at(tokenizer_path)
        part = TaskContext.get().partitionId()
        packer = Packer(size, open_windows, part << 32)
        for b in batches:
            docs_in = iter(b.column("doc_id").to_pylist())  # Python integers: ids of any size beside nulls
            for some in chunks(b.column("text").to_pylist()):
                for ids in encoder.encode(some):
                    doc, ids = next(docs_in), ids + end
                    total = len(ids) // 4
                    whole = total - total % size
                    for k in range(0, whole, size):
                        packer.emit([(doc, k, ids[4 * k : 4 * (k + size)], total)])
                    if whole < total:
                        packer.put(doc, whole, ids[4 * whole :], total)
                if len(packer.out) > 5000:
                    yield rows_of(packer.out, [None] * len(packer.out))
                    packer.out = []
        yield rows_of(packer.out, [None] * len(packer.out))
        encoder.forget()
        rest = [(doc, start, len(ids) // 4, 0, total, -1 - part, 0) for w in packer.open for doc, start, ids, total in w[1]]
        yield rows_of(rest, [p[2] for w in packer.open for p in w[1]])

    def second(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("sequence_id", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        packer = Packer(size, 0, (1 << 62) + (key[0].as_py() << 32))
        pieces = zip(*(t[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
        packer.open = [[0, list(pieces)]]
        packer.finish()
        return pa.Table.from_batches([rows_of(packer.out)])

    placed = materialise(docs.select("doc_id", "text").mapInArrow(first, PIECE + ", ids binary"), "packed")
    left = placed.where("sequence_id < 0")
    merged = left.groupBy(F.floor((-1 - F.col("sequence_id")) / merge).alias("part")).applyInArrow(second, PIECE)
    return placed.where("sequence_id >= 0").drop("ids").unionByName(merged)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
