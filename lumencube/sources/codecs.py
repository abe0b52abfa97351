"""Codecs of Zarr chunks, by their configuration: a dict with id and parameters, or None for raw chunks.

The blosc container: a header of 16 bytes (version, inner version, flags, sample size, and as 32-bit numbers the plain size,
the block size and the whole size), the place of each block, then the blocks. A block may be split into a stream a byte of
a sample; a stream is a 32-bit length and its bytes, which are compressed unless they are as long as what they stand for.
Flags: 1 bytes shuffled, 2 stored plainly, 4 bits shuffled, 16 never split, from bit 5 on the inner codec.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard

KNOWN = ("blosc", "zlib", "gzip", "zstd", "lz4", "bz2", "lzma")
# Inner codecs by their number in the flags.
INNER = ("blosclz", "lz4", "snappy", "zlib", "zstd")
# A block is split if samples have at most so many bytes and a stream would have at least so many.
MOST_STREAMS, LEAST_STREAM = 16, 128


def check(config: dict | None) -> None:
    if config is not None and config.get("id") not in KNOWN:
        raise ValueError(f"chunks are compressed by {config.get('id')}, known are {', '.join(KNOWN)}")


def plain(content: bytes, config: dict | None) -> bytes:
    """The samples' bytes of a chunk."""
    kind = (config or {}).get("id")
    if kind == "blosc":
        return blosc_plain(content)
    if kind == "lz4":  # the plain size comes first
        return pa.Codec("lz4_raw").decompress(content[4:], int.from_bytes(content[:4], "little")).to_pybytes()
    if kind == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress}[kind](content)


def packed(raw: bytes, config: dict | None, width: int) -> bytes:
    """A chunk's content; width: bytes a sample."""
    kind = (config or {}).get("id")
    if kind == "blosc":
        return blosc_packed(raw, width, config.get("cname", "lz4"), config.get("shuffle", 1), config.get("blocksize", 0))
    if kind == "lz4":
        return len(raw).to_bytes(4, "little") + pa.Codec("lz4_raw").compress(raw).to_pybytes()
    if kind == "zstd":
        return zstandard.ZstdCompressor().compress(raw)
    return {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "bz2": bz2.compress, "lzma": lzma.compress}[kind](raw)


def shuffled(raw: bytes, width: int, back: bool) -> bytes:
    """First the first byte of each sample, then the second ones, and so on; bytes beyond whole samples stay at the end."""
    n = len(raw) // width
    shape = (width, n) if back else (n, width)
    return np.frombuffer(raw, np.uint8, n * width).reshape(shape).T.tobytes() + raw[n * width :]


def bits_shuffled(raw: bytes, width: int, back: bool) -> bytes:
    """First the lowest bit of the first byte of each sample, then the next bit, and so on, if samples come in eights."""
    n = len(raw) // width
    if n % 8:
        return raw
    own = np.frombuffer(raw, np.uint8, n * width)
    if back:
        bits = np.unpackbits(own.reshape(8 * width, n // 8), axis=1, bitorder="little").T
    else:
        bits = np.unpackbits(own.reshape(n, width), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").tobytes() + raw[n * width :]


def _streams(width: int, size: int, whole: bool, split: bool) -> int:
    return width if split and whole and width <= MOST_STREAMS and size // width >= LEAST_STREAM else 1


def blosc_plain(content: bytes) -> bytes:
    if len(content) < 16:
        raise ValueError("a blosc chunk is shorter than its header")
    version, _, flags, width, size, block, total = struct.unpack("<BBBBIII", content[:16])
    if version > 2:
        raise ValueError(f"blosc format {version}, known are 1 and 2")
    if flags & 2:
        return content[16 : 16 + size]
    if flags & 8 or flags >> 5 >= len(INNER) or total > len(content):
        raise ValueError(f"blosc chunk with flags {flags}, {total} bytes of which {len(content)} are there")
    width, out = max(width, 1), []
    starts = struct.unpack_from(f"<{-(-size // block) if block else 0}I", content, 16)
    for k, at in enumerate(starts):
        own = min(block, size - k * block)
        streams, parts = _streams(width, own, own == block, not flags & 16), []
        for _ in range(streams):
            n = int.from_bytes(content[at : at + 4], "little")
            stream = content[at + 4 : at + 4 + n]
            parts.append(stream if n == own // streams else _inner_plain(INNER[flags >> 5], stream, own // streams))
            at += 4 + n
        data = b"".join(parts)
        if flags & 1 and width > 1:
            data = shuffled(data, width, True)
        elif flags & 4 and own >= width:
            data = bits_shuffled(data, width, True)
        out.append(data)
    return b"".join(out)


def blosc_packed(raw: bytes, width: int, inner: str, shuffle: int, block: int = 0) -> bytes:
    """shuffle: 0 none, 1 bytes, 2 bits, -1 bits for samples of a byte, else bytes; block: bytes a block (0: up to 256 KiB)."""
    if inner not in INNER[1:]:
        raise ValueError(f"blosc with {inner}: written are {', '.join(INNER[1:])}")
    width = width if width < 256 else 1
    shuffle = (2 if width == 1 else 1) if shuffle == -1 else shuffle
    block = max(width, min(block or 1 << 18, max(len(raw), 1)) // width * width)
    flags = (1 if shuffle == 1 and width > 1 else 4 if shuffle == 2 else 0) | INNER.index(inner) << 5
    count = -(-len(raw) // block)
    starts, body, at = [], [], 16 + 4 * count
    for k in range(0, len(raw), block):
        data = raw[k : k + block]
        if flags & 1:
            data = shuffled(data, width, False)
        elif flags & 4:
            data = bits_shuffled(data, width, False)
        starts.append(at)
        streams = _streams(width, len(data), len(data) == block, True)
        n = len(data) // streams
        for s in range(streams):
            part = data[s * n : (s + 1) * n]
            small = {"lz4": _arrow, "snappy": _arrow, "zlib": lambda b, _: zlib.compress(b), "zstd": _arrow}[inner](part, inner)
            small = small if len(small) < n else part
            body.append(len(small).to_bytes(4, "little") + small)
            at += len(body[-1])
    if at >= 16 + len(raw):  # nothing gained
        return struct.pack("<BBBBIII", 2, 1, flags | 2, width, len(raw), block, 16 + len(raw)) + raw
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(raw), block, at) + struct.pack(f"<{count}I", *starts) + b"".join(body)


def _arrow(data: bytes, inner: str) -> bytes:
    return pa.Codec("lz4_raw" if inner == "lz4" else inner).compress(data).to_pybytes()


def _inner_plain(inner: str, data: bytes, size: int) -> bytes:
    if inner == "zlib":
        return zlib.decompress(data)
    if inner == "blosclz":
        return blosclz_plain(data, size)
    return pa.Codec("lz4_raw" if inner == "lz4" else inner).decompress(data, size).to_pybytes()


def blosclz_plain(data: bytes, size: int) -> bytes:
    """Runs of literals (a byte below 32: one less than their number) and copies of what came before (the three highest bits:
    two less than their number, 7 being continued by further bytes up to one below 255; the others and the next byte: how far
    back, less one; where all of these are set, two more bytes say how much further)."""
    out, at = bytearray(), 1
    control = data[0] & 31 if data else 0
    while len(out) < size:
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
        else:
            n, back = (control >> 5) + 2, (control & 31) << 8
            if n == 9:
                more = 255
                while more == 255:
                    more = data[at]
                    n, at = n + more, at + 1
            low, at = data[at], at + 1
            back += low
            if back == 0x1FFF:
                back, at = 0x1FFF + (data[at] << 8) + data[at + 1], at + 2
            start = len(out) - back - 1
            if start < 0:
                raise ValueError("a copy begins before the block")
            while n:  # a copy may reach into what it makes
                some = out[start : start + n]
                out += some
                start, n = start + len(some), n - len(some)
        if at >= len(data):
            break
        control, at = data[at], at + 1
    if len(out) != size:
        raise ValueError(f"a block of {size} bytes has {len(out)}")
    return bytes(out)
