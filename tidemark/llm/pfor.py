"""Token files in patched frame-of-reference blocks.

A file holds the ids of many documents as one stream, cut into blocks of
BLOCK ids. A block stores its minimum; the differences to it are packed at a
width that holds the chosen percentile of them, and the few that need more
bits go to an exception list of (position, difference). After the blocks come
the start of every block, then a directory of documents (key, id, whether the
id is null, number of ids), then a fixed footer.

    header     b"TMPFOR01"
    block      <IHHBxxx> minimum, ids, exceptions, width; packed low bits;
               exceptions x uint16 positions; exceptions x uint32 differences
    starts     uint64 per block, and the end of the last
    directory  int64 keys, int64 doc_ids, uint8 nulls, uint64 lengths
    footer     <QQQ> blocks, documents, start of `starts`; b"TMPFOREN"
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

BLOCK = 512
PERCENTILE = 0.95
MAGIC, END = b"TMPFOR01", b"TMPFOREN"
HEAD, FOOT = struct.Struct("<IHHBxxx"), struct.Struct("<QQQ")


def widths(differences: np.ndarray) -> np.ndarray:
    """Bits that each unsigned difference needs; 0 for 0."""
    return np.frexp(differences.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as packed rows of bytes, least significant bit first."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(len(values), BLOCK, 4), axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(values), BLOCK * width), axis=1, bitorder="little")


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack() for rows of packed bytes."""
    if not width:
        return np.zeros((len(packed), BLOCK), np.uint32)
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    full = np.zeros((len(packed), BLOCK, 32), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full.reshape(len(packed), BLOCK * 32), axis=1, bitorder="little").view("<u4")


def blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of a stream of uint32 ids; only the last may hold fewer than BLOCK."""
    if not len(ids):
        return []
    short = -len(ids) % BLOCK
    rows = np.concatenate([ids, np.repeat(ids[-1:], short)]).reshape(-1, BLOCK)
    low = rows.min(axis=1)
    over = rows - low[:, None]
    need = widths(over)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(need, at, axis=1)[:, at]
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        packed = pack(over[mine] & np.uint32((1 << int(w)) - 1), int(w))
        for k, body in zip(mine.tolist(), packed, strict=True):
            odd = np.flatnonzero(need[k] > w)
            count = BLOCK - short if k == len(rows) - 1 else BLOCK
            out[k] = HEAD.pack(int(low[k]), count, len(odd), int(w)) + body.tobytes() + odd.astype("<u2").tobytes() + over[k][odd].astype("<u4").tobytes()
    return out


def unblocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; starts are offsets in data, with the end."""
    heads = [HEAD.unpack_from(data, s) for s in starts[:-1].tolist()]
    rows = np.empty((len(heads), BLOCK), np.uint32)
    width = np.array([h[3] for h in heads], np.uint8)
    raw = np.frombuffer(data, np.uint8)
    for w in np.unique(width):
        mine, size = np.flatnonzero(width == w), BLOCK // 8 * int(w)
        packed = raw[(starts[mine] + HEAD.size)[:, None].astype(np.int64) + np.arange(size)] if size else np.empty((len(mine), 0), np.uint8)
        rows[mine] = unpack(packed, int(w))
    for k, (_, _, odd, w) in enumerate(heads):
        if odd:
            at = int(starts[k]) + HEAD.size + BLOCK // 8 * w
            rows[k, np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    rows += np.array([h[0] for h in heads], np.uint32)[:, None]
    return rows.reshape(-1)[: sum(h[1] for h in heads)]


class Writer:
    """Writes documents one after another; holds at most CHUNK blocks of ids."""

    CHUNK = 512

    def __init__(self, out) -> None:
        self.out, self.at = out, len(MAGIC)
        self.starts: list[int] = []
        self.keys: list[int] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.held: list[bytes] = []
        self.held_bytes = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes, key: int = 0) -> None:
        """ids: little-endian uint32."""
        self.keys.append(key)
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * BLOCK * self.CHUNK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.held)
        keep = 0 if last else len(data) % (4 * BLOCK)
        for body in blocks(np.frombuffer(data, "<u4", (len(data) - keep) // 4)):
            self.starts.append(self.at)
            self.out.write(body)
            self.at += len(body)
        self.held = [data[len(data) - keep :]] if keep else []
        self.held_bytes = keep

    def close(self) -> None:
        self._flush(last=True)
        self.out.write(np.array([*self.starts, self.at], "<u8").tobytes())
        for values, kind in ((self.keys, "<i8"), ([d or 0 for d in self.docs], "<i8"), ([d is None for d in self.docs], "u1"), (self.lengths, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOT.pack(len(self.starts), len(self.docs), self.at) + END)


class Reader:
    """Documents of a file in their order; a document's ids can also be read alone by its place."""

    CHUNK = 512

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail = self._read(size - FOOT.size - len(END), FOOT.size + len(END))
        if tail[FOOT.size :] != END or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        n, docs, at = FOOT.unpack_from(tail)
        body = self._read(at, 8 * (n + 1) + 25 * docs)
        self.starts = np.frombuffer(body, "<u8", n + 1)
        at = 8 * (n + 1)
        self.keys = np.frombuffer(body, "<i8", docs, at)
        self.doc_ids = np.frombuffer(body, "<i8", docs, at + 8 * docs)
        self.nulls = np.frombuffer(body, "u1", docs, at + 16 * docs)
        self.lengths = np.frombuffer(body, "<u8", docs, at + 17 * docs).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def span(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first to last - 1."""
        at = int(self.starts[first])
        return unblocks(self._read(at, int(self.starts[last]) - at), self.starts[first : last + 1] - self.starts[first])

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at a place of the directory, by the block starts alone."""
        b, e = int(self.begins[place]), int(self.begins[place + 1])
        if b == e:
            return np.empty(0, np.uint32)
        first = b // BLOCK
        return self.span(first, -(-e // BLOCK))[b - first * BLOCK : e - first * BLOCK]

    def __iter__(self) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(key, doc_id, ids) of every document, CHUNK blocks at a time."""
        held, at, block = np.empty(0, np.uint32), 0, 0
        for k, null, doc, key in zip(range(len(self.doc_ids)), self.nulls.tolist(), self.doc_ids.tolist(), self.keys.tolist(), strict=True):
            need = int(self.lengths[k])
            parts, have = [held[at:]], len(held) - at
            while have < need:
                upto = min(block + self.CHUNK, len(self.starts) - 1)
                parts.append(self.span(block, upto))
                have, block = have + len(parts[-1]), upto
            if len(parts) > 1:
                held, at = np.concatenate(parts), 0
            yield key, None if null else doc, held[at : at + need]
            at += need
