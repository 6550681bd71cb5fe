"""Operator 2: SentencePiece ids with the original byte span of every piece.

A text is normalised by the model's compiled character map: at each position
the longest prefix in the map's double-array trie is replaced, else one
character is kept, and every byte of the result records the byte of the text
that it came from. Blanks become U+2581 and one is put in front. The merges
are the library's, run without a normaliser of its own on the normalised
text; each id's piece then covers known bytes of it, which the record
projects back to the text.

No piece of the vocabulary has U+2581 or a line end after another character,
so merges never cross the places before them; the text is cut there and each
distinct unit is merged once while it is remembered. The memory has a fixed
number of units. A vocabulary with such pieces turns the cutting off.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import common

BLANK = "▁"
AT_ONCE = 64
#: Units of more characters are forgotten once their texts are done.
REMEMBERED = 64
UNIT = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n[^{BLANK}\n]*|[^{BLANK}\n]+")
BYTE = re.compile("<0x([0-9A-F]{2})>")


class CharMap:
    """A compiled character map: <I size of the trie, the trie's units, replacements ended by NUL."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken by the longest key that starts at a position, and its replacement."""
        if not self.units:
            return None
        node, found = self.offset(self.units[0]), None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != data[k]:
                break
            node ^= self.offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The text with all replacements, and for each of its bytes (and its end) the byte of the text it came from."""
        data, out, origin, at = text.encode(), bytearray(), [], 0
        while at < len(data):
            lead = data[at]
            taken, new = self.longest(data, at) or (n := 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), data[at : at + n])
            out += new
            same = taken == len(new) and data[at : at + taken] == new
            origin += range(at, at + taken) if same else [at] * len(new)
            at += taken
        return out.decode(), [*origin, len(data)]


class Encoded(NamedTuple):
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class Units(dict):
    """Unit of normalised text -> its ids as bytes, `<u4`; forgets all when full, and long units at the next call."""

    def __init__(self, merge, limit: int) -> None:
        self.merge, self.limit, self.long = merge, limit, []

    def learn(self, units: set[str]) -> None:
        """Merges the units that aren't known in one call."""
        for u in self.long:
            self.pop(u, None)
        self.long = [u for u in units if len(u) > REMEMBERED]
        if len(self) + len(units) > self.limit:
            self.clear()
        new = [u for u in units if u not in self]
        self.update(zip(new, [array("I", ids).tobytes() for ids in self.merge(new)], strict=True))


class Codec:
    """encode(text) and decode(ids) of one model."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.map, self.trims, self.prefix = CharMap(spec.precompiled_charsmap), spec.remove_extra_whitespaces, spec.add_dummy_prefix
        spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.name = b"", False, False, "identity"
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [p.piece for p in model.pieces]
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.unknown = next((k for k, p in enumerate(model.pieces) if p.type == 2), -1)
        self.sizes = np.array([1 if BYTE.fullmatch(p) else len(p.encode()) for p in pieces])
        self.units = Units(lambda units: self.merges.encode(units, num_threads=1), limit)

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text, and where its bytes came from: None if it is the text with blanks escaped behind one more."""
        if not self.map.units and not self.trims and BLANK not in text:
            return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK), None
        plain, origin = self.map.normalise(text)
        out, at, last_blank = [], [], True
        for ch, k in zip(plain, np.cumsum([0, *(len(c.encode()) for c in plain)]).tolist(), strict=False):
            if self.trims and ch == " " and last_blank:
                continue
            last_blank = ch == " "
            size = len(ch.encode())
            out.append(BLANK if ch == " " else ch)
            at += [origin[k]] * 3 if ch == " " else origin[k : k + size]
        while self.trims and out and out[-1] == BLANK and last_blank:
            out.pop()
            del at[-3:]
        if self.prefix and out:
            out.insert(0, BLANK)
            at[:0] = [at[0]] * 3
        return "".join(out), [*at, origin[-1]]

    def encode(self, texts: list[str]) -> list[Encoded]:
        """All ids of each text; begins and ends are offsets in its UTF-8 bytes."""
        plain = [self.normalise(t) for t in texts]
        units = [UNIT.findall(p) if self.cuts else [p] if p else [] for p, _ in plain]
        self.units.learn(set().union(*units))
        return [self.spans(p, origin, b"".join([self.units[u] for u in own])) for (p, origin), own in zip(plain, units, strict=True)]

    def spans(self, plain: str, origin: list[int] | None, found: bytes) -> Encoded:
        ids = np.frombuffer(found, "<u4")
        sizes = self.sizes[ids] if not (ids == self.unknown).any() else self.sizes_with_unknowns(plain)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        if origin is not None:
            spot = np.array(origin)
            begins, ends = spot[begins], spot[ends]
        elif len(ids):
            raw = np.frombuffer(plain.encode(), np.uint8)
            # an escaped blank is three bytes here and one in the text; the first is none
            blanks = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
            at = np.flatnonzero(blanks)
            begins, ends = self.unescaped(begins, at), self.unescaped(ends, at)
        return Encoded(ids, begins, ends)

    def unescaped(self, places: np.ndarray, blanks: np.ndarray) -> np.ndarray:
        before = np.searchsorted(blanks, places)
        return np.maximum(0, places - 2 * before - (before > 0) * self.prefix)

    def sizes_with_unknowns(self, plain: str) -> np.ndarray:
        """Bytes of each piece, where the library tells pieces of unknown characters by their surface."""
        return np.array([len(p.surface.encode()) for p in self.merges.encode(plain, return_type="proto").pieces], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, begins, ends (spans in the text's bytes) and decoded of every document, in place: no shuffle.

    A null text counts as empty: no ids, the empty decoding. Rows are taken
    one by one, so repeats, ties and null ids stay; other columns are ignored.
    """
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("ids", "begins", "ends")), ("decoded", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        c = codec(path)
        for doc_id, e in encoded(batches, c):
            yield doc_id, e.ids, e.begins, e.ends, c.decode(e.ids)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), schema, 256), "doc_id long, ids array<long>, begins array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """encode_documents() with digests for its arrays: n_tokens, ids_sha256, decoded_sha256, span_bytes (bytes that spans cover)."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("span_bytes", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        c = codec(path)
        for doc_id, e in encoded(batches, c):
            ids = e.ids.tolist()
            yield doc_id, len(ids), sha256(",".join(map(str, ids))), sha256(c.library.decode(ids)), int((e.ends - e.begins).sum())

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(batches: Iterator[pa.RecordBatch], c: Codec) -> Iterator[tuple[int | None, Encoded]]:
    """The documents of Arrow batches, AT_ONCE texts merged in a call."""
    pairs = (row for batch in batches for row in zip(batch.column("doc_id"), batch.column("text"), strict=True))
    for some in itertools.batched(pairs, AT_ONCE):
        for (doc_id, _), e in zip(some, c.encode([text.as_py() or "" for _, text in some]), strict=True):
            yield doc_id.as_py(), e
