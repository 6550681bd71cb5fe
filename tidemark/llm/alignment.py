"""Operator 11: how the tokens of two tokenizers meet, counted over the corpus by a cogroup of postings.

Side A is byte-level BPE of a blank and the text, side B SentencePiece of the
text, which puts that blank in front itself; added tokens' strings are plain
text. Both cover the same bytes. The places where tokens of both end cut them
into groups, and two tokens whose bytes overlap are a link.

1. A task encodes its texts. It cuts them before blanks and line ends that
   follow other characters, where neither side has a token across; the
   alignment of each distinct unit is worked out once while it is remembered.
   Of every stretch of documents it gives a row per document, and per A id a
   block of postings: the B ids, how many documents have each, and for each of
   those the document and how often the pair is linked there.
2. Counts of documents are summed by pair and gathered by A id: no more
   entries than B has ids.
3. Blocks are cogrouped with the counts of their A id: both are dealt by the
   id and sorted by it, counts first, so a task streams them (Spark spills what
   it sorts) and holds one id's counts and a bounded number of postings. An id
   with many postings is dealt to several tasks, its blocks by a hash, its
   counts to each. The task finds the id's highest count and gives what each
   document's links add up to.
4. These are summed by document, those of a stretch of documents together.

Texts that are null, empty, or that either side's tokens don't spell byte for
byte (as with U+2581 in them) have no tokens. A row is a document, so repeated
rows, several texts under one id and null ids count each and all stay. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, sentencepieces

#: Units of at most so many bytes are remembered, so many of them at most; longer ones are worked out where they stand.
UNIT_BYTES, UNITS = 64, 200_000
#: Texts whose new units go to the libraries at once; links and documents of a stretch; postings that a task of the cogroup holds.
AT_ONCE, STRETCH_LINKS, STRETCH_DOCS = 64, 1 << 20, 1 << 14
HELD_POSTINGS = 1 << 21
#: Postings of one A id that one task takes.
ID_POSTINGS = 4_000_000

CUT = re.compile(rf"(?<=[^{bpe.SPACE}])(?=[ \n])")

DOCUMENT = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCK = "a int, base long, postings long, bs array<int>, counts array<long>, docs binary, often binary"


class Unit(NamedTuple):
    """The alignment of a stretch of bytes: its sums of tokens of A and B and of groups, every link as a << 32 | b, `<u8`, and the groups spelt out."""

    sums: int
    links: bytes
    groups: str

    def __add__(self, other: Unit) -> Unit:
        return Unit(self.sums + other.sums, self.links + other.links, f"{self.groups};{other.groups}")


def packed(n_a: int, n_b: int, n_groups: int) -> int:
    """Three sums as one integer, so that those of many units are added at once."""
    return n_a | n_b << 64 | n_groups << 128


def unpacked(sums: int) -> tuple[int, int, int]:
    low = (1 << 64) - 1
    return sums & low, sums >> 64 & low, sums >> 128


def align(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> Unit:
    """Both sides' tokens with the bytes at which they end; the last ends are equal."""
    if a_ends == b_ends:
        return Unit(packed(len(a), len(b), len(a)), array("Q", [x << 32 | y for x, y in zip(a, b, strict=True)]).tobytes(), ";".join([f"{x}|{y}" for x, y in zip(a, b, strict=True)]))
    links, groups, first, i, j = [], [], (0, 0), 0, 0
    while i < len(a):
        links.append(a[i] << 32 | b[j])
        at_a, at_b = a_ends[i], b_ends[j]
        i += at_a <= at_b
        j += at_b <= at_a
        if at_a == at_b:
            groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
            first = i, j
    return Unit(packed(len(a), len(b), len(groups)), array("Q", links).tobytes(), ";".join(groups))


class Aligner:
    """units(texts) gives the units of each text with their number in order, None for a text without tokens."""

    def __init__(self, path_a: str, path_b: str, limit: int = UNITS) -> None:
        from tokenizers import Tokenizer

        self.a, self.b, self.limit = Tokenizer.from_file(path_a), sentencepieces.Codec(path_b), limit
        self.a.encode_special_tokens = True
        letters = frozenset(bpe.byte_letters())
        # a letter of a byte-level token stands for a byte
        self.a_size = {k: len(t) if letters.issuperset(t) else 0 for t, k in self.a.get_vocab().items()}
        pieces = list(map(self.b.library.id_to_piece, range(self.b.library.get_piece_size())))
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := sentencepieces.BYTE.fullmatch(p)) else p.replace(sentencepieces.BLANK, " ").encode() for p in pieces]
        self.b_size = list(map(len, self.b_bytes))
        self.cuts = self.b.cuts and self.b.prefix and not self.b.trims and not self.b.map.units
        #: Marks before which neither side has a token across, if a letter stands there.
        self.marks = frozenset(m for m in bpe.ENDS if not any(m in p[1:] and any(x.isalpha() for x in p[: p.rindex(m)]) for p in pieces)) - {"'"}
        self.known: dict[str, Unit | None] = {}
        self.elder: dict[str, Unit | None] = {}

    def keys(self, text: str) -> list[str]:
        """The units of a blank and the text; the blank in front of a unit is left out if a word follows."""
        flat = text.replace("\n", " ")
        if "  " not in flat and flat[0] != " " != flat[-1] and (flat.isprintable() or text.split() == flat.split(" ")):
            return text.replace("\n", " \n").split(" ")
        return [u[1:] if u[0] == " " and u[1:2] not in ("", " ", "\n") else u for u in CUT.split(" " + text)]

    def work_out(self, whole: list[str]) -> list[Unit | None]:
        """The alignments of stretches of text, each put to both libraries as it is."""
        a = self.a.encode_batch_fast(whole, add_special_tokens=False)
        b = self.b.merges.encode([u.replace(" ", sentencepieces.BLANK) for u in whole], num_threads=1)
        return [self.unit(u, x.ids, y) for u, x, y in zip(whole, a, b, strict=True)]

    def unit(self, text: str, a: list[int], b: list[int]) -> Unit | None:
        """The alignment of a text's ids; None if they don't spell its bytes."""
        raw = text.encode()
        a_ends = list(itertools.accumulate(map(self.a_size.__getitem__, a)))
        if a_ends[-1] != len(raw) or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return align(a, a_ends, b, list(itertools.accumulate(map(self.b_size.__getitem__, b))))

    def recall(self, keys: set[str]) -> dict[str, Unit | None]:
        """What stretches of text stand for: remembered, or worked out together."""
        found, new = {}, []
        for k in keys:
            u = self.known.get(k, 0)
            if u == 0:
                u = self.elder.get(k, 0)
                if u == 0:
                    new.append(k)
                    continue
                self.known[k] = u
            found[k] = u
        worked = dict(zip(new, self.work_out([k if k[0] in " \n" else " " + k for k in new]), strict=True)) if new else {}
        if len(self.known) + len(new) > self.limit:
            self.known, self.elder = {}, self.known
        # a character takes four bytes at most
        self.known.update((k, u) for k, u in worked.items() if len(k) * 4 <= UNIT_BYTES or len(k.encode()) <= UNIT_BYTES)
        return found | worked

    def units(self, texts: list[str]) -> Iterator[tuple[list[str], dict[str, Unit | None]] | None]:
        """Of each text its keys in order and what they stand for."""
        if not self.cuts:
            for t in texts:
                found = self.unit(" " + t, self.a.encode(" " + t, add_special_tokens=False).ids, self.b.library.encode(t)) if t else None
                yield None if found is None else ([t], {t: found})
            return
        all_keys = [self.keys(t) if t and sentencepieces.BLANK not in t else None for t in texts]
        own = set(itertools.chain.from_iterable(filter(None, all_keys)))
        ended = {k for k in own if k[-1] in self.marks and k[-2:-1].isalpha()}
        found = self.recall((own - ended) | {k[:-1] for k in ended})
        for k in ended:
            word, mark = found[k[:-1]], self.mark(k[-1])
            found[k] = word + mark if word is not None and mark is not None else None
        for keys in all_keys:
            yield None if keys is None or any(found[k] is None for k in keys) else (keys, found)

    @functools.cache  # noqa: B019  a worker has one aligner, and marks are few
    def mark(self, mark: str) -> Unit | None:
        return self.unit(mark, self.a.encode(mark, add_special_tokens=False).ids, self.b.merges.encode(mark))


def default_paths() -> tuple[str, str]:
    return bpe.default_path(), sentencepieces.default_path()


def encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of DOCUMENT and of BLOCK, stored; what isn't of a row's kind is null."""
    schema = pa.schema(
        [("key", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]
        + [("a", pa.int32()), ("base", pa.int64()), ("postings", pa.int64()), ("bs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("docs", pa.binary()), ("often", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = common.lasting(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        pairs = (row for batch in batches for row in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True))
        # a stored attempt has the keys of its documents and postings both, so another attempt's keys don't matter
        base = TaskContext.get().partitionId() << 40
        rows, held, links = [], [], 0
        for some in itertools.batched(pairs, AT_ONCE):
            for (doc_id, _), found in zip(some, aligner.units([t.as_py() or "" for _, t in some]), strict=True):
                if found is None:
                    rows.append((base + len(rows), doc_id, 0, 0, 0, 0, ""))
                    continue
                keys, units = found
                own = Counter(keys)
                sums, own_links, _ = zip(*[units[k] for k in own], strict=True)
                times = np.fromiter(own.values(), np.int64, len(own))
                each = np.fromiter(map(len, own_links), np.int64, len(own)) >> 3
                totals = unpacked(sum(map(operator.mul, sums, own.values())))
                spelt = hashlib.sha256(";".join([units[k][2] for k in keys]).encode()).hexdigest()
                held.append((np.frombuffer(b"".join(own_links), "<u8"), np.repeat(times, each), len(rows)))
                links += len(held[-1][0])
                rows.append((base + len(rows), doc_id, *totals, int(times @ each), spelt))
                if links > STRETCH_LINKS or len(rows) >= STRETCH_DOCS:
                    yield from stretch(rows, held, base, schema)
                    base += len(rows)
                    rows, held, links = [], [], 0
            if len(rows) >= STRETCH_DOCS:
                yield from stretch(rows, held, base, schema)
                base += len(rows)
                rows, held, links = [], [], 0
        yield from stretch(rows, held, base, schema)

    return common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(common.map_batches, run, f"{DOCUMENT}, {BLOCK}"), "alignment")


def stretch(rows: list[tuple], held: list[tuple[np.ndarray, np.ndarray, int]], base: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The documents of a stretch, then its postings as a block per A id."""
    if rows:
        nothing = [pa.nulls(len(rows), f.type) for f in list(schema)[7:]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)), *nothing], schema=schema)
    if not held:
        return
    pair = np.concatenate([p for p, _, _ in held])
    doc = np.repeat(np.array([k for _, _, k in held], np.int32), [len(p) for p, _, _ in held])
    order = np.lexsort((doc, pair))
    pair, doc, times = pair[order], doc[order], np.concatenate([t for _, t, _ in held])[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]))
    pair, doc, often = pair[first], doc[first].astype("<u4"), np.add.reduceat(times, first).astype("<i8")
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))  # postings begin a pair
    counts, ids = np.diff(np.append(at, len(pair))), (pair[at] >> np.uint64(32)).astype(np.int32)
    b = (pair[at] & np.uint64(0xFFFF_FFFF)).astype(np.int32)
    to = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # pairs begin an id
    pair_at, post_at = np.append(to, len(ids)).astype(np.int32), np.append(at[to], len(pair)).astype(np.int32)
    n = len(to)
    binary = lambda values, size: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((post_at * size).astype(np.int32)), pa.py_buffer(values.tobytes())])
    columns = [pa.array(ids[to]), pa.array(np.full(n, base)), pa.array(np.diff(post_at).astype(np.int64))]
    columns += [pa.ListArray.from_arrays(pair_at, pa.array(v)) for v in (b, counts.astype(np.int64))]
    yield pa.RecordBatch.from_arrays([*(pa.nulls(n, f.type) for f in list(schema)[:7]), *columns, binary(doc, 4), binary(often, 8)], schema=schema)


PARTS = "base long, docs binary, n_best binary, count_sum binary"


def cogroup(batches: Iterator[pa.RecordBatch], n_ids: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of PARTS, what documents of a stretch get from this task's ids, from rows in order of (a, salt, tag): each id's counts, then its blocks of postings, of which it holds `most`."""
    counts, highest, at = np.zeros(n_ids, np.int64), 0, None
    held: list[np.ndarray] = []
    n_held = 0
    for batch in batches:
        ids, salts, tags = (batch.column(c).to_numpy() for c in ("a", "salt", "tag"))
        begins = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (salts[1:] != salts[:-1]) | (tags[1:] != tags[:-1])]))
        for low, high in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True):
            part = batch.slice(low, high - low)
            b, n = (part.column(c).flatten().to_numpy() for c in ("bs", "counts"))
            if (ids[low], salts[low]) != at:
                at = ids[low], salts[low]
                counts[:] = 0
            if tags[low] == 0:
                counts[b] = n  # the counts of an id are one row
                highest = int(n.max(initial=0))
                continue
            doc, often = (np.frombuffer(b"".join(part.column(c).to_pylist()), t).astype(np.int64) for c, t in (("docs", "<u4"), ("often", "<i8")))
            count = np.repeat(counts[b], n)
            held.append(np.stack([np.repeat(part.column("base").to_numpy(), part.column("postings").to_numpy()) + doc, often * (count == highest), often * count]))
            n_held += len(doc)
            if n_held > most:
                yield summed(held)
                held, n_held = [], 0
    if held:
        yield summed(held)


def summed(held: list[np.ndarray]) -> pa.RecordBatch:
    """Sums by document, a row per stretch of STRETCH_DOCS places or less: a stretch's keys are within one multiple of it."""
    every = np.concatenate(held, axis=1)
    every = every[:, np.argsort(every[0], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], every[0, 1:] != every[0, :-1]]))
    keys, (best, total) = every[0, first], np.add.reduceat(every[1:], first, axis=1)
    stretches = keys // STRETCH_DOCS
    at = np.flatnonzero(np.concatenate([[True], stretches[1:] != stretches[:-1]]))
    offsets = np.append(at, len(keys))
    binary = lambda values, size: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((offsets * size).astype(np.int32)), pa.py_buffer(values.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(stretches[at] * STRETCH_DOCS), binary((keys - stretches * STRETCH_DOCS).astype("<u4"), 4), binary(best.astype("<i8"), 8), binary(total.astype("<i8"), 8)], names=["base", "docs", "n_best", "count_sum"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n_best and count_sum of every document with links, from rows of PARTS in order of base."""
    base, sums, seen = None, np.zeros((2, STRETCH_DOCS), np.int64), np.zeros(STRETCH_DOCS, bool)

    def told() -> pa.RecordBatch:
        at = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(base + at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["key", "n_best", "count_sum"])

    for batch in batches:
        for own, *parts in zip(*(batch.column(c).to_pylist() for c in ("base", "docs", "n_best", "count_sum")), strict=True):
            if own != base:
                if base is not None:
                    yield told()
                base, sums[:], seen[:] = own, 0, False
            doc = np.frombuffer(parts[0], "<u4")
            seen[doc] = True
            for k in range(2):
                sums[k, doc] += np.frombuffer(parts[k + 1], "<i8")
    if base is not None:
        yield told()


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]
    import sentencepiece

    most, n_ids = HELD_POSTINGS, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    encoded = encode(docs, path_a, path_b)
    blocks, documents = encoded.where("a is not null").select("a", "base", "postings", "bs", "counts", "docs", "often"), encoded.where("key is not null").select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    # a row per A id: no more than the vocabulary has
    dealt = F.broadcast(blocks.groupBy("a").agg(F.ceil(F.sum("postings") / ID_POSTINGS).cast("int").alias("salts")))
    pairs = blocks.select("a", F.inline(F.arrays_zip("bs", "counts"))).groupBy("a", "bs").agg(F.sum("counts").alias("n"))
    counts = pairs.groupBy("a").agg(F.collect_list(F.struct("bs", "n")).alias("all")).join(dealt, "a")
    null = F.lit(None)
    first = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tag"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("postings"), F.col("all.bs").alias("bs"), F.col("all.n").alias("counts"), null.cast("binary").alias("docs"), null.cast("binary").alias("often"))
    then = blocks.join(dealt, "a").select("a", F.pmod(F.xxhash64("base"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("tag"), "base", "postings", "bs", "counts", "docs", "often")
    streams = first.unionByName(then).repartition("a", "salt").sortWithinPartitions("a", "salt", "tag")
    parts = streams.transform(common.map_batches, lambda b: cogroup(b, n_ids, most), PARTS)
    sums = parts.repartition("base").sortWithinPartitions("base").transform(common.map_batches, merged, "key long, n_best long, count_sum long")
    zero = F.lit(0).cast("long")
    return documents.join(sums, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
