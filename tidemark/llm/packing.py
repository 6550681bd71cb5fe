"""Operator 9: mixture-controlled packing into sequences of fixed length.

Every source is a queue of tokens, its documents in ascending doc_id order.
Deficit round-robin serves the queues in rounds. In each round every queue
that still has tokens is credited with its share of WINDOW tokens; it serves
as many whole TURNs as its credit pays for, in order of the queues, and
carries what is left, its deficit, into the next round. A queue whose credit
covers all it still has serves that and drops out; from the next round on the
others share WINDOW tokens among them. The served tokens form one stream that
is cut every WINDOW tokens: no padding but in the last sequence, and every
window holds the target mixture to within a turn per queue.

Between two dropouts every round is alike, so a queue's credit after r rounds
is a linear function of r in at most one stretch per queue. Rounds holds those
stretches, from the totals and shares alone, and each task works out the
rounds and places of its own documents: deficits carry across windows and
partitions without a pass over the stream. All is in whole numbers: credit is
counted in 1 / UNIT of a token.

The default target is the corpus's own mixture, so all queues end together. A
source with less than LEAST_SHARE of the bytes, less than a token in a window,
shares one of TAIL_QUEUES queues with others of that kind, unless the mixture
names it; so at most 1 / LEAST_SHARE + TAIL_QUEUES queues and the named ones
exist, and what each task is sent has a fixed bound.

Null texts are empty and have the end id alone; a null source is a queue of
its own; null doc_ids come first in their queue; repeated rows are all
packed; a mixture's sources without documents are ignored, and its shares
must be above 0; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, token_files

WINDOW = 1024
#: Tokens that a queue serves at once, and the fractions of a token in which credit is counted.
TURN, UNIT = 32, 1 << 16
#: Shares are rounded to whole multiples of 1 / SHARES.
SHARES = 1 << 30
LEAST_SHARE, TAIL_QUEUES = 1 / 1024, 64
#: Tokens of a queue that a task places at once, and cells of (round, queue) that it works out at once.
PLACED, CELLS = 1 << 20, 1 << 20

PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("source", pa.string())])


def name_of(source: str | None) -> str:
    return "null" if source is None else f"={source}"


def queue_of(docs: DataFrame, named: Iterable[str | None] = ()) -> tuple[Column, Column]:
    """The queue's name and that of the source; null and '' differ."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    sizes = docs.groupBy(name.alias("name")).agg(F.sum(F.octet_length(common.text_of()) + 1).alias("size"))
    whole = sizes.agg(F.sum("size")).first()[0] or 0
    own = {r["name"] for r in sizes.where(F.col("size") >= LEAST_SHARE * whole).collect()}  # at most 1 / LEAST_SHARE rows
    own |= set(map(name_of, named))
    return F.when(name.isin(sorted(own)), name).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64(name), F.lit(TAIL_QUEUES)))), name


class Rounds:
    """The schedule of queues with these totals and shares: for each stretch of like rounds its first round, and every queue's credit then and per round."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, window: int = WINDOW, turn: int = TURN) -> None:
        self.totals, self.window, self.turn = np.asarray(totals, np.int64), window, turn
        shares = np.asarray(shares, np.float64)
        if (self.totals <= 0).any() or (self.totals >= 1 << 46).any():
            raise ValueError("a queue has from 1 to 2**46 tokens")
        if not 0 < window <= 1 << 16:
            raise ValueError("a window has from 1 to 65536 tokens")
        if not (np.isfinite(shares) & (shares > 0)).all():
            raise ValueError("shares must be above 0")
        weights = np.maximum(1, np.rint(shares / max(shares.sum(), 1e-300) * SHARES)).astype(np.int64)
        self.price = self.totals * UNIT
        begin, credit, left = 0, np.zeros(len(weights), np.int64), np.ones(len(weights), bool)
        begins, credits, quanta = [], [], []
        while left.any():
            quantum = np.where(left, np.maximum(1, window * UNIT * weights // weights[left].sum()), 0)
            begins.append(begin)
            credits.append(credit)
            quanta.append(quantum)
            rounds = int((-(-(self.price - credit)[left] // quantum[left])).min())
            begin, credit = begin + rounds, np.minimum(self.price, credit + rounds * quantum)
            left = credit < self.price
        self.begins = np.array([*begins, begin], np.int64)
        self.credits = np.array([*credits, credit], np.int64)
        self.quanta = np.array([*quanta, np.zeros(len(weights), np.int64)], np.int64)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of every queue served before each round: rounds x queues."""
        at = np.searchsorted(self.begins, rounds, "right") - 1
        credit = self.credits[at] + (rounds - self.begins[at])[:, None] * self.quanta[at]
        return np.where(credit >= self.price, self.totals, credit // (self.turn * UNIT) * self.turn)

    def round_of(self, queue: int, tokens: np.ndarray) -> np.ndarray:
        """The round that serves each token of a queue."""
        price = np.minimum(self.price[queue], (tokens // self.turn + 1) * (self.turn * UNIT))
        at = np.searchsorted(self.credits[:, queue], price) - 1
        return self.begins[at] - -(price - self.credits[at, queue]) // self.quanta[at, queue] - 1

    def runs(self, queue: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts in the queue and places in the stream of the runs that tokens start .. stop - 1 are served in."""
        turns = np.arange(start // self.turn, -(-stop // self.turn), dtype=np.int64) * self.turn
        rounds = self.round_of(queue, turns)
        new = np.concatenate([[True], rounds[1:] != rounds[:-1]])
        begin, rounds = np.maximum(turns[new], start), rounds[new]
        place = np.empty(len(begin), np.int64)
        step = max(1, CELLS // len(self.totals))
        for k in range(0, len(begin), step):
            now, after = self.served(rounds[k : k + step]), self.served(rounds[k : k + step] + 1)
            place[k : k + step] = after[:, :queue].sum(axis=1) + now[:, queue + 1 :].sum(axis=1) + begin[k : k + step]
        return begin, place

    def pieces(self, queue: int, start: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents of these lengths (above 0) that lie one behind another in a queue from token start: the pieces' document, start in the queue, length, and place in the stream."""
        edges = start + np.concatenate([[0], np.cumsum(lengths)])
        begin, place = self.runs(queue, start, int(edges[-1]))
        size = np.diff(begin, append=edges[-1])
        # windows that a run goes on into
        more = (place + size - 1) // self.window - place // self.window
        run = np.repeat(np.arange(len(begin)), more)
        window = (place // self.window)[run] + 1 + np.arange(len(run)) - np.repeat(np.cumsum(more) - more, more)
        cuts = np.unique(np.concatenate([begin, edges[:-1], begin[run] + window * self.window - place[run]]))
        run = np.searchsorted(begin, cuts, "right") - 1
        return np.searchsorted(edges, cuts, "right") - 1, cuts, np.diff(cuts, append=edges[-1]), place[run] + cuts - begin[run]


def pack(docs: DataFrame, path: str | None = None, mixture: Mapping[str | None, float] | None = None, window: int = WINDOW, turn: int = TURN, remembered: int = bpe.LIMIT) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    mixture: target share of tokens by source, null as None; sources that it leaves out get their share of the corpus. remembered: words that a worker remembers.
    """
    if any(not share > 0 for share in (mixture or {}).values()):
        raise ValueError("shares must be above 0")
    queue, name = queue_of(docs, mixture or ())
    manifest = token_files.write_token_files(docs, path, key=queue, label=name, remembered=remembered)
    queues = manifest.groupBy("key").agg(F.sum("n_tokens").alias("n")).orderBy("key").collect()  # bounded by queue_of()
    place = {q["key"]: k for k, q in enumerate(queues)}
    totals = np.array([q["n"] for q in queues], np.int64)
    shares = totals / max(1, totals.sum())
    for source, share in (mixture or {}).items():
        if (k := place.get(name_of(source))) is not None:
            shares[k] = share

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(totals, shares, window, turn)
        for batch in batches:
            for file in batch.to_pylist():
                for key, base, held in by_queue(token_files.documents_of(file["path"], file["bases"])):
                    yield placed(rounds, place[key], base, held)

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return token_files.per_file(manifest).transform(common.map_batches, rows, fields)


Held = list[tuple[str, int | None, np.ndarray]]


def by_queue(documents: Iterator[tuple[str, str, int | None, int, np.ndarray]]) -> Iterator[tuple[str, int, Held]]:
    """(queue, tokens of it before, its next documents): about PLACED tokens at a time."""
    last, base, size, held = None, 0, 0, []
    for key, label, doc_id, at, ids in documents:
        if held and (key != last or size >= PLACED):
            yield last, base, held
            held = []
        if not held:
            last, base, size = key, at, 0
        held.append((label, doc_id, ids))
        size += len(ids)
    if held:
        yield last, base, held


def placed(rounds: Rounds, queue: int, base: int, held: Held) -> pa.RecordBatch:
    """The pieces of documents that lie one behind another in a queue."""
    lengths = np.array([len(ids) for _, _, ids in held], np.int64)
    document, start, length, place = rounds.pieces(queue, base, lengths)
    data = memoryview(np.concatenate([ids for _, _, ids in held]).astype("<u4").tobytes())
    ends = 4 * (start + length - base)
    crcs = [zlib.crc32(data[a:b]) for a, b in zip((4 * (start - base)).tolist(), ends.tolist(), strict=True)]
    before = base + np.cumsum(lengths) - lengths
    at = pa.array(document)
    doc_id = pa.array([d for _, d, _ in held], pa.int64()).take(at)
    source = pa.array([None if label == "null" else label[1:] for label, _, _ in held], pa.string()).take(at)
    numbers = (start - before[document], length, np.array(crcs, np.int64), lengths[document], place // rounds.window, place % rounds.window)
    return pa.RecordBatch.from_arrays([doc_id, *map(pa.array, numbers), source], schema=PIECES)
