"""Operator 8: n-gram Jaccard join by prefix trees.

A document is the set of its distinct runs of n words (all words as one run
if fewer), words lower-cased in A-Z. Two documents link when their sets'
intersection is at least `percent` hundredths of their union.

1. Equal sets become one node, whose id is a hash of the set.
2. Blocks. Sizes fall into levels such that linked sets are in one or in two
   that follow each other; a set takes part in its own level and, as the
   smaller, in the next. Linked sets of sizes a and b differ in at most
   (a + b) * (100 - percent) / (100 + percent) members. Members are dealt to
   more buckets than that by their hash, so linked sets have an equal bucket.
   The bucket's content and the level are a signature; of these, each set
   gives the first in one order, one more than can be unlike, and sets that
   share one are candidates. Members that many sets have, as passages do, are left out
   of both sides' buckets, which leaves the bound as it is: no link can be
   missed, and sets that merely share a passage don't meet.
3. A level's candidates' connected components are split into chunks of bounded
   size, and each pair of chunks is a task of the join. A pair is looked at in
   the level of its larger set alone.
4. In a task all sets are written in one global order of members, most common
   first, and the first chunk's sets go into a prefix tree. Each set of the
   second walks the tree: a shared prefix's overlap is counted once for all
   sets below, and a subtree is left as soon as the members that remain there
   and in the set can't reach the needed overlap.
5. The links' components, and with them the nodes' documents.

Null texts and texts without words have the empty set, n_shingles 0, and link
with nothing. Rows with a null doc_id take the component of documents with
the same set, or null if there is none, and link to no others. Repeated rows
are one node; several texts under one doc_id are nodes of their own. Other
columns are ignored or passed through; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, components

CHUNK_SETS = 1024
CHUNK_MEMBERS = 1 << 20
BROADCAST_ROWS = 1_000_000
SIGNATURES_HELD = 1 << 19
#: Signatures that a task sorts at once, at about 60 bytes each.
SORTED_ROWS = 1 << 20
#: Members that so many sets of a stretch share are left out of signatures, the most common MOST_COMMON of them.
COMMON_SETS, MOST_COMMON = 3, 1_000_000
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class WordHashes(dict):
    """Word -> 64-bit hash; forgets all when full, and doesn't keep long words."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = out
        return out

    @classmethod
    def lasting(cls) -> WordHashes:
        return common.lasting(cls.__qualname__, cls)


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The set of a text: ascending distinct 64-bit hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, U(size))
    for k in range(size):
        out = mixed(out * U(31) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def set_id(members: np.ndarray) -> int:
    """A hash of the whole set as a signed 64-bit integer."""
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


class Levels(NamedTuple):
    """Lower bounds of size classes: linked sets are in one class or two that follow each other."""

    percent: int
    bounds: np.ndarray

    @classmethod
    def of(cls, percent: int, largest: int) -> Levels:
        bounds = [1]
        while bounds[-1] <= largest:
            bounds.append(bounds[-1] * 100 // percent + 1)
        return cls(percent, np.array([*bounds, bounds[-1] * 100 // percent + 1, (bounds[-1] * 100 // percent + 1) * 100 // percent + 1]))

    def of_size(self, size: int) -> tuple[int, int]:
        """The levels at which a set of this size is signed: its own class, and the next, where it is the smaller."""
        own = int(np.searchsorted(self.bounds, size, "right")) - 1
        return own, own + 1

    def most_unlike(self, level: int) -> int:
        return 2 * (int(self.bounds[level + 1]) - 1) * (100 - self.percent) // (100 + self.percent)

    def unlike_of(self, size: int, level: int) -> int | None:
        """How many members a set of this size and any that links with it at the level differ in at most; None if none of the level can."""
        largest = min(int(self.bounds[level + 1]) - 1, size * 100 // self.percent)
        return None if largest < self.bounds[level] else (size + largest) * (100 - self.percent) // (100 + self.percent)


def signatures(members: np.ndarray, levels: Levels, common_members: np.ndarray) -> list[np.ndarray]:
    """Signatures of a set in each of its levels. Linked sets share one in the level of the larger.

    Unlike members touch at most unlike_of() buckets, whichever members are
    left out of both sets, so two linked sets lack at most that many of each
    other's signatures: the first ones of each in one order, one more than
    that, have one in common. Those in common_members, one list for all sets,
    are left out first: the buckets with other members are signed. If they are
    no more than can be unlike, the whole set's buckets are signed too, and
    behind those as many empty ones as are wanting.
    """
    at = np.minimum(np.searchsorted(common_members, members), max(0, len(common_members) - 1))
    rest = members[common_members[at] != members] if len(common_members) else members
    out = []
    for level in levels.of_size(len(members)):
        unlike = levels.unlike_of(len(members), level)
        if unlike is None:
            out.append(np.empty(0, np.uint64))
            continue
        most = levels.most_unlike(level)
        buckets = most + 1 + most // 5
        salt = U(level << 40) + U(1 << 36)
        found = firsts(filled_buckets(rest, buckets, salt)[1], unlike + 1)
        if len(found) <= unlike:
            salt += U(1 << 37)
            full, whole = filled_buckets(members, buckets, salt)
            whole = firsts(whole, unlike + 1)
            empty = np.setdiff1d(np.arange(buckets, dtype=np.uint64), full) if len(whole) <= unlike else np.empty(0, np.uint64)
            found = np.concatenate([found, whole, firsts(mixed(mixed(salt + empty)), unlike + 1 - len(whole))])
        out.append(found)
    return out


def firsts(values: np.ndarray, n: int) -> np.ndarray:
    """The n least values."""
    return np.partition(values, n - 1)[:n] if 0 < n < len(values) else values[: max(n, 0)]


def filled_buckets(members: np.ndarray, buckets: int, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that have members, and a signature of each one's content."""
    if not len(members):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    bucket = (members >> U(32)) * U(buckets) >> U(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket[first], mixed(mixed(salt + bucket[first]) + np.add.reduceat(mixed(members + U(0x9E3779B97F4A7C15)), first))


def node_of(set_id: int, level: int) -> int:
    """A set in a level, as a signed 64-bit integer."""
    return int(mixed(np.array([(set_id + (1 << 63)) ^ (level + 1) * 0x9E3779B97F4A7C15 & 0xFFFF_FFFF_FFFF_FFFF], np.uint64)).view(np.int64)[0])


class Node(NamedTuple):
    """A radix node: the members after its parent's, the length so far, lengths of sets below, sets that end here."""

    segment: np.ndarray
    depth: int
    least: int
    most: int
    ends: list[int]
    children: list[Node]


class PrefixTree:
    """Sets of ranks, each ascending, in a radix tree."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">i4").tobytes())
        self.root = self._node(order, 0) if order else None

    def _node(self, order: list[int], depth: int) -> Node:
        """The node of sets in lexical order that agree up to depth and on the member there. Depth of recursion is bounded by branching, not length."""
        first, last = self.sets[order[0]], self.sets[order[-1]]
        n = min(len(first), len(last))
        apart = np.flatnonzero(first[depth:n] != last[depth:n])
        upto = depth + int(apart[0]) if len(apart) else n
        sizes = [len(self.sets[k]) for k in order]
        ends = [k for k, s in zip(order, sizes, strict=True) if s == upto]
        node = Node(first[depth:upto], upto, min(sizes), max(sizes), ends, [])
        todo = [(node, order[len(ends) :])]
        while todo:
            parent, rest = todo.pop()
            for _, group in itertools.groupby(rest, key=lambda k: self.sets[k][parent.depth]):
                below = list(group)
                first, last = self.sets[below[0]], self.sets[below[-1]]
                n = min(len(first), len(last))
                apart = np.flatnonzero(first[parent.depth : n] != last[parent.depth : n])
                upto = parent.depth + int(apart[0]) if len(apart) else n
                sizes = [len(self.sets[k]) for k in below]
                ends = [k for k, s in zip(below, sizes, strict=True) if s == upto]
                child = Node(first[parent.depth : upto], upto, min(sizes), max(sizes), ends, [])
                parent.children.append(child)
                if len(ends) < len(below):
                    todo.append((child, below[len(ends) :]))
        return node

    def linked(self, probe: np.ndarray, mask: np.ndarray, percent: int, among: range | None = None) -> Iterator[int]:
        """Sets of the tree that link with a probe, whose ranks are set in mask; among: only these."""
        size = len(probe)
        todo = [(self.root, 0)] if self.root else []
        while todo:
            node, overlap = todo.pop()
            if 100 * node.most < percent * size or percent * node.least > 100 * size:
                continue
            if len(node.segment):
                overlap += int(np.count_nonzero(mask[node.segment]))
                passed = int(np.searchsorted(probe, node.segment[-1], "right"))
                reach = overlap + min(node.most - node.depth, size - passed)
                if (100 + percent) * reach < percent * (node.least + size):
                    continue
            if node.ends and 100 * overlap >= percent * (node.depth + size - overlap):
                yield from (k for k in node.ends if among is None or k in among)
            todo += [(c, overlap) for c in node.children]


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Sets of hashes as ascending ranks in one order, most common first, and the number of ranks."""
    values, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int32)
    rank[np.lexsort((values, -often))] = np.arange(len(values), dtype=np.int32)
    every = rank[inverse]
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(part) for part in np.split(every, cuts)], len(values)


class Forest:
    """Union-find over 0 .. n - 1; the root is the least."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def join_chunks(ids: list[int], sets: list[np.ndarray], second: list[bool], own: list[bool], percent: int) -> Iterator[tuple[int, int, int]]:
    """(id, id of a set in its component, number of links) of the sets with links: between the chunks, or in the first if there is no second. Of a pair one set is of the level's own."""
    order = sorted(range(len(ids)), key=lambda k: (second[k], ids[k]))
    ids, sets, own = [ids[k] for k in order], [sets[k] for k in order], [own[k] for k in order]
    ranks, size = ranked(sets)
    cut = len(ids) - sum(second)
    tree, mask, forest, links = PrefixTree(ranks[:cut]), np.zeros(size, bool), Forest(len(ids)), [0] * len(ids)
    for k in range(cut, len(ids)) if cut < len(ids) else range(cut):
        mask[ranks[k]] = True
        for other in tree.linked(ranks[k], mask, percent, range(k) if k < cut else None):
            if own[k] or own[other]:
                forest.join(k, other)
                links[k] += 1
                links[other] += 1
        mask[ranks[k]] = False
    for k, n in enumerate(links):
        if n:
            yield ids[k], ids[forest.root(k)], n


class Join(NamedTuple):
    """documents: doc_id, text_hash, n_shingles, set_id. nodes: set_id, rep_id, rep_hash, copies. linked: set_id, root, n_links of nodes with links."""

    documents: DataFrame
    nodes: DataFrame
    linked: DataFrame


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))


def few(df: DataFrame) -> bool:
    """Whether a side is small enough to broadcast; counts no more rows than needed."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> Join:
    rows = hashed(docs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """A row per document, and a row per member that COMMON_SETS sets of some CHUNK_MEMBERS members have."""
        hashes, held, seen, size = WordHashes.lasting(), [], set(), 0
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), strict=True):
                members = shingles(text.as_py(), n, hashes)
                key = set_id(members)
                yield doc_id, text_hash, len(members), key, None, None
                if key not in seen:
                    seen.add(key)
                    held.append(members)
                    size += len(members)
                if size > CHUNK_MEMBERS:
                    yield from often(held)
                    held, seen, size = [], set(), 0
        if held:
            yield from often(held)

    columns = ("doc_id", "text_hash", "n_shingles", "set_id", "member", "sets")
    schema = pa.schema([(c, pa.int64()) for c in columns])
    measured = common.stored(rows.transform(common.map_batches, lambda b: common.rows_to_batches(measure(b), schema), ", ".join(f"{c} long" for c in columns)), "join-documents")
    documents = measured.where("member is null").drop("member", "sets")
    # which members are left out changes the work, never the links, so the list may be cut
    left_out = measured.where("member is not null").groupBy("member").agg(F.sum("sets").alias("sets")).orderBy(F.desc("sets"), "member").limit(MOST_COMMON).select("member").toArrow()
    left_out = np.sort(left_out.column("member").to_numpy().astype(np.int64).view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(left_out)  # at most MOST_COMMON numbers
    nodes = common.stored(
        documents.where("doc_id is not null and n_shingles > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")).selectExpr("set_id", "rep.doc_id rep_id", "rep.text_hash rep_hash", "n_shingles", "copies"),
        "join-nodes",
    )
    largest = nodes.agg(F.max("n_shingles")).first()[0] or 1
    levels = Levels.of(percent, largest)

    # rows that repeat another row's set sign nothing: drop them if they are few, else go by the nodes
    again = documents.where("doc_id is null or n_shingles = 0").select("doc_id", "text_hash").unionByName(
        documents.join(nodes.where("copies > 1"), "set_id").where("doc_id <> rep_id or text_hash <> rep_hash").select("doc_id", "text_hash")
    )
    if few(again):
        own = rows.join(F.broadcast(again), rows["doc_id"].eqNullSafe(again["doc_id"]) & (rows["text_hash"] == again["text_hash"]), "left_anti")
    else:
        own = rows.join(nodes.selectExpr("rep_id doc_id", "rep_hash text_hash"), ["doc_id", "text_hash"], "left_semi")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per signature and task, however many nodes of the task share it, and a row per pair (node, other) that shared one here."""
        hashes, held, size = WordHashes.lasting(), [], 0
        for batch in batches:
            for text in batch.column("text"):
                members = shingles(text.as_py(), n, hashes)
                if len(members):
                    for level, found in zip(levels.of_size(len(members)), signatures(members, levels, sent.value), strict=True):
                        held.append((found, np.full(len(found), node_of(set_id(members), level))))
                        size += len(found)
                if size > SIGNATURES_HELD:
                    yield pre_aggregated(held)
                    held, size = [], 0
        if held:
            yield pre_aggregated(held)

    signed = own.select("text").transform(common.map_batches, sign, "signature long, node long, other long")
    # every candidate is tied to the least set of its block: the same component as all pairs, without the pairs
    # as many partitions as it takes for each to be sorted in memory: about one signature for two members
    expected = (documents.agg(F.sum("n_shingles")).first()[0] or 0) // 2
    parts = expected // SORTED_ROWS + 1
    if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        signed = signed.repartition(parts, "signature")
    block = Window.partitionBy("signature")
    ties = signed.withColumn("least", F.coalesce("other", F.min("node").over(block))).where("least <> node").selectExpr("least a", "node b")
    clusters = components.connected(ties)

    def leveled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, size in zip(batch.column("set_id").to_pylist(), batch.column("n_shingles").to_pylist(), strict=True):
                for level, own in zip(levels.of_size(size), (True, False), strict=True):
                    yield node_of(key, level), key, own

    schema = pa.schema([("node", pa.int64()), ("set_id", pa.int64()), ("own", pa.bool_())])
    levelled = nodes.select("set_id", "n_shingles").transform(common.map_batches, lambda b: common.rows_to_batches(leveled(b), schema, 16384), "node long, set_id long, own boolean")
    weights = common.stored(clusters.join(levelled, "node").join(nodes.select("set_id", "rep_id", "rep_hash", "n_shingles"), "set_id"), "join-candidates")
    sizes = weights.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CHUNK_SETS, F.sum("n_shingles") / CHUNK_MEMBERS)).alias("chunks"))
    place = F.struct("root", "own", F.pmod(F.xxhash64("set_id"), "chunks").alias("chunk"), "chunks")
    # a set has at most two places, one per level
    picked = common.stored(weights.join(sizes, "root").groupBy(F.col("rep_id").alias("doc_id"), F.col("rep_hash").alias("text_hash"), "set_id").agg(F.collect_list(place).alias("places")), "join-places")
    texts = rows.join(F.broadcast(picked) if few(picked) else picked, ["doc_id", "text_hash"])
    chunk = F.col("place.chunk")
    tasks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("place.chunks") - 1), lambda k: F.struct(F.least(k, chunk).alias("low"), F.greatest(k, chunk).alias("high"), (k < chunk).alias("second")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes.lasting()
        for batch in batches:
            found = [shingles(t.as_py(), n, hashes).tobytes() for t in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("members", pa.array(found, pa.binary()))

    with_sets = texts.select("set_id", "places", "text").transform(common.map_batches, sets, "set_id long, places array<struct<root long, own boolean, chunk long, chunks long>>, members binary")
    placed = with_sets.select("set_id", "members", F.explode("places").alias("place"))
    dealt = placed.select("set_id", "members", "place", F.explode(tasks).alias("task")).select("place.root", "task.low", "task.high", "task.second", "set_id", "place.own", "members")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "second", "set_id", "own", "members")), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[:3]):
            own = list({r[4]: r for r in group}.values())  # repeated rows are one node
            if own[0][1] == own[0][2] or any(r[3] for r in own):  # a pair of chunks of which the second is empty has no links
                yield from join_chunks([r[4] for r in own], [np.frombuffer(r[6], np.uint64) for r in own], [r[3] for r in own], [r[5] for r in own], percent)

    schema = pa.schema([(c, pa.int64()) for c in ("set_id", "near", "n_links")])
    found = common.stored(
        dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").transform(common.map_batches, lambda b: common.rows_to_batches(walk(b), schema), "set_id long, near long, n_links long"), "join-links"
    )
    roots = components.connected(found.selectExpr("set_id a", "near b")).withColumnsRenamed({"node": "set_id"})
    linked = found.groupBy("set_id").agg(F.sum("n_links").alias("n_links")).join(roots, "set_id")
    return Join(documents, nodes, common.stored(linked, "join-linked"))


def often(held: list[np.ndarray]) -> Iterator[tuple]:
    values, sets = np.unique(np.concatenate(held), return_counts=True)
    for member, count in zip(values[sets >= COMMON_SETS].view(np.int64).tolist(), sets[sets >= COMMON_SETS].tolist(), strict=True):
        yield None, None, None, None, member, count


def pre_aggregated(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    signature, ids = (np.concatenate(c) for c in zip(*held, strict=True))
    own, first, back = np.unique(signature, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([ids, ids[first][back]], axis=1)[ids != ids[first][back]], axis=0)
    # a pair has a signature of its own, so it meets no block
    signature = np.concatenate([own, mixed(pairs[:, 0].view(np.uint64) ^ mixed(pairs[:, 1].view(np.uint64)))]).view(np.int64)
    other = pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(pairs[:, 1])])
    return pa.RecordBatch.from_arrays([pa.array(signature), pa.array(np.concatenate([ids[first], pairs[:, 0]])), other], names=["signature", "node", "other"])


def with_components(j: Join) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and n_links (other sets that link with the document's)."""
    nodes = j.nodes.join(j.linked, "set_id", "left").select("set_id", "rep_id", F.coalesce("root", "set_id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = nodes.groupBy("root").agg(F.min("rep_id").alias("component"))
    named = nodes.join(least, "root").select("set_id", "component", "n_links")
    # a row whose set no other has, and that links with none, needs no lookup; the rest may crowd on one set
    return j.documents.join(named, "set_id", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") == 0, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )


def similar(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document."""
    return with_components(join(docs, n, percent)).drop("text_hash")


def filter_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one of least doc_id, once; documents without words all stay, as do null ids without a counterpart."""
    found = with_components(join(docs, n, percent))
    stays = (F.col("n_shingles") == 0) | F.col("component_id").isNull() | F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False))
    gone = common.stored(found.where(~stays).select("doc_id", "text_hash"), "join-gone").distinct()
    gone = gone.withColumnsRenamed({"doc_id": "_gone_id", "text_hash": "_gone_hash"})
    marked = docs.withColumn("_hash", F.xxhash64(common.text_of()))
    left = marked.join(F.broadcast(gone) if few(gone) else gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash")), "left_anti")
    repeated = common.stored(found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_again_id"), F.col("text_hash").alias("_again_hash")), "join-repeated")
    if repeated.limit(1).count():
        again = F.broadcast(repeated) if few(repeated) else repeated
        same = (F.col("doc_id").cast("long") == F.col("_again_id")) & (F.col("_hash") == F.col("_again_hash"))
        left = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "_hash"]).union(left.join(again, same, "left_anti"))
    return left.drop("_hash")
