"""Connected components of a graph too large for one machine, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: A graph of at most so many edges, whatever the input's size, is finished by one task.
FEW_EDGES = 200_000


class Forest:
    """Union-find; the root is the least."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, k: int) -> int:
        up = self.up.setdefault(k, k)
        while up != k:
            self.up[k] = self.up[up]
            k, up = up, self.up[up]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def finished(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph that is known to be small."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.join(a, b)
        nodes = list(forest.up)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "root": pa.array(map(forest.root, nodes), pa.int64())})

    return edges.select("a", "b").coalesce(1).transform(common.map_batches, join, "node long, root long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) but lone loops: two nodes have one root if a path joins them. Nulls aren't allowed.

    While edges are many, in each round every node moves to its least
    neighbour if that is less, and the edges follow; equal ones fall together.
    A chain of n nodes takes about log n rounds, a star one. Each round's
    tables are stored, so nothing is recomputed when an executor is lost.
    """
    edges = common.stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while edges.count() > FEW_EDGES:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = common.stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "moves")
        rounds.append(moves)
        start, end = (moves.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        moved = edges.join(start, "a").join(end, "b").where("a_root <> b_root")
        edges = common.stored(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    roots = finished(edges)
    for moves in reversed(rounds):
        # a node's root is the root of where it moved
        above = roots.withColumnsRenamed({"node": "at", "root": "top"})
        roots = moves.withColumnRenamed("root", "at").join(above, "at", "left").select("node", F.coalesce("top", "at").alias("root"))
    return common.stored(roots, "roots")
