"""A two-branch network: text vector and features to rates at all horizons.

fit_rows() fits on all rows, on the executors. With `batch`, as the network is
trained, a step takes that many rows, so an epoch has as many steps as rows
allow; a step needs the weights of the one before, so blocks of rows follow one
another, a task each. Without, a step takes a large part of the table: the
weights (a few hundred kB, fixed by the layer sizes) go to the tasks, each sums
the gradients of its rows, sums meet in a tree of tasks, and the driver makes
the step. fit() runs on the driver, on a sample of at most MOST_ROWS rows: those
with the least hash of id, which are spread over the whole table and are the
same however it is partitioned. Prediction runs on the executors, batch by batch.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import training
from tidemark.sources.store import shared_dir, stored

MOST_ROWS = 20_000
LAYERS = {"text": (128, 64), "features": (32,), "out": 9}


def start(text_size: int, feature_size: int, outputs: int = LAYERS["out"], seed: int = 0) -> dict[str, np.ndarray]:
    """Weights and biases of text -> 128 -> 64, features -> 32, both -> outputs."""
    rng = np.random.default_rng(seed)
    shapes = {"t1": (text_size, 128), "t2": (128, 64), "f1": (feature_size, 32), "o": (96, outputs)}
    found = {}
    for name, (a, b) in shapes.items():
        found[name] = rng.uniform(-1, 1, (a, b)) / np.sqrt(a)
        found[f"{name}_b"] = np.zeros(b)
    return found


def forward(w: dict[str, np.ndarray], text: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, tuple]:
    a = np.maximum(0, text @ w["t1"] + w["t1_b"])
    b = np.maximum(0, a @ w["t2"] + w["t2_b"])
    c = np.maximum(0, features @ w["f1"] + w["f1_b"])
    both = np.concatenate([b, c], axis=1)
    return both @ w["o"] + w["o_b"], (a, b, c, both)


def gradients(w: dict[str, np.ndarray], text: np.ndarray, features: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean squared error and its gradient."""
    out, (a, b, c, both) = forward(w, text, features)
    d = 2 * (out - targets) / targets.size
    g = {"o": both.T @ d, "o_b": d.sum(0)}
    back = d @ w["o"].T
    db, dc = back[:, : b.shape[1]] * (b > 0), back[:, b.shape[1] :] * (c > 0)
    g |= {"f1": features.T @ dc, "f1_b": dc.sum(0), "t2": a.T @ db, "t2_b": db.sum(0)}
    da = (db @ w["t2"].T) * (a > 0)
    g |= {"t1": text.T @ da, "t1_b": da.sum(0)}
    return float(((out - targets) ** 2).mean()), g


def sample(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """At most `most` rows, those with the least hash of id, in that order."""
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


def fit(rows: DataFrame, weights: dict[str, np.ndarray] | None = None, epochs: int = 10, batch: int = 32, rate: float = 1e-3, most: int = MOST_ROWS, seed: int = 0) -> tuple[dict[str, np.ndarray], list[float]]:
    """Adam on at most `most` rows (id, text_vector, features, targets), taken by hash of id; weights to go on from, and the loss of each epoch."""
    table = sample(rows, most).select("text_vector", "features", "targets").toPandas()
    text, features, targets = (np.array(table[c].tolist(), float) for c in ("text_vector", "features", "targets"))
    w = {k: v.copy() for k, v in (weights or start(text.shape[1], features.shape[1], targets.shape[1], seed)).items()}
    adam, rng, losses = Adam(w, rate), np.random.default_rng(seed), []
    for _ in range(epochs):
        order, total = rng.permutation(len(text)), 0.0
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            loss, g = gradients(w, text[at], features[at], targets[at])
            adam.step(w, g)
            total += loss * len(at)
        losses.append(total / max(1, len(order)))
    return w, losses


#: Sums of gradients that a task of the tree adds up, and that reach the driver at most.
FAN = 16


class Adam:
    """Steps of fixed rate, scaled by running means of gradients and of their squares."""

    def __init__(self, w: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.n = rate, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k in w:
            self.mean[k] = 0.9 * self.mean[k] + 0.1 * g[k]
            self.square[k] = 0.999 * self.square[k] + 0.001 * g[k] ** 2
            w[k] -= self.rate * (self.mean[k] / (1 - 0.9**self.n)) / (np.sqrt(self.square[k] / (1 - 0.999**self.n)) + 1e-8)


def flat(g: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([g[k].ravel() for k in sorted(g)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


SUMS = "part int, n long, loss double, gradient binary"


def gradient_sums(rows: DataFrame, w: dict[str, np.ndarray]) -> tuple[int, float, dict[str, np.ndarray]]:
    """Rows, the mean squared error over them and its gradient; no more than FAN sums reach the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, None
        for b in batches:
            if b.num_rows:
                text, features, targets = (np.array(b.column(c).to_pylist(), float) for c in ("text_vector", "features", "targets"))
                e, g = gradients(sent.value, text, features, targets)
                n, loss = n + len(text), loss + e * len(text)
                total = flat(g) * len(text) if total is None else total + flat(g) * len(text)
        if n:
            yield sum_row(TaskContext.get().partitionId(), n, loss, total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])  # FAN rows
        if found:
            yield sum_row(found[0]["part"], sum(r["n"] for r in found), sum(r["loss"] for r in found), sum(np.frombuffer(r["gradient"]) for r in found))

    sums, parts = rows.select("text_vector", "features", "targets").mapInArrow(own, SUMS), rows.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts, F.floor(F.col("part") / FAN)).mapInArrow(added, SUMS)
    found = sorted(sums.collect(), key=lambda r: r["part"])
    n = sum(r["n"] for r in found)
    if not n:
        return 0, 0.0, {k: np.zeros_like(v) for k, v in w.items()}
    return n, sum(r["loss"] for r in found) / n, shaped(sum(np.frombuffer(r["gradient"]) for r in found) / n, w)


def sum_row(part: int, n: int, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["part", "n", "loss", "gradient"])


#: Rows of a step, as the network is trained.
BATCH = 32
#: Bytes of rows that a task holds at once while it steps through them.
BLOCK_BYTES = 32 << 20


@dataclass
class Run:
    """What a block of rows hands to the next: weights, Adam's means, rows that don't fill a step yet; rows and losses of the epoch so far."""

    w: dict[str, np.ndarray]
    adam: Adam
    left: np.ndarray
    n: int = 0
    loss: float = 0.0

    def go(self, rows: np.ndarray, batch: int, ends: bool = False) -> None:
        """Steps through rows (text, features and targets side by side) after those left; a step has fewer than `batch` only where the epoch ends."""
        vector = flat(self.w)
        self.w = shaped(vector, self.w)  # views, so a step of the vector is one of them all
        rows, text, features = np.concatenate([self.left, rows]), len(self.w["t1"]), len(self.w["f1"])
        end = len(rows) if ends else len(rows) - len(rows) % batch
        for k in range(0, end, batch):
            t, f, y = np.split(rows[k : k + batch], [text, text + features], axis=1)
            e, g = gradients(self.w, t, f, y)
            self.adam.step({"all": vector}, {"all": flat(g)})
            self.n, self.loss = self.n + len(y), self.loss + e * len(y)
        self.left = rows[end:].copy()


def after_block(rows: DataFrame, run: Run, batch: int, seed: int, epoch: int) -> Run:
    """The run after one task's steps through rows, in the order of a hash of id and the epoch."""
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(run))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = pickle.loads(sent.value), []
        sizes = {"text_vector": len(own.w["t1"]), "features": len(own.w["f1"]), "targets": len(own.w["o_b"])}
        for b in batches:
            values = [b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size) for c, size in sizes.items()]
            found.append((b.column("at").to_numpy(), b.column("tie").to_numpy(), np.concatenate(values, axis=1)))
        if found:
            at, tie, table = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            own.go(table[np.lexsort((tie, at))], batch)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["run"])

    at, tie = F.xxhash64("id", F.lit(seed), F.lit(epoch)), F.xxhash64("id", "text_vector", "features", "targets")
    keyed = rows.select(at.alias("at"), tie.alias("tie"), "text_vector", "features", "targets")
    found = keyed.coalesce(1).mapInArrow(steps, "run binary").collect()  # one run, of three times the weights' size
    sent.destroy()
    return pickle.loads(found[0].run) if found else run


def in_blocks(held: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Stored rows with `block`, the blocks being dealt by a hash of id, of about `most` rows and a folder each; and the number of blocks."""
    blocks = max(1, -(-held.count() // most))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    if blocks == 1:
        return dealt, 1
    path = shared_dir(held.sparkSession, "blocks")
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(path)
    return held.sparkSession.read.schema(dealt.schema).parquet(path), blocks


def fit_rows(rows: DataFrame, weights: dict[str, np.ndarray] | None = None, epochs: int = 10, batches: int = 1, rate: float = 1e-3, seed: int = 0, batch: int | None = None) -> tuple[dict[str, np.ndarray], list[float]]:
    """Adam over all rows (id, text_vector, features, targets); weights to go on from, and the loss of each epoch.

    batch: rows of a step; an epoch has a step for each so many, and its last
    takes what remains. An epoch goes through the blocks, and through the rows
    of each, in an order of its own.
    batches: if batch isn't given, steps of an epoch. A row's is told by a hash
    of its id and the epoch.
    Neither depends on how rows are dealt to tasks. The rows are stored; an
    epoch reads them again. Without rows the weights stay.
    """
    held = stored(rows.select("id", "text_vector", "features", "targets"), "training")
    first = held.select(*(F.size(c) for c in ("text_vector", "features", "targets"))).first()
    if first is None:
        return dict(weights or {}), []
    w = {k: v.copy() for k, v in (weights or start(*first, seed)).items()}
    if batch:
        return fit_steps(held, w, epochs, batch, rate, seed)
    adam, losses = Adam(w, rate), []
    for epoch in range(epochs):
        total, seen = 0.0, 0
        for k in range(batches):
            part = held if batches == 1 else held.where(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(epoch)), F.lit(batches)) == k)
            n, loss, g = gradient_sums(part, w)
            if n:
                adam.step(w, g)
                total, seen = total + loss * n, seen + n
        losses.append(total / max(1, seen))
    return w, losses


def fit_steps(held: DataFrame, w: dict[str, np.ndarray], epochs: int, batch: int, rate: float, seed: int) -> tuple[dict[str, np.ndarray], list[float]]:
    """fit_rows() of stored rows in steps of `batch`."""
    width = len(w["t1"]) + len(w["f1"]) + len(w["o_b"])
    dealt, blocks = in_blocks(held, max(batch, BLOCK_BYTES // (8 * width)))
    run, losses = Run(w, Adam({"all": flat(w)}, rate), np.empty((0, width))), []
    for epoch in range(epochs):
        run.n, run.loss = 0, 0.0
        for k in np.random.default_rng((seed, epoch)).permutation(blocks):
            run = after_block(dealt.where(F.col("block") == int(k)), run, batch, seed, epoch)
        run.go(run.left[:0], batch, ends=True)  # fewer than `batch` rows
        losses.append(run.loss / max(1, run.n))
    return run.w, losses


TEXT_SIZE = 64


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_words(texts: pd.Series) -> pd.Series:
    """Shares of a text's words by hash: stands in for a language model's vector where there is none."""

    def shares(text: str | None) -> np.ndarray:
        words = (text or "").split()
        return np.bincount([zlib.crc32(x.encode()) % TEXT_SIZE for x in words], minlength=TEXT_SIZE) / max(1, len(words))

    return texts.map(shares)


def predict(rows: DataFrame, weights: dict[str, np.ndarray], names: tuple[str, ...] = training.TARGETS) -> DataFrame:
    """id and rates, a map from each target's name to its predicted rate, of rows (id, text_vector, features)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out, _ = forward(weights, np.array(b["text_vector"].tolist(), float), np.array(b["features"].tolist(), float))
                yield pd.DataFrame({"id": b["id"], "rates": out.tolist()})

    found = rows.select("id", "text_vector", "features").mapInPandas(run, "id long, rates array<double>")
    return found.select("id", training.named(F.col("rates"), names).alias("rates"))
