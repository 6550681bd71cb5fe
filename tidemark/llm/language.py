"""Operator 6: language by family first, then by one-versus-one machines within it.

A text becomes a vector of hashed counts of 1- to MAX_N-grams of its lower-case
letters (runs of other characters are one blank), square-rooted and scaled to
length 1. One linear support vector machine per family against the rest names
the family; inside it a machine for every pair of languages votes, and the
most votes (then the larger sum of margins) win. score is the family's share
of the softmax of family margins times the winner's mean pair probability.

The machines are fitted on the driver on a sample of at most about
SAMPLE_PER_LANGUAGE labelled documents a language, chosen by a hash of their
id; every document of the table is predicted, in place, without a shuffle.

A null text or one without a letter is `und` with score 0. Rows with a null
lang or doc_id aren't learnt from; repeated rows count as often as they are
there; with fewer than two languages the only one (or `und`) is the answer;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SAMPLE_PER_LANGUAGE = 600
MAX_N = 4
DIMENSIONS = 1 << 13
UNDETERMINED = "und"

#: Families of ISO 639-1 codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), lang)


@functools.cache
def lower_letters() -> np.ndarray:
    """By code point: its lower-case letter, or a blank."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, range(0x110000))], np.uint32)


def vector(text: str) -> np.ndarray | None:
    """The features of a text, or None if it has no letter."""
    codes = lower_letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    blank = codes == 32
    if blank.all():
        return None
    again = np.concatenate([[False], blank[1:] & blank[:-1]])
    codes = np.concatenate([[32], codes[~again], [32]]).astype(np.uint32)
    counts = np.zeros(DIMENSIONS)
    gram = np.zeros(len(codes), np.uint32)
    for n in range(1, MAX_N + 1):
        if len(codes) < n:
            break
        gram = (gram[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1))
        mixed = gram ^ (gram >> np.uint32(15))
        mixed = mixed * np.uint32(0x85EBCA6B + 2 * n)
        counts += np.bincount(mixed >> np.uint32(32 - 13), minlength=DIMENSIONS)
    out = np.sqrt(counts)
    return (out / np.linalg.norm(out)).astype(np.float32)


class Machine(NamedTuple):
    """weights . features + bias > 0 for the positive class."""

    weights: np.ndarray
    bias: float


def fit_machine(x: np.ndarray, positive: np.ndarray, rounds: int = 30, regularisation: float = 1e-4, seed: int = 7) -> Machine:
    """A linear SVM by averaged stochastic subgradient steps on the hinge loss; both classes weigh the same."""
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, len(y) / max(1, 2 * positive.sum()), len(y) / max(1, 2 * (~positive).sum()))
    rng, step, size = np.random.default_rng(seed), 0, 32
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, taken = np.zeros(x.shape[1]), 0.0, 0
    for turn in range(rounds):
        order = rng.permutation(len(y))
        for k in range(0, len(y), size):
            at = order[k : k + size]
            step += 1
            rate = 1.0 / (1 + 0.02 * step)
            wrong = at[y[at] * (x[at] @ w + b) < 1]
            pull = weight[wrong] * y[wrong] / size
            w = (1 - rate * regularisation) * w + rate * 8 * (pull @ x[wrong])
            b += rate * pull.sum()
            if turn >= rounds // 2:
                taken += 1
                mean_w += (w - mean_w) / taken
                mean_b += (b - mean_b) / taken
    return Machine(mean_w.astype(np.float32), float(mean_b))


class Model(NamedTuple):
    families: tuple[tuple[str, ...], ...]
    weights: np.ndarray  # machines x dimensions: a row per family, then a row per pair in a family
    biases: np.ndarray
    pairs: tuple[tuple[int, int, int], ...]  # family, first and second language of each pair machine
    languages: int

    def predict(self, text: str | None) -> tuple[str, float]:
        v = vector(text) if text and self.languages else None
        if v is None:
            return UNDETERMINED, 0.0
        margins = self.weights @ v + self.biases
        n = len(self.families) if len(self.families) > 1 else 0
        family, share = 0, 1.0
        if n:
            e = np.exp(3 * (margins[:n] - margins[:n].max()))
            family = int(margins[:n].argmax())
            share = float(e[family] / e.sum())
        names = self.families[family]
        votes, sums, odds = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for (f, a, b), margin in zip(self.pairs, margins[n:], strict=True):
            if f == family:
                votes[a if margin > 0 else b] += 1
                sums[a] += margin
                sums[b] -= margin
                p = 1 / (1 + np.exp(-3 * margin))
                odds[a] += p
                odds[b] += 1 - p
        best = int(np.lexsort((sums, votes))[-1])
        return names[best], share * (float(odds[best]) / (len(names) - 1) if len(names) > 1 else 1.0)


def fit_model(langs: list[str], x: np.ndarray) -> Model:
    names = sorted(set(langs))
    families: dict[str, list[str]] = {}
    for lang in names:
        families.setdefault(family_of(lang), []).append(lang)
    groups = [tuple(v) for _, v in sorted(families.items())]
    label = np.array(langs)
    machines = [fit_machine(x, np.isin(label, g)) for g in groups] if len(groups) > 1 else []
    pairs = [(f, a, b) for f, g in enumerate(groups) for a, b in combinations(range(len(g)), 2)]
    for f, a, b in pairs:
        some = np.isin(label, [groups[f][a], groups[f][b]])
        machines.append(fit_machine(x[some], label[some] == groups[f][a]))
    weights = np.stack([m.weights for m in machines]) if machines else np.zeros((0, DIMENSIONS), np.float32)
    return Model(tuple(groups), weights, np.array([m.bias for m in machines]), tuple(pairs), len(names))


def held_out() -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text divisible by 5 (a null id isn't)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """About per_language labelled documents of each language, chosen by a hash of their id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n)))) if counts else F.lit(None).cast("map<string,double>")
    return known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * 1_000_000)


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                if (v := vector(text.as_py() or "")) is not None:
                    yield lang.as_py(), v.astype(np.float16).tobytes()

    schema = pa.schema([("lang", pa.string()), ("v", pa.binary())])
    found = sample(docs, per_language).select("lang", "text").transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), schema, 64), "lang string, v binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["v"])))  # the same machines whatever the order of tasks
    x = np.frombuffer(b"".join([r["v"] for r in found]), np.float16).astype(np.float32).reshape(-1, DIMENSIONS)
    return fit_model([r["lang"] for r in found], x)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, out, text in zip(batch.column("doc_id"), batch.column("held_out"), batch.column("text"), strict=True):
                yield (doc_id.as_py(), out.as_py(), *model.predict(text.as_py()))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return picked.transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), schema), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
