"""Training a day at a time: which day is next, the weights and the losses change together or not at all."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import regressor
from tidemark.sources import store

STATE_FILE = "state.json"


class State(NamedTuple):
    """day: the next to train, or the last one trained if none was there then; losses: of each day trained, by epoch."""

    day: str
    weights: dict[str, np.ndarray] | None
    losses: dict[str, list[float]]


class DayTrainer:
    """A job that can be stopped at any time: what it has done is what its last commit says.

    rows: the training rows (id, text_vector, features, targets) of a day.
    following: the next day that has any, or None; with None the job waits at
    its day. A day without rows isn't left either, as nothing was learnt.
    """

    def __init__(self, spark: SparkSession, path: str, start: str, rows: Callable[[str], DataFrame], following: Callable[[str], str | None]) -> None:
        self.spark, self.path, self.start, self.rows, self.following = spark, path, start, rows, following

    def state(self) -> State:
        at = store.opened(self.spark, self.path)
        if at is None:
            return State(self.start, None, {})
        told = json.loads(store.read_bytes(self.spark, f"{at}/{STATE_FILE}"))
        return State(told["day"], store.load_model(self.spark, at), told["losses"])

    def step(self, batch: int | None = regressor.BATCH, **options) -> str | None:
        """Trains on the next day's rows and commits; the day, or None if there was nothing to do. Options are those of fit_rows()."""
        day, weights, losses = self.state()
        if day in losses:  # no further day was there when it was trained
            day = self.following(day)
        if day is None:
            return None
        rows = self.rows(day)
        weights, found = regressor.fit_rows(rows, weights, batch=batch, **options)
        if not found:
            return None
        told = {"day": self.following(day) or day, "losses": losses | {day: found}}

        def write(to: str) -> None:
            store.write_bytes(self.spark, f"{to}/{store.MODEL_FILE}", store.packed_model(weights))
            store.write_bytes(self.spark, f"{to}/{STATE_FILE}", json.dumps(told).encode())

        store.replace(self.spark, self.path, write)
        return day

    def reset(self) -> None:
        """Forgets weights, losses and the day."""
        store.delete(self.spark, self.path)
