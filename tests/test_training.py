"""Fitting on executors, and day by day."""

import numpy as np
import pytest

from tidemark.operators import daily, regressor
from tidemark.plans import learning
from tidemark.sources import store

SCHEMA = "id long, text_vector array<double>, features array<double>, targets array<double>"


def rows_of(spark, n, seed=1, first=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(first + k, rng.normal(size=6).tolist(), rng.normal(size=4).tolist(), [float(k % 3), rng.normal()]) for k in range(n)], SCHEMA)


def apart(a, b):
    return max(np.abs(a[k] - b[k]).max() for k in a)


def test_equals_the_drivers_fit(spark):
    """One batch of all rows: the same steps, whether the gradients are summed in one process or in any number of tasks."""
    rows = rows_of(spark, 90)
    want, losses = regressor.fit(rows, epochs=5, batch=1000)
    for parts in (1, 3, 40):
        got, found = regressor.fit_rows(rows.repartition(parts), epochs=5)
        assert apart(got, want) < 1e-9 and found == pytest.approx(losses, rel=1e-9)
    assert losses[-1] < losses[0]


def test_tree_of_sums(spark):
    rows, w = rows_of(spark, 60), regressor.start(6, 4, 2)
    one = regressor.gradient_sums(rows.repartition(1), w)
    many = regressor.gradient_sums(rows.repartition(300), w)  # most tasks have no rows, and the tree has levels
    assert one[0] == many[0] == 60 and one[1] == pytest.approx(many[1]) and apart(one[2], many[2]) < 1e-12


def test_batches_dont_depend_on_tasks(spark):
    rows = rows_of(spark, 80)
    a, la = regressor.fit_rows(rows.repartition(2), epochs=4, batches=5)
    b, lb = regressor.fit_rows(rows.repartition(7), epochs=4, batches=5)
    assert apart(a, b) < 1e-9 and la == pytest.approx(lb) and la[-1] < la[0]
    assert regressor.fit_rows(rows.limit(0), {"x": np.ones(1)}) == ({"x": np.ones(1)}, [])


def test_loss_falls_on_the_work_set(spark):
    rows = store.stored(learning.training_rows(spark, "/root/testdata/sf0.001"), "rows")
    w, losses = regressor.fit_rows(rows, epochs=8, rate=1e-2)
    assert rows.count() > 0 and losses[-1] < losses[0]
    got = regressor.predict(rows, w).collect()
    assert len(got) == rows.count() and set(got[0].rates) == set(regressor.training.TARGETS)


DAYS = ["2024-01-01", "2024-01-03", "2024-01-04"]


def trainer(spark, path, known):
    rows = lambda day: rows_of(spark, 0 if day not in known else 20, 1 + DAYS.index(day), 100 * DAYS.index(day))
    return daily.DayTrainer(spark, path, DAYS[0], rows, lambda day: next((d for d in DAYS if d > day and d in known), None))


def test_stopped_and_resumed_equals_one_run(spark, tmp_path):
    whole = trainer(spark, f"{tmp_path}/whole", DAYS)
    assert [whole.step(epochs=2) for _ in range(4)] == [*DAYS, None]
    broken, at = f"{tmp_path}/broken", 0
    for n in range(60):  # a step that breaks off at its n-th write, then runs again in a new process's place
        one = trainer(spark, broken, DAYS)
        if at == len(DAYS):
            break
        with pytest.MonkeyPatch.context() as patched:
            left = [n % 5]

            def guard(f, left=left):
                def run(*args):
                    left[0] -= 1
                    if left[0] < 0:
                        raise KeyboardInterrupt
                    return f(*args)

                return run

            for name in ("write_bytes", "_renamed", "delete"):
                patched.setattr(store, name, guard(getattr(store, name)))
            try:
                one.step(epochs=2)
            except KeyboardInterrupt:
                pass
        at = len(one.state().losses)
    a, b = whole.state(), trainer(spark, broken, DAYS).state()
    # files are dealt to tasks by their size, so sums may meet in another order
    assert a.day == b.day and list(a.losses) == list(b.losses) == DAYS and apart(a.weights, b.weights) < 1e-9


def test_waits_for_days(spark, tmp_path):
    one = trainer(spark, f"{tmp_path}/days", [])
    assert one.state().day == DAYS[0] and one.step() is None and one.state().weights is None
    one = trainer(spark, f"{tmp_path}/days", DAYS[:1])
    assert one.step(epochs=1) == DAYS[0] and one.step(epochs=1) is None and one.state().day == DAYS[0]
    one = trainer(spark, f"{tmp_path}/days", DAYS)
    assert one.step(epochs=1) == DAYS[1] and one.state().day == DAYS[2]
    one.reset()
    assert one.state() == (DAYS[0], None, {})


def in_order(spark, rows, seed, epoch, blocks=1):
    """The rows as an epoch goes through them."""
    at = spark.createDataFrame(rows, rows[0].__fields__).selectExpr("id", f"pmod(xxhash64(id), {blocks}) AS block", f"xxhash64(id, {seed}, {epoch}) AS hash").collect()
    place = {int(k): n for n, k in enumerate(np.random.default_rng((seed, epoch)).permutation(blocks))}
    keys = {r.id: (place[r.block], r.hash) for r in at}
    return sorted(rows, key=lambda r: keys[r.id])


def by_hand(spark, rows, epochs, blocks=1, batch=32, seed=0):
    """Weights, losses and the number of steps of a plain loop over all rows."""
    w = regressor.start(*(len(rows[0][c]) for c in ("text_vector", "features", "targets")), seed)
    adam, losses = regressor.Adam(w, 1e-3), []
    for epoch in range(epochs):
        table, total = in_order(spark, rows, seed, epoch, blocks), 0.0
        text, features, targets = (np.array([r[c] for r in table]) for c in ("text_vector", "features", "targets"))
        for k in range(0, len(table), batch):
            at = slice(k, k + batch)
            loss, g = regressor.gradients(w, text[at], features[at], targets[at])
            adam.step(w, g)
            total += loss * len(text[at])
        losses.append(total / len(table))
    return w, losses, adam.n


@pytest.mark.parametrize("most", [1000, 100, 40])
def test_steps_of_a_batch(spark, monkeypatch, most):
    """Each epoch takes every row once, 32 a step and the rest in its last, however rows are dealt to blocks and tasks."""
    rows = rows_of(spark, 205).cache()
    blocks = -(-205 // most)
    monkeypatch.setattr(regressor, "BLOCK_BYTES", 8 * 12 * most)
    want, losses, steps = by_hand(spark, rows.collect(), 3, blocks)
    assert steps == 3 * 7 and losses[-1] < losses[0]
    for parts in (1, 9):
        got, found = regressor.fit_rows(rows.repartition(parts), epochs=3, batch=32)
        assert apart(got, want) < 1e-9 and found == pytest.approx(losses, rel=1e-9)
    assert regressor.fit_rows(rows.limit(0), {"x": np.ones(1)}, batch=32) == ({"x": np.ones(1)}, [])


def test_blocks_without_rows(spark, monkeypatch):
    """More blocks than rows: some have none, and what is left of the last still gets its step."""
    rows = rows_of(spark, 6).cache()
    monkeypatch.setattr(regressor, "BLOCK_BYTES", 0)
    want, losses, _ = by_hand(spark, rows.collect(), 2, 6, batch=1)
    got, found = regressor.fit_rows(rows, epochs=2, batch=1)
    assert apart(got, want) < 1e-9 and found == pytest.approx(losses, rel=1e-9)
    kept = {k: v.copy() for k, v in want.items()}
    again, _ = regressor.fit_rows(rows, want, epochs=1, batch=4)
    assert apart(again, want) > 1e-4 and apart(kept, want) == 0  # goes on from weights, which stay as they are


def test_work_set_rates_takes_the_whole_training(spark, monkeypatch):
    """The query's network has made ten epochs in steps of 32 rows, not a step an epoch."""
    rng = np.random.default_rng(3)
    made = [(k, rng.normal(size=5).tolist(), rng.normal(size=17).tolist(), rng.normal(size=9).tolist()) for k in range(100)]
    rows = spark.createDataFrame(made, SCHEMA)
    monkeypatch.setattr(learning, "training_rows", lambda spark, sf_dir: rows)
    want, _, steps = by_hand(spark, rows.collect(), 10)
    assert steps == 40
    got = {r.id: r.rates for r in learning.work_set_rates(spark, "").collect()}
    out, _ = regressor.forward(want, *(np.array([r[c] for r in made]) for c in (1, 2)))
    assert len(got) == 100 and all([got[k][c] for c in regressor.training.TARGETS] == pytest.approx(out[k].tolist(), abs=1e-9) for k in range(100))


def test_a_day_is_trained_in_steps_of_a_batch(spark, tmp_path):
    rows = rows_of(spark, 70)
    one = daily.DayTrainer(spark, f"{tmp_path}/days", DAYS[0], lambda day: rows, lambda day: None)
    assert one.step(epochs=2) == DAYS[0]
    want, losses, _ = by_hand(spark, rows.collect(), 2)
    assert apart(one.state().weights, want) < 1e-6 and one.state().losses[DAYS[0]] == pytest.approx(losses)
