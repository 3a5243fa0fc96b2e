import json
import math
from pathlib import Path

import pytest

from spanloom.operators import grid, population

CHOICES = {"rate": [0.001, 0.01, 0.1, 1.0], "decay": [0.1, 0.5, 0.9]}


def descent(calls=None, fail_at=None):
    """Steps down a curve from the state so far."""

    def run(settings, state, to):
        if calls is not None:
            calls.append(to)
        if fail_at and to.endswith(fail_at):
            raise RuntimeError("lost")
        x = json.loads(Path(state, "x").read_text()) if state else 10.0
        for _ in range(3):
            x -= settings["rate"] * 2.9 * x * settings["decay"]  # best between the choices
        Path(to).mkdir(parents=True, exist_ok=True)
        Path(to, "x").write_text(json.dumps(x))
        return -abs(x)

    return run


def rows(found):
    return sorted((tuple(r[:-2]), r.score) for r in found.collect())


def test_a_search_is_repeatable_and_goes_on_where_it_stopped(spark, tmp_path):
    one = population.search(spark, CHOICES, descent(), str(tmp_path / "a"), trials=6, rounds=4, seed=3)
    two = population.search(spark, CHOICES, descent(), str(tmp_path / "b"), trials=6, rounds=4, seed=3, at_once=1)
    assert rows(one) == rows(two) and one.count() == 24
    with pytest.raises(RuntimeError, match="lost"):
        population.search(spark, CHOICES, descent(fail_at="2-3"), str(tmp_path / "c"), trials=6, rounds=4, seed=3)
    calls = []
    three = population.search(spark, CHOICES, descent(calls), str(tmp_path / "c"), trials=6, rounds=4, seed=3)
    assert rows(three) == rows(one) and {c[-3] for c in calls} == {"2", "3"}
    assert rows(population.search(spark, CHOICES, descent(), str(tmp_path / "d"), trials=6, rounds=4, seed=4)) != rows(one)


def test_the_worst_go_on_from_the_best(spark, tmp_path):
    found = {(r["round"], r.trial): r for r in population.search(spark, CHOICES, descent(), str(tmp_path / "a"), trials=8, rounds=3, seed=1).collect()}
    for k in (1, 2):
        order = sorted(range(8), key=lambda t: (-found[k - 1, t].score, t))
        for t in range(8):
            if t in order[6:]:
                assert found[k, t].parent in order[:2]
            else:
                assert found[k, t].parent == t and found[k, t].rate == found[k - 1, t].rate
    assert all(0.001 <= r.rate <= 1.0 and 0.1 <= r.decay <= 0.9 for r in found.values())


def test_it_is_no_worse_than_a_grid_of_as_many_trials(spark, tmp_path):
    run = descent()
    best = population.best(population.search(spark, CHOICES, run, str(tmp_path / "a"), trials=12, rounds=4, seed=5)).first()
    scores = []
    for i, t in enumerate(grid.grid(spark, CHOICES).collect()):
        state = None
        for k in range(4):
            to = str(tmp_path / f"grid-{i}-{k}")
            score, state = run({"rate": t.rate, "decay": t.decay}, state, to), to
        scores.append(score)
    assert len(scores) == 12 and best.score >= max(scores)


def test_scores_that_are_no_numbers_are_the_worst(spark, tmp_path):
    def run(settings, state, to):
        return math.nan if settings["rate"] > 0.05 else settings["rate"]

    found = population.search(spark, CHOICES, run, str(tmp_path / "a"), trials=8, rounds=2, seed=0)
    assert population.best(found).first().score <= 0.05
    assert population.search(spark, CHOICES, run, str(tmp_path / "b"), trials=1, rounds=2).count() == 2
