"""Population-based search over settings: trials train side by side, and bad ones go on from good ones.

A round trains each trial once more from its saved state and scores it. Then each trial of the
worst share takes the settings and the state of one of the best share, and changes the settings:
each is drawn anew from its choices with a small chance, else multiplied up or down. Training
and scoring are whatever Spark jobs run() starts; this module holds settings and scores alone.

What a round has found is written before the next begins, so a search that was cut off goes on
with the round that it was in, and gives the same result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes of a number, and the chance that it is drawn anew.
FACTORS, ANEW = (0.8, 1.2), 0.25

#: run(settings, from_state, to_state) trains for a round from the state in a folder (None at first), saves the new state in another, and gives the score.
Run = Callable[[dict[str, float], str | None, str], float]


def changed(settings: Mapping[str, float], choices: Mapping[str, Sequence[float]], r: np.random.Generator) -> dict[str, float]:
    """Settings near others, within the ends of their choices."""
    out = {}
    for name, values in choices.items():
        if r.random() < ANEW:
            out[name] = float(values[r.integers(len(values))])
        else:
            out[name] = float(np.clip(settings[name] * FACTORS[r.integers(len(FACTORS))], min(values), max(values)))
    return out


def _drawn(choices: Mapping[str, Sequence[float]], count: int, r: np.random.Generator) -> list[dict[str, float]]:
    """Combinations of choices at random, all of them before any comes again."""
    total = math.prod(len(v) for v in choices.values())
    out: list[dict[str, float]] = []
    while len(out) < count:
        for number in r.choice(total, min(total, count - len(out)), replace=False).tolist():
            settings = {}
            for name, values in choices.items():
                number, k = divmod(number, len(values))
                settings[name] = float(values[k])
            out.append(settings)
    return out


def _schema(names: Sequence[str]) -> str:
    return "round int, trial int, parent int, " + ", ".join(f"{n} double" for n in names) + ", state string, score double"


def finished(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """round, trial, parent (whose state and settings it took, itself as a rule), settings, state and score of all that has run."""
    try:
        return spark.read.schema(_schema(names)).json(f"{folder.rstrip('/')}/rounds/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _schema(names))


def search(spark: SparkSession, choices: Mapping[str, Sequence[float]], run: Run, folder: str, trials: int = 8, rounds: int = 4, share: float = 0.25, seed: int = 0, at_once: int = 4) -> DataFrame:
    """All rounds of a search, as finished() has them. choices: what each setting is drawn from at first; folder: a shared one, for states and rounds; at_once: trials that run side by side."""
    names = list(choices)
    folder = folder.rstrip("/")
    for k in range(rounds):
        done = {(r["round"], r["trial"]): r.asDict() for r in finished(spark, folder, names).collect()}  # a row for each trial and round
        if all((k, t) in done for t in range(trials)):
            continue
        plan = []
        if k == 0:
            r = np.random.default_rng([seed, 0])
            plan = [(t, t, settings, None) for t, settings in enumerate(_drawn(choices, trials, r))]
        else:
            order = sorted(range(trials), key=lambda t: (-done[k - 1, t]["score"], t))
            few = max(1, int(trials * share)) if trials > 1 else 0
            for t in range(trials):
                own = done[k - 1, t]
                r = np.random.default_rng([seed, k, t])
                if t in order[trials - few :]:
                    parent = order[int(r.integers(few))]
                    held = done[k - 1, parent]
                    plan.append((t, parent, changed({n: held[n] for n in names}, choices, r), held["state"]))
                else:
                    plan.append((t, t, {n: own[n] for n in names}, own["state"]))

        def one(p, k=k):
            trial, parent, settings, state = p
            to = f"{folder}/states/{k}-{trial}"
            score = float(run(dict(settings), state, to))
            return (k, trial, parent, *[settings[n] for n in names], to, score if np.isfinite(score) else float("-inf"))

        with ThreadPoolExecutor(at_once) as pool:
            rows = list(pool.map(one, plan))
        spark.createDataFrame(rows, _schema(names)).coalesce(1).write.mode("overwrite").json(f"{folder}/rounds/{k}")
    return finished(spark, folder, names)


def best(found: DataFrame) -> DataFrame:
    """The row of highest score, the first of equals."""
    return found.orderBy(F.desc("score"), "round", "trial").limit(1)
