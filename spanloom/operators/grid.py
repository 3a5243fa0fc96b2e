"""Settings of training runs, and searches over them as a table."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Training:
    """Defaults of a run."""

    learning_rate: float = 1e-4
    epochs: float = 3.0
    train_batch: int = 16
    eval_batch: int = 64
    seed: int = 42
    masking_probability: float = 0.0
    replacement_probability: float = 0.0


# Mask and replacement probabilities by task.
TASKS = {"NER": (0.025, 0.025), "PANELIZATION": (0.0, 0.0), "GENEPROD_ROLES": (1.0, 0.0), "SMALL_MOL_ROLES": (1.0, 0.0)}


def for_task(task: str) -> Training:
    mask, replace = TASKS[task]
    return Training(masking_probability=mask, replacement_probability=replace)


def grid(spark: SparkSession, choices: Mapping[str, Sequence[float]]) -> DataFrame:
    """trial, and one column for each setting: every combination."""
    rows = [(i, *map(float, c)) for i, c in enumerate(itertools.product(*choices.values()))]
    return spark.createDataFrame(rows, "trial long, " + ", ".join(f"{k} double" for k in choices))


def search(trials: DataFrame, run: Callable[[dict], float]) -> DataFrame:
    """Trials with the score that run gives each, one Python task a trial."""
    names = trials.columns

    def each(group: pd.DataFrame) -> pd.DataFrame:
        return group.assign(score=[float(run(dict(zip(names, r, strict=True)))) for r in group.itertuples(index=False)])

    return trials.groupBy("trial").applyInPandas(each, ", ".join(f"{n} {t}" for n, t in trials.dtypes) + ", score double")


def best(scored: DataFrame) -> DataFrame:
    """The trial of highest score, the first of equals."""
    return scored.orderBy(F.desc("score"), "trial").limit(1)
