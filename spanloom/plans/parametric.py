"""Named SQL queries with parameters that are checked before they run."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r":([A-Za-z_]\w*)")
_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'")


@dataclass(frozen=True)
class Query:
    """SQL text with :name parameters, the columns it must return, and a function for its rows."""

    text: str
    returns: tuple[str, ...] = ()
    map: Callable[[DataFrame], DataFrame] = lambda df: df

    @property
    def parameters(self) -> frozenset[str]:
        return frozenset(_NAME.findall(_LITERAL.sub("''", self.text)))

    def run(self, spark: SparkSession, **values) -> DataFrame:
        if set(values) != self.parameters:
            raise ValueError(f"parameters are {sorted(self.parameters)}, not {sorted(values)}")
        out = spark.sql(self.text, args=values)
        missing = [c for c in self.returns if c not in out.columns]
        if missing:
            raise ValueError(f"the query does not return {missing}")
        return self.map(out)
