"""Registry of the named queries the driver checks.

Each query is a callable ``(spark, sf_dir) -> DataFrame``.  Most also carry
an oracle: DuckDB SQL over the same Parquet tables.  Doubles listed in
``rounding`` are rounded to that many decimals on *both* sides (sums run in a
different order in the two engines), then ``+ 0.0`` turns -0.0 into 0.0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    rounding: dict[str, int] = field(default_factory=dict)

    def spark_df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if not self.rounding:
            return df
        return df.withColumns({c: F.round(F.col(c).cast("double"), d) + F.lit(0.0)
                               for c, d in self.rounding.items()})

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.rounding:
            return self.sql
        repl = ", ".join(f"round(CAST({_q(c)} AS DOUBLE), {d}) + 0.0 AS {_q(c)}"
                         for c, d in self.rounding.items())
        return f"SELECT * REPLACE ({repl}) FROM (\n{self.sql}\n) AS _oracle"


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, rounding: dict[str, int] | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, sql, dict(rounding or {}))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # import for side effects: each module registers its queries
    from loanframe.plans import (  # noqa: F401
        q_diagnose, q_transform, q_metrics, q_models)
    return REGISTRY
