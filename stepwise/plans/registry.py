"""Registry of named queries and their DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from stepwise.functions.numeric import r6, round_half_away

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def two_stage_rounding(sql: str) -> str:
    """Oracle text: every ``round(x, 6)`` becomes ``round(round(x, 9), 6)``.

    Mirrors ``r6`` on the Spark side (see there); all report roundings in
    the oracle texts are written as ``round(<expr>, 6)``.
    """
    n_open, n_close = sql.count("round("), sql.count(", 6)")
    if n_open != n_close:
        raise ValueError("oracle text mixes other round() forms")
    return sql.replace("round(", "round(round(").replace(", 6)", ", 9), 6)")


def register(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = two_stage_rounding(oracle)
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every top-level double column (reports compare at 6 places)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.col(f"`{f.name}`")
            cols.append((r6(c) if places == 6 else round_half_away(c, places)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
