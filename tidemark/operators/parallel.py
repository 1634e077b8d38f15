"""Chunks of work over numbered items."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lin_parts(num_atoms: int, num_threads: int) -> list[int]:
    """Bounds of chunks of about equal size."""
    n = min(num_threads, num_atoms)
    return [math.ceil(round(k * num_atoms / n, 9)) for k in range(n + 1)] if n else [0]


def nested_parts(num_atoms: int, num_threads: int, upper_triangle: bool = False) -> list[int]:
    """Bounds of chunks of about equal work where item k costs k + 1 (n - k from the other end)."""
    out, n = [0.0], min(num_threads, num_atoms)
    for _ in range(n):
        out.append((-1 + math.sqrt(1 + 4 * (out[-1] ** 2 + out[-1] + num_atoms * (num_atoms + 1.0) / n))) / 2)
    bounds = [int(round(x)) for x in out]
    if upper_triangle:
        sizes = [b - a for a, b in zip(bounds, bounds[1:], strict=False)][::-1]
        bounds = [0]
        for s in sizes:
            bounds.append(bounds[-1] + s)
    return bounds


def mp_pandas_obj(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, num_chunks: int | None = None, linear: bool = True, order: str = "pos") -> DataFrame:
    """func on contiguous chunks of rows numbered by `order` (0-based), a task each; results come in order of `order` if they have it."""
    n = df.agg(F.max(order)).first()[0]
    if n is None:
        return df.sparkSession.createDataFrame([], schema)
    parts = (lin_parts if linear else nested_parts)(n + 1, num_chunks or df.sparkSession.sparkContext.defaultParallelism)
    chunk = sum((F.when(F.col(order) >= b, 1).otherwise(0) for b in parts[1:-1]), F.lit(0))
    out = df.withColumn("__chunk", chunk).groupBy("__chunk").applyInPandas(lambda p: func(p.drop(columns="__chunk").sort_values(order)), schema)
    return out.orderBy(order) if order in out.columns else out
