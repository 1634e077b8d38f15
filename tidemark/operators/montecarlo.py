"""Seeded experiments: a trial's stream depends on the seed and its number only, so partitions don't matter."""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.weights import draw_sequential


def trial_rng(seed: int, trial: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(trial,)))


def run_trials(spark: SparkSession, func: Callable[..., Mapping[str, float]], n_iter: int, seed: int | None = 0, partitions: int | None = None, **kwargs) -> DataFrame:
    """(trial, one column per result key): func(rng, **kwargs) for each trial; keys must be those of trial 0."""
    if n_iter < 1 or int(n_iter) != n_iter:
        raise ValueError("n_iter must be a positive integer")
    seed = secrets.randbits(63) if seed is None else seed
    names = list(func(trial_rng(seed, 0), **kwargs))
    if not names:
        raise ValueError("func must return at least one key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i in ids:
                got = func(trial_rng(seed, i), **kwargs)
                if set(got) != set(names):
                    raise ValueError(f"trial {i} returned other keys than trial 0")
                rows.append([float(got[n]) for n in names])
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.float64()) for c in cols)], ["trial", *names])

    n = partitions or max(1, min(int(n_iter), 2 * spark.sparkContext.defaultParallelism))
    return spark.range(0, int(n_iter), 1, n).mapInArrow(run, "trial long, " + ", ".join(f"`{x}` double" for x in names))


def random_labels(n_obs: int, n_bars: int, max_h: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct start bars and end bars; of equal starts the last draw counts."""
    if n_obs < 1 or n_bars < 1 or max_h < 2:
        raise ValueError("n_obs and n_bars must be at least 1, max_h at least 2")
    starts = rng.integers(0, n_bars, size=n_obs)
    lengths = rng.integers(1, max_h, size=n_obs)
    kept = dict(zip(starts.tolist(), lengths.tolist(), strict=True))
    s = np.array(sorted(kept), dtype=np.int64)
    return s, s + np.array([kept[x] for x in s.tolist()], dtype=np.int64)


def random_t1(spark: SparkSession, n_obs: int, n_bars: int, max_h: int, seed: int | None = None) -> DataFrame:
    """(start_pos, end_pos) of a random set of labels, drawn in a task: one stream of random numbers has one reader."""

    def draw(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, e = random_labels(n_obs, n_bars, max_h, np.random.default_rng(seed))
        for at in range(0, len(s), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(s[at : at + 100_000]), pa.array(e[at : at + 100_000])], ["start_pos", "end_pos"])

    if n_obs < 1 or n_bars < 1 or max_h < 2:
        raise ValueError("n_obs and n_bars must be at least 1, max_h at least 2")
    return spark.range(0, 1, 1, 1).mapInArrow(draw, "start_pos long, end_pos long")


def _mean_uniqueness(starts: np.ndarray, ends: np.ndarray) -> float:
    n = int(ends.max()) + 1
    count = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends + 1, minlength=n + 1))[:n]
    inverse = np.concatenate(([0.0], np.cumsum(np.where(count > 0, 1.0 / np.maximum(count, 1), 0.0))))
    return float(np.mean((inverse[ends + 1] - inverse[starts]) / (ends - starts + 1)))


def bootstrap_uniqueness_trial(rng: np.random.Generator, n_obs: int, n_bars: int, max_h: int) -> dict[str, float]:
    """Average uniqueness of a plain and of a sequential bootstrap of one random set of labels.

    Draws, in this order: starts and lengths, the plain sample, one uniform per sequential draw.
    """
    starts, ends = random_labels(n_obs, n_bars, max_h, rng)
    m = len(starts)
    plain = rng.integers(0, m, size=m)
    drawn = draw_sequential(starts, ends, rng.random(m))
    return {"std_u": _mean_uniqueness(starts[plain], ends[plain]), "seq_u": _mean_uniqueness(starts[drawn], ends[drawn])}


def bootstrap_uniqueness_mc(spark: SparkSession, n_obs: int = 10, n_bars: int = 100, max_h: int = 5, n_iter: int = 10_000, seed: int | None = 0) -> DataFrame:
    """(trial, std_u, seq_u)."""
    return run_trials(spark, bootstrap_uniqueness_trial, n_iter, seed, n_obs=n_obs, n_bars=n_bars, max_h=max_h)
