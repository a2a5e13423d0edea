"""Reproducible batched Monte Carlo.

Every batch has a random stream of its own, derived from the run's seed and the batch
number, so results depend on (seed, batch size) and never on the cluster's layout. A
simulation is any picklable object with ``run_trial(rng, index)``, or ``run_batch(rng,
start, stop)`` returning an array where it can be vectorised.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.checks import require_columns


class Reducer(Protocol):
    """What becomes of results: each batch's are folded where they were drawn, and the parts meet in batch order."""

    def partial(self, results: list, batch: int) -> Any:
        """The picklable part of one batch; runs in the worker that drew it."""

    def merge(self, left: Any, right: Any) -> Any:
        """Two neighbouring parts as one; ``left`` has the earlier batches."""

    def finalize(self, part: Any) -> Any:
        """The value of all parts, or of None if there was no batch."""


class CollectReducer:
    """All results in trial order; the whole list comes to the driver."""

    def partial(self, results: list, batch: int) -> list:
        return list(results)

    def merge(self, left: list, right: list) -> list:
        left.extend(right)
        return left

    def finalize(self, part: list | None) -> list:
        return [] if part is None else part


class MeanReducer:
    """The mean of numeric results, None of no results."""

    def partial(self, results: list, batch: int) -> tuple[int, float]:
        return len(results), math.fsum(results)

    def merge(self, left: tuple[int, float], right: tuple[int, float]) -> tuple[int, float]:
        return left[0] + right[0], left[1] + right[1]

    def finalize(self, part: tuple[int, float] | None) -> float | None:
        return part[1] / part[0] if part and part[0] else None


@dataclass(frozen=True)
class RunResult:
    value: Any
    n_trials: int
    n_batches: int
    backend: str
    run_seed: int


def _check(n_trials: int, batch_size: int) -> int:
    if n_trials < 0:
        raise ValueError(f"n_trials can't be negative: {n_trials}")
    if batch_size <= 0:
        raise ValueError(f"batch_size must be positive: {batch_size}")
    return -(-n_trials // batch_size)


def batch_bounds(spark: SparkSession, n_trials: int, batch_size: int, first: int = 0, last: int | None = None) -> DataFrame:
    """``batch, start, stop``: half-open ranges of trials, the last one short; batches ``first`` to ``last`` in contiguous partitions."""
    count = _check(n_trials, batch_size)
    last = count if last is None else min(last, count)
    start = F.col("id") * batch_size
    tasks = max(1, min(last - first, 4 * spark.sparkContext.defaultParallelism))
    ids = spark.range(first, max(first, last), 1, tasks)
    return ids.select(F.col("id").alias("batch"), start.alias("start"), F.least(start + batch_size, F.lit(n_trials)).alias("stop"))


def batch_rng(run_seed: int, batch: int) -> np.random.Generator:
    """The batch's own stream: the same as the batch-th child of the seed's sequence."""
    return np.random.default_rng(np.random.SeedSequence(run_seed, spawn_key=(batch,)))


def run_batch(simulation: Any, run_seed: int, batch: int, start: int, stop: int) -> list:
    """Results of one batch."""
    rng = batch_rng(run_seed, batch)
    if hasattr(simulation, "run_batch"):
        return np.asarray(simulation.run_batch(rng, start, stop)).tolist()
    return [simulation.run_trial(rng, i) for i in range(start, stop)]


def trials(spark: SparkSession, simulation: Any, n_trials: int, batch_size: int = 1000, run_seed: int = 0, value_type: str = "double") -> DataFrame:
    """``batch, trial, value``: a lazy row per trial; batches are spread over tasks."""

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch, start, stop in frame.itertuples(index=False):
                values = run_batch(simulation, run_seed, int(batch), int(start), int(stop))
                yield pd.DataFrame({"batch": batch, "trial": np.arange(start, stop), "value": values})

    return batch_bounds(spark, n_trials, batch_size).mapInPandas(play, f"batch long, trial long, value {value_type}")


def _partials(spark: SparkSession, simulation: Any, reducer: Reducer, n_trials: int, batch_size: int, run_seed: int, first: int, last: int) -> list:
    """``(batch, trials, part)`` of the batches ``first`` to ``last``, drawn and folded in the workers."""

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for batch, start, stop in frame.itertuples(index=False):
                part = reducer.partial(run_batch(simulation, run_seed, int(batch), int(start), int(stop)), int(batch))
                yield pd.DataFrame({"batch": [batch], "trials": [stop - start], "part": [pickle.dumps(part)]})

    rows = batch_bounds(spark, n_trials, batch_size, first, last).mapInPandas(play, "batch long, trials long, part binary").collect()
    return [(r["batch"], r["trials"], pickle.loads(r["part"])) for r in sorted(rows, key=lambda r: r["batch"])]


def run(
    spark: SparkSession | None,
    simulation: Any,
    n_trials: int,
    reducer: Reducer | None = None,
    batch_size: int = 1000,
    run_seed: int = 0,
    backend: str = "spark",
    on_progress: Callable[[int, int], None] | None = None,
) -> RunResult:
    """Run all trials and fold them; both backends ("spark" or "local") merge the same parts in the same order, so their values are equal.

    On Spark a part for each batch reaches the driver, wave by wave, so it holds one wave's parts at a time.
    ``on_progress`` gets the trials done and all trials after each batch.
    """
    if backend not in ("spark", "local"):
        raise ValueError(f"unknown backend {backend!r}")
    total = _check(n_trials, batch_size)
    reducer = reducer or CollectReducer()

    def drawn() -> Iterator[tuple[int, int, Any]]:
        if backend == "local":
            for batch in range(total):
                start, stop = batch * batch_size, min(n_trials, (batch + 1) * batch_size)
                yield batch, stop - start, reducer.partial(run_batch(simulation, run_seed, batch, start, stop), batch)
            return
        wave = 32 * spark.sparkContext.defaultParallelism
        for first in range(0, total, wave):
            yield from _partials(spark, simulation, reducer, n_trials, batch_size, run_seed, first, first + wave)

    part, seen = None, 0
    for batch, count, own in drawn():
        part = reducer.merge(part, own) if batch else own
        seen += count
        if on_progress:
            on_progress(seen, n_trials)
    return RunResult(reducer.finalize(part), seen, total, backend, run_seed)


def serial_loop(simulation: Any, n_trials: int, run_seed: int = 0) -> list:
    """All trials from one stream on this machine: what batches are held against in distribution, not value by value."""
    rng = np.random.default_rng(run_seed)
    if hasattr(simulation, "run_batch"):
        return np.asarray(simulation.run_batch(rng, 0, n_trials)).tolist()
    return [simulation.run_trial(rng, i) for i in range(n_trials)]


@dataclass(frozen=True)
class Coin:
    """1 with probability ``p``, else 0."""

    p: float = 0.5

    def run_batch(self, rng: np.random.Generator, start: int, stop: int) -> np.ndarray:
        return (rng.random(stop - start) < self.p).astype(float)


@dataclass(frozen=True)
class Draw:
    """Uniform in [0, 1)."""

    def run_batch(self, rng: np.random.Generator, start: int, stop: int) -> np.ndarray:
        return rng.random(stop - start)


@dataclass(frozen=True)
class Indexed:
    """The trial's own number."""

    def run_batch(self, rng: np.random.Generator, start: int, stop: int) -> np.ndarray:
        return np.arange(start, stop)


@dataclass(frozen=True)
class Normal:
    """Normal draws of one mean and deviation."""

    mean: float = 0.0
    stddev: float = 1.0

    def run_batch(self, rng: np.random.Generator, start: int, stop: int) -> np.ndarray:
        return rng.normal(self.mean, self.stddev, stop - start)


@dataclass(frozen=True)
class EntityNormal:
    """A normal draw with the parameters of entity ``index % n``; vectorised over the batch."""

    means: tuple[float, ...]
    stddevs: tuple[float, ...]

    def run_batch(self, rng: np.random.Generator, start: int, stop: int) -> np.ndarray:
        at = np.arange(start, stop) % len(self.means)
        return rng.normal(np.asarray(self.means)[at], np.asarray(self.stddevs)[at])


@dataclass(frozen=True)
class Costly:
    """The sum of square roots of uniforms: arithmetic for benchmarks."""

    inner_steps: int = 400

    def run_batch(self, rng: np.random.Generator, start: int, stop: int) -> np.ndarray:
        return np.sqrt(rng.random((stop - start, self.inner_steps))).sum(axis=1)


class EntityCache:
    """Entities of a bounded table as arrays, for simulations that look them up by key or dense position.

    Pickled with the simulation that holds it; positions follow the order of the records.
    """

    def __init__(self, keys: list, columns: dict[str, np.ndarray]) -> None:
        for name, values in columns.items():
            if len(values) != len(keys):
                raise ValueError(f"field {name!r} has {len(values)} values for {len(keys)} keys")
        self.keys, self._columns = list(keys), {k: np.asarray(v) for k, v in columns.items()}
        self._at = {k: i for i, k in enumerate(self.keys)}
        if len(self._at) < len(self.keys):
            seen: set = set()
            double = next(k for k in self.keys if k in seen or seen.add(k))
            raise ValueError(f"key {double!r} is not unique")

    @classmethod
    def from_records(cls, records: list[dict], key: str, fields: list[str], dtype: type = np.float64) -> EntityCache:
        """From dictionaries; a record without the key or a field is a KeyError that names its position."""
        for i, record in enumerate(records):
            missing = [x for x in (key, *fields) if x not in record]
            if missing:
                raise KeyError(f"record {i} has no {missing[0]!r}")
        return cls([r[key] for r in records], {f: np.array([r[f] for r in records], dtype) for f in fields})

    @classmethod
    def from_frame(cls, entities: DataFrame, key: str, fields: list[str], max_rows: int = 1_000_000, dtype: type = np.float64) -> EntityCache:
        """From a table, in the order of its keys; a table over ``max_rows`` is an error, look that up by ``EntityTable``."""
        require_columns(entities, [key, *fields], "entities")
        rows = entities.select(key, *fields).orderBy(key).limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"more than {max_rows} entities")
        return cls.from_records([r.asDict() for r in rows], key, fields, dtype)

    def __len__(self) -> int:
        return len(self.keys)

    @property
    def fields(self) -> list[str]:
        return list(self._columns)

    def index_of(self, key: Any) -> int:
        """The dense position of a key; KeyError if there is none."""
        if key not in self._at:
            raise KeyError(f"no entity {key!r}")
        return self._at[key]

    def field(self, name: str) -> np.ndarray:
        """All values of a field, by position; KeyError if there is no such field."""
        if name not in self._columns:
            raise KeyError(f"no field {name!r}; there are {self.fields}")
        return self._columns[name]

    def field_list(self, name: str) -> list:
        """``field`` as Python numbers, which scalar look-ups read faster."""
        return self.field(name).tolist()


@dataclass(frozen=True)
class CachedNormal:
    """A normal draw with the parameters of entity ``index % n`` of a cache; fields by position."""

    cache: EntityCache
    mean: str = "mean"
    stddev: str = "stddev"

    def run_batch(self, rng: np.random.Generator, start: int, stop: int) -> np.ndarray:
        at = np.arange(start, stop) % len(self.cache)
        return rng.normal(self.cache.field(self.mean)[at], self.cache.field(self.stddev)[at])


@dataclass(frozen=True)
class LookupNormal:
    """The same draws, one trial at a time and each entity by its key."""

    cache: EntityCache
    mean: str = "mean"
    stddev: str = "stddev"

    def run_trial(self, rng: np.random.Generator, index: int) -> float:
        at = self.cache.index_of(self.cache.keys[index % len(self.cache)])
        return float(rng.normal(self.cache.field(self.mean)[at], self.cache.field(self.stddev)[at]))


class FrameNormal:
    """The same draws, each entity by a search through a pandas frame: the slow form that caches are held against."""

    def __init__(self, frame: pd.DataFrame, key: str, mean: str = "mean", stddev: str = "stddev") -> None:
        self.frame, self.key, self.mean, self.stddev = frame, key, mean, stddev

    def run_trial(self, rng: np.random.Generator, index: int) -> float:
        keys = self.frame[self.key]
        row = self.frame.loc[keys == keys.iloc[index % len(keys)]].iloc[0]
        return float(rng.normal(row[self.mean], row[self.stddev]))


class EntityTable:
    """A dimension of entities with unique keys, to look up by key or dense position; broadcast up to ``broadcast_rows`` rows."""

    def __init__(self, entities: DataFrame, key: str, fields: list[str], broadcast_rows: int = 100_000) -> None:
        require_columns(entities, [key, *fields], "entities")
        double = entities.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
        if double:
            raise ValueError(f"key {double[0][0]!r} is not unique")
        self.key, self.fields = key, list(fields)
        self.frame = entities.select(key, *fields)
        self.small = self.frame.limit(broadcast_rows + 1).count() <= broadcast_rows

    def lookup(self, df: DataFrame, on: str) -> DataFrame:
        """``df`` with the fields of the entity that ``on`` names; null where there is none. Broadcast only where the table is small."""
        side = self.frame.withColumnRenamed(self.key, "_lk_key")
        return df.join(F.broadcast(side) if self.small else side, F.col(on) == F.col("_lk_key"), "left").drop("_lk_key")


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A uniform number that depends on the seed and the keys alone; never 0."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def hash_normal(seed: int, *keys: Column) -> Column:
    """A standard normal number of the keys, by the Box-Muller transform."""
    a, b = hash_uniform(seed, F.lit("a"), *keys), hash_uniform(seed, F.lit("b"), *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(a)) * F.cos(F.lit(2 * math.pi) * b)
