"""The history block of gapless series, made from the rows that are known.

Windows over a filled-in spine shuffle and sort every step of every series and copy the wide row
once per level. Where most steps hold a fill value, that is most of the work. Here only the known
rows are shuffled, next to one row per (series, chunk) that says which steps the chunk has; each
task lays its chunks out as vectors, one block at a time, and a step back is a shifted vector.

Chunks and halos are those of ``series``: no task sees a whole series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import epoch_seconds
from tidemark.operators.rolling import window_recipe
from tidemark.operators.series import CHUNK, HOURLY, POS, Series
from tidemark.schemas import LAG_STEPS, LAGS, MEAN_WINDOWS, PREFIX, STD_WINDOWS, change_name, lag_name, mean_name, std_name

BLOCK_STEPS = 1 << 15  # steps laid out together, the last chunk of a block on top
AT, MICROS = "_at", 1_000_000


def _back(values: np.ndarray, k: int) -> np.ndarray:
    """The vector k steps earlier; its first k entries mean nothing."""
    if not k:
        return values
    out = np.zeros_like(values)
    out[k:] = values[:max(len(values) - k, 0)]
    return out


def _windows(values: np.ndarray, windows: list[int], spreads: list[int]) -> tuple[dict, dict]:
    """Sums and squared deviations per window, added in the order of ``rolling_levels``."""
    recipe = window_recipe(windows + spreads)
    sums, devs = {1: values}, {}
    for n, (_, parts) in recipe.items():
        if n > 1:
            sums[n] = _total(_back(sums[d], k) for d, k in parts)

    def spread(n: int) -> np.ndarray:
        if n not in devs:
            terms = []
            for d, k in recipe[n][1]:
                terms.append(d * np.square(_back(sums[d], k) / d - sums[n] / n))
                if d > 1:
                    terms.append(_back(spread(d), k))
            devs[n] = _total(terms)
        return devs[n]

    return sums, {n: spread(n) for n in spreads}


def _total(terms) -> np.ndarray:
    first, *rest = terms
    out = first.copy()
    for t in rest:
        out += t
    return out


def _history(measures: dict[str, np.ndarray]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(column, steps it reaches back, values) of the block; what lies nearer the start is NULL."""
    with np.errstate(all="ignore"):
        for m, values in measures.items():
            for k in LAGS[m]:
                yield lag_name(m, k), k, _back(values, k)
            spreads = STD_WINDOWS if m == "us_aqi" else []
            sums, devs = _windows(values, MEAN_WINDOWS, spreads)
            for n in MEAN_WINDOWS:
                yield mean_name(m, n), n - 1, sums[n] / n
            if m == "us_aqi":
                for k in LAG_STEPS:
                    yield change_name(m, k), k, values - _back(values, k)
            for n in spreads:
                yield std_name(m, n), n - 1, np.sqrt(devs[n] / (n - 1))


def _names() -> list[str]:
    return [name for name, *_ in _history({m: np.zeros(0) for m in PREFIX})]


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each (series, chunk); a NULL key differs from the row before."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in [*keys, CHUNK]:
        column = table.column(k)
        new |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy()
    return np.flatnonzero(np.append(True, new))


def _laid_out(keys: list[str], time: str, step: int, chunk_seconds: int, fill: float):
    def block(table: pa.Table, starts: np.ndarray, steps: np.ndarray, low: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        """Chunks side by side: every step of them, then the block's columns on its own steps."""
        n, first = int(steps.sum()), np.cumsum(steps) - steps
        at = table.column(AT).cast(pa.int64())
        ahead = pc.fill_null(at, 0).to_numpy() - low[group] * MICROS
        known = at.is_valid().to_numpy() & (ahead >= 0) & (ahead % (step * MICROS) == 0) & (ahead < steps[group] * step * MICROS)
        place = first[group[known]] + ahead[known] // (step * MICROS)
        measures = {}
        for m in PREFIX:
            measures[m] = np.full(n, fill)
            measures[m][place] = table.column(m).to_numpy()[known]
        index = np.arange(n) - np.repeat(first, steps)
        at = np.repeat(low, steps) + index * step
        own = np.flatnonzero(at >= np.repeat(table.column(CHUNK).to_numpy()[starts] * chunk_seconds, steps))
        pick = (lambda v: v) if len(own) == n else (lambda v: v[own])
        index, bits = pick(index), {}

        def column(values: np.ndarray, reach: int) -> pa.Array:
            if reach not in bits:
                bits[reach] = pa.py_buffer(np.packbits(index >= reach, bitorder="little"))
            return pa.Array.from_buffers(pa.float64(), len(index), [bits[reach], pa.py_buffer(pick(values))])

        rows = pa.array(pick(np.repeat(starts, steps)))
        out = {k: table.column(k).take(rows).combine_chunks() for k in keys}
        out[time] = pa.array(pick(at) * MICROS, pa.int64()).view(pa.timestamp("us"))
        out |= {m: column(v, 0) for m, v in measures.items()}
        out |= {name: column(v, reach) for name, reach, v in _history(measures)}
        return pa.record_batch([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.values()], names=list(out))

    def solve(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, table.num_rows))
        named = table.column("_low").take(pa.array(starts))
        last = table.column("_high").take(pa.array(starts))
        has = named.is_valid().to_numpy()
        low = pc.fill_null(named, 0).to_numpy()
        # copies for a chunk that lies behind the series' end have no steps
        steps = np.where(has, (pc.fill_null(last, 0).to_numpy() - low) // step + 1, 0)
        number = (np.cumsum(steps) - steps) // BLOCK_STEPS
        edges = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(starts))
        for a, z in zip(edges[:-1], edges[1:]):
            if steps[a:z].any():
                rows = table.slice(starts[a], sizes[a:z].sum())
                yield block(rows, starts[a:z] - starts[a], steps[a:z], low[a:z], np.repeat(np.arange(z - a), sizes[a:z]))

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
            starts = _group_starts(table, keys)
            if len(starts) > 1:
                yield from solve(table.slice(0, starts[-1]), starts[:-1])
            rest = table.slice(starts[-1])  # the last chunk may go on in the next batch
        if rest is not None:
            yield from solve(rest, np.zeros(1, np.int64))
    return run


def dense_history(df: DataFrame, series: Series = HOURLY, fill: float = 0.0) -> DataFrame:
    """Lags, means, changes and spreads on every step between the first and last row of each series.

    Equal to ``over_series(densify(df).na.fill(fill), dense, *history_levels())``, bit for bit: steps
    without a row, and NULL or NaN measures, hold ``fill``; rows off the spine don't count, and as in
    the join of ``densify`` neither do those without a key. (keys, time) must be unique.
    """
    keys, step, size = list(series.keys), series.step_seconds, series.chunk_seconds
    back = max([k for ks in LAGS.values() for k in ks] + LAG_STEPS + [n - 1 for n in MEAN_WINDOWS + STD_WINDOWS])
    low, high, chunk = F.col("_start"), F.col("_end"), F.col(CHUNK)
    off = F.pmod(low, F.lit(step))
    spine = (
        df.groupBy(*keys).agg(epoch_seconds(F.min(series.time)).alias("_start"), epoch_seconds(F.max(series.time)).alias("_end"))
        .where("_start <= _end")
        .withColumn(CHUNK, F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
        .select(*keys, CHUNK, F.lit(None).cast("timestamp_ntz").alias(AT),
                F.greatest(low, chunk * size - back * step + off).alias("_low"),
                F.least(high, (chunk + 1) * size - step + off).alias("_high"),
                *[F.lit(None).cast("double").alias(m) for m in PREFIX])
    )
    known = (
        df.dropna(subset=keys)
        .withColumns({AT: F.col(series.time).cast("timestamp_ntz"), POS: epoch_seconds(series.time),
                      **{m: F.col(m).cast("double") for m in PREFIX}}).na.fill(fill, list(PREFIX))
        .withColumn(CHUNK, F.explode(F.sequence(F.floor(F.col(POS) / size), F.floor((F.col(POS) + back * step) / size))))
        .select(*keys, CHUNK, AT, F.lit(None).cast("long").alias("_low"), F.lit(None).cast("long").alias("_high"), *PREFIX)
    )
    # a number of partitions of its own: these few rows become very many, so their bytes say nothing of the work
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{series.time}` timestamp_ntz"]
    kinds += [f"`{c}` double" for c in [*PREFIX, *_names()]]
    return known.unionByName(spine).repartition(parts, *keys, CHUNK).sortWithinPartitions(*keys, CHUNK, AT).mapInArrow(
        _laid_out(keys, series.time, step, size, fill), ", ".join(kinds))
