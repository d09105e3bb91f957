"""Exact interpolated quantiles of a column of any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one task. Here a mergeable
sketch brackets each quantile, one scan counts what lies below the bracket, and the bracket is
narrowed until few enough values are left to sort. Each round divides the candidates by several
hundred, so even 10^12 rows need three or four scans; small inputs need one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import epoch_seconds

SMALL = 50_000  # values one task may sort, over all quantiles asked for together
SKETCH_ACCURACY = 2_000


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float],
                    small: int = SMALL, accuracy: int = SKETCH_ACCURACY) -> list[float | None]:
    """Linear interpolation between the two nearest ranks, NULL and NaN left out."""
    c = F.col(column).cast("double")
    values = df.select(c.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    first = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = first["n"]
    if n == 0:
        return [None] * len(probabilities)
    # wanted ranks that share a closed value bracket -> (low, high, rows below it, rows inside it)
    groups = {(math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in probabilities}
    open_ = {tuple(sorted(set(g))): (first["lo"], first["hi"], 0, n) for g in groups}
    done: dict[int, float] = {}
    while open_:
        for g in [g for g, b in open_.items() if b[0] == b[1]]:
            done.update(dict.fromkeys(g, open_.pop(g)[0]))
        few, room = {}, small
        for g, b in sorted(open_.items(), key=lambda item: item[1][3]):
            if b[3] <= room:
                few[g] = b
                room -= 0 if b in [x for k, x in few.items() if k != g] else b[3]
        if few:
            done.update(_sorted_pick(values, few))
            open_ = {g: b for g, b in open_.items() if g not in few}
        elif open_:
            open_ = _narrow(values, open_, accuracy)
    out = []
    for p in probabilities:
        at = p * (n - 1)
        low, high = done[math.floor(at)], done[math.ceil(at)]
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def _inside(b):
    return F.col("v").between(b[0], b[1])


def _sorted_pick(values: DataFrame, brackets: dict) -> dict[int, float]:
    alias = {b: f"_{i}" for i, b in enumerate(sorted(set(brackets.values())))}
    lists = [F.sort_array(F.collect_list(F.when(_inside(b), F.col("v")))).alias(a)
             for b, a in alias.items()]
    picks = {r: F.element_at(F.col(alias[b]), r - b[2] + 1).alias(f"r{r}")
             for g, b in brackets.items() for r in g}
    row = values.agg(*lists).select(*picks.values()).first()
    return {r: row[f"r{r}"] for r in picks}


def _narrow(values: DataFrame, brackets: dict, accuracy: int) -> dict:
    v, slack = F.col("v"), 2.0 / accuracy
    items = list(brackets.items())
    sketches = []
    for i, (g, b) in enumerate(items):
        at = [(r - b[2] + 0.5) / b[3] for r in g]
        ends = F.array(F.lit(max(0.0, at[0] - slack)), F.lit(min(1.0, at[-1] + slack)))
        sketches.append(F.percentile_approx(F.when(_inside(b), v), ends, accuracy).alias(f"s{i}"))
    sketched = values.agg(*sketches).first()
    trial, counts = [], []
    for i, (_, b) in enumerate(items):
        lo, hi = sketched[f"s{i}"]
        if (lo, hi) == b[:2]:  # the sketch cannot split further: halve the value range
            middle = b[0] + (b[1] - b[0]) / 2
            lo, hi = b[0], (middle if middle < b[1] else b[0])
        trial.append((lo, hi))
        counts += [
            F.count_if(v < lo).alias(f"below{i}"), F.count_if(v.between(lo, hi)).alias(f"inside{i}"),
            F.max(F.when(v < lo, v)).alias(f"before{i}"), F.min(F.when(v > hi, v)).alias(f"after{i}"),
            F.max(F.when(v <= hi, v)).alias(f"top{i}"),
        ]
    seen = values.agg(*counts).first()
    out: dict = {}
    for i, (g, b) in enumerate(items):
        below, inside = seen[f"below{i}"], seen[f"inside{i}"]
        parts: dict = {}
        for r in g:
            if r < below:
                part = (b[0], seen[f"before{i}"], b[2], below - b[2])
            elif r < below + inside:
                part = (trial[i][0], seen[f"top{i}"], below, inside)
            else:
                part = (seen[f"after{i}"], b[1], below + inside, b[2] + b[3] - below - inside)
            parts.setdefault(part, []).append(r)
        out.update({tuple(rs): part for part, rs in parts.items()})
    return out


def time_quantile(df: DataFrame, time: str, probability: float) -> float | None:
    """Interpolated quantile of a timestamp, as seconds since 1970 on the naive clock."""
    (value,) = exact_quantiles(df.select(epoch_seconds(time).alias("s")), "s", [probability])
    return value
