"""Lag, change, rolling and lead columns.

Rolling sums are built from shorter rolling sums: the 24-row sum is four 6-row sums read at
offsets 0, 6, 12, 18, and so on. A row then costs a handful of additions per window instead of
one pass over the whole frame, and because sums only ever add neighbours there is no
cancellation as with running totals. Squared deviations combine the same way (the pairwise
update of Chan, Golub and LeVeque), so the spread is as stable as a two-pass computation.

A NULL anywhere in the frame, or a frame reaching before the first row, gives NULL: the same
as asking for a full window of known values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import At, Level, Series, over_series, quoted
from tidemark.schemas import (
    LAG_STEPS, LAGS, MEAN_WINDOWS, PREFIX, STD_WINDOWS, change_name, lag_name, mean_name,
    std_name,
)

MAX_PARTS = 6


def window_recipe(windows: list[int]) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """For each window length: its level and its parts as (length, offset) pairs.

    Equal parts of an already available length are preferred, then a two-part split; helper
    lengths are added where neither fits.
    """
    recipe: dict[int, tuple[int, list[tuple[int, int]]]] = {1: (0, [(1, 0)])}

    def add(n: int) -> None:
        if n in recipe:
            return
        best = None
        for d, (level, _) in recipe.items():
            if n % d == 0 and n // d <= MAX_PARTS:
                best = min(best or (level + 1, n // d, d), (level + 1, n // d, d))
        if best:
            level, count, d = best
            recipe[n] = (level, [(d, i * d) for i in range(count)])
            return
        head = max(d for d in recipe if d < n)
        if head * MAX_PARTS < n:
            head = (n + 1) // 2
            add(head)
        add(n - head)
        recipe[n] = (max(recipe[head][0], recipe[n - head][0]) + 1,
                     [(head, 0), (n - head, head)])

    for n in sorted(windows):
        add(n)
    return recipe


def rolling_levels(mean_windows: dict[str, list[int]], std_windows: dict[str, list[int]]) -> list[Level]:
    """Levels for ``over_series`` that leave ``_sum_{measure}_{n}`` and ``_dev_{measure}_{n}``."""
    recipes = {
        m: window_recipe(mean_windows.get(m, []) + std_windows.get(m, []))
        for m in dict.fromkeys([*mean_windows, *std_windows])
    }
    # lengths whose squared deviations are needed, including those the parts need
    dev: dict[str, set[int]] = {}
    for m, recipe in recipes.items():
        todo = list(std_windows.get(m, []))
        dev[m] = set()
        while todo:
            n = todo.pop()
            if n > 1 and n not in dev[m]:
                dev[m].add(n)
                todo += [d for d, _ in recipe[n][1]]

    def total(m: str, n: int) -> str:
        return m if n == 1 else f"_sum_{m}_{n}"

    def shifted(kind: str, m: str, n: int, k: int) -> str:
        base = total(m, n) if kind == "sum" else f"_dev_{m}_{n}"
        return base if k == 0 else f"{base}_at_{k}" if base.startswith("_") else f"_{base}_at_{k}"

    depth = max((lv for r in recipes.values() for lv, _ in r.values()), default=0)
    levels: list[Level] = []
    for lv in range(1, depth + 1):
        wanted = [(m, n, parts) for m, r in recipes.items()
                  for n, (level, parts) in r.items() if level == lv]

        def reads(at: At, wanted=wanted) -> dict[str, str]:
            out = {}
            for m, n, parts in wanted:
                for d, k in parts:
                    if k:
                        out[shifted("sum", m, d, k)] = at(total(m, d), k)
                        if n in dev[m] and d > 1:
                            out[shifted("dev", m, d, k)] = at(f"_dev_{m}_{d}", k)
            return out

        def combine(at: At, wanted=wanted) -> dict[str, str]:
            return {
                total(m, n): " + ".join(quoted(shifted("sum", m, d, k)) for d, k in parts)
                for m, n, parts in wanted
            }

        def deviate(at: At, wanted=wanted) -> dict[str, str]:
            out = {}
            for m, n, parts in wanted:
                if n in dev[m]:
                    terms = []
                    for d, k in parts:
                        part, whole = quoted(shifted("sum", m, d, k)), quoted(total(m, n))
                        terms.append(f"{d}D * power({part} / {d}D - {whole} / {n}D, 2)")
                        if d > 1:
                            terms.append(quoted(shifted("dev", m, d, k)))
                    out[f"_dev_{m}_{n}"] = " + ".join(terms)
            return out

        levels += [reads, combine]
        if any(n in dev[m] for m, n, _ in wanted):
            levels.append(deviate)
    return levels


def rolling_columns(mean_windows: dict[str, list[int]],
                    std_windows: dict[str, list[int]]) -> dict[str, str]:
    """Final columns from what ``rolling_levels`` left behind."""
    out: dict[str, str] = {}
    for m, windows in mean_windows.items():
        for n in windows:
            out[mean_name(m, n)] = f"{quoted(m if n == 1 else f'_sum_{m}_{n}')} / {n}D"
    for m, windows in std_windows.items():
        for n in windows:
            out[std_name(m, n)] = f"sqrt({quoted(f'_dev_{m}_{n}')} / {n - 1}D)"
    return out


def lags(df: DataFrame, measure: str, steps: list[int], series: Series) -> DataFrame:
    return over_series(df, series, max(steps), 0, [
        lambda at: {lag_name(measure, k): at(measure, k) for k in steps}
    ])


def changes(df: DataFrame, measure: str, steps: list[int], series: Series) -> DataFrame:
    return over_series(df, series, max(steps), 0, [
        lambda at: {change_name(measure, k): f"{quoted(measure)} - {at(measure, k)}" for k in steps}
    ])


def rolling_mean(df: DataFrame, measures: list[str], windows: list[int], series: Series) -> DataFrame:
    return _rolling(df, {m: windows for m in measures}, {}, series)


def rolling_std(df: DataFrame, measure: str, windows: list[int], series: Series) -> DataFrame:
    """Sample standard deviation of each trailing window."""
    return _rolling(df, {}, {measure: windows}, series)


def _rolling(df, means, stds, series: Series) -> DataFrame:
    work, casts = df, {m: F.col(m).cast("double") for m in {*means, *stds}}
    work = work.withColumns(casts)
    back = max(n for ws in [*means.values(), *stds.values()] for n in ws) - 1
    final = rolling_columns(means, stds)
    levels = rolling_levels(means, stds) + [lambda at: final]
    return over_series(work, series, back, 0, levels, keep=df.columns + list(final))


def leads(df: DataFrame, names: dict[str, str], steps: int, series: Series) -> DataFrame:
    """Columns read ``steps`` ahead; ``names`` maps new name to source column."""
    return over_series(df, series, 0, steps, [
        lambda at: {new: at(src, -steps) for new, src in names.items()}
    ])


def history_levels(mean_windows=None, std_windows=None, lag_steps=None, change_steps=None):
    """Levels, final columns and lookback of the whole history feature block."""
    lag_steps = LAGS if lag_steps is None else lag_steps
    change_steps = {"us_aqi": LAG_STEPS} if change_steps is None else change_steps
    mean_windows = {m: MEAN_WINDOWS for m in PREFIX} if mean_windows is None else mean_windows
    std_windows = {"us_aqi": STD_WINDOWS} if std_windows is None else std_windows

    def first(at: At) -> dict[str, str]:
        return {lag_name(m, k): at(m, k) for m, ks in lag_steps.items() for k in ks}

    final: dict[str, str] = {}
    for m, ks in change_steps.items():
        for k in ks:
            final[change_name(m, k)] = f"{quoted(m)} - {quoted(lag_name(m, k))}"
    final.update(rolling_columns(mean_windows, std_windows))
    levels = [first] + rolling_levels(mean_windows, std_windows) + [lambda at: final]
    reach = [k for ks in [*lag_steps.values(), *change_steps.values()] for k in ks]
    reach += [n - 1 for ws in [*mean_windows.values(), *std_windows.values()] for n in ws]
    return levels, max(reach)
