"""Gradient-boosted trees on histograms, all horizons in one pass over the rows.

Spark ML's boosted trees have no L1/L2 penalty, draw columns per node and grow level by level only, so
the learner is built here: the rows of a horizon store become blocks of bin numbers (one byte a value),
each pass adds up gradients by (horizon, node, feature, bin) on the executors, and the best split of each
node is chosen where its sums meet: on the executors, or on the driver while a pass's histograms are a few MB.
The driver never gets rows.

A round takes as many passes as its trees are deep, for any number of horizons. Predictions are not
stored each round: a block applies the trees since the last checkpoint, and every EPOCH rounds the blocks are
checkpointed in the shared folder with their predictions, which also cuts the lineage.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import epoch_seconds
from tidemark.operators.aggregates import regression_metrics
from tidemark.operators.errors import DataContractError
from tidemark.operators.series import HOURLY, Series
from tidemark.plans.horizons import AHEAD
from tidemark.schemas import FUTURE_WEATHER, HORIZON_EXTRAS, MODEL_BASE_COLUMNS, WIND_DIRECTION
from tidemark.session import shared_dir

EPOCH = 50
DRIVER_BYTES = 8 << 20  # histograms of a pass that the driver may add up; beyond it they are shuffled
SKETCH = 10_000  # accuracy of quantiles that become bin edges


@dataclass(frozen=True)
class Boosting:
    """What a fit may do. ``leaves`` bounds a tree that grows best-first; with 0 only ``depth`` bounds it."""

    rounds: int = 800
    rate: float = 0.02
    depth: int = 2
    leaves: int = 0
    least_rows: int = 20
    rows: float = 0.8
    columns: float = 0.7
    l1: float = 1.0
    l2: float = 20.0
    bins: int = 255
    held_out: float = 0.0  # share of the rows that only measure, for stopping early
    patience: int = 10
    tolerance: float = 1e-7
    seed: int = 42


# The settings of the direct models and of the histogram experiment.
DIRECT = Boosting()
HISTOGRAM = Boosting(rounds=300, rate=0.05, depth=64, leaves=20, rows=1.0, columns=1.0, l1=0.0, l2=1.0, held_out=0.1)


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. A row goes left where its value <= the threshold."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf_of(self, x: np.ndarray, thresholds=None) -> np.ndarray:
        """The node each row (of values, or of bins with thresholds in bins) ends in."""
        at = np.zeros(len(x), np.int64)
        feature, left, right = (np.array(v, np.int64) for v in (self.feature, self.left, self.right))
        cut = np.array(self.threshold if thresholds is None else thresholds, float)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            below = x[inner, feature[here]] <= cut[here]
            at[inner] = np.where(below, left[here], right[here])


@dataclass
class BoostedTrees:
    """A fitted model of one horizon."""

    features: tuple[str, ...]
    base: float
    rate: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)  # on the held-out rows, round by round

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * np.array(t.value)[t.leaf_of(x)]
        return out

    def as_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> "BoostedTrees":
        return BoostedTrees(tuple(d["features"]), d["base"], d["rate"], [Tree(**t) for t in d["trees"]], d["losses"])


# -- blocks ------------------------------------------------------------------------------------
def bin_edges(rows: DataFrame, columns: list[str], bins: int = 255) -> dict[str, list[float]]:
    """Upper edges of each column's bins, up to ``bins`` numbers a column: all values of a column that has few of
    them, else quantiles. Two aggregates; the first tells which columns have few."""
    distinct = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = {c for c in columns if distinct[c] <= 0.8 * bins}  # the estimate is off by a few hundredths
    shares = ", ".join(f"{k / bins}D" for k in range(1, bins))
    found = rows.selectExpr(*[f"collect_set(CAST(`{c}` AS DOUBLE)) AS `{c}`" if c in few else
                              f"percentile_approx(CAST(`{c}` AS DOUBLE), array({shares}), {SKETCH}) AS `{c}`" for c in columns]).first()
    return {c: sorted(set(found[c] or []))[:bins] for c in columns}


def _extras(time_seconds: np.ndarray, hours: np.ndarray, weather: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """The columns HORIZON_EXTRAS of (row, horizon) pairs: weather ahead, wind as sine and cosine, target calendar."""
    at = (time_seconds + hours * 3600).astype("datetime64[s]")
    day = at.astype("datetime64[D]")
    weekday = (day.astype(np.int64) + 3) % 7  # 1970-01-01 was a Thursday; Monday is 0
    hour = (at - day).astype("timedelta64[h]").astype(np.int64)
    month = at.astype("datetime64[M]").astype(np.int64) % 12 + 1
    angle = np.radians(direction)
    return np.column_stack([weather, np.sin(angle), np.cos(angle), hour, weekday, month, weekday >= 5])


def pairs_of(batch: pa.RecordBatch, base: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row number, horizon, inputs, target) of all pairs of a row and a horizon that have all of them."""
    own = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in base]) if base else np.zeros(
        (batch.num_rows, 0))
    ahead = batch.column(AHEAD)
    row = np.repeat(np.arange(batch.num_rows), np.diff(ahead.offsets.to_numpy()))
    flat = ahead.flatten()
    get = lambda c: flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    weather = np.column_stack([get(n) for n in FUTURE_WEATHER])
    hours, direction, target = flat.field("horizon").to_numpy(zero_copy_only=False).astype(np.int64), get("direction"), get("target")
    seconds = batch.column("_seconds").to_numpy(zero_copy_only=False)
    x = np.column_stack([own[row], _extras(seconds[row], hours, weather, direction)])
    known = ~np.isnan(target) & ~np.isnan(x).any(axis=1)
    return row[known], hours[known], x[known], target[known]


def _places(base: list[str], features: list[str]) -> list[int]:
    names = [*base, *HORIZON_EXTRAS]
    return [names.index(c) for c in features]


def _base_of(store: DataFrame, features: list[str] | tuple[str, ...] | None) -> tuple[list[str], list[str]]:
    """(columns to read, model inputs): all base columns of the store and the target-hour extras, or those named."""
    if features is None:
        base = [c for c in MODEL_BASE_COLUMNS if c in store.columns]
        return base, [*base, *HORIZON_EXTRAS]
    return [c for c in features if c not in HORIZON_EXTRAS], list(features)


def _scan(store: DataFrame, base: list[str], series: Series = HOURLY) -> DataFrame:
    """What blocks are made of: the base inputs, the arrays, the time in seconds and a hash of the key."""
    return store.select(*series.keys, series.time, *base, AHEAD, epoch_seconds(series.time).alias("_seconds"),
                        F.xxhash64(*series.keys, series.time).alias("_id"))


def _blocks(store: DataFrame, base: list[str], features: list[str], edges: list[list[float]], spec: Boosting,
            horizons: list[int]) -> RDD:
    """Training blocks: one array of bin numbers a horizon, targets, row hashes, predictions so far."""
    wanted, cuts = sorted(horizons), [np.array(e, float) for e in edges]
    at = _places(base, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, hours, x, y = pairs_of(b, base)
            x = x[:, at]
            ids = b.column("_id").to_numpy(zero_copy_only=False)
            made = []
            for h in wanted:
                own = hours == h
                if not own.any():
                    continue
                bins = np.column_stack([np.searchsorted(c, x[own, k]) for k, c in enumerate(cuts)]).astype(np.uint8)
                out = io.BytesIO()
                np.savez(out, h=h, bins=bins, y=y[own], ids=ids[row[own]])
                made.append(out.getvalue())
            yield pa.record_batch([pa.array(made, pa.binary())], names=["block"])

    def load(r) -> dict:
        with np.load(io.BytesIO(r.block)) as z:
            block = {k: z[k] for k in z.files}
        block["h"], block["made"] = int(block["h"]), 0.0
        block["held"] = _draw(block["ids"], spec.seed, -1, block["h"]) < spec.held_out
        return block

    return _scan(store, base).mapInArrow(run, "block binary").rdd.map(load)


def _draw(ids: np.ndarray, seed: int, round_: int, h: int) -> np.ndarray:
    """A number in [0, 1) for each row, the same whenever and wherever it is asked for."""
    with np.errstate(over="ignore"):
        z = ids.view(np.uint64) + np.uint64((seed * 1_000_003 + round_ * 8191 + h + 1) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)).astype(np.float64) / 2.0 ** 64


# -- growing -----------------------------------------------------------------------------------
@dataclass
class _Growing:
    """A tree under construction: nodes with their sums, and the best split of those that were measured."""

    columns: np.ndarray
    tree: Tree = field(default_factory=Tree)
    bins: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sums: list[tuple[float, int]] = field(default_factory=list)
    best: dict[int, tuple | None] = field(default_factory=dict)
    made: dict[int, tuple[int, int]] = field(default_factory=dict)

    def add(self, depth: int, sums: tuple[float, int]) -> int:
        for values, v in ((self.tree.feature, -1), (self.tree.threshold, 0.0), (self.tree.left, 0), (self.tree.right, 0),
                          (self.tree.value, 0.0), (self.bins, 0), (self.depth, depth), (self.sums, sums)):
            values.append(v)
        return len(self.bins) - 1

    def children(self, node: int) -> tuple[int, int]:
        """The nodes below a measured node's best split, made once."""
        if node not in self.made:
            _, feature, cut, g, n = self.best[node]
            (total, rows), d = self.sums[node], self.depth[node] + 1
            self.made[node] = (self.add(d, (g, n)), self.add(d, (total - g, rows - n)))
            self.tree.feature[node], self.bins[node] = feature, cut
            self.tree.left[node], self.tree.right[node] = self.made[node]
        return self.made[node]

    def known(self, node: int, spec: Boosting) -> bool:
        return node in self.best or self.depth[node] >= spec.depth or self.sums[node][1] < 2 * spec.least_rows

    def grow(self, spec: Boosting) -> tuple[set[int], set[int]]:
        """(leaves, nodes to measure first): splits the leaf of the greatest gain as long as all are known.

        If some are not, the children of every leaf that may still be split are asked for as well."""
        leaves = {0}
        while not spec.leaves or len(leaves) < spec.leaves:
            unknown = {x for x in leaves if not self.known(x, spec)}
            useful = [x for x in leaves if self.best.get(x)]
            if unknown:
                if spec.leaves:
                    unknown |= {c for x in useful for c in self.children(x) if not self.known(c, spec)}
                return leaves, unknown
            if not useful:
                break
            split = max(useful, key=lambda x: (self.best[x][0], -x))
            leaves = leaves - {split} | set(self.children(split))
        return leaves, set()

    def finished(self, spec: Boosting, edges: list[list[float]]) -> Tree:
        """The tree without nodes that were only tried, with leaf values and thresholds in the inputs' units."""
        leaves, _ = self.grow(spec)
        out = Tree()

        def copy(node: int) -> int:
            at = len(out.feature)
            leaf = node in leaves
            f = -1 if leaf else self.tree.feature[node]
            out.feature.append(f)
            out.threshold.append(0.0 if leaf else float(edges[f][self.bins[node]]))
            g, n = self.sums[node]
            out.value.append(float(-_shrunk(g, spec.l1) / (n + spec.l2)) if leaf and n + spec.l2 > 0 else 0.0)
            out.left.append(0)
            out.right.append(0)
            if not leaf:
                for side, child in zip((out.left, out.right), self.made[node]):
                    side[at] = copy(child)
            return at
        copy(0)
        return out


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(sums: np.ndarray, counts: np.ndarray, spec: Boosting) -> tuple | None:
    """(gain, feature number, bin, gradient and rows of the left side) of one node's histograms, None if no split helps.

    sums and counts are (features, bins). Of equal gains the first feature's first bin counts."""
    g, n = sums.cumsum(1)[:, :-1], counts.cumsum(1)[:, :-1]
    total, rows = sums[0].sum(), counts[0].sum()
    score = lambda a, b: _shrunk(a, spec.l1) ** 2 / np.maximum(b + spec.l2, 1e-300)
    gain = score(g, n) + score(total - g, rows - n) - score(total, rows)
    gain[(n < spec.least_rows) | (rows - n < spec.least_rows)] = -np.inf
    if not gain.size or not gain.max() > 1e-6:
        return None
    f, cut = divmod(int(gain.argmax()), gain.shape[1])
    return float(gain[f, cut]), f, cut, float(g[f, cut]), int(n[f, cut])


def _bin_trees(trees: list[Tree], edges: list[list[float]]) -> list[tuple[Tree, list[float]]]:
    """Trees with thresholds as bin numbers, for rows that are bin numbers."""
    return [(t, [float(np.searchsorted(edges[f], c)) if f >= 0 else 0.0 for f, c in zip(t.feature, t.threshold)]) for t in trees]


def _predicted(block: dict, trees: dict[int, list], base: dict[int, float], rate: float) -> np.ndarray:
    out = np.broadcast_to(block["made"], block["y"].shape) + np.zeros(len(block["y"]))
    for t, cuts in trees.get(block["h"], ()):
        out += rate * np.array(t.value)[t.leaf_of(block["bins"], cuts)]
    return out


def _measure(blocks: RDD, base: dict[int, float], recent: dict[int, list], growing: dict[int, _Growing], wanted: dict[int, list[int]],
             round_: int, spec: Boosting) -> dict[tuple[int, int], tuple]:
    """One pass: (horizon, node) -> (gradient, rows, best split) of the wanted nodes, and (horizon, -1) -> held-out loss."""
    width = spec.bins + 1
    trees = {h: (g.tree, g.bins, g.columns) for h, g in growing.items()}

    def partial(block: dict):
        h = block["h"]
        if h not in wanted:
            return
        off = base[h] + _predicted(block, recent, base, spec.rate) - block["y"]
        held = block["held"]
        if held.any():
            yield (h, -1), np.array([(off[held] ** 2).sum(), held.sum()])
        used = ~held & (_draw(block["ids"], spec.seed, round_, h) < spec.rows)
        tree, cuts, columns = trees[h]
        bins, g = block["bins"][used], off[used]
        node = tree.leaf_of(bins, cuts) if tree.feature else np.zeros(len(bins), np.int64)
        for k in wanted[h]:
            own = node == k
            if not own.any():
                continue
            x = bins[own][:, columns].astype(np.int64) + np.arange(len(columns)) * width
            flat, weights = x.ravel(), np.repeat(g[own], len(columns))
            size = len(columns) * width
            yield (h, k), np.stack([np.bincount(flat, weights, size), np.bincount(flat, minlength=size)])

    def choose(item):
        (h, k), sums = item
        if k < 0:
            return (h, k), tuple(sums)
        sums = sums.reshape(2, -1, width)
        return (h, k), (float(sums[0, 0].sum()), int(sums[1, 0].sum()), best_split(sums[0], sums[1], spec))

    parts, keys = blocks.getNumPartitions(), sum(map(len, wanted.values()))
    columns = max(len(t[2]) for t in trees.values())
    found = blocks.flatMap(partial)
    if parts * keys * columns * width * 16 <= DRIVER_BYTES:  # so little that a shuffle would cost more than it saves
        summed: dict[tuple[int, int], np.ndarray] = {}
        for k, v in found.collect():
            summed[k] = summed[k] + v if k in summed else v
        return dict(map(choose, summed.items()))
    return dict(found.reduceByKey(np.add, parts).map(choose).collect())


def fit_boosted(store: DataFrame, horizons: list[int], spec: Boosting = DIRECT, features: list[str] | None = None,
                blocks: int | None = None) -> dict[int, BoostedTrees]:
    """One boosted model a horizon out of a horizon store (see horizons.horizon_store), all grown side by side.

    A row counts for a horizon where the target and all inputs are known. Rows and columns of each tree
    and the held-out rows are drawn by hash, so a repeated or recomputed task draws the same. A horizon stops
    when its held-out loss has not fallen by ``tolerance`` for ``patience`` rounds, and then ends at its best.
    ``blocks`` sets the number of partitions the passes run over; the scan's own number without it.
    """
    spark, (base, features) = store.sparkSession, _base_of(store, features)
    every = _edges(store, base, spec.bins)
    edges = [every[k] for k in _places(base, features)]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    data = _blocks(store, base, features, edges, spec, horizons)
    data = (data.coalesce(blocks) if blocks else data).persist(StorageLevel.MEMORY_AND_DISK)
    means = dict(data.map(lambda b: (b["h"], np.array([b["y"][~b["held"]].sum(), (~b["held"]).sum()]))).reduceByKey(np.add).collect())
    start = {h: float(v[0] / v[1]) for h, v in means.items() if v[1]}
    if missing := sorted(set(horizons) - set(start)):
        raise DataContractError(f"no rows to learn from for horizons {missing}")
    models = {h: BoostedTrees(tuple(features), start[h], spec.rate, []) for h in sorted(horizons)}
    recent: dict[int, list] = {h: [] for h in models}
    live, n_columns = set(models), max(1, round(spec.columns * len(features)))
    try:
        for r in range(spec.rounds + bool(spec.held_out)):
            growing = {h: _Growing(np.sort(np.random.default_rng([spec.seed, h, r]).choice(len(features), n_columns, replace=False)))
                       for h in live}
            wanted = {h: [0] for h in live}
            while wanted:
                found = _measure(data, start, recent, {h: growing[h] for h in wanted}, wanted, r, spec)
                for (h, k), got in found.items():
                    if k < 0:
                        if wanted[h] == [0]:
                            models[h].losses.append(float(got[0] / got[1]))
                        continue
                    tree = growing[h]
                    if k == 0:
                        tree.add(0, got[:2])
                    split = got[2]
                    tree.best[k] = split and (split[0], int(tree.columns[split[1]]), *split[2:])
                live = {h for h in live if not _stopped(models[h], spec) and growing[h].sums}
                wanted = {h: sorted(need) for h in live if (need := growing[h].grow(spec)[1])}
            if r == spec.rounds or not live:
                break
            for h in live:
                tree = growing[h].finished(spec, edges)
                models[h].trees.append(tree)
                recent[h] += _bin_trees([tree], edges)
            if (r + 1) % EPOCH == 0:
                data, recent = _advanced(data, recent, start, spec), {h: [] for h in models}
    finally:
        data.unpersist()
    for m in models.values():
        if spec.held_out and m.losses:
            m.trees = m.trees[: int(np.argmin(m.losses))]  # the loss of round r is that of its first r trees
    return models


def _advanced(data: RDD, recent: dict[int, list], start: dict[int, float], spec: Boosting) -> RDD:
    """The blocks with the recent trees in their predictions, checkpointed in the shared folder."""
    state = data.context.broadcast(recent)
    moved = data.map(lambda b: {**b, "made": _predicted(b, state.value, start, spec.rate)}).persist(StorageLevel.MEMORY_AND_DISK)
    moved.checkpoint()
    moved.count()
    data.unpersist()
    return moved


def _stopped(model: BoostedTrees, spec: Boosting) -> bool:
    losses = model.losses
    if not spec.held_out or len(losses) <= spec.patience:
        return False
    return min(losses[-spec.patience:]) > min(losses[:-spec.patience]) - spec.tolerance


def _edges(store: DataFrame, base: list[str], bins: int) -> list[list[float]]:
    """Bin edges of all inputs. Weather ahead has the edges of the same measure, whatever the horizon."""
    wind = F.radians(F.col(f"_w.{WIND_DIRECTION}"))
    sources = {n: F.col(f"_w.{s}") for n, s in FUTURE_WEATHER.items()}
    rows = store.select(*base, F.get(AHEAD, F.lit(0)).alias("_first")).select(*base, F.struct(
        *[F.col(f"_first.{n}").alias(s) for n, s in FUTURE_WEATHER.items()], F.col("_first.direction").alias(WIND_DIRECTION)).alias("_w"))
    rows = rows.select(*base, *[c.alias(n) for n, c in sources.items()], F.sin(wind).alias("_sin"), F.cos(wind).alias("_cos"))
    found = bin_edges(rows, [*base, *sources, "_sin", "_cos"], bins)
    calendar = [range(24), range(7), range(1, 13), range(2)]
    return [*(found[c] for c in (*base, *FUTURE_WEATHER, "_sin", "_cos")), *([float(v) for v in c] for c in calendar)]


# -- scoring -----------------------------------------------------------------------------------
def score_store(store: DataFrame, models: dict[int, BoostedTrees], series: Series = HOURLY) -> DataFrame:
    """(keys, time, horizon, target, prediction) for all rows and the models' horizons, in one pass.

    The models must share their inputs."""
    base, features = _base_of(store, next(iter(models.values())).features)
    places = _places(base, features)
    held = store.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, hours, x, y = pairs_of(b, base)
            x = x[:, places]
            for h, m in held.value.items():
                own = hours == h
                at = pa.array(row[own])
                yield pa.record_batch([
                    *(b.column(k).take(at) for k in (*series.keys, series.time)), pa.array(np.full(own.sum(), h, np.int32)),
                    pa.array(y[own]), pa.array(m.predict(x[own]))], names=[*series.keys, series.time, "horizon", "target", "prediction"])

    kinds = ", ".join(f"`{k}` {store.schema[k].dataType.simpleString()}" for k in (*series.keys, series.time))
    return _scan(store, base, series).mapInArrow(run, f"{kinds}, horizon int, target double, prediction double")


def score_rows(inputs: DataFrame, models: dict[int, BoostedTrees], horizon: str = "horizon_hours") -> DataFrame:
    """Rows with model inputs and their horizon -> the same rows with a prediction; one pass for all models."""
    held = inputs.sparkSession.sparkContext.broadcast(models)
    columns = inputs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hours = b.column(horizon).to_numpy(zero_copy_only=False)
            out = np.full(b.num_rows, np.nan)
            for h, m in held.value.items():
                own = np.flatnonzero(hours == h)
                if len(own):
                    x = np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)[own] for c in m.features])
                    out[own] = m.predict(x)
            yield pa.record_batch([*b.columns, pa.array(out)], names=[*columns, "prediction"])

    return inputs.where(F.col(horizon).isin(list(models))).mapInArrow(
        run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema) + ", prediction double")


def boosted_metrics(store: DataFrame, models: dict[int, BoostedTrees], boundary, name: str = "Boosted trees",
                    source: str = "feature table", series: Series = HOURLY) -> DataFrame:
    """Scores of the rows from the boundary on, and the rows on both sides of it, horizon by horizon."""
    test = F.col(series.time) >= F.lit(boundary).cast("timestamp_ntz")
    sides = regression_metrics(score_store(store, models, series).withColumn("_test", test), "target", "prediction",
                               ("horizon", "_test"))  # one pass; a row a horizon and side
    of = lambda side, c: F.max(F.when(F.col("_test") == side, F.col(c)))
    return sides.groupBy("horizon").agg(
        F.coalesce(of(False, "row_count"), F.lit(0)).alias("training_rows"), F.coalesce(of(True, "row_count"), F.lit(0)).alias("test_rows"),
        *[of(True, c).alias(c) for c in ("mae", "rmse", "r2")]).select(
        F.lit(name).alias("model"), F.lit(source).alias("data_source"), F.col("horizon").alias("forecast_horizon_hours"),
        "training_rows", "test_rows", "mae", "rmse", "r2")
