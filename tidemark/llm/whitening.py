"""Embedding whitening: covariance as Spark aggregates, its components by QDWH spectral divide-and-conquer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

SCALE, COMPONENTS = 256.0, 4
EPS = np.finfo(float).eps
MAX_LONG = (1 << 63) - 1


# ---- spectral divide-and-conquer of a small symmetric matrix -------------------------------------

def polar_factor(h: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the dynamically weighted Halley iteration.

    In each step the weights a, b, c are those that best lift the singular values' lower bound l to 1; the
    step is taken through a QR factorisation of [sqrt(c) X; I], which never forms an inverse.
    """
    n, size = len(h), np.linalg.norm(h)
    if size == 0:
        return np.eye(n)
    x, l = h / size, EPS
    for _ in range(30):
        d = (4 * (1 - l * l) / l ** 4) ** (1 / 3)
        a = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l * l) / (l * l * np.sqrt(1 + d)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        new = b / c * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        l = min(1.0, l * (a + b * l * l) / (1 + c * l * l))
        if l > 1 - 1e-15 and moved < 1e-14 * n:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None for (near) multiples of I.

    The polar factor U of A - shift gives the projector (U + I) / 2 on the eigenvalues above the shift. A shift
    on an eigenvalue leaves coupling between the parts and is replaced by another one.
    """
    n, size = len(a), np.linalg.norm(a)
    if np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= 8 * EPS * n * size:
        return None
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.diag(np.diag(a)), 2)
    shifts = [np.median(diagonal), np.trace(a) / n, *((diagonal[1:] + diagonal[:-1]) / 2)[:: max(1, n // 4)],
              *(np.trace(a) / n + spread * np.array([.5, -.5, .25, -.25, .1, -.1, .9, -.9]))]
    for least in (1e-14, 1e-13, 1e-12):
        for shift in shifts:
            u = polar_factor(a - shift * np.eye(n))
            p = (u + np.eye(n)) / 2
            k = int(round(np.trace(p)))
            if not 0 < k < n:
                continue
            # The projector's own columns of greatest norm span its range; one more product sharpens it.
            first = np.argsort(-np.linalg.norm(p, axis=0), kind="stable")
            q, _ = np.linalg.qr(np.hstack([p @ np.linalg.qr(p[:, first[:k]])[0], np.eye(n) - p]))
            up, down = q[:, :k], q[:, k:n]
            if np.linalg.norm(down.T @ a @ up) <= least * n * size:
                return up, down
    return None


def leading_components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the `count` largest of a symmetric matrix.

    Subspaces are split again and again, the upper one first; what lies below the wanted ones is left whole.
    A block that is a multiple of the identity ends the splitting: any basis of it will do.
    """
    values: list[float] = []
    vectors: list[np.ndarray] = []
    work = [np.eye(len(v))]  # the last holds the largest eigenvalues
    while work and len(values) < count:
        basis = work.pop()
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        parts = _split(block) if len(block) > 1 else None
        if parts is None:
            order = np.argsort(-np.diag(block), kind="stable")
            values += np.diag(block)[order].tolist()
            vectors += list(basis[:, order].T)
        else:
            work += [basis @ parts[1], basis @ parts[0]]
    order = np.argsort(-np.array(values), kind="stable")[:count]
    return np.array(values)[order], np.array(vectors).reshape(-1, len(v))[order].T


# ---- Spark side ----------------------------------------------------------------------------------

def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): x = floor(256 * entry), for the rows whose vector has entries, all of them finite numbers."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    return rows.filter(F.coalesce(good, F.lit(False))).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Rows, exact sums by dimension and the greatest absolute entry. One row a partition reaches the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, most = 0, np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for b in batches:
            x = _matrix(b.column("x"), d)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
            most = max([most, *(abs(int(k)) for k in (x.min(), x.max()))]) if len(x) else most
        total = [str((int(h) << 32) + int(k)) for h, k in zip(high, low)]
        yield pa.record_batch([pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array(total),
                               pa.array([str(most)] * d)], names=["n", "at", "total", "most"])

    parts = fit.mapInArrow(run, "n bigint, at int, total string, most string")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s"),
                                   F.max(F.col("most").cast("decimal(38,0)")).alias("most")).orderBy("at").collect()
    return int(rows[0].n), [int(r.s) for r in rows], int(rows[0].most)


def _second_moments(fit: DataFrame, d: int, centre: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Sum over the rows of y y' with y = project' (x - centre): each partition gives its own sum, as rows of entries."""
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            y = (_matrix(b.column("x"), d) - centre) @ project
            total += y.T @ y
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((k, k))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # k * k numbers, whatever the rows
        out[r.i, r.j] = r.v
    return out


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row a vector and component.

    Vectors that are null, empty, or hold null or non-finite entries go. The fit list is each distinct
    quantised vector once; vectors of another length than most distinct ones have (ties: the longer) go as well.
    Null and repeated ids are returned as they come. Components without variance (eigenvalue at rounding level)
    have no whitened form and give no rows, so equal vectors alone give none. deviation is exact; null where
    it passes 2^63. The driver holds the d x d covariance and `components` vectors of d numbers, nothing
    that grows with the rows; these few vectors are what the tasks get.
    """
    rows = quantised(embeddings, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    distinct = stage(rows.select("x").distinct(), "fit-list")
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = lengths.d
    same: Column = F.size("x") == d
    fit = distinct.filter(same)
    n, sums, most = _sums(fit, d)
    mean = np.array([s / n for s in sums])
    v = _second_moments(fit, d, mean, np.eye(d)) / n
    values, vectors = leading_components((v + v.T) / 2, min(components, d))
    useful = values > 64 * EPS * d * max(np.trace(v), 0.0)
    values, vectors = values[useful], vectors[:, useful]
    k = len(values)
    if k == 0:
        return rows.sparkSession.createDataFrame([], schema)
    scaled = vectors / np.sqrt(values)
    error = float(np.abs(_second_moments(fit, d, mean, scaled) / n - np.eye(k)).max())
    explained = (values / np.trace(v)).tolist()
    narrow = d * (2 * n * most) ** 2 <= MAX_LONG  # every product and sum below fits a long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, np.int64 if narrow else object)
        for b in batches:
            x = _matrix(b.column("x"), d)
            off = (x if narrow else x.astype(object)) * n - exact
            deviation = pa.array([int(q) if q <= MAX_LONG else None for q in (off * off).sum(1)], pa.int64())
            at = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch([
                b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), n)), deviation.take(pa.array(at)),
                pa.array(((x - mean) @ scaled).reshape(-1)), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(at), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(same).mapInArrow(run, schema)
