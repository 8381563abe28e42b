"""Whitening of vectors by shifted CholeskyQR over distributed Gram passes.

A pass sums ``Z'Z`` of the centred rows ``Z`` block by block; the Cholesky factor ``R`` of that
sum (with a small multiple of the identity added where it would not be safely positive)
turns each row into ``z R**-1`` by a triangular solve in the next pass. Repeated, the rows
become orthonormal even where the covariance is badly conditioned, and the product of the
factors is the ``R`` of the whole table: ``Y = Q R``. Its singular value decomposition
``R = U S W'`` gives the components (``W``), their variances (``S**2 / n``) and, from the
orthonormal rows, the whitened values ``Q U sqrt(n)``; no covariance is ever inverted.

Entries are whole numbers (``floor(64 * c) + 1000000``), so sums are exact, and rows are
centred as ``(n * x - S) / n`` from whole numbers before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..tables import checkpointed, table

#: Components returned at most.
COMPONENTS = 32
#: Whole units of one, and what is added, so that entries become whole numbers.
UNITS, OFFSET = 64, 1_000_000
#: Entries of this size or more leave no room for their sums in 64 bits; their rows are dropped.
MOST = 2.0**40
#: Rows that are multiplied at once.
BLOCK = 4096
#: Gram passes at most; they end when every eigenvalue is this close to one, for each dimension (or, from a few passes on, next to nothing: a direction without variance).
PASSES, CLOSE = 6, 1e-13
#: Bytes of partial sums that the driver, or one task, adds up at most.
SUM_BYTES = 1 << 26
#: Vector lengths that a task keeps sums of before it hands them on.
LENGTHS = 16
_UNIT = np.finfo(np.float64).eps / 2


class Whitening(NamedTuple):
    """Row count, sums by dimension, triangular factors in the order in which rows are solved by them, ``U sqrt(n)`` of the components, these as rows, their shares of the variance, and the measured error."""

    n: int
    sums: np.ndarray
    factors: list[np.ndarray]
    turn: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def _blocks(batches: Iterator[pa.RecordBatch], length: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of the last column that can be used, as whole numbers: their length, their rows in the batch, the numbers. All lengths, or the given one."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        for begin in range(0, len(lists), BLOCK):
            own = lists.slice(begin, BLOCK)
            sizes = np.asarray(own.value_lengths().fill_null(-1))
            for d in np.unique(sizes[sizes >= 0]).tolist() if length is None else [length]:
                at = np.flatnonzero(sizes == d)
                values = own.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), d)
                fit = (np.abs(values) < MOST).all(axis=1)
                if fit.any():
                    yield d, at[fit] + begin, np.floor(UNITS * values[fit]).astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length the number of vectors and the sums of their dimensions."""
    found: dict[int, list] = {}

    def told():
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([s.tobytes() for _, s in found.values()], pa.binary())], ["length", "n", "part"])

    for d, at, x in _blocks(batches, None):
        if d not in found and len(found) == LENGTHS:
            yield told()
            found.clear()
        own = found.setdefault(d, [0, np.zeros(d, np.int64)])
        own[0] += len(at)
        own[1] += x.sum(axis=0)
    yield told()


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums).astype(np.float64) / n


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows @ inv(factor)`` for an upper triangular factor, by substitution column by column."""
    out = np.empty_like(rows)
    for j in range(len(factor)):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _turned(x: np.ndarray, n: int, sums: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    rows = _centred(x, n, sums)
    for factor in factors:
        rows = solved(rows, factor)
    return rows


def _gram(batches: Iterator[pa.RecordBatch], state) -> Iterator[pa.RecordBatch]:
    """``Z'Z`` of a task's rows, and below it the sums of ``Z``."""
    n, sums, factors = state.value
    total = np.zeros((len(sums) + 1, len(sums)))
    for _, _, x in _blocks(batches, len(sums)):
        z = _turned(x, n, sums, factors)
        total[:-1] += z.T @ z
        total[-1] += z.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def _added(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column(0):
            own = np.frombuffer(part.as_py(), dtype=kind)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def _total(parts: DataFrame, kind: type, numbers: int) -> np.ndarray:
    """The sum of the packed arrays of ``part``, level by level, so that no task or driver adds more than :data:`SUM_BYTES` of them at once."""
    most = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fan = int(min(256, max(2, SUM_BYTES // (8 * numbers))))
    while True:
        parts = parts.select("part").repartition(most).mapInArrow(partial(_added, kind=np.dtype(kind).str), "part binary")
        if most <= fan:
            break
        most = -(-most // fan)
    return np.sum([np.frombuffer(r[0], dtype=kind) for r in parts.collect()], axis=0)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening learned from all vectors that can be used (see :func:`whiten`); None if there are none."""
    spark = vectors.sparkSession
    rows = vectors.select(column)
    sums = checkpointed(rows.mapInArrow(_sums, "length long, n long, part binary"))
    usual = sums.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not usual or not usual[0]["length"]:
        return None
    d, n = usual[0]
    total = _total(sums.where(F.col("length") == d), np.int64, d)
    factors: list[np.ndarray] = []
    for k in range(PASSES):
        state = spark.sparkContext.broadcast((n, total, factors))
        gram = _total(rows.mapInArrow(partial(_gram, state=state), "part binary"), np.float64, d * (d + 1)).reshape(d + 1, d)
        state.destroy()
        gram, means = gram[:-1], gram[-1] / n
        values, turned = np.linalg.eigh(gram)
        if k == 0:
            trace = float(np.trace(gram))
            if not trace > 0:
                return Whitening(n, total, [], np.zeros((d, 0)), np.zeros((0, d)), np.zeros(0), 0.0)
        bound = 11 * (BLOCK * d + d * (d + 1)) * _UNIT * values[-1]
        flat = values <= bound
        if k and (np.abs(values[~flat] - 1) <= CLOSE * max(d, 10)).all() and (k > 3 or not flat.any()) or k == PASSES - 1:
            break
        lift = np.eye(d) if k == 0 else turned[:, flat] @ turned[:, flat].T  # later passes lift directions without variance only
        factors.append(np.linalg.cholesky(gram + bound * lift).T)
    whole = np.linalg.multi_dot([*factors[::-1], np.eye(d)])
    u, sigma, w = np.linalg.svd(whole)
    kept = np.flatnonzero(sigma > sigma[0] * max(d, 8) * 8 * _UNIT)[:components]
    sign = np.where(w[kept, np.abs(w[kept]).argmax(axis=1)] < 0, -1.0, 1.0)
    u, w = u[:, kept] * sign, w[kept] * sign[:, None]
    mean = means @ u * np.sqrt(n)
    error = u.T @ gram @ u - np.outer(mean, mean) - np.eye(len(kept))
    return Whitening(n, total, factors, u * np.sqrt(n), w, sigma[kept] ** 2 / trace, float(np.abs(error).max()))


def _whitened(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = model.value
    m = len(own.explained)
    for batch in batches:
        for _, at, x in _blocks([batch], len(own.sums)):
            apart = own.n * x - own.sums
            deviation = (apart * apart).sum(axis=1)  # exact modulo 2**64
            fits = (apart.astype(np.float64) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            z = _turned(x, own.n, own.sums, own.factors) @ own.turn
            many = np.repeat(np.arange(len(at)), m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at[many])), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))), pa.array(np.full(len(many), own.n)), pa.array(deviation[many], mask=~fits[many]), pa.array(z.ravel()), pa.array(np.tile(own.explained, len(at))), pa.array(np.full(len(many), own.identity_error))],
                [batch.schema.names[0], *RESULTS],
            )


RESULTS = {"component": "integer", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that can be used and each component up to ``components``: ``key``, ``component`` (from 1, by falling variance), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Not used: null vectors, those with a null, NaN, infinite or enormous (:data:`MOST`) entry,
    and those of another length than most have (ties: the longest). Repeated rows and equal or
    null keys each count. Directions without variance give no component, so a table whose
    vectors are all equal, or without any, gives no row. ``deviation`` is null where it does not
    fit in 64 bits. Other columns are not read. The sign of a component is such that its largest
    entry is positive. The table is read once for the sums, once for each Gram pass (3 as a
    rule), and once for the result; no row is shuffled.
    """
    schema = T.StructType([vectors.schema[key]])
    for name, kind in RESULTS.items():
        schema = schema.add(name, kind)
    model = fit(vectors, column, components)
    if model is None or not len(model.explained):
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.select(key, column).mapInArrow(partial(_whitened, model=vectors.sparkSession.sparkContext.broadcast(model)), schema)


def op12_whitening(spark, sf_dir):
    """The whitened vectors of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings"))
