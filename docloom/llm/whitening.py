"""Whitening of embeddings by matrix-free block subspace iteration.

No covariance matrix is ever made. The entries become longs x = floor(64 c) + 1000000; the *fit list* holds each
distinct x vector once, so a vector that a third of all rows repeat counts once and is one row after the
map-side half of the grouping. Then, for a block Q of orthonormal columns:

1. One Spark pass over the fit list computes X'(XQ) of the centred rows. Each task keeps one matrix of dimensions x block
   and streams its rows; the matrices of over MERGERS tasks are summed in MERGERS tasks before the driver sees them.
2. The driver makes the Rayleigh-Ritz step and the residuals VU - UE of the k leading pairs. They certify the pairs once
   each is at most TOLERANCE of the largest eigenvalue.
3. Else the residuals, made orthonormal to the basis by QR, are the next pass's block. The basis keeps the blocks whose
   products are known, BASIS_BLOCKS at most; then its best Ritz vectors take their place. Spectra of embeddings are often flat (of
   those given here the 33rd eigenvalue is 96 % of the 16th, on which plain subspace iteration takes some 800 passes), so
   the step looks for the pairs in all kept blocks, not in the last one alone.

Centring is exact: with S = n m + r per dimension, an entry is (x - m) - r / n, so the offset of 1000000 costs no digit.

Defined cases: a row whose vector is null, or holds null, NaN or an infinity, is dropped. Repeated rows are each returned, the
fit list has them once. Vectors of another length than the most frequent one (of equally frequent, the greater) are
dropped, as are empty ones: they are no points of that space. Components without variance (eigenvalue at most RANK of the largest) don't exist:
constant or too few vectors have fewer than k, one distinct vector none. Entries beyond 9e18 / 64 count as that. deviation is null
where it exceeds a long. A null vec_id stays null. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, written

K = 16
BLOCK = 32
BASIS_BLOCKS = 4
TOLERANCE = 1e-13
RANK = 1e-10
MAX_PASSES = 400
#: Tasks that sum the tasks' matrices, and so the most matrices that the driver gets.
MERGERS = 64
SCALE, OFFSET, EDGE = 64.0, 1_000_000, 9e18


@dataclass(frozen=True)
class Whitening:
    """What a fit found: entries are centred by (x - whole) - rest / n, then projected and divided by sqrt(values)."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int
    residual: float


def whole_entries(vector: Column) -> Column:
    """x = floor(64 c) + 1000000 of each entry; null for vectors that don't count."""
    c = vector.cast("array<double>")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    cut = lambda v: F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), v * SCALE))
    return F.when(usable & (F.size(c) > 0), F.transform(c, lambda v: F.floor(cut(v)).cast("long") + OFFSET))


def points(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that count, and their dimension; 0 if there are none."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole_entries(F.col(vector_col)).alias("x")).filter("x is not null")
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = found[0].d if found else 0
    return rows.filter(F.size("x") == d), d


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The long entries of a batch's column x."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and the exact sum of each dimension: halves of 32 bits, summed as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b, d)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    parts = fit.mapInArrow(run, "at long, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = sorted(parts.groupBy("at").agg(F.sum("n").alias("n"), total("high"), total("low")).collect())
    return rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]


def _summed(fit: DataFrame, d: int, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows of what add(total, x) adds to total for a batch x."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for b in batches:
            add(total, _matrix(b, d))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MERGERS]), pa.array([total.tobytes()], pa.binary())], ["slot", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for part in b.column("part"):
                total += np.frombuffer(part.as_buffer(), np.float64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = fit.mapInArrow(one, "slot long, part binary")
    if fit.rdd.getNumPartitions() > MERGERS:
        parts = parts.repartition(MERGERS, "slot").mapInArrow(merge, "part binary")
    return sum((np.frombuffer(r.part, np.float64).reshape(shape) for r in parts.collect()), np.zeros(shape))


def _pairs(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: Ritz values, falling, and the coefficients of their vectors in the basis."""
    h = basis.T @ product
    values, coefficients = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], coefficients[:, ::-1]


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal block of what of the columns lies outside the basis; columns that all but lie inside go."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def fit(distinct: DataFrame, d: int, k: int = K, block: int = BLOCK, tolerance: float = TOLERANCE) -> Whitening | None:
    """The leading components of a written table of distinct x vectors; null if it is empty."""
    if d == 0:
        return None
    n, sums = _sums(distinct, d)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    shift = rest / n
    k = min(k, d)
    block = min(d, max(block, k))

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - shift

    def multiplied(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q, and V's trace."""

        def add(total: np.ndarray, x: np.ndarray) -> None:
            c = centred(x)
            total[:d] += c.T @ (c @ q)
            total[d, 0] += np.einsum("ij,ij->", c, c)

        out = _summed(distinct, d, (d + 1, q.shape[1]), add) / n
        return out[:d], out[d, 0]

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, block)))[0]
    basis, product, passes, trace = np.zeros((d, 0)), np.zeros((d, 0)), 0, 0.0
    while True:
        made, trace = multiplied(q)
        passes += 1
        basis, product = np.hstack([basis, q]), np.hstack([product, made])
        values, w = _pairs(basis, product)
        vectors = basis @ w[:, :block]
        off = product @ w[:, :block] - vectors * values[:block]
        residual = float(np.linalg.norm(off[:, :k], axis=0).max() / values[0]) if values[0] > 0 else 0.0
        if residual <= tolerance or basis.shape[1] >= d:
            break
        if passes >= MAX_PASSES:
            raise RuntimeError(f"{k} components aren't certified after {passes} passes: residual {residual:.1e}")
        if basis.shape[1] + block > max(2, BASIS_BLOCKS) * block:  # keep the best Ritz vectors, and their products
            keep = w[:, : block * (BASIS_BLOCKS - 2)]
            basis, r = np.linalg.qr(basis @ keep)
            product = np.linalg.solve(r.T, (product @ keep).T).T
        q = _orthonormal(off, basis)
        if not q.shape[1]:
            break
    good = values[:k] > max(values[0], 0.0) * RANK
    k = int(good.sum())
    values, vectors = values[:k], vectors[:, :k]
    if k:
        vectors = vectors / np.linalg.norm(vectors, axis=0)
        largest = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.sign(vectors[largest, np.arange(k)])
    error = 0.0
    if k:
        weights = vectors / np.sqrt(values)

        def add(total: np.ndarray, x: np.ndarray) -> None:
            z = centred(x) @ weights
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)

        out = _summed(distinct, d, (k + 1, k), add) / n
        error = float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())
    return Whitening(n, whole, rest, vectors, values, float(trace), error, passes, residual)


def _deviations(x: np.ndarray, found: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null where it exceeds a long."""
    t = x - found.whole
    most = int(np.abs(t).max(initial=0)) + 1
    if x.shape[1] * (found.n * most) ** 2 < 2**63:
        e = t * found.n - found.rest
        return np.einsum("ij,ij->i", e, e).tolist()
    rest = found.rest.tolist()
    exact = [sum((found.n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in t.tolist()]
    return [v if v < 2**63 else None for v in exact]


def project(rows: DataFrame, d: int, found: Whitening) -> DataFrame:
    """(vec_id, x) -> a row for each component."""
    k = len(found.values)
    weights, shift = found.components / np.sqrt(found.values), found.rest / found.n
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, d)
            z = ((x - found.whole).astype(np.float64) - shift) @ weights
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), found.n, np.int64)),
                    pa.array(_deviations(x, found), pa.int64()).take(pa.array(each)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), found.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, _schema(rows))


def _schema(rows: DataFrame) -> str:
    kind = rows.schema["vec_id"].dataType.simpleString()
    return f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = K, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, d = points(vectors, id_col, vector_col)
    distinct = written(rows.select("x").groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "fit-list")
    found = fit(distinct, d, k, block)
    forget(distinct)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], _schema(rows))
    return project(rows, d, found)
