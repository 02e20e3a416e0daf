"""Embedding whitening by shifted CholeskyQR.

Vectors are read in exact fixed point, x = floor(SCALE * c) + OFFSET.  The fit list has every distinct
vector once, so that copies weigh nothing.  Its centred rows A = x - mean are orthogonalised by passes over
the list: a pass sums the Gram matrix of Q = A R1^-1 ... Rk^-1 (one triangular solve per factor, so no
inverse is formed), and its Cholesky factor is the next R.  The first Gram matrix is shifted
by a bound of its rounding error, so that the factor exists even where A is nearly singular; a later one is
shifted only if it isn't positive definite.  Once Q is orthonormal, A = Q R with R the product of the
factors, and the singular values and right vectors of R are those of A, small ones not squared away.

Tasks send d x d sums, which are added by cell before the driver reads them; the driver holds d x d
matrices and no rows.  Sums of x are exact (integers), and rows are centred as (n x - S) / n.

Left out are vectors that are null, empty or hold a null, a non-finite entry or one beyond
+-2**53 / SCALE, whose x isn't exact.  Vectors must have one length: the fit takes the commonest length
among distinct vectors (of ties the greatest) and vectors of others are left out as well.  Null ids stay null.
Repeated rows and ties give equal results; of equal eigenvalues the vectors are any orthonormal ones.
A component without variance (to working precision) has null ``whitened``.  ``deviation`` is null where it
doesn't fit a long.  An empty table gives an empty one.  Other columns are left behind, so names can't clash.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import words as W
from commitlens.session import cut

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Rows whose products a task forms at a time.
ROWS = 4096
#: Q is orthonormal enough if its Gram matrix is this near the identity; one more factor then makes R exact.
NEAR = 1e-9
PASSES = 8


def fixed_point(lists):
    """Which vectors of an Arrow list column can be read, and the x of those, laid end to end, with their lengths."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    with np.errstate(all="ignore"):
        c = SCALE * flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        good = np.abs(c) <= 2.0**53
    bad = np.append(0, np.cumsum(~good))
    lengths = np.diff(offsets)
    usable = (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
    x = np.floor(c[np.repeat(usable, lengths)]).astype(np.int64) + OFFSET
    return usable, x, lengths[usable]


def vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """The fit list: (x) of every distinct vector that can be read."""

    def run(batches):
        for batch in batches:
            _, x, lengths = fixed_point(batch.column(0))
            ends = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x))], names=["x"])

    return table.select(column).mapInArrow(run, W.schema("x array<bigint>")).distinct()


@dataclass
class Whitening:
    """What a fit knows: n rows of d entries with sums S, factors R1, R2, ..., and the leading components."""

    d: int
    n: int
    sums: list
    factors: list
    values: np.ndarray = None
    components: np.ndarray = None
    trace: float = 0.0
    identity_error: float = None

    def scaled(self, x):
        """n * x - S, exact: int64, or Python integers where that could overflow."""
        pivot = [s // self.n for s in self.sums]
        rest = [s - self.n * p for s, p in zip(self.sums, pivot)]
        away = x - np.array(pivot, np.int64)
        if (int(np.abs(away).max(initial=0)) + 1) * self.n >= 1 << 62:
            away = away.astype(object)
        return away * self.n - np.array(rest, away.dtype)

    def centred(self, x):
        return (self.scaled(x) / self.n).astype(np.float64)

    def orthogonal(self, x):
        q = self.centred(x)
        for r in self.factors:
            q = solve_right(q, r)
        return q

    def whiten(self, centred):
        """Projections on the components, over the roots of their eigenvalues; NaN without variance."""
        with np.errstate(all="ignore"):
            return centred @ self.components / np.where(self.values > 0, np.sqrt(self.values), np.nan)


def solve_right(a, r):
    """Q with Q R = A for an upper triangular R."""
    q = np.empty_like(a)
    for j in range(r.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _rows(batches, d):
    """The x of list batches as matrices of at most ROWS rows."""
    for batch in batches:
        lists = batch.column(0)
        x = lists.flatten().to_numpy().reshape(-1, d)
        for start in range(0, len(x), ROWS):
            yield x[start : start + ROWS]


def _gram(fit, d, of):
    """The Gram matrix of ``of(x)`` over the fit list, added by cell."""

    def run(batches):
        total = None
        for x in _rows(batches, d):
            q = of(x)
            total = q.T @ q + (0 if total is None else total)
        if total is not None:
            cells = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], names=["cell", "value"])

    sums = fit.mapInArrow(run, W.schema("cell bigint, value double")).groupBy("cell").agg(F.sum("value").alias("value")).collect()
    width = int(len(sums) ** 0.5)
    gram = np.zeros(width * width)
    for cell, value in sums:
        gram[cell] = value
    gram = gram.reshape(width, width)
    return (gram + gram.T) / 2


def _sums(fit, d):
    """How many rows the fit list has, and the exact sums of their entries, which tasks add in two halves."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for x in _rows(batches, d):
            n += len(x)
            high += (x >> 26).sum(axis=0)
            low += (x & ((1 << 26) - 1)).sum(axis=0)
        columns = [pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", "high", "low"])

    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = fit.mapInArrow(run, W.schema("cell bigint, n bigint, high bigint, low bigint")).groupBy("cell").agg(*whole).collect()
    sums, n = [0] * d, 0
    for r in found:
        sums[r.cell], n = (int(r.high) << 26) + int(r.low), int(r.n)
    return n, sums


def factor(gram, n, shifted):
    """The Cholesky factor R of ``gram`` (R^T R), shifted by a bound of the rounding error if asked to or if needed."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * 2.0**-53 * max(float(np.linalg.norm(gram, 2)), 2.0**-1000)
    # A bound that grows with n is more than enough once it reaches the matrix itself.
    shift = min(shift, 1e-3 * float(np.linalg.norm(gram, 2)) or 1.0)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the fit list, or None if there is no vector."""
    found = cut(vectors(table, column), "vectors")
    common = found.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first().m
    if common is None:
        return None
    d = common.d
    found = found.filter(F.size("x") == d)
    n, sums = _sums(found, d)
    model = Whitening(d, n, sums, [])
    for k in range(PASSES):
        gram = _gram(found, d, model.orthogonal)
        near = np.abs(gram - np.eye(d)).max() < NEAR
        last = near or k == PASSES - 1 or not gram.any()
        if last:
            break
        model.factors.append(factor(gram, n, shifted=k == 0))
    # The last Gram matrix is all but the identity; its root corrects what is left.  Where A lacks rank it has zeros.
    values, vectors_ = np.linalg.eigh(gram)
    r = (vectors_ * np.sqrt(np.maximum(values, 0))).T
    for x in reversed(model.factors):
        r = r @ x
    _, sigma, v = np.linalg.svd(r)
    e = sigma**2 / n
    e[sigma <= sigma.max(initial=0) * d * 2.0**-52] = 0
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], 1) < 0, -1, 1)
    k = min(components, d)
    model.trace, model.values, model.components = float(e.sum()), e[:k], v[:k].T
    live = int((model.values > 0).sum())
    if live:
        def white(x):
            return model.whiten(model.centred(x))[:, :live]

        model.identity_error = float(np.abs(_gram(found, d, white) / n - np.eye(live)).max())
    return model


def _deviations(scaled):
    """Sums of squares, exact; None where they don't fit a long."""
    most = int(np.abs(scaled).max(initial=0)) if len(scaled) else 0
    if most * most * scaled.shape[1] < 1 << 62:
        return pa.array((scaled * scaled).sum(axis=1).astype(np.int64))
    whole = (scaled.astype(object) ** 2).sum(axis=1)
    return pa.array([int(s) if s < 1 << 63 else None for s in whole], pa.int64())


def whiten(table: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    ``deviation`` is the sum over dimensions of (n x - S)^2, ``explained`` the component's share of all
    variance, ``identity_error`` the greatest entry of the whitened fit list's covariance less the identity.
    """
    table = table.select(F.col(key).cast("bigint").alias(key), column)
    kinds = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    out = W.schema(f"`{key}` bigint, {kinds}")
    if model is None:
        return table.sparkSession.createDataFrame([], out)

    def run(batches):
        k = len(model.values)
        shares = model.values / model.trace if model.trace else np.zeros(k)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                usable, x, lengths = fixed_point(part.column(1))
                fits = lengths == model.d
                rows = np.flatnonzero(usable)[fits]
                x = x[np.repeat(fits, lengths)].reshape(-1, model.d)
                scaled = model.scaled(x)
                white = model.whiten((scaled / model.n).astype(np.float64))
                m, each = len(rows) * k, pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(m, model.n)),
                        _deviations(scaled).take(each),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(shares, len(rows))),
                        pa.array([model.identity_error] * m, pa.float64()),
                    ],
                    names=out.names,
                )

    return table.mapInArrow(run, out)
