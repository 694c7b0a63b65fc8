"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

1. Vector entries become whole numbers ``floor(scale * c) + shift``; the fit list
   is each distinct vector once, written in blocks of rows together with exact
   sums, so that centring is exact to a rounding.
2. With X the centred rows (n by d), each step makes one distributed pass: the
   tasks form w = X v - beta u and return X'w, U'w and |w|^2 as sums over their
   rows.  That gives the next u (orthogonalised against all earlier ones) and,
   through X'u, the next v (orthogonalised against all earlier ones, twice).
   The vectors u have one entry a row and are never stored or gathered: a task
   rebuilds its part of them from its rows by the same short recurrence.
   An invariant subspace (repeated values) ends in a fresh start vector that is
   orthogonal to all before.
3. The SVD of the small bidiagonal matrix yields components and deviations.
   Steps go on until the components span the space, or (beyond ``full_dims``
   dimensions) until the residuals of the wanted ones are below ``tol``.
4. Every kept row, repeated ones too, is projected on the components.

Only sums of d + k + 1 numbers come to the driver, grouped in Spark; a task
holds one block of rows at a time.

Defined cases: vectors that are null, hold a null or non-finite entry, or an
entry beyond 2^50 in size (after scaling), take no part; nor do those whose length is not the
commonest one (the longer at a tie).  Rows with a null id stay.  Components of
no variance (as in a fit list of one vector) have no unit scale and are left
out, so such tables, empty tables and empty vectors give no rows.  Extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

BLOCK_ROWS = 4096
WHITENED = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_KEPT = "_wh_x"


@dataclass
class Whitening:
    """Components (d by k), standard deviations and shares of variance, largest first, and the mean as base + rest."""

    n: int
    sums: list[int]
    base: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float
    steps: int


def whole_vectors(vectors: DataFrame, vector_col: str, scale: float, shift: int) -> DataFrame:
    """The rows that take part, with their whole numbers in ``_wh_x``."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    scaled = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))
    fits = F.forall(v, lambda c: F.coalesce(F.abs(c) <= F.lit(2.0**50 / scale), F.lit(False)) & ~F.isnan(c))
    rows = vectors.filter(F.coalesce(fits, F.lit(False))).withColumn(
        _KEPT, F.transform(scaled, lambda c: c.cast("long") + F.lit(int(shift)))
    )
    lengths = rows.groupBy(F.size(_KEPT).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size(_KEPT) == F.lit(lengths[0]["d"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The arrays of a list column as rows of a matrix."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _packer(shift: int):
    def run(batches):
        """Rows packed into blocks, in the narrowest whole numbers that hold them, with the exact sums of each block."""
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at : at + BLOCK_ROWS]
                near = part - shift
                top = int(np.abs(near).max()) if near.size else 0
                narrow = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(part)], pa.int64()),
                        pa.array([near.astype(narrow).tobytes()], pa.binary()),
                        pa.array([[int(s) for s in part.sum(axis=0)]], pa.list_(pa.int64())),
                    ],
                    names=["m", "x", "s"],
                )

    return run


def _centred(m: int, x: bytes, d: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Whole numbers minus the mean: the whole part is taken off exactly, the rest (below one) after."""
    near = np.frombuffer(x, np.dtype(f"i{len(x) // (m * d)}")).reshape(m, d)
    return (near - base).astype(np.float64) - rest


def _sums(blocks: DataFrame, one_block, d: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The sum over all blocks of ``one_block(centred rows)``, a vector: added up in each task, then by entry in Spark."""

    def run(batches):
        total = None
        for batch in batches:
            for m, x in zip(*[c.to_pylist() for c in batch.columns]):
                part = one_block(_centred(m, x, d, base, rest))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    got = blocks.select("m", "x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.empty(len(got))
    for r in got:
        out[r.i] = r.v
    return out


def _against(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w made orthogonal to the columns of q, twice."""
    for _ in range(2):
        w = w - q @ (q.T @ w)
    return w


def _fresh(q: np.ndarray, d: int, rng: np.random.Generator) -> np.ndarray:
    w = _against(q, rng.standard_normal(d))
    return w / np.linalg.norm(w)


def bidiagonalise(pass_over, d: int, wanted: int, full_dims: int, tol: float, seed: int):
    """(V, B) with X V = U B, U and V orthonormal and B upper bidiagonal.

    ``pass_over(V, R, z)`` returns the sums X'w, U'w and |w|^2 for w = X z[0] - U z[1], where U is rebuilt from
    U R = X V.  R holds every coefficient taken off, so the tasks repeat what was done.
    """
    rng = np.random.default_rng(seed)
    v = np.zeros((d, 0))
    u_of = np.zeros((0, 0))  # upper triangular R: X V = U R
    live: list[int] = []  # the steps whose u exists (alpha above zero)
    b = np.zeros((d, d))
    xtu = np.zeros((d, 0))  # X'U
    nxt, beta, scale = _fresh(v, d, rng), 0.0, 0.0
    for k in range(d):
        v = np.column_stack([v, nxt])
        z = np.zeros(len(live))
        if beta and live:
            z[-1] = beta
        xtw, utw, ww = pass_over(v[:, live], u_of, nxt, z)
        size = max(0.0, ww - float(utw @ utw))
        alpha = float(np.sqrt(size))
        scale = max(scale, alpha, float(np.sqrt(ww)))
        taken = z + utw
        for col, j in enumerate(live):
            b[j, k] = taken[col] if j == k - 1 else 0.0
        if alpha > 1e-12 * scale * d:
            # with |w|^2 all but lost to earlier vectors, a sum of squares is too coarse: nothing of w is left
            b[k, k] = alpha
            u_of = np.block([[u_of, taken[:, None]], [np.zeros((1, len(live))), np.array([[alpha]])]])
            w = (xtw - xtu @ utw) / alpha
            xtu = np.column_stack([xtu, w])
            live.append(k)
            left = _against(v, w)
            beta = float(np.linalg.norm(left))
        else:
            left, beta = np.zeros(d), 0.0
        if k + 1 == d:
            break
        if beta > 1e-12 * scale * d:
            nxt = left / beta
        else:
            nxt, beta = _fresh(v, d, rng), 0.0
        if d > full_dims and k + 1 >= wanted and beta:
            p, s, _ = np.linalg.svd(b[: k + 1, : k + 1])
            if np.all(beta * np.abs(p[-1, :wanted]) <= tol * s[0]):
                break
    return v, b[: v.shape[1], : v.shape[1]]


def fit_whitening(
    kept: DataFrame, shift: int, wanted: int = 16, full_dims: int = 512, tol: float = 1e-13, seed: int = 5
) -> Whitening | None:
    """Components of the distinct vectors of ``kept`` (rows of ``whole_vectors``); None if there is no vector."""
    blocks = materialise(
        kept.select(_KEPT).distinct().mapInArrow(_packer(shift), "m long, x binary, s array<long>"), "whitening-blocks"
    )
    rows = blocks.agg(F.sum("m")).first()[0]
    if not rows:
        return None
    n = int(rows)
    total = (
        blocks.select(F.posexplode("s").alias("i", "s"))
        .groupBy("i")
        .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        .collect()
    )
    d = len(total)
    if not d:
        return None
    sums = [int(r.s) for r in sorted(total, key=lambda r: r.i)]
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, base)])

    def pass_over(v, u_of, z, take):
        # U R = X V column by column: u_j = (X v_j - sum of R_ij u_i) / R_jj, as it was made
        def one(x):
            xv = x @ v
            u = np.empty_like(xv)
            for j in range(u.shape[1]):
                u[:, j] = (xv[:, j] - u[:, :j] @ u_of[:j, j]) / u_of[j, j]
            w = x @ z - u @ take
            return np.concatenate([x.T @ w, u.T @ w, [w @ w]])

        got = _sums(blocks, one, d, base - shift, rest)
        return got[:d], got[d:-1], float(got[-1])

    v, b = bidiagonalise(pass_over, d, wanted, full_dims, tol, seed)
    _, s, qt = np.linalg.svd(b)
    trace = float(_sums(blocks, lambda x: np.array([np.einsum("ij,ij->", x, x)]), d, base - shift, rest)[0]) / n
    have = min(wanted, int(np.sum(s > 1e-10 * s[0]))) if len(s) and s[0] > 0 else 0
    if not have:
        return Whitening(n, sums, base, rest, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0, v.shape[1])
    comps, devs = (v @ qt.T)[:, :have], s[:have] / np.sqrt(n)
    comps = comps / np.linalg.norm(comps, axis=0)
    y_mean = _sums(blocks, lambda x: (x @ comps / devs).sum(axis=0), d, base - shift, rest) / n

    def second(x):
        y = x @ comps / devs - y_mean
        return (y.T @ y).ravel()

    cov = _sums(blocks, second, d, base - shift, rest).reshape(have, have) / n
    error = float(np.abs(cov - np.eye(have)).max())
    return Whitening(n, sums, base, rest, comps, devs, devs**2 / trace, error, v.shape[1])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal]:
    """The sum over dimensions of (n x - S)^2, exact: in 64 bits if the largest fits, else in Python's whole numbers."""
    d = x.shape[1]
    top = max((max(abs(n * int(hi) - s), abs(n * int(lo) - s)) for hi, lo, s in zip(x.max(axis=0), x.min(axis=0), sums)), default=0)
    reach = n * max(abs(int(x.max())), abs(int(x.min())))
    if top * top * d < 2**62 and reach < 2**62 and max(abs(s) for s in sums) < 2**62:
        a = x * np.int64(n) - np.array(sums, np.int64)
        return [Decimal(int(t)) for t in np.einsum("ij,ij->i", a, a)]
    return [Decimal(sum((n * int(c) - s) ** 2 for c, s in zip(row, sums))) for row in x]


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    shift: int = 1_000_000,
    wanted: int = 16,
) -> DataFrame:
    """One row for each vector and component: ``id_col`` and the columns of ``WHITENED``."""
    kind = vectors.schema[id_col].dataType
    kept = whole_vectors(
        vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("_v")), "_v", scale, shift
    ).select("_id", _KEPT)
    model = fit_whitening(kept, shift, wanted)
    out = f"_id {kind.simpleString()}, {WHITENED}"
    if model is None or model.components.shape[1] == 0:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("_id", id_col)
    names = ["_id", *[c.split()[0] for c in WHITENED.split(", ")]]

    def run(batches):
        k = model.components.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _matrix(part.column(1))
                m = len(x)
                y = ((x - model.base).astype(np.float64) - model.rest) @ model.components / model.deviations
                far = pa.array(_deviations(x, model.n, model.sums), pa.decimal128(38, 0))
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(again),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        far.take(again),
                        pa.array(y.ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=names,
                )

    return kept.mapInArrow(run, out).withColumnRenamed("_id", id_col)
