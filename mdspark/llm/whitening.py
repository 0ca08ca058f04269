"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Every entry c becomes the whole number x = floor(64 * c) + 1000000. The covariance V is that of the fit list, each
distinct x vector once, with divisor n. V is never formed: a pass over the fit list gives V times a block of vectors
(X'(XQ) of centred rows, summed by tasks), and only such products reach the driver. A block of twice the wanted
vectors is filtered by a Chebyshev polynomial in V that is small over the unwanted part of the spectrum (from a
lower bound by a few Lanczos steps to the smallest Ritz value), made orthonormal (QR) and turned to its Ritz vectors.
Rounds end when the residuals |Vq - eq| certify every wanted pair and do not shrink any more. A block that does
not get there is doubled; as wide as the vectors, it spans everything and its Ritz pairs are exact.

Rows are centred before they are multiplied, as (n * x - S) / n with whole n * x - S, so that the large shift costs
no digits. The polynomial's degree is chosen so that the largest eigenvalue is not amplified beyond the others'
digits.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part; vectors of different
lengths have no common covariance, so each length is whitened by itself; repeated rows are fitted once and each
returned, as are rows that repeat an id or have none; entries beyond 2^60 after scaling count as that; components
whose eigenvalue is zero (below 1e-13 of the largest) do not exist, so a fit list of one vector gives no rows;
a deviation beyond a long is null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Highest degree of a filter, Lanczos steps, digits by which a filter may amplify the first vector more than the last wanted one.
DEGREE, LANCZOS, DIGITS = 12, 12, 8
#: Residuals that certify, as a share of the largest eigenvalue; rounds after which a block that has not got there is doubled.
CERTIFIED, PATIENCE = 1e-12, 12
#: Share of the largest eigenvalue below which one is zero; entries count as this much at most, after scaling.
ZERO, LARGEST = 1e-13, float(1 << 60)
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def shifted(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>) of the rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    scaled = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * SCALE))
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    return own.select("vec_id", F.transform("v", lambda c: F.floor(scaled(c)).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in whole numbers: 64-bit ones where they hold it, else Python's."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (differences(x, n, sums) / n).astype(np.float64)


def deviations(d: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers, null beyond a long."""
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


def totals(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and S, in whole numbers. Tasks send a sum for each dimension, which are added by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dim, object)
        for b in batches:
            x = matrix(b.column(0), dim)
            safe = int(np.abs(x).max(initial=0)) * max(1, len(x)) < 1 << 62
            s = s + (x.sum(0) if safe else x.astype(object).sum(0)).astype(object)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"s": [[str(n), *map(str, s)]]})

    each = fit.mapInArrow(run, "s array<string>").select(F.posexplode("s").alias("at", "v"))
    found = {r.at: int(r.v) for r in each.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return (found[0], [found[i + 1] for i in range(dim)]) if found else (0, [])


def summed(fit: DataFrame, dim: int, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of what `of` gives for blocks of its rows; one array for each task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for b in batches:
            if b.num_rows:
                total += of(matrix(b.column(0), dim))
                some = True
        if some:
            yield pa.RecordBatch.from_pydict({"y": [total.ravel()]})

    each = fit.mapInArrow(run, "y array<double>").select(F.posexplode("y").alias("at", "v"))
    out = np.zeros(int(np.prod(shape)))
    for r in each.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out.reshape(shape)


def lower_bound(product: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int) -> float:
    """A lower bound of the spectrum, 0 at least: the smallest Ritz value of a few Lanczos steps less the last residual."""
    q = [start / np.linalg.norm(start)]
    alpha: list[float] = []
    beta: list[float] = []
    for _ in range(steps):
        r = product(q[-1][:, None])[:, 0]
        alpha.append(float(q[-1] @ r))
        for _ in range(2):  # orthogonal to all before, twice for the digits
            r = r - np.stack(q, 1) @ (np.stack(q) @ r)
        beta.append(float(np.linalg.norm(r)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        q.append(r / beta[-1])
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beta[-1])


def filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, w: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A scaled Chebyshev polynomial in V, small on [low, high], applied to q; w = Vq is the recurrence's first pass."""
    half, mid = (high - low) / 2, (high + low) / 2
    first = half / (top - mid)
    sigma, before, now = first, q, (w - mid * q) * (first / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        before, now = now, (product(now) - mid * now) * (2 * new / half) - sigma * new * before
        sigma = new
    return now


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the want largest, certified by their residuals."""
    draw = np.random.default_rng(12)
    width, want = min(dim, 2 * want), min(dim, want)
    low = lower_bound(product, draw.standard_normal(dim), LANCZOS) if width < dim else 0.0
    q = np.linalg.qr(draw.standard_normal((dim, width)))[0]
    w = product(q)
    rounds, last = 0, np.inf
    while True:
        h = q.T @ w
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, w = q @ u, w @ u
        worst = float(np.linalg.norm(w - q * e, axis=0)[:want].max())
        if width == dim or worst <= CERTIFIED * e[0] and not worst < last / 2:
            return e[:want], q[:, :want]
        rounds, last = rounds + 1, worst
        if rounds % PATIENCE == 0 and worst > CERTIFIED * e[0]:
            width = min(dim, 2 * width)
            q = np.linalg.qr(np.concatenate([q, draw.standard_normal((dim, width - q.shape[1]))], axis=1))[0]
        else:
            high = max(float(e[-1]), 1e-9 * float(e[0]))
            floor = low if low < high else 0.0
            at = lambda x: float(np.arccosh(max(1.0, (2 * x - floor - high) / (high - floor))))
            room = at(e[0]) - at(e[want - 1])
            degree = DEGREE if room * DEGREE <= DIGITS * np.log(10) else max(1, int(DIGITS * np.log(10) / room))
            q = np.linalg.qr(filtered(product, q, w, floor, high, max(float(e[0]), high * (1 + 1e-9)), degree))[0]
        w = product(q)


def fit_components(x: DataFrame, dim: int, want: int) -> tuple[int, list[int], np.ndarray, np.ndarray, float, float]:
    """(n, S, e, vectors, trace of V, identity error) of rows (vec_id, x) of one length."""
    fit = common.materialize(x.select("x").distinct(), "fit")
    n, sums = totals(fit, dim)
    square = lambda c: (c * c).sum()[None]
    trace = float(summed(fit, dim, (1,), lambda v: square(centred(v, n, sums)))[0]) / n

    def product(q: np.ndarray) -> np.ndarray:
        def of(v: np.ndarray) -> np.ndarray:
            c = centred(v, n, sums)
            return c.T @ (c @ q)

        return summed(fit, dim, q.shape, of) / n

    if not trace > 0:
        return n, sums, np.zeros(0), np.zeros((dim, 0)), trace, 0.0
    e, u = leading(product, dim, want)
    kept = e > ZERO * e[0]
    e, u = e[kept], u[:, kept]
    turn = u / np.sqrt(e)

    def moments(v: np.ndarray) -> np.ndarray:
        c = centred(v, n, sums) @ turn
        return c.T @ c

    error = float(np.abs(summed(fit, dim, (len(e), len(e)), moments) / n - np.eye(len(e))).max())
    return n, sums, e, u, trace, error


def whiten(df: DataFrame, want: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """SCHEMA, a row for each row and component; components count from 1 by falling eigenvalue."""
    rows = shifted(df, id_col, vec_col)
    out = df.sparkSession.createDataFrame([], SCHEMA)
    for r in rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        own, dim = rows.where(F.size("x") == r.dim), r.dim
        n, sums, e, u, trace, error = fit_components(own, dim, want)
        turn, share, k = u / np.sqrt(e), e / trace if len(e) else e, len(e)

        def run(batches: Iterator[pa.RecordBatch], dim=dim, n=n, sums=sums, turn=turn, share=share, k=k, error=error) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = differences(matrix(b.column(1), dim), n, sums)
                w = (d / n).astype(np.float64) @ turn
                at = np.repeat(np.arange(len(w)), k)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(at), n)),
                    pa.array(deviations(d), pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(share, len(w))), pa.array(np.full(len(at), error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        if k:
            out = out.unionByName(own.mapInArrow(run, SCHEMA))
    return out


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
