"""Linear model of voxel courses: least squares, contrasts, prewhitening.

All courses of a run share its design, so they share its Gram matrix too.  What
differs by voxel are sums over frames: covariances with the columns, the
variance and the mean, which aggregate partially and stay exact for data far
from zero.  Models have an intercept; it isn't one of ``columns``.

A fit is a row a voxel: intercept, beta (array, in the order of the columns),
rss, dof and inverse (the inverse of the columns' matrix of centred sums, row by
row, which contrasts need).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

#: Part of the largest singular value below which a direction counts as none.
RANK = 1e-10


def _gram(columns: Sequence[str], over: W | None = None) -> list[Column]:
    """Centred sums of squares and products of the columns, upper triangle row by row."""
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n = on(F.count("*"))
    return [on(F.covar_pop(a, b)) * n for i, a in enumerate(columns) for b in columns[i:]]


def _inverses(upper: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(inverse, rank) of symmetric matrices given by their upper triangles, one a row; what they can't tell apart gets a pseudo-inverse."""
    full = np.zeros((len(upper), p, p))
    i, j = np.triu_indices(p)
    full[:, i, j] = upper
    full[:, j, i] = upper
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", full), 0.0))
    scale[scale == 0] = 1.0
    full = full / scale[:, :, None] / scale[:, None, :]  # columns of very different size
    rank = np.linalg.matrix_rank(full, tol=RANK, hermitian=True)
    return np.linalg.pinv(full, rcond=RANK, hermitian=True) / scale[:, :, None] / scale[:, None, :], rank


def _invert(p: int, at: int, kept: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upper = np.array(batch.column(at).to_pylist(), float).reshape(batch.num_rows, -1)
            inverse, rank = _inverses(upper, p)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), pa.array(list(inverse.reshape(batch.num_rows, -1)), pa.list_(pa.float64())), pa.array(rank.astype(np.int64))], names=[*kept, "inverse", "rank"])

    return run


def gram_inverses(design: DataFrame, columns: Sequence[str], by: Sequence[str] = ("run",)) -> DataFrame:
    """A row a run: frames, means of the columns, inverse of their centred sums, rank."""
    sums = design.groupBy(*by).agg(F.count("*").alias("frames"), F.array(*[F.avg(c) for c in columns]).alias("means"), F.array(*_gram(columns)).alias("upper"))
    kept = [*by, "frames", "means"]
    schema = ", ".join([f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in kept] + ["inverse array<double>", "rank long"])
    return sums.select(*kept, "upper").mapInArrow(_invert(len(columns), len(kept), kept), schema)


def _solve(inverse: Column, sxy: Sequence[Column]) -> list[Column]:
    p = len(sxy)
    return [sum((inverse[i * p + j] * sxy[j] for j in range(1, p)), inverse[i * p] * sxy[0]) for i in range(p)]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def fit(df: DataFrame, design: DataFrame, columns: Sequence[str], by: Sequence[str] = ("run",), t: str = "t", voxel: str = "voxel", v: str = "v") -> DataFrame:
    """Least squares of each voxel's course on its run's columns: intercept, beta, rss, dof, inverse.

    Frames that the design lacks are left out, which is how frames are
    censored.  A voxel that lacks a frame of the design, or has a null or NaN
    there, isn't fitted: its results are null.  Columns that can't be told
    apart share their effect, and dof counts what can.  One exchange by voxel,
    of partial sums; the design joins by frame.
    """
    rows = df.select(*by, t, voxel, F.when(~F.isnan(v), F.col(v)).alias("__v")).join(design.select(*by, t, *columns), [*by, t])
    sums = rows.groupBy(*by, voxel).agg(F.count("__v").alias("__n"), F.avg("__v").alias("__mean"), F.var_pop("__v").alias("__var"), *[F.covar_pop(c, "__v").alias(f"__s{i}") for i, c in enumerate(columns)])
    known = sums.join(gram_inverses(design, columns, by), list(by))
    n = F.col("frames")
    sxy = [F.col(f"__s{i}") * n for i in range(len(columns))]
    known = known.where("true").select(*by, voxel, "__n", "__mean", "frames", "means", "rank", "inverse", (F.col("__var") * n).alias("__yy"), F.array(*sxy).alias("__xy"), F.array(*_solve(F.col("inverse"), sxy)).alias("beta"))
    p = range(len(columns))
    beta, whole = [F.col("beta")[i] for i in p], F.col("__n") == n
    rss = F.greatest(F.col("__yy") - _dot(beta, [F.col("__xy")[i] for i in p]), F.lit(0.0))
    intercept = F.col("__mean") - _dot(beta, [F.col("means")[i] for i in p])
    return known.select(*by, voxel, *[F.when(whole, c).alias(k) for k, c in (("intercept", intercept), ("beta", F.col("beta")), ("rss", rss), ("dof", n - F.col("rank") - 1), ("inverse", F.col("inverse")))])


def contrasts(fitted: DataFrame, weights: Mapping[str, Sequence[float]], by: Sequence[str] = ("run",), voxel: str = "voxel", keep: Sequence[str] = ()) -> DataFrame:
    """A row a voxel and contrast: effect, its variance, t, z and dof; null where there is no fit or nothing is left over.

    ``weights`` gives each contrast a number for each column; columns of the
    fit that ``keep`` names stay.
    """
    rows = []
    for name, c in weights.items():
        p = len(c)
        used = [i for i in range(p) if c[i]]
        effect = sum((F.lit(float(c[i])) * F.col("beta")[i] for i in used), F.lit(0.0))
        spread = sum((F.lit(float(c[i] * c[j])) * F.col("inverse")[i * p + j] for i in used for j in used), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("contrast"), effect.alias("effect"), (F.try_divide(F.col("rss"), F.col("dof")) * spread).alias("variance")))
    each = fitted.select(*by, voxel, *keep, "dof", F.inline(F.array(*rows)))
    t = F.when(F.col("dof") > 0, F.try_divide(F.col("effect"), F.sqrt(F.nullif(F.col("variance"), F.lit(0.0)))))
    return each.withColumn("t", t).withColumn("z", F.when(F.col("t").isNotNull(), t_to_z(F.coalesce("t", F.lit(0.0)), F.coalesce("dof", F.lit(1)).cast("double"))))


# t to z


def _log_tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Logarithm of the chance of a value above t >= 0 under Student's distribution, by the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2, np.full(len(t), 0.5)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)
    near = x < (a + 1) / (a + b + 2)
    p, q, y = np.where(near, a, b), np.where(near, b, a), np.where(near, x, 1 - x)
    tiny = 1e-300
    c, d = np.ones(len(t)), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        log_part = front + np.log(out) - np.log(p)
        whole = np.where(near, log_part, np.log1p(-np.exp(np.minimum(log_part, 0.0))))
    return np.where(t == 0, math.log(0.5), whole - math.log(2))


def _log_upper(z: np.ndarray) -> np.ndarray:
    """Logarithm of the chance of a normal value above z."""
    with np.errstate(divide="ignore"):
        plain = np.log(0.5 * np.vectorize(math.erfc, otypes=[float])(z / math.sqrt(2)))
        far = -z * z / 2 - np.log(np.maximum(z, 1.0)) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / np.maximum(z, 1.0) ** 2)
    return np.where(z > 30, far, plain)


def z_of(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Normal values as unlikely as t with dof degrees of freedom; exact in the tails too."""
    want = _log_tail(np.abs(t), dof)
    z = np.sqrt(np.maximum(-2 * (want + math.log(2)), 0.0))
    for _ in range(60):  # Newton steps on the logarithm, which is concave
        now = _log_upper(z)
        hazard = np.exp(-z * z / 2 - 0.5 * math.log(2 * math.pi) - now)
        step = (now - want) / hazard
        z = np.maximum(z + step, 0.0)
        if (np.abs(step) < 1e-12 * (1 + z)).all():
            break
    return np.sign(t) * z


@F.pandas_udf(DoubleType())
def t_to_z(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(z_of(t.to_numpy(float), np.maximum(dof.to_numpy(float), 1.0)))


# prewhitening


def autocorrelations(rows: DataFrame, order: int, by: Sequence[str], t: str = "t", value: str = "__r") -> DataFrame:
    """``rows`` plus __a1 to __a<order>: the tapered autocorrelations of ``value`` over a voxel's course, 0 where it has no spread.

    A lag k of M = order + 1 is weighted with (1 + cos(pi * k / M)) / 2.  Shares the exchange by voxel.
    """
    course, along = W.partitionBy(*by), W.partitionBy(*by).orderBy(t)
    rows = rows.withColumns({f"__l{k}": F.lag(value, k).over(along) for k in range(1, order + 1)})
    power = F.sum(F.col(value) * F.col(value)).over(course)
    taper = lambda k: F.lit(0.5 * (1 + math.cos(math.pi * k / (order + 1))))
    found = {f"__a{k}": taper(k) * F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(f"__l{k}")).over(course), power), F.lit(0.0)) for k in range(1, order + 1)}
    return rows.withColumns(found).drop(*[f"__l{k}" for k in range(1, order + 1)])


def _levinson(rows: DataFrame, order: int) -> DataFrame:
    """``rows`` plus __c1 to __c<order>: the coefficients of the autoregression with the autocorrelations __a1 ..."""
    rows = rows.withColumns({"__k1_1": F.col("__a1"), "__e1": F.lit(1.0) - F.col("__a1") * F.col("__a1")})
    for m in range(2, order + 1):
        past = _dot([F.col(f"__k{m - 1}_{i}") for i in range(1, m)], [F.col(f"__a{m - i}") for i in range(1, m)])
        rows = rows.withColumn(f"__k{m}_{m}", F.coalesce(F.try_divide(F.col(f"__a{m}") - past, F.col(f"__e{m - 1}")), F.lit(0.0)))
        last = F.col(f"__k{m}_{m}")
        rows = rows.withColumns({f"__k{m}_{i}": F.col(f"__k{m - 1}_{i}") - last * F.col(f"__k{m - 1}_{m - i}") for i in range(1, m)} | {f"__e{m}": F.col(f"__e{m - 1}") * (F.lit(1.0) - last * last)})
    return rows.withColumns({f"__c{i}": F.col(f"__k{order}_{i}") for i in range(1, order + 1)}).drop(*[f"__k{m}_{i}" for m in range(1, order + 1) for i in range(1, m + 1)], *[f"__e{m}" for m in range(1, order + 1)])


def fit_prewhitened(df: DataFrame, design: DataFrame, columns: Sequence[str], order: int = 3, by: Sequence[str] = ("run",), t: str = "t", voxel: str = "voxel", v: str = "v") -> DataFrame:
    """``fit`` twice: the residuals of the first give each voxel an autoregression of ``order``, which filters data and columns for the second.

    The second fit leaves out the first ``order`` frames, which lack what the
    filter needs; its intercept is that of the unfiltered data.  Each voxel has
    a matrix of its own there.  Windows over a voxel's course do all of it: the
    design joins by frame, with its run's inverse at hand, and one exchange by
    voxel serves both passes.  Voxels that lack frames aren't fitted.
    """
    p, course, along = len(columns), W.partitionBy(*by, voxel), W.partitionBy(*by, voxel).orderBy(t)
    told = design.select(*by, t, *columns).join(gram_inverses(design, columns, by), list(by))
    rows = df.select(*by, t, voxel, F.when(~F.isnan(v), F.col(v)).alias("__v")).join(told, [*by, t])
    rows = rows.withColumns({"__n": F.count("__v").over(course), "__m": F.avg("__v").over(course)} | {f"__s{i}": F.covar_pop(c, "__v").over(course) * F.col("frames") for i, c in enumerate(columns)})
    slopes = _solve(F.col("inverse"), [F.col(f"__s{i}") for i in range(p)])
    centred = [F.col(c) - F.col("means")[i] for i, c in enumerate(columns)]
    rows = rows.withColumn("__r", F.col("__v") - F.col("__m") - _dot(slopes, centred)).drop(*[f"__s{i}" for i in range(p)], "inverse", "means", "rank")
    rows = _levinson(autocorrelations(rows, order, [*by, voxel], t), order)
    filtered = lambda c: F.col(c) - sum((F.col(f"__c{k}") * F.lag(c, k).over(along) for k in range(2, order + 1)), F.col("__c1") * F.lag(c, 1).over(along))
    rows = rows.withColumns({f"__f{i}": filtered(c) for i, c in enumerate(["__v", *columns])} | {"__place": F.row_number().over(along), "__one": F.lit(1.0) - sum((F.col(f"__c{k}") for k in range(2, order + 1)), F.col("__c1"))})
    x = [f"__f{i + 1}" for i in range(p)]
    sums = rows.where(F.col("__place") > order).groupBy(*by, voxel).agg(
        F.first("frames").alias("frames"), F.first("__n").alias("__n"), F.count("*").alias("__k"), F.first("__one").alias("__one"), F.avg("__f0").alias("__mean"), (F.var_pop("__f0") * F.count("*")).alias("__yy"),
        F.array(*[F.avg(c) for c in x]).alias("means"), F.array(*[F.covar_pop(c, "__f0") * F.count("*") for c in x]).alias("__xy"), F.array(*_gram(x)).alias("upper"),
    )
    sums = sums.where("__n = frames")
    kept = [*by, voxel, "__k", "__one", "__mean", "__yy", "means", "__xy"]
    schema = ", ".join([f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in kept] + ["inverse array<double>", "rank long"])
    solved = sums.select(*kept, "upper").mapInArrow(_invert(p, len(kept), kept), schema)
    xy = [F.col("__xy")[i] for i in range(p)]
    solved = solved.withColumn("beta", F.array(*_solve(F.col("inverse"), xy)))
    beta = [F.col("beta")[i] for i in range(p)]
    rss = F.greatest(F.col("__yy") - _dot(beta, xy), F.lit(0.0))
    intercept = F.try_divide(F.col("__mean") - _dot(beta, [F.col("means")[i] for i in range(p)]), F.col("__one"))
    return solved.select(*by, voxel, intercept.alias("intercept"), "beta", rss.alias("rss"), (F.col("__k") - F.col("rank") - 1).alias("dof"), "inverse")
