"""Queries of designs and model fits over the driver's tables.

Runs are the series of ``embeddings``; their events are those of ``events``
whose user's number ends alike, a regressor an event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import design as D, fit as L
from .registry import query, r, rs
from .tables import SERIES_SQL, series, table

TR, STEPS, NAMES = 2.0, 20, ("click", "view")
RESPONSE = D.double_gamma(TR, STEPS)


def event_vectors_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    onset = F.expr("unix_micros(cast(ts as timestamp)) div 1000") % 100_000
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("run"), F.col("event_type").alias("regressor"), (onset / 1000.0).alias("onset"), (F.least("value", F.lit(30.0)) / 10).alias("duration"), F.lit(1.0).alias("one"))


def runs_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("run")).agg(F.count("*").alias("frames"))


def design(spark: SparkSession, sf_dir: str, derivatives: bool = False) -> DataFrame:
    return D.design_matrix(event_vectors_of_runs(spark, sf_dir), runs_of_series(spark, sf_dir), TR, NAMES, RESPONSE, steps=STEPS, derivatives=derivatives)


#: The same by summing the response over every place of the grid on which an event is on.
_H = f"[{', '.join(repr(x) + '::DOUBLE' for x in RESPONSE)}]"
_K, _DT = len(RESPONSE), TR / STEPS
_at = lambda shift: f"CASE WHEN j + {shift} - i BETWEEN 0 AND {_K - 1} THEN h[(j + {shift} - i + 1)::INT] ELSE 0 END"
DESIGN_SQL = (
    "runs AS (SELECT label AS run, count(*) AS frames FROM embeddings GROUP BY label), "
    "ev AS (SELECT (user_id % 10)::INT AS run, event_type AS regressor, floor((((epoch_us(ts) // 1000) % 100000) / 1000.0::DOUBLE) / "
    f"{_DT}::DOUBLE + 0.5)::BIGINT AS i0, floor((((epoch_us(ts) // 1000) % 100000) / 1000.0::DOUBLE + least(value, 30.0::DOUBLE) / 10) / {_DT}::DOUBLE + 0.5)::BIGINT AS i1 FROM events WHERE event_type IN ('click', 'view')), "
    "grid AS (SELECT run, regressor, i, count(*)::DOUBLE AS n FROM (SELECT run, regressor, unnest(range(i0, greatest(i0 + 1, i1))) AS i FROM ev) GROUP BY ALL), "
    f"fr AS (SELECT run, t, t * {STEPS} AS j, {_H} AS h FROM (SELECT run, unnest(range(0, frames)) AS t FROM runs)), "
    f"reached AS (SELECT f.run, f.t, regressor, sum(n * {_at(0)}) AS value, sum(n * (({_at(1)}) - ({_at(-1)}))) / {2 * _DT}::DOUBLE AS slope FROM fr f JOIN grid g ON g.run = f.run AND g.i BETWEEN f.j - {_K} AND f.j + 1 GROUP BY ALL), "
    "design AS (SELECT f.run, f.t, " + ", ".join(f"coalesce(max(CASE WHEN regressor = '{n}' THEN value END), 0.0::DOUBLE) AS {n}, coalesce(max(CASE WHEN regressor = '{n}' THEN slope END), 0.0::DOUBLE) AS {n}_d" for n in NAMES) + " FROM fr f LEFT JOIN reached d ON d.run = f.run AND d.t = f.t GROUP BY f.run, f.t)"
)


@query(f"WITH {DESIGN_SQL} SELECT run, t, " + ", ".join(f"{rs(c)} AS {c}" for n in NAMES for c in (n, f"{n}_d")) + " FROM design")
def design_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design(spark, sf_dir, True).select("run", "t", *[r(c).alias(c) for n in NAMES for c in (n, f"{n}_d")])


CONTRASTS = {"click": (1.0, 0.0), "difference": (1.0, -1.0)}


def _tests(fitted: DataFrame) -> DataFrame:
    rows = L.contrasts(fitted, CONTRASTS, keep=("intercept", "beta", "rss"))
    one = lambda c: r(F.max(c))
    numbers = {"intercept": F.col("intercept"), "click": F.col("beta")[0], "view": F.col("beta")[1], "rss": F.col("rss")} | {f"t_{k}": F.when(F.col("contrast") == k, F.col("t")) for k in CONTRASTS}
    return rows.groupBy("run", F.col("voxel").cast("long").alias("voxel")).agg(*[one(c).alias(k) for k, c in numbers.items()], F.max("dof").alias("dof"))


#: Normal equations of two columns and a constant, from centred sums; ``one`` is what the constant has become.
_NORMAL_SQL = (
    "n AS (SELECT run, voxel, count(*) AS k, any_value(one) AS one, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(y) * count(*) AS yy, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_ FROM d GROUP BY run, voxel), "
    "s AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS click, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS view, aa * bb - ab * ab AS det FROM n), "
    "e AS (SELECT *, (my - click * ma - view * mb) / one AS intercept, yy - click * ay - view * by_ AS rss, k - 3 AS dof FROM s) "
    f"SELECT run, voxel, {rs('intercept')} AS intercept, {rs('click')} AS click, {rs('view')} AS view, {rs('rss')} AS rss, {rs('click / sqrt(rss / dof * bb / det)')} AS t_click, {rs('(click - view) / sqrt(rss / dof * (aa + bb + 2 * ab) / det)')} AS t_difference, dof FROM e"
)


@query(f"WITH {SERIES_SQL}, {DESIGN_SQL}, d AS (SELECT s.run, s.voxel, s.v AS y, g.click AS a, g.view AS b, 1.0::DOUBLE AS one FROM series s JOIN design g ON g.run = s.run AND g.t = s.t), {_NORMAL_SQL}")
def model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tests(L.fit(series(spark, sf_dir), design(spark, sf_dir), NAMES))


@query(
    f"WITH {SERIES_SQL}, {DESIGN_SQL}, c AS (SELECT s.run, s.voxel, s.t, s.v AS y, g.click AS a, g.view AS b FROM series s JOIN design g ON g.run = s.run AND g.t = s.t), "
    "m AS (SELECT run, voxel, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM c GROUP BY run, voxel), "
    "u AS (SELECT c.*, y - my - (bb * ay - ab * by_) / (aa * bb - ab * ab) * (a - ma) - (aa * by_ - ab * ay) / (aa * bb - ab * ab) * (b - mb) AS e FROM c JOIN m USING (run, voxel)), "
    "w AS (SELECT *, lag(e) OVER p AS e1, lag(y) OVER p AS y1, lag(a) OVER p AS a1, lag(b) OVER p AS b1 FROM u WINDOW p AS (PARTITION BY run, voxel ORDER BY t)), "
    "q AS (SELECT *, 0.5::DOUBLE * sum(e * e1) OVER (PARTITION BY run, voxel) / sum(e * e) OVER (PARTITION BY run, voxel) AS f FROM w), "
    f"d AS (SELECT run, voxel, y - f * y1 AS y, a - f * a1 AS a, b - f * b1 AS b, 1 - f AS one FROM q WHERE t > 0), {_NORMAL_SQL}"
)
def model_fit_prewhitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tests(L.fit_prewhitened(series(spark, sf_dir), design(spark, sf_dir), NAMES, order=1))
