"""Anomaly scores of each time: prediction error P times deviations of edge strengths (C) and weights (G) from references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Query, each, sql
from .prior import DUCK as _DUCK
from .prior import fill

COMBINE = "select $k, t, p_mean as p, c_mean as c, g, <ALPHA> * c_mean + <BETA> * g as s, p_mean * (<ALPHA> * c_mean + <BETA> * g) as a from {error} e join (select $k, t, c_mean from {deviation}) d using ($k, t) join (select $k, t, c_mean as g from {weights}) h using ($k, t)"
#: Centre (median) and scale (1.4826 times the median deviation; else the deviation; else 1) of x over the rows that fit.
ROBUST = {
    "m": "select $k, <MED:x> as centre, stddev_pop(x) as sd from {values} where <FIT> group by $k",
    "d": "select $k, abs(x - centre) as x, centre, sd from {values} v join {m} m using ($k) where <FIT>",
    "s": "select $k, max(centre) as centre, max(sd) as sd, 1.4826e0 * <MED:x> as mad from {d} d group by $k",
    "result": "select $k, centre, case when mad >= 1e-6 then mad when sd >= 1e-6 then sd else 1e0 end as scale from {s} s",
}
ROBUST_Z = "select $k, t, greatest((x - centre) / greatest(scale, 1e-6), <CLIP>) as z from {values} v join {robust} r using ($k)"
TIMELINE = "select $k, t, s.score as score from {times} q left join (select $k, win + <L> - 1 as t, score from {windows}) s using ($k, t)"
THREE_SIGMA = "select $k, t, score > avg(score) over (partition by $k) + 3e0 * stddev_pop(score) over (partition by $k) as above from {scores}"
#: The second form: at or above mean and deviation of the rows that <FIT>.
THREE_SIGMA_OF = "select $k, t, score >= mu + 3e0 * sd as above from {scores} s join (select $k, avg(score) as mu, stddev_pop(score) as sd from {scores} where <FIT> group by $k) f using ($k)"
#: Scores of a moving window of <W> rows set at its middle, the ends 0.
PADDED = "select $k, t, coalesce(s.score, 0e0) as score from {times} q left join (select $k, t + cast(ceil(<W> / 2e0) as int) as t, score from {scores}) s using ($k, t)"


def filled(template: Query, by: list[str], duck: bool = False, **values: object) -> Query:
    median = "quantile_cont(x, 0.5)" if duck else "percentile(x, 0.5)"
    return fill(each(template, lambda t: t.replace("<MED:x>", median)), by, _DUCK if duck else {}, **values)


def run(template: Query, by: list[str], frames: dict[str, DataFrame], **values: object) -> DataFrame:
    return sql(filled(template, by, **values), **frames)


#: The components that are calibrated, by number.
COMPONENTS = ("p", "c", "g")


def calibrators(raw: DataFrame, by: list[str], fit: str) -> DataFrame:
    """(by, component, centre, scale): robust centre and scale of each raw component of each run over the rows that `fit`; component is its place in COMPONENTS."""
    each = ", ".join(f"named_struct('component', {i}, 'x', {c})" for i, c in enumerate(COMPONENTS))
    long = raw.selectExpr(*by, "t", f"inline(array({each}))")
    return run(ROBUST, [*by, "component"], {"values": long.where("x is not null")}, FIT=fit)


def calibrated(raw: DataFrame, found: DataFrame, by: list[str], alpha: float = 1.0, beta: float = 1.0, least: float = 0.0) -> DataFrame:
    """(by, t, p, c, g, s, a): each component by its calibrator, at least `least`; then s = alpha c + beta g and a = p s."""
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("component") == i, F.col(x))).alias(f"_{x}_{c}") for i, c in enumerate(COMPONENTS) for x in ("centre", "scale")])
    z = raw.join(wide, by).select(*by, "t", *[F.greatest((F.col(c) - F.col(f"_centre_{c}")) / F.greatest(F.col(f"_scale_{c}"), F.lit(1e-6)), F.lit(least)).alias(c) for c in COMPONENTS])
    s = alpha * F.col("c") + beta * F.col("g")
    return z.withColumn("s", s).withColumn("a", F.col("p") * F.col("s"))
