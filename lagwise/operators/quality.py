"""How well scores (by, t, y, score) find labelled anomalies; every metric for all series of `by` at once.

Entity, component, seed or epoch are keys in `by`. A sweep's 100 thresholds lie evenly between a series' least and
largest score and a point is predicted if its score is larger. A point's level is the number of thresholds below it. No
metric copies points by threshold: sums over points are counts by level, added up; segments come with the range of
thresholds in which they live (levels.py); and a zone's integrals are sums over its points and over its gaps. No window
covers a whole series: places and running sums are scans over blocks (blocks.py). A series without a positive label has
NULL metrics. In the texts $k stands for the keys, {name} for a table; they hold for Spark SQL and for other engines.
"""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import Query, each, scratch, sql
from . import blocks, segments
from .ingest import finite
from .levels import THRESHOLDS, levels


def text(template: Query, by: list[str]) -> Query:
    return each(template, lambda t: Template(t).substitute(k=", ".join(by)))


def ranked(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """(by, score, p, n, cp, cn, tp, tn): each different score's positives and others, those at or above it, and all."""
    given = scores.where("score is not null").groupBy(*by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    cut = blocks.by_value(given, by, "score", size)
    return blocks.running(cut, by, [F.col("score").desc()], {"cp": F.col("p"), "cn": F.col("n")}, {"tp": "cp", "tn": "cn"})


RANK = """
select $k, sum(n * (cp - p + p / 2e0)) / nullif(max(tp) * max(tn) * 1e0, 0e0) as auc_roc,
       case when max(tp) > 0 then sum(p * (cp / (cp + cn + 0e0))) / max(tp * 1e0) end as auc_pr,
       case when max(tp) > 0 then max(2e0 * (cp / (cp + cn + 0e0)) * (cp / nullif(tp, 0)) / (cp / (cp + cn + 0e0) + cp / nullif(tp, 0) + 1e-5)) end as f1
from {ranked} group by $k"""

#: The number of the thresholds lo, lo + st, ..., hi that lie below a score.
_LEVEL = """cast(greatest(coalesce(j, 0) - 1, 0) + case when j between 1 and 100 and score > lo + (j - 1) * st then 1 else 0 end
 + case when j between 0 and 99 and score > case when j = 99 then hi else lo + j * st end then 1 else 0 end
 + case when j between 0 and 98 and score > case when j = 98 then hi else lo + (j + 1) * st end then 1 else 0 end as int)"""


def places(rows: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """Adds i, the place in the series from 0; seg, which names the run of labels that holds the point; n and pos, the points and positives."""
    given = blocks.by_time(rows, "t", size)
    out = blocks.running(given, by, [F.col("t")], {"i": F.lit(1).cast("long"), "_normal": 1 - F.col("y"), "_pos": F.col("y")}, {"n": "i", "pos": "_pos"})
    return out.withColumns({"i": F.col("i") - 1, "seg": F.when(F.col("y") > 0, F.col("_normal"))}).drop(blocks.BLOCK, "_normal", "_pos")


def points(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """(by, t, i, y, score, seg, n, nb): the points with a score; nb is their level."""
    given = scores.where("score is not null").select(*by, "t", "y", "score")
    ends = given.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    placed = places(given, by, size).join(ends, by).withColumn("st", F.expr("(hi - lo) / 99e0"))
    placed = placed.withColumn("j", F.expr("cast(floor((score - lo) / nullif(st, 0e0)) as bigint)"))
    return placed.select(*by, "t", "i", "y", "score", "seg", "n", F.expr(_LEVEL).alias("nb"))


def predicted_points(preds: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """Points of given predictions instead of a sweep: those with pred 1 are predicted at threshold 0, none above it."""
    return places(preds.select(*by, "t", "y", "pred"), by, size).select(*by, "t", "i", "y", "seg", "n", F.col("pred").cast("int").alias("nb"))


def at_thresholds(changes: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, th, columns) for each threshold from the changes at it: what a change adds holds from its threshold down."""
    grid = changes.select(*by).distinct().withColumn("th", F.explode(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1))))
    summed = changes.where(F.col("th") >= 0).groupBy(*by, "th").agg(*[F.sum(c).alias(c) for c in columns])
    down = Window.partitionBy(*by).orderBy(F.col("th").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(summed, [*by, "th"], "left")
    return out.select(*by, "th", *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(c) for c in columns])


#: Counts at each threshold th: tp, fp points; tpa points after adjustment; hits and segments; positives.
_SEGMENTS = "select $k, seg, min(i) as s, count(*) as len, max(nb) as top, max(case when i = 0 then nb end) as nb0 from {points} where y > 0 group by $k, seg"
_CHANGES = """
select $k, nb - 1 as th, sum(y) as tp, sum(1 - y) as fp, 0 as tpa, 0 as hits from {points} group by $k, nb
union all select $k, top - 1 as th, 0, 0, len, 1 from {segments}
union all select $k, top - 1 as th, 0, 0, -1, 0 from {segments} where s = 0
union all select $k, nb0 - 1 as th, 0, 0, 1, 0 from {segments} where s = 0"""
ADJUSTED = "select $k, max(2e0 * tpa / (tpa + pos + fp)) as pa_f1 from {sweep} group by $k"
EVENT = """
select $k, max(2e0 * (hits / (n_seg * 1e0)) * coalesce(tp / nullif(tp + fp + 0e0, 0e0), 0e0) / (hits / (n_seg * 1e0) + coalesce(tp / nullif(tp + fp + 0e0, 0e0), 0e0) + 1e-15)) as event_f1
from {sweep} group by $k"""
RANGE_F = "select $k, max(case when r_recall + r_precision > 0 then 2e0 * r_recall * r_precision / (r_recall + r_precision) else 0e0 end) as r_f from {ranges} group by $k"


def _outside(a: str, b: str) -> str:
    """Integral of the precision probability over the piece [a, b], which lies beside the event."""
    near, far = f"greatest({a} - je, js - {b})", f"greatest({b} - je, js - {a})"
    m = "least(js - e0, e1 - je)"
    quarter = f"(power(least({far}, {m}), 2) - power(least({near}, {m}), 2)) / 2e0 + {m} * (greatest({far}, {m}) - greatest({near}, {m}))"
    return f"case when {b} > {a} then ({b} - {a}) - ({quarter} + (power({far}, 2) - power({near}, 2)) / 2e0 + (je - js) * ({b} - {a})) / (e1 - e0) else 0e0 end"


def _recall(a: str, b: str, p: str, right: bool) -> str:
    """Integral of the recall probability over [a, b] of an event beside a prediction whose nearest border is p."""

    def part(lo: str, hi: str, weight: str) -> str:
        x, y = f"greatest({a}, {lo})", f"least({b}, {hi})"
        return f"case when {y} > {x} then {weight.format(d=f'({y} - {x})', q=f'({y} * {y} - {x} * {x})')} else 0e0 end"

    mid, left, back = "((e0 + e1) / 2e0)", f"((e0 + {p}) / 2e0)", f"((e1 + {p}) / 2e0)"
    near = f"2e0 * {p} * {{d}} - {{q}}" if right else f"{{q}} - 2e0 * {p} * {{d}}"
    first = f"({p} - e0) * {{d}}" if right else f"{{q}} - (e0 + {p}) * {{d}}"
    last = f"(e1 + {p}) * {{d}} - {{q}}" if right else f"(e1 - {p}) * {{d}}"
    parts = [part("e0", f"least({mid}, {left})", first), part(left, mid, near), part(mid, back, near), part(f"greatest({mid}, {back})", "e1", last)]
    return f"case when {b} > {a} and {p} > e0 and {p} < e1 then ({b} - {a}) - ({' + '.join(parts)}) / (e1 - e0) else 0e0 end"


AFFILIATION = "select $k, th, avg(precision_p) as aff_precision, sum(recall_p) / max(zones * 1e0) as aff_recall from {values} join (select $k, count(*) as zones from {zones} group by $k) z using ($k) group by $k, th"
AFFILIATION_F = "select $k, max(2e0 * aff_precision * aff_recall / (aff_precision + aff_recall + 1e-15)) as aff_f from {affiliation} group by $k"

#: Volume under the surface: range AUC and AP, averaged over margins w = 0..W, at K rank thresholds.
VUS = {
    "pts": "select $k, i, y, n, pos, seg, cast(ceil(f * (<K> - 1e0) / (n - 1e0) - 1e-9) as bigint) as k0 from {placed} where pos > 0",
    "tot": "select $k, max(n) as n, max(pos) as pos from {pts} pts group by $k",
    "sg": "select $k, seg, min(i) as s, max(i) as e, min(k0) as m0 from {pts} pts where y > 0 group by $k, seg",
    "mg": "select $k, seg, d, i from (select $k, seg, d, e + d as i from {sg} sg cross join range(1, <W> / 2 + 1) r(d) union all select $k, seg, d, s - d from {sg} sg cross join range(1, <W> / 2 + 1) r(d)) u",
    "mp": "select $k, m.seg as seg, d, i, k0, p.y as y from {mg} m join (select $k, i, k0, y from {pts} pts) p using ($k, i)",
    "ws": "select $k, w from {windows} cross join range(<W> + 1) r(w) where w <= win",
    "lb": "select $k, w, i, k0, least(1e0, sum(sqrt(1 - d / (w * 1e0)))) as soft from {mp} mp join {ws} ws using ($k) where 2 * d <= w and y = 0 group by $k, w, i, k0",
    "sl": "select $k, w, k0, sum(soft) as soft from {lb} lb group by $k, w, k0",
    "hp": "select $k, k0, count(*) as n_pred, sum(y) as p_in from {pts} pts group by $k, k0",
    "mm": "select $k, seg, w, min(k0) as mk from {mp} mp join {ws} ws using ($k) where 2 * d <= w group by $k, seg, w",
    "sw": "select $k, seg, w, s, e, m0 from {sg} sg join {ws} ws using ($k)",
    "sm": "select $k, seg, w, s, e, least(m0, coalesce(mk, m0)) as mk, case when lag(e) over (partition by $k, w order by s) + floor(w / 2e0) < s - floor(w / 2e0) then 1 else 0 end as cut from {sw} sw left join {mm} mm using ($k, seg, w)",
    "sc": "select $k, w, mk, sum(cut) over (partition by $k, w order by s) as grp from {sm} sm",
    "me": "select $k, w, grp, min(mk) as mk from {sc} sc group by $k, w, grp",
    "mc": "select $k, w, mk as k0, count(*) as m from {me} me group by $k, w, mk",
    "mt": "select $k, w, count(*) as merged from {me} me group by $k, w",
    "gr": "select $k, w, n, pos, q as k0 from {tot} tot join {ws} ws using ($k) cross join range(<K>) r(q)",
    "al": "select $k, w, n, pos, k0, sum(coalesce(n_pred, 0)) over v as npred, sum(coalesce(p_in, 0)) over v as tp_in, sum(coalesce(soft, 0e0)) over v as tp_out, sum(coalesce(m, 0)) over v as found from {gr} gr left join {hp} hp using ($k, k0) left join {sl} sl using ($k, w, k0) left join {mc} mc using ($k, w, k0) window v as (partition by $k, w order by k0)",
    "rt": "select $k, w, k0, least((tp_in + tp_out) / ((pos + pos + tp_out) / 2e0), 1e0) * found / merged as tpr, (npred - tp_in - tp_out) / (n - (pos + pos + tp_out) / 2e0) as fpr, (tp_in + tp_out) / npred as prec from {al} al join {mt} mt using ($k, w)",
    "st": "select $k, w, k0, tpr, fpr, prec, coalesce(lag(tpr) over (partition by $k, w order by k0), 0e0) as tpr0, coalesce(lag(fpr) over (partition by $k, w order by k0), 0e0) as fpr0 from {rt} rt",
    "pw": "select $k, w, sum((fpr - fpr0) * (tpr + tpr0) / 2e0) + max(case when k0 = <K> - 1 then (1e0 - fpr) * (1e0 + tpr) / 2e0 end) as auc, sum((tpr - tpr0) * prec) as ap from {st} st group by $k, w",
}
VUS_MEAN = {**VUS, "result": "select $k, avg(auc) as vus_roc, avg(ap) as vus_pr from {pw} group by $k"}
VUS_AT = {**VUS, "result": "select $k, w, auc, ap from {pw}"}
#: The same for given predictions: precision, recall and F over margins 0..W; each margin starts from the true labels.
VUS_PRED = {
    "pts": "select $k, i, y, pred, pos, seg from {placed} where pos > 0",
    "tot": "select $k, max(pos) as pos, sum(pred) as n_pred, sum(y * pred) as tp_in from {pts} pts group by $k",
    "sg": "select $k, seg, min(i) as s, max(i) as e from {pts} pts where y > 0 group by $k, seg",
    "ws": "select w from range(<W> + 1) r(w)",
    "mg": "select $k, seg, d, i from (select $k, seg, d, e + d as i from {sg} sg cross join range(1, <W> / 2 + 1) r(d) union all select $k, seg, d, s - d from {sg} sg cross join range(1, <W> / 2 + 1) r(d)) u",
    "lb": "select $k, w, i, least(1e0, sum(sqrt(1 - d / (w * 1e0)))) as soft from {mg} mg join (select $k, i, pred, y from {pts} pts where y = 0 and pred = 1) p using ($k, i) join {ws} ws on 2 * d <= w group by $k, w, i",
    "sl": "select $k, w, sum(soft) as soft from {lb} lb group by $k, w",
    "al": "select $k, w, least((tp_in + coalesce(soft, 0e0)) / ((pos + pos + coalesce(soft, 0e0)) / 2e0), 1e0) as r, coalesce((tp_in + coalesce(soft, 0e0)) / nullif(n_pred * 1e0, 0e0), 0e0) as p from {tot} tot cross join {ws} ws left join {sl} sl using ($k, w)",
    "result": "select $k, avg(r) as vus_recall, avg(p) as vus_precision, avg(case when p + r > 0 then 2e0 * p * r / (p + r) else 0e0 end) as vus_f from {al} al group by $k",
}


def _vus(template: Query, by: list[str], window: int, thresholds: int = 250) -> Query:
    return text(each(template, lambda t: t.replace("<W> / 2", str(window // 2)).replace("<W>", str(window)).replace("<K>", str(thresholds))), by)


def rank_metrics(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """auc_roc (ties count half), auc_pr (average precision) and f1 (the best over all thresholds)."""
    return sql(text(RANK, by), ranked=ranked(scores, by, size))


def sweep(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """(by, th, tp, fp, tpa, hits, n_seg, pos): counts at each threshold, of series with a positive label."""
    pts = scratch(points(scores, by, size))
    seg = sql(text(_SEGMENTS, by), points=pts)
    sums = seg.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seg"), F.sum("len").alias("pos"))
    counts = at_thresholds(sql(text(_CHANGES, by), points=pts, segments=seg), by, ["tp", "fp", "tpa", "hits"])
    return counts.join(sums, by)


def adjusted_f1(scores: DataFrame, by: list[str]) -> DataFrame:
    """The best F1 after whole segments count as found by one hit (but for a first point of the series, which keeps its own)."""
    return sql(text(ADJUSTED, by), sweep=sweep(scores, by))


def event_f1(scores: DataFrame, by: list[str]) -> DataFrame:
    """The best F of segment recall and point precision."""
    return sql(text(EVENT, by), sweep=sweep(scores, by))


def adjust(preds: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """One threshold: points predicted by `pred` (0/1) instead of a sweep; a hit segment is predicted whole, `filled` up to its first hit."""
    placed = places(preds.select(*by, "t", "y", "pred"), by, size)
    seg = placed.where("y > 0").groupBy(*by, "seg").agg(F.max("pred").alias("hit"), F.min(F.when(F.col("pred") > 0, F.col("i"))).alias("first_hit"), F.min("i").alias("s"))
    found = placed.join(seg, [*by, "seg"], "left")
    hit = "y > 0 and hit > 0 and i > 0"
    return found.selectExpr(*by, "t", "y", f"case when {hit} then 1 else pred end as adjusted", f"case when {hit} and i < first_hit then 1 else 0 end as filled", f"case when {hit} and i = s then 1 else 0 end as event")


def range_scores(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """Range recall (a fifth for existence) and precision at each threshold with predictions.

    A predicted segment's precision holds for the thresholds in which it lives. A true segment's hits and predicted
    pieces change only at its points' levels: at a point's level a hit comes, and a piece where the point before is lower.
    """
    return _range_scores(scratch(points(scores, by, size)), by, size)


def range_scores_of_predictions(preds: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """The same of given predictions `pred` (0/1); series without a predicted or a positive point are left out."""
    return _range_scores(scratch(predicted_points(preds, by, size)), by, size).where("th = 0").drop("th")


def _range_scores(pts: DataFrame, by: list[str], size: int) -> DataFrame:
    runs = levels(pts, by, ("run",), size).selectExpr(*by, "lo", "hi", "hits / ((e - s + 1) * 1e0) / greatest(card, 1) as v")
    change = runs.selectExpr(*by, "inline(array(struct(hi as th, v as v, 1 as n_pred), struct(lo - 1 as th, -v as v, -1 as n_pred)))")
    found = at_thresholds(change, by, ["v", "n_pred"])
    before = blocks.beside(pts, by, "i", {"nb0": ("nb", -1), "y0": ("y", -1)}, size).where("y > 0").withColumn("nb0", F.expr("case when y0 > 0 then nb0 else 0 end"))
    sized = pts.where("y > 0").groupBy(*by, "seg").agg(F.count(F.lit(1)).alias("len"))
    steps = before.selectExpr(*by, "seg", "inline(array(struct(nb - 1 as th, 1 as hits, int(nb > nb0) as card), struct(nb0 - 1 as th, 0 as hits, -int(nb > nb0) as card)))")
    steps = steps.where("th >= 0").groupBy(*by, "seg", "th").agg(F.sum("hits").alias("hits"), F.sum("card").alias("card"))
    down = Window.partitionBy(*by, "seg").orderBy(F.col("th").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"hits": F.sum("hits").over(so_far), "card": F.sum("card").over(so_far)}).join(sized, [*by, "seg"])
    steps = steps.withColumns({"o": F.expr("case when card > 0 then hits / (len * 1e0) / card else 0e0 end"), "x": F.expr("case when hits > 0 then 1 else 0 end")})
    steps = steps.withColumns({"overlap": F.col("o") - F.coalesce(F.lag("o").over(down), F.lit(0.0)), "exist": F.col("x") - F.coalesce(F.lag("x").over(down), F.lit(0))})
    recall = at_thresholds(steps.select(*by, "th", "overlap", "exist"), by, ["overlap", "exist"])
    n_true = sized.groupBy(*by).agg(F.count(F.lit(1)).alias("n_true"))
    out = found.where("n_pred > 0").join(n_true, by).join(recall, [*by, "th"], "left").na.fill(0, ["overlap", "exist"])
    return out.selectExpr(*by, "th", "(0.2e0 * exist + 0.8e0 * overlap) / n_true as r_recall", "exist / (n_true * 1e0) as existence", "overlap / n_true as overlap", "v / n_pred as r_precision")


def range_f1(scores: DataFrame, by: list[str]) -> DataFrame:
    return sql(text(RANGE_F, by), ranges=range_scores(scores, by))


def zones(pts: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """(by, seg, js, je, e0, e1): true events [js, je) and their zones: halfway to the neighbours, the outer ones to the ends of the series."""
    events = pts.where("y > 0").groupBy(*by, "seg").agg(F.min("i").alias("s"), F.min("i").cast("double").alias("js"), (F.max("i") + 1.0).alias("je"), F.max("n").alias("n"))
    events = blocks.beside(events, by, "s", {"je0": ("je", -1), "js1": ("js", 1)}, size)
    return events.selectExpr(*by, "seg", "js", "je", "coalesce((je0 + js) / 2e0, 0e0) as e0", "coalesce((je + js1) / 2e0, n * 1e0) as e1")


def affiliation_changes(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> tuple[DataFrame, DataFrame]:
    """Zones, and what each threshold adds to their sums (by, seg, th, len, pp, pd, rp, rd).

    A predicted point adds the integral of precision over its cell [i, i + 1), clipped to the zone (a cell may lie in
    two), and of recall if it is in the event. A gap between predictions adds the integral of recall over the event's
    part in it, towards the nearer end; a gap that leaves a zone has one end there.
    """
    return _affiliation_changes(scratch(points(scores, by, size)), by, size)


def _affiliation_changes(pts: DataFrame, by: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    zs = scratch(zones(pts, by, size))
    near = blocks.nearest_known(pts.select(*by, "i", "y", "nb", "seg"), by, F.expr("case when y > 0 then struct(i, seg) end"), "i", size)
    near = near.where("_before is not null or _after is not null")
    mid = "(_before.i + 1 + _after.i) / 2e0"
    # the zone of a cell's left end and of its right end, and where they meet
    cells = near.selectExpr(
        *by, "i", "nb", f"case when _before is null then _after.seg when _after is null or i < {mid} then _before.seg else _after.seg end as z0",
        f"case when _before is null then _after.seg when _after is null or i + 1 <= {mid} then _before.seg else _after.seg end as z1", f"case when _before.i < _after.i and {mid} > i and {mid} < i + 1 then {mid} end as cut",
    )
    cells = scratch(cells)
    parts = cells.where("nb > 0").selectExpr(*by, "nb - 1 as th", "inline(case when cut is null then array(struct(z0 as seg, i * 1e0 as a, i + 1e0 as b)) else array(struct(z0 as seg, i * 1e0 as a, cut as b), struct(z1 as seg, cut as a, i + 1e0 as b)) end)")
    inside = "greatest(0e0, least(b, je) - greatest(a, js))"
    parts = parts.join(zs, [*by, "seg"]).selectExpr(
        *by, "seg", "th", "b - a as len", _outside("a", "least(b, js)") + f" + {inside} + " + _outside("greatest(a, je)", "b") + " as pp",
        "power(greatest(0e0, js - a), 2) / 2e0 - power(greatest(0e0, js - b), 2) / 2e0 + power(greatest(0e0, b - je), 2) / 2e0 - power(greatest(0e0, a - je), 2) / 2e0 as pd", f"{inside} as rp", "0e0 as rd",
    )
    gaps = levels(pts, by, ("gap",), size).selectExpr(*by, "s", "e + 1 as v", "lo", "hi")
    left = cells.selectExpr(*by, "i + 1 as s", "z1 as zl")
    right = cells.selectExpr(*by, "i as v", "z0 as zr")
    gaps = gaps.join(left, [*by, "s"], "left").join(right, [*by, "v"], "left")
    half = "(s + v) / 2e0"
    sides = gaps.selectExpr(*by, "lo", "hi", f"""inline(array(
        struct(zl as seg, s * 1e0 as p, false as right, s * 1e0 as a, case when zl = zr then {half} else v * 1e0 end as b),
        struct(zr as seg, v * 1e0 as p, true as right, case when zl = zr then {half} else s * 1e0 end as a, v * 1e0 as b)))""").where("seg is not null")
    # clipped to the event, which lies within the zone
    sides = sides.join(zs, [*by, "seg"]).withColumns({"a": F.expr("greatest(a, js)"), "b": F.expr("least(b, je)")}).where("a < b")
    value = f"case when right then {_recall('a', 'b', 'p', True)} else {_recall('a', 'b', 'p', False)} end"
    sides = sides.selectExpr(*by, "seg", "lo", "hi", f"{value} as rp", "abs(power(b - p, 2) - power(a - p, 2)) / 2e0 as rd")
    sides = sides.selectExpr(*by, "seg", "0e0 as len", "0e0 as pp", "0e0 as pd", "inline(array(struct(hi as th, rp as rp, rd as rd), struct(lo - 1 as th, -rp as rp, -rd as rd)))")
    sums = [F.sum(c).alias(c) for c in ("len", "pp", "pd", "rp", "rd")]
    return zs, scratch(parts.unionByName(sides).where("th >= 0").groupBy(*by, "seg", "th").agg(*sums))


def affiliation_zones(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """Precision, recall and their distances of each zone and threshold that has predictions in it."""
    zs, changes = affiliation_changes(scores, by, size)
    return _zone_values(zs, changes, by)


def _zone_values(zs: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    found = at_thresholds(changes, [*by, "seg"], ["len", "pp", "pd", "rp", "rd"]).where("len > 0").join(zs, [*by, "seg"])
    return found.selectExpr(*by, "th", "seg", "len as pred_len", "pp / len as precision_p", "rp / (je - js) as recall_p", "pd / len as precision_d", "rd / (je - js) as recall_d")


def affiliation(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """Precision over zones with predictions and recall over all zones, at each threshold."""
    zs, changes = affiliation_changes(scores, by, size)
    return sql(text(AFFILIATION, by), values=_zone_values(zs, changes, by), zones=zs)


def affiliation_f(scores: DataFrame, by: list[str]) -> DataFrame:
    return sql(text(AFFILIATION_F, by), affiliation=affiliation(scores, by))


def affiliation_of_predictions(preds: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """(by, aff_precision, aff_recall, aff_f) of given predictions `pred` (0/1).

    Series without a positive label are left out; without a predicted point the recall is 0, the precision and F are NULL.
    """
    zs, changes = _affiliation_changes(scratch(predicted_points(preds, by, size)), by, size)
    found = sql(text(AFFILIATION, by), values=_zone_values(zs, changes, by), zones=zs).where("th = 0").drop("th")
    out = zs.select(*by).distinct().join(found, by, "left").withColumn("aff_recall", F.coalesce("aff_recall", F.lit(0.0)))
    return out.withColumn("aff_f", F.expr("2e0 * aff_precision * aff_recall / nullif(aff_precision + aff_recall, 0e0)"))


def batch_affiliation(events: DataFrame, truth: str = "groundtruth", size: int = blocks.SIZE) -> DataFrame:
    """(dataset, algorithm, aff_precision, aff_recall, aff_f): each algorithm's 0/1 series (dataset, algorithm, t, y) against the dataset's `truth`.

    The truth's times count: where an algorithm has none of them, it predicts nothing there.
    """
    keys = ["dataset", "algorithm"]
    real = events.where(F.col("algorithm") == truth).select("dataset", "t", "y")
    others = events.where(F.col("algorithm") != truth).select(*keys, "t", F.col("y").alias("pred"))
    grid = real.join(others.select(*keys).distinct(), "dataset").join(others, [*keys, "t"], "left").na.fill(0, ["pred"])
    return affiliation_of_predictions(grid, keys, size)


def windows(scores: DataFrame, by: list[str], window: int | DataFrame) -> tuple[DataFrame, int]:
    """(by, win) of each series and the largest: a fixed number, or a table such as evaluation_windows() gives."""
    if isinstance(window, int):
        return scores.select(*by).distinct().withColumn("win", F.lit(window)), window
    return window, window.agg(F.max("win")).first()[0] or 0


def _ranked_places(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """The points with their places and f, the number of points with a larger score."""
    given = scores.where("score is not null").select(*by, "t", "y", "score")
    given = scratch(given)
    above = ranked(given, by, size).selectExpr(*by, "score", "cp + cn - p - n as f")
    return scratch(places(given, by, size).join(above, [*by, "score"]))


def vus(scores: DataFrame, by: list[str], window: int | DataFrame = 20, thresholds: int = 250) -> DataFrame:
    table, most = windows(scores, by, window)
    return sql(_vus(VUS_MEAN, by, most, thresholds), placed=_ranked_places(scores, by), windows=table)


def range_auc(scores: DataFrame, by: list[str], window: int | DataFrame = 20, thresholds: int = 250) -> DataFrame:
    """Range AUC and AP of each margin 0 to the window."""
    table, most = windows(scores, by, window)
    return sql(_vus(VUS_AT, by, most, thresholds), placed=_ranked_places(scores, by), windows=table)


def range_auc_of_share(scores: DataFrame, by: list[str], share: float = 0.2, thresholds: int = 250, size: int = blocks.SIZE) -> DataFrame:
    """(by, auc, ap): range AUC and AP with margins whose width is a share of each segment's own length, rounded down.

    Margins are those of segments.soft_labels_from_end(). A segment is one of the raw labels; it is found at a threshold
    if a point of it or of its margins is predicted. Only margins are multiplied out, never points by thresholds.
    """
    pts = _ranked_places(scores, by, size).where("pos > 0")
    pts = pts.withColumn("k", F.expr(f"cast(ceil(f * ({thresholds} - 1e0) / greatest(n - 1e0, 1e0) - 1e-9) as int)")).select(*by, "i", "y", "seg", "n", "pos", "k")
    segs = pts.where("y > 0").groupBy(*by, "seg").agg(F.min("i").alias("s"), F.max("i").alias("e"), F.min("k").alias("own"))
    segs = segs.withColumn("w", F.floor((F.col("e") - F.col("s") + 1) * F.lit(share)))
    margins = segs.where("w > 0").select(*by, "seg", "s", "e", "w", F.explode(F.expr("concat(sequence(s - w, s - 1), sequence(e, e + w - 1))")).alias("i"))
    margins = scratch(margins.join(pts.select(*by, "i", "y", "k"), [*by, "i"]))
    near = margins.groupBy(*by, "seg").agg(F.min("k").alias("near"))
    found = segs.join(near, [*by, "seg"], "left").groupBy(*by, F.expr("least(own, coalesce(near, own))").alias("k")).agg(F.count(F.lit(1)).alias("found"))
    soft = margins.where("y = 0").withColumn("d", F.expr("sqrt(1 - (case when i >= e then i - e else s - i end) / (2e0 * w))"))
    soft = soft.groupBy(*by, "i", "k").agg(F.least(F.lit(1.0), F.sum("d")).alias("soft"))
    soft = soft.groupBy(*by, "k").agg(F.sum("soft").alias("soft"), F.sum(F.expr("case when soft < 1 then soft else 0e0 end")).alias("part"), F.sum(F.expr("int(soft >= 1)")).alias("full"))
    plain = pts.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("y").alias("inside"))
    totals = pts.groupBy(*by).agg(F.max("n").alias("n"), F.max("pos").alias("pos")).join(segs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seg")), by)
    totals = totals.join(soft.groupBy(*by).agg(F.sum("full").alias("ones")), by, "left").withColumn("ones", F.coalesce("ones", F.lit(0)) + F.col("pos"))
    at = totals.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))))
    for part in (plain, soft.drop("full"), found):
        at = at.join(part, [*by, "k"], "left")
    down = Window.partitionBy(*by).orderBy("k")
    at = at.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(down.rowsBetween(Window.unboundedPreceding, 0)) for c in ("n_pred", "inside", "soft", "part", "found")})
    at = at.withColumns({"tp": F.expr("inside + soft"), "p": F.expr("(pos + ones + part) / 2e0")})
    at = at.withColumns({"tpr": F.expr("least(tp / p, 1e0) * found / n_seg"), "fpr": F.expr("(n_pred - tp) / nullif(n - p, 0e0)"), "prec": F.expr("tp / n_pred")})
    at = at.withColumns({f"{c}0": F.coalesce(F.lag(c).over(down), F.lit(0.0)) for c in ("tpr", "fpr")})
    last = f"case when k = {thresholds - 1} then (1e0 - fpr) * (1e0 + tpr) / 2e0 end"
    return at.groupBy(*by).agg(F.expr(f"sum((fpr - fpr0) * (tpr + tpr0) / 2e0) + max({last})").alias("auc"), F.expr("sum((tpr - tpr0) * prec)").alias("ap"))


def vus_of_predictions(preds: DataFrame, by: list[str], window: int = 20) -> DataFrame:
    return sql(_vus(VUS_PRED, by, window), placed=scratch(places(preds.select(*by, "t", "y", "pred"), by)))


def evaluation_slice(scores: DataFrame, by: list[str], start: int = 0) -> DataFrame:
    """The rows at t >= start whose score is a finite number."""
    return scores.where((F.col("t") >= start) & finite(F.col("score")).isNotNull())


def evaluation_windows(scores: DataFrame, by: list[str], default: int = 100) -> DataFrame:
    """(by, win): the median length of each series' segments of positive labels, by place in the slice; `default` without any."""
    placed = blocks.placed(scores.select(*by, "t", "y"), by).select(*by, "y", (F.col("_place") + 1).alias("t"))
    found = segments.median_length(segments.runs(placed, by), scores.select(*by).distinct(), by, default)
    return found.withColumnRenamed("width", "win")


#: The classic report's columns.
CLASSIC = ["auc", "prec", "rec", "f", "pa_f1", "r_recall", "existence", "overlap", "r_precision", "r_f", "precision_at_k"]


def classic_report(scores: DataFrame, by: list[str], size: int = blocks.SIZE) -> DataFrame:
    """(by, CLASSIC) at one cut: precision, recall, F, F after adjustment and range scores of the predictions `pred` (0/1).

    Without a column pred, scores more than three standard deviations above the series' mean are predicted. Precision at
    k is that of the k best scores, k being the number of positives and ties going by t. Series without a positive label
    are left out; rows without a score too; what has no predictions to divide by is 0.
    """
    rows = scores.where("score is not null").select(*by, "t", "y", "score", *[c for c in ("pred",) if c in scores.columns])
    sums = rows.groupBy(*by).agg((F.avg("score") + 3 * F.stddev_pop("score")).alias("_cut"), F.sum("y").alias("_pos")).where("_pos > 0")
    rows = rows.join(sums, by)
    if "pred" not in rows.columns:
        rows = rows.withColumn("pred", (F.col("score") > F.col("_cut")).cast("int"))
    rows = scratch(rows.drop("_cut", "_pos"))
    out = rows.groupBy(*by).agg(F.sum("y").alias("pos"), F.sum("pred").alias("n_pred"), F.sum(F.col("y") * F.col("pred")).alias("tp"))
    adjusted = adjust(rows, by, size).groupBy(*by).agg(F.sum("adjusted").alias("n_adjusted"), F.sum(F.col("y") * F.col("adjusted")).alias("tpa"))
    # of the scores not beaten by pos others, the first in time of those that share the last of them
    best = _ranked_places(rows, by, size).where("f < pos")
    best = blocks.running(blocks.by_time(best, "i", size), [*by, "score"], [F.col("i")], {"_q": F.lit(1)})
    top = best.where("f + _q <= pos").groupBy(*by).agg(F.sum("y").alias("top"))
    for other in (adjusted, top, rank_metrics(rows, by, size).select(*by, F.col("auc_roc").alias("auc")), range_scores_of_predictions(rows, by, size)):
        out = out.join(other, by, "left")
    out = out.na.fill(0, ["r_recall", "existence", "overlap", "r_precision"])
    return out.selectExpr(
        *by, "auc", "coalesce(tp / nullif(n_pred * 1e0, 0e0), 0e0) as prec", "tp / (pos * 1e0) as rec", "2e0 * tp / (n_pred + pos) as f", "2e0 * tpa / (n_adjusted + pos) as pa_f1", "r_recall", "existence", "overlap", "r_precision",
        "coalesce(2e0 * r_recall * r_precision / nullif(r_recall + r_precision, 0e0), 0e0) as r_f", "top / (pos * 1e0) as precision_at_k",
    )


def report(scores: DataFrame, by: list[str], window: int | DataFrame | None = None, start: int = 0) -> DataFrame:
    """All nine metrics of each series in one row, of its evaluation slice; window None: the median length of its segments.

    The scores should be a table or cached: each metric reads them.
    """
    rows = evaluation_slice(scores, by, start).select(*by, "t", "y", "score")
    window = evaluation_windows(rows, by) if window is None else window
    out = rank_metrics(rows, by)
    for other in (adjusted_f1(rows, by), event_f1(rows, by), range_f1(rows, by), affiliation_f(rows, by), vus(rows, by, window)):
        out = out.join(other, by, "left")
    return out
