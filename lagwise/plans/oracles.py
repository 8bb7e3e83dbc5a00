"""SQL written apart from the operators: by threshold, by pair, by segment and by edge, as the definitions read.

Nothing here is shared with the operators' texts but the fixtures; where these work on counts, running sums and window
functions, the texts here join and count anew.
"""

from __future__ import annotations

from ..operators import quality as ql
from . import by_threshold as bt
from . import fixtures as fx
from . import priors as pq
from . import quality as qq

O: dict[str, str] = {}
TAU, BINS = pq.TAU, pq.BINS
EDGE = ["entity", "tau", "src", "tgt"]


def put(name: str, before: str, keys: list[str], columns: list[str], body: str, digits: int = 8, whole: bool = False, zero: str = "") -> None:
    ks = ", ".join(f"cast({k} as bigint) as {k}" if whole else k for k in keys)
    values = "".join(f", round(cast({c} as double), {digits}){zero} as {c}" for c in columns)
    O[name] = f"with {before} select {ks}{values} from ({body}) res"


# Ranks: every pair, every threshold.
RANKS = """
ths as (select distinct entity, score as s from scores),
cut as (select h.entity, s, sum(y) as tp, count(*) as n from ths h join scores x on h.entity = x.entity and x.score >= h.s group by all),
pos as (select entity, sum(y) as p from scores group by all),
pr as (select c.entity, s, tp / n::double as prec, tp / p::double as rec from cut c join pos using (entity) where p > 0),
ap as (select a.entity, sum((a.rec - coalesce((select max(b.rec) from pr b where b.entity = a.entity and b.s > a.s), 0)) * a.prec) as auc_pr, max(2 * a.prec * a.rec / (a.prec + a.rec + 1e-5)) as f1 from pr a group by all),
roc as (select a.entity, avg(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0 end) as auc_roc from scores a join scores b on a.entity = b.entity and a.y = 1 and b.y = 0 group by all),
ranks as (select entity, auc_roc, auc_pr, f1 from roc join ap using (entity))"""
B = fx.SCORES
for name, columns in (("flagship_rank_quality", ["auc_roc", "auc_pr", "f1"]), ("q02_auc_roc", ["auc_roc"]), ("q03_average_precision", ["auc_pr"]), ("q04_best_f1", ["f1"])):
    put(name, f"{B},{RANKS}", ["entity"], columns, "select * from ranks")

# Sweeps: each threshold's predictions as a copy of the series.
SWEEP = """
places as (select entity, t, y, score, row_number() over (partition by entity order by t) - 1 as i from scores),
truth as (select entity, row_number() over (partition by entity order by min(i)) as seg, min(i) as s, max(i) as e from (select *, i - row_number() over (partition by entity order by i) as g from places where y = 1) group by entity, g),
ends as (select entity, min(score) as lo, max(score) as hi, count(*) as n from scores group by all),
thr as (select entity, th, case when th = 99 then hi else lo + th * ((hi - lo) / 99::double) end as cut, n from ends, range(100) r(th)),
pred as (select p.entity, th, i, y, seg, score > cut as p from places p join thr using (entity) left join truth on p.entity = truth.entity and p.i between truth.s and truth.e),
found as (select entity, th, seg, bool_or(p) as hit from pred where y = 1 group by all),
adjusted as (select pred.*, case when y = 1 and i > 0 and hit then true else p end as a from pred left join found using (entity, th, seg)),
per as (select entity, th, count(*) filter (where p and y = 1) as tp, count(*) filter (where p and y = 0) as fp, count(*) filter (where a and y = 1) as tpa, count(distinct case when p and y = 1 then seg end) as hits,
               count(distinct seg) as n_seg, count(*) filter (where y = 1) as pos from adjusted group by all having count(distinct seg) > 0),
pa as (select entity, max(case when tpa > 0 then 2 * (tpa / (tpa + fp)::double) * (tpa / pos::double) / (tpa / (tpa + fp)::double + tpa / pos::double) else 0 end) as pa_f1 from per group by all),
ev as_ (select 1),
evf as (select entity, max(case when hits > 0 then 2 * (hits / n_seg::double) * (tp / (tp + fp)::double) / (hits / n_seg::double + tp / (tp + fp)::double + 1e-15) else 0 end) as event_f1 from per group by all)""".replace("ev as_ (select 1),\n", "")
B_SWEEP = f"{fx.SCORES},{SWEEP}"
put("q06_sweep_counts", B_SWEEP, ["entity", "th"], ["tp", "fp", "tpa", "hits", "n_seg", "pos"], "select * from per")
put("q06_adjusted_f1", B_SWEEP, ["entity"], ["pa_f1"], "select * from pa")
put("q07_event_f1", B_SWEEP, ["entity"], ["event_f1"], "select * from evf")
put(
    "q05_point_adjust", fx.SCORES + """,
    p as (select entity, t, y, (score > 1.5)::int as pred, row_number() over (partition by entity order by t) - 1 as i from scores),
    seg as (select entity, min(i) as s, max(i) as e from (select *, i - row_number() over (partition by entity order by i) as g from p where y = 1) group by entity, g),
    hit as (select g.entity, s, e, min(case when pred = 1 then i end) as first from seg g join p on p.entity = g.entity and p.i between s and e group by all),
    a as (select p.*, s, first from p left join hit on p.entity = hit.entity and p.i between s and e)""",
    ["entity", "t"], ["y", "adjusted", "filled", "event"],
    "select entity, t, y, case when first is not null and i > 0 then 1 else pred end as adjusted, (coalesce(i < first, false) and i > 0)::int as filled, (coalesce(i = s, false) and first is not null and i > 0)::int as event from a",
)

# Ranges: predicted against true segments, by overlap.
RANGES = """
runs as (select entity, th, row_number() over (partition by entity, th order by min(i)) as k, min(i) as s, max(i) as e from (select *, i - row_number() over (partition by entity, th order by i) as g from pred where p) group by entity, th, g),
meet as (select r.entity, r.th, r.k, g.seg, least(r.e, g.e) - greatest(r.s, g.s) + 1 as shared from runs r join truth g on r.entity = g.entity and r.s <= g.e and g.s <= r.e),
of_true as (select entity, th, seg, sum(shared) as shared, count(*) as touched from meet group by all),
of_pred as (select entity, th, k, sum(shared) as shared, count(*) as touched from meet group by all),
rec as (select o.entity, th, count(*) as exist, sum(shared / (g.e - g.s + 1)::double / touched) as overlap from of_true o join truth g using (entity, seg) group by all),
pre as (select r.entity, r.th, sum(coalesce(shared / (r.e - r.s + 1)::double / touched, 0)) / count(*) as r_precision from runs r left join of_pred using (entity, th, k) group by all),
nt as (select entity, count(*) as n from truth group by all),
ranges as (select p.entity, p.th, coalesce((0.2::double * exist + 0.8::double * overlap) / n, 0) as r_recall, coalesce(exist / n::double, 0) as existence, coalesce(overlap / n, 0) as overlap, r_precision
           from pre p join nt using (entity) left join rec on p.entity = rec.entity and p.th = rec.th),
rf as (select entity, max(case when r_recall + r_precision > 0 then 2 * r_recall * r_precision / (r_recall + r_precision) else 0 end) as r_f from ranges group by all)"""
put("q08_range_recall", f"{B_SWEEP},{RANGES}", ["entity", "th"], ["r_recall", "existence", "overlap", "r_precision"], "select * from ranges")
put("q10_range_f1", f"{B_SWEEP},{RANGES}", ["entity"], ["r_f"], "select * from rf")
put(
    "q09_biased_recall", B_SWEEP + """,
    w as (select pred.*, g.e - i + 1 as front, i - g.s + 1 as back, case when i - g.s + 1 <= (g.e - g.s + 1) / 2.0 then i - g.s + 1 else g.e - i + 1 end as middle from pred join truth g using (entity, seg)),
    z as (select entity, th, seg, sum(front) filter (where p) / sum(front)::double as front, sum(back) filter (where p) / sum(back)::double as back, sum(middle) filter (where p) / sum(middle)::double as middle from w group by all)""",
    ["entity", "th"], ["front", "back", "middle"], "select entity, th, avg(coalesce(front, 0)) as front, avg(coalesce(back, 0)) as back, avg(coalesce(middle, 0)) as middle from z group by all",
)
_PLACES = SWEEP[: SWEEP.index("ends as")].rstrip().rstrip(",")


def classic(name: str, before: str, condition: str) -> None:
    """One cut: the predictions' counts, adjusted counts, ranges and the best k by comparing each pair of scores."""
    put(
        name, f"""{fx.SCORES},{_PLACES}, cuts as ({before}),
        pred as (select p.entity, 0 as th, p.i, p.y, seg, {condition} as p from places p join cuts using (entity) left join truth on p.entity = truth.entity and p.i between truth.s and truth.e),
        {SWEEP[SWEEP.index("found as"):SWEEP.index("pa as")].rstrip().rstrip(",")},{RANGES[:RANGES.index("rf as")].rstrip().rstrip(",")},
        roc as (select a.entity, avg(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0 end) as auc from scores a join scores b on a.entity = b.entity and a.y = 1 and b.y = 0 group by all),
        top as (select x.entity, sum(x.y) as top from scores x join per on per.entity = x.entity where (select count(*) from scores z where z.entity = x.entity and (z.score > x.score or z.score = x.score and z.t < x.t)) < per.pos group by all)""",
        ["entity"], ql.CLASSIC,
        """select per.entity, auc, coalesce(tp / nullif(tp + fp, 0)::double, 0) as prec, tp / pos::double as rec, 2 * tp / (tp + fp + pos)::double as f, 2 * tpa / (tpa + fp + pos)::double as pa_f1, coalesce(r_recall, 0) as r_recall,
           coalesce(existence, 0) as existence, coalesce(overlap, 0) as overlap, coalesce(r_precision, 0) as r_precision, case when r_recall + r_precision > 0 then 2 * r_recall * r_precision / (r_recall + r_precision) else 0 end as r_f, top / pos::double as precision_at_k
           from per left join ranges using (entity) left join roc using (entity) left join top using (entity)""",
    )


classic("q23_classic_report", "select entity, avg(score) + 3 * stddev_pop(score) as cut from scores group by all", "score > cut")
classic("q23_report_of_predictions", "select distinct entity from scores", "score > 1.5")


def vus(windows: str) -> str:
    """Every margin, threshold and point; margins to the window of `windows` (entity, win)."""
    return f"""
wins as ({windows}),
vp as (select entity, i, y, score, count(*) over (partition by entity) as n, row_number() over (partition by entity order by score desc) - 1 as place from places),
vt as (select v.entity, k, score as cut from vp v, range(250) r(k) where place = trunc(k * (n - 1) / 249::double)),
ws as (select entity, w from wins, range(1000) r(w) where w <= win),
soft as (select p.entity, w, p.i, p.y, score, n, case when p.y = 1 then 1 else least(1, coalesce(sum(sqrt(1 - (case when p.i > g.e then p.i - g.e else g.s - p.i end) / w::double)), 0)) end as lab
         from vp p join ws using (entity) left join truth g on g.entity = p.entity and w > 0 and p.i between g.s - w // 2 and g.e + w // 2 and not p.i between g.s and g.e group by p.entity, w, p.i, p.y, score, n),
joined as (select t.entity, w, seg, s - w // 2 as s, e + w // 2 as e, coalesce(max(e + w // 2) over (partition by t.entity, w order by s rows between unbounded preceding and 1 preceding) < s - w // 2, true) as cut from truth t join ws using (entity)),
blocks as (select entity, w, grp, min(s) as s, max(e) as e from (select *, sum(cut::int) over (partition by entity, w order by s) as grp from joined) group by all),
tops as (select b.entity, w, grp, max(score) as top from blocks b join vp on vp.entity = b.entity and vp.i between b.s and b.e group by all),
ex as (select o.entity, w, k, count(*) filter (where top >= cut) / count(*)::double as found from tops o join vt using (entity) group by all),
sums as (select s.entity, w, k, max(n) as n, sum(y) as p, sum(lab) filter (where score >= cut) as tp, sum(case when y = 0 then lab end) filter (where score >= cut) as outside, count(*) filter (where score >= cut) as npred
       from soft s join vt using (entity) group by s.entity, w, k),
rates as (select entity, w, k, least(tp / ((p + p + coalesce(outside, 0)) / 2), 1) * found as tpr, (npred - tp) / (n - (p + p + coalesce(outside, 0)) / 2) as fpr, tp / npred as prec from sums join ex using (entity, w, k) where p > 0),
curve as (select entity, w, k, tpr, fpr, prec from rates union all select distinct entity, w, -1, 0, 0, null from rates union all select distinct entity, w, 250, 1, 1, null from rates),
areas as (select b.entity, b.w, sum((b.fpr - a.fpr) * (b.tpr + a.tpr) / 2) as auc, sum(case when b.k < 250 then (b.tpr - a.tpr) * b.prec end) as ap from curve b join curve a on a.entity = b.entity and a.w = b.w and a.k = b.k - 1 group by all),
vm as (select entity, avg(auc) as vus_roc, avg(ap) as vus_pr from areas group by all)"""


TWENTY = vus("select distinct entity, 20 as win from scores")
put("q19_vus", f"{fx.SCORES},{_PLACES},{TWENTY}", ["entity"], ["vus_roc", "vus_pr"], "select * from vm")
put("q21_range_auc", f"{fx.SCORES},{_PLACES},{TWENTY}", ["entity", "w"], ["auc", "ap"], "select * from areas")
put(
    "q21_range_auc_share", f"""{fx.SCORES},{_PLACES},
    byrank as (select *, row_number() over (partition by entity order by score desc) - 1 as place, count(*) over (partition by entity) as n from places),
    cuts as (select entity, k, n, score as cut from byrank, range(250) r(k) where place = trunc(k * (n - 1) / 249::double)),
    wide as (select *, floor((e - s + 1) * 0.5)::bigint as w from truth),
    lab as (select p.entity, p.i, p.y, p.score, case when p.y = 1 then 1 else least(1, coalesce(sum(sqrt(1 - (case when p.i >= e then p.i - e else s - p.i end) / (2 * w)::double)), 0)) end as lab
            from places p left join wide g on g.entity = p.entity and w > 0 and (p.i between s - w and s - 1 or p.i between e and e + w - 1) group by p.entity, p.i, p.y, p.score),
    tops as (select g.entity, seg, max(score) as top from wide g join places p on p.entity = g.entity and p.i between s - w and greatest(e, e + w - 1) group by all),
    ex as (select entity, k, count(*) filter (where top >= cut) / count(*)::double as found from tops join cuts using (entity) group by all),
    sums as (select l.entity, k, max(n) as n, (sum(y) + sum(case when lab = 1 then 1 when score >= cut then lab else 0 end)) / 2 as p, sum(lab) filter (where score >= cut) as tp, count(*) filter (where score >= cut) as npred from lab l join cuts using (entity) group by l.entity, k),
    rates as (select entity, k, least(tp / p, 1) * found as tpr, (npred - tp) / (n - p) as fpr, tp / npred as prec from sums join ex using (entity, k)),
    curve as (select * from rates union all select distinct entity, -1, 0, 0, null from rates union all select distinct entity, 250, 1, 1, null from rates)""",
    ["entity"], ["auc", "ap"], "select b.entity, sum((b.fpr - a.fpr) * (b.tpr + a.tpr) / 2) as auc, sum(case when b.k < 250 then (b.tpr - a.tpr) * b.prec end) as ap from curve b join curve a on a.entity = b.entity and a.k = b.k - 1 group by all",
)
_FILES = ", ".join(f"('{name}', {cut}::double)" for name, cut in qq.ALGORITHMS.items())
_FILE_POINTS = """
pts as (select dataset, algorithm, row_number() over (partition by dataset, algorithm order by t) - 1 as i, y, pred as nb, case when y > 0 then sum(1 - y) over (partition by dataset, algorithm order by t) end as seg from files)"""
put(
    "q29_batch_affiliation", f"""{fx.SCORES},
    files as (select entity as dataset, algorithm, t, y, (score > cut and (algorithm <> 'a2' or t < 700))::int as pred from scores, (values {_FILES}) a(algorithm, cut)),
    zn0 as ({ql.text(bt.AFFILIATION_ZONES, ["dataset", "algorithm"]).replace(ql.text(bt.POINTS, ["dataset", "algorithm"]), _FILE_POINTS)}),
    many as (select dataset, count(*) as n from (select distinct dataset, t - (select count(*) from scores b where b.entity = a.dataset and b.y = 1 and b.t <= a.t) as run from files a where y = 1) group by all),
    pr as (select dataset, algorithm, avg(precision_p) as aff_precision, sum(recall_p) / max(n) as aff_recall from zn0 join many using (dataset) group by all)""",
    ["dataset", "algorithm"], ["aff_precision", "aff_recall", "aff_f"],
    "select dataset, algorithm, aff_precision, coalesce(aff_recall, 0) as aff_recall, 2 * aff_precision * aff_recall / (aff_precision + aff_recall) as aff_f from (select distinct dataset, algorithm from files join many using (dataset)) left join pr using (dataset, algorithm)",
)
put(
    "q22_vus_of_predictions", f"""{fx.SCORES},{_PLACES}, ws as (select distinct entity, w from scores, range(21) r(w)),
    soft as (select p.entity, w, p.i, p.y, (score > 1.5)::int as pred, case when p.y = 1 then 1 else least(1, coalesce(sum(sqrt(1 - (case when p.i > g.e then p.i - g.e else g.s - p.i end) / w::double)), 0)) end as lab
             from places p join ws using (entity) left join truth g on g.entity = p.entity and w > 0 and p.i between g.s - w // 2 and g.e + w // 2 and not p.i between g.s and g.e group by p.entity, w, p.i, p.y, score),
    one as (select entity, w, sum(lab * pred) as tp, sum(pred) as np, sum(y) as pos, sum(case when y = 0 then lab * pred else 0 end) as outside from soft group by all),
    pr as (select entity, w, least(tp / ((pos + pos + outside) / 2), 1) as r, case when np > 0 then tp / np else 0 end as p from one where pos > 0)""",
    ["entity"], ["vus_recall", "vus_precision", "vus_f"], "select entity, avg(r) as vus_recall, avg(p) as vus_precision, avg(case when p + r > 0 then 2 * p * r / (p + r) else 0 end) as vus_f from pr group by all",
)
SLICED = fx.SCORES.replace("scores as (", "all_scores as (") + """,
broken as (select entity, t, y, case when t % 41 = 7 then 'nan'::double when t % 53 = 9 then 'infinity'::double when t % 59 = 11 then null else score end as score from all_scores),
scores as (select * from broken where t >= 450 and score is not null and isfinite(score))"""
WIDTHS = "select n.entity, case when m is null then 100 else greatest(cast(floor(m) as int), 1) end as win from (select distinct entity from scores) n left join (select entity, quantile_cont(e - s + 1, 0.5) as m from truth group by all) using (entity)"
put("q01_evaluation_slice", f"{SLICED},{_PLACES}", ["entity"], ["n", "positives", "total", "win"], f"select * from (select entity, count(*) as n, sum(y) as positives, sum(score) as total from scores group by all) join ({WIDTHS}) using (entity)")

# Digits and entropies: by counts of edges below, and by the four joint entropies.
_ENDS = "select entity, var, min(x) as lo, case when max(x) > min(x) then max(x) else min(x) + 1 end as hi from {c} group by all"
DIGITS = """
full_cells as (select entity, t, var, coalesce(x, 0) as x from cells),
sides as (""" + _ENDS.format(c="full_cells") + f"""),
digits as (select c.entity, c.t, c.var, (select count(*) from range(1, {BINS}) r(k) where c.x >= s.lo + k * ((s.hi - s.lo) / {BINS}::double)) as b from full_cells c join sides s using (entity, var))"""
CHUNKS = """
chunks as (select entity, i as chunk, cast(floor(share * 520) as bigint) as s, cast(floor(share * 520) + 199 as bigint) as e from (select distinct entity from ev), (values (0, 0.0::double), (1, 0.3::double), (2, 0.6::double), (3, 1.0::double)) c(i, share)),
bins as (select d.*, k.chunk from digits d join chunks k on d.entity = k.entity and d.t between k.s and k.e)"""


def entropy(tau: int = TAU) -> str:
    def h(columns: str) -> str:
        return f"select entity, chunk, tau, src, tgt, sum(-(c / m) * log2(c / m)) as h from (select entity, chunk, tau, src, tgt, m::double as m, count(*)::double as c from j group by entity, chunk, tau, src, tgt, m, {columns}) group by all"

    return f"""
size as (select entity, chunk, min(t) as t0, count(distinct t) as n from bins group by all),
j as (select y.entity, y.chunk, tau, x.var as src, y.var as tgt, n - tau as m, y.b as yt, p.b as yp, x.b as xp from size z join bins y using (entity, chunk), range(1, {tau} + 1) l(tau), bins p, bins x
      where p.entity = y.entity and p.chunk = y.chunk and p.var = y.var and p.t = y.t - 1 and x.entity = y.entity and x.chunk = y.chunk and x.t = y.t - tau and x.var <> y.var and y.t - t0 >= tau and n - tau > 1),
te as (select entity, tau, src, tgt, avg(greatest(a.h - b.h - c.h + d.h, 0)) as te from ({h('yt, yp')}) a join ({h('yp')}) b using (entity, chunk, tau, src, tgt) join ({h('yt, yp, xp')}) c using (entity, chunk, tau, src, tgt) join ({h('yp, xp')}) d using (entity, chunk, tau, src, tgt) group by entity, tau, src, tgt)"""


def prior(te: str = "te", tau: int = TAU) -> str:
    """Entropies to a prior, column by column."""
    return f"""
grid as (select a.entity, tau, a.var as src, b.var as tgt from (select distinct entity, var from bins) a join (select distinct entity, var from bins) b using (entity), range(1, {tau} + 1) l(tau)),
raws as (select g.*, greatest(coalesce(te, 0), case when tau = 1 and src = tgt then 0.25 else 0 end) as raw from grid g left join {te} x using (entity, tau, src, tgt)),
mass as (select entity, tgt, sum(raw) as total from raws group by all),
upper_q as (select entity, quantile_cont(raw, 0.75) as q from raws where raw > 0 group by all),
prior as (select r.entity, tau, src, r.tgt, raw, case when total > 1e-12 then raw / total when tau = 1 and src = r.tgt then 1 else 0 end as weight, case when tau = 1 and src = r.tgt then 1 else least(1, raw / coalesce(q, 1)) end as gate
          from raws r join mass m on r.entity = m.entity and r.tgt = m.tgt left join upper_q u on r.entity = u.entity)"""


P_TE = f"{fx.CELLS},{DIGITS},{CHUNKS},{entropy()}"
put("p01_bin_edges", f"{fx.CELLS}, sides as ({_ENDS.format(c='cells')})", ["entity", "var", "edge"], ["x"], f"select entity, var, k as edge, coalesce(lo, 0) + k * (coalesce(hi, 1) - coalesce(lo, 0)) / {BINS}::double as x from sides, range(1, {BINS}) r(k)", whole=True)
put("p02_digitise", f"{fx.CELLS},{DIGITS}", ["entity", "var", "t"], ["b"], "select * from digits", whole=True)
put("p03_transfer_entropy", P_TE, EDGE, ["te"], "select * from te", whole=True)
put("p07_entropy_prior", f"{P_TE},{prior()}", EDGE, ["raw", "weight", "gate"], "select * from prior", whole=True)

CONFOUND = """
rough as (select entity, src, tgt, max(te) as te from te group by all),
theta as (select n.entity, coalesce(m, 0.1) as th from (select distinct entity from rough) n left join (select entity, median(te) as m from rough where te > 0 group by all) using (entity)),
cand as (select a.entity, a.src, a.tgt, zs.src as z, zs.te + zt.te as score from rough a, rough zs, rough zt, rough sz, theta h
         where zs.entity = a.entity and zt.entity = a.entity and sz.entity = a.entity and h.entity = a.entity and zs.tgt = a.src and zt.src = zs.src and zt.tgt = a.tgt and sz.src = a.src and sz.tgt = zs.src
           and zs.src <> a.tgt and zs.te > th and zt.te > th and sz.te < zs.te / 2),
conf as (select * from cand c where not exists (select 1 from cand d where d.entity = c.entity and d.src = c.src and d.tgt = c.tgt and (d.score > c.score or d.score = c.score and d.z < c.z)))"""


def conditional(width: int, tau: int) -> str:
    def h(columns: str) -> str:
        return f"select entity, chunk, tau, src, tgt, sum(-(c / m) * log2(c / m)) as h from (select entity, chunk, tau, src, tgt, m::double as m, count(*)::double as c from jz group by entity, chunk, tau, src, tgt, m, {columns}) group by all"

    half = max(width // 2, 2)
    return f"""
jz as (select y.entity, y.chunk, tau, f.src, f.tgt, s.n - tau as m, y.b as yt, p.b as yp, x.b as xp, least(w.b * {half} // {width}, {half} - 1) as zp from size s join bins y using (entity, chunk), range(1, {tau} + 1) l(tau), bins p, bins x, bins w, conf f
       where f.entity = y.entity and f.tgt = y.var and p.entity = y.entity and p.chunk = y.chunk and p.var = y.var and p.t = y.t - 1 and x.entity = y.entity and x.chunk = y.chunk and x.var = f.src and x.t = y.t - tau
         and w.entity = y.entity and w.chunk = y.chunk and w.var = f.z and w.t = y.t - 1 and y.t - t0 >= tau and s.n - tau > 1),
cte as (select entity, tau, src, tgt, avg(greatest(a.h - b.h - c.h + d.h, 0)) as te from ({h('yt, yp, zp')}) a join ({h('yp, zp')}) b using (entity, chunk, tau, src, tgt) join ({h('yt, yp, xp, zp')}) c using (entity, chunk, tau, src, tgt) join ({h('yp, xp, zp')}) d using (entity, chunk, tau, src, tgt) group by entity, tau, src, tgt),
mixed as (select t.entity, t.tau, t.src, t.tgt, coalesce(c.te, t.te) as te from te t left join cte c on t.entity = c.entity and t.tau = c.tau and t.src = c.src and t.tgt = c.tgt)"""


put("p05_confounders", f"{P_TE},{CONFOUND}", ["entity", "src", "tgt", "z"], ["score"], "select * from conf", whole=True)
put("p04_conditional_entropy", f"{P_TE},{CONFOUND},{conditional(BINS, TAU)}", EDGE, ["te"], "select * from cte", whole=True)
put("p06_conditional_prior", f"{P_TE},{CONFOUND},{conditional(BINS, TAU)},{prior('mixed')}", EDGE, ["raw", "weight", "gate"], "select * from prior", whole=True)
DRIVEN = fx.CELLS + """,
noise as (select entity, t, (coalesce(x, 0) * 7919 + t * 104729 + entity * 31) % 1009 % 4 as u from cells where var = 0),
three as (select n.entity, n.t, v.var, case v.var when 0 then n.u when 1 then coalesce(a.u, 0) + n.u % 2 else coalesce(b.u, 0) + n.u // 2 % 2 end as x from noise n left join noise a on a.entity = n.entity and a.t = n.t - 1 left join noise b on b.entity = n.entity and b.t = n.t - 2, range(3) v(var)),
sides as (""" + _ENDS.format(c="three") + """),
bins as (select c.entity, c.t, c.var, 0 as chunk, (select count(*) from range(1, 4) r(k) where c.x >= s.lo + k * ((s.hi - s.lo) / 4::double)) as b from three c join sides s using (entity, var)),""" + entropy(2) + "," + CONFOUND + "," + conditional(4, 2)
put("p05_driven_confounders", DRIVEN, ["entity", "src", "tgt", "z"], ["score"], "select * from conf", whole=True)
put("p04_driven_conditional_entropy", DRIVEN, EDGE, ["te"], "select * from cte", whole=True)
put("p06_driven_conditional_prior", f"{DRIVEN},{prior('mixed', 2)}", EDGE, ["raw", "weight", "gate"], "select * from prior", whole=True)

GRAPH = """
graph as (select entity, src, tgt, case when (src + tgt) % 3 = 0 and tau = 1 then 0 else tau end as lag, case when te > 0.4 then '-->' when te > 0.2 then 'o-o' when te > 0.1 then 'x-x' else '' end as kind, te as val from (select entity, tau, src, tgt, round(te, 10) as te from te)),
ggrid as (select a.entity, tau, a.var as src, b.var as tgt from (select distinct entity, var from bins) a join (select distinct entity, var from bins) b using (entity), range(1, 4) l(tau)),
lagged as (select entity, lag as tau, src, tgt, case kind when '-->' then val when '' then 0 else val / 2 end as v, case kind when '-->' then 1 when '' then 0 else 0.5 end as g from graph where lag > 0),
at_once as (select entity, src, tgt, val from graph where lag = 0 and kind = '-->'),
merged as (select q.entity, q.tau, q.src, q.tgt, greatest(coalesce(l.v, 0), case when q.tau = 1 then coalesce(o.val, 0) else 0 end, case when q.tau = 1 and q.src = q.tgt then 0.25 else 0 end) as raw,
                  case when q.tau = 1 and (q.src = q.tgt or o.val is not null) then 1 else coalesce(l.g, 0) end as gate
           from ggrid q left join lagged l on l.entity = q.entity and l.tau = q.tau and l.src = q.src and l.tgt = q.tgt left join at_once o on o.entity = q.entity and o.src = q.src and o.tgt = q.tgt),
gp as (select m.*, raw / (select sum(raw) from merged x where x.entity = m.entity and x.tgt = m.tgt) as weight from merged m)"""
for name in ("p11_graph_prior", "p13_built_from_graph"):
    put(name, f"{P_TE},{GRAPH}", EDGE, ["raw", "weight", "gate"], "select * from gp", whole=True)
O["p15_density"] = f"with {P_TE},{GRAPH} select entity, count(*) filter (where gate = 1) as directed, count(*) filter (where gate = 0.5) as ambiguous, count(*) filter (where gate = 0) as empty from gp group by entity"
O["p14_priors_to_compute"] = f"""with u as (select user_id as entity, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as t, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as var, sum(cast(round(value * 100) as bigint)) as x from events group by all)
 select entity, sha256('tau=3|' || count(*) || '|' || sum(('0x' || substr(md5(t || '|' || var || '|' || x), 1, 15))::bigint)) as key from u where entity % 3 <> 0 group by entity"""

put("p14_stored_priors", f"{P_TE},{prior()}", EDGE, ["raw", "weight", "gate", "reused"], "select *, (entity % 2 = 0)::int as reused from prior", whole=True)

# Edges: one row for each, sums by subquery.
E_PRIOR = f"{fx.SCALED},{DIGITS}, bins as (select *, 0 as chunk from digits),{entropy()},{prior()}"
E_WEIGHTS = E_PRIOR + """,
gates as (select entity, tau, src, tgt, (0.05 + 0.95 * gate) * (1 / (1 + exp(-(ln(4) + 0.125 * (ln(c) - ln(1 - c)))))) as gate from (select *, greatest(1e-4, least(gate, 0.9999)) as c from prior)),
logits as (select entity, tau, src, tgt, (src = tgt)::int + 0.6 * ln(greatest(weight, 1e-8)) as logit from prior),
powers as (select l.entity, l.tau, l.src, l.tgt, exp(logit) * gate as e, exp(logit) as x, gate from logits l join gates using (entity, tau, src, tgt)),
weights as (select p.entity, tau, src, p.tgt, e / (total + 1e-12 * top) as weight, gate from powers p join (select entity, tgt, sum(e) as total, max(x) as top from powers group by all) s on s.entity = p.entity and s.tgt = p.tgt)"""
E_EFFECTS = E_WEIGHTS + f""",
effects as (select y.entity, y.t, w.tau, w.src, w.tgt, w.weight * x.z as effect, w.weight * abs(x.z) as strength from (select distinct entity, t from scaled where t >= {TAU}) y join weights w using (entity) join scaled x on x.entity = y.entity and x.t = y.t - w.tau and x.var = w.src),
errors as (select f.entity, f.t, f.tgt, s.z as actual, f.predicted, s.z - f.predicted as err from (select entity, t, tgt, sum(effect) as predicted from effects group by all) f join scaled s on s.entity = f.entity and s.t = f.t and s.var = f.tgt)"""


def gains(name: str, fill: str = "0", where: str = "true") -> str:
    """What the forecast's error grows by when an edge's input is `fill`."""
    return f"{name} as (select e.entity, e.tau, e.src, e.tgt, avg(abs(actual - (predicted - effect + weight * {fill})) - abs(err)) as raw_delta, avg(greatest(abs(actual - (predicted - effect + weight * {fill})) - abs(err), 0)) as positive_delta from effects e join errors r on r.entity = e.entity and r.t = e.t and r.tgt = e.tgt join weights w on w.entity = e.entity and w.tau = e.tau and w.src = e.src and w.tgt = e.tgt where e.{where} group by all)"


E_GAINS = f"{E_EFFECTS}, {gains('gains', where='t >= 0')}"
RUNS_OF = "select * from (select distinct entity from scaled), range(1, 4) s(seed), range(1, 4) e(epoch) where not (entity = 3 and seed > 1)"


def drawn(name: str, runs: str) -> str:
    """(entity, seed, epoch, draw, tau, src): sixteen draws a run by the running shares of the gates' sums."""
    return f"""{name}_mass as (select entity, tau, src, sum(round(gate, 10)) as m from prior group by all),
{name}_even as (select x.entity, tau, src, case when (select sum(m) from {name}_mass y where y.entity = x.entity) > 1e-8 then m else 1 end as m from {name}_mass x),
{name}_cdf as (select x.entity, x.tau, x.src, round((select sum(m) from {name}_even y where y.entity = x.entity and (y.tau, y.src) <= (x.tau, x.src)) / (select sum(m) from {name}_even y where y.entity = x.entity), 10) as hi from {name}_even x),
{name}_u as (select r.*, d.draw, ('0x' || substr(md5(r.entity || '|' || r.seed || '|' || r.epoch || '|' || d.draw), 1, 8))::bigint / 4294967296::double as u from ({runs}) r, range(16) d(draw)),
{name} as (select u.entity, seed, epoch, draw, c.tau, c.src from {name}_u u join {name}_cdf c on c.entity = u.entity and c.hi > u.u and not exists (select 1 from {name}_cdf k where k.entity = u.entity and k.hi > u.u and (k.tau, k.src) < (c.tau, c.src)))"""


E_REF = E_EFFECTS + f""", {gains('train_gains', where=fx.TRAIN)}, {drawn('drawn', 'select distinct entity, 0 as seed, 0 as epoch from scaled')},
worth as (select p.entity, p.tau, p.src, p.tgt, greatest(0, case when exists (select 1 from drawn d where d.entity = p.entity and d.tau = p.tau and d.src = p.src) then g.positive_delta else p.weight end) as v from prior p left join train_gains g on g.entity = p.entity and g.tau = p.tau and g.src = p.src and g.tgt = p.tgt),
ref as (select w.entity, tau, src, w.tgt, case when total > 1e-12 then v / total when tau = 1 and src = w.tgt then 1 else 0 end as v from worth w join (select entity, tgt, sum(v) as total from worth group by all) s on s.entity = w.entity and s.tgt = w.tgt)"""


def edge(name: str, before: str, keys: list[str], columns: list[str], body: str) -> None:
    put(name, before, keys, columns, body, 7, True, " + 0.0")


put("i03_sampled_edges", f"""{E_WEIGHTS}, sums as (select entity, tau, src, sum(round(gate, 10)) as m from prior group by all),
cdf as (select x.entity, x.tau, x.src, round((select sum(m) from sums y where y.entity = x.entity and (y.tau, y.src) <= (x.tau, x.src)) / (select sum(m) from sums y where y.entity = x.entity), 10) as hi from sums x)""", ["entity", "draw", "tau", "src"], [],
    "select c.entity, draw, tau, src from cdf c join range(64) r(draw) on c.hi > (draw + 0.5) / 64::double and not exists (select 1 from cdf k where k.entity = c.entity and k.hi > (draw + 0.5) / 64::double and (k.tau, k.src) < (c.tau, c.src))", whole=True)
put("i03_drawn_edges", f"{E_WEIGHTS}, {drawn('drawn', RUNS_OF)}", ["entity", "seed", "epoch", "draw", "tau", "src"], [], "select * from drawn", whole=True)
edge("i01_rotated_source", fx.SCALED + """,
    p as (select entity, t, z, row_number() over (partition by entity order by t) - 1 as i from scaled where var = 2),
    b as (select *, i // 50 as block, i % 50 as place, least(50, 720 - i // 50 * 50) as n from p)""", ["entity", "t"], ["before", "after"], "select x.entity, x.t, x.z as before, y.z as after from b x join b y on x.entity = y.entity and x.block = y.block and x.place = (y.place + 7) % y.n")
edge("i01_permuted_source", fx.SCALED + """,
    p as (select entity, t, z, (t // 50) as block, ('0x' || substr(md5(entity || '|' || t || '|7'), 1, 8))::bigint as u from scaled where var = 2),
    b as (select p.*, t % 50 as place, (select count(*) from p q where q.entity = p.entity and q.block = p.block and (q.u, q.t) < (p.u, p.t)) as rank from p)""", ["entity", "t"], ["before", "after"], "select x.entity, x.t, x.z as before, y.z as after from b x join b y on x.entity = y.entity and x.block = y.block and y.rank = x.place")
edge("f01_edge_logits", E_WEIGHTS, EDGE, ["logit"], "select * from logits")
edge("f02_edge_gates", E_WEIGHTS, EDGE, ["gate"], "select * from gates")
edge("f04_edge_weights", E_WEIGHTS, EDGE, ["weight", "gate"], "select * from weights")
edge("f05_forecast", E_EFFECTS, ["entity", "t", "tgt"], ["actual", "predicted", "err"], "select * from errors")
edge("f07_reference", E_REF, EDGE, ["v"], "select * from ref")
edge("f08_reference_ema", E_REF, EDGE, ["v"], "select r.entity, r.tau, r.src, r.tgt, 0.9 * r.v + 0.1 * w.weight as v from ref r join weights w using (entity, tau, src, tgt)")
SIMILAR = f"""alike as (select a.entity, a.t, tau, i.var as src, j.var as tgt, (select sum(x.z * y.z) from scaled x join scaled y on x.entity = y.entity and x.t = y.t where x.entity = a.entity and x.var = i.var and y.var = j.var and x.t between a.t - tau - 3 and a.t - tau) / 2 as similarity
 from (select distinct entity, t from scaled) a, range(1, {TAU + 1}) l(tau), range({fx.VARS}) i(var), range({fx.VARS}) j(var))"""
edge("f03_similarity", f"{fx.SCALED}, {SIMILAR}", ["entity", "t", "tau", "src", "tgt"], ["similarity"], "select * from alike")
E_AT = E_REF + f""", {SIMILAR},
now as (select s.entity, s.t, s.tau, s.src, s.tgt, logit + coalesce(similarity, 0) as l, gate from alike s join logits using (entity, tau, src, tgt) join gates using (entity, tau, src, tgt)),
top_now as (select entity, t, tgt, max(l) as top, sum(exp(l) * gate) as total from now group by all),
weights_at as (select n.entity, n.t, n.tau, n.src, n.tgt, exp(l) * gate / (total + 1e-12 * exp(top)) as weight from now n join top_now using (entity, t, tgt)),
w_ref as (select entity, tau, src, tgt, avg(weight) as v from weights_at where {fx.TRAIN} group by all)"""
edge("f03_weights_at", E_AT, ["entity", "t", "tau", "src", "tgt"], ["weight"], "select * from weights_at")
edge("f07_weight_reference", E_AT, EDGE, ["v"], "select * from w_ref")
edge("i02_constant_fill", f"{E_EFFECTS}, {gains('gains', '0.5', 't >= 0')}", EDGE, ["raw_delta", "positive_delta"], "select * from gains")
edge("i04_contributions", E_GAINS, EDGE, ["raw_delta", "positive_delta"], "select * from gains")
_NULLS = "null::double as raw_mean, null::double as raw_max, null::double as positive_mean, null::double as positive_max"
edge("i05_rollups", E_GAINS, ["entity", "tau", "src", "tgt"], ["raw_mean", "raw_max", "positive_mean", "positive_max", "strength"],
     f"select entity, null as tau, src, tgt, sum(raw_delta) / {TAU} as raw_mean, max(raw_delta) as raw_max, sum(positive_delta) / {TAU} as positive_mean, max(positive_delta) as positive_max, null::double as strength from gains group by entity, src, tgt "
     f"union all select entity, tau, src, null, {_NULLS}, sum(positive_delta) from gains group by entity, tau, src union all select entity, tau, null, tgt, {_NULLS}, sum(positive_delta) from gains group by entity, tau, tgt")  # fmt: skip
edge("i06_top_edges", E_GAINS, ["entity", "place", "tau", "src", "tgt"], ["positive_delta"],
     "select g.*, (select count(*) from gains h where h.entity = g.entity and (h.positive_delta > g.positive_delta or h.positive_delta = g.positive_delta and (h.tau * 100 + h.src * 10 + h.tgt) >= (g.tau * 100 + g.src * 10 + g.tgt))) as place from gains g where place <= 10")
edge("i08_alignment", E_GAINS, ["entity"], ["loss"],
     "select a.entity, avg((coalesce(s / nullif(ss, 0), 1.0 / n) - coalesce(p / nullif(pp, 0), 1.0 / n)) ** 2) as loss from (select entity, tgt, sum(strength) as s from effects group by all) a join (select entity, tgt, sum(positive_delta) as p from gains group by all) b on a.entity = b.entity and a.tgt = b.tgt "
     "join (select entity, sum(strength) as ss, count(distinct tgt) as n from effects group by all) c on c.entity = a.entity join (select entity, sum(positive_delta) as pp from gains group by all) d on d.entity = a.entity group by a.entity")  # fmt: skip
edge("m01_error_size", E_EFFECTS, ["entity"], ["mean_abs", "mean_l2"], "select * from (select entity, avg(abs(err)) as mean_abs from errors group by all) join (select entity, avg(l2) as mean_l2 from (select entity, t, sqrt(sum(err ** 2)) as l2 from errors group by all) group by all) using (entity)")
edge("m02_edge_monitors", E_WEIGHTS, ["entity"], ["js", "gate_bce", "sparsity", "monotone", "entropy", "stability", "structure_kl", "max_weight", "max_gate", "mean_weight", "std_weight"],
     f"""select a.entity, sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 / {TAU * fx.VARS} as js, -avg(pg * ln(c) + (1 - pg) * ln(1 - c)) as gate_bce, avg(g) as sparsity, any_value(mono) as monotone, sum(-w * ln(w + 1e-12)) / {fx.VARS} / ln({TAU * fx.VARS}) as entropy,
     avg((w - r) ** 2) as stability, sum(q * ln(q / p)) / {TAU * fx.VARS} as structure_kl, max(w) as max_weight, max(g) as max_gate, avg(w) as mean_weight, stddev_pop(w) as std_weight
     from (select w.entity, w.weight as w, r.weight as r, greatest(w.weight, 1e-8) as p, greatest(r.weight, 1e-8) as q, w.gate as g, r.gate as pg, greatest(1e-4, least(w.gate, 0.9999)) as c from weights w join prior r using (entity, tau, src, tgt)) a
     join (select x.entity, avg(greatest(y.gate - x.gate, 0)) as mono from weights x join weights y on x.entity = y.entity and x.src = y.src and x.tgt = y.tgt and y.tau = x.tau + 1 group by all) b on a.entity = b.entity group by a.entity""")  # fmt: skip
edge("m07_environment_variance", E_EFFECTS, ["entity"], ["variance"], f"select entity, avg(v) as variance from (select entity, tau, src, tgt, avg(m * m) - avg(m) ** 2 as v from (select entity, tau, src, tgt, (t - {TAU}) * 4 // {fx.HOURS - TAU} as env, avg(strength) as m from effects group by all) group by entity, tau, src, tgt) group by entity")
edge("g01_error_score", E_EFFECTS, ["entity", "t"], ["p_mean", "p_max", "p_top"], "select entity, t, avg(abs(err)) as p_mean, max(abs(err)) as p_max, list_sum(list_slice(list_reverse_sort(list(abs(err))), 1, 2)) / 2 as p_top from errors group by all")


def deviation(name: str, values: str, ref: str) -> str:
    """Per time: the root mean square deviation of each lag, and the mean deviation of its rows, over lags."""
    return f"""{name}_d as (select n.entity, n.t, n.tau, n.src, n.v - r.v as d from ({values}) n join {ref} r on r.entity = n.entity and r.tau = n.tau and r.src = n.src and r.tgt = n.tgt),
{name}_l as (select entity, t, tau, sqrt(avg(d * d) + 1e-12) as fro from {name}_d group by all),
{name}_r as (select entity, t, tau, list_reverse_sort(list(m)) as rows from (select entity, t, tau, src, avg(abs(d)) as m from {name}_d group by all) group by all),
{name} as (select entity, t, avg(fro) as c_mean, max(fro) as c_max, avg(rows[1]) as row_mean, avg((rows[1] + rows[2] + rows[3]) / 3) as top_mean from {name}_l join {name}_r using (entity, t, tau) group by entity, t)"""


_STRENGTHS = "select e.entity, e.t, e.tau, e.src, e.tgt, case when total > 1e-12 then strength / total when tau = 1 and src = e.tgt then 1 else 0 end as v from effects e join (select entity, t, tgt, sum(strength) as total from effects group by all) s on s.entity = e.entity and s.t = e.t and s.tgt = e.tgt"
E_DEV = f"{E_AT}, {deviation('dev_c', _STRENGTHS, 'ref')}, {deviation('dev_g', 'select entity, t, tau, src, tgt, weight as v from weights_at', 'w_ref')}"
_C = ["c_mean", "c_max", "row_mean", "top_mean"]
edge("g04_strength_deviation", E_DEV, ["entity", "t"], _C, "select * from dev_c")
edge("g05_weight_deviation", E_DEV, ["entity", "t"], _C, "select * from dev_g")
E_COMB = E_DEV + """,
comb as (select p.entity, p.t, p.p, c.c_mean as c, g.c_mean as g, (c.c_mean + g.c_mean) / 2 as s, p.p * (c.c_mean + g.c_mean) / 2 as a from (select entity, t, avg(abs(err)) as p from errors group by all) p join dev_c c on c.entity = p.entity and c.t = p.t join dev_g g on g.entity = p.entity and g.t = p.t)"""
edge("g06_combined_score", E_COMB, ["entity", "t"], ["p", "c", "g", "s", "a"], "select * from comb")


def calibrated(raw: str, keys: list[str]) -> str:
    """From raw scores (keys, t, p, c, g) to scores: centre and scale of each component over the training hours, then the products."""
    k, on = ", ".join(keys), lambda a, b: " and ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    parts = " union all ".join(f"select {k}, t, {i} as component, {c} as x from {raw}" for i, c in enumerate("pcg"))
    same_ = f"{on('v', 'm')} and v.component = m.component"
    return f"""long as ({parts}),
mid as (select {k}, component, median(x) as centre, stddev_pop(x) as sd from long where {fx.TRAIN} group by all),
robust as (select {', '.join(f'm.{x}' for x in keys)}, m.component, any_value(centre) as centre, case when 1.4826 * median(abs(x - centre)) >= 1e-6 then 1.4826 * median(abs(x - centre)) when any_value(sd) >= 1e-6 then any_value(sd) else 1 end as scale from long v join mid m on {same_} where {fx.TRAIN} group by {', '.join(f'm.{x}' for x in keys)}, m.component),
zs as (select v.*, greatest((x - centre) / greatest(scale, 1e-6), 0) as z from long v join robust m on {same_}),
cal as (select a.{k.replace(', ', ', a.')}, a.t, a.z as p, b.z as c, d.z as g, b.z + d.z as s, a.z * (b.z + d.z) as a from zs a join zs b on {on('a', 'b')} and a.t = b.t join zs d on {on('a', 'd')} and a.t = d.t where a.component = 0 and b.component = 1 and d.component = 2)"""


E_ROBUST = f"{E_COMB}, raw1 as (select entity, t, round(p, 6) as p, round(c, 6) as c, round(g, 6) as g from comb), {calibrated("raw1", ["entity"])}"
edge("g07_robust_scale", E_ROBUST, ["entity", "component"], ["centre", "scale"], "select * from robust")
edge("g08_robust_z", E_ROBUST, ["entity", "t"], ["p", "c", "g", "s", "a"], "select * from cal")
O["g10_scored_quality"] = f"with {E_ROBUST}{fx._LABELS}, scores as (select v.entity, v.t, y, round(v.a, 6) as score from cal v join labels l on l.entity = v.entity and l.t = v.t),{RANKS} select entity, round(auc_roc, 7) as auc_roc, round(auc_pr, 7) as auc_pr, round(f1, 7) as f1 from ranks"
_LONG = " union all ".join(f"select entity, t, '{k.upper()}' as component, round({k}, 5) as score from comb" for k in "pcgsa")
# Results over runs: nine metrics of each; the affiliation's are from the text of the operator, which tests hold against integration.
NINE = ["auc_pr", "auc_roc", "f1", "pa_f1", "event_f1", "r_f", "aff_f", "vus_roc", "vus_pr"]


def nine(windows: str) -> str:
    """The metrics of `scores`, whose entity may name a run."""
    aff = ql.text(bt.AFFILIATION_F, ["entity"]).format(affiliation=f"({qq.AFF})")
    return f"{RANKS},{SWEEP},{RANGES},{vus(windows)}, nine as (select r.*, pa_f1, event_f1, r_f, aff_f, vus_roc, vus_pr from ranks r left join pa using (entity) left join evf using (entity) left join rf using (entity) left join ({aff}) using (entity) left join vm using (entity))"


put("q26_report", f"{SLICED},{nine(WIDTHS)}", ["entity"], NINE, "select * from nine")
E_PARTS = f"{E_COMB}{fx._LABELS}, scores as (select l.entity || '|' || component as entity, l.t, y, score from ({_LONG}) l join labels b on b.entity = l.entity and b.t = l.t), {nine(WIDTHS)}"
O["q27_component_quality"] = f"with {E_PARTS} select cast(split_part(entity, '|', 1) as bigint) as entity, split_part(entity, '|', 2) as component, {', '.join(f'round({m}, 6) as {m}' for m in NINE)} from nine"
#: Runs: references folded epoch by epoch, one after the other.
_SHARE = "case when sum(greatest({v}, 0)) over (partition by {k}) > 1e-12 then greatest({v}, 0) / sum(greatest({v}, 0)) over (partition by {k}) when tau = 1 and src = tgt then 1 else 0 end"


def folded(e: int) -> str:
    """Both references after epoch e, from those before."""
    first = e == 1
    before = "prior" if first else f"cls{e - 1}"
    at = " and ".join(f"b.{x} = r.{x}" for x in ["entity", "tau", "src", "tgt", *([] if first else ["seed"])])
    new = f"""got{e} as (select r.entity, r.seed, b.tau, b.src, b.tgt, case when exists (select 1 from drawn d where d.entity = r.entity and d.seed = r.seed and d.epoch = {e} and d.tau = b.tau and d.src = b.src) then g.positive_delta else b.{'weight' if first else 'v'} end as v
 from (select distinct entity, seed from ({RUNS_OF})) r join {before} b on b.entity = r.entity{'' if first else ' and b.seed = r.seed'} left join gains{e} g on g.entity = r.entity and g.tau = b.tau and g.src = b.src and g.tgt = b.tgt),
new{e} as (select entity, seed, tau, src, tgt, {_SHARE.format(v='v', k='entity, seed, tgt')} as v from got{e}),
wnew{e} as (select entity, tau, src, tgt, avg(weight) as v from weights_at where {fx.TRAIN} and t * 3 // {fx.SPLIT} = {e - 1} group by all)"""
    if first:
        return new + f", cls{e} as (select * from new{e}), wref{e} as (select * from wnew{e})"
    return new + f""", mix{e} as (select r.entity, r.seed, r.tau, r.src, r.tgt, 0.9 * b.v + 0.1 * r.v as v from new{e} r join cls{e - 1} b on {at}),
cls{e} as (select entity, seed, tau, src, tgt, {_SHARE.format(v='v', k='entity, seed, tgt')} as v from mix{e}),
wref{e} as (select r.entity, r.tau, r.src, r.tgt, 0.9 * b.v + 0.1 * r.v as v from wnew{e} r join wref{e - 1} b on b.entity = r.entity and b.tau = r.tau and b.src = r.src and b.tgt = r.tgt)"""


_PARTS = ", ".join(gains(f"gains{e}", where=f"{fx.TRAIN} and e.t * 3 // {fx.SPLIT} = {e - 1}") for e in (1, 2, 3))
E_RUNS = f"""{E_AT}, {_PARTS}, {drawn('drawn', RUNS_OF)}, {', '.join(map(folded, (1, 2, 3)))},
cls_all as (select *, 1 as epoch from cls1 union all select *, 2 from cls2 union all select *, 3 from cls3), w_all as (select *, 1 as epoch from wref1 union all select *, 2 from wref2 union all select *, 3 from wref3)""".replace("drawn as (", "drawn_ as (", 0)
E_RUNS = E_RUNS.replace(drawn('drawn', 'select distinct entity, 0 as seed, 0 as epoch from scaled'), drawn('drawn0', 'select distinct entity, 0 as seed, 0 as epoch from scaled')).replace("from drawn d where d.entity = p.entity", "from drawn0 d where d.entity = p.entity")
edge("f08_weight_references", E_RUNS, [*EDGE, "epoch"], ["ref"], "select *, v as ref from w_all")
edge("f08_gain_references", E_RUNS, [*EDGE, "seed", "epoch"], ["ref"], "select *, v as ref from cls_all")


def run_deviation(name: str, values: str, refs: str, keys: str) -> str:
    """Per run and time: the mean over lags of the root mean square deviation."""
    return f"{name} as (select {keys}, t, avg(fro) as v from (select n.entity, {keys.replace('entity, ', '')}, n.t, n.tau, sqrt(avg((n.v - r.v) ** 2) + 1e-12) as fro from ({values}) n join {refs} r on r.entity = n.entity and r.tau = n.tau and r.src = n.src and r.tgt = n.tgt group by all) group by all)"


E_RUN_SCORES = f"""{E_RUNS}, {run_deviation('run_c', _STRENGTHS, 'cls_all', 'entity, seed, epoch')}, {run_deviation('run_g', 'select entity, t, tau, src, tgt, weight as v from weights_at', 'w_all', 'entity, epoch')},
run_p as (select entity, t, avg(abs(err)) as v from errors group by all),
raw2 as (select c.entity, c.seed, c.epoch, c.t, round(p.v, 6) as p, round(c.v, 6) as c, round(g.v, 6) as g from run_c c join run_g g on g.entity = c.entity and g.epoch = c.epoch and g.t = c.t join run_p p on p.entity = c.entity and p.t = c.t), {calibrated("raw2", ["entity", "seed", "epoch"])}"""
_RUNS = f"""{E_RUN_SCORES}{fx._LABELS},
scores as (select v.entity || '|' || seed || '|' || epoch as entity, v.t, y, round(v.a, 6) as score from cal v join labels l on l.entity = v.entity and l.t = v.t)"""
_ROUNDED = ", ".join(f"round({m}, 9) as {m}" for m in NINE)
_MISSING = "seed = 2 and epoch = 2"
RUNS = f"""{_RUNS},{nine("select distinct entity, 4 as win from scores")},
metrics as (select cast(split_part(entity, '|', 1) as bigint) as entity, cast(split_part(entity, '|', 2) as bigint) as seed, cast(split_part(entity, '|', 3) as bigint) as epoch, {_ROUNDED} from nine),
good as (select * replace (case when {_MISSING} then null else f1 end as f1, case when {_MISSING} then null else auc_pr end as auc_pr, case when {_MISSING} then null else vus_pr end as vus_pr) from metrics)"""


def _stats(keys: str, sd: str) -> str:
    return f"select {keys}, " + ", ".join(f"avg({m}) as {m}_mean, {sd}({m}) as {m}_std" for m in NINE) + f" from good group by {keys}"


_STATS = [f"{m}_{x}" for m in NINE for x in ("mean", "std")]
_MEANS = [f"{m}_mean" for m in NINE]
EPOCHS = f"{RUNS}, epochs as ({_stats('entity, epoch', 'stddev_samp')}), sums as (select *, coalesce(auc_pr_mean, 0) + coalesce(auc_roc_mean, 0) + coalesce(vus_pr_mean, 0) + coalesce(vus_roc_mean, 0) + coalesce(f1_mean, 0) + coalesce(aff_f_mean, 0) as total from epochs)".replace("sums as (select *, coalesce", "totals as (select *, coalesce")
BEST = f"{EPOCHS}, best as (select * from totals a where not exists (select 1 from totals b where b.entity = a.entity and (b.total > a.total or b.total = a.total and b.epoch < a.epoch)))"
put("a01_over_seeds", RUNS, ["entity"], _STATS, _stats("entity", "stddev_pop"), 7)
put("a02_over_epochs", EPOCHS, ["entity", "epoch"], _STATS, "select * from epochs", 7)
put("a03_best_epoch", BEST, ["entity", "epoch"], ["total"], "select * from best", 7)
put("a04_macro_average", BEST, ["name"], _MEANS, f"select cast(entity as varchar) as name, {', '.join(_MEANS)} from best union all select 'MACRO_AVG', {', '.join(f'avg({m})' for m in _MEANS)} from best", 7)
put("a06_percent", EPOCHS, ["entity", "epoch"], ["percent"], "select entity, epoch, round(100 * auc_roc_mean, 2) as percent from epochs", 7)
put("a07_epoch_metrics", RUNS, ["entity", "seed", "epoch"], ["auc_roc", "pa_f1", "event_f1", "r_f", "aff_f", "vus_roc"], "select * from metrics", 7)
