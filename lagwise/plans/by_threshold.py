"""SQL of the affiliation by threshold, for engines that hold the results against it.

It copies the points for each threshold, builds its segments, clips them to the zones and integrates by piece; the
operators do none of this. $k stands for the keys, {name} for a table.
"""

from __future__ import annotations

#: Points with their place i, and nb, the number of thresholds below the score; seg: the run of labels that holds it.
POINTS = """
p0 as (select $k, t, y, score, cast(row_number() over (partition by $k order by t) - 1 as bigint) as i,
              min(score) over (partition by $k) as lo, max(score) over (partition by $k) as hi, sum(1 - y) over (partition by $k order by t) as normal from {scores} where score is not null),
p1 as (select *, (hi - lo) / 99e0 as st, cast(floor((score - lo) / nullif((hi - lo) / 99e0, 0e0)) as bigint) as j from p0),
pts as (select $k, t, i, y, score, case when y > 0 then normal end as seg,
               cast(greatest(coalesce(j, 0) - 1, 0) + case when j between 1 and 100 and score > lo + (j - 1) * st then 1 else 0 end
               + case when j between 0 and 99 and score > case when j = 99 then hi else lo + j * st end then 1 else 0 end
               + case when j between 0 and 98 and score > case when j = 98 then hi else lo + (j + 1) * st end then 1 else 0 end as bigint) as nb from p1),
thr as (select $k, i as th from (select distinct $k from pts) a cross join range(100) r(i))"""

#: Zones of true events: halfway to the neighbours, the outer ones to the ends of the series.
ZONES = POINTS + """,
tr as (select $k, seg, cast(min(i) as double) as js, max(i) + 1e0 as je from pts where y > 0 group by $k, seg),
sz as (select $k, count(*) as n from pts group by $k),
zn as (select $k, seg, js, je, coalesce((lag(je) over (partition by $k order by js) + js) / 2e0, 0e0) as e0, coalesce((je + lead(js) over (partition by $k order by js)) / 2e0, n * 1e0) as e1 from tr join sz using ($k))"""


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


#: Precision, recall and their distances of each zone and threshold that has predictions in it.
AFFILIATION_ZONES = (
    "with "
    + ZONES
    + """,
up as (select $k, th, i, i - row_number() over (partition by $k, th order by i) as ps from (select $k, r.th as th, p.i from pts p join range(100) r(th) on r.th < p.nb) x),
ev as (select $k, th, cast(min(i) as double) as s, max(i) + 1e0 as e from up group by $k, th, ps),
pc as (select $k, th, seg, js, je, e0, e1, greatest(s, e0) as a, least(e, e1) as b from ev join zn using ($k) where greatest(s, e0) < least(e, e1)),
nb as (select *, coalesce((lag(b) over (partition by $k, th, seg order by a) + a) / 2e0, js) as r0, coalesce((b + lead(a) over (partition by $k, th, seg order by a)) / 2e0, je) as r1 from pc),
jr as (select *, greatest(js, r0) as j0, least(je, r1) as j1 from nb)
select $k, th, seg, sum(b - a) as pred_len,
       sum("""
    + _outside("a", "least(b, js)") + " + greatest(0e0, least(b, je) - greatest(a, js)) + " + _outside("greatest(a, je)", "b")
    + """) / sum(b - a) as precision_p,
       sum(case when j1 > j0 then """
    + _recall("j0", "least(j1, a)", "a", True) + " + greatest(0e0, least(j1, b) - greatest(j0, a)) + " + _recall("greatest(j0, b)", "j1", "b", False)
    + """ else 0e0 end) / max(je - js) as recall_p,
       sum(power(greatest(0e0, js - a), 2) / 2e0 - power(greatest(0e0, js - b), 2) / 2e0 + power(greatest(0e0, b - je), 2) / 2e0 - power(greatest(0e0, a - je), 2) / 2e0) / sum(b - a) as precision_d,
       sum(case when j1 > j0 then power(greatest(0e0, a - j0), 2) / 2e0 - power(greatest(0e0, a - j1), 2) / 2e0 + power(greatest(0e0, j1 - b), 2) / 2e0 - power(greatest(0e0, j0 - b), 2) / 2e0 else 0e0 end) / max(je - js) as recall_d
from jr group by $k, th, seg"""
)
AFFILIATION = """
with nz as (select $k, count(*) as zones from (select $k, n0 from (select $k, sum(1 - y) over (partition by $k order by t) as n0, y from {scores} where score is not null) x where y > 0 group by $k, n0) z group by $k)
select $k, th, avg(precision_p) as aff_precision, sum(recall_p) / max(zones * 1e0) as aff_recall from {zones} join nz using ($k) group by $k, th"""
AFFILIATION_F = "select $k, max(2e0 * aff_precision * aff_recall / (aff_precision + aff_recall + 1e-15)) as aff_f from {affiliation} group by $k"
