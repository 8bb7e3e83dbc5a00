"""Forecasts from weighted lagged edges, and aggregates that watch the edge tables.

An edge table is (by, tau, src, tgt, ...); series are (by, var, t, z). $k stands for the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.frames import Query, sql
from .prior import fill

LOGITS = "select $k, tau, src, tgt, gate, case when src = tgt then <BIAS> else 0e0 end + (<INIT> + <BLEND>) * ln(greatest(weight, 1e-8)) as logit from {prior}"
GATES = """
select $k, tau, src, tgt, (0.05e0 + 0.95e0 * gate) / (1e0 + exp(-(ln(<GATE> / (1e0 - <GATE>)) + 0.5e0 * <INIT> * ln(least(greatest(gate, 1e-4), 0.9999e0) / (1e0 - least(greatest(gate, 1e-4), 0.9999e0)))))) as gate from {prior}"""
SOFTMAX = {
    "s": "select *, exp((logit - max(logit) over (partition by $k, tgt)) / <TEMP>) * gate as e from {logits}",
    "result": "select $k, tau, src, tgt, e / (sum(e) over (partition by $k, tgt) + 1e-12) as weight from {s} s",
}
#: Values normalised over (tau, src) per target, a target without mass keeping itself at lag 1.
#: What an edge is worth: its mean gain where it was intervened on, else the reference before, else the prior's weight, else itself.
GAIN_REFERENCE = "select $k, tau, src, tgt, coalesce(g.positive_delta, o.v, p.weight, case when tau = 1 and src = tgt then 1e0 else 0e0 end) as v from {prior} p left join {gains} g using ($k, tau, src, tgt) left join {before} o using ($k, tau, src, tgt)"
NORMAL = "select $k, tau, src, tgt, case when sum(greatest(v, 0e0)) over (partition by $k, tgt) > 1e-12 then greatest(v, 0e0) / sum(greatest(v, 0e0)) over (partition by $k, tgt) when tau = 1 and src = tgt then 1e0 else 0e0 end as v from {edges}"
MONITORS = {
    "a": "select $k, tau, src, tgt, greatest(w.weight, 1e-8) as p, greatest(p.weight, 1e-8) as q, w.weight as w, p.weight as r, w.gate as g, least(greatest(w.gate, 1e-4), 0.9999e0) as gc, p.gate as pg from {weights} w join (select $k, tau, src, tgt, weight, gate from {prior}) p using ($k, tau, src, tgt)",
    "b": "select *, lead(g) over (partition by $k, src, tgt order by tau) as g2 from {a} a",
    "n": "select $k, count(distinct tgt) as n_var, max(tau) as n_tau from {a} a group by $k",
    "e": "select $k, tgt, sum(-w * ln(w + 1e-12)) as h from {a} a group by $k, tgt",
    "h": "select $k, avg(h) as h from {e} e group by $k",
    "result": "select $k, sum(0.5e0 * (p * ln(p / ((p + q) / 2e0)) + q * ln(q / ((p + q) / 2e0)))) / max(n_tau * n_var * 1e0) as js, avg(-(pg * ln(gc) + (1e0 - pg) * ln(1e0 - gc))) as gate_bce, avg(g) as sparsity, coalesce(avg(case when g2 is not null then greatest(g2 - g, 0e0) end), 0e0) as monotone, max(h / ln(n_tau * n_var * 1e0)) as entropy, avg(power(w - r, 2)) as stability, sum(q * (ln(q) - ln(p))) / max(n_tau * n_var * 1e0) as structure_kl, max(w) as max_weight, max(g) as max_gate, avg(w) as mean_weight, stddev_pop(w) as std_weight from {b} b join {n} n using ($k) join {h} h using ($k) group by $k",
}
ERROR_SIZE = {
    "r": "select $k, t, sum(err * err) as s2, sum(abs(err)) as s1, count(*) as n from {errors} group by $k, t",
    "result": "select $k, sum(s1) / sum(n) as mean_abs, avg(sqrt(s2)) as mean_l2 from {r} r group by $k",
}
ROLLUP = """
select $k, 'lags' as part, cast(null as int) as tau, src, tgt, avg(raw_delta) as raw_mean, max(raw_delta) as raw_max, avg(positive_delta) as positive_mean, max(positive_delta) as positive_max, cast(null as double) as strength from {gains} group by $k, src, tgt
union all select $k, 'source', tau, src, cast(null as int), null, null, null, null, sum(positive_delta) from {gains} group by $k, tau, src
union all select $k, 'target', tau, cast(null as int), tgt, null, null, null, null, sum(positive_delta) from {gains} group by $k, tau, tgt"""
TOP = {
    "p": "select *, row_number() over (partition by $k order by positive_delta desc, tau desc, src desc, tgt desc) as place from {gains}",
    "result": "select $k, place, tau, src, tgt, positive_delta from {p} p where place <= <N>",
}
ALIGNMENT = {
    "t": "select $k, tgt, sum(strength) as s from {effects} group by $k, tgt",
    "g": "select $k, tgt, sum(positive_delta) as p from {gains} group by $k, tgt",
    "n": "select $k, tgt, coalesce(s / nullif(sum(s) over (partition by $k), 0e0), 1e0 / count(*) over (partition by $k)) as a, coalesce(p / nullif(sum(p) over (partition by $k), 0e0), 1e0 / count(*) over (partition by $k)) as b from {t} t join {g} g using ($k, tgt)",
    "result": "select $k, avg(power(a - b, 2)) as loss from {n} n group by $k",
}
#: Lag-tau inputs of one source, rotated by <SHIFT> places within blocks of <BLOCK> rows (a block of one row stays).
ROTATE = {
    "p": "select $k, t, z, row_number() over (partition by $k order by t) - 1 as i from {series} where var = <SRC>",
    "b": "select *, floor(i / <BLOCK>e0) as block, count(*) over (partition by $k, floor(i / <BLOCK>e0)) as n from {p} p",
    "r": "select $k, block, t, z, n, row_number() over (partition by $k, block order by t) - 1 as place from {b} b",
    "result": "select $k, t, z as before, v as after from {r} r join (select $k, block, (place + <SHIFT>) % n as place, z as v from {r} r) s using ($k, block, place)",
}
RUN = {"BIAS": "1e0", "INIT": "2.5e-1", "BLEND": "3.5e-1", "GATE": "8e-1", "TEMP": "1e0"}


def run(template: Query, by: list[str], frames: dict[str, DataFrame], **numbers: object) -> DataFrame:
    return sql(fill(template, by, **{**RUN, **numbers}), **frames)


def weights(prior: DataFrame, by: list[str]) -> DataFrame:
    """The softmax of a prior's edges per target, with their effective gates: (by, tau, src, tgt, weight, gate)."""
    gates = run(GATES, by, {"prior": prior})
    logits = run(LOGITS, by, {"prior": prior}).drop("gate").join(gates, [*by, "tau", "src", "tgt"])
    return run(SOFTMAX, by, {"logits": logits}).join(gates, [*by, "tau", "src", "tgt"])


def gain_reference(gains: DataFrame, prior: DataFrame, by: list[str], sampled: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """(by, tau, src, tgt, v), normalised over (tau, src) per target; gains count for the sampled (by, tau, src) only, if given."""
    if sampled is not None:
        gains = gains.join(sampled.select(*by, "tau", "src").distinct(), [*by, "tau", "src"], "left_semi")
    if before is None:
        before = prior.where("false").selectExpr(*by, "tau", "src", "tgt", "weight as v")
    return run(NORMAL, by, {"edges": run(GAIN_REFERENCE, by, {"gains": gains, "prior": prior, "before": before})})
