"""Causal priors: transfer entropy between lagged variables, conditional on a confounder or not, and graph tables.

Cells are (by, var, t, x) without gaps in t. A prior is (by, tau, src, tgt, raw, weight, gate).
"""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Query, each, sql
from .quality import text

#: Bins of equal width between a variable's least and largest value, numbered from 0; a constant has bin 0.
DIGITISE = """
select $k, var, t, case when x is not null then least(<B> - 1, greatest(0, cast(floor((x - lo) / (case when hi > lo then hi - lo else 1e0 end) * <B>) as int))) end as b
from (select *, min(x) over (partition by $k, var) * 1e0 as lo, max(x) over (partition by $k, var) * 1e0 as hi from {cells}) r where x is not null"""
EDGES = """
select $k, var, i as edge, coalesce(lo, 0e0) + i * (case when coalesce(hi, 1e0) > coalesce(lo, 0e0) then coalesce(hi, 1e0) - coalesce(lo, 0e0) else 1e0 end) / <B> as x
from (select $k, var, min(x) * 1e0 as lo, max(x) * 1e0 as hi from {cells} group by $k, var) r cross join range(1, <B>) e(i)"""
#: Per chunk, lag and pair: counts of (y now, y before, x tau before), from which the entropy follows.
ENTROPY = {
    "y": "select $k, var, chunk, t, b, lag(b) over (partition by $k, chunk, var order by t) as p, t - min(t) over (partition by $k, chunk, var) as pos, count(*) over (partition by $k, chunk, var) as n from {bins}",
    "xs": "select $k, chunk, t as tx, var as src, b as xp from {bins}",
    "j": "select $k, chunk, tau, src, tgt, n, yt, yp, xp from (select $k, chunk, var as tgt, n, b as yt, p as yp, t - tau as tx, tau from {y} y cross join range(1, <T> + 1) l(tau) where pos >= tau and n - tau > 1) q join {xs} xs using ($k, chunk, tx) where src <> tgt",
    "c": "select $k, chunk, tau, src, tgt, n, yt, yp, xp, count(*) * 1e0 as c from {j} j group by $k, chunk, tau, src, tgt, n, yt, yp, xp",
    "m": "select *, sum(c) over (partition by $k, chunk, tau, src, tgt, yp) as cy, sum(c) over (partition by $k, chunk, tau, src, tgt, yp, xp) as cyx, sum(c) over (partition by $k, chunk, tau, src, tgt, yt, yp) as cyy from {c} c",
    "e": "select $k, chunk, tau, src, tgt, greatest(sum(c / (n - tau) * ln((c * cy + 1e-12) / (cyx * cyy + 1e-12))) / ln(2e0), 0e0) as te from {m} m group by $k, chunk, tau, src, tgt",
    "result": "select $k, tau, src, tgt, avg(te) as te from {e} e group by $k, tau, src, tgt",
}
CONFOUNDERS = {
    "r": "select $k, src, tgt, max(te) as te from {te} group by $k, src, tgt",
    "h": "select $k, coalesce(<MEDIAN>, 0.1e0) as th from (select $k, case when te > 0 then te end as te from {r} r) q group by $k",
    "c": "select $k, st.src, st.tgt, zs.src as z, zs.te + zt.te as score from {r} st join (select $k, src, tgt as to_src, te from {r} r) zs using ($k) join (select $k, src as z2, tgt as to_tgt, te from {r} r) zt using ($k) join (select $k, src as s2, tgt as z3, te from {r} r) sz using ($k) join {h} h using ($k) where zs.to_src = st.src and zt.z2 = zs.src and zt.to_tgt = st.tgt and sz.s2 = st.src and sz.z3 = zs.src and zs.src <> st.tgt and zs.te > th and zt.te > th and sz.te < zs.te * 0.5e0",
    "result": "select $k, src, tgt, z, score from (select *, row_number() over (partition by $k, src, tgt order by score desc, z) as place from {c} c) p where place = 1",
}
CONDITIONAL = {
    "y": "select $k, var, chunk, t, b, lag(b) over (partition by $k, chunk, var order by t) as p, t - min(t) over (partition by $k, chunk, var) as pos, count(*) over (partition by $k, chunk, var) as n from {bins}",
    "xs": "select $k, chunk, t as tx, var as src, b as xp from {bins}",
    "zs": "select $k, chunk, t as tz, var as z, least(greatest(cast(floor(b * <Z> / (<B> * 1e0)) as int), 0), <Z> - 1) as zp from {bins}",
    "j": "select $k, chunk, tau, src, tgt, n, yt, yp, zp, xp from (select $k, chunk, y.var as tgt, n, b as yt, p as yp, t - 1 as tz, t - tau as tx, tau from {y} y cross join range(1, <T> + 1) l(tau) where pos >= tau and n - tau > 1) q join {confounders} f using ($k, tgt) join {xs} xs using ($k, chunk, tx, src) join {zs} zs using ($k, chunk, tz, z)",
    "c": "select $k, chunk, tau, src, tgt, n, yt, yp, zp, xp, count(*) * 1e0 as c from {j} j group by $k, chunk, tau, src, tgt, n, yt, yp, zp, xp",
    "m": "select *, sum(c) over (partition by $k, chunk, tau, src, tgt, yp, zp) as cc, sum(c) over (partition by $k, chunk, tau, src, tgt, yp, zp, xp) as cx, sum(c) over (partition by $k, chunk, tau, src, tgt, yt, yp, zp) as cy from {c} c",
    "e": "select $k, chunk, tau, src, tgt, greatest(sum(c / (n - tau) * ln((c * cc + 1e-12) / (cx * cy + 1e-12))) / ln(2e0), 0e0) as te from {m} m group by $k, chunk, tau, src, tgt",
    "result": "select $k, tau, src, tgt, avg(te) as te from {e} e group by $k, tau, src, tgt",
}
TWO_STAGE = "select $k, tau, src, tgt, coalesce(c.te, u.te) as te from {te} u left join {conditional} c using ($k, tau, src, tgt)"
#: Entropies to a prior: prune, give each variable mass on itself at lag 1, normalise per target, gate by the upper quartile.
NORMALISE = {
    "v": "select $k, var from {variables}",
    "g": "select $k, tau, s.var as src, tgt from (select $k, var from {v} v) s join (select $k, var as tgt from {v} v) t using ($k) cross join range(1, <T> + 1) l(tau)",
    "r": "select $k, tau, src, tgt, case when tau = 1 and src = tgt then greatest(case when coalesce(te, 0e0) < <MIN> then 0e0 else coalesce(te, 0e0) end, <SELF>) else case when coalesce(te, 0e0) < <MIN> then 0e0 else coalesce(te, 0e0) end end as raw from {g} g left join {te} e using ($k, tau, src, tgt)",
    "q": "select $k, coalesce(<UPPER>, 1e0) as scale from (select $k, case when raw > 0 then raw end as raw from {r} r) p group by $k",
    "result": "select $k, tau, src, tgt, raw, case when sum(raw) over (partition by $k, tgt) > 1e-12 then raw / sum(raw) over (partition by $k, tgt) when tau = 1 and src = tgt then 1e0 else 0e0 end as weight, case when tau = 1 and src = tgt then 1e0 else least(greatest(raw / greatest(scale, 1e-12), 0e0), 1e0) end as gate from {r} r join {q} q using ($k)",
}
#: A discovered graph to entropies: arrows count fully, ambiguous edges half; an edge without lag counts at lag 1.
GRAPH = """
select $k, greatest(lag, 1) as tau, src, tgt, max(case when edge_type = '-->' then abs(val) when edge_type in ('o-o', 'x-x') and lag > 0 then abs(val) / 2e0 else 0e0 end) as te,
       max(case when edge_type = '-->' then 1e0 when edge_type in ('o-o', 'x-x') and lag > 0 then 0.5e0 else 0e0 end) as gate from {graph} group by $k, greatest(lag, 1), src, tgt"""
#: That graph's prior: self mass, weights over (tau, src) per target; gates as the edges have them, a variable's own at lag 1 open.
GRAPH_PRIOR = {
    "v": "select $k, var from {variables}",
    "g": "select $k, tau, src, tgt from (select $k, var as src from {v} v) s join (select $k, var as tgt from {v} v) t using ($k) cross join range(1, <T> + 1) l(tau)",
    "r": "select $k, tau, src, tgt, greatest(coalesce(te, 0e0), case when tau = 1 and src = tgt then <SELF> else 0e0 end) as raw, case when tau = 1 and src = tgt then 1e0 else coalesce(gate, 0e0) end as gate from {g} g left join {edges} e using ($k, tau, src, tgt)",
    "result": "select $k, tau, src, tgt, raw, case when sum(raw) over (partition by $k, tgt) > 1e-12 then raw / sum(raw) over (partition by $k, tgt) when tau = 1 and src = tgt then 1e0 else 0e0 end as weight, gate from {r} r",
}
DENSITY = "select $k, count(case when gate = 1 then 1 end) as directed, count(case when gate > 0 and gate < 1 then 1 end) as ambiguous, count(case when gate = 0 then 1 end) as empty from {prior} group by $k"

SPARK = {"MEDIAN": "percentile(te, 0.5)", "UPPER": "percentile(raw, 0.75)"}
DUCK = {"MEDIAN": "quantile_cont(te, 0.5)", "UPPER": "quantile_cont(raw, 0.75)"}


def fill(template: Query, by: list[str], dialect: dict[str, str] = SPARK, **numbers: float) -> Query:
    def put(out: str) -> str:
        for name, value in {**dialect, **{k: str(v) for k, v in numbers.items()}}.items():
            out = out.replace(f"<{name}>", value)
        return out

    return each(text(template, by), put)


def digitise(cells: DataFrame, by: list[str], bins: int = 8) -> DataFrame:
    return sql(fill(DIGITISE, by, B=bins), cells=cells)


def bin_edges(cells: DataFrame, by: list[str], bins: int = 8) -> DataFrame:
    return sql(fill(EDGES, by, B=bins), cells=cells)


def transfer_entropy(bins: DataFrame, by: list[str], tau_max: int) -> DataFrame:
    """(by, tau, src, tgt, te): bits that src tau before tells about tgt beyond tgt itself, averaged over chunks.

    Rows meet by (by, chunk, t) and are counted at once: a pair and lag keep at most bins^3 counts a chunk.
    """
    return sql(fill(ENTROPY, by, T=tau_max), bins=bins)


def confounders(te: DataFrame, by: list[str]) -> DataFrame:
    """For each pair the variable that drives both most, if there is one: both above the median, the way back below half."""
    return sql(fill(CONFOUNDERS, by), te=te)


def conditional_entropy(bins: DataFrame, found: DataFrame, by: list[str], tau_max: int, width: int = 8) -> DataFrame:
    """Transfer entropy given the pair's confounder, in half as many bins."""
    return sql(fill(CONDITIONAL, by, T=tau_max, B=width, Z=max(width // 2, 2)), bins=bins, confounders=found)


def prior(te: DataFrame, variables: DataFrame, by: list[str], tau_max: int, least: float = 0.0, self_mass: float = 0.25) -> DataFrame:
    return sql(fill(NORMALISE, by, T=tau_max, MIN=f"{least:e}", SELF=f"{self_mass:e}"), te=te, variables=variables)


def build(kind: str, data: DataFrame, by: list[str], tau_max: int, width: int = 8, least: float = 0.0, self_mass: float = 0.25) -> DataFrame:
    """A prior by transfer entropy (te), conditional on confounders (cte), both from bins; or from a graph's edges (graph).

    A graph names each variable at least once, as source or target.
    """
    if kind == "graph":
        variables = data.select(*by, F.col("src").alias("var")).union(data.select(*by, "tgt")).distinct()
        return from_graph(data, variables, by, tau_max, self_mass)
    if kind not in ("te", "cte"):
        raise ValueError(f"unknown prior {kind!r}")
    te = transfer_entropy(data, by, tau_max)
    if kind == "cte":
        rough = te
        found = confounders(rough, by)
        te = sql(text(TWO_STAGE, by), te=rough, conditional=conditional_entropy(data, found, by, tau_max, width))
    return prior(te, data.select(*by, "var").distinct(), by, tau_max, least, self_mass)


def from_graph(graph: DataFrame, variables: DataFrame, by: list[str], tau_max: int, self_mass: float = 0.25) -> DataFrame:
    """The prior of a graph (by, src, tgt, lag, edge_type, val)."""
    return sql(fill(GRAPH_PRIOR, by, T=tau_max, SELF=f"{self_mass:e}"), edges=sql(text(GRAPH, by), graph=graph), variables=variables)


def density(prior_: DataFrame, by: list[str]) -> DataFrame:
    """How many places of a graph's prior hold arrows (the variables' own at lag 1 with them), ambiguous edges, nothing."""
    return sql(text(DENSITY, by), prior=prior_)


def fingerprints(cells: DataFrame, by: list[str], parameters: str) -> DataFrame:
    """(by, key): changes whenever a series' cells or the parameters do, whatever the order of rows: a sum of the cells' hashes."""
    cell = "cast(conv(substr(md5(concat_ws('|', t, var, coalesce(cast(x as string), ''))), 1, 15), 16, 10) as decimal(20,0))"
    row = Template("select $k, sha2(concat_ws('|', '<P>', count(*), sum(<CELL>)), 256) as key from {cells} group by $k").substitute(k=", ".join(by))
    return sql(row.replace("<P>", parameters).replace("<CELL>", cell), cells=cells)


def to_compute(keys: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """The series whose key is not among the stored priors'."""
    return keys.join(stored, [*by, "key"], "left_anti")
