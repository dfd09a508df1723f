"""Queries of iterative fits and profile intervals, held against Newton's method and bisection in recursive SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import family
from ..operators import bootstrap, fit, loo, moments, profile, shapes
from ..operators.ranking import quantiles
from ..sources import readers
from ..sources.observations import observations
from ..streaming import drift
from .catalog import _events, _items, _orders, query, rounded, row
from .shared import folder, settle


def newton_sql(table: str, start: str, loglik: str, names: str, steps: int = 14, h: float = 1e-3) -> str:
    """Recursive SQL whose CTE ``p`` goes to the top of the sum of ``loglik`` over ``table``, by differences in each of ``names``."""
    ps = names.split()
    n = len(ps)
    offsets = [[0.0] * n] + [[(h if j == i else 0.0) * s for j in range(n)] for i in range(n) for s in (1, -1)]
    offsets += [[h * s if k in (i, j) else 0.0 for k in range(n)] for i in range(n) for j in range(i) for s in (1, -1)]
    values = ", ".join(f"({k}, {', '.join(map(str, o))})" for k, o in enumerate(offsets))
    lines = ", ".join(f"max(case when k = {k} then ll end) as l{k}" for k in range(len(offsets)))
    g = [f"((l{1 + 2 * i} - l{2 + 2 * i}) / {2 * h})" for i in range(n)]
    hess = [["" for _ in range(n)] for _ in range(n)]
    at = 1 + 2 * n
    for i in range(n):
        hess[i][i] = f"((l{1 + 2 * i} - 2 * l0 + l{2 + 2 * i}) / {h * h})"
        for j in range(i):
            hess[i][j] = hess[j][i] = f"((l{at} + l{at + 1} - l{1 + 2 * i} - l{2 + 2 * i} - l{1 + 2 * j} - l{2 + 2 * j} + 2 * l0) / {2 * h * h})"
            at += 2

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " + ".join(f"({'-1' if j % 2 else '1'}) * {m[0][j]} * {det([r[:j] + r[j + 1 :] for r in m[1:]])}" for j in range(len(m))) + ")"

    named = [[f"h{min(i, j)}{max(i, j)}" for j in range(n)] for i in range(n)]
    moves = [f"{ps[i]} - ({det([[f'g{r}' if c == i else named[r][c] for c in range(n)] for r in range(n)])}) / {det(named)}" for i in range(n)]
    slopes = ", ".join([f"{g[i]} as g{i}" for i in range(n)] + [f"{hess[i][j]} as h{i}{j}" for i in range(n) for j in range(i, n)])
    here = ", ".join(f"p.{x} + o.d{x} as {x}" for x in ps)
    keep, old = ", ".join(f"p.{x} as b{x}" for x in ps), ", ".join(f"b{x}" for x in ps)
    return f"""with recursive t as ({table}), o(k, {', '.join(f'd{x}' for x in ps)}) as (values {values}), p(i, {', '.join(ps)}) as (select 0, {start} from t union all
select i + 1, {', '.join(moves)} from (select i, {', '.join(f'b{x} as {x}' for x in ps)}, {slopes} from (select i, {old}, {lines} from (
select i, {old}, k, sum({loglik}) as ll from (select p.i, o.k, {keep}, {here}, t.* from p, o, t where p.i < {steps}) group by i, {old}, k) group by i, {old}))) """


_CENSORED = "select value as x, event_type <> 'view' as seen from events where value > 0"
_GUMBEL = "case when seen then -(x - m) / exp(v) - exp(-(x - m) / exp(v)) - v else ln(1 - exp(-exp(-(x - m) / exp(v)))) end"
_Y = "(x / exp(v))"
_GAMMA = (
    f"case when seen then (exp(u) - 1) * ln(x) - {_Y} - exp(u) * v - lgamma(exp(u)) "
    f"else ln(1 - exp(exp(u) * ln({_Y}) - {_Y}) * list_sum(list_transform(range(150), lambda j: exp(j * ln({_Y}) - lgamma(exp(u) + j + 1))))) end"
)


def _censored(spark, d) -> DataFrame:
    e = _events(spark, d).filter("value > 0").withColumn("seen", F.col("event_type") != "view")
    return observations(e, "value", event="seen")


@query("fit_gumbel_censored", newton_sql(_CENSORED, "avg(x), ln(stddev_pop(x))", _GUMBEL, "m v") + "select (select count(*) from t) as n, round(m, 2) as location, round(exp(v), 2) as scale from p where i = 14")
def _(spark, d):
    r = fit.newton_fit(_censored(spark, d), "gumbel")
    return row(spark, n=r["n"], location=round(r["params"]["location"], 2), scale=round(r["params"]["scale"], 2))


@query("fit_gamma_censored", newton_sql(_CENSORED, "0.0::double, ln(avg(x) / avg(seen::int))", _GAMMA, "u v", 10) + "select (select count(*) from t) as n, round(exp(u), 3) as shape, round(exp(v), 2) as scale from p where i = 10")
def _(spark, d):
    r = fit.newton_fit(_censored(spark, d), "gamma")
    return row(spark, n=r["n"], shape=round(r["params"]["shape"], 3), scale=round(r["params"]["scale"], 2))


_STUDENT = "lgamma((exp(w) + 1) / 2) - lgamma(exp(w) / 2) - 0.5 * (w + ln(pi())) - v - (exp(w) + 1) / 2 * ln(1 + (x - m) * (x - m) / exp(2 * v) / exp(w))"
_LOGS = "select ln(value) as x from events where value > 0"


def _logs(spark, d) -> DataFrame:
    return _events(spark, d).filter("value > 0").select(F.log("value").alias("x"))


@query("fit_student_t", newton_sql(_LOGS, "median(x), ln((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.45), ln(4.5)", _STUDENT, "m v w", 16) + "select (select count(*) from t) as n, round(exp(w), 2) as df, round(m, 3) as location, round(exp(v), 3) as scale from p where i = 16")
def _(spark, d):
    r = shapes.fit_student_t(_logs(spark, d), "x")
    return row(spark, n=r["n"], df=round(r["params"]["df"], 2), location=round(r["params"]["location"], 3), scale=round(r["params"]["scale"], 3))


@query("fit_student_t_fixed", newton_sql(_LOGS, "median(x), ln((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.45)", _STUDENT.replace("exp(w)", "5.0").replace("(w +", "(ln(5.0) +"), "m v", 12) + "select (select count(*) from t) as n, round(m, 4) as location, round(exp(v), 4) as scale from p where i = 12")
def _(spark, d):
    r = shapes.fit_student_t(_logs(spark, d), "x", degrees=5)
    return row(spark, n=r["n"], location=round(r["params"]["location"], 4), scale=round(r["params"]["scale"], 4))


# L-moments and triangles

_B = """with recursive r as (select value as x, row_number() over (order by value) - 1 as i, count(*) over () as n, avg(value) over () as m from events),
b as (select max(n) as n, max(m) as b0, sum((x - m) / n * i / (n - 1)) as b1, sum((x - m) / n * i / (n - 1) * (i - 1) / (n - 2)) as b2, sum((x - m) / n * i / (n - 1) * (i - 1) / (n - 2) * (i - 2) / (n - 3)) as b3 from r),
l as (select n, b0 as l1, 2 * b1 as l2, (6 * b2 - 6 * b1) / (2 * b1) as t3, (20 * b3 - 30 * b2 + 12 * b1) / (2 * b1) as t4 from b) """


@query("l_moments", _B + "select n, round(l1, 6) as l1, round(l2, 6) as l2, round(t3, 6) as t3, round(t4, 6) as t4 from l")
def _(spark, d):
    r = shapes.l_moments(_events(spark, d), "value")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("l1", "l2", "t3", "t4")])


@query("fit_gev", _B + """, k(i, lo, hi) as (select 0, -0.999::double, 5.0::double union all select i + 1, case when s > t3 then (lo + hi) / 2 else lo end, case when s > t3 then hi else (lo + hi) / 2 end
from (select k.*, t3, 2 * (1 - pow(3.0, -(lo + hi) / 2)) / (1 - pow(2.0, -(lo + hi) / 2)) - 3 as s from k, l where i < 60)),
f as (select (lo + hi) / 2 as k from k where i = 60), s as (select n, l1, k, l2 * k / ((1 - pow(2.0, -k)) * gamma(1 + k)) as scale from l, f)
select n, round(-k, 5) as shape, round(l1 - scale * (1 - gamma(1 + k)) / k, 4) as location, round(scale, 4) as scale from s""")
def _(spark, d):
    r = shapes.fit_gev_lmoments(_events(spark, d), "value")
    p = r["params"]
    return row(spark, n=r["n"], shape=round(p["shape"], 5), location=round(p["location"], 4), scale=round(p["scale"], 4))


@query("fit_triangular", """with t as (select l_quantity as x, count(*) as c from lineitem group by 1), n as (select sum(c)::double as n from t),
s as (select x, c, coalesce(sum(c) over (order by x rows between unbounded preceding and 1 preceding), 0) as bc, coalesce(sum(c * ln(x)) over (order by x rows between unbounded preceding and 1 preceding), 0) as bl,
coalesce(sum(c) over (order by x rows between 1 following and unbounded following), 0) as ac, coalesce(sum(c * ln(51 - x)) over (order by x rows between 1 following and unbounded following), 0) as al from t)
select n::bigint as n, x as peak, round(n * ln(2 / 51.0) + bl - bc * ln(x) + al - ac * ln(51 - x), 3) as loglik from s, n order by n * ln(2 / 51.0) + bl - bc * ln(x) + al - ac * ln(51 - x) desc, x limit 1""")
def _(spark, d):
    r = shapes.fit_triangular(_items(spark, d), "l_quantity", 0.0, 51.0)
    return row(spark, n=r["n"], peak=float(r["params"]["peak"]), loglik=round(r["loglik"], 3))


# Profile intervals

_HALF = 1.920729410347062


def bisection_sql(top: str, loss: str, low: str, high: str, steps: int = 40) -> str:
    """CTEs ``b`` that close in on both ends of an interval of a positive number x around ``top``: where ``loss`` is half a chi-square quantile."""
    return f"""b(side, i, lo, hi) as (select side, 0, case side when -1 then {low} else {top} end, case side when -1 then {top} else {high} end from best, (values (-1), (1)) v(side)
union all select side, i + 1, case when (side = -1) = (loss > {_HALF}) then x else lo end, case when (side = -1) = (loss > {_HALF}) then hi else x end
from (select b.*, x, {loss} as loss from (select *, (lo + hi) / 2 as x from b where i < {steps}) b, best)) """


_INNER = """(with recursive r(i, lo, hi) as (select 0, ln({low}::double), ln({high}::double) union all select i + 1, case when g > 0 then (lo + hi) / 2 else lo end, case when g > 0 then hi else (lo + hi) / 2 end
from (select i, lo, hi, (select {root} from w) as g from r where i < 60)) select exp((lo + hi) / 2) from r where i = 60)"""
# Gumbel: with y = 1 / scale and w = x - min, the slope of the profile is 1 / y - avg(w) + sum(w e^(-y w)) / sum(e^(-y w)).
_GUMBEL_ROOT = _INNER.format(low="0.0000001", high="1.0", root="1 / exp((lo + hi) / 2) - avg(w) + sum(w * exp(-exp((lo + hi) / 2) * w)) / sum(exp(-exp((lo + hi) / 2) * w))")
_GUMBEL_SQL = f"""with recursive w as (select o_totalprice - min(o_totalprice) over () as w from orders), best as (select y, n * ln(y) - n * y * m - n * ln((select sum(exp(-y * w)) from w) / n) as best, n, m from (select {_GUMBEL_ROOT} as y, count(*)::double as n, avg(w) as m from w)), """


@query("profile_gumbel_scale", _GUMBEL_SQL + bisection_sql("y", "best - (n * ln(x) - n * x * m - n * ln((select sum(exp(-x * w)) from w) / n))", "y * 0.8", "y * 1.25") + "select round(min(2 / (lo + hi)), 2) as lower, round(max(2 / (lo + hi)), 2) as upper from b where i = 40")
def _(spark, d):
    obs, f = profile.exact(_orders(spark, d), "o_totalprice"), fit.fit_gumbel(_orders(spark, d), "o_totalprice")
    (r,) = profile.intervals(obs, {**f, "params": {k: f[k] for k in family("gumbel").params}}, [("scale",)])
    return row(spark, lower=round(r["lower"], 2), upper=round(r["upper"], 2))


_SHAPE_ROOT = _INNER.format(low="0.01", high="100", root="1 / exp((lo + hi) / 2) - sum(w * exp(exp((lo + hi) / 2) * w)) / sum(exp(exp((lo + hi) / 2) * w)) + avg(w) filter (seen)")
_SHAPE_SQL = f"""with recursive t as ({_CENSORED}), w as (select ln(x) - max(ln(x)) over () as w, seen from t),
best as (select y, d, s, d * ln(y) + (y - 1) * s - d * ln((select sum(exp(y * w)) from w) / d) as best from (select {_SHAPE_ROOT} as y, (count(*) filter (seen))::double as d, sum(w) filter (seen) as s from w)), """


@query("profile_weibull_censored", _SHAPE_SQL + bisection_sql("y", "best - (d * ln(x) + (x - 1) * s - d * ln((select sum(exp(x * w)) from w) / d))", "y * 0.8", "y * 1.25") + "select round(min((lo + hi) / 2), 4) as lower, round(max((lo + hi) / 2), 4) as upper from b where i = 40")
def _(spark, d):
    obs = _censored(spark, d)
    (r,) = profile.intervals(obs, fit.newton_fit(obs, "weibull"), [("shape",)])
    return row(spark, lower=round(r["lower"], 4), upper=round(r["upper"], 4))


@query("profile_lognormal", f"""with s as (select count(*)::double as n, avg(ln(o_totalprice)) as m, var_pop(ln(o_totalprice)) as v from orders)
select 'mu' as quantity, round(m - sqrt(v * (exp(2 * {_HALF} / n) - 1)), 6) as lower, round(m + sqrt(v * (exp(2 * {_HALF} / n) - 1)), 6) as upper from s""")
def _(spark, d):
    obs, f = profile.exact(_orders(spark, d), "o_totalprice"), fit.fit_closed(_orders(spark, d), "o_totalprice", ["lognormal"]).first()
    (r,) = profile.intervals(obs, {"family": "lognormal", "code": f["code"], "params": {"mu": f["p1"], "sigma": f["p2"]}}, [("mu",)])
    return row(spark, quantity="mu", lower=round(r["lower"], 6), upper=round(r["upper"], 6))


# Sums and moments


@query("exact_loglik_exponential", "select count(*) as n, round(count(*) * ln(0.02) - 0.02 * sum(value), 4) as loglik from events")
def _(spark, d):
    obs = observations(_events(spark, d), "value")
    return row(spark, n=obs.count(), loglik=round(fit.exact_log_likelihood(obs, "exponential", (0.02,)), 4))


@query("fit_merged_rows", """with recursive t as (select l_quantity as x, count(*)::double as c from lineitem group by 1), w as (select ln(x) - max(ln(x)) over () as w, max(ln(x)) over () as top, c from t),
b(i, lo, hi) as (select 0, ln(0.01::double), ln(100::double) union all select i + 1, case when g > 0 then (lo + hi) / 2 else lo end, case when g > 0 then hi else (lo + hi) / 2 end
from (select i, lo, hi, (select 1 / exp((lo + hi) / 2) - sum(c * w * exp(exp((lo + hi) / 2) * w)) / sum(c * exp(exp((lo + hi) / 2) * w)) + sum(c * w) / sum(c) from w) as g from b where i < 50)),
k as (select exp((lo + hi) / 2) as k from b where i = 50) select (select sum(c)::bigint from t) as n, round(any_value(k), 4) as shape, round(exp(any_value(top) + ln(sum(c * exp(k * w)) / sum(c)) / any_value(k)), 3) as scale from w, k""")
def _(spark, d):
    obs = observations(_items(spark, d), "l_quantity")
    r = fit.newton_fit(obs, "weibull", merged=True)
    return row(spark, n=obs.count(), shape=round(r["params"]["shape"], 4), scale=round(r["params"]["scale"], 3))


@query("moment_test_exponential")
def _(spark, d):
    """Gaps of four moments of all events from a fitted exponential, and their p-values."""
    e = _events(spark, d)
    r = moments.moment_test(e, "value", "exponential", (fit.fit_closed(e, "value", ["exponential"]).first()["p1"],), 99)
    return spark.createDataFrame([(k, round(r[k], 6), r["p_values"][k]) for k in moments.GAPS], "moment string, gap double, p_value double")


# Leave-one-out and bootstrap


@query("leave_one_out_steps", """with t as (select ln(o_totalprice) as y, o_totalprice as x from orders), s as (select count(*)::double as n, avg(y) as m, var_pop(y) as v from t),
d as (select n, m - (y - m) / (n - 1) as mean, (n * v - (y - m) * (y - m) * n / (n - 1)) / (n - 1) as var, y from t, s)
select 'lognormal' as family, count(*) as n, round(sum(0.5 * ln(2 * pi() * var) + (y - mean) * (y - mean) / (2 * var) + y), 2) as loo from d""")
def _(spark, d):
    r = loo.leave_one_out(_orders(spark, d), "o_totalprice", "lognormal")
    return row(spark, family=r["family"], n=r["n"], loo=round(r["loo"], 2))


@query("leave_one_out_gamma")
def _(spark, d):
    """Minus the leave-one-out log-likelihood of Weibull, gamma and Gumbel fits to all positive events."""
    e = _events(spark, d).filter("value > 0")
    rows = [(n, (r := loo.leave_one_out(e, "value", n))["code"], r["n"], round(r["loo"], 4), r["refits"]) for n in ("weibull", "gamma", "gumbel")]
    return spark.createDataFrame(rows, "family string, code string, n bigint, loo double, refits bigint")


@query("bootstrap_median")
def _(spark, d):
    """Interval of the median of all prices by the bag of little bootstraps."""
    items = _items(spark, d).withColumn("k", F.xxhash64("l_orderkey", "l_linenumber"))
    (median,) = quantiles(items, "l_extendedprice", (0.5,))
    r = bootstrap.interval(bootstrap.little_bootstraps(items, "l_extendedprice", bootstrap.weighted_quantile(0.5), key="k"), median)
    return row(spark, estimate=round(r["estimate"], 4), se=round(r["se"], 4), lower=round(r["lower"], 4), upper=round(r["upper"], 4), bags=r["bags"])


@query("source_duckdb_slices", "select count(*) as n, round(count(*) / sum(value), 9) as rate from events")
def _(spark, d):
    """A fit to a column that executors read through DuckDB in row ranges."""
    r = fit.fit_closed(readers.read_duckdb(spark, f"{d}/events.parquet", "value", rows_each=4096), "x", ["exponential"])
    return r.select("n", F.round("p1", 9).alias("rate"))


# Drift


@query("drift_alarms", """with recursive r as (select event_type as key, avg(value) as m, stddev_pop(value) as s from events group by 1),
w as (select event_type as key, date_trunc('day', ts) as start, count(*) as n, avg(value) as x from events group by 1, 2 having date_trunc('day', ts) + interval 1 day <= (select max(ts) from events)),
z as (select w.key, start, n, row_number() over (partition by w.key order by start) as i, (x - m) * sqrt(n) / s as z from w join r using (key)),
c as (select key, start, n, i, z, greatest(0.0, z - 0.5) as up, greatest(0.0, -z - 0.5) as down from z where i = 1
union all select z.key, z.start, z.n, z.i, z.z, greatest(0.0, case when greatest(up, down) > 2 then 0.0 else up end + z.z - 0.5), greatest(0.0, case when greatest(up, down) > 2 then 0.0 else down end - z.z - 0.5) from c join z on z.key = c.key and z.i = c.i + 1)
select key, start, n, round(z, 4) as z, round(up, 4) as up, round(down, 4) as down, case when up > 2 then 'RISE' when down > 2 then 'FALL' end as alarm from c""")
def _(spark, d):
    """Cumulative sums of each event type over a stream of all events, against the whole table's means."""
    e = _events(spark, d)
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"drift_{uuid.uuid4().hex}"
    told = drift.scores(stream, settle(drift.reference(e, "event_type", "value"), "reference"), "event_type", "ts", "value", limit=2.0)
    place = f"{folder(spark)}/quernel/{name}"
    told.writeStream.format("parquet").option("checkpointLocation", f"{place}/marks").outputMode("append").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    out = spark.read.schema(told.schema).parquet(f"{place}/out")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)
