"""Queries over the provided tables, one or more for each operator, with the SQL that gives the same rows.

Real numbers are rounded on both sides, well above the noise of summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import column
from ..operators import assess, exact, fit, gof, samples, uncertainty
from ..sources import partitions
from ..sources.observations import numeric_violations, observations, violations
from ..streaming import fits as streams
from .shared import folder, settle

FLAGSHIP = "fit_exponential_grouped"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir) and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _events(spark, d):
    return table(spark, d, "events")


def _orders(spark, d):
    return table(spark, d, "orders")


def _items(spark, d):
    return table(spark, d, "lineitem")


def row(spark: SparkSession, **values) -> DataFrame:
    """A one-row table of numbers that the driver has."""
    kind = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    values = {k: v.item() if hasattr(v, "item") else v for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind[type(v)]}" for k, v in values.items()))


# Closed-form fits


@query("fit_exponential", "select count(value) as n, round(count(value) / sum(value), 8) as rate, round(count(value) * ln(count(value) / sum(value)) - count(value), 4) as loglik from events")
def _(spark, d):
    r = fit.fit_closed(_events(spark, d), "value", ["exponential"])
    return r.select("n", F.round("p1", 8).alias("rate"), F.round("loglik", 4).alias("loglik"))


@query("fit_exponential_grouped", "select event_type, count(value) as n, round(count(value) / sum(value), 8) as rate, round(count(value) * ln(count(value) / sum(value)) - count(value), 4) as loglik from events group by event_type")
def _(spark, d):
    r = fit.fit_closed(_events(spark, d), "value", ["exponential"], by=["event_type"])
    return r.select("event_type", "n", F.round("p1", 8).alias("rate"), F.round("loglik", 4).alias("loglik"))


@query("fit_exponential_censored", "select count(*) as n, sum(case when event_type <> 'view' then 1 else 0 end)::bigint as events, round(sum(value), 4) as exposure, round(sum(case when event_type <> 'view' then 1 else 0 end) / sum(value), 8) as rate, round(sum(value) / sum(case when event_type <> 'view' then 1 else 0 end), 6) as mean, round(sqrt(sum(case when event_type <> 'view' then 1 else 0 end)) / sum(value), 8) as se from events")
def _(spark, d):
    e = _events(spark, d).withColumn("seen", F.col("event_type") != "view")
    r = fit.fit_exponential_censored(e, "value", "seen")
    return r.select("n", "events", F.round("exposure", 4).alias("exposure"), F.round("rate", 8).alias("rate"), F.round("mean", 6).alias("mean"), F.round("se", 8).alias("se"))


_S = """with s as (select count(x) as n, sum(x) as s1, avg(x) as mean, var_pop(x) as var, var_samp(x) as var1, sum(x * x) as s2, sum(ln(x)) as sl, avg(ln(x)) as ml, var_pop(ln(x)) as vl, var_samp(ln(x)) as vl1, sum(1 / x) as sr, min(x) as lo, max(x) as hi, quantile_cont(x, 0.5) as med from t),
m as (select avg(abs(x - med)) as mad from t, s) """
_PRICES = "with t as (select o_totalprice as x from orders), " + _S[5:]


@query("fit_closed_forms", _PRICES + """select family, n, round(p1, 6) as p1, round(p2, 6) as p2, round(loglik, 2) as loglik from (
select 'exponential' as family, n, n / s1 as p1, cast(null as double) as p2, n * ln(n / s1) - n as loglik from s
union all select 'normal', n, mean, sqrt(var), -n / 2 * (ln(2 * pi()) + ln(var) + 1) from s
union all select 'lognormal', n, ml, sqrt(vl), -n / 2 * (ln(2 * pi()) + ln(vl) + 1) - sl from s
union all select 'uniform', n, lo, hi, -n * ln(hi - lo) from s
union all select 'rayleigh', n, sqrt(s2 / (2 * n)), null, sl - n * ln(s2 / (2 * n)) - n from s
union all select 'laplace', n, med, mad, -n * (ln(2 * mad) + 1) from s, m
union all select 'pareto', n, n / (sl - n * ln(lo)), lo, n * ln(n / (sl - n * ln(lo))) + n * n / (sl - n * ln(lo)) * ln(lo) - (n / (sl - n * ln(lo)) + 1) * sl from s
union all select 'wald', n, mean, n / (sr - n / mean), n / 2 * (ln(n / (sr - n / mean)) - ln(2 * pi()) - 1) - 1.5 * sl from s)""")
def _(spark, d):
    r = fit.fit_closed(_orders(spark, d), "o_totalprice", ["exponential", "normal", "lognormal", "uniform", "rayleigh", "laplace", "pareto", "wald"])
    return r.select("family", "n", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"), F.round("loglik", 2).alias("loglik"))


@query("fit_discrete", """with t as (select l_quantity as x from lineitem), s as (select count(*) as n, avg(x) as m, sum(x) as s1, max(x) as hi, var_samp(x) as v, sum(lgamma(x + 1)) as lf from t)
select family, round(p1, 8) as p1, round(p2, 8) as p2, round(loglik, 2) as loglik from (
select 'poisson' as family, m as p1, cast(null as double) as p2, s1 * ln(m) - s1 - lf as loglik from s
union all select 'geometric', 1 / m, null, n * ln(1 / m) + (s1 - n) * ln(1 - 1 / m) from s
union all select 'negative_binomial', m * m / (v - m), m / v, null from s
union all select 'binomial', hi, greatest(0.001, least(0.999, m / hi)), null from s
union all select 'hypergeometric', round(m * 1000 / 60), 60, null from s)""")
def _(spark, d):
    i = _items(spark, d)
    a = fit.fit_closed(i, "l_quantity", ["poisson", "geometric"]).select("family", "p1", "p2", "loglik")
    b = fit.fit_moments(i, "l_quantity", ["negative_binomial"]).select("family", "p1", "p2", F.lit(None).cast("double").alias("loglik"))
    c = fit.fit_binomial(i, "l_quantity").select(F.lit("binomial").alias("family"), F.col("n_trials").alias("p1"), F.col("p").alias("p2"), F.lit(None).cast("double").alias("loglik"))
    h = fit.fit_hypergeometric(i, "l_quantity", 1000, 60).select(F.lit("hypergeometric").alias("family"), F.col("successes").cast("double").alias("p1"), F.col("draws").cast("double").alias("p2"), F.lit(None).cast("double").alias("loglik"))
    r = a.union(b).union(c).union(h)
    return r.select("family", F.round("p1", 8).alias("p1"), F.round("p2", 8).alias("p2"), F.round("loglik", 2).alias("loglik"))


@query("fit_moments", _PRICES + """select family, round(p1, 5) as p1, round(p2, 5) as p2 from (
select 'normal' as family, mean as p1, sqrt(var1) as p2 from s union all select 'exponential', 1 / mean, null from s union all select 'uniform', lo, hi from s
union all select 'gamma', mean * mean / var1, var1 / mean from s union all select 'lognormal', ml, sqrt(vl1) from s
union all select 'logistic', mean, sqrt(var1) * sqrt(3) / pi() from s union all select 'gumbel', mean - 0.5772156649015329 * sqrt(var1) * sqrt(6) / pi(), sqrt(var1) * sqrt(6) / pi() from s
union all select 'pareto', greatest(1.01, mean / (mean - lo)), lo from s union all select 'laplace', med, mad from s, m
union all select 'rayleigh', sqrt(s2 / (2 * n)), null from s union all select 'wald', mean, mean * mean * mean / var1 from s)""")
def _(spark, d):
    r = fit.fit_moments(_orders(spark, d), "o_totalprice", ["normal", "exponential", "uniform", "gamma", "lognormal", "logistic", "gumbel", "pareto", "laplace", "rayleigh", "wald"])
    return rounded(r.select("family", "p1", "p2"), 5)


@query("fit_support_failures", "select family, code from (values ('exponential', 'INVALID_SUPPORT'), ('lognormal', 'INVALID_SUPPORT'), ('normal', 'OK'), ('pareto', 'INVALID_SUPPORT'), ('rayleigh', 'INVALID_SUPPORT')) t(family, code) where (select min(c_acctbal) from customer) < 0")
def _(spark, d):
    return fit.fit_closed(table(spark, d, "customer"), "c_acctbal", ["exponential", "lognormal", "normal", "pareto", "rayleigh"]).select("family", "code")


# Iterative fits


_BISECT = """with recursive t as (select {x} as x from {tab}), c as (select max(ln(x)) as top, avg(ln(x)) as ml, count(*) as n from t),
w as (select ln(x) - top as w from t, c), b(i, lo, hi) as (select 0, ln(0.01::double), ln(100::double)
union all select i + 1, case when g > 0 then (lo + hi) / 2 else lo end, case when g > 0 then hi else (lo + hi) / 2 end
from (select i, lo, hi, (select 1 / exp((lo + hi) / 2) - sum(w * exp(exp((lo + hi) / 2) * w)) / sum(exp(exp((lo + hi) / 2) * w)) + avg(w) from w) as g from b where i < 48))
select c.n, round(exp((lo + hi) / 2), 5) as shape, round(exp(c.top + ln((select sum(exp(exp((lo + hi) / 2) * w)) from w) / c.n) / exp((lo + hi) / 2)), 4) as scale from b, c where i = 48"""


@query("fit_weibull", _BISECT.format(x="value", tab="events where value > 0"))
def _(spark, d):
    r = fit.fit_weibull(_events(spark, d).filter("value > 0"), "value")
    return row(spark, n=r["n"], shape=round(r["shape"], 5), scale=round(r["scale"], 4))


@query("fit_gumbel", """with recursive t as (select o_totalprice as x from orders), c as (select avg(x) as m, min(x) as lo, greatest(max(x) - avg(x), avg(x) - min(x)) as peak, count(*) as n from t),
w as (select (lo - x) / peak as w from t, c), b(i, a, z) as (select 0, ln(0.001::double), ln(1000::double)
union all select i + 1, case when g > 0 then (a + z) / 2 else a end, case when g > 0 then z else (a + z) / 2 end
from (select i, a, z, (select 1 / exp((a + z) / 2) - sum(w * exp(exp((a + z) / 2) * w)) / sum(exp(exp((a + z) / 2) * w)) + (select (lo - m) / peak from c) from w) as g from b where i < 48))
select c.n, round(c.m + c.peak * ((c.lo - c.m) / c.peak - ln((select sum(exp(exp((a + z) / 2) * w)) from w) / c.n) / exp((a + z) / 2)), 2) as location, round(c.peak / exp((a + z) / 2), 2) as scale from b, c where i = 48""")
def _(spark, d):
    r = fit.fit_gumbel(_orders(spark, d), "o_totalprice")
    return row(spark, n=r["n"], location=round(r["location"], 2), scale=round(r["scale"], 2))


@query("fit_gamma_grouped", """with recursive s as (select event_type, count(*) as n, avg(value) as m, ln(avg(value)) - avg(ln(value)) as g from events where value > 0 group by event_type),
b(event_type, i, lo, hi) as (select event_type, 0, ln(0.01::double), ln(1000::double) from s
union all select event_type, i + 1, case when f > g then (lo + hi) / 2 else lo end, case when f > g then hi else (lo + hi) / 2 end from (
select b.event_type, i, lo, hi, g, (select ln(k) - (ln(k + 40) - 0.5 / (k + 40) - 1 / (12 * (k + 40) * (k + 40)) + 1 / (120 * pow(k + 40, 4)) - (select sum(1 / (k + j)) from range(0, 40) r(j))) from (select exp((lo + hi) / 2) as k)) as f from b join s using (event_type) where i < 45))
select event_type, n, round(exp((lo + hi) / 2), 5) as shape, round(m / exp((lo + hi) / 2), 4) as scale from b join s using (event_type) where i = 45""")
def _(spark, d):
    return fit.fit_gamma(_events(spark, d).filter("value > 0"), "value", by=["event_type"]).select("event_type", "n", F.round("shape", 5).alias("shape"), F.round("scale", 4).alias("scale"))


@query("profile_sums", "with w as (select ln(value) - (select max(ln(value)) from events where value > 0) as w from events where value > 0) select b::double as b, round(sum(exp(b * w)), 4) as s0, round(sum(w * exp(b * w)), 4) as s1, round(sum(w * w * exp(b * w)), 4) as s2 from w, (values (0.25), (0.5), (1.0), (2.0), (4.0)) v(b) group by b")
def _(spark, d):
    e = _events(spark, d).filter("value > 0")
    top = e.agg(F.max(F.log("value"))).first()[0]
    grid = [0.25, 0.5, 1.0, 2.0, 4.0]
    s = fit.profile_sums(e, F.log("value") - F.lit(top), grid)
    rows = [F.struct(F.lit(b).alias("b"), *[F.round(f"s{k}_{i}", 4).alias(f"s{k}") for k in range(3)]) for i, b in enumerate(grid)]
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _newton_rows(spark, fits) -> DataFrame:
    out = []
    for r in fits:
        p = [*(r.get("params") or {}).values(), None, None, None][:3]
        out.append((r["family"], r["code"], r["n"], *[None if v is None else float(f"{v:.4g}") for v in p], round(r["loglik"], 1) if "loglik" in r else None))
    return spark.createDataFrame(out, "family string, code string, n bigint, p1 double, p2 double, p3 double, loglik double")


@query("fit_newton_families")
def _(spark, d):
    """Families without closed form: logistic, Cauchy, Student, beta, chi-square, F, Burr, generalised extreme value."""
    grid = _events(spark, d).select(((F.col("event_id") % 997 + 0.5) / 997.0).alias("u"))
    fits = []
    for name, p in (("logistic", (10.0, 3.0)), ("cauchy", (5.0, 2.0)), ("student_t", (4.0, 1.0, 2.0)), ("gev", (0.15, 10.0, 2.0)), ("burr", (2.0, 1.5, 10.0)), ("chi_square", (5.0,)), ("f", (6.0, 9.0))):
        o = observations(grid.select(column(name, "ppf", "u", *p).alias("v")), "v").persist()
        fits.append({**fit.newton_fit(o, name, merged=True), "n": o.count()})
        o.unpersist()
    o = observations(_items(spark, d).filter("l_discount > 0").withColumn("v", F.col("l_discount") * 5), "v").persist()
    fits.append({**fit.newton_fit(o, "beta", merged=True), "n": o.count()})
    o.unpersist()
    return _newton_rows(spark, fits)


@query("fit_newton_censored")
def _(spark, d):
    """Right-censored fits of all six lifetime families."""
    e = observations(_events(spark, d).filter("value > 0").withColumn("seen", F.col("event_type") != "view"), "value", event="seen")
    e = settle(fit.grouped_by_multiplicity(e), "merged")  # once for all six
    n = int(e.agg(F.sum("weight")).first()[0] or 0)
    fits = [{**fit.newton_fit(e, f), "n": n} for f in ("exponential", "weibull", "lognormal", "gamma", "normal", "gumbel")]
    return _newton_rows(spark, fits)


# Functions


_FORMS = {
    "exponential": ((0.02,), "ln(0.02) - 0.02 * value", "1 - exp(-0.02 * value)", "-ln(1 - u) / 0.02"),
    "weibull": ((1.2, 50.0), "ln(1.2 / 50.0) + 0.2 * ln(value / 50.0) - pow(value / 50.0, 1.2)", "1 - exp(-pow(value / 50.0, 1.2))", "50.0 * pow(-ln(1 - u), 1 / 1.2)"),
    "gumbel": ((30.0, 25.0), "-(value - 30.0) / 25.0 - exp(-(value - 30.0) / 25.0) - ln(25.0)", "exp(-exp(-(value - 30.0) / 25.0))", "30.0 - 25.0 * ln(-ln(u))"),
    "logistic": ((50.0, 20.0), "-abs(value - 50.0) / 20.0 - 2 * ln(1 + exp(-abs(value - 50.0) / 20.0)) - ln(20.0)", "1 / (1 + exp(-(value - 50.0) / 20.0))", "50.0 + 20.0 * ln(u / (1 - u))"),
    "cauchy": ((40.0, 20.0), "-ln(20.0 * pi()) - ln(1 + pow((value - 40.0) / 20.0, 2))", "0.5 + atan((value - 40.0) / 20.0) / pi()", "40.0 + 20.0 * tan(pi() * (u - 0.5))"),
    "laplace": ((40.0, 20.0), "-abs(value - 40.0) / 20.0 - ln(40.0)", "case when value < 40.0 then 0.5 * exp((value - 40.0) / 20.0) else 1 - 0.5 * exp(-(value - 40.0) / 20.0) end", "40.0 - 20.0 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5))"),
    "rayleigh": ((40.0,), "case when value > 0 then ln(value) - 2 * ln(40.0) - value * value / 3200.0 else '-inf'::double end", "1 - exp(-value * value / 3200.0)", "40.0 * sqrt(-2 * ln(1 - u))"),
    "uniform": ((0.0, 1000.0), "-ln(1000.0)", "least(1, greatest(0, value / 1000.0))", "u * 1000.0"),
    "pareto": ((1.5, 0.001), "ln(1.5) + 1.5 * ln(0.001) - 2.5 * ln(value)", "1 - pow(0.001 / value, 1.5)", "0.001 * exp(-ln(1 - u) / 1.5)"),
    "burr": ((1.5, 2.0, 60.0), "ln(1.5 * 2.0 / 60.0) + 0.5 * ln(value / 60.0) - 3.0 * ln(1 + pow(value / 60.0, 1.5))", "1 - pow(1 + pow(value / 60.0, 1.5), -2.0)", "60.0 * pow(pow(1 - u, -0.5) - 1, 1 / 1.5)"),
}
for _name, (_p, _lp, _cdf, _ppf) in _FORMS.items():

    @query(f"functions_{_name}", f"select event_id, round({_lp}, 7) as logpdf, round({_cdf}, 9) as cdf, round(1 - ({_cdf}), 9) as sf, round({_ppf}, 5) as ppf from (select event_id, value, (event_id % 997 + 0.5) / 997.0 as u from events where value > 0.001)")
    def _(spark, d, name=_name, p=_p):
        e = _events(spark, d).filter("value > 0.001").withColumn("u", (F.col("event_id") % 997 + 0.5) / 997.0)
        return e.select("event_id", F.round(column(name, "logpdf", "value", *p), 7).alias("logpdf"), F.round(column(name, "cdf", "value", *p), 9).alias("cdf"), F.round(column(name, "sf", "value", *p), 9).alias("sf"), F.round(column(name, "ppf", "u", *p), 5).alias("ppf"))


_SERIES = {
    "normal": ((50.0, 50.0), "select event_id, (value - 50.0) / 50.0 as z from events", "-0.5 * z * z - ln(50.0) - 0.5 * ln(2 * pi())", "0.5 + exp(-0.5 * z * z) / sqrt(2 * pi()) * sign(z) * list_sum([exp((2 * k + 1) * ln(abs(z) + 1e-300) - lgamma(k + 1.5) - (k + 1) * ln(2) + 0.5 * ln(pi())) for k in range(0, 260)])"),
    "gamma": ((2.5, 20.0), "select event_id, value / 20.0 as y from events where value > 0", "1.5 * ln(y) - y - lgamma(2.5) - ln(20.0)", "exp(2.5 * ln(y) - y) * list_sum([exp(k * ln(y) - lgamma(k + 3.5)) for k in range(0, 260)])"),
}
for _name, (_p, _from, _lp, _cdf) in _SERIES.items():
    for _suffix in ("", "_whole"):

        @query(f"functions_{_name}{_suffix}", f"select event_id, round({_lp}, 8) as logpdf, round({_cdf}, 8) as cdf from ({_from})")
        def _(spark, d, name=_name, p=_p):
            e = _events(spark, d) if name == "normal" else _events(spark, d).filter("value > 0")
            return e.select("event_id", F.round(column(name, "logpdf", "value", *p), 8).alias("logpdf"), F.round(column(name, "cdf", "value", *p), 8).alias("cdf"))


@query("loglik_weibull_mixed", """with o as (select value as v, event_id % 4 as s, value * 1.5 as u, case when event_id % 3 = 0 then value * 0.1 end as lo from events where value > 0.01),
c as (select s, case when s = 1 then ln(1.2 / 50.0) + 0.2 * ln(v / 50.0) - pow(v / 50.0, 1.2) when s = 0 then -pow(v / 50.0, 1.2)
when s = 2 then ln(exp(-pow(coalesce(lo, 0) / 50.0, 1.2)) - exp(-pow(v / 50.0, 1.2))) else ln(exp(-pow(v / 50.0, 1.2)) - exp(-pow(u / 50.0, 1.2))) end + pow(coalesce(lo, 0) / 50.0, 1.2) as l from o)
select s as status, count(*) as n, round(sum(l), 3) as loglik from c group by s""")
def _(spark, d):
    e = _events(spark, d).filter("value > 0.01").withColumn("s", (F.col("event_id") % 4).cast("int"))
    e = e.withColumn("u", F.when(F.col("s") == 3, F.col("value") * 1.5)).withColumn("lo", F.when(F.col("event_id") % 3 == 0, F.col("value") * 0.1))
    o = observations(e, "value", status="s", upper="u", trunc_lower="lo")
    rows = []
    for s in range(4):
        n, ll = fit.log_likelihoods(o.filter(F.col("status") == s), "weibull", [(1.2, 50.0)])
        rows.append((s, n, round(float(ll[0]), 3)))
    return spark.createDataFrame(rows, "status bigint, n bigint, loglik double")


@query("observation_violations", "select 'UNKNOWN_STATUS' as code, count(*) as rows from events where event_id % 7 = 6 having count(*) > 0 union all select 'OUTSIDE_WINDOW', count(*) from events where event_id % 7 <> 6 and event_id % 5 = 0 having count(*) > 0")
def _(spark, d):
    e = _events(spark, d).withColumn("s", F.when(F.col("event_id") % 7 == 6, 9).otherwise(1)).withColumn("lo", F.when(F.col("event_id") % 5 == 0, F.col("value") + 1))
    return violations(observations(e, "value", status="s", trunc_lower="lo"))


@query("value_policy", "select 'NULL_VALUE' as code, count(*) as rows from events where event_id % 10 = 3 having count(*) > 0")
def _(spark, d):
    return numeric_violations(_events(spark, d).withColumn("v", F.when(F.col("event_id") % 10 != 3, F.col("value"))), "v")


# Uncertainty


@query("uncertainty_exponential", "with s as (select count(*) as n, sum(value) as t from events) select round(n / t, 8) as rate, round(sqrt(n) / t, 8) as se, round(n / t * exp(-1.959963984540054 / sqrt(n)), 8) as lower, round(n / t * exp(1.959963984540054 / sqrt(n)), 8) as upper, round(t / n * ln(10), 5) as q90 from s")
def _(spark, d):
    r = fit.fit_exponential_censored(_events(spark, d).withColumn("e", F.lit(1)), "value", "e").first()
    n, rate = r["events"], r["rate"]
    f = {"family": "exponential", "code": "OK", "params": {"rate": rate}, "information": [[float(n)]], "free": ["rate"]}
    w = uncertainty.wald(f)["rate"]
    return row(spark, rate=round(rate, 8), se=round(w["se"], 8), lower=round(w["lower"], 8), upper=round(w["upper"], 8), q90=round(uncertainty.derived_quantile(f, 0.9)["estimate"], 5))


@query("intervals_exponential")
def _(spark, d):
    """Exact, profile and derived intervals of a rate."""
    r = fit.fit_exponential_censored(_events(spark, d).withColumn("e", F.lit(1)), "value", "e").first()
    n, t = r["events"], r["exposure"]
    f = {"family": "exponential", "code": "OK", "params": {"rate": n / t}, "information": [[float(n)]], "free": ["rate"]}
    p = uncertainty.profile_rate(n, t)
    out = [("exact", *uncertainty.exact_rate(n, t)), ("profile", p["lower"], p["upper"])]
    out += [(k, v["lower"], v["upper"]) for k, v in (("mean", uncertainty.derived_mean(f)), ("q50", uncertainty.derived_quantile(f, 0.5)), ("s100", uncertainty.derived_survival(f, 100.0)))]
    return spark.createDataFrame([(a, round(b, 8), round(c, 8)) for a, b, c in out], "what string, lower double, upper double")


# Goodness of fit


@query("edf_exponential", """with t as (select value as x, row_number() over (order by value) as i, count(*) over () as n, 1 - exp(-0.02 * value) as p from events),
q as (select *, greatest(1e-15, least(1 - 1e-15, p)) as c from t), r as (select q.*, (select count(*) from events) as m from q)
select max(n) as n, round(max(greatest(i / n - p, p - (i - 1) / n)), 9) as ks, round(-max(n) - sum((2 * i - 1) * ln(c) + (2 * (n - i) + 1) * ln(1 - c)) / max(n), 5) as ad, round(1 / (12 * max(n)) + sum(pow((2 * i - 1) / (2 * n) - c, 2)), 6) as cvm from r""")
def _(spark, d):
    r = gof.edf_statistics(_events(spark, d), "value", "exponential", (0.02,))
    return r.select("n", F.round("ks", 9).alias("ks"), F.round("ad", 5).alias("ad"), F.round("cvm", 6).alias("cvm"))


@query("histogram_prices", "with s as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem) select cast(least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20))) as int) as bin, count(*) as count from lineitem, s group by 1")
def _(spark, d):
    return gof.histogram(_items(spark, d), "l_extendedprice", 20).select("bin", "count")


@query("chi_square_uniform")
def _(spark, d):
    i = _items(spark, d)
    s = i.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    r = gof.chi_square(i, "l_extendedprice", "uniform", tuple(s))
    return row(spark, n=r["n"], bins=r["bins"], statistic=round(r["statistic"], 4), df=r["df"], p_value=round(r["p_value"], 8))


@query("large_sample_regions", "select cast(2 * least(floor((1 - exp(-0.02 * value)) * 256), 255) as int) as region, count(*) as cnt from events group by 1")
def _(spark, d):
    return gof.regions(_events(spark, d), "value", "exponential", (0.02,), k=8)


@query("large_sample_decision")
def _(spark, d):
    r = gof.large_sample(_events(spark, d), "value", "exponential", (0.02,), 0.05)
    return row(spark, n=r["n"], ks_lower=round(r["ks_lower"], 9), ks_upper=round(r["ks_upper"], 9), tv_lower=round(r["tv_lower"], 9), decision=r["decision"])


@query("monte_carlo_gof")
def _(spark, d):
    r = gof.monte_carlo(_events(spark, d), "value", "exponential", 60, seed=3)
    return r.select("statistic", F.round("value", 8).alias("value"), F.round("p_value", 8).alias("p_value"), "failures")


@query("all_tests")
def _(spark, d):
    return rounded(assess.all_tests(_events(spark, d), "value", "exponential", (0.02,)), 7)


@query("ecdf", "select value as x, round(max(i) / max(n), 9) as p from (select value, row_number() over (order by value) as i, count(*) over () as n from events) group by value")
def _(spark, d):
    return rounded(assess.ecdf(_events(spark, d), "value"), 9)


@query("assess_families")
def _(spark, d):
    rows, _ = assess.assess(_events(spark, d).filter("value > 0"), "value", ["exponential", "normal", "lognormal", "weibull"], 40, seed=1)
    return rows.select("family", "code", F.round("p_value", 6).alias("p_value"), F.round("aic", 4).alias("aic"))


@query("profile_interval_weibull")
def _(spark, d):
    """Ends where the profile falls by half the chi-square quantile, in few passes."""
    e = _events(spark, d).filter("value > 0").select("value").persist()
    r = assess.profile_shape(e, "value", fit.fit_weibull(e, "value"))
    e.unpersist()
    return row(spark, lower=round(r["lower"], 5), estimate=round(r["estimate"], 5), upper=round(r["upper"], 5), passes=r["passes"])


@query("weighted_fits")
def _(spark, d):
    """Weighted likelihood of families with and without closed form."""
    i = _items(spark, d).withColumn("v", F.col("l_extendedprice") / 10000).persist()
    out = [assess.fit_family(i, "v", f, weight="l_quantity") for f in ("exponential", "gamma", "normal")]
    i.unpersist()
    return _newton_rows(spark, out)


# Comparison of models


@query("compare_models", """with s as (select count(*) as n, sum(value) as s1, avg(value) as mean, var_pop(value) as var, sum(ln(value)) as sl, var_pop(ln(value)) as vl, sum(value * value) as s2 from events where value > 0),
f as (select 'exponential' as family, 1 as k, n, n * ln(n / s1) - n as ll from s union all select 'normal', 2, n, -n / 2 * (ln(2 * pi()) + ln(var) + 1) from s
union all select 'lognormal', 2, n, -n / 2 * (ln(2 * pi()) + ln(vl) + 1) - sl from s union all select 'rayleigh', 1, n, sl - n * ln(s2 / (2 * n)) - n from s),
a as (select family, n, round(2 * k - 2 * ll, 2) as aic, round(k * ln(n) - 2 * ll, 2) as bic, 2 * k - 2 * ll as raw from f)
select family, n, aic, bic, round(raw - min(raw) over (), 2) as delta, cast(row_number() over (order by raw, family) as int) as rank from a""")
def _(spark, d):
    r = samples.compare(_events(spark, d).filter("value > 0"), "value", ["exponential", "normal", "lognormal", "rayleigh"])
    return r.select("family", "n", F.round("aic", 2).alias("aic"), F.round("bic", 2).alias("bic"), F.round("delta", 2).alias("delta"), "rank")


for _fam, _y, _term in (("exponential", "value", "-ln((s - y) / m) - y / ((s - y) / m)"), ("normal", "value", "-0.5 * (ln(2 * pi() * ((q - y * y) / m - pow((s - y) / m, 2))) + pow(y - (s - y) / m, 2) / ((q - y * y) / m - pow((s - y) / m, 2)))")):

    @query(f"leave_one_out_{_fam}", f"with t as (select {_y} as y from events), a as (select count(*) - 1.0 as m, sum(y) as s, sum(y * y) as q from t) select '{_fam}' as family, round(-sum({_term}), 3) as loo from t, a")
    def _(spark, d, fam=_fam):
        return rounded(samples.leave_one_out(_events(spark, d), "value", fam), 3)


@query("adequacy_gate", "select 'OK' as code, 'b' as family, 11.0::double as aic")
def _(spark, d):
    c = spark.createDataFrame([("a", 0.01, 10.0), ("b", 0.2, 11.0), ("c", 0.9, 11.0)], "family string, p_value double, aic double")
    return samples.adequate_best(c)


@query("adequacy_gate_fitted")
def _(spark, d):
    """The gate on families fitted to all events."""
    rows, _ = assess.assess(_events(spark, d).filter("value > 0"), "value", ["exponential", "normal", "lognormal", "weibull"], 40, seed=1)
    return samples.adequate_best(rows).select("code", "family", F.round("aic", 4).alias("aic"))


@query("suggest_families", """with s as (select min(value) as lo, avg(value) as m, var_pop(value) as v from events),
k as (select any_value(lo) as lo, avg(pow(value - m, 3)) / pow(any_value(v), 1.5) as sk, avg(pow(value - m, 4)) / pow(any_value(v), 2) - 3 as ku from events, s),
f as (select unnest(['normal', 'lognormal', 'gamma', 'weibull', 'exponential']) as family, unnest(range(5)) as place)
select place, family, concat_ws(', ', case when lo > 0 then 'above 0' end, case when abs(sk) > 0.5 then 'skewed' end, case when ku > 1 then 'heavy tails' end) as why from f, k where lo > 0 or place = 0""")
def _(spark, d):
    return samples.suggest(_events(spark, d), "value")


@query("describe_sample", """with s as (select count(*) as n, avg(c_acctbal) as mean, stddev_samp(c_acctbal) as sd, quantile_cont(c_acctbal, 0.5) as median, min(c_acctbal) as low, max(c_acctbal) as high, quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3, var_pop(c_acctbal) as v from customer)
select n, round(mean, 5) as mean, round(sd, 5) as sd, round(median, 5) as median, low, high, (select round(avg(pow(c_acctbal - mean, 3)) / pow(v, 1.5), 6) from customer) as skew, (select round(avg(pow(c_acctbal - mean, 4)) / (v * v) - 3, 6) from customer) as kurt,
(select count(*) from customer where c_acctbal < q1 - 1.5 * (q3 - q1) or c_acctbal > q3 + 1.5 * (q3 - q1)) as outliers from s""")
def _(spark, d):
    r = samples.describe(table(spark, d, "customer"), "c_acctbal")
    return r.select("n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round("median", 5).alias("median"), "low", "high", F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"), "outliers")


# Weights


@query("weighted_summary", "select l_returnflag, count(*) as n, round(sum(w * x) / sum(w), 5) as mean, round(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2), 1) as var, round(sum(w) * sum(w) / sum(w * w), 4) as ess from (select l_returnflag, l_extendedprice as x, l_quantity as w from lineitem where l_quantity > 0) group by l_returnflag")
def _(spark, d):
    r = samples.weighted_summary(_items(spark, d), "l_extendedprice", "l_quantity", by=["l_returnflag"])
    return r.select("l_returnflag", "n", F.round("mean", 5).alias("mean"), F.round("var", 1).alias("var"), F.round("ess", 4).alias("ess"))


@query("weighted_quantiles", "with t as (select l_extendedprice as x, sum(l_quantity) as w from lineitem where l_quantity > 0 group by 1), c as (select x, sum(w) over (order by x) as cum, sum(w) over () as total from t) select q::double as q, min(x) as value from c, (values (0.25), (0.5), (0.75)) v(q) where cum >= q * total group by q")
def _(spark, d):
    return samples.weighted_quantiles(_items(spark, d), "l_extendedprice", "l_quantity")


@query("weighted_moments", """with s as (select sum(w * x) / sum(w) as m, sum(w * x * x) / sum(w) as m2, sum(w * ln(x)) / sum(w) as ml, sum(w * ln(x) * ln(x)) / sum(w) as ml2 from (select l_extendedprice as x, l_quantity as w from lineitem where l_quantity > 0))
select 'normal' as family, round(m, 4) as p1, round(sqrt(m2 - m * m), 4) as p2 from s union all select 'gamma', round(m * m / (m2 - m * m), 4), round((m2 - m * m) / m, 4) from s union all select 'lognormal', round(ml, 4), round(sqrt(ml2 - ml * ml), 4) from s union all select 'rayleigh', round(sqrt(m2 / 2), 4), null from s""")
def _(spark, d):
    r = samples.weighted_moments(_items(spark, d), "l_extendedprice", "l_quantity")
    return rounded(r.filter(F.col("family").isin("normal", "gamma", "lognormal", "rayleigh")), 4)


@query("frequency_weighted_fit", "select round(sum(l_quantity) / sum(l_quantity * l_extendedprice), 10) as rate from lineitem")
def _(spark, d):
    s = _items(spark, d).agg((F.sum("l_quantity") / F.sum(F.col("l_quantity") * F.col("l_extendedprice"))).alias("rate"))
    return rounded(s, 10)


# Diagnostics


@query("residuals_logistic", "with s as (select avg(o_totalprice - 250000.0) as m, stddev_pop(o_totalprice - 250000.0) as sd from orders) select o_orderkey, round((o_totalprice - 250000.0) / (80000.0 * pi() / sqrt(3)), 7) as pearson_residual, round((o_totalprice - 250000.0 - m) / sd, 7) as standard_residual, round(sign(o_totalprice - 250000.0) * sqrt(greatest(0, 2 * (abs(o_totalprice - 250000.0) / 80000.0 + 2 * ln(1 + exp(-abs(o_totalprice - 250000.0) / 80000.0)) - 2 * ln(2)))), 6) as deviance_residual from orders, s")
def _(spark, d):
    r = samples.residuals(_orders(spark, d), "o_totalprice", "logistic", (250000.0, 80000.0))
    return r.select("o_orderkey", F.round("pearson_residual", 7).alias("pearson_residual"), F.round("standard_residual", 7).alias("standard_residual"), F.round("deviance_residual", 6).alias("deviance_residual"))


@query("influence_exponential", "with t as (select event_id, exp(-0.02 * value) as f from events), s as (select max(f) as top from t) select event_id, round(f / top, 8) as leverage from t, s")
def _(spark, d):
    return samples.influence(_events(spark, d), "value", "exponential", (0.02,)).select("event_id", F.round("leverage", 8).alias("leverage"))


for _method, _cond in (("zscore", "abs(value - 50.0) / 50.0 > 3"), ("iqr", "value < -ln(0.75) / 0.02 - 1.5 * (ln(4) + ln(0.75)) / 0.02 or value > ln(4) / 0.02 + 1.5 * (ln(4) + ln(0.75)) / 0.02"), ("mahalanobis", "pow((value - 50.0) / 50.0, 2) > 6.634896601021213"), ("likelihood", "ln(0.02) - 0.02 * value < -9.0")):

    @query(f"outliers_{_method}", f"select event_id, {_cond} as outlier from events")
    def _(spark, d, method=_method):
        return samples.outliers(_events(spark, d), "value", "exponential", (0.02,), method, -9.0 if method == "likelihood" else None).select("event_id", "outlier")


@query("plot_positions", "with t as (select value as x, row_number() over (order by value) as i, count(*) over () as n from events), g as (select x, count(*) as c, avg(i) as r, max(n) as n from t group by x) select x, c, round((r - 0.5) / n, 9) as position, round(-ln(1 - (r - 0.5) / n) / 0.02, 5) as theoretical, round(1 - exp(-0.02 * x), 9) as probability from g")
def _(spark, d):
    p = samples.plot_positions(_events(spark, d), "value", "exponential", (0.02,))
    return p.select("x", "c", F.round("position", 9).alias("position"), F.round("theoretical", 5).alias("theoretical"), F.round("probability", 9).alias("probability"))


@query("qq_summary", "with t as (select value as x, row_number() over (order by value) as i, count(*) over () as n from events), g as (select x, avg(i) as r, max(n) as n from t group by x), p as (select x, -ln(1 - (r - 0.5) / n) / 0.02 as t, abs(1 - exp(-0.02 * x) - (r - 0.5) / n) as gap from g) select round(corr(t, x), 7) as qq_corr, round(max(gap), 7) as pp_gap, round(regr_slope(x, t), 6) as slope, round(regr_intercept(x, t), 4) as intercept from p")
def _(spark, d):
    s = samples.qq_summary(samples.plot_positions(_events(spark, d), "value", "exponential", (0.02,)))
    return s.select(F.round("qq_corr", 7).alias("qq_corr"), F.round("pp_gap", 7).alias("pp_gap"), F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


# Survival, windows, mixtures and others


@query("kaplan_meier", "with g as (select event_type, user_id % 2 as arm, value as t, case when user_id % 3 <> 0 then 1 else 0 end as e from events), h as (select arm, t as time, sum(e)::bigint as events, count(*) as c from g group by 1, 2), r as (select arm, time, events, sum(c) over (partition by arm order by time desc)::bigint as at_risk from h) select arm, time, events, at_risk, round(case when max(case when events = at_risk then 1 else 0 end) over w = 1 then 0 else exp(sum(case when events < at_risk then ln(1 - events / at_risk) else 0 end) over w) end, 8) as survival from r where events > 0 window w as (partition by arm order by time)")
def _(spark, d):
    e = _events(spark, d).withColumn("arm", F.col("user_id") % 2).withColumn("e", (F.col("user_id") % 3 != 0).cast("int"))
    return samples.kaplan_meier(e, "value", "e", by=["arm"]).select("arm", "time", "events", "at_risk", F.round("survival", 8).alias("survival"))


@query("rolling_normal", "select event_id, round(avg(value) over w, 6) as mu, round(stddev_pop(value) over w, 5) as sigma from events window w as (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding)")
def _(spark, d):
    r = samples.rolling_normal(_events(spark, d), "value", ["ts", "event_id"], 10, ["user_id"])
    return r.select("event_id", F.round("mu", 6).alias("mu"), F.round("sigma", 5).alias("sigma"))


@query("normal_posterior", "with s as (select count(*) as n, avg(value) as m, var_samp(value) as v from events) select round((40.0 / 100.0 + n * m / v) / (1 / 100.0 + n / v), 6) as post_mean, round(1 / (1 / 100.0 + n / v), 8) as post_var from s")
def _(spark, d):
    r = samples.normal_posterior(_events(spark, d), "value", 40.0, 100.0)
    return r.select(F.round("post_mean", 6).alias("post_mean"), F.round("post_var", 8).alias("post_var"))


@query("mixture_step", "with t as (select value as x, ln(0.5) - 0.5 * pow((value - 20.0) / 15.0, 2) - ln(15.0) as a, ln(0.5) - 0.5 * pow((value - 90.0) / 40.0, 2) - ln(40.0) as b from events), r as (select x, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) as r0, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) as r1 from t) select 0 as component, round(avg(r0), 7) as weight, round(sum(r0 * x) / sum(r0), 5) as mu from r union all select 1, round(avg(r1), 7), round(sum(r1 * x) / sum(r1), 5) from r")
def _(spark, d):
    r = samples.mixture_step(_events(spark, d), "value", [(0.5, 20.0, 15.0), (0.5, 90.0, 40.0)])
    return r.select("component", F.round("weight", 7).alias("weight"), F.round("mu", 5).alias("mu"))


@query("mixture_step_whole", "with t as (select value as x, ln(0.5) - 0.5 * pow((value - 20.0) / 15.0, 2) - ln(15.0) as a, ln(0.5) - 0.5 * pow((value - 90.0) / 40.0, 2) - ln(40.0) as b from events), r as (select x, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) as r0, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) as r1 from t) select 0 as component, round(avg(r0), 7) as weight, round(sum(r0 * x) / sum(r0), 5) as mu from r union all select 1, round(avg(r1), 7), round(sum(r1 * x) / sum(r1), 5) from r")
def _(spark, d):
    r = samples.mixture_step(_events(spark, d), "value", [(0.5, 20.0, 15.0), (0.5, 90.0, 40.0)])
    return r.select("component", F.round("weight", 7).alias("weight"), F.round("mu", 5).alias("mu"))


@query("value_at_risk", "select round(quantile_cont(value, 0.05), 6) as empirical, round(-ln(0.95) / 0.02, 6) as parametric from events")
def _(spark, d):
    return rounded(samples.value_at_risk(_events(spark, d), "value", 0.95, "exponential", (0.02,)), 6)


@query("shifted_exponential", "select min(value) as shift, round(avg(value) - min(value), 6) as scale from events")
def _(spark, d):
    return samples.shifted_exponential(_events(spark, d), "value").select("shift", F.round("scale", 6).alias("scale"))


@query("weibull_hazard", "select event_id, round(1.2 / 50.0 * pow(value / 50.0, 0.2), 8) as hazard from events where value > 0")
def _(spark, d):
    return _events(spark, d).filter("value > 0").select("event_id", F.round(samples.hazard("weibull", "value", 1.2, 50.0), 8).alias("hazard"))


@query("weibull_hazard_whole", "select event_id, round(1.2 / 50.0 * pow(value / 50.0, 0.2), 8) as hazard from events where value > 0")
def _(spark, d):
    return _events(spark, d).filter("value > 0").select("event_id", F.round(samples.hazard("weibull", "value", 1.2, 50.0), 8).alias("hazard"))


# Partitions, exact sums, streams


@query("exact_sum", "select round(fsum(value), 6) as total from events")
def _(spark, d):
    return row(spark, total=round(float(exact.exact_sum(_events(spark, d), "value")), 6))


@query("incremental_merge", "select count(*) as n, round(count(*) / sum(l_extendedprice), 12) as rate, round(avg(l_extendedprice), 4) as mu, round(stddev_pop(l_extendedprice), 2) as sigma from lineitem")
def _(spark, d):
    s = partitions.states(_items(spark, d).select(F.concat("l_returnflag", "l_linestatus").alias("partition_id"), F.col("l_extendedprice").alias("x")))
    return partitions.merge(s).select("n", F.round("rate", 12).alias("rate"), F.round("mu", 4).alias("mu"), F.round("sigma", 2).alias("sigma"))


@query("manifest_diff", "select coalesce(a.p, b.p) as partition_id, case when a.p is null then 'added' when b.p is null then 'removed' when a.f = b.f then 'kept' else 'changed' end as change from (select n_name as p, n_regionkey::varchar as f from nation where n_nationkey < 20) a full outer join (select n_name as p, case when n_nationkey % 5 = 0 then 'x' else n_regionkey::varchar end as f from nation where n_nationkey > 3) b on a.p = b.p")
def _(spark, d):
    n = table(spark, d, "nation")
    old = n.filter("n_nationkey < 20").select(F.col("n_name").alias("partition_id"), F.col("n_regionkey").cast("string").alias("fingerprint"))
    new = n.filter("n_nationkey > 3").select(F.col("n_name").alias("partition_id"), F.when(F.col("n_nationkey") % 5 == 0, "x").otherwise(F.col("n_regionkey").cast("string")).alias("fingerprint"))
    return partitions.manifest_diff(old, new)


@query("stream_hourly_fits", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(count(*) / sum(value), 8) as rate from events group by 1, 2")
def _(spark, d):
    import uuid

    e = _events(spark, d)
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"fits_{uuid.uuid4().hex}"
    q = streams.windowed_fits(stream, "ts", "value", "1 hour", late="3650 days", by=["event_type"]).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder(spark)}/quernel/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("rate", 8).alias("rate"))


@query("poisson_bootstrap")
def _(spark, d):
    return rounded(samples.poisson_bootstrap(_events(spark, d), "value", 40, seed=5, key="event_id"), 8)


@query("parametric_bootstrap")
def _(spark, d):
    return rounded(samples.parametric_bootstrap(_events(spark, d), "gamma", (2.0, 3.0), 400, 40, seed=5), 8)


@query("sample_weibull")
def _(spark, d):
    return rounded(samples.sample_family(spark, "weibull", (1.5, 10.0), 5000, seed=2), 8)

