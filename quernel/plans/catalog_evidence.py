"""Further queries of the catalogue: kernels, sources, checkpoints, coverage, offsets, intervals, and fits at scale."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import column
from ..operators import assess, evidence, exact, fit, folds, gof, samples, scale, score, uncertainty
from ..sources import lifetime_csv, partitions, tables
from ..sources.observations import observations
from ..streaming import fits as streams
from .catalog import _BISECT, _events, _items, _orders, query, rounded, row, table
from .shared import folder


def scratch(spark, tag: str) -> str:
    """A new folder that all executors share."""
    return f"{folder(spark)}/quernel/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{tag}"


# Kernels

for _name, _params, _cdf, _sf in (
    ("exponential", (0.02,), "ln(1 - exp(-0.02 * value))", "-0.02 * value"),
    ("weibull", (1.2, 50.0), "ln(1 - exp(-pow(value / 50.0, 1.2)))", "-pow(value / 50.0, 1.2)"),
    ("gumbel", (30.0, 25.0), "-exp(-(value - 30.0) / 25.0)", "ln(1 - exp(-exp(-(value - 30.0) / 25.0)))"),
    ("logistic", (50.0, 20.0), "-ln(1 + exp(-(value - 50.0) / 20.0))", "-ln(1 + exp((value - 50.0) / 20.0))"),
):

    @query(f"log_tails_{_name}", f"select event_id, round({_cdf}, 6) as logcdf, round({_sf}, 6) as logsf, round({ {'exponential': '-ln(u) / 0.02', 'weibull': '50.0 * pow(-ln(u), 1 / 1.2)', 'gumbel': '30.0 - 25.0 * ln(-ln(1 - u))', 'logistic': '50.0 - 20.0 * ln(u / (1 - u))'}[_name] }, 5) as isf from (select event_id, value, (event_id % 997 + 0.5) / 997.0 as u from events where value > 0.001)")  # noqa: E501
    def _(spark, d, name=_name, p=_params):
        e = _events(spark, d).filter("value > 0.001").withColumn("u", (F.col("event_id") % 997 + 0.5) / 997.0)
        return e.select("event_id", F.round(column(name, "logcdf", "value", *p), 6).alias("logcdf"), F.round(column(name, "logsf", "value", *p), 6).alias("logsf"), F.round(column(name, "isf", "u", *p), 5).alias("isf"))


_PHI = "0.5 + exp(-0.5 * z * z) / sqrt(2 * pi()) * sign(z) * list_sum([exp((2 * k + 1) * ln(abs(z) + 1e-300) - lgamma(k + 1.5) - (k + 1) * ln(2) + 0.5 * ln(pi())) for k in range(0, 260)])"
_GAMMA_P = "exp(2.5 * ln(y) - y) * list_sum([exp(k * ln(y) - lgamma(k + 3.5)) for k in range(0, 260)])"


@query("functions_lognormal", f"select event_id, round(-0.5 * z * z - ln(1.2) - 0.5 * ln(2 * pi()) - ln(value), 8) as logpdf, round({_PHI}, 8) as cdf, round(1 - ({_PHI}), 8) as sf, round(u, 9) as back from (select event_id, value, (ln(value) - 3.5) / 1.2 as z, (event_id % 997 + 0.5) / 997.0 as u from events where value > 0)")
def _(spark, d):
    e = _events(spark, d).filter("value > 0").withColumn("u", (F.col("event_id") % 997 + 0.5) / 997.0)
    f = lambda op, x: column("lognormal", op, x, 3.5, 1.2)
    return e.select("event_id", F.round(f("logpdf", "value"), 8).alias("logpdf"), F.round(f("cdf", "value"), 8).alias("cdf"), F.round(f("sf", "value"), 8).alias("sf"), F.round(f("cdf", f("ppf", "u")), 9).alias("back"))


for _name, _params, _from, _lp, _cdf in (
    ("normal", (50.0, 50.0), "select event_id, value, (value - 50.0) / 50.0 as z, (event_id % 997 + 0.5) / 997.0 as u from events", "-0.5 * z * z - ln(50.0) - 0.5 * ln(2 * pi())", _PHI),
    ("gamma", (2.5, 20.0), "select event_id, value / 20.0 as y, (event_id % 997 + 0.5) / 997.0 as u from events where value > 0", "1.5 * ln(y) - y - lgamma(2.5) - ln(20.0)", _GAMMA_P),
):

    @query(f"functions_{_name}_all", f"select event_id, round({_lp}, 8) as logpdf, round({_cdf}, 8) as cdf, round(1 - ({_cdf}), 8) as sf, round(u, 9) as back from ({_from})")
    def _(spark, d, name=_name, p=_params):
        e = _events(spark, d) if name == "normal" else _events(spark, d).filter("value > 0")
        e = e.withColumn("u", (F.col("event_id") % 997 + 0.5) / 997.0)
        f = lambda op, x: column(name, op, x, *p)
        return e.select("event_id", F.round(f("logpdf", "value"), 8).alias("logpdf"), F.round(f("cdf", "value"), 8).alias("cdf"), F.round(f("sf", "value"), 8).alias("sf"), F.round(f("cdf", f("ppf", "u")), 9).alias("back"))


_CENSORED = {
    "exponential": ((0.02,), "ln(0.02) - 0.02 * v", "-0.02 * v"),
    "weibull": ((1.2, 50.0), "ln(1.2 / 50.0) + 0.2 * ln(v / 50.0) - pow(v / 50.0, 1.2)", "-pow(v / 50.0, 1.2)"),
    "gumbel": ((30.0, 45.0), "-(v - 30.0) / 45.0 - exp(-(v - 30.0) / 45.0) - ln(45.0)", "ln(1 - exp(-exp(-(v - 30.0) / 45.0)))"),
    "normal": ((200.0, 150.0), "-0.5 * z * z - ln(150.0) - 0.5 * ln(2 * pi())", f"ln(1 - ({_PHI}))"),
    "lognormal": ((3.5, 1.2), "-0.5 * z * z - ln(1.2) - 0.5 * ln(2 * pi()) - ln(v)", f"ln(1 - ({_PHI}))"),
    "gamma": ((2.5, 20.0), "1.5 * ln(y) - y - lgamma(2.5) - ln(20.0)", f"ln(1 - ({_GAMMA_P}))"),
}
for _name, (_params, _lp, _ls) in _CENSORED.items():
    _z = {"normal": "(value - 200.0) / 150.0", "lognormal": "(ln(value) - 3.5) / 1.2"}.get(_name, "0.5")

    @query(f"loglik_{_name}_censored", f"select status, count(*) as n, round(sum(case when status = 1 then {_lp} else {_ls} end), 2) as loglik from (select value as v, {_z} as z, value / 20.0 as y, case when event_type <> 'view' then 1 else 0 end::bigint as status from events where value > 0) group by status")
    def _(spark, d, name=_name, p=_params):
        e = _events(spark, d).filter("value > 0").withColumn("seen", F.col("event_type") != "view")
        o, out = observations(e, "value", event="seen"), []
        for s in (0, 1):
            n, ll = fit.log_likelihoods(o.filter(F.col("status") == s), name, [p])
            out.append((s, n, round(float(ll[0]), 2)))
        return spark.createDataFrame(out, "status bigint, n bigint, loglik double")


@query("loglik_far_tail", "select 'right' as what, count(*) as n, round(sum(-value * 20), 4) as loglik from events union all select 'truncated', count(*), round(sum(-0.5 * value), 6) from events union all select 'narrow', count(*), round(sum(-0.5 * 0.001 + ln(exp(0.001 / 4) - exp(-0.001 / 4)) - ln(exp(0.001 / 2) - exp(-0.001 / 2)) + 0.0005), 5) from events")
def _(spark, d):
    """Exponential rows of rate 1: censored far out, truncated just below a value far out, and an interval in the middle of a narrow window far out."""
    e = _events(spark, d).select("value")
    far = F.col("value") * 20
    parts = {
        "right": e.select(far.alias("v"), F.lit(0).alias("s"), F.lit(None).cast("double").alias("u"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")),
        "truncated": e.select((F.lit(1000.0) + F.col("value") * 0.5).alias("v"), F.lit(0).alias("s"), F.lit(None).cast("double").alias("u"), F.lit(1000.0).alias("lo"), F.lit(None).cast("double").alias("hi")),
        "narrow": e.select(F.lit(899.99975).alias("v"), F.lit(3).alias("s"), F.lit(900.00025).alias("u"), F.lit(899.9995).alias("lo"), F.lit(900.0005).alias("hi")),
    }
    out = []
    for what, p in parts.items():
        n, ll = fit.log_likelihoods(observations(p, "v", status="s", upper="u", trunc_lower="lo", trunc_upper="hi"), "exponential", [(1.0,)])
        out.append((what, n, round(float(ll[0]), {"right": 4, "truncated": 6, "narrow": 5}[what])))
    return spark.createDataFrame(out, "what string, n bigint, loglik double")


@query("multiplicity_groups", "select count(*) as rows, (select round(sum(case when s = 1 then ln(1.2 / 50.0) + 0.2 * ln(v / 50.0) else 0 end - pow(v / 50.0, 1.2)), 2) from (select round(value) as v, case when event_type <> 'view' then 1 else 0 end as s from events where round(value) > 0)) as loglik from (select distinct round(value), event_type <> 'view' from events where round(value) > 0)")
def _(spark, d):
    e = _events(spark, d).select(F.round("value").alias("v"), (F.col("event_type") != "view").alias("seen")).filter("v > 0")
    g = fit.grouped_by_multiplicity(observations(e, "v", event="seen"))
    n, ll = fit.log_likelihoods(g, "weibull", [(1.2, 50.0)])
    return row(spark, rows=n, loglik=round(float(ll[0]), 2))


@query("fit_weibull_censored", """with recursive t as (select value as x, event_type <> 'view' as seen from events where value > 0), c as (select max(ln(x)) as top, count(*) as n, count(*) filter (seen) as d from t),
w as (select ln(x) - top as w, seen from t, c), b(i, lo, hi) as (select 0, ln(0.01::double), ln(100::double)
union all select i + 1, case when g > 0 then (lo + hi) / 2 else lo end, case when g > 0 then hi else (lo + hi) / 2 end
from (select i, lo, hi, (select 1 / exp((lo + hi) / 2) - sum(w * exp(exp((lo + hi) / 2) * w)) / sum(exp(exp((lo + hi) / 2) * w)) + avg(w) filter (seen) from w) as g from b where i < 48))
select c.n, round(exp((lo + hi) / 2), 3) as shape, round(exp(c.top + ln((select sum(exp(exp((lo + hi) / 2) * w)) from w) / c.d) / exp((lo + hi) / 2)), 2) as scale from b, c where i = 48""")
def _(spark, d):
    e = _events(spark, d).filter("value > 0").withColumn("seen", F.col("event_type") != "view")
    r = fit.newton_fit(observations(e, "value", event="seen"), "weibull")
    return row(spark, n=r["n"], shape=round(r["params"]["shape"], 3), scale=round(r["params"]["scale"], 2))


_FRACTION = "z"
for _k in range(60, 0, -1):
    _FRACTION = f"(z + {_k} / {_FRACTION})"
_MILLS = f"case when z > 2 then {_FRACTION} else exp(-0.5 * z * z) / sqrt(2 * pi()) / (1 - ({_PHI})) end"
for _name, _y in (("normal", "value"), ("lognormal", "ln(value)")):
    # Expectation and maximisation, whose fixed point is the maximum of the likelihood.
    _sql = f"""with recursive t as (select {_y} as y, event_type <> 'view' as seen from events where value > 0), e as (select count(*)::double as n, sum(y) filter (seen) as s1, sum(y * y) filter (seen) as s2 from t), c as (select y from t where not seen),
p(i, m, s) as (select 0, avg(y), stddev_pop(y) from t union all select i + 1, m2, sqrt(q2 - m2 * m2) from (
select i, (s1 + a) / n as m2, (s2 + b) / n as q2 from (select p.i, e.n, e.s1, e.s2, sum(m + s * lam) as a, sum(m * m + s * s + s * (y + m) * lam) as b from e, (select i, m, s, y, {_MILLS} as lam from (select p.i, p.m, p.s, c.y, (c.y - p.m) / p.s as z from p, c where p.i < 30)) p group by 1, 2, 3, 4)))
select (select n::bigint from e) as n, round(m, 2) as mu, round(s, 2) as sigma from p where i = 30"""

    @query(f"fit_{_name}_censored", _sql)
    def _(spark, d, name=_name):
        e = _events(spark, d).filter("value > 0").withColumn("seen", F.col("event_type") != "view")
        r = fit.newton_fit(observations(e, "value", event="seen"), name)
        return row(spark, n=r["n"], mu=round(r["params"]["mu"], 2), sigma=round(r["params"]["sigma"], 2))


@query("fit_logistic", """with recursive t as (select o_totalprice / 100000 as x from orders), p(i, m, s) as (select 0, median(x), stddev_pop(x) * sqrt(3) / pi() from t union all
select i + 1, m - (d22 * g1 - d12 * g2) / (d11 * d22 - d12 * d21), s - (d11 * g2 - d21 * g1) / (d11 * d22 - d12 * d21) from (
select i, any_value(m) as m, any_value(s) as s, sum(h) as g1, sum(z * h) - count(*) as g2, -sum(d) / any_value(s) as d11, -sum(z * d) / any_value(s) as d12, -sum(h + z * d) / any_value(s) as d21, -sum(z * (h + z * d)) / any_value(s) as d22
from (select i, m, s, (x - m) / s as z, tanh((x - m) / s / 2) as h, (1 - tanh((x - m) / s / 2) * tanh((x - m) / s / 2)) / 2 as d from p, t where i < 25) group by i))
select (select count(*) from t) as n, round(m, 4) as location, round(s, 4) as scale from p where i = 25""")
def _(spark, d):
    o = _orders(spark, d).select((F.col("o_totalprice") / 100000).alias("x"))
    r = fit.newton_fit(observations(o, "x"), "logistic")
    return row(spark, n=r["n"], location=round(r["params"]["location"], 4), scale=round(r["params"]["scale"], 4))


@query("fit_cauchy", """with recursive t as (select o_totalprice / 100000 as x from orders), p(i, m, s) as (select 0, median(x), 0.5::double from t union all
select i + 1, m + a / w, sqrt((q - a * a / w) / n * 2) from (select i, any_value(m) as m, count(*)::double as n, sum(1 / (1 + z * z)) as w, sum((x - m) / (1 + z * z)) as a, sum((x - m) * (x - m) / (1 + z * z)) as q from (select i, m, s, x, (x - m) / s as z from p, t where i < 120) group by i))
select (select count(*) from t) as n, round(m, 3) as location, round(s, 3) as scale from p where i = 120""")
def _(spark, d):
    o = _orders(spark, d).select((F.col("o_totalprice") / 100000).alias("x"))
    r = fit.newton_fit(observations(o, "x"), "cauchy")
    return row(spark, n=r["n"], location=round(r["params"]["location"], 3), scale=round(r["params"]["scale"], 3))


@query("score_weibull", "select round(sum(case when seen then ln(1.2 / 50.0) + 0.2 * ln(x / 50.0) else 0 end - pow(x / 50.0, 1.2)), 3) as value, round(sum(case when seen then 1 + u else 0 end - u * exp(u)), 3) as d_shape, round(sum(1.2 * (exp(u) - seen::int)), 3) as d_scale, round(sum(case when seen then u else 0 end - u * exp(u) - u * u * exp(u)), 3) as d_shape_shape, round(sum(1.2 * (exp(u) + u * exp(u) - seen::int)), 3) as d_shape_scale, round(sum(-1.44 * exp(u)), 3) as d_scale_scale from (select value as x, 1.2 * ln(value / 50.0) as u, event_type <> 'view' as seen from events where value > 0)")
def _(spark, d):
    """Log-likelihood, gradient and Hessian of a censored sample from one aggregation."""
    o = observations(_events(spark, d).filter("value > 0").withColumn("seen", F.col("event_type") != "view"), "value", event="seen")
    v, g, h = score.derivatives(o, "weibull", (1.2, 50.0))
    return row(spark, value=round(v, 3), d_shape=round(g[0], 3), d_scale=round(g[1], 3), d_shape_shape=round(h[0, 0], 3), d_shape_scale=round(h[0, 1], 3), d_scale_scale=round(h[1, 1], 3))


@query("own_reducer", "select count(*) as n, round(sum(value), 4) as total, max(value) as top from events")
def _(spark, d):
    """An aggregation of one's own, folded in tasks and merged in a tree."""
    import struct

    r = folds.Reducer(
        empty=lambda: (0, 0.0, 0.0), update=lambda s, b: (s[0] + b.num_rows, s[1] + float(b.column(0).to_numpy().sum()), max(s[2], float(b.column(0).to_numpy().max()))),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])), to_bytes=lambda s: struct.pack("<qdd", *s), from_bytes=lambda v: struct.unpack("<qdd", v),
    )
    n, total, top = folds.fold(_events(spark, d).select("value").repartition(9), r, fan=2)
    return row(spark, n=n, total=round(total, 4), top=top)


# Sources


@query("source_parquet", "select count(*) as rows, count(distinct 'one') as files, round(sum(value), 4) as total from events")
def _(spark, d):
    v = partitions.parquet_values(spark, f"{d}/events.parquet", "value")
    return v.agg(F.count("*").alias("rows"), F.count_distinct("partition_id").alias("files"), F.round(F.sum("x"), 4).alias("total"))


@query("source_arrays", "select count(*) * 2 as rows, sum(n_nationkey) * 2 as total from nation")
def _(spark, d):
    """A list of lists, flattened; the table has 25 rows at any scale."""
    keys = [r[0] for r in table(spark, d, "nation").select("n_nationkey").collect()]
    return tables.from_array(spark, [keys, keys]).agg(F.count("*").alias("rows"), F.sum("x").alias("total"))


@query("source_arrow", "select count(*) as rows, sum(n_nationkey)::double as total from nation")
def _(spark, d):
    """An Arrow table; 25 rows at any scale."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name").toArrow()
    return tables.from_arrow(spark, nation.to_reader(), "n_nationkey").agg(F.count("*").alias("rows"), F.sum("x").alias("total"))


@query("source_duckdb", "select 1000 as rows, sum(i * i)::double as total from range(1000) t(i)")
def _(spark, d):
    import duckdb

    found = tables.from_duckdb(spark, duckdb.connect(), "select i * i as square from range(1000) t(i)", "square")
    return found.agg(F.count("*").alias("rows"), F.sum("x").alias("total"))


@query("source_sql", "select count(*) as rows, round(sum(o_totalprice), 2) as total from orders where o_orderstatus = 'F'")
def _(spark, d):
    name = f"orders_{uuid.uuid4().hex}"
    _orders(spark, d).createOrReplaceTempView(name)
    return tables.from_sql(spark, f"select o_totalprice as price from {name} where o_orderstatus = 'F'", "price").agg(F.count("*").alias("rows"), F.round(F.sum("x"), 2).alias("total"))


@query("zip_weights", "select count(*) as n, round(sum((user_id % 5 + 1) * value) / sum(user_id % 5 + 1), 6) as mean from events")
def _(spark, d):
    e = _events(spark, d)
    z = evidence.zip_weights(e.select("event_id", "value"), e.select("event_id", (F.col("user_id") % 5 + 1).alias("w")), "event_id")
    return z.agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("mean"))


def _csv(spark, d, spoil: bool = False) -> str:
    """Events as CSV, a file for each type; some lines are spoilt by their id."""
    path = scratch(spark, "lifetimes")
    time, seen = F.format_string("%.2f", "value"), (F.col("user_id") % 3 != 0).cast("int").cast("string")
    line = F.concat_ws(",", time, seen)
    if spoil:
        n = F.col("event_id")
        line = F.when(n % 101 == 1, F.concat(F.lit("+"), line)).when(n % 101 == 2, F.concat(line, F.lit(",x"))).when(n % 101 == 3, F.concat(time, F.lit(",true"))).when(n % 101 == 4, F.concat(F.lit("1e999,"), seen)).otherwise(line)
    rows = _events(spark, d).select("event_type", line.alias("line"))
    head = rows.select("event_type").distinct().withColumn("line", F.lit(lifetime_csv.HEADER))
    every = head.withColumn("o", F.lit(0)).union(rows.withColumn("o", F.lit(1)))
    every.repartition("event_type").sortWithinPartitions("event_type", "o").drop("o").write.partitionBy("event_type").text(path)
    return path


_CSV = "from (select cast(printf('%.2f', value) as double) as t, case when user_id % 3 <> 0 then 1 else 0 end as e from events)"


@query("csv_lifetimes", f"select count(*) as n, sum(e)::bigint as events, round(sum(t), 2) as exposure, round(sum(e) / sum(t), 9) as rate {_CSV}")
def _(spark, d):
    r = fit.fit_exponential_censored(lifetime_csv.read_lifetimes(spark, f"{_csv(spark, d)}/*/*.txt"), "time", "event")
    return r.select("n", "events", F.round("exposure", 2).alias("exposure"), F.round("rate", 9).alias("rate"))


@query("csv_violations", "select * from (select case event_id % 101 when 1 then 'TIME' when 2 then 'FIELDS' when 3 then 'EVENT' else 'TIME_RANGE' end as code, count(*) as rows from events where event_id % 101 between 1 and 4 group by 1)")
def _(spark, d):
    return lifetime_csv.violations(spark, f"{_csv(spark, d, spoil=True)}/*/*.txt")


@query("csv_checkpointed", f"select 'COMPLETE' as code, 'CANCELLED' as first_code, count(*) as n, sum(e)::bigint as events, round(sum(e) / sum(t), 9) as rate {_CSV}")
def _(spark, d):
    """A fit that is cancelled after its first step and then goes on from its store."""
    path, store, calls = f"{_csv(spark, d)}/*/*.txt", scratch(spark, "store"), []
    first = lifetime_csv.checkpointed_fit(spark, path, store, "events", files_each=2, cancel=lambda: len(calls) > 0 or calls.append(1) is not None)
    r = lifetime_csv.checkpointed_fit(spark, path, store, "events", files_each=2)
    return row(spark, code=r["code"], first_code=first["code"], n=r["n"], events=r["events"], rate=round(r["rate"], 9))


@query("stream_resumable_fit", "select count(*) as n, sum(case when event_type <> 'view' then 1 else 0 end)::bigint as events, round(sum(value), 4) as exposure, round(sum(case when event_type <> 'view' then 1 else 0 end) / sum(value), 9) as rate from events")
def _(spark, d):
    """Micro-batches over files, stopped and started again on the same checkpoint."""
    path, store, marks = scratch(spark, "arrivals"), scratch(spark, "sums"), scratch(spark, "marks")
    e = _events(spark, d).select("value", (F.col("event_type") != "view").alias("seen"), F.pmod(F.col("event_id"), F.lit(3)).alias("k"))
    for k in range(3):
        e.filter(F.col("k") == k).drop("k").write.mode("append").parquet(path)
        stream = spark.readStream.schema("value double, seen boolean").option("maxFilesPerTrigger", 2).parquet(path)
        streams.resumable_fit(stream, "value", marks, store, "seen").awaitTermination()
    s = streams.stored_fit(spark, store)
    return s.select("n", "events", F.round("exposure", 4).alias("exposure"), F.round("rate", 9).alias("rate"))


# Delivery, coverage, digests

_CHUNKS = "select user_id % 7 as source, (event_id % 400) * 10 as row_start, (event_id % 400) * 10 + case when event_id % 13 = 0 then 15 when event_id % 17 = 0 then 5 else 10 end as row_stop from events"


def _chunks(spark, d) -> DataFrame:
    n = F.col("event_id")
    start = (n % 400) * 10
    return _events(spark, d).select((F.col("user_id") % 7).alias("source"), start.alias("row_start"), (start + F.when(n % 13 == 0, 15).when(n % 17 == 0, 5).otherwise(10)).alias("row_stop"))


@query("delivery_faults", f"with c as ({_CHUNKS}), o as (select source, row_start, row_stop, count(*) as c from c group by all), p as (select source, row_start, max(row_stop) as row_stop, count(*) as kinds from o group by 1, 2), b as (select *, coalesce(max(row_stop) over (partition by source order by row_start rows between unbounded preceding and 1 preceding), 0) as reached from p) select fault, count(*) as faults from (select case when row_start > reached then 'GAP' else 'OVERLAP' end as fault from b where row_start <> reached union all select 'OVERLAP' from b where kinds > 1 union all select 'DUPLICATE' from o, range(c - 1) where c > 1) group by fault")
def _(spark, d):
    return streams.delivery_faults(_chunks(spark, d)).groupBy("fault").agg(F.count("*").alias("faults"))


_ISLANDS = f"with c as ({_CHUNKS}), p as (select source, row_start, max(row_stop) as row_stop from c group by 1, 2), f as (select *, case when row_start > coalesce(max(row_stop) over (partition by source order by row_start rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as fresh from p), i as (select *, sum(fresh) over (partition by source order by row_start) as island from f), r as (select source, min(row_start) as row_start, max(row_stop) as row_stop from i group by source, island) "


@query("coverage_ranges", _ISLANDS + "select * from r")
def _(spark, d):
    return evidence.coverage(_chunks(spark, d))


@query("coverage_outcomes", _ISLANDS + "select s.source, coalesce(sum(row_stop - row_start), 0)::bigint as rows, any_value(s.n)::bigint as row_count, case when coalesce(sum(row_stop - row_start), 0) = any_value(s.n) then 'COMPLETE' when coalesce(sum(row_stop - row_start), 0) > 0 then 'PARTIAL' else 'FAILED' end as outcome from (select i as source, 4000 + (i % 2) * 5 as n from range(9) t(i)) s left join r using (source) group by s.source")
def _(spark, d):
    expected = spark.range(9).select(F.col("id").alias("source"), (F.lit(4000) + (F.col("id") % 2) * 5).alias("row_count"))
    return evidence.outcomes(evidence.coverage(_chunks(spark, d)), expected)


@query("chunk_names", "select event_id, 'chunk_' || substr(sha256('5:chunk' || strlen(event_type) || ':' || event_type || length(event_id::varchar) || ':' || event_id || length((event_id + 10)::varchar) || ':' || (event_id + 10)), 1, 32) as chunk_id from events")
def _(spark, d):
    return _events(spark, d).select("event_id", evidence.chunk_id("event_type", F.col("event_id"), F.col("event_id") + 10).alias("chunk_id"))


@query("replayed_rows", "select count(*) as rows, round(sum(value), 4) as total, true as same, false as same_after_change from events")
def _(spark, d):
    """A replay that is told from a changed copy by its digest."""
    kept, mark = evidence.replay(_events(spark, d).select("event_id", "value"))
    changed = kept.withColumn("value", F.when(F.col("event_id") == 0, F.col("value") + 1).otherwise(F.col("value")))
    s = kept.agg(F.count("*").alias("rows"), F.sum("value").alias("total")).first()
    return row(spark, rows=s["rows"], total=round(s["total"], 4), same=evidence.row_digest(kept.repartition(3)) == mark, same_after_change=evidence.row_digest(changed) == mark)


@query("log_density_outcomes", "select code, count(*) as rows, round(sum(log_density), 3) as total from (select case when event_id % 11 = 0 then 'nonfinite_observation' when value - 40 <= 0 then 'support_violation' end as code, case when event_id % 11 <> 0 and value - 40 > 0 then ln(1.2 / 50.0) + 0.2 * ln((value - 40) / 50.0) - pow((value - 40) / 50.0, 1.2) end as log_density from events) group by code")
def _(spark, d):
    e = _events(spark, d).select(F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 40).alias("v"))
    return evidence.log_density_outcomes(e, "v", "weibull", (1.2, 50.0)).groupBy("code").agg(F.count("*").alias("rows"), F.round(F.sum("log_density"), 3).alias("total"))


@query("result_json", "select '{\"code\":\"OK\",\"family\":\"exponential\",\"n\":' || count(*) || ',\"rate\":' || round(1 / avg(value), 4) || '}' as json from events")
def _(spark, d):
    r = scale.fit(_events(spark, d), "value", "exponential")
    return row(spark, json=evidence.canonical({"family": r["family"], "n": r["n"], "rate": round(r["params"]["rate"], 4), "code": r["code"]}))


# Numbers far from zero

_FAR = "1e9 + value * 0.001"


@query("offset_partitions", f"select count(*) as n, round(stddev_pop({_FAR}), 7) as sigma from events")
def _(spark, d):
    s = partitions.states(_events(spark, d).select(F.col("event_type").alias("partition_id"), F.expr("1e9D + value * 0.001D").alias("x")))
    return partitions.merge(s).select("n", F.round("sigma", 7).alias("sigma"))


@query("offset_weighted", f"with t as (select event_type, {_FAR} as x, user_id % 5 + 1 as w from events), m as (select event_type, sum(w * (x - 1e9)) / sum(w) as m from t group by 1) select event_type, round(sqrt(sum(w * (x - 1e9 - m) * (x - 1e9 - m)) / sum(w)), 7) as sd from t join m using (event_type) group by event_type")
def _(spark, d):
    e = _events(spark, d).select("event_type", F.expr("1e9D + value * 0.001D").alias("x"), (F.col("user_id") % 5 + 1).alias("w"))
    return samples.weighted_summary(e, "x", "w", by=["event_type"]).select("event_type", F.round("sd", 7).alias("sd"))


@query("offset_leave_one_out", f"with t as (select {_FAR} - 1e9 as y from events), a as (select count(*)::double as n, avg(y) as m, var_pop(y) as v from t) select 'normal' as family, round(sum(0.5 * (ln(2 * pi() * s2) + r * r / s2)), 1) as loo from (select (n * v - (y - m) * (y - m) * n / (n - 1)) / (n - 1) as s2, (y - m) * n / (n - 1) as r from t, a)")
def _(spark, d):
    e = _events(spark, d).select(F.expr("1e9D + value * 0.001D").alias("x"))
    return rounded(samples.leave_one_out(e, "x", "normal"), 1)


@query("offset_stream", f"select date_trunc('day', ts) as start, count(*) as n, round(stddev_pop({_FAR}), 6) as sigma from events group by 1")
def _(spark, d):
    e = _events(spark, d)
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("x", F.expr("1e9D + value * 0.001D"))
    name = f"offset_{uuid.uuid4().hex}"
    q = streams.windowed_fits(stream, "ts", "x", "1 day", late="3650 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("sigma", 6).alias("sigma"))


@query("exact_sum_of_squares", "select round(sum(cast(round(value * 100) as hugeint) * cast(round(value * 100) as hugeint)) / 10000.0, 3) as total from events")
def _(spark, d):
    return row(spark, total=round(float(exact.exact_sum(_events(spark, d), "value", squares=True)), 3))


# Descriptions, weights, choice


@query("describe_groups", """with s as (select event_type, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events group by event_type)
select s.event_type, any_value(n) as n, round(any_value(mean), 6) as mean, round(any_value(sd), 6) as sd, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median, round(any_value(q3), 6) as q3, count(*) filter (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as outliers from events join s using (event_type) group by s.event_type""")
def _(spark, d):
    r = samples.describe(_events(spark, d), "value", by=["event_type"])
    return rounded(r.select("event_type", "n", "mean", "sd", "q1", "median", "q3", "outliers"), 6)


@query("exact_quantiles", "select p::double as p, round(quantile_cont(l_extendedprice, p), 6) as value from lineitem, (values (0.001), (0.1), (0.5), (0.9), (0.999)) v(p) group by p".replace("quantile_cont(l_extendedprice, p)", "case p when 0.001 then quantile_cont(l_extendedprice, 0.001) when 0.1 then quantile_cont(l_extendedprice, 0.1) when 0.5 then quantile_cont(l_extendedprice, 0.5) when 0.9 then quantile_cont(l_extendedprice, 0.9) else quantile_cont(l_extendedprice, 0.999) end"))
def _(spark, d):
    from ..operators.ranking import quantiles

    probs = [0.001, 0.1, 0.5, 0.9, 0.999]
    return spark.createDataFrame([(p, round(v, 6)) for p, v in zip(probs, quantiles(_items(spark, d), "l_extendedprice", probs), strict=True)], "p double, value double")


@query("suggested_families", "with s as (select min(value) as lo, avg(value) as m, var_pop(value) as v from events), t as (select any_value(lo) as lo, avg(pow(value - m, 3)) / pow(any_value(v), 1.5) as sk, avg(pow(value - m, 4)) / pow(any_value(v), 2) - 3 as ku from events, s) select place::int as place, family, concat_ws(', ', case when lo > 0 then 'above 0' end, case when abs(sk) > 0.5 then 'skewed' end, case when ku > 1 then 'heavy tails' end) as why from t, (values (0, 'normal'), (1, 'lognormal'), (2, 'gamma'), (3, 'weibull'), (4, 'exponential')) f(place, family) where place = 0 or lo > 0")
def _(spark, d):
    return samples.suggest(_events(spark, d), "value")


@query("weighted_closed_fits", "with t as (select l_extendedprice / 10000 as x, l_quantity as w from lineitem), m as (select sum(w) as sw, sum(w * x) / sum(w) as m from t) select 'exponential' as family, round(1 / m, 4) as p1, cast(null as double) as p2 from m union all select 'normal', round(any_value(m), 4), round(sqrt(sum(w * (x - m) * (x - m)) / any_value(sw)), 4) from t, m")
def _(spark, d):
    """Weighted likelihood by Newton passes, where the answer has a closed form."""
    i, out = _items(spark, d).withColumn("v", F.col("l_extendedprice") / 10000).select("v", "l_quantity").persist(), []
    for f in ("exponential", "normal"):
        p = [*assess.fit_family(i, "v", f, weight="l_quantity")["params"].values(), None]
        out.append((f, round(p[0], 4), None if p[1] is None else round(p[1], 4)))
    i.unpersist()
    return spark.createDataFrame(out, "family string, p1 double, p2 double")


@query("best_by_p_value", "select n_name as family, n_regionkey / 10.0 as p_value from nation order by p_value desc, family limit 1")
def _(spark, d):
    return assess.best_by_p(table(spark, d, "nation").select(F.col("n_name").alias("family"), (F.col("n_regionkey") / 10.0).alias("p_value")))


@query("calibration", "select event_type, count(*) as runs, count(*) filter ((event_id % 1000) / 1000.0 < 0.05) as rejected, round(avg(((event_id % 1000) / 1000.0 < 0.05)::int), 8) as rate, round(sqrt(avg(((event_id % 1000) / 1000.0 < 0.05)::int) * (1 - avg(((event_id % 1000) / 1000.0 < 0.05)::int)) / count(*)), 8) as error from events group by event_type")
def _(spark, d):
    p = _events(spark, d).select("event_type", ((F.col("event_id") % 1000) / 1000.0).alias("p_value"))
    return rounded(assess.calibration(p, 0.05, by=["event_type"]), 8)


@query("top_models", "with s as (select count(*) as n, sum(value) as s1, var_pop(value) as var, sum(ln(value)) as sl, var_pop(ln(value)) as vl from events where value > 0), f as (select 'exponential' as family, 2 - 2 * (n * ln(n / s1) - n) as aic from s union all select 'normal', 4 + n * (ln(2 * pi()) + ln(var) + 1) from s union all select 'lognormal', 4 + n * (ln(2 * pi()) + ln(vl) + 1) + 2 * sl from s) select family, round(aic, 2) as aic, cast(row_number() over (order by aic) as int) as rank from f order by aic limit 2")
def _(spark, d):
    r = samples.compare(_events(spark, d).filter("value > 0"), "value", ["exponential", "normal", "lognormal"])
    return r.filter("rank <= 2").select("family", F.round("aic", 2).alias("aic"), "rank")


@query("fit_degenerate", "select o_orderstatus, family, count(*) as n, case family when 'exponential' then 'OK' else 'DEGENERATE_SAMPLE' end as code from orders, (values ('exponential'), ('normal'), ('uniform'), ('pareto')) f(family) group by 1, 2")
def _(spark, d):
    o = _orders(spark, d).select("o_orderstatus", F.lit(7.0).alias("x"))
    return fit.fit_closed(o, "x", ["exponential", "normal", "uniform", "pareto"], by=["o_orderstatus"]).select("o_orderstatus", "family", "n", "code")


@query("influence_full", "with t as (select event_id, exp(-0.02 * value) as f, (value - 50.0) / 50.0 as z from events), s as (select max(f) as top, count(*) as n from t), l as (select event_id, z, f / top as h, n from t, s) select event_id, round(z * z * h / pow(greatest(1e-12, 1 - h * 0.999999), 2), 3) as cook, round(z * sqrt(h / greatest(1e-12, 1 - h * 0.999999)), 4) as dffits, z * z * h / pow(greatest(1e-12, 1 - h * 0.999999), 2) > 4.0 / n as influential from l where h < 0.9999")
def _(spark, d):
    """All rows but those at the mode itself, whose distance has no bound."""
    r = samples.influence(_events(spark, d), "value", "exponential", (0.02,)).filter("leverage < 0.9999")
    return r.select("event_id", F.round("cook", 3).alias("cook"), F.round("dffits", 4).alias("dffits"), "influential")


# Goodness of fit


@query("ks_test", """with t as (select value as x, row_number() over (order by value) as i, count(*) over () as n, 1 - exp(-0.02 * value) as p from events),
g as (select x, max(i) as hi, min(i) as lo, any_value(n)::double as n, any_value(p) as p from t group by x), d as (select x, hi / n - p as plus, p - (lo - 1) / n as minus, n from g),
a as (select max(plus) as plus, max(minus) as minus, max(n) as n from d),
s as (select n, greatest(plus, minus) as d, case when plus >= minus then 'plus' else 'minus' end as side, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * greatest(plus, minus) as r from a)
select n::bigint as n, round(d, 9) as statistic, round(list_sum([2 * (case when k % 2 = 1 then 1 else -1 end) * exp(-2 * k * k * r * r) for k in range(1, 60)]), 6) as p_value, side, (select min(x) from d, s where case when side = 'plus' then plus else minus end = s.d) as place from s""")
def _(spark, d):
    r = gof.ks_test(_events(spark, d), "value", "exponential", (0.02,), exact_rows=0)
    return row(spark, n=r["n"], statistic=round(r["statistic"], 9), p_value=round(r["p_value"], 6), side=r["side"], place=r["place"])


@query("chi_square_whole", """with c as (select count(*)::double as n, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem), k as (select n, lo, hi, greatest(5, least(20, ceil(1 + log2(n)))) as k from c),
b as (select least(k - 1, floor((l_extendedprice - lo) / ((hi - lo) / k))) as b, count(*) as c from lineitem, k group by 1), s as (select sum((coalesce(c, 0) - n / k) * (coalesce(c, 0) - n / k) / (n / k)) as stat, any_value(k) as k, any_value(n) as n from k, (select i from range(20) t(i)) left join b on b.b = i where i < k)
select n::bigint as n, k::bigint as bins, round(stat, 4) as statistic, (k - 3)::bigint as df, round(1 - exp((k - 3) / 2 * ln(stat / 2) - stat / 2) * list_sum([exp(j * ln(stat / 2) - lgamma((k - 3) / 2 + j + 1)) for j in range(0, 400)]), 6) as p_value from s""")
def _(spark, d):
    i = _items(spark, d)
    s = i.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    r = gof.chi_square(i, "l_extendedprice", "uniform", tuple(s))
    return row(spark, n=r["n"], bins=r["bins"], statistic=round(r["statistic"], 4), df=r["df"], p_value=round(r["p_value"], 6))


@query("large_sample_bounds", """with c as (select least(floor((1 - exp(-0.02 * value)) * 4096), 4095) as b, count(*) as c from events group by 1), g as (select i, coalesce(c, 0) as c, (select count(*) from events)::double as n from range(4096) t(i) left join c on c.b = i),
u as (select i, c, n, sum(c) over (order by i) as cum from g),
s as (select max(n) as n, max(case when i < 4095 then abs(cum / n - (i + 1) / 4096.0) end) - 1e-12 as lower, greatest(max(cum / n - i / 4096.0), max((i + 1) / 4096.0 - (cum - c) / n)) + 1e-12 as upper, 0.5 * sum(abs(c / n - 1 / 4096.0)) as tv from u)
select n::bigint as n, round(lower, 9) as ks_lower, round(upper, 9) as ks_upper, round(tv, 9) as tv_lower, case when upper <= 0.05 then 'PASS' when lower > 0.05 then 'FAIL' else 'INCONCLUSIVE' end as decision from s""")
def _(spark, d):
    r = gof.large_sample(_events(spark, d), "value", "exponential", (0.02,), 0.05)
    return row(spark, n=r["n"], ks_lower=round(r["ks_lower"], 9), ks_upper=round(r["ks_upper"], 9), tv_lower=round(r["tv_lower"], 9), decision=r["decision"])


# Intervals


@query("derived_exponential", "with s as (select count(*)::double as n, sum(value) as t, 1.959963984540054 as z from events), r as (select *, n / t as rate, exp(-100 * n / t) as s100 from s) select 'mean' as what, round(t / n * exp(-z / sqrt(n)), 6) as lower, round(t / n * exp(z / sqrt(n)), 6) as upper from r union all select 'q50', round(ln(2) / rate * exp(-z / sqrt(n)), 6), round(ln(2) / rate * exp(z / sqrt(n)), 6) from r union all select 's100', round(1 / (1 + (1 - s100) / s100 * exp(z * 100 * rate / (1 - s100) / sqrt(n))), 6), round(1 / (1 + (1 - s100) / s100 * exp(-z * 100 * rate / (1 - s100) / sqrt(n))), 6) from r")
def _(spark, d):
    f = scale.information(scale.fit(_events(spark, d), "value", "exponential"))
    got = (("mean", uncertainty.derived_mean(f)), ("q50", uncertainty.derived_quantile(f, 0.5)), ("s100", uncertainty.derived_survival(f, 100.0)))
    return spark.createDataFrame([(k, round(v["lower"], 6), round(v["upper"], 6)) for k, v in got], "what string, lower double, upper double")


_ENDS = "with recursive s as (select count(*)::double as n, sum(value) as t from events), b(side, i, lo, hi) as (select side, 0, case side when -1 then n / t * 0.5 else n / t end, case side when -1 then n / t else n / t * 2 end from s, (values (-1), (1)) v(side) union all select side, i + 1, case when (side = -1) = (2 * (n * ln(n / t) - n - n * ln((lo + hi) / 2) + (lo + hi) / 2 * t) > 3.841458820694124) then (lo + hi) / 2 else lo end, case when (side = -1) = (2 * (n * ln(n / t) - n - n * ln((lo + hi) / 2) + (lo + hi) / 2 * t) > 3.841458820694124) then hi else (lo + hi) / 2 end from b, s where i < 50) "


@query("profile_exponential", _ENDS + "select 'rate' as what, round(min((lo + hi) / 2), 8) as lower, round(max((lo + hi) / 2), 8) as upper from b where i = 50 union all select 'mean', round(min(2 / (lo + hi)), 6), round(max(2 / (lo + hi)), 6) from b where i = 50 union all select 'survival', round(min(exp(-100 * (lo + hi) / 2)), 8), round(max(exp(-100 * (lo + hi) / 2)), 8) from b where i = 50")
def _(spark, d):
    r = fit.fit_exponential_censored(_events(spark, d).withColumn("e", F.lit(1)), "value", "e").first()
    got = scale.exponential_intervals(r["events"], r["exposure"], [("rate",), ("mean",), ("survival", 100.0)])
    return spark.createDataFrame([(g["quantity"], round(g["lower"], 6 if g["quantity"] == "mean" else 8), round(g["upper"], 6 if g["quantity"] == "mean" else 8)) for g in got], "what string, lower double, upper double")


@query("profile_weibull_shape", """with recursive t as (select value as x from events where value > 0), c as (select max(ln(x)) as top, avg(ln(x)) as ml, count(*)::double as n from t), w as (select ln(x) - top as w from t, c),
k as (select *, (select exp((lo + hi) / 2) from (with recursive b(i, lo, hi) as (select 0, ln(0.01::double), ln(100::double) union all select i + 1, case when g > 0 then (lo + hi) / 2 else lo end, case when g > 0 then hi else (lo + hi) / 2 end from (select i, lo, hi, (select 1 / exp((lo + hi) / 2) - sum(w * exp(exp((lo + hi) / 2) * w)) / sum(exp(exp((lo + hi) / 2) * w)) + avg(w) from w) as g from b where i < 48)) select * from b where i = 48)) as k from c),
p as (select k.*, n * ln(k) + n * k * (ml - top) - n * ln((select sum(exp(k * w)) from w, k) / n) as best from k),
b(side, i, lo, hi) as (select side, 0, case side when -1 then k * 0.8 else k end, case side when -1 then k else k * 1.25 end from p, (values (-1), (1)) v(side)
union all select side, i + 1, case when (side = -1) = (loss > 1.920729410347062) then m else lo end, case when (side = -1) = (loss > 1.920729410347062) then hi else m end from (select b.*, (lo + hi) / 2 as m, best - (n * ln((lo + hi) / 2) + n * (lo + hi) / 2 * (ml - top) - n * ln((select sum(exp((lo + hi) / 2 * w)) from w) / n)) as loss from b, p where i < 34))
select round(min((lo + hi) / 2), 5) as lower, round(max((lo + hi) / 2), 5) as upper from b where i = 34""")
def _(spark, d):
    e = _events(spark, d).filter("value > 0")
    r = scale.weibull_intervals(e, "value", fit.fit_weibull(e, "value"), [("shape",)])[0]
    return row(spark, lower=round(r["lower"], 5), upper=round(r["upper"], 5))


@query("profile_weibull_quantities")
def _(spark, d):
    """Mean, median, tenth part and survival of a Weibull fit, from three passes."""
    e = _events(spark, d).filter("value > 0")
    got = scale.weibull_intervals(e, "value", fit.fit_weibull(e, "value"), [("scale",), ("mean",), ("quantile", 0.5), ("quantile", 0.1), ("survival", 100.0)])
    return spark.createDataFrame([(g["quantity"], float(g.get("at", 0.0)), *[round(g[k], 6) for k in ("estimate", "lower", "upper")], g["passes"]) for g in got], "quantity string, at double, estimate double, lower double, upper double, passes int")


# Fits at scale

for _name, _p in (("exponential", "1 / avg(value), null"), ("normal", "avg(value), stddev_pop(value)"), ("lognormal", "avg(ln(value)), stddev_pop(ln(value))")):

    @query(f"scale_fit_{_name}", f"select count(*) as n, 'OK' as code, round(({_p.split(', ')[0]}), 8) as p1, round(({', '.join(_p.split(', ')[1:])})::double, 8) as p2, 1 as passes from events where value > 0")
    def _(spark, d, name=_name):
        r = scale.fit(_events(spark, d).filter("value > 0"), "value", name)
        p = [*r["params"].values(), None]
        return spark.createDataFrame([(r["n"], r["code"], round(p[0], 8), None if p[1] is None else round(p[1], 8), r["passes"])], "n bigint, code string, p1 double, p2 double, passes int")


@query("scale_fit_weibull_resumed", _BISECT.format(x="value", tab="events where value > 0").replace("select c.n,", "select c.n, true as reused_all, true as few_passes,"))
def _(spark, d):
    """A fit whose passes are kept, run again from its store: no pass reads the data."""
    e, store = _events(spark, d).filter("value > 0"), scratch(spark, "passes")
    scale.fit(e, "value", "weibull", store=store)
    r = scale.fit(e, "value", "weibull", store=store, resume=True)
    return row(spark, n=r["n"], reused_all=r["reused"] == r["passes"], few_passes=r["passes"] <= 6, shape=round(r["params"]["shape"], 5), scale=round(r["params"]["scale"], 4))


@query("incremental_fit", "select count(*) as n, round(avg(l_extendedprice), 4) as mu, round(stddev_pop(l_extendedprice), 3) as sigma, 2 as kept, 1 as added from lineitem")
def _(spark, d):
    """Two folders of files, and then a third, of which alone the second run reads rows."""
    path, store = scratch(spark, "parts"), scratch(spark, "states")
    i = _items(spark, d).select("l_extendedprice", (F.col("l_orderkey") % 3).alias("k"))
    for k in (0, 1):
        i.filter(F.col("k") == k).drop("k").write.parquet(f"{path}/part-{k}")
    scale.fit_incremental(spark, path, "l_extendedprice", "normal", store, by_folder=True)
    i.filter("k = 2").drop("k").write.parquet(f"{path}/part-2")
    r = scale.fit_incremental(spark, path, "l_extendedprice", "normal", store, by_folder=True)
    return spark.createDataFrame([(r["n"], round(r["params"]["mu"], 4), round(r["params"]["sigma"], 3), r["files"].get("kept", 0), r["files"].get("added", 0))], "n bigint, mu double, sigma double, kept int, added int")


@query("mixture_by_bic")
def _(spark, d):
    """Number of normals of least BIC for the mixture of two that event ids are mapped to."""
    u = (F.col("event_id") % 991 + 0.5) / 991.0
    e = _events(spark, d).select(F.when(F.col("event_id") % 3 == 0, column("normal", "ppf", u, 0.0, 1.0)).otherwise(column("normal", "ppf", u, 12.0, 2.0)).alias("x"))
    e = e.persist()
    r = samples.best_mixture(e, "x", most=3, steps=40)
    e.unpersist()
    return row(spark, components=r["components"], loglik=round(r["loglik"], 2))
