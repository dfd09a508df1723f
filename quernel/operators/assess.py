"""Whole procedures: one door to all fits, all tests of one fit, families weighed against each other, profile intervals at scale."""

from __future__ import annotations

import hashlib
import html
import math
import platform
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.families import family
from ..plans.shared import ship
from ..sources.observations import CapabilityError, cell, observations
from . import gof
from .fit import CLOSED, PassBudgetError, fit_closed, fit_gumbel, fit_moments, fit_weibull, newton_fit, profile_sums


def fit_family(df: DataFrame, value: str, name: str, method: str = "mle", weight: str | None = None, event: str | None = None, **columns) -> dict:
    """Fit one family by the cheapest sound way: a closed form, a profile, or Newton passes where rows are weighted, censored or truncated."""
    f = family(name)
    state = cell("right" if event else "any" if {"status", "upper"} & set(columns) else "none", "any" if {"trunc_lower", "trunc_upper"} & set(columns) else "none", "frequency" if weight else "none", "fit")
    if not state.startswith("supported"):
        raise CapabilityError(state)
    if method == "moments":
        r = fit_moments(df, value, [f.name]).first()
        return {"family": f.name, "code": "OK", "n": r["n"], "params": dict(zip(f.params, [r["p1"], r["p2"], r["p3"]], strict=False))}
    if weight or event or columns:
        return newton_fit(observations(df, value, event=event, weight=weight, **columns), f.name)
    if f.name in CLOSED:
        r = fit_closed(df, value, [f.name]).first()
        return {"family": f.name, "code": r["code"], "n": r["n"], "params": dict(zip(f.params, [r["p1"], r["p2"]], strict=False)), "loglik": r["loglik"], "aic": r["aic"], "bic": r["bic"]}
    if f.name in ("weibull", "gumbel"):
        r = fit_weibull(df, value) if f.name == "weibull" else fit_gumbel(df, value)
        return {**r, "params": {k: r[k] for k in f.params if k in r}}
    return newton_fit(observations(df, value), f.name)


# Published piecewise approximations of tail probabilities of the adjusted Anderson-Darling and Cramer-von Mises statistics.
_AD = ((0.2, -13.436, 101.14, -223.73), (0.34, -8.318, 42.796, -59.938), (0.6, 0.9177, -4.279, -1.38), (math.inf, 1.2937, -5.709, 0.0186))
_CVM = ((0.0275, -13.953, 775.5, -12542.61), (0.051, -5.903, 179.546, -1515.29), (0.092, 0.886, -31.62, 10.897), (math.inf, 1.111, -34.242, 12.832))


def _tail(pieces, x: float) -> float:
    """Both lower pieces give the complement; the top one is held at its least value beyond its turning point."""
    for i, (end, a, b, c) in enumerate(pieces):
        if x < end:
            x = min(x, -b / (2 * c)) if c > 0 else x
            e = math.exp(min(0.0, a + b * x + c * x * x))
            return 1 - e if i < 2 else e
    return 0.0


def ad_p_value(a2: float, n: int) -> float:
    return _tail(_AD, a2 * (1 + 0.75 / n + 2.25 / n**2))


def cvm_p_value(w2: float, n: int) -> float:
    return _tail(_CVM, w2 * (1 + 0.5 / n))


def all_tests(df: DataFrame, value: str, name: str, params: Sequence[float]) -> DataFrame:
    """(statistic, value, p_value, n) of KS, AD, CvM and chi-square."""
    s = gof.edf_statistics(df, value, name, params).first()
    c = gof.chi_square(df, value, name, params)
    n = s["n"]
    rows = [("ks", s["ks"], gof.ks_p_value(s["ks"], n), n), ("ad", s["ad"], ad_p_value(s["ad"], n), n), ("cvm", s["cvm"], cvm_p_value(s["cvm"], n), n), ("chi_square", c["statistic"], c["p_value"], n)]
    return df.sparkSession.createDataFrame([(a, float(b), float(p), int(m)) for a, b, p, m in rows], "statistic string, value double, p_value double, n bigint")


def assess(df: DataFrame, value: str, families: Sequence[str], replicates: int = 100, seed: int = 0, threshold: float = 0.05, statistic: str = "ad", whole: int = gof.WHOLE) -> tuple[DataFrame, dict]:
    """Candidates (family, code, p_value, aic) by refit Monte Carlo, and the adequate one of least aic (ties by name)."""
    ship(df.sparkSession)
    rows = []
    least = df.agg(F.count(value).alias("n"), F.min(value).alias("lo")).first()
    for name in families:
        f = family(name)
        if least["n"] < (1 if f.name == "exponential" else 3):
            rows.append((f.name, "SAMPLE_TOO_SMALL", None, None))
        elif least["lo"] < f.low(*[1.0] * len(f.params)) or (f.name in ("weibull", "gamma", "lognormal") and least["lo"] <= 0):
            rows.append((f.name, "INVALID_SUPPORT", None, None))
        else:
            r = fit_family(df, value, f.name)
            p = gof.monte_carlo(df, value, f.name, replicates, seed, whole=whole).filter(F.col("statistic") == statistic).first()
            rows.append((f.name, r["code"], float(p["p_value"]), float(2 * len(f.params) - 2 * r["loglik"])))
    good = sorted((r[3], r[0]) for r in rows if r[2] is not None and r[2] >= threshold)
    best = {"code": "OK", "family": good[0][1], "aic": good[0][0]} if good else {"code": "NONE_ADEQUATE"}
    return df.sparkSession.createDataFrame(rows, "family string, code string, p_value double, aic double"), best


def hypothesis_test(df: DataFrame, value: str, generate: Callable, statistic: Callable, replicates: int = 200, seed: int = 0, two_sided: bool = False, most_rows: int = 100_000) -> dict:
    """p-value of a statistic of the sample against samples that ``generate(rng, n)`` draws under the null; one generator for each replicate.

    Replicates are whole samples, so samples of over ``most_rows`` rows are refused.
    """
    x = np.array([r[0] for r in df.select(F.col(value).cast("double")).limit(most_rows + 1).collect()])
    if len(x) > most_rows:
        raise gof.RefitRefused(f"over {most_rows} rows")
    seen, n = float(statistic(x)), len(x)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"v": [float(statistic(np.asarray(generate(np.random.default_rng([seed, int(r)]), n), float))) for r in b["id"]]})

    v = F.abs("v") if two_sided else F.col("v")
    out = df.sparkSession.range(replicates).mapInPandas(run, "v double").agg(F.avg((v >= F.lit(abs(seen) if two_sided else seen)).cast("double")).alias("p")).first()
    return {"statistic": seen, "p_value": out["p"], "n": n}


def best_by_p(candidates: DataFrame) -> DataFrame:
    """(family, p_value): of rows (family, p_value), the one of largest p-value; ties by name."""
    best = candidates.filter("p_value is not null").agg(F.min(F.struct((-F.col("p_value")).alias("p"), "family")).alias("b"))
    return best.select("b.family", (-F.col("b.p")).alias("p_value"))


def calibration(p_values: DataFrame, level: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """(by.., runs, rejected, rate, error): how often tests of true hypotheses reject, with the binomial error of the rate."""
    seen = p_values.filter("p_value is not null").groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(F.col("p_value") < F.lit(level)).alias("rejected"))
    rate = F.col("rejected") / F.col("runs")
    return seen.select(*by, "runs", "rejected", rate.alias("rate"), F.sqrt(rate * (1 - rate) / F.col("runs")).alias("error"))


def profile_shape(df: DataFrame, value: str, fitted: dict, level: float = 0.95, budget: int = 9) -> dict:
    """Profile-likelihood interval of a Weibull shape (or of a Gumbel scale) over data of any size.

    The profile needs one sum at each candidate, so a pass over eight candidates a side narrows both ends at once.
    """
    x = F.col(value).cast("double")
    weibull = fitted["family"] == "weibull"
    if weibull:
        s = df.agg(F.count(x).alias("n"), F.max(F.log(x)).alias("top"), F.avg(F.log(x)).alias("m")).first()
        w, mean, b0 = F.log(x) - F.lit(s["top"]), s["m"] - s["top"], fitted["shape"]
    else:
        s = df.agg(F.count(x).alias("n"), F.min(x).alias("top"), F.avg(x).alias("m")).first()
        w, mean, b0 = F.lit(s["top"]) - x, s["top"] - s["m"], 1 / fitted["scale"]
    n, limit = s["n"], float(sp.chi2_ppf(level, 1)) / 2

    def losses(points):
        row = profile_sums(df, w, [b0, *points]).first()
        value_at = [n * math.log(b) + n * b * mean - n * math.log(row[f"s0_{i}"] / n) for i, b in enumerate([b0, *points])]
        return [value_at[0] - v for v in value_at[1:]]

    spread = math.sqrt(2 * limit / n) * 1.2
    brackets = {-1: (b0, b0 * math.exp(-4 * spread - 0.0)), 1: (b0, b0 * math.exp(4 * spread))}
    for used in range(1, budget + 1):
        grids = {k: np.exp(np.linspace(math.log(a), math.log(b), 6)[1:]) for k, (a, b) in brackets.items()}
        both = losses([*grids[-1], *grids[1]])
        for k, own in ((-1, both[:5]), (1, both[5:])):
            a, points = brackets[k][0], list(grids[k])
            over = [i for i, v in enumerate(own) if v >= limit]
            if not over:
                brackets[k] = (points[-1], points[-1] * math.exp(k * 8 * spread))
            else:
                i = over[0]
                brackets[k] = (points[i - 1] if i else a, points[i])
        if all(abs(math.log(b / a)) < 1e-7 for a, b in brackets.values()):
            break
        if used == budget and any(abs(math.log(b / a)) > 1e-3 for a, b in brackets.values()):
            raise PassBudgetError("the interval is not narrow enough")
    low, high = (math.sqrt(a * b) for a, b in (brackets[-1], brackets[1]))
    return {"estimate": b0, "lower": low, "upper": high, "passes": used + 1} if weibull else {"estimate": 1 / b0, "lower": 1 / high, "upper": 1 / low, "passes": used + 1}


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(x, p): the empirical distribution function at each distinct value."""
    from .ranking import tied_ranks

    ranked, n = tied_ranks(df, value)
    return ranked.select("x", ((F.col("before") + F.col("c")) / F.lit(float(n))).alias("p"))


def environment_digest(spark) -> str:
    """A hash of logarithms and exponentials over a fixed sample and of the versions that made them."""
    x = np.linspace(0.001, 50, 4001)
    h = hashlib.sha256(np.log(x).tobytes() + np.exp(x).tobytes())
    h.update(f"{np.__version__}|{spark.version}|{platform.python_version()}".encode())
    return h.hexdigest()


#: Labels of a report by language.
LABELS = {
    "en": {"family": "Family", "code": "Outcome", "n": "Values", "loglik": "Log-likelihood", "aic": "AIC", "bic": "BIC", "passes": "Passes", "title": "Fitted distribution"},
    "de": {"family": "Familie", "code": "Ergebnis", "n": "Werte", "loglik": "Log-Likelihood", "aic": "AIC", "bic": "BIC", "passes": "Durchläufe", "title": "Angepasste Verteilung"},
    "fa": {"family": "خانواده", "code": "نتیجه", "n": "تعداد", "loglik": "لگاریتم درست‌نمایی", "aic": "AIC", "bic": "BIC", "passes": "گذرها", "title": "توزیع برازش‌شده"},
}


def report_html(fitted: dict, title: str | None = None, language: str = "en") -> str:
    """A small semantic page about one fit, in English, German or Persian (from right to left)."""
    names = LABELS[language]
    title = title or names["title"]
    shown = {**{k: v for k, v in fitted.items() if not isinstance(v, (dict, list))}, **fitted.get("params", {})}
    cells = "".join(f"<tr><th scope='row'>{html.escape(names.get(str(k), str(k)))}</th><td dir='ltr'>{html.escape(f'{v:.6g}' if isinstance(v, float) else str(v))}</td></tr>" for k, v in shown.items())
    direction = "rtl" if language == "fa" else "ltr"
    return f"<!DOCTYPE html><html lang='{language}' dir='{direction}'><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><main><h1>{html.escape(title)}</h1><table>{cells}</table></main></body></html>"
