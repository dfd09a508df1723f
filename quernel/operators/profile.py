"""Profile-likelihood intervals of any quantity of a two-parameter fit, censored or not.

An end of the interval is where the quantity is largest or least on the contour on which the log-likelihood has
lost half a chi-square quantile.  There the gradients of both are parallel.  Newton's method solves these
equations in the two parameters and the multiplier; value, gradient and Hessian come from exact derivatives, and one
aggregation serves all ends of all quantities.  Where a start from the quadratic approximation
does not lead there, the contour is approached in smaller losses.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.families import Family, family
from . import score

TOGETHER = 12


def quantity(f: Family, what: Sequence) -> tuple[Callable, Callable, Callable]:
    """A quantity on a scale without bounds as a function of the natural parameters, the way back, and its value: (parameter,), ("mean",), ("quantile", q) or ("survival", t)."""
    kind, rest = what[0], what[1:]
    log, same = (math.log, math.exp), (float, float)
    if kind in f.params:
        i = f.params.index(kind)
        to, back = log if f.positive[i] else same
        plain = lambda *p: float(p[i])
    elif kind == "mean":
        to, back = log if all(f.positive) or f.name == "lognormal" else same
        plain = lambda *p: float(f.mean(*p))
    elif kind == "quantile":
        to, back = log if all(f.positive) or f.name == "lognormal" else same
        plain = lambda *p: float(f.quantile(np.array([rest[0]]), *p)[0])
    elif kind == "survival":
        to, back = lambda v: math.log(v) - math.log1p(-v), lambda u: 1 / (1 + math.exp(-u)) if u > -700 else 0.0
        plain = lambda *p: float(f.upper(np.array([float(rest[0])]), *p)[0])
    else:
        raise ValueError(f"{f.name} has no {kind}")
    return (lambda *p: to(plain(*p))), back, plain


def _slopes(psi: Callable, u: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian of a smooth function of two numbers, by differences of fourth and second order."""
    e = np.diag(h)
    at = lambda i, j: psi(u + i * e[0] + j * e[1])
    mid = psi(u)
    g = np.array([(-at(2, 0) + 8 * at(1, 0) - 8 * at(-1, 0) + at(-2, 0)) / (12 * h[0]), (-at(0, 2) + 8 * at(0, 1) - 8 * at(0, -1) + at(0, -2)) / (12 * h[1])])
    aa = (-at(2, 0) + 16 * at(1, 0) - 30 * mid + 16 * at(-1, 0) - at(-2, 0)) / (12 * h[0] ** 2)
    bb = (-at(0, 2) + 16 * at(0, 1) - 30 * mid + 16 * at(0, -1) - at(0, -2)) / (12 * h[1] ** 2)
    ab = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / (4 * h[0] * h[1])
    return mid, g, np.array([[aa, ab], [ab, bb]])


class _End:
    """One end on its way: parameters on the fit's scale, multiplier, and the losses still to be reached."""

    def __init__(self, psi: Callable, side: int, top: np.ndarray, cov: np.ndarray, loss: float, h: np.ndarray):
        self.psi, self.side, self.top, self.cov, self.h = psi, side, top, cov, h
        self.goals, self.state, self.tries, self.last = [loss], "open", 0, math.inf
        self.begin(top, loss)

    def begin(self, near: np.ndarray, loss: float) -> None:
        _, g, _ = _slopes(self.psi, self.top, self.h)
        length = math.sqrt(max(float(g @ self.cov @ g), 1e-300))
        self.u = near if near is not self.top else self.top + self.side * math.sqrt(2 * loss) * (self.cov @ g) / length
        self.multiplier = -self.side * math.sqrt(2 * loss) / length
        self.unit = np.sqrt(np.diag(self.cov))

    def move(self, value: float, g: np.ndarray, h: np.ndarray, best: float) -> None:
        """A Newton step from what a pass has told."""
        target = best - self.goals[0]
        try:
            _, pg, ph = _slopes(self.psi, self.u, self.h)
            system = np.block([[h - self.multiplier * ph, -pg[:, None]], [g[None, :], np.zeros((1, 1))]])
            step = np.linalg.solve(system, -np.append(g - self.multiplier * pg, value - target))
        except (np.linalg.LinAlgError, ValueError, OverflowError):
            step = None
        self.tries += 1
        if step is None or not np.isfinite(step).all() or self.tries > 25:
            self.restart()
            return
        size = float(np.max(np.abs(step[:2]) / self.unit))
        step *= min(1.0, 2.0 / max(size, 1e-300))
        self.u, self.multiplier = self.u + step[:2], self.multiplier + step[2]
        # What a step leaves is of its square; one that is small and no longer shrinks is the rounding of the sums.
        arrived, self.last = size < 1e-7 or size < 1e-4 and size > self.last / 4, size
        if np.max(np.abs(self.u - self.top) / self.unit) > 1e5:
            self.state = "unbounded"
        elif arrived:
            if self.multiplier * self.side > 0:  # the other end
                self.restart()
            elif len(self.goals) > 1:
                self.goals.pop(0)
                self.tries, self.last = 0, math.inf
            else:
                self.state = "done"

    def restart(self) -> None:
        """Again from the estimate, in small losses."""
        if len(self.goals) > 1 or self.state == "again":
            self.state = "lost"
            return
        last = self.goals[0]
        self.goals, self.tries, self.state, self.last = [last * (k / 8) ** 2 for k in range(1, 9)], 0, "again", math.inf
        self.begin(self.top, self.goals[0])


def intervals(obs: DataFrame, fitted: dict, quantities: Sequence[Sequence], level: float = 0.95, passes: int = 80) -> list[dict]:
    """Profile intervals of ``quantities`` of a fit of Weibull, gamma, lognormal, normal or Gumbel to ``obs`` (value, status, weight).

    Each has quantity, at, estimate, lower, upper and whether a side is unbounded; or a reason: NO_DATA, SINGULAR_INFORMATION, NOT_COMPUTABLE.
    """
    name = fitted["family"]
    f = family(name)
    about = [{"quantity": q[0], **({"at": q[1]} if len(q) > 1 else {})} for q in quantities]
    if fitted.get("code") != "OK":
        return [{**a, "reason": "NO_DATA"} for a in about]
    if len(f.params) != 2:
        raise ValueError("two-parameter families only; an exponential fit has intervals of its own")
    known = score.admissible(obs)
    p = [fitted["params"][k] for k in f.params]
    positive = np.array(f.positive)
    top = np.where(positive, np.log(np.where(positive, p, 1)), p)
    natural = lambda u: np.where(positive, np.exp(np.clip(u, -700, 700)), u)
    best, _, h = score.derivatives(obs, name, p, known)
    used, loss = 1, float(sp.chi2_ppf(level, 1)) / 2
    w = np.linalg.eigvalsh(-h)
    if w[0] <= 1e-12 * abs(w[-1]):
        return [{**a, "reason": "SINGULAR_INFORMATION"} for a in about]
    cov = np.linalg.inv(-h)
    width = np.minimum(1e-2, 0.05 * np.sqrt(np.diag(cov))) * np.where(positive, 1, np.maximum(1.0, natural(top)[positive].max() if positive.any() else 1.0))
    width = np.maximum(width, 1e-4 * np.where(positive, 1, np.sqrt(np.diag(cov))))
    made = [quantity(f, q) for q in quantities]
    ends = [(_End(lambda u, to=to: to(*natural(u)), side, top, cov, loss, width)) for to, _, _ in made for side in (-1, 1)]
    # Losses are sums of what rows lose against the mean row at the estimate: those of whole log-likelihoods drown in rounding as rows grow.
    centre, best = best / known["mass"], None
    while used < passes:
        todo = [e for e in ends if e.state in ("open", "again")][:TOGETHER]
        if not todo:
            break
        points = [natural(e.u) for e in todo] + ([p] if best is None else [])
        told = score.derivatives_at(obs, name, points, known, centre)
        best = told[-1][0] if best is None else best
        for e, (value, g, hess) in zip(todo, told, strict=False):
            e.move(value, g, hess, best)
        used += 1
    out = []
    for k, (a, (to, back, plain)) in enumerate(zip(about, made, strict=True)):
        low, high = ends[2 * k], ends[2 * k + 1]
        if any(e.state not in ("done", "unbounded") for e in (low, high)):
            out.append({**a, "reason": "NOT_COMPUTABLE", "passes": used})
            continue
        value = lambda e, s: s * math.inf if e.state == "unbounded" else back(to(*natural(e.u)))  # noqa: B023, E731
        out.append({**a, "estimate": plain(*p), "lower": value(low, -1), "upper": value(high, 1), "lower_unbounded": low.state == "unbounded", "upper_unbounded": high.state == "unbounded", "passes": used})
    return out


def exact(df: DataFrame, value: str) -> DataFrame:
    """A column of exact values as observations."""
    return df.select(F.col(value).cast("double").alias("value"), F.lit(1).alias("status"), F.lit(1).alias("weight"))
