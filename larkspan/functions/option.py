"""Black-Scholes expressions: normal distribution, price, delta and implied volatility, all inside Catalyst."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from larkspan.functions.text import let

IV_LOW, IV_HIGH, IV_STEPS = 1e-4, 10.0, 30
_INTRINSIC_SLACK = 1e-6
# Coefficients of Cody's rational Chebyshev approximations of erf and erfc (Math. Comp. 23, 1969), by range of |x|.
_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346047, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
_NEAR_END, _MIDDLE_END, _FAR_END = 0.46875, 4.0, 6.0


def _quotient(ranges: tuple, x):
    """The quotient of two polynomials, highest power first; ``x`` is a column or an array."""
    above, below = (reduce(lambda total, c: total * x + c, more, first) for first, *more in ranges)
    return above / below


def erf(x: Column) -> Column:
    """The error function to double precision; beyond 6 it is 1."""
    return let(x.cast("double"), lambda v: let(F.least(F.abs(v), F.lit(_FAR_END)), lambda z: F.signum(v) * _erf(z)))


def _erf(z: Column) -> Column:
    near = let(z * z, lambda q: z * _quotient(_NEAR, q))
    middle = 1 - F.exp(-z * z) * _quotient(_MIDDLE, z)
    far = let(1 / (z * z), lambda q: 1 - F.exp(-z * z) / z * (F.lit(1 / math.sqrt(math.pi)) - q * _quotient(_FAR, q)))
    return F.when(z <= _NEAR_END, near).when(z <= _MIDDLE_END, middle).when(z < _FAR_END, far).otherwise(z * 0 + 1)


def erf_array(x: np.ndarray) -> np.ndarray:
    """``erf`` of an array."""
    z = np.abs(x)
    out = np.ones(len(z))
    out[np.isnan(z)] = np.nan
    at = z <= _NEAR_END
    out[at] = z[at] * _quotient(_NEAR, z[at] ** 2)
    at = (z > _NEAR_END) & (z <= _MIDDLE_END)
    out[at] = 1 - np.exp(-z[at] ** 2) * _quotient(_MIDDLE, z[at])
    at = (z > _MIDDLE_END) & (z < _FAR_END)
    q = z[at] ** -2.0
    out[at] = 1 - np.exp(-z[at] ** 2) / z[at] * (1 / math.sqrt(math.pi) - q * _quotient(_FAR, q))
    return np.copysign(out, x)


def norm_cdf(x: Column) -> Column:
    """The standard normal distribution function."""
    return 0.5 * (1 + erf(x / F.lit(math.sqrt(2))))


def d1(spot: Column, strike: Column, years: Column, sigma: Column, rate: Column | float = 0.0) -> Column:
    """(ln(S/K) + (r + sigma^2/2) T) / (sigma sqrt(T)); callers guard the domain."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return (F.ln(spot / strike) + (r + sigma * sigma / 2) * years) / (sigma * F.sqrt(years))


def _checked(spot: Column, strike: Column, value: Column, strict: bool) -> Column:
    bad = (spot <= 0) | (strike <= 0)
    wrong = F.raise_error(F.lit("spot and strike must be positive")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(bad, wrong).otherwise(value)


def intrinsic(spot: Column, strike: Column, call: Column) -> Column:
    """What exercising now is worth."""
    return F.when(call, F.greatest(spot - strike, F.lit(0.0))).otherwise(F.greatest(strike - spot, F.lit(0.0)))


def price(spot: Column, strike: Column, years: Column, sigma: Column, call: Column, rate: float = 0.0, strict: bool = False) -> Column:
    """European price; intrinsic without time or volatility. A spot or strike that isn't positive gives null, or an error if ``strict``."""
    alive = (years > 0) & (sigma > 0) & (spot > 0) & (strike > 0)
    one = F.lit(1.0)
    s, k, t, v = (F.when(alive, x).otherwise(one) for x in (spot, strike, years, sigma))
    discounted = k * F.exp(F.lit(-float(rate)) * t)
    sign = F.when(call, 1.0).otherwise(-1.0)
    value = let(d1(s, k, t, v, rate), lambda a: sign * (s * norm_cdf(sign * a) - discounted * norm_cdf(sign * (a - v * F.sqrt(t)))))
    return _checked(spot, strike, F.when(alive, value).otherwise(intrinsic(spot, strike, call)), strict)


def delta(spot: Column, strike: Column, years: Column, sigma: Column, call: Column, rate: float = 0.0, strict: bool = False) -> Column:
    """Sensitivity to spot; a step without time or volatility, 0 exactly at the money."""
    alive = (years > 0) & (sigma > 0) & (spot > 0) & (strike > 0)
    one = F.lit(1.0)
    s, k, t, v = (F.when(alive, x).otherwise(one) for x in (spot, strike, years, sigma))
    up = norm_cdf(d1(s, k, t, v, rate))
    step = F.when(call, F.when(spot > strike, 1.0).otherwise(0.0)).otherwise(F.when(spot < strike, -1.0).otherwise(0.0))
    return _checked(spot, strike, F.when(alive, F.when(call, up).otherwise(up - 1)).otherwise(step), strict)


def implied_vol(price_: Column, spot: Column, strike: Column, years: Column, call: Column, rate: float = 0.0) -> Column:
    """The volatility that gives ``price_``: the middle of the bracket after a fixed number of bisections; null if there is none."""
    usable = (price_ > 0) & (years > 0) & (spot > 0) & (strike > 0)
    usable = usable & (price_ >= intrinsic(spot, strike, call) - _INTRINSIC_SLACK)
    reachable = usable & (price(spot, strike, years, F.lit(IV_HIGH), call, rate) >= price_)

    def step(acc: Column, _: Column) -> Column:
        def halve(mid: Column) -> Column:
            above = price(spot, strike, years, mid, call, rate) > price_
            return let(above, lambda up: F.struct(F.when(up, acc["lo"]).otherwise(mid).alias("lo"), F.when(up, mid).otherwise(acc["hi"]).alias("hi")))

        return let((acc["lo"] + acc["hi"]) / 2, halve)

    bracket = F.struct(F.lit(IV_LOW).alias("lo"), F.lit(IV_HIGH).alias("hi"))
    return F.when(reachable, F.aggregate(F.sequence(F.lit(1), F.lit(IV_STEPS)), bracket, step, lambda acc: (acc["lo"] + acc["hi"]) / 2))


def implied_vol_arrow(price_: Column, spot: Column, strike: Column, years: Column, call: Column, rate: float = 0.0) -> Column:
    """``implied_vol`` in Arrow batches: Spark has no error function, and a series inside each bisection step costs about fifty times as much."""
    usable = (price_ > 0) & (years > 0) & (spot > 0) & (strike > 0) & (price_ >= intrinsic(spot, strike, call) - _INTRINSIC_SLACK)

    def value(s: np.ndarray, k: np.ndarray, t: np.ndarray, v: np.ndarray, sign: np.ndarray) -> np.ndarray:
        a = (np.log(s / k) + (rate + v * v / 2) * t) / (v * np.sqrt(t))
        cdf = lambda x: 0.5 * (1 + erf_array(x / math.sqrt(2)))
        return sign * (s * cdf(sign * a) - k * np.exp(-rate * t) * cdf(sign * (a - v * np.sqrt(t))))

    @F.pandas_udf(DoubleType())
    def solve(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, c: pd.Series, ok: pd.Series) -> pd.Series:
        good = ok.fillna(False).to_numpy(bool)
        out = np.full(len(p), np.nan)
        if good.any():
            p, s, k, t = (x[good].to_numpy(np.float64) for x in (p, s, k, t))
            sign = np.where(c[good].to_numpy(bool), 1.0, -1.0)
            low, high = np.full(len(p), IV_LOW), np.full(len(p), IV_HIGH)
            reachable = value(s, k, t, high, sign) >= p
            for _ in range(IV_STEPS):
                mid = (low + high) / 2
                above = value(s, k, t, mid, sign) > p
                low, high = np.where(above, low, mid), np.where(above, mid, high)
            out[good] = np.where(reachable, (low + high) / 2, np.nan)
        return pd.Series(out)

    args = [x.cast("double") for x in (price_, spot, strike, years)]
    found = solve(*args, call, usable)
    return F.when(~F.isnan(found), found)
