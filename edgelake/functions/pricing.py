"""Black-Scholes prices and greeks as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgelake.constants import RISK_FREE, STRIKE_STEPS

# The rational approximation of the normal distribution by Hart as given by West (2005), highest power first.
NUMERATOR = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
DENOMINATOR = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
TURN = 7.07106781186547


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def let(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once; long formulas stay small code."""
    return F.transform(F.array(value), use)[0]


def normal_cdf(x: Column) -> Column:
    return let(x, _normal_cdf)


def _normal_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)

    def polynomial(powers: list[float]) -> Column:
        out = F.lit(powers[0])
        for p in powers[1:]:
            out = out * z + p
        return out

    fraction = z + 0.65
    for k in (4, 3, 2, 1):
        fraction = z + k / fraction
    tail = F.when(z > 37, 0.0).when(z < TURN, e * polynomial(NUMERATOR) / polynomial(DENOMINATOR)).otherwise(e / fraction / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def black_scholes(s: Column, k: Column, t: Column, r: Column | float, sigma: Column, kind: Column) -> Column:
    """A struct (price, delta, theta, gamma); theta by trading day. kind is ``call`` or ``put``; anything else raises.

    Without time or volatility the price is the intrinsic value.
    """
    r = F.lit(r) if isinstance(r, float) else r
    call = F.when(kind == "call", True).when(kind == "put", False).otherwise(F.raise_error(F.lit("option type must be call or put")).cast("boolean"))
    over = (t <= 0) | (sigma <= 0)
    sign = F.when(call, 1.0).otherwise(-1.0)
    inside = F.when(call & (s > k), 1.0).when(~call & (s < k), -1.0).otherwise(0.0)

    def struct(price: Column, delta: Column, theta: Column, gamma: Column) -> Column:
        return F.struct(F.greatest(price, F.lit(0.0)).alias("price"), delta.alias("delta"), theta.alias("theta"), gamma.alias("gamma"))

    def alive(v: Column) -> Column:
        price = v["sign"] * (s * v["n1"] - v["later"] * v["n2"])
        theta = (-(s * v["density"] * sigma) / (2 * F.sqrt(t)) - v["sign"] * r * v["later"] * v["n2"]) / 252
        return struct(price, v["sign"] * v["n1"], theta, v["density"] / (s * v["root"]))

    def with_normals(v: Column) -> Column:
        n1, n2 = normal_cdf(v["sign"] * v["d1"]), normal_cdf(v["sign"] * (v["d1"] - v["root"]))
        return let(F.struct(v["sign"].alias("sign"), v["root"].alias("root"), n1.alias("n1"), n2.alias("n2"), normal_pdf(v["d1"]).alias("density"), (k * F.exp(-r * t)).alias("later")), alive)

    root = sigma * F.sqrt(t)
    d1 = (F.ln(s / k) + (r + sigma * sigma / 2) * t) / root
    zero = F.lit(0.0)
    return F.when(over, struct(sign * (s - k), inside, zero, zero)).otherwise(let(F.struct(sign.alias("sign"), root.alias("root"), d1.alias("d1")), with_normals))


def strike_step(instrument: Column, steps: dict[str, float] | None = None, default: float = 50.0) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in (steps or STRIKE_STEPS).items() for x in (k, float(v))))
    return F.coalesce(F.try_element_at(table, instrument), F.lit(default))


def at_the_money(s: Column, step: Column) -> Column:
    """The strike nearest to s, halves to the even multiple; null where that is 0, as an option can't have it."""
    return F.nullif(F.bround(s / step) * step, F.lit(0.0))


def atm_premium(s: Column, sigma: Column, step: Column, kind: Column, days: Column, r: float = RISK_FREE) -> Column:
    """The premium of an at-the-money option; null where there is no strike, or the volatility is null or not positive."""
    strike = at_the_money(s, step)
    return F.when((sigma > 0) & strike.isNotNull(), black_scholes(s, strike, days / 252.0, r, sigma, kind))
