"""Keyed randomness: a draw depends on (seed, stream, key) only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str, seed: int | str = 0, stream: str = "") -> Column:
    """In [0, 1), a multiple of 2**-32."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


#: fixed values: coefficients of Acklam's published rational approximation of the normal quantile
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(u: Column) -> Column:
    u = F.least(F.greatest(u, F.lit(1e-9)), F.lit(1 - 1e-9))
    tail = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    outer = _poly(_C, tail) / (_poly(_D, tail) * tail + 1)
    q = u - 0.5
    r = q * q
    inner = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    return F.when(u < 0.02425, outer).when(u > 1 - 0.02425, -outer).otherwise(inner)


def normal(u: Column, mean, sd) -> Column:
    return F.lit(mean) + F.lit(sd) * normal_quantile(u)


def log_normal_length(u: Column, mu, sigma) -> Column:
    """Rounded; exactly exp(mu) without spread."""
    return F.round(F.exp(F.lit(mu) + F.when(F.lit(sigma) == 0, 0.0).otherwise(F.lit(sigma) * normal_quantile(u))))


def poisson(u: Column, mean: float) -> Column:
    """By inverse CDF below 30, else a rounded normal."""
    if mean <= 0:
        return F.lit(0).cast("long")
    if mean >= 30:
        return F.greatest(F.lit(0.0), F.round(normal(u, mean, mean**0.5))).cast("long")
    import math

    total, p, cuts = 0.0, math.exp(-mean), []
    for k in range(120):
        total += p
        cuts.append(total)
        p *= mean / (k + 1)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < u)).cast("long")


def choose(options: Column, u: Column) -> Column:
    return F.element_at(options, (F.floor(u * F.size(options)) + 1).cast("int"))
