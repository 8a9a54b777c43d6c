"""The null algebra of cells, as columns: every numeric result is finite or null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, NEAR = 1e-300, 1e-9
INFINITY = float("inf")
WILSON_Z = 1.959963984540054


def null() -> Column:
    return F.lit(None).cast("double")


def finite(x: Column) -> Column:
    """NaN counts as larger than infinity, so one comparison rules out both."""
    return F.when(F.abs(x) < INFINITY, x)


def add(a: Column, b: Column) -> Column:
    """Null is the identity."""
    return finite(F.coalesce(a + b, a, b))


def subtract(a: Column, b: Column) -> Column:
    return finite(F.coalesce(a - b, a, -b))


def multiply(a: Column, b: Column) -> Column:
    return finite(a * b)


def divide(a: Column, b: Column) -> Column:
    return finite(F.when(F.abs(b) >= TINY, F.try_divide(a, b)))


def truth(test: Column) -> Column:
    """1.0, 0.0 or null."""
    return test.cast("double")


def compare(op: str, a: Column, b: Column, text: bool = False) -> Column:
    if op in ("==", "!="):
        same = a == b if text else F.abs(a - b) < NEAR
        return truth(same if op == "==" else ~same)
    return truth({"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op])


def both(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), truth((a != 0) & (b != 0)))


def either(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), truth((a != 0) | (b != 0)))


def negate(a: Column) -> Column:
    return truth(F.abs(a) < NEAR)


def choose(c: Column, a: Column, b: Column) -> Column:
    return F.when(F.abs(c) >= NEAR, a).otherwise(b)


def least(args: list[Column]) -> Column:
    return F.least(*args) if len(args) > 1 else args[0]


def greatest(args: list[Column]) -> Column:
    return F.greatest(*args) if len(args) > 1 else args[0]


def safe_div(n: Column, d: Column, default: Column) -> Column:
    return F.when((F.abs(d) >= TINY) & n.isNotNull(), finite(F.try_divide(n, d))).otherwise(default)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(x, low), high))


def power(a: Column, b: Column) -> Column:
    return finite(F.pow(a, b))


def square_root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def logarithm(x: Column, ten: bool = False) -> Column:
    return F.when(x > 0, F.log10(x) if ten else F.ln(x))


def half_away(x: Column) -> Column:
    """Rounds halves away from zero. Above 2^52 a double has no fraction."""
    whole = F.floor(F.abs(x)).cast("double")
    up = F.when(F.abs(x) - whole >= 0.5, whole + 1).otherwise(whole)
    return F.when(F.abs(x) >= 4503599627370496.0, x).otherwise(F.signum(x) * up)


def floor(x: Column) -> Column:
    return F.when(F.abs(x) >= 4503599627370496.0, x).otherwise(F.floor(x).cast("double"))


def ceil(x: Column) -> Column:
    return F.when(F.abs(x) >= 4503599627370496.0, x).otherwise(F.ceil(x).cast("double"))


def euclid(a: Column, b: Column) -> Column:
    """Remainder that is never negative."""
    return F.when(F.abs(b) >= TINY, finite(F.pmod(a, F.abs(F.when(F.abs(b) >= TINY, b)))))


def _polynomial(x: Column, *highest_first: float) -> Column:
    out = F.lit(highest_first[0])
    for c in highest_first[1:]:
        out = F.lit(c) + x * out
    return out


#: Published approximations' coefficients, of the highest power first.
TAIL = (1.330274, -1.8212560, 1.781478, -0.3565638, 0.3193815)
CENTER_UP = (-25.44106049637, 41.39119773534, -18.61500062529, 2.50662823884)
CENTER_DOWN = (3.13082909833, -21.06224101826, 23.08336743743, -8.47351093090, 1.0)
FAR_OUT = (3.960315187e-7, 2.888167364e-7, 3.21767881768e-5, 3.951896511919e-4, 3.8405729373609e-3, 2.76438810333863e-2, 0.1607979714918209, 0.9761690190917186, 0.3374754822726147)


def norm_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, with the coefficients that published results were made with."""
    z = (x - mu) / F.when(sigma > 0, sigma)
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    density = 0.3989422804014327 * F.exp(-z * z / 2.0)
    beyond = density * t * _polynomial(t, *TAIL)
    return finite(F.when(z > 0, 1.0 - beyond).otherwise(beyond))


def norm_inv(p: Column, mu: Column, sigma: Column) -> Column:
    """Beasley, Springer and Moro."""
    p = F.when((p > 0) & (p < 1), p)
    y = p - 0.5
    r = y * y
    central = y * _polynomial(r, *CENTER_UP) / _polynomial(r, *CENTER_DOWN)
    series = _polynomial(F.ln(-F.ln(F.when(y > 0, 1.0 - p).otherwise(p))), *FAR_OUT)
    unit = F.when(F.abs(y) < 0.42, central).otherwise(F.when(y < 0, -series).otherwise(series))
    return finite(F.when(sigma > 0, mu + sigma * unit))


def nbinom_cdf(k: Column, mu: Column, alpha: Column) -> Column:
    """Negative binomial in mean and dispersion, by the ratio of neighbouring probabilities."""
    good = (mu > 0) & (alpha > 0) & k.isNotNull()
    r, p, top = 1.0 / alpha, 1.0 / (1.0 + alpha * mu), F.floor(k).cast("long")
    first = F.pow(p, r)
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * ((r + i - 1.0) / i * (1.0 - p))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    counts = F.transform(F.when(top >= 1, F.sequence(F.lit(1).cast("long"), top)).otherwise(F.array().cast("array<bigint>")), lambda i: i.cast("double"))
    total = F.aggregate(counts, start, step, lambda acc: acc["total"])
    return F.when(good, F.when(top < 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))))


def nbinom_sf(k: Column, mu: Column, alpha: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - nbinom_cdf(k, mu, alpha))) + F.when(nbinom_cdf(k, mu, alpha).isNotNull(), 0.0)


def wilson(p: Column, n: Column, upper: bool) -> Column:
    p, n = F.when((p >= 0) & (p <= 1), p), F.when(n > 0, n)
    z2 = WILSON_Z * WILSON_Z
    denominator = 1.0 + z2 / n
    center = (p + z2 / (2.0 * n)) / denominator
    margin = WILSON_Z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / denominator
    out = center + margin if upper else center - margin
    return F.when(out.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)))


def key_text(x: Column, kind: str) -> Column:
    """Lookup keys are text; a whole number has no decimal point."""
    if kind == "string":
        return x
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def whole(x: float) -> int:
    return int(math.trunc(x))
