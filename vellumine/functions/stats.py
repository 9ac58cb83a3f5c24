"""Paired t-test, nearest-rank percentiles, back-off and display formats."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKOFF_BASE_S, BACKOFF_CAP_S, MOST_ATTEMPTS = 30, 900, 5


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 3e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_upper(t: float, df: float) -> float:
    """P(T > t) of Student's distribution."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e7
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1.0 - t_upper(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def paired_t(n: int, mean: float | None, sd: float | None, flat: bool) -> tuple[float, float, float, float, float]:
    """``(mean, t, p, low, high)`` of paired differences; ``flat``: all are equal, which decides zero variance."""
    if not n or mean is None:
        return 0.0, 0.0, 1.0, 0.0, 0.0
    if n == 1:
        return mean, 0.0, 1.0, mean, mean
    if flat:
        return (0.0, 0.0, 1.0, 0.0, 0.0) if mean == 0 else (mean, math.copysign(math.inf, mean), 0.0, mean, mean)
    error = sd / math.sqrt(n)
    t = mean / error
    half = t_quantile(0.975, n - 1) * error
    return mean, t, 2 * t_upper(abs(t), n - 1), mean - half, mean + half


def nearest_rank(p: int, value: str) -> Column:
    """The nearest-rank percentile of a group, 0 for an empty one."""
    return F.coalesce(F.expr(f"percentile_disc({p / 100.0}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))


def retry_window(attempts: Column) -> Column:
    """Seconds within which the next try falls: base * 2^(attempts - 1), capped."""
    return F.least(F.lit(float(BACKOFF_CAP_S)), F.lit(float(BACKOFF_BASE_S)) * F.pow(F.lit(2.0), F.least(attempts, F.lit(40)) - 1))


def full_jitter(attempts: int, rng: random.Random) -> float:
    return rng.random() * min(BACKOFF_CAP_S, BACKOFF_BASE_S * 2.0 ** (min(attempts, 40) - 1))


def human_bytes(n: int) -> str:
    size = float(n)
    for unit in ("B", "KiB", "MiB", "GiB"):
        if size < 1024:
            return f"{int(size)} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TiB"


def human_duration(seconds: float) -> str:
    s = int(seconds)
    for size, unit, sub, small in ((86_400, "d", 3600, "h"), (3600, "h", 60, "m"), (60, "m", 1, "s")):
        if s >= size:
            rest = s % size // sub
            return f"{s // size}{unit}{rest}{small}" if rest else f"{s // size}{unit}"
    return f"{s}s"


def format_p(p: float) -> str:
    return "<0.001" if p < 0.001 else f"{p:.3f}"


def format_signed(x: float) -> str:
    return f"{x:+.3f}"


def format_count(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"
