"""Array-valued signal expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An expression captured by a lambda is evaluated again for every element;
    binding it as a lambda variable keeps array expressions linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def standardise_sign(values: Column | str) -> Column:
    """Flip the signal when its largest excursion is negative."""
    return let(_c(values), lambda v: F.when(
        F.array_max(v) < F.abs(F.array_min(v)), F.transform(v, lambda x: -x)).otherwise(v))


def clip_fraction(values: Column | str, rail: float | None = None, tol: float = 0.05) -> Column:
    """Share of samples within ``tol`` of the rail (taken from the data when not given)."""
    v = _c(values)
    top = F.lit(rail) if rail is not None else F.array_max(F.transform(v, lambda x: F.abs(x)))
    limit = F.greatest(F.lit(0.0), top - tol)
    hits = let(limit, lambda bar: F.size(F.filter(v, lambda x: F.abs(x) >= bar)))
    return F.when((F.size(v) > 0) & (top > 0), hits / F.size(v)).otherwise(F.lit(0.0))


def nonnegative(value: Column | str) -> Column:
    """Rounding noise below zero becomes zero; a real negative is an error."""
    v = _c(value)
    bad = F.raise_error(F.concat(F.lit("negative entry "), v.cast("string"))).cast("double")
    return F.when(v < -1e-12, bad).otherwise(F.greatest(v, F.lit(0.0)))


def time_normalise(values: Column | str, points: int) -> Column:
    """Linear interpolation of an array onto ``points`` equally spaced positions.

    Arrays of at most one sample give NULL entries.
    """
    def resample(v: Column) -> Column:
        n = F.size(v)

        def at(i: Column) -> Column:
            pos = i * (n - 1) / F.lit(float(points - 1))
            left = F.least(F.floor(pos).cast("int"), n - 2)
            a, b = F.get(v, left), F.get(v, left + 1)
            return F.when(n > 1, a + (b - a) * (pos - left))

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)

    return let(_c(values), resample)


def peak_normalise(values: Column | str, peak: Column | str) -> Column:
    p = _c(peak)
    return F.transform(_c(values), lambda x: F.when(p > 0, x / p))


def max_renormalise(values: Column | str, floor: float = 1e-10) -> Column:
    """Scale an array by its own maximum, never dividing by less than ``floor``."""
    v = _c(values)
    return let(F.greatest(F.array_max(v), F.lit(floor)), lambda top: F.transform(v, lambda x: x / top))


def argmax(values: Column | str) -> Column:
    """0-based position of the first maximum."""
    return let(_c(values), lambda v: F.array_position(v, F.array_max(v)) - 1)


def rms(values: Column | str) -> Column:
    return let(_c(values), lambda v: F.sqrt(array_sum(F.transform(v, lambda x: x * x)) / F.size(v)))


def norm(values: Column | str) -> Column:
    v = _c(values)
    return F.sqrt(array_sum(F.transform(v, lambda x: x * x)))


def dot(a: Column | str, b: Column | str) -> Column:
    return array_sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; NULL when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def l1_normalise(values: Column | str, eps: float = 1e-8) -> Column:
    v = _c(values)
    return let(array_sum(v) + eps, lambda total: F.transform(v, lambda x: x / total))


def block_length(n: Column | str, min_b: int = 3, max_fraction: int = 8) -> Column:
    """Square-root block length held between ``min_b`` and ``n / max_fraction``."""
    size = _c(n).cast("int")
    top = F.greatest(F.lit(min_b), F.floor(size / max_fraction).cast("int"))
    root = F.floor(F.sqrt(size.cast("double"))).cast("int")
    return F.when(size > 0, F.greatest(F.lit(1), F.least(F.greatest(F.lit(min_b), F.least(top, root)), size))
                  ).otherwise(F.lit(1))
