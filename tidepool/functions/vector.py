"""Vector column functions (P8, F5-F7, F11) as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonzero(v: Column | str) -> Column:
    """True when some component is not zero (a zero vector is never indexed)."""
    return F.exists(_c(v), lambda x: x != F.lit(0.0))


def finite(v: Column | str) -> Column:
    """True when every component is a finite number."""
    return F.forall(_c(v), lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """dot(a, b) / (|a| |b|); NULL when either vector has zero norm."""
    den = norm(a) * norm(b)
    return F.when(den > F.lit(0.0), dot(a, b) / den)


def encode(v: Column | str) -> Column:
    """Vector -> JSON array text."""
    return F.to_json(_c(v))


def decode(text: Column | str) -> Column:
    """JSON array text -> ARRAY<DOUBLE>; '' means pending (NULL); bad text raises."""
    t = _c(text)
    parsed = F.from_json(t, "array<double>", {"mode": "FAILFAST"})
    return F.when(t == F.lit(""), F.lit(None).cast("array<double>")).otherwise(parsed)


def component_sum(v: Column | str) -> Column:
    """Compact digest of a vector for reports: the sum of its components."""
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)
