"""Aggregates that the summaries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("n", "mean", "std", "min", "q1", "median", "q3", "max", "nz")


def distribution(c: Column | str) -> list[Column]:
    """One column per field of FIELDS: exact quantiles with linear interpolation, sd with n - 1 (0 for one value)."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    q = lambda p: F.percentile(c, p)
    n = F.count(c)
    sd = F.when(n > 1, F.stddev_samp(c)).when(n == 1, 0.0)
    values = (n, F.avg(c), sd, F.min(c), q(0.25), q(0.5), q(0.75), F.max(c), F.count_if(c != 0))
    return [v.alias(f) for f, v in zip(FIELDS, values, strict=True)]


def effective_count(w: Column | str) -> Column:
    """(sum w)^2 / sum w^2 over positive weights, 0 without any."""
    w = (F.col(w) if isinstance(w, str) else w).cast("double")
    w = F.when(w > 0, w)
    return F.coalesce(F.sum(w) * F.sum(w) / F.sum(w * w), F.lit(0.0))


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def inbreeding_bin(f: Column) -> Column:
    return F.when(f <= 1e-9, "0").when(f <= 0.0625, "(0, 0.0625]").when(f <= 0.125, "(0.0625, 0.125]").when(f <= 0.25, "(0.125, 0.25]").otherwise("(0.25, 1]")
