"""Expression builders shared by the operators.

All of them return ``Column`` objects so they compile into whole-stage codegen
and can be combined into one ``agg`` over many columns (one scan, partial
aggregation on the map side).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qname(name: str) -> str:
    """Back-quote a column name for use inside SQL text or ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    return F.col(qname(name))


def as_double(c) -> Column:
    return col(c).cast("double")


def nan_to_null(c) -> Column:
    """NaN and NULL are both 'missing' in the reference data model."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def paired(a, b):
    """(a, b) restricted to rows where both are present (pairwise deletion)."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, as_double(a)), F.when(both, as_double(b))


def safe_corr(a, b) -> Column:
    """Pearson correlation with pairwise deletion; NULL when undefined.

    ``corr`` raises DIVIDE_BY_ZERO on a constant column under ANSI mode, so it
    is rebuilt from population moments with ``try_divide``.
    """
    x, y = paired(a, b)
    denom = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(denom > 0, F.try_divide(F.covar_pop(x, y), denom))


def skewness(c) -> Column:
    """Population (biased) skewness; NULL for a constant column."""
    c = as_double(c)
    return F.when(F.stddev_pop(c) > 0, F.skewness(c))


def kurtosis(c) -> Column:
    """Population excess kurtosis; NULL for a constant column."""
    c = as_double(c)
    return F.when(F.stddev_pop(c) > 0, F.kurtosis(c))


def pct(part, whole) -> Column:
    """100 * part / whole; NULL when whole is 0."""
    return F.try_divide(col(part).cast("double") * F.lit(100.0), col(whole).cast("double"))


def round_half_even(c, scale: int = 4) -> Column:
    """Python ``round`` is half-even; Spark ``round`` is half-up."""
    return F.bround(col(c), scale)


def stable_round(c, scale: int = 6) -> Column:
    """Rounding applied to floating outputs of the registered queries."""
    return F.round(col(c).cast("double"), scale)
