"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dround(c, scale: int) -> Column:
    """Publish a double rounded HALF_UP on its decimal value.

    ``F.round`` on a double and the oracle's ``round`` disagree on binary
    ties; Spark casts a double to DECIMAL through its shortest decimal
    string, so rounding that decimal is engine-independent. Values must stay
    below 1e28.
    """
    return F.round(col(c).cast("decimal(38,10)"), scale).cast("double")


def safe_div(num, den) -> Column:
    """``num / den`` with NULL for a zero or NULL denominator (ANSI-safe)."""
    return F.try_divide(col(num), col(den))


def pct_change(cur, prior) -> Column:
    """(cur - prior) / prior * 100, NULL when prior is NULL or 0."""
    cur, prior = col(cur), col(prior)
    return F.when(prior != 0, (cur - prior) / prior * F.lit(100.0))


def quality_score(months) -> Column:
    """Gap months -> data-quality score: 0 -> 1, 1-2 -> 2, 3-5 -> 3, 6+ -> 4."""
    m = col(months)
    return (F.when(m == 0, F.lit(1))
             .when(m <= 2, F.lit(2))
             .when(m <= C.MAX_IMPUTED_MONTHS, F.lit(3))
             .otherwise(F.lit(4)))


def pcaf_confidence(score) -> Column:
    """PCAF score -> confidence factor; unknown or NULL -> default."""
    s = col(score)
    e = F.lit(C.PCAF_CONFIDENCE_DEFAULT)
    for k in sorted(C.PCAF_CONFIDENCE, reverse=True):
        e = F.when(s == F.lit(k), F.lit(C.PCAF_CONFIDENCE[k])).otherwise(e)
    return e


def settled(df: DataFrame) -> DataFrame:
    """The same rows; what ``df`` computes is computed here, once per row.

    A generator over one struct. Filters and projections above it can't be
    rewritten in terms of the expressions below, which otherwise are copied
    into every filter that mentions them.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def trend_class(yoy, band: float = 0.0) -> Column:
    y = col(yoy)
    return (F.when(y.isNull(), F.lit("n/a"))
             .when(y > band, F.lit("up"))
             .when(y < -band, F.lit("down"))
             .otherwise(F.lit("stable")))
