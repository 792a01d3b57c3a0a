"""Exact quantiles by distributed selection: counts by ordered ranges, then only the range that holds the rank is refined.

A round is one pass over the columns that are still open. Each task counts
values by range (at most ``RANGES`` and some for a column), so what is shuffled and what the
last task reads are a few thousand rows a column, whatever the number of rows. The
first round's ranges are sign and binary exponent; later ones cut the range that
holds the rank evenly, between its true least and greatest value, until one value is
left or so few rows that they are counted by value. A column takes three
passes as a rule, and as many as its values have bits by twelves at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096
#: A range of at most so many rows is counted by value.
FEW = 10_000


def _exponent(x: Column) -> Column:
    """An ordered number for sign and binary exponent; NaN comes last, as Spark orders it."""
    size = F.least(F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-1080)), F.lit(1030)) + 1100
    return F.when(F.isnan(x), F.lit(3000)).when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("long")


def _holding(counts: DataFrame, ranks: dict[str, int] | None, share: float) -> dict[str, tuple]:
    """Per column: (least, greatest, rows, rank inside) of the range that holds the rank, and the column's rows."""
    w = Window.partitionBy("column").orderBy("range")
    c = counts.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("column"))})
    rank = F.greatest(F.ceil(F.col("all") * F.lit(share)), F.lit(1))
    if ranks is not None:
        rank = F.coalesce(*(F.when(F.col("column") == c_, F.lit(r)) for c_, r in ranks.items()))
    c = c.withColumn("rank", rank).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return {r["column"]: (r["low"], r["high"], r["n"], r["rank"] - (r["upto"] - r["n"])) for r in c.collect()}   # one row a column


def exact_quantile(df: DataFrame, columns: list[str], share: float = 0.5) -> dict[str, float | None]:
    """The smallest value of each column that at least ``share`` of its non-null values do not exceed; None without values."""

    def counted(items: list[Column]) -> DataFrame:
        rows = df.select(F.explode(F.array_compact(F.array(*items))).alias("x")).select("x.*")
        return rows.groupBy("column", "range").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))

    def item(c: str, x: Column, range_: Column, when: Column) -> Column:
        return F.when(x.isNotNull() & when, F.struct(F.lit(c).alias("column"), range_.cast("double").alias("range"), x.alias("x")))

    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    found: dict[str, float | None] = dict.fromkeys(columns)
    open_ = _holding(counted([item(c, x, _exponent(x), F.lit(True)) for c, x in value.items()]), None, share)
    while True:
        found |= {c: low for c, (low, high, _, _) in open_.items() if low == high or low != low}
        open_ = {c: o for c, o in open_.items() if not (o[0] == o[1] or o[0] != o[0])}
        if not open_:
            return found
        items = []
        for c, (low, high, n, _) in open_.items():
            x = value[c]
            cut = x if n <= FEW else F.floor((x - low) / F.lit(high - low) * RANGES)
            items.append(item(c, x, cut, x.between(low, high)))
        open_ = _holding(counted(items), {c: o[3] for c, o in open_.items()}, share)
