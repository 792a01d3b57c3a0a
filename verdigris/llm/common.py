"""Shared pieces of the corpus operators: tables, word rules, ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.session import materialize, shared_dir  # noqa: F401  (re-used by the operators)

#: The six ASCII white-space characters of the word rule ``[^\x20\x09-\x0D]+``.
#: ``bytes.split()`` of Python splits at exactly these.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def texts_of(column: pa.Array) -> list[str | None]:
    """The texts of an Arrow column; bytes that are no UTF-8, which Spark lets pass in a string, read as U+FFFD."""
    return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def without_white(col: Column) -> Column:
    """The text with every white-space character deleted."""
    return F.translate(col, WHITE, "")


def text_key(col: str = "text") -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(text_or_empty(col))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes not to meet a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def columns_of(df: DataFrame) -> list[Column]:
    return [df[f"`{c}`"] for c in df.columns]


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows named by ``dropped`` (doc_id, text_key).

    The match is null-safe on doc_id and also holds the text's key, so rows
    that merely share a doc_id with a dropped one stay.
    """
    return docs.join(*_by_row(docs, dropped), "left_anti")


def meet_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``rows`` (doc_id, text_key) names."""
    return docs.join(*_by_row(docs, rows), "left_semi")


def _by_row(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, Column]:
    i, k = unused(docs, "_id", "_key")
    r = rows.select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct()
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return r, docs["doc_id"].eqNullSafe(r[i]) & (key == r[k])


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with a column for each of ``sums``: its expression summed over all rows earlier in ``order``.

    Rows are written by range of the order; only the ranges' totals, a row per range, meet in one task.
    ``order`` should tell all rows apart: else equal rows come in any order.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range").agg(*(F.sum(F.expr(e)).alias(n) for n, e in sums.items()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(totals, "_range").select(*df.columns, *(
        (F.col(f"_{n}") + F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0))).alias(n) for n, e in sums.items()))
