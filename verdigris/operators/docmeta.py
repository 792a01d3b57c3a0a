"""KB-02: document metadata and attribute bitmaps.

Every (attribute, value) has one bitmap per 32,768 document ids, built with
``bitmap_construct_agg``. A filter is a list of clauses, each an attribute with
the values it allows: a clause's bitmaps are joined by OR, the clauses' by AND,
before any text or posting is read. What comes out is a few kilobytes for
32,768 documents, and a document passes where its bit is set.

Ids are whole numbers from 0; documents without an id are in no bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: frameworks that documents are filed under
FRAMEWORKS = ("GRI_305", "IFRS_S2", "CSRD_ESRS_E1", "OJK_PSPK")


def doc_meta(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, language, category, framework, contains_numeric_data: what a knowledge base keeps beside a document.

    Language and category are the table's own columns; the framework follows the id, as no column holds one.
    """
    framework = F.element_at(F.array(*map(F.lit, FRAMEWORKS)), (F.pmod(F.col(key), F.lit(len(FRAMEWORKS))) + 1).cast("int"))
    return docs.select(F.col(key).cast("long").alias(key), F.col("lang").alias("language"), F.col("source").alias("category"), framework.alias("framework"),
                       F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)).cast("string").alias("contains_numeric_data"))


def bitmaps(meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """attribute, value, part (of the ids), bitmap; NULL is a value of its own that no clause can name."""
    names = [c for c in meta.columns if c != key]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in names)))
    rows = meta.where(F.col(key) >= 0).select(key, pairs.alias("x"))
    return (rows.groupBy("x.attribute", "x.value", F.bitmap_bucket_number(key).alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bitmap")))


def allowed(maps: DataFrame, clauses: dict[str, tuple[str, ...]]) -> DataFrame:
    """part, bitmap of the documents that meet every clause, by any of its values."""
    wanted = F.lit(False)
    for attribute, values in clauses.items():
        wanted = wanted | ((F.col("attribute") == attribute) & F.col("value").isin(*values))
    either = maps.where(wanted).groupBy("attribute", "part").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return (either.groupBy("part").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("met"))
            .where(F.col("met") == len(clauses)).select("part", "bitmap"))


def is_set(bitmap: Column, key: Column) -> Column:
    """Whether the bit of ``key`` is set in the bitmap of its part."""
    place = F.bitmap_bit_position(key)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def passing(rows: DataFrame, allowed_: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose document is allowed; all columns as they came."""
    part = allowed_.withColumnsRenamed({"part": "_part", "bitmap": "_bitmap"})
    joined = rows.join(part, F.bitmap_bucket_number(F.col(key)) == F.col("_part"))
    return joined.where(is_set(F.col("_bitmap"), F.col(key))).drop("_part", "_bitmap")
