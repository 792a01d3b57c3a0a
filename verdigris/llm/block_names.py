"""Exact dedup by deterministic block naming (DataFrame operations only).

A text is its characters without white space, cut into blocks of fixed size.
Naming sorts the distinct blocks and numbers them; the names of adjacent
blocks are paired and the distinct pairs named in turn, until each document
has one integer. Equal integers mean equal texts: a name stands for one block
sequence and for no other, so there is nothing to collide.

Naming starts at the first block of every document. Only documents that share
their length and that first name can still be equal, so only their other
blocks are cut, shuffled and named; every other document already has an
identity of its own.

Defined results: a null text is the empty text; a null doc_id sorts last, so
it stays only in a group without any other id; rows repeated with one doc_id
and one text are members of one group and share its ``kept`` value
(``keep_one`` drops the repeats); an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_rows, materialize, meet_rows, text_key, text_or_empty, unused, without_white

#: Characters of the first block, of later blocks, and how many sorted runs the names are dealt over.
FIRST_BLOCK = 128
BLOCK = 512
RUNS = 1 << 16


def name_values(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """One integer for each distinct value of ``keys``.

    Values are dealt over ``RUNS`` sorted runs; a name is the place in its run
    times ``RUNS`` plus the run's number, so no two values share one and no
    run grows beyond its share.
    """
    values = df.select(*keys).distinct().withColumn("_run", F.pmod(F.xxhash64(*keys), F.lit(RUNS)))
    place = F.row_number().over(Window.partitionBy("_run").orderBy(*keys))
    return values.select(*keys, ((place.cast("long") - 1) * RUNS + F.col("_run")).alias(out))


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))


def text_names(docs: DataFrame, first_block: int = FIRST_BLOCK, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, text_key, chars, text_sha256 and the identity (first, rest)."""
    norm = without_white(text_or_empty())
    base = materialize(docs.select("doc_id", text_key().alias("text_key"),
                                   F.char_length(text_or_empty()).alias("chars"), norm.alias("_n"))
                       .select("doc_id", "text_key", "chars", F.char_length("_n").alias("size"),
                               F.substring("_n", 1, first_block).alias("head"),
                               F.sha2("_n", 256).alias("text_sha256")), "names-base")
    heads = base.groupBy("size", "head").agg(F.count("*").alias("sharing"))
    named = name_values(heads, ["size", "head"], "first")
    heads = materialize(heads.join(named, ["size", "head"]), "names-heads")   # the join below splits what very many rows share
    base = base.join(heads, ["size", "head"]).drop("head")

    open_rows = materialize(base.where((F.col("sharing") > 1) & (F.col("size") > first_block))
                            .select("doc_id", "text_key", "size").distinct()
                            .withColumn("row", F.monotonically_increasing_id()), "names-open")
    longest = open_rows.agg(F.max("size")).first()[0]
    if longest is None:
        return base.drop("sharing", "size").withColumn("rest", F.lit(-1).cast("long"))

    left = docs.select("doc_id", "text")
    o = open_rows.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "row")
    # the built side holds one short row for each open text; repeats of a row collapse to one text
    texts = (left.join(o.hint("shuffle_hash"), left["doc_id"].eqNullSafe(o["_d"])).where(text_key() == F.col("_k")))
    if open_rows.count() < base.where((F.col("sharing") > 1) & (F.col("size") > first_block)).count():
        texts = texts.dropDuplicates(["row"])
    cut = texts.select("row", F.posexplode(_blocks(F.substr(without_white(text_or_empty()), F.lit(first_block + 1)), block))
                       .alias("place", "block"))
    cut = materialize(cut, "names-blocks")
    names = materialize(cut.join(name_values(cut, ["block"], "name"), "block").select("row", "place", "name"), "names-0")
    width, level = -(-(longest - first_block) // block), 0
    while width > 1:
        half = F.floor(F.col("place") / 2).alias("place")
        side = lambda odd: F.max(F.when(F.col("place") % 2 == odd, F.col("name")))
        pairs = names.groupBy("row", half).agg(side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"))
        pairs = materialize(pairs, "names-pairs")
        width, level = -(-width // 2), level + 1
        names = materialize(pairs.join(name_values(pairs, ["left", "right"], "name"), ["left", "right"])
                            .select("row", "place", "name"), f"names-{level}")
    rest = o.join(names.select("row", F.col("name").alias("rest")), "row").drop("row")
    base = base.drop("sharing", "size")
    return (base.join(rest, base["doc_id"].eqNullSafe(rest["_d"]) & (base["text_key"] == rest["_k"]), "left")
            .drop("_d", "_k").withColumn("rest", F.coalesce("rest", F.lit(-1).cast("long"))))


def exact_groups(docs: DataFrame, first_block: int = FIRST_BLOCK, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, text_key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most characters before normalisation
    stays, then the one with the smallest doc_id.
    """
    rows = materialize(text_names(docs, first_block, block), "names-rows")
    best = F.max(F.struct("chars", F.negate("doc_id").alias("minus"))).alias("best")
    groups = materialize(rows.groupBy("first", "rest").agg(F.count("*").alias("group_size"), best), "names-sizes")
    # copies of one text meet their group's row here: two plain tables, so a hot group is split by the adaptive skew join
    out = rows.join(groups, ["first", "rest"])
    keep = F.negate("best.minus")
    return out.select("doc_id", "text_key", keep.alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
                      (F.col("doc_id").eqNullSafe(keep) & (F.col("chars") == F.col("best.chars"))).alias("kept"),
                      "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without their copies, all columns as they came."""
    groups = materialize(exact_groups(docs), "names-groups")
    out = drop_rows(docs, groups.where(~F.col("kept")))
    again = groups.where("kept").groupBy("doc_id", "keep_id", "text_sha256").agg(
        F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return out
    # rows repeated under one doc_id: one of each text stays
    again = materialize(groups.join(again.select("doc_id", "text_sha256").distinct().withColumnsRenamed({"doc_id": "_d", "text_sha256": "_h"}),
                                    F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_sha256") == F.col("_h")), "left_semi")
                        .where("kept"), "names-again")
    norm, = unused(docs, "_norm")
    one = meet_rows(docs, again).withColumn(norm, without_white(text_or_empty())).dropDuplicates(["doc_id", norm])
    return drop_rows(out, again).unionByName(one.drop(norm))
