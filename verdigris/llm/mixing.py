"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
150 % of all words; a target stops at twice its source's size, the excess is
shared again by weight until no target is above. A document's size is its
number of words.

Each source takes every document as many whole times as its target allows and
fits the remaining budget from counts of documents by exact size: the same
share of each size, then a bounded-knapsack table over the sizes for what that
leaves. Where this doesn't meet the budget exactly, each size hands back one
of its documents, then two, four and so on, and the table is solved again for
the larger rest. Budgets of at most ``TABLE`` words so end with the largest sum
of all that are not above the budget, larger ones with the best that was found. Which documents
of a size are taken is drawn by a seeded hash, so reruns agree.

Sizes are counted by partial aggregates and a source's fit reads one row per
distinct size, however many documents it has. The draw ranks documents inside
hash ranges of at most about ``RANGE`` documents, whose counts place them, so
a source or a size that holds a third of all rows is ranked in many tasks.

Defined results: a null text has size 0 and is taken 0 times (as is any
document without words); a null source is a source of its own, last in order;
repeated rows are documents of their own; equal hashes are ordered by doc_id;
an empty table gives an empty result; further columns of the input are ignored
by ``plan`` and passed on by ``mixed``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, materialize, sums_before, text_key, text_or_empty, unused

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = 8
RANGE = 1000
#: Largest rest (in words) that the knapsack table covers; larger budgets have the part above it filled by shares and whole steps.
TABLE = 1 << 16


def words(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size: one row per source) with a target each.

    Sharing the excess again until none is above ends at min(most * size,
    level * weight) for one level; sorted by the level at which a source is
    full, the level follows from the sums over earlier sources. Places and sums
    are made by ranges, so sources may be as many as hosts.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    weighed = (sums_before(sizes.select("source", "source_size"), by_name, {"i": "1"}, "mix-places")
               .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")))
               .withColumn("cap", most * F.col("source_size"))
               .withColumn("full_at", F.col("cap") / F.col("weight")))
    filled = sums_before(weighed, [F.col("full_at"), *by_name], {"cap_before": "cap", "weight_before": "weight"}, "mix-levels")
    whole = filled.agg(F.sum("source_size"), F.sum("weight")).first()   # one row
    level = (F.lit(share * (whole[0] or 0)) - F.col("cap_before")) / (F.lit(whole[1] or 0) - F.col("weight_before"))
    # the level is the one at the first source that it doesn't fill; those after it come out lower
    top = filled.select(level.alias("try"), "full_at").where("try <= full_at").agg(F.max("try")).first()[0]
    return filled.select("source", "source_size", F.least("cap", F.lit(float("inf") if top is None else top) * F.col("weight")).alias("target"))


def _knapsack(sizes: list[int], free: list[int], rest: int) -> tuple[int, list[int]]:
    """The largest sum of at most ``rest`` from ``free`` documents of each size, and how many of each make it."""
    # reach: bit r is set if some choice among the items so far sums to r
    items, reach, steps, take = [], 1, [], [0] * len(sizes)
    mask = (1 << (rest + 1)) - 1
    for i, s in enumerate(sizes):
        left, part = min(free[i], rest // s), 1
        while left and not reach >> rest & 1:
            n = min(part, left)
            wider = reach | reach << (n * s) & mask
            if wider != reach:  # at most as many steps are kept as there are new sums
                steps.append(reach)
                items.append((i, n))
                reach = wider
            left, part = left - n, part * 2
        if reach >> rest & 1:
            break
    best = at = reach.bit_length() - 1
    for (i, n), before in zip(reversed(items), reversed(steps)):
        if not before >> at & 1:
            at -= n * sizes[i]
            take[i] += n
    return best, take


def fit_counts(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size to take so that their sum comes close below ``budget``: closest, if that is at most ``TABLE``.

    sizes ascending and distinct, budget at most the sum of all.
    """
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    limit, back, found = max(TABLE, sizes[-1]), 0, (-1, [])
    while True:
        take = [max(0, c * budget // total - back) for c in counts]
        rest = budget - sum(s * t for s, t in zip(sizes, take))
        if back and rest > limit:
            return found[1]
        for i in range(len(sizes) - 1, -1, -1):  # what the shares left beyond the table, largest sizes first
            if rest <= limit:
                break
            n = min(counts[i] - take[i], (rest - limit) // sizes[i] + 1, rest // sizes[i])
            take[i] += n
            rest -= n * sizes[i]
        got, more = _knapsack(sizes, [c - t for c, t in zip(counts, take)], rest)
        found = max(found, (budget - rest + got, [t + m for t, m in zip(take, more)]), key=lambda x: x[0])
        if got == rest or not any(take):
            return found[1]
        back = max(1, 2 * back)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = int(target // size)
    rest = round(target - whole * size)
    taken = fit_counts(rows["size"].tolist(), rows["n"].tolist(), rest)
    return pd.DataFrame({"source": rows["source"], "size": rows["size"], "n": rows["n"], "whole": whole, "more": taken})


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, text_key, source, size, source_size, target, times (copies in the mix)."""
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"),
                                   F.col("source").cast("string").alias("source"), words().alias("size"))
                       .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_key")), "mix-sizes")
    counts = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    goals = materialize(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                                weights, share, most), "mix-targets")
    g = goals.withColumnRenamed("source", "_s")
    fitted = (counts.where("size > 0").join(g, counts["source"].eqNullSafe(g["_s"])).drop("_s").groupBy("source")
              .applyInPandas(_fit, "source string, size long, n long, whole long, more long"))
    fitted = materialize(fitted, "mix-fitted").withColumnsRenamed({"source": "_s", "size": "_z"})

    # ranges of the hash, as many as the size's documents ask for; their counts place the rank inside
    placed = rows.join(fitted, rows["source"].eqNullSafe(fitted["_s"]) & (rows["size"] == fitted["_z"]), "left").drop("_s", "_z")
    spread = F.shiftrightunsigned("draw", 33).cast("double") / F.lit(float(1 << 31))
    drawn = F.coalesce((F.col("more") > 0) & (F.col("more") < F.col("n")), F.lit(False))
    placed = placed.withColumn("range", F.when(drawn, F.floor(spread * F.ceil(F.col("n") / RANGE)))
                               .otherwise(F.pmod("draw", F.lit(1 << 16))))  # no rank is asked for: anywhere
    ranges = (placed.where("more > 0 AND more < n").groupBy("source", "size", "range").agg(F.count("*").alias("c"))
              .withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("source", "size").orderBy("range")
                                                               .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("range").alias("_r"), "before"))
    placed = placed.join(ranges, placed["source"].eqNullSafe(ranges["_s"]) & (placed["size"] == ranges["_z"])
                         & (placed["range"] == ranges["_r"]), "left").drop("_s", "_z", "_r")
    rank = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("draw", "doc_id", "text_key"))
    more = F.when(F.col("more") >= F.col("n"), 1).when(F.col("before") + rank <= F.col("more"), 1).otherwise(0)
    placed = placed.withColumn("times", F.coalesce(F.col("whole") + more, F.lit(0)).cast("long"))
    return (placed.join(g, placed["source"].eqNullSafe(g["_s"]))
            .select("doc_id", "text_key", "source", "size", "source_size", "target", "times"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as planned, all columns as they came.

    Rows repeated under one doc_id and text all take the largest plan among them.
    """
    i, k, n = unused(docs, "_id", "_key", "_times")
    times = (plan(docs, **how).where("times > 0").groupBy("doc_id", "text_key").agg(F.max("times").cast("int").alias(n))
             .withColumnsRenamed({"doc_id": i, "text_key": k}))
    joined = docs.join(times, docs["doc_id"].eqNullSafe(times[i]) & (text_key() == times[k]))
    return joined.select(*columns_of(docs), F.explode(F.array_repeat(F.lit(0), F.col(n))).alias(n)).drop(n)
