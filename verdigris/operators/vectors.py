"""KB-03: exact top k by cosine through cells, angle bounds and dense blocks.

A pivot table is fitted on a bounded sample; every vector belongs to the cell of
the nearest pivot of its label and keeps its angle to it. Angles between unit
vectors obey the triangle inequality, so all vectors of a cell are at
least |angle(query, pivot) - angle(vector, pivot)| away from a query. A query is
compared with its nearest cells first; the k-th angle found there then rules out
cells whose bound is larger. What is left is compared in dense blocks: a task
multiplies a block of a cell's vectors with a block of the queries that
need the cell, and hands on each query's best. The best of all blocks get their
scores from the same expression as a plain search, so results are the same
row for row.

Vectors without any neighbourhood (random directions) rule out no cells; then all
queries meet all vectors of their label, as block products. That work grows
with queries times vectors, as it must for exact results.

Vectors that are null or have no length are no hits and no queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dround
from ..session import materialize
from .retrieval import TOP_K, cosine, top_k

#: Pivots of a label: the root of its vectors, at most so many; and of all labels (a label beyond them is one cell).
PIVOTS, MOST_PIVOTS = 256, 16_384
#: Cells that a query meets first.
PROBED = 2
#: Vectors, and queries, of a block at most (about, as hashes deal them).
BLOCK = 4096
#: Scores are published with six digits; whatever may round to the k-th best stays a candidate.
MARGIN = 2e-6


def fit_pivots(vectors: DataFrame, label: str, key: str, vec: str) -> dict:
    """label -> matrix of unit pivots, from the vectors of the smallest hashes of their keys: at most ``MOST_PIVOTS`` rows reach the driver."""
    # a stored table, whose size Spark knows: small, it is broadcast, and no vector is shuffled by label
    count = materialize(vectors.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("n")), "vector-counts")
    share = F.shiftrightunsigned(F.xxhash64(key).bitwiseXOR(F.lit(-(2**63))), 11).cast("double") / F.lit(float(2**53))
    rows = vectors.join(count, F.col(label) == F.col("_label")).where(share * F.col("n") <= 4 * PIVOTS)   # few rows of any label
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key))
    rows = rows.withColumn("place", place).where(F.col("place") <= F.least(F.ceil(F.sqrt("n")), F.lit(PIVOTS)))
    held: dict = {}
    for name, x in rows.orderBy("place", F.xxhash64(key)).limit(MOST_PIVOTS).select(label, F.col(vec).cast("array<double>")).collect():
        held.setdefault(name, []).append(x)
    return {name: _units(np.array(x)) for name, x in held.items()}


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else list(column), float)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def assign(vectors: DataFrame, pivots: dict, label: str, key: str, vec: str, every: bool = False) -> DataFrame:
    """(key, label, cell, angle, unit) of every vector: its nearest cell, or with ``every`` one row for each cell of its label."""

    def run(batches):
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for name in dict.fromkeys(names):
                at = pa.array(np.flatnonzero(names == name))
                units = _units(_matrix(batch.column(2).take(at)))
                own = pivots.get(name)
                angle = np.zeros((len(at), 1)) if own is None else _angles(units, own)
                cells = np.arange(angle.shape[1])[None, :].repeat(len(at), 0) if every else angle.argmin(axis=1)[:, None]
                angle = np.take_along_axis(angle, cells, 1)
                row = np.arange(len(at)).repeat(cells.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at).take(pa.array(row)), batch.column(1).take(at).take(pa.array(row)), pa.array(cells.ravel(), pa.int32()),
                     pa.array(angle.ravel()), _lists(units[row])], names=[key, label, "cell", "angle", "unit"])

    kinds = dict(vectors.dtypes)
    rows = vectors.select(key, label, F.col(vec).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) > 0))
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, cell int, angle double, unit array<double>")


def _compared(wanted: DataFrame, cells: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """(query_id, key, cos): of every cell block that ``wanted`` (query_id, label, cell, unit) asks for, each query's best ``k``, and what ties with them."""
    of = [label, "cell"]
    shape = (cells.groupBy(*of).agg(F.count(F.lit(1)).alias("n")).join(wanted.groupBy(*of).agg(F.count(F.lit(1)).alias("q")), of)
             .select(*of, F.ceil(F.col("n") / BLOCK).cast("int").alias("n"), F.ceil(F.col("q") / BLOCK).cast("int").alias("q")))
    shape = materialize(shape, "vector-shapes")
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = cells.join(shape, of).select(key, *of, "unit", part(key, "n").alias("block"), whole("q").alias("queries"))
    asked = wanted.join(shape, of).select("query_id", *of, "unit", part("query_id", "q").alias("queries"), whole("n").alias("block"))
    group = [*of, "block", "queries"]
    kinds = dict(cells.dtypes) | dict(wanted.dtypes)

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], key: [], "cos": []})
        vectors, ids, out = _matrix(held["unit"]), held[key].to_numpy(), []
        for a in range(0, len(asked), 512):
            some = asked.iloc[a : a + 512]
            cos = _matrix(some["unit"]) @ vectors.T
            least = np.partition(cos, max(0, cos.shape[1] - k), axis=1)[:, max(0, cos.shape[1] - k)] - MARGIN
            i, j = np.nonzero(cos >= least[:, None])
            out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[i], key: ids[j], "cos": cos[i, j]}))
        return pd.concat(out)

    return (asked.groupBy(*group).cogroup(held.groupBy(*group))
            .applyInPandas(run, f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, cos double"))


def _kth(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th best cosine of each query that has so many."""
    w = Window.partitionBy("query_id").orderBy(F.desc("cos"))
    best = hits.select("query_id", "cos").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("cos")).alias("least")).where("least IS NOT NULL")


def wanted_cells(queries: DataFrame, cells: DataFrame, pivots: dict, key: str, label: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits in the nearest cells, and the other (query_id, label, cell, unit) that can hold a better one."""
    reach = materialize(cells.groupBy(label, "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")), "vector-cells")
    q = assign(queries.withColumnRenamed("filter_label", label), pivots, label, "query_id", "query_vec", every=True)
    q = materialize(q.join(reach, [label, "cell"]).withColumn(
        "near", F.row_number().over(Window.partitionBy("query_id").orderBy("angle", "cell"))), "vector-queries")
    first = materialize(_compared(q.where(F.col("near") <= PROBED), cells, key, label, k), "vector-first")
    theta = _kth(first, k).select("query_id", (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") - MARGIN))) + 1e-9).alias("theta"))
    near = F.greatest(F.col("angle") - F.col("high"), F.col("low") - F.col("angle"))
    more = q.where(F.col("near") > PROBED).join(theta, "query_id", "left").where(F.col("theta").isNull() | (near <= F.col("theta")))
    return first, materialize(more.select("query_id", label, "cell", "unit"), "vector-wanted")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, label: str = "label", key: str = "vec_id",
                vec: str = "embedding") -> DataFrame:
    """Exact cosine top k of every query (query_id, filter_label, query_vec) within its label: query_id, key, rank, score."""
    pivots = fit_pivots(vectors.where(F.aggregate(F.col(vec).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x) > 0), label, key, vec)
    cells = materialize(assign(vectors, pivots, label, key, vec), "vector-cells-of")
    first, more = wanted_cells(queries, cells, pivots, key, label, k)
    hits = materialize(first.unionByName(_compared(more, cells, key, label, k)), "vector-hits")
    final = (hits.join(_kth(hits, k), "query_id", "left").where(F.col("least").isNull() | (F.col("cos") >= F.col("least") - MARGIN))
             .select("query_id", key))
    v = vectors.select(F.col(key), F.col(vec).cast("array<double>").alias("v"))
    scored = final.join(v, key).join(queries.select("query_id", "query_vec"), "query_id")
    scored = scored.select("query_id", key, dround(cosine(F.col("query_vec"), F.col("v")), 6).alias("score"))
    return top_k(scored, "query_id", key, k).select("query_id", key, "rank", "score")
