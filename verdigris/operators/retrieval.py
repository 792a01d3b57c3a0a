"""Batch retrieval behind report evidence: chunking, BM25, cosine top-k, packing.

* Windows are cut with array functions (``sequence`` + ``slice``), one row per
  window, whole texts; chunks by paragraph and sentence are in ``chunks``.
* BM25 reads a stored index, written once per table, in segments of whole documents. A segment is
  scored by itself, with numpy, and sends on only documents that can still reach a query's top k, so a query matching a
  third of the corpus never shuffles its candidates.
* Vector search is filtered by the framework label (equi-join on the label),
  cosine computed JVM-side with ``zip_with``/``aggregate``.
* Packing is a running sum over each query's ranked hits (a top-k group).
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import dround
from ..session import materialize, shared_dir

# FIXED VALUES: retrieval parameters of the reference
CHUNK_TOKENS = 300
CHUNK_OVERLAP = 50
TOP_K = 5
SCORE_THRESHOLD = 0.40
BENCHMARK_THRESHOLD = 0.30
CHARS_PER_TOKEN = 4
MIN_TAIL_CHARS = 100
TRUNCATION_MARK = "..."
PASSAGE_SEPARATOR = "\n\n---\n\n"
BM25_K1 = 1.2
BM25_B = 0.75

WS = r"[\t\n\x0B\f\r ]+"
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Whitespace tokens, empty strings dropped."""
    return F.filter(F.split(text, WS), lambda t: t != "")


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS,
          overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` tokens, stepping ``size - overlap``, wherever sentences end.

    A window is emitted at 0 and at every step that still adds tokens past
    the previous window; every token of every text lands in some chunk.
    """
    step = size - overlap
    t = docs.select(key, tokens(F.col(text)).alias("toks"))
    n = F.size("toks")
    starts = F.sequence(F.lit(0), F.greatest(n - F.lit(overlap) - 1, F.lit(0)), F.lit(step))
    c = t.select(key, "toks", F.posexplode(starts).alias("chunk_no", "start"))
    body = F.slice("toks", F.col("start") + 1, size)
    return c.select(key, "chunk_no", F.size(body).alias("n_tokens"), F.array_join(body, " ").alias("chunk_text"))


@dataclass(frozen=True)
class Index:
    """Stored postings of a corpus: who holds a term and how often, how many hold it, and the corpus's size.

    postings: bucket, term, segment (a hash of the key), the metadata columns, and as arrays keys, dls, tfs of the
    term's postings there; terms: bucket, term, metadata, df; stats: n_docs, avgdl, buckets. Postings and terms are laid out
    by ``bucket``, a hash of the term, and in the order of terms inside it, so a query reads its terms'
    buckets only; a term that very many documents hold is spread over as many rows as segments hold it.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str
    meta: tuple[str, ...]


#: Bytes of text to an index bucket, and to a segment: their numbers grow with the corpus.
BUCKET_BYTES = 32 << 20
SEGMENT_BYTES = 8 << 20


def _bucket(term, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for every value, from 0, in the order of values; a null comes first."""
    values = pa.concat_arrays(column.chunks)
    named = values.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(named.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order))
    return place[named.indices.to_numpy()]


def _words(joined: pa.Array) -> tuple[pa.Array, pa.Array]:
    """How many words each text of words joined by a space holds (null: no text), and all words."""
    lists = pc.split_pattern(joined, " ")
    found = lists.flatten()
    return pc.if_else(pc.equal(joined, ""), pa.scalar(0, pa.int32()), pc.list_value_length(lists)), found.filter(pc.not_equal(found, ""))


def _segment_postings(key: str, meta: tuple[str, ...]):
    """segment, key, metadata, words (joined; null: no text) of a segment's rows -> segment, term, metadata, keys, dls, tfs, n.

    Rows of one key, metadata and length count as one document. The term NULL holds all documents, for the corpus's size.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dls, words = _words(pa.concat_arrays(t["words"].chunks).cast(pa.string()))
        # documents in the order of metadata; what is told apart by it is told apart by the highest digits
        number = np.zeros(t.num_rows, "i8")
        for column in (*(t[m] for m in meta), t[key], pa.chunked_array([dls])):
            code = _codes(column)
            number = np.unique(number * (code.max() + 1) + code, return_inverse=True)[1]
        _, at, doc = np.unique(number, return_index=True, return_inverse=True)
        group = np.zeros(t.num_rows, "i8")
        for m in meta:
            code = _codes(t[m])
            group = group * (code.max() + 1) + code
        group = np.unique(group, return_inverse=True)[1][at]
        n, named = len(at), words.dictionary_encode()
        pair, tf = np.unique(named.indices.to_numpy().astype("i8") * n + np.repeat(doc, pc.fill_null(dls, 0).to_numpy()), return_counts=True)
        pair, tf = np.append(pair, len(named.dictionary) * n + np.arange(n)), np.append(tf, np.ones(n, "i8"))
        term, of = pair // n, pair % n
        run_of = term * n + group[of]
        first = np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1]))
        rows, ends = pa.array(at[of]), pa.array(np.append(first, len(pair)), pa.int32())
        terms = pa.concat_arrays([named.dictionary, pa.nulls(1, named.dictionary.type)])
        lists = (pa.ListArray.from_arrays(ends, x) for x in (pa.concat_arrays(t[key].chunks).take(rows), dls.take(rows), pa.array(tf, pa.int32())))
        here = pa.array(at[of][first])
        return pa.Table.from_arrays([pa.concat_arrays(t["segment"].chunks).take(here), terms.take(pa.array(term[first])), *(pa.concat_arrays(t[m].chunks).take(here) for m in meta),
                                     *lists, pa.array(np.diff(np.append(first, len(pair))), pa.int64())], names=["segment", "term", *meta, "keys", "dls", "tfs", "n"])

    return run


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("lang",)) -> None:
    """KB-04: write the index of ``docs`` under ``path`` (one tokenising pass; df and size come from the postings).

    Texts are shuffled once, to segments of whole documents, and postings once, as arrays, to their buckets.
    Each build has a folder of its own, never written to again; it counts once its last table is complete.
    """
    path = f"{path}/build-{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets, segments = 1 + size // BUCKET_BYTES, 1 + size // SEGMENT_BYTES
    toks = docs.select(F.pmod(F.xxhash64(key), F.lit(segments)).cast("int").alias("segment"), key, *meta, F.col(text)).repartition("segment")
    toks = toks.select("segment", key, *meta, F.array_join(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), 0), " ").alias("words"))
    kind = {f.name: f.dataType.simpleString() for f in toks.schema}
    made = "segment int, term string, " + "".join(f"`{m}` {kind[m]}, " for m in meta) + f"keys array<{kind[key]}>, dls array<int>, tfs array<int>, n long"
    post = toks.groupBy("segment").applyInArrow(_segment_postings(key, meta), made).withColumn("bucket", F.when(F.col("term").isNotNull(), _bucket("term", buckets)))
    # the rows of no term (bucket NULL) hold all documents, for the corpus's size
    post.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    post = docs.sparkSession.read.parquet(f"{path}/postings")
    (post.where("term IS NOT NULL").groupBy("bucket", "term", *meta).agg(F.sum("n").alias("df"))
     .hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms"))
    # one row per document and length is enough for both figures
    every = post.where("term IS NULL").select(*meta, F.inline(F.arrays_zip("keys", "dls")))
    per_doc = every.groupBy("keys", *meta).agg(F.max("dls").alias("dl"))
    (per_doc.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.greatest("dl", F.lit(0))).alias("avgdl"),
                 F.lit(buckets).cast("int").alias("buckets"))
     .write.parquet(f"{path}/stats"))


def _latest_build(spark: SparkSession, path: str) -> str | None:
    """The newest complete build under ``path``."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    fs = kind(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(kind(f"{path}/build-*/stats/_SUCCESS")) or []
    done = max(((x.getModificationTime(), x.getPath().getParent().getParent().toString()) for x in found), default=None)
    return done and done[1]


def read_index(spark: SparkSession, path: str, key: str = "doc_id", meta: tuple[str, ...] = ("lang",)) -> Index:
    """The newest complete index under ``path``."""
    build = _latest_build(spark, path)
    if build is None:
        raise FileNotFoundError(f"no complete index under {path}")
    path = build
    post, terms_, stats = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats"))
    return Index(post.where("term IS NOT NULL"), terms_, stats, key, meta)


def index_path(docs: DataFrame, kind: str = "bm25-segments") -> str:
    """Where an index of a stored table is kept: a folder of the shared one, named by the table's files as they are now.

    A file counts by its name, length and modification time, so a replaced one
    makes another folder. The tasks that scan a file report these; what
    reaches the driver is one row of two numbers, however many files there are.
    """
    file = [F.col(f"_metadata.{x}").alias(x) for x in ("file_path", "file_size", "file_modification_time")]
    files = docs.select(*file).distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time")
                                                                                  .cast("decimal(38,0)")).alias("hashes")).first()
    name = hashlib.sha256(f"{files.n} {files.hashes}".encode()).hexdigest()[:16]
    return f"{shared_dir(docs.sparkSession).rstrip('/')}/indexes/{kind}-{name}"


def index_of(docs: DataFrame) -> Index:
    """The index of a stored table as it is now: read where the batch has written it, else written once, now."""
    spark, path = docs.sparkSession, index_path(docs)
    if _latest_build(spark, path) is None:
        write_index(docs, path)
    return read_index(spark, path)


#: Terms in more than this share of the documents are looked up only for documents that can still reach the top k.
COMMON_SHARE = 0.1


#: Queries of a batch, about: a segment's sums are held for so many queries at once.
BATCH = 1000


def _segment_scores(k: int, margin: float, avgdl: float, k1: float, b: float):
    """keys, dls, tfs, wanted (q, idf, common) of a segment's rows of the queries' terms -> q, key, rare, score.

    Of each query: documents that can be among its best ``k`` of all segments, by all terms or by the rarer ones.
    Of documents with equal scores, the first ``k`` in the order of keys are enough.
    """

    def best(scores: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(scores > 0)   # in the order of keys
        if len(hit) <= k:
            return hit
        hit = hit[scores[hit] >= np.partition(scores[hit], -k)[-k] - margin]
        hit = hit[np.argsort(-scores[hit], kind="stable")]
        new = np.append(True, np.diff(scores[hit]) != 0)
        return hit[np.arange(len(hit)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]

    def run(t: pa.Table) -> pa.Table:
        of = {c: pa.concat_arrays(t[c].chunks) for c in ("keys", "dls", "tfs", "wanted")}
        ends, wanted_ends = (np.append(0, np.cumsum(pc.list_value_length(of[c]).to_numpy())) for c in ("keys", "wanted"))
        keys, entries = of["keys"].flatten(), of["wanted"].flatten()
        code = _codes(pa.chunked_array([keys]))
        first = np.unique(code, return_index=True)[1]
        tf, dl = (of[c].flatten().to_numpy().astype("f8") for c in ("tfs", "dls"))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        q, idf, common = (pc.struct_field(entries, c).to_numpy(zero_copy_only=False) for c in ("q", "idf", "common"))
        queries, query = np.unique(q, return_inverse=True)
        sums = np.zeros((2, len(queries), len(first)))   # of rarer terms, and of common ones
        for r in range(t.num_rows):
            held, given = code[ends[r] : ends[r + 1]], part[ends[r] : ends[r + 1]]
            if len(held) > 1 and (held[1:] == held[:-1]).any():   # one key with several lengths
                held, back = np.unique(held, return_inverse=True)
                given = np.bincount(back, given)
            for j in range(wanted_ends[r], wanted_ends[r + 1]):
                sums[int(common[j]), query[j], held] += idf[j] * given
        out = [[], [], [], []]
        for i, x in enumerate(queries):
            rare, score = sums[0, i], sums[0, i] + sums[1, i]
            kept = np.union1d(best(rare), best(score))
            for column, y in zip(out, (np.full(len(kept), x), first[kept], rare[kept], score[kept])):
                column.append(y)
        q, at, rare, score = (np.concatenate(c) if c else np.zeros(0, "i8") for c in out)
        return pa.Table.from_arrays([pa.array(q, pa.int64()), keys.take(pa.array(at, pa.int64())), pa.array(rare, pa.float64()), pa.array(score, pa.float64())],
                                    names=["q", "key", "rare", "score"])

    return run


def bm25_candidates(queries: DataFrame, index: Index, k: int = TOP_K, keys: tuple[str, ...] = ("query_id",), text: str = "query_text",
                    visible: Column | None = None, margin: float = 1e-5, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Exact BM25 scores of every document within ``margin`` of a query's true top k, and of few others.

    1. The rows of the queries' terms, arrays of postings, carry the queries along and come together by segment:
       a segment holds whole documents, so it is scored by itself, and what leaves it is
       the documents that can still be in a top k. No row is made for a pair of query and posting.
    2. The k-th best sum over a query's rarer terms bounds its true k-th score from below (theta). Where the
       common terms' bounds together (idf * (k1 + 1) each) stay below theta - margin, a document needs a rarer term.

    ``keys`` names a query; ``visible`` (of query and metadata columns) hides
    documents from it, so one pass serves a query under several filters.
    A document without a key is scored by its rarer terms alone where these decide.
    """
    key, seen = index.key, F.lit(True) if visible is None else visible
    keys, meta = list(keys), list(index.meta)
    shown = [c for c in queries.columns if c not in (*keys, text)]
    qt = queries.select(*keys, *shown, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), 0))).alias("term"))
    size = index.stats.first()   # one stored row of three numbers
    qt = qt.withColumn("bucket", _bucket("term", size.buckets))
    n_docs = F.lit(size.n_docs)
    weighed = (qt.join(index.terms, ["bucket", "term"]).groupBy(*keys, *shown, "bucket", "term").agg(F.sum("df").alias("df"))
               .withColumn("idf", F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
               .withColumn("common", F.col("df") > n_docs * COMMON_SHARE))
    weighed = materialize(weighed, "bm25-terms")   # this and what follows are read several times, and computed once
    # a query without a name finds nothing
    named = weighed.select(*keys).dropna().distinct()
    named = materialize(named.withColumn("q", F.monotonically_increasing_id()), "bm25-queries")
    batches = 1 + named.count() // BATCH
    weighed = weighed.join(named, keys).withColumn("batch", F.pmod(F.xxhash64("q"), F.lit(batches)).cast("int"))
    wanted = (weighed.join(index.terms.drop("df"), ["bucket", "term"]).where(seen).groupBy("batch", "bucket", "term", *meta)
              .agg(F.collect_list(F.struct("q", "idf", "common")).alias("wanted")))   # as many as a batch's queries
    wanted = materialize(wanted.withColumnsRenamed({c: f"_{c}" for c in ("bucket", "term", *meta)}), "bm25-wanted")
    post = index.postings
    same = [post[c] == wanted[f"_{c}"] for c in ("bucket", "term")] + [post[m].eqNullSafe(wanted[f"_{m}"]) for m in meta]
    held = post.join(wanted, same).select("segment", "batch", "keys", "dls", "tfs", "wanted")
    kind = index.postings.schema["keys"].dataType.elementType.simpleString()
    found = held.groupBy("segment", "batch").applyInArrow(_segment_scores(k, margin, size.avgdl, k1, b), f"q long, `key` {kind}, rare double, score double")
    found = materialize(found, "bm25-found")

    best = Window.partitionBy("q").orderBy(F.desc("rare"))
    theta = (found.where("rare > 0").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("q")
             .agg(F.when(F.count(F.lit(1)) >= k, F.min("rare") - margin).alias("theta")))
    bounds = weighed.groupBy("q").agg(F.sum(F.when(F.col("common"), F.col("idf") * (k1 + 1)).otherwise(F.lit(0.0))).alias("more"))
    split = F.coalesce(F.col("more") < F.col("theta"), F.lit(False))
    able = found.join(bounds.join(theta, "q", "left"), "q").where(~split | ((F.col("rare") > 0) & (F.col("rare") + F.col("more") >= F.col("theta"))))
    score = F.when(split & F.col("key").isNull(), F.col("rare")).otherwise(F.col("score"))
    return able.join(named, "q").select(*keys, F.col("key").alias(key), score.alias("score"))


def bm25_topk(queries: DataFrame, index: Index, k: int = TOP_K, **how) -> DataFrame:
    """KB-04: exact top k; ranks go by the published (rounded) score, the id decides ties."""
    s = bm25_candidates(queries, index, k, **how).withColumn("score", dround("score", 6))
    return top_k(s, "query_id", index.key, k).select("query_id", index.key, "rank", "score")


def top_k(scores: DataFrame, qkey: str, dkey: str, k: int = TOP_K, score: str = "score") -> DataFrame:
    """Top-k per query by score, ties by id; rank 1..k."""
    w = Window.partitionBy(qkey).orderBy(F.desc(score), F.asc(dkey))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Query vectors: the mean embedding of each label (framework)."""
    e = vectors.select(label, F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x"))
    m = e.groupBy(label, "dim").agg(F.avg("x").alias("x"))                # rows = labels x dims
    g = m.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return g.select(F.col(label).alias("query_id"), F.col(label).alias("filter_label"),
                    F.transform("v", lambda s: s["x"]).alias("query_vec"))


#: Every vector whose id this divides is a query.
QUERY_EVERY = 50


def sampled_vectors(vectors: DataFrame, every: int = QUERY_EVERY, label: str = "label", key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Query vectors: the vectors with an id divisible by ``every``, each within its own label."""
    v = vectors.where(F.col(key) % every == 0)
    return v.select(F.col(key).alias("query_id"), F.col(label).alias("filter_label"), F.col(vec).cast("array<double>").alias("query_vec"))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, label: str = "label",
                key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """KB-02 / KB-03: cosine top-k within the query's framework label (equi-join)."""
    v = vectors.select(key, F.col(label).alias("filter_label"), F.col(vec).cast("array<double>").alias("v"))
    # Spark broadcasts the queries while their measured size allows, and else splits a label
    # that holds a large share of the vectors
    s = v.join(queries, "filter_label").withColumn("score", dround(cosine(F.col("query_vec"), F.col("v")), 6))
    return top_k(s, "query_id", key, k).select("query_id", key, "rank", "score")


def with_fallback(queries: DataFrame, index: Index, filter_expr: Column, threshold: float, k: int = TOP_K) -> DataFrame:
    """KB-02 / KB-05 / KB-06: top k under the filter; queries without a hit at or above the threshold take the
    unfiltered top k instead.

    A score is a share of the query's best one in the whole corpus. Filtered
    and unfiltered search are one pass, as two scopes of each query.
    """
    key = index.key
    scopes = queries.withColumn("filtered", F.explode(F.array(F.lit(False), F.lit(True))))
    s = bm25_candidates(scopes, index, k, ("query_id", "filtered"), visible=~F.col("filtered") | filter_expr, margin=1e-3)
    best = F.max("score").over(Window.partitionBy("query_id"))   # candidates only
    s = s.withColumn("score", dround(F.col("score") / best, 6))
    w = Window.partitionBy("query_id", "filtered").orderBy(F.desc("score"), F.asc(key))
    top = s.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") >= threshold))
    usable = F.max(F.col("filtered")).over(Window.partitionBy("query_id"))   # 2k hits
    return (top.withColumn("usable", usable).where(F.col("filtered") == F.col("usable"))
            .select("query_id", key, "rank", "score", (~F.col("filtered")).alias("fallback")))


# FIXED VALUE: rank constant of reciprocal rank fusion
FUSION_K = 60


def fuse(*rankings: DataFrame, key: str = "doc_id", k: int = TOP_K) -> DataFrame:
    """KB-04: hybrid search: each ranking (query_id, key, rank) gives 1 / (60 + rank), the sums are ranked."""
    each = None
    for r in rankings:
        part = r.select("query_id", key, (F.lit(1.0) / (FUSION_K + F.col("rank"))).alias("part"))
        each = part if each is None else each.unionByName(part)
    s = each.groupBy("query_id", key).agg(dround(F.sum("part"), 8).alias("score"))
    return top_k(s, "query_id", key, k).select("query_id", key, "rank", "score")


def vectors_of_best(hits: DataFrame, vectors: DataFrame, label: str = "label", key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Query vectors for text queries: the vector of each query's best hit that has one, within its label."""
    v = vectors.select(F.col(key).alias("doc_id"), F.col(label).alias("filter_label"), F.col(vec).cast("array<double>").alias("query_vec"))
    best = hits.join(v, "doc_id").groupBy("query_id").agg(F.min_by(F.struct("filter_label", "query_vec"), "rank").alias("v"))
    return best.select("query_id", "v.filter_label", "v.query_vec")


def route(routes: DataFrame, sections: DataFrame) -> DataFrame:
    """KB-09: the queries that sections ask for: ``routes`` (section_type, framework, query_text, cap) is an input table.

    A route for the section's own framework goes before a general one (NULL);
    ``cap`` is how many hits the section's context takes.
    """
    s = sections.select("section_key", "section_type", "framework")
    own = s.join(routes, ["section_type", "framework"])
    general = s.join(own.select("section_key").distinct(), "section_key", "left_anti").join(
        routes.where("framework IS NULL").drop("framework"), "section_type")
    return own.unionByName(general.select(*own.columns))


def pack(hits: DataFrame, passages: DataFrame, cap_tokens: int, qkey: str = "query_id", dkey: str = "doc_id",
         text: str = "text") -> DataFrame:
    """KB-07 / KB-10: greedy context packing under a character budget of 4 x cap.

    Passages in rank order (empty ones skipped) are taken while the running
    length fits; the first passage that does not fit is cut to the remaining
    room if more than 100 characters remain, and packing stops there.
    """
    h = hits.join(passages.select(dkey, F.col(text).alias("passage")), dkey) \
        .filter(F.length("passage") > 0)
    return pack_ranked(h, cap_tokens, qkey, [dkey])


def pack_ranked(h: DataFrame, cap_tokens: int, qkey: str, keep: list[str]) -> DataFrame:
    """``pack`` for hits that hold their ``passage``; ``keep`` names the columns that go along."""
    budget = cap_tokens * CHARS_PER_TOKEN
    w = Window.partitionBy(qkey).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = (h.withColumn("len", F.length("passage"))
          .withColumn("cum", F.sum("len").over(w))
          .withColumn("prev", F.col("cum") - F.col("len")))
    room = F.lit(budget) - F.col("prev")
    used = (F.when(F.col("cum") <= budget, F.col("passage"))
             .when((F.col("prev") < budget) & (room > MIN_TAIL_CHARS), F.substring("passage", 1, room)))
    first_over = F.min(F.when(F.col("cum") > budget, F.col("rank"))).over(Window.partitionBy(qkey))
    return (h.withColumn("used", used).withColumn("first_over", first_over)
             .filter(F.col("used").isNotNull() & (F.col("first_over").isNull() | (F.col("rank") <= F.col("first_over"))))
             .select(qkey, *keep, "rank", F.length("used").alias("chars_used"),
                     (F.length("used") < F.col("len")).alias("truncated"),
                     F.when(F.length("used") < F.col("len"), F.concat("used", F.lit(TRUNCATION_MARK)))
                      .otherwise(F.col("used")).alias("context")))


def context_text(packed: DataFrame, qkey: str = "query_id") -> DataFrame:
    """KB-07: the packed passages of a query joined in rank order (top-k: bounded per query)."""
    parts = F.sort_array(F.collect_list(F.struct("rank", "context")))
    return packed.groupBy(qkey).agg(
        F.array_join(F.transform(parts, lambda x: x["context"]), PASSAGE_SEPARATOR).alias("context"),
        F.sum("chars_used").alias("chars_used"))


def retrieval_stats(scored: DataFrame, packed: DataFrame, threshold: float, qkey: str = "query_id") -> DataFrame:
    """KB-08: per query hits, hits above threshold, passages used and characters."""
    a = scored.groupBy(qkey).agg(F.count(F.lit(1)).alias("hits"),
                                 F.count_if(F.col("score") >= threshold).alias("above_threshold"),
                                 F.max("fallback").alias("used_fallback"))
    p = packed.groupBy(qkey).agg(F.count(F.lit(1)).alias("used"), F.sum("chars_used").alias("chars"))
    return (a.join(p, qkey, "left")
             .select(qkey, "hits", "above_threshold", "used_fallback", F.coalesce("used", F.lit(0)).cast("bigint").alias("used"),
                     F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars")))
