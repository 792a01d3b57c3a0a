"""Chunks by paragraph and sentence, and keyword search over them with block maxima.

* A chunk takes whole sentences up to a number of tokens. It ends with the last
  paragraph that fills at least half of it, else with the last sentence; a
  sentence longer than a chunk is cut into windows. The next chunk repeats the last
  sentences of up to ``overlap`` tokens, as far as they leave room for a new one.
* The index keeps a term's postings in blocks: a block is ``BLOCK`` neighbouring
  chunks, in the order of metadata and documents, as those share words, and has the
  largest contribution any posting of it makes. ``SEGMENT`` neighbouring chunks are a
  segment; a row of the index is a term in a segment, with its blocks, their maxima and their
  postings as arrays. A search reads block maxima first, which are columns of their own, and
  unpacks only blocks that can reach a query's k-th score.
* Segments are searched by themselves: the rows of a segment that hold the queries' terms
  come together once, as arrays, and what leaves it is a few best chunks of each query. No row is
  made for a pair of query and posting, or of query and block.
* Contexts are packed from chunks; hits carry the chunk's place in its text.

Chunks are cut with built-in functions; a segment's arrays are made and added up with Arrow and numpy. A step of a search
is a table in the shared folder, so none is computed twice and plans stay small. Disk holds the stored tables (zstd) and the
shuffle of one step: texts are shuffled once as documents and once as words, postings once, packed by segment and bucket.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import dround
from ..session import discard, freed_shuffles, materialize
from . import docmeta, retrieval
from .retrieval import BM25_B, BM25_K1, CHUNK_OVERLAP, CHUNK_TOKENS, COMMON_SHARE, TOKEN, TOP_K

WHITE = r"\t\n\x0B\f\r "
PIECE = f"[^{WHITE}]+[{WHITE}]*"
SENTENCE_END = r"[.!?][\"')\]]*$"
PARAGRAPH_END = r"\n[\t\x0B\f\r ]*\n"
#: Sentences that most chunks stay below.
FEW = 40
#: Chunks of a block at most. Small ones have maxima close to what a chunk reaches, so more of them are passed over.
BLOCK = 8
#: Chunks of a segment at most, a multiple of BLOCK.
SEGMENT = 4096
#: Blocks of a query that are unpacked first, to learn a score that its best chunks reach.
PROBED = 20
#: Tokens of an index bucket, about: a bucket is a folder of the stored index.
BUCKET_TOKENS = 8_000_000


# ------------------------------------------------------------------ chunking
def boundaries(docs: DataFrame, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ()) -> DataFrame:
    """(key, meta, tokens, ends): whitespace tokens, and 2 * tokens before (+ 1 for a paragraph) of every sentence's end."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0))
    p = docs.select(key, *meta, pieces.alias("pieces"))
    n = F.size("pieces")
    token = lambda x: F.rtrim(x, F.lit("\t\n\x0b\f\r "))
    # patterns are left to pieces that can match them, which are few
    paragraph = lambda x: x.contains("\n") & x.rlike(PARAGRAPH_END)
    sentence = lambda x: (x.contains(".") | x.contains("!") | x.contains("?")) & token(x).rlike(SENTENCE_END)
    end = lambda x, i: F.when((i + 1 == n) | paragraph(x), 2 * i + 3).when(sentence(x), 2 * i + 2)
    return p.select(key, *meta, F.transform("pieces", token).alias("tokens"),
                    F.filter(F.transform("pieces", end), lambda e: e.isNotNull()).alias("ends"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def spans(tokens: Column, ends: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) of a text's chunks, in tokens.

    A running state walks the sentence ends: where the next chunk starts, the
    first end behind that, and the chunks so far. Each step looks at ``FEW`` ends,
    and where a chunk may hold more, at ``size``, as it can't hold more than these.
    """
    place = lambda e: F.shiftright(e, 1)
    last = lambda x: place(F.get(x, F.size(x) - 1))
    kind = "struct<start: int, at: int, made: array<struct<start: int, end: int>>>"
    first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("made")).cast(kind)

    def moved(state: Column, near: Column, cut: Column, following: Column) -> Column:
        """The state behind a chunk that ends at ``cut``; ``following`` is the sentence end after it."""
        carried = F.filter(near, lambda e: (place(e) >= cut - overlap) & (place(e) <= cut) & (following - place(e) <= size))
        again = F.when(F.size(near) == 0, cut - overlap).otherwise(F.coalesce(place(F.get(carried, 0)), cut))
        return _let(again, lambda t: F.struct(
            F.when(following.isNull(), cut).otherwise(t).alias("start"),
            (state["at"] + F.size(F.filter(near, lambda e: place(e) <= t))).alias("at"),
            F.concat(state["made"], F.array(F.struct(state["start"].alias("start"), cut.alias("end")))).alias("made")).cast(kind))

    def step(state: Column, _: Column) -> Column:
        start, at = state["start"], state["at"]
        reach = F.when(place(F.get(ends, at + FEW)) <= start + size, F.slice(ends, at + 1, size)).otherwise(F.slice(ends, at + 1, FEW))
        near = F.filter(reach, lambda e: place(e) <= start + size)   # ascending
        half = lambda near: F.filter(near, lambda e: (e % 2 == 1) & (place(e) >= start + size // 2))
        cut = lambda near: F.coalesce(_let(half(near), last), last(near), start + size)
        behind = lambda near, cut: place(F.get(ends, at + F.size(F.filter(near, lambda e: place(e) <= cut))))
        walked = _let(near, lambda m: _let(cut(m), lambda c: _let(behind(m, c), lambda f: moved(state, m, c, f))))
        return F.when(at >= F.size(ends), state).otherwise(walked)

    # every chunk takes in a sentence's end or is a window of a long sentence
    most = F.size(ends) + F.ceil(F.size(tokens) / (size - overlap)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), most), first, step, lambda s: s["made"])


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = (), size: int = CHUNK_TOKENS,
          overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """KB-01: key, meta, chunk_no, first_token, n_tokens and chunk_text of every chunk; each token lies in one at least.

    A text that is null or has no token has no chunk.
    """
    b = boundaries(docs, key, text, meta)   # no filter on tokens, which would find them once more; without any there are no spans
    c = b.select(key, *meta, "tokens", F.posexplode(spans(F.col("tokens"), F.col("ends"), size, overlap)).alias("chunk_no", "c"))
    body = F.slice("tokens", F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    return c.select(key, *meta, "chunk_no", F.col("c.start").alias("first_token"), (F.col("c.end") - F.col("c.start")).alias("n_tokens"),
                    F.array_join(body, " ").alias("chunk_text"))


# ------------------------------------------------------------------ index
@dataclass(frozen=True)
class ChunkIndex:
    """A stored index of chunks.

    chunks: key, chunk_no, first_token, n_tokens, chunk_text, block, segment, at (its place there) and metadata;
    rows: bucket, term, segment, and as arrays block (its place in the segment), n, max_part of the term's blocks in the segment,
    place (in the block) and part (the contribution, but for idf) of its postings, block after block, in the order of terms inside
    a bucket; terms: bucket, term, df, max_part; segments: segment, starts (first place of each run of equal metadata), again
    (places of chunks whose key and number come more than once); stats: n_chunks, avgdl, buckets.
    """

    chunks: DataFrame
    rows: DataFrame
    terms: DataFrame
    segments: DataFrame
    stats: DataFrame
    key: str

    @property
    def blocks(self) -> DataFrame:
        """bucket, term, block, n, max_part, postings (at, part): the rows, one for each block."""
        before = F.aggregate(F.slice("n", 1, F.col("i")), F.lit(0), lambda s, x: s + x)
        held = lambda c: F.slice(c, before + 1, F.col("held"))
        one = self.rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("block") - 1))).withColumns({
            "inside": F.get("block", "i").cast("int"), "held": F.get("n", "i").cast("int"), "most": F.get("max_part", "i")})
        at = F.transform(held("place"), lambda x: F.col("inside") * BLOCK + x.cast("int"))
        one = one.withColumn("postings", F.arrays_zip(at.alias("at"), held("part").alias("part")))
        whole = F.col("segment") * (SEGMENT // BLOCK) + F.col("inside")
        return one.select("bucket", "term", "postings", whole.alias("_block"), "held", "most").select(
            "bucket", "term", F.col("_block").alias("block"), F.col("held").alias("n"), F.col("most").alias("max_part"), "postings")


def _part(tf, dl, avgdl, k1: float = BM25_K1, b: float = BM25_B):
    """A posting's contribution, but for the term's idf."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _counted(terms: Column) -> Column:
    """(term, tf) of every distinct term of an array: where the sorted terms change."""
    change = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    count = lambda s, at: F.transform(at, lambda x, i: F.struct(
        F.get(s, x).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(s)) - x).alias("tf")))
    return _let(F.array_sort(terms), lambda s: _let(change(s), lambda at: count(s, at)))


def _lists(values, first, kind) -> pa.Array:
    """``values`` cut into lists that begin at ``first``."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), pa.array(values, kind))


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, "i8")


ROWS = "bucket int, term string, segment long, block array<smallint>, n array<smallint>, max_part array<double>, place array<smallint>, part array<double>"
PACKED = "bucket int, segment long, tokens long, size int, packed binary"
_PACKED = pa.schema([("term", pa.string()), *((c, pa.list_(pa.int16())) for c in ("block", "n", "place")), *((c, pa.list_(pa.int32())) for c in ("tf", "dl"))])


def _packed_segment(buckets: int, block: int, size: int):
    """segment, at, words of a segment's chunks -> its terms' postings, packed by bucket; the first row has the number of words."""

    def run(t: pa.Table) -> pa.Table:
        dl, words = retrieval._words(pa.concat_arrays(t["words"].chunks).cast(pa.string()))
        dl = dl.to_numpy().astype("i8")
        at = t["at"].to_numpy().astype("i8")
        of = np.zeros(size, "i8")
        of[at] = dl
        named = words.dictionary_encode()
        names = named.dictionary
        # terms are numbered by bucket
        bucket = np.fromiter((zlib.crc32(x) % buckets for x in names.cast(pa.binary()).to_pylist()), "i8", len(names))
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), "i8")
        number[order] = np.arange(len(order))
        pair, tf = np.unique(number[named.indices.to_numpy()] * size + np.repeat(at, dl), return_counts=True)
        term, at = pair // size, pair % size
        first = _changes(pair // block)               # of every block of a term, as size is a multiple of block
        outer = _changes(term[first])                  # of every term among the blocks
        held = pa.RecordBatch.from_arrays([
            names.take(pa.array(order)), _lists(at[first] // block, outer, pa.int16()), _lists(np.diff(np.append(first, len(pair))), outer, pa.int16()),
            _lists(at % block, first[outer], pa.int16()), _lists(tf, first[outer], pa.int32()), _lists(of[at], first[outer], pa.int32())], schema=_PACKED)
        starts = _changes(bucket[order])
        each = [held.slice(x, y - x).serialize() for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(order)])]
        return pa.Table.from_arrays([
            pa.array(bucket[order][starts], pa.int32()), pa.array(np.full(len(starts), t["segment"][0].as_py()), pa.int64()),
            pa.array(np.append(len(words), np.zeros(len(starts), "i8"))[: len(starts)], pa.int64()), pa.array([x.size for x in each], pa.int32()), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in each], pa.binary())],
            names=["bucket", "segment", "tokens", "size", "packed"])

    return run


def _unpacked(avgdl: float):
    """``PACKED`` -> ``ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, segment, _, size, packed in (tuple(r.values()) for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            held = pa.ipc.read_record_batch(pa.py_buffer(pa.decompress(packed, size, codec="zstd", asbytes=True)), _PACKED)
            flat = lambda c: held[c].flatten().to_numpy()  # noqa: B023, E731
            part = _part(flat("tf").astype("f8"), flat("dl"), avgdl)
            most = np.maximum.reduceat(part, np.append(0, np.cumsum(flat("n"), dtype="i8")[:-1]))
            lists = lambda like, x: pa.ListArray.from_arrays(held[like].offsets, pa.array(x, pa.float64()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(held.num_rows, bucket), pa.int32()), held["term"], pa.array(np.full(held.num_rows, segment), pa.int64()), held["block"], held["n"],
                lists("block", most), held["place"], lists("place", part)], names=["bucket", "term", "segment", "block", "n", "max_part", "place", "part"])

    return run


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("lang",)) -> None:
    """KB-04: chunk ``docs`` and write their index under ``path``; a build has a folder of its own and counts once its last table is complete."""
    with freed_shuffles(docs.sparkSession):
        _write_index(docs, f"{path}/build-{uuid.uuid4().hex}", key, text, meta)


def _write_index(docs: DataFrame, path: str, key: str, text: str, meta: tuple[str, ...]) -> None:
    spark = docs.sparkSession
    # neighbours by metadata and document come together, while texts are whole; a block is the next few chunks of a partition
    near = docs.select(key, *meta, text).repartitionByRange(*meta, key, F.xxhash64(text))
    near = chunk(near, key, text, meta).sortWithinPartitions(*meta, key, "chunk_no")
    numbered = near.withColumn("_row", F.monotonically_increasing_id()).select(
        *near.columns, F.floor(F.col("_row") / BLOCK).cast("long").alias("block"), F.floor(F.col("_row") / SEGMENT).cast("long").alias("segment"),
        F.pmod(F.col("_row"), F.lit(SEGMENT)).cast("int").alias("at"))
    stored = lambda df: df.write.option("compression", "zstd")
    stored(numbered).parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    n, pieces = chunks.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    buckets = max(1, -(-(pieces or 0) // BUCKET_TOKENS))
    # a segment's chunks come together as words; its postings are shuffled once more to their buckets, packed. They are a table until
    # then, as their contributions need the mean length
    found = F.array_join(F.regexp_extract_all(F.lower("chunk_text"), F.lit(TOKEN), F.lit(0)), " ")
    packed = chunks.select("segment", "at", found.alias("words")).groupBy("segment").applyInArrow(_packed_segment(buckets, BLOCK, SEGMENT), PACKED)
    packed.write.option("compression", "none").parquet(f"{path}/packed")
    packed = spark.read.schema(PACKED).parquet(f"{path}/packed")
    avgdl = (packed.agg(F.sum("tokens")).first()[0] or 0) / n if n else None
    rows = packed.hint("rebalance", "bucket").mapInArrow(_unpacked(avgdl), ROWS).sortWithinPartitions("bucket", "term", "segment")
    stored(rows).partitionBy("bucket").parquet(f"{path}/rows")
    discard(spark, f"{path}/packed")
    each = spark.read.parquet(f"{path}/rows").select("bucket", "term", F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("df"), F.array_max("max_part").alias("max_part"))
    stored(each.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("max_part").alias("max_part"))
           .hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")).partitionBy("bucket").parquet(f"{path}/terms")
    starts = chunks.groupBy("segment", *meta).agg(F.min("at").alias("at")).groupBy("segment").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    twice = chunks.groupBy(key, "chunk_no").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumnsRenamed({key: "_key", "chunk_no": "_no"})
    again = (chunks.join(twice, chunks[key].eqNullSafe(twice["_key"]) & (chunks["chunk_no"] == twice["_no"]), "left_semi")
             .groupBy("segment").agg(F.collect_list("at").alias("again")))   # lists of a segment's own chunks
    starts.join(again, "segment", "left").withColumn("again", F.coalesce("again", F.array().cast("array<int>"))).write.parquet(f"{path}/segments")
    spark.createDataFrame([(n, avgdl, buckets)], "n_chunks long, avgdl double, buckets int").coalesce(1) \
        .write.parquet(f"{path}/stats")


def _bucket(term, buckets) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def read_index(spark: SparkSession, path: str, key: str = "doc_id") -> ChunkIndex:
    """The newest complete index under ``path``."""
    build = retrieval._latest_build(spark, path)
    if build is None:
        raise FileNotFoundError(f"no complete index under {path}")
    return ChunkIndex(*(spark.read.parquet(f"{build}/{t}") for t in ("chunks", "rows", "terms", "segments", "stats")), key)


def index_of(docs: DataFrame) -> ChunkIndex:
    """The chunk index of a stored table as it is now, written once if it is missing; other sizes make another index."""
    path = retrieval.index_path(docs, f"chunks-packed-{CHUNK_TOKENS}-{CHUNK_OVERLAP}-{BLOCK}-{SEGMENT}")
    if retrieval._latest_build(docs.sparkSession, path) is None:
        write_index(docs, path)
    return read_index(docs.sparkSession, path)


# ------------------------------------------------------------------ search
@dataclass(frozen=True)
class Search:
    """hits: query_id, key, chunk_no, score of each query's best chunks; read: query_id, blocks, blocks_read, postings, postings_read."""

    hits: DataFrame
    read: DataFrame


class _Segment:
    """The rows of a segment that hold terms of a batch of queries, as flat arrays."""

    def __init__(self, t: pa.Table, block: int, size: int):
        of = lambda rows, c: pa.concat_arrays(rows[c].chunks)
        rows = t.filter(pc.is_valid(t["wanted"]))
        marks = t.filter(pc.is_null(t["wanted"])).to_pylist()
        self.mark, self.size = marks[0] if marks else {}, rows.num_rows
        if not self.size:
            return
        flat = lambda c: of(rows, c).flatten().to_numpy(zero_copy_only=False)
        ends = lambda c: np.append(0, np.cumsum(pc.list_value_length(of(rows, c)).to_numpy()))
        inside = flat("block").astype("i8")
        self.blocks, self.block = np.unique(inside + t["segment"][0].as_py() * (size // block), return_inverse=True)
        self.block_ends, self.wanted_ends = ends("block"), ends("wanted")
        if "max_part" in rows.column_names:
            self.most = flat("max_part")
        if "place" in rows.column_names:
            self.n, self.part, self.at_ends = flat("n"), flat("part"), ends("place")
            self.at = np.repeat(inside * block, self.n) + flat("place")
            self.at_block = np.repeat(self.block, self.n)
        entries = of(rows, "wanted").flatten()
        entry = {f.name: pc.struct_field(entries, f.name).to_numpy(zero_copy_only=False) for f in entries.type}
        self.queries, first, self.query = np.unique(entry["q"], return_index=True, return_inverse=True)
        self.idf, self.common = entry["idf"], entry["common"].astype(bool)
        self.plan = {c: entry[c][first] for c in entry if c not in ("q", "idf", "common")}
        self.open = np.isin(self.blocks, self.mark["blocks"]) if self.mark.get("blocks") is not None else np.ones(len(self.blocks), bool)

    def entries(self):
        """Every row's blocks and postings, as slices, with its entries (query's place, idf, common)."""
        for r in range(self.size):
            blocks = slice(self.block_ends[r], self.block_ends[r + 1])
            postings = slice(self.at_ends[r], self.at_ends[r + 1]) if hasattr(self, "at") else None
            for j in range(self.wanted_ends[r], self.wanted_ends[r + 1]):
                yield blocks, postings, self.query[j], self.idf[j], self.common[j]

    def bounds(self):
        """Sums of block maxima per query and block: of rarer terms, and of common ones."""
        rare, common = np.zeros((2, len(self.queries), len(self.blocks)))
        for blocks, _, q, idf, often in self.entries():
            (common if often else rare)[q, self.block[blocks]] += idf * self.most[blocks]   # a row's blocks are distinct
        return rare, common

    def scores(self, chosen: np.ndarray) -> np.ndarray:
        """Sums per query and place, over the postings of the ``chosen`` blocks (query, block)."""
        out = np.zeros((len(self.queries), int(self.at.max()) + 1))
        for _, postings, q, idf, _ in self.entries():
            read = chosen[q, self.at_block[postings]]
            out[q, self.at[postings][read]] += idf * self.part[postings][read]
        if self.mark.get("allowed") is not None:
            out[:, ~np.isin(np.arange(out.shape[1]), self.mark["allowed"])] = 0
        return out

    def best(self, scores: np.ndarray, k: int, margin: float):
        """(query, places, scores) that can be among a query's best ``k`` of all segments, whatever the others hold.

        Chunks whose key and number come again elsewhere are all of them, as their scores are yet to be added up.
        Of chunks with equal scores, the first ``k`` in the order of ids are enough.
        """
        again = np.isin(np.arange(scores.shape[1]), self.mark["again"])
        run = np.searchsorted(self.mark["starts"], np.arange(scores.shape[1]), "right")
        for q, row in enumerate(scores):
            hit = np.flatnonzero(row > 0)
            kept = hit[~again[hit]]
            if len(kept) > k:
                kept = kept[row[kept] >= np.partition(row[kept], -k)[-k] - margin]
                kept = kept[np.lexsort((kept, run[kept], -row[kept]))]
                new = np.append(True, (np.diff(row[kept]) != 0) | (np.diff(run[kept]) != 0))
                kept = kept[np.arange(len(kept)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]
            kept = np.append(kept, hit[again[hit]])
            yield q, kept, row[kept]


def _table(schema: dict, columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), kind) for c, kind in zip(columns, schema.values())], names=list(schema))


_BOUND = {"q": pa.int64(), "segment": pa.int64(), "block": pa.int64(), "bound": pa.float64()}
_HIT = {"q": pa.int64(), "segment": pa.int64(), "at": pa.int32(), "score": pa.float64()}
_READ = {"blocks": pa.int64(), "blocks_read": pa.int64(), "postings": pa.int64(), "postings_read": pa.int64()}


def _best_bounds(most: int, block: int, size: int):
    """The ``most`` blocks of the highest bounds, for every query."""

    def run(t: pa.Table) -> pa.Table:
        s, out = _Segment(t, block, size), [[], [], [], []]
        for q, row in enumerate(s.bounds()[0] if s.size else ()):
            held = np.flatnonzero((row > 0) & s.open)
            held = held[np.lexsort((s.blocks[held], -row[held]))][:most]
            for column, x in zip(out, (np.full(len(held), s.queries[q]), np.full(len(held), t["segment"][0].as_py()), s.blocks[held], row[held])):
                column.append(x)
        return _table(_BOUND, out)

    return run


def _probe(k: int, margin: float, block: int, size: int):
    """The best chunks of the probed blocks, for every query."""

    def run(t: pa.Table) -> pa.Table:
        s, out = _Segment(t, block, size), [[], [], [], []]
        if s.size:
            chosen = np.zeros((len(s.queries), len(s.blocks)), bool)
            place = {q: i for i, q in enumerate(s.queries.tolist())}
            for x in s.mark["probes"]:
                if x["q"] in place:
                    chosen[place[x["q"]]] |= s.blocks == x["block"]
            for q, at, score in s.best(s.scores(chosen), k, margin):
                for column, x in zip(out, (np.full(len(at), s.queries[q]), np.full(len(at), t["segment"][0].as_py()), at, score)):
                    column.append(x)
        return _table(_HIT, out)

    return run


def _chosen(s: _Segment) -> np.ndarray:
    """Whether a query needs a block, by its bound."""
    rare, common = s.bounds()
    theta, more, split, named = (s.plan[c][:, None] for c in ("theta", "more", "split", "named"))
    theta = np.where(np.isnan(theta.astype("f8")), -np.inf, theta.astype("f8"))
    split = split.astype(bool)
    needed = np.where(split, (rare > 0) & (rare + more >= theta), rare + common > 0)
    return needed & (rare + common >= theta) & named.astype(bool) & s.open


def _search(k: int, margin: float, block: int, size: int):
    """The best chunks of the chosen blocks, and how much of the segment was read, for every query."""

    def run(t: pa.Table) -> pa.Table:
        s, out = _Segment(t, block, size), [[] for _ in range(8)]
        if s.size:
            chosen = _chosen(s)
            read = np.zeros((4, len(s.queries)), "i8")
            for blocks, _, q, _, _ in s.entries():
                used, n = chosen[q, s.block[blocks]], s.n[blocks]
                read[:, q] += (len(n), used.sum(), n.sum(), n[used].sum())
            for q, at, score in s.best(s.scores(chosen), k, margin):
                # the figures stand in a row of their own, at place -1
                counts = (np.append(x, np.zeros(len(at), "i8")) for x in read[:, q : q + 1])
                one = np.ones(len(at) + 1, "i8")
                for column, x in zip(out, (one * s.queries[q], one * t["segment"][0].as_py(), np.append(-1, at), np.append(0.0, score), *counts)):
                    column.append(x)
        return _table(_HIT | _READ, out)

    return run


#: Queries of a batch, about: a segment's sums are held for so many queries at once.
BATCH = 1000
MARKS = {"starts": "array<int>", "again": "array<int>", "blocks": "array<long>", "allowed": "array<int>", "probes": "array<struct<q: bigint, block: bigint>>"}
HITS = "q long, segment long, at int, score double"


def search(queries: DataFrame, index: ChunkIndex, k: int = TOP_K, margin: float = 1e-5, allowed: DataFrame | None = None) -> Search:
    """Exact scores of every chunk that can be one of a query's best ``k``, and of few others.

    ``allowed`` (bitmaps of documents, see ``docmeta``) leaves out all others:
    blocks without an allowed chunk are not looked at. Weights stay those of the whole corpus.

    1. Blocks of a query's rarer terms get a bound, the sum of their maxima. The
       ``PROBED`` blocks of the highest bounds are unpacked; the k-th best score
       in them is at most the true k-th score.
    2. Where the common terms' maxima together stay below it, a chunk needs a
       rarer term, and only blocks of those are looked at. Others look at all
       blocks of all their terms.
    3. A block's bound gets the maxima of the common terms in that block; where it
       stays below the k-th score, its postings are passed over.

    Each step is one pass over the segments' rows of the queries' terms, which carry the queries along as arrays.
    """
    with freed_shuffles(queries.sparkSession):
        return _searched(queries, index, k, margin, allowed)


def _searched(queries: DataFrame, index: ChunkIndex, k: int, margin: float, allowed: DataFrame | None) -> Search:
    key, stats = index.key, index.stats.first()   # one stored row
    n = F.lit(stats.n_chunks)
    words = F.array_distinct(F.regexp_extract_all(F.lower("query_text"), F.lit(TOKEN), F.lit(0)))
    named = materialize(queries.select("query_id").distinct().withColumn("q", F.monotonically_increasing_id()), "chunk-queries")
    batches = 1 + named.count() // BATCH
    named = named.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int")).withColumnRenamed("query_id", "_id")
    qt = queries.select("query_id", F.explode(words).alias("term")).withColumn("bucket", _bucket("term", stats.buckets))
    qt = qt.join(named, qt["query_id"].eqNullSafe(named["_id"])).drop("_id")
    idf = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = materialize(qt.join(index.terms, ["bucket", "term"]).select(
        "q", "batch", F.col("query_id").isNotNull().alias("named"), "bucket", "term", idf.alias("idf"), (idf * F.col("max_part")).alias("most"),
        (F.col("df") > n * COMMON_SHARE).alias("common")), "chunk-terms")
    every = index.segments.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    if allowed is not None:
        held = docmeta.passing(index.chunks.select("segment", "block", "at", key), allowed, key)
        able = materialize(held.groupBy("segment").agg(F.collect_set("block").alias("blocks"), F.collect_set("at").alias("allowed")), "chunk-allowed")
        every = every.join(able, "segment", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<long>"))) \
            .withColumn("allowed", F.coalesce("allowed", F.array().cast("array<int>")))

    def over(of: DataFrame, columns: list[str], marks: DataFrame, run, schema: str, name: str, *along: str) -> DataFrame:
        """What ``run`` makes of every segment and batch: its rows of the terms ``of``, with their queries, and its marks."""
        wanted = materialize(of.groupBy("batch", "bucket", "term").agg(F.collect_list(F.struct("q", "idf", "common", *along)).alias("wanted")), f"{name}-terms")
        rows = index.rows.select("bucket", "term", "segment", *columns).join(wanted, ["bucket", "term"]).select("segment", "batch", *columns, "wanted")
        rows = rows.join(marks.select("segment", "batch"), ["segment", "batch"], "left_semi") if "probes" in marks.columns else rows
        both = rows.unionByName(marks, allowMissingColumns=True)
        missing = [F.lit(None).cast(kind).alias(c) for c, kind in MARKS.items() if c not in both.columns]
        return materialize(both.select("*", *missing).groupBy("segment", "batch").applyInArrow(run, schema), name)

    def merged(hits: DataFrame) -> DataFrame:
        """Scores by key and number of the chunks."""
        held = index.chunks.select("segment", "at", key, "chunk_no")
        return hits.join(held, ["segment", "at"]).groupBy("q", key, "chunk_no").agg(F.sum("score").alias("score"))

    bounds = over(terms.where("NOT common"), ["block", "max_part"], every, _best_bounds(PROBED, BLOCK, SEGMENT), "q long, segment long, block long, bound double", "chunk-bounds")
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    probed = bounds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= PROBED).join(named, "q")
    probed = probed.groupBy("segment", "batch").agg(F.collect_list(F.struct("q", "block")).alias("probes"))   # as many as a batch's queries probe
    postings = ["block", "n", "place", "part"]
    seen = over(terms, postings, every.join(materialize(probed, "chunk-probes"), ["segment", "batch"]), _probe(k, margin, BLOCK, SEGMENT), HITS, "chunk-probed")
    first = Window.partitionBy("q").orderBy(F.desc("score"))
    seen = merged(seen).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    theta = seen.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score") - margin).alias("theta"))
    more = terms.groupBy("q").agg(F.sum(F.when(F.col("common"), F.col("most")).otherwise(F.lit(0.0))).alias("more"))
    plan = more.join(theta, "q", "left").withColumn("split", F.coalesce(F.col("more") < F.col("theta"), F.lit(False)))

    found = over(terms.join(plan, "q"), [*postings, "max_part"], every, _search(k, margin, BLOCK, SEGMENT), f"{HITS}, {', '.join(f'{c} long' for c in _READ)}", "chunk-found",
                 "theta", "more", "split", "named")
    ids = named.select("q", F.col("_id").alias("query_id"))
    read = found.where("at < 0").groupBy("q").agg(*(F.sum(c).alias(c) for c in _READ))
    return Search(merged(found.where("at >= 0")).join(ids, "q").select("query_id", key, "chunk_no", "score"), ids.join(read, "q").drop("q"))


def bm25_topk(found: Search, index: ChunkIndex, k: int = TOP_K) -> DataFrame:
    """KB-04: query_id, key, chunk_no, rank, score, up to the ``k`` of the search; ranks go by the published score, then by key and chunk."""
    s = found.hits.withColumn("score", dround("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), index.key, "chunk_no")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", index.key, "chunk_no", "rank", "score")


def with_text(hits: DataFrame, index: ChunkIndex) -> DataFrame:
    """Hits with the chunk's place and text. Hits are a table, whose size Spark knows: texts are shuffled only where hits are many."""
    hits = materialize(hits, "chunk-hits")
    return hits.join(index.chunks.select(index.key, "chunk_no", "first_token", "n_tokens", "chunk_text"), [index.key, "chunk_no"])


def blocks_read(found: Search, index: ChunkIndex) -> DataFrame:
    """KB-08: per query, how many blocks of postings its terms have and how many of them a search unpacked."""
    return found.read.select("query_id", "blocks", "blocks_read", "postings", "postings_read")


def pack(hits: DataFrame, index: ChunkIndex, cap_tokens: int) -> DataFrame:
    """KB-07 / KB-10: greedy packing of chunks in rank order under a budget of 4 characters a token; the one that crosses it is cut.

    query_id, key, chunk_no, first_token, n_tokens, rank, chars_used, truncated, context.
    """
    texts = with_text(hits, index).withColumnRenamed("chunk_text", "passage").where(F.length("passage") > 0)
    return retrieval.pack_ranked(texts, cap_tokens, "query_id", [index.key, "chunk_no", "first_token", "n_tokens"])
