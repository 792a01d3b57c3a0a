"""MinHash near-dedup with sequential Bayesian verification.

Documents with one shingle set form a class at once. Classes are banded by
MinHash; band buckets give candidates; a candidate pair's signatures are
compared batch by batch, and the pair is pruned as soon as the posterior
probability that its similarity reaches the threshold falls below the chosen
miss probability (uniform prior, so after ``m`` of ``n`` equal hashes the
posterior is Beta(m+1, n-m+1)). What survives is verified on the full sets.

Candidates come in rounds, so that no group emits all its pairs. First each
member of a bucket meets the bucket's first member only: each document is
verified against one of these, then against those that it isn't connected with
yet. What is left are buckets whose members are not all connected. In a group
of copies edited apart these are many, and nearly all of their pairs fall short
of the threshold. So a prefix filter goes first: with shingles ordered from rare
to frequent, sets that reach the threshold share one of their first few, at
places that leave room for the overlap needed, and their parity sketches
differ in few bits. Only such pairs across components are compared and verified. Pairs inside a component need no test,
as they change nothing; every other candidate pair is tested or can't be one.

The chance that banding misses a pair at the threshold is at most
``MISS``; rows per band are as many as that allows, which keeps documents that
merely share a passage out of one another's buckets.

Defined results: words are lower-cased in A-Z only; a document with fewer
words than a shingle has its whole sequence as one; one without words (or with
a null text) has an empty set and is linked with nothing, its component is its
own id; component ids are the smallest non-null doc_id reachable; rows
repeated with one doc_id share their result; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, materialize, text_key
from .graph import components

#: Chance of missing a pair at the threshold, in banding and in each pruning step.
MISS = 1e-6
MOST_HASHES = 400
#: Hashes that the sequential comparison reads, and how many at a time.
COMPARED, BATCH = 128, 16
SEED = 20240229
#: Counters that order shingles by frequency, one array of 32-bit numbers (4 MB) whatever the input; any order is right.
SLOTS = 1 << 20
#: Bits of a set's parity sketch, as 64-bit words.
PARITY = 512


def banding(percent: int, miss: float = MISS, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have when bands * rows stays within ``most``."""
    s, best = percent / 100, (0, 0)
    for rows in range(1, 17):
        bands = 1 if s >= 1 else math.ceil(math.log(miss) / math.log1p(-s**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """For each batch, the fewest equal hashes with which a pair goes on.

    Pr[S >= t | m of n] = sum over j <= m of C(n+1, j) t^j (1-t)^(n+1-j).
    """
    t, out = percent / 100, []
    for n in range(BATCH, COMPARED + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


class _Words(dict):
    """64-bit hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _odd(count: int, bits: int, seed: int) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64(seed))
    kind = np.uint32 if bits == 32 else np.uint64
    return r.integers(0, 2**bits, count, dtype=kind) | kind(1)


def shingles(text: bytes | None, size: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text in UTF-8."""
    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    by = _odd(size, 64, SEED)
    if n < size:
        return _mix(np.array([(h * by[:n]).sum(dtype=np.uint64) + np.uint64(n)]))
    s = h[: n - size + 1] * by[0]
    for i in range(1, size):
        s += h[i : n - size + 1 + i] * by[i]
    s = np.sort(_mix(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def signature(hashes: np.ndarray, count: int) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    a = _odd(count, 32, SEED + 1)[:, None]
    b = _odd(count, 32, SEED + 2)[:, None]
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (a * x[i : i + 256] + b).min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    by = _odd(rows, 64, SEED + 3)
    s = (sig[: bands * rows].reshape(bands, rows).astype(np.uint64) * by).sum(axis=1, dtype=np.uint64)
    return _mix(s + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


_SKETCH = "doc_id long, text_key long, n long, d1 long, d2 long, bands array<long>, sig binary"


def sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: set size, a 128-bit digest of the set, band keys and the hashes to compare."""
    bands, rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(2):
                s = shingles(value.as_py(), size, words)
                d = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None
                sig = signature(s, max(COMPARED, bands * rows)) if len(s) else None
                out[0].append(len(s))
                for i, shift in ((1, 64), (2, 0)):
                    out[i].append(None if d is None else ((d >> shift) & (2**64 - 1)) - 2**63)
                out[3].append(None if sig is None else band_keys(sig, bands, rows))
                out[4].append(None if sig is None else sig[:COMPARED].astype(np.uint16).tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)],
                                             names=[x.split()[0] for x in _SKETCH.split(", ")])

    return (docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("binary"))
            .mapInArrow(run, _SKETCH))


def _survivors(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the sequential comparison doesn't prune."""
    least = least_matches(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, COMPARED) for i in (2, 3))
            live, equal = np.arange(len(x)), np.zeros(len(x), np.int32)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal = equal + (x[live, part] == y[live, part]).sum(axis=1)
                on = equal >= need
                live, equal = live[on], equal[on]
            kept = batch.take(pa.array(live))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    one = lambda c: sigs.select(F.col("class").alias(c), F.col("sig").alias(f"sig_{c}"))
    return (pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sig_a", "sig_b")
            .mapInArrow(run, "a long, b long"))


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """(class, text) of the classes ``wanted``, as a stored table."""
    ids = classes.join(wanted, "class").select("class", F.col("doc_id").alias("_d"), "text_key")
    return materialize(docs.select("doc_id", "text")
                       .join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_d")))
                       .where(text_key() == F.col("text_key"))
                       .select("class", F.col("text").cast("binary").alias("text")).dropDuplicates(["class"]), name)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold; the texts of their classes are fetched once."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), classes, docs, "minhash-texts")

    def run(batches):
        words, of, last = _Words(), None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                if a[i].as_py() != of:
                    of, last = a[i].as_py(), shingles(ta[i].as_py(), size, words)
                other = shingles(tb[i].as_py(), size, words)
                both = len(np.intersect1d(last, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last) + len(other) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    one = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}"))
    return (pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "text_a", "text_b")
            .mapInArrow(run, "a long, b long"))


def _frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """About how many of ``texts`` hold the shingles of each slot."""

    def run(batches):
        words = _Words()
        for batch in batches:
            found = [shingles(t.as_py(), size, words) >> np.uint64(44) for t in batch.column(0)]
            slots, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["slot", "n"])

    out = np.zeros(SLOTS, np.uint32)
    counted = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for slot, n in counted.toArrow().to_pandas().itertuples(index=False):  # SLOTS rows at most
        out[slot] = min(n, 0xFFFFFFFF)
    return out


def parity(hashes: np.ndarray) -> np.ndarray:
    """``PARITY`` bits, each the parity of the hashes that fall on it.

    The exclusive or of two sketches is the sketch of the sets' difference, so
    it has at most as many bits set as shingles are in one set alone.
    """
    on = np.bincount((hashes >> np.uint64(16)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(on.astype(np.uint8)).view(np.int64)


def _prefixes(texts: DataFrame, frequency: np.ndarray, size: int, percent: int) -> DataFrame:
    """class, n, parity sketch, and the shingles of which a partner of at most this size must share one, from rare to frequent."""

    def run(batches):
        words = _Words()
        for batch in batches:
            ns, first, bits = [], [], []
            for value in batch.column(1):
                s = shingles(value.as_py(), size, words)
                bits.append(parity(s))
                s = s[np.lexsort((s, frequency[s >> np.uint64(44)]))]
                ns.append(len(s))
                first.append(s[: len(s) - -(-percent * len(s) // 100) + 1].view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(bits, lists), pa.array(first, lists)],
                                             names=["class", "n", "bits", "first"])

    return texts.mapInArrow(run, "class long, n long, bits array<long>, first array<long>")


def _across(members: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (class, root) with different roots that the prefix filter leaves."""
    texts = _texts(members.select("class"), classes, docs, "minhash-mixed-texts")
    found = _prefixes(texts, _frequencies(texts, size), size, percent).join(members, "class")
    words = range(PARITY // 64)
    found = materialize(found.select("class", "n", "root", *[F.col("bits")[i].alias(f"b{i}") for i in words],
                                     F.posexplode("first").alias("at", "shingle")), "minhash-prefixes")
    x, y = found.alias("x"), found.alias("y")
    # y is the smaller one; its shared shingle must lie in the shorter prefix for sizes from its own on
    room = (100 + percent) * (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")))
    # sets that reach the threshold differ in few shingles, which bounds the bits in which their sketches differ
    differ = sum(F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in words)
    return (x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root"))
                   & ((F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.class") < F.col("x.class"))))
                   & (100 * F.col("y.n") >= percent * F.col("x.n"))
                   & (F.col("y.at") <= F.col("y.n") - F.ceil(2 * percent * F.col("y.n") / (100 + percent)))
                   & (room >= percent * (F.col("x.n") + F.col("y.n")))
                   & ((100 + percent) * differ <= (100 - percent) * (F.col("x.n") + F.col("y.n"))))
            .select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct())


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, component_id, kept."""
    rows = materialize(sketch(docs, size, percent), "minhash-sketch")
    full = rows.where("n > 0")
    # a class is named by the smallest row number among its members; its text is that of one member
    numbered = full.select("d1", "d2", "doc_id", "text_key", "n", F.monotonically_increasing_id().alias("row"))
    classes = materialize(numbered.groupBy("d1", "d2").agg(
        F.min(F.struct("row", "doc_id", "text_key", "n")).alias("m"), F.min("doc_id").alias("first_id"))
        .select("d1", "d2", F.col("m.row").alias("class"), "m.doc_id", "m.text_key", "m.n", "first_id"), "minhash-classes")
    one_of = classes.select("d1", "d2", "class", F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    of_class = (full.select("d1", "d2", "doc_id", "text_key", "n", "bands", "sig").join(one_of, ["d1", "d2"])
                .where(F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")))
                .select("class", "n", "bands", "sig"))
    sigs = materialize(of_class.dropDuplicates(["class"]), "minhash-signatures")

    banded = sigs.select("class", "n", F.explode("bands").alias("band"))
    shared = (banded.groupBy("band").agg(F.min(F.struct("class", "n")).alias("first"), F.count("*").alias("members"))
              .where("members > 1"))
    shared = materialize(shared, "minhash-shared")   # the join below splits a bucket that very many classes share
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  as |A| / |B| bounds the similarity
    buckets = materialize(banded.join(shared, "band").select("band", "class", "n", "first", "members"), "minhash-buckets")
    star = (buckets.where((F.col("class") != F.col("first.class")) & near(F.col("n"), F.col("first.n")))
            .select(F.col("first.class").alias("a"), F.col("class").alias("b")).distinct())
    lean = sigs.select("class", "sig")
    star = materialize(_survivors(star, lean, percent), "minhash-star")
    one = star.groupBy("b").agg(F.min("a").alias("a"))
    found = materialize(_verified(one, classes, docs, size, percent), "minhash-links")
    roots = materialize(components(found), "minhash-roots")

    def rooted(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = (df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
                  .withColumn(f"root_{c}", F.coalesce(f"root_{c}", c)))
        return df

    def connected(pairs: DataFrame) -> DataFrame:
        """The roots when links among ``pairs`` are added."""
        links = rooted(_verified(pairs, classes, docs, size, percent), "a", "b")
        links = materialize(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "minhash-links")
        top = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
        return materialize(roots.unionByName(ends.join(roots, "node", "left_anti")).join(top, "root", "left")
                           .select("node", F.coalesce("top", "root").alias("root")), "minhash-roots")

    rest = rooted(star.join(one, ["a", "b"], "left_anti"), "a", "b").where("root_a <> root_b")
    rest = materialize(rest.select("a", "b"), "minhash-rest")
    if not rest.isEmpty():
        roots = connected(rest)
    many = rooted(buckets.where("members > 2").select("band", "class"), "class")
    mixed = many.groupBy("band").agg(F.min("root_class").alias("lo"), F.max("root_class").alias("hi")).where("lo <> hi")
    mixed = materialize(mixed, "minhash-mixed-bands")
    members = materialize(many.join(mixed.select("band"), "band", "left_semi")
                          .select("class", F.col("root_class").alias("root")).distinct(), "minhash-mixed")
    if not members.isEmpty():
        more = materialize(_survivors(_across(members, classes, docs, size, percent), lean, percent), "minhash-across")
        if not more.isEmpty():
            roots = connected(more)

    placed = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    first = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(first, "root").select("d1", "d2", "component_id")
    out = rows.select("doc_id", "text_key", "n", "d1", "d2")
    joined = out.where("n > 0").join(placed, ["d1", "d2"]).unionByName(
        out.where("n = 0").withColumn("component_id", F.col("doc_id")))
    return joined.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id",
                         F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, all columns as they came."""
    groups = materialize(near_groups(docs, size, percent), "minhash-groups")
    return drop_rows(docs, groups.where(~F.col("kept")))
