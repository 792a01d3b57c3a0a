"""Spelling variants by dense prefix-suffix tiling.

Words are compared in dense blocks: the code points of two blocks of words stand
in padded byte matrices, aligned left and right, and whole matrices of pairs get
their common prefix and suffix lengths, column by column. Two words differ by one
inserted, deleted or replaced code point exactly when these two lengths reach the
longer length minus one.

Blocks needn't hold pairs that cannot be near. For a longer length L, cut at
t = (L + 1) // 2: if the common prefix is shorter than t, the common suffix has at
least L - t code points. So the words of lengths L and L - 1 meet once in the tile
of their first t code points and once in the tile of their last L - t; a near pair
counts in the first where its common prefix reaches t, else in the second, so
exactly once. Tiles with more than ``BLOCK`` words are cut into blocks by a hash
of the word, and every two blocks meet in a task of their own; the work of such a
tile grows with the square of its words, as in any dense comparison.

No pairs are sent on: a task reports per word how many near words it saw and the
best of them, and Spark adds these up. A word's form is its near word of largest
count (ties: smallest in code-point order) where that count is at least ``factor``
times its own. Counts at least double along forms, so chains are short; the roots
are found by replacing forms by their forms, all at once, until nothing moves.

Defined results: a null or empty text has no words, bytes that are no UTF-8 part
words; a null doc_id counts as the empty string; repeated rows count again; texts
of any length are read whole, words of any length are compared; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")   # all below U+0100, so a code point is a byte of a matrix
MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2
BLOCK = 1024
#: Rows of tiles that a task compares together; only the size of tasks hangs on it.
TASK_ROWS = 4096
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def word_counts(docs: DataFrame, least_length: int = MIN_LENGTH, least: int = MIN_COUNT, spoil: int = 0) -> DataFrame:
    """(word, n) of all words of ``least_length`` code points or more that occur ``least`` times.

    With ``spoil``, words whose crc32 (of ``<doc_id>:<word>``) it divides lose the
    code point that the crc32 points at, before anything else looks at them.
    """

    def spoilt(word: str, head: int) -> str:
        h = zlib.crc32(word.encode(), head)
        if h % spoil:
            return word
        i = h % len(word)
        return word[:i] + word[i + 1 :]

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(LETTERS.findall((text.as_py() or b"").lower().decode("utf-8", "replace")))
                head = zlib.crc32(f"{key or ''}:".encode())
                for word, n in found.items():
                    if len(word) >= least_length:
                        if spoil:
                            word = spoilt(word, head)
                            if len(word) < least_length:
                                continue
                        counts[word] += n
                if len(counts) > HELD:
                    yield table(counts)
                    counts.clear()
        yield table(counts)

    return (docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def tiles(words: DataFrame) -> DataFrame:
    """Four rows for each word: as longer (its own length) and shorter word (one more), by prefix and by suffix."""
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer")
    cut = F.floor((F.col("longer") + 1) / 2).cast("int")
    key = lambda side: F.when(F.lit(side == "p"), F.substring("word", F.lit(1), cut)).otherwise(
        F.substring("word", F.length("word") - (F.col("longer") - cut) + 1, F.col("longer") - cut))
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), key(s).alias("key")) for s in "ps"))).alias("x")
    return words.select("word", "n", longer).select("word", "n", "longer", sides).select("word", "n", "longer", "x.side", "x.key")


def _matrices(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    read = lambda pad: np.frombuffer(b"".join(pad(w, width, b"\0") for w in words), np.uint8).reshape(-1, width).T.copy()
    return read(bytes.ljust), read(bytes.rjust)


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], side: str, longer: int) -> np.ndarray:
    """Which words of ``a`` (length ``longer``) and ``b`` (that or one less) of a tile are one edit apart, and count in it."""
    cut = (longer + 1) // 2
    shape = a[0].shape[1], b[0].shape[1]

    def common(m, columns):
        on, n = np.ones(shape, bool), np.zeros(shape, np.int32)
        for c in columns:
            on &= m[0][c][:, None] == m[1][c][None, :]
            if not on.any():
                break
            n += on
        return n

    left, right = (a[0], b[0]), (a[1], b[1])
    if side == "p":  # the first `cut` code points agree
        return common(left, range(cut, longer)) + common(right, range(longer - 1, cut - 1, -1)) >= longer - cut - 1
    prefix = common(left, range(cut))  # the last `longer - cut` agree
    return (prefix < cut) & (prefix + common(right, range(cut - 1, -1, -1)) >= cut - 1)


def compare(words: list[str], part: np.ndarray, one: bool, side: str, longer: int):
    """(index, near words, best near word's index) of the words of ``one`` block of a tile, or of two (``part`` 0 and 1) against each other.

    The words come sorted by count from large to small, then by code points, so the first near word is the best.
    """
    coded = [w.encode("latin-1") for w in words]
    long_ = np.array([len(w) == longer for w in coded])
    blocks = {}
    for p in (0, 1):
        for kind in (True, False):
            at = np.flatnonzero((part == p) & (long_ == kind))
            if len(at):
                blocks[p, kind] = at, _matrices([coded[i] for i in at], longer)
    meet = ([((0, True), (0, True)), ((0, True), (0, False))] if one
            else [((0, True), (1, True)), ((0, True), (1, False)), ((1, True), (0, False))])
    out = []
    for x, y in meet:
        if x not in blocks or y not in blocks:
            continue
        (at, a), (bt, b) = blocks[x], blocks[y]
        if x == y and len(at) < 2:
            continue
        near = _near(a, b, side, longer)
        if x == y:
            np.fill_diagonal(near, False)
        for i, j, m in ((at, bt, near),) if x == y else ((at, bt, near), (bt, at, near.T)):
            n = m.sum(axis=1)
            hit = np.flatnonzero(n)
            if len(hit):
                out.append((i[hit], n[hit], j[m[hit].argmax(axis=1)]))
    return out


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best: struct of less (minus its count) and word) of every word of ``words`` (a stored table) that has a near one."""
    rows = materialize(tiles(words), "spelling-tiles")
    tile = ["longer", "side", "key"]
    # tiles that are cut: few rows, each standing for more than a block of words
    large = materialize(rows.groupBy(*tile).count().where(F.col("count") > block)
                        .select(*tile, F.ceil(F.col("count") / block).cast("long").alias("blocks")), "spelling-large-tiles")
    own = F.pmod(F.xxhash64("word"), F.col("blocks"))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j"), (F.col("own") > x).cast("int").alias("part")))
    dealt = (rows.join(large, tile, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("own", own)
             .select(*tile, "word", "n", F.explode(meets).alias("m")).select(*tile, "word", "n", "m.i", "m.j", "m.part"))
    tasks = max(1, round(rows.count() / TASK_ROWS))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64(*tile, "i", "j"), F.lit(tasks)))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["longer", "side", "key", "i", "j", "n", "word"], ascending=[True] * 5 + [False, True], ignore_index=True)
        code = df.groupby(["longer", "side", "key", "i", "j"], sort=False).ngroup().to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [len(df)]))
        word, n, part = df["word"].to_numpy(), df["n"].to_numpy(), df["part"].to_numpy()
        side, longer, one = df["side"].to_numpy(), df["longer"].to_numpy(), (df["i"] == df["j"]).to_numpy()
        who, many, best = [], [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                for i, k, j in compare(word[a:b].tolist(), part[a:b], one[a], side[a], int(longer[a])):
                    who.append(i + a)
                    many.append(k)
                    best.append(j + a)
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        who, best = join(who), join(best)
        return pd.DataFrame({"word": word[who], "n_near": join(many), "best_n": n[best], "best_word": word[best]})

    best = F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word"))
    return (dealt.groupBy("task").applyInPandas(run, "word string, n_near long, best_n long, best_word string")
            .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form), form by form to the last one."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        above = up.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        nxt = materialize(up.join(above, up["root"] == above["_w"], "left")
                          .select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spelling-roots")
        up = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return up


def variants(words: DataFrame, factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n)."""
    words = materialize(words.select("word", "n"), "spelling-words")
    best: Column = -F.col("best.less")
    take = best >= factor * F.col("n")
    found = materialize(words.join(near_words(words, block), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(take, F.col("best.word")).alias("form"), F.when(take, best).alias("form_n")), "spelling-found")
    return (found.join(roots(found.where("form IS NOT NULL")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
