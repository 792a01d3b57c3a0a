"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids (and an end id) are cut into pieces that depend on its own
length only: whole sequences first, then what is left in near-equal parts of
at most ``part`` ids. Whole pieces are sequences as they are. The others are
dealt into groups of about ``group`` pieces by their place in a table, and in
each group differencing makes near-equal windows: every piece starts as a
partial partition of one used window, and the two partial partitions with the
largest imbalance (most to least filled window) are merged again and again,
fullest windows on emptiest, until one is left. The group starts with as many
windows as its ids need at least; when a window exceeds the capacity, the
count rises and the group is differenced again.

Texts are read once and ids are never shuffled: checksums, lengths and starts
of the pieces are written as a table, and only lengths meet in the groups.

Defined results: a null or empty text is the end id alone; bytes that are no
UTF-8 count as U+FFFD; repeated rows are
packed as documents of their own; a text of any length is cut the same way;
an empty table gives an empty result; further columns of the input are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts_of

CAPACITY = 2048
PART = 512
GROUP = 1024
END_ID = 1
#: Texts above this many characters go to the tokenizers library; the other one's pattern engine may refuse them.
LONG_TEXT = 1_000_000


def encoder(vocabulary: str | None = None, added: bool = False) -> Callable[[str], list[int]]:
    """Ids of byte_bpe_50k; ``vocabulary`` is the folder of the public vocabulary files.

    tiktoken reads the same vocabulary as ranks and gives the same ids several
    times faster (tests hold both against each other). With ``added`` the
    vocabulary's added tokens inside a text have ids of their own, as in the
    plain call of tokenizers, which takes the texts that hold one; else they are ordinary text.
    """
    import base64
    import json
    import os

    import public_tokenizers as public
    import tiktoken

    path = public.path if vocabulary is None else lambda name: os.path.join(vocabulary, name)
    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    marks = []
    if added:
        with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
            marks = [x["content"] for x in json.load(f)["added_tokens"]]
    quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = None

    def encode(text: str) -> list[int]:
        nonlocal slow
        if len(text) <= LONG_TEXT and not any(x in text for x in marks):
            return quick.encode_ordinary(text)
        if slow is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
            slow.encode_special_tokens = not added
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int, part: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    whole = n // capacity * capacity
    out = [(i, capacity) for i in range(0, whole, capacity)]
    if n > whole:
        k = -(-(n - whole) // part)
        edges = [whole + (n - whole) * i // k for i in range(k + 1)]
        out += [(a, b - a) for a, b in zip(edges, edges[1:])]
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, part: int = PART, end_id: int = END_ID,
           vocabulary: str | None = None, added: bool = False) -> DataFrame:
    """doc_id, start, length, doc_tokens and the ids (unsigned 32 bit, little-endian) of every piece."""

    def run(batches):
        encode = encoder(vocabulary, added)
        for batch in batches:
            rows, starts, lengths, sizes, ids = [], [], [], [], []
            for row, text in enumerate(texts_of(batch.column(1))):
                got = np.array([*encode(text or ""), end_id], "<u4")
                for start, length in cut(len(got), capacity, part):
                    rows.append(row)
                    starts.append(start)
                    lengths.append(length)
                    sizes.append(len(got))
                    ids.append(got[start : start + length].tobytes())
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), *(pa.array(c, pa.int64()) for c in (starts, lengths, sizes)), pa.array(ids, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary"))


def difference(lengths: list[int], windows: int) -> list[int]:
    """The window of each piece after Karmarkar-Karp differencing into ``windows`` windows."""
    onto = list(range(len(lengths)))  # piece -> piece whose window it joined
    # a partial partition: its used windows as (filling, a piece in it), ascending; unused ones are left out
    heap = [(-x, i, [(x, i)]) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    serial = len(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = max(0, len(a) + len(b) - windows)
        joined = []
        for (x, i), (y, j) in zip(a[:shared], reversed(b[:shared])):
            onto[j] = i
            joined.append((x + y, i))
        merged = sorted(joined + a[shared:] + b[shared:])
        least = merged[0][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[-1][0], serial, merged))
        serial += 1
    number = {i: n for n, (_, i) in enumerate(heap[0][2])}
    out = []
    for i in range(len(lengths)):
        while onto[i] != i:
            onto[i] = i = onto[onto[i]]
        out.append(number[i])
    return out


def pack_group(lengths: list[int], capacity: int) -> list[int]:
    """Windows of at most ``capacity``; the count rises until none exceeds it."""
    windows = -(-sum(lengths) // capacity)
    while True:
        found = difference(lengths, windows)
        filled = np.bincount(found, lengths, minlength=windows)
        if filled.max() <= capacity:
            return found
        windows += max(1, windows // 200)


def pack(table: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``table`` (a stored table with a length per row) with sequence_id and offset."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "place"], ascending=[False, True], ignore_index=True)
        rows["window"] = pack_group(rows["length"].tolist(), capacity)
        rows["offset"] = rows.groupby("window")["length"].cumsum() - rows["length"]
        return rows[["place", "group", "window", "offset"]]

    placed = materialize(table.withColumn("place", F.monotonically_increasing_id()), "pack-pieces")
    short = placed.where(F.col("length") < capacity)
    groups = max(1, round(short.count() / group))
    dealt = short.select("place", F.col("length").cast("long"), F.pmod(F.xxhash64("place"), F.lit(groups)).alias("group"))
    packed = (dealt.groupBy("group").applyInPandas(run, "place long, group long, window long, offset long")
              .select(F.col("place").alias("_p"), (F.col("group") * (1 << 20) + F.col("window")).alias("sequence_id"), "offset"))
    whole = placed.where(F.col("length") >= capacity)  # each a sequence of its own, numbered after the groups'
    return (short.join(packed, short["place"] == packed["_p"]).drop("_p", "place")
            .unionByName(whole.withColumns({"sequence_id": F.lit(groups * (1 << 20)) + F.col("place"), "offset": F.lit(0).cast("long")}).drop("place")))


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, part: int = PART, group: int = GROUP, end_id: int = END_ID,
                  vocabulary: str | None = None, added: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    found = pieces(docs, capacity, part, end_id, vocabulary, added)
    return pack(found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), capacity, group)
