"""Substring dedup by hashing lines.

Units are the lines of a text (split at ``\\n``). A unit is normalised: A-Z
lower-cased, runs of white space made one space, ends trimmed. Units with at
least ``min_words`` words are grouped by a 128-bit digest over all documents;
the occurrence earliest in (doc_id, line) order stays, every other one is
removed. Removed spans are code-point offsets into the original text.

Only digests and offsets are shuffled for the grouping, and their first
occurrences are found by a partial aggregate, so a line in a third of all
documents sends one row per task; the texts move once, to meet their spans.

Defined results: a null text has no units and stays null; bytes that are no
UTF-8 read, and come back, as U+FFFD; a null doc_id sorts
last; rows that repeat a doc_id with its text count as one document, each gets
its result; a text that loses every line becomes empty; an empty table gives
an empty result; further columns of the input are ignored.

``drop_passages`` goes on where the lines end: after the removal of repeated
lines, every run of ``size`` words (across line ends) that occurs earlier in
(doc_id, word) order loses its words, wherever in a line it starts. Half-size
grams are winnowed, so that each such run holds a chosen gram, the same one in
every copy; only runs whose chosen gram repeats are digested and grouped.
Neighbouring runs with one chosen gram are first grouped as a whole, by the
digest of all their words: copies of the first such context in another
document are settled by that one row, and only the first ones have their runs
digested one by one. A run
that overlaps its own first occurrence loses the words beyond that one. A line
that loses all its words goes with its line end.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, text_key, texts_of

MIN_WORDS = 8
PASSAGE_WORDS = 50


def _units(text: str, min_words: int):
    """(number, start, end, digest) of each line with enough words."""
    start = 0
    for number, line in enumerate(text.split("\n")):
        words = line.encode().lower().split()
        if len(words) >= min_words:
            yield number, start, start + len(line), xxhash.xxh3_128_intdigest(b" ".join(words))
        start += len(line) + 1


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, unit, start, end and the digest (d1, d2) of every unit."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for row, text in enumerate(texts_of(batch.column(2))):
                for number, start, end, d in _units(text or "", min_words):
                    for column, x in zip(out, (row, number, start, end, (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63)):
                        column.append(x)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c, pa.int64()) for c in out[1:])],
                names=["doc_id", "text_key", "unit", "start", "end", "d1", "d2"])

    return (docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, text_key long, unit long, start long, end long, d1 long, d2 long"))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, unit, start, end of every unit that an earlier one repeats."""
    found = materialize(units(docs, min_words), "lines")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "unit")
    first = found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last")
    first = materialize(first, "lines-first")   # a table of its own: the join then splits a line that very many documents hold
    return (found.join(first, ["d1", "d2"]).where(rank != F.col("first"))
            .select("doc_id", "text_key", "unit", "start", "end").distinct())


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, text without repeated lines, n_units, removed (array of unit, start, end)."""
    # a document's spans are as many as its own lines
    spans = (repeated_spans(docs, min_words).groupBy("doc_id", "text_key")
             .agg(F.sort_array(F.collect_list(F.struct("unit", "start", "end"))).alias("removed"))
             .withColumnsRenamed({"doc_id": "_d", "text_key": "_k"}))

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for value, gone in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
                counts.append(sum(1 for _ in _units(value or "", min_words)))
                if gone:
                    lost = {x["unit"] for x in gone}
                    value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in lost)
                texts.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), batch.column(2)],
                names=["doc_id", "text", "n_units", "removed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_d"]) & (text_key() == spans["_k"]), "left")
    kind = "array<struct<unit: bigint, start: bigint, end: bigint>>"
    return (joined.select("doc_id", "text", F.coalesce("removed", F.array().cast(kind)).alias("removed"))
            .mapInArrow(run, f"doc_id long, text string, n_units long, removed {kind}"))


def _without(text: str, lost: list[dict]) -> str:
    """The text without the lines ``lost`` (unit, start, end)."""
    if not lost:
        return text
    units_ = {x["unit"] for x in lost}
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in units_)


def _words(text: str, lost: list[dict]) -> list[bytes]:
    return _without(text, lost).encode().lower().split()


def _places(text: str, lost: list[dict]):
    """The lines that stay, as (start, line), and for each of their words its line's index and its start in the text."""
    lines, at, starts, start = [], [], [], 0
    units_ = {x["unit"] for x in lost}
    for number, line in enumerate(text.split("\n")):
        if number not in units_:
            for m in re.finditer(WORD, line):
                at.append(len(lines))
                starts.append(start + m.start())
            lines.append((start, line))
        start += len(line) + 1
    return lines, at, starts


def _chosen(words: list[bytes], size: int):
    """Of each run of ``size`` words, the place of its chosen gram, and the hashes of all grams."""
    gram, n = size // 2, len(words)
    if n < size:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", n)
    base = 0x9E3779B97F4A7C15
    power = lambda x: np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(n - 1, x, "u8"), dtype="u8")])
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(hashes * power(base), dtype="u8")])
    grams = (sums[gram:] - sums[:-gram]) * power(pow(base, -1, 2**64))[: n - gram + 1]
    grams = (grams ^ (grams >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    grams ^= grams >> np.uint64(29)
    view = np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1)
    return np.arange(len(view)) + view.argmin(axis=1), grams


def _signed(x: int) -> int:
    return x - 2**63


def _rank():
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "place")


def _first(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """First occurrence of every key that has a second one, as a table."""
    first = found.groupBy(*keys).agg(F.min(_rank()).alias("first"), F.max(_rank()).alias("last")).where("first <> last")
    return materialize(first.drop("last"), name)


def _meet(rows: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """``rows`` with the columns of ``per_doc``, one row of which stands for a doc_id and text_key."""
    other = per_doc.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    return rows.join(other, rows["doc_id"].eqNullSafe(other["_d"]) & (rows["text_key"] == other["_k"]), how).drop("_d", "_k")


def _anchors(marked: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, place and gram of every chosen gram."""

    def run(batches):
        for batch in batches:
            rows, places, grams = [], [], []
            for row, (text, lost) in enumerate(zip(texts_of(batch.column(2)), batch.column(3).to_pylist())):
                chosen, hashes = _chosen(_words(text or "", lost), size)
                chosen = np.unique(chosen)
                rows.append(np.full(len(chosen), row))
                places.append(chosen)
                grams.append(hashes[chosen].view("i8"))
            rows, places, grams = (pa.array(np.concatenate([np.zeros(0, "i8"), *x]), pa.int64()) for x in (rows, places, grams))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), places, grams],
                                             names=["doc_id", "text_key", "place", "gram"])

    return marked.select("doc_id", "text_key", "text", "lines").mapInArrow(run, "doc_id long, text_key long, place long, gram long")


def _digest(words: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(b" ".join(words))
    return _signed(d >> 64), _signed(d & (2**64 - 1))


def _rows_of(held: DataFrame, rest: list[str], found, names: list[str]) -> DataFrame:
    """doc_id, text_key and ``names`` (long) of what ``found`` yields for each text's words and its columns ``rest``."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(len(names) + 1)]
            for row, (text, lost, given) in enumerate(zip(texts_of(batch.column(2)), *(batch.column(i).to_pylist() for i in (3, 4)))):
                for values in found(_words(text or "", lost), given):
                    for column, x in zip(out, (row, *values)):
                        column.append(x)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c, pa.int64()) for c in out[1:])],
                names=["doc_id", "text_key", *names])

    return (held.select("doc_id", "text_key", "text", "lines", *rest)
            .mapInArrow(run, "doc_id long, text_key long, " + ", ".join(f"{n} long" for n in names)))


def _contexts(held: DataFrame, size: int) -> DataFrame:
    """Neighbouring runs that share a chosen gram among the text's ``places``, as one row: first run, how many, digest of all their words."""

    def found(words, places):
        chosen = _chosen(words, size)[0]
        at = np.flatnonzero(np.isin(chosen, places))
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(chosen[at]) != 0)) + 1
        for part in np.split(at, cut):
            if len(part):
                place, n = int(part[0]), len(part)
                yield (place, n, *_digest(words[place : place + n - 1 + size]))

    return _rows_of(held, ["places"], found, ["place", "n", "d1", "d2"])


def _runs(held: DataFrame, size: int) -> DataFrame:
    """Place and digest of every single run of the text's contexts ``parts`` (place, n)."""

    def found(words, parts):
        for part in parts:
            for place in range(part["place"], part["place"] + part["n"]):
                yield (place, *_digest(words[place : place + size]))

    return _rows_of(held, ["parts"], found, ["place", "d1", "d2"])


def _cut(text: str, lost: list[dict], gone: list[dict]):
    """The text without the lost lines and the words of ``gone`` (from, to), and the (start, end) that the words take along."""
    if not gone:
        return _without(text, lost), []
    lines, at, starts = _places(text, lost)
    drop = np.zeros(len(starts) + 1, "i8")
    for x in gone:
        drop[x["from"]] += 1
        drop[x["to"]] -= 1
    drop = (np.cumsum(drop) > 0).tolist()
    per_line = [[] for _ in lines]
    for i, line in enumerate(at):
        per_line[line].append(i)
    kept, spans = [], []
    for (start, line), held in zip(lines, per_line):
        if held and all(drop[i] for i in held):
            spans.append((start, start + len(line)))
            continue
        end, out, done = start + len(line), [], start
        for i, following in zip(held, [*held[1:], None]):
            if drop[i]:
                stop = end if following is None else starts[following]
                out.append(text[done : starts[i]])
                if spans and spans[-1][1] == starts[i]:
                    spans[-1] = (spans[-1][0], stop)
                else:
                    spans.append((starts[i], stop))
                done = stop
        kept.append("".join(out) + text[done:end])
    return "\n".join(kept), spans


def _long(text: str, lost: list[dict], gone: list[dict], size: int) -> int:
    """How many stretches of ``size`` words or more lie in lost lines and ``gone`` runs."""
    units_, flags, kept = {x["unit"] for x in lost}, [], []
    for number, line in enumerate(text.split("\n")):
        n = len(line.encode().split())
        flags += [number in units_] * n
        if number not in units_:
            kept += range(len(flags) - n, len(flags))
    for x in gone:
        for i in kept[x["from"] : x["to"]]:
            flags[i] = True
    return sum(on and sum(1 for _ in run) >= size for on, run in itertools.groupby(flags))


def drop_passages(docs: DataFrame, min_words: int = MIN_WORDS, size: int = PASSAGE_WORDS) -> DataFrame:
    """Per row: doc_id, text without repeated lines and runs of words, lines (unit, start, end) and passages (start, end) removed.

    n_units counts the lines that are units, n_long the stretches of ``size`` words or more that went, by either step.
    """
    kind = "array<struct<unit: bigint, start: bigint, end: bigint>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs, min_words).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("unit", "start", "end"))).alias("lines"))
    marked = _meet(rows, spans, "left").withColumn("lines", F.coalesce("lines", F.array().cast(kind)))
    marked = materialize(marked, "passages-marked")

    anchors = materialize(_anchors(marked, size), "passages-anchors")
    # a document's places are as many as its own words, here and below
    places = (anchors.join(_first(anchors, ["gram"], "passages-grams"), "gram").groupBy("doc_id", "text_key")
              .agg(F.collect_set("place").alias("places")))
    # contexts are told apart first: where another document has the whole context earlier, all its runs go at once
    contexts = materialize(_contexts(_meet(marked, places, "inner"), size), "passages-contexts")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    told = materialize(contexts.join(_first(contexts, ["d1", "d2", "n"], "passages-classes"), ["d1", "d2", "n"], "left")
                       .select("doc_id", "text_key", "place", "n", (F.col("first").isNotNull() & ~own).alias("copied")), "passages-told")
    parts = told.where("NOT copied").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("place", "n")).alias("parts"))
    # every run's first occurrence lies in the first of equal contexts, so these and repeats inside a document are enough
    runs = materialize(_runs(_meet(marked, parts, "inner"), size), "passages-runs")
    after = F.when(own, F.greatest("place", F.col("first.place") + size)).otherwise(F.col("place"))
    single = (runs.join(_first(runs, ["d1", "d2"], "passages-first"), ["d1", "d2"]).where(_rank() != F.col("first"))
              .select("doc_id", "text_key", F.struct(after.alias("from"), (F.col("place") + size).alias("to")).alias("x")))
    whole = told.where("copied").select("doc_id", "text_key", F.struct(F.col("place").alias("from"), (F.col("place") + F.col("n") - 1 + size).alias("to")).alias("x"))
    gone = single.unionByName(whole).groupBy("doc_id", "text_key").agg(F.collect_set("x").alias("gone"))

    def run(batches):
        for batch in batches:
            texts, passages, counts, long_ = [], [], [], []
            for value, lost, words in zip(texts_of(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3))):
                found = []
                counts.append(sum(1 for _ in _units(value or "", min_words)))
                long_.append(_long(value, lost, words or [], size) if lost or words else 0)
                if value is not None:
                    value, found = _cut(value, lost, words or [])
                texts.append(value)
                passages.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), batch.column(2),
                 pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(counts, pa.int64()), pa.array(long_, pa.int64())],
                names=["doc_id", "text", "lines", "passages", "n_units", "n_long"])

    return (_meet(marked, gone, "left").select("doc_id", "text", "lines", "gone")
            .mapInArrow(run, f"doc_id long, text string, lines {kind}, passages array<struct<start: bigint, end: bigint>>, n_units long, n_long long"))
