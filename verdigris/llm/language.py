"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is its letters, lower-cased, as words with a blank on either side. Its
subwords are the 2, 3 and 4 neighbouring characters inside a word and its blanks.
Each is hashed to one of ``BUCKETS`` embeddings, the text is the mean of its
subwords' embeddings, and a linear softmax gives one probability per language.
Embeddings and weights are trained together by stochastic gradient descent in
numpy, one passage at a time.

Training reads at most ``TRAIN_DOCS`` labelled documents of every language, those
with the smallest hash of their doc_id among texts of at most ``TRAIN_CHARS``
characters; each distinct text gives itself and ``PASSAGES`` passages of 1 to 50 words. A fifth of
the documents is kept from training for calibration: the logits are scaled by
exp(a + b log(subwords)), with a and b of least log loss, so that short texts get lower
scores; and the least score is found from which at most ``REJECT_ERROR`` of the
accepted passages are wrong. Predictions below it are marked as rejected, and
keep the best language and its score.

For prediction, weights and embeddings are multiplied beforehand (the mean is linear),
and the products are rounded to whole numbers, so that sums don't depend on
how texts are sliced. Whole texts are read, in slices of ``SLICE`` characters.

Defined results: a text that is null or has no letter is ``und`` with score 0, and
rejected; so is every text where nothing labelled could be learnt; ties go to
the language first in code-point order; bytes that are no UTF-8 count as U+FFFD; rows are
judged one by one, so repeated rows share a result; an empty table gives an empty
result; further columns of the input are ignored. Languages with a null label or
a null doc_id are not learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKETS, DIMENSIONS, SIZES = 1 << 16, 16, (2, 3, 4)
TRAIN_DOCS, TRAIN_CHARS, PASSAGES, EPOCHS, RATE = 400, 20_000, 5, 4, 0.4
REJECT_ERROR = 0.01
#: Before the smallest hashes of a language are ranked, so many times as many rows are taken by their hash alone.
THINNED = 4
SLICE = 1 << 20
UNKNOWN = "und"
_UNIT = 1 << 20   # products are rounded to this part of one
_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str | None) -> str:
    """The words of the text with a blank on either side, or nothing."""
    words = _LETTERS.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


def _subwords(points: np.ndarray, limit: int):
    """For each size: places below ``limit`` where a subword starts, and its bucket."""
    blank = points == 32
    with np.errstate(over="ignore"):
        for size in SIZES:
            n = len(points) - size + 1
            if n <= 0:
                continue
            inner = ~blank[:n] | ~blank[1 : n + 1] if size == 2 else ~blank[1 : n + 1]
            h = points[:n] + np.uint32(size * 0x9E37)
            for i in range(1, size):
                h = h * np.uint32(0x01000193) ^ points[i : n + i]
                if 1 < i < size - 1:
                    inner = inner & ~blank[i : n + i]
            at = np.flatnonzero(inner[:limit])
            h = h[at]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield at, (h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def buckets(text: str) -> np.ndarray:
    """Buckets of all subwords of a text of ``letters``."""
    return np.concatenate([np.zeros(0, np.uint32), *(b for _, b in _subwords(_points(text), len(text)))])


@dataclass
class Model:
    """Languages, the product of weights and embeddings per language and bucket, biases, calibration."""

    languages: list[str]
    products: np.ndarray   # languages x buckets, whole numbers
    bias: np.ndarray
    scale: tuple[float, float] = (0.0, 0.0)
    least: float = 0.0     # scores below it are rejected

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text (of ``letters``, none empty): number of subwords, and the sum of their products per language."""
        count, total = np.zeros(len(texts), np.int64), np.zeros((len(self.languages), len(texts)), np.int64)

        def add(points, limit, first, starts):
            for at, bucket in _subwords(points, limit):
                cut = np.searchsorted(at, starts)
                n = np.diff(np.append(cut, len(at)))
                has = np.flatnonzero(n)
                count[first : first + len(starts)] += n
                for k, row in enumerate(self.products):
                    total[k, first + has] += np.add.reduceat(row[bucket], cut[has]) if len(has) else 0

        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
                size += len(texts[j])
                j += 1
            points = _points("".join(texts[i:j]))
            starts = np.cumsum([0, *map(len, texts[i : j - 1])])
            if size <= SLICE:
                add(points, size, i, starts)
            else:   # one long text: each slice looks as far ahead as a subword reaches
                for a in range(0, size, SLICE):
                    part = points[a : a + SLICE + max(SIZES) - 1]
                    add(part, min(SLICE, size - a), i, np.zeros(1, np.int64))
            i = j
        return count, total

    def scores(self, texts: list[str]) -> np.ndarray:
        """texts x languages: calibrated probabilities."""
        count, total = self.sums(texts)
        return _softmax(self.logits(count, total) * np.exp(self.scale[0] + self.scale[1] * np.log(np.maximum(count, 1)))[:, None])

    def logits(self, count: np.ndarray, total: np.ndarray) -> np.ndarray:
        return total.T / (_UNIT * np.maximum(count, 1)[:, None]) + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _passages(texts: list[str], labels: list[int], random: np.random.Generator) -> list[tuple[str, int]]:
    out = []
    for text, label in zip(texts, labels):
        words = text.split()
        out.append((text, label))
        for _ in range(PASSAGES):
            n = int(random.integers(1, 51))
            at = int(random.integers(0, max(1, len(words) - n + 1)))
            out.append((f" {' '.join(words[at : at + n])} ", label))
    return out


def fit(texts: list[str], labels: list[str], seed: int = 0) -> Model:
    """The model for labelled texts (each of ``letters``, none empty)."""
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    y, random = [number[x] for x in labels], np.random.default_rng(seed)
    held = [i % 5 == 4 for i in range(len(texts))]
    split = lambda keep: _passages([t for t, h in zip(texts, held) if h == keep], [k for k, h in zip(y, held) if h == keep], random)
    learn, check = split(False), split(True)
    ready = []
    for text, label in learn:
        bucket, n = np.unique(buckets(text), return_counts=True)
        ready.append((bucket, (n / n.sum())[:, None], label))
    embed = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    weight, bias = np.zeros((len(languages), DIMENSIONS)), np.zeros(len(languages))
    steps, step = EPOCHS * len(ready), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(ready)):
            bucket, share, label = ready[i]
            rate = RATE * (1 - step / steps)
            mean = (embed[bucket] * share).sum(axis=0)
            z = weight @ mean + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[label] -= 1
            back = g @ weight
            weight -= rate * g[:, None] * mean
            bias -= rate * 0.1 * g
            # a step of the rate in the mean, whatever the number of subwords: each moves by its own share of the text
            embed[bucket] -= (rate / max((share * share).sum(), 1e-9)) * share * back * 0.5
            step += 1
    model = Model(languages, np.rint(weight @ embed.T * _UNIT).astype(np.int64), bias)
    return _calibrated(model, check) if check else model


def _calibrated(model: Model, passages: list[tuple[str, int]]) -> Model:
    """Scale of the logits by least log loss, and the least score that keeps errors rare."""
    y = np.array([k for _, k in passages])
    count, total = model.sums([t for t, _ in passages])
    z, size = model.logits(count, total), np.log(np.maximum(count, 1))

    def loss(a, b):
        p = _softmax(z * np.exp(a + b * size)[:, None])[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-12)).mean()

    best, width = (0.0, 0.0), 2.0
    for _ in range(6):   # a grid around the best point, finer each time
        best = min(((best[0] + width * i / 4, best[1] + width * j / 8) for i in range(-4, 5) for j in range(-4, 5)), key=lambda s: loss(*s))
        width /= 2.5
    model.scale = best
    p = _softmax(z * np.exp(best[0] + best[1] * size)[:, None])
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[order])
    fine = np.flatnonzero(wrong <= REJECT_ERROR * np.arange(1, len(y) + 1))
    model.least = float(top[order[fine[-1]]]) if len(fine) else 1.0
    return model


def train(docs: DataFrame, usable: Column, lang: str = "lang", most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Model | None:
    """The model for the labelled rows of ``docs`` that are ``usable``; None where there are none.

    At most ``most`` documents a language reach the driver, as texts of at most ``chars`` characters.
    """
    rows = docs.select("doc_id", F.make_valid_utf8(F.col("text").cast("string")).alias("text"), F.col(lang).cast("string").alias("lang"), usable.alias("usable"))
    rows = rows.where(F.col("usable") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.char_length("text").between(1, chars))
    rank = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    # a language's rows are thinned by their hash to some times `most` before they meet, so few reach a task at any size
    # (a stored table, whose size Spark knows: small, it is broadcast, and no text is shuffled by language)
    count = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "_lang"), "language-counts")
    share = F.shiftrightunsigned(F.xxhash64("doc_id").bitwiseXOR(F.lit(-(2**63))), 11).cast("double") / F.lit(float(2**53))
    rows = rows.join(count, rows["lang"] == count["_lang"]).where(share * F.col("n") <= THINNED * most)
    order = Window.partitionBy("lang").orderBy(*rank)
    sample = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("lang", "place", "text").collect()
    texts = {}
    for lang_, _, text in sorted(sample, key=lambda r: (r[1], r[0])):
        if short := letters(text):
            texts.setdefault(short, lang_)
    return fit(list(texts), list(texts.values())) if texts else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, lang_pred, score and rejected."""

    def run(batches):
        for batch in batches:
            short = [letters((t.as_py() or b"").decode()) for t in batch.column(1)]
            has = [i for i, t in enumerate(short) if t] if model else []
            lang, score = np.full(len(short), UNKNOWN, object), np.zeros(len(short))
            if has:
                p = model.scores([short[i] for i in has])
                lang[has] = np.array(model.languages, object)[p.argmax(axis=1)]
                score[has] = p.max(axis=1)
            out = (score < model.least) if model else np.ones(len(short), bool)
            out |= lang == UNKNOWN
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    text = F.make_valid_utf8(F.col("text").cast("string")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
