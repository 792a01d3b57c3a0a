"""Quality rules by line labelling: a linear-chain conditional random field
marks each line as content or boilerplate, Viterbi decoding picks the best
sequence, and the share of word characters in content lines decides.

Each line gets features counted from its bytes (share of symbols, capitals,
digits, pipes and exclamation marks; word count and length; whether the line
or its words repeat earlier ones; how it ends; its place). The field has one
weight per feature for boilerplate against content, and transition weights
between neighbouring lines.

Training reads at most ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_CHARS`` characters, those with the smallest hash of their doc_id. The
labels are by document, so lines start as content where the document is good
and as boilerplate where it isn't; after each fit the lines of bad documents
are labelled anew by the field, as they hold good lines too. Without labels of
both kinds the field has the plain weights of ``PRIOR``.

Defined results: a null or empty text has no words and fails the base rules;
texts are read as bytes, so those that are no UTF-8 count as they are;
rows are judged one by one, so repeated rows share a result; lines of any
length are counted in slices of 1 MB; an empty table gives an empty result;
further columns of the input are ignored, or passed on by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 1000
TRAIN_CHARS = 20_000
TRAIN_ROUNDS = 3
CONTENT_SHARE = 0.5
WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = b"#*$%&|<>"
SLICE = 1 << 20

FEATURES = ["bias", "symbols", "pipes", "capitals", "digits", "marks", "punctuation", "words", "short", "word_length",
            "seen_line", "repeated_words", "ends_sentence", "starts_capital", "first", "last", "twin_words"]
#: Used where nothing can be learnt: symbols, pipes, shouting and repetition speak for boilerplate.
PRIOR = np.array([-2, 4, 4, 4, 1, 3, 0, 0, 0.5, 0, 2, 4, -0.5, 0, 0, 0, 4], float)

_BLANK, _CONT, _SYM, _PIPE, _UPPER, _LOWER, _DIGIT, _MARK, _PUNCT, _REST = range(10)
_KIND = np.full(256, _REST, np.uint8)
for _chars, _k in ((b" \t\n\x0b\x0c\r", _BLANK), (range(0x80, 0xC0), _CONT), (SYMBOLS, _SYM), (b"|", _PIPE), (range(65, 91), _UPPER),
                   (range(97, 123), _LOWER), (range(48, 58), _DIGIT), (b"!", _MARK), (b".,;:?", _PUNCT)):
    _KIND[list(_chars)] = _k


def _counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes of each kind in each line, and the words that begin in it."""
    out = np.zeros(len(starts) * 16, np.int64)
    for i in range(0, len(data), SLICE):
        part = _KIND[data[i : i + SLICE]]
        lo = np.searchsorted(starts, i, "right") - 1
        hi = np.searchsorted(starts, i + len(part) - 1, "right")
        line = np.repeat(np.arange(lo, hi), np.diff(np.concatenate(([i], starts[lo + 1 : hi], [i + len(part)]))))
        out += np.bincount(line * 16 + part, minlength=len(out))
        begins = part != _BLANK
        begins[1:] &= part[:-1] == _BLANK
        if i:
            begins[0] &= _KIND[data[i - 1]] == _BLANK
        out += np.bincount(line[begins] * 16 + 10, minlength=len(out))
    return out.reshape(-1, 16)


def _numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words))


def _repeated(w: np.ndarray) -> np.ndarray | None:
    """Which words lie in an 8-word window that the text has twice or more."""
    n = len(w) - WINDOW + 1
    if n < 2 or int(w.max()) + 1 == len(w):
        return None
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        x = (w[i : i + n] + np.uint64(i * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h += (x ^ (x >> np.uint64(32))) * np.uint64(2 * i + 0xD6E8FEB86659FD93)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return None
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(w) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW:] -= twice
    return np.cumsum(edge)[:-1] > 0


@dataclass
class Lines:
    """Base counts of a text, and its lines' features and word characters."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    weight: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def read(text: bytes | None) -> Lines:
    text = text or b""
    data = np.frombuffer(text, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    count = _counts(data, starts) if len(data) else np.zeros((1, 16), np.int64)
    words = text.split()
    n_words = count[:, 10]
    points = count[:, :10].sum(axis=1) - count[:, _CONT]
    solid = points - count[:, _BLANK]
    again, seen = np.zeros(len(starts), bool), set()
    for i, line in enumerate(text.split(b"\n")):
        if n_words[i]:
            again[i] = line in seen
            seen.add(line)
    w = _numbered(words)
    rep = _repeated(w)
    line_of = np.repeat(np.arange(len(starts)), n_words)
    rep_line = np.zeros(len(starts)) if rep is None else np.bincount(line_of, rep, minlength=len(starts))
    twin_line = np.bincount(line_of[1:], w[1:] == w[:-1], minlength=len(starts))
    has = np.flatnonzero(n_words)
    c, solid, n_w = count[has].astype(float), solid[has], n_words[has].astype(float)
    size = np.maximum(solid, 1)
    letters = c[:, _UPPER] + c[:, _LOWER] + 1
    f = np.zeros((len(has), len(FEATURES)))
    f[:, 0] = 1
    f[:, 1] = np.minimum(10 * c[:, _SYM] / size, 1)
    f[:, 2] = np.minimum(10 * c[:, _PIPE] / size, 1)
    f[:, 3] = c[:, _UPPER] / letters
    f[:, 4] = np.minimum(5 * c[:, _DIGIT] / size, 1)
    f[:, 5] = np.minimum(10 * c[:, _MARK] / size, 1)
    f[:, 6] = np.minimum(10 * c[:, _PUNCT] / size, 1)
    f[:, 7] = np.log1p(n_w) / 4
    f[:, 8] = n_w < 5
    f[:, 9] = np.minimum(solid / np.maximum(n_w, 1), 20) / 10
    f[:, 10] = again[has]
    f[:, 11] = rep_line[has] / np.maximum(n_w, 1)
    f[:, 16] = twin_line[has] / np.maximum(n_w, 1)
    if len(has):
        ends = np.append(starts[1:] - 1, len(data))[has]
        tail = data[np.maximum(ends - 1, 0)]
        tail = np.where(tail == 13, data[np.maximum(ends - 2, 0)], tail)
        f[:, 12] = np.isin(tail, np.frombuffer(b".?", np.uint8))
        f[:, 13] = _KIND[data[starts[has]]] == _UPPER
        f[0, 14] = f[-1, 15] = 1
    return Lines(len(words), int(solid.sum()), int(count[:, _SYM].sum() + count[:, _PIPE].sum()), int(again.sum()),
                 0 if rep is None else int(rep.sum()), solid, f)


@dataclass
class Field:
    """Weights of the field; label 0 is content, label 1 boilerplate."""

    weights: np.ndarray
    step: np.ndarray  # step[i, j]: from label i to label j

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The most probable label sequence."""
        if not len(features):
            return np.zeros(0, np.int8)
        score = (features @ self.weights).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, score[0], []
        for e in score[1:]:
            to_a, to_b = b + s10 > a + s00, b + s11 > a + s01
            back.append((to_a, to_b))
            a, b = (b + s10 if to_a else a + s00), (b + s11 if to_b else a + s01) + e
        label = int(b > a)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return np.array(out[::-1], np.int8)


def fit(docs: list[np.ndarray], labels: list[np.ndarray], steps: int = 120, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps; the forward and backward sums run over all documents at once."""
    t, n, k = max(map(len, docs)), len(docs), len(FEATURES)
    x, y, m = np.zeros((n, t, k)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (d, g) in enumerate(zip(docs, labels)):
        x[i, : len(d)], y[i, : len(d)], m[i, : len(d)] = d, g, True
    pairs = m[:, 1:]
    total = m.sum()
    seen_step = np.array([[(pairs & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    seen = np.einsum("nt,ntk->k", (y * m).astype(float), x)
    p = np.zeros(k + 4)
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        # forward and backward sums, scaled to 1 at each line; padding passes its values on
        w, trans = p[:k], np.exp(p[k:].reshape(2, 2))
        e = np.ones((t, n, 2))
        e[:, :, 1] = np.exp(np.clip(x @ w, -30, 30)).T
        f, b, scale = np.empty((t, n, 2)), np.ones((t, n, 2)), np.ones((t, n, 1))
        for i in range(t):
            v = e[i] if i == 0 else np.where(m[:, i, None], f[i - 1] @ trans * e[i], f[i - 1])
            scale[i] = v.sum(axis=1, keepdims=True)
            f[i] = v / scale[i]
        for i in range(t - 2, -1, -1):
            b[i] = np.where(m[:, i + 1, None], (e[i + 1] * b[i + 1]) @ trans.T / scale[i + 1], 1)
        want = (f * b)[:, :, 1].T * m
        both = np.einsum("tni,tnj->ij", f[:-1], e[1:] * b[1:] / scale[1:] * pairs.T[:, :, None]) * trans
        g = np.concatenate((seen - np.einsum("nt,ntk->k", want, x), (seen_step - both).ravel())) / total - ridge * p
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        p = p + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(p[:k], p[k:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field:
    """The field for these labels, from a sample of at most ``most`` documents."""
    rank = F.xxhash64("doc_id")
    chosen = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(rank, "doc_id").limit(most))
    rows = (docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.char_length("text").alias("chars"))
            .join(F.broadcast(chosen), "doc_id").where(F.col("chars").between(1, chars))  # `most` rows at most
            .orderBy(rank, "doc_id", "chars").limit(most).select("text", "quality").collect())
    x, good = [], []
    for text, quality in rows:
        d = read(bytes(text))
        if len(d.features):
            x.append(d.features)
            good.append(bool(quality))
    if len(set(good)) < 2:
        return Field(PRIOR.copy(), np.zeros((2, 2)))
    y = [np.full(len(d), 0 if g else 1) for d, g in zip(x, good)]
    field = fit(x, y)
    for _ in range(TRAIN_ROUNDS - 1):
        y = [np.zeros(len(d), int) if g else field.decode(d).astype(int) for d, g in zip(x, good)]
        field = fit(x, y)
    return field


def judge(text: bytes | None, field: Field, share: float = CONTENT_SHARE) -> tuple[Lines, np.ndarray, float, bool]:
    """The counts, line labels, content share and verdict of one text."""
    lines = read(text)
    labels = field.decode(lines.features)
    content = float(lines.weight[labels == 0].sum() / max(lines.weight.sum(), 1))
    return lines, labels, content, not lines.base_failed and content >= share


_RULES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, line_labels string, content_share double, kept boolean")


def rule_table(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """Per row: the base counts, one letter per line with a word (C content, B boilerplate), content share and verdict."""
    names = [x.split()[0] for x in _RULES.split(", ")]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names[1:]]
            for value in batch.column(1):
                d, labels, content, kept = judge(value.as_py(), field, share)
                row = (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed,
                       "".join("CB"[x] for x in labels), content, kept)
                for column, v in zip(out, row):
                    column.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _RULES)


def keep_good(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that pass, all columns as they came, in one pass without a shuffle."""
    where = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            kept = [judge(text, field, share)[3] for text in batch.column(where).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
