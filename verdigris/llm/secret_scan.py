"""Secret scan over a trigram inverted index.

Each rule's regex is parsed, and a Boolean query over trigrams is derived from
it: a trigram that every match must hold is mandatory (AND), branches of an
alternative give an OR. Trigrams are of bytes with A-Z lower-cased, so one
index serves rules with and without case. Documents are indexed in blocks: a
block's index maps the trigrams that the rules ask for to the documents of the
block that hold them. A rule's postings are intersected and united as its
query says, and only the documents that are left are searched with the regex
and checked. A rule without a mandatory trigram (a run of hex digits) scans
all documents of the block.

Blocks are slices of a task's rows of about ``BLOCK`` bytes, so memory is
bounded and no text is shuffled; a text larger than that is a block of its own.

Base rules: assign, access, hex; further rules: github, google, slack, jwt,
private_key. Positions count code points. Defined results: a null text is
empty; rows are read one by one, so repeated rows share a result; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4 << 20
#: Sets of more strings than this are no longer followed by the derivation.
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    valid: Callable[[re.Match], bool] = lambda m: True


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs of 16 and more are the runs [0-9a-f]+ that pass
)
RULES = BASE + (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)

# A query is ("all",), ("tri", t), ("and", queries) or ("or", queries).
ALL = ("all",)


def _and(queries) -> tuple:
    parts = {q for q in queries if q != ALL}
    return ALL if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def _or(queries) -> tuple:
    parts = set(queries)
    return ALL if ALL in parts else parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _grams(s: bytes) -> tuple:
    return _and(("tri", s[i : i + 3]) for i in range(len(s) - 2))


def _chars(items) -> set[bytes] | None:
    """Lower-cased one-character strings of a class, None if there are too many or it is negated."""
    out: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower().encode() if value < 128 else chr(value).encode())
        elif kind is op.RANGE and value[1] < 128 and value[1] - value[0] < MOST_STRINGS:
            out |= {chr(c).lower().encode() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_STRINGS // 4 else None


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query that every match of ``pattern`` satisfies."""

    def walk(seq) -> tuple[tuple, set[bytes] | None]:
        """Query that holds for the sequence, and its exact strings if these are few."""
        query, now = ALL, {b""}

        def close():
            nonlocal query, now
            query, now = _and([query, _or(_grams(s) for s in now)]), {b""}

        whole = True
        for kind, value in seq:
            if kind is op.LITERAL:
                q, strings = ALL, _chars([(kind, value)])
            elif kind is op.IN:
                q, strings = ALL, _chars(value)
            elif kind is op.SUBPATTERN:
                q, strings = walk(value[3])
            elif kind is op.BRANCH:
                parts = [walk(x) for x in value[1]]
                strings = None if any(s is None for _, s in parts) else set().union(*(s for _, s in parts))
                q = _or(x for x, _ in parts)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
                least, most, inner = value
                q, strings = walk(inner)
                if least == 0:
                    q, strings = ALL, strings | {b""} if strings is not None and most == 1 else None
                elif (least, most) != (1, 1):
                    strings = {s * least for s in strings} if strings is not None and least == most and least < 4 else None
            else:  # assertions, any character, back references: nothing is asked for
                q, strings = ALL, {b""} if kind is op.AT else None
            query = _and([query, q]) if strings is None else query
            if strings is None:
                close()
                whole = False
                continue
            joined = {a + b for a in now for b in strings}
            if len(joined) > MOST_STRINGS:
                close()
                whole, joined = False, set(strings)
            now = joined
        strings = now
        close()
        return query, strings if whole else None

    return walk(parser.parse(pattern, re.ASCII))[0]


def _wanted(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*map(_wanted, query[1])) if len(query) > 1 else set()


class Index:
    """Trigram -> sorted numbers of a block's texts that hold it, for the trigrams asked for."""

    def __init__(self, texts: list[bytes], wanted: list[bytes]):
        data = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0", np.uint8).astype(np.uint32)
        gram = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        asked = np.zeros(1 << 24, bool)
        codes = np.array(sorted(int.from_bytes(t, "big") for t in wanted), np.uint32)
        asked[codes] = True
        at = np.flatnonzero(asked[gram])
        ends = np.cumsum([len(t) + 2 for t in texts])
        self.count = len(texts)
        pairs = np.unique(gram[at].astype(np.int64) << 32 | np.searchsorted(ends, at, "right"))
        edges = np.searchsorted(pairs >> 32, np.append(codes, 1 << 24))
        self.postings = {int(c): pairs[a:b] & 0xFFFFFFFF for c, a, b in zip(codes, edges, edges[1:])}

    def search(self, query: tuple) -> np.ndarray:
        if query == ALL:
            return np.arange(self.count)
        if query[0] == "tri":
            return self.postings[int.from_bytes(query[1], "big")]
        parts = sorted((self.search(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id and spans (array of kind, start, end; by start, then kind as listed)."""
    ready = [(i, r.name, re.compile(r.pattern.encode(), 0), r.valid, trigram_query(r.pattern)) for i, r in enumerate(rules)]
    wanted = sorted(set().union(*(_wanted(r[4]) for r in ready)))

    def scan(texts: list[bytes]) -> list[list[dict]]:
        found: list[list[tuple]] = [[] for _ in texts]
        index = Index(texts, wanted)
        for i, name, pattern, valid, query in ready:
            for n in index.search(query).tolist():
                for m in pattern.finditer(texts[n]):
                    if valid(m):
                        found[n].append((m.start(), i, m.end(), name))
        out = []
        for text, spans in zip(texts, found):
            row, at, points = [], 0, 0
            for start, _, end, name in sorted(spans):  # starts ascend: code points are counted on from the last one
                points, at = points + len(text[at:start].decode("utf-8", "replace")), start
                row.append({"kind": name, "start": points, "end": points + len(text[start:end].decode("utf-8", "replace"))})
            out.append(row)
        return out

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, texts, size = [], [], 0
            for value in batch.column(1):
                texts.append(value.as_py() or b"")
                size += len(texts[-1])
                if size >= block:
                    spans += scan(texts)
                    texts, size = [], 0
            spans += scan(texts) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
            .mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>"))
