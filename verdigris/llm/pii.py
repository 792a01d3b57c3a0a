"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, schemes, words
that announce an identifier, and the shortest digit forms that an address, a
card or a phone number must hold (a dot between digits, neighbouring digits, a
plus before a digit). Each anchor is expanded to the boundary of its kind and
a local parser reads and validates the span there. Kinds, in order: email, ip,
card, phone (the base rules), then url and account.

A base rule takes leftmost, non-overlapping spans of its pattern and drops
those that fail validation. Expansion gives the same spans: an anchor lies in
every match, each kind's characters left of the anchor lead back to the
leftmost start, and the next anchor of the kind inside a taken span is passed
over.

Positions count code points. Defined results: a null text is empty; bytes that
are no UTF-8 count as U+FFFD; rows are
read one by one, so repeated rows share a result; texts of any length are read
whole; an empty table gives an empty result; further columns of the input are
ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CHAIN = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|]+")
_ACCOUNT = re.compile(r"[^A-Za-z0-9\n]{0,3}(?:(?:no|nr|number)[.:# ]{1,3})?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}|[0-9][0-9 -]{5,24}[0-9])(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    auto, d = ahocorasick.Automaton(), "0123456789"
    forms = [("email", "@")] + [("ip", f"{a}.{b}") for a in d for b in d] + [("phone", f"+{a}") for a in d]
    forms += [("card", f"{a}{sep}{b}") for a in d for b in d for sep in ("", " ", "-")]
    forms += [("url", s) for s in SCHEMES]
    forms += [("account", x) for c in CUES for x in {c, c.upper(), c.capitalize()}]
    for kind, form in forms:
        auto.add_word(form, (KINDS.index(kind), len(form)))
    auto.make_automaton()
    return auto


def _back(text: str, at: int, floor: int, chars: frozenset) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def _chain_start(text: str, at: int, floor: int) -> int:
    """Start of the digits, each after one blank or dash at most, that lead to the digit at ``at``."""
    while at > floor:
        if text[at - 1] in _DIGITS:
            at -= 1
        elif at - 1 > floor and text[at - 1] in " -" and text[at - 2] in _DIGITS:
            at -= 2
        else:
            break
    return at


def spans(text: str, auto: ahocorasick.Automaton) -> list[list[tuple[int, int]]]:
    """(start, end) of each kind."""
    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    done = [0] * len(KINDS)  # where the kind's last span ended, valid or not
    for last, (kind, size) in auto.iter(text):
        at = last - size + 1
        if at < done[kind]:
            continue
        if kind == 0:
            m = _DOMAIN.match(text, at)
            start = _back(text, at, done[0], _LOCAL) if m else at
            if start < at:
                out[0].append((start, m.end()))
                done[0] = m.end()
        elif kind == 1:
            m = _QUAD.match(text, _back(text, at, done[1], _DIGITS))
            if m:
                done[1] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out[1].append(m.span())
        elif kind == 2:
            m = _CHAIN.match(text, _chain_start(text, at, done[2]))
            done[2] = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
        elif kind == 3:
            m = _PHONE.match(text, at)
            if m:
                done[3] = m.end()
                if 8 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    out[3].append(m.span())
        elif kind == 4:
            m = _URL.match(text, last + 1)
            if m:
                end = last + 1 + len(m.group().rstrip(".,;:!?)"))
                done[4] = m.end()
                if end > last + 1:
                    out[4].append((at, end))
        elif not (at and text[at - 1].isalnum()):
            m = _ACCOUNT.match(text, last + 1)
            if m:
                done[5] = m.end()
                code = re.sub("[ -]", "", m.group(1))
                if not code[0].isalpha() or 15 <= len(code) <= 34 and iban(code):
                    out[5].append(m.span(1))
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and spans (array of kind, start, end; by kind, then start)."""

    def run(batches):
        auto = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = []
            for text in texts_of(batch.column(1)):
                found.append([{"kind": k, "start": s, "end": e} for k, of in zip(KINDS, spans(text, auto)) for s, e in of]
                             if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>"))


