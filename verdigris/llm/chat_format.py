"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string: each turn between ``<s>`` and
``</s>``, a system or user text between markers of its own, an assistant text
bare, any other role named between role markers. Control strings inside texts
and roles are escaped: a backslash becomes two, and one is put after the first
character of each control string, so none can be read in a text and the
original comes back exactly.

The string is encoded once, with the offsets of its tokens. The control
strings are tokens of their own, so no token spans a marker and a text. The
sorted spans of assistant texts are met with the sorted token spans by binary
search, which gives the loss mask; ``masked_text`` reads it back from tokens
and string alone (a character split over several tokens counts once).

Turns come sorted to one task per conversation, by a shuffle on the
conversation's id, and are read as a stream; one conversation at a time is in
memory, as its string is encoded as a whole.

Defined results: a null text or role is empty; bytes that are no UTF-8 read as
U+FFFD; turns order by turn (null
first), then role and text, repeated rows are turns of their own; a null
conversation id is a conversation; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

OPEN, CLOSE = "<s>", "</s>"
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]")}
ROLE = ("[ROLE]", "[/ROLE]")
CONTROL = (OPEN, CLOSE, *MARKS["system"], *MARKS["user"], *ROLE)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string and the (start, end) of each assistant text in it."""
    out, at, spans = [], 0, []

    def put(s: str) -> None:
        nonlocal at
        out.append(s)
        at += len(s)

    for role, text in turns:
        put(OPEN)
        if role in MARKS:
            put(MARKS[role][0] + escape(text) + MARKS[role][1])
        elif role == "assistant":
            body = escape(text)
            spans.append((at, at + len(body)))
            put(body)
        else:
            put(ROLE[0] + escape(role) + ROLE[1] + escape(text))
        put(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered string; no text holds a control string, so the markers alone cut it."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        body = part.removeprefix(OPEN)
        for role, (a, b) in MARKS.items():
            if body.startswith(a):
                turns.append((role, unescape(body[len(a) : -len(b)])))
                break
        else:
            if body.startswith(ROLE[0]):
                role, _, text = body[len(ROLE[0]) :].partition(ROLE[1])
                turns.append((unescape(role), unescape(text)))
            else:
                turns.append(("assistant", unescape(body)))
    return turns


def encoder(vocabulary: str | None = None):
    from tokenizers import AddedToken, Tokenizer

    if vocabulary is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    else:
        path = os.path.join(vocabulary, "byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.add_tokens([AddedToken(c, normalized=False, special=False) for c in CONTROL])
    tok.encode_special_tokens = True  # a vocabulary's own special strings are ordinary text here
    return tok


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of the sorted token spans lie in the sorted assistant spans."""
    mask = np.zeros(len(offsets), bool)
    if not spans:
        return mask
    s = np.array(spans)
    first = np.searchsorted(offsets[:, 1], s[:, 0], "right")  # first token that ends after the span begins
    last = np.searchsorted(offsets[:, 0], s[:, 1], "left")  # first token that begins at its end or later
    for a, b in zip(first, last):
        mask[a:b] = True
    return mask


def masked_text(formatted: str, starts, ends, mask) -> str:
    """The text under a loss mask, unescaped turn by turn and joined."""
    out, run, at = [], [], 0
    for start, end, on in zip(starts, ends, mask):
        if on:
            run.append(formatted[max(start, at) : end])
            at = max(at, end)
        elif run:
            out.append(unescape("".join(run)))
            run = []
    if run:
        out.append(unescape("".join(run)))
    return "".join(out)


_OUT = "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_chats(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per conversation: the string, its tokens with offsets, and the loss mask of each token."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]

    def run(batches):
        tok = encoder(vocabulary)

        def done(conv, turns):
            formatted, spans = render(turns)
            got = tok.encode(formatted, add_special_tokens=False)
            offsets = np.array(got.offsets, np.int32).reshape(-1, 2)
            return conv, formatted, got.ids, offsets[:, 0], offsets[:, 1], loss_mask(offsets, spans)

        def batch_of(ready):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), kinds)], names=names)

        conv, turns, ready, size = None, [], [], 0
        for batch in batches:
            for c, role, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), texts_of(batch.column(2))):
                if turns and c != conv:
                    ready.append(done(conv, turns))
                    size += len(ready[-1][1])
                    turns = []
                    if size > 2 << 20:
                        yield batch_of(ready)
                        ready, size = [], 0
                conv = c
                turns.append((role or "", text or ""))
        if turns:
            ready.append(done(conv, turns))
        if ready:
            yield batch_of(ready)

    return (rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(run, _OUT))


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and loss text of formatted conversations, from their strings, tokens and masks alone."""
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        import hashlib

        hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out = []
            for conv, formatted, starts, ends, mask in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse(formatted)
                loss = masked_text(formatted, starts, ends, mask)
                out.append((conv, len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexed(loss), len(formatted)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return chats.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(run, _READ)
