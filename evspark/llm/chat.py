"""Conversations as training text with token-aligned loss masks (operator 6).

A conversation is rendered whole and encoded once with offsets. A token trains if its span meets an assistant turn's
span; the turns' spans are sorted, so a binary search finds the one that a token can meet. The exact characters under the
mask are the intersections, so a token that reaches over a turn's edge adds nothing from outside.

Control strings inside texts and roles get a backslash behind their first character, one more if they have some
already; reading back takes one away. So no text can close its turn or make a special token, and nothing is lost.

Definitions: rows are ordered by turn, then role and text; null turns come first. A null text or role is
empty. Roles other than user, system and assistant are written out. Rows with a null conv_id are one conversation.
Equal rows all stay. An empty table gives no rows. A conversation is one output row and is held whole by one task. Texts of any
length stay whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, END_OF_TEXT = "<s>", "<|endoftext|>"
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[OUT]", "</s>")}
ROLE, ROLE_TEXT, ROLE_END = "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROL = [START, END_OF_TEXT, ROLE, ROLE_TEXT, ROLE_END, *(m for pair in MARKS.values() for m in pair)]

_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROL))
_OPEN = re.compile(rf"([<\[])(\\*(?:{_REST}))")
_ESCAPED = re.compile(rf"([<\[])\\(\\*(?:{_REST}))")
_TURN = re.compile("|".join([*(f"(?P<{r}>{re.escape(a)}(?P<{r}_text>.*?){re.escape(b)})" for r, (a, b) in MARKS.items()), f"{re.escape(ROLE)}(?P<role>.*?){re.escape(ROLE_TEXT)}(?P<text>.*?){re.escape(ROLE_END)}"]), re.DOTALL)


def escape(text: str) -> str:
    return _OPEN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and where its assistant texts stand in it."""
    parts, at, spans = [START], len(START), []
    for role, text in turns:
        before, after = MARKS[role] if role in MARKS else (ROLE + escape(role) + ROLE_TEXT, ROLE_END)
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    out = []
    for m in _TURN.finditer(formatted, len(START)):
        role = next((r for r in MARKS if m[r] is not None), None)
        out.append((role, unescape(m[f"{role}_text"])) if role else (unescape(m["role"]), unescape(m["text"])))
    return out


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Whether each token trains, and the character ranges under the mask, sorted and united within a turn."""
    if not offsets or not spans:
        return np.zeros(len(offsets), bool), []
    token = np.array(offsets, np.int64)
    span = np.array(spans, np.int64)
    # characters that no token claims belong to the next one; a character of several tokens counts once
    ends = np.maximum.accumulate(token[:, 1])
    starts = np.minimum(token[:, 0], np.r_[0, ends[:-1]])
    trains = np.zeros(len(token), bool)
    ranges: list[tuple[int, int]] = []
    first = np.searchsorted(span[:, 1], starts, side="right")
    last = np.searchsorted(span[:, 0], ends, side="left")
    for t in np.flatnonzero(first < last):
        for a, b in span[first[t] : last[t]].tolist():
            a, b = max(a, int(starts[t])), min(b, int(ends[t]))
            if a < b:
                trains[t] = True
                if ranges and a <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
                else:
                    ranges.append((a, b))
    return trains, ranges


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, formatted (text), ids, trains (per token), loss (character ranges) of every conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("trains", pa.list_(pa.bool_())), ("loss", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [render(list(zip(r, t, strict=True))) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                encoded = library.encode_batch([text for text, _ in made], add_special_tokens=False)
                masks = [mask(e.offsets, spans) for e, (_, spans) in zip(encoded, made, strict=True)]
                loss = [[{"start": a, "stop": b} for a, b in ranges] for _, ranges in masks]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in made]), pa.array([e.ids for e in encoded], schema.field(2).type), pa.array([m.tolist() for m, _ in masks], schema.field(3).type), pa.array(loss, schema.field(4).type)], schema=schema)

    return grouped.mapInArrow(run, "conv_id long, formatted string, ids array<int>, trains array<boolean>, loss array<struct<start:long,stop:long>>")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold, read from their text and masks alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = parse(text)
                loss = "".join(unescape(text[r["start"] : r["stop"]]) for r in row["loss"])
                out.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, DIGESTS)
