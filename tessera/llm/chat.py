"""Chat formatting with offset-aligned loss masks (operator 9).

Method: the turns of a conversation are rendered into one string, the string
is encoded once with offsets, and the sorted spans of the assistant texts are
intersected with the sorted token spans by binary search. A token is under the
loss if it overlaps such a span; of a token that reaches over a span's edge
only the part inside counts, so the masked text is exactly the texts.

Template: ``<|role|>\\n`` text ``<|endoftext|>`` for each turn. Inside texts a
backslash is put after the bracket of anything that looks like a control
string of this or another common template (``<|``, ``</s>``, ``[INST]``,
``<<SYS>>``), whatever number of backslashes already stands there, so taking
one away restores the text. Roles are percent-encoded.

Rows are range-partitioned by (conversation, turn) and read as a sorted
stream, so no conversation is gathered: a long one is rendered and encoded in
blocks of whole turns, ``BLOCK_CHARS`` or so each. That is the same as encoding
it at once, because the end marker is a special token, at which the tokenizer
always cuts.

Defined cases: null texts and roles are empty strings; rows without a
conversation id are one conversation without id; equal turn numbers are
ordered by role, then text; an empty table gives no blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BLOCK_CHARS = 1 << 17
END = "<|endoftext|>"

# What follows the bracket in control strings of common templates.
_CONTROL = r"(?:\||/?s>|/?INST\]|/?SYS>>)"
_ESCAPE = re.compile(r"([<\[])(?=\\*" + _CONTROL + ")")
_UNESCAPE = re.compile(r"([<\[])\\(?=\\*" + _CONTROL + ")")
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|endoftext\|>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted string of (role, text) turns, and the spans of their texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{quote(role, safe='')}|>\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unquote(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def loss_mask(begin: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Token mask, and the text under it as merged ranges, from token offsets
    (both ascending) and the sorted spans that carry loss."""
    mask, under = np.zeros(len(begin), bool), []
    for a, b in spans:
        lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(begin, b, "left")
        mask[lo:hi] = True
        for s, e in zip(np.maximum(begin[lo:hi], a).tolist(), np.minimum(end[lo:hi], b).tolist()):
            if under and s <= under[-1][1]:
                under[-1] = (under[-1][0], max(e, under[-1][1]))
            elif s < e:
                under.append((s, e))
    return mask, under


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


FORMATTED = "conv_id long, block long, text string, ids array<int>, loss array<boolean>, loss_spans array<array<int>>"


def _format(vocabulary: str, loss_role: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(vocabulary)
        number, conv, turns, size = 0, None, [], 0

        def encode():
            text, spans = render(turns)
            e = tok.encode(text, add_special_tokens=False)
            o = np.array(e.offsets, np.int64).reshape(-1, 2)
            mask, under = loss_mask(o[:, 0], np.maximum.accumulate(o[:, 1]) if len(o) else o[:, 1],
                                    [(a, b) for a, b, role in spans if role == loss_role and a < b])
            return (conv, base + number, text, e.ids, mask, [list(s) for s in under])

        def batch(rows):
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()),
                     pa.list_(pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)],
                                              names=[f.split()[0] for f in FORMATTED.split(", ")])

        rows, base = [], 0
        for b in it:
            for part, c, role, text in zip(*(x.to_pylist() for x in b.columns)):
                base = part << 33
                if turns and (c != conv or size >= BLOCK_CHARS):
                    rows.append(encode())
                    number, turns, size = number + 1, [], 0
                conv = c
                turns.append((role, text))
                size += len(text)
            if rows:
                yield batch(rows)
                rows = []
        if turns:
            yield batch([encode()])
    return run


def format_conversations(rows: DataFrame, vocabulary: str = VOCABULARY, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, block, text, ids, loss, loss_spans`` of ``rows (conv_id,
    turn, role, text)``: the blocks of each conversation in order."""
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = r.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)
    tagged = ranged.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "role", "text")
    return stored(tagged.mapInArrow(_format(vocabulary, loss_role), FORMATTED), "formatted")


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_tokens long, n_loss_tokens long")


def _read_back(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None

    def close():
        conv, n, turns, chars, loss, total, tokens, masked = state
        return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, tokens, masked)

    for b in it:
        done = []
        for conv, text, spans, tokens, masked in zip(*(x.to_pylist() for x in b.columns)):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(close())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, t in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{t}\n".encode("utf-8", "surrogatepass"))
            for a, e in spans:
                t = unescape(text[a:e])
                state[3] += len(t)
                state[4].update(t.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
            state[6] += tokens
            state[7] += masked
        yield _digests(done)
    if state is not None:
        yield _digests([close()])


def _digests(rows) -> pa.RecordBatch:
    kinds = [f.split() for f in DIGEST.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), pa.string() if k == "string" else pa.int64()) for c, (_, k) in zip(cols, kinds)],
        names=[n for n, _ in kinds])


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the blocks alone. Digests run
    over a conversation's blocks in order, as a sorted stream."""
    f = formatted.select("conv_id", "block", "text", "loss_spans", F.size("ids").cast("long").alias("n"),
                         F.size(F.filter("loss", lambda x: x)).cast("long").alias("m"))
    sorted_ = f.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return sorted_.select("conv_id", "text", "loss_spans", "n", "m").mapInArrow(_read_back, DIGEST)
