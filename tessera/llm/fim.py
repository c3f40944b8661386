"""Fill-in-the-middle transformation on seekable compressed frames (operator 11).

Method: a text is stored as independent zstandard frames of at most
``FRAME_BYTES`` each, cut between code points, together with the number of
lines and of code points that end before each frame. A cut after ``u`` lines is
found by binary search in these counts, and only the frame that holds it is
decompressed. The output is spliced: frames that lie wholly in one part are
taken over as they are, cut frames are compressed anew in two pieces, and the
sentinels are small frames of their own. Independent frames put one after the
other are a valid zstandard stream, so the output is the compressed output
text. Digests stream the frames in order; the text is rebuilt from the output
and the form alone, by looking for the sentinels across frame borders and
streaming the parts in their first order.

A document is one row with a list of frames, so no text is shuffled and no
document is spread over tasks. Beyond the cell that the scan hands over, a task
holds the compressed text of one document and one frame.

Units are lines, ``[^\\n]*\\n|[^\\n]+``. The cuts and the form come from
sha256(``seed:id``); a text that holds a sentinel, or no text, stays plain.

Defined cases: a null text is empty; a null id hashes as an empty string and
stays null; repeated rows are transformed one by one; a text without a line end
is one unit, however long; an empty table gives no rows. Only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import batches

FRAME_BYTES = 1 << 16
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

FRAMES = ("doc_id long, n long, chars long, marked boolean, frames array<binary>, lines_before array<long>, "
          "chars_before array<long>")
FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
DIGEST = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _types(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()),
             "array<long>": pa.list_(pa.int64())}
    return [(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")]


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = _types(ddl)
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _chars(piece: bytes) -> int:
    """Code points of a piece of UTF-8: the bytes that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80))


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` cut into pieces of at most ``size`` bytes (four at least), never inside a code point."""
    at = 0
    while at < len(data):
        end = min(at + max(size, 4), len(data))
        while end < len(data) and end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def compress(data: bytes, size: int = FRAME_BYTES) -> tuple[list[bytes], list[int], list[int]]:
    """The frames of a text, and before each (and at the end) the number of
    line ends and of code points."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    frames, lines, chars = [], [0], [0]
    for p in pieces(data, size):
        frames.append(pack(p))
        lines.append(lines[-1] + p.count(b"\n"))
        chars.append(chars[-1] + _chars(p))
    return frames, lines, chars


class Unpack:
    """Decompression of one frame at a time, counted."""

    def __init__(self):
        self._d = zstandard.ZstdDecompressor()
        self.opened = 0

    def __call__(self, frame: bytes) -> bytes:
        self.opened += 1
        return self._d.decompress(frame)


def locate(frames: list[bytes], lines: list[int], n: int, units: int, unpack) -> tuple[int, int]:
    """Where the first ``units`` of ``n`` units end, as (frame, byte).
    Decompresses the frame that holds the place, and no other."""
    if units <= 0:
        return 0, 0
    if units >= n:
        return len(frames), 0
    k = int(np.searchsorted(lines, units, "left")) - 1
    text, at = unpack(frames[k]), 0
    for _ in range(units - lines[k]):
        at = text.index(b"\n", at) + 1
    return k, at


def part(frames: list[bytes], begin: tuple[int, int], end: tuple[int, int], unpack) -> list[bytes]:
    """The frames of the text from ``begin`` to ``end``: whole ones as they
    are, those that are cut compressed anew."""
    out = []
    for k in range(begin[0], min(end[0] + 1, len(frames))):
        low, high = begin[1] if k == begin[0] else 0, end[1] if k == end[0] else None
        if low or high is not None:
            piece = unpack(frames[k])[low:high] if high is None or low < high else b""
            if piece:
                out.append(zstandard.ZstdCompressor(level=LEVEL).compress(piece))
        else:
            out.append(frames[k])
    return out


def draw(seed: int, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the hex digest, as unsigned integers."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12)]


def splice(row: dict, seed: int, fim_percent: int, spm_percent: int, unpack) -> tuple:
    """The row of FORMED for a row of FRAMES."""
    h1, h2, h3, h4 = draw(seed, row["doc_id"])
    n, frames, lines = row["n"], row["frames"], row["lines_before"]
    if not n or row["marked"] or h3 % 100 >= fim_percent:
        return row["doc_id"], n, "plain", None, None, frames
    cuts = [locate(frames, lines, n, u, unpack) for u in sorted((h1 % (n + 1), h2 % (n + 1)))]
    chars = [row["chars_before"][k] + (_chars(unpack(frames[k])[:at]) if at else 0) for k, at in cuts]
    prefix, middle, suffix = (part(frames, a, b, unpack) for a, b in (((0, 0), cuts[0]), tuple(cuts), (cuts[1], (len(frames), 0))))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    p, s, m = (zstandard.ZstdCompressor(level=LEVEL).compress(x) for x in (PREFIX, SUFFIX, MIDDLE))
    out = [s, *suffix, p, *prefix, m, *middle] if form == "spm" else [p, *prefix, s, *suffix, m, *middle]
    return row["doc_id"], n, form, chars[0], chars[1] - chars[0], out


def find(frames: list[bytes], mark: bytes, start: tuple[int, int], unpack) -> tuple[int, int]:
    """The (frame, byte) behind the first ``mark`` at or after ``start``, seen across frame borders."""
    k, at = start
    tail = b""
    while k < len(frames):
        text = unpack(frames[k])[at:]
        hit = (tail + text).find(mark)
        if hit >= 0:
            return k, at + hit - len(tail) + len(mark)
        tail, k, at = (tail + text)[-(len(mark) - 1):], k + 1, 0
    raise ValueError("the output lacks a sentinel")


def stream(frames: list[bytes], begin: tuple[int, int], end: tuple[int, int], drop: int, unpack) -> Iterator[bytes]:
    """The text from ``begin`` to ``end`` without its last ``drop`` bytes, a frame at a time."""
    held = b""
    for k in range(begin[0], min(end[0] + 1, len(frames))):
        text = unpack(frames[k])
        held += text[begin[1] if k == begin[0] else 0:end[1] if k == end[0] else len(text)]
        if len(held) > drop:
            yield held[:len(held) - drop]
            held = held[len(held) - drop:]


def restore(frames: list[bytes], form: str, unpack) -> Iterator[bytes]:
    """The first text, a frame at a time, from the output and its form alone."""
    last = (len(frames), 0)
    if form == "plain":
        yield from stream(frames, (0, 0), last, 0, unpack)
        return
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    a = find(frames, marks[0], (0, 0), unpack)
    b = find(frames, marks[1], a, unpack)
    c = find(frames, marks[2], b, unpack)
    first, second, third = (a, b, len(marks[1])), (b, c, len(marks[2])), (c, last, 0)
    for part in ((second, third, first) if form == "spm" else (first, third, second)):
        yield from stream(frames, *part, unpack)


def _store(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = text.as_py()
                frames, lines, chars = compress(data, size)
                rows.append((doc_id, lines[-1] + (bool(data) and not data.endswith(b"\n")), chars[-1],
                             any(m in data for m in (PREFIX, SUFFIX, MIDDLE)), frames, lines, chars))
            yield _batch(FRAMES, rows)
    return run


def store_frames(docs: DataFrame, frame_bytes: int = FRAME_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts of ``docs`` as a table of frames in the shared folder (FRAMES)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                    F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return stored(d.mapInArrow(_store(frame_bytes), FRAMES), "frames")


def fill_in_middle(frames: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """The transformed documents (FORMED): ``output`` is the output text as
    zstandard frames, to be read one after the other (``output_text``)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Unpack()
        for b in batches(it, 4 << 20):
            yield _batch(FORMED, [splice(r, seed, fim_percent, spm_percent, unpack) for r in b.to_pylist()])
    return frames.mapInArrow(run, FORMED)


def output_text(formed: DataFrame) -> DataFrame:
    """``doc_id, form, text``: the outputs decompressed, for texts that fit one cell."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Unpack()
        for b in batches(it, 1 << 20):
            yield _batch("doc_id long, form string, text string",
                         [(d, form, b"".join(map(unpack, out)).decode()) for d, form, out in zip(*(c.to_pylist() for c in b.columns))])
    return formed.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, form string, text string")


def _sha(parts) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest()


def digest_outputs(formed: DataFrame) -> DataFrame:
    """Digests of the output and of the text rebuilt from it (DIGEST)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = Unpack()
        for b in batches(it, 4 << 20):
            yield _batch(DIGEST, [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"],
                                   _sha(map(unpack, r["output"])), _sha(restore(r["output"], r["form"], unpack)))
                                  for r in b.to_pylist()])
    return formed.mapInArrow(run, DIGEST)
