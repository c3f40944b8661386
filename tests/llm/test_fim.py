"""Operator 11: cuts, splices and digests against whole-text brute force."""

import hashlib
import random
import re

import pytest
import zstandard

from tessera.llm import fim
from tessera.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, form string, output string, n long, frames string"


def brute(doc_id, text):
    """The contract on whole strings."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def texts():
    rng = random.Random(3)
    fixed = [None, "", "\n", "\n\n\n", "a", "a\n", "é\n😀", "x<P>y\nz", "<S>", "a<M", "<\nP>\n<", "<P\n>", "no line end " * 50,
             "l\n" * 400, "é" * 999 + "\n" + "😀" * 300, "\r\n a\r\n", "\x00\n\x00"]
    made = ["".join(rng.choice("ab<>PSM\né😀 ") for _ in range(rng.randrange(1, 300))) for _ in range(120)]
    return fixed + made


@pytest.mark.parametrize("size", [5, 64, 1 << 16])
def test_fill_in_middle_equals_brute_force(spark, size):
    rows = [(i, t, "f", "o", 1, "x") for i, t in enumerate(texts())] + [(3, "a\nb", None, None, None, None)] * 2 + [
        (None, "x\ny\nz", "", "", 0, ""), (None, None, "", "", 0, ""), (-5, "m\nn", "", "", 0, "")]
    formed = fim.fill_in_middle(fim.store_frames(spark.createDataFrame(rows, SCHEMA), size))
    got = sorted(map(str, map(tuple, fim.digest_outputs(formed).collect())))
    assert got == sorted(str(brute(i, t)) for i, t, *_ in rows)
    for r in fim.output_text(formed).collect():
        assert len(r.text) >= 9 or r.form == "plain"


def test_forms_and_percentages(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    frames = fim.store_frames(docs)
    count = lambda **k: {r["form"]: r["count"] for r in fim.fill_in_middle(frames, **k).groupBy("form").count().collect()}
    assert set(count()) == {"spm", "psm"} and min(count().values()) > 150
    assert count(fim_percent=0) == {"plain": 400}
    assert 100 < count(fim_percent=50)["plain"] < 300
    assert count(spm_percent=100) == {"spm": 400}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digest_outputs(fim.fill_in_middle(fim.store_frames(docs))).count() == 0


def test_only_cut_frames_are_opened_and_the_rest_taken_over():
    text = "".join(f"line {i}\n" for i in range(50_000)).encode()
    frames, lines, chars = fim.compress(text, 4096)
    assert len(frames) > 100
    row = {"doc_id": 1, "n": lines[-1], "marked": False, "frames": frames, "lines_before": lines, "chars_before": chars}
    unpack = fim.Unpack()
    out = fim.splice(row, 7, 100, 50, unpack)[5]
    assert unpack.opened <= 10
    assert len(set(frames) & set(out)) >= len(set(frames)) - 2
    assert zstandard.ZstdDecompressor().stream_reader(b"".join(out), read_across_frames=True).read() == b"".join(map(unpack, out))
    assert b"".join(fim.restore(out, fim.splice(row, 7, 100, 50, unpack)[2], unpack)) == text


def test_very_long_text(spark):
    text = "é" * 3_000_000 + "\n" + "word\n" * 400_000
    docs = spark.createDataFrame([(8, text), (9, "x" * 2_000_000)], "doc_id long, text string")
    got = fim.digest_outputs(fim.fill_in_middle(fim.store_frames(docs))).collect()
    assert sorted(map(tuple, got)) == sorted([brute(8, text), brute(9, "x" * 2_000_000)])


def test_query_takes_whole_texts(spark):
    from conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op11_fill_in_middle"](spark, SF_SMALL).collect()))
    assert got == sorted(brute(*r) for r in docs)
