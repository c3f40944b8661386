"""Operator 12 against dictionaries of whole sequences, and its encoding."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long, path string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))
    name = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda e: (e[0] is not None, e[0] or 0, name(e[1], e[2])))] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(str((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                       hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k)).encode()).hexdigest()))
                  for k, m in members.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA)


def conversations(seed, n, most, alphabet):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", rng.choice(alphabet)))
    return rows


CASES = {
    "mixed": conversations(1, 150, 9, ["a", "bé", "", "ccc"]) + [(-7, 0, "user", "a"), (-5, 1, None, None), (None, 0, "user", "x"),
                                                               (None, None, None, None)],
    "copies": [(c, t, "user", f"turn {t}") for c in range(60) for t in range(6)] + [(c, 0, "user", "turn 0") for c in range(100, 140)],
    "ties": [(c, t, r, x) for c in range(20) for t in (None, None, 1, 1) for r, x in (("user", "b"), ("user", "a"), (None, "a"))],
    "single": [(3, 0, "user", "only")],
    "long": [(c, t, "user", f"{t % 3}") for c in (0, 1, 5, 6) for t in range(300)] + [(5, 400, "user", "end")],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("shard_paths", [3, 100_000])
def test_trie_equals_brute_force(spark, monkeypatch, case, shard_paths):
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "RUN_IDS", 3)
    got = trie.conversation_trie(frame(spark, CASES[case]), shard_paths)
    assert got.columns == COLUMNS
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(CASES[case])


def test_empty_table(spark):
    assert trie.conversation_trie(frame(spark, [])).count() == 0
    assert trie.conversation_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 8, 256])
def test_findclose_equals_a_stack(block):
    rng = random.Random(block)
    for n in (1, 2, 5, 40, 500):
        bits, depth = [], 0
        while len(bits) < 2 * n:
            left = 2 * n - len(bits)
            up = depth == 0 or (depth < left and rng.random() < 0.55)
            bits.append(int(up))
            depth += 1 if up else -1
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        p = trie.Parens(np.array(bits, np.uint8), block)
        assert {i: p.findclose(i) for i in want} == want
    deep = trie.Parens(np.array([1] * 5000 + [0] * 5000, np.uint8), block)
    assert [deep.findclose(i) for i in (0, 17, 4999)] == [9999, 9982, 5000]
