"""Operators over ``documents``: brute force, edge cases, defined results."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, linedup, minmax, packing, pii, toxicity

LONG = " ".join(f"w{i}" for i in range(30_000))
DOC = "doc_id long, text string, lang string, n_words long, _found long, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, 8, len(t) if t is not None else None) for i, t in rows], DOC)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (None, "a null id with five words"),
        (6, "one two three"), (6, "one two three"), (7, "Ünïcode ßtraße 中文 words here now"), (8, "x" * 5000)]

#: the same with other ids
APART = [(None if i is None else i + 70_000, t) for i, t in EDGE]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


# --- operator 1 ---------------------------------------------------------------------------------

def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_contamination(text, items):
    w = plain_words(text)
    hit, found = [False] * len(w), set()
    for item_id, item in items:
        iw = plain_words(item)
        k = min(13, len(iw))
        for j in range(len(iw) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i:i + k] == iw[j:j + k]:
                    found.add(item_id)
                    hit[i:i + k] = [True] * k
    ids = sorted(map(str, found))
    return len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


@pytest.mark.parametrize("block,sets", [(decontam.BLOCK_BYTES, 50_000), (60, 50_000), (60, 0)])
def test_contamination_equals_brute_force(spark, monkeypatch, block, sets):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "SMALL_SETS", sets)
    words = [f"q{i % 17}" for i in range(40)]
    items = [(1, " ".join(words[:20])), (2, "Alpha beta"), (3, None), (4, "..."), (5, " ".join(words[3:25])), (2, "gamma delta x")]
    rows = [(10, "zz " + " ".join(words) + " end"), (11, "alpha, BETA alpha beta"), (12, " ".join(words[:12])),
            (13, " ".join(words[5:18]) + " filler" * 300), (10, "zz " + " ".join(words) + " end"), *EDGE]
    got = decontam.contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *brute_contamination(t, items)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    for r in got:
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    assert next(r.longest_match for r in got if r.doc_id == 13) >= 13


def test_longest_matches_equal_brute_force(spark):
    """Random items over few words: every document's longest match, its places, and shared beginnings."""
    r = np.random.default_rng(21)
    say = lambda n: " ".join(f"v{k}" for k in r.integers(0, 3, n))
    shared = say(15)
    items = [(k, f"{shared} {say(r.integers(0, 12))}") for k in range(12)] + [(50 + k, say(r.integers(1, 30))) for k in range(8)]
    rows = [(k, f"{say(r.integers(0, 20))} {shared} {say(10)} {items[k % 20][1]} {say(4)}") for k in range(25)] + [(90, say(60)), (91, "")]
    found = decontam.find_matches(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    text, item = {i: plain_words(t) for i, t in rows}, {str(i): plain_words(t) for i, t in items}
    for row in found.collect():
        w, best = text[row.doc_id], 0
        for i in range(len(w)):
            for x in item.values():
                for j in range(len(x)):
                    n = 0
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    best = max(best, n if n >= min(13, len(x)) else 0)
        assert max((m.n_words for m in row.found.matches), default=0) == best
        for m in row.found.matches:
            assert w[m.doc_start:m.doc_start + m.n_words] == item[m.item_id][m.item_start:m.item_start + m.n_words]


def test_shared_prompts_stay_flat():
    """2,000 items and 20,000 documents with one prompt: a row per document, not per pair."""
    import time
    prompt = " ".join(f"p{k}" for k in range(13))
    items = decontam.TestItems([(k, f"{prompt} tail{k} more{k}".encode()) for k in range(2000)])
    docs = [f"{prompt} own{k % 100}".encode() for k in range(20_000)]
    t = time.time()
    _, runs, classes, begins = decontam.search_shard(docs, items)
    assert time.time() - t < 30
    assert len(runs) == len(classes) == len(begins[0]) == 20_000
    assert len(items.ids_of(classes[:1, 1])) == 2000


def test_passes_judge_rows_not_ids(spark, monkeypatch):
    """Different texts under one id, or without an id, are judged one by one when the benchmark takes several passes."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 30)
    items = [(1, "alpha beta gamma"), (2, "delta epsilon zeta"), (3, "one two three four"), (4, "red green blue")]
    texts = ["so alpha beta gamma here", "delta epsilon zeta", "quite clean " * 40, None, "a one two three four b red green blue",
             "quite clean " * 40]
    rows = [(i, t) for i in (7, None) for t in texts]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert len(decontam._blocks(bench)) > 1
    got = decontam.contamination(docs, bench).collect()
    want = sorted((str(i), *brute_contamination(t, items)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    kept = decontam.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted(
        (str(i), t or "") for i, t in rows if t in (None, texts[2]))


def test_decontamination_passes_columns_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    docs = docs_of(spark, [(1, "alpha beta"), (2, "clean"), *EDGE[:3]])
    out = decontam.remove_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 2, 3]
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs, bench.limit(0)).collect())


def test_suffix_array_sorts_suffixes():
    r = np.random.default_rng(1)
    for _ in range(50):
        t = r.integers(0, 4, r.integers(1, 60)).astype(np.int32)
        order = decontam.suffix_array(t, 64)
        assert [t[i:].tolist() for i in order] == sorted((t[i:].tolist() for i in range(len(t))))


# --- operator 3 ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def toxic_corpus(spark):
    r = np.random.default_rng(5)
    base = ["the", "house", "river", "walks", "green", "stone", "quickly", "over", "and", "under", "stupid", "moron"]
    rows, labels = [], []
    for i in range(900):
        w = [base[k] for k in r.integers(0, 10, 30)]
        y = int(i % 3 == 0)
        if y:
            w[r.integers(0, 30)] = base[10 + i % 2]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity_holds_out_and_restores(spark, toxic_corpus):
    docs, labels, rows = toxic_corpus
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.7)
    held = [i for i, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.98
    cost = toxicity.trigram_costs(docs)
    restore = toxicity.Restorer(cost)
    assert restore("a stup1d m0ron") == "a stupid moron"
    assert restore("s t u p i d") == "stupid"
    assert restore("stuuuupid m-o-r-o-n") == "stupid moron"
    assert restore("The House, walks.") == "the house, walks."


def test_disguised_words_are_found_alone():
    """Each form in the middle of a text that has no other span."""
    for form in ("m.0.r.0.n", "k.1.l.l", "i-d-1-o-t", "m o r o n", "m-o-r-o-n", "d13", "hat3", "a$$", "@$$", "stup1d", "1diot",
                 "1d10t", "@ss", "f!sh", "stüüüpid", "stuuupid", "bébééé", "a.1.a.1.a", "m.0.r.0.n!"):
        for before, after in (("the house ", " walks over"), ("the house, (", ") walks"), ("", " walks"), ("ünder ", "")):
            text = before + form + after
            spans = toxicity.suspicious_spans(text)
            assert [text[s:e] for s, e in spans] == [form.rstrip("!")] or text[slice(*spans[0])] == form and len(spans) == 1, text
    for text in ("The House, walks. Oh! Yes!! $100 and 100$ at $$ or 2024", "a cat, I said - so be it"):
        assert toxicity.suspicious_spans(text) == []


def test_apart_guard_is_a_superset():
    r = np.random.default_rng(4)
    for _ in range(20_000):
        kind = bytes(r.choice(list(b"a12 .,"), r.integers(1, 12)).astype(np.uint8))
        if toxicity._APART.search(kind):
            assert toxicity._THREE in b".%b" % kind.translate(toxicity._PLACES)


def test_toxicity_edges(spark, toxic_corpus):
    docs, labels, _ = toxic_corpus
    out = toxicity.score_documents(docs_of(spark, EDGE), labels).collect()
    assert len(out) == len(EDGE) and all(r.score is not None for r in out)
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    none = toxicity.score_documents(docs, labels.limit(0)).select("score").distinct().count()
    assert none == 1
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and 590 <= kept.count() <= 610


def test_viterbi_reads_lattices_exactly():
    """Against all readings of a short lattice."""
    from itertools import product

    cost = np.random.default_rng(2).random((64, 64, 64)).astype(np.float32) * 5
    for span in ("s1l0", "a@a", "b u t", "ooo1"):
        places = toxicity.lattice(span)

        def price(choice):
            x = y = 0
            total = sum(p for _, p in choice)
            for ch in "".join(c for c, _ in choice):
                z = int(toxicity.CLASSES[min(ord(ch), 0x250)])
                total += float(cost[x, y, z])
                x, y = y, z
            return total + float(cost[x, y, 0])

        best = min(product(*places), key=price)
        got = toxicity.viterbi(places, cost)
        assert got == "".join(c for c, _ in best)


# --- operator 5 ---------------------------------------------------------------------------------

def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows, percent):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("block", [256, 8])
def test_minmax_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minmax, "BLOCK", block)
    r = np.random.default_rng(9)
    rows = []
    for g in range(6):
        words = [f"t{g}_{k}" for k in range(120)]
        for c in range(25):
            w = list(words)
            for k in r.integers(0, 120, r.integers(0, 5)):
                w[k] = f"n{r.integers(1 << 30)}"
            rows.append((len(rows) + 100, " ".join(w).upper() if c == 3 else " ".join(w)))
    rows += [(9000, "a b c"), (9001, "A  b\nc"), (9002, "a b d"), (9003, None), (9004, "")]
    got = {x.doc_id: x for x in minmax.link_documents(docs_of(spark, rows), 85).collect()}
    want = brute_groups(rows, 85)
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (i == x.component_id) for i, x in got.items())


def test_minmax_edges(spark):
    out = minmax.link_documents(docs_of(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    by = {r.doc_id: r for r in out}
    assert by[5].component_id == 4 and not by[5].kept and by[4].kept
    assert by[None].component_id is None and by[None].kept
    assert by[1].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert minmax.link_documents(docs_of(spark, EDGE).limit(0)).count() == 0


def test_min_max_estimate_is_unbiased():
    r = np.random.default_rng(4)
    agree = []
    for _ in range(60):
        both, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (140, 30, 30))
        x, y = minmax.signature(np.concatenate([both, a])), minmax.signature(np.concatenate([both, b]))
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 0.7) < 0.02


# --- operator 6 ---------------------------------------------------------------------------------

def check_packing(rows, docs_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.VOCABULARY)
    texts = {}
    for i, t in docs_rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        texts.setdefault(i, []).append(ids)
    pieces = {}
    for r in rows:
        ids = texts[r.doc_id][0]
        assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, copies in texts.items():
        want = [(k, s, n) for k, (s, n) in enumerate(packing.pieces_of(len(copies[0])))]
        assert sorted(pieces[i]) == sorted(want * len(copies))
        assert all(n == 2048 for k, s, n in want if k > 0)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 120)
    r = np.random.default_rng(6)
    rows = [(1000 + i, " ".join(f"tok{k}" for k in r.integers(0, 999, r.integers(1, 700)))) for i in range(200)]
    rows += [*EDGE, (50, "a <|endoftext|> b"), (51, "emoji 😀   and ͸ unassigned \x00\x1f")]
    got = packing.pack_documents(docs_of(spark, rows)).collect()
    n = check_packing(got, rows)
    lengths = np.array([x.length for x in got])
    assert n >= packing.lower_bound(lengths)
    assert n <= packing.lower_bound(lengths) + 4
    assert packing.pack_documents(docs_of(spark, rows).limit(0)).count() == 0


def test_certificates_of_partitions(spark, monkeypatch):
    """Counts and bounds by partition and turn add up to the sequences in use."""
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    monkeypatch.setattr(packing, "MOST_TASKS", 3)
    r = np.random.default_rng(2)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(r.integers(1, 2048, 400))], "uid long, length long").cache()
    proofs = packing.certificates(pieces).collect()
    used = packing.place(pieces).select("sequence_id").distinct().count()
    assert all(p.bound <= p.bins and 0 <= p.exchanged <= p.bins for p in proofs)
    assert sum(p.bins - p.exchanged for p in proofs) == used
    assert len({p.part for p in proofs if p.turn == 0}) == 8
    assert packing.certificates(pieces.limit(0)).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    rows = [(1, "a b c"), (2, None), (3, LONG)]
    out = packing.packed_sequences(docs_of(spark, rows)).collect()
    assert all(len(r.ids) <= 2048 for r in out)
    assert sum(len(r.ids) for r in out) == sum(len(packing.Encoder.of()(t)) + 1 for _, t in rows)


def test_bound_never_exceeds_the_optimum():
    from itertools import combinations

    def optimum(items):
        if not items:
            return 0
        first, rest = items[0], items[1:]
        best = len(items)
        for k in range(len(rest) + 1):
            for c in combinations(range(len(rest)), k):
                if first + sum(rest[i] for i in c) <= 20:
                    best = min(best, 1 + optimum([x for i, x in enumerate(rest) if i not in c]))
        return best

    r = np.random.default_rng(8)
    for _ in range(60):
        items = sorted(r.integers(1, 21, r.integers(1, 8)).tolist(), reverse=True)
        a = np.array(items)
        assert packing.lower_bound(a, 20) <= optimum(items) <= len(packing.best_fit_decreasing(a, 20)[2])


# --- operator 8 ---------------------------------------------------------------------------------

def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_edit_distance():
    r = np.random.default_rng(3)
    for _ in range(4000):
        a = "".join(r.choice(list("abc"), r.integers(0, 14)))
        b = list(a)
        for _ in range(r.integers(0, 5)):
            k, at = r.integers(3), int(r.integers(0, len(b) + 1))
            if k == 0:
                b.insert(at, "abc"[r.integers(3)])
            elif b and k == 1:
                b.pop(min(at, len(b) - 1))
            elif b:
                b[min(at, len(b) - 1)] = "abc"[r.integers(3)]
        b = "".join(b)
        for e in (1, 2, 3):
            assert linedup.within(a, b, e) == (edit_distance(a, b) <= e), (a, b, e)


def line_rows():
    r = np.random.default_rng(12)
    rows = []
    for i in range(60):
        lines = []
        for k in range(4):
            g = int(r.integers(0, 12))
            line = f"line number {g} has some words that repeat {g * 7919}"
            for _ in range(r.integers(0, 3)):
                at = int(r.integers(0, len(line)))
                line = line[:at] + "xyz"[r.integers(3)] + line[at + r.integers(0, 2):]
            lines.append(line)
        short = ["short", "ab", "café 1", "cafe 12"][r.integers(4)]
        rows.append((i, "\n".join([*lines, short, "short", ["", "x", "word 17", "words 71"][r.integers(4)]])))
    return rows


@pytest.mark.parametrize("small,block", [(12, 256), (1, 7)])
def test_line_classes_equal_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(linedup, "SMALL", small)
    monkeypatch.setattr(linedup, "BLOCK", block)
    rows = line_rows()
    lines = {(i, k): x.strip(" ") for i, t in rows for k, x in enumerate(t.split("\n"))}
    texts = sorted({x for x in lines.values() if x})
    root, links = {x: x for x in texts}, dict.fromkeys(texts, 0)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[k + 1:]:
            if min(len(a), len(b)) >= linedup.MIN_CHARS and abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    first = {}
    for key in sorted(lines):
        if lines[key] in root:
            first.setdefault(top(lines[key]), key)
    got = {(r.doc_id, r.line): r for r in linedup.classify_lines(docs_of(spark, rows)).collect()}
    assert set(got) == set(lines)
    for key, x in lines.items():
        f = first[top(x)] if x in root else key
        r = got[key]
        assert (r.first_doc_id, r.first_line, r.n_links, r.kept) == (*f, links.get(x, 0), f == key)


def test_lines_without_blanks_take_part(spark):
    """Short lines, other scripts, tabs, NBSP and addresses: by code points, not by blanks."""
    passage = "这是一个很长的段落没有任何空格重复出现在每一个文档里面" * 20
    same = ["All rights reserved.", passage, "ชื่อบริษัทจำกัดสงวนลิขสิทธิ์", "one\ttwo\tthree\tfour\tfive", "a\u00a0b\u00a0c\u00a0d\u00a0e\u00a0f\u00a0ghi jklm",
            "https://example.org/a/very/long/path", "Page up"]
    rows = [(k, "\n".join([f"{'abcd'[k]}" * 40, *same])) for k in range(3)]
    rows.append((3, "\n".join(["z" * 40, "All rights reservd", passage[:70] + passage[72:], *same[2:]])))
    got = {(r.doc_id, r.line): r for r in linedup.classify_lines(docs_of(spark, rows)).collect()}
    assert len(got) == 4 * 8
    for (doc, line), r in got.items():
        linked = line in (1, 2)
        assert (r.first_doc_id, r.first_line) == ((0, line) if line else (doc, 0))
        assert r.kept == (doc == 0 or line == 0) and r.n_links == (1 if linked else 0)
    left = {r.doc_id: r.text for r in linedup.remove_repeated_lines(docs_of(spark, rows)).collect()}
    assert left == {0: rows[0][1], 1: "b" * 40 + "\nPage up", 2: "c" * 40 + "\nPage up",
                    3: "z" * 40 + "\nAll rights reservd\nPage up"}  # 18 code points are left


def test_lines_with_one_common_beginning(spark):
    """A segment that 10,000 unrelated lines share: seconds, not the square of the group in Python."""
    import time
    r = np.random.default_rng(2)
    rows = [(i, "the same beginning of every line, some 40 characters " + "".join(chr(97 + c) for c in r.integers(0, 26, 40)))
            for i in range(10_000)]
    rows += [(20_000 + i, rows[i][1][:-1] + "#") for i in range(50)]
    t = time.time()
    got = {x.doc_id: x for x in linedup.classify_lines(docs_of(spark, rows)).collect()}
    assert time.time() - t < 150
    assert all(got[20_000 + i].first_doc_id == i and got[i].n_links == 1 for i in range(50))
    assert sum(x.kept for x in got.values()) == 10_000


def test_stages_with_clashing_names(spark):
    """Helper columns clash with no column of the input, in any case."""
    texts = [(1, "a line of some words that is long enough"), (2, "a line of some words that is long enough"), (3, None)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2.0, "r", 3, "k") for i, t in texts],
                                 "doc_id long, text string, _FOUND int, _Score string, _gone double, _Doc string, _REST int, _gone_ string")
    bench = spark.createDataFrame([("b", "nothing of this kind stands anywhere")], "item_id string, text string")
    kept = decontam.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 3
    left = linedup.remove_repeated_lines(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 4)], "doc_id long, quality int, toxic int")
    scored = toxicity.remove_toxic(docs, lab)
    assert scored.columns == docs.columns and scored.count() <= 3


def test_repeated_lines_go(spark):
    a, b, c = "the first line of many words", "the second line of many words", "something else with a few words"
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{c}\nok"), (3, f"{b[:-1]}\n{a}"), (4, f"ok\n{c}"), *APART]
    docs = docs_of(spark, rows)
    out = linedup.remove_repeated_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == f"{a}\n{b}" and got[2].text == f"{c}\nok" and 3 not in got and got[4].text == "ok"
    assert got[2].n_chars == len(got[2].text)
    assert got[None].text and got[2].lang == "en" and got[1].n_words == 7
    assert linedup.remove_repeated_lines(docs.limit(0)).count() == 0


# --- operator 10 --------------------------------------------------------------------------------

def test_base_spans_equal_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = np.random.default_rng(2)
    for _ in range(5000):
        t = "".join(r.choice(list("a.@-1% +é"), r.integers(0, 18)))
        assert [m.span() for m in email.finditer(t)] == pii.emails(t)
    t = "mail a.b@c.org, 10.0.0.1 or 300.1.1.1, 4111 1111 1111 1111, 4111111111111112, +1 (555) 123-4567 +12"
    assert [(t[s:e], pii.KINDS[k]) for s, k, e in pii.base_spans(t)] == [
        ("a.b@c.org", "email"), ("10.0.0.1", "ip"), ("4111 1111 1111 1111", "card"), ("+1 (555) 123-4567", "phone")]
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_gradients_match_differences():
    r = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in pii.new_weights(4, 5).items()}
    chars, tags = r.integers(0, pii.N_CHAR, (3, 6)), r.integers(0, pii.TAGS, (6, 3))

    def loss():
        e, _ = pii.emissions(w, chars)
        return pii.crf_gradient(e.astype(np.float64), w["T"], tags)[0]

    e, (x, h, sf, sb) = pii.emissions(w, chars, keep=True)
    _, de, dt = pii.crf_gradient(e.astype(np.float64), w["T"], tags)
    dh = de @ w["O"].T
    dx, dw, du, db = pii._lstm_back(dh[:, :, :5], x, w["Wf"], w["Uf"], sf)
    for name, g, at in (("T", dt, (1, 2)), ("Wf", dw, (2, 7)), ("Uf", du, (3, 4)), ("Bf", db, (6,)),
                        ("O", h.reshape(-1, 10).T @ de.reshape(-1, pii.TAGS), (4, 3))):
        old = w[name][at]
        w[name][at] = old + 1e-3
        up = loss()
        w[name][at] = old - 1e-3
        down = loss()
        w[name][at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 2e-3, name


@pytest.fixture(scope="module")
def private_docs(spark):
    r = np.random.default_rng(3)
    words = "the river walks under green stones and over a quiet house with many old doors".split()
    rows = []
    for i in range(400):
        w = [words[k] for k in r.integers(0, len(words), 40)]
        kind = i % 5
        if kind < 4:
            w[r.integers(5, 35)] = [f"{words[r.integers(8)]}.{r.integers(99)}@mail{r.integers(9)}.example.com",
                                    ".".join(str(r.integers(256)) for _ in range(4)), "4111111111111111",
                                    f"+1 ({r.integers(200, 999)}) 555-{r.integers(1000, 9999)}"][kind]
        rows.append((i, " ".join(w)))
    return rows


def test_personal_data(spark, private_docs):
    rows = [*private_docs, *APART, (900, "please call (415) 555-2671 before the river walks over the house"),
            (901, "host 10[.]23[.]4[.]77 under green stones by the house")]
    got = pii.find_personal_data(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        base = pii.base_spans(text[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == q for _, k, _ in base) for q in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert set(joined.split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added
    by = {r.doc_id: r for r in got}
    assert "phone" in by[900].spans and by[901].spans == "ip:5:21"
    clean = [r.n_added for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(clean) == 0
    assert pii.find_personal_data(docs_of(spark, rows).limit(0)).count() == 0


def test_windows_cover_every_cue():
    t = "x" * 500 + " 12 " + "y" * 300 + " a@b " + "z" * 40
    for m in re.finditer(r"[0-9@]", t):
        assert any(s <= max(0, m.start() - 20) and min(len(t), m.start() + 20) <= s + pii.WIDTH for s in pii.windows_of(t))


def test_windows_hold_every_disguised_form():
    """All forms of an address, without digits, at all places of the grid: plausible, and whole inside a window."""
    names = ["jane.doe@example.org", "firstname.lastname@department.university.edu"]
    ats = [" at ", " (at) ", "[at]", " [at] ", "(at)", " AT ", " @ "]
    dots = [".", " dot ", " (dot) ", "[dot]", "[.]", "(dot)", " DOT ", " . ", " [dot] "]
    for form in (n.replace("@", a).replace(".", d) for n in names for a in ats for d in dots):
        assert pii.plausible(0, form) and len(form) <= pii.LONGEST
        for offset in range(200, 200 + pii.STRIDE):
            t = ("word " * 60)[:offset - 1] + " " + form + " and more words" * 20
            assert any(w < offset and offset + len(form) < w + pii.WIDTH for w in pii.windows_of(t)), (form, offset)
    assert pii.windows_of("plain words of water. The data dotted") == []


def test_sample_holds_different_windows(spark, private_docs, monkeypatch):
    """A text that most rows hold is one window of the sample, and its copies are sampled each by itself."""
    hot = private_docs[0][1]
    docs = docs_of(spark, [*private_docs, *((1000 + i, hot) for i in range(2000))])
    seen = []
    monkeypatch.setattr(pii, "training_windows", lambda windows: (seen.append(windows), None))
    monkeypatch.setattr(pii, "train", lambda *_: None)
    pii.fit(docs)
    windows = [(t, tuple(spans)) for t, spans in seen[0]]
    assert len(windows) == len(set(windows)) > 300


def test_base_patterns_equal_the_contract():
    """All four kinds against the stated patterns on random texts."""
    rules = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                     r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def plain(text):
        out = []
        for kind, rule in enumerate(rules):
            for m in rule.finditer(text):
                d = [int(c) for c in m.group() if c in "0123456789"]
                luhn = sum(x * (1 + i % 2) - 9 * (x * (1 + i % 2) > 9) for i, x in enumerate(reversed(d))) % 10 == 0
                if [True, all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else True,
                        12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15][kind]:
                    out.append((m.start(), kind, m.end()))
        return sorted(out)

    r = np.random.default_rng(8)
    alphabets = ["0123456789.", "01 -+().", "4111 1-", "a@.b0", "25.+@ a-()", "٣1.2"]
    for _ in range(6000):
        letters = alphabets[r.integers(len(alphabets))]
        t = "".join(letters[k] for k in r.integers(0, len(letters), r.integers(0, 45)))
        assert pii.base_spans(t) == plain(t), t
    zeros = "0" * 45 + "1.2.3.4"
    assert pii.base_spans(zeros) == [(0, 1, len(zeros))] == plain(zeros)


@pytest.mark.parametrize("unit", ["1", "1.", "1 ", "+1 (", "a@", "@a.", "(", "( ", "at ", "1a"])
def test_long_texts_take_linear_time(unit):
    import time
    t = time.time()
    pii.base_spans(unit * (1_000_000 // len(unit)))
    assert time.time() - t < 4


def test_sample_share_of_huge_corpora(spark):
    """The share is never 0: of a corpus of 10^11 rows as many are taken as of a small one."""
    docs = spark.range(4_000_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert 15 <= pii.sample_of(docs, 4 * 10 ** 9 // 1).count() <= 27
    some = pii.sample_of(docs, 10 ** 11)._jdf.queryExecution().optimizedPlan().toString()
    assert "2.0E-7" in some
    assert pii.sample_of(docs.limit(100), 100).count() == 100


def test_viterbi_equals_all_paths():
    from itertools import product
    r = np.random.default_rng(4)
    for _ in range(20):
        e, trans = r.normal(size=(4, 2, 3)), r.normal(size=(3, 3))
        got = pii.viterbi(e, trans)
        for n in range(2):
            best = max(product(range(3), repeat=4), key=lambda p: sum(e[i, n, k] for i, k in enumerate(p)) + sum(
                trans[a, b] for a, b in zip(p, p[1:])))
            assert tuple(got[:, n]) == best


def test_recall_of_disguised_spans(spark):
    """Disguised spans planted into the given documents: how many the model
    finds; figures are in the README."""
    from conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    weights = pii.fit(docs)
    r = np.random.default_rng(12)
    clean = [t for _, t in docs.orderBy("doc_id").collect() if t and not pii.base_spans(t) and 200 < len(t) < 4000][:240]
    rows, planted = [], []
    for i, text in enumerate(clean):
        kind = i % 4
        span = [f"{['kim', 'jo.lee', 'a_smith'][r.integers(3)]}@{['host', 'mail'][r.integers(2)]}.{['org', 'com'][r.integers(2)]}",
                ".".join(str(r.integers(256)) for _ in range(4)), ["4111111111111111", "5500005555555559"][r.integers(2)],
                f"+1{r.integers(200, 999)}555{r.integers(1000, 9999)}"][kind]
        form = pii.disguise(kind, span, r, re.findall("[a-z]{3,8}", text))
        at = text.find(" ", r.integers(0, len(text) - 100))
        rows.append((i, f"{text[:at]} {form} {text[at:]}"))
        planted.append((at + 1, kind, at + 1 + len(form)))
    assert pii.base_spans(" ".join(f for _, f in rows[:0])) == []
    hit = [0] * 4
    for row in pii.find_personal_data(docs_of(spark, rows), weights).collect():
        s, k, e = planted[row.doc_id]
        spans = [x.split(":") for x in row.spans.split(",") if x]
        hit[k] += any(x[0] == pii.KINDS[k] and int(x[1]) < e and int(x[2]) > s for x in spans)
    print("recall", {pii.KINDS[k]: hit[k] / 60 for k in range(4)})
    assert sum(hit) >= 0.85 * len(rows), hit


# --- the pipeline -------------------------------------------------------------------------------

def test_pipeline_stages(spark, toxic_corpus, tmp_path):
    import corpus_pipeline

    docs, labels, rows = toxic_corpus
    docs.union(docs_of(spark, EDGE)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = str(tmp_path)
    now = spark.read.parquet(os.path.join(base, "documents.parquet"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, base)
        assert now.columns == columns, name
        now.write.parquet(os.path.join(base, name))
        now = spark.read.parquet(os.path.join(base, name))
    kept = {r.doc_id: r.text for r in now.collect()}
    packed = corpus_pipeline.run(spark, base).collect()
    assert {r.doc_id for r in packed} == set(kept)
    texts = dict(rows)
    assert all("moron" not in (t or "") for t in kept.values())
    assert sum(i in kept for i in texts if i % 3) >= 590
