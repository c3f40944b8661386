"""Operators over pages, vectors and conversations."""

import hashlib
import re

import numpy as np
import pytest

from tessera.llm import chat, flatgraph, warc, wrapper
from tessera.session import scratch_path

PAGE = "page_id long, url string, html string, text string, payload binary"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "other", b"x") for i, u, h in rows], PAGE)


# --- operator 2 ---------------------------------------------------------------------------------

def warc_rows():
    big = "é" * 80 + "content"
    return [(5, "http://a/x", big), (3, "http://a/y z", big), (9, None, big), (4, "u", None), (6, "u", ""), (7, "u", "short"),
            (8, "u", "short"), (None, "n", big), (10, "u\r\nX: y", "z" * 300_000), (3, "http://a/y z", big)]


def test_warc_round_trip(spark):
    rows = warc_rows()
    got = warc.round_trip(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i not in (None, 3, 10)
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
                                            for r in got)
    assert warc.round_trip(pages_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("size", [7, 100, 5000])
def test_ranges_own_each_record_once(spark, monkeypatch, size):
    folder = scratch_path(spark, "warc-test")
    rows = [(i, f"http://h/{i}", "<p>" + "ab" * (i * 37 % 500) + "\x1f\x8b\x08" * (i % 3)) for i in range(40)]
    manifest = warc.write_warc(pages_of(spark, rows), folder)
    monkeypatch.setattr(warc, "RANGE_BYTES", size)
    got = warc.read_warc(manifest, folder).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"} == {
        (i, h) for i, _, h in rows if i == next(j for j, _, g in rows if g == h or len(h.encode()) < 100 and j == i)}
    assert len(got) == len(rows)
    assert all(r.payload_digest == r.stated_digest for r in got if r.record_type == "response")


def test_reader_is_split_over_tasks(spark, monkeypatch):
    """As many tasks as ranges, although descriptors are a few bytes; the same records beyond the digest limit."""
    monkeypatch.setattr(warc, "RANGE_BYTES", 3000)
    rows = [(i, f"http://h/{i % 50}", "".join(map(str, np.random.default_rng(i % 50).integers(0, 10, 2000)))) for i in range(100)]
    results = []
    for limit in (200_000, 0):
        monkeypatch.setattr(warc, "SMALL_DIGESTS", limit)
        folder = scratch_path(spark, "warc-split")
        manifest = warc.write_warc(pages_of(spark, rows), folder)
        records = warc.read_warc(manifest, folder).cache()
        ranges = sum(-(-r.bytes // 3000) for r in manifest.collect())
        assert records.rdd.getNumPartitions() == ranges > 10
        assert records.filter("page_id is null or not well_formed").count() == 0
        results.append(sorted((r.page_id, r.record_type, r.refers_to, r.payload_digest) for r in warc.resolve_revisits(records).collect()))
    assert results[0] == results[1] and sum(r[1] == "revisit" for r in results[0]) == 50


def test_foreign_records_do_not_end_the_job():
    for length in (b"x", b"", b"-5", b"99999999999999999999", b"400"):
        record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + length + b"\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
        headers, payload, sound = warc.parse_record(record)
        assert payload == b"body" and not sound and headers["warc-type"] == "response"


def test_reader_skips_false_magic_and_broken_members():
    good = warc.record_bytes(1, "u", b"data", "d", None, "1970-01-01T00:00:00Z")
    import gzip

    other = gzip.compress(b"not a record")
    blob = b"\x1f\x8b\x08junk" + good + other + good[:-4] + b"\x1f\x8b" + good
    read = lambda at, n: blob[at:at + n]
    found = list(warc.records_from(read, 0, len(blob)))
    assert len(found) >= 2 and all(warc.parse_record(r)[1] == b"data" for r in found)


# --- operator 7 ---------------------------------------------------------------------------------

def page(k, title, paragraphs, extra="", tail="</article><footer>foot {k} &copy;</footer></body></html>"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var t=\"</p>\";</script></head><body><nav><ul>"
            f"<li><a href='/{k}'>menu {k}</a></li></ul></nav><!-- c --><div class=\"ad\">buy {k}</div>{extra}<article><h1>{title}"
            f"</h1>{body}" + tail.format(k=k))


def test_wrapper_extracts_the_article(spark):
    rows, want = [], {}
    for k in range(12):
        paragraphs = [f"Para {k} a&amp;b  <b>bold</b>\n text &lt;tag&gt;", "Same on every page."] * (1 + k % 3)
        rows.append((k, "http://H.example/p", page(k, f"Title {k}", paragraphs)))
        want[k] = "\n\n".join([f"Title {k}", *[f"Para {k} a&b bold text <tag>", "Same on every page."] * (1 + k % 3)])
    comments = "<div id='comments-7'><p>first!</p></div><form>q <input></form><aside>side</aside>"
    rows.append((20, "http://h.example/q", page(20, "T", ["x"], extra=comments)))
    want[20] = "T\n\nx"
    rows.append((21, "http://h.example/q", page(21, "T", ["cut"], tail="<p>open paragraph <b>without end &amp; <foot")))
    want[21] = "T\n\ncut\n\nopen paragraph without end &"
    rows += [(22, None, None), (23, "x", ""), (24, None, "plain text"), (0, "http://H.example/p", rows[0][2])]
    want |= {22: "", 23: "", 24: "plain text"}
    got = wrapper.extract_text(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id], r.page_id
        assert r.n_chars == len(r.text)
    assert wrapper.extract_text(pages_of(spark, rows).limit(0)).count() == 0


def test_constant_slots_are_template(spark):
    """Without semantic elements the template shows by what never changes."""
    rows = [(k, "http://plain/", f"<html><body><div>Welcome to our site</div><div class=body><p>story {k}</p></div>"
             f"<table><tr><td>All rights reserved</td></tr></table></body></html>") for k in range(8)]
    got = wrapper.extract_text(pages_of(spark, rows)).collect()
    assert {r.page_id: r.text for r in got} == {k: f"story {k}" for k in range(8)}


def test_hosts_may_mix_templates(spark):
    """One page with an article does not empty the div-based pages of its host."""
    rows = [(k, url, f"<html><body><div class=top>site {k}</div><div class=body><p>story {k}</p></div></body></html>")
            for url, start in (("http://mixed/", 0), (None, 10)) for k in range(start, start + 8)]
    rows += [(30, "http://mixed/", page(30, "T", ["x"])), (31, "no host", page(31, "U", ["y"], extra="<div>beside</div>"))]
    got = {r.page_id: r.text for r in wrapper.extract_text(pages_of(spark, rows)).collect()}
    want = {k: f"site {k}\n\nstory {k}" for k, _, _ in rows[:16]}
    assert got == want | {30: "T\n\nx", 31: "U\n\ny"}


def test_slots_of_few_pages_are_no_template(spark):
    """A block that one page in eight has, or a small part of a host's pages, says nothing about the template."""
    frame = "<html><body><div>Welcome</div><div class=body><p>story {}</p>{}</div></body></html>"
    few = {3: ("<blockquote>said once</blockquote>", "said once"), 5: ("<pre>x = 1</pre>", "x = 1")}
    rows = [(k, "http://few/", frame.format(k, few.get(k, ("",))[0])) for k in range(8)]
    rows += [(100 + k, "http://many/", frame.format(k, "<h4>See below</h4>" if k < 6 else "")) for k in range(40)]
    got = {r.page_id: r.text for r in wrapper.extract_text(pages_of(spark, rows)).collect()}
    want = {k: f"story {k}" + (f"\n\n{few[k][1]}" if k in few else "") for k in range(8)}
    want |= {100 + k: f"story {k}" + ("\n\nSee below" if k < 6 else "") for k in range(40)}
    assert got == want


@pytest.mark.parametrize("names", ["has-sidebar", "right-sidebar no-footer", "legal-news", "search-engine-review", "sidebar", ""])
def test_names_on_ancestors_of_the_content_drop_nothing(spark, names):
    rows = [(k, "http://a/", f"<html class='{names}'><body class='{names}'><article class='{names}'><p>story {k}</p></article></body></html>")
            for k in range(6)]
    rows += [(10 + k, "http://b/", f"<body class='{names}'><div class='{names}'><p>a long story about {k}</p></div></body>") for k in range(6)]
    rows += [(20 + k, "http://c/", f"<body><div class='{names}'><article><p>story {k}</p></article></div></body>") for k in range(6)]
    got = {r.page_id: r.text for r in wrapper.extract_text(pages_of(spark, rows)).collect()}
    want = {k: f"story {k}" for k in (*range(6),)} | {20 + k: f"story {k}" for k in range(6)}
    assert got == want | {10 + k: f"a long story about {k}" for k in range(6)}


def test_named_parts_beside_the_content_go(spark):
    rows = [(k, "http://a/", f"<body><div class='story'><p>{'long text ' * 20}{k}</p></div><div class='right-sidebar'>now {k}</div>"
             f"<div class='comments'><p>first! {k}</p></div></body>") for k in range(6)]
    rows += [(10 + k, "http://b/", f"<article><p>{'long text ' * 20}{k}</p><div id='comments-{k}'>I agree {k}</div></article>") for k in range(6)]
    got = {r.page_id: r.text for r in wrapper.extract_text(pages_of(spark, rows)).collect()}
    assert got == {i + k: "long text " * 20 + str(k) for i in (0, 10) for k in range(6)}


def test_hostile_pages(spark):
    """Deep nesting, unclosed tags and stray quotes: linear time, nothing lost but the open tag."""
    import time
    deep = "<div>" * 1500
    rows = [(k, "http://deep/", f"<body>{deep}story {k}{'</div>' * 1500}</body>") for k in range(6)]
    rows += [(10, "http://deep/", "<section><div>" * 700 + "mixed"), (11, "x", "<p title=don't>kept</p><p>too</p>"),
             (12, "x2", "<a <b> text"), (13, "x3", "a < b and c <> d <"), (14, "x4", "<p>İ<script>if (a</b) x</script>after"),
             (15, "x5", "<p a=\"x>y\" b='>'>in</p>"), (16, "x6", "<!-- open <p>gone")]
    got = {r.page_id: r.text for r in wrapper.extract_text(pages_of(spark, rows)).collect()}
    want = {k: f"story {k}" for k in range(6)} | {10: "mixed", 11: "kept\n\ntoo", 12: "text", 13: "a < b and c <> d", 14: "İafter",
                                                  15: "in", 16: ""}
    assert got == want
    for bad in ("<a " * 300_000, "<p>" * 100_000, "<foo>" * 50_000 + "<p></p>" * 50_000, "<b>" * 100_000 + "x<br>" * 50_000,
                "<a b=\"" * 100_000, "</x>" * 100_000, "<script>" * 50_000, "<" * 300_000, "&" * 100_000, "<!-" * 100_000):
        t = time.time()
        wrapper.page_blocks(bad)
        assert time.time() - t < 5, bad[:20]


def test_equals_brute_force_on_pages(spark):
    """A plain extractor with xml.etree-like recursion over the given pages' articles."""
    from conftest import SF_SMALL
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.on, self.skip, self.blocks, self.now = 0, 0, [], []

        def cut(self):
            text = " ".join("".join(self.now).split())
            if text and self.on:
                self.blocks.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in wrapper.RAW or tag in wrapper.NOT_TEXT:
                self.skip += tag not in wrapper.VOID
            if tag == "br":
                self.now.append(" ")
            elif tag not in wrapper.INLINE:
                self.cut()
            self.on += tag == "article"

        def handle_endtag(self, tag):
            if tag not in wrapper.INLINE and tag != "br":
                self.cut()
            self.on -= tag == "article"
            if tag in wrapper.RAW or tag in wrapper.NOT_TEXT:
                self.skip -= tag not in wrapper.VOID

        def handle_data(self, data):
            if not self.skip:
                self.now.append(data)

    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.extract_text(pages).collect()}
    same = 0
    for r in pages.collect():
        a = Article()
        a.feed(r.html or "")
        a.close()
        a.cut()
        same += got[r.page_id] == "\n\n".join(a.blocks)
    assert same == len(got)


def test_tree_matching_aligns_renamed_nodes():
    a = wrapper.fold(["html/body/div.x/p", "html/body/section/h2", "html/body/section/p"])
    b = wrapper.fold(["html/body/nav/a", "html/body/div.y/p", "html/body/section/p"])
    score, pairs = wrapper.match_trees(a, b)
    assert ("html/body/div.x/p", "html/body/div.y/p") in pairs and ("html/body/section/p", "html/body/section/p") in pairs
    assert score > 5


# --- operator 4 ---------------------------------------------------------------------------------

def check_vectors(rows, got):
    usable = {i: np.array(x, float) for i, x in rows if i is not None and x is not None
              and all(v is not None and np.isfinite(v) for v in x) and any(x)}
    links = {i: [] for i in usable}
    for i, x in usable.items():
        for j, y in usable.items():
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[i].append(j)
    comp = {i: i for i in usable}
    changed = True
    while changed:
        changed = False
        for i in usable:
            low = min([comp[i], *(comp[j] for j in links[i])])
            if low < comp[i]:
                comp[i], changed = low, True
    for r in got:
        i = r.vec_id
        assert (r.n_links, r.component_id) == ((len(links[i]), comp[i]) if i in usable else (0, i)), i
        assert r.kept == (i is None or i == r.component_id)


@pytest.mark.parametrize("cap", [1024, 20])
def test_graph_finds_all_links(spark, monkeypatch, cap):
    monkeypatch.setattr(flatgraph, "CAP", cap)
    monkeypatch.setattr(flatgraph, "SHARD_ROWS", 40)
    r = np.random.default_rng(5)
    centres = r.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + r.normal(size=16) * (0.1 if i % 2 else 0.02)).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [1.0, 2.0]),
             (2005, [2.0, 4.0]), (2006, []), (None, rows[3][1]), (2007, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(i, x, 1, 0) for i, x in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = flatgraph.link_vectors(df).collect()
    assert len(got) == len(rows)
    check_vectors(rows, got)
    assert flatgraph.link_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_scale(spark):
    """Cosine does not depend on scale: components of 1e200 and 1e-200 neither overflow nor vanish."""
    r = np.random.default_rng(6)
    base = [r.normal(size=8) for _ in range(6)]
    rows = [(3 * k + i, (b * s).tolist()) for k, b in enumerate(base) for i, s in enumerate((1.0, 1e200, 1e-200))]
    got = {x.vec_id: x for x in flatgraph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(x.n_links == 2 and x.component_id == i // 3 * 3 for i, x in got.items())


def test_audit_counts_vectors_not_weights(spark):
    """A heavy vector that was found does not hide many that were not."""
    nodes = spark.createDataFrame([(i, 1_000_000 if i == 0 else 1, [1.0, i * 1e-4]) for i in range(50)],
                                  "rep long, weight long, x array<double>")
    counts = spark.createDataFrame([(i, 1) for i in range(50)], "rep long, n long")
    assert abs(flatgraph.audit(nodes, counts, 0.95) - 1 / 49) < 1e-9


# --- operator 9 ---------------------------------------------------------------------------------

def chat_rows():
    hard = "</s>[INST] ok [/INST]"
    return [(1, 0, "user", "hi"), (1, 1, "assistant", "  hello\n"), (1, 2, "user", hard), (1, 3, "assistant", hard),
            (2, 0, None, None), (2, 1, "assistant", ""), (3, 1, "assistant", "<|endoftext|><|user|>\n<\\|x <<SYS>>"),
            (3, 0, "we|ird %role\n", "émoji 😀 \\"), (None, 0, "assistant", "no id"), (4, 0, "assistant", "a " * 3000),
            (4, 1, "assistant", "b" * 3000), (4, 1, "assistant", "b" * 3000), (4, None, "system", "null turn first")]


def check_chats(rows, got):
    groups = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id for r in got} == set(groups) and len(got) == len(groups)
    for r in got:
        turns = groups[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("size", [1 << 17, 10])
def test_chat_round_trip(spark, monkeypatch, size):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int")
    monkeypatch.setattr(chat, "BLOCK_CHARS", size)
    blocks = chat.format_conversations(df)
    check_chats(rows, chat.digest_conversations(blocks).collect())
    tok = chat._tokenizer(chat.VOCABULARY)
    whole = {}
    for b in blocks.orderBy("conv_id", "block").collect():
        assert list(b.ids) == tok.encode(b.text, add_special_tokens=False).ids and len(b.ids) == len(b.loss)
        text, ids = whole.get(b.conv_id, ("", []))
        whole[b.conv_id] = (text + b.text, ids + list(b.ids))
    for text, ids in whole.values():  # blocks are cut where the tokenizer cuts anyway
        assert ids == tok.encode(text, add_special_tokens=False).ids
    assert chat.digest_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_escaping_is_reversible():
    r = np.random.default_rng(7)
    parts = ["<", "|", "\\", "/", "s>", "[", "INST]", "<<SYS>>", "<|endoftext|>", "a", "]", "[/INST]", "</s>"]
    for _ in range(5000):
        t = "".join(parts[k] for k in r.integers(0, len(parts), r.integers(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", e), (t, e)


def test_masks_clip_tokens_that_reach_over():
    mask, under = chat.loss_mask(np.array([0, 3, 6, 6, 9]), np.array([3, 6, 9, 9, 12]), [(4, 8), (10, 11)])
    assert mask.tolist() == [False, True, True, True, True] and under == [(4, 8), (10, 11)]
