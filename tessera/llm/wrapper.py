"""Main text of web pages by wrapper induction (operator 7).

Method: pages of one host are made from one template. Every page is parsed
into a tree; siblings with the same label are folded into one repeating node,
as a wrapper's list rule does, so each node of the folded tree is a slot. The
host's most frequent folded tree is its wrapper, and every other one is aligned
with it by simple tree matching (Yang, "Identifying Syntactic Differences
Between Two Programs", 1991; used for wrappers by Zhai & Liu, WWW 2005). Over
all pages of the host, a slot whose text never changes is template, if at least
``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's pages have it; varying
slots are content, unless they lie in an element that is by its kind no main
text (menu, footer, aside, form), or are mostly links. If varying slots of a
tree lie in an article (or main) element, only those are the text of its pages;
other trees of the host keep all their varying slots.

A name alone (class, id, role) never makes an element a sidebar, notice or
comment: an element with such a name is left out only if it holds no article
and no large part of the host's varying text. That part is ``CARRIES`` where
the name is such a word, ``MAY_CARRY`` where it only contains one, as in
``has-sidebar`` or ``legal-news``. html, body, article and main are never
judged by name.

Plan: pages with equal folded trees need the same alignment, so matching runs
once per (host, tree), not per page. Pass 1 parses pages and sums slot
statistics per (host, tree, slot), within tasks first, so a host that holds a
third of all pages costs a few rows per task; trees and slots go by hashes, the
text of a tree once per task. Pass 2 parses again and keeps the blocks of
content slots. No html is shuffled while the wrapper table has at most
``SMALL_RULES`` bytes; beyond that it is joined by shuffle.

A page is read once from left to right, whatever it holds; labels keep
``LABEL_NAMES`` names of ``NAME_CHARS`` characters, and elements nested deeper
than ``DEPTH`` share the slot of their ancestor at that depth (their text stays).

Defined cases: null and empty html give empty text; a null url is the host '';
hosts with fewer than ``MIN_PAGES`` pages have no constant slots; pages that
end in the middle of a tag lose that tag only. Repeated rows and ids are
extracted row by row; an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import batches

MIN_PAGES = 5
MIN_SHARE = 0.25
MAX_LINK_SHARE = 0.5
CARRIES = 0.8
MAY_CARRY = 0.5
SMALL_RULES = 8 << 20
DEPTH = 150
LABEL_NAMES = 8
NAME_CHARS = 64

# Fixed values of HTML: elements without an end tag, raw text, inline elements,
# and the start tags that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                   "h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: a start tag ends an open element of these names, up to the given container
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# Names of what is not main text.
NOT_TEXT = frozenset("nav footer aside form dialog menu button select option head input fieldset".split())
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer header legal login masthead menu modal nav navbar navigation newsletter notice notification pager "
    "pagination popup promo promotion related replies reply respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget contentinfo complementary alert".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


def label_of(tag: str, names: str) -> str:
    """Tag with its class, id and role names; digits are taken out, so that
    numbered ids are one label."""
    found = [n[:NAME_CHARS] for n in re.sub(r"[\d/|.]+", "", names).lower().split()]
    return tag + "".join("." + n for n in found[:LABEL_NAMES])


def tags(page: str) -> Iterator[tuple[int, int, str, str, bool, bool]]:
    """(begin, end, tag, names, closes, void) of every tag of a page; comments
    and the like have an empty tag. An open end is a tag up to the page's end."""
    at, n = 0, len(page)
    while (lt := page.find("<", at)) >= 0:
        head = page[lt + 1:lt + 2]
        closes = head == "/"
        name = _NAME.match(page, lt + 1 + closes)
        if name is None:
            if head not in ("/", "!", "?") or not head:
                if not head:
                    return
                at = lt + 1
                continue
            mark = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(mark, lt + (4 if mark == "-->" else 2))
            at = n if end < 0 else end + len(mark)
            yield lt, at, "", "", False, False
            continue
        at, names, void = name.end(), [], False
        while True:
            m = _ATTRIBUTE.match(page, at)
            if m is None:
                at = n
                break
            void = m[1] is not None and page[m.end() - 2:m.end() - 1] == "/"
            at = m.end()
            if m[1]:
                break
            key = m[2].lower()
            if key in ("class", "id", "role"):
                names.append(m[3] or m[4] or m[5] or "")
            elif key == "hidden":
                names.append("hidden")
        yield lt, at, name[0].lower(), " ".join(names), closes, void


def page_blocks(page: str) -> list[tuple[str, str, int]]:
    """(slot, text, characters inside links) of each block of a page, in order.
    The slot is the path of labels; inline elements are part of their block."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []  # (tag, path) of open block elements
    opened: Counter = Counter()        # how many elements of a tag are open
    inline: Counter = Counter()
    text: list[str] = []
    links = 0

    def flush():
        nonlocal links
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            if t:
                out.append((stack[-1][1] if stack else "", t, links))
            text.clear()
        links = 0

    def pop_to(k):
        flush()
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]
        inline.clear()

    def say(piece):
        nonlocal links
        text.append(piece)
        if inline["a"]:
            links += len(piece)

    at, n = 0, len(page)
    for begin, end, tag, names, closes, void in tags(page):
        if begin < at:      # inside raw text
            continue
        if begin > at:
            say(page[at:begin])
        at = end
        if not tag:
            continue
        if closes:
            if tag in INLINE:
                inline[tag] = max(0, inline[tag] - 1)
            elif opened[tag]:
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            if not (void and tag == "svg"):
                m = _RAW_END[tag].search(page, at)
                close = page.find(">", m.end()) if m else -1
                at = close + 1 if close >= 0 else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            inline[tag] += 1
            continue
        if tag in ENDS_P and opened["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in ENDS_P:
                    break
        if tag in SIBLINGS and any(opened[x] for x in SIBLINGS[tag][0]):
            same, until = SIBLINGS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in until:
                    break
                if stack[k][0] in same:
                    pop_to(k)
                    break
        flush()
        if tag not in VOID:
            path = label_of(tag, names)
            if stack:
                path = f"{stack[-1][1]}/{path}" if len(stack) < DEPTH else stack[-1][1]
            stack.append((tag, path))
            opened[tag] += 1
    if at < n:
        rest = page[at:]
        say(rest[:-1] if rest.endswith("<") else rest)
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def fold(paths: list[str]) -> dict:
    """The folded tree of slot paths: children by label, in order."""
    root: dict = {}
    for p in paths:
        node = root
        for label in p.split("/"):
            node = node.setdefault(label, {})
    return root


def match_trees(a: dict, b: dict, at: str = "", to: str = "") -> tuple[float, list[tuple[str, str]]]:
    """Simple tree matching of the children of two matched nodes: the best
    order-preserving pairing; tags must be equal, equal names count extra."""
    ka, kb = list(a), list(b)
    table = [[(0.0, None)] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    pairs = {}
    for i, x in enumerate(ka, 1):
        for j, y in enumerate(kb, 1):
            best = max(table[i - 1][j][0], table[i][j - 1][0])
            move = (i - 1, j) if table[i - 1][j][0] >= table[i][j - 1][0] else (i, j - 1)
            if x.split(".")[0] == y.split(".")[0]:
                pa_, pb = (f"{at}/{x}" if at else x), (f"{to}/{y}" if to else y)
                score, inner = match_trees(a[x], b[y], pa_, pb)
                score += 1.0 + 0.5 * (x == y) + table[i - 1][j - 1][0]
                if score > best:
                    best, move = score, None
                    pairs[i, j] = [(pa_, pb), *inner]
            table[i][j] = (best, move)
    found, i, j = [], len(ka), len(kb)
    while i and j:
        move = table[i][j][1]
        if move is None:
            found += pairs[i, j]
            i, j = i - 1, j - 1
        else:
            i, j = move
    return table[-1][-1][0], found


def kind_of(slot: str) -> bool:
    """Is the slot, by the elements on its path, not main text?"""
    inside = False
    for label in slot.split("/"):
        tag, _, names = label.partition(".")
        if tag in NOT_TEXT or tag == "header" and not inside or "hidden" in names.split("."):
            return True
        inside |= tag in ("article", "main")
    return False


def named(slot: str) -> list[tuple[str, bool]]:
    """The paths of the slot's elements that have a name of boilerplate, and
    whether the name is such a word; others only contain one."""
    out, labels = [], slot.split("/")
    for k, label in enumerate(labels):
        tag, *names = label.split(".")
        if tag in ("html", "body", "article", "main"):
            continue
        exact = any(n.strip("-_") in BOILERPLATE for n in names)
        if exact or any(w in BOILERPLATE for n in names for w in re.split(r"[-_]", n)):
            out.append(("/".join(labels[:k + 1]), exact))
    return out


def in_article(slot: str) -> bool:
    return any(x.partition(".")[0] in ("article", "main") or ".main" in x for x in slot.split("/"))


def slot_key(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path.encode("utf-8", "surrogatepass")) >> 1


def _parsed(texts, urls):
    for page, url in zip(texts, urls):
        blocks = page_blocks(page or "")
        paths = "|".join(dict.fromkeys(b[0] for b in blocks))
        yield host_of(url), xxhash.xxh3_128_hexdigest(paths.encode("utf-8", "surrogatepass")), paths, blocks


STATS = "host string, tree string, slot long, pages long, chars long, links long, low long, high long, paths string"


def _statistics(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, 8 << 20):
        sums: dict[tuple[str, str, int], list] = {}
        for host, tree, paths, blocks in _parsed(b.column(1).to_pylist(), b.column(0).to_pylist()):
            slots: dict[str, list] = {}
            for slot, text, links in blocks:
                s = slots.setdefault(slot, [0, 0, xxhash.xxh3_64()])
                s[0] += len(text)
                s[1] += links
                s[2].update(text.encode("utf-8", "surrogatepass") + b"\n")
            for k, (slot, (chars, links, h)) in enumerate(slots.items()):
                v = h.intdigest() >> 1
                t = sums.setdefault((host, tree, slot_key(slot)), [0, 0, 0, v, v, paths if k == 0 else None])
                t[0] += 1
                t[1] += chars
                t[2] += links
                t[3], t[4] = min(t[3], v), max(t[4], v)
        rows = [(*k, *v) for k, v in sums.items()]
        cols = list(zip(*rows)) if rows else [[]] * 9
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.string() if i in (0, 1, 8) else pa.int64()) for i, c in enumerate(cols)],
            names=[f.split()[0] for f in STATS.split(", ")])


def _aligned(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in it:
        for host, tree, own, main in zip(p.host, p.tree, p.paths, p.main):
            paths = own.split("|")
            to = dict(match_trees(fold(paths), fold(main.split("|")))[1]) if own != main else {}
            yield pd.DataFrame([(host, tree, slot_key(s), to.get(s, s)) for s in paths], columns=["host", "tree", "slot", "place"])


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """``host, tree, slots``: the content slots of every folded tree of every
    host, from statistics over all pages."""
    stats = stored(pages.select("url", "html").mapInArrow(_statistics, STATS).groupBy("host", "tree", "slot").agg(
        F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("paths").alias("paths")), "slots")
    trees = stats.filter("paths IS NOT NULL").select("host", "tree", "pages", "paths")      # its first slot: one row a tree
    main = trees.groupBy("host").agg(F.max(F.struct("pages", "tree", "paths")).alias("m"), F.sum("pages").alias("host_pages"))
    main = main.select("host", F.col("m.paths").alias("main"), "host_pages")
    aligned = stored(trees.join(main, "host").select("host", "tree", "paths", "main").mapInPandas(
        _aligned, "host string, tree string, slot long, place string"), "aligned")
    place = (stats.join(aligned, ["host", "tree", "slot"]).groupBy("host", "place").agg(
        F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        F.min("low").alias("low"), F.max("high").alias("high")).join(main.select("host", "host_pages"), "host"))
    judged = stored(place.mapInPandas(_judged, "host string, place string, article boolean, chars long, "
                                               "named array<struct<path:string,exact:boolean,inside:boolean,holds:boolean>>"), "places")
    # an element named like boilerplate, against what it holds of its host's text (of that in articles, inside one)
    total = judged.groupBy("host").agg(F.sum("chars").alias("all"), F.sum(F.when(F.col("article"), F.col("chars"))).alias("inner"))
    carried = judged.select("host", "chars", F.explode("named").alias("e")).groupBy("host", "e.path").agg(
        F.sum("chars").alias("chars"), F.max("e.exact").alias("exact"), F.max("e.inside").alias("inside"), F.max("e.holds").alias("holds"))
    least = F.when(F.col("exact"), CARRIES).otherwise(MAY_CARRY) * F.when(F.col("inside"), F.col("inner")).otherwise(F.col("all"))
    dropped = carried.join(total, "host").filter(~F.col("holds") & (F.col("chars") < least)).select("host", "path")
    under = judged.select("host", "place", F.explode("named.path").alias("path")).join(dropped, ["host", "path"], "left_semi")
    kept = judged.join(under.select("host", "place").distinct(), ["host", "place"], "left_anti").select("host", "place", "article")
    rules = aligned.join(kept, ["host", "place"]).groupBy("host", "tree").agg(  # a tree's own slots
        F.collect_set(F.when(F.col("article"), F.col("slot"))).alias("inside"), F.collect_set("slot").alias("all"))
    return rules.select("host", "tree", F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.col("all")).alias("slots"))


def _judged(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The places that are content by how they vary, whether they lie in an
    article, and their elements with names of boilerplate."""
    for p in it:
        rows = []
        for r in p.itertuples():
            article = in_article(r.place)
            constant = r.low == r.high and r.pages >= max(MIN_PAGES, MIN_SHARE * r.host_pages)
            menu = r.links > MAX_LINK_SHARE * r.chars
            if not kind_of(r.place) and (article or not (constant or menu)):
                names = [{"path": path, "exact": exact, "inside": in_article(path),
                          "holds": article and not in_article(path)} for path, exact in named(r.place)]
                rows.append((r.host, r.place, article, r.chars, names))
        yield pd.DataFrame(rows, columns=["host", "place", "article", "chars", "named"]).astype({"article": bool, "chars": "int64"})


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.list_(pa.struct([("slot", pa.int64()), ("text", pa.string())]))
    for b in batches(it, 8 << 20):
        host, tree, found = [], [], []
        for h, t, _, blocks in _parsed(b.column(2).to_pylist(), b.column(1).to_pylist()):
            host.append(h), tree.append(t)
            found.append([{"slot": slot_key(s), "text": x} for s, x, _ in blocks])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(host, pa.string()), pa.array(tree, pa.string()),
                                          pa.array(found, block)], names=["page_id", "url", "host", "tree", "blocks"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages (page_id, url, html)``."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.col("html").cast("string").alias("html"))
    rules = stored(induce_wrappers(p), "wrappers")
    size = rules.agg(F.sum(F.octet_length("host") + 32 + 8 * F.size("slots"))).first()[0] or 0
    if size <= SMALL_RULES:
        rules = F.broadcast(rules)
    parsed = p.mapInArrow(_blocks, "page_id long, url string, host string, tree string, "
                                   "blocks array<struct<slot:long,text:string>>")
    kept = F.filter("blocks", lambda b: F.array_contains(F.col("slots"), b["slot"]))
    text = F.coalesce(F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n"), F.lit(""))
    return parsed.join(rules, ["host", "tree"], "left").select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))
