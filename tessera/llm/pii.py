"""Personal data: patterns, and a character BiLSTM-CRF for disguised forms (operator 10).

Two layers. The base layer is the stated patterns for e-mail addresses, IP
addresses, payment cards and phone numbers, over whole texts. The method layer
is a character-level bidirectional LSTM with a linear-chain CRF on top (Lample
et al., "Neural Architectures for Named Entity Recognition", NAACL 2016; on
characters), trained in numpy on labelled spans: windows around base spans of
a bounded sample of documents, the same spans disguised in the ways people
write them (``name at host dot org``, ``10[.]0[.]0[.]1``, national phone
formats, dotted cards), and windows without personal data.

The model adds spans that the patterns miss; base spans stay as they are and
the model never overlaps them. Every plausible span holds a digit, an @ or a
spelled or bracketed "at", so a window without such a cue (a spelled or
bracketed "dot" is one too) has nothing to find and is not decoded. Around cues
the text is cut into windows of ``WIDTH`` characters every ``STRIDE``
characters, so that each span of up to ``LONGEST`` lies inside one. A span that several windows see is taken
from the window whose middle it is nearest to: of overlapping spans of a text
the one nearest to its window's middle stays.

Plan: one pass over a sample of about ``SAMPLE_DOCS`` documents (a share of all,
by hash) to collect at most ``SAMPLE_WINDOWS`` different windows, training on the
driver (some 20 seconds, whatever the corpus; weights of a few KB, broadcast),
one pass over all documents. No shuffle; a hot source stays spread over its
tasks. Weights of an earlier ``fit`` may be passed in instead.

Defined cases: null and empty texts have no spans; repeated rows are tagged
each by itself; a corpus without base spans trains on none and adds none; an
empty table gives an empty result. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

SAMPLE_DOCS = 20_000
SAMPLE_WINDOWS = 6_000
WIDTH = 160
STRIDE = 72  # less than WIDTH - LONGEST
LONGEST = 80
TRAIN_WIDTH = 96
DISGUISED = 6_000
VARIANTS = 40
KINDS = ("email", "ip", "card", "phone")

# The contract's patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[\d@]|(?<![A-Za-z])[aA][tT](?![A-Za-z])|\b[dD][oO][tT]\b|[(\[{<]\s*(?:[aA][tT]|[dD][oO][tT]|\.)\s*[)\]}>]")
_ANY = re.compile(r"[0-9@]")
#: what may be a disguised span: such windows are no examples of clean text
_DOUBTFUL = re.compile(r"(?:[0-9][\s().,_/\[\]+-]*(?:dot\s*)?){7}|@|\b[aA][tT]\b.{1,40}\b[dD][oO][tT]\b|[(\[{<]\s*(?:at|dot|\.)\s*[)\]}>]"
                       r"|\b[aA][tT]\s+[\w-]+(?:\s*\.\s*[\w-]+)*(?:\.|\s\.\s)[A-Za-z]{2}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @, dotted domain, found
    from the @ signs, so long runs of letters cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > last and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                last = domain.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Matches of four dotted numbers of at most 255. A run of digits matches
    from its first digit or not at all, so the leftmost matches in a dotted
    chain are its numbers taken by fours, and no digit is read twice."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in four)):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's matches, sorted."""
    if not text or not _ANY.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    out += [(s, 1, e) for s, e in ips(text)]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# --- the model ----------------------------------------------------------------------------------

N_CHAR = 72
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind


def _char_table() -> np.ndarray:
    t = np.full(0x180, 1, np.int64)  # 0: padding, 1: anything else
    for c in range(0x20, 0x41):
        t[c] = 2 + c - 0x20
    for k in range(26):
        t[0x61 + k] = 35 + k
        t[0x41 + k] = 35 + k
    for k, c in enumerate("[]{}_|~\\\n"):
        t[ord(c)] = 61 + k
    t[0xC0:] = 70
    return t


_CHARS = _char_table()


def encode_chars(window: str, width: int) -> np.ndarray:
    code = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(width, np.int64)
    out[:len(code)] = _CHARS[np.minimum(code, 0x17F)]
    return out


def new_weights(embed: int = 16, hidden: int = 24, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {"E": r.normal(0, 0.3, (N_CHAR, embed))}
    for d in "fb":
        w[f"W{d}"] = r.normal(0, 1 / np.sqrt(embed), (embed, 4 * hidden))
        w[f"U{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w[f"B{d}"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])  # the forget gate starts open
    w["O"] = r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS))
    w["C"] = np.zeros(TAGS)
    w["T"] = np.zeros((TAGS, TAGS))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """Hidden states (T, N, H) of inputs (T, N, E); with ``keep`` what the
    backward pass needs."""
    steps, n, _ = x.shape
    h, width = np.zeros((n, u.shape[0]), np.float32), u.shape[0]
    c = np.zeros_like(h)
    gates_in = x @ w + b
    out = np.empty((steps, n, width), np.float32)
    saved = []
    for t in range(steps):
        z = gates_in[t] + h @ u
        f, i, o = (_sigmoid(z[:, k * width:(k + 1) * width]) for k in range(3))
        g = np.tanh(z[:, 3 * width:])
        before, was = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((f, i, o, g, before, tc, was))
    return out, saved


def _lstm_back(dout: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, saved):
    steps, n, width = dout.shape
    dz_all = np.empty((steps, n, 4 * width), np.float32)
    dh, dc, du = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32), np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        f, i, o, g, before, tc, was = saved[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :width] = dc * before * f * (1 - f)
        dz[:, width:2 * width] = dc * g * i * (1 - i)
        dz[:, 2 * width:3 * width] = dh * tc * o * (1 - o)
        dz[:, 3 * width:] = dc * i * (1 - g * g)
        du += was.T @ dz
        dh, dc = dz @ u.T, dc * f
    flat = dz_all.reshape(-1, 4 * width)
    return (dz_all @ w.T), x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def emissions(w: dict[str, np.ndarray], chars: np.ndarray, keep: bool = False):
    """Tag scores (T, N, TAGS) of windows (N, T)."""
    x = w["E"][chars.T]
    hf, sf = _lstm(x, w["Wf"], w["Uf"], w["Bf"], keep)
    hb, sb = _lstm(x[::-1], w["Wb"], w["Ub"], w["Bb"], keep)
    h = np.concatenate([hf, hb[::-1]], 2)
    return h @ w["O"] + w["C"], (x, h, sf, sb)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradient(e: np.ndarray, trans: np.ndarray, tags: np.ndarray):
    """Mean negative log-likelihood of tags (T, N), and its gradients for the
    emissions and the transitions, by the forward-backward recursions."""
    steps, n, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + trans[None], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    dt = np.zeros_like(trans)
    for t in range(1, steps):
        dt += np.exp(alpha[t - 1][:, :, None] + trans[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    rows = np.arange(n)
    gold = e[0, rows, tags[0]].copy()
    de[0, rows, tags[0]] -= 1
    for t in range(1, steps):
        gold += e[t, rows, tags[t]] + trans[tags[t - 1], tags[t]]
        de[t, rows, tags[t]] -= 1
    np.add.at(dt, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    return float((z - gold).mean()), de / n, dt / n


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (T, N)."""
    steps, n, k = e.shape
    best, back = e[0], np.empty((steps, n, k), np.int8)
    for t in range(1, steps):
        s = best[:, :, None] + trans[None]
        back[t] = s.argmax(1)
        best = s.max(1) + e[t]
    out = np.empty((steps, n), np.int64)
    out[-1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t][np.arange(n), out[t]]
    return out


def train(chars: np.ndarray, tags: np.ndarray, steps: int = 500, size: int = 64, rate: float = 0.02, seed: int = 3,
          losses: list[float] | None = None) -> dict[str, np.ndarray]:
    """Adam on mini-batches of windows (N, T) and their tags; gradients by hand."""
    w = new_weights()
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    for step in range(1, steps + 1):
        pick = r.integers(0, len(chars), size)
        e, (x, h, sf, sb) = emissions(w, chars[pick], keep=True)
        loss, de, dt = crf_gradient(e, w["T"], tags[pick].T)
        if losses is not None:
            losses.append(loss)
        g = {"T": dt, "C": de.sum((0, 1)), "O": h.reshape(-1, h.shape[2]).T @ de.reshape(-1, TAGS)}
        dh = de @ w["O"].T
        half = dh.shape[2] // 2
        dxf, g["Wf"], g["Uf"], g["Bf"] = _lstm_back(dh[:, :, :half], x, w["Wf"], w["Uf"], sf)
        dxb, g["Wb"], g["Ub"], g["Bb"] = _lstm_back(dh[::-1, :, half:], x[::-1], w["Wb"], w["Ub"], sb)
        g["E"] = np.zeros_like(w["E"])
        np.add.at(g["E"], chars[pick].T, dxf + dxb[::-1])
        scale = min(1.0, 5.0 / (np.sqrt(sum(float((q * q).sum()) for q in g.values())) + 1e-9))
        lr = rate * (1 - 0.9 * step / steps)
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * scale * g[k]
            v[k] = 0.999 * v[k] + 0.001 * (scale * g[k]) ** 2
            w[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return w


# --- training data ------------------------------------------------------------------------------

def disguise(kind: int, s: str, r: np.random.Generator, names: list[str]) -> str:
    """One of the ways in which people write a span so that patterns miss it;
    half of the addresses get other names, taken from words of the text."""
    if kind == 0:
        if names and r.integers(2):
            pick = [names[i].lower() for i in r.integers(0, len(names), 3)]
            s = (pick[0] + ["", ".", "_", "-"][r.integers(4)] + [pick[1], str(r.integers(1, 99)), ""][r.integers(3)]).strip(".-_")
            s += "@" + pick[2] + ["", ".example", "-mail"][r.integers(3)] + [".com", ".org", ".net", ".de", ".fr", ".io"][r.integers(6)]
        at = [" at ", " (at) ", "[at]", " [at] ", "(at)", " AT ", " @ "][r.integers(7)]
        dot = [" dot ", " (dot) ", "[dot]", "[.]", "(dot)", " DOT ", " . "][r.integers(7)]
        return s.replace("@", at).replace(".", dot)
    if kind == 1:
        return s.replace(".", ["[.]", "(.)", " . ", " dot ", "[dot]", " . "][r.integers(6)])
    d = _digits(s)
    if kind == 2:
        sep = [".", "  ", "_", "/", " . "][r.integers(5)]
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4))
    d = d[-10:].rjust(10, "5")
    return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}",
            f"{d[:3]} {d[3:6]} {d[6:]}", f"00{s[1:]}", f"+ {s[1:]}", f"({d[:3]}) {d[3:6]} {d[6:]}"][r.integers(7)]


def training_windows(windows: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 11):
    """Character ids and tags of the windows: as they are, and with their spans
    disguised, at varied places of the window."""
    r = np.random.default_rng(seed)
    chars, tags = [], []

    def add(text, spans):
        cut = int(r.integers(0, max(1, min(len(text) // 3, spans[0][0] + 1 if spans else 1))))
        t = np.zeros(TRAIN_WIDTH, np.int64)
        for s, k, e in spans:
            s, e = s - cut, min(e - cut, TRAIN_WIDTH)
            if 0 <= s < e:
                t[s:e] = 2 + 2 * k
                t[s] = 1 + 2 * k
        chars.append(encode_chars(text[cut:cut + TRAIN_WIDTH], TRAIN_WIDTH))
        tags.append(t)

    words = sorted({w for text, spans in windows if not spans for w in text.split()}
                   | {w for text, spans in windows for s, _, e in spans[:1] for w in (text[:s] + " " + text[e:]).split()})

    def some_words() -> str:
        """Context: words of other windows, or letters that are no words."""
        pick = [words[i] if r.integers(4) else "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9)))
                for i in r.integers(0, len(words), r.integers(0, 8))] if words else []
        return " ".join(pick)

    # few spans are disguised more often, so that every form is seen with many contexts
    variants = max(3, min(VARIANTS, DISGUISED // max(1, sum(len(spans) for _, spans in windows))))
    for text, spans in windows:
        add(text, spans)
        names = re.findall(r"[A-Za-z]{3,10}", text)
        for s, k, e in spans:
            for _ in range(variants):
                new = "".join(str(r.integers(10)) if c.isdigit() and k else c for c in text[s:e])
                if k == 1:
                    new = ".".join(str(r.integers(256)) for _ in range(4))
                if r.integers(4):
                    new = disguise(k, new, r, names)
                if r.integers(2):
                    before, after = text[max(0, s - 40):s], text[e:]
                else:
                    before, after = f"{some_words()} ".lstrip(), f" {some_words()}".rstrip()
                if not any(a < s and b > s - 40 for a, _, b in spans) or before != text[max(0, s - 40):s]:
                    after = after if not any(a >= e for a, _, b in spans) else f" {some_words()}".rstrip()
                    add(before + new + after, [(len(before), k, len(before) + len(new))])
        if not spans and r.integers(3) == 0:
            add(f"{some_words()} {some_words()}", [])
    return np.array(chars).reshape(-1, TRAIN_WIDTH), np.array(tags).reshape(-1, TRAIN_WIDTH)


def _sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a task's documents: around base spans, around other cues, and plain."""
    for b in batches(it):
        out = []
        for text in b.column(0).to_pylist():
            spans = base_spans(text)
            if not text:
                continue
            picks = [max(0, s - 32) for s, _, _ in spans[:4]]
            cues = [m.start() for m in _CUE.finditer(text) if not any(s <= m.start() < e for s, _, e in spans)]
            picks += [max(0, c - 40) for c in cues[::max(1, len(cues) // 2)][:2]]
            if not picks:
                picks = [(len(text) * 7 // 10) // 2] if len(out) % 4 == 0 else []
            for p in picks:
                inside = [(s - p, k, e - p) for s, k, e in spans if p <= s and e <= p + TRAIN_WIDTH]
                if not inside and _DOUBTFUL.search(text[p:p + TRAIN_WIDTH]):
                    continue
                whole = all(e <= p or s >= p + TRAIN_WIDTH or (p <= s and e <= p + TRAIN_WIDTH) for s, _, e in spans)
                apart = all(x[2] <= y[0] for x, y in zip(inside, inside[1:]))
                if whole and apart:
                    out.append({"text": text[p:p + TRAIN_WIDTH], "spans": [list(x) for x in inside]})
        yield pa.RecordBatch.from_arrays(
            [pa.array([o["text"] for o in out], pa.string()), pa.array([o["spans"] for o in out], pa.list_(pa.list_(pa.int32())))],
            names=["text", "spans"])


def sample_of(docs: DataFrame, n: int) -> DataFrame:
    """About SAMPLE_DOCS of ``n`` documents, all if there are fewer: those whose
    hash, as one of 2^53 numbers, is below that share."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") / float(1 << 53)
    return docs.filter(place < min(1.0, SAMPLE_DOCS / max(n, 1)))


def fit(docs: DataFrame) -> dict[str, np.ndarray] | None:
    """Weights trained on a bounded sample; None where nothing is labelled."""
    sample = sample_of(docs, docs.count()).select("text")
    rows = sample.mapInArrow(_sample, "text string, spans array<array<int>>").distinct()
    kept = rows.withColumn("_h", F.xxhash64("text", "spans")).orderBy("_h", "text").limit(SAMPLE_WINDOWS)
    windows = [(r.text, [tuple(s) for s in r.spans]) for r in kept.collect()]
    if not any(s for _, s in windows):
        return None
    return train(*training_windows(windows))


# --- decoding -----------------------------------------------------------------------------------

def plausible(kind: int, s: str) -> bool:
    """Does a span have what its kind needs?"""
    d = _digits(s)
    if kind == 0:
        return bool(re.search(r"\w\s*(?:@|[(\[{<]?\s*(?<![a-z])at(?![a-z])\s*[)\]}>]?)\s*\w", s, re.I)) and bool(
            re.search(r"\w\s*(?:\.|[(\[{<]?\s*(?:dot|\.)\s*[)\]}>]?)\s*[a-z]{2,}\Z", s, re.I)) and len(s) <= LONGEST
    if kind == 1:
        parts = re.findall(r"\d+", s)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and len(s) <= 24 and not re.search(r"[a-z]", s, re.I)


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows; each span of up to ``LONGEST``
    characters that holds a cue lies inside one, apart from its edges."""
    starts: list[int] = []
    for m in _CUE.finditer(text):
        first = max(0, (m.start() - LONGEST) // STRIDE * STRIDE)
        for s in range(first, m.start() + 1, STRIDE):
            if not starts or s > starts[-1]:
                starts.append(s)
    return starts


def tag_texts(w: dict[str, np.ndarray], texts: list[str | None], base: list[list[tuple[int, int, int]]]
              ) -> list[list[tuple[int, int, int]]]:
    """The model's spans (start, kind, end) of each text, reconciled over its
    windows and kept apart from the base spans."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    where = [(i, s) for i, t in enumerate(texts) if t for s in windows_of(t)]
    found: dict[int, list[tuple[float, int, int, int]]] = {}
    for a in range(0, len(where), 512):
        part = where[a:a + 512]
        chars = np.stack([encode_chars(texts[i][s:s + WIDTH], WIDTH) for i, s in part])
        tags = viterbi(emissions(w, chars)[0], w["T"]).T
        begins = (tags > 0) & (tags % 2 == 1)
        for row, col in zip(*np.nonzero(begins)):
            i, s = part[row]
            k, end = (tags[row, col] - 1) // 2, col + 1
            while end < WIDTH and tags[row, end] == 2 + 2 * k:
                end += 1
            # spans cut by the window's edge belong to its neighbour
            if (end == WIDTH and s + WIDTH < len(texts[i])) or (col == 0 and s > 0):
                continue
            found.setdefault(i, []).append((abs((col + end) / 2 - WIDTH / 2), s + int(col), int(k), s + int(end)))
    for i, spans in found.items():
        taken = [(s, e) for s, _, e in base[i]]
        for _, s, k, e in sorted(spans):  # the span nearest to its window's middle first
            t = texts[i][s:e]
            s, e = s + len(t) - len(t.lstrip()), e - (len(t) - len(t.rstrip(" \n.,;")))
            cut = texts[i][s - 1:s].isalnum() or texts[i][e:e + 1].isalnum()  # part of a longer word or number
            if s < e and not cut and plausible(k, texts[i][s:e]) and all(e <= x or s >= y for x, y in taken):
                taken.append((s, e))
                out[i].append((s, k, e))
        out[i].sort()
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
         "n_added long")


def _tagger(weights):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches(it, 4 << 20):
            texts = b.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            added = tag_texts(w, texts, base) if w is not None else [[] for _ in texts]
            counts = np.zeros((len(KINDS), len(texts)), np.int64)
            for i, spans in enumerate(base):
                for _, k, _ in spans:
                    counts[k, i] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c) for c in counts),
                 pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]),
                 pa.array([_joined(sorted(x + y)) for x, y in zip(base, added)]), pa.array([len(y) for y in added], pa.int64())],
                names=[f.split()[0] for f in FOUND.split(", ")])
    return run


def find_personal_data(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Spans and counts for every row of ``docs (doc_id, text, ...)``; counts
    and digest are of the base spans. ``weights`` are those of an earlier fit."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(d) if weights is None else weights)
    return d.mapInArrow(_tagger(shared), FOUND)
