"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The base finds emails, addresses, cards and phones in their plain forms. The field scores whole
segments of tokens with features of the span (digits, groups, separators, check sum, shape) and
chooses boundaries and kinds together by dynamic programming over segments of bounded length. It
is fitted by likelihood on a bounded sample of the corpus's own base matches, each also rewritten
into forms that the base misses, among regions that hold no match. Only regions with digits or an
at-sign that the base leaves open are decoded; a decoded span that touches a base span is dropped.

Null and empty texts have no spans. A corpus without any base match gives no model, so only base
spans. Repeated rows get equal spans. Extra columns pass through unless they bear a result's name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

KINDS = ("email", "ip", "card", "phone")

# --- base patterns ----------------------------------------------------------------------

# The part before the at-sign is taken by scanning back from it, so long words cost nothing.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never begins inside a run of digits: if it fails at the start of the run it fails within.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base matches, by kind and start."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                out.append((0, start, last))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# --- regions that may hold more ------------------------------------------------------------

_RUN = re.compile(r"[0-9+(\[][0-9 ()./\[\]+-]{6,}")
_AT = re.compile(r"@|[\[({] ?at ?[\])}]", re.I)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
LEAST_DIGITS = 7
REACH = 48          # characters around an at-sign
LONGEST = 20        # tokens of a segment


def regions(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches with at least seven digits in a run, with four number groups in a row, or around an at-sign."""
    found = []
    if _DIGIT.search(text):
        found += [(m.start(), m.end()) for m in _RUN.finditer(text) if len(_DIGIT.findall(m[0])) >= LEAST_DIGITS]
        found += [(m.start(), m.end()) for m in _IP_SHAPE.finditer(text)]
    if "@" in text or "at" in text:
        for m in _AT.finditer(text):
            lo = max(text.rfind("\n", 0, m.start()) + 1, m.start() - REACH)
            hi = text.find("\n", m.end(), m.end() + REACH)
            found.append((lo, hi if hi >= 0 else min(len(text), m.end() + REACH)))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


# --- segments and their features -------------------------------------------------------------

_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]+)+", re.I)
_IP_SHAPE = re.compile(r"[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}")
_PHONE_SHAPE = re.compile(r"(?:(?:00|\+)[0-9]{1,3}[ ./-]?)?(?:[0-9]{1,3}[ ./-])?\(?[0-9]{3}\)?[ ./-]?[0-9]{3}[ ./-][0-9]{4}")
FEATURES = 20


def features(span: str, before: str, after: str) -> list[int]:
    """Numbers of the features that hold for a whole segment and the characters beside it."""
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    shape = re.sub(r"[0-9]+", "9", span)
    email, ip, phone = bool(_EMAIL_SHAPE.fullmatch(span)), bool(_IP_SHAPE.fullmatch(span)), bool(_PHONE_SHAPE.fullmatch(span))
    tests = (
        True, email, "@" in span and not email, ip and all(map(_octet, groups)), ip and not all(map(_octet, groups)),
        len(groups) == 4 and not ip, 16 <= len(digits) <= 19 and luhn(digits), 16 <= len(digits) <= 19 and not luhn(digits),
        len(digits) > 19, phone, 8 <= len(digits) <= 15 and not phone and span[0] == "+", span[0] == "+",
        len(digits) <= 15 and not (phone or ip or email or span[0] == "+"), len(groups) > 5,
        bool(re.search(r"[A-Za-z]", span)) and not email, set(shape) <= set("9 .-/()+[]") and "9" in shape,
        before.isalnum() or after.isalnum(), before in "+.-/@" and before != "", after in ".-/@" and after != "" and len(after) == 1,
        len(groups) > 1 and len(digits) >= 16 and len({len(g) for g in groups}) <= 2)
    return [k for k, x in enumerate(tests) if x]


class Region:
    """Tokens of a stretch of text and the features of its candidate segments."""

    def __init__(self, text: str, lo: int, hi: int):
        piece = text[lo:hi]
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(piece)]
        self.n, self.lo, self.tokens = len(tokens), lo, tokens
        self.segments: list[tuple[int, int]] = []
        rows = []
        for i, (s, _) in enumerate(tokens):
            if not (piece[s].isalnum() or piece[s] in "+("):
                continue
            for j in range(i, min(len(tokens), i + LONGEST)):
                e = tokens[j][1]
                if not piece[e - 1].isalnum():
                    continue
                span = piece[s:e]
                if len(_DIGIT.findall(span)) < LEAST_DIGITS and not _AT.search(span) and not _IP_SHAPE.fullmatch(span):
                    continue
                self.segments.append((i, j + 1))
                rows.append(features(span, piece[s - 1:s] or text[max(0, lo + s - 1):lo + s], piece[e:e + 1] or text[lo + e:lo + e + 1]))
        self.x = np.zeros((len(rows), FEATURES))
        for k, r in enumerate(rows):
            self.x[k, r] = 1

    def by_end(self) -> list[list[int]]:
        ends: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(self.segments):
            ends[j].append(k)
        return ends

    def decode(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation: ``(kind, start, end)`` in the text; tokens outside spans score 0."""
        if not len(self.segments):
            return []
        scores = self.x @ w
        kinds = scores.argmax(axis=1)
        best, back = np.zeros(self.n + 1), [-1] * (self.n + 1)
        for j, ks in enumerate(self.by_end()):
            if j:
                best[j] = best[j - 1]
            for k in ks:
                v = best[self.segments[k][0]] + scores[k, kinds[k]]
                if v > best[j]:
                    best[j], back[j] = v, k
        out, j = [], self.n
        while j > 0:
            if back[j] < 0:
                j -= 1
                continue
            i, _ = self.segments[back[j]]
            out.append((int(kinds[back[j]]), self.lo + self.tokens[i][0], self.lo + self.tokens[j - 1][1]))
            j = i
        return out[::-1]

    def gradient(self, w: np.ndarray, gold: list[tuple[int, int, int]]) -> np.ndarray | None:
        """Of the log likelihood of the gold spans; None if a gold span is no candidate."""
        scores = self.x @ w
        place = {(self.lo + self.tokens[i][0], self.lo + self.tokens[j - 1][1]): k for k, (i, j) in enumerate(self.segments)}
        if any((s, e) not in place for _, s, e in gold):
            return None
        forward, backward = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        forward[0] = backward[self.n] = 0.0
        total = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        for j, ks in enumerate(self.by_end()):
            if j:
                forward[j] = forward[j - 1]
            for k in ks:
                forward[j] = np.logaddexp(forward[j], forward[self.segments[k][0]] + total[k])
        starts: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, _) in enumerate(self.segments):
            starts[i].append(k)
        for i in range(self.n - 1, -1, -1):
            backward[i] = backward[i + 1]
            for k in starts[i]:
                backward[i] = np.logaddexp(backward[i], backward[self.segments[k][1]] + total[k])
        expected = np.zeros_like(scores)
        for k, (i, j) in enumerate(self.segments):
            expected[k] = -np.exp(forward[i] + backward[j] + scores[k] - forward[self.n])
        for kind, s, e in gold:
            expected[place[s, e], kind] += 1
        return self.x.T @ expected


# --- fitting ------------------------------------------------------------------------------------

SAMPLE = 400        # windows of the corpus that the field is fitted on
DOCUMENTS = 200     # documents looked at for each window
EPOCHS = 12
CONTEXT = 40
L2 = 1e-3


def _variants(kind: int, span: str) -> list[str]:
    """Forms of a base match that the base misses."""
    if kind == 0:
        name, host = span.split("@", 1)
        return [f"{name} (at) {host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} @ {host}"]
    if kind == 1:
        return [span.replace(".", "[.]"), span.replace(".", " . ")]
    digits = "".join(_DIGIT.findall(span))
    if kind == 2:
        return [".".join(digits[k:k + 4] for k in range(0, len(digits), 4)), "/".join(digits[k:k + 4] for k in range(0, len(digits), 4))]
    d = digits[-10:]
    return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}"]


def _decoys(kind: int, span: str) -> list[str]:
    """Forms like a base match that are no personal data: dates, versions, book and order numbers."""
    digits = "".join(_DIGIT.findall(span))
    if kind == 1:
        return [span.split(".", 1)[0] + ".0.1." + digits[:4], "9" + span.replace(".", ".9")]
    if kind == 2:
        return [digits[:-1] + str((int(digits[-1]) + 1) % 10), digits + digits[:8]]
    if kind == 3 and len(digits) >= 10:
        d = digits[-10:]
        return [f"20{d[:2]}-{d[2:4]}-{d[4:6]} {d[6:8]}:{d[8:10]}", f"20{d[:2]}-{d[2:4]}-{d[4:6]}", f"{d[:2]}/{d[2:4]}/20{d[4:6]}",
                f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", d, d[:8], f"{d[0]}.{d[1]}{d[2:]}", f"{d[:4]} {d[4:8]}"]
    return []


def _windows(text: pa.Array) -> pa.Array:
    """Stretches around base matches and around other regions."""
    out = []
    for t in text.to_pylist():
        mine = []
        for lo, hi in regions(t or ""):
            mine.append(t[max(0, lo - CONTEXT):hi + CONTEXT])
        out.append(mine)
    return pa.array(out, pa.list_(pa.string()))


def fit(windows: list[str]) -> np.ndarray | None:
    """Weights by feature and kind, or None if no window holds a base match."""
    cases = []

    def add(text: str, s: int, e: int, extra: list[tuple[int, int, int]]) -> None:
        """The region about ``s`` to ``e``, with its base spans outside these and the extra ones."""
        spans = [g for g in base_spans(text) if g[2] <= s or g[1] >= e] + extra
        for lo, hi in regions(text):
            if lo < e and hi > s:
                inside = sorted((g for g in spans if g[1] < hi and g[2] > lo), key=lambda g: g[1])
                lo, hi = min([lo, *(g[1] for g in inside)]), max([hi, *(g[2] for g in inside)])
                if all(a[2] <= b[1] for a, b in zip(inside, inside[1:])):
                    cases.append((Region(text, lo, hi), inside))

    for w in windows:
        for lo, hi in regions(w):
            add(w, lo, hi, [g for g in base_spans(w) if g[1] < hi and g[2] > lo])
        for kind, s, e in base_spans(w):
            for forms, is_kind in ((_variants(kind, w[s:e]), True), (_decoys(kind, w[s:e]), False)):
                for form in forms:
                    to = s + len(form)
                    add(w[:s] + form + w[e:], s, to, [(kind, s, to)] if is_kind else [])
    if not any(gold for _, gold in cases):
        return None
    w, seen = np.zeros((FEATURES, len(KINDS))), np.full((FEATURES, len(KINDS)), 1e-6)
    w[0] = -4.0
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in order.permutation(len(cases)):
            region, gold = cases[k]
            g = region.gradient(w, gold) if len(region.segments) else None
            if g is not None:
                g = g - L2 * w
                seen += g * g
                w += 0.5 * g / np.sqrt(seen)
    return w


def model(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Fit on ``sample`` windows of the corpus, the first in the order of their hashes.

    Only ``DOCUMENTS`` times as many documents, chosen by hash, are asked for windows, so that what
    the tasks send does not grow with the corpus.
    """
    share = int(1_000_000 * min(1.0, DOCUMENTS * sample / max(1, docs.count())))
    some = docs.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < share)
    found = some.filter(F.col("text").rlike("[0-9@]")).select(F.explode(arrow_udf(_windows, "array<string>")("text")).alias("w")).distinct()
    rows = found.orderBy(F.xxhash64("w"), "w").limit(sample).collect()  # bounded by the parameter
    return fit([r["w"] for r in rows])


# --- spans of a corpus ----------------------------------------------------------------------------

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
SPANS_DDL = "array<struct<kind:int,start:int,end:int,base:boolean>>"


def all_spans(text: str, weights: np.ndarray | None) -> list[tuple[int, int, int, bool]]:
    base = base_spans(text)
    out = [(*b, True) for b in base]
    if weights is not None:
        for lo, hi in regions(text):
            inside = [b for b in base if b[1] < hi and b[2] > lo]
            rest, at = "", lo
            for _, s, e in sorted(inside, key=lambda b: b[1]):
                rest, at = rest + text[at:max(at, s)], max(at, e)
            rest += text[at:hi]
            if len(_DIGIT.findall(rest)) < LEAST_DIGITS and not _AT.search(rest) and not _IP_SHAPE.search(rest):
                continue
            for kind, s, e in Region(text, lo, hi).decode(weights):
                if all(e <= b[1] or s >= b[2] for b in inside):
                    out.append((kind, s, e, False))
    return sorted(out)


def spans(text: str | Column, weights: np.ndarray | None) -> Column:
    """All spans of a text, by kind and start, in code points."""
    def run(texts: pa.Array) -> pa.Array:
        names = SPAN.names
        return pa.array([[dict(zip(names, s)) for s in all_spans(t or "", weights)] for t in texts.to_pylist()], pa.list_(SPAN))

    return arrow_udf(run, SPANS_DDL)(text)


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``pii``: the spans of each text."""
    return docs.withColumn("pii", spans("text", model(docs, sample)))


def masked(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; null stays null."""
    weights = model(docs, sample)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t:
                found, at, pieces = sorted(all_spans(t, weights), key=lambda s: (s[1], -s[2])), 0, []
                for kind, s, e, _ in found:
                    if s >= at:
                        pieces += [t[at:s], f"[{KINDS[kind]}]"]
                    at = max(at, e)
                t = "".join([*pieces, t[at:]]) if pieces else t
            out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn("text", arrow_udf(run, "string")("text"))
