"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for what they miss.

Patterns find e-mail addresses, IP addresses, card and phone numbers in their usual forms (:func:`base_spans`). In
the text between them a semi-Markov field looks for the same four kinds in other forms, such as ``name (at) mail (dot)
com``, ``10[.]0[.]0[.]1``, ``(826) 555-4081`` or a card number with dots. Candidate segments are runs of at most
``MOST_GROUPS`` groups of digits, and the surroundings of an @ or a bracketed "at". A segment is scored as a whole,
by features such as its digit groups, its check digit, its separators and what stands beside it; dynamic programming
over segments chooses boundaries and kinds together (the best path), and forward and backward sums give the
probability of each chosen segment, of which the sure ones are added. Text between candidates is outside by
definition and costs nothing, so only clusters of overlapping candidates are decoded.

The field learns in one task from about ``FIT_DOCS`` documents (drawn by a hash of the id, of at most
``FIT_CHARS`` characters each): the spans of the patterns are its examples, rewritten in other forms as well and
spoiled as counter-examples (a wrong check digit, a part over 255, too few digits). Only its weights, a few hundred
rows, reach the driver. Every document is searched whole; texts without a digit, an @ or a bracketed "at" cannot hold
a span and are not sent to Python.

Defined cases: a null text is empty and has no spans; texts may be of any length (all scans are linear); with no
example in the sample nothing is added to the patterns; repeated rows give repeated rows; an empty table gives
none. Other columns are ignored. Spans are in code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Documents the field learns from, about, their greatest length, and passes over the examples.
FIT_DOCS, FIT_CHARS, EPOCHS = 4000, 20_000, 6
#: Digit groups of a segment, labels of a domain, characters before an @ that are looked at.
MOST_GROUPS, MOST_LABELS, MOST_LOCAL = 8, 6, 64
#: Segments that are decoded together.
MOST_SEGMENTS = 2000
#: Probability from which a segment is added.
SURE = 0.9

Span = tuple[int, int, int]  # start, kind, end

#: Texts without this hold no span.
TRIGGER = r"[0-9@]|(?i)[(\[{]\x20?at\x20?[)\]}]"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs: a digit run is passed once, whatever follows it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for at, c in enumerate(reversed(digits)):
        v = int(c) * (1 + at % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, done)
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, EMAIL, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, by start and then kind."""
    spans = list(_emails(text))
    for m in _IP.finditer(text):
        if all(map(_byte, m.group().split("."))):
            spans.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append((m.start(), PHONE, m.end()))
    return sorted(spans)


# -- candidate segments -------------------------------------------------------

_NUMBERS = re.compile(r"[0-9]++(?:(?:[ ./()+-]|\[\.\]|\(\.\)){1,3}+[0-9]++)*+")
_AT = re.compile(r" ?(?:@|[(\[{] ?at ?[)\]}]) ?", re.IGNORECASE)
_LABELS = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[A-Za-z0-9-]+)*", re.IGNORECASE)
_DOT = re.compile(r" ?(?:\.|[(\[{] ?dot ?[)\]}]) ?", re.IGNORECASE)


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    email: bool
    features: tuple[str, ...]


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "none"
    c = text[at]
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def _number(text: str, start: int, end: int, groups: list[str]) -> Segment:
    digits = "".join(groups)
    separators = "".join(sorted(set(_DIGITS.sub("", text[start:end]))))
    quad = len(groups) == 4 and all(map(_byte, groups)) and "." in separators
    check = f"{len(digits)} {luhn(digits)}" if 12 <= len(digits) <= 19 else "none"
    shape = "-".join(str(min(9, len(g))) for g in groups)
    return Segment(start, end, False, (
        "number", f"digits {min(20, len(digits))}", f"shape {shape}", f"groups {len(groups)}", f"between {separators}",
        f"check {check}", f"luhn {check[-4:]}", f"quad {quad}", f"quad {quad} {separators}", f"first {text[start] in '+('}",
        f"left {_side(text, start - 1)}", f"right {_side(text, end)}", f"farther left {_side(text, start - 2)}",
        f"farther right {_side(text, end + 1)}"))


def _number_segments(text: str, start: int, end: int) -> Iterator[Segment]:
    for run in _NUMBERS.finditer(text, start, end):
        at = [m.span() for m in _DIGITS.finditer(text, run.start(), run.end())]
        for i, (first, _) in enumerate(at):
            count, ends = 0, []
            for j in range(i, min(len(at), i + MOST_GROUPS)):
                count += at[j][1] - at[j][0]
                if count > 24:
                    break
                if count < 7 and not (j == i + 3 and count >= 4):
                    continue
                ends.append((at[j][1], [text[a:b] for a, b in at[i:j + 1]]))
            starts = [first - 1, first] if first > start and text[first - 1] in "+(" else [first]
            yield from (_number(text, s, e, groups) for s in starts for e, groups in ends)


def _email_segments(text: str, start: int, end: int) -> Iterator[Segment]:
    for mark in _AT.finditer(text, start, end):
        local = _local_start(text, mark.start(), max(start, mark.start() - MOST_LOCAL))
        domain = _LABELS.match(text, mark.end(), min(end, mark.end() + 256))
        if local == mark.start() or domain is None:
            continue
        ends = [m.start() for m in _DOT.finditer(text, domain.start(), domain.end())][1:] + [domain.end()]
        for n, stop in enumerate(ends[:MOST_LABELS]):
            last = re.split(r"[^A-Za-z0-9-]+", text[domain.start():stop])[-1]
            yield Segment(local, stop, True, (
                "mail", f"plain at {mark.group() == '@'}", f"spaced at {mark.group().strip() == '@'}",
                f"dots {len(_DOT.findall(text, domain.start(), stop)) > 0}", f"labels {n}", f"all labels {stop == domain.end()}",
                f"last alphabetic {last.isalpha()}", f"last {min(5, len(last))}", f"spaced dot {' ' in text[domain.start():stop]}",
                f"left {_side(text, local - 1)}", f"right {_side(text, stop)}", f"local {min(4, mark.start() - local)}"))


def clusters(text: str, start: int = 0, end: int | None = None) -> Iterator[list[Segment]]:
    """Candidates within a part of the text, those that overlap or touch together.

    A cluster of over ``MOST_SEGMENTS`` comes in parts, so that memory stays bounded; the part on the left
    decides what crosses the joint.
    """
    end = len(text) if end is None else end
    held: list[Segment] = []
    reach = -1
    for s in heapq.merge(_number_segments(text, start, end), _email_segments(text, start, end), key=lambda s: s.start):
        if held and (s.start > reach or len(held) >= MOST_SEGMENTS and s.start > held[-1].start):
            yield held
            held, reach = [], -1
        held.append(s)
        reach = max(reach, s.end)
    if held:
        yield held


# -- the field ----------------------------------------------------------------

LABELS = 1 + len(KINDS)  # outside, then the kinds
_OFF = -1e30


class Lattice:
    """Paths over one cluster: nodes are the boundaries of its segments, outside edges join neighbours."""

    def __init__(self, segments: list[Segment]):
        nodes = sorted({p for s in segments for p in (s.start, s.end)})
        at = {p: i for i, p in enumerate(nodes)}
        self.segments, self.size = segments, len(nodes)
        self.start = np.array([at[s.start] for s in segments])
        self.end = np.array([at[s.end] for s in segments])
        self.ending = [np.flatnonzero(self.end == i) for i in range(self.size)]
        self.starting = [np.flatnonzero(self.start == i) for i in range(self.size)]
        self.allowed = np.array([[s.email, not s.email, not s.email, not s.email] for s in segments])

    def scores(self, weights: dict[str, np.ndarray]) -> np.ndarray:
        none = np.zeros(len(KINDS))
        raw = np.array([sum((weights.get(f, none) for f in s.features), none) for s in self.segments])
        return np.where(self.allowed, raw, _OFF)

    def forward(self, scores: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha = np.full((self.size, LABELS), _OFF)
        into = np.empty_like(alpha)
        alpha[0, 0] = 0
        for i in range(self.size):
            if i:
                alpha[i, 0] = into[i - 1, 0]
                if len(k := self.ending[i]):
                    alpha[i, 1:] = np.logaddexp.reduce(into[self.start[k], 1:] + scores[k], axis=0)
            into[i] = np.logaddexp.reduce(alpha[i][:, None] + steps, axis=0)
        return alpha, into

    def marginals(self, scores: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log of the sum over paths, probability of each segment and kind, expected steps between labels."""
        alpha, into = self.forward(scores, steps)
        beta, ahead = np.zeros_like(alpha), np.full_like(alpha, _OFF)
        for i in range(self.size - 2, -1, -1):
            ahead[i, 0] = beta[i + 1, 0]
            if len(k := self.starting[i]):
                ahead[i, 1:] = np.logaddexp.reduce(scores[k] + beta[self.end[k], 1:], axis=0)
            beta[i] = np.logaddexp.reduce(steps + ahead[i], axis=1)
        total = float(np.logaddexp.reduce(alpha[-1]))
        inner = slice(0, self.size - 1)
        moved = np.exp(alpha[inner, :, None] + steps + ahead[inner, None, :] - total).sum(0)
        return total, np.exp(into[self.start, 1:] + scores + beta[self.end, 1:] - total), moved

    def best(self, scores: np.ndarray, steps: np.ndarray) -> list[tuple[int, int]]:
        """Segment and kind along the best path."""
        value = np.full((self.size, LABELS), _OFF)
        value[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in range(1, self.size):
            for k, y in [(-1, 0)] + [(int(k), y) for k in self.ending[i] for y in range(1, LABELS) if self.allowed[k, y - 1]]:
                s = i - 1 if k < 0 else int(self.start[k])
                before = value[s] + steps[:, y] + (0 if k < 0 else scores[k, y - 1])
                if (top := before.max()) > value[i, y]:
                    value[i, y] = top
                    back[i, y] = s, int(before.argmax()), k
        path, at = [], (self.size - 1, int(value[-1].argmax()))
        while at in back:
            s, y, k = back[at]
            if k >= 0:
                path.append((k, at[1] - 1))
            at = s, y
        return path[::-1]


@dataclass
class Field:
    weights: dict[str, np.ndarray]
    steps: np.ndarray

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Sure segments between the spans of the patterns."""
        if not self.weights:
            return []
        out, at, done = [], 0, 0
        # Beside outside a segment of a kind can gain so much from the steps at most; without odds of its own it cannot be sure.
        gain = (self.steps[:, 1:] - self.steps[:, :1]).max(0) + (self.steps[1:] - self.steps[:1]).max(1)
        least = math.log(SURE / (1 - SURE)) - gain
        for start, stop in [*((s, e) for s, _, e in base), (len(text), len(text))]:
            for cluster in clusters(text, at, start) if start > at else ():
                grid = Lattice(cluster)
                scores = grid.scores(self.weights)
                path = grid.best(scores, self.steps) if (scores >= least).any() else []
                share = grid.marginals(scores, self.steps)[1] if path else None
                for k, y in path:
                    if share[k, y] >= SURE and cluster[k].start >= done:
                        done = cluster[k].end
                        out.append((cluster[k].start, y, done))
            at = max(at, stop)
        return out


def _respelled(kind: int, found: str) -> tuple[list[str], list[str]]:
    """Other forms of a span, and forms of it that are none."""
    groups = _DIGITS.findall(found)
    digits = "".join(groups)
    if kind == EMAIL:
        local, domain = found.rsplit("@", 1)
        return [f"{local} (at) {domain}", f"{local}[at]{domain}", f"{local} @ {domain}",
                f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} (at) {domain.replace('.', '(dot)')}"], [
                f"{local} (at) {domain.split('.')[0]}", f"{local} @"]
    if kind == IP:
        return ["[.]".join(groups), "(.)".join(groups)], [
            ".".join(groups[:3]), "[.]".join([str(int(groups[0]) + 256), *groups[1:]]), "-".join(groups), " ".join(groups)]
    if kind == CARD:
        four = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        bad = [wrong[i:i + 4] for i in range(0, len(wrong), 4)]
        return [".".join(four), "/".join(four)], [wrong, " ".join(bad), "-".join(bad), ".".join(bad), "/".join(bad), digits[:9], digits[:12]]
    area, middle, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}", f"{area} {middle} {last}",
            f"00{digits[:-10]} {area} {middle} {last}", f"+{digits[:-10]}/{area}/{middle}/{last}"], [
            f"{middle}{last}", f"{area}{middle}", f"{digits}{last}", f"20{middle[:2]}-{area[:2]}-{last[:2]} {last}",
            f"{area}.{middle}", f"{digits[-10:]}"]


def examples(text: str) -> Iterator[tuple[list[Segment], set[Span]]]:
    """Clusters of a text with the spans that are right in them, also of its spans respelled and spoiled."""
    gold, end = [], 0
    for s in base_spans(text):
        if s[0] >= end:
            gold.append(s)
            end = s[2]
    for cluster in clusters(text):
        have = {(s.start, s.end) for s in cluster}
        low, high = cluster[0].start, max(s.end for s in cluster)
        here = {g for g in gold if low <= g[0] and g[2] <= high}
        if all((g[0], g[2]) in have for g in here):
            yield cluster, here
    for start, kind, end in gold:
        left, right = text[max(0, start - 20):start], text[end:end + 20]
        good, bad = _respelled(kind, text[start:end])
        for form, right_one in [(f, True) for f in good] + [(f, False) for f in bad]:
            span = len(left), kind, len(left) + len(form)
            for cluster in clusters(left + form + right):
                if any(s.start < span[2] and s.end > span[0] for s in cluster):
                    held = any((s.start, s.end) == (span[0], span[2]) for s in cluster)
                    if held or not right_one:
                        yield cluster, {span} if right_one else set()


def fit(texts: list[str], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Gradient steps on the log-likelihood of the right paths, one cluster at a time."""
    found = [(Lattice(c), g) for t in texts for c, g in examples(t)]
    weights: dict[str, np.ndarray] = {}
    steps, seen = np.zeros((LABELS, LABELS)), np.full((LABELS, LABELS), 1e-8)
    if not any(g for _, g in found):
        return Field({}, steps)
    squares: dict[str, np.ndarray] = defaultdict(lambda: np.full(len(KINDS), 1e-8))
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        for at in draw.permutation(len(found)):
            grid, gold = found[at]
            right, path = np.zeros((len(grid.segments), len(KINDS))), {}
            for start, kind, end in gold:
                k = next(k for k, s in enumerate(grid.segments) if (s.start, s.end) == (start, end))
                right[k, kind], path[int(grid.start[k])] = 1, (int(grid.end[k]), 1 + kind)
            _, share, moved = grid.marginals(grid.scores(weights), steps)
            node, label, taken = 0, 0, np.zeros_like(steps)
            while node < grid.size - 1:
                after, to = path.get(node, (node + 1, 0))
                taken[label, to] += 1
                node, label = after, to
            slope = right - share
            for k in np.flatnonzero(np.abs(slope).max(1) > 1e-6):
                for f in grid.segments[k].features:
                    squares[f] += slope[k] ** 2
                    w = weights.setdefault(f, np.zeros(len(KINDS)))
                    w += rate * (slope[k] - decay * w) / np.sqrt(squares[f])
            back = taken - moved
            back[0, 0] = 0  # outside after outside costs nothing, so runs of it are one edge
            seen += back ** 2
            steps += rate * (back - decay * steps) / np.sqrt(seen)
            steps[0, 0] = 0
    return Field(weights, steps)


# -- on Spark -----------------------------------------------------------------

def _searchable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("text"))


def train(docs: DataFrame) -> Field:
    """Learn in one task from the documents that a hash of the id draws."""
    share = F.pmod(F.xxhash64("doc_id"), F.lit(10**9)) < F.lit(int(10**9 * min(1.0, FIT_DOCS / max(1, docs.count()))))
    drawn = _searchable(docs.where(share & (F.length("text") <= FIT_CHARS))).where("text is not null")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted(t for b in batches for t in b.column(0).to_pylist())
        field = fit(texts)
        rows = [(f, *w) for f, w in field.weights.items()] + [(f"step {i}", *row[1:]) for i, row in enumerate(field.steps)]
        rows += [(f"step out {i}", *field.steps[i, :1], 0.0, 0.0, 0.0) for i in range(LABELS)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["feature", *KINDS])

    rows = drawn.select("text").repartition(1).mapInArrow(
        learned, "feature string, " + ", ".join(f"{k} double" for k in KINDS)).collect()
    table = {r.feature: np.array(r[1:]) for r in rows}
    steps = np.zeros((LABELS, LABELS))
    for i in range(LABELS):
        if f"step {i}" in table:
            steps[i, 1:], steps[i, 0] = table.pop(f"step {i}"), table.pop(f"step out {i}")[0]
    return Field(table, steps)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every document.

    The counts and the digest are those of the patterns; ``spans`` has the added ones as well.
    """
    model = train(docs) if field is None else field
    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType)
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")
    arrow = to_arrow_schema(schema)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                t = text.as_py() or ""
                base = base_spans(t)
                more = model.added(t, base) if t else []
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            columns = zip(*rows) if rows else [[]] * (len(KINDS) + 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return _searchable(docs).mapInArrow(searched, schema)
