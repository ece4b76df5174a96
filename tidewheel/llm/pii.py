"""Personal data: overlapping candidates of generous generators, judged by boosted trees.

Four kinds (email, ip, card, phone). The base spans follow fixed rules and are
always kept. The generators also propose what the rules miss: numbers inside
longer runs of digits, cards in groups by other separators, phones without a
plus, spelled-out addresses. Each proposal is described by its format (digits, groups,
separators, checksum) and context (neighbouring signs, cue words); trees grown on a bounded sample
of candidates give a probability. Right ones are base spans written as the base rules miss them
(no plus, spelled out, other separators), so the sign that the rules go by is no
feature; wrong ones are other extents of those, candidates without a cue word or plus, and sentence ends with an "at" put in. A
threshold per kind, set on held-back candidates, selects spans to add. A span
that overlaps a base span or a better one is not added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import boosting
from tidewheel.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Documents whose candidates the trees are grown on, those of the smallest hash of doc_id; and candidates at most of one kind.
MAX_SAMPLE_DOCS = 20_000
MAX_SAMPLE = 20_000
#: Share of right ones that a threshold must reach among held-back candidates, and the least probability.
PRECISION = 0.99
LEAST_PROBABILITY = 0.9

Span = tuple[str, int, int]

# Base rules; the look-behinds and possessive repeats keep them linear and don't change what they match.
_EMAIL_AT = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL_AT.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators of further candidates.
_LOOSE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+"
    r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}")
_DIGIT_RUN = re.compile(r"[0-9](?:[\x20.()/-]{0,2}[0-9]){6,}")
_GROUP = re.compile(r"[0-9]+")
_CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|contact|write|address)"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|addr|address)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|amex|credit|payment)"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax)"),
}
#: Digit groups of a run that one candidate may span; 19 digits can't have more.
_MOST_GROUPS = 19


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[re.Match[str]]:
    at = 0
    while True:
        # A match may begin right where the last one ended, inside a run of these signs.
        found = (_EMAIL_AT.match(text, at) if at else None) or _EMAIL.search(text, at)
        if not found:
            return
        yield found
        at = found.end()


def base_spans(text: str) -> list[Span]:
    """Spans by the fixed rules, leftmost and non-overlapping per kind, by kind and start."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", *m.span()) for m in _emails(text)]
    if "." in text:
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def candidates(text: str) -> Iterator[Span]:
    """Proposed spans, overlapping each other and the base ones."""
    if "@" in text or "(at)" in text or "[at]" in text:
        for m in _LOOSE_EMAIL.finditer(text):
            yield "email", *m.span()
    for run in _DIGIT_RUN.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, min(len(groups), i + _MOST_GROUPS)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                end = groups[j][1]
                if j - i == 3 and text.count(".", start, end) == 3 and end - start == digits + 3:
                    yield "ip", start, end
                if digits >= 13:
                    yield "card", start, end
                if 8 <= digits <= 15:
                    lead = start
                    while lead and text[lead - 1] in "+(":
                        lead -= 1
                    yield "phone", lead, end


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, start, end = span
    body = text[start:end]
    groups = [g for g in _GROUP.findall(body)]
    digits = "".join(groups)
    before, after = text[max(0, start - 1): start], text[end: end + 1]
    seps = set(re.sub(r"[0-9A-Za-z]", "", body))
    sizes = [len(g) for g in groups] or [0]
    around = text[max(0, start - 40): start]
    return [
        len(body), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        float(bool(digits) and luhn(digits)), float(sum(map(_byte, groups)) == len(groups)),
        len(seps), float("." in seps), float("-" in seps), float(" " in seps), float("+" in body), float("(" in body), float("@" in body),
        body.count("."), float(body[-4:].isalpha()), sum(c.isalpha() for c in body),
        float(before.isalnum()), float(after.isalnum()), float(before in ".-+/_@" and before != ""), float(after in "-/_@" and after != ""),
        float(before.isspace() or not before), float(after.isspace() or not after),
        float(text[max(0, start - 2): max(0, start - 1)].isdigit()), float(text[end + 1: end + 2].isdigit()), float(bool(_CUES[kind].search(around))),
    ]


@dataclass(frozen=True)
class Judge:
    """A calibrated model of one kind with its threshold."""

    model: boosting.Boosted
    threshold: float


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for text in batch.column("text"):
        yield text.as_py() or ""


_SPELLED = ((" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."))
_SENTENCE_END = re.compile(r"(?<!\S)([^\W\d_]{2,20})\x20([^\W\d_]{2,20}\.\x20[^\W\d_]{2,20})(?!\S)")
#: Signs kept on each side of a span that is written anew.
_AROUND = 60


def _respelled(text: str, span: Span) -> tuple[str, Span]:
    """A base span in a form that the base rules miss (an ip as it is), with the text around it."""
    kind, start, end = span
    body = text[start:end]
    if kind == "phone":
        body = body[1:]
    elif kind == "email":
        at, dot = _SPELLED[start % len(_SPELLED)]
        local, domain = body.rsplit("@", 1)
        body = local + at + domain.replace(".", dot)
    elif kind == "card":
        body = re.sub(r"[\x20-]", "./"[start % 2], body)
    lead = text[max(0, start - _AROUND): start]
    return lead + body + text[end: end + _AROUND], (kind, len(lead), len(lead) + len(body))


def lessons(text: str) -> Iterator[tuple[str, int, list[float]]]:
    """kind, label and description of candidates whose label is known by other signs than those described."""
    base = base_spans(text)
    for span in base:
        own, at = _respelled(text, span)
        for c in candidates(own):
            if c[0] == at[0] and c[1] < at[2] and at[1] < c[2]:
                yield c[0], int(c == at), describe(own, c)
    taken = _Taken(base)
    for c in candidates(text):
        cued = _CUES[c[0]].search(text[max(0, c[1] - 40): c[1]])
        # A cue word or a plus may stand by a right one that the base rules miss: that is no lesson.
        if not cued and text[c[1]] != "+" and not taken.meets(*c[1:]):
            yield c[0], 0, describe(text, c)
    for k, m in enumerate(islice(_SENTENCE_END.finditer(text), 4)):
        lead = text[max(0, m.start() - _AROUND): m.start()] + m[1]
        own = lead + (" (at) ", " @ ", " [at] ", "@ ")[k] + m[2] + text[m.end(): m.end() + _AROUND]
        for c in candidates(own):
            if c[0] == "email" and c[1] <= len(lead) < c[2]:
                yield c[0], 0, describe(own, c)


def sample(docs: DataFrame, max_docs: int = MAX_SAMPLE_DOCS, most: int = MAX_SAMPLE) -> pa.Table:
    """kind, label, described: lessons of the sampled documents."""
    place = F.xxhash64("doc_id")
    last = docs.select(place.alias("place")).orderBy("place").limit(max_docs).agg(F.max("place")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lesson for text in _texts(batch) for lesson in lessons(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "label", "described"])

    found = materialize(docs.filter(place <= F.lit(last)).select("text").mapInArrow(
        run, "kind string, label long, described array<double>"), "candidates")
    share = [found.filter((F.col("kind") == k) & (F.col("label") == v)).orderBy(F.xxhash64("described"), "described").limit(most // 2)
             for k in KINDS for v in (0, 1)]
    out = share[0]
    for more in share[1:]:
        out = out.union(more)
    return out.toArrow()


def judges(rows: pa.Table) -> dict[str, Judge]:
    """A judge of each kind that has right and wrong candidates enough; the others add no spans."""
    table = rows.to_pydict()
    found = {}
    for kind in KINDS:
        at = [i for i, k in enumerate(table["kind"]) if k == kind]
        if not at:
            continue
        x = np.array([table["described"][i] for i in at], "float64").reshape(len(at), -1)
        y = np.array([table["label"][i] for i in at], "float64")
        held = np.arange(len(at)) % 4 == 0
        if min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 5:
            continue
        model = boosting.calibrated(boosting.fit(x[~held], y[~held]), x[held], y[held])
        p = model.probability(x[held])
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        if len(good):
            found[kind] = Judge(model, max(LEAST_PROBABILITY, float(p[order][good[-1]])))
    return found


class _Taken:
    """Intervals that are in use, to ask whether a new one overlaps any of them."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1:]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def added_spans(text: str, base: list[Span], known: dict[str, Judge]) -> list[Span]:
    """Candidates over their threshold, best first, that overlap no kept span of any kind."""
    taken = _Taken(base)
    free: dict[str, list[Span]] = {}
    for c in candidates(text):
        if c[0] in known and not taken.meets(*c[1:]):
            free.setdefault(c[0], []).append(c)
    ranked = []
    for kind, spans in free.items():
        p = known[kind].model.probability(np.array([describe(text, s) for s in spans]))
        ranked += [(-q, s[1], -s[2], s) for q, s in zip(p.tolist(), spans, strict=True) if q >= known[kind].threshold]
    out = []
    for *_, span in sorted(ranked):
        if not taken.meets(*span[1:]):
            taken.add(*span[1:])
            out.append(span)
    return out


def by_kind(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, known: dict[str, Judge] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of ``docs`` (doc_id, text).

    The counts and the hash are of the base spans, ``spans`` has those and the
    added ones. A null or empty text has none. Positions are code points; repeated rows are reported
    each for itself. ``known`` defaults to judges grown on ``docs``.
    """
    docs = docs.select("doc_id", "text")
    known = judges(sample(docs)) if known is None else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in _texts(batch):
                base = base_spans(text)
                added = added_spans(text, base, known)
                kinds = [k for k, _, _ in base]
                row = [*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(by_kind(base + added)), len(added)]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(columns))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string, n_added long")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; spans that overlap go as one, under the kind listed first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
            merged[-1][0] = min(merged[-1][0], kind, key=KINDS.index)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, known: dict[str, Judge] | None = None) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by ``<KIND>``; null stays null, other columns stay as they are."""
    known = judges(sample(docs.select("doc_id", "text"))) if known is None else known
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column("text"):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    text = redact(text, base + added_spans(text, base, known))
                texts.append(text)
            yield batch.set_column(at, batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)
