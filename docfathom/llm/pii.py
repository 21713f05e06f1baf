"""Personal data: fixed patterns, and weak supervision that adds spans.

base_spans() finds e-mail addresses, IPv4 addresses, payment cards and phone numbers by fixed rules. Beyond them,
candidates() proposes looser spans (secrets, loosely written addresses and numbers). Regex, gazetteer and context
labelers vote yes, no or nothing on each; expectation-maximisation over the counts of all vote patterns estimates how
far each labeler can be trusted, and a logistic span classifier is trained on the resulting soft labels. Its yes-spans
that meet no base span are added.

What is learned depends on a candidate's signature only: kind, votes and a few coarse features, under MAX_SIGNATURES
possibilities. So the corpus is counted in one map with a sum per signature, and a table of bounded size comes to the
driver, whatever the input.

Defined results: null text is empty and has no span; long texts are scanned in linear time; rows that repeat get
equal answers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds in their order in a span list; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "secret", "account", "contact")
BASE = KINDS[:4]
MIN_CARD, MAX_CARD, MIN_PHONE, MAX_PHONE = 14, 19, 10, 15

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive, and not from within digits, so that long runs are read once; the matches are those of the plain form.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


class Span(NamedTuple):
    start: int
    kind: str
    end: int


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail a check are dropped."""
    found = []
    at, used = text.find("@"), 0
    while at >= 0:
        start = at
        while start > used and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            used = domain.end()
            found.append(Span(start, "email", used))
        at = text.find("@", max(at + 1, used))
    for m in IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):
            found.append(Span(m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= MIN_CARD and MIN_CARD <= len(d := digits_of(m[0])) <= MAX_CARD and luhn(d):
            found.append(Span(m.start(), "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if MIN_PHONE <= len(digits_of(m[0])) <= MAX_PHONE:
                found.append(Span(m.start(), "phone", m.end()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


# Candidates: kind, pattern. Each pattern begins where its class begins, so a run is read once.
CANDIDATES = (
    ("secret", re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{16,}=*")),
    ("account", re.compile(r"(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9](?:[ -]?[0-9]){8,})(?![0-9A-Za-z])")),
    ("contact", re.compile(r"(?<![0-9A-Za-z+])(?:\(?[0-9]{2,4}\)?[ .-]){2,4}[0-9]{2,4}(?![0-9A-Za-z])|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9.-]{1,64}")),
)
# Gazetteers, lower case.
SECRET_WORDS = frozenset("token secret password passwd pwd apikey api_key access_key key bearer auth credential".split())
CONTACT_WORDS = frozenset("call phone tel telephone mobile fax whatsapp contact email mail reach".split())
ACCOUNT_WORDS = frozenset("iban account ssn social card visa passport licence tax bank".split())
SECRET_PREFIXES = ("AKIA", "ASIA", "sk_", "pk_", "ghp_", "xox", "eyJ", "api_", "token_", "secret_")
GAZETTEERS = {"secret": SECRET_WORDS, "contact": CONTACT_WORDS, "account": ACCOUNT_WORDS}
WORD = re.compile(r"[A-Za-z_]+")

LABELERS = 6
#: kinds beyond the base x votes x length x digit share x letter case x left x right.
MAX_SIGNATURES = 3 * 3**LABELERS * 4 * 4 * 4 * 3 * 3


def votes(kind: str, span: str, left: str, right: str) -> list[int]:
    """1 yes, -1 no, 0 nothing, from each labeler: two on the pattern, two on gazetteers, two on the context."""
    digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    before = [w.lower() for w in WORD.findall(left)[-3:]]
    strict = {
        "secret": 1 if digits >= 3 and letters >= 3 else -1,
        "account": 1 if re.fullmatch(r"[A-Z]{2}[0-9]{2}.*|[0-9]{3}-[0-9]{2}-[0-9]{4}", span) else 1 if digits in (9, 16) else 0,
        "contact": 1 if 8 <= digits <= 13 or "at" in span else -1,
    }[kind]
    mixed = {
        "secret": 1 if re.fullmatch(r"[0-9a-f]{32,}", span) else -1 if span.isalpha() or "-" in span and letters > 4 * digits else 0,
        "account": -1 if MIN_CARD <= digits <= MAX_CARD and not luhn(digits_of(span)) else 0,
        "contact": -1 if span.count(".") > 2 else 0,
    }[kind]
    listed = 1 if any(w in GAZETTEERS[kind] for w in before) else 0
    prefixed = 1 if kind == "secret" and span.startswith(SECRET_PREFIXES) else 0
    assigned = 1 if re.search(r"""[:=]\s*["']?$""", left) else -1 if kind == "secret" and not listed else 0
    apart = -1 if left[-1:].isalnum() or right[:1].isalnum() or left[-1:] in "#$%&/" and left else 0
    return [strict, mixed, listed, prefixed, assigned, apart]


def signature(kind: str, span: str, left: str, right: str) -> int:
    """Kind, votes and features as one number under MAX_SIGNATURES."""
    n = len(span)
    digits, upper = sum(c.isdigit() for c in span), sum(c.isupper() for c in span)
    side = lambda c: 0 if not c or c.isspace() else 1 if c in "\"'=:([<" else 2
    parts = [(KINDS.index(kind) - len(BASE), 3), *((v + 1, 3) for v in votes(kind, span, left, right)),
             (min(3, n // 12), 4), (min(3, 4 * digits // n), 4), (min(3, 4 * upper // n), 4), (side(left[-1:]), 3), (side(right[:1]), 3)]
    out = 0
    for value, size in parts:
        out = out * size + value
    return out


def unpack(code: int) -> list[int]:
    sizes = [3, *[3] * LABELERS, 4, 4, 4, 3, 3]
    out = []
    for size in reversed(sizes):
        code, value = divmod(code, size)
        out.append(value)
    return out[::-1]


def candidates(text: str, base: list[Span]) -> list[tuple[Span, int]]:
    """Spans that meet no base span and no earlier candidate, with their signatures."""
    found: list[tuple[Span, int]] = []
    if not re.search(r"[0-9]|[\[(]at[\])]", text):
        return found
    starts, ends = [], []  # of what is taken, apart and in order
    for s in sorted(base):
        if ends and s.start <= ends[-1]:
            ends[-1] = max(ends[-1], s.end)
        else:
            starts.append(s.start)
            ends.append(s.end)
    for kind, pattern in CANDIDATES:
        for m in pattern.finditer(text):
            span = m[0]
            if kind == "secret" and (span.isalpha() or not any(c.isdigit() for c in span)):
                continue
            at = bisect_left(ends, m.start() + 1)
            if at < len(starts) and starts[at] < m.end():
                continue
            left, right = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 8]
            found.append((Span(m.start(), kind, m.end()), signature(kind, span, left, right)))
            starts.insert(at, m.start())
            ends.insert(at, m.end())
    return found


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of yes for each vote pattern: labelers independent given the truth, majority vote to begin with."""
    post = 1 / (1 + np.exp(-2.0 * patterns.sum(axis=1) + 0.5))
    for _ in range(rounds):
        prior = np.clip((post * counts).sum() / counts.sum(), 0.01, 0.99)
        odds = np.full(len(patterns), np.log(prior / (1 - prior)))
        for k in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                here = patterns[:, k] == v
                yes = ((post * counts)[here].sum() + 1) / ((post * counts).sum() + 3)
                no = (((1 - post) * counts)[here].sum() + 1) / (((1 - post) * counts).sum() + 3)
                odds[here] += np.log(yes / no)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def features(codes: list[int]) -> np.ndarray:
    sizes = [3, *[3] * LABELERS, 4, 4, 4, 3, 3]
    out = np.zeros((len(codes), sum(sizes) + 1))
    out[:, -1] = 1
    for row, code in enumerate(codes):
        at = 0
        for size, value in zip(sizes, unpack(code), strict=True):
            out[row, at + value] = 1
            at += size
    return out


def train(table: list[tuple[int, int]], rounds: int = 200) -> dict[int, float]:
    """Probability of each signature seen: EM per kind, then weighted logistic regression by Newton steps."""
    if not table:
        return {}
    table = sorted(table)
    codes, counts = [c for c, _ in table], np.array([n for _, n in table], float)
    parts = np.array([unpack(c) for c in codes])
    soft = np.zeros(len(codes))
    for kind in range(3):
        here = parts[:, 0] == kind
        if here.any():
            soft[here] = em(parts[here, 1 : 1 + LABELERS] - 1, counts[here])
    x, weight = features(codes), np.zeros(features(codes[:1]).shape[1])
    scale = counts / counts.sum() * min(counts.sum(), 1000)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        gradient = x.T @ (scale * (p - soft)) + 0.1 * weight
        step = np.linalg.solve((x.T * (scale * p * (1 - p))) @ x + 0.1 * np.eye(x.shape[1]), gradient)
        weight -= step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
    return dict(zip(codes, p.tolist(), strict=True))


def learn(docs: DataFrame) -> dict[int, float]:
    """Counts of signatures over all texts; at most MAX_SIGNATURES rows reach the driver, a few hundred in practice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(code for _, code in candidates(text, base_spans(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").sum("n").collect()
    return train([(r[0], r[1]) for r in rows])


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans, n_added) for each row."""
    model = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                added = [s for s, code in candidates(text or "", base) if model.get(code, 0) >= least]
                kinds = Counter(s.kind for s in base)
                rows.append((*(kinds[k] for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(in_order(base + added)), len(added)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                                             names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])

    fields = ", ".join(["doc_id long", *(f"n_{k} long" for k in BASE), "base_sha256 string", "spans string", "n_added long"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, fields)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for s in in_order(spans):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
    return "".join([*out, text[at:]])
