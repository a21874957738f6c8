"""Personal data by weak supervision: base patterns, three families of labelers, a span model.

Base spans (e-mail, ip, card, phone) follow fixed patterns and checks and always stay.
Beside them, looser candidate patterns (phone numbers without a country sign, obfuscated
e-mails, keys and passwords) are voted on by labelers that may abstain:

* regex labelers: a strict shape of the candidate,
* gazetteer labelers: lists of key prefixes, domain endings and area forms,
* context labelers: words close before the candidate.

Expectation-maximisation over the counts of vote patterns in the whole corpus estimates how
reliable each labeler is for each kind, without labels; its posteriors then train a logistic span
classifier on shape features, which decides on every candidate. Votes and features are small
categories, so the whole corpus is summed up exactly in a few thousand counted patterns.

Defined results: null and empty texts have no spans; rows with equal ids are searched one by
one; a corpus without candidates trains a model that adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import ship

#: Kinds in the order in which equal starts are listed; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Classifier probability from which a candidate becomes a span.
ACCEPT = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """The check digit rule of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost e-mails, found from their @ so that long runs cost no more than their length."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    if not _ANY.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# Gazetteers and context words.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk_live_", "sk_test_", "xoxb-", "xoxp-", "AIza", "eyJ")
DOMAIN_ENDS = ("com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu")
PHONE_WORDS = ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "contact", "whatsapp")
MAIL_WORDS = ("mail", "e-mail", "email", "contact", "write", "correo", "courriel")
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "key", "apikey", "api_key", "credential", "auth")
PLAIN_WORDS = ("version", "license", "licence", "copyright", "isbn", "page", "chapter", "section", "figure", "table", "rfc")

_CANDIDATES = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++")),
    (3, re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    (4, re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{8,}+(?![A-Za-z0-9])")),
    (4, re.compile(r"(?<![A-Za-z0-9])(?:gh[opsu]_|glpat-|sk_live_|sk_test_|xox[bp]-|AIza|eyJ)[A-Za-z0-9_.-]{8,}+")),
    (4, re.compile(r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|token|secret|api_?key)(?: ?[=:] ?)\"?([^\s\"']{6,}+)")),
    (4, re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])")),
)
_DIGIT = re.compile(r"[0-9]")
_DOT = re.compile(r"[(\[ ]dot[)\] ]")
_SECRET_NAME = re.compile(r"[dDnNtTyY]\"? ?[=:]")

#: A cheap necessary condition for each candidate pattern, so that most texts cost one search.
_HINTS = (
    lambda t, digit: "dot" in t and _DOT.search(t),
    lambda t, digit: digit,
    lambda t, digit: "AKIA" in t or "ASIA" in t,
    lambda t, digit: any(k in t for k in ("gho_", "ghp_", "ghs_", "ghu_", "glpat-", "sk_live_", "sk_test_", "xoxb-", "xoxp-", "AIza", "eyJ")),
    lambda t, digit: ("=" in t or ":" in t) and _SECRET_NAME.search(t),
    lambda t, digit: True,
)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the looser patterns that touch no base span and no other candidate."""
    digit = _DIGIT.search(text) is not None
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # the furthest end so far
    out: list[tuple[int, int, int]] = []  # apart from each other, so their ends are in order too
    for (kind, pattern), hint in zip(_CANDIDATES, _HINTS, strict=True):
        if hint(text, digit):
            for m in pattern.finditer(text):
                s, e = m.span(1) if pattern.groups else m.span()
                at, own = bisect_left(starts, e), bisect_left(out, (e,))
                if (not at or reach[at - 1] <= s) and (not own or out[own - 1][2] <= s):
                    insort(out, (s, kind, e))
    return out


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""
    span, before = text[start:end], text[max(0, start - 32) : start].lower()
    near = re.split(r"[^\w-]+", before)
    digits = sum(c.isdigit() for c in span)
    if kind == 3:
        shape = 1 if 9 <= digits <= 12 else -1
        gazetteer = 1 if re.match(r"\(?[2-9]", span) else 0
        context = 1 if any(w in PHONE_WORDS for w in near) else 0
    elif kind == 0:
        shape = 1 if ("(at)" in span or "[at]" in span) else 0
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in DOMAIN_ENDS else -1
        context = 1 if any(w in MAIL_WORDS for w in near) else 0
    else:
        mixed = digits and sum(c.isalpha() for c in span)
        shape = 1 if mixed and len(span) >= 16 else -1 if len(set(span)) < 5 or not digits else 0
        gazetteer = 1 if span.startswith(KEY_PREFIXES) else 0
        context = 1 if any(w in SECRET_WORDS for w in near) else 0
    plain = -1 if any(w in PLAIN_WORDS for w in near) else 0
    variety = len(set(span)) / max(len(span), 1)
    word = kind == 4 and span.isalpha() and span.islower()
    spread = 1 if kind == 4 and len(set(span)) >= 10 else -1 if variety < 0.2 or word else 0
    return shape, gazetteer, context, plain, spread


def shape_features(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """Small categories of the span's form: length, digits, capitals, quoting."""
    span = text[start:end]
    digits, capitals = sum(c.isdigit() for c in span), sum(c.isupper() for c in span)
    return min(len(span) // 8, 5), min(4 * digits // max(len(span), 1), 3), min(4 * capitals // max(len(span), 1), 3), int(text[max(0, start - 1) : start] in ('"', "=", ":"))


def pattern_of(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    return (kind, *votes(text, start, kind, end), *shape_features(text, start, kind, end))


N_VOTES = 5


@dataclass
class SpanModel:
    """Weights over one-hot categories; reliabilities of each kind's labelers for the record."""

    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    bias: float = -10.0
    reliability: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)

    def probability(self, pattern: tuple[int, ...]) -> float:
        z = self.bias + sum(self.weights.get((i, v), 0.0) for i, v in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def estimate(counts: Counter, rounds: int = 50) -> tuple[np.ndarray, dict[int, tuple[float, float]]]:
    """EM over counted vote patterns: posterior of each pattern, and each labeler's
    (chance to vote for a true span, chance to vote for a false one), given that it votes.

    Starts from the majority vote; pseudo-counts keep every labeler better than chance.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    vote = np.array([p[1 : 1 + N_VOTES] for p in patterns], float).reshape(len(patterns), N_VOTES)
    post = 1 / (1 + np.exp(-1.5 * vote.sum(1)))
    good = bad = np.zeros(N_VOTES)
    for _ in range(rounds):
        a, b = n * post, n * (1 - post)
        good = ((a[:, None] * (vote > 0)).sum(0) + 8) / ((a[:, None] * (vote != 0)).sum(0) + 10)
        bad = ((b[:, None] * (vote > 0)).sum(0) + 2) / ((b[:, None] * (vote != 0)).sum(0) + 10)
        bad = np.minimum(bad, good - 0.05)
        prior = (a.sum() + 1) / (n.sum() + 2)
        z = math.log(prior / (1 - prior)) + np.where(vote > 0, np.log(good / bad), 0).sum(1) + np.where(vote < 0, np.log((1 - good) / (1 - bad)), 0).sum(1)
        post = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    return post, {i: (float(good[i]), float(bad[i])) for i in range(N_VOTES)}


def fit(counts: Counter, rounds: int = 400, rate: float = 0.3, ridge: float = 1e-3) -> SpanModel:
    """The span classifier, trained on the posteriors of all counted patterns."""
    if not counts:
        return SpanModel()
    patterns = sorted(counts)
    # a labeler asks something else of every kind, so each kind has its own reliabilities
    parts, reliability = [], {}
    for kind in sorted({p[0] for p in patterns}):
        found, own = estimate(Counter({p: counts[p] for p in patterns if p[0] == kind}))
        parts.append(found)
        reliability.update({(kind, i): pair for i, pair in own.items()})
    post = np.concatenate(parts)  # patterns are sorted by kind
    n = np.array([counts[p] for p in patterns], float)
    n /= n.sum()
    names = sorted({(i, v) for p in patterns for i, v in enumerate(p)})
    place = {k: j for j, k in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for r, p in enumerate(patterns):
        for i, v in enumerate(p):
            x[r, place[i, v]] = 1
    w, bias = np.zeros(len(names)), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -35, 35)))
        g = n * (p - post)
        w -= rate * (x.T @ g * 10 + ridge * w)
        bias -= rate * 10 * g.sum()
    return SpanModel({k: float(w[j]) for k, j in place.items()}, float(bias), reliability)


def train(docs: DataFrame) -> SpanModel:
    """Count the vote patterns of every document and fit on the counts.

    Patterns are added up in each task and merged by a keyed aggregation; their number is
    bounded by the categories, so a few thousand rows at most reach the driver.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(",".join(map(str, pattern_of(text, *c))) for c in candidates(text, base_spans(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return fit(Counter({tuple(map(int, r.pattern.split(","))): r.n for r in rows}))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: SpanModel, accept: float = ACCEPT) -> DataFrame:
    """Per row: doc_id, base counts, digest of the base spans, all spans as a string, how many spans
    the method added, and whether there is any span."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, digest, spans, added = [[], [], [], []], [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                kinds = [k for _, k, _ in base]
                for k in range(4):
                    count[k].append(kinds.count(k))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                more = [c for c in candidates(text, base) if model.probability(pattern_of(text, *c)) >= accept] if text else []
                spans.append(joined(sorted([*base, *more])))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array([s != "" for s in spans], pa.bool_())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "has_private"],
            )

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, has_private boolean")


def pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Train on all of ``docs`` and search every row of it."""
    return find(docs, train(docs), accept)
