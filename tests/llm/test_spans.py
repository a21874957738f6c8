"""The spans that the weak supervision adds, against planted ones and a brute-force rule."""

import random
import re

from lexmill.llm import pii


def planted(rng, n):
    """Texts with known private spans, and look-alikes that are none."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789") for _ in range(k))
    out = []
    for i in range(n):
        private = [
            ("call ", f"({rng.randint(200, 989)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", " soon"),
            ("password=", mixed(14) + "7a", " end"),
            ("token = ", "".join(rng.choice("0123456789abcdef") for _ in range(40)), " end"),
            ("", "ghp_" + mixed(36), " in code"),
            ("mail ", f"{word()} (at) {word()} (dot) com", " please"),
        ]
        public = [("version ", "1.20.300", " of"), ("isbn ", "978-3-16", " is"), ("the secret: ", "nothing", " more"), ("key: ", "aaaaaaaaaa", " of")]
        take = rng.sample(private, rng.randint(0, 2)) + rng.sample(public, rng.randint(0, 2))
        rng.shuffle(take)
        text, spans = "", []
        for before, what, after in take:
            text += " ".join(word() for _ in range(4)) + " " + before
            if (before, what, after) in private:
                spans.append((len(text), len(text) + len(what)))
            text += what + after + " "
        out.append((i, text, spans))
    return out


def test_added_spans_of_planted_texts(spark):
    rows = planted(random.Random(12), 600)
    got = {r.doc_id: r for r in pii.pii(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    right = found = wanted = 0
    for i, _, spans in rows:
        have = {tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s}
        right += len(have & set(spans))
        found += len(have)
        wanted += len(spans)
        assert got[i].has_private == bool(have) and got[i].n_added <= len(have)
    assert right / wanted > 0.95 and right / found > 0.95


def test_added_spans_equal_a_plain_rule():
    # without overlaps every candidate of the patterns is found, in any order of the kinds
    rng = random.Random(4)
    for _, text, _ in planted(rng, 200):
        base = pii.base_spans(text)
        got = pii.candidates(text, base)
        want = []
        for kind, pattern in pii._CANDIDATES:
            for m in re.finditer(pattern.pattern, text, pattern.flags):
                s, e = m.span(1) if pattern.groups else m.span()
                if all(y <= s or x >= e for x, _, y in [*base, *want]):
                    want.append((s, kind, e))
        assert got == sorted(want)


def test_a_long_base_span_keeps_its_tail():
    text = "x" + ".1.2.3.4" * 30 + "@y.org password=abcdef1234567890"
    base = pii.base_spans(text)
    (email,) = [b for b in base if b[1] == 0]
    assert all(c[0] >= email[2] for c in pii.candidates(text, base))
    long = "a" * 80 + " (at) " + "b" * 80 + " (dot) org"
    assert pii.candidates(long, []) == [(0, 0, len(long))]
    assert pii.candidates("a (at) b (dot) c " * 20_000, [])  # as long as it is
