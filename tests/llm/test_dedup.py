"""Line dedup, near copies, suffix dedup, decontamination, url filters, pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lexmill.llm import components, decontamination, line_dedup, minhash, suffix_dedup, toxicity, url_filters

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ------------------------------------------------------------------ lines


def brute_lines(rows, sites):
    where, first = {}, {}
    for d, t, s in rows:
        for i, x in enumerate((t or "").split("\n") if t is not None else []):
            k = x.strip(" \t\r")
            if k:
                where.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, (d, i)), (d, i))
    out = {}
    for d, t, _ in rows:
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not (k := x.strip(" \t\r")) or len(where[k]) < sites or first[k] == (d, i))
    return out


def test_line_dedup_equals_brute_force(spark):
    random.seed(7)
    pool = [f"line {i}" for i in range(40)] + ["", "  ", "é"]
    rows = [(i, "\n".join(random.choice(pool) + random.choice(["", " ", "\r"]) for _ in range(random.randint(0, 12))), random.choice(["a", "b", "c", "d", "e", None])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "\n".join(["line 1"] * 3000), "c")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, source string, key string, n_chars int")
    for sites in (3, 6):
        out = line_dedup.dedup_lines(docs, sites)
        assert out.columns == docs.columns
        got = out.collect()
        want = brute_lines(rows, sites)
        assert {r.doc_id: r.text for r in got} == want
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ near copies


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    p = {d: d for d in sets}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                p[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def near_rows():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(25):
        words = random.choices(vocabulary, k=random.choice([3, 8, 60, 200, 400]))
        for _ in range(random.choice([1, 1, 2, 5, 30])):
            copy = list(words)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append((len(rows) * 3, random.choice([" ", "\n"]).join(copy).title() if random.random() < 0.3 else " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "a " * 20000), (5006, "a " * 9)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, component_id int, sig string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == sum(v[2] for v in got.values())


def test_near_duplicates_odd_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(map(str, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()))
    assert got == ["Row(doc_id=1, component_id=1, kept=True)"] * 2 + ["Row(doc_id=2, component_id=1, kept=False)", "Row(doc_id=None, component_id=None, kept=True)"]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _star(n, at):
    """A text with id ``at`` and ``n`` copies with three edits each, every one near the text alone."""
    rng = random.Random(11)
    text = [f"w{i}" for i in range(200)]
    copies = []
    for i in range(n):
        t = list(text)
        for j, place in enumerate(rng.sample(range(1, 38), 3)):
            t[place * 5] = f"own{i}x{j}"
        copies.append(" ".join(t))
    ids = [i for i in range(n + 1) if i != at]
    return [(at, " ".join(text)), *zip(ids, copies, strict=True)]


def test_near_duplicates_join_a_star(spark):
    rows = _star(300, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert {v[1] for v in got.values()} == {0}


def test_exact_pass_links_what_the_orders_left(spark):
    docs = spark.createDataFrame(_star(120, 60), "doc_id long, text string")
    reps = minhash.materialise(minhash._signed(docs).select("doc_id", "n_shingles", "sig"), "reps")
    regions = minhash.materialise(minhash._regions(reps, "bigint"), "regions")
    sets = minhash.materialise(minhash._sets(docs, regions.select("doc_id").distinct()), "sets")
    # ids below 20 are one component already
    known = spark.createDataFrame([(i, 0) for i in range(20)], "node long, component long")
    for block in (7, 256):
        late = minhash._apart(regions, reps, sets, known, "bigint", block)
        whole = late.unionByName(known.selectExpr("component as a", "node as b"))
        assert {r.component for r in components.components(whole).collect()} == {0}
        assert {r.a for r in late.collect()} | {r.b for r in late.collect()} >= {60, *range(20, 121)}


def test_rare_shingles_link_what_is_near(spark):
    # a template that all share, words of their own, and copies that are near some of them
    rng = random.Random(17)
    template = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = [*template, *(f"own{i}x{j}" for j in range(rng.choice([10, 40, 120])))]
        rows.append((3 * i, " ".join(words)))
        if i % 4 == 0:
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((3 * i + 1, " ".join(copy)))
    rows += [(1000, "a b"), (1001, "a b c d e f"), (1002, " ".join(template))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = minhash.materialise(minhash._sets(docs, docs.select("doc_id")), "sets")
    # pairs of one component need no link
    same = {0: 1, 3: 1}
    members = spark.createDataFrame([(i, same.get(i, i)) for i, _ in rows], "doc_id long, c long")
    full = {}
    for d, t in rows:
        w = t.split()
        full[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    want = set()
    for a in full:
        for b in full:
            n = len(full[a] & full[b])
            if a < b and same.get(a, a) != same.get(b, b) and 100 * n >= 85 * (len(full[a]) + len(full[b]) - n):
                want.add(frozenset((same.get(a, a), same.get(b, b))))
    assert len(want) > 300
    for block in (16, 4096):
        got = [frozenset((r.a, r.b)) for r in minhash._rare_links(members, sets, "bigint", block).collect()]
        assert set(got) == want


def test_crowded_regions_equal_the_others(spark):
    rows = near_rows() + [(9000 + i, t) for i, (_, t) in enumerate(_star(80, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = minhash.materialise(minhash._signed(docs).where("n_shingles > 0").select("doc_id", "n_shingles", "sig"), "reps")
    regions = minhash.materialise(minhash._regions(reps, "bigint"), "regions")
    sets = minhash.materialise(minhash._sets(docs, regions.select("doc_id").distinct()), "sets")
    known = spark.createDataFrame([], "node long, component long")
    found = [components.components(minhash._apart(regions, reps, sets, known, "bigint", 4, crowd)).collect() for crowd in (0, 3, 1000)]
    assert sorted(found[0]) == sorted(found[1]) == sorted(found[2]) and len(found[0]) > 150


def test_components(spark):
    random.seed(5)
    edges = [(random.randint(0, 200), random.randint(0, 200)) for _ in range(110)] + [(300, 300 + i) for i in range(200)] + [(None, 1)]
    p = list(range(600))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges[:-1] if e[0] != e[1] for x in e}


# ------------------------------------------------------------------ suffix dedup


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            cover[i : i + length] |= w in seen
            seen.add(w)
        cover = cover[: len(b)]
        runs = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(b) else 0
        out[d] = (len(b), int(cover.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest())
    return out


def test_lpf_equals_brute_force():
    random.seed(4)
    for _ in range(150):
        s = bytes(random.choice(b"ab") for _ in range(random.randint(1, 40)))
        n = len(s)
        order, lcp = suffix_dedup.suffix_order(np.frombuffer(s, np.uint8), np.arange(n), np.full(n, n))
        assert [s[i:] for i in order] == sorted(s[i:] for i in range(n))
        common = lambda i, j: next(x for x in range(n - max(i, j) + 1) if x == n - max(i, j) or s[i + x] != s[j + x])  # noqa: B023, E731
        assert lcp.tolist() == [0, *(common(i, j) for i, j in zip(order[:-1], order[1:], strict=True))]
        lpf = suffix_dedup.longest_previous_factor(order, lcp)
        for k, i in enumerate(order):
            assert lpf[k] == max([0] + [common(i, j) for j in range(i)])


def test_long_previous_factors_of_pieces():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 900).astype(np.uint8)
    text[400:560], text[700:850] = text[100:260], text[120:270]
    starts, ends = [], []
    for lo, hi in ((90, 260), (395, 565), (695, 860)):
        starts += range(lo, hi - 99)
        ends += [hi] * (hi - 99 - lo)
    starts, ends = np.array(starts), np.array(ends)
    place = rng.permutation(2000)[: len(starts)]  # any order of places
    got = suffix_dedup.previous_factors(text, starts, ends, place)
    t = text.tobytes()
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        best = 0
        for j in np.flatnonzero(place < place[i]):
            x = 0
            while x < min(e - s, ends[j] - starts[j]) and t[s + x] == t[starts[j] + x]:
                x += 1
            best = max(best, x)
        assert got[i] == (best if best >= 100 else 0)


@pytest.mark.parametrize("limits", [(48, 2000), (2, 3), (10_000, 3), (3, 10_000)])
def test_suffix_dedup_equals_brute_force(spark, limits):
    random.seed(9)
    phrase = "".join(random.choice("abcdefgh ") for _ in range(130))
    some = lambda: "".join(random.choice("abcdefghij é") for _ in range(random.randint(0, 200)))
    rows = [(i, some() + (phrase if i % 2 else "") + some()) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(["a" * 700, "ab" * 300, None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 100, rows[3][1], rows[5][1] + rows[7][1], "é" * 120])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, crowded_here=limits[0], crowded=limits[1]).collect()}
    assert got == brute_repeats(rows)


def test_suffix_dedup_long_text_and_empty_table(spark):
    random.seed(3)
    part = "".join(random.choice("abcdefghijkl ") for _ in range(400_000))
    rows = [(1, part + part[1000:2000]), (2, part), (3, "q" * 20)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (401_000, 1000, 1), 2: (400_000, 400_000, 1), 3: (20, 0, 0)}
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ decontamination


def brute_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = {}
    for d, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for i, x in items:
            v = word.findall((x or "").translate(LOWER))
            m = min(13, len(v))
            for s in range(len(v) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[s : s + m]:
                        hit.update(range(p, p + m))
                        found.add(i)
        out[d] = (len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_equals_brute_force(spark):
    random.seed(13)
    pool = ["the", "of", "É", "é", "Σ", "ς", "ab1", "İ", "K", "x"]
    some = lambda n: [random.choice(pool) for _ in range(n)]
    items = [(i, random.choice([" ", ", ", "--"]).join(some(random.choice([1, 2, 4, 5, 12, 13, 20, 40])))) for i in range(25)] + [(98, None), (99, ""), (100, "?!")]
    items.append((97, items[0][1]))
    docs = [(i, " ".join(some(random.randint(0, 60)) + (items[i % 25][1].upper() if i % 3 else items[i % 25][1]).split() + some(5))) for i in range(60)]
    docs += [(900, None), (901, ""), (902, "... "), (903, "."), (904, "a"), (905, ".a"), (906, "a."), (907, "the É " * 2000)]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, start int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    for block in (decontamination.BLOCK_BYTES, 400):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.decontamination(d, b, block_bytes=block).collect()}
        assert got == want
    assert decontamination.clean(d, b).count() == sum(not v[3] for v in want.values())


def test_decontamination_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontamination(d, b).where("not contaminated").count() == 2
    assert decontamination.decontamination(d.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# ------------------------------------------------------------------ urls


def test_url_aliases_and_rules(spark):
    rows = [
        (1, "http://a.net/x", '<link rel="canonical" href="https://www.example.org/es/1">', "block"),
        (2, "https://www.example.org/es/1#q", "", "block"),
        (3, "http://ok.org/1", "<meta content='0; url=http://a.net/x' http-equiv=refresh>", "allow"),
        (4, None, None, "allow"),
        (5, "abc", "<link>", "allow"),
        (6, "http://B.com/fr/?x", "<LINK href=http://a.net/x rel=canonical>", "allow"),
        (7, "HTTP://Q.Com?/de/", None, "allow"),
        (8, "http://example.org/en/15", None, "block"),
        (9, "http://example.org/en/25", None, "allow"),
        (9, "http://c.com/de/", None, "block"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = url_filters.judge(pages).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == sorted((r[0], r[3]) for r in rows)
    by = {r.page_id: r for r in got}
    assert (by[6].host, by[6].path, by[6].rule) == ("b.com", "/fr/", "com/fr/") and (by[4].host, by[4].path, by[4].rule) == ("", "", None)
    more = url_filters.judge(pages, redirects=spark.createDataFrame([("http://q.com?/de/", "http://a.net/x")], "source string, target string"))
    assert more.where("page_id = 7").first().verdict == "block"
    assert url_filters.judge(pages.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_equals_brute_force(spark, sf):
    import duckdb
    from tokenizers import Tokenizer

    from lexmill.llm.queries import vocabulary_path
    from lexmill.session import read_table

    docs = read_table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in toxicity.toxicity(docs, read_table(spark, sf, "labels"), keep=True).collect()]
    text = brute_lines(rows, line_dedup.SITES)
    kept = {d for d, v in brute_components(list(text.items())).items() if v[2]}
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = {}
    for i, x in items:
        v = word.findall(x.translate(LOWER))
        for s in range(max(len(v) - 12, 1)):
            grams.setdefault(tuple(v[s : s + 13]), i)
    sizes = {len(g) for g in grams}
    clean = {}
    for d in kept:
        w = word.findall((text[d] or "").translate(LOWER))
        hit = {q for m in sizes for p in range(len(w) - m + 1) if tuple(w[p : p + m]) in grams for q in range(p, p + m)}
        if not hit or 20 * len(hit) < len(w):
            clean[d] = text[d]
    library = Tokenizer.from_file(vocabulary_path())
    got = {r.doc_id: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in clean.items()}
