"""Operators 3, 5 and 7, and the pipeline, against brute force."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import plain  # noqa: F401
from test_narrow import brute_contaminations
from tidelog.llm import jaccard_join, lm_scoring, quality, sentencepiece_codec, substring_dedup
from tidelog.llm._components import components
from tidelog.llm._text import buffers, word_hashes

SMALL = "/root/testdata/sf0.001"


def gram_set(text, n=3):
    w = re.sub(r"[!-/:-@\[-`{-~]", "", (text or "").lower()).split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_pairs(rows, threshold=0.5):
    sets = defaultdict(set)
    for d, t in rows:
        if d is not None:
            sets[d] |= gram_set(t)
    out = {}
    by_gram = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            by_gram[g].add(d)
    shared = Counter(p for ds in by_gram.values() for p in itertools.combinations(sorted(ds), 2))
    for (a, b), k in shared.items():
        if k / (len(sets[a]) + len(sets[b]) - k) >= threshold:
            out[a, b] = k / (len(sets[a]) + len(sets[b]) - k)
    return out


def near_copies(draw, base, count):
    """Copies with a growing share of words changed."""
    out = []
    for k in range(count):
        w = base.split()
        for _ in range(int(len(w) * 0.012 * k)):
            w[draw.randrange(len(w))] = f"new{draw.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def copies(small):
    draw = random.Random(8)
    rows = [(r.doc_id, r.text) for r in small.collect()]
    long = [t for _, t in rows if len(t.split()) > 150][:8]
    extra = [c for t in long for c in near_copies(draw, t, 12)] + [long[0]] * 40 + ["two words", "Two, words!", "two words"] + ["lone", "...", "?! ,"]
    return rows + [(1000 + k, t) for k, t in enumerate(extra)]


# --- 3


def groups_of(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def expanded(docs):
    """All similar pairs that class pairs and membership stand for."""
    pairs, members = jaccard_join.class_pairs(docs)
    of = defaultdict(list)
    for r in members.collect():
        of[r.rep].append(r.doc_id)
    out = {tuple(sorted(p)): 1.0 for ds in of.values() for p in itertools.combinations(ds, 2)}
    for r in pairs.collect():
        out |= {tuple(sorted((a, b))): r.jaccard for a in of[r.doc_a] for b in of[r.doc_b]}
    return out


def test_pairs_against_brute_force(make, copies, hard_rows):
    rows = copies + [(None if i is None else i + 5000, t) for i, t in hard_rows] + [(5900, hard_rows[4][1] + " and a few words more")]
    docs, want = make(rows, extra=True), brute_pairs(rows)
    got = expanded(docs)
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 1000 and (5004, 5900) in got
    assert all(abs(v - want[p]) < 1e-12 for p, v in got.items())
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similar_classes(docs).collect()}
    assert set(found) == {d for d, _ in rows if d is not None}
    links, roots = Counter(x for p in got for x in p), groups_of(got)
    assert found == {d: (roots.get(d, d), links[d]) for d in found}


def test_large_groups_take_several_blocks(make, copies, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    want = brute_pairs(copies)
    got = expanded(make(copies))
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)


def random_text(draw, words, size):
    return " ".join(draw.choice(words) for _ in range(size))


def entry_links(texts, batches=1, monkeypatch=None, many=None, few=None):
    """What entries and links make of texts, without Spark: (links, entries of the largest bucket)."""
    if many is not None:
        monkeypatch.setattr(jaccard_join, "MANY", many)
        monkeypatch.setattr(jaccard_join, "FEW", few)
    bands, rows = jaccard_join.bands_for(0.5, 0.9995)
    width, most = -(-bands * rows // 32), bands * rows - jaccard_join.least_agreement(0.5, 0.9995, bands * rows)
    cls, keys, sketch = jaccard_join.signatures(*jaccard_join._grams(pa.array(texts), 3), bands, rows)
    table = pa.table({"cls": cls.view(np.int64), "bands": jaccard_join._binary(keys), "sketch": jaccard_join._binary(sketch)})
    out = pa.Table.from_batches(jaccard_join._entries(bands, width, most)(iter(table.to_batches(max_chunksize=-(-len(texts) // batches)))))
    sent = Counter(out.column("bucket").to_pylist()).most_common(1)[0][1]
    of = {int(c): k for k, c in enumerate(cls.view(np.int64).tolist())}
    rows = sorted(set(zip(out.column("bucket").to_pylist(), out.column("cls").to_pylist())))
    met = pa.table({"bucket": [r[0] for r in rows], "cls": [r[1] for r in rows], "sketch": jaccard_join._binary(sketch[[of[r[1]] for r in rows]])})
    links = pa.Table.from_batches(jaccard_join._linked(width, most)(iter(met.to_batches(max_chunksize=777))))
    return [(of[a], of[b]) for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist())], sent


def test_hot_buckets_keep_all_connected(monkeypatch):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = random_text(draw, words, 120)
    texts = [random_text(draw, words, 120) for _ in range(60)]
    for _ in range(600):  # near copies of one text, each with some words of its own
        w = base.split()
        for _ in range(draw.choice((1, 1, 2, 3, 12))):
            w[draw.randrange(len(w))] = draw.choice(words)
        texts.append(" ".join(w))
    draw.shuffle(texts)
    want = groups_of(brute_pairs(list(enumerate(texts))))
    usual, largest = entry_links(texts, 3, monkeypatch, 10**6, 64)
    few, less = entry_links(texts, 3, monkeypatch, 4, 8)
    for links in (usual, few):
        got = groups_of(links)
        assert all(got.get(d, d) == r for d, r in want.items()) and set(got) == set(want)
    assert less <= 221 < 300 < largest  # no bucket is larger than a batch


def sketch_of(values):
    out = np.zeros((1, -(-len(values) // 32)), np.uint64)
    for k, v in enumerate(values):
        out[0, k // 32] |= np.uint64(int(v) << 2 * (k % 32))
    return out


@pytest.mark.parametrize("meet", (8192, 4))
def test_what_left_a_bucket_meets_the_rest_of_it(spark, make, monkeypatch, meet):
    """One of many near copies, tied to their least in another bucket, is the only one that is like some rows of the bucket it left."""
    monkeypatch.setattr(jaccard_join, "MEET", meet, raising=False)
    bands, rows = jaccard_join.bands_for(0.5, 0.9995)
    most = bands * rows - jaccard_join.least_agreement(0.5, 0.9995, bands * rows)
    base, edge, beyond = (np.where(np.arange(bands * rows) < n, 1, 0) for n in (0, most, most + 40))
    sketches = [base] * 40 + [edge] + [beyond] * 9 + [np.full(bands * rows, 3)]
    draw = np.random.default_rng(2)
    keys = draw.integers(0, 2**63, (len(sketches), bands), dtype=np.uint64)
    keys[:, 7] = 77  # the one bucket that they share
    made = [(k, k, k, keys[k].tobytes(), sketch_of(s).tobytes()) for k, s in enumerate(sketches)]
    join = jaccard_join.Join(make([]), 0.5, 3, 0.999, "doc_id", "text")
    join.signed = spark.createDataFrame(made, "doc bigint, key bigint, cls bigint, bands binary, sketch binary").coalesce(1)
    join.classes = join.signed.select("cls", F.lit(1).cast("bigint").alias("size"), "sketch")
    got = {r.node: r.root for r in components(join.likely()).collect()}
    assert got == {k: 0 for k in range(50)}


def test_large_buckets_keep_every_link(monkeypatch):
    """In a bucket of several blocks, a row that is only like one of an earlier block that isn't the first of its kind is still linked."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    draw = np.random.default_rng(4)
    size, most = 171, 85
    rows = [np.zeros(size, int)] * 30 + [np.where(np.arange(size) < most, 1, 0)] + [np.full(size, 2)] * 30
    rows += [np.where(np.arange(size) < n, v, w) for n, v, w in ((most + 60, 1, 0), (most, 3, 2), (most + 60, 3, 2))] + [draw.integers(0, 4, size) for _ in range(40)]
    sketch = np.concatenate([sketch_of(r) for r in rows])
    a, b = jaccard_join._meet(np.arange(len(rows)), sketch, np.array([0]), np.array([len(rows)]), most)
    values = np.array(rows)
    want = groups_of([(i, j) for i in range(len(rows)) for j in range(i) if (values[i] != values[j]).sum() <= most])
    assert groups_of(zip(a.tolist(), b.tolist())) == want and want[61] == 0 and want[63] == 31


def test_chance_links_nothing():
    """Documents that share phrases by chance aren't brought together: comparisons stay in proportion to true pairs as the corpus grows."""
    draw = random.Random(6)
    words, phrases = [f"w{k}" for k in range(5000)], []
    phrases = [random_text(draw, words, 8) for _ in range(40)]
    made = []
    for size in (400, 1600):
        texts = [" ".join(draw.choice((draw.choice(phrases), random_text(draw, words, 12))) for _ in range(12)) for _ in range(size)]
        links = entry_links(texts)[0]
        true = brute_pairs(list(enumerate(texts)))
        made.append(len(set(links)) - len(true))
    assert max(made) <= 2


def test_one_of_each_group_stays(make, copies):
    rows = [*copies, (None, "no id"), (9000, None), (9001, "")]
    docs = make(rows, extra=True)
    left = jaccard_join.without_copies(docs)
    assert left.columns == docs.columns
    roots = groups_of(brute_pairs(rows))
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(d or -1 for d, _ in rows if roots.get(d, d) == d)


def test_rows_that_repeat(make):
    twice = [(1, "same text two times"), (1, "same text two times"), (1, "another text, though"), (2, "Same text two times!"), (3, None), (3, None), (4, ""), (4, "")]
    docs = make(twice).withColumn("extra", F.when(F.col("lang") == "en", F.rand()))
    assert sorted((r.doc_id, r.text) for r in jaccard_join.without_copies(docs).collect() if r.text) == [(1, "another text, though"), (1, "same text two times")]
    assert jaccard_join.without_copies(docs).where("doc_id > 2").count() == 2
    got = sorted(map(tuple, jaccard_join.similar_classes(docs).collect()))
    assert got == [(1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_pairs_of_nothing(make):
    for rows in ([], [(1, None), (2, ""), (3, " ")]):
        assert not expanded(make(rows))
        assert jaccard_join.without_copies(make(rows)).count() == len(rows)
        assert {(r.class_id, r.n_links) for r in jaccard_join.similar_classes(make(rows)).collect()} == {(d, 0) for d, _ in rows}


def test_components(spark):
    draw = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: r for n, r in groups_of(edges).items() if sum(v == r for v in groups_of(edges).values()) > 1}
    assert got == want


def test_bands_reach_the_recall():
    for threshold, recall in ((0.5, 0.999), (0.8, 0.95), (0.3, 0.9)):
        b, r = jaccard_join.bands_for(threshold, recall)
        assert 1 - (1 - threshold**r) ** b >= recall and b * r <= 256
    assert jaccard_join.bands_for(0.01, 0.999)[1] == 1 and 1 - 0.99 ** jaccard_join.bands_for(0.01, 0.999)[0] >= 0.999


# --- 5


def brute_repeats(rows, window=50, first_ones=False):
    """Words covered by a window that occurs earlier, or by the first one of those, as spans."""
    seen, out = set(), {}
    first = {}
    docs = sorted({(d, t) for d, t in rows if d is not None and t}, key=lambda r: r[0])
    for d, t in docs:
        w = t.split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in first:
                seen.add(first[key] if first_ones else (d, k))
            else:
                first[key] = d, k
    for d, t in docs:
        spans = []
        for k in sorted(k for e, k in seen if e == d):
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + window
            else:
                spans.append([k, k + window])
        out[d] = [tuple(s) for s in spans]
    return {d: s for d, s in out.items() if s}


@pytest.fixture(scope="module")
def passages(small):
    draw = random.Random(4)
    rows = [(r.doc_id, r.text) for r in small.collect()]
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    shared = [" ".join(word() for _ in range(n)) for n in (49, 50, 51, 55, 60, 80, 120, 300) for _ in range(6)]
    for k, p in enumerate(shared):
        for j in range(2):
            rows.append((2000 + 2 * k + j, " ".join([word() for _ in range(draw.randrange(40))] + [p] + [word() for _ in range(draw.randrange(40))])))
    rows += [(3000, "la " * 70 + "x"), (3001, "y " + "la " * 55), (3002, "ab cd " * 60), (3003, "q " + "ab cd " * 40), (3004, "solo " * 200)]
    return rows


def test_repeats_against_brute_force(make, passages, hard_rows):
    long = hard_rows[4][1]
    rows = passages + [(None if i is None else i + 5000, t) for i, t in hard_rows] + [(6000, "zz " + long[200_000:300_000].split(" ", 1)[1])]
    got, first = defaultdict(list), defaultdict(list)
    for r in substring_dedup.repeated_spans(make(rows, extra=True)).orderBy("doc_id", "span_start").collect():
        assert r.n_words == r.span_end - r.span_start
        (first if r.kept else got)[r.doc_id].append((r.span_start, r.span_end))
    want = brute_repeats(rows)
    size = lambda spans: {(d, k) for d, ss in spans.items() for a, b in ss for k in range(a, b)}
    assert size(got) <= size(want) and len(size(got)) >= 0.99 * len(size(want))
    assert sum(got[d] == s for d, s in want.items()) >= 0.97 * len(want) and len(want) > 40
    want = brute_repeats(rows, first_ones=True)
    assert size(first) <= size(want) and len(size(first)) >= 0.99 * len(size(want))


def test_hot_passages_are_settled_in_their_tasks(spark, make):
    """A passage in every document: what meets in one place grows with the tasks and not with the documents."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    shared = " ".join(word() for _ in range(90))
    rows = [(i, " ".join([*(word() for _ in range(i % 7)), shared, *(word() for _ in range(60))])) for i in range(600)]
    docs = make(rows).repartition(3).cache()
    met = substring_dedup.final_symbols(docs, 8, "doc_id", "text").groupBy("name").count().agg({"count": "max"}).first()[0]
    # the order of rows is chance here, so a lesser id may come after the least one so far; slices are larger than these tasks
    assert met <= 3
    got, first = {}, {}
    for r in substring_dedup.repeated_spans(docs).orderBy("doc_id", "span_start").collect():
        (first if r.kept else got).setdefault(r.doc_id, []).append((r.span_start, r.span_end))
    assert got == brute_repeats(rows) and first == brute_repeats(rows, first_ones=True) and len(got) == 599


@pytest.mark.parametrize("most", [1, 5, 1 << 14])
def test_settling_keeps_the_least(most):
    """Over any slices and any memory: what is settled has an earlier place in its task, and every name's least and another place stay."""
    draw = np.random.default_rng(most)
    task, seen, stay = substring_dedup._Task(most), {}, {}
    for _ in range(40):
        n = int(draw.integers(0, 30))
        name, start, key = draw.integers(0, 12, n).astype(np.uint64), draw.integers(0, 4, n), draw.integers(-1, 2, n)
        doc = [str(x) for x in draw.integers(0, 40, n)]
        beyond, last, near = task.settle(name, pa.array(doc, pa.string()), start, key, name)
        places = list(zip(doc, start.tolist(), key.tolist()))
        for who, place in zip(name.tolist(), places):
            seen.setdefault(who, set()).add(place)
        for k, (who, place) in enumerate(zip(name.tolist(), places)):
            mark = near[k].as_py()
            if beyond[k]:
                least = mark["doc"], mark["start"], mark["key"]
                assert least < place and least in seen[who] and mark["gap"] == who
            if not beyond[k] or last[k]:
                stay.setdefault(who, set()).add(place)
        assert len(task.kept[0]) <= most
    for who, places in seen.items():
        assert min(places) in stay[who] and (len(places) == 1 or len(stay[who]) > 1)


def test_rows_of_one_id_are_told_apart(make):
    """Two texts of one id that begin alike hold the passage twice; a repeated row of an id and text holds it once."""
    words = [f"w{k}" for k in range(140)]
    one, two = " ".join(words[:70] + ["x"] * 3), " ".join(words[:70] + words[100:])
    spans = lambda rows: [(r.doc_id, r.kept, r.n_words) for r in substring_dedup.repeated_spans(make(rows)).orderBy("kept").collect()]
    assert spans([(1, one), (1, two)]) == [(1, False, 70), (1, True, 70)]
    assert spans([(1, one), (1, one)]) == []


def cut(text, spans):
    w = text.split()
    return [x for k, x in enumerate(w) if not any(a <= k < b for a, b in spans)]


def test_recompression_ends_with_long_symbols(hard_rows):
    draw = random.Random(2)
    for text in (hard_rows[4][1], "ab " * 7 + "x", " ".join(draw.choice("ab") for _ in range(5000)), "a " * 9000):
        words, per = word_hashes(*buffers(pa.array([text])))
        name, first, size = substring_dedup.recompress(words, per, 8)
        size = np.abs(size)
        covered = np.zeros(len(words), int)
        for a, n in zip(first, size):
            covered[a : a + n] += 1
        # what no final symbol covers is a single short symbol between two of them
        assert covered.max(initial=0) <= 1 and (len(words) < 100 or covered.mean() > 0.6)
        gaps = np.diff(np.flatnonzero(np.concatenate([[1], covered, [1]])))
        assert len(words) < 100 or gaps.max() <= 8


def test_cutting(make, passages, hard_rows):
    rows = passages + [(None if i is None else i + 5000, t) for i, t in hard_rows]
    docs = make(rows, extra=True)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    found = defaultdict(list)
    for r in substring_dedup.repeated_spans(docs).where("not kept").collect():
        found[r.doc_id].append((r.span_start, r.span_end))
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter()
    for d, t in rows:
        if d in found:
            if cut(t, found[d]):
                want[d, " ".join(cut(t, found[d]))] += 1
        else:
            want[d, t] += 1
    assert Counter({(d, " ".join(t.split()) if d in found else t): n for (d, t), n in got.items()}) == want
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None and r.doc_id in found)


def test_no_repeats(make):
    for rows in ([], [(1, None), (2, "")], [(1, "w " * 49)], [(1, " ".join(map(str, range(90))))] * 2):
        assert substring_dedup.repeated_spans(make(rows)).count() == 0
        assert substring_dedup.without_repeats(make(rows)).count() == len(rows)


# --- 7


def brute_scores(rows, held, shares=10):
    """Counts in dictionaries, EM over held-out predictions one by one, then log probabilities."""
    c = [Counter(), Counter(), Counter()]
    documents = 0

    def grams(text):
        w = ["<", "<", *text.split(), ">"]
        return [tuple(w[k - 2 : k + 1]) for k in range(2, len(w))]

    for d, t in rows:
        if t is not None and not held[d]:
            documents += 1
            for u, v, w in grams(t):
                c[0][w] += 1
                c[1][v, w] += 1
                c[2][u, v, w] += 1
    words, flat = sum(c[0].values()), 1 / (len(c[0]) + 1)

    def parts(d, t):
        less = 0 if held[d] else 1
        for u, v, w in grams(t):
            uv = documents if v == "<" else c[1][u, v]
            cv = documents if v == "<" else c[0][v]
            n = [max(x - less, 0) for x in (c[2][u, v, w], uv, c[1][v, w], cv, c[0][w])]
            level = 20 + min(19, int(math.log2(n[1]))) if n[1] else min(19, int(math.log2(n[3] + 1)))
            yield level, [min(1, n[0] / n[1]) if n[1] else 0, min(1, n[2] / n[3]) if n[3] else 0, min(1, n[4] / words), flat]

    seen = [(lv, [p if k == 3 else 2 ** (-min(254, round(-2 * math.log2(p))) / 2) if p else 0 for k, p in enumerate(ps)]) for d, t in rows if t is not None and held[d] for lv, ps in parts(d, t)]
    lam = {lv: [0.25] * 4 for lv in range(40)}
    for _ in range(60):
        mass = {lv: [0.0] * 4 for lv in range(40)}
        for lv, ps in seen:
            total = sum(x * p for x, p in zip(lam[lv], ps))
            for k in range(4):
                mass[lv][k] += lam[lv][k] * ps[k] / total
        whole = [sum(m[k] for m in mass.values()) for k in range(4)]
        pooled = [w / sum(whole) for w in whole] if sum(whole) else [0.25] * 4
        lam = {lv: [(m[k] + 0.5 * pooled[k]) / (sum(m) + 0.5) for k in range(4)] if sum(m) else pooled for lv, m in mass.items()}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, None))
        else:
            ps = [sum(x * p for x, p in zip(lam[lv], q)) for lv, q in parts(d, t)]
            out.append((d, len(ps), sum(map(math.log, ps))))
    return out


def test_scores_against_brute_force(make, small, hard_rows):
    rows = [(r.doc_id + 100, r.text) for r in small.collect()] + [(i, t) for i, t in hard_rows]
    docs = make(rows, extra=True)
    held = {r.doc_id: r.h for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).alias("h")).collect()}
    got = sorted(((r.doc_id, r.n_tokens, r.log_prob, r.perplexity, r.held_out) for r in lm_scoring.score_documents(docs).collect()), key=str)
    want = sorted(brute_scores(rows, held), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[4] == held[g[0]]
        if w[2] is not None:
            assert abs(g[2] - w[2]) < 1e-4 * max(1, abs(w[2])) and abs(g[3] - math.exp(-w[2] / w[1])) < 1e-3 * g[3]


def test_chunks_do_not_change_scores(make, small, monkeypatch):
    docs = small.limit(80)
    once = {r.doc_id: r.log_prob for r in lm_scoring.score_documents(docs).collect()}
    monkeypatch.setattr(lm_scoring, "CHUNK", 20_000)
    many = {r.doc_id: r.log_prob for r in lm_scoring.score_documents(docs.repartition(7, "doc_id")).collect()}
    assert once == many
    assert lm_scoring.score_documents(make([])).count() == 0


def test_large_counts_stay_whole():
    values = np.array([0, 1, 2**40, 2**62 + 5], np.uint64)
    assert (lm_scoring.unsqueeze(lm_scoring.squeeze(values, 8), 4, 8) == values).all()
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2))
    assert (lm_scoring._keys_in(lm_scoring._keys_out(keys), 50) == keys).all()


def test_weights_favour_what_predicts():
    level, p = np.zeros(4, np.int64), np.array([[0.9] * 4, [0.1] * 4, [0.1] * 4, [0.01] * 4])
    w = lm_scoring.weights_by_em(level, p, np.ones(4) * 100)
    assert w[0, 0] > 0.9 and abs(w.sum(axis=1) - 1).max() < 1e-9


# --- the pipeline


def test_pipeline_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    ranker = quality.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    score = {r.doc_id: r.score for r in quality.scored(docs, ranker).collect()}
    rows = [(d, t) for d, t in rows if score[d] is not None and score[d] >= ranker.threshold]
    roots = groups_of(brute_pairs(rows))
    rows = [(d, t) for d, t in rows if roots.get(d, d) == d]
    spans = brute_repeats(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(d, " ".join(cut(t, spans[d])) if d in spans else t) for d, t in rows if d not in spans or cut(t, spans[d])]
    bad = {d for d, _ in brute_contaminations(rows, items)}
    rows = [(d, t) for d, t in rows if d not in bad]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == {d for d, _ in rows} and 50 < len(got) < docs.count()
    texts = {r.doc_id: r.text for r in sentencepiece_codec.decode(spark.createDataFrame([(d, r.piece_ids) for d, r in got.items()], "doc_id bigint, piece_ids array<int>")).collect()}
    for d, t in rows:
        assert texts[d].split() == t.split() if d in spans else texts[d] == t


def test_stages_keep_the_columns(spark, small, make):
    strange = small.limit(30).withColumns({"score": F.lit(1), "node": F.lit(2), "starts": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, strange, SMALL).columns == strange.columns
        assert stage(spark, make([]), SMALL).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_hard_rows(spark, make, small, hard_rows, tmp_path):
    """Nulls, empty and blank texts, repeated rows, a very long text and columns of clashing names, beside usual documents."""
    usual = [(r.doc_id + 100, r.text) for r in small.collect()]
    rows = [*usual, *[(None if i is None else i, t) for i, t in hard_rows], *usual[:5], (None, usual[0][1])]
    make(rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    ranker = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    keep = {t for t in {t for _, t in rows if t is not None} if ranker.score(pa.array([t]))[0] >= ranker.threshold}
    left = [(d, t) for d, t in rows if t in keep]
    roots = groups_of(brute_pairs(left))
    left = [(d, t) for d, t in dict.fromkeys(left) if d is not None and roots.get(d, d) == d]
    spans = brute_repeats(left)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = [(d, " ".join(cut(t, spans[d])) if d in spans else t) for d, t in left if d not in spans or cut(t, spans[d])]
    bad = {d for d, _ in brute_contaminations(left, items)}
    assert {d: n for d, n in got.items() if d is not None} == {d: 1 for d, _ in left if d not in bad}
    assert got[None] == sum(d is None and t in keep for d, t in rows)
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
