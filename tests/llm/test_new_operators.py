"""Suffix-array dedup, kd-tree clustering and ranked lexical search against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.llm import common, kd_clustering, lexical_search, queries, suffix_dedup
from tracemill.llm.suffix_array import suffix_arrays

from ..conftest import SF

DOCS = "doc_id long, text string"


# op11


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30), max_size=6))
def test_suffix_arrays_are_sorted_suffixes(strings):
    flat, sizes, expected = [c for s in strings for c in s], [len(s) for s in strings], []
    for s in strings:
        at = len(expected)
        expected += [at + i for i in sorted(range(len(s)), key=lambda i: s[i:])]
    assert suffix_arrays(np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64)).tolist() == expected


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, "abaab" * 4_000, "".join(map(str, range(5_000))), "b" + "a" * 20_000])
def test_suffix_arrays_of_periodic_texts_take_linear_time(text):
    began = time.time()
    got = suffix_arrays(np.frombuffer(text.encode(), dtype=np.uint8), np.array([len(text)]))
    assert time.time() - began < 20
    if len(set(text)) > 1:  # neighbours in order, where comparing them is cheap
        for a, b in list(zip(got, got[1:]))[:: len(got) // 200]:
            assert text[a:] < text[b:]
    else:
        assert got.tolist() == list(range(len(text)))[::-1]


def plain_repeats(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha) for (doc_id, bytes)."""
    least = {}
    for doc, t in rows:
        for p in range(len(t) - length + 1):
            if doc is not None:
                least[t[p : p + length]] = min(doc, least.get(t[p : p + length], doc))
    out = []
    for doc, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if doc is not None and least[t[p : p + length]] < doc:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found_repeats(df, **options):
    out = []
    for r in suffix_dedup.without_repeats(df, **options).collect():
        edges = [0, *(x for s in r.spans for x in (s.start, s.end)), len(r.text)]
        assert b"".join(r.text[x:y] for x, y in zip(edges[::2], edges[1::2])) == bytes(r.kept)
        assert all(x < y for x, y in zip(edges[1:-1], edges[2:-1]))  # maximal: no two touch
        out.append((r.doc_id, len(r.text), len(r.text) - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [1, 3, 20_000])
def test_op11_is_brute_force(spark, crowd):
    """With a low `crowd` windows go one by one, which gives the same."""
    docs = common.table(spark, SF, "documents")
    assert found_repeats(docs, crowd=crowd) == plain_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])


def test_op11_on_passages_of_all_lengths(spark):
    """Passages of 45 to 60 bytes in other surroundings, copies, edits, periodic texts, and ids in no order."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in range(45, 61)]
    rows = [(rng.randrange(1000), noise(rng.randrange(80)) + rng.choice(passages) + noise(rng.randrange(80)) + rng.choice(passages)) for _ in range(150)]
    rows += [(5000 + k, rows[k][1][:60] + "#" + rows[k][1][61:]) for k in range(40)]
    rows += [(7, "xyz" * 200), (3, "yzx" * 90), (9, "a" * 49), (1, "a" * 49), (8, "a" * 51), (2, "a" * 50), (4, "b" * 1000), (6, "b" * 400)]
    df = spark.createDataFrame(rows, DOCS)
    assert found_repeats(df) == plain_repeats([(i, t.encode()) for i, t in rows])
    assert found_repeats(df.repartition(7)) == found_repeats(df, crowd=2)


def test_op11_long_runs_and_blocks(spark, monkeypatch):
    """Texts of several blocks and contexts of several solves give the same."""
    for name, value in (("BLOCK", 512), ("PIECE", 16), ("SORTED", 2000), ("MANY", 5)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(6)
    whole = "".join(rng.choice("abcd") for _ in range(3000))
    rows = [(i, whole[rng.randrange(1000) : 1000 + rng.randrange(2000)]) for i in range(30)]
    assert suffix_dedup.runs([rows[0][1].encode()], 50)[3].max() <= 16
    assert found_repeats(spark.createDataFrame(rows, DOCS)) == plain_repeats([(i, t.encode()) for i, t in rows])


def test_op11_sorts_only_contexts_that_may_repeat(monkeypatch):
    """Contexts that share a key's 16 bytes and less than a window's places are not sorted; all that share a window are, wherever the key's string stands."""
    rng = random.Random(8)
    noise = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    anchor = noise(suffix_dedup.KEY)
    key = suffix_dedup.string_hashes(anchor + bytes(8), 0, 1) >> np.uint64(16)
    unlike = [noise(34) + anchor + noise(34) for _ in range(40)]
    sorted_bytes = []
    monkeypatch.setattr(suffix_dedup, "suffix_arrays", lambda symbols, sizes: sorted_bytes.append(len(symbols)) or suffix_arrays(symbols, sizes))
    least, _ = suffix_dedup.least_ids(np.repeat(key, 40), unlike, np.arange(40), 50)
    assert not sorted_bytes and least.tolist() == np.repeat(np.arange(40), 35).tolist()
    for before in range(35):  # one window in common, the string at each place in it; the second one has the string twice
        shared = noise(before) + anchor + noise(34 - before)
        some = [*unlike[:5], noise(9) + shared + noise(7), anchor + noise(3) + shared + noise(2)]
        kept = suffix_dedup.alike(np.repeat(key, len(some)), some, 50)
        assert kept.tolist() == [False] * 5 + [True] * 2
        least, first = suffix_dedup.least_ids(np.repeat(key, len(some)), some, np.arange(len(some)), 50)
        assert least[first[5] + 9] == least[first[6] + 19] == 5 and least[first[6]] == 6


def test_op11_sorts_no_stretch_twice(monkeypatch):
    """Where a passage of many texts begins and ends, what is all theirs is sorted once and the rest in short strings; least ids are those of plain comparison."""
    rng = random.Random(9)
    noise = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    passage, longest, total = noise(200), [0], [0]

    def counted(symbols, sizes):
        longest[0], total[0] = max(longest[0], int(sizes.max())), total[0] + len(symbols)
        return suffix_arrays(symbols, sizes)

    monkeypatch.setattr(suffix_dedup, "suffix_arrays", counted)
    texts = [noise(60) + passage + noise(60) for _ in range(40)] + [noise(60) + b"ab" * 100 + noise(60) for _ in range(5)]
    key, owner, begin, size = suffix_dedup.runs(texts, 50)
    contexts = [texts[t][x : x + n + 49] for t, x, n in zip(owner.tolist(), begin.tolist(), size.tolist())]
    by = sorted({(k, c): o for k, c, o in sorted(zip(key.tolist(), contexts, owner.tolist()), key=lambda r: -r[2])}.items())
    keys, contexts, ids = np.array([k for (k, _), _ in by]), [c for (_, c), _ in by], np.array([o for _, o in by])
    least, first = suffix_dedup.least_ids(keys, contexts, ids, 50)
    plain = {}
    for c, i in zip(contexts, ids.tolist()):
        for p in range(len(c) - 49):
            plain[c[p : p + 50]] = min(i, plain.get(c[p : p + 50], i))
    for c, f in zip(contexts, first.tolist()):
        assert least[f : f + len(c) - 49].tolist() == [plain[c[p : p + 50]] for p in range(len(c) - 49)]
    assert total[0] < 9_000 and longest[0] < 2_700, (total, longest)


def test_op11_awkward(spark):
    text = "the same passage of more than fifty bytes stands in all of these rows, é"
    rows = [(5, text), (5, text), (5, "x" + text), (None, text), (None, None), (6, None), (7, ""), (3, "\0" * 60 + text), (4, "\0" * 70), (9, text + " ")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("ref", "key", "keys", "spans", "bytes", "a.b", "kept", "n")})
    got = found_repeats(df)
    assert got == plain_repeats([(i, (t or "").encode()) for i, t in rows]) and len(got) == len(rows)
    assert found_repeats(df.limit(0)) == []
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(df, length=10)


def test_op11_one_line_in_most_documents(spark):
    """A crowded line, and a text that has most rows."""
    rng = random.Random(7)
    line = "Subscribe to our weekly newsletter and never miss a single story again."
    rows = [(i, f"{rng.random()} {line} {rng.random()}") for i in range(400)] + [(1000, "one row again and again, of more than fifty bytes in all")] * 300
    expected = plain_repeats([(i, t.encode()) for i, t in rows])
    assert found_repeats(spark.createDataFrame(rows, DOCS), crowd=50) == expected == found_repeats(spark.createDataFrame(rows, DOCS))


# op12


def plain_clusters(rows, k=40, rounds=5):
    """{vec_id: (cluster, distance)} and the centroids, in plain Python integers."""
    points = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    draws = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), p) for i, p in points if i is not None)
    centroids = [p for _, p in draws[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = {}
        for _, p in points:
            of.setdefault(nearest(p)[1], []).append(p)
        for n, own in of.items():
            centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, *reversed(nearest(p))) for i, p in points), key=str), centroids


def found_clusters(df, k=40):
    found, centroids = kd_clustering.cluster(df, k=k)
    return sorted(((r.id, r.cluster, r.distance) for r in found.collect()), key=str), centroids


def test_op12_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kd_clustering, "TREE", 100)  # several trees
    vectors = common.table(spark, SF, "embeddings").limit(260)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert found_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == plain_clusters(rows)


def test_op12_query(spark):
    out = queries.op12_centroid_clustering(spark, SF).collect()
    assert {r.inertia for r in out} == {sum(r.distance for r in out)}
    for c in {r.cluster for r in out}:
        own = [r for r in out if r.cluster == c]
        assert {r.cluster_inertia for r in own} == {sum(r.distance for r in own)} and len({r.centroid_sha256 for r in own}) == 1


def test_op12_ties_nulls_and_repeats(spark):
    one, other = [0.5] * 64, [-0.25] * 64
    rows = [(1, one), (1, one), (2, other), (2, one), (None, one), (3, None), (4, one[:63]), (5, [*one[:63], None]), (6, [*one[:63], float("nan")]), (7, [*one[:63], float("inf")])] + [(20 + i, [i / 64.0] * 64) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(7) for c in ("id", "x", "n", "cluster", "h", "a.b")})
    assert found_clusters(df, k=4) == plain_clusters(rows, k=4)
    assert found_clusters(df, k=40) == plain_clusters(rows, k=40)  # fewer vectors than centroids: repeated ones are centroids too
    assert found_clusters(df.limit(0)) == ([], [])
    hot = spark.createDataFrame([(i, one) for i in range(500)] + [(600, other)], "vec_id long, embedding array<float>")
    assert found_clusters(hot, k=3) == plain_clusters([(i, one) for i in range(500)] + [(600, other)], k=3)


def test_op12_large_components_stay_exact():
    rng = np.random.default_rng(3)
    points, centroids = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-(1 << 27), 1 << 27, (5, 64))
    assert kd_clustering.distances(points, centroids).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in centroids] for p in points]


@pytest.mark.parametrize("width", [1, 2, 5])
def test_kd_trees_prune_nothing_that_may_be_nearest(width):
    """Trees give the sums of a scan, also with ties on integer grids, and settle most points without comparing them."""
    rng = np.random.default_rng(width)
    points, centroids = rng.integers(0, 60, (4000, width)), rng.integers(0, 60, (12, width))
    nodes, order = kd_clustering.build(points)
    tree = nodes | {"points": points[order].astype(np.int32)}
    to = ((points[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
    n, total = kd_clustering.sums(tree, centroids)
    assert n.tolist() == np.bincount(to, minlength=12).tolist()
    assert total.tolist() == [points[to == c].sum(axis=0).tolist() for c in range(12)]
    assert kd_clustering.assigned(tree, centroids)[0].tolist() == to[order].tolist()
    if width < 5:
        assert sum(tree["n"][i] for i, left in kd_clustering.walk(tree, centroids) if len(left) == 1) > 1000


# op13


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    rows = [(i, Counter(t)) for i, text in docs if (t := plain_terms(text))]
    n_docs, n_terms, df = len(rows), sum(c.total() for _, c in rows), Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        own, scored = Counter(plain_terms(text)), []
        for doc, c in rows:
            m = 25 + 75 * c.total() * n_docs // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in own.items() if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found_search(docs, items, **options):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(docs, items, **options).collect()), key=str)


@pytest.mark.parametrize("shard,step,block", [(1 << 14, 1 << 11, 4 << 20), (40, 16, 500)])
def test_op13_is_brute_force(spark, monkeypatch, shard, step, block):
    for name, value in (("SHARD", shard), ("STEP", step), ("ITEM_BYTES", block)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    assert found_search(docs.repartition(3), items) == plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_op13_ties_nulls_and_repeats(spark):
    docs = [(9, "Alpha beta"), (3, "alpha BETA"), (3, "alpha beta"), (None, "alpha beta"), (4, None), (5, ""), (6, "--"), (7, "é alpha İx ÉE"), (8, "beta " * 20_000), (2, "unrelated words only")] + [(100 + i, "alpha beta gamma") for i in range(20)]
    items = [(1, "alpha, Beta"), (1, "beta beta"), (2, None), (3, ""), (4, "nothing there"), (None, "é İx"), (5, "gamma alpha gamma")]
    d = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(7) for c in ("row", "score", "rank", "terms", "n", "item_id", "a.b")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(7) for c in ("row", "score", "doc_id", "t")})
    assert found_search(d, i) == plain_search(docs, items)
    assert found_search(d, i, k=2) == plain_search(docs, items, k=2)
    assert found_search(d.limit(0), i) == found_search(d, i.limit(0)) == found_search(d.where("doc_id = 6"), i) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aZ09-_\t\n\x00\x7f éİ﻿", max_size=40))
def test_op13_terms(text):
    assert [t.decode() for t in lexical_search.terms_of(text)] == plain_terms(text)


def test_op13_bounds_spare_weak_postings():
    """A term in every document is not looked at for all of them once rare ones have given k better documents."""
    rng = random.Random(4)
    n = 20_000
    held, terms, times = [], [], []
    for i in range(n):
        own = [0] + ([1] if i < 15 or rng.random() < 0.001 else []) + ([2] if i < 12 else [])
        held.append(len(own))
        terms += own
        times += [1] * len(own)
    df = Counter(terms)
    weights = np.array([lexical_search.weight(n, df[t]) for t in range(3)])
    shard = lexical_search.Shard(list(range(n)), np.full(n, 10), np.array(held), np.array(terms), np.array(times), weights, n, 10 * n)
    assert [d for _, d in shard.best(Counter({0: 1, 1: 1, 2: 1}), 10)] == list(range(10))
    assert shard.probed < n / 4
