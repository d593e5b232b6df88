"""Exact copies, near copies, repeated passages and vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenora.llm import exact_dedup, graph, jaccard_join, shingles, sieve, substring_dedup, vector_join
from tenora.llm.heavy import MisraGries, heavy_hitters

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows):
    """(doc_id, text) with columns whose names the operators use themselves."""
    wide = [(i, t, "x", 1, "y", 2, "z", 3) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, digest string, row int, name string, keep int, part string, bits int")


def reach(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_misra_gries_bound(items, capacity):
    summary = MisraGries(capacity)
    for at in range(0, len(items), 17):
        part = items[at : at + 17]
        summary.add({k: part.count(k) for k in set(part)})
    for k in set(items):
        kept, true = summary.counters.get(k, 0), items.count(k)
        assert kept <= true <= kept + len(items) / (capacity + 1)
    assert len(summary.counters) <= capacity


def test_heavy_hitters_are_found(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit("warm")).otherwise(F.col("id").cast("string")).alias("k"))
    found = {r["k"] for r in heavy_hitters(df, "k", share=100, capacity=400).collect()}
    assert {"hot"} <= found and len(found) <= 200


def test_exact_dedup(spark):
    rows = [(5, "a b"), (3, "a\t b"), (9, "a\n\x0bb"), (1, "a\xa0b"), (2, None), (4, ""), (7, " "), (8, "x" * 300_000), (6, "x" * 300_000), (None, "q"), (11, "A b"), (3, "a b")] + [(100 + i, "hot  text") for i in range(500)]
    out = exact_dedup.exact_dedup(documents(spark, rows), share=10).collect()
    assert len(out) == len(rows)
    norm = lambda t: BLANK.sub(" ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    names = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        ids = names[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["doc_id"] in ids and r["group_size"] == len(ids) and r["keep_id"] == (min(known) if known else None)
    for name in names:
        assert sum(r["kept"] for r in out if r["text_sha256"] == name) == 1
    left = exact_dedup.drop_copies(documents(spark, rows), share=10)
    assert left.columns == documents(spark, rows).columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left.collect() if r["doc_id"] is not None) == sorted((False, min(i for i in v if i is not None)) for v in groups.values() if v != [None])
    assert left.count() == len(groups)
    none = documents(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 4)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert out == {n: c for n, c in reach({x for e in real for x in e}, real).items()}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    i, j = np.array([0, 4, 2]), np.array([1, 2, 3])
    assert graph.forest(6, i, j).tolist() == [0, 0, 2, 2, 2, 5]


def test_sieve(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k").withColumn("part", F.lit(1))
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    assert sieve.sieved(rows, keys, "k").count() == keys.count()
    assert sieve.without(rows.unionByName(spark.createDataFrame([(None, 1)], "k long, part int")), keys, "k").count() == 5001 - keys.count()


def test_shingles_equal_slow_ones():
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) if w]
    rng = random.Random(5)
    texts = [prose(rng, n, 12) for n in (0, 1, 4, 5, 6, 40, 200)] + ["  A\tb ", "a B", "É é x y z", None, "", "w" * 5000 + " a b c d", "ab " * 300]
    names, seen = {}, {}
    for t, hashes in zip(texts, shingles.shingles_in_order(texts), strict=True):
        w = words(t or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        assert len(grams) == len(hashes)
        for g, h in zip(grams, hashes.tolist(), strict=True):
            assert names.setdefault(g, h) == h and seen.setdefault(h, g) == g


def jaccard_brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = [x for x in BLANK.split((t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = list(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, reach(ids, links)


def near_copies(rng):
    rows, i = [], 0
    line = prose(rng, 12)
    for _ in range(25):
        base = prose(rng, rng.choice([4, 20, 60, 150])).split()
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            text = " ".join(copy)
            rows.append((i, rng.choice([text, text.upper(), f"{line}\n{text}"])))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, prose(rng, 30_000)), (i + 4, "one"), (i + 5, "ONE")]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed, monkeypatch):
    if seed == 2:  # groups larger than a tile
        monkeypatch.setattr(jaccard_join, "TILE", 3)
    rows = near_copies(random.Random(seed))
    rows += [(5000 + i, rows[0][1]) for i in range(40)]
    n, root = jaccard_brute(rows)
    out = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} == {(i, n[i], root[i]) for i, _ in rows}


def test_large_balls_of_unlike_copies(spark, monkeypatch):
    # all share half their shingles with the first, so that it heads them, but few of them are near it
    monkeypatch.setattr(jaccard_join, "TILE", 2)
    rng = random.Random(11)
    half = prose(rng, 40)
    ends = [prose(rng, 40) for _ in range(4)]
    rows = [(0, half)]
    for i in range(1, 41):
        words = f"{half} {ends[i % 4]}".split()
        words[rng.randrange(40, 80)] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(7, "another text with the same id as one before it"), (None, rows[3][1] + " z")]
    n, root = jaccard_brute([r for r in rows[:41]])
    assert len(set(root.values())) == 5
    out = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert {(i, n[i], root[i]) for i in n} <= {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} and len(out) == len(rows)


def test_overlaps_are_exact_integers():
    big = np.arange(1, 300_001, dtype=np.uint64)
    both = jaccard_join.overlaps([big, big[:225_000], big[1:]], columns=1 << 15)
    assert both.dtype == np.int64 and both[0, 1] == 225_000 and both[0, 2] == 299_999 and both[1, 2] == 224_999


def test_jaccard_odd_rows(spark):
    assert jaccard_join.jaccard_components(documents(spark, [])).count() == 0
    out = jaccard_join.jaccard_components(documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)])).collect()
    assert sorted(str(r["component_id"]) for r in out) == ["1", "1", "1", "2"]
    alone = jaccard_join.jaccard_components(documents(spark, [(1, "x"), (2, "y")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in alone} == {(1, 1), (2, 2)}


def test_shingles_of_one_class_are_not_shuffled(spark, monkeypatch):
    """Of texts that share nothing, and of word-for-word copies, next to nothing is shown to others; of two near ones, what they share."""
    rng = random.Random(12)
    rows = [(i, prose(rng, 200, 10**6)) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(60)]
    near = rows[7][1].split()
    near[100] = "changed"
    rows.append((400, " ".join(near)))
    n, root = jaccard_brute(rows)
    told, true = [], jaccard_join.shown

    def counted(*a):
        told.append(true(*a).cache())
        return told[0]

    monkeypatch.setattr(jaccard_join, "shown", counted)
    out = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} == {(i, n[i], root[i]) for i, _ in rows} and root[400] == 7
    assert 90 <= told[0].count() <= 400  # of some 30,000
    told[0].unpersist()


def test_passages_shared_with_many_bring_few_texts_together(spark, monkeypatch):
    """Nine texts of eight passages, each shared with another one of them: enough in all, too little with any."""
    rng = random.Random(13)
    passage = {(i, j): prose(rng, 30, 10**6) for i in range(9) for j in range(i)}
    rows = [(i, " ".join(passage[max(i, j), min(i, j)] for j in range(9) if j != i)) for i in range(9)]
    rows.append((20, rows[4][1] + " more"))
    told, true = [], jaccard_join.ball_links

    def counted(balls, *a):
        told.extend(r["doc_id"] for r in balls.collect())
        return true(balls, *a)

    monkeypatch.setattr(jaccard_join, "ball_links", counted)
    out = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == jaccard_brute(rows)[1] == {i: 4 if i == 20 else i for i, _ in rows}
    assert {4, 20} <= set(told) and len(set(told)) <= 6


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.integers(6, 12))
@settings(max_examples=100, deadline=None)
def test_packed_shingles_come_back(tokens, bits):
    tokens = tokens + tokens[:3] + [tokens[0] ^ 1, 0, 2**64 - 1]
    got = [(bucket << 32) | int(k) for bucket, data in jaccard_join.packed(np.array(tokens, np.uint64), bits) for k in jaccard_join.unpacked(data)]
    assert got == sorted(t >> (32 - bits) for t in tokens)


@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_prefixes_of_similar_sets_share_enough(a, b, seed):
    loads = np.random.default_rng(seed).integers(0, 4, 1 << jaccard_join.BUCKET_BITS).astype(np.int32)
    spread = lambda x: np.unique(shingles.mixed(np.array(sorted(set(x)), np.uint64)))
    x, y = spread(a), spread(b)
    both = len(np.intersect1d(x, y))
    if 100 * both >= 75 * (len(x) + len(y) - both):
        (p, k), (q, m) = jaccard_join.prefix(x, loads, 75), jaccard_join.prefix(y, loads, 75)
        assert len(np.intersect1d(p, q)) >= min(k, m)


def test_repeated_passages(spark):
    rng = random.Random(11)
    passage, other = prose(rng, 60), prose(rng, 80)
    near = other.split()
    near[40] = "changed"
    rows = [(1, f"{prose(rng, 30)} {passage} {prose(rng, 50)}"), (2, f"{passage} {prose(rng, 10)}"), (3, prose(rng, 200)), (4, f"{prose(rng, 100)} {passage}\n{prose(rng, 5)} {passage}"), (5, other), (6, " ".join(near)), (7, None), (8, ""), (9, "short"), (10, prose(rng, 40)), (None, passage)]
    short = prose(rng, 40)
    rows += [(20, f"{short} {prose(rng, 60)}"), (21, f"{prose(rng, 60)} {short}")] + [(100 + i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(60)]
    out = substring_dedup.repeated_passages(documents(spark, rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["first_word"], r["last_word"], r["source_id"], r["kept"]))
    assert set(by) == {1, 2, 4, 5, 6, *range(100, 160)}
    assert by[1] == [(30, 89, 1, True)] and by[2] == [(0, 59, 1, False)] and sorted(by[4]) == [(100, 159, 1, False), (165, 224, 1, False)]
    assert by[5] == [(0, 79, 5, True)] and by[100] == [(20, 79, 1, False)]
    assert substring_dedup.repeated_passages(documents(spark, [])).count() == 0


def test_changed_passages_are_verified():
    rng = random.Random(17)
    grams = lambda w: [hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)]
    tried = 0
    for n in (50, 55, 60, 80, 100):
        base = prose(rng, n + 1).split()
        for at in range(n):
            forms = (base[:n], base[:at] + ["new"] + base[at + 1 : n]), (base[:n], base[:at] + ["new"] + base[at:n]), (base[: n + 1], base[:at] + base[at + 1 : n + 1])
            for one, two in forms:
                a, b = set(grams(one)), set(grams(two))
                if 100 * len(a & b) < 75 * len(a | b):
                    continue
                x, y = (np.array(grams(prose(rng, 60).split() + part + prose(rng, 60).split())) for part in (one, two))
                found = list(substring_dedup.passages(x, y, 0, 46, 75))
                assert found and all(substring_dedup.similar(x[i:j], y[k:m], 75) and min(j - i, m - k) >= 46 for i, j, k, m in found), (n, at)
                assert max(j - i for i, j, _, _ in found) >= n - 4 - 6
                tried += 1
    assert tried > 800


def test_near_passages_are_all_found(spark):
    rng = random.Random(23)
    rows, i = [], 0
    for n in (50, 50, 52, 55, 60, 75, 100):
        for at in range(2, n - 2, 5):
            one = prose(rng, n).split()
            two = one[:at] + rng.choice([["new"], ["new", one[at]], []]) + one[at + 1 :]
            a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (one, two))
            if len(two) < 50 or 100 * len(a & b) < 75 * len(a | b):
                continue
            rows += [(i, f"{prose(rng, 70)} {' '.join(one)} {prose(rng, 70)}"), (i + 1, f"{prose(rng, 30)} {' '.join(two)} {prose(rng, 90)}")]
            i += 2
    found = {r["doc_id"] for r in substring_dedup.repeated_passages(documents(spark, rows)).collect()}
    assert i > 120 and found == set(range(i))


def slow_windows(h, span):
    """Compact windows by looking left and right of every place."""
    out = []
    for c in range(len(h)):
        left = right = c
        while left and h[left - 1] > h[c]:
            left -= 1
        while right + 1 < len(h) and h[right + 1] > h[c]:
            right += 1
        if right - left + 1 >= span:
            out.append((left, c, right))
    return out


def test_compact_windows_equal_slow_ones():
    rng = np.random.default_rng(5)
    for span in (1, 3, 10, 46):
        lengths = np.array([0, 5, 46, 120, 1, 300])
        rows = rng.integers(0, 1 << 60, lengths.sum()).astype(np.uint64)
        text, low, centre, high = substring_dedup.compact_windows(lengths, rows, span, np.uint64(77))
        got = list(zip(text.tolist(), low.tolist(), centre.tolist(), high.tolist(), strict=True))
        want, at = [], 0
        for t, n in enumerate(lengths):
            h = shingles.mixed(rows[at : at + n] ^ np.uint64(77)) >> np.uint64(20)
            want += [(t, *w) for w in slow_windows(h.tolist(), span)] if n >= span else []
            at += n
        assert got == want


def test_repeating_text_has_few_windows():
    for period in (1, 3, 40):
        rows = np.tile(np.random.default_rng(period).integers(0, 1 << 60, period).astype(np.uint64), 12_000 // period)
        text, key, place = substring_dedup.signatures(np.array([len(rows)]), rows, 46, 4)
        assert len(key) <= 4 * (12_000 // substring_dedup.RUN + 2)
        _, first, last = substring_dedup.unpacked(place)
        assert first.min() == 0 and last.max() == len(rows) - 46


def test_interval_join_equals_counting():
    rng = np.random.default_rng(9)
    for _ in range(50):
        n = int(rng.integers(3, 40))
        a, b, c = rng.integers(0, 2, n), rng.integers(5, 7, n), rng.integers(50, 120, n)
        first, last = c - rng.integers(20, 46, n), c - rng.integers(0, 20, n)
        at, place = substring_dedup.packed(c, first, last), substring_dedup.packed(c + 7, c + 7, c + 7)
        found = {}
        for x, y, d, low, high in zip(*(v.tolist() for v in substring_dedup.regions(a, b, at, place, 3)), strict=True):
            assert d == 7
            found.setdefault((x, y), set()).update(range(low, high + 1))
        for x in (0, 1):
            for y in (5, 6):
                own = (a == x) & (b == y)
                assert {p for p in range(200) if ((first <= p) & (p <= last) & own).sum() >= 3} == found.get((x, y), set())


def test_recall_of_near_passages(spark):
    """Passages with words changed, put in and left out, of all similarities from 0.75: found or not, against the sets themselves."""
    rng = random.Random(31)
    rows, i = [], 0
    while i < 900:
        one = prose(rng, rng.choice([55, 70, 90, 120])).split()
        two = list(one)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            at = rng.randrange(len(two))
            two[at : at + rng.choice([0, 1, 1, 2])] = [f"n{rng.randrange(10**6)}"] * rng.choice([0, 1, 1, 2])
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (one, two))
        if len(two) < 50 or one == two or 100 * len(a & b) < 75 * len(a | b):
            continue
        rows += [(i, f"{prose(rng, 70)} {' '.join(one)} {prose(rng, 70)}"), (i + 1, f"{prose(rng, 30)} {' '.join(two)} {prose(rng, 90)}")]
        i += 2
    clean = [(10_000 + k, prose(rng, 200)) for k in range(200)]
    found = {r["doc_id"] for r in substring_dedup.repeated_passages(documents(spark, rows + clean)).collect()}
    assert not {d for d in found if d >= 10_000}
    assert len(found) / len(rows) > 0.97


def test_whole_copies(spark):
    rng = random.Random(37)
    text, short = prose(rng, 90), prose(rng, 30)
    rows = [(i, text) for i in range(5, 40)] + [(3, short), (4, short), (5, text), (50, f"{prose(rng, 20)} {text.upper()}"), (60, " ".join(["again"] * 500)), (61, "x " + " ".join(["again"] * 400)), (7, prose(rng, 200))]
    out = {(r["doc_id"], r["first_word"], r["last_word"], r["source_id"]) for r in substring_dedup.repeated_passages(documents(spark, rows)).collect()}
    assert {(60, 0, 499, 60), (61, 1, 400, 60)} <= out
    assert {(i, 0, 89, 5) for i in range(5, 40)} | {(50, 20, 109, 5)} <= out and {r[0] for r in out} <= {*range(5, 40), 50, 60, 61}


def test_passages_around_common_quotes(spark):
    rng = random.Random(29)
    rows = []
    quotes = [prose(rng, 30) for _ in range(3)]
    for q, quote in enumerate(quotes):  # smaller ids hold each quote alone
        rows += [(100 * q + k, f"{prose(rng, 60)} {quote} {prose(rng, 60)}") for k in range(40 if q else 90)]
    for k in range(3):
        passage = f"{quotes[k]} {quotes[(k + 1) % 3]}"  # quotes only, in an order that two documents share
        rows += [(1000 + 2 * k + c, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for c in (0, 1)]
    out = {r["doc_id"]: (r["first_word"], r["last_word"], r["source_id"]) for r in substring_dedup.repeated_passages(documents(spark, rows)).collect()}
    assert out == {1000 + 2 * k + c: (60, 119, 1000 + 2 * k) for k in range(3) for c in (0, 1)}


def test_compact_windows_are_minima():
    rows = np.random.default_rng(2).integers(0, 1 << 40, 500).astype(np.uint64)
    for span in (1, 2, 7, 46, 64):
        least = substring_dedup.least_hashes(rows, np.uint64(9), span)
        h = (shingles.mixed(rows ^ np.uint64(9)) & ~np.uint64((1 << 20) - 1)) | np.arange(500, dtype=np.uint64)
        assert least.tolist() == [h[i : i + span].min() for i in range(500 - span + 1)]


def vector_brute(vectors, threshold=0.95):
    fine = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in fine for b in fine if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] / (np.linalg.norm(fine[a]) * np.linalg.norm(fine[b])) >= threshold]
    count = {i: 0 for i, _ in vectors}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, reach([i for i, _ in vectors], links)


@pytest.mark.parametrize("size", [64, 3])
def test_vectors(spark, size):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for _ in range(40):
        base = rng.normal(size=size)
        for _ in range(int(rng.choice([1, 3, 9]))):
            rows.append((i, [float(x) for x in base * rng.uniform(0.1, 9) + rng.normal(size=size) * rng.choice([0, 0.05, 0.2, 0.3])]))
            i += 1
    rows += [(i, None), (i + 1, [0.0] * size), (i + 2, [float("nan")] * size), (i + 3, [None] * size), (i + 4, []), (i + 5, [1.0, 0.0]), (i + 6, [2.0, 0.0]), (i + 7, [float("inf")] * size)]
    count, root = vector_brute(rows)
    df = spark.createDataFrame([(a, b, 7, 8) for a, b in rows], "vec_id long, embedding array<double>, row int, size int")
    out = vector_join.vector_components(df).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out} == {(a, count[a], root[a], root[a] == a) for a, _ in rows}
    assert vector_join.vector_components(df.limit(0)).count() == 0
    assert vector_join.vector_components(df.where("vec_id >= " + str(i)).where("size(embedding) > 2")).where("n_links > 0").count() == 0
    twice = vector_join.vector_components(df.limit(1).unionByName(df.limit(1))).collect()
    assert [r["n_links"] for r in twice] == [1, 1]


def test_tiled_vectors(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 16)) * 0.1 + rng.normal(size=16)
    spaces = vector_join.Subspaces(vector_join.unit_rows(x), 0.95)
    found = set()
    for b in range(len(spaces.blocks)):
        i, j = vector_join.linked_pairs(spaces, b, x, None, 0.95, step=7)
        new = set(zip(i.tolist(), j.tolist(), strict=True))
        assert not new & found
        found |= new
    u = vector_join.unit_rows(x)
    assert found == {(a, b) for a in range(50) for b in range(a + 1, 50) if u[a] @ u[b] >= 0.95}


def test_vectors_in_boxes(spark, monkeypatch):
    """Boxes of few rows, more equal and similar vectors than a box holds, and visitors in several tasks."""
    monkeypatch.setattr(vector_join, "FEW", 100)
    monkeypatch.setattr(vector_join, "LEAST_BOX", 16)
    monkeypatch.setattr(vector_join, "BOX_BYTES", 16 * 24 * 4)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 24))
    many = np.concatenate([base[rng.integers(0, 60, 400)] + rng.normal(size=(400, 24)) * rng.choice([0, 0.1, 0.25, 0.3], (400, 1)), np.repeat(base[:1], 150, 0), base[1] + rng.normal(size=(150, 24)) * 0.1])
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(many)]
    rows += [(1000 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(30, 3)).astype(np.float32))] + [(2000, None)]
    count, root = vector_brute(rows)
    out = vector_join.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == sorted((a, count[a], root[a]) for a, _ in rows)


def test_boxes_bring_near_vectors_together():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 6)) * [1, 1, 0.5, 0.5, 0.2, 0]
    for budget in (0.0, 0.05, 0.6):
        boxes = vector_join.Boxes(x[:200], budget, 5)
        rows, box, lives = boxes.places(x)
        assert boxes.count > 8 and sorted(rows[lives]) == list(range(700))
        home = dict(zip(rows[lives].tolist(), box[lives].tolist(), strict=True))
        visits = set(zip(rows[~lives].tolist(), box[~lives].tolist(), strict=True))
        near = ((x[:, None] - x[None]) ** 2).sum(2) <= budget
        for i, j in zip(*(z.tolist() for z in np.nonzero(near)), strict=True):
            assert home[i] >= home[j] or (i, home[j]) in visits


def test_word_for_word_repeats_behind_quotes(spark):
    """Passages in two documents each, parts of which many documents with smaller ids hold."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    some = lambda n: [word() for _ in range(n)]
    passages = [some(60) for _ in range(60)]
    rows = []
    for p in passages:
        for _ in range(24):
            at = rnd.randrange(0, 27)
            rows.append(some(30) + p[at : at + 34] + some(30))
    first = len(rows)
    for p in passages:
        rows += [some(40) + p + some(20), some(10) + p + some(50)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["first_word"], r["last_word"]) for r in substring_dedup.repeated_passages(df).collect() if r["doc_id"] >= first}
    for k in range(len(passages)):
        for i, before in ((first + 2 * k, 40), (first + 2 * k + 1, 10)):
            begin, end = got[i]
            assert begin <= before and end >= before + 59


def test_near_copies_judges_rows(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    near = [*words[:59], "other"]
    rows = [(3, " ".join(words)), (7, " ".join(near)), (7, "something else that stands alone in this table"), (None, " ".join(near)), (None, None), (9, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, source string")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect()), key=str)
    assert got == sorted([(3, " ".join(words)[:9]), (7, "something"), (None, ""), (9, "")], key=str)
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "jaccard_join", "pii", "packing"])
def test_stages_take_odd_tables(spark, name):
    """Nulls in any column, an empty table, repeated rows and ids, clashing names and a long text."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest int, kept string, row int, lengths int, component_id int, part int, rank string"
    long = " ".join(f"word{i % 977} is here" for i in range(9000))
    rows = [(1, "The cat sat on the mat with a hat", "en", "s", 5), (1, "The cat sat on the mat with a hat", "en", "s", 5), (None, None, None, None, None), (2, "", "fr", None, 0), (None, "Le chat est sur la table", None, "s", None), (3, long, "en", "s", None)]
    docs = spark.createDataFrame([(*r, 1, "k", 1, 1, 1, 1, "r") for r in rows], schema)
    out = stage(spark, docs, "")
    n = out.count()
    assert n >= 1 and (name == "packing" or out.columns == docs.columns)
    if name == "exact_dedup":
        assert n == 4  # the copy goes, and of the two texts without words one
    assert stage(spark, docs.limit(0), "").count() == 0
