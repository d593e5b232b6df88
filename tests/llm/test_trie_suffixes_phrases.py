"""Phrase mining, suffix sorting and the prefix trie against plain code on small tables."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenora.llm import sieve
from tenora.llm import suffix_sort as ss
from tenora.llm.collocations import _slices, collocations
from tenora.llm.prefix_trie import fattest, prefix_trie
from tenora.plans.staging import staged

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mined(rows, least, top, drop):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= drop * f[p[i : i + k]]}
        scored = []
        for p, a in good.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for n, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, n, phrase.decode(), -a, left, right, total[lang], -score))
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("least", "top", "seed"), [(5, 2000, 1), (4, 12, 2)])
def test_collocations(spark, least, top, seed):
    rnd = random.Random(seed)
    phrases = ["new york city", "in spite of", "as well as the", "é à", "a a a a", "The End"]
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rnd.randrange(1, 40)):
            parts.append(rnd.choice(phrases) if rnd.random() < 0.4 else rnd.choice(words))
            parts.append(rnd.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b"]))
        rows.append((rnd.choice(["en", "fr", None]), "".join(parts)))
    rows += [("xx", None), ("xx", ""), ("en", " \t "), ("zz", "one two " * 50), ("zz", "one two " * 50)]
    df = spark.createDataFrame([(r[0], r[1], 1) for r in rows], "lang string, text string, word long").repartition(5)
    assert {tuple(r) for r in collocations(df, least, top).select(*COLUMNS).collect()} == mined(rows, least, top, 80)
    assert len(mined(rows, least, top, 80)) > 20


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    out = collocations(empty)
    assert out.columns == COLUMNS and out.count() == 0


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr("tenora.llm.collocations.SLICE", 50)
    text = "".join(f"word{i} other{i}. " for i in range(200)) + "x" * 300
    parts = list(_slices(text))
    assert b"".join(parts).replace(b"\n", b".") == text.encode() and len(parts) > 10
    assert all(p.startswith(b"\n") for p in parts[1:])


@pytest.mark.parametrize("text", [".", ".a" * 3, "a. " + "b" * 60, "." + "a" * 60 + "." + "b" * 60 + ".", "." * 130, "a" * 60])
def test_slices_end_whatever_stands_behind_the_last_end_of_a_piece(monkeypatch, text):
    monkeypatch.setattr("tenora.llm.collocations.SLICE", 50)
    parts = list(islice(_slices(text), 1000))
    assert b"".join(parts).replace(b"\n", b".") == text.encode() and all(parts)


@pytest.mark.parametrize("bits", [1 << 25, 1 << 15])
def test_rows_that_occur_among_the_keys_are_not_shuffled_whole(spark, monkeypatch, bits):
    monkeypatch.setattr(sieve, "BITS", bits)  # few bits: many rows are held back by chance
    rows = spark.createDataFrame([(i if i else None, f"text {i}") for i in range(20000)], "row long, text string")
    keys = staged(spark.range(1, 20000, 2).withColumnRenamed("id", "row"), "keys")
    out = sieve.without_wide(rows, keys, "row")
    assert sorted(r["text"] for r in out.collect()) == sorted(f"text {i}" for i in range(0, 20000, 2)) and out.columns == rows.columns
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def cut_plainly(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(b[i : i + size]).digest() for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[hashlib.md5(b[i : i + size]).digest()] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), kept))
    return out


def repeating_texts(seed, n=200):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(2500))
    texts = []
    for k in range(n):
        a, size = rnd.randrange(0, 1900), rnd.randrange(300, 600)
        ends = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 150))) for _ in range(2)]
        texts.append(ends[0] + base[a : a + size] + ends[1] + (base[100:520] if k % 7 == 0 else "") + ("x" * rnd.randrange(300, 900) if k % 11 == 0 else ""))
    return [*texts, texts[3], None, "", texts[5][:400], "z" * 400, "y" * 401, "ab" * 300, base * 2]


@pytest.mark.parametrize(("seed", "range_"), [(1, 1 << 15), (2, 40)])
def test_repeated_bytes(spark, monkeypatch, seed, range_):
    monkeypatch.setattr(ss, "RANGE", range_)  # many ranges: equal windows of different ranges meet by their hashes
    texts = repeating_texts(seed)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row long").repartition(4)
    out = ss.without_repeats(df)
    assert out.columns == ["doc_id", "text", "row", "cut"]
    got = {r["doc_id"]: (r["cut"]["n_removed"], len(r["cut"]["spans"]), bytes(r["cut"]["kept"])) for r in out.collect()}
    assert got == dict(enumerate(cut_plainly(texts, 400)))
    assert sum(x[0] for x in got.values()) > 50_000
    assert ss.without_repeats(df.limit(0)).count() == 0


def test_copies_remove_each_other(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefg ") for _ in range(700))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short"), (3, text[::-1])], "doc_id long, text string")
    got = sorted((r["cut"]["n_removed"], len(r["cut"]["kept"])) for r in ss.without_repeats(df).collect())
    assert got == [(0, 5), (0, 700), (700, 0), (700, 0), (700, 0)]


def test_cut_texts_give_the_same_windows(monkeypatch):
    texts = [t.encode() for t in repeating_texts(7, 30) if t]

    def windows(chunk):
        monkeypatch.setattr(ss, "CHUNK", chunk)
        out = {}
        for s in ss.Stretches(400).of(list(range(len(texts))), texts):
            for row, lo, hi, anchor, head in zip(*(s[c].tolist() for c in ("row", "lo", "hi", "anchor", "head")), strict=True):
                for w in range(lo, hi + 1):
                    assert (row, w) not in out
                    out[row, w] = (anchor, head)
        return out

    whole = windows(1 << 19)
    assert whole == windows(700) and len(whole) == sum(max(0, len(t) - 399) for t in texts)
    # equal windows have anchors at equal distances
    place = {}
    for (row, w), (anchor, head) in whole.items():
        assert place.setdefault(texts[row][w : w + 400], (anchor - w, head)) == (anchor - w, head)


def test_loser_tree_merges_by_known_prefixes():
    rnd = random.Random(3)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 12))) for _ in range(rnd.randrange(1, 60))) for _ in range(7)]
    merged, last = [], b""
    coded = [ss.Run(*ss.front_coded(r)) for r in runs]
    for run, i, shared in ss.LoserTree(coded):
        key = coded[run].key
        assert key == runs[run][i] and shared == ss.common(last, key)
        merged.append(key)
        last = key
    assert merged == sorted(k for r in runs for k in r)
    assert list(ss.LoserTree([])) == []


def test_fattest_numbers(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", fattest(F.col("a"), F.col("b")).alias("f"))
    for r in df.collect():
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x)


def trie_plainly(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if full[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_conversations(rnd, convs, longest):
    rows = []
    for c in rnd.sample(range(-8, 4 * convs), convs):
        for turn in range(rnd.randrange(1, longest)):
            rows.append((c, rnd.choice([turn, turn, turn, None, 0]), rnd.choice(["user", "assistant", None]), rnd.choice(["", "hé", "yes", "no", None])))
    return rows + [(None, 1, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]


@pytest.mark.parametrize(("seed", "convs", "longest"), [(1, 50, 6), (2, 12, 20)])
def test_prefix_trie(spark, seed, convs, longest):
    rows = random_conversations(random.Random(seed), convs, longest)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == trie_plainly(rows)


def test_tries_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], schema)).count() == 0
    # crc32 of "1" modulo 9 is not 0, and conversation 0 does not exist: nothing of its one turn is left
    assert zlib.crc32(b"1") % 9 > 0
    rows = [(1, 0, "user", "x")]
    assert [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, schema)).collect()] == trie_plainly(rows)


def test_equal_windows_at_every_distance():
    rnd = np.random.default_rng(1)
    n, length, wide = 60, 30, 8
    keys = sorted((bytes(rnd.integers(97, 99, length)), bytes(rnd.integers(97, 99, wide))) for _ in range(n))
    keys = sorted([*keys, *[(r, left[:k] + b"z" * (wide - k)) for (r, left), k in zip(keys, rnd.integers(0, wide, n), strict=True)]])
    far = rnd.integers(0, wide + 1, len(keys))
    near = np.minimum(rnd.integers(0, 3, len(keys)), far)
    joined = [r + left[:f] for (r, left), f in zip(keys, far, strict=True)]
    order = sorted(range(len(keys)), key=lambda i: joined[i])
    joined, far, near = [joined[i] for i in order], far[order], near[order]
    shared = np.array([0, *[ss.common(a, b) for a, b in zip(joined, joined[1:], strict=False)]])
    found = {(d, i) for d, who in ss.equal_windows([k[length:] for k in joined], shared, near, far, length) for i in who.tolist()}
    want = set()
    for d in range(wide + 1):
        window = {i: (k[: length - d], k[length : length + d]) for i, k in enumerate(joined) if near[i] <= d <= far[i]}
        n_same = Counter(window.values())
        want |= {(d, i) for i, w in window.items() if n_same[w] > 1}
    assert found == want and want
    assert bisect_left([b"a"], b"b") == 1
