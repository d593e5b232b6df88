"""Operator 10: near-duplicate passages by compact windows.

A text is its row of five-word shingles. For each of HASHES hash functions, the Cartesian tree of a text's hashes has a node for
every subsequence minimum: a compact window (l, c, r) says that all subsequences from [l, c] to [c, r] have their least hash at
place c. Only windows of a passage's least length are kept, some two for every such length. Windows of one function with equal
least hashes collide; each is paired with the first of its group. Collisions of a pair of documents near one diagonal are joined on
the intervals of places where a passage can begin: where the windows of MATCHES functions overlap, a passage is a candidate and
verified on all its shingles.

Windows outside all passages found go on to a second round, as the first of their group may be a document that shares a short
quote alone: there, two windows of different functions that overlap in a document make one signature, which such a quote
seldom has. In a third round, every stretch of a passage's least length that lies in a colliding window and in no passage found yet
is named by all its shingles. Word-for-word repeats meet there in any case, whatever other documents share parts of them, as all that
have such a name are equal to the first that has it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenora.llm.exact_dedup import digest, with_winner
from tenora.llm.shingles import WORDS, in_groups, mixed, shingle_rows, word_hashes
from tenora.llm.sieve import roughly, sieved, without
from tenora.plans.staging import staged

LEAST_WORDS = 50
PERCENT = 75
HASHES = 6
MATCHES = 2  # of a passage with similarity s, HASHES * s windows collide on average
_PLACES = np.uint64((1 << 20) - 1)
_SEEDS = np.random.default_rng(20240302).integers(1, 1 << 63, 64, np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
RUN = 2048
_WIDE = 64  # places that words put in or left out may move a collision off its neighbours' diagonal


def least_hashes(rows: np.ndarray, seed: np.uint64, span: int) -> np.ndarray:
    """For each place, the least hash of the ``span`` shingles from there, with its place in the low 20 bits."""
    least = (mixed(rows ^ seed) & ~_PLACES) | (np.arange(len(rows), dtype=np.uint64) & _PLACES)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return least


def tree_bounds(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node of Cartesian trees over ``values``, the nearest smaller ones on the left and on the right, as places; -1 for none.

    ``begins`` marks the first node of each tree. Built from left to right with a stack of the nodes on the right edge.
    """
    left, right = np.full(len(values), -1), np.full(len(values), -1)
    lefts, rights, stack = [-1] * len(values), [-1] * len(values), []
    for i, (v, new) in enumerate(zip(values.tolist(), begins.tolist(), strict=True)):
        if new:
            stack = []
        while stack and stack[-1][0] > v:
            rights[stack.pop()[1]] = i
        if stack:
            lefts[i] = stack[-1][1]
        stack.append((v, i))
    left[:], right[:] = lefts, rights
    return left, right


def compact_windows(lengths: np.ndarray, rows: np.ndarray, span: int, seed: np.uint64) -> tuple[np.ndarray, ...]:
    """Compact windows of at least ``span`` shingles of texts whose shingles stand in a row: text, l, c, r, all in the text.

    A node's window is that wide if and only if it is the least of some ``span`` neighbours, and then the nodes that bound it are
    such nodes too. So the tree is built over these alone.
    """
    none = np.zeros(0, np.int64)
    if len(rows) < span:
        return none, none, none, none
    least = least_hashes(rows, seed, span)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    at = np.arange(len(least))
    inside = ends[text] - at >= span
    least, at = least[inside], at[inside]
    place = at + ((least & _PLACES) - (at.astype(np.uint64) & _PLACES) & _PLACES).astype(np.int64)
    if not len(place):
        return none, none, none, none
    new = np.concatenate([[True], place[1:] != place[:-1]])
    place, value = place[new], least[new] & ~_PLACES
    own = np.searchsorted(ends, place, "right")
    left, right = tree_bounds(value, np.concatenate([[True], own[1:] != own[:-1]]))
    low = np.where(left >= 0, place[left] + 1, (ends - lengths)[own])
    high = np.where(right >= 0, place[right] - 1, ends[own] - 1)
    start = (ends - lengths)[own]
    return own, low - start, place - start, high - start


def signatures(lengths: np.ndarray, rows: np.ndarray, span: int, hashes: int = HASHES) -> tuple[np.ndarray, ...]:
    """Of all compact windows: text, key, and the place: c with the first and last place where a passage of ``span`` may begin, packed."""
    parts = []
    first = np.cumsum(lengths) - lengths
    for f in range(hashes):
        text, low, centre, high = compact_windows(lengths, rows, span, _SEEDS[f])
        key = mixed(rows[first[text] + centre] + _SEEDS[-1 - f])
        begin, end = np.maximum(low, centre - span + 1), np.minimum(centre, high - span + 1)
        if len(key):
            # text that repeats itself has many windows with one key in a row, which are one here, of RUN places at most
            other = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
            share = (begin - begin[np.flatnonzero(other)][np.cumsum(other) - 1]) // RUN
            new = np.flatnonzero(other | np.concatenate([[True], share[1:] != share[:-1]]))
            text, key, centre, begin, end = text[new], key[new], centre[new], begin[new], end[np.append(new[1:], len(key)) - 1]
        parts.append((text, key.view(np.int64), packed(centre, begin, end, f)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def packed(centre: np.ndarray, first: np.ndarray, last: np.ndarray, function: int = 0) -> np.ndarray:
    """A window's centre, its function, how far before the centre a passage may begin, and in how many places more, as one number."""
    return centre << 32 | function << 24 | (centre - first) << 12 | (last - first)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre = place >> 32
    first = centre - (place >> 12 & 4095)
    return centre, first, first + (place & 4095)


def regions(a: np.ndarray, b: np.ndarray, at: np.ndarray, place: np.ndarray, matches: int) -> tuple[np.ndarray, ...]:
    """Candidates among the collisions of pairs (a, b) of windows ``at`` in a and ``place`` in b: a, b, diagonal, low, high.

    Collisions of a pair are grouped where their diagonals lie close, and their intervals of beginnings are joined: a candidate
    begins in a at low to high, where ``matches`` of them overlap. In text that repeats itself it reaches as far as the windows
    of either document, moved to a's places.
    """
    c, first, last = unpacked(at)
    c_b, first_b, last_b = unpacked(place)
    diagonal = c_b - c
    long = (last - first > _WIDE) | (last_b - first_b > _WIDE)
    from_, to = np.where(long, np.minimum(first, first_b - diagonal), first), np.where(long, np.maximum(last, last_b - diagonal), last)
    order = np.lexsort((diagonal, b, a))
    a, b, diagonal, first, last, from_, to, long = (x[order] for x in (a, b, diagonal, first, last, from_, to, long))
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (np.diff(diagonal) > _WIDE // 4)])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    enough = (sizes >= matches)[group]
    mean = (np.bincount(group, diagonal) / sizes).astype(np.int64)
    heads = np.flatnonzero(new)
    g, first, last = group[enough], first[enough], last[enough]
    # beginnings and ends in a row: the number of open intervals is a running sum, and each group's ends at none
    where, step = np.concatenate([first, last + 1]), np.concatenate([np.ones(len(g), np.int64), -np.ones(len(g), np.int64)])
    g = np.concatenate([g, g])
    order = np.lexsort((step, where, g))
    g, where, depth = g[order], where[order], np.cumsum(step[order])
    deep = depth >= matches
    begin = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]]))
    end = np.flatnonzero(~deep & np.concatenate([[False], deep[:-1]]))
    own = heads[g[begin]]
    low, high = where[begin], where[end] - 1
    if long.any():
        least, most = np.full(len(heads), 1 << 60), np.full(len(heads), -1)
        np.minimum.at(least, group[long], from_[long])
        np.maximum.at(most, group[long], to[long])
        low, high = np.maximum(np.minimum(low, least[g[begin]]), 0), np.maximum(high, most[g[begin]])
    return a[own], b[own], mean[g[begin]], low, high


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Jaccard similarity of the two rows' sets."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _chain(x: np.ndarray, y: np.ndarray, shift: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal shingles, ascending in both rows, as many as can be, within ``band`` of the diagonal ``shift``."""
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    times = high - low
    i = np.repeat(np.arange(len(x)), times)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
    near = np.abs(j - i - shift) <= band
    i, j = i[near], j[near]
    if len(i) < 2 or ((np.diff(i) > 0) & (np.diff(j) > 0)).all():
        return i, j
    order = np.lexsort((-j, i))
    i, j = i[order], j[order]
    tails, last, before = [], [], []  # longest ascending subsequence of j; equal i stand in descending order of j
    for n, v in enumerate(j.tolist()):
        at = bisect_left(tails, v)
        before.append(last[at - 1] if at else -1)
        tails[at:at + 1], last[at:at + 1] = [v], [n]
    keep, n = [], last[-1]
    while n >= 0:
        keep.append(n)
        n = before[n]
    return i[keep[::-1]], j[keep[::-1]]


def _longest(i: np.ndarray, j: np.ndarray, sizes: tuple[int, int], least: int, percent: int) -> tuple[int, int, int, int, int, int] | None:
    """The longest similar stretch between two of the matches (i, j): first match, last match, and its begin and end in both rows.

    One that is shorter than ``least`` is filled up to it with what stands beside it, which counts as different.
    """
    n = np.arange(len(i))
    # 100 * both >= percent * (size of a + size of b - both), split into what belongs to the first and to the last match
    begin, end = (100 + percent) * n - percent * (i + j), (100 + percent) * (n + 1) - percent * (i + j + 2)
    reach = np.maximum.accumulate(end[::-1])[::-1]
    last = np.searchsorted(-reach, -begin, "right") - 1
    fits = (last >= n) & (i[last] - i >= least - 1) & (j[last] - j >= least - 1)
    if fits.any():
        s = int(np.argmax(np.where(fits, i[last] - i + j[last] - j, -1)))
        t = int(last[s])
        return s, t, int(i[s]), int(i[t]) + 1, int(j[s]), int(j[t]) + 1
    for both in range(min(2 * least, len(i)), 0, -1):
        s = n[: len(i) - both + 1]
        a, b = np.maximum(i[s + both - 1] - i[s] + 1, least), np.maximum(j[s + both - 1] - j[s] + 1, least)
        fits = (100 * both >= percent * (a + b - both)) & (a <= sizes[0]) & (b <= sizes[1])
        if fits.any():
            s = int(np.argmax(fits))
            x, y = min(int(i[s]), sizes[0] - int(a[s])), min(int(j[s]), sizes[1] - int(b[s]))
            return s, s + both - 1, x, x + int(a[s]), y, y + int(b[s])
        if 100 * both < percent * (2 * least - both):
            return None
    return None


def passages(x: np.ndarray, y: np.ndarray, shift: int, least: int, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """Similar passages near the diagonal ``shift`` of two rows, begin and end in x and in y: the longest ones, and every run without a mismatch.

    Words may be changed, put in or left out: the equal shingles are chained over neighbouring diagonals, up to ``least`` away.
    """
    a, b = max(0, -shift), max(0, shift)
    n = max(0, min(len(x) - a, len(y) - b))
    same = x[a : a + n] == y[b : b + n]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]]))).reshape(-1, 2)
    if len(edges) == 1 and edges[0, 1] - edges[0, 0] >= least:
        begin, end = edges[0] + a
        if not np.isin(np.concatenate([x[:begin], x[end:]]), y).any():
            yield int(begin), int(end), int(begin) - a + b, int(end) - a + b
            return
    if 2 * min(len(np.unique(x)), len(np.unique(y))) >= min(len(x), len(y)):
        i, j = _chain(x, y, shift, least)
        todo = [(i, j)]
        while todo:
            i, j = todo.pop()
            found = _longest(i, j, (len(x), len(y)), least, percent) if len(i) else None
            if found is None:
                continue
            s, t, *ends = found
            if similar(x[ends[0] : ends[1]], y[ends[2] : ends[3]], percent):
                yield tuple(ends)
            todo += [(i[:s], j[:s]), (i[t + 1 :], j[t + 1 :])]
    for begin, end in edges.tolist():
        if end - begin >= least:
            # text that repeats itself goes on as long as it brings no other shingle
            run = x[a + begin : a + end]
            yield *_prolonged(x, a + begin, a + end, run), *_prolonged(y, b + begin, b + end, run)


def _prolonged(row: np.ndarray, begin: int, end: int, run: np.ndarray) -> tuple[int, int]:
    """The stretch from ``begin`` to ``end`` with what stands beside it and brings no shingle that ``run`` has not."""
    other = ~np.isin(row, run)
    before, after = np.flatnonzero(other[:begin]), np.flatnonzero(other[end:])
    return int(before[-1]) + 1 if len(before) else 0, end + int(after[0]) if len(after) else len(row)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, hashes: int = HASHES, matches: int = MATCHES) -> DataFrame:
    """One row for each stretch of a document that repeats in another: doc_id, first_word, last_word, n_words, source_id, kept.

    Words are runs of characters other than ASCII blanks, counted from 0; ``last_word`` is included. A passage repeats if
    another document has one with a Jaccard similarity of word five-grams of ``percent`` hundredths or more, over
    ``least_words`` words or more. Overlapping stretches of a document are one. ``source_id`` is the smallest document it was
    matched with, itself included; ``kept`` says that it is the document itself. Word-for-word repeats are all found. Of similar
    ones, those with fewer than ``matches`` colliding windows are missed, and those whose windows, alone and in twos, all stand behind
    a document that shares less than a passage. Null, empty and short texts, and null ids, give no row. Rows
    that repeat an id count as one document: no passage is reported between them. An empty table gives an empty result.
    """
    span = least_words - WORDS + 1
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    # of equal texts one is searched, and the others repeat it as a whole; an id with several texts is searched in any case
    known = staged(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest")), "digests")
    copies = with_winner(known).groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"), F.min("digest").alias("from"), F.max("digest").alias("to"))
    copies = staged(copies.where("`from` = `to` AND doc_id != keep_id").select("doc_id", "keep_id"), "copies")
    whole = staged(_whole_copies(docs, copies, span), "whole")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, group in in_groups(batch.column(1).to_pylist()):
                text, key, place = signatures(*_rows(group), span, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[first + text], pa.int64()), pa.array(place, pa.int64())], ["key", "doc_id", "place"])

    searched = without(docs, copies, "doc_id")
    shared = staged(_met(searched.mapInArrow(sign, "key long, doc_id long, place long")), "shared")
    spans = staged(_verified(staged(_candidates(shared, matches), "candidates"), docs, span, percent), "spans")
    # what is not covered yet, by signatures of two windows
    left = _uncovered(shared, _sound(spans.unionByName(whole)))
    twice = _met(_paired(left, hashes))
    more = staged(_verified(staged(_candidates(twice, max(2, matches - 1)), "candidates"), docs, span, percent), "spans")
    # what repeats word for word and has met only documents that share a part of it
    exact = _met(_named(_open_places(shared, _sound(spans.unionByName(more).unionByName(whole)), span), searched, span))
    last = staged(_verified(staged(_candidates(exact, 1), "candidates"), docs, span, percent), "spans")
    return _merged(_sound(spans.unionByName(more).unionByName(last).unionByName(whole)))


def _whole_copies(docs: DataFrame, copies: DataFrame, span: int) -> DataFrame:
    """Spans of whole texts between each copy and the document that is searched instead; short texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in in_groups(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(group)), pa.array(_rows(group)[0], pa.int64())], ["doc_id", "n"])

    sizes = sieved(docs, copies, "doc_id").mapInArrow(count, "doc_id long, n long").groupBy("doc_id").agg(F.max("n").alias("n")).where(F.col("n") >= span)
    zero = F.lit(0).cast("long")
    return copies.join(sizes, "doc_id").select(F.col("keep_id").alias("a"), zero.alias("begin_a"), F.col("n").alias("end_a"), F.col("doc_id").alias("b"), zero.alias("begin_b"), F.col("n").alias("end_b"))


def _met(entries: DataFrame) -> DataFrame:
    """Windows (key, doc_id, place) that collide with one of another document, with the first of their group: doc_id, place, a, at.

    A text has some 2 * HASHES windows for each passage's length, all with other keys, so even a passage that all documents share
    makes a small part of the rows equal in key.
    """
    group = Window.partitionBy("key")
    entries = entries.withColumn("first", F.min(F.struct("doc_id", "place")).over(group)).withColumn("to", F.max("doc_id").over(group))
    return entries.where("first.doc_id != to").select("doc_id", "place", F.col("first.doc_id").alias("a"), F.col("first.place").alias("at"))


def _candidates(met: DataFrame, matches: int) -> DataFrame:
    """Candidates (a, b, diagonal, low, high) of collisions; a task joins the intervals of the pairs dealt to it."""
    pairs = met.where((F.col("a") != F.col("doc_id")) | (F.col("at") != F.col("place"))).select("a", F.col("doc_id").alias("b"), "at", "place")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if len(held[0]) < 1 << 16:
                continue
            # all of a pair stand together; the last pair may go on
            cut = len(held[0]) - int(np.argmax(((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[::-1]))
            cut = cut if cut < len(held[0]) else 0
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in regions(*(h[:cut] for h in held), matches)], ["a", "b", "diagonal", "low", "high"])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in regions(*held, matches)], ["a", "b", "diagonal", "low", "high"])

    return pairs.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(join, "a long, b long, diagonal long, low long, high long")


def _paired(met: DataFrame, hashes: int) -> DataFrame:
    """Signatures (key, doc_id, place) of two windows of a document, of neighbouring functions, where a passage may begin in both.

    Windows of one group have the same first window, so that stands for their key.
    """
    entries = met.withColumn("key", F.xxhash64("a", "at"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def out(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((unpacked(place)[1], doc))
            key, doc, place = key[order], doc[order], place[order]
            (centre, first, last), function = unpacked(place), place >> 24 & 255
            # numbers that ascend over all documents; later ones that begin before one's last place overlap it
            number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 40
            times = np.searchsorted(number + first, number + last, "right") - np.arange(len(doc)) - 1
            i = np.repeat(np.arange(len(doc)), times)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            beside = (function[j] - function[i]) % hashes
            near = (beside == 1) | (beside == hashes - 1)
            i, j = i[near], j[near]
            both = mixed(np.minimum(key[i], key[j]).view(np.uint64)) + np.maximum(key[i], key[j]).view(np.uint64)
            # the centre of the smaller key, so that it is the same one in every document
            c = np.where(key[i] < key[j], centre[i], centre[j])
            start, stop = first[j], np.minimum(last[i], last[j])
            c = np.maximum(c, start)  # but of merged windows, whose centre may lie before
            return pa.RecordBatch.from_arrays([pa.array(mixed(both).view(np.int64)), pa.array(doc[i]), pa.array(packed(c, start, stop))], ["key", "doc_id", "place"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if len(held[0]) < 1 << 14:
                continue
            cut = len(held[1]) - int(np.argmax((held[1] != held[1][-1])[::-1]))
            if 0 < cut < len(held[1]):
                yield out(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield out(*held)

    return entries.select("key", "doc_id", "place").repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(pair, "key long, doc_id long, place long")


def _uncovered(met: DataFrame, spans: DataFrame) -> DataFrame:
    """The windows whose centre lies in no stretch found."""
    whole = staged(_stretches(spans), "stretches").select(F.col("doc_id").alias("in"), "begin", "end")
    centre = F.shiftright("place", 32)
    return met.join(whole, (F.col("doc_id") == F.col("in")) & (centre >= F.col("begin")) & (centre < F.col("end")), "left_anti")


def _open_places(met: DataFrame, spans: DataFrame, span: int) -> DataFrame:
    """Where stretches of ``span`` shingles begin that no stretch found holds: doc_id, places (first, last). Each lies in one window of the first function."""
    whole = staged(_stretches(spans), "stretches").select(F.col("doc_id").alias("in"), "begin", "end")
    first = F.shiftright("place", 32) - F.shiftright("place", 12).bitwiseAND(F.lit(4095))
    windows = met.where(F.shiftright("place", 24).bitwiseAND(F.lit(255)) == 0).select("doc_id", first.alias("first"), (first + F.col("place").bitwiseAND(F.lit(4095))).alias("last"))
    left = windows.join(whole, (F.col("doc_id") == F.col("in")) & (F.col("first") >= F.col("begin")) & (F.col("last") + span <= F.col("end")), "left_anti")
    return staged(left.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("places")), "places")


def _named(places: DataFrame, docs: DataFrame, span: int) -> DataFrame:
    """Entries (key, doc_id, place) of stretches of ``span`` shingles, named by all of them, that begin at the given places."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for begin, group in in_groups(batch.column(1).to_pylist()):
                lengths, rows = _rows(group)
                starts = np.cumsum(lengths) - lengths
                up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(rows), x, np.uint64)])) for x in (_STEP, _BACK))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(rows * up[:-1])])
                for t, (start, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                    ends = wanted[begin + t].values
                    at = np.unique(np.concatenate([np.arange(f, min(z, n - span) + 1) for f, z in zip(ends.field(0).to_pylist(), ends.field(1).to_pylist(), strict=True)] or [np.zeros(0, np.int64)]))
                    if len(at):
                        key = mixed((sums[start + at + span] - sums[start + at]) * down[start + at])
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(at), ids[begin + t]), pa.int64()), pa.array(packed(at, at, at), pa.int64())], ["key", "doc_id", "place"])

    rows = roughly(docs, places, "doc_id").join(places, "doc_id").select("doc_id", "text", "places")
    return rows.mapInArrow(name, "key long, doc_id long, place long")


def _sound(spans: DataFrame) -> DataFrame:
    """Spans without those inside one document of a passage that no other document has."""
    other = spans.where("a != b")
    whole = _stretches(other).select(F.col("doc_id").alias("a"), F.col("begin").alias("from"), F.col("end").alias("to"))
    inside = spans.where("a = b").join(whole, "a").where((F.col("begin_a") < F.col("to")) & (F.col("from") < F.col("end_a")))
    return other.unionByName(inside.select(*spans.columns).distinct())


def _rows(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of several texts in a row, and how many each has; texts of fewer than five words have none."""
    words, counts = word_hashes(group)
    ends = np.cumsum(counts)
    rows = [shingle_rows(words[end - n : end]) if n >= WORDS else words[:0] for n, end in zip(counts.tolist(), ends.tolist(), strict=True)]
    return np.array([len(r) for r in rows]), np.concatenate(rows) if rows else words


def _verified(pairs: DataFrame, docs: DataFrame, span: int, percent: int) -> DataFrame:
    """Verified stretches: a, begin_a, end_a, b, begin_b, end_b in shingles (ends excluded), of the stored candidates."""
    margin = span  # what is similar further away has windows of its own
    zero = F.lit(0).cast("long")
    from_b = F.greatest(zero, F.col("low") + F.col("diagonal") - margin)
    ends = pairs.withColumn("from_a", F.greatest(zero, F.col("low") - margin)).withColumn("to_a", F.col("high") + span + margin)
    ends = ends.withColumn("from_b", from_b).withColumn("to_b", F.greatest(from_b, F.col("high") + F.col("diagonal") + span + margin)).drop("low", "high")
    wanted = staged(ends.select(F.col("a").alias("doc_id")).union(ends.select("b")).distinct(), "wanted")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in in_groups(batch.column(1).to_pylist()):
                lengths, rows = _rows(group)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                values = (rows >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(group)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "rows"])

    # the joins drop what passes the bitmap by chance, so texts are not shuffled beside their shingles
    rows = roughly(docs, wanted, "doc_id").mapInArrow(rows_of, "doc_id long, rows array<int>")
    cut = lambda at, to: F.slice("rows", (F.col(at) + 1).cast("int"), (F.col(to) - F.col(at)).cast("int"))
    joined = ends.join(rows.withColumnRenamed("doc_id", "b"), "b").withColumn("part_b", cut("from_b", "to_b")).drop("rows", "to_b")
    joined = joined.join(rows.withColumnRenamed("doc_id", "a"), "a").withColumn("part_a", cut("from_a", "to_a")).drop("rows", "to_a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, diagonal, from_a, from_b = (batch.column(i).to_pylist() for i in range(5))
            part_a, part_b = batch.column(5), batch.column(6)
            out = []
            for i in range(batch.num_rows):
                x, y = part_a[i].values.to_numpy(), part_b[i].values.to_numpy()
                at, to = from_a[i], from_b[i]
                for begin, end, first, last in passages(x, y, diagonal[i] - to + at, span, percent):
                    out.append((a[i], at + begin, at + end, b[i], to + first, to + last))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays(columns, ["a", "begin_a", "end_a", "b", "begin_b", "end_b"])

    return joined.select("a", "b", "diagonal", "from_a", "from_b", "part_a", "part_b").mapInArrow(verify, "a long, begin_a long, end_a long, b long, begin_b long, end_b long")


def _merged(spans: DataFrame) -> DataFrame:
    """The result's rows."""
    first, last = F.col("begin"), F.col("end") + WORDS - 2
    return _stretches(spans).select("doc_id", first.alias("first_word"), last.alias("last_word"), (last - first + 1).alias("n_words"), "source_id", (F.col("source_id") == F.col("doc_id")).alias("kept"))


def _stretches(spans: DataFrame, shares: int = 16) -> DataFrame:
    """Overlapping stretches of each document as one. A document matched by very many is merged in shares first."""
    share = F.pmod(F.xxhash64("b"), F.lit(shares))
    own = spans.select(F.col("a").alias("doc_id"), F.col("begin_a").alias("begin"), F.col("end_a").alias("end"), F.col("a").alias("source_id"), share.alias("share"))
    other = spans.select(F.col("b").alias("doc_id"), F.col("begin_b").alias("begin"), F.col("end_b").alias("end"), F.col("a").alias("source_id"), F.lit(0).cast("long").alias("share"))
    return _islands(_islands(own.unionByName(other), ["doc_id", "share"]), ["doc_id"])


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("begin", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # stretches that overlap or adjoin in words
    rows = rows.withColumn("new", F.coalesce(F.col("begin") > F.max("end").over(before) + WORDS - 2, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("source_id").alias("source_id")).drop("island")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
