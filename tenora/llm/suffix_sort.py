"""Removal of long repeated byte strings, by sorting suffixes in a distributed merge sort that is aware of common prefixes.

A *window* is a string of ``length`` bytes (400) of one text; a byte goes if one of its windows occurs elsewhere too. Each window
belongs to the place with the least hash of 16 bytes among its first ``SPAN`` places, its *anchor*. That choice depends on the
window alone, so equal windows have anchors at equal distances, and what follows an anchor says which windows can be equal:

1.  Anchors whose next ``length - SPAN + 1`` bytes occur once are left aside: none of their windows is repeated.
2.  The neighbouring windows of one anchor make one stretch of text. Stretches that occur twice are repeated as a whole.
3.  The other stretches of repeated anchors, one of each text, differ near their ends. Their suffixes from the anchor on, followed by what
    stands before it, backwards, are sorted: each task sorts runs of them and cuts the runs at common splitters, the pieces are
    exchanged front-coded (length of the prefix shared with the one before, and the rest), and each range merges its pieces by a
    loser tree that compares lengths of known common prefixes first and bytes only beyond them. The common prefixes of neighbours,
    which come out with the order, give for each distance of window and anchor which windows are equal: suffixes that agree in
    enough bytes to the right stand together, and among them those are counted that agree to the left.
4.  Suffixes that share this much with a splitter may have equals in the next range; their windows are settled by an
    aggregate on 128 bits of hash, counted in each range first.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.llm.sieve import bits_of, has_bit, roughly, without_wide
from tenora.plans.staging import fresh, staged

LENGTH = 400
SPAN = 96  # places among which a window's anchor is chosen
GRAM = 16
CHUNK = 1 << 19  # bytes hashed at once; longer texts are cut, with an overlap
RUN = 1 << 15  # suffixes in a sorted run
RANGE = 1 << 15  # suffixes in a range of the merge, about
SAMPLE = 1 << 17  # keys sampled for splitters at most: 64 MB
_R1, _R2, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F | 1, np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(r: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, r
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(step)
        done, step = done + m, step * step % (1 << 64)
    return out


class _Hasher:
    """Polynomial hashes of all substrings of up to some hundred bytes of a chunk. Powers are kept between chunks."""

    def __init__(self, size: int):
        self.up = [_powers(r, size) for r in (_R1, _R2)]
        self.down = [_powers(pow(r, -1, 1 << 64), size) for r in (_R1, _R2)]
        self.table = np.frombuffer(hashlib.shake_256(b"bytes").digest(2048), np.uint64)

    def take(self, data: np.ndarray) -> None:
        values = self.table[data]
        self.sums = []
        for up in self.up:
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values * up[: len(data)], out=s[1:])
            self.sums.append(s)

    def of(self, at: np.ndarray, size: np.ndarray | int, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return (s[at + size] - s[at]) * self.down[which][at]


class Stretches:
    """Anchors of many texts and the windows that belong to them."""

    def __init__(self, length: int):
        self.length = length
        self.hasher = _Hasher(CHUNK + 8 * length + 65536)

    def of(self, rows: list[int], texts: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
        """Columns row, lo, hi (first and last window), anchor, head and x1, x2 (hashes), and data with base for the bytes."""
        group, held = [], 0
        for row, text in zip(rows, texts, strict=True):
            # windows that begin in [at, at + CHUNK) are this piece's
            for at in range(0, max(len(text) - self.length + 1, 0), CHUNK):
                piece = text[at : at + CHUNK + self.length - 1]
                if held + len(piece) > CHUNK + 2 * self.length and group:
                    yield self._group(group)
                    group, held = [], 0
                group.append((row, at, piece))
                held += len(piece)
        if group:
            yield self._group(group)

    def _group(self, group: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        h = self.hasher
        h.take(data)
        sizes = np.array([len(p) for _, _, p in group])
        begins = np.cumsum(sizes) - sizes
        n = len(data) - GRAM + 1
        grams = h.of(np.arange(n), GRAM)
        grams ^= grams >> np.uint64(32)
        grams *= _MIX
        least = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
        width = 1
        while width < SPAN:
            step = min(width, SPAN - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        # the last windows of a chunk have all their places: a window is longer than SPAN + GRAM
        windows = sizes - self.length + 1
        w = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        anchor = (least[w] & _PLACE).astype(np.int64)
        of = np.repeat(np.arange(len(group)), windows)
        cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])])
        lo, hi = w[cut], w[np.r_[cut[1:] - 1, len(w) - 1]]
        anchor, of = anchor[cut], of[cut]
        size = hi + self.length - lo
        shift = np.array([at for _, at, _ in group])[of] - begins[of]
        out = {"row": np.array([r for r, _, _ in group], np.int64)[of], "lo": lo + shift, "hi": hi + shift, "anchor": anchor + shift, "head": h.of(anchor, self.length - SPAN + 1).view(np.int64)}
        # the distance of anchor and first window belongs to the stretch
        turn = ((size.astype(np.uint64) << np.uint64(32)) | (anchor - lo).astype(np.uint64)) * _MIX
        out |= {"x1": (h.of(lo, size) + turn).view(np.int64), "x2": (h.of(lo, size, 1) ^ turn).view(np.int64), "data": data, "shift": shift}
        return out


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[dict[str, np.ndarray]]:
    maker = Stretches(length)
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            yield from maker.of(part.column(0).to_pylist(), [(t or "").encode() for t in part.column(1).to_pylist()])


def _heads(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches, length):
            heads, n = np.unique(s["head"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(n)], ["head", "n"])

    return docs.select("row", "text").mapInArrow(run, "head long, n long").groupBy("head").agg(F.sum("n").alias("n")).where("n > 1").select("head")


def _mark(x1: np.ndarray, row: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A number for a stretch at its place, which says where one of several equal stretches stands."""
    mixed = (x1.view(np.uint64) ^ (row.astype(np.uint64) * np.uint64(_R1)) ^ (lo.astype(np.uint64) * np.uint64(_R2))) * _MIX
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _repeated(docs: DataFrame, heads: DataFrame, length: int) -> DataFrame:
    """Stretches whose head occurs twice, and some others: head, x1, x2, mark, row, place (first window and number of more ones, packed).

    What a bitmap lets pass by chance has no equal, and needn't be joined away: it makes a kind of its own, of which there is one.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(heads, F.col("head")))
    names = ["head", "x1", "x2", "mark", "row", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches, length):
            at = np.flatnonzero(has_bit(bits.value, s["head"]))
            if len(at):
                one = {c: s[c][at] for c in ("head", "x1", "x2", "row", "lo", "hi")}
                one |= {"mark": _mark(one["x1"], one["row"], one["lo"]), "place": one["lo"] << 16 | (one["hi"] - one["lo"])}
                yield pa.RecordBatch.from_arrays([pa.array(one[c]) for c in names], names)

    return docs.select("row", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _suffixes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted stretches (mark) with their sort keys: row, lo, near, far (distances of windows and anchor), key.

    A bitmap chooses them; others that it lets pass are stretches of the texts too, so they may be sorted with the rest.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(wanted, F.col("mark")))
    names = ["row", "lo", "near", "far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches, length):
            at = np.flatnonzero(has_bit(bits.value, _mark(s["x1"], s["row"], s["lo"])))
            data = s["data"].tobytes() if len(at) else b""
            for begin in range(0, len(at), 1 << 13):
                i = at[begin : begin + (1 << 13)]
                anchor, near, far, shift = s["anchor"][i], s["anchor"][i] - s["hi"][i], s["anchor"][i] - s["lo"][i], s["shift"][i]
                keys = [data[a : h + length] + data[f:a][::-1] for a, h, f in zip((anchor - shift).tolist(), (s["hi"][i] - shift).tolist(), (s["lo"][i] - shift).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in (s["row"][i], s["lo"][i], near, far)], pa.array(keys, pa.binary())], [*names, "key"])

    return docs.select("row", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", key binary")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes needn't be compared."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    low, high = known, end
    while high - low > 1:  # they differ somewhere in [low, high)
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Sorted keys as lengths shared with the one before, all rests in one string, and the rests' lengths."""
    shared = np.fromiter((0 if i == 0 else common(keys[i - 1], k) for i, k in enumerate(keys)), np.uint16, len(keys))
    rests = [k[s:] for k, s in zip(keys, shared.tolist(), strict=True)]
    return shared, b"".join(rests), np.fromiter(map(len, rests), np.uint16, len(rests))


class Run:
    """A front-coded sorted run, read one key at a time."""

    def __init__(self, shared: np.ndarray, rests: bytes, sizes: np.ndarray):
        self.shared, self.rests, self.ends = shared.tolist(), rests, list(accumulate(sizes.tolist()))
        self.sizes, self.i, self.key = sizes.tolist(), -1, b""

    def advance(self) -> int | None:
        """Go to the next key; returns how much it shares with the one before, None at the end."""
        self.i += 1
        if self.i >= len(self.shared):
            self.key = None
            return None
        shared, end = self.shared[self.i], self.ends[self.i]
        self.key = self.key[:shared] + self.rests[end - self.sizes[self.i] : end]
        return shared


class LoserTree:
    """Merges sorted runs. Each loser keeps how much it shares with the winner it lost to, so known prefixes are never compared again.

    All that stand on the way of the last winner share a known length with it: of two with different lengths the longer one is
    the lesser; only of two with equal lengths are bytes compared, from there on.
    """

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.loser: list[tuple[int, int]] = [(-1, 0)] * self.size
        self.winner = self._built(1)

    def _built(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            r = node - self.size
            if r < len(self.runs) and self.runs[r].advance() is not None:
                return r, 0
            return -1, 0
        return self._played(node, self._built(2 * node), self._built(2 * node + 1))

    def _played(self, node: int, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        """The lesser of two (run, length shared with the last key given out) goes on; the other stays with its length."""
        (ra, la), (rb, lb) = a, b
        if ra < 0 or rb < 0:
            self.loser[node] = b if rb < 0 else a
            return a if rb < 0 else b
        if la == lb:
            ka, kb = self.runs[ra].key, self.runs[rb].key
            both = common(ka, kb, la)
            if ka[both:] <= kb[both:]:
                self.loser[node] = (rb, both)
                return a
            self.loser[node] = (ra, both)
            return b
        # what shares less with the key before is the greater one, and shares as much with the other
        if la > lb:
            self.loser[node] = b
            return a
        self.loser[node] = a
        return b

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """Run, place in it and length shared with the key before, in order; the key is the run's until the next step."""
        while self.winner[0] >= 0:
            run, shared = self.winner
            yield run, self.runs[run].i, shared
            ahead = self.runs[run].advance()
            here = (-1, 0) if ahead is None else (run, ahead)
            node = (run + self.size) // 2
            while node:
                here = self._played(node, here, self.loser[node])
                node //= 2
            self.winner = here


def equal_windows(lefts: list[bytes], shared: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Distances and the suffixes (by place in the sorted order) whose windows at that distance occur among them more than once.

    ``lefts`` hold what stands before the anchors, backwards; ``shared`` is at most ``length``. A window at distance d is d bytes to the left
    and ``length - d`` to the right: the right ones are equal within runs of suffixes that share as much, and the left
    ones get numbers that are refined byte by byte.
    """
    n = len(lefts)
    wide = max((len(x) for x in lefts), default=0)
    before = np.zeros((n, wide), np.uint8)
    for i, x in enumerate(lefts):
        before[i, : len(x)] = np.frombuffer(x, np.uint8)
    left = np.zeros(n, np.int64)
    alive = np.arange(n)  # only suffixes that may have an equal at greater distances
    for d in range(wide + 1):
        if d:
            alive = alive[far[alive] >= d]
            _, left[alive] = np.unique(left[alive] * 256 + before[alive, d - 1], return_inverse=True)
        together = np.cumsum(shared < length - d)
        here = alive[near[alive] <= d]
        if len(here):
            _, at, n_same = np.unique(together[here] * (n + 1) + left[here], return_inverse=True, return_counts=True)
            yield d, here[n_same[at] > 1]


def _sorted_runs(suffixes: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Front-coded pieces of sorted runs: range, ids, nears, fars, shared, rests, sizes."""
    sent = suffixes.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, int]] = []

        def out() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[0])
            keys = [x[0] for x in held]
            begin, rows = 0, []
            for k, end in enumerate([*[bisect_left(keys, s) for s in sent.value], len(keys)]):
                if end > begin:
                    shared, rests, sizes = front_coded(keys[begin:end])
                    ids, nears, fars = (np.array([x[i] for x in held[begin:end]], t).tobytes() for i, t in ((1, np.int64), (2, np.uint16), (3, np.uint16)))
                    rows.append((k, ids, nears, fars, shared.tobytes(), rests, sizes.tobytes()))
                begin = end
            held.clear()
            for at in range(0, len(rows), 64):
                columns = list(zip(*rows[at : at + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["range", "ids", "nears", "fars", "shared", "rests", "sizes"])

        for batch in batches:
            held.extend(zip(*(batch.column(c).to_pylist() for c in ("key", "id", "near", "far")), strict=True))
            if len(held) >= RUN:
                yield from out()
        if held:
            yield from out()

    return suffixes.select("id", "near", "far", "key").mapInArrow(run, "range long, ids binary, nears binary, fars binary, shared binary, rests binary, sizes binary")


def _merged(pieces: DataFrame, splitters: list[bytes], length: int) -> DataFrame:
    """Repeated windows of suffixes (id, distance), and those to be settled between ranges (w1, w2 not null, n and one id of them)."""
    sent = pieces.sparkSession.sparkContext.broadcast(splitters)
    core = length - SPAN + 1

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        runs = [Run(np.frombuffer(s, np.uint16), r, np.frombuffer(z, np.uint16)) for s, r, z in zip(rows["shared"], rows["rests"], rows["sizes"], strict=True)]
        ids, nears, fars = ([np.frombuffer(x, t) for x in rows[c]] for c, t in (("ids", np.int64), ("nears", np.uint16), ("fars", np.uint16)))
        at, keys, shared = [], [], []
        for run, i, both in LoserTree(runs):
            at.append((run, i))
            keys.append(runs[run].key)
            shared.append(both)
        ids, nears, fars = (np.array([x[r][i] for r, i in at]).astype(np.int64) for x in (ids, nears, fars))
        rights = [len(k) - f for k, f in zip(keys, fars.tolist(), strict=True)]
        lefts = [k[r:] for k, r in zip(keys, rights, strict=True)]
        out = list(equal_windows(lefts, np.array(shared), nears, fars, length))
        who = np.concatenate([ids[w] for _, w in out]) if out else ids[:0]
        first, last, who = _joined(who, np.repeat([d for d, _ in out], [len(w) for _, w in out]).astype(np.int64))
        found = pd.DataFrame({"id": who, "first": first, "last": last, "w1": None, "w2": None, "n": None})
        # suffixes with possible equals in the ranges beside this one
        k = int(key[0])
        heads = {s[:core] for s in sent.value[max(k - 1, 0) : k + 1]}
        edges = []
        for i in [i for i, x in enumerate(keys) if x[:core] in heads]:
            far, text = int(fars[i]), lefts[i][::-1] + keys[i][: rights[i]]
            edges += [(int(ids[i]), d, hashlib.blake2b(text[far - d : far - d + length], digest_size=16).digest()) for d in range(int(nears[i]), far + 1)]
        if edges:
            e = pd.DataFrame(edges, columns=["id", "first", "w"])
            e["n"] = e.groupby("w")["id"].transform("size")
            e = e.drop_duplicates("w")  # what occurs more than once here is found already
            halves = np.frombuffer(b"".join(e["w"]), np.int64).reshape(-1, 2)
            found = pd.concat([found, pd.DataFrame({"id": e["id"], "first": e["first"], "last": e["first"], "w1": halves[:, 0], "w2": halves[:, 1], "n": e["n"]})])
        return found.astype({"w1": "Int64", "w2": "Int64", "n": "Int64"})

    return pieces.groupBy("range").applyInPandas(merge, "id long, first long, last long, w1 long, w2 long, n long")


def _joined(who: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive distances of one id, and the id."""
    order = np.lexsort((distance, who))
    who, distance = who[order], distance[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (distance[1:] != distance[:-1] + 1)
    begin = np.flatnonzero(new)
    return distance[begin], distance[np.r_[begin[1:], len(who)][: len(begin)] - 1], who[begin]


def _splitters(suffixes: DataFrame, n: int) -> list[bytes]:
    """Keys that cut the sorted suffixes into ranges of about ``RANGE``, from a sample of at most about ``SAMPLE``."""
    ranges = min(-(-n // RANGE), SAMPLE // 16)
    if ranges < 2:
        return []
    keys = sorted(bytes(r["key"]) for r in suffixes.select("key").sample(min(1.0, 64 * ranges / n), seed=1).collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)} if keys else set())


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans (row, begin, end) of bytes of ``texts`` (row, text; stored, rows distinct) that windows of ``length`` cover which occur elsewhere too.

    Spans of one row may overlap. ``length`` must be 3 * SPAN at least.
    """
    if not 3 * SPAN <= length <= 1 << 14:
        raise ValueError(f"length must be between {3 * SPAN} and {1 << 14}")
    heads = staged(_heads(texts, length), "heads")
    found = staged(_repeated(texts, heads, length), "repeated", "zstd")
    kinds = staged(found.groupBy("head", "x1", "x2").agg(F.count("*").alias("n"), F.min("mark").alias("mark")), "kinds", "zstd")
    whole = found.select("x1", "x2", "row", "place").join(kinds.where("n > 1").select("x1", "x2"), ["x1", "x2"], "left_semi")
    lo = F.shiftright("place", 16)
    whole = whole.select("row", lo.alias("begin"), (lo + F.col("place").bitwiseAND(F.lit(65535)) + length).alias("end"))
    several = kinds.groupBy("head").agg(F.count("*").alias("m")).where("m > 1").select("head")
    wanted = staged(kinds.join(several, "head", "left_semi").select("mark"), "wanted")
    if wanted.isEmpty():
        return whole
    suffixes = staged(_suffixes(texts, wanted, length).withColumn("id", F.monotonically_increasing_id()), "suffixes", "zstd")
    splitters = _splitters(suffixes, suffixes.count())
    merged = staged(_merged(staged(_sorted_runs(suffixes, splitters), "runs", "zstd"), splitters, length), "merged")
    between = merged.where("w1 IS NOT NULL")
    twice = between.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2")
    equal = merged.where("w1 IS NULL").select("id", "first", "last").unionByName(between.join(twice, ["w1", "w2"], "left_semi").select("id", "first", "last"))
    place = suffixes.select("id", "row", (F.col("lo") + F.col("far")).alias("anchor"))
    parts = equal.join(place, "id").select("row", (F.col("anchor") - F.col("last")).alias("begin"), (F.col("anchor") - F.col("first") + length).alias("end"))
    return whole.unionByName(parts)


_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def _merged_spans(found: DataFrame) -> DataFrame:
    """The maximal runs of each row's spans: row, spans in order."""
    order = Window.partitionBy("row").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("begin") <= before, 0).otherwise(1)
    runs = found.withColumn("run", new).withColumn("run", F.sum("run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``docs`` with a column ``cut``: kept (the bytes that stay), n_removed, and spans (the maximal removed runs: begin, end).

    All occurrences of a repeated string go, the first one too. Null texts are empty; texts shorter than ``length`` lose nothing;
    repeated rows are texts of their own, so they remove each other. Other columns stay as they are; where one is called ``cut``, the new
    one gets an underscore. An empty table gives no rows.
    """
    row, cut, spans = fresh(docs, "row"), fresh(docs, "cut"), fresh(docs, "spans")
    stored = staged(docs.withColumn(row, F.monotonically_increasing_id()), "texts", "zstd")
    found = repeated_spans(stored.select(F.col(row).alias("row"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text") >= length), length)
    size = F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long")
    whole = (F.size("spans") == 1) & (F.col("spans")[0]["begin"] == 0) & (F.col("spans")[0]["end"] == F.col("size"))
    per = _merged_spans(found).join(stored.select(F.col(row).alias("row"), size.alias("size")), "row")
    per = staged(per.select(F.col("row").alias(row), F.col("spans").alias(spans), whole.alias("whole")), "spans")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    runs = F.col(spans)
    # what lies before each run and after the last one, put together as hexadecimal text, as only text can be joined
    gaps = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), runs["end"]), F.concat(runs["begin"], F.array(F.octet_length(data).cast("long"))), lambda b, e: F.hex(F.substring(data, (b + 1).cast("int"), (e - b).cast("int"))))
    removed = F.aggregate(runs, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    # texts and spans always meet by a merge, so that small and large tables take one way; of those that go as a whole no text is needed
    kept = F.unhex(F.array_join(gaps, ""))
    hit = None
    for gone in (True, False):
        of = per.where("whole" if gone else "NOT whole").select(row, spans)
        part = roughly(stored, of, row).join(of.hint("merge"), row).select(*columns, F.struct((F.lit(b"") if gone else kept).alias("kept"), removed.alias("n_removed"), runs.cast(_SPANS).alias("spans")).alias(cut))
        hit = part if hit is None else hit.unionByName(part)
    none = F.struct(data.alias("kept"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(_SPANS).alias("spans"))
    return without_wide(stored, per, row).select(*columns, none.alias(cut)).unionByName(hit)


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document after strings of 400 bytes that occur twice have gone."""
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", n_bytes.alias("n_bytes"))
    out = without_repeats(docs)
    return out.select("doc_id", "n_bytes", F.col("cut.n_removed").alias("n_removed"), F.size("cut.spans").cast("long").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256"))
