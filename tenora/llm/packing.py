"""Operator 8: best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt into blocks of some thousands by hash. For each block, several islands evolve packings apart from each
other: crossover injects whole well-filled bins of one parent into another, bins that hold any of the injected
pieces are dissolved, displaced pieces are traded for shorter ones where that fills a bin, and the rest is put back by best fit.
After each round an island's elite migrates to the next island and all evolve again. The best packing of each block is taken. No task
holds more than a block.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.llm.words import sliced, word_encoder
from tenora.plans.session import small_batches
from tenora.plans.staging import fresh, staged

CAPACITY = 2048
BLOCK = 8192
ISLANDS = 3
POPULATION = 4
GENERATIONS = 6  # of every island in a round
ROUNDS = 3  # elites migrate between them


def best_fit(lengths: np.ndarray, order: np.ndarray, bin_of: np.ndarray, space: list[int], capacity: int) -> None:
    """Put the pieces ``order``, one by one, where the least space is left that suffices; new bins when none does.

    ``bin_of`` and ``space`` are extended in place. Spaces with an open bin are the set bits of one number.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for b, s in enumerate(space):
        if s:
            stacks[s].append(b)
            open_ |= 1 << s
    size = lengths.tolist()
    for i in order.tolist():
        n = size[i]
        fits = open_ >> n
        if fits:
            s = n + (fits & -fits).bit_length() - 1
            b = stacks[s].pop()
            if not stacks[s]:
                open_ ^= 1 << s
        else:
            b, s = len(space), capacity
            space.append(capacity)
        s -= n
        space[b] = s
        bin_of[i] = b
        if s:
            stacks[s].append(b)
            open_ |= 1 << s


class Packing:
    """An assignment of pieces to bins 0 to n - 1, and the bins' fill."""

    def __init__(self, bin_of: np.ndarray, lengths: np.ndarray, capacity: int):
        self.bin_of = np.unique(bin_of, return_inverse=True)[1].astype(np.int32)
        self.fill = np.bincount(self.bin_of, lengths).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        self.bins = len(self.fill)
        # few bins first, then bins as unevenly filled as can be, which leaves room to save one
        self.fitness = float(np.square(self.fill / capacity).mean()) if self.bins else 1.0

    def key(self) -> tuple[int, float]:
        return self.bins, -self.fitness


def packed(lengths: np.ndarray, order: np.ndarray, capacity: int) -> Packing:
    bin_of, space = np.full(len(lengths), -1, np.int64), []
    best_fit(lengths, order, bin_of, space, capacity)
    return Packing(bin_of, lengths, capacity)


def swapped(lengths: np.ndarray, displaced: np.ndarray, bin_of: np.ndarray, space: list[int]) -> np.ndarray:
    """Trade single pieces of bins for longer displaced ones that still fit; returns what is displaced then.

    Bins become fuller and what is left over becomes shorter, so that it finds room more easily.
    """
    out = sorted(displaced.tolist(), key=lengths.__getitem__)
    sizes = [int(lengths[i]) for i in out]
    placed = np.flatnonzero(bin_of >= 0)
    gaps = np.array(space)[bin_of[placed]]
    for i in placed[(gaps > 0) & (lengths[placed] < sizes[-1])].tolist() if sizes else ():
        b, own = bin_of[i], int(lengths[i])
        at = bisect_right(sizes, own + space[b]) - 1
        if at >= 0 and sizes[at] > own:
            space[b] -= sizes[at] - own
            bin_of[out[at]], bin_of[i] = b, -1
            del sizes[at], out[at]
            at = bisect_right(sizes, own)
            sizes.insert(at, own)
            out.insert(at, i)
    return np.array(out, np.int64)


def crossed(a: Packing, b: Packing, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with some of the fullest bins of ``b`` injected, its clashing bins dissolved, and the displaced put back by best fit."""
    full = np.argsort(-b.fill, kind="stable")[: max(1, b.bins // 2)]
    injected = np.zeros(b.bins, bool)
    injected[rng.choice(full, max(1, len(full) // int(rng.integers(2, 9))), replace=False)] = True
    taken = injected[b.bin_of]
    clash = np.zeros(a.bins, bool)
    clash[a.bin_of[taken]] = True
    # the emptiest bins are dissolved too, and a few others
    clash[np.argsort(a.fill, kind="stable")[: max(1, a.bins // 50)]] = True
    clash[rng.integers(a.bins, size=max(1, a.bins // 50))] = True
    displaced = np.flatnonzero(clash[a.bin_of] & ~taken)
    bin_of = np.where(taken, b.bin_of + a.bins, a.bin_of).astype(np.int64)
    bin_of[displaced] = -1
    stay = bin_of >= 0
    names, again = np.unique(bin_of[stay], return_inverse=True)
    bin_of[stay] = again
    space = (capacity - np.bincount(again, lengths[stay], len(names)).astype(np.int64)).tolist()
    displaced = swapped(lengths, displaced, bin_of, space)
    best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], bin_of, space, capacity)
    return Packing(bin_of, lengths, capacity)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the total, or the pieces of over half a bin."""
    return max(-(-int(lengths.sum()) // capacity), int((lengths * 2 > capacity).sum()))


def evolve(lengths: np.ndarray, elites: list[np.ndarray], seed: int, capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """The best packing of one island, starting from ``elites`` and from best fit in decreasing and near-decreasing orders.

    Ends early only where the lower bound is met, which no packing can beat.
    """
    rng = np.random.default_rng(seed)
    least = lower_bound(lengths, capacity)
    own = [Packing(e, lengths, capacity) for e in elites] or [packed(lengths, np.argsort(-lengths, kind="stable"), capacity)]
    while len(own) < population and min(p.bins for p in own) > least:
        own.append(packed(lengths, np.argsort(-lengths * rng.uniform(0.8, 1.2, len(lengths)), kind="stable"), capacity))
    for _ in range(generations):
        own.sort(key=Packing.key)
        if own[0].bins <= least:
            break
        # equal packings count once, so that the population does not become one
        own = list({p.key(): p for p in reversed(own)}.values())[::-1][:population]
        pairs = [(i % len(own), int(rng.integers(len(own)))) for i in range(population)]
        own += [crossed(own[i], own[j] if i != j else packed(lengths, np.argsort(-lengths * rng.uniform(0.8, 1.2, len(lengths)), kind="stable"), capacity), lengths, capacity, rng) for i, j in pairs]
    return min(own, key=Packing.key)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut only where they exceed ``capacity``.

    Null and empty texts give one piece, ``end_id`` alone; null ids and repeated rows give pieces like any other; a long text is
    encoded in parts. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for batch in batches:
            for part in sliced(batch, 1):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    view = memoryview(ids + tail)
                    for k, start in enumerate(range(0, len(view) // 4, capacity)):
                        piece = view[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, k, start, len(piece) // 4, zlib.crc32(piece)))
                columns = [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def evolved(rest: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """The best packing found for each block of ``rest`` (block, row, length): block, bins, best_fit_bins, least_bins, bin_of.

    ``bin_of`` holds the bin of each row, in the order of ``row``, as 32-bit numbers. Every island of a block is a task; after each
    round an island gets the elite of the one before it, and blocks that meet their lower bound on any island take no
    further part. ``best_fit_bins`` is what best fit in decreasing order takes, ``least_bins`` the lower bound.
    """
    each = staged(rest.withColumn("island", F.explode(F.array(*[F.lit(i).cast("long") for i in range(islands)]))), "islands")
    kind = "block long, island long, bins long, spread double, best_fit_bins long, least_bins long, bin_of binary"

    def elite(key: tuple, table: pa.Table, given: list[np.ndarray], turn: int) -> pa.Table:
        b, i = (int(k.as_py()) for k in key)
        lengths = table.sort_by("row")["length"].to_numpy()
        best = evolve(lengths, given, seed=b * 1009 + i * 31 + turn, capacity=capacity)
        first = packed(lengths, np.argsort(-lengths, kind="stable"), capacity).bins if turn == 0 else 0
        return pa.table(
            {
                "block": pa.array([b], pa.int64()), "island": pa.array([i], pa.int64()), "bins": pa.array([best.bins], pa.int64()), "spread": pa.array([-best.fitness]),
                "best_fit_bins": pa.array([first], pa.int64()), "least_bins": pa.array([lower_bound(lengths, capacity)], pa.int64()), "bin_of": pa.array([best.bin_of.tobytes()], pa.binary()),
            }
        )

    elites = staged(each.groupBy("block", "island").applyInArrow(lambda key, table: elite(key, table, [], 0), kind), "elites")
    done = [elites]
    for turn in range(1, rounds):
        still = elites.groupBy("block").agg(F.min("bins").alias("found"), F.min("least_bins").alias("least")).where("found > least").select("block")
        elites = elites.join(still, "block", "left_semi")
        moved = elites.unionByName(elites.withColumn("island", (F.col("island") + 1) % islands)) if islands > 1 else elites

        def again(key: tuple, table: pa.Table, met: pa.Table) -> pa.Table:
            best = met.sort_by([("bins", "ascending"), ("spread", "ascending")])
            return elite(key, table, [np.frombuffer(x, np.int32) for x in best["bin_of"].to_pylist()], turn)  # noqa: B023


        left = each.join(still, "block", "left_semi")
        elites = staged(left.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInArrow(again, kind), "elites")
        done.append(elites)
        if elites.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    best = F.min_by(F.struct("bins", "bin_of"), F.struct("bins", "spread", "island")).alias("best")
    return found.groupBy("block").agg(best, F.max("best_fit_bins").alias("best_fit_bins"), F.max("least_bins").alias("least_bins")).select("block", "best.bins", "best_fit_bins", "least_bins", "best.bin_of")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Place pieces (length, and any other columns) into sequences: adds sequence_id and offset, in place of any such columns.

    Lengths are 1 to ``capacity``. Pieces that fill a sequence get one of their own at once. Every other piece belongs to
    one block by the hash of its row number; blocks hold about ``block`` pieces whatever the keys. Repeated rows are pieces of
    their own; an empty table gives an empty result.
    """
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    own = fresh(pieces, "row")
    rows = staged(pieces.withColumn(own, F.monotonically_increasing_id()), "pieces")
    filled = rows.where(F.col("length") >= capacity).select(*columns, (-1 - F.col(own)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < capacity).select(F.col(own).alias("row"), F.col("length").cast("long"))
    blocks = max(1, -(-rest.count() // block))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long")).select("block", "row", "length")
    best = evolved(rest, capacity, islands, rounds)

    def place(key: tuple, table: pa.Table, chosen: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        bin_of, length = np.frombuffer(chosen["bin_of"][0].as_py(), np.int32), table["length"].to_numpy()
        order = np.argsort(bin_of, kind="stable")
        ends = np.cumsum(length[order])
        begins = ends - length[order]
        new = np.concatenate([[True], np.diff(bin_of[order]) > 0])
        offset = np.empty(len(length), np.int64)
        offset[order] = begins - np.maximum.accumulate(np.where(new, begins, 0))
        ids = (int(key[0].as_py()) << 20) + bin_of.astype(np.int64)
        return pa.table({"row": table["row"], "sequence_id": pa.array(ids), "offset": pa.array(offset)})

    placed = rest.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(place, "row long, sequence_id long, offset long")
    number, sequence, at = (fresh(rows, c) for c in ("placed_row", "placed_sequence", "placed_offset"))
    placed = placed.select(F.col("row").alias(number), F.col("sequence_id").alias(sequence), F.col("offset").alias(at))
    others = rows.join(placed, F.col(own) == F.col(number)).select(*columns, F.col(sequence).alias("sequence_id"), F.col(at).alias("offset"))
    return filled.unionByName(others)


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of every document with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer_path))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenora.llm.bpe import default_path

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
