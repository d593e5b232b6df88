"""Operator 4: near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine t are sqrt(2 - 2t) apart. Rotated to their principal axes and split into blocks of coordinates, each
block gets a share of that squared distance in proportion to its variance; two vectors that near are within the share of
at least one block. So each block is joined by itself on a range: a tree of cuts, fitted on a sample, divides the block's
space into boxes. A vector lives in one box and visits every later one that lies within the block's range of it; of two
vectors in range, that of the earlier box visits the other's. A task compares what lives in a box with itself and with the
visitors, and verifies what is within the range on the original vectors, in double precision. A pair counts in the first
block that brings it together. Tasks report each vector's number of links and a spanning forest, never pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.llm.graph import components, forest
from tenora.plans.staging import staged

THRESHOLD = 0.95
FIT_SAMPLE = 8192
BLOCKS = 4
SLACK = 1e-6
BOX_BYTES = 8 << 20  # of vectors that live in a task's box; visitors may take four times that
LEAST_BOX = 256  # rows
DEPTH = 11  # of cuts, at most: a tree has at most 2048 boxes, and larger ones are dealt to several tasks
FEW = 64  # vectors of a length that fewer have are compared in one task
BAND = 1e-9  # decisions closer than this are taken again by sums whose rounding does not depend on the task


class Subspaces:
    """A rotation, its blocks of axes, and each block's share of the squared distance."""

    def __init__(self, sample: np.ndarray, threshold: float):
        d = sample.shape[1]
        values, axes = np.linalg.eigh(np.cov(sample.T).reshape(d, d) if len(sample) > 1 else np.eye(d))
        order = np.argsort(-values)
        self.axes = np.ascontiguousarray(axes[:, order].T)
        variance = np.maximum(values[order], values.max() * 1e-3 + 1e-12)
        n = max(1, min(BLOCKS, d // 8))
        edges = np.linspace(0, d, n + 1).astype(int)
        self.blocks = [slice(int(a), int(b)) for a, b in itertools.pairwise(edges)]
        # slack covers rounding, so that no pair at the threshold is lost
        total = (2 - 2 * threshold) * (1 + SLACK) + 1e-12
        self.budgets = [total * float(variance[s].sum() / variance.sum()) for s in self.blocks]

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        """Coordinates on the axes. Sums run along each row, so a vector's do not depend on those beside it."""
        out = np.empty_like(unit)
        for k, axis in enumerate(self.axes):
            out[:, k] = (unit * axis).sum(1)
        return out

    def gap(self, b: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Squared distances in block b, row by row, rounded alike in every task and in either order."""
        apart = u - v
        return sum(((apart * axis).sum(1) ** 2 for axis in self.axes[self.blocks[b]]), np.zeros(len(u)))


class Boxes:
    """A tree of cuts through a block's space, each where few of the sample are within the range of it."""

    def __init__(self, sample: np.ndarray, budget: float, depth: int):
        self.budget = budget * (1 + BAND) + 1e-12
        self.count = 0
        self.root = self._grown(sample, np.sqrt(budget), depth)

    def _grown(self, points: np.ndarray, reach: float, depth: int) -> int | tuple:
        best = None
        if depth and len(points) > 3:
            for axis in range(points.shape[1]):
                line = np.sort(points[:, axis])
                cuts = line[(len(line) * np.linspace(0.3, 0.7, 9)).astype(int)]
                near = np.searchsorted(line, cuts + reach, "right") - np.searchsorted(line, cuts - reach)
                k = int(np.argmin(near))
                if cuts[k] < line[-1] and (best is None or near[k] < best[0]):
                    best = (int(near[k]), axis, float(cuts[k]))
        if best is None:
            self.count += 1
            return self.count - 1
        _, axis, cut = best
        low = points[:, axis] <= cut
        return axis, cut, self._grown(points[low], reach, depth - 1), self._grown(points[~low], reach, depth - 1)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of x (at least one), the boxes they live in or visit, and which it is: of those in range, its own and the later ones."""
        found: list[tuple[np.ndarray, int, np.ndarray]] = []

        def down(node: int | tuple, rows: np.ndarray, off: np.ndarray, gap: np.ndarray, lives: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, int):
                found.append((rows, node, lives))
                return
            axis, cut, low, high = node
            by = x[rows, axis] - cut
            across = gap - off[:, axis] ** 2 + by**2
            for child, inside in ((low, by <= 0), (high, by > 0)):
                so_far = np.where(inside, gap, across)
                ok = (so_far <= self.budget) | (lives & inside)
                own = off[ok]
                own[:, axis] = np.where(inside[ok], own[:, axis], np.abs(by[ok]))
                down(child, rows[ok], own, so_far[ok], lives[ok] & inside[ok])

        down(self.root, np.arange(len(x)), np.zeros(x.shape), np.zeros(len(x)), np.ones(len(x), bool))
        rows = np.concatenate([f[0] for f in found])
        box = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
        lives = np.concatenate([f[2] for f in found])
        home = np.empty(len(x), np.int64)
        home[rows[lives]] = box[lives]
        keep = box >= home[rows]
        return rows[keep], box[keep], lives[keep]


def unit_rows(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(1))[:, None]


def _cosine(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1)))


def _settled(value: np.ndarray, limit: float, again: Callable[..., np.ndarray]) -> np.ndarray:
    """value <= limit; what is too close to call is computed again, some places at a time."""
    ok = value <= limit
    close = np.nonzero(np.abs(value - limit) < BAND)
    for at in range(0, len(close[0]), 1 << 16):
        some = tuple(c[at : at + (1 << 16)] for c in close)
        ok[some] = again(*some) <= limit
    return ok


class Side:
    """Vectors of one side of a comparison: as they are, as unit vectors, and turned."""

    def __init__(self, raw: np.ndarray, spaces: Subspaces):
        self.wide = raw.astype(np.float64)
        self.unit = unit_rows(raw)
        self.turned = self.unit @ spaces.axes.T


def linked_tiles(spaces: Subspaces, b: int, x: Side, y: Side | None, threshold: float, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs that block b is the first to bring together and that are similar, tile by tile; within x if y is None."""
    same = y is None
    y = x if same else y
    limit = np.float32(spaces.budgets[b] + 1e-4)
    own = spaces.blocks[b]
    bx, by = x.turned[:, own].astype(np.float32), y.turned[:, own].astype(np.float32)
    one = lambda z: np.ones((len(z), 1), np.float32)
    square = lambda z: (z * z).sum(1, keepdims=True)
    # products of these rows are the squared distances
    fx, fy = np.hstack([bx, square(bx), one(bx)]), np.hstack([-2 * by, one(by), square(by)])
    for p in range(0, len(fx), step):
        for q in range(p if same else 0, len(fy), step):
            hit = fx[p : p + step] @ fy[q : q + step].T <= limit
            if same and p == q:
                hit = np.triu(hit, 1)
            n = np.count_nonzero(hit)
            if not n:
                continue
            u, v = slice(p, p + step), slice(q, q + step)
            if n * 16 > hit.size:
                i, j = _of_all(spaces, b, x, y, u, v, hit, threshold)
            else:
                i, j = np.nonzero(hit)
                i, j = _of_some(spaces, b, x, y, i + p, j + q, threshold)
            if len(i):
                yield i, j


def _of_some(spaces: Subspaces, b: int, x: Side, y: Side, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    for e in (b, *range(b)):
        s = spaces.blocks[e]
        gap = ((x.turned[i, s] - y.turned[j, s]) ** 2).sum(1)
        near = _settled(gap, spaces.budgets[e], lambda k, e=e, i=i, j=j: spaces.gap(e, x.unit[i[k]], y.unit[j[k]]))
        ok = near if e == b else ~near
        i, j = i[ok], j[ok]
    ok = _cosine(x.wide[i], y.wide[j]) >= threshold
    return i[ok], j[ok]


def _of_all(spaces: Subspaces, b: int, x: Side, y: Side, u: slice, v: slice, hit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for a tile of which many pairs are near, by products of matrices."""
    for e in (b, *range(b)):
        s = spaces.blocks[e]
        tx, ty = x.turned[u, s], y.turned[v, s]
        gap = (tx * tx).sum(1)[:, None] + (ty * ty).sum(1)[None, :] - 2 * (tx @ ty.T)
        near = _settled(gap, spaces.budgets[e], lambda i, j, e=e: spaces.gap(e, x.unit[u][i], y.unit[v][j]))
        hit &= near if e == b else ~near
    hit &= _settled(-(x.unit[u] @ y.unit[v].T), -threshold, lambda i, j: -_cosine(x.wide[u][i], y.wide[v][j]))
    i, j = np.nonzero(hit)
    return i + u.start, j + v.start


def linked_pairs(spaces: Subspaces, b: int, x: np.ndarray, y: np.ndarray | None, threshold: float, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of :func:`linked_tiles` at once, for small sets of vectors."""
    found = list(linked_tiles(spaces, b, Side(x, spaces), None if y is None else Side(y, spaces), threshold, step))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, int), np.zeros(0, int))


class Links:
    """Numbers of links and the forest of a task's vectors, added up tile by tile."""

    def __init__(self, n: int):
        self.n = np.zeros(n, np.int64)
        self.root = np.arange(n)
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        new = np.bincount(i, minlength=len(self.n)) + np.bincount(j, minlength=len(self.n))
        self.n += new
        # a tile's pairs are kept as its forest alone
        nodes = np.flatnonzero(new)
        at = np.zeros(len(new), np.int64)
        at[nodes] = np.arange(len(nodes))
        self.ends.append((nodes, nodes[forest(len(nodes), at[i], at[j])]))
        self.held += len(nodes)
        if self.held > 1 << 18:
            self.fold()

    def fold(self) -> None:
        a = np.concatenate([np.arange(len(self.root)), *[e[0] for e in self.ends]])
        c = np.concatenate([self.root, *[e[1] for e in self.ends]])
        self.root, self.ends, self.held = forest(len(self.root), a, c), [], 0

    def table(self, row: np.ndarray) -> pa.Table:
        self.fold()
        some = np.flatnonzero(self.n)
        return pa.table({"row": pa.array(row[some], pa.int64()), "n": pa.array(self.n[some], pa.int64()), "root": pa.array(row[self.root[some]], pa.int64())})


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows link when the cosine of their vectors, in double precision, is ``threshold`` or more; every such pair is found.
    Vectors that are null, empty, all zero, or hold a null, NaN or infinite component link with nothing, and vectors of
    different lengths never link. Repeated rows link like any equal vectors. Rotation and boxes are fitted on FIT_SAMPLE
    vectors of a length; they affect speed alone, as any give the same links. Lengths that fewer than FEW vectors have are
    compared in one task each. An empty table gives an empty result. In many nearly independent dimensions the blocks
    prune little: work then grows nearly with the square of the number of vectors, and copies shipped faster than it.
    """
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = staged(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.when(fine, F.size(v))),
        "vectors",
    )
    known = rows.where("size IS NOT NULL")
    sizes = known.groupBy("size").count().where(F.col("count") >= FEW).collect()  # at most one for FEW rows
    links = _few_links(known.where(~F.col("size").isin([s for s, _ in sizes])), threshold)
    for size, n in sizes:
        links = links.unionByName(_links(known.where(F.col("size") == size).select("row", "v"), size, n, kind, threshold))
    links = staged(links, "links")
    counts = links.groupBy("row").agg(F.sum("n").alias("n_links"))
    near = components(links.select(F.col("row").alias("src"), F.col("root").alias("dst")), "vec").withColumnRenamed("node", "row")
    named = staged(rows.select("row", "vec_id").join(near, "row", "left").withColumn("component", F.coalesce("component", "row")), "named")
    # the component's smallest id, by an aggregate that is joined back
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least, "component").join(counts, "row", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _few_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Links among vectors of lengths that few have: each length is a task."""

    def compare(table: pa.Table) -> pa.Table:
        row = table["row"].to_numpy()
        wide = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["v"].chunks]).astype(np.float64).reshape(len(row), -1)
        unit = unit_rows(wide)
        links = Links(len(row))
        similar = _settled(-(unit @ unit.T), -threshold, lambda i, j: -_cosine(wide[i], wide[j]))
        links.add(*np.nonzero(np.triu(similar, 1)))
        return links.table(row)

    return rows.groupBy("size").applyInArrow(compare, "row long, n long, root long")


def _links(rows: DataFrame, size: int, n: int, kind: type, threshold: float) -> DataFrame:
    """row, number of links found, and a root in the same component: one row for each vector and task with links."""
    taken = [r["v"] for r in rows.orderBy(F.xxhash64("row")).limit(FIT_SAMPLE).select("v").collect()]
    sample = unit_rows(np.array(taken, np.float64))
    spaces = Subspaces(sample, threshold)
    width = size * np.dtype(kind).itemsize
    lodgers = max(BOX_BYTES // width, LEAST_BOX)
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(n / min(lodgers, max(-(-n // 4), LEAST_BOX)))))))
    turned = spaces.rotated(sample)
    boxes = [Boxes(turned[:, s], budget, depth) for s, budget in zip(spaces.blocks, spaces.budgets, strict=True)]

    def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), kind).reshape(batch.num_rows, size)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((box.count, 2), np.int64) for box in boxes]
        for batch in batches:
            if not batch.num_rows:
                continue
            at = spaces.rotated(unit_rows(vectors_of(batch)))
            for b, box in enumerate(boxes):
                _, place, lives = box.places(at[:, spaces.blocks[b]])
                np.add.at(found[b], (place, np.where(lives, 0, 1)), 1)
        for b, counts in enumerate(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), b)), pa.array(np.arange(len(counts))), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["b", "box", "living", "visiting"])

    # at most BLOCKS * 2^DEPTH rows
    totals = rows.mapInArrow(counted, "b long, box long, living long, visiting long").groupBy("b", "box").agg(F.sum("living").alias("living"), F.sum("visiting").alias("visiting"))
    shares = [np.ones((box.count, 2), np.int64) for box in boxes]
    for b, box, living, visiting in totals.collect():
        parts = max(1, -(-living // lodgers))
        shares[b][box] = parts, max(1, -(-(visiting + (living if parts > 1 else 0)) // (4 * lodgers)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, raw = batch.column(0).to_numpy(), vectors_of(batch)
            at = spaces.rotated(unit_rows(raw))
            mixed = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            one, two = (mixed >> np.uint64(33)).astype(np.int64), (mixed >> np.uint64(3) & np.uint64(0x3FFFFFFF)).astype(np.int64)
            for b, box in enumerate(boxes):
                who, place, lives = box.places(at[:, spaces.blocks[b]])
                parts, rights = shares[b][place].T
                part, right = one[who] % parts, two[who] % rights
                # on the left in every task of its own part; on the right in one task of each part before it, or of each part visited
                for times, side in ((np.where(lives, rights, 0), 0), (np.where(lives, part, parts), 1)):
                    k = np.repeat(np.arange(len(who)), times)
                    nth = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
                    i, j = (part[k], nth) if side == 0 else (nth, right[k])
                    for s in range(0, len(k), 8192):
                        some = slice(s, s + 8192)
                        packed = raw[who[k[some]]].tobytes()
                        ends = np.arange(len(k[some]) + 1, dtype=np.int32) * width
                        keys = [np.full(len(k[some]), b), place[k[some]], i[some], j[some], np.full(len(k[some]), side), row[who[k[some]]]]
                        yield pa.RecordBatch.from_arrays(
                            [*[pa.array(x, pa.int64()) for x in keys], pa.Array.from_buffers(pa.binary(), len(k[some]), [None, pa.py_buffer(ends), pa.py_buffer(packed)])],
                            ["b", "box", "i", "j", "side", "row", "v"],
                        )

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        b, _, _, j = (k.as_py() for k in key)
        side, row = table["side"].to_numpy(), table["row"].to_numpy()
        order = np.lexsort((row, side))
        raw = np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(len(row), size)[order]
        side, row = side[order], row[order]
        left = int((side == 0).sum())
        links = Links(len(row))
        if left:
            x = Side(raw[:left], spaces)
            if j == 0:
                for p, q in linked_tiles(spaces, b, x, None, threshold):
                    links.add(p, q)
            for at in range(left, len(row), 8192):
                for p, q in linked_tiles(spaces, b, x, Side(raw[at : at + 8192], spaces), threshold):
                    links.add(p, q + at)
        return links.table(row)

    tasks = rows.mapInArrow(dealt, "b long, box long, i long, j long, side long, row long, v binary")
    return tasks.groupBy("b", "box", "i", "j").applyInArrow(compare, "row long, n long, root long")


def op4_vector_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r GROUP BY r.a
"""
