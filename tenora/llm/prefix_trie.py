"""A prefix trie of conversations, built as a z-fast trie: compacted nodes are found by hashes at two-fattest depths.

Every turn of a conversation gets a hash of all turns up to it, a sum of hashes of (depth, turn), so that long conversations are
summed in parts. A compacted node is an edge from depth ``top`` (exclusive) to its extent ``low``, named by the hash there, with the
conversation ``owner`` that runs along it. Its handle is the depth in (top, low] that is divisible by the highest power of two.

Conversations are put in by batches. In each, every one left finds the edge where it leaves the trie: it halves its depths by handles (fat
binary search), one join for each halving, and compares hashes along the last edge. All edges are then split where
somebody leaves or ends, and of those that leave at one place by one turn a random one becomes a new leaf. The others are
below it and stay for the next batch; their number of batches is logarithmic, as a random one halves a subtree more often than not.
At the end edges are expanded to the nodes on them. What holds for whole subtrees is summed by doubling: after round k, a
node has the sum over descendants nearer than 2^k.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenora.plans.staging import staged

BITS = 30
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["low", "g1", "g2", "top", "t1", "t2", "owner", "at", "h1", "h2", "c1", "c2"]  # extent, parent's extent, owner, handle, first turn below the parent


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that is divisible by the highest power of two."""
    return F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(a.bitwiseXOR(b))) - 1).bitwiseAND(b)


def ordered_turns(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with their position from 1 and the range they fell into: conv, part, pos, digest, bytes.

    Positions are counted within ranges of the sorted rows and moved by what stands in ranges before, so that a conversation with
    very many turns is spread over tasks. Null turns come first; ties go by role, then by the turn's hash.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = staged(turns.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id().cast("long")), "turns")
    own = Window.partitionBy("conv", "part").orderBy(*order)
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moved = dealt.groupBy("conv", "part").agg(F.count("*").alias("n")).select("conv", "part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = dealt.withColumn("nth", F.row_number().over(own)).join(moved, ["conv", "part"])
    return numbered.select("conv", "part", (F.col("before") + F.col("nth")).alias("pos"), "digest", "bytes")


def rebuilt(rows: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of their family's first: all ids (conv), and turns (conv, part, depth, digest, bytes)."""
    turns = staged(ordered_turns(rows), "positions")
    known = staged(turns.groupBy("conv").agg(F.count("*").alias("n")), "conversations")
    base, taken = F.col("conv") - F.col("conv") % family, F.crc32(F.col("conv").cast("string").cast("binary")) % most
    wanted = known.select("conv", base.alias("base"), taken.alias("h"))
    has = known.select(F.col("conv").alias("base"), F.col("n").alias("given"))
    wanted = staged(wanted.join(has, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("given")), "wanted")
    heads = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    first = wanted.join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv", F.lit(-1).cast("long").alias("part"), F.col("pos").alias("depth"), "digest", "bytes")
    own = turns.join(wanted, "conv").where(F.col("pos") > F.col("h")).select("conv", "part", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "digest", "bytes")
    return known.select("conv"), first.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns with the hash of all turns up to each: conv, depth, h1, h2, bytes, total (bytes up to here). Parts are summed one by one."""
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")), 256)
    pieces = [F.conv(F.substring(hashed, 1 + 8 * i, 7), 16, 10).cast("long").alias(f"s{i}") for i in range(4)]
    rows = staged(turns.select("conv", "part", "depth", "bytes", *pieces), "terms")
    names = [f"s{i}" for i in range(4)] + ["bytes"]
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv", "part").agg(*[F.sum(c).alias(c) for c in names]).select("conv", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in names])
    here = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("conv", "part", "depth", "bytes", *[F.sum(c).over(here).alias(f"{c}_here") for c in names]).join(parts, ["conv", "part"])
    up_to = lambda c: F.col(f"{c}_before") + F.col(f"{c}_here")
    low = lambda i: up_to(f"s{i}").bitwiseAND(F.lit((1 << BITS) - 1))
    pair = lambda i: F.shiftleft(low(i), BITS).bitwiseOR(low(i + 1))
    return staged(sums.select("conv", "depth", pair(0).alias("h1"), pair(2).alias("h2"), "bytes", up_to("bytes").alias("total")), "prefixes")


def _hash_at(rows: DataFrame, prefix: DataFrame, who: str, depth: Column, names: tuple[str, str], how: str = "left") -> DataFrame:
    """``rows`` with the hash of conversation ``who`` at ``depth``, under two new names; 0 at the root."""
    p = prefix.select(F.col("conv").alias("_conv"), F.col("depth").alias("_depth"), F.col("h1").alias(names[0]), F.col("h2").alias(names[1]))
    return rows.withColumn("_at", depth).join(p, (F.col(who) == F.col("_conv")) & (F.col("_at") == F.col("_depth")), how).drop("_conv", "_depth", "_at")


def _exits(left: DataFrame, nodes: DataFrame, prefix: DataFrame) -> DataFrame:
    """Where each conversation left (rep, n, e1, e2, and a node on its path: a, a1, a2) leaves the trie.

    Adds d, d1, d2 (the place), q1, q2 (its next turn's hash, null at its end) and x, x1, x2 (the edge that is split there, null at a node).
    """
    none = F.lit(None).cast("long")
    edge = [f"x_{c}" for c in ("low", "g1", "g2", "top", "owner")]
    state = left.withColumn("b", F.col("n")).select("*", *[none.alias(c) for c in edge])
    found = []
    while True:
        asking = F.col("x_low").isNull() & (F.col("a") < F.col("b"))
        found.append(state.where(~asking))
        state = state.where(asking)
        if state.isEmpty():
            break
        handles = nodes.select("at", F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("low").alias("f_low"), F.col("g1").alias("f_g1"), F.col("g2").alias("f_g2"), F.col("top").alias("f_top"), F.col("owner").alias("f_owner"))
        probe = _hash_at(state.withColumn("f", fattest(F.col("a"), F.col("b"))), prefix, "rep", F.col("f"), ("p1", "p2"))
        probe = probe.join(handles, (F.col("f") == F.col("at")) & (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2")), "left")
        probe = _hash_at(probe, prefix, "rep", F.col("f_low"), ("r1", "r2"))
        hit = F.col("f_low").isNotNull()
        whole = hit & F.coalesce((F.col("r1") == F.col("f_g1")) & (F.col("r2") == F.col("f_g2")), F.lit(False))
        go = lambda yes, c: F.when(whole, F.col(yes)).otherwise(F.col(c)).alias(c)
        state = staged(
            probe.select(
                "rep", "n", "e1", "e2", go("f_low", "a"), go("f_g1", "a1"), go("f_g2", "a2"), F.when(hit, F.col("b")).otherwise(F.col("f") - 1).alias("b"),
                *[F.when(hit & ~whole, F.col(f"f_{c[2:]}")).alias(c) for c in edge],
            ), "search",
        )
    state = found[0]
    for more in found[1:]:
        state = state.unionByName(more)
    # below the deepest node on the path there may still be an edge that begins with the next turn
    state = _hash_at(state, prefix, "rep", F.col("a") + 1, ("q1", "q2"))
    below = nodes.select(*[F.col(c[2:]).alias(f"f_{c[2:]}") for c in edge], F.col("t1").alias("k1"), F.col("t2").alias("k2"), "c1", "c2")
    on = (F.col("a") == F.col("f_top")) & (F.col("a1") == F.col("k1")) & (F.col("a2") == F.col("k2")) & (F.col("q1") == F.col("c1")) & (F.col("q2") == F.col("c2"))
    state = state.join(below, on, "left").select("rep", "n", "e1", "e2", "a", "a1", "a2", "q1", "q2", *[F.coalesce(c, f"f_{c[2:]}").alias(c) for c in edge])
    state = staged(state, "exits")
    at_node = state.where("x_low IS NULL").select("rep", "n", "e1", "e2", F.col("a").alias("d"), F.col("a1").alias("d1"), F.col("a2").alias("d2"), "q1", "q2", none.alias("x"), none.alias("x1"), none.alias("x2"))
    # along an edge, hashes agree up to the place
    mine = prefix.select(F.col("conv").alias("rep"), "depth", "h1", "h2")
    theirs = prefix.select(F.col("conv").alias("x_owner"), "depth", F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    along = state.where("x_low IS NOT NULL").drop("q1", "q2").join(mine, "rep").where((F.col("depth") > F.col("x_top")) & (F.col("depth") <= F.col("x_low") + 1))
    same = F.coalesce((F.col("o1") == F.col("h1")) & (F.col("o2") == F.col("h2")) & (F.col("depth") <= F.col("x_low")), F.lit(False))
    along = along.join(theirs, ["x_owner", "depth"], "left").withColumn("same", same).withColumn("hash", F.struct("h1", "h2"))
    keys = ["rep", "n", "e1", "e2", "x_low", "x_g1", "x_g2"]
    place = along.groupBy(*keys).agg(F.max(F.when(F.col("same"), F.struct("depth", "hash"))).alias("last"), F.min(F.when(~F.col("same"), F.struct("depth", "hash"))).alias("next"))
    inside = F.col("last.depth") < F.col("x_low")
    place = place.select(
        "rep", "n", "e1", "e2", F.col("last.depth").alias("d"), F.col("last.hash.h1").alias("d1"), F.col("last.hash.h2").alias("d2"), F.col("next.hash.h1").alias("q1"), F.col("next.hash.h2").alias("q2"),
        F.when(inside, F.col("x_low")).alias("x"), F.when(inside, F.col("x_g1")).alias("x1"), F.when(inside, F.col("x_g2")).alias("x2"),
    )
    return staged(at_node.unionByName(place), "places")


def _inserted(nodes: DataFrame, places: DataFrame, prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes after a batch, and the conversations that stay for the next one."""
    cuts = places.where("x IS NOT NULL").select(F.col("x").alias("low"), F.col("x1").alias("g1"), F.col("x2").alias("g2"), "d", "d1", "d2").distinct()
    edges = cuts.select("low", "g1", "g2").distinct()
    kept = nodes.join(edges, ["low", "g1", "g2"], "left_anti")
    broken = nodes.join(edges, ["low", "g1", "g2"], "left_semi")
    ends = cuts.join(broken, ["low", "g1", "g2"]).select(*NODE, "d", "d1", "d2").unionByName(broken.select(*NODE, F.col("low").alias("d"), F.col("g1").alias("d1"), F.col("g2").alias("d2")))
    order = Window.partitionBy("low", "g1", "g2").orderBy("d")
    before = lambda c, first: F.coalesce(F.lag(c).over(order), F.col(first))
    pieces = ends.select("owner", F.col("d").alias("_d"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), before("d", "top").alias("top"), before("d1", "t1").alias("t1"), before("d2", "t2").alias("t2"))
    pieces = pieces.select("owner", F.col("_d").alias("low"), F.col("_d1").alias("g1"), F.col("_d2").alias("g2"), "top", "t1", "t2")
    going = places.where(F.col("n") > F.col("d"))
    chosen = going.groupBy("d", "d1", "d2", "q1", "q2").agg(F.min(F.struct(F.xxhash64("rep").alias("dice"), "rep", "n", "e1", "e2")).alias("one"))
    leaves = chosen.select(F.col("one.rep").alias("owner"), F.col("one.n").alias("low"), F.col("one.e1").alias("g1"), F.col("one.e2").alias("g2"), F.col("d").alias("top"), F.col("d1").alias("t1"), F.col("d2").alias("t2"))
    new = pieces.unionByName(leaves).withColumn("at", fattest(F.col("top"), F.col("low")))
    new = _hash_at(_hash_at(new, prefix, "owner", F.col("at"), ("h1", "h2")), prefix, "owner", F.col("top") + 1, ("c1", "c2"))
    after = staged(kept.select(*NODE).unionByName(new.select(*NODE)), "nodes")
    rest = going.join(leaves.select(F.col("owner").alias("rep")), "rep", "left_anti")
    return after, staged(rest.select("rep", "n", "e1", "e2", F.col("d").alias("a"), F.col("d1").alias("a1"), F.col("d2").alias("a2")), "left")


def compacted(sequences: DataFrame, prefix: DataFrame) -> DataFrame:
    """All compacted nodes but the root (columns ``NODE``), of distinct sequences (rep, n, e1, e2) with their prefix hashes."""
    zero = F.lit(0).cast("long")
    left = staged(sequences.where("n > 0").select("rep", "n", "e1", "e2", zero.alias("a"), zero.alias("a1"), zero.alias("a2")), "left")
    nodes = sequences.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in NODE))
    own = prefix
    while not left.isEmpty():
        nodes, left = _inserted(nodes, _exits(left, nodes, own), own)
    return nodes


def subtree_sums(nodes: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """``nodes`` with columns ``sums`` and ``least`` totalled over each node and all below it, in as many rounds as the height has binary digits."""
    values = staged(nodes.select(*NODE[:6], *sums, *least).withColumns({c: F.when(F.col("top") > 0, F.col(a)) for c, a in (("up", "top"), ("u1", "t1"), ("u2", "t2"))}), "values")
    while not values.where("up IS NOT NULL").isEmpty():
        below = values.where("up IS NOT NULL").groupBy("up", "u1", "u2").agg(*[F.sum(c).alias(f"{c}_") for c in sums], *[F.min(c).alias(f"{c}_") for c in least])
        below = below.withColumnsRenamed({"up": "low", "u1": "g1", "u2": "g2"})
        total = [(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in sums] + [F.least(c, f"{c}_").alias(c) for c in least]
        onward = values.select(F.col("low").alias("up"), F.col("g1").alias("u1"), F.col("g2").alias("u2"), F.col("up").alias("v"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        values = values.join(below, ["low", "g1", "g2"], "left").select(*NODE[:6], "up", "u1", "u2", *total).join(onward, ["up", "u1", "u2"], "left")
        values = staged(values.select(*NODE[:6], *sums, *least, F.col("v").alias("up"), F.col("v1").alias("u1"), F.col("v2").alias("u2")), "values")
    return nodes.drop(*sums, *least).join(values.select("low", "g1", "g2", *sums, *least), ["low", "g1", "g2"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """For each sequence (n, e1, e2), the SHA-256 of its members' ids (conv) in ascending order, joined by commas.

    Ids are joined within ranges first, so that the task that hashes a sequence of very many members reads one row for each range.
    """
    keys = ["n", "e1", "e2"]
    dealt = ends.repartitionByRange(*keys, "conv").withColumn("part", F.spark_partition_id())
    joined = dealt.groupBy(*keys, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if row[:3] != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = row[:3], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row[3].encode())
            if out:
                yield _batch(out)
        if key is not None:
            yield _batch([(*key, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*keys, "ends_sha256"])

    return joined.repartition(*keys).sortWithinPartitions(*keys, "part").select(*keys, "part", "ids").mapInArrow(hashed, "n long, e1 long, e2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations; the columns are those of :func:`op13_prefix_trie`.

    Reads conv_id, turn, role and text alone, so other columns may have any name. Rows without a conv_id belong to no conversation and are left out;
    null roles and texts are empty; null turns come first; rows of one turn are ordered by role and hash, repeated rows are turns
    of their own. An empty table has no node, not even a root.
    """
    ids, turns = rebuilt(conversations)
    prefix = prefixes(turns)
    zero = F.lit(0).cast("long")
    last = prefix.groupBy("conv").agg(F.max(F.struct("depth", "h1", "h2")).alias("end"))
    ends = staged(ids.join(last, "conv", "left").select("conv", *[F.coalesce(F.col(f"end.{c}"), zero).alias(n) for c, n in (("depth", "n"), ("h1", "e1"), ("h2", "e2"))]), "ends")
    sequences = staged(ends.groupBy("n", "e1", "e2").agg(F.min("conv").alias("rep"), F.count("*").alias("members")), "sequences")
    path = staged(prefix.join(sequences.select(F.col("rep").alias("conv")), "conv", "left_semi"), "paths")
    nodes = compacted(sequences, path)
    kids = nodes.groupBy(F.col("top").alias("low"), F.col("t1").alias("g1"), F.col("t2").alias("g2")).agg(F.count("*").alias("kids"))
    members = sequences.select(F.col("n").alias("low"), F.col("e1").alias("g1"), F.col("e2").alias("g2"), "members", F.col("rep").alias("least"))
    bytes_at = path.select(F.col("conv").alias("owner"), F.col("depth").alias("low"), F.col("total").alias("low_bytes"))
    bytes_top = path.select(F.col("conv").alias("owner"), F.col("depth").alias("top"), F.col("total").alias("top_bytes"))
    full = nodes.join(kids, ["low", "g1", "g2"], "left").join(members, ["low", "g1", "g2"], "left").join(bytes_at, ["owner", "low"]).join(bytes_top, ["owner", "top"], "left")
    full = full.select(*NODE, F.coalesce("kids", zero).alias("kids"), F.coalesce("members", zero).alias("members"), "least", F.col("kids").isNull().cast("long").alias("leaves"), "low_bytes", F.coalesce("top_bytes", zero).alias("top_bytes"))
    full = staged(subtree_sums(staged(full, "full"), ["members", "leaves"], ["least"]), "counted")
    full = full.withColumn("saved", (F.col("members") - 1) * (F.col("low_bytes") - F.col("top_bytes")))
    full = staged(subtree_sums(staged(full, "weighed"), ["saved"], []), "saved")
    hashes = staged(end_hashes(ends), "hashes")
    root = ends.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    tops = full.where("top = 0").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    empty = hashes.where("n = 0").agg(F.coalesce(F.max("ends_sha256"), F.lit(EMPTY)).alias("ends_sha256"))
    root = staged(root.crossJoin(tops).crossJoin(empty), "root")  # three single rows
    parents = full.select(F.col("low").alias("top"), F.col("g1").alias("t1"), F.col("g2").alias("t2"), F.col("least").alias("above"))
    edges = full.join(parents, ["top", "t1", "t2"], "left").join(hashes.withColumnsRenamed({"n": "low", "e1": "g1", "e2": "g2"}), ["low", "g1", "g2"], "left")
    edges = edges.join(F.broadcast(root.select(F.col("conv_id").alias("first"))), F.lit(True))
    spread = edges.withColumn("depth", F.explode(F.sequence(F.col("top") + 1, F.col("low"))))
    steps = path.select(F.col("conv").alias("owner"), "depth", (F.col("total") - F.col("bytes")).alias("before"))
    at_end = F.col("depth") == F.col("low")
    out = spread.join(steps, ["owner", "depth"]).select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("top") + 1, F.col("least")).when(F.col("top") > 0, F.col("above")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(at_end, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("members") - 1) * (F.col("before") - F.col("top_bytes"))).alias("saved_tokens"), F.when(at_end, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )
    return out.unionByName(root.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node over all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = r"""WITH RECURSIVE bits AS (SELECT b, 0 AS k, b AS c FROM range(0, 256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
turns AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv, conv - conv % 5 AS base, count(*) AS n FROM turns GROUP BY ALL),
h AS (SELECT conv, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM convs, crc),
given AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS given FROM h LEFT JOIN convs b ON b.conv = h.base),
seq AS (SELECT g.conv, pos AS depth, digest, bytes FROM given g JOIN turns t ON t.conv = g.base AND pos <= h UNION ALL SELECT g.conv, pos - h + given, digest, bytes FROM given g JOIN turns t ON t.conv = g.conv AND pos > h),
pre AS (SELECT conv, depth, bytes, sha256(string_agg(digest, '' ORDER BY depth) OVER (PARTITION BY conv ORDER BY depth)) AS node FROM seq UNION ALL SELECT conv, 0, 0, '' FROM convs),
path AS (SELECT *, lag(node) OVER (PARTITION BY conv ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv) AS is_end FROM pre),
node AS (SELECT depth, node, any_value(up) AS up, any_value(bytes) AS bytes, min(conv) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (is_end), '')) AS ends_sha256 FROM path GROUP BY 1, 2),
kids AS (SELECT up AS node, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY 1),
below AS (SELECT p.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved FROM node v LEFT JOIN kids k ON k.node = v.node JOIN path p ON p.conv = v.conv_id AND p.depth <= v.depth GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256 FROM node n LEFT JOIN node u ON u.node = n.up LEFT JOIN kids ON kids.node = n.node JOIN below ON below.node = n.node"""
