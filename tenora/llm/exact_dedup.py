"""Operator 1: exact deduplication with a heavy-hitter split.

Digests that fill more than 1/1024 of the table are found by Misra-Gries summaries and verified by exact counts;
their winners, 2048 rows at most, are broadcast and decide their copies where they are read. Only the remaining
digests are shuffled, so no task receives one large group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenora.llm.heavy import heavy_hitters
from tenora.plans.staging import fresh, staged

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text's UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def heavy_winners(digests: DataFrame, share: int = 1024) -> DataFrame:
    """digest, keep_id, keep_row, group_size of every digest above 1/share of the rows (and of some near it).

    ``digests`` has doc_id, row, digest. At most 2 * share rows.
    """
    candidates = heavy_hitters(digests, "digest", share, 4 * share)
    found = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.min(_order()).alias("first"), F.count("*").alias("group_size"))
    return found.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")


def _order() -> Column:
    """Smallest doc_id first, null last, then the row number."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id stays; null ids sort last and, where a group has no other, one of them stays with a
    null keep_id. Rows that repeat an id and a text count as copies: exactly one of them is kept. Columns of
    ``docs`` other than the two named are not read. An empty table gives an empty result.
    """
    digests = staged(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest(F.col(text_col)).alias("digest")), "digests"
    )
    rows = with_winner(digests, share)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def with_winner(digests: DataFrame, share: int = 1024) -> DataFrame:
    """Stored rows (doc_id, row, digest) with keep_id, keep_row and group_size of their digest.

    Heavy digests are decided where they are read, the others by one shuffle.
    """
    winners = staged(heavy_winners(digests, share), "winners")
    hot = digests.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    cold = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("first", F.min(_order()).over(group))
        .select("digest", "doc_id", "row", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.count("*").over(group).alias("group_size"))
    )
    return hot.select(*cold.columns).unionByName(cold)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of heavy digests are removed where they are read; what remains is shuffled once, by digest, and the first
    row of each is taken.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest(F.col(text_col)).alias("digest"))
    own, hot, keep, nth = (fresh(docs, c) for c in ("digest", "hot", "keep", "nth"))
    winners = staged(heavy_winners(staged(known, "digests"), share).select(F.col("digest").alias(hot), F.col("keep_id").alias(keep)), "winners")
    rows = docs.withColumn(own, digest(F.col(f"`{text_col}`"))).join(F.broadcast(winners), F.col(own) == F.col(hot), "left")
    rows = rows.where(F.col(hot).isNull() | F.col(f"`{id_col}`").eqNullSafe(F.col(keep)))
    order = Window.partitionBy(own).orderBy(F.col(f"`{id_col}`").asc_nulls_last())
    return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
