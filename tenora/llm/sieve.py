"""A semi-join that shuffles little of its large side: a bitmap of fixed size drops most rows where they are read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenora.plans.staging import fresh, staged

BITS = 1 << 25  # 1024 bitmaps of 4 KB, whatever the data


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def sieved(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` whose column ``name`` occurs in ``keys``, which is stored and distinct in it.

    The bitmap (4 MB, broadcast) lets every wanted row pass, and some others; the exact semi-join that follows drops
    those. With very many keys it lets all pass, which costs a shuffle but changes no result.
    """
    tested, hit = _tested(rows, keys, name)
    return tested.where(hit).join(keys.select(name), name, "left_semi").select(*_columns(rows))


def roughly(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """:func:`sieved` without the exact semi-join, for callers whose own join drops the rows that pass by chance."""
    tested, hit = _tested(rows, keys, name)
    return tested.where(hit).select(*_columns(rows))


def without(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` whose column ``name`` does not occur in ``keys``; null names stay. Rows that the bitmap clears are not shuffled."""
    tested, hit = _tested(rows, keys, name)
    cleared = tested.where(~hit).select(*_columns(rows))
    return cleared.unionByName(tested.where(hit).select(*_columns(rows)).join(keys.select(name), name, "left_anti").select(*_columns(rows)))


def without_wide(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """:func:`without` for stored rows with large columns.

    Of the rows that the bitmap doesn't clear, names alone are compared first, so that of rows that occur in ``keys`` no other column is shuffled: only those that the
    bitmap held back by chance are fetched whole.
    """
    tested, hit = _tested(rows, keys, name)
    held = staged(tested.where(hit).select(name).join(keys.select(name), name, "left_anti").distinct(), "held")
    return tested.where(~hit).select(*_columns(rows)).unionByName(sieved(rows, held, name))


def _columns(rows: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in rows.columns]


def _tested(rows: DataFrame, keys: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """``rows`` joined with their bitmap, and the test: may the name be among the keys?"""
    part, bits = fresh(rows, "part"), fresh(rows, "bits")
    at = _place(F.col(name)) + 1  # bitmap functions count from 1
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    tested = rows.join(F.broadcast(maps), F.bitmap_bucket_number(at) == F.col(part), "left")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return tested, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)) & F.col(name).isNotNull()


def bits_of(rows: DataFrame, key: Column) -> np.ndarray:
    """A bitmap of the lowest bits of ``key``, a long, for use in Python workers: 4 MB at most, whatever the data."""
    at = key.bitwiseAND(F.lit(BITS - 1)) + 1
    maps = rows.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((BITS >> 15, 1 << 12), np.uint8)
    for row in maps.collect():
        out[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` may be among those of :func:`bits_of`; those that were there always are."""
    at = keys & (BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
