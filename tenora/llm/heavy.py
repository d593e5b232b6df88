"""Frequent keys of a distributed column, by Misra-Gries summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MisraGries:
    """At most ``capacity`` counters; a key's counter falls short of its count by n / (capacity + 1) at most."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counters: dict = {}
        self.n = 0

    def add(self, counts: dict) -> None:
        """Take in exact counts of a batch, then shrink back to the capacity."""
        own = self.counters
        for key, c in counts.items():
            own[key] = own.get(key, 0) + c
            self.n += c
        if len(own) > self.capacity:
            cut = sorted(own.values(), reverse=True)[self.capacity]
            self.counters = {k: c - cut for k, c in own.items() if c > cut}

    def frequent(self) -> dict:
        """The counters that stand out; leaving the others away costs n / (capacity + 1) once more."""
        floor = self.n / (self.capacity + 1)
        return {k: c for k, c in self.counters.items() if c > floor}


def heavy_hitters(df: DataFrame, key: str, share: int = 1024, capacity: int = 4096) -> DataFrame:
    """Candidates for every key that holds more than 1/``share`` of the rows: column ``key`` alone.

    Each task keeps one summary of ``capacity`` counters and returns those above its own floor; the merged
    lower bounds are summed. A key with more than n/share rows keeps a merged bound of at least
    n/share - 2n/(capacity + 1), which at most (capacity + 1) / 2 keys can reach for capacity = 4 * share.
    So the result is at most ``2 * share`` rows whatever the input, and is safe to broadcast. The
    candidates are a superset: callers verify them with exact counts. ``df`` should be a stored table, as it is
    read twice.
    """
    n = df.count()
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("bound", T.LongType())])
    arrow = {T.BinaryType(): pa.binary(), T.StringType(): pa.string(), T.LongType(): pa.int64()}[kind]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(capacity)
        for batch in batches:
            counted = batch.column(0).drop_null().value_counts()
            summary.add(dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True)))
        kept = summary.frequent()
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), arrow), pa.array(list(kept.values()), pa.int64())], [key, "bound"])

    merged = df.select(key).mapInArrow(summarise, schema).groupBy(key).agg(F.sum("bound").alias("bound"))
    return merged.where(F.col("bound") >= max(1, n * (1 / share - 2 / (capacity + 1)))).select(key)
