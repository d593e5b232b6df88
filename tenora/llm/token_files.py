"""Operator 7: token-id files of independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a sequence of zstandard frames, each the ids (little-endian unsigned 32-bit) of consecutive documents, then one
skippable frame with the document index, then the seek table in the published seekable format: a skippable
frame of (compressed size, decompressed size, low half of XXH64) for each frame, with a nine-byte footer. A
reader seeks to the footer, reads table and index, and decompresses only the frames of the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenora.llm.words import sliced, word_encoder
from tenora.plans.staging import new_path, staged

# Fixed values of the seekable format.
SKIPPABLE, INDEX_MAGIC = 0x184D2A5E, 0x184D2A50
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

FRAME_BYTES = 1 << 18
END_ID = 2


@dataclass
class Entry:
    at: int
    packed: int
    size: int
    checksum: int


class TokenFileWriter:
    """Writes documents' ids to a binary stream; at most one frame is held."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.size = 0
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        table = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_tokens": pa.array(self.lengths, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        index = self.packer.compress(sink.getvalue().to_pybytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append((len(index) + 8, 0, 0))
        rows = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + len(footer)) + rows + footer)


class TokenFileReader:
    """Reads single documents, or all in order, from a seekable binary file."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        if end < 17:
            raise ValueError("not a token file")
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOTER_MAGIC or flags & CHECKSUMS == 0:
            raise ValueError("no seek table")
        file.seek(end - 9 - 12 * n)
        rows = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(rows[:, 0])])
        self.entries = [Entry(int(starts[i]), int(p), int(s), int(c)) for i, (p, s, c) in enumerate(rows)]
        index = self.entries.pop()
        file.seek(index.at + 8)
        packed = file.read(index.packed - 8)
        self.unpacker = zstandard.ZstdDecompressor()
        with pa.ipc.open_stream(self.unpacker.decompress(packed)) as reader:
            table = reader.read_all()
        self.doc_ids = table["doc_id"].to_pylist()
        self.lengths = table["n_tokens"].to_numpy()
        self.ends = np.cumsum(self.lengths) * 4
        self.frame_ends = np.cumsum([e.size for e in self.entries])

    def frame(self, i: int) -> bytes:
        e = self.entries[i]
        self.file.seek(e.at)
        raw = self.unpacker.decompress(self.file.read(e.packed), max_output_size=max(e.size, 1))
        if len(raw) != e.size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != e.checksum:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def document(self, place: int) -> bytes:
        """The ids of the document at a place of the index; only its frame is decompressed."""
        end, size = int(self.ends[place]), int(self.lengths[place]) * 4
        if not size:
            return b""
        i = int(np.searchsorted(self.frame_ends, end - size, "right"))
        before = int(self.frame_ends[i - 1]) if i else 0
        return self.frame(i)[end - size - before : end - before]

    def find(self, doc_id: int) -> list[bytes]:
        return [self.document(i) for i, d in enumerate(self.doc_ids) if d == doc_id]

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, a frame at a time."""
        place = at = 0
        for i in range(len(self.entries)):
            raw = self.frame(i)
            while place < len(self.doc_ids) and int(self.ends[place]) <= at + len(raw):
                stop = int(self.ends[place]) - at
                yield self.doc_ids[place], raw[stop - int(self.lengths[place]) * 4 : stop]
                place += 1
            at += len(raw)


#: Schemes of folders that pyarrow can open, by Spark's names.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system of a Spark path, and the path in it; Spark's names for S3 are those of pyarrow's."""
    scheme, rest = uri.split("://", 1) if "://" in uri else ("file", uri.removeprefix("file:"))
    scheme = SCHEMES.get(scheme.lower())
    if scheme is None:
        raise ValueError(f"token files can be written to {', '.join(sorted(SCHEMES))}, not to {uri.split('://')[0]}")
    return fs.FileSystem.from_uri(f"{scheme}://{rest}")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = END_ID, chars_per_file: int = 1 << 26) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order, one file for each range of ids.

    Returns the files: part, path, n_docs, n_tokens, in order of part. Texts are dealt by ranges of doc_id once and encoded
    where they are written. A file's name is unique for each attempt, and only names that the finished tasks report
    are used, so repeated tasks do no harm. Null ids come first, null texts count as empty, rows of one id stand in the
    order of their texts, repeated rows are all written, and an empty table gives no file.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // chars_per_file))
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        system, base = file_system(folder)
        out = writer = None
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.ztok"
        for batch in batches:
            for piece in sliced(batch, 1):
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                    if writer is None:
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(path)
                        writer = TokenFileWriter(out)
                    writer.add(doc_id, ids + tail)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.lengths)]})

    dealt = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in ``files`` (of :func:`write_token_files`).

    ``start`` counts the ids of all documents before. The running sum is over one row for each file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as file:
                    at, rows = row["start"], []
                    for doc_id, ids in TokenFileReader(file).documents():
                        rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
                        at += len(ids) // 4
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    tasks = max(1, files.count())
    return placed.select("path", "start").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tenora.llm.bpe import default_path

    folder = new_path(spark, "tokens")
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, default_path())
    return read_token_files(files, folder)
