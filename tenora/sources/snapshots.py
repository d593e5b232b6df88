"""Tables in hash buckets under a manifest: a write copies the touched buckets only, and a write from an old state is refused.

Below a folder, ``data/<table>/<version>/bucket=<n>`` holds the rows of one bucket as one write left them, and
``manifest/<number>.json`` names the version of every bucket. Readers take the newest manifest and see one state, whole. A writer
says which manifest it began from and adds the next number; creating that file fails if another writer was first. That is as
exclusive as the file system's ``create`` without overwriting: on HDFS and on stores with conditional puts fully, elsewhere but for the
instant between check and creation. Versions that no manifest in use names can be deleted at any time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.operators.jobs import upsert_users
from tenora.sources.schemas import TABLES

BUCKETS = 64
#: What a table is bucketed by: users by what sign-ins know of them, the others by tenant.
BUCKETED_BY = {"users": "firebase_uid", "tenants": "id", "memberships": "tenant_id", "invitations": "tenant_id"}


class LostUpdate(RuntimeError):
    """Another writer has changed the tables since the manifest that a write began from."""


@dataclass(frozen=True)
class Manifest:
    """One state of the tables: its number, the version of each bucket, and the last batch of each stream that wrote."""

    number: int = 0
    versions: dict[str, dict[int, str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def _system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _name(number: int) -> str:
    return f"{number:012d}.json"


def current(spark: SparkSession, folder: str) -> Manifest:
    """The newest manifest; an empty one where nothing has been written."""
    system, path = _system(spark, f"{folder}/manifest")
    if not system.exists(path):
        return Manifest()
    names = [s.getPath().getName() for s in system.listStatus(path)]
    newest = max((n for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)
    if newest is None:
        return Manifest()
    kept = json.loads(spark.read.text(f"{folder}/manifest/{newest}", wholetext=True).first()[0])
    return Manifest(kept["number"], {t: {int(b): v for b, v in of.items()} for t, of in kept["versions"].items()}, kept["batches"])


def bucket_of(table: str) -> Column:
    return F.pmod(F.hash(F.col(BUCKETED_BY[table])), F.lit(BUCKETS))


def read_bucketed(spark: SparkSession, folder: str, table: str, manifest: Manifest | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
    """A table, or some of its buckets, as the manifest (else the newest one) has it."""
    versions = (manifest or current(spark, folder)).versions.get(table, {})
    wanted = versions if buckets is None else {b: versions[b] for b in buckets if b in versions}
    paths = [f"{folder}/data/{table}/{version}/bucket={b}" for b, version in sorted(wanted.items())]
    return spark.read.schema(TABLES[table]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[table])


def touched_buckets(rows: DataFrame, table: str) -> list[int]:
    """The buckets that rows with the table's bucketing column fall into; at most ``BUCKETS``."""
    return sorted(r["b"] for r in rows.select(bucket_of(table).alias("b")).distinct().collect())


def write_changes(spark: SparkSession, folder: str, base: Manifest, changes: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None) -> Manifest:
    """The state after ``changes`` (rows that replace those with their id, or are new) and without ``removed`` (rows with id and bucketing column).

    A row must stay in its bucket: its bucketing column doesn't change. ``batch`` (stream, number) is recorded; a batch that the
    base has recorded already writes nothing. Raises :class:`LostUpdate` if ``base`` isn't the newest state any more.
    """
    if batch and base.batches.get(batch[0], -1) >= batch[1]:
        return base
    removed = removed or {}
    versions = {t: dict(of) for t, of in base.versions.items()}
    for table in sorted(changes.keys() | removed.keys()):
        schema, key = TABLES[table], BUCKETED_BY[table]
        gone = [df.select("id", key) for df in (changes.get(table), removed.get(table)) if df is not None]
        keys = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
        buckets = touched_buckets(keys, table)
        rows = read_bucketed(spark, folder, table, base, buckets).join(keys.select("id").distinct(), "id", "left_anti").select(*schema.names)
        if table in changes:
            rows = rows.unionByName(changes[table].select(*schema.names))
        version = uuid.uuid4().hex
        path = f"{folder}/data/{table}/{version}"
        rows.withColumn("bucket", bucket_of(table)).repartition("bucket").write.partitionBy("bucket").parquet(path)
        system, at = _system(spark, path)
        left = {int(s.getPath().getName().split("=")[1]) for s in system.listStatus(at) if s.getPath().getName().startswith("bucket=")}
        of = versions.setdefault(table, {})
        for b in buckets:  # a bucket without rows any more has no version
            of.pop(b, None)
        of.update(dict.fromkeys(left, version))
    after = Manifest(base.number + 1, versions, base.batches | ({batch[0]: batch[1]} if batch else {}))
    _commit(spark, folder, after)
    return after


def _commit(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    newest = current(spark, folder).number
    system, path = _system(spark, f"{folder}/manifest/{_name(manifest.number)}")
    if newest >= manifest.number or system.exists(path):
        raise LostUpdate(f"state {manifest.number} of {folder} has been written already")
    try:
        out = system.create(path, False)
    except Exception as e:  # the other writer was faster
        raise LostUpdate(f"state {manifest.number} of {folder} has been written already") from e
    text = {"number": manifest.number, "versions": manifest.versions, "batches": manifest.batches}
    out.write(bytearray(json.dumps(text).encode()))
    out.close()


def store_sign_ins(sign_ins: DataFrame, folder: str, as_of: Column, new_id: Column, stream: str = "sign-ins", retries: int = 5):
    """Keep the stored users up to date from a stream of sign-ins; returns the stream writer.

    A batch reads and rewrites the buckets that its uids fall into. Its number is in the manifest it writes, so one that is delivered
    again writes nothing; where another writer was first, it starts over from the new state. ``new_id`` gives a new user's id from
    firebase_uid and ts.
    """

    def put(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        for attempt in range(retries):
            base = current(spark, folder)
            if base.batches.get(stream, -1) >= number:
                return
            users = read_bucketed(spark, folder, "users", base, touched_buckets(rows.where("firebase_uid IS NOT NULL"), "users"))
            after = upsert_users(users, rows, as_of, new_id).drop("inserted", "profile_changed")
            try:
                write_changes(spark, folder, base, {"users": after}, batch=(stream, number))
                return
            except LostUpdate:
                if attempt + 1 == retries:
                    raise

    return sign_ins.writeStream.foreachBatch(put)


def update(spark: SparkSession, folder: str, change: Callable[[Manifest], dict[str, DataFrame]], retries: int = 5) -> Manifest:
    """Write what ``change`` makes of the newest state; again from the start where another writer was first."""
    for attempt in range(retries):
        base = current(spark, folder)
        try:
            return write_changes(spark, folder, base, change(base))
        except LostUpdate:
            if attempt + 1 == retries:
                raise
    raise LostUpdate(folder)
