"""State that grows with what happens: tables in buckets, and streams with keyed state and event time."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tenora.operators import replay
from tenora.operators.queries import rate_limit
from tenora.sources import snapshots
from tenora.sources.fixtures import Fixture
from tenora.sources.schemas import TABLES
from tenora.streaming import streams

NOW = dt.datetime(2026, 8, 17, 12)
SIGN_INS = "event_id long, firebase_uid string, email string, email_verified boolean, display_name string, ts timestamp_ntz"


def new_id():
    return F.crc32(F.col("firebase_uid").cast("binary"))


def user(i, name="n"):
    return (i, f"u{i}", f"u{i}@x", True, name, None, NOW, NOW)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = f"file://{tmp_path}"
    users = spark.createDataFrame([user(i) for i in range(300)], TABLES["users"])
    one = snapshots.write_changes(spark, folder, snapshots.current(spark, folder), {"users": users})
    before = files(tmp_path)
    two = snapshots.write_changes(spark, folder, one, {"users": spark.createDataFrame([user(7, "new"), user(900)], TABLES["users"])})
    changed = {b for b, v in two.versions["users"].items() if one.versions["users"].get(b) != v}
    assert 1 <= len(changed) <= 2 and before < files(tmp_path)
    rows = {r["id"]: r["display_name"] for r in snapshots.read_bucketed(spark, folder, "users").collect()}
    assert len(rows) == 301 and rows[7] == "new" and rows[900] == "n"
    # readers of the state before still find it
    assert snapshots.read_bucketed(spark, folder, "users", one).count() == 300
    three = snapshots.write_changes(spark, folder, two, {}, {"users": users.where("id < 300")})
    assert [r["id"] for r in snapshots.read_bucketed(spark, folder, "users", three).collect()] == [900] and len(three.versions["users"]) == 1
    assert snapshots.read_bucketed(spark, folder, "tenants").count() == 0


def test_of_two_writers_one_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}"
    base = snapshots.current(spark, folder)
    snapshots.write_changes(spark, folder, base, {"users": spark.createDataFrame([user(1, "first")], TABLES["users"])})
    with pytest.raises(snapshots.LostUpdate):
        snapshots.write_changes(spark, folder, base, {"users": spark.createDataFrame([user(1, "second")], TABLES["users"])})
    assert [r["display_name"] for r in snapshots.read_bucketed(spark, folder, "users").collect()] == ["first"]
    tried = []

    def change(manifest):
        if not tried:  # another writer comes first, once
            snapshots.write_changes(spark, folder, manifest, {"users": spark.createDataFrame([user(2)], TABLES["users"])})
        tried.append(manifest.number)
        return {"users": spark.createDataFrame([user(3)], TABLES["users"])}

    snapshots.update(spark, folder, change)
    assert tried == [1, 2] and {r["id"] for r in snapshots.read_bucketed(spark, folder, "users").collect()} == {1, 2, 3}


def test_a_replayed_batch_adds_no_file(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = [(1, "a", " A@x ", True, "Ann", NOW), (2, "b", "b@x", False, None, NOW), (3, None, "c@x", True, None, NOW)]
    spark.createDataFrame(rows, SIGN_INS).write.parquet(f"{tmp_path}/s")
    run = lambda at: snapshots.store_sign_ins(spark.readStream.schema(SIGN_INS).parquet(f"{tmp_path}/s"), folder, F.lit(str(NOW)).cast("timestamp_ntz"), new_id()).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    run(f"{tmp_path}/k1")
    found = {r["firebase_uid"]: (r["id"], r["email"]) for r in snapshots.read_bucketed(spark, folder, "users").collect()}
    assert set(found) == {"a", "b"} and found["a"][1] == "a@x" and None not in {i for i, _ in found.values()}
    before = files(f"{tmp_path}/store")
    run(f"{tmp_path}/k2")  # a new checkpoint delivers batch 0 again
    assert files(f"{tmp_path}/store") == before and snapshots.current(spark, folder).number == 1


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def start(stream, path):
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/k").option("path", f"{path}/o").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_settled_limits_equal_batch_whatever_the_order(spark, sf_dir, tmp_path, rocks):
    requests = Fixture(spark, sf_dir).requests.select("event_id", "caller", "policy", "ts")
    want = {(r["event_id"], r["admitted"], r["retry_after"]) for r in rate_limit(requests, F.lit(5), 86400).collect()}
    rows = [(r["event_id"], r["caller"], r["policy"], r["ts"]) for r in requests.collect()]
    newest = max(r[3] for r in rows)
    # three arrivals; each holds a day's requests in any order, and some of the day before
    rnd = random.Random(1)
    rnd.shuffle(rows)
    first, last = min(r[3] for r in rows), newest
    third = (last - first) / 3
    arrivals = [[], [], []]
    for r in rows:
        at = min(2, int((r[3] - first) / third))
        arrivals[min(2, at + (rnd.random() < 0.2 and r[3] > first + (at + 1) * third - dt.timedelta(days=2)))].append(r)
    schema = "event_id long, caller string, policy string, ts timestamp"
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/r")
    stream = lambda: streams.settled_limits(read(), {"bootstrap": 5, "invitation-redemption": 5}, 86400, "3 days")
    as_instant = lambda part: spark.createDataFrame(part, schema.replace("ts timestamp", "ts timestamp_ntz")).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (*arrivals, [(-1, "end", "none", newest + dt.timedelta(days=30))]):
        as_instant(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
        q = start(stream(), tmp_path)
    got = [(r["event_id"], r["admitted"], r["retry_after"]) for r in spark.read.parquet(f"{tmp_path}/o").collect()]
    assert len(got) == len(rows) and set(got) == want
    # nothing is kept but the last request and its window
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    as_instant([(-2, "late", "none", first)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
    start(stream(), tmp_path)
    assert spark.read.parquet(f"{tmp_path}/o").where("event_id = -2").count() == 0


def test_members_kept_by_key_equal_one_batch(spark, sf_dir, tmp_path, rocks):
    x = Fixture(spark, sf_dir)
    want = {(r["command_id"], r["outcome"]) for r in replay.replay_membership_commands(x.memberships, x.commands)[0].collect()}
    cut = x.commands.agg(F.percentile_approx("ts", 0.5).alias("t")).first()["t"]
    initial = spark.createDataFrame(streams.first_state(x.memberships).collect(), streams.first_state(x.memberships).schema)
    for part in (F.col("ts") <= F.lit(cut), F.col("ts") > F.lit(cut)):
        x.commands.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
        rows = spark.readStream.schema(x.commands.schema).parquet(f"{tmp_path}/c")
        q = start(streams.membership_stream(rows, initial), tmp_path)  # the second start goes on from the checkpoint
    assert {(r["command_id"], r["outcome"]) for r in spark.read.parquet(f"{tmp_path}/o").collect()} == want
    progress = q.lastProgress["stateOperators"][0]
    members = initial.count()
    assert progress["numRowsTotal"] >= members * 0.5 and progress["numRowsUpdated"] < members


def test_invitations_of_the_first_state(spark, tmp_path, rocks):
    invitations = spark.createDataFrame([(5, 1, "d@x", 10, NOW + dt.timedelta(days=1), None, None), (6, 1, "e@x", 20, NOW + dt.timedelta(days=1), NOW, None), (7, 1, "f@x", 20, NOW + dt.timedelta(days=1), None, NOW)], "id long, tenant_id long, email string, role int, expires_at timestamp_ntz, accepted_at timestamp_ntz, revoked_at timestamp_ntz")
    initial = streams.first_state(spark.createDataFrame([(1, 1, 30)], "tenant_id long, user_id long, role int"), invitations)
    schema = "tenant_id long, command_id long, actor_id long, target_id long, ts timestamp_ntz, kind string, role int, invitation_id long, email string"
    log = [(1, 1, 2, None, NOW, "accept", None, 6, "e@x"), (1, 2, 2, None, NOW, "accept", None, 7, "f@x"), (1, 3, 1, None, NOW, "issue", 10, 8, "d@x"), (1, 4, 4, None, NOW, "accept", None, 5, "d@x"), (1, 5, 1, None, NOW, "issue", 10, 9, "d@x"), (2, 6, 1, None, NOW, "leave", None, None, None)]
    spark.createDataFrame(log, schema).coalesce(1).write.parquet(f"{tmp_path}/c")
    start(streams.membership_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/c"), initial), tmp_path)
    got = {r["command_id"]: r["outcome"] for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert got == {1: "invitation.already_accepted", 2: "invitation.revoked", 3: "invitation.already_pending", 4: "ok", 5: "ok", 6: "resource.not_found"}
