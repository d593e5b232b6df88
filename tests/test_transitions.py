"""State transitions: jobs, replay, snapshots and streams."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenora.operators import audits, jobs, queries, replay
from tenora.sources import tables
from tenora.sources.fixtures import Fixture
from tenora.streaming import streams

NOW = dt.datetime(2026, 8, 17, 12)
USERS = "id long, firebase_uid string, email string, email_verified boolean, display_name string, last_seen_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
SIGN_INS = "event_id long, firebase_uid string, email string, email_verified boolean, display_name string, ts timestamp_ntz"


def now():
    return F.lit(str(NOW)).cast("timestamp_ntz")


def test_upsert_normalises_refreshes_and_repeats(spark):
    old = dt.datetime(2020, 1, 1)
    users = spark.createDataFrame([(1, "a", "a@x", True, "A", old, old, old), (2, "b", "b@x", True, None, old, old, old)], USERS)
    rows = [(1, "a", "OTHER@x", False, " ", NOW), (2, "c", " New.User@Example.com ", True, "New User", NOW - dt.timedelta(hours=1)), (3, "c", "new.user@example.com", True, "N", NOW), (4, None, "x@y", True, None, NOW), (5, "d", " ", True, None, NOW)]
    signs = spark.createDataFrame(rows, SIGN_INS)
    out = jobs.upsert_users(users, signs, now())
    by = {r["firebase_uid"]: r for r in out.collect()}
    assert set(by) == {"a", "b", "c"}
    assert by["a"]["email"] == "other@x" and by["a"]["display_name"] is None and by["a"]["profile_changed"] and by["a"]["created_at"] == old and by["a"]["updated_at"] == NOW
    assert by["b"]["updated_at"] == old and not by["b"]["inserted"]
    assert by["c"]["inserted"] and by["c"]["email"] == "new.user@example.com" and by["c"]["display_name"] == "N"
    again = {r["firebase_uid"]: r for r in jobs.upsert_users(out.drop("inserted", "profile_changed"), signs, now()).collect()}
    assert not again["a"]["profile_changed"] and again["c"]["created_at"] == by["c"]["created_at"]
    assert {r["event_id"] for r in jobs.refused_sign_ins(signs).collect()} == {4, 5}


def test_slugs_of_one_batch_never_collide(spark):
    caller = spark.createDataFrame([("u", 1, True), ("v", 2, False)], "firebase_uid string, id long, email_verified boolean")
    taken = spark.createDataFrame([("acme",), ("acme-3",)], "slug string")
    names = ["Acme", "Acme 2", "Acme", "", "x" * 101]
    rows = [(i, "u", n, NOW) for i, n in enumerate(names)] + [(10, "v", "B", NOW), (11, "w", "B", NOW)]
    out = {r["command_id"]: r for r in jobs.create_tenants(spark.createDataFrame(rows, "command_id long, firebase_uid string, name string, ts timestamp_ntz"), caller, taken).collect()}
    assert [out[i]["slug"] for i in range(3)] == ["acme-2", "acme-2-2", "acme-4"]
    assert out[3]["error_code"] == out[4]["error_code"] == "request.validation_failed"
    assert (out[10]["error_code"], out[11]["error_code"]) == ("user.email_not_verified", "user.not_provisioned")


INVITES = "id long, tenant_id long, email string, token_hash binary, accepted_at timestamp_ntz, revoked_at timestamp_ntz, expires_at timestamp_ntz"


def test_accept_order_of_refusals(spark):
    later, past = NOW + dt.timedelta(days=1), NOW - dt.timedelta(days=1)
    states = [(1, None, None, later), (2, None, past, past), (3, past, None, later), (4, None, None, NOW), (5, past, past, later), (6, None, None, later)]
    inv = spark.createDataFrame([(i, 1, "a@x", None, a, r, e) for i, a, r, e in states], INVITES).withColumn("token_hash", F.unhex(F.sha2(F.concat(F.lit("t"), F.col("id")), 256)))
    users = spark.createDataFrame([(1, "a@x"), (2, "b@x"), (3, "m@x")], "id long, email string")
    members = spark.createDataFrame([(1, 3, 10)], "tenant_id long, user_id long, role int")
    commands = [(1, "t2", 1), (2, "t3", 1), (3, "t4", 1), (4, "t5", 1), (5, "t1", 2), (6, "t9", 1), (7, "t2", 3), (8, "t1", 9), (20, "t1", 1), (21, "t6", 1), (22, "t1", 2)]
    out = jobs.accept_invitations(spark.createDataFrame([(*c, NOW) for c in commands], "command_id long, token string, user_id long, ts timestamp_ntz"), users, members, inv)
    assert {r["command_id"]: r["outcome"] for r in out.collect()} == {
        1: "invitation.revoked", 2: "invitation.already_accepted", 3: "invitation.expired", 4: "invitation.revoked", 5: "access.forbidden", 6: "resource.not_found", 7: "already_member", 8: "user.not_provisioned",
        20: "accepted", 21: "already_member", 22: "access.forbidden",
    }


def test_accept_with_a_shared_address(spark):
    later = NOW + dt.timedelta(days=1)
    inv = spark.createDataFrame([(i, 1, "a@x", None, None, None, later) for i in (1, 2, 3)], INVITES).withColumn("token_hash", F.unhex(F.sha2(F.concat(F.lit("t"), F.col("id")), 256)))
    users = spark.createDataFrame([(1, "a@x"), (2, "A@x"), (3, "a@x")], "id long, email string")
    members = spark.createDataFrame([], "tenant_id long, user_id long, role int")
    commands = [(1, "t1", 1), (2, "t1", 2), (3, "t2", 2), (4, "t2", 2), (5, "t2", 3), (6, "t3", 1), (7, "t3", 3), (8, "t1", 3)]
    out = jobs.accept_invitations(spark.createDataFrame([(*c, NOW) for c in commands], "command_id long, token string, user_id long, ts timestamp_ntz"), users, members, inv)
    used, member = "invitation.already_accepted", "already_member"
    assert {r["command_id"]: r["outcome"] for r in out.collect()} == {1: "accepted", 2: used, 3: "accepted", 4: member, 5: used, 6: member, 7: "accepted", 8: member}


def test_second_run_inserts_nobody(spark):
    users = spark.createDataFrame([], "id long, firebase_uid string, email string, email_verified boolean, display_name string, last_seen_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz")
    sign_ins = spark.createDataFrame([("u", "a@x", True, "A", NOW, 1), ("v", "b@x", True, None, NOW, 2)], "firebase_uid string, email string, email_verified boolean, display_name string, ts timestamp_ntz, event_id long")
    once = jobs.upsert_users(users, sign_ins, F.lit(NOW).cast("timestamp_ntz"))
    assert {(r["firebase_uid"], r["inserted"]) for r in once.collect()} == {("u", True), ("v", True)}
    again = jobs.upsert_users(once.drop("inserted", "profile_changed"), sign_ins, F.lit(NOW).cast("timestamp_ntz"))
    assert {(r["firebase_uid"], r["inserted"], r["profile_changed"]) for r in again.collect()} == {("u", False, False), ("v", False, False)}


def test_at_most_one(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "id long, uid string")
    assert queries.at_most_one(rows, "uid").count() == 4
    with pytest.raises(Exception, match="more than one row for uid: a"):
        queries.at_most_one(rows.union(rows.where("id = 1")), "uid").collect()


def state(**roles):
    return replay.TenantState({int(k[1:]): v for k, v in roles.items()})


@pytest.mark.parametrize(
    ("roles", "command", "outcome"),
    [
        ({"u1": 30}, ("leave", 1, 1, None), "tenant.last_owner"), ({"u1": 30, "u2": 10}, ("set_role", 1, 1, 20), "tenant.last_owner"), ({"u1": 30, "u2": 30}, ("set_role", 1, 1, 20), "ok"),
        ({"u1": 30, "u2": 10}, ("set_role", 1, 2, 15), "request.validation_failed"), ({"u1": 30, "u2": 20, "u3": 20}, ("remove", 2, 3, None), "access.forbidden"), ({"u1": 30, "u2": 20}, ("remove", 2, 1, None), "access.forbidden"),
        ({"u1": 30, "u2": 20}, ("remove", 2, 2, None), "ok"), ({"u1": 30, "u2": 20}, ("set_role", 2, 2, 30), "access.forbidden"), ({"u1": 30, "u2": 10}, ("remove", 2, 2, None), "access.forbidden"), ({"u1": 30}, ("remove", 1, 7, None), "resource.not_found"),
        ({"u1": 30}, ("set_role", 9, 1, 10), "resource.not_found"), ({"u1": 30}, ("set_role", 1, 1, 30), "ok"), ({"u1": 30, "u2": 10}, ("leave", 2, 2, None), "ok"), ({"u1": 30}, ("remove", 1, 1, None), "tenant.last_owner"),
    ],
)
def test_replay_rules(roles, command, outcome):
    assert state(**roles).apply(*command) == outcome


def test_replay_invitations_in_one_log():
    t, at = state(u1=30, u2=20), pd.Timestamp(NOW)
    assert t.apply("issue", 2, None, 30, 1, "x@y", at) == "access.forbidden"
    assert t.apply("issue", 1, None, 20, 1, "x@y", at) == "ok"
    assert t.apply("issue", 1, None, 20, 2, "x@y", at) == "invitation.already_pending"
    assert t.apply("accept", 5, None, None, 1, "other@y", at) == "access.forbidden"
    assert t.apply("accept", 5, None, None, 1, "x@y", at + pd.Timedelta(days=7)) == "invitation.expired"
    assert t.apply("accept", 5, None, None, 1, "x@y", at) == "ok" and t.roles[5] == 20
    assert t.apply("revoke", 1, None, None, 1) == "invitation.already_accepted"


def test_replay_keeps_an_owner(spark, sf_dir):
    x = Fixture(spark, sf_dir)
    outcomes, after = replay.replay_membership_commands(x.memberships, x.commands)
    assert outcomes.count() == x.commands.count()
    owners = after.groupBy("tenant_id").agg(F.count_if(F.col("role") == 30).alias("n")).collect()
    assert len(owners) == x.tenants.count() and min(r["n"] for r in owners) >= 1


def test_snapshot_round_trip(spark, sf_dir, tmp_path):
    from tenora.sources.schemas import TABLES

    made = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    tables.write_snapshot(made, f"file://{tmp_path}")
    made["users"] = spark.createDataFrame([(1, "u", "e", True, None, None, NOW, NOW)], TABLES["users"])
    tables.write_snapshot(made, f"file://{tmp_path}")
    read = tables.read_snapshot(spark, f"file://{tmp_path}")
    assert read["users"].count() == 1 and read["tenants"].count() == 0


def test_audit_finds_each_kind(spark):
    u = spark.createDataFrame([(1, "a", "e", True, None), (1, "a", None, True, "n" * 201)], "id long, firebase_uid string, email string, email_verified boolean, display_name string")
    t = spark.createDataFrame([(1, "n", "s", 9)], "id long, name string, slug string, created_by_user_id long")
    m = spark.createDataFrame([(1, 2, 1, 10)], "id long, tenant_id long, user_id long, role int")
    i = spark.createDataFrame([(1, 1, "x", 10, bytearray(3), NOW, None, None)], "id long, tenant_id long, email string, role int, token_hash binary, expires_at timestamp_ntz, accepted_at timestamp_ntz, revoked_at timestamp_ntz")
    rules = {r["rule"] for r in audits.audit_constraints({"users": u, "tenants": t, "memberships": m, "invitations": i}).collect()}
    assert {"unique users(id)", "unique users(firebase_uid)", "required users.email", "length users.display_name", "reference tenants.created_by_user_id", "reference memberships.tenant_id", "owner of tenants", "length invitations.token_hash"} <= rules


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streamed_limits_equal_batch(spark, sf_dir, tmp_path, rocks):
    from tenora.operators.queries import rate_limit

    x = Fixture(spark, sf_dir)
    x.requests.select("event_id", "caller", "policy", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/r")
    rows = spark.readStream.schema("event_id long, caller string, policy string, ts timestamp").parquet(f"{tmp_path}/r")
    _run(streams.limited_requests(rows, {"bootstrap": 5, "invitation-redemption": 5}, 86400), "limits")
    got = {(r["event_id"], r["admitted"], r["retry_after"]) for r in spark.sql("SELECT * FROM limits").collect()}
    want = {(r["event_id"], r["admitted"], r["retry_after"]) for r in rate_limit(x.requests, F.lit(5), 86400).collect()}
    assert got == want
    _run(streams.windowed_requests(rows, 86400), "windows")
    assert spark.sql("SELECT count(*) AS n FROM windows").first()["n"] > 0


def test_streamed_commands_equal_batch(spark, sf_dir, tmp_path, rocks):
    x = Fixture(spark, sf_dir)
    early = F.lit("1900-01-01").cast("timestamp_ntz")
    seed = x.memberships.select(F.col("id").alias("command_id"), "tenant_id", F.col("user_id").alias("actor_id"), F.col("user_id").alias("target_id"), early.alias("ts"), F.lit("seed").alias("kind"), "role")
    seed.unionByName(x.commands).coalesce(1).write.parquet(f"{tmp_path}/c")
    rows = spark.readStream.schema(seed.schema).parquet(f"{tmp_path}/c")
    _run(streams.membership_stream(rows), "commands")
    got = {(r["command_id"], r["outcome"]) for r in spark.sql("SELECT * FROM commands").collect()}
    want = {(r["command_id"], r["outcome"]) for r in replay.replay_membership_commands(x.memberships, x.commands)[0].collect()}
    assert got == want


def test_sign_in_stream_and_log(spark, tmp_path):
    old = dt.datetime(2020, 1, 1)
    kept = {"users": spark.createDataFrame([(1, "a", "a@x", True, None, old, old, old)], USERS)}
    spark.createDataFrame([(1, "b", "B@x", True, None, NOW)], SIGN_INS).write.parquet(f"{tmp_path}/s")
    rows = spark.readStream.schema(SIGN_INS).parquet(f"{tmp_path}/s")

    def store(df, batch_id):
        df.write.mode("overwrite").parquet(f"{tmp_path}/u-{batch_id}")
        kept["users"] = spark.read.parquet(f"{tmp_path}/u-{batch_id}")

    streams.sign_in_stream(rows, lambda: kept["users"], store, now()).trigger(availableNow=True).start().awaitTermination()
    assert {r["email"] for r in kept["users"].collect()} == {"a@x", "b@x"}
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"event_id":1,"ts":"2024-01-01T00:00:01Z","status":500,"path":"/api"}\n{"event_id":2,"ts":"2024-01-01T02:00:00Z","status":200,"path":"/api"}\n')
    assert tables.read_request_log(spark, f"{tmp_path}/log").count() == 2
    _run(streams.error_rates(tables.read_request_log(spark, f"{tmp_path}/log", streaming=True)), "rates")
    assert [r["n_error"] for r in spark.sql("SELECT * FROM rates").collect()] == [1]


def test_vector_queries_in_tiles(spark):
    from tenora.operators.retrieval import vector_top_k

    rows = [(i, [float((i * 7 + j * j * 3) % 11 - 5) for j in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0, None, 0.0, 0.0]), (63, [float("nan")] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, vector_top_k(q, v, 3).collect()))
    want, good = [], {i: np.array(x) for i, x in rows[:60]}
    for i, x in good.items():
        near = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9), j) for j, y in good.items() if j != i)[:3]
        want += [(i, j, -c, n) for n, (c, j) in enumerate(near, 1)]
    assert [(r[0], r[1], r[3]) for r in whole] == [(w[0], w[1], w[3]) for w in sorted(want)]
    assert sorted(map(tuple, vector_top_k(q, v, 3, tile=7).collect())) == whole
    assert vector_top_k(q, v.limit(0), 3).count() == 0


def test_accepted_commands_make_rows(spark):
    from tenora.functions.columns import token_hash
    from tenora.sources.schemas import INVITATIONS, MEMBERSHIPS, TENANTS

    old = dt.datetime(2020, 1, 1)
    users = spark.createDataFrame([(1, "a", "a@x", True, None, old, old, old), (2, "b", "b@x", True, None, old, old, old)], USERS)
    creates = spark.createDataFrame([(i, "a", "Acme", NOW) for i in range(1, 31)], "command_id long, firebase_uid string, name string, ts timestamp_ntz")
    outcomes = jobs.create_tenants(creates, users, spark.createDataFrame([], TENANTS))
    codes = {r["command_id"]: (r["slug"], r["error_code"]) for r in outcomes.collect()}
    assert codes[1] == ("acme", None) and codes[25] == ("acme-25", None) and codes[26] == codes[30] == (None, "tenant.slug_exhausted")
    tenants, members = jobs.created(outcomes, creates, users, F.col("command_id") + 100)
    assert tenants.columns == TENANTS.names and members.columns == MEMBERSHIPS.names and tenants.count() == 25
    assert {(r["tenant_id"], r["user_id"], r["role"]) for r in members.collect()} == {(i + 100, 1, 30) for i in range(1, 26)}
    none = spark.createDataFrame([], INVITATIONS)
    issues = spark.createDataFrame([(1, 101, 1, "B@x", 10, "t1", NOW), (2, 101, 1, "b@x", 10, "t2", NOW), (3, 101, 2, "c@x", 10, "t3", NOW)], "command_id long, tenant_id long, actor_id long, email string, role int, token string, ts timestamp_ntz")
    invitations = jobs.issued(jobs.issue_invitations(issues, users, tenants, members, none), issues, F.col("command_id"))
    assert invitations.columns == INVITATIONS.names
    assert [(r["id"], r["email"], r["expires_at"]) for r in invitations.collect()] == [(1, "b@x", NOW + dt.timedelta(days=7))]
    accepts = spark.createDataFrame([(1, "t1", 2, NOW), (2, "t1", 1, NOW), (3, "t9", 2, NOW)], "command_id long, token string, user_id long, ts timestamp_ntz")
    new, after = jobs.accepted(jobs.accept_invitations(accepts, users, members, invitations), accepts, invitations, F.col("command_id"))
    assert [(r["tenant_id"], r["user_id"], r["role"]) for r in new.collect()] == [(101, 2, 10)]
    assert after.columns == INVITATIONS.names and [(r["accepted_at"], r["accepted_by_user_id"]) for r in after.collect()] == [(NOW, 2)]
    assert after.select(token_hash(F.lit("t1")) == F.col("token_hash")).first()[0]


def test_invitations_of_a_tenant_in_turn():
    b = replay.TenantState({1: 30})
    ts = pd.Timestamp(NOW)
    assert b.apply("issue", 1, None, 10, 7, "b@x", ts) == "ok" and b.apply("issue", 1, None, 10, 8, "b@x", ts) == "invitation.already_pending"
    assert b.apply("issue", 1, None, None, 9, "c@x", ts) == "request.validation_failed"
    assert b.owners == 1 and b.open == {"b@x": 1}
    assert b.apply("revoke", 1, None, None, 7) == b.apply("revoke", 1, None, None, 7) == "ok" and b.apply("issue", 1, None, 20, 8, "b@x", ts) == "ok"
    assert b.apply("accept", 2, None, None, 8, "b@x", ts) == "ok" and b.roles[2] == 20 and b.apply("leave", 1, None, None) == "tenant.last_owner"
    assert b.apply("set_role", 1, 2, 30) == b.apply("leave", 1, None, None) == "ok" and b.owners == 1 and b.open == {}


def test_streamed_invitations(spark, tmp_path, rocks):
    schema = "tenant_id long, command_id long, actor_id long, target_id long, ts timestamp_ntz, kind string, role int, invitation_id long, email string"
    late = NOW + dt.timedelta(days=8)
    first = [(1, 0, 1, 1, NOW, "seed", 30, None, None), (1, 0, 1, None, NOW, "seed", 10, 5, "d@x"), (1, 1, 1, None, NOW, "issue", 10, 6, "b@x")]
    second = [(1, 2, 2, None, NOW, "accept", None, 6, "b@x"), (1, 3, 4, None, late, "accept", None, 5, "d@x"), (1, 4, 2, 1, late, "remove", None, None, None)]
    for n, part in enumerate((first, second)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
        stream = streams.membership_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/c"))
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/k").option("path", f"{tmp_path}/o").trigger(availableNow=True).start().awaitTermination()
    got = {r["command_id"]: r["outcome"] for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert got == {1: "ok", 2: "ok", 3: "invitation.expired", 4: "access.forbidden"}


def test_attempts_carry_no_hashes(spark, sf_dir, monkeypatch):
    from tenora.operators import registry

    kept, stage = [], jobs.staged
    monkeypatch.setattr(jobs, "staged", lambda df, tag: kept.append((tag, df.dtypes)) or stage(df, tag))
    assert registry.registered()["accept_contested_invitations"](spark, sf_dir).count() > 0
    assert {tag for tag, _ in kept} == {"attempts", "rivals", "winners"}
    assert not [x for _, types in kept for x in types if x[1] == "binary"], kept


def test_addresses_are_looked_up_and_not_made_distinct(spark, sf_dir):
    from tenora.operators import registry

    plan = registry.registered()["issue_invitations"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ExistenceJoin") == 2
    assert not [line for line in plan.splitlines() if "Aggregate [tenant_id" in line and "email" in line]
