"""Commands that depend on each other: acceptances that compete, and membership logs, against plain sequential code."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenora.operators import jobs, replay

NOW = dt.datetime(2026, 8, 17, 12)
COMMANDS = "tenant_id long, command_id long, actor_id long, target_id long, ts timestamp_ntz, kind string, role int"


def in_turn(attempts):
    users, tokens, won = set(), set(), set()
    for turn, user, token in sorted(attempts):
        if user not in users and token not in tokens:
            won.add((turn, user, token))
            users.add(user)
            tokens.add(token)
    return won


@pytest.mark.parametrize("seed", [1, 2])
def test_first_come_equals_one_by_one(spark, seed):
    rnd = random.Random(seed)
    attempts = [(i, rnd.randrange(40), rnd.randrange(60)) for i in range(400)]
    df = spark.createDataFrame(attempts + [(900, None, 1), (901, 1, None)], "turn long, user long, token long")
    assert {tuple(r) for r in jobs.first_come(df, ["user"], ["token"], "turn").select("turn", "user", "token").collect()} == in_turn(attempts)


def test_first_come_along_a_chain(spark):
    # each attempt shares a user with the one before and a token with the next
    attempts = [(i, (i + 1) // 2, i // 2) for i in range(12)]
    df = spark.createDataFrame(attempts, "turn long, user long, token long")
    assert {tuple(r) for r in jobs.first_come(df, ["user"], ["token"], "turn").select("turn", "user", "token").collect()} == in_turn(attempts)
    assert jobs.first_come(df.limit(0), ["user"], ["token"], "turn").count() == 0


def test_a_refused_attempt_keeps_nobody_out(spark):
    users = spark.createDataFrame([(i, "team@x") for i in (1, 2, 3)], "id long, email string")
    invitations = spark.createDataFrame([(i, 1, "team@x", bytearray(__import__("hashlib").sha256(f"t{i}".encode()).digest()), NOW + dt.timedelta(days=7), None, None) for i in (1, 2)], "id long, tenant_id long, email string, token_hash binary, expires_at timestamp_ntz, accepted_at timestamp_ntz, revoked_at timestamp_ntz")
    members = spark.createDataFrame([], "tenant_id long, user_id long")
    at = lambda m: NOW + dt.timedelta(minutes=m)
    rows = [(1, "t1", 1, at(1)), (2, "t1", 2, at(2)), (3, "t2", 2, at(3)), (4, "t2", 3, at(4)), (5, "t1", 1, at(5)), (6, "t9", 1, at(6)), (7, None, 1, at(7)), (8, "t1", 9, at(8))]
    out = jobs.accept_invitations(spark.createDataFrame(rows, "command_id long, token string, user_id long, ts timestamp_ntz"), users, members, invitations)
    assert {r["command_id"]: r["outcome"] for r in out.collect()} == {
        1: "accepted", 2: "invitation.already_accepted", 3: "accepted", 4: "invitation.already_accepted", 5: "already_member", 6: "resource.not_found", 7: "resource.not_found", 8: "user.not_provisioned",
    }


def random_log(rnd, tenants, users, n):
    members = [(t, u, rnd.choice([10, 10, 20, 30])) for t in range(tenants) for u in range(users) if rnd.random() < 0.8]
    kinds = ["set_role"] * 5 + ["remove", "leave", "accept", "issue", "revoke", "nonsense"]
    log = []
    for i in range(n):
        kind, actor = rnd.choice(kinds), rnd.randrange(users)
        log.append((rnd.randrange(tenants), i, actor, rnd.choice([actor, rnd.randrange(users), None]), NOW + dt.timedelta(seconds=rnd.randrange(n // 2)), kind, rnd.choice([10, 20, 30, 30, 15, None])))
    return members, log


@pytest.mark.parametrize(("seed", "tenants", "users", "n", "parts"), [(1, 5, 6, 300, None), (4, 1, 8, 400, 5), (3, 2, 3, 200, 3)])
def test_replay_equals_one_by_one(spark, seed, tenants, users, n, parts):
    members, log = random_log(random.Random(seed), tenants, users, n)
    outcomes, after = replay.replay_membership_commands(spark.createDataFrame(members, "tenant_id long, user_id long, role int"), spark.createDataFrame(log, COMMANDS), parts)
    want, left = {}, set()
    for t in range(tenants):
        state = replay.TenantState({u: r for x, u, r in members if x == t})
        mine = pd.DataFrame([x for x in log if x[0] == t], columns=["tenant_id", "command_id", "actor_id", "target_id", "ts", "kind", "role"]).sort_values(["ts", "command_id"])
        want |= {(t, c): code for c, code in zip(mine["command_id"], replay.run_commands(state, mine), strict=True)}
        left |= {(t, u, r) for u, r in state.roles.items()}
    assert {(r["tenant_id"], r["command_id"]): r["outcome"] for r in outcomes.collect()} == want
    assert {tuple(r) for r in after.select("tenant_id", "user_id", "role").collect()} == left
    assert len({"ok", "tenant.last_owner", "access.forbidden", "resource.not_found", "request.validation_failed"} & set(want.values())) == 5


def test_a_large_tenant_is_spread_over_tasks(spark):
    n = 60_000
    i = F.col("id")
    kind = F.when(i % 7 == 0, "remove").otherwise("set_role")
    log = spark.range(n).select(F.lit(1).cast("long").alias("tenant_id"), i.alias("command_id"), F.lit(0).cast("long").alias("actor_id"), (1 + i * 31 % 5000).alias("target_id"), F.lit(NOW).cast("timestamp_ntz").alias("ts"), kind.alias("kind"), (10 + i * 13 % 3 * 10).cast("int").alias("role"))
    members = spark.range(5001).select(F.lit(1).cast("long").alias("tenant_id"), i.alias("user_id"), F.when(i == 0, 30).otherwise(10).alias("role"))
    outcomes, after = replay.replay_membership_commands(members, log, 8)
    assert outcomes.count() == n
    roles = {0: 30} | dict.fromkeys(range(1, 5001), 10)
    for c in range(n):
        target = 1 + c * 31 % 5000
        if target in roles:
            if c % 7 == 0:
                del roles[target]
            else:
                roles[target] = 10 + c * 13 % 3 * 10
    assert {(r["user_id"], r["role"]) for r in after.collect()} == set(roles.items())


def test_replay_of_nothing(spark):
    members = spark.createDataFrame([(1, 1, 30)], "tenant_id long, user_id long, role int")
    outcomes, after = replay.replay_membership_commands(members, spark.createDataFrame([], COMMANDS))
    assert outcomes.count() == 0 and after.count() == 1
    lone = spark.createDataFrame([(2, 1, 1, 1, NOW, "leave", None)], COMMANDS)
    assert [r["outcome"] for r in replay.replay_membership_commands(members, lone)[0].collect()] == ["resource.not_found"]


def test_rounds_read_named_members_only(spark, monkeypatch):
    read, judged = [], replay._judged
    monkeypatch.setattr(replay, "_judged", lambda asked, writes, state, owners: read.append(state.count()) or judged(asked, writes, state, owners))
    members = spark.createDataFrame([(t, u, 30 if u == 0 else 10) for t in (1, 2) for u in range(100)], "tenant_id long, user_id long, role int")
    log = spark.createDataFrame([(1, 1, 0, 5, dt.datetime(2026, 1, 1), "remove", None)], COMMANDS)
    outcomes, after = replay.replay_membership_commands(members, log)
    assert [r["outcome"] for r in outcomes.collect()] == ["ok"] and after.count() == 199
    assert max(read) == 2, read
