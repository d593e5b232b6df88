"""Commands whose outcome depends on those before.

A log in one batch is replayed by rounds of windows over all commands (:func:`replay_membership_commands`); a stream applies commands one by one to
the state it keeps (:class:`TenantState`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import MutableMapping
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenora.plans.staging import staged
from tenora.sources.schemas import ADMIN, OWNER, ROLE_NAMES


@dataclass(frozen=True)
class Invite:
    email: str
    role: int
    expires_at: pd.Timestamp
    accepted: bool = False
    revoked: bool = False


def _is_open(one: Invite) -> bool:
    return not one.accepted and not one.revoked


class TenantState:
    """One tenant's members (user to role), invitations (id to state) and numbers of open ones by address, with the number of owners.

    The three are dictionaries, or stand for kept state of which only what a command touches is read and written.
    """

    def __init__(self, roles: MutableMapping[int, int] | None = None, invites: MutableMapping[int, Invite] | None = None, open_: MutableMapping[str, int] | None = None, owners: int | None = None):
        self.roles = {} if roles is None else roles
        self.invites = {} if invites is None else invites
        self.open = dict(Counter(i.email for i in self.invites.values() if not i.accepted and not i.revoked)) if open_ is None else open_
        self.owners = sum(r == OWNER for r in self.roles.values()) if owners is None else owners

    def put(self, user: int, role: int | None) -> None:
        """Give a user a role, or none any more."""
        self.owners += (role == OWNER) - (self.roles.pop(user, None) == OWNER)
        if role is not None:
            self.roles[user] = role

    def invite(self, invitation: int, one: Invite) -> None:
        """Take in an invitation, or its new state."""
        old = self.invites.get(invitation)
        change = _is_open(one) - (old is not None and _is_open(old))
        if change:
            n = self.open.get(one.email, 0) + change
            if n:
                self.open[one.email] = n
            else:
                del self.open[one.email]
        self.invites[invitation] = one

    def _losing_last(self, user: int, role: int | None) -> bool:
        return self.roles[user] == OWNER and role != OWNER and self.owners <= 1

    def apply(self, kind: str, actor: int, target: int | None, role: int | None, invitation: int | None = None, email: str | None = None, ts=None) -> str:
        """Carry out one command; returns ok or the code of its refusal."""
        own = self.roles.get(actor)
        if kind == "leave":
            return self._drop(actor) if own is not None else "resource.not_found"
        if kind == "accept":
            return self._accept(actor, invitation, email, ts)
        if own is None:
            return "resource.not_found"
        if kind == "set_role":
            return self._set_role(own, target, role)
        if own < ADMIN:
            return "access.forbidden"
        if kind == "remove":
            if target not in self.roles:
                return "resource.not_found"
            if own == ADMIN and self.roles[target] >= ADMIN and target != actor:
                return "access.forbidden"
            return self._drop(target)
        if kind == "issue":
            return self._issue(own, invitation, email, role, ts)
        if kind == "revoke":
            found = self.invites.get(invitation)
            if found is None:
                return "resource.not_found"
            if found.accepted:
                return "invitation.already_accepted"
            if not found.revoked:
                self.invite(invitation, replace(found, revoked=True))
            return "ok"
        return "request.validation_failed"

    def _set_role(self, own: int, target: int | None, role: int | None) -> str:
        if own < OWNER:
            return "access.forbidden"
        if role not in ROLE_NAMES:
            return "request.validation_failed"
        if target not in self.roles:
            return "resource.not_found"
        if self.roles[target] != role:
            if self._losing_last(target, role):
                return "tenant.last_owner"
            self.put(target, role)
        return "ok"

    def _drop(self, user: int) -> str:
        if self._losing_last(user, None):
            return "tenant.last_owner"
        self.put(user, None)
        return "ok"

    def _issue(self, own: int, invitation: int | None, email: str | None, role: int | None, ts) -> str:
        if role not in ROLE_NAMES or not email or invitation is None or invitation in self.invites:
            return "request.validation_failed"
        if own < OWNER <= role:
            return "access.forbidden"
        if self.open.get(email, 0) > 0:
            return "invitation.already_pending"
        self.invite(invitation, Invite(email, role, ts + pd.Timedelta(days=7)))
        return "ok"

    def _accept(self, user: int, invitation: int | None, email: str | None, ts) -> str:
        found = self.invites.get(invitation)
        if found is None:
            return "resource.not_found"
        if user in self.roles:
            return "ok"
        for failed, code in ((found.revoked, "invitation.revoked"), (found.accepted, "invitation.already_accepted"), (found.expires_at <= ts, "invitation.expired"), (found.email != email, "access.forbidden")):
            if failed:
                return code
        self.invite(invitation, replace(found, accepted=True))
        self.put(user, found.role)
        return "ok"


def number(x) -> int | None:
    return None if pd.isna(x) else int(x)


def run_commands(state: TenantState, commands: pd.DataFrame) -> list[str]:
    """Outcomes of commands in order of (ts, command_id)."""
    optional = lambda row, name: getattr(row, name, None)
    return [
        state.apply(row.kind, number(row.actor_id), number(row.target_id), number(row.role), number(optional(row, "invitation_id")), optional(row, "email"), row.ts)
        for row in commands.sort_values(["ts", "command_id"]).itertuples(index=False)
    ]


def replay_membership_commands(memberships: DataFrame, commands: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Outcomes (tenant_id, command_id, outcome), and the members that are left (tenant_id, user_id, role).

    All commands are judged at once, by the roles that the outcomes of the round before give, until no outcome changes. A
    command's outcome depends on earlier ones alone, so what doesn't change any more is what one would find command by command. Only
    tenants with a changed outcome go on to the next round; there are as many rounds as the longest row of outcomes in a tenant of
    which each changes the next.

    Within a round, roles come from the last write before a command, and the number of owners from a scan: a command that makes
    an owner adds one, one that would unmake an owner takes one unless one is left, and any sequence of these is again
    a function ``max(n + a, b)`` of the number before, which sums and maxima over windows give. Commands are sorted by tenant and time and cut
    into ranges (``parts``, else the session's number); both scans run within ranges and are carried from range to range, so
    that a tenant of any size is spread over tasks. Commands of one tenant should differ in (ts, command_id).
    """
    order = ["tenant_id", "ts", "command_id"]
    todo = commands.select(*order, "actor_id", "kind", F.when(F.col("kind") == "leave", F.col("actor_id")).otherwise(F.col("target_id")).alias("target_id"), F.col("role").cast("int").alias("role"))
    dealt = todo.repartitionByRange(parts, *order) if parts else todo.repartitionByRange(*order)
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()), "commands")
    nth = F.row_number().over(Window.partitionBy("tenant_id", "part").orderBy("ts", "command_id"))
    asked = staged(dealt.select("tenant_id", "command_id", "part", nth.alias("nth"), "actor_id", "target_id", "kind", "role"), "commands")
    state = memberships.groupBy("tenant_id", "user_id").agg(F.max(F.col("role").cast("int")).alias("role"))
    state = staged(state, "members")
    owners = state.where(F.col("role") == OWNER).groupBy("tenant_id").agg(F.count("*").alias("owners"))
    # rounds read those members only whom commands name
    named = asked.select("tenant_id", F.explode(F.array("actor_id", "target_id")).alias("user_id")).distinct()
    members = known = staged(state.join(named, ["tenant_id", "user_id"], "left_semi"), "named")
    writes = _writes(asked.withColumns({"code": F.lit("ok"), "changes": F.lit(False)}))
    settled, last = [], None
    while True:
        now = staged(_judged(asked, writes, known, owners), "verdicts")
        if last is None:
            moving = now.where("changes").select("tenant_id").distinct()
        else:
            before = last.select("tenant_id", "part", "nth", F.struct("code", "changes").alias("before"))
            moving = now.join(before, ["tenant_id", "part", "nth"]).where(F.col("before") != F.struct("code", "changes")).select("tenant_id").distinct()
        moving = staged(moving, "moving")
        settled.append(now.join(moving, "tenant_id", "left_anti"))
        if moving.isEmpty():
            break
        last = now.join(moving, "tenant_id", "left_semi")
        asked, writes, known = last.drop("code", "changes"), _writes(last), members.join(moving, "tenant_id", "left_semi")
    verdicts = reduce(DataFrame.unionByName, settled)
    final = _writes(verdicts).groupBy("tenant_id", "user_id").agg(F.max_by("written", F.struct("part", "nth")).alias("written"))
    after = state.join(final, ["tenant_id", "user_id"], "left").select("tenant_id", "user_id", F.when(F.col("written").isNull(), F.col("role")).otherwise(F.col("written.role")).alias("role"))
    return verdicts.select("tenant_id", "command_id", F.col("code").alias("outcome")), after.where("role IS NOT NULL")


def _writes(verdicts: DataFrame) -> DataFrame:
    """What commands write: the target's new role, null for none any more."""
    role = F.when(F.col("kind") == "set_role", F.col("role"))
    return verdicts.where("changes").select("tenant_id", F.col("target_id").alias("user_id"), "part", "nth", F.struct(role.alias("role")).alias("written"))


def _judged(asked: DataFrame, writes: DataFrame, state: DataFrame, owners: DataFrame) -> DataFrame:
    """Commands with their code, and whether they change something, if ``writes`` is what commands before them write."""
    roles = _roles_before(asked, writes, state)
    own, theirs, role, kind = F.col("own"), F.col("theirs"), F.col("role"), F.col("kind")
    losing = (theirs == OWNER) & ~((kind == "set_role") & (role == OWNER))
    known = F.coalesce(role.isin(*ROLE_NAMES), F.lit(False))
    moved = (
        F.when(kind == "accept", "resource.not_found").when(own.isNull(), "resource.not_found").when(kind == "leave", "ok")
        .when(kind == "set_role", F.when(own < OWNER, "access.forbidden").when(~known, "request.validation_failed").when(theirs.isNull(), "resource.not_found").otherwise("ok"))
        .when(own < ADMIN, "access.forbidden")
        .when(kind == "remove", F.when(theirs.isNull(), "resource.not_found").when((own == ADMIN) & (theirs >= ADMIN) & (F.col("target_id") != F.col("actor_id")), "access.forbidden").otherwise("ok"))
        .when(kind == "revoke", "resource.not_found").otherwise("request.validation_failed")
    )
    rows = roles.withColumn("code", moved)
    ok = F.col("code") == "ok"
    changes = ok & ~((kind == "set_role") & F.coalesce(theirs == role, F.lit(False)))
    step = F.when(changes & losing, -1).when(changes & (kind == "set_role") & (role == OWNER), 1).otherwise(0)
    rows = rows.withColumns({"changes": changes, "step": step})
    counts = _owners_before(rows.where("step <> 0").select("tenant_id", "part", "nth", "step"), owners)
    rows = rows.join(counts, ["tenant_id", "part", "nth"], "left")
    refused = F.coalesce((F.col("step") < 0) & (F.col("count") <= 1), F.lit(False))
    return rows.select(*asked.columns, F.when(refused, "tenant.last_owner").otherwise(F.col("code")).alias("code"), (F.col("changes") & ~refused).alias("changes"))


def _roles_before(asked: DataFrame, writes: DataFrame, state: DataFrame) -> DataFrame:
    """Commands with the roles of actor (own) and target (theirs) just before them."""
    reads = asked.select("tenant_id", "part", "nth", F.explode(F.array(F.struct(F.col("actor_id").alias("user_id"), F.lit(True).alias("acts")), F.struct(F.col("target_id").alias("user_id"), F.lit(False).alias("acts")))).alias("x"))
    points = reads.select("tenant_id", "x.user_id", "part", "nth", "x.acts", F.lit(None).cast(writes.schema["written"].dataType).alias("written"))
    points = points.unionByName(writes.withColumn("acts", F.lit(None).cast("boolean")))
    key = ["tenant_id", "user_id"]
    wrote = F.col("written").isNotNull()
    ranges = points.groupBy(*key, "part").agg(F.max_by(F.when(wrote, F.col("written")), F.when(wrote, F.col("nth"))).alias("written"))
    carried = F.last("written", ignorenulls=True).over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = ranges.select(*key, "part", carried.alias("carried")).join(state.withColumnRenamed("role", "first"), key, "left")
    # a command reads before it writes
    earlier = Window.partitionBy(*key, "part").orderBy("nth", wrote).rowsBetween(Window.unboundedPreceding, 0)
    seen = points.withColumn("here", F.last("written", ignorenulls=True).over(earlier)).where("acts IS NOT NULL").join(start, [*key, "part"])
    found = F.coalesce("here", "carried", F.struct(F.col("first").alias("role")))["role"]
    # a null actor or target matches no key and has no role
    per = seen.groupBy("tenant_id", "part", "nth").agg(F.max(F.when(F.col("acts"), found)).alias("own"), F.max(F.when(~F.col("acts"), found)).alias("theirs"))
    return asked.join(per, ["tenant_id", "part", "nth"], "left")


def _owners_before(steps: DataFrame, owners: DataFrame) -> DataFrame:
    """The number of owners (count) before each step: +1, or -1 unless one is left.

    After steps with sums ``s1, s2, ...`` there are ``s + max(n, 1 - sj for every step down)`` owners, if there were ``n`` at first.
    """
    own = Window.partitionBy("tenant_id", "part").orderBy("nth")
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.withColumn("sum", F.sum("step").over(upto)).withColumn("least", F.when(F.col("step") < 0, 1 - F.col("sum")))
    rows = rows.select("tenant_id", "part", "nth", "step", "sum", F.max("least").over(before).alias("most"), "least")
    earlier = Window.partitionBy("tenant_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("tenant_id", "part").agg(F.sum("step").alias("total"), F.max("least").alias("peak")).withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    ranges = ranges.withColumn("top", F.max(F.col("peak") - F.col("base")).over(earlier)).join(owners, "tenant_id", "left").select("tenant_id", "part", "base", "top", F.coalesce("owners", F.lit(0)).alias("owners"))
    at_least = F.greatest("owners", "top", F.col("most") - F.col("base"))  # nulls are passed over
    return rows.join(ranges, ["tenant_id", "part"]).select("tenant_id", "part", "nth", (F.col("base") + F.col("sum") - F.col("step") + at_least).alias("count"))
