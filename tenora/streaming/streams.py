"""Structured Streaming forms of the jobs: request limits, sign-ins, membership commands, error rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tenora.operators.jobs import upsert_users
from tenora.operators.replay import Invite, TenantState, number


def windowed_requests(requests: DataFrame, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Requests per caller, policy and fixed window, emitted once the watermark passes the window."""
    w = F.window("ts", f"{seconds} seconds")
    return requests.withWatermark("ts", lateness).groupBy(w, "caller", "policy").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "caller", "policy", "n")


def error_rates(log: DataFrame, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Requests and errors (status 500 or more) per fixed window of the request log."""
    rows = log.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("n_error")).select(F.col("window.start").alias("window_start"), "n", "n_error")


class _Limiter(StatefulProcessor):
    """Counts a caller's requests in its current window. Rows of a batch are taken in order of (ts, event_id)."""

    def __init__(self, permits: dict[str, int], seconds: int):
        self.permits, self.seconds = permits, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "begin long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        caller, policy = key
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for row in batch.itertuples(index=False):
            micros = int(row.ts.value // 1000)
            width = self.seconds * 1_000_000
            begin = micros // width
            n = (self.seen.getValue((begin,))[0] if self.seen.containsKey((begin,)) else 0) + 1
            self.seen.updateValue((begin,), (n,))
            admitted = policy not in self.permits or n <= self.permits[policy]
            out.append((row.event_id, caller, policy, admitted, None if admitted else -(-((begin + 1) * width - micros) // 1_000_000)))
        # windows long before the newest are over
        newest = max(k[0] for k in self.seen.keys())
        for (old,) in [k for k in self.seen.keys() if k[0] < newest - 60]:
            self.seen.removeKey((old,))
        frame = pd.DataFrame(out, columns=["event_id", "caller", "policy", "admitted", "retry_after"])
        yield frame.astype({"retry_after": "Int64"})

    def close(self) -> None:
        pass


def limited_requests(requests: DataFrame, permits: dict[str, int], seconds: int = 60) -> DataFrame:
    """A verdict for every request of a stream: event_id, caller, policy, admitted, retry_after. Needs the RocksDB state store.

    Requests of a policy without a number of permits are all admitted. A caller's windows are kept until its requests are 60 windows
    further; requests later than that are counted from one again.
    """
    return requests.groupBy("caller", "policy").transformWithStateInPandas(
        statefulProcessor=_Limiter(permits, seconds), outputStructType="event_id long, caller string, policy string, admitted boolean, retry_after long", outputMode="Append", timeMode="None"
    )


class _Settled(StatefulProcessor):
    """Requests of a caller wait for their window's end; a timer then judges them in order of (ts, event_id)."""

    def __init__(self, permits: dict[str, int], seconds: int):
        self.permits, self.width = permits, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "begin long, micros long, event_id long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        begins = set()
        for batch in rows:
            for row in batch.itertuples(index=False):
                micros = int(row.ts.value // 1000)
                at = (micros // self.width, micros, int(row.event_id))
                self.waiting.updateValue(at, ((self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else 0) + 1,))
                begins.add(at[0])
        for begin in begins:
            self.handle.registerTimer((begin + 1) * self.width // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        caller, policy = key
        begin = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.width - 1
        out, nth = [], 0
        for at in sorted(k for k in self.waiting.keys() if k[0] == begin):
            for _ in range(self.waiting.getValue(at)[0]):
                nth += 1
                admitted = policy not in self.permits or nth <= self.permits[policy]
                out.append((at[2], caller, policy, admitted, None if admitted else -(-((begin + 1) * self.width - at[1]) // 1_000_000)))
            self.waiting.removeKey(at)
        yield pd.DataFrame(out, columns=["event_id", "caller", "policy", "admitted", "retry_after"]).astype({"retry_after": "Int64"})

    def close(self) -> None:
        pass


def settled_limits(requests: DataFrame, permits: dict[str, int], seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """The verdicts of ``rate_limit`` from a stream in any order of arrival: event_id, caller, policy, admitted, retry_after.

    A window's requests are judged together once the watermark has passed its end, by time and not by arrival; then its state goes. A request
    that comes later than ``lateness`` after the newest one of the stream has no verdict, as its window may be settled; the stream's
    progress counts these (numRowsDroppedByWatermark). Needs the RocksDB state store.
    """
    return requests.withWatermark("ts", lateness).groupBy("caller", "policy").transformWithStateInPandas(
        statefulProcessor=_Settled(permits, seconds), outputStructType="event_id long, caller string, policy string, admitted boolean, retry_after long", outputMode="Append", timeMode="EventTime"
    )


class _Kept(MutableMapping):
    """A map state as a dictionary of the batch: reads what is asked for once, writes what was changed at the end."""

    def __init__(self, state, load: Callable[[tuple], object], dump: Callable[[object], tuple]):
        self.state, self.load, self.dump = state, load, dump
        self.seen: dict = {}
        self.changed: set = set()

    def _value(self, key):
        if key not in self.seen:
            self.seen[key] = self.load(self.state.getValue((key,))) if key is not None and self.state.containsKey((key,)) else None
        return self.seen[key]

    def __getitem__(self, key):
        value = self._value(key)
        if value is None:
            raise KeyError(key)
        return value

    def __setitem__(self, key, value) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def __delitem__(self, key) -> None:
        self[key]
        self[key] = None

    def __iter__(self):
        raise TypeError("kept state is not listed")

    def __len__(self) -> int:
        raise TypeError("kept state is not counted")

    def write(self) -> None:
        for key in self.changed:
            if self.seen[key] is None:
                self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), self.dump(self.seen[key]))


class _Members(StatefulProcessor):
    """A tenant's members and invitations, each an entry of its own, between batches of commands."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.roles = handle.getMapState("roles", "user long", "role int")
        self.invites = handle.getMapState("invites", "invitation long", "email string, role int, micros long, accepted boolean, revoked boolean")
        self.open = handle.getMapState("open", "email string", "n int")
        self.owners = handle.getValueState("owners", "n long")

    def _tenant(self) -> TenantState:
        one = lambda v: v[0]
        single = lambda v: (v,)
        load = lambda v: Invite(v[0], v[1], pd.Timestamp(v[2], unit="us"), v[3], v[4])
        dump = lambda i: (i.email, i.role, int(i.expires_at.value // 1000), i.accepted, i.revoked)
        n = self.owners.get()[0] if self.owners.exists() else 0
        return TenantState(_Kept(self.roles, one, single), _Kept(self.invites, load, dump), _Kept(self.open, one, single), n)

    def _write(self, tenant: TenantState) -> None:
        for kept in (tenant.roles, tenant.invites, tenant.open):
            kept.write()
        self.owners.update((tenant.owners,))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        tenant = self._tenant()
        for row in initialState.itertuples(index=False):
            if number(row.invitation_id) is not None:
                tenant.invite(number(row.invitation_id), Invite(row.email, number(row.role), row.expires_at, bool(row.accepted), bool(row.revoked)))
            elif number(row.user_id) is not None:
                tenant.put(number(row.user_id), number(row.role))
        self._write(tenant)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tenant = self._tenant()
        batch = pd.concat(list(rows)).sort_values(["ts", "command_id"])
        out = []
        for row in batch.itertuples(index=False):
            invitation, email = number(getattr(row, "invitation_id", None)), getattr(row, "email", None)
            if row.kind == "seed":  # an open invitation or a member that is already there
                if invitation is not None:
                    tenant.invite(invitation, Invite(email, number(row.role), row.ts + pd.Timedelta(days=7)))
                else:
                    tenant.put(number(row.target_id), number(row.role))
                continue
            out.append((key[0], row.command_id, tenant.apply(row.kind, number(row.actor_id), number(row.target_id), number(row.role), invitation, email, row.ts)))
        self._write(tenant)
        yield pd.DataFrame(out, columns=["tenant_id", "command_id", "outcome"])

    def close(self) -> None:
        pass


def first_state(memberships: DataFrame, invitations: DataFrame | None = None) -> DataFrame:
    """The batch tables as the first state of :func:`membership_stream`: one row for each member and each invitation."""
    none = lambda kind: F.lit(None).cast(kind)
    empty = {"user_id": "long", "invitation_id": "long", "email": "string", "expires_at": "timestamp_ntz", "accepted": "boolean", "revoked": "boolean"}
    columns = ["tenant_id", "user_id", "role", *list(empty)[1:]]
    rows = memberships.select("tenant_id", F.col("user_id").cast("long").alias("user_id"), F.col("role").cast("int").alias("role")).withColumns({c: none(k) for c, k in empty.items() if c != "user_id"}).select(*columns)
    if invitations is None:
        return rows
    given = invitations.select("tenant_id", none("long").alias("user_id"), F.col("role").cast("int").alias("role"), F.col("id").alias("invitation_id"), "email", "expires_at", F.col("accepted_at").isNotNull().alias("accepted"), F.col("revoked_at").isNotNull().alias("revoked"))
    return rows.unionByName(given)


def membership_stream(commands: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Outcomes of a stream of commands (tenant_id, command_id, actor_id, target_id, ts, kind, role, and invitation_id and email where invitations occur).

    ``initial`` (:func:`first_state`) is put into the state when the stream starts for the first time. Members, invitations and open addresses are
    entries of their own, so a batch reads and writes those its commands touch. ``seed`` rows in the stream add a member, or an open
    invitation with the time of its issue. Needs the RocksDB state store.
    """
    grouped = initial.groupBy("tenant_id") if initial is not None else None
    return commands.groupBy("tenant_id").transformWithStateInPandas(
        statefulProcessor=_Members(), outputStructType="tenant_id long, command_id long, outcome string", outputMode="Append", timeMode="None", initialState=grouped
    )


def sign_in_stream(sign_ins: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], as_of: Column, new_id: Column | None = None):
    """Keep users up to date from a stream of sign-ins: ``load`` reads the users, ``store(users, batch_id)`` replaces them.

    The batch id names the write, so a batch that is delivered again gives the same users. For tables in buckets, where a batch
    rewrites what it touches and is written once, see ``sources.snapshots.store_sign_ins``. ``new_id`` gives new users' ids.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        users = upsert_users(load(), rows, as_of, new_id)
        store(users.drop("inserted", "profile_changed"), batch_id)

    return sign_ins.writeStream.foreachBatch(batch)
