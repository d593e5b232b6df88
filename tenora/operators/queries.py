"""Reads over the tenancy tables: scoped filters, joins, counts and listings.

Tables come in as DataFrames and are joined on their keys. Counts per tenant are aggregated once before a join. Nothing is
collected, and every listing's order ends in an id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenora.functions.columns import CODE_OF_INVITATION, chosen, invitation_status, is_open, normal_email, role_name, token_hash
from tenora.sources.schemas import ADMIN, MEMBER, OWNER


def scoped(rows: DataFrame, tenant_id: int | None) -> DataFrame:
    """Rows of one tenant; none at all while no tenant is established."""
    return rows.where(F.col("tenant_id") == tenant_id) if tenant_id is not None else rows.where(F.lit(False))


def unscoped(rows: DataFrame) -> DataFrame:
    """Rows of all tenants, said so on purpose: for jobs over the whole estate and for joining by token."""
    return rows


def member_counts(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("tenant_id").agg(F.count("*").alias("member_count"))


def owner_counts(tenants: DataFrame, memberships: DataFrame) -> DataFrame:
    """Owners of every tenant, 0 where there is none."""
    counts = memberships.groupBy("tenant_id").agg(F.count_if(F.col("role") == OWNER).alias("owner_count"))
    return tenants.select(F.col("id").alias("tenant_id")).join(counts, "tenant_id", "left").select("tenant_id", F.coalesce("owner_count", F.lit(0)).cast("long").alias("owner_count"))


def member_directory(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Members with their profile: highest role first, then oldest, then by user."""
    u = users.select(F.col("id").alias("user_id"), "email", "display_name")
    rows = memberships.join(u, "user_id").select("tenant_id", "user_id", "email", "display_name", "role", F.col("created_at").alias("joined_at"))
    return rows.orderBy("tenant_id", F.col("role").desc(), "joined_at", "user_id").withColumn("role", role_name(F.col("role")))


def tenant_summary(memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """Every membership's tenant, with the member's role and the number of members. Tenants and counts, one row each, are hashed: members need not be sorted."""
    t = tenants.select(F.col("id").alias("tenant_id"), "name", "slug")
    rows = memberships.select("tenant_id", "user_id", role_name(F.col("role")).alias("role"), "created_at", F.col("id").alias("membership_id"))
    return rows.join(t.hint("shuffle_hash"), "tenant_id").join(member_counts(memberships).hint("shuffle_hash"), "tenant_id")


def user_organizations(memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """Each user's organizations, oldest membership first (``position`` from 1)."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "membership_id"))
    return tenant_summary(memberships, tenants).select("user_id", nth.alias("position"), "tenant_id", "name", "slug", "role", "member_count")


def default_organization(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """Each user's first organization by membership, null for none. An aggregate: users need not be sorted."""
    first = memberships.groupBy("user_id").agg(F.min(F.struct("created_at", "id", "tenant_id")).alias("first"))
    return users.select(F.col("id").alias("user_id")).join(first, "user_id", "left").select("user_id", F.col("first.tenant_id").alias("tenant_id"))


def user_profiles(users: DataFrame, memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """Users with their organizations nested, an empty list for none."""
    one = F.struct("position", "tenant_id", "name", "slug", "role", "member_count")
    lists = user_organizations(memberships, tenants).groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("organizations"))
    u = users.select(F.col("id").alias("user_id"), "email", "email_verified", "display_name")
    joined = u.join(lists, "user_id", "left")
    return joined.withColumn("organizations", F.coalesce("organizations", F.array().cast(lists.schema["organizations"].dataType)))


def to_api_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object for each row; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(column))


def open_invitations(invitations: DataFrame, as_of: Column) -> DataFrame:
    rows = unscoped(invitations).where(is_open(as_of))
    return rows.select("tenant_id", "id", "email", role_name(F.col("role")).alias("role"), "expires_at", "created_at").orderBy("tenant_id", "created_at", "id")


def invitation_report(invitations: DataFrame, as_of: Column) -> DataFrame:
    rows = unscoped(invitations)
    return rows.select("id", "tenant_id", F.lower(F.hex("token_hash")).alias("token_hash"), role_name(F.col("role")).alias("role"), F.date_trunc("microsecond", "created_at").cast("timestamp_ntz").alias("created_at"), "expires_at", invitation_status(as_of).alias("status"))


def preview_invitations(tokens: DataFrame, invitations: DataFrame, tenants: DataFrame, as_of: Column) -> DataFrame:
    """What each token (column token) shows, or the code with which it is refused."""
    i = unscoped(invitations).withColumn("status", invitation_status(as_of)).select("token_hash", "tenant_id", "email", "role", "expires_at", "status")
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"))
    found = tokens.withColumn("token_hash", token_hash(F.col("token"))).join(i.join(t, "tenant_id"), "token_hash", "left")
    code = F.when(F.col("tenant_id").isNull(), "resource.not_found").otherwise(chosen(F.col("status"), CODE_OF_INVITATION))
    shown = lambda c: F.when(code.isNull(), c)
    return found.select("token", code.cast("string").alias("error_code"), shown(F.col("tenant_name")).alias("tenant_name"), shown(F.col("email")).alias("email"), shown(role_name(F.col("role"))).alias("role"), shown(F.col("expires_at")).alias("expires_at"))


def resolve_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (event_id, firebase_uid) with the caller's id, or the code for one that is not provisioned. Two users of one uid are a fault."""
    u = at_most_one(users.select("firebase_uid", F.col("id").alias("user_id")), "firebase_uid")
    return requests.join(u, "firebase_uid", "left").select("event_id", "user_id", F.when(F.col("user_id").isNull(), "user.not_provisioned").alias("error_code"))


def authorize(role: Column, required: Column) -> Column:
    """The code of a refusal: strangers learn nothing of the tenant, members that their role is too low; null if allowed."""
    return F.when(role.isNull(), "resource.not_found").when(role < required, "access.forbidden")


def access_check(requests: DataFrame, users: DataFrame, memberships: DataFrame) -> DataFrame:
    """Requests (event_id, firebase_uid, tenant_id, required) with the caller's role and the outcome. Two users of one uid are a fault."""
    u = at_most_one(users.select("firebase_uid", F.col("id").alias("user_id")), "firebase_uid")
    m = memberships.select("tenant_id", "user_id", "role")
    rows = requests.join(u, "firebase_uid", "left").join(m, ["tenant_id", "user_id"], "left")
    return rows.select("event_id", "tenant_id", "user_id", role_name(F.col("role")).alias("role"), F.coalesce(authorize(F.col("role"), F.col("required")), F.lit("ok")).alias("outcome"))


def removal_rights(memberships: DataFrame) -> DataFrame:
    """How many members each member may remove, from three counts per tenant instead of all pairs.

    Owners may remove anyone but the last owner, admins members and themselves, members none.
    """
    count = lambda r: F.count_if(F.col("role") == r)
    per = memberships.groupBy("tenant_id").agg(count(MEMBER).alias("members"), count(ADMIN).alias("admins"), count(OWNER).alias("owners"))
    every = F.col("members") + F.col("admins") + F.when(F.col("owners") > 1, F.col("owners")).otherwise(0)
    allowed = F.when(F.col("role") >= OWNER, every).when(F.col("role") >= ADMIN, F.col("members") + 1).otherwise(0)
    return memberships.join(per, "tenant_id").select("tenant_id", F.col("user_id").alias("actor_id"), allowed.cast("long").alias("removable"))


def normalized_users(raw: DataFrame) -> DataFrame:
    """Users (user_id, claims as JSON text) as they are stored."""
    from tenora.functions.columns import parse_claims

    c = raw.select("user_id", parse_claims(F.col("claims")).alias("c"))
    return c.select("user_id", F.col("c.uid").alias("firebase_uid"), normal_email(F.col("c.email")).alias("email"), F.col("c.email_verified").alias("email_verified"), F.col("c.name").alias("display_name"))


def taken_slugs(probes: DataFrame, tenants: DataFrame) -> DataFrame:
    """For each wanted slug (column base), the slugs that equal it or continue it after a hyphen.

    Each taken slug is joined by everything that a hyphen in it could follow, which makes an equi-join of the prefix probe.
    """
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split("slug", "-"))), lambda n: F.call_function("substring_index", F.col("slug"), F.lit("-"), n))
    have = tenants.where("slug IS NOT NULL").select("slug", F.explode(heads).alias("base"))
    return probes.join(have, "base").select("base", "slug")


def onboarding_progress(tenants: DataFrame, users: DataFrame, memberships: DataFrame, invitations: DataFrame, as_of: Column) -> DataFrame:
    """Steps done of three per tenant: created, creator's address verified, somebody invited."""
    invited = unscoped(invitations).where(is_open(as_of)).groupBy("tenant_id").agg(F.count("*").alias("open"))
    u = users.select(F.col("id").alias("created_by_user_id"), "email_verified")
    rows = tenants.select(F.col("id").alias("tenant_id"), "created_by_user_id").join(u, "created_by_user_id", "left").join(member_counts(memberships), "tenant_id", "left").join(invited, "tenant_id", "left")
    verified = F.coalesce("email_verified", F.lit(False))
    invite = (F.coalesce("open", F.lit(0)) > 0) | (F.coalesce("member_count", F.lit(0)) > 1)
    done = F.lit(1) + verified.cast("int") + invite.cast("int")
    return rows.select("tenant_id", verified.alias("verify_done"), invite.alias("invite_done"), done.alias("done"), F.lit(3).alias("total"))


def request_outcomes(requests: DataFrame) -> DataFrame:
    """Requests (message_type, outcome: ok, failed, crashed or cancelled, error_code) by type and level. Cancelled ones aren't logged."""
    level = chosen(F.col("outcome"), {"ok": "Information", "failed": "Warning"}, F.lit("Error"))
    rows = requests.where(F.col("outcome") != "cancelled").withColumn("level", level)
    bad = F.count_if(F.col("level") == "Error")
    return rows.groupBy("message_type").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "Warning").alias("n_warning"), bad.alias("n_error"), F.round(bad / F.count("*"), 6).alias("error_rate"))


def request_classification(requests: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Requests (event_id, subject, address, path, status, failed, ts) with caller, default code, level and retry time."""
    from tenora.functions.columns import caller_key, default_code, log_level, retry_after

    return requests.select(
        "event_id", caller_key(F.col("subject"), F.col("address")).alias("caller"), default_code(F.col("status")).cast("string").alias("error_code"),
        log_level(F.col("status"), F.col("failed"), F.col("path")).alias("level"), retry_after(F.col("ts"), window_seconds).alias("retry_after"),
    )


def rate_limit(requests: DataFrame, permit: Column, seconds: int) -> DataFrame:
    """Requests (event_id, caller, policy, ts) with whether their fixed window still admits them.

    Windows start at multiples of ``seconds`` since the epoch. The n-th of its caller, policy and window, by time and
    id, is admitted if n is at most ``permit``.
    """
    from tenora.functions.columns import retry_after

    begin = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    nth = F.row_number().over(Window.partitionBy("caller", "policy", begin).orderBy("ts", "event_id"))
    rows = requests.withColumn("admitted", nth <= permit)
    refused = ~F.col("admitted")
    return rows.select(
        "event_id", "caller", "policy", "admitted", F.when(refused, 429).alias("status"), F.when(refused, "quota.rate_limited").alias("error_code"), F.when(refused, retry_after(F.col("ts"), seconds)).alias("retry_after")
    )


def requests_per_window(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests per caller, policy and fixed window (window_start, from the epoch)."""
    begin = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    return requests.groupBy(begin.alias("window_start"), "caller", "policy").agg(F.count("*").alias("n"))


def validation_report(messages: DataFrame) -> DataFrame:
    """One row for each distinct (command_id, field, message) that a command's name, email or role fails on."""
    from tenora.functions.columns import email_shape, stripped
    from tenora.sources.schemas import ROLE_NAMES

    name, email, role = F.col("name"), F.col("email"), F.col("role")
    blank = lambda x: F.coalesce(stripped(x) == "", F.lit(True))
    rules = [
        ("Name", "must not be empty", blank(name)), ("Name", "must be at most 100 characters", F.char_length(name) > 100),
        ("Email", "must not be empty", blank(email)), ("Email", "must be at most 320 characters", F.char_length(email) > 320), ("Email", "is not an address", ~blank(email) & ~email_shape(email)),
        ("Role", "is not a role", role.isNull() | ~role.isin(*ROLE_NAMES)),
    ]
    failed = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, m, rule in rules]))
    return messages.select("command_id", F.explode(failed).alias("x")).select("command_id", "x.field", "x.message").distinct()


def validation_maps(report: DataFrame) -> DataFrame:
    """The report with one map from field to messages for each command."""
    fields = report.groupBy("command_id", "field").agg(F.array_sort(F.collect_list("message")).alias("messages"))
    return fields.groupBy("command_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "messages")))).alias("errors"))


def at_most_one(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, one for each value of ``keys`` at most: a second one is a fault that ends the query. Rows with a null key pass.

    For lookups by what must be unique, where a second row would multiply what is joined to it.
    """
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    second = whole & (F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) > 1)
    fault = F.raise_error(F.concat_ws(" ", F.lit(f"more than one row for {', '.join(keys)}:"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
    return rows.withColumn("_second", second).where(F.when(F.col("_second"), fault).otherwise(F.lit(True))).drop("_second")
