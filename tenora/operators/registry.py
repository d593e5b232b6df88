"""The tenancy queries over the test tables, and the same questions as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.functions.columns import chosen
from tenora.functions.slugs import plain_slug
from tenora.operators import audits, jobs, postings, queries, replay, retrieval
from tenora.plans.staging import new_path
from tenora.sources.fixtures import CTES, Fixture, as_of

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Fixture], DataFrame]], Query]:
    """Register a query over the derived tables under the function's name; ``sql`` continues the shared CTEs."""

    def add(build: Callable[[Fixture], DataFrame]) -> Query:
        name = build.__name__
        _QUERIES[name] = lambda spark, sf_dir: build(Fixture(spark, sf_dir))
        if sql:
            _SQL[name] = CTES + sql
        return _QUERIES[name]

    return add


ROLE = "CASE role WHEN 10 THEN 'Member' WHEN 20 THEN 'Admin' WHEN 30 THEN 'Owner' END"
COUNTS = ", counts AS (SELECT tenant_id, count(*) AS member_count FROM memberships GROUP BY 1)"


@query(f"SELECT m.tenant_id, m.user_id, u.email, u.display_name, {ROLE} AS role, m.created_at AS joined_at FROM memberships m JOIN users u ON u.id = m.user_id")
def member_directory(x: Fixture) -> DataFrame:
    return queries.member_directory(x.memberships, x.users)


@query("SELECT tenant_id, count(*) AS member_count FROM memberships GROUP BY 1")
def member_counts(x: Fixture) -> DataFrame:
    return queries.member_counts(x.memberships)


@query("SELECT t.id AS tenant_id, count(*) FILTER (m.role = 30) AS owner_count FROM tenants t LEFT JOIN memberships m ON m.tenant_id = t.id GROUP BY 1")
def owner_counts(x: Fixture) -> DataFrame:
    return queries.owner_counts(x.tenants, x.memberships)


@query(COUNTS + f" SELECT m.tenant_id, m.user_id, {ROLE} AS role, t.name, t.slug, c.member_count FROM memberships m JOIN tenants t ON t.id = m.tenant_id JOIN counts c ON c.tenant_id = m.tenant_id")
def tenant_summary(x: Fixture) -> DataFrame:
    return queries.tenant_summary(x.memberships, x.tenants).select("tenant_id", "user_id", "role", "name", "slug", "member_count")


@query(COUNTS + f" SELECT m.user_id, CAST(row_number() OVER (PARTITION BY m.user_id ORDER BY m.created_at, m.id) AS INTEGER) AS position, m.tenant_id, t.name, t.slug, {ROLE} AS role, c.member_count FROM memberships m JOIN tenants t ON t.id = m.tenant_id JOIN counts c ON c.tenant_id = m.tenant_id")
def user_organizations(x: Fixture) -> DataFrame:
    return queries.user_organizations(x.memberships, x.tenants)


@query("SELECT u.id AS user_id, m.tenant_id FROM users u LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM memberships) m ON m.user_id = u.id AND m.n = 1")
def default_organization(x: Fixture) -> DataFrame:
    return queries.default_organization(x.users, x.memberships)


@query()
def user_profiles(x: Fixture) -> DataFrame:
    return queries.user_profiles(x.users, x.memberships, x.tenants)


@query(COUNTS + f""" SELECT u.id AS user_id, u.email, u.email_verified, u.display_name, CAST(count(m.id) OVER (PARTITION BY u.id) AS INTEGER) AS n_organizations,
  CAST(CASE WHEN m.id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY u.id ORDER BY m.created_at, m.id) END AS INTEGER) AS position, m.tenant_id, t.name, t.slug, {ROLE} AS role, c.member_count
FROM users u LEFT JOIN memberships m ON m.user_id = u.id LEFT JOIN tenants t ON t.id = m.tenant_id LEFT JOIN counts c ON c.tenant_id = m.tenant_id""")
def user_profile_rows(x: Fixture) -> DataFrame:
    """The nested profiles, one row for each organization; users without one keep a row."""
    p = queries.user_profiles(x.users, x.memberships, x.tenants)
    rows = p.select("user_id", "email", "email_verified", "display_name", F.size("organizations").alias("n_organizations"), F.explode_outer("organizations").alias("o"))
    return rows.select("user_id", "email", "email_verified", "display_name", "n_organizations", F.coalesce("o.position", F.lit(0)).alias("position"), "o.tenant_id", "o.name", "o.slug", "o.role", "o.member_count")


@query(f"SELECT tenant_id, id, email, {ROLE} AS role, expires_at, created_at FROM invitations, params WHERE accepted_at IS NULL AND revoked_at IS NULL AND expires_at > as_of")
def open_invitations(x: Fixture) -> DataFrame:
    return queries.open_invitations(x.invitations, as_of())


STATUS = "CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN accepted_at IS NOT NULL THEN 'accepted' WHEN expires_at <= {at} THEN 'expired' ELSE 'pending' END"
CODE = "CASE WHEN revoked_at IS NOT NULL THEN 'invitation.revoked' WHEN accepted_at IS NOT NULL THEN 'invitation.already_accepted' WHEN expires_at <= {at} THEN 'invitation.expired' END"


@query(f"SELECT id, tenant_id, token_hash, {ROLE} AS role, created_at, expires_at, {STATUS.format(at='as_of')} AS status FROM invitations, params")
def invitation_report(x: Fixture) -> DataFrame:
    return queries.invitation_report(x.invitations, as_of())


@query(f""", tokens AS (SELECT 'tok-' || o_orderkey AS token FROM orders), found AS (
  SELECT token, CASE WHEN i.id IS NULL THEN 'resource.not_found' ELSE {CODE.format(at='as_of')} END AS error_code, t.name, i.email, i.role, i.expires_at
  FROM params, tokens LEFT JOIN (SELECT i.* FROM invitations i JOIN tenants t ON t.id = i.tenant_id) i ON i.token_hash = sha256(token) LEFT JOIN tenants t ON t.id = i.tenant_id)
SELECT token, error_code, CASE WHEN error_code IS NULL THEN name END AS tenant_name, CASE WHEN error_code IS NULL THEN email END AS email, CASE WHEN error_code IS NULL THEN {ROLE} END AS role, CASE WHEN error_code IS NULL THEN expires_at END AS expires_at FROM found""")
def preview_invitations(x: Fixture) -> DataFrame:
    tokens = x.table("orders").select(F.concat(F.lit("tok-"), F.col("o_orderkey")).alias("token"))
    return queries.preview_invitations(tokens, x.invitations, x.tenants, as_of())


# callers of one event in eight are unknown
_UID = "'uid-' || CASE WHEN event_id % 8 = 0 THEN -1 - user_id ELSE user_id END"


def _callers(x: Fixture) -> DataFrame:
    uid = F.concat(F.lit("uid-"), F.when(F.col("event_id") % 8 == 0, -1 - F.col("user_id")).otherwise(F.col("user_id")))
    return x.table("events").select("event_id", uid.alias("firebase_uid"), (F.col("event_id") % 10).alias("tenant_id"), ((F.col("event_id") % 3 + 1) * 10).alias("required"))


@query(f"SELECT event_id, u.id AS user_id, CASE WHEN u.id IS NULL THEN 'user.not_provisioned' END AS error_code FROM events LEFT JOIN users u ON u.firebase_uid = {_UID}")
def resolve_users(x: Fixture) -> DataFrame:
    return queries.resolve_users(_callers(x), x.users)


@query(f"""SELECT event_id, event_id % 10 AS tenant_id, u.id AS user_id, {ROLE} AS role, CASE WHEN role IS NULL THEN 'resource.not_found' WHEN role < (event_id % 3 + 1) * 10 THEN 'access.forbidden' ELSE 'ok' END AS outcome
FROM events LEFT JOIN users u ON u.firebase_uid = {_UID} LEFT JOIN memberships m ON m.user_id = u.id AND m.tenant_id = event_id % 10""")
def access_check(x: Fixture) -> DataFrame:
    return queries.access_check(_callers(x), x.users, x.memberships)


@query("""SELECT a.tenant_id, a.user_id AS actor_id, CAST(CASE WHEN role >= 30 THEN members + admins + CASE WHEN owners > 1 THEN owners ELSE 0 END WHEN role >= 20 THEN members + 1 ELSE 0 END AS BIGINT) AS removable
FROM memberships a JOIN (SELECT tenant_id, count(*) FILTER (role = 10) AS members, count(*) FILTER (role = 20) AS admins, count(*) FILTER (role = 30) AS owners FROM memberships GROUP BY 1) c USING (tenant_id)""")
def removal_rights(x: Fixture) -> DataFrame:
    return queries.removal_rights(x.memberships)


@query("""SELECT id AS user_id, firebase_uid, email, id % 3 = 0 AS email_verified, display_name FROM users""")
def normalized_users(x: Fixture) -> DataFrame:
    flag = F.when(F.col("id") % 3 == 0, F.lit(" True")).when(F.col("id") % 3 == 1, F.lit("1"))
    claims = F.to_json(F.struct(F.concat(F.lit(" "), F.col("firebase_uid")).alias("sub"), F.concat(F.lit("  "), F.upper("email"), F.lit("\t ")).alias("email"), flag.alias("email_verified"), F.coalesce(F.concat("display_name", F.lit("  ")), F.lit("   ")).alias("name")))
    return queries.normalized_users(x.users.select(F.col("id").alias("user_id"), claims.alias("claims")))


@query("SELECT id, name, slug FROM tenants")
def tenant_slugs(x: Fixture) -> DataFrame:
    """All tenants' names created again, in order of id, with nothing taken."""
    t = x.tenants.select("id", "name")
    commands = t.select(F.col("id").alias("command_id"), F.lit("uid").alias("firebase_uid"), "name", F.lit("2000-01-01").cast("timestamp_ntz").alias("ts"))
    caller = x.spark.createDataFrame([("uid", 1, True)], "firebase_uid string, id long, email_verified boolean")
    return jobs.create_tenants(commands, caller, x.tenants.limit(0)).select(F.col("command_id").alias("id"), "name", "slug")


@query("SELECT DISTINCT base, slug FROM bases JOIN tenants ON slug = base OR starts_with(slug, base || '-')")
def taken_slugs(x: Fixture) -> DataFrame:
    return queries.taken_slugs(x.tenants.select(plain_slug(F.col("name")).alias("base")).distinct(), x.tenants)


_ISSUES = """, issues AS (
  SELECT o_orderkey AS command_id, tenant_id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 100000000 WHEN o_orderkey % 2 = 0 THEN owner_id ELSE o_custkey END AS actor_id,
    CASE WHEN o_orderkey % 11 = 0 THEN 'nobody' WHEN o_orderkey % 3 = 0 THEN 'invitee' || o_custkey || '@example.com' WHEN o_orderkey % 3 = 1 THEN 'user' || o_custkey || '@example.com' ELSE 'guest' || o_orderkey % 400 || '@example.com' END AS email,
    CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 20 WHEN '3-MEDIUM' THEN 15 ELSE 10 END AS role, o_orderdate AS ts
  FROM order_tenants JOIN owners USING (tenant_id)), judged AS (
  SELECT c.*, CASE WHEN a.role IS NULL THEN 'resource.not_found' WHEN a.role < 20 THEN 'access.forbidden' WHEN c.email = 'nobody' OR c.role = 15 THEN 'request.validation_failed'
    WHEN a.role < 30 AND c.role >= 30 THEN 'access.forbidden' WHEN b.email IS NOT NULL THEN 'membership.already_exists' WHEN p.email IS NOT NULL THEN 'invitation.already_pending' END AS code
  FROM issues c LEFT JOIN memberships a ON a.tenant_id = c.tenant_id AND a.user_id = c.actor_id
  LEFT JOIN (SELECT DISTINCT tenant_id, email FROM memberships m JOIN users u ON u.id = m.user_id) b ON b.tenant_id = c.tenant_id AND b.email = c.email
  LEFT JOIN (SELECT DISTINCT tenant_id, email FROM invitations WHERE accepted_at IS NULL AND revoked_at IS NULL) p ON p.tenant_id = c.tenant_id AND p.email = c.email)
SELECT command_id, tenant_id, email, coalesce(code, CASE WHEN row_number() OVER (PARTITION BY tenant_id, email, code IS NULL ORDER BY ts, command_id) > 1 THEN 'invitation.already_pending' END) AS error_code FROM judged"""


@query(_ISSUES)
def issue_invitations(x: Fixture) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    role = chosen(F.col("o_orderpriority"), {"1-URGENT": 30, "2-HIGH": 20, "3-MEDIUM": 15}, F.lit(10))
    at = F.lit("@EXAMPLE.com ")
    email = F.when(key % 11 == 0, "nobody").when(key % 3 == 0, F.concat(F.lit("Invitee"), cust, at)).when(key % 3 == 1, F.concat(F.lit(" User"), cust, at)).otherwise(F.concat(F.lit("guest"), key % 400, at))
    actor = F.when(key % 5 == 0, cust + 100000000).when(key % 2 == 0, F.col("owner_id")).otherwise(cust)
    commands = x.order_tenants.join(x.owners, "tenant_id").select(key.alias("command_id"), "tenant_id", actor.alias("actor_id"), email.alias("email"), role.alias("role"), F.col("o_orderdate").alias("ts"))
    return jobs.issue_invitations(commands, x.users, x.tenants, x.memberships, x.invitations)


# attempts are walked through one by one within an address of a tenant, with the users and tokens taken so far; 
# needs judged (command_id, ts, user_id, tenant_id, email, token_hash, code)
_IN_TURN = """, able AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, email ORDER BY ts, command_id) AS n FROM judged WHERE code = 'accepted'),
walk AS (
  SELECT tenant_id, email, n, command_id, ts, user_id, token_hash, [user_id] AS users_in, [token_hash] AS tokens_used, true AS won FROM able WHERE n = 1
  UNION ALL SELECT a.tenant_id, a.email, a.n, a.command_id, a.ts, a.user_id, a.token_hash,
    CASE WHEN list_contains(users_in, a.user_id) OR list_contains(tokens_used, a.token_hash) THEN users_in ELSE list_append(users_in, a.user_id) END,
    CASE WHEN list_contains(users_in, a.user_id) OR list_contains(tokens_used, a.token_hash) THEN tokens_used ELSE list_append(tokens_used, a.token_hash) END,
    NOT (list_contains(users_in, a.user_id) OR list_contains(tokens_used, a.token_hash))
  FROM walk w JOIN able a ON a.tenant_id = w.tenant_id AND a.email = w.email AND a.n = w.n + 1),
winner AS (SELECT tenant_id, user_id, token_hash, (ts, command_id) AS at FROM walk WHERE won)
SELECT c.command_id, CASE WHEN code IN ('user.not_provisioned', 'resource.not_found') THEN code WHEN u.at < (c.ts, c.command_id) THEN 'already_member' WHEN code = 'accepted' AND t.at < (c.ts, c.command_id) THEN 'invitation.already_accepted' ELSE code END AS outcome
FROM judged c LEFT JOIN winner u ON u.tenant_id = c.tenant_id AND u.user_id = c.user_id LEFT JOIN winner t ON t.token_hash = c.token_hash"""
_JUDGED = """judged AS (
  SELECT c.command_id, c.ts, c.user_id, i.tenant_id, i.email, i.token_hash, CASE WHEN u.id IS NULL THEN 'user.not_provisioned' WHEN i.id IS NULL THEN 'resource.not_found' WHEN m.id IS NOT NULL THEN 'already_member'
    WHEN revoked_at IS NOT NULL THEN 'invitation.revoked' WHEN accepted_at IS NOT NULL THEN 'invitation.already_accepted' WHEN expires_at <= c.ts THEN 'invitation.expired' WHEN i.email <> u.email THEN 'access.forbidden' ELSE 'accepted' END AS code
  FROM cmds c LEFT JOIN open_i i ON i.token_hash = sha256(c.token) LEFT JOIN {users} u ON u.id = c.user_id LEFT JOIN part_m m ON m.tenant_id = i.tenant_id AND m.user_id = c.user_id)"""


@query(""", part_m AS (SELECT * FROM memberships WHERE (tenant_id + user_id) % 3 <> 0), cmds AS (
  SELECT o_orderkey AS command_id, 'tok-' || o_orderkey AS token, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS user_id, o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS ts FROM orders
  UNION ALL SELECT o_orderkey + 1000000000, 'tok-' || o_orderkey, o_custkey + 1, o_orderdate + INTERVAL 3 DAY FROM orders WHERE o_orderkey % 3 = 0),
open_i AS (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN accepted_at END AS accepted_at, CASE WHEN id % 4 = 1 THEN revoked_at END AS revoked_at) FROM invitations), """ + _JUDGED.format(users="users") + _IN_TURN)
def accept_invitations(x: Fixture) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    token = F.concat(F.lit("tok-"), key).alias("token")
    o = x.table("orders")
    first = o.select(key.alias("command_id"), token, F.when(key % 7 == 0, cust + 100000000).otherwise(cust).alias("user_id"), (F.col("o_orderdate") + F.make_dt_interval((key % 10).cast("int"))).alias("ts"))
    second = o.where(key % 3 == 0).select((key + 1000000000).alias("command_id"), token, (cust + 1).alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("ts"))
    some = x.memberships.where((F.col("tenant_id") + F.col("user_id")) % 3 != 0)
    live = x.invitations.withColumn("accepted_at", F.when(F.col("id") % 4 == 0, F.col("accepted_at"))).withColumn("revoked_at", F.when(F.col("id") % 4 == 1, F.col("revoked_at")))
    return jobs.accept_invitations(first.unionByName(second), x.users, some, live)


@query(""", part_m AS (SELECT * FROM memberships WHERE user_id % 8 = 0), team AS (SELECT * REPLACE ('team' || id // 8 || '@example.com' AS email) FROM users),
open_i AS (SELECT * REPLACE (tenant_id % 10 AS tenant_id, 'team' || (id % 40) || '@example.com' AS email, TIMESTAMP '2030-01-01' AS expires_at, CASE WHEN id % 50 = 0 THEN accepted_at END AS accepted_at, CASE WHEN id % 50 = 1 THEN revoked_at END AS revoked_at) FROM invitations),
cmds AS (SELECT o_orderkey * 4 + k AS command_id, 'tok-' || o_orderkey AS token, o_orderkey % 40 * 8 + (o_orderkey // 40 * 3 + k * 5) % 8 AS user_id, o_orderdate + to_days(CAST((o_orderkey * 7 + k * 11) % 30 AS INTEGER)) AS ts FROM orders, range(0, 4) t(k) WHERE o_orderkey % 60 < 45),
""" + _JUDGED.format(users="team") + _IN_TURN)
def accept_contested_invitations(x: Fixture) -> DataFrame:
    """Addresses that eight users share, each with many invitations of one tenant: attempts are refused that would have kept others from winning."""
    key, k = F.col("o_orderkey"), F.col("k")
    orders = x.table("orders").where(key % 60 < 45).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    mate = (F.expr("o_orderkey div 40") * 3 + k * 5) % 8
    commands = orders.select((key * 4 + k).alias("command_id"), F.concat(F.lit("tok-"), key).alias("token"), (key % 40 * 8 + mate).alias("user_id"), (F.col("o_orderdate") + F.make_dt_interval(((key * 7 + k * 11) % 30).cast("int"))).alias("ts"))
    team = x.users.withColumn("email", F.concat(F.lit("team"), F.expr("id div 8"), F.lit("@example.com")))
    live = x.invitations.withColumns({
        "tenant_id": F.col("tenant_id") % 10, "email": F.concat(F.lit("team"), F.col("id") % 40, F.lit("@example.com")), "expires_at": F.lit("2030-01-01").cast("timestamp_ntz"),
        "accepted_at": F.when(F.col("id") % 50 == 0, F.col("accepted_at")), "revoked_at": F.when(F.col("id") % 50 == 1, F.col("revoked_at")),
    })
    return jobs.accept_invitations(commands, team, x.memberships.where(F.col("user_id") % 8 == 0), live)


@query("""SELECT i.o_orderkey AS command_id, CASE WHEN i.o_orderkey % 7 = 0 THEN 'resource.not_found' WHEN v.accepted_at IS NOT NULL THEN 'invitation.already_accepted' END AS error_code,
  CASE WHEN i.o_orderkey % 7 = 0 OR v.accepted_at IS NOT NULL THEN NULL ELSE coalesce(v.revoked_at, as_of) END AS revoked_at FROM params, order_tenants i JOIN invitations v ON v.id = i.o_orderkey""")
def revoke_invitations(x: Fixture) -> DataFrame:
    key = F.col("o_orderkey")
    commands = x.order_tenants.select(key.alias("command_id"), (F.col("tenant_id") + F.when(key % 7 == 0, 1000000).otherwise(0)).alias("tenant_id"), key.alias("invitation_id"), as_of().alias("ts"))
    return jobs.revoke_invitations(commands, x.invitations)


@query(""", old AS (SELECT * FROM users WHERE id % 2 = 0), new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firebase_uid ORDER BY ts DESC, event_id DESC) AS n FROM sign_ins) WHERE n = 1)
SELECT coalesce(o.firebase_uid, n.firebase_uid) AS firebase_uid, coalesce(o.id, 1000000000 + CAST(substr(n.firebase_uid, 5) AS BIGINT)) AS id, CASE WHEN n.event_id IS NULL THEN o.email ELSE n.email END AS email, CASE WHEN n.event_id IS NULL THEN o.email_verified ELSE n.email_verified END AS email_verified,
  CASE WHEN n.event_id IS NULL THEN o.display_name END AS display_name, CASE WHEN n.event_id IS NULL THEN o.last_seen_at ELSE n.ts END AS last_seen_at, coalesce(o.created_at, as_of) AS created_at, CASE WHEN n.event_id IS NULL THEN o.updated_at ELSE as_of END AS updated_at,
  o.id IS NULL AS inserted, n.event_id IS NOT NULL AND o.id IS NOT NULL AND (n.email <> o.email OR n.email_verified <> o.email_verified OR o.display_name IS NOT NULL) AS profile_changed
FROM old o FULL JOIN new n ON o.firebase_uid = n.firebase_uid CROSS JOIN params""")
def upsert_users(x: Fixture) -> DataFrame:
    return jobs.upsert_users(x.users.where(F.col("id") % 2 == 0), x.sign_ins, as_of(), F.substring("firebase_uid", 5, 19).cast("long") + 1000000000)


@query(""", cmds AS (SELECT p_partkey AS command_id, p_name AS name, u.id AS uid, u.email_verified AS ok, rtrim(left(trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), 48), '-') AS base FROM part LEFT JOIN users u ON u.id = p_partkey * 2),
judged AS (SELECT *, CASE WHEN uid IS NULL THEN 'user.not_provisioned' WHEN NOT ok THEN 'user.email_not_verified' END AS code FROM cmds),
wanted AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY command_id) AS n FROM judged WHERE code IS NULL),
free AS (SELECT base, slug, row_number() OVER (PARTITION BY base ORDER BY i) AS n FROM (SELECT base, i, CASE WHEN i = 1 THEN base ELSE rtrim(left(base, 48 - length('-' || i)), '-') || '-' || i END AS slug FROM (SELECT DISTINCT base FROM wanted), range(1, 26) r(i)) WHERE slug NOT IN (SELECT slug FROM tenants WHERE slug IS NOT NULL))
SELECT command_id, name, slug, CASE WHEN slug IS NULL THEN 'tenant.slug_exhausted' END AS error_code FROM wanted LEFT JOIN free USING (base, n)
UNION ALL SELECT command_id, name, NULL, code FROM judged WHERE code IS NOT NULL""")
def create_tenants(x: Fixture) -> DataFrame:
    commands = x.table("part").select(F.col("p_partkey").alias("command_id"), F.concat(F.lit("uid-"), F.col("p_partkey") * 2).alias("firebase_uid"), F.concat(F.lit(" "), F.col("p_name")).alias("name"), as_of().alias("ts"))
    return jobs.create_tenants(commands, x.users, x.tenants)


_RENAMES = """, cmds AS (SELECT o_orderkey AS command_id, tenant_id, CASE WHEN o_orderkey % 4 = 0 THEN owner_id ELSE o_custkey END AS actor_id, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'Renamed ' || o_orderkey END AS name, o_orderdate AS ts FROM order_tenants JOIN owners USING (tenant_id)),
judged AS (SELECT c.*, CASE WHEN role IS NULL THEN 'resource.not_found' WHEN role < 30 THEN 'access.forbidden' WHEN name = '' THEN 'request.validation_failed' END AS error_code FROM cmds c LEFT JOIN memberships m ON m.tenant_id = c.tenant_id AND m.user_id = c.actor_id)
SELECT command_id, tenant_id, name, error_code, error_code IS NULL AND row_number() OVER (PARTITION BY tenant_id, error_code IS NULL ORDER BY ts DESC, command_id DESC) = 1 AS applied FROM judged"""


@query(_RENAMES)
def rename_tenants(x: Fixture) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.when(key % 10 == 0, "  ").otherwise(F.concat(F.lit(" Renamed "), key))
    commands = x.order_tenants.join(x.owners, "tenant_id").select(key.alias("command_id"), "tenant_id", F.when(key % 4 == 0, F.col("owner_id")).otherwise(F.col("o_custkey")).alias("actor_id"), name.alias("name"), F.col("o_orderdate").alias("ts"))
    return jobs.rename_tenants(commands, x.memberships)


@query(""", gone AS (SELECT s_suppkey AS id FROM supplier JOIN owners ON tenant_id = s_suppkey WHERE s_suppkey % 5 = 0 AND s_suppkey % 10 = 0)
SELECT 'tenants' AS table_name, count(*) AS n_left FROM tenants WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'memberships', count(*) FROM memberships WHERE tenant_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'invitations', count(*) FROM invitations WHERE tenant_id NOT IN (SELECT id FROM gone)""")
def delete_tenants(x: Fixture) -> DataFrame:
    """Owners delete every tenth tenant; strangers' commands for others are refused."""
    t = x.owners.where(F.col("tenant_id") % 5 == 0)
    actor = F.when(F.col("tenant_id") % 10 == 0, F.col("owner_id")).otherwise(F.lit(-1))
    commands = t.select(F.col("tenant_id").alias("command_id"), "tenant_id", actor.cast("long").alias("actor_id"))
    _, left = jobs.delete_tenants(commands, {"tenants": x.tenants, "memberships": x.memberships, "invitations": x.invitations})
    return jobs.union_all(df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_left")) for name, df in left.items())


# commands are walked through one by one within a tenant, with the roles of all who occur in them and the number of owners
_REPLAY = """, cmds AS (SELECT o_orderkey AS command_id, tenant_id, owner_id AS actor_id, CASE WHEN o_orderpriority = '5-LOW' THEN owner_id ELSE o_custkey END AS target_id, o_orderdate AS ts,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'set_role' WHEN o_orderpriority = '5-LOW' THEN 'leave' ELSE 'remove' END AS kind, CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 20 WHEN '3-MEDIUM' THEN 10 END AS role
  FROM order_tenants JOIN owners USING (tenant_id)),
turns AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, command_id) AS n FROM cmds),
involved AS (SELECT tenant_id, map_from_entries(list((user_id, role))) AS roles, count(*) FILTER (role = 30) AS n_owners FROM memberships WHERE (tenant_id, user_id) IN (SELECT (tenant_id, actor_id) FROM cmds UNION SELECT (tenant_id, target_id) FROM cmds) GROUP BY 1),
walk AS (
  SELECT tenant_id, 0::BIGINT AS n, NULL::BIGINT AS command_id, NULL::VARCHAR AS outcome, roles, n_owners FROM involved
  UNION ALL SELECT tenant_id, n, command_id, outcome, CASE WHEN writes THEN map_concat(roles, MAP {target_id: after}) ELSE roles END, n_owners + CASE WHEN writes THEN (coalesce(after, 0) = 30)::INT - (theirs = 30)::INT ELSE 0 END
  FROM (SELECT *, outcome = 'ok' AND theirs IS DISTINCT FROM after AS writes FROM (
    SELECT t.*, w.roles, w.n_owners, own, theirs, CASE WHEN kind = 'set_role' THEN t.role END AS after, CASE WHEN own IS NULL THEN 'resource.not_found'
      WHEN kind <> 'leave' AND own < CASE kind WHEN 'set_role' THEN 30 ELSE 20 END THEN 'access.forbidden' WHEN theirs IS NULL THEN 'resource.not_found'
      WHEN kind = 'remove' AND own = 20 AND theirs >= 20 AND target_id <> actor_id THEN 'access.forbidden' WHEN theirs = 30 AND (kind <> 'set_role' OR t.role <> 30) AND w.n_owners <= 1 THEN 'tenant.last_owner' ELSE 'ok' END AS outcome
    FROM (SELECT *, n + 1 AS next FROM walk) w JOIN turns t ON t.tenant_id = w.tenant_id AND t.n = w.next, LATERAL (SELECT w.roles[t.actor_id] AS own, w.roles[t.target_id] AS theirs)))) """


@query(_REPLAY + "SELECT tenant_id, command_id, outcome FROM walk WHERE n > 0")
def replay_membership_commands(x: Fixture) -> DataFrame:
    return replay.replay_membership_commands(x.memberships, x.commands)[0]


@query(_REPLAY + """, final AS (SELECT tenant_id, unnest(map_keys(roles)) AS user_id, unnest(map_values(roles)) AS role FROM walk QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC) = 1)
SELECT m.tenant_id, m.user_id, CASE WHEN f.user_id IS NULL THEN m.role ELSE f.role END AS role FROM memberships m LEFT JOIN final f USING (tenant_id, user_id) WHERE f.user_id IS NULL OR f.role IS NOT NULL""")
def members_after_commands(x: Fixture) -> DataFrame:
    return replay.replay_membership_commands(x.memberships, x.commands)[1]


@query("""
, u AS (SELECT 'unique open invitations(tenant_id,email)' AS rule, tenant_id || '/' || email AS key, count(*) AS n_rows FROM invitations WHERE accepted_at IS NULL AND revoked_at IS NULL GROUP BY tenant_id, email HAVING count(*) > 1
  UNION ALL SELECT 'report shared addresses', '*', count(*) FROM (SELECT email FROM users GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'required tenants.slug', '*', count(*) FROM tenants WHERE slug IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'unique memberships(tenant_id,user_id)', tenant_id || '/' || user_id, count(*) FROM memberships GROUP BY tenant_id, user_id HAVING count(*) > 1
  UNION ALL SELECT 'reference memberships.user_id', CAST(user_id AS VARCHAR), count(*) FROM memberships WHERE user_id NOT IN (SELECT id FROM users) GROUP BY user_id
  UNION ALL SELECT 'reference invitations.tenant_id', CAST(tenant_id AS VARCHAR), count(*) FROM invitations WHERE tenant_id NOT IN (SELECT id FROM tenants) GROUP BY tenant_id
  UNION ALL SELECT 'reference memberships.tenant_id', CAST(tenant_id AS VARCHAR), count(*) FROM memberships WHERE tenant_id NOT IN (SELECT id FROM tenants) GROUP BY tenant_id
  UNION ALL SELECT 'owner of tenants', CAST(id AS VARCHAR), 0 FROM tenants WHERE id NOT IN (SELECT tenant_id FROM owners))
SELECT * FROM u""")
def audit_constraints(x: Fixture) -> DataFrame:
    return audits.audit_constraints({"users": x.users, "tenants": x.tenants, "memberships": x.memberships, "invitations": x.invitations})


# tokens of one length, inside longer text: alone, after a prefix, before a suffix, between other token letters
@query(""", tokens AS (SELECT id, 'T' || lpad(CAST(id AS VARCHAR), 11, '0') || 'k' AS token FROM invitations), lines AS (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Bearer ' || t || ', again ' || t WHEN 1 THEN 'GET /invite-' || t || '?x=1' WHEN 2 THEN 'tok_' || t WHEN 3 THEN t || '-retry' WHEN 4 THEN 'ab' || left(t, 9) || ' ' || substr(t, 10) ELSE 'x' || t || t || 'T0' END AS line
  FROM (SELECT event_id, 'T' || lpad(CAST(event_id % 4000 AS VARCHAR), 11, '0') || 'k' AS t FROM events WHERE event_id % 50 < 6) UNION ALL SELECT event_id, props FROM events WHERE event_id % 50 >= 6)
SELECT DISTINCT event_id, id AS invitation_id FROM (SELECT * FROM lines WHERE contains(line, 'T')) JOIN tokens ON contains(line, token)""")
def leak_scan(x: Fixture) -> DataFrame:
    token = lambda n: F.concat(F.lit("T"), F.lpad(n.cast("string"), 11, "0"), F.lit("k"))
    i, t = F.col("event_id"), token(F.col("event_id") % 4000)
    forms = [F.concat(F.lit("Bearer "), t, F.lit(", again "), t), F.concat(F.lit("GET /invite-"), t, F.lit("?x=1")), F.concat(F.lit("tok_"), t), F.concat(t, F.lit("-retry")), F.concat(F.lit("ab"), F.substring(t, 1, 9), F.lit(" "), F.substring(t, 10, 9))]
    line = F.concat(F.lit("x"), t, t, F.lit("T0"))
    for n, form in enumerate(forms):
        line = F.when(i % 6 == n, form).otherwise(line)
    log = x.table("events").select("event_id", F.when(i % 50 < 6, line).otherwise(F.col("props")).alias("line"))
    return audits.leak_scan(log, x.invitations.select("id", F.unhex(F.sha2(token(F.col("id")), 256)).alias("token_hash")), (13,))


_BAD = """, bad AS (SELECT id, CASE WHEN id % 7 = 0 THEN '  ' WHEN id % 11 = 0 THEN repeat('n', 101) ELSE coalesce(display_name, '') END AS name, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 13 = 0 THEN '@x' WHEN id % 17 = 0 THEN repeat('e', 320) || '@x' ELSE email END AS email, CAST(id % 4 * 10 AS INTEGER) AS role FROM users)"""


@query(_BAD + """ SELECT id AS command_id, 'Name' AS field, 'must not be empty' AS message FROM bad WHERE trim(name) = '' UNION ALL SELECT id, 'Name', 'must be at most 100 characters' FROM bad WHERE length(name) > 100
UNION ALL SELECT id, 'Email', 'must not be empty' FROM bad WHERE email IS NULL UNION ALL SELECT id, 'Email', 'must be at most 320 characters' FROM bad WHERE length(email) > 320
UNION ALL SELECT id, 'Email', 'is not an address' FROM bad WHERE email = '@x' UNION ALL SELECT id, 'Role', 'is not a role' FROM bad WHERE role = 0""")
def validation_report(x: Fixture) -> DataFrame:
    i = F.col("id")
    name = F.when(i % 7 == 0, "  ").when(i % 11 == 0, F.repeat(F.lit("n"), 101)).otherwise(F.coalesce("display_name", F.lit("")))
    email = F.when(i % 5 == 0, None).when(i % 13 == 0, "@x").when(i % 17 == 0, F.concat(F.repeat(F.lit("e"), 320), F.lit("@x"))).otherwise(F.col("email"))
    return queries.validation_report(x.users.select(i.alias("command_id"), name.alias("name"), email.alias("email"), (i % 4 * 10).cast("int").alias("role")))


@query(COUNTS + """, invited AS (SELECT tenant_id, count(*) AS n FROM invitations, params WHERE accepted_at IS NULL AND revoked_at IS NULL AND expires_at > as_of GROUP BY 1), steps AS (
  SELECT t.id AS tenant_id, coalesce(u.email_verified, false) AS verify_done, coalesce(i.n, 0) > 0 OR coalesce(member_count, 0) > 1 AS invite_done FROM tenants t LEFT JOIN users u ON u.id = t.created_by_user_id LEFT JOIN counts c ON c.tenant_id = t.id LEFT JOIN invited i ON i.tenant_id = t.id)
SELECT *, 1 + CAST(verify_done AS INTEGER) + CAST(invite_done AS INTEGER) AS done, 3 AS total FROM steps""")
def onboarding_progress(x: Fixture) -> DataFrame:
    return queries.onboarding_progress(x.tenants, x.users, x.memberships, x.invitations, as_of())


@query("""SELECT event_type AS message_type, count(*) AS n, count(*) FILTER (level = 'Warning') AS n_warning, count(*) FILTER (level = 'Error') AS n_error, round(count(*) FILTER (level = 'Error') / count(*), 6) AS error_rate
FROM (SELECT event_type, CASE WHEN event_id % 20 = 0 THEN 'none' WHEN event_type = 'error' THEN 'Error' WHEN event_id % 3 = 0 THEN 'Warning' ELSE 'Information' END AS level FROM events) WHERE level <> 'none' GROUP BY 1""")
def request_outcomes(x: Fixture) -> DataFrame:
    e = x.table("events")
    outcome = F.when(F.col("event_id") % 20 == 0, "cancelled").when(F.col("event_type") == "error", "crashed").when(F.col("event_id") % 3 == 0, "failed").otherwise("ok")
    return queries.request_outcomes(e.select(F.col("event_type").alias("message_type"), outcome.alias("outcome")))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE '10.0.0.1' END ELSE caller END AS caller,
  CASE WHEN s = 200 THEN NULL WHEN s = 404 THEN 'resource.not_found' WHEN s = 418 THEN 'request.rejected' ELSE 'server.unexpected_error' END AS error_code,
  CASE WHEN s >= 500 THEN 'Error' WHEN event_id % 10 = 1 THEN 'Verbose' ELSE 'Information' END AS level, CAST(ceil((60000000 - epoch_us(ts) % 60000000) / 1000000.0) AS BIGINT) AS retry_after
FROM (SELECT *, CASE WHEN status = 500 THEN 500 WHEN event_id % 9 = 0 THEN 404 WHEN event_id % 9 = 1 THEN 418 ELSE 200 END AS s FROM requests)""")
def request_classification(x: Fixture) -> DataFrame:
    i = F.col("event_id")
    status = F.when(F.col("status") == 500, 500).when(i % 9 == 0, 404).when(i % 9 == 1, 418).otherwise(200)
    path = F.when(i % 10 == 1, "/Health/ready").when(i % 10 == 2, "/healthy").otherwise("/api")
    rows = x.requests.select("event_id", F.when(i % 6 == 0, " ").otherwise(F.col("caller")).alias("subject"), F.when(i % 4 != 0, "10.0.0.1").alias("address"), path.alias("path"), status.alias("status"), F.lit(False).alias("failed"), "ts")
    return queries.request_classification(rows)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, caller, policy, count(*) AS n FROM requests GROUP BY ALL")
def requests_per_window(x: Fixture) -> DataFrame:
    return queries.requests_per_window(x.requests, 3600)


@query("""SELECT event_id, caller, policy, n <= 5 AS admitted, CASE WHEN n > 5 THEN 429 END AS status, CASE WHEN n > 5 THEN 'quota.rate_limited' END AS error_code, CASE WHEN n > 5 THEN CAST(ceil((86400000000 - epoch_us(ts) % 86400000000) / 1000000.0) AS BIGINT) END AS retry_after
FROM (SELECT *, row_number() OVER (PARTITION BY caller, policy, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) AS n FROM requests)""")
def rate_limit(x: Fixture) -> DataFrame:
    return queries.rate_limit(x.requests, F.lit(5), 86400)


_CHUNKS = r""", words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS w FROM documents),
chunks AS (SELECT doc_id, i AS ordinal, i * 512 AS first_word, CAST(least(512, len(w) - i * 512) AS BIGINT) AS n_words, array_to_string(w[i * 512 + 1 : i * 512 + 512], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 511) // 512)) AS i FROM words WHERE len(w) > 0))"""


@query(_CHUNKS + " SELECT * FROM chunks")
def chunk_documents(x: Fixture) -> DataFrame:
    return retrieval.chunk_documents(x.table("documents"))


_COS = """, vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), near AS (
  SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS cosine FROM vec q JOIN vec v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0))"""


def _near(x: Fixture, k: int) -> DataFrame:
    e = x.table("embeddings").select("vec_id", "embedding")
    return retrieval.vector_top_k(e.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), e, k)


@query(_COS + " SELECT query_id, vec_id, round(cosine, 6) AS cosine, rank FROM near WHERE rank <= 10")
def vector_top_k(x: Fixture) -> DataFrame:
    return _near(x, 10).withColumn("cosine", F.round("cosine", 6))


_BM25 = r""", tw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
stats AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM tw), q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM benchmark WHERE item_id % 50 = 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM tw) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), stats GROUP BY ALL),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def _found(x: Fixture, k: int) -> DataFrame:
    q = x.table("benchmark").where(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), "text")
    return retrieval.text_top_k(q, x.table("documents"), k)


@query(_BM25 + " SELECT query_id, doc_id, round(score, 4) AS score, rank FROM found WHERE rank <= 10")
def text_top_k(x: Fixture) -> DataFrame:
    return _found(x, 10).withColumn("score", F.round("score", 4))


@query(_BM25.replace("item_id % 50 = 0", "item_id % 50 < 2") + " SELECT query_id, doc_id, round(score, 4) AS score, rank FROM found WHERE rank <= CASE WHEN query_id % 50 = 0 THEN 10 ELSE 20 END")
def indexed_text_top_k(x: Fixture) -> DataFrame:
    """One index over all documents, asked by two sets of queries: the 10 best for the first, the 20 best for the second."""
    index = postings.write_index(x.table("documents"), new_path(x.spark, "index"))
    b = x.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = [postings.indexed_top_k(b.where(F.col("query_id") % 50 == n), index, k) for n, k in ((0, 10), (1, 20))]
    return jobs.union_all(found).withColumn("score", F.round("score", 4))


_FUSED = _COS + _BM25 + """, fused AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.doc_id) AS item_id, round(coalesce(1::DOUBLE / (60 + a.rank), 0) + coalesce(1::DOUBLE / (60 + b.rank), 0), 9) AS score
  FROM (SELECT * FROM near WHERE rank <= 20) a FULL JOIN (SELECT * FROM found WHERE rank <= 20) b ON a.query_id = b.query_id AND a.vec_id = b.doc_id))"""


def _fused(x: Fixture) -> DataFrame:
    return retrieval.rrf_fuse(_near(x, 20).withColumnRenamed("vec_id", "item_id"), _found(x, 20).withColumnRenamed("doc_id", "item_id"))


@query(_FUSED + " SELECT query_id, item_id, round(score, 6) AS score, rank FROM fused")
def rrf_fuse(x: Fixture) -> DataFrame:
    return _fused(x).withColumn("score", F.round("score", 6))


@query(_FUSED + _CHUNKS + """, asked AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS t FROM benchmark),
best AS (SELECT f.query_id, f.rank, c.*, row_number() OVER (PARTITION BY f.query_id, c.doc_id ORDER BY len(list_intersect(list_distinct(regexp_split_to_array(lower(chunk), '[^a-z0-9]+')), coalesce(a.t, []))) DESC, ordinal) AS n
  FROM fused f JOIN chunks c ON c.doc_id = f.item_id LEFT JOIN asked a ON a.query_id = f.query_id WHERE f.rank <= 5)
SELECT b.query_id, b.doc_id, b.rank, d.source, b.ordinal, b.first_word, b.n_words FROM best b JOIN documents d ON d.doc_id = b.doc_id WHERE n = 1""")
def cite(x: Fixture) -> DataFrame:
    docs, asked = x.table("documents"), x.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.cite(_fused(x).where("rank <= 5").withColumnRenamed("item_id", "doc_id"), asked, retrieval.chunk_documents(docs), docs)


@query("""SELECT user_id % 10 AS tenant_id, date_trunc('day', ts) AS window_start, count(*) AS n, CAST(user_id % 10 * 3 AS BIGINT) AS quota, count(*) > user_id % 10 * 3 AS exceeded FROM events GROUP BY user_id % 10, date_trunc('day', ts)""")
def tenant_usage(x: Fixture) -> DataFrame:
    usage = x.table("events").select((F.col("user_id") % 10).alias("tenant_id"), "ts")
    limits = usage.select("tenant_id").distinct().withColumn("quota", F.col("tenant_id") * 3)
    return retrieval.tenant_usage(usage, limits)


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def registered_sql() -> dict[str, str]:
    return dict(_SQL)


FLAGSHIP = "member_directory"
