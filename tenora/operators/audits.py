"""Integrity rules that a relational store would enforce, as audit jobs: rows (rule, key, n_rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenora.plans.bitmap import may_match
from tenora.plans.staging import staged
from tenora.sources.schemas import OWNER

TOKEN_LENGTH = 43  # 32 random bytes as base64 for urls
ROWS = 1 << 19  # rows whose facts one task counts before the shuffle: most are distinct, so its memory goes with them

# What must be unique, present, of bounded length, and refer to what.
UNIQUE = {"users": [["id"], ["firebase_uid"]], "tenants": [["id"], ["slug"]], "memberships": [["id"], ["tenant_id", "user_id"]], "invitations": [["id"], ["token_hash"]]}
REQUIRED = {"users": ["firebase_uid", "email", "email_verified"], "tenants": ["name", "slug", "created_by_user_id"], "memberships": ["tenant_id", "user_id", "role"], "invitations": ["tenant_id", "email", "role", "token_hash", "expires_at"]}
LENGTHS = {"users": {"firebase_uid": 128, "email": 320, "display_name": 200}, "tenants": {"name": 100, "slug": 48}, "invitations": {"email": 320}}
REFERENCES = [("tenants", "created_by_user_id", "users"), ("memberships", "tenant_id", "tenants"), ("memberships", "user_id", "users"), ("invitations", "tenant_id", "tenants")]


def _key(columns: list[str], rows: DataFrame) -> Column:
    text = [F.lower(F.hex(c)) if rows.schema[c].dataType.typeName() == "binary" else F.col(c).cast("string") for c in columns]
    return F.concat_ws("/", *text)


def _facts(name: str, rows: DataFrame) -> DataFrame:
    """What a row says to the rules, as (space, key, tag): its unique keys, what it lacks, what it refers to and what may refer to it."""
    text = lambda *columns: _key(list(columns), rows)
    fact = lambda space, key, tag, when: F.when(when, F.struct(F.lit(space).alias("space"), key.alias("key"), F.lit(tag).alias("tag")))
    whole = lambda columns: reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    facts = [fact(f"unique {name}({','.join(k)})", text(*k), "", whole(k)) for k in UNIQUE[name]]
    facts += [fact(f"required {name}.{c}", F.lit("*"), "", F.col(c).isNull()) for c in REQUIRED[name]]
    facts += [fact(f"length {name}.{c}", F.lit("*"), "", F.char_length(c) > n) for c, n in LENGTHS.get(name, {}).items()]
    facts += [fact(f"parent {parent}", text(c), f"reference {name}.{c}", F.col(c).isNotNull()) for child, c, parent in REFERENCES if child == name]
    if name in {parent for _, _, parent in REFERENCES}:
        facts.append(fact(f"parent {name}", text("id"), "parent", F.col("id").isNotNull()))
    if name == "users":
        facts.append(fact("address", F.col("email"), "", F.col("email").isNotNull()))
    if name == "memberships":
        facts.append(fact("parent tenants", text("tenant_id"), "owner", (F.col("role") == OWNER) & F.col("tenant_id").isNotNull()))
    if name == "invitations":
        facts.append(fact("length invitations.token_hash", F.lit("*"), "", F.octet_length("token_hash") != 32))
        open_ = F.col("accepted_at").isNull() & F.col("revoked_at").isNull()
        facts.append(fact("unique open invitations(tenant_id,email)", F.concat_ws("/", F.coalesce(text("tenant_id"), F.lit("")), F.coalesce("email", F.lit(""))), "", open_))
    return rows.select(F.explode(F.array_compact(F.array(*facts))).alias("x")).select("x.*")


def _in_small_tasks(name: str, rows: DataFrame) -> DataFrame:
    """The columns that rules look at, staged, and dealt to tasks of some ``ROWS`` rows whatever their number."""
    used = {c for key in UNIQUE[name] for c in key} | {*REQUIRED[name], *LENGTHS.get(name, {})} | {c for child, c, _ in REFERENCES if child == name}
    used |= {"accepted_at", "revoked_at"} if name == "invitations" else set()
    rows = staged(rows.select(*[c for c in rows.columns if c in used]), name)
    n = rows.count()
    return rows.repartition(-(-n // ROWS), *rows.columns) if n > ROWS else rows


def audit_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """Every violation: rule, key, n_rows. Nulls are no duplicates.

    Each table is read once: its rows are expanded to facts, and one aggregate over those of all tables has the counts of every unique key, of
    every missing or overlong value, and, for each parent, whether it exists, who refers to it and whether it has an owner. Counts are taken
    before the shuffle, so a key with very many rows costs no more than others, and in tasks of so many rows, so their memory does not grow.
    """
    facts = reduce(DataFrame.unionByName, [_facts(name, _in_small_tasks(name, tables[name])) for name in UNIQUE])
    refers = {f"reference {child}.{c}": parent for child, c, parent in REFERENCES}
    counts = {"parent": F.count_if(F.col("tag") == "parent"), "owner": F.count_if(F.col("tag") == "owner")} | {tag: F.count_if(F.col("tag") == tag) for tag in refers}
    groups = facts.groupBy("space", "key").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in counts.items()])
    n, space, key = F.col("n"), F.col("space"), F.col("key")
    found = lambda rule, n, when: F.when(when, F.struct(rule.alias("rule"), key.alias("key"), n.cast("long").alias("n_rows")))
    lone = (space == "parent tenants") & (F.col("parent") > 0) & (F.col("owner") == 0)
    rules = [
        found(space, n, space.startswith("unique ") & (n > 1)), found(space, n, space.startswith("required ") | space.startswith("length ")),
        found(F.lit("owner of tenants"), F.lit(0), lone), found(F.lit("report shared addresses"), n, (space == "address") & (n > 1)),
        *[found(F.lit(tag), F.col(f"`{tag}`"), (space == f"parent {parent}") & (F.col("parent") == 0) & (F.col(f"`{tag}`") > 0)) for tag, parent in refers.items()],
    ]
    rows = groups.select(F.explode(F.array_compact(F.array(*rules))).alias("x")).select("x.*")
    # shared addresses are reported as one number
    shared = F.col("rule") == "report shared addresses"
    rows = rows.select("rule", F.when(shared, "*").otherwise(F.col("key")).alias("key"), F.when(shared, 1).otherwise(F.col("n_rows")).alias("n_rows"))
    return rows.groupBy("rule", "key").agg(F.sum("n_rows").alias("n_rows"))


def leak_scan(log: DataFrame, invitations: DataFrame, lengths: tuple[int, ...] = (TOKEN_LENGTH,)) -> DataFrame:
    """Log lines (event_id, line) that contain an invitation's token, whatever stands beside it: event_id, invitation_id.

    Only the tokens' hashes are stored, so every stretch of a token's length within a run of token letters is hashed. A bitmap of the hashes,
    of fixed size, drops nearly all stretches where they are made; the others are joined with the hashes themselves. Null lines hold nothing.
    """
    known = invitations.select("token_hash", F.col("id").alias("invitation_id")).where("token_hash IS NOT NULL")
    place = lambda c: F.conv(F.substring(F.hex(c), 1, 12), 16, 10).cast("long")
    found = []
    for length in lengths:
        runs = log.select("event_id", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(rf"([A-Za-z0-9_\-]{{{length},}})"), F.lit(1)))).alias("run"))
        begins = F.sequence(F.lit(1), F.char_length("run") - length + 1)
        stretches = runs.select("event_id", F.explode(F.array_distinct(F.transform(begins, lambda i: F.substring(F.col("run"), i, F.lit(length))))).alias("stretch"))  # noqa: B023
        hashed = stretches.select("event_id", F.unhex(F.sha2("stretch", 256)).alias("token_hash"))
        found.append(may_match(hashed, place("token_hash"), known, place("token_hash")))
    rows = reduce(DataFrame.unionByName, found)
    return rows.join(known, "token_hash").select("event_id", "invitation_id").distinct()
