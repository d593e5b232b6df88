"""Explicit schemas of the four tenancy tables, of commands and of the request log."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_ID, _TEXT, _FLAG, _TIME, _ROLE = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType(), T.IntegerType()

USERS = _table(id=_ID, firebase_uid=_TEXT, email=_TEXT, email_verified=_FLAG, display_name=_TEXT, last_seen_at=_TIME, created_at=_TIME, updated_at=_TIME)
TENANTS = _table(id=_ID, name=_TEXT, slug=_TEXT, created_by_user_id=_ID, created_at=_TIME, updated_at=_TIME)
MEMBERSHIPS = _table(id=_ID, tenant_id=_ID, user_id=_ID, role=_ROLE, created_at=_TIME, updated_at=_TIME)
INVITATIONS = _table(
    id=_ID, tenant_id=_ID, email=_TEXT, role=_ROLE, token_hash=T.BinaryType(), invited_by_user_id=_ID, expires_at=_TIME,
    accepted_at=_TIME, accepted_by_user_id=_ID, revoked_at=_TIME, created_at=_TIME, updated_at=_TIME,
)
TABLES = {"users": USERS, "tenants": TENANTS, "memberships": MEMBERSHIPS, "invitations": INVITATIONS}

REQUEST_LOG = _table(event_id=_ID, ts=T.TimestampType(), caller=_TEXT, path=_TEXT, status=T.IntegerType(), message=_TEXT)
EVENTS = _table(event_id=_ID, ts=_TIME, user_id=_ID, event_type=_TEXT, value=T.DoubleType(), props=_TEXT)

# The ordered roles and their names.
MEMBER, ADMIN, OWNER = 10, 20, 30
ROLE_NAMES = {MEMBER: "Member", ADMIN: "Admin", OWNER: "Owner"}
