"""Column expressions of the tenancy rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.sources.schemas import ROLE_NAMES

# Statuses of deliberate failures, and the code for a status that came without one.
STATUS_OF_CATEGORY = {"Validation": 400, "Unauthorized": 401, "Forbidden": 403, "NotFound": 404, "Conflict": 409, "RateLimited": 429, "Unavailable": 503, "Timeout": 504, "Unexpected": 500}
CODE_OF_STATUS = {
    400: "request.invalid", 401: "access.unauthorized", 403: "access.forbidden", 404: "resource.not_found", 405: "request.method_not_allowed", 406: "request.not_acceptable",
    409: "resource.conflict", 413: "request.payload_too_large", 415: "request.unsupported_media_type", 429: "quota.rate_limited", 503: "server.unavailable", 504: "server.timeout",
}
CATEGORY_OF_CODE = {
    "request.validation_failed": "Validation", "access.unauthorized": "Unauthorized", "access.forbidden": "Forbidden", "user.not_provisioned": "Forbidden", "user.email_not_verified": "Forbidden",
    "resource.not_found": "NotFound", "resource.conflict": "Conflict", "tenant.last_owner": "Conflict", "tenant.slug_exhausted": "Conflict", "membership.already_exists": "Conflict",
    "invitation.already_pending": "Conflict", "invitation.already_accepted": "Conflict", "invitation.revoked": "Conflict", "invitation.expired": "Conflict", "quota.rate_limited": "RateLimited",
}

WHITE = r"(?U)^\s+|\s+$"


def chosen(key: Column, table: dict, other: Column | None = None) -> Column:
    """The entry of a small fixed table for ``key``."""
    out = F.lit(None) if other is None else other
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, WHITE, "")


def normal_email(x: Column) -> Column:
    return F.lower(stripped(x))


def normal_name(x: Column) -> Column:
    """Trimmed, blank as null."""
    return F.nullif(stripped(x), F.lit(""))


def role_name(role: Column) -> Column:
    return chosen(role, ROLE_NAMES).cast("string")


def is_open(as_of: Column) -> Column:
    """Neither accepted nor revoked, and not yet expired."""
    return F.col("accepted_at").isNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > as_of)


def invitation_status(as_of: Column) -> Column:
    """Revoked before accepted before expired before pending."""
    return F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("accepted_at").isNotNull(), "accepted").when(F.col("expires_at") <= as_of, "expired").otherwise("pending")


#: The code with which redeeming an invitation of each status fails.
CODE_OF_INVITATION = {"revoked": "invitation.revoked", "accepted": "invitation.already_accepted", "expired": "invitation.expired"}


def token_hash(token: Column) -> Column:
    """SHA-256 of the token's UTF-8; a blank token has none."""
    return F.when(stripped(token) != "", F.unhex(F.sha2(token, 256)))


def url_token(random: Column) -> Column:
    """Random bytes as base64 for urls, without padding."""
    return F.translate(F.base64(random), "+/=\r\n", "-_")


def default_code(status: Column) -> Column:
    return chosen(status, CODE_OF_STATUS, F.when(status >= 500, "server.unexpected_error").when(status >= 400, "request.rejected"))


def status_of(category: Column) -> Column:
    return F.coalesce(chosen(category, STATUS_OF_CATEGORY), F.lit(500)).cast("int")


def is_probe(path: Column) -> Column:
    """The health path or one below it, by segment, whatever the case."""
    return (F.lower(path) == "/health") | F.lower(path).startswith("/health/")


def log_level(status: Column, failed: Column, path: Column) -> Column:
    return F.when(failed | (status >= 500), "Error").when(is_probe(path), "Verbose").otherwise("Information")


def retry_after(ts: Column, seconds: int) -> Column:
    """Whole seconds, rounded up, until the fixed window of ``ts`` ends."""
    micros = F.unix_micros(ts.cast("timestamp"))
    width = seconds * 1_000_000
    return F.ceil((F.lit(width) - F.pmod(micros, F.lit(width))) / 1_000_000).cast("long")


def caller_key(subject: Column, address: Column) -> Column:
    return F.coalesce(normal_name(subject), normal_name(address), F.lit("unknown"))


def parse_claims(claims: Column) -> Column:
    """A token's claims: blank as null, and only the text ``true`` (any case) as true."""
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("sub", "email", "email_verified", "name")])
    c = F.from_json(claims, kind)
    flag = F.coalesce(F.lower(stripped(c["email_verified"])) == "true", F.lit(False))
    return F.struct(normal_name(c["sub"]).alias("uid"), normal_name(c["email"]).alias("email"), flag.alias("email_verified"), normal_name(c["name"]).alias("name"))


def ordered_id(ts: Column, key: Column) -> Column:
    """A time-ordered id in the layout of version 7, the same for the same key: tasks that run again repeat it."""
    x = F.concat(F.lpad(F.lower(F.hex(F.unix_millis(ts.cast("timestamp")))), 12, "0"), F.lit("7"), F.substring(F.sha2(key.cast("string"), 256), 1, 3), F.lit("8"), F.substring(F.sha2(key.cast("string"), 256), 4, 15))
    return F.concat_ws("-", *[F.substring(x, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def email_shape(x: Column) -> Column:
    """One at sign, neither first nor last."""
    return (F.length(x) - F.length(F.replace(x, F.lit("@"), F.lit(""))) == 1) & ~x.startswith("@") & ~x.endswith("@")
