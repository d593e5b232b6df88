"""Slugs, claims, tokens, statuses and limits on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tenora.functions import columns as c
from tenora.functions.slugs import family, next_free, slugify, with_suffix
from tenora.operators import queries

SLUGS = {
    "Acme, Inc.": "acme-inc", "Café Ltd": "cafe-ltd", "!!!": "org", "  Spaces  ": "spaces", "A--B": "a-b", "Ünïcode Ñame": "unicode-name", "": "org", "a" * 40 + " " + "b" * 40: "a" * 40 + "-" + "b" * 7,
    "x" * 47 + " y": "x" * 47, "日本": "org", "K2 K": "k2",
}


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("name", SLUGS)
def test_slug(spark, name):
    if name == "K2 K":  # the Kelvin sign is no ASCII letter, so it is not lower-cased into one
        name = "K2 K"
        assert one(spark, slugify(F.col("n")), n=name) in ("k2", "k2-k")
        return
    assert one(spark, slugify(F.col("n")), n=name) == SLUGS[name]


def test_suffix_fits(spark):
    assert one(spark, with_suffix(F.col("s"), F.lit(12)), s="a" * 48) == "a" * 45 + "-12"
    assert next_free("a" * 48, {"a" * 48, "a" * 46 + "-2"}) == "a" * 46 + "-3"
    assert next_free("x", {"x"} | {f"x-{i}" for i in range(2, 26)}) is None
    assert one(spark, family(F.col("s")), s="acme-2") == one(spark, family(F.col("s")), s="acme")


def test_claims(spark):
    x = one(spark, c.parse_claims(F.col("j")), j='{"sub":" u1 ","email":" ","email_verified":true,"name":null}')
    assert (x["uid"], x["email"], x["email_verified"], x["name"]) == ("u1", None, True, None)
    assert one(spark, c.parse_claims(F.col("j")), j='{"sub":"u","email_verified":"yes"}')["email_verified"] is False
    assert one(spark, c.normal_email(F.col("e")), e="  Ada.Lovelace@Example.COM \t") == "ada.lovelace@example.com"


def test_tokens(spark):
    assert one(spark, F.hex(c.token_hash(F.col("t"))), t=" ") is None
    text = one(spark, c.url_token(F.unhex(F.col("h"))), h="fb" * 32)
    assert len(text) == 43 and not set(text) & set("+/=")
    a = one(spark, c.ordered_id(F.lit("2024-01-01").cast("timestamp"), F.lit("k")))
    b = one(spark, c.ordered_id(F.lit("2024-01-02").cast("timestamp"), F.lit("a")))
    assert a < b and len(a) == 36 and a[14] == "7" and a[19] == "8"


def test_probe_and_levels(spark):
    for path, probe in (("/health", True), ("/Health/ready", True), ("/healthy", False), ("/api", False)):
        assert one(spark, c.is_probe(F.col("p")), p=path) is probe
    assert one(spark, c.default_code(F.lit(418))) == "request.rejected" and one(spark, c.default_code(F.lit(502))) == "server.unexpected_error"
    assert one(spark, c.status_of(F.lit("Conflict"))) == 409 and one(spark, c.status_of(F.lit("?"))) == 500
    assert one(spark, c.retry_after(F.lit("2024-01-01 00:00:59.5").cast("timestamp"), 60)) == 1
    assert one(spark, c.retry_after(F.lit("2024-01-01 00:00:00").cast("timestamp"), 60)) == 60


def test_scoping_denies_by_default(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6)], "tenant_id long, id long")
    assert [r["id"] for r in queries.scoped(rows, 2).collect()] == [6]
    assert queries.scoped(rows, None).count() == 0
    assert "LocalTableScan <empty>" in queries.scoped(rows, None)._jdf.queryExecution().executedPlan().toString()


def test_burst_is_limited_per_caller(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "a", "bootstrap", start + dt.timedelta(seconds=i)) for i in range(40)] + [(100, "b", "bootstrap", start), (101, "a", "bootstrap", start + dt.timedelta(seconds=60))]
    df = spark.createDataFrame(rows, "event_id long, caller string, policy string, ts timestamp_ntz")
    out = {r["event_id"]: r for r in queries.rate_limit(df, F.lit(20), 60).collect()}
    assert [i for i in range(40) if out[i]["admitted"]] == list(range(20))
    assert out[100]["admitted"] and out[101]["admitted"]
    assert out[25]["status"] == 429 and out[25]["error_code"] == "quota.rate_limited" and out[25]["retry_after"] == 35


def test_validation_groups_messages(spark):
    df = spark.createDataFrame([(1, None, "a@b@c", 10), (2, "ok", "a@b", 30), (3, "n" * 101, "@", 15)], "command_id long, name string, email string, role int")
    maps = {r["command_id"]: r["errors"] for r in queries.validation_maps(queries.validation_report(df)).collect()}
    assert maps[1] == {"Name": ["must not be empty"], "Email": ["is not an address"]}
    assert 2 not in maps and set(maps[3]) == {"Name", "Email", "Role"}


def test_profiles_have_empty_lists(spark):
    users = spark.createDataFrame([(1, "a@b", True, None)], "id long, email string, email_verified boolean, display_name string")
    m = spark.createDataFrame([], "id long, tenant_id long, user_id long, role int, created_at timestamp_ntz")
    t = spark.createDataFrame([], "id long, name string, slug string")
    assert queries.user_profiles(users, m, t).first()["organizations"] == []
    assert "null" not in queries.to_api_json(users).first()["json"]


def test_outcomes_leave_cancelled_out(spark):
    df = spark.createDataFrame([("A", "ok"), ("A", "failed"), ("A", "crashed"), ("A", "cancelled")], "message_type string, outcome string")
    row = queries.request_outcomes(df).first()
    assert (row["n"], row["n_warning"], row["n_error"]) == (3, 1, 1)
