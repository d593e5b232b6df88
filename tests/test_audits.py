"""Audits read each table once; leaks are found inside longer text."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from tenora.operators import audits
from tenora.sources.schemas import TABLES

NOW = dt.datetime(2026, 8, 17, 12)


def test_each_table_is_scanned_once(spark, tmp_path):
    users = [(i, f"u{i}", "same@x" if i < 3 else f"{i}@x", True, None, None, NOW, NOW) for i in range(1, 6)]
    made = {n: spark.createDataFrame(users if n == "users" else [], s) for n, s in TABLES.items()}
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}")
    out = audits.audit_constraints({n: spark.read.schema(s).parquet(f"{tmp_path}/{n}") for n, s in TABLES.items()})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4
    assert {tuple(r) for r in out.select("rule", "key", "n_rows").collect()} == {("report shared addresses", "*", 1)}


def test_tokens_are_found_in_longer_text(spark):
    token = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:43]
    invitations = spark.createDataFrame([(i, bytearray(hashlib.sha256(token(i).encode()).digest())) for i in range(50)] + [(99, None)], "id long, token_hash binary")
    lines = [f"Bearer {token(1)}", f"GET /invite-{token(2)}?a=1", f"tok_{token(3)}", f"{token(4)}-retry", f"{token(5)}{token(6)}", token(7)[:-1], f"{token(8)[:20]} {token(8)[20:]}", None, "", f"é{token(9)}é {token(9)}"]
    log = spark.createDataFrame(list(enumerate(lines)), "event_id long, line string")
    got = {(r["event_id"], r["invitation_id"]) for r in audits.leak_scan(log, invitations).collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (9, 9)}
    assert audits.leak_scan(log, invitations.limit(0)).count() == 0 and audits.leak_scan(log.where(F.lit(False)), invitations).count() == 0


def test_clustered_vectors_are_compared_in_part(spark):
    import random

    from tenora.operators import retrieval

    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [c + rnd.gauss(0, 0.05) for c in centres[i % 40]]) for i in range(2000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    units = retrieval._celled(retrieval._units(v.withColumnRenamed("vec_id", "id")), pivots := retrieval._pivots(retrieval._units(v.withColumnRenamed("vec_id", "id"))))
    shape = {r["cell"]: (r["n"], r["a"], r["b"]) for r in units.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("a"), F.max("away").alias("b")).collect()}
    q = units.where(F.col("id") % 50 == 0)
    sizes = spark.createDataFrame([(c, n) for c, (n, _, _) in shape.items()], "cell long, n long")
    compared = lambda visits: visits.join(sizes, "cell").agg(F.sum("n")).first()[0]
    first = compared(retrieval._visits(q.select("id", "unit"), pivots, shape, dict.fromkeys(shape, 1), 10, 1, None))
    got = retrieval.vector_top_k(v.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), v, 10)
    worst = got.groupBy("query_id").agg(F.min("cosine").alias("worst")).withColumnRenamed("query_id", "id")
    second = compared(retrieval._visits(q.select("id", "unit").join(worst, "id"), pivots, shape, dict.fromkeys(shape, 1), 10, 1, "worst")) or 0
    assert first + second < 0.25 * 40 * 2000  # of 40 queries against 2000 vectors
    assert got.count() == 400


def test_rolled_log(spark, tmp_path):
    from tenora.sources.tables import damaged_lines, read_request_log

    for day in ("20240101", "20240102", "20240103"):
        line = f'{{"event_id": {day}, "ts": "2024-01-01T00:00:01Z", "status": 200, "path": "/api"}}\n'
        (tmp_path / f"requests-{day}.json").write_text(line * 2 + ("{broken\n" if day == "20240102" else ""))
    one = read_request_log(spark, str(tmp_path), first_day="2024-01-02", last_day="2024-01-02")
    assert [r["event_id"] for r in one.collect()] == [20240102] * 2
    assert read_request_log(spark, str(tmp_path)).count() == 6
    lost = damaged_lines(spark, str(tmp_path)).collect()
    assert [(r["file_name"], r["damaged_line"]) for r in lost] == [("requests-20240102.json", "{broken")]
    assert damaged_lines(spark, str(tmp_path), first_day="2024-01-03").count() == 0
    # files of other days are not read at all
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    scan.execute().count()
    assert scan.metrics().apply("numFiles").value() == 1


def test_facts_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(audits, "ROWS", 100, raising=False)
    rows = spark.range(0, 1000, 1, 1).select(F.col("id"), F.lit(1).cast("long").alias("tenant_id"), F.col("id").alias("user_id"), F.lit(30).alias("role"))
    tables = {name: spark.createDataFrame([], kind) for name, kind in TABLES.items()} | {"memberships": rows}
    parts = audits._in_small_tasks("memberships", rows)
    assert parts.rdd.getNumPartitions() == 10 and max(parts.rdd.glom().map(len).collect()) < 200
    found = {(r["rule"], r["key"]): r["n_rows"] for r in audits.audit_constraints(tables).collect()}
    assert found["reference memberships.tenant_id", "1"] == 1000 and len(found) == 1001
