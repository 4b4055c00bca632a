"""Sheet queries against their SQL on small tables that meet limits and ties."""

import datetime

import duckdb

from folioflow.operators import sheets as G
from folioflow.plans.registry import ORACLE_SQL, QUERIES


def answers(spark, folder, name, table, rows, schema):
    """What a query and its SQL say of a table of these rows."""
    spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = c.execute(ORACLE_SQL[name])
    columns, said = [x[0] for x in want.description], want.fetchall()
    return sorted(map(tuple, QUERIES[name](spark, f"file://{folder}").select(*columns).collect())), sorted(said)


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event(i, user, value):
    return (i, datetime.datetime(2024, 1, 1), user, "view", value, "{}")


def test_margin_limits_are_exact(spark, tmp_path):
    """F8: 24 + 0.35 * 71 is 48.85, a little less in doubles."""
    rows = [event(36, 4, 48.85), event(1, 4, 30.0), event(36 + 37, 1, 46.9), event(2, 1, 30.0), event(36 + 74, 4, 48.86), event(36, 3, 15.8), event(36, 3, 15.79)]
    got, want = answers(spark, tmp_path, "geo18_margin_choice", "events", rows, EVENTS)
    assert got == want == [(1, 46.9), (3, 15.8), (4, 48.85)]
    doubles = spark.createDataFrame([("p", 30.0, 1, 20.0, 95.0), ("p", 46.25, 1, 20.0, 95.0)], "page string, x double, prominence int, x_min double, x_max double")
    assert G.margin_choice(doubles).collect() == [("p", 30.0)]


def test_verdict_rounds_ties_as_its_sql(spark, tmp_path):
    """201 of 400 is 0.5025, which scaled by 1000 falls short of a tie; medians of (value * 7) % 11 - 5 likewise."""
    weak = lambda i, n: i * 10 + (0 if i < n else 9)
    rows = [event(weak(i, n), page, 1.0 if i < n else 0.0) for page, n in ((0, 201), (1, 203), (2, 202)) for i in range(400)]
    rows += [event(i, 3, 2.85) for i in range(20)] + [event(i, 4, 2.85 if i % 2 else 0.15) for i in range(40)] + [event(i, 5, 1.0) for i in range(19)]
    got, want = answers(spark, tmp_path, "agg14_fit_verdict", "events", rows, EVENTS)
    assert got == want and len(got) == 5
    assert [r[2:4] for r in got[:3]] == [(0.502, 0.502), (0.507, 0.507), (0.505, 0.505)]


def test_lines_in_quad_are_counted_without_a_second_copy(spark, tmp_path):
    """lines are many times the quads that size estimates go by, so no side of them may be joined or broadcast."""
    rows = [(k % 40, 1 + k % 50) for k in range(60)]
    got, want = answers(spark, tmp_path, "geo7_lines_in_quad", "part", rows, "p_partkey long, p_size int")
    assert got == want and max(r[5] for r in got) > 20
    plan = QUERIES["geo7_lines_in_quad"](spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange") == 1
