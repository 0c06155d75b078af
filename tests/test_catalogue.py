"""Every registered query with SQL equals DuckDB; the others run and give rows."""

import duckdb
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from pulsegrid.plans import catalogue

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, con, name):
    assert differences(catalogue.QUERIES[name](spark, DIR), catalogue.ORACLE[name], con) == ""


@pytest.mark.parametrize("name", ["spectral_features", "sanity_models", "native_streams", "window_features"])
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_hourly_timeline_moves_no_empty_hours(spark, tmp_path):
    """Empty hours are made after the last exchange, and gaps, null values and single hours come out as in SQL."""
    rows = [(k, f"2024-01-{1 + (k * k * 7) % 29:02d} {(k * 5) % 24:02d}:{(k * 13) % 60:02d}:00", k % 4, "error" if k % 6 == 0 else "view", None if k % 5 == 0 else float(k % 17), "{}") for k in range(90)]
    rows += [(100, "2024-01-03 05:00:00", 9, "view", None, "{}"), (101, "2024-01-01 00:00:00", 8, "error", 1.5, "{}"), (102, "2024-01-30 23:59:59", 8, "error", 2.5, "{}")]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out, con = catalogue.hourly_timeline(spark, str(tmp_path)), duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert differences(out, catalogue.ORACLE["hourly_timeline"], con) == ""
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")
