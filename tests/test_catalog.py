"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tessellar import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver's own comparison runs them all.
SOME = (
    "q1_flagship p04_match p09_stale p10_offset s15_last_write_wins r01_rate r04_increase_with_resets r05_delta r08_changes r13_sum_over_time r19_quantile_over_time r21_predict_linear r23_absent_over_time t07_sliding_sum f09_day_of_year f15_label_replace"
    " a06_stddev a09_topk a11_count_values b05_one_to_one b07_group_left_labels b12_or h01_classic_quantile h02_native_quantile h05_fraction v03_bucket r03_rate_of_deltas d02_label_names"
).split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, database, name):
    frame = catalog.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    cursor = database.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-6, abs=1e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
