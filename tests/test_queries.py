"""Every query of the core beside its SQL twin, on the smallest tables; skipped where these are not there."""

import os

import duckdb
import pytest

from chronoloom.plans import advice, captures, gpu, occupancy, problems, sources, tasks, traces

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = (advice, captures, gpu, occupancy, problems, sources, tasks, traces)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_results_do_not_depend_on_partitions(spark):
    for name in ("p2_found", "p4_found", "partner_frames", "csv_series"):
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name](spark, FOLDER)
            found.append(rows_of(df.columns, df.collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert found[0] == found[1], name
