"""Null apps and names, and the query that reads drifting files."""

from chronoloom.operators.schema_drift import changes, consistent_fields, shaped
from chronoloom.plans.problems import p1_union

DECLARED = "app string, full_name string, capture_id long, at int, fields array<struct<name: string, offset: bigint, type_name: string>>"


def test_null_group_and_name_stay_in_the_table(spark):
    rows = [(None, "E.A", 1, 1, [("x", 0, "u8"), (None, 1, "u8")]), (None, "E.A", 2, 2, [("x", 0, "u16")]), ("a", "E.A", 3, 1, [(None, 0, "u8")])]
    got = consistent_fields(*shaped(spark.createDataFrame(rows, DECLARED)), "app", "full_name", "capture_id").collect()
    assert {(r.app, r.capture_id, r.name, r.union_type) for r in got} == {(None, 1, "x", "u16"), (None, 1, None, "u8"), (None, 2, "x", "u16"), ("a", 3, None, "u8")} and len(got) == 4


def test_renamed_type_of_a_null_group(spark):
    rows = [(None, "E.Old", 1, 1, [("x", 0, "u8")]), (None, "E.New", 2, 2, [("x", 0, "u8")]), ("a", "E.Other", 3, 3, [("x", 0, "u8")])]
    got = changes(*shaped(spark.createDataFrame(rows, DECLARED)), "app", "full_name", "capture_id", ["at", "capture_id"]).collect()
    assert [(r.app, r.capture_id, r.full_name, r.change) for r in got] == [(None, 2, "E.New", "type_renamed")]


def test_files_are_cast_to_the_union_of_their_schemas(spark, tmp_path):
    folder = tmp_path / "event_types.parquet"
    folder.mkdir()
    for i, (schema, row) in enumerate((("capture_id long, size int", (1, 5)), ("capture_id long, size bigint, flags int", (2, 2**40, 1)))):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        next((tmp_path / str(i)).glob("*.parquet")).rename(folder / f"{i}.parquet")
    got = p1_union(spark, str(tmp_path))
    assert got.dtypes == [("capture_id", "bigint"), ("size", "bigint"), ("flags", "int")]
    assert {tuple(r) for r in got.collect()} == {(1, 5, None), (2, 2**40, 1)}
