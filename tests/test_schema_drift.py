import itertools

import pytest
from pyspark.sql import functions as F

from chronoloom.operators.schema_drift import COLUMN_PARENTS, PARENTS, TOP, changes, consistent_fields, declarations, promote, read_union, shaped

DECLARED = "app string, started int, capture_id long, full_name string, fields array<struct<name:string, offset:long, type_name:string>>"


def test_lattice_is_commutative_idempotent_and_holds_both():
    for a, b in itertools.product(PARENTS, repeat=2):
        assert promote(a, b) == promote(b, a) and promote(a, a) == a
    for a, b, c in itertools.product(PARENTS, repeat=3):
        assert promote(promote(a, b), c) == promote(a, promote(b, c)), (a, b, c)
    assert promote("u8", "i8") == "i16" and promote("u32", "i32") == "i64" and promote("u64", "i64") == "i128" and promote("i32", "f32") == "f64" and promote("i64", "f64") == TOP
    assert promote("bool", "u16") == "u16" and promote("AnsiString", "u8") == TOP
    assert promote("int", "bigint", COLUMN_PARENTS, "string") == "bigint" and promote("date", "timestamp_ntz", COLUMN_PARENTS, "string") == "timestamp_ntz"


def run(spark, rows):
    df = spark.createDataFrame(rows, DECLARED)
    return sorted((r.capture_id, r.full_name, r.field_name, r.change) for r in changes(*shaped(df), "app", "full_name", "capture_id", ["started", "capture_id"]).collect())


def test_each_kind_of_change(spark):
    one = [("a", 0, "u8"), ("b", 1, "u16"), ("c", 3, "u32")]
    two = [("a", 0, "u16"), ("bb", 1, "u16"), ("d", 9, "u8"), ("A", 12, "u8")]
    got = run(spark, [("x", 1, 1, "T", one), ("x", 2, 2, "T", two), ("x", 3, 3, "T", [("a", 4, "u8"), *two[1:]])])
    assert got == sorted([(2, "T", "a", "retyped"), (2, "T", "bb", "renamed"), (2, "T", "c", "removed"), (2, "T", "d", "added"), (2, "T", "A", "added"), (3, "T", "a", "retyped"), (3, "T", "a", "moved")])


def test_renames_pair_one_to_one_and_type_renames(spark):
    old, new = [("p", 0, "s"), ("q", 0, "s")], [("r", 0, "s"), ("q", 0, "s"), ("t", 0, "s")]
    got = run(spark, [("x", 1, 1, "T", old), ("x", 2, 2, "T", new), ("x", 3, 3, "U", new), ("y", 4, 4, "V", new)])
    assert got == [(2, "T", "r", "renamed"), (2, "T", "t", "added"), (3, "U", "", "type_renamed")]


def test_nothing_from_nothing_and_order_by_time(spark):
    assert run(spark, []) == []
    assert run(spark, [("x", 9, 1, "T", [("a", 0, "u8")]), ("x", 2, 7, "T", [])]) == [(1, "T", "a", "added")]


def test_declarations_and_consistent_fields(spark):
    fields = "array<struct<name:string, offset:int, type_name:string>>"
    rows = [(1, "T", 5, 0, [("a", 0, "u8")]), (1, "T", 6, 0, [("a", 0, "i8")]), (1, "T", 9, 0, None), (2, "T", 1, 0, [("a", 0, "u8")]), (2, None, 1, 0, [("a", 0, "u8")])]
    df = spark.createDataFrame(rows, f"capture_id long, full_name string, seq long, at int, fields {fields}")
    kept, lists = declarations(df, ["capture_id"], "full_name", "seq", "at")
    kept = kept.withColumn("app", F.lit("x"))
    assert {(r.capture_id, r.fields[0].type_name) for r in kept.join(lists, "_shape").collect()} == {(1, "i8"), (2, "u8")}
    assert {(r.capture_id, r.type_name, r.union_type) for r in consistent_fields(kept, lists, "app", "full_name", "capture_id").collect()} == {(1, "i8", "i16"), (2, "u8", "i16")}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_read_union_of_drifting_files(spark, tmp_path, order):
    spark.createDataFrame([(1, 2.5, "x")], "id int, size float, gone string").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2**40, 3.5)], "id long, width float").coalesce(1).write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(5, 1.5, True)], "id long, width double, fresh boolean").coalesce(1).write.parquet(str(tmp_path / "c"))
    paths = [str(next((tmp_path / n).glob("*.parquet"))) for n in "abc"]
    table, log = read_union(spark, [paths[i] for i in order])
    assert table.count() == 3 and dict(table.dtypes)["id"] == "bigint"
    if order == (0, 1, 2):
        assert dict(table.dtypes)["width"] == "double" and {r.width for r in table.collect()} == {2.5, 3.5, 1.5}
        assert [(r.field_name, r.change) for r in log.collect()] == [("width", "renamed"), ("gone", "removed"), ("id", "retyped"), ("fresh", "added"), ("width", "retyped")]
