"""Schemas that drift between files: one consistent table, and a report of each change.

A declaration is the list of fields (name, offset, type) that one header gives for one record type. Headers are read in
parallel, types are folded through a promotion lattice, rows are cast to the union schema, and each declaration is
compared with the one before it in order. A list of fields is written once and named by its shape, a hash of it:
declarations travel as shapes, and lists are compared once for each pair of shapes that follow one another, as there are
few of them however many declarations there are. Everything but the reading of file footers is expressions that the JVM
runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators.hot import HOT, Cut
from chronoloom.session import cut_lineage

#: Where each type goes when it meets one it does not hold: the edges of the lattice, upwards, to types that hold every
#: value exactly. 'i128' is not on the wire: it is what holds both u64 and i64. WideString is the top. Any two types have
#: one least type above them, so a u32 and a float meet at the top: with an edge from u32 to f64, u32 and i8 would have two.
PARENTS = {
    "bool": ("u8", "i8"),
    "u8": ("u16", "i16"),
    "u16": ("u32", "i32"),
    "u32": ("u64", "i64"),
    "u64": ("i128",),
    "i8": ("i16",),
    "i16": ("i32", "f32"),
    "i32": ("i64", "f64"),
    "i64": ("i128",),
    "i128": ("WideString",),
    "f32": ("f64",),
    "f64": ("WideString",),
    "AnsiString": ("WideString",),
    "Array": ("WideString",),
    "WideString": (),
}
TOP = "WideString"
#: The same for the columns of files, by the names of Spark's types. A bigint and a double meet in a string, since neither
#: a double nor a decimal holds all of both.
COLUMN_PARENTS = {
    "boolean": ("string",),
    "tinyint": ("smallint",),
    "smallint": ("int", "float"),
    "int": ("bigint", "double"),
    "bigint": ("decimal(38,18)",),
    "float": ("double",),
    "double": ("string",),
    "decimal(38,18)": ("string",),
    "date": ("timestamp_ntz",),
    "timestamp_ntz": ("string",),
    "timestamp": ("string",),
    "binary": ("string",),
    "string": (),
}


def _above(parents: dict[str, tuple[str, ...]], kind: str) -> dict[str, int]:
    """Types that hold a type, with the least number of steps up to each."""
    found, edge = {kind: 0}, [kind]
    while edge:
        edge = [p for k in edge for p in parents.get(k, ()) if found.setdefault(p, found[k] + 1) == found[k] + 1]
    return found


def promote(a: str, b: str, parents: dict[str, tuple[str, ...]] = PARENTS, top: str = TOP) -> str:
    """The least type that holds both; the top where an unknown type meets another. Commutative and idempotent."""
    if a == b:
        return a
    left, right = _above(parents, a), _above(parents, b)
    shared = left.keys() & right.keys()
    return min(shared, key=lambda k: (max(left[k], right[k]), left[k] + right[k], k), default=top)


def folded_type(kinds: Column, parents: dict[str, tuple[str, ...]] = PARENTS, top: str = TOP) -> Column:
    """The lattice join of an array of type names, an expression: sorted first, so that any order gives one result."""
    table = F.create_map(*[F.lit(x) for a in parents for b in parents for x in (f"{a}|{b}", promote(a, b, parents, top))])
    known = F.filter(F.array_sort(F.array_distinct(kinds)), lambda k: k.isNotNull())
    step = lambda acc, k: F.when(acc == k, acc).otherwise(F.coalesce(F.element_at(table, F.concat(acc, F.lit("|"), k)), F.lit(top)))
    return F.aggregate(known, F.element_at(known, 1), step)


def _fields(column: str, name: str, offset: str, kind: str) -> Column:
    return F.transform(F.col(f"`{column}`"), lambda x: F.struct(x[name].alias("name"), x[offset].cast("long").alias("offset"), x[kind].alias("type_name")))


_LIST = "array<struct<name: string, offset: bigint, type_name: string>>"


def shaped(df: DataFrame, fields: str = "fields", name: str = "name", offset: str = "offset", kind: str = "type_name") -> tuple[DataFrame, DataFrame]:
    """df with _shape in the place of fields, and the table _shape, fields (name, offset, type_name) of every list there is.

    Two lists are taken for equal where the 64-bit hashes of their names, offsets and types are.
    """
    shape = F.xxhash64(f"{fields}.{name}", F.col(f"{fields}.{offset}").cast("array<bigint>"), f"{fields}.{kind}")
    lists = df.select(shape.alias("_shape"), F.col(fields).alias("_list")).groupBy("_shape").agg(F.first("_list").alias("_list"))
    return df.withColumn("_shape", shape).drop(fields), lists.select("_shape", _fields("_list", name, offset, kind).alias("fields"))


def declarations(df: DataFrame, source: Sequence[str], record: str, seq: str, version: str, fields: str = "fields", name: str = "name", offset: str = "offset", kind: str = "type_name") -> tuple[DataFrame, DataFrame]:
    """source..., record, _shape: of several declarations of a record in one source the one with the highest seq; and the lists.

    Declarations with null fields or a null record do not count; equal seq: the last delivered, then the greater shape.
    """
    rows, lists = shaped(df.where(F.col(f"`{fields}`").isNotNull() & F.col(f"`{record}`").isNotNull()), fields, name, offset, kind)
    packed = F.max(F.struct(F.col(f"`{seq}`").alias("seq"), F.col(f"`{version}`").alias("version"), "_shape")).alias("_last")
    return rows.groupBy(*source, record).agg(packed).select(*source, record, "_last._shape"), lists


def _differences(was: Column, now: Column) -> Column:
    """The changes from one list of fields to the next: (field_name, change)."""
    same = lambda a, b: a["offset"].eqNullSafe(b["offset"]) & a["type_name"].eqNullSafe(b["type_name"])
    one_name = lambda a, b: a["name"].eqNullSafe(b["name"])
    absent = lambda some, others: F.filter(some, lambda x: ~F.exists(others, lambda y: one_name(x, y)))
    alike = lambda some, x: F.size(F.filter(some, lambda y: same(x, y)))
    nth = lambda some, x, i: F.size(F.filter(F.slice(some, 1, i + 1), lambda y: same(x, y)))
    gone, come = absent(was, now), absent(now, was)

    def said(fields: Column, change: str) -> Column:
        return F.transform(fields, lambda x: F.struct(x["name"].alias("field_name"), F.lit(change).alias("change")))

    differs = lambda x, part: F.exists(was, lambda y: one_name(x, y) & ~x[part].eqNullSafe(y[part]))
    return F.concat(
        said(F.filter(come, lambda x, i: nth(come, x, i) <= alike(gone, x)), "renamed"),
        said(F.filter(come, lambda x, i: nth(come, x, i) > alike(gone, x)), "added"),
        said(F.filter(gone, lambda x, i: nth(gone, x, i) > alike(come, x)), "removed"),
        said(F.filter(now, lambda x: differs(x, "type_name")), "retyped"),
        said(F.filter(now, lambda x: differs(x, "offset")), "moved"),
    )


def changes(declared: DataFrame, lists: DataFrame, group: str, record: str, source: str, order: Sequence[str], hot: int = HOT) -> DataFrame:
    """group, source, record, field_name, change, at, union_type: how each declaration differs from the record's one before it.

    declared has one row per source and record with _shape, lists the fields of each shape. In the order of the order
    columns within a group: a name that goes and one that comes with equal offset and type is 'renamed' (the new name; of
    several alike as many as go, in field order), else 'added' and 'removed'; a name in both is 'retyped' and/or 'moved'.
    A record whose first fields equal the last fields of another record of the group that ended before is 'type_renamed',
    with field_name ''. Names are case-sensitive. Null names and offsets compare as values; of a name declared twice in
    one list the first counts. union_type is the lattice join of all types that the field has in the group, to which its
    values are cast. No declaration, no rows; the first one of a record is no change.
    """
    one_name = lambda a, b: a["name"].eqNullSafe(b["name"])
    columns = [group, source, record]
    # of the declarations of a record only the first, the last and those that differ from the one before are looked at again
    cut = Cut(declared, [group, record], order, order[0], hot).beside("_was", F.col("_shape"), -1).beside("_next", F.col("_shape"))
    points = cut_lineage(cut.done().where("_was is null or _next is null or _was <> _shape"))
    steps = points.where("_was <> _shape")

    # each pair of shapes that follow one another is compared once
    once = lists.withColumn("fields", F.filter("fields", lambda x, i: ~F.exists(F.slice(F.col("fields"), 1, i), lambda y: one_name(x, y))))
    pairs = steps.select("_was", "_shape").distinct()
    pairs = pairs.join(once.select(F.col("_shape").alias("_was"), F.col("fields").alias("_before")), "_was").join(once.select("_shape", F.col("fields").alias("_now")), "_shape")
    pairs = pairs.select("_was", "_shape", _differences(F.col("_before"), F.col("_now")).alias("_found")).where("size(_found) > 0")
    log = steps.join(pairs, ["_was", "_shape"]).select(*columns, F.posexplode("_found").alias("at", "_row")).select(*columns, "_row.*", "at")
    union = unions(points, lists, group, record)
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col(record) == F.col("_record")) & F.col("field_name").eqNullSafe(F.col("_name"))
    log = log.join(union, same, "left").select(*columns, "field_name", "change", "at", "union_type")

    # a record that starts with the shape another one ended with: only first and last declarations meet
    place = F.struct(*order)
    begins = points.where("_was is null").select(*columns, F.col("_shape").alias("began"), place.alias("first"))
    ended = points.where("_next is null").select(group, record, F.col("_shape").alias("ended"), place.alias("last"))
    # of the records that end alike the one that ended first answers whether any ended before
    ends = ended.groupBy(F.col(group).alias("_group"), F.col("ended").alias("_ended")).agg(F.min("last").alias("_last"))
    met = F.col(group).eqNullSafe(F.col("_group")) & (F.col("began") == F.col("_ended"))
    renamed = begins.join(ends, met).where(F.col("_last") < F.col("first"))
    types = renamed.select(*columns, F.lit("").alias("field_name"), F.lit("type_renamed").alias("change"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("union_type"))
    return log.unionByName(types)


def unions(declared: DataFrame, lists: DataFrame, group: str, record: str) -> DataFrame:
    """_group, _record, _name, union_type: the lattice join of all types that each field has in the group."""
    used = declared.select(group, record, "_shape").distinct().join(lists, "_shape")
    rows = used.select(group, record, F.explode("fields").alias("_f")).groupBy(F.col(group).alias("_group"), F.col(record).alias("_record"), F.col("_f.name").alias("_name"))
    return rows.agg(F.collect_set("_f.type_name").alias("_kinds")).select("_group", "_record", "_name", folded_type(F.col("_kinds")).alias("union_type"))


def consistent_fields(declared: DataFrame, lists: DataFrame, group: str, record: str, source: str) -> DataFrame:
    """Every field of every declaration in one table: group, source, record, name, offset, type_name, union_type.

    union_type is the lattice join of all types that the field has had in the group, so every source casts to it. A null
    group or name is one of its own.
    """
    rows = declared.join(lists, "_shape").select(group, source, record, F.explode("fields").alias("_f")).select(group, source, record, "_f.*")
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col(record) == F.col("_record")) & F.col("name").eqNullSafe(F.col("_name"))
    return rows.join(unions(declared, lists, group, record), same).select(group, source, record, "name", "offset", "type_name", "union_type")


def _schema_of(path: str) -> pa.Schema:
    """The footer of a Parquet file, on any file system that its URI names; no row is read."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        system, place = fs.FileSystem.from_uri(path)
        return pq.read_schema(place, filesystem=system)
    return pq.read_schema(path)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, order) to rows (path, order, fields) from the footers."""
    from pyspark.sql.pandas.types import from_arrow_type

    kind = pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int64()), ("type_name", pa.string())]))
    for batch in batches:
        schemas = [_schema_of(p) for p in batch.column(0).to_pylist()]
        fields = [[{"name": f.name, "offset": i, "type_name": from_arrow_type(f.type, prefer_timestamp_ntz=True).simpleString()} for i, f in enumerate(s)] for s in schemas]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fields, kind)], names=["path", "at", "fields"])


def file_schemas(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, at (its place in paths) and fields of every Parquet file, the footers read in parallel."""
    listed = spark.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), "path string, at long").repartition(max(1, min(len(paths), 512)))
    return listed.mapInArrow(_footers, f"path string, at long, fields {_LIST}")


def read_union(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All files as one table of the union schema, and the ordered differences (path, field_name, change) between them.

    paths are in order. Columns missing in a file are null, types are promoted through the lattice, a column that goes
    while one of the same position and type comes is 'renamed' and its values go into the new column. Columns come in
    order of first appearance. Files of one schema are read together, so the plan grows with schemas, not with files. The
    driver, which has the paths, gets a shape for each of them, and each schema and each way it was renamed once.
    """
    heads, lists = shaped(file_schemas(spark, paths))
    heads = cut_lineage(heads.withColumn("files", F.lit("files")).withColumn("group", F.lit("")))
    lists = cut_lineage(lists)
    log = cut_lineage(changes(heads, lists, "group", "files", "path", ["at"]).withColumnRenamed("at", "_nth").join(heads.select("path", "at"), "path"))
    if not paths:
        return spark.createDataFrame([], "_empty int").drop("_empty"), log.select("at", "path", "field_name", "change")
    schemas = {r._shape: [(f.name, f.type_name, f.offset) for f in r.fields] for r in lists.collect()}
    shapes: dict[int, list[str]] = {}
    for row in heads.select("path", "_shape", "at").orderBy("at").collect():
        shapes.setdefault(row._shape, []).append(row.path)
    newer = _renames(heads, lists)

    def final(name: str, present: set[str]) -> str:
        seen = {name}
        while name in newer and newer[name] not in seen and newer[name] not in present:
            name = newer[name]
            seen.add(name)
        return name

    kinds: dict[str, list[str]] = {}
    for shape in shapes:
        present = {n for n, _, _ in schemas[shape]}
        for name, kind, _ in schemas[shape]:
            kinds.setdefault(final(name, present), []).append(kind)
    union = {n: reduce(lambda a, b: promote(a, b, COLUMN_PARENTS, "string"), sorted(set(k))) for n, k in kinds.items()}
    parts = []
    for shape, files in shapes.items():
        present = {n for n, _, _ in schemas[shape]}
        source, own = {final(n, present): n for n in present}, {n: k for n, k, _ in schemas[shape]}
        columns = [
            (F.col(f"`{source[n]}`") if own[source[n]] == kind else F.col(f"`{source[n]}`").cast(kind)).alias(n) if n in source else F.lit(None).cast(kind).alias(n)
            for n, kind in union.items()
        ]
        parts.append(spark.read.parquet(*files).select(*columns))
    return reduce(DataFrame.unionByName, parts), log.select("at", "path", "field_name", "change", "_nth").orderBy("at", "_nth").drop("_nth")


def _renames(heads: DataFrame, lists: DataFrame) -> dict[str, str]:
    """Old and new name of each renamed column, the last time it was renamed: one row for each pair of names."""
    window = Window.partitionBy("group").orderBy("at")
    steps = heads.withColumn("_was", F.lag("_shape").over(window)).where("_was is not null and _was <> _shape").groupBy("_was", "_shape").agg(F.max("at").alias("at"))
    both = steps.join(lists.select(F.col("_shape").alias("_was"), F.col("fields").alias("_before")), "_was").join(lists.select("_shape", F.col("fields").alias("_now")), "_shape")
    names = lambda c: F.transform(F.col(c), lambda x: x["name"])
    gone = F.filter("_before", lambda x: ~F.array_contains(names("_now"), x["name"]))
    come = F.filter("_now", lambda x: ~F.array_contains(names("_before"), x["name"]))
    # at one position there is one column, so what goes and what comes there are one to one
    met = F.explode(F.transform(gone, lambda g: F.struct(g["name"].alias("old"), F.try_element_at(F.filter(come, lambda c: (c["offset"] == g["offset"]) & (c["type_name"] == g["type_name"])), F.lit(1))["name"].alias("new"))))
    pairs = both.select("at", met.alias("_m")).select("at", "_m.*").where("new is not null").groupBy("old").agg(F.max_by("new", "at").alias("new"))
    return {r.old: r.new for r in pairs.collect()}
