"""Capture queries on small tables made by hand."""

import datetime

from chronoloom.plans import captures

DAY = datetime.datetime(2026, 1, 1)
SCHEMAS = {
    "captures": "capture_id long, app string, platform string, build_version string, started_at timestamp, start_cycle long, cycle_frequency long, frame_count long, mean_ms double, p50_ms double, p95_ms double, p99_ms double, over_budget long, hitches long, ingested_at timestamp",
    "frames": "frame_id long, capture_id long, tid int, frame_type int, begin_cycle long, end_cycle long, ingested_at timestamp",
    "csv_values": "value_id long, capture_id long, tid int, seq long, cycle long, stat int, kind string, value double, op int, ingested_at timestamp",
    "nodes": "node_id long, capture_id long, frame_id long, tid int, spec long, name string, parent_node_id long, inclusive long, ingested_at timestamp",
}


def tables(spark, folder, **rows):
    """Writes each table; rows are dicts, and columns they leave out are null."""
    for name, schema in SCHEMAS.items():
        names = [c.split()[0] for c in schema.split(", ")]
        made = [tuple({"ingested_at": DAY, **r}.get(c) for c in names) for r in rows.get(name, [])]
        spark.createDataFrame(made, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def node(id_, frame, spec, inclusive, parent=None, name=None):
    return {"node_id": id_, "capture_id": 1, "frame_id": frame, "tid": 2, "spec": spec, "name": name, "parent_node_id": parent, "inclusive": inclusive}


def test_frame_work_counts_nested_timers(spark, tmp_path):
    # frame 1 of the fixture 'work': Tick holds FrameTime
    folder = tables(
        spark,
        tmp_path,
        captures=[{"capture_id": 1, "app": "a", "started_at": DAY, "cycle_frequency": 1_000_000}],
        frames=[{"frame_id": 1, "capture_id": 1, "tid": 2, "frame_type": 0, "begin_cycle": 1_020_000, "end_cycle": 1_080_000}],
        nodes=[node(1, 1, 7, 45_000), node(2, 1, 8, 20_000, 1), node(3, 1, 9, None, 1), node(4, 1, 8, -5, 1)],
    )
    got = captures.frame_work_topn(spark, folder).orderBy("place").collect()
    assert [(r.spec, r.cycles, r.place) for r in got] == [(7, 45_000, 1), (8, 20_000, 2)]


def test_candidates_take_nested_timers_against_the_span_of_the_frames(spark, tmp_path):
    folder = tables(
        spark,
        tmp_path,
        captures=[{"capture_id": 1, "app": "a", "started_at": DAY, "cycle_frequency": 1_000_000}],
        frames=[
            {"frame_id": 1, "capture_id": 1, "tid": 2, "frame_type": 0, "begin_cycle": 0, "end_cycle": 60_000},
            {"frame_id": 2, "capture_id": 1, "tid": 2, "frame_type": 0, "begin_cycle": 60_000, "end_cycle": 100_000},
        ],
        nodes=[
            node(1, 1, 7, 50_000, None, "Tick"), node(2, 1, 8, 45_000, 1, "Physics"), node(3, 1, 9, 44_000, 2, "RenderThreadSync"),
            node(4, 1, 10, 43_000, 3, "DispatchAll"), node(5, 1, 11, 42_000, 4, "LockFreeList"), node(6, 1, 12, 41_000, 5, "ConcurrentBag"),
            node(7, 2, 13, 24_000, None, "Small"), node(8, 2, 14, 25_000, None, "Quarter"),
        ],
    )
    got = captures.candidates(spark, folder).orderBy("place").collect()
    assert [(r.name, r.cycles, r.share, r.place) for r in got] == [("Tick", 50_000, 0.5, 1), ("Physics", 45_000, 0.45, 2), ("Quarter", 25_000, 0.25, 3)]


def test_csv_series_combines_by_op_in_order(spark, tmp_path):
    def values(stat, *said, kind="custom"):
        return [{"value_id": 100 * stat + i, "capture_id": 1, "tid": 2, "seq": i, "cycle": 10 + i, "stat": stat, "kind": kind, "value": float(v), "op": op} for i, (v, op) in enumerate(said)]

    folder = tables(
        spark,
        tmp_path,
        frames=[{"frame_id": 1, "capture_id": 1, "tid": 2, "frame_type": 0, "begin_cycle": 0, "end_cycle": 100}],
        csv_values=values(1, (5, 1), (3, 1), (4, 1))
        + values(2, (5, 2), (9, 2), (4, 2))
        + values(3, (5, 3), (-2, 3), (4, 3))
        + values(4, (5, 0), (7, None))
        + values(5, (50, 3), (5, 0), (2, 3), (4, 1), (6, 2), (1, 3))
        + values(6, (1, None), (2, None), kind="timer"),
    )
    got = {r.stat: (r.frame_id, r.n, r.value) for r in captures.csv_series(spark, folder).collect()}
    assert got == {1: (1, 3, 3.0), 2: (1, 3, 9.0), 3: (1, 3, 7.0), 4: (1, 2, 7.0), 5: (1, 6, 7.0), 6: (1, 2, 3.0)}
