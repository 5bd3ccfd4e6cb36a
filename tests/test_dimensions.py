"""The tables of a capture from hand-made events, and what the source says of a whole file."""

import struct

import pytest

from chronoloom.operators import gpu, tasks
from chronoloom.sources import dimensions as dim
from chronoloom.sources.capture import TABLES, CaptureSource
from test_sources import aux, capture_bytes, declare, number, packet

EVENTS = TABLES["events"]


@pytest.fixture
def made(spark):
    def rows(*said):
        out = []
        for i, (tid, logger, name, values) in enumerate(said):
            whole = {k: v for k, v in values.items() if isinstance(v, int)}
            text = {k: v for k, v in values.items() if isinstance(v, str)}
            raw = {k: bytearray(v) for k, v in values.items() if isinstance(v, bytes)}
            real = {k: v for k, v in values.items() if isinstance(v, float)}
            out.append(("f", tid, i, 10 + i if tid > 1 else None, 16, logger, name, whole, real, text, raw))
        return spark.createDataFrame(out, EVENTS).repartition(3)

    return rows


def test_session_threads_and_timers(made):
    events = made(
        (1, "$Trace", "NewTrace", {"StartCycle": 5, "CycleFrequency": 1000, "StartDateTime": 2.5}), (1, "$Trace", "ThreadGroupBegin", {"Name": "Pool"}), (1, "$Trace", "ThreadInfo", {"ThreadId": 4, "Name": "Worker"}),
        (1, "$Trace", "ThreadGroupEnd", {}), (1, "$Trace", "ThreadInfo", {"ThreadId": 2, "Name": "GameThread", "SystemId": 77}), (1, "Diagnostics", "Session2", {"Platform": "Linux", "AppName": "demo", "Changelist": 9}),
        (1, "CpuProfiler", "EventSpec", {"Id": 7, "Name": "Tick", "File": "a.cpp", "Line": 3}), (1, "CpuProfiler", "EventSpec", {"Id": 7, "Name": "WaitForAll", "Line": 4}), (1, "CpuProfiler", "EventSpec", {"Name": "lost"}),
        (2, "CpuProfiler", "EndThread", {"Cycle": 99}), (9, "Misc", "Bookmark", {"Cycle": 1}),
    )
    s = dim.session(events).first()
    assert (s.start_cycle, s.cycle_frequency, s.endian, s.start_date_time, s.platform, s.app, s.changelist, s.gpu_channel_version) == (5, 1000, 0, 2.5, "Linux", "demo", 9, None)
    assert {(r.id, r.name, r.group, r.role, r.events, r.end_cycle, r.system_id) for r in dim.threads(events).collect()} == {(4, "Worker", "Pool", None, 0, None, None), (2, "GameThread", "", "game", 1, 99, 77), (9, "", "", None, 1, None, None)}
    timers = dim.timers(events)
    assert [tuple(r) for r in timers.collect()] == [("f", 7, "WaitForAll", "", 4, "wait")]
    rows = events.selectExpr("path", "cast(7 + seq % 2 as bigint) as spec").distinct()
    assert {(r.spec, r.name) for r in dim.named(rows, timers).collect()} == {(7, "WaitForAll"), (8, "spec 8")}


def test_specs_marks_and_misses(made):
    events = made(
        (1, "GpuProfiler", "EventSpec", {"EventType": 3, "Name": "Pass\0".encode("utf-16-le")}), (1, "GpuProfiler", "QueueSpec", {"QueueId": 0x030201, "TypeString": "Copy"}),
        (1, "GpuProfiler", "EventBreadcrumbSpec", {"SpecId": 1, "StaticName": "Shadow"}), (1, "GpuProfiler", "EventBreadcrumbSpec", {"SpecId": 2, "NameFormat": "%s", "FieldNames": b"abc"}), (1, "GpuProfiler", "EventBreadcrumbSpec", {"SpecId": 3}),
        (1, "Misc", "BookmarkSpec", {"BookmarkPoint": 5, "FormatString": "Load", "Line": 8}), (2, "Misc", "Bookmark", {"Cycle": 10, "BookmarkPoint": 5}), (2, "Misc", "Bookmark", {"Cycle": 11, "BookmarkPoint": 6}),
        (1, "Counters", "Spec", {"Id": 1, "Name": "c"}), (2, "Counters", "SetValueInt", {"CounterId": 1}), (2, "Counters", "SetValueFloat", {"CounterId": 1}), (1, "CsvProfiler", "RegisterCategory", {"Index": 0, "Name": "Game"}),
        (1, "CsvProfiler", "DefineDeclaredStat", {"StatId": 7, "Name": "FrameTime", "CategoryIndex": 0}), (1, "CsvProfiler", "DefineInlineStat", {"StatId": 9, "Name": "Draws", "CategoryIndex": 4}), (1, "Trace", "ChannelAnnounce", {"Id": 1, "Name": "Cpu", "IsEnabled": 1}),
        (2, "Misc", "BeginFrame", {"Cycle": 100, "FrameType": 1}), (2, "Misc", "EndFrame", {"Cycle": 120, "FrameType": 1}),
    )
    one = lambda df, *names: sorted(tuple(r[n] for n in names) for r in df.collect())
    assert one(dim.gpu_specs(events), "id", "name") == [(3, "Pass")] and one(dim.gpu_queues(events), "gpu", "index", "type", "name") == [(2, 3, 1, "Copy")]
    assert one(dim.crumb_specs(events), "id", "shown", "fields") == [(1, "Shadow", 0), (2, "%s", 3), (3, "spec 3", 0)]
    held, missed = dim.bookmarks(events)
    assert one(held, "cycle", "name", "line") == [(10, "Load", 8)] and missed.first().unknown == 1
    assert one(dim.counters(events), "id", "values") == [(1, 2)] and one(dim.csv_stats(events), "id", "kind", "category") == [(7, "declared", "Game"), (9, "inline", None)]
    assert one(dim.channels(events), "name", "is_enabled", "read_only") == [("Cpu", True, False)] and one(dim.frame_marks(events), "type", "cycle", "d") == [(1, 100, 1), (1, 120, -1)]


def test_events_reach_the_operators(made):
    events = made(
        (2, "GpuProfiler", "EventBeginWork", {"QueueId": 0, "GPUTimestampTOP": 10, "CPUTimestamp": 8}), (2, "GpuProfiler", "EventEndWork", {"QueueId": 0, "GPUTimestampBOP": 25}), (2, "GpuProfiler", "EventWait", {"QueueId": 0, "StartTime": 25, "EndTime": 27}),
        (2, "GpuProfiler", "WaitFence", {"QueueId": 0, "QueueToWaitForId": 2}), (2, "TaskTrace", "Init", {}), (2, "TaskTrace", "Launched", {"TaskId": 1, "Timestamp": 5, "TaskSize": 48, "DebugName": "Job", "ThreadToExecuteOn": 1, "Tracked": 1}),
        (4, "TaskTrace", "Started", {"TaskId": 1, "Timestamp": 6}), (4, "TaskTrace", "Finished", {"TaskId": 1, "Timestamp": 16}), (2, "TaskTrace", "WaitingStarted", {"Timestamp": 7, "Tasks": bytes(16)}), (2, "TaskTrace", "WaitingFinished", {"Timestamp": 17}), (2, "TaskTrace", "Started", {"Timestamp": 6}),
    )
    row = gpu.queue_rows(dim.gpu_events(events), ["path"]).first()
    assert (row.queue, row.work_spans, row.busy_us, row.wait_us, row.lag_total_us) == (0, 1, 15, 2, 2) and [r.other for r in gpu.fences(dim.gpu_events(events), ["path"]).collect()] == [2]
    said = dim.task_events(events)
    task = tasks.lifecycle(said, ["path"]).withColumn("duration", tasks.duration()).first()
    assert (task.task, task.name, task.size, task.tracked, task.started_tid, task.duration) == (1, "Job", 48, True, 4, 10)
    assert [(r.begin, r.end) for r in tasks.waits(said, ["path"])[0].collect()] == [(7, 17)] and said.where("kind = 'WaitingStarted'").first().other == 2


def test_info_frames_of_the_older_channel_and_verification(spark, tmp_path):
    spark.dataSource.register(CaptureSource)
    blob = number(3 << 1 | 1) + struct.pack("<I", 7) + number(10 << 1)
    types = declare(30, "GpuProfiler", "Frame", [("TimestampBase", "u64"), ("RenderingFrameNumber", "u32"), ("Data", "arr")], 2 | 4)
    thread = b"\x3d\x00" + struct.pack("<QI", 1000, 5) + aux(2, blob) + b"\x06" + b"\x3d\x00" + struct.pack("<QI", 2000, 6) + aux(2, blob[:3]) + b"\x06"
    paths = []
    for name, extra in (("a", packet(0, types) + packet(3, thread)), ("b", packet(5, b"\x41\x01"))):
        paths.append(str(tmp_path / name))
        with open(paths[-1], "wb") as file:
            file.write(capture_bytes(extra=extra))
    read = lambda table, **o: spark.read.format("capture").options(table=table, **o).load(",".join(paths))
    info = {r.path[-1]: (r.magic, r.transport, r.protocol, r.port, r.session, r.packets, r.lz4, r.sync) for r in read("info").collect()}
    assert info["a"] == ("2CRT", 4, 7, 1985, bytes(range(16)).hex(), 6, 1, 1) and info["b"][5] == 5
    records = read("gpu_records", splits="3")
    assert sorted((r.frame, r.number, r.t, r.spec, r.d, r.truncated) for r in records.collect() if r.d is not None) == [(0, 5, 1003, 7, 1, False), (0, 5, 1013, None, -1, False)]
    assert [(r.frame, r.truncated) for r in records.collect() if r.d is None] == [(1, True)]
    assert gpu.decoded_frames(records.where("d is not null"), ["path", "frame"]).first().busy_us == 10
    for splits in ("1", "4"):
        assert read("events", splits=splits).count() == read("events").count()
    checked = {r.path[-1]: (r.errors, r.ok, r.missing) for r in dim.verified(read("events"), read("anomalies")).collect()}
    assert checked == {"a": (0, True, 0), "b": (1, False, 0)}
    assert {(r.form, r.packets) for r in dim.packets_of(read("packets"), 2).collect()} == {("raw", 1)}
