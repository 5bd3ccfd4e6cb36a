import struct

import pytest
from pyspark.sql import functions as F

from chronoloom.operators.pairing import stack_pairs
from chronoloom.sources import render, store
from chronoloom.sources.capture import Capture, CaptureError, CaptureSource, absolute, batch, lz4_length, type_name, varint

KINDS = {"u8": (0, 1), "u16": (1, 2), "u32": (2, 4), "u64": (3, 8), "i32": (0x12, 4), "f64": (0x43, 8), "s": (0x88, 0), "ws": (0x89, 0), "arr": (0x80, 0)}


def number(value):
    out = b""
    while True:
        byte, value = value & 127, value >> 7
        out += bytes((byte | (128 if value else 0),))
        if not value:
            return out


def declare(uid, logger, name, fields, flags):
    heads, names, at = b"", (logger + name).encode(), 0
    for field, kind in fields:
        byte, size = KINDS[kind]
        heads += struct.pack("<BBHHBB", 0, 0x70, at, size, byte, len(field))
        names += field.encode()
        at += size
    body = struct.pack("<HBBBB", uid, len(fields), flags, len(logger), len(name)) + heads + names
    return struct.pack("<HH", 0, len(body)) + body


def aux(index, data, shift=1, end=b""):
    return bytes((1 << shift, index & 31 | (len(data) & 7) << 5)) + struct.pack("<H", len(data) >> 3) + data + end


def literals(data):
    rest = len(data) - 15
    return (bytes((len(data) << 4,)) if rest < 0 else b"\xf0" + b"\xff" * (rest // 255) + bytes((rest % 255,))) + data


def packet(tid, payload, encoded=False):
    body = struct.pack("<H", len(payload)) + literals(payload) if encoded else payload
    return struct.pack("<HH", 4 + len(body), tid | 0x8000 * encoded) + body


def capture_bytes(*, extra=b"", encoded=True):
    types = (
        declare(16, "$Trace", "NewTrace", [("StartCycle", "u64"), ("CycleFrequency", "u64")], 4)
        + declare(17, "CpuProfiler", "EventSpec", [("Id", "u32"), ("Name", "s")], 1 | 2 | 4)
        + declare(18, "CpuProfiler", "EventBatchV2", [("Data", "arr")], 2 | 4)
        + declare(19, "Misc", "BeginFrame", [("Cycle", "u64"), ("FrameType", "u8")], 0)
        + declare(20, "Logging", "Text", [("Text", "ws"), ("Delta", "i32"), ("Value", "f64")], 2 | 4)
    )
    spec = struct.pack("<I", 7) + aux(1, b"Tick", 0, b"\x03")
    importants = struct.pack("<HHQQ", 16, 16, 1_000_000, 1_000_000) + struct.pack("<HH", 17, len(spec)) + spec
    data = number(1_000_100 << 2 | 1) + number(7) + number(20 << 2 | 1) + number(300) + number(5 << 2) + number(30 << 2 | 3) + number(9) + number(1)
    thread = b"\x25\x00" + aux(0, data[:5]) + aux(0, data[5:]) + b"\x06"
    thread += bytes((4 << 1,)) + struct.pack("<Q", 55 << 8 | 6 << 1)
    thread += b"\x27\x00" + b"\x05\x00\x01" + struct.pack("<QB", 1_000_050, 0)
    thread += b"\x25\x00" + aux(0, number(40 << 2)) + b"\x06"
    thread += b"\x29\x00" + struct.pack("<id", -3, 2.5) + aux(0, "hé".encode("utf-16-le")) + b"\x06"
    fields = struct.pack("<HH", 2 | 0 << 8, 1985) + struct.pack("<H", 16 | 1 << 8) + bytes(range(16))
    return b"2CRT" + struct.pack("<H", len(fields)) + fields + bytes((4, 7)) + packet(0, types, encoded) + packet(1, importants) + packet(2, thread) + struct.pack("<HH", 4, 0x3FFF) + extra


def test_header_and_refusals():
    made = Capture.open(capture_bytes())
    assert made.metadata()[0] == struct.pack("<H", 1985) and made.versions() == (4, 7)
    assert [p[3] for p in made.packets] == ["lz4", "raw", "raw", "sync"] and made.threads() == [0, 1, 2]
    for bad in (b"short", b"ECRT" + bytes(20), b"ABCD" + bytes(20)):
        with pytest.raises(CaptureError):
            Capture.open(bad)
    old = Capture.open(b"TRC2" + capture_bytes()[4:])
    assert old.anomalies[0][1] == "old-magic" and len(old.types()) == 5


def test_cut_files_report_and_stop():
    made = Capture.open(capture_bytes(extra=struct.pack("<HH", 900, 2)))
    assert made.anomalies[-1][1] == "packet" and len(made.packets) == 4
    assert lz4_length(literals(b"x" * 300)) == 300 and lz4_length(b"\xf0") == -1
    with pytest.raises(ValueError):
        varint(b"\xff\xff", 0)
    assert batch(number(8 << 2 | 1)) == ([], "a number runs past its end")
    assert absolute([100, 20, 5, 300]) == [100, 120, 125, 300] and type_name(0x13) == "i64" and type_name(0) == "bool"


def test_source_tables(spark, tmp_path):
    path = str(tmp_path / "one.bin")
    for encoded in (True, False):
        with open(path, "wb") as file:
            file.write(capture_bytes(encoded=encoded))
        spark.dataSource.register(CaptureSource)
        table = lambda t: spark.read.format("capture").option("table", t).load(path)
        assert table("packets").where("form = 'sync'").count() == 1
        assert {r.full_name: r.size for r in table("types").collect()}["Misc.BeginFrame"] == 9
        rows = {(r.tid, r.name): r for r in table("events").collect()}
        assert rows[1, "EventSpec"].text == {"Name": "Tick"} and rows[1, "NewTrace"].whole["CycleFrequency"] == 1_000_000
        assert rows[2, "BeginFrame"].serial == 0x010005 and rows[2, "Text"].text == {"Text": "hé"} and rows[2, "Text"].real == {"Value": 2.5} and rows[2, "Text"].whole == {"Delta": -3}
        cpu = [(r.cycle, r.spec, r.d) for r in table("records").orderBy("seq").collect()]
        assert cpu == [(1_000_100, 7, 1), (1_000_120, 300, 1), (1_000_125, None, -1), (1_000_155, None, 1), (1_000_195, None, -1)]
        assert table("anomalies").count() == 0
        pairs = {r.seq: (r.level, r.end_time) for r in stack_pairs(table("records"), ["tid"]).collect()}
        assert pairs == {0: (1, None), 1: (2, 1_000_125), 3: (2, 1_000_195)}
    with open(path, "wb") as file:
        file.write(capture_bytes(extra=packet(5, b"\x41\x01")))
    assert [(r.tid, r.kind) for r in table("anomalies").collect()] == [(5, "unknown-uid")]


def test_store_keeps_for_the_same_bytes_only(spark, tmp_path):
    source, folder = tmp_path / "f.bin", str(tmp_path / "kept")
    source.write_bytes(b"abc")
    who = store.identity(str(source))
    assert store.load(spark, folder, who) is None and not store.clear(folder)
    store.save({"t": spark.range(3)}, folder, who)
    assert store.load(spark, folder, who)["t"].count() == 3
    source.write_bytes(b"abd")
    assert store.load(spark, folder, store.identity(str(source))) is None and store.clear(folder)


def test_renderers(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, None), ("c", 20.0, 3)], "name string, x double, n long")
    assert render.rows_as(df, "csv") == "name,x,n\na|b,1.5,-\nc,20,3\n"
    assert "a\\|b" in render.rows_as(df, "markdown") and render.rows_as(df).splitlines()[1].startswith("a|b")
    assert render.graph_as([(1, "A"), (2, 'B"')], [(1, 2), (1, 2)]) == 'digraph {\n  rankdir=LR\n  n0 [label="A"]\n  n1 [label="B\\""]\n  n0 -> n1\n}\n'
    assert render.graph_as([(1, "A")], [], "mermaid").startswith("flowchart LR") and '"edges": []' in render.graph_as([(1, "A")], [], "json")
    path = str(tmp_path / "b.json")
    render.write_baseline(spark.createDataFrame([("p50", 1.0), ("gone", None)], "key string, value double"), path)
    assert render.read_baseline(path) == {"gone": None, "p50": 1.0}
    values = spark.createDataFrame([(0, "B,b", 1.0), (1, "A", 0.05)], "frame long, series string, value double")
    events = spark.createDataFrame([(1, "load;x")], "frame long, name string")
    out = str(tmp_path / "f.csv")
    render.write_frame_csv(values, events, [0, 1, 2], out, {"platform": "x,y"})
    assert open(out).read().splitlines() == ["EVENTS,A,B.b", ",0,1", "load.x,0.050000,0", ",0,0", "[platform],x.y"]
    stamped = spark.createDataFrame([(1, "load;x", 2.5), (1, "a", 0.25)], "frame long, name string, seconds double")
    render.write_frame_csv(values, stamped, spark.range(1, 2).withColumnRenamed("id", "frame"), out, {})
    assert open(out).read().splitlines()[1] == "a##0.250000;load.x##2.500000,0.050000,0"
    found = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 1, "c")], "capture_id long, place int, rule string")
    assert '"rule": "a"' in render.advice_json(found, 1, {"budget": 60}) and '"c"' not in render.advice_json(found, 1, {})
    compared = spark.createDataFrame([("x", "k1", 1.0, 2.0, "worse"), ("x", "k0", 1.0, 1.0, "same")], "app string, key string, before double, after double, verdict string")
    assert '"passed": false' in render.comparison_as(compared, "x") and render.comparison_as(compared, "x", "markdown").splitlines()[2].startswith("| k1")
    assert F is not None
