import random

from pyspark.sql import functions as F

from chronoloom.operators.interval_map import IntervalMap
from chronoloom.streaming.stateful import stream_periods, stream_stack_pairs, windowed_counts


def run(spark, tmp_path, schema, batches, query, mode, name):
    folder = tmp_path / name
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        del i
    running = query(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    return spark.table(name).collect()


def test_stacks_and_maps_live_across_batches(spark, tmp_path):
    schema = "tid long, seq long, cycle long, spec string, d int"
    batches = [[(1, 0, 10, "a", 1), (1, 1, 12, "b", 1)], [(1, 2, 15, None, -1), (2, 0, 3, None, -1)], [(1, 3, 20, None, -1)]]
    # one file a batch, in order of time
    rows = run(spark, tmp_path, schema, batches, stream_stack_pairs, "append", "stacks")
    closed = {(r.tid, r.end) for r in rows}
    assert closed == {(1, 15), (2, 3), (1, 20)}
    rng = random.Random(2)
    spans = [("k", b := rng.randrange(300), b + rng.randrange(20)) for _ in range(90)]
    for shard in (10, 7_000):
        rows = run(spark, tmp_path, "entity string, b long, e long", [spans[:40], spans[40:] + spans[:5]], lambda s: stream_periods(s, shard=shard), "update", f"maps{shard}")
        whole = IntervalMap()
        for _, b, e in spans:
            whole.insert(b, e)
        last = max(rows, key=lambda r: r.covered)
        assert (last.periods, last.covered, last.gaps_us, last.first, last.last) == (len(whole.periods()), sum(e - b for b, e in whole.periods()), sum(e - b for b, e in whole.gaps()), whole.starts[0], whole.ends[-1])
    want = IntervalMap()
    for _, b, e in spans:
        want.insert(b, e)
    assert (max(r.periods + r.covered * 1000 for r in rows)) == len(want.periods()) + 1000 * sum(e - b for b, e in want.periods())


def test_windows_drop_late_rows(spark, tmp_path):
    schema = "at timestamp, k string, v double"
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = run(spark, tmp_path, schema, [[(t(1), "a", 5.0), (t(1), "a", 50.0), (t(30), "a", 1.0)], [(t(31), "a", 1.0)]], lambda s: windowed_counts(s, "at", ["k"], budget=20.0, value="v"), "append", "wins")
    assert [(r.n, r.over) for r in rows if r.window.start.minute == 1] == [(2, 1)]
    assert F is not None
