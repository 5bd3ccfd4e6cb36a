"""GPU queues and tasks on small hand-made event streams."""

from chronoloom.operators import gpu, tasks

GPU = "tid int, seq long, kind string, queue long, spec long, top long, bop long, cpu long, other long, number long, draws long, primitives long"


def stream(spark, *said):
    names = [c.split()[0] for c in GPU.split(", ")]
    rows = [tuple({"tid": 2, "seq": i, "queue": 0, **e}.get(n) for n in names) for i, e in enumerate(said)]
    return spark.createDataFrame(rows, GPU).repartition(3)


def test_two_stacks_a_queue(spark):
    begin = lambda t, **k: {"kind": "BeginWork", "top": t, **k}
    end = lambda t, **k: {"kind": "EndWork", "bop": t, **k}
    crumb = lambda t, spec: {"kind": "BeginCrumb", "top": t, "spec": spec}
    done = lambda t: {"kind": "EndCrumb", "bop": t}
    events = stream(
        spark,
        begin(1002, cpu=1000), crumb(1002, 1), begin(1003, cpu=1004), crumb(1003, 2), done(1006), done(1009), end(1010), end(1010),
        {"kind": "Wait", "top": 1010, "bop": 1012}, {"kind": "Stats", "draws": 120, "primitives": 2400}, {"kind": "Boundary", "number": 1}, begin(1020), end(1026), {"kind": "Boundary", "number": 2},
        begin(0), end(1027), {"kind": "Wait", "top": 1033, "bop": 1032}, begin(1025), {"kind": "Signal"}, begin(1011, queue=2), end(1012, queue=2),
        {"kind": "WaitFence", "queue": 2, "other": 0}, {"kind": "WaitFence", "queue": 2},
    )
    queues = {r.queue: r for r in gpu.queue_rows(events, []).collect()}
    one = queues[0]
    assert (one.work_spans, one.busy_us, one.wait_spans, one.wait_us, one.submits, one.lag_total_us, one.lag_negative, one.lag_max_us, one.boundaries, one.last_frame, one.draws, one.primitives) == (3, 14, 1, 2, 4, 2, 1, 2, 2, 2, 120, 2400)
    assert queues[2].busy_us == 1
    counts = gpu.walk_counts(events.withColumn("c", events.tid), ["c"]).first()
    # unpaired: one end with no begin, one begin never closed
    assert (counts.zero_times, counts.unpaired, counts.negative, counts.out_of_order, counts.specless) == (1, 2, 1, 1, 0)
    kept, dropped = gpu.passes(events.withColumn("c", events.tid), ["c"], 1)
    assert [(r.spec, r.calls, r.inclusive_us, r.max_begin_us) for r in kept.collect()] == [(1, 1, 7, 1002)] and dropped.first().dropped == 1
    assert {tuple(r) for r in gpu.fences(events, []).collect()} == {("signal", 0, 0, 1), ("wait", 2, 0, 1)}


def test_frames_of_the_older_channel(spark):
    def frame(n, *records):
        t, out = 0, []
        for i, (delta, spec, d) in enumerate(records):
            t += delta
            out.append((n, i, t, spec, d))
        return out

    rows = frame(1, (10, 7, 1), (10, None, -1)) + frame(2, (0, 1, 1), (5, 2, 1), (5, None, -1), (5, None, -1)) + frame(3, (0, 1, 1), (10, None, -1), (10, 2, 1), (10, None, -1))
    rows += frame(4, (5, None, -1)) + frame(5, (5, 3, 1)) + frame(6, (0, 1, 1), (4_000_000_000, None, -1)) + [r for i in range(10) for r in [(7, 2 * i, 100 * i, i, 1), (7, 2 * i + 1, 100 * i + i + 1, None, -1)]]
    got = {r.f: (r.busy_us, r.depth, r.unbalanced, [tuple(p) for p in r.passes]) for r in gpu.decoded_frames(spark.createDataFrame(rows, "f int, ord long, t long, spec long, d int"), ["f"]).collect()}
    assert got[1] == (10, 1, 0, [(7, 10)]) and got[2] == (15, 2, 0, [(1, 15), (2, 5)]) and got[3] == (20, 1, 0, [(1, 10), (2, 10)])
    assert got[4] == (0, 0, 1, []) and got[5] == (0, 1, 1, []) and got[6] == (0, 0, 1, []) and got[7][3] == [(9, 10), (8, 9), (7, 8), (6, 7), (5, 6), (4, 5)]


def test_a_timeline_that_does_not_fit_is_refused(spark):
    windows = spark.createDataFrame([(c, 10 * c + i, 100 * i, 100 * i + 100) for c in (1, 2, 3) for i in range(3)], "c int, frame_id int, b long, e long")
    made = spark.createDataFrame([(1, "work", 50, 150), (1, "work", 900, 950), (1, "wait", 10, 20), (2, "work", 5, 6), (2, "work", 900, 901), (2, "work", 903, 904), (3, "work", 5000, 5001)], "c int, kind string, b long, e long")
    frames, verdict = gpu.placement(made, windows, ["c"])
    assert {(r.c, r.spans, r.placed, r.accepted) for r in verdict.collect()} == {(1, 2, 1, True), (2, 3, 1, False), (3, 1, 0, False)}
    assert {(r.frame_id, r.work_us, r.wait_us) for r in frames.collect()} == {(10, 50, 10), (11, 50, None)}


TASK = "tid int, seq long, kind string, task long, other long, stamp long, size long, text string, execute_on long, tracked boolean"


def test_lifecycle_waits_and_edges(spark):
    rows = [
        (2, 0, "Created", 1, None, 5, 40, None, None, None), (2, 1, "Launched", 1, None, 6, 48, "Job", 3, True), (4, 2, "Started", 1, None, 10, None, None, None, None), (4, 3, "Finished", 1, None, 30, None, None, None, None),
        (2, 4, "SubsequentAdded", 1, 2, 6, None, None, None, None), (2, 5, "SubsequentAdded", 1, 2, 7, None, None, None, None), (2, 6, "SubsequentAdded", 9, 2, 7, None, None, None, None),
        (4, 7, "Started", 2, None, 50, None, None, None, None), (4, 8, "Finished", 2, None, 45, None, None, None, None), (4, 9, "Started", 3, None, 60, None, None, None, None),
        (2, 10, "WaitingStarted", None, 1, 6, None, None, None, None), (2, 11, "WaitingStarted", None, 1, 8, None, None, None, None), (2, 12, "WaitingFinished", None, None, 20, None, None, None, None),
        (2, 13, "WaitingFinished", None, None, 21, None, None, None, None), (4, 14, "WaitingStarted", None, 1, 70, None, None, None, None),
    ]
    events = spark.createDataFrame(rows, TASK).repartition(4)
    made = tasks.lifecycle(events, []).withColumn("duration", tasks.duration())
    got = {r.task: (r.created, r.started, r.finished, r.name, r.size, r.execute_on, r.tracked, r.started_tid, r.duration) for r in made.collect()}
    assert got == {1: (5, 10, 30, "Job", 48, 3, True, 4, 20), 2: (None, 50, 45, None, None, None, None, 4, 0), 3: (None, 60, None, None, None, None, None, 4, None)}
    waits, unread = tasks.waits(events, [])
    assert [(r.tid, r.begin, r.end) for r in waits.collect()] == [(2, 8, 20)] and unread.first().unreadable == 2
    links = tasks.edges(events, [])
    assert {(r.task, tuple(r.prerequisites), tuple(r.subsequents)) for r in tasks.linked(made, links, []).collect()} == {(1, (), (2,)), (2, (1, 9), ()), (3, (), ())}
    assert {(r.pred, r.succ) for r in tasks.among(links, made, []).collect()} == {(1, 2)}
