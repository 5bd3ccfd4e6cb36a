"""The worked examples of occupancy: one frame thread and one worker, times in microseconds."""

from chronoloom.operators import occupancy as op


def test_solo_others_peak_and_contention(spark):
    # thread 2: a scope that waits and locks inside, then another; thread 4: work, then a lock
    rows = [
        (2, "busy", 1_002_000, 1_018_000), (2, "busy", 1_010_000, 1_014_000), (2, "wait", 1_010_000, 1_014_000), (2, "busy", 1_014_000, 1_016_000), (2, "lock", 1_014_000, 1_016_000), (2, "busy", 1_022_000, 1_030_000),
        (4, "busy", 1_005_000, 1_012_000), (4, "busy", 1_015_000, 1_017_000), (4, "lock", 1_015_000, 1_017_000), (7, "busy", 2_000_000, 2_000_010),
    ]
    spans = spark.createDataFrame(rows, "tid int, kind string, b long, e long").repartition(3)
    frames = spark.createDataFrame([(0, 2, 1_000_000, 1_020_000), (1, 2, 1_020_000, 1_060_000)], "frame_id int, tid int, b long, e long")
    threads, made = op.occupancy(spans, frames, [])
    assert {r.frame_id: (r.solo, r.others_work, r["all"], r.peak, r.contended) for r in made.collect()} == {0: (5_000, 9_000, 16_000, 2, 1_000), 1: (8_000, 0, 8_000, 1, 0)}
    assert {(r.frame_id, r.tid): (r.busy, r.wait, r.lock) for r in threads.collect()} == {(0, 2): (16_000, 4_000, 2_000), (0, 4): (9_000, 0, 2_000), (1, 2): (8_000, 0, 0)}
    totals = op.thread_totals(spans, [])
    assert {r.tid: (r.spans, r.busy, r.wait, r.lock) for r in totals.collect()} == {2: (2, 24_000, 4_000, 2_000), 4: (2, 9_000, 0, 2_000), 7: (1, 10, 0, 0)}
    assert {r.tid: (r.frames, r.busy, r.elsewhere) for r in op.beside(threads, totals, []).collect()} == {2: (2, 24_000, False), 4: (1, 9_000, False), 7: (0, 0, True)}


def test_covered_and_waiting_by_the_frame_a_scope_ends_in(spark):
    frames = spark.createDataFrame([(0, 1_000_000, 1_020_000), (1, 1_020_000, 1_080_000)], "frame_id int, f_b long, f_e long")
    scopes = spark.createDataFrame([(False, 1_002_000, 1_010_000), (True, 1_012_000, 1_018_000), (False, 1_019_000, 1_070_000), (True, 1_030_000, 1_050_000), (False, 2_000_000, 2_000_001)], "waits boolean, b long, e long")
    assert {r.frame_id: (r.covered, r.waiting) for r in op.coverage(scopes, frames, []).collect()} == {0: (14_000, 6_000), 1: (50_000, 20_000)}
