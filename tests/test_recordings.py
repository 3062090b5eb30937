"""Joins by time over several recordings at once equal those over each alone."""

import random

from spoor.operators import timejoin


def test_each_recording_sees_its_own(spark):
    r = random.Random(6)
    names = ["a", "b", None]
    track = [(n, r.random() * 9000, i, r.random(), r.random(), r.random()) for n in names for i in range(40)]
    frames = [(n, i, r.random() * 10_000 - 500) for n in names for i in range(30)] + [("c", 0, 5.0), ("a", 99, None)]
    t = spark.createDataFrame(track, "log string, t double, row_idx long, x double, y double, z double")
    q = spark.createDataFrame(frames, "log string, frame_id long, ts double")
    got = {(x.log, x.frame_id): (x.x, x.y, x.z) for x in timejoin.interpolated(q.where("ts IS NOT NULL"), t, by=["log"], bucket=500.0).collect()}
    near = {(x.log, x.frame_id) for x in timejoin.within_tolerance(q, t, 40.0, ts="ts", by=["log"]).collect()}
    want, close = {}, {("a", 99)}
    for n in names:
        mine, asked = t.where(t.log.eqNullSafe(n)), q.where(q.log.eqNullSafe(n) & q.ts.isNotNull())
        want |= {(n, x.frame_id): (x.x, x.y, x.z) for x in timejoin.interpolated(asked, mine).collect()}
        close |= {(n, x.frame_id) for x in timejoin.within_tolerance(asked, mine, 40.0, ts="ts").collect()}
    assert near == close
    assert got.pop(("c", 0)) == (None, None, None)
    assert got == want
