"""Machines on event time over deliveries that come out of order; each delivery is a run that starts from the checkpoint."""

import datetime

from marlstone.functions.lineage import cut_folder
from marlstone.streaming import machines as M

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_requests_expire_and_late_approvals_are_told(spark):
    asked = [("in time", "PENDING", 0), ("in time", "APPROVED", 5), ("too late", "PENDING", 0), ("too late", "APPROVED", 40), ("delayed", "PENDING", 1), ("open", "PENDING", 119), ("unasked", "APPROVED", 3)]
    later = [("clock", "PENDING", 120), ("delayed", "APPROVED", 10), ("in time", "APPROVED", 6)]
    parts = [spark.createDataFrame([(k, s, at(m)) for k, s, m in rows], "id string, status string, ts timestamp").repartition(3) for rows in (asked, later)]
    got = M.delivered(parts, lambda x: M.requests(x, "id", minutes=30, delay="1 minute")).collect()
    assert sorted(map(tuple, got)) == sorted([("in time", "APPROVED"), ("too late", "EXPIRED"), ("delayed", "EXPIRED"), ("unasked", "APPROVED"), ("delayed", "LATE"), ("in time", "LATE")])


def test_ordered_steps_over_a_restart(spark):
    events = [[(1, "a", 0, "start"), (3, "a", 70, "stop"), (4, "b", 200, "start")], [(2, "a", 40, "go"), (5, "a", 150, "start"), (6, "b", 400, "go"), (7, "a", 190, "go")], [(8, "c", 5000, "start")]]
    parts = [spark.createDataFrame([(i, k, at(m), e) for i, k, m, e in rows], "event_id long, who string, ts timestamp, event_type string") for rows in events]
    allowed = {("new", "start"), ("start", "go"), ("start", "stop"), ("stop", "start")}
    work = lambda x: M.ordered_transitions(x, "who", allowed, "new", minutes=60, idle_days=1, delay="10 minutes")
    got = {tuple(r) for r in M.delivered(parts, work).collect()}
    # 2 and 5 come when their hours are done; 7 is in an hour that waits for the watermark, though it comes last
    assert got == {("a", 1, "new", True, False), ("a", 3, "start", True, False), ("a", 2, None, None, True), ("b", 4, "new", True, False), ("a", 5, None, None, True), ("a", 7, "stop", False, False), ("b", 6, "start", True, False)}
    folder = f"{cut_folder(spark)}/again"
    parts[0].write.parquet(f"{folder}/src")
    stream = work(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/src"))
    first = M.run(stream, folder).count()
    assert M.run(stream, folder).count() == first  # nothing new: nothing is worked on twice


def test_a_step_at_the_end_of_idleness_and_many_keys_in_a_bucket(spark):
    """The watermark passes the end of a's idle time before the chunk of a's next event is done."""
    many = [(100 + i, f"k{i}", 0, "start") for i in range(40)]
    events = [[(1, "a", 0, "start"), (2, None, 0, "start"), (3, "c", 200, "start"), *many], [(4, "a", 1440, "go"), (5, None, 1441, "go"), (6, "c", 1460, "go")], [(7, "c", 5000, "start")]]
    parts = [spark.createDataFrame([(i, k, at(m), e) for i, k, m, e in rows], "event_id long, who string, ts timestamp, event_type string") for rows in events]
    allowed = {("new", "start"), ("start", "go")}
    got = {(r.event_id, r.who, r.from_state, r.valid, r.late) for r in M.delivered(parts, lambda x: M.ordered_transitions(x, "who", allowed, "new", minutes=60, idle_days=1, delay="10 minutes", buckets=2)).collect()}
    assert got == {(1, "a", "new", True, False), (2, None, "new", True, False), (3, "c", "new", True, False), (4, "a", "start", True, False), (5, None, "new", False, False), (6, "c", "start", True, False)} | {(i, k, "new", True, False) for i, k, _, _ in many}


def test_requests_of_one_bucket(spark):
    big = (1 << 60) + 1
    asked = [(i, "PENDING", 0) for i in [*range(40), big]] + [(None, "PENDING", 0), (big, "APPROVED", 29), (None, "APPROVED", 31), (-1, "PENDING", 100)]
    parts = [spark.createDataFrame([(k, s, at(m)) for k, s, m in rows], "id long, status string, ts timestamp") for rows in (asked, [(-2, "PENDING", 30_000), (5, "APPROVED", 50)])]
    got = sorted(map(str, map(tuple, M.delivered(parts, lambda x: M.requests(x, "id", minutes=30, delay="1 minute", buckets=1)).collect())))
    assert got == sorted(map(str, [*[(i, "EXPIRED") for i in range(40)], (big, "APPROVED"), (None, "EXPIRED"), (5, "LATE"), (-1, "EXPIRED")]))
