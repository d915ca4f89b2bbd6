"""Stateful progress on a stream: replays, final and expired rows, and state that leaves."""

from datetime import datetime, timedelta

from corrgrid.streaming.progress import WEIGHTS, job_events

EVENTS = "event_id long, user_id long, event_type string, ts timestamp"
START = datetime(2024, 1, 1)
at = lambda minutes: START + timedelta(minutes=minutes)


def test_jobs_end_once_and_leave(spark, tmp_path):
    stages = list(WEIGHTS)
    batches = [
        [(1, 7, stages[0], at(0)), (2, 7, stages[1], at(1)), (3, 8, stages[0], at(1)), (4, None, stages[0], at(1))],
        [(1, 7, stages[0], at(0)), (2, 7, stages[1], at(1)), (5, 7, "unknown", at(2))],  # a replay, and one new event
        [(10 + i, 7, s, at(3 + i)) for i, s in enumerate(stages[2:])],
        [(10 + i, 7, s, at(3 + i)) for i, s in enumerate(stages)],  # after the final event
        [(99, 9, stages[0], at(300))],
        [(100, 9, stages[1], at(301))],  # the watermark of the batch before fires the timers
        [(101, 9, stages[1], at(302))],
    ]
    source = str(tmp_path / "in")
    spark.createDataFrame([], EVENTS).write.parquet(source)
    stream = spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).parquet(source)
    q = job_events(stream).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "check")).start()
    held = []
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
        held.append(next(p for p in reversed(q.recentProgress) if p["stateOperators"])["stateOperators"][0]["numRowsTotal"])
    q.stop()
    got = [tuple(r) for r in spark.table("jobs").collect()]
    job = [r for r in got if r[0] == 7]
    assert [(r[1], round(r[2], 6), r[3]) for r in job] == [("progress", 0.35, 2), ("progress", 0.35, 3), ("final", 1.0, 3 + len(stages) - 2)]
    assert job[-1][4] == at(5)
    assert [(r[1], r[3]) for r in got if r[0] == 8] == [("progress", 1), ("expired", 1)]
    assert {r[0] for r in got} == {7, 8, 9}
    # Two jobs with their events; three events; the final row leaves marks only; timers leave nothing but the new job.
    assert held[:5] == [2 + 3, 2 + 4, 1 + 2, 1 + 2, 2]
