"""How often a log conversion numbers its events."""

from datetime import datetime, timedelta

from poseweave.plans import queries_text as Q
from poseweave.plans import tables as T


def test_a_log_conversion_numbers_the_events_once(spark, tmp_path, monkeypatch):
    kinds = ["click", "view", "signup", "error"]
    rows = [(run, datetime(2024, 1, 1) + timedelta(minutes=k), 100 * run + k, 150.0 + k, kinds[(run + k) % 4]) for run in (1, 2) for k in range(12)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, value double, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    asked, plain = [], T.motion_events
    monkeypatch.setattr(T, "motion_events", lambda events: asked.append(1) or plain(events))
    _, poses, relations = Q._converted(spark, str(tmp_path))
    assert len(asked) == 1
    lasers = {(r[0], r[2] + 0.5) for r in rows if r[4] != "error"}
    assert {(r["run"], r["at"]) for r in poses.collect()} <= lasers
    assert relations.count() == 20
    # The same poses as with motions read anew.
    again = sorted(map(tuple, T.poses(spark, str(tmp_path)).collect()))
    assert sorted(map(tuple, T.poses(spark, str(tmp_path), T.motions(spark, str(tmp_path))).collect())) == again
