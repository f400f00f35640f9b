"""Reaping by timers gives what the batch rule gives, over several ticks and restarts."""

import json

from pyspark.sql import functions as F

from vellumark.operators.jobs import reap_stale
from vellumark.streaming.scheduler import reaped

EVENTS = "run_id string, kind string, ts timestamp, attempts int"


def at(s):
    return f"2024-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"


def test_stale_runs_over_ticks_and_restarts(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    seen = []

    def tick(n, *events):
        """One batch, in a query started anew on the checkpoint; what it gave so far."""
        seen.extend(events)
        (source / f"{n}.json").write_text("\n".join(json.dumps({"run_id": r, "kind": k, "ts": at(s), "attempts": a}) for r, k, s, a in events))
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
        q = reaped(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.id, r.status, r.error_message) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def batch(now):
        """The batch rule at a time, over each run's last state."""
        runs = {}
        for r, k, s, a in sorted(seen, key=lambda e: e[2]):
            if k == "claimed":
                runs[r] = [s, a]
            elif k == "over":
                runs.pop(r, None)
            elif r in runs:
                runs[r][0] = s
        rows = [(r, "s", "running", a, f"2024-01-01 {at(s)[11:19]}") for r, (s, a) in runs.items()]
        df = spark.createDataFrame(rows, "id string, source_id string, status string, attempts int, heartbeat_at string").withColumn("heartbeat_at", F.col("heartbeat_at").cast("timestamp_ntz"))
        return sorted((r.id, r.status, r.error_message) for r in reap_stale(df, f"2024-01-01 {at(now)[11:19]}").collect())

    assert tick(0, ("a", "claimed", 0, 1), ("b", "claimed", 0, 3), ("c", "claimed", 10, 1), ("d", "claimed", 20, 1)) == []
    assert tick(1, ("a", "beat", 200, None), ("d", "over", 210, None), ("e", "beat", 220, None), ("c", "beat", 250, None)) == []
    # b was last heard of at 0, a at 200, c at 250.
    got = tick(2, ("tick", "beat", 450, None))
    assert got == batch(450) == [("b", "failed", "worker lost")]
    got = tick(3, ("tick", "beat", 501, None))
    assert got == batch(501) == [("a", "pending", None), ("b", "failed", "worker lost")]
    # a is claimed again by another worker and lost once more.
    tick(4, ("a", "claimed", 510, 3))
    got = tick(5, ("tick", "beat", 900, None))
    assert got == [("a", "failed", "worker lost"), ("a", "pending", None), ("b", "failed", "worker lost"), ("c", "pending", None)]
    assert {g for g in got if g not in [("a", "pending", None)]} == set(batch(900))
