import json
import os

from pyspark.sql import functions as F

from chronoweave.operators.escalation import fold
from chronoweave.streaming import rounds as S

SIGNALS, LEVELS = ("stuck_region", "test_tampering", "regression", "boundary_breach"), ("high", "medium", "low", "silent")


def _rounds():
    out, n = [], 0
    for signal in SIGNALS:
        for level in LEVELS:
            for direct in (False, True):
                for pattern in ("1111111", "1011001", "0000000", "1100100", "1010101"):
                    n += 1
                    out += [(n, signal, level, direct, i, c == "1") for i, c in enumerate(pattern)]
    return out


SCHEMA = "incident long, signal string, level string, direct boolean, round int, recurred boolean"


def test_fold_equals_the_plain_state_machine(spark):
    rows = _rounds()
    found = {r.incident: (r.state, r["count"], r.stable, r.agent, r.user) for r in fold(spark.createDataFrame(rows, SCHEMA), ["incident"]).collect()}
    want = {}
    for i, signal, level, direct, _, recurred in rows:
        want[i] = S.advance(want.get(i, S.OPENED), recurred, signal, level, direct)
    assert found == want
    assert len({w[0] for w in want.values()}) == 3


def test_stream_equals_the_fold(spark, tmp_path):
    rows = _rounds()[: 7 * 40]
    source, out = tmp_path / "in", {}
    source.mkdir()
    for part in range(3):
        with open(source / f"{part}.json", "w") as f:
            for r in rows:
                if r[4] % 3 == part or part == 2 and r[4] % 3 == 2:
                    f.write(json.dumps(dict(zip(("incident", "signal", "level", "direct", "round", "recurred"), (*r[:4], part * 10 + r[4], r[5]), strict=True))) + "\n")
        os.utime(source / f"{part}.json", (1_700_000_000 + part, 1_700_000_000 + part))  # files are read in order of age
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))

    def keep(batch, _):
        out.update({r.incident: (r.state, r["count"], r.stable, r.agent, r.user) for r in batch.collect()})

    q = S.escalated(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    want = {}
    for r in sorted(rows, key=lambda r: (r[0], r[4] % 3, r[4])):
        want[r[0]] = S.advance(want.get(r[0], S.OPENED), r[5], *r[1:4])
    assert out == want


def test_hook_events_and_duplicates(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = [("a", "post_edit", False), ("a", "post_edit", False), ("b", "stop", True), ("c", "stop", False), ("d", "other", False)]
    with open(source / "1.json", "w") as f:
        for i, kind, stop in events:
            f.write(json.dumps({"event_id": i, "kind": kind, "project_id": 1, "stop_active": stop, "at": "2024-01-01T00:00:00Z"}) + "\n")
        f.write("not json\n")
    seen = []
    q = S.run_rounds(S.once(S.hook_events(spark, str(source)), ["event_id"]), lambda b, n: seen.extend(r.event_id for r in b.select("event_id").where(F.col("kind").isNotNull()).collect()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert q.exception() is None and sorted(seen) == ["a", "c"]


def test_rounds_capture_changes_and_open_incidents_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    forms = ["a", "b", "a", "a2", "b"]
    for n, form in enumerate(forms):
        with open(source / f"{n}.json", "w") as f:
            f.write(json.dumps({"event_id": str(n), "kind": "post_edit", "project_id": 1, "path": "src/x.py", "output": form, "at": f"2024-01-01T0{n}:00:00Z"}) + "\n")
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))

    def defines_of(batch):
        return batch.select("project_id", F.col("path").alias("file_path"), F.lit("f").alias("define_name"), F.col("output").alias("content_hash"), F.substring("output", 1, 1).alias("node_fingerprint"), F.substring("output", 1, 1).alias("fine_fingerprint"))

    log, incidents = str(tmp_path / "log"), str(tmp_path / "inc")
    stage = S.reconcile(log, incidents, defines_of)
    events = S.hook_events(spark, str(source), files_per_round=1)
    q = S.run_rounds(events, stage, str(tmp_path / "c"))
    q.awaitTermination(300)
    assert q.exception() is None
    rows = spark.read.parquet(log).orderBy("seq").collect()
    order = [r.content_hash for r in rows]
    assert sorted(order) == sorted(forms) and [r.seq for r in rows] == [1, 2, 3, 4, 5]
    assert [r.edit_type for r in rows] == ["create", *["modify"] * 4]
    found = spark.read.parquet(incidents).collect()
    assert [(r.signal, r.target_node) for r in found] == [("define_loop", "src/x.py::f")]
    # a round that is repeated changes nothing
    last = max(int(r.round) for r in rows)
    batch = spark.read.schema(S.EVENT).json(str(source)).where(F.col("output") == order[-1]).limit(1)
    stage(batch, last)
    assert spark.read.parquet(log).count() == 5 and spark.read.parquet(incidents).count() == 1
