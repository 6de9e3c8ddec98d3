"""Streams that read and write only what a batch touches."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from mnemora.functions.records import canonical
from mnemora.operators import folds
from mnemora.sources import records
from mnemora.sources.folders import numbered_folders
from mnemora.streaming import refresh, turns

UUID = "018f0000-0000-7000-8000-{:012d}"


def put(folder, n, event_type="payload.evicted", **more):
    value = {"schema": "0.2", "record_type": "event", "id": UUID.format(n), "sequence": n, "previous_event": None, "event_type": event_type, "recorded_at": "2024-01-01T00:00:00Z", "actor": "user", "target": UUID.format(n % 3), "data": {}, "sensitivity": "personal", "sealed": True, **more}
    value["integrity"] = "sha256:" + hashlib.sha256(canonical(value)).hexdigest()
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{value['id']}.json").write_text(json.dumps(value))


def test_the_event_log_as_a_stream_feeds_the_folded_state(spark, tmp_path):
    log, store, place = tmp_path / "_events", f"{tmp_path}/store", f"{tmp_path}/check"
    rng = random.Random(1)
    for batch in range(3):
        for n in range(10 * batch + 1, 10 * batch + 11):
            put(log / f"d{n % 2}", n, rng.choice(list(folds.STATES)))
        events = records.stream_events(spark, str(log)).where("error is null").select("target", F.col("sequence").alias("seq"), F.col("event_type").alias("kind"))
        refresh.refresh(events, store, place).awaitTermination(120)  # a restart goes on with the new files
    whole = records.read_events(spark, str(log)).select("target", F.col("sequence").alias("seq"), F.col("event_type").alias("kind"))
    assert whole.count() == 30
    want = folds.effective_state(whole).select(*refresh.FOLDED).collect()
    assert sorted(map(tuple, refresh.current(spark, store).select(*refresh.FOLDED).collect())) == sorted(map(tuple, want))


def test_a_batch_touches_its_own_parts_and_old_versions_go(spark, tmp_path):
    store, source, place = f"{tmp_path}/store", f"{tmp_path}/in", f"{tmp_path}/check"
    schema = "target long, seq long, kind string"
    for k in range(5):
        rows = [(t, 100 * k + t, "payload.evicted") for t in (range(40) if k == 0 else [7])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        refresh.refresh(spark.readStream.schema(schema).json(source), store, place).awaitTermination(120)
    versions = refresh._versions(spark, store)
    assert sum(len(v) for v in versions.values()) == len(versions) + 1 and max(map(len, versions.values())) == 2
    assert numbered_folders(spark, store, "batch") == [0, 3, 4]
    assert {r.target: r.last_seq for r in refresh.current(spark, store).collect()} == {t: 407 if t == 7 else t for t in range(40)}


def test_turns_judged_by_keyed_state(spark, tmp_path):
    schema = "host string, session_id string, turn_id string, user_text string, assistant_text string"
    steps = [[("h", "s", "1", "u", "a"), ("h", "s", "2", "u", "a")], [("h", "s", "1", "u", "a"), ("h", "s", "2", "u", "other"), ("h", "s", "3", "u", None), ("h", "s", "3", "u", None)]]
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        judged = turns.judged_turns(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
        judged.writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.schema("turn_id string, outcome string").json(f"{tmp_path}/out").collect()
    assert sorted((r.turn_id, r.outcome) for r in got) == [("1", "new"), ("1", "replay"), ("2", "conflict"), ("2", "new"), ("3", "new"), ("3", "replay")]


def test_gates_of_sealed_events(spark, tmp_path):
    put(tmp_path, 1)
    put(tmp_path, 2, schema="0.1")
    put(tmp_path, 3, recorded_at="2024-01-01T00:00:00")
    put(tmp_path, 4, actor=" ")
    put(tmp_path, 5, sequence=0)
    rows = records.read_events(spark, str(tmp_path)).select("id", records.event_error(F.col("raw")).alias("fault"), "error").collect()
    assert all(r.error is None for r in rows)
    assert {int(r.id[-1]): r.fault for r in rows} == {1: None, 2: "$.schema: const", 3: "$.recorded_at: format", 4: "$.actor: not an actor", 5: "$.sequence: minimum"}
