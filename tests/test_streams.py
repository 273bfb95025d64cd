"""Streams that apply rows in order, timers, and the bucketed sink, beside their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import history as H
from waymark.operators import learn as L
from waymark.streaming import jobs as streams

MINUTE = 60


def arriving(spark, path, rows, schema, batches, rng, late_s=500):
    """Rows (with s, seconds) written as files in the order they arrive, late by up to ``late_s``; a last row moves the clock on."""
    order = sorted(rows, key=lambda r: r["s"] + rng.randrange(late_s))
    step = -(-len(order) // batches)
    parts = [order[i : i + step] for i in range(0, len(order), step)] + [[{"s": max(r["s"] for r in rows) + 10**6}]]
    for part in parts:
        df = spark.createDataFrame([{**dict.fromkeys(schema.replace(" ", ",").split(",")[::2]), **r} for r in part], schema)
        df.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(path)
    read = spark.read.parquet(path).schema
    return spark.readStream.schema(read).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, root):
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def test_learning_agrees_over_batches_slices_and_streams(spark, tmp_path):
    rng = random.Random(1)
    rows = [
        {"event_id": i, "landmark_id": rng.choice([1, 1, 1, 2, 3, 99]), "lat": 28.65 + rng.uniform(-0.003, 0.003), "lng": 77.12 + rng.uniform(-0.003, 0.003),
         "accuracy_m": rng.choice([None, 20.0, 120.0]), "spelling": rng.choice([None, "Temple", "temple ", "Shiv"]), "s": 1_700_000_000 + rng.randrange(20_000)}
        for i in range(400)
    ]
    schema = "event_id long, landmark_id long, lat double, lng double, accuracy_m double, spelling string, s long"
    landmarks = spark.createDataFrame(
        [(1, "Shiv Mandir", ["temple"], 28.65, 77.12, 5, 0.5), (2, "Tank", [], 28.65, 77.12, 0, 0.5), (3, "No point", [], None, None, 2, 0.5)],
        "landmark_id long, canonical_name string, aliases array<string>, lat double, lng double, observation_count int, confidence double",
    )
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    want = {}
    for name in (1, 2, 3, 99):
        state = None if name > 2 else {"lat": 28.65, "lng": 77.12, "raw_lat": 28.65, "raw_lng": 77.12, "observations": 5 if name == 1 else 0, "confidence": 0.5,
                                       "known": frozenset({"shiv mandir", "temple"} if name == 1 else {"tank"})}
        for r in sorted((r for r in rows if r["landmark_id"] == name), key=lambda r: (r["s"], r["event_id"])):
            state, audit = L.step(state, {**r, "ts": None})
            want[r["event_id"]] = audit
    columns = ["before_observations", "after_observations", "rejected", "lat", "lng", "confidence", "alias_added", "moved_m"]
    for size in (100_000, 7):
        got = {r["event_id"]: r for r in L.learning_audit(events, landmarks, slice_rows=size).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][c] == want[i][c] for i in want for c in columns)
    stream = streams.learn_landmarks(arriving(spark, f"{tmp_path}/in", rows, schema, 5, rng), landmarks)
    got = {r["event_id"]: r for r in drained(stream, tmp_path).where("landmark_id is not null").collect()}
    assert got.keys() == want.keys()
    assert all(got[i][c] == want[i][c] for i in want for c in columns)
    assert any(w["alias_added"] for w in want.values()) and any(w["rejected"] == "too far" for w in want.values())


def entries_and_timeouts(rng, n=600):
    return [
        {"event_id": i, "cache_key": rng.choice(["hot", "hot", "a", "b", "c"]), "s": 1_700_000_000 + rng.randrange(400) * MINUTE,
         "kind": rng.choice(["q", "r", "x"])}
        for i in range(n)
    ]


def test_deduplication_agrees_with_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = entries_and_timeouts(rng)
    schema = "event_id long, cache_key string, kind string, s long"
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    want = {r["event_id"] for r in H.first_in_ttl(batch, "cache_key", "ts", "event_id", "30 minutes").collect()}
    last, plain = {}, set()
    for r in sorted(rows, key=lambda r: (r["s"], r["event_id"])):
        if r["cache_key"] not in last or r["s"] > last[r["cache_key"]] + 1800:
            last[r["cache_key"]] = r["s"]
            plain.add(r["event_id"])
    stream = streams.dedupe_resolutions(arriving(spark, f"{tmp_path}/in", rows, schema, 4, rng), "30 minutes")
    got = {r["event_id"] for r in drained(stream, tmp_path).where("cache_key is not null").collect()}
    assert got == want == plain and len(plain) > 30


def test_timers_agree_with_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"event_id": r["event_id"], "order_id": r["cache_key"] + str(rng.randrange(20)), "question": r["kind"] == "q", "reply": r["kind"] == "r", "s": r["s"]} for r in entries_and_timeouts(rng)]
    schema = "event_id long, order_id string, question boolean, reply boolean, s long"
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    want = {(r["event_id"], r["due"]) for r in H.unanswered(batch, "order_id", "ts", "event_id", F.col("question"), F.col("reply"), "90 minutes").collect()}
    stream = streams.unanswered(arriving(spark, f"{tmp_path}/in", rows, schema, 4, rng), "90 minutes")
    got = [(r["event_id"], r["due"]) for r in drained(stream, tmp_path).where("order_id is not null").collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_rows_after_the_watermark_are_dropped(spark, tmp_path):
    rng = random.Random(4)
    schema = "event_id long, cache_key string, s long"
    base = 1_700_000_000
    first = arriving(spark, f"{tmp_path}/in", [{"event_id": 1, "cache_key": "a", "s": base}], schema, 1, rng, 1)
    for row in ((3, None, base + 10**6), (2, "b", base + 5)):  # the watermark of one batch holds from the next on
        df = spark.createDataFrame([row], schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = drained(streams.dedupe_resolutions(first, "1 hour"), tmp_path).where("cache_key is not null").collect()
    assert [r["event_id"] for r in got] == [1]


def test_sink_writes_what_a_batch_touches(spark, tmp_path):
    target = f"{tmp_path}/table"
    frame = lambda rows: spark.createDataFrame(rows, "id long, t int, state string")
    streams.merge_batch(frame([(i, 1, "old") for i in range(1000)]), 0, target, "id", ["t"], buckets=32)
    before = streams.manifest(spark, target)
    assert len(before["files"]) == 32
    streams.merge_batch(frame([(7, 2, "new"), (8, 0, "late"), (5000, 1, "added")]), 1, target, "id", ["t"])
    after = streams.manifest(spark, target)
    moved = [b for b in after["files"] if after["files"][b] != before["files"][b]]
    assert 1 <= len(moved) <= 3 and after["buckets"] == 32
    rows = {r["id"]: (r["t"], r["state"]) for r in streams.latest_snapshot(spark, target).collect()}
    assert len(rows) == 1001 and rows[7] == (2, "new") and rows[8] == (1, "old") and rows[5000] == (1, "added")
    streams.merge_batch(frame([(7, 9, "again")]), 1, target, "id", ["t"])  # the same batch once more
    assert streams.manifest(spark, target) == after
    assert streams.vacuum(spark, target, keep=2) == []
    gone = streams.vacuum(spark, target, keep=1)
    assert sorted(gone) == sorted(before["files"][b] for b in moved)
    assert streams.latest_snapshot(spark, target).count() == 1001 and len(streams.manifests(spark, target)) == 1


def test_a_batch_without_rows_and_no_table(spark, tmp_path):
    target = f"{tmp_path}/table"
    assert streams.latest_snapshot(spark, target) is None and streams.vacuum(spark, target) == []
    streams.merge_batch(spark.createDataFrame([], "id long, t int"), 0, target, "id", ["t"])
    assert streams.latest_snapshot(spark, target) is None and streams.manifest(spark, target)["batch"] == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_slices_are_bounded_and_in_order(spark, size):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), rng.choice([None, *range(0, 600, 7)])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id int, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = {}
    for r in L.sliced(df, "k", "ts", "event_id", size).collect():
        found.setdefault(r["k"], []).append((r["slice"], r["s"] is not None, r["s"] or 0, r["event_id"]))
    for parts in found.values():
        parts.sort(key=lambda x: x[1:])
        assert [p[0] for p in parts] == [i // size for i in range(len(parts))]


def state_rows(stream, root):
    """The most rows of state that a stream over what is there held, and those it left."""
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return max(held), held[-1]


def test_landmarks_without_deliveries_are_no_state(spark, tmp_path):
    rows = [{"event_id": i, "landmark_id": i % 3, "lat": 28.65, "lng": 77.12, "s": 1_700_000_000 + i} for i in range(9)]
    schema = "event_id long, landmark_id long, lat double, lng double, accuracy_m double, spelling string, s long"
    landmarks = spark.range(2000).selectExpr("id as landmark_id", "'Tank' as canonical_name", "array('x') as aliases", "28.65D as lat", "77.12D as lng", "5 as observation_count", "0.5D as confidence")
    stream = streams.learn_landmarks(arriving(spark, f"{tmp_path}/in", rows, schema, 1, random.Random(6), 1), landmarks)
    assert state_rows(stream, tmp_path)[0] < 50


@pytest.mark.parametrize("kind", ["entries", "timeouts"])
def test_state_is_per_bucket_and_outlived_rows_leave_it(spark, tmp_path, kind):
    rows = [{"event_id": i, "order_id": i, "question": True, "s": 1_700_000_000 + i % 60} for i in range(4000)]
    stream = arriving(spark, f"{tmp_path}/in", rows, "event_id long, order_id long, question boolean, reply boolean, s long", 1, random.Random(6), 1)
    found = streams.unanswered(stream, "1 hour") if kind == "timeouts" else streams.dedupe_resolutions(stream.withColumnRenamed("order_id", "cache_key"), "1 hour")
    most, left = state_rows(found, tmp_path)
    assert most < 4000 and left < 4
    assert spark.read.parquet(f"{tmp_path}/out").where("event_id is not null").count() == 4000


def test_rows_without_a_key_leave_other_keys_theirs(spark, tmp_path):
    """A null among whole numbers makes floats of a batch's keys in pandas; they stay the keys they are."""
    rows = [{"event_id": i, "cache_key": None if i % 7 == 0 else i % 5, "s": 1_700_000_000 + i} for i in range(70)]
    stream = arriving(spark, f"{tmp_path}/in", rows, "event_id long, cache_key long, s long", 1, random.Random(8), 1)
    got = drained(streams.dedupe_resolutions(stream, "1 hour"), tmp_path).where("cache_key is not null").collect()
    assert sorted((r["cache_key"], r["event_id"]) for r in got) == [(0, 5), (1, 1), (2, 2), (3, 3), (4, 4)]
