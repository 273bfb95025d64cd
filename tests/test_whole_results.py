"""Results that must not lose rows, text or precision at any size."""

from pyspark.sql import functions as F

from waymark.operators import evaluate as E
from waymark.operators import history as H
from waymark.operators import seeds as S
from waymark.streaming import jobs as streams


def test_last_bucket_has_no_end(spark):
    df = spark.createDataFrame([(15,), (16,), (999,), (1000,), (10**9,)], "n long").select(H.seen_bucket(F.col("n")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["8-15", "16+", "16+", "16+", "16+"]


def test_entries_expire_from_when_they_were_stored(spark):
    rows = [(i, "k", m * 60) for i, m in enumerate((0, 90, 180, 299, 301))] + [(9, None, 0), (10, None, 60)]
    df = spark.createDataFrame(rows, "event_id int, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    kept = {r["event_id"] for r in H.first_in_ttl(df, "key", "ts", "event_id", "2 hours").collect()}
    assert kept == {0, 2, 4, 9}


def test_late_rows_do_not_replace_newer_state(spark, tmp_path):
    schema = "id int, t int, state string"
    for i, rows in enumerate(([(1, 10, "new"), (2, 1, "a")], [(1, 5, "late"), (2, 2, "b")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streams.upsert_sink(stream, f"{tmp_path}/out", "id", ["t"], f"{tmp_path}/state").awaitTermination()
    got = {r["id"]: r["state"] for r in streams.latest_snapshot(spark, f"{tmp_path}/out").collect()}
    assert got == {1: "new", 2: "b"}


def test_landmark_ids_hold_the_whole_digest(spark):
    key = spark.range(1).select(S.landmark_key(F.lit("Temple"), F.lit(1.0), F.lit(2.0), F.lit(""))).first()[0]
    assert len(key.rpartition("#")[2]) == 64


def test_scores_are_not_rounded_before_the_fit(spark):
    df = spark.createDataFrame([(0.5, False), (0.5000001, True)], "score double, correct boolean")
    assert [k[1] for k in E.isotonic_knots(E.fit_isotonic(df))] == [0.0, 1.0]
