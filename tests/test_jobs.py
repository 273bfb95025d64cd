"""Learning, policy, corpus, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.operators import corpus as C
from waymark.operators import learn as L
from waymark.operators import orders as O
from waymark.operators import policy as P
from waymark.operators import responses as R
from waymark.operators import scoring as S
from waymark.sources import files

SHIV = (28.6524, 77.1206)


def start(observations=47, lat=SHIV[0], lng=SHIV[1]):
    return {"lat": lat, "lng": lng, "raw_lat": lat, "raw_lng": lng, "observations": observations, "confidence": 0.5, "known": frozenset({"shiv mandir"})}


def event(lat=28.6526, lng=77.1208, accuracy=None, spelling=None):
    return {"event_id": 1, "ts": None, "lat": lat, "lng": lng, "accuracy_m": accuracy, "spelling": spelling}


def test_ema_alpha():
    assert (L.ema_alpha(0), L.ema_alpha(1), L.ema_alpha(9), L.ema_alpha(10_000)) == (1.0, 0.5, 0.1, 0.02)


def test_one_confirmation():
    after, audit = L.step(start(), event())
    assert after["observations"] == 48 and 0 < audit["moved_m"] < 2.0
    cold, _ = L.step(start(0), event())
    assert (cold["lat"], cold["lng"]) == (28.6526, 77.1208)
    same, far = L.step(start(), event(28.70, 77.20))
    assert far["rejected"] and same["observations"] == 47
    good, poor = L.step(start(3), event(accuracy=10.0))[1], L.step(start(3), event(accuracy=200.0))[1]
    assert poor["moved_m"] < good["moved_m"]
    assert L.step(start(), event(spelling="Shiv Mandhir"))[1]["alias_added"] == "Shiv Mandhir"
    assert L.step(start(), event(spelling="SHIV mandir"))[1]["alias_added"] is None
    assert L.step(None, event())[1]["rejected"] == "landmark not in graph"


CASE = "case_id int, principal string, confidence double, messages_sent int, local_hour int, channel string, opted_out boolean, pending boolean"


def test_contact_policy(spark):
    ok = ("clarifier", 0.5, 0, 12, "sms", False, True)

    def but(**kw):
        names = ("principal", "confidence", "messages_sent", "local_hour", "channel", "opted_out", "pending")
        return tuple(kw.get(n, v) for n, v in zip(names, ok))

    cases = {
        1: (ok, True), 2: (but(local_hour=9), True), 3: (but(local_hour=20), True), 4: (but(local_hour=8), False), 5: (but(local_hour=21), False),
        6: (but(confidence=0.8), False), 7: (but(messages_sent=1), False), 8: (but(channel="voice"), False), 9: (but(pending=False), False),
        10: (but(principal="operator", local_hour=23, confidence=0.99), True), 11: (but(principal="operator", opted_out=True), False),
        12: (but(opted_out=True), False), 13: (but(principal="resolver"), False), 14: (but(confidence=None), False), 15: (but(local_hour=None), False),
    }
    df = spark.createDataFrame([(k, *v[0]) for k, v in cases.items()], CASE)
    got = {r["case_id"]: r for r in P.contact_decisions(df).collect()}
    assert {k: r["allowed"] for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert got[11]["matched_policies"] == ["contact-opted-out"] and "failing closed" in got[14]["reason"]


def test_overwrite_policy(spark):
    df = spark.createDataFrame([(0.95, "landmark_graph"), (0.96, "landmark_graph"), (0.99, "geocoder"), (None, "landmark_graph")], "confidence double, geo_source string")
    assert [r["allowed"] for r in P.overwrite_decisions(df).collect()] == [False, True, False, False]


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, O.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_calibration_is_identity_without_knots(spark):
    df = spark.createDataFrame([(0.1,), (0.7,), (0.95,)], "s double")
    assert [r[0] for r in df.select(S.apply_calibration(F.col("s"), None)).collect()] == [0.1, 0.7, 0.95]
    assert [round(r[0], 4) for r in df.select(S.apply_calibration(F.col("s"))).collect()] == [0.0, 0.0759, 1.0]


def test_model_responses(spark):
    body = {"building": "14", "pincode": "999999", "locality": None, "landmarks": [{"name": "Gate {2}", "relation": "BEHIND", "matched_id": "L7"}],
            "field_confidence": {"building": "0.3", "junk": 1, "city": "x"}, "alternatives": [{"reason": "r", "fields": {"city": "Pune"}}, {"reason": "empty"}]}
    texts = [f"Here: ```json {json.dumps(body)} ``` and {{more}}", "sorry", '{"building": "1"', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    settled = {f: F.lit(None).cast("string") for f in R.tables.FIELDS} | {"pincode": F.lit("110015")}
    rows = R.reconcile(df.withColumns(settled | {"candidate_ids": F.array(F.lit("L1"))})).orderBy("i")
    first, *rest = rows.collect()
    assert [r["failed"] for r in rest] == [True, True, True] and not first["failed"]
    assert first["model_pincode"] == "110015" and first["model_building"] == "14"
    assert tuple(first["model_landmarks"][0]) == ("Gate {2}", "behind", None)
    assert first["field_confidence"] == {"building": 0.3} and len(first["conflicts"]) == 2 and len(first["alternatives"]) == 1
    reasons = rows.where("i = 0").select(R.escalation_reasons(F.lit(False)), R.self_confidence()).first()
    assert reasons[0] == ["deterministic_conflict", "alternatives_present", "low_field_confidence"] and reasons[1] == 0.3


def test_corpus_is_reproducible_and_truthful(spark):
    seeds = spark.createDataFrame(
        [(f"S{i}", f"Place {i} Post Office, near Shiv Mandir Colony, Pune, Maharashtra - 41100{i % 9 + 1}", "Pune", f"41100{i % 9 + 1}") for i in range(40)],
        "seed_id string, raw string, city string, pincode string",
    )
    a = sorted(map(str, C.perturb(seeds, 8).collect()))
    b = sorted(map(str, C.perturb(seeds.repartition(7), 8).collect()))
    assert a == b
    rows = C.perturb(seeds, 25).collect()
    share = {p: sum(p in r["perturbations"] for r in rows) / len(rows) for p in C.RATES}
    for p in ("add_unit", "inject_phone", "merge_lines", "case_noise", "transliterate", "drop_pincode"):
        assert abs(share[p] - C.RATES[p] * 24 / 25) < 0.06, (p, share[p])
    for r in rows:
        if r["variant"] == 0:
            assert not r["perturbations"]
        if "drop_pincode" in r["perturbations"] and "inject_phone" not in r["perturbations"] and "add_unit" not in r["perturbations"]:
            assert r["pincode"] not in r["raw"]


def test_gold_split(spark):
    rows = [(f"S{i % 60}#v{i // 60}", f"S{i % 60}", f"City {i % 5}", ["x"] * (i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "address_id string, seed_id string, city string, perturbations array<string>")
    gold = C.gold_split(df, 100).collect()
    assert len(gold) == 100 and sum(r["split"] == "dev" for r in gold) == 50
    per_seed = {}
    for r in gold:
        per_seed[r["seed_id"]] = per_seed.get(r["seed_id"], 0) + 1
    assert max(per_seed.values()) <= 3


def test_directory_with_bom(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("﻿Pincode,OfficeName,OfficeType,District,StateName,Latitude,Longitude\n110015,Ramesh Nagar S.O,SO,WEST,DELHI,28.65,77.12\n", encoding="utf-8")
    row = files.read_directory(spark, str(path)).first()
    assert row["Pincode"] == "110015" and row["Delivery"] is None


def test_jsonl_rejects_unknown_fields(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": "1"}\n\n{"a": "2", "b": 3}\n')
    with pytest.raises(Exception, match="unknown fields: b"):
        files.read_jsonl(spark, str(path), "a string").collect()
    assert files.read_jsonl(spark, str(path), "a string, b int").count() == 2


def test_small_maps(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"_comment": "x", "opp": "opposite"}')
    assert files.read_abbreviations(spark, str(path)) == {"opp": "opposite"}
    path.write_text('{"knots": [[0.5, 0.2], [0.1, 0.0]]}')
    assert files.read_knots(spark, str(path)) == [(0.1, 0.0), (0.5, 0.2)]


def test_stream_and_batch_learn_alike(spark, sf):
    from waymark.plans.registry import JOBS
    import waymark.plans.catalog  # noqa: F401

    columns = ["event_id", "landmark_id", "before_observations", "after_observations", "rejected", "lat", "lng"]
    batch = sorted(map(str, JOBS["learning_audit"].run(spark, sf).select(columns).collect()))
    stream = sorted(map(str, JOBS["stream_learn_landmarks"].run(spark, sf).select(columns).collect()))
    assert batch == stream and batch
