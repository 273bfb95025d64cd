"""The whole chain on a handful of real places."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import blocks
from waymark.operators import retrieval as R
from waymark.plans import catalog, chain
from waymark.sources.fixtures import view
from waymark.sources.warehouse import Warehouse

# A neighbourhood of Delhi and a far namesake.
PLACES = [
    ("LMK#DL#RAMESH", "Ramesh Nagar", ["ramesh nagar", "रमेश नगर"], 28.6519, 77.1200, 12),
    ("LMK#DL#SHIV", "Shiv Mandir", ["shiv temple", "शिव मंदिर", "mandir wali gali"], 28.6524, 77.1206, 47),
    ("LMK#DL#GUPTA", "Gupta General Store", ["gupta store", "gupta kirana"], 28.6521, 77.1198, 3),
    ("LMK#DL#TANK", "Water Tank", ["paani ki tanki"], 28.6530, 77.1210, 5),
    ("LMK#DL#HANUMAN", "Hanuman Mandir", ["hanuman temple"], 28.6700, 77.1400, 8),
    ("LMK#MH#SHIV", "Shiv Mandir", ["shiv temple"], 19.0760, 72.8777, 20),
]
REQUESTS = [
    (1, "H.No 14, behind Shiv Mandir, Ramesh Nagar, Delhi 110015, 9876543210"),
    (2, "मकान 14, शिव मंदिर के पीछे, रमेश नगर, दिल्ली 110015"),
    (3, "near shiv mandir"),
    (4, "flat 4b, opp water tank, Ramesh Nagar, bengaluru karnataka 110015"),
    (5, "h no 14 behind shiv mandir ramesh nagar delhi 110015 98765 43210"),
    (6, "some place 999999"),
]


@pytest.fixture(scope="module")
def resolved(spark):
    gaz = spark.createDataFrame(
        [("110015", "Ramesh Nagar", "West", "Delhi", 28.6519, 77.1200, 6), ("400001", "Fort", "Mumbai", "Maharashtra", 18.94, 72.83, 4)],
        "pincode string, locality string, district string, state string, lat double, lng double, office_count int",
    )
    names = spark.createDataFrame([("110015", "ramesh nagar"), ("110015", "rajouri garden"), ("400001", "fort")], "pincode string, locality string")
    marks = spark.createDataFrame(PLACES, "landmark_id string, canonical_name string, aliases array<string>, lat double, lng double, observation_count int")
    requests = spark.createDataFrame(REQUESTS, "order_id int, raw string")
    rows = chain.resolve(requests, gaz, names, R.prepare_landmarks(marks), "R2").collect()
    return {r["order_id"]: r for r in rows}


def test_anchor_places_the_address(resolved):
    r = resolved[1]
    assert (r["pincode"], r["locality"], r["city"], r["state"], r["building"]) == ("110015", "Ramesh Nagar", "New Delhi", "Delhi", "14")
    assert r["anchor_id"] == "LMK#DL#RAMESH" and r["geo"]["source"] == "landmark_graph"
    assert (r["geo"]["lat"], r["geo"]["lng"]) == (28.6519, 77.12)
    assert [(l["matched_id"], l["relation"]) for l in r["landmarks"]] == [("LMK#DL#SHIV", "behind")]


def test_hindi_and_latin_agree(resolved):
    a, b = resolved[1], resolved[2]
    assert [l["matched_id"] for l in a["landmarks"]] == [l["matched_id"] for l in b["landmarks"]]
    assert a["pincode"] == b["pincode"] and b["devanagari"]


def test_copies_resolve_alike(resolved):
    assert resolved[1]["digipin"] == resolved[5]["digipin"] and len(resolved[1]["digipin"]) == 10


def test_namesakes_without_a_centre_are_ambiguous(resolved):
    assert resolved[3]["status"] == "AMBIGUOUS" and len(resolved[3]["alternatives"]) == 2


def test_conflict_is_penalised(resolved):
    r = resolved[4]
    assert r["state_conflict"] and r["confidence"] < 0.5 and r["state"] == "Delhi"
    assert any("pincode_state_conflict" in e for e in r["evidence"])


def test_unknown_pincode_asks_one_question(resolved):
    r = resolved[6]
    assert r["status"] == "NEEDS_INFO" and r["pincode"] is None and r["clarification"]["field"] == "locality"
    assert any("unknown six-digit token(s) 999999" in e for e in r["evidence"])


def test_no_phone_leaves_the_parse(resolved):
    for r in resolved.values():
        assert "9876543210" not in str({k: v for k, v in r.asDict().items() if k != "phones"})


def test_configurations_share_parse_and_search(spark, sf, monkeypatch):
    """Resolved together, addresses are parsed and searched once, and each configuration answers as it does alone."""
    from waymark.plans.jobs_retrieval import index

    catalog.load()
    w = Warehouse(spark, sf)
    requests = view(spark, sf, "address").where("order_id % 8 = 0").select("order_id", "raw")
    given = requests, w.table("gazetteer"), w.table("localities"), index(w)
    calls = []
    for module, name in ((chain.L, "parse_addresses"), (chain.R, "phrase_pairs"), (blocks, "around")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **k: (calls.append(n), f(*a, **k))[1])
    together = chain.resolve_each(*given)
    assert sorted(calls) == ["around", "parse_addresses", "phrase_pairs"] and set(together) == {"A", "R1", "R2"}
    for config, rows in together.items():
        want, got = (sorted(map(str, df.select("order_id", *chain.RESULT).collect())) for df in (chain.resolve(*given, config), rows))
        assert got == want and got
