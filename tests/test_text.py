"""Pinned values of normalisation and parsing."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import text as X
from waymark.operators import normalise as N
from waymark.operators import parse as P


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


def many(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", expr(F.col("t")).alias("o"))
    return [r["o"] for r in rows.orderBy("i").collect()]


def test_fold(spark):
    assert one(spark, "H.No 14,, Ramesh  Nagar | Delhi", X.fold) == "h.no 14 ramesh nagar delhi"
    assert one(spark, "１１００１５", X.fold) == "110015"
    assert "मंदिर" in one(spark, "शिव मंदिर", X.fold)
    assert one(spark, "A–B — C -- D- e's. x.", X.fold) == "a b c d- e's x"


def test_transliteration(spark):
    pairs = {
        "मंदिर": "mandir", "नगर": "nagar", "रमेश": "ramesh", "दिल्ली": "dilli", "मुंबई": "mumbai",
        "बेंगलुरु": "bengaluru", "गली": "gali", "चेन्नई": "chennai", "शिव मंदिर": "shiv mandir", "११००१५": "110015",
        "ramesh nagar 110015": "ramesh nagar 110015",
    }
    assert many(spark, pairs, X.transliterate) == list(pairs.values())
    assert "्" not in one(spark, "दिल्ली नई दिल्ली क्षेत्र", X.transliterate)


def test_abbreviations(spark):
    pairs = {
        "h.no 14": "house number 14", "opp sbi": "opposite sbi", "nr mandir": "near mandir", "sec 22": "sector 22",
        "blr": "bengaluru", "up": "uttar pradesh", "h no 5": "house number 5", "opp nr up": "opposite near uttar pradesh",
        "st st": "street street", "": "",
    }
    pairs |= {w: w for w in ("gupta", "behind", "store", "delhi", "sunrise", "upper", "nagar", "apartments")}
    assert many(spark, pairs, X.expand_abbreviations) == list(pairs.values())


def test_normalise(spark):
    raws = [
        "H.No 14, Ramesh Nagar, Delhi 110015", "h no 14   ramesh  nagar, delhi, 110015", "h no 41 ramesh nagar delhi 110015",
        "शिव मंदिर, रमेश नगर", "शिव मंदिर near SBI", "சென்னை 600034", "शिव मंदिर के पीछे, रमेश नगर, दिल्ली 110015",
    ]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    out = N.normalise_addresses(rows).orderBy("i").collect()
    assert out[0]["cache_key"] == out[1]["cache_key"] != out[2]["cache_key"]
    assert "मंदिर" in out[3]["retrieval_text"] and "mandir" in out[3]["retrieval_text"]
    assert set(out[4]["scripts"]) == {"latin", "devanagari"}
    assert "other_indic" in out[5]["scripts"]
    assert "shiv mandir" in out[6]["text"] and "110015" in out[6]["text"]


@pytest.mark.parametrize(
    "phone", ["9876543210", "+91 98765 43210", "+919876543210", "09876543210", "98765-43210", "91 98765 43210", "9000000000"]
)
def test_phones_are_removed_whole(spark, phone):
    rows = spark.createDataFrame([(f"h no 14 ramesh nagar delhi 110015 {phone}",)], "text string")
    out = P.strip_phones(rows).first()
    assert out["phones"] and not any(c.isdigit() for c in out["without_phones"].replace("110015", "").replace("14", ""))
    # nothing of the number is trimmed away
    assert sum(c.isdigit() for c in out["phones"][0]) == sum(c.isdigit() for c in phone)


def test_units(spark):
    texts = ["flat 4b sunrise 2nd floor tower c sector 22", "plot number 42 chennai", "house number 115b patna", "ramesh nagar", "phase ii d block ground floor"]
    rows = P.with_unit_fields(spark.createDataFrame(list(enumerate(texts)), "i int, clean_text string")).orderBy("i").collect()
    assert [r["building"] for r in rows] == ["4B", "42", "115B", None, None]
    assert (rows[0]["floor"], rows[0]["tower"], rows[0]["sub_locality"]) == ("2", "C", "Sector 22")
    assert (rows[4]["floor"], rows[4]["block"], rows[4]["sub_locality"]) == ("GROUND", "D", "Phase II")


def landmarks(spark, text, places=("delhi",)):
    found = F.array(*[F.lit(p) for p in places])
    df = spark.createDataFrame([(text,)], "t string").select(P.landmark_phrases(F.col("t")).alias("p"))
    return [tuple(x) for x in df.select(P.final_landmarks(F.col("p"), found)).first()[0]]


def test_landmark_phrases(spark):
    assert landmarks(spark, "behind shiv mandir") == [("shiv mandir", "behind")]
    assert landmarks(spark, "shiv mandir ke pichhe") == [("shiv mandir", "behind")]
    assert landmarks(spark, "opposite shiv mandir") == [("shiv mandir", "opposite")]
    assert landmarks(spark, "near here") == []
    text = "house number 14 behind shiv mandir near gupta general store opposite water tank ramesh nagar delhi 110015"
    got = landmarks(spark, text, ("ramesh nagar", "delhi"))
    assert got == [("shiv mandir", "behind"), ("gupta general store", "near"), ("water tank", "opposite")]
    assert landmarks(spark, "near loyola college", ("loyola college",)) == [("loyola college", "near")]
    assert landmarks(spark, "752034 baulabanadh ke paas") == [("baulabanadh", "near")]
    assert landmarks(spark, "near shiv mandir beside shiv mandir") == [("shiv mandir", "near")]


def test_question_language_and_order(spark):
    from waymark.operators import decide as D

    df = spark.createDataFrame(
        [(None, None, None, [], False), ("x", None, None, [], True), ("x", "1", None, [], False), ("x", "1", "2", [], False), ("x", "1", "2", ["a"], True)],
        "locality string, pincode string, building string, landmarks array<string>, devanagari boolean",
    )
    rows = df.select(D.choose_question(D.missing_field(), F.col("devanagari")).alias("q")).collect()
    assert [r["q"]["field"] for r in rows] == ["locality", "pincode", "building", "landmark", "geo_confirm"]
    assert rows[1]["q"]["language"] == "hi-IN" and rows[0]["q"]["question"].startswith("Which locality")


def test_a_text_is_cut_into_units_once(spark):
    df = spark.createDataFrame([("दिल्ली मंबई",), (None,), ("",)], "t string").select(X.transliterate(F.col("t")).alias("t"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert [r[0] for r in df.collect()] == ["dilli mambai", None, ""]
