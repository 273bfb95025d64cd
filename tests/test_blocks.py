"""Search in blocks beside scoring everything."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import blocks as B
from waymark.operators import retrieval as R


def metres(a, b, c, d):
    x, y = math.radians(a), math.radians(c)
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("size", [2048, 16])
def test_searches_with_and_without_a_centre(spark, monkeypatch, size):
    monkeypatch.setattr(B, "BLOCK_DOCS", size)
    monkeypatch.setattr(B, "BLOCK_VISITS", 8)
    monkeypatch.setattr(B, "SLICE", 3)
    rng = random.Random(12)
    words = ["shiv", "mandir", "gupta", "store", "water", "tank", "school", "nagar", "road", "gate", "old", "new"] + [f"n{i}" for i in range(30)]
    spots = [(28.6 + rng.uniform(0, 0.2), 77.1 + rng.uniform(0, 0.2)) for _ in range(6)]
    rows = []
    for i in range(400):  # half of them on one spot
        lat, lng = spots[0] if i % 2 else rng.choice(spots)
        rows.append((f"L{i:04d}", " ".join(rng.choices(words, k=rng.randint(1, 5))), [], lat + rng.uniform(-0.01, 0.01), lng + rng.uniform(-0.01, 0.01), 1))
    rows.append(("L9999", "shiv mandir", [], None, None, 1))
    landmarks = spark.createDataFrame(rows, "landmark_id string, canonical_name string, aliases array<string>, lat double, lng double, observation_count int")
    index = R.prepare_landmarks(landmarks)
    asked = []
    for i in range(60):
        text = " ".join(rng.choices(words + ["unknown"], k=rng.randint(0, 5)))
        lat, lng = rng.choice(spots)
        radius = rng.choice([800.0, 3000.0, 20000.0])
        asked.append((f"q{i}", text, *((f"{lat}/{lng}/{radius}", lat, lng, radius) if i % 3 else (None, None, None, 3000.0))))
    queries = spark.createDataFrame(asked, "query_id string, query_text string, centre_id string, centre_lat double, centre_lng double, radius_m double")
    got = {(r["query_id"], r["landmark_id"]): r["signals"] for r in R.hybrid_retrieve(queries, index).collect()}
    impact = {}
    for r in index["impacts"].collect():
        impact.setdefault(r["term"], {})[r["landmark_id"]] = r["impact"]
    vectors = {r["landmark_id"]: {x["bucket"]: x["w"] for x in r["vector"]} for r in index["landmarks"].select("landmark_id", "vector").collect()}
    asking = {r["query_id"]: r for r in R.with_name_vector(queries, "query_text").withColumn("tokens", R.X.tokens(F.col("query_text"))).collect()}
    points = {r[0]: (r[3], r[4]) for r in rows}
    want = {}
    for q, text, centre, lat, lng, radius in asked:
        away = {d: metres(lat, lng, *p) for d, p in points.items() if p[0] is not None} if centre else {}
        pool = [d for d in points if not centre or away.get(d, math.inf) <= radius]
        lexical = {d: round(sum(impact.get(t, {}).get(d, 0.0) for t in asking[q]["tokens"]), 9) for d in pool}
        dense = {d: round(sum(x["w"] * vectors[d].get(x["bucket"], 0.0) for x in asking[q]["vector"]), 9) for d in pool}
        lists = {"bm25": sorted((-s, d) for d, s in lexical.items() if s > 0), "knn": sorted((-s, d) for d, s in dense.items() if s > 0)}
        if centre and text.strip():
            lists["geo"] = sorted((away[d], d) for d in pool)
        for signal, found in lists.items():
            for rank, (_, d) in enumerate(found[:20], 1):
                want.setdefault((q, d), {})[signal] = rank
    assert got == want and len(want) > 600


def test_no_documents_and_no_queries(spark):
    empty = spark.createDataFrame([], "landmark_id string, canonical_name string, aliases array<string>, lat double, lng double, observation_count int")
    some = spark.createDataFrame([("L1", "shiv mandir", [], 28.6, 77.1, 1)], empty.schema)
    queries = spark.createDataFrame([("q", "shiv", "c", 28.6, 77.1, 3000.0), ("r", "shiv", None, None, None, 3000.0)], "query_id string, query_text string, centre_id string, centre_lat double, centre_lng double, radius_m double")
    assert R.hybrid_retrieve(queries, R.prepare_landmarks(empty)).collect() == []
    assert R.hybrid_retrieve(queries.where("query_id = 'x'"), R.prepare_landmarks(some)).collect() == []
    assert {r["query_id"] for r in R.hybrid_retrieve(queries, R.prepare_landmarks(some)).collect()} == {"q", "r"}


def test_documents_of_equal_content_are_scored_once_and_share_a_block(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_DOCS", 8)
    monkeypatch.setattr(B, "BLOCK_PLACES", 40)
    names = ["shiv mandir 1", "shiv mandir 2", "mandir shiv 1", "gupta store"]
    # 300 landmarks of four names in one square, each name nearer the centre than the next, one name of more than a block's places
    rows = [(f"L{i:04d}", names[3 if i % 4 == 0 else i % 3], [], 28.61 + i * 1e-5, 77.11 + i % 7 * 1e-4, 1) for i in range(300)]
    index = R.prepare_landmarks(spark.createDataFrame(rows, "landmark_id string, canonical_name string, aliases array<string>, lat double, lng double, observation_count int"))
    docs = index["landmarks"].select(F.col("landmark_id").alias("doc"), "lat", "lng", "vector")
    blocks = B.grid_blocks(B.with_parts(docs, index["impacts"].withColumnRenamed("impact", "dw"), "landmark_id"), R.CELL_DEG)
    sizes = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    assert sum(sizes.values()) == 300 and 2 < len(sizes) < 300 // 8  # more than one, and not one per eight documents
    asked = [(f"q{i}", t, f"c{r}", 28.61, 77.11, r) for i, (t, r) in enumerate((t, r) for t in ("shiv", "gupta", "mandir 2", "none") for r in (90.0, 5000.0))]
    queries = spark.createDataFrame(asked, "query_id string, query_text string, centre_id string, centre_lat double, centre_lng double, radius_m double")
    got = {}
    for r in R.hybrid_retrieve(queries, index, use_vector=False, use_geo=False).collect():
        got.setdefault(r["query_id"], []).append((r["signals"]["bm25"], r["landmark_id"]))
    impact = {}
    for r in index["impacts"].collect():
        impact.setdefault(r["landmark_id"], {})[r["term"]] = r["impact"]
    for q, text, _, lat, lng, radius in asked:
        scores = {d: round(sum(impact[d].get(t, 0.0) for t in text.split()), 9) for d, _, _, y, x, _ in rows if metres(lat, lng, y, x) <= radius}
        want = [d for _, d in sorted((-s, d) for d, s in scores.items() if s > 0)[:20]]
        assert [d for _, d in sorted(got.get(q, []))] == want, q


def test_searches_without_a_centre_score_each_content_once(spark, monkeypatch):
    names = ["shiv mandir 1", "shiv mandir 2", "mandir shiv 1", "gupta store"]
    rows = [(f"L{i:04d}", names[3 if i % 30 == 0 else i % 3], [], 28.61, 77.11, 1) for i in range(120)]
    index = R.prepare_landmarks(spark.createDataFrame(rows, "landmark_id string, canonical_name string, aliases array<string>, lat double, lng double, observation_count int"))
    texts = ["shiv", "gupta", "gupta mandir", "1 2", "none"]
    asked = [(f"q{i}", texts[i % 5], None, None, None, 3000.0) for i in range(10)]
    queries = spark.createDataFrame(asked, "query_id string, query_text string, centre_id string, centre_lat double, centre_lng double, radius_m double")
    sizes, by_terms, by_vector = [], R.pruned_top_terms, R.knn_cosine

    def counted(search):
        def run(a, b, *rest):
            sizes.append(b.select("one").distinct().count())
            return search(a, b, *rest)

        return run

    monkeypatch.setattr(R, "pruned_top_terms", counted(by_terms))
    monkeypatch.setattr(R, "knn_cosine", counted(by_vector))
    got = {}
    for r in R.hybrid_retrieve(queries, index).collect():
        for signal, rank in r["signals"].items():
            got.setdefault((r["query_id"], signal), []).append((rank, r["landmark_id"]))
    assert sizes == [3, 4]  # equal words in another order are one content of terms
    impact = {}
    for r in index["impacts"].collect():
        impact.setdefault(r["landmark_id"], {})[r["term"]] = r["impact"]
    vectors = {r["landmark_id"]: {x["bucket"]: x["w"] for x in r["vector"]} for r in index["landmarks"].select("landmark_id", "vector").collect()}
    asking = {r["query_id"]: r["vector"] for r in R.with_name_vector(queries, "query_text").collect()}
    for q, text, *_ in asked:
        lexical = {d: round(sum(impact[d].get(t, 0.0) for t in text.split()), 9) for d in vectors}
        dense = {d: round(sum(x["w"] * v.get(x["bucket"], 0.0) for x in asking[q]), 9) for d, v in vectors.items()}
        for signal, scores in (("bm25", lexical), ("knn", dense)):
            want = [d for _, d in sorted((-s, d) for d, s in scores.items() if s > 0)[:20]]
            assert [d for _, d in sorted(got.get((q, signal), []))] == want, (q, signal)
