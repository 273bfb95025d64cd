"""Pinned values of the grid and of distances."""

import math

from pyspark.sql import functions as F

from waymark.functions import geo

SPREAD = [
    (28.6224, 77.2085), (19.0760, 72.8777), (12.9716, 77.5946), (22.5726, 88.3639), (13.0827, 80.2707),
    (26.9124, 75.7873), (34.0837, 74.7973), (8.0883, 77.5385), (27.0844, 93.6053), (23.0225, 72.5714),
]


def points(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "i int, lat double, lng double")


def test_official_vector_and_edges(spark):
    rows = points(spark, [(13.11179621, 80.20264269), (38.5, 99.5), (2.5, 63.5), (2.4, 70.0)])
    got = [r[0] for r in rows.orderBy("i").select(geo.grid_cell(F.col("lat"), F.col("lng"))).collect()]
    assert got == ["4T396F42L7", "8888888888", "LLLLLLLLLL", None]


def test_round_trip(spark):
    rows = points(spark, SPREAD).withColumn("cell", geo.grid_cell(F.col("lat"), F.col("lng"))).withColumn("b", geo.cell_box(F.col("cell")))
    for r in rows.collect():
        b = r["b"]
        assert b["min_lat"] <= r["lat"] <= b["max_lat"] and b["min_lng"] <= r["lng"] <= b["max_lng"]
        assert 3.0 < (b["max_lat"] - b["min_lat"]) * 111_320 < 4.5
        clat, clng = (b["min_lat"] + b["max_lat"]) / 2, (b["min_lng"] + b["max_lng"]) / 2
        assert math.hypot((clat - r["lat"]) * 111_320, (clng - r["lng"]) * 111_320 * math.cos(math.radians(r["lat"]))) < 5


def test_clean_cell(spark):
    codes = [" 4t3-96f-42l7 ", "4T396F42L7", "4T396F42L", "4T396F42LA", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string").orderBy("i")
    assert [r[0] for r in df.select(geo.clean_cell(F.col("c"))).collect()] == ["4T396F42L7", "4T396F42L7", None, None, None]


def test_missing_points_stay_missing(spark):
    df = spark.createDataFrame([(None, None, None)], "lat double, lng double, n int")
    row = df.select(
        geo.haversine_m(F.col("lat"), F.col("lng"), F.lit(1.0), F.lit(1.0)).alias("d"), geo.centroid_accuracy_m(F.col("n")).alias("a")
    ).first()
    assert row["d"] is None and row["a"] == 8000.0


def test_centroid_accuracy(spark):
    df = spark.createDataFrame([(1,), (30,), (100,)], "n int")
    assert [round(r[0], 6) for r in df.orderBy("n").select(geo.centroid_accuracy_m(F.col("n"))).collect()] == [1200.0, 8000.0, 8000.0]


def test_cells_within_cover_the_circle(spark):
    """Every point inside the radius lies in one of the squares."""
    import random

    rng = random.Random(4)
    rows = []
    for _ in range(300):
        lat, lng, r = rng.uniform(8, 37), rng.uniform(68, 97), rng.choice([3000.0, 20000.0])
        bearing, d = rng.uniform(0, 2 * math.pi), rng.uniform(0, r * 0.9999)
        plat = lat + d * math.cos(bearing) / 111_195
        plng = lng + d * math.sin(bearing) / (111_195 * math.cos(math.radians(lat)))
        rows.append((lat, lng, r, plat, plng))
    df = spark.createDataFrame(rows, "lat double, lng double, r double, plat double, plng double")
    inside = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng")) <= F.col("r")
    covered = F.array_contains(geo.cells_within(F.col("lat"), F.col("lng"), F.col("r"), 0.05), geo.square(F.col("plat"), F.col("plng"), 0.05))
    assert df.where(inside & ~covered).count() == 0
