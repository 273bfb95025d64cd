"""Ground-truth addresses and landmark entities from directory offices."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, tables
from waymark.functions.text import literal_map
from waymark.operators.skew import salted_join

# Search squares from fine to coarse, in degrees. A point that has enough
# neighbours within one square's width is settled there, so dense areas are
# never compared over the wide squares.
SEARCH_LEVELS = (0.0005, 0.005, 0.05)
MIN_LEVEL_LAT = 39.0


def nearest_places(
    points: DataFrame, places: DataFrame, wanted: int, min_m: float, max_m: float
) -> DataFrame:
    """The ``wanted`` nearest distinct place names of each point.

    points: lat, lng (distinct). places: place_key, name, lat, lng.
    Returns lat, lng, place_key, name, place_lat, place_lng, distance_m, place_rank.

    Places on one spot count as one: only its first ``wanted`` names can ever
    be among the nearest. Points are searched over growing squares and leave
    as soon as the next square cannot bring anything nearer.
    """
    spot = Window.partitionBy("place_lat", "place_lng").orderBy("place_key")
    candidates = (
        places.groupBy("place_key", F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"))
        .agg(F.min("name").alias("name"))
        .withColumn("_r", F.row_number().over(spot))
        .where(F.col("_r") <= wanted)
        .drop("_r")
    )
    nearest_of_name = Window.partitionBy("lat", "lng").orderBy("distance_m", "place_key")
    open_points, settled = points.select("lat", "lng"), None
    metres = geo.METRES_PER_DEGREE * 0.99
    levels = [w for w in SEARCH_LEVELS if w * metres < max_m] + [max(SEARCH_LEVELS)]
    for width in dict.fromkeys(levels):
        last = width == levels[-1]
        reach = max_m if last else min(max_m, width * metres * math.cos(math.radians(MIN_LEVEL_LAT)))
        around = open_points.withColumn(
            "_cell",
            F.explode(geo.cells_within(F.col("lat"), F.col("lng"), F.lit(float(reach)), width)),
        )
        found = (
            around.join(
                candidates.withColumn("_cell", geo.square(F.col("place_lat"), F.col("place_lng"), width)), "_cell"
            )
            .withColumn(
                "distance_m",
                geo.haversine_m(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng")),
            )
            .where((F.col("distance_m") > min_m) & (F.col("distance_m") <= reach))
            .groupBy("lat", "lng", "place_key")
            .agg(F.min(F.struct("distance_m", "name", "place_lat", "place_lng")).alias("_p"))
            .select("lat", "lng", "place_key", "_p.*")
            .withColumn("place_rank", F.row_number().over(nearest_of_name))
            .where(F.col("place_rank") <= wanted)
            .groupBy("lat", "lng")
            .agg(
                F.collect_list(
                    F.struct("place_key", "name", "place_lat", "place_lng", "distance_m", "place_rank")
                ).alias("_near")
            )
        )
        searched = open_points.join(found, ["lat", "lng"], "left")
        enough = F.coalesce(F.size("_near") == wanted, F.lit(False))
        part = searched if last else searched.where(enough)
        part = part.select("lat", "lng", F.inline("_near"))
        open_points = searched.where(~enough).select("lat", "lng")
        settled = part if settled is None else settled.unionByName(part)
    return settled


def nearby_landmarks(
    offices: DataFrame, max_m: float = 3_000.0, limit: int = 2, min_m: float = 25.0
) -> DataFrame:
    """Up to ``limit`` named places around each office, nearest first.

    A place that only repeats the office's own name, city, district or state
    does not count, so four more places than asked for are looked up per spot.
    """
    places = offices.select(F.lower("name").alias("place_key"), "name", "lat", "lng")
    spots = offices.select("lat", "lng").distinct()
    around = nearest_places(spots, places, limit + 4, min_m, max_m)
    own = F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("own_name", "city", "district", "state")])
    order = Window.partitionBy("line_no").orderBy("distance_m", "place_key")
    return (
        salted_join(offices.withColumnRenamed("name", "own_name"), around, ["lat", "lng"], ["line_no"], "inner")
        .where(~F.array_contains(own, F.col("place_key")))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(
            "line_no",
            "rank",
            "name",
            F.round("place_lat", 6).alias("true_lat"),
            F.round("place_lng", 6).alias("true_lng"),
            F.round("distance_m", 1).alias("distance_m"),
        )
    )


def sample_seeds(offices: DataFrame, n: int = 120, seed: str = "20260917") -> DataFrame:
    """``n`` offices, one per pincode, target cities in turn, then the rest."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), "pincode", "name"))
    one_per_pin = (
        offices.withColumn("_draw", draw)
        .groupBy("pincode")
        .agg(F.min_by(F.struct(*offices.columns, "_draw"), F.struct("_draw", "line_no")).alias("_o"))
        .select("_o.*")
    )
    city_rank = literal_map({c: i for i, c in enumerate(tables.TARGET_CITIES)})
    turn = Window.partitionBy("_city").orderBy("_draw", "line_no")
    with_city = one_per_pin.withColumn("_city", F.element_at(city_rank, F.col("city")))
    targets = (
        with_city.where(F.col("_city").isNotNull())
        .withColumn("_turn", F.row_number().over(turn))
        .where(F.col("_turn") <= n)
        .withColumn("_rest", F.lit(0))
    )
    rest = with_city.where(F.col("_city").isNull()).withColumn("_turn", F.lit(0)).withColumn("_rest", F.lit(1))
    return (
        targets.unionByName(rest)
        .orderBy("_rest", "_turn", "_city", "_draw", "line_no")
        .limit(n)
        .select(offices.columns)
    )


def sub_locality_of(name: Column) -> Column:
    pattern = r"(?i)\b(sector|phase)\s*[:\-]?\s*([0-9]{1,3}\s*[a-z]?|[ivx]{1,4})\b"
    return F.when(
        name.rlike(pattern),
        F.concat_ws(
            " ",
            F.initcap(F.regexp_extract(name, pattern, 1)),
            F.replace(F.upper(F.regexp_extract(name, pattern, 2)), F.lit(" "), F.lit("")),
        ),
    )


def compose_seeds(offices: DataFrame, nearby: DataFrame) -> DataFrame:
    """Seed rows: canonical text, truth fields, rounded point and its cell."""
    first = nearby.where(F.col("rank") == 1).select("line_no", F.col("name").alias("near_name"))
    near = F.when(F.col("near_name").isNotNull(), F.concat(F.lit("near "), F.col("near_name")))
    city = F.when((F.col("city") != "") & (F.lower("city") != F.lower("name")), F.col("city"))
    state = F.when((F.col("state") != "") & (F.lower("state") != F.lower("city")), F.col("state"))
    segments = F.array_distinct(
        F.array_compact(F.array(F.concat(F.col("name"), F.lit(" Post Office")), near, city, state))
    )
    return (
        offices.join(first, "line_no", "left")
        .withColumn("raw", F.concat(F.array_join(segments, ", "), F.lit(" - "), F.col("pincode")))
        .withColumn("lat", F.round("lat", 6))
        .withColumn("lng", F.round("lng", 6))
        .select(
            F.concat(F.lit("SEED#"), F.col("line_no").cast("string")).alias("seed_id"),
            "line_no",
            "raw",
            F.when(F.col("near_name").isNull(), "postal").otherwise("landmark").alias("shape"),
            sub_locality_of(F.col("name")).alias("sub_locality"),
            F.col("name").alias("locality"),
            F.nullif("city", F.lit("")).alias("city"),
            F.nullif("district", F.lit("")).alias("district"),
            F.nullif("state", F.lit("")).alias("state"),
            "pincode",
            "lat",
            "lng",
            geo.grid_cell(F.col("lat"), F.col("lng")).alias("cell"),
        )
    )


def infer_type(name: Column) -> Column:
    low, kind = F.lower(name), F.lit("unknown")
    for label, words in reversed(tables.TYPE_HINTS):
        hit = low.rlike("|".join(words))
        kind = F.when(hit, label).otherwise(kind)
    return kind


def landmark_key(name: Column, lat: Column, lng: Column, state: Column) -> Column:
    """Stable id of a place: name, point to five decimals, state code."""

    def fixed(v):
        return F.round(v * 100000.0).cast("long").cast("string")

    code = F.coalesce(F.element_at(literal_map(tables.STATE_CODES), state), F.lit("IN"))
    digest = F.sha2(F.concat_ws("|", F.lower(name), fixed(lat), fixed(lng)), 256)
    return F.concat(F.lit("LMK#"), code, F.lit("#"), F.upper(digest))


def seed_places(seeds: DataFrame, nearby: DataFrame) -> DataFrame:
    """Every place a seed names: its own locality and what it is near."""
    own = seeds.select(
        "seed_id", "line_no", F.lit(0).alias("ord"), F.col("locality").alias("name"), "lat", "lng", "pincode", "state"
    )
    near = nearby.join(seeds.select("seed_id", "line_no", "pincode", "state"), "line_no").select(
        "seed_id", "line_no", F.col("rank").alias("ord"), "name",
        F.col("true_lat").alias("lat"), F.col("true_lng").alias("lng"), "pincode", "state",
    )
    key = landmark_key(F.col("name"), F.col("lat"), F.col("lng"), F.coalesce(F.col("state"), F.lit("")))
    return own.unionByName(near).withColumn("landmark_id", key)


def build_landmarks(places: DataFrame) -> DataFrame:
    """One landmark per id; the first mention decides its fields.

    An id hashes the lower-case name, so the spellings gathered per id differ
    in case only.
    """
    merged = places.groupBy("landmark_id").agg(
        F.min_by(F.struct("name", "lat", "lng", "pincode"), F.struct("line_no", "ord")).alias("_p"),
        F.collect_set(F.lower("name")).alias("_names"),
    )
    return merged.select(
        "landmark_id",
        F.col("_p.name").alias("canonical_name"),
        F.array_sort(F.array_except("_names", F.array(F.lower("_p.name")))).alias("aliases"),
        infer_type(F.col("_p.name")).alias("type"),
        F.col("_p.lat").alias("lat"),
        F.col("_p.lng").alias("lng"),
        geo.grid_cell(F.col("_p.lat"), F.col("_p.lng")).alias("digipin_cell"),
        F.col("_p.pincode").alias("pincode"),
    )


def warm_observations(places: DataFrame, corpus: DataFrame) -> DataFrame:
    """How often the corpus mentions each landmark, and the trust that gives."""
    per_seed = corpus.groupBy("seed_id").agg(F.count("*").alias("_n"))
    seen = places.join(per_seed, "seed_id").groupBy("landmark_id").agg(F.sum("_n").alias("_seen"))
    n = F.coalesce("_seen", F.lit(1)).cast("int")
    return (
        places.select("landmark_id")
        .distinct()
        .join(seen, "landmark_id", "left")
        .select(
            "landmark_id",
            n.alias("observation_count"),
            F.round(F.least(F.lit(0.95), (n - 1) * 0.1 + 0.5), 6).alias("confidence"),
        )
    )
