"""Reference tables from a raw post-office directory."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, tables
from waymark.functions.text import WORD, literal_map, squeeze
from waymark.operators.skew import grouped_median, grouped_order_stats, salted_join

MEDIAN_RANGE_DEG = 0.01
MEDIAN_RANGE_M = 50.0


def usable_offices(directory: DataFrame) -> DataFrame:
    """Civilian pincodes only, without placeholder rows."""
    placeholder = r"(?i)^\s*(?:test\s*office|dummy|sample|n\.?a\.?|xxx+)\s*$"
    name = F.coalesce(F.col("OfficeName"), F.lit(""))
    return directory.withColumn("Pincode", F.trim("Pincode")).where(
        F.col("Pincode").rlike(r"^[1-8]\d{5}$") & ~name.rlike(placeholder)
    )


def clean_office_name(raw: Column) -> Column:
    """Name without parentheses and without the office type and what follows it."""
    edges = F.lit(" ,-")
    name = squeeze(F.regexp_replace(F.trim(raw), r"\s*\([^)]*\)", " "))
    cut = F.btrim(F.regexp_replace(name, r"(?i)\s*\b(?:G\.?P\.?O|[BSH]\.?O)\b\.?.*$", ""), edges)
    return F.btrim(squeeze(F.coalesce(F.nullif(cut, F.lit("")), name)), edges)


def titlecase_place(raw: Column) -> Column:
    """Capital at the start of every run of letters; NCT and NCR stay capitals."""
    titled = titlecase_name(F.trim(raw))
    return F.regexp_replace(F.regexp_replace(titled, r"\bNct\b", "NCT"), r"\bNcr\b", "NCR")


def titlecase_name(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalised), "")


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000)))


def parse_degrees(text: Column) -> Column:
    numeric = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
    return F.when(text.rlike(numeric), F.trim(text).try_cast("double"))


def with_coordinates(directory: DataFrame) -> DataFrame:
    """Adds lat and lng, both null unless the point lies in the national grid."""
    lat, lng = parse_degrees(F.col("Latitude")), parse_degrees(F.col("Longitude"))
    good = geo.in_grid(F.col("_lat"), F.col("_lng"))
    return (
        directory.withColumn("_lat", lat)
        .withColumn("_lng", lng)
        .withColumn("lat", F.when(good, F.col("_lat")))
        .withColumn("lng", F.when(good, F.col("_lng")))
        .drop("_lat", "_lng")
    )


def office_rows(directory: DataFrame) -> DataFrame:
    """Usable directory rows with every cleaned column the builds share."""
    kind = F.upper(F.trim(F.col("OfficeType")))
    return with_coordinates(usable_offices(directory)).select(
        "line_no",
        F.col("Pincode").alias("pincode"),
        clean_office_name(F.col("OfficeName")).alias("name"),
        kind.alias("office_type"),
        F.when(kind.isin("HO", "GPO"), 0).when(kind == "SO", 1).when(kind == "BO", 2).otherwise(3).alias("type_rank"),
        titlecase_place(F.col("District")).alias("district"),
        titlecase_place(F.col("StateName")).alias("state"),
        "lat",
        "lng",
        F.col("Delivery").alias("delivery"),
        F.col("Latitude").alias("lat_text"),
        F.col("Longitude").alias("lng_text"),
    )


def build_gazetteer(offices: DataFrame) -> DataFrame:
    """One row per pincode: best name, district, state, median point, office count.

    ``offices`` has pincode, name, type_rank, district, state, lat, lng, line_no.
    """
    named = F.when(F.col("name") != "", F.struct("type_rank", "name"))
    base = offices.groupBy("pincode").agg(
        F.min(named).alias("_best"),
        F.min_by(F.struct("district", "state"), "line_no").alias("_place"),
        F.count("*").cast("int").alias("office_count"),
    )
    points = offices.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        "pincode",
        F.explode(
            F.array(
                F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("deg")),
                F.struct(F.lit("lng").alias("axis"), F.col("lng").alias("deg")),
            )
        ).alias("_p"),
    )
    medians = grouped_median(
        points.select("pincode", "_p.axis", "_p.deg"), ["pincode", "axis"], "deg", MEDIAN_RANGE_DEG, "deg"
    )
    centre = medians.groupBy("pincode").agg(
        F.round(F.max(F.when(F.col("axis") == "lat", F.col("deg"))), 6).alias("lat"),
        F.round(F.max(F.when(F.col("axis") == "lng", F.col("deg"))), 6).alias("lng"),
    )
    return base.join(centre, "pincode", "left").select(
        "pincode",
        F.coalesce(F.col("_best.name"), F.lit("")).alias("locality"),
        F.coalesce(F.col("_place.district"), F.lit("")).alias("district"),
        F.coalesce(F.col("_place.state"), F.lit("")).alias("state"),
        "lat",
        "lng",
        "office_count",
    )


def build_locality_index(offices: DataFrame) -> DataFrame:
    """Every distinct (pincode, office name)."""
    return offices.where(F.col("name") != "").select("pincode", F.col("name").alias("locality")).distinct()


def build_stats(directory: DataFrame) -> DataFrame:
    """One row of counts about a build."""
    usable = office_rows(directory)
    per_pin = usable.groupBy("pincode").agg(
        F.count("*").alias("rows"), F.count_if(F.col("lat").isNull()).alias("bad")
    )
    kept = per_pin.agg(
        F.sum("rows").alias("rows_read"),
        F.count("*").alias("pincodes"),
        F.count_if(F.col("rows") == F.col("bad")).alias("no_centroid"),
        F.sum("bad").alias("bad_coordinates"),
    )
    total = directory.agg(F.count("*").alias("t")).scalar()
    localities = build_locality_index(usable).agg(F.count("*").alias("c")).scalar()
    return kept.select("*", (total - F.col("rows_read")).alias("rejected"), localities.alias("localities"))


def city_for_district(district: Column, state: Column) -> Column:
    """The city people write for a district; null for an empty district."""
    compass = F.lower(district).isin(*tables.COMPASS_DISTRICTS)
    return F.when(
        district.isNotNull() & (district != ""),
        F.when((F.lower(state) == "delhi") | compass, "New Delhi").otherwise(
            F.coalesce(F.element_at(literal_map(tables.CITY_BY_DISTRICT), district), district)
        ),
    )


def seed_city(district: Column, state: Column) -> Column:
    return F.when((state == "Delhi") | district.isin(*tables.DELHI_DISTRICTS), "New Delhi").otherwise(
        F.coalesce(city_for_district(district, state), district)
    )


def normalise_name(name: Column) -> Column:
    """Names in one case only get a capital per alphabetic word."""
    one_case = (F.upper(name) != F.lower(name)) & ((name == F.upper(name)) | (name == F.lower(name)))
    words = F.transform(
        F.split(name, " "), lambda w: F.when(w.rlike(r"^\p{L}+$"), capitalised(w)).otherwise(w)
    )
    return F.when(one_case, F.array_join(words, " ")).otherwise(name)


def written_decimals(text: Column) -> Column:
    return F.length(F.regexp_extract(F.trim(text), r"\.(.*)$", 1))


def delivery_offices(directory: DataFrame) -> DataFrame:
    """Delivery offices whose coordinate and name can serve as ground truth."""
    surveyed = ~(
        (F.round("lat", 2) == F.col("lat")) & (F.round("lng", 2) == F.col("lng"))
    )
    return (
        office_rows(directory)
        .where(F.lower(F.trim(F.coalesce(F.col("delivery"), F.lit("")))) == "delivery")
        .where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .where(F.least(written_decimals(F.col("lat_text")), written_decimals(F.col("lng_text"))) >= 4)
        .where(surveyed)
        .withColumn("name", normalise_name(F.col("name")))
        .where(F.length("name") >= 3)
        .where(~F.upper("name").isin("GPO", "HO", "SO", "BO") & F.col("name").rlike("[A-Za-z]{3}"))
        .withColumn("city", seed_city(F.col("district"), F.col("state")))
        .select("line_no", "name", "pincode", "district", "state", "city", "lat", "lng", "office_type")
    )


def state_bounds(offices: DataFrame, min_rows: int = 20, pad_deg: float = 0.5) -> DataFrame:
    """Padded 1st to 99th percentile box of each state with enough offices."""
    axes = offices.select(
        "state",
        F.explode(
            F.array(
                F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("deg")),
                F.struct(F.lit("lng").alias("axis"), F.col("lng").alias("deg")),
            )
        ).alias("_p"),
    ).select("state", "_p.axis", "_p.deg")
    n = F.col("n")
    stats = grouped_order_stats(
        axes,
        ["state", "axis"],
        "deg",
        {q: F.least(n - 1, F.floor((n - 1) * F.lit(p))) for q, p in (("low", 0.01), ("high", 0.99))},
        MEDIAN_RANGE_DEG,
    ).where(n >= min_rows)

    def edge(axis, which, pad):
        return (F.max(F.when(F.col("axis") == axis, F.col(which))) + pad).alias(
            f"{'min' if which == 'low' else 'max'}_{axis}"
        )

    return stats.groupBy("state").agg(
        edge("lat", "low", -pad_deg), edge("lng", "low", -pad_deg), edge("lat", "high", pad_deg), edge("lng", "high", pad_deg)
    )


def in_state_bounds(offices: DataFrame, bounds: DataFrame) -> DataFrame:
    """Offices inside their state's box; states without a box keep all."""
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lng").between(
        F.col("min_lng"), F.col("max_lng")
    )
    return (
        salted_join(offices, bounds, ["state"], ["line_no"])
        .where(F.col("min_lat").isNull() | inside)
        .drop("min_lat", "min_lng", "max_lat", "max_lng")
    )


def drop_district_outliers(
    offices: DataFrame, min_rows: int = 10, floor_m: float = 25_000.0, factor: float = 5.0
) -> DataFrame:
    """Drops offices far from their district's median point, by its own spread."""
    keys = ["state", "district"]
    axes = offices.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("deg")),
                F.struct(F.lit("lng").alias("axis"), F.col("lng").alias("deg")),
            )
        ).alias("_p"),
    ).select(*keys, "_p.axis", "_p.deg")
    n = F.col("n")
    centre = (
        grouped_order_stats(
            axes, [*keys, "axis"], "deg", {"_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2)}, MEDIAN_RANGE_DEG
        )
        .groupBy(*keys)
        .agg(
            F.max("n").alias("_n"),
            F.max(F.when(F.col("axis") == "lat", (F.col("_lo") + F.col("_hi")) / 2)).alias("_clat"),
            F.max(F.when(F.col("axis") == "lng", (F.col("_lo") + F.col("_hi")) / 2)).alias("_clng"),
        )
    )
    placed = salted_join(offices, centre, keys, ["line_no"], "inner").withColumn(
        "_d", geo.haversine_m(F.col("_clat"), F.col("_clng"), F.col("lat"), F.col("lng"))
    )
    typical = grouped_median(placed, keys, "_d", MEDIAN_RANGE_M, "_typical")
    limit = F.greatest(F.lit(floor_m), F.col("_typical") * factor)
    return (
        salted_join(placed, typical, keys, ["line_no"], "inner")
        .where((F.col("_n") < min_rows) | (F.col("_d") <= limit))
        .select(offices.columns)
    )


def known_cities(gazetteer: DataFrame) -> DataFrame:
    """Distinct districts as (city_key, city)."""
    return (
        gazetteer.where(F.col("district") != "")
        .groupBy(F.lower("district").alias("city_key"))
        .agg(F.max("district").alias("city"))
    )


def first_word(phrase: Column) -> Column:
    return F.regexp_extract(F.lower(phrase), rf"([{WORD}]+)", 1)
