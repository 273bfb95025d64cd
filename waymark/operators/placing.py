"""Jobs over points and grid cells."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.skew import salted_join


def with_grid_cell(df: DataFrame, lat: str, lng: str, level: int = geo.LEVELS, out: str = "cell") -> DataFrame:
    return df.withColumn(out, geo.grid_cell(F.col(lat), F.col(lng), level))


def cell_bounds(df: DataFrame, cell: str) -> DataFrame:
    """Box and centre of each cell."""
    box = geo.cell_box(F.col(cell))
    return (
        df.withColumn("_box", box)
        .select("*", "_box.*")
        .drop("_box")
        .withColumn("centre_lat", F.round((F.col("min_lat") + F.col("max_lat")) / 2, 6))
        .withColumn("centre_lng", F.round((F.col("min_lng") + F.col("max_lng")) / 2, 6))
    )


def clean_cells(df: DataFrame, code: str) -> DataFrame:
    """Canonical code, its display form, and whether the input was a code at all."""
    cleaned = geo.clean_cell(F.col(code))
    return (
        df.withColumn("cell", cleaned)
        .withColumn("display", F.when(F.col("cell").isNotNull(), geo.display_cell(F.col("cell"))))
        .withColumn("valid", F.col("cell").isNotNull())
    )


def rollup_by_cell(df: DataFrame, cell: str, lat: str, lng: str, level: int) -> DataFrame:
    """Counts and centroid per cell prefix; a shared prefix means nearby."""
    return (
        df.where(F.col(cell).isNotNull())
        .groupBy(F.substring(cell, 1, level).alias("cell_prefix"))
        .agg(
            F.count("*").alias("points"),
            F.round(F.avg(lat), 9).alias("lat"),
            F.round(F.avg(lng), 9).alias("lng"),
        )
    )


def dedupe_by_cell(df: DataFrame, row_id: str, cell: str) -> DataFrame:
    """Rows that share a doorstep cell with another row, and the cell's first row."""
    shared = (
        df.where(F.col(cell).isNotNull())
        .groupBy(cell)
        .agg(F.count("*").alias("rows_in_cell"), F.min(row_id).alias("first_row"))
        .where(F.col("rows_in_cell") > 1)
    )
    return salted_join(df.select(row_id, cell), shared, [cell], [row_id], "inner")


def geocode_cascade(
    addresses: DataFrame, geocoder_points: DataFrame | None = None, point_key: str = "order_id"
) -> DataFrame:
    """Places each address by the best source that answers.

    addresses: order_id; landmark_lat/lng/observations/relation of the match
    (null if none); centroid_lat/lng and office_count of the pincode (null if
    none); geocoder points, if any, as geo_lat, geo_lng and geo_accuracy_m of
    the addresses or of a table by ``point_key``.
    """
    df = addresses
    if geocoder_points is not None:
        df = df.join(geocoder_points, point_key, "left")
    elif "geo_lat" not in df.columns:
        df = df.withColumns({c: F.lit(None).cast("double") for c in ("geo_lat", "geo_lng", "geo_accuracy_m")})

    def point(lat: Column, lng: Column, source: str, accuracy: Column) -> Column:
        return F.struct(
            lat.alias("lat"), lng.alias("lng"), F.lit(source).alias("source"), accuracy.alias("accuracy_m")
        )

    relation = F.coalesce("landmark_relation", F.lit("near"))
    moved = geo.offset_point(F.col("landmark_lat"), F.col("landmark_lng"), geo.relation_offset_m(relation))
    landmark = F.when(
        F.col("landmark_lat").isNotNull(),
        point(
            F.round(moved["lat"], 6),
            F.round(moved["lng"], 6),
            "landmark_graph",
            F.round(geo.landmark_accuracy_m(F.col("landmark_observations"), relation), 1),
        ),
    )
    street = F.when(
        F.col("geo_lat").isNotNull(),
        point(F.round("geo_lat", 6), F.round("geo_lng", 6), "geocoder", F.col("geo_accuracy_m")),
    )
    centroid = F.when(
        F.col("centroid_lat").isNotNull(),
        point(
            F.col("centroid_lat"),
            F.col("centroid_lng"),
            "pincode_centroid",
            F.round(geo.centroid_accuracy_m(F.col("office_count")), 1),
        ),
    )
    return df.withColumn("geo", F.coalesce(landmark, street, centroid)).drop("geo_lat", "geo_lng", "geo_accuracy_m")
