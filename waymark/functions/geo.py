"""Column expressions over coordinates and the 4x4 hierarchical grid."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import tables
from waymark.functions.text import literal_map

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0

# The grid's box, its depth and its symbols, south-west first.
MIN_LAT, MAX_LAT = 2.5, 38.5
MIN_LNG, MAX_LNG = 63.5, 99.5
LEVELS = 10
SYMBOLS = "LMPTK456J327FC98"

CELL_DEGREES = 36.0 / 2**20
LAST_CELL = 2**20 - 1


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0)
    )
    # least() skips nulls, so a missing point is kept missing by hand
    return F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h))) * F.lit(2 * EARTH_RADIUS_M)


def in_grid(lat: Column, lng: Column) -> Column:
    return lat.between(MIN_LAT, MAX_LAT) & lng.between(MIN_LNG, MAX_LNG)


def grid_cell(lat: Column, lng: Column, level: int = LEVELS) -> Column:
    """Grid code of a point; null outside the grid.

    The box is 36 degrees wide and halves exactly twice per level, so row and
    column are plain integers and each level reads two bits of both.
    """
    row = F.least(F.floor((lat - MIN_LAT) / CELL_DEGREES), F.lit(LAST_CELL))
    col = F.least(F.floor((lng - MIN_LNG) / CELL_DEGREES), F.lit(LAST_CELL))

    def symbol(depth: int) -> Column:
        bits = 2 * (LEVELS - 1 - depth)
        r = F.shiftright(row, bits).bitwiseAND(F.lit(3))
        c = F.shiftright(col, bits).bitwiseAND(F.lit(3))
        return F.substring(F.lit(SYMBOLS), (r * 4 + c + 1).cast("int"), F.lit(1))

    return F.when(in_grid(lat, lng), F.concat(*[symbol(d) for d in range(level)]))


def clean_cell(code: Column) -> Column:
    """Canonical ten-symbol code, or null when it is none."""
    pin = F.regexp_replace(F.upper(F.trim(code)), "[- ]", "")
    return F.when(pin.rlike(f"^[{''.join(sorted(SYMBOLS))}]{{10}}$"), pin)


def display_cell(cell: Column) -> Column:
    return F.concat_ws("-", F.substring(cell, 1, 3), F.substring(cell, 4, 3), F.substring(cell, 7, 4))


def cell_box(cell: Column) -> Column:
    """Struct (min_lat, min_lng, max_lat, max_lng) of a canonical code."""

    def index(component) -> Column:
        total = F.lit(0)
        for depth in range(LEVELS):
            place = F.instr(F.lit(SYMBOLS), F.substring(cell, depth + 1, 1)) - 1
            total = total * 4 + component(place)
        return total

    row = index(lambda p: F.floor(p / 4))
    col = index(lambda p: p % 4)
    lat, lng = row * CELL_DEGREES + MIN_LAT, col * CELL_DEGREES + MIN_LNG
    return F.when(
        cell.isNotNull(),
        F.struct(
            lat.alias("min_lat"),
            lng.alias("min_lng"),
            (lat + CELL_DEGREES).alias("max_lat"),
            (lng + CELL_DEGREES).alias("max_lng"),
        ),
    )


def offset_point(lat: Column, lng: Column, metres: Column, bearing_deg: float = 0.0) -> Column:
    """Struct (lat, lng): the point moved over flat ground."""
    bearing = F.radians(F.lit(float(bearing_deg)))
    east = metres * F.sin(bearing) / (F.cos(F.radians(lat)) * METRES_PER_DEGREE)
    north = metres * F.cos(bearing) / METRES_PER_DEGREE
    moved = metres != 0.0
    return F.struct(
        F.when(moved, lat + north).otherwise(lat).alias("lat"),
        F.when(moved, lng + east).otherwise(lng).alias("lng"),
    )


def relation_offset_m(relation: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(tables.RELATION_OFFSET_M), relation), F.lit(0.0))


def centroid_accuracy_m(office_count: Column) -> Column:
    """1.2 km for one office, 8 km from thirty up, logarithmic between."""
    n = F.greatest(F.lit(1), office_count).cast("double")
    grown = F.least(F.lit(1.0), F.log(n) / F.log(F.lit(30.0)))
    return F.when(office_count.isNotNull(), grown * 6_800.0 + 1_200.0).otherwise(8_000.0)


def landmark_accuracy_m(observations: Column, relation: Column) -> Column:
    seen = F.greatest(F.lit(1), observations).cast("double")
    return (
        (F.lit(1.0) + F.lit(2.0) / F.sqrt(seen)) * 60.0
        + F.when(relation == "inside", 120.0).otherwise(0.0)
        + relation_offset_m(relation)
    )


def cells_within(lat: Column, lng: Column, radius_m: Column, width: float) -> Column:
    """Array of (cy, cx): every ``width``-degree square a circle can touch."""
    dlat = radius_m / 111_000.0
    dlng = dlat / F.cos(F.radians(F.least(F.abs(lat) + dlat, F.lit(89.0))))
    rows = F.sequence(F.floor((lat - dlat) / width), F.floor((lat + dlat) / width))
    cols = F.sequence(F.floor((lng - dlng) / width), F.floor((lng + dlng) / width))
    return F.flatten(
        F.transform(rows, lambda y: F.transform(cols, lambda x: F.struct(y.alias("cy"), x.alias("cx"))))
    )


def square(lat: Column, lng: Column, width: float) -> Column:
    return F.struct(F.floor(lat / width).alias("cy"), F.floor(lng / width).alias("cx"))
