"""Landmark compaction, access notes per cell, and answers from customers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions import text as X
from waymark.operators.graph import connected
from waymark.operators.retrieval import VECTOR_SHARE, name_affinity, with_name_vector
from waymark.operators.skew import each, salted_join, split_join
from waymark.sources.warehouse import staged

#: Names are one place's from this affinity on, if the places are no further apart than this.
SAME_AFFINITY, SAME_M = 0.8, 150.0


def notes_for_cells(rows: DataFrame, notes: DataFrame, cell: str, row_id: str, limit: int) -> DataFrame:
    """The ``limit`` most upvoted notes of each row's cell."""
    order = Window.partitionBy(cell).orderBy(F.desc("upvotes"), F.asc("note_id"))
    best = notes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return salted_join(rows, best, [cell], [row_id], "inner").select(row_id, "note_id", "upvotes", "rank")


def compact_landmarks(landmarks: DataFrame, level: int) -> DataFrame:
    """Landmarks of one name within one cell prefix become one, weighted by observations."""
    n = F.col("observation_count")
    return (
        landmarks.groupBy(F.lower("canonical_name").alias("name_key"), F.substring("cell", 1, level).alias("cell_prefix"))
        .agg(
            F.min("landmark_id").alias("landmark_id"),
            F.count("*").alias("merged"),
            F.sum(n).alias("observation_count"),
            F.round(F.sum(F.col("lat") * n) / F.sum(n), 6).alias("lat"),
            F.round(F.sum(F.col("lng") * n) / F.sum(n), 6).alias("lng"),
        )
    )


def spelled_out(name: Column) -> Column:
    """A name with dotted initials as one word: S.B.I. and SBI are the same."""
    return F.trim(F.regexp_replace(F.lower(name), r"(?<=\b\p{L})\.(?=\p{L}\b)|(?<=\.\p{L})\.", ""))


def affine_pairs(places: DataFrame, affinity: float, metres: float) -> DataFrame:
    """(a, b) of places whose names have at least this affinity and that are no further apart.

    places: place, name, lat, lng. An affinity of p needs either a share of p of all words, or
    a cosine of p / ``VECTOR_SHARE``. Both are bounded from below by what two names must have in
    common: of n words one of the rarest n - ceil(p n) + 1 of each; of a vector one of the rarest components that
    carry all but the bound of its length. So pairs meet on (square, such a part) only, in the
    squares around the one whose square comes first, and are then compared whole. A square's pairs are never listed.
    """
    names = staged(
        with_name_vector(places.withColumn("words", F.array_distinct(X.tokens(F.col("name")))), "name"), "named_places"
    )
    words = each(names, ["place"], F.col("words"), "part")
    grams = each(names, ["place"], F.col("vector"), "bucket", "w")
    order = Window.partitionBy("place").orderBy("df", "part")  # a name's words
    first = words.join(words.groupBy("part").agg(F.count("*").alias("df")), "part").withColumn("nth", F.row_number().over(order))
    n = F.size("words")
    kept = first.join(names.select("place", "words"), "place").where(F.col("nth") <= n - F.ceil(n * affinity - 1e-9) + 1).select("place", F.concat(F.lit("w"), "part").alias("part"))
    bound = affinity / VECTOR_SHARE
    rare_last = Window.partitionBy("place").orderBy(F.desc("df"), F.desc("bucket"))  # a name's trigrams
    weighed = grams.join(grams.groupBy("bucket").agg(F.count("*").alias("df")), "bucket").withColumn("rest", F.sum(F.col("w") * F.col("w")).over(rare_last))
    # the parts left out are the common ones that together stay below the bound
    carried = weighed.where(F.col("rest") >= bound * bound - 1e-9).select("place", F.concat(F.lit("v"), F.col("bucket").cast("string")).alias("part"))
    parts = staged(kept.unionByName(carried).join(names.select("place", "lat", "lng"), "place"), "name_parts")
    width = metres / geo.METRES_PER_DEGREE
    # what meets by an equal hash only is told apart like all that meets
    spot = F.xxhash64("square", "part").alias("spot")
    parts = parts.withColumn("own", geo.square(F.col("lat"), F.col("lng"), width))
    around = parts.select("part", "place", "own", F.explode(geo.cells_within(F.col("lat"), F.col("lng"), F.lit(metres), width)).alias("square"))
    around = around.where("square >= own").select(spot, F.col("place").alias("a"), (F.col("square") == F.col("own")).alias("inside"))
    placed = parts.withColumnRenamed("own", "square").select(spot, F.col("place").alias("b"))
    met = split_join(around, placed, ["spot"], "a", "b").where("a < b or a > b and not inside")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # names and vectors go along with pairs that are near only
    of = lambda side, *columns: names.select(F.col("place").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    near = geo.haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) <= metres
    met = met.join(of("a", "lat", "lng"), "a").join(of("b", "lat", "lng"), "b").where(near).select("a", "b")
    both = staged(met, "near_places").join(of("a", "name", "vector"), "a").join(of("b", "name", "vector"), "b")
    alike = name_affinity(F.col("a_name"), F.col("a_vector"), F.array("b_name"), F.map_from_entries("b_vector")) >= affinity
    return both.where(alike).select("a", "b")


def merge_landmarks(landmarks: DataFrame, affinity: float = SAME_AFFINITY, metres: float = SAME_M) -> DataFrame:
    """Landmarks that are one place become one: the smallest id, all spellings, the weighted centre.

    landmarks: landmark_id (a number), canonical_name, aliases, lat, lng, observation_count. Two
    landmarks are linked if any of their names are alike and they are near each other, whichever cells
    they stand in; what links connect is one place. Its name is that of its most observed landmark; all
    other spellings are aliases, each once. Landmarks without a point stay as they are.
    """
    rows = landmarks.withColumn("names", F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    spelled = each(rows.where("lat is not null and lng is not null"), ["landmark_id", "lat", "lng"], F.col("names"), "spelling")
    # every spelling at a point is a place of its own until it is linked; its landmarks meet others as one, by the least of them
    owned = spelled.select("landmark_id", "lat", "lng", spelled_out(F.col("spelling")).alias("name"))
    owned = owned.withColumn("place", F.xxhash64("name", "lat", "lng"))
    places = owned.groupBy("place", "name", "lat", "lng").agg(F.min("landmark_id").alias("least"), F.max("landmark_id").alias("last"))
    places = staged(places, "spelled_places")
    shared = staged(with_name_vector(places.where("least <> last"), "name"), "shared_places")
    shared = shared.where(name_affinity(F.col("name"), F.col("vector"), F.array("name"), F.map_from_entries("vector")) >= affinity).select("place", "least")
    same = owned.select("place", "landmark_id").join(shared, "place").where("landmark_id <> least").select(F.col("least").alias("a"), F.col("landmark_id").alias("b"))
    pairs = affine_pairs(places.select("place", "name", "lat", "lng"), affinity, metres)
    least = lambda side, name: places.select(F.col("place").alias(side), F.col("least").alias(name))
    links = pairs.join(least("a", "x"), "a").join(least("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = connected(links.unionByName(same))
    rooted = rows.join(roots, rows["landmark_id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "landmark_id"))
    n = F.greatest(F.coalesce("observation_count", F.lit(0)), F.lit(0))
    weight = n + F.lit(1e-9)  # landmarks nobody has seen yet count alike among themselves
    best = F.struct((-n).alias("m"), "landmark_id")
    merged = rooted.groupBy("root").agg(
        F.count("*").alias("merged"), F.sum(n).alias("observation_count"), F.min_by("canonical_name", best).alias("canonical_name"),
        F.round(F.sum(F.col("lat") * weight) / F.sum(F.when(F.col("lat").isNotNull(), weight)), 6).alias("lat"),
        F.round(F.sum(F.col("lng") * weight) / F.sum(F.when(F.col("lng").isNotNull(), weight)), 6).alias("lng"),
    )
    # one place's spellings, each once by its lower case
    spellings = each(rooted, ["root"], F.col("names"), "spelling").groupBy("root", F.lower("spelling").alias("low")).agg(F.min("spelling").alias("spelling"))
    aliases = spellings.groupBy("root").agg(F.array_sort(F.collect_list("spelling")).alias("spellings"))
    return merged.join(aliases, "root").select(
        F.col("root").alias("landmark_id"), "canonical_name",
        F.filter("spellings", lambda s: F.lower(s) != F.lower("canonical_name")).alias("aliases"), "lat", "lng", "observation_count", "merged",
    )


def with_answers(orders: DataFrame, answers: DataFrame) -> DataFrame:
    """Raw text of answered orders with what the customer added, ready to resolve again."""
    return orders.join(answers, "order_id").select(
        "order_id", F.concat_ws(", ", "raw", "locality", "pincode").alias("raw")
    )
