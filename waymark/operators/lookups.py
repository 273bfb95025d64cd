"""Joins between parsed addresses and the gazetteer."""

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import tables
from waymark.functions import text as X
from waymark.operators import gazetteer as G
from waymark.operators import parse as P
from waymark.operators.skew import each, salted_join
from waymark.sources.warehouse import staged

#: Words in a row, at most, that names meet texts on.
RUN_WORDS = 8


def explode_pincodes(df: DataFrame, key: str, tokens: str = "pincode_candidates") -> DataFrame:
    return each(df, [key], F.col(tokens), "pincode", position="pos")


def resolve_pincode(df: DataFrame, gazetteer: DataFrame, key: str, tokens: str = "pincode_candidates") -> DataFrame:
    """The last token the gazetteer knows, with that pincode's row."""
    facts = explode_pincodes(df, key, tokens)
    known = salted_join(facts, gazetteer, ["pincode"], [key], "inner")
    columns = [F.col(c) for c in gazetteer.columns]
    chosen = known.groupBy(key).agg(F.max_by(F.struct(*columns), "pos").alias("_g")).select(
        key,
        F.col("_g.pincode").alias("pincode"),
        F.col("_g.locality").alias("primary_locality"),
        F.nullif(F.col("_g.district"), F.lit("")).alias("district"),
        F.nullif(F.col("_g.state"), F.lit("")).alias("pincode_state"),
        F.col("_g.lat").alias("centroid_lat"),
        F.col("_g.lng").alias("centroid_lng"),
        F.col("_g.office_count").alias("office_count"),
    )
    return df.join(chosen, key, "left")


def unknown_pincode_tokens(df: DataFrame, gazetteer: DataFrame, key: str, tokens: str = "pincode_candidates") -> DataFrame:
    """Six-digit tokens the gazetteer does not know."""
    facts = explode_pincodes(df, key, tokens)
    known = gazetteer.select("pincode", F.lit(True).alias("_known"))
    return salted_join(facts, known, ["pincode"], [key], "left").where(F.col("_known").isNull()).drop("_known")


def anchors(names: DataFrame, block: list[str], name: str) -> DataFrame:
    """(block, name, word): each name with its rarest word among all names, of equally rare ones the first.

    A text that contains a name as a phrase has every word of the name, so the rarest
    marks the part of a long name that few others share.
    """
    words = each(names.select(*block, name).distinct(), [*block, name], F.array_distinct(X.word_tokens(F.col(name))), "word")
    shared = words.groupBy("word").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct("_n", "word")).alias("_a")
    return words.join(shared, "word").groupBy(*block, name).agg(rarest).select(*block, name, F.col("_a.word").alias("word"))


def phrase_runs(names: DataFrame, block: list[str], name: str) -> DataFrame:
    """(block, name, run, size): the words of each name that a text has in a row if it contains the name.

    All of a name's words up to ``RUN_WORDS``; of a longer name as many in a row, its anchor among them.
    """
    held = anchors(names, block, name).withColumn("_words", X.word_tokens(F.col(name)))
    size = F.size("_words")
    start = F.greatest(F.lit(1), F.least(F.array_position("_words", F.col("word")).cast("int"), size - RUN_WORDS + 1))
    run = F.array_join(F.slice("_words", start, F.least(size, F.lit(RUN_WORDS))), " ")
    return held.select(*block, name, run.alias("run"), F.least(size, F.lit(RUN_WORDS)).alias("size"))


def contained(texts: DataFrame, names: DataFrame, key: str, text: str, block: list[str], name: str) -> DataFrame:
    """(key, name) of all names that stand in a text as phrases, among those of the text's block.

    The text's runs of words meet the names' without the text; it is joined back once, to the names that remain possible.
    """
    wanted = staged(phrase_runs(names, block, name), "phrase_runs")
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]  # RUN_WORDS at most
    words = texts.select(key, *block, X.word_tokens(F.col(text)).alias("_words"))

    def runs(size):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_words") - size + 1, F.lit(1))), lambda i: i <= F.size("_words") - size + 1)
        return F.transform(starts, lambda i: F.array_join(F.slice("_words", i, size), " "))

    every = F.flatten(F.array(*map(runs, sorted(sizes)))) if sizes else F.array().cast("array<string>")
    found = each(words, [key, *block], F.array_distinct(every), "run")
    met = salted_join(found, wanted.drop("size"), [*block, "run"], [key, "run"], "inner").select(key, name)
    return texts.select(key, text).join(met, key).where(X.contains_phrase(F.lower(text), F.col(name))).select(key, name)


def locality_agreement(df: DataFrame, localities: DataFrame, key: str, text: str = "clean_text") -> DataFrame:
    """Adds locality_agrees (true, false, null) and matched_locality: the longest name of the pincode that stands in the text."""
    names = localities.select("pincode", F.lower("locality").alias("name")).where(F.length("name") >= 4)
    found = (
        contained(df.where(F.col("pincode").isNotNull()), names, key, text, ["pincode"], "name")
        .groupBy(key)
        .agg(F.max(F.struct(F.length("name").alias("n"), F.col("name"))).alias("_m"))
        .select(key, F.col("_m.name").alias("matched_locality"))
    )
    has_names = localities.select("pincode").distinct().withColumn("_has_names", F.lit(True))
    agrees = F.when(F.col("matched_locality").isNotNull(), True).when(F.col("_has_names"), False)
    return (
        salted_join(df.join(found, key, "left"), has_names, ["pincode"], [key], "left")
        .withColumn("locality_agrees", agrees)
        .drop("_has_names")
    )


def state_conflict(df: DataFrame) -> DataFrame:
    """Adds state_conflict: the text's state is not the pincode's."""
    differs = F.lower("pincode_state") != F.lower("stated_state")
    return df.withColumn("state_conflict", F.coalesce(differs, F.lit(False)))


def find_city_exact(df: DataFrame, cities: DataFrame, key: str, text: str = "clean_text") -> DataFrame:
    """Rows (key, city): the longest district name that stands in the text."""
    wanted = cities.where((F.length("city_key") >= 4) & ~F.col("city_key").isin(*tables.COMPASS_DISTRICTS))
    return (
        contained(df, wanted, key, text, [], "city_key")
        .join(wanted.select("city_key", "city"), "city_key")
        .groupBy(key)
        .agg(F.max_by("city", F.struct(F.length("city_key"), F.col("city_key"))).alias("city"))
    )


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _allowed_edits(name_length: Column, cutoff: float) -> Column:
    """Edits a name can have when the other word is at most two letters longer."""
    return F.floor((name_length * 2 + 2) * F.lit(1.0 - cutoff) + F.lit(1e-9)).cast("int")


def _part_start(i: Column, length: Column, edits: Column) -> Column:
    return F.floor(i * length / (edits + 1)).cast("int")


def _name_parts(name: Column, cutoff: float) -> Column:
    """The name cut into one part more than it may have edits."""
    n = F.length(name)
    e = _allowed_edits(n, cutoff)
    return F.transform(
        F.sequence(F.lit(0), e),
        lambda i: F.struct(
            n.alias("length"),
            i.alias("piece"),
            F.substring(
                name, _part_start(i, n, e) + 1, _part_start(i + 1, n, e) - _part_start(i, n, e)
            ).alias("part"),
        ),
    )


def _word_parts(word: Column, cutoff: float) -> Column:
    """Every part the word shares with a name it is close to, by name length."""
    m = F.length(word)

    def per_length(n):
        e = _allowed_edits(n, cutoff)

        def per_piece(i):
            size = _part_start(i + 1, n, e) - _part_start(i, n, e)
            low = F.greatest(F.lit(0), _part_start(i, n, e) - e)
            high = F.least(m - size, _part_start(i, n, e) + e)
            starts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(
                starts,
                lambda s: F.struct(n.alias("length"), i.alias("piece"), F.substring(word, s + 1, size).alias("part")),
            )

        return F.flatten(F.transform(F.sequence(F.lit(0), e), per_piece))

    return F.array_distinct(F.flatten(F.transform(F.sequence(m - 2, m + 2), per_length)))


def find_city_fuzzy(
    df: DataFrame, cities: DataFrame, key: str, text: str = "clean_text", cutoff: float = 0.90
) -> DataFrame:
    """Rows (key, city): the last word that nearly spells a district.

    Each distinct word is compared once. A ratio of ``cutoff`` leaves room for
    few edits; a name cut into one part more than that keeps a part unedited
    and nearly in place. So an equality join on parts finds every possible
    pair, and the exact ratio runs on those only.
    """
    parts = each(
        cities, ["city", "city_key"], _name_parts(F.col("city_key"), cutoff), "length", "piece", "part"
    )
    spelled = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{5,})"), F.lit(1))
    mentions = each(df, [key], spelled, "word", position="pos").where(
        ~F.col("word").isin(*tables.NOT_A_CITY)
    )
    words = mentions.select("word").distinct()
    best = (
        each(words, ["word"], _word_parts(F.col("word"), cutoff), "length", "piece", "part")
        .join(parts, ["length", "piece", "part"])
        .select("word", "city", "city_key")
        .distinct()
        .where(F.levenshtein("word", "city_key") <= _allowed_edits(F.length("city_key"), cutoff))
        .withColumn("score", sequence_ratio("word", "city_key"))
        .groupBy("word")
        .agg(F.max(F.struct("score", "city_key", "city")).alias("_b"))
        .where((F.col("_b.score") >= cutoff) & ~F.col("_b.city_key").isin(*tables.NOT_A_CITY))
        .select("word", F.col("_b.city").alias("city"))
    )
    return (
        salted_join(mentions, best, ["word"], [key, "pos"], "inner")
        .groupBy(key)
        .agg(F.max_by("city", "pos").alias("city"))
    )


def with_landmarks(df: DataFrame, localities: DataFrame, key: str) -> DataFrame:
    """Final landmarks: phrases without the names of the address's own places."""
    suffixes = each(
        df.where(F.col("pincode").isNotNull()), [key, "pincode"], P.place_suffixes(F.col("phrases")), "name"
    )
    names = localities.select("pincode", F.lower("locality").alias("name")).distinct().withColumn("_hit", F.lit(True))
    # a handful per address: three suffixes per phrase at most
    known = (
        salted_join(suffixes, names, ["pincode", "name"], [key, "name"], "inner")
        .groupBy(key)
        .agg(F.collect_set("name").alias("_places"))
    )
    own = F.array_compact(
        F.array(F.lit("delhi"), *[F.lower(c) for c in ("city", "district", "state", "locality")])
    )
    places = F.array_union(own, F.coalesce("_places", F.array().cast("array<string>")))
    return (
        df.join(known, key, "left")
        .withColumn("landmarks", P.final_landmarks(F.col("phrases"), places))
        .drop("_places", "phrases")
    )


def parse_addresses(
    df: DataFrame, gazetteer: DataFrame, localities: DataFrame, key: str = "order_id", text: str = "text"
) -> DataFrame:
    """The whole deterministic parse, one row per input row.

    Three stages are written on the way: the parsed text, the rows with their
    pincode, and the placed rows, each of which several steps read.
    """
    cities = G.known_cities(gazetteer)
    parsed = staged(P.parse_text(df, text), "parsed_text")
    pinned = staged(resolve_pincode(parsed, gazetteer, key), "pinned")
    placed = locality_agreement(pinned, localities, key)
    placed = state_conflict(placed).withColumn("state", F.coalesce("pincode_state", "stated_state"))
    placed = staged(placed, "placed")
    # a misspelt city is only looked for where neither pincode nor exact name gives one
    by_pin = F.col("district").isNotNull() & F.col("state").isNotNull()
    open_rows = placed.where(~by_pin).select(key, "clean_text")
    exact = find_city_exact(open_rows, cities, key)
    fuzzy = find_city_fuzzy(open_rows.join(exact, key, "left_anti"), cities, key)
    in_text = exact.unionByName(fuzzy).withColumnRenamed("city", "_text_city")
    implied = G.city_for_district(F.col("district"), F.col("state"))
    placed = (
        placed.join(in_text, key, "left")
        .withColumn("city", F.when(by_pin, implied).otherwise(F.col("_text_city")))
        .withColumn("locality", F.when(F.col("matched_locality").isNotNull(), G.titlecase_name("matched_locality")))
        .drop("_text_city")
    )
    return with_landmarks(placed, localities, key)
