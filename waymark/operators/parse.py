"""Deterministic parsing of normalised address text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import tables
from waymark.functions import text as X

# Phone shapes, split mobile first.
SPLIT_PHONE = r"(?<!\d)(?:\+?91[\s.\-]?)?[6-9]\d{4}[\s.\-]\d{5}(?!\d)"
PHONE = r"(?<!\d)(?:(?:\+?91[\s.\-]?|0)?[6-9]\d{9}|0\d{2,4}[\s.\-]?\d{6,8})(?!\d)"
PINCODE = r"\b([1-9]\d{5})\b"

# Postal words that are no part of a landmark's name.
POSTAL_JARGON = r"post\s+(?:office|ophis|ofis|aphis|afis)|p\.o\.?|po"

_STOPS = [*tables.RELATION_WORDS, *tables.PHRASE_STOPS]
_STOP_WORDS = [w for w in _STOPS if " " not in w]
_STOP_PAIRS = [w for w in _STOPS if w.count(" ") == 1]
MAX_PHRASE_WORDS = 4

PHRASES = "array<struct<name:string,relation:string>>"


def strip_phones(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds phones (to be quarantined) and without_phones."""
    once = F.regexp_replace(F.col(text), SPLIT_PHONE, " ")
    return (
        df.withColumn("_once", once)
        .withColumn(
            "phones",
            F.transform(
                F.concat(
                    F.regexp_extract_all(F.col(text), F.lit(f"({SPLIT_PHONE})"), F.lit(1)),
                    F.regexp_extract_all(F.col("_once"), F.lit(f"({PHONE})"), F.lit(1)),
                ),
                lambda p: F.trim(p),
            ),
        )
        .withColumn("without_phones", X.squeeze(F.regexp_replace("_once", PHONE, " ")))
        .drop("_once")
    )


def pincode_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PINCODE), F.lit(1))


def unit_number(text: Column) -> Column:
    """Number after the first unit label that has one, by label priority."""
    return F.coalesce(*[X.first_group(text, pattern) for _, pattern in tables.UNIT_PATTERNS])


def sub_locality(text: Column) -> Column:
    sector, phase = X.first_group(text, tables.SECTOR_PATTERN), X.first_group(text, tables.PHASE_PATTERN)
    return F.coalesce(F.concat(F.lit("Sector "), sector), F.concat(F.lit("Phase "), phase))


def state_in_text(text: Column) -> Column:
    """Longest state name or alias that stands in the text between spaces."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    by_length = sorted(tables.STATE_ALIASES.items(), key=lambda kv: -len(kv[0]))
    return F.coalesce(*[F.when(padded.contains(f" {alias} "), F.lit(name)) for alias, name in by_length])


def with_unit_fields(df: DataFrame, text: str = "clean_text") -> DataFrame:
    t = F.col(text)
    return df.withColumns(
        {
            "building": unit_number(t),
            "floor": X.first_group(t, tables.FLOOR_PATTERN, 3),
            "block": X.first_group(t, tables.BLOCK_PATTERN, 2),
            "tower": X.first_group(t, tables.TOWER_PATTERN),
            "sub_locality": sub_locality(t),
        }
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{X.SPACE}]+"), lambda w: w != "")


def _phrases_before(text: Column) -> Column:
    """(name, relation) for each relation that follows its landmark."""
    pattern = X.guarded(tables.POSTPOSITIONS)
    pieces, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    run = F.flatten(F.zip_with(pieces, hits, lambda p, h: F.array(p, F.coalesce(h, F.lit("")))))

    def phrase(hit, i):
        words = _words(F.array_join(F.slice(run, 1, i * 2 + 1), ""))
        tail = F.slice(words, F.greatest(F.size(words) - MAX_PHRASE_WORDS, F.lit(1)), MAX_PHRASE_WORDS + 1)
        cut = F.array_max(
            F.transform(
                tail,
                lambda w, j: F.when(
                    F.concat_ws(" ", w, F.get(tail, j + 1)).isin(*_STOP_PAIRS), j + 2
                )
                .when(w.isin(*_STOP_WORDS) | w.rlike(r"^\d{6}$"), j + 1)
                .otherwise(0),
            )
        )
        kept = F.greatest(F.coalesce(cut, F.lit(0)), F.size(tail) - MAX_PHRASE_WORDS)
        name = F.array_join(F.slice(tail, kept + 1, MAX_PHRASE_WORDS), " ")
        return F.struct(
            name.alias("name"),
            F.element_at(X.literal_map(tables.POSTPOSITIONS), F.lower(hit)).alias("relation"),
        )

    return F.transform(hits, phrase)


def _phrases_after(text: Column) -> Column:
    """(name, relation) for each relation that precedes its landmark."""
    masked = F.regexp_replace(text, X.guarded(tables.POSTPOSITIONS), " ")
    stop = rf"(?<![{X.WORD}])(?:{X.alternation(_STOPS)})(?![{X.WORD}])"
    pattern = rf"(?is){X.guarded(tables.RELATION_WORDS)}[{X.SPACE}]+(.*?)(?={stop}|$)"
    relations = F.regexp_extract_all(masked, F.lit(pattern), F.lit(1))
    tails = F.regexp_extract_all(masked, F.lit(pattern), F.lit(2))
    return F.zip_with(
        relations,
        tails,
        lambda r, t: F.struct(
            F.array_join(F.slice(_words(t), 1, MAX_PHRASE_WORDS), " ").alias("name"),
            F.element_at(X.literal_map(tables.RELATION_WORDS), F.lower(r)).alias("relation"),
        ),
    )


def clean_phrase(phrase: Column) -> Column:
    """Without numbers, postal words and punctuation at either end."""
    piece = rf"(?:[\s,.\-]|\d{{3,}}|{POSTAL_JARGON})+"
    return F.regexp_replace(phrase, rf"(?i)^{piece}|{piece}$", "")


def landmark_phrases(text: Column) -> Column:
    """Cleaned (name, relation) candidates; place names are still at their ends."""
    every = F.concat(_phrases_before(text), _phrases_after(text))
    return F.transform(
        every, lambda p: F.struct(clean_phrase(p["name"]).alias("name"), p["relation"].alias("relation"))
    )


def place_suffixes(phrases: Column) -> Column:
    """Word groups at phrase ends that might be place names."""

    def suffixes(p):
        w = F.split(F.lower(p["name"]), " ")
        last, third = F.element_at(w, -1), F.get(w, F.lit(2))
        return (
            F.when(F.size(w) == 3, F.array(last))
            .when(F.size(w) == 4, F.array(F.concat_ws(" ", third, last), last, third))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.array_distinct(F.flatten(F.transform(phrases, suffixes)))


def trim_places(phrase: Column, places: Column) -> Column:
    """Drops place names off a phrase's end while more than two words remain."""
    w = F.split(phrase, " ")
    low = F.split(F.lower(phrase), " ")
    last, third = F.element_at(low, -1), F.get(low, F.lit(2))

    def known(x):
        return F.array_contains(places, x)

    two = F.array_join(F.slice(w, 1, 2), " ")
    three = F.array_join(F.slice(w, 1, 3), " ")
    return (
        F.when((F.size(w) == 3) & known(last), two)
        .when((F.size(w) == 4) & known(F.concat_ws(" ", third, last)), two)
        .when((F.size(w) == 4) & known(last) & known(third), two)
        .when((F.size(w) == 4) & known(last), three)
        .otherwise(phrase)
    )


def final_landmarks(phrases: Column, places: Column) -> Column:
    """Trimmed, non-trivial landmarks, each name once, first mention first."""
    trimmed = F.transform(
        phrases,
        lambda p: F.struct(trim_places(p["name"], places).alias("name"), p["relation"].alias("relation")),
    )
    strong = F.filter(
        trimmed,
        lambda p: (F.length(p["name"]) >= 3)
        & ~F.lower(p["name"]).isin(*tables.WEAK_LANDMARKS)
        & p["name"].rlike(r"(?i)[a-zऀ-ॿ]{3}"),
    )
    names = F.transform(strong, lambda p: F.lower(p["name"]))
    return F.filter(strong, lambda p, i: F.array_position(names, F.lower(p["name"])) == i + 1)


def parse_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Everything that needs no reference table."""
    t = F.col("clean_text")
    return (
        strip_phones(df, text)
        .withColumn("clean_text", X.strip_chatter(F.col("without_phones")))
        .drop("without_phones")
        .transform(with_unit_fields)
        .withColumns(
            {
                "pincode_candidates": pincode_tokens(t),
                "stated_state": state_in_text(t),
                "phrases": landmark_phrases(t),
            }
        )
    )


def structured_building(building: Column, block: Column, tower: Column, floor: Column) -> Column:
    """Unit number followed by block, tower and floor, null when none is known."""
    joined = F.concat_ws(
        ", ",
        building,
        F.concat(F.lit("Block "), block),
        F.concat(F.lit("Tower "), tower),
        F.concat(F.lit("Floor "), floor),
    )
    return F.nullif(joined, F.lit(""))


def can_skip_model(df: DataFrame) -> Column:
    """Known pincode, agreeing locality, no conflict, a unit and no landmarks."""
    return (
        F.col("pincode").isNotNull()
        & F.coalesce(F.col("locality_agrees"), F.lit(False))
        & ~F.col("state_conflict")
        & F.col("building").isNotNull()
        & (F.size("landmarks") == 0)
    )


def valid_request(raw: Column, hint: Column) -> Column:
    """1 to 2,000 characters and, if there is a hint, a point on the globe."""
    in_range = hint["lat"].between(-90, 90) & hint["lng"].between(-180, 180)
    return F.coalesce(F.length(raw).between(1, 2000), F.lit(False)) & (
        hint.isNull() | F.coalesce(in_range, F.lit(False))
    )


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined)."""
    good = valid_request(F.col("raw"), F.col("hint"))
    return df.where(good), df.where(~good)
