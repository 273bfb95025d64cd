"""Column expressions over address text."""

import re
import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import tables

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\u2028\u2029"


def alternation(words) -> str:
    """Longest word first, so that no word hides behind its own prefix."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def guarded(words) -> str:
    """Pattern whose group 1 is one of ``words`` standing on its own."""
    return rf"(?<![{WORD}])({alternation(words)})(?![{WORD}])"


def literal_map(mapping: dict) -> Column:
    """A constant map; one parsed expression, not one call per entry."""
    return F.expr("map(" + ", ".join(_literal(x) for x in chain(*mapping.items())) + ")")


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. ASCII text is already normal and never leaves the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def fold(text: Column, normalised: bool = False) -> Column:
    """Canonical punctuation, spacing and case.

    ``normalised`` says the caller already applied :func:`nfkc`.
    """
    c = text if normalised else nfkc(text)
    c = F.regexp_replace(c, r"[,;|/\\\n\r\t]+|[‐-―−]+|--+", " ")
    c = F.regexp_replace(c, rf"[^{WORD}{SPACE}ऀ-ॿ#&.'\-]+", " ")
    c = F.regexp_replace(c, rf"(?<=[{WORD}])[.']+(?=[{SPACE}]|$)", "")
    return F.lower(squeeze(c))


def strip_chatter(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, "(?i)" + tables.CHATTER_PATTERN, " "))


def scripts(text: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(text.rlike("[A-Za-z]"), "latin"),
            F.when(text.rlike(r"[ऀ-ॿ]"), "devanagari"),
            F.when(text.rlike(r"[ঀ-ൿ]"), "other_indic"),
        )
    )


def is_multi_script(found: Column) -> Column:
    return F.size(F.array_remove(found, "other_indic")) > 1


def expand_abbreviations(text: Column) -> Column:
    """Long forms for short ones, in one pass so that no output is read again.

    The text is cut at every abbreviation and put together with the long forms
    in the gaps.
    """
    pattern = "(?i)" + guarded(tables.ABBREVIATIONS)
    pieces = F.split(text, pattern)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    long_form = literal_map(tables.ABBREVIATIONS)
    return F.array_join(
        F.zip_with(
            pieces,
            hits,
            lambda piece, hit: F.concat(
                piece, F.coalesce(F.element_at(long_form, F.lower(hit)), F.lit(""))
            ),
        ),
        "",
    )


def transliterate(text: Column) -> Column:
    """Devanagari to Latin, rule by rule, for finding romanised names.

    The text is cut into the longest known units; what each consonant and nasal
    becomes depends on the unit after it.
    """
    consonants, vowels = tables.DEVA_CONSONANTS, tables.DEVA_VOWELS
    known = [
        *consonants, *vowels, *tables.DEVA_MATRAS, *tables.DEVA_NASALS,
        *tables.DEVA_SILENT, *tables.DEVA_DIGITS,
    ]
    units = F.regexp_extract_all(text, F.lit(f"((?s:{alternation(known)}|.))"), F.lit(1))
    plain = literal_map(
        {**vowels, **tables.DEVA_MATRAS, **tables.DEVA_DIGITS, **dict.fromkeys(tables.DEVA_SILENT, "")}
    )

    def emit(found, unit, i):
        after = F.get(found, i + 1)
        vowel_given = after.isin(*tables.DEVA_MATRAS, tables.DEVA_VIRAMA)
        word_ends = after.isNull() | after.rlike(rf"^[{SPACE}]$")
        labial_next = after.isin(*tables.DEVA_LABIALS)
        return (
            F.when(
                unit.isin(*consonants),
                F.concat(
                    F.element_at(literal_map(consonants), unit),
                    F.when(word_ends | vowel_given, "").otherwise("a"),
                ),
            )
            .when(unit.isin("ं", "ँ") & labial_next, "m")
            .when(unit.isin(*tables.DEVA_NASALS), F.element_at(literal_map(tables.DEVA_NASALS), unit))
            .otherwise(F.coalesce(F.element_at(plain, unit), unit))
        )

    # the units are bound to a variable: named inside, they would be cut out of the text again for each of them
    spelled = F.transform(F.array(units), lambda found: F.array_join(F.transform(found, lambda u, i: emit(found, u, i)), ""))
    return F.get(spelled, F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs, Devanagari marks included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}ऀ-ॿ]+)"), F.lit(1))


def word_tokens(text: Column) -> Column:
    """Runs of word characters: every word-bounded phrase starts with one."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([{WORD}]+)"), F.lit(1))


def name_key(text: Column) -> Column:
    """Lower-case a-z, digits and Devanagari, single spaces: names that embed alike."""
    return F.array_join(
        F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9ऀ-ॿ]+)"), F.lit(1)), " "
    )


def trigrams(text: Column) -> Column:
    """Three-letter windows over each token, with its ends marked."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9ऀ-ॿ]+)"), F.lit(1))
    padded = F.transform(words, lambda w: F.concat(F.lit("\x02"), w, F.lit("\x03")))
    return F.flatten(
        F.transform(
            padded,
            lambda p: F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - 2)),
                lambda i: F.substring(p, i, F.lit(3)),
            ),
        )
    )


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether ``phrase`` stands in ``text`` with no word character touching it."""
    bounded = F.concat(
        F.lit(rf"(?<![{WORD}])\Q"), phrase, F.lit(rf"\E(?![{WORD}])")
    )
    return F.contains(text, phrase) & F.rlike(text, bounded)


def blank_to_null(value: Column) -> Column:
    stripped = F.trim(value)
    return F.when(
        ~F.lower(stripped).isin("", "null", "none", "n/a", "na", "-", "unknown"), stripped
    )


def comparable(value: Column) -> Column:
    """The form in which two field values are compared for equality."""
    low = F.lower(F.trim(value))
    kept = F.when(~low.isin("", "null", "none", "n/a", "na", "-"), low)
    return F.nullif(squeeze(F.regexp_replace(kept, rf"[^\p{{L}}\p{{N}}{SPACE}]", " ")), F.lit(""))


def first_group(text: Column, pattern: str, groups: int = 1) -> Column:
    """First non-empty group of the first match, without spaces, in capitals."""
    found = F.coalesce(
        *[
            F.nullif(F.regexp_extract(text, "(?i)" + pattern, g), F.lit(""))
            for g in range(1, groups + 1)
        ]
    )
    return F.nullif(F.upper(F.regexp_replace(found, r"\s+", "")), F.lit(""))


def stable_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only, not on partitioning."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stable_pick(n: int, *parts: Column) -> Column:
    """An integer in [0, n) that depends on ``parts`` only."""
    return F.floor(stable_uniform(*parts) * F.lit(float(n))).cast("int")
