"""Labelled, reproducibly messy addresses from clean ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import tables
from waymark.functions import text as X


def hindi_word_order(text: Column) -> Column:
    """Relation words moved behind their landmark, in Hindi."""
    for english, hindi in tables.HINDI_ORDER:
        text = F.regexp_replace(text, rf"(?i)\b{english}\s+([^,]+?)\s*(?=,|$)", f"$1 {hindi}")
    return text


def to_devanagari(text: Column) -> Column:
    """Rough Latin to Devanagari: known words whole, others letter by letter."""
    letters = dict(tables.LATIN_TO_DEVA)
    known, by_letter = X.literal_map(tables.KNOWN_DEVA), X.literal_map(letters)
    pattern = f"({X.alternation(letters)}|(?s:.))"

    def word(w):
        core = F.lower(F.btrim(w, F.lit(".,-")))
        spelled = F.array_join(
            F.transform(
                F.regexp_extract_all(core, F.lit(pattern), F.lit(1)),
                lambda u: F.coalesce(F.element_at(by_letter, u), u),
            ),
            "",
        )
        return F.coalesce(F.element_at(known, core), spelled)

    words = F.filter(F.split(hindi_word_order(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, word), " ")


def misspell(word: Column, *seed: Column) -> Column:
    """One typing error inside a word of four letters or more."""
    n = F.length(word)
    u = X.stable_uniform(F.lit("at"), *seed)
    i = (F.floor(u * (n - 2)) + 1).cast("int")
    kind = X.stable_pick(4, F.lit("kind"), *seed)
    side = X.stable_uniform(F.lit("side"), *seed)

    def part(start, length):
        return F.substring(word, start, length)

    before, letter, after = part(F.lit(1), i), part(i + 1, F.lit(1)), part(i + 2, n)
    keys = F.element_at(X.literal_map(tables.KEYBOARD_NEIGHBOURS), F.lower(letter))
    near = F.substring(keys, (F.floor(side * F.length(keys)) + 1).cast("int"), F.lit(1))
    wrong = (
        F.when((kind == 0) & keys.isNotNull(), F.concat(before, near, after))
        .when(kind == 1, F.concat(before, letter, letter, after))
        .when(kind == 2, F.concat(before, after))
        .otherwise(F.concat(before, part(i + 2, F.lit(1)), letter, part(i + 3, n)))
    )
    return F.when(n < 4, word).otherwise(wrong)


def contractions() -> list[tuple[str, list[str]]]:
    """Long form to its short forms, without entries that change nothing."""
    table: dict[str, list[str]] = {}
    for short, long_form in tables.ABBREVIATIONS.items():
        if short != long_form:
            table.setdefault(long_form, []).append(short)
    return [(k, v) for k, v in table.items() if len(k) >= 4]


def contract_abbreviations(text: Column, *seed: Column) -> Column:
    """Some long forms, where they first stand, replaced by one of their short forms."""
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("long"), F.array(*[F.lit(s) for s in v]).alias("shorts"))
            for k, v in contractions()
        ]
    )

    def shorten(acc, row):
        pattern = F.concat(
            F.lit(rf"(?is)^(.*?)(?<![{X.WORD}])\Q"), row["long"], F.lit(rf"\E(?![{X.WORD}])")
        )
        pick = F.floor(X.stable_uniform(F.lit("short"), row["long"], *seed) * F.size(row["shorts"])).cast("int")
        chosen = X.stable_uniform(F.lit("use"), row["long"], *seed) < 0.6
        found = F.contains(F.lower(acc), row["long"])
        return F.when(
            found & chosen, F.regexp_replace(acc, pattern, F.concat(F.lit("$1"), F.get(row["shorts"], pick)))
        ).otherwise(acc)

    return F.aggregate(rows, text, shorten)


def fake_phone(*seed: Column) -> Column:
    """A well-formed number nobody has, in one of four styles."""
    tail = F.lpad(X.stable_pick(100000, F.lit("tail"), *seed).cast("string"), 5, "0")
    style = X.stable_pick(4, F.lit("style"), *seed)
    return (
        F.when(style == 0, F.concat(F.lit("99999"), tail))
        .when(style == 1, F.concat(F.lit("+91 99999 "), tail))
        .when(style == 2, F.concat(F.lit("99999-"), tail))
        .otherwise(F.concat(F.lit("099999"), tail))
    )


def unit_number(*seed: Column) -> Column:
    """Struct (fragment, value) of an invented unit number."""
    value = F.concat(
        (X.stable_pick(299, F.lit("num"), *seed) + 1).cast("string"),
        F.get(F.array(*[F.lit(s) for s in ("", "", "", "A", "B", "C", "D")]), X.stable_pick(7, F.lit("suffix"), *seed)),
    )
    lead = F.get(
        F.array(*[F.lit(s) for s in ("H.No ", "Flat ", "h no ", "", "Plot No ", "House Number ")]),
        X.stable_pick(6, F.lit("unit"), *seed),
    )
    return F.struct(F.concat(lead, value).alias("fragment"), value.alias("value"))


# Chance of each perturbation.
RATES = {
    "add_unit": 0.55, "drop_pincode": 0.30, "drop_city": 0.20, "misspell": 0.35, "abbreviate": 0.40,
    "reorder": 0.25, "inject_phone": 0.30, "append_chatter": 0.25, "transliterate": 0.15,
    "merge_lines": 0.30, "case_noise": 0.20, "extra_whitespace": 0.25,
}


def perturb(seeds: DataFrame, per_seed: int) -> DataFrame:
    """``per_seed`` variants of each seed; variant 0 stays clean.

    seeds: seed_id, raw, city, pincode. Every choice hashes (seed, variant,
    step), so the corpus is the same under any partitioning. Adds address_id,
    variant, building, perturbations and phones_expected; raw is rewritten.
    """
    key = (F.col("seed_id"), F.col("variant"))
    dirty = F.col("variant") > 0

    def roll(step):
        return dirty & (X.stable_uniform(F.lit(step), *key) < RATES[step])

    def step(df, name, hit, **changes):
        """Apply ``changes`` where the step happens, and note that it did."""
        df = df.withColumn("_hit", hit)
        df = df.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()})
        return df.withColumn(
            "perturbations",
            F.when(F.col("_hit"), F.concat("perturbations", F.array(F.lit(name)))).otherwise(F.col("perturbations")),
        )

    text_parts = F.filter(F.transform(F.split("raw", ","), lambda p: F.trim(p)), lambda p: p != "")
    df = seeds.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(per_seed - 1)))).withColumns(
        {
            "parts": text_parts,
            "building": F.lit(None).cast("string"),
            "perturbations": F.array().cast("array<string>"),
            "phones_expected": F.array().cast("array<string>"),
        }
    )
    df = df.withColumn("_unit", unit_number(*key))
    df = step(
        df, "add_unit", roll("add_unit"),
        parts=F.concat(F.array("_unit.fragment"), "parts"), building=F.col("_unit.value"),
    )
    pin = F.concat(F.lit(r"\b"), F.col("pincode"), F.lit(r"\b"))
    cleared = F.transform("parts", lambda p: F.btrim(F.regexp_replace(p, pin, F.lit("")), F.lit(" -,")))
    df = step(
        df, "drop_pincode", roll("drop_pincode") & F.col("pincode").isNotNull(),
        parts=F.filter(cleared, lambda p: p != ""),
    )
    df = step(
        df, "drop_city", roll("drop_city") & F.col("city").isNotNull(),
        parts=F.filter("parts", lambda p: F.lower(p) != F.lower("city")),
    )
    short = F.filter(
        F.transform("parts", lambda p, i: F.when((F.size(F.split(p, r"\s+")) <= 4) & (F.length(p) > 5), i)),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("_short", short).withColumn(
        "_at", F.get("_short", F.floor(X.stable_uniform(F.lit("part"), *key) * F.size("_short")).cast("int"))
    )
    df = df.withColumn("_words", F.split(F.get("parts", F.col("_at")), r"\s+")).withColumn(
        "_w", F.floor(X.stable_uniform(F.lit("word"), *key) * F.size("_words")).cast("int")
    )
    wrong = F.array_join(
        F.transform("_words", lambda w, i: F.when(i == F.col("_w"), misspell(w, *key)).otherwise(w)), " "
    )
    df = step(
        df, "misspell", roll("misspell") & (F.size("_short") > 0),
        parts=F.transform("parts", lambda p, i: F.when(i == F.col("_at"), wrong).otherwise(p)),
    )
    df = df.withColumn("_joined", F.array_join("parts", ", ")).withColumn(
        "_brief", contract_abbreviations(F.col("_joined"), *key)
    )
    df = step(
        df, "abbreviate", roll("abbreviate") & (F.col("_brief") != F.col("_joined")),
        parts=F.filter(F.transform(F.split("_brief", ","), lambda p: F.trim(p)), lambda p: p != ""),
    )
    tail = F.transform(
        F.array_sort(
            F.transform(
                F.slice("parts", F.lit(2), F.size("parts")), lambda p: F.struct(F.md5(F.concat_ws("|", p, *[k.cast("string") for k in key])).alias("h"), p.alias("p"))
            )
        ),
        lambda s: s["p"],
    )
    df = step(
        df, "reorder", roll("reorder") & (F.size("parts") > 2),
        parts=F.concat(F.slice("parts", 1, 1), tail),
    )
    df = df.withColumn("_phone", fake_phone(*key))
    df = step(
        df, "inject_phone", roll("inject_phone"),
        parts=F.concat("parts", F.array("_phone")), phones_expected=F.array("_phone"),
    )
    phrase = F.get(
        F.array(*[F.lit(c) for c in tables.CHATTER_PHRASES]), X.stable_pick(len(tables.CHATTER_PHRASES), F.lit("phrase"), *key)
    )
    df = step(df, "append_chatter", roll("append_chatter"), parts=F.concat("parts", F.array(phrase)))
    df = df.withColumn("text", F.when(dirty, F.array_join("parts", ", ")).otherwise(F.col("raw")))
    df = step(df, "transliterate", roll("transliterate"), text=to_devanagari(F.col("text")))
    df = step(df, "merge_lines", roll("merge_lines"), text=F.replace("text", F.lit(","), F.lit(" ")))
    upper = X.stable_uniform(F.lit("upper"), *key) < 0.5
    df = step(
        df, "case_noise", roll("case_noise"), text=F.when(upper, F.upper("text")).otherwise(F.lower("text"))
    )
    gaps = F.array_join(
        F.transform(
            F.split("text", r"\s"),
            lambda w, i: F.concat(w, F.repeat(F.lit(" "), X.stable_pick(3, F.lit("gap"), i, *key) + 1)),
        ),
        "",
    )
    comma = F.get(F.array(*[F.lit(c) for c in (",", " ,", ",,", " -")]), X.stable_pick(4, F.lit("comma"), *key))
    df = step(
        df, "extra_whitespace", roll("extra_whitespace"), text=F.replace(gaps, F.lit(","), comma)
    )
    return df.select(
        F.concat("seed_id", F.lit("#v"), F.col("variant").cast("string")).alias("address_id"),
        *[c for c in seeds.columns if c != "raw"], "variant", F.trim("text").alias("raw"), "building",
        "perturbations", "phones_expected",
    )


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """Rows per perturbation, clean rows included as such."""
    marks = F.when(F.size("perturbations") == 0, F.array(F.lit("clean"))).otherwise(F.col("perturbations"))
    return corpus.select(F.explode(marks).alias("perturbation")).groupBy("perturbation").agg(F.count("*").alias("rows"))


def band(perturbations: Column) -> Column:
    n = F.size(perturbations)
    return F.when(n == 0, "clean").when(n <= 2, "light").otherwise("heavy")


def gold_split(corpus: DataFrame, n: int = 300, max_per_seed: int = 3, seed: str = "20260917") -> DataFrame:
    """At most ``n`` rows, split alternately into dev and test.

    Each stratum (city, messiness) gets its share, no seed more than
    ``max_per_seed`` rows, and a shortfall is filled from the remaining rows.
    """
    from pyspark.sql import Window

    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("address_id")))
    rows = corpus.withColumn("_draw", draw).withColumn("_band", band(F.col("perturbations"))).withColumn(
        "_city", F.coalesce("city", F.lit("?"))
    )
    per_seed = Window.partitionBy("seed_id").orderBy("_draw")
    eligible = rows.withColumn("_s", F.row_number().over(per_seed)).where(F.col("_s") <= max_per_seed)
    total = rows.agg(F.count("*").alias("t")).scalar()
    quota = rows.groupBy("_city", "_band").agg(
        F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.count("*") / total, 0)).cast("int").alias("_quota")
    )
    stratum = Window.partitionBy("_city", "_band").orderBy("_draw")
    # no stratum's quota exceeds n, so n rows of each are enough to rank
    ranked = (
        eligible.withColumn("_r", F.row_number().over(stratum))
        .where(F.col("_r") <= n)
        .join(quota, ["_city", "_band"])
    )
    picked = ranked.withColumn("_late", F.when(F.col("_r") <= F.col("_quota"), 0).otherwise(1))
    chosen = picked.orderBy("_late", "_draw", "address_id").limit(n)
    # n rows: small enough to number in one task
    order = Window.partitionBy(F.lit(0)).orderBy("_deal", "address_id")
    return (
        chosen.withColumn("_deal", F.md5(F.concat_ws("|", F.lit("deal"), F.lit(seed), F.col("address_id"))))
        .withColumn("_n", F.row_number().over(order))
        .withColumn("split", F.when(F.col("_n") % 2 == 1, "dev").otherwise("test"))
        .withColumn("label_status", F.lit("derived"))
        .select(*corpus.columns, "split", "label_status")
    )


def corpus_quality(corpus: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row of violation counts over seeds and corpus; all but the last two must be zero."""
    bad_seed = seeds.agg(
        F.count_if(~F.coalesce(F.col("pincode").rlike(r"^[1-8]\d{5}$"), F.lit(False))).alias("bad_pincode"),
        F.count_if(F.col("locality").isNull() | F.col("state").isNull()).alias("missing_truth"),
        F.count_if(F.col("cell").isNull()).alias("no_cell"),
        F.count_if(~F.contains("raw", F.col("pincode"))).alias("pincode_not_in_text"),
    )
    clean = F.col("variant") == 0
    shaped = F.exists("phones_expected", lambda p: ~F.regexp_replace(p, r"\D", "").rlike(r"^(0|91)?99999\d{5}$"))
    rows = corpus.agg(
        F.count_if(clean & (F.size("perturbations") > 0)).alias("dirty_variant_zero"),
        F.count_if(F.array_contains("perturbations", "add_unit") != F.col("building").isNotNull()).alias("unit_without_truth"),
        F.count_if(F.array_contains("perturbations", "inject_phone") != (F.size("phones_expected") > 0)).alias("phone_without_record"),
        F.count_if(shaped).alias("phone_shape"),
        F.count_if(F.length("raw") == 0).alias("empty_text"),
        F.count("*").alias("rows"),
        F.count_if(F.size("perturbations") > 2).alias("heavy_rows"),
    )
    return rows.select("*", *[bad_seed.select(c).scalar().alias(c) for c in bad_seed.columns])
