"""Accuracy, reliability and calibration as aggregate queries."""

import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, tables
from waymark.functions.text import comparable, literal_map
from waymark.operators.skew import grouped_order_stats, nearest_rank
from waymark.sources.warehouse import staged

GEO_CORRECT_M = 500.0
ERROR_RANGE_M = 5.0


def resolution_violations(resolutions: DataFrame) -> DataFrame:
    """One row of counts that must all be zero, and the row count."""
    scored = F.exists("landmarks", lambda l: l["match_score"].isNotNull() & l["matched_id"].isNull())
    return resolutions.agg(
        F.count_if((F.col("status") == "NEEDS_INFO") & F.col("clarification").isNull()).alias("unasked"),
        F.count_if((F.col("status") == "AMBIGUOUS") & (F.size("alternatives") < 2)).alias("single_option"),
        F.count_if(F.col("digipin").isNotNull() & F.col("geo").isNull()).alias("cell_without_point"),
        F.count_if(scored).alias("score_without_match"),
        F.count("*").alias("rows"),
    )


# --- fields ----------------------------------------------------------------


def field_rows(graded: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per graded address and field: comparable p(rediction) and t(ruth).

    graded: pred_<field> and true_<field> columns.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                comparable(F.col(f"pred_{f}")).alias("p"),
                comparable(F.col(f"true_{f}")).alias("t"),
            )
            for f in tables.FIELDS
        ]
    )
    return graded.select(*keep, F.explode(pairs).alias("_f")).select(*keep, "_f.*")


def score_fields(graded: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Confusion counts per field (and per ``keep``)."""
    p, t = F.col("p"), F.col("t")
    wrong = p.isNotNull() & t.isNotNull() & (p != t)
    return (
        field_rows(graded, keep)
        .groupBy(*keep, "field")
        .agg(
            F.count_if(p == t).alias("tp"),
            F.count_if((p.isNotNull() & t.isNull()) | wrong).alias("fp"),
            F.count_if((p.isNull() & t.isNotNull()) | wrong).alias("fn"),
            F.count_if(p.isNull() & t.isNull()).alias("tn"),
            F.count_if(wrong).alias("wrong"),
        )
    )


def with_f1(scores: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    total = F.col("precision") + F.col("recall")
    return (
        scores.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", F.when(total > 0, F.col("precision") * F.col("recall") * 2 / total).otherwise(0.0))
        .withColumn("support", tp + fn)
    )


def summary_f1(scores: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Macro and weighted F1 over the measured fields, and how many are not."""
    weight = F.element_at(literal_map(tables.EVALUATION_WEIGHTS), F.col("field"))
    measured = F.col("support") > 0
    return (
        with_f1(scores)
        .groupBy(*keep)
        .agg(
            F.coalesce(F.round(F.avg(F.when(measured, F.col("f1"))), 6), F.lit(0.0)).alias("macro_f1"),
            F.coalesce(
                F.round(F.sum(F.when(measured, F.col("f1") * weight)) / F.sum(F.when(measured, weight)), 6), F.lit(0.0)
            ).alias("weighted_f1"),
            F.count_if(~measured).alias("unmeasured"),
        )
    )


def unmeasured_fields(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("tp") + F.col("fn") == 0).select("field")


def _same(field: str) -> Column:
    return comparable(F.col(f"pred_{field}")).eqNullSafe(comparable(F.col(f"true_{field}")))


def all_fields_right(fields=tables.FIELDS) -> Column:
    right = F.lit(True)
    for f in fields:
        right = right & _same(f)
    return right


def populated_fields_right() -> Column:
    """Every field the truth row fills is right."""
    right = F.lit(True)
    for f in tables.FIELDS:
        right = right & (comparable(F.col(f"true_{f}")).isNull() | _same(f))
    return right


def exact_match_rate(graded: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Share of addresses right in every field the truth ever fills.

    Which fields count is only known once all rows are seen, so rows are first
    counted by the pattern of their right and filled fields: 4^8 at most.
    """
    flags = {f"r_{f}": _same(f) for f in tables.FIELDS} | {
        f"k_{f}": comparable(F.col(f"true_{f}")).isNotNull() for f in tables.FIELDS
    }
    patterns = graded.select(*keep, *[c.alias(n) for n, c in flags.items()]).groupBy(*keep, *flags).agg(
        F.count("*").alias("_n")
    )
    ever = patterns.groupBy(*keep).agg(*[F.bool_or(f"k_{f}").alias(f"e_{f}") for f in tables.FIELDS])
    none = F.lit(True)
    for f in tables.FIELDS:
        none = none & ~F.col(f"e_{f}")
    right = F.lit(True)
    for f in tables.FIELDS:
        right = right & (F.col(f"r_{f}") | (~none & ~F.col(f"e_{f}")))
    if keep:
        joined = patterns.join(ever, list(keep))
    else:
        joined = patterns.select("*", *[ever.select(f"e_{f}").scalar().alias(f"e_{f}") for f in tables.FIELDS])
    return joined.groupBy(*keep).agg(
        F.round(F.sum(F.when(right, F.col("_n")).otherwise(0)) / F.sum("_n"), 6).alias("exact_match")
    )


def geo_error_m() -> Column:
    return geo.haversine_m(F.col("pred_lat"), F.col("pred_lng"), F.col("true_lat"), F.col("true_lng"))


def geocode_error(graded: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Median and nearest-rank p90 error over rows with both points, and coverage."""
    errors = graded.withColumn("_err", geo_error_m())
    n = F.col("n")
    stats = grouped_order_stats(
        errors, list(keep), "_err",
        {"_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2), "_p90": nearest_rank(0.9)}, ERROR_RANGE_M,
    ).select(
        *keep, F.round((F.col("_lo") + F.col("_hi")) / 2, 1).alias("median_m"), F.round("_p90", 1).alias("p90_m")
    )
    coverage = errors.groupBy(*keep).agg(
        F.round(F.count("_err") / F.count("*"), 6).alias("coverage")
    )
    if keep:
        return coverage.join(stats, list(keep), "left")
    return coverage.select("*", *[stats.select(c).scalar().alias(c) for c in ("median_m", "p90_m")])


def status_rates(graded: DataFrame, keep: list[str] = ()) -> DataFrame:
    def share(status, name):
        return F.round(F.avg((F.col("status") == status).cast("double")), 6).alias(name)

    return graded.groupBy(*keep).agg(
        share("RESOLVED", "resolved"), share("NEEDS_INFO", "needs_info"), share("AMBIGUOUS", "ambiguous")
    )


def precision_at_threshold(graded: DataFrame, threshold: float = 0.80, keep: list[str] = ()) -> DataFrame:
    """Share of confident addresses with all eight fields right; 0 when none is confident."""
    above = F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold
    return graded.groupBy(*keep).agg(
        F.coalesce(F.round(F.avg(F.when(above, all_fields_right().cast("double"))), 6), F.lit(0.0)).alias("precision_at"),
        F.count_if(above).alias("above"),
    )


def latency_percentiles(df: DataFrame, timings: str = "timings_ms", range_ms: float = 1.0) -> DataFrame:
    """Median and nearest-rank p95 of each row's summed stage timings."""
    total = F.aggregate(F.map_values(timings), F.lit(0.0), lambda a, x: a + x)
    rows = df.where(F.size(timings) > 0).withColumn("_t", total)
    n = F.col("n")
    stats = grouped_order_stats(
        rows, [], "_t", {"_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2), "_p95": nearest_rank(0.95)}, range_ms
    )
    return stats.select(
        F.round((F.col("_lo") + F.col("_hi")) / 2, 6).alias("p50_ms"), F.round("_p95", 6).alias("p95_ms")
    )


def run_metrics(graded: DataFrame, keep: list[str]) -> DataFrame:
    """The whole metric row per configuration or slice."""
    out = graded.groupBy(*keep).agg(F.count("*").alias("n"))
    for part in (
        summary_f1(with_f1(score_fields(graded, keep)), keep),
        exact_match_rate(graded, keep),
        geocode_error(graded, keep),
        status_rates(graded, keep),
        precision_at_threshold(graded, keep=keep),
    ):
        out = out.join(part, list(keep), "left")
    return out


# --- reliability -----------------------------------------------------------


def is_correct() -> Column:
    """Filled fields right and, where both points are known, within 500 m."""
    return populated_fields_right() & F.coalesce(geo_error_m() <= GEO_CORRECT_M, F.lit(True))


def step_below(score: Column, steps: int) -> Column:
    """Largest i with i/steps <= score, exact for doubles."""
    near = F.round(score * steps).cast("int")
    return F.when(near / F.lit(float(steps)) <= score, near).otherwise(near - 1)


def reliability_bins(scored: DataFrame, score: str = "score", correct: str = "correct", bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) per equal-width bin; the last one is closed."""
    bin_ = F.least(step_below(F.col(score), bins), F.lit(bins - 1))
    return scored.groupBy(bin_.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(score).alias("confidence"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
    )


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error of a bin table."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return bins.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"))


class Pooled:
    """Neighbouring blocks (lo, hi, label, weight) in order of score, pooled until their labels rise."""

    def __init__(self):
        self.blocks: list[tuple[float, float, float, float]] = []

    def add(self, lo: float, hi: float, label: float, weight: float) -> None:
        while self.blocks and self.blocks[-1][2] >= label:
            first, _, other, more = self.blocks.pop()
            lo, label, weight = first, (other * more + label * weight) / (more + weight), more + weight
        self.blocks.append((lo, hi, label, weight))


_BLOCKS = "part int, lo double, hi double, label double, weight double"


def pooled(blocks: DataFrame) -> DataFrame:
    """Blocks of each ``part``, which its rows hold in order of score, pooled; what is kept are blocks, never points."""

    def per_task(batches):
        part, held = None, Pooled()

        def done():
            columns = list(zip(*held.blocks)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array([part] * len(held.blocks), pa.int32()), *(pa.array(c, pa.float64()) for c in columns)], [c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] != part:
                    if held.blocks:
                        yield done()
                    part, held = row[0], Pooled()
                held.add(*row[1:])
        if held.blocks:
            yield done()

    return blocks.mapInArrow(per_task, _BLOCKS)


def fit_isotonic(scored: DataFrame, score: str = "score", correct: str = "correct", fan_in: int = 4):
    """Monotone map from score to the share correct.

    Equal scores are merged first; each distinct score is one weighted point. Points are pooled
    per range of scores, then ``fan_in`` neighbouring ranges at a time, as a tree: pooling what is
    pooled gives what pooling all would. The final fit only sees the last blocks' ends.
    """
    points = scored.where(F.col(score).isNotNull() & F.col(correct).isNotNull()).groupBy(F.col(score).cast("double").alias("lo")).agg(
        F.avg(F.col(correct).cast("double")).alias("label"), F.count("*").cast("double").alias("weight")
    )
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.repartitionByRange(parts, "lo").sortWithinPartitions("lo")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "lo", F.col("lo").alias("hi"), "label", "weight")
    blocks = staged(pooled(dealt), "pooled_ranges")
    while parts > 1:
        parts = -(-parts // fan_in)
        merged = blocks.withColumn("part", F.expr(f"cast(part div {fan_in} as int)"))
        blocks = staged(pooled(merged.repartition(parts, "part").sortWithinPartitions("part", "lo")), "pooled_ranges")
    ends = F.array_distinct(F.array("lo", "hi"))
    knots = blocks.select(F.explode(ends).alias("score"), "label", (F.col("weight") / F.size(ends)).alias("weight"))
    return IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(knots)


def isotonic_knots(model) -> list[tuple[float, float]]:
    return list(zip(map(float, model.boundaries.toArray()), map(float, model.predictions.toArray())))


def cross_validated_ece(scored: DataFrame, position: str, score: str = "score", correct: str = "correct") -> DataFrame:
    """ECE when each half, by position, is scored with the map of the other."""
    half = scored.agg((F.floor(F.count("*") / 2)).alias("h")).scalar()
    ranked = scored.withColumn("_first", F.col(position) < half)
    parts = []
    for first in (True, False):
        model = fit_isotonic(ranked.where(F.col("_first") == first), score, correct)
        other = ranked.where(F.col("_first") != first).withColumnRenamed(score, "score")
        parts.append(model.transform(other).select(F.col("prediction").alias("score"), F.col(correct).alias("correct")))
    return ece(reliability_bins(parts[0].unionByName(parts[1])))


def choose_threshold(
    scored: DataFrame, target: float, score: str = "score", correct: str = "correct", min_support: int = 10
) -> DataFrame:
    """Lowest two-decimal threshold that, with all higher supported ones, meets the target."""
    steps = scored.groupBy(step_below(F.col(score), 100).alias("step")).agg(
        F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("right")
    )
    offered = scored.select(F.round(F.col(score) * 100).cast("int").alias("step")).distinct().withColumn("offered", F.lit(1))
    # a hundred rows at most
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("step"))
    running = (
        steps.join(offered, "step", "full")
        .withColumn("support", F.sum(F.coalesce("n", F.lit(0))).over(down))
        .withColumn("hits", F.sum(F.coalesce("right", F.lit(0))).over(down))
        .where(F.col("offered").isNotNull() & (F.col("support") >= min_support))
        .withColumn("precision", F.col("hits") / F.col("support"))
        .withColumn("failed", F.max((F.col("precision") < target).cast("int")).over(down))
    )
    total = scored.agg(F.count("*").alias("t")).scalar()
    return (
        running.where(F.col("failed") == 0)
        .groupBy()
        .agg(F.min_by(F.struct("step", "precision", "support"), "step").alias("_b"))
        .select(
            F.round(F.col("_b.step") / 100.0, 2).alias("threshold"),
            F.round("_b.precision", 6).alias("precision"),
            F.round(F.coalesce(F.col("_b.support"), F.lit(0)) / total, 6).alias("auto_resolution_rate"),
            F.coalesce(F.col("_b.support"), F.lit(0)).alias("support"),
        )
    )


def calibrated(df: DataFrame, model, score: str = "score") -> DataFrame:
    """Adds calibrated by a fitted model."""
    return model.transform(df.withColumnRenamed(score, "score")).withColumnRenamed("prediction", "calibrated")


def label_status_counts(gold: DataFrame) -> DataFrame:
    """Rows per provenance of their label."""
    return gold.groupBy("label_status").agg(F.count("*").alias("rows"))


def split_overlap(dev: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys that stand in both splits; a sound split has none."""
    return dev.select(key).intersect(test.select(key))
