"""Order state, its timeline, the review queue, feedback and request metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import tables

QUEUE_STATUSES = ("NEEDS_INFO", "AMBIGUOUS")
FEEDBACK_ACTIONS = ("approve", "edit", "reject")


def upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """A new snapshot: update rows replace target rows of the same key.

    Statistics are aggregates over the snapshot, so a replaced row is never
    counted twice.
    """
    return target.join(updates.select(key).distinct(), key, "left_anti").unionByName(updates)


def ttl_filter(df: DataFrame, now: Column, days: int = 90, written_at: str = "written_at") -> DataFrame:
    """Rows whose expiry, write time plus ``days``, is not before ``now``."""
    return df.where(F.col(written_at) + F.make_dt_interval(F.lit(days)) >= now)


def latest_state(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key, with the first created_at."""
    rest = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"), F.min("created_at").alias("_first")
    ).select(key, *[F.col("_first").alias(c) if c == "created_at" else F.col(f"_s.{c}").alias(c) for c in rest])


def review_queue(orders: DataFrame, status: str | None = None, limit: int = 50, tie: str = "order_id") -> DataFrame:
    """Open cases, oldest first."""
    wanted = (status,) if status in QUEUE_STATUSES else QUEUE_STATUSES
    return (
        orders.where(F.col("status").isin(*wanted) & F.col("created_at").isNotNull())
        .orderBy("created_at", tie)
        .limit(max(1, min(200, limit)))
    )


def order_timeline(events: DataFrame, order_id, limit: int = 100) -> DataFrame:
    return events.where(F.col("order_id") == order_id).orderBy("ts", "event_id").limit(limit)


def summary() -> Column:
    """What an operator sees of an order: resolved fields, never the raw text."""
    return F.concat_ws(", ", "building", "locality", "city", "pincode")


def record_resolutions(resolutions: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """(order rows, timeline events) of one batch of resolutions."""
    orders = resolutions.select(
        "order_id", "status", ts.alias("created_at"), ts.alias("updated_at"), "confidence", summary().alias("summary"), "digipin"
    )
    events = resolutions.select(
        "order_id", ts.alias("ts"), F.lit("resolved").alias("event"), F.col("status").alias("new_status"), "confidence"
    )
    return orders, events


def valid_feedback(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined); the action is compared trimmed and in lower case."""
    clean = feedback.withColumn("action", F.lower(F.trim("action")))
    good = F.coalesce(F.col("order_id").isNotNull() & F.col("action").isin(*FEEDBACK_ACTIONS), F.lit(False))
    return clean.where(good), clean.where(~good)


def apply_feedback(orders: DataFrame, feedback: DataFrame, order: list[str]) -> DataFrame:
    """Orders after their latest operator decision.

    feedback: order_id, action, actor, edits (map of field to value), and the
    columns that order it.
    """
    last = feedback.groupBy("order_id").agg(
        F.max_by(F.struct("action", "actor", "edits"), F.struct(*order)).alias("_f")
    )
    joined = orders.join(last, "order_id", "left")
    decided = F.col("_f").isNotNull()
    edited = {
        f: F.coalesce(F.element_at("_f.edits", f), F.col(f)) for f in tables.FIELDS if f in orders.columns
    }
    return (
        joined.withColumn(
            "status",
            F.when(F.col("_f.action").isin("approve", "edit"), "RESOLVED").when(decided, "REJECTED").otherwise(F.col("status")),
        )
        .withColumns(edited)
        .withColumn("reviewed_by", F.col("_f.actor"))
        .drop("_f")
    )


def feedback_events(feedback: DataFrame) -> DataFrame:
    return feedback.select(
        "order_id", "ts", F.concat(F.lit("operator_"), F.col("action")).alias("event"), "actor",
        F.when(F.col("action").isin("approve", "edit"), "RESOLVED").otherwise("REJECTED").alias("new_status"),
    )


def bulk_close(orders: DataFrame, keep: DataFrame) -> DataFrame:
    """Rejections for every open order that is not on the keep list."""
    return (
        orders.where(F.col("status").isin(*QUEUE_STATUSES))
        .join(keep.select("order_id").distinct(), "order_id", "left_anti")
        .select("order_id", F.lit("reject").alias("action"), F.lit("cleanup").alias("actor"))
    )


def acceptable_question(question: Column, language: Column) -> Column:
    """One question mark at most, 5 to 160 characters, a known language, no digit more than six times."""
    too_many = F.lit(False)
    for digit in "0123456789":
        too_many = too_many | (F.regexp_count(question, F.lit(digit)) > 6)
    return F.coalesce(
        F.length(question).between(5, 160)
        & language.rlike("^(hi-IN|en-IN|hi-Latn)$")
        & (F.regexp_count(question, F.lit(r"\?")) <= 1)
        & ~too_many,
        F.lit(False),
    )


def question_quality(df: DataFrame) -> DataFrame:
    """Adds question, language and source: the generated question or else the template."""
    good = acceptable_question(F.col("generated"), F.col("generated_language"))
    return (
        df.withColumn("_ok", good)
        .withColumn("question", F.when(F.col("_ok"), F.trim("generated")).otherwise(F.col("template")))
        .withColumn("language", F.when(F.col("_ok"), F.col("generated_language")).otherwise(F.col("template_language")))
        .withColumn("source", F.when(F.col("_ok"), "agent").otherwise("template"))
        .drop("_ok")
    )


def cost_per_address(cached: Column, model_used: Column, escalated: Column, retrieval_ran: Column) -> Column:
    model = F.when(model_used, F.when(escalated, tables.COST_STRONG_MODEL).otherwise(tables.COST_CHEAP_MODEL)).otherwise(0.0)
    return F.when(cached, 0.0).otherwise(F.when(retrieval_ran, tables.COST_RETRIEVAL).otherwise(0.0) + model)


def request_metrics(df: DataFrame) -> DataFrame:
    """Adds the ten per-request measures; rates are 0 or 1."""

    def flag(c):
        return F.coalesce(c, F.lit(False)).cast("double")

    status, source = F.col("status"), F.col("geo_source")
    return df.withColumns(
        {
            "resolution_rate": flag(status == "RESOLVED"),
            "clarification_rate": flag(status == "NEEDS_INFO"),
            "ambiguous_rate": flag(status == "AMBIGUOUS"),
            "escalation_rate": flag(F.col("escalated")),
            "cache_hit_rate": flag(F.col("cached")),
            "model_call_rate": flag(F.col("model_used")),
            "geo_from_graph_rate": flag(source == "landmark_graph"),
            "geo_from_centroid_rate": flag(source == "pincode_centroid"),
            "latency_ms": F.round("elapsed_ms", 2),
            "cost_per_address": cost_per_address(F.col("cached"), F.col("model_used"), F.col("escalated"), F.col("retrieval_ran")),
        }
    )
