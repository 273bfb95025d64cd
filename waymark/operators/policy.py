"""Who may contact a customer and who may overwrite an address, as rules over tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Policy names as they are cited.
CONTACT_WINDOW = "contact-allowed-window"
CONTACT_OPERATOR = "contact-human-operator"
CONTACT_OPTED_OUT = "contact-opted-out"
OVERWRITE_CERTAIN = "overwrite-needs-certainty"


def confidence_pct(confidence: Column) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.when(confidence.isNotNull(), F.bround(clamped * 100, 0).cast("int"))


def local_hour(ts: Column) -> Column:
    """Hour of the day in India for a UTC timestamp."""
    return F.hour(ts + F.expr("interval 330 minutes"))


def messages_sent(events: DataFrame) -> DataFrame:
    return events.groupBy("order_id").agg(F.count_if(F.col("event") == "message_sent").cast("int").alias("messages_sent"))


def contact_denial_reason() -> Column:
    """First failing condition, in words."""
    hour = F.col("local_hour")
    return (
        F.when(F.col("opted_out"), "customer has opted out of contact")
        .when(~F.col("pending"), "order is not pending resolution")
        .when(
            hour.isNotNull() & ~hour.between(9, 20),
            F.format_string("outside contact hours (local time %02d:00; allowed 09:00-20:00)", hour),
        )
        .when(F.col("messages_sent") > 0, "a message has already been sent for this order")
        .when(F.col("confidence_pct") >= 80, "confidence is already above the clarification threshold")
        .when(
            ~F.col("channel").eqNullSafe("sms"),
            F.concat(F.lit("channel '"), F.coalesce("channel", F.lit("None")), F.lit("' is not an approved contact channel")),
        )
        .otherwise("no permit policy matched")
    )


def contact_decisions(cases: DataFrame) -> DataFrame:
    """Adds confidence_pct, allowed, matched_policies and reason.

    A forbid beats every permit, and a case with a missing input is denied.
    """
    required = ("principal", "confidence", "messages_sent", "local_hour", "channel", "opted_out", "pending")
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    window = (
        (F.col("principal") == "clarifier")
        & F.col("pending")
        & (F.col("confidence_pct") < 80)
        & (F.col("messages_sent") == 0)
        & F.col("local_hour").between(9, 20)
        & (F.col("channel") == "sms")
    )
    operator = (F.col("principal") == "operator") & F.col("pending")
    ids = F.when(
        F.col("opted_out"), F.array(F.lit(CONTACT_OPTED_OUT))
    ).otherwise(F.array_compact(F.array(F.when(window, CONTACT_WINDOW), F.when(operator, CONTACT_OPERATOR))))
    none = F.array().cast("array<string>")
    allowed = F.col("_complete") & ~F.col("opted_out") & (window | operator)
    names = F.array_join("matched_policies", ", ")
    return (
        cases.withColumn("confidence_pct", confidence_pct(F.col("confidence")))
        .withColumn("_complete", complete)
        .withColumn("matched_policies", F.when(F.col("_complete"), ids).otherwise(none))
        .withColumn("allowed", F.coalesce(allowed, F.lit(False)))
        .withColumn(
            "reason",
            F.when(~F.col("_complete"), "policy evaluation reported errors; failing closed")
            .when(F.col("allowed"), F.concat(F.lit("permitted by "), names))
            .when(F.size("matched_policies") > 0, F.concat(F.lit("forbidden by "), names, F.lit(": "), contact_denial_reason()))
            .otherwise(F.concat(F.lit("no permit matched: "), contact_denial_reason())),
        )
        .drop("_complete")
    )


def overwrite_decisions(cases: DataFrame) -> DataFrame:
    """Adds confidence_pct, allowed and reason for automatic overwrites."""
    pct, source = F.col("confidence_pct"), F.col("geo_source")
    allowed = F.coalesce((pct > 95) & (source == "landmark_graph"), F.lit(False))
    return (
        cases.withColumn("confidence_pct", confidence_pct(F.col("confidence")))
        .withColumn("allowed", allowed)
        .withColumn(
            "reason",
            F.when(F.col("allowed"), f"permitted by {OVERWRITE_CERTAIN}")
            .when(pct.isNull(), "policy evaluation reported errors; failing closed")
            .when(pct <= 95, F.format_string("confidence %d%% is not above 95%%", pct))
            .when(
                ~source.eqNullSafe("landmark_graph"),
                F.concat(F.lit("geo source '"), F.coalesce(source, F.lit("")), F.lit("' is not the landmark graph")),
            )
            .otherwise("no permit matched"),
        )
    )


def route_denials(decisions: DataFrame, action: str = "contactCustomer") -> DataFrame:
    """Queue rows of denied cases: one per order, each reason once in its evidence."""
    listed = F.when(
        F.size("matched_policies") > 0, F.concat(F.lit(" ["), F.array_join("matched_policies", ", "), F.lit("]"))
    ).otherwise("")
    denied = decisions.where(~F.col("allowed")).withColumn(
        "review_reason", F.concat(F.lit(f"policy DENY on {action}: "), F.col("reason"), listed)
    )
    # reasons come from the rule texts above, a few dozen at most
    return denied.groupBy("order_id").agg(
        F.lit("NEEDS_INFO").alias("status"),
        F.max_by("review_reason", F.struct("ts", "case_id")).alias("review_reason"),
        F.array_sort(F.collect_set(F.concat(F.lit("outreach denied by policy: "), F.col("reason")))).alias("evidence"),
    )
