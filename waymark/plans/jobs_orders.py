"""Jobs over order state, policy, feedback and cost."""

from pyspark.sql import functions as F

from waymark.operators import orders as O
from waymark.operators import policy as P
from waymark.plans.registry import job
from waymark.sources.fixtures import table, view
from waymark.sources.warehouse import Warehouse


def both(select: str, **tables):
    """One SELECT for both engines: DuckDB text, and a Spark runner over named tables."""
    marked = select
    for name in tables:
        marked = marked.replace(f"from {name}", f"from {{{name}}}")

    def run(spark, sf):
        return spark.sql(marked, **{n: load(spark, sf) for n, load in tables.items()})

    return select.replace(" as string)", " as varchar)"), run


def driver(name):
    return lambda spark, sf: table(spark, sf, name)


def derived(name):
    return lambda spark, sf: view(spark, sf, name)


CASES, cases = both(
    """select o_orderkey as case_id, o_custkey as order_id, o_orderdate as ts,
      case when o_orderkey % 211 = 0 then null when o_orderkey % 9 = 0 then 'operator' when o_orderkey % 17 = 0 then 'resolver' else 'clarifier' end as principal,
      case when o_orderkey % 13 = 0 then 0.8E0 when o_orderkey % 311 = 0 then null else (o_totalprice % 100)/100.0E0 end as confidence,
      cast(case when o_custkey % 11 = 0 then 1 else 0 end as int) as messages_sent, cast(o_orderkey % 24 as int) as local_hour,
      case when o_orderkey % 19 = 0 then 'voice' else 'sms' end as channel, o_custkey % 23 = 0 as opted_out, o_orderstatus <> 'F' as pending,
      case when o_orderkey % 3 = 0 then 'landmark_graph' when o_orderkey % 3 = 1 then 'geocoder' else 'pincode_centroid' end as geo_source from orders""",
    orders=driver("orders"),
)

DECIDED = f"""cases as ({CASES}),
pct as (select *, case when confidence is not null then cast(round_even(least(1.0E0, greatest(0.0E0, confidence))*100, 0) as integer) end as pct from cases),
ruled as (select *, principal is null or confidence is null as broken,
  coalesce(principal = 'clarifier' and pending and pct < 80 and messages_sent = 0 and local_hour between 9 and 20 and channel = 'sms', false) as win,
  coalesce(principal = 'operator' and pending, false) as op from pct),
why as (select *, case when opted_out then 'customer has opted out of contact' when not pending then 'order is not pending resolution'
  when not (local_hour between 9 and 20) then 'outside contact hours (local time ' || lpad(cast(local_hour as varchar),2,'0') || ':00; allowed 09:00-20:00)'
  when messages_sent > 0 then 'a message has already been sent for this order' when pct >= 80 then 'confidence is already above the clarification threshold'
  when channel <> 'sms' then 'channel ''' || channel || ''' is not an approved contact channel' else 'no permit policy matched' end as sentence,
  not broken and not opted_out and (win or op) as allowed,
  case when broken then '' when opted_out then 'contact-opted-out' when win then 'contact-allowed-window' when op then 'contact-human-operator' else '' end as policies from ruled),
decided as (select *, case when broken then 'policy evaluation reported errors; failing closed' when allowed then 'permitted by ' || policies
  when policies <> '' then 'forbidden by ' || policies || ': ' || sentence else 'no permit matched: ' || sentence end as reason from why)"""


@job("contact_decisions", "AU1 AU2 AU4", f"with {DECIDED} select case_id, allowed, policies, reason, pct as confidence_pct from decided")
def contact_decisions(spark, sf):
    return P.contact_decisions(cases(spark, sf)).select(
        "case_id", "allowed", F.array_join("matched_policies", ", ").alias("policies"), "reason", "confidence_pct"
    )


@job(
    "overwrite_decisions", "AU3 AU4",
    f"""with {DECIDED} select case_id, coalesce(pct > 95 and geo_source = 'landmark_graph', false) as allowed,
      case when pct > 95 and geo_source = 'landmark_graph' then 'permitted by overwrite-needs-certainty' when pct is null then 'policy evaluation reported errors; failing closed'
        when pct <= 95 then 'confidence ' || pct || '% is not above 95%' else 'geo source ''' || geo_source || ''' is not the landmark graph' end as reason from decided""",
)
def overwrite_decisions(spark, sf):
    return P.overwrite_decisions(cases(spark, sf)).select("case_id", "allowed", "reason")


@job(
    "route_denials", "AU6",
    f"""with {DECIDED}, d as (select *, 'policy DENY on contactCustomer: ' || reason || case when policies <> '' then ' [' || policies || ']' else '' end as rr from decided where not allowed)
    select order_id, 'NEEDS_INFO' as status, arg_max(rr, {{'ts': ts, 'id': case_id}}) as review_reason,
      (select string_agg('outreach denied by policy: ' || r, ' | ' order by 'outreach denied by policy: ' || r) from (select unnest(list_distinct(list(d.reason))) as r)) as evidence
    from d group by order_id""",
)
def route_denials(spark, sf):
    denied = P.route_denials(P.contact_decisions(cases(spark, sf)))
    return denied.withColumn("evidence", F.array_join("evidence", " | "))


EVENTS, order_events = both(
    """select event_id, user_id as order_id, ts, case event_type when 'error' then 'message_sent' when 'purchase' then 'operator_edit' else 'resolved' end as event from events""",
    events=driver("events"),
)


@job("messages_sent", "AU5", f"with e as ({EVENTS}) select order_id, cast(count(*) filter (where event = 'message_sent') as integer) as messages_sent from e group by 1")
def messages_sent(spark, sf):
    return P.messages_sent(order_events(spark, sf))


@job("local_hour", "AU7", "select event_id, cast(hour(ts + interval 330 minutes) as integer) as local_hour from events")
def local_hour(spark, sf):
    return table(spark, sf, "events").select("event_id", P.local_hour(F.col("ts")).alias("local_hour"))


STATES, states = both(
    """select o_custkey as order_id, o_orderkey as version, o_orderdate as updated_at, o_orderdate as created_at,
      case o_orderstatus when 'O' then 'NEEDS_INFO' when 'P' then 'AMBIGUOUS' else 'RESOLVED' end as status, (o_totalprice % 100)/100.0E0 as confidence,
      concat('b', cast(o_orderkey % 90 as string)) as building, 'Ramesh Nagar' as locality, cast(110000 + o_custkey % 160 as string) as pincode from orders""",
    orders=driver("orders"),
)
LATEST = f"""states as ({STATES}),
latest as (select order_id, s.version as version, s.updated_at as updated_at, first as created_at, s.status as status, s.confidence as confidence, s.building as building, s.locality as locality, s.pincode as pincode
  from (select order_id, arg_max(states, {{'u': updated_at, 'v': version}}) as s, min(created_at) as first from states group by 1))"""


def latest(spark, sf):
    return O.latest_state(states(spark, sf), "order_id", ["updated_at", "version"])


@job("latest_state", "RT20", f"with {LATEST} select * from latest")
def latest_state(spark, sf):
    return latest(spark, sf)


@job("review_queue", "RT18", f"with {LATEST} select order_id, status, created_at from latest where status in ('NEEDS_INFO','AMBIGUOUS') order by created_at, order_id limit 50")
def review_queue(spark, sf):
    return O.review_queue(latest(spark, sf)).select("order_id", "status", "created_at")


@job("order_timeline", "RT19", f"with e as ({EVENTS}) select event_id, ts, event from e where order_id = 7 order by ts, event_id limit 100")
def order_timeline(spark, sf):
    return O.order_timeline(order_events(spark, sf), 7).select("event_id", "ts", "event")


@job(
    "upsert_orders", "SNK3",
    f"""with {LATEST}, u as (select order_id, version, updated_at, created_at, 'REJECTED' as status, confidence, building, locality, pincode from latest where order_id % 5 = 0
      union all select order_id + 1000000, version, updated_at, created_at, status, confidence, building, locality, pincode from latest where order_id % 50 = 1)
    select * from latest where order_id not in (select order_id from u) union all select * from u""",
)
def upsert_orders(spark, sf):
    rows = latest(spark, sf)
    changed = rows.where("order_id % 5 = 0").withColumn("status", F.lit("REJECTED"))
    added = rows.where("order_id % 50 = 1").withColumn("order_id", F.col("order_id") + 1000000)
    return O.upsert(rows, changed.unionByName(added), "order_id")


@job("ttl_filter", "SNK4", "select o_orderkey, o_orderdate as written_at from orders where o_orderdate + interval 90 days >= timestamp '1998-06-01 00:00:00'")
def ttl_filter(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("written_at"))
    return O.ttl_filter(rows, F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))


FEEDBACK, feedback = both(
    """select event_id, user_id as order_id, ts, case event_type when 'view' then ' Approve ' when 'click' then 'edit' when 'error' then 'reject' when 'purchase' then 'bogus' else null end as action,
      concat('op', cast(event_id % 4 as string)) as actor, event_type = 'click' as edits_locality, value from events""",
    events=driver("events"),
)


def feedback_rows(spark, sf):
    edits = F.when(F.col("edits_locality"), F.create_map(F.lit("locality"), F.concat(F.lit("Edited "), F.col("event_id").cast("string"))))
    return feedback(spark, sf).withColumn("edits", edits)


@job(
    "apply_feedback", "FB1",
    f"""with {LATEST}, fb as ({FEEDBACK}),
    ok as (select *, lower(trim(action)) as a from fb where lower(trim(action)) in ('approve','edit','reject')),
    last as (select order_id, arg_max(ok, {{'ts': ts, 'e': event_id}}) as f from ok group by 1)
    select l.order_id, case when f.a in ('approve','edit') then 'RESOLVED' when f.a is not null then 'REJECTED' else l.status end as status,
      case when f.edits_locality then 'Edited ' || f.event_id else l.locality end as locality, f.actor as reviewed_by
    from latest l left join last using (order_id)""",
)
def apply_feedback(spark, sf):
    good, _ = O.valid_feedback(feedback_rows(spark, sf))
    return O.apply_feedback(latest(spark, sf), good, ["ts", "event_id"]).select("order_id", "status", "locality", "reviewed_by")


@job(
    "feedback_timeline", "FB1 SNK5",
    f"""with fb as ({FEEDBACK}) select order_id, ts, 'operator_' || lower(trim(action)) as event, actor, case when lower(trim(action)) in ('approve','edit') then 'RESOLVED' else 'REJECTED' end as new_status
      from fb where lower(trim(action)) in ('approve','edit','reject')""",
)
def feedback_timeline(spark, sf):
    return O.feedback_events(O.valid_feedback(feedback_rows(spark, sf))[0])


@job(
    "bulk_close", "FB2 ST3",
    f"with {LATEST} select order_id, 'reject' as action, 'cleanup' as actor from latest where status in ('NEEDS_INFO','AMBIGUOUS') and order_id not in (select user_id from events)",
)
def bulk_close(spark, sf):
    keep = table(spark, sf, "events").select(F.col("user_id").alias("order_id"))
    return O.bulk_close(latest(spark, sf), keep)


GENERATED, generated = both(
    """select conv_id, turn, text as generated, case when turn % 5 = 0 then 'fr-FR' when turn % 2 = 0 then 'en-IN' else 'hi-Latn' end as generated_language,
      'What is the pincode?' as template, 'en-IN' as template_language from conversations""",
    conversations=driver("conversations"),
)
DIGITS = " or ".join(f"len(generated) - len(replace(generated, '{d}', '')) > 6" for d in "0123456789")


@job(
    "question_quality", "QA1",
    f"""with g as ({GENERATED}), q as (select *, length(generated) between 5 and 160 and generated_language in ('hi-IN','en-IN','hi-Latn')
      and len(generated) - len(replace(generated, '?', '')) <= 1 and not ({DIGITS}) as ok from g)
    select conv_id, turn, case when ok then 'agent' else 'template' end as source, case when ok then generated_language else template_language end as language,
      md5(case when ok then trim(generated) else template end) as question_md5 from q""",
)
def question_quality(spark, sf):
    return O.question_quality(generated(spark, sf)).select("conv_id", "turn", "source", "language", F.md5("question").alias("question_md5"))


@job("record_resolutions", "RC1")
def record_resolutions(spark, sf):
    orders, _ = O.record_resolutions(Warehouse(spark, sf).table("resolutions"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return orders


@job(
    "order_summaries", "RC1",
    f"with {LATEST} select order_id, concat_ws(', ', building, locality, pincode) as summary from latest",
)
def order_summaries(spark, sf):
    return latest(spark, sf).withColumn("city", F.lit(None).cast("string")).select("order_id", O.summary().alias("summary"))


REQUESTS, requests = both(
    """select event_id, ts, case when user_id % 2 = 0 then 'R2' else 'A' end as stack, 'local' as provider, value as elapsed_ms,
      case event_type when 'view' then 'RESOLVED' when 'click' then 'NEEDS_INFO' else 'AMBIGUOUS' end as status,
      case when event_id % 3 = 0 then 'landmark_graph' when event_id % 3 = 1 then 'pincode_centroid' end as geo_source,
      event_id % 7 = 0 as cached, event_id % 4 = 0 as model_used, event_id % 8 = 0 as escalated, event_id % 2 = 0 as retrieval_ran from events""",
    events=driver("events"),
)
METRIC_SQL = f"""req as ({REQUESTS}),
metrics as (select *, case when status='RESOLVED' then 1.0E0 else 0 end as resolution_rate, case when status='NEEDS_INFO' then 1.0E0 else 0 end as clarification_rate,
  case when status='AMBIGUOUS' then 1.0E0 else 0 end as ambiguous_rate, case when escalated then 1.0E0 else 0 end as escalation_rate, case when cached then 1.0E0 else 0 end as cache_hit_rate,
  case when model_used then 1.0E0 else 0 end as model_call_rate, case when geo_source='landmark_graph' then 1.0E0 else 0 end as geo_from_graph_rate,
  case when geo_source='pincode_centroid' then 1.0E0 else 0 end as geo_from_centroid_rate, round(elapsed_ms, 2) as latency_ms,
  case when cached then 0.0E0 else case when retrieval_ran then 0.00003E0 else 0 end + case when model_used then case when escalated then 0.0045E0 else 0.00025E0 end else 0 end end as cost_per_address from req)"""
RATE_COLUMNS = (
    "resolution_rate", "clarification_rate", "ambiguous_rate", "escalation_rate", "cache_hit_rate", "model_call_rate",
    "geo_from_graph_rate", "geo_from_centroid_rate",
)


@job(
    "request_metrics", "CO1 CO2",
    f"with {METRIC_SQL} select event_id, {', '.join(RATE_COLUMNS)}, latency_ms, round(cost_per_address, 9) as cost_per_address from metrics",
)
def request_metrics(spark, sf):
    return O.request_metrics(requests(spark, sf)).select(
        "event_id", *RATE_COLUMNS, "latency_ms", F.round("cost_per_address", 9).alias("cost_per_address")
    )


@job(
    "metric_windows", "SM4 EV9",
    f"""with {METRIC_SQL}, w as (select *, time_bucket(interval 5 minutes, ts) as window_start from metrics)
    select window_start, stack, provider, count(*) as requests, {', '.join(f'round(avg({c}),6) as {c}' for c in RATE_COLUMNS)}, round(avg(cost_per_address),9) as cost_per_address,
      round(median(latency_ms),4) as latency_p50_ms, round(quantile_disc(latency_ms, 0.95),4) as latency_p95_ms from w group by 1, 2, 3""",
)
def metric_windows(spark, sf):
    """Batch twin of the streamed windows, with exact percentiles."""
    from waymark.operators.skew import grouped_order_stats, nearest_rank

    keys = ["window_start", "stack", "provider"]
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300).cast("timestamp_ntz")
    rows = O.request_metrics(requests(spark, sf)).withColumn("window_start", start)
    n = F.col("n")
    stats = grouped_order_stats(
        rows, keys, "latency_ms", {"_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2), "_p95": nearest_rank(0.95)}, 1.0
    ).select(*keys, F.round((F.col("_lo") + F.col("_hi")) / 2, 4).alias("latency_p50_ms"), F.round("_p95", 4).alias("latency_p95_ms"))
    means = rows.groupBy(*keys).agg(
        F.count("*").alias("requests"), *[F.round(F.avg(c), 6).alias(c) for c in RATE_COLUMNS],
        F.round(F.avg("cost_per_address"), 9).alias("cost_per_address"),
    )
    return means.join(stats, keys)
