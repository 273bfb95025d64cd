"""Jobs that grade resolutions: accuracy, reliability, calibration, learning curve."""

from pyspark.sql import functions as F

from waymark.functions import tables
from waymark.functions import text as X
from waymark.operators import evaluate as E
from waymark.operators import scoring as S
from waymark.plans import chain, sql
from waymark.plans.jobs_corpus import corpus
from waymark.plans.jobs_retrieval import (
    CITY_SQL, FIELDS_SQL, HYBRID_SQL, RESPONSE, RULES_SQL, calibrated, hybrid_sql, index, request_rows,
)
from waymark.plans.registry import job
from waymark.sources.fixtures import table, view
from waymark.sources.warehouse import Warehouse, reference_table, staged

GRADED_SQL = f"""with {sql.AGREEMENT}, {CITY_SQL}, {FIELDS_SQL},
graded as (select f.order_id, f.building as pred_building, cast(null as varchar) as pred_street, cast(null as varchar) as pred_sub_locality,
  f.locality as pred_locality, f.city as pred_city, f.district as pred_district, f.state as pred_state, f.pincode as pred_pincode,
  case when f.order_id % 10 = 3 then 'x' || f.order_id else cast(f.order_id % 300 as varchar) end as true_building, cast(null as varchar) as true_street,
  case when f.order_id % 50 = 7 then 'Sector 9' end as true_sub_locality, a.true_locality, o.district as true_city, o.district as true_district, a.true_state, a.true_pincode,
  f.centroid_lat as pred_lat, f.centroid_lng as pred_lng, a.true_lat, a.true_lng,
  ((f.order_id * 37) % 1000)/1000.0E0 as confidence,
  case when f.order_id % 4 = 0 then 'RESOLVED' when f.order_id % 4 = 1 then 'AMBIGUOUS' else 'NEEDS_INFO' end as status,
  case when f.order_id % 3 = 0 then 'A' else 'R2' end as config
  from fields f join address a using (order_id) join office o on o.office_id = a.landmark_office_id)"""


@reference_table("graded")
def _graded(w):
    """Parsed fields beside the truth, with a stand-in confidence and status."""
    parsed = w.table("parsed")
    truth = view(w.spark, w.sf_dir, "address").select(
        "order_id", "landmark_office_id", "true_locality", "true_state", "true_pincode", "true_lat", "true_lng"
    )
    district = view(w.spark, w.sf_dir, "office").select(F.col("office_id").alias("landmark_office_id"), F.col("district").alias("true_district"))
    k = F.col("order_id")
    none = F.lit(None).cast("string")
    return (
        parsed.select(
            "order_id", *[F.col(f).alias(f"pred_{f}") for f in ("building", "locality", "city", "district", "state", "pincode")],
            F.col("centroid_lat").alias("pred_lat"), F.col("centroid_lng").alias("pred_lng"),
        )
        .join(truth, "order_id")
        .join(district, "landmark_office_id")
        .withColumns(
            {
                "pred_street": none, "pred_sub_locality": none, "true_street": none,
                "true_building": F.when(k % 10 == 3, F.concat(F.lit("x"), k.cast("string"))).otherwise((k % 300).cast("string")),
                "true_sub_locality": F.when(k % 50 == 7, "Sector 9"),
                "true_city": F.col("true_district"),
                "confidence": (k * 37 % 1000) / F.lit(1000.0),
                "status": F.when(k % 4 == 0, "RESOLVED").when(k % 4 == 1, "AMBIGUOUS").otherwise("NEEDS_INFO"),
                "config": F.when(k % 3 == 0, "A").otherwise("R2"),
            }
        )
    )


def graded(spark, sf):
    return Warehouse(spark, sf).table("graded")


def comp(x):
    low = f"lower(trim({x}))"
    return (
        f"nullif(trim(regexp_replace(regexp_replace(case when {low} in ('','null','none','n/a','na','-') then null else {low} end, "
        f"'[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '')"
    )


LONG_SQL = GRADED_SQL + ", long as (" + " union all ".join(
    f"select order_id, config, '{f}' as field, {E.tables.EVALUATION_WEIGHTS[f]}E0 as weight, {comp('pred_' + f)} as p, {comp('true_' + f)} as t from graded"
    for f in tables.FIELDS
) + """),
counts as (select config, field, any_value(weight) as weight, count(*) filter (where p = t) as tp, count(*) filter (where p is not null and (t is null or p <> t)) as fp,
  count(*) filter (where t is not null and (p is null or p <> t)) as fn, count(*) filter (where p is null and t is null) as tn, count(*) filter (where p <> t) as wrong from long group by 1, 2),
totals as (select field, any_value(weight) as weight, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tn) as bigint) as tn, cast(sum(wrong) as bigint) as wrong from counts group by 1)"""

F1 = """(select *, case when pr + re > 0 then 2*pr*re/(pr+re) else 0 end as f1 from (select *,
  case when tp+fp > 0 then tp*1.0E0/(tp+fp) else 1.0E0 end as pr, case when tp+fn > 0 then tp*1.0E0/(tp+fn) else 1.0E0 end as re from {0}))"""


@job("normalise_value", "EV1", f"{GRADED_SQL} select order_id, {comp('pred_locality')} as p, {comp('true_building')} as t from graded")
def normalise_value(spark, sf):
    return graded(spark, sf).select(
        "order_id", X.comparable(F.col("pred_locality")).alias("p"), X.comparable(F.col("true_building")).alias("t")
    )


@job("score_fields", "EV2", f"{LONG_SQL} select field, tp, fp, fn, tn, wrong from totals")
def score_fields(spark, sf):
    return E.score_fields(graded(spark, sf))


@job(
    "macro_f1", "EV3 EV4",
    f"{LONG_SQL} select round(avg(case when tp+fn>0 then f1 end),6) as macro_f1, round(sum(case when tp+fn>0 then f1*weight end)/sum(case when tp+fn>0 then weight end),6) as weighted_f1, count(*) filter (where tp+fn=0) as unmeasured from {F1.format('totals')}",
)
def macro_f1(spark, sf):
    return E.summary_f1(E.with_f1(E.score_fields(graded(spark, sf))))


@job("unmeasured_fields", "EV4", f"{LONG_SQL} select field from totals where tp + fn = 0")
def unmeasured_fields(spark, sf):
    return E.unmeasured_fields(E.score_fields(graded(spark, sf)))


EXACT = """(select order_id, any_value(config) as config, bool_and(p is not distinct from t) as ok from long where field in (select field from totals where tp+fn > 0) group by 1)"""


@job("exact_match_rate", "EV5", f"{LONG_SQL} select round(avg(case when ok then 1.0E0 else 0 end),6) as exact_match from {EXACT}")
def exact_match_rate(spark, sf):
    return E.exact_match_rate(graded(spark, sf))


ERR = sql.haversine("pred_lat", "pred_lng", "true_lat", "true_lng")


@job(
    "geocode_error", "EV6 GE6",
    f"{GRADED_SQL}, e as (select {ERR} as err from graded) select round(median(err),1) as median_m, round(quantile_disc(err, 0.9),1) as p90_m, round(count(err)*1.0E0/count(*),6) as coverage from e",
)
def geocode_error(spark, sf):
    return E.geocode_error(graded(spark, sf))


def rate(status, name):
    return f"round(avg(case when status='{status}' then 1.0E0 else 0 end),6) as {name}"


RATES = f"{rate('RESOLVED','resolved')}, {rate('NEEDS_INFO','needs_info')}, {rate('AMBIGUOUS','ambiguous')}"


@job("status_rates", "EV7", f"{GRADED_SQL} select {RATES} from graded")
def status_rates(spark, sf):
    return E.status_rates(graded(spark, sf))


@job(
    "precision_at_threshold", "EV8",
    f"""{LONG_SQL}, allr as (select order_id, bool_and(p is not distinct from t) as ok from long group by 1)
    select coalesce(round(avg(case when confidence >= 0.8 then case when ok then 1.0E0 else 0 end end),6),0) as precision_at, count(*) filter (where confidence >= 0.8) as above from graded join allr using (order_id)""",
)
def precision_at_threshold(spark, sf):
    return E.precision_at_threshold(graded(spark, sf))


@job(
    "latency_percentiles", "EV9",
    "with t as (select value + (event_id % 13)/10.0E0 + 0.25E0 as v from events) select round(median(v),6) as p50_ms, round(quantile_disc(v,0.95),6) as p95_ms from t",
)
def latency_percentiles(spark, sf):
    timings = F.create_map(
        F.lit("parse"), F.col("value"), F.lit("retrieve"), (F.col("event_id") % 13) / F.lit(10.0), F.lit("decide"), F.lit(0.25)
    )
    return E.latency_percentiles(table(spark, sf, "events").withColumn("timings_ms", timings))


ABLATION_TAIL = f""", f as {F1.format('counts')},
    s as (select config, round(avg(case when tp+fn>0 then f1 end),6) as macro_f1, round(sum(case when tp+fn>0 then f1*weight end)/sum(case when tp+fn>0 then weight end),6) as weighted_f1, count(*) filter (where tp+fn=0) as unmeasured from f group by 1),
    ex as (select order_id, any_value(l.config) as config, bool_and(l.p is not distinct from l.t) as ok from long l join counts c on c.config=l.config and c.field=l.field where c.tp+c.fn>0 group by 1),
    x as (select config, round(avg(case when ok then 1.0E0 else 0 end),6) as exact_match from ex group by 1),
    allr as (select order_id, bool_and(p is not distinct from t) as ok from long group by 1),
    g as (select config, count(*) as n, {RATES}, round(median({ERR}),1) as median_m, round(quantile_disc({ERR},0.9),1) as p90_m, round(count({ERR})*1.0E0/count(*),6) as coverage,
      coalesce(round(avg(case when confidence >= 0.8 then case when ok then 1.0E0 else 0 end end),6),0) as precision_at, count(*) filter (where confidence >= 0.8) as above
      from graded join allr using (order_id) group by 1)
    select * from g join s using (config) join x using (config)"""


@job("ablation", "EV10 EV3 EV5 EV6 EV7 EV8", LONG_SQL + ABLATION_TAIL)
def ablation(spark, sf):
    return E.run_metrics(graded(spark, sf), ["config"])


def graded_runs(configs: dict[str, str]) -> str:
    """Metrics of several configurations, given as the statements of their outcomes, by their own status and confidence."""
    truth = ", ".join(f"true_{f}" for f in tables.FIELDS)
    filled = "case when config like '%+responses' and order_id % 3 <> 0 and order_id % 10 <> 1 then 'Sector 9' end"
    runs = " union all ".join(f"select '{name}' as config, * from ({outcomes})" for name, outcomes in configs.items())
    return f"""with truth as (select order_id, {truth}, true_lat, true_lng from ({GRADED_SQL} select * from graded)),
    runs as ({runs}),
    graded as (select config || '/' || order_id as order_id, config, status, confidence, building as pred_building, cast(null as varchar) as pred_street, {filled} as pred_sub_locality,
      locality as pred_locality, city as pred_city, district as pred_district, state as pred_state, pincode as pred_pincode, lat as pred_lat, lng as pred_lng, {truth}, true_lat, true_lng
      from runs join truth using (order_id))""" + LONG_SQL[len(GRADED_SQL) :] + ABLATION_TAIL


def run_of(rows, config):
    """Resolutions of one configuration as predictions."""
    return rows.select(
        F.lit(config).alias("config"), "order_id", "status", "confidence", *[F.col(f).alias(f"pred_{f}") for f in tables.FIELDS],
        F.col("geo.lat").alias("pred_lat"), F.col("geo.lng").alias("pred_lng"),
    )


def metrics_of(w, runs):
    truth = w.table("graded").select("order_id", *[f"true_{f}" for f in tables.FIELDS], "true_lat", "true_lng")
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    return E.run_metrics(staged(every.join(truth, "order_id"), "graded_runs"), ["config"])


@job("ablation_configs", "EV10 EV8", graded_runs({"A": RULES_SQL, "R1": hybrid_sql(lexical=True), "R2": HYBRID_SQL}))
def ablation_configs(spark, sf):
    """The three model-free configurations graded against the same truth."""
    w = Warehouse(spark, sf)
    found = chain.resolve_each(request_rows(spark, sf), w.table("gazetteer"), w.table("localities"), index(w))
    return metrics_of(w, [run_of(rows, config) for config, rows in found.items()])


@job("ablation_responses", "EV10 EV8 PR17", graded_runs({"R1+responses": hybrid_sql(lexical=True, responded=True), "R2+responses": hybrid_sql(responded=True)}))
def ablation_responses(spark, sf):
    """The configurations that settle with stored model responses, graded like those without."""
    w = Warehouse(spark, sf)
    requests = request_rows(spark, sf, F.expr(RESPONSE.replace("\n", " ")).alias("response"))
    found = chain.resolve_each(requests, w.table("gazetteer"), w.table("localities"), index(w), ("R1", "R2"))
    return metrics_of(w, [run_of(rows, f"{config}+responses") for config, rows in found.items()])


SLICES = ("drop_pincode", 5), ("inject_phone", 6), ("append_chatter", 7)
SLICE_SQL = LONG_SQL + ", slices as (" + " union all ".join(
    f"select order_id, '{n}' as perturbation from graded where order_id % {m} = 0" for n, m in SLICES
) + ")"


@job(
    "metrics_by_perturbation", "EV11",
    f"""{SLICE_SQL} select perturbation, field, count(*) filter (where p = t) as tp, count(*) filter (where p is not null and (t is null or p <> t)) as fp,
      count(*) filter (where t is not null and (p is null or p <> t)) as fn, count(*) filter (where p is null and t is null) as tn, count(*) filter (where p <> t) as wrong
      from long join slices using (order_id) group by 1, 2""",
)
def metrics_by_perturbation(spark, sf):
    marks = F.array_compact(F.array(*[F.when(F.col("order_id") % m == 0, n) for n, m in SLICES]))
    rows = graded(spark, sf).withColumn("perturbation", F.explode(marks))
    return E.score_fields(rows, ["perturbation"])


@reference_table("corpus_graded")
def _corpus_graded(w):
    """Each row of the corpus as each configuration resolves it, beside the truth of its seed."""
    rows = corpus(w.spark, w.sf_dir).select(F.col("address_id").alias("order_id"), "raw", "seed_id", "building", "perturbations")
    seeds = w.table("seeds")
    known = [f for f in tables.FIELDS if f != "building" and f in seeds.columns]
    truth = rows.withColumnRenamed("building", "true_building").join(
        seeds.select("seed_id", *[F.col(f).alias(f"true_{f}") for f in known], F.col("lat").alias("true_lat"), F.col("lng").alias("true_lng")), "seed_id"
    )
    truth = truth.withColumns({f"true_{f}": F.lit(None).cast("string") for f in tables.FIELDS if f"true_{f}" not in truth.columns})
    truth = truth.select("order_id", "perturbations", *[f"true_{f}" for f in tables.FIELDS], "true_lat", "true_lng")
    runs = None
    for config, found in chain.resolve_each(rows.select("order_id", "raw"), w.table("gazetteer"), w.table("localities"), index(w)).items():
        runs = run_of(found, config) if runs is None else runs.unionByName(run_of(found, config))
    return runs.join(truth, "order_id")


@job("corpus_ablation", "EV8 EV10")
def corpus_ablation(spark, sf):
    """The model-free configurations over the whole corpus, by their own status and confidence."""
    return E.run_metrics(Warehouse(spark, sf).table("corpus_graded"), ["config"])


@job("corpus_by_perturbation", "EV11")
def corpus_by_perturbation(spark, sf):
    """Counts per configuration, field and perturbation of the corpus; rows without any count as clean."""
    marks = F.when(F.size("perturbations") == 0, F.array(F.lit("clean"))).otherwise(F.col("perturbations"))
    rows = Warehouse(spark, sf).table("corpus_graded").withColumn("perturbation", F.explode(marks))
    return E.score_fields(rows, ["config", "perturbation"])


CORRECT = f"""({' and '.join(f"({comp('true_' + f)} is null or {comp('pred_' + f)} is not distinct from {comp('true_' + f)})" for f in tables.FIELDS)} and coalesce({ERR} <= 500, true))"""
SCORED_SQL = GRADED_SQL + f", scored as (select order_id, confidence as score, {CORRECT} as correct from graded)"


@reference_table("scored")
def _scored(w):
    return w.table("graded").select("order_id", F.col("confidence").alias("score"), E.is_correct().alias("correct"))


@job("is_correct", "CA7", f"{SCORED_SQL} select order_id, correct from scored")
def is_correct(spark, sf):
    return graded(spark, sf).select("order_id", E.is_correct().alias("correct"))


# accounts as scored predictions: more rows, finer scores than the addresses
ACCOUNTS = "accounts as (select c_custkey as id, round((c_acctbal + 1000)/11000.0E0, 6) as score, (c_acctbal + (c_custkey * 7919) % 6000) > 6500 as correct from customer)"


def accounts(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.round((F.col("c_acctbal") + 1000) / 11000.0, 6).alias("score"),
        ((F.col("c_acctbal") + F.col("c_custkey") * 7919 % 6000) > 6500).alias("correct"),
    )


BINS = """bins as (select b as bin, count(*) as n, avg(score) as confidence, avg(case when correct then 1.0E0 else 0 end) as accuracy
  from accounts join range(10) r(b) on (score >= b/10.0E0 and score < (b+1)/10.0E0) or (b = 9 and score = 1.0) group by 1)"""


@job(
    "fit_isotonic", "CA1 CA2",
    f"""with {ACCOUNTS}, g as (select score, count(*) as w, avg(case when correct then 1.0E0 else 0 end) as y from accounts group by 1),
    n as (select *, row_number() over (order by score) as i, sum(w) over (order by score) as cw, sum(w*y) over (order by score) as cy from g),
    m as (select a.i as j, b.i as k, (b.cy - a.cy + a.w*a.y)/(b.cw - a.cw + a.w) as av from n a join n b on b.i >= a.i),
    low as (select j, k, min(av) over (partition by j order by k desc) as lo from m),
    fit as (select k as i, max(lo) as f from low group by 1)
    select score, round(f, 6) as calibrated from n join fit using (i)""",
)
def fit_isotonic(spark, sf):
    rows = accounts(spark, sf)
    model = E.fit_isotonic(rows)
    return E.calibrated(rows.select("score").distinct(), model).select("score", F.round("calibrated", 6).alias("calibrated"))


@job(
    "apply_calibration", "CA2",
    f"with {ACCOUNTS} select id, round({calibrated('score')}, 6) as calibrated from accounts",
)
def apply_calibration(spark, sf):
    return accounts(spark, sf).select("id", F.round(S.apply_calibration(F.col("score")), 6).alias("calibrated"))


@job("reliability_bins", "CA3", f"with {ACCOUNTS}, {BINS} select cast(bin as integer) as bin, n, round(confidence,6) as confidence, round(accuracy,6) as accuracy from bins")
def reliability_bins(spark, sf):
    b = E.reliability_bins(accounts(spark, sf))
    return b.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@job("expected_calibration_error", "CA4", f"with {ACCOUNTS}, {BINS} select round(sum(n*abs(confidence-accuracy))/sum(n),6) as ece from bins")
def expected_calibration_error(spark, sf):
    return E.ece(E.reliability_bins(accounts(spark, sf)))


@job("cross_validated_ece", "CA5")
def cross_validated_ece(spark, sf):
    return E.cross_validated_ece(accounts(spark, sf), "id")


@job(
    "choose_threshold", "CA6",
    f"""with {ACCOUNTS}, c as (select distinct round(score,2) as t from accounts),
    p as (select t, count(*) as support, avg(case when correct then 1.0E0 else 0 end) as pr from c join accounts on score >= t group by 1 having count(*) >= 10),
    f as (select coalesce(max(t), -1) as worst from p where pr < 0.7),
    b as (select * from p where t > (select worst from f) order by t limit 1)
    select round(min(t),2) as threshold, round(min(pr),6) as precision, round(coalesce(min(support),0)*1.0E0/(select count(*) from accounts),6) as auto_resolution_rate, coalesce(min(support),0) as support from b""",
)
def choose_threshold(spark, sf):
    return E.choose_threshold(accounts(spark, sf), 0.7)


@job(
    "field_completeness", "SC1 SC2 AU4",
    f"""{GRADED_SQL} select order_id, round(least(1.0E0, case when pred_building is not null then 0.28E0 else 0 end + case when pred_locality is not null then 0.2E0 else 0 end
      + case when pred_pincode is not null then 0.18E0 else 0 end + case when pred_city is not null then 0.08E0 else 0 end + case when pred_district is not null then 0.03E0 else 0 end
      + case when pred_state is not null then 0.03E0 else 0 end),6) as completeness,
      round(case when order_id % 60 = 0 then 0 else least(1.0E0, ln(1.0E0 + order_id % 60)/ln(51.0E0)) end, 6) as observation_weight,
      cast(round_even(least(1, greatest(0, confidence))*100, 0) as integer) as confidence_pct from graded""",
)
def field_completeness(spark, sf):
    from waymark.operators.policy import confidence_pct

    return graded(spark, sf).select(
        "order_id",
        F.round(S.field_completeness({f: F.col(f"pred_{f}") for f in tables.FIELDS}), 6).alias("completeness"),
        F.round(S.observation_weight(F.col("order_id") % 60), 6).alias("observation_weight"),
        confidence_pct(F.col("confidence")).alias("confidence_pct"),
    )
