"""Jobs over histories and streams: learning, caches, timeouts, the learning curve."""

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import history as H
from waymark.operators import learn as L
from waymark.operators import orders as O
from waymark.operators import placing
from waymark.plans import sql
from waymark.plans.jobs_orders import METRIC_SQL, RATE_COLUMNS, both, derived, driver, requests
from waymark.plans.jobs_retrieval import AFFINITY_SQL, per_order
from waymark.plans.registry import job
from waymark.sources.fixtures import table, view
from waymark.sources.warehouse import Warehouse, scratch, staged, widened
from waymark.streaming import jobs as streams


def known_landmarks(spark, sf):
    """Offices with a point as landmarks; ids stay numbers to match deliveries."""
    return view(spark, sf, "office").where(F.col("lat").isNotNull()).select(
        F.col("office_id").alias("landmark_id"), F.col("office_name").alias("canonical_name"),
        F.array().cast("array<string>").alias("aliases"), "lat", "lng", "observation_count", F.lit(0.5).alias("confidence"),
    )


# every ninth confirmation is for a landmark nobody knows, spellings repeat
DELIVERIES, deliveries = both(
    """select event_id, ts, case when event_id % 9 = 0 then landmark_id + 900000 else landmark_id end as landmark_id, lat, lng,
      case when event_id % 5 = 0 then null else accuracy_m end as accuracy_m,
      case when event_id % 3 = 0 then concat('Spelling ', cast(event_id % 4 as string)) else null end as spelling from delivery""",
    delivery=derived("delivery"),
)

D = sql.haversine("s.lat", "s.lng", "e.lat", "e.lng")
ALPHA = "(greatest(0.02E0, 1.0E0/(s.obs + 1)) * case when e.accuracy_m > 50 then 50.0E0/e.accuracy_m else 1.0E0 end)"
FOLD = f"""ev as (select *, row_number() over (partition by landmark_id order by ts, event_id) as n from ({DELIVERIES})),
start as (select office_id as landmark_id, lat, lng, observation_count as obs, 0.5E0 as confidence, lower(office_name) as nm from office where lat is not null),
walk(landmark_id, n, event_id, lat, lng, rlat, rlng, obs, confidence, before_obs, moved, rejected) as (
  select landmark_id, cast(0 as bigint), cast(null as bigint), lat, lng, lat, lng, obs, confidence, obs, 0.0E0, false from start
  union all
  select s.landmark_id, e.n, e.event_id,
    case when {D} > 400 then s.lat else cast(printf('%.6f', s.lat + {ALPHA}*(e.lat - s.lat)) as double) end, case when {D} > 400 then s.lng else cast(printf('%.6f', s.lng + {ALPHA}*(e.lng - s.lng)) as double) end,
    case when {D} > 400 then s.rlat else s.lat + {ALPHA}*(e.lat - s.lat) end, case when {D} > 400 then s.rlng else s.lng + {ALPHA}*(e.lng - s.lng) end,
    case when {D} > 400 then s.obs else s.obs + 1 end, case when {D} > 400 then s.confidence else least(0.97E0, s.confidence + 0.05E0) end,
    s.obs, case when {D} > 400 then 0.0E0 else {sql.haversine('s.lat','s.lng',f'(s.lat + {ALPHA}*(e.lat - s.lat))',f'(s.lng + {ALPHA}*(e.lng - s.lng))')} end, {D} > 400
  from walk s join ev e on e.landmark_id = s.landmark_id and e.n = s.n + 1)"""


@job(
    "learning_audit", "SM1 SM2",
    f"""with {FOLD} select event_id, landmark_id, cast(before_obs as integer) as before_observations, cast(obs as integer) as after_observations, round(moved, 3) as moved_m,
      case when rejected then 'too far' end as rejected, round(lat, 6) as lat, round(lng, 6) as lng from walk where n > 0
    union all select event_id, landmark_id, 0, 0, 0.0, 'landmark not in graph', null, null from ev where landmark_id not in (select landmark_id from start)""",
)
def learning_audit(spark, sf):
    audit = L.learning_audit(deliveries(spark, sf), known_landmarks(spark, sf))
    return audit.select(
        "event_id", "landmark_id", "before_observations", "after_observations", F.round("moved_m", 3).alias("moved_m"), "rejected",
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"),
    )


@job(
    "learn_landmarks", "SM1 SM8",
    f"""with {FOLD}, last as (select landmark_id, arg_max(walk, n) as w from walk group by 1),
    accepted as (select w.landmark_id, e.spelling from walk w join ev e on e.landmark_id = w.landmark_id and e.n = w.n where w.n > 0 and not w.rejected),
    al as (select landmark_id, count(distinct spelling) as aliases from accepted group by 1)
    select l.landmark_id, round(w.lat, 6) as lat, round(w.lng, 6) as lng, cast(w.obs as integer) as observation_count, round(w.confidence, 6) as confidence,
      coalesce(al.aliases, 0) as aliases, substr({sql.cell('w.rlat','w.rlng')}, 1, 8) as cell8 from last l left join al using (landmark_id)""",
)
def learn_landmarks(spark, sf):
    known = known_landmarks(spark, sf)
    audit = staged(L.learning_audit(deliveries(spark, sf), known), "learning_audit")
    return L.learned_landmarks(audit, known).select(
        "landmark_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "observation_count",
        F.round("confidence", 6).alias("confidence"), F.size("aliases").cast("long").alias("aliases"),
        F.substring("digipin_cell", 1, 8).alias("cell8"),
    )


CONFIRMED, confirmed = both(
    """select order_id, order_id + 5000000 as event_id, timestamp_ntz '2024-01-01 00:00:00' as ts, case when order_id % 3 = 0 then null else true_lat end as lat, true_lng as lng,
      cast(order_id % 90 as double) as accuracy_m from address""",
    address=derived("address"),
)


@job(
    "learning_events", "JN12",
    f"""with c as ({CONFIRMED.replace('timestamp_ntz', 'timestamp')}), o as (select order_id, landmark_office_id, true_locality, true_lat + 0.001E0 as glat, true_lng as glng from address)
    select o.landmark_office_id as landmark_id, order_id, event_id, round(coalesce(c.lat, o.glat), 6) as lat, round(case when c.lat is not null then c.lng else o.glng end, 6) as lng, accuracy_m, true_locality as spelling
    from c join o using (order_id) where coalesce(c.lat, o.glat) is not null
    union all select o.landmark_office_id + 1, order_id, event_id, round(coalesce(c.lat, o.glat), 6), round(case when c.lat is not null then c.lng else o.glng end, 6), accuracy_m, 'second'
    from c join o using (order_id) where coalesce(c.lat, o.glat) is not null and order_id % 2 = 0""",
)
def learning_events(spark, sf):
    address = view(spark, sf, "address")
    second = F.when(F.col("order_id") % 2 == 0, F.col("landmark_office_id") + 1)
    orders = address.select(
        "order_id",
        F.array(
            F.struct(F.col("landmark_office_id").alias("matched_id"), F.col("true_locality").alias("name")),
            F.struct(second.alias("matched_id"), F.lit("second").alias("name")),
        ).alias("landmarks"),
        F.struct((F.col("true_lat") + 0.001).alias("lat"), F.col("true_lng").alias("lng")).alias("geo"),
    )
    events = confirmed(spark, sf).withColumn("location", F.when(F.col("lat").isNotNull(), F.struct("lat", "lng"))).drop("lat", "lng")
    return L.learning_events(events, orders).select(
        "landmark_id", "order_id", "event_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "accuracy_m", "spelling"
    )


ROUTED, routed = both(
    """select event_id, case when event_id % 37 = 0 then null else user_id end as order_id, case event_type when 'purchase' then 'DeliveryConfirmed' when 'error' then null else 'CaseReviewed' end as detail_type,
      case when event_id % 11 = 0 then null else value end as lat from events""",
    events=driver("events"),
)


@job(
    "route_events", "SM3",
    f"with r as ({ROUTED}) select event_id, case when detail_type is distinct from 'DeliveryConfirmed' then 'ignored' when order_id is not null and lat is not null then 'learn' else 'skipped' end as route from r",
)
def route_events(spark, sf):
    rows = routed(spark, sf).withColumn("location", F.when(F.col("lat").isNotNull(), F.struct("lat", F.lit(0.0).alias("lng"))))
    return L.route_events(rows).select("event_id", "route")


# entries of a cache: the first storing row of a user, then the first after each entry's end
ENTRIES = """st as (
      select user_id, min(ts) as ts from e where stores group by 1
      union all select e.user_id, min(e.ts) from st join e on e.user_id = st.user_id and e.stores and e.ts > st.ts + interval {ttl} group by e.user_id, st.ts),
    entry as (select st.user_id, st.ts, min(e.event_id) as event_id from st join e on e.user_id = st.user_id and e.ts = st.ts and e.stores group by 1, 2),
    looked as (select e.event_id, e.user_id, exists (select 1 from entry x where x.user_id = e.user_id and (x.ts < e.ts or (x.ts = e.ts and x.event_id < e.event_id)) and e.ts <= x.ts + interval {ttl}) as cache_hit from e)"""
BOUGHT = f"e as (select event_id, user_id, ts, event_type = 'purchase' as stores from events), {ENTRIES.format(ttl='6 hours')}"


@job(
    "asof_cache_hit", "JN13 SM6",
    f"with {BOUGHT} select event_id, cache_hit from looked",
)
def asof_cache_hit(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return H.asof_cache_hit(events, "user_id", "ts", "event_id", F.col("event_type") == "purchase", "6 hours").select("event_id", "cache_hit")


@job(
    "dedupe_resolutions", "SM6",
    f"with e as (select event_id, user_id, ts, true as stores from events), {ENTRIES.format(ttl='2 hours')} select event_id, user_id from looked where not cache_hit",
)
def dedupe_resolutions(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return H.first_in_ttl(events, "user_id", "ts", "event_id", "2 hours").select("event_id", "user_id")


@job(
    "clarification_timeout", "SM7",
    """with e as (select * from events where event_type in ('error', 'purchase')),
    f as (select *, min(case when event_type = 'purchase' then ts end) over (partition by user_id order by ts desc, event_id desc rows between unbounded preceding and 1 preceding) as reply from e)
    select event_id, user_id, ts + interval 6 hours as due from f where event_type = 'error' and (reply is null or reply >= ts + interval 6 hours)""",
)
def clarification_timeout(spark, sf):
    kind = F.col("event_type")
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return H.unanswered(events, "user_id", "ts", "event_id", kind == "error", kind == "purchase", "6 hours").select("event_id", "user_id", "due")


# each address once more with one letter added: its near duplicate
VARIANTS = f"""{sql.PINS}, base as (select order_id, text, coalesce((select max(pincode) from pins p where p.order_id = f.order_id), '') as pincode from phone_free f),
t as (select order_id as doc, pincode, text from base union all select order_id + 1000000, pincode, text || ' a' from base where order_id % 3 = 0)"""


@job(
    "near_duplicate_join", "JN10",
    f"""with {VARIANTS},
    words as (select doc, chr(2) || unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) || chr(3) as w from t),
    grams as (select doc, unnest(list_transform(range(1, greatest(2, length(w) - 1)), lambda i: substr(w, i, 3))) as g from words),
    gc as (select doc, g, count(*) as c from grams group by 1, 2),
    gv as (select doc, cast(('0x' || substr(md5(g),1,8)) as bigint) % 1024 as bucket, sum(case when substr(md5(g),9,1) in ('8','9','a','b','c','d','e','f') then 1.0E0 else -1.0E0 end * (1 + ln(c))) as v from gc group by 1, 2),
    nm as (select doc, sqrt(sum(v*v)) as n from gv group by 1),
    vec as (select doc, pincode, bucket, v/n as w from gv join nm using (doc) join t using (doc)),
    dots as (select a.doc as a, b.doc as b, round(sum(a.w*b.w), 9) as cosine from vec a join vec b on a.pincode = b.pincode and a.bucket = b.bucket and b.doc < a.doc group by 1, 2)
    select a as doc, min({{'m': -cosine, 'b': b}}).b as other, round(max(cosine), 6) as cosine from dots where cosine >= 0.97 group by 1""",
)
def near_duplicate_join(spark, sf):
    parsed = Warehouse(spark, sf).table("parsed_text")
    base = parsed.select("order_id", "text", F.coalesce(F.array_max("pincode_candidates"), F.lit("")).alias("pincode"))
    again = base.where(F.col("order_id") % 3 == 0).select(
        (F.col("order_id") + 1000000).alias("order_id"), F.concat("text", F.lit(" a")).alias("text"), "pincode"
    )
    texts = widened(base).unionByName(widened(again)).withColumnRenamed("order_id", "doc")
    return H.near_duplicate_join(texts, "doc", "pincode").select("doc", "other", F.round("cosine", 6).alias("cosine"))


@job(
    "cache_stats", "EV13",
    f"""with {BOUGHT}, l as (select case when cache_hit then 'exact' when event_id % 10 = 0 then 'near_duplicate' end as level from looked)
    select count(*) as lookups, count(*) filter (where level = 'exact') as exact_hits, count(*) filter (where level = 'near_duplicate') as near_hits, count(*) filter (where level is null) as misses,
      round(count(level)*1.0E0/count(*), 6) as hit_rate from l""",
)
def cache_stats(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    hits = H.asof_cache_hit(events, "user_id", "ts", "event_id", F.col("event_type") == "purchase", "6 hours")
    level = F.when(F.col("cache_hit"), "exact").when(F.col("event_id") % 10 == 0, "near_duplicate")
    return H.cache_stats(hits.withColumn("level", level))


def ordered(spark, sf):
    return view(spark, sf, "address").withColumn("ord", F.md5(F.concat(F.lit("walk|"), F.col("order_id").cast("string"))))


@job(
    "seen_in_locality", "RT21",
    "select order_id, row_number() over (partition by true_pincode order by md5('walk|' || order_id)) - 1 as seen from address",
)
def seen_in_locality(spark, sf):
    return H.seen_before(ordered(spark, sf), "true_pincode", "ord").select("order_id", "seen")


# landmarks within the address's own pincode become known as that pincode is visited
CURVE = AFFINITY_SQL + f""",
walk as (select order_id, md5('walk|' || order_id) as ord, lpad(cast(landmark_office_id as varchar),12,'0') as own, true_pincode, true_lat, true_lng from address),
visits as (select true_pincode, min(ord) as first_ord from walk group by 1),
first_seen as (select l.landmark_id, v.first_ord from lm l join visits v on v.true_pincode = l.pincode),
m as (select a.order_id, w.ord, a.landmark_id, max(a.affinity) as affinity from aff a join walk w using (order_id) where a.affinity >= 0.35 group by 1, 2, 3),
hit as (select m.order_id, min({{'a': -m.affinity, 'l': m.landmark_id}}).l as landmark_id from m join first_seen f using (landmark_id) where f.first_ord < m.ord group by 1)"""


def first_seen(spark, sf):
    visits = ordered(spark, sf).groupBy(F.col("true_pincode").alias("pincode")).agg(F.min("ord").alias("first_ord"))
    return Warehouse(spark, sf).table("landmarks").select("landmark_id", "pincode").join(visits, "pincode").select("landmark_id", "first_ord")


def known_matches(spark, sf):
    w = Warehouse(spark, sf)
    strong = w.table("pairs").where(F.col("affinity") >= 0.35).groupBy("query_id", "landmark_id").agg(F.max("affinity").alias("affinity"))
    walk = ordered(spark, sf).select("order_id", "ord")
    matches = per_order(w, strong).join(walk, "order_id")
    return H.known_before(matches, first_seen(spark, sf))


@job("prequential_graph_join", "JN14", f"with {CURVE} select order_id, landmark_id from hit")
def prequential_graph_join(spark, sf):
    return known_matches(spark, sf)


SEEN = "(row_number() over (partition by w.true_pincode order by w.ord) - 1)"


@job(
    "learning_curve", "EV12 JN14 RT21",
    f"""with {CURVE}, s as (select w.order_id, {SEEN} as seen, h.landmark_id is not null as from_graph,
      {sql.haversine('coalesce(l.lat, p.centroid_lat)', 'case when l.lat is not null then l.lng else p.centroid_lng end', 'w.true_lat', 'w.true_lng')} as err
      from walk w left join hit h using (order_id) left join lm l on l.landmark_id = h.landmark_id left join placed p on p.order_id = w.order_id)
    select case when seen = 0 then '0' when seen = 1 then '1' when seen <= 3 then '2-3' when seen <= 7 then '4-7' when seen <= 15 then '8-15' else '16+' end as bucket,
      count(*) as n, round(avg(case when from_graph then 1.0E0 else 0 end), 6) as graph_hit_rate, round(count(err)*1.0E0/count(*), 6) as geo_coverage, round(median(err), 1) as geo_median_m from s group by 1""",
)
def learning_curve(spark, sf):
    w = Warehouse(spark, sf)
    truth = H.seen_before(ordered(spark, sf), "true_pincode", "ord").select("order_id", "seen", "true_lat", "true_lng")
    marks = w.table("landmarks").select("landmark_id", F.col("lat").alias("llat"), F.col("lng").alias("llng"))
    found = known_matches(spark, sf).join(marks, "landmark_id")
    centroid = w.table("parsed").select("order_id", "centroid_lat", "centroid_lng")
    placed = truth.join(found, "order_id", "left").join(centroid, "order_id", "left")
    at_landmark = F.col("llat").isNotNull()
    error = geo.haversine_m(
        F.coalesce("llat", "centroid_lat"), F.when(at_landmark, F.col("llng")).otherwise(F.col("centroid_lng")),
        F.col("true_lat"), F.col("true_lng"),
    )
    return H.learning_curve(placed.select("seen", F.col("landmark_id").isNotNull().alias("from_graph"), error.alias("error_m")))


# --- grid cells -------------------------------------------------------------

POINTS = "points as (select event_id, lat, lng, landmark_id from delivery)"


@job("with_grid_cell", "GE1", f"with {POINTS} select event_id, {sql.cell('lat','lng')} as cell from points")
def with_grid_cell(spark, sf):
    return placing.with_grid_cell(view(spark, sf, "delivery"), "lat", "lng").select("event_id", "cell")


@job(
    "cell_bounds", "GE2",
    f"""with {POINTS}, i as (select event_id, least(floor((lat-2.5E0)/(36.0E0/1048576)), 1048575) as i, least(floor((lng-63.5E0)/(36.0E0/1048576)), 1048575) as j from points)
    select event_id, round(2.5E0 + i*(36.0E0/1048576), 9) as min_lat, round(63.5E0 + j*(36.0E0/1048576), 9) as min_lng,
      round(2.5E0 + (i+1)*(36.0E0/1048576), 9) as max_lat, round(63.5E0 + (j+1)*(36.0E0/1048576), 9) as max_lng from i""",
)
def cell_bounds(spark, sf):
    rows = placing.cell_bounds(placing.with_grid_cell(view(spark, sf, "delivery"), "lat", "lng"), "cell")
    return rows.select("event_id", *[F.round(c, 9).alias(c) for c in ("min_lat", "min_lng", "max_lat", "max_lng")])


MESSY = "messy as (select event_id, case event_id % 4 when 0 then lower(c) when 1 then ' ' || substr(c,1,3) || '-' || substr(c,4,3) || '-' || substr(c,7,4) || ' ' when 2 then substr(c,1,9) else replace(c, '4', 'A') end as code from (select event_id, " + sql.cell("lat", "lng") + " as c from delivery))"


@job(
    "clean_cells", "GE3",
    f"""with {MESSY}, c as (select event_id, replace(replace(upper(trim(code)), '-', ''), ' ', '') as p from messy)
    select event_id, case when regexp_full_match(p, '[23456789CFJKLMPT]{{10}}') then p end as cell, case when regexp_full_match(p, '[23456789CFJKLMPT]{{10}}') then substr(p,1,3) || '-' || substr(p,4,3) || '-' || substr(p,7,4) end as display,
      regexp_full_match(p, '[23456789CFJKLMPT]{{10}}') as valid from c""",
)
def clean_cells(spark, sf):
    c = F.col("cell")
    rows = placing.with_grid_cell(view(spark, sf, "delivery"), "lat", "lng")
    code = (
        F.when(F.col("event_id") % 4 == 0, F.lower(c))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), geo.display_cell(c), F.lit(" ")))
        .when(F.col("event_id") % 4 == 2, F.substring(c, 1, 9))
        .otherwise(F.replace(c, F.lit("4"), F.lit("A")))
    )
    return placing.clean_cells(rows.select("event_id", code.alias("code")), "code").drop("code")


@job(
    "rollup_by_cell", "GE4",
    f"with {POINTS}, c as (select substr({sql.cell('lat','lng')},1,6) as cell_prefix, lat, lng from points) select cell_prefix, count(*) as points, round(avg(lat),9) as lat, round(avg(lng),9) as lng from c group by 1",
)
def rollup_by_cell(spark, sf):
    return placing.rollup_by_cell(placing.with_grid_cell(view(spark, sf, "delivery"), "lat", "lng"), "cell", "lat", "lng", 6)


@job(
    "dedupe_by_cell", "GE5",
    f"""with {POINTS}, c as (select event_id, {sql.cell('lat','lng')} as cell from points), n as (select cell, count(*) as rows_in_cell, min(event_id) as first_row from c group by 1 having count(*) > 1)
    select event_id, cell, rows_in_cell, first_row from c join n using (cell)""",
)
def dedupe_by_cell(spark, sf):
    rows = placing.with_grid_cell(view(spark, sf, "delivery"), "lat", "lng")
    return placing.dedupe_by_cell(rows, "event_id", "cell").select("event_id", "cell", "rows_in_cell", "first_row")


@job(
    "haversine_and_offset", "GE6 GE7 GE8 GE9",
    f"""with o as (select e.event_id, {sql.haversine('e.lat','e.lng','f.lat','f.lng')} as d, f.observation_count as obs, e.event_id % 4 as r, e.lat, e.lng from delivery e join office f on f.office_id = e.landmark_id)
    select event_id, round(d, 1) as distance_m, round(case when r >= 2 then lat + 40.0E0*cos(radians(90.0E0))/111320.0E0 else lat end, 9) as lat,
      round(case when r = 1 then lng + 25.0E0/(cos(radians(lat))*111320.0E0) when r >= 2 then lng + 40.0E0/(cos(radians(lat))*111320.0E0) else lng end, 9) as lng,
      round(1200 + least(1.0E0, ln(greatest(1, obs))/ln(30.0E0))*6800, 3) as centroid_accuracy_m, round(60*(1 + 2/sqrt(greatest(1, obs))) + case r when 0 then 120 when 1 then 25 else 40 end, 3) as landmark_accuracy_m from o""",
)
def haversine_and_offset(spark, sf):
    office = view(spark, sf, "office").select(
        F.col("office_id").alias("landmark_id"), F.col("lat").alias("olat"), F.col("lng").alias("olng"), "observation_count"
    )
    relation = F.get(F.array(*[F.lit(r) for r in ("inside", "beside", "behind", "opposite")]), (F.col("event_id") % 4).cast("int"))
    rows = view(spark, sf, "delivery").join(office, "landmark_id").withColumn("relation", relation)
    moved = geo.offset_point(F.col("lat"), F.col("lng"), geo.relation_offset_m(F.col("relation")), 90.0)
    return rows.select(
        "event_id",
        F.round(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("olat"), F.col("olng")), 1).alias("distance_m"),
        F.round(moved["lat"], 9).alias("lat"), F.round(moved["lng"], 9).alias("lng"),
        F.round(geo.centroid_accuracy_m(F.col("observation_count")), 3).alias("centroid_accuracy_m"),
        F.round(geo.landmark_accuracy_m(F.col("observation_count"), F.col("relation")), 3).alias("landmark_accuracy_m"),
    )


@job(
    "access_notes", "DO1",
    f"""with c as (select event_id, landmark_id, accuracy_m, {sql.cell('lat','lng')} as cell from delivery),
    notes as (select substr(cell,1,7) as area, event_id as note_id, cast(round(accuracy_m) as integer) % 9 as upvotes from c where event_id % 5 = 0),
    r as (select area, note_id, upvotes, row_number() over (partition by area order by upvotes desc, note_id) as rn from notes)
    select c.event_id, r.note_id, r.upvotes, cast(r.rn as integer) as rank from c join r on r.area = substr(c.cell,1,7) where r.rn <= 3""",
)
def access_notes(spark, sf):
    """The three best notes left at each resolution's cell."""
    from waymark.operators.compaction import notes_for_cells

    rows = placing.with_grid_cell(view(spark, sf, "delivery"), "lat", "lng").withColumn("area", F.substring("cell", 1, 7))
    notes = rows.where(F.col("event_id") % 5 == 0).select(
        "area", F.col("event_id").alias("note_id"), (F.round("accuracy_m").cast("int") % 9).alias("upvotes")
    )
    return notes_for_cells(rows.select("event_id", "area"), notes, "area", "event_id", 3)


@job(
    "compact_landmarks", "DO2",
    f"""with l as (select office_id, lower(office_name) as k, substr({sql.cell('lat','lng')},1,3) as prefix, lat, lng, observation_count as n from office where lat is not null)
    select k as name_key, prefix as cell_prefix, min(office_id) as landmark_id, count(*) as merged, cast(sum(n) as bigint) as observation_count,
      round(sum(lat*n)/sum(n), 6) as lat, round(sum(lng*n)/sum(n), 6) as lng from l group by 1, 2""",
)
def compact_landmarks(spark, sf):
    from waymark.operators.compaction import compact_landmarks as compact

    rows = placing.with_grid_cell(view(spark, sf, "office").where(F.col("lat").isNotNull()), "lat", "lng")
    return compact(
        rows.select(F.col("office_id").alias("landmark_id"), F.col("office_name").alias("canonical_name"), "cell", "lat", "lng", "observation_count"), 3
    )


@job("merge_landmarks", "DO2")
def merge_landmarks(spark, sf):
    """Offices of like names near one another as one landmark, whichever cells they stand in."""
    from waymark.operators.compaction import merge_landmarks as merge

    rows = view(spark, sf, "office").select(
        F.col("office_id").alias("landmark_id"), F.col("office_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"),
        "lat", "lng", F.col("observation_count").cast("int").alias("observation_count"),
    )
    return merge(rows, metres=600.0)


@job(
    "apply_answers", "DO3",
    """with a as (select order_id, raw, case when order_id % 4 = 0 then 'Answered Colony' end as locality, case when order_id % 6 = 0 then true_pincode end as pincode from address)
    select order_id, concat_ws(', ', raw, locality, pincode) as raw from a where locality is not null or pincode is not null""",
)
def apply_answers(spark, sf):
    from waymark.operators.compaction import with_answers

    orders = view(spark, sf, "address").select("order_id", "raw", "true_pincode")
    answers = orders.where((F.col("order_id") % 4 == 0) | (F.col("order_id") % 6 == 0)).select(
        "order_id", F.when(F.col("order_id") % 4 == 0, "Answered Colony").alias("locality"),
        F.when(F.col("order_id") % 6 == 0, F.col("true_pincode")).alias("pincode"),
    )
    return with_answers(orders.select("order_id", "raw"), answers)


# --- streams ----------------------------------------------------------------


def as_stream(df, name, files_per_batch=1000):
    """The rows of a job's input written as files and read back as a stream."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Rows that a file of a stream's input has at least, where a batch has several.
FILE_ROWS = 100_000


def arriving(df, name, ts="ts", tie="event_id", key=None):
    """Rows as a stream of micro-batches in the order they arrive: up to nine minutes after their time.

    A batch is a file, or as many files as all batches have rows for. The last batch is a row of no key, a day
    after all others, that only moves the watermark on.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    late = F.make_dt_interval(secs=F.pmod(F.xxhash64(tie), F.lit(540)))
    rows = staged(df.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("_at", F.col(ts) + late).where("_at is not null"), f"{name}-rows")
    part = F.least(F.floor((F.dayofmonth("_at") - 1) / 7), F.lit(3))
    sizes = [r["count"] for r in rows.groupBy(part).count().collect()]
    files = max(1, min([spark.sparkContext.defaultParallelism, *(n // FILE_ROWS for n in sizes)]))
    for i in range(4):
        now = rows.where(part == i).drop("_at")
        (now.coalesce(1) if files == 1 else now.repartition(files, tie)).write.mode("append").parquet(path)
    last = rows.agg(F.max(ts).alias(ts)).select(
        *[(F.col(ts) + F.expr("interval 1 day") if c == ts else F.lit(None).cast(t)).alias(c) for c, t in rows.drop("_at").dtypes]
    )
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("_at").schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream, name, mode="append"):
    """Run a stream over what is there and read what it wrote."""
    spark = stream.sparkSession
    root = scratch(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@job("stream_learn_landmarks", "SM1 SM2 SRC6", f"""with {FOLD} select event_id, landmark_id, cast(before_obs as integer) as before_observations, cast(obs as integer) as after_observations,
      case when rejected then 'too far' end as rejected, round(lat, 6) as lat, round(lng, 6) as lng from walk where n > 0
    union all select event_id, landmark_id, 0, 0, 'landmark not in graph', null, null from ev where landmark_id not in (select landmark_id from start)""")
def stream_learn_landmarks(spark, sf):
    audit = streams.learn_landmarks(arriving(deliveries(spark, sf), "deliveries"), known_landmarks(spark, sf))
    return drained(audit, "audit").where(F.col("landmark_id").isNotNull()).select(
        "event_id", "landmark_id", "before_observations", "after_observations", "rejected",
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"),
    )


@job(
    "stream_metric_windows", "SM4 SRC6",
    f"""with {METRIC_SQL}, w as (select *, time_bucket(interval 5 minutes, ts) as window_start from metrics)
    select window_start, stack, provider, count(*) as requests, {', '.join(f'round(avg({c}),6) as {c}' for c in RATE_COLUMNS)} from w
    where window_start + interval 15 minutes <= (select max(ts) from events) group by 1, 2, 3""",
)
def stream_metric_windows(spark, sf):
    """Windows the watermark has closed."""
    metrics = O.request_metrics(requests(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(streams.metric_windows(as_stream(metrics, "metrics")), "windows")
    return out.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "stack", "provider", "requests",
        *[F.round(c, 6).alias(c) for c in RATE_COLUMNS],
    )


@job(
    "stream_dedupe", "SM6 SRC6",
    f"with e as (select event_id, user_id, ts, true as stores from events), {ENTRIES.format(ttl='2 hours')} select user_id as cache_key, count(*) as kept from looked where not cache_hit group by 1",
)
def stream_dedupe(spark, sf):
    """Rows of each key that store an entry; most keys have several."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("cache_key"), "event_id", "ts")
    out = drained(streams.dedupe_resolutions(arriving(events, "resolutions"), "2 hours"), "deduped")
    return out.where(F.col("cache_key").isNotNull()).groupBy("cache_key").agg(F.count("*").alias("kept"))


@job(
    "stream_timeouts", "SM7 SRC6",
    """with e as (select * from events where event_type in ('error', 'purchase')),
    f as (select *, min(case when event_type = 'purchase' then ts end) over (partition by user_id order by ts desc, event_id desc rows between unbounded preceding and 1 preceding) as reply from e)
    select event_id, user_id, ts + interval 6 hours as due from f where event_type = 'error' and (reply is null or reply >= ts + interval 6 hours)""",
)
def stream_timeouts(spark, sf):
    """Questions that stay open for six hours, found by timers."""
    kind = F.col("event_type")
    events = table(spark, sf, "events").where(kind.isin("error", "purchase")).select(
        F.col("user_id").alias("order_id"), "event_id", "ts", (kind == "error").alias("question"), (kind == "purchase").alias("reply")
    )
    out = drained(streams.unanswered(arriving(events, "questions")), "timeouts").where(F.col("order_id").isNotNull())
    return out.select("event_id", F.col("order_id").alias("user_id"), F.col("due").cast("timestamp_ntz").alias("due"))


@job("stream_needs_info", "SM5 SRC6")
def stream_needs_info(spark, sf):
    """Unresolved addresses of the hybrid chain on their way to a question."""
    resolved = Warehouse(spark, sf).table("resolutions").select(
        "order_id", "status", "confidence", "devanagari", F.col("clarification.field").alias("asked_field"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(order_id % 24 as int))").alias("ts"),
    )
    cases = resolved.select(
        "order_id", (F.col("order_id") % 11 == 0).cast("int").alias("messages_sent"), (F.col("order_id") % 23 == 0).alias("opted_out")
    )
    return drained(streams.needs_info(as_stream(resolved, "resolved"), staged(cases, "cases")), "questions")


@job(
    "stream_upsert_sink", "SM8 SNK3",
    "select order_id, s.status as status, s.o_totalprice as price from (select o_custkey as order_id, arg_max({'status': o_orderstatus, 'o_totalprice': o_totalprice}, {'d': o_orderdate, 'k': o_orderkey}) as s from orders group by 1)",
)
def stream_upsert_sink(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("order_id"), "o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")
    )
    root = scratch(spark, "orders")
    late = rows.repartition(3, "o_orderkey")  # three micro-batches, in which an order's changes come in any order
    streams.upsert_sink(as_stream(late, "order_changes", files_per_batch=1), f"{root}/out", "order_id", ["o_orderdate", "o_orderkey"], f"{root}/state").awaitTermination()
    return streams.latest_snapshot(spark, f"{root}/out").select("order_id", "status", "price")
