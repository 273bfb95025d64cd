"""Jobs over the post-office directory: gazetteer, seeds, landmarks."""

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import gazetteer as G
from waymark.operators import seeds as S
from waymark.plans import sql
from waymark.plans.registry import job
from waymark.sources.fixtures import view
from waymark.sources.warehouse import Warehouse, reference_table, widened


def directory(spark, sf):
    return view(spark, sf, "directory")


@reference_table("seed_offices")
def _seed_offices(w):
    return G.delivery_offices(widened(directory(w.spark, w.sf_dir)))


@reference_table("nearby")
def _nearby(w):
    return S.nearby_landmarks(w.table("seed_offices"))


@reference_table("seeds")
def _seeds(w):
    return S.compose_seeds(w.table("seed_offices"), w.table("nearby"))


@reference_table("seed_places")
def _seed_places(w):
    return S.seed_places(w.table("seeds"), w.table("nearby"))


def seed_offices(spark, sf):
    return Warehouse(spark, sf).table("seed_offices")


@job("usable_offices", "GZ1", f"select line_no, trim(Pincode) as Pincode, OfficeName from directory where {sql.USABLE}")
def usable_offices(spark, sf):
    return G.usable_offices(directory(spark, sf)).select("line_no", "Pincode", "OfficeName")


@job(
    "clean_directory", "GZ2 GZ3 GZ4",
    f"with {sql.OFFICE_ROWS} select line_no, pincode, name, office_type, type_rank, district, state, lat, lng from office_rows",
)
def clean_directory(spark, sf):
    return G.office_rows(directory(spark, sf)).drop("delivery", "lat_text", "lng_text")


@job(
    "build_gazetteer", "GZ5",
    f"""with {sql.OFFICE_ROWS}
    select pincode, coalesce(min({{'r': type_rank, 'n': name}}) filter (where name <> '').n, '') as locality,
      arg_min(district, line_no) as district, arg_min(state, line_no) as state,
      round(median(lat),6) as lat, round(median(lng),6) as lng, cast(count(*) as integer) as office_count
    from office_rows group by pincode""".replace("min({'r': type_rank, 'n': name}) filter (where name <> '').n", "(min({'r': type_rank, 'n': name}) filter (where name <> '')).n"),
)
def build_gazetteer(spark, sf):
    return G.build_gazetteer(G.office_rows(directory(spark, sf)))


@job("build_locality_index", "GZ6 ST2", f"with {sql.OFFICE_ROWS} select distinct pincode, name as locality from office_rows where name <> ''")
def build_locality_index(spark, sf):
    return G.build_locality_index(G.office_rows(directory(spark, sf)))


@job(
    "build_stats", "GZ7",
    f"""with {sql.OFFICE_ROWS} select count(*) as rows_read, count(distinct pincode) as pincodes,
      (select count(*) from (select pincode from office_rows group by 1 having count(lat)=0)) as no_centroid,
      count(*) - count(lat) as bad_coordinates, (select count(*) from directory) - count(*) as rejected,
      count(distinct case when name <> '' then (pincode, name) end) as localities from office_rows""",
)
def build_stats(spark, sf):
    return G.build_stats(directory(spark, sf))


@job("delivery_offices", "GZ8 GZ9", f"with {sql.DELIVERY_OFFICES} select * from seed_offices")
def delivery_offices(spark, sf):
    return G.delivery_offices(directory(spark, sf))


BOUNDS = """bounds as (
  select state, min_lat - 0.5E0 as min_lat, min_lng - 0.5E0 as min_lng, max_lat + 0.5E0 as max_lat, max_lng + 0.5E0 as max_lng from (
    select state, count(*) as n, list_sort(list(lat))[1 + cast(floor(0.01E0*(count(*)-1)) as bigint)] as min_lat,
      list_sort(list(lng))[1 + cast(floor(0.01E0*(count(*)-1)) as bigint)] as min_lng,
      list_sort(list(lat))[1 + cast(floor(0.99E0*(count(*)-1)) as bigint)] as max_lat,
      list_sort(list(lng))[1 + cast(floor(0.99E0*(count(*)-1)) as bigint)] as max_lng
    from seed_offices group by state) where n >= 20)"""


@job(
    "state_bounds", "GZ10",
    f"""with {sql.DELIVERY_OFFICES}, {BOUNDS} select state, round(min_lat,6) as min_lat, round(min_lng,6) as min_lng,
    round(max_lat,6) as max_lat, round(max_lng,6) as max_lng from bounds""",
)
def state_bounds(spark, sf):
    b = G.state_bounds(seed_offices(spark, sf))
    return b.select("state", *[F.round(c, 6).alias(c) for c in ("min_lat", "min_lng", "max_lat", "max_lng")])


@job(
    "in_state_bounds", "GZ11",
    f"""with {sql.DELIVERY_OFFICES}, {BOUNDS} select o.* from seed_offices o left join bounds b on b.state = o.state
    where b.state is null or (o.lat between min_lat and max_lat and o.lng between min_lng and max_lng)""",
)
def in_state_bounds(spark, sf):
    offices = seed_offices(spark, sf)
    return G.in_state_bounds(offices, G.state_bounds(offices))


@job(
    "drop_district_outliers", "GZ12",
    f"""with {sql.DELIVERY_OFFICES},
    centre as (select state, district, median(lat) as clat, median(lng) as clng, count(*) as n from seed_offices group by 1,2),
    dist as (select o.*, n, {sql.haversine('clat','clng','o.lat','o.lng')} as d from seed_offices o join centre c on c.state=o.state and c.district=o.district),
    typical as (select state, district, median(d) as t from dist group by 1,2)
    select line_no, name, d.pincode, d.district, d.state, city, lat, lng, office_type
    from dist d join typical t on t.state=d.state and t.district=d.district where n < 10 or d <= greatest(25000.0, 5.0*t)""",
)
def drop_district_outliers(spark, sf):
    return G.drop_district_outliers(seed_offices(spark, sf))


@job("nearby_landmarks", "GZ13", f"with {sql.NEARBY} select * from nearby")
def nearby_landmarks(spark, sf):
    return S.nearby_landmarks(seed_offices(spark, sf))


@job(
    "sample_seeds", "GZ14 ST1",
    f"""with {sql.DELIVERY_OFFICES},
    draws as (select *, md5('20260917|' || pincode || '|' || name) as draw from seed_offices),
    one as (select * from (select *, row_number() over (partition by pincode order by draw, line_no) as rn from draws) where rn=1),
    turns as (select * exclude (rn), case city when 'New Delhi' then 0 when 'Bengaluru' then 2 end as ci from one),
    ranked as (select *, case when ci is null then 1 else 0 end as rest,
      case when ci is null then 0 else row_number() over (partition by ci order by draw, line_no) end as turn from turns)
    select line_no, name, pincode, district, state, city, lat, lng, office_type from ranked
    order by rest, turn, ci, draw, line_no limit 120""",
)
def sample_seeds(spark, sf):
    return S.sample_seeds(seed_offices(spark, sf))


SEEDS = sql.NEARBY + f""",
seed_rows as (
  select 'SEED#' || o.line_no as seed_id, o.line_no,
    array_to_string(list_filter([o.name || ' Post Office', 'near ' || n.name,
      case when city <> '' and lower(city) <> lower(o.name) then city end,
      case when state <> '' and lower(state) <> lower(city) then state end], lambda x: x is not null), ', ') || ' - ' || pincode as raw,
    case when n.name is null then 'postal' else 'landmark' end as shape,
    case when regexp_matches(o.name, '(?i)\\b(sector|phase)\\s*[:\\-]?\\s*([0-9]{{1,3}}\\s*[a-z]?|[ivx]{{1,4}})\\b') then 'x' end as sub_locality,
    o.name as locality, nullif(city,'') as city, nullif(district,'') as district, nullif(state,'') as state, pincode,
    round(o.lat,6) as lat, round(o.lng,6) as lng, {sql.cell('round(o.lat,6)', 'round(o.lng,6)')} as cell
  from seed_offices o left join nearby n on n.line_no = o.line_no and n.rank = 1)"""


@job("compose_seeds", "GZ15", f"with {SEEDS} select * from seed_rows")
def compose_seeds(spark, sf):
    w = Warehouse(spark, sf)
    return S.compose_seeds(w.table("seed_offices"), w.table("nearby"))


STATE_CODE = "case state when 'Delhi' then 'DL' when 'Karnataka' then 'KA' else 'IN' end"
LANDMARKS = SEEDS + f""",
place_rows as (
  select seed_id, line_no, 0 as ord, locality as name, lat, lng, pincode, state from seed_rows
  union all
  select s.seed_id, s.line_no, n.rank, n.name, n.true_lat, n.true_lng, s.pincode, s.state from nearby n join seed_rows s on s.line_no = n.line_no),
places as (
  select *, 'LMK#' || {STATE_CODE} || '#' || upper(sha256(lower(name) || '|' || cast(round(lat*100000.0E0) as bigint) || '|' || cast(round(lng*100000.0E0) as bigint))) as landmark_id
  from place_rows),
landmarks as (
  select landmark_id, b.name as canonical_name, b.lat as lat, b.lng as lng, b.pincode as pincode,
    {sql.cell('b.lat', 'b.lng')} as digipin_cell,
    case when regexp_matches(lower(b.name), 'mandir|temple|masjid|mosque|church|gurudwara|dargah') then 'religious'
      when regexp_matches(lower(b.name), 'hospital|clinic|nursing home|dispensary') then 'medical'
      when regexp_matches(lower(b.name), 'school|college|university|vidyalaya|institute') then 'education'
      when regexp_matches(lower(b.name), 'market|bazaar|bazar|mall|complex') then 'commercial'
      when regexp_matches(lower(b.name), 'station|railway|metro|bus stand|depot') then 'transport'
      when regexp_matches(lower(b.name), 'post office|police|court|bhawan|bhavan|office') then 'civic'
      when regexp_matches(lower(b.name), 'park|garden|ground|stadium') then 'open_space'
      when regexp_matches(lower(b.name), 'nagar|colony|vihar|puram|enclave|layout|sector') then 'locality' else 'unknown' end as type,
    other_names
  from (select landmark_id, arg_min({{'name': name, 'lat': lat, 'lng': lng, 'pincode': pincode}}, line_no*10 + ord) as b,
      count(distinct lower(name)) - 1 as other_names from places group by 1))"""


@job("build_landmarks", "GZ16 GZ17 ST1 ST3", f"with {LANDMARKS} select landmark_id, canonical_name, lat, lng, pincode, digipin_cell, type, other_names from landmarks")
def build_landmarks(spark, sf):
    built = S.build_landmarks(Warehouse(spark, sf).table("seed_places"))
    return built.withColumn("other_names", F.size("aliases").cast("long")).drop("aliases")


@job(
    "warm_observations", "GZ18",
    f"""with {LANDMARKS},
    corpus as (select 'SEED#' || (c_custkey % (select count(*) from part)) as seed_id from customer),
    per as (select seed_id, count(*) as n from corpus group by 1),
    seen as (select landmark_id, sum(n) as n from places p join per using (seed_id) group by 1)
    select l.landmark_id, cast(coalesce(s.n,1) as integer) as observation_count,
      round(least(0.95E0, 0.5E0 + 0.1E0*(coalesce(s.n,1)-1)),6) as confidence
    from landmarks l left join seen s using (landmark_id)""",
)
def warm_observations(spark, sf):
    corpus = view(spark, sf, "address").select(
        F.concat(F.lit("SEED#"), F.col("landmark_office_id").cast("string")).alias("seed_id")
    )
    return S.warm_observations(Warehouse(spark, sf).table("seed_places"), corpus)


@job(
    "landmark_stats", "GZ19",
    f"""with {LANDMARKS} select type, count(*) as landmarks, min(lat) as min_lat, max(lat) as max_lat, round(avg(lat),6) as mean_lat
    from landmarks group by 1""",
)
def landmark_stats(spark, sf):
    return (
        S.build_landmarks(Warehouse(spark, sf).table("seed_places"))
        .groupBy("type")
        .agg(
            F.count("*").alias("landmarks"),
            F.min("lat").alias("min_lat"),
            F.max("lat").alias("max_lat"),
            F.round(F.avg("lat"), 6).alias("mean_lat"),
        )
    )
