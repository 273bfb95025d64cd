"""Jobs over landmarks: search signals, fusion, matching, placing."""

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import decide as D
from waymark.operators import placing
from waymark.operators import retrieval as R
from waymark.operators import scoring as S
from waymark.operators.skew import each, salted_join
from waymark.plans import chain, sql
from waymark.plans.registry import job
from waymark.sources.fixtures import table, view
from waymark.sources.warehouse import Warehouse, reference_table, staged, widened


def offices(spark, sf):
    return view(spark, sf, "office")


@reference_table("landmarks")
def _landmarks(w):
    none = F.array().cast("array<string>")
    return view(w.spark, w.sf_dir, "office").where(F.col("lat").isNotNull()).select(
        F.lpad(F.col("office_id").cast("string"), 12, "0").alias("landmark_id"),
        F.col("office_name").alias("canonical_name"), none.alias("aliases"), "lat", "lng", "observation_count", "pincode",
    )


@reference_table("landmark_index")
def _landmark_index(w):
    return R.prepare_landmarks(widened(w.table("landmarks")))["landmarks"]


@reference_table("landmark_impacts")
def _landmark_impacts(w):
    return R.prepare_landmarks(widened(w.table("landmarks")))["impacts"]


def index(w):
    return {"landmarks": w.table("landmark_index"), "impacts": w.table("landmark_impacts")}


@reference_table("asked")
def _asked(w):
    normal = w.table("normalised").select("order_id", "retrieval_text")
    parsed = w.table("parsed").drop("retrieval_text").join(normal, "order_id")
    return chain.retrieval_queries(parsed.withColumns({c: F.lit(None).cast("double") for c in ("hint_lat", "hint_lng")}))


@reference_table("candidates")
def _candidates(w):
    asked = w.table("asked")
    queries = asked.groupBy("query_id").agg(
        *[F.first(c).alias(c) for c in ("query_text", "centre_id", "centre_lat", "centre_lng", "radius_m")]
    )
    return R.hybrid_retrieve(staged(queries, "searches"), index(w))


def per_order(w, rows):
    """Rows of each search, for every order that asked it."""
    return salted_join(w.table("asked").select("order_id", "query_id"), rows, ["query_id"], ["order_id"], "inner")


LANDMARK_SQL = "lm as (select lpad(cast(office_id as varchar),12,'0') as landmark_id, office_name as name, lat, lng, observation_count, pincode from office where lat is not null)"

POST_SQL = LANDMARK_SQL + r""",
tok as (select landmark_id, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) as term, len(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) as doc_len from lm),
post as (select landmark_id, term, count(*) as tf, any_value(doc_len) as doc_len from tok group by 1, 2),
stats as (select (select count(*) from lm) as n_docs, (select avg(len(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'))) from lm) as avg_len),
dfs as (select term, count(*) as df from post group by 1),
impact as (select p.landmark_id, p.term, ln(1 + (s.n_docs - d.df + 0.5E0)/(d.df + 0.5E0)) * p.tf * 2.2E0 / (p.tf + 1.2E0*(0.25E0 + 0.75E0*p.doc_len/s.avg_len)) as impact
  from post p join dfs d using (term) cross join stats s)"""

# the searches of every address: its phrase, its locality, its centre
ASKED_SQL = sql.AGREEMENT + r""",
phrase as (select order_id, array_to_string((string_split(trim(regexp_replace(regexp_extract(clean_text, '\b(behind|opposite|near) (.*)$', 2),
   '\b(district|pin|pincode|near|over|behind|opposite|block|floor|flat)\b.*$', '')), ' '))[:4], ' ') as phrase,
   regexp_extract(clean_text, '\b(behind|opposite|near) (.*)$', 1) as relation from phone_free),
asked as (select p.order_id, ph.phrase, ph.relation, a.matched_locality as locality, p.pincode, p.office_count,
  concat_ws(' ', ph.phrase, a.matched_locality) as query_text, p.centroid_lat as clat, p.centroid_lng as clng,
  case when p.centroid_lat is null then 3000.0E0 else greatest(3000.0E0, 2.5E0*(1200.0E0 + least(1.0E0, ln(greatest(1,p.office_count))/ln(30.0E0))*6800.0E0)) end as radius
  from placed p join phrase ph using (order_id) join agreement a using (order_id)),
""" + POST_SQL + f""",
reach as (select q.order_id, l.landmark_id, {sql.haversine('q.clat','q.clng','l.lat','l.lng')} as d, q.radius
  from asked q join lm l on l.lat between q.clat - 0.3 and q.clat + 0.3 and l.lng between q.clng - 0.4 and q.clng + 0.4),
near as (select * from reach where d <= radius),
pool as (select order_id, landmark_id from near union all select q.order_id, l.landmark_id from asked q cross join lm l where q.clat is null)"""

RANK_SQL = ASKED_SQL + r""",
qterm as (select order_id, term, count(*) as qtf from (select order_id, unnest(regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+')) as term from asked) group by 1, 2),
lex as (select c.order_id, c.landmark_id, round(sum(t.qtf * i.impact), 9) as score
  from pool c join qterm t using (order_id) join impact i on i.landmark_id = c.landmark_id and i.term = t.term group by 1, 2),
lexr as (select *, row_number() over (partition by order_id order by score desc, landmark_id) as rank from lex where score > 0),
texts as (select 'q' || order_id as id, query_text as t from asked union all select 'l' || landmark_id, name from lm union all select 'p' || order_id, phrase from asked union all select 'a' || order_id, locality from asked where locality is not null),
words as (select id, chr(2) || unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) || chr(3) as w from texts),
grams as (select id, unnest(list_transform(range(1, greatest(2, length(w) - 1)), lambda i: substr(w, i, 3))) as g from words),
gcount as (select id, g, count(*) as c from grams group by 1, 2),
gv as (select id, cast(('0x' || substr(md5(g),1,8)) as bigint) % 1024 as bucket, sum(case when substr(md5(g),9,1) in ('8','9','a','b','c','d','e','f') then 1.0E0 else -1.0E0 end * (1 + ln(c))) as v from gcount group by 1, 2),
norms as (select id, sqrt(sum(v*v)) as n from gv group by 1),
vec as (select id, bucket, v/n as w from gv join norms using (id) where v <> 0),
knn as (select c.order_id, c.landmark_id, round(sum(a.w*b.w), 9) as score from pool c
  join vec b on b.id = 'l' || c.landmark_id join vec a on a.id = 'q' || c.order_id and a.bucket = b.bucket group by 1, 2),
knnr as (select *, row_number() over (partition by order_id order by score desc, landmark_id) as rank from knn where score > 0),
geor as (select order_id, landmark_id, d, row_number() over (partition by order_id order by d, landmark_id) as rank from near),
ranks as (select order_id, 'bm25' as signal, landmark_id, rank, 1.0E0 as weight from lexr where rank <= 20
  union all select order_id, 'knn', landmark_id, rank, 1.0E0 from knnr where rank <= 20
  union all select order_id, 'geo', landmark_id, rank, 0.5E0 from geor where rank <= 20),
fused as (select order_id, landmark_id, round(sum(weight/(60 + rank)), 12) as rrf_score, count(*) as n_signals,
  string_agg(signal || ':' || rank, ',' order by signal) as signals from ranks group by 1, 2),
cand as (select *, row_number() over (partition by order_id order by rrf_score desc, n_signals desc, landmark_id) as position from fused)"""


@job("postings", "RT1 RT2", f"""with {POST_SQL} select p.landmark_id, p.term, p.tf, p.doc_len, d.df, s.n_docs, round(s.avg_len,6) as avg_len from post p join dfs d using (term) cross join stats s""")
def postings(spark, sf):
    docs = Warehouse(spark, sf).table("landmarks")
    post = R.postings(docs, "landmark_id", "canonical_name")
    stats = R.corpus_stats(docs, "canonical_name")
    df = R.document_frequencies(post)
    return post.join(df, "term").select(
        "landmark_id", "term", "tf", F.col("doc_len").cast("long"), "df",
        stats.select("n_docs").scalar().alias("n_docs"), F.round(stats.select("avg_len").scalar(), 6).alias("avg_len"),
    )


@job(
    "bm25_documents", "RT3 RT8",
    r"""with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\x{0900}-\x{097F}]+')) as term from documents),
    post as (select doc_id, term, count(*) as tf from tok group by 1, 2),
    lens as (select doc_id, count(*) as doc_len from tok group by 1),
    s as (select (select count(*) from documents) as n, (select sum(doc_len) from lens) * 1.0E0 / (select count(*) from documents) as al),
    dfs as (select term, count(*) as df from post group by 1),
    q as (select item_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\x{0900}-\x{097F}]+')) as term from benchmark) group by 1, 2),
    sc as (select item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5E0)/(df + 0.5E0)) * tf * 2.2E0 / (tf + 1.2E0*(0.25E0 + 0.75E0*doc_len/al))), 9) as score
      from q join post using (term) join dfs using (term) join lens using (doc_id) cross join s group by 1, 2)
    select item_id, doc_id, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from sc) where rank <= 20""",
)
def bm25_documents(spark, sf):
    scored = R.bm25(table(spark, sf, "benchmark"), widened(table(spark, sf, "documents").select("doc_id", "text")), "item_id", "doc_id")
    return scored.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


EMBED_SQL = POST_SQL + r""",
words as (select landmark_id, chr(2) || unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) || chr(3) as w from lm),
grams as (select landmark_id, unnest(list_transform(range(1, greatest(2, length(w) - 1)), lambda i: substr(w, i, 3))) as g from words),
gcount as (select landmark_id, g, count(*) as c from grams group by 1, 2),
gv as (select landmark_id, cast(cast(('0x' || substr(md5(g),1,8)) as bigint) % 1024 as integer) as bucket, sum(case when substr(md5(g),9,1) in ('8','9','a','b','c','d','e','f') then 1.0E0 else -1.0E0 end * (1 + ln(c))) as v from gcount group by 1, 2),
norms as (select landmark_id, sqrt(sum(v*v)) as n from gv group by 1)"""
EMBED_SELECT = "select landmark_id, bucket, round(v/n, 6) as w from gv join norms using (landmark_id) where v <> 0"


@job("embed_trigrams", "RT4", f"with {EMBED_SQL} {EMBED_SELECT}")
def embed_trigrams(spark, sf):
    rows = R.embed_trigrams(Warehouse(spark, sf).table("landmarks"), "landmark_id", "canonical_name")
    return rows.select("landmark_id", "bucket", F.round("w", 6).alias("w"))


@job("embed_names", "RT4 RT5", f"with {EMBED_SQL} {EMBED_SELECT}")
def embed_names(spark, sf):
    """The in-row form, with a repeated spelling that must not count twice."""
    docs = Warehouse(spark, sf).table("landmarks").withColumn("aliases", F.array(F.upper("canonical_name")))
    docs = docs.withColumn("t", R.embedding_text(F.col("canonical_name"), F.col("aliases")))
    return each(R.with_name_vector(docs, "t"), ["landmark_id"], F.col("vector"), "bucket", "w").select(
        "landmark_id", "bucket", F.round("w", 6).alias("w")
    )


@job(
    "geo_radius_join", "JN9 JN11 RT7",
    f"""with {ASKED_SQL}, c as (select distinct round(clat,6) as lat, round(clng,6) as lng, round(radius,3) as radius, landmark_id, round(d,1) as distance_m from near join asked using (order_id, radius)),
    r as (select *, row_number() over (partition by lat, lng order by distance_m, landmark_id) as rank from c)
    select lat, lng, radius, landmark_id, distance_m from c""",
)
def geo_radius_join(spark, sf):
    w = Warehouse(spark, sf)
    centres = w.table("asked").where(F.col("centre_id").isNotNull()).select("centre_id", "centre_lat", "centre_lng", "radius_m").distinct()
    near = R.geo_radius_join(centres, w.table("landmarks"), "landmark_id")
    return near.join(centres.drop("radius_m"), "centre_id").select(
        F.round("centre_lat", 6).alias("lat"), F.round("centre_lng", 6).alias("lng"), F.round("radius_m", 3).alias("radius"),
        "landmark_id", F.round("distance_m", 1).alias("distance_m"),
    )


@job("geo_rank", "RT7 RT8", f"with {RANK_SQL} select order_id, landmark_id, round(1 - least(1.0E0, g.d/n.radius), 6) as score, cast(g.rank as integer) as rank from geor g join near n using (order_id, landmark_id) where g.rank <= 20")
def geo_rank(spark, sf):
    w = Warehouse(spark, sf)
    asked = w.table("asked").where(F.col("centre_id").isNotNull())
    centres = asked.select("centre_id", "centre_lat", "centre_lng", "radius_m").distinct()
    ranked = R.geo_rank(R.geo_radius_join(centres, w.table("landmarks"), "landmark_id"))
    return salted_join(asked.select("order_id", "centre_id"), ranked, ["centre_id"], ["order_id"], "inner").select(
        "order_id", "landmark_id", F.round("score", 6).alias("score"), "rank"
    )


@job(
    "query_text", "RT11 JN11",
    f"with {ASKED_SQL} select order_id, lower(query_text) as query_text, round(radius, 3) as radius_m, clat is not null as has_centre from asked",
)
def query_text(spark, sf):
    return Warehouse(spark, sf).table("asked").select(
        "order_id", F.lower("query_text").alias("query_text"), F.round("radius_m", 3).alias("radius_m"),
        F.col("centre_id").isNotNull().alias("has_centre"),
    )


@job(
    "hybrid_retrieve", "RT6 RT9 RT10 RT12 ST1",
    f"""with {RANK_SQL}, used as (select order_id, count(distinct signal) as n from ranks group by 1)
    select order_id, landmark_id, round(rrf_score, 9) as rrf_score, n_signals, signals, cast(position as integer) as position,
      round(greatest(0, least(1.0E0, rrf_score / (u.n / 61.0E0))), 6) as normalised from cand join used u using (order_id)""",
)
def hybrid_retrieve(spark, sf):
    w = Warehouse(spark, sf)
    signals = F.array_join(
        F.transform(F.array_sort(F.map_entries("signals")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","
    )
    return per_order(w, w.table("candidates")).select(
        "order_id", "landmark_id", F.round("rrf_score", 9).alias("rrf_score"), "n_signals", signals.alias("signals"), "position",
        F.round(R.normalise_rrf(F.col("rrf_score"), F.col("signals_used")), 6).alias("normalised"),
    )


@job("candidates_to_model", "RT16", f"with {RANK_SQL} select order_id, landmark_id, cast(position as integer) as position from cand where position <= 8")
def candidates_to_model(spark, sf):
    w = Warehouse(spark, sf)
    return per_order(
        w, w.table("candidates").where(F.col("position") <= 8).select("query_id", "landmark_id", "position")
    ).drop("query_id")


AFFINITY_SQL = RANK_SQL + r""",
phrases as (select order_id, 0 as pos, phrase as t, 'p' || order_id as id from asked union all select order_id, -1, locality, 'a' || order_id from asked where locality is not null),
dots as (select c.order_id, p.pos, c.landmark_id, sum(a.w*b.w) as dot from cand c join phrases p using (order_id) join vec b on b.id = 'l' || c.landmark_id join vec a on a.id = p.id and a.bucket = b.bucket group by 1, 2, 3),
aff as (select c.order_id, p.pos, c.landmark_id, c.position, c.rrf_score, l.lat, l.lng, l.name, l.observation_count,
  round(greatest(coalesce(len(list_intersect(list_distinct(string_split(lower(p.t),' ')), list_distinct(string_split(lower(l.name),' ')))) * 1.0E0
    / len(list_distinct(list_concat(string_split(lower(p.t),' '), string_split(lower(l.name),' ')))), 0), 0.85E0*greatest(0, least(1.0E0, coalesce(d.dot, 0)))), 9) as affinity
  from cand c join phrases p using (order_id) join lm l using (landmark_id) left join dots d on d.order_id = c.order_id and d.pos = p.pos and d.landmark_id = c.landmark_id)"""


def pairs(w):
    """Affinities of every phrase, with its candidate."""
    asked = w.table("asked")
    queries = asked.groupBy("query_id").agg(F.first("landmarks").alias("landmarks"), F.first("locality").alias("locality"))
    phrases = each(
        queries, ["query_id"], F.transform("landmarks", lambda l: l["name"]), "phrase", position="phrase_pos"
    ).unionByName(
        queries.where(F.col("locality").isNotNull()).select("query_id", F.lit(-1).alias("phrase_pos"), F.col("locality").alias("phrase"))
    )
    return R.phrase_pairs(w.table("candidates"), phrases)


@reference_table("pairs")
def _pairs(w):
    return pairs(w)


@job("name_affinity", "RT13", f"with {AFFINITY_SQL} select order_id, pos, landmark_id, round(affinity, 6) as affinity from aff")
def name_affinity(spark, sf):
    w = Warehouse(spark, sf)
    return per_order(w, pairs(w)).select(
        "order_id", F.col("phrase_pos").alias("pos"), "landmark_id", F.round("affinity", 6).alias("affinity")
    )


MATCH_SQL = AFFINITY_SQL + """,
used as (select order_id, count(distinct signal) as n from ranks group by 1),
top as (select order_id, rrf_score as top_rrf, greatest(0, least(1.0E0, rrf_score/(n/61.0E0))) as top_score from cand join used using (order_id) where position = 1),
best as (select * from (select *, row_number() over (partition by order_id, pos order by affinity desc, landmark_id) as rn from aff where affinity >= 0.35) where rn = 1)"""


@job(
    "greedy_match", "RT14 RT15 JN8",
    f"""with {MATCH_SQL} select order_id, pos, landmark_id, round(affinity,6) as affinity,
      round(least(1.0E0, rrf_score/top_rrf*top_score*affinity), 4) as match_score from best join top using (order_id)""",
)
def greedy_match(spark, sf):
    w = Warehouse(spark, sf)
    p = w.table("pairs")
    scores = p.select("query_id", "landmark_id", "rrf_score", "signals_used").distinct()
    top = w.table("candidates").where(F.col("position") == 1).select(
        "query_id", F.col("rrf_score").alias("top_rrf"), R.normalise_rrf(F.col("rrf_score"), F.col("signals_used")).alias("top_score")
    )
    taken = R.greedy_match(p.where("phrase_pos >= 0"), "query_id").unionByName(R.greedy_match(p.where("phrase_pos < 0"), "query_id"))
    matched = taken.join(scores, ["query_id", "landmark_id"]).join(top, "query_id")
    return per_order(w, matched).select(
        "order_id", F.col("phrase_pos").alias("pos"), "landmark_id", F.round("affinity", 6).alias("affinity"),
        F.round(R.match_score(F.col("rrf_score"), F.col("top_rrf"), F.col("top_score"), F.col("affinity")), 4).alias("match_score"),
    )


@job(
    "candidate_separation", "SC3",
    f"""with {RANK_SQL}, b as (select order_id, lat as blat, lng as blng from cand join lm using (landmark_id) where position = 1),
    d as (select order_id, count(*) as n, max(case when position=1 then rrf_score end) - max(case when position=2 then rrf_score end) as gap,
      max({sql.haversine('blat','blng','l.lat','l.lng')}) as spread from cand join lm l using (landmark_id) join b using (order_id) group by 1)
    select order_id, n as n_candidates, round(spread,1) as spread_m, round(case when n < 2 then 1.0E0 when gap >= 0.05 then 1.0E0 when spread <= 500 then 0.8E0 else greatest(0.0E0, gap/0.05E0) end, 6) as separation from d""",
)
def candidate_separation(spark, sf):
    w = Warehouse(spark, sf)
    sep = S.candidate_separation(w.table("candidates"), "query_id")
    return per_order(w, sep).select(
        "order_id", "n_candidates", F.round("spread_m", 1).alias("spread_m"), F.round("separation", 6).alias("separation")
    )


@job(
    "find_ambiguity", "DC1",
    f"""with {AFFINITY_SQL}, a as (select order_id, landmark_id, any_value(rrf_score) as rrf, any_value(lat) as lat, any_value(lng) as lng, max(affinity) as affinity from aff group by 1, 2),
    r as (select *, row_number() over w as rn, first_value(landmark_id) over w as bid, first_value(affinity) over w as baff, first_value(lat) over w as blat, first_value(lng) over w as blng
      from a where affinity >= 0.35 window w as (partition by order_id order by affinity desc, rrf desc, landmark_id)),
    f as (select *, row_number() over (partition by order_id order by rn) as k from r where rn > 1 and round(baff - affinity, 9) <= 0.10 and {sql.haversine('blat','blng','lat','lng')} >= 500)
    select order_id, bid as best_id, landmark_id as rival_id from f where k = 1""",
)
def find_ambiguity(spark, sf):
    w = Warehouse(spark, sf)
    c = w.table("pairs").groupBy("query_id", "landmark_id").agg(
        F.max("affinity").alias("affinity"), F.first("rrf_score").alias("rrf_score"), F.first("lat").alias("lat"), F.first("lng").alias("lng")
    )
    return per_order(w, D.find_ambiguity(c, "query_id")).select(
        "order_id", F.col("best.landmark_id").alias("best_id"), F.col("rival.landmark_id").alias("rival_id")
    )


def calibrated(raw):
    """Piecewise-linear map of the stored knots."""
    from waymark.functions.tables import CALIBRATION_KNOTS as K

    parts = [f"when {raw} <= {K[0][0]}E0 then {K[0][1]}E0", f"when {raw} >= {K[-1][0]}E0 then {K[-1][1]}E0"]
    for (x0, y0), (x1, y1) in zip(K, K[1:]):
        parts.append(f"when {raw} <= {x1}E0 then {y0}E0 + ({raw} - {x0}E0)/({x1}E0 - {x0}E0)*({y1}E0 - {y0}E0)")
    return f"case {' '.join(parts)} end"


def outcome(features, lat, lng, source, accuracy, anchor, rival, raw_from, pick="select * from outcomes"):
    return f"""
    scored as (select *, {features} as raw from {raw_from}),
    final as (select *, {calibrated('raw')} as conf, {rival} as has_rival from scored),
    outcomes as (select order_id, case when has_rival then 'AMBIGUOUS' when conf >= 0.8 then 'RESOLVED' else 'NEEDS_INFO' end as status,
      round(conf,6) as confidence, round(raw,6) as raw_confidence, building, locality, city, district, state, pincode,
      {sql.cell(lat, lng)} as digipin, {anchor} as anchor_id, {source} as geo_source, round({lat},6) as lat, round({lng},6) as lng, round({accuracy},1) as accuracy_m,
      case when not has_rival and conf < 0.8 then case when locality is null then 'locality' when pincode is null then 'pincode' when building is null then 'building' else 'geo_confirm' end end as asked_field,
      case when has_rival then 2 else 0 end as n_alternatives from final) {pick}"""


CITY_SQL = """cities as (select distinct district as city, lower(district) as k from gaz),
in_text as (select order_id, max({'n': length(k), 'k': k, 'c': city}).c as city from phone_free join cities
   on contains(' ' || regexp_replace(clean_text, '[^a-z0-9_]', ' ', 'g') || ' ', ' ' || k || ' ') group by 1)"""
FIELDS_SQL = f"""fields as (select p.order_id, {sql.unit('p.clean_text')} as building, {sql.title('a.matched_locality')} as locality,
  case when p.district is not null then p.district else t.city end as city, p.district, p.pincode_state as state, p.pincode, a.locality_agrees,
  round(p.centroid_lat,6) as centroid_lat, round(p.centroid_lng,6) as centroid_lng, p.office_count
  from placed p join agreement a using (order_id) left join in_text t using (order_id))"""
BASE = """(0.22E0*least(1.0E0, (case when building is not null then 0.28E0 else 0 end + case when locality is not null then 0.2E0 else 0 end + case when pincode is not null then 0.18E0 else 0 end
  + case when city is not null then 0.08E0 else 0 end + case when district is not null then 0.03E0 else 0 end + case when state is not null then 0.03E0 else 0 end))
  + 0.2E0*(case when locality_agrees then 1.0E0 when not locality_agrees then 0.35E0 else 0.5E0 end) + 0.06E0*0.5E0"""
CENTROID_ACC = "(1200.0E0 + least(1.0E0, ln(greatest(1,office_count))/ln(30.0E0))*6800.0E0)"
NO_PIN = "(case when pincode is null then 0.75E0 else 1.0E0 end)"

RULES_SQL = f"""with {sql.AGREEMENT}, {CITY_SQL}, {FIELDS_SQL},""" + outcome(
    BASE + f" + 0.2E0*(case when centroid_lat is not null then 0.3E0 else 0 end) + 0.08E0) * {NO_PIN}",
    "centroid_lat", "centroid_lng", "case when centroid_lat is not null then 'pincode_centroid' end",
    f"case when centroid_lat is not null then {CENTROID_ACC} end", "cast(null as varchar)", "false", "fields",
)

HINT_LAT = "case when p.order_id % 2 = 0 then p.true_lat + (p.order_id % 7 - 3)/1000.0E0 end"
HINT_LNG = "case when p.order_id % 2 = 0 then p.true_lng + (p.order_id % 5 - 2)/1000.0E0 end"
RESPONSE = """case when order_id % 3 = 0 then null when order_id % 10 = 1 then 'no json here' else
  concat('{"sub_locality": "Sector 9", "building": "B", "landmarks": [{"name": "Shiv Mandir", "relation": "behind", "matched_id": "',
    lpad(cast(landmark_office_id as string), 12, '0'), '"}], "field_confidence": {"building": 0.9, "city": 0.5}, "alternatives": [',
    case when order_id % 9 = 4 then '{"reason": "two readings", "fields": {"city": "Pune"}}' else '' end, ']}') end"""


VECTOR_AND_GEO = """
  union all select order_id, 'knn', landmark_id, rank, 1.0E0 from knnr where rank <= 20
  union all select order_id, 'geo', landmark_id, rank, 0.5E0 from geor where rank <= 20"""
assert VECTOR_AND_GEO in RANK_SQL


def hybrid_sql(responded=False, hinted=False, pick="select * from outcomes", lexical=False):
    """The whole hybrid chain: with stored responses for some orders, with GPS hints for some, or by words alone."""
    match = MATCH_SQL
    if lexical:
        match = match.replace(VECTOR_AND_GEO, "")
    if hinted:
        match = match.replace(
            "p.centroid_lat as clat, p.centroid_lng as clng", f"coalesce({HINT_LAT}, p.centroid_lat) as clat, coalesce({HINT_LNG}, p.centroid_lng) as clng"
        ).replace("when p.centroid_lat is null then 3000.0E0", f"when p.centroid_lat is null or {HINT_LAT} is not null then 3000.0E0")
    given, readable = ("f.order_id % 3 <> 0", "(f.order_id % 3 <> 0 and f.order_id % 10 <> 1)") if responded else ("false", "false")
    return f"""with {match}, {CITY_SQL}, {FIELDS_SQL},
a1 as (select order_id, landmark_id, any_value(rrf_score) as rrf, any_value(lat) as lat, any_value(lng) as lng, max(affinity) as affinity from aff group by 1, 2),
r1 as (select *, row_number() over w as rn, first_value(affinity) over w as baff, first_value(lat) over w as blat, first_value(lng) over w as blng
  from a1 where affinity >= 0.35 window w as (partition by order_id order by affinity desc, rrf desc, landmark_id)),
rivals as (select distinct order_id from r1 where rn > 1 and round(baff - affinity, 9) <= 0.10 and {sql.haversine('blat','blng','lat','lng')} >= 500),
b1 as (select order_id, lat as blat, lng as blng, observation_count as best_obs from cand join lm using (landmark_id) where position = 1),
d1 as (select order_id, count(*) as nc, max(case when position=1 then rrf_score end) - max(case when position=2 then rrf_score end) as gap,
  max({sql.haversine('blat','blng','l.lat','l.lng')}) as spread, any_value(best_obs) as best_obs from cand join lm l using (landmark_id) join b1 using (order_id) group by 1),
anchors as (select * from best where pos = -1),
own as (select order_id, lpad(cast(landmark_office_id as varchar), 12, '0') as landmark_id from address),
claims as (select f.order_id, lat, lng, observation_count, 'behind' as relation from own f join cand using (order_id, landmark_id) join lm using (landmark_id) where position <= 8 and {readable}),
firsts as (select f.order_id, f.lat, f.lng, f.observation_count, k.relation from best f join asked k using (order_id) where pos = 0 and not {given}
  union all select * from claims),
joined as (select f.*, t.top_score, d.best_obs, d.nc, case when d.nc < 2 then 1.0E0 when d.gap >= 0.05 then 1.0E0 when d.spread <= 500 then 0.8E0 else greatest(0.0E0, d.gap/0.05E0) end as sep,
  an.landmark_id as anchor_id, coalesce(an.lat, fi.lat) as llat, coalesce(an.lng, fi.lng) as llng, coalesce(an.observation_count, fi.observation_count) as lobs,
  case when an.landmark_id is null and fi.relation in ('behind','opposite') then 40.0E0 else 0.0E0 end as off, k.clat,
  rv.order_id is not null or ({readable} and f.order_id % 9 = 4) as rival, {readable} as readable, {given} and not {readable} as failed
  from fields f join asked k using (order_id) left join top t using (order_id) left join d1 d using (order_id)
  left join anchors an using (order_id) left join firsts fi using (order_id) left join rivals rv using (order_id)),
located as (select *, case when llat is not null then round(case when off <> 0 then llat + off/111320.0E0 else llat end, 6) else centroid_lat end as plat,
  case when llat is not null then round(llng, 6) else centroid_lng end as plng,
  case when llat is not null then 60.0E0*(1 + 2.0E0/sqrt(greatest(1,lobs))) + case when anchor_id is not null then 120.0E0 else 0 end + off when centroid_lat is not null then {CENTROID_ACC} end as pacc,
  case when llat is not null then 'landmark_graph' when centroid_lat is not null then 'pincode_centroid' end as psource from joined),""" + outcome(
        BASE + f""" + case when readable then 0.06E0*0.2E0 + 0.22E0*0.12E0 else 0 end
      + 0.2E0*(case psource when 'landmark_graph' then 1.0E0 when 'pincode_centroid' then 0.3E0 else 0 end)
      + case when nc > 0 then 0.16E0*top_score + 0.08E0*least(1.0E0, ln(1.0E0+best_obs)/ln(51.0E0)) + 0.08E0*sep else 0.08E0 end)
      * {NO_PIN} * (case when clat is null and {not lexical} then 0.92E0 else 1.0E0 end) * (case when failed then 0.6E0 else 1.0E0 end)""",
        "plat", "plng", "psource", "pacc", "anchor_id", "rival", "located", pick,
    )


HYBRID_SQL = hybrid_sql()


@job("resolve_rules_only", "EV10 DC2 SC1 SC4 SC5 SC6 CA2", RULES_SQL)
def resolve_rules_only(spark, sf):
    return flat(resolve_config(spark, sf, "A"))


@job("resolve_lexical", "EV10 RT12", hybrid_sql(lexical=True))
def resolve_lexical(spark, sf):
    return flat(resolve_config(spark, sf, "R1"))


@job("resolve_hybrid", "RT12 DC2 DC3 SC2 SC4 SC5 SC6 CA2 GE9 GE10 GE11", HYBRID_SQL)
def resolve_hybrid(spark, sf):
    """Raw address text to placed, scored and decided resolutions."""
    return flat(resolve_config(spark, sf, "R2"))


def request_rows(spark, sf, *more):
    return view(spark, sf, "address").alias("p").select("order_id", "raw", *more)


def resolve_requests(spark, sf, requests, config="R2", **more):
    w = Warehouse(spark, sf)
    return chain.resolve(requests, w.table("gazetteer"), w.table("localities"), index(w) if config != "A" else None, config, **more)


@job("resolve_with_hints", "RT12 JN11 PR13 EV10", hybrid_sql(hinted=True, pick="select * from outcomes where order_id % 50 <> 8"))
def resolve_with_hints(spark, sf):
    """Every other request comes with a GPS hint; some hints lie off the globe and are quarantined."""
    lat = F.when(F.col("order_id") % 50 == 8, 95.0).otherwise(F.expr(HINT_LAT)).alias("hint_lat")
    lng = F.when(F.col("order_id") % 50 == 8, 77.0).otherwise(F.expr(HINT_LNG)).alias("hint_lng")
    return flat(resolve_requests(spark, sf, request_rows(spark, sf, lat, lng)))


@job("resolve_with_responses", "PR15 PR16 PR17 JN8 DC1 SC6 EV10", hybrid_sql(responded=True))
def resolve_with_responses(spark, sf):
    """Two of three requests come with a stored model response, some of them not readable."""
    return flat(resolve_requests(spark, sf, request_rows(spark, sf, F.expr(RESPONSE.replace("\n", " ")).alias("response"))))


# even orders were resolved before; every fourth comes again as it was, the other even ones with a word in front
CACHED_SQL = hybrid_sql(pick="""select order_id, cache_level, status, confidence, pincode from answered""").replace(
    ") select order_id, cache_level", """),
cached_texts as (select text, min(order_id) as order_id from normal join outcomes using (order_id) where order_id % 2 = 0 and status = 'RESOLVED' group by 1),
entries as (select sha256(text) as cache_key, text, o.* from cached_texts join outcomes o using (order_id)),
again as (select order_id, case when order_id % 4 = 2 then 'a ' || text else text end as text, c.g.pincode as pin
  from normal left join chosen c using (order_id)),
exact as (select a.order_id, 'exact' as cache_level, e.status, e.confidence, e.pincode from again a join entries e using (text)),
npool as (select 'a' || order_id as id, text as t from again where order_id not in (select order_id from exact) union all select 'e' || cache_key, text from entries),
nwords as (select id, chr(2) || unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) || chr(3) as w from npool),
ngrams as (select id, unnest(list_transform(range(1, greatest(2, length(w) - 1)), lambda i: substr(w, i, 3))) as g from nwords),
ncount as (select id, g, count(*) as c from ngrams group by 1, 2),
ngv as (select id, cast(('0x' || substr(md5(g),1,8)) as bigint) % 1024 as bucket, sum(case when substr(md5(g),9,1) in ('8','9','a','b','c','d','e','f') then 1.0E0 else -1.0E0 end * (1 + ln(c))) as v from ncount group by 1, 2),
nnorm as (select id, sqrt(sum(v*v)) as n from ngv group by 1),
nvec as (select id, bucket, v/n as w from ngv join nnorm using (id)),
ndots as (select a.order_id, e.cache_key, round(sum(x.w*y.w), 9) as cosine from again a join entries e on coalesce(a.pin, '') = coalesce(e.pincode, '')
  join nvec x on x.id = 'a' || a.order_id join nvec y on y.id = 'e' || e.cache_key and y.bucket = x.bucket group by 1, 2),
nearest as (select order_id, min({'m': -cosine, 'k': cache_key}).k as cache_key from ndots where cosine >= 0.97 group by 1),
answered as (select * from exact union all select n.order_id, 'near_duplicate', e.status, e.confidence, e.pincode from nearest n join entries e using (cache_key)
  union all select order_id, null, null, null, null from again where order_id not in (select order_id from exact) and order_id not in (select order_id from nearest))
    select order_id, cache_level""")


@job("resolve_cached", "RT12 JN13 JN10 EV13", CACHED_SQL)
def resolve_cached(spark, sf):
    """Requests of which some were resolved before, word for word or nearly so."""
    w = Warehouse(spark, sf)
    before = w.table("resolutions").where("order_id % 2 = 0")
    entries = staged(chain.cache_entries(request_rows(spark, sf), before), "cache-entries")
    again = request_rows(spark, sf).withColumn("raw", F.when(F.col("order_id") % 4 == 2, F.concat(F.lit("a "), "raw")).otherwise(F.col("raw")))
    rows = resolve_requests(spark, sf, again, "A", entries=entries)
    known = lambda c: F.when(F.col("cached"), c)
    return rows.select("order_id", "cache_level", known(F.col("status")).alias("status"), known(F.round("confidence", 6)).alias("confidence"), known(F.col("pincode")).alias("pincode"))


@job("evidence", "DC4")
def evidence(spark, sf):
    w = Warehouse(spark, sf)
    return w.table("resolutions").select("order_id", "status", F.array_join("evidence", "; ").alias("evidence"))


@job(
    "resolution_invariants", "DQ1 ST4",
    "select 0 as unasked, 0 as single_option, 0 as cell_without_point, 0 as score_without_match, count(*) as rows from customer",
)
def resolution_invariants(spark, sf):
    from waymark.operators.evaluate import resolution_violations

    return resolution_violations(Warehouse(spark, sf).table("resolutions"))


def resolve_config(spark, sf, config):
    w = Warehouse(spark, sf)
    return chain.resolve(view(spark, sf, "address"), w.table("gazetteer"), w.table("localities"), index(w) if config != "A" else None, config)


@reference_table("resolutions")
def _resolutions(w):
    return resolve_config(w.spark, w.sf_dir, "R2")


@reference_table("resolutions_lexical")
def _resolutions_lexical(w):
    return resolve_config(w.spark, w.sf_dir, "R1")


@reference_table("resolutions_rules")
def _resolutions_rules(w):
    return resolve_config(w.spark, w.sf_dir, "A")


def flat(df):
    """A resolution without nested columns."""
    return df.select(
        "order_id", "status", F.round("confidence", 6).alias("confidence"), F.round("raw_confidence", 6).alias("raw_confidence"),
        "building", "locality", "city", "district", "state", "pincode", "digipin", "anchor_id",
        F.col("geo.source").alias("geo_source"), F.round("geo.lat", 6).alias("lat"), F.round("geo.lng", 6).alias("lng"),
        F.round("geo.accuracy_m", 1).alias("accuracy_m"), F.col("clarification.field").alias("asked_field"),
        F.size("alternatives").alias("n_alternatives"),
    )
