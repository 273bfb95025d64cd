"""Jobs over address text: normalisation, parsing, gazetteer lookups."""

from pyspark.sql import functions as F

from waymark.functions import geo, tables
from waymark.functions import text as X
from waymark.operators import gazetteer as G
from waymark.operators import lookups as L
from waymark.operators import normalise as N
from waymark.operators import parse as P
from waymark.operators import placing
from waymark.plans import sql
from waymark.plans.registry import job
from waymark.sources.fixtures import table, view
from waymark.sources.warehouse import Warehouse, reference_table, staged, widened


def offices_as_rows(spark, sf):
    """The office view in the columns the gazetteer build reads."""
    rank = F.when(F.col("office_type") == "HO", 0).when(F.col("office_type") == "SO", 1).otherwise(2)
    return view(spark, sf, "office").select(
        F.col("office_id").alias("line_no"), "pincode", F.col("office_name").alias("name"),
        rank.alias("type_rank"), "district", "state", "lat", "lng",
    )


@reference_table("gazetteer")
def _gazetteer(w):
    return G.build_gazetteer(offices_as_rows(w.spark, w.sf_dir))


@reference_table("localities")
def _localities(w):
    rows = G.build_locality_index(offices_as_rows(w.spark, w.sf_dir))
    return rows.select("pincode", F.lower("locality").alias("locality")).distinct()


@reference_table("normalised")
def _normalised(w):
    return N.normalise_addresses(widened(view(w.spark, w.sf_dir, "address")))


@reference_table("parsed_text")
def _parsed_text(w):
    return P.parse_text(w.table("normalised"))


@reference_table("parsed")
def _parsed(w):
    return L.parse_addresses(w.table("normalised"), w.table("gazetteer"), w.table("localities"))


def wh(spark, sf):
    return Warehouse(spark, sf)


@job(
    "place_by_pincode", "JN1 GE1 GE8 GE10",
    f"""with {sql.RESOLVED_PINS}
    select order_id, pincode, round(centroid_lat,6) as lat, round(centroid_lng,6) as lng,
      case when centroid_lat is null then null else round(coalesce(1200.0E0 + least(1.0E0, ln(greatest(1,office_count))/ln(30.0E0))*6800.0E0, 8000.0E0),1) end as accuracy_m,
      {sql.cell('centroid_lat','centroid_lng')} as cell from placed""",
)
def place_by_pincode(spark, sf):
    """Address text to its last known pincode, that pincode's centroid and grid cell."""
    df = N.normalise_addresses(widened(view(spark, sf, "address")))
    df = P.strip_phones(df).withColumn("clean_text", X.strip_chatter(F.col("without_phones")))
    df = df.withColumn("pincode_candidates", P.pincode_tokens(F.col("clean_text")))
    gaz = G.build_gazetteer(offices_as_rows(spark, sf))
    tokens = staged(df.select("order_id", "pincode_candidates"), "pincode_tokens")  # read more than once
    placed = L.resolve_pincode(tokens, gaz, "order_id")
    none = F.lit(None)
    placed = placing.geocode_cascade(
        placed.withColumns(
            {
                "landmark_lat": none.cast("double"), "landmark_lng": none.cast("double"),
                "landmark_observations": none.cast("int"), "landmark_relation": none.cast("string"),
            }
        )
    )
    return placed.select(
        "order_id", "pincode", F.round("geo.lat", 6).alias("lat"), F.round("geo.lng", 6).alias("lng"),
        F.col("geo.accuracy_m").alias("accuracy_m"), geo.grid_cell(F.col("geo.lat"), F.col("geo.lng")).alias("cell"),
    )


@job("fold_text", "NM1", f"select order_id, {sql.fold('raw')} as folded from address")
def fold_text(spark, sf):
    return view(spark, sf, "address").select("order_id", X.fold(F.col("raw")).alias("folded"))


@job(
    "fold_documents", "NM1 NM2",
    f"""select doc_id, md5({sql.fold('text')}) as folded_md5, regexp_matches(text, '[A-Za-z]') as latin,
      regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') as devanagari from documents""",
)
def fold_documents(spark, sf):
    found = X.scripts(F.col("text"))
    return widened(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.md5(X.fold(F.col("text"))).alias("folded_md5"),
        F.array_contains(found, "latin").alias("latin"), F.array_contains(found, "devanagari").alias("devanagari"),
    )


@job(
    "normalise_addresses", "NM4 NM5 NM6 NM7",
    f"with {sql.NORMALISED} select order_id, folded, text, text as retrieval_text, sha256(text) as cache_key from normal",
)
def normalise_addresses(spark, sf):
    df = N.normalise_addresses(widened(view(spark, sf, "address")))
    return df.select("order_id", "folded", "text", "retrieval_text", "cache_key")


@job("transliterate_addresses", "NM3 CG4")
def transliterate_addresses(spark, sf):
    """Addresses written in Devanagari and read back in Latin."""
    from waymark.operators.corpus import to_devanagari

    df = widened(view(spark, sf, "address").select("order_id", "raw")).select("order_id", to_devanagari(F.col("raw")).alias("raw"))
    return N.normalise_addresses(df).select("order_id", "raw", "text", "retrieval_text")


@job("strip_phones", "PR1", f"with {sql.PHONE_FREE} select order_id, clean_text, n_phones from phone_free")
def strip_phones(spark, sf):
    df = P.strip_phones(N.normalise_addresses(widened(view(spark, sf, "address"))))
    return df.select(
        "order_id", X.strip_chatter(F.col("without_phones")).alias("clean_text"), F.size("phones").cast("long").alias("n_phones")
    )


@job(
    "strip_phones_documents", "PR1",
    f"""with m as (select doc_id, {sql.strip_phones('text')} as marked from documents)
    select doc_id, len(marked) - len(replace(marked, chr(1), '')) as n_phones,
      md5({sql.squeeze("replace(marked, chr(1), ' ')")}) as clean_md5 from m""",
)
def strip_phones_documents(spark, sf):
    df = P.strip_phones(widened(table(spark, sf, "documents").select("doc_id", "text")))
    return df.select("doc_id", F.size("phones").cast("long").alias("n_phones"), F.md5("without_phones").alias("clean_md5"))


@job("pincode_candidates", "PR2", f"with {sql.PINS} select order_id, cast(pos - 1 as integer) as pos, pincode from pins")
def pincode_candidates(spark, sf):
    return L.explode_pincodes(wh(spark, sf).table("parsed_text"), "order_id")


# address text with a unit, a floor, a block, a tower and a sector written in
UNITS_SQL = """units as (select order_id, lower(concat(
   case order_id % 7 when 0 then 'flat ' when 1 then 'house number ' when 2 then 'door number ' when 3 then 'plot number ' when 4 then 'shop ' when 5 then 'room ' else 'survey number ' end,
   cast(order_id % 300 as varchar), case when order_id % 3 = 0 then ' b' when order_id % 3 = 1 then '/12' else '' end, ' ',
   case order_id % 5 when 0 then '2nd floor' when 1 then 'ground floor' when 2 then 'floor 3' else '' end, ' ',
   case order_id % 4 when 0 then 'block c' when 1 then 'd block' else '' end, ' ',
   case when order_id % 6 < 2 then concat('tower t', cast(order_id % 9 as varchar)) else '' end, ' ',
   case order_id % 8 when 0 then 'sector 22' when 1 then 'phase ii' when 2 then 'sector 5 a' else '' end, ' ', raw)) as clean_text from address)"""


@job(
    "unit_fields", "PR3 PR4 PR5",
    f"""with {UNITS_SQL} select order_id, {sql.unit('clean_text')} as building, {sql.group1('clean_text', tables.FLOOR_PATTERN, 3)} as floor,
      {sql.group1('clean_text', tables.BLOCK_PATTERN, 2)} as block, {sql.group1('clean_text', tables.TOWER_PATTERN)} as tower,
      coalesce('Sector ' || {sql.group1('clean_text', tables.SECTOR_PATTERN)}, 'Phase ' || {sql.group1('clean_text', tables.PHASE_PATTERN)}) as sub_locality
    from units""",
)
def unit_fields(spark, sf):
    return P.with_unit_fields(unit_texts(spark, sf)).drop("clean_text")


def unit_texts(spark, sf):
    select = UNITS_SQL[len("units as (") : -1].replace("varchar", "string").replace("from address", "from {address}")
    return spark.sql(select, address=view(spark, sf, "address"))


STATES = sorted(tables.STATE_ALIASES)
STATED_SQL = "stated as (select order_id, pincode, pincode_state, lower(raw) || ' ' || ([" + ",".join(
    f"'{s}'" for s in STATES
) + f"])[1 + order_id % {len(STATES)}] || ' end' as clean_text from placed)"


def stated_texts(df):
    aliases = F.array(*[F.lit(s) for s in STATES])
    return df.withColumn(
        "clean_text",
        F.concat(F.lower("raw"), F.lit(" "), F.get(aliases, (F.col("order_id") % len(STATES)).cast("int")), F.lit(" end")),
    )


ALIAS_ROWS = "aliases as (select unnest([" + ",".join(
    f"{{'a': '{a}', 'c': '{c}'}}" for a, c in tables.STATE_ALIASES.items()
) + "], recursive := true))"


@job(
    "state_in_text", "PR6 JN4 RT17",
    f"""with {sql.RESOLVED_PINS}, {STATED_SQL}, {ALIAS_ROWS},
    found as (select order_id, max({{'n': length(a), 'c': c}}).c as stated_state from stated join aliases on contains(' ' || clean_text || ' ', ' ' || a || ' ') group by 1)
    select s.order_id, f.stated_state, coalesce(lower(pincode_state) <> lower(f.stated_state), false) as state_conflict
    from stated s left join found f using (order_id)""",
)
def state_in_text(spark, sf):
    df = wh(spark, sf).table("parsed_text").drop("stated_state")
    placed = L.resolve_pincode(df, wh(spark, sf).table("gazetteer"), "order_id")
    df = stated_texts(placed).withColumn("stated_state", P.state_in_text(F.col("clean_text")))
    return L.state_conflict(df).select("order_id", "stated_state", "state_conflict")


@job("landmark_phrases", "PR7 PR8",
     r"""with """ + sql.PHONE_FREE + r""",
     tails as (select order_id, regexp_extract(clean_text, '\b(behind|opposite|near) (.*)$', 1) as relation,
       regexp_extract(clean_text, '\b(behind|opposite|near) (.*)$', 2) as tail from phone_free)
     select order_id, relation, array_to_string((string_split(trim(regexp_replace(tail, '\b(district|pin|pincode|near|over|behind|opposite|block|floor|flat)\b.*$', '')), ' '))[:4], ' ') as name from tails""")
def landmark_phrases(spark, sf):
    df = wh(spark, sf).table("parsed_text")
    return df.select("order_id", F.inline("phrases")).select("order_id", "relation", "name")


@job("final_landmarks", "PR9 PR10")
def final_landmarks(spark, sf):
    return wh(spark, sf).table("parsed").select("order_id", F.posexplode("landmarks").alias("pos", "l")).select("order_id", "pos", "l.*")


@job(
    "skip_model", "PR11",
    f"""with {sql.AGREEMENT} select count(*) as addresses, count_if(a.pincode is not null) as known_pincode, count_if(locality_agrees) as agreeing from agreement a""",
)
def skip_model(spark, sf):
    df = wh(spark, sf).table("parsed")
    return df.withColumn("skip", P.can_skip_model(df)).agg(
        F.count("*").alias("addresses"), F.count_if(F.col("pincode").isNotNull()).alias("known_pincode"),
        F.count_if(F.col("locality_agrees")).alias("agreeing"),
    )


@job(
    "structured_building", "PR12",
    f"""with {UNITS_SQL}, f as (select order_id, {sql.unit('clean_text')} as b, {sql.group1('clean_text', tables.FLOOR_PATTERN, 3)} as f,
      {sql.group1('clean_text', tables.BLOCK_PATTERN, 2)} as k, {sql.group1('clean_text', tables.TOWER_PATTERN)} as t from units)
    select order_id, nullif(concat_ws(', ', b, 'Block ' || k, 'Tower ' || t, 'Floor ' || f), '') as building from f""",
)
def structured_building(spark, sf):
    df = P.with_unit_fields(unit_texts(spark, sf))
    return df.select(
        "order_id",
        P.structured_building(F.col("building"), F.col("block"), F.col("tower"), F.col("floor")).alias("building"),
    )


REQUESTS = """select doc_id, text as raw, case when doc_id % 3 = 0 then null else cast(doc_id % 400 as double) - 200 end as lat,
  cast(doc_id % 500 as double) - 250 as lng from documents"""


@job(
    "validate_requests", "PR13",
    f"""with requests as ({REQUESTS})
    select doc_id, coalesce(length(raw) between 1 and 2000, false) and (lat is null or (lat between -90 and 90 and lng between -180 and 180)) as accepted from requests""",
)
def validate_requests(spark, sf):
    rows = spark.sql(REQUESTS.replace("from documents", "from {documents}"), documents=table(spark, sf, "documents"))
    rows = rows.withColumn("hint", F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")))
    good, bad = P.split_requests(rows)
    return good.select("doc_id", F.lit(True).alias("accepted")).unionByName(bad.select("doc_id", F.lit(False).alias("accepted")))


BLANKS = """select order_id, case order_id % 9 when 0 then '' when 1 then ' null ' when 2 then 'N/A' when 3 then '-' when 4 then 'Unknown' when 5 then ' x ' else true_pincode end as v,
  case order_id % 4 when 0 then true_pincode when 1 then concat('0', substr(true_pincode, 2)) when 2 then substr(true_pincode, 2) else concat(true_pincode, '1') end as pin from address"""


@job(
    "blank_is_null", "PR14",
    f"""with b as ({BLANKS}) select order_id, case when lower(trim(v)) in ('','null','none','n/a','na','-','unknown') then null else trim(v) end as v,
      regexp_full_match(pin, '[1-9][0-9]{{5}}') as valid_pin from b""",
)
def blank_is_null(spark, sf):
    rows = spark.sql(BLANKS.replace("from address", "from {address}"), address=view(spark, sf, "address"))
    return rows.select("order_id", X.blank_to_null(F.col("v")).alias("v"), F.col("pin").rlike(r"^[1-9]\d{5}$").alias("valid_pin"))


@job(
    "resolve_pincode", "JN1 SRC2",
    f"with {sql.RESOLVED_PINS} select order_id, pincode, district, pincode_state, centroid_lat, centroid_lng, office_count from placed",
)
def resolve_pincode(spark, sf):
    w = wh(spark, sf)
    df = L.resolve_pincode(w.table("parsed_text").select("order_id", "pincode_candidates"), w.table("gazetteer"), "order_id")
    return df.select("order_id", "pincode", "district", "pincode_state", "centroid_lat", "centroid_lng", "office_count")


# every seventh pincode shifted out of the directory
@job(
    "unknown_pincode_tokens", "JN2 ST3",
    f"""with {sql.PINS}, {sql.GAZETTEER},
    moved as (select order_id, cast(pos - 1 as integer) as pos, case when order_id % 7 = 0 then '9' || substr(pincode, 2) else pincode end as pincode from pins)
    select m.* from moved m where pincode not in (select pincode from gaz)""",
)
def unknown_pincode_tokens(spark, sf):
    w = wh(spark, sf)
    df = w.table("parsed_text").select(
        "order_id",
        F.transform(
            "pincode_candidates",
            lambda p: F.when(F.col("order_id") % 7 == 0, F.concat(F.lit("9"), F.substring(p, 2, 5))).otherwise(p),
        ).alias("pincode_candidates"),
    )
    return L.unknown_pincode_tokens(df, w.table("gazetteer"), "order_id").select("order_id", "pos", "pincode")


@job("locality_agreement", "JN3 RT17", f"with {sql.AGREEMENT} select * from agreement")
def locality_agreement(spark, sf):
    w = wh(spark, sf)
    df = L.resolve_pincode(w.table("parsed_text").select("order_id", "clean_text", "pincode_candidates"), w.table("gazetteer"), "order_id")
    return L.locality_agreement(df, w.table("localities"), "order_id").select(
        "order_id", "pincode", "matched_locality", "locality_agrees"
    )


DISTRICTS = "['Bengaluru Urban','Mumbai Suburban','Ernakulam','Gurgaon','West','Shahdara','North Goa','Unmapped Place','']"


@job(
    "city_for_district", "JN5",
    f"""with d as (select o_orderkey, ({DISTRICTS})[1 + o_orderkey % 9] as district, case when o_custkey % 5 = 0 then 'Delhi' else 'Goa' end as state from orders)
    select o_orderkey, case when district = '' then null when state = 'Delhi' or lower(district) in ('west','shahdara') then 'New Delhi'
      else coalesce(map {{'Bengaluru Urban':'Bengaluru','Mumbai Suburban':'Mumbai','Ernakulam':'Kochi','Gurgaon':'Gurugram','North Goa':'Panaji'}}[district], district) end as city from d""",
)
def city_for_district(spark, sf):
    names = F.array(*[F.lit(x) for x in DISTRICTS.strip("[]").replace("'", "").split(",")])
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.get(names, (F.col("o_orderkey") % 9).cast("int")).alias("district"),
        F.when(F.col("o_custkey") % 5 == 0, "Delhi").otherwise("Goa").alias("state"),
    )
    return orders.select("o_orderkey", G.city_for_district(F.col("district"), F.col("state")).alias("city"))


@job(
    "find_city_exact", "JN6 RT17",
    f"""with {sql.PHONE_FREE}, {sql.GAZETTEER}, cities as (select distinct district as city, lower(district) as k from gaz)
    select order_id, max({{'n': length(k), 'k': k, 'c': city}}).c as city from phone_free join cities
      on contains(' ' || regexp_replace(clean_text, '[^a-z0-9_]', ' ', 'g') || ' ', ' ' || k || ' ') group by 1""",
)
def find_city_exact(spark, sf):
    w = wh(spark, sf)
    return L.find_city_exact(w.table("parsed_text"), G.known_cities(w.table("gazetteer")), "order_id")


# Real district names to misspell.
CITY_NAMES = ("bengaluru", "chennai", "lucknow", "visakhapatnam", "coimbatore", "ahmedabad", "thiruvananthapuram", "nagaur")


@job("find_city_fuzzy", "JN7")
def find_city_fuzzy(spark, sf):
    """Misspelt city names found again; checked against brute force in the tests."""
    from waymark.operators.corpus import misspell

    names = F.array(*[F.lit(c) for c in CITY_NAMES])
    city = F.get(names, (F.col("order_id") % len(CITY_NAMES)).cast("int"))
    df = view(spark, sf, "address").select(
        "order_id", F.concat(F.lower("raw"), F.lit(" "), misspell(city, F.col("order_id"))).alias("clean_text")
    )
    cities = df.select(city.alias("city_key"), F.initcap(city).alias("city")).distinct()
    return L.find_city_fuzzy(df, cities, "order_id")


@job("parse_addresses", "PR12 NM7 DQ1")
def parse_addresses(spark, sf):
    """The whole rules-only parse, straight from raw text."""
    w = wh(spark, sf)
    df = N.normalise_addresses(widened(view(spark, sf, "address"))).select("order_id", "text")
    out = L.parse_addresses(df, w.table("gazetteer"), w.table("localities"))
    return out.select(
        "order_id", "building", "locality", "city", "district", "state", "pincode", "locality_agrees", "state_conflict",
        F.concat_ws("; ", F.transform("landmarks", lambda l: F.concat_ws(" ", l["relation"], l["name"]))).alias("landmarks"),
    )
