"""Fragments of the DuckDB statements."""


def haversine(lat1, lng1, lat2, lng2):
    h = (
        f"(pow(sin((radians({lat2})-radians({lat1}))/2),2)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lng2}-{lng1})/2),2))"
    )
    return f"(2*6371000.0E0*asin(sqrt(case when {h} > 1 then 1.0E0 else {h} end)))"


def cell(lat, lng, level=10):
    """Grid code by walking the levels down, one 4x4 split at a time."""
    row = f"least(cast(floor(({lat}-2.5E0)/(36.0E0/1048576)) as bigint),1048575)"
    col = f"least(cast(floor(({lng}-63.5E0)/(36.0E0/1048576)) as bigint),1048575)"
    parts = " || ".join(
        f"substr('LMPTK456J327FC98', cast(4*(({row} // {4 ** (9 - d)}) % 4) + ({col} // {4 ** (9 - d)}) % 4 + 1 as integer), 1)"
        for d in range(level)
    )
    return (
        f"(case when {lat} between 2.5E0 and 38.5E0 and {lng} between 63.5E0 and 99.5E0 then {parts} end)"
    )


def title(text):
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower(trim({text})), '[a-z]+|[^a-z]+'), "
        f"lambda x: upper(x[1]) || x[2:]), '')"
    )


def place(text):
    return f"regexp_replace(regexp_replace({title(text)}, '\\bNct\\b', 'NCT', 'g'), '\\bNcr\\b', 'NCR', 'g')"


def office_name(text):
    name = f"trim(regexp_replace(regexp_replace(trim({text}), '\\s*\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'))"
    cut = f"trim(regexp_replace({name}, '(?i)\\s*\\b(?:G\\.?P\\.?O|[BSH]\\.?O)\\b\\.?.*$', ''), ' ,-')"
    return f"trim(coalesce(nullif({cut},''), {name}), ' ,-')"


USABLE = (
    "regexp_full_match(trim(Pincode), '[1-8][0-9]{5}') and not "
    "regexp_matches(coalesce(OfficeName,''), '(?i)^\\s*(?:test\\s*office|dummy|sample|n\\.?a\\.?|xxx+)\\s*$')"
)

# every cleaned column of the directory
OFFICE_ROWS = f"""office_rows as (
  select line_no, trim(Pincode) as pincode, {office_name('OfficeName')} as name,
    upper(trim(OfficeType)) as office_type,
    case when upper(trim(OfficeType)) in ('HO','GPO') then 0 when upper(trim(OfficeType))='SO' then 1
      when upper(trim(OfficeType))='BO' then 2 else 3 end as type_rank,
    {place('District')} as district, {place('StateName')} as state,
    case when try_cast(Latitude as double) between 2.5 and 38.5 and try_cast(Longitude as double) between 63.5 and 99.5 then try_cast(Latitude as double) end as lat,
    case when try_cast(Latitude as double) between 2.5 and 38.5 and try_cast(Longitude as double) between 63.5 and 99.5 then try_cast(Longitude as double) end as lng,
    Delivery as delivery, Latitude as lat_text, Longitude as lng_text
  from directory where {USABLE})"""

DELIVERY_OFFICES = OFFICE_ROWS + """,
named_rows as (
  select * replace (case when (name=upper(name) or name=lower(name)) and upper(name)<>lower(name) then
    array_to_string(list_transform(string_split(name,' '), lambda w: case when regexp_full_match(w,'[A-Za-z]+') then upper(w[1])||lower(w[2:]) else w end),' ')
    else name end as name) from office_rows),
seed_offices as (
  select line_no, name, pincode, district, state,
    case when state='Delhi' or lower(district) in ('central','east','new delhi','north','north east','north west','south','south east','south west','west','shahdara') then 'New Delhi'
      when district in ('Bengaluru Urban','Bengaluru Rural') then 'Bengaluru' else district end as city,
    lat, lng, office_type
  from named_rows
  where lower(trim(delivery))='delivery' and lat is not null and lng is not null
    and least(length(split_part(lat_text,'.',2)), length(split_part(lng_text,'.',2))) >= 4
    and not (round(lat,2)=lat and round(lng,2)=lng)
    and length(name)>=3 and upper(name) not in ('GPO','HO','SO','BO') and regexp_matches(name,'[A-Za-z]{3}'))"""

H_NEAR = haversine("o.lat", "o.lng", "p.lat", "p.lng")

# two nearest distinct names, never the office's own names
NEARBY = DELIVERY_OFFICES + f""",
near_pairs as (
  select o.line_no, lower(p.name) as place_key, p.name, p.lat as plat, p.lng as plng, {H_NEAR} as d
  from seed_offices o join seed_offices p on p.lat between o.lat-0.05 and o.lat+0.05 and p.lng between o.lng-0.06 and o.lng+0.06
  where lower(p.name) not in (lower(o.name), lower(coalesce(o.city,'')), lower(coalesce(o.district,'')), lower(coalesce(o.state,'')))),
near_names as (
  select line_no, place_key, min({{'d': d, 'name': name, 'lat': plat, 'lng': plng}}) as b
  from near_pairs where d > 25 and d <= 3000 group by 1, 2),
nearby as (
  select line_no, rn as rank, b.name as name, round(b.lat,6) as true_lat, round(b.lng,6) as true_lng, round(b.d,1) as distance_m
  from (select *, cast(row_number() over (partition by line_no order by b.d, place_key) as integer) as rn from near_names) where rn <= 2)"""

# the gazetteer of the office view
GAZETTEER = """gaz as (
  select pincode, min({'r': type_rank, 'n': office_name}).n as locality, arg_min(district, office_id) as district,
    arg_min(state, office_id) as state, round(median(lat),6) as lat, round(median(lng),6) as lng,
    cast(count(*) as integer) as office_count
  from (select *, case office_type when 'HO' then 0 when 'SO' then 1 else 2 end as type_rank from office) group by pincode)"""

LOCALITIES = "localities as (select distinct pincode, lower(office_name) as locality from office)"


def fold(text):
    """Folding of ASCII text."""
    t = f"regexp_replace({text}, '[,;|/\\\\\\n\\r\\t]+|--+', ' ', 'g')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s\\x{{0900}}-\\x{{097F}}#&.''\\-]+', ' ', 'g')"
    t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}_])[.'']+(\\s|$)', '\\1\\2', 'g')"
    return f"lower({squeeze(t)})"


def squeeze(text):
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def chatter(text):
    from waymark.functions.tables import CHATTER_PATTERN

    return squeeze(f"regexp_replace({text}, '(?i){CHATTER_PATTERN}', ' ', 'g')")


def expand(text):
    """Abbreviations between spaces, longest first, marked before they are written out."""
    from waymark.functions.tables import ABBREVIATIONS

    keys = sorted(ABBREVIATIONS, key=len, reverse=True)
    marked = f"(' ' || replace({text}, ' ', '  ') || ' ')"
    names = ",".join(f"'{k}'" for k in keys)
    pairs = ",".join(f"'{k}={ABBREVIATIONS[k]}'" for k in keys)
    marked = (
        f"list_reduce([{names}], lambda s, k: replace(s, ' '||replace(k,' ','  ')||' ', "
        f"' '||chr(1)||k||chr(1)||' '), {marked})"
    )
    written = (
        f"list_reduce([{pairs}], lambda s, x: replace(s, chr(1)||split_part(x,'=',1)||chr(1), split_part(x,'=',2)), {marked})"
    )
    return squeeze(written)


# spaces and folding first, then phones between non-digits, twice for neighbours
def strip_phones(text):
    split = r"(^|[^0-9])(?:\+?91[\s.\-]?)?[6-9][0-9]{4}[\s.\-][0-9]{5}($|[^0-9])"
    whole = r"(^|[^0-9])(?:(?:\+?91[\s.\-]?|0)?[6-9][0-9]{9}|0[0-9]{2,4}[\s.\-]?[0-9]{6,8})($|[^0-9])"
    for pattern in (split, split, whole, whole):
        text = f"regexp_replace({text}, '{pattern}', '\\1' || chr(1) || '\\2', 'g')"
    return text


NORMALISED = f"""folded as (select *, {chatter(fold('raw'))} as folded from address),
normal as (select *, {expand('folded')} as text from folded)"""

PHONE_FREE = NORMALISED + f""",
marked as (select *, {strip_phones('text')} as marked from normal),
phone_free as (select *, {chatter("replace(marked, chr(1), ' ')")} as clean_text,
  len(marked) - len(replace(marked, chr(1), '')) as n_phones from marked)"""


def group1(text, pattern, groups=1):
    parts = ", ".join(f"nullif(regexp_extract({text}, '(?i){pattern}', {g}), '')" for g in range(1, groups + 1))
    return f"nullif(upper(regexp_replace(coalesce({parts}, NULL), '\\s+', '', 'g')), '')"


def unit(text):
    from waymark.functions.tables import UNIT_PATTERNS

    return "coalesce(" + ", ".join(group1(text, p) for _, p in UNIT_PATTERNS) + ")"


PINS = PHONE_FREE + r""",
pins as (select order_id, clean_text, unnest(regexp_extract_all(clean_text, '\b([1-9][0-9]{5})\b', 1)) as pincode,
  generate_subscripts(regexp_extract_all(clean_text, '\b([1-9][0-9]{5})\b', 1), 1) as pos from phone_free)"""

RESOLVED_PINS = PINS + ", " + GAZETTEER + """,
chosen as (select p.order_id, arg_max(g, p.pos) as g from pins p join gaz g on g.pincode = p.pincode group by 1),
placed as (select f.*, c.g.pincode as pincode, c.g.district as district, c.g.state as pincode_state, c.g.lat as centroid_lat,
  c.g.lng as centroid_lng, c.g.office_count as office_count from phone_free f left join chosen c using (order_id))"""

AGREEMENT = RESOLVED_PINS + ", " + LOCALITIES + """,
agreed as (select p.order_id, max({'n': length(l.locality), 'name': l.locality}).name as matched_locality
  from placed p join localities l on l.pincode = p.pincode and length(l.locality) >= 4
   and contains(' ' || regexp_replace(p.clean_text, '[^a-z0-9_]', ' ', 'g') || ' ', ' ' || l.locality || ' ') group by 1),
agreement as (select p.order_id, p.pincode, a.matched_locality,
  case when a.matched_locality is not null then true when p.pincode in (select pincode from localities) then false end as locality_agrees
  from placed p left join agreed a using (order_id))"""
