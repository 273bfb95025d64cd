"""Look-alike tables derived from the driver's data.

The post-office directory, the address corpus and the delivery log are not
shipped, so each is derived from a driver table by one SQL text that Spark and
DuckDB read alike.
"""

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

_PIN = "p_partkey % 160"

VIEWS = {
    "office": """
        select p_partkey as office_id, cast(110000 + p_partkey % 160 as string) as pincode,
          concat(p_name, ' ', cast(p_partkey % 37 as string)) as office_name,
          case when p_partkey % 11 = 0 then 'HO' when p_partkey % 3 = 0 then 'SO' else 'BO' end as office_type,
          concat('District ', cast((p_partkey % 160) % 40 as string)) as district,
          concat('State ', cast((p_partkey % 160) % 8 as string)) as state,
          case when p_partkey % 17 = 0 then cast(null as double)
            else 8.0 + ((p_partkey % 160) * 7919 % 2800)/100.0E0 + ((p_partkey*31) % 600 - 300)/10000.0E0 end as lat,
          case when p_partkey % 17 = 0 then cast(null as double)
            else 70.0 + ((p_partkey % 160) * 104729 % 2400)/100.0E0 + ((p_partkey*53) % 600 - 300)/10000.0E0 end as lng,
          p_size as observation_count from part""",
    "address": """
        select c_custkey as order_id, o.office_id as landmark_office_id,
          concat('H.No ', cast(c_custkey % 300 as string), ', ',
            case when c_custkey % 4 = 0 then 'opp ' when c_custkey % 4 = 1 then 'behind ' else 'nr ' end,
            o.office_name, ', ', o.district, case when c_custkey % 5 = 0 then '' else concat(' - ', o.pincode) end,
            case when c_custkey % 6 = 0 then concat(', 99999', lpad(cast(c_custkey % 100000 as string),5,'0')) else '' end,
            case when c_custkey % 7 = 0 then ', call before coming' else '' end) as raw,
          o.office_name as true_locality, o.pincode as true_pincode, o.state as true_state,
          o.lat as true_lat, o.lng as true_lng
        from (select c_custkey, c_custkey % (select count(*) from part) as office_key from customer) c
        join office o on o.office_id = c.office_key""",
    "delivery": """
        select e.event_id, e.ts, o.office_id as landmark_id,
          o.lat + ((e.event_id*13) % 80 - 40)/10000.0E0 as lat,
          o.lng + ((e.event_id*17) % 80 - 40)/10000.0E0 as lng, e.value as accuracy_m
        from events e join office o on o.office_id = e.user_id % 200 where o.lat is not null""",
    # directory: the office table as the messy all-string CSV it would come from
    "directory": """
        select p_partkey as line_no,
          case when p_partkey % 41 = 0 then '900056' when p_partkey % 43 = 0 then '1100' else cast(110000 + p_partkey % 160 as string) end as Pincode,
          case when p_partkey % 53 = 0 then 'Test Office' when p_partkey % 59 = 0 then 'GPO'
            else concat(case when p_partkey % 5 = 0 then upper(p_name) else p_name end, ' ', cast(p_partkey % 37 as string),
              case p_partkey % 6 when 0 then ' S.O' when 1 then ' B.O (North)' when 2 then ' SO West' when 3 then ' G.P.O.' else '' end) end as OfficeName,
          case when p_partkey % 11 = 0 then 'HO' when p_partkey % 3 = 0 then 'so' when p_partkey % 7 = 0 then 'XX' else 'BO' end as OfficeType,
          case when p_partkey % 4 = 0 then 'Non Delivery' else 'Delivery' end as Delivery,
          case when p_partkey % 160 < 8 then 'WEST' when p_partkey % 160 < 16 then 'BENGALURU URBAN'
            else concat('DISTRICT ', cast((p_partkey % 160) % 40 as string)) end as District,
          case when p_partkey % 160 < 8 then 'NCT OF DELHI' when p_partkey % 160 < 16 then 'KARNATAKA'
            else concat('STATE ', cast((p_partkey % 160) % 8 as string)) end as StateName,
          case when p_partkey % 17 = 0 then 'NA' when p_partkey % 19 = 0 then '0.0' when p_partkey % 29 = 0 then '21.15'
            else concat(cast(8 + (p_partkey % 8) * 3 as string), '.',
              lpad(cast((p_partkey % 160) * 4321 % 90 * 10000 + (p_partkey*7919) % 60000 as string), 6, '0')) end as Latitude,
          case when p_partkey % 17 = 0 then '' when p_partkey % 31 = 0 then '81.25'
            else concat(cast(70 + (p_partkey % 8) * 2 as string), '.',
              lpad(cast((p_partkey % 160) * 1234 % 90 * 10000 + (p_partkey*104729) % 60000 as string), 6, '0')) end as Longitude
        from part""",
}

NEEDS = {"office": ("part",), "address": ("part", "customer"), "delivery": ("part", "events"), "directory": ("part",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view; the views it builds on are inlined."""
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    inputs = {t: table(spark, sf_dir, t) for t in NEEDS[name]}
    if name in ("address", "delivery"):
        inputs["office"] = view(spark, sf_dir, "office")
    for source in inputs:
        for word in ("from", "join"):
            text = text.replace(f"{word} {source} ", f"{word} {{{source}}} ")
            text = text.replace(f"{word} {source})", f"{word} {{{source}}})")
            if text.endswith(f"{word} {source}"):
                text = text[: -len(source)] + f"{{{source}}}"
    return spark.sql(text, **inputs)


def duckdb_views() -> str:
    """The same views as leading CTEs of a DuckDB statement."""
    return ",\n".join(
        f"{name} as ({body.replace(' as string)', ' as varchar)')})" for name, body in VIEWS.items()
    )
