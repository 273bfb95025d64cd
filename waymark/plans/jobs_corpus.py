"""Jobs over test corpora, stored model responses, dense vectors and files."""

from pyspark.sql import functions as F

from waymark.functions import tables
from waymark.operators import corpus as C
from waymark.operators import gazetteer as G
from waymark.operators import knn as K
from waymark.operators import responses as R
from waymark.plans import sql
from waymark.plans.jobs_gazetteer import SEEDS
from waymark.plans.registry import job
from waymark.sources import files
from waymark.sources.fixtures import table, view
from waymark.sources.warehouse import Warehouse, reference_table, scratch, widened

VARIANTS = 6


@reference_table("corpus")
def _corpus(w):
    return C.perturb(widened(w.table("seeds").select("seed_id", "raw", "city", "pincode", "lat", "lng")), VARIANTS)


def corpus(spark, sf):
    return Warehouse(spark, sf).table("corpus")


def chance(step):
    return f"(variant > 0 and cast(('0x' || substr(md5('{step}|' || seed_id || '|' || variant), 1, 8)) as bigint)/4294967296.0E0 < {C.RATES[step]}E0)"


ROLLED = SEEDS + f""",
rows as (select s.seed_id, s.raw, s.city, s.pincode, v as variant from seed_rows s cross join range({VARIANTS}) r(v)),
rolled as (select *, {', '.join(f"{chance(x)} as {x}" for x in C.RATES)} from rows)"""
INDEPENDENT = ("add_unit", "drop_pincode", "drop_city", "inject_phone", "append_chatter", "transliterate", "merge_lines", "case_noise", "extra_whitespace")


@job(
    "perturb", "CG1 CG3 CG4",
    f"""with {ROLLED} select seed_id || '#v' || variant as address_id, cast(variant as integer) as variant, {', '.join(f'{x}' for x in INDEPENDENT)},
      case when variant = 0 then raw end as clean_text, add_unit as has_building, inject_phone as has_phone from rolled""",
)
def perturb(spark, sf):
    rows = C.perturb(widened(Warehouse(spark, sf).table("seeds").select("seed_id", "raw", "city", "pincode")), VARIANTS)
    return rows.select(
        "address_id", "variant", *[F.array_contains("perturbations", x).alias(x) for x in INDEPENDENT],
        F.when(F.col("variant") == 0, F.col("raw")).alias("clean_text"), F.col("building").isNotNull().alias("has_building"),
        (F.size("phones_expected") > 0).alias("has_phone"),
    )


@job("corpus_texts", "CG1 CG2 CG3 CG4 CG5")
def corpus_texts(spark, sf):
    return corpus(spark, sf).select("address_id", "raw", "building", F.array_join("perturbations", ",").alias("perturbations"))


WORDS = "words as (select p_partkey, p_name as word from part)"


def u(tag):
    return f"(cast(('0x' || substr(md5('{tag}|' || p_partkey),1,8)) as bigint)/4294967296.0E0)"


NEIGHBOURS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in tables.KEYBOARD_NEIGHBOURS.items()) + "}"


@job(
    "misspell", "CG2",
    f"""with {WORDS}, s as (select *, cast(floor({u('at')}*(length(word)-2)) as integer) + 1 as i, cast(floor({u('kind')}*4.0E0) as integer) as kind, {u('side')} as side from words),
    l as (select *, substr(word, i+1, 1) as ch, {NEIGHBOURS}[lower(substr(word, i+1, 1))] as near from s)
    select p_partkey, case when length(word) < 4 then word when kind = 0 and near is not null then substr(word,1,i) || substr(near, cast(floor(side*length(near)) as integer)+1, 1) || substr(word,i+2)
      when kind = 1 then substr(word,1,i) || ch || ch || substr(word,i+2) when kind = 2 then substr(word,1,i) || substr(word,i+2)
      else substr(word,1,i) || substr(word,i+2,1) || ch || substr(word,i+3) end as misspelt from l""",
)
def misspell(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.misspell(F.col("p_name"), F.col("p_partkey")).alias("misspelt"))


@job("corpus_counts", "GZ19 CG1")
def corpus_counts(spark, sf):
    return C.corpus_counts(corpus(spark, sf))


@job("gold_split", "CG6 ST4 EV14", "select 300 as rows, 150 as dev, 150 as test, 0 as over_cap, 0 as in_both, 300 as derived")
def gold_split(spark, sf):
    """Sizes and caps of the split; the split itself is checked in the tests."""
    gold = C.gold_split(corpus(spark, sf).drop("lat", "lng"))
    per_seed = gold.groupBy("seed_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "test").alias("test"),
        F.count_if(F.col("label_status") == "derived").alias("derived"), (F.count("*") - F.count_distinct("address_id")).alias("dup"),
    )
    return per_seed.agg(
        F.sum("n").cast("int").alias("rows"), F.sum("dev").cast("int").alias("dev"), F.sum("test").cast("int").alias("test"),
        F.count_if(F.col("n") > 3).cast("int").alias("over_cap"), F.sum("dup").cast("int").alias("in_both"), F.sum("derived").cast("int").alias("derived"),
    )


@job(
    "label_status_counts", "EV14",
    "select case when quality = 1 then 'verified' else 'derived' end as label_status, count(*) as rows from labels group by 1",
)
def label_status_counts(spark, sf):
    from waymark.operators.evaluate import label_status_counts as counts

    rows = table(spark, sf, "labels").withColumn("label_status", F.when(F.col("quality") == 1, "verified").otherwise("derived"))
    return counts(rows)


@job(
    "split_overlap", "ST4",
    "select doc_id from (select doc_id from labels where quality = 1 intersect select doc_id from labels where toxic = 0)",
)
def split_overlap(spark, sf):
    from waymark.operators.evaluate import split_overlap as overlap

    rows = table(spark, sf, "labels")
    return overlap(rows.where("quality = 1"), rows.where("toxic = 0"), "doc_id")


@job(
    "corpus_quality", "CG7",
    f"""with {ROLLED} select 0 as dirty_variant_zero, 0 as unit_without_truth, 0 as phone_without_record, 0 as phone_shape, 0 as empty_text, count(*) as rows,
      0 as bad_pincode, 0 as missing_truth, count(*) filter (where variant = 0 and cell is null) as no_cell, 0 as pincode_not_in_text
      from rolled join (select seed_id, cell from seed_rows) using (seed_id)""",
)
def corpus_quality(spark, sf):
    return C.corpus_quality(corpus(spark, sf), Warehouse(spark, sf).table("seeds")).drop("heavy_rows")


# --- stored model responses ---------------------------------------------------

BODY = """concat('{"building": ', case when order_id % 3 = 0 then concat('"', cast(order_id % 300 as string), '"') else cast(order_id % 300 as string) end,
   ', "locality": ', case when order_id % 4 = 0 then 'null' else '"Model Colony {1}"' end, ', "pincode": "', case when order_id % 5 = 0 then '999999' else true_pincode end, '", "extra": 1',
   ', "landmarks": [{"name": " Shiv Mandir ", "relation": "', case when order_id % 2 = 0 then 'Behind' else 'around' end, '", "matched_id": "', case when order_id % 6 = 0 then 'L9' else 'L1' end, '"}, {"name": ""}]',
   ', "field_confidence": {"building": ', case when order_id % 7 = 0 then '0.4' else '1.7' end, ', "locality": 0.9, "other": 0.1}',
   ', "alternatives": [', case when order_id % 9 = 0 then '{"reason": "two readings", "fields": {"city": "Pune"}}' else '' end, ']}')"""

def stored(spark, sf):
    rows = view(spark, sf, "address")
    body = F.expr(BODY.replace("\n", " "))
    return rows.select(
        "order_id", "true_pincode",
        F.when(F.col("order_id") % 10 == 0, "no json here")
        .when(F.col("order_id") % 10 == 1, F.concat(F.lit('{"building": "'), F.col("order_id").cast("string")))
        .otherwise(F.concat(F.lit("Here is the JSON: ```json "), body, F.lit(" ```"))).alias("response"),
    ).withColumns(
        {f: F.lit(None).cast("string") for f in tables.FIELDS if f != "pincode"}
        | {"pincode": F.col("true_pincode"), "candidate_ids": F.array(F.lit("L1"), F.lit("L2"))}
    )


@job(
    "reconcile_responses", "PR15 PR16 PR17",
    f"""with b as (select order_id, true_pincode, order_id % 10 < 2 as failed, cast({BODY.replace(' as string)', ' as varchar)')} as json) as j from address)
    select order_id, failed, case when not failed then j->>'building' end as building, case when not failed then j->>'locality' end as locality, true_pincode as pincode,
      case when failed then '' else case when order_id % 2 = 0 then 'behind' else 'near' end || ':Shiv Mandir:' || case when order_id % 6 = 0 then '' else 'L1' end end as landmarks,
      case when failed then 0 else (case when order_id % 5 = 0 and true_pincode <> '999999' then 1 else 0 end) + (case when order_id % 6 = 0 then 1 else 0 end) end as conflicts,
      case when failed then '' else concat_ws(',', case when order_id % 5 = 0 or order_id % 6 = 0 then 'deterministic_conflict' end, case when order_id % 9 = 0 then 'alternatives_present' end,
        case when order_id % 4 = 3 then 'multi_script' end, case when order_id % 7 = 0 then 'low_field_confidence' end) end as reasons,
      round(case when failed then 0.5E0 when order_id % 7 = 0 then 0.65E0 else 0.95E0 end, 6) as self_confidence from b""",
)
def reconcile_responses(spark, sf):
    rows = R.reconcile(stored(spark, sf))
    rows = rows.withColumn("reasons", F.when(F.col("failed"), F.array().cast("array<string>")).otherwise(R.escalation_reasons(F.col("order_id") % 4 == 3)))
    rows = rows.withColumn("self_confidence", F.round(R.self_confidence(), 6))
    marks = F.transform("model_landmarks", lambda l: F.concat_ws(":", l["relation"], l["name"], F.coalesce(l["matched_id"], F.lit(""))))
    return R.merge_fields(rows).select(
        "order_id", "failed", "building", "locality", "pincode", F.array_join(marks, ";").alias("landmarks"),
        F.size("conflicts").alias("conflicts"), F.array_join("reasons", ",").alias("reasons"), "self_confidence",
    )


# --- dense vectors -------------------------------------------------------------


@job(
    "knn_embeddings", "RT6",
    """with v as (select vec_id, cast(embedding as double[]) as e from embeddings), n as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from v),
    s as (select a.vec_id as query_id, b.vec_id as vec_id, round(list_inner_product(a.e, b.e)/(a.n*b.n), 9) as score from n a join n b on a.vec_id <> b.vec_id)
    select query_id, vec_id, round(score, 6) as score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score > 0) where rank <= 10""",
)
def knn_embeddings(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    return K.knn_cosine(queries, vectors, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# --- files ----------------------------------------------------------------------


@job(
    "directory_round_trip", "SRC1 SRC2 SRC3 SNK1",
    f"""with {sql.OFFICE_ROWS} select pincode, coalesce((min({{'r': type_rank, 'n': name}}) filter (where name <> '')).n, '') as locality,
      round(median(lat),6) as lat, cast(count(*) as integer) as office_count, count(distinct lower(name)) filter (where name <> '') as localities from office_rows group by pincode""",
)
def directory_round_trip(spark, sf):
    """Directory written and read as CSV, both reference tables written and read back."""
    raw, out = scratch(spark, "directory"), scratch(spark, "gazetteer")
    view(spark, sf, "directory").drop("line_no").write.option("header", True).csv(raw)
    rows = G.office_rows(files.read_directory(spark, raw))
    files.write_gazetteer(G.build_gazetteer(rows), G.build_locality_index(rows), out)
    names = files.read_localities(spark, f"{out}/localities").groupBy("pincode").agg(F.count("*").alias("localities"))
    pins = files.read_gazetteer(spark, f"{out}/pincodes").withColumn("locality", F.coalesce("locality", F.lit("")))
    return pins.join(names, "pincode", "left").select("pincode", "locality", "lat", "office_count", F.coalesce("localities", F.lit(0)).alias("localities"))


@job(
    "jsonl_round_trip", "SRC4 SNK2",
    f"with {SEEDS} select seed_id, raw, locality, pincode, lat, lng, cell as digipin from seed_rows",
)
def jsonl_round_trip(spark, sf):
    path = scratch(spark, "seeds")
    seeds = Warehouse(spark, sf).table("seeds").select(
        "seed_id", "raw", "shape", F.struct("sub_locality", "locality", "city", "district", "state", "pincode").alias("truth"),
        F.struct("lat", "lng").alias("geo"), F.col("cell").alias("digipin"),
    )
    files.write_jsonl(seeds, path)
    return files.read_jsonl(spark, path, files.SEEDS).select("seed_id", "raw", "truth.locality", "truth.pincode", "geo.lat", "geo.lng", "digipin")


@job(
    "timeline_round_trip", "SNK5 RT19",
    "select event_id, user_id as order_id, ts, event_type as event from events where cast(ts as date) = (select cast(min(ts) as date) from events)",
)
def timeline_round_trip(spark, sf):
    """Events appended by day; reading one day touches one folder."""
    path = scratch(spark, "timeline")
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("order_id"), "ts", F.col("event_type").alias("event"))
    files.append_timeline(events.where("event_id % 2 = 0"), path)
    files.append_timeline(events.where("event_id % 2 = 1"), path)
    day = events.agg(F.min(F.to_date("ts"))).first()[0]
    return files.read_timeline(spark, path, str(day)).drop("event_date")


@job(
    "bulk_resolve", "SRC7 SNK2 PR13",
    """with sent as (select order_id, order_id % 40 = 3 as refused from address)
    select cast(order_id as varchar) as order_id, refused, (select count(*) from sent where not refused) as done,
      (select count(*) from sent where refused) as quarantined from sent""",
)
def bulk_resolve(spark, sf):
    """CSV in, JSON lines out, with the counts of the job; texts that are too long go to quarantine."""
    from waymark.plans import chain

    w = Warehouse(spark, sf)
    source, out = scratch(spark, "bulk-in"), scratch(spark, "bulk-out")
    raw = F.when(F.col("order_id") % 40 == 3, F.rpad("raw", 2001, "x")).otherwise(F.col("raw")).alias("raw")
    view(spark, sf, "address").select("order_id", raw).write.option("header", True).csv(source)
    counts = files.bulk_resolve(
        spark, source, out, lambda rows: chain.resolve(rows, w.table("gazetteer"), w.table("localities"), None, "A"), chain.split_requests
    )
    written = [
        spark.read.schema("order_id string").json(path).withColumn("refused", F.lit(refused))
        for path, refused in ((out, False), (f"{out}-quarantined", True))
    ]
    return written[0].unionByName(written[1]).select("order_id", "refused", *(F.lit(counts[c]).alias(c) for c in ("done", "quarantined")))
