"""Raw addresses to resolutions, set at a time.

Configuration A uses rules only, R1 adds lexical retrieval, R2 the full hybrid;
with stored model responses among the requests, R1 and R2 also settle with those.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, tables
from waymark.functions import text as X
from waymark.operators import decide as D
from waymark.operators import history as H
from waymark.operators import lookups as L
from waymark.operators import normalise as N
from waymark.operators import placing, responses, retrieval as R, scoring as S
from waymark.operators import parse as P
from waymark.operators.skew import each, salted_join
from waymark.sources.warehouse import staged, widened

CONFIGS = ("A", "R1", "R2")
#: What a request may bring along beside its text.
EXTRAS = {
    "hint_lat": "double", "hint_lng": "double", "geo_lat": "double", "geo_lng": "double", "geo_accuracy_m": "double",
    "response": "string",
}
#: Fixed value: how many candidates a model is shown.
SHOWN = 8


def with_extras(requests: DataFrame) -> DataFrame:
    return requests.withColumns({c: F.lit(None).cast(t) for c, t in EXTRAS.items() if c not in requests.columns})


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) requests, see :func:`parse.valid_request`; half a hint is none that could be accepted."""
    given = F.col("hint_lat").isNotNull() | F.col("hint_lng").isNotNull()
    hint = F.when(given, F.struct(F.col("hint_lat").alias("lat"), F.col("hint_lng").alias("lng")))
    good, bad = P.split_requests(with_extras(requests).withColumn("hint", hint))
    return good.select(requests.columns), bad.select(requests.columns)


def retrieval_queries(parsed: DataFrame) -> DataFrame:
    """Adds query_text, its centre, and query_id: equal searches share one id."""
    names = F.concat(
        F.transform("landmarks", lambda l: l["name"]),
        F.when(F.col("locality").isNotNull(), F.array("locality")).otherwise(F.array().cast("array<string>")),
    )
    asked = R.radius_for_query(parsed).withColumn("query_text", R.query_text(names, F.col("retrieval_text")))
    return asked.withColumn(
        "query_id",
        F.sha2(
            F.concat_ws(
                "\x1f", F.coalesce("centre_id", F.lit("")), F.to_json("landmarks"),
                F.coalesce("locality", F.lit("")), "query_text",
            ),
            256,
        ),
    )


def affinities(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, phrase_pos, landmark_id, affinity) of each phrase of a query, the locality's at -1, with each of its candidates."""
    phrases = each(
        queries, ["query_id"], F.transform("landmarks", lambda l: l["name"]), "phrase", position="phrase_pos"
    ).unionByName(
        queries.where(F.col("locality").isNotNull()).select(
            "query_id", F.lit(-1).alias("phrase_pos"), F.col("locality").alias("phrase")
        )
    )
    return R.phrase_pairs(candidates, phrases).select("query_id", "phrase_pos", "landmark_id", "affinity")


def match_candidates(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per query: its best candidate, matches, anchor, ambiguity and what a model is shown.

    Everything gathered per query is bounded by the per-signal ranking. pairs: :func:`affinities`, written.
    """
    listed = F.struct("position", "landmark_id", "lat", "lng", "observation_count")
    shown = candidates.where(F.col("position") <= SHOWN).groupBy("query_id").agg(F.array_sort(F.collect_list(listed)).alias("shown"))
    taken = R.greedy_match(pairs.where(F.col("phrase_pos") >= 0), "query_id").unionByName(
        R.greedy_match(pairs.where(F.col("phrase_pos") < 0), "query_id")
    )
    top = candidates.where(F.col("position") == 1).select(
        "query_id",
        F.col("rrf_score").alias("top_rrf"),
        R.normalise_rrf(F.col("rrf_score"), F.col("signals_used")).alias("top_score"),
        F.col("observation_count").alias("best_observations"),
    )
    matched = (
        taken.join(candidates.drop("vector", "aliases"), ["query_id", "landmark_id"])
        .join(top, "query_id")
        .withColumn("match_score", R.match_score(F.col("rrf_score"), F.col("top_rrf"), F.col("top_score"), F.col("affinity")))
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "phrase_pos", "landmark_id", "canonical_name", "match_score", "distance_m", "lat", "lng", "observation_count"
                    )
                )
            ).alias("matches")
        )
    )
    affinity = pairs.groupBy("query_id", "landmark_id").agg(F.max("affinity").alias("affinity"))
    rivals = D.find_ambiguity(
        candidates.select("query_id", "landmark_id", "rrf_score", "lat", "lng").join(affinity, ["query_id", "landmark_id"]),
        "query_id",
    )
    separation = S.candidate_separation(candidates, "query_id")
    return (
        top.join(separation, "query_id").join(shown, "query_id").join(matched, "query_id", "left").join(rivals, "query_id", "left")
    )


def unmatched_landmarks() -> Column:
    return F.transform(
        "landmarks",
        lambda l: F.struct(
            F.initcap(l["name"]).alias("name"), l["relation"].alias("relation"),
            F.lit(None).cast("string").alias("matched_id"), F.lit(None).cast("double").alias("match_score"),
            F.lit(None).cast("double").alias("distance_m"),
        ),
    )


def with_matches(df: DataFrame) -> DataFrame:
    """Landmarks with their match, and the landmark the address is placed by.

    The locality's own landmark comes first: the doorstep is inside it, not
    merely near something else.
    """
    named = F.filter("matches", lambda m: m["phrase_pos"] >= 0)
    anchor = F.get(F.filter("matches", lambda m: m["phrase_pos"] < 0), F.lit(0))

    def joined(l, i):
        m = F.get(F.filter("matches", lambda x: x["phrase_pos"] == i), F.lit(0))
        return F.struct(
            F.coalesce(m["canonical_name"], F.initcap(l["name"])).alias("name"),
            l["relation"].alias("relation"),
            m["landmark_id"].alias("matched_id"),
            m["match_score"].alias("match_score"),
            m["distance_m"].alias("distance_m"),
        )

    first = F.get(named, F.lit(0))
    placed_by = F.coalesce("_anchor", "_first")
    return (
        df.withColumn("_anchor", anchor)
        .withColumn("_first", first)
        .withColumn("landmark_relation", F.when(F.col("_anchor").isNotNull(), "inside").otherwise(
            F.get("landmarks", F.col("_first.phrase_pos"))["relation"]))
        .withColumn("_place", placed_by)
        .withColumn("unmatched", unmatched_landmarks())
        .withColumn("landmarks", F.transform("landmarks", joined))
        .withColumn("anchor_id", F.col("_anchor.landmark_id"))
        .withColumn("landmark_lat", F.col("_place.lat"))
        .withColumn("landmark_lng", F.col("_place.lng"))
        .withColumn("landmark_observations", F.col("_place.observation_count"))
        .drop("_anchor", "_first", "_place", "matches")
    )


def without_retrieval(parsed: DataFrame) -> DataFrame:
    kinds = {
        "landmark_relation": "string", "anchor_id": "string", "landmark_lat": "double", "landmark_lng": "double",
        "landmark_observations": "int", "n_candidates": "long", "top_score": "double", "best_observations": "int",
        "separation": "double",
    }
    rival = "struct<landmark_id:string,affinity:double,rrf_score:double,lat:double,lng:double>"
    return (
        parsed.withColumn("landmarks", unmatched_landmarks())
        .withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
        .withColumns({c: F.lit(None).cast(rival) for c in ("best", "rival")})
        .withColumn("degraded", F.lit(False))
    )


def without_response(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "model_confidence": F.lit(None).cast("double"),
            "model_failed": F.lit(False),
            "model_alternatives": F.lit(None).cast(D.READINGS),
            "model_conflicts": F.array().cast("array<string>"),
        }
    )


def with_response(df: DataFrame) -> DataFrame:
    """Settles open fields and landmarks with the stored model response, where a row has one.

    A model names the landmarks itself, by the ids it was shown, so the matcher's
    do not count for such rows, be the response readable or not; the locality's
    own landmark still comes first. Rows without a response stay as they are.
    """
    given = F.col("response").isNotNull()
    shown = F.coalesce("shown", F.array().cast("array<struct<position:int,landmark_id:string,lat:double,lng:double,observation_count:int>>"))
    said = responses.reconcile(df.withColumn("candidate_ids", F.transform(shown, lambda c: c["landmark_id"])))
    said = responses.merge_fields(said)
    used = given & ~F.col("failed")
    named = F.transform(
        "model_landmarks",
        lambda l: F.struct(
            l["name"].alias("name"), l["relation"].alias("relation"), l["matched_id"].alias("matched_id"),
            F.lit(None).cast("double").alias("match_score"), F.lit(None).cast("double").alias("distance_m"),
        ),
    )
    claim = F.when(used, F.get(F.filter("model_landmarks", lambda l: l["matched_id"].isNotNull()), F.lit(0)))
    said = said.withColumn("_claim", claim)
    said = said.withColumn("_place", F.get(F.filter(shown, lambda c: c["landmark_id"] == F.col("_claim.matched_id")), F.lit(0)))
    claimed = {
        "landmark_lat": "_place.lat", "landmark_lng": "_place.lng", "landmark_observations": "_place.observation_count",
        "landmark_relation": "_claim.relation",
    }
    return said.withColumns(
        {
            "model_confidence": F.when(used, responses.self_confidence()),
            "model_failed": given & F.col("failed"),
            "model_alternatives": F.when(used, F.col("alternatives")),
            "model_conflicts": F.when(used, F.col("conflicts")).otherwise(F.array().cast("array<string>")),
            "landmarks": F.when(used & (F.size("model_landmarks") > 0), named).when(given, F.col("unmatched")).otherwise(F.col("landmarks")),
            **{c: F.when(given & F.col("anchor_id").isNull(), F.col(v)).otherwise(F.col(c)) for c, v in claimed.items()},
        }
    ).drop("_claim", "_place", "failed", "conflicts", "alternatives", "field_confidence")


def score_and_decide(df: DataFrame, knots=tables.CALIBRATION_KNOTS, with_model: bool = False) -> DataFrame:
    """The narrow tail: settle, place, encode, score, calibrate, decide, explain."""
    df = df.withColumn(
        "building", P.structured_building(F.col("building"), F.col("block"), F.col("tower"), F.col("floor"))
    ).withColumn("street", F.lit(None).cast("string"))
    df = with_response(df) if with_model else without_response(df)
    df = placing.geocode_cascade(df)
    df = df.withColumn("digipin", geo.grid_cell(F.col("geo.lat"), F.col("geo.lng")))
    df = S.with_penalties(S.with_features(df)).withColumn("raw_confidence", S.raw_score())
    df = df.withColumn("confidence", S.apply_calibration(F.col("raw_confidence"), knots))
    hinted = F.when(F.col("hint_lat").isNotNull(), "searched around the GPS hint, which is not an answer itself")
    conflicts = F.transform("model_conflicts", lambda c: F.concat(F.lit("conflict: "), c))
    return D.evidence(D.decide(df)).withColumn("evidence", F.concat(F.array_compact(F.array(hinted)), conflicts, "evidence"))


RESULT = (
    "status", "confidence", "raw_confidence", "building", "street", "sub_locality", "locality", "city", "district",
    "state", "pincode", "landmarks", "geo", "digipin", "clarification", "alternatives", "evidence", "locality_agrees",
    "state_conflict", "n_candidates", "top_score", "separation", "anchor_id", "phones", "devanagari",
)


def resolve_texts(
    texts: DataFrame, gazetteer: DataFrame, localities: DataFrame, index: dict | None, configs: tuple[str, ...] = ("R2",),
    knots=tables.CALIBRATION_KNOTS, asks: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """By configuration one resolution per ask (ask_id, cache_key and what it brings along); without asks one per text.

    Texts are parsed once for all configurations. Those that search ask the same, so each signal is searched
    once, and a configuration fuses the signals that it uses.
    """
    parsed = L.parse_addresses(texts, gazetteer, localities, "cache_key")
    if asks is None:
        asked, with_model = with_extras(parsed.withColumn("ask_id", F.col("cache_key"))), False
    else:
        asked, with_model = with_extras(salted_join(asks, parsed, ["cache_key"], ["ask_id"], "inner")), "response" in asks.columns
    searching = [c for c in configs if c != "A"]
    if searching and len(configs) > len(searching):
        asked = staged(asked, "parsed")
    out = {"A": score_and_decide(without_retrieval(asked), knots).select("ask_id", *RESULT)} if "A" in configs else {}
    if not searching:
        return out
    asked = staged(retrieval_queries(asked), "asked")
    queries = staged(
        asked.groupBy("query_id").agg(
            *[F.first(c).alias(c) for c in ("query_text", "centre_id", "centre_lat", "centre_lng", "radius_m", "landmarks", "locality")]
        ),
        "searches",
    )
    every = "R2" in searching
    rankings = staged(R.signal_rankings(queries, index, use_vector=every, use_geo=every), "rankings")
    pairs = None
    for config in sorted(searching, reverse=True):
        hybrid = config == "R2"
        used = rankings if hybrid == every else rankings.where(F.col("signal") == "bm25")
        candidates = staged(R.fused(queries, used, index, use_geo=hybrid), "candidates")
        # the lexical candidates are among the hybrid ones
        own = affinities(queries, candidates) if pairs is None else pairs.join(candidates.select("query_id", "landmark_id"), ["query_id", "landmark_id"], "left_semi")
        pairs = staged(own, "phrase_pairs")
        found = match_candidates(candidates, pairs)
        joined = salted_join(asked, found, ["query_id"], ["ask_id"], "left")
        degraded = F.col("centre_id").isNull() if hybrid else F.lit(False)
        out[config] = score_and_decide(with_matches(joined.withColumn("degraded", degraded)), knots, with_model).select("ask_id", *RESULT)
    return out


def cache_entries(requests: DataFrame, resolutions: DataFrame) -> DataFrame:
    """What later requests may be answered with: one RESOLVED resolution per text, with the text.

    Of several the one of the smallest order_id. Rows past their lifetime are the
    caller's to drop, see :func:`orders.ttl_filter`.
    """
    rows = resolutions.where((F.col("status") == "RESOLVED") & ~F.col("cached")).select("order_id", "cache_key", *RESULT)
    texts = N.normalise_addresses(requests.select("order_id", "raw")).select("order_id", "text")
    kept = rows.join(texts, "order_id")
    one = F.min_by(F.struct(*[c for c in kept.columns if c != "cache_key"]), "order_id").alias("_one")
    return kept.groupBy("cache_key").agg(one).select("cache_key", "_one.text", *[f"_one.{c}" for c in RESULT])


def cached_answers(texts: DataFrame, entries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(cache_key, RESULT, cache_level) of the texts that an entry answers, itself or its near duplicate.

    A near duplicate is an entry whose pincode is the last known one in the text,
    at a cosine of ``history.NEAR_DUPLICATE_COSINE`` or more; the nearest counts.
    """
    stored = entries.select("cache_key", *RESULT)
    exact = texts.select("cache_key").join(stored, "cache_key").withColumn("_why", F.lit("answered from the cache: the same address was resolved before"))
    open_texts = texts.join(entries.select("cache_key"), "cache_key", "left_anti")
    asked = L.resolve_pincode(
        open_texts.select("cache_key", "text", P.pincode_tokens(F.col("text")).alias("pincode_candidates")), gazetteer, "cache_key"
    )
    columns = ["cache_key", "text", F.coalesce("pincode", F.lit("")).alias("pincode")]
    pool = asked.select(*columns, F.lit(False).alias("known")).unionByName(entries.select(*columns, F.lit(True).alias("known")))
    pairs = H.near_duplicate_join(pool, "cache_key", "pincode", known="known")
    near = pairs.join(stored.withColumnRenamed("cache_key", "other"), "other").withColumn(
        "_why", F.format_string("answered from the cache: cosine %.3f to an address of the same pincode", "cosine")
    )
    columns = ["cache_key", *[c for c in RESULT if c != "evidence"], F.concat(F.array("_why"), "evidence").alias("evidence")]
    return exact.select(*columns, F.lit("exact").alias("cache_level")).unionByName(near.select(*columns, F.lit("near_duplicate").alias("cache_level")))


def resolve(
    requests: DataFrame, gazetteer: DataFrame, localities: DataFrame, index: dict | None, config: str = "R2",
    knots=tables.CALIBRATION_KNOTS, entries: DataFrame | None = None,
) -> DataFrame:
    """Resolutions of the accepted requests, see :func:`split_requests` for the others.

    requests: order_id, raw and, as far as known, a GPS hint (hint_lat, hint_lng),
    a geocoder's point (geo_lat, geo_lng, geo_accuracy_m) and a stored model
    response. Equal addresses that bring the same along are resolved once. A hint
    moves the search only. Rules alone (A) use no hint and no response.
    entries: :func:`cache_entries`; texts they answer are not resolved again.
    """
    return resolve_each(requests, gazetteer, localities, index, (config,), knots, entries)[config]


def resolve_each(
    requests: DataFrame, gazetteer: DataFrame, localities: DataFrame, index: dict | None, configs: tuple[str, ...] = CONFIGS,
    knots=tables.CALIBRATION_KNOTS, entries: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """:func:`resolve` by configuration; what configurations do alike is done once."""
    brought = lambda config: [c for c in EXTRAS if c in requests.columns and (config != "A" or c.startswith("geo_"))]
    if len({tuple(brought(c)) for c in configs}) > 1:
        rest = tuple(c for c in configs if c != "A")
        return {c: r for some in (("A",), rest) for c, r in resolve_each(requests, gazetteer, localities, index, some, knots, entries).items()}
    used = brought(configs[0])
    good, _ = split_requests(requests)
    brought = F.to_json(F.struct(*used)) if used else F.lit("{}")
    ask = F.when(brought == "{}", F.col("cache_key")).otherwise(F.sha2(F.concat("cache_key", brought), 256))
    normal = staged(
        N.normalise_addresses(widened(good.select("order_id", "raw", *used))).select(
            "order_id", "cache_key", "text", "retrieval_text", "scripts", *used, ask.alias("ask_id")
        ),
        "normal",
    )
    texts = N.distinct_texts(normal)
    hits = None
    if entries is not None:
        hits = staged(cached_answers(staged(texts, "texts"), entries, gazetteer), "hits")
        texts = texts.join(hits.select("cache_key"), "cache_key", "left_anti")
    asks = normal.groupBy("ask_id", "cache_key").agg(*(F.first(c).alias(c) for c in used)) if used else None
    orders = normal.select("order_id", "cache_key", "ask_id")
    out = {}
    for config, resolved in resolve_texts(texts, gazetteer, localities, index, configs, knots, asks).items():
        fresh = salted_join(orders, resolved, ["ask_id"], ["order_id"], "inner").withColumn("cache_level", F.lit(None).cast("string")).drop("ask_id")
        if hits is not None:
            fresh = fresh.unionByName(salted_join(orders.drop("ask_id"), hits, ["cache_key"], ["order_id"], "inner"))
        out[config] = fresh.withColumn("cached", F.col("cache_level").isNotNull())
    return out
