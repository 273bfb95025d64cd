"""Hybrid landmark retrieval: lexical, vector and spatial signals, fused by rank."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions import text as X
from waymark.operators import blocks
from waymark.operators.knn import knn_cosine
from waymark.operators.skew import each, salted_join, split_join
from waymark.sources.warehouse import staged

# BM25, fusion and matching constants.
K1, B = 1.2, 0.75
PER_SIGNAL = 20
RRF_K = 60
SIGNAL_WEIGHTS = {"bm25": 1.0, "knn": 1.0, "geo": 0.5}
MIN_AFFINITY = 0.35
EMBEDDING_DIM = 1024
VECTOR_SHARE = 0.85
GEO_RADIUS_M = 3_000.0

CELL_DEG = 0.05
# ranking scores are compared to this many places, so that summation order is no tie-break
SCORE_PLACES = 9


# --- lexical ---------------------------------------------------------------


def postings(docs: DataFrame, doc: str, text: str, asked: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf, doc_len) of every document that has a term, or that has one of the terms ``asked``."""
    # counted before the explode, so that no row carries or reads the whole text again
    counted = docs.select(doc, X.tokens(F.col(text)).alias("_terms")).withColumn("doc_len", F.size("_terms"))
    terms = each(counted, [doc, "doc_len"], F.col("_terms"), "term")
    return (
        (terms if asked is None else terms.join(asked, "term", "left_semi"))
        .groupBy(doc, "term")
        .agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    )


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: n_docs and avg_len."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(X.tokens(F.col(text)))).alias("avg_len"))


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def impacts(post: DataFrame, stats: DataFrame, doc: str) -> DataFrame:
    """Postings with what one query mention of the term adds to the document.

    A common term has as many postings as there are documents, so its postings
    are spread over tasks and its few statistics repeated.
    """
    n_docs, avg_len = stats.select("n_docs").scalar(), stats.select("avg_len").scalar()
    df = document_frequencies(post)
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + (F.lit(1.0 - B) + F.lit(B) * F.col("doc_len") / F.greatest(avg_len, F.lit(1e-9))) * K1
    return salted_join(post, df.select("term", idf.alias("idf")), ["term"], [doc], "inner").select(
        doc, "term", (F.col("idf") * F.col("tf") * (K1 + 1.0) / norm).alias("impact")
    )


def query_terms(queries: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, qtf): repeated query words count again."""
    return (
        each(queries, keys, X.tokens(F.col(text)), "term")
        .groupBy(*keys, "term")
        .agg(F.count("*").alias("qtf"))
    )


def top_k(scored: DataFrame, keys: list[str], score: str, doc: str, k: int = PER_SIGNAL) -> DataFrame:
    """Best ``k`` per key with their 1-based rank; every task keeps ``k`` before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(doc))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def score_terms(terms: DataFrame, weighted: DataFrame, keys: list[str], on: list[str], doc: str, within: bool = False) -> DataFrame:
    """Sum of weights over shared terms per (keys, doc).

    ``terms`` has keys, on, qw; ``weighted`` has on, doc, dw. A common term is
    common on both sides, so both are split; ``within`` a centre only that
    centre's documents have it, and it is the searches that are spread.
    """
    met = salted_join(terms, weighted, on, keys, "inner") if within else split_join(terms, weighted, on, keys[0], doc)
    return (
        met.groupBy(*keys, doc)
        .agg(F.round(F.sum(F.col("qw") * F.col("dw")), SCORE_PLACES).alias("score"))
        .where(F.col("score") > 0)
    )


def bm25(queries: DataFrame, docs: DataFrame, query: str, doc: str, text: str = "text", k: int = PER_SIGNAL) -> DataFrame:
    """Best ``k`` documents per query over all documents. Terms that no query asks for add to no score and are not kept."""
    terms = staged(query_terms(queries, [query], text).withColumnRenamed("qtf", "qw"), "query_terms")
    post = staged(postings(docs, doc, text, terms.select("term").distinct()), "postings")
    weighted = staged(impacts(post, corpus_stats(docs, text), doc), "impacts")
    return pruned_top_terms(terms, weighted.withColumnRenamed("impact", "dw"), query, doc, k)


def pruned_top_terms(queries: DataFrame, weighted: DataFrame, query: str, doc: str, k: int = PER_SIGNAL) -> DataFrame:
    """Best ``k`` documents per query over a whole collection: (query, doc, score, rank).

    ``queries`` has query, term, qw; ``weighted`` has doc, term, dw, all positive. Exact, by the
    bounds of blocks, see :mod:`blocks`.
    """
    return blocks.top_by_terms(queries, weighted, query, doc, k)


def distinct_top_terms(queries: DataFrame, weighted: DataFrame, query: str, doc: str, k: int = PER_SIGNAL) -> DataFrame:
    """As :func:`pruned_top_terms`, with documents of equal terms and weights searched once."""
    parts = weighted.groupBy(F.col(doc).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("term", "dw"))).alias("terms"))
    firsts = staged(blocks.first_of_content(parts, "terms", k), "firsts_by_terms")
    ones = firsts.where(F.col("nth") == 1).select(F.col("doc").alias("one"), F.explode("terms").alias("t")).select("one", "t.term", "t.dw")
    found = staged(pruned_top_terms(queries, ones, query, "one", k).select(F.col(query).alias("query"), "one", "score"), "contents_by_terms")
    return blocks.with_copies(found, firsts, k).select(F.col("query").alias(query), F.col("doc").alias(doc), "score", "rank")


# --- vectors ---------------------------------------------------------------


def gram_bucket(gram: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long") % dim).cast("int")


def gram_sign(gram: Column) -> Column:
    return F.when(F.substring(F.md5(gram), 9, 1).isin(*"89abcdef"), 1.0).otherwise(-1.0)


def embed_trigrams(docs: DataFrame, doc: str, text: str, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Unit vectors in long form, (doc, bucket, w); texts of any length."""
    gram = F.col("gram")
    counted = each(docs, [doc], X.trigrams(F.col(text)), "gram").groupBy(doc, "gram").agg(
        F.count("*").alias("c")
    )
    raw = (
        counted.select(
            doc, gram_bucket(gram, dim).alias("bucket"), (gram_sign(gram) * (F.log(F.col("c")) + 1.0)).alias("v")
        )
        .groupBy(doc, "bucket")
        .agg(F.sum("v").alias("v"))
    )
    norms = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).where(F.col("norm") > 0)
    return raw.join(norms, doc).where(F.col("v") != 0).select(doc, "bucket", (F.col("v") / F.col("norm")).alias("w"))


def with_name_vector(df: DataFrame, text: str, out: str = "vector", dim: int = EMBEDDING_DIM) -> DataFrame:
    """The same vector inside one row, for names: an array of (bucket, w)."""
    grams = F.col("_grams")
    term = lambda g: F.struct(
        gram_bucket(g, dim).alias("bucket"),
        (gram_sign(g) * (F.log(F.size(F.filter(grams, lambda x: x == g)).cast("double")) + 1.0)).alias("v"),
    )
    summed = lambda b: F.struct(
        b.alias("bucket"),
        F.aggregate(
            F.filter("_terms", lambda t: t["bucket"] == b), F.lit(0.0), lambda acc, t: acc + t["v"]
        ).alias("v"),
    )
    return (
        df.withColumn("_grams", X.trigrams(F.col(text)))
        .withColumn("_terms", F.transform(F.array_distinct(grams), term))
        .withColumn("_sums", F.transform(F.array_distinct(F.col("_terms.bucket")), summed))
        .withColumn("_norm", F.sqrt(F.aggregate("_sums", F.lit(0.0), lambda acc, t: acc + t["v"] * t["v"])))
        .withColumn(
            out,
            F.transform(
                F.filter("_sums", lambda t: t["v"] != 0.0),
                lambda t: F.struct(t["bucket"].alias("bucket"), (t["v"] / F.col("_norm")).alias("w")),
            ),
        )
        .drop("_grams", "_terms", "_sums", "_norm")
    )


def distinct_knn(queries: DataFrame, vectors: DataFrame, query: str, doc: str, k: int = PER_SIGNAL) -> DataFrame:
    """Nearest documents by their name vectors (``vector``), with documents of equal vectors searched once: (query, doc, score, rank)."""
    firsts = staged(blocks.first_of_content(vectors.withColumnRenamed(doc, "doc"), "vector", k), "firsts_by_vector")
    ones = firsts.where(F.col("nth") == 1).select("one", "vector")
    found = knn_cosine(queries, ones, k, query, "one", "vector", EMBEDDING_DIM).select(F.col(query).alias("query"), "one", "score")
    return blocks.with_copies(staged(found, "contents_by_vector"), firsts, k).select(F.col("query").alias(query), F.col("doc").alias(doc), "score", "rank")


def embedding_text(name: Column, aliases: Column) -> Column:
    """Name and aliases, each spelling once by its normalised form."""
    parts = F.filter(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda p: X.name_key(p) != "")
    keys = F.transform(parts, X.name_key)
    first = F.filter(parts, lambda p, i: F.array_position(keys, X.name_key(p)) == i + 1)
    return F.array_join(F.transform(first, lambda p: F.trim(p)), " ")


# --- space -----------------------------------------------------------------


def geo_radius_join(
    centres: DataFrame, docs: DataFrame, doc: str, lat: str = "lat", lng: str = "lng"
) -> DataFrame:
    """Documents within each centre's radius: (centre_id, doc, distance_m).

    centres: centre_id, centre_lat, centre_lng, radius_m, one row per centre.
    Both sides meet on grid squares; the distance decides among those.
    """
    around = centres.withColumn(
        "_cell",
        F.explode(geo.cells_within(F.col("centre_lat"), F.col("centre_lng"), F.col("radius_m"), CELL_DEG)),
    )
    placed = docs.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(
        doc,
        F.col(lat).alias("_lat"),
        F.col(lng).alias("_lng"),
        geo.square(F.col(lat), F.col(lng), CELL_DEG).alias("_cell"),
    )
    return (
        split_join(around, placed, ["_cell"], "centre_id", doc)
        .withColumn(
            "distance_m",
            geo.haversine_m(F.col("centre_lat"), F.col("centre_lng"), F.col("_lat"), F.col("_lng")),
        )
        .where(F.col("distance_m") <= F.col("radius_m"))
        .select("centre_id", doc, "distance_m", "radius_m")
    )


def radius_for_query(df: DataFrame) -> DataFrame:
    """Adds centre_lat, centre_lng, radius_m and centre_id.

    A GPS hint is close to the doorstep and keeps the tight radius; a pincode
    centroid gets one that grows with the pincode. No centre, no id.
    """
    hinted = F.col("hint_lat").isNotNull()
    wide = F.greatest(F.lit(GEO_RADIUS_M), geo.centroid_accuracy_m(F.col("office_count")) * 2.5)
    return (
        df.withColumn("centre_lat", F.when(hinted, F.col("hint_lat")).otherwise(F.col("centroid_lat")))
        .withColumn("centre_lng", F.when(hinted, F.col("hint_lng")).otherwise(F.col("centroid_lng")))
        .withColumn("radius_m", F.when(hinted | F.col("centroid_lat").isNull(), F.lit(GEO_RADIUS_M)).otherwise(wide))
        .withColumn(
            "centre_id",
            F.when(
                F.col("centre_lat").isNotNull(),
                F.concat_ws("/", F.col("centre_lat").cast("string"), F.col("centre_lng").cast("string"), F.col("radius_m").cast("string")),
            ),
        )
    )


# --- fusion ----------------------------------------------------------------


def rrf(rankings: DataFrame, keys: list[str], doc: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (keys, signal, doc, rank).

    Adds per (keys, doc): rrf_score, signals (signal to rank), n_signals and
    the fused position.
    """
    weight = X.literal_map(SIGNAL_WEIGHTS)
    best = rankings.groupBy(*keys, "signal", doc).agg(F.min("rank").alias("rank"))
    share = F.coalesce(F.element_at(weight, F.col("signal")), F.lit(1.0)) / (F.col("rank") + k)
    fused = best.groupBy(*keys, doc).agg(
        F.round(F.sum(share), 12).alias("rrf_score"),
        # one entry per signal: three at most
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "rank")))).alias("signals"),
        F.count("*").alias("n_signals"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("rrf_score"), F.desc("n_signals"), F.asc(doc))
    return fused.withColumn("position", F.row_number().over(order))


def normalise_rrf(score: Column, n_signals: Column, k: int = RRF_K) -> Column:
    best = n_signals / F.lit(float(k + 1))
    return F.when(n_signals > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / best))).otherwise(0.0)


def query_text(names: Column, retrieval_text: Column) -> Column:
    """The landmark phrases when there are any, else the whole text."""
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), retrieval_text)


def prepare_landmarks(landmarks: DataFrame) -> dict[str, DataFrame]:
    """What retrieval reads of a landmark table: impacts, vectors, the rows.

    landmarks: landmark_id, canonical_name, aliases, lat, lng, observation_count.
    """
    docs = landmarks.withColumn(
        "search_text", F.array_join(F.concat(F.array("canonical_name"), "aliases"), " ")
    ).withColumn("_text", embedding_text(F.col("canonical_name"), F.col("aliases")))
    docs = with_name_vector(docs, "_text").drop("_text")
    post = postings(docs, "landmark_id", "search_text")
    return {
        "landmarks": docs.drop("search_text"),
        "impacts": impacts(post, corpus_stats(docs, "search_text"), "landmark_id"),
    }


def hybrid_retrieve(
    queries: DataFrame, index: dict[str, DataFrame], use_vector: bool = True, use_geo: bool = True
) -> DataFrame:
    """Fused candidates of every query.

    queries: query_id, query_text, centre_id, centre_lat, centre_lng, radius_m;
    a null centre_id searches everywhere. Searches with a centre visit the blocks of
    the squares around it, which score terms, vectors and distance in one pass; searches
    without one visit the blocks that can matter and prune their vectors exactly. Returns query_id, landmark_id,
    rrf_score, signals, n_signals, position, signals_used, distance_m.
    """
    return fused(queries, staged(signal_rankings(queries, index, use_vector, use_geo), "rankings"), index, use_geo)


def signal_rankings(queries: DataFrame, index: dict[str, DataFrame], use_vector: bool = True, use_geo: bool = True) -> DataFrame:
    """(query_id, landmark_id, rank, signal): the best landmarks of every query by each signal. No signal's ranks depend on another."""
    landmarks, weighted = index["landmarks"], index["impacts"].withColumnRenamed("impact", "dw")
    here = queries.where(F.col("centre_id").isNotNull())
    anywhere = queries.where(F.col("centre_id").isNull())
    ranked = ["query_id", "landmark_id", "rank"]
    no_vector = F.array().cast("array<struct<bucket:int,w:double>>")
    docs = landmarks.select(F.col("landmark_id").alias("doc"), "lat", "lng", (F.col("vector") if use_vector else no_vector).alias("vector"))
    asking = with_name_vector(here, "query_text") if use_vector else here.withColumn("vector", no_vector)
    asking = asking.select(
        F.col("query_id").alias("query"), F.col("centre_id").alias("centre"), F.col("centre_lat").alias("lat"), F.col("centre_lng").alias("lng"),
        F.col("radius_m").alias("radius"), F.transform(X.tokens(F.col("query_text")), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w"))).alias("terms"),
        F.transform("vector", lambda v: F.struct(v["bucket"].alias("bucket"), v["w"].alias("w"))).alias("vector"),
    )
    found, nearest = blocks.around(staged(asking, "searches_here"), blocks.with_parts(docs, weighted, "landmark_id"), PER_SIGNAL, CELL_DEG)
    found = found.select(F.col("query").alias("query_id"), "signal", F.col("doc").alias("landmark_id"), "rank")
    far_terms = query_terms(anywhere, ["query_id"], "query_text").withColumnRenamed("qtf", "qw")
    far = distinct_top_terms(staged(far_terms, "far_terms"), weighted, "query_id", "landmark_id").select(*ranked)
    rankings = found.where(F.col("signal") == "bm25").unionByName(far.withColumn("signal", F.lit("bm25")))
    if use_vector:
        everywhere = distinct_knn(
            with_name_vector(anywhere, "query_text").select("query_id", "vector"), landmarks.select("landmark_id", "vector"), "query_id", "landmark_id"
        )
        rankings = rankings.unionByName(found.where(F.col("signal") == "knn")).unionByName(everywhere.select(*ranked, F.lit("knn").alias("signal")))
    if use_geo:
        by_centre = here.where(F.trim("query_text") != "").select("query_id", "centre_id")
        rankings = rankings.unionByName(
            salted_join(by_centre, nearest.select(F.col("centre").alias("centre_id"), F.col("doc").alias("landmark_id"), "rank"), ["centre_id"], ["query_id"], "inner").select(
                "query_id", F.lit("geo").alias("signal"), "landmark_id", "rank"
            )
        )
    return rankings


def fused(queries: DataFrame, rankings: DataFrame, index: dict[str, DataFrame], use_geo: bool = True) -> DataFrame:
    """Candidates of every query from its written rankings, see :func:`hybrid_retrieve`."""
    landmarks = index["landmarks"]
    fused = rrf(rankings, ["query_id"], "landmark_id")
    used = rankings.groupBy("query_id").agg(F.count_distinct("signal").alias("signals_used"))
    located = queries.select("query_id", "centre_lat", "centre_lng") if use_geo else queries.select(
        "query_id", F.lit(None).cast("double").alias("centre_lat"), F.lit(None).cast("double").alias("centre_lng")
    )
    return (
        fused.join(used, "query_id")
        .join(located, "query_id")
        .join(landmarks.select("landmark_id", "canonical_name", "aliases", "vector", "lat", "lng", "observation_count"), "landmark_id")
        .withColumn(
            "distance_m", geo.haversine_m(F.col("centre_lat"), F.col("centre_lng"), F.col("lat"), F.col("lng"))
        )
        .drop("centre_lat", "centre_lng")
    )


def geo_rank(reach: DataFrame, k: int = PER_SIGNAL) -> DataFrame:
    """Nearest ``k`` of each centre, scored closer is higher."""
    order = Window.partitionBy("centre_id").orderBy("distance_m", "landmark_id")
    return (
        reach.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("score", F.lit(1.0) - F.least(F.lit(1.0), F.col("distance_m") / F.col("radius_m")))
    )


# --- matching --------------------------------------------------------------


def word_set(text: Column) -> Column:
    return F.array_distinct(X.tokens(text))


def set_overlap(own: Column, others: Column) -> Column:
    """Best Jaccard of a set of words against any of the sets in an array."""

    def against(other):
        shared = F.size(F.array_intersect(own, other))
        return F.when(F.size(other) > 0, shared / (F.size(own) + F.size(other) - shared)).otherwise(0.0)

    return F.when(F.size(own) > 0, F.coalesce(F.array_max(F.transform(others, against)), F.lit(0.0))).otherwise(0.0)


def token_overlap(phrase: Column, names: Column) -> Column:
    """Best token Jaccard of a phrase against any of the names."""
    return set_overlap(word_set(phrase), F.transform(names, word_set))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, an array of (bucket, w) and a map of bucket to w."""
    dot = F.aggregate(
        a, F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(F.element_at(b, x["bucket"]), F.lit(0.0))
    )
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def name_affinity(phrase: Column, phrase_vector: Column, names: Column, vector: Column) -> Column:
    """How much a phrase looks like a landmark's name, to 9 places."""
    return set_affinity(word_set(phrase), phrase_vector, F.transform(names, word_set), vector)


def set_affinity(own: Column, phrase_vector: Column, others: Column, vector: Column) -> Column:
    """:func:`name_affinity` of texts whose words are known: a set, and an array of sets."""
    close = F.greatest(F.lit(0.0), sparse_cosine(phrase_vector, vector)) * VECTOR_SHARE
    return F.round(F.greatest(set_overlap(own, others), F.coalesce(close, F.lit(0.0))), SCORE_PLACES)


def greedy_match(pairs: DataFrame, key: str, minimum: float = MIN_AFFINITY) -> DataFrame:
    """One-to-one pairing, strongest first: (key, phrase_pos, landmark_id, affinity).

    pairs: key, phrase_pos, landmark_id, affinity. A key has at most three
    signals' candidates times the phrases of one address, so its pairs fit in
    one small array.
    """
    strongest_first = F.array_sort(
        F.collect_list(
            F.struct((-F.col("affinity")).alias("minus"), "phrase_pos", "landmark_id")
        )
    )
    gathered = pairs.where(F.col("affinity") >= minimum).groupBy(key).agg(strongest_first.alias("_pairs"))
    empty = F.array().cast("array<struct<minus:double,phrase_pos:int,landmark_id:string>>")

    def take(chosen, pair):
        free = ~F.exists(chosen, lambda c: c["phrase_pos"] == pair["phrase_pos"]) & ~F.exists(
            chosen, lambda c: c["landmark_id"] == pair["landmark_id"]
        )
        return F.when(free, F.concat(chosen, F.array(pair))).otherwise(chosen)

    taken = each(gathered, [key], F.aggregate("_pairs", empty, take), "minus", "phrase_pos", "landmark_id")
    return taken.select(key, "phrase_pos", "landmark_id", (-F.col("minus")).alias("affinity"))


def match_score(rrf_score: Column, top_rrf: Column, top_score: Column, affinity: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), rrf_score / top_rrf * top_score * affinity), 4)


def phrase_pairs(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Affinity of every (phrase, candidate) of a query.

    phrases: query_id, phrase_pos, phrase. The candidates of a query are capped
    by the per-signal ranking, so this is a few dozen pairs per phrase.
    """
    # words and maps are made once per phrase and candidate, below the join, not per pair
    named = with_name_vector(phrases, "phrase", "phrase_vector").withColumn("_own", word_set(F.col("phrase")))
    sets = F.transform(F.concat(F.array("canonical_name"), "aliases"), word_set)
    return (
        candidates.withColumns({"_map": F.map_from_entries("vector"), "_others": sets})
        .join(named, "query_id")
        .withColumn("affinity", set_affinity(F.col("_own"), F.col("phrase_vector"), F.col("_others"), F.col("_map")))
        .drop("_map", "_own", "_others")
    )
