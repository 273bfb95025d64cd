"""Questions about earlier and later rows of the same key, safe for hot keys."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import tables
from waymark.operators.retrieval import EMBEDDING_DIM, SCORE_PLACES, with_name_vector
from waymark.operators.skew import each, grouped_order_stats, salted_join
from waymark.sources.warehouse import staged

NEAR_DUPLICATE_COSINE = 0.97
#: Texts that are compared with as many others at a time. It bounds memory, not results.
MEET_ROWS = 1024


def neighbour_time(
    df: DataFrame, key: str, ts: str, tie: str, target: Column, out: str, after: bool = False, range_s: int = 300
) -> DataFrame:
    """Adds ``out``: time of the nearest earlier (or later) target row of the key.

    A key's history is never walked in one task: the nearest target of each
    time range is found first, ranges are chained per key, and rows are only
    ordered within their range.
    """
    when = F.when(target, F.col(ts))
    best = F.min if after else F.max
    ranged = df.withColumn("_range", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / range_s)).withColumn("_t", when)
    direction = F.desc if after else F.asc
    per_range = ranged.groupBy(key, "_range").agg(best("_t").alias("_best"))
    earlier = Window.partitionBy(key).orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    chained = per_range.withColumn("_outside", best("_best").over(earlier)).drop("_best")
    inside = (
        Window.partitionBy(key, "_range").orderBy(direction(ts), direction(tie)).rowsBetween(Window.unboundedPreceding, -1)
    )
    nearest = F.least if after else F.greatest
    return (
        ranged.withColumn("_inside", best("_t").over(inside))
        .join(chained, [key, "_range"])
        .withColumn(out, nearest("_inside", "_outside"))
        .drop("_range", "_t", "_inside", "_outside")
    )


def nearest_key(key: str) -> Column:
    """A key as a string that joins like any other value when it is null."""
    return F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))


def entry_times(stores: DataFrame, life: Column) -> DataFrame:
    """Of the times ``t`` at which a key ``k`` could store an entry those at which it does: none of its entries was alive.

    Each entry names the next one, the first storing time after its end, and which times
    are entries depends on where that walk begins. A time without any other in the
    ``life`` before it is an entry whatever came earlier. From those on, pointers are
    followed in doubling steps: after n rounds every entry within 2**n steps is
    known. Nodes are dealt out by key and time, so the entries of a hot key are found
    by all tasks, in as many rounds as the logarithm of its longest unbroken chain.
    """
    nodes = staged(stores.distinct(), "storing_times")
    node = F.struct(F.lit(0).alias("probe"), F.col("t").alias("own"))
    probe = F.struct(F.lit(1).alias("probe"), F.col("t").alias("own"))
    both = nodes.select("k", "t", node.alias("n")).unionByName(nodes.select("k", (F.col("t") + life).alias("t"), probe.alias("n")))
    seen = neighbour_time(both, "k", "t", "n", F.col("n.probe") == 0, "next", after=True)
    ahead = seen.where("n.probe = 1 and next is not null").select("k", F.col("n.own").alias("t"), "next")
    before = neighbour_time(nodes.withColumn("n", F.lit(0)), "k", "t", "n", F.lit(True), "before")
    reached = staged(before.where(F.col("before").isNull() | (F.col("before") + life < F.col("t"))).select("k", "t"), "first_entries")
    # a pointer to such an entry tells nothing new
    jumps = staged(ahead.join(reached.withColumnRenamed("t", "next"), ["k", "next"], "left_anti").select("k", "t", "next"), "next_entries")
    while True:
        more = staged(reached.join(jumps, ["k", "t"]).select("k", F.col("next").alias("t")), "further_entries")
        if more.isEmpty():
            return reached
        reached = staged(reached.unionByName(more), "entries")
        twice = jumps.select("k", F.col("t").alias("next"), F.col("next").alias("after"))
        jumps = staged(jumps.join(twice, ["k", "next"]).select("k", "t", F.col("after").alias("next")), "doubled_entries")


def asof_cache_hit(requests: DataFrame, key: str, ts: str, tie: str, resolved: Column, ttl: str) -> DataFrame:
    """Adds cache_hit: an entry stored by an earlier row of the key was still alive.

    A resolved row stores an entry when it misses; a hit stores none and does not
    prolong the one it found. Entries come from ``entry_times``; each row then looks for the
    nearest earlier one, range by range, so no task ever walks a key's history.
    ``tie`` orders rows of one time. Rows of a null key are a key's rows; rows without a time
    neither hit nor store.
    """
    life = F.expr(f"interval {ttl}")
    rows = requests.withColumns(
        {"_k": nearest_key(key), "_at": F.col(ts).cast("timestamp"), "_stores": F.coalesce(resolved, F.lit(False))}
    )
    stores = rows.where("_stores and _at is not null")
    entries = entry_times(stores.select(F.col("_k").alias("k"), F.col("_at").alias("t")), life)
    storing = stores.groupBy("_k", "_at").agg(F.min(tie).alias("_tie"))
    storing = storing.join(entries.select(F.col("k").alias("_k"), F.col("t").alias("_at")), ["_k", "_at"], "left_semi")
    told = rows.where(F.col("_at").isNotNull()).join(storing, ["_k", "_at"], "left")
    found = neighbour_time(told, "_k", "_at", tie, F.col("_stores") & (F.col("_tie") == F.col(tie)), "_stored")
    hit = F.coalesce(F.col("_stored") + life >= F.col("_at"), F.lit(False))
    timeless = requests.where(F.col(ts).isNull()).withColumn("cache_hit", F.lit(False))
    return found.select(*requests.columns, hit.alias("cache_hit")).unionByName(timeless)


def first_in_ttl(events: DataFrame, key: str, ts: str, tie: str, ttl: str) -> DataFrame:
    """Rows that store their key: no kept row of it lies within ``ttl`` before them."""
    return (
        asof_cache_hit(events, key, ts, tie, F.lit(True), ttl).where(~F.col("cache_hit")).drop("cache_hit")
    )


def unanswered(events: DataFrame, key: str, ts: str, tie: str, question: Column, reply: Column, wait: str) -> DataFrame:
    """Questions without a reply of the same key within ``wait``."""
    seen = neighbour_time(events.where(question | reply), key, ts, tie, reply, "_reply", after=True)
    answered = F.coalesce(F.col("_reply") < F.col(ts) + F.expr(f"interval {wait}"), F.lit(False))
    return seen.where(question & ~answered).withColumn(
        "due", F.col(ts) + F.expr(f"interval {wait}")
    ).drop("_reply")


def seen_before(df: DataFrame, key: str, order: str, out: str = "seen") -> DataFrame:
    """Adds how many rows of the key come before each row in hash order.

    ``order`` is a hex digest: its first three digits cut it into ranges that
    are counted first, so a hot key is ranked in thousands of small pieces.
    """
    ranged = df.withColumn("_range", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_range").orderBy(order)
    return (
        ranged.withColumn("_r", F.row_number().over(inside))
        .join(before, [key, "_range"])
        .withColumn(out, (F.col("_before") + F.col("_r") - 1).cast("long"))
        .drop("_range", "_r", "_before")
    )


def near_duplicate_join(
    texts: DataFrame, doc: str, block: str, text: str = "text", threshold: float = NEAR_DUPLICATE_COSINE, known: str | None = None
) -> DataFrame:
    """Best earlier near-duplicate of each text in its block: (doc, other, cosine).

    Earlier are texts of a smaller ``doc``, or with ``known``, a boolean column,
    the known ones to those that are not. Of equally near texts the smallest wins.
    ``texts`` holds each distinct text once, so copies are no pairs. Two unit
    vectors can only reach the threshold when they share a component among
    those that carry all but ``threshold`` of either one's length. Taking the
    rarest components for that, texts meet on few and rare values; those of a small
    block meet as a whole. The bound is exact. Those that meet are compared at once,
    ``MEET_ROWS`` against as many, and only the best of each text leaves a task, so no
    row per pair is ever written.
    """
    side = F.col(known) if known else F.lit(False)
    usable = texts.where(F.col(doc).isNotNull() & F.col(block).isNotNull() & side.isNotNull())
    vectors = staged(with_name_vector(usable, text).select(doc, block, "vector", side.alias("_known")), "near_vectors")
    parts = each(vectors, [doc, block, "_known"], F.col("vector"), "bucket", "w")
    frequency = parts.groupBy("bucket").agg(F.count("*").alias("df"))
    rare_last = Window.partitionBy(doc).orderBy(F.desc("df"), F.desc("bucket"))
    small = vectors.groupBy(block).agg((F.count("*") <= MEET_ROWS).alias("_small"))
    # a vector has a thousand components at most
    prefix = (
        parts.join(frequency, "bucket")
        .withColumn("_rest", F.sum(F.col("w") * F.col("w")).over(rare_last))
        .where(F.col("_rest") >= threshold * threshold - 1e-9)
        .join(small, block)
        .select(doc, block, F.when(F.col("_small"), -1).otherwise(F.col("bucket")).alias("bucket"))
        .distinct()
    )
    prefix = staged(prefix, "near_prefixes")
    met = prefix.groupBy(block, "bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    cut = met.select(block, "bucket", F.ceil(F.col("_n") / MEET_ROWS).cast("int").alias("_cuts"))
    own = F.pmod(F.xxhash64(doc), F.col("_cuts")).cast("int")
    placed = salted_join(prefix, cut, [block, "bucket"], [doc], "inner").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    flat = vectors.select(F.col(doc).alias("_d"), F.col(block).alias("_b"), "_known", "vector.bucket", "vector.w").withColumnsRenamed({"bucket": "at", "w": "weights"})
    kind = dict(texts.dtypes)[doc]
    near = (
        placed.join(flat, (F.col(doc) == F.col("_d")) & (F.col(block) == F.col("_b")))
        .select(F.col(block).alias("block"), "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.col(doc).alias("doc"), "_known", "at", "weights")
        .groupBy("block", "bucket", "x", "y")
        .applyInPandas(lambda rows: _nearest(rows, threshold, known is not None), f"a {kind}, b {kind}, cosine double")
    )
    return (
        near.groupBy("a")
        .agg(F.min(F.struct((-F.col("cosine")).alias("m"), F.col("b"))).alias("_p"))
        .select(F.col("a").alias(doc), F.col("_p.b").alias("other"), (-F.col("_p.m")).alias("cosine"))
    )


def _nearest(rows: pd.DataFrame, threshold: float, known: bool) -> pd.DataFrame:
    """Of texts that meet (own, doc, _known, at, weights) the best earlier one of each between parts ``x`` and ``y``."""
    rows = rows.sort_values("doc", kind="stable")
    docs, place = rows["doc"].to_numpy(), rows["own"].to_numpy()
    order = np.unique(docs, return_inverse=True)[1]
    stored = rows["_known"].to_numpy(dtype=bool)
    m = np.zeros((len(rows), EMBEDDING_DIM))
    m[np.repeat(np.arange(len(rows)), rows["at"].map(len)), np.concatenate(rows["at"].to_list())] = np.concatenate(rows["weights"].to_list())
    x, y = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
    out = [pd.DataFrame({"a": docs[:0], "b": docs[:0], "cosine": np.zeros(0)})]
    for later, earlier in ((x, y),) if x == y else ((x, y), (y, x)):
        i, j = np.flatnonzero(place == later), np.flatnonzero(place == earlier)
        if not len(i) or not len(j):
            continue
        cosine = np.round(m[i] @ m[j].T, SCORE_PLACES)
        comes = ~stored[i, None] & stored[j] if known else order[j] < order[i, None]
        cosine[~comes | (cosine < threshold)] = -np.inf
        best = cosine.argmax(axis=1)  # the first is the smallest
        top = cosine[np.arange(len(i)), best]
        hit = top > -np.inf
        out.append(pd.DataFrame({"a": docs[i[hit]], "b": docs[j[best[hit]]], "cosine": top[hit]}))
    return pd.concat(out)


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Counts of exact hits, near hits and misses; ``level`` is null for a miss."""
    exact = F.count_if(F.col("level") == "exact")
    near = F.count_if(F.col("level") == "near_duplicate")
    return lookups.agg(
        F.count("*").alias("lookups"), exact.alias("exact_hits"), near.alias("near_hits"),
        F.count_if(F.col("level").isNull()).alias("misses"),
        F.coalesce(F.round((exact + near) / F.count("*"), 6), F.lit(0.0)).alias("hit_rate"),
    )


def known_before(matches: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Best match of each address among landmarks first seen before it.

    matches: order_id, ord, landmark_id, affinity; first_seen: landmark_id,
    first_ord. Whether a landmark is known depends on earlier inputs only, so
    the learning curve needs no loop.
    """
    known = salted_join(matches, first_seen, ["landmark_id"], ["order_id"], "inner").where(
        F.col("first_ord") < F.col("ord")
    )
    best = F.min_by("landmark_id", F.struct(-F.col("affinity"), F.col("landmark_id")))
    return known.groupBy("order_id").agg(best.alias("landmark_id"))


def seen_bucket(n: Column) -> Column:
    """The bucket a count falls in; the last has no end."""
    label = F.lit(f"{tables.SEEN_BUCKETS[-1][0]}+")
    for lo, hi in reversed(tables.SEEN_BUCKETS[:-1]):
        label = F.when(n.between(lo, hi), str(lo) if lo == hi else f"{lo}-{hi}").otherwise(label)
    return label


def learning_curve(samples: DataFrame) -> DataFrame:
    """Per bucket of addresses seen before: n, graph hits, median error, coverage.

    samples: seen, from_graph, error_m (null without a point).
    """
    rows = samples.withColumn("bucket", seen_bucket(F.col("seen")))
    n = F.col("n")
    medians = grouped_order_stats(
        rows, ["bucket"], "error_m", {"_lo": F.floor((n - 1) / 2), "_hi": F.floor(n / 2)}, 5.0
    ).select("bucket", F.round((F.col("_lo") + F.col("_hi")) / 2, 1).alias("geo_median_m"))
    return (
        rows.groupBy("bucket")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg(F.col("from_graph").cast("double")), 6).alias("graph_hit_rate"),
            F.round(F.count("error_m") / F.count("*"), 6).alias("geo_coverage"),
        )
        .join(medians, "bucket", "left")
    )
