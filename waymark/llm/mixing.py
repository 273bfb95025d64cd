"""Mixing sources to target weights by min-cost flow."""

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import picked
from waymark.sources.warehouse import staged

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 4096


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Each source's quota: its weight's part of ``share`` of all sizes, at most ``most`` times its own size.

    What a source cannot take is dealt again among the others by their weights,
    until none is above its limit. Sizes and results are exact fractions.
    """
    left = Fraction(share).limit_denominator(10**6) * sum(sizes.values())
    limit = {s: Fraction(most).limit_denominator(10**6) * n for s, n in sizes.items()}
    out, open_sources = {}, set(sizes)
    while open_sources:
        total = sum(weights[s] for s in open_sources)
        above = {s for s in open_sources if left * weights[s] > limit[s] * total}
        if not above:
            out |= {s: left * weights[s] / total for s in open_sources}
            break
        out |= {s: limit[s] for s in above}
        left -= sum(limit[s] for s in above)
        open_sources -= above
    return out


def min_cost_flow(arcs: list[tuple], source, sink) -> dict[int, int]:
    """Most flow at least cost over arcs (from, to, capacity, cost); arc number → flow.

    Shortest augmenting paths with potentials; costs must not be negative.
    """
    ends, graph = [], {}
    for u, v, capacity, cost in arcs:
        graph.setdefault(u, []).append(len(ends))
        ends.append([v, capacity, cost])
        graph.setdefault(v, []).append(len(ends))
        ends.append([u, 0, -cost])
    height = dict.fromkeys(graph, 0)
    while True:
        far, by = {source: 0}, {}
        queue, tie = [(0, 0, source)], 0
        while queue:
            d, _, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in graph.get(u, ()):
                v, capacity, cost = ends[e]
                step = d + cost + height[u] - height[v]
                if capacity > 0 and (v not in far or step < far[v]):
                    far[v], by[v] = step, e
                    tie += 1
                    heapq.heappush(queue, (step, tie, v))
        if sink not in far:
            return {i: ends[2 * i + 1][1] for i in range(len(arcs))}
        for v in height:
            height[v] += far.get(v, far[sink])
        amount, v = None, sink
        while v != source:
            e = by[v]
            amount = ends[e][1] if amount is None else min(amount, ends[e][1])
            v = ends[e ^ 1][0]
        v = sink
        while v != source:
            e = by[v]
            ends[e][1] -= amount
            ends[e ^ 1][1] += amount
            v = ends[e ^ 1][0]


def routed(patterns: dict[tuple, int], quotas: dict, repeats: int = 2) -> dict[tuple, int]:
    """How many words each membership pattern gives, from ``patterns`` (sources a document belongs to → words).

    A pattern can give its words once for nothing and again at a cost that grows
    with each repetition, so no document is repeated while others are unused. A
    pattern serves any of its sources, up to their quotas.
    """
    arcs, repeat_arcs = [], {}
    for p, words in sorted(patterns.items(), key=str):
        for r in range(repeats):
            repeat_arcs.setdefault(p, []).append(len(arcs))
            arcs.append((("start",), ("pattern", p), words, r * r))
        arcs += [(("pattern", p), ("source", s), words * repeats, 0) for s in p]
    arcs += [(("source", s), ("end",), int(q), 0) for s, q in sorted(quotas.items(), key=str)]
    flow = min_cost_flow(arcs, ("start",), ("end",))
    return {p: sum(flow[i] for i in numbers) for p, numbers in repeat_arcs.items()}


def selected(rows: DataFrame, given: dict[tuple, int], patterns: dict[tuple, int], seed: int) -> DataFrame:
    """Rows (id, key, size, pattern) with ``taken``: every document of a pattern as often as its flow covers it in full.

    What is left of the flow goes to documents in a seeded order, as far as they
    fit one after another. The order is by a hash; its ranges are summed first
    and only the one range of each pattern where the sum is reached is sorted, so
    a pattern that holds a third of all rows is never gathered. What then remains is less
    than one document's size, that of the one that no longer fits; it is filled
    with further documents, see ``filled``.
    """
    spark = rows.sparkSession
    shares = [
        ([None if s is None else str(s) for s in p], given[p] // w, given[p] - given[p] // w * w, w) for p, w in patterns.items() if w
    ]
    plan = spark.createDataFrame(shares, "pattern array<string>, full bigint, rest bigint, words bigint")
    dealt = rows.withColumn("draw", F.xxhash64(F.lit(seed), "id", "size"))
    counts = dealt.where("size > 0").groupBy("pattern").agg(F.count("*").alias("n"))
    ranges = counts.select("pattern", F.expr(f"cast(greatest(0, ceil(log2(n / {RANGE_ROWS}))) as int)").alias("bits"))
    plan = plan.join(ranges, "pattern")
    placed = dealt.join(F.broadcast(plan), "pattern", "left")  # one row per set of sources, as the driver has them
    placed = placed.withColumn("range", F.expr("if(bits = 0, 0L, shiftrightunsigned(draw, 64 - bits))"))
    sums = staged(placed.where("size > 0").groupBy("pattern", "range").agg(F.sum("size").alias("words")), "ranges")
    ahead = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).select("pattern", "range", "ahead", F.col("words").alias("range_words"))
    known = placed.join(sums, ["pattern", "range"], "left")
    # a range is wholly in, wholly out, or holds the end
    inside = F.col("ahead") + F.col("range_words") <= F.col("rest")
    beyond = F.col("ahead") >= F.col("rest")
    even = known.where((F.col("size") == 0) | inside | beyond | F.col("rest").isNull())
    turn = known.where((F.col("size") > 0) & ~inside & ~beyond)
    upto = Window.partitionBy("pattern", "range").orderBy("draw", "id", "key", "size")
    fits = F.col("ahead") + F.sum("size").over(upto) <= F.col("rest")
    more = F.coalesce(inside & (F.col("size") > 0), F.lit(False))
    decided = even.withColumn("more", more).unionByName(turn.withColumn("more", fits))
    columns = ["id", "key", "size", "pattern", "draw", "full", "rest", "more"]
    out = filled(staged(decided.select(*columns).withColumn("at", F.monotonically_increasing_id()), "seeded"))
    taken = F.when(F.col("size") == 0, 0).otherwise(F.col("size") * (F.col("full") + F.col("more").cast("int")))
    return out.select("id", "key", "size", "pattern", taken.alias("taken"))


def fill(left: int, sizes: dict[int, int]) -> dict[int, int]:
    """How many documents of each size fill ``left`` words, the largest first: what stays open is less than any size that is not used up."""
    out = {}
    for size in sorted(sizes, reverse=True):
        if n := min(sizes[size], left // size):
            out[size] = n
            left -= n * size
    return out


def filled(placed: DataFrame) -> DataFrame:
    """``placed`` with ``more`` also for the documents that fill what each pattern still lacks.

    Only counts of the sizes that fit reach the driver, so many per pattern at most as the words of
    the document that did not fit. Of a size the first in seeded order are used: the place of
    the last of them is found by a bounded ranking, and rows up to it are marked.
    """
    spark = placed.sparkSession
    sums = placed.groupBy("pattern").agg(F.max("rest").alias("rest"), F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).alias("used")).collect()
    lacking = [(r["pattern"], r["rest"] - r["used"]) for r in sums if r["rest"] is not None and r["rest"] > r["used"]]
    if not lacking:
        return placed
    unused = placed.where("size > 0 and not more")
    lacks = spark.createDataFrame(lacking, "pattern array<string>, lack bigint")
    sizes = {}
    for r in unused.join(F.broadcast(lacks), "pattern").where("size <= lack").groupBy("pattern", "size").count().collect():
        sizes.setdefault(tuple(r["pattern"]), {})[r["size"]] = r["count"]
    plan = [(list(p), size, n) for p, lack in lacking for size, n in fill(lack, sizes.get(tuple(p), {})).items()]
    if not plan:
        return placed
    place = F.struct("draw", "key", "at")
    ranked = unused.join(F.broadcast(spark.createDataFrame(plan, "pattern array<string>, size bigint, n bigint")), ["pattern", "size"])
    ranked = ranked.withColumn("turn", F.row_number().over(Window.partitionBy("pattern", "size").orderBy(place)))
    last = ranked.where(F.col("turn") <= max(n for *_, n in plan)).where("turn = n").select("pattern", "size", place.alias("last"))
    more = F.col("more") | F.coalesce(place <= F.col("last"), F.lit(False))
    return placed.join(F.broadcast(last), ["pattern", "size"], "left").withColumn("more", more).drop("last")  # a row of the plan each


def mixed(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11,
) -> DataFrame:
    """(id, ``size``, ``source_size``, ``target``, ``taken``) of every row of ``documents``.

    ``size`` counts the words between ASCII white space, null texts have none.
    ``source_column`` is a source or an array of sources; a document in several
    counts to each source's size and can serve any of them, its ``source_size`` and
    ``target`` are those of its first. Sources weigh by their order, null last, and
    share ``share`` of all sizes, see ``targets``. ``taken`` is 0, ``size`` or twice
    it, whole documents; per pattern of sources the sum falls short of what the flow gives it
    by less than the smallest of its documents that could still be taken. Draws depend on seed, id and size only, so reruns agree and rows equal
    in all three are interchangeable. Only per-pattern sums reach the driver: one
    number per set of sources, not per document, and counts of sizes, see ``filled``.
    """
    found = shares(documents, id_column, text_column, source_column, cycle, share, most, seed)
    return found.select(F.col("id").alias(id_column), "size", "source_size", "target", "taken")


def dealt_out(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11,
) -> DataFrame:
    """The mix itself: all columns of every row that ``mixed`` takes, as often as it takes it."""
    found = shares(documents, id_column, text_column, source_column, cycle, share, most, seed).where("taken > 0")
    times = found.groupBy("id", "key").agg(F.sum(F.expr("taken div size")).cast("int").alias("times"))
    once = picked(documents, times, id_column, text_column)
    return once.select("row", F.explode(F.sequence(F.lit(1), "chosen.times"))).select("row.*")


def shares(
    documents: DataFrame, id_column: str, text_column: str, source_column: str, cycle: tuple[int, ...], share: float, most: float, seed: int
) -> DataFrame:
    """What ``mixed`` tells of each row, with its key."""
    spark = documents.sparkSession
    source = F.col(source_column)
    if not documents.schema[source_column].dataType.simpleString().startswith("array"):
        source = F.array(source.cast("string"))
    listed = F.when(F.size(F.coalesce(source, F.array())) > 0, F.array_distinct(source.cast("array<string>"))).otherwise(F.array(F.lit(None).cast("string")))
    rows = staged(
        documents.select(
            F.col(id_column).alias("id"), F.xxhash64(F.col(id_column).isNull(), F.coalesce(F.col(text_column), F.lit(""))).alias("key"),
            F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), listed.alias("pattern")
        ),
        "sizes",
    )
    patterns = {tuple(r["pattern"]): r["words"] for r in rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect()}
    order = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    weights = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    sizes = {s: sum(w for p, w in patterns.items() if s in p) for s in order}
    quotas = targets(sizes, weights, share, most)
    quotas = {s: min(q, Fraction(most).limit_denominator(10**6) * sizes[s]) for s, q in quotas.items()}
    given = routed(patterns, {s: round(q) for s, q in quotas.items()}, int(most))
    facts = spark.createDataFrame([(s, sizes[s], float(quotas[s])) for s in order], "source string, source_size bigint, target double")
    out = selected(rows, given, patterns, seed).withColumn("source", F.col("pattern")[0])
    return out.join(facts, out["source"].eqNullSafe(facts["source"])).select("id", "key", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
