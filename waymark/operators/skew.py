"""Joins and order statistics that hold when one key owns much of the data."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list[str], array: Column, *names: str, position: str | None = None) -> DataFrame:
    """One row per element of an array expression.

    A plain explode makes the optimizer copy the whole expression into a
    "not empty" filter below it and compute it twice, nested lambdas and all;
    the outer form with a filter on its output computes it once.
    """
    if position:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, "_e")).where(F.col(position).isNotNull())
    else:
        rows = df.select(*keep, F.explode_outer(array).alias("_e")).where(F.col("_e").isNotNull())
    if len(names) == 1:
        return rows.withColumnRenamed("_e", names[0])
    return rows.select(*keep, *([position] if position else []), *[F.col(f"_e.{n}").alias(n) for n in names])


def shares(df: DataFrame, keys: list[str]) -> dict[int, float]:
    """Hash of each key with more than one shuffle partition's share of the rows → how many such shares it has.

    One pass with a sketch of fixed size, no shuffle of the rows; no more keys than
    there are shuffle partitions come back. The counts are estimates: results never
    depend on them, only how rows are dealt out.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = max(1000, 8 * tasks)
    row = df.select(F.xxhash64(*keys).alias("_h")).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(_h, {min(tasks, tracked)}, {tracked})").alias("top")
    ).first()
    return {t["item"]: t["count"] * tasks / row["n"] for t in row["top"] or () if t["count"] * tasks > row["n"]}


def _cuts(keys: list[str], parts: dict[int, float]) -> Column:
    """Into how many parts a row's key is cut: one, unless it is listed."""
    if not parts:
        return F.lit(1)
    listed = F.create_map(*[F.lit(x) for h, n in sorted(parts.items()) for x in (h, math.ceil(n))])
    return F.coalesce(F.try_element_at(listed, F.xxhash64(*keys)), F.lit(1))


def _part(row: str | list[str], parts: Column) -> Column:
    rows = [row] if isinstance(row, str) else row
    return F.pmod(F.xxhash64(*[F.col(c) for c in rows]), parts).cast("int")


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def salted_join(facts: DataFrame, dims: DataFrame, keys: list[str], row_key: list[str], how: str = "left") -> DataFrame:
    """Join facts to a dimension whose keys are few rows each.

    A key that holds a third of the facts would end up in one task. The facts of a
    key with more than a task's share are spread over as many tasks as it has
    shares, by a hash of ``row_key``, and only that key's dimension rows are
    repeated. All other keys meet as in a plain join.
    """
    hot = shares(facts, keys)
    if not hot:
        return facts.join(dims, keys, how)
    parts = _cuts(keys, hot)
    spread, repeated = facts.withColumn("_salt", _part(row_key, parts)), dims.withColumn("_salt", _every(parts))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], left_row: str, right_row: str) -> DataFrame:
    """Inner join of two sides that may both have many rows of one key.

    A key with more than a task's share of one side is cut there into as many parts
    as it has shares; one that is hot on both sides is cut on each into the square
    root of them, so its pairs of parts are about as many. Rows are repeated for
    the other side's parts only.
    """
    a, b = shares(left, keys), shares(right, keys)
    if not a and not b:
        return left.join(right, keys)
    cut_a = _cuts(keys, {h: n**0.5 if h in b else n for h, n in a.items()})
    cut_b = _cuts(keys, {h: n**0.5 if h in a else n for h, n in b.items()})
    x = left.withColumn("_l", _part(left_row, cut_a)).withColumn("_r", _every(cut_b))
    y = right.withColumn("_r", _part(right_row, cut_b)).withColumn("_l", _every(cut_a))
    return x.join(y, [*keys, "_l", "_r"]).drop("_l", "_r")


def grouped_order_stats(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], width: float
) -> DataFrame:
    """Exact values at given 0-based ranks of every group.

    ``ranks`` maps a result name to a rank expression over the group size
    column ``n``. No group is ever gathered: equal values are counted first,
    the counts are added up per value range of ``width``, the range that holds
    a rank is found from those sums, and only the values in that one range are
    ordered.
    """
    if not keys:
        one = df.withColumn("_all", F.lit(0))
        return grouped_order_stats(one, ["_all"], value, ranks, width).drop("_all")
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_b", F.floor(F.col("_v") / width))
    )
    by_range = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_rc"))
    sizes = by_range.groupBy(*keys).agg(F.sum("_rc").alias("n"))
    running = Window.partitionBy(*keys).orderBy("_b")
    before = (F.sum("_rc").over(running) - F.col("_rc")).alias("_before")
    ranges = by_range.select(*keys, "_b", "_rc", before)
    wanted = sizes.select(
        *keys,
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])
        ).alias("_w"),
    ).select(*keys, "n", F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"))
    hit = wanted.join(ranges, keys, "inner").where(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_rc"))
    )
    inside = Window.partitionBy(*keys, "_b", "_name").orderBy("_v")
    found = (
        counted.join(hit.select(*keys, "_b", "_name", "_rank", "_before", "n"), [*keys, "_b"])
        .withColumn("_upto", F.sum("_c").over(inside) + F.col("_before"))
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    )
    return found.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in ranks],
    )


def grouped_median(df: DataFrame, keys: list[str], value: str, width: float, name: str = "median") -> DataFrame:
    n = F.col("n")
    stats = grouped_order_stats(
        df,
        keys,
        value,
        {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)},
        width,
    )
    return stats.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def nearest_rank(q: float) -> Column:
    """0-based rank of the nearest-rank percentile."""
    n = F.col("n")
    return F.greatest(F.lit(0), F.least(n - 1, F.ceil(F.lit(q) * n) - 1))
