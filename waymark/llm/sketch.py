"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph pieces. DataFrame functions only."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import row_key, text_rows
from waymark.sources.warehouse import staged

#: A paragraph is a line; a longer one is cut after every eighth word, so an edit touches few pieces.
PIECE = r"(?:\\S++[^\\S\\n]*+){1,8}+\\n*+"
BASE_SLOTS = 4
ROUNDS = 12
RANGES_PER_PARTITION = 16
SMALL_ROWS = 500_000


def digests(text: str) -> Column:
    """The distinct 64-bit digests of a text's pieces; none for a text without words."""
    return F.expr(f"array_distinct(transform(regexp_extract_all({text}, '{PIECE}', 0), p -> xxhash64(rtrim(p))))")


def base_sketch(column: str) -> Column:
    """The sketch of the smallest size as text: three tables of slots, each with its count, and the sums of its digests and of their checks."""
    slots = []
    for table in range(3):
        for slot in range(BASE_SLOTS):
            own = f"filter({column}, x -> (shiftrightunsigned(x, {table * 8}) & {BASE_SLOTS - 1}) = {slot})"
            slots.append(
                f"aggregate({own}, named_struct('n', 0, 'k', 0L, 'c', 0L), (s, x) -> named_struct("
                f"'n', s.n + 1, 'k', s.k ^ x, 'c', s.c ^ xxhash64(x, 99)), s -> concat_ws('.', hex(s.n), hex(s.k), hex(s.c & 4294967295)))"
            )
    return F.expr(f"concat_ws(':', {', '.join(slots)})")


def _spot(table: int, level: int) -> str:
    return f"cast({table} * room + pmod(xxhash64(digest, {100 * level + table}), room) as int)"


def differences(rows: DataFrame, keys: list[str], pairs: list[tuple[str, str]], level: int = 1, listed: bool = False) -> DataFrame:
    """Per row and pair of digest columns: (keys, ``pair``, ``n_a``, ``n_b``, ``only_a``, ``only_b``, ``failed``).

    If ``listed``, the digests themselves, as they are peeled: (keys, ``pair``, ``side``, ``digest``), side 1 for
    those of the first column only, -1 for those of the second, and a row of side 0 where slots were left.

    Both sides' digests go into three tables of slots, those of the second counted
    off, so what both have cancels out. A slot that holds one digest, told by its
    check, gives it up: it is taken out of its slots in the other tables, which
    may leave one digest there, and so on, one table after the other. ``failed``
    says that slots were left; a larger ``level`` then has twice the room.

    ``rows`` must be partitioned by the first key, so that nothing is shuffled again.
    Each round is a map and a sum by slot, in bounded memory for texts of any length.
    """
    parts, counts = [], []
    for i, (a, b) in enumerate(pairs):
        room = f"cast(ceil(0.75 * {2 ** (level - 1)} * (size({a}) + size({b}))) + 8 as int)"
        parts += [f"transform({side}, x -> struct({i} as pair, {room} as room, x as digest, {sign} as n))" for side, sign in ((a, 1), (b, -1))]
        counts += [f"struct({i} as pair, -{s} as room, 0L as digest, size({side}) as n)" for s, side in ((3, a), (4, b))]
    items = rows.select(*keys, F.expr(f"inline(concat(array({', '.join(counts)}), {', '.join(parts)}))"))
    kept = ["held"] if listed else []  # the digest of a row that tells of one peeled
    cells = items.select(
        *keys, "pair", "room", "n", "digest", *(F.lit(0).cast("long").alias(c) for c in kept),
        F.expr(
            f"explode(if(room < 0, array(room), array({', '.join(_spot(t, level) for t in range(3))})))"
        ).alias("slot"),
    ).select(*keys, "pair", "room", "slot", "n", "digest", *kept, F.expr("if(room < 0, 0L, xxhash64(digest, 99))").alias("proof"))

    def summed(df):
        return df.groupBy(*keys, "pair", "room", "slot", *kept).agg(
            F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("proof").alias("proof")
        ).where("slot < 0 or n <> 0 or digest <> 0 or proof <> 0")

    cells = summed(cells)
    for turn in range(ROUNDS):
        table = turn % 3
        lone = f"slot >= {table} * room and slot < {table + 1} * room and room > 0 and abs(n) = 1 and proof = xxhash64(digest, 99)"
        none, own, same = (", 0L as held", ", digest as held", ", held") if listed else ("", "", "")
        gone = ", ".join(f"struct({_spot(t, level)} as slot, -n as n, digest, proof{none})" for t in range(3) if t != table)
        found = f"struct(if(n > 0, -1, -2) as slot, 1L as n, 0L as digest, 0L as proof{own})"
        cells = summed(
            cells.select(*keys, "pair", "room", F.expr(f"inline(if({lone}, array({found}, {gone}), array(struct(slot, n, digest, proof{same}))))"))
        )
    if listed:
        side = F.expr("case slot when -1 then 1 when -2 then -1 else 0 end")
        return cells.where("slot > -3").select(*keys, "pair", side.alias("side"), F.expr("if(slot < 0, held, null)").alias("digest")).distinct()
    told = lambda slot: F.coalesce(F.sum(F.when(F.col("slot") == slot, F.col("n"))), F.lit(0)).cast("long")
    return cells.groupBy(*keys, "pair").agg(
        told(-3).alias("n_a"), told(-4).alias("n_b"), told(-1).alias("only_a"), told(-2).alias("only_b"),
        (F.count(F.when(F.col("slot") >= 0, 1)) > 0).alias("failed"),
    )


def changed_pieces(versions: DataFrame, id_column: str, before_column: str, after_column: str) -> DataFrame:
    """(id, ``side``, ``digest``): the digests of pieces that only one of two versions of a text has.

    ``side`` is 'removed' for those of the version before, 'added' for those after; a piece that
    both have is in neither, however often. They are what peeling the difference of both sketches
    gives; rows whose sketch is too small are done again with twice the room. Null versions are
    empty; rows of equal id and versions give the same rows once; null ids are ids.
    """
    rows = versions.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(before_column), F.lit("")).alias("before"), F.coalesce(F.col(after_column), F.lit("")).alias("after")
    ).distinct()
    keys = ["id", "before_key", "after_key"]
    sides = rows.select("id", F.xxhash64("before").alias("before_key"), F.xxhash64("after").alias("after_key"), digests("before").alias("a"), digests("after").alias("b"))
    left, found, level = staged(sides, "versions"), [], 1
    while not left.isEmpty():
        told = staged(differences(left.repartition(*keys), keys, [("a", "b")], level, listed=True), "peeled")
        open_rows = told.where("side = 0").select(*keys)
        found.append(told.alias("t").join(open_rows.alias("o"), _same("t", "o", [(k, k) for k in keys]), "left_anti").select("id", "side", "digest"))
        left = staged(left.alias("t").join(open_rows.alias("o"), _same("t", "o", [(k, k) for k in keys]), "left_semi"), "open-versions")
        level += 1
    none = sides.sparkSession.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, side int, digest bigint")
    side = F.when(F.col("side") > 0, "removed").otherwise("added")
    return reduce(DataFrame.unionByName, found, none).select(F.col("id").alias(id_column), side.alias("side"), "digest").distinct()


def likeness() -> Column:
    """Digests in common by digests in either; two texts without any are alike."""
    either = F.col("n_a") + F.col("only_b")
    return F.when(~F.col("failed"), F.when(either == 0, 1.0).otherwise((F.col("n_a") - F.col("only_a")) / either))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (id, key, text) with the id, key and text of the next by (id, key), the first after the last.

    Ranges of the order take the place of one global sort: bounds come from
    quantiles of the id, an id on several bounds is spread by key, and the first row
    of each range also stands, as a ghost, at the end of the range before. Each
    row knows its range and place in it, and comes partitioned by range.
    """
    spark = rows.sparkSession
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)]).alias("cuts")).first()["cuts"] or []
    held = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<bigint>")
    steps = max(1, len(cuts).bit_length())

    def below(test):
        return (
            f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, _) -> if(s.lo >= s.hi, s, "
            f"if(element_at(cuts, int((s.lo + s.hi) div 2) + 1) {test} id, named_struct('lo', int((s.lo + s.hi) div 2) + 1, 'hi', s.hi), "
            "named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2)))), s -> s.lo)"
        )

    dealt = rows.withColumn("cuts", held).withColumn("under", F.expr(f"if(id is null, 0, {below('<')})"))
    dealt = dealt.withColumn("upto", F.expr(f"if(id is null, 0, {below('<=')})")).drop("cuts")
    share = "least(0.999999999999, greatest(0.0, key / 18446744073709551616.0D + 0.5D))"
    dealt = dealt.select("id", "key", "text", F.expr(f"under + int(floor({share} * (upto - under + 1)))").alias("range"))
    firsts = dealt.groupBy("range").agg(F.min(F.struct("id", "key")).alias("first"))
    around = Window.orderBy("range")  # one row per range
    firsts = firsts.select("first.id", "first.key", F.col("range").alias("at"), F.lag("range").over(around).alias("before"), F.max("range").over(Window.partitionBy()).alias("last"))
    firsts = staged(firsts.select("id", "key", "at", F.coalesce("before", "last").alias("before")), "first-rows")
    ghosts = dealt.alias("d").join(
        F.broadcast(firsts.alias("f")), F.expr("d.range = f.at and d.id <=> f.id and d.key = f.key")
    ).select("d.id", "d.key", "d.text", F.col("f.before").alias("range"), F.lit(True).alias("ghost"))
    both = dealt.withColumn("ghost", F.lit(False)).select("id", "key", "text", "range", "ghost").unionByName(ghosts)
    order = Window.partitionBy("range").orderBy("ghost", F.col("id").asc_nulls_first(), "key")
    both = both.repartition(ranges // 2, "range")
    return both.select(
        "range", F.row_number().over(order).alias("place"), "id", "key", "text", "ghost",
        *(F.lead(c).over(order).alias(f"next_{c}") for c in ("id", "key", "text")),
    ).where("not ghost").drop("ghost")


def fingerprinted(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``) of every row.

    The edited text is the row's with its last quarter of characters (rounded down)
    replaced by as many from the start of the next row by id, or by all it has; the
    first row follows the last, and a row alone follows itself. Rows of equal id stand
    in the order of their text's hash; null texts are empty; null ids, which must be
    numbers otherwise, come first. Repeated rows are rows like others.

    ``fingerprint`` is the base sketch. Likeness is what subtracting two sketches
    leaves: digests found on one side only, against all. Sketches have room for what
    two texts may differ in; pairs that do not come out are done again with new
    hashes and twice the room, until none is left. Two texts without pieces are
    alike (1.0).
    """
    spark = documents.sparkSession
    rows = text_rows(documents, id_column, text_column).withColumn("key", row_key())
    placed = in_order(rows).withColumn("cut", F.expr("char_length(text) div 4"))
    placed = placed.withColumn("edited", F.expr("if(cut = 0, text, concat(left(text, int(char_length(text) - cut)), left(next_text, int(cut))))"))
    held = placed.select("range", "place", digests("text").alias("own"), digests("edited").alias("changed"), digests("next_text").alias("following"))
    near = differences(held, ["range", "place"], [("own", "changed"), ("own", "following")])
    near = near.withColumn("near", likeness()).groupBy("range", "place").agg(
        F.max(F.when(F.col("pair") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("pair") == 1, F.col("near"))).alias("near_next")
    )
    facts = placed.select(
        "range", "place", "id", "key", "next_id", "next_key", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests("text").alias("own"), digests("edited").alias("changed"),
    ).withColumn("fingerprint", base_sketch("own")).withColumn("edited_fingerprint", base_sketch("changed")).drop("own", "changed")
    # null-safe, so that no filter comes between the one exchange of the texts and its two readers
    told = facts.alias("o").join(near.alias("g"), _same("o", "g", [("range", "range"), ("place", "place")]), "left")
    told = told.select("o.*", "g.near_edited", "g.near_next").drop("range", "place")
    out = staged(told, "fingerprints")
    pair, values = ["id", "key", "next_id", "next_key"], ["near_edited", "near_next"]
    missing = "near_edited is null or near_next is null"
    found, n, level = [], None, 1
    left = staged(out.where(missing).select(*pair, *values).distinct(), "open-pairs")
    while left.count():
        n, level = n or left.count(), level + 1
        done = _filled(left, _retried(rows, left.select(*pair), level, n), pair, values)
        found.append(staged(done, "retried"))
        left = staged(found[-1].where(missing), "open-pairs")
    if found:
        settled = reduce(DataFrame.unionByName, found).groupBy(*pair).agg(*(F.max(v).alias(v) for v in values))
        out = _filled(out, F.broadcast(settled) if n <= SMALL_ROWS else settled, pair, values)
    return out.select(F.col("id").alias(id_column), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *values)


def _same(a: str, b: str, names: list[str]) -> Column:
    return F.expr(" and ".join(f"{a}.{x} <=> {b}.{y}" for x, y in names))


def _retried(rows: DataFrame, open_pairs: DataFrame, level: int, n: int) -> DataFrame:
    """Likeness of the pairs that did not come out, with sketches of a larger size."""
    wanted = open_pairs.select("id", "key").unionByName(open_pairs.selectExpr("next_id as id", "next_key as key")).distinct()
    wanted = F.broadcast(wanted) if n <= SMALL_ROWS else wanted
    texts = staged(rows.alias("r").join(wanted.alias("w"), _same("r", "w", [("id", "id"), ("key", "key")]), "left_semi").distinct(), "open-texts")
    both = open_pairs.alias("p").join(texts.alias("a"), _same("p", "a", [("id", "id"), ("key", "key")])).join(
        texts.alias("b"), _same("p", "b", [("next_id", "id"), ("next_key", "key")])
    ).select("p.*", "a.text", F.col("b.text").alias("next_text"))
    both = both.withColumn("cut", F.expr("char_length(text) div 4")).withColumn(
        "edited", F.expr("if(cut = 0, text, concat(left(text, int(char_length(text) - cut)), left(next_text, int(cut))))")
    )
    keys = ["id", "key", "next_id", "next_key"]
    held = both.select(*keys, digests("text").alias("own"), digests("edited").alias("changed"), digests("next_text").alias("following"))
    near = differences(held, keys, [("own", "changed"), ("own", "following")], level).withColumn("near", likeness())
    return near.groupBy(*keys).agg(
        F.max(F.when(F.col("pair") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("pair") == 1, F.col("near"))).alias("near_next")
    )


def _filled(out: DataFrame, again: DataFrame, pair: list[str], values: list[str]) -> DataFrame:
    joined = out.alias("o").join(again.alias("g"), _same("o", "g", [(c, c) for c in pair]), "left")
    kept = [F.col(f"o.{c}") for c in out.columns if c not in values]
    return joined.select(*kept, *(F.expr(f"coalesce(o.{c}, g.{c})").alias(c) for c in values))
