"""Near duplicates by SetSketch: bands of registers propose pairs, a joint likelihood thins them, whole sets decide."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Bloom, blobs, frugal, kept_once, row_key, runs_of, text_rows
from waymark.llm.components import connected
from waymark.llm.decontaminate import Hashes
from waymark.llm.shingles import class_of, shingle_set
from waymark.llm.simhash import fingerprint, forest
from waymark.llm.simhash import links as simhash_links
from waymark.sources.warehouse import staged

#: Texts are linked from this Jaccard similarity on, as a fraction.
SIMILAR = (4, 5)
#: Registers of a sketch, registers of a band. Sets of similarity 0.8 share no band at all in fewer than 1 of 10,000,000 pairs.
REGISTERS, BAND = 200, 5
BANDS = REGISTERS // BAND
#: Registers hold floor(1 - log_BASE h) of the least h of exponential rate RATE, kept within 0 and TOP, so that they fit a byte.
BASE, RATE, TOP = 1.08, 20.0, 255
#: A pair is given up if its registers are exp(UNLIKELY) times likelier at its best similarity than at any of SIMILAR or more.
UNLIKELY = 16.0
#: Members of one head, and shingles of one bucket, that a task compares at a time.
HEAD_ROWS, BLOCK_SHINGLES = 512, 1 << 19
_PAIR = "a bigint, b bigint"
_FACTORS = np.random.default_rng(11).integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)


def sketch(found: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes, as bytes. The sketch of a union is the greater of each register (``merged``)."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for lo in range(0, len(found), 4096):
        np.minimum(least, (found[lo : lo + 4096, None] * _FACTORS).min(axis=0), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint8)


def merged(sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union of the sets that rows of ``sketches`` stand for."""
    return sketches.max(axis=0)


def log_likelihood(more: np.ndarray, fewer: np.ndarray, n: np.ndarray, m: np.ndarray, jaccard: np.ndarray) -> np.ndarray:
    """Of similarity ``jaccard``, where ``more`` registers of a set of n are greater than those of a set of m and ``fewer`` are less.

    A register of the first is greater with probability p(u - v J), where u and v
    are the shares of n and m in n + m and p(x) = -log_BASE(1 - x (BASE - 1) / BASE).
    """
    u = n / (n + m)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    greater, less = p(u - (1 - u) * jaccard), p(1 - u - u * jaccard)
    tiny = 1e-12
    same = np.maximum(1 - greater - less, tiny)
    return more * np.log(np.maximum(greater, tiny)) + fewer * np.log(np.maximum(less, tiny)) + (REGISTERS - more - fewer) * np.log(same)


def _ends(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, float]:
    """The greatest similarity that sets of n and m can have, and the one from which on they are linked."""
    return np.minimum(n, m) / np.maximum(n, m), SIMILAR[0] / SIMILAR[1]


def estimated(more: np.ndarray, fewer: np.ndarray, n: np.ndarray, m: np.ndarray, steps: int = 200) -> np.ndarray:
    """The likeliest similarity of each pair, in steps of its range."""
    most, _ = _ends(n, m)
    grid = most[:, None] * np.linspace(0, 1, steps + 1)
    every = log_likelihood(*(x[:, None] for x in (more, fewer, n, m)), grid)
    return grid[np.arange(len(grid)), every.argmax(axis=1)]


def plausible(more: np.ndarray, fewer: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m with these registers can be similar enough, by the joint likelihood of both sizes and the registers."""
    out = np.zeros(len(more), bool)
    most, least = _ends(n, m)
    fits = np.flatnonzero(SIMILAR[1] * np.minimum(n, m) >= SIMILAR[0] * np.maximum(n, m))
    for lo in range(0, len(fits), 1 << 14):
        at = fits[lo : lo + (1 << 14)]
        parts = [x[at, None].astype(np.float64) for x in (more, fewer, n, m)]
        top = most[at, None]
        linked = log_likelihood(*parts, least + (top - least) * np.linspace(0, 1, 9)).max(axis=1)
        every = log_likelihood(*parts, top * np.linspace(0, 1, 33)).max(axis=1)
        out[at] = linked >= every - UNLIKELY
    return out


def sketched(rows: DataFrame, shingle: int, fingerprints: bool = False) -> DataFrame:
    """Per input row (``id``, ``key``, ``class``, ``n``, ``sketch``, ``fp``): equal sets have equal classes; no words, a null class.

    ``fp`` is the SimHash of the text's shingles, as ``simhash.fingerprints`` has it, if ``fingerprints`` are asked for.
    """

    def per_batch(batches):
        known = Hashes()
        for batch in batches:
            classes, sizes, sketches, prints = [], [], [], []
            for data in blobs(batch.column("text")):
                prints.append(fingerprint(data, shingle) if fingerprints else None)
                found = shingle_set(data, known, shingle)
                sizes.append(len(found))
                classes.append(class_of(found) if len(found) else None)
                sketches.append(sketch(found).tobytes() if len(found) else None)
            prints = pa.array(np.array(prints, np.uint64).view(np.int64)) if fingerprints else pa.nulls(len(prints), pa.int64())
            held = [pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), prints]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *held], ["id", "key", "class", "n", "sketch", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(frugal(per_batch), f"id {kind}, key bigint, class bigint, n bigint, sketch binary, fp bigint")


def posts_of(classes: DataFrame) -> DataFrame:
    """(``bucket``, ``band``, ``class``): a class's band values, each numbered with its band."""
    part = lambda k: F.xxhash64(F.lit(k), F.substring("sketch", BAND * k + 1, BAND))
    bands = F.array(*[F.struct(part(k).alias("bucket"), F.lit(k).alias("band")) for k in range(BANDS)])
    return classes.select("class", F.explode(bands).alias("b")).select("b.bucket", "b.band", "class")


def compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that are plausible by their sketches."""

    def per_batch(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("x", "y"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            yield batch.select(["a", "b"]).filter(pa.array(plausible((x > y).sum(axis=1), (x < y).sum(axis=1), n, m)))

    both = pairs.join(classes.select(F.col("class").alias("a"), "n", F.col("sketch").alias("x")), "a")
    both = both.join(classes.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    p, q = SIMILAR
    fits = q * F.least("n", "m") >= p * F.greatest("n", "m")
    return both.where(fits).select("a", "b", "n", "m", "x", "y").mapInArrow(frugal(per_batch), _PAIR)


def sets_of(wanted: DataFrame, chosen: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(``class``, ``tokens``): the whole sets of the classes ``wanted``, each from the text of one row of it.

    ``chosen`` names that row. Rows that are surely not wanted stop at a filter before they are shuffled.
    """
    spark = texts.sparkSession
    named = staged(wanted.join(chosen, "class").select("class", "id", "key", F.xxhash64("id", "key").alias("spot")), "wanted-sets")
    passes = Bloom.of(named, "spot").column(spark, "spot")
    rows = texts.withColumn("spot", F.xxhash64("id", "key")).where(passes).withColumnRenamed("id", "i")
    same = rows["i"].eqNullSafe(named["id"]) & (rows["key"] == named["key"]) & (rows["spot"] == named["spot"])
    met = rows.join(named, same).groupBy("class").agg(F.first("text").alias("text"))

    def per_batch(batches):
        known = Hashes()
        for batch in batches:
            for i, data in enumerate(blobs(batch.column("text"))):
                tokens = pa.array([shingle_set(data, known, shingle).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("class").slice(i, 1), tokens], ["class", "tokens"])

    return staged(met.mapInArrow(frugal(per_batch), "class bigint, tokens binary"), "shingle-sets")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    p, q = SIMILAR
    if q * min(len(a), len(b)) < p * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum())
    return q * common >= p * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole sets are similar enough. A head ``a`` meets its members in blocks, its set once in each."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / HEAD_ROWS).cast("int").alias("blocks"))
    member = pairs.join(degree, "a").join(sets.withColumnRenamed("class", "b"), "b")
    member = member.select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b", "tokens")
    head = degree.join(sets.withColumnRenamed("class", "a"), "a")
    head = head.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "tokens")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = head.unionByName(member).repartition(tasks, "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def per_task(batches):
        own = None
        for batch in batches:
            keep = []
            for b, tokens in zip(batch.column("b"), batch.column("tokens")):
                found = np.frombuffer(tokens.as_buffer(), np.uint64)
                if not b.is_valid:
                    own = found.copy()
                keep.append(b.is_valid and similar(own, found))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(frugal(per_task), _PAIR)


def open_links(posts: DataFrame, heads: DataFrame, roots: DataFrame, classes: DataFrame, chosen: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Links between classes of one bucket, none its head, that heads have not connected.

    Buckets whose classes are all connected are done. Others are cut into blocks
    by how many shingles they hold; each pair of blocks is a task's work of
    bounded memory, in which a pair is compared in the first band that it shares, and
    links are given as far as they connect anything.
    """
    rest = posts.join(heads.where("classes > 2"), "bucket").where("class <> head").select("bucket", "band", "class")
    sizes = classes.select("class", "n")
    rest = rest.join(roots, rest["class"] == roots["node"], "left").select("bucket", "band", "class", F.coalesce("root", "class").alias("root"))
    rest = staged(rest.join(sizes, "class"), "bucket-roots")
    held = rest.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("total"))
    held = held.where("low < high").select("bucket", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = staged(rest.join(held, "bucket"), "open-buckets")
    sets = sets_of(placed.select("class").distinct(), chosen, texts, shingle)
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    every = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    dealt = every.select("bucket", "band", x, y, "own", "class", "root", "n").join(classes.select("class", "sketch"), "class").join(sets, "class")
    key = ["bucket", "x", "y"]
    tasks = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(*key, "band", "own", "class", "root", "n", "sketch", "tokens").repartition(tasks, *key).sortWithinPartitions(*key)

    def per_task(batches):
        for run in runs_of(batches, key):
            own, x, y, kind, root, n = (run.column(c).to_numpy() for c in ("own", "x", "y", "class", "root", "n"))
            band = run.column("band")[0].as_py()
            registers = np.frombuffer(b"".join(run.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            tokens = run.column("tokens").to_pylist()
            here, there = np.flatnonzero(own == x), np.flatnonzero(own == y)
            if not len(here) or not len(there):
                continue
            first, second = [], []
            for lo in range(0, len(here), 16):
                a = here[lo : lo + 16, None]
                more = (registers[a] > registers[there]).sum(axis=2, dtype=np.int64)
                fewer = (registers[a] < registers[there]).sum(axis=2, dtype=np.int64)
                fits = root[a] != root[there]
                if x[0] == y[0]:
                    fits &= kind[a] < kind[there]
                i, j = np.nonzero(fits)
                i, j = i[near := plausible(more[i, j], fewer[i, j], n[a[i, 0]], n[there[j]])], j[near]
                first.append(a[i, 0])
                second.append(there[j])
            first, second = np.concatenate(first), np.concatenate(second)
            linked = [], []
            for lo in range(0, len(first), 4096):
                a, b = first[lo : lo + 4096], second[lo : lo + 4096]
                shared = (registers[a] == registers[b]).reshape(-1, BANDS, BAND).all(axis=2)
                for p, q in zip(a[shared.argmax(axis=1) == band].tolist(), b[shared.argmax(axis=1) == band].tolist()):
                    if similar(np.frombuffer(tokens[p], np.uint64), np.frombuffer(tokens[q], np.uint64)):
                        linked[0].append(kind[p])
                        linked[1].append(kind[q])
            if kept := forest(np.array(linked[0], np.int64), np.array(linked[1], np.int64)):
                a, b = zip(*kept)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(frugal(per_task), _PAIR)


def simhash_pairs(classes: DataFrame, roots: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): all classes whose fingerprints are within ``radius`` bits, equal ones too, and that ``roots`` have not connected."""
    rooted = classes.select("class", "fp").join(roots, classes["class"] == roots["node"], "left")
    rooted = rooted.select("fp", F.col("class").alias("node"), F.coalesce("root", "class").alias("root"))
    return simhash_links(staged(rooted, "rooted-fingerprints"), radius, apart=True).distinct()


def components(documents: DataFrame, id_column: str, text_column: str, shingle: int, fingerprints: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, class, n, sketch, fp), and (``class``, ``least``, ``root``) of each class that has words."""
    texts = text_rows(documents, id_column, text_column).withColumn("key", row_key())
    rows = staged(sketched(texts, shingle, fingerprints), "sketches")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("one")
    classes = rows.where("class is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("id").alias("least"), F.min("fp").alias("fp"), one)
    classes = staged(classes, "sketch-classes")
    chosen = classes.select("class", "one.id", "one.key")
    posts = posts_of(classes)
    heads = staged(posts.groupBy("bucket").agg(F.min("class").alias("head"), F.count("*").alias("classes")).where("classes > 1"), "bucket-heads")
    ends = lambda pairs: pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    stars = posts.join(heads, "bucket").where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()
    tried = staged(compared(stars, classes), "star-pairs")
    near = staged(confirmed(tried, sets_of(ends(tried), chosen, texts, shingle)), "star-links")
    links = near.unionByName(open_links(posts, heads, connected(near), classes, chosen, texts, shingle))
    if fingerprints:
        links = staged(links, "band-links")
        further = staged(simhash_pairs(classes, connected(links)), "fingerprint-pairs")
        links = links.unionByName(confirmed(further, sets_of(ends(further), chosen, texts, shingle)))
    roots = connected(links)
    return rows, classes.join(roots, classes["class"] == roots["node"], "left").select("class", "least", F.coalesce("root", "class").alias("root"))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 2) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``, ``kept``) of every row of ``documents``.

    A document is the set of its distinct shingles of ``shingle`` words (A-Z count as
    a-z, words lie between ASCII white space, fewer words are one shingle). Documents
    whose sets have a Jaccard similarity of ``SIMILAR`` or more are linked, by their whole
    sets; ``component_id`` is the smallest id that links lead to, the row's own
    included. Texts without words and null texts have an empty set and are linked
    with nothing, not even each other. Null ids are rows like others but never a component's id;
    a component of null ids has a null one. ``kept`` is whether both ids are the same, nulls
    too; rows that repeat an id are kept or not together. Repeated rows come back as often as they
    came in, an empty table gives an empty result. Only the two named columns are read.

    Pairs are proposed by equal bands of sketch registers. Each class of equal sets
    first meets the least one of its buckets, so a large group of near copies is
    connected by as many pairs as it has members; then what shares a bucket and is
    not connected yet is compared in blocks. No bucket is cut short.
    """
    rows, rooted = components(documents, id_column, text_column, shingle)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(named, "root").select("class", "component_id")
    linked = rows.where("class is not null").join(members, "class").select("id", "n", "component_id")
    alone = rows.where("class is null").select("id", "n", F.col("id").alias("component_id"))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return linked.unionByName(alone).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", kept)


def deduplicated(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5) -> DataFrame:
    """All columns of one row of each group of near duplicates: the one of the smallest id, null ids last.

    Groups are as in ``near_duplicates``, of ``shingle`` words, but texts without words are one
    group. All SimHash fingerprints within two bits propose pairs too, of what the bands leave apart; all are
    decided by whole sets, so texts that merely share a fingerprint's bits both stay.
    """
    rows, rooted = components(documents, id_column, text_column, shingle, fingerprints=True)
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("one")
    best = rows.groupBy("class").agg(one).join(rooted.select("class", "root"), "class", "left")  # no words: no class and no root
    best = best.groupBy("root").agg(F.min("one").alias("one"))
    return kept_once(documents, best.select("one.id", "one.key"), id_column, text_column)
