"""SimHash near-dedup: fingerprints of word shingles, compared exactly tile by tile."""

from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blobs, frugal, kept_once, row_key, runs_of, text_rows, word_blocks
from waymark.llm.components import connected
from waymark.sources.warehouse import staged

SEED = 42
TILE_ROWS = 2048
COMPARED_PER_ROW = 4096


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """64 majority bits over the XXH64 of all word shingles; 0 without words.

    A-Z count as a-z, words lie between ASCII white space. Repeated shingles
    count as often as they occur; fewer words than a shingle are one shingle.
    """
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data):
        words = tail + [w.lower() for w in words] if tail else [w.lower() for w in words]
        tail = words[max(0, len(words) - shingle + 1) :]
        if len(words) >= shingle:
            parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            digests = b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED)))
            bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(bits)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(``id``, ``key``, ``fp``): one row per input row, null texts as empty ones, ``fp`` the 64 bits as a signed long."""

    def per_batch(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in blobs(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(fps)], ["id", "key", "fp"])

    rows = text_rows(documents, id_column, text_column).withColumn("key", row_key())
    return rows.mapInArrow(frugal(per_batch), f"id {rows.schema['id'].dataType.simpleString()}, key bigint, fp bigint")


def parts_for(rows: int, radius: int) -> int:
    """Into how many parts the bits are cut for counting, so that a row meets about ``COMPARED_PER_ROW`` others.

    More rows need finer counts. The result of the comparison does not depend on
    it: two fingerprints within the radius never differ by more than the radius
    in the sum of their parts' population counts.
    """
    for parts in (1, 2, 4, 8, 16):
        bits = 64 // parts
        gap = [comb(2 * bits, bits + d) / 4**bits * (2 if d else 1) for d in range(radius + 1)]
        near = [1.0] + [0.0] * radius
        for _ in range(parts):
            near = [sum(near[s - d] * gap[d] for d in range(s + 1)) for s in range(radius + 1)]
        if rows * sum(near) <= COMPARED_PER_ROW:
            break
    return parts


def shifts(parts: int, radius: int) -> np.ndarray:
    """Every change of the parts' counts within the radius, half of each pair of opposites, no change first."""
    found = {(0,) * parts}
    for _ in range(radius):
        found |= {(*x[:i], x[i] + s, *x[i + 1 :]) for x in found for i in range(parts) for s in (1, -1)}
    return np.array(sorted((x for x in found if x >= (0,) * parts), key=lambda x: sum(map(abs, x))), np.int64)


def tile_keys(fps: np.ndarray, parts: int) -> np.ndarray:
    """The population counts of the parts as one number; keys add up as counts do."""
    weights = np.random.default_rng(1).integers(1, 2**63, 16, dtype=np.uint64)[:parts] | np.uint64(1)
    counts = np.bitwise_count((fps[:, None] >> np.arange(0, 64, 64 // parts, dtype=np.uint64)) & np.uint64(2 ** (64 // parts) - 1))
    return (counts.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of one tile that connect what all of them connect."""
    top: dict[int, int] = {}

    def find(x):
        while (y := top.setdefault(x, x)) != x:
            top[x] = top[y]
            x = y
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            top[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def links(classes: DataFrame, radius: int = 2, apart: bool = False) -> DataFrame:
    """Distinct fingerprints ``fp`` → (``a``, ``b``): within each tile, links that connect all pairs within the radius.

    With ``apart``, ``classes`` has a ``node`` and its ``root`` beside a fingerprint, which may repeat: all
    pairs of nodes within the radius whose roots differ are given, whatever else connects them.

    A tile holds the fingerprints whose parts have equal population counts.
    It is compared with itself and with the tiles whose counts differ by no more
    than the radius; all other tile pairs are skipped, none of their pairs can be
    near. Large tiles are cut into blocks of about ``TILE_ROWS`` by a hash, and
    each pair of blocks is a task's work of bounded memory.
    """
    spark = classes.sparkSession
    parts = parts_for(classes.count(), radius)
    moves = shifts(parts, radius)
    held = ["node", "root"] if apart else []

    def expand(batches):
        weights = np.random.default_rng(1).integers(1, 2**63, 16, dtype=np.uint64)[:parts] | np.uint64(1)
        steps = (moves.view(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                fps, *others = (np.asarray(batch.column(c).slice(lo, 4096)) for c in ("fp", *held))
                keys = tile_keys(fps.view(np.uint64), parts)
                met = (keys[:, None] + steps[None, :]).ravel()
                for tiles, times, visits in ((keys, 1, False), (met, len(steps), True)):
                    columns = [tiles.view(np.int64), *(np.repeat(x, times) for x in (fps, *others)), np.full(len(tiles), visits)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["tile", "fp", *held, "visits"])

    def compare(batches):
        for run in runs_of(batches, ["tile", "own_block", "met_block"]):
            visits = np.asarray(run["visits"].combine_chunks())
            fps = np.asarray(run["fp"].combine_chunks()).view(np.uint64)
            here, there = fps[~visits], fps[visits]
            if not len(here) or not len(there):
                continue
            if apart:
                node, root = (np.asarray(run[c].combine_chunks()) for c in held)
                first, second = node[~visits], node[visits]
                for lo in range(0, len(here), 256):
                    hit = np.bitwise_count(here[lo : lo + 256, None] ^ there[None, :]) <= radius
                    i, j = np.nonzero(hit & (root[~visits][lo : lo + 256, None] != root[visits][None, :]))
                    x, y = first[lo + i], second[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
                continue
            same = np.isin(there, here)
            near_a, near_b = [], []
            for lo in range(0, len(here), 256):
                block = here[lo : lo + 256]
                hit = np.bitwise_count(block[:, None] ^ there[None, :]) <= radius
                i, j = np.nonzero(hit)
                x, y = block[i], there[j]
                keep = ~same[j] & (x != y) | (x < y)
                near_a.append(x[keep])
                near_b.append(y[keep])
            kept = forest(np.concatenate(near_a).view(np.int64), np.concatenate(near_b).view(np.int64))
            if kept:
                a, b = zip(*kept)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    tiles = classes.select("fp", *held).mapInArrow(frugal(expand), ", ".join(f"{c} bigint" for c in ("tile", "fp", *held)) + ", visits boolean")
    sizes = tiles.groupBy("tile").agg(F.count(F.when(~F.col("visits"), 1)).alias("own"), F.count(F.when(F.col("visits"), 1)).alias("met"))
    blocks = lambda n: F.ceil(F.col(n) / TILE_ROWS).cast("int")
    sizes = staged(sizes.where("own > 0 and met > 1").select("tile", blocks("own").alias("own_blocks"), blocks("met").alias("met_blocks")), "tiles")
    placed = tiles.join(sizes, "tile")
    side = F.xxhash64("fp", *held)
    own = placed.where("not visits").select(
        "tile", F.pmod(side, F.col("own_blocks")).cast("int").alias("own_block"),
        F.explode(F.sequence(F.lit(0), F.col("met_blocks") - 1)).alias("met_block"), "fp", *held, "visits",
    )
    met = placed.where("visits").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("own_block"),
        F.pmod(side, F.col("met_blocks")).cast("int").alias("met_block"), "fp", *held, "visits",
    )
    key = ["tile", "own_block", "met_block"]
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(met).repartition(count, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(frugal(compare), "a bigint, b bigint")


def grouped(documents: DataFrame, id_column: str, text_column: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, fp), and the ``root`` of each fingerprint's component with its least id."""
    rows = staged(fingerprints(documents, id_column, text_column, shingle), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    found = connected(links(classes, radius))
    return rows, classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, ``fingerprint``, ``component_id``) of every row of ``documents``.

    Fingerprints within ``radius`` bits are linked, and ``component_id`` is the
    smallest id that links lead to, the row's own included. Equal texts share a
    fingerprint and so a component. Texts without words, null ones included, have
    fingerprint zero and are linked like any other. Null ids are rows like
    others but never a component's id; a component of null ids has a null one.
    Repeated rows come back as often as they came in; an empty table gives an
    empty result. Only the two named columns are read.
    """
    rows, rooted = grouped(documents, id_column, text_column, shingle, radius)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(members, "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """All columns of one row of each component of ``near_duplicates``: the one of the smallest id, null ids last."""
    rows, rooted = grouped(documents, id_column, text_column, shingle, radius)
    ranked = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("one")
    best = rows.groupBy("fp").agg(ranked).join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("one").alias("one"))
    return kept_once(documents, best.select("one.id", "one.key"), id_column, text_column)
