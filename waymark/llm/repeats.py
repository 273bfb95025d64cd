"""Suffix-array dedup: every byte window that occurs again, by a radix sort of suffixes cut off at the window's length.

All suffixes are ordered by most-significant-digit passes, only as deep as the
window, and a group leaves the sort as soon as it holds one suffix; what is equal
after the last pass are exactly the repeated windows. Order itself is of no use
here, so the digits need not be read left to right: any function of the window's
bytes is a digit. They are chosen so that one row can stand for many suffixes.

1. First digit: the least hashed k-gram of the window (its anchor) and where in the
   window it lies. Neighbouring suffixes share an anchor, so one row per anchor is
   sorted. Runs of suffixes whose joint text occurs again are settled at once.
2. Next digits, of anchors that several different runs share: the bytes that a
   block of neighbouring suffixes has in common, at fixed offsets from the anchor.
   Blocks whose joint text occurs again are settled at once.
3. Last digit, of blocks that share those bytes but differ around them: the whole
   window, suffix by suffix. These are the ends of repeated passages.

Hashes are 64 bits wide and each group is told apart by two or more of them.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Bloom, blobs, row_key, text_rows
from waymark.sources.warehouse import staged

SLAB = 1 << 18
RUN = 32
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 20) - 1)
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Slab:
    """Hashes of substrings of some bytes: a polynomial over prefix sums, modulo 2**64."""

    def __init__(self, window: int):
        n = SLAB + 4 * window
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)

    def load(self, data: bytes) -> "Slab":
        values = _BYTES[np.frombuffer(data, np.uint8)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * self.down[: len(data)], out=self.sums[1:])
        return self

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.up[lo])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.up[:n])


def anchors(slab: Slab, data: bytes, window: int, gram: int):
    """(start, anchor, first, last, gram hash, run hash) of each run of suffixes with one anchor.

    Yields arrays per slab; ``anchor``, ``first`` and ``last`` count from the slab's
    start. Slabs begin at fixed places, so memory is bounded and copies are cut alike.
    """
    w, total = window - gram + 1, len(data) - window + 1
    for start in range(0, total, SLAB):
        slab.load(data[start : start + SLAB + window - 1])
        n = min(SLAB, total - start)
        grams = slab.all(gram)
        places = np.full(-(-len(grams) // w) * w, 2**64 - 1, np.uint64)
        places[: len(grams)] = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)  # of equal grams the leftmost
        rows = places.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _PLACE).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [n - 1]])
        anchor = anchor[first]
        shape = ((anchor - first) * 4096 + (last - first)).astype(np.uint64)
        yield start, anchor, first, last, grams[anchor], slab.hash(first, last + window) ^ mixed(shape)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def anchor_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, key, place, gram, run) of every run; ``place`` packs its first suffix, the anchor behind it and its length."""

    def per_batch(batches):
        slab = Slab(window)
        for batch in batches:
            picked, parts = [], []
            for i, data in enumerate(blobs(batch.column("text"))):
                for start, anchor, first, last, grams, runs in anchors(slab, data, window, gram):
                    picked.append(np.full(len(first), i))
                    parts.append((((first + start) << 24) | ((anchor - first) << 12) | (last - first), grams, runs))
            if picked:
                take = pa.array(np.concatenate(picked))
                place, grams, runs = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("key").take(take), pa.array(place), _signed(grams), _signed(runs)],
                    ["id", "key", "place", "gram", "run"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_batch, f"id {kind}, key bigint, place bigint, gram bigint, run bigint")


def block_rows(joined: DataFrame, window: int, run: int) -> DataFrame:
    """Runs of a document cut into blocks at fixed offsets from the anchor.

    ``core`` hashes what all suffixes of a whole block share, ``joint`` the text of
    the block, ``hashes`` the window of each suffix.
    """

    def per_batch(batches):
        slab = Slab(window)
        for batch in batches:
            out = []
            for i, (data, places) in enumerate(zip(blobs(batch.column("text")), batch.column("runs").to_pylist())):
                for x in places:
                    place = x["place"]
                    first, behind, length = place >> 24, place >> 12 & 4095, (place & 4095) + 1
                    slab.load(data[first : first + length - 1 + window])
                    offsets = np.arange(length) - behind
                    numbers = offsets // run
                    cut = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
                    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [length - 1]])
                    block = numbers[lo]
                    begin = block * run + behind
                    cores = slab.hash(begin + run - 1, begin + window) ^ mixed((block + 4096).astype(np.uint64))
                    joint = slab.hash(lo, hi + window) ^ mixed(((lo - begin) * 4096 + hi - lo).astype(np.uint64))
                    hashes = slab.all(window)
                    for a, b, c, j in zip(lo.tolist(), hi.tolist(), cores.view(np.int64).tolist(), joint.view(np.int64).tolist()):
                        out.append((i, c, j, first + a, b - a + 1, x["copies"], hashes[a : b + 1].tobytes()))
            if out:
                picked, cores, joints, lo, n, copies, hashes = zip(*out)
                take = pa.array(picked)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take), batch.column("key").take(take), pa.array(cores, pa.int64()), pa.array(joints, pa.int64()),
                        pa.array(lo, pa.int64()), pa.array(n, pa.int32()), pa.array(copies, pa.int32()), pa.array(hashes, pa.binary()),
                    ],
                    ["id", "key", "core", "joint", "lo", "n", "copies", "hashes"],
                )

    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(per_batch, f"id {kind}, key bigint, core bigint, joint bigint, lo bigint, n int, copies int, hashes binary")


def _unpacked(rows: DataFrame) -> DataFrame:
    """One row per suffix of a block."""

    def per_batch(batches):
        for batch in batches:
            counts = np.asarray(batch.column("n"))
            if not len(counts):
                continue
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            windows = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take), batch.column("key").take(take), batch.column("core").take(take), pa.array(windows),
                    pa.array(np.asarray(batch.column("lo"))[np.asarray(take)] + within), batch.column("copies").take(take),
                ],
                ["id", "key", "core", "window", "lo", "copies"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_batch, f"id {kind}, key bigint, core bigint, window bigint, lo bigint, copies int")


def same_row(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])


def repeated_spans(rows: DataFrame, window: int = 400) -> DataFrame:
    """(id, key, lo, hi): spans of rows (id, key, text) that together are the bytes of all repeated windows."""
    spark = rows.sparkSession
    gram, run = max(1, window * 8 // 25), max(1, min(RUN, window // 8))
    found = staged(anchor_rows(rows, window, gram), "anchors")
    # first digit: anchors; a run that occurs again is settled, whatever else shares its anchor
    runs = staged(
        found.groupBy("gram", "run").agg(F.count("*").alias("copies"), F.min(F.struct("id", "key", "place")).alias("one")), "runs"
    )
    shared = runs.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1")
    open_runs = staged(
        runs.join(shared.select("gram"), "gram").select("one.*", F.least("copies", F.lit(2)).cast("int").alias("copies")), "open-runs"
    )
    settled = found.join(runs.where("copies > 1").select("gram", "run"), ["gram", "run"]).select(
        "id", "key", F.expr("shiftright(place, 24)").alias("lo"), F.expr(f"shiftright(place, 24) + (place & 4095) + {window}").alias("hi")
    )
    # next digits: blocks of the runs that share an anchor but not their text
    asked = open_runs.withColumn("doc", F.xxhash64("id", "key"))
    mark = Bloom.of(asked.select("doc"), "doc").column(spark, "doc")
    wanted = open_runs.groupBy("id", "key").agg(F.collect_list(F.struct("place", "copies")).alias("runs"))
    texts = rows.withColumn("doc", F.xxhash64("id", "key")).where(mark).drop("doc")
    joined = texts.join(wanted, same_row(texts, wanted)).select(texts["id"], texts["key"], "text", "runs")
    blocks = staged(block_rows(joined, window, run), "blocks")
    kinds = staged(
        blocks.groupBy("core", "joint").agg(
            F.sum("copies").alias("copies"), F.min(F.struct("id", "key", "lo", "n", "hashes")).alias("one")
        ),
        "block-kinds",
    )
    again = blocks.where("copies = 1").join(kinds.where("copies > 1").select("core", "joint"), ["core", "joint"])
    again = again.select("id", "key", "lo", F.expr(f"lo + n - 1 + {window}").alias("hi"))
    # last digit: the windows of blocks that share their core
    close = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1")
    singles = kinds.join(close.select("core"), "core").select(
        "core", "one.*", F.least("copies", F.lit(2)).cast("int").alias("copies")
    )
    windows = staged(_unpacked(singles), "windows")
    twice = windows.groupBy("core", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("core", "window")
    ends = windows.where("copies = 1").join(twice, ["core", "window"]).select("id", "key", "lo", F.expr(f"lo + {window}").alias("hi"))
    return settled.unionByName(again).unionByName(ends)


def merged(spans) -> list[tuple[int, int]]:
    """Spans as maximal runs."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def without_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 400, keep_text: bool = True) -> DataFrame:
    """Every document with the bytes of repeated windows taken out.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere
    else in the table, in the same text or another; overlaps count, strings never
    cross texts, and all are judged on the input. Returns, per input row, the id,
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``
    and, with ``keep_text``, ``kept`` (binary, since a cut may fall inside a
    character). Null texts are empty; texts shorter than the window and unique
    texts come back whole; repeated rows repeat each other and lose all bytes if
    they are long enough; null ids are ids like others; other columns are not read.
    """
    spark = documents.sparkSession
    rows = text_rows(documents, id_column, text_column)
    rows = rows.withColumn("key", row_key())
    spans = staged(repeated_spans(rows, window), "spans")
    per_row = spans.groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    mark = Bloom.of(spans.select(F.xxhash64("id", "key").alias("doc")).distinct(), "doc").column(spark, "doc")
    marked = rows.withColumn("doc", F.xxhash64("id", "key")).withColumn("may", mark)
    whole = marked.where("not may").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if keep_text else []),
    )
    some = marked.where("may").select("id", "key", "text")
    joined = some.join(per_row, same_row(some, per_row), "left").select(some["id"], "text", "spans")

    def cut(batches):
        for batch in batches:
            out = []
            for data, spans in zip(blobs(batch.column("text")), batch.column("spans").to_pylist()):
                gone = merged((x["lo"], x["hi"]) for x in spans or ())
                edges = [0, *(e for s in gone for e in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            if out:
                columns = list(zip(*out))[: 5 if keep_text else 4]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns) + 1]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return whole.unionByName(joined.mapInArrow(cut, whole.schema)).withColumnRenamed("id", id_column)
