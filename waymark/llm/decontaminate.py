"""Benchmark decontamination by winnowing."""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blobs, frugal, row_key, text_rows, without
from waymark.sources.warehouse import staged

#: Letters a-z, digits and every byte of a non-ASCII character make words; A-Z count as a-z, all else parts them.
_WORD_BYTES = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256)
)
_BLOCK = 1 << 20
_SPACE = re.compile(rb" ")
_STEP = 0xD1342543DE82EF95
KNOWN_WORDS = 1 << 18


def words_in_blocks(data: bytes, overlap: int):
    """(index of the first word, words) in blocks of bounded size that share ``overlap`` words."""
    at, before, tail = 0, 0, []
    while at < len(data) or not at:
        end = at + _BLOCK
        plain = data[at:end].translate(_WORD_BYTES)
        if end < len(data):
            rest = data[end : end + _BLOCK].translate(_WORD_BYTES)
            while (cut := _SPACE.search(rest)) is None and end + len(rest) < len(data):
                rest += data[end + len(rest) : end + len(rest) + _BLOCK].translate(_WORD_BYTES)
            more = cut.start() if cut else len(rest)
            plain, end = plain + rest[:more], end + more
        words = tail + plain.split()
        yield before, words
        tail = words[max(0, len(words) - overlap) :]
        before += len(words) - len(tail)
        at = max(end, 1)


def window_of(data: bytes, longest: int) -> int:
    """``longest``, or the number of all words of a shorter text; reads no further than it must."""
    total = 0
    for before, words in words_in_blocks(data, 0):
        total = before + len(words)
        if total >= longest:
            break
    return min(longest, total)


class Hashes(dict):
    """Hashes of words, of so many at most at a time."""

    def __missing__(self, word):
        if len(self) > KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def split_of(length: int) -> tuple[int, int]:
    """(k, w): the least of w hashed k-grams lies in every span of ``length`` words."""
    k = (length + 1) // 2
    return k, length - k + 1


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(_STEP) + hashes[j : j + len(total)]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def winnowed(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams kept: in each span of ``length`` words the least, of equals the leftmost."""
    k, w = split_of(length)
    if len(hashes) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    found = grams(hashes, k)
    n = len(found) - w + 1
    least, at = found[w - 1 : w - 1 + n].copy(), np.arange(w - 1, w - 1 + n)
    for j in range(w - 2, -1, -1):
        here = found[j : j + n]
        take = here <= least
        least[take], at[take] = here[take], (np.arange(n) + j)[take]
    at = np.unique(at)
    return at, found[at]


def extended(left: str, right: str, other_left: str, other_right: str) -> tuple[int, int]:
    """How many words two contexts share directly before and after a place; lefts are read backwards."""
    counts = []
    for a, b in ((left.split()[::-1], other_left.split()[::-1]), (right.split(), other_right.split())):
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        counts.append(n)
    return counts[0], counts[1]


def _emit(out, i, length, found, places, words, before):
    k, _ = split_of(length)
    reach = length - k
    for h, p in zip(found.view(np.int64).tolist(), places.tolist()):
        left, right = b" ".join(words[max(0, p - reach) : p]), b" ".join(words[p : p + k + reach])
        out.append((i, length, h, before + p, left, right))


def item_rows(rows: DataFrame, longest: int) -> DataFrame:
    """(id, length, hash, left, right) of every kept k-gram of the benchmark, with the words around it.

    ``length`` is the window's: ``longest``, or all words of a shorter item.
    """

    def per_batch(batches):
        known = Hashes()
        for batch in batches:
            out = []
            for i, data in enumerate(blobs(batch.column("text"))):
                length = window_of(data, longest)
                for before, words in words_in_blocks(data, longest) if length else ():
                    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    places, found = winnowed(hashes, length)
                    _emit(out, i, length, found, places, words, before)
            if out:
                picked, lengths, hashes, _, left, right = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(picked)), pa.array(lengths, pa.int32()), pa.array(hashes, pa.int64()),
                        pa.array(left, pa.binary()).cast(pa.string()), pa.array(right, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "length", "hash", "left", "right"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(frugal(per_batch), f"id {kind}, length int, hash bigint, left string, right string")


def document_rows(rows: DataFrame, lengths: list[int], held) -> DataFrame:
    """One row with the word count per document, and one per kept k-gram that the benchmark may have.

    ``held`` is a broadcast filter of fixed size; what passes it wrongly meets no row in the join.
    """

    def per_batch(batches):
        known, bits = Hashes(), held.value
        mask = np.uint64(len(bits) * 32 - 1)
        for batch in batches:
            out, counts = [], []
            for i, data in enumerate(blobs(batch.column("text"))):
                total = 0
                for before, words in words_in_blocks(data, max(lengths, default=1)):
                    total = before + len(words)
                    if not lengths or not words:
                        continue
                    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    for length in lengths:
                        places, found = winnowed(hashes, length)
                        spot = found & mask
                        may = (bits[spot >> np.uint64(5)] >> (spot & np.uint64(31)).astype(np.uint32)) & 1 == 1
                        _emit(out, i, length, found[may], places[may], words, before)
                counts.append(total)
            n = len(counts)
            picked, length, hashes, places, left, right = zip(*out) if out else [()] * 6
            take = pa.array([*range(n), *picked], pa.int64())
            none = [None] * n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take), batch.column("key").take(take), pa.array([*counts, *[None] * len(picked)], pa.int64()),
                    pa.array([*none, *length], pa.int32()), pa.array([*none, *hashes], pa.int64()), pa.array([*none, *places], pa.int64()),
                    pa.array([*none, *left], pa.binary()).cast(pa.string()), pa.array([*none, *right], pa.binary()).cast(pa.string()),
                ],
                ["id", "key", "n_words", "length", "hash", "place", "left", "right"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        frugal(per_batch), f"id {kind}, key bigint, n_words bigint, length int, hash bigint, place bigint, left string, right string"
    )


FILTER_BITS = 1 << 23


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", window: int = 10,
) -> DataFrame:
    """(id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``) of every row of ``documents``.

    Words are runs of ASCII letters (A-Z as a-z), digits and non-ASCII characters.
    A document's word is hit if it lies in an occurrence of any ``window``
    consecutive words of a benchmark text, or of a whole shorter one. Both sides
    keep the least k-gram hash of every window, so each occurrence shares a kept
    k-gram with its item; the join finds it and comparing the words around it, on
    both sides as far as a window can reach, extends it to the occurrence.

    ``items_sha256`` is over the ids of items with a hit, as sorted strings joined by
    commas (empty without any). Null texts have no words; benchmark rows with a
    null id mark words but are not listed; rows that share an item id are one item.
    Repeated rows come back each; an empty benchmark hits nothing.
    """
    found = hit_rows(documents, benchmark, id_column, text_column, item_column, window)
    return found.drop("key").withColumnRenamed("id", id_column)


def clean(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", window: int = 10
) -> DataFrame:
    """The rows of ``documents`` that share no window with the benchmark, see ``contamination``."""
    found = hit_rows(documents, benchmark, id_column, text_column, item_column, window)
    return without(documents, found.where("contaminated").select("id", "key").distinct(), id_column, text_column)


def hit_rows(documents: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str, window: int) -> DataFrame:
    """What ``contamination`` tells of each row, with its key."""
    spark = documents.sparkSession
    items = text_rows(benchmark, item_column, "text")
    kept = staged(item_rows(items, window), "item-grams")
    contexts = staged(kept.groupBy("length", "hash", "left", "right").agg(F.min(F.xxhash64("length", "hash", "left", "right")).alias("context")), "contexts")
    owners = kept.select(F.xxhash64("length", "hash", "left", "right").alias("context"), F.col("id").cast("string").alias("item")).where("item is not null").distinct()
    lengths = sorted(r["length"] for r in contexts.select("length").distinct().collect())
    words = contexts.select(F.expr(f"pmod(hash, {FILTER_BITS})").alias("spot")).groupBy(F.expr("int(spot div 32)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(spot % 32))")).alias("mask")
    ).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
    rows = text_rows(documents, id_column, text_column).withColumn("key", row_key())
    found = staged(document_rows(rows, lengths, spark.sparkContext.broadcast(bits)), "document-grams")
    seen = found.where("length is not null").drop("n_words").distinct()
    met = seen.withColumnsRenamed({"left": "doc_left", "right": "doc_right"}).join(contexts, ["length", "hash"])

    def extend(batches):
        for batch in batches:
            keep, lo, hi = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("length", "place", "doc_left", "doc_right", "left", "right"))
            for i, (length, place, a, b, c, d) in enumerate(zip(*columns)):
                before, after = extended(a, b, c, d)
                if before + after >= length:
                    keep.append(i)
                    lo.append(place - before)
                    hi.append(place + after)
            if keep:
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(take) for c in ("id", "key", "context")] + [pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                    ["id", "key", "context", "lo", "hi"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    hits = staged(met.mapInArrow(frugal(extend), f"id {kind}, key bigint, context bigint, lo bigint, hi bigint"), "hits")
    covered = hits.select("id", "key", "lo", "hi").distinct().groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    covered = covered.select(
        "id", "key",
        F.expr(
            "aggregate(spans, named_struct('n', 0L, 'at', 0L), (s, x) -> named_struct("
            "'n', s.n + greatest(0L, x.hi - greatest(s.at, x.lo)), 'at', greatest(s.at, x.hi)), s -> s.n)"
        ).alias("n_hit"),
    )
    listed = (
        hits.select("id", "key", "context").distinct().join(owners, "context").select("id", "key", "item").distinct()
        .groupBy("id", "key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    docs = found.where("length is null").select("id", "key", "n_words")
    on = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])
    out = docs.join(covered, on(docs, covered), "left").select(docs["id"], docs["key"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"))
    out = out.join(listed, on(out, listed), "left").select(out["id"], out["key"], "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(
        "id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
