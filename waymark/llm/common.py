"""Helpers of the corpus operators: Arrow columns as bytes, runs of equal keys, bounded Bloom filters."""

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def text_rows(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``text`` of a table, null texts empty; no other column is read."""
    return documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def row_key(text: str = "text") -> Column:
    """With ``id``, tells rows apart; only rows equal in id and text share it."""
    return F.xxhash64(F.col("id").isNull(), F.col(text))


def whole_rows(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(``row``, ``row_id``, ``row_key``): every column of a row in one struct, so that no name of a caller meets one of ours."""
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    key = F.xxhash64(F.col(id_column).isNull(), F.coalesce(F.col(text_column), F.lit("")))
    return documents.select(row, F.col(id_column).alias("row_id"), key.alias("row_key"))


def picked(documents: DataFrame, chosen: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(``row``, ``chosen``): rows of ``documents`` whose id and key are in ``chosen``, one of rows that share both, and what names them there.

    ``chosen`` has ``id`` and ``key``, each pair once; its further columns come along.
    """
    named = chosen.select(F.col("id").alias("chosen_id"), F.col("key").alias("chosen_key"), F.struct(*chosen.columns).alias("chosen"))
    same = F.col("row_id").eqNullSafe(F.col("chosen_id")) & (F.col("row_key") == F.col("chosen_key"))
    joined = whole_rows(documents, id_column, text_column).join(named, same)
    return joined.groupBy("chosen_id", "chosen_key").agg(F.first("row").alias("row"), F.first("chosen").alias("chosen")).select("row", "chosen")


def kept_once(documents: DataFrame, chosen: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Columns of ``documents`` for rows whose id and key are in ``chosen``, one of rows that share both."""
    return picked(documents, chosen, id_column, text_column).select("row.*")


def without(documents: DataFrame, gone: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows of ``documents`` whose id and key are not in ``gone``."""
    out = gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"))
    same = F.col("row_id").eqNullSafe(F.col("gone_id")) & (F.col("row_key") == F.col("gone_key"))
    return whole_rows(documents, id_column, text_column).join(out, same, "left_anti").select("row.*")


def frugal(per_task):
    """``per_task`` over batches, after which a worker gives back the memory that it no longer uses.

    Workers outlive their tasks, and what one stage has allocated would else stay with them in the next.
    """

    def run(batches):
        try:
            yield from per_task(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library: it keeps its own counsel
                pass

    return run


def blobs(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; nulls are empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in blocks of about ``size`` bytes, so a very long text needs bounded memory."""
    at = 0
    while at < len(data):
        end = at + size
        if end >= len(data):
            yield data[at:].split()
            return
        cut = _SPACE.search(data, end)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys as one table each, from batches sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


BLOOM_BITS = 1 << 23


class Bloom:
    """Keys that may be in a set, in a megabyte whatever the size of the set.

    A full filter passes every key, so what follows must stay exact without it.
    It only keeps rows that cannot match out of a shuffle.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> "Bloom":
        """Of a long column: positions are found and merged by Spark, at most ``BLOOM_BITS`` / 32 words come back."""
        spots = [F.expr(f"pmod(xxhash64({column}, {seed}), {BLOOM_BITS})") for seed in (1, 2, 3)]
        words = (
            keys.select(F.explode(F.array(*spots)).alias("spot"))
            .groupBy(F.expr("int(spot div 32)").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(spot % 32))")).alias("mask"))
        ).toArrow()
        bits = np.zeros(BLOOM_BITS // 32, np.uint32)
        bits[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
        return cls(bits)

    def column(self, spark, column: str) -> Column:
        """Whether a row's key may be in the set, as a vectorised test."""
        held = spark.sparkContext.broadcast(self.bits)

        @F.pandas_udf("boolean")
        def passes(a, b, c):
            import pandas as pd

            bits = held.value
            ok = np.ones(len(a), bool)
            for spot in (a, b, c):
                x = spot.to_numpy()
                ok &= (bits[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1
            return pd.Series(ok)

        return passes(*(F.expr(f"pmod(xxhash64({column}, {seed}), {BLOOM_BITS})") for seed in (1, 2, 3)))
