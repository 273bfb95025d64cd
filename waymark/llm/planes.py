"""Token-id files: blocks of ids transposed into byte planes, each compressed, with an index of chunks."""

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waymark.llm.common import blobs, frugal, text_rows
from waymark.llm.files import create, open_read
from waymark.llm.tokens import shared_ids, word_ids
from waymark.sources.warehouse import scratch, staged

#: File format: magic, chunks (the compressed planes of a block, one after another), index as compressed JSON,
#: its length as little-endian u64, magic.
MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
PLANES = 4


def transposed(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """A block of 32-bit ids as 4 byte planes, least significant first, or 32 bit planes."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, PLANES)
    if bits:
        cells = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(cells[:, b], bitorder="little").tobytes() for b in range(32)]
    return [np.ascontiguousarray(rows[:, p]).tobytes() for p in range(PLANES)]


def restored(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes, of bytes or of bits by their number."""
    if len(planes) == PLANES:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        cells = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        rows = np.packbits(cells, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


class Writer:
    """Writes documents of ids to one file, a block at a time; only the index grows with the file."""

    def __init__(self, out, bits: bool = False):
        self.out, self.bits = out, bits
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.chunks, self.docs, self.n_ids = [], [], 0
        self.squeeze = zstandard.ZstdCompressor(level=3)
        out.write(MAGIC)

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc, len(ids)))
        self.n_ids += len(ids)
        while len(ids):
            take = min(len(ids), BLOCK_IDS - self.n_held)
            self.held.append(ids[:take])
            self.n_held += take
            ids = ids[take:]
            if self.n_held == BLOCK_IDS:
                self._flush()

    def _flush(self) -> None:
        if self.n_held:
            planes = [self.squeeze.compress(p) for p in transposed(np.concatenate(self.held), self.bits)]
            self.chunks.append([self.at, self.n_held, [len(p) for p in planes]])
            self.out.write(b"".join(planes))
            self.at += sum(map(len, planes))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        index = self.squeeze.compress(json.dumps({"block_ids": BLOCK_IDS, "chunks": self.chunks, "docs": self.docs}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()


def read_documents(source):
    """(doc, ids) of each document of an open file, in order, one block in memory beside the document."""
    size = source.size()
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a complete file of id planes")
    (length,) = struct.unpack("<Q", tail[:8])
    source.seek(size - 16 - length)
    expand = zstandard.ZstdDecompressor()
    index = json.loads(expand.decompress(source.read(length)))
    chunks, held, n_held = iter(index["chunks"]), [], 0
    for doc, n in index["docs"]:
        while n_held < n:
            at, n_ids, lengths = next(chunks)
            source.seek(at)
            planes = [expand.decompress(source.read(x)) for x in lengths]
            held.append(restored(planes, n_ids))
            n_held += n_ids
        ids = np.concatenate(held) if held else np.empty(0, np.uint32)
        yield doc, ids[:n]
        held, n_held = [ids[n:]], n_held - n


def write_ids(
    documents: DataFrame, tokenizer: str, folder: str, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = 1, bits: bool = False,
) -> DataFrame:
    """Writes every text's ids and ``end_id`` below ``folder`` in ascending id order; returns the files.

    (``part``, ``path``, ``n_docs``, ``n_ids``, ``start``): one file per range of
    ids, ``start`` the ids in all files before it. A task writes under a name of its
    own, and only files that a finished task reports are listed, so retried and
    duplicate attempts leave no rows. Null ids come first, null texts are empty,
    rows of equal id stand in the order of their text's hash.
    """
    rows = text_rows(documents, id_column, text_column)
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    dealt = dealt.select(F.col("id").cast(stored(rows.schema["id"].dataType.simpleString())).alias("id"), "text")

    def per_part(batches):
        pieces, out = shared_ids(tokenizer), None
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            for doc, ids in zip(batch.column("id").to_pylist(), word_ids(pieces, blobs(batch.column("text")))):
                out = out or Writer(create(path), bits)
                out.add(doc, np.append(ids, np.uint32(end_id)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": [len(out.docs)], "n_ids": [out.n_ids]}
            )

    files = staged(dealt.mapInArrow(frugal(per_part), "part int, path string, n_docs bigint, n_ids bigint"), "id-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def stored(id_type: str) -> str:
    """How ids of a type stand in a file's index: whole numbers and strings as they are, all others as strings."""
    return id_type if id_type in ("tinyint", "smallint", "int", "bigint", "string") else "string"


def read_ids(files: DataFrame, id_type: str = "bigint", id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, ``start``, ``n_tokens``, ``ids_crc32``) of every document of the listed files, and ``ids`` if asked for."""

    def per_file(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                with open_read(path) as source:
                    for doc, ids in read_documents(source):
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
                        start += len(ids)
                        if len(rows) == 4096 or with_ids:
                            yield shaped(rows)
                            rows = []
                if rows:
                    yield shaped(rows)

    schema = f"{id_column} {stored(id_type)}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def shaped(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    fields = to_arrow_schema(StructType.fromDDL(schema))
    found = files.select("path", "start").repartition(max(1, files.count())).mapInArrow(frugal(per_file), schema)
    return found.withColumn(id_column, F.col(id_column).cast(id_type))


def token_files(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the ids of ``documents`` below the shared folder and reads them back, see ``write_ids`` and ``read_ids``."""
    folder = scratch(documents.sparkSession, "ids")
    kind = documents.schema[id_column].dataType.simpleString()
    return read_ids(write_ids(documents, tokenizer, folder, id_column, text_column), kind, id_column)
