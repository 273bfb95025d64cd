"""Token counts and token ids by the tokenizers library, text by text, each distinct piece encoded once per task."""

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import frugal, text_rows, word_blocks

#: A single space between two visible characters: a byte-level pre-tokenizer always starts a piece there.
SAFE = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")
BATCH_BYTES = 1 << 20
GROUP_PIECES = 1 << 18
KNOWN_PIECES = 1 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Pieces that a normalizer of the steps in ``_LEAVES`` alone gives back as they are.
PLAIN = re.compile(rb"[!-@\[-~]*")
_LEAVES = ({"type": "NFC"}, {"type": "NFKC"}, {"type": "NFD"}, {"type": "NFKD"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def unnormalized(tokenizer):
    """The same tokenizer without its normalizer, if that changes no ``PLAIN`` piece, else None."""
    steps = json.loads(tokenizer.to_str())["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    if not steps or any(step not in _LEAVES for step in steps):
        return None
    from tokenizers import Tokenizer, normalizers

    bare = Tokenizer.from_str(tokenizer.to_str())
    bare.normalizer = normalizers.Sequence([])
    return bare


def byte_batches(pieces: list, size: int = BATCH_BYTES):
    """Pieces in batches of about equal bytes."""
    batch, held = [], 0
    for piece in pieces:
        batch.append(piece)
        held += len(piece)
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class Pieces:
    """Results of encoding pieces, kept while a task meets them again; at most ``KNOWN_PIECES`` between groups of texts."""

    def __init__(self, tokenizer, result):
        self.tokenizer, self.result, self.known = tokenizer, result, {}
        self.bare = unnormalized(tokenizer)
        self.marks = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
        normalizer = tokenizer.normalizer
        #: Whether the tokenizer tells A-Z from a-z nowhere, so that pieces may be looked up in lower case.
        self.folds = bool(normalizer) and normalizer.normalize_str(_UPPER) == _UPPER.lower()

    def folded(self, data: bytes) -> bytes:
        """A text with A-Z as a-z, if that changes none of its ids: it must not turn anything into a special token."""
        low = data.lower() if self.folds else data
        return data if any(m in low for m in self.marks) else low

    def learn(self, pieces: set) -> None:
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        new = list(pieces.difference(self.known))
        plain = [p for p in new if isinstance(p, bytes) and PLAIN.fullmatch(p)] if self.bare else []
        other = list(set(new).difference(plain)) if plain else new
        for tokenizer, some in ((self.bare, plain), (self.tokenizer, other)):
            for batch in byte_batches(some):
                texts = [p if isinstance(p, str) else p.decode() for p in batch]
                for piece, got in zip(batch, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                    self.known[piece] = self.result(got)

    def of(self, groups: Iterable[list]) -> Iterator[Iterator]:
        """The results of each list of pieces; lists are encoded together, in groups of some megabytes."""
        held, size = [], 0
        for pieces in groups:
            held.append(pieces)
            size += len(pieces)
            if size >= GROUP_PIECES:
                self.learn(set().union(*held))
                for p in held:
                    yield map(self.known.__getitem__, p)
                held, size = [], 0
        self.learn(set().union(*held))
        for p in held:
            yield map(self.known.__getitem__, p)


@cache
def shared_counts(path: str) -> Pieces:
    """One store of counts per Python worker, which outlives its tasks."""
    return Pieces(load(path), len)


@cache
def shared_ids(path: str) -> Pieces:
    """One store of ids, as the bytes of 32-bit numbers, per Python worker."""
    return Pieces(load(path), id_bytes)


def id_bytes(encoding) -> bytes:
    return array("I", encoding.ids).tobytes()


def byte_level_pieces(text: str) -> list[str]:
    """A text cut before every space that surely starts a piece of a byte-level tokenizer."""
    if _TWO_SPACES.search(text):
        first, *rest = SAFE.split(text)
    else:
        first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


def count_tokens(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512) -> DataFrame:
    """(id, ``n_bytes``, ``n_tokens``, ``over_limit``) of every row, by the byte-level tokenizer file ``tokenizer``.

    Counts are those of the library for the whole text without added tokens, and
    special strings inside a text as it handles them by default. Texts are cut only
    where the pre-tokenizer cuts too, and each distinct piece is encoded once per
    task, in batches balanced by bytes; only lengths leave the function. Null and
    empty texts have no tokens; repeated rows and null ids come back as they are.
    """

    def per_batch(batches):
        pieces = shared_counts(tokenizer)
        for batch in batches:
            counts = list(map(sum, pieces.of(map(byte_level_pieces, batch.column("text").to_pylist()))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = text_rows(documents, id_column, text_column).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(frugal(per_batch), f"id {kind}, n_bytes bigint, n_tokens bigint").select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def word_ids(pieces: Pieces, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Ids of each text for a tokenizer that drops white space and joins nothing across it."""
    def lists():
        for data in texts:
            n = 0
            for words in word_blocks(pieces.folded(data)):
                n += 1
                yield words
            sizes.append(n)

    sizes, found = [], []
    for got in pieces.of(lists()):
        found.append(np.frombuffer(b"".join(got), np.uint32))
        while sizes and sizes[0] <= len(found):
            n = sizes.pop(0)
            yield np.concatenate(found[:n]) if n else np.empty(0, np.uint32)
            del found[:n]
    for n in sizes:
        yield np.concatenate(found[:n]) if n else np.empty(0, np.uint32)
        del found[:n]
