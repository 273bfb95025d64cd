"""Cross-tokenizer alignment: groups of two token sequences over the same bytes, found by skipping along diagonals."""

import gc
import hashlib
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import frugal
from waymark.sources.warehouse import staged

#: A single space between two visible characters: both tokenizers always start a token there.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a text that are cut and encoded at a time.
BLOCK = 1 << 18
#: Pieces a task remembers, pieces encoded at a time, entries of a chunk's pair lists. They bound memory, not results.
KNOWN_PIECES, GROUP_CHARS, CHUNK_PAIRS = 1 << 17, 1 << 19, 1 << 21
#: Parts that are encoded in one text.
TOGETHER = 256
#: Links of one group from which on repeated ids are counted instead of listed.
WIDE_GROUP = 4096
PAIR = np.dtype([("code", "<i8"), ("times", "<i8")])


def blocks_of(text: str, size: int = BLOCK) -> Iterator[list[str]]:
    """The parts of a text between safe cuts, without the space that starts each, in blocks of about ``size`` characters."""
    at = 0
    while at <= len(text):
        cut = SAFE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield SAFE.split(text[at:end])
        at = end + 1


class Vocabularies:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = byte_letters()
        held = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(held.values()) + 1)
        for token, i in held.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token))
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = ([str(i) for i in range(len(t))] for t in (self.a_bytes, self.b_bytes))
        #: Whether no token of B goes on with a space after another character, so that texts may be cut at safe places.
        self.cuts = not any("▁" in x.lstrip("▁") for x in names)

    def encoded(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of each part after one space."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + x for x in parts], add_special_tokens=False)]
        return a, self.b.encode(parts, num_threads=1)

    def encoded_together(self, parts: list[str]) -> tuple | None:
        """(parts, A ids, A counts, B ids, B counts) in some order, or None if a part's tokens are not its bytes.

        Parts that begin and end with a visible character are encoded side by side, many in one text,
        as cuts between them are safe; byte ends then tell them apart.
        """
        inner = [x for x in parts if not (x[0].isspace() or x[-1].isspace())]
        outer = [x for x in parts if x[0].isspace() or x[-1].isspace()]
        texts = [" ".join(inner[i : i + TOGETHER]) for i in range(0, len(inner), TOGETHER)] + outer
        parts = inner + outer
        spelled = [(" " + x).encode() for x in parts]
        whole, ends = b"".join(spelled), np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
        a = [x.ids for x in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
        out = [parts]
        for ids, table, sizes in ((a, self.a_bytes, self.a_sizes), (self.b.encode(texts, num_threads=1), self.b_bytes, self.b_sizes)):
            flat = list(chain.from_iterable(ids))
            if b"".join(map(table.__getitem__, flat)) != whole:
                return None
            ids = np.array(flat, np.int64)
            at = np.cumsum(sizes[ids])
            last = np.searchsorted(at, ends)
            if (at[last] != ends).any():
                return None
            out += [ids, np.diff(last, prepend=-1)]
        return tuple(out)

    def same_bytes(self, part: str, a: list[int], b: list[int]) -> bool:
        whole = b" " + part.encode()
        return b"".join(map(self.b_bytes.__getitem__, b)) == whole and b"".join(map(self.a_bytes.__getitem__, a)) == whole


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if printable, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group starts in both sequences, from the tokens' byte ends; both sequences end at the same byte.

    While groups are one token to one token, equal ends lie on one diagonal:
    the shift between both indexes stays. Stretches of it are compared at once,
    twice as long each time, so a long one takes few steps. Where the ends
    differ, both indexes move on, the one that is behind first, until they
    meet again; that is one irregular group, and the shift is taken from there.
    """
    a, b = a_ends.tolist(), b_ends.tolist()
    n, i, j = len(a), 0, 0
    a_starts, b_starts = [], []
    while i < n:
        lo, width = i, 2
        while lo < n and a[lo : lo + width] == b[j + lo - i : j + lo - i + width]:
            lo += width
            width *= 2
        lo, hi = min(lo, n), lo + width
        while lo < n and hi - lo > 1:
            middle = (lo + hi) // 2
            if a[lo:middle] == b[j + lo - i : j + middle - i]:
                lo = middle
            else:
                hi = middle
        a_starts.extend(range(i, lo))
        b_starts.extend(range(j, j + lo - i))
        i, j = lo, j + lo - i
        if i == n:
            break
        a_starts.append(i)
        b_starts.append(j)
        while a[i] != b[j]:
            if a[i] < b[j]:
                i += 1
            else:
                j += 1
        i, j = i + 1, j + 1
    return np.array(a_starts, np.int64), np.array(b_starts, np.int64)


def linked(a_ids: np.ndarray, b_ids: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each entry, entries): the id pairs that groups link, as ``a * width + b``, and how often each entry counts."""
    a_sizes, b_sizes = np.diff(a_starts, append=len(a_ids)), np.diff(b_starts, append=len(b_ids))
    counts = a_sizes * b_sizes
    wide = np.flatnonzero(counts > WIDE_GROUP)
    listed = counts.copy()
    listed[wide] = 0
    of = np.repeat(np.arange(len(counts)), listed)
    at = np.arange(len(of)) - np.repeat(np.cumsum(listed) - listed, listed)
    first, second = np.divmod(at, b_sizes[of])
    pairs = np.empty(len(of), PAIR)
    pairs["code"] = a_ids[a_starts[of] + first] * width + b_ids[b_starts[of] + second]
    pairs["times"] = 1
    for g in wide.tolist():
        x, cx = np.unique(a_ids[a_starts[g] : a_starts[g] + a_sizes[g]], return_counts=True)
        y, cy = np.unique(b_ids[b_starts[g] : b_starts[g] + b_sizes[g]], return_counts=True)
        more = np.empty(len(x) * len(y), PAIR)
        more["code"] = (x[:, None] * width + y[None, :]).ravel()
        more["times"] = (cx[:, None] * cy[None, :]).ravel()
        of, pairs = np.concatenate([of, np.full(len(more), g)]), np.concatenate([pairs, more])
    if len(wide):
        order = np.argsort(of, kind="stable")
        of, pairs = of[order], pairs[order]
    return of, pairs


class Aligned:
    """Alignments of text parts, remembered while a task meets them again: two stores of ``KNOWN_PIECES`` at most.

    Each part gives (groups as text, id pairs as bytes of ``PAIR``, token and group
    counts as the bytes of three longs), or None where its tokens are not its bytes.
    """

    def __init__(self, vocabularies: Vocabularies):
        self.both, self.known, self.before = vocabularies, {}, {}

    def learn(self, parts: list[str]) -> None:
        """Align parts that are not known yet, all in one sequence: every part ends a group."""
        both = self.both
        together = both.encoded_together(parts)
        if together is None:
            a, b = both.encoded(parts)
            fits = list(map(both.same_bytes, parts, a, b))
            self.known.update((p, None) for p, f in zip(parts, fits) if not f)
            parts, a, b = ([x for x, f in zip(xs, fits) if f] for xs in (parts, a, b))
            if not parts:
                return
            together = parts, *(y for x in (a, b) for y in (np.array(list(chain.from_iterable(x)), np.int64), np.fromiter(map(len, x), np.int64, len(x))))
        parts, a_ids, a_counts, b_ids, b_counts = together
        a_starts, b_starts = groups(np.cumsum(both.a_sizes[a_ids]), np.cumsum(both.b_sizes[b_ids]))
        last = np.searchsorted(a_starts, np.cumsum(a_counts))  # groups up to each part's end
        of, pairs = linked(a_ids, b_ids, a_starts, b_starts, len(both.b_bytes))
        upto = (np.searchsorted(of, last) * PAIR.itemsize).tolist()
        counts, raw = np.stack([a_counts, b_counts, np.diff(last, prepend=0)], axis=1).tobytes(), pairs.tobytes()
        texts = self.group_texts(a_ids.tolist(), b_ids.tolist(), a_starts.tolist(), b_starts.tolist())
        lo, at, k = 0, 0, 0
        for part, hi, to in zip(parts, last.tolist(), upto):
            self.known[part] = (";".join(texts[lo:hi]).encode(), raw[at:to], counts[k : k + 24])
            lo, at, k = hi, to, k + 24

    def group_texts(self, a_ids: list, b_ids: list, a_starts: list, b_starts: list) -> list[str]:
        a_names, b_names = [self.both.a_names[i] for i in a_ids], [self.both.b_names[i] for i in b_ids]
        a_stops, b_stops = a_starts[1:] + [len(a_ids)], b_starts[1:] + [len(b_ids)]
        return [
            a_names[p] + "|" + b_names[r] if q - p == 1 == s - r else ",".join(a_names[p:q]) + "|" + ",".join(b_names[r:s])
            for p, q, r, s in zip(a_starts, a_stops, b_starts, b_stops)
        ]

    def documents(self, texts: Iterable[str | None]) -> Iterator["Links"]:
        """What each text links, in order; new parts of several texts are learned together."""
        held, size = [], 0
        for text in texts:
            links = Links()
            for parts in blocks_of(text) if text and self.both.cuts else [[text]] if text else []:
                held.append((links, parts, None))
                size += sum(map(len, parts))
                if size >= GROUP_CHARS:
                    yield from self.settled(held)
                    held, size = [], 0
            held.append((links, [], text or ""))
        yield from self.settled(held)

    def settled(self, held: list) -> Iterator["Links"]:
        """Add parts to their texts' links; give those of texts that end here."""
        wanted = set().union(*(parts for _, parts, _ in held))
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > KNOWN_PIECES:
            self.before, self.known, new = self.known, {}, wanted
        again = new.intersection(self.before)  # pieces met again stay, others go with the store before
        self.known.update((p, self.before[p]) for p in again)
        if new := list(new.difference(again)):
            self.learn(new)
        for links, parts, ended in held:
            if parts:
                links.add([self.known[p] for p in parts])
            if ended is not None:
                yield links if links.fits else self.whole(ended)

    def whole(self, text: str) -> "Links":
        """Of a text with a part whose tokens are not its bytes: it is encoded in one piece."""
        links = Links()
        (a,), (b,) = self.both.encoded([text])
        if self.both.same_bytes(text, a, b):
            a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
            a_starts, b_starts = groups(np.cumsum(self.both.a_sizes[a_ids]), np.cumsum(self.both.b_sizes[b_ids]))
            _, pairs = linked(a_ids, b_ids, a_starts, b_starts, len(self.both.b_bytes))
            texts = self.group_texts(a, b, a_starts.tolist(), b_starts.tolist())
            links.add([(";".join(texts).encode(), pairs.tobytes(), np.array([len(a), len(b), len(texts)], np.int64).tobytes())])
        return links


class Links:
    """What a text's groups link: its counts, distinct pair codes, how often each is linked, and a digest of the groups."""

    def __init__(self):
        self.fits, self.counts, self._digest = True, np.zeros(3, np.int64), None
        self.codes, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, parts: list) -> None:
        if None in parts or not self.fits:
            self.fits = False
            return
        texts, pairs, counts = zip(*parts)
        if self._digest is None:
            self._digest = hashlib.sha256()
        else:
            self._digest.update(b";")
        self._digest.update(b";".join(texts))
        self.counts += np.frombuffer(b"".join(counts), np.int64).reshape(-1, 3).sum(axis=0)
        here = np.frombuffer(b"".join(pairs), PAIR)
        if len(self.codes):
            self.codes, self.times = added_up(np.concatenate([self.codes, here["code"]]), np.concatenate([self.times, here["times"]]))
        else:
            self.codes, self.times = added_up(here["code"], here["times"])

    @property
    def row(self) -> tuple:
        return (*self.counts.tolist(), int(self.times.sum()), self._digest.hexdigest() if self._digest else "")


def added_up(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sum of their times."""
    order = np.argsort(codes)
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1 if len(codes) else 0))
    return codes[first], np.add.reduceat(times, first) if len(first) else times


_DOCUMENT = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def document_links(rows: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Two kinds of rows per chunk of documents, from one pass over the texts.

    Documents have their counts, digest and ``pairs``: places in the chunk's
    list of id pairs and how often each is linked. Pairs have ``code`` and
    ``docs``, the chunk's documents that hold them. A chunk never spans two tasks.
    """
    kind = rows.schema["id"].dataType.simpleString()
    names = ["chunk", "place", "code", "docs", "id", *_DOCUMENT, "pairs", "times"]
    schema = (
        f"chunk bigint, place int, code bigint, docs bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups_sha256 string, pairs binary, times binary"
    )

    def flushed(ids: list[pa.Array], found: list[Links]) -> Iterator[pa.RecordBatch]:
        chunk = uuid.uuid4().int >> 65
        pairs, at, docs = np.unique(np.concatenate([x.codes for x in found]), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x.codes) for x in found]).tolist()
        at = at.astype(np.int32)
        places = pa.array([at[lo:hi].tobytes() for lo, hi in zip([0, *ends], ends)], pa.binary())
        times = pa.array([x.times.astype(np.int32 if x.times.max(initial=0) < 2**31 else np.int64).tobytes() for x in found], pa.binary())
        counts = [pa.array(x) for x in zip(*(x.row for x in found))]
        k, p = len(found), len(pairs)
        none = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())]
        rows = [pa.array(np.full(k, chunk)), *none, pa.concat_arrays(ids), *counts, places, times]
        blank = [pa.nulls(p, x.type) for x in rows[4:]]
        yield from pa.Table.from_arrays(rows, names).to_batches(2048)
        yield from pa.Table.from_arrays([pa.array(np.full(p, chunk)), pa.array(np.arange(p, dtype=np.int32)), pa.array(pairs), pa.array(docs), *blank], names).to_batches(1 << 16)

    def per_task(batches):
        gc.disable()  # nothing here refers in circles, and the stores are large to search through
        both = Aligned(Vocabularies(byte_level, pieces))
        ids, found, held = [], [], 0
        for batch in batches:
            start = 0
            for i, links in enumerate(both.documents(batch.column("text").to_pylist()), 1):
                found.append(links)
                held += len(links.codes)
                if held >= CHUNK_PAIRS:
                    yield from flushed([*ids, batch.column("id").slice(start, i - start)], found)
                    ids, found, held, start = [], [], 0, i
            ids.append(batch.column("id").slice(start))
        if found:
            yield from flushed(ids, found)
        gc.enable()

    return rows.mapInArrow(frugal(per_task), schema)


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """(``code``, ``count``, ``best``): documents that hold each id pair, and whether no pair of its A id has more."""
    counts = pairs.groupBy("code").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"code div {width}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(documents: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``byte_level`` is a byte-level tokenizers file (A), ``pieces`` a sentencepiece
    model (B). A space and the text are encoded by A, the text by B, which adds the
    space. Groups are the shortest stretches of bytes that tokens of both
    end together. Id pairs of one group are linked; a pair counts the documents of the
    whole table that link it, ``count_sum`` adds these counts over all links of a
    document, ``n_best`` counts links whose pair no other pair of its A id exceeds.
    Null and empty texts, and texts that either tokenizer does not give back byte
    by byte (one with U+2581, for one), have zeros and an empty digest. Repeated rows are
    documents of their own, null ids are ids, an empty table gives an empty result.

    Texts are aligned in one pass, which leaves each chunk of documents with a list
    of its id pairs. Only these lists are counted and joined; each chunk then meets
    its own list again, in one task whose memory the chunk's size bounds.
    """
    spark = documents.sparkSession
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=pieces).vocab_size()
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = staged(document_links(texts, byte_level, pieces), "alignments")
    pairs = found.where("place is not null").select("chunk", "place", "code", "docs")
    counted = pairs.select("chunk", "place", "code").join(pair_counts(pairs, width), "code").select("chunk", "place", "count", "best")
    rows = found.where("place is null").drop("place", "code", "docs")
    kind = rows.schema["id"].dataType.simpleString()
    both = counted.unionByName(rows, allowMissingColumns=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("place").isNull(), "place")

    def per_chunk(batches):
        here, lists = None, []
        for batch in batches:
            for run in split_runs(batch, "chunk"):
                if (chunk := run.column("chunk")[0].as_py()) != here:
                    here, lists = chunk, []
                of_pairs = run.num_rows - run.column("place").null_count
                if of_pairs:
                    lists.append([run.column(c).slice(0, of_pairs).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("count", "best")])
                docs = run.slice(of_pairs)
                if not docs.num_rows:
                    continue
                if len(lists) > 1:
                    lists = [[np.concatenate(x) for x in zip(*lists)]]
                n_best, total = [], []
                for places, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist()):
                    at = np.frombuffer(places, np.int32)
                    by = np.frombuffer(times, np.int32 if len(times) == len(places) else np.int64).astype(np.int64)
                    total.append(int(lists[0][0][at] @ by) if len(at) else 0)
                    n_best.append(int(lists[0][1][at] @ by) if len(at) else 0)
                yield pa.RecordBatch.from_arrays(
                    [docs.column("id"), *(docs.column(c) for c in _DOCUMENT[:4]), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), docs.column("groups_sha256")],
                    ["id", *_DOCUMENT[:4], "n_best", "count_sum", "groups_sha256"],
                )

    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return dealt.mapInArrow(frugal(per_chunk), schema).withColumnRenamed("id", id_column)


def split_runs(batch: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
    """Slices of equal keys of a batch that is sorted by it."""
    if not batch.num_rows:
        return
    column = batch.column(key).to_numpy()
    cuts = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(lo, hi - lo)
