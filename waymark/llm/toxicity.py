"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blobs, frugal, text_rows
from waymark.llm.decontaminate import words_in_blocks
from waymark.sources.warehouse import staged

TRAIN_ROWS = 20_000
LEXICON_TERMS = 20_000
FOLDS = 5
NEAR = 3
STRONG = 1.5
KNOWN_WORDS = 1 << 18

#: Second-person words of the corpus's languages, and signs written in place of letters.
SECOND_PERSON = frozenset(
    w.encode() for w in "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted vosotros".split()
)
SIGNS = bytes.maketrans(b"01345789@$!|", b"oieastbgasil")
#: Letters, signs, dots and hyphens stay, all else parts runs of them.
_RUN_BYTES = bytes(c if c < 0x80 and (chr(c).isalnum() or chr(c) in "@$!|*.-") else 0x20 for c in range(256))
_NO_LETTER = b"0123456789@$!|*.-"
_SIGN = re.compile(rb"[0-9@$!|*]")
_RUNS = re.compile(rb"[!?]{2,}")
FEATURES = (
    "words", "hit_rate", "hits", "top", "second", "mean_top", "hidden_hits", "near_you", "near_you_rate", "you_rate", "capitals",
    "capital_words", "exclaim", "question", "runs", "stars", "digits", "punctuation", "hidden_rate", "word_length",
)


def terms(word: bytes) -> list[bytes]:
    """A word and its beginnings, by which inflected forms are met."""
    text = word.decode("utf-8", "replace")
    return [word] + [b"^" + text[:n].encode() for n in (4, 5, 6) if len(text) >= n]


def _marked(blocks):
    """Blocks, and whether one is the last."""
    held = None
    for block in blocks:
        if held:
            yield *held, False
        held = block
    if held:
        yield *held, True


def plain_words(data: bytes):
    for before, words in words_in_blocks(data, 0):
        yield words


def hidden_words(data: bytes) -> list[bytes]:
    """Words with signs in place of letters, or parted by them, as they are meant."""
    found = []
    for run in data.translate(_RUN_BYTES).split():
        if run.isalpha():
            continue
        word = run.strip(_NO_LETTER)  # from its first letter to its last
        if _SIGN.search(word):
            found.append(re.sub(rb"[^a-z]", b"", word.lower().translate(SIGNS)))
            found.append(re.sub(rb"[^a-z]", b"", word.lower()))
    return found


def held_out(id_column: str = "id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.expr(f"crc32(cast({id_column} as string)) % 3 = 1"), F.lit(False))


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, counts): in how many texts of each label and fold a term occurs; label 1 in the second half."""

    def per_part(batches):
        found: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for data, label, fold in zip(blobs(batch.column("text")), batch.column("label").to_pylist(), batch.column("fold").to_pylist()):
                own = set()
                for words in plain_words(data):
                    own.update(words)
                for t in {t for w in own.union(hidden_words(data)) for t in terms(w)}:
                    if t not in found:
                        found[t] = np.zeros(2 * FOLDS, np.int64)
                    found[t][label * FOLDS + fold] += 1
            if len(found) > KNOWN_WORDS:
                yield shaped(found)
                found = {}
        if found:
            yield shaped(found)

    def shaped(found):
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array([x.tolist() for x in found.values()], pa.list_(pa.int64()))], ["term", "counts"])

    rows = sample.mapInArrow(frugal(per_part), "term binary, counts array<bigint>")
    return rows.groupBy("term").agg(*(F.sum(F.col("counts")[i]).alias(f"n{i}") for i in range(2 * FOLDS)))


def lexicon(sample: DataFrame, least: int = 2) -> dict[bytes, np.ndarray]:
    """Term → weight without each fold, and with all: the log of how much likelier the term is in a text of label 1.

    The ``LEXICON_TERMS`` terms that speak most for label 1; the rest weigh nothing.
    """
    sizes = sample.groupBy("label", "fold").count().collect()
    totals = np.zeros(2 * FOLDS)
    for r in sizes:
        totals[r["label"] * FOLDS + r["fold"]] = r["count"]
    ones = sum(F.col(f"n{i}") for i in range(FOLDS, 2 * FOLDS))
    zeros = sum(F.col(f"n{i}") for i in range(FOLDS))
    n0, n1 = float(totals[:FOLDS].sum()), float(totals[FOLDS:].sum())
    odds = F.log((ones + 0.3) / (n1 + 1)) - F.log((zeros + 0.3) / (n0 + 1))
    best = term_counts(sample).where(ones >= least).withColumn("odds", odds).where("odds > 0.5")
    out = {}
    for r in best.orderBy(F.desc("odds"), "term").limit(LEXICON_TERMS).collect():
        counts = np.array([r[f"n{i}"] for i in range(2 * FOLDS)], float).reshape(2, FOLDS)
        seen = np.concatenate([counts.sum(1, keepdims=True) - counts, counts.sum(1, keepdims=True)], axis=1)
        size = totals.reshape(2, FOLDS)
        size = np.concatenate([size.sum(1, keepdims=True) - size, size.sum(1, keepdims=True)], axis=1)
        weight = np.log((seen[1] + 0.3) / (size[1] + 1)) - np.log((seen[0] + 0.3) / (size[0] + 1))
        out[bytes(r["term"])] = np.where(seen[1] >= least, np.maximum(weight, 0), 0).astype(np.float32)
    return out


class Reader:
    """Features of texts under one fold's weights."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights, self.known = weights, {}

    def weight(self, word: bytes) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            got = self.known[word] = -1.0 if word in SECOND_PERSON else max(self.weights.get(t, 0.0) for t in terms(word))
        return got

    def features(self, data: bytes) -> list[float]:
        """The dense features, in the order of ``FEATURES``; all zero for a text without words."""
        n = you = near = 0
        hits: list[float] = []
        distinct: Counter = Counter()
        letters = 0
        for before, words, final in _marked(words_in_blocks(data, 2 * NEAR)):
            last = before + len(words)
            found = np.fromiter(map(self.weight, words), np.float32, len(words))
            start, stop = 0 if before == 0 else NEAR, len(words) if final else len(words) - NEAR
            new = len(words) if before == 0 else len(words) - 2 * NEAR
            strong = np.flatnonzero(found > STRONG)
            to_you = np.flatnonzero(found < 0)
            n = last
            you += int((to_you >= len(words) - new).sum())
            letters += sum(map(len, words[len(words) - new :]))
            for i in strong.tolist():
                if i >= len(words) - new:
                    hits.append(float(found[i]))
                    distinct[words[i]] += 1
                if start <= i < stop and len(to_you) and int(np.abs(to_you - i).min()) <= NEAR:
                    near += 1
        if not n:
            return [0.0] * len(FEATURES)
        hidden = hidden_words(data)
        hidden_hits = [w for w in map(self.weight, hidden) if w > STRONG]
        hits.sort(reverse=True)
        size = max(1, len(data))
        upper = sum(data.count(bytes([c])) for c in range(65, 91))
        lower = sum(data.count(bytes([c])) for c in range(97, 123))
        shouted = len(_SHOUTED.findall(data))
        tops = (hits + sorted(hidden_hits, reverse=True))[:5]
        return [
            float(np.log1p(n)), len(hits) / n, float(min(len(hits), 20)), max(tops, default=0.0), tops[1] if len(tops) > 1 else 0.0,
            sum(tops) / 5, float(min(len(hidden_hits), 20)), float(min(near, 20)), near / n, you / n, upper / max(1, upper + lower), shouted / n,
            data.count(b"!") / size, data.count(b"?") / size, len(_RUNS.findall(data)) / n, data.count(b"*") / size,
            sum(data.count(bytes([c])) for c in range(48, 58)) / size, sum(data.count(c) for c in (b".", b",", b";", b":")) / size,
            len(hidden) / n, letters / n,
        ]


_SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")


@dataclass
class Trees:
    """Boosted trees of fixed depth: per tree the feature and threshold of each inner node, and the leaves' values."""

    start: float
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.values.shape[1])) if len(self.values) else 0
        for f, t, v in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            out += v[node - (len(v) - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 1.0, cuts: int = 48) -> Trees:
    """Trees that follow the logistic loss's gradient, splits at quantiles of each feature."""
    base = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    start = float(np.log(base / (1 - base)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    if len(set(y.tolist())) < 2:
        return Trees(start, np.empty((0, 0), int), np.empty((0, 0)), np.empty((0, 2**depth)))
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = cuts + 1
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        inner = 2**depth - 1
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best, choice = np.full(count, 1e-9), [(0, np.inf)] * count
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = local * width + binned[:, f]
                gs = np.bincount(cell, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(cell, h, count * width).reshape(count, width).cumsum(1)
                gl, hl, gt, ht = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(hl < 0.05) | (ht - hl < 0.05)] = 0
                at = gain.argmax(1)
                for c in range(count):
                    if gain[c, at[c]] > best[c]:
                        best[c], choice[c] = gain[c, at[c]], (f, e[at[c]])
            for c, (f, t) in enumerate(choice):
                feature[first + c], threshold[first + c] = f, t
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -rate * gs / (hs + penalty)
        margin += value[leaf]
        trees.append((feature, threshold, value))
    f, t, v = map(np.stack, zip(*trees))
    return Trees(start, f, t, v)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the non-decreasing fit; equal margins are one point."""
    points, which = np.unique(margin, return_inverse=True)
    ones, n = np.bincount(which, y, len(points)), np.bincount(which, minlength=len(points)).astype(float)
    blocks: list[list[float]] = []
    for x, a, b in zip(points, ones, n):
        blocks.append([x, x, a, b])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, a2, b2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + a2, blocks[-1][3] + b2]
    xs = [x for lo, hi, _, _ in blocks for x in (lo, hi)]
    ys = [(a + 1e-3) / (b + 2e-3) for _, _, a, b in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    weights: dict[bytes, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[bytes], reader: Reader) -> np.ndarray:
        if not texts:
            return np.empty(0)
        margin = self.trees.margin(np.array([reader.features(t) for t in texts]))
        calibrated = np.interp(margin, *self.knots) if len(self.knots[0]) else 1 / (1 + np.exp(-margin))
        return np.clip(0.999 * calibrated + 0.001 / (1 + np.exp(-margin)), 0, 1)  # the margin orders what calibration ties


def fitted(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, train_rows: int) -> Model:
    """Learns from at most ``train_rows`` labelled rows that are not held out, drawn by a hash of their id.

    Each row's lexicon weights come from the other folds, and calibration sees
    margins of trees that were not fitted on the row.
    """
    told = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("id is not null and label is not null")
    told = told.where(~held_out()).groupBy("id").agg(F.least(F.greatest(F.max("label"), F.lit(0)), F.lit(1)).alias("label"))
    told = told.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(train_rows).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(6)), FOLDS).cast("int"))
    sample = staged(text_rows(documents, id_column, text_column).join(F.broadcast(told), "id"), "labelled")
    parts = sample.sparkSession.sparkContext.defaultParallelism
    sample = staged(sample.repartition(parts), "labelled-dealt")
    weights = lexicon(sample)
    held = sample.sparkSession.sparkContext.broadcast(weights)

    def per_part(batches):
        readers = [Reader({t: float(w[f]) for t, w in held.value.items()}) for f in range(FOLDS)]
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            rows = [readers[f].features(t) for f, t in zip(folds, blobs(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("label"), batch.column("fold"), batch.column("id").cast(pa.string())], ["x", "label", "fold", "id"])

    found = sample.select("id", "text", "label", "fold").mapInArrow(frugal(per_part), "x array<double>, label int, fold int, id string").orderBy("id", "x").collect()
    x = np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES))
    y = np.array([r["label"] for r in found], float)
    fold = np.array([r["fold"] for r in found], int)
    margins = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any():
            margins[fold == f] = boosted(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model({t: float(w[FOLDS]) for t, w in weights.items()}, boosted(x, y), isotonic(margins, y))


def scored(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    threshold: float = 0.7, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) of every row of ``documents``; the score is a function of the text alone.

    The lexicon, the trees and the calibration are learned from labels of ids whose
    CRC-32 leaves no remainder of 1 by 3. Rows without a label or id teach nothing;
    of several labels of an id the largest counts. Null and empty texts get the
    score of a text without words. Without labels of both kinds every score is the
    share of label 1 (kept off 0 and 1). Repeated rows are scored each.
    """
    model = documents.sparkSession.sparkContext.broadcast(fitted(documents, labels, id_column, text_column, label_column, train_rows))

    def per_part(batches):
        reader = Reader(model.value.weights)
        for batch in batches:
            scores = model.value.scores(blobs(batch.column("text")), reader)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    rows = text_rows(documents, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(frugal(per_part), f"id {kind}, score double").select(
        F.col("id").alias(id_column), held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def accepted(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    threshold: float = 0.7, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """All columns of the rows of ``documents`` that ``scored`` does not predict as toxic."""
    model = documents.sparkSession.sparkContext.broadcast(fitted(documents, labels, id_column, text_column, label_column, train_rows))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model.value.weights)
        for batch in texts:
            yield pd.Series(model.value.scores([t.encode() for t in batch], reader))

    return documents.where(score(F.coalesce(F.col(text_column), F.lit(""))) < threshold)
