import random
import re
from collections import Counter

import numpy as np

from waymark.llm import setsketch
from waymark.llm.queries import QUERIES


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(words, words[1:])) or frozenset([tuple(words)] if words else [])


def plain(rows):
    """(id, size, component, kept) of each row, by comparing all pairs of sets."""
    sets, root, links = [plain_set(t) for _, t in rows], list(range(len(rows))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                links += a != b
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    found = [least.get(find(i)) for i in range(len(rows))]
    return [(x, len(s), c, x == c) for (x, _), s, c in zip(rows, sets, found)], links


def rows_of(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_query_against_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, links = plain(rows)
    assert rows_of(QUERIES["op11_setsketch"](spark, sf)) == Counter(want) and links


def test_whole_table_against_all_pairs(spark):
    """Every row of sf0.01: pairs near the threshold, templates and copies, as the driver makes them."""
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, links = plain(rows)
    assert rows_of(QUERIES["op11_setsketch"](spark, sf)) == Counter(want) and links


def test_edits_templates_and_chains(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "HEAD_ROWS", 4)
    monkeypatch.setattr(setsketch, "BLOCK_SHINGLES", 1 << 9)
    rng = random.Random(7)
    vocab, texts = [f"w{i}" for i in range(500)], []
    for _ in range(60):  # edited at up to nine places: similarities on both sides of 0.8
        base = rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 12, 60, 90, 200]))
        for edits in (0, 0, 1, 2, 3, 5, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "Edited" + str(rng.randrange(9))
            texts.append(copy)
    line = rng.choices(vocab, k=100)
    texts += [line + rng.choices(vocab, k=k) for k in (14, 16, 18, 20, 22, 30) for _ in range(25)]  # a template: most pairs just below
    step = rng.choices(vocab, k=100)
    for _ in range(60):  # a chain whose ends are unlike
        step = [*step[6:], *rng.choices(vocab, k=6)]
        texts.append(step)
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in zip(rng.sample(range(5000), len(texts)), texts)]
    want, links = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(setsketch.near_duplicates(docs)) == Counter(want) and links > 100


def test_edge_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (3, " \t"), (5, "One two"), (None, "one TWO"), (None, "x"), (None, "x"), (7, "y"), (7, "y"), (6, "Y"), (9, "a " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as class", "2 as key", "'z' as id", "3 as n", "4 as kept")
    want = [(1, 0, 1, True)] * 2 + [(2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (None, 1, 5, False)]
    want += [(None, 1, None, True)] * 2 + [(7, 1, 6, False)] * 2 + [(6, 1, 6, True), (9, 1, 9, True)]
    assert rows_of(setsketch.near_duplicates(docs)) == Counter(want)
    assert setsketch.near_duplicates(docs.where("doc_id > 90")).collect() == []


def test_sketches_merge_estimate_and_meet():
    rng = np.random.default_rng(1)
    errors, shared, kept = [], [], []
    for _ in range(400):
        n = int(rng.integers(20, 900))
        common = rng.integers(0, 2**64, n, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**64, n // 8, dtype=np.uint64)]) for _ in range(2))
        x, y = setsketch.sketch(a), setsketch.sketch(b)
        assert (setsketch.merged(np.array([x, y])) == setsketch.sketch(np.concatenate([a, b]))).all()
        args = [np.array([v]) for v in ((x > y).sum(), (x < y).sum(), len(a), len(b))]
        truth = n / (n + 2 * (n // 8))
        errors.append(setsketch.estimated(*args)[0] - truth)
        shared.append((x == y).reshape(-1, setsketch.BAND).all(axis=1).any())
        kept.append(setsketch.plausible(*args)[0])
        assert truth < 0.8 or kept[-1]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05 and all(shared) and all(kept)
    a, b = (rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    x, y = setsketch.sketch(a), setsketch.sketch(b)
    assert not setsketch.plausible(*(np.array([v]) for v in ((x > y).sum(), (x < y).sum(), 500, 500)))[0]
