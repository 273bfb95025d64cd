import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from waymark.llm import mixing
from waymark.llm.queries import QUERIES


def check(rows, texts, sources):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for i, t in texts.items():
        total[sources[i]] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, left, free = {}, 1.5 * sum(total.values()), set(order)
    while free:
        w = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / w > 2 * total[s] + 1e-9]
        if not above:
            want |= {s: left * weight[s] / w for s in free}
            break
        for s in above:
            want[s] = 2 * total[s]
        left -= sum(want[s] for s in above)
        free -= set(above)
    taken, times = defaultdict(int), defaultdict(dict)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == size(texts[r["doc_id"]]) and r["source_size"] == total[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        if r["size"]:
            times[s].setdefault(r["taken"] // r["size"], []).append(r["size"])
    for s in order:  # short of the target by less than the smallest document that could be taken once more
        unused = times[s][min(times[s])] if times[s] and min(times[s]) < 2 else []
        assert -1 <= want[s] - taken[s] < min(unused, default=0) + 1, (s, taken[s], want[s])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = QUERIES["op5_mixing"](spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, {r["doc_id"]: r["text"] for r in docs}, {r["doc_id"]: r["source"] for r in docs})
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op5_mixing"](spark, sf).collect()))


def test_many_ranges_and_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 8)
    rows = [(i, "w " * (i % 17), [None, "a", "b", "Z", "ä"][i % 5]) for i in range(600)] + [(1000, None, "a"), (1001, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as size", "2 as target")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    check(got, {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows})
    assert mixing.mixed(docs.where("doc_id < 0")).collect() == []
    twice = mixing.mixed(docs.where("doc_id in (5, 11)").unionByName(docs.where("doc_id in (5, 11)"))).collect()
    assert len(twice) == 4


def test_overlapping_sources_use_each_word_once_first(spark):
    given = mixing.routed({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 100})
    words = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    assert sum(given.values()) == 250 and all(words[p] <= given[p] <= 2 * words[p] for p in words)  # all used once before any twice
    only = mixing.routed({("a",): 10, ("a", "b"): 10}, {"a": 10, "b": 10})
    assert only == {("a",): 10, ("a", "b"): 10}
    rows = [(i, "w w w", ["a"] if i % 3 else ["a", "b"]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source array<string>")
    assert all(r["taken"] in (0, 3, 6) for r in mixing.mixed(docs).collect())


def test_goes_on_after_a_document_that_does_not_fit(spark):
    for seed in range(6):
        rows = [(0, "w " * 300, "a")] + [(i, "w " * 20, "a") for i in range(1, 31)] + [(50 + i, "w " * i, "b") for i in range(9)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        got = mixing.mixed(docs, seed=seed).collect()
        check(got, {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows})


def test_flow_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(40):
        words = {("a",): rng.randrange(5), ("a", "b"): rng.randrange(5), ("b",): rng.randrange(5)}
        quotas = {"a": rng.randrange(12), "b": rng.randrange(12)}
        best = None
        for g in itertools.product(*(range(2 * w + 1) for w in words.values())):
            if any(g[0] + x <= quotas["a"] and g[2] + g[1] - x <= quotas["b"] for x in range(g[1] + 1)):
                repeated = sum(max(0, n - w) for n, w in zip(g, words.values()))
                best = max(best or (0, 0), (sum(g), -repeated))
        given = mixing.routed(words, quotas)
        assert (sum(given.values()), -sum(max(0, given[p] - words[p]) for p in words)) == best


def test_any_column_names(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2], i * 7, str(i)) for i in range(40)] + [(3, "w " * 4, "b", 21, "3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, times bigint, row string").selectExpr(
        "*", "1 as id", "2 as key", "3 as chosen", "4 as row_id", "5 as row_key", "6 as `a.b`", "7 as pattern", "8 as more"
    )
    taken = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        taken[r["doc_id"]] += r["taken"] // r["size"]
    got = mixing.dealt_out(docs)
    assert got.columns == docs.columns
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter({r: taken[r[0]] for r in rows if taken[r[0]]})
