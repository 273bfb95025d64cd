import hashlib
import random
import re
from collections import Counter

from waymark.llm import decontaminate
from waymark.llm.queries import QUERIES


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, window=10):
    spans = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            spans.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(s) for s in spans}
    out = Counter()
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in spans:
                    hit.update(range(i, i + n))
                    found |= spans[tuple(w[i : i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out[doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    return out


def rows(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(QUERIES["op8_decontaminate"](spark, sf))
    assert got == plain(docs, items) and sum(n for r, n in got.items() if r[5]) >= 3


def test_random_passages_short_items_and_edges(spark, monkeypatch):
    rng = random.Random(4)
    vocab = ["a", "b", "c", "É1", "dd"]
    items = [(i // 2 if i % 7 else None, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 5, 9, 10, 11, 14, 30])))) for i in range(25)]
    items += [(90, None), (91, "?!"), (92, "Solo"), (92, "solo")]
    docs = [(i, " ".join(rng.choices([*vocab, "x", "y"], k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "a b"), (102, items[-5][1] or ""), (103, "SOLO, solo"), (103, "SOLO, solo"), (104, " ".join(t or "" for _, t in items))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as hash", "2 as item_id")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(decontaminate.contamination(d, b)) == plain(docs, items)
    assert all(not r[5] for r in rows(decontaminate.contamination(d, b.where("item_id > 900"))))
    assert rows(decontaminate.contamination(d.where("doc_id > 900"), b)) == Counter()


def test_blocks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(decontaminate, "_BLOCK", 16)
    text = " ".join(f"w{i}é" for i in range(60)) + "x" * 50 + " end"
    got = {}
    for before, block in decontaminate.words_in_blocks(text.encode(), 4):
        got.update({before + i: w.decode() for i, w in enumerate(block)})
    assert [got[i] for i in range(len(got))] == words(text)


def test_benchmark_text_whose_first_block_has_few_words(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    items = [(1, "alpha beta " + "." * (1 << 21) + " " + passage), (2, "." * (1 << 21) + " solo word"), (3, "gamma" + " " * (1 << 21) + "delta")]
    docs = [(1, "clean text with alpha beta in it"), (2, "x " + passage + " y"), (3, "a solo word"), (4, "gamma alone"), (5, "gamma delta")]
    docs += [(6, "alpha beta " + " ".join(passage.split()[:8]))]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = plain(docs, items)
    assert rows(decontaminate.contamination(d, b)) == want and {r[0] for r in want if not r[5]} == {1, 4}
