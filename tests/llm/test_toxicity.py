import random
import re
import time
import zlib

import numpy as np

from waymark.llm import toxicity
from waymark.llm.queries import QUERIES



def test_scores_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    told = [(rows[i]["predicted"], t, rows[i]["score"]) for i, t in labels.items() if rows[i]["held_out"]]
    caught, toxic = sum(p and t for p, t, _ in told), sum(t for _, t, _ in told)
    wrong = sum(p and not t for p, t, _ in told)
    print("held out", len(told), "toxic", toxic, "caught", caught, "wrong", wrong)
    assert caught >= 0.85 * toxic and wrong <= 0.01 * len(told)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "you fool", 1), (3, "x " * 9, 1), (3, "x " * 9, 1)], "doc_id bigint, text string, label int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.scored(docs, none).collect()
    assert len(rows) == 5 and len({r["score"] for r in rows}) == 1 and all(0 <= r["score"] < 0.7 for r in rows)
    some = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    texts = spark.createDataFrame([(i, "you awful zork" if i % 2 else "a fine day") for i in range(60)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(texts, some).collect()}
    assert all(got[i] == i % 2 for i in range(60))
    assert toxicity.scored(docs.where("doc_id > 9"), some).collect() == []


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.boosted(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    xs, ys = toxicity.isotonic(np.array([0, 1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1, 1.0]))
    assert np.all(np.diff(ys) >= 0) and np.interp(1.5, xs, ys) == np.interp(2, xs, ys) and abs(np.interp(1, xs, ys) - 0.5) < 0.01


def test_features_do_not_depend_on_blocks(monkeypatch):
    from waymark.llm import decontaminate

    text = b" ".join([b"fine", b"you", b"zork", b"id1ot", b"DAY", b"ok!"] * 60 + [b"zork", b"a", b"b", b"your"])
    whole = toxicity.Reader({b"zork": 4.0, b"idiot": 3.0}).features(text)
    monkeypatch.setattr(decontaminate, "_BLOCK", 64)
    assert toxicity.Reader({b"zork": 4.0, b"idiot": 3.0}).features(text) == whole and whole[6] > 0


def test_hidden_words_in_linear_time():
    backtracking = re.compile(rb"[A-Za-z][A-Za-z0-9@$!|*.\-]*[0-9@$!|*][A-Za-z0-9@$!|*.\-]*[A-Za-z]")
    rng = random.Random(6)
    for _ in range(3000):
        data = "".join(rng.choice("abZ019@$!|*.-  é\n") for _ in range(rng.randrange(30))).encode()
        want = [f(m[0].lower()) for m in backtracking.finditer(data) for f in (lambda w: re.sub(rb"[^a-z]", b"", w.translate(toxicity.SIGNS)), lambda w: re.sub(rb"[^a-z]", b"", w))]
        assert toxicity.hidden_words(data) == want, data
    start = time.process_time()
    for word in (b"x" * 1_000_000, b"a." * 500_000, b"a1" * 500_000, b"." * 1_000_000):
        toxicity.hidden_words(word)
    assert time.process_time() - start < 5
