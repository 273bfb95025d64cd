import hashlib
import random
import re
from collections import Counter

import pytest

from waymark.llm import sketch
from waymark.llm.queries import QUERIES


def pieces(text):
    return {p.rstrip(" ") for p in re.findall(r"(?:[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*){1,8}\n*", text)}


def alike(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, after):
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def check(rows, docs):
    docs = [(i, t or "") for i, t in docs]
    got = {r["doc_id"]: r for r in rows}
    prints = {}
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        r, e = got[i], edited(t, after)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(t, e)) and r["near_next"] == pytest.approx(alike(t, after))
        prints.setdefault(t, set()).add(r["fingerprint"])
        prints.setdefault(e, set()).add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    sets = {}
    for t, (p,) in prints.items():
        sets.setdefault(frozenset(pieces(t)), set()).add(p)
    assert len({p for s in sets.values() for p in s}) == len(sets)


def test_whole_table(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op2_fingerprints"](spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, docs)


def test_small_sketches_are_retried(spark, monkeypatch):
    monkeypatch.setattr(sketch, "ROUNDS", 4)
    levels = []
    retried = sketch._retried
    monkeypatch.setattr(sketch, "_retried", lambda rows, pairs, level, n: levels.append((level, n)) or retried(rows, pairs, level, n))
    docs = [(i, " ".join(f"w{(i * 7 + j) % 5000}" for j in range(40 * (i % 9)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as key", "2 as range")
    check(sketch.fingerprinted(df).collect(), docs)
    assert levels


def test_edges(spark):
    docs = [(None, "null id\nline two"), (1, None), (2, ""), (3, "abc"), (4, "abcd"), (5, "é" * 9 + " \n x  y\n\nz"), (6, "same"), (7, "same")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    check(sketch.fingerprinted(df).collect(), docs)
    assert sketch.fingerprinted(df.where("doc_id > 90")).collect() == []
    alone = sketch.fingerprinted(df.where("doc_id = 4")).collect()[0]
    assert alone["edited_sha256"] == hashlib.sha256(b"abca").hexdigest() and alone["near_next"] == 1.0
    hot = spark.createDataFrame([(3, f"text {i}") for i in range(50)] + [(3, "text 1")], "doc_id bigint, text string")
    assert len(sketch.fingerprinted(hot).collect()) == 51


def test_no_python_on_the_main_path(spark, sf):
    rows = sketch.in_order(sketch.text_rows(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("key", sketch.row_key()))
    held = rows.select("range", "place", sketch.digests("text").alias("own"), sketch.digests("next_text").alias("following"))
    plan = sketch.differences(held, ["range", "place"], [("own", "following")])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("rounds", [12, 3])
def test_changed_pieces_are_recovered(spark, monkeypatch, rounds):
    monkeypatch.setattr(sketch, "ROUNDS", rounds)
    rng = random.Random(4)
    rows = [(None, "a b\nc", "a b\nd"), (1, None, "x"), (1, "x", None), (2, "", None), (3, "same\nlines", "same\nlines"), (9, "p q", "r s"), (9, "p q", "r s")]
    for i in range(20, 60):
        text = [f"line {rng.randrange(200)}" for _ in range(rng.randrange(60))]
        other = [x if rng.random() < 0.8 else "changed " + x for x in text] + ["new"] * rng.randrange(2)
        rows.append((i, "\n".join(text), "\n".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, before string, after string").selectExpr("*", "1 as id", "2 as side")
    got = Counter((r["doc_id"], r["side"], r["digest"]) for r in sketch.changed_pieces(df, "doc_id", "before", "after").collect())
    named = {(p, i): None for i, *versions in rows for v in versions for p in pieces(v or "")}
    hashed = {r["p"]: r["h"] for r in spark.createDataFrame([(p,) for p, _ in named], "p string").selectExpr("p", "xxhash64(p) as h").collect()}
    want = {(i, side, hashed[p]) for i, a, b in rows for side, x, y in (("removed", a, b), ("added", b, a)) for p in pieces(x or "") - pieces(y or "")}
    assert set(got) == want and max(got.values()) == 1 and len(want) > 100
    assert sketch.changed_pieces(df.where("doc_id > 90"), "doc_id", "before", "after").collect() == []
