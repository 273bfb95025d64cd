import hashlib
import random
from collections import Counter

from waymark.llm.queries import QUERIES
from waymark.llm.repeats import without_repeats


def plain(texts, window):
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in blobs for i in range(len(b) - window + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def compare(rows, ids, texts, window):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == Counter((i, *w) for i, w in zip(ids, plain(texts, window)))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op1_repeats"](spark, sf).collect()
    compare(rows, [r["doc_id"] for r in docs], [r["text"] for r in docs], 400)
    assert sum(r["n_removed"] > 0 for r in rows) > 10


def test_random_texts_of_few_letters(spark):
    rng = random.Random(5)
    for window, letters in ((16, "ab"), (25, "abcdé"), (40, "ab")):
        passages = ["".join(rng.choices(letters, k=rng.randint(window - 3, 3 * window))) for _ in range(12)]
        texts = []
        for _ in range(80):
            parts = []
            for _ in range(rng.randint(0, 5)):
                p = rng.choice(passages)
                parts.append(p if rng.random() < 0.5 else p[rng.randint(0, 9) :])
                parts.append("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 30))))
            texts.append("".join(parts))
        texts += [None, "", "a" * 300, "ab" * 150, "x" * window, "y" * (window - 1), texts[3], texts[3]]
        ids = [None if i == 5 else i // 2 for i in range(len(texts))]
        docs = spark.createDataFrame(list(zip(ids, texts, range(len(texts)))), "doc_id bigint, text string, key int")
        compare(without_repeats(docs, window=window).collect(), ids, texts, window)


def test_empty_and_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "né" * 40), (2, "né" * 40 + "ende")], "doc_id bigint, text string")
    assert without_repeats(docs.where("doc_id > 5"), window=20).collect() == []
    kept = {r["doc_id"]: bytes(r["kept"]) for r in without_repeats(docs, window=20).collect()}
    assert kept[1] == b"" and kept[2].endswith(b"ende")


def test_long_text_over_slabs(spark, monkeypatch):
    from waymark.llm import repeats

    monkeypatch.setattr(repeats, "SLAB", 256)
    rng = random.Random(9)
    body = "".join(rng.choices("abcdefgh", k=3000))
    texts = [body, "zz" + body[700:2100], "".join(rng.choices("abcdefgh", k=900)) + body[500:540]]
    data = [t.encode() for t in texts]
    slab = repeats.Slab(40)
    for d in data:
        starts = [(s + f, s + l) for s, _, first, last, _, _ in repeats.anchors(slab, d, 40, 12) for f, l in zip(first, last)]
        assert [x for f, l in starts for x in range(f, l + 1)] == list(range(len(d) - 39))
