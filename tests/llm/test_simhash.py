import re

import numpy as np
import xxhash

from waymark.llm import simhash
from waymark.llm.components import connected
from waymark.llm.queries import QUERIES


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, fps, radius=2):
    arr = np.array(fps, np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def test_whole_table_against_all_pairs(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op7_simhash"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = plain_components([r["doc_id"] for r in rows], fps)
    assert len(got) == len(rows)
    for r, fp, c in zip(rows, fps, want):
        assert got[r["doc_id"]]["fingerprint"] == f"{fp:016x}" and got[r["doc_id"]]["component_id"] == c


def test_links_of_random_and_chained_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 400, dtype=np.uint64).tolist()
    for start in (fps[0], 0, 2**64 - 1):
        x = start
        for _ in range(60):  # a chain whose ends are far apart
            x ^= 1 << int(rng.integers(0, 64))
            x ^= 1 << int(rng.integers(0, 64))
            fps.append(x)
    fps = sorted(set(fps))
    for compared, tile in ((8, 4), (4096, 2048)):
        monkeypatch.setattr(simhash, "COMPARED_PER_ROW", compared)
        monkeypatch.setattr(simhash, "TILE_ROWS", tile)
        df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
        roots = {r["node"]: r["root"] for r in connected(simhash.links(df)).collect()}
        signed = [int(np.uint64(f).view(np.int64)) for f in fps]
        assert [roots.get(s, s) for s in signed] == plain_components(signed, fps)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (5, "one", None), (4, "ONE", None), (None, "one", "y"), (7, "a b c d", "z"), (7, "a b c d", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").withColumnRenamed("fp", "component_id")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    zero, one, four = "0" * 16, f"{plain_fingerprint('one'):016x}", f"{plain_fingerprint('a b c d'):016x}"
    assert got == sorted([(1, zero, 1), (2, zero, 1), (3, zero, 1), (5, one, 4), (4, one, 4), (None, one, 4), (7, four, 7), (7, four, 7)], key=str)
    assert simhash.near_duplicates(docs.where("doc_id > 90")).collect() == []


def test_long_text_in_blocks():
    text = " ".join(f"w{i % 977}" for i in range(400_000))
    hashes = np.array([xxhash.xxh64_intdigest(" ".join((f"w{i % 977}", f"w{(i + 1) % 977}", f"w{(i + 2) % 977}")), 42) for i in range(399_998)], np.uint64)
    bits = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprint(text.encode()) == bits
