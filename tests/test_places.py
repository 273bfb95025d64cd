"""Merged landmarks, names in texts, row numbers of split files, pooled fits: each beside the plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import text as X
from waymark.operators import compaction, graph
from waymark.operators import evaluate as E
from waymark.operators import lookups as L
from waymark.operators import retrieval as R
from waymark.sources import files


def test_one_place_across_a_border_keeps_its_spellings(spark):
    rows = [
        (1, "SBI ATM", ["sbi atm point"], 28.65000, 77.12000, 4), (2, "S.B.I. A.T.M.", [], 28.65050, 77.12060, 12), (3, "SBI ATM", [], 28.70000, 77.12000, 3),
        (4, "Shiv Mandir", ["Shiv Temple"], 28.65001, 77.12001, 5), (5, "shiv mandir", [], 28.65030, 77.12030, 0), (6, "Shiv Temple", [], 28.65060, 77.12001, 1), (7, "Water Tank", [], None, None, 2),
    ]
    df = spark.createDataFrame(rows, "landmark_id long, canonical_name string, aliases array<string>, lat double, lng double, observation_count int")
    got = {r["landmark_id"]: r for r in compaction.merge_landmarks(df).collect()}
    assert set(got) == {1, 3, 4, 7}
    assert (got[1]["canonical_name"], got[1]["aliases"], got[1]["observation_count"], got[1]["merged"]) == ("S.B.I. A.T.M.", ["SBI ATM", "sbi atm point"], 16, 2)
    assert got[1]["lat"] == round((28.65 * 4 + 28.6505 * 12) / 16, 6)
    assert (got[4]["canonical_name"], got[4]["aliases"], got[4]["merged"]) == ("Shiv Mandir", ["Shiv Temple"], 3)
    assert got[3]["aliases"] == [] and got[7]["lat"] is None
    assert compaction.merge_landmarks(df.where("landmark_id > 90")).collect() == []


def test_pairs_of_names_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["shiv", "mandir", "gupta", "store", "general", "water", "tank", "school", "sbi", "atm", "road", "gate"]
    rows = []
    for i in range(220):
        name = rng.sample(words, rng.randint(1, 6))
        if rng.random() < 0.3:
            k = rng.randrange(len(name))
            name[k] = name[k] + rng.choice("aeiou")
        rows.append((i, " ".join(name), 28.65 + rng.uniform(0, 0.006), 77.12 + rng.uniform(0, 0.006)))
    df = spark.createDataFrame(rows, "place long, name string, lat double, lng double")
    named = R.with_name_vector(df, "name")
    a, b = (named.select(*[F.col(c).alias(f"{s}_{c}") for c in named.columns]) for s in "ab")
    from waymark.functions import geo

    close = geo.haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) <= 400.0
    for least in (0.5, 0.8):
        alike = R.name_affinity(F.col("a_name"), F.col("a_vector"), F.array("b_name"), F.map_from_entries("b_vector")) >= least
        want = {(r[0], r[1]) for r in a.join(b, (F.col("a_place") < F.col("b_place")) & close & alike).select("a_place", "b_place").collect()}
        got = {(r["a"], r["b"]) for r in compaction.affine_pairs(df, least, 400.0).collect()}
        assert got == want and want


def test_components_against_search(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1070)] + [(5, 5), (2000, 1999)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        if x != y:
            root[max(find(x), find(y))] = min(find(x), find(y))
    got = {r["node"]: r["root"] for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.connected(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_names_in_texts_by_their_rarest_word(spark):
    rng = random.Random(4)
    words = ["ramesh", "nagar", "west", "st.", "mary's", "gali", "no-5", "pune", "old"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)}) + ["--", "नगर पालिका"]
    texts = [(i, rng.choice("ab"), ", ".join(rng.choices(words + ["x"], k=rng.randint(0, 9))).replace(",", rng.choice(["", ",", " /"]))) for i in range(120)] + [(900, "a", "नगर पालिका ke paas"), (901, "b", None)]
    listed = [(rng.choice("ab"), n) for n in names for _ in range(2)]
    t = spark.createDataFrame(texts, "id long, pin string, text string")
    n = spark.createDataFrame(listed, "pin string, name string").distinct()
    got = {(r["id"], r["name"]) for r in L.contained(t, n, "id", "text", ["pin"], "name").collect()}
    want = {(r[0], r[1]) for r in t.join(n, "pin").where(X.contains_phrase(F.lower("text"), F.col("name")) & (F.size(X.word_tokens(F.col("name"))) > 0)).select("id", "name").collect()}
    assert got == want and len(want) > 50
    split = {r["name"]: set(r["w"]) for r in n.select("name", X.word_tokens(F.col("name")).alias("w")).distinct().collect()}
    count = {}
    for found in split.values():
        for w in found:
            count[w] = count.get(w, 0) + 1
    anchors = {r["name"]: r["word"] for r in L.anchors(n, [], "name").collect()}
    assert set(anchors) == {name for name in split if split[name]}
    assert all(count[w] == min(count[v] for v in split[name]) for name, w in anchors.items())


@pytest.mark.parametrize("split", ["128m", "700"])
def test_row_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    rows = [f"11{i:04d},Office {i} S.O,SO,WEST,DELHI,28.65,77.12" for i in range(90)]
    for k in range(2):
        head = "Pincode,OfficeName,OfficeType,District,StateName,Latitude,Longitude"
        (tmp_path / f"d{k}.csv").write_text("\n".join([head, *rows[k * 50 : k * 50 + 50]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["Pincode"]: r["line_no"] for r in files.read_directory(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"11{i:04d}": i for i in range(90)}


def test_pooling_as_a_tree(spark):
    rng = random.Random(6)
    rows = [(round(rng.random(), 2 if i % 2 else 6), rng.random() < 0.3 + 0.4 * (i % 3 == 0)) for i in range(900)] + [(0.5, None), (None, True)]
    df = spark.createDataFrame(rows, "score double, correct boolean")
    by_score = {}
    for s, c in rows:
        if s is not None and c is not None:
            by_score.setdefault(s, []).append(c)
    plain = E.Pooled()
    for s in sorted(by_score):
        plain.add(s, s, sum(by_score[s]) / len(by_score[s]), len(by_score[s]))
    want = [(x, label) for lo, hi, label, _ in plain.blocks for x in dict.fromkeys((lo, hi))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = E.isotonic_knots(E.fit_isotonic(df))
        assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_texts_meet_names_on_runs_of_words(spark):
    names = [("1", f"{a} {b} {i}") for a in ("big", "red") for b in ("ring", "bolt") for i in range(30)]
    long = "one two three four five six seven eight nine ten"
    names += [("1", long), ("1", long.replace("ten", "twelve")), ("2", "big ring 3"), ("1", "..."), ("1", "ring-bolt"), ("1", "a.b")]
    texts = [(1, "1", "house 3 opp Big Ring 3 and 4"), (2, "1", f"at {long} end"), (3, "1", "red bolt 29"), (4, "2", "big ring 30"), (5, "1", "ring bolt ring-bolt a.b"), (6, "1", ""), (7, "1", None), (8, None, "big ring 3"), (9, "1", "ring bolt")]
    t = spark.createDataFrame(texts, "id long, pin string, text string")
    n = spark.createDataFrame(names, "pin string, name string")
    want = {(r[0], r[1]) for r in t.join(n, "pin").where(X.contains_phrase(F.lower("text"), F.col("name"))).where("name <> '...'").select("id", "name").collect()}
    assert {(r["id"], r["name"]) for r in L.contained(t, n, "id", "text", ["pin"], "name").collect()} == want
    assert {(1, "big ring 3"), (2, long), (5, "ring-bolt"), (5, "a.b")} <= want
    # names that share words, but no run of them, do not meet
    runs = L.phrase_runs(n, ["pin"], "name").collect()
    assert sum(r["run"] == "big ring 3" for r in runs) == 2 and max(r["size"] for r in runs) == L.RUN_WORDS
    assert L.contained(t, n.where("name = 'none'"), "id", "text", ["pin"], "name").collect() == []


def test_words_of_phrases_are_cut_out_below_the_join(spark):
    c = spark.createDataFrame(
        [("q", "x", "Shiv Mandir", ["Shiv Temple"]), ("q", "y", None, []), ("q", "z", "--", ["shiv"])], "query_id string, landmark_id string, canonical_name string, aliases array<string>"
    )
    c = R.with_name_vector(c, "canonical_name")
    p = spark.createDataFrame([("q", 0, "shiv temple"), ("q", 1, ""), ("q", 2, "mandir")], "query_id string, phrase_pos int, phrase string")
    pairs = R.phrase_pairs(c, p)
    got = {(r["phrase_pos"], r["landmark_id"]): r["affinity"] for r in pairs.collect()}
    assert got[0, "x"] == 1.0 and got[2, "x"] >= 0.5 and got[0, "z"] >= 0.5 and got[1, "x"] == 0.0 and got[0, "y"] == 0.0
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan[: plan.index("Join")]


def test_landmarks_of_one_name_and_point_meet_others_as_one(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(compaction, "affine_pairs", lambda places, *more, f=compaction.affine_pairs: (seen.append(places.count()), f(places, *more))[1])
    rows = [(i, "Shiv Mandir", 28.65, 77.12) for i in range(5, 205)] + [(2, "Shiv Mandir", 28.6501, 77.12), (3, "--", 28.65, 77.12), (4, "--", 28.65, 77.12)]
    marks = spark.createDataFrame(rows, "landmark_id long, canonical_name string, lat double, lng double")
    marks = marks.selectExpr("*", "cast(array() as array<string>) as aliases", "1 as observation_count")
    found = sorted((r["landmark_id"], r["merged"]) for r in compaction.merge_landmarks(marks, metres=600.0).collect())
    assert found == [(2, 201), (3, 1), (4, 1)] and seen == [3]


def test_only_terms_that_queries_ask_for_are_kept(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(R, "impacts", lambda post, *more, f=R.impacts: (kept.extend(r["term"] for r in post.collect()), f(post, *more))[1])
    docs = spark.createDataFrame([(1, "red fort gate"), (2, "red market"), (3, "old lane")], "doc int, text string")
    asked = spark.createDataFrame([(7, "red gate")], "item int, text string")
    assert [r["doc"] for r in sorted(R.bm25(asked, docs, "item", "doc").collect(), key=lambda r: r["rank"])] == [1, 2]
    assert sorted(kept) == ["gate", "red", "red"]
