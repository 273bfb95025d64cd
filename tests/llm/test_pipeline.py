import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from test_decontaminate import plain as plain_hits
from test_shingles import plain_groups
from test_tokens import expected

from waymark.llm import mixing, setsketch, tokens
from waymark.llm.toxicity import scored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_another(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{i}")
        kept.append([tuple(r) for r in docs.collect()])
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    last = sorted(tuple(r) for r in docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    first, nontoxic, distinct, clean, mixed = kept
    predicted = {r["doc_id"]: r["predicted"] for r in scored(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(nontoxic) == sorted(r for r in first if not predicted[r[0]])
    groups, links = plain_groups([r[0] for r in nontoxic], [r[1] for r in nontoxic])
    assert sorted(distinct) == sorted(r for r, c in zip(nontoxic, groups) if r[0] == c) and len(distinct) < len(nontoxic) and links
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in plain_hits([(r[0], r[1]) for r in distinct], items) if r[5]}
    assert sorted(clean) == sorted(r for r in distinct if r[0] not in hit) and hit
    times = Counter(mixed)
    assert set(times) <= set(clean) and max(times.values()) <= 2
    words, target = defaultdict(int), {}
    for r in mixed:
        words[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    for r in mixing.mixed(spark.createDataFrame(clean, docs_schema())).collect():
        target[next(x[3] for x in clean if x[0] == r["doc_id"])] = r["target"]
    for source, t in target.items():  # short by less than the smallest document that could be taken once more
        sizes = {n: [len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in clean if r[3] == source and times[r] == n] for n in (0, 1)}
        unused = [x for x in sizes[0] or sizes[1] if x]
        assert -1 <= t - words[source] < min(unused, default=0) + 1
    ordered = sorted((r[0], r[1]) for r in mixed)
    assert last == sorted(expected(ordered, tokens.load(public_tokenizers.path("word_bpe_49k.json"))))


def docs_schema():
    return "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_with_edge_rows(spark, sf):
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (None, "a b c", None, "s", 5), (2, "", "en", "s", 0), (3, "x y z w", "en", "t", 7), (3, "x y z w", "en", "t", 7)]
    docs = spark.createDataFrame(rows, docs_schema())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id > 90"), sf).collect() == []
        stage(spark, docs, sf).collect()
    once = [tuple(r) for r in setsketch.deduplicated(docs).collect()]
    assert sorted(once, key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
    times = Counter(tuple(r) for r in mixing.dealt_out(docs).collect())
    assert set(times) <= set(rows) and sum(times.values()) >= 2
