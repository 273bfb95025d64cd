from collections import Counter

from waymark.functions import tables
from waymark.plans import catalog
from waymark.plans.registry import JOBS
from waymark.sources.warehouse import Warehouse


def test_corpus_rows_are_graded_by_their_own_perturbations_and_results(spark, sf):
    catalog.load()
    corpus = Warehouse(spark, sf).table("corpus").select("address_id", "perturbations").collect()
    marks = Counter(x for r in corpus for x in (r["perturbations"] or ["clean"]))
    graded = Warehouse(spark, sf).table("corpus_graded").collect()
    assert Counter(r["config"] for r in graded) == dict.fromkeys(("A", "R1", "R2"), len(corpus)) and len(marks) > 5
    counted = Counter()
    for r in JOBS["corpus_by_perturbation"].run(spark, sf).collect():
        counted[r["config"], r["perturbation"], r["field"]] += r["tp"] + r["tn"] + r["fp"] + r["fn"] - r["wrong"]
    assert counted == {(c, x, f): n for c in ("A", "R1", "R2") for x, n in marks.items() for f in tables.FIELDS}
    runs = {r["config"]: r for r in JOBS["corpus_ablation"].run(spark, sf).collect()}
    for c in ("A", "R1", "R2"):
        mine = [r for r in graded if r["config"] == c]
        assert runs[c]["above"] == sum(r["confidence"] >= 0.8 for r in mine)
        assert abs(runs[c]["resolved"] - sum(r["status"] == "RESOLVED" for r in mine) / len(mine)) < 1e-6
