"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from waymark.plans import catalog  # noqa: F401
from waymark.plans.registry import JOBS
from waymark.session import local_session
from waymark.sources.warehouse import forget

HEADLINE = (
    "place_by_pincode", "normalise_addresses", "parse_addresses", "build_gazetteer", "nearby_landmarks",
    "bm25_documents", "knn_embeddings", "hybrid_retrieve", "resolve_rules_only", "resolve_lexical", "resolve_hybrid",
    "learning_audit", "asof_cache_hit", "near_duplicate_join", "metric_windows", "contact_decisions", "fold_documents",
    "strip_phones_documents", "perturb",
)
CHAINS = {"resolve_rules_only": "A", "resolve_lexical": "R1", "resolve_hybrid": "R2"}


def timed(spark, name: str, sf_dir: str) -> float:
    """Seconds to compute every row and column of a job."""
    start = time.time()
    JOBS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "waymark-bench")
    cold, warm = {}, {}
    for name in HEADLINE:
        forget()  # neither run reads what another job, or its own first run, has written
        cold[name] = timed(spark, name, sf_dir)
        forget()
        warm[name] = timed(spark, name, sf_dir)
    addresses = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, warm total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in warm.items()},
                "cold": {k: round(v, 3) for k, v in cold.items()},
                "addresses_per_sec": {c: round(addresses / warm[n], 1) for n, c in CHAINS.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
