"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints
one JSON line. Every query runs to its last row (the no-op sink). The index is
built once, by the entry of that name, and read by the searches; a run over the
smallest tables beforehand starts Python's workers and compiles code."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from textmill import queries
from textmill.plans.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("index_build", "bm25_topk", "hybrid_fusion", "hybrid_search", "vector_search", "extractive_answer", "hard_split_chunks", "exact_dedup", "term_frequency", "knn_batch", "hashed_embedding", "verify_orphan_terms")


def main() -> None:
    spark = session(f"local[{CPUS}]", int(CPUS), spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str, sf_dir: str) -> float:
        start = time.perf_counter()
        if name == "index_build":
            queries._index(spark, sf_dir)
        else:
            run: Callable = queries.QUERIES[name]
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = os.path.join(os.path.dirname(SF_DIR), "sf0.001")
    if os.path.isdir(small):
        for name in ("index_build", "bm25_topk", "hashed_embedding"):
            timed(name, small)
    took = {name: timed(name, SF_DIR) for name in HEADLINE}
    print(json.dumps({"metric": "seconds for the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    main()
