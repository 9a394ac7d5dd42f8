"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairlake import session  # noqa: E402
from pairlake.plans import registry  # noqa: E402

HEADLINE = (
    "flagship", "split_exact", "pairs_replicated", "attach_texts", "pair_targets", "lex_value", "inject", "interleave",
    "rename", "inject_dead", "profile_cells", "html_nodes", "tree_distance", "datapair", "token_distance", "token_frequencies",
    "describe", "fit_vocab", "encode", "select_segments", "cosine01", "clone_search", "roc_auc", "evaluate_scores", "read_cells",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        f"local[{cpus}]", "bench", spark__driver__memory="10g", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one small run first, so that the start of JVM and Python is not booked on the first query
    registry.QUERIES["string_distance"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE:
        start = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
        session.drop_cuts(spark)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
