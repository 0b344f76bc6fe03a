"""Prints one JSON line with the seconds of the headline queries.

`queries` are whole queries from Parquet files to results. `index` tells what an index costs once, and what a search costs that
finds it there; it is not part of the sum.
"""

import json
import os
import time
import uuid

from pyspark.sql import SparkSession

from lumenfold import catalog
from lumenfold.operators.indexes import KeywordIndex
from lumenfold.sources.store import work_dir

HEADLINE = ("bm25_topk", "vector_topk", "rrf_hybrid", "regex_search", "grep_context", "exact_duplicates", "callgraph_edges", "impact_bfs", "sessionize_ttl", "rate_window", "summary_rollup", "uncovered_blocks", "token_budget_prefix", "line_metrics")
TRAINING = ("op1_language_id", "op2_near_duplicates", "op3_nearest_vectors", "op4_tool_calls", "op5_weak_quality", "op6_line_dedup", "op7_source_mix", "op8_context_tree_scores", "op9_vector_duplicates", "op10_piece_sampling", "op11_ranked_search", "op12_line_rules", "op13_collocations")


def seconds(work) -> float:
    began = time.time()
    work()
    return round(time.time() - began, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    write = lambda df: df.write.format("noop").mode("overwrite").save()
    catalog.QUERIES["summary_rollup"](spark, sf).collect()
    found = {name: seconds(lambda: write(catalog.QUERIES[name](spark, sf))) for name in HEADLINE}  # noqa: B023
    index = KeywordIndex(spark, f"{work_dir(spark)}/bench-{uuid.uuid4().hex}")
    stored = {"bm25_build": seconds(lambda: index.build(spark.read.parquet(f"{sf}/documents.parquet")))}
    stored["bm25_search"] = min(seconds(lambda: write(index.search("the and que", 10))) for _ in range(3))
    stored["phrase_search"] = min(seconds(lambda: write(index.search('"of the" and', 10))) for _ in range(3))
    training = {}
    try:
        from lumenfold.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    for name in TRAINING:
        if name in QUERIES:
            training[name] = seconds(lambda: write(QUERIES[name](spark, sf)))  # noqa: B023
    every = found | training
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": every, "index": stored, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
