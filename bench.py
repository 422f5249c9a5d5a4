"""Benchmark the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3). Each query runs once to warm up, then BENCH_RUNS
times; the reported time is the median. Results go to Spark's ``noop`` sink,
so the whole plan executes and nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tandem.plans.queries import QUERIES  # noqa: E402
from tandem.session import build_session  # noqa: E402

HEADLINE = (
    "eval_report", "eval_report_by_group", "bleu_canonical", "tanimoto_bits", "pair_status",
    "decode_by_codebook", "canonical_match", "augment_variants",
    "build_vocab", "encode_padded", "decode_ids", "make_batches", "seed_replicas",
    "masked_mean_pool", "project_embeddings", "vicreg", "vicreg_by_shard", "clip_loss", "token_cross_entropy",
    "topk_checkpoints", "early_stop", "lr_one_cycle", "validation_plan", "metric_log_summary",
    "run_catalog", "batch_generate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = os.environ.get("BENCH_ONLY")
    names = [n for n in HEADLINE if not only or n in only.split(",")]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    out: dict[str, float] = {}
    for name in names:
        q = QUERIES[name]
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        times = []
        for _ in range(runs):
            t = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        out[name] = round(statistics.median(times), 3)
        print(f"# {name}: {out[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
