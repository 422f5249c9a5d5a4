"""Scan the physical plan of every registered query for operators that do not
scale: cartesian products, nested-loop joins, single-partition exchanges,
row-at-a-time Python UDFs. Prints one line per query."""
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tandem.plans.queries import QUERIES  # noqa: E402
from tandem.session import build_session  # noqa: E402

FLAGS = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython")
STREAMING = {"streaming_eval", "streaming_early_stop", "streaming_metric_windows",
             "sink_eval_tsv", "sink_predictions_csv", "sink_metrics_json"}

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = build_session()
for name, q in QUERIES.items():
    if name in STREAMING:
        continue  # these run their jobs inside the call; plans are checked via their parts
    plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
    hits = {f: plan.count(f) for f in FLAGS if f in plan}
    n_ex = plan.count("Exchange ")
    print(f"{name:26s} exchanges={n_ex:3d} {hits if hits else ''}", flush=True)
