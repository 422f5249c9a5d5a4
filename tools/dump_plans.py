"""Write the physical plans of the headline queries to docs/PLANS.md."""
import os
import sys

ROOT = __file__.rsplit("/tools/", 1)[0]
sys.path.insert(0, ROOT)

from tandem.plans.queries import QUERIES  # noqa: E402
from tandem.session import build_session  # noqa: E402

NAMES = ("eval_report", "decode_by_codebook", "augment_variants", "encode_padded", "make_batches",
         "early_stop", "topk_checkpoints", "vicreg_by_shard", "clip_loss", "masked_mean_pool")

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
spark = build_session()
out = ["# Physical plans of the headline queries", "",
       f"Generated by `tools/dump_plans.py` at `{os.path.basename(sf.rstrip('/'))}` (local[8], 8 shuffle partitions, "
       "AQE on; plans shown before adaptive re-planning). Refresh after plan changes.", ""]
for name in NAMES:
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    plan = plan.replace(sf, "<sf>")
    out += [f"## {name}", "", "```", plan.rstrip(), "```", ""]
with open(os.path.join(ROOT, "docs", "PLANS.md"), "w") as f:
    f.write("\n".join(out))
print("written", sum(len(x) for x in out))
