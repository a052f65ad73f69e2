"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tagloom.plans import QUERIES  # noqa: E402
from tagloom.session import local_session  # noqa: E402

HEADLINE = ["near_pairs", "near_groups", "select_tags", "captions", "caption_fit", "ref_scores", "matches", "copy_pool", "tag_stats",
            "policy_flag", "nms", "people_state", "export_names", "run_progress", "loss_curve", "events_tumbling"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["tag_topk"](spark, sf).count()  # warm the session and the page cache
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
