"""Hot-key check: run the skew-sensitive operators on inputs where one key
holds a third of all rows, and report per-stage task times from Spark's
event log (max task vs median task).

The inputs are derived from the driver's ``orders`` table: every third order
is re-assigned to one author (or one query), the rest keep their customer.

usage: python tools/skew_check.py [sf_dir] [event_log_dir]
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = sys.argv[2] if len(sys.argv) > 2 else "/tmp/skewlog"
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quire.session import ship_package

    ship_package(spark)
    from quire.operators.indexing import grouped_running_sums
    from quire.operators.metrics import per_query_metrics
    from quire.operators.similarity import author_pairs
    from quire.plans.pairs import build_cross_role_pairs
    from quire.sources import fixtures as fx

    o = fx.table(spark, sf_dir, "orders")
    hot = F.col("o_orderkey") % 3 == 0
    docs = o.select(
        F.when(hot, F.lit("hot")).otherwise(F.col("o_custkey").cast("string")).alias("author_id"),
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_orderkey").alias("seq"),
        # the hot author is candidate-only; others have both roles
        F.when(hot | (F.col("o_orderkey") % 3 == 1), "candidate").otherwise("query").alias("side"),
        F.array(
            *[F.sin(F.col("o_orderkey") * (k + 1) + F.col("o_totalprice")).cast("double") for k in range(8)]
        ).alias("vec"),
    )
    results = {}

    def run(name, df):
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        results[name] = {"sec": round(time.perf_counter() - t0, 2)}

    run("running_sums_hot_author", grouped_running_sums(
        docs.select("author_id", "doc_id", F.lit(1).alias("one")), ["author_id"], ["doc_id"], ["one"], totals=True
    ))
    spark.sparkContext.setJobGroup("pairs_hot_candidate_author", "pairs_hot_candidate_author")
    t0 = time.perf_counter()
    ps = build_cross_role_pairs(docs.drop("vec"), "train", 1, strict=False)
    ps.rows.write.format("noop").mode("overwrite").save()
    results["pairs_hot_candidate_author"] = {"sec": round(time.perf_counter() - t0, 2)}
    small_hot = docs.where(~hot | (F.col("doc_id") % 30 == 0))  # hot author: ~5k docs at sf0.1
    run("within_author_max_hot_author", author_pairs(small_hot, emit="max"))
    scores = o.select(
        F.when(hot, F.lit(0)).otherwise(F.col("o_custkey")).alias("query_id"),
        F.col("o_orderkey").alias("candidate_id"),
        F.round(F.sin(F.col("o_totalprice")), 3).alias("score"),
        (F.col("o_orderkey") % 7 == 0).cast("int").alias("label"),
    )
    run("eer_ap_hot_query", per_query_metrics(scores))
    spark.stop()

    import zstandard  # noqa: F401  (event logs may be compressed)

    app = sorted(glob.glob(os.path.join(log_dir, "*")), key=os.path.getmtime)[-1]
    files = sorted(glob.glob(os.path.join(app, "events_*"))) if os.path.isdir(app) else [app]
    stage_group, tasks = {}, {}
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        for line in raw.decode().splitlines():
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                g = e.get("Properties", {}).get("spark.jobGroup.id")
                for sid in e["Stage IDs"]:
                    stage_group[sid] = g
            elif e["Event"] == "SparkListenerTaskEnd":
                ti = e["Task Info"]
                tasks.setdefault(e["Stage ID"], []).append(ti["Finish Time"] - ti["Launch Time"])
    for name in results:
        worst = None
        for sid, durs in tasks.items():
            if stage_group.get(sid) != name or len(durs) < 2 or max(durs) < 200:
                continue
            ratio = max(durs) / max(1.0, statistics.median(durs))
            if worst is None or max(durs) > worst["max_task_ms"]:
                worst = {"stage": sid, "tasks": len(durs), "max_task_ms": max(durs),
                         "median_task_ms": statistics.median(durs), "max_over_median": round(ratio, 1)}
        results[name]["slowest_stage"] = worst
    print(json.dumps(results, indent=1))


if __name__ == "__main__":
    main()
