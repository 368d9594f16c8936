"""Task-retry check: the same epoch of pairs and the same EER/AP come out
when tasks upstream fail on their first attempt and are retried.

Runs in its own process with ``local[4,3]`` (three attempts per task) and
prints ``OK`` or the differences.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"


def flaky(df):
    """Pass rows through, failing the first attempt of every other task."""

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        if ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
            raise RuntimeError("injected failure (first attempt)")
        yield from batches

    return df.repartition(4).mapInPandas(run, df.schema)


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4,3]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from quire.session import ship_package

    ship_package(spark)
    from quire.plans import pairs as P
    from quire.plans import scoring
    from quire.plans.registry import _resolved
    from quire.sources import fixtures as fx

    docs = _resolved(spark, SF)
    clean = sorted(tuple(r) for r in P.build_cross_role_pairs(docs, "train", 2, strict=False).rows.collect())
    retried = sorted(tuple(r) for r in P.build_cross_role_pairs(flaky(docs), "train", 2, strict=False).rows.collect())

    scored = scoring.scored_with_truth(fx.fx_queries(spark, SF), fx.fx_candidates(spark, SF))
    m1 = sorted(tuple(r) for r in scoring.evaluate_attribution(scored)[0].collect())
    m2 = sorted(tuple(r) for r in scoring.evaluate_attribution(flaky(scored))[0].collect())
    spark.stop()
    problems = []
    if clean != retried:
        problems.append("pairs differ after retries")
    if m1 != m2:
        problems.append("metrics differ after retries")
    print("OK" if not problems else "; ".join(problems))


if __name__ == "__main__":
    main()
