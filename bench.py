"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

Times are of fresh plans run to the end (no-op sink), after a warm-up on the same plans.  The
``c1_*`` entries are the published configuration: 100,000 x 100,000, 1,000,000 entries, rank 10.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from rankweave import catalogue as C  # noqa: E402
from rankweave.model import MatrixMeta, Problem  # noqa: E402
from rankweave.operators import loss as L  # noqa: E402
from rankweave.plans import als, sgd  # noqa: E402
from rankweave.sources import generate as G  # noqa: E402

HEADLINES = (
    "nnz_rows", "crossprod_w", "sum_of_squares", "loss_nzsl", "loss_sl", "loss_gkl", "loss_nzl2", "project_frequent", "kcore", "update_nzsl_l2",
    "regularize_nzl2", "balance_optimal_nzl2", "als_half_step_r2", "gnmf_h_step", "lee_w_step", "sections", "cos_dist",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="rankweave-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{scratch}/checkpoints")
        .config("spark.sql.autoBroadcastJoinThreshold", "64m").config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    done = lambda df: df.write.format("noop").mode("overwrite").save()

    def timed(f) -> float:
        best = []
        for _ in range(3):
            t = time.perf_counter()
            f()
            best.append(time.perf_counter() - t)
        return round(min(best[1:]), 4)

    found = {name: timed(lambda name=name: done(C.QUERIES[name](spark, sf_dir))) for name in HEADLINES}

    p, _, _ = G.problem(spark, G.RandomMatrix(100_000, 100_000, 1_000_000, 100_000, 10, "Normal(0,3.1622776601683795)", "Normal(0,1)"))
    for name in ("v", "test", "w", "h"):
        getattr(p, name).write.parquet(f"{scratch}/{name}")
    load = lambda name: spark.read.parquet(f"{scratch}/{name}").cache()
    v, test, w, h = (load(n) for n in ("v", "test", "w", "h"))
    for df in (v, test, w, h):
        df.count()
    c1 = Problem(v, w, h, MatrixMeta(100_000, 100_000), 10, test)
    found["c1_train_loss"] = timed(lambda: L.squared(v, w, h, 10).collect())
    found["c1_test_loss"] = timed(lambda: L.squared(test, w, h, 10).collect())
    run = sgd.Stratified(c1, sgd.Rule("Nzsl_L2", (1.0,)), 4, 8)
    epochs = iter(range(1, 100))
    found["c1_overlapped_epoch"] = timed(lambda: run.epoch(next(epochs), 0.001, 1))
    found["c1_als_half_step"] = timed(lambda: done(als.half_step(v, h, w, 10, lam=1.0)))
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
