"""Every benchmarked operator builds and runs on the smallest tables."""
import tempfile

import bench


def test_bench_plans_run(spark):
    root = tempfile.mkdtemp(prefix="tallyspark-bench-smoke-")
    load_seconds, plans = bench.build_plans(spark, "/root/testdata/sf0.001", root)
    assert load_seconds > 0 and len(plans) >= 20
    for name, build in plans.items():
        build().write.format("noop").mode("overwrite").save()
