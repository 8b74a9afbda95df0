"""Benchmark: headline operators on stored tables at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

1. The driver's tables are adapted once into the back-office layout and
   written as Parquet under a fresh scratch folder (sales partitioned by
   month, every table clustered by its key; event sales and add-on rows also
   bucketed by sale id), timed as ``load_seconds``.
2. Each headline operator then runs on the stored tables: one warm-up run,
   then the median of five timed runs. Each run executes the whole plan into
   Spark's ``noop`` sink, so nothing is collected to the driver.

Prints one JSON line: metric, value (sum of the per-query medians, seconds),
per-query seconds, scale factor.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def _sf(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def build_plans(spark, sf_dir: str, root: str):
    """Store the adapted tables under ``root``; return (load seconds, plans)."""
    from tallyspark.sources import driver_tables as D
    from tallyspark.sources.tables import read_bucketed, read_table, save_bucketed, write_table
    from tallyspark import periods as P
    from tallyspark.operators import audit, catalog, changes, inventory, kpis, rankings, sales_views

    SF_DIR = sf_dir
    t0 = time.perf_counter()
    adapters = {
        "sales": D.sales_a, "products": D.products, "addons": D.addons,
        "sale_addons": D.sale_addons, "sales_void": D.sales_void,
        "ingredients": D.ingredients, "audit_logs": D.audit_logs,
    }
    for name, fn in adapters.items():
        write_table(fn(spark, SF_DIR), root, name)
    # Event sales and add-on rows are also stored bucketed by the sale id
    # (same bucket count), the layout for the sale-id joins of the list.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events_root = os.path.join(root, "events_shop")
    save_bucketed(D.sales_b(spark, SF_DIR), "sales", "bench_sales_b", os.path.join(events_root, "sales"), buckets)
    save_bucketed(D.sale_addons(spark, SF_DIR), "sale_addons", "bench_sale_addons",
                  os.path.join(events_root, "sale_addons"), buckets)
    feeds = {
        "sale_requests": D.sale_requests, "cancel_requests": D.cancel_requests,
        "void_requests": D.void_requests, "product_changes": D.product_changes,
        "audit_entries": D.audit_entries,
    }
    for name, fn in feeds.items():
        fn(spark, SF_DIR).write.mode("overwrite").parquet(os.path.join(root, "feeds", name))
    load_seconds = time.perf_counter() - t0

    def t(name):
        return read_table(spark, root, name)

    sales, products = t("sales"), t("products")
    sales_b = read_bucketed(spark, "bench_sales_b", "sales")
    addons_b = read_bucketed(spark, "bench_sale_addons", "sale_addons")
    feed = {n: spark.read.parquet(os.path.join(root, "feeds", n)) for n in feeds}
    a = D.AS_OF_A

    plans = {
        "dashboard_kpis": lambda: kpis.dashboard_kpis(sales, a),
        "report_kpis_monthly": lambda: kpis.report_kpis(sales, a, "monthly"),
        "completed_totals": lambda: kpis.completed_totals(sales),
        "top_with_image_monthly": lambda: rankings.top_products_with_image(sales, products, a, P.MONTHLY),
        "top_completed_monthly": lambda: rankings.top_products_completed(sales, products, a, P.MONTHLY),
        "category_ranking": lambda: rankings.category_ranking(sales, products),
        "report_transactions_monthly": lambda: sales_views.report_transactions(sales, a, "monthly"),
        "sales_list_all": lambda: sales_views.sales_list(sales_b, products, addons_b),
        "product_search": lambda: catalog.product_search(products, "ring", "standard", "Available"),
        "stock_status": lambda: inventory.stock_status(t("ingredients")),
        "inventory_report": lambda: inventory.inventory_report(t("ingredients")),
        "price_sales": lambda: changes.price_sales(feed["sale_requests"], products, t("addons")).accepted,
        "apply_status_changes": lambda: changes.apply_status_changes(
            sales_b, feed["cancel_requests"], feed["void_requests"]),
        "upsert_products": lambda: changes.upsert_products(products, feed["product_changes"]).table,
        "append_audit": lambda: audit.append_audit(t("audit_logs"), feed["audit_entries"]),
        "report_summary_weekly": lambda: kpis.report_summary(sales, a, "weekly"),
        "sales_list_search_day": lambda: sales_views.sales_list(
            sales_b, products, addons_b, search="bolt", on_date=D.AS_OF_B),
        "addons_by_sale": lambda: sales_views.addons_by_sale(addons_b),
        "stock_cards": lambda: inventory.stock_cards(t("ingredients")),
        "low_stock_alerts": lambda: inventory.low_stock_alerts(t("ingredients")),
        "reset_history_addons": lambda: changes.reset_history(
            sales_b, addons_b, t("sales_void"), "2024-01-15 12:00:00").sale_addons,
        "recent_audit_logs": lambda: audit.recent_audit_logs(t("audit_logs")),
        "menu_pages": lambda: catalog.menu_pages(products),
    }
    return load_seconds, plans


def main() -> None:
    from tallyspark.session import local_session

    spark = local_session(CPUS, shuffle_partitions=int(CPUS) * 2, app_name="tallyspark-bench")
    root = tempfile.mkdtemp(prefix="tallyspark-bench-", dir=os.environ.get("TMPDIR", "/tmp"))
    load_seconds, plans = build_plans(spark, SF_DIR, root)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    timings, spread = {}, {}
    for name, build in plans.items():
        run(build())  # warm-up: file listing, code generation
        runs = []
        for _ in range(RUNS):
            s = time.perf_counter()
            run(build())
            runs.append(time.perf_counter() - s)
        timings[name] = round(statistics.median(runs), 4)
        spread[name] = [round(min(runs), 4), round(max(runs), 4)]

    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": _sf(SF_DIR),
        "load_seconds": round(load_seconds, 3),
        "cpus": CPUS,
        "runs": RUNS,
        "spread": spread,
        "machine": {"cores": os.cpu_count(), "memory_gb": round(os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2 ** 30, 1)},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
