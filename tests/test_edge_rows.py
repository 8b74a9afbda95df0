"""Operators on the invented edge rows of FIXTURES.md §2."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark import periods as P
from tallyspark import schemas as S
from tallyspark.operators import catalog, changes, inventory, kpis, rankings, sales_views
from tallyspark.sources.tables import conform


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_any_status_sums(edge):
    s, d = edge["sales"], edge["as_of"]
    assert one(kpis.period_sales_total(s, d, P.DAILY)).total == Decimal("30.00")
    assert one(kpis.period_sales_total(s, d, P.TRAILING7)).total == Decimal("85.00")
    assert one(kpis.period_sales_total(s, d, P.MONTHLY)).total == Decimal("137.50")
    assert one(kpis.monthly_forecast(s, d)).forecast == Decimal("151.250")


def test_completed_sums(edge):
    s, d = edge["sales"], edge["as_of"]
    c = "Completed"
    assert one(kpis.period_sales_total(s, d, P.DAILY, c)).total == Decimal("20.00")
    assert one(kpis.period_sales_total(s, d, P.TRAILING7, c)).total == Decimal("60.00")
    assert one(kpis.report_summary(s, d, "weekly")).total_sales == Decimal("105.00")
    assert one(kpis.period_sales_total(s, d, P.MONTHLY, c)).total == Decimal("112.50")
    r = one(kpis.completed_totals(s))
    assert (r.total_sales, r.total_transactions) == (Decimal("153.50"), 6)


def test_dashboard_strip_matches_single_kpis(edge):
    s, d = edge["sales"], edge["as_of"]
    r = one(kpis.dashboard_kpis(s, d))
    assert (r.daily, r.weekly, r.monthly, r.today_orders) == (
        Decimal("30.00"), Decimal("85.00"), Decimal("137.50"), 2)
    assert r.forecast == Decimal("151.250")
    k = one(kpis.report_kpis(s, d, "weekly"))
    assert (k.total_sales, k.total_transactions, k.weekly_sales, k.monthly_sales, k.today_orders) == (
        Decimal("105.00"), 3, Decimal("60.00"), Decimal("112.50"), 1)


def test_empty_period_sums_to_zero(edge):
    r = one(kpis.period_sales_total(edge["sales"], "1990-01-01", P.DAILY))
    assert r.total == Decimal("0.00")


def test_image_ranking_keeps_only_products_with_image(edge):
    out = rankings.top_products_with_image(edge["sales"], edge["products"], edge["as_of"], P.MONTHLY)
    assert [r.product_id for r in out.collect()] == [10]


def test_completed_ranking_keeps_orphans(edge):
    out = rankings.top_products_completed(edge["sales"], edge["products"], edge["as_of"], P.MONTHLY)
    rows = {r.product_id: r for r in out.collect()}
    assert None in rows and rows[None].category is None and rows[None].qty_sold == 4
    assert rows[11].qty_sold == 3 and rows[11].category == "B"


def test_category_ranking_drops_orphans(edge):
    rows = rankings.category_ranking(edge["sales"], edge["products"]).collect()
    cats = [(r.rank, r.category, r.total_sales) for r in rows]
    # Completed: A = 20 + 11, B = 45 + 30, NULL category = 7.50; orphan sale 6 dropped.
    assert cats == [(1, "B", Decimal("75.00")), (2, "A", Decimal("31.00")), (3, None, Decimal("7.50"))]


def test_search_is_case_and_accent_insensitive(edge):
    out = catalog.product_search(edge["products"], search="cafe")
    assert sorted(r.product_id for r in out.collect()) == [10, 11]
    assert catalog.product_search(edge["products"], search="0").count() == 3   # PHP empty
    assert sorted(r.product_id for r in catalog.product_search(edge["products"], search="%").collect()) == [10, 11, 12]
    assert [r.product_id for r in catalog.product_search(edge["products"], search="50%").collect()] == [12]


def test_sales_list_unit_price_and_badges(edge, spark):
    from tallyspark import schemas as S
    addons = spark.createDataFrame([(1, 1, 1, "Shot", Decimal("1.50")), (2, 1, 1, "Shot", Decimal("1.50"))],
                                   S.SALE_ADDONS)
    rows = sales_views.sales_list(edge["sales"], edge["products"], addons).collect()
    by_id = {r.sales_id: r for r in rows}
    assert by_id[8].unit_price == Decimal("0.00") and by_id[8].badge == "pending"
    assert by_id[3].unit_price == Decimal("15.00")
    assert by_id[2].badge == "cancelled" and by_id[4].badge == "void"
    assert len(by_id[1].addons) == 2 and by_id[5].addons == []
    assert by_id[1].can_cancel and by_id[1].has_image and not by_id[2].can_cancel and not by_id[5].has_image
    assert rows[-1].sales_id == 9          # NULL time sorts last
    assert by_id[6].product_category is None
    with pytest.raises(ValueError):
        sales_views.sales_list(edge["sales"], edge["products"], addons, on_date="15/05/2030")


@pytest.mark.parametrize("fn,expected", [
    ("stock_status", {1: "Low", 2: "Mid", 3: "Good", 4: "Mid", 5: "Low", 6: "Low", 7: "Low", 8: "Good"}),
])
def test_dashboard_stock_labels(edge, fn, expected):
    rows = getattr(inventory, fn)(edge["ingredients"]).collect()
    assert {r.ingredient_id: r.label for r in rows} == expected
    assert rows[0].stock is None      # NULL stock first


def test_card_levels_and_fill(edge):
    rows = {r.ingredient_id: r for r in inventory.stock_cards(edge["ingredients"]).collect()}
    assert {k: r.level for k, r in rows.items()} == {
        1: "low", 2: "mid", 3: "high", 4: "high", 5: "low", 6: "low", 7: "low", 8: "high"}
    assert {k: r.fill_pct for k, r in rows.items()} == {
        1: 33, 2: 100, 3: 100, 4: 100, 5: 0, 6: 0, 7: 0, 8: 100}


def test_search_levels_null_matches_nothing(edge):
    ing = edge["ingredients"]
    low = {r.ingredient_id for r in inventory.ingredient_search(ing, stock_level="low").collect()}
    mid = {r.ingredient_id for r in inventory.ingredient_search(ing, stock_level="mid").collect()}
    high = {r.ingredient_id for r in inventory.ingredient_search(ing, stock_level="high").collect()}
    assert (low, mid, high) == ({1, 7}, {2}, {3, 8})


def test_alerts_and_unit_labels(edge):
    ing = edge["ingredients"]
    r = inventory.low_stock_alert_count(ing).collect()[0]
    assert (r.alerts, r.message) == (2, "2 ingredients need restocking")
    labels = {x.unit_label for x in inventory.unit_labels(ing).collect()}
    assert "Box-based-based" in labels and "Other-based" in labels and "Pcs-based" in labels
    rep = inventory.inventory_report(ing, status="badge-bad").collect()
    assert {x.ingredient_id for x in rep} == {1, 5, 6, 7}


def test_price_sales(edge, spark):
    from tallyspark import schemas as S
    req = spark.createDataFrame([
        (1, 10, 2, [1, 1, 2, 99], None),
        (2, 10, 0, [1], None),
        (3, 999, 1, None, None),
        (4, 11, 3, [], None),
    ], S.SALE_REQUESTS)
    res = changes.price_sales(req, edge["products"], edge["addons"])
    acc = {r.sales_id: r for r in res.accepted.collect()}
    assert acc[1].total == Decimal("23.00") and acc[4].total == Decimal("45.00")
    assert acc[1].status == "Completed" and acc[1].product_name == "Café Uno"
    rej = {r.request_id: r.reason for r in res.rejects.collect()}
    assert rej == {2: "Invalid product or quantity.", 3: "Product not found."}
    assert [(r.sale_id, r.addon_id) for r in res.addon_rows.collect()] == [(1, 1)]


def test_product_changes_and_delete(edge, spark):
    from tallyspark import schemas as S
    ch = spark.createDataFrame([
        (1, "update", 999, "x", Decimal("1.00"), "A", "Available", "z.jpg"),
        (2, "update", 10, " New ", Decimal("12.00"), "A", "Available", ""),
    ], S.PRODUCT_CHANGES)
    out = changes.upsert_products(edge["products"], ch)
    rows = {r.product_id: r for r in out.table.collect()}
    assert set(rows) == {10, 11, 12}
    assert rows[10].product_name == "New" and rows[10].image == "a.jpg" and rows[10].price == Decimal("12.00")
    deleted = changes.delete_products(edge["products"], edge["sales"],
                                      spark.createDataFrame([(10,)], "product_id long"))
    s = {r.sales_id: r for r in deleted.sales.collect()}
    assert all(s[i].product_id is None and s[i].product_name == "Café Uno" for i in (1, 2, 7, 8))
    assert deleted.sales.count() == 9 and deleted.products.count() == 2


def test_collated_category_grouping(spark):
    from decimal import Decimal
    from tallyspark import schemas as S
    import datetime as dt
    sales = spark.createDataFrame([
        (1, 1, "a", 1, Decimal("5.00"), dt.datetime(2030, 1, 1), "Completed", None),
        (2, 2, "b", 2, Decimal("7.00"), dt.datetime(2030, 1, 1), "Completed", None),
    ], S.SALES)
    products = spark.createDataFrame([
        (1, "a", "Hot Coffee", Decimal("1"), "Available", None),
        (2, "b", "hot cöffee", Decimal("1"), "Available", None),
    ], S.PRODUCTS)
    assert rankings.category_ranking(sales, products).count() == 2
    rows = rankings.category_ranking(sales, products, collation="UNICODE_CI_AI").collect()
    assert len(rows) == 1 and rows[0].total_sales == Decimal("12.00") and rows[0].total_quantity == 3


def test_status_canonical_on_write(spark, edge, tmp_path):
    from tallyspark.sources.tables import read_table, write_table
    s = edge["sales"].withColumn("status", F.when(F.col("sales_id") == 1, F.lit("completed"))
                                 .otherwise(F.col("status")))
    write_table(s, str(tmp_path), "sales")
    back = read_table(spark, str(tmp_path), "sales")
    assert back.filter(F.col("status") == "completed").count() == 0
    assert back.filter(F.col("status") == "Completed").count() == 6
    assert back.filter(F.col("status") == "pending").count() == 1


def test_price_sales_default_time(edge, spark):
    import datetime as dt
    from tallyspark import schemas as S
    req = spark.createDataFrame([(1, 10, 1, [], None)], S.SALE_REQUESTS)
    at = dt.datetime(2030, 5, 15, 9, 30)
    res = changes.price_sales(req, edge["products"], edge["addons"], default_time=at)
    assert res.accepted.first().created_at == at


def test_reset_keeps_microseconds(spark):
    import datetime as dt
    from tallyspark import schemas as S
    sales = spark.createDataFrame([
        (1, 1, "a", 1, Decimal("1.00"), dt.datetime(2030, 1, 1, 12, 0, 0, 200000), "Completed", None),
        (2, 1, "a", 1, Decimal("1.00"), dt.datetime(2030, 1, 1, 12, 0, 0, 700000), "Completed", None),
    ], S.SALES)
    empty_addons = spark.createDataFrame([], S.SALE_ADDONS)
    empty_voids = spark.createDataFrame([], S.SALES_VOID)
    kept = changes.reset_history(sales, empty_addons, empty_voids, dt.datetime(2030, 1, 1, 12, 0, 0, 500000))
    assert [r.sales_id for r in kept.sales.collect()] == [2]


def test_top_k_survives_callers_limit(spark):
    """A caller's limit on the report top-k must return its first rows."""
    from tallyspark.sources import driver_tables as D
    sf = "/root/testdata/sf0.001"
    full = rankings.top_products_completed(D.sales_a(spark, sf), D.products(spark, sf), D.AS_OF_A, P.MONTHLY)
    rows = full.collect()
    assert [r.qty_sold for r in rows] == sorted((r.qty_sold for r in rows), reverse=True)
    assert full.limit(3).collect() == rows[:3]
    img = rankings.top_products_with_image(D.sales_a(spark, sf), D.products(spark, sf), D.AS_OF_A, P.MONTHLY)
    assert img.limit(3).collect() == img.collect()[:3]


def test_price_sales_repeated_request_id(edge, spark):
    req = spark.createDataFrame([
        (1, 10, 2, [1], None), (1, 10, 2, [], None),    # copies that differ
        (2, 11, 1, [], None),
    ], S.SALE_REQUESTS)
    res = changes.price_sales(req, edge["products"], edge["addons"])
    assert [r.sales_id for r in res.accepted.collect()] == [2]
    rej = sorted((r.request_id, r.reason) for r in res.rejects.collect())
    assert rej == [(1, "Duplicate key.")]     # one row per id whose copies differ
    assert res.addon_rows.count() == 0


def test_void_repeated_seq_rejected(edge, spark):
    import datetime as dt
    from tallyspark import schemas as S
    voids = spark.createDataFrame([
        (1, 1, " a ", dt.datetime(2030, 5, 16)), (1, 3, "b", dt.datetime(2030, 5, 16)),
        (2, 3, "\tc ", dt.datetime(2030, 5, 16)), (3, 0, "d", None), (4, 77, "e", None),
    ], S.VOID_REQUESTS)
    log = spark.createDataFrame([], S.SALES_VOID)
    res = changes.apply_voids(edge["sales"], log, voids)
    rej = sorted((r.seq, r.reason) for r in res.rejects.collect())
    assert rej == [(1, "Duplicate key."), (3, "Invalid sale."), (4, "Unknown sale.")]
    assert [(r.void_id, r.sale_id, r.reason) for r in res.sales_void.collect()] == [(2, 3, "c")]
    status = {r.sales_id: r.status for r in res.sales.collect()}
    assert status[3] == "VOID" and status[1] == "Completed"


def test_collated_name_grouping_in_top_sellers(spark):
    import datetime as dt
    from tallyspark import schemas as S
    sales = spark.createDataFrame([
        (1, 5, "Latte", 1, Decimal("3.00"), dt.datetime(2030, 5, 15, 9), "Completed", None),
        (2, 5, "latte", 2, Decimal("6.00"), dt.datetime(2030, 5, 15, 10), "Completed", None),
    ], S.SALES)
    products = spark.createDataFrame([(5, "Latte", "Hot", Decimal("3.00"), "Available", "l.jpg")], S.PRODUCTS)
    plain = rankings.top_products_completed(sales, products, "2030-05-15", P.DAILY).collect()
    assert len(plain) == 2
    folded = rankings.top_products_completed(sales, products, "2030-05-15", P.DAILY,
                                             collation="UNICODE_CI_AI").collect()
    assert len(folded) == 1 and folded[0].qty_sold == 3 and folded[0].category == "Hot"
    img = rankings.top_products_with_image(sales, products, "2030-05-15", P.DAILY, collation="UNICODE_CI_AI")
    assert img.count() == 1


def test_wildcard_search_folds_accents(edge):
    def ids(term):
        return sorted(r.product_id for r in catalog.product_search(edge["products"], search=term).collect())
    assert ids("cafe%uno") == [10]      # 'Café Uno' once accents are folded
    assert ids("CAF_ D%") == [11]       # '_' is exactly one character
    assert ids("CAFÉ%") == [10, 11]     # accents folded on the term too


def test_unit_labels_first_seen_order(edge):
    labels = [r.unit_label for r in inventory.unit_labels(edge["ingredients"]).collect()]
    # Stock ascending with NULL first: i5 (NULL, pcs), then stock 0 (Pack), 1 (Pack),
    # 5 (Box), 6 (Can), 15 (Box), 16 (NULL unit -> Other).
    assert labels == ["Pcs-based", "Pack-based-based", "Box-based-based", "Can-based-based", "Other-based"]


def test_alert_headline_singular_and_none(edge):
    ing = edge["ingredients"]
    one = inventory.low_stock_alert_count(ing.filter(F.col("ingredient_id") == 1)).first()
    assert (one.alerts, one.message) == (1, "1 ingredient needs restocking")
    none = inventory.low_stock_alert_count(ing.filter(F.col("ingredient_id") == 3)).first()
    assert (none.alerts, none.message) == (0, None)


def test_reset_drops_untimed_sales_and_their_children(edge, spark):
    import datetime as dt
    from tallyspark import schemas as S
    addons = spark.createDataFrame([(1, 9, 1, "Shot", Decimal("1.50")), (2, 3, 1, "Shot", Decimal("1.50"))],
                                   S.SALE_ADDONS)
    voids = spark.createDataFrame([(1, 9, "x", dt.datetime(2030, 6, 1)), (2, 3, "y", dt.datetime(2030, 6, 1))],
                                  S.SALES_VOID)
    kept = changes.reset_history(edge["sales"], addons, voids, dt.datetime(2030, 5, 15, 12, 0))
    assert sorted(r.sales_id for r in kept.sales.collect()) == [2, 3]       # sale 9 has no time
    assert [r.sale_id for r in kept.sale_addons.collect()] == [3]
    assert [r.sale_id for r in kept.sales_void.collect()] == [3]


def test_append_audit_without_reset_keeps_old_log(spark):
    import datetime as dt
    from tallyspark import schemas as S
    from tallyspark.operators import audit
    logs = spark.createDataFrame([(1, "u", "Add User", "a", dt.datetime(2030, 1, 1))], S.AUDIT_LOGS)
    entries = spark.createDataFrame([(2, "u", "Update Settings", "b", dt.datetime(2030, 1, 2))], S.AUDIT_ENTRIES)
    assert sorted(r.log_id for r in audit.append_audit(logs, entries).collect()) == [1, 2]
    reset = spark.createDataFrame([(3, "u", "Reset Logs", "All audit logs cleared", dt.datetime(2030, 1, 3)),
                                   (4, "u", "Add User", "c", dt.datetime(2030, 1, 4))], S.AUDIT_ENTRIES)
    assert sorted(r.log_id for r in audit.append_audit(logs, reset).collect()) == [3, 4]
    top = audit.recent_audit_logs(audit.append_audit(logs, entries), n=1).collect()
    assert [r.log_id for r in top] == [2]


@pytest.mark.parametrize("term,names", [
    ("a\\b", ["xaby"]), ("\\%", ["5% up"]), ("5\\", []), ("\\\\", ["c\\d"]), ("a\\\\b", []), ("_p", ["5% up"]),
    ("ech", ["Bánh ếch"]), ("e_h", ["Bánh ếch"]), ("ẾCH", ["Bánh ếch"]), ("e\u0301_h", ["Bánh ếch"]), ("%B%ec", ["Bánh ếch"])])
def test_search_terms(spark, term, names):
    """Escapes and accents, with and without wildcards."""
    rows = [(i, n, None, None, "Available", None) for i, n in enumerate(["xaby", "5% up", "c\\d", "Bánh ếch"])]
    found = catalog.product_search(spark.createDataFrame(rows, S.PRODUCTS), search=term).collect()
    assert [r.product_name for r in found] == names


def test_identical_repeats_count_once(spark, edge):
    t = dt.datetime(2030, 5, 15)
    req = spark.createDataFrame([(1, 10, 2, [1], t), (1, 10, 2, [1], t), (2, 10, 1, None, t), (2, 10, 3, None, t)], S.SALE_REQUESTS)
    req = req.union(req.limit(1).select(F.lit(None).cast("long"), *req.columns[1:]))
    res = changes.price_sales(req, edge["products"], edge["addons"])
    assert [(r.sales_id, r.quantity) for r in res.accepted.collect()] == [(1, 2)]
    assert sorted((r.request_id or 0, r.reason) for r in res.rejects.collect()) == [(0, "Missing key."), (2, "Duplicate key.")]


def test_repeated_change_numbers_are_reported(spark, edge):
    rows = [(5, "insert", 9, "A", Decimal("1.00"), "c", "Available", None), (5, "insert", 9, "B", Decimal("1.00"), "c", "Available", None),
            (6, "insert", 8, "C", Decimal("2.00"), "c", "available", None), (6, "insert", 8, "C", Decimal("2.00"), "c", "available", None)]
    out = changes.upsert_products(edge["products"], spark.createDataFrame(rows, S.PRODUCT_CHANGES))
    new = [(r.product_id, r.product_name, r.status) for r in out.table.filter("product_id < 10").collect()]
    assert new == [(8, "C", "Available")]
    assert [(r.seq, r.key, r.reason) for r in out.rejects.collect()] == [(5, 9, "Repeated change number.")]


def test_totals_beyond_the_column_are_rejected(spark, edge):
    big = spark.createDataFrame([(1, "x", "c", Decimal("9999999999.00"), "Available", None)], S.PRODUCTS)
    req = spark.createDataFrame([(1, 1, 2, None, dt.datetime(2030, 5, 15)), (2, 1, 1, None, dt.datetime(2030, 5, 15))], S.SALE_REQUESTS)
    res = changes.price_sales(req, big, edge["addons"])
    assert [r.sales_id for r in res.accepted.collect()] == [2]
    assert [(r.request_id, r.reason) for r in res.rejects.collect()] == [(1, "Total out of range.")]


def test_large_limits_and_image_zero(spark):
    rows = [(1, "i", 5, 2 ** 31 - 1, "u", "0"), (2, "j", 2 ** 31 - 1, 2 ** 30, "u", "x.png")]
    ing = spark.createDataFrame(rows, S.INGREDIENTS)
    cards = {r.ingredient_id: r for r in inventory.stock_cards(ing).collect()}
    assert not cards[1].has_image and cards[2].has_image and cards[1].level == "low" and cards[2].level == "mid"
    assert inventory.stock_status(ing).count() == 2 and inventory.inventory_report(ing).count() == 2
    assert [r.ingredient_id for r in inventory.ingredient_search(ing, stock_level="mid").collect()] == [2]


def test_names_sort_without_case_and_accents(spark):
    rows = [(i, n, "c", Decimal("1.00"), "available", None) for i, n in enumerate(["Banana", "apple", "Éclair", "date", "cherry"])]
    p = conform(spark.createDataFrame(rows, S.PRODUCTS), "products")
    want = ["apple", "Banana", "cherry", "date", "Éclair"]
    assert [r.product_name for r in catalog.sellable_products(p).collect()] == want
    pages = catalog.menu_pages(p, page_size=2).collect()
    assert [x.product_name for r in pages for x in r.items] == want


def test_filter_tags():
    from tallyspark.functions.labels import filter_tag
    assert [filter_tag(x) for x in ("badge-bad", "badge-mid", "badge-good", "odd")] == ["Low", "Medium", "Good", "odd"]


def test_export_folder_stays_inside(edge, tmp_path):
    from tallyspark.plans import export
    out = export.export_report(edge["sales"], "2030-05-15", "/../../other", str(tmp_path))
    assert out == str(tmp_path / "Report_All_2030-05-15")


def test_attach_refuses_managed_tables_and_odd_names(spark):
    from tallyspark.sources.tables import attach_bucketed
    spark.range(1).write.mode("overwrite").saveAsTable("tally_managed")
    try:
        for name in ("tally_managed", "a; DROP TABLE x", "a b"):
            with pytest.raises(ValueError):
                attach_bucketed(spark, name, "/nowhere", "sales", 4)
        assert spark.table("tally_managed").count() == 1
    finally:
        spark.sql("DROP TABLE tally_managed")


def test_search_folds_letters_of_any_script(spark):
    from tallyspark.functions.text import _fold_text, fold_accents, search_filter
    names = ["Καφές", "ΚΑΦΕΣ", "καφες φίλτρου", "Чёрный чай", "ガム", "ガム", "Crème", "한과", "하과"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = lambda term: {r.name for r in df.filter(search_filter("name", term)).collect()}
    assert found("καφες") == found("ΚΑΦΈΣ") == {"Καφές", "ΚΑΦΕΣ", "καφες φίλτρου"}
    assert found("κ_φες φιλ%") == {"καφες φίλτρου"}
    assert found("черныи") == found("ЧЁРНЫЙ") == {"Чёрный чай"}
    assert found("カム") == {"ガム", "ガム"}
    assert found("creme") == {"Crème"}
    assert found("하") == {"하과"}
    assert all(r[0] == _fold_text(r[1]) for r in df.select(fold_accents("name"), "name").collect())
