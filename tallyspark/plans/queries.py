"""Registered queries: each loads the adapted driver tables of one scale
directory and runs one operator over the whole of them.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the SQL oracle. Money leaves as ``double`` and counts as
``bigint`` (``for_compare``), after exact decimal arithmetic inside.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import periods as P
from tallyspark.functions.text import search_filter
from tallyspark.operators import kpis as K
from tallyspark.operators import rankings as R
from tallyspark.operators import sales_views as V
from tallyspark.operators import catalog as C
from tallyspark.operators import inventory as I
from tallyspark.operators import changes as CH
from tallyspark.operators import audit as AU
from tallyspark.plans import export as EX
from tallyspark.plans import stored as ST
from tallyspark.streaming import kpi_stream as KS
from tallyspark.session import ensure_checkpoint_dir
from tallyspark.sources import driver_tables as D
from tallyspark.sources import search_index as SI
from tallyspark.sources.tables import SALE_MONTH, read_table, write_table

AS_OF_A = D.AS_OF_A
AS_OF_B = D.AS_OF_B


def for_compare(df: DataFrame) -> DataFrame:
    """Decimals to double, integral types to bigint; nothing else changes."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = lambda spark, sf_dir: for_compare(fn(spark, sf_dir))
        REGISTRY[name].__doc__ = fn.__doc__
        return fn
    return deco


# --- Period KPIs (set A: line-item sales, report date 1998-06-17) ----------


@register("daily_total_any_status")
def _q(spark, d):
    """O01 dashboard daily total, every status."""
    return K.period_sales_total(D.sales_a(spark, d, names=False), AS_OF_A, P.DAILY)


@register("trailing7_total_completed")
def _q(spark, d):
    """O01 report trailing-7 total, Completed only."""
    return K.period_sales_total(D.sales_a(spark, d, names=False), AS_OF_A, P.TRAILING7, "Completed")


@register("monthly_total_any_status")
def _q(spark, d):
    """O01 dashboard month total, every status."""
    return K.period_sales_total(D.sales_a(spark, d, names=False), AS_OF_A, P.MONTHLY)


@register("daily_orders")
def _q(spark, d):
    """O02 today's order count, every status."""
    return K.period_order_count(D.sales_a(spark, d, names=False), AS_OF_A, P.DAILY)


@register("monthly_forecast")
def _q(spark, d):
    """O03 month total x 1.1."""
    return K.monthly_forecast(D.sales_a(spark, d, names=False), AS_OF_A)


@register("dashboard_kpis")
def _q(spark, d):
    """O04 the dashboard strip from one scan."""
    return K.dashboard_kpis(D.sales_a(spark, d, names=False), AS_OF_A)


@register("report_summary_weekly")
def _q(spark, d):
    """O05 report summary for filter=weekly (calendar week), Completed."""
    return K.report_summary(D.sales_a(spark, d, names=False), AS_OF_A, "weekly")


@register("report_summary_monthly")
def _q(spark, d):
    """O05 report summary for filter=monthly, Completed."""
    return K.report_summary(D.sales_a(spark, d, names=False), AS_OF_A, "monthly")


@register("completed_totals")
def _q(spark, d):
    """O06 all-time Completed total and count."""
    return K.completed_totals(D.sales_a(spark, d, names=False))


@register("report_kpis_daily")
def _q(spark, d):
    """O07 the report strip for filter=daily from one scan."""
    return K.report_kpis(D.sales_a(spark, d, names=False), AS_OF_A, "daily")


@register("report_kpis_all")
def _q(spark, d):
    """O07 the report strip for an unknown filter (all time)."""
    return K.report_kpis(D.sales_a(spark, d, names=False), AS_OF_A, "everything")


# --- Rankings ---------------------------------------------------------------


@register("top_with_image_daily")
def _q(spark, d):
    """O08 dashboard top-10 today, any status, products with an image."""
    return R.top_products_with_image(D.sales_a(spark, d), D.products(spark, d), AS_OF_A, P.DAILY)


@register("top_with_image_trailing7")
def _q(spark, d):
    """O08 dashboard top-10 over the trailing week."""
    return R.top_products_with_image(D.sales_a(spark, d), D.products(spark, d), AS_OF_A, P.TRAILING7)


@register("top_with_image_monthly")
def _q(spark, d):
    """O08 dashboard top-10 this month."""
    return R.top_products_with_image(D.sales_a(spark, d), D.products(spark, d), AS_OF_A, P.MONTHLY)


@register("top_completed_daily")
def _q(spark, d):
    """O09 report top-10 today, Completed, orphaned sales kept."""
    return R.top_products_completed(D.sales_a(spark, d), D.products(spark, d), AS_OF_A, P.DAILY)


@register("top_completed_trailing7")
def _q(spark, d):
    """O09 report top-10 over the trailing week."""
    return R.top_products_completed(D.sales_a(spark, d), D.products(spark, d), AS_OF_A, P.TRAILING7)


@register("top_completed_monthly")
def _q(spark, d):
    """O09 report top-10 this month (the flagship query)."""
    return R.top_products_completed(D.sales_a(spark, d), D.products(spark, d), AS_OF_A, P.MONTHLY)


@register("category_ranking")
def _q(spark, d):
    """O10 all-time Completed revenue per live category, ranked."""
    return R.category_ranking(D.sales_a(spark, d, names=False), D.products(spark, d))


# --- Sales listing (set B: event sales, report date 2024-01-17) ------------


@register("addons_by_sale")
def _q(spark, d):
    """O11 add-ons nested per sale (rendered as text for comparison)."""
    nested = V.addons_by_sale(D.sale_addons(spark, d))
    return nested.select("sale_id", V.addons_text("addons").alias("addons"),
                         F.size("addons").cast("long").alias("n_addons"))


@register("addon_copies_by_sale")
def _q(spark, d):
    """O11, compact: one element per distinct add-on of a sale, with its number."""
    return V.addon_copies_by_sale(D.sale_addons(spark, d)).select(
        "sale_id", F.explode("addons").alias("a")).select(
        "sale_id", "a.first_id", "a.addon_name", "a.price", "a.addon_id", "a.n")


def _sales_list(spark, d, search, on_date, sales=D.sales_b):
    out = V.sales_list(sales(spark, d), D.products(spark, d), D.sale_addons(spark, d),
                       search=search, on_date=on_date)
    return out.withColumn("addons", V.addons_text("addons"))


@register("sales_list_all")
def _q(spark, d):
    """O12 the whole sales list with categories, add-ons, unit price, badge."""
    return _sales_list(spark, d, None, None)


@register("sales_list_search_day")
def _q(spark, d):
    """O12 searched ('bolt', case/accent-insensitive) on one day."""
    return _sales_list(spark, d, "BOLT", AS_OF_B)


@register("sales_list_wildcard")
def _q(spark, d):
    """O12 search text with a user-typed LIKE wildcard."""
    return _sales_list(spark, d, "r_d w", None)


@register("report_transactions_monthly")
def _q(spark, d):
    """O13 Completed rows of the month, newest first."""
    return V.report_transactions(D.sales_a(spark, d), AS_OF_A, "monthly")


@register("report_transactions_weekly")
def _q(spark, d):
    """O13 Completed rows of the calendar week."""
    return V.report_transactions(D.sales_a(spark, d), AS_OF_A, "weekly")


@register("sale_badges")
def _q(spark, d):
    """O14 badge of every sale."""
    return V.sale_badges(D.sales_b(spark, d, names=False))


# --- Catalogue -------------------------------------------------------------


@register("sellable_products")
def _q(spark, d):
    """O15 available products by category and name."""
    return C.sellable_products(D.products(spark, d))


@register("menu_sections")
def _q(spark, d):
    """O15 one row per category of the sale form."""
    return C.menu_sections(D.products(spark, d))


@register("sellable_addons")
def _q(spark, d):
    """O16 available add-ons by name."""
    return C.sellable_addons(D.addons(spark, d))


@register("product_search")
def _q(spark, d):
    """O17 name substring + category + status, case-insensitive."""
    return C.product_search(D.products(spark, d), search="  ring ", category="standard",
                            status="Available")


@register("product_search_none")
def _q(spark, d):
    """O17 with PHP-empty filters ('0', blanks): every product."""
    return C.product_search(D.products(spark, d), search="0", category="  ", status=None)


# --- Inventory -------------------------------------------------------------


@register("stock_status")
def _q(spark, d):
    """O18 every ingredient with its Low/Mid/Good label."""
    return I.stock_status(D.ingredients(spark, d))


@register("ingredient_search")
def _q(spark, d):
    """O19 name substring + unit (case-insensitive) + stock level mid."""
    return I.ingredient_search(D.ingredients(spark, d), search=" E ", unit="brand#2",
                               stock_level="mid")


@register("ingredient_search_low")
def _q(spark, d):
    """O19 stock level low only."""
    return I.ingredient_search(D.ingredients(spark, d), stock_level="low")


@register("stock_cards")
def _q(spark, d):
    """O20 card level, bar percent and image flag of every ingredient."""
    return I.stock_cards(D.ingredients(spark, d))


@register("low_stock_alerts")
def _q(spark, d):
    """O21 ingredients at or under threshold, by name."""
    return I.low_stock_alerts(D.ingredients(spark, d))


@register("low_stock_alert_count")
def _q(spark, d):
    """O22 alert count and headline."""
    return I.low_stock_alert_count(D.ingredients(spark, d))


@register("inventory_report")
def _q(spark, d):
    """O23 the report's inventory table, unfiltered."""
    return I.inventory_report(D.ingredients(spark, d))


@register("inventory_report_filtered")
def _q(spark, d):
    """O23 filtered by class badge-good and a unit label."""
    return I.inventory_report(D.ingredients(spark, d), status="badge-good",
                              unit_label_filter="Brand#2-based")


@register("unit_labels")
def _q(spark, d):
    """O24 distinct derived unit labels."""
    return I.unit_labels(D.ingredients(spark, d))


# --- Batch change jobs (set B sales and request feeds) ---------------------


def _priced(spark, d):
    return CH.price_sales(D.sale_requests(spark, d), D.products(spark, d), D.addons(spark, d))


@register("price_sales_accepted")
def _q(spark, d):
    """O25 accepted sales of the request batch, priced with add-ons."""
    return _priced(spark, d).accepted


@register("price_sales_rejects")
def _q(spark, d):
    """O25 rejected requests with the handler's reason."""
    return _priced(spark, d).rejects


@register("sale_addon_rows")
def _q(spark, d):
    """O26 one add-on snapshot row per accepted sale and distinct add-on."""
    return _priced(spark, d).addon_rows


@register("apply_cancellations")
def _q(spark, d):
    """O27 the sales table after a batch of cancellations."""
    return CH.apply_cancellations(D.sales_b(spark, d), D.cancel_requests(spark, d))


def _voided(spark, d):
    return CH.apply_voids(D.sales_b(spark, d), D.sales_void(spark, d), D.void_requests(spark, d))


@register("apply_voids_sales")
def _q(spark, d):
    """O28 the sales table after a batch of voids."""
    return _voided(spark, d).sales


@register("apply_voids_log")
def _q(spark, d):
    """O28 the void log after the batch (one row per accepted request)."""
    return _voided(spark, d).sales_void


@register("apply_voids_rejects")
def _q(spark, d):
    """O28 rejected void requests."""
    return _voided(spark, d).rejects


@register("apply_status_changes")
def _q(spark, d):
    """O27+O28 cancels and voids of one batch in one pass."""
    return CH.apply_status_changes(D.sales_b(spark, d), D.cancel_requests(spark, d),
                                   D.void_requests(spark, d))


def _reset(spark, d, at):
    return CH.reset_history(D.sales_b(spark, d), D.sale_addons(spark, d), D.sales_void(spark, d), at)


@register("reset_history_sales")
def _q(spark, d):
    """O29 sales kept by a reset at 2024-01-15 12:00."""
    return _reset(spark, d, "2024-01-15 12:00:00").sales


@register("reset_history_addons")
def _q(spark, d):
    """O29 add-on rows kept by that reset (their sale survives)."""
    return _reset(spark, d, "2024-01-15 12:00:00").sale_addons


@register("reset_history_voids")
def _q(spark, d):
    """O29 void log rows kept by a reset at 1996-01-01."""
    return _reset(spark, d, "1996-01-01 00:00:00").sales_void


def _products_upserted(spark, d):
    return CH.upsert_products(D.products(spark, d), D.product_changes(spark, d))


@register("upsert_products")
def _q(spark, d):
    """O30 the catalogue after a batch of inserts and updates."""
    return _products_upserted(spark, d).table


@register("upsert_products_rejects")
def _q(spark, d):
    """O30 changes that did not apply, with the reason."""
    return _products_upserted(spark, d).rejects


def _deleted(spark, d):
    return CH.delete_products(D.products(spark, d), D.sales_b(spark, d), D.product_deletes(spark, d))


@register("delete_products_catalog")
def _q(spark, d):
    """O31 the catalogue after deletions."""
    return _deleted(spark, d).products


@register("delete_products_sales")
def _q(spark, d):
    """O31 the sales after deletions (product id cleared)."""
    return _deleted(spark, d).sales


def _ingredients_upserted(spark, d):
    return CH.upsert_ingredients(D.ingredients(spark, d), D.ingredient_changes(spark, d))


@register("upsert_ingredients")
def _q(spark, d):
    """O32 the ingredients after a batch of inserts and updates."""
    return _ingredients_upserted(spark, d).table


@register("upsert_ingredients_rejects")
def _q(spark, d):
    """O32 ingredient changes that did not apply (negative numbers, duplicates)."""
    return _ingredients_upserted(spark, d).rejects


@register("delete_ingredients")
def _q(spark, d):
    """O32 the ingredients after deletions."""
    return CH.delete_ingredients(D.ingredients(spark, d), D.ingredient_deletes(spark, d))


# --- Audit and export ------------------------------------------------------


@register("append_audit")
def _q(spark, d):
    """O33 the log after appending a batch that contains resets."""
    return AU.append_audit(D.audit_logs(spark, d), D.audit_entries(spark, d))


@register("recent_audit_logs")
def _q(spark, d):
    """O34 the latest 20 log entries."""
    return AU.recent_audit_logs(D.audit_logs(spark, d))


@register("export_summary_monthly")
def _q(spark, d):
    """O35 the export's summary table for filter=monthly."""
    return EX.export_frames(D.sales_a(spark, d, names=False), AS_OF_A, "monthly")[0]


@register("export_transactions_weekly")
def _q(spark, d):
    """O35 the export's transaction table for filter=weekly."""
    return EX.export_frames(D.sales_a(spark, d), AS_OF_A, "weekly")[1]


# --- Streaming operator, run as a batch query -------------------------------


@register("daily_sales_windows")
def _q(spark, d):
    """Day windows of the streaming KPI job (all statuses and Completed),
    evaluated over the whole event-sales table as a batch (day as ISO text)."""
    out = KS.daily_windows(D.sales_b(spark, d, names=False))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("menu_pages")
def _q(spark, d):
    """O15 the grouped menu nested in pages of at most 25 products per category."""
    pages = C.menu_pages(D.products(spark, d), page_size=25)
    items = F.array_join(F.transform("items", lambda x: F.concat(
        x["product_name"], F.lit("#"), x["product_id"].cast("string"))), "; ")
    return pages.select("category", "page", items.alias("items"), F.size("items").alias("n_items"))


# --- More parameter variants ---------------------------------------------------
@register("report_kpis_monthly")
def _q(spark, d):
    """O07 the report strip for filter=monthly."""
    return K.report_kpis(D.sales_a(spark, d, names=False), AS_OF_A, "monthly")


@register("report_transactions_daily")
def _q(spark, d):
    """O13 Completed rows of the report day."""
    return V.report_transactions(D.sales_a(spark, d), AS_OF_A, "daily")


@register("stock_cards_low_search")
def _q(spark, d):
    """O19 + O20 the inventory page's cards for the stock level 'low'."""
    return I.stock_cards(I.ingredient_search(D.ingredients(spark, d), stock_level=" low "))


@register("inventory_report_bad")
def _q(spark, d):
    """O23 the report's inventory table filtered to class badge-bad."""
    return I.inventory_report(D.ingredients(spark, d), status="badge-bad")


@register("dashboard_from_stream_days")
def _q(spark, d):
    """The dashboard strip served from the streaming day table (batch form)
    over the whole event-sales table, report date 2024-01-17."""
    return KS.dashboard_from_days(KS.daily_windows(D.sales_b(spark, d, names=False)), AS_OF_B)


@register("sales_list_day")
def _q(spark, d):
    """O12 the sales list of one day (date filter only)."""
    return _sales_list(spark, d, None, AS_OF_B)


@register("product_search_wildcard")
def _q(spark, d):
    """O17 a name search with a user-typed wildcard, any category and status."""
    return C.product_search(D.products(spark, d), search="  BL_E%R ")


@register("report_summary_empty_filter")
def _q(spark, d):
    """O05 with filter='' (not missing): the page's else-branch, all time."""
    return K.report_summary(D.sales_a(spark, d, names=False), AS_OF_A, "")


@register("report_summary_no_filter")
def _q(spark, d):
    """O05 with no filter at all: the page's default, daily."""
    return K.report_summary(D.sales_a(spark, d, names=False), AS_OF_A, None)


# --- Edge rows: escapes, repeats, mixed case, missing keys ---------------------


@register("sales_list_backslash")
def _q(spark, d):
    """O12 a search with a backslash: the next character is literal."""
    return _sales_list(spark, d, "b\\olt", None)


@register("product_search_backslash")
def _q(spark, d):
    """O17 a search with a backslash before a letter."""
    return C.product_search(D.products(spark, d), search="r\\ing")


@register("sales_list_without_products")
def _q(spark, d):
    """O12 where many sales have lost their product id."""
    return _sales_list(spark, d, None, None, D.sales_b_without_products)


@register("stock_cards_edge")
def _q(spark, d):
    """O20 with images named '0' and thresholds near the 32-bit limit."""
    return I.stock_cards(D.ingredients_edge(spark, d))


@register("stock_status_edge")
def _q(spark, d):
    """O18 on the same rows."""
    return I.stock_status(D.ingredients_edge(spark, d))


@register("sellable_products_mixed_case")
def _q(spark, d):
    """O15 where statuses and names are in mixed case."""
    return C.sellable_products(D.products_mixed_case(spark, d))


@register("menu_pages_mixed_case")
def _q(spark, d):
    """O15 nested: name order is case-insensitive, also over page borders."""
    pages = C.menu_pages(D.products_mixed_case(spark, d), page_size=7)
    items = F.array_join(F.transform("items", lambda x: F.concat(
        x["product_name"], F.lit("#"), x["product_id"].cast("string"))), "; ")
    return pages.select("category", "page", items.alias("items"), F.size("items").alias("n_items"))


def _priced_repeated(spark, d):
    return CH.price_sales(D.sale_requests_repeated(spark, d), D.products(spark, d), D.addons(spark, d))


@register("price_sales_repeated")
def _q(spark, d):
    """O25 of an at-least-once feed: equal copies are one sale."""
    return _priced_repeated(spark, d).accepted


@register("price_sales_repeated_rejects")
def _q(spark, d):
    """O25 rejects of that feed: ids whose copies differ, once each."""
    return _priced_repeated(spark, d).rejects


@register("upsert_products_repeated_seq")
def _q(spark, d):
    """O30 where change numbers repeat."""
    return CH.upsert_products(D.products(spark, d), D.product_changes_repeated(spark, d)).table


@register("upsert_products_repeated_rejects")
def _q(spark, d):
    """O30 rejects there: every clash is reported."""
    return CH.upsert_products(D.products(spark, d), D.product_changes_repeated(spark, d)).rejects


@register("append_audit_no_reset")
def _q(spark, d):
    """O33 the log after a batch without a reset: old rows stay."""
    return AU.append_audit(D.audit_logs(spark, d), D.audit_entries_without_reset(spark, d))


@register("daily_sales_windows_changed")
def _q(spark, d):
    """Day windows of sales and their later status changes and removals."""
    effects = KS.sale_effects(D.sales_b(spark, d, names=False)).unionByName(
        KS.change_effects(D.sale_status_changes(spark, d)))
    return KS.daily_windows(effects).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# --- The same changes on stored tables --------------------------------------------
def _stored(spark, tables: dict[str, DataFrame]) -> str:
    """The tables in their stored layout, in a folder of their own."""
    root = f"{ensure_checkpoint_dir(spark)}/shop-{uuid.uuid4().hex}"
    for name, df in tables.items():
        write_table(df, root, name)
    return root


def _status_shop(spark, d):
    root = _stored(spark, {"sales": D.sales_b(spark, d), "sales_void": D.sales_void(spark, d)})
    ST.apply_statuses(spark, root, 1, D.cancel_requests(spark, d), D.void_requests(spark, d))
    return root


@register("stored_status_sales")
def _q(spark, d):
    """O27+O28 on storage: the sales after cancels and voids, month by month."""
    return read_table(spark, _status_shop(spark, d), "sales").drop(SALE_MONTH)


@register("stored_status_log")
def _q(spark, d):
    """O28 on storage: the void log after it."""
    return read_table(spark, _status_shop(spark, d), "sales_void")


@register("stored_status_rejects")
def _q(spark, d):
    """O28 on storage: void requests that were rejected."""
    return ST.output(spark, _status_shop(spark, d), 1, "void_rejects")


def _reset_shop(spark, d, at):
    root = _stored(spark, {"sales": D.sales_b(spark, d), "sale_addons": D.sale_addons(spark, d), "sales_void": D.sales_void(spark, d)})
    ST.reset_sales(spark, root, 1, at)
    return root


@register("stored_reset_sales")
def _q(spark, d):
    """O29 on storage: months dropped as folders, one rewritten."""
    return read_table(spark, _reset_shop(spark, d, "2024-01-15 12:00:00"), "sales").drop(SALE_MONTH)


@register("stored_reset_addons")
def _q(spark, d):
    """O29 on storage: the add-on rows that are left."""
    return read_table(spark, _reset_shop(spark, d, "2024-01-15 12:00:00"), "sale_addons")


@register("stored_reset_voids")
def _q(spark, d):
    """O29 on storage: the void log that is left."""
    return read_table(spark, _reset_shop(spark, d, "1996-01-01 00:00:00"), "sales_void")


@register("stored_delete_products_sales")
def _q(spark, d):
    """O31 on storage: the sales after deletions."""
    root = _stored(spark, {"sales": D.sales_b(spark, d), "products": D.products(spark, d)})
    ST.delete_products(spark, root, 1, D.product_deletes(spark, d))
    return read_table(spark, root, "sales").drop(SALE_MONTH)


def _catalog_shop(spark, d):
    root = _stored(spark, {"products": D.products(spark, d), "ingredients": D.ingredients(spark, d)})
    ST.change_catalog(spark, root, 1, D.product_changes(spark, d))
    ST.change_catalog(spark, root, 2, ingredient_deletes=D.ingredient_deletes(spark, d))
    return root


@register("stored_upsert_products")
def _q(spark, d):
    """O30 on storage: the catalogue after a batch."""
    return read_table(spark, _catalog_shop(spark, d), "products")


@register("stored_delete_ingredients")
def _q(spark, d):
    """O32 on storage: ingredients after deletions."""
    return read_table(spark, _catalog_shop(spark, d), "ingredients")


@register("stored_append_audit")
def _q(spark, d):
    """O33 on storage: the log after a batch with a reset."""
    root = _stored(spark, {"audit_logs": D.audit_logs(spark, d)})
    ST.log_audit(spark, root, 1, D.audit_entries(spark, d))
    return read_table(spark, root, "audit_logs")


# --- Lists of several periods, and names as the database compares them ------------
@register("top_with_image_strip")
def _q(spark, d):
    """O08 the dashboard's three lists from one scan."""
    return R.top_with_image_strip(D.sales_a(spark, d), D.products(spark, d), AS_OF_A)


@register("top_completed_strip")
def _q(spark, d):
    """O09 the report's three lists from one scan."""
    return R.top_completed_strip(D.sales_a(spark, d), D.products(spark, d), AS_OF_A)


@register("top_with_image_mixed_case")
def _q(spark, d):
    """O08 where sale-time names differ by case and accents."""
    return R.top_products_with_image(D.sales_a_mixed_case(spark, d), D.products(spark, d), AS_OF_A, P.MONTHLY, collation="UNICODE_CI_AI")


@register("top_completed_mixed_case")
def _q(spark, d):
    """O09 where sale-time names differ by case and accents."""
    return R.top_products_completed(D.sales_a_mixed_case(spark, d), D.products(spark, d), AS_OF_A, P.MONTHLY, collation="UNICODE_CI_AI")


@register("category_ranking_mixed_case")
def _q(spark, d):
    """O10 where categories differ by case."""
    return R.category_ranking(D.sales_a(spark, d), D.products_mixed_category(spark, d), collation="UNICODE_CI_AI")


# --- Searches through an index of stored names -------------------------------------
def _searched(spark, d, term):
    root = _stored(spark, {"products": D.products(spark, d)})
    SI.build_search_index(spark, root, "products", "product_name")
    return C.product_search(SI.read_candidates(spark, root, "products", "product_name", term), term)


@register("product_search_indexed")
def _q(spark, d):
    """O17 over the files that may hold the term."""
    return _searched(spark, d, "r%d w").drop("is_available", "availability")


@register("sales_search_indexed")
def _q(spark, d):
    """O12's search over the files that may hold the term (ids and names)."""
    root = _stored(spark, {"sales": D.sales_b(spark, d)})
    SI.build_search_index(spark, root, "sales", "product_name")
    found = SI.read_candidates(spark, root, "sales", "product_name", "r_d w", trim=False)
    return found.filter(search_filter("product_name", "r_d w", trim=False)).select("sales_id", "product_name")
