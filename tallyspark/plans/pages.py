"""Page loads as named sets of lazily built DataFrames.

The source runs 8-10 statements per page load, each its own table scan. Here
a page is a dict of DataFrames; nothing runs until a caller acts on one, and
the KPI strip of each page is one conditional aggregation over one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyspark import periods as P
from tallyspark.operators import catalog, inventory, kpis, rankings, sales_views
from tallyspark.sources.tables import ShopTables


def dashboard(t: ShopTables, as_of) -> dict[str, DataFrame]:
    """Dashboard: KPI strip (all statuses), stock status, three top-10 lists
    of products with an image."""
    return {
        "kpis": kpis.dashboard_kpis(t.sales, as_of),
        "stock_status": inventory.stock_status(t.ingredients),
        # The three lists from one scan; each alone follows.
        "top": rankings.top_with_image_strip(t.sales, t.products, as_of),
        "top_daily": rankings.top_products_with_image(t.sales, t.products, as_of, P.DAILY),
        "top_weekly": rankings.top_products_with_image(t.sales, t.products, as_of, P.TRAILING7),
        "top_monthly": rankings.top_products_with_image(t.sales, t.products, as_of, P.MONTHLY),
    }


def report(t: ShopTables, as_of, filter_name: str | None = "daily",
           inv_status: str | None = None, inv_unit: str | None = None) -> dict[str, DataFrame]:
    """Report page: Completed KPI strip, period rows, three top-10 lists,
    category ranking, inventory table and its unit-label options."""
    return {
        "kpis": kpis.report_kpis(t.sales, as_of, filter_name),
        "transactions": sales_views.report_transactions(t.sales, as_of, filter_name),
        "top": rankings.top_completed_strip(t.sales, t.products, as_of),
        "top_daily": rankings.top_products_completed(t.sales, t.products, as_of, P.DAILY),
        "top_weekly": rankings.top_products_completed(t.sales, t.products, as_of, P.TRAILING7),
        "top_monthly": rankings.top_products_completed(t.sales, t.products, as_of, P.MONTHLY),
        "categories": rankings.category_ranking(t.sales, t.products),
        "inventory": inventory.inventory_report(t.ingredients, inv_status, inv_unit),
        "unit_labels": inventory.unit_labels(t.ingredients),
    }


def sales_page(t: ShopTables, search: str | None = None, on_date=None) -> dict[str, DataFrame]:
    """Sales page: the list, all-time Completed totals, the entry form's
    products and add-ons."""
    return {
        "sales": sales_views.sales_list(t.sales, t.products, t.sale_addons, search, on_date),
        "totals": kpis.completed_totals(t.sales),
        "products": catalog.sellable_products(t.products),
        "menu": catalog.menu_sections(t.products),
        "addons": catalog.sellable_addons(t.addons),
    }


def inventory_page(t: ShopTables, search: str | None = None, unit: str | None = None,
                   stock_level: str | None = None) -> dict[str, DataFrame]:
    """Inventory page: searched cards, alert list and headline."""
    found = inventory.ingredient_search(t.ingredients, search, unit, stock_level)
    return {
        "cards": inventory.stock_cards(found),
        "alerts": inventory.low_stock_alerts(t.ingredients),
        "alert_count": inventory.low_stock_alert_count(t.ingredients),
    }


def products_page(t: ShopTables, search: str | None = None, category: str | None = None,
                  status: str | None = None) -> dict[str, DataFrame]:
    return {"products": catalog.product_search(t.products, search, category, status)}
