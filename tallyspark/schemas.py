"""Schemas of the seven back-office tables and of the batch request feeds.

Keys are ``long``; money is ``decimal(12,2)`` (room for the adapted test data);
timestamps are ``timestamp_ntz`` as stored in Parquet (a JDBC source gives
``timestamp``; every operator accepts either).
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

# ---------------------------------------------------------------------------
# These must equal the reference application's values.
# Sale statuses as written by the sale, cancel and void handlers.
STATUS_COMPLETED = "Completed"
STATUS_CANCELLED = "Cancelled"
STATUS_VOID = "VOID"
# Product and add-on availability values.
AVAILABLE = "Available"
UNAVAILABLE = "Unavailable"
# Threshold assumed when an ingredient has none (dashboard and report views).
DEFAULT_LOW_STOCK_THRESHOLD = 5
# Monthly forecast factor and ranking / log list lengths.
FORECAST_GROWTH = "1.1"
TOP_K = 10
RECENT_LOGS = 20
# Audit action that clears the log before being logged itself.
RESET_LOGS_ACTION = "Reset Logs"
RESET_LOGS_DETAILS = "All audit logs cleared"
# Reject reasons of the sale entry handler.
REJECT_INVALID = "Invalid product or quantity."
REJECT_NOT_FOUND = "Product not found."
# End of fixed values.
# ---------------------------------------------------------------------------


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


SALES = T.StructType([
    _f("sales_id", T.LongType(), False),
    _f("product_id", T.LongType()),
    _f("product_name", T.StringType()),
    _f("quantity", T.IntegerType()),
    _f("total", MONEY),
    _f("created_at", T.TimestampNTZType()),
    _f("status", T.StringType()),
    _f("product_image", T.StringType()),
])

PRODUCTS = T.StructType([
    _f("product_id", T.LongType(), False),
    _f("product_name", T.StringType()),
    _f("category", T.StringType()),
    _f("price", MONEY),
    _f("status", T.StringType()),
    _f("image", T.StringType()),
])

ADDONS = T.StructType([
    _f("addon_id", T.LongType(), False),
    _f("addon_name", T.StringType(), False),
    _f("price", MONEY, False),
    _f("status", T.StringType()),
])

SALE_ADDONS = T.StructType([
    _f("id", T.LongType(), False),
    _f("sale_id", T.LongType(), False),
    _f("addon_id", T.LongType()),
    _f("addon_name", T.StringType()),
    _f("price", MONEY),
])

SALES_VOID = T.StructType([
    _f("void_id", T.LongType(), False),
    _f("sale_id", T.LongType()),
    _f("reason", T.StringType()),
    _f("voided_at", T.TimestampNTZType()),
])

INGREDIENTS = T.StructType([
    _f("ingredient_id", T.LongType(), False),
    _f("ingredient_name", T.StringType()),
    _f("stock", T.IntegerType()),
    _f("low_stock_threshold", T.IntegerType()),
    _f("unit", T.StringType()),
    _f("image", T.StringType()),
])

AUDIT_LOGS = T.StructType([
    _f("log_id", T.LongType(), False),
    _f("user", T.StringType()),
    _f("action", T.StringType()),
    _f("details", T.StringType()),
    _f("created_at", T.TimestampNTZType()),
])

TABLES = {
    "sales": SALES,
    "products": PRODUCTS,
    "addons": ADDONS,
    "sale_addons": SALE_ADDONS,
    "sales_void": SALES_VOID,
    "ingredients": INGREDIENTS,
    "audit_logs": AUDIT_LOGS,
}

# Request feeds of the batch change jobs. ``seq`` orders several changes to
# one key inside a batch; the caller supplies ids of inserted rows.
SALE_REQUESTS = T.StructType([
    _f("request_id", T.LongType(), False),
    _f("product_id", T.LongType()),
    _f("quantity", T.IntegerType()),
    _f("addon_ids", T.ArrayType(T.LongType())),
    _f("created_at", T.TimestampNTZType()),
])

CANCEL_REQUESTS = T.StructType([_f("sale_id", T.LongType())])

VOID_REQUESTS = T.StructType([
    _f("seq", T.LongType(), False),
    _f("sale_id", T.LongType()),
    _f("reason", T.StringType()),
    _f("voided_at", T.TimestampNTZType()),
])

PRODUCT_CHANGES = T.StructType([
    _f("seq", T.LongType(), False),
    _f("op", T.StringType(), False),
    _f("product_id", T.LongType()),
    _f("product_name", T.StringType()),
    _f("price", MONEY),
    _f("category", T.StringType()),
    _f("status", T.StringType()),
    _f("image", T.StringType()),
])

INGREDIENT_CHANGES = T.StructType([
    _f("seq", T.LongType(), False),
    _f("op", T.StringType(), False),
    _f("ingredient_id", T.LongType()),
    _f("ingredient_name", T.StringType()),
    _f("stock", T.IntegerType()),
    _f("low_stock_threshold", T.IntegerType()),
    _f("unit", T.StringType()),
    _f("image", T.StringType()),
])

AUDIT_ENTRIES = T.StructType([
    _f("log_id", T.LongType(), False),
    _f("user", T.StringType()),
    _f("action", T.StringType()),
    _f("details", T.StringType()),
    _f("created_at", T.TimestampNTZType()),
])
