"""Stand-in inputs built from the driver's test tables.

The driver ships TPC-H-like tables, not a shop's tables. The functions here
only re-shape those rows into the back-office schemas; they compute nothing
an operator computes, and every operator works on any data of the schema.

Mapping (one rule per column):

* ``products``    <- ``part``: category = p_type, price = p_retailprice,
  Available when p_size <= 45; image NULL / '' / a file name by key.
* ``sales`` set A <- ``lineitem`` with the part name as the sale-time name:
  quantity = l_quantity, total = l_extendedprice, created_at = l_shipdate,
  status by l_returnflag (N Completed, R Cancelled, A VOID). Used by the
  period KPIs, rankings and report rows.
* ``sales`` set B <- ``events``: sales_id = event_id, product_id = props.k,
  total = value, created_at = ts (sub-second times), status by event type.
  Used by the sales list and the change jobs.
* ``addons``      <- ``supplier``; ``sale_addons`` <- ``lineitem`` x ``supplier``
  (sale_id = l_orderkey); ``ingredients`` <- ``part``; ``audit_logs`` <- ``events``;
  ``sales_void`` <- ``orders`` with status P.
* Request feeds of the change jobs <- ``events``, ``orders``, ``customer``.

Keys of set A are ``l_orderkey * 8 + l_linenumber``; the driver data repeats
that pair, so set-A ids are not unique and no set-A query outputs them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.sources.tables import conform

# Report dates used with the adapted data: both are Wednesdays, so the
# trailing week and the calendar week differ.
AS_OF_A = "1998-06-17"
AS_OF_B = "2024-01-17"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _money(col) -> F.Column:
    return F.col(col).cast(S.MONEY) if isinstance(col, str) else col.cast(S.MONEY)


def _image_rule(key, prefix: str) -> F.Column:
    k = F.col(key)
    return (F.when(k % 10 == 0, F.lit(None).cast("string"))
            .when(k % 10 == 1, F.lit(""))
            .otherwise(F.concat(F.lit(prefix), k.cast("string"), F.lit(".jpg"))))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return conform(p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        _money("p_retailprice").alias("price"),
        F.when(F.col("p_size") <= 45, F.lit(S.AVAILABLE)).otherwise(F.lit(S.UNAVAILABLE)).alias("status"),
        _image_rule("p_partkey", "part_").alias("image"),
    ), "products")


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))


def sales_a(spark: SparkSession, sf_dir: str, names: bool = True) -> DataFrame:
    """Sales from line items; the sale-time product name comes from ``part``,
    or is NULL without ``names`` (for queries that don't read it)."""
    li = _read(spark, sf_dir, "lineitem")
    rows = li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sales_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _money("l_extendedprice").alias("total"),
        F.col("l_shipdate").alias("created_at"),
        (F.when(F.col("l_returnflag") == "N", F.lit(S.STATUS_COMPLETED))
         .when(F.col("l_returnflag") == "R", F.lit(S.STATUS_CANCELLED))
         .when(F.col("l_returnflag") == "A", F.lit(S.STATUS_VOID))).alias("status"),
        _image_rule("l_partkey", "part_").alias("product_image"),
    )
    return _named(spark, sf_dir, rows, names)


def _named(spark: SparkSession, sf_dir: str, rows: DataFrame, names: bool) -> DataFrame:
    if names:
        rows = rows.join(_part_names(spark, sf_dir), "product_id", "left")
    else:
        rows = rows.withColumn("product_name", F.lit(None).cast("string"))
    return conform(rows, "sales")


def _event_status() -> F.Column:
    t = F.col("event_type")
    return (F.when(t.isin("purchase", "click"), F.lit(S.STATUS_COMPLETED))
            .when(t == "error", F.lit(S.STATUS_CANCELLED))
            .when(t == "signup", F.lit(S.STATUS_VOID))
            .otherwise(F.lit("Pending")))


def sales_b(spark: SparkSession, sf_dir: str, names: bool = True) -> DataFrame:
    """Sales from events: unique ids and microsecond timestamps (``names`` as
    in ``sales_a``)."""
    ev = _read(spark, sf_dir, "events")
    rows = ev.select(
        F.col("event_id").alias("sales_id"),
        F.get_json_object("props", "$.k").cast("long").alias("product_id"),
        (F.col("event_id") % 5 + 1).cast("int").alias("quantity"),
        _money("value").alias("total"),
        F.col("ts").alias("created_at"),
        _event_status().alias("status"),
    )
    rows = rows.withColumn("product_image", _image_rule("product_id", "part_"))
    return _named(spark, sf_dir, rows, names)


def sales_b_without_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set B where every third sale has lost its product id."""
    kept = F.when(F.col("sales_id") % 3 != 0, F.col("product_id"))
    return conform(sales_b(spark, sf_dir).withColumn("product_id", kept), "sales")


def sale_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set B's changes after entry: clicks go from Completed to Cancelled,
    sign-ups (VOID) are removed."""
    ev = _read(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "signup"))
    click = F.col("event_type") == "click"
    return ev.select(F.col("ts").alias("created_at"), _money("value").alias("total"),
                     F.when(click, F.lit(S.STATUS_COMPLETED)).otherwise(F.lit(S.STATUS_VOID)).alias("old_status"),
                     F.when(click, F.lit(S.STATUS_CANCELLED)).alias("new_status"))


def products_mixed_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as a case-insensitive database may hold it: every second
    status in lower case, every third name in upper case."""
    k = F.col("product_id")
    p = products(spark, sf_dir)
    return conform(p.withColumn("status", F.when(k % 2 == 0, F.lower("status")).otherwise(F.col("status")))
                   .withColumn("product_name", F.when(k % 3 == 0, F.upper("product_name")).otherwise(F.col("product_name"))), "products")


def sales_a_mixed_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set A where every third sale was entered in upper case and every fifth
    with an accent."""
    k, name = F.col("sales_id"), F.col("product_name")
    spelt = F.when(k % 3 == 0, F.upper(name)).when(k % 5 == 0, F.regexp_replace(name, "e", "é")).otherwise(name)
    return conform(sales_a(spark, sf_dir).withColumn("product_name", spelt), "sales")


def products_mixed_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with every second category in lower case."""
    k = F.col("product_id")
    return conform(products(spark, sf_dir).withColumn(
        "category", F.when(k % 2 == 0, F.lower("category")).otherwise(F.col("category"))), "products")


def ingredients_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredients with images named ``0`` and with very large thresholds."""
    k = F.col("ingredient_id")
    i = ingredients(spark, sf_dir)
    return conform(i.withColumn("image", F.when(k % 7 == 0, F.lit("0")).otherwise(F.col("image")))
                   .withColumn("low_stock_threshold", F.when(k % 9 == 0, F.lit(2 ** 31 - 1)).otherwise(F.col("low_stock_threshold"))),
                   "ingredients")


def addons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    return conform(s.select(
        F.col("s_suppkey").alias("addon_id"),
        F.col("s_name").alias("addon_name"),
        _money(F.abs(F.col("s_acctbal"))).alias("price"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit(S.UNAVAILABLE)).otherwise(F.lit(S.AVAILABLE)).alias("status"),
    ), "addons")


def sale_addons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One add-on row per line item: the supplier stands in for the add-on."""
    li = _read(spark, sf_dir, "lineitem")
    sup = _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("addon_id"), F.col("s_name").alias("addon_name"),
        _money(F.abs(F.col("s_acctbal"))).alias("price"))
    rows = li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("sale_id"),
        F.col("l_suppkey").alias("addon_id"),
    )
    return conform(rows.join(sup, "addon_id", "left"), "sale_addons")


def sales_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return conform(o.filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("void_id"),
        F.col("o_orderkey").alias("sale_id"),
        F.col("o_orderpriority").alias("reason"),
        F.col("o_orderdate").alias("voided_at"),
    ), "sales_void")


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return conform(p.select(
        k.alias("ingredient_id"),
        F.col("p_name").alias("ingredient_name"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("int").alias("stock"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(k % 7).cast("int").alias("low_stock_threshold"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("unit"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("ing_"), k.cast("string"), F.lit(".png"))).alias("image"),
    ), "ingredients")


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    return conform(ev.select(
        F.col("event_id").alias("log_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
        F.col("event_type").alias("action"),
        F.col("props").alias("details"),
        F.col("ts").alias("created_at"),
    ), "audit_logs")


# ---------------------------------------------------------------------------
# Request feeds for the batch change jobs.

def sale_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event: product ids run past the catalogue and below 1,
    quantities include 0, add-on lists repeat ids and name unknown ones."""
    ev = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    ids = (F.when(F.col("event_type") == "view", F.array().cast("array<bigint>"))
           .when(F.col("event_type") == "signup", F.lit(None).cast("array<bigint>"))
           .otherwise(F.array(k, k, F.col("user_id"))))
    return ev.select(
        F.col("event_id").alias("request_id"),
        (F.col("user_id") * 20 + k % 20 - 60).alias("product_id"),
        (F.col("value").cast("int") % 5).cast("int").alias("quantity"),
        ids.alias("addon_ids"),
        F.col("ts").alias("created_at"),
    )


def sale_requests_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sale feed as delivered at least once: purchases come twice alike,
    errors come twice with another quantity."""
    ev = _read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "event_type")
    r = sale_requests(spark, sf_dir)
    again = r.join(ev.filter(F.col("event_type").isin("purchase", "error")), "request_id")
    quantity = F.when(F.col("event_type") == "error", F.col("quantity") + 1).otherwise(F.col("quantity"))
    return r.unionByName(again.withColumn("quantity", quantity).drop("event_type"))


def cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("sale_id"))


def void_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders void the sale numbered like their customer; customers
    repeat, so some sales are voided several times."""
    o = _read(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("sale_id"),
        F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" "), F.col("o_orderpriority"), F.lit("\t")).alias("reason"),
        F.col("o_orderdate").alias("voided_at"),
    )


def _change_key() -> F.Column:
    # Two customers share each key, so a batch holds several changes per key.
    return F.floor(F.col("c_custkey") / 2).cast("long") * 3


def product_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("seq"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("insert")).otherwise(F.lit("update")).alias("op"),
        _change_key().alias("product_id"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")).alias("product_name"),
        _money(F.abs(F.col("c_acctbal"))).alias("price"),
        F.col("c_mktsegment").alias("category"),
        F.when(F.col("c_acctbal") >= 0, F.lit(S.AVAILABLE)).otherwise(F.lit(S.UNAVAILABLE)).alias("status"),
        F.when(F.col("c_acctbal") > 5000, F.lit(""))
         .otherwise(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"), F.lit(".jpg"))).alias("image"),
    )


def product_changes_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product changes whose numbers repeat: half of the keys give both their
    changes one number, and every fifth change is delivered twice."""
    c = product_changes(spark, sf_dir)
    paired = F.when(F.col("seq") % 4 < 2, F.floor(F.col("seq") / 2).cast("long")).otherwise(F.col("seq") + 10 ** 9)
    return c.unionByName(c.filter(F.col("seq") % 5 == 0)).withColumn("seq", paired)


def ingredient_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("seq"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("insert")).otherwise(F.lit("update")).alias("op"),
        _change_key().alias("ingredient_id"),
        F.concat(F.col("c_name"), F.lit(" ")).alias("ingredient_name"),
        (F.col("c_nationkey") - 2).cast("int").alias("stock"),
        F.floor(F.col("c_acctbal") / 1000).cast("int").alias("low_stock_threshold"),
        F.concat(F.col("c_mktsegment"), F.lit("-based")).alias("unit"),
        F.when(F.col("c_acctbal") > 5000, F.lit(""))
         .otherwise(F.concat(F.lit("ci_"), F.col("c_custkey").cast("string"), F.lit(".png"))).alias("image"),
    )


def product_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("product_id"))


def ingredient_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderpriority") == "2-HIGH").select(F.col("o_custkey").alias("ingredient_id"))


def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New log entries appended after the existing log, in ``log_id`` order;
    urgent pending orders stand for "Reset Logs" actions."""
    o = _read(spark, sf_dir, "orders")
    reset = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    return o.select(
        (F.col("o_orderkey") + F.lit(10 ** 12)).alias("log_id"),
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("user"),
        F.when(reset, F.lit(S.RESET_LOGS_ACTION)).otherwise(F.lit("Update Settings")).alias("action"),
        F.when(reset, F.lit(S.RESET_LOGS_DETAILS)).otherwise(F.col("o_orderpriority")).alias("details"),
        F.col("o_orderdate").alias("created_at"),
    )


def audit_entries_without_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New log entries of which none is a reset."""
    return audit_entries(spark, sf_dir).filter(F.col("action") != S.RESET_LOGS_ACTION)


TABLE_BUILDERS = {
    "sales": sales_a,
    "products": products,
    "addons": addons,
    "sale_addons": sale_addons,
    "sales_void": sales_void,
    "ingredients": ingredients,
    "audit_logs": audit_logs,
}
