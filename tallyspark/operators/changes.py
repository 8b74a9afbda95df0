"""Batch change jobs: the application's one-request-at-a-time handlers
re-aimed as DataFrame jobs (requests in, new table contents and rejects out).

* ``price_sales``: sale entry (validation, product lookup, add-on pricing).
* ``apply_cancellations`` / ``apply_voids`` / ``apply_status_changes``.
* ``reset_history``: the sales reset with its child tables.
* ``upsert_products`` / ``delete_products`` / ``upsert_ingredients`` /
  ``delete_ingredients``.

Several changes to one key inside a batch are applied in ``seq`` order with
the handlers' semantics (an insert of an existing key fails; an update of a
missing key changes nothing; an empty image keeps the current one). The
per-key fold is written with aggregates (``min``, ``max_by``) rather than a
window, so a key that receives a third of a batch is reduced inside each
task before any shuffle. Catalogue-sized sides (add-ons, the keys a batch
touches) are joined without hints: adaptive execution broadcasts them when
their measured size is under the threshold and falls back to a shuffle join
otherwise.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schemas as S
from tallyspark.functions.text import php_empty, php_trim
from tallyspark.operators.common import range_predicate
from tallyspark.periods import ts_literal
from tallyspark.sources.tables import conform

# ---------------------------------------------------------------------------
# Messages of the reference handlers, and ours for outcomes
# that the reference reports as a database error.
REJECT_INVALID_SALE = "Invalid sale."
REJECT_NEGATIVE_STOCK = "Stock and threshold values must not be negative."
# Ours (the reference fails on a database error in these cases):
REJECT_UNKNOWN_SALE = "Unknown sale."
REJECT_DUPLICATE_KEY = "Duplicate key."
REJECT_MISSING_KEY = "Missing key."
REJECT_UNKNOWN_OP = "Unknown operation."
REJECT_TOTAL_RANGE = "Total out of range."
REJECT_REPEATED_SEQ = "Repeated change number."
IGNORED_UNKNOWN_KEY = "No such row; nothing changed."
# End of fixed values.
# ---------------------------------------------------------------------------

# The first total that the column type ``schemas.MONEY`` cannot hold. A sale
# at or above it is rejected ("Total out of range."), as storing it would fail.
MONEY_LIMIT = 10 ** (S.MONEY.precision - S.MONEY.scale)


def _agreeing(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(one row per key, keys whose copies differ).

    Feeds deliver a change at least once: equal copies of a key count as one,
    copies that disagree can't be ordered and are set aside. One aggregation
    with a map-side minimum and maximum; null keys are groups of their own.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    seen = df.groupBy(*keys).agg(F.min(row).alias("_lo"), F.max(row).alias("_hi"))
    same = F.col("_lo").eqNullSafe(F.col("_hi"))
    one = seen.filter(same).select(*keys, *[F.col("_lo")[c].alias(c) for c in rest])
    return one, seen.filter(~same).select(*keys)


# ---------------------------------------------------------------------------
# Sale entry

@dataclass
class PricedSales:
    accepted: DataFrame      # new sales rows (sales schema)
    rejects: DataFrame       # (request_id, reason)
    addon_rows: DataFrame    # (sale_id, addon_id, addon_name, price)
    outcomes: DataFrame      # all three in one frame, told apart by ``output``


# Outputs of a sale batch and their columns in the common frame.
SALE_OUTPUTS = {
    "new_sales": [f.name for f in S.SALES.fields],
    "new_sale_addons": ["sale_id", "addon_id", "addon_name", "price"],
    "sale_rejects": ["request_id", "reason"],
}


def sale_schema() -> T.StructType:
    """The columns of all outputs of a sale batch."""
    kinds = {f.name: f.dataType for schema in (S.SALE_ADDONS, S.SALES) for f in schema.fields}
    kinds |= {"request_id": T.LongType(), "reason": T.StringType()}
    return T.StructType([T.StructField(c, kinds[c]) for cs in SALE_OUTPUTS.values() for c in cs])


def sale_outcomes(requests: DataFrame, products: DataFrame, addons: DataFrame, default_time=None) -> DataFrame:
    """The rules of ``price_sales`` in one pass: a row per new sale, add-on
    row and reject, with ``output`` and the columns of all three (null where
    an output has none).

    Every request goes through as one row that carries its reject reason, if
    any, and meets the catalogue and the add-ons once; so the feed is read,
    grouped and joined once whatever outputs are wanted.
    """
    r = requests.select("request_id", "product_id", "quantity", "addon_ids", "created_at")
    if default_time is not None:
        r = r.withColumn("created_at", F.coalesce(F.col("created_at"), ts_literal(default_time)))
    # Equal copies of a request are one; a request without an id is a reject of
    # its own, so these are grouped by nothing in common.
    rest = F.struct("product_id", "quantity", "addon_ids", "created_at")
    alone = F.when(F.col("request_id").isNull(), F.monotonically_increasing_id())
    one = (r.withColumn("_alone", alone).groupBy("request_id", "_alone")
           .agg(F.min(rest).alias("_lo"), F.max(rest).alias("_hi")))
    valid = F.coalesce((F.col("_lo.product_id") > 0) & (F.col("_lo.quantity") > 0), F.lit(False))
    reason = (F.when(F.col("request_id").isNull(), F.lit(REJECT_MISSING_KEY))
              .when(~F.col("_lo").eqNullSafe(F.col("_hi")), F.lit(REJECT_DUPLICATE_KEY))
              .when(~valid, F.lit(S.REJECT_INVALID)))
    one = one.select("request_id", "_alone", "_lo.*", reason.alias("_reason"))

    # Rejects meet no product and no add-on: a second key spreads them.
    spread = F.xxhash64("request_id", "_alone")
    here = F.lit(0).cast("long")
    cat = products.select(F.col("product_id").alias("_pid"), here.alias("_ppart"), F.col("product_name").alias("_pname"),
                          F.col("price").alias("_price"), F.col("image").alias("_image"))
    part = F.when(F.col("_reason").isNull(), here).otherwise(spread)
    looked = one.join(cat, (F.col("product_id") == F.col("_pid")) & (part == F.col("_ppart")), "left").drop("_pid", "_ppart")
    looked = looked.withColumn("_reason", F.coalesce("_reason", F.when(php_empty(F.col("_pname")), F.lit(S.REJECT_NOT_FOUND))))

    avail = (addons.filter(F.col("status") == F.lit(S.AVAILABLE))
             .select(F.col("addon_id").alias("_avail_id"), here.alias("_apart"), F.col("addon_name").alias("_aname"),
                     F.col("price").alias("_aprice")))
    wanted = F.when(F.col("_reason").isNull(), F.array_distinct("addon_ids"))
    exploded = looked.withColumn("_aid", F.explode_outer(wanted)).drop("addon_ids")
    part = F.when(F.col("_aid").isNull(), spread).otherwise(here)
    with_addons = exploded.join(avail, (F.col("_aid") == F.col("_avail_id")) & (part == F.col("_apart")), "left")
    # A request's own add-ons are gathered: as many as its list names.
    keys = ["request_id", "_alone", "product_id", "quantity", "created_at", "_reason", "_pname", "_price", "_image"]
    addon = F.struct(F.col("_aid").alias("addon_id"), F.col("_aname").alias("addon_name"), F.col("_aprice").alias("price"))
    per_request = with_addons.groupBy(*keys).agg(
        F.coalesce(F.sum("_aprice"), F.lit(0).cast(S.MONEY)).alias("_addon_total"),
        F.collect_list(F.when(F.col("_aname").isNotNull(), addon)).alias("_addons"))
    qty = F.col("quantity").cast("decimal(10,0)")
    total = qty * F.coalesce(F.col("_price"), F.lit(0).cast(S.MONEY)) + qty * F.col("_addon_total")
    priced = per_request.withColumn("_total", total)
    too_big = F.when(F.abs(F.col("_total")) >= F.lit(MONEY_LIMIT), F.lit(REJECT_TOTAL_RANGE))
    priced = priced.withColumn("_reason", F.coalesce("_reason", too_big))

    schema = sale_schema()
    schema["created_at"].dataType = requests.schema["created_at"].dataType

    def row(output: str, **values) -> Column:
        return F.struct(F.lit(output).alias("output"), *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    col = F.col
    sale = row("new_sales", sales_id=col("request_id"), product_id=col("product_id"), product_name=col("_pname"), quantity=col("quantity"),
               total=F.when(col("_reason").isNull(), col("_total")), created_at=col("created_at"), status=F.lit(S.STATUS_COMPLETED),
               product_image=col("_image"))
    extras = F.transform("_addons", lambda a: row("new_sale_addons", sale_id=col("request_id"), **{c: a[c] for c in SALE_OUTPUTS["new_sale_addons"][1:]}))
    reject = row("sale_rejects", request_id=col("request_id"), reason=col("_reason"))
    rows = F.when(col("_reason").isNull(), F.concat(F.array(sale), extras)).otherwise(F.array(reject))
    return priced.select(F.explode(rows).alias("_row")).select("_row.*")


def sale_output(outcomes: DataFrame, output: str) -> DataFrame:
    """One output of ``sale_outcomes``, with its own columns."""
    out = outcomes.filter(F.col("output") == F.lit(output)).select(*SALE_OUTPUTS[output])
    return conform(out, "sales") if output == "new_sales" else out


def price_sales(requests: DataFrame, products: DataFrame, addons: DataFrame,
                default_time=None) -> PricedSales:
    """O25 + O26: price a batch of sale requests.

    Rejects, in the handler's order: product id or quantity not positive
    ("Invalid product or quantity."), then a product that does not exist or
    has an empty name ("Product not found."), then a total that the column
    can't hold ("Total out of range."). Before those, a missing request id
    ("Missing key.") and an id whose copies differ ("Duplicate key.", one row
    per id); equal copies of a request are one sale. Total = quantity x price +
    quantity x (sum of the *available* add-ons among the request's ids);
    repeated ids count once, unknown or unavailable ids are ignored, product
    availability is not checked, a NULL price counts as 0. Accepted sales get
    status Completed, the request id as ``sales_id`` and snapshots of the
    product name and image; one add-on row is produced per accepted sale and
    distinct available add-on. A request without a time gets
    ``default_time`` when given (the database stamps the insert time).

    The three outputs are parts of one frame (``outcomes``): a job that wants
    all of them writes that frame once.
    """
    outcomes = sale_outcomes(requests, products, addons, default_time)
    return PricedSales(sale_output(outcomes, "new_sales"), sale_output(outcomes, "sale_rejects"),
                       sale_output(outcomes, "new_sale_addons"), outcomes)


# ---------------------------------------------------------------------------
# Status changes

def status_flags(cancel_ids: DataFrame | None, voids: DataFrame | None) -> DataFrame:
    """One row per named sale: whether a valid request voids or cancels it.
    Flags are combined before the shuffle, however often a sale is named."""
    parts = []
    if cancel_ids is not None:
        parts.append(cancel_ids.select(F.col("sale_id").alias("sales_id"), F.lit(False).alias("_void"), F.lit(True).alias("_cancel")))
    if voids is not None:
        good, _ = _agreeing(voids.select("seq", "sale_id", "reason", "voided_at").filter(F.col("seq").isNotNull()), "seq")
        parts.append(good.filter(F.col("sale_id") > 0).select(
            F.col("sale_id").alias("sales_id"), F.lit(True).alias("_void"), F.lit(False).alias("_cancel")))
    named = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (named.filter(F.col("sales_id").isNotNull()).groupBy("sales_id")
            .agg(F.max("_void").alias("_void"), F.max("_cancel").alias("_cancel")))


def new_status() -> Column:
    """The status of a sale that is joined with its flags."""
    return (F.when(F.col("_void"), F.lit(S.STATUS_VOID))
            .when(F.col("_cancel") & (F.col("status") == F.lit(S.STATUS_COMPLETED)), F.lit(S.STATUS_CANCELLED))
            .otherwise(F.col("status")))


def with_status(sales: DataFrame, flags: DataFrame) -> DataFrame:
    """Sales after the flagged voids and cancels: one join on the sale id."""
    return sales.join(flags, "sales_id", "left").withColumn("status", new_status()).select(*sales.columns)


def apply_cancellations(sales: DataFrame, cancel_ids: DataFrame) -> DataFrame:
    """Completed sales named in ``cancel_ids(sale_id)`` become Cancelled;
    any other status is left as is (so repeating a batch changes nothing)."""
    return with_status(sales, status_flags(cancel_ids, None))


@dataclass
class VoidResult:
    sales: DataFrame
    sales_void: DataFrame
    rejects: DataFrame      # (seq, sale_id, reason)


def split_voids(sales: DataFrame, voids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that apply, rejects); scans the sales' ids."""
    v = voids.select("seq", "sale_id", "reason", "voided_at")
    # ``seq`` becomes the log's key.
    missing = v.filter(F.col("seq").isNull()).select("seq", "sale_id", F.lit(REJECT_MISSING_KEY).alias("reason"))
    v, repeated = _agreeing(v.filter(F.col("seq").isNotNull()), "seq")
    dup = repeated.select("seq", F.lit(None).cast("long").alias("sale_id"), F.lit(REJECT_DUPLICATE_KEY).alias("reason"))
    bad_id = v.filter(~F.coalesce(F.col("sale_id") > 0, F.lit(False))).select(
        "seq", "sale_id", F.lit(REJECT_INVALID_SALE).alias("reason"))
    ok = v.filter(F.col("sale_id") > 0)
    # Which requested ids exist: an inner join of the (distinct) requested
    # ids with the sales keys, so the small side can be the build side.
    wanted = ok.select("sale_id").distinct()
    known = (sales.select(F.col("sales_id").alias("sale_id"))
             .join(wanted, "sale_id", "inner").distinct().withColumn("_known", F.lit(True)))
    tagged = ok.join(known, "sale_id", "left")
    unknown = tagged.filter(F.col("_known").isNull()).select(
        "seq", "sale_id", F.lit(REJECT_UNKNOWN_SALE).alias("reason"))
    applied = tagged.filter(F.col("_known")).drop("_known")
    return applied, missing.unionByName(dup).unionByName(bad_id).unionByName(unknown)


def void_log(applied: DataFrame) -> DataFrame:
    """The log rows of applied void requests (``void_id = seq``)."""
    return conform(applied.select(F.col("seq").alias("void_id"), "sale_id",
                                  php_trim(F.coalesce(F.col("reason"), F.lit(""))).alias("reason"),
                                  "voided_at"), "sales_void")


def apply_voids(sales: DataFrame, sales_void: DataFrame, voids: DataFrame) -> VoidResult:
    """Void a batch of sales and log each reason.

    Any status becomes VOID. Every accepted request appends one
    ``sales_void`` row (``void_id = seq``, trimmed reason), so voiding a sale
    twice logs twice. Ids not above 0 are rejected ("Invalid sale."); ids with
    no sale are rejected because the log's foreign key would fail. Equal
    copies of a ``seq`` are one request; one whose copies differ is rejected
    ("Duplicate key.", one row without a sale), a missing one too.

    The new sales read the sales table once and join it once (an id without a
    sale matches nothing); only the log and the rejects look ids up.
    """
    applied, rejects = split_voids(sales, voids)
    new_sales = with_status(sales, status_flags(None, voids))
    return VoidResult(new_sales, conform(sales_void, "sales_void").unionByName(void_log(applied)), rejects)


def apply_status_changes(sales: DataFrame, cancel_ids: DataFrame, voids: DataFrame) -> DataFrame:
    """Cancels and voids of one batch in a single pass over ``sales``.

    VOID absorbs: a voided sale ends VOID whatever the order; otherwise a
    cancel turns Completed into Cancelled. This equals applying the requests
    one by one in any order.
    """
    return with_status(sales, status_flags(cancel_ids, voids))


@dataclass
class History:
    sales: DataFrame
    sale_addons: DataFrame
    sales_void: DataFrame


def reset_history(sales: DataFrame, sale_addons: DataFrame, sales_void: DataFrame,
                  reset_at) -> History:
    """The sales reset at time ``reset_at``: every sale created before it
    (or with no time) is removed, with its add-on rows and void log rows;
    void rows logged before the reset go too."""
    at = reset_at if isinstance(reset_at, dt.datetime) else dt.datetime.fromisoformat(str(reset_at))
    kept = sales.filter(range_predicate(sales, at, None))
    keys = kept.select(F.col("sales_id").alias("sale_id"))
    addons_kept = sale_addons.join(keys, "sale_id", "left_semi")
    void_pred = range_predicate(sales_void, at, None, col="voided_at")
    voids_kept = sales_void.filter(void_pred).join(keys, "sale_id", "left_semi")
    return History(kept, addons_kept, voids_kept)


# ---------------------------------------------------------------------------
# Catalogue and stock changes

@dataclass
class Upserted:
    table: DataFrame
    rejects: DataFrame     # (seq, key, reason); ignored updates included


def _upsert(base: DataFrame, changes: DataFrame, key: str, value_cols: list[str],
            extra_rejects: Column | None, reject_reason: str | None, table: str) -> Upserted:
    """Fold each key's changes in ``seq`` order with one aggregation.

    For a key already in the table every insert fails and every update
    applies: the values are those of the last update, the image that of the
    last update with a non-empty image (else the current one). For a new key
    the first insert (seq ``f``) creates the row; updates before ``f`` change
    nothing, later inserts fail; so the values are the last update's if it
    comes after ``f``, else the insert's, and likewise for the image. All of
    that is a handful of conditional ``min``/``max``/``min_by``/``max_by``
    aggregates per key (map-side partial, so a hot key is reduced in each
    task), then one full outer join with the table, which is read once; the
    rejects take from the same join whether their key is in the table.
    """
    reasons = F.when(F.col(key).isNull(), F.lit(REJECT_MISSING_KEY)) \
               .when(~F.col("op").isin("insert", "update"), F.lit(REJECT_UNKNOWN_OP))
    if extra_rejects is not None:
        reasons = reasons.when(extra_rejects, F.lit(reject_reason))
    c = changes.withColumn("_bad", reasons)
    invalid = c.filter(F.col("_bad").isNotNull()).select("seq", F.col(key).alias("key"),
                                                         F.col("_bad").alias("reason"))
    # Changes of a key are ordered by ``seq``: equal copies count once, copies
    # that differ are rejected, all of them.
    c, clash = _agreeing(c.filter(F.col("_bad").isNull()).drop("_bad"), key, "seq")
    clash = clash.select("seq", F.col(key).alias("key"), F.lit(REJECT_REPEATED_SEQ).alias("reason"))

    is_upd = F.col("op") == "update"
    is_ins = F.col("op") == "insert"
    has_image = ~php_empty(F.col("image"))
    vals = F.struct(*[F.col(v) for v in value_cols])
    order = F.col("seq")
    folded = c.groupBy(key).agg(
        F.min(F.when(is_ins, F.col("seq"))).alias("_f"),
        F.min_by(vals, F.when(is_ins, order)).alias("_ins_v"),
        F.min_by(F.col("image"), F.when(is_ins, order)).alias("_ins_img"),
        F.max(F.when(is_upd, F.col("seq"))).alias("_u"),
        F.max_by(vals, F.when(is_upd, order)).alias("_upd_v"),
        F.max(F.when(is_upd & has_image, F.col("seq"))).alias("_ui"),
        F.max_by(F.col("image"), F.when(is_upd & has_image, order)).alias("_upd_img"),
    )
    # The table and the folded changes meet once; a row of the result is a key
    # of the table, of the batch, or of both.
    met = base.withColumn("_in_base", F.lit(True)).join(folded, key, "full_outer").withColumn(
        "_in_base", F.coalesce("_in_base", F.lit(False)))
    # A key that is there takes its updates; a new one begins with its first
    # insert and takes the updates after it.
    begins = ~F.col("_in_base") & F.col("_f").isNotNull()
    updated = F.col("_u").isNotNull() & (F.col("_in_base") | (F.col("_u") > F.col("_f")))
    pictured = F.col("_ui").isNotNull() & (F.col("_in_base") | (F.col("_ui") > F.col("_f")))
    out_cols = []
    for col in base.columns:
        if col == key:
            value = F.col(key)
        elif col == "image":
            value = F.when(pictured, F.col("_upd_img")).when(begins, F.col("_ins_img")).otherwise(F.col("image"))
        elif col in value_cols:
            value = F.when(updated, F.col("_upd_v")[col]).when(begins, F.col("_ins_v")[col]).otherwise(F.col(col))
        else:
            value = F.col(col)
        out_cols.append(value.alias(col))
    table_out = conform(met.filter(F.col("_in_base") | begins).select(*out_cols), table)

    # Changes that did not apply (reported, not applied).
    fate = met.filter(F.col("_f").isNotNull() | F.col("_u").isNotNull()).select(key, "_f", "_in_base")
    ck = c.join(fate, key, "left")
    after_insert = F.col("_f").isNotNull() & (F.col("seq") > F.col("_f"))
    applies = ((is_upd & (F.col("_in_base") | after_insert))
               | (is_ins & ~F.col("_in_base") & (F.col("seq") == F.col("_f"))))
    ignored = ck.filter(~F.coalesce(applies, F.lit(False))).select(
        "seq", F.col(key).alias("key"),
        F.when(is_ins, F.lit(REJECT_DUPLICATE_KEY)).otherwise(F.lit(IGNORED_UNKNOWN_KEY)).alias("reason"))
    return Upserted(table_out, invalid.unionByName(clash).unionByName(ignored))


def upsert_products(products: DataFrame, changes: DataFrame) -> Upserted:
    """Apply product inserts and updates of one batch in ``seq`` order.

    Names are trimmed; a NULL price counts as 0 (``floatval``); inserting an
    existing id is rejected; updating a missing id changes nothing; an update
    without an image keeps the current image.
    """
    c = changes.select(
        "seq", F.lower(php_trim("op")).alias("op"), "product_id",
        php_trim("product_name").alias("product_name"),
        F.coalesce(F.col("price").cast(S.MONEY), F.lit(0).cast(S.MONEY)).alias("price"),
        "category", "status", "image")
    return _upsert(conform(products, "products"), c, "product_id",
                   ["product_name", "price", "category", "status"], None, None, "products")


def upsert_ingredients(ingredients: DataFrame, changes: DataFrame) -> Upserted:
    """Ingredient inserts and updates, as ``upsert_products``; a negative
    stock or threshold rejects the change (a missing number counts as 0)."""
    c = changes.select(
        "seq", F.lower(php_trim("op")).alias("op"), "ingredient_id",
        php_trim("ingredient_name").alias("ingredient_name"),
        F.coalesce(F.col("stock"), F.lit(0)).cast("int").alias("stock"),
        F.coalesce(F.col("low_stock_threshold"), F.lit(0)).cast("int").alias("low_stock_threshold"),
        "unit", "image")
    negative = (F.col("stock") < 0) | (F.col("low_stock_threshold") < 0)
    return _upsert(conform(ingredients, "ingredients"), c, "ingredient_id",
                   ["ingredient_name", "stock", "low_stock_threshold", "unit"],
                   negative, REJECT_NEGATIVE_STOCK, "ingredients")


@dataclass
class ProductsDeleted:
    products: DataFrame
    sales: DataFrame


def delete_products(products: DataFrame, sales: DataFrame, ids: DataFrame) -> ProductsDeleted:
    """Remove products; their sales keep name and total but lose the
    product id (the foreign key's ON DELETE SET NULL)."""
    gone = ids.select("product_id").filter(F.col("product_id").isNotNull()).distinct()
    kept = products.join(gone, "product_id", "left_anti")
    # Sales without a product match nothing: a second key spreads them.
    hit = gone.select(F.col("product_id").alias("_gone_id"), F.lit(0).cast("long").alias("_gone_part"), F.lit(True).alias("_gone"))
    part = F.when(F.col("product_id").isNull(), F.col("sales_id")).otherwise(F.lit(0).cast("long"))
    new_sales = (sales.join(hit, (F.col("product_id") == F.col("_gone_id")) & (part == F.col("_gone_part")), "left")
                 .withColumn("product_id", F.when(F.col("_gone"), F.lit(None).cast("long"))
                             .otherwise(F.col("product_id")))
                 .select(*sales.columns))
    return ProductsDeleted(kept, new_sales)


def delete_ingredients(ingredients: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove ingredients by id."""
    gone = ids.select("ingredient_id").filter(F.col("ingredient_id").isNotNull()).distinct()
    return ingredients.join(gone, "ingredient_id", "left_anti")
