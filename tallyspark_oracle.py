"""Independent SQL oracle for every registered query (DuckDB dialect).

Each statement restates the adapted tables as CTEs over the driver's views
and then says the rule in SQL's own way (``month()``/``year()``/``yearweek()``
predicates, correlated lookups, windows over changes) rather than the Spark
plan's, so that a mistake in the plan (ranges, folds, top-k before join) shows. Money is summed as decimal and returned as double;
counts as bigint.
"""

from __future__ import annotations

AS_OF_A = "DATE '1998-06-17'"
AS_OF_B = "DATE '2024-01-17'"


def _image(key: str, prefix: str) -> str:
    return (f"CASE WHEN {key} % 10 = 0 THEN NULL WHEN {key} % 10 = 1 THEN '' "
            f"ELSE '{prefix}' || CAST({key} AS VARCHAR) || '.jpg' END")


_K = "CAST(json_extract_string(e.props, '$.k') AS BIGINT)"

CTES: dict[str, str] = {
    "products": f"""
      SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
             CAST(p_retailprice AS DECIMAL(12,2)) AS price,
             CASE WHEN p_size <= 45 THEN 'Available' ELSE 'Unavailable' END AS status,
             {_image('p_partkey', 'part_')} AS image
      FROM part""",
    "sales": f"""
      SELECT l.l_orderkey * 8 + l.l_linenumber AS sales_id, l.l_partkey AS product_id,
             pn.p_name AS product_name, CAST(l.l_quantity AS INTEGER) AS quantity,
             CAST(l.l_extendedprice AS DECIMAL(12,2)) AS total, l.l_shipdate AS created_at,
             CASE l.l_returnflag WHEN 'N' THEN 'Completed' WHEN 'R' THEN 'Cancelled'
                                 WHEN 'A' THEN 'VOID' END AS status,
             {_image('l.l_partkey', 'part_')} AS product_image
      FROM lineitem l LEFT JOIN part pn ON pn.p_partkey = l.l_partkey""",
    "sales_b": f"""
      SELECT e.event_id AS sales_id, {_K} AS product_id, pn.p_name AS product_name,
             CAST(e.event_id % 5 + 1 AS INTEGER) AS quantity,
             CAST(e.value AS DECIMAL(12,2)) AS total, e.ts AS created_at,
             CASE WHEN e.event_type IN ('purchase', 'click') THEN 'Completed'
                  WHEN e.event_type = 'error' THEN 'Cancelled'
                  WHEN e.event_type = 'signup' THEN 'VOID' ELSE 'Pending' END AS status,
             {_image(_K, 'part_')} AS product_image
      FROM events e LEFT JOIN part pn ON pn.p_partkey = {_K}""",
    "addons": """
      SELECT s_suppkey AS addon_id, s_name AS addon_name,
             CAST(abs(s_acctbal) AS DECIMAL(12,2)) AS price,
             CASE WHEN s_suppkey % 4 = 0 THEN 'Unavailable' ELSE 'Available' END AS status
      FROM supplier""",
    "sale_addons": """
      SELECT l.l_orderkey * 8 + l.l_linenumber AS id, l.l_orderkey AS sale_id,
             l.l_suppkey AS addon_id, s.s_name AS addon_name,
             CAST(abs(s.s_acctbal) AS DECIMAL(12,2)) AS price
      FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "sales_void": """
      SELECT o_orderkey AS void_id, o_orderkey AS sale_id, o_orderpriority AS reason,
             o_orderdate AS voided_at
      FROM orders WHERE o_orderstatus = 'P'""",
    "ingredients": """
      SELECT p_partkey AS ingredient_id, p_name AS ingredient_name,
             CAST(CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS INTEGER) AS stock,
             CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 7 END AS INTEGER)
               AS low_stock_threshold,
             CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS unit,
             CASE WHEN p_partkey % 5 = 0 THEN NULL
                  ELSE 'ing_' || CAST(p_partkey AS VARCHAR) || '.png' END AS image
      FROM part""",
    "audit_logs": """
      SELECT event_id AS log_id, 'user' || CAST(user_id AS VARCHAR) AS "user",
             event_type AS action, props AS details, ts AS created_at
      FROM events""",
    "sale_requests": f"""
      SELECT e.event_id AS request_id,
             e.user_id * 20 + {_K} % 20 - 60 AS product_id,
             CAST(CAST(floor(e.value) AS INTEGER) % 5 AS INTEGER) AS quantity,
             CASE WHEN e.event_type = 'view' THEN CAST([] AS BIGINT[])
                  WHEN e.event_type = 'signup' THEN CAST(NULL AS BIGINT[])
                  ELSE [{_K}, {_K}, e.user_id] END AS addon_ids,
             e.ts AS created_at
      FROM events e""",
    "cancel_requests": "SELECT o_orderkey AS sale_id FROM orders WHERE o_orderstatus = 'F'",
    "void_requests": """
      SELECT o_orderkey AS seq, o_custkey AS sale_id,
             '  ' || o_orderstatus || ' ' || o_orderpriority || chr(9) AS reason,
             o_orderdate AS voided_at
      FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "product_changes": """
      SELECT c_custkey AS seq,
             CASE WHEN c_mktsegment = 'BUILDING' THEN 'insert' ELSE 'update' END AS op,
             CAST(floor(c_custkey / 2) AS BIGINT) * 3 AS product_id,
             ' ' || c_name || ' ' AS product_name,
             CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS price, c_mktsegment AS category,
             CASE WHEN c_acctbal >= 0 THEN 'Available' ELSE 'Unavailable' END AS status,
             CASE WHEN c_acctbal > 5000 THEN ''
                  ELSE 'cust_' || CAST(c_custkey AS VARCHAR) || '.jpg' END AS image
      FROM customer""",
    "ingredient_changes": """
      SELECT c_custkey AS seq,
             CASE WHEN c_mktsegment = 'MACHINERY' THEN 'insert' ELSE 'update' END AS op,
             CAST(floor(c_custkey / 2) AS BIGINT) * 3 AS ingredient_id,
             c_name || ' ' AS ingredient_name,
             CAST(c_nationkey - 2 AS INTEGER) AS stock,
             CAST(floor(c_acctbal / 1000) AS INTEGER) AS low_stock_threshold,
             c_mktsegment || '-based' AS unit,
             CASE WHEN c_acctbal > 5000 THEN ''
                  ELSE 'ci_' || CAST(c_custkey AS VARCHAR) || '.png' END AS image
      FROM customer""",
    "product_deletes": "SELECT o_custkey AS product_id FROM orders WHERE o_orderpriority = '1-URGENT'",
    "ingredient_deletes": "SELECT o_custkey AS ingredient_id FROM orders WHERE o_orderpriority = '2-HIGH'",
    "audit_entries": """
      SELECT o_orderkey + 1000000000000 AS log_id, 'cust' || CAST(o_custkey AS VARCHAR) AS "user",
             CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
                  THEN 'Reset Logs' ELSE 'Update Settings' END AS action,
             CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
                  THEN 'All audit logs cleared' ELSE o_orderpriority END AS details,
             o_orderdate AS created_at
      FROM orders""",
}


def with_tables(names: str, body: str, alias: dict | None = None) -> str:
    """``WITH`` the named adapted tables, then ``body``.

    ``alias`` renames a CTE (e.g. use set B as ``sales``).
    """
    alias = alias or {}
    parts = []
    for n in names.split():
        src = alias.get(n, n)
        parts.append(f"{n} AS ({CTES[src]})")
    return "WITH " + ",\n".join(parts) + "\n" + body


def _money(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


SQL: dict[str, str] = {}

# --- Period KPIs -------------------------------------------------------------
_DAY_A = f"created_at >= {AS_OF_A} AND created_at < {AS_OF_A} + INTERVAL 1 DAY"
_T7_A = f"created_at >= {AS_OF_A} - INTERVAL 6 DAY AND created_at < {AS_OF_A} + INTERVAL 1 DAY"
_MONTH_A = f"month(created_at) = month({AS_OF_A}) AND year(created_at) = year({AS_OF_A})"
_DATE_EQ_A = f"CAST(created_at AS DATE) = {AS_OF_A}"
_WEEK_A = f"yearweek(created_at) = yearweek({AS_OF_A})"

SQL["daily_total_any_status"] = with_tables("sales", f"""
SELECT {_money('coalesce(sum(total), 0)')} AS total FROM sales WHERE {_DAY_A}""")

SQL["trailing7_total_completed"] = with_tables("sales", f"""
SELECT {_money('coalesce(sum(total), 0)')} AS total FROM sales
WHERE status = 'Completed' AND {_T7_A}""")

SQL["monthly_total_any_status"] = with_tables("sales", f"""
SELECT {_money('coalesce(sum(total), 0)')} AS total FROM sales WHERE {_MONTH_A}""")

SQL["daily_orders"] = with_tables("sales", f"""
SELECT CAST(count(*) AS BIGINT) AS orders FROM sales WHERE {_DAY_A}""")

SQL["monthly_forecast"] = with_tables("sales", f"""
SELECT {_money('coalesce(sum(total), 0) * 1.1')} AS forecast FROM sales WHERE {_MONTH_A}""")

SQL["dashboard_kpis"] = with_tables("sales", f"""
SELECT {_money(f'(SELECT coalesce(sum(total), 0) FROM sales WHERE {_DAY_A})')} AS daily,
       {_money(f'(SELECT coalesce(sum(total), 0) FROM sales WHERE {_T7_A})')} AS weekly,
       {_money(f'(SELECT coalesce(sum(total), 0) FROM sales WHERE {_MONTH_A})')} AS monthly,
       (SELECT CAST(count(*) AS BIGINT) FROM sales WHERE {_DAY_A}) AS today_orders,
       {_money(f'(SELECT coalesce(sum(total), 0) FROM sales WHERE {_MONTH_A}) * 1.1')} AS forecast""")

SQL["report_summary_weekly"] = with_tables("sales", f"""
SELECT {_money('coalesce(sum(total), 0)')} AS total_sales,
       CAST(count(*) AS BIGINT) AS total_transactions
FROM sales WHERE status = 'Completed' AND {_WEEK_A}""")

SQL["report_summary_monthly"] = with_tables("sales", f"""
SELECT {_money('coalesce(sum(total), 0)')} AS total_sales,
       CAST(count(*) AS BIGINT) AS total_transactions
FROM sales WHERE status = 'Completed' AND {_MONTH_A}""")

SQL["completed_totals"] = with_tables("sales", f"""
SELECT {_money('coalesce(sum(total), 0)')} AS total_sales,
       CAST(count(*) AS BIGINT) AS total_transactions
FROM sales WHERE status = 'Completed'""")


def _report_kpis(cond: str) -> str:
    return with_tables("sales", f"""
SELECT {_money(f"(SELECT coalesce(sum(total), 0) FROM sales WHERE status = 'Completed' AND {cond})")} AS total_sales,
       (SELECT CAST(count(*) AS BIGINT) FROM sales WHERE status = 'Completed' AND {cond}) AS total_transactions,
       {_money(f"(SELECT coalesce(sum(total), 0) FROM sales WHERE status = 'Completed' AND {_T7_A})")} AS weekly_sales,
       {_money(f"(SELECT coalesce(sum(total), 0) FROM sales WHERE status = 'Completed' AND {_MONTH_A})")} AS monthly_sales,
       (SELECT CAST(count(*) AS BIGINT) FROM sales WHERE status = 'Completed' AND {_DATE_EQ_A}) AS today_orders""")


SQL["report_kpis_daily"] = _report_kpis(_DATE_EQ_A)
SQL["report_kpis_all"] = _report_kpis("1=1")


# --- Rankings ------------------------------------------------------------------
def _sold(name: str, cond: str) -> str:
    """Units and revenue per product and sale-time name, in a period."""
    return f""",
  sold AS (SELECT product_id, product_name, CAST(sum(quantity) AS BIGINT) AS {name}, sum(total) AS money
           FROM sales WHERE {cond} GROUP BY ALL)
"""


def _best(name: str) -> str:
    return f"ORDER BY {name} DESC, product_id NULLS FIRST, product_name NULLS FIRST LIMIT 10"


def _top_with_image(cond: str) -> str:
    return with_tables("sales products", _sold("qty", cond) + f"""
SELECT product_id, product_name, qty, {_money('money')} AS revenue, image, {_money('price')} AS price, category
FROM sold JOIN (SELECT product_id, image, price, category FROM products WHERE length(image) > 0) shown USING (product_id)
{_best('qty')}""")


def _top_completed(cond: str) -> str:
    return with_tables("sales products", _sold("qty_sold", f"status = 'Completed' AND {cond}") + f"""
SELECT product_id, product_name, qty_sold, {_money('money')} AS revenue,
       (SELECT any_value(image) FROM products p WHERE p.product_id = sold.product_id) AS image,
       (SELECT {_money('any_value(price)')} FROM products p WHERE p.product_id = sold.product_id) AS price,
       (SELECT any_value(category) FROM products p WHERE p.product_id = sold.product_id) AS category
FROM sold {_best('qty_sold')}""")


SQL["top_with_image_daily"] = _top_with_image(_DAY_A)
SQL["top_with_image_trailing7"] = _top_with_image(_T7_A)
SQL["top_with_image_monthly"] = _top_with_image(_MONTH_A)
SQL["top_completed_daily"] = _top_completed(_DATE_EQ_A)
SQL["top_completed_trailing7"] = _top_completed(_T7_A)
SQL["top_completed_monthly"] = _top_completed(_MONTH_A)

SQL["category_ranking"] = with_tables("sales products", f""",
  live AS (SELECT product_id, category FROM products),
  sums AS (SELECT category, sum(quantity) AS q, sum(total) AS t FROM live
           JOIN (FROM sales WHERE status = 'Completed') USING (product_id) GROUP BY category)
SELECT 1 + (SELECT count(*) FROM sums o WHERE o.t > s.t OR (o.t = s.t AND (o.category < s.category
            OR (o.category IS NULL AND s.category IS NOT NULL)))) AS rank,
       category, CAST(q AS BIGINT) AS total_quantity, {_money('t')} AS total_sales FROM sums s""")


# --- Sales listing -------------------------------------------------------------
_ADDON_TEXT = """
  nested AS (
    SELECT sale_id,
           string_agg(coalesce(addon_name, '') || ' +' || coalesce(CAST(price AS VARCHAR), ''), '; '
                      ORDER BY id NULLS FIRST, addon_name NULLS FIRST, price NULLS FIRST, addon_id NULLS FIRST)
             AS addons,
           CAST(count(*) AS BIGINT) AS n_addons
    FROM sale_addons GROUP BY sale_id)"""

SQL["addons_by_sale"] = with_tables("sale_addons", "SELECT * FROM nested").replace(
    "\nSELECT * FROM nested", "," + _ADDON_TEXT + "\nSELECT sale_id, addons, n_addons FROM nested")

SQL["addon_copies_by_sale"] = with_tables("sale_addons", f"""
SELECT sale_id, min(id) AS first_id, addon_name, {_money('price')} AS price, addon_id, CAST(count(*) AS BIGINT) AS n
FROM sale_addons GROUP BY sale_id, addon_name, price, addon_id""")


def _half_up_div(num_cents: str, den: str) -> str:
    """round(num_cents / den) half away from zero, in exact integers."""
    return f"(sign({num_cents}) * ((2 * abs({num_cents}) + ({den})) // (2 * ({den}))))"


_BADGE = """CASE lower(coalesce(s.status, '')) WHEN 'completed' THEN 'completed'
      WHEN 'void' THEN 'void' WHEN 'cancelled' THEN 'cancelled' WHEN 'canceled' THEN 'cancelled'
      ELSE 'pending' END"""


def _sales_list(where: str, no_product: str = "false") -> str:
    cents = "CAST(coalesce(s.total, 0) * 100 AS BIGINT)"
    q = "greatest(coalesce(s.quantity, 0), 1)"
    body = f""",{_ADDON_TEXT},
  shown AS (SELECT * REPLACE (CASE WHEN {no_product} THEN NULL ELSE product_id END AS product_id)
            FROM sales s WHERE {where}),
  texts AS (SELECT sale_id, addons AS t FROM nested)
SELECT s.sales_id, s.product_id, s.product_name, CAST(s.quantity AS BIGINT) AS quantity,
       {_money('s.total')} AS total, s.created_at, s.status, s.product_image,
       (SELECT any_value(category) FROM products p WHERE p.product_id = s.product_id) AS product_category,
       coalesce(texts.t, '') AS addons,
       CAST({_half_up_div(cents, q)} AS DOUBLE) / 100 AS unit_price,
       {_BADGE} AS badge,
       coalesce(s.product_image, '') NOT IN ('', '0') AS has_image,
       coalesce(s.status, '') = 'Completed' AS can_cancel
FROM shown s LEFT JOIN texts ON texts.sale_id = s.sales_id"""
    return with_tables("sales products sale_addons", "", alias={"sales": "sales_b"}) + body.lstrip("\n")


SQL["sales_list_all"] = _sales_list("1=1")
SQL["sales_list_search_day"] = _sales_list(
    f"strip_accents(lower(s.product_name)) LIKE '%bolt%' AND CAST(s.created_at AS DATE) = {AS_OF_B}")
SQL["sales_list_wildcard"] = _sales_list("strip_accents(lower(s.product_name)) LIKE '%r_d w%'")


def _report_rows(cond: str) -> str:
    return with_tables("sales", f"""
SELECT product_name, CAST(quantity AS BIGINT) AS quantity, {_money('total')} AS total, created_at, status
FROM sales WHERE status = 'Completed' AND {cond}
ORDER BY created_at DESC""")


SQL["report_transactions_monthly"] = _report_rows(_MONTH_A)
SQL["report_transactions_weekly"] = _report_rows(_WEEK_A)

SQL["sale_badges"] = with_tables("sales", f"""
SELECT s.sales_id, s.status, {_BADGE} AS badge FROM sales s""", alias={"sales": "sales_b"})

# --- Catalogue -------------------------------------------------------------------
SQL["sellable_products"] = with_tables("products", f"""
SELECT product_id, product_name, category, {_money('price')} AS price
FROM products WHERE status = 'Available' ORDER BY category, product_name""")

SQL["menu_sections"] = with_tables("products", f"""
SELECT category, CAST(count(*) AS BIGINT) AS items, {_money('min(price)')} AS min_price,
       {_money('max(price)')} AS max_price
FROM products WHERE status = 'Available' GROUP BY category""")

SQL["sellable_addons"] = with_tables("addons", f"""
SELECT addon_id, addon_name, {_money('price')} AS price
FROM addons WHERE status = 'Available' ORDER BY addon_name""")

_PRODUCT_COLS = f"""product_id, product_name, category, {_money('price')} AS price, status, image,
       status = 'Available' AS is_available,
       CASE WHEN status = 'Available' THEN 'Available' ELSE 'Unavailable' END AS availability"""

SQL["product_search"] = with_tables("products", f"""
SELECT {_PRODUCT_COLS} FROM products
WHERE strip_accents(lower(product_name)) LIKE '%ring%'
  AND strip_accents(lower(category)) = 'standard'
  AND strip_accents(lower(status)) = 'available'""")

SQL["product_search_none"] = with_tables("products", f"SELECT {_PRODUCT_COLS} FROM products")

# --- Inventory -------------------------------------------------------------------
_ING = "ingredient_id, ingredient_name, CAST(stock AS BIGINT) AS stock, " \
       "CAST(low_stock_threshold AS BIGINT) AS low_stock_threshold, unit, image"
_THR = "coalesce(low_stock_threshold, 5)"
_LABEL = f"""CASE WHEN stock IS NULL OR stock <= {_THR} THEN 'Low'
     WHEN stock <= {_THR} * 3 THEN 'Mid' ELSE 'Good' END"""
_CLS = f"""CASE WHEN stock IS NULL OR stock <= {_THR} THEN 'badge-bad'
     WHEN stock <= {_THR} * 3 THEN 'badge-mid' ELSE 'badge-good' END"""
_HAS_IMAGE = "coalesce(image, '') NOT IN ('', '0')"
_UNIT_LABEL = "upper(substr(coalesce(unit, 'Other'), 1, 1)) || substr(coalesce(unit, 'Other'), 2) || '-based'"

SQL["stock_status"] = with_tables("ingredients", f"""
SELECT ingredient_id, ingredient_name, unit, CAST(stock AS BIGINT) AS stock,
       CAST({_THR} AS BIGINT) AS threshold, {_LABEL} AS label, image,
       {_HAS_IMAGE} AS has_image
FROM ingredients ORDER BY stock ASC NULLS FIRST""")

SQL["ingredient_search"] = with_tables("ingredients", f"""
SELECT {_ING} FROM ingredients
WHERE strip_accents(lower(ingredient_name)) LIKE '%e%' AND lower(unit) = 'brand#2'
  AND stock > low_stock_threshold AND stock <= low_stock_threshold * 3""")

SQL["ingredient_search_low"] = with_tables("ingredients", f"""
SELECT {_ING} FROM ingredients WHERE stock <= low_stock_threshold""")

_PCT_NUM = "coalesce(stock, 0) * 100"
_PCT_DEN = "greatest(coalesce(low_stock_threshold, 0) * 3, 1)"
SQL["stock_cards"] = with_tables("ingredients", f"""
SELECT {_ING},
       CASE WHEN stock IS NULL THEN 'low'
            WHEN low_stock_threshold IS NULL THEN
                 CASE WHEN stock = 0 THEN 'low' WHEN stock < 0 THEN 'mid' ELSE 'high' END
            WHEN stock <= low_stock_threshold THEN 'low'
            WHEN stock <= low_stock_threshold * 3 THEN 'mid' ELSE 'high' END AS level,
       CAST(least(100, {_half_up_div(_PCT_NUM, _PCT_DEN)}) AS BIGINT) AS fill_pct,
       {_HAS_IMAGE} AS has_image
FROM ingredients""")

SQL["low_stock_alerts"] = with_tables("ingredients", """
SELECT ingredient_name AS label, CAST(stock AS BIGINT) AS stock,
       CAST(low_stock_threshold AS BIGINT) AS low_stock_threshold
FROM ingredients WHERE stock <= low_stock_threshold ORDER BY ingredient_name""")

SQL["low_stock_alert_count"] = with_tables("ingredients", """
SELECT CAST(count(*) AS BIGINT) AS alerts,
       CASE WHEN count(*) > 0 THEN CAST(count(*) AS VARCHAR) || ' ingredient'
            || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ' need'
            || CASE WHEN count(*) = 1 THEN 's' ELSE '' END || ' restocking' END AS message
FROM ingredients WHERE stock <= low_stock_threshold""")


def _inventory_report(where: str) -> str:
    return with_tables("ingredients", f"""
SELECT * FROM (
  SELECT {_ING}, {_CLS} AS cls, {_UNIT_LABEL} AS unit_label, CAST({_THR} AS BIGINT) AS threshold, {_LABEL} AS label
  FROM ingredients) t
WHERE {where} ORDER BY stock ASC NULLS FIRST""")


SQL["inventory_report"] = _inventory_report("1=1")
SQL["inventory_report_filtered"] = _inventory_report("cls = 'badge-good' AND unit_label = 'Brand#2-based'")

SQL["unit_labels"] = with_tables("ingredients", f"""
SELECT DISTINCT {_UNIT_LABEL} AS unit_label FROM ingredients""")


# --- Batch change jobs -------------------------------------------------------------
_SALES_COLS = f"""s.sales_id, s.product_id, s.product_name, CAST(s.quantity AS BIGINT) AS quantity,
       {_money('s.total')} AS total, s.created_at, {{status}} AS status, s.product_image"""

_PRICING = """,
  once AS (SELECT DISTINCT * FROM sale_requests),
  rep AS (SELECT request_id FROM once GROUP BY request_id HAVING count(*) > 1),
  uniq AS (SELECT * FROM once WHERE request_id NOT IN (SELECT request_id FROM rep)),
  ok AS (SELECT * FROM uniq WHERE product_id > 0 AND quantity > 0),
  lk AS (SELECT ok.*, p.product_name AS pname, p.price AS pprice, p.image AS pimage
         FROM ok LEFT JOIN products p ON p.product_id = ok.product_id),
  fnd AS (SELECT * FROM lk WHERE pname IS NOT NULL AND pname <> '' AND pname <> '0'),
  ids AS (SELECT DISTINCT request_id, unnest(addon_ids) AS aid FROM fnd),
  ad AS (SELECT ids.request_id, a.addon_id, a.addon_name, a.price
         FROM ids JOIN addons a ON a.addon_id = ids.aid WHERE a.status = 'Available'),
  tot AS (SELECT request_id, sum(price) AS addon_total FROM ad GROUP BY request_id)
"""

SQL["price_sales_accepted"] = with_tables("products addons sale_requests", _PRICING + f"""
SELECT f.request_id AS sales_id, f.product_id, f.pname AS product_name,
       CAST(f.quantity AS BIGINT) AS quantity,
       {_money('f.quantity * coalesce(f.pprice, 0) + f.quantity * coalesce(t.addon_total, 0)')} AS total,
       f.created_at, 'Completed' AS status, f.pimage AS product_image
FROM fnd f LEFT JOIN tot t ON t.request_id = f.request_id
WHERE abs(f.quantity * coalesce(f.pprice, 0) + f.quantity * coalesce(t.addon_total, 0)) < 10000000000""")

SQL["price_sales_rejects"] = with_tables("products addons sale_requests", _PRICING + """
SELECT request_id, 'Duplicate key.' AS reason FROM rep
UNION ALL
SELECT f.request_id, 'Total out of range.' AS reason FROM fnd f LEFT JOIN tot t ON t.request_id = f.request_id
WHERE abs(f.quantity * coalesce(f.pprice, 0) + f.quantity * coalesce(t.addon_total, 0)) >= 10000000000
UNION ALL
SELECT request_id, 'Invalid product or quantity.' AS reason FROM uniq
WHERE NOT coalesce(product_id > 0 AND quantity > 0, false)
UNION ALL
SELECT request_id, 'Product not found.' AS reason FROM lk
WHERE pname IS NULL OR pname = '' OR pname = '0'""")

SQL["sale_addon_rows"] = with_tables("products addons sale_requests", _PRICING + f"""
SELECT request_id AS sale_id, addon_id, addon_name, {_money('price')} AS price FROM ad""")

SQL["apply_cancellations"] = with_tables("sales cancel_requests", f"""
SELECT {_SALES_COLS.format(status="CASE WHEN c.sale_id IS NOT NULL AND s.status = 'Completed' THEN 'Cancelled' ELSE s.status END")}
FROM sales s LEFT JOIN (SELECT DISTINCT sale_id FROM cancel_requests) c ON c.sale_id = s.sales_id""",
                                         alias={"sales": "sales_b"})

_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
_VOIDS = """,
  von AS (SELECT DISTINCT * FROM void_requests),
  vrep AS (SELECT seq FROM von GROUP BY seq HAVING count(*) > 1),
  vok AS (SELECT * FROM von WHERE sale_id > 0 AND sale_id IN (SELECT sales_id FROM sales)
          AND seq NOT IN (SELECT seq FROM vrep))
"""

SQL["apply_voids_sales"] = with_tables("sales sales_void void_requests", _VOIDS + f"""
SELECT {_SALES_COLS.format(status="CASE WHEN s.sales_id IN (SELECT sale_id FROM vok) THEN 'VOID' ELSE s.status END")}
FROM sales s""", alias={"sales": "sales_b"})

SQL["apply_voids_log"] = with_tables("sales sales_void void_requests", _VOIDS + f"""
SELECT void_id, sale_id, reason, voided_at FROM sales_void
UNION ALL
SELECT seq AS void_id, sale_id, trim(coalesce(reason, ''), {_TRIM}) AS reason, voided_at FROM vok""",
                                     alias={"sales": "sales_b"})

SQL["apply_voids_rejects"] = with_tables("sales void_requests", """,
  von AS (SELECT DISTINCT * FROM void_requests),
  vrep AS (SELECT seq FROM von GROUP BY seq HAVING count(*) > 1),
  v AS (SELECT * FROM von WHERE seq NOT IN (SELECT seq FROM vrep))
SELECT seq, CAST(NULL AS BIGINT) AS sale_id, 'Duplicate key.' AS reason FROM vrep
UNION ALL
SELECT seq, sale_id, 'Invalid sale.' AS reason FROM v WHERE NOT coalesce(sale_id > 0, false)
UNION ALL
SELECT seq, sale_id, 'Unknown sale.' AS reason FROM v
WHERE sale_id > 0 AND sale_id NOT IN (SELECT sales_id FROM sales)""", alias={"sales": "sales_b"})

SQL["apply_status_changes"] = with_tables("sales cancel_requests void_requests", _VOIDS + f"""
SELECT {_SALES_COLS.format(status='''CASE WHEN s.sales_id IN (SELECT sale_id FROM vok) THEN 'VOID'
            WHEN s.sales_id IN (SELECT sale_id FROM cancel_requests) AND s.status = 'Completed'
            THEN 'Cancelled' ELSE s.status END''')}
FROM sales s""", alias={"sales": "sales_b"})

SQL["reset_history_sales"] = with_tables("sales", f"""
SELECT {_SALES_COLS.format(status="s.status")} FROM sales s
WHERE s.created_at >= TIMESTAMP '2024-01-15 12:00:00'""", alias={"sales": "sales_b"})

SQL["reset_history_addons"] = with_tables("sales sale_addons", f"""
SELECT id, sale_id, addon_id, addon_name, {_money('price')} AS price FROM sale_addons
WHERE sale_id IN (SELECT sales_id FROM sales WHERE created_at >= TIMESTAMP '2024-01-15 12:00:00')""",
                                          alias={"sales": "sales_b"})

SQL["reset_history_voids"] = with_tables("sales sales_void", """
SELECT void_id, sale_id, reason, voided_at FROM sales_void
WHERE voided_at >= TIMESTAMP '1996-01-01 00:00:00'
  AND sale_id IN (SELECT sales_id FROM sales WHERE created_at >= TIMESTAMP '1996-01-01 00:00:00')""",
                                         alias={"sales": "sales_b"})


def _upsert_sql(base: str, changes: str, key: str, vals: list[str], cast_base: dict,
                bad: str | None, bad_reason: str | None, out_cols: list[str]) -> tuple[str, str]:
    """(table SQL, rejects SQL) for a sequential per-key fold, written with windows."""
    bad_case = f"WHEN {bad} THEN '{bad_reason}'" if bad else ""
    common = f""",
  cv AS (SELECT *, CASE WHEN {key} IS NULL THEN 'Missing key.'
                        WHEN op NOT IN ('insert', 'update') THEN 'Unknown operation.'
                        {bad_case} END AS bad FROM ch),
  cd AS (SELECT DISTINCT * FROM cv WHERE bad IS NULL),
  clash AS (SELECT {key}, seq FROM cd GROUP BY {key}, seq HAVING count(*) > 1),
  c AS (SELECT * FROM cd WHERE ({key}, seq) NOT IN (SELECT ({key}, seq) FROM clash)),
  fi AS (SELECT {key}, min(seq) AS first_insert FROM c WHERE op = 'insert' GROUP BY {key}),
  ck AS (SELECT c.*, fi.first_insert, b.{key} IS NOT NULL AS in_base
         FROM c LEFT JOIN fi USING ({key})
         LEFT JOIN (SELECT DISTINCT {key} FROM {base}) b USING ({key})),
  ck2 AS (SELECT *, coalesce((op = 'update' AND (in_base OR (first_insert IS NOT NULL AND seq > first_insert)))
                     OR (op = 'insert' AND NOT in_base AND seq = first_insert), false) AS applies FROM ck),
  ap AS (SELECT * FROM ck2 WHERE applies),
  lastv AS (SELECT * FROM (SELECT ap.*, row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) AS rn
                           FROM ap) WHERE rn = 1),
  img AS (SELECT {key}, image AS new_image FROM (
            SELECT {key}, image, row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) AS rn
            FROM ap WHERE op = 'insert' OR NOT (image IS NULL OR image = '' OR image = '0')) WHERE rn = 1),
  ins AS (SELECT {key} FROM ap WHERE op = 'insert')
"""
    sel_upd = []
    sel_ins = []
    for col in out_cols:
        cb = cast_base.get(col, "{}")
        if col == key:
            sel_upd.append(f"b.{key}")
            sel_ins.append(f"l.{key}")
        elif col == "image":
            sel_upd.append("CASE WHEN i.{k} IS NOT NULL THEN i.new_image ELSE b.image END AS image".format(k=key))
            sel_ins.append("i.new_image AS image")
        elif col in vals:
            sel_upd.append(cb.format(f"CASE WHEN l.{key} IS NOT NULL THEN l.{col} ELSE b.{col} END") + f" AS {col}")
            sel_ins.append(cb.format(f"l.{col}") + f" AS {col}")
        else:
            sel_upd.append(cb.format(f"b.{col}") + f" AS {col}")
    table_sql = common + f"""
SELECT {', '.join(sel_upd)}
FROM {base} b LEFT JOIN lastv l ON l.{key} = b.{key} AND l.{key} NOT IN (SELECT {key} FROM ins)
LEFT JOIN img i ON i.{key} = b.{key} AND i.{key} NOT IN (SELECT {key} FROM ins)
UNION ALL
SELECT {', '.join(sel_ins)}
FROM lastv l JOIN img i ON i.{key} = l.{key}
WHERE l.{key} IN (SELECT {key} FROM ins)"""
    rejects_sql = common + f"""
SELECT seq, {key} AS key, bad AS reason FROM cv WHERE bad IS NOT NULL
UNION ALL
SELECT seq, {key} AS key, 'Repeated change number.' AS reason FROM clash
UNION ALL
SELECT seq, {key} AS key, CASE WHEN op = 'insert' THEN 'Duplicate key.'
                              ELSE 'No such row; nothing changed.' END AS reason
FROM ck2 WHERE NOT applies"""
    return table_sql, rejects_sql


_PCH = """,
  ch AS (SELECT seq, lower(trim(op)) AS op, product_id, trim(product_name) AS product_name,
                coalesce(price, 0) AS price, category, status, image FROM product_changes)"""
_pt, _pr = _upsert_sql("products", "ch", "product_id", ["product_name", "price", "category", "status"],
                       {"price": "CAST({} AS DOUBLE)"}, None, None,
                       ["product_id", "product_name", "category", "price", "status", "image"])
SQL["upsert_products"] = with_tables("products product_changes", _PCH + _pt)
SQL["upsert_products_rejects"] = with_tables("products product_changes", _PCH + _pr)

_ICH = """,
  ch AS (SELECT seq, lower(trim(op)) AS op, ingredient_id, trim(ingredient_name) AS ingredient_name,
                coalesce(stock, 0) AS stock, coalesce(low_stock_threshold, 0) AS low_stock_threshold,
                unit, image FROM ingredient_changes)"""
_it, _ir = _upsert_sql("ingredients", "ch", "ingredient_id",
                       ["ingredient_name", "stock", "low_stock_threshold", "unit"],
                       {"stock": "CAST({} AS BIGINT)", "low_stock_threshold": "CAST({} AS BIGINT)"},
                       "stock < 0 OR low_stock_threshold < 0",
                       "Stock and threshold values must not be negative.",
                       ["ingredient_id", "ingredient_name", "stock", "low_stock_threshold", "unit", "image"])
SQL["upsert_ingredients"] = with_tables("ingredients ingredient_changes", _ICH + _it)
SQL["upsert_ingredients_rejects"] = with_tables("ingredients ingredient_changes", _ICH + _ir)

SQL["delete_products_catalog"] = with_tables("products product_deletes", f"""
SELECT product_id, product_name, category, {_money('price')} AS price, status, image FROM products
WHERE product_id NOT IN (SELECT product_id FROM product_deletes WHERE product_id IS NOT NULL)""")

SQL["delete_products_sales"] = with_tables("sales product_deletes", f"""
SELECT s.sales_id,
       CASE WHEN s.product_id IN (SELECT product_id FROM product_deletes) THEN NULL ELSE s.product_id END
         AS product_id,
       s.product_name, CAST(s.quantity AS BIGINT) AS quantity, {_money('s.total')} AS total,
       s.created_at, s.status, s.product_image
FROM sales s""", alias={"sales": "sales_b"})

SQL["delete_ingredients"] = with_tables("ingredients ingredient_deletes", f"""
SELECT {_ING} FROM ingredients
WHERE ingredient_id NOT IN (SELECT ingredient_id FROM ingredient_deletes WHERE ingredient_id IS NOT NULL)""")


# --- Audit and export ----------------------------------------------------------------
SQL["append_audit"] = with_tables("audit_logs audit_entries", """,
  r AS (SELECT max(log_id) AS last_reset FROM audit_entries WHERE action = 'Reset Logs')
SELECT l.* FROM audit_logs l, r WHERE r.last_reset IS NULL
UNION ALL
SELECT e.* FROM audit_entries e, r WHERE r.last_reset IS NULL OR e.log_id >= r.last_reset""")

SQL["recent_audit_logs"] = with_tables("audit_logs", """
SELECT * FROM audit_logs ORDER BY created_at DESC, log_id DESC LIMIT 20""")

SQL["export_summary_monthly"] = with_tables("sales", f"""
SELECT 'Monthly' AS period_label, {_money('coalesce(sum(total), 0)')} AS total_sales,
       CAST(count(*) AS BIGINT) AS total_transactions,
       format('{{:,.2f}}', CAST(coalesce(sum(total), 0) AS DOUBLE)) AS total_sales_text
FROM sales WHERE status = 'Completed' AND {_MONTH_A}""")

SQL["export_transactions_weekly"] = with_tables("sales", f"""
SELECT product_name, CAST(quantity AS BIGINT) AS quantity, {_money('total')} AS total, created_at, status,
       format('{{:,.2f}}', CAST(total AS DOUBLE)) AS total_text
FROM sales WHERE status = 'Completed' AND {_WEEK_A}
ORDER BY created_at DESC""")


# --- Streaming day windows (batch form) ------------------------------------------------
SQL["daily_sales_windows"] = with_tables("sales", f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, {_money('coalesce(sum(total), 0)')} AS total,
       CAST(count(*) AS BIGINT) AS orders,
       {_money("coalesce(sum(CASE WHEN status = 'Completed' THEN total END), 0)")} AS completed_total,
       CAST(count(CASE WHEN status = 'Completed' THEN 1 END) AS BIGINT) AS completed_orders
FROM sales WHERE created_at IS NOT NULL GROUP BY CAST(created_at AS DATE)""", alias={"sales": "sales_b"})


SQL["menu_pages"] = with_tables("products", """,
  r AS (SELECT category, product_name, product_id,
               row_number() OVER (PARTITION BY category ORDER BY product_name NULLS FIRST, product_id) - 1 AS rn
        FROM products WHERE status = 'Available')
SELECT category, CAST(floor(rn / 25) AS BIGINT) AS page,
       string_agg(product_name || '#' || CAST(product_id AS VARCHAR), '; '
                  ORDER BY product_name NULLS FIRST, product_id) AS items,
       CAST(count(*) AS BIGINT) AS n_items
FROM r GROUP BY category, floor(rn / 25)""").replace("WITH products AS", "WITH products AS", 1)


# --- More parameter variants -------------------------------------------------------------
SQL["report_kpis_monthly"] = _report_kpis(_MONTH_A)
SQL["report_transactions_daily"] = _report_rows(_DATE_EQ_A)
SQL["stock_cards_low_search"] = with_tables("ingredients", f"""
SELECT {_ING},
       CASE WHEN stock IS NULL THEN 'low'
            WHEN low_stock_threshold IS NULL THEN
                 CASE WHEN stock = 0 THEN 'low' WHEN stock < 0 THEN 'mid' ELSE 'high' END
            WHEN stock <= low_stock_threshold THEN 'low'
            WHEN stock <= low_stock_threshold * 3 THEN 'mid' ELSE 'high' END AS level,
       CAST(least(100, {_half_up_div(_PCT_NUM, _PCT_DEN)}) AS BIGINT) AS fill_pct,
       {_HAS_IMAGE} AS has_image
FROM ingredients WHERE stock <= low_stock_threshold""")
SQL["inventory_report_bad"] = _inventory_report("cls = 'badge-bad'")

_DAY_B = f"created_at >= {AS_OF_B} AND created_at < {AS_OF_B} + INTERVAL 1 DAY"
_T7_B = f"created_at >= {AS_OF_B} - INTERVAL 6 DAY AND created_at < {AS_OF_B} + INTERVAL 1 DAY"
_MONTH_B = f"month(created_at) = month({AS_OF_B}) AND year(created_at) = year({AS_OF_B})"
SQL["dashboard_from_stream_days"] = with_tables("sales", f"""
SELECT {_money(f'(SELECT coalesce(sum(total), 0) FROM sales WHERE {_DAY_B})')} AS daily,
       {_money(f'(SELECT coalesce(sum(total), 0) FROM sales WHERE {_T7_B})')} AS weekly,
       {_money(f'(SELECT coalesce(sum(total), 0) FROM sales WHERE {_MONTH_B})')} AS monthly,
       (SELECT CAST(count(*) AS BIGINT) FROM sales WHERE {_DAY_B}) AS today_orders,
       {_money(f'(SELECT coalesce(sum(total), 0) FROM sales WHERE {_MONTH_B}) * 1.1')} AS forecast""",
                                                 alias={"sales": "sales_b"})

SQL["sales_list_day"] = _sales_list(f"CAST(s.created_at AS DATE) = {AS_OF_B}")
SQL["product_search_wildcard"] = with_tables("products", f"""
SELECT {_PRODUCT_COLS} FROM products
WHERE strip_accents(lower(product_name)) LIKE '%bl_e%r%'""")

SQL["report_summary_empty_filter"] = SQL["completed_totals"]
SQL["report_summary_no_filter"] = with_tables("sales", f"""
SELECT {_money('coalesce(sum(total), 0)')} AS total_sales,
       CAST(count(*) AS BIGINT) AS total_transactions
FROM sales WHERE status = 'Completed' AND {_DATE_EQ_A}""")


# --- Edge rows --------------------------------------------------------------------------
CTES["products_mixed"] = f"""
      SELECT product_id, CASE WHEN product_id % 3 = 0 THEN upper(product_name) ELSE product_name END AS product_name,
             category, price, status, image FROM ({CTES['products']})"""
CTES["ingredients_edge"] = f"""
      SELECT * REPLACE (CASE WHEN ingredient_id % 7 = 0 THEN '0' ELSE image END AS image,
                        CASE WHEN ingredient_id % 9 = 0 THEN 2147483647 ELSE low_stock_threshold END::BIGINT AS low_stock_threshold)
      FROM ({CTES['ingredients']})"""
CTES["sale_requests_repeated"] = f"""
      SELECT * FROM ({CTES['sale_requests']})
      UNION ALL
      SELECT r.* REPLACE (CAST(CASE WHEN e.event_type = 'error' THEN r.quantity + 1 ELSE r.quantity END AS INTEGER) AS quantity)
      FROM ({CTES['sale_requests']}) r JOIN events e ON e.event_id = r.request_id
      WHERE e.event_type IN ('purchase', 'error')"""
CTES["product_changes_repeated"] = f"""
      SELECT * REPLACE (CASE WHEN seq % 4 < 2 THEN CAST(floor(seq / 2) AS BIGINT) ELSE seq + 1000000000 END AS seq)
      FROM (SELECT * FROM ({CTES['product_changes']}) UNION ALL
            SELECT * FROM ({CTES['product_changes']}) WHERE seq % 5 = 0)"""


def _on(sql: str, name: str, other: str) -> str:
    """``sql`` with the table ``name`` built as ``other``."""
    return sql.replace(f"{name} AS ({CTES[name]})", f"{name} AS ({CTES[other]})")


SQL["sales_list_backslash"] = _sales_list("strip_accents(lower(s.product_name)) LIKE '%bolt%'")
SQL["product_search_backslash"] = with_tables("products", f"""
SELECT {_PRODUCT_COLS} FROM products WHERE contains(strip_accents(lower(product_name)), 'ring')""")
SQL["sales_list_without_products"] = _sales_list("1=1", "sales_id % 3 = 0")
SQL["stock_cards_edge"] = _on(SQL["stock_cards"], "ingredients", "ingredients_edge")
SQL["stock_status_edge"] = _on(SQL["stock_status"], "ingredients", "ingredients_edge")
SQL["sellable_products_mixed_case"] = _on(SQL["sellable_products"], "products", "products_mixed")
SQL["menu_pages_mixed_case"] = _on(SQL["menu_pages"], "products", "products_mixed").replace("rn / 25", "rn / 7").replace(
    "ORDER BY product_name NULLS FIRST", "ORDER BY lower(strip_accents(product_name)) NULLS FIRST, product_name NULLS FIRST")
SQL["price_sales_repeated"] = _on(SQL["price_sales_accepted"], "sale_requests", "sale_requests_repeated")
SQL["price_sales_repeated_rejects"] = _on(SQL["price_sales_rejects"], "sale_requests", "sale_requests_repeated")
SQL["upsert_products_repeated_seq"] = _on(SQL["upsert_products"], "product_changes", "product_changes_repeated")
SQL["upsert_products_repeated_rejects"] = _on(SQL["upsert_products_rejects"], "product_changes", "product_changes_repeated")
SQL["append_audit_no_reset"] = with_tables("audit_logs audit_entries", """
SELECT * FROM audit_logs UNION ALL SELECT * FROM audit_entries WHERE action <> 'Reset Logs'""")
SQL["daily_sales_windows_changed"] = with_tables("sales", f""",
  now AS (SELECT s.created_at, s.total, CASE WHEN e.event_type = 'click' THEN 'Cancelled' ELSE s.status END AS status,
                 e.event_type = 'signup' AS gone
          FROM sales s JOIN events e ON e.event_id = s.sales_id)
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day,
       {_money('coalesce(sum(total) FILTER (NOT gone), 0)')} AS total, CAST(count(*) FILTER (NOT gone) AS BIGINT) AS orders,
       {_money("coalesce(sum(total) FILTER (NOT gone AND status = 'Completed'), 0)")} AS completed_total,
       CAST(count(*) FILTER (NOT gone AND status = 'Completed') AS BIGINT) AS completed_orders
FROM now WHERE created_at IS NOT NULL GROUP BY CAST(created_at AS DATE)""", alias={"sales": "sales_b"})
# The same changes, made on stored tables.
for _stored, _same in {
        "stored_status_sales": "apply_status_changes", "stored_status_log": "apply_voids_log", "stored_status_rejects": "apply_voids_rejects",
        "stored_reset_sales": "reset_history_sales", "stored_reset_addons": "reset_history_addons", "stored_reset_voids": "reset_history_voids",
        "stored_delete_products_sales": "delete_products_sales", "stored_upsert_products": "upsert_products",
        "stored_delete_ingredients": "delete_ingredients", "stored_append_audit": "append_audit"}.items():
    SQL[_stored] = SQL[_same]

# Lists of several periods in one result.
def _strip(name: str, qty: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{p}' AS period, * FROM ({SQL[f'{name}_{p}']})" for p in ("daily", "trailing7", "monthly"))
    return f"""SELECT *, row_number() OVER (PARTITION BY period ORDER BY {qty} DESC, product_id NULLS FIRST, product_name NULLS FIRST)
AS rank FROM ({rows}) lists"""


SQL["top_with_image_strip"] = _strip("top_with_image", "qty")
SQL["top_completed_strip"] = _strip("top_completed", "qty_sold")

# Names and categories that differ by case and accents count as one, under the
# smallest spelling.
_SPELT = """SELECT * REPLACE (CASE WHEN sales_id % 3 = 0 THEN upper(product_name) WHEN sales_id % 5 = 0
  THEN replace(product_name, 'e', 'é') ELSE product_name END AS product_name) FROM ("""
for _name in ("top_with_image", "top_completed"):
    SQL[f"{_name}_mixed_case"] = SQL[f"{_name}_monthly"].replace(
        f"sales AS ({CTES['sales']})", f"sales AS ({_SPELT}{CTES['sales']}))").replace(
        "SELECT product_id, product_name, CAST(sum(quantity)", "SELECT product_id, min(product_name) AS product_name, CAST(sum(quantity)").replace(
        "GROUP BY ALL", "GROUP BY product_id, strip_accents(lower(product_name))")
SQL["category_ranking_mixed_case"] = SQL["category_ranking"].replace(
    "live AS (SELECT product_id, category FROM products)",
    "live AS (SELECT product_id, CASE WHEN product_id % 2 = 0 THEN lower(category) ELSE category END AS category FROM products)").replace(
    "sums AS (SELECT category,", "sums AS (SELECT min(category) AS category,").replace(
    "USING (product_id) GROUP BY category)", "USING (product_id) GROUP BY lower(category))")

# Searches through an index find what a scan finds.
SQL["product_search_indexed"] = with_tables("products", f"""
SELECT product_id, product_name, category, {_money('price')} AS price, status, image FROM products
WHERE strip_accents(lower(product_name)) LIKE '%r%d w%'""")
SQL["sales_search_indexed"] = with_tables("sales", """
SELECT sales_id, product_name FROM sales WHERE strip_accents(lower(product_name)) LIKE '%r_d w%'""", {"sales": "sales_b"})
