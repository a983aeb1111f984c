"""The registered queries as SQL over the source tables, for a row-by-row check in another engine.

They are written from the shop's rules, as plain joins and groupings, not from the DataFrame code:
no folding before joins, whole windows for numbering. Money is summed and rounded as exact
decimals, as in the library.
"""

from __future__ import annotations

from rackwise.functions.fixed_values import (
    ACQUISITION_TYPES, ACTION_MARKDOWN, ACTION_NONE, ACTION_OLD_ITEMS, ACTION_OVERSTOCK, CATEGORIES, CHANNELS, CONDITION_TEXT,
    CONDITIONS, FITS, GENDERS, MARKDOWN_AGES, PAYOUT_HEADINGS, PENDING_LABEL, PERCENT_OFF_TEXT, PHOTO_LIST_HEADINGS, PRICE_TEXT,
    STAGE_LONG, STAGE_OTHER, STAGE_PERCENT, STAGE_SHORT,
)

_SHOP = """
consignors AS (
  SELECT printf('C%04d', s_suppkey + 1) AS id, s_name AS name,
         CASE WHEN s_suppkey % 4 <> 0 THEN '31-' || s_suppkey END AS whatsapp, CAST(NULL AS VARCHAR) AS email,
         'pix-' || s_suppkey AS pix_key,
         CASE WHEN s_suppkey % 5 <> 0 THEN (40 + 5 * (s_suppkey % 5)) / 100 END AS percent,
         CAST(CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS INTEGER) AS active
  FROM supplier),
lines AS (
  SELECT l.*, CAST(l_shipdate AS DATE) AS date,
         CASE WHEN l_partkey % 53 = 0 THEN 'avulso-' ELSE '' END || l_orderkey AS sku,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.001, 2) AS DOUBLE) AS sale_price,
         CASE WHEN l_discount > 0 THEN
           CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2)) * 0.001, 2) AS DOUBLE)
         END AS discount_value,
         ['Loja', 'Instagram', 'WhatsApp', 'Online'][l_linenumber % 4 + 1] AS channel,
         ['Débito', 'Crédito', 'Pix', 'Dinheiro'][l_linenumber % 4 + 1] AS payment_method,
         CASE WHEN l_suppkey % 9 <> 0 THEN printf('C%04d', l_suppkey + 2) END AS consignor_id
  FROM lineitem l),
sales AS (
  SELECT 'V' || strftime(date, '%y%m') || (((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber) AS id, date, sku, sale_price, discount_value, channel, payment_method, consignor_id,
         CAST(sale_price AS DECIMAL(18,4)) - COALESCE(CAST(discount_value AS DECIMAL(18,4)), 0) AS net,
         l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice
  FROM lines WHERE l_returnflag = 'N'),
items AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sku,
         CASE WHEN o_orderkey % 11 <> 0
              THEN printf('C%04d', o_custkey % ((SELECT count(*) FROM supplier) + 1) + 1) END AS consignor_id,
         CASE WHEN o_orderkey % 11 <> 0 THEN 'consignação' WHEN o_orderkey % 2 = 0 THEN 'doação' ELSE 'troca' END AS acquisition_type,
         CASE o_orderkey % 37 WHEN 0 THEN NULL WHEN 1 THEN 'Vestido' WHEN 2 THEN 'Bolsa' ELSE p_type END AS category, p_name AS subcategory, CASE WHEN o_orderkey % 13 <> 0 THEN p_brand END AS brand,
         CASE WHEN o_orderkey % 23 <> 0 THEN CAST(p_size AS VARCHAR) END AS size,
         ['F', 'M', 'Unissex', 'X'][o_orderkey % 4 + 1] AS gender, ['Ajustada', 'Regular', 'Ampla', 'Larga'][o_orderkey % 4 + 1] AS fit, ['A', 'A-', 'B', 'C'][o_orderkey % 4 + 1] AS condition,
         CAST(0 AS DOUBLE) AS cost,
         CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001, 2) AS DOUBLE) AS list_price,
         CAST(CASE WHEN o_orderkey % 6 <> 5 THEN o_orderkey % 6 END AS INTEGER) AS markdown_stage,
         CAST(o_orderdate AS DATE) AS acquired_at, CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_orderdate AS DATE) END AS listed_at,
         ['Loja', 'Instagram', 'WhatsApp', 'Online'][o_orderkey % 4 + 1] AS channel_listed,
         sold_at,
         CASE o_orderkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'photos/' || o_orderkey END AS photos_url,
         CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 END AS INTEGER) AS active
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
  LEFT JOIN (SELECT sku, max(date) AS sold_at FROM sales GROUP BY 1) s ON s.sku = CAST(o_orderkey AS VARCHAR)),
stock AS (
  SELECT *, DATE '2001-07-15' - listed_at AS age,
         CASE markdown_stage WHEN 0 THEN 0.00 WHEN 1 THEN 0.10 WHEN 2 THEN 0.25 WHEN 3 THEN 0.40 ELSE 0.00 END AS pct
  FROM items WHERE active = 1 AND sold_at IS NULL)
"""

_SALE_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"

# Batches of new rows.
_NEW_CONSIGNORS = """
new_consignors AS (
  SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_name END AS name,
         '31-' || c_custkey AS whatsapp, CAST(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS INTEGER) AS active
  FROM customer)
"""
_NEW_ITEMS = """
new_items AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN printf('C%04d', o_custkey) END AS consignor_id,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS category,
         CASE WHEN o_orderpriority = '5-LOW' THEN 0
              ELSE CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001, 2) AS DOUBLE) END AS list_price,
         CAST(o_orderkey % 4 AS INTEGER) AS markdown_stage, CAST(o_orderdate AS DATE) AS listed_at
  FROM orders)
"""
_NEW_SALES = f"""
new_sales AS (
  SELECT * EXCLUDE (sku, sale_price, date), CASE WHEN l_partkey % 31 <> 0 THEN date END AS date,
         CASE WHEN l_tax < 0.005 THEN '' WHEN l_tax > 0.075 THEN 'perdido-' || sku ELSE sku END AS sku,
         CASE WHEN discount_value IS NULL THEN 0 ELSE sale_price END AS sale_price
  FROM lines WHERE l_returnflag = 'A'),
month_counts AS (SELECT strftime(date, '%y%m') AS month, max(CAST(id[6:] AS BIGINT)) AS n FROM sales GROUP BY 1)
"""
_REGISTERED = f"""{_NEW_SALES},
checked AS (
  SELECT n.* EXCLUDE (consignor_id), i.consignor_id,
         CASE WHEN n.sku = '' THEN 'SKU is required' WHEN n.sale_price <= 0 THEN 'sale price must be positive'
              WHEN n.date IS NULL THEN 'date is required'
              WHEN i.sku IS NULL THEN 'SKU not found' END AS reject_reason
  FROM new_sales n LEFT JOIN items i ON i.sku = n.sku),
accepted AS (
  SELECT 'V' || strftime(date, '%y%m') || printf('%03d', COALESCE(n, 0) + row_number() OVER (
           PARTITION BY strftime(date, '%y%m') ORDER BY {_SALE_ORDER})) AS id, c.*
  FROM checked c LEFT JOIN month_counts ON month = strftime(date, '%y%m') WHERE reject_reason IS NULL)
"""
_CHANGES = """
changes AS (
  SELECT CASE WHEN l_tax > 0.075 THEN 'novo-' || l_orderkey WHEN l_partkey % 43 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS sku,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.001, 2) AS DOUBLE) AS list_price,
         ['Loja', 'Instagram', 'WhatsApp', 'Online'][l_linenumber % 4 + 1] AS channel_listed,
         CASE WHEN l_linestatus = 'O' THEN 'revisado' END AS notes,
         CAST(l_shipdate AS DATE) AS changed_at, l_partkey, l_suppkey, l_linenumber
  FROM lineitem WHERE l_returnflag = 'R'),
last_changes AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY sku ORDER BY changed_at DESC, l_partkey DESC, l_suppkey DESC,
      l_linenumber DESC, list_price DESC, channel_listed DESC, notes DESC NULLS LAST) AS rn FROM changes WHERE sku IS NOT NULL) WHERE rn = 1)
"""
_PHOTOS = """
photo_files AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS sku,
         concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER)) ||
           CASE l_returnflag WHEN 'A' THEN '.jpg' WHEN 'R' THEN '.png' ELSE '.jpeg' END AS file,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS preference
  FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'O')),
inventory AS (
  SELECT sku, count(*) AS n_files, (array_agg(file ORDER BY preference, file))[1] AS first_file
  FROM photo_files GROUP BY sku),
orphans AS (
  SELECT sku AS folder FROM inventory v WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.sku = v.sku AND i.active = 1))
"""
_CATEGORY_REVENUE = """
revenue AS (
  SELECT i.category, count(*) AS qty, CAST(sum(net) AS DOUBLE) AS revenue
  FROM sales s JOIN items i ON s.sku = i.sku
  WHERE s.date >= DATE '2001-06-15' AND s.date <= DATE '2001-07-15' GROUP BY i.category),
shares AS (
  SELECT *, round_even(revenue / (SELECT sum(revenue) FROM revenue) * 100, 1) AS share_pct FROM revenue),
classes AS (
  SELECT *, CAST(cumulative AS DOUBLE) AS cumulative_pct,
         CASE WHEN cumulative <= 80 THEN 'A' WHEN cumulative <= 95 THEN 'B' ELSE 'C' END AS abc_class
  FROM (SELECT *, sum(CAST(share_pct AS DECIMAL(18,1))) OVER (
          ORDER BY revenue DESC, category ROWS UNBOUNDED PRECEDING) AS cumulative FROM shares))
"""
# Sales of the period counted per item; an item's rows are its sales, or one if it has none.
_MATRIX = """
sold_items AS (
  SELECT sku, count(*) AS n FROM sales WHERE date BETWEEN DATE '2001-06-15' AND DATE '2001-07-15' GROUP BY sku),
listed_rows AS (
  SELECT category, size, COALESCE(n, 0) AS n, greatest(COALESCE(n, 0), 1) AS n_rows
  FROM items LEFT JOIN sold_items USING (sku) WHERE listed_at >= DATE '2001-06-15'),
matrix AS (
  SELECT category, size, sold, total, round(CAST(100 AS DOUBLE) * sold / total, 1) AS rate
  FROM (SELECT category, size, CAST(sum(n) AS BIGINT) AS sold, CAST(sum(n_rows) AS BIGINT) AS total FROM listed_rows GROUP BY ALL)
  WHERE total > 1)
"""
_AGEING = """
aged AS (SELECT category, CAST(listed_at < DATE '2001-07-15' - 60 AS INTEGER) AS is_old FROM stock),
ageing AS (
  SELECT category, total_items, old_items, round(CAST(100 AS DOUBLE) * old_items / total_items, 1) AS old_pct
  FROM (SELECT category, CAST(sum(1) AS BIGINT) AS total_items, CAST(sum(COALESCE(is_old, 0)) AS BIGINT) AS old_items FROM aged GROUP BY ALL)
  WHERE total_items >= 6)
"""
# Sales counted per item first. An item is as many rows as it has sales ever, or one.
_PERFORMANCE = """
item_sales AS (
  SELECT sku, count(*) AS ever, count(*) FILTER (date >= DATE '2001-06-15') AS lately,
         sum(net) FILTER (date >= DATE '2001-06-15') AS value FROM sales GROUP BY sku),
item_rows AS (
  SELECT consignor_id, COALESCE(lately, 0) AS n_sold, value,
         CASE WHEN listed_at >= DATE '2001-06-15' THEN greatest(COALESCE(ever, 0), 1) ELSE 0 END AS n_added
  FROM items LEFT JOIN item_sales USING (sku)),
per_consignor AS (
  SELECT consignor_id AS id, CAST(sum(n_added) AS BIGINT) AS items_added_30d, CAST(sum(n_sold) AS BIGINT) AS items_sold_30d,
         CAST(sum(value) AS DOUBLE) AS revenue FROM item_rows GROUP BY ALL),
performance AS (
  SELECT id, name, items_added_30d, items_sold_30d, revenue,
         CASE WHEN items_added_30d > 0 THEN round(CAST(100 AS DOUBLE) * items_sold_30d / items_added_30d, 1) END AS rate
  FROM per_consignor JOIN consignors USING (id) WHERE active = 1 AND items_added_30d + items_sold_30d > 0),
ranked AS (
  SELECT name, items_added_30d, items_sold_30d, COALESCE(rate, 0) AS sell_through_rate,
         COALESCE(revenue, 0) AS revenue_30d,
         row_number() OVER (ORDER BY rate DESC NULLS LAST, revenue DESC NULLS LAST, id) AS rn FROM performance)
"""
_COVERAGE = """
shown AS (SELECT category, CAST(length(COALESCE(photos_url, '')) > 0 AS INTEGER) AS has_photo FROM stock),
coverage AS (
  SELECT category, total, with_photos, round(CAST(100 AS DOUBLE) * with_photos / total, 1) AS coverage_pct
  FROM (SELECT category, CAST(sum(1) AS BIGINT) AS total, CAST(sum(has_photo) AS BIGINT) AS with_photos FROM shown GROUP BY ALL))
"""
# The schedule as rows: an item is due for the last stage whose age it has passed, if that is above its own.
_PENDING = f"""
schedule(stage, min_age, update_needed) AS (VALUES {', '.join(f"({k}, {MARKDOWN_AGES[k]}, '{PENDING_LABEL[k]}')" for k in MARKDOWN_AGES)}),
due AS (
  SELECT sku, max(stage) AS stage FROM stock JOIN schedule ON age > min_age AND markdown_stage < stage GROUP BY sku),
pending AS (SELECT update_needed, count(*) AS qty FROM due JOIN schedule USING (stage) GROUP BY ALL)
"""
_KPIS = """
kpis AS (
  SELECT (SELECT count(*) FROM stock) AS total_stock, n AS period_sales_count, revenue AS period_revenue,
         CASE WHEN listed > 0 THEN n / listed * 100 ELSE 0 END AS sell_through_rate,
         COALESCE((SELECT avg(s.date - i.listed_at) FROM sales s JOIN items i ON s.sku = i.sku
                   WHERE s.date >= DATE '2001-06-15' AND s.date <= DATE '2001-07-15'), 0) AS avg_days_to_sell
  FROM (SELECT count(*) AS n, COALESCE(CAST(sum(net) AS DOUBLE), 0) AS revenue FROM sales
        WHERE date >= DATE '2001-06-15' AND date <= DATE '2001-07-15'),
       (SELECT count(*) AS listed FROM items WHERE listed_at >= DATE '2001-06-15' AND listed_at <= DATE '2001-07-15'))
"""
# Sums per noted consignor; who that is comes afterwards.
_PAYOUTS = """
owed AS (
  SELECT consignor_id, sum(net) AS net, count(*) AS qtd FROM sales
  WHERE consignor_id IS NOT NULL AND date BETWEEN DATE '2001-06-15' AND DATE '2001-07-15' GROUP BY ALL),
shared AS (
  SELECT owed.*, (SELECT name FROM consignors WHERE id = consignor_id) AS name,
         (SELECT pix_key FROM consignors WHERE id = consignor_id) AS pix_key,
         COALESCE((SELECT percent FROM consignors WHERE id = consignor_id), 0.5) AS percent FROM owed),
payouts AS (
  SELECT consignor_id, name, pix_key, percent, CAST(net AS DOUBLE) AS total_net, qtd, CAST(part AS DOUBLE) AS consignor_value,
         CAST(round(net - part, 2) AS DOUBLE) AS shop_value
  FROM (SELECT *, round(CAST(net AS DECIMAL(20,4)) * CAST(percent AS DECIMAL(9,6)), 2) AS part FROM shared))
"""
_TRANSITIONS = """
moves AS (
  SELECT sku, listed_at, markdown_stage, DATE '2001-07-15' - listed_at AS age, active = 1 AND sold_at IS NULL AS ours FROM items),
steps AS (
  SELECT *, ours AND age > 30 AND markdown_stage = 0 AS to1,
         ours AND age > 60 AND (markdown_stage = 1 OR (markdown_stage = 0 AND age > 30)) AS to2,
         ours AND age > 90 AND (markdown_stage = 2 OR (markdown_stage = 1 AND age > 60) OR (markdown_stage = 0 AND age > 60)) AS to3
  FROM moves)
"""
_LABELS = f"""
labels AS (
  SELECT sku, condition, list_price, markdown_stage, listed_at,
         concat_ws(' ', category, brand, size) AS description,
         '{PRICE_TEXT}' || CAST(CAST(round(CAST(list_price AS DECIMAL(18,4)) * (1 - CAST(pct AS DECIMAL(3,2))), 2) AS DECIMAL(18,2)) AS VARCHAR)
           AS price_text,
         '{PRICE_TEXT}' || CAST(CAST(list_price AS DECIMAL(18,2)) AS VARCHAR) AS list_price_text
  FROM stock)
"""

_LABEL_FIELDS = "sku, category, brand, size, condition, list_price, markdown_stage"
_NEWEST = "ORDER BY listed_at DESC, sku DESC"
_IN_PERIOD = "s.date >= DATE '2001-06-15' AND s.date <= DATE '2001-07-15'"
_NO_PHOTO = "(photos_url IS NULL OR photos_url = '')"
_WORK_FIELDS = "sku, category, brand, size, list_price"
_PRICE = "CAST(list_price AS DECIMAL(18,4)) * (1 - CAST(pct AS DECIMAL(3,2)))"
_PCT = "CASE markdown_stage WHEN 0 THEN 0.00 WHEN 1 THEN 0.10 WHEN 2 THEN 0.25 WHEN 3 THEN 0.40 ELSE 0.00 END"
def _stages(texts: dict[int, str], other: str | None = None) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in texts.items())
    return f"CASE markdown_stage {cases}" + (f" ELSE '{other}' END" if other else " END")


def _known(column: str, values: list[str]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"CAST(COALESCE({column} IN ({listed}), FALSE) AS INTEGER) AS {column}_known"


def _headed(headings: dict[str, str]) -> str:
    return ", ".join(f'{c} AS "{heading}"' for c, heading in headings.items())


def _filled(text: str, value: str) -> str:
    """The text with a number in the place of ``%d``."""
    before, after = text.split("%d")
    return f"'{before}' || {value} || '{after}'"


def _rate_columns() -> str:
    sizes = [(str(k), f"= '{k}'") for k in range(1, 46)] + [("null", "IS NULL")]
    return ", ".join(f'COALESCE(max(rate) FILTER (size {test}), 0) AS "{name}"' for name, test in sizes)


_STAGE_LONG, _STAGE_SHORT = _stages(STAGE_LONG, STAGE_OTHER), _stages(STAGE_SHORT, STAGE_OTHER)
_STAGE_PERCENT = _stages(STAGE_PERCENT)
_ALL_ITEM_FIELDS = """sku, consignor_id, acquisition_type, category, subcategory, brand, gender, size, fit,
  CAST(NULL AS VARCHAR) AS color, CAST(NULL AS VARCHAR) AS fabric, condition,
  CAST(NULL AS VARCHAR) AS flaws, CAST(NULL AS DOUBLE) AS bust, CAST(NULL AS DOUBLE) AS waist, CAST(NULL AS DOUBLE) AS length,
  cost, list_price, markdown_stage, acquired_at, listed_at, channel_listed, sold_at,
  CAST(NULL AS DOUBLE) AS sale_price, CAST(NULL AS VARCHAR) AS channel_sold, CAST(NULL AS INTEGER) AS days_on_hand,
  photos_url, CAST(NULL AS VARCHAR) AS notes, active"""
_PICKER = "rtrim(sku || ' - ' || COALESCE(category, '') || ' ' || COALESCE(brand, '') || ' ' || COALESCE(size, '')) AS picker_text, sku AS picked_sku"
_GALLERY_FIELDS = f"""sku, category, brand, size, condition, list_price, markdown_stage, photos_url,
  trim(COALESCE(category, '') || ' ' || COALESCE(brand, '') || ' ' || COALESCE(size, '')) AS title,
  CAST({_PRICE} AS DOUBLE) AS current_price,
  '{PRICE_TEXT}' || CAST(CAST(round({_PRICE}, 2) AS DECIMAL(18,2)) AS VARCHAR) AS price_text,
  CASE WHEN pct > 0 THEN '{PRICE_TEXT}' || CAST(CAST(list_price AS DECIMAL(18,2)) AS VARCHAR) END AS struck_price_text,
  CASE WHEN pct > 0 THEN CAST(CAST(pct * 100 AS INTEGER) AS VARCHAR) || '{PERCENT_OFF_TEXT}' END AS percent_off_text"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join((_SHOP, *parts))


def _slots(cols: int, rows: int) -> str:
    per_sheet = cols * rows
    return f"""SELECT sku, slot, slot // {per_sheet} AS sheet, slot % {per_sheet} % {cols} AS col,
      (slot % {per_sheet}) // {cols} AS row
      FROM (SELECT sku, row_number() OVER (ORDER BY listed_at NULLS FIRST, sku) - 1 AS slot FROM stock)"""


def _merged(price_only: bool) -> str:
    taken = ["list_price"] if price_only else ["list_price", "channel_listed", "notes"]

    def updated(c: str, old: str) -> str:
        return f"CASE WHEN n.sku IS NOT NULL THEN n.{c} ELSE {old} END AS {c}" if c in taken else f"{old} AS {c}"

    fields = ["sku", "list_price", "channel_listed", "notes", "active"]
    if not price_only:
        fields = ["sku", "category", *fields[1:-1], "cost", "markdown_stage", "active"]
    old = {"notes": "CAST(NULL AS VARCHAR)", "sku": "i.sku"}
    known = ", ".join(updated(c, old.get(c, f"i.{c}")) for c in fields)
    start = {"category": "NULL", "cost": "0", "markdown_stage": "0", "active": "1"}
    fresh = ", ".join(start.get(c, f"n.{c}") for c in fields)
    return f"""SELECT {known} FROM items i LEFT JOIN last_changes n ON n.sku = i.sku
      UNION ALL SELECT {fresh} FROM last_changes n WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.sku = n.sku)"""


ORACLE_SQL: dict[str, str] = {
    **{f"load_{table}_{fmt}": f"{_with()} SELECT {fields} FROM {table}" for fmt in ("parquet", "csv") for table, fields in {
        "items": _ALL_ITEM_FIELDS,
        "consignors": "*, CAST(NULL AS VARCHAR) AS notes",
        "sales": """id, date, sku, sale_price, discount_value, channel, CAST(NULL AS VARCHAR) AS customer_name,
          CAST(NULL AS VARCHAR) AS customer_whatsapp, payment_method, CAST(NULL AS VARCHAR) AS notes, consignor_id""",
    }.items()},
    "sql_over_tables": f"""{_with()} SELECT i.brand, s.channel, count(*) AS n_sales, max(s.sale_price) AS top_price
      FROM sales s JOIN items i ON s.sku = i.sku WHERE {_IN_PERIOD} AND i.condition = 'A' GROUP BY i.brand, s.channel""",
    "sql_positional": f"""{_with()} SELECT category, count(*) AS n_items FROM items
      WHERE listed_at >= DATE '2001-06-15' AND listed_at <= DATE '2001-07-15' GROUP BY category""",
    "upsert_items": f"{_with(_CHANGES)} {_merged(price_only=False)}",
    "upsert_items_price_only": f"{_with(_CHANGES)} {_merged(price_only=True)}",
    "delete_items": f"""{_with(_CHANGES)} SELECT sku, category, list_price FROM items
      WHERE sku NOT IN (SELECT sku FROM changes WHERE sku IS NOT NULL)""",
    "keyless_changes": f"{_with(_CHANGES)} SELECT list_price, channel_listed, changed_at FROM changes WHERE sku IS NULL",
    "upsert_consignors": f"""{_with(_NEW_CONSIGNORS)}, edits AS (SELECT printf('C%04d', c_custkey + 1) AS id, * FROM new_consignors)
      SELECT COALESCE(e.id, c.id) AS id, CASE WHEN e.id IS NULL THEN c.name ELSE e.name END AS name,
        CASE WHEN e.id IS NULL THEN c.whatsapp ELSE e.whatsapp END AS whatsapp, pix_key,
        CASE WHEN c.id IS NULL THEN CAST(0.5 AS DOUBLE) ELSE percent END AS percent,
        CASE WHEN e.id IS NULL THEN c.active ELSE e.active END AS active FROM consignors c FULL JOIN edits e ON e.id = c.id""",
    "delete_consignors": f"""{_with()} SELECT id, name, active FROM consignors c
      WHERE NOT EXISTS (SELECT 1 FROM sales s WHERE s.consignor_id = c.id)""",
    "delete_sales": f"{_with()} SELECT id, date, sku FROM sales WHERE payment_method <> 'Pix'",
    "payouts_csv": f"{_with(_PAYOUTS)} SELECT {_headed(PAYOUT_HEADINGS)} FROM payouts",
    "photo_list_csv": f"{_with()} SELECT {_headed(PHOTO_LIST_HEADINGS)} FROM stock WHERE {_NO_PHOTO}",
    "photo_inventory": f"{_with(_PHOTOS)} SELECT sku, n_files, first_file FROM inventory",
    "stamp_photos": f"""{_with(_PHOTOS)} SELECT i.sku, CASE WHEN v.sku IS NOT NULL THEN 'photos/' || v.sku ELSE i.photos_url END
      AS photos_url, listed_at, active FROM items i LEFT JOIN inventory v ON v.sku = i.sku""",
    "consignor_ids": f"""{_with(_NEW_CONSIGNORS)} SELECT printf('C%04d', (SELECT count(*) FROM supplier) +
      row_number() OVER (ORDER BY c_custkey)) AS id, c_custkey, name FROM new_consignors""",
    "skus": f"""{_with(_NEW_ITEMS)}, finished AS (
        SELECT strftime(listed_at, '%y%m') AS month, count(*) AS n FROM new_items WHERE category = 'F' GROUP BY 1)
      SELECT 'BH-' || strftime(listed_at, '%y%m') || '-' || printf('%04d', CASE WHEN category = 'F' THEN 0 ELSE COALESCE(n, 0) END
        + row_number() OVER (PARTITION BY category = 'F', strftime(listed_at, '%y%m') ORDER BY o_orderkey)) AS sku,
        o_orderkey, listed_at FROM new_items LEFT JOIN finished ON month = strftime(listed_at, '%y%m')""",
    "skus_of_one_month": f"""{_with(_NEW_ITEMS)} SELECT 'BH-0107-' || printf('%04d', row_number() OVER (ORDER BY o_orderkey)) AS sku,
      o_orderkey FROM new_items""",
    "sale_ids": f"""{_with(_NEW_SALES)} SELECT 'V' || month_of_sale || printf('%03d', COALESCE(n, 0) + row_number() OVER (
        PARTITION BY month_of_sale ORDER BY {_SALE_ORDER})) AS id, date, sku, sale_price
      FROM (SELECT *, strftime(COALESCE(date, DATE '2001-07-15'), '%y%m') AS month_of_sale FROM new_sales)
      LEFT JOIN month_counts ON month = month_of_sale""",
    "accepted_consignors": f"""{_with(_NEW_CONSIGNORS)} SELECT name, whatsapp, CAST(0.5 AS DOUBLE) AS percent, active
      FROM new_consignors WHERE name <> ''""",
    "rejected_consignors": f"""{_with(_NEW_CONSIGNORS)} SELECT c_custkey, name, 'name is required' AS reject_reason
      FROM new_consignors WHERE name = ''""",
    "accepted_items": f"""{_with(_NEW_ITEMS)} SELECT consignor_id, category, list_price, markdown_stage, listed_at,
      CAST(NULL AS DATE) AS sold_at, CAST(0 AS DOUBLE) AS cost, CAST(1 AS INTEGER) AS active,
      CAST(round(CAST(list_price AS DECIMAL(18,4)) * (1 - CAST({_PCT} AS DECIMAL(3,2))), 2) AS DOUBLE) AS current_price
      FROM new_items WHERE category <> '' AND list_price > 0""",
    "rejected_items": f"""{_with(_NEW_ITEMS)} SELECT o_orderkey, category, list_price,
      CASE WHEN category = '' THEN 'category is required' ELSE 'list price must be positive' END AS reject_reason
      FROM new_items WHERE category = '' OR list_price <= 0""",
    "registered_sales": f"""{_with(_REGISTERED)}
      SELECT id, date, sku, sale_price, discount_value, channel, consignor_id FROM sales
      UNION ALL SELECT id, date, sku, sale_price, discount_value, channel, consignor_id FROM accepted""",
    "registered_net_values": f"""{_with(_REGISTERED)} SELECT id, sku, sale_price - discount_value AS net_value, consignor_id
      FROM accepted""",
    "registered_items": f"""{_with(_REGISTERED)}, last_sale AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC,
          l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM accepted) WHERE rn = 1)
      SELECT i.sku, CASE WHEN s.sku IS NULL THEN i.sold_at ELSE s.date END AS sold_at, s.sale_price, s.channel AS channel_sold,
        i.listed_at FROM items i LEFT JOIN last_sale s ON s.sku = i.sku""",
    "rejected_sales": f"""{_with(_REGISTERED)} SELECT date, sku, sale_price, reject_reason FROM checked
      WHERE reject_reason IS NOT NULL""",
    "markdown_prices": f"""{_with()} SELECT sku, list_price, markdown_stage, CAST(round({_PRICE}, 2) AS DOUBLE) AS current_price,
      CAST({_PRICE} AS DOUBLE) AS current_price_unrounded,
      CASE WHEN pct > 0 THEN CAST(pct * 100 AS INTEGER) END AS percent_off FROM (SELECT *, {_PCT} AS pct FROM items)""",
    "stage_names": f"""{_with()} SELECT sku, {_STAGE_LONG} AS stage_long, {_STAGE_SHORT} AS stage_short,
      {_STAGE_PERCENT} AS stage_percent FROM items""",
    "payout_splits": f"""{_with()}, texts AS (
        SELECT sku, CASE WHEN condition = 'C' THEN 'sem valor' ELSE CAST(list_price AS VARCHAR) END AS total_net,
          CASE WHEN photos_url = '' THEN '' ELSE '0.35' END AS percent,
          CASE WHEN condition = 'C' THEN 0 ELSE CAST(list_price AS DECIMAL(18,4)) END AS total,
          CASE WHEN photos_url = '' THEN 0 ELSE CAST(0.35 AS DECIMAL(9,6)) END AS share FROM items),
      split AS (SELECT *, round(total * share, 2) AS part FROM texts)
      SELECT sku, total_net, percent, CAST(part AS DOUBLE) AS consignor_value, CAST(round(total - part, 2) AS DOUBLE) AS shop_value
      FROM split""",
    "item_ages": f"{_with()} SELECT sku, (DATE '2001-07-15' - listed_at) + CAST(0.25 AS DOUBLE) AS age FROM items",
    "item_checks": f"""{_with()} SELECT sku, {", ".join(_known(c, v) for c, v in (
        ("acquisition_type", ACQUISITION_TYPES), ("category", CATEGORIES), ("gender", GENDERS), ("fit", FITS),
        ("condition", CONDITIONS), ("channel_listed", CHANNELS)))} FROM items""",
    "sale_checks": f"""{_with()} SELECT channel, payment_method, CAST(1 AS INTEGER) AS channel_known,
      CAST(1 AS INTEGER) AS payment_method_known, count(*) AS n_sales FROM sales GROUP BY channel, payment_method""",
    "consignor_list": f"{_with()} SELECT id, name, whatsapp, email, pix_key, percent, active FROM consignors",
    "consignor_cards": f"""{_with()} SELECT id, name, COALESCE(whatsapp, '—') AS whatsapp_text,
      CAST(CAST(round_even(percent * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS percent_text,
      CASE WHEN active = 1 THEN '✅ Ativo' ELSE '❌ Inativo' END AS status FROM consignors""",
    "active_consignors": f"{_with()} SELECT id, name FROM consignors WHERE active = 1",
    "search_consignors": f"""{_with()} SELECT id, name FROM consignors WHERE active = 1
      AND contains(lower(name), 'supplier#0000000') ORDER BY name, id LIMIT 5""",
    "items_with_consignor": f"""{_with()} SELECT sku, consignor_id, COALESCE(name, '') AS consignor_name
      FROM items LEFT JOIN (SELECT id, name FROM consignors WHERE active = 1) ON id = consignor_id""",
    "stock_list": f"""{_with()} SELECT sku, consignor_id, acquisition_type, category, brand, size, condition, list_price,
      markdown_stage, CAST(round({_PRICE}, 2) AS DOUBLE) AS preco_atual, channel_listed, listed_at, photos_url, active
      FROM (SELECT *, {_PCT} AS pct FROM items)""",
    "sales_history": f"""{_with()} SELECT s.id, s.date, s.sku, i.category, i.brand, i.size, s.sale_price,
      s.discount_value, s.sale_price - s.discount_value AS liquido, s.channel, s.payment_method, s.consignor_id
      FROM sales s LEFT JOIN items i ON s.sku = i.sku""",
    "recent_stock_photo": f"{_with()} SELECT sku, category, brand, size, consignor_id, {_PICKER} FROM stock {_NEWEST} LIMIT 100",
    "recent_stock_label": f"{_with()} SELECT {_LABEL_FIELDS}, {_PICKER} FROM stock {_NEWEST} LIMIT 100",
    "item_lookup": f"""{_with(_CHANGES)} SELECT sku, category, list_price, markdown_stage, sold_at FROM items
      WHERE sku IN (SELECT sku FROM changes)""",
    "gallery": f"{_with()} SELECT {_GALLERY_FIELDS} FROM stock",
    "gallery_filtered": f"""{_with()} SELECT {_GALLERY_FIELDS} FROM stock
      WHERE category = 'PROMO' AND brand ILIKE '%brand#1%' AND photos_url IS NOT NULL AND photos_url <> ''""",
    "fast_movers": f"""{_with()} SELECT i.sku, i.category, i.brand, i.size, CAST(s.date - i.listed_at AS INTEGER) AS days_to_sell,
      s.sale_price - COALESCE(s.discount_value, 0) AS net_price FROM sales s JOIN items i ON s.sku = i.sku
      WHERE {_IN_PERIOD} AND s.date - i.listed_at <= 7 ORDER BY days_to_sell, i.sku, net_price LIMIT 10""",
    "very_slow_items": f"""{_with()} SELECT sku, category, brand, size, CAST(age AS INTEGER) AS days_listed, list_price,
      {_STAGE_PERCENT} AS discount FROM stock WHERE age > 90 ORDER BY age DESC, sku LIMIT 20""",
    "photo_worklist_all": f"{_with()} SELECT {_WORK_FIELDS} FROM stock WHERE {_NO_PHOTO}",
    "photo_worklist_new": f"{_with()} SELECT {_WORK_FIELDS} FROM stock WHERE {_NO_PHOTO} AND age <= 30",
    "photo_worklist_high_value": f"{_with()} SELECT {_WORK_FIELDS} FROM stock WHERE {_NO_PHOTO} AND list_price >= 50",
    "photo_worklist_categories": f"""{_with()} SELECT {_WORK_FIELDS} FROM stock WHERE {_NO_PHOTO}
      AND category IN ('PROMO', 'LARGE')""",
    "label_batch": f"{_with()} SELECT {_LABEL_FIELDS} FROM stock {_NEWEST} LIMIT 50",
    "label_batch_filtered": f"""{_with()} SELECT {_LABEL_FIELDS} FROM stock WHERE category = 'SMALL' AND age <= 30
      {_NEWEST} LIMIT 10""",
    "markdown_label_items": f"{_with()} SELECT {_LABEL_FIELDS} FROM stock WHERE markdown_stage = 2 {_NEWEST} LIMIT 20",
    "kpis": f"{_with(_KPIS)} SELECT * FROM kpis",
    "kpis_of_last_days": f"{_with(_KPIS)} SELECT * FROM kpis",
    "kpi_cards": f"""{_with(_KPIS)}
      SELECT 'Estoque Atual' AS metric, format('{{:,}}', total_stock) AS value FROM kpis
      UNION ALL SELECT 'Vendas (Período)', format('{{:,}}', period_sales_count) FROM kpis
      UNION ALL SELECT 'Receita (Período)', '{PRICE_TEXT}' || format('{{:,.2f}}', period_revenue) FROM kpis
      UNION ALL SELECT 'Taxa de Venda', printf('%.1f', sell_through_rate) || '%' FROM kpis
      UNION ALL SELECT 'Dias p/ Vender', printf('%.1f', avg_days_to_sell) FROM kpis""",
    "photo_stats": f"""{_with()} SELECT total_items, with_photos, without_photos,
      round(with_photos * CAST(100 AS DOUBLE) / NULLIF(total_items, 0), 1) AS with_pct,
      round(without_photos * CAST(100 AS DOUBLE) / NULLIF(total_items, 0), 1) AS without_pct
      FROM (SELECT count(*) AS total_items, count(CASE WHEN photos_url IS NOT NULL AND photos_url <> '' THEN 1 END) AS with_photos,
        count(CASE WHEN {_NO_PHOTO} THEN 1 END) AS without_photos FROM stock)""",
    "markdown_pending": f"""{_with()} SELECT count(*) AS markdown_pending FROM stock WHERE (age > 30 AND markdown_stage = 0)
      OR (age > 60 AND markdown_stage = 1) OR (age > 90 AND markdown_stage = 2)""",
    "old_items": f"{_with()} SELECT count(*) AS old_items FROM stock WHERE age > 90",
    "overstocked_categories": f"""{_with()} SELECT count(*) AS overstocked_categories
      FROM (SELECT category FROM stock WHERE category IS NOT NULL GROUP BY category HAVING count(*) > 20)""",
    "action_summary": f"""{_with(_PENDING)}, checks AS (
        SELECT (SELECT count(*) FROM due) AS pending, (SELECT count(*) FROM stock WHERE age > 90) AS old,
               (SELECT count(DISTINCT category) FROM (SELECT category FROM stock GROUP BY category HAVING count(*) > 20)) AS full_cats)
      SELECT CAST(1 AS INTEGER) AS action_no, {_filled(ACTION_MARKDOWN, 'pending')} AS action FROM checks WHERE pending > 0
      UNION ALL SELECT 2, {_filled(ACTION_OLD_ITEMS, 'old')} FROM checks WHERE old > 10
      UNION ALL SELECT 3, {_filled(ACTION_OVERSTOCK, 'full_cats')} FROM checks WHERE full_cats > 0
      UNION ALL SELECT 4, '{ACTION_NONE}' FROM checks WHERE pending = 0 AND old <= 10 AND full_cats = 0""",
    "payouts": f"{_with(_PAYOUTS)} SELECT * FROM payouts",
    "revenue_by_category": f"{_with(_CATEGORY_REVENUE)} SELECT category, qty, revenue FROM revenue",
    "sell_through_matrix": f"{_with(_MATRIX)} SELECT * FROM matrix",
    "sell_through_matrix_distinct": f"""{_with()} SELECT category, size, sold, total,
      round(sold * CAST(100 AS DOUBLE) / total, 1) AS rate FROM (
        SELECT i.category, i.size, count(DISTINCT s.sku) AS sold, count(DISTINCT i.sku) AS total
        FROM items i LEFT JOIN sales s ON i.sku = s.sku AND {_IN_PERIOD}
        WHERE i.listed_at >= DATE '2001-06-15' GROUP BY i.category, i.size) WHERE total >= 2""",
    "sell_through_pivot": f"""{_with(_MATRIX)} SELECT category, {_rate_columns()} FROM matrix GROUP BY category""",
    "stock_by_stage": f"""{_with()} SELECT markdown_stage, {_STAGE_LONG} AS stage_name, count(*) AS qty,
      CAST(sum({_PRICE}) AS DOUBLE) AS current_value FROM stock GROUP BY markdown_stage""",
    "performance_by_stage": f"""{_with()} SELECT markdown_stage, {_STAGE_SHORT} AS stage_name, count(*) AS sold_qty,
      avg(s.date - i.listed_at) AS avg_days FROM sales s JOIN items i ON s.sku = i.sku
      WHERE {_IN_PERIOD} GROUP BY markdown_stage""",
    "top_consignors": f"""{_with()} SELECT name, items_sold, CAST(net AS DOUBLE) AS total_revenue,
      CAST(net AS DOUBLE) / items_sold AS avg_price FROM (
        SELECT c.id, c.name, count(*) AS items_sold, sum(net) AS net FROM sales s JOIN consignors c ON s.consignor_id = c.id
        WHERE {_IN_PERIOD} GROUP BY c.id, c.name) ORDER BY net DESC, id LIMIT 10""",
    "slow_movers": f"""{_with()} SELECT category, count(*) AS qty FROM stock WHERE age > 60 AND markdown_stage < 2
      GROUP BY category ORDER BY qty DESC, category LIMIT 5""",
    "stock_gaps": f"""{_with()} SELECT category, size, count(*) AS current_stock FROM stock GROUP BY category, size
      HAVING count(*) < 3 ORDER BY current_stock, category NULLS FIRST, size NULLS FIRST LIMIT 10""",
    "pending_markdowns": f"{_with(_PENDING)} SELECT * FROM pending",
    "pending_total": f"{_with(_PENDING)} SELECT count(*) AS pending_total FROM due",
    "category_ageing": f"{_with(_AGEING)} SELECT * FROM ageing",
    "problem_categories": f"{_with(_AGEING)} SELECT * FROM ageing WHERE old_pct > 50",
    "high_demand": f"""{_with()} SELECT category, size, total_sold, round_even(mean_days, 1) AS avg_days_to_sell FROM (
        SELECT i.category, i.size, count(*) AS total_sold, avg(s.date - i.listed_at) AS mean_days
        FROM sales s JOIN items i ON s.sku = i.sku WHERE s.date >= DATE '2001-06-15' GROUP BY i.category, i.size)
      WHERE total_sold >= 3 AND mean_days <= 14 ORDER BY total_sold DESC, mean_days, category, size LIMIT 10""",
    "high_demand_of_a_year": f"""{_with()} SELECT category, size, total_sold, round_even(mean_days, 1) AS avg_days_to_sell FROM (
        SELECT i.category, i.size, count(*) AS total_sold, avg(s.date - i.listed_at) AS mean_days
        FROM sales s JOIN items i ON s.sku = i.sku WHERE s.date >= DATE '2001-07-15' - 365 GROUP BY i.category, i.size)
      WHERE total_sold >= 2 AND mean_days <= 300
      ORDER BY total_sold DESC, mean_days, category NULLS FIRST, size NULLS FIRST LIMIT 10""",
    "low_demand": f"""{_with()} SELECT category, size, current_stock, sold_ever,
      round_even(COALESCE(mean_days, 0), 1) AS avg_days_when_sold FROM (
        SELECT category, size, count(*) AS current_stock, count(sold_at) AS sold_ever,
          CAST(sum(sold_at - listed_at) AS DOUBLE) / NULLIF(count(sold_at), 0) AS mean_days
        FROM items WHERE listed_at >= DATE '2001-07-15' - 90 GROUP BY category, size)
      WHERE current_stock >= 3 AND (sold_ever = 0 OR mean_days > 45) ORDER BY current_stock DESC, category, size LIMIT 10""",
    "consignor_performance": f"{_with(_PERFORMANCE)} SELECT * EXCLUDE (rn) FROM ranked",
    "top_performers": f"""{_with(_PERFORMANCE)} SELECT * EXCLUDE (rn) FROM ranked WHERE sell_through_rate >= 50
      ORDER BY rn LIMIT 3""",
    "low_performers": f"""{_with(_PERFORMANCE)} SELECT * EXCLUDE (rn) FROM ranked
      WHERE items_added_30d >= 5 AND sell_through_rate < 20 ORDER BY rn LIMIT 3""",
    "low_performers_below_all": f"""{_with(_PERFORMANCE)} SELECT * EXCLUDE (rn) FROM ranked
      WHERE items_added_30d >= 2 AND sell_through_rate < 100 ORDER BY rn LIMIT 3""",
    "consignor_performance_distinct": f"""{_with()}, lately AS (SELECT sku, sum(net) AS value FROM sales
        WHERE date >= DATE '2001-06-15' GROUP BY sku),
      flags AS (SELECT consignor_id, COALESCE(listed_at >= DATE '2001-06-15', FALSE) AS added, l.sku IS NOT NULL AS sold, value
        FROM items i LEFT JOIN lately l USING (sku)),
      sums AS (SELECT consignor_id, count(*) FILTER (added) AS n_added, count(*) FILTER (sold) AS n_sold,
        CAST(sum(value) AS DOUBLE) AS revenue FROM flags GROUP BY ALL)
      SELECT name, n_added AS items_added_30d, n_sold AS items_sold_30d,
        CASE WHEN n_added > 0 THEN round(CAST(100 AS DOUBLE) * n_sold / n_added, 1) ELSE 0 END AS sell_through_rate,
        COALESCE(revenue, 0) AS revenue_30d
      FROM sums JOIN consignors ON id = consignor_id WHERE active = 1 AND n_added + n_sold > 0""",
    "photo_coverage": f"{_with(_COVERAGE)} SELECT * FROM coverage",
    "low_photo_coverage": f"{_with(_COVERAGE)} SELECT * FROM coverage WHERE total >= 3 AND coverage_pct < 50",
    "abc_analysis": f"""{_with(_CATEGORY_REVENUE)} SELECT category, qty, revenue, share_pct, cumulative_pct, abc_class
      FROM classes""",
    "abc_summary": f"""{_with(_CATEGORY_REVENUE)} SELECT abc_class, count(category) AS categories,
      CAST(round_even(sum(CAST(revenue AS DECIMAL(28,4))), 2) AS DOUBLE) AS revenue,
      CAST(sum(CAST(share_pct AS DECIMAL(18,1))) AS DOUBLE) AS share_pct FROM classes GROUP BY abc_class""",
    "orphan_photo_folders": f"{_with(_PHOTOS)} SELECT folder FROM orphans",
    "orphan_photo_summary": f"""{_with(_PHOTOS)} SELECT count(*) AS orphan_folders,
      (SELECT string_agg(folder, ', ' ORDER BY folder) FROM (SELECT folder FROM orphans ORDER BY folder LIMIT 10)) AS first_folders,
      greatest(count(*) - 10, 0) AS not_shown FROM orphans""",
    "apply_markdowns": f"""{_with(_TRANSITIONS)} SELECT sku, listed_at,
      CAST(CASE WHEN to3 THEN 3 WHEN to2 THEN 2 WHEN to1 THEN 1 ELSE markdown_stage END AS INTEGER) AS markdown_stage FROM steps""",
    "markdown_transitions": f"""{_with(_TRANSITIONS)} SELECT to_stage_1, to_stage_2, to_stage_3,
      to_stage_1 + to_stage_2 + to_stage_3 AS total_updated FROM (
        SELECT count(CASE WHEN to1 THEN 1 END) AS to_stage_1, count(CASE WHEN to2 THEN 1 END) AS to_stage_2,
          count(CASE WHEN to3 THEN 1 END) AS to_stage_3 FROM steps)""",
    "label_manifest": f"""{_with(_LABELS)} SELECT sku, description,
      CASE WHEN length(description) > 15 THEN array_to_string(string_split(description, ' ')[1:2], ' ') ELSE description END AS line1,
      CASE WHEN length(description) > 15 THEN NULLIF(array_to_string(string_split(description, ' ')[3:], ' '), '') END AS line2,
      '{CONDITION_TEXT}' || condition AS condition_text, price_text,
      CASE WHEN markdown_stage > 0 THEN '(' || list_price_text || ')' END AS original_price_text FROM labels""",
    "label_sheets": f"{_with()} {_slots(2, 4)}",
    "label_sheet_first": f"{_with()} SELECT * FROM ({_slots(3, 6)}) WHERE slot < 18",
}

# Another way to the same rows.
ORACLE_SQL |= {same: ORACLE_SQL[name] for same, name in {
    "upsert_items_by_month": "upsert_items", "delete_items_by_month": "delete_items", "markdowns_in_two_runs": "apply_markdowns",
    "item_lookup_by_month": "item_lookup", "newest_stock": "recent_stock_photo", "newest_labels": "label_batch_filtered",
    "newest_markdown_labels": "markdown_label_items",
    "search_consignors_by_index": "search_consignors", "gallery_by_index": "gallery_filtered",
    "rolled_kpis": "kpis", "rolled_revenue_by_category": "revenue_by_category", "rolled_performance_by_stage": "performance_by_stage",
    "rolled_high_demand": "high_demand_of_a_year", "rolled_top_consignors": "top_consignors", "rolled_payouts": "payouts",
    "rolled_abc_analysis": "abc_analysis", "refreshed_payouts": "payouts", "refreshed_performance_by_stage": "performance_by_stage",
    **{f"dashboard_{name}": name for name in (
        "photo_stats", "markdown_pending", "old_items", "overstocked_categories", "action_summary", "stock_by_stage", "slow_movers",
        "stock_gaps", "pending_markdowns", "pending_total", "category_ageing", "problem_categories", "photo_coverage", "low_photo_coverage",
    )},
}.items()}
ORACLE_SQL["abc_by_item"] = f"""{_with()},
  sold AS (SELECT sku, count(*) AS qty, sum(CAST(net AS DECIMAL(28,4))) AS revenue FROM sales s WHERE {_IN_PERIOD} GROUP BY sku),
  running AS (SELECT *, sum(revenue) OVER (ORDER BY revenue DESC, sku ROWS UNBOUNDED PRECEDING) AS reached, sum(revenue) OVER () AS whole FROM sold)
  SELECT sku, qty, CAST(revenue AS DOUBLE) AS revenue, CAST(revenue AS DOUBLE) / CAST(whole AS DOUBLE) * 100 AS share_pct,
    CAST(reached AS DOUBLE) / CAST(whole AS DOUBLE) * 100 AS cumulative_pct,
    CASE WHEN reached * 100 <= 80 * whole THEN 'A' WHEN reached * 100 <= 95 * whole THEN 'B' ELSE 'C' END AS abc_class FROM running"""
ORACLE_SQL["relisted_items"] = f"""{_with(_CHANGES)}
  SELECT i.sku, category, CASE WHEN n.sku IS NULL THEN i.list_price ELSE n.list_price END AS list_price,
    CASE WHEN n.sku IS NULL THEN i.listed_at ELSE n.changed_at END AS listed_at, active
  FROM items i LEFT JOIN last_changes n ON n.sku = i.sku
  UNION ALL SELECT sku, NULL, list_price, changed_at, 1 FROM last_changes WHERE sku NOT IN (SELECT sku FROM items)"""
